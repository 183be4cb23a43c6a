import random
import re

from conftest_llm import docs_frame

from postsift.llm import secrets as S


def base_spans(text):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


ID = "ASIAQ7X2M4K8P1Z5"
KEY = "wJalrXUtnFEMI7K7MDENGbPxRfiCYEXAMPLE" + "KEYa"
TEXTS = [
    'token = "abcdef123" 😀 PASSWORD:xyz secret:token:abcdefgh', "AKIA" + "A1" * 8 + " AKIAAKIA" + "B" * 14 + " AKIA123",
    "x" + "0123456789abcdef" * 2 + "g api_key='0123456789abcdef01234567'", None, "", "api-key=nothing", "é" * 50 + "apikey=éabc apikey=abcdefg",
    "pad " * 30_000 + " secret=tail99", f"{ID} uses {KEY} today", f"only {KEY} here", f"only {ID} here",
    f"{ID} " + "far " * 400 + KEY, f"see https://host.example.com/x and {ID} with {KEY}", "see https://host.example.com/x alone",
    "password=abcdef AKIA" + "Z" * 16 + " https://host.example.com/x",
]


def all_spans(text, scope):
    """Base spans and, from every pair of spans, the weak ones that are completed, with Python's own matcher."""
    base = [(lo, S.KINDS[k], hi) for lo, k, hi in base_spans(text)]
    weak = [(m.start(), kind, m.end()) for kind, (pattern, _, _) in S.WEAK.items() for m in re.finditer(pattern, text)]
    weak = [w for w in weak if not any(w[0] < b[2] and b[0] < w[2] for b in base)]

    def near(w, role):
        return any(S.ROLES[p[1]] == role and (0 <= p[0] - w[2] <= scope or 0 <= w[0] - p[2] <= scope) for p in base + weak)

    found = [w for w in weak if all(near(w, role) for role in S.NEEDS[w[1]])]
    return sorted((lo, S.KINDS.index(k), hi) for lo, k, hi in base + found)


PARTS = ["alice.b@mail.example.com", "user: alice", "login=bob7", "client_id='9aF3kQ81LmZx04TTqw2b'", ID, "pass: Xy7!", "pwd=hunter2",
         "0123456789abcdef", "aB3dE6gH9jK2mN5pQ8sT", KEY, "token=abcdef12", "AKIA" + "Q2" * 8, "deadbeef" * 4, "db.example.com:5432",
         "postgres://db.example.com/x", "host = db1.local", "4785380592391139", "Passage ends: word", "é😀"]


def test_interval_join_equals_all_pairs(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice(PARTS) if draw.random() < 0.1 else "wörd" for _ in range(draw.randrange(1, 400))) for _ in range(150)]
    texts += [f"{a} {b}" for a in PARTS for b in PARTS]
    want = [all_spans(t, 60) for t in texts]
    rows = {r.doc_id: [tuple(s) for s in r.all] for r in S.scan(docs_frame(spark, list(enumerate(texts))), scope=60).collect()}
    assert [rows[i] for i in range(len(texts))] == want
    kinds = {k for spans in want for _, k, _ in spans}
    assert kinds == set(range(len(S.KINDS))), "every kind is linked somewhere"


def test_clean_documents_get_no_linked_spans(spark):
    clean = ["write to alice.b@mail.example.com or see https://example.com/about", "user: alice, host = db1.local", "pass: the salt",
             "client_id='9aF3kQ81LmZx04TTqw2b'", "card 4785380592391139 of alice.b@mail.example.com", "build 0123456789abcdef"]
    rows = S.digests(S.scan(docs_frame(spark, list(enumerate(clean))))).collect()
    assert all(r.spans == "" and r.n_linked == 0 for r in rows)


def test_strong_spans_and_linked_ones(spark):
    rows = {r.doc_id: r for r in S.scan(docs_frame(spark, list(enumerate(TEXTS)))).collect()}
    kinds = {}
    for i, text in enumerate(TEXTS):
        assert [tuple(s) for s in rows[i].base] == base_spans(text or ""), text
        base = {tuple(s) for s in rows[i].base}
        kinds[i] = [S.KINDS[s.kind] for s in rows[i].all if tuple(s) not in base]
        assert base <= {tuple(s) for s in rows[i].all}
    assert kinds[8] == ["weak_id", "weak_key"] and kinds[9] == kinds[10] == kinds[11] == kinds[13] == []
    assert kinds[12] == ["weak_endpoint", "weak_id", "weak_key"] and kinds[14] == ["weak_endpoint"]


def test_redaction_and_odd_rows(spark, edge, nothing):
    docs = docs_frame(spark, list(enumerate(TEXTS)))
    clean = {r.doc_id: r.text for r in S.redacted(docs).collect()}
    for i, text in enumerate(TEXTS):
        if i in (3, 4, 5, 9, 10, 11, 13):
            assert clean[i] == text
        elif i < 8:
            want, at = "", 0
            for start, _, stop in base_spans(text):
                if start >= at:
                    want += text[at:start] + "[SECRET]"
                at = max(at, stop)
            assert clean[i] == want + text[at:]
    assert S.scan(edge).count() == edge.count() and S.redacted(edge).columns == edge.columns
    assert S.redacted(edge).count() == edge.count()
    assert S.digests(S.scan(nothing)).count() == 0
