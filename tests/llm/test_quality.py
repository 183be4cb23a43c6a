import re
from collections import Counter

from conftest_llm import EDGE

from postsift.llm import quality as Q


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_measures_of_odd_texts(spark, edge):
    rows = Q.ledger(edge).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert Counter(map(tuple, rows)) == Counter(expected(t) for _, t in EDGE)


def test_repeats_lines_and_symbols(spark):
    from conftest_llm import docs_frame

    texts = ["a b c a b c a", "x\nx\n \nx\ny", "## $$ | <b> %", "a a a a", "p q r s p q"]
    rows = Q.ledger(docs_frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows] == [expected(t) for t in texts]


def test_policies_and_ablations(spark, edge, nothing):
    entries = Q.ledger(edge).cache()
    kept = entries.filter(Q.passes(Q.V1)).count()
    assert Q.keep_passing(edge).count() == kept and Q.keep_passing(edge).columns == edge.columns
    for row in Q.ablations(entries, [Q.BASE, Q.V1]).collect():
        policy = Q.BASE if row.version == "base" else Q.V1
        rest = Q.Policy("rest", tuple(r for r in policy.rules if r != row.rule))
        assert row.documents == len(EDGE)
        assert row.failed == entries.filter(~Q.passes(Q.Policy("one", (row.rule,)))).count()
        assert row.kept_without == entries.filter(Q.passes(rest)).count()
        assert row.only_this == row.kept_without - entries.filter(Q.passes(policy)).count()
    assert Q.ledger(nothing).count() == 0 and Q.ablations(Q.ledger(nothing), [Q.V1]).count() == 0
