"""URL filter and WARC archives."""

import base64
import hashlib
import itertools
import random

import pytest
import zstandard

from postsift.llm import url_filter as U
from postsift.llm import warc as A
from postsift.session import scratch_path

PAGES = "page_id long, url string, html string, host string, tokens string, payload string, sha1 string"


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]


def listed(host, path):
    fits = [r for r in U.LISTED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


ODD = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/1?x=1#y", "http://example.org", "http://example.org?q=/es/",
       "http://badexample.org/es/", "http://x.com/de/a://b/fr/", "http://org/", "http://a.example.org/en/1", "http://a.example.org/en/21",
       "http://é.com/fr/ü#://", "http://h.com\n/de/"]


def test_listed_rules_of_odd_urls(spark):
    rows = pages_frame(spark, [(i, u, None) for i, u in enumerate([*ODD, ODD[5]])])
    found = {r.page_id: r for r in U.judge(rows).collect()}
    for i, url in enumerate([*ODD, ODD[5]]):
        host, path = split_url(url)
        rule = listed(host, path)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule and rule.text), url
        if rule:
            assert found[i].verdict == rule.verdict
    assert U.judge(pages_frame(spark, [])).count() == 0


def test_mined_rules_match_all_subsets(spark):
    random_ = random.Random(4)
    urls = [f"http://{random_.choice(['m', 'www'])}.s{random_.randrange(3)}.{random_.choice(['com', 'org', 'net'])}/"
            f"{random_.choice(['fr', 'de', 'en', 'es'])}/{random_.choice(['a', 'b'])}" for _ in range(300)]
    rows = pages_frame(spark, [(i, u, None) for i, u in enumerate(urls)])
    found = {r.page_id: r for r in U.judge(rows, min_support=0.02, min_confidence=0.8).collect()}

    def tokens(url):
        host, path = split_url(url)
        return {f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in path.split("/") if x}

    labelled = [(tokens(u), r.verdict) for u in urls if (r := listed(*split_url(u)))]
    least = max(0.02, U.MIN_COUNT / len(labelled)) * len(labelled)
    rules = []
    names = sorted(set().union(*(t for t, _ in labelled)))
    for size in range(1, 7):
        for some in itertools.combinations(names, size):
            hits = [v for t, v in labelled if t >= set(some)]
            for verdict in ("allow", "block"):
                n = hits.count(verdict)
                if n and n >= least - 1e-9 and n / len(hits) >= 0.8:
                    rules.append((n / len(hits), size, n / len(labelled), verdict, " ".join(some)))
    mined = 0
    for i, url in enumerate(urls):
        if listed(*split_url(url)) is None:
            best = max((r for r in rules if tokens(url) >= set(r[4].split(" "))), default=None)
            assert found[i].verdict == (best[3] if best else "allow") and found[i].mined_rule == (best and best[4])
            mined += best is not None
    assert mined > 20


def test_archives_give_the_pages_back(spark):
    random_ = random.Random(2)
    bodies = ["".join(random_.choice(["<p>", "</p>", "word ", "text ", "é", str(random_.random())]) for _ in range(80)) for _ in range(60)]
    rows = [(i, f"http://h/{i}", b) for i, b in enumerate(bodies)]
    rows += [(100, "http://copy", bodies[7]), (101, None, None), (102, "http://e\r\nWARC-Type: x", ""), (None, "http://n", bodies[7]),
             (None, "http://n2", "only here"), (103, "http://long", "long " * 300_000), (3, "http://again", bodies[3])]
    pages = pages_frame(spark, rows)
    found = A.archive(pages).collect()
    first = {}
    for key, _, body in rows:
        if key is not None:
            first[body or ""] = min(key, first.get(body or "", key))
    want = []
    for key, url, body in rows:
        data = (body or "").encode()
        lead = first.get(body or "")
        new = key == lead or lead is None
        want.append((key, url and url.replace("\r\n", "%0D%0A"), "response" if new else "revisit", len(data),
                     base64.b32encode(hashlib.sha1(data).digest()).decode(), None if new else lead, data if new else None))
    plain = [(*r[:6], None if r.payload is None else bytes(r.payload)) for r in found]
    assert sorted(map(str, plain)) == sorted(map(str, want))
    assert A.archive(pages_frame(spark, [])).count() == 0


def test_an_archive_carries_its_dictionary(spark):
    bodies = [f"<html><body>{'shared words of many pages ' * 20}{i * 7919}</body></html>" for i in range(200)]
    pages = pages_frame(spark, [(i, f"http://h/{i}", b) for i, b in enumerate(bodies)]).coalesce(1)
    dictionary = A.build_dictionary(pages)
    # Record headers repeat in every frame, so the dictionary must hold them.
    assert b"WARC-Payload-Digest: sha1:" in dictionary and b"shared words of many pages" in dictionary
    giant = pages.union(pages_frame(spark, [(1000, "http://giant", "giant " * 400_000)]))
    assert A.build_dictionary(giant) and A.build_dictionary(giant, sample=1 << 16) and A.build_dictionary(giant, sample=64) == b""
    path = scratch_path(spark, "warc_test")
    A.write_archives(A.mark_revisits(pages), dictionary, path)
    data = bytes(spark.read.format("binaryFile").load(path).filter("length > 0").first().content)
    assert int.from_bytes(data[:4], "little") == A.DICTIONARY and data[8: 8 + len(dictionary)] == dictionary
    records = list(A.frames_of(data))
    assert len(records) == 200 and all(r.startswith(b"WARC/1.1\r\n") for r in records)
    without = sum(len(zstandard.ZstdCompressor(level=A.LEVEL).compress(r)) for r in records)
    assert len(data) - len(dictionary) < without
    broken = records[0].replace(b"shared", b"shaRed")
    with pytest.raises(ValueError, match="differs"):
        A.parse_record(broken)
    with pytest.raises(ValueError, match="ends within"):
        list(A.frames_of(data[: len(data) - 40]))


def test_tokens_that_always_occur_together_stand_for_one(spark):
    """Thirty tokens in every url would make 2^30 combinations."""
    path = "/".join(f"s{i}" for i in range(30))
    urls = [f"http://a{i % 2}.{['org', 'com'][i % 2]}/{['x', 'de'][i % 2]}/{path}" for i in range(200)]
    urls += [f"http://a1.net/{path}", f"http://b.net/{path}", "http://a0.net/s7", "http://b.net/x"]
    rows = U.judge(pages_frame(spark, [(i, u, None) for i, u in enumerate(urls)]), min_support=0.1, default="none").collect()
    verdicts = {r.page_id: r.verdict for r in rows}
    assert [verdicts[200], verdicts[201], verdicts[202], verdicts[203]] == ["block", "none", "allow", "allow"]
    table = spark.createDataFrame([(["b", "a", "c"],), (["a", "b"],), (["d", "e"],), (["e"],)], "tokens array<string>")
    assert sorted(tuple(r) for r in U.frequent_tokens(table, 1).collect()) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e")]
