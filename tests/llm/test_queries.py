"""Every registered query against its SQL, and the pipeline against a brute-force version."""

import re
import sys
from pathlib import Path

import public_tokenizers
import pytest
from conftest_llm import DATA
from test_neighbours import brute_classes, brute_coverage
from test_secrets import base_spans
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from postsift.llm import packing, queries  # noqa: E402


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    rel = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, rel.fetchall())


def test_each_operator_has_one_query():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_matches_brute_force(spark, duck):
    kept = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({queries.ORACLES['op1_quality_rules']}) q WHERE kept").fetchall()}
    docs = [(i, t) for i, t in duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if i in kept]
    docs = [(i, t) for (i, t), (_, c, _) in zip(docs, brute_classes(docs)) if i == c]
    plain = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [plain(t) for _, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()]
    clean = []
    for i, text in docs:
        words = plain(text)
        seeds = {tuple(words[k:k + 5]) for k in range(len(words) - 4)}
        near = [x for x in items if any(tuple(x[k:k + 5]) in seeds for k in range(len(x) - 4))]
        if not any(brute_coverage(words, x, 5) >= 0.5 for x in near):
            clean.append((i, text))
    model, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for i, text in clean:
        out, at = "", 0
        for start, _, stop in base_spans(text):
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, stop)
        ids, at = [*model.encode(out + text[at:], add_special_tokens=False).ids, 1], 0
        for size in packing.piece_lengths(len(ids)):
            want.add((i, at, size, b"".join(x.to_bytes(4, "little") for x in ids[at: at + size])))
            at += size
    got = {(r.doc_id, r.start, r.length, bytes(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and len(clean) < len(kept)


def test_stages_keep_columns_and_take_odd_rows(spark, edge, nothing):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, nothing.select(docs.columns)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, DATA)
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            out.count()
