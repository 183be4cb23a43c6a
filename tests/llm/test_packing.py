import zlib

import public_tokenizers
import pyarrow as pa
from conftest_llm import EDGE
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postsift.llm import packing as P

FILE = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'SstzéÉİ́  　\n\t\r\x0b\x1c<|endoftx>.,!;0日Σς"), max_size=40)))
def test_ids_are_those_of_whole_texts(texts):
    texts = [*texts, "it's, It'S. <|endoftext|> <|ENDOFTEXT|> don't;", "", None]
    ids, begins = P.worker_tokenizer(FILE).encode(pa.array(texts, pa.string()))
    model = Tokenizer.from_file(FILE)
    for i, text in enumerate(texts):
        assert ids[begins[i]:begins[i + 1]].tolist() == model.encode(text or "", add_special_tokens=False).ids


@given(st.integers(0, 100_000))
def test_pieces_are_powers_of_two(n):
    sizes = P.piece_lengths(n)
    assert sum(sizes) == n and sizes == sorted(sizes, reverse=True)
    assert all(s & (s - 1) == 0 and s <= P.MAX_LEN for s in sizes) and len(set(s for s in sizes if s < P.MAX_LEN)) == sum(s < P.MAX_LEN for s in sizes)


def test_pieces_put_documents_together_again(spark, edge, nothing):
    rows = P.pack(edge, FILE).collect()
    model = Tokenizer.from_file(FILE)
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length == 1 << r.bucket for r in rows)
    found = {}
    for r in sorted(rows, key=lambda r: r.sequence_id):
        if r.start == 0:
            found.setdefault(r.doc_id, []).append(b"")
        found[r.doc_id][-1] += bytes(r.ids)
        assert len(found[r.doc_id][-1]) == 4 * (r.start + r.length)
    for key in {k for k, _ in EDGE}:
        want = []
        for _, text in (e for e in EDGE if e[0] == key):
            ids = [*model.encode(text or "", add_special_tokens=False).ids, P.END_ID]
            want.append(b"".join(i.to_bytes(4, "little") for i in ids))
        assert sorted(found[key]) == sorted(want)
    assert zlib.crc32(b"\1\0\0\0") == 2583214201  # what the query returns for the end id alone
    assert P.pack(nothing, FILE).count() == 0
