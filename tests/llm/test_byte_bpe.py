import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sproutscope.llm import byte_bpe as b

RANKS = P.path("byte_bpe_50k.tiktoken")
PLAIN = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=b.load_ranks(RANKS), special_tokens={})
TEXT = st.text(alphabet="ab' \n\t\x1cé中1²!#sre  😀", max_size=80)


def stitched(own, text, chunk, overlap):
    chunks, found = [], []
    for origin, part in b.cut(text, chunk, overlap):
        starts, counts, ids = own.pieces(part, origin)
        chunks.append((origin, part, np.frombuffer(starts, "<i8").tolist()))
        found.append((np.concatenate([[0], np.cumsum(np.frombuffer(counts, "<u4"))]).astype(int) * 4, ids))
    out = []
    for k, x, y in b.stitch(chunks, own.pattern):
        out.append(b"".join(own.ids_of(p) for p in x) if k is None else found[k][1][found[k][0][x] : found[k][0][y]])
    return np.frombuffer(b"".join(out), "<u4").tolist()


@settings(max_examples=600, deadline=None)
@given(TEXT, st.integers(1, 20), st.integers(0, 12))
def test_chunks_of_any_size_give_the_library_ids(text, chunk, overlap):
    own = b.Pieces(RANKS, P.PATTERN) if not hasattr(test_chunks_of_any_size_give_the_library_ids, "own") else test_chunks_of_any_size_give_the_library_ids.own
    test_chunks_of_any_size_give_the_library_ids.own = own
    want = PLAIN.encode_ordinary(text)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == want
    assert stitched(own, text, chunk, overlap) == want


@pytest.mark.parametrize("text", ["x" * 5000, " " * 3000 + "a", "中" * 2000, "a\n" * 999, "' " * 700])
def test_texts_without_a_place_to_meet(text):
    assert stitched(b.Pieces(RANKS, P.PATTERN), text, 100, 20) == PLAIN.encode_ordinary(text)


def test_table_with_long_texts_and_odd_rows(docs, prose):
    long = prose(1, 900) + "  \n" + prose(2, 900)
    pairs = [(1, None), (2, ""), (3, "hi there"), (4, long), (5, long), (5, long), (None, long + "x"), (7, "z" * 4000)]
    table = docs(pairs).selectExpr("*", "1 AS name", "2 AS number", "'x' AS ids", "0 AS n_tokens")
    encoded = b.encode(table, RANKS, P.PATTERN, chunk_chars=500, overlap_chars=40)
    assert "name" in encoded.columns and "text" not in encoded.columns
    rows = b.digests(encoded, RANKS).collect()
    assert len(rows) == len(pairs)
    want = sorted((str(i), len(PLAIN.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs)
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in rows) == want
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].ids_sha256 == hashlib.sha256(" ".join(map(str, PLAIN.encode_ordinary(long))).encode()).hexdigest()
    assert {bytes(r.text_bytes) for r in b.decode(encoded, RANKS).where("doc_id = 4").collect()} == {long.encode()}


def test_empty_table(docs):
    assert b.digests(b.encode(docs([]), RANKS, P.PATTERN), RANKS).count() == 0


def test_digests_are_taken_by_the_worker_that_encodes(docs, prose):
    table = docs([(1, None), (2, prose(1, 30)), (3, prose(2, 900)), (3, prose(2, 900))])
    once = b.encode(table, RANKS, P.PATTERN, chunk_chars=500, overlap_chars=40, digested=True)
    twice = b.digests(b.encode(table, RANKS, P.PATTERN, chunk_chars=500, overlap_chars=40), RANKS)
    python = [line for line in once._jdf.queryExecution().executedPlan().toString().split("\n") if "InArrow" in line]
    assert len(python) == 4  # short texts, cuts, chunks, stitches: none on top of another
    assert sorted(map(str, once.select(*twice.columns).collect())) == sorted(map(str, twice.collect()))
