import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sproutscope.llm import token_orc as o
from sproutscope.session import new_path

PATH = P.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
WORDS = o.Words(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab' \n\t\x1cé中1²!#sre  😀<|endoftext|>", max_size=60), max_size=4))
def test_words_give_the_library_ids(texts):
    want = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in WORDS.encode(texts)] == want


def test_other_tokenizers_get_whole_texts():
    path = P.path("word_bpe_49k.json")
    own, plain = o.Words(path), Tokenizer.from_file(path)
    assert not own.by_word
    text = "Some Words  here"
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_round_trip_by_brute_force(docs, prose):
    pairs = [(5, prose(5, 30)), (1, None), (3, ""), (9, "a b"), (9, "a b"), (2, prose(2, 3000)), (None, "x y"), (-4, "neg")]
    rows = {}
    found = o.round_trip(docs(pairs).selectExpr("*", "1 AS part", "2 AS ids"), PATH).collect()
    for r in found:
        rows.setdefault(r.doc_id, []).append(r)
    start = 0
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        ids = np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        row = next(r for r in rows[i] if r.start == start)
        assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(found) == len(pairs)


def test_files_have_bloom_filters_and_pruned_lookups(spark, docs, prose):
    path = new_path(spark, "orc-test")
    o.write(docs([(i, prose(i, 20)) for i in range(500)]), PATH, path)
    stored = o.read(spark, path)
    assert stored.where("doc_id = 77").count() == 1
    plan = stored.where("doc_id = 77").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in plan and "ids" not in plan.split("ReadSchema")[1]


@pytest.fixture
def even_ids(spark, docs, prose):
    """One file of 5,000 even ids, a few index groups long."""
    path = new_path(spark, "orc-lookups")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        o.write(docs([(2 * i, prose(i, 5)) for i in range(5000)]), PATH, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    return o.read(spark, path)


def rows_read(df):
    """Rows that the scan gave after skipping stripes and row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_lookups_skip_row_groups_by_index_and_bloom_filter(even_ids):
    assert 0 < rows_read(even_ids.where("doc_id = 4444").select("n_tokens")) <= o.INDEX_STRIDE
    # odd ids lie between the least and the most of a group, so only the Bloom filter can rule them out
    read = [rows_read(even_ids.where(f"doc_id = {2 * i + 1}").select("n_tokens")) for i in range(500, 4500, 200)]
    assert sum(n > 0 for n in read) <= 2


def test_ids_are_the_same_whatever_the_pieces_of_work(prose):
    texts = [prose(k, 40) + ".\nNext " + " " * (k % 3) + prose(-k, 3) for k in range(60)] + ["", None, " ", "  a", "a ", "\n b"]
    fresh = o.Words(PATH)
    together = fresh.encode(texts)
    assert together == [fresh.encode([t])[0] for t in texts]
    fresh.bytes_of[:] = 0  # tokens that can't be told apart by their bytes
    fresh.forget()
    assert fresh.encode(texts) == together


def test_parts_are_looked_up_among_the_few_at_hand(prose, monkeypatch):
    """Known parts are the values looked up, never the set that Arrow hashes at each call; forgetting changes no id."""
    sets, find = [], o.pc.index_in
    monkeypatch.setattr(o.pc, "index_in", lambda values, value_set: (sets.append(len(value_set)), find(values, value_set=value_set))[1])
    texts = [prose(k, 60) + " a\tb 1." for k in range(30)]
    want = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    for remembered in (o.REMEMBERED, 200):
        monkeypatch.setattr(o, "REMEMBERED", remembered)
        own = o.Words(PATH)
        got = [np.frombuffer(own.encode([t])[0], "<u4").tolist() for t in texts + texts]
        assert got == want + want
        assert len(own.known) > 1000 if remembered > 200 else len(own.known) <= 200
    assert max(sets) < 100


def test_empty_table(docs):
    assert o.round_trip(docs([]), PATH).count() == 0
