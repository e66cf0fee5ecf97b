import hashlib

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from sproutscope.llm import byte_bpe

PLAIN = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "decontamination", "byte_bpe"]
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


@pytest.fixture
def folder(spark, docs, prose, tmp_path):
    """Tables with one planted case of each kind among clean documents."""
    clean = [(k, prose(k, 60 + k)) for k in range(40)]
    leak = prose("benchmark", 25)
    bad = [
        (100, None),
        (101, ""),
        (102, "12345 --- 67890"),
        (103, "### " * 40),
        (104, "too short"),
        (105, prose(3, 63)),
        (106, " ".join([*prose(4, 64).split()[:-1], "changed"])),
        (107, f"{prose('x', 40)} {leak} {prose('y', 40)}"),
        (107, f"{prose('x', 40)} {leak} {prose('y', 40)}"),
    ]
    docs([*clean, *bad]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), clean


def test_planted_documents_go_and_clean_ones_stay(spark, folder):
    path, clean = folder
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in clean]
    texts = dict(clean)
    for r in got:
        ids = PLAIN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_each_stage_keeps_the_columns_and_its_own_input(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "'extra' AS score", "1 AS node", "2 AS text_key")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        assert out.count() == out.join(docs.select("doc_id").distinct(), "doc_id").count() > 40


def test_empty_tables(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
