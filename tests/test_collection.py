"""Governance collected over several runs, some of them broken off."""

import json

import pytest

from sproutscope.plans import collection


def _answer(language):
    return json.dumps({"repository": {"license": {"name": "MIT"}, "primaryLanguage": {"name": language}}})


def _land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"repo_name": r, "response": x}) for r, x in rows))


@pytest.fixture
def cohort(spark):
    return spark.createDataFrame([(f"o/{k}",) for k in range(6)] + [("o/1",), (None,)], "repo_name string")


def _rows(df):
    return sorted((r.repo_name, r.answered, r.primary_language, r.file) for r in df.collect())


def test_runs_add_up_to_one(spark, cohort, tmp_path):
    folder, parts, whole = tmp_path / "landed", str(tmp_path / "parts"), str(tmp_path / "whole")
    run = lambda table: collection.collect(spark, collection.read_responses(spark, str(folder)), cohort, table)
    assert collection.collected(spark, parts) is None
    _land(folder, "a.json", [("o/0", _answer("Go")), ("o/1", "not json"), ("o/9", _answer("C"))])
    assert _rows(run(parts)) == [("o/0", True, "Go", "a.json"), ("o/1", False, None, "a.json")]
    before = _rows(run(parts))
    _land(folder, "b.json", [("o/0", _answer("Rust")), ("o/2", _answer("Ada")), ("o/3", None), ("o/2", _answer("Ada"))])
    after = _rows(run(parts))
    assert set(before) < set(after) and len(after) == 4
    assert after == _rows(run(parts)) == _rows(run(whole))
    assert sorted(r.repo_name for r in collection.answered(run(parts)).collect()) == ["o/0", "o/2"]


def test_a_run_that_broke_off_while_it_committed(spark, cohort, tmp_path):
    folder, table, whole = tmp_path / "landed", str(tmp_path / "table"), str(tmp_path / "whole")
    _land(folder, "a.json", [(f"o/{k}", _answer(f"l{k}")) for k in range(5)])
    responses = collection.read_responses(spark, str(folder))
    want = _rows(collection.collect(spark, responses, cohort, whole))
    # some of the files of the run are there, others aren't
    spark.read.parquet(whole).where("repo_name < 'o/3'").write.parquet(table)
    assert _rows(collection.collect(spark, responses, cohort, table)) == want


def test_only_pending_responses_are_parsed(spark, cohort, tmp_path):
    folder, table = tmp_path / "landed", str(tmp_path / "table")
    _land(folder, "a.json", [("o/0", _answer("Go"))])
    responses = collection.read_responses(spark, str(folder))
    collection.collect(spark, responses, cohort, table)
    _land(folder, "a.json", [("o/0", _answer("changed"))])
    assert _rows(collection.collect(spark, responses, cohort, table))[0][2] == "Go"
    empty = spark.createDataFrame([], "repo_name string")
    assert len(_rows(collection.collect(spark, responses, empty, table))) == 1
