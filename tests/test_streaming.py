"""Draining a folder in several runs equals the batch result over all of it."""

import json
from datetime import timedelta

from sproutscope import schemas as S
from sproutscope.operators.activity import activity
from sproutscope.operators.contributors import contributor_months
from sproutscope.operators.labels import labels
from sproutscope.sources.events import flatten_events, read_events
from sproutscope.streaming import archive as st


def _line(i, name, when, kind=S.PUSH, actor="ann", payload=None):
    return json.dumps(
        {
            "id": str(i), "type": kind, "created_at": when.strftime("%Y-%m-%dT%H:%M:%SZ"),
            "repo": {"name": name}, "actor": {"login": actor}, "payload": payload or {},
        }
    )


def _write(folder, ts, part):
    base = ts("2024-01-01")
    lines = []
    for i in range(40):
        when = base + timedelta(days=part * 40 + i)
        kind, payload = (S.WATCH, {"action": "started"}) if i % 5 == 0 else (S.PUSH, None)
        lines.append(_line(f"{part}-{i}", f"a/{i % 3}", when, kind, f"u{i % 4}", payload))
    lines.append("cut off {")
    if part == 1:
        lines.append(_line("late", "a/1", base + timedelta(days=600)))
    (folder / f"part{part}.json").write_text("\n".join(lines))


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_restart_counts_each_file_once(spark, tmp_path, ts):
    folder = tmp_path / "in"
    folder.mkdir()
    cohort = spark.createDataFrame(
        [(f"a/{i}", ts("2024-01-01")) for i in range(4)], "repo_name string, created_at timestamp"
    )
    tables = {n: (str(tmp_path / n), str(tmp_path / f"{n}-progress")) for n in ("activity", "labels", "months")}

    def run():
        stream = st.stream_archive(spark, str(folder), files_per_batch=1)
        st.drain(st.stream_activity(stream, cohort, *tables["activity"]))
        st.drain(st.stream_labels(stream, cohort, *tables["labels"]))
        st.drain(st.stream_contributor_months(stream, cohort, *tables["months"]))

    _write(folder, ts, 0)
    run()
    _write(folder, ts, 1)
    run()
    run()

    flat = flatten_events(read_events(spark, str(folder)))
    got = st.read_activity(spark.read.parquet(tables["activity"][0]), cohort)
    assert _rows(got) == _rows(activity(flat, cohort))
    got = st.read_labels(spark.read.schema("repo_name string").parquet(tables["labels"][0]), cohort)
    assert _rows(got) == _rows(labels(flat, cohort))
    assert got.where("is_sustainable = 1").count() == 1
    got = st.read_contributor_months(spark.read.parquet(tables["months"][0]))
    assert _rows(got) == _rows(contributor_months(flat, cohort))


def test_found_repositories_are_not_joined_again(spark, ts, tmp_path):
    table = str(tmp_path / "hits")
    anchors = spark.createDataFrame([("a",), ("b",), ("c",)], "repo_name string")
    assert st.open_anchors(spark, table, anchors, 0).count() == 3
    spark.createDataFrame([("a",)], "repo_name string").write.parquet(f"{table}/batch_id=0")
    spark.createDataFrame([("b",)], "repo_name string").write.parquet(f"{table}/batch_id=1")
    left = lambda batch: sorted(r[0] for r in st.open_anchors(spark, table, anchors, batch).collect())
    assert left(1) == ["b", "c"]  # a batch that is run again doesn't see its own rows
    assert left(2) == ["c"]
