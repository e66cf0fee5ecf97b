import gzip
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sproutscope import schemas as S
from sproutscope.operators import cohort as co
from sproutscope.plans import study
from sproutscope.sources import events as src
from sproutscope.sources import tables as tab


def _push(i, when="2024-01-05T06:07:08Z", payload=None, **more):
    return {
        "id": str(i), "type": S.PUSH, "created_at": when, "repo": {"id": 1, "name": "a/b"},
        "actor": {"login": "ann"}, "payload": {} if payload is None else payload, **more,
    }


def test_lenient_lines(spark, tmp_path):
    lines = [json.dumps(_push(1)), "", "   ", '{"id": "2", "type"', json.dumps(_push(3, when="yesterday"))]
    (tmp_path / "feed.json").write_text("\n".join(lines))
    good, bad = src.split_corrupt(src.read_events(spark, str(tmp_path)))
    assert {r.id for r in good.collect()} == {"1", "3"}
    assert bad.count() == 1
    assert [r.event_id for r in src.flatten_events(good).collect()] == ["1"]


def test_feed_counts_malformed_lines_while_it_is_read(spark, tmp_path):
    lines = [json.dumps(_push(1)), "", "   ", '{"id": "2", "type"', json.dumps(_push(3))]
    (tmp_path / "feed.json").write_text("\n".join(lines))
    events, counts = src.read_feed(spark, str(tmp_path))
    assert {r.id for r in events.collect()} == {"1", "3"}
    assert counts.get == {"good": 2, "malformed": 1}
    flat, _ = src.read_feed(spark, str(tmp_path))
    plan = src.flatten_events(flat)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1  # of the payload alone


def test_payload_object_equals_payload_string(spark, tmp_path):
    body = {"action": "opened", "issue": {"number": 4, "created_at": "2024-01-02T00:00:00Z"}}
    rows = [{**_push(i, payload=p), "type": S.ISSUE} for i, p in enumerate([body, json.dumps(body)])]
    (tmp_path / "feed.json").write_text("\n".join(map(json.dumps, rows)))
    good, _ = src.split_corrupt(src.read_events(spark, str(tmp_path)))
    first, second = [r.asDict() for r in src.flatten_events(good).orderBy("event_id").collect()]
    first.pop("event_id"), second.pop("event_id")
    assert first == second
    assert first["number"] == "4" and first["action"] == "opened" and first["ym"] == "202401"


def test_missing_actor_becomes_blank(spark, tmp_path):
    row = _push(1)
    del row["actor"]
    (tmp_path / "feed.json").write_text(json.dumps(row))
    flat = src.flatten_events(src.read_events(spark, str(tmp_path)))
    assert flat.first().actor_login == ""


def test_hourly_archive_range(spark, tmp_path):
    for day, hour in [("2024-01-01", 23), ("2024-01-02", 0), ("2024-01-02", 13), ("2024-01-03", 5)]:
        with gzip.open(tmp_path / f"{day}-{hour}.json.gz", "wt") as out:
            out.write(json.dumps(_push(f"{day}-{hour}")) + "\nnot json\n")
    # a file that cannot be read, outside the range: it must not be opened
    (tmp_path / "2024-01-04-1.json.gz").write_text("not gzip")
    got = src.read_archive(spark, str(tmp_path), "2024-01-02", "2024-01-02")
    assert {r.id for r in got.collect()} == {"2024-01-02-0", "2024-01-02-13"}


def test_land_and_scan(spark, tmp_path):
    root, table = tmp_path / "raw", str(tmp_path / "table")
    root.mkdir()
    rows = [_push(i, when=f"2024-0{m}-05T00:00:00Z") for i, m in enumerate([1, 2, 2, 3])]
    (root / "2024-01-05-0.json").write_text("\n".join(map(json.dumps, rows)))
    for _ in range(2):  # landing the same files again changes nothing
        study.land_archive(spark, str(root), "2024-01-01", "2024-12-31", table)
    assert spark.read.schema(S.FLAT_EVENT).parquet(table).count() == 4
    landed = spark.read.schema(S.FLAT_EVENT).parquet(table)
    picked = src.scan_months(landed, "202402", "202402", types=[S.PUSH], cols=["event_id", "ym"])
    assert picked.count() == 2
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan
    assert "PushedFilters" in plan and "PushEvent" in plan
    assert "payload" not in plan.split("ReadSchema")[1]


def test_series_documents_and_shards(spark, tmp_path):
    doc = lambda n, months: {"childOwner": "o", "childName": n, "forkTime": "2024-01-15T00:00:00Z", "commitTimes": months}
    (tmp_path / "series10.json").write_text(json.dumps([doc("x", {"2024-01": 3})]))
    (tmp_path / "series2.json").write_text(json.dumps([doc("y", None), doc("z", {})]))
    glob = str(tmp_path / "series*.json")
    assert tab.read_commit_series(spark, glob).count() == 3
    shards = [(r.shard, r.childName) for r in tab.union_shards(spark, glob).orderBy("shard", "childName").collect()]
    assert shards == [(2, "y"), (2, "z"), (10, "x")]


def test_csv_and_appends(spark, tmp_path):
    schema = T.StructType([T.StructField("repo_name", T.StringType()), T.StructField("created_at", T.TimestampType())])
    df = spark.createDataFrame([("a/b", None)], schema).withColumn("created_at", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    path = str(tmp_path / "t.csv")
    tab.write_table(df, path, "csv")
    tab.append_table(df, path, "csv")
    back = tab.read_table_csv(spark, path, schema)
    assert back.count() == 2
    assert back.first() == df.first()


def _fork(full_name="me/fork", **fields):
    forkee = {"full_name": full_name, "id": 5, "created_at": "2024-01-05T06:07:08Z", "owner": {"login": "me", "type": "User"}, **fields}
    return {
        "id": "e1", "type": S.FORK, "created_at": "2024-01-05T06:07:09Z", "repo": {"id": 9, "name": "up/stream"},
        "actor": {"login": "me"}, "payload": json.dumps({"forkee": forkee}),
    }


def _read(spark, tmp_path, rows):
    (tmp_path / "feed.json").write_text("\n".join(map(json.dumps, rows)))
    return src.split_corrupt(src.read_events(spark, str(tmp_path)))[0]


def test_fork_cohort(spark, tmp_path):
    rows = [
        _fork("me/content", size=10, topics=["x", "y"]),
        _fork("me/empty", size=0),
        _fork("org/empty", owner={"login": "org", "type": "Organization"}),
        _fork("me/archived", size=10, archived=True),
        _fork(None, size=10),
        _fork("me/badtime", size=1, created_at="soon"),
    ]
    kept, excluded = study.fork_cohort(_read(spark, tmp_path, rows))
    kept = {r.repo_name: r for r in kept.collect()}
    assert set(kept) == {"me/content", "org/empty", "me/badtime"}
    assert {r.repo_name for r in excluded.collect()} == {"me/empty"}
    assert kept["me/badtime"].created_at is None
    assert kept["me/content"].initial_topics == "x,y" and kept["org/empty"].initial_topics == ""
    assert kept["me/content"].parent_repo_name == "up/stream"
    assert list(kept["me/content"].asDict()) == S.COHORT_COLUMNS


def test_fork_duplicates_keep_the_latest(spark, tmp_path):
    early, late = _fork(size=1), _fork(size=2)
    late["created_at"] = "2024-01-06T00:00:00Z"
    kept, _ = study.fork_cohort(_read(spark, tmp_path, [late, early]))
    assert [r.initial_size_kb for r in kept.collect()] == [2]
    both, _ = study.fork_cohort(_read(spark, tmp_path, [late, early]), dedup=False)
    assert both.count() == 2


def test_creation_cohort(spark, tmp_path):
    make = lambda i, name, when, **more: {
        "id": str(i), "type": "CreateEvent", "created_at": when, "repo": {"id": i, "name": name},
        "actor": {"login": "ann"}, "payload": {"master_branch": "main"}, **more,
    }
    rows = [
        make(1, "a/a", "2023-12-01T00:00:00Z"),
        make(2, "a/a", "2023-12-02T00:00:00Z"),
        make(3, "b/b", "2024-01-31T23:59:59Z", org={"login": "b"}),
        make(4, "c/c", "2024-02-01T00:00:00Z"),
        make(5, "d/d", "never"),
        make(6, "", "2024-01-01T00:00:00Z"),
    ]
    got = {r.repo_name: r for r in study.creation_cohort(_read(spark, tmp_path, rows)).collect()}
    assert set(got) == {"a/a", "b/b"}
    assert got["a/a"].event_id == "1" and got["a/a"].fork_owner_type == "User"
    assert got["b/b"].fork_owner_type == "Organization" and got["b/b"].default_branch == "main"


def test_duplicate_rows_with_maps(spark):
    df = spark.createDataFrame(
        [("a", {"x": 1, "y": 2}), ("a", {"y": 2, "x": 1}), ("b", {"x": 1})], "k string, m map<string,long>"
    )
    assert [(r.k, r.copies) for r in co.duplicate_rows(df).collect()] == [("a", 2)]


def test_a_landed_day_is_few_files(spark, tmp_path):
    rows = [(f"e{k}", f"r/{k % 97}", "202401" if k % 2 else "202402", f"2024-0{1 if k % 2 else 2}-0{1 + k % 3}") for k in range(3000)]
    flat = spark.createDataFrame(rows, "event_id string, repo_name string, ym string, file_day string").repartition(50)
    for _ in range(2):  # landing again replaces the days
        src.land_events(flat, str(tmp_path / "t"))
        files = list((tmp_path / "t").glob("ym=*/file_day=*/*.parquet"))
        folders = {f.parent for f in files}
        assert len(folders) == 6 and len(files) <= 6 * src.DAY_REPO_BUCKETS * src.DAY_EVENT_BUCKETS
        assert spark.read.parquet(str(tmp_path / "t")).count() == 3000


def test_archive_text_is_compressed_and_not_shuffled(spark, tmp_path, monkeypatch):
    """The files of feeds and streams: every line once, in six files or more, with keys that repeat or are null."""
    import checks.adapters as adapters

    day = "DATE '1996-01-02'"
    make = lambda name, sql: spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    make("customer", "SELECT id AS c_custkey, id % 3 AS c_nationkey FROM range(4) UNION ALL SELECT NULL, 1L")
    make("orders", f"SELECT id % 40 AS o_orderkey, id % 4 AS o_custkey, {day} AS o_orderdate, if(id % 9 = 0, 'P', 'F') AS o_orderstatus FROM range(45) UNION ALL SELECT NULL, 1L, {day}, 'F'")
    make("lineitem", f"SELECT if(id % 50 = 0, NULL, id % 45) AS l_orderkey, id AS l_partkey, id % 5 AS l_suppkey, CAST(id % 7 + 1 AS INT) AS l_linenumber, {day} AS l_shipdate, if(id % 2 = 0, 'N', 'A') AS l_returnflag, if(id % 3 = 0, 'F', 'O') AS l_linestatus FROM range(300)")
    tables = adapters.Tables(spark, str(tmp_path))
    path = tables.archive_files("watched", 6)
    names = [f.rsplit("/", 1)[1] for f in spark.read.text(path).inputFiles()]
    assert len(names) >= 6 and all(n.endswith(".txt.gz") for n in names)
    lines = lambda df: sorted(r[0] for r in df.collect())
    assert lines(spark.read.text(path)) == lines(tables.archive_lines)
    assert spark.read.text(path).where("value LIKE '%created_at%'").count() == spark.sql(
        f"SELECT 1 FROM parquet.`{tmp_path}/lineitem.parquet` JOIN parquet.`{tmp_path}/orders.parquet` ON l_orderkey = o_orderkey JOIN parquet.`{tmp_path}/customer.parquet` ON o_custkey = c_custkey"
    ).count() > 200
    monkeypatch.setattr(adapters, "FILE_LINES", 20)  # long files are split, however many are asked for
    assert len(spark.read.text(tables.archive_files("feed")).inputFiles()) >= 12
