"""Sources and sinks, cohort records, filters, deduplication, profiles, governance."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.adapters import rounded, with_archive, with_commits, with_feed
from checks.registry import check
from sproutscope import schemas as S
from sproutscope.functions import scalars as fn
from sproutscope.operators import cohort as co
from sproutscope.operators import governance as gov
from sproutscope.operators import profiles
from sproutscope.plans import collection
from sproutscope.session import new_path, stage
from sproutscope.sources import events as src
from sproutscope.sources import tables as tab

# ---------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------
FLAT_SQL = """
SELECT event_id, type, repo_name, actor_login, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, ym, action,
  CASE WHEN type IN ('IssuesEvent', 'IssueCommentEvent', 'PullRequestEvent', 'PullRequestReviewCommentEvent') THEN number END AS number,
  CASE WHEN type IN ('IssuesEvent', 'IssueCommentEvent', 'PullRequestEvent', 'PullRequestReviewCommentEvent')
    THEN strftime(opened_at, '%Y-%m-%d %H:%M:%S') END AS opened_at,
  merged
FROM archive
"""


@check("src1_event_lines", with_archive(FLAT_SQL))
def _(t):
    """NDJSON text written, read back leniently and flattened."""
    path = new_path(t.spark, "feed")
    t.archive_lines.write.text(path)
    good, _counts = src.read_feed(t.spark, path)
    return rounded(src.flatten_events(good).drop("commit_emails"))


@check(
    "src1_counts_while_reading",
    """SELECT (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS good,
              (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS malformed,
              (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS landed""",
)
def _(t):
    """Good and malformed lines counted by the pass that lands the events."""
    good, counts = src.read_feed(t.spark, t.archive_files("feed"))
    landed = stage(src.flatten_events(good), "landed").count()
    return t.spark.createDataFrame([(counts.get["good"], counts.get["malformed"], landed)], "good long, malformed long, landed long")


@check(
    "src1_malformed_lines",
    """SELECT (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS good,
              (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS malformed""",
)
def _(t):
    raw = src.parse_event_lines(t.archive_lines)
    return profiles.conditional_counts(
        raw, good=F.col(S.CORRUPT).isNull(), malformed=F.col(S.CORRUPT).isNotNull()
    ).drop("total")


@check(
    "src2_archive_dates",
    with_archive("""
SELECT type, count(*) AS events, count(DISTINCT repo_name) AS repos FROM archive
WHERE event_ts >= DATE '1996-03-05' AND event_ts < DATE '1996-04-21' GROUP BY 1
"""),
)
def _(t):
    """Gzip lines by month, restricted by the rule on the date in a file's name; each event's day stands for its file."""
    path = new_path(t.spark, "archive")
    lines = t.archive.select(
        F.date_format("event_ts", "yyyy-MM").alias("month"),
        F.to_json(
            F.struct(
                F.col("event_id").alias("id"), "type",
                F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
                F.struct(F.col("repo_name").alias("name")).alias("repo"),
            )
        ).alias("value"),
    )
    lines.write.partitionBy("month").option("compression", "gzip").text(path)
    read = src.parse_event_lines(t.spark.read.text(path))
    day = F.concat(F.substring("created_at", 1, 10), F.lit("-0.json.gz"))
    return (
        src.in_file_dates(read, day, "1996-03-05", "1996-04-20")
        .groupBy("type")
        .agg(F.count("*").alias("events"), F.count_distinct("repo.name").alias("repos"))
    )


@check(
    "src3_month_pruned_scan",
    with_archive("""
SELECT ym, type, count(*) AS events, count(DISTINCT actor_login) AS actors FROM archive
WHERE ym BETWEEN '199612' AND '199707' AND type IN ('PushEvent', 'IssuesEvent') GROUP BY 1, 2
"""),
)
def _(t):
    """Archive landed by month, then scanned with partition pruning."""
    path = new_path(t.spark, "landed")
    src.land_events(t.archive, path)
    landed = t.spark.read.parquet(path).withColumn("ym", F.col("ym").cast("string"))
    picked = src.scan_months(
        landed, "199612", "199707", types=[S.PUSH, S.ISSUE], cols=["ym", "type", "actor_login"]
    )
    return picked.groupBy("ym", "type").agg(
        F.count("*").alias("events"), F.count_distinct("actor_login").alias("actors")
    )


@check("src5_snk1_csv_round_trip", "SELECT * FROM customer")
def _(t):
    path = new_path(t.spark, "csv")
    customer = t.table("customer")
    tab.write_table(customer, path, "csv")
    return tab.read_table_csv(t.spark, path, customer.schema)


@check("snk2_append_twice", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(t):
    path = new_path(t.spark, "append")
    rows = t.table("supplier").select("s_suppkey", "s_name")
    tab.append_table(rows, path)
    tab.append_table(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path)


@check("snk3_json_lines", "SELECT event_id, user_id, event_type, value, props FROM events")
def _(t):
    path = new_path(t.spark, "jsonl")
    rows = t.table("events").select("event_id", "user_id", "event_type", "value", "props")
    tab.write_jsonl(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


# ---------------------------------------------------------------------------
# Cohort records
# ---------------------------------------------------------------------------
def _fork_lines(t):
    """A fork event per customer; some keys are absent, some payloads are strings."""
    key = F.col("c_custkey")
    forkee = F.struct(
        F.concat(F.lit("c"), F.col("c_nationkey"), F.lit("/r"), key).alias("full_name"),
        F.concat(F.lit("r"), key).alias("name"),
        key.alias("id"),
        F.when(key % 11 == 0, "not a time").otherwise("2024-01-05T06:07:08Z").alias("created_at"),
        F.lit("main").alias("default_branch"),
        F.struct(
            F.concat(F.lit("c"), F.col("c_nationkey")).alias("login"),
            F.when(F.col("c_mktsegment") == "BUILDING", "Organization").otherwise("User").alias("type"),
        ).alias("owner"),
        F.when(key % 3 == 0, key % 17).alias("stargazers_count"),
        F.when(key % 4 == 0, F.lit(0)).otherwise(F.floor(F.abs("c_acctbal"))).alias("size"),
        F.when(key % 5 != 0, key % 2 == 0).alias("has_wiki"),
        F.when(key % 7 == 0, F.lit(True)).alias("archived"),
        F.when(key % 2 == 0, F.array(F.lit("a"), F.col("c_mktsegment"))).alias("topics"),
    )
    payload = F.struct(forkee.alias("forkee"))
    body = lambda p: F.to_json(
        F.struct(
            key.cast("string").alias("id"),
            F.lit(S.FORK).alias("type"),
            F.lit("2024-01-05T06:07:09Z").alias("created_at"),
            F.struct(
                (F.col("c_nationkey") + 1).alias("id"),
                F.concat(F.lit("up/"), F.col("c_nationkey")).alias("name"),
            ).alias("repo"),
            p.alias("payload"),
        )
    )
    return t.table("customer").select(
        F.when(key % 2 == 0, body(F.to_json(payload))).otherwise(body(payload)).alias("value")
    )


FORK_RECORDS_SQL = """
SELECT 'c' || c_nationkey || '/r' || c_custkey AS repo_name, c_custkey AS repo_id,
  CASE WHEN c_custkey % 11 <> 0 THEN '2024-01-05 06:07:08' END AS created_at, true AS is_fork, 'main' AS default_branch,
  'c' || c_nationkey AS fork_owner_login,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Organization' ELSE 'User' END AS fork_owner_type,
  'up/' || c_nationkey AS parent_repo_name, CAST(c_nationkey + 1 AS BIGINT) AS parent_repo_id, NULL AS parent_org,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 17 ELSE 0 END AS initial_stars,
  CAST(0 AS BIGINT) AS initial_forks, CAST(0 AS BIGINT) AS initial_open_issues,
  CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE floor(abs(c_acctbal)) END AS BIGINT) AS initial_size_kb,
  false AS has_issues_enabled, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 2 = 0 END, false) AS has_wiki,
  false AS has_discussions, c_custkey % 7 = 0 AS is_archived, false AS is_template, NULL AS initial_language,
  CASE WHEN c_custkey % 2 = 0 THEN 'a,' || c_mktsegment ELSE '' END AS initial_topics,
  CAST(c_custkey AS VARCHAR) AS event_id, '2024-01-05 06:07:09' AS event_created_at
FROM customer
"""


def _fork_records(t):
    good, _bad = src.split_corrupt(src.parse_event_lines(_fork_lines(t)))
    return co.fork_records(good)


@check("prj1_fork_records", FORK_RECORDS_SQL)
def _(t):
    return rounded(_fork_records(t))


@check(
    "flt2_flt3_intentional_forks",
    f"""
SELECT CASE WHEN initial_size_kb > 0 OR fork_owner_type = 'Organization' THEN 'kept' ELSE 'excluded' END AS outcome,
  repo_name FROM ({FORK_RECORDS_SQL}) WHERE repo_name IS NOT NULL AND NOT is_archived
""",
)
def _(t):
    usable = co.drop_unusable(_fork_records(t), "repo_name", "is_archived")
    kept, excluded = co.split_intentional(usable)
    return kept.select(F.lit("kept").alias("outcome"), "repo_name").unionByName(
        excluded.select(F.lit("excluded").alias("outcome"), "repo_name")
    )


@check(
    "flt3_split_by_balance",
    """SELECT c_acctbal > 0 OR c_mktsegment = 'BUILDING' AS kept, count(*) AS n FROM customer GROUP BY 1""",
)
def _(t):
    owners = t.table("customer").withColumn(
        "owner", F.when(F.col("c_mktsegment") == "BUILDING", "Organization").otherwise("User")
    )
    kept, excluded = co.split_intentional(owners, "c_acctbal", "owner")
    both = kept.withColumn("kept", F.lit(True)).unionByName(excluded.withColumn("kept", F.lit(False)))
    return both.groupBy("kept").agg(F.count("*").alias("n"))


def _creation_lines(t):
    """A creation event per order; an urgent order belongs to an organisation."""
    return t.table("orders").select(
        F.to_json(
            F.struct(
                F.col("o_orderkey").cast("string").alias("id"),
                F.lit("CreateEvent").alias("type"),
                F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
                F.struct(
                    F.col("o_custkey").alias("id"), F.concat(F.lit("c/"), F.col("o_custkey")).alias("name")
                ).alias("repo"),
                F.struct(F.col("o_orderpriority").alias("login")).alias("actor"),
                F.when(
                    F.col("o_orderpriority") == "1-URGENT",
                    F.struct(F.concat(F.lit("org"), F.col("o_orderstatus")).alias("login")),
                ).alias("org"),
                F.to_json(F.struct(F.lit("trunk").alias("master_branch"))).alias("payload"),
            )
        ).alias("value")
    )


CREATION_SQL = """
SELECT 'c/' || o_custkey AS repo_name, o_custkey AS repo_id, o_orderdate AS created_at, false AS is_fork,
  'trunk' AS default_branch, o_orderpriority AS fork_owner_login,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Organization' ELSE 'User' END AS fork_owner_type,
  NULL AS parent_repo_name, NULL AS parent_repo_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'org' || o_orderstatus END AS parent_org,
  CAST(o_orderkey AS VARCHAR) AS event_id, o_orderdate AS event_created_at
FROM orders
"""


def _creations(t):
    good, _bad = src.split_corrupt(src.parse_event_lines(_creation_lines(t)))
    return co.creation_records(good)


@check(
    "prj2_creation_records",
    f"""SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
        strftime(event_created_at, '%Y-%m-%d %H:%M:%S') AS event_created_at) FROM ({CREATION_SQL})""",
)
def _(t):
    return rounded(_creations(t))


@check(
    "flt4_ded1_monthly_cohort",
    f"""
SELECT repo_name, event_id, fork_owner_type, parent_org FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY event_created_at, event_id) AS i FROM ({CREATION_SQL})
  WHERE strftime(created_at, '%Y-%m') IN ('1996-12', '1997-01')) WHERE i = 1
""",
)
def _(t):
    rows = co.in_months(_creations(t), "created_at", ("1996-12", "1997-01"))
    return co.dedup_first(rows, "repo_name", ["event_created_at", "event_id"]).select(
        "repo_name", "event_id", "fork_owner_type", "parent_org"
    )


@check(
    "ded1_first_event_per_user",
    """SELECT user_id, event_id, event_type FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) WHERE i = 1""",
)
def _(t):
    return co.dedup_first(t.table("events"), "user_id", ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type"
    )


@check(
    "ded1_latest_record_per_repo",
    f"""SELECT repo_name, event_id, strftime(event_created_at, '%Y-%m-%d %H:%M:%S') AS event_created_at FROM (
         SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY event_created_at DESC, event_id DESC) AS i
         FROM ({CREATION_SQL})) WHERE i = 1""",
)
def _(t):
    return rounded(
        co.latest_per_repo(_creations(t)).select("repo_name", "event_id", "event_created_at")
    )


@check(
    "ded2_duplicate_rows",
    """SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS copies
       FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def _(t):
    rows = t.table("events").select(
        "user_id", "event_type", F.from_json("props", "map<string,long>").alias("k")
    )
    return co.duplicate_rows(rows).withColumn(
        "k", fn.json_scalar(F.col("k"), "$[0].value").cast("long")
    )


@check(
    "prj3_owner_and_name",
    """SELECT l_orderkey, l_linenumber, l_partkey,
         CASE WHEN l_linenumber <> 7 THEN 'n' || l_suppkey END AS owner,
         CASE WHEN l_linenumber <> 7 THEN 'r' || l_partkey END AS name
       FROM lineitem""",
)
def _(t):
    full = F.concat(
        F.lit("n"), F.col("l_suppkey"), F.lit("/r"), F.col("l_partkey"),
        F.when(F.col("l_linenumber") == 7, "/x").otherwise(""),
    )
    owner, name = fn.owner_and_name(full)
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", owner.alias("owner"), name.alias("name")
    )


# ---------------------------------------------------------------------------
# JSON feed and profiles
# ---------------------------------------------------------------------------
@check("fn1_json_scalar", with_feed("SELECT id, k FROM feed"))
def _(t):
    return t.feed.select("id", fn.json_scalar(F.col("payload"), "$.k").cast("long").alias("k"))


@check(
    "fn2_json_items",
    """SELECT o_custkey, count(*) AS items, count(DISTINCT l_partkey) AS parts
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t):
    lists = t.table("lineitem").groupBy("l_orderkey").agg(
        F.to_json(F.collect_list(F.struct(F.col("l_partkey").alias("part")))).alias("items")
    )
    item = T.StructType([T.StructField("part", T.LongType())])
    return (
        t.table("orders")
        .join(lists, F.col("o_orderkey") == F.col("l_orderkey"))
        .select("o_custkey", F.explode(fn.json_items(F.col("items"), item)).alias("item"))
        .groupBy("o_custkey")
        .agg(F.count("*").alias("items"), F.count_distinct("item.part").alias("parts"))
    )


@check(
    "fn5_month_arithmetic",
    """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 2 MONTH, '%Y-%m-%d %H:%M:%S') AS later,
         strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS month_start,
         strftime(o_orderdate, '%Y-%m') AS month FROM orders""",
)
def _(t):
    ts = F.col("o_orderdate").cast("timestamp")
    return rounded(
        t.table("orders").select(
            "o_orderkey",
            fn.plus_months(ts, 2).alias("later"),
            fn.month_start(ts).alias("month_start"),
            fn.month_of(ts).alias("month"),
        )
    )


@check(
    "flt1_feed_types",
    with_feed("SELECT repo_name, type, count(*) AS events FROM feed WHERE type IN ('WatchEvent', 'IssuesEvent') GROUP BY 1, 2"),
)
def _(t):
    return co.of_type(t.feed, S.WATCH, S.ISSUE).groupBy("repo_name", "type").agg(
        F.count("*").alias("events")
    )


@check(
    "agg1_feed_activity",
    """
SELECT 'e/' || user_id AS repo_name, count(*) FILTER (event_type = 'click') AS total_commits,
  count(*) FILTER (event_type = 'error' AND k < 50) AS issues_opened,
  count(*) FILTER (event_type = 'error' AND k >= 50) AS issues_closed,
  count(*) FILTER (event_type = 'purchase' AND k < 50) AS num_releases,
  count(*) FILTER (event_type = 'view' AND k < 50) AS star_count,
  count(*) FILTER (event_type = 'signup') AS fork_count
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, min(ts) OVER (PARTITION BY user_id) AS created_at FROM events)
WHERE ts BETWEEN created_at AND created_at + INTERVAL 7 DAY GROUP BY 1
""",
)
def _(t):
    """Activity over the JSON feed in a seven-day window."""
    from sproutscope.functions.anchored import first_days
    from sproutscope.operators.activity import activity_counts
    from sproutscope.operators.windows import events_in_window

    opened = fn.json_scalar(F.col("payload"), "$.k").cast("long") < 50
    action = (
        F.when(F.col("type") == S.ISSUE, F.when(opened, "opened").otherwise("closed"))
        .when((F.col("type") == S.RELEASE) & opened, "published")
        .when((F.col("type") == S.WATCH) & opened, "started")
    )
    events = t.feed.select(
        F.col("id").alias("event_id"), "type", "repo_name", "event_ts", action.alias("action"),
        F.lit("").alias("actor_login"), F.lit(None).cast("boolean").alias("merged"),
    )
    cohort = t.feed.groupBy("repo_name").agg(F.min("event_ts").alias("created_at"))
    counts = activity_counts(events_in_window(events, cohort, first_days(7)))
    return counts.select(
        "repo_name", "total_commits", "issues_opened", "issues_closed", "num_releases", "star_count", "fork_count"
    )


@check(
    "agg14_conditional_counts",
    """SELECT count(*) AS total, count(*) FILTER (c_mktsegment = 'BUILDING') AS org_forks,
              count(*) FILTER (c_mktsegment = 'MACHINERY') AS user_forks FROM customer""",
)
def _(t):
    return profiles.conditional_counts(
        t.table("customer"),
        org_forks=F.col("c_mktsegment") == "BUILDING",
        user_forks=F.col("c_mktsegment") == "MACHINERY",
    )


@check(
    "agg15_date_profile",
    with_commits("""
SELECT strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS latest,
  CAST(date_diff('month', min(created_at), max(created_at)) AS INTEGER) AS span_months FROM commit_cohort
"""),
)
def _(t):
    return rounded(profiles.date_profile(t.commit_cohort))


@check(
    "agg16_cohort_profile",
    f"""SELECT count(*) AS total, count(*) FILTER (month(created_at) = 12) AS created_in_month_12,
          count(*) FILTER (month(created_at) = 1) AS created_in_month_1,
          count(*) FILTER (fork_owner_type = 'User') AS user_owned,
          count(*) FILTER (fork_owner_type = 'Organization') AS org_owned FROM ({CREATION_SQL})""",
)
def _(t):
    return profiles.cohort_profile(_creations(t))


@check("win6_top_customers", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def _(t):
    return profiles.top_n(t.table("customer"), "c_acctbal", 15, "c_custkey").select("c_custkey", "c_acctbal")


@check("win7_ordered_repo_months", with_archive("SELECT * FROM cm ORDER BY repo_name, month"))
def _(t):
    from sproutscope.operators.contributors import contributor_months

    return profiles.ordered(contributor_months(t.archive, t.cohort), "repo_name", "month")


@check(
    "fn11_fn12_fn16_presence_and_order",
    """SELECT c_custkey, c_acctbal > 0 AS has_balance, 'x,' || c_mktsegment AS tags FROM customer""",
)
def _(t):
    rows = t.table("customer").select(
        fn.comma_list(F.array(F.lit("x"), F.col("c_mktsegment"))).alias("tags"),
        fn.is_present(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).alias("has_balance"),
        "c_custkey",
    )
    return fn.existing_columns(rows, ["c_custkey", "has_balance", "absent", "tags"])


# ---------------------------------------------------------------------------
# Governance out of landed responses
# ---------------------------------------------------------------------------
def _responses(t):
    """A response per supplier as JSON text; every ninth repository has none."""
    key = F.col("s_suppkey")
    named = lambda c: F.struct(c.alias("name"))
    language = F.when(key % 6 != 0, named(F.concat(F.lit("lang"), key % 4)))
    repository = F.struct(
        F.concat(F.lit("o/"), key).alias("nameWithOwner"),
        F.when(key % 2 == 0, F.struct(F.lit("x").alias("id"))).alias("contributing"),
        F.when(key % 3 == 0, F.struct(F.lit("x").alias("id"))).alias("codeOfConduct"),
        F.when(F.col("s_acctbal") > 4000, named(F.lit("MIT"))).alias("license"),
        F.when(key % 5 < 2, F.struct(F.lit("x").alias("id"))).alias("cicd"),
        language.alias("primaryLanguage"),
        F.struct(
            F.array(
                F.struct(named(F.lit("spark")).alias("topic")),
                F.struct(named(F.concat(F.lit("t"), key % 7)).alias("topic")),
            ).alias("nodes")
        ).alias("repositoryTopics"),
        F.when(
            key % 4 != 0,
            F.struct(
                F.concat(F.lit("o/"), F.col("s_nationkey")).alias("nameWithOwner"),
                (key * 3).alias("stargazerCount"),
                (key * 2).alias("forkCount"),
                F.lit("2020-02-03T04:05:06Z").alias("createdAt"),
                language.alias("primaryLanguage"),
            ),
        ).alias("parent"),
    )
    return t.table("supplier").select(
        F.concat(F.lit("o/"), key).alias("repo_name"),
        F.to_json(F.struct(F.when(key % 9 != 0, repository).alias("repository"))).alias("response"),
    )


GOVERNANCE_SQL = """SELECT 'o/' || s_suppkey AS repo_name, s_suppkey % 2 = 0 AS has_contributing, s_suppkey % 3 = 0 AS has_code_of_conduct,
         s_acctbal > 4000 AS has_license, s_suppkey % 5 < 2 AS has_cicd,
         CASE WHEN s_suppkey % 6 <> 0 THEN 'lang' || s_suppkey % 4 END AS primary_language,
         'spark,t' || s_suppkey % 7 AS topics
       FROM supplier WHERE s_suppkey % 9 <> 0"""


@check("gov1_governance", GOVERNANCE_SQL)
def _(t):
    return gov.governance(_responses(t))


@check("gov1_jon10_resumed_collection", GOVERNANCE_SQL)
def _(t):
    """Governance by three runs over responses that land bit by bit, of which the second finds nothing new."""
    folder, table = new_path(t.spark, "responses"), new_path(t.spark, "collected")
    responses = _responses(t)
    number = F.element_at(F.split("repo_name", "/"), 2).cast("long")
    land = lambda rows: rows.select("repo_name", "response").write.mode("append").json(folder)
    run = lambda: collection.collect(t.spark, collection.read_responses(t.spark, folder), responses, table)
    land(responses.where(number % 2 == 0))
    run()
    run()
    land(responses)  # the first half once more
    return collection.answered(run()).select(*gov.governance(responses).columns)


PARENT_SQL = """SELECT 'o/' || s_suppkey AS repo_name, CASE WHEN s_suppkey % 4 <> 0 THEN 'o/' || s_nationkey END AS parent_repo,
         CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 3 END AS parent_stars,
         CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 2 END AS parent_forks,
         CASE WHEN s_suppkey % 4 <> 0 THEN '2020-02-03 04:05:06' END AS parent_created_at,
         CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 6 <> 0 THEN 'lang' || s_suppkey % 4 END AS parent_language
       FROM supplier WHERE s_suppkey % 9 <> 0"""


@check("gov2_parent_metadata", PARENT_SQL)
def _(t):
    return rounded(gov.parent_meta(_responses(t)))


def _issue_responses(t):
    """Issue states per customer: counts, a deletion marker, an error word, or nothing."""
    key = F.col("c_custkey")
    return t.table("customer").select(
        F.concat(F.lit("c/"), key).alias("repo_name"),
        F.when(key % 5 == 0, F.to_json(F.struct(F.lit(True).alias("deleted_repo"))))
        .when(key % 5 == 1, F.lit('"errors"'))
        .when(
            key % 5 != 2,
            F.to_json(
                F.struct(
                    (key % 2 == 0).alias("issues_enabled"),
                    (key % 13).alias("open_issues_count"),
                    (key % 8).alias("closed_issues_count"),
                )
            ),
        )
        .alias("issues"),
        (key % 100).alias("stars"),
    )


ISSUE_STATE_SQL = """
SELECT 'c/' || c_custkey AS repo_name,
  CASE c_custkey % 5 WHEN 0 THEN 'deleted' WHEN 1 THEN 'error' WHEN 2 THEN NULL ELSE 'ok' END AS status,
  CASE WHEN c_custkey % 5 > 2 THEN c_custkey % 2 = 0 END AS issues_enabled,
  CASE WHEN c_custkey % 5 > 2 THEN c_custkey % 13 END AS open_issues_count,
  CASE WHEN c_custkey % 5 > 2 THEN c_custkey % 8 END AS closed_issues_count,
  c_custkey % 100 AS stars
FROM customer
"""


@check("gov4_issue_state", ISSUE_STATE_SQL)
def _(t):
    return gov.issue_state(_issue_responses(t))


def _dated_forks(t):
    """A fork event per customer, last updated at a fixed time."""
    return t.table("customer").select(
        F.struct(F.concat(F.lit("up/p"), F.col("c_nationkey")).alias("name")).alias("repo"),
        F.to_json(
            F.struct(
                F.struct(
                    F.concat(F.lit("c/"), F.col("c_custkey")).alias("full_name"),
                    F.lit("1997-06-15T00:00:00Z").alias("updated_at"),
                ).alias("forkee")
            )
        ).alias("payload"),
    )


ENRICHED_SQL = f"""
WITH since AS (
  SELECT 'c/' || o_custkey AS repo_name, o_orderdate AS ts FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-15 00:00:00'
), firsts AS (SELECT repo_name, min(ts) AS first_ts FROM since GROUP BY 1)
SELECT f.repo_name, 'up' AS parent_owner, 'p' || c_nationkey AS parent_name, 'c' AS child_owner,
  CAST(c_custkey AS VARCHAR) AS child_name, '1997-06-15T00:00:00Z' AS fork_time,
  coalesce(m.months, 0) AS months, coalesce(m.commits, 0) AS commits, coalesce(p.commits_post, 0) AS commits_post,
  status, open_issues_count, stars
FROM (SELECT 'c/' || c_custkey AS repo_name, * FROM customer) f
LEFT JOIN (SELECT repo_name, count(DISTINCT strftime(ts, '%Y-%m')) AS months, count(*) AS commits FROM since GROUP BY 1) m USING (repo_name)
LEFT JOIN (SELECT repo_name, count(*) AS commits_post FROM since JOIN firsts USING (repo_name)
           WHERE ts >= first_ts + INTERVAL 2 MONTH GROUP BY 1) p USING (repo_name)
LEFT JOIN ({ISSUE_STATE_SQL}) i USING (repo_name)
"""


def _enriched(forks, t):
    rows = gov.enriched_forks(forks, t.commits, _issue_responses(t))
    return rows.select(
        "repo_name", "parent_owner", "parent_name", "child_owner", "child_name", "fork_time",
        F.coalesce(F.size("commit_times"), F.lit(0)).cast("long").alias("months"),
        F.coalesce(F.aggregate(F.map_values("commit_times"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("commits"),
        "commits_post", "status", "open_issues_count", "stars",
    )


@check("gov5_enriched_forks", ENRICHED_SQL)
def _(t):
    return _enriched(_dated_forks(t), t)


@check("gov5_repeated_events", ENRICHED_SQL)
def _(t):
    """Every fork event twice: the counts are those of one."""
    forks = _dated_forks(t)
    return _enriched(forks.unionAll(forks), t).distinct()


@check(
    "flt12_agg11_eda_table",
    f"""
WITH monthly AS (
  SELECT 'c/' || o_custkey AS repo, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS commits FROM orders
  WHERE o_orderdate >= TIMESTAMP '1997-06-15 00:00:00' GROUP BY 1, 2
), halves AS (
  SELECT repo, CAST(sum(CASE WHEN i <= 3 THEN commits ELSE 0 END) AS BIGINT) AS early_commits,
    CAST(sum(CASE WHEN i > 3 THEN commits ELSE 0 END) AS BIGINT) AS sustained_commits
  FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY month) AS i FROM monthly) GROUP BY 1
)
SELECT repo, early_commits, sustained_commits, stars,
  coalesce(open_issues_count, 0) + coalesce(closed_issues_count, 0) AS total_issues,
  round(CASE WHEN coalesce(open_issues_count, 0) + coalesce(closed_issues_count, 0) > 0
    THEN closed_issues_count / (open_issues_count + closed_issues_count)::DOUBLE ELSE 0 END, 6) AS issue_closure_rate,
  CASE WHEN sustained_commits >= 2 THEN 1 ELSE 0 END AS healthy
FROM halves JOIN ({ISSUE_STATE_SQL}) i ON i.repo_name = repo WHERE early_commits + sustained_commits >= 15
""",
)
def _(t):
    from sproutscope.plans.series_track import eda_table

    return rounded(eda_table(_dated_forks(t), t.commits, _issue_responses(t)))
