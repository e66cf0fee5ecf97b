"""Views of the driver tables in the library's schemas, in Spark and in SQL.

Archive: lineitem joined to its order and customer becomes an event of a supplier's
repository by a customer's nation; flags and line number choose the event type. Orders
alone are commits of a customer's repository. The ``events`` table is a feed with JSON
payloads.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.session import new_path, stage

#: Lines of one gzipped file, which a single task reads.
FILE_LINES = 500_000


class Tables:
    """Lazy access to the parquet tables of one scale and to the views built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def archive(self) -> DataFrame:
        """Flat events out of lineitem, orders and customer."""
        flag = F.concat("l_returnflag", "l_linestatus")
        odd = F.col("l_linenumber") % 2 == 1
        line = F.col("l_linenumber")
        kind = (
            F.when(flag == "NO", S.PUSH)
            .when(flag == "AO", F.when(odd, S.ISSUE).otherwise(S.ISSUE_COMMENT))
            .when(
                flag == "NF",
                F.when(line <= 3, S.ISSUE)
                .when(line == 4, S.RELEASE)
                .when(line == 5, S.WATCH)
                .otherwise(S.FORK),
            )
            .when(flag == "RO", F.when(odd, S.PULL_REQUEST).otherwise(S.REVIEW_COMMENT))
            .otherwise(S.PULL_REQUEST)
        )
        action = (
            F.when(flag.isin("AO", "RO"), F.when(odd, "opened").otherwise("created"))
            .when(
                flag == "NF",
                F.when(line <= 3, "closed").when(line == 4, "published").when(line == 5, "started"),
            )
            .when(flag.isin("RF", "AF"), "closed")
        )
        merged = F.when(flag == "RF", F.when(line < 7, True)).when(flag == "AF", F.lit(False))
        # the joins move narrow rows, the largest table once; kinds are named afterwards
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus"
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        ordered = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
        joined = lines.join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
        ts = F.col("l_shipdate").cast("timestamp")
        return joined.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("event_id"),
            kind.alias("type"),
            F.concat(F.lit("o/"), F.col("l_suppkey")).alias("repo_name"),
            F.concat(F.lit("u"), F.col("c_nationkey")).alias("actor_login"),
            ts.alias("event_ts"),
            F.date_format(ts, "yyyyMM").alias("ym"),
            action.alias("action"),
            F.col("l_orderkey").cast("string").alias("number"),
            F.col("o_orderdate").cast("timestamp").alias("opened_at"),
            merged.alias("merged"),
        )

    @cached_property
    def cohort(self) -> DataFrame:
        """One repository per supplier, created at its first shipment; a stored table."""
        created = (
            self.table("lineitem")
            .groupBy("l_suppkey")
            .agg(F.min("l_shipdate").cast("timestamp").alias("created_at"))
        )
        owner = F.when(F.col("s_acctbal") > 5000, "Organization").otherwise("User")
        parent = F.when(
            F.col("s_suppkey") % 5 != 0, F.concat(F.lit("o/"), F.col("s_nationkey"))
        )
        repositories = created.join(
            self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")
        ).select(
            F.concat(F.lit("o/"), F.col("s_suppkey")).alias("repo_name"),
            "created_at",
            (F.col("s_suppkey") % 2 == 0).alias("is_fork"),
            owner.alias("fork_owner_type"),
            parent.alias("parent_repo"),
        )
        return stage(repositories, "cohort")

    @cached_property
    def commits(self) -> DataFrame:
        """Orders as pushes to a repository per customer."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("event_id"),
            F.lit(S.PUSH).alias("type"),
            F.concat(F.lit("c/"), F.col("o_custkey")).alias("repo_name"),
            F.col("o_orderpriority").alias("actor_login"),
            F.col("o_orderdate").cast("timestamp").alias("event_ts"),
            F.col("o_totalprice").alias("price"),
        )

    @cached_property
    def commit_cohort(self) -> DataFrame:
        return stage(
            self.commits.groupBy("repo_name").agg(F.min("event_ts").alias("created_at")), "cohort"
        )

    @cached_property
    def feed(self) -> DataFrame:
        """The ``events`` table in the raw envelope, payload as JSON text."""
        kinds = {
            "click": S.PUSH, "error": S.ISSUE, "view": S.WATCH,
            "purchase": S.RELEASE, "signup": S.FORK,
        }
        kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
        return self.table("events").select(
            F.col("event_id").cast("string").alias("id"),
            kind.alias("type"),
            F.concat(F.lit("e/"), F.col("user_id")).alias("repo_name"),
            F.col("ts").cast("timestamp").alias("event_ts"),
            "value",
            F.col("props").alias("payload"),
        )

    @cached_property
    def archive_lines(self) -> DataFrame:
        """The archive as NDJSON text: payloads as objects and as strings, in turn, plus one
        cut-off line for every pending order."""
        about_issue = F.col("type").isin(S.ISSUE, S.ISSUE_COMMENT)
        about_request = F.col("type").isin(S.PULL_REQUEST, S.REVIEW_COMMENT)
        subject = lambda *extra: F.struct(
            F.col("number").cast("long").alias("number"),
            F.date_format("opened_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
            *extra,
        )
        payload = F.struct(
            "action",
            F.when(about_issue, subject()).alias("issue"),
            F.when(about_request, subject(F.col("merged"))).alias("pull_request"),
        )
        envelope = lambda body: F.to_json(
            F.struct(
                F.col("event_id").alias("id"),
                "type",
                F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
                F.struct(F.col("repo_name").alias("name")).alias("repo"),
                F.struct(F.col("actor_login").alias("login")).alias("actor"),
                body.alias("payload"),
            )
        )
        as_text = F.col("number").cast("long") % 2 == 0
        good = self.archive.select(
            F.when(as_text, envelope(F.to_json(payload))).otherwise(envelope(payload)).alias("value")
        )
        cut = self.table("orders").where(F.col("o_orderstatus") == "P").select(
            F.concat(F.lit('{"id": "'), F.col("o_orderkey"), F.lit('", "type": ')).alias("value")
        )
        return good.unionByName(cut)

    def archive_files(self, label: str, files: int = 1) -> str:
        """The archive text in a new folder, gzipped as archives are: ``files`` files or more, none of them long.

        Lines are written where the join left them, so the text is neither shuffled nor sorted.
        """
        path = new_path(self.spark, label)
        lines = self.table("lineitem").count()
        most = max(1, min(FILE_LINES, -(-lines // files)))
        writer = self.archive_lines.write.option("compression", "gzip")
        writer.option("maxRecordsPerFile", most).text(path)
        return path

    @cached_property
    def push_lines(self) -> DataFrame:
        """One push per order, its lines as the commits inside the payload."""
        commits = self.table("lineitem").groupBy("l_orderkey").agg(
            F.collect_list(
                F.struct(
                    F.struct(F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("email")).alias("author")
                )
            ).alias("commits")
        )
        orders = self.table("orders").join(commits, F.col("o_orderkey") == F.col("l_orderkey"))
        return orders.select(
            F.to_json(
                F.struct(
                    F.col("o_orderkey").cast("string").alias("id"),
                    F.lit(S.PUSH).alias("type"),
                    F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
                    F.struct(F.concat(F.lit("c/"), F.col("o_custkey")).alias("name")).alias("repo"),
                    F.struct(F.col("o_orderpriority").alias("login")).alias("actor"),
                    F.struct("commits").alias("payload"),
                )
            ).alias("value")
        )

    @cached_property
    def study(self) -> DataFrame:
        """Early order features of every customer with the label (adapter for the statistics)."""
        from sproutscope.operators.labels import labels
        from sproutscope.operators.windows import events_in_window

        cohort = self.commit_cohort
        early = events_in_window(self.commits, cohort)
        features = early.groupBy("repo_name").agg(
            F.count("*").alias("total_commits"),
            F.count_distinct("actor_login").alias("unique_commit_authors"),
            F.round(F.sum("price"), 2).alias("spend"),
            F.count_if(F.col("actor_login") == "1-URGENT").alias("urgent"),
            F.max(F.unix_seconds("event_ts") - F.unix_seconds("created_at")).alias("active_seconds"),
        )
        customers = self.table("customer").select(
            F.concat(F.lit("c/"), F.col("c_custkey")).alias("repo_name"),
            F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation"),
        )
        ratio = F.when(F.col("total_commits") > 1, F.col("urgent") / F.col("total_commits"))
        wide = (
            features.join(labels(self.commits, cohort), "repo_name")
            .join(customers, "repo_name")
            .withColumn("divergence_ratio", ratio)
        )
        return stage(wide, "study")


# ---------------------------------------------------------------------------
# The same views as SQL, prefixed to the oracle queries.
# ---------------------------------------------------------------------------
ARCHIVE_SQL = """
archive AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS event_id,
    CASE l_returnflag || l_linestatus
      WHEN 'NO' THEN 'PushEvent'
      WHEN 'AO' THEN CASE WHEN l_linenumber % 2 = 1 THEN 'IssuesEvent' ELSE 'IssueCommentEvent' END
      WHEN 'NF' THEN CASE WHEN l_linenumber <= 3 THEN 'IssuesEvent' WHEN l_linenumber = 4 THEN 'ReleaseEvent'
                          WHEN l_linenumber = 5 THEN 'WatchEvent' ELSE 'ForkEvent' END
      WHEN 'RO' THEN CASE WHEN l_linenumber % 2 = 1 THEN 'PullRequestEvent' ELSE 'PullRequestReviewCommentEvent' END
      ELSE 'PullRequestEvent' END AS type,
    CASE WHEN l_returnflag || l_linestatus IN ('AO', 'RO')
           THEN CASE WHEN l_linenumber % 2 = 1 THEN 'opened' ELSE 'created' END
         WHEN l_returnflag || l_linestatus = 'NF'
           THEN CASE WHEN l_linenumber <= 3 THEN 'closed' WHEN l_linenumber = 4 THEN 'published'
                     WHEN l_linenumber = 5 THEN 'started' END
         WHEN l_returnflag || l_linestatus IN ('RF', 'AF') THEN 'closed' END AS action,
    CASE WHEN l_returnflag || l_linestatus = 'RF' AND l_linenumber < 7 THEN true
         WHEN l_returnflag || l_linestatus = 'AF' THEN false END AS merged,
    'o/' || l_suppkey AS repo_name, 'u' || c_nationkey AS actor_login,
    l_shipdate AS event_ts, strftime(l_shipdate, '%Y%m') AS ym,
    CAST(l_orderkey AS VARCHAR) AS number, o_orderdate AS opened_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
cohort AS (
  SELECT 'o/' || s_suppkey AS repo_name, created_at, s_suppkey % 2 = 0 AS is_fork,
    CASE WHEN s_acctbal > 5000 THEN 'Organization' ELSE 'User' END AS fork_owner_type,
    CASE WHEN s_suppkey % 5 <> 0 THEN 'o/' || s_nationkey END AS parent_repo
  FROM supplier JOIN (SELECT l_suppkey, min(l_shipdate) AS created_at FROM lineitem GROUP BY 1)
    ON l_suppkey = s_suppkey
),
early AS (
  SELECT a.*, c.created_at FROM archive a JOIN cohort c USING (repo_name)
  WHERE a.event_ts BETWEEN c.created_at AND c.created_at + INTERVAL 182 DAY
),
cm AS (
  SELECT repo_name, strftime(event_ts, '%Y-%m') AS month, actor_login AS contributor, count(*) AS commit_count
  FROM early WHERE type = 'PushEvent' GROUP BY 1, 2, 3
)"""

COMMITS_SQL = """
commits AS (
  SELECT o_orderkey AS event_id, 'c/' || o_custkey AS repo_name, o_orderpriority AS actor_login,
    o_orderdate AS event_ts, o_totalprice AS price FROM orders
),
commit_cohort AS (SELECT repo_name, min(event_ts) AS created_at FROM commits GROUP BY 1),
labelled AS (
  SELECT repo_name, CAST(max(CASE WHEN date_sub('day', created_at, event_ts) BETWEEN 548 AND 730 THEN 1 ELSE 0 END) AS INTEGER)
    AS is_sustainable
  FROM commits JOIN commit_cohort USING (repo_name) GROUP BY 1
)"""

STUDY_SQL = COMMITS_SQL + """,
study AS (
  SELECT f.*, l.is_sustainable, c_acctbal AS balance, c_mktsegment AS segment, c_nationkey AS nation,
    CASE WHEN total_commits > 1 THEN urgent / CAST(total_commits AS DOUBLE) END AS divergence_ratio
  FROM (
    SELECT repo_name, count(*) AS total_commits, count(DISTINCT actor_login) AS unique_commit_authors,
      round(sum(price), 2) AS spend, count(*) FILTER (actor_login = '1-URGENT') AS urgent,
      max(date_sub('second', created_at, event_ts)) AS active_seconds
    FROM commits JOIN commit_cohort USING (repo_name)
    WHERE event_ts BETWEEN created_at AND created_at + INTERVAL 182 DAY GROUP BY 1
  ) f JOIN labelled l USING (repo_name) JOIN customer ON repo_name = 'c/' || c_custkey
)"""

FEED_SQL = """
feed AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
    CASE event_type WHEN 'click' THEN 'PushEvent' WHEN 'error' THEN 'IssuesEvent' WHEN 'view' THEN 'WatchEvent'
      WHEN 'purchase' THEN 'ReleaseEvent' WHEN 'signup' THEN 'ForkEvent' END AS type,
    'e/' || user_id AS repo_name, ts AS event_ts, value, props AS payload,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events
)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, timestamps as text: the form compared with the SQL results."""
    shown = {
        "double": lambda c: F.round(c, digits),
        "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
    }
    return df.select(
        *[
            shown.get(f.dataType.typeName(), lambda c: c)(F.col(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def with_archive(sql: str) -> str:
    return f"WITH {ARCHIVE_SQL}\n{sql}"


def with_commits(sql: str) -> str:
    return f"WITH {COMMITS_SQL}\n{sql}"


def with_study(sql: str) -> str:
    return f"WITH {STUDY_SQL}\n{sql}"


def with_feed(sql: str) -> str:
    return f"WITH {FEED_SQL}\n{sql}"
