"""Contributor health: concentration, retention and the first outside contribution.

No window ever holds all contributors of one repository. Concentration works on the
histogram of row sizes, which has at most about ``sqrt(2 * commits)`` rows, and the monthly
metrics on (first month, month) pairs, which are bounded by the square of the months.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sproutscope import schemas as S
from sproutscope.functions.anchored import EARLY, AnchoredWindow
from sproutscope.functions.scalars import month_of
from sproutscope.operators.windows import events_in_window


def contributor_month_counts(windowed: DataFrame) -> DataFrame:
    pushes = windowed.where(F.col("type") == S.PUSH)
    return pushes.groupBy(
        "repo_name", month_of(F.col("event_ts")).alias("month"), F.col("actor_login").alias("contributor")
    ).agg(F.count("*").alias("commit_count"))


def contributor_months(
    events: DataFrame, cohort: DataFrame, within: AnchoredWindow = EARLY
) -> DataFrame:
    """Pushes by repository, month and contributor."""
    pushes = events.where(F.col("type") == S.PUSH)
    return contributor_month_counts(events_in_window(pushes, cohort, within))


def _histogram(cm: DataFrame, grain: str) -> DataFrame:
    """Rows per distinct size: ``(repo_name, size, rows)``."""
    if grain == "contributor":
        cm = cm.groupBy("repo_name", "contributor").agg(F.sum("commit_count").alias("commit_count"))
    elif grain != "contributor_month":
        raise ValueError(f"unknown grain: {grain}")
    return cm.groupBy("repo_name", F.col("commit_count").alias("size")).agg(
        F.count("*").alias("rows")
    )


def concentration(
    cm: DataFrame, share: float = S.BUS_FACTOR_SHARE, grain: str = "contributor_month"
) -> DataFrame:
    """Bus factor and Gini coefficient from one histogram per repository."""
    repo = Window.partitionBy("repo_name")
    descending = repo.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ascending = repo.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    mass = F.col("size") * F.col("rows")
    ranked = _histogram(cm, grain).select(
        "repo_name",
        "size",
        "rows",
        F.sum(mass).over(repo).alias("total"),
        F.coalesce(F.sum(mass).over(descending), F.lit(0)).alias("mass_above"),
        F.coalesce(F.sum("rows").over(ascending), F.lit(0)).alias("rows_below"),
    )
    # largest whole running sum that is still short of the share
    short_of_share = F.ceil(F.col("total") * F.lit(float(share))) - 1
    still_short = F.greatest(
        F.lit(0), F.least(F.col("rows"), F.expr("_room div size"))
    )
    rank_sum = F.col("size") * (
        F.col("rows") * F.col("rows_below") + F.expr("rows * (rows + 1) div 2")
    )
    folded = (
        ranked.withColumn("_room", short_of_share - F.col("mass_above"))
        .groupBy("repo_name")
        .agg(
            F.sum(still_short).alias("short_rows"),
            F.sum(rank_sum).alias("rank_mass"),
            F.sum("rows").alias("n"),
            F.max("total").alias("total"),
        )
    )
    n, total = F.col("n"), F.col("total")
    return folded.select(
        "repo_name",
        F.when(total == 0, F.lit(0)).otherwise(F.col("short_rows") + 1).cast("long").alias("bus_factor"),
        F.when(
            (n >= 2) & (total > 0), 2 * F.col("rank_mass") / (n * total) - (n + 1) / n
        ).alias("contributor_gini"),
    )


def bus_factor(
    cm: DataFrame, share: float = S.BUS_FACTOR_SHARE, grain: str = "contributor_month"
) -> DataFrame:
    """Fewest rows, largest first, that reach ``share`` of the commits."""
    return concentration(cm, share, grain).select("repo_name", "bus_factor")


def gini(cm: DataFrame, grain: str = "contributor_month") -> DataFrame:
    """Inequality of the row sizes; null below two rows."""
    return concentration(cm, grain=grain).select("repo_name", "contributor_gini")


def cohort_matrix(cm: DataFrame) -> DataFrame:
    """Contributors by the month they first appeared in and the months they were active in.

    ``(repo_name, first_month, month, contributors, active_month)`` with ``active_month``
    the 1-based index of ``month`` among the repository's active months.
    """
    career = Window.partitionBy("repo_name", "contributor")
    counts = (
        cm.select("repo_name", "contributor", "month")
        .withColumn("first_month", F.min("month").over(career))
        .groupBy("repo_name", "first_month", "month")
        .agg(F.count("*").alias("contributors"))
    )
    by_month = Window.partitionBy("repo_name").orderBy("month")
    return counts.withColumn("active_month", F.dense_rank().over(by_month).cast("long"))


def retention_of(matrix: DataFrame, ks=S.RETENTION_MONTHS) -> DataFrame:
    repo = Window.partitionBy("repo_name")
    founding = F.col("first_month") == F.col("opening_month")
    marked = matrix.withColumn("opening_month", F.min("month").over(repo))
    kept = lambda k: F.sum(
        F.when(founding & (F.col("active_month") == k), F.col("contributors")).otherwise(0)
    )
    return marked.groupBy("repo_name").agg(
        *[
            F.when(F.max("active_month") >= k, kept(k) / kept(1)).alias(f"retention_m{k}")
            for k in ks
        ]
    )


def retention(cm: DataFrame, ks=S.RETENTION_MONTHS) -> DataFrame:
    """Share of first-month contributors active again in the k-th active month."""
    return retention_of(cohort_matrix(cm), ks)


def first_external_of(matrix: DataFrame) -> DataFrame:
    arrivals = matrix.groupBy("repo_name", "active_month").agg(
        F.sum(F.when(F.col("first_month") == F.col("month"), F.col("contributors")).otherwise(0)).alias("arrived")
    )
    so_far = Window.partitionBy("repo_name").orderBy("active_month")
    known = arrivals.withColumn("known", F.sum("arrived").over(so_far))
    return known.groupBy("repo_name").agg(
        F.min(F.when(F.col("known") >= 2, F.col("active_month") - 1)).alias(
            "months_to_first_external_contrib"
        )
    )


def first_external(cm: DataFrame) -> DataFrame:
    """0-based index, among active months, of the first with someone besides the founder.

    The founder belongs to the first month, so this is the first month by which two
    different contributors have appeared; who came first does not matter.
    """
    return first_external_of(cohort_matrix(cm))


def contributor_health(cm: DataFrame) -> DataFrame:
    """All contributor metrics, one row per repository with commits."""
    matrix = cohort_matrix(cm)
    return (
        concentration(cm)
        .join(retention_of(matrix), "repo_name")
        .join(first_external_of(matrix), "repo_name")
    )
