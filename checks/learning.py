"""Feature preparation, evaluation, training and explanation over the driver tables."""

from pyspark.sql import functions as F

from checks.adapters import rounded, with_study
from checks.registry import check
from sproutscope.functions.scalars import feature_of_condition, indicator
from sproutscope.operators import evaluation as ev
from sproutscope.operators import explain as ex
from sproutscope.operators import prep
from sproutscope.operators import training as tr
from sproutscope.operators.smote import smote
from sproutscope.plans import analysis

FEATURES = ["total_commits", "unique_commit_authors", "spend", "urgent", "active_seconds", "balance", "nation"]


# ---------------------------------------------------------------------------
# Preparation
# ---------------------------------------------------------------------------
@check("pre1_feature_frame_nonfork", with_study("SELECT total_commits, spend, segment FROM study"))
def _(t):
    rows = t.study.select(
        "repo_name", F.lit("x").alias("topics"), "total_commits", "spend", "segment", "divergence_ratio",
        "is_sustainable",
    )
    return prep.feature_frame(rows, "nonfork")


@check(
    "pre2_domain_imputation",
    with_study("""
SELECT repo_name, round(coalesce(delay, 2 * (SELECT median(delay) FROM d)), 6) AS avg_issue_first_response_hrs,
  round(coalesce(divergence_ratio, 0), 6) AS divergence_ratio, in_credit
FROM d
""").replace("\nSELECT repo_name, round(coalesce(delay", """,
d AS (SELECT repo_name, divergence_ratio, CASE WHEN balance > 0 THEN 1 ELSE 0 END AS in_credit,
        CASE WHEN active_seconds > 0 THEN active_seconds / 3600.0 END AS delay FROM study)
SELECT repo_name, round(coalesce(delay""", 1),
)
def _(t):
    rows = t.study.select(
        "repo_name",
        F.when(F.col("active_seconds") > 0, F.col("active_seconds") / 3600.0).alias("avg_issue_first_response_hrs"),
        "divergence_ratio",
        (F.col("balance") > 0).alias("in_credit"),
    )
    return rounded(prep.impute_domain(rows))


@check(
    "pre2_null_flags",
    """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal > 0 THEN 0 ELSE 2 END AS rich,
         CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END AS known, CASE WHEN c_nationkey > 5 THEN 1 ELSE 0 END AS far FROM customer""",
)
def _(t):
    """Flags with nulls take a code of their own, after those that occur."""
    balance = F.col("c_acctbal")
    rich = F.when(balance > 5000, F.lit(True)).when(balance > 0, F.lit(False))
    known = F.when(balance > 0, F.lit(True))
    return prep.impute_domain(t.table("customer").select("c_custkey", rich.alias("rich"), known.alias("known"), (F.col("c_nationkey") > 5).alias("far")))


@check(
    "pre1_feature_frame_fork",
    with_study("SELECT total_commits, spend, segment, round(divergence_ratio, 6) AS divergence_ratio FROM study"),
)
def _(t):
    rows = t.study.select(
        "repo_name", F.lit("x").alias("topics"), "total_commits", "spend", "segment", "divergence_ratio",
        "is_sustainable",
    )
    return rounded(prep.feature_frame(rows, "fork"))


@check(
    "pre3_generic_imputation",
    with_study("""
SELECT repo_name, round(coalesce(divergence_ratio, (SELECT median(divergence_ratio) FROM study)), 6) AS divergence_ratio,
  coalesce(CASE WHEN nation % 2 = 0 THEN segment END, (SELECT segment FROM study WHERE nation % 2 = 0 GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)) AS segment,
  coalesce(CASE WHEN nation % 3 > 0 THEN balance > 0 END, (SELECT balance > 0 FROM study WHERE nation % 3 > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS in_credit
FROM study
"""),
)
def _(t):
    rows = t.study.select(
        "repo_name",
        "divergence_ratio",
        F.when(F.col("nation") % 2 == 0, F.col("segment")).alias("segment"),
        F.when(F.col("nation") % 3 > 0, F.col("balance") > 0).alias("in_credit"),
    )
    return rounded(prep.impute_generic(rows, skip=("repo_name",)))


@check(
    "pre4_label_encode",
    """SELECT doc_id, CAST(dense_rank() OVER (ORDER BY coalesce(lang, 'nan')) - 1 AS INTEGER) AS lang,
         CAST(dense_rank() OVER (ORDER BY CASE WHEN n_chars % 3 = 0 THEN 'nan' ELSE source END) - 1 AS INTEGER) AS source
       FROM documents""",
)
def _(t):
    rows = t.table("documents").select(
        "doc_id", "lang", F.when(F.col("n_chars") % 3 != 0, F.col("source")).alias("source")
    )
    return prep.label_encode(rows, ["lang", "source"])


@check(
    "pre5_one_hot",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS "c_mktsegment_BUILDING",
         CASE c_mktsegment WHEN 'FURNITURE' THEN 1 ELSE 0 END AS "c_mktsegment_FURNITURE",
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 1 ELSE 0 END AS "c_mktsegment_HOUSEHOLD",
         CASE c_mktsegment WHEN 'MACHINERY' THEN 1 ELSE 0 END AS "c_mktsegment_MACHINERY",
         CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS in_credit_true
       FROM customer""",
)
def _(t):
    rows = t.table("customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") > 0).alias("in_credit"))
    return prep.one_hot(rows, ["c_mktsegment", "in_credit"])


@check(
    "pre6_top_categories",
    """SELECT "column", category, count FROM (
         SELECT 'lang' AS "column", lang AS category, count(*) AS count FROM documents WHERE lang <> (SELECT min(lang) FROM documents) GROUP BY 2
         UNION ALL
         SELECT 'source', source, count(*) FROM documents WHERE source <> (SELECT min(source) FROM documents) GROUP BY 2)
       ORDER BY count DESC, "column", category LIMIT 10""",
)
def _(t):
    return prep.top_categories(t.table("documents"), ["lang", "source"])


# ---------------------------------------------------------------------------
# Evaluation: a raw feature as the score
# ---------------------------------------------------------------------------
def _scored(t):
    return t.study.select(
        F.col("is_sustainable").alias("label"),
        F.col("spend").alias("score"),
        indicator(F.col("total_commits") > 1).alias("prediction"),
        (F.col("nation") % 5).alias("fold"),
    )


AUC_SQL = """,
ranked AS (SELECT nation % 5 AS fold, is_sustainable AS label,
  rank() OVER (PARTITION BY {by} ORDER BY spend) + (count(*) OVER (PARTITION BY {by}, spend) - 1) / 2.0 AS midrank FROM study),
aucs AS (SELECT {key} count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n2,
  (sum(midrank) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
  / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM ranked {group})
"""


@check(
    "ml5_auc",
    with_study("").rstrip() + AUC_SQL.format(by="1", key="", group="") + "SELECT n1, n2, round(auc, 6) AS auc FROM aucs",
)
def _(t):
    return rounded(ev.auc(_scored(t)))


@check(
    "ml5_fold_auc_spread",
    with_study("").rstrip()
    + AUC_SQL.format(by="nation % 5", key="fold,", group="GROUP BY fold")
    + "SELECT round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc FROM aucs",
)
def _(t):
    return rounded(ev.auc_spread(ev.fold_auc(_scored(t))))


@check(
    "ml6_class_report",
    with_study("").rstrip() + """,
c AS (SELECT CAST(count(*) FILTER (p AND l) AS DOUBLE) AS tp, CAST(count(*) FILTER (p AND NOT l) AS DOUBLE) AS fp,
        CAST(count(*) FILTER (NOT p AND l) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT p AND NOT l) AS DOUBLE) AS tn
      FROM (SELECT total_commits > 1 AS p, is_sustainable = 1 AS l FROM study)),
q AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1,
        tn + fp AS n0, tp + fn AS n1, (tp + tn) / (tp + fp + fn + tn) AS acc FROM c),
f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM q)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(n AS BIGINT) AS support FROM (
  SELECT '0' AS class, p0 AS p, r0 AS r, f0 AS f, n0 AS n FROM f
  UNION ALL SELECT '1', p1, r1, f1, n1 FROM f
  UNION ALL SELECT 'accuracy', acc, acc, acc, n0 + n1 FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1 FROM f
  UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / (n0 + n1), (r0 * n0 + r1 * n1) / (n0 + n1), (f0 * n0 + f1 * n1) / (n0 + n1), n0 + n1 FROM f)
""",
)
def _(t):
    return rounded(ev.class_report(_scored(t)))


PR_SQL = """,
v AS (SELECT spend, count(*) FILTER (is_sustainable = 1) AS pos, count(*) AS n FROM study GROUP BY 1),
w AS (SELECT spend, CAST(sum(pos) OVER (ORDER BY spend DESC) AS DOUBLE) AS tp, CAST(sum(n) OVER (ORDER BY spend DESC) AS DOUBLE) AS hits,
        CAST(sum(pos) OVER () AS DOUBLE) AS actual FROM v),
pr AS (SELECT spend AS threshold, tp / hits AS precision, tp / actual AS recall,
        CASE WHEN tp > 0 THEN 2 * (tp / hits) * (tp / actual) / (tp / hits + tp / actual) ELSE 0 END AS f1 FROM w)
"""


@check(
    "ml7_pr_curve",
    with_study("").rstrip() + PR_SQL
    + "SELECT threshold, precision, recall, f1 FROM pr",
)
def _(t):
    return ev.pr_curve(_scored(t))


@check(
    "ml7_best_f1_threshold",
    with_study("").rstrip() + PR_SQL
    + """SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
         FROM pr ORDER BY pr.f1 DESC, pr.threshold LIMIT 1""",
)
def _(t):
    return rounded(ev.best_f1_threshold(_scored(t)))


@check(
    "ml8_threshold_table",
    with_study("""
SELECT k, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall
FROM (SELECT k, CAST(count(*) FILTER (divergence_ratio >= k AND is_sustainable = 1) AS DOUBLE) AS tp,
        CAST(count(*) FILTER (divergence_ratio >= k AND is_sustainable = 0) AS DOUBLE) AS fp,
        CAST(count(*) FILTER (divergence_ratio < k AND is_sustainable = 1) AS DOUBLE) AS fn
      FROM study, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) x(k) WHERE divergence_ratio IS NOT NULL GROUP BY 1)
"""),
)
def _(t):
    rows = t.study.where(F.col("divergence_ratio").isNotNull()).select(
        F.col("is_sustainable").alias("label"), F.col("divergence_ratio").alias("score")
    )
    return rounded(ev.threshold_table(rows))


# ---------------------------------------------------------------------------
# Splits, oversampling, training
# ---------------------------------------------------------------------------
@check(
    "ml1_train_test_split",
    with_study("""
SELECT repo_name, CASE WHEN ('0x' || substr(md5('42/' || repo_name), 1, 8))::BIGINT % 10000 < 2000 THEN 'test' ELSE 'train' END AS side
FROM study
"""),
)
def _(t):
    train, test = tr.split(t.study, "repo_name")
    return train.select("repo_name", F.lit("train").alias("side")).unionByName(
        test.select("repo_name", F.lit("test").alias("side"))
    )


@check(
    "ml2_stratified_fold_sizes",
    """SELECT label, fold, (n - fold + 4) // 5 AS rows
       FROM (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1), (VALUES (0), (1), (2), (3), (4)) f(fold)""",
)
def _(t):
    folded = tr.stratified_folds(t.table("labels"), "doc_id", "quality")
    return folded.groupBy(F.col("quality").alias("label"), "fold").agg(F.count("*").alias("rows"))


@check("ml3_smote_study")
def _(t):
    rows = t.study.select(*FEATURES, (1 - F.col("is_sustainable")).alias("label"))
    return smote(rows, FEATURES)


@check(
    "ml3_smote_class_sizes",
    """SELECT label, synthetic, n AS rows FROM (
         SELECT CASE WHEN label = 3 THEN 1 ELSE 0 END AS label, false AS synthetic, count(*) AS n FROM embeddings GROUP BY 1
         UNION ALL SELECT 1, true, count(*) FILTER (label <> 3) - count(*) FILTER (label = 3) FROM embeddings)""",
)
def _(t):
    """Oversampling one class of the embeddings to the size of the rest."""
    vectors = t.table("embeddings")
    names = [f"x{i}" for i in range(64)]
    rows = vectors.select(
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
        indicator(F.col("label") == 3).alias("label"),
    )
    return smote(rows, names).groupBy("label", "synthetic").agg(F.count("*").alias("rows"))


def _training_rows(t):
    return t.study.select(
        "repo_name", F.col("is_sustainable").alias("label"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES],
    )


@check("ml4_ml6_cross_validated_report")
def _(t):
    return tr.cv_train(_training_rows(t), FEATURES, k=3, rounds=5, depth=3).report


@check("ml4_ml5_study_settings")
def _(t):
    """Areas under the curve of five folds at the study's 500 rounds and depth 5, with its penalties."""
    return tr.cv_boost(_training_rows(t), FEATURES).fold_auc


@check("ml9_importance_comparison")
def _(t):
    """Customers with a high balance as one cohort, the others as the other."""
    rows, wealthy = _training_rows(t), F.col("balance") > 4500
    ranked = lambda part: tr.mean_importance(tr.cv_boost(part, FEATURES).importances)
    return tr.compare_importance(ranked(rows.where(wealthy)), ranked(rows.where(~wealthy)))


def _dataset(t):
    """The order study under the dataset's column names."""
    return t.study.select(
        "repo_name", "is_sustainable", "total_commits", "unique_commit_authors", "divergence_ratio",
        F.col("urgent").alias("star_count"),
        F.when(F.col("active_seconds") > 0, F.col("active_seconds") / 3600.0).alias("avg_issue_first_response_hrs"),
        (F.col("balance") > 0).alias("has_license"),
        (F.col("nation") % 3 == 0).alias("has_cicd"),
        F.when(F.col("segment") == "BUILDING", "Organization").otherwise("User").alias("fork_owner_type"),
        F.col("segment").alias("primary_language"),
        F.when(F.col("nation") > 3, F.concat(F.lit("n"), F.col("nation"))).alias("parent_language"),
    )


@check("ml4_ml5_cohort_comparison")
def _(t):
    data, owned = _dataset(t), F.col("fork_owner_type") == "Organization"
    tables = analysis.compare_cohorts(data.where(owned), data.where(~owned))
    return tables["importance"]


@check("ml5_ml8_threshold_analysis")
def _(t):
    return analysis.threshold_analysis(_dataset(t), rounds=5, depth=3)["thresholds"]


@check("ml10_ml11_explanation_analysis")
def _(t):
    return analysis.explanation_analysis(_dataset(t), instances=100, rounds=5, depth=3)


@check("sta_divergence_analysis")
def _(t):
    """All statistics of the divergence question as ``(table, row)`` in JSON."""
    tables = analysis.divergence_analysis(_dataset(t))
    rows = [df.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row")) for name, df in tables.items()]
    merged = rows[0]
    for part in rows[1:]:
        merged = merged.unionByName(part)
    return merged


@check("ml10_local_explanations")
def _(t):
    rows = _training_rows(t)
    train, test = tr.split(rows)
    model = tr.train(train, FEATURES, rounds=5, depth=3)
    chosen = ex.sample_rows(test, "repo_name", 100)
    return ex.explain_local(model, rows, chosen, FEATURES)


@check(
    "ml11_explanation_summary",
    """
SELECT feature, round(avg(share), 6) AS mean_signed, round(avg(abs(share)), 6) AS mean_abs,
  round(avg(CASE WHEN weight > 0 THEN 1 ELSE 0 END), 6) AS pos_ratio, count(*) AS count
FROM (SELECT feature, weight, CASE WHEN total > 0 THEN weight / total ELSE 0 END AS share FROM (
  SELECT l_returnflag || l_linestatus AS feature, l_discount - 0.05 AS weight,
    sum(abs(l_discount - 0.05)) OVER (PARTITION BY l_orderkey) AS total FROM lineitem))
GROUP BY 1
""",
)
def _(t):
    """Lines as rules of an order, the discount's deviation as weight."""
    rule = F.concat(F.lit("1.00 < "), F.col("l_returnflag"), F.col("l_linestatus"), F.lit(" <= "), F.col("l_quantity"))
    weights = t.table("lineitem").select(
        F.col("l_orderkey").alias("instance"), rule.alias("feature"), (F.col("l_discount") - 0.05).alias("weight")
    )
    return rounded(ex.explain_summary(weights))


@check(
    "fn15_feature_of_rule",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'f' || l_linenumber AS feature FROM lineitem""",
)
def _(t):
    name = F.concat(F.lit("f"), F.col("l_linenumber"))
    rule = (
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("-1.50 < "), name, F.lit(" <= "), F.col("l_tax")))
        .when(F.col("l_linenumber") % 3 == 1, F.concat(name, F.lit(" > "), F.col("l_quantity")))
        .otherwise(F.concat(name, F.lit("=1")))
    )
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", feature_of_condition(rule).alias("feature")
    )
