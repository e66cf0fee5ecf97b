"""Explicit schemas and fixed values shared by every stage."""

from pyspark.sql import types as T

_S, _L, _B, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CORRUPT = "_corrupt"

# ---------------------------------------------------------------------------
# Raw archive envelope. ``payload`` is read as text: Spark's JSON reader returns
# the raw text of an object and the unescaped text of a string, so one column
# serves both spellings found in the archives.
# ---------------------------------------------------------------------------
RAW_EVENT = _struct(
    id=_S,
    type=_S,
    created_at=_S,
    repo=_struct(id=_L, name=_S),
    actor=_struct(login=_S),
    org=_struct(login=_S),
    payload=_S,
    **{CORRUPT: _S},
)

ARCHIVE_PAYLOAD = _struct(
    action=_S,
    issue=_struct(number=_L, created_at=_S),
    pull_request=_struct(number=_L, created_at=_S, merged=_B),
    commits=T.ArrayType(_struct(author=_struct(email=_S))),
)

FORK_PAYLOAD = _struct(
    forkee=_struct(
        full_name=_S,
        name=_S,
        id=_L,
        created_at=_S,
        updated_at=_S,
        default_branch=_S,
        owner=_struct(login=_S, type=_S),
        stargazers_count=_L,
        forks_count=_L,
        open_issues_count=_L,
        size=_L,
        has_issues=_B,
        has_wiki=_B,
        has_discussions=_B,
        archived=_B,
        is_template=_B,
        language=_S,
        topics=T.ArrayType(_S),
    )
)

CREATION_PAYLOAD = _struct(master_branch=_S)

_NAMED = _struct(name=_S)
_PRESENT = _struct(id=_S)
REPOSITORY_RESPONSE = _struct(
    repository=_struct(
        nameWithOwner=_S,
        isFork=_B,
        parent=_struct(
            nameWithOwner=_S, stargazerCount=_L, forkCount=_L, createdAt=_S, primaryLanguage=_NAMED
        ),
        contributing=_PRESENT,
        codeOfConduct=_PRESENT,
        license=_NAMED,
        cicd=_PRESENT,
        primaryLanguage=_NAMED,
        repositoryTopics=_struct(nodes=T.ArrayType(_struct(topic=_NAMED))),
        defaultBranchRef=_NAMED,
    )
)

ISSUE_STATE = _struct(
    issues_enabled=_B, open_issues_count=_L, closed_issues_count=_L, deleted_repo=_B
)

COMMIT_SERIES = _struct(
    parentName=_S,
    parentOwner=_S,
    childOwner=_S,
    childName=_S,
    forkTime=_S,
    commitTimes=T.MapType(_S, _L),
    issues=_S,
    commitsPost2m=_L,
    stars=_L,
)

# ---------------------------------------------------------------------------
# Flat event: one typed row per archive event, the input of every aggregate.
# ---------------------------------------------------------------------------
FLAT_EVENT = _struct(
    event_id=_S,
    type=_S,
    repo_name=_S,
    actor_login=_S,
    event_ts=_TS,
    ym=_S,
    action=_S,
    number=_S,
    opened_at=_TS,
    merged=_B,
    commit_emails=T.ArrayType(_S),
)

# ---------------------------------------------------------------------------
# Event types, windows, thresholds and column lists that decide
# the results and therefore must not vary.
# ---------------------------------------------------------------------------
PUSH = "PushEvent"
ISSUE = "IssuesEvent"
PULL_REQUEST = "PullRequestEvent"
ISSUE_COMMENT = "IssueCommentEvent"
REVIEW_COMMENT = "PullRequestReviewCommentEvent"
RELEASE = "ReleaseEvent"
WATCH = "WatchEvent"
FORK = "ForkEvent"

EARLY_DAYS = 182
EARLY_MONTHS = 6
EARLY_WEEKS = 26
LABEL_FIRST_DAY = 548
LABEL_LAST_DAY = 730
COHORT_MONTHS = ("2023-12", "2024-01")
MIN_SERIES_COMMITS = 15
POPULAR_MONTHS = 3
POPULAR_MORE_THAN = 5
BUS_FACTOR_SHARE = 0.8
RETENTION_MONTHS = (3, 6)
SCORE_THRESHOLDS = (0.3, 0.5, 0.7)

DIVERGENCE_BINS = (
    (0.0, 0.33, "Low (0.0-0.33)"),
    (0.33, 0.66, "Medium (0.33-0.66)"),
    (0.66, 1.01, "High (0.66-1.0)"),
)

COHORT_COLUMNS = [
    "repo_name", "repo_id", "created_at", "is_fork", "default_branch",
    "fork_owner_login", "fork_owner_type",
    "parent_repo_name", "parent_repo_id", "parent_org",
    "initial_stars", "initial_forks", "initial_open_issues", "initial_size_kb",
    "has_issues_enabled", "has_wiki", "has_discussions", "is_archived", "is_template",
    "initial_language", "initial_topics",
    "event_id", "event_created_at",
]

ACTIVITY_COLUMNS = [
    "total_commits", "unique_commit_authors",
    "issues_opened", "issues_closed",
    "prs_opened", "prs_merged", "prs_rejected",
    "num_releases", "star_count", "fork_count",
    "total_issue_comments", "total_pr_comments",
]

RESPONSE_COLUMNS = ["avg_issue_first_response_hrs", "avg_pr_first_response_hrs"]

GOVERNANCE_FLAGS = ["has_contributing", "has_code_of_conduct", "has_license", "has_cicd"]

PARENT_COLUMNS = [
    "parent_repo", "parent_stars", "parent_forks", "parent_created_at", "parent_language",
]

DIVERGENCE_COLUMNS = ["early_commits_on_branch", "parent_early_commits", "divergence_ratio"]

DATASET_COLUMNS = [
    "repo_name", "is_fork", "fork_owner_type", "created_at",
    "total_commits", "commit_frequency_per_week", "unique_commit_authors",
    "issues_opened", "issues_closed", "issue_close_rate",
    "prs_opened", "prs_merged", "prs_rejected", "pr_acceptance_rate",
    "num_releases", "star_count", "fork_count",
    "total_issue_comments", "total_pr_comments",
    "avg_issue_first_response_hrs", "avg_pr_first_response_hrs",
    "bus_factor", "contributor_gini", "retention_m3", "retention_m6",
    "months_to_first_external_contrib",
    "has_contributing", "has_code_of_conduct", "has_license", "has_cicd",
    "parent_repo", "parent_stars", "parent_forks", "parent_created_at", "parent_language",
    "early_commits_on_branch", "parent_early_commits", "divergence_ratio",
    "primary_language", "topics",
]

NEVER_FEATURES = [
    "repo_name", "created_at", "parent_repo", "parent_created_at", "topics",
    "is_fork", "is_sustainable",
]

FORK_ONLY_FEATURES = [
    "parent_stars", "parent_forks", "parent_language",
    "early_commits_on_branch", "parent_early_commits", "divergence_ratio",
]

DOUBLED_MEDIAN_FEATURES = ["avg_issue_first_response_hrs", "avg_pr_first_response_hrs"]

LOGIT_CONTROLS = [
    "divergence_ratio", "total_commits", "unique_commit_authors", "star_count",
    "has_license", "has_cicd", "fork_owner_type",
]

BOOSTER_DEFAULTS = {
    "rounds": 500, "depth": 5, "learning_rate": 0.05, "row_sample": 0.8,
    "feature_sample": 0.8, "min_leaf_rows": 5, "min_gain": 0.1,
}

# penalties on leaf values and the least curvature of a leaf, for the second-order learner
BOOSTER_PENALTIES = {"alpha": 0.1, "lambda": 1.0, "min_leaf_weight": 5.0}

# the learner's own defaults, used with a single train/test split
PLAIN_BOOSTER = {
    "rounds": 100, "depth": 6, "learning_rate": 0.3, "row_sample": 1.0,
    "feature_sample": 1.0, "min_leaf_rows": 1, "min_gain": 0.0,
}

EDA_COLUMNS = [
    "repo", "early_commits", "sustained_commits", "stars", "total_issues",
    "issue_closure_rate", "healthy",
]
