"""Quality rules as a ledger of failure bits, judged by versioned policies.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; a policy is a mask over those bits, so a new policy or an ablation never touches a
text again.

Defined cases: a null or empty text has no words and all counts 0 (it fails ``few_words``); repeated
rows are judged one by one; an empty table gives an empty ledger; columns of the input that have the
name of a ledger column are replaced, all others are kept.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sproutscope.llm.batches import as_bytes, bounded_batches

SYMBOLS = b"#*$%&|<>"
WINDOW = 8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "max_word_bytes"]

#: Odd multipliers that mix the hashes of the words of a window.
_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    windows = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        windows += hashes[k : k + n] * _MIX[k]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    steps[:n] += twice
    steps[WINDOW : WINDOW + n] -= twice
    return int(np.count_nonzero(np.cumsum(steps[:-1])))


def _code_points(raw: bytes) -> int:
    return len(raw) - np.count_nonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) == 0x80)


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = (text or b"").split()  # splits exactly at the ASCII white space 09-0D and 20
    if not words:
        return (0,) * len(MEASURES)
    lines = [line for line in text.split(b"\n") if not line.isspace() and line]
    chars = _code_points(b"".join(words))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    most = max(map(len, words))
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words), most


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measured(text: pa.Array) -> pa.Array:
    rows = np.array([measure(t) for t in as_bytes(text)], dtype=np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(MEASURES))], names=MEASURES)


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL condition over the measurements holds."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a changed rule takes a new bit, so old ledgers keep their meaning.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(3, "repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "endless_word", "max_word_bytes > 1000"),
)

#: Versions of policies: the rules that a kept document must not fail.
POLICIES = {
    "v1": ("few_words", "repeated_windows", "symbols"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "endless_word"),
}
BASE = ("few_words", "repeated_windows")


def mask_of(names) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def failure_bits(rules=RULES) -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")) for r in rules]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: its other columns, the measurements and ``failed_bits``."""
    bounded_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text, "failed_bits", *MEASURES)]
    rows = docs.select(*others, measured(text).alias("__m")).select(*others, "__m.*")
    return rows.withColumn("failed_bits", failure_bits())


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def judge(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Ledger rows with ``base_failed``, ``policy`` and ``kept``."""
    base = F.col("failed_bits").bitwiseAND(F.lit(mask_of(BASE)).cast("long")) != 0
    return rows.withColumns({"base_failed": base, "policy": F.lit(policy), "kept": ~base & passes(policy)})


def ablations(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """What each rule of a policy decides alone: one row per rule.

    ``failed``: documents that fail it; ``only``: documents that no other rule of the policy drops,
    which are what the policy without the rule would keep in addition; ``kept``: what it keeps now.
    Documents are first counted per bit pattern, at most ``2 ** len(RULES)`` of them.
    """
    mask = mask_of(POLICIES[policy])
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).count()
    chosen = [r for r in RULES if r.name in POLICIES[policy]]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen]))
    spread = patterns.select("bits", "count", each.alias("r")).select("bits", "count", "r.rule", "r.bit")
    when = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0)).alias
    return spread.groupBy("rule").agg(
        when(F.col("bits").bitwiseAND(F.col("bit")) != 0)("failed"),
        when(F.col("bits") == F.col("bit"))("only"),
        when(F.col("bits") == 0)("kept"),
    )


def filter_documents(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that pass; their columns are unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return judge(ledger(rows), policy).where("kept").select("__row.*")
