"""The mix of sources against fractions in plain Python."""

from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from sproutscope.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def targets_by_hand(sizes, weights=mixing.WEIGHTS, most=mixing.MOST_COPIES):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped = set()
    while True:
        rest = [s for s in names if s not in capped]
        words, total = sum(sizes.values()) - most * sum(sizes[s] for s in capped), sum(weight[s] for s in rest)
        share = {s: Fraction(weight[s] * words, total) for s in rest}
        above = {s for s in rest if share[s] > most * sizes[s]}
        if not above:
            return share | {s: Fraction(most * sizes[s]) for s in capped}
        capped |= above


def sizes_by_hand(rows):
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len((text or "").split(" ")) if text else 0
    return sizes


def words(n):
    return " ".join(["w"] * n) or None


CASES = {
    "even": [(k, f"s{k % 4}", words(1 + k % 17)) for k in range(400)],
    "hot": [(k, "a" if k % 3 else f"s{k % 7}", words(1 + k * k % 50)) for k in range(900)],
    "bounds": [(k, "tiny" if k < 5 else "zero" if k < 8 else None if k < 20 else "Big", None if k in (5, 6, 7) else words(3 + k % 5)) for k in range(300)],
    "long": [(0, "a", words(20_000))] + [(k, "b", words(5)) for k in range(1, 200)] + [(k, "a", words(9)) for k in range(200, 300)],
    "repeated": [(1, "x", "one two")] * 50 + [(None, "y", words(4))] * 30 + [(2, "z", "")] * 3,
}


@pytest.mark.parametrize("case", CASES)
def test_targets_and_copies(spark, case):
    rows = CASES[case]
    sized = mixing.with_size(spark.createDataFrame(rows, SCHEMA)).drop("text")
    found = mixing.allot(sized).collect()
    sizes = sizes_by_hand(rows)
    want = targets_by_hand(sizes)
    assert Counter((r["doc_id"], r["source"]) for r in found) == Counter((i, s) for i, s, _ in rows)
    taken, count, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        count[r["source"]] += r["copies"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for source, target in want.items():
        own = sum(s == source for _, s, _ in rows)
        assert abs(taken[source] - target) <= longest[source]
        if sizes[source]:
            assert abs(count[source] - own * target / sizes[source]) < 1
            per_document = {r["copies"] for r in found if r["source"] == source}
            assert max(per_document) - min(per_document) <= 1  # one more or less than expected
    assert sorted(map(str, mixing.allot(sized).collect())) == sorted(map(str, found))


def test_mixture_holds_the_texts(spark):
    rows = CASES["bounds"]
    docs = spark.createDataFrame([(*r, 7, "c") for r in rows], SCHEMA + ", target int, copy string")
    mixed = mixing.mixture(docs)
    copies = {r["doc_id"]: r["copies"] for r in mixing.allot(mixing.with_size(docs)).collect()}
    got = Counter(r["doc_id"] for r in mixed.collect())
    assert got == Counter({i: n for i, n in copies.items() if n})
    assert {r["doc_id"]: r["text"] for r in mixed.collect()}.items() <= {i: t for i, _, t in rows}.items()


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixture(empty).collect() == []
    assert mixing.allot(mixing.with_size(spark.createDataFrame([(1, "a", None), (2, None, " ")], SCHEMA))).where("copies > 0 OR target > 0").count() == 0
