import itertools
import re

import duckdb
import pytest

from sproutscope.llm import decontaminate as d
from sproutscope.llm import queries


def tokens(text):
    return re.findall(r"[\u4e00-\u9fff]|[^\W_\u4e00-\u9fff]+", (text or "").lower())


def brute_force(pairs, items):
    out = set()
    for doc_id, text in pairs:
        t = tokens(text)
        for item_id, item in items:
            w = tokens(item)
            if len(w) < d.LEAST_TOKENS:
                at = [k for k in range(len(t) - len(w) + 1) if t[k : k + len(w)] == w]
                if w and at and (len(w) >= d.LEAST_RUN or len(w) == len(t)):
                    out.add((doc_id, item_id, len(w)))
                continue
            width = min(len(w), d.WINDOW)
            best = 0
            for shift in range(-len(w) + 1, len(t)):
                same = [0 <= shift + j < len(t) and t[shift + j] == x for j, x in enumerate(w)]
                best = max(best, max(sum(same[s : s + width]) for s in range(len(w) - width + 1)))
            if best >= width - (width - 7) // 2:
                out.add((doc_id, item_id, best))
    return out


@pytest.mark.parametrize("width", range(d.LEAST_TOKENS, d.WINDOW + 1))
def test_masks_miss_no_allowed_substitution(width):
    for wrong in itertools.combinations(range(width), (width - 7) // 2):
        assert any(not any(s + m in wrong for m in mask) for mask in d.MASKS for s in range(width - mask[-1]))


@pytest.mark.parametrize("limit,part", [(d.BROADCAST_SEEDS, d.PART), (0, d.PART), (d.BROADCAST_SEEDS, 7), (0, 11)])
def test_by_brute_force_on_both_paths(spark, docs, prose, monkeypatch, limit, part):
    monkeypatch.setattr(d, "PART", part)
    items = [(k, prose(f"item{k}", 8 + 3 * k)) for k in range(6)] + [(90, prose("item2", 14)), (91, None), (92, "too short")]
    pairs = [(k, prose(k, 80)) for k in range(8)]
    for k, (item_id, item) in enumerate(items[:6]):
        words = item.split()
        for changes in range(5):
            own = words[:]
            for c in range(changes):
                own[(c * 5 + k) % len(own)] = f"other{c}"
            pairs.append((100 * (k + 1) + changes, f"{prose(f'before{k}', 30)}, {' '.join(own)}. {prose(f'after{k}', 20)}"))
    pairs += [(1000, None), (1001, ""), (1002, items[3][1].upper()), (1002, items[3][1].upper()), (1003, items[4][1][: len(items[4][1]) // 2])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = docs(pairs)
    found = d.overlaps(table, benchmark, limit)
    by_text = {}
    keyed = table.selectExpr("doc_id", "md5(text) AS text_key").join(found, "text_key")
    for r in keyed.collect():
        by_text[r.doc_id, r.item_id] = r.matched
    assert {(i, j, m) for (i, j), m in by_text.items()} == brute_force(pairs, items)


SHORT = [(1, "one"), (2, "One two."), (3, "one two three four"), (4, "a b c d e f g"), (5, "a b c d e f g h"), (6, "…"), (7, None), (8, "one"), (9, "天地玄黄宇宙洪荒日月盈昃"), (10, "天地玄黄")]


@pytest.mark.parametrize("limit,part", [(d.BROADCAST_SEEDS, d.PART), (0, 5)])
def test_short_items_and_scripts_without_spaces(spark, docs, prose, monkeypatch, limit, part):
    monkeypatch.setattr(d, "PART", part)
    texts = ["one", "One, two", "one two three", "zero one two three four five", "a b c d e f g", "x a b c d e f g h y", "a b c d e f", "",
             "我们说天地玄黄宇宙洪荒日月盈昃。完了", "我们说天地玄黄宇宙洪荒x月盈昃", "x天地玄黄y", "天地玄", f"{prose(1, 30)} one two three four {prose(2, 30)}"]
    pairs = [*enumerate(texts), (98, None), (99, "one")]
    table, benchmark = docs(pairs), spark.createDataFrame(SHORT, "item_id long, text string")
    keyed = table.selectExpr("doc_id", "md5(text) AS text_key").join(d.overlaps(table, benchmark, limit), "text_key")
    want = brute_force(pairs, SHORT)
    assert {(r.doc_id, r.item_id, r.matched) for r in keyed.collect()} == want and keyed.count() == len(want)
    assert (3, 3, 4) in want and (2, 1, 1) not in want and (9, 9, 11) in want
    kept = {r.doc_id for r in d.filter_documents(table, benchmark).collect()}
    assert kept == {i for i, _ in pairs} - {i for i, _, _ in want}


def test_short_items_in_sql(spark, docs, tmp_path):
    pairs = [(1, "one"), (2, "zero one two three four"), (3, "x天地玄黄y"), (4, "one two"), (4, "one two"), (5, None), (6, "天地玄黄宇宙洪荒日月盈星")]
    docs(pairs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(SHORT, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = sorted(tuple(r) for r in queries.op7(spark, str(tmp_path)).collect())
    assert found == sorted(con.execute(queries.DECONTAMINATION_SQL).fetchall()) and len(found) == 8


def test_filter_and_empty_tables(spark, docs, prose):
    item = prose("item", 30)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    table = docs([(1, f"x y {item}"), (2, prose(2, 50)), (3, None), (4, "")])
    out = d.filter_documents(table, benchmark)
    assert out.columns == table.columns and sorted(r.doc_id for r in out.collect()) == [2, 3, 4]
    assert d.contaminated(docs([]), benchmark).count() == 0
    assert d.filter_documents(table, benchmark.where("false")).count() == 4


def test_no_python_on_the_main_path(spark, docs, prose):
    benchmark = spark.createDataFrame([(1, prose("item", 30))], "item_id long, text string")
    plan = d.overlaps(docs([(1, "a b")]), benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
