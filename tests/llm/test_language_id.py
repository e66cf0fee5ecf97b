import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from sproutscope.llm import language_id as li

SF = "/root/testdata/sf0.01"
TABLE = li.letter_table()


def by_hand(text):
    """Grams of one text, character by character."""
    codes = []
    for c in text:
        low = int(TABLE[ord(c)])
        if low or (codes and codes[-1]):
            codes.append(low)
    if codes and codes[-1]:
        codes.append(0)
    out = []
    for i, c in enumerate(codes):
        before = [codes[i - k] if i >= k else 0 for k in (3, 2, 1)]
        out.append(before[0] << 48 | before[1] << 32 | before[2] << 16 | c)
    return out


def test_grams_by_hand():
    texts = ["Ab, c", "", "12 !", "xÉ\n\nß", "a", "中文 ab", "  lead"]
    got, ends = li.grams(texts, TABLE)
    starts = [0, *ends[:-1]]
    for t, a, b in zip(texts, starts, ends, strict=True):
        assert got[a:b].tolist() == by_hand(t), t


def test_probabilities_sum_to_one():
    keys, counts = np.unique(li.grams(["the cat sat on the mat", "a bat and a cat"], TABLE)[0], return_counts=True)
    model = li.KneserNey(keys, counts)
    alphabet = model.tables[1][0]
    for order in (2, 3, 4):
        for context in model.contexts[order][0][:20]:
            p = model.probability((context << np.uint64(16)) | alphabet, order, len(alphabet) + 1)
            unseen = model.probability(np.array([(context << np.uint64(16)) | np.uint64(0xFFFE)]), order, len(alphabet) + 1)
            assert abs(p.sum() + unseen[0] - 1) < 1e-9


def test_arrays_give_the_models_probabilities():
    counted, texts = [], {"x": "the cat sat on the mat", "y": "der hund und die katze"}
    for name, t in texts.items():
        keys, n = np.unique(li.grams([t], TABLE)[0], return_counts=True)
        counted.append(pd.DataFrame({"lang": name, "gram": keys.view(np.int64), "n": n}))
    models = li.build(pd.concat(counted))
    size = len({c for f in counted for c in (f["gram"].to_numpy().view(np.uint64) & np.uint64(0xFFFF)).tolist()}) + 1
    probe = li.grams(["the hund qux", "zzz"], TABLE)[0]
    logs = li._log_probabilities(models, probe)
    for k, f in enumerate(counted):
        own = li.KneserNey(f["gram"].to_numpy().view(np.uint64), f["n"].to_numpy())
        assert np.allclose(logs[:, k], np.log(own.probability(probe, 4, size)), atol=1e-4)


def test_counts_by_hand(docs):
    table = docs([(1, "ab ab"), (2, "ab"), (3, None), (4, "ba")], lang={1: "x", 2: "x", 3: "x", 4: "y"})
    got = {(r.lang, r.gram): r.n for r in li.count_grams(table).collect()}
    want = {}
    for lang, text in (("x", "ab ab"), ("x", "ab"), ("y", "ba")):
        for g in by_hand(text):
            want[lang, np.uint64(g).view(np.int64).item()] = want.get((lang, np.uint64(g).view(np.int64).item()), 0) + 1
    assert got == want


def test_odd_rows_and_columns(docs):
    pairs = [(k, "the cat sat on the mat and the dog") for k in range(40)] + [(100 + k, "der hund und die katze sind im haus") for k in range(40)]
    pairs += [(900, None), (901, "12 34 !!"), (902, ""), (903, "the dog sat"), (903, "the dog sat"), (None, "der hund")]
    langs = {i: None if i is None or i >= 900 else "de" if i >= 100 else "en" for i, _ in pairs}
    table = docs(pairs, lang=langs).selectExpr("*", "'z' AS score", "1 AS chars")
    rows = li.identify(table).collect()
    assert len(rows) == len(pairs)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (900, 901, 902))
    assert by[903].lang_pred == "en" and by[None].lang_pred == "de" and by[903].chars == 1
    assert all(by[i].lang_pred == langs[i] and not by[i].rejected and 0.5 < by[i].score <= 1 for i, _ in pairs if langs.get(i))
    kept = li.filter_documents(table)
    assert kept.columns == table.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())


def test_other_languages_are_rejected_and_mixed_ones_kept(docs, prose):
    pairs = [(k, prose(k, 40)) for k in range(300)]
    other = [(1000, prose("o", 40, "vwxyz")), (1001, prose("p", 40, "бгджзлмнпр"))]
    mixed = [(1002, prose("m", 20) + " " + prose("o", 3, "vwxyz"))]
    got = {r.doc_id: r.rejected for r in li.identify(docs([*pairs, *other, *mixed], lang={i: "en" for i, _ in pairs})).collect()}
    assert got[1000] and got[1001] and not got[1002]
    assert not any(got[i] for i, _ in pairs)


def test_without_labels_or_rows(docs):
    assert li.identify(docs([])).count() == 0
    rows = li.identify(docs([(1, "abc")], lang={})).collect()
    assert rows[0].lang_pred == "und" and rows[0].rejected


def test_models_beyond_the_bound_give_the_same_scores(docs, prose, monkeypatch):
    """No gram is dropped: with a bound that bites, the rest of the grams are joined."""
    pairs = [(k, prose(k, 25) if k % 2 else prose(k, 25, "bcdfinortuvwxyzé")) for k in range(120)]
    pairs += [(200, None), (201, "12 34 !!"), (202, ""), (203, prose("u", 9, "abxyzж中文")), (204, "zq"), (None, prose(5, 12))]
    table = docs(pairs, lang={i: None if i is None or i >= 200 else "en" if i % 2 else "xx" if i % 3 else "yy" for i, _ in pairs})
    rows = lambda: {r.doc_id: r for r in li.identify(table).collect()}
    want = rows()
    for cells in (1, 4000):
        monkeypatch.setattr(li, "CELLS", cells)
        got = rows()
        assert got.keys() == want.keys()
        for i, r in got.items():
            assert (r.lang_pred, r.rejected, r.held_out) == (want[i].lang_pred, want[i].rejected, want[i].held_out)
            assert abs(r.score - want[i].score) < 1e-4 and abs((r.entropy or 0) - (want[i].entropy or 0)) < 1e-4


@pytest.fixture(scope="module")
def predicted(spark):
    found = entry.queries()["op2_language_id"](spark, SF).toPandas()
    return found.merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")


def test_held_out_accuracy(predicted):
    held = predicted[predicted.held_out]
    assert len(held) > 250 and (held.lang == held.lang_pred).mean() > 0.97
    assert predicted.rejected.mean() < 0.01


def test_held_out_labels_are_not_read(spark, predicted, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "IF(crc32(string(doc_id)) % 3 = 1, 'wrong', lang) AS lang")
    again = li.identify(table).toPandas().merge(predicted, on="doc_id")
    assert (again.lang_pred_x == again.lang_pred_y).all() and np.allclose(again.score_x, again.score_y)
