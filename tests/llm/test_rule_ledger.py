from collections import Counter

from sproutscope.llm import quality_rules as q


def by_hand(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    return len(words), len(inside)


def test_repeated_windows_by_brute_force(prose):
    base = prose(1, 60)
    texts = [base, f"{base} {base}", " ".join(["x"] * 30), " ".join(base.split()[:7]), f"{prose(2, 20)} {base} {prose(3, 9)} {base[:100]}", "", " \n "]
    for t in texts:
        m = dict(zip(q.MEASURES, q.measure(t.encode()), strict=True))
        assert (m["n_words"], m["n_repeat_words"]) == by_hand(t)


def test_cases_by_hand(docs):
    pairs = [
        (1, None),
        (2, ""),
        (3, "é* a\n\nb|c\né* a\n \té"),
        (4, " ".join(f"w{i}" for i in range(25))),
        (4, " ".join(f"w{i}" for i in range(25))),
        (5, "a b\x0bc"),
    ]
    rows = sorted(q.judge(q.ledger(docs(pairs))).collect(), key=lambda r: r.doc_id)
    assert [r.n_words for r in rows] == [0, 0, 6, 25, 25, 2]
    assert rows[2].word_chars == 10 and rows[2].n_symbols == 3
    assert rows[2].n_dup_lines == 1 and rows[2].n_lines == 4
    assert rows[5].word_chars == 4
    assert [r.base_failed for r in rows] == [True, True, True, False, False, True]
    assert [r.kept for r in rows] == [False, False, False, True, True, False]
    assert rows[0].lang == "en" and rows[0].source == "src0"


def test_empty_table_and_clashing_columns(docs, spark):
    assert q.ledger(docs([])).count() == 0
    clash = docs([(1, "a b")]).selectExpr("*", "7L AS n_words", "'x' AS failed_bits", "true AS kept")
    row = q.judge(q.ledger(clash)).first()
    assert row.n_words == 2 and row.failed_bits & 1 and row.kept is False


def test_policies_and_ablations_agree_with_rejudging(docs, prose):
    pairs = [(i, prose(i, 40)) for i in range(5)] + [(9, "short"), (10, "# " * 40), (11, "a b c d e f g h " * 9), (12, None)]
    ledger = q.ledger(docs(pairs))
    for policy, names in q.POLICIES.items():
        kept = {r.doc_id for r in q.judge(ledger, policy).where("kept").collect()}
        table = {r.rule: r for r in q.ablations(ledger, policy).collect()}
        assert set(table) == set(names)
        for rule, row in table.items():
            q.POLICIES["without"] = tuple(n for n in names if n != rule)
            without = {r.doc_id for r in ledger.where(q.passes("without")).collect()}
            del q.POLICIES["without"]
            assert row.kept == len(kept) and row.only == len(without - kept)


def test_filter_keeps_columns_and_clean_documents(docs, prose):
    table = docs([(1, prose(1, 50)), (2, None), (3, "### " * 30), (1, prose(1, 50))])
    out = q.filter_documents(table)
    assert out.columns == table.columns and sorted(r.doc_id for r in out.collect()) == [1, 1]
