"""Repair of conversations against a shortest path over all edits of whole conversations."""

import hashlib
import heapq
import random
import re

import pytest

from sproutscope.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(kinds):
    """(cost, audit) by a queue over (cost, audit); ``kinds``: (initial, has to go, truncated) of each turn."""
    steps = {"": {"s": "s", "u": "su"}, "s": {"u": "su"}, "su": {"a": "sua"}, "sua": {"u": "su"}}
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(kinds) and state in ("", "sua"):
            return cost, audit
        moves = steps[state]
        for role in "ua":
            if role in moves:
                heapq.heappush(queue, (cost + 2, audit + "I", i, moves[role]))
        if i < len(kinds):
            initial, goes, cut = kinds[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state))
            if not goes:
                if initial in moves:
                    heapq.heappush(queue, (cost + cut, audit + "K", i + 1, moves[initial]))
                for role in "ua":
                    if role in moves:
                        heapq.heappush(queue, (cost + cut + 2, audit + "R", i + 1, moves[role]))
    raise AssertionError


def by_hand(rows):
    """The summary of one conversation's (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    rows = [(t, r or "", x or "") for t, r, x in rows]
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        goes = cut = False
        if not BLANK.search(text):
            counts[0] += 1
            goes = True
        elif (role, text) in seen:
            counts[1] += 1
            goes = True
        elif BLANK.findall(text)[-1] not in ".!?":
            counts[2] += 1
            cut = True
        seen.add((role, text))
        kinds.append((role[:1], goes, int(cut)))
    cost, audit = cheapest(kinds)
    out, expected, left = [], "user", iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        role = row[1] if edit == "K" else expected
        out.append(f"{role}:{row[2] if row else ''}")
        expected = "assistant" if role[0] == "u" else "user"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversation(draw, n, roles=("user", "assistant", "system", "tool", "", None)):
    texts = ["Yes.", "No!", "and then", "", " \t", "Why?  ", "fine. ", None, "x"]
    return [(draw.choice([k, k, k, k + 1, None]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"turn {draw.random()}{draw.choice('.!?x')}") for k in range(n)]


def found(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SCHEMA)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in repair.repair(df, **sizes).collect()}


@pytest.mark.parametrize("chunk_rows", [3, 4096])
def test_equals_shortest_paths(spark, chunk_rows):
    draw = random.Random(chunk_rows)
    made = {c: conversation(draw, draw.choice([1, 2, 5, 9, 30])) for c in [None, *range(40)]}
    made[100] = conversation(draw, 60, ("user",))
    made[101] = conversation(draw, 60, ("assistant", "user"))
    made[102] = [(k, "user", "") for k in range(50)] + [(50, "assistant", "Hi.")]  # all but one have to go
    made[103] = [(0, "system", "Be kind.")]
    rows = [(c, *r) for c, own in made.items() for r in own]
    draw.shuffle(rows)
    got = found(spark, rows, chunk_rows=chunk_rows)
    assert got == {c: by_hand(own) for c, own in made.items()}


def test_one_conversation_with_most_of_the_rows(spark):
    draw = random.Random(7)
    long = [(k, draw.choice(["user", "assistant"]), f"text {k % 700}{draw.choice(['.', ''])}") for k in range(5000)]
    short = {c: conversation(draw, 6) for c in range(20)}
    rows = [(77, *r) for r in long] + [(c, *r) for c, own in short.items() for r in own]
    got = found(spark, rows, chunk_rows=256)
    assert got == {77: by_hand(long)} | {c: by_hand(own) for c, own in short.items()}


def test_reruns_stop_where_vectors_differ_by_a_constant():
    codes = bytes(repair.code_of(r, "x.") for r in ["user", "assistant"] * 50)
    old = repair.backward(codes, repair.END)
    for end in [(0, 2, 0, 0), (3, 4, 0, 2), (0, 0, 0, 0)]:
        assert (repair.backward(codes, end, old) == repair.backward(codes, end)).all()


def test_repaired_turns_are_written_out(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi!"), (1, 3, "user", "Hi!")]
    turns = repair.repaired_turns(repair.solve(repair.chunks(spark.createDataFrame(rows, SCHEMA)))).orderBy("part", "seq", "at").collect()
    kept = [f"{t['role']}:{t['text']}" for t in turns if t["edit"] != "D"]
    assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == by_hand([r[1:] for r in rows])[-1]
    assert "".join(t["edit"] for t in turns) == by_hand([r[1:] for r in rows])[-2]


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == {}
    df = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 3)], SCHEMA + ", audit string, part int")
    assert repair.repair(df).first()["audit"] == "KI"


def test_query_equals_shortest_paths(spark):
    from sproutscope.llm.queries import damaged, queries

    folder = "/root/testdata/sf0.001"
    own = {}
    source = spark.read.parquet(f"{folder}/conversations.parquet")
    for r in damaged(source).collect():
        own.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    want = {r[0]: by_hand(own[r[0]]) if r[0] in own else nothing for r in source.select("conv_id").distinct().collect()}
    got = queries()["op12_conversation_repair"](spark, folder).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want
