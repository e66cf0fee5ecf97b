"""Structure repair of conversations by a rank-convergence parallel Viterbi.

A conversation should read ``(s?(ua)+)?`` by the first letters of its roles. Edits and their costs: Keep 0,
Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant turn 2; a truncated turn that
stays costs 1 more, a blank or repeated one has to go. The cheapest edits win, of equal ones those whose
letters (K, R, D, I) come first in ASCII order.

The rows, in order, are cut into chunks of bounded rows and bytes. Costs run backwards: each chunk starts
from a speculative vector of costs, one per state of the pattern (that of a conversation's end). Fix-up
passes give a chunk the vector that the next one came to; a chunk is run again from there until its vectors
differ from the earlier ones by a constant only, which is then added to the rest, and the passes end when no
chunk meets another vector. What a chunk adds to the costs is summed up. The least audit is traced forwards
through each chunk from every state at once; stitching picks the state in which a chunk is entered. Texts
are shuffled once, and again only for conversations that lie in several chunks; only their hash, which has
to be taken in order, streams through one task a conversation, chunk by chunk.

Faults of a turn, of which the first counts: blank (nothing but white space), duplicate (its role and text
were there before), truncated (it doesn't end in one of ``.!?``).

Defined cases: rows go by turn (nulls first), role, the first 64 characters of the text and its hash; null
roles and texts are empty; a role that begins with none of s, u, a can only be reroled or deleted; a null
conversation id is one conversation; repeated rows are duplicates; an empty table gives an empty result;
other columns are left out.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sproutscope.llm.batches import bounded_batches, pieces
from sproutscope.session import stage

CHUNK_ROWS = 4096
CHUNK_BYTES = 1 << 20

# States of the pattern: nothing yet, after a system, a user, an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The role that a state can take besides a system turn, and the state after it.
EXPECTED = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Costs at the end of a conversation.
END = (0, 4, 2, 0)

_SPACE = " \t\n\v\f\r"
_BLANK = re.compile(r"[^\x20\x09-\x0D]")
_INITIALS = "sua"
_GOES = 0  # code of a turn that has to be deleted; others are 1 + 2 * initial + truncated

_LEGAL = {"su", "ua", "au"}


def code_of(role: str, text: str) -> int:
    """The code of a turn that isn't blank."""
    initial = _INITIALS.find(role[0]) if role else -1
    return 1 + 2 * (initial if initial >= 0 else 3) + (text.rstrip(_SPACE)[-1] not in ".!?")


def earlier(b: tuple, code: int) -> tuple:
    """Costs before a turn from those after it."""
    if code == _GOES:
        return tuple(x + DELETE for x in b)
    initial, cut = divmod(code - 1, 2)
    user = b[USER] + cut + (0 if initial == 1 else REROLE)
    empty = min(b[EMPTY] + DELETE, user, b[SYSTEM] + cut if initial == 0 else user)
    system = min(b[SYSTEM] + DELETE, user)
    assistant = min(b[ASSISTANT] + DELETE, user)
    after_user = min(b[USER] + DELETE, b[ASSISTANT] + cut + (0 if initial == 2 else REROLE))
    expects_assistant = min(after_user, assistant + INSERT)
    expects_user = min(assistant, after_user + INSERT)
    return min(empty, expects_assistant + INSERT), min(system, expects_assistant + INSERT), expects_assistant, expects_user


def backward(codes: bytes, end: tuple, old: np.ndarray | None = None) -> np.ndarray:
    """The costs at every place of a chunk, the last row being ``end``.

    With the vectors ``old`` of an earlier run it stops as soon as both differ by a constant.
    """
    n = len(codes)
    out = np.empty((n + 1, 4), dtype=np.int64)
    out[n] = b = end
    for i in range(n - 1, -1, -1):
        if old is not None:
            apart = out[i + 1] - old[i + 1]
            if (apart == apart[0]).all():
                out[: i + 1] = old[: i + 1] + apart[0]
                return out
        b = earlier(b, codes[i])
        out[i] = b
    return out


def trace(codes: bytes, costs: np.ndarray, state: int, last: bool) -> tuple[str, int]:
    """(initials of the least cheapest edits, state after them) of a chunk that is entered in ``state``.

    Turns are inserted before the next one of the chunk; after its last one only if the conversation ends.
    """
    rows, edits, n = costs.tolist(), [], len(codes)
    i = 0
    while i < n or (last and rows[n][state] > 0):
        left = rows[i][state]
        _, expected = EXPECTED[state]
        if i < n and rows[i + 1][state] + DELETE == left:
            edits.append("D")
            i += 1
            continue
        if rows[i][expected] + INSERT == left:
            edits.append("I")
            state = expected
            continue
        initial, cut = divmod(codes[i] - 1, 2)
        keeps = SYSTEM if initial == 0 and state == EMPTY else expected if initial == expected - 1 else None
        if keeps is not None and rows[i + 1][keeps] + cut == left:
            edits.append("K")
            state = keeps
        else:
            edits.append("R")
            state = expected
        i += 1
    return "".join(edits), state


def edited(roles, texts, audit: str, state: int):
    """(edit, role, text) of each edit of a chunk; a deleted turn has the role and text that it had."""
    i = 0
    for edit in audit:
        role, after = EXPECTED[state]
        if edit == "I":
            yield edit, role, ""
            state = after
            continue
        if edit == "D":
            yield edit, roles[i], texts[i]
        elif edit == "K":
            yield edit, roles[i], texts[i]
            state = SYSTEM if roles[i][0] == "s" else after
        else:
            yield edit, role, texts[i]
            state = after
        i += 1


# --- chunks ---------------------------------------------------------------------------------------

COUNTS = ["blank", "duplicate", "truncated", "illegal"]
CHUNK = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("whole", T.BooleanType()),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("codes", T.BinaryType()),
        T.StructField("marks", T.ArrayType(T.BinaryType())),
        *[T.StructField(c, T.LongType()) for c in COUNTS],
        T.StructField("n_turns", T.LongType()),
        T.StructField("first_turn", T.LongType()),
        T.StructField("last_turn", T.LongType()),
        T.StructField("first_initial", T.StringType()),
        T.StructField("last_initial", T.StringType()),
    ]
)


def _chunk(conv, rows: list, seen: set) -> dict:
    """A chunk of (turn, role, text) rows; ``seen``: marks of the run's turns before it in this task."""
    codes, marks, counts = bytearray(), [], dict.fromkeys(COUNTS, 0)
    before = None
    for _, role, text in rows:
        mark, code = None, _GOES
        if not _BLANK.search(text):
            counts["blank"] += 1
        else:
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            if mark in seen:
                counts["duplicate"] += 1
                mark = None
            else:
                seen.add(mark)
                code = code_of(role, text)
                counts["truncated"] += (code - 1) % 2
        codes.append(code)
        marks.append(mark)
        if before is not None:
            counts["illegal"] += before + role[:1] not in _LEGAL
        before = role[:1]
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "conv_id": conv, "roles": [r for _, r, _ in rows], "texts": [t for _, _, t in rows], "codes": bytes(codes), "marks": marks,
        **counts, "n_turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "first_initial": rows[0][1][:1], "last_initial": rows[-1][1][:1],
    }


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))


def _cut(batches, chunk_rows: int, chunk_bytes: int):
    """Chunks of sorted rows. ``whole`` ones hold a conversation that no other task can have a part of."""
    part, seq, runs, found = TaskContext.get().partitionId(), 0, 0, []
    conv, rows, size, cut, seen, held = object(), [], 0, False, set(), 0

    def close(whole: bool):
        nonlocal seq, rows, size, held
        if rows:
            found.append(_chunk(conv, rows, seen) | {"part": part, "seq": seq, "whole": whole})
            if whole:
                found[-1]["marks"] = None
            held += size + 100 * len(rows)
            seq, rows, size = seq + 1, [], 0

    def ready():
        nonlocal found, held
        out, found, held = found, [], 0
        return _batch(out, CHUNK)

    for batch in batches:
        for piece in pieces(batch, "text"):
            for own, turn, role, text in zip(*(piece.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if own != conv:
                    close(whole=runs > 1 and not cut)
                    conv, cut, seen, runs = own, False, set(), runs + 1
                elif len(rows) >= chunk_rows or size >= chunk_bytes:
                    close(whole=False)
                    cut = True
                if held >= chunk_bytes:
                    yield ready()
                rows.append((turn, role, text))
                size += len(text)
    close(whole=False)
    if found:
        yield ready()


def chunks(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows (conv_id, turn, role, text) in order, cut into chunks by (part, seq)."""
    bounded_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("uid"),
    )
    # a conversation with most of the rows spans many ranges; the last keys split rows that are alike
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), "uid"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    return stage(placed.mapInArrow(lambda b: _cut(b, chunk_rows, chunk_bytes), CHUNK), "chunks")


# --- costs and audits -----------------------------------------------------------------------------

SOLVED = T.StructType([*CHUNK.fields, T.StructField("gain", T.LongType()), T.StructField("state", T.IntegerType()), T.StructField("audit", T.StringType())])
_PLACE = ["conv_id", "part", "seq"]
_KEPT = ["codes", *COUNTS, "last"]
COSTED = T.StructType(
    [f for f in CHUNK.fields if f.name in [*_PLACE, "codes", *COUNTS]]
    + [
        T.StructField("last", T.BooleanType()),
        T.StructField("used", T.ArrayType(T.LongType())),
        T.StructField("came", T.ArrayType(T.LongType())),
        T.StructField("gain", T.LongType()),
        T.StructField("costs", T.BinaryType()),
    ]
)


def _rows_of(batches, column: str):
    for batch in batches:
        for piece in pieces(batch, column):
            yield piece.to_pylist()


def _costed(row: dict, end, old: np.ndarray | None) -> dict:
    """The chunk with its costs from the vector ``end``, whose least cost is 0."""
    costs = backward(row["codes"], tuple(end), old)
    gain = int(costs[0].min())
    return {**{k: row[k] for k in (*_PLACE, *_KEPT)}, "used": list(end), "came": (costs[0] - gain).tolist(), "gain": gain, "costs": costs.tobytes()}


def _speculate(batches):
    """Marks duplicates of turns in earlier chunks and runs every chunk from the end's vector."""
    for rows in _rows_of(batches, "codes"):
        for row in rows:
            codes = bytearray(row["codes"])
            for at in row["again"] or []:
                row["duplicate"] += 1
                row["truncated"] -= (codes[at] - 1) % 2
                codes[at] = _GOES
            row["codes"] = bytes(codes)
        yield _batch([_costed(r, END, None) for r in rows], COSTED)


def _fix(batches):
    """Runs chunks again that meet another vector than the one they started from."""
    for rows in _rows_of(batches, "costs"):
        out = []
        for row in rows:
            if row["wanted"] is not None:
                row = _costed(row, row["wanted"], np.frombuffer(row["costs"], dtype=np.int64).reshape(-1, 4))
            out.append({k: row[k] for k in COSTED.names})
        yield _batch(out, COSTED)


def _repeats(parts: DataFrame) -> DataFrame:
    """(part, seq, again): places of turns that an earlier chunk of the conversation has."""
    marked = parts.select(*_PLACE, F.posexplode("marks").alias("at", "mark")).where("mark IS NOT NULL")
    # a chunk has a mark once, so a group here is no larger than the number of its chunks
    earlier_ones = F.row_number().over(Window.partitionBy("conv_id", "mark").orderBy("part", "seq"))
    return marked.withColumn("k", earlier_ones).where("k > 1").groupBy("part", "seq").agg(F.collect_list("at").alias("again"))


def converged(parts: DataFrame) -> DataFrame:
    """Chunks of ``parts`` with their final costs; ``gain`` is what a chunk adds to the least cost."""
    in_order = Window.partitionBy("conv_id").orderBy("part", "seq")
    ends = parts.select(*_PLACE, F.lead("seq").over(in_order).isNull().alias("last"))
    narrow = parts.select("part", "seq", "codes", *COUNTS)
    ready = narrow.join(ends, ["part", "seq"]).join(_repeats(parts), ["part", "seq"], "left")
    state = stage(ready.mapInArrow(_speculate, COSTED), "costs")
    end = F.array(*[F.lit(c).cast("long") for c in END])
    while True:
        # a chunk whose turns all go hands on the vector that it gets, so its own is passed over
        moves = F.expr("hex(codes) RLIKE '[^0]'")
        following = F.first(F.when(moves, F.col("came")), ignorenulls=True).over(in_order.rowsBetween(1, Window.unboundedFollowing))
        met = state.select("part", "seq", "used", F.coalesce(following, end).alias("wanted")).where("wanted != used").drop("used")
        met = stage(met, "met")
        if met.isEmpty():
            return state
        state = stage(state.join(met, ["part", "seq"], "left").mapInArrow(_fix, COSTED), "costs")


TRACED = T.StructType(
    [f for f in COSTED.fields if f.name not in ("used", "came", "costs")]
    + [T.StructField("enters", T.LongType()), T.StructField("audits", T.ArrayType(T.StringType())), T.StructField("states", T.ArrayType(T.IntegerType()))]
)


def _trace_all(batches):
    for rows in _rows_of(batches, "costs"):
        for row in rows:
            costs = np.frombuffer(row["costs"], dtype=np.int64).reshape(-1, 4)
            found = [trace(row["codes"], costs, s, row["last"]) for s in range(4)]
            row["audits"], row["states"], row["enters"] = [a for a, _ in found], [s for _, s in found], row["came"][EMPTY]
        yield _batch([{k: r[k] for k in TRACED.names} for r in rows], TRACED)


def _solve_whole(batches):
    """Conversations of one chunk start from the end's true costs."""
    for rows in _rows_of(batches, "codes"):
        for row in rows:
            costs = backward(row["codes"], END)
            row["audit"], _ = trace(row["codes"], costs, EMPTY, True)
            row["gain"], row["state"] = int(costs[0][EMPTY]), EMPTY
        yield _batch(rows, SOLVED)


def _entered(batches):
    """The state in which each chunk is entered, by the states that chunks before it lead to."""
    conv, state = object(), EMPTY
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["conv_id"] != conv:
                conv, state = row["conv_id"], EMPTY
            out.append({"part": row["part"], "seq": row["seq"], "state": state})
            state = row["states"][state]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("state", pa.int32())]))


def solve(cut: DataFrame) -> DataFrame:
    """Chunks of :func:`chunks` with their faults, ``gain`` (their part of the cost), entered ``state`` and ``audit``."""
    whole = cut.where("whole").mapInArrow(_solve_whole, SOLVED)
    parts = cut.where("NOT whole")
    traced = stage(converged(parts).mapInArrow(_trace_all, TRACED), "traced")
    states = traced.select(*_PLACE, "states").repartition("conv_id").sortWithinPartitions(*_PLACE).mapInArrow(_entered, "part int, seq long, state int")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "seq")) == 1
    firsts = traced.select("part", "seq", first.alias("opens"))
    named = traced.join(states, ["part", "seq"]).join(firsts, ["part", "seq"])
    named = named.select("part", "seq", "codes", *COUNTS, (F.col("gain") + F.when(F.col("opens"), F.col("enters")).otherwise(0)).alias("gain"), "state", F.col("audits")[F.col("state")].alias("audit"))
    texts = parts.drop("codes", *COUNTS)
    return whole.unionByName(texts.join(named, ["part", "seq"]).select(*SOLVED.names))


# --- results --------------------------------------------------------------------------------------

TURNS = "conv_id long, part int, seq long, at int, edit string, role string, text string"


def repaired_turns(solved: DataFrame) -> DataFrame:
    """The edits of every conversation, in the order of (part, seq, at): edit, role, text; deleted turns included."""

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("at", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        for rows in _rows_of(batches, "codes"):
            out = [
                {**{k: r[k] for k in _PLACE}, "at": at, "edit": edit, "role": role, "text": text}
                for r in rows
                for at, (edit, role, text) in enumerate(edited(r["roles"], r["texts"], r["audit"], r["state"]))
            ]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return solved.mapInArrow(run, TURNS)


SUMMARY = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        T.StructField("audit", T.StringType()),
        T.StructField("repaired_sha256", T.StringType()),
    ]
)


def _summaries(batches):
    """One row per conversation from its chunks, one after another."""
    now, done = None, []

    def close():
        gaps = 0 if now["first"] is None else now["last"] - now["first"] + 1 - now["turns"]
        done.append({"conv_id": now["conv_id"], "gaps": gaps, **now["counts"], "cost": now["cost"], "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()})

    for rows in _rows_of(batches, "codes"):
        for row in rows:
            if now is None or row["conv_id"] != now["conv_id"]:
                if now is not None:
                    close()
                now = {"conv_id": row["conv_id"], "counts": dict.fromkeys(COUNTS, 0), "first": None, "last": None, "turns": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "initial": None, "kept": False}
            for c in COUNTS:
                now["counts"][c] += row[c]
            if now["initial"] is not None:
                now["counts"]["illegal"] += now["initial"] + row["first_initial"] not in _LEGAL
            now["initial"] = row["last_initial"]
            if row["first_turn"] is not None:
                now["turns"] += row["n_turns"] - (row["first_turn"] == now["last"])  # a turn number may go on in the next chunk
                now["first"] = row["first_turn"] if now["first"] is None else now["first"]
                now["last"] = row["last_turn"]
            now["cost"] += row["gain"]
            now["audit"].append(row["audit"])
            for edit, role, text in edited(row["roles"], row["texts"], row["audit"], row["state"]):
                if edit != "D":
                    now["hash"].update((("\n" if now["kept"] else "") + f"{role}:{text}").encode())
                    now["kept"] = True
        if done:
            yield _batch(done, SUMMARY)
            done = []
    if now is not None:
        close()
        yield _batch(done, SUMMARY)


def summaries(solved: DataFrame) -> DataFrame:
    """Faults, cost, audit and the hash of the repaired turns of every conversation."""
    whole = solved.where("whole").mapInArrow(_summaries, SUMMARY)
    parts = solved.where("NOT whole").repartition("conv_id").sortWithinPartitions(*_PLACE)
    return whole.unionByName(parts.mapInArrow(_summaries, SUMMARY))


def repair(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """:func:`summaries` of all conversations of rows (conv_id, turn, role, text and more)."""
    return summaries(solve(chunks(conversations, chunk_rows, chunk_bytes)))
