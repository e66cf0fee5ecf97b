"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all turns before it are context, and only its text is
trainable. All examples of a conversation are prefixes of one rendering, so the rendering is stored
once, a row per turn with its offsets, and an example is (conversation, end, loss span). A
conversation of n turns takes n rows, not n squared; ``render`` writes out the texts of examples.

The template marks a turn as ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. In texts and roles a
backslash is doubled and ``<|`` becomes ``<\\|``, so no control string can appear inside a text.

Defined cases: null texts and roles are empty; turns are ordered by (turn, role, text) with nulls
first, and equal rows are all kept; conversations without an assistant have rows but no example; a
null conversation id is one conversation; an empty table gives an empty result; other columns are
left out.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sproutscope.llm.batches import bounded_batches, pieces

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"

FORMATTED = (
    "conv_id long, ordinal long, segment string, start long, end long, target boolean, loss_start long, loss_end long"
)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLAIN = {"n": "\n"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN.get(m[1], m[1]), text)


def segment_of(role: str, text: str) -> tuple[str, int]:
    """The formatted turn and where its text starts."""
    head = f"{START}{escape_role(role)}\n"
    return f"{head}{escape(text)}{END}", len(head)


def parse(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    head, _, rest = segment.removeprefix(START).partition("\n")
    return unescape(head), unescape(rest.removesuffix(END))


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as formatted turns with their offsets in the rendering.

    A task streams over the turns of its conversations in order and holds no conversation.
    """
    bounded_batches(conversations.sparkSession)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        current, ordinal, at = object(), 0, 0
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for conv, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                    if conv != current:
                        current, ordinal, at = conv, 0, 0
                    segment, head = segment_of(role, text)
                    target = role == TARGET_ROLE
                    loss = (at + head, at + len(segment) - len(END)) if target else (None, None)
                    rows.append((conv, ordinal, segment, at, at + len(segment), target, *loss))
                    ordinal, at = ordinal + 1, at + len(segment)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in FORMATTED.split(", ")])

    return ordered.mapInArrow(run, FORMATTED)


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn, exploded out of its conversation: an example of its own.

    Its context is all of the rendering before ``loss_start``, ``context_turns`` turns and the head
    of its own, kept as a reference; only ``loss_start`` to ``loss_end`` is trainable; it has ``chars`` characters.
    """
    rows = formatted.where("target")
    return rows.select("conv_id", F.col("ordinal").alias("example"), F.col("ordinal").alias("context_turns"), F.col("end").alias("chars"), "loss_start", "loss_end")


def render(formatted: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts of chosen examples (of ``examples``), written out with all their context."""
    turns = formatted.select("conv_id", "ordinal", "segment").alias("t")
    chosen = chosen.alias("e")
    near = F.expr("e.conv_id <=> t.conv_id AND t.ordinal <= e.example")
    columns = [F.col(f"e.{c}") for c in ("conv_id", "example", "loss_start", "loss_end")]
    listed = chosen.join(turns, near).groupBy(*columns).agg(F.sort_array(F.collect_list(F.struct("t.ordinal", "t.segment"))).alias("turns"))
    return listed.select("conv_id", "example", "loss_start", "loss_end", F.concat_ws("", F.transform("turns", lambda t: t["segment"])).alias("text"))


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, stored_chars long"
)


def digests(formatted: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """What the stored turns and :func:`examples` say, one row per conversation.

    The turns are read back out of their segments; what is trained on and how long examples are comes from
    the example rows alone, whose spans are read out of the rendering. ``formatted_chars``: characters
    of all examples with their contexts, and of the turns after the last example once;
    ``stored_chars``: characters of the rendering.
    """
    found = examples(formatted) if found is None else found
    none = lambda c: F.lit(None).cast("long").alias(c)
    turns = formatted.select("conv_id", "ordinal", F.lit(0).alias("kind"), "segment", "start", "end", none("chars"), none("loss_start"), none("loss_end"))
    spans = found.select("conv_id", F.col("example").alias("ordinal"), F.lit(1).alias("kind"), F.lit("").alias("segment"), none("start"), none("end"), "chars", "loss_start", "loss_end")
    ordered = turns.unionByName(spans).repartition("conv_id").sortWithinPartitions("conv_id", "ordinal", "kind")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def run(batches):
        state, done = None, []

        def close(s):
            return (s["conv"], s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"] + s["end"] - s["covered"], s["examples"], s["end"])

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for part in pieces(batch, "segment"):
                for row in part.to_pylist():
                    if state is None or row["conv_id"] != state["conv"]:
                        if state is not None:
                            done.append(close(state))
                        state = {"conv": row["conv_id"], "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "end": 0, "covered": 0, "examples": 0}
                    if row["kind"] == 0:
                        role, text = parse(row["segment"])
                        state["turns"] += 1
                        state["all"].update(f"{role}\n{text}\n".encode())
                        state["end"], state["last"] = row["end"], row
                    else:  # an example ends with the turn just read
                        last = state["last"]
                        target = unescape(last["segment"][row["loss_start"] - last["start"] : row["loss_end"] - last["start"]])
                        state["chars"] += len(target)
                        state["loss"].update(target.encode())
                        state["formatted"] += row["chars"]
                        state["covered"] = row["chars"]
                        state["examples"] += 1
                if done:
                    yield table(done)
                    done = []
        if state is not None:
            yield table([close(state)])

    return ordered.mapInArrow(run, DIGESTS)
