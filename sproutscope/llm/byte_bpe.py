"""Byte-level BPE: overlapping chunk encoding, and decoding by concatenation of raw bytes.

A long text is cut into chunks that overlap. Each chunk is split into pre-tokens on its own, in
parallel, as if the text began there. Its first pre-tokens may be wrong, but a position at which two
neighbouring chunks both start a pre-token is one from which they agree for good: the pattern looks
at nothing before a pre-token. The chunks are stitched at the first such position, and where an
overlap has none, the pre-tokens of the left chunk are continued until they meet one of the right
chunk. The pieces are then encoded by the ranks.

Defined cases: a null or empty text has no ids; texts of any length are processed whole; repeated
rows are encoded one by one; an empty table gives an empty result; other columns are kept.
"""

import base64
import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sproutscope.llm.batches import Remembered, add_columns, as_bytes, once, pieces

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 10
#: A pre-token is certain if it starts this many characters before the end of a chunk or earlier.
MARGIN = 4
#: Distinct words whose ids a worker remembers, twice over.
REMEMBERED = 150_000

#: A space before white space, where a text can't be cut by plain spaces.
_UNSURE = re.compile(r" (?=\s)| \Z")
_SURE = re.compile(r" (?=\S)")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Pieces:
    """Pre-tokens of a pattern and their ids by a rank file.

    A space before a character that is not white space always starts a pre-token, so a text is first
    divided there, and the pre-tokens of each distinct word are found once.
    """

    def __init__(self, path: str, pattern: str):
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        self.pattern = regex.compile(pattern)
        self.ids = Remembered(REMEMBERED)

    @staticmethod
    def words(text: str) -> list[str]:
        """The text divided at spaces that surely start a pre-token; each but the first lost its space."""
        return _SURE.split(text) if _UNSURE.search(text) else text.split(" ")

    def ids_of(self, word: str) -> bytes:
        found = self.ids.older(word)
        if found is None:
            found = self.ids.new[word] = np.array(self.encoding.encode_ordinary(word), dtype="<u4").tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        self.ids.age()
        first, *rest = self.words(text)
        get, out = self.ids.new.get, [self.ids_of(first)] if first else []
        for word in rest:
            word = " " + word
            out.append(get(word) or self.ids_of(word))
        return b"".join(out)

    def pieces(self, text: str, origin: int = 0) -> tuple[bytes, bytes, bytes]:
        """Of all pre-tokens of a chunk: starts counted from ``origin``, counts of ids, and ids."""
        self.ids.age()
        found, get = self.pattern.findall(text), self.ids.new.get
        ids = [get(p) or self.ids_of(p) for p in found]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        return (origin + np.cumsum(lengths) - lengths).astype("<i8").tobytes(), counts.astype("<u4").tobytes(), b"".join(ids)


def loaded(path: str, pattern: str) -> Pieces:
    """The worker's own copy, made once; workers read the vocabulary file themselves."""
    return once(("pieces", path, pattern), lambda: Pieces(path, pattern))


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk text): chunks start every ``chunk`` characters and reach ``overlap`` into the next."""
    return [(s, text[s : s + chunk + overlap]) for s in range(0, max(len(text), 1), chunk)]


def stitch(chunks: list[tuple[int, str, list[int]]], pattern) -> list[tuple]:
    """The text as segments of right pieces, from what its chunks found on their own.

    ``chunks``: (origin, text, starts of pre-tokens) in order. A segment is (chunk, first piece, end
    piece), or (None, pre-tokens, None) for text between chunks that never met.
    """
    segments: list[tuple] = []
    k = first = 0
    while True:
        origin, text, starts = chunks[k]
        if k + 1 == len(chunks):
            return [*segments, (k, first, len(starts))]
        after = chunks[k + 1]
        certain = bisect.bisect_right(starts, origin + len(text) - MARGIN)
        there = set(after[2])
        meet = next((i for i in range(max(first, bisect.bisect_left(starts, after[0])), certain) if starts[i] in there), None)
        if meet is not None:
            segments.append((k, first, meet))
            k, first = k + 1, bisect.bisect_left(after[2], starts[meet])
            continue
        last = max(first, certain - 1)
        segments.append((k, first, last))
        k, first, between = _bridge(chunks, k, starts[last], pattern)
        segments.append((None, between, None))
        if k is None:
            return segments


def _bridge(chunks: list[tuple[int, str, list[int]]], k: int, begin: int, pattern) -> tuple:
    """Goes on from a certain start until a later chunk starts a pre-token there too.

    Returns (chunk, its piece, the pre-tokens between); no chunk if the text ended first.
    """
    known, upto, at, between = join(chunks[k : k + 2], begin), k + 1, begin, []
    while True:
        m = pattern.match(known, at - begin)
        while upto + 1 < len(chunks) and (m is None or m.end() > len(known) - MARGIN):
            upto = min(len(chunks) - 1, upto + max(1, upto - k))  # twice as much each time
            known = join(chunks[k : upto + 1], begin)
            m = pattern.match(known, at - begin)
        end = m.end() if m else len(known)
        between.append(known[at - begin : end])
        at = begin + end
        if end >= len(known):
            return None, None, between
        for j in range(upto, k, -1):
            origin, _, starts = chunks[j]
            if origin <= at:
                i = bisect.bisect_left(starts, at)
                if i < len(starts) and starts[i] == at:
                    return j, i, between
                break


def join(chunks: list[tuple[int, str, list[int]]], start: int) -> str:
    """The text from ``start`` to the end of the last of these chunks."""
    parts, at = [], start
    for origin, text, _ in chunks:
        if origin + len(text) > at:
            parts.append(text[at - origin :])
            at = origin + len(text)
    return "".join(parts)


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    digested: bool = False,
) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian 32-bit integers) in place of the text.

    ``digested`` adds what ``digests`` does in the same pass, so a task has one Python worker and not two.

    Texts of one chunk are encoded where they lie. Longer ones are cut, their chunks are dealt over
    all tasks and encoded there, and come together again per text to be stitched. Only long texts
    are shuffled, copies of one once. An input column named ``ids`` is replaced.
    """
    fields = [T.StructField("ids", T.BinaryType()), *(DIGESTS if digested else [])]
    new = [f.name for f in fields]
    kept = [c for c in docs.columns if c not in (text, *new)]
    size = F.coalesce(F.length(text), F.lit(0))

    def short(part):
        own = loaded(path, pattern)
        ids = [own.encode(t) if t else b"" for t in part.column(text).to_pylist()]
        return [pa.array(ids, pa.binary()), *(_digests(path, ids) if digested else [])]

    whole = add_columns(docs.select(*kept, text).where(size <= chunk_chars), text, fields, short)
    long = docs.where(size > chunk_chars)
    name = F.sha2(F.col(text), 256)
    cut_up = long.select(name.alias("name"), F.col(text).alias("text")).mapInArrow(_cutter(chunk_chars, overlap_chars), CUT)
    # dealing out by (name, number) also leaves one of each repeated chunk
    dealt = cut_up.dropDuplicates(["name", "number"])
    encoded = dealt.mapInArrow(_chunk_encoder(path, pattern), ENCODED)
    joined = encoded.groupBy("name").applyInArrow(_stitcher(path, pattern, digested), T.StructType([T.StructField("name", T.StringType()), *fields]))
    rest = long.select(F.struct(*kept).alias("rest"), name.alias("name"))
    return whole.unionByName(rest.join(joined, "name").select("rest.*", *new))


CUT = "name string, number long, origin long, chunk string"
ENCODED = "name string, number long, origin long, chunk string, starts binary, counts binary, ids binary"


def _cutter(chunk_chars: int, overlap_chars: int):
    def run(batches):
        for batch in batches:
            for name, whole in zip(batch.column("name").to_pylist(), batch.column("text"), strict=True):
                cuts = cut(whole.as_py(), chunk_chars, overlap_chars)
                columns = [[name] * len(cuts), list(range(len(cuts))), [o for o, _ in cuts], [c for _, c in cuts]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "number", "origin", "chunk"])

    return run


def _chunk_encoder(path: str, pattern: str):
    def run(batches):
        own = loaded(path, pattern)
        for batch in batches:
            for part in pieces(batch, "chunk"):
                found = [own.pieces(chunk, origin) for chunk, origin in zip(part.column("chunk").to_pylist(), part.column("origin").to_pylist(), strict=True)]
                arrays = [pa.array([f[i] for f in found], pa.binary()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, "starts", "counts", "ids"])

    return run


def _stitcher(path: str, pattern: str, digested: bool):
    def run(group: pa.Table) -> pa.Table:
        own = loaded(path, pattern)
        rows = group.sort_by("number").to_pylist()
        chunks = [(r["origin"], r["chunk"], np.frombuffer(r["starts"], dtype="<i8").tolist()) for r in rows]
        ends = [np.concatenate([[0], np.cumsum(np.frombuffer(r["counts"], dtype="<u4"), dtype=np.int64)]) * 4 for r in rows]
        out = []
        for k, a, b in stitch(chunks, own.pattern):
            if k is None:
                out.extend(own.ids_of(p) for p in a)
            else:
                out.append(rows[k]["ids"][ends[k][a] : ends[k][b]])
        ids = [b"".join(out)]
        arrays = [pa.array([rows[0]["name"]], pa.string()), pa.array(ids, pa.binary()), *(_digests(path, ids) if digested else [])]
        return pa.Table.from_arrays(arrays, names=["name", "ids", *([f.name for f in DIGESTS] if digested else [])])

    return run


DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def _digests(path: str, encoded: list[bytes | None]) -> list[pa.Array]:
    table, names = _tables(path)
    counts, ids_hex, bytes_hex = [], [], []
    for raw in encoded:
        own = np.frombuffer(raw or b"", dtype="<u4").tolist()
        counts.append(len(own))
        ids_hex.append(hashlib.sha256(b" ".join([names[i] for i in own])).hexdigest())
        bytes_hex.append(hashlib.sha256(b"".join([table[i] for i in own])).hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(bytes_hex, pa.string())]


def digests(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the count and digests of its ids and of the bytes they decode to."""
    return add_columns(encoded, ids, DIGESTS, lambda part: _digests(path, as_bytes(part.column(ids))))


def _tables(path: str) -> tuple[list[bytes], list[bytes]]:
    """By id: its bytes and its decimal digits."""

    def make():
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        return table, [b"%d" % i for i in range(len(table))]

    return once(("bytes", path), make)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "text_bytes") -> DataFrame:
    """``encoded`` with the raw bytes of its ids in column ``out``; ids outside the ranks fail the job."""

    def compute(part):
        table, _ = _tables(path)
        return [pa.array([b"".join([table[i] for i in np.frombuffer(raw or b"", dtype="<u4").tolist()]) for raw in as_bytes(part.column(ids))], pa.binary())]

    return add_columns(encoded, ids, [T.StructField(out, T.BinaryType())], compute)
