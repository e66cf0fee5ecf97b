"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt out by ranges of ``doc_id``, tokenised in that order inside each task, and
written as one row each: the id, the part, the offset inside the part, the count and the ids. The
stripes of a file can be read in parallel; a lookup of ids skips stripes and row groups by the
index and the Bloom filter. Global offsets come from the parts' totals, one row per part.

Defined cases: a null or empty text is the end id alone; null ids come first; rows with equal ids are
all kept, in the order of their texts; an empty table gives empty files; other columns aren't stored.
"""

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sproutscope.llm.batches import BATCH_BYTES, add_columns, bounded_batches, once, pieces
from sproutscope.llm.byte_bpe import Pieces
from sproutscope.session import new_path

END_ID = 2
#: Distinct words whose ids a worker remembers.
REMEMBERED = 800_000
#: Rows between two entries of the row index, and so the least that a lookup reads.
INDEX_STRIDE = 1000
STRIPE_BYTES = 16 << 20
BLOOM_FPP = 0.01

STORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)


#: A word, perhaps with its space, the marks after it, and perhaps a next line's first word with its own:
#: letters, marks and a single line break are pieces apart, so they need not make new words together.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[.,;:!?#$%&*|<>]+"
_MARK_CHARS = _MARKS[1:-2]
_LETTER_CHARS = " " + "".join(chr(c) for c in range(256) if re.match(_LETTERS, chr(c)))
_PARTS = rf"\A(?P<a> ?{_LETTERS})(?P<b>{_MARKS})?(?P<c>\n)(?P<d>{_LETTERS})(?P<e>{_MARKS})?\z"
#: New pieces that go through the tokenizer as one text.
_TOGETHER = 4096


def _runs(values: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs ``at`` one after another, their lengths), where ``values`` is cut into runs of ``lengths``."""
    starts, taken = (np.cumsum(lengths) - lengths)[at], lengths[at]
    upto = np.cumsum(taken)
    return values[np.repeat(starts - upto + taken, taken) + np.arange(upto[-1] if len(upto) else 0)], taken


class Words:
    """Ids of texts by a tokenizer file; each distinct word goes through the tokenizer once.

    A byte-level tokenizer without a normaliser always starts a piece at a space before a character
    that isn't white space, so the words between such spaces can be encoded apart. Words are cut,
    numbered and looked up in Arrow. New ones are encoded many at a time as one text and told apart by the
    bytes of their tokens. Any other kind of tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # strings of special tokens in a text are ordinary text
        self.tokenizer.no_truncation()
        pre = self.tokenizer.pre_tokenizer
        self.by_word = self.tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)  # byte-level tokens have a character for each byte
        self.forget()

    def forget(self) -> None:
        self.known, self.values, self.lengths = pa.array([], pa.string()), np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each) of words that surely are cut apart where ``before`` stands before each."""
        values, lengths = [], []
        for k in range(0, len(words), _TOGETHER):
            group = words.slice(k, _TOGETHER)
            texts = group.to_pylist()
            ids = np.frombuffer(self._encoded([before + before.join(texts)])[0], dtype="<i4")
            ends = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
            sizes = pc.binary_length(group).to_numpy().astype(np.int64) + len(before)
            stops = np.cumsum(sizes)
            begins = stops - sizes + len(before)
            first, stop = np.searchsorted(ends, begins), np.searchsorted(ends, stops)
            if ends[-1] == stops[-1] and (ends[first] == begins).all() and (ends[stop] == stops).all():
                inside = np.zeros(len(ids) + 1, dtype=np.int64)
                np.add.at(inside, first, 1)
                np.add.at(inside, stop, -1)
                values.append(ids[np.cumsum(inside)[:-1] > 0])
                lengths.append(stop - first)
            else:
                raw = self._encoded(texts)
                values.append(np.frombuffer(b"".join(raw), dtype="<i4"))
                lengths.append(np.array([len(r) // 4 for r in raw], dtype=np.int64))
        return np.concatenate([np.empty(0, dtype=np.int32), *values]), np.concatenate([np.empty(0, dtype=np.int64), *lengths])

    def _learn(self, new: pa.Array) -> np.ndarray:
        """The numbers that the words ``new`` get."""
        second = pc.utf8_slice_codeunits(new, 1, 2)
        spaced = pc.and_(pc.starts_with(new, " "), pc.invert(pc.or_(pc.utf8_is_space(second), pc.equal(second, ""))))
        letters = pc.match_substring_regex(new, rf"\A{_LETTERS}\z")
        other = new.filter(pc.invert(pc.or_(spaced, letters)))
        raw = self._encoded(other.to_pylist())
        kinds = np.where(spaced.to_numpy(zero_copy_only=False), 0, np.where(letters.to_numpy(zero_copy_only=False), 1, 2))
        numbers = np.empty(len(new), dtype=np.int64)
        numbers[np.argsort(kinds, kind="stable")] = len(self.known) + np.arange(len(new))
        spaced, letters = new.filter(spaced), new.filter(letters)
        found = [self._together(spaced, ""), self._together(letters, "\n")]
        self.known = pa.concat_arrays([self.known, spaced, letters, other])
        self.values = np.concatenate([self.values, *(v for v, _ in found), np.frombuffer(b"".join(raw), dtype="<i4")])
        self.lengths = np.concatenate([self.lengths, *(n for _, n in found), np.array([len(r) // 4 for r in raw], dtype=np.int64)])
        return numbers

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """The numbers of distinct parts among the known ones; new ones are learnt.

        The known parts are looked up among the few at hand, as Arrow hashes all it looks up in at each call.
        """
        at = np.full(len(parts), -1, dtype=np.int64)
        hits = pc.index_in(self.known, value_set=parts)
        has = np.flatnonzero(hits.is_valid().to_numpy(zero_copy_only=False))
        at[hits.fill_null(0).to_numpy()[has]] = has
        new = np.flatnonzero(at < 0)
        if len(self.known) and len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = np.arange(len(parts))
        if len(new):
            at[new] = self._learn(parts.take(pa.array(new)))
        return at

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each) of words, by way of their parts."""
        marked, empty = pc.match_substring_regex(words, rf"\A ?{_LETTERS}{_MARKS}\z"), pa.array([""] * len(words), pa.string())
        stem = pc.if_else(marked, pc.utf8_rtrim(words, _MARK_CHARS), words)
        columns = [stem, pc.if_else(marked, pc.utf8_ltrim(words, _LETTER_CHARS), ""), empty, empty, empty]
        lines = pc.match_substring_regex(words, _PARTS)
        matched = pc.extract_regex(words.filter(lines), _PARTS)
        columns = [pc.replace_with_mask(c, lines, pc.struct_field(matched, name)) for c, name in zip(columns, "abcde", strict=True)]
        coded = pa.concat_arrays(columns).dictionary_encode()
        places = self._numbers(coded.dictionary)[coded.indices.to_numpy()].reshape(len(columns), len(words)).T
        values, lengths = _runs(self.values, self.lengths, places.ravel())
        return values, lengths.reshape(places.shape).sum(axis=1)

    def column(self, texts: pa.Array, ended: list[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's end), every text followed by the ids ``ended``."""
        end = np.array(ended, dtype=np.int32)
        if not self.by_word:
            raw = [r + end.tobytes() for r in self._encoded([t or "" for t in texts.to_pylist()])]
            return np.frombuffer(b"".join(raw), dtype="<i4"), np.cumsum([len(r) // 4 for r in raw], dtype=np.int64)
        cut = pc.split_pattern(pc.fill_null(texts, ""), " ")
        starts, coded = cut.offsets.to_numpy().astype(np.int64), cut.values.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        rows, firsts = np.repeat(np.arange(len(texts)), np.diff(starts)), starts[:-1]
        begins = pc.utf8_slice_codeunits(distinct, 0, 1)
        unsure = pc.or_(pc.utf8_is_space(begins), pc.equal(begins, "")).to_numpy(zero_copy_only=False)[codes]
        unsure[firsts] = False
        whole = np.unique(rows[unsure])  # texts that plain spaces don't cut rightly
        apart = [(r, w) for r in whole.tolist() for w in _cut(texts[r].as_py())]
        later = np.ones(len(rows), dtype=bool)
        later[firsts] = False
        later &= ~np.isin(rows, whole)
        begin = np.setdiff1d(np.arange(len(texts)), whole)
        used = np.zeros(len(distinct), dtype=bool)
        used[codes[later]] = True
        words = pc.binary_join_element_wise(" ", distinct.filter(pa.array(used)), "")
        plain = len(words)
        words = pa.concat_arrays([words, cut.values.take(pa.array(firsts[begin])), pa.array([w for _, w in apart], pa.string())])
        values, lengths = self._ids_of(words)
        owners = np.concatenate([begin, rows[later], np.array([r for r, _ in apart], dtype=np.int64), np.arange(len(texts))])
        places = np.concatenate(
            [
                plain + np.arange(len(begin)),
                (np.cumsum(used) - 1)[codes[later]],
                plain + len(begin) + np.arange(len(apart)),
                np.full(len(texts), len(words)),
            ]
        )[np.argsort(owners, kind="stable")]
        values, taken = _runs(np.concatenate([values, end]), np.concatenate([lengths, [len(end)]]), places)
        upto = np.cumsum(taken)
        return values, upto[np.cumsum(np.bincount(owners, minlength=len(texts))) - 1]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        ids, ends = self.column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=False)]


def _cut(text: str) -> list[str]:
    first, *rest = Pieces.words(text)
    return [first, *[" " + w for w in rest]]


def loaded(path: str) -> Words:
    return once(("words", path), lambda: Words(path))


def write(docs: DataFrame, tokenizer_path: str, to: str, end_id: int = END_ID) -> None:
    """Tokenises ``docs`` (doc_id, text) and writes the files, ascending by ``doc_id`` over the parts."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        own, part, start = loaded(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in pieces(batch, "text", BATCH_BYTES):
                values, ends = own.column(rows.column("text"), [end_id])
                offsets = np.concatenate([[0], ends])
                counts = np.diff(offsets)
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                columns = [rows.column("doc_id"), pa.array(np.full(len(counts), part, dtype=np.int32)), pa.array(start + offsets[:-1]), pa.array(counts), ids]
                start += int(offsets[-1])
                yield pa.RecordBatch.from_arrays(columns, names=STORED.names)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    (
        ordered.mapInArrow(run, STORED)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(INDEX_STRIDE))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .orc(to)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; a filter on ``doc_id`` reaches the files' indexes."""
    return spark.read.schema(STORED).orc(path)


def part_starts(stored: DataFrame) -> DataFrame:
    """(part, base): ids before each part; one row per part, from two narrow columns."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))


def with_starts(stored: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` (by default the stored ones) with ``start``, the ids of all documents before."""
    rows = stored if rows is None else rows
    bases = part_starts(stored)
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def checksums(stored: DataFrame) -> DataFrame:
    """Stored rows with ``ids_crc32`` (of little-endian 32-bit ids) and ``n_tokens`` counted from the ids."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]

    def compute(rows):
        ids = rows.column("ids")
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return [pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())]

    return add_columns(stored, "ids", fields, compute)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files into the shared folder and returns (doc_id, start, n_tokens, ids_crc32) from them."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write(docs, tokenizer_path, path, end_id)
    stored = read(spark, path)
    return with_starts(stored, checksums(stored)).select("doc_id", "start", "n_tokens", "ids_crc32")
