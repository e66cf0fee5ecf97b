"""Near-duplicates by ProbMinHash, banding, verification by the exact similarity, and components.

A text is a set of five-word shingles weighted by ``1 + ln(occurrences)``; texts are linked if the
probability Jaccard similarity of the weights is 0.8 or more, and classes are what links connect.

Signatures: each shingle is a Poisson process whose rate is its weight. Every arrival takes a random
register, the earliest arrival of a register stays, and a shingle ends once its arrivals come later
than all registers hold. Two texts agree in a register with the probability Jaccard similarity.

Exact copies are one text (node) from the start. Texts that share a band are not paired with each
other but with the band's pivot, the one that meets the most texts over all bands, so a group of n
texts costs n comparisons, and most links show there.

Bands whose texts are still in different classes are settled exactly, inside tasks. Their texts are
gathered into families by the pivot that each meets most often, so that a family of near texts travels
once and not once a band; families are cut into blocks of bounded texts and shingles, and every two
blocks of a family meet once. Texts of different families that share a band meet by that band. A task
counts the shared shingles of all its pairs by matrix products and returns no pairs but a forest of the
links between classes, so rows grow with the texts. The comparisons of a family grow with the square of its
size where its texts are near each other and yet not linked.

Defined cases: texts that are null or have no word are alone in their class; texts of fewer than five
words have one shingle of all their words; repeated rows are copies; classes are named by their least
``doc_id`` (nulls only if there is no other); an empty table gives an empty result.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sproutscope.llm.batches import bounded_batches, pieces
from sproutscope.session import stage

SHINGLE = 5
SIMILARITY = 0.8
#: Room for rounding in a sum of similarities.
ROUNDING = 1e-9
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Registers in which a pair of similarity 0.8 agrees but for a chance of 1e-8.
AGREE = 75
#: Texts and shingles that are compared in one piece; a larger group is several.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
#: Shingles of a matrix product at a time.
STRIP = 4096

_U64 = np.uint64
_STEP = [_U64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(SHINGLE + 1)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each 64-bit value."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, weights)."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64), np.empty(0)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    found = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        found += hashes[k : k + n] * _STEP[k]
    keys, counts = np.unique(mixed(found), return_counts=True)
    return keys, 1 + np.log(counts)


def signatures(owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The winning shingles of ``n`` texts: shingle ``keys[i]`` of text ``owner[i]`` has ``weights[i]``."""
    best = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, dtype=np.uint64)
    last = np.full(n, np.inf)
    time = np.zeros(len(keys))
    arrival = 0
    while len(keys):
        draws = 1 if len(keys) > 50_000 else 8
        for _ in range(draws):
            arrival += 1
            random = mixed(keys + _U64(arrival * int(_STEP[0]) & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((random >> _U64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / weights
            register = owner * registers + (mixed(random) % _U64(registers)).astype(np.int64)
            np.minimum.at(best, register, time)
            won = best[register] == time
            winner[register[won]] = keys[won]
        texts = np.unique(owner)
        last[texts] = best.reshape(n, registers)[texts].max(axis=1)
        active = time < last[owner]
        owner, keys, weights, time = owner[active], keys[active], weights[active], time[active]
    return winner.reshape(n, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A hash per band of each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP[1], (len(signature), 1))
    for k in range(ROWS):
        out = mixed(out * _STEP[2] + parts[:, :, k])
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard similarity of two weighted sets."""
    keys = np.union1d(a[0], b[0])
    if not len(keys):
        return 0.0
    wa, wb = np.zeros(len(keys)), np.zeros(len(keys))
    wa[np.searchsorted(keys, a[0])] = a[1]
    wb[np.searchsorted(keys, b[0])] = b[1]
    both = (wa > 0) & (wb > 0)
    if not both.any():
        return 0.0
    ratio = np.where(wb > 0, wa / np.where(wb > 0, wb, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ranked = ratio[order]
    below = np.concatenate([[0], np.cumsum(wb[order])])
    above = wa.sum() - np.concatenate([[0], np.cumsum(wa[order])])
    at = np.searchsorted(ranked, ratio[both], side="left")
    return float((1 / (above[at] / wa[both] + below[at] / wb[both])).sum())


def node_of(text: Column) -> Column:
    """The name of a text: equal texts have the same."""
    return F.unhex(F.md5(text))


PROFILE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType(), False)),
        T.StructField("signature", T.BinaryType()),
    ]
)


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands, signature) of each row; no bands where a text has no word.

    ``signature`` has a byte of each register, so it agrees wherever the register does.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                sizes = np.fromiter((len(k) for k, _ in sets), dtype=np.int64, count=len(sets))
                owner = np.repeat(np.arange(len(sets)), sizes)
                found = signatures(owner, np.concatenate([k for k, _ in sets]), np.concatenate([w for _, w in sets]), len(sets))
                keys = band_keys(found).view(np.int64)
                bands = [k if s else [] for k, s in zip(keys, sizes, strict=True)]
                short = pa.array([x.tobytes() for x in mixed(found).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(bands, pa.list_(pa.int64())), short], names=PROFILE.names)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of(F.col("text")).alias("node"), "text")
    return rows.mapInArrow(run, PROFILE)


def _pivots(members: DataFrame, key: str, rank: Column) -> DataFrame:
    """(pivot, node) of each group of ``members``, without the pivot itself."""
    chosen = members.groupBy(key).agg(F.max(F.struct(rank.alias("rank"), "node"))["node"].alias("pivot"))
    return members.join(chosen, key).where("pivot != node").select("pivot", "node").distinct()


def band_members(profiles: DataFrame) -> DataFrame:
    """(band, node, n) of the texts of every band that several share."""
    bands = profiles.where(F.size("bands") > 0).select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    return stage(bands.join(shared, "band"), "band-members")


def first_pairs(members: DataFrame) -> DataFrame:
    """(pivot, node): each text with the pivots of its bands."""
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    return _pivots(members.join(meets, "node"), "band", F.col("meets"))


def _agreeing(signature: np.ndarray, kind: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different kinds whose signatures agree; of two blocks, a row of each."""
    two = block.min() != block.max()
    order = np.lexsort((kind, block))
    left = order[block[order] == block.min()]
    right = order[block[order] == block.max()]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    found = []
    for at in range(0, len(left), 32):
        a = left[at : at + 32]
        b = right if two else right[place[right] > place[a[0]]]
        if kind[a[0]] == kind[a[-1]]:  # rows of a block are in order of their kinds
            b = b[kind[b] != kind[a[0]]]
        if len(b):
            near = np.count_nonzero(signature[a][:, None] == signature[b][None], axis=2) >= AGREE
            near &= (kind[a][:, None] != kind[b][None]) & (place[a][:, None] < place[b][None])
            i, j = np.nonzero(near)
            found.append((a[i], b[j]))
    if not found:
        return order[:0], order[:0]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _incidence(rows: np.ndarray, columns: np.ndarray, n: int, first: int, end: int) -> np.ndarray:
    """A 0/1 matrix of the entries whose column is in ``first..end``; entries are in order of their columns."""
    low, high = np.searchsorted(columns, [first, end])
    out = np.zeros((n, end - first), dtype=np.float32)
    out[rows[low:high], columns[low:high] - first] = 1
    return out


def shared_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left has in common with each one on the right."""
    sides, known = [], []
    for sets in (left, right):
        keys = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        sides.append((np.repeat(np.arange(len(sets)), [len(k) for k in sets]), keys))
        known.append(np.unique(keys))
    both = np.intersect1d(*known, assume_unique=True)
    entries = []
    for rows, keys in sides:
        at = np.searchsorted(both, keys)
        has = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == keys) if len(both) else np.zeros(len(keys), bool)
        order = np.argsort(at[has], kind="stable")
        entries.append((rows[has][order], at[has][order]))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, len(both), STRIP):
        end = min(first + STRIP, len(both))
        out += _incidence(*entries[0], len(left), first, end) @ _incidence(*entries[1], len(right), first, end).T
    return out


def _forest(kind: np.ndarray, pairs) -> list[tuple[int, int]]:
    """Those of ``pairs`` (left, right, test) that join two kinds not yet joined; a test is made only then."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    chosen = []
    for i, j, test in pairs:
        a, b = find(int(kind[i])), find(int(kind[j]))
        if a != b and (test is None or test(i, j)):
            parent[a] = b
            chosen.append((i, j))
    return chosen


REST = "node binary, class binary, family binary, signature binary, keys binary, weights binary, n_keys long"


def _with_shingles(rest: DataFrame) -> DataFrame:
    """Texts of the rest as sets: ``weights`` is null where all are 1."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                keys = pa.array([k.tobytes() for k, _ in sets], pa.binary())
                weights = pa.array([None if (w == 1).all() else w.tobytes() for _, w in sets], pa.binary())
                sizes = pa.array([len(k) for k, _ in sets], pa.int64())
                columns = [part.column(c) for c in ("node", "class", "family", "signature")] + [keys, weights, sizes]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in REST.split(", ")])

    return rest.select("node", "class", "family", "signature", "text").mapInArrow(run, REST)


def _links(table: pa.Table) -> pa.Table:
    """A forest of the links between classes among the pairs of a block, or of a row of one with a row of another."""
    table = table.combine_chunks()
    column = lambda c: table.column(c).to_pylist()
    nodes, keys, weights = column("node"), [np.frombuffer(k, np.uint64) for k in column("keys")], column("weights")
    kind = table.column("class").dictionary_encode().combine_chunks().indices.to_numpy()
    family = table.column("family").dictionary_encode().combine_chunks().indices.to_numpy()
    block, across = table.column("block").to_numpy(), column("across")[0]
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    flat = np.array([w is None for w in weights])
    sets = lambda k: (keys[k], np.ones(len(keys[k])) if weights[k] is None else np.frombuffer(weights[k]))
    wanted = lambda i, j: (kind[i] != kind[j]) & ((family[i] != family[j]) | (not across))
    # where no shingle is repeated the similarity is Jaccard's, and exact in whole numbers: 9 * shared >= 4 * (sum of sizes)
    a, b = left[flat[left]], right[flat[right]]
    size = np.array([len(k) for k in keys], dtype=np.float32)
    near = 9 * shared_shingles([keys[i] for i in a], [keys[j] for j in b]) >= 4 * (size[a][:, None] + size[b][None])
    near &= wanted(a[:, None], b[None])
    i, j = np.nonzero(near)
    i, j = a[i], b[j]
    _, first = np.unique(kind[i].astype(np.int64) * (len(kind) + 1) + kind[j], return_index=True)
    i, j = i[first], j[first]

    def linked():
        for at in range(0, len(i), STRIP):  # few at a time, as there may be as many as the block has pairs
            yield from ((x, y, None) for x, y in zip(i[at : at + STRIP].tolist(), j[at : at + STRIP].tolist(), strict=True))

    pairs = linked()
    if not flat.all():
        signature = np.frombuffer(b"".join(column("signature")), dtype=np.uint8).reshape(len(nodes), REGISTERS)
        test = lambda x, y: similarity(sets(x), sets(y)) >= SIMILARITY - ROUNDING
        agreeing = zip(*_agreeing(signature, kind, block), strict=True)
        pairs = itertools.chain(pairs, ((x, y, test) for x, y in agreeing if wanted(x, y) and not (flat[x] and flat[y])))
    chosen = _forest(kind, pairs)
    return pa.table({"pivot": pa.array([nodes[x] for x, _ in chosen], pa.binary()), "node": pa.array([nodes[y] for _, y in chosen], pa.binary())})


def _blocks_of(n: Column, n_keys: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK, n_keys / BLOCK_SHINGLES))


def rest_links(members: DataFrame, profiles: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(pivot, node): links that join all classes which share a band and should be one."""
    named = members.join(labels, "node", "left").select("band", "n", "node", F.coalesce("component", "node").alias("class"))
    named = stage(named, "band-classes")
    mixed_bands = named.groupBy("band").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a != b").select("band")
    rest = stage(named.join(mixed_bands, "band"), "rest-members")
    # a text's family: the text that most often is the pivot of its bands, and so on from there
    meets = rest.groupBy("node").agg(F.sum("n").alias("meets"))
    ranked = rest.join(meets, "node")
    pivots = ranked.groupBy("band").agg(F.max(F.struct("meets", "node"))["node"].alias("pivot"))
    led = ranked.join(pivots, "band").groupBy("node", "pivot").agg(F.count("*").alias("times"))
    leaders = stage(led.groupBy("node").agg(F.max(F.struct("times", "pivot"))["pivot"].alias("pivot")), "leaders")
    families = components(leaders.where("pivot != node"))
    nodes = rest.groupBy("node").agg(F.first("class").alias("class"))
    placed = nodes.join(families.withColumnRenamed("component", "family"), "node", "left").withColumn("family", F.coalesce("family", "node"))
    signed = profiles.where(F.size("bands") > 0).select("node", "signature").dropDuplicates(["node"])
    sets = stage(_with_shingles(placed.join(signed, "node").join(texts, "node")), "rest-sets")
    # inside a family
    sizes = [F.count("*").alias("n"), F.sum("n_keys").alias("n_keys"), F.min("class").alias("a"), F.max("class").alias("b")]
    own = sets.groupBy("family").agg(*sizes).where("a != b").select("family", F.hex("family").alias("group"), _blocks_of(F.col("n"), F.col("n_keys")).alias("blocks"))
    inside = sets.join(own, "family").withColumn("across", F.lit(False))
    # between families, by the bands that have several
    described = rest.select("band", "node").join(sets.select("node", "family", "n_keys"), "node")
    sizes = [F.count("*").alias("n"), F.sum("n_keys").alias("n_keys"), F.min("family").alias("a"), F.max("family").alias("b")]
    shared = described.groupBy("band").agg(*sizes).where("a != b").select("band", F.col("band").cast("string").alias("group"), _blocks_of(F.col("n"), F.col("n_keys")).alias("blocks"))
    between = rest.select("band", "node").join(shared, "band").join(sets, "node").withColumn("across", F.lit(True))
    columns = ["group", "blocks", "across", "node", "class", "family", "signature", "keys", "weights"]
    rows = inside.select(*columns).unionByName(between.select(*columns)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # every two blocks of a group meet once
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    return rows.groupBy("group", "low", "high").applyInArrow(_links, "pivot binary, node binary").distinct()


VERIFIED = T.StructType(
    [
        T.StructField("pivot", T.BinaryType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs with their exact similarity."""

    def run(batches):
        known = (None, None)
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for pivot, node, pivot_text, text in zip(*(part.column(c).to_pylist() for c in ("pivot", "node", "pivot_text", "text")), strict=True):
                    if known[0] != pivot:
                        known = pivot, shingles(pivot_text)
                    rows.append((pivot, node, similarity(known[1], shingles(text))))
                kinds = [pa.binary(), pa.binary(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=VERIFIED.names)

    with_text = pairs.join(texts, "node")
    pivot_texts = texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text"))
    return with_text.join(pivot_texts, "pivot").select("pivot", "node", "pivot_text", "text").mapInArrow(run, VERIFIED)


def linked_classes(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(node, component) of all texts that have a link."""
    members = band_members(profiles)
    pairs = stage(first_pairs(members), "pairs")
    texts = docs.select(node_of(F.col("text")).alias("node"), "text")
    wanted = pairs.select("node").union(pairs.select("pivot")).distinct()
    # their number grows with the corpus, so they are never broadcast
    needed = stage(texts.join(wanted.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "pair-texts")
    verified = stage(verify(pairs, needed), "verified")
    found = verified.where(F.col("similarity") >= SIMILARITY - ROUNDING).select("pivot", "node")
    labels = components(found)
    # every text of a shared band has been a pivot or met one, so all texts are there
    more = stage(rest_links(members, profiles, needed, labels), "rest-links")
    return labels if more.isEmpty() else components(found.unionByName(more))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge: the least node it is connected to.

    Each round takes the least label around a node and then that label's own label, so the rounds
    grow with the logarithm of the longest path.
    """
    both = stage(edges.select(F.col("pivot").alias("a"), F.col("node").alias("b")).union(edges.select("node", "pivot")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("beyond"))
        after = stage(nearer.join(jump, "near").select("node", "before", F.least("near", "beyond").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("component != before").isEmpty():
            return labels


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, node, class_id, n_in_class, first.

    ``first`` is true for rows of the one text and doc_id that stand for the class. A text without a
    word has its own doc_id as class.
    """
    profiles = stage(profile(docs), "profiles")
    found = linked_classes(docs, profiles)
    rows = profiles.select("doc_id", "node", (F.size("bands") > 0).alias("has_words"))
    named = stage(rows.where("has_words").join(found, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("class")), "members")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))
    # staged, so that the join below can split a class that holds very many rows
    totals = stage(named.groupBy("class").agg(least.alias("least"), F.count("*").alias("n_in_class")), "classes-named")
    joined = named.join(totals, "class").select(
        "doc_id",
        "node",
        F.col("least.doc_id").alias("class_id"),
        "n_in_class",
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("node") == F.col("least.node"))).alias("first"),
    )
    alone = rows.where(~F.col("has_words")).select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_in_class"), F.lit(True).alias("first"))
    return joined.unionByName(alone)


def filter_documents(docs: DataFrame) -> DataFrame:
    """One document of each class, the one of the least ``doc_id``; its columns are unchanged."""
    found = stage(classes(docs.select("doc_id", "text")), "classes")
    winners = found.where("first AND node IS NOT NULL").groupBy("doc_id", "node").agg(F.max("n_in_class").alias("n"), F.count("*").alias("rows"))
    winners = stage(winners, "winners")
    row = F.struct(*docs.columns).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("id"), node_of(F.col("text")).alias("name"))
    same = keyed["id"].eqNullSafe(winners["doc_id"]) & (keyed["name"] == winners["node"])
    kept = keyed.join(winners, same, "left_semi")
    if not winners.where("rows > 1 AND n > 1").isEmpty():  # rows that repeat both id and text
        kept = kept.dropDuplicates(["id", "name"])
    return kept.select("row.*").unionByName(docs.where("text IS NULL"))
