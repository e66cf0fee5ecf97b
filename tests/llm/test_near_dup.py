import itertools

import numpy as np

from sproutscope.llm import near_dup as n


def brute_force_classes(pairs):
    """Classes over distinct texts by all-pairs similarity."""
    texts = sorted({t for _, t in pairs if t and t.split()})
    sets = [n.shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if n.similarity(sets[i], sets[j]) >= n.SIMILARITY:
            parent[find(i)] = find(j)
    label = {t: find(k) for k, t in enumerate(texts)}
    least = {}
    for i, t in pairs:
        if t in label and i is not None:
            least[label[t]] = min(i, least.get(label[t], i))
    return {(i, t): least.get(label[t]) if t in label else i for i, t in pairs}


def edited(text, seed, changes):
    words, rng = text.split(), np.random.default_rng(seed)
    for k in range(changes):
        words[rng.integers(len(words))] = f"new{seed}x{k}"
    return " ".join(words)


def test_similarity_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a = np.unique(rng.integers(0, 12, 8).astype(np.uint64))
        b = np.unique(rng.integers(0, 12, 8).astype(np.uint64))
        wa, wb = rng.integers(1, 5, len(a)).astype(float), rng.integers(1, 5, len(b)).astype(float)
        x, y = dict(zip(a, wa, strict=True)), dict(zip(b, wb, strict=True))
        want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
        assert abs(n.similarity((a, wa), (b, wb)) - want) < 1e-9


def test_signatures_estimate_the_similarity(prose):
    base = prose(1, 200)
    errors = []
    for k in range(40):
        sets = [n.shingles(base), n.shingles(edited(base, k, k % 20))]
        owner = np.repeat([0, 1], [len(s[0]) for s in sets])
        found = n.signatures(owner, np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), 2)
        errors.append((found[0] == found[1]).mean() - n.similarity(*sets))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_signatures_do_not_depend_on_the_batch(prose):
    sets = [n.shingles(prose(k, 30 + k)) for k in range(5)]
    alone = [n.signatures(np.zeros(len(k), int), k, w, 1)[0] for k, w in sets]
    owner = np.repeat(np.arange(5), [len(k) for k, _ in sets])
    together = n.signatures(owner, np.concatenate([k for k, _ in sets]), np.concatenate([w for _, w in sets]), 5)
    assert (np.stack(alone) == together).all()


def test_classes_by_brute_force(docs, prose):
    pairs = [(1000 + k, prose(k, 60)) for k in range(20)]
    base = prose("base", 150)
    # a group around one text, many of them not similar enough to each other or to it
    pairs += [(k, edited(base, k, k % 7)) for k in range(10, 90)]
    pairs += [(200 + k, base) for k in range(5)]
    # a chain: neighbours are similar, ends aren't
    words = prose("chain", 160).split()
    pairs += [(300 + k, " ".join(words[10 * k : 10 * k + 100])) for k in range(7)]
    pairs += [(400, None), (401, ""), (402, "\n "), (403, "a b"), (404, "a b"), (405, "A  b"), (None, base), (406, prose("long", 5000)), (406, prose("long", 5000))]
    got = {}
    for r in n.classes(docs(pairs)).collect():
        got.setdefault(r.doc_id, []).append(r.class_id)
    want = brute_force_classes(pairs)
    for (i, t), c in want.items():
        assert c in got[i], (i, (t or "")[:30])
    assert sum(map(len, got.values())) == len(pairs)


def test_second_rounds_find_links_that_a_pivot_misses(docs, prose):
    """Two texts similar to each other but not to the text that both meet in a band."""
    words = prose("p", 100).split()
    middle = " ".join(words)
    other = words[:]
    other[10:22] = [f"q{k}" for k in range(12)]
    twin = other[:]
    twin[60] = "changed"
    pairs = [(1, middle), (2, " ".join(other)), (3, " ".join(twin))] + [(10 + k, edited(middle, k, 1)) for k in range(6)]
    sets = [n.shingles(t) for _, t in pairs]
    assert n.similarity(sets[1], sets[2]) >= 0.8 > max(n.similarity(sets[0], sets[1]), n.similarity(sets[0], sets[2]))
    got = {r.doc_id: r.class_id for r in n.classes(docs(pairs)).collect()}
    assert got[2] == got[3] == 2 and got[1] == 1 and got[15] == 1


def mosaic(prose, n, chosen=40, of=60):
    """Distinct texts of blocks in fixed order, and some that are one block away from another."""
    blocks = [prose(f"block{k}", 20) for k in range(of)]
    rng = np.random.default_rng(5)
    sets = [sorted(rng.choice(of, chosen, replace=False)) for _ in range(n)]
    for k in range(n // 10):
        spare = [b for b in range(of) if b not in sets[k]]
        sets.append(sorted([*sets[k][:3], *sets[k][4:], spare[k % len(spare)]]))
    return [(i, " ".join(blocks[b] for b in s)) for i, s in enumerate(sets)]


def jaccard_classes(texts):
    """Classes by all pairs, for texts that repeat no shingle: there the similarity is Jaccard's."""
    sets = [n.shingles(t) for t in texts]
    assert all((w == 1).all() for _, w in sets)
    known = np.unique(np.concatenate([k for k, _ in sets]))
    has = np.zeros((len(sets), len(known)), dtype=np.float32)
    for row, (keys, _) in zip(has, sets, strict=True):
        row[np.searchsorted(known, keys)] = 1
    both, size = has @ has.T, has.sum(axis=1)
    linked = both >= n.SIMILARITY * (size[:, None] + size[None] - both)
    label = np.arange(len(sets))
    while True:
        after = np.array([label[row].min() for row in linked])
        if (after == label).all():
            return label.tolist()
        label = after


def test_mosaics_by_brute_force(docs, prose):
    """Texts that share blocks meet in bands whose pivots are far from both."""
    pairs = mosaic(prose, 500)
    got = {r.doc_id: r.class_id for r in n.classes(docs(pairs)).collect()}
    want = jaccard_classes([t for _, t in pairs])
    assert len(set(want)) < len(pairs)
    assert [got[i] for i, _ in pairs] == want


def test_a_pair_is_compared_though_its_pivot_is_far(docs, prose):
    """The one band that two similar texts share has a pivot unlike both."""
    base = prose("base", 100)
    pairs = [(1, base), (2, edited(base, 1, 1)), (3, prose("pivot", 100))] + [(10 + k, prose(k, 100)) for k in range(3)]
    table = docs(pairs)
    same = bytearray(n.REGISTERS)
    found = [(i, "[7]" if i < 3 else "[7, 8]" if i == 3 else "[8]", same if i < 3 else bytearray([i]) * n.REGISTERS) for i, _ in pairs]
    rows = table.sparkSession.createDataFrame(found, "doc_id long, bands string, signature binary")
    profiles = rows.join(table, "doc_id").selectExpr("doc_id", "unhex(md5(text)) AS node", "from_json(bands, 'array<bigint>') AS bands", "signature")
    got = n.linked_classes(table, profiles).collect()
    want = {r.node for r in profiles.where("doc_id < 3").collect()}
    assert {r.node for r in got} == want and len({r.component for r in got}) == 1


def test_pairs_of_blocks_meet_once():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (6, n.REGISTERS), dtype=np.uint8)
    signature = base[rng.integers(0, 6, 150)]
    kind = rng.integers(0, 40, 150)
    for block in (np.zeros(150, int), rng.integers(2, 4, 150)):
        i, j = n._agreeing(signature, kind, block)
        want = {(a, b) for a, b in itertools.combinations(range(150), 2) if kind[a] != kind[b] and (signature[a] == signature[b]).all() and (block.min() == block.max() or block[a] != block[b])}
        assert len(i) == len(want) and {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want


def test_filter_keeps_one_of_each_class(docs, prose):
    base = prose(1, 80)
    table = docs([(5, base), (3, edited(base, 1, 1)), (9, prose(2, 80)), (3, edited(base, 1, 1)), (6, None), (7, ""), (8, "")])
    out = n.filter_documents(table)
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 6, 7, 8, 9]


def test_empty_table(docs):
    assert n.classes(docs([])).count() == 0 and n.filter_documents(docs([])).count() == 0


def test_shared_shingles_by_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, size).astype(np.uint64)) for size in (0, 1, 5, 300, 4000, 7000, 7000)]
    found = n.shared_shingles(sets[:4], sets[2:])
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:4]]
    assert n.shared_shingles([], sets).shape == (0, 7)


def test_a_large_band_of_near_texts_gives_no_more_rows_than_texts(spark, prose):
    """Texts that all meet in one band, some linked in small classes, most not linked at all."""
    size = 6000
    base, rng = prose("base", 60).split(), np.random.default_rng(8)
    texts = []
    for k in range(size):
        words, group = base[:], k // 3 if k % 10 else size + k
        for at in np.random.default_rng(group).choice(58, 5, replace=False):
            words[at] = f"x{group}y{at}"
        texts.append(" ".join([*words[:59], f"z{k}"]))
    rows = [(i, t, bytearray(rng.integers(0, 256, n.REGISTERS, dtype=np.uint8))) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, signature binary")
    profiles = table.selectExpr("doc_id", "unhex(md5(text)) AS node", "array(7L) AS bands", "signature")
    nodes = table.selectExpr("unhex(md5(text)) AS node", "text")
    found = n.rest_links(n.band_members(profiles), profiles, nodes, spark.createDataFrame([], "node binary, component binary")).collect()
    assert len(found) < 2 * size
    want = jaccard_classes(texts)
    assert 1 < len(set(want)) < size
    name = {r.node: r.doc_id for r in profiles.collect()}
    parent = list(range(size))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[find(name[r.pivot])] = find(name[r.node])
    got = {}
    assert [got.setdefault(find(k), k) for k in range(size)] == want
