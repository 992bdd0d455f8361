"""SimHash near-duplicates: fingerprints of word shingles, linked with the help of pivot distance tables.

Distinct fingerprints are dealt into cells by bits on which they agree. The 64 bits are cut into ``radius + m``
blocks; two linked fingerprints differ in ``radius`` blocks at most, so they agree on some ``m`` of them, and
each choice of ``m`` blocks is a cell key. ``m`` grows with the number of fingerprints so that unrelated ones
rarely share a cell (``CROWD`` of them by expectation); no link is lost at any ``m``.

In a cell each fingerprint has a row of Hamming distances to the pivots (fixed reference fingerprints). By the
triangle inequality the distances of linked fingerprints differ by ``radius`` at most in every coordinate. The
cell is sorted by the first coordinate, so that only neighbours within ``radius`` of it meet at all; pairs with
a larger difference in another one are discarded, and the survivors verified by their differing bits. A cell
yields a spanning forest of its links, never the pairs.

A cell above ``CELL`` members is cut. First its chunks are worked on alone, which with all other cells gives
components; then only members of different components are still to be compared: those outside the cell's
largest component meet every chunk of the cell. So a huge group of copies is passed over once and not squared.
Components then come from the forests.

``similar`` is the operator for texts that are alike by a share of their shingles (five words, 0.8, by default).
A bit of two such texts differs with a probability of 0.15 (``acos(2s/(1+s))/pi``), so the fingerprints are
``WIDE`` words of 64 bits over the set of shingles, cells come from samples of bits (as many samples as let a pair
at the share miss all of them once in ``1/MISS`` cases; their number grows with the fingerprints' as N^0.24), and
a cell's members link at ``WIDE_RADIUS`` differing bits or fewer (``WORD_RADIUS`` in any word), far from the half in which unrelated texts
differ; sets of four to nine shingles also have a cell per set without one of its shingles. Those links only propose: within what they connect the sets of shingles themselves are compared, by an
index of the rarest shingles of each set, and only pairs at the share are links. The pivot tables are kept there,
but at that radius they discard next to nothing.

Defined results: null or empty text, or one without a word, has fingerprint zero and is linked like any
other; repeated rows are linked; a row whose id is null belongs to its component, of which the id is the
least that is not null (null if there is none); an empty table gives no rows; other columns are never read.
For ``similar`` a text of less than five words is a single shingle, texts without a word are equal to each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from . import common, graph

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Members of a cell that one group holds; larger cells are cut.
CELL = 8192
#: Unrelated fingerprints that share a cell, by expectation and at most, before cells get keys of more blocks.
CROWD = 64
#: Rows that a task gathers before it works on the cells that are complete.
GATHER = 60_000
#: Reference fingerprints, from a fixed rule.
PIVOTS = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "big"), SEED) for i in range(32)], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number: each bit as in most hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return int.from_bytes(xxhash.xxh64_digest(joined, SEED), "big", signed=True)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_digest
    counts, total = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, total, 1 << 16):
        end = min(total, at + (1 << 16))
        shingles = [digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:end], starts[at + width : end + width], strict=True)]
        bits = np.unpackbits(np.frombuffer(b"".join(shingles), np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long) per row."""

    def make():
        return lambda texts: [pa.array([fingerprint(t) for t in texts], pa.int64())]

    return common.map_texts(docs, [key], text, [T.StructField("fp", T.LongType())], make)


class Forest:
    """Union-find over positions, with the root of every position at hand as an array."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> list[int]:
        """Joins i[k] and j[k] in turn; the k that joined two trees."""
        root, used = self.root, []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return int(x)

        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                used.append(k)
        if used:
            while not np.array_equal(up := root[root], root):
                root = up
            self.root = root
        return used


def forest(fps: np.ndarray, cells: np.ndarray, radius: int = RADIUS, wanted: np.ndarray | None = None, pivots: np.ndarray | None = None, each: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that connect what is linked among fingerprints ``fps``, rows of one or several words, of equal ``cells`` (any numbers): ``radius`` differing bits at most, and ``each`` in any word.

    With ``wanted`` (component numbers) only links between different ones are looked for.
    """
    fps = fps.reshape(len(fps), -1)
    pivots = PIVOTS[:, None] if pivots is None else pivots
    away = lambda a, b: np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)
    first = away(fps, pivots[0])
    order = np.lexsort((first, cells))
    fps, first, cells = fps[order], first[order], cells[order]
    tables = [away(fps, p) for p in pivots[1:]]
    words = np.ascontiguousarray(fps.T)
    trees, left, right = Forest(len(fps)), [], []
    if wanted is not None:
        _, start, inverse = np.unique(wanted[order], return_index=True, return_inverse=True)
        trees.root = start[inverse]

    def check(i: np.ndarray, j: np.ndarray) -> None:
        """Keeps the links among pairs: what the pivots don't discard is verified."""
        for table in tables:
            if not len(i):
                return
            fine = np.abs(table[i] - table[j]) <= radius
            i, j = i[fine], j[fine]
        apart = np.zeros(len(i), np.int16)
        for word in words:
            own = np.bitwise_count(word[i] ^ word[j])
            apart += own
            fine = (own <= each) & (apart <= radius)
            i, j, apart = i[fine], j[fine], apart[fine]
        if len(i):
            used = trees.join(i, j)
            left.append(i[used])
            right.append(j[used])

    if each < 64:
        # wide fingerprints, whose cells are large: a cell's first words against each other, in blocks
        bounds = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
        for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
            at, end = int(bounds[k]), int(bounds[k + 1])
            while at < end - 1:
                to = min(end, at + max(1, 131_072 // (end - at)))
                near = np.bitwise_count(words[0][at:to, None] ^ words[0][None, at:end]) <= each
                near &= np.bitwise_count(words[1][at:to, None] ^ words[1][None, at:end]) <= each
                i, j = np.divmod(np.flatnonzero(near), end - at)
                fine = (i < j) & (trees.root[i + at] != trees.root[j + at])
                check(i[fine] + at, j[fine] + at)
                at = to
    else:
        here, step, last = np.arange(len(fps)), 1, len(fps) - 1
        while True:
            here = here[here + step <= last]
            # sorted by cell and first coordinate: what is too far now is too far at every later step
            here = here[(cells[here + step] == cells[here]) & (first[here + step] - first[here] <= radius)]
            if not len(here):
                break
            i = here[trees.root[here] != trees.root[here + step]]
            check(i, i + step)
            step += 1
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def blocks_of(radius: int, agreeing: int) -> list[tuple[int, int]]:
    """(shift, mask) of ``radius + agreeing`` blocks of bits, as even as may be."""
    n = radius + agreeing
    bounds = [64 * k // n for k in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]


def agreeing(n: int, radius: int = RADIUS, crowd: int = CROWD) -> int:
    """Blocks that a cell key holds for ``n`` distinct fingerprints: as many as keep unrelated ones to ``crowd`` a cell, up to half of all bits."""
    m = 1
    while 64 * m / (radius + m) < min(32, log2(max(n, 1) / crowd)):
        m += 1
    return m


def dealt(fps: DataFrame, radius: int, m: int) -> DataFrame:
    """(fp, cell): a row per choice of ``m`` blocks; the cell's name is a hash of the choice and its bits."""
    blocks = [F.shiftrightunsigned("fp", shift).bitwiseAND(mask) for shift, mask in blocks_of(radius, m)]
    cells = [F.xxhash64(F.lit(k), *[blocks[b] for b in choice]) for k, choice in enumerate(combinations(range(len(blocks)), m))]
    return fps.select("fp", F.explode(F.array(*cells)).alias("cell"))


def _forests(groups: DataFrame, node: str, words: list[str], radius: int, pivots: np.ndarray | None = None) -> DataFrame:
    """(a, b): the forests of ``groups`` (node, words, cell, one, two[, root]), whatever shares cell, one and two; with ``root`` between different roots."""
    names = ["cell", "one", "two"]
    ready = groups.repartition(*names).sortWithinPartitions(*names).select(*names, node, *[w for w in words if w != node], *[c for c in groups.columns if c == "root"])
    at = slice(3, 4) if words == [node] else slice(4, 4 + len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def work(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
            i, j = forest(np.ascontiguousarray(rows[:, at]).view(np.uint64), np.cumsum(new), radius, rows[:, at.stop] if rows.shape[1] > at.stop else None, pivots, 64 if pivots is None else WORD_RADIUS)
            return pa.RecordBatch.from_arrays([pa.array(rows[i, 3]), pa.array(rows[j, 3])], names=["a", "b"])

        for batch in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(map(len, held)) >= GATHER:
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))
                if len(last):
                    cut = int(last[-1]) + 1
                    yield work(rows[:cut])
                    rows = rows[cut:]
                held = [rows]
        if held and sum(map(len, held)):
            yield work(np.concatenate(held))

    return ready.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, cell: int = CELL, m: int = 1) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fps`` (fp), enough of them to connect all that are linked; ``m`` blocks make a key."""
    return _links(dealt(fps, radius, m), "fp", ["fp"], radius, cell)


def _links(each: DataFrame, node: str, words: list[str], radius: int, cell: int, pivots: np.ndarray | None = None) -> DataFrame:
    """(a, b): links between the nodes of ``each`` (node, words, cell) that share a cell."""
    hot = common.materialise(each.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell), "hot-cells")
    forests = lambda groups: _forests(groups, node, words, radius, pivots)
    if hot.isEmpty():
        return forests(each.withColumns({"one": F.lit(0), "two": F.lit(0)}))
    kept = list(dict.fromkeys([node, *words, "cell"]))
    chunk = lambda n: F.pmod(F.xxhash64(node), F.ceil(n / F.lit(cell))).cast("int")
    alone = each.join(hot, "cell", "left").select(*kept, F.coalesce(chunk(F.col("n")), F.lit(0)).alias("one"), F.lit(0).alias("two"))
    found = common.materialise(forests(alone), "links-in-chunks")
    # what the chunks left apart
    root = common.materialise(graph.components(found).withColumnRenamed("node", node), "chunk-components")
    members = each.join(hot, "cell").join(root, node, "left").select(*kept, "n", F.coalesce("root", node).alias("root"))
    members = common.materialise(members, "hot-members")
    parts = members.groupBy("cell", "root").agg(F.count("*").alias("own"))
    largest = parts.groupBy("cell").agg(F.max(F.struct("own", "root"))["root"].alias("major"), F.sum("own").alias("all"), F.max("own").alias("own"))
    apart = common.materialise(largest.where("all > own").select("cell", "major", (F.col("all") - F.col("own")).alias("others")), "apart")
    rest = members.join(apart, "cell")
    ones, twos = F.ceil(F.col("others") / F.lit(cell)).cast("int"), F.ceil(F.col("n") / F.lit(cell)).cast("int")
    minor = rest.where("root <> major").select(*kept, "root", F.pmod(F.xxhash64(node), ones).cast("int").alias("one"), F.explode(F.sequence(F.lit(0), twos - 1)).alias("two"))
    every = rest.select(*kept, "root", F.explode(F.sequence(F.lit(0), ones - 1)).alias("one"), chunk(F.col("n")).alias("two"))
    return found.union(forests(minor.unionByName(every).distinct()))


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id) per row of ``docs``."""
    common.small_batches(docs.sparkSession)
    rows = common.materialise(fingerprints(docs, key, text), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min(key).alias("rep"))
    nodes = common.materialise(nodes, "distinct-fingerprints")
    edges = links(nodes.select("fp"), radius, m=agreeing(nodes.count(), radius))
    found = common.materialise(graph.components(edges).withColumnRenamed("node", "fp"), "components")
    least = found.join(nodes, "fp").groupBy("root").agg(F.min("rep").alias("least"))
    of = nodes.join(found.join(least, "root").select("fp", "least"), "fp", "left")
    of = common.materialise(of.select("fp", F.coalesce("least", "rep").alias("component_id")), "members")
    # alone in its plan, so that a fingerprint of very many rows can be split
    return rows.join(of, "fp").select(key, "fp", "component_id")


def digests(grouped: DataFrame, key: str = "doc_id") -> DataFrame:
    return grouped.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- texts alike by a share of their shingles --------------------------------------------------------------

#: Words of a shingle, and the least similarity of a link, as a fraction.
SIMILAR_WIDTH, SHARE = 5, (4, 5)
#: Words of 64 bits of a wide fingerprint; differing bits of a proposed link, of all and of any word (0.15 of them and six deviations, or five for sets of few shingles).
WIDE, WIDE_RADIUS, WORD_RADIUS = 4, 76, 28
#: How often a bit differs for two texts at the share, how often a pair at the share may miss all samples, and members of a cell by expectation.
DIFFER, MISS, SAMPLE_CROWD = 0.151, 1e-5, 2048
#: Shingles and sets of what was proposed that one group holds; more are cut.
WEIGHT, MEMBERS = 1_000_000, 2048
#: Nodes that are broadcast at most to fetch their texts; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Fixed rules: what spreads a shingle's hash over the words, and the wide pivots.
SPREAD = np.array([xxhash.xxh64_intdigest(f"word {i}", SEED) for i in range(WIDE)], np.uint64)
WIDE_PIVOTS = np.array([[xxhash.xxh64_intdigest(f"pivot {p} {i}", SEED) for i in range(WIDE)] for p in range(2)], np.uint64)


def shingles(text: str | None, width: int = SIMILAR_WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = [w.encode("utf-8", "surrogatepass") for w in (text or "").lower().split()]
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        return np.frombuffer(digest(joined, SEED), ">u8").astype(np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    hashes = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:])])  # noqa: B905
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """``WIDE`` words: each bit as in most of the set's hashes, spread over the words."""
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(own), 1 << 14):
        x = own[at : at + (1 << 14), None] ^ SPREAD
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(33)
        bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1)
        for first in range(0, len(bits), 255):
            counts += bits[first : first + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(own)).view(np.uint64)


def small_keys(own: np.ndarray) -> list[int]:
    """Names that two sets of few shingles at the share have in common for certain: one of them has one shingle more than the other, of four to eight."""
    if not 4 <= len(own) <= 9:
        return []
    parts = [own] * (len(own) <= 8) + [np.delete(own, i) for i in range(len(own) if len(own) >= 5 else 0)]
    return [int.from_bytes(xxhash.xxh64_digest(x.tobytes(), SEED + 1), "big", signed=True) for x in parts]


def samples(n: int) -> list[list[tuple[int, int]]]:
    """The bits (word, shift) of each sample for ``n`` distinct sets; a cell's key are a sample's bits."""
    size = max(6, round(log2(max(n, 1) / SAMPLE_CROWD)))
    share = (1 - DIFFER) ** size
    rng = np.random.default_rng(SEED)
    return [[divmod(int(b), 64) for b in np.sort(rng.choice(64 * WIDE, size, replace=False))] for _ in range(ceil(log(MISS) / log(1 - share)))]


def exact_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (positions) that connect what is linked among ``sets``."""
    if len(sets) < 2:
        return []
    sizes = [len(s) for s in sets]
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranked = [np.sort(r) for r in np.split(rank[place], np.cumsum(sizes)[:-1])]
    held = [set(r.tolist()) for r in ranked]
    root, used, index = list(range(len(sets))), [], {}
    (part, whole) = SHARE

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x in sorted(range(len(sets)), key=sizes.__getitem__):
        n = sizes[x]
        rare = ranked[x][: n - -(-part * n // whole) + 1].tolist()
        for y in {y for r in rare for y in index.get(r, ())}:
            if whole * sizes[y] < part * n or (a := find(x)) == (b := find(y)):
                continue
            both = len(held[x] & held[y])
            if (part + whole) * both >= part * (n + sizes[y]):
                root[max(a, b)] = min(a, b)
                used.append((y, x))
        for r in rare:
            index.setdefault(r, []).append(x)
    return used


def _set_groups(sets: DataFrame) -> DataFrame:
    """``sets`` (own, root, n, held) dealt into groups (root, one, two); any two with the same root share a group."""
    size = sets.groupBy("root").agg(F.greatest(F.sum("n") / WEIGHT, F.count("*") / MEMBERS).alias("size")).where("size > 1")
    large = common.materialise(size.select("root", F.ceil(F.col("size") * 2).cast("int").alias("pieces")), "large-clusters")
    if large.isEmpty():
        return sets.select("root", F.lit(0).alias("one"), F.lit(0).alias("two"), "own", "held")
    whole = sets.join(large, "root", "left_anti").select("root", F.lit(0).alias("one"), F.lit(0).alias("two"), "own", "held")
    own = sets.join(large, "root").withColumn("mine", F.pmod(F.xxhash64("own"), "pieces").cast("int"))
    cut = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return whole.union(cut.select("root", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "own", "held"))


def set_links(sets: DataFrame) -> DataFrame:
    """(a, b): links between ``sets`` (own, root, n, held), enough of them to connect all that are linked within what was proposed, ``root``."""
    names = ["root", "one", "two"]
    sorted_groups = _set_groups(sets).repartition(*names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, held = None, [], []

        def work() -> pa.RecordBatch:
            found = exact_forest(held)
            return pa.RecordBatch.from_pydict({"a": pa.array([own[i] for i, _ in found], pa.int64()), "b": pa.array([own[j] for _, j in found], pa.int64())})

        for batch in batches:
            for root, one, two, name, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, one, two) != now:
                    if len(own) > 1:
                        yield work()
                    now, own, held = (root, one, two), [], []
                own.append(name)
                held.append(np.frombuffer(raw, np.uint64))
        if len(own) > 1:
            yield work()

    return sorted_groups.mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, own, component_id) per row of ``docs``: the name of its set of shingles, and the least key of its component."""

    def signed():
        def work(texts: list) -> list:
            sets = [shingles(t) for t in texts]
            words = np.array([wide_fingerprint(s) for s in sets]).reshape(-1, WIDE).view(np.int64)
            names = [int.from_bytes(xxhash.xxh64_digest(s.tobytes(), SEED), "big", signed=True) for s in sets]
            return [pa.array(names, pa.int64()), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(WIDE)], pa.array([small_keys(s) for s in sets], pa.list_(pa.int64()))]

        return work

    def held():
        def work(texts: list) -> list:
            sets = [shingles(t) for t in texts]
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]

        return work

    words = [f"w{i}" for i in range(WIDE)]
    rows = common.materialise(common.map_texts(docs, [key], text, [*[T.StructField(c, T.LongType()) for c in ("own", *words)], T.StructField("small", T.ArrayType(T.LongType()))], signed), "signatures")
    nodes = common.materialise(rows.groupBy("own").agg(F.min(key).alias("rep"), *[F.any_value(w).alias(w) for w in (*words, "small")]), "distinct-sets")
    keys = []
    for k, sample in enumerate(samples(nodes.count())):
        masks = [sum(1 << shift for word, shift in sample if word == i) for i in range(WIDE)]
        keys.append(F.xxhash64(F.lit(k), *[F.col(w).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)) for w, mask in zip(words, masks, strict=True)]))
    each = nodes.select("own", *words, F.explode(F.concat(F.array(*keys), F.col("small"))).alias("cell"))
    proposed = graph.components(_links(each, "own", words, WIDE_RADIUS, CELL, WIDE_PIVOTS))
    wanted = common.materialise(proposed.withColumnRenamed("node", "own").join(nodes, "own").select(F.col("rep").alias(key), "own", "root"), "proposed")
    sent = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    texts = docs.select(key, F.col(text).alias("__text")).join(sent, key)
    sets = common.map_texts(texts, ["own", "root"], "__text", [T.StructField("n", T.LongType()), T.StructField("held", T.BinaryType())], held)
    sets = common.materialise(sets.dropDuplicates(["own"]), "sets")
    found = common.materialise(graph.components(set_links(sets)).withColumnRenamed("node", "own"), "components")
    least = found.join(nodes, "own").groupBy("root").agg(F.min("rep").alias("least"))
    of = nodes.select("own", "rep").join(found.join(least, "root").select("own", "least"), "own", "left")
    of = common.materialise(of.select("own", F.coalesce("least", "rep").alias("component_id")), "members")
    # alone in its plan, so that a set of very many rows can be split
    return rows.select(key, "own").join(of, "own").select(key, "own", "component_id")
