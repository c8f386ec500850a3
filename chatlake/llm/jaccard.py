"""Exact Jaccard join of documents on word shingles, with count vectors in R-trees.

A document is the set of its distinct shingles of five words; equal sets are one node. Shingles are hashed to groups, at least four for
each shingle of the set, and a node's point is how many of its shingles fall in each. The overlap of two nodes is at most the sum over groups of the
smaller count, and at most the same sum against the upper corner of an R-tree's box. Groups are leading bits of the hash, so a point of many
groups is folded by halves to compare it with one of fewer; the R-trees use 256 groups, and what passes is bounded by all.

An R-tree over all points would be read almost whole by each query, as random points of so many dimensions lie all equally far
apart. So nodes first meet in blocks that lose no link: of two linked nodes, the rarest quarter (and one) of either's shingles
have one in common. Rarity is a fixed-size sketch of counts; it decides only about cost. The first shingle in that order that two linked nodes share
has enough shingles behind it in both, so pairs with too few behind a block's shingle are left to another block, or have no link. Blocks of few nodes give
their pairs; in larger ones each node is first paired with the block's hub and with neighbours in random orders. Pairs whose bound allows a
link are verified on the sets. Then only blocks whose nodes are not all in one component are joined in full: nodes outside the block's largest
component are looked up among all, by R-trees over tiles of bounded size. What comes out is every component; links inside one need not all be listed.

Nodes of a shingle that very many documents share are dealt out by node instead of meeting in one group, and meet as a block's tiles.

Null texts and texts without a word have an empty set and no links; fewer than five words are one shingle, the whole sequence.
Repeated rows are nodes like any copy. A null id takes part and counts as larger than all others. An empty table gives no rows.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import blobs
from chatlake.llm.common import STEP_BYTES, gram_hashes, mixed, read, steps, utf8, word_hashes, word_spans
from chatlake.llm.components import components
from chatlake.llm.registry import query
from chatlake.session import discard, materialise, scratch

SHINGLE = 5
#: Two sets link when 100 times their intersection is at least this many times their union.
PERCENT = 75
#: Groups of the points in R-trees, as a power of two; a node has at least so many, and four for each shingle.
GROUP_BITS = 8
GROUPS = 1 << GROUP_BITS
PER_SHINGLE = 4
#: Counters of the rarity sketch, as a power of two; the sketch has this size whatever the input.
SKETCH_BITS = 19
_CHUNKS = 32
#: Blocks up to this size give all pairs at once.
SMALL = 12
#: Random orders in which the nodes of a larger block are paired with their neighbours.
ORDERS = 2
#: Nodes in one tile of a block's join, and points in one box of an R-tree.
TILE = 1024
LEAF = 16
#: Bytes of stored points that are unpacked at once; one takes about ten times as much unpacked.
POINT_BYTES = 1 << 18
#: A shingle's nodes are dealt out by node if the sketch counts so many documents and several times its mean.
HOT, TIMES_MEAN = 200_000, 8
#: Parts by node into which the rows of a block are dealt to meet what is known of the block.
PARTS = 16
BROADCAST_NODES = 2_000_000
BROADCAST_BLOCKS = 500_000


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, offsets = utf8(texts)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    starts, ends, first = word_spans(low, offsets)
    hashes = word_hashes(low, starts, ends)
    grams = gram_hashes(hashes, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a:b - n + 1])
        elif b > a:
            yield gram_hashes(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    total = np.bitwise_xor.reduce(mixed(shingles + np.uint64(0x632BE59BD9B4E019)), keepdims=True)
    total += np.add.reduce(mixed(shingles), keepdims=True) * np.uint64(3) + np.uint64(len(shingles))
    return int(mixed(total).view(np.int64)[0])


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """The smallest overlap at which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def group_bits(n: np.ndarray | int) -> np.ndarray | int:
    """Number of groups, as a power of two, of a set of ``n`` shingles."""
    return np.maximum(GROUP_BITS, np.ceil(np.log2(PER_SHINGLE * np.maximum(n, 1)))).astype(np.int64)


def point_of(shingles: np.ndarray) -> bytes:
    """The groups of sorted shingles as squeezed differences: a sparse point, as most counts are 0 or 1."""
    groups = (shingles >> np.uint64(64 - int(group_bits(len(shingles))))).astype(np.uint32)
    return pa.compress(np.diff(groups, prepend=np.uint32(0)).tobytes(), codec="zstd", asbytes=True)


def groups_of(point: bytes, n: int) -> np.ndarray:
    """The group of each shingle, ascending."""
    return np.cumsum(np.frombuffer(pa.decompress(point, 4 * n, codec="zstd", asbytes=True), "<u4"), dtype=np.uint32)


def dense(points: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Counts of 256 groups, a row for each list of groups."""
    out = np.zeros((len(points), GROUPS), np.int64)
    for row, groups, bits in zip(out, points, group_bits(sizes).tolist(), strict=True):
        row += np.bincount(groups >> np.uint32(bits - GROUP_BITS), minlength=GROUPS)
    return out


def common_at_most(a: np.ndarray, b: np.ndarray) -> int:
    """The summed coordinate minima of two points, the finer one folded to the groups of the other."""
    bits = int(group_bits(min(len(a), len(b))))
    a, b = (g >> np.uint32(int(group_bits(len(g))) - bits) for g in (a, b))
    # Equal groups are told apart by their number within the group, so the minimum is what both have.
    a, b = ((g.astype(np.int64) << 32) + np.arange(len(g)) - np.searchsorted(g, g) for g in (a, b))
    both = np.sort(np.concatenate((a, b)), kind="stable")
    return int((both[1:] == both[:-1]).sum())


#: A block's place holds the set's size (24 bits, the largest standing for all above) and, in steps of 1/1024 of it, how many shingles are rarer.
_SIZE_BITS = 24
_MAX_SIZE = (1 << _SIZE_BITS) - 1


def place_of(n: int, rank: np.ndarray) -> np.ndarray:
    steps_ = np.minimum(rank * 1024 // n, 255) if n < _MAX_SIZE else np.zeros(len(rank), np.int64)
    return (min(n, _MAX_SIZE) | (steps_ << _SIZE_BITS)).astype(np.uint32)


def size_and_rest(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes, and how many shingles at most are not rarer than the block's."""
    places = places.astype(np.int64)
    n = places & _MAX_SIZE
    return n, n - (places >> _SIZE_BITS) * n // 1024


def may_link(n: np.ndarray, rest: np.ndarray, m: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes allow a link and, were the block's shingle the first in common, enough shingles are left on both sides."""
    near = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(rest, other) >= needed(n, m, percent))
    return near | (n == _MAX_SIZE) | (m == _MAX_SIZE)


def described(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text), ``node`` (null for empty sets), ``n`` and ``point`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            nodes, sizes, points = [], [], []
            for s in shingle_sets(step["text"]):
                nodes.append(node_of(s) if len(s) else None)
                sizes.append(len(s))
                points.append(point_of(s))
            yield pa.RecordBatch.from_arrays([step["doc_id"], step["text_key"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                                              pa.array(points, pa.binary())], ["doc_id", "text_key", "node", "n", "point"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        run, "doc_id long, text_key long, node long, n long, point binary")


def sketched(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many documents have a shingle with each leading hash; 2^bits counters, summed by Spark in chunks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for step in steps(batches):
            places = np.concatenate([*shingle_sets(step["text"]), np.zeros(0, np.uint64)]) >> np.uint64(64 - bits)
            total += np.bincount(places.astype(np.int64), minlength=1 << bits).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array(
                [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in np.split(total, _CHUNKS)], pa.binary())], ["chunk", "counts"])

    size = (1 << bits) // _CHUNKS * 4

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size // 4, np.uint64)
        for x in table["counts"].to_pylist():
            total += np.frombuffer(pa.decompress(x, size, codec="zstd", asbytes=True), np.uint32)
        return pa.table({"chunk": table["chunk"][:1], "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(
        add, "chunk int, counts binary").collect()
    out = np.zeros((_CHUNKS, size // 4), np.uint32)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(bytes(r["counts"]), np.uint32)
    return out.reshape(-1)


def blocks(docs: DataFrame, sketch: np.ndarray, buckets: int, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """The rarest shingles of every node, as many as leave no link out, by bucket of the shingle; places are those of ``place_of``.
    Shingles that very many documents share go to buckets below zero, by the node, with their whole hash."""
    shift = np.uint64(64 - int(len(sketch)).bit_length() + 1)
    counters = docs.sparkSession.sparkContext.broadcast(sketch)
    limit = max(hot, TIMES_MEAN * int(sketch.sum(dtype=np.int64)) // len(sketch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, places, size, seen = [], [], [], 0, set()
        rare = counters.value

        def flush() -> Iterator[pa.RecordBatch]:
            k, o, p = np.concatenate(keys), np.concatenate(owners), np.concatenate(places)
            many = rare[k >> shift] > limit
            # The bucket comes from a mixed hash, as shingles are chosen by their leading bits. Within a bucket its low half
            # tells shingles apart; two that share it only add pairs to check.
            few = ~many if many.any() else slice(None)
            x = mixed(k[few])
            yield blobs.packed(x, x.astype(np.uint32), o[few], p[few], buckets)
            if many.any():
                rows = blobs.packed(mixed(o[many].view(np.uint64)), k[many], o[many], p[many], buckets)
                yield rows.set_column(0, "bucket", pa.array(-1 - rows["bucket"].to_numpy(), pa.int32()))

        for step in steps(batches):
            for s in shingle_sets(step["text"]):
                node = node_of(s) if len(s) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                count = len(s) - -(-percent * len(s) // 100) + 1
                keys.append(s[np.lexsort((s, rare[s >> shift]))[:count]])
                owners.append(np.full(count, node, np.int64))
                places.append(place_of(len(s), np.arange(count)))
                size += count
            if size >= blobs.FLUSH:
                yield from flush()
                keys, owners, places, size, seen = [], [], [], 0, set()
        if size:
            yield from flush()

    return docs.select("text").mapInArrow(run, blobs.SCHEMA)


def _all_pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within runs of equal size, runs one after another; ``sizes`` are all the same."""
    size, runs = int(sizes[0]), len(sizes)
    i, j = np.triu_indices(size, 1)
    base = (np.arange(runs) * size)[:, None]
    return (base + i).ravel(), (base + j).ravel()


def first_pairs(blocked: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a``, ``b`` (a < b) that meet in small blocks or as neighbours in large ones, and, with ``block`` set, the large blocks:
    rows ``block``, ``a`` and ``place`` for each node. A block is named by its members, so blocks with the same nodes count once, with the
    rarest shingle's place; a block that is dealt out is named by its shingle."""
    def meet(table: pa.Table) -> pa.Table:
        spread = table["bucket"][0].as_py() < 0
        keys, owners, places = blobs.unpacked(table, np.uint64 if spread else np.uint32)
        order = np.lexsort((places, owners, keys))
        k, o, p = keys[order], owners[order], places[order]
        fresh = np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]))[:len(k)]
        k, o, p = k[fresh], o[fresh], p[fresh]
        n, rest = size_and_rest(p)
        cuts = np.flatnonzero(np.append(True, k[1:] != k[:-1])[:len(k)])
        counts = np.diff(np.append(cuts, len(k)))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = 0 if spread else SMALL
        for size in range(2, small + 1):
            runs = cuts[counts == size]
            if len(runs):
                members = (runs[:, None] + np.arange(size)).ravel()
                i, j = (members[x] for x in _all_pairs(np.full(len(runs), size)))
                near = may_link(n[i], rest[i], n[j], rest[j], percent)
                left.append(o[i[near]])
                right.append(o[j[near]])
        named: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for a, size in zip(cuts[counts > small].tolist(), counts[counts > small].tolist(), strict=True):
            members, at = o[a:a + size], p[a:a + size]
            name = int(k[a:a + 1].view(np.int64)[0]) if spread else node_of(members.view(np.uint64))
            # A node's size is the same in all, so the least place is the one with the fewest rarer shingles.
            named[name] = (members, np.minimum(at, named[name][1]) if name in named else at)
        for members, _ in named.values():
            for turn in range(ORDERS):
                shuffled = members[np.argsort(mixed(members.view(np.uint64) ^ mixed(np.array([turn + 1], np.uint64))))]
                left += [shuffled[:-1]]
                right += [shuffled[1:]]
        x, y = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        large = [np.full(len(m), name, np.int64) for name, (m, _) in named.items()]
        members = np.concatenate([*(m for m, _ in named.values()), np.zeros(0, np.int64)])
        at = np.concatenate([*(x for _, x in named.values()), np.zeros(0, np.uint32)]).astype(np.int64)
        return pa.table({
            "block": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(np.concatenate([*large, np.zeros(0, np.int64)]))]),
            "a": np.concatenate((pairs[:, 0], members)),
            "b": pa.concat_arrays([pa.array(np.ascontiguousarray(pairs[:, 1])), pa.nulls(len(members), pa.int64())]),
            "place": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(at)])})

    return blocked.groupBy("bucket").applyInArrow(meet, "block long, a long, b long, place long")


def with_block(large: DataFrame, of_block: DataFrame, bound: int | None = None) -> DataFrame:
    """``large`` with the columns of its block. Up to ``bound`` blocks (a few numbers each) are broadcast; beyond, both sides are dealt out by
    block and part of the nodes, so no block is one task's."""
    known = materialise(of_block, "join-of-block")
    if known.limit((BROADCAST_BLOCKS if bound is None else bound) + 1).count() <= (BROADCAST_BLOCKS if bound is None else bound):
        return large.join(F.broadcast(known), "block")
    parts = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    return large.withColumn("_part", F.pmod(F.xxhash64("a"), F.lit(PARTS)).cast("int")).join(parts, ["block", "_part"]).drop("_part")


def hub_pairs(large: DataFrame) -> DataFrame:
    """Every node of a large block with the block's hub: the node that is in most large blocks, ties by a hash.

    A text that many others were made from has no shingle of its own, so it is in the most blocks, and links with more of them than
    they do with each other.
    """
    degree = large.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    known = large.join(degree, "a")
    # The greatest is found map-side, so a block sends one row from each task.
    hubs = known.groupBy("block").agg(F.max(F.struct("degree", F.xxhash64("a").alias("x"), "a")).alias("top")).select("block", F.col("top.a").alias("hub"))
    return with_block(large, hubs).filter("a != hub").select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b"))


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sizes and summed coordinate minima allow a link, with the ``slack`` of that bound."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b", "na", "nb", "pa", "pb")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps([batch], "pa", POINT_BYTES):
                na, nb = (part[x].to_numpy(zero_copy_only=False) for x in ("na", "nb"))
                ga, gb = ([groups_of(x, n) for x, n in zip(part[p].to_pylist(), sizes.tolist(), strict=True)] for p, sizes in (("pa", na), ("pb", nb)))
                least = needed(na, nb, percent)
                most = np.minimum(dense(ga, na), dense(gb, nb)).sum(axis=1)
                for i in np.flatnonzero((most >= least) & (np.minimum(na, nb) > GROUPS // PER_SHINGLE)).tolist():
                    most[i] = common_at_most(ga[i], gb[i])
                slack = (most - least) / (na + nb)
                yield part.select(["a", "b"]).append_column("slack", pa.array(slack)).filter(pa.array(slack >= 0))

    return both.mapInArrow(keep, "a long, b long, slack double")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int = PERCENT, bound: int = BROADCAST_NODES) -> DataFrame:
    """The stored pairs that link, by their sets. Only texts of nodes in a pair are read again, one for each node: a node is found by the id
    and the text's hash of its first row, and of rows alike in both a task passes on one."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first_id", "text_key"), "node")
    wanted = materialise(wanted, "join-wanted")
    asked = wanted.count()
    few = asked <= bound
    keyed = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("first_id"), F.xxhash64("text").alias("text_key"), "text")
    texts = keyed.join(F.broadcast(wanted) if few else wanted, ["first_id", "text_key"]).select("node", "text")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for step in steps(batches):
            fresh = []
            for node in step["node"].to_pylist():
                fresh.append(node not in seen)
                seen.add(node)
            step = step.filter(pa.array(fresh, pa.bool_()))
            keep = [len(x) > 0 and node_of(x) == node  # two texts may share their hash
                    for node, x in zip(step["node"].to_pylist(), shingle_sets(step["text"]), strict=True)]
            kept = step.filter(pa.array(keep, pa.bool_()))
            raw = [x.as_buffer() for x in kept["text"].cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([kept["node"], pa.array([x.size for x in raw], pa.int64()), pa.array(
                [pa.compress(x, codec="zstd", asbytes=True) for x in raw], pa.binary())], ["node", "size", "text"])

    # Squeezed texts are a third as large as their sets of hashes, so the sets are made again at each pair.
    found = materialise(texts.mapInArrow(chosen, "node long, size long, text binary"), "join-texts")
    if found.count() > asked:  # each node is found once at least
        twice, found = found, materialise(found.dropDuplicates(["node"]), "join-texts")
        discard(twice)

    def sets_of(part: pa.RecordBatch, side: str) -> Iterator[np.ndarray]:
        raw = [pa.decompress(x.as_buffer(), size, codec="zstd", asbytes=True)
               for x, size in zip(part[f"text{side}"], part[f"size{side}"].to_pylist(), strict=True)]
        return shingle_sets(pa.array(raw, pa.binary()).view(pa.string()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "texta", STEP_BYTES // 4):
            keep = []
            for s, t in zip(sets_of(part, "a"), sets_of(part, "b"), strict=True):
                small, large = (s, t) if len(s) <= len(t) else (t, s)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(common >= needed(len(s), len(t), percent))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: found.select(F.col("node").alias(x), F.col("size").alias(f"size{x}"), F.col("text").alias(f"text{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "sizea", "texta", "sizeb", "textb")
    links = materialise(both.mapInArrow(check, "a long, b long"), "join-links")
    discard(wanted, found)
    return links


def likeliest(pairs: DataFrame) -> DataFrame:
    """Of each node's pairs, the one with the most slack, ties by a hash: one pair for each node at most."""
    ends = pairs.select("a", "b", "slack", F.explode(F.array("a", "b")).alias("node"))
    best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("slack", F.xxhash64("a", "b"))).alias("pair"))
    return best.select("pair.a", "pair.b").distinct()


def between_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are not in one component yet."""
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


class RTree:
    """Points packed into boxes of ``LEAF`` by size and then by their heaviest groups; two levels."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order = np.lexsort((*points[:, :4].T, sizes // max(1, int(sizes.max()) // 16)))
        self.order = order
        self.points, self.sizes = points[order], sizes[order]
        cuts = np.arange(0, len(order), LEAF)
        self.cuts = np.append(cuts, len(order))
        self.upper = np.maximum.reduceat(self.points, cuts, axis=0)
        self.least = np.minimum.reduceat(self.sizes, cuts)
        self.most = np.maximum.reduceat(self.sizes, cuts)

    def probe(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Numbers of the points whose bound allows a link with the given one."""
        near = (100 * self.most >= percent * size) & (percent * self.least <= 100 * size)
        boxes = np.flatnonzero(near)
        boxes = boxes[np.minimum(self.upper[boxes], point).sum(axis=1) >= needed(size, np.maximum(self.least[boxes], -(-percent * size // 100)), percent)]
        if not len(boxes):
            return boxes
        inside = np.concatenate([np.arange(self.cuts[b], self.cuts[b + 1]) for b in boxes])
        sizes = self.sizes[inside]
        fits = np.minimum(self.points[inside], point).sum(axis=1) >= needed(size, sizes, percent)
        return self.order[inside[fits & (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size))]]


def remaining_pairs(large: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of different components within large blocks whose bound allows a link. Of a block, the nodes outside its largest component
    look up all nodes, so a pair of two such nodes is found from either side. Nodes lie in tiles; those that look up come from one tile
    and meet one tile in each group."""
    members = large.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    counts = members.groupBy("block", "root").agg(F.count(F.lit(1)).alias("c"))
    opened = counts.groupBy("block").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top")).filter("top.c < m").select(
        "block", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"), F.col("top.root").alias("main"))
    placed = with_block(members, opened).withColumn("tile", F.pmod(F.xxhash64("a", "block"), F.col("tiles")).cast("int"))
    outside = placed.filter("root != main")
    asking = outside.groupBy("block").agg(F.array_sort(F.collect_set("tile")).alias("askers"))
    columns = ["block", "a", "root", "place"]
    asks = outside.select(*columns, F.col("tile").alias("asker"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(True).alias("asks"))
    stored = with_block(placed, asking).select(*columns, F.explode("askers").alias("asker"), "tile", F.lit(False).alias("asks"))
    keyed = asks.unionByName(stored).join(nodes.select(F.col("node").alias("a"), "n", "point"), "a")

    def join(table: pa.Table) -> pa.Table:
        name, root, n, place, asks = (table[c].to_numpy() for c in ("a", "root", "n", "place", "asks"))
        size, rest = size_and_rest(place)
        own, there = np.flatnonzero(asks), np.flatnonzero(~asks)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(own) and len(there):
            points = [groups_of(x, k) for x, k in zip(table["point"].to_pylist(), n.tolist(), strict=True)]
            vectors = dense(points, n)
            tree = RTree(vectors[there], n[there])
            for i in own.tolist():
                j = there[tree.probe(vectors[i], int(n[i]), percent)]
                j = j[(root[j] != root[i]) & may_link(size[j], rest[j], size[i], rest[i], percent)]
                least = needed(int(n[i]), n[j], percent)
                j = j[[common_at_most(points[i], points[k]) >= x for k, x in zip(j.tolist(), least.tolist(), strict=True)]] if len(j) else j
                left.append(np.minimum(name[j], name[i]))
                right.append(np.maximum(name[j], name[i]))
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})

    return keyed.groupBy("block", "asker", "tile").applyInArrow(join, "a long, b long").distinct()


def clustered(docs: DataFrame, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (smallest id that links reach) of every row."""
    rows, named = _clustered(docs, percent, hot)
    out = rows.join(named, "node", "left")
    component = F.when(F.col("component") == (1 << 63) - 1, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _clustered(docs: DataFrame, percent: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Both written: ``doc_id``, ``n`` and ``node`` of every row, and ``node`` and ``component`` of every node that is linked or repeated."""
    with scratch(docs.sparkSession) as keep:
        rows, named = _linked(docs, percent, hot)
        return keep(rows), keep(named)


def _linked(docs: DataFrame, percent: int, hot: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    whole = materialise(described(docs), "join-described")
    # Null ids come after all others here.
    own_id = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    nodes = materialise(whole.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct(own_id.alias("first_id"), "text_key")).alias("top"), F.first("n").alias("n"), F.first("point").alias("point"),
        F.count(F.lit(1)).alias("rows")).select("node", "top.first_id", "top.text_key", "n", "point", "rows"), "join-nodes")
    rows = materialise(whole.select("doc_id", "n", "node"), "join-rows")
    discard(whole)
    met = materialise(first_pairs(blocks(docs, sketched(docs), blobs.bucket_count(spark), percent, hot), percent), "join-blocks")
    # Blocks with the same nodes may come from several buckets; the rarest shingle's place stays.
    large = materialise(met.filter("block IS NOT NULL").groupBy("block", "a").agg(F.min("place").alias("place")), "join-large")
    near = met.filter("block IS NULL").select("a", "b").unionByName(hub_pairs(large)).distinct()
    pairs = materialise(bounded(near, nodes, percent), "join-pairs")
    discard(met)
    # The likeliest pair of each node joins most of a component; other pairs within it need no check then.
    first = materialise(likeliest(pairs), "join-likely")
    all_links = [verified(first, docs, nodes, percent)]
    roots = components(all_links[0])
    rest = lambda r: between_roots(pairs.join(first, ["a", "b"], "left_anti"), r)
    far = lambda r: remaining_pairs(large, nodes, r, percent).join(pairs, ["a", "b"], "left_anti")
    for left in (rest, far):
        more = materialise(left(roots), "join-more")
        if more.limit(1).count():
            all_links.append(verified(more, docs, nodes, percent))
            links = all_links[0]
            for other in all_links[1:]:
                links = links.unionByName(other)
            old, roots = roots, components(links)
            discard(old)
        discard(more)
    firsts = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first_id", "rows")
    least = firsts.groupBy("root").agg(F.min("first_id").alias("component"))
    # A node of one row that nothing links with is its own component.
    named = materialise(firsts.join(least, "root").filter("rows > 1 OR first_id != component").select("node", "component"), "join-named")
    return rows, named


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one of the smallest id, with all its columns; of rows that repeat its id and text,
    one stays. Rows without an id stay. Texts are dealt out only where more than ``BROADCAST_NODES`` documents leave."""
    rows, named = _clustered(docs, percent, HOT)
    component = F.coalesce("component", "doc_id")
    found = rows.join(named, "node", "left").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("doc_id") == component).alias("first"), F.count(F.lit(1)).alias("rows"))
    odd = materialise(found.filter("NOT first OR rows > 1"), "join-odd")
    discard(rows, named)
    if odd.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        odd = F.broadcast(odd)
    packed = docs.select(F.col("doc_id").alias("_id"), F.struct("*").alias("_doc"))
    plain = packed.join(odd, packed["_id"] == odd["doc_id"], "left_anti")
    again = odd.filter("first")
    twice = packed.join(again, packed["_id"] == again["doc_id"], "left_semi").withColumn("_text", F.col("_doc.text"))
    return plain.select("_doc.*").unionByName(twice.dropDuplicates(["_id", "_text"]).select("_doc.*"))


@query(r"""
WITH RECURSIVE w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM common JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * c >= 75 * (sa.n + sb.n - c)),
walk AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT walk.a, links.b FROM walk JOIN links ON links.a = walk.b)
SELECT w.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, c.component_id FROM w LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY a) c USING (doc_id)
""")
def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return clustered(read(spark, folder, "documents"))
