"""Near copies by SimHash up to a word shingle similarity, with an exact check of every link.

At a similarity of 0.8 two fingerprints differ in about a seventh of their bits. A ball that wide meets every shard of a
vantage-point tree of random fingerprints, so the tree alone would compare all pairs. Therefore:

1. Texts with the same set of shingle hashes are one node with a 128-bit SimHash; the first 64 bits go through the
   vantage-point tree of ``simhash`` for the close copies.
2. Bands of least hashes part the nodes for the wider ball: inside a band fingerprints within ``RADIUS`` bits are tied. A pair
   of similarity ``s`` shares a band with probability 1 - (1 - s^5)^24, which is 0.99993 at 0.8, and is over the radius with 0.00002.
3. Tied nodes form clusters. Each node's shingle set goes to its cluster once, and all pairs inside are held against each
   other exactly, as products of incidence matrices. Clusters over the tile size are cut into tiles of home and visitor blocks.
4. The links are joined to components.

Bands of very many nodes are found on a sample and dealt over several tasks; such a band is one cluster whatever its nodes'
fingerprints. The work in a cluster grows with the square of its different texts.

Defined cases: null and empty texts have the empty set and are copies of each other; a text of fewer words than a shingle is
one shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialised, whole_text
from .simhash import links as ball_links
from .simhash import shingle_hashes

BANDS, BAND_ROWS = 24, 5
#: of 128 bits; sets under ``SMALL`` shingles have too coarse fingerprints for it
RADIUS, SMALL = 36, 64
_RNG = np.random.default_rng(11)
FLIP = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)
ODD = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
MIX = _RNG.integers(0, 1 << 63, BAND_ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
SECOND = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text or "", words))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of the set's least hashes."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[i : i + 2048, None] ^ FLIP) * ODD).min(0))
    least ^= least >> np.uint64(29)
    return (least.reshape(BANDS, BAND_ROWS) * MIX).sum(1, dtype=np.uint64).view(np.int64)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """Two words of SimHash bits of a shingle set: a bit is set if over half of the hashes have it."""
    ones = np.zeros(128, np.int64)
    for i in range(0, len(hashes), 8192):
        h = hashes[i : i + 8192]
        other = (h ^ (h >> np.uint64(32))) * SECOND
        both = np.stack([h, other ^ (other >> np.uint64(29))], 1)
        ones += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def identity(columns: list[str]) -> tuple[Column, Column]:
    """128 bits that name a row by its content; equal rows share them."""
    every = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*every), F.xxhash64(F.lit(97), *every)


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """``(order, node, size, a, b, bands)`` of every row: set digest and size, the two words of its fingerprint, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, prints, keys = [], [], [], []
            for text in batch.column(1):
                h = shingle_set(text.as_py(), words)
                node.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                size.append(len(h))
                prints.append(wide_print(h))
                keys.append(bands(h) if len(h) else np.zeros(0, np.int64))
            p = np.array(prints, np.int64).reshape(-1, 2)
            names = ["order", "node", "size", "a", "b", "bands"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary()), pa.array(size, pa.int32()), pa.array(p[:, 0]), pa.array(p[:, 1]), _lists(keys)], names=names)

    kind = rows.schema["order"].dataType.simpleString()
    return rows.select("order", whole_text().alias("text")).mapInArrow(run, f"order {kind}, node binary, size int, a long, b long, bands array<long>")


def forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of the graph whose adjacency is ``hit``, a square of booleans."""
    free = np.ones(len(hit), bool)
    out = []
    for start in range(len(hit)):
        if not free[start]:
            continue
        free[start] = False
        reached = [start]
        while reached:
            at = reached.pop()
            for x in np.flatnonzero(hit[at] & free).tolist():
                free[x] = False
                reached.append(x)
                out.append((at, x))
    return out


def like_sizes(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    return np.minimum(x[:, None], y) >= least * np.maximum(x[:, None], y) - 1e-9


def tied(nodes: DataFrame, least: float, group_rows: int = 2048, sample_rows: int = 100_000) -> DataFrame:
    """``(u, v)``: spanning edges of the candidate pairs of every band, over ``nodes(id, size, a, b, bands)``.

    A band whose nodes in a sample say that it is over ``group_rows`` is tied as a whole, over several tasks.
    """
    banded = nodes.select("id", "size", "a", "b", F.posexplode("bands").alias("i", "k")).select(F.xxhash64("i", "k").alias("key"), "id", "size", "a", "b")
    share = min(1.0, sample_rows / max(1, nodes.count()))
    picked = banded.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 53)) < F.lit(int(share * (1 << 53))))
    # at most BANDS * sample_rows / 50 keys
    hot = picked.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where(F.col("n") > max(50.0, group_rows * share)).select("key", "head")
    marked = banded.join(F.broadcast(hot), "key", "left")
    whole = marked.where("head is not null and id <> head").select(F.col("id").alias("u"), F.col("head").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 5), np.int64)

        def met(rows: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            starts, sizes = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(rows)]]))
            x = starts[sizes == 2]
            first, second = rows[x], rows[x + 1]
            low, high = np.minimum(first[:, 2], second[:, 2]), np.maximum(first[:, 2], second[:, 2])
            apart = np.bitwise_count((first[:, 3:] ^ second[:, 3:]).view(np.uint64)).sum(1)
            ok = (low >= least * high - 1e-9) & ((apart <= RADIUS) | (low < SMALL))
            edges = [np.stack([first[ok, 1], second[ok, 1]], 1)]
            for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                for i in range(0, n, group_rows):  # a band over the size that the sample missed goes on in overlapping blocks
                    part = rows[at + max(0, i - 1) : at + min(n, i + group_rows)]
                    apart = sum(np.bitwise_count(w[:, None] ^ w) for w in np.ascontiguousarray(part[:, 3:].T).view(np.uint64))
                    hit = like_sizes(part[:, 2], part[:, 2], least) & ((apart <= RADIUS) | (np.minimum(part[:, None, 2], part[:, 2]) < SMALL))
                    if n > group_rows:
                        hit[0] = hit[:, 0] = True
                    edges.append(np.array([(part[p, 1], part[q, 1]) for p, q in forest(hit)], np.int64).reshape(-1, 2))
            every = np.concatenate(edges)
            return pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], names=["u", "v"])

        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)])
            last = np.searchsorted(rows[:, 0], rows[-1, 0]) if len(rows) else 0
            if last:
                yield met(rows[:last])
            rest = rows[last:]
        if len(rest):
            yield met(rest)

    usual = marked.where("head is null").select("key", "id", "size", "a", "b").repartition("key").sortWithinPartitions("key")
    return usual.mapInArrow(run, "u long, v long").union(whole).distinct()


def exact_links(ids: np.ndarray, sets: list[np.ndarray], home: np.ndarray, least: float, columns: int = 8192) -> list[tuple[int, int]]:
    """Spanning edges of the pairs of a home and another row with the similarity ``least`` or more."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # a shingle in one set only adds to no intersection
    number = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), sizes)
    keep = shared[code]
    row, code = row[keep], number[code[keep]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    own = np.flatnonzero(home)
    common = np.zeros((len(own), len(sets)), np.float32)
    for i in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(code, [i, i + columns])
        x = np.zeros((len(sets), min(columns, int(shared.sum()) - i)), np.float32)
        x[row[a:b], code[a:b] - i] = 1
        common += x[own] @ x.T
    hit = np.zeros((len(sets), len(sets)), bool)
    hit[own] = common >= least * (sizes[own][:, None] + sizes - common) - 1e-6
    return [(int(ids[a]), int(ids[b])) for a, b in forest(hit | hit.T)]


def linked(spark: SparkSession, clusters: DataFrame, sets: DataFrame, least: float, tile_rows: int = 2048, tile_shingles: int = 1_000_000) -> DataFrame:
    """``(u, v)``: spanning edges of the true links inside ``clusters(id, cluster)``, with ``sets(id, set, size)``."""
    placed = clusters.join(sets.select("id", "size"), "id")
    totals = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    totals = totals.withColumn("parts", F.greatest(F.ceil(F.col("n") / tile_rows), F.ceil(F.col("s") / tile_shingles)).cast("int"))
    every = totals.agg(F.sum("s")).first()[0] or 0
    buckets = F.lit(max(1, int(2 * every // tile_shingles)))
    dealt = clusters.join(totals.select("cluster", "parts"), "cluster")
    slot = F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int")
    one = F.array(F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(True).alias("home")))
    # a pair of blocks meets in the tile (lower, higher); the lower block's rows are its homes
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, slot).alias("r"), F.greatest(x, slot).alias("c"), (slot <= x).alias("home")))
    dealt = dealt.withColumn("t", F.explode(F.when(F.col("parts") > 1, others).otherwise(one)))
    dealt = dealt.select("id", "cluster", F.when(F.col("parts") > 1, F.xxhash64("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), buckets)).alias("bucket"), "t.r", "t.c", "t.home")

    def run(group: pa.Table) -> pa.Table:
        cluster, ids, home = (group.column(c).to_numpy() for c in ("cluster", "id", "home"))
        held = group.column("set").combine_chunks()
        if isinstance(held, pa.ChunkedArray):
            held = held.chunk(0) if held.num_chunks else pa.array([], pa.list_(pa.int64()))
        values, ends = held.values.to_numpy(zero_copy_only=False), held.offsets.to_numpy()
        order = np.argsort(cluster, kind="stable")
        cuts = np.flatnonzero(cluster[order][1:] != cluster[order][:-1]) + 1
        edges = []
        for at in np.split(order, cuts):
            if len(at) > 1:
                edges += exact_links(ids[at], [values[ends[i] : ends[i + 1]] for i in at.tolist()], home[at], least)
        return pa.table({"u": pa.array([a for a, _ in edges], pa.int64()), "v": pa.array([b for _, b in edges], pa.int64())})

    return dealt.join(sets.select("id", "set"), "id").groupBy("bucket", "r", "c").applyInArrow(run, "u long, v long")


def first_rows(spark: SparkSession, rows: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """``(k1, k2, repeated)``: the first by ``order`` of each group of linked copies, and whether other rows equal it.

    ``rows`` has ``text``, ``k1`` and ``k2`` (which name a row by its content) and ``order``, a struct that ends in both.
    """
    drawn = materialised(spark, sketches(rows, words), "copies-sketches")
    grouped = drawn.groupBy("node").agg(F.min("order").alias("order"), *(F.first(c).alias(c) for c in ("size", "a", "b", "bands")))
    nodes = materialised(spark, grouped.drop("node").withColumn("id", F.monotonically_increasing_id()), "copies-nodes")
    # close copies by the vantage-point tree, wider ones by bands
    of_print = nodes.where("size > 0").groupBy(F.col("a").alias("fp")).agg(F.min("id").alias("least"))
    near = ball_links(spark, of_print.select("fp"))
    same = nodes.select("id", F.col("a").alias("fp")).join(of_print, "fp").where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    named = lambda c: of_print.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_id"))
    close = near.join(named("u"), "u").join(named("v"), "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))
    candidates = materialised(spark, tied(nodes, least).union(same).union(close), "copies-candidates")
    clusters = components(spark, candidates).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    clusters = clusters.union(clusters.select(F.col("cluster").alias("id"), "cluster")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found), pa.array([len(x) for x in found], pa.int32())], names=["id", "set", "size"])

    wanted = clusters.join(nodes.select("id", "order.k1", "order.k2"), "id").select("id", "k1", "k2")
    texts = rows.select("k1", "k2", whole_text().alias("text")).join(wanted, ["k1", "k2"]).select("id", "text")
    sets = materialised(spark, texts.mapInArrow(run, "id long, set array<long>, size int").dropDuplicates(["id"]), "copies-sets")
    links = materialised(spark, linked(spark, clusters, sets, least), "copies-links")
    root = components(spark, links)
    groups = nodes.select("id", "order").join(root, F.col("id") == F.col("node"), "left").groupBy(F.coalesce("root", "id").alias("root"))
    first = groups.agg(F.min("order").alias("order")).select("order.k1", "order.k2")
    repeats = drawn.groupBy("order.k1", "order.k2").count().where("count > 1").select("k1", "k2", F.lit(True).alias("repeated"))
    return materialised(spark, first.join(repeats, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("repeated", F.lit(False)).alias("repeated")), "copies-first")
