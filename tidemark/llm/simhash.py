"""SimHash near-duplicates, linked exactly through a distributed vantage-point tree.

Method
------
1. A 64-bit SimHash of every whole text (lower-cased word shingles hashed with XXH64).
2. Equal fingerprints are one node. A routing tree of vantage points and median radii is fitted on a bounded sample
   of the fingerprints; every fingerprint has one home shard (leaf).
3. A fingerprint also visits each shard that its ball of the link radius reaches over a boundary, by the triangle bound.
   A pair is found where either end visits the other's home, so visits only go to shards right of the home.
4. Inside a shard, homes and visitors are ordered by their distance to a local vantage point and only rings within the
   radius are compared, exactly. A shard returns a spanning forest of its links, never the pairs.
5. Components of the forest edges give each document its group.

The sample only balances the shards: any tree gives the same links. Shards over ``tile_rows`` are cut into tiles of
home and visitor blocks, so no task holds an unbounded shard.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows come out once
for each; a null id takes no part in the minimum; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialised, whole_text

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """XXH64 of each word shingle (repeats included) of a text; of the whole sequence where it has fewer words."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "replace").translate(LOWER).split()
    # bytes.split() cuts at exactly the six ASCII white space characters \x09-\x0D and \x20
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    k = min(words, len(parts))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - k + 1].tolist()
    return np.fromiter([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint as an unsigned integer: a bit is 1 if it is set in over half of the shingles' hashes."""
    h = shingle_hashes(text or "", words)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the signed 64-bit view of each row's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


@dataclass
class Node:
    """An inner node of the routing tree: points within ``radius`` of ``point`` go left."""

    point: np.uint64
    radius: int
    left: "Node | int"
    right: "Node | int"


def build_tree(sample: np.ndarray, leaf_size: int) -> Node | int:
    """A vantage-point tree over a sample; leaves are numbered from left to right."""
    made = [0]
    rng = np.random.default_rng(7)

    def leaf() -> int:
        made[0] += 1
        return made[0] - 1

    def grow(points: np.ndarray, depth: int) -> Node | int:
        if len(points) <= leaf_size or depth > 40:
            return leaf()
        best = None
        for p in points[rng.integers(0, len(points), 5)]:
            d = np.bitwise_count(points ^ p).astype(np.int64)
            radius = int(np.median(d))
            if radius == d.max():
                radius -= 1
            inside = d <= radius
            # the vantage point that cuts evenly and leaves few points near its boundary
            near = np.mean(np.abs(d - radius) <= 3) + abs(0.5 - inside.mean())
            if 0 < inside.sum() < len(points) and (best is None or near < best[0]):
                best = (near, p, radius, inside)
        if best is None:
            return leaf()
        _, p, radius, inside = best
        return Node(p, radius, grow(points[inside], depth + 1), grow(points[~inside], depth + 1))

    return grow(np.unique(sample), 0)


def route(tree: Node | int, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each fingerprint its home leaf and the leaves right of it that its ball reaches: (position, leaf, is_home)."""
    out: list[tuple[np.ndarray, int, bool]] = []

    def walk(node: Node | int, home: np.ndarray, visit: np.ndarray) -> None:
        if not len(home) and not len(visit):
            return
        if not isinstance(node, Node):
            out.append((home, node, True))
            out.append((visit, node, False))
            return
        dh = np.bitwise_count(fps[home] ^ node.point).astype(np.int64)
        dv = np.bitwise_count(fps[visit] ^ node.point).astype(np.int64)
        inside = dh <= node.radius
        walk(node.left, home[inside], visit[dv - reach <= node.radius])
        walk(node.right, home[~inside], np.concatenate([visit[dv + reach > node.radius], home[inside & (dh + reach > node.radius)]]))

    walk(tree, np.arange(len(fps)), np.zeros(0, np.int64))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return (
        np.concatenate([x for x, _, _ in out]),
        np.concatenate([np.full(len(x), leaf, np.int32) for x, leaf, _ in out]),
        np.concatenate([np.full(len(x), h, bool) for x, _, h in out]),
    )


def link_shard(homes: np.ndarray, others: np.ndarray, reach: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all links between ``homes`` and ``others`` (which may include the homes): (node, root)."""
    points, where = np.unique(np.concatenate([homes, others]), return_inverse=True)
    own, rest = np.unique(where[: len(homes)]), np.unique(where[len(homes) :])
    parent = list(range(len(points)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def unite(a: int, b: int) -> None:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    if len(own) and len(rest):
        pivot = points[own[len(own) // 2]]
        ring = np.bitwise_count(points ^ pivot).astype(np.int64)
        own = own[np.argsort(ring[own], kind="stable")]
        own_ring = ring[own]
        for at in np.unique(ring[rest]):
            a, b = np.searchsorted(own_ring, [at - reach, at + reach + 1])
            near = own[a:b]
            if not len(near):
                continue
            mine = rest[ring[rest] == at]
            for i in range(0, len(mine), rows):
                block = mine[i : i + rows]
                hit = np.bitwise_count(points[block][:, None] ^ points[near][None, :]) <= reach
                if hit.sum() <= 16 * rows:
                    for x, y in zip(*np.nonzero(hit)):
                        unite(int(block[x]), int(near[y]))
                    continue
                while True:  # a dense block: unite each row's least and largest label until every row agrees
                    label = np.fromiter((find(int(x)) for x in near), np.int64, len(near))
                    mine_label = np.fromiter((find(int(x)) for x in block), np.int64, len(block))
                    some = hit.any(1)
                    low = np.minimum(np.where(hit, label, len(points)).min(1), mine_label)
                    high = np.maximum(np.where(hit, label, -1).max(1), mine_label)
                    differ = some & (low != high)
                    if not differ.any():
                        break
                    for x, y in {*zip(low[differ].tolist(), high[differ].tolist())}:
                        unite(x, y)
    root = np.fromiter((find(i) for i in range(len(points))), np.int64, len(points))
    moved = root != np.arange(len(points))
    return points[moved], points[root[moved]]


def sampled(share: float) -> Column:
    """Whether a fingerprint is in a sample of about ``share``, by its hash; exact to a part in 2^53."""
    return F.shiftrightunsigned(F.xxhash64("fp"), 11) < F.lit(int(share * (1 << 53)))


def links(spark: SparkSession, nodes: DataFrame, reach: int = 3, sample_rows: int = 16384, leaf_rows: int = 4096, tile_rows: int = 16384) -> DataFrame:
    """Spanning edges ``(u, v)`` over the distinct ``nodes(fp)``: every pair within ``reach`` bits is connected by them.

    ``sample_rows`` bounds the fingerprints that the driver sees to fit the routing tree, and at most a quarter of them
    is taken. The shard size grows with the square root of the input, so that the number of visits stays moderate.
    """
    count = nodes.count()
    share = min(0.25, sample_rows / max(1, count))
    picked = nodes.where(sampled(share)).select("fp").collect()
    sample = np.array([r[0] for r in picked], np.int64).view(np.uint64)
    rows = max(leaf_rows, int(12 * count**0.5))
    tree = build_tree(sample, max(4, int(rows * share)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            at, leaf, home = route(tree, fps, reach)
            for i in range(0, len(at), 1 << 18):
                part = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(fps[at[part]].view(np.int64)), pa.array(leaf[part]), pa.array(home[part])], names=["fp", "leaf", "home"])

    routed = nodes.select("fp").mapInArrow(spread, "fp long, leaf int, home boolean")
    sizes = routed.groupBy("leaf").agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
    # one row for each shard over the tile size; the shards number at most sample_rows, whatever the input
    large = sizes.where((F.col("homes") > tile_rows) | (F.col("all") > 8 * tile_rows)).collect()
    hb, vb = F.lit(1), F.lit(1)
    if large:
        hb = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r in large for x in (r["leaf"], -(-r["homes"] // tile_rows) or 1)]), F.col("leaf")), F.lit(1))
        vb = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r in large for x in (r["leaf"], -(-r["all"] // (8 * tile_rows)) or 1)]), F.col("leaf")), F.lit(1))
    slot = lambda n: F.pmod(F.xxhash64("fp", F.lit(3)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))
    tiled = (
        routed.withColumn("hb", hb).withColumn("vb", vb)
        # a home stands in its own row of tiles, and every point, homes too, in its own column of tiles
        .withColumn("part", F.explode(F.when(F.col("home"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
        .withColumn("r", F.explode(F.when(F.col("part"), F.array(slot(F.col("hb")))).otherwise(every(F.col("hb")))))
        .withColumn("c", F.explode(F.when(F.col("part"), every(F.col("vb"))).otherwise(F.array(slot(F.col("vb"))))))
    )

    def shard(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        home = group.column("part").to_numpy()
        node, root = link_shard(fps[home], fps[~home], reach)
        return pa.table({"u": node.view(np.int64), "v": root.view(np.int64)})

    return tiled.select("leaf", "r", "c", "fp", "part").groupBy("leaf", "r", "c").applyInArrow(shard, "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, reach: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    prints = materialised(spark, fingerprints(docs, id_col, text_col, words), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(spark, nodes, reach)
    root = components(spark, edges)
    # a component's least id, over all the fingerprints in it
    placed = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    small = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.select("fp", "root").join(small, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(spark, table(spark, sf_dir, "documents"))
