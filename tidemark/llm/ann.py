"""Approximate nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are parted into bands of like norm. Inside a band, inner product becomes Euclidean nearness by scaling vectors with
the band's largest norm and adding the coordinate that fills them up to norm one; queries have zero there. Each table cuts
``hashes`` Gaussian projections into cells of ``width``. Every vector is indexed in each table of its band, and a query probes
all bands; a band of ``small_rows`` vectors or fewer is a single bucket that every query visits. A query visits its own bucket and then perturbed ones, in the order of estimated
success: the expected squared distances to the crossed cell borders, ranked as if the distances were order statistics.
A bucket's candidates are scored exactly on the original vectors in double precision, and the tables' candidates merge
by query.

Equal vectors are one candidate that carries its smallest ids, as many as an answer can hold, so a vector shared by a
third of the rows is a single entry; nothing is lost as equal vectors tie and the smaller id comes first. Buckets over
``bucket_rows`` are dealt over several parts, each of which the queries visit. Queries whose probes find fewer candidates than an
answer holds are searched again, exactly: all vectors are then one bucket, in parts.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as query or candidate;
vectors of another length than the most frequent one neither; null ids neither; rows that repeat a vector's id count once;
with fewer candidates than ``k`` all are returned. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialised, table


def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The best sets of the 2K cell borders sorted by distance, the empty set first."""
    k = hashes
    j = np.arange(1, 2 * k + 1)
    far = 2 * k + 1 - j
    cost = np.where(j <= k, j * (j + 1) / (4 * (k + 1) * (k + 2)), 1 - far / (k + 1) + far * (far + 1) / (4 * (k + 1) * (k + 2)))
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        c, chosen = heapq.heappop(heap)
        if all(2 * k - 1 - x not in chosen for x in chosen):  # both borders of one projection can't be crossed
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], chosen[:-1] + (last + 1,)))
            heapq.heappush(heap, (c + cost[last + 1], chosen + (last + 1,)))
    return out


class Tables:
    """The projections of every table."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, probes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dim + 1, hashes)) / width
        self.b = rng.random((tables, hashes))
        self.odd = rng.integers(1, 1 << 62, (tables, hashes), np.int64) | 1
        self.sets = perturbations(hashes, probes)

    def keys(self, x: np.ndarray, t: int) -> np.ndarray:
        return (np.floor(x @ self.a[t] + self.b[t]).astype(np.int64) * self.odd[t]).sum(1)

    def probes(self, x: np.ndarray, t: int) -> np.ndarray:
        """Bucket keys of each row's probes, most promising first."""
        h = x @ self.a[t] + self.b[t]
        cell = np.floor(h).astype(np.int64)
        k = h.shape[1]
        order = np.argsort(np.concatenate([h - cell, 1 - (h - cell)], 1), 1, kind="stable")
        step = np.concatenate([-self.odd[t], self.odd[t]])
        own = (cell * self.odd[t]).sum(1)
        return np.stack([own + step[order[:, list(s)]].sum(1) if s else own for s in self.sets], 1) if k else own[:, None]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id long, v array<double>)`` of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    dim = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (dim["n"] if dim else 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``(v, ids)``: each vector with its ``k + 1`` smallest ids.

    The row-number filter is a group limit, applied before and after the shuffle: a task passes on k + 1 rows of a vector.
    """
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id")) <= k + 1
    return rows.distinct().withColumn("_first", first).where("_first").groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def best(q: np.ndarray, v: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query row the positions of the ``k`` rows of ``v`` with the largest inner product, and all ties with the last."""
    s = q @ v.T
    if s.shape[1] <= k:
        return [np.arange(s.shape[1])] * len(q)
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    return [np.flatnonzero(row) for row in s >= least - 1e-9]


def search(
    spark: SparkSession, vectors: DataFrame, is_query, k: int = 20, tables: int = 3, hashes: int = 6, width: float = 2.5, probes: int = 40,
    bucket_rows: int = 8192, task_rows: int = 20_000, small_rows: int = 1024, band: float = 1.25, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` (a column over ``vec_id``) its k nearest others."""
    rows = usable(vectors, id_col, vector_col)
    most = F.array_max(F.transform("v", F.abs))
    norm = F.least(most * F.sqrt(F.aggregate(F.transform("v", lambda x: x / most), F.lit(0.0), lambda a, x: a + x * x)), F.lit(1.7e308))
    found = distinct_vectors(rows, k).withColumn("rep", F.element_at("ids", 1)).withColumn("norm", norm)
    reps = materialised(spark, found, "ann-vectors")
    scale = reps.agg(F.max("norm").alias("norm"), F.max(F.size("v")).alias("dim"), F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).first()
    kind = "query_id long, rank int, vec_id long, score double"
    if scale["norm"] is None:
        return spark.createDataFrame([], kind)
    hashed = Tables(scale["dim"], tables, hashes, width, probes)
    # logarithms of the norm, so the bands of all doubles are some thousands at most; the little offset keeps equal norms together
    reps = reps.withColumn("band", F.floor((F.log(F.lit(float(scale["norm"]))) - F.log("norm") + 1e-6) / float(np.log(band))).cast("int"))
    bands = {r["band"]: (float(r["norm"]), r["n"]) for r in reps.groupBy("band").agg(F.max("norm").alias("norm"), F.count("*").alias("n")).collect()}
    small = [i for i, (_, n) in bands.items() if n <= small_rows]
    wide = [i for i in bands if i not in set(small)]
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct().join(reps.select("v", "rep"), "v").select("query_id", "rep")
    asked = materialised(spark, asked, "ann-queries")
    # a distinct vector asks once, however many queries share it
    asking = reps.select("rep", "v").join(asked.select("rep").distinct(), "rep", "left_semi")

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, of = matrix(batch.column(1)), batch.column(2).to_numpy()
            x = v / np.array([bands[i][0] for i in of.tolist()]).reshape(-1, 1)
            x = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], 1)
            one = np.isin(of, small)
            yield pa.RecordBatch.from_arrays([pa.array(-1 - of[one], pa.int32()), pa.array(np.zeros(one.sum(), np.int64)), batch.column(0).filter(pa.array(one))], names=["t", "bucket", "rep"])
            rest = batch.column(0).filter(pa.array(~one))
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(of[~one] * tables + t, pa.int32()), pa.array(hashed.keys(x[~one], t)), rest], names=["t", "bucket", "rep"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1))
            x = v / np.abs(v).max(1, initial=0, keepdims=True)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            x = np.concatenate([x, np.zeros((len(x), 1))], 1)
            for i in small:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), -1 - i, np.int32)), pa.array(np.zeros(len(v), np.int64)), batch.column(0)], names=["t", "bucket", "rep"])
            for t in range(tables if wide else 0):
                keys = hashed.probes(x, t)
                at = pa.array(np.repeat(np.arange(len(v)), keys.shape[1]))
                for i in wide:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i * tables + t, np.int32)), pa.array(keys.ravel()), batch.column(0).take(at)], names=["t", "bucket", "rep"])

    entries = reps.select("rep", "v", "band").mapInArrow(index, "t int, bucket long, rep long")
    visits = asking.select("rep", "v").mapInArrow(probe, "t int, bucket long, rep long").distinct()

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact scores inside each bucket; of a query the k + 1 best distinct vectors of all buckets in this task go on."""
        kept: dict[int, dict[int, float]] = {}
        room = 500_000  # entries of kept before they go on

        def flush() -> Iterator[pa.RecordBatch]:
            q, r, s = [], [], []
            for query, of in kept.items():
                for rep, score in sorted(of.items(), key=lambda x: (-x[1], x[0]))[: k + 1]:
                    q.append(query)
                    r.append(rep)
                    s.append(score)
            kept.clear()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.float64())], names=["query", "rep", "score"])

        now, own, own_v, ask, ask_v = None, [], [], [], []

        def meet() -> None:
            if ask and own:
                v, q = np.concatenate(own_v), np.concatenate(ask_v)
                ids, queries = np.concatenate(own), np.concatenate(ask)
                for i in range(0, len(q), 512):
                    for j, near in enumerate(best(q[i : i + 512], v, k + 1), i):
                        of = kept.setdefault(int(queries[j]), {})
                        # summed in the same order for any block, so that a pair has one score
                        of.update(zip(ids[near].tolist(), np.einsum("ij,j->i", v[near], q[j]).tolist()))
                        if len(of) > 8 * (k + 1):
                            kept[int(queries[j])] = dict(sorted(of.items(), key=lambda x: (-x[1], x[0]))[: k + 1])

        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1).astype(np.int64)
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            rep, v = batch.column(4).to_numpy(), matrix(batch.column(5))
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if b <= a:
                    continue
                if (this := tuple(key[a].tolist())) != now:
                    meet()
                    now, own, own_v, ask, ask_v = this, [], [], [], []
                    if len(kept) * 8 * (k + 1) > room and sum(map(len, kept.values())) > room:
                        yield from flush()
                mine = asks[a:b]
                own.append(rep[a:b][~mine])
                own_v.append(v[a:b][~mine])
                ask.append(rep[a:b][mine])
                ask_v.append(v[a:b][mine])
                if sum(map(len, ask)) > 4096:  # the bucket's own rows come first
                    meet()
                    ask, ask_v = [], []
                    if len(kept) * 8 * (k + 1) > room and sum(map(len, kept.values())) > room:
                        yield from flush()
        meet()
        yield from flush()

    def answered(entries: DataFrame, visits: DataFrame) -> DataFrame:
        """``(query, near)``: of each visiting vector the best ids in all the buckets it visits."""
        # buckets over the limit, joined as they grow with the rows
        large = entries.groupBy("t", "bucket").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("parts")).where("parts > 1")
        large = materialised(spark, large, "ann-large")
        parts = F.coalesce("parts", F.lit(1))
        entries = entries.join(large, ["t", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).drop("parts")
        visits = visits.join(large, ["t", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        placed = entries.withColumn("asks", F.lit(False)).unionByName(visits.withColumn("asks", F.lit(True))).join(reps.select("rep", "v"), "rep")
        # buckets are dealt over as many tasks as the entries need, since a query's best go on once from each task
        tasks = max(8, -(-tables * scale["n"] // task_rows))
        placed = placed.withColumn("task", F.pmod(F.xxhash64("t", "bucket", "part"), F.lit(tasks)))
        dealt = placed.repartition("task").sortWithinPartitions("task", "t", "bucket", "part", "asks", "rep")

        scored = dealt.select("t", "bucket", "part", "asks", "rep", "v").mapInArrow(rerank, "query long, rep long, score double").distinct()
        order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
        merged = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).join(reps.select("rep", "ids"), "rep")
        answers = merged.groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), "ids")).alias("near"))
        # each vector's ids, nearest first and ties to the smaller id
        flat = F.sort_array(F.flatten(F.transform("near", lambda n: F.transform(n["ids"], lambda i: F.struct(n["minus"].alias("minus"), i.alias("vec_id"))))))
        return answers.select("query", F.slice(flat, 1, k + 1).alias("near"))

    answers = materialised(spark, answered(entries, visits), "ann-answers")
    whole = min(k + 1, scale["ids"])
    short = asking.select("rep").join(answers.where(F.size("near") >= whole), F.col("rep") == F.col("query"), "left_anti")
    short = materialised(spark, short, "ann-short")
    if short.limit(1).count():
        one = [F.lit(0).alias("t"), F.lit(0).cast("long").alias("bucket"), "rep"]
        exact = answered(reps.select(*one), short.select(*one))
        answers = answers.where(F.size("near") >= whole).unionByName(exact)
    given = asked.join(answers, asked["rep"] == answers["query"])
    others = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    return given.select("query_id", F.posexplode(others).alias("rank", "n")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.minus")).alias("score")
    )


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
