"""Document fingerprints by locally consistent parsing.

The code points of a text are cut into phrases by deterministic coin tossing: where neighbours differ, a symbol's label is
the place of its lowest bit that differs from its left neighbour's, with that bit's value; three rounds leave labels
below 6 whatever the alphabet, and local maxima of the labels start phrases. Runs of one symbol are first collapsed to
one symbol named by its length. A phrase's name is a hash of its symbols, and the names are the next level's text. A cut
depends on a few symbols to either side only, so equal substrings have equal interior phrases at any offset.

The fingerprint samples the phrase names of levels 2 and 3, with 32 slots for either, each with one byte of the least
hash that falls into it (00: none). The likeness of two fingerprints is the share of equal slots among those that
either fills.

Defined cases: a null text is the empty text, whose fingerprint is all zero; two empty fingerprints have likeness 1;
repeated rows come out once for each; rows of one id follow each other in the order of a hash of their texts; rows with a
null id come last in the descending order. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialised, table, whole_text

LEVELS = 3  # the names of the last two levels are sampled; phrases have about 2.6 ** level code points
SLOTS = 64
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
SLICE_CHARS = 64_000_000
POWERS = np.random.default_rng(5).integers(1, 1 << 63, 64, np.uint64) << np.uint64(1) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on its own copy."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def toss(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """One round of coin tossing; neighbours in ``x`` differ but where ``head`` starts a new text."""
    d = np.empty_like(x)
    d[0] = 0
    np.bitwise_xor(x[1:], x[:-1], out=d[1:])
    d[head] = x[head] + x.dtype.type(1)  # a text's first symbol is compared with an outside one
    low = d & (~d + d.dtype.type(1))
    place = np.bitwise_count(low - d.dtype.type(1)).astype(np.uint8)
    return (place << np.uint8(1)) | ((x & low) != 0)


def phrases(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level of texts that follow each other and begin at ``starts``: the names, and where each text begins."""
    n = len(x)
    keep = np.empty(n, bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    keep[starts] = True
    if not keep.all():  # collapse runs
        at = np.flatnonzero(keep)
        length = np.diff(at, append=n)
        x = x[at]
        starts = np.searchsorted(at, starts)
        run = np.flatnonzero(length > 1)
        x[run] = (mix(x[run].astype(np.uint64) * GOLD + length[run].astype(np.uint64)) & np.uint64(np.iinfo(x.dtype).max)).astype(x.dtype)
        n = len(x)
        beside = np.setdiff1d(np.concatenate([run, run + 1]), starts)
        beside = beside[(beside > 0) & (beside < n)]
        clash = beside[x[beside] == x[beside - 1]]  # a run whose name happens to be its neighbour's
        x[clash] ^= x.dtype.type(1)
    label = toss(toss(toss(x, starts), starts), starts)
    cut = np.zeros(n, bool)
    if n > 2:
        rise = label[1:] > label[:-1]
        np.greater(rise[:-1], rise[1:], out=cut[1:-1])
        cut[starts[1:] - 1] = False  # a text's last symbol has no right neighbour
    cut[starts] = True
    at = np.flatnonzero(cut)
    inside = np.arange(n, dtype=np.int32)
    inside -= np.repeat(at.astype(np.int32), np.diff(at, append=n))
    inside &= 63
    names = np.add.reduceat((x.astype(np.uint64) + np.uint64(1)) * POWERS[inside], at)
    return mix(names), np.searchsorted(at, starts)


def sketches(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprints (rows of bytes) of texts whose code points follow each other in ``codes``."""
    n = len(sizes)
    none = np.uint64(np.iinfo(np.uint64).max)
    best = np.full(n * SLOTS, none, np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        x, starts = codes, np.cumsum(sizes[full]) - sizes[full]
        for level in range(1, LEVELS + 1):
            x, starts = phrases(x, starts)
            if level >= LEVELS - 1:
                doc = np.repeat(full, np.diff(starts, append=len(x)))
                h = mix(x + np.array([level], np.uint64) * GOLD)
                slot = doc * SLOTS + (level - LEVELS + 1) * (SLOTS // 2) + (h % np.uint64(SLOTS // 2)).astype(np.int64)
                np.minimum.at(best, slot, h >> np.uint64(8))
    best = best.reshape(n, SLOTS)
    return np.where(best == none, 0, 1 + (best >> np.uint64(3)) % np.uint64(255)).astype(np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def fingerprint(text: str | None) -> np.ndarray:
    codes = code_points(text or "")
    return sketches(codes, np.array([len(codes)]))[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of two tables of fingerprints."""
    filled = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    return np.where(filled == 0, 1.0, same / np.maximum(filled, 1))


def document_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint)`` of every row, as lowercase hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                codes = [code_points(t) for t in part.column(1).to_pylist()]
                rows = sketches(np.concatenate(codes), np.fromiter(map(len, codes), np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes().hex() for r in rows])], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, fingerprint string")


def in_order(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """``(slice, doc_id, text)``: the rows in partitions of descending ids, by range and sorted inside each.

    There are as many slices as keep each near ``SLICE_CHARS``. Equal and null ids are ordered by a hash of the text, then by the text, so
    that many of them are dealt over several slices too.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("h", F.xxhash64("text"))
    if slices is None:
        size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        slices = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SLICE_CHARS))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    dealt = rows.repartitionByRange(slices, *order).sortWithinPartitions(*order, "text")
    return dealt.select(F.spark_partition_id().alias("slice"), "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many first code points of another."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def measured(rows: list[tuple], following: str) -> list[pa.Array]:
    """The result's columns for rows ``(doc_id, text)`` that follow each other, and the text after the last."""
    texts = [t for _, t in rows]
    nexts = [*texts[1:], following]
    changed = [edited(a, b) for a, b in zip(texts, nexts)]
    every = [code_points(t) for t in [*texts, following, *changed]]
    prints = sketches(np.concatenate(every), np.fromiter(map(len, every), np.int64))
    n = len(rows)
    own, after, new = prints[:n], prints[1 : n + 1], prints[n + 1 :]
    return [
        pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed]),
        pa.array([r.tobytes().hex() for r in own]), pa.array([r.tobytes().hex() for r in new]),
        pa.array(likeness(own, new), pa.float64()), pa.array(likeness(own, after), pa.float64()),
    ]


def edit_fingerprints(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and its likeness to that and to the next document.

    A slice measures all its rows but the last, and passes its first and last row on; the last ones meet the first ones of the next
    slices in a join of a row for each slice.
    """
    spark = docs.sparkSession
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next row may not be seen yet
        size, now = 0, None

        def edge(first: bool, row: tuple) -> pa.RecordBatch:
            none = [pa.nulls(1, k) for k in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *none, pa.array([now], pa.int32()), pa.array([first]), pa.array([row[1]], pa.string())], names=[*names, "slice", "first", "text"])

        def done(rows: list[tuple], following: str) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([*measured(rows, following), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())], names=[*names, "slice", "first", "text"])

        for batch in batches:
            for s, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None:
                    now = s
                    yield edge(True, (i, t))
                if len(held) >= 256 or size > 60_000:
                    yield done(held, t)
                    held, size = [], 0
                held.append((i, t))
                size += len(t)
        if held:
            if held[:-1]:
                yield done(held[:-1], held[-1][1])
            yield edge(False, held[-1])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, following in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays(measured([(i, t)], following), names=names)

    made = materialised(spark, in_order(docs, slices).mapInArrow(run, f"{RESULT}, slice int, first boolean, text string"), "fingerprints")
    first = made.where("first").select("slice", F.col("text").alias("following"))
    # a row of two integers for each slice, in one task
    order = Window.orderBy("slice")
    after = first.select("slice", F.lead("slice").over(order).alias("next"), F.first("slice").over(order).alias("least")).select("slice", F.coalesce("next", "least").alias("next"))
    last = made.where("not first").select("slice", "doc_id", "text").join(after, "slice").join(first.withColumnRenamed("slice", "next"), "next")
    return made.where("first is null").select(*names).unionByName(last.select("doc_id", "text", "following").mapInArrow(close, RESULT))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents"))
