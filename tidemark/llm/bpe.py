"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's parts are a linked list of byte positions. Each mergeable pair waits in the bucket of its merge rank; a
two-level bitmap over the ranks marks the buckets in use, and find-first-set picks the least rank. Within a bucket the
leftmost position comes first. A merge changes its two neighbouring pairs: their new ranks are pushed, the old entries
go stale and are skipped when they come up. So a pre-token of n bytes takes O(n log n) steps at most, however long.

Defined cases: a null text is the empty text and has no ids; repeated rows are encoded one by one; text that looks like a
special token is ordinary text. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text

#: No vocabulary over this size is sent to the executors.
MAX_RANK_FILE = 64 << 20
CACHE_ROWS = 400_000
#: Pre-tokens of more bytes have a queue of their own.
LONG = 256


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    end = list(range(1, n + 1))  # of the part that starts here; the next part starts there
    before = list(range(-1, n))  # start of the part before the one that starts here
    pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair whose left part starts here
    pair.append(-1)
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}  # lower bitmap: 64 ranks a word
    top = 0  # upper bitmap: words in use
    for i, r in enumerate(pair):
        if r >= 0:
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                w = r >> 6
                words[w] = words.get(w, 0) | 1 << (r & 63)
                top |= 1 << w
    while top:
        w = (top & -top).bit_length() - 1
        bits = words[w]
        low = bits & -bits
        r = (w << 6) + low.bit_length() - 1
        bucket = buckets[r]
        i = heappop(bucket)
        if not bucket:
            del buckets[r]
            words[w] = bits ^ low
            if bits == low:
                top ^= 1 << w
        if pair[i] != r:
            continue
        j = end[i]
        k = end[j]
        end[i] = k
        pair[j] = -1
        left = before[i]
        fresh = ((i, get(piece[i : end[k]], -1) if k < n else -1),)
        if k < n:
            before[k] = i
        if left >= 0:
            fresh += ((left, get(piece[left:k], -1)),)
        for at, r in fresh:
            pair[at] = r
            if r >= 0:
                if r in buckets:
                    heappush(buckets[r], at)
                else:
                    buckets[r] = [at]
                    w = r >> 6
                    words[w] = words.get(w, 0) | 1 << (r & 63)
                    top |= 1 << w
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class PairTable:
    """Rank of the token that two adjacent tokens make, for arrays of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = max(ranks.values()) + 1
        made = [(ranks[t[:i]] * self.n + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys = np.array(sorted(made), np.int64).reshape(-1, 2)
        self.keys, self.values = np.ascontiguousarray(keys[:, 0]), keys[:, 1].astype(np.int32)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where the two make no token."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)


def merge_many(pieces: list[bytes], pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """All ids of many pre-tokens, one after the other, and how many each has.

    One queue holds the pairs of all pre-tokens: a bucket's positions in different pre-tokens merge at once, and of
    those in the same pre-token only the leftmost, as a merge may make a pair of a lower rank there.
    """
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    token = pairs.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(token)
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
    last = np.cumsum(size) - 1
    end = np.arange(1, n + 1, dtype=np.int32)  # start of the next part; -1 after a pre-token's last
    end[last] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[last[:-1] + 1] = -1
    pair = np.full(n, -1, np.int32)
    inner = np.flatnonzero(end >= 0)
    pair[inner] = pairs(token[inner], token[inner + 1])
    alive = np.ones(n, bool)
    buckets: dict[int, list[np.ndarray]] = {}
    words: dict[int, int] = {}
    top = 0

    def push(at: np.ndarray) -> None:
        nonlocal top
        r = pair[at]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for rank, i, j in zip(r[starts].tolist(), starts, [*starts[1:], len(r)]):
            if rank in buckets:
                buckets[rank].append(at[i:j])
            else:
                buckets[rank] = [at[i:j]]
                w = rank >> 6
                words[w] = words.get(w, 0) | 1 << (rank & 63)
                top |= 1 << w

    if (first := np.flatnonzero(pair >= 0)).size:
        push(first)
    while top:
        w = (top & -top).bit_length() - 1
        bits = words[w]
        low = bits & -bits
        rank = (w << 6) + low.bit_length() - 1
        held = buckets.pop(rank)
        words[w] = bits ^ low
        if bits == low:
            top ^= 1 << w
        at = held[0] if len(held) == 1 else np.concatenate(held)
        at = np.sort(at[pair[at] == rank])  # the others are stale
        if at.size > 1 and (same := at[1:] == at[:-1]).any():
            at = at[np.concatenate(([True], ~same))]
        if not at.size:
            continue
        if at.size > 1:
            own = piece[at]
            again = own[1:] == own[:-1]
            if again.any():
                later = at[1:][again]
                at = at[np.concatenate(([True], ~again))]
                buckets[rank] = [later]
                words[w] = words[w] | low
                top |= 1 << w
        j = end[at]
        k = end[j]
        token[at] = rank
        end[at] = k
        alive[j] = False
        pair[j] = -1
        pair[at] = -1
        right = k >= 0
        a, k = at[right], k[right]
        before[k] = a
        pair[a] = pairs(token[a], token[k])
        p = before[at]
        left = p >= 0
        p = p[left]
        pair[p] = pairs(token[p], token[at[left]])
        fresh = np.concatenate([a, p])
        fresh = fresh[pair[fresh] >= 0]
        if fresh.size:
            push(fresh)
    return token[alive], np.bincount(piece[alive], minlength=len(pieces))


def _ranges(points: list[int]) -> str:
    out, a, b = [], points[0], points[0]
    for x in points[1:] + [0x7FFFFFFF]:
        if x != b + 1:
            out.append(rf"\U{a:08x}-\U{b:08x}")
            a = x
        b = x
    return "".join(out)


class Codec:
    """Encodes texts to ids and back, by a table of merge ranks and a splitting pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pairs = PairTable(self.ranks)
        self.pieces: dict[str, bytes] = {}  # pre-token to its ids as little-endian bytes
        self.wide = regex.compile(pattern).findall
        # The pattern with its classes spelled out for the first 0x3000 code points, which the standard module matches faster
        spelled = pattern
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            one = regex.compile(name)
            spelled = spelled.replace(name, "\0" + _ranges([c for c in range(0x3000) if one.match(chr(c))]) + "\1")
        spelled = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace("\0", "").replace("\1", ""), spelled.replace(r"\S", f"[^{_ranges([c for c in range(0x3000) if regex.match(r'\s', chr(c))])}]"))
        self.narrow = re.compile(spelled.replace("\0", "[").replace("\1", "]")).findall
        self.beyond = re.compile("[　-\U0010ffff]").search

    def split(self, text: str) -> list[str]:
        return (self.wide if self.beyond(text) else self.narrow)(text)

    def learn(self, pieces: set[str]) -> None:
        """Encode pre-tokens that are not in the cache yet; the rest of the cache goes when it is full."""
        if len(self.pieces) > CACHE_ROWS:
            self.pieces = {}
        missing = list(pieces - self.pieces.keys())
        coded = [p.encode("utf-8", "replace") for p in missing]
        short = []
        for p, b in zip(missing, coded):
            if b in self.ranks or len(b) > LONG:
                self.pieces[p] = np.array(merge(b, self.ranks), "<u4").tobytes()
            else:
                short.append((p, b))
        if short:
            ids, sizes = merge_many([b for _, b in short], self.pairs)
            whole, at = ids.astype("<u4").tobytes(), 0
            for (p, _), n in zip(short, (4 * sizes).tolist()):
                self.pieces[p] = whole[at : at + n]
                at += n

    def encode_all(self, texts: list[str | None], chars: int = 8_000_000) -> Iterator[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers; about ``chars`` are split at a time."""
        i = 0
        while i < len(texts):
            split, total, new = [], 0, set()
            while i < len(texts) and total < chars:
                split.append(self.split(texts[i] or ""))
                new.update(split[-1])
                total += len(texts[i] or "")
                i += 1
            self.learn(new)
            get = self.pieces.__getitem__
            for pieces in split:
                yield np.frombuffer(b"".join(map(get, pieces)), "<u4")

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec a process for each vocabulary."""
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def default_vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _shipped(spark: SparkSession, path: str | None, pattern: str | None):
    if path is None or pattern is None:
        path, pattern = default_vocabulary()
    with open(path, "rb") as f:  # the vocabulary lies with the driver; the executors get its bytes
        content = f.read(MAX_RANK_FILE + 1)
    if len(content) > MAX_RANK_FILE:
        raise ValueError(f"the rank file is over {MAX_RANK_FILE} bytes")
    return spark.sparkContext.broadcast(content), pattern


def encode_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every row."""
    content, pattern = _shipped(spark, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(content.value, pattern)
        for batch in batches:
            ids = [x.view("<i4") for x in coder.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode_documents(spark: SparkSession, encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of every row of ``encoded(doc_id, ids)``."""
    content, pattern = _shipped(spark, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(content.value, pattern)
        for batch in batches:
            texts = [coder.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def token_digests(spark: SparkSession, docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode, decode the ids again and give the digests of both: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, and ``ids`` if asked.

    Both directions run in one pass, so the ids are not passed between processes.
    """
    content, pattern = _shipped(spark, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(content.value, pattern)
        for batch in batches:
            n, a, b, every = [], [], [], []
            for ids in coder.encode_all(batch.column(1).to_pylist()):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if with_ids:
                    every.append(ids.view("<i4"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                columns.append(pa.array(every, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, kind)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark, table(spark, sf_dir, "documents"))
