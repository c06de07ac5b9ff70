"""Toxicity by multiple-instance learning: a document is toxic if at least one of its sentences is.

A sentence has the logit ``bias + sum of the weights of its features``, repeats included; features are lower-cased words and
their prefixes (inflected insults share them). A document's score is the noisy-or ``1 - prod(1 - p_sentence)``. Only
document labels are known, so the gradient passes through the noisy-or to the sentences. The trained model then locates
the sentences whose own probability is over the threshold.

Fitting takes a bounded sample of labelled rows (``max_rows``, drawn by a hash of the id); scoring covers every row.

Defined cases: a null text is the empty text, which has one empty sentence; repeated rows are scored one by one; a null id
is never trained on and counts as not held out; contradicting labels of one id count as toxic; without both classes in
the sample every score is that of the prior alone. Columns of the input other than id and text are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialised, table, whole_text

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7, 8)
CACHE_ROWS = 250_000


def word_features(word: str) -> list[str]:
    """A word and its proper prefixes of the chosen lengths."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def sentence_features(sentence: str) -> list[str]:
    """Features of a sentence, each as often as it occurs."""
    return [f for w in WORD.findall(sentence.lower()) for f in word_features(w)]


@dataclass
class ToxicityModel:
    """Weights of the selected features and the bias of a sentence."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    _memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "weights": self.weights, "_memo": {}}

    def _weight(self, token: str) -> float:
        """Weights of all words of a token between white space; none is negative."""
        if len(self._memo) > CACHE_ROWS:
            self._memo.clear()
        found = self._memo[token] = sum(self.weights.get(f, 0.0) for f in sentence_features(token))
        return found

    def score(self, text: str | None, threshold: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, end, probability) of each sentence that is over the threshold."""
        text = text or ""
        memo, weight = self._memo, self._weight
        if not any((weight(t) if (w := memo.get(t)) is None else w) for t in {*text.split()}):
            n = len(SENTENCE.findall(text)) or 1
            return float(-np.expm1(-n * np.logaddexp(0, self.bias))), []
        clean, located = 0.0, []
        for m in SENTENCE.finditer(text):
            z = self.bias + sum(weight(t) if (w := memo.get(t)) is None else w for t in m[0].split())
            clean -= np.logaddexp(0, z)
            p = 1 / (1 + np.exp(-z))
            if p >= threshold:
                located.append((m.start(), m.end(), float(p)))
        return float(-np.expm1(clean)), located


def train(bags: list[tuple[int, int, list[list[int]]]], n_features: int, base_rate: float = 0.5, steps: int = 250, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Fit weights and bias by Adam on the noisy-or likelihood, with the classes weighted to ``base_rate``.

    A bag is (label, sentences without features, feature numbers of each other sentence).
    """
    y = np.array([b[0] for b in bags], float)
    plain = np.array([b[1] for b in bags], float)
    doc, sent, feat, n = [], [], [], 0
    for d, (_, _, sentences) in enumerate(bags):
        for s in sentences:
            doc.append(d)
            feat.extend(s)
            sent.extend([n] * len(s))
            n += 1
    doc, sent, feat = (np.array(x, np.int64) for x in (doc, sent, feat))
    w = np.zeros(n_features + 1)
    w[-1] = -5.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    share = np.where(y > 0, base_rate / max(1, y.sum()), (1 - base_rate) / max(1, (1 - y).sum()))
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(sent, weights=w[feat], minlength=n) if n else np.zeros(0)
        log_clean = -np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(y)) - plain * np.logaddexp(0, w[-1])
        toxic = np.maximum(-np.expm1(log_clean), 1e-9)
        pull = np.where(y > 0, np.exp(log_clean) / toxic, -1.0) * share  # d likelihood / d logit, over the sentence's own p
        g = np.zeros_like(w)
        per = pull[doc] * sigmoid(z)
        g[:-1] = np.bincount(feat, weights=per[sent], minlength=n_features) - decay * w[:-1] / n_features
        g[-1] = per.sum() + (pull * plain).sum() * sigmoid(w[-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        np.maximum(w[:-1], 0, out=w[:-1])  # features are those that toxic texts have more often
    return w[:-1], float(w[-1])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_features: int = 3000) -> ToxicityModel:
    """Fit on rows of ``labels(doc_id, toxic)`` whose crc32 of the id leaves a remainder mod 5, joined to ``docs(doc_id, text)``.

    At most about ``max_rows`` of them, half of either class where there are enough, chosen by a hash of the id.
    """
    known = (
        labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, max_rows / 2 / n) for y, n in sizes.items()}
    if not {0, 1} <= share.keys():
        return ToxicityModel(bias=-5.0 if 1 not in share else 0.0)
    rank = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(rank < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # bounded by max_rows ids and labels; written, as it is read three times
    rows = F.broadcast(chosen).join(docs.select("doc_id", whole_text().alias("text")), "doc_id").select("toxic", "text")
    rows = materialised(spark, rows, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {*sentence_features(text)}:
                    seen[f][toxic > 0] += 1
        keys = list(seen)
        for i in range(0, len(keys), 20_000):
            part = keys[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[k][0] for k in part], pa.int64()), pa.array([seen[k][1] for k in part], pa.int64())], names=["f", "clean", "toxic"])

    counts = rows.mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    drawn = rows.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean")).first()
    if not drawn["toxic"] + drawn["clean"]:  # no labelled id has a document
        return ToxicityModel(bias=-5.0)
    a, b = max(1, drawn["toxic"]), max(1, drawn["clean"])
    lift = F.log((F.col("toxic") + 0.5) / (a + 1.0)) - F.log((F.col("clean") + 0.5) / (b + 1.0))
    weight = lift * (F.col("toxic") / a - F.col("clean") / b)
    n = F.col("toxic") + F.col("clean")
    term = lambda c, k: F.col(c) * F.log(F.greatest(F.col(c), F.lit(1)) * (a + b) / (n * k))
    evidence = 2 * (term("toxic", a) + term("clean", b))  # likelihood ratio against no association
    best = counts.where((lift > 1) & (evidence > 12)).orderBy(weight.desc(), "f").limit(max_features)
    number = {r["f"]: i for i, r in enumerate(best.select("f").collect())}

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, plain, features = [], [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sentences = [sorted(number[f] for f in sentence_features(s) if f in number) for s in SENTENCE.findall(text)] or [[]]
                toxic.append(int(y > 0))
                plain.append(sum(not s for s in sentences))
                features.append([s for s in sentences if s])
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(plain, pa.int32()), pa.array(features, pa.list_(pa.list_(pa.int32())))], names=["toxic", "plain", "features"])

    bags = [tuple(r) for r in rows.mapInArrow(bag, "toxic int, plain int, features array<array<int>>").collect()]
    weights, bias = train(sorted(bags), len(number), sizes[1] / (sizes[0] + sizes[1]))
    return ToxicityModel(bias, {f: float(weights[i]) for f, i in number.items()})


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves no remainder mod 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, passed: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *passed, score, sentences)`` of every row: the sentences over the threshold as code point spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, spans = [], []
            for text in batch.column(1):
                s, found = model.score(text.as_py(), threshold)
                score.append(s)
                spans.append([{"start": a, "end": b, "p": p} for a, b, p in found])
            found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            kept = [batch.column(0), *(batch.column(2 + i) for i in range(len(passed)))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64()), pa.array(spans, found_type)], names=["doc_id", *passed, "score", "sentences"])

    kinds = dict(docs.dtypes)
    head = ", ".join([f"doc_id {kinds['doc_id']}", *(f"`{c}` {kinds[c]}" for c in passed)])
    return docs.select("doc_id", whole_text().alias("text"), *(F.col(c) for c in passed)).mapInArrow(run, f"{head}, score double, sentences array<struct<start:int,end:int,p:double>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(spark, docs, table(spark, sf_dir, "labels"))
    located = F.array_join(F.transform("sentences", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), located.alias("toxic_sentences"))
