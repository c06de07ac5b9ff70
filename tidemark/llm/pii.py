"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose spans, which may overlap: the four base kinds, and looser forms of them (written-out e-mail
addresses, telephone numbers without a leading plus, cards with dots or slashes, IPv6). Every candidate gets format
and context features. Boosted trees score them; they are small, fitted on a bounded number of candidates of each kind and
compiled to one column expression. Base spans always stay; a looser candidate is added where it has its kind's structure,
lies outside the base spans and its score is over the threshold of its kind.

There are no labels of personal data, so the trees learn from the base rules. A span that passes a base rule is an example for
its kind twice: as it stands, and rewritten in the kind's looser form in the same surroundings. Number-like and
address-like spans outside all of them are the examples against, dealt over the kinds. Thresholds are calibrated by counts
of scores over the rewritten examples and those against of the other half of all documents; for a kind with under ten
examples there, structure alone decides, so a rare kind is still redacted.

Positions are code points. They come from the lengths of the matches and of the pieces between them, so texts are scanned
by the regular expression engine only, in time linear in the matches. The expressions use possessive quantifiers where a loop would
otherwise recurse, and look behind so that a long run of one class is tried once. The counts in them are those of the
formats (four digits, eight groups), not limits on length.

Defined cases: a null text is the empty text; repeated rows come out once for each; null ids pass. Other columns are not
looked at.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, materialised, running, table

KINDS = ("email", "ip", "card", "phone")
#: The base expressions, written so that Java's engine neither recurses nor tries each place of a run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms of each kind.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}([./])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([./])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}\x20)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: Number-like spans of any kind, the examples against.
OTHER = r"(?<![0-9A-Za-z])[0-9]++(?:[./:\x20()-]{1,2}+[0-9]++)*+"
SPAN = "struct<kind:int,start:int,end:int>"
MATCH = "struct<kind:int,start:int,end:int,m:string,before:string,after:string>"
CONTEXT = 24
FEATURES = (
    "kind", "digits", "letters", "length", "groups", "spaces", "dots", "hyphens", "brackets", "colons", "at_signs", "at_words", "word_before", "word_after", "label_before",
)
LABELS = r"(?i)(?:e-?mail|mail|phone|tel|call|fax|mobile|card|visa|credit|contact|ip|host|address)[^A-Za-z0-9]{0,4}$"
FILLER = "\x00"


def _empty(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return m.rlike(f"^{octet}(?:\\.{octet}){{3}}$")
    if kind == "card":
        # from the right, every second digit is doubled and a product of two digits counts as their sum
        value = lambda i: F.substring(digits, (n - i).cast("int"), F.lit(1)).cast("int")
        doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(value(i))).otherwise(value(i)))
        return F.when(n.between(13, 19), total % 10 == 0).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _cut_up(text: Column, pattern: str) -> Column:
    """The matches of a pattern and the pieces between them, computed once."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))


def matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """The leftmost non-overlapping matches that ``keep`` (of the matched text) allows, with their surroundings."""

    def placed(p: Column) -> Column:
        found, between = p["found"], p["between"]
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(between, i)))

        def one(m: Column, i: Column, before: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(between, i))
            left = F.concat(F.when(i > 0, F.get(found, i - 1)).otherwise(F.lit("")), F.get(between, i))
            right = F.concat(F.get(between, i + 1), F.coalesce(F.get(found, i + 1), F.lit("")))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"), F.right(left, F.lit(CONTEXT)).alias("before"), F.left(right, F.lit(CONTEXT)).alias("after"))

        spans = let(running(sizes, lambda a, x: a + x), lambda before: F.transform(found, lambda m, i: one(m, i, before)))
        return F.when(F.size(found) > 0, F.filter(spans, lambda s: keep(s["m"]))).otherwise(_empty(MATCH))

    return let(_cut_up(text, pattern), placed)


def blanked(text: Column, pattern: str, keep) -> Column:
    """The text with each kept match filled by as many code points that no pattern knows."""

    def filled(p: Column) -> Column:
        fill = lambda m: F.when(keep(m), F.repeat(F.lit(FILLER), F.length(m))).otherwise(m)
        return F.array_join(F.transform(p["between"], lambda b, i: F.concat(b, F.coalesce(fill(F.get(p["found"], i)), F.lit("")))), "")

    return let(_cut_up(text, pattern), filled)


def _may_have(kind: str, text: Column) -> Column:
    """A quick test that texts without the kind fail."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": text.rlike(r"\+[0-9]")}[kind]


def base_matches(text: Column, kind: str) -> Column:
    found = matches(text, BASE[kind], KINDS.index(kind), lambda m: _valid(kind, m))
    return F.when(_may_have(kind, text), found).otherwise(_empty(MATCH))


def base_spans(text: Column, kind: str) -> Column:
    return F.transform(base_matches(text, kind), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def without_base(text: Column) -> Column:
    """The text with every base span filled."""

    def without(kind: str):
        return lambda t: F.when(_may_have(kind, t), blanked(t, BASE[kind], lambda m: _valid(kind, m))).otherwise(t)

    for kind in KINDS:
        text = let(text, without(kind))
    return text


def loose_matches(text: Column, kind: str) -> Column:
    quick = {"email": r"(?i)[\[(]\x20?at\x20?[\])]", "ip": r"(?:[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:){2}", "card": r"[0-9]{4}[./][0-9]{4,6}[./]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}[kind]
    keep = (lambda m: F.lit(True)) if kind == "ip" else (lambda m: _valid(kind, m))
    return F.when(text.rlike(quick), matches(text, LOOSE[kind], KINDS.index(kind), keep)).otherwise(_empty(MATCH))


def loosened(s: Column) -> Column:
    """A base match rewritten in the looser form of its kind, in its surroundings."""
    m, digits = s["m"], F.regexp_replace(s["m"], "[^0-9]", "")
    octet = lambda i: F.get(F.split(m, r"\."), F.lit(i)).try_cast("int")
    word = lambda i: F.lower(F.hex((octet(i) * 256 + octet(i + 1)).cast("long")))
    forms = (
        F.concat(F.substring_index(m, "@", 1), F.lit(" [at] "), F.replace(F.substring_index(m, "@", -1), F.lit("."), F.lit(" [dot] "))),
        F.concat_ws(":", F.lit("2001:db8:0:0:0:0"), word(0), word(2)),
        F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1."),
        F.regexp_replace(F.right(digits, F.lit(10)), "^([0-9]*)([0-9]{3})([0-9]{4})$", "($1) $2-$3"),
    )
    text = reduce(lambda a, i: F.when(s["kind"] == i, forms[i]).otherwise(a), range(1, len(KINDS)), forms[0])
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), text.alias("m"), s["before"].alias("before"), s["after"].alias("after"))


def features(s: Column, kind: Column | None = None) -> dict[str, Column]:
    """Format and context of a match, as small integers."""
    m, before, after = s["m"], s["before"], s["after"]
    count = lambda chars: F.length(m) - F.length(F.regexp_replace(m, f"[{chars}]", ""))
    return {
        "kind": s["kind"] if kind is None else kind,
        "digits": count("0-9"), "letters": count("A-Za-z"), "length": F.length(m), "groups": F.size(F.split(m, "[^0-9A-Za-z]+")),
        "spaces": count(r"\x20"), "dots": count("."), "hyphens": count(r"\-"), "brackets": count(r"()\[\]"), "colons": count(":"), "at_signs": count("@"),
        "at_words": m.rlike(r"(?i)[\[(]\x20?at\x20?[\])]").cast("int"),
        "word_before": before.rlike(r"\p{L}[ ,.]{0,2}$").cast("int"), "word_after": after.rlike(r"^[ ,.]{0,2}\p{L}").cast("int"), "label_before": before.rlike(LABELS).cast("int"),
    }


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.3, least: int = 5, smooth: float = 1.0) -> list[tuple]:
    """Boosted trees of depth two for the logistic loss.

    A tree is (feature, cut, left, right) with leaves or further splits below; rows with a feature up to the cut go left.
    """
    z = np.zeros(len(y))

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        best = None
        total = g[rows].sum() ** 2 / (h[rows].sum() + smooth)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] != v[:-1])
            at = at[(at + 1 >= least) & (len(order) - at - 1 >= least)]
            if len(at):
                gain = gs[at] ** 2 / (hs[at] + smooth) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + smooth) - total
                i = int(np.argmax(gain))
                if gain[i] > 1e-6 and (best is None or gain[i] > best[0] + 1e-12):
                    best = (gain[i], f, float(v[at[i]]))
        return best

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        found = split(rows, g, h) if depth else None
        if found is None:
            return float(rate * g[rows].sum() / (h[rows].sum() + smooth))
        _, f, cut = found
        low = x[rows, f] <= cut
        return (f, cut, grow(rows[low], g, h, depth - 1), grow(rows[~low], g, h, depth - 1))

    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), 2)
        trees.append(tree)
        z += predict([tree], x)
    return trees


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    def value(tree, rows: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(rows), tree)
        f, cut, left, right = tree
        low = rows[:, f] <= cut
        out = np.empty(len(rows))
        out[low], out[~low] = value(left, rows[low]), value(right, rows[~low])
        return out

    return sum((value(t, x) for t in trees), np.zeros(len(x)))


def compiled(trees: list, of: dict[str, Column]) -> Column:
    """The score of the trees as a column."""

    def value(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        f, cut, left, right = tree
        return F.when(of[FEATURES[f]] <= cut, value(left)).otherwise(value(right))

    return reduce(lambda a, b: a + b, map(value, trees), F.lit(0.0))


class Detector:
    """Fitted trees and the threshold of each kind."""

    def __init__(self, trees: list, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def __repr__(self) -> str:
        return json.dumps({"trees": self.trees, "thresholds": self.thresholds})


#: The threshold of a kind that can't be calibrated: its structure alone decides.
DEFAULT = float("-inf")
BINS = 256


def candidates(docs: DataFrame) -> DataFrame:
    """``(good, form, half, pick)`` and the features of every base span, as it stands (form 0) and loosened (form 1), and of other spans."""
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike("[0-9@]"))
    base = F.concat(*(base_matches(F.col("text"), k) for k in KINDS))
    marked = lambda form, a: F.transform(a, lambda s: F.struct(F.lit(form).alias("form"), s.alias("s")))
    good = let(base, lambda b: F.concat(marked(0, b), marked(1, F.transform(b, loosened))))
    other = let(without_base(F.col("text")), lambda t: matches(t, OTHER, -1, lambda m: F.lit(True)))
    rows = some.select("doc_id", F.explode(F.concat(good, marked(0, other))).alias("e"))
    pick = F.xxhash64(F.coalesce("doc_id", F.lit(0)), "e.s.kind", "e.s.start", "e.form")
    half = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(2)), F.lit(2))
    rows = rows.select((F.col("e.s.kind") >= 0).alias("good"), "e.form", half.alias("half"), pick.alias("pick"), "e.s")
    kind = F.when(F.col("good"), F.col("s.kind")).otherwise(F.pmod("pick", F.lit(len(KINDS))))
    return rows.select("good", "form", "half", "pick", *(c.cast("int").alias(n) for n, c in features(F.col("s"), kind).items()))


def fit(docs: DataFrame, max_rows: int = 20_000, precision: float = 0.98) -> Detector:
    """Fit on the candidates of half of the documents, at most ``max_rows``, of which the examples for and against each kind have an equal share.

    A kind's threshold lies in the middle of the least score at which its loosened examples among all candidates of the other half
    have the wanted precision (or their best one) and the next lower score; with under ten examples, or none against, it is ``DEFAULT``.
    """
    found = materialised(docs.sparkSession, candidates(docs), "pii-candidates")
    share = max_rows // (2 * len(KINDS))
    order = F.row_number().over(Window.partitionBy("good", "kind").orderBy("pick", *FEATURES))  # a group limit: a task passes on at most share rows of a group
    picked = found.where("half = 0").withColumn("n", order).where(F.col("n") <= share).select("good", *FEATURES).orderBy("good", *FEATURES).collect()
    trees = []
    if picked:
        trees = fit_trees(np.array([r[1:] for r in picked], float), np.array([r[0] for r in picked], float))
    score = F.floor(compiled(trees, {f: F.col(f) for f in FEATURES}) * BINS)
    counts = found.where("half = 1 and (form = 1 or not good)").groupBy("good", "kind", score.alias("bin")).count().collect()
    of = {(r["good"], r["kind"], r["bin"]): r["count"] for r in counts}
    thresholds = {}
    for k, name in enumerate(KINDS):
        bins = sorted({b for _, kind, b in of if kind == k}, reverse=True)
        own = np.cumsum([of.get((True, k, b), 0) for b in bins])
        other = np.cumsum([of.get((False, k, b), 0) for b in bins])
        thresholds[name] = DEFAULT
        if len(bins) and own[-1] >= 10:
            sure = np.where(own > 0, own / np.maximum(own + other, 1), 0.0)
            ok = np.flatnonzero(sure >= min(precision, sure.max()))
            below = bins[ok[-1] + 1 : ok[-1] + 2]
            thresholds[name] = (bins[ok[-1]] + below[0]) / 2 / BINS if below else DEFAULT
    return Detector(trees, thresholds)


def with_spans(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``, arrays of ``struct<kind, start, end>`` in order of kind and start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    added = _empty()
    kinds = [k for k in KINDS if k in detector.thresholds]
    if kinds:
        least = lambda s: reduce(lambda a, k: F.when(s["kind"] == KINDS.index(k), detector.thresholds[k]).otherwise(a), kinds, F.lit(float("inf")))
        packed = lambda s: F.struct(*(c.alias(n) for n, c in features(s).items()))
        score = lambda s: let(packed(s), lambda f: compiled(detector.trees, {n: f[n] for n in FEATURES}))
        loose = let(without_base(text), lambda t: F.concat(*(loose_matches(t, k) for k in kinds)))
        chosen = F.transform(F.filter(loose, lambda s: score(s) >= least(s)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        added = F.when(text.rlike(r"(?i)[0-9\])][\x20./:-]|[\[(]\x20?at"), chosen).otherwise(_empty())
    base = F.concat(*(base_spans(text, k) for k in KINDS))
    both = let(base, lambda b: F.struct(b.alias("base"), F.sort_array(F.concat(b, added)).alias("every")))
    return docs.withColumn("_pii", both).withColumn("pii_base", F.col("_pii.base")).withColumn("pii_spans", F.col("_pii.every")).drop("_pii")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    block = 4096  # a substring counts from the text's beginning, so pieces are cut from blocks

    def cut(blocks: Column, start: Column, size: Column) -> Column:
        of = F.slice(blocks, F.floor(start / block).cast("int") + 1, (F.floor((start % block + size) / block) + 1).cast("int"))
        return F.substring(F.array_join(of, ""), (start % block + 1).cast("int"), size.cast("int"))

    def replaced(blocks: Column, ordered: Column) -> Column:
        ends = running(F.transform(ordered, lambda s: -s["minus"]), lambda a, x: F.greatest(a, x))
        piece = lambda s, at: F.when(s["start"] >= at, F.concat(cut(blocks, at, s["start"] - at), F.get(names, s["kind"]))).otherwise(F.lit(""))
        last = F.aggregate(ordered, F.lit(0), lambda a, s: F.greatest(a, -s["minus"]))
        return F.concat(let(ends, lambda e: F.array_join(F.transform(ordered, lambda s, i: piece(s, F.get(e, i))), "")), let(last, lambda a: cut(blocks, a, F.length(text))))

    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind"))))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}+"), F.lit(0))
    return F.when(F.size(spans) > 0, let(F.struct(blocks.alias("b"), order.alias("o")), lambda p: replaced(p["b"], p["o"]))).otherwise(text)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the base spans; ``spans`` lists all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, fit(docs))
    of_kind = lambda i: F.size(F.filter("pii_base", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("pii_base")), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))
