"""The training-data operators against plain restatements on small fixtures."""

import base64
import hashlib
import json
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, chat, common, copies, mixing, parsing, pii, simhash, toxicity, urls, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " \t\n", "a", "é", "word", "x" * 30_000, "one two three " * 4000, "😀 中文\r\n", "\x00", "same text here", "same text here"]


def documents(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).withColumns({"fp": F.lit("clash"), "u": F.lit(1), "root": F.lit(2), "score": F.lit("x"), "at": F.lit(0)})


# --- op1


def test_toxicity_learns_sentences_from_document_labels(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = toxicity.fit(spark, docs, labels)
    said = {r["doc_id"]: r for r in toxicity.scores(docs, model).withColumn("held", toxicity.held_out()).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(said) == docs.count() and all(0 <= r["score"] <= 1 for r in said.values())
    right = [(said[i]["score"] >= 0.5) == bool(y) for i, y in marks.items() if i in said]
    assert np.mean(right) > 0.9


def test_toxicity_query_finds_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["toxic"] for r in common.table(spark, sf, "labels").where("toxic is not null").collect()}
    out = {r["doc_id"]: r for r in toxicity.op1_toxicity(spark, sf).collect()}
    assert out.keys() == {r["doc_id"] for r in common.table(spark, sf, "documents").collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for i, r in out.items())
    held = [(out[i]["predicted"], y) for i, y in marks.items() if i in out and out[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.9  # on documents whose labels were not seen


def test_toxicity_scores_are_the_noisy_or_of_sentences():
    model = toxicity.ToxicityModel(-3.0, {"bad": 5.0, "awfu*": 2.0})
    p = lambda z: 1 / (1 + np.exp(-z))
    score, found = model.score("A good day. You are BAD! Awfully so")
    assert score == pytest.approx(1 - (1 - p(-3)) * (1 - p(2)) * (1 - p(-1)))
    assert [(a, b) for a, b, _ in found] == [(11, 23)]
    assert model.score("")[0] == model.score(None)[0] == pytest.approx(p(-3))


def test_toxicity_defined_cases(spark):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scores(docs, toxicity.fit(spark, docs, none)).count() == len(ODD)
    some = spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.scores(docs, toxicity.fit(spark, docs, some)).count() == len(ODD)
    assert toxicity.scores(docs.limit(0), toxicity.ToxicityModel(-1.0)).count() == 0


# --- op2


def plain_chances(cells, targets, share):
    """Raked probabilities of ``{cell: weight}`` in plain loops, with the budget met by sorting."""
    total = sum(cells.values())
    w = dict(cells)
    goals = []
    for i, want in enumerate(targets):
        now = {}
        for c, x in cells.items():
            now[c[i]] = now.get(c[i], 0) + x
        g = want(now)
        goals.append({v: g[v] / sum(g.values()) for v in now})
    for _ in range(2000):
        for i, g in enumerate(goals):
            now = {}
            for c, x in w.items():
                now[c[i]] = now.get(c[i], 0) + x
            w = {c: x * g[c[i]] / now[c[i]] for c, x in w.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        got = sum(cells[c] * min(1, mid * w[c] * total / cells[c]) for c in cells)
        low, high = (mid, high) if got < share * total else (low, mid)
    return {c: min(1, low * w[c] * total / cells[c]) for c in cells}


def test_raking_meets_every_margin(spark):
    rng = random.Random(1)
    cells = [(a, b, c, rng.uniform(1, 9)) for a in ("x", "y", None, "-") for b in "pq" for c in "mn"]
    want = {"a": {"x": 0.4, "y": 0.3, None: 0.2, "-": 0.1}, "b": {"p": 0.6, "q": 0.4}, "c": {"m": 0.1, "n": 0.9}}
    frame = spark.createDataFrame(cells, "a string, b string, c string, weight double")
    out = mixing.rake(spark, frame, {m: mixing.fixed(t) for m, t in want.items()}).collect()
    for i, (m, t) in enumerate(want.items()):
        for v, share in t.items():
            assert sum(r["raked"] for r in out if r[f"own_{i}"] == v) == pytest.approx(share, abs=1e-9)
    with pytest.raises(RuntimeError):
        mixing.rake(spark, frame, {m: mixing.fixed(t) for m, t in want.items()}, rounds=1, together=1, tolerance=1e-300)


def test_mixing_query_against_plain_loops(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents").collect()

    def topic(t):
        return "table" if " | " in t else "noise" if "%%%" in t or "***" in t else "licence" if "icense" in t else "note" if len(t) < 500 else "article" if len(t) < 5000 else "book"

    cells, of = {}, {}
    for r in docs:
        t = r["text"] or ""
        of[r["doc_id"]] = (r["source"], r["lang"], topic(t))
        cells[of[r["doc_id"]]] = cells.get(of[r["doc_id"]], 0) + max(1, -(-len(t) // 4))
    power = lambda a, down=None: lambda now: {v: x**a * (down or {}).get(v, 1) for v, x in now.items()}
    want = plain_chances(cells, [power(0.5), power(0.7), power(1.0, {"noise": 0.25})], 0.5)
    every = {r["doc_id"]: r for r in mixing.sampling(spark, common.table(spark, sf, "documents")).collect()}
    assert every.keys() == of.keys()
    assert all(abs(every[i]["keep_probability"] - want[c]) < 1e-8 for i, c in of.items())
    drawn = {r["doc_id"]: r["d"] for r in spark.createDataFrame([(i,) for i in of], "doc_id long").select("doc_id", mixing.draw().alias("d")).collect()}
    kept = {r["doc_id"]: r for r in mixing.op2_mixing(spark, sf).collect()}
    assert kept.keys() == {i for i, d in drawn.items() if d < every[i]["keep_probability"]}
    assert all((r["source"], r["lang"], r["topic"]) == of[i] for i, r in kept.items())


def test_sample_meets_the_budget_and_the_targets(spark):
    docs = documents(spark, ["w " * 40] * 4000).withColumn("source", F.when(F.col("doc_id") % 10 < 8, "big").otherwise("small"))
    clash = {c: F.lit("clash") for c in ("tokens", "keep_probability", "_p", "_tokens", "n", "m_0", "row", "weight", "raked", "_m_source", "k_m_0")}
    targets = {"source": mixing.fixed({"big": 0.5, "small": 0.5})}
    kept = mixing.sample(spark, docs.withColumns(clash), targets, share=0.3, derived={}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in kept}
    assert abs(sum(n.values()) - 1200) < 100 and abs(n["big"] - n["small"]) < 100
    assert mixing.sample(spark, docs.limit(0)).count() == 0
    assert mixing.sampling(spark, documents(spark, ODD).withColumn("topic", F.lit(1))).count() == len(ODD)
    assert {r["keep_probability"] for r in mixing.sampling(spark, docs, targets, share=1.0, derived={}).collect()} == {1.0}


# --- op3


def near(vectors, query, k):
    scored = sorted((-float(np.dot(vectors[query], v)), i) for i, v in vectors.items() if i != query)
    return scored[:k]


def test_neighbours_recall(spark):
    rows = common.table(spark, "/root/testdata/sf0.01", "embeddings").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    out = ann.op3_neighbours(spark, "/root/testdata/sf0.01").collect()
    found = {}
    for r in out:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert r["score"] == pytest.approx(float(np.dot(vectors[r["query_id"]], vectors[r["vec_id"]])), abs=1e-12)
    assert set(found) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        hits += len({i for _, i, _ in got} & {i for _, i in near(vectors, q, 20)})
    assert hits / (20 * len(found)) >= 0.9


def test_neighbours_defined_cases(spark):
    good = [(i, [1.0, float(i % 3), 0.5]) for i in range(40)]
    rows = good + [(40, None), (60, []), (80, [0.0, 0.0, 0.0]), (100, [1.0, None, 2.0]), (120, [float("nan"), 1.0, 1.0]), (140, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (0, good[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("rep", F.lit(2))
    out = ann.search(spark, frame, F.col("vec_id") % 20 == 0, k=20, tables=4, hashes=2, width=4.0, probes=16).collect()
    vectors = {i: np.array(v) for i, v in good}
    for q in (0, 20):
        got = [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert [i for i, _ in got] == [i for _, i in near(vectors, q, 20)]
    assert {r["query_id"] for r in out} == {0, 20}
    assert ann.search(spark, frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_uneven_norms_and_tiny_tables(spark):
    rng = np.random.default_rng(5)
    kind = "vec_id long, embedding array<double>"
    x = rng.normal(size=(1200, 24))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * rng.choice([1.0, 0.4, 3.0], 1200)[:, None]
    x[7] *= 60
    vectors = dict(enumerate(x))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], kind)
    for small_rows, probes in ((64, 40), (0, 1)):  # one probe each finds too few for many queries
        got = {}
        for r in ann.search(spark, frame, F.col("vec_id") % 20 == 0, small_rows=small_rows, probes=probes).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert set(got) == set(range(0, 1200, 20)) and all(len(g) == 20 for g in got.values())
        if probes == 40:
            assert np.mean([len(g & {i for _, i in near(vectors, q, 20)}) / 20 for q, g in got.items()]) >= 0.9
    tiny = spark.createDataFrame([(i, (x[i] * 10.0 ** (2 * i)).tolist()) for i in range(5)], kind)
    for small_rows in (0, 1024):
        out = ann.search(spark, tiny, F.col("vec_id") >= 0, small_rows=small_rows, probes=1).collect()
        assert sorted((r["query_id"], r["vec_id"]) for r in out) == [(i, j) for i in range(5) for j in range(5) if i != j]


# --- op4

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(x.lstrip("0")) > 3 or int(x.lstrip("0") or 0) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


HARD = [
    "é😀 a@b.c.d_e@f.g x@y", "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112 or 41111111111111110", "+1 (366) 555-9807, +1-2 +123456789012345 +1234567890123456",
    "a.b@c-d.e", "@.a@b.c", "mail a%b+c@d.e-f.", "1" * 5000, "1 " * 5000, "4242424242424242" * 3, "a" * 50_000 + "@b.c", "+" * 300 + "1 23456789", "a@b.c" * 50, "x@y.z.", "9" * 50_000 + ".1.1.1", "(555) 123-4567 call me", "name [at] host [dot] org",
]


def test_base_spans_are_those_of_the_plain_expressions(spark):
    rng = random.Random(3)
    texts = [*ODD, *HARD, *("".join(rng.choice("0123456789.-+ ()@ab\n") for _ in range(rng.randint(0, 80))) for _ in range(400))]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r["s"] for r in pii.with_spans(docs, pii.Detector([], {})).select("doc_id", pii.listed(F.col("pii_base")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t)), repr(t[:100] if t else t)


def test_pii_query_on_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    for r in pii.op4_pii(spark, "/root/testdata/sf0.01").collect():
        base = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x == k for x, _, _ in base) for k in PLAIN]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= {*filter(None, r["spans"].split(","))}


def test_rare_kinds_are_redacted(spark):
    loose = {1: "write to jane [at] example [dot] org now", 2: "call 555 123 4567 now", 3: "pay 4111.1111.1111.1111 now", 4: "host 2001:db8:0:0:0:0:0:1 now"}
    plain = [(i, f"in {1900 + i % 90} they sold {i} of 12/{i}, see a{i}@b.org" if i % 3 else f"page {i}") for i in range(10, 100)]
    for more in ([], plain):
        docs = spark.createDataFrame([*loose.items(), *more], "doc_id long, text string")
        found = pii.with_spans(docs, pii.fit(docs)).where("doc_id < 10").select("doc_id", pii.redacted(F.col("text"), F.col("pii_spans")).alias("text"))
        assert {r["doc_id"]: r["text"] for r in found.collect()} == {1: "write to [EMAIL] now", 2: "call [PHONE] now", 3: "pay [CARD] now", 4: "host [IP] now"}


def test_fitted_trees_add_looser_forms_and_leave_look_alikes(spark):
    rng = random.Random(7)
    card = lambda: next(c for c in iter(lambda: f"4{rng.randrange(10**15):015d}", None) if luhn(c))
    rows = []
    for i in range(400):
        c, p = card(), f"{rng.randrange(200, 999)} {rng.randrange(200, 999)}-{rng.randrange(10**4):04d}"
        said = [f"write to u{i}@site{i % 7}.org", f"phone +1 {p}", f"card {c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"host 10.{i % 256}.3.{i % 99}"][i % 4]
        rows.append((i, f"In {1900 + i % 99} some {i * 37} of 1{i}.{i % 90} units (12/{i % 28}/2001) were sold, v1.{i}.2; {said} for more."))
    loose = {1000: ("email", "jane.doe [at] example [dot] org"), 1001: ("phone", "555 123 4567"), 1002: ("card", "4111.1111.1111.1111"), 1003: ("ip", "2001:db8:0:0:0:0:0:1")}
    alike = {1004: "card 4111.1111.1111.1112", 1005: "on 12/05/2001 and 13.14.15", 1006: "a list (at most 3) of 100 200 300", 1007: "ratio 1:2:3:4"}
    docs = spark.createDataFrame([*rows, *((i, f"please use {t} soon") for i, (_, t) in loose.items()), *alike.items()], "doc_id long, text string")
    model = pii.fit(docs)
    assert model.trees and all(t > pii.DEFAULT for t in model.thresholds.values())
    got = {r["doc_id"]: r["s"] for r in pii.with_spans(docs, model).select("doc_id", pii.listed(F.col("pii_spans")).alias("s")).collect()}
    for i, (kind, t) in loose.items():
        assert got[i] == f"{kind}:11:{11 + len(t)}", (i, model.thresholds)
    assert all(got[i] == "" for i in alike)
    assert all(got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t)) for i, t in rows)


def test_many_matches_in_one_text_take_linear_time(spark):
    import time

    text = "see a@b.org or 10.0.0.1; " * 50_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.with_spans(docs, pii.Detector([], {"phone": pii.DEFAULT})).select(F.size("pii_base").alias("n"), F.length(pii.redacted(F.col("text"), F.col("pii_spans"))).alias("size")).first()
    assert (row["n"], row["size"]) == (100_000, 50_000 * len("see [EMAIL] or [IP]; "))
    assert time.time() - began < 60


def test_trees_as_column_score_like_trees(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, (300, len(pii.FEATURES))).astype(float)
    y = (x[:, 0] + x[:, 3] > 8).astype(float)
    trees = pii.fit_trees(x, y)
    assert np.mean((pii.predict(trees, x) > 0) == y) > 0.9
    rows = spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"{f} int" for f in pii.FEATURES))
    got = [r[0] for r in rows.select(pii.compiled(trees, {f: F.col(f) for f in pii.FEATURES})).collect()]
    assert np.allclose(sorted(got), sorted(pii.predict(trees, x)))


def test_redaction(spark):
    rows = [("ab é a@b.c and 1.2.3.4!", [(0, 5, 10), (1, 15, 22)]), ("xyz", []), ("abcdef", [(2, 0, 4), (3, 2, 6)])]
    frame = spark.createDataFrame(rows, f"text string, s array<{pii.SPAN}>")
    assert [r[0] for r in frame.select(pii.redacted(F.col("text"), F.col("s"))).collect()] == ["ab é [EMAIL] and [IP]!", "xyz", "[CARD]"]


# --- op5


def test_bpe_agrees_with_the_library(spark):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    coder = bpe.Codec(open(path, "rb").read(), pattern)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(0)
    alphabet = [chr(c) for c in range(0x2FFF)] + ["中", "𝒳", "😀", "\x1c", "\x85"] + list(" \n\t'sd  tre..12") * 40
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["aaaa" * 50, "the" * 40, " " * 30 + "x", "ab" * 3000, "<|endoftext|>", ""] + [" " * i for i in range(20)]
    for text, ids in zip(texts, coder.encode_all(texts, chars=1000)):
        assert ids.tolist() == other.encode_ordinary(text)
        assert coder.decode(ids).decode() == text
    docs = documents(spark, ODD)
    for r in bpe.token_digests(spark, docs).collect():
        text = ODD[r["doc_id"]] or ""
        ids = np.array(other.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode_documents(spark, bpe.encode_documents(spark, docs)).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t in enumerate(ODD)}


def test_queue_follows_ranks_that_do_not_rise_with_length():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 500, b"abc": 300, b"bc": 400, b"abcabc": 350, b"ca": 310}
    rng = random.Random(2)

    def plain(p):
        parts = [p[i : i + 1] for i in range(len(p))]
        while (best := min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)) is not None:
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[x] for x in parts]

    pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))).encode() for _ in range(500)]
    ids, sizes = bpe.merge_many(pieces, bpe.PairTable(ranks))
    at = 0
    for p, n in zip(pieces, sizes):
        want = [ranks[p]] if p in ranks else plain(p)
        assert bpe.merge(p, ranks) == want
        if p not in ranks:
            assert ids[at : at + n].tolist() == want
        at += n


# --- op6


def test_edit_fingerprints(spark):
    docs = common.table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    out = {r["doc_id"]: r for r in parsing.edit_fingerprints(docs, slices=7).collect()}
    order = sorted(texts, reverse=True)
    assert set(out) == set(order)
    for i, nxt in zip(order, [*order[1:], order[0]]):
        changed = parsing.edited(texts[i], texts[nxt])
        own, new, after = map(parsing.fingerprint, (texts[i], changed, texts[nxt]))
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own.tobytes().hex(), new.tobytes().hex())
        assert (r["near_edited"], r["near_next"]) == (parsing.likeness(own, new), parsing.likeness(own, after))
    assert np.mean([r["near_edited"] > r["near_next"] for r in out.values()]) > 0.9


def plain_fingerprint(text):
    """The parsing of the module's text in plain loops over Python integers."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ x >> 30) * int(parsing.M1)) & mask
        x = ((x ^ x >> 27) * int(parsing.M2)) & mask
        return x ^ x >> 31

    def tossed(x):
        out = []
        for i, v in enumerate(x):
            d = v ^ x[i - 1] if i else v + 1
            place = (d & -d).bit_length() - 1
            out.append(2 * place + (v >> place & 1))
        return out

    x, best, top = [ord(c) for c in text], {}, (1 << 32) - 1
    for level in (1, 2, 3):
        runs = []
        for v in x:
            if runs and runs[-1][0] == v:
                runs[-1][1] += 1
            else:
                runs.append([v, 1])
        x = [v if n == 1 else mixed((v * int(parsing.GOLD) + n) & mask) & top for v, n in runs]
        label = tossed(tossed(tossed(x)))
        cuts = [i for i in range(len(x)) if i == 0 or i + 1 < len(x) and label[i - 1] < label[i] >= label[i + 1]]
        names = []
        for a, b in zip(cuts, [*cuts[1:], len(x)]):
            names.append(mixed(sum((v + 1) * int(parsing.POWERS[j & 63]) for j, v in enumerate(x[a:b])) & mask))
        x, top = names, mask
        if level > 1:
            for v in names:
                h = mixed((v + level * int(parsing.GOLD)) & mask)
                slot = (level - 2) * 32 + h % 32
                best[slot] = min(best.get(slot, mask), h >> 8)
    return bytes(0 if s not in best else 1 + (best[s] >> 3) % 255 for s in range(64)).hex()


def test_fingerprints_against_plain_loops(spark):
    docs = common.table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    some = {i: t for i, t in texts.items() if not re.search(r"(.)\1", t, re.S) or len(t) < 3000}
    got = {r["doc_id"]: r["fingerprint"] for r in parsing.op6_fingerprints(spark, SF).collect()}
    assert got.keys() == texts.keys() and len(some) > 50
    assert all(got[i] == plain_fingerprint(t) for i, t in some.items())


def test_fingerprint_defined_cases(spark):
    docs = documents(spark, ODD).unionByName(documents(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(documents(spark, ["again"]))
    out = parsing.edit_fingerprints(docs, slices=5).collect()
    assert len(out) == len(ODD) + 2
    same = [r["fingerprint"] for r in out if r["doc_id"] in (10, 11)]
    assert same[0] == same[1]
    assert parsing.edit_fingerprints(docs.limit(0)).count() == 0
    alone = parsing.edit_fingerprints(documents(spark, ["only one document here"])).collect()
    assert alone[0]["near_next"] == 1.0


def test_phrases_do_not_depend_on_the_offset():
    rng = random.Random(5)
    core = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    a = parsing.fingerprint("x" * 11 + core)
    assert parsing.likeness(a, parsing.fingerprint("other words first " + core)) > 0.9


# --- op7


def test_preferences(spark):
    turn = lambda r, t: (r, t)
    shared = [turn("user", "hi"), turn("assistant", "yes")]
    pairs = [(1, [*shared, turn("user", "q"), turn("assistant", "good")], [*shared, turn("user", "q"), turn("assistant", "bad <|im_end|>")]), (2, shared, shared), (3, [], shared), (4, None, None)]
    rows = spark.createDataFrame(pairs, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    out = {r["pair_id"]: r for r in chat.format_preferences(rows).collect()}
    assert out[1]["n_prompt_turns"] == 3 and out[1]["prompt"].endswith("<|im_start|>user\nq<|im_end|>\n")
    for side, body in (("chosen", "good<|im_end|>\n"), ("rejected", "bad < |im_end|><|im_end|>\n")):
        (span,) = out[1][f"{side}_mask"]
        assert out[1][side][span["start"] : span["end"]] == body
    assert (out[2]["n_prompt_turns"], out[2]["chosen"], out[2]["chosen_mask"]) == (2, "", [])
    assert out[3]["n_prompt_turns"] == 0 and out[3]["chosen"] == "" and len(out[3]["rejected_mask"]) == 1
    assert out[4]["prompt"] == out[4]["rejected"] == ""


def test_conversations_defined_cases(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (None, 0, "user", "lost"), (2, None, "user", "first"), (2, 0, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.gathered(frame).collect()}
    assert got == {1: [("user", "a"), ("", "")], 2: [("user", "first"), ("assistant", "")]}
    assert chat.format_preferences(chat.with_other_reply(frame)).count() == 0  # one reply only
    assert chat.with_other_reply(frame.limit(0)).count() == 0
    more = spark.createDataFrame([(9, 0, "user", "q"), (9, 1, "assistant", "good"), (9, 2, "user", "thanks"), (40, 0, "assistant", "other"), (41, 0, "assistant", "other"), (50, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    rows = {r["pair_id"]: r for r in chat.with_other_reply(more.withColumn("reply", F.lit(1)).withColumn("next", F.lit(2))).collect()}
    assert {i: (r["chosen"][-1]["text"], r["rejected"][-1]["text"], len(r["chosen"])) for i, r in rows.items()} == {9: ("good", "other", 2), 41: ("other", "good", 1)}
    ids = spark.createDataFrame([(i * i * 7 - 90,) for i in range(60)], "conv_id long")
    want = sorted(r["conv_id"] for r in ids.collect())
    assert {tuple(r) for r in chat.next_ids(ids, 4).collect()} == set(zip(want, want[1:] + want[:1]))
    assert chat.gathered(frame.limit(0)).count() == 0


def test_preferences_query_against_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view conversations as select * from read_parquet('/root/testdata/sf0.01/conversations.parquet')")
    found = con.sql(chat.SQL)
    out = chat.op7_preferences(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, out.select(*found.columns).collect())) == sorted(found.fetchall())
    assert out.where("chosen = '' or rejected = '' or chosen = rejected").count() == 0


# --- op8


def plain_simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_groups(prints, reach=3):
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= reach:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_near_duplicates(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    prints = {r["doc_id"]: plain_simhash(r["text"]) for r in docs.collect()}
    groups = plain_groups(prints)
    out = simhash.near_duplicates(spark, docs).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in out} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in out} == groups


def test_sample_rate_holds_at_any_size():
    for n in (1e9, 1.7e10, 1e11, 1e13):
        assert int(min(0.25, 16384 / n) * (1 << 53)) * n / (1 << 53) == pytest.approx(16384, rel=1e-3)


def test_links_in_dense_balls_and_tiles(spark):
    rng = random.Random(4)
    points = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        points |= {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(60)}
    points |= {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    prints = dict(enumerate(sorted(points)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints.values()]
    nodes = spark.createDataFrame(signed, "fp long")
    want = plain_groups(prints)
    for options in ({}, {"leaf_rows": 16}, {"leaf_rows": 10_000, "tile_rows": 50}):
        edges = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(spark, nodes, 3, **options).collect()]
        assert all(a != b for a, b in edges)
        number = {p: i for i, p in prints.items()}
        assert plain_components(prints, [(number[a], number[b]) for a, b in edges]) == want


def plain_components(nodes, edges):
    parent = {i: i for i in nodes}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in nodes}


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)] + [(7, x) for x in range(500, 700)] + [(5, 5)]
    out = {r["node"]: r["root"] for r in common.components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e}
    want = plain_components(nodes, edges)
    assert all(out.get(i, i) == want[i] for i in nodes)
    assert common.components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_defined_cases(spark):
    docs = documents(spark, ODD).unionByName(documents(spark, ["same text here"]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(documents(spark, [""]))
    out = simhash.near_duplicates(spark, docs).collect()
    assert len(out) == len(ODD) + 2
    zero = {r["component_id"] for r in out if r["fingerprint"] == "0" * 16}
    assert zero == {0}
    assert {r["component_id"] for r in out if r["doc_id"] in (10, 11, None)} == {10}
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


# --- op9


def test_urls(spark):
    rows = [
        (1, "HTTP://A.Example.COM/en/7/x?q"), (2, "http://b.com/en/1"), (3, "http://x.net/de/9#f"), (4, "http://sub.example.net/de/8"), (5, "https://spam.org/fr/"), (6, None), (7, "no scheme"),
        (8, "x://"), (9, "ftp://Host?path=/en/"), (10, "http://notcom/en/"), (11, "http://com/en/"), (5, "https://spam.org/fr/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    bad = spark.createDataFrame([(5, 1), (4, 0), (2, 0), (None, 1), (3, None)], "page_id long, bad int")
    out = {r["page_id"]: r for r in urls.judge(pages, bad).collect()}
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("a.example.com", "/en/7/x", "example.com/en/7", "allow")
    assert (out[2]["rule"], out[2]["verdict"]) == ("com/en/", "block") and (out[3]["rule"], out[3]["verdict"]) == ("net/de/", "allow")
    assert (out[4]["rule"], out[4]["verdict"]) == ("example.net/de/8", "block") and out[5]["rule"] is None
    assert (out[6]["host"], out[6]["path"], out[7]["host"]) == ("", "", "") and (out[9]["host"], out[9]["path"]) == ("host", "")
    assert out[10]["rule"] is None and out[11]["rule"] == "com/en/"
    assert urls.judge(pages, bad).count() == len(rows)
    assert urls.judge(pages, bad.limit(0)).where("verdict = 'block' and rule is null").count() == 0
    assert urls.judge(pages.limit(0), bad).count() == 0


def test_reputation_blocks_bad_hosts_only(spark):
    rows = [(i, f"http://{'bad' if i < 60 else 'good'}.site.org/p") for i in range(120)] + [(500 + i, f"http://h{i}.other.org/") for i in range(30)]
    outcomes = spark.createDataFrame([(i, int(i < 60 and i % 10 < 9)) for i in range(120)] + [(500 + i, 0) for i in range(30)], "page_id long, bad int")
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), outcomes)
    assert {r["host"] for r in out.where("verdict = 'block'").collect()} == {"bad.site.org"}


def test_spread_join_is_a_left_join(spark):
    rows = spark.createDataFrame([("a" if i % 3 == 0 else f"k{i % 50}" if i % 2 else "none", i) for i in range(3000)], "k string, i long")
    known = rows.where("k <> 'none'").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    known = known.where("n > 1")
    for parts in (1, 4, 512):  # none, one and all of the values are hot
        got = common.spread_join(rows, known, "k", "n", parts)
        assert got.columns == ["k", "i", "least"]
        want = rows.join(known.drop("n"), "k", "left")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select("k", "i", "least").collect()))
    assert common.spread_join(rows, known.limit(0), "k", "n").where("least is null").count() == 3000
    assert common.spread_join(rows.limit(0), known, "k", "n").count() == 0


# --- op10


def test_digest_column_is_base32_of_sha1(spark):
    texts = ["", "a", "é" * 1000, *(f"page {i}" for i in range(500))]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32(F.sha1(F.encode("t", "UTF-8"))).alias("d"))
    assert all(r["d"] == warc.digest_of(r["t"].encode()) for r in frame.collect())


def test_warc_round_trip(spark, tmp_path):
    texts = [(3, "u\r\nX: 1", "same"), (1, "u1", "same"), (2, None, "other é"), (4, "u4", None), (5, "u5", ""), (1, "u1", "same"), (None, "u6", "same"), (9, "u9", "x" * 400_000)]
    pages = spark.createDataFrame(texts, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("first", F.lit(2))
    bundles = warc.write_bundles(warc.marked(pages), bundle_bytes=300).cache()
    out = warc.read_bundles(bundles).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in out) == sorted((str(i), len((t or "").encode()), digest(t)) for i, _, t in texts)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in out)
    assert kinds == sorted([("3", "revisit", 1), ("1", "response", None), ("1", "response", None), ("2", "response", None), ("4", "response", None), ("5", "revisit", 4), ("None", "revisit", 1), ("9", "response", None)])
    body = {r["page_id"]: bytes(r["body"]) for r in out if r["record_type"] == "response"}
    assert body[2] == "other é".encode() and len(body[9]) == 400_000
    got = {r["page_id"]: bytes(r["record"]) for r in warc.fetch(bundles, spark.createDataFrame([(2,), (9,), (77,)], "page_id long")).collect()}
    assert set(got) == {2, 9} and warc.parse(got[2])[1] == "other é".encode()
    files = warc.export_bundles(bundles, f"file://{tmp_path}/out").collect()
    assert len(files) == bundles.count()
    assert warc.read_bundle_files(spark, f"file://{tmp_path}/out").count() == len(texts)
    assert warc.read_bundles(warc.write_bundles(warc.marked(pages.limit(0)))).count() == 0


def test_warc_query_against_plain_code(spark):
    rows = common.table(spark, SF, "pages").collect()
    first = {}
    for r in sorted(rows, key=lambda r: r["page_id"]):
        first.setdefault(r["html"] or "", r["page_id"])
    want = []
    for r in rows:
        data, to = (r["html"] or "").encode(), first[r["html"] or ""]
        again = to != r["page_id"]
        want.append((r["page_id"], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", to if again else None))
    got = [tuple(r)[:5] for r in warc.op10_warc(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_bundle_is_plain_zstandard():
    import zstandard

    data = warc.pack([b"one", b"two" * 100])
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"one" + b"two" * 100
    assert [n for _, _, n in warc.frames_of(data)] == [3, 300]


def test_frames_hold_several_records(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * (4000 if i == 5 else 3)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    bundles = warc.write_bundles(warc.marked(pages).coalesce(1), frame_bytes=2000).cache()
    index = [p for r in bundles.collect() for p in r["index"]]
    assert any(p["inside"] > 0 for p in index) and len({p["frame"] for p in index}) > 2
    got = {r["page_id"]: bytes(r["record"]) for r in warc.fetch(bundles, pages.select("page_id")).collect()}
    assert {i: warc.parse(r)[1].decode() for i, r in got.items()} == {r["page_id"]: r["html"] for r in pages.collect()}
    assert all(warc.parse(r)[2] == len(r) for r in got.values())
    assert warc.read_bundles(bundles).count() == 40


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = common.table(spark, SF, "documents")
    toxic = cp.drop_toxic(spark, docs, SF)
    model = toxicity.fit(spark, docs, common.table(spark, SF, "labels"))
    assert {r["doc_id"] for r in toxic.collect()} == {r["doc_id"] for r in toxicity.scores(docs, model).where("score < 0.5").collect()}
    unique = {r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, SF).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert unique == {rows[i][0] for i in plain_kept([t for _, t in rows])}
    clean = {r["doc_id"]: r["text"] for r in cp.redact(spark, docs, SF).collect()}
    for r in docs.collect():
        assert plain_spans(clean[r["doc_id"]]) == []
        if not plain_spans(r["text"]):
            assert clean[r["doc_id"]] == r["text"]
    assert all(f(spark, docs, SF).columns == cp.COLUMNS for _, f in cp.STAGES[:-1])
    probability = {r["doc_id"]: (r["keep_probability"], r["d"]) for r in mixing.sampling(spark, docs).withColumn("d", mixing.draw()).collect()}
    mixed = {r["doc_id"]: r["text"] for r in cp.mix(spark, docs, SF).collect()}
    assert mixed.keys() == {i for i, (p, d) in probability.items() if d < p}
    path, pattern = bpe.default_vocabulary()
    coder = bpe.Codec(open(path, "rb").read(), pattern)
    encoded = cp.encode(spark, docs, SF).collect()
    assert {r["doc_id"]: coder.decode(np.array(r["ids"])).decode() for r in encoded} == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(len(r["ids"]) == r["n_tokens"] for r in encoded)
    assert 0 < cp.run(spark, SF).count() < docs.count()


def test_pipeline_defined_cases(spark):
    import corpus_pipeline as cp

    docs = documents(spark, ODD).unionByName(documents(spark, ["x"]).withColumn("doc_id", F.lit(None).cast("long")))
    for _, stage in cp.STAGES:
        stage(spark, docs, SF).collect()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_keeps_one_row_of_repeated_ids_and_null_ids(spark):
    import corpus_pipeline as cp

    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, one)] * 5 + [(1, two), (2, two), (None, two), (None, three), (None, three), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    stage = dict(cp.STAGES)["near_duplicates"]
    assert sorted((r["text"], r["doc_id"]) for r in stage(spark, docs, SF).collect()) == [(one, 1), (two, 1), (three, None)]


def plain_kept(texts, least=0.8):
    sets = [set(copies.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            root = [root[i] if r == root[j] else r for r in root]
    return {min(i for i in range(len(texts)) if root[i] == r) for r in set(root)}


def test_pipeline_drops_planted_near_copies(spark):
    import corpus_pipeline as cp

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["sea", "tide", "wind"]) + str(rng.randrange(500)) for _ in range(300)) for _ in range(12)]
    for t in texts[:12]:
        for changes in (1, 3, 5, 6, 9, 12):  # from similarity 0.97 to 0.6 or so
            words = t.split()
            for i in range(changes):
                words[i * 24 + rng.randrange(20)] = "other"
            texts.append(" ".join(words))
    texts += ["", None, "a b", "A  b", "a b c"]
    kept = {r["doc_id"] for r in dict(cp.STAGES)["near_duplicates"](spark, documents(spark, texts), SF).collect()}
    assert kept == plain_kept(texts)
    assert not kept & set(range(12, 12 + 72, 6))


def test_tiles_and_hot_bands_lose_no_link(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(150):  # one family whose members have similarities of 0.5 to 0.95
        words = list(base)
        for i in rng.sample(range(200), rng.randint(1, 14)):
            words[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{rng.randrange(10**6)}" for _ in range(40)) for _ in range(20)]
    sets = [copies.shingle_set(t) for t in texts]
    want = plain_components(range(len(texts)), [(a, b) for a, b in combinations(range(len(texts)), 2) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))])
    frame = spark.createDataFrame([(i, s.view(np.int64).tolist(), len(s)) for i, s in enumerate(sets)], "id long, set array<long>, size int")
    clusters = frame.select("id", F.when(F.col("id") < 150, 0).otherwise(F.col("id")).cast("long").alias("cluster"))
    for tile in (2048, 20):
        edges = [tuple(r) for r in copies.linked(spark, clusters, frame, 0.8, tile_rows=tile).collect()]
        assert plain_components(range(len(texts)), edges) == want
    kind = "id long, size int, a long, b long, bands array<long>"
    nodes = spark.createDataFrame([(i, len(s), *copies.wide_print(s).tolist(), copies.bands(s).tolist()) for i, s in enumerate(sets)], kind)
    for rows, sample in ((2048, 100_000), (30, 100_000), (30, 1)):  # all at once, dealt, and blocks of a band that no sample shows
        got = plain_components(range(len(texts)), [tuple(r) for r in copies.tied(nodes, 0.8, rows, sample).collect()])
        assert all(got[a] == got[b] for a, b in want.items())


def test_detector_prints_as_json():
    assert json.loads(repr(pii.Detector([(0, 1.0, 0.1, -0.1)], {"ip": 0.2})))["thresholds"] == {"ip": 0.2}
