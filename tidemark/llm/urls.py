"""URL filtering by explicit rules, else by empirical-Bayes host reputation.

Labelled outcomes (a page is bad or not) are counted by host, registered domain and suffix. Counts are beta-binomial: a
suffix is shrunk towards the whole (which starts from a bad rate of a tenth, of five pages), a domain towards its suffix, a host towards its domain, each by a prior whose strength
is the moment estimate of the overdispersion at that level. A host is blocked if the lower bound of its posterior bad rate
is over ``most_bad``. Unlabelled hosts get what their domain, suffix or the whole says.

Only aggregations (combined before the shuffle) and equi-joins on their keys are used. Counts and each level's posteriors are
written to the shared folder, so that no level computes those above again; pages of a very frequent host are spread over tasks.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and is judged as the host that is
empty; repeated pages count and come out once for each; labels that are null don't count and of contradicting labels of
an id the worse counts; without any label nothing is blocked by reputation. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialised, spread_join, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the query
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
Z = 1.645
LEVELS = ("suffix", "domain", "host")


def parts(pages: DataFrame) -> DataFrame:
    """``(page_id, host, path, domain, suffix)`` of every page."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rows = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    rows = rows.select("page_id", F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    return rows.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))


def rule_of(rules=RULES):
    """The longest fitting rule of a row as ``struct<verdict, rule>``, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    out = None
    for verdict, host, path in ordered:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        given = F.struct(F.lit(verdict).alias("verdict"), F.lit(host + path).alias("rule"))
        out = F.when(fits, given) if out is None else out.when(fits, given)
    return out


def reputation(pages: DataFrame, outcomes: DataFrame, most_bad: float = 0.3) -> DataFrame:
    """``(host, bad_rate, lower, blocked, pages)`` of every host of ``pages(page_id, host, domain, suffix)``.

    ``outcomes(page_id, bad 0/1)`` are the labels. A level's prior strength is the one at which the spread of its
    units' rates is what beta-binomial counts would show, between 1 and 1000.
    """
    spark = pages.sparkSession
    worst = outcomes.dropna().groupBy("page_id").agg(F.max("bad").cast("double").alias("bad"))
    counts = F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("x"), F.count("*").alias("pages")
    per = materialised(spark, pages.join(worst, "page_id", "left").groupBy("suffix", "domain", "host").agg(*counts), "url-counts")
    whole = F.broadcast(per.agg((F.sum("x") + 0.5).alias("gx"), (F.sum("n") + 5.0).alias("gn")))  # one row
    keys: list[str] = []
    above = None
    for level in LEVELS:
        keys = [*keys, level]
        units = per.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "x", "pages")))
        if above is None:
            units = units.crossJoin(whole).withColumn("prior", F.col("gx") / F.col("gn")).drop("gx", "gn")
        else:
            units = units.join(above, keys[:-1])
        # sum (x - n p)^2 = sum n p (1 - p) (1 + (n - 1) rho) over the units
        expected = F.col("n") * F.col("prior") * (1 - F.col("prior"))
        moments = units.agg(F.sum((F.col("x") - F.col("n") * F.col("prior")) ** 2).alias("seen"), F.sum(expected).alias("even"), F.sum(expected * (F.col("n") - 1)).alias("over"))
        rho = F.coalesce(F.try_divide(F.col("seen") - F.col("even"), F.col("over")), F.lit(0.0))
        strength = F.least(F.greatest(F.coalesce(F.try_divide(1 - rho, F.greatest(rho, F.lit(1e-9))), F.lit(1.0)), F.lit(1.0)), F.lit(1000.0))
        units = units.crossJoin(F.broadcast(moments.select(strength.alias("m"))))  # one row
        units = units.withColumn("a", F.col("x") + F.col("m") * F.col("prior")).withColumn("b", F.col("n") - F.col("x") + F.col("m") * (1 - F.col("prior")))
        last = materialised(spark, units.select(*keys, (F.col("a") / (F.col("a") + F.col("b"))).alias("prior"), "a", "b", "pages"), f"url-{level}")
        above = last.drop("a", "b", "pages")
    total = F.col("a") + F.col("b")
    lower = F.col("prior") - Z * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return last.select("host", F.col("prior").alias("bad_rate"), lower.alias("lower"), (lower > most_bad).alias("blocked"), "pages")


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, most_bad: float = 0.3) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bad_rate)`` of every page of ``pages(page_id, url)``."""
    rows = parts(pages)
    known = reputation(rows, outcomes, most_bad)
    said = spread_join(rows.withColumn("given", rule_of(rules)), known, "host", "pages")
    verdict = F.coalesce(F.col("given.verdict"), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return said.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is the quality label that carries its id."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), outcomes)


SQL = """
with p as (
  select page_id, case when url is not null and instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages
), q as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from p
), r as (
  select *, array_to_string(string_split(host, '.')[-2:], '.') domain, string_split(host, '.')[-1] suffix from q
), o as (
  select doc_id page_id, max(1 - quality)::double bad from labels where quality is not null and doc_id is not null group by 1
), per as (
  select suffix, domain, host, count(bad)::double n, coalesce(sum(bad), 0)::double x from r left join o using (page_id) group by all
), u1 as (
  select suffix, sum(n) n, sum(x) x, (select (sum(x) + 0.5) / (sum(n) + 5) from per) prior from per group by 1
), m1 as (
  select least(greatest((1 - rho) / greatest(rho, 1e-9), 1), 1000) m from (
    select coalesce((sum((x - n * prior) ** 2) - sum(n * prior * (1 - prior))) / nullif(sum(n * prior * (1 - prior) * (n - 1)), 0), 0) rho from u1)
), s1 as (select suffix, (x + m * prior) / (n + m) prior from u1, m1),
u2 as (
  select suffix, domain, sum(n) n, sum(x) x, any_value(s1.prior) prior from per join s1 using (suffix) group by all
), m2 as (
  select least(greatest((1 - rho) / greatest(rho, 1e-9), 1), 1000) m from (
    select coalesce((sum((x - n * prior) ** 2) - sum(n * prior * (1 - prior))) / nullif(sum(n * prior * (1 - prior) * (n - 1)), 0), 0) rho from u2)
), s2 as (select suffix, domain, (x + m * prior) / (n + m) prior from u2, m2),
u3 as (
  select per.*, s2.prior from per join s2 using (suffix, domain)
), m3 as (
  select least(greatest((1 - rho) / greatest(rho, 1e-9), 1), 1000) m from (
    select coalesce((sum((x - n * prior) ** 2) - sum(n * prior * (1 - prior))) / nullif(sum(n * prior * (1 - prior) * (n - 1)), 0), 0) rho from u3)
), s3 as (
  select host, x + m * prior a, n - x + m * (1 - prior) b from u3, m3
), rules(verdict, rhost, rpath) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit as (
  select page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) rule, arg_max(verdict, length(rhost || rpath)) verdict
  from (select distinct page_id, host, path from q), rules where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by all
)
select q.page_id, q.host, q.path, fit.rule,
       coalesce(fit.verdict, case when a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.3 then 'block' else 'allow' end) verdict,
       round(a / (a + b), 6) bad_rate
from q join s3 on s3.host = q.host
left join fit on fit.page_id is not distinct from q.page_id and fit.host = q.host and fit.path = q.path
"""
