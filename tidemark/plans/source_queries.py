"""Sources and sinks as queries: each writes a table in a raw form to shared storage and reads it back through its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import scratch
from tidemark.sources import files
from tidemark.sources.tracks import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(text: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = text
        return f

    return add


def place(spark, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def daily(spark, d: str) -> DataFrame:
    """Orders by status and day: the greatest price and the count."""
    day = F.to_date("o_orderdate").alias("date")
    return table(spark, d, "orders").groupBy("o_orderstatus", day).agg(F.max("o_totalprice").alias("peak"), F.count("*").cast("double").alias("n"))


@query("""select o_orderstatus station, o_orderdate::date date, max(o_totalprice) "Rainfall", count(*)::double "Temperature" from orders group by all""")
def s1_station_csv(spark, d):
    path = place(spark, "stations")
    rows = daily(spark, d).select(F.col("o_orderstatus").alias("Station"), F.year("date").alias("Year"), F.month("date").alias("Month"), F.day("date").alias("Day"), F.col("peak").alias("Rainfall"), F.col("n").alias("Temperature"))
    rows.write.csv(path, header=True)
    return files.station_daily(spark, path, ("Rainfall", "Temperature"))


@query("""select o_orderstatus id, o_orderdate::date date, count(*) / 10 "Rainfall", case when day(o_orderdate) <> 13 then max(o_totalprice) / 10 end "Tmax" from orders group by 1, 2, day(o_orderdate)""")
def s2_element_files(spark, d):
    """Compressed files without a header; flagged rows and other elements are left out."""
    path = place(spark, "elements")
    of = daily(spark, d).select("o_orderstatus", F.date_format("date", "yyyyMMdd").alias("day"), F.explode(F.create_map(F.lit("PRCP"), F.col("n"), F.lit("TMAX"), F.col("peak"), F.lit("SNOW"), F.lit(1.0))).alias("element", "value"))
    flag = F.when((F.col("element") == "TMAX") & F.col("day").endswith("13"), "I").otherwise("")
    of.select("o_orderstatus", "day", "element", "value", F.lit("").alias("m"), flag.alias("q"), F.lit("S").alias("s"), F.lit("").alias("t")).write.csv(path, compression="gzip")
    return files.element_daily(spark, path).select("id", "date", "Rainfall", "Tmax")


@query("""select *, case when rfh_avg > 0 then round(100 * rfh / rfh_avg, 3) end rfq from (
  select o_orderpriority "PCODE", o_orderdate::date date, round(sum(w * h) / sum(case when h is not null then w end), 3) rfh, round(sum(w * a) / sum(w), 3) rfh_avg, sum(w) n_pixels, count(*) n_rows, bool_or(o_orderkey % 3 = 0) any_prelim
  from (select *, (o_custkey % 7 + 1)::double w, case when o_orderkey % 5 <> 0 then (o_custkey % 100)::double end h, (o_custkey % 9)::double a from orders where o_orderstatus <> 'F') group by 1, 2)""")
def s3_gridded_csv(spark, d):
    path = place(spark, "grid")
    o = table(spark, d, "orders")
    h, a = F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_custkey") % 100).cast("double")), (F.col("o_custkey") % 9).cast("double")
    o.select(
        F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("adm_level"), F.col("o_orderpriority").alias("PCODE"), (F.col("o_custkey") % 7 + 1).cast("double").alias("n_pixels"),
        *(x.alias(n + s) for n in ("rfh", "r1h", "r3h") for x, s in ((h, ""), (a, "_avg"))), F.when(F.col("o_orderkey") % 3 == 0, "prelim").otherwise("final").alias("version"),
    ).write.csv(path, header=True)
    g = files.gridded_dekads(spark, path).withColumns({"rfh": F.round("rfh", 3), "rfh_avg": F.round("rfh_avg", 3)})
    return g.select("PCODE", "date", "rfh", "rfh_avg", "n_pixels", "n_rows", "any_prelim", F.round(files.anomaly_ratio("rfh", "rfh_avg"), 3).alias("rfq"))


@query("""select o_orderdate::date date, case when count(*) % 2 = 1 then count(*)::double end n, max(o_totalprice) peak from orders group by 1""")
def s4_year_day_csv(spark, d):
    path = place(spark, "yearday")
    day = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("peak"))
    day.select(F.year("date").alias("YEAR"), F.dayofyear("date").alias("DOY"), F.when(F.col("n") % 2 == 1, F.col("n")).otherwise(-999).cast("double").alias("n"), "peak").write.csv(path, header=True)
    return files.year_day(spark, path, ["n", "peak"])


@query("""select make_date(y, m, 1) date, nullif(count(o_orderkey), 0)::double value from (select unnest(range(1996, 2001))::int y) cross join (select unnest(range(1, 13))::int m)
  left join orders on year(o_orderdate) = y and month(o_orderdate) = m group by y, m""")
def s5_monthly_text(spark, d):
    """A table of 1996 to 2000; the years around it stand in the file too and are ignored."""
    path = place(spark, "monthly")
    o = table(spark, d, "orders")
    years = o.withColumn("m", F.month("o_orderdate")).groupBy(F.year("o_orderdate").alias("y")).pivot("m", list(range(1, 13)))
    lines = years.count().select(F.concat_ws(" ", "y", *(F.coalesce(F.col(str(m)), F.lit(-99.9)) for m in range(1, 13))).alias("value"))
    head = spark.createDataFrame([(" 1996 2000",), ("counts of orders",)], "value string")
    head.unionByName(lines).write.text(path)
    return files.monthly_table(spark, path)


@query("""select r_name key, s_suppkey, s_acctbal from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def s6_keyed_files(spark, d):
    """A file for each region; the key stands in the file's name alone."""
    path = place(spark, "keyed")
    regions = table(spark, d, "region")
    nations = table(spark, d, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    rows = table(spark, d, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    names = sorted(r["r_name"] for r in regions.select("r_name").distinct().collect())
    for name in names:
        rows.where(F.col("r_name") == name).select("s_suppkey", "s_acctbal").coalesce(1).write.csv(f"{path}/parts/{name}", header=True)
        files.only_file(spark, f"{path}/parts/{name}", f"{path}/all/point_{name}.csv")
    return files.keyed_by_name(spark, f"{path}/all/*.csv", r"^point_(.*)\.csv$", "s_suppkey long, s_acctbal double")


@query("""select o_orderdate::date date, unnest(['n', 'peak']) parameter, unnest([case when count(*) % 4 <> 0 then count(*)::double end, max(o_totalprice)]) "value" from orders group by 1""")
def s7_nested_json(spark, d):
    """A file for each year, shaped as a point service answers."""
    path = place(spark, "points")
    day = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("peak"))
    n = F.when(F.col("n") % 4 == 0, -999.0).otherwise(F.col("n").cast("double"))
    days = lambda v: F.map_from_entries(F.collect_list(F.struct(F.date_format("date", "yyyyMMdd"), v)))
    year = day.groupBy(F.year("date").alias("year")).agg(days(n).alias("n"), days(F.col("peak")).alias("peak"))
    body = F.to_json(F.struct(F.struct(F.struct("n", "peak").alias("parameter")).alias("properties")))
    year.select("year", body.alias("value")).repartition("year").write.partitionBy("year").text(path)
    return files.nested_json(spark, f"{path}/*/*.txt")


@query("""select n_nationkey::varchar id, n_name "name", case when n_regionkey > 0 then n_regionkey::varchar end region from nation""")
def s8_fixed_width(spark, d):
    path = place(spark, "fixed")
    line = F.concat(F.rpad(F.col("n_nationkey").cast("string"), 4, " "), F.rpad("n_name", 26, " "), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey").cast("string")).otherwise(" "))
    table(spark, d, "nation").select(line.alias("value")).write.text(path)
    return files.fixed_width(spark, path, {"id": (0, 4), "name": (4, 30), "region": (30, 31)})


@query("""select n_name "name", 5 corners, n_nationkey::double x0, n_regionkey::double y0, n_nationkey + 1.0::double x1 from nation""")
def s9_geojson(spark, d):
    """A unit square for each nation, all in one collection."""
    path = place(spark, "squares")
    x, y = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    ring = F.array(F.array(x, y), F.array(x + 1, y), F.array(x + 1, y + 1), F.array(x, y + 1), F.array(x, y))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("unused")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    whole = table(spark, d, "nation").agg(F.collect_list(feature).alias("features"))  # 25 rows
    whole.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.text(path)
    at = lambda i, j: F.col("ring")[i][j]
    return files.polygons(spark, path, ["name"]).select("name", F.size("ring").alias("corners"), at(0, 0).alias("x0"), at(0, 1).alias("y0"), at(1, 0).alias("x1"))


@query("""select s_suppkey::varchar sid, s_acctbal lat from supplier where s_suppkey % 10 <> 0""")
def s10_units_row(spark, d):
    path = place(spark, "units")
    s = table(spark, d, "supplier")
    lat = F.when(F.col("s_suppkey") % 10 == 0, "unknown").otherwise(F.concat(F.lit(" "), F.col("s_acctbal").cast("string")))
    units = spark.createDataFrame([(" ", "note", "degrees_north")], "sid string, note string, lat string")
    units.unionByName(s.select(F.col("s_suppkey").cast("string").alias("sid"), F.lit("x").alias("note"), lat.alias("lat"))).write.csv(path, header=True)
    return files.with_units_row(spark, path, {"sid": "string", "lat": "double"}, "lat")


@query("""select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1""")
def s11_latest_record(spark, d):
    return files.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("""select l_returnflag, count(*) n, max(l_quantity) peak from lineitem where l_shipdate >= '1997-01-01' group by 1""")
def s12_s13_projected_scan(spark, d):
    """Reads three columns; the date reaches the scan as a filter."""
    return table(spark, d, "lineitem").where("l_shipdate >= timestamp'1997-01-01'").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.max("l_quantity").alias("peak"))


@query("""select n_regionkey, count(*) * 2 n, (sum(n_nationkey) * 2)::bigint keys from nation group by 1""")
def s16_appended_records(spark, d):
    path = place(spark, "log")
    for _ in range(2):
        files.append_records(table(spark, d, "nation"), path)
    return spark.read.schema("n_nationkey long, n_name string, n_regionkey int").json(path).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))


@query("""select split, 'naive' model, 'orders' track, o_orderstatus var, true first_wrote, false second_wrote, count(*) n, max(o_totalprice) peak from orders cross join (select unnest(['test', 'val']) split) group by 1, 4""")
def s17_s18_forecast_cache(spark, d):
    """Each (split, variable) is written once; a second run finds it complete and leaves it."""
    path = place(spark, "cache")
    rows = table(spark, d, "orders")
    wrote = []
    for split in ("test", "val"):
        for var in ("F", "O", "P"):
            own = rows.where(F.col("o_orderstatus") == var).select("o_totalprice")
            wrote.append((split, var, *(files.write_once(spark, own, path, split, "naive", "orders", var) for _ in range(2))))
    said = F.broadcast(spark.createDataFrame(wrote, "split string, var string, first_wrote boolean, second_wrote boolean"))  # six rows
    n = spark.read.parquet(path).groupBy("split", "model", "track", "var").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("peak"))
    return n.join(said, ["split", "var"])


@query("""select o_orderstatus model, count(*) n, max(o_totalprice) peak from orders group by 1""")
def s19_csv_report(spark, d):
    path = place(spark, "report")
    board = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("peak"))
    files.write_report(board, path)
    return spark.read.csv(path, header=True, schema="model string, n long, peak double")


@query(r"""select line_no::int line_no, line from (select 0 line_no, '\begin{tabular}{lrr}' line union all select 1, 'region & n & keys \\ \hline' union all select 99, '\end{tabular}'
  union all select n_regionkey + 2, n_regionkey || ' & ' || case when count(*) = max(count(*)) over () then '\textbf{' || count(*) || '}' else count(*)::varchar end || ' & ' || sum(n_nationkey) || ' \\' from nation group by n_regionkey)""")
def s20_latex_table(spark, d):
    """The lines of the table; the body's are numbered by region."""
    board = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))
    rows = [r.asDict() for r in board.orderBy("region").collect()]  # a report's rows
    head, names, *body, end = files.latex_table(rows, ["region", "n", "keys"], {"n": "max"}).split("\n")
    numbered = [(0, head), (1, names), *((r["region"] + 2, line) for r, line in zip(rows, body)), (99, end)]
    return spark.createDataFrame(numbered, "line_no int, line string")


@query("""select r_name, sha256(string_agg(n_name, chr(10) order by n_name) || chr(10)) sha256 from nation join region on n_regionkey = r_regionkey group by 1""")
def s21_checksums(spark, d):
    path = place(spark, "sums")
    rows = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    content = rows.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "\n").alias("value"))
    content.repartition("r_name").write.partitionBy("r_name").text(path)
    name = F.url_decode(F.regexp_extract("path", "r_name=([^/]*)/", 1))
    return files.manifest(spark, f"{path}/*/*.txt").select(name.alias("r_name"), "sha256")


EVENTS = """days as (select o_orderdate::date date, count(*) n from orders group by 1), flagged as (select *, n > (select avg(n) from days) hot from days),
  marked as (select *, sum(case when hot and not coalesce(was, false) then 1 else 0 end) over (order by date) event from (select *, lag(hot) over (order by date) was from flagged))"""


@query(f"""with {EVENTS} select event::bigint event, min(l_shipdate::date) first_day, max(l_shipdate::date) last_day, count(*) lines from lineitem join marked on marked.date = l_shipdate::date and hot group by 1""")
def j16_events_by_date(spark, d):
    """Event ids of days with many orders, joined to the lines shipped on those days."""
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    mean = F.broadcast(days.agg(F.avg("n").alias("mean")))  # one row
    w = Window.orderBy("date")  # one row a calendar day, whatever the scale
    hot = days.crossJoin(mean).withColumn("hot", F.col("n") > F.col("mean"))
    start = (F.col("hot") & ~F.coalesce(F.lag("hot").over(w), F.lit(False))).cast("int")
    marked = hot.withColumn("start", start).withColumn("event", F.sum("start").over(w)).where("hot").select("date", "event")
    lines = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count("*").alias("n"))
    return lines.join(marked, "date").groupBy("event").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.sum("n").alias("lines"))
