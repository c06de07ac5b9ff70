"""Readers of the raw file forms and writers of results: station CSV, element files, gridded CSV, text tables, JSON and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import day_of_year_date

ELEMENTS = {"PRCP": "Rainfall", "TAVG": "Tavg", "TMAX": "Tmax", "TMIN": "Tmin"}


def station_daily(spark: SparkSession, path: str, variables: tuple[str, ...] = ("Rainfall", "Temperature", "Humidity", "Sunshine")) -> DataFrame:
    """CSV with Station, Year, Month, Day and variables; a date that doesn't exist is an error."""
    schema = "Station string, Year int, Month int, Day int, " + ", ".join(f"{v} double" for v in variables)
    rows = spark.read.csv(path, header=True, schema=schema)
    return rows.select(F.col("Station").alias("station"), F.make_date("Year", "Month", "Day").alias("date"), *variables)


def element_daily(spark: SparkSession, path: str, drop_failed: bool = True) -> DataFrame:
    """Headerless CSV of (id, yyyymmdd, element, value in tenths, flags): one row a day with a column for each element kept.

    Rows with a quality flag are dropped if asked; days without any row stay absent.
    """
    names = "id string, day string, element string, value double, mflag string, qflag string, sflag string, time string"
    rows = spark.read.csv(path, schema=names).where(F.col("element").isin(*ELEMENTS))
    if drop_failed:
        rows = rows.where(F.coalesce(F.trim("qflag"), F.lit("")) == "")
    day = rows.groupBy("id", F.to_date("day", "yyyyMMdd").alias("date")).pivot("element", sorted(ELEMENTS)).agg(F.first(F.col("value") / 10, ignorenulls=True))
    return day.withColumnsRenamed(ELEMENTS)


def shift_day(rows: DataFrame, column: str, keys: list[str], days: int = 1) -> DataFrame:
    """Move one column by days against the others, keeping days that only one side has."""
    moved = rows.select(*keys, F.date_add("date", days).alias("date"), column).where(F.col(column).isNotNull())
    return rows.drop(column).join(moved, [*keys, "date"], "full")


def weighted_merge(rows: DataFrame, keys: list[str], values: list[str], weight: str, mark: tuple[str, str] | None = None) -> DataFrame:
    """One row for each key: means weighted by ``weight`` over the rows that have the value, the weights' sum and the row count.

    ``mark`` is a column and a value: whether any row has it.
    """
    mean = lambda v: F.try_divide(F.sum(F.col(weight) * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col(weight))))
    more = [F.bool_or(F.col(mark[0]) == mark[1]).alias(f"any_{mark[1]}")] if mark else []
    return rows.groupBy(*keys).agg(*(mean(v).alias(v) for v in values), F.sum(weight).alias(weight), F.count("*").alias("n_rows"), *more)


def anomaly_ratio(value: str, usual: str) -> Column:
    """Percent of the usual value, where that is above zero."""
    return F.when(F.col(usual) > 0, 100 * F.try_divide(value, usual))


def gridded_dekads(spark: SparkSession, path: str, level: int = 2) -> DataFrame:
    """Ten-day rainfall by area: one administrative level, duplicate areas merged by pixels, with the ratios to normal."""
    values = ["rfh", "rfh_avg", "r1h", "r1h_avg", "r3h", "r3h_avg"]
    schema = "date date, adm_level int, PCODE string, n_pixels double, " + ", ".join(f"{v} double" for v in values) + ", version string"
    rows = spark.read.csv(path, header=True, schema=schema).where(F.col("adm_level") == level)
    merged = weighted_merge(rows, ["PCODE", "date"], values, "n_pixels", ("version", "prelim"))
    return merged.withColumns({"rfq": anomaly_ratio("rfh", "rfh_avg"), "r1q": anomaly_ratio("r1h", "r1h_avg"), "r3q": anomaly_ratio("r3h", "r3h_avg")})


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; ValueError if a key occurs twice."""
    twice = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {keys} occurs twice: {twice[0].asDict()}")
    return rows


def year_day(spark: SparkSession, path: str, variables: list[str], missing: float = -999.0) -> DataFrame:
    """CSV with YEAR and DOY; the sentinel is missing in every column and a day occurs once."""
    schema = "YEAR int, DOY int, " + ", ".join(f"{v} double" for v in variables)
    rows = spark.read.csv(path, header=True, schema=schema)
    return unique(rows.select(day_of_year_date("YEAR", "DOY").alias("date"), *(F.nullif(F.col(v), F.lit(missing)).alias(v) for v in variables)), ["date"])


def keyed_by_name(spark: SparkSession, glob: str, pattern: str, schema: str) -> DataFrame:
    """All CSV files of a glob, with the key that a pattern's first group finds in each file's name."""
    rows = spark.read.csv(glob, header=True, schema=schema)
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))  # Spark gives it as part of a URI
    return rows.select(F.regexp_extract(name, pattern, 1).alias("key"), *rows.columns)


def monthly_table(spark: SparkSession, path: str, missing_to: float = -99.0) -> DataFrame:
    """A text table: a line 'y0 y1', then lines of a year and twelve values; other lines are ignored. ``(date, value)``."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w"))
    number = r"^-?[0-9]+(\.[0-9]*)?([eE][-+]?[0-9]+)?$"
    head = lines.where((F.size("w") == 2) & F.forall("w", lambda x: x.rlike("^[0-9]{4}$"))).select(F.col("w")[0].cast("int").alias("y0"), F.col("w")[1].cast("int").alias("y1")).limit(1)
    rows = lines.where((F.size("w") == 13) & F.forall("w", lambda x: x.rlike(number)) & F.col("w")[0].rlike("^[0-9]{4}$"))
    rows = rows.join(F.broadcast(head), F.col("w")[0].cast("int").between(F.col("y0"), F.col("y1")))  # one row
    long = rows.select(F.col("w")[0].cast("int").alias("year"), F.posexplode(F.slice("w", 2, 12)).alias("m", "v"))
    value = F.col("v").cast("double")
    return long.select(F.make_date("year", F.col("m") + 1, F.lit(1)).alias("date"), F.when(value > missing_to, value).alias("value"))


def nested_json(spark: SparkSession, path: str, missing_to: float = -999.0) -> DataFrame:
    """``(date, parameter, value)`` of files like ``{"properties": {"parameter": {name: {yyyymmdd: value}}}}``."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "properties struct<parameter: map<string, map<string, double>>>").alias("j"))
    each = raw.select(F.explode("j.properties.parameter").alias("parameter", "days")).select("parameter", F.explode("days").alias("day", "v"))
    return each.select(F.to_date("day", "yyyyMMdd").alias("date"), "parameter", F.when(F.col("v") > missing_to, F.col("v")).alias("value"))


def fixed_width(spark: SparkSession, path: str, columns: dict[str, tuple[int, int]]) -> DataFrame:
    """Columns cut from [start, end) of every line, trimmed; an empty cell is missing."""
    return spark.read.text(path).select(*(F.nullif(F.trim(F.substring("value", a + 1, b - a)), F.lit("")).alias(n) for n, (a, b) in columns.items()))


def polygons(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """``(properties ..., ring array<array<double>>)`` of each outer ring in a GeoJSON file."""
    kinds = ", ".join(f"{p}: string" for p in properties)
    schema = f"features array<struct<properties: struct<{kinds}>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("features").alias("f"))
    return rows.select(*(F.col(f"f.properties.{p}").alias(p) for p in properties), F.col("f.geometry.coordinates")[0].alias("ring"))


def with_units_row(spark: SparkSession, path: str, columns: dict[str, str], key: str) -> DataFrame:
    """CSV whose first data row holds units: that row goes, and cells that are no number become missing."""
    rows = spark.read.csv(path, header=True).select(*columns)
    parsed = rows.select(*(F.expr(f"try_cast(trim(`{c}`) as {k})").alias(c) for c, k in columns.items()))
    return parsed.where(F.col(key).isNotNull())


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest ``order``."""
    top = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r"))
    return top.select("r.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def only_file(spark: SparkSession, folder: str, to: str) -> None:
    """Move the one data file that Spark wrote into ``folder`` to a name of one's own."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path(to).getParent())
    (part,) = [f.getPath() for f in store.listStatus(path(folder)) if f.getPath().getName().startswith("part-")]
    if not store.rename(part, path(to)):
        raise OSError(f"cannot move {part.toString()} to {to}")


def write_once(spark: SparkSession, frame: DataFrame, root: str, split: str, model: str, track: str, var: str) -> bool:
    """Write a forecast cache below ``root/split=/model=/track=/var=`` unless it is complete there; whether it wrote."""
    path = f"{root}/split={split}/model={model}/track={track}/var={var}"
    if exists(spark, f"{path}/_SUCCESS"):
        return False
    frame.write.mode("overwrite").parquet(path)
    return True


def append_records(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").json(path)


def write_report(frame: DataFrame, path: str) -> None:
    """A small board as one CSV file."""
    frame.coalesce(1).write.mode("overwrite").csv(path, header=True)


def latex_table(rows: list[dict], columns: list[str], best: dict[str, str] | None = None) -> str:
    """A LaTeX tabular of a small board; ``best`` names columns whose 'min' or 'max' is set bold."""
    def cell(c: str, v) -> str:
        text = "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("_", r"\_")
        values = [r[c] for r in rows if r[c] is not None] if best and c in best else []
        return rf"\textbf{{{text}}}" if values and v == (min if best[c] == "min" else max)(values) else text

    body = [" & ".join(cell(c, r[c]) for c in columns) + r" \\" for r in rows]
    return "\n".join([rf"\begin{{tabular}}{{{'l' + 'r' * (len(columns) - 1)}}}", " & ".join(c.replace("_", r"\_") for c in columns) + r" \\ \hline", *body, r"\end{tabular}"])
