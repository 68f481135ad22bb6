"""Logger text formats as DataFrames.

Header lines are told from data by their content, never by a line number, so
large files stay splittable. Where the order of lines matters it comes from
the split offset and the position inside the split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.timecodes import DAY_US, from_date_vector
from ..operators import scan

# fixed values: missing-value codes of the loggers
SENTINELS = (-7999.0, -99999.0)


def _number(c: Column) -> Column:
    x = F.trim(F.regexp_replace(c, '"', "")).try_cast("double")
    return F.when(~F.isnan(x) & ~x.isin(*SENTINELS), x)


def read_lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def ordered_lines(spark: SparkSession, path) -> DataFrame:
    """Lines with ``pos``, an integer that increases along each file.

    A split is read by one task in order, and it holds fewer lines than bytes,
    so split offset plus line number inside the split is monotone.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"))
    first = raw.groupBy("file", "_start").agg(F.min("_id").alias("_first"))
    return raw.join(first, ["file", "_start"]).select("file", "value", (F.col("_start") + F.col("_id") - F.col("_first")).alias("pos"))


def scan_logger(spark: SparkSession, path, channels: list[str]) -> DataFrame:
    """Headerless logger table: date vector in the first four fields, then *channels*.

    Sentinels and unparsable fields are missing, short rows are padded and
    long ones trimmed, seconds are rounded to 0.01. Per file: equal stamps keep
    the first, a leading midnight row is dropped, rows beyond two days are cut,
    and a closing midnight row is added when it is missing.
    """
    parts = F.split("value", ",")
    lines = ordered_lines(spark, path).filter(F.trim("value") != "").withColumn("_p", parts)
    at = lambda i: _number(F.get("_p", F.lit(i)))
    rows = lines.select("file", "pos", from_date_vector(at(0), at(1), at(2), at(3)).alias("us"),
                        *[at(4 + i).alias(c) for i, c in enumerate(channels)]).filter("us is not null")
    first = rows.groupBy("file", "us").agg(F.min_by(F.struct(*channels), "pos").alias("_r")).select("file", "us", "_r.*")
    ends = first.groupBy("file").agg(F.min("us").alias("_lo"), F.max("us").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    kept = first.join(ends, "file").filter(~((F.col("us") == F.col("_lo")) & (F.pmod("us", F.lit(DAY_US)) == 0))).filter(
        F.col("us") <= F.col("_lo") + 2 * DAY_US)
    last = kept.groupBy("file").agg(F.max("us").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    closing = last.filter((F.col("_n") > 2) & (F.pmod("_hi", F.lit(DAY_US)) != 0)).select(
        "file", (F.col("_hi") + F.pmod(-F.col("_hi"), F.lit(DAY_US))).alias("us"))
    return kept.select("file", "us", *channels).unionByName(closing, allowMissingColumns=True)


def header_columns(spark: SparkSession, header_path, units_path=None) -> DataFrame:
    """Column dimension of header files: file, pos, name, height (last numeric run) and unit."""
    def fields(path):
        lines = read_lines(spark, path).filter(F.trim("value") != "")
        return lines.select("file", F.posexplode(F.split("value", ",")).alias("pos", "_f")).select("file", "pos", F.trim("_f").alias("name"))

    cols = fields(header_path)
    cols = cols.withColumn("height", sensor_height(F.col("name")))
    if units_path is None:
        return cols.withColumn("unit", F.lit(None).cast("string"))
    units = fields(units_path).select("pos", F.nullif("name", F.lit("")).alias("unit"))
    return cols.join(units, "pos", "left")


def sensor_height(name: Column) -> Column:
    """Height from the last numeric run of a column name; missing when there is none."""
    runs = F.regexp_extract_all(name, F.lit(r"([\d.]+)"), 1)
    return F.when(F.size(runs) > 0, F.try_element_at(runs, F.lit(-1)).try_cast("double"))


def scan_toa5(spark: SparkSession, path, columns: list[str]) -> DataFrame:
    """Quoted table files with four header lines; the timestamp is the first field, then the record number."""
    data = read_lines(spark, path).filter(F.col("value").rlike(r'^"?\d{4}-\d\d-\d\d'))
    p = F.split("value", ",")
    stamp = F.try_to_timestamp(F.regexp_replace(F.get(p, F.lit(0)), '"', ""))
    return data.select("file", F.unix_micros(stamp).alias("us"), F.get(p, F.lit(1)).try_cast("long").alias("record"),
                       *[_number(F.get(p, F.lit(2 + i))).alias(c) for i, c in enumerate(columns)])


def toa5_header(spark: SparkSession, path) -> DataFrame:
    """Column names and units of each file from its own header lines."""
    lines = read_lines(spark, path)
    clean = lambda c: F.trim(F.regexp_replace(c, '"', ""))
    def row(pattern, name):
        hit = lines.filter(F.col("value").rlike(pattern)).groupBy("file").agg(F.min("value").alias("_v"))
        return hit.select("file", F.posexplode(F.split("_v", ",")).alias("pos", "_f")).select("file", "pos", clean(F.col("_f")).alias(name))

    return row(r'^"?TIMESTAMP', "name").join(row(r'^"?TS"?,', "unit"), ["file", "pos"], "left")


def load_logger_files(spark: SparkSession, paths, columns: list[str], source: str | None = None, by_record: bool = False) -> DataFrame:
    """Several files as one table; of equal stamps of a source the first by (file, record) stays.

    *source* is a pattern whose group names the logger in a file's path; the
    name becomes the column ``source``. Without it all files are one logger's.
    With *by_record* the record number tells samples of one stamp apart, and
    only repeats of a record go.
    """
    df, keys = scan_toa5(spark, paths, columns), ["us"]
    if source:
        df, keys = df.withColumn("source", F.regexp_extract("file", source, 1)), ["source", "us"]
    keys += ["record"] if by_record else []
    rest = [c for c in ("file", "record", *columns) if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("file", "record")).alias("_r")).select(*keys, "_r.*")


def scan_stats_log(spark: SparkSession, path, columns: list[str]) -> DataFrame:
    """Whitespace log with DATE and TIME first; names and units rows do not start with a date."""
    data = read_lines(spark, path).filter(F.col("value").rlike(r"^\s*\d{4}-\d\d-\d\d\s"))
    p = F.split(F.trim("value"), r"\s+")
    return data.select("file", F.unix_micros(F.to_timestamp(F.concat_ws(" ", F.get(p, F.lit(0)), F.get(p, F.lit(1))))).alias("us"),
                       *[_number(F.get(p, F.lit(2 + i))).alias(c) for i, c in enumerate(columns)])


def scan_analyser(spark: SparkSession, path, fields: dict[str, int], date_pos: int = 7, time_pos: int = 8) -> DataFrame:
    """Fast analyser records: whitespace fields, stamp HH:MM:SS:mmm; the header block has no such stamp."""
    p = F.split(F.trim("value"), r"\s+")
    time = F.get(p, F.lit(time_pos))
    rows = read_lines(spark, path).filter(F.coalesce(time.rlike(r"^\d\d:\d\d:\d\d:\d+$"), F.lit(False)))
    whole = F.concat_ws(" ", F.get(p, F.lit(date_pos)), F.regexp_replace(time, r":(\d+)$", ""))
    ms = F.regexp_extract(time, r":(\d+)$", 1).cast("long")
    return rows.select("file", (F.unix_micros(F.to_timestamp(whole)) + ms * 1000).alias("us"),
                       *[_number(F.get(p, F.lit(i))).alias(c) for c, i in fields.items()])


def scan_met(spark: SparkSession, path, schema: str, columns: list[str]) -> DataFrame:
    """Headed CSV of minute records with year, day, HM (and second) columns."""
    raw = spark.read.schema(schema).option("header", True).csv(path)
    sec = F.col("second") if "second" in raw.columns else F.lit(0.0)
    num = lambda c: F.when(~F.isnan(c) & ~F.col(c).isin(*SENTINELS), F.col(c))
    return raw.select(from_date_vector(F.col("year"), F.col("day"), F.col("HM"), sec).alias("us"), *[num(c).alias(c) for c in columns])


CHANNELS = ("ax", "ay", "az", "gx", "gy", "gz", "roll", "pitch", "yaw")


def scan_tagged_log(spark: SparkSession, path, chunk: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """Records and per-file counts of a tagged log: lines A, G, E, closed by D.

    The record of a line is the number of D lines before it; the last line of
    each tag counts. Incomplete, malformed and pre-clock records are counted.
    """
    lines = ordered_lines(spark, path).withColumn("tag", F.substring("value", 1, 1))
    is_d = (F.col("tag") == "D").cast("long")
    tagged = scan.running(lines, ["file"], "pos", {"_closed": ("sum", is_d)}, chunk)
    tagged = tagged.withColumn("rec", F.col("_closed") - is_d)
    f = F.split(F.trim("value"), r"\s+")
    nums = F.array(*[F.get(f, F.lit(i)).try_cast("double") for i in (1, 2, 3)])
    good = (F.size(f) == 4) & (F.size(F.filter(nums, lambda x: x.isNull())) == 0)
    tagged = tagged.withColumns({"_v": F.when(good, nums), "_f": f})
    last = lambda tag: F.max_by(F.struct(F.col("_v").alias("v")), F.when(F.col("tag") == tag, F.col("pos")))
    bad = F.count(F.when(F.col("tag").isin("A", "G", "E") & F.col("_v").isNull(), 1))
    unknown = F.count(F.when(~F.col("tag").isin("A", "G", "E", "D"), 1))
    recs = tagged.groupBy("file", "rec").agg(
        last("A").alias("_a"), last("G").alias("_g"), last("E").alias("_e"), F.max(F.when(F.col("tag") == "D", F.col("_f"))).alias("_d"),
        bad.alias("bad_fields"), unknown.alias("unknown_tags"), F.count(F.lit(1)).alias("lines"))
    d = F.col("_d")
    ymd = F.split(F.get(d, F.lit(1)), "-")
    day = F.when((F.size(d) == 4) & (F.get(d, F.lit(2)) == "T:"), F.unix_date(F.try_make_timestamp(
        F.get(ymd, F.lit(0)).try_cast("int"), F.get(ymd, F.lit(1)).try_cast("int"), F.get(ymd, F.lit(2)).try_cast("int"),
        F.lit(0), F.lit(0), F.lit(0)).cast("date")))
    hms = F.split(F.get(d, F.lit(3)), ":")
    sec = F.split(F.get(hms, F.lit(2)), r"\.")
    part = lambda a, i: F.get(a, F.lit(i)).try_cast("long")
    clock = part(hms, 0) * 3600 + part(hms, 1) * 60 + part(sec, 0)
    ms = F.when(F.size(sec) > 1, part(sec, 1)).otherwise(0)
    shaped = (F.size(d) == 4) & (F.get(d, F.lit(2)) == "T:")
    complete = F.col("_a.v").isNotNull() & F.col("_g.v").isNotNull() & F.col("_e.v").isNotNull()
    recs = recs.withColumns({"_day": day, "_clock": F.when(F.size(hms) == 3, clock * 1000 + ms), "_complete": complete, "_shaped": shaped})
    status = (F.when(d.isNull(), "open").when(~F.col("_complete"), "incomplete").when(~F.col("_shaped"), "bad_field")
              .when(F.col("_day").isNull() | (F.col("_day") < 3652), "pre_rtc").when(F.col("_clock").isNull(), "bad_field").otherwise("ok"))
    recs = recs.withColumn("status", status)
    records = recs.filter("status = 'ok'").select(
        "file", "rec", (F.col("_day").cast("long") * DAY_US + F.col("_clock") * 1000).alias("us"),
        *[F.get(F.col(f"_{t}.v"), F.lit(i)).alias(CHANNELS[3 * j + i]) for j, t in enumerate("age") for i in range(3)])
    kinds = ("ok", "incomplete", "pre_rtc", "bad_field")
    stats = recs.groupBy("file").agg(
        F.sum("lines").alias("lines"), F.sum("unknown_tags").alias("unknown_tag_lines"), F.sum("bad_fields").alias("bad_value_lines"),
        *[F.count(F.when(F.col("status") == k, 1)).alias(f"records_{k}") for k in kinds])
    return records, stats


def scan_attitude_csv(spark: SparkSession, path, schema: str, columns: dict[str, str], time: str, lag_s: float = 0.0,
                      keys: tuple[str, ...] = ()) -> DataFrame:
    """Delimited attitude records: mapped columns, constant clock lag, first of equal stamps per *keys* (site, unit)."""
    raw = spark.read.schema(schema).option("header", True).csv(path)
    us = F.unix_micros(F.to_timestamp(time)) + int(round(lag_s * 1e6))
    rows = raw.select(*keys, us.alias("us"), *[F.col(src).cast("double").alias(out) for out, src in columns.items()], F.col("_metadata.file_path").alias("_f"))
    return rows.groupBy(*keys, "us").agg(F.min_by(F.struct(*columns), F.struct("_f", *columns)).alias("_r")).select(*keys, "us", "_r.*")
