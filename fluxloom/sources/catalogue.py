"""Column, sensor, unit and file dimensions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators import scan
from ..operators.quantiles import median_exceeds

# fixed values: linear scale and offset of each unit onto the internal unit of its quantity
UNITS = {
    "temperature": {"degc": (1.0, 0.0), "c": (1.0, 0.0), "k": (1.0, -273.15), "kelvin": (1.0, -273.15)},
    "humidity": {"%": (1.0, 0.0), "percent": (1.0, 0.0), "fraction": (100.0, 0.0), "1": (100.0, 0.0)},
    "pressure": {"kpa": (1.0, 0.0), "hpa": (0.1, 0.0), "mbar": (0.1, 0.0), "mb": (0.1, 0.0), "pa": (0.001, 0.0)},
    "h2o_density": {"gm-3": (1.0, 0.0), "kgm-3": (1000.0, 0.0), "mgm-3": (0.001, 0.0)},
    "co2_density": {"mgm-3": (1.0, 0.0), "gm-3": (1000.0, 0.0), "kgm-3": (1.0e6, 0.0), "ugm-3": (0.001, 0.0)},
}


def wildcard(pattern: str) -> str:
    """Regular expression of a wildcard: ``*`` any run, ``?`` one character, all else literal; whole name, any case."""
    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern) + "$"


def match_columns(columns: DataFrame, pattern: str) -> DataFrame:
    return columns.filter(F.col("name").rlike(wildcard(pattern)))


def sensor_catalogue(columns: DataFrame, template: dict[str, str], sonics: DataFrame | None = None) -> DataFrame:
    """Field of each header column by its template, with bearing and maker of its sonic height."""
    fields = F.filter(F.array(*[F.when(F.col("name").rlike(wildcard(p)), F.lit(f)) for f, p in template.items() if p]), lambda x: x.isNotNull())
    out = columns.withColumn("field", F.explode(fields))
    if sonics is None:
        return out
    key = F.round(F.col("height") * 100).cast("long")
    s = sonics.select(key.alias("_h"), "bearing", "maker")
    return out.withColumn("_h", key).join(s, "_h", "left").drop("_h")


def parse_label(label: Column) -> tuple[Column, Column]:
    """Height and name of ``name_<h>`` or ``<h> m: name``; no height gives (missing, label)."""
    tail, head = r"^(.*)_(\d+(?:\.\d+)?)$", r"^(\d+(?:\.\d+)?)\s*m\s*:?\s*(.+)$"
    t = F.trim(label)
    height = F.when(t.rlike(tail), F.regexp_extract(t, tail, 2)).when(t.rlike(head), F.regexp_extract(t, head, 1)).try_cast("double")
    name = F.when(t.rlike(tail), F.regexp_extract(t, tail, 1)).when(t.rlike(head), F.regexp_extract(t, head, 2)).otherwise(t)
    return height, name


def to_levels(wide: DataFrame, keys, columns: list[str], fields: list[str]) -> DataFrame:
    """Wide columns ``<field>_<height>`` to one row per (keys, height) with a column per field."""
    long = wide.unpivot(list(keys), [F.col(f"`{c}`") for c in columns], "_label", "_value")
    h, n = parse_label(F.col("_label"))
    return long.select(*keys, h.alias("height"), n.alias("field"), "_value").groupBy(*keys, "height").pivot("field", fields).agg(F.first("_value"))


def to_wide(levels: DataFrame, keys, heights: list[float], fields: list[str]) -> DataFrame:
    """Level rows to columns ``<field>_<height>`` in registry order."""
    aggs = [F.max(F.when(F.abs(F.col("height") - h) <= 0.01, F.col(f))).alias(f"{f}_{h:g}") for f in fields for h in heights]
    return levels.groupBy(*keys).agg(*aggs)


def map_columns(df: DataFrame, keys, mapping: dict[str, str]) -> DataFrame:
    """Output names from source columns; an absent source gives a missing column, a repeated output an error."""
    outs = list(mapping)
    if len(set(outs)) != len(outs) or set(outs) & set(keys):
        raise ValueError("duplicate output column")
    return df.select(*keys, *[(F.col(s).cast("double") if s in df.columns else F.lit(None).cast("double")).alias(o) for o, s in mapping.items()])


def unit_name(unit: Column) -> Column:
    """A unit in the spelling of the table: small letters, no blanks or carets, degrees in words, negative powers."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(F.lower(unit), "º", "°"), "[ ^_]", ""), "°", "deg")
    return F.regexp_replace(plain, "/m([23])", "m-$1")


def to_internal(value: Column, unit: Column, quantity: str, target: str | None = None) -> Column:
    """Value in the internal (or target) unit, by a lookup of the line (scale, offset) of its unit.

    Without a declared unit the value stays; an unknown one raises an error.
    """
    lines = F.create_map(*[x for name, (scale, offset) in UNITS[quantity].items()
                           for x in (F.lit(name), F.struct(F.lit(float(scale)).alias("scale"), F.lit(float(offset)).alias("offset")))])
    name = unit_name(unit)
    line = F.try_element_at(lines, F.nullif(name, F.lit("")))
    internal = value * line["scale"] + line["offset"]
    if target:
        scale, offset = UNITS[quantity][target]
        internal = (internal - offset) / scale
    unknown = F.raise_error(F.concat(F.lit(f"{quantity}: unknown unit "), unit)).cast("double")
    return F.when(F.coalesce(name, F.lit("")) == "", value).when(line.isNull(), unknown).otherwise(internal)


# fixed values: how a series without a declared unit is read, by (quantity, target): the unit that a median beyond the limit means
UNDECLARED = {("temperature", "degc"): ("above", 250.0, "k"), ("temperature", "k"): ("below", 200.0, "degc"), ("humidity", "%"): None,
              ("pressure", "kpa"): ("above", 200.0, "hpa"), ("h2o_density", "gm-3"): None, ("co2_density", "mgm-3"): None}


def _declared(unit: Column) -> Column:
    return F.nullif(unit_name(F.coalesce(unit, F.lit(""))), F.lit(""))


def unit_problem(unit: Column, quantity: str, target: str) -> Column:
    """Why a series of this unit cannot be converted to *target*; NULL if it can. Undeclared units need a fallback."""
    name = _declared(unit)
    none = F.lit(None).cast("string") if (quantity, target) in UNDECLARED else F.lit(f"{quantity}: no unit declared")
    return F.when(name.isNull(), none).when(~name.isin(*UNITS[quantity]), F.concat(F.lit(f"{quantity}: unknown unit "), unit))


def convert_series(df: DataFrame, keys, col: str, unit: str, quantity: str, target: str) -> DataFrame:
    """*col* in the *target* unit: by its declared unit, else as the size of its median per series tells (`UNDECLARED`).

    Values whose unit has a problem (`unit_problem`) become missing. Only the undeclared series need the median.
    """
    name, rule = _declared(F.col(unit)), UNDECLARED.get((quantity, target))
    scale, offset = UNITS[quantity][target]
    read_as = lambda u: ((F.col(col) * UNITS[quantity][u][0] + UNITS[quantity][u][1]) - offset) / scale if u != target else F.col(col)
    plain = F.col(col) if (quantity, target) in UNDECLARED else F.lit(None).cast("double")
    if rule:
        side, limit, other = rule
        bare = F.when(name.isNull(), F.col(col))
        above = median_exceeds(bare, limit)
        beyond = above if side == "above" else median_exceeds(-bare, -limit)
        df = df.join(df.groupBy(*keys).agg(beyond.alias("_beyond")), list(keys))
        plain = F.when(F.col("_beyond"), read_as(other)).otherwise(F.col(col))
    value = F.when(name.isNull(), plain)
    for u in UNITS[quantity]:
        value = value.when(name == u, read_as(u))
    return df.withColumn(col, value).drop("_beyond")


def clean_unit(unit: Column) -> Column:
    """Placeholder cells of a table export mean no unit."""
    u = F.trim(F.regexp_replace(unit, "[\"']", ""))
    return F.when(u.rlike("^Unnamed:") | (F.lower(u) == "nan") | (u == ""), None).otherwise(u)


def resolve_units(columns: DataFrame, declared: DataFrame) -> DataFrame:
    """Unit per column: a declared unit overrides the file's own units row."""
    d = declared.select("name", clean_unit(F.col("unit")).alias("_declared"))
    return columns.join(d, "name", "left").withColumn("unit", F.coalesce("_declared", clean_unit(F.col("unit")))).drop("_declared")


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old product names to the registry names; names already current stay."""
    return df.withColumnsRenamed(names)


def file_dates(files: DataFrame) -> DataFrame:
    """Table and day of files named ``..._<table>_<yyyymmddHHMMSS>...``."""
    name = F.element_at(F.split("file", "/"), -1)
    pat = r"^(?:.*_)?([A-Za-z0-9]+)_(\d{8})\d{6}"
    return files.withColumns({"table": F.regexp_extract(name, pat, 1), "_d": F.regexp_extract(name, pat, 2)}).filter("_d <> ''").withColumn(
        "day", F.to_date("_d", "yyyyMMdd")).drop("_d")


def date_table_catalogue(files: DataFrame, tables: list[str]) -> DataFrame:
    """One row per day with the file of each table; days without any file do not occur."""
    return file_dates(files).groupBy("day").pivot("table", tables).agg(F.max("file"))


def file_spans(records: DataFrame, keys, file: str, us: str) -> DataFrame:
    """First stamp of each file and of the next one of its source: the interval its records may cover."""
    keys = list(keys)
    lo = records.groupBy(*keys, file).agg(F.min(us).alias("first_us"))
    w = W.partitionBy(*keys).orderBy("first_us")
    return lo.withColumn("next_us", F.lead("first_us").over(w))


def files_for_windows(spans: DataFrame, windows: DataFrame, keys, bucket_us: int = 86_400_000_000) -> DataFrame:
    """Files of a source that start inside a window, and the last one before it, whose tail may reach in.

    Starts meet windows in buckets of *bucket_us*: a file lies in one, a window in those it touches, so candidates grow
    with the files, not with files times windows. The file before a window comes from one scan of starts and windows in order.
    """
    keys = list(keys)
    bucket = lambda c: F.expr(f"({c} - pmod({c}, {bucket_us})) div {bucket_us}")
    touched = windows.withColumn("_bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    starts = spans.withColumn("_bucket", bucket("first_us"))
    inside = touched.join(starts, [*keys, "_bucket"]).filter(F.col("first_us").between(F.col("lo"), F.col("hi"))).drop("_bucket")
    other = [c for c in spans.columns if c not in keys]
    # of files that start together only the last in order can reach beyond its start
    reaching = spans.filter(F.col("next_us").isNull() | (F.col("next_us") > F.col("first_us")))
    stacked = reaching.select(*keys, F.col("first_us").alias("_at"), F.lit(1).alias("_side"), F.struct(*other).alias("_file")).unionByName(
        windows.select(*keys, F.col("lo").alias("_at"), F.lit(0).alias("_side"), F.struct(*[c for c in windows.columns if c not in keys]).alias("_window")),
        allowMissingColumns=True)
    seen = scan.brackets(stacked, keys, "_at", ["_file"], 400 * bucket_us, ["_side"]).filter("_side = 0 AND before__file IS NOT NULL")
    tail = seen.select(*keys, "_window.*", "before__file.x.*")
    return inside.unionByName(tail.select(inside.columns))


def recovered_coverage(records: DataFrame, spans: DataFrame, windows: DataFrame, keys, file: str, us: str, expected: float) -> DataFrame:
    """Coverage of each span with the records of every file that overlaps it, not only its own."""
    keys = list(keys)
    picked = files_for_windows(spans, windows, keys).select(*keys, file, "win", "lo", "hi")
    rows = records.join(picked, [*keys, file]).filter(F.col(us).between(F.col("lo"), F.col("hi")))
    return rows.groupBy(*keys, "win").agg(F.countDistinct(file).alias("n_files"), (F.count(F.lit(1)) / expected).alias("coverage"))
