"""Tower, window, platform and product layouts derived from the driver tables.

Each layout exists twice: as a DataFrame and as the SQL text of the same
projection, so a checked query and its SQL twin start from equal inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
# a scan chunk holds at most (sampling rate x chunk length) rows of one series
CHUNK_US = 6 * HOUR_US

KEYS = ["site", "height"]
PERIOD = ["site", "height", "period_us"]


def tower(events: DataFrame) -> DataFrame:
    """One row per sample: site, height, stamp and the channels of one sonic level."""
    k = F.get_json_object("props", "$.k").cast("int")
    w8 = (F.pmod(F.col("user_id"), F.lit(17)) - 8).cast("double")
    value = F.col("value")
    base = events.select(
        "event_id",
        F.when(F.pmod(F.col("user_id"), F.lit(2)) == 0, "north").otherwise("south").alias("site"),
        F.expr("CASE event_type WHEN 'view' THEN 2.0D WHEN 'click' THEN 4.5D WHEN 'signup' THEN 10.85D "
               "WHEN 'purchase' THEN 20.0D ELSE 32.18D END").alias("height"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        value, w8.alias("w8"), k.alias("k"))
    k = F.col("k")
    w8 = F.col("w8")
    root = F.sqrt(F.col("value"))
    return base.select(
        "event_id", "site", "height", "us", "value", "k",
        F.expr(f"us + pmod(-us, {DAY_US})").alias("period_us"),
        F.when(k != 7, 4.0 + root / 5.0 + 0.05 * w8).alias("u"),
        F.when(k != 11, (k - 50) / 50.0 + F.sqrt(k + 1.0) / 10.0).alias("v"),
        (w8 / 10.0 - root / 30.0).alias("w"),
        F.when(k != 29, 14.0 + F.sqrt(k + 2.0) + w8 / 8.0).alias("ts_c"),
        F.when(k != 13, 8.0 + w8 / 10.0 + F.sqrt(k + 3.0) / 3.0).alias("h2o"),
        (720.0 - 2.0 * w8 + root).alias("co2"),
        (14.5 + F.sqrt(k + 2.0) + w8 / 9.0 - root / 9.0).alias("fw"),
        (99.0 + F.sqrt(k + 5.0) / 100.0).alias("p_kpa"),
        (k >= 97).cast("int").alias("diag"),
        (1.0 - k / 200.0).alias("signal"),
    )


_TOWER = f"""tower AS (
 SELECT event_id, site, height, us, value, k,
   CASE WHEN us % {DAY_US} = 0 THEN us ELSE us - us % {DAY_US} + {DAY_US} END AS period_us,
   CASE WHEN k <> 7 THEN 4.0::DOUBLE + sqrt(value) / 5.0::DOUBLE + 0.05::DOUBLE * w8 END AS u,
   CASE WHEN k <> 11 THEN (k - 50) / 50.0::DOUBLE + sqrt(k + 1.0::DOUBLE) / 10.0::DOUBLE END AS v,
   w8 / 10.0::DOUBLE - sqrt(value) / 30.0::DOUBLE AS w,
   CASE WHEN k <> 29 THEN 14.0::DOUBLE + sqrt(k + 2.0::DOUBLE) + w8 / 8.0::DOUBLE END AS ts_c,
   CASE WHEN k <> 13 THEN 8.0::DOUBLE + w8 / 10.0::DOUBLE + sqrt(k + 3.0::DOUBLE) / 3.0::DOUBLE END AS h2o,
   720.0::DOUBLE - 2.0::DOUBLE * w8 + sqrt(value) AS co2,
   14.5::DOUBLE + sqrt(k + 2.0::DOUBLE) + w8 / 9.0::DOUBLE - sqrt(value) / 9.0::DOUBLE AS fw,
   99.0::DOUBLE + sqrt(k + 5.0::DOUBLE) / 100.0::DOUBLE AS p_kpa,
   CASE WHEN k >= 97 THEN 1 ELSE 0 END AS diag,
   1.0::DOUBLE - k / 200.0::DOUBLE AS signal
 FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'north' ELSE 'south' END AS site,
         CASE event_type WHEN 'view' THEN 2.0::DOUBLE WHEN 'click' THEN 4.5::DOUBLE
           WHEN 'signup' THEN 10.85::DOUBLE WHEN 'purchase' THEN 20.0::DOUBLE
           ELSE 32.18::DOUBLE END AS height,
         epoch_us(ts) AS us, value, (user_id % 17 - 8)::DOUBLE AS w8,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k
       FROM events))"""


def windows(embeddings: DataFrame) -> DataFrame:
    """One row per analysis window with three signals as arrays (one sample per slot)."""
    x = F.transform("embedding", lambda a: a.cast("double"))
    half = F.expr("cast(size(x) / 2 as int)")
    return (
        embeddings.select("vec_id", "label", x.alias("x"))
        .select(
            "vec_id", "label",
            F.col("x").alias("u"),
            F.zip_with(F.reverse("x"), "x", lambda a, b: 0.5 * a - 0.25 * b).alias("w"),
            F.concat(F.slice("x", half + 1, F.size("x") - half),
                     F.slice("x", F.lit(1), half)).alias("c"),
        ))


_WINDOWS = """win AS (
 SELECT vec_id, label, i, n, x[i + 1] AS u, 0.5::DOUBLE * x[n - i] - 0.25::DOUBLE * x[i + 1] AS w,
   x[((i + n // 2) % n) + 1] AS c
 FROM (SELECT vec_id, label, len(embedding) AS n, CAST(embedding AS DOUBLE[]) AS x,
         UNNEST(generate_series(0, len(embedding) - 1)) AS i FROM embeddings))"""

_PRIMES = _WINDOWS + """,
prime AS (
 SELECT vec_id, label, i, n, u - AVG(u) OVER (PARTITION BY vec_id) AS u,
   w - AVG(w) OVER (PARTITION BY vec_id) AS w, c - AVG(c) OVER (PARTITION BY vec_id) AS c
 FROM win)"""


def platform(events: DataFrame) -> DataFrame:
    """Attitude-sensor records in logger units (g, deg/s, deg), one per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    uid = F.col("user_id")
    return events.select(
        "event_id",
        F.when(F.pmod(uid, F.lit(2)) == 0, "north").otherwise("south").alias("site"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        (F.sqrt("value") / 200.0).alias("ax"),
        ((k - 50) / 400.0).alias("ay"),
        (1.0 - F.sqrt("value") / 60.0).alias("az"),
        ((F.pmod(uid, F.lit(13)) - 6) / 2.0).alias("gx"),
        ((F.pmod(uid, F.lit(11)) - 5) / 2.0).alias("gy"),
        (F.col("value") / 4.0 - 10.0).alias("gz"),
        F.floor(k / 25).cast("double").alias("roll"),
        F.floor(F.pmod(uid, F.lit(60)) / 20).cast("double").alias("pitch"),
        ((k * 4) % 360 - 180).cast("double").alias("yaw"),
    )


_PLATFORM = """imu AS (
 SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'north' ELSE 'south' END AS site, epoch_us(ts) AS us,
   sqrt(value) / 200.0::DOUBLE AS ax, (k - 50) / 400.0::DOUBLE AS ay, 1.0::DOUBLE - sqrt(value) / 60.0::DOUBLE AS az,
   (user_id % 13 - 6) / 2.0::DOUBLE AS gx, (user_id % 11 - 5) / 2.0::DOUBLE AS gy,
   value / 4.0::DOUBLE - 10.0::DOUBLE AS gz, (k // 25)::DOUBLE AS roll,
   ((user_id % 60) // 20)::DOUBLE AS pitch, ((k * 4) % 360 - 180)::DOUBLE AS yaw
 FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""


def products(orders: DataFrame) -> DataFrame:
    """Period products of two runs of the same periods, keyed by order."""
    key = F.col("o_orderkey")
    flux = F.sqrt("o_totalprice") - 400.0
    return orders.select(
        key.alias("rec"), F.col("o_orderstatus").alias("group_name"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
        flux.alias("flux_a"),
        F.when(F.pmod(key, F.lit(13)) != 5, flux * 0.97 + F.pmod(key, F.lit(7)) - 3.0).alias("flux_b"),
        F.pmod(F.col("o_custkey"), F.lit(3)).cast("int").alias("qc"),
        (F.pmod(F.col("o_custkey"), F.lit(101)) / 100.0).alias("rssi"),
    )


_PRODUCTS = """prod AS (
 SELECT o_orderkey AS rec, o_orderstatus AS group_name, epoch_us(o_orderdate) AS us,
   sqrt(o_totalprice) - 400.0::DOUBLE AS flux_a,
   CASE WHEN o_orderkey % 13 <> 5 THEN (sqrt(o_totalprice) - 400.0::DOUBLE) * 0.97::DOUBLE
     + o_orderkey % 7 - 3.0::DOUBLE END AS flux_b,
   CAST(o_custkey % 3 AS INTEGER) AS qc, (o_custkey % 101) / 100.0::DOUBLE AS rssi
 FROM orders)"""

_GRID = _TOWER + f""",
slots AS (SELECT site, height, us - us % {HOUR_US} AS us, AVG(u) AS u, AVG(w) AS w, AVG(ts_c) AS ts_c,
   AVG(h2o) AS h2o FROM tower GROUP BY 1, 2, 3),
grid AS (SELECT g.site, g.height, g.us, s.u, s.w, s.ts_c, s.h2o FROM (
     SELECT site, height, UNNEST(generate_series(MIN(us), MAX(us), {HOUR_US})) AS us FROM slots GROUP BY 1, 2) g
   LEFT JOIN slots s ON g.site = s.site AND g.height = s.height AND g.us = s.us)"""

# longer tokens first: replacement is textual
SQL = {"grid": _GRID, "tower": _TOWER, "prime": _PRIMES, "win": _WINDOWS, "imu": _PLATFORM, "prod": _PRODUCTS}
