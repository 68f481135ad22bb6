"""Checks of thermodynamic, stability and quality expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves, flags, stability, thermo
from .registry import check
from .standin import PERIOD

_BASE = """WITH @tower, b AS (SELECT *, coalesce(ts_c, 20) + 273.15 AS t_k, 20 + k * 0.7 AS rh, coalesce(h2o, 9) / 1000.0::DOUBLE AS rho_v,
  1.15 + k / 1000.0::DOUBLE AS rho_d FROM tower)"""


def _base(t):
    return t.tower().select("*", (F.coalesce("ts_c", F.lit(20.0)) + 273.15).alias("t_k"), (20 + F.col("k") * 0.7).alias("rh"),
                            (F.coalesce("h2o", F.lit(9.0)) / 1000.0).alias("rho_v"), (1.15 + F.col("k") / 1000.0).alias("rho_d"))


c = F.col
_ES = "(0.6112 * exp(17.67 * (t_k - 273.16) / (t_k - 29.66)))"


@check("p01_vapour_pressure_and_humidity", "event_id", "es q",
       f"""{_BASE} SELECT event_id, {_ES} AS es, 0.622 * (rh / 100 * {_ES}) / (p_kpa - 0.378 * (rh / 100 * {_ES})) AS q FROM b""", digits=7)
def _(t):
    return _base(t).select("event_id", thermo.saturation_vapour_pressure(c("t_k")).alias("es"),
                           thermo.specific_humidity(c("rh"), c("p_kpa"), c("t_k")).alias("q"))


@check("p02_virtual_temperature_and_densities", "event_id", "theta_v r rho_moist rho_dry rho_h2o",
       f"""{_BASE}, e AS (SELECT *, 1000 * {_ES} * rh / 100 AS e, p_kpa * 1000 AS p FROM b)
         SELECT event_id, (t_k + 0.0098 * height) * (1 + 0.61 * (621.97 * e / (p - e)) / 1000) AS theta_v, 621.97 * e / (p - e) AS r,
           (p - e) / (287.058 * t_k) + e / (461.495 * t_k) AS rho_moist, (p - e) / (287.058 * t_k) AS rho_dry, e / (461.495 * t_k) AS rho_h2o FROM e""")
def _(t):
    m = thermo.moist_air(c("t_k"), c("rh"), c("p_kpa"), c("height"))
    return _base(t).select("event_id", *[x.alias(n) for n, x in m.items()])


@check("p03_standard_pressure", "event_id", "p",
       "WITH @tower SELECT event_id, 101.325 * pow(1 - 2.25577e-5 * (height + value), 5.25588) AS p FROM tower")
def _(t):
    return t.tower().select("event_id", thermo.standard_pressure(c("height") + c("value")).alias("p"))


@check("p05_sonic_to_air_temperature", "event_id", "t_air t_prime",
       f"{_BASE} SELECT event_id, t_k / (1 + 0.51 * rho_v) AS t_air, (t_k - 293) - 0.51 * 293 * (rho_v - 0.009) AS t_prime FROM b")
def _(t):
    return _base(t).select("event_id", thermo.air_from_sonic(c("t_k"), c("rho_v")).alias("t_air"),
                           thermo.air_perturbation(c("t_k") - 293, c("rho_v") - 0.009, F.lit(293.0)).alias("t_prime"))


def _iter(t):
    return f"(t_s / (1 + 0.51 * rho_v / ((p - rho_v * 461.495 * {t}) / (287.058 * {t}) + rho_v)))"


@check("p07_air_state_fixed_point", "event_id", "t rho_d q",
       f"""{_BASE}, a AS (SELECT *, t_k AS t_s, p_kpa * 1000 AS p FROM b), i1 AS (SELECT *, {_iter('t_s')} AS t1 FROM a),
         i2 AS (SELECT *, {_iter('t1')} AS t2 FROM i1), i3 AS (SELECT *, {_iter('t2')} AS t3 FROM i2),
         z AS (SELECT *, (p - rho_v * 461.495 * t3) / (287.058 * t3) AS rd FROM i3)
         SELECT event_id, t3 AS t, rd AS rho_d, rho_v / (rd + rho_v) AS q FROM z""", digits=7)
def _(t):
    s = thermo.air_state(c("t_k") - 273.15, c("rho_v") * 1000.0, c("p_kpa"))
    return _base(t).select("event_id", *[s[n].alias(n) for n in ("t", "rho_d", "q")])


@check("p08_density_corrected_flux", "event_id", "vapour trace",
       f"""{_BASE} SELECT event_id, (1 + 1.6077 * rho_v / rho_d) * (w / 1000 + rho_v * (w * 0.1) / t_k) AS vapour,
         w / 100 + 1.6077 * (co2 / rho_d) * (w / 1000) + (1 + 1.6077 * rho_v / rho_d) * (co2 / t_k) * (w * 0.1) AS trace FROM b""")
def _(t):
    w = c("w")
    return _base(t).select(
        "event_id", thermo.wpl_vapour_flux(w / 1000, w * 0.1, c("rho_v"), c("rho_d"), c("t_k")).alias("vapour"),
        thermo.wpl_trace_flux(w / 100, w / 1000, w * 0.1, c("co2"), c("rho_v"), c("rho_d"), c("t_k")).alias("trace"))


@check("p09_vaporisation_heat", "event_id", "lv_g lv_kg",
       f"{_BASE} SELECT event_id, (2.501 - 0.00237 * (t_k - 273.15)) * 1000 AS lv_g, 1000 * (2500.8 - 2.36 * (t_k - 273.15)) AS lv_kg FROM b", digits=7)
def _(t):
    return _base(t).select("event_id", thermo.vaporisation_heat_j_per_g(c("t_k")).alias("lv_g"),
                           thermo.vaporisation_heat_j_per_kg(c("t_k")).alias("lv_kg"))


@check("p10_mole_fractions", "event_id", "ch4_ppm co2_ppm",
       f"""{_BASE} SELECT event_id, (k / 10.0::DOUBLE) * 0.001 * 8.314462618 * t_k / (p_kpa * 1000) * 1e6 AS ch4_ppm,
         co2 * 1000 * 8.314 * t_k / (44.01 * p_kpa * 1000) AS co2_ppm FROM b""")
def _(t):
    return _base(t).select("event_id", thermo.mole_fraction_ppm(c("k") / 10.0, c("p_kpa"), c("t_k") - 273.15).alias("ch4_ppm"),
                           thermo.co2_mole_fraction_ppm(c("co2"), c("p_kpa"), c("t_k") - 273.15).alias("co2_ppm"))


@check("p16_stability_functions", "event_id", "psi_m_h psi_h_h psi_m_b psi_h_b psi_m_d psi_h_d",
       "WITH @tower, z AS (SELECT event_id, (k - 60) / 40.0::DOUBLE AS z FROM tower) SELECT event_id, " + ", ".join(
           f"CASE WHEN z >= 0 THEN -{bm} * z ELSE ln((1 + sqrt(1 - {gm} * z)) / 2 * pow((1 + pow(1 - {gm} * z, 0.25)) / 2, 2)) "
           f"- 2 * atan(pow(1 - {gm} * z, 0.25)) + pi() / 2 END AS psi_m_{n}, "
           f"CASE WHEN z >= 0 THEN -{bh} * z ELSE 2 * ln((1 + {ah} * sqrt(1 - {gh} * z)) / 2) END AS psi_h_{n}"
           for n, gm, bm, ah, gh, bh in (("h", 19.3, 6.0, 0.95, 11.6, 7.8), ("b", 15.0, 4.7, 0.74, 9.0, 4.7), ("d", 16.0, 5.0, 1.0, 16.0, 5.0)))
       + " FROM z")
def _(t):
    z = (c("k") - 60) / 40.0
    out = []
    for n, s in (("h", "hoegstroem1988"), ("b", "businger1971"), ("d", "dyer1974")):
        out += [stability.psi_m(z, s).alias(f"psi_m_{n}"), stability.psi_h(z, s).alias(f"psi_h_{n}")]
    return t.tower().select("event_id", *out)


@check("p17_phi_and_similarity_alpha", "event_id", "phi alpha",
       """WITH @tower, z AS (SELECT event_id, height, (k - 60) / 25.0::DOUBLE AS z, value + 10 AS p FROM tower),
         f AS (SELECT *, CASE WHEN z BETWEEN 0 AND 1 THEN 0.95 + 7.8 * z WHEN z >= -2 AND z < 0 THEN 0.95 / sqrt(1 - 11.6 * z) END AS phi FROM z)
         SELECT event_id, phi, sqrt(0.4 / pi() * (height - 0.5) / (height * height) * p * 0.45 / phi) AS alpha FROM f""")
def _(t):
    z = (c("k") - 60) / 25.0
    return t.tower().select("event_id", stability.phi_h(z).alias("phi"), stability.renewal_alpha(
        c("value") + 10, F.lit(0.45), z, c("height"), 0.5).alias("alpha"))


@check("p18_sigma_w_models", "event_id", "above above_lat canopy cubic",
       """WITH @tower, z AS (SELECT event_id, height, (k - 50) / 60.0::DOUBLE AS z, 0.1 + value / 500 AS us FROM tower)
         SELECT event_id, CASE WHEN z < -0.032 THEN 2 * pow(-z, 0.125) WHEN z < 0 THEN 1.3 ELSE 1.1 + 0.9 * pow(z, 0.6) END AS above,
           CASE WHEN z < -0.032 THEN 2 * pow(-z, 0.125) WHEN z < 0 THEN 1.3 WHEN z <= 0.4 THEN
             0.21 * ln(2 * 7.2921e-5 * sin(radians(39)) / us) + 3.1 ELSE 1.1 + 0.9 * pow(z, 0.6) END AS above_lat,
           1.25 * (exp(-0.9 * pow(1 - least(height / 25, 1), 1.2)) * 1.63 - 0.63) AS canopy,
           CASE WHEN z < 0 THEN 1.25 * pow(1 - 3 * z, 1 / 3.0::DOUBLE) ELSE 1.25 END AS cubic FROM z""")
def _(t):
    z, us = (c("k") - 50) / 60.0, 0.1 + c("value") / 500
    return t.tower().select("event_id", stability.sigma_w_reference(z, us).alias("above"),
                            stability.sigma_w_reference(z, us, 39.0).alias("above_lat"),
                            stability.sigma_w_canopy(c("height"), 25.0).alias("canopy"), flags.itc_cubic_root_model(z).alias("cubic"))


@check("p21_three_class_flag", "event_id cls", "",
       """WITH @tower SELECT event_id, CASE WHEN h2o IS NULL THEN 0 WHEN value <= 30 THEN 1 WHEN value <= 100 THEN 2 ELSE 3 END AS cls FROM tower""")
def _(t):
    return t.tower().select("event_id", flags.three_class(F.when(c("h2o").isNotNull(), c("value"))).alias("cls"))


@check("p25_neutral_curves", "event_id", "u v w temp uw wt ut",
       """WITH @tower, f AS (SELECT event_id, 0.01 + value / 125 AS f FROM tower)
         SELECT event_id, 105 * f / pow(1 + 33 * f, 5 / 3.0::DOUBLE) AS u, 17 * f / pow(1 + 9.5 * f, 5 / 3.0::DOUBLE) AS v,
           2 * f / (1 + 5.3 * pow(f, 5 / 3.0::DOUBLE)) AS w,
           CASE WHEN f <= 0.15 THEN 53.4 * f / pow(1 + 24 * f, 5 / 3.0::DOUBLE) ELSE 24.4 * f / pow(1 + 12.5 * f, 5 / 3.0::DOUBLE) END AS temp,
           14 * f / pow(1 + 9.6 * f, 2.4) AS uw, CASE WHEN f <= 1 THEN 11 * f / pow(1 + 13.3 * f, 1.75) ELSE 4.4 * f / pow(1 + 3.8 * f, 2.4) END AS wt,
           40 * f / pow(1 + 14 * f, 2.6) AS ut FROM f""")
def _(t):
    f = 0.01 + c("value") / 125
    names = {"u": "u", "v": "v", "w": "w", "T": "temp", "uw": "uw", "wT": "wt", "uT": "ut"}
    return t.tower().select("event_id", *[curves.neutral_curve(f, k).alias(n) for k, n in names.items()])


@check("p26_met_derived", "event_id", "vpd albedo h2o_mmol",
       f"""{_BASE} SELECT event_id, 6.1078 * exp(17.27 * (t_k - 273.15) / (t_k - 273.15 + 237.3)) * (1 - rh / 100) AS vpd,
         CASE WHEN value > 5 THEN 100 * (k / 4.0::DOUBLE) / value END AS albedo, (rho_v * 1000) * 28.97 / 18.0153 AS h2o_mmol FROM b""")
def _(t):
    return _base(t).select("event_id", thermo.vapour_pressure_deficit_hpa(c("t_k") - 273.15, c("rh")).alias("vpd"),
                           thermo.albedo_percent(c("value"), c("k") / 4.0).alias("albedo"),
                           (c("rho_v") * 1000 * thermo.M_DRY / thermo.M_VAPOUR).alias("h2o_mmol"))
