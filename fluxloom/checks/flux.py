"""Checks of the flux job and its product groups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..plans.flux_job import (CORRELATED, EFFICIENT, PRODUCTS, SKEWED, STEADY, FluxOptions, flux_job, period_state, reference_state,
                              primes, full_state)
from .registry import check
from .rotation import _fit
from .standin import DAY_US, PERIOD

OPTS = FluxOptions(period_us=DAY_US, n_sub=4, missing_share=0.12, diagnostic_limit=0.12, elevation=190.0, slope=6.0, aspect=30.0,
                   bearing=45.0, canopy=3.0, latitude=39.0, displacement=0.3, krypton=True, detrend="constant", level_means=True)
LINEAR = replace(OPTS, detrend="linear")

_OK = "u IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL"
_share = lambda c: f"AVG(CAST({c} IS NULL AS INTEGER)) >= 0.12"
_FLUX = f"""WITH @tower,
st0 AS (SELECT site, height, period_us, COUNT(*) AS n_samples, AVG(u) FILTER ({_OK}) AS m_u, AVG(v) FILTER ({_OK}) AS m_v, AVG(w) FILTER ({_OK}) AS m_w,
  AVG(u) AS a_u, AVG(v) AS a_v, AVG(w) AS a_w, AVG(ts_c) AS a_ts, AVG(h2o) AS a_h, AVG(co2) AS a_c, AVG(fw) AS a_f, AVG(p_kpa) AS a_p,
  {_share('u')} AS fu, {_share('v')} AS fv, {_share('w')} AS fwd, {_share('ts_c')} AS tsf, {_share('h2o')} AS h2of, {_share('co2')} AS co2f, {_share('fw')} AS fwf,
  AVG(diag) >= 0.12 AS fd FROM tower GROUP BY 1, 2, 3),
st AS (SELECT *, fwd OR fd AS unrot, fu OR fv OR fwd OR fd AS rot FROM st0),
fsrc AS (SELECT site, height, m_u AS u, m_v AS v, m_w AS w FROM st WHERE NOT rot),
fit AS ({_fit('site, height', 'fsrc')}),
zr AS (SELECT site, MIN(height) AS z_ref FROM st GROUP BY 1),
r0 AS (SELECT st.site, st.period_us, z_ref, a_p, a_ts + 273.15 AS ts, a_h / 1000 AS rv, 101.325 * pow(1 - 2.25577e-5 * (z_ref + 190), 5.25588) AS p_std
  FROM st JOIN zr ON st.site = zr.site AND st.height = z_ref),
r1 AS (SELECT *, CASE WHEN abs((MEDIAN(a_p) OVER (PARTITION BY site) - p_std) / p_std) < 0.05 THEN coalesce(a_p, p_std) ELSE p_std END AS "P_kPa" FROM r0),
r2 AS (SELECT *, coalesce(rv / (("P_kPa" * 1000 - rv * 461.495 * ts) / (287.058 * ts) + rv), 0.012) AS q_ref FROM r1),
r3 AS (SELECT *, ts / (1 + 0.51 * q_ref) AS "T_K", q_ref * "P_kPa" / 0.622 AS pv FROM r2),
r4 AS (SELECT *, 1000 * ("P_kPa" - pv) / (287.058 * "T_K") AS rho_d, 1000 * pv / (461.495 * "T_K") AS rho_v FROM r3),
ref AS (SELECT site, period_us, z_ref, p_std, "P_kPa", "T_K", q_ref, rho_d, rho_v, rho_d + rho_v AS rho_air, 1004.67 * (1 + 0.84 * q_ref) AS cp_air,
  "T_K" * (1 + 0.61 * q_ref) AS "T_virt_K", LAG(q_ref) OVER g AS qp, LAG(period_us) OVER g AS pp FROM r4 WINDOW g AS (PARTITION BY site ORDER BY period_us)),
s1 AS (SELECT st.*, ref.* EXCLUDE (site, period_us), b0, b1, b2, degrees(atan2(-a_v, a_u)) + 45 AS d0,
  CASE WHEN abs((MEDIAN(a_p) OVER (PARTITION BY st.site, st.height) - p_std) / p_std) < 0.05 THEN a_p ELSE "P_kPa" END AS p_lev FROM st LEFT JOIN ref USING (site, period_us) LEFT JOIN fit USING (site, height)),
j1 AS (SELECT t.us, t.u, t.v, t.w, t.ts_c, t.h2o, t.co2, t.fw, s1.*, CASE WHEN qp IS NULL THEN q_ref ELSE qp + (q_ref - qp) * ((us - pp)::DOUBLE / (t.period_us - pp)) END AS qf
  FROM tower t JOIN s1 ON t.site = s1.site AND t.height = s1.height AND t.period_us = s1.period_us),
j2 AS (SELECT *, (fw + 0.0098 * (height - z_ref)) * (1 + 0.61 * qf) AS vfw, (ts_c + 273.15) / (1 + 0.51 * qf) AS ta_k, AVG((ts_c + 273.15) / (1 + 0.51 * qf)) OVER (PARTITION BY site, height, period_us) AS tam,
  sqrt(b1 * b1 + b2 * b2 + 1) AS nrm FROM j1),
j3 AS (SELECT *, -b1 / nrm AS p31, sqrt((b2 * b2 + 1)) / nrm AS ca, (b2 / nrm) / (sqrt(b2 * b2 + 1) / nrm) AS sb, (1 / nrm) / (sqrt(b2 * b2 + 1) / nrm) AS cb FROM j2),
j4 AS (SELECT *, ca * (u - m_u) + p31 * sb * (v - m_v) - p31 * cb * (w - m_w) AS ut, CASE WHEN u IS NOT NULL THEN cb * (v - m_v) + sb * (w - m_w) END AS vt,
  p31 * (u - m_u) - ca * sb * (v - m_v) + ca * cb * (w - m_w) AS wr, ca * m_u + p31 * sb * m_v - p31 * cb * (m_w - b0) AS yu, cb * m_v + sb * (m_w - b0) AS yv,
  u - a_u AS up, v - a_v AS vp, w - a_w AS wp, ts_c - a_ts AS tp, fw - a_f AS fp, vfw - AVG(vfw) OVER (PARTITION BY site, height, period_us) AS gp, h2o - a_h AS hp, (co2 - a_c) / 1e6 AS cp FROM j3),
j5 AS (SELECT *, (yu * ut + yv * vt) / sqrt(yu * yu + yv * yv) AS ur, (yu * vt - yv * ut) / sqrt(yu * yu + yv * yv) AS vr,
  tp - 0.51 * tam * (hp / 1000 / (rho_d + rho_v)) AS ta FROM j4),
j6 AS (SELECT *, hp + 1000 * (28.97 / 18.0153::DOUBLE * (rho_v / rho_d) * hp / 1000 + rho_v * (1 + 28.97 / 18.0153::DOUBLE * rho_v / rho_d) * ta / "T_K") AS hw,
  28.97 / 18.0153::DOUBLE * (a_c / 1e6 / rho_d) * hp / 1000 + a_c / 1e6 * (1 + 28.97 / 18.0153::DOUBLE * rho_v / rho_d) * ta / "T_K" AS xc,
  co2 * 1000 * 8.314 * ta_k / (44.01 * p_lev * 1000) AS ppm, least((us - 1 - (period_us - {DAY_US})) // {DAY_US // 4}, 3) AS sub FROM j5),
j7 AS (SELECT *, cp + xc AS cw, (co2 - a_c) / 1e6 + xc AS cs, ca * u + p31 * sb * v - p31 * cb * w AS put, CASE WHEN u IS NOT NULL THEN cb * v + sb * w END AS pvt,
  p31 * u - ca * sb * v + ca * cb * w AS pwr FROM j6),
sb0 AS (SELECT site, height, period_us, sub, {', '.join(f"CASE WHEN COUNT({a} * {b}) >= 3 THEN AVG({a} * {b}) - AVG({a}) * AVG({b}) FILTER ({a} IS NOT NULL) - AVG({b}) * AVG({a}) FILTER ({b} IS NOT NULL) + AVG({a}) * AVG({b}) END AS c_{n}, AVG({a} * {b}) AS d_{n}" for n, (a, b) in STEADY.items())}
  FROM j7 GROUP BY 1, 2, 3, 4),
sb1 AS (SELECT site, height, period_us, {', '.join(f"AVG(c_{n}) AS c_{n}, AVG(d_{n}) AS d_{n}" for n in STEADY)} FROM sb0 GROUP BY 1, 2, 3),
j8 AS (SELECT *, {', '.join(f"SUM(wr * {c}) OVER g AS tot_{n}" for n, c in EFFICIENT.items())} FROM j7 WINDOW g AS (PARTITION BY site, height, period_us)),
ag AS (SELECT site, height, period_us, {', '.join(f'AVG({q}) AS "m_{q.replace("*", "_")}"' for q in PRODUCTS)},
  STDDEV_SAMP(wr) AS sw1, AVG(vfw) AS vfw_m, MAX(tam) AS tam_m, VAR_POP(cs) AS cs_var, STDDEV_POP(u) AS sd_u, STDDEV_POP(v) AS sd_v, STDDEV_POP(w) AS sd_w, STDDEV_POP(ts_c) AS sd_t,
  STDDEV_POP(fw) AS sd_f, STDDEV_POP(h2o) AS sd_h, STDDEV_POP(co2) AS sd_c, STDDEV_POP((yu * put + yv * pvt) / sqrt(yu * yu + yv * yv)) AS sd_ur,
  STDDEV_POP((yu * pvt - yv * put) / sqrt(yu * yu + yv * yv)) AS sd_vr, STDDEV_POP(pwr) AS sd_wr,
  {', '.join(f'CORR({a}, {b}) AS {n}_corr_pf' for n, (a, b) in CORRELATED.items())},
  {', '.join(f'SKEWNESS({c}) AS {n}' for n, c in SKEWED.items())},
  {', '.join(f"MAX(tot_{n}) / SUM(wr * {c}) FILTER (wr * {c} * tot_{n} > 0) AS {n}_eta_pf, (coalesce(SUM(wr * {c}) FILTER (wr * {c} * tot_{n} > 0 AND wr > 0), 0) - coalesce(SUM(wr * {c}) FILTER (wr * {c} * tot_{n} > 0 AND wr < 0), 0)) / MAX(tot_{n}) AS {n}_delta_flux_pf, (COUNT(*) FILTER (wr * {c} * tot_{n} > 0 AND wr > 0) - COUNT(*) FILTER (wr * {c} * tot_{n} > 0 AND wr < 0)) / COUNT(wr * {c})::DOUBLE AS {n}_delta_time_pf" for n, c in EFFICIENT.items())},
  {', '.join(f"AVG({a} * {b}) - AVG({a}) * AVG({b}) FILTER ({a} IS NOT NULL) - AVG({b}) * AVG({a}) FILTER ({b} IS NOT NULL) + AVG({a}) * AVG({b}) AS f_{n}, AVG({a} * {b}) AS g_{n}, COUNT({a} * {b}) AS k_{n}" for n, (a, b) in STEADY.items())}
  FROM j8 GROUP BY 1, 2, 3),
w1 AS (SELECT ag.*, s1.* EXCLUDE (site, height, period_us), sb1.* EXCLUDE (site, height, period_us), d0 - 360 * floor(d0 / 360) AS direction
  FROM ag JOIN s1 USING (site, height, period_us) JOIN sb1 USING (site, height, period_us)),
w2 AS (SELECT *, m_wr_tp * cos(radians(6)) - m_ut_tp * cos(radians(direction - 30)) * sin(radians(6)) - m_vt_tp * cos(radians(direction - 30 - 90)) * sin(radians(6)) AS vert,
  sqrt(m_ur_wr ** 2 + m_vr_wr ** 2) AS tau, (2.501 - 0.00237 * ("T_K" - 273.15)) * 1000 AS lv, 1 + 28.97 / 18.0153::DOUBLE * rho_v / rho_d AS wpl,
  CASE WHEN NOT (rot OR tsf OR h2of) THEN m_wr_ta END AS heat FROM w1),
w3 AS (SELECT *, CASE WHEN NOT (rot OR tsf) THEN -pow(tau, 1.5) / (0.4 * 9.81 / "T_virt_K" * vert) END AS lo, CASE WHEN NOT rot THEN sqrt(tau) END AS us_,
  CASE WHEN NOT (unrot OR h2of) THEN 1000 * lv * wpl * (m_wr_hp / 1000 + rho_v / "T_K" * heat) END AS le FROM w2),
w4 AS (SELECT *, height / lo AS zeta, greatest(height - 0.3, 0.1) / lo AS ze, sw1 / us_ AS meas FROM w3),
w5 AS (SELECT *, CASE WHEN height <= 3 THEN 1.25 * (exp(-0.9 * pow(1 - height / 3, 1.2)) * 1.63 - 0.63) WHEN ze < -0.032 THEN 2 * pow(-ze, 0.125) WHEN ze < 0 THEN 1.3
    WHEN ze <= 0.4 THEN 0.21 * ln(2 * 7.2921e-5 * sin(radians(39)) / us_) + 3.1 ELSE 1.1 + 0.9 * pow(ze, 0.6) END AS model,
  CASE WHEN ze < 0 THEN 1.25 * pow(1 - 3 * ze, 1 / 3.0::DOUBLE) WHEN ze >= 0 THEN 1.25 END AS model2 FROM w4),
w6 AS (SELECT *, CASE WHEN model > 0 THEN abs((model - meas) / model) * 100 END AS itc, abs((model2 - meas) / model2) * 100 AS itc2,
  {', '.join(f"CASE WHEN k_{n} >= 10 THEN abs((c_{n} - f_{n}) / f_{n}) * 100 END AS ss_{n}, CASE WHEN k_{n} >= 10 THEN abs((d_{n} - g_{n}) / g_{n}) * 100 END AS sr_{n}" for n in STEADY)} FROM w5)"""


# with linear detrending each mean becomes the trend at the sample, over the series' own samples (the wind vector: complete ones)
_T = "(us - period_us) / 1e6"
_trend = lambda c: f"REGR_INTERCEPT({c}, {_T}) AS i_{c}, REGR_SLOPE({c}, {_T}) AS g_{c}"
_xtrend = lambda c: f"REGR_INTERCEPT({c}, {_T}) FILTER ({_OK}) AS ix_{c}, REGR_SLOPE({c}, {_T}) FILTER ({_OK}) AS gx_{c}"
_at = lambda c: f"{c} - i_{c} - g_{c} * (us - period_us) / 1e6"
_xat = lambda c: f"{c} - ix_{c} - gx_{c} * (us - period_us) / 1e6"
_FLUX_LINEAR = _FLUX.replace("AVG(diag) >= 0.12 AS fd FROM", "AVG(diag) >= 0.12 AS fd, " + ", ".join(
    [_trend(c) for c in ("u", "v", "w", "ts_c", "fw", "h2o", "co2")] + [_xtrend(c) for c in "uvw"]) + " FROM")
for _c in "uvw":
    _FLUX_LINEAR = _FLUX_LINEAR.replace(f"({_c} - m_{_c})", f"({_xat(_c)})").replace(f"  {_c} - a_{_c} AS", f"  {_at(_c)} AS").replace(
        f", {_c} - a_{_c} AS", f", {_at(_c)} AS")
for _c, _m in (("ts_c", "ts"), ("fw", "f"), ("h2o", "h")):
    _FLUX_LINEAR = _FLUX_LINEAR.replace(f", {_c} - a_{_m} AS", f", {_at(_c)} AS")
_OVER = "OVER (PARTITION BY site, height, period_us)"
_FLUX_LINEAR = _FLUX_LINEAR.replace(f"AVG(vfw) {_OVER}", f"REGR_INTERCEPT(vfw, {_T}) {_OVER} - REGR_SLOPE(vfw, {_T}) {_OVER} * {_T}")
_FLUX_LINEAR = _FLUX_LINEAR.replace("(co2 - a_c) / 1e6 AS cp", f"({_at('co2')}) / 1e6 AS cp")


def _cls(ss, itc, flags):
    two = f"CASE WHEN {ss} IS NULL{f' OR {itc} IS NULL' if itc else ''} THEN 2"
    for lim, k in ((30, 0), (100, 1)):
        two += f" WHEN {ss} < {lim}{f' AND {itc} < {lim}' if itc else ''} THEN {k}"
    return f"CASE WHEN {flags} THEN 2 ELSE {two} ELSE 2 END END"


_Q = {"Tau": ("greatest(ss_uw, ss_vw)", "greatest(sr_uw, sr_vw)", "rot"), "H": ("ss_wt", "sr_wt", "rot OR tsf"),
      "LE": ("ss_wh", "sr_wh", "rot OR h2of"), "Fc": ("ss_wc", "sr_wc", "rot OR co2f")}
_QUALITY = ", ".join(f'{_cls(a, "itc", f)} AS "{n}_ssitc", {_cls(a, None, f)} AS "{n}_ss", {_cls(b, "itc2", f)} AS "{n}_ssitc_simple"'
                     for n, (a, b, f) in _Q.items())

# output: (SQL expression, voiding flags)
_OUT = {
    "u_sigma_raw": ("sd_u", "rot"), "v_sigma_raw": ("sd_v", "rot"), "w_sigma_raw": ("sd_w", "unrot"),
    "u_sigma_pf": ("sd_ur", "rot"), "v_sigma_pf": ("sd_vr", "rot"), "w_sigma_pf": ("sd_wr", "rot"),
    "ts_sigma": ("sd_t", "tsf"), "t_fw_sigma": ("sd_f", "fwf"), "h2o_sigma": ("sd_h", "rot OR tsf"),
    "co2_sigma": ("sd_c", "rot OR tsf"), "co2_wpl_sigma": ("sqrt(cs_var) * 1e6", "rot OR tsf"),
    "Tau_raw": ("sqrt(m_up_wp ** 2 + m_vp_wp ** 2)", "rot"), "Tau_pf": ("tau", "rot"), "u_var_pf": ("m_ur_ur", "rot"),
    "u_v_cov_pf": ("m_ur_vr", "rot"), "u_w_cov_pf": ("m_ur_wr", "rot"), "v_w_cov_pf": ("m_vr_wr", "rot"),
    "u_var_tilt": ("m_ut_ut", "rot"), "u_w_cov_tilt": ("m_ut_wr", "rot"), "v_w_cov_tilt": ("m_vt_wr", "rot"),
    "TKE": ("0.5 * (m_up_up + m_vp_vp + m_wp_wp)", "rot"),
    "TKE_transport_pf": ("0.5 * (m_wr_ur_ur + m_wr_vr_vr + m_wr_wr_wr)", "rot"), "u_w_transport_pf": ("m_wr_ur_wr", "rot"),
    "w_theta_v_transport_pf": ("m_wr_tp_wr", "rot"), "ts_var_transport_pf": ("m_wr_tp_tp", "rot OR tsf"),
    "w_theta_v_cov_vertical": ("vert", "rot OR tsf"), "u_theta_v_cov_snsp": ("m_ut_tp", "rot OR tsf"), "v_theta_v_cov_snsp": ("m_vt_tp", "rot OR tsf"),
    "w_theta_s_cov_raw": ("m_wp_tp", "unrot OR tsf"), "w_theta_s_cov_pf": ("m_wr_tp", "rot OR tsf"),
    "u_theta_s_cov_raw": ("m_up_tp", "rot OR tsf"), "v_theta_s_cov_raw": ("m_vp_tp", "rot OR tsf"),
    "u_theta_s_cov_pf": ("m_ur_tp", "rot OR tsf"), "v_theta_s_cov_pf": ("m_vr_tp", "rot OR tsf"),
    "w_theta_v_cov_snsp": ("m_wr_tp", "rot OR tsf"), "v_var_tilt": ("m_vt_vt", "rot"), "w_var_tilt": ("m_wr_wr", "rot"),
    "u_v_cov_tilt": ("m_ut_vt", "rot"), "v_var_pf": ("m_vr_vr", "rot"), "w_var_pf": ("m_wr_wr", "rot"),
    "u_ts_cov_raw": ("m_up_tp", "rot OR tsf"), "v_ts_cov_raw": ("m_vp_tp", "rot OR tsf"), "u_theta_v_cov_pf": ("m_ur_tp", "rot"),
    "u_h2o_cov_pf": ("m_ur_hp", "rot"), "u_h2o_wpl_cov_pf": ("m_ur_hw", "rot"), "w_h2o_transport_pf": ("m_wr_hp_wr", "rot"),
    "w_h2o_wpl_transport_pf": ("m_wr_hw_wr", "rot"),
    "w_ts_cov_raw": ("m_wp_tp", "unrot OR tsf"), "w_theta_v_cov_pf": ("m_wr_tp", "rot OR tsf"),
    "w_t_air_cov_raw": ("m_wp_ta", "unrot OR tsf OR h2of"), "w_t_air_cov_pf": ("m_wr_ta", "rot OR tsf OR h2of"),
    "w_t_fw_cov_raw": ("m_wp_fp", "unrot OR fwf"), "w_t_fw_cov_pf": ("m_wr_fp", "rot OR fwf"),
    **{f"w_theta_{k}fw_cov_{r}": (f"m_{w}_{x}", f"{f} OR fwf") for k, x in (("", "fp"), ("v_", "gp")) for r, w, f in (("raw", "wp", "unrot"), ("pf", "wr", "rot"))},
    **{f"{a}_theta_fw_cov_{r}": (f"m_{a}{x}_fp", "rot OR fwf") for a in "uv" for r, x in (("raw", "p"), ("pf", "r"))},
    "theta_fw": ("a_f + 0.0098 * (height - z_ref)", ""), "theta_v": ("a_ts + 0.0098 * (height - z_ref)", ""), "theta_v_fw": ("vfw_m", ""),
    "t_air": ("tam_m - 273.15", ""),
    "u_ts_cov_pf": ("m_ur_tp", "rot OR tsf"), "v_ts_cov_pf": ("m_vr_tp", "rot OR tsf"),
    "H_raw": ("rho_air * cp_air * m_wp_ta", "unrot OR tsf OR h2of"), "H_pf": ("rho_air * cp_air * heat", ""),
    "H_buoyancy_pf": ("rho_air * cp_air * m_wr_tp", "rot OR tsf"),
    "Lv": ("lv", ""), "w_h2o_cov_raw": ("m_wp_hp", "unrot OR h2of"), "w_h2o_cov_pf": ("m_wr_hp", "rot OR h2of"),
    "w_h2o_wpl_cov_pf": ("m_wr_hw", "rot OR h2of"), "w_q_wpl_cov_pf": ("1e3 * wpl * (m_wr_hp / 1e3 + rho_v / \"T_K\" * m_wr_ta) / 1e3", "rot OR h2of"),
    "LE_wpl_raw": ("1000 * lv * wpl * (m_wp_hp / 1000 + rho_v / \"T_K\" * heat)", "unrot OR h2of"), "LE_wpl_pf": ("le", ""),
    "LE_o2_raw": ("lv * (m_wp_hp + 0.23 * 0.0045 / 0.153 * rho_d / \"T_K\" * heat * 1000)", ""),
    "LE_o2_pf": ("lv * (m_wr_hp + 0.23 * 0.0045 / 0.153 * rho_d / \"T_K\" * heat * 1000)", ""),
    "w_co2_cov_raw": ("m_wp_cp", "unrot OR co2f"), "w_co2_cov_pf": ("m_wr_cp", "rot OR co2f"),
    "w_co2_wpl_cov_pf": ("m_wr_cp + m_wr_xc", "rot OR co2f"), "co2_mole_fraction": ("m_ppm", ""),
    "Fc_wpl_pf": ("m_wr_cp + 28.97 / 18.0153::DOUBLE * (a_c / 1e6 / rho_d) * (le / lv / 1000) + wpl * (a_c / 1e6 / \"T_K\") * heat", "rot OR co2f"),
    "L": ("lo", ""), "ustar_pf": ("us_", ""), "theta_star": ("-m_wr_tp / us_", "rot OR tsf"),
    "q_star": ("-(m_wr_hp / (rho_d + rho_v)) / us_", "rot OR h2of"),
    "psi_m": ("CASE WHEN zeta >= 0 THEN -6 * zeta ELSE ln((1 + sqrt(1 - 19.3 * zeta)) / 2 * pow((1 + pow(1 - 19.3 * zeta, 0.25)) / 2, 2)) - 2 * atan(pow(1 - 19.3 * zeta, 0.25)) + pi() / 2 END", ""),
    "psi_h": ("CASE WHEN zeta >= 0 THEN -7.8 * zeta ELSE 2 * ln((1 + 0.95 * sqrt(1 - 11.6 * zeta)) / 2) END", ""),
}


def _sel(names, extra=""):
    cols = []
    for n in names:
        e, f = _OUT[n]
        cols.append(f'{e} AS "{n}"' if not f else f'CASE WHEN NOT ({f}) THEN {e} END AS "{n}"')
    return f"{_FLUX} SELECT site, height, period_us, {', '.join(cols)}{extra} FROM w6"


def _job(t):
    return flux_job(t.tower(), OPTS)


GROUPS = {
    "p11_sensible_heat_flux": "w_ts_cov_raw w_theta_v_cov_pf w_t_air_cov_raw w_t_air_cov_pf w_t_fw_cov_raw w_t_fw_cov_pf H_raw H_pf H_buoyancy_pf",
    "p12_latent_heat": "Lv w_h2o_cov_raw w_h2o_cov_pf w_h2o_wpl_cov_pf w_q_wpl_cov_pf LE_wpl_raw LE_wpl_pf LE_o2_raw LE_o2_pf",
    "p13_co2_flux": "w_co2_cov_raw w_co2_cov_pf w_co2_wpl_cov_pf Fc_wpl_pf co2_mole_fraction",
    "p14_obukhov_length": "w_theta_v_cov_vertical L psi_m psi_h",
    "p15_surface_layer_scales": "ustar_pf theta_star q_star",
}
DIGITS = {"p13_co2_flux": 9, "p14_obukhov_length": 5}
for _name, _cols in GROUPS.items():
    check(_name, "site height period_us", _cols, _sel(_cols.split()), DIGITS.get(_name, 6))(_job)

_QN = [f"{n}_{k}" for n in _Q for k in ("ssitc", "ss")]
check("p19_quality_flags", "site height period_us " + " ".join(_QN), "", f"{_FLUX} SELECT site, height, period_us, " + ", ".join(
    f'"{n}"' for n in _QN) + f" FROM (SELECT *, {_QUALITY} FROM w6)")(_job)
_QS = [f"{n}_ssitc_simple" for n in _Q]
check("p20_simple_quality_flags", "site height period_us " + " ".join(_QS), "", f"{_FLUX} SELECT site, height, period_us, " + ", ".join(
    f'"{n}"' for n in _QS) + f" FROM (SELECT *, {_QUALITY} FROM w6)")(_job)

_ALL = [n for n in _OUT if n not in ("Fc_wpl_pf", "w_co2_cov_raw", "w_co2_cov_pf", "w_co2_wpl_cov_pf", "L", "psi_m", "psi_h")]
_CORR = [f"{n}_corr_pf" for n in CORRELATED]
_EFFN = [f"{n}_{s}_pf" for n in EFFICIENT for s in ("eta", "delta_flux", "delta_time")]
_BLANKED = {n: "rot OR tsf" for n in (*_CORR, *_EFFN)} | {n: "rot" for n in SKEWED}
_TAIL = ", ".join(f"CASE WHEN NOT ({_BLANKED[n]}) THEN {n} END AS {n}" if n in _BLANKED else n for n in (*_CORR, *_EFFN, *SKEWED))
def _whole(base):
    return (f"{base}, w7 AS (SELECT *, {_QUALITY} FROM w6) SELECT site, height, period_us, n_samples, " + ", ".join(f'"{n}"' for n in _QN) + ", "
            + _sel(_ALL).split("period_us, ", 1)[-1].rsplit(" FROM w6", 1)[0].rsplit("SELECT site, height, period_us, ", 1)[-1] + f", {_TAIL} FROM w7")


_KEYS, _VALS = "site height period_us n_samples " + " ".join(_QN), " ".join([*_ALL, *_CORR, *_EFFN, *SKEWED])
check("p27_flux_job", _KEYS, _VALS, _whole(_FLUX), 5)(_job)


@check("p27_flux_job_linear", _KEYS, _VALS, _whole(_FLUX_LINEAR), 5)
def _(t):
    return flux_job(t.tower(), LINEAR)


@check("p04_reference_state", "site period_us", "P_kPa T_K q_ref rho_d rho_v rho_air cp_air T_virt_K",
       f'{_FLUX} SELECT site, period_us, "P_kPa", "T_K", q_ref, rho_d, rho_v, rho_air, cp_air, "T_virt_K" FROM ref')
def _(t):
    return reference_state(period_state(t.tower(), OPTS), OPTS)


@check("p06_level_inputs", "event_id", "ur vr wr ta hw ppm",
       f"{_FLUX} SELECT t.event_id, ur, vr, wr, ta, hw, ppm FROM j7 JOIN tower t USING (site, height, us)")
def _(t):
    return primes(t.tower(), full_state(t.tower(), OPTS))


# hygrometers of the upper levels, with periods without a value
_SLOW = "SELECT site, height, period_us, ts_c + 272.65 AS t_k, CASE WHEN period_us // 86400000000 % 5 <> 2 THEN 35 + k / 4.0::DOUBLE END AS rh FROM tower WHERE height > 4"
_LEVEL = f"""{_FLUX}, slow AS ({_SLOW}),
v1 AS (SELECT slow.*, p_lev, z_ref, rh / 100 * 0.6112 * exp(17.67 * (slow.t_k - 273.16) / (slow.t_k - 29.66)) AS e FROM slow JOIN s1 USING (site, height, period_us)),
v2 AS (SELECT site, height, period_us, AVG(rh) / 100 * 0.6112 * exp(17.67 * (AVG(t_k) - 273.16) / (AVG(t_k) - 29.66)) AS em, ANY_VALUE(p_lev) AS pm,
  AVG((t_k + 0.0098 * (height - z_ref)) * (1 + 0.61 * 0.62197 * e / (p_lev - e))) AS theta_v_slow, AVG(621.97 * e / (p_lev - e)) AS r,
  AVG(1000 * (p_lev - e) / (287.058 * t_k) + 1000 * e / (461.495 * t_k)) AS rho_air_moist, AVG(1000 * (p_lev - e) / (287.058 * t_k)) AS rho_air_dry,
  AVG(1000 * e / (461.495 * t_k)) AS rho_h2o FROM v1 GROUP BY 1, 2, 3)
SELECT w6.site, w6.height, w6.period_us, 1000 * 0.622 * em / (pm - 0.378 * em) AS q, theta_v_slow, r, rho_air_moist, rho_air_dry, rho_h2o,
  w6.lo / w6."T_virt_K" * CASE WHEN w6.height > 4 THEN theta_v_slow ELSE w6."T_virt_K" END AS "L"
FROM w6 LEFT JOIN v2 USING (site, height, period_us)"""


@check("p06_level_humidity", "site height period_us", "q theta_v_slow r rho_air_moist rho_air_dry rho_h2o L", _LEVEL, 5)
def _(t):
    slow = t.tower().filter("height > 4").selectExpr("site", "height", "period_us", "ts_c + 272.65D AS t_k",
                                                     "case when period_us div 86400000000 % 5 <> 2 then 35 + k / 4.0D end AS rh")
    return flux_job(t.tower(), OPTS, humidity=slow)


@check("f25_steady_state_deviation", "site height period_us", "uw wt",
       f"{_FLUX} SELECT site, height, period_us, ss_uw AS uw, ss_wt AS wt FROM w6", 4)
def _(t):
    from ..plans.flux_job import period_sums, steady_state, sub_period_sums

    p = primes(t.tower(), full_state(t.tower(), OPTS))
    ss = steady_state()
    return period_sums(sub_period_sums(p, OPTS)).select(*PERIOD, ss["uw"].alias("uw"), ss["wt"].alias("wt"))
