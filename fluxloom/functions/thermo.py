"""Moist-air thermodynamics and density corrections as column expressions.

Temperatures in K unless the name ends in ``_c``; pressures in kPa; densities
in kg m-3 unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: physical constants
R_DRY, R_VAPOUR = 287.058, 461.495
M_VAPOUR, M_DRY = 18.0153, 28.97
MU = 1.6077
CP_DRY = 1004.67
LAPSE_DRY = 0.0098
SONIC_HUMIDITY = 0.51
R_GAS = 8.314462618
M_CO2 = 44.01


def saturation_vapour_pressure(t: Column) -> Column:
    """kPa over liquid water."""
    return 0.6112 * F.exp(17.67 * (t - 273.16) / (t - 29.66))


def specific_humidity(rh: Column, p_kpa: Column, t: Column) -> Column:
    """kg/kg from relative humidity in percent."""
    e = rh / 100.0 * saturation_vapour_pressure(t)
    return 0.622 * e / (p_kpa - 0.378 * e)


def standard_pressure(z: Column) -> Column:
    """kPa of the standard atmosphere at height *z* above sea level."""
    return 101.325 * F.pow(1.0 - 2.25577e-5 * z, F.lit(5.25588))


def moist_air(t: Column, rh: Column, p_kpa: Column, level: Column) -> dict[str, Column]:
    """Virtual potential temperature, mixing ratio (g/kg) and densities."""
    p = p_kpa * 1000.0
    e = 1000.0 * saturation_vapour_pressure(t) * rh / 100.0
    r = 621.97 * e / (p - e)
    dry, vapour = (p - e) / (R_DRY * t), e / (R_VAPOUR * t)
    return {"theta_v": (t + LAPSE_DRY * level) * (1.0 + 0.61 * r / 1000.0), "r": r,
            "rho_moist": dry + vapour, "rho_dry": dry, "rho_h2o": vapour}


def air_from_sonic(ts: Column, q: Column) -> Column:
    """Air temperature of a sonic temperature (both K)."""
    return ts / (1.0 + SONIC_HUMIDITY * q)


def air_perturbation(ts_p: Column, q_p: Column, t_mean: Column) -> Column:
    """T' = Ts' - 0.51 T q'."""
    return ts_p - SONIC_HUMIDITY * t_mean * q_p


def humidity_from_density(rho_v: Column, p_kpa: Column, t: Column) -> Column:
    """Specific humidity of a vapour density at total pressure and temperature."""
    rho_d = (p_kpa * 1000.0 - rho_v * R_VAPOUR * t) / (R_DRY * t)
    return rho_v / (rho_d + rho_v)


def air_state(ts_c: Column, h2o_g: Column, p_kpa: Column, iterations: int = 3) -> dict[str, Column]:
    """Fixed point of the sonic-humidity relation and the gas partition of total pressure."""
    ts, rho_v, p = ts_c + 273.15, h2o_g / 1000.0, p_kpa * 1000.0
    partition = lambda t: (p - rho_v * R_VAPOUR * t) / (R_DRY * t)
    t = ts
    for _ in range(iterations):
        rho_d = partition(t)
        t = ts / (1.0 + SONIC_HUMIDITY * rho_v / (rho_d + rho_v))
    rho_d = partition(t)
    return {"t": t, "rho_v": rho_v, "rho_d": rho_d, "q": rho_v / (rho_d + rho_v)}


def wpl_vapour_flux(w_rho_v: Column, w_t: Column, rho_v: Column, rho_d: Column, t: Column) -> Column:
    """Vapour flux corrected for density fluctuations."""
    return (1.0 + MU * rho_v / rho_d) * (w_rho_v + rho_v / t * w_t)


def wpl_trace_flux(w_rho_c: Column, w_rho_v: Column, w_t: Column, rho_c: Column, rho_v: Column, rho_d: Column,
                   t: Column) -> Column:
    """Open-path trace-gas flux corrected for density fluctuations."""
    return w_rho_c + MU * rho_c / rho_d * w_rho_v + (1.0 + MU * rho_v / rho_d) * rho_c / t * w_t


def vaporisation_heat_j_per_g(t: Column) -> Column:
    """Latent heat, the form the flux job uses (J/g)."""
    return (2.501 - 0.00237 * (t - 273.15)) * 1000.0


def vaporisation_heat_j_per_kg(t: Column) -> Column:
    """Latent heat, the form the density module uses (J/kg)."""
    return 1000.0 * (2500.8 - 2.36 * (t - 273.15))


def mole_fraction_ppm(mmol_m3: Column, p_kpa: Column, t_c: Column) -> Column:
    """Wet mole fraction (ppm) of a molar density."""
    return mmol_m3 * 1e-3 * R_GAS * (t_c + 273.15) / (p_kpa * 1e3) * 1e6


def co2_mole_fraction_ppm(mg_m3: Column, p_kpa: Column, t_c: Column) -> Column:
    """Wet mole fraction (ppm) of a CO2 mass density."""
    return mg_m3 * 1000.0 * 8.314 * (t_c + 273.15) / (M_CO2 * p_kpa * 1e3)


def specific_heat(q: Column) -> Column:
    return CP_DRY * (1.0 + 0.84 * q)


def vapour_pressure_deficit_hpa(t_c: Column, rh: Column) -> Column:
    return 6.1078 * F.exp(17.27 * t_c / (t_c + 237.3)) * (1.0 - rh / 100.0)


def albedo_percent(sw_in: Column, sw_out: Column) -> Column:
    """Missing unless the incoming radiation exceeds 5 W m-2."""
    return F.when(sw_in > 5.0, 100.0 * F.try_divide(sw_out, sw_in))
