"""Label model (deposition, optical loss, specific yield) and the mass-balance kernel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.functions.cleaning import at_least


# ---- label model
def deposit_rate(pm10: Column, dust: Column, gust_ms: Column, rain_mm: Column) -> Column:
    """Dust settling on the glass, g/m2 per day. Nulls: gust 3 m/s, everything else 0."""
    pm10, dust, rain = (F.coalesce(c, F.lit(0.0)) for c in (pm10, dust, rain_mm))
    gust = F.coalesce(gust_ms, F.lit(3.0))
    lift = F.lit(1.0) + F.least(F.lit(2.2), F.greatest(F.lit(0.0), gust - 4.0) / 6.0)
    return 0.00042 * (0.42 * dust + 0.16 * pm10) * lift / (1.0 + 2.6 * rain)


def optical_loss_pct(mass: Column) -> Column:
    """Saturating optical loss in percent for a dust mass in g/m2."""
    return 98.0 * (1.0 - F.exp(-mass / C.MASS_SCALE))


def dust_factor_today(days_since_rain: Column, rate: Column) -> Column:
    return optical_loss_pct(F.greatest(F.lit(1.0), days_since_rain) * F.greatest(F.lit(0.0), rate)) / 100.0


def cell_temp_c(tair_c: Column, ghi_wm2: Column) -> Column:
    return tair_c + (C.NOCT_C - 20.0) / 800.0 * at_least(ghi_wm2, 0.0)


def label_performance_ratio(tair_c: Column, ghi_wm2: Column, loss_pct: Column) -> Column:
    derate = 1.0 + C.LABEL_TEMP_COEFF * (cell_temp_c(tair_c, ghi_wm2) - 25.0)
    return F.greatest(F.lit(0.05), C.LABEL_PR * derate * (1.0 - loss_pct / 100.0))


def specific_yield(ghi_mj_m2: Column, tair_c: Column, loss_pct: Column) -> Column:
    """kWh per kWp and day from irradiation (MJ/m2), air temperature and soiling loss."""
    kwh = F.coalesce(ghi_mj_m2, F.lit(0.0)) / 3.6
    peak = kwh * 1000.0 / 24.0 * 3.0
    ratio = label_performance_ratio(F.coalesce(tair_c, F.lit(0.0)), peak, loss_pct)
    return F.when(kwh > 0, kwh * ratio).otherwise(F.lit(0.0))


def is_storm(pm10_max: Column, threshold: Column) -> Column:
    return F.when(F.coalesce(pm10_max, F.lit(0.0)) >= threshold, 1).otherwise(0)


# ---- mass-balance kernel
def wind_deposition(wind_kmh: Column) -> Column:
    ms = at_least(wind_kmh, 0.5) / 3.6
    z = F.ln(ms / C.WIND_PEAK_MS) / C.WIND_SIGMA
    return C.WIND_FLOOR + (1.0 - C.WIND_FLOOR) * F.exp(-0.5 * z * z)


def deposition_flux(pm10: Column, wind_kmh: Column, factor: Column | float = 1.0) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return C.V_SCALE * factor * wind_deposition(wind_kmh) * F.pow(at_least(pm10, 5.0) / 100.0, F.lit(C.P_EXP))


def cementation(rh_pct: Column) -> Column:
    return 1.0 + C.CEMENT_BETA * at_least(rh_pct - C.CEMENT_RH_REF, 0.0) / 60.0


def mass_loss_pct(mass: Column, rh_pct: Column) -> Column:
    return 100.0 * (1.0 - F.exp(-C.K_LOSS * mass * cementation(rh_pct)))


def kept_after_rain_and_wind(rain_mm: Column, wind_kmh: Column) -> Column:
    """Share of yesterday's mass which survives today's rain and wind."""
    rain = (F.when(rain_mm >= C.RAIN_RESET_MM, 0.0)
            .when(rain_mm >= C.PARTIAL_RAIN_MM, F.exp(-C.ALPHA_RAIN * rain_mm))
            .otherwise(1.0))
    wind = F.when(wind_kmh > C.RESUSPEND_KMH,
                  F.greatest(F.lit(0.0), 1.0 - C.RESUSPEND_SLOPE * (wind_kmh - C.RESUSPEND_KMH))).otherwise(1.0)
    return rain * wind


# ---- seasonal climatology
def seasonal_value(doy: Column, coef: Column) -> Column:
    """Mean plus two harmonics of the day of year; ``coef`` is an array of five doubles."""
    t = 2 * F.pi() * (doy - 1) / 365.25
    return (coef[0] + coef[1] * F.cos(t) + coef[2] * F.sin(t)
            + coef[3] * F.cos(2 * t) + coef[4] * F.sin(2 * t))


def backfill_from_pm10(pm10: Column) -> dict[str, Column]:
    """Aerosol columns of a day without measurements, scaled off a modelled PM10 mean."""
    return {
        "pm10_mean": pm10,
        "pm10_max": pm10 * 1.7,
        "pm25_mean": pm10 * 0.32,
        "pm25_max": pm10 * 0.32 * 1.8,
        "dust_mean": pm10 * 0.55,
        "dust_max": pm10 * 0.55 * 1.9,
        "aod_mean": F.least(F.lit(1.2), 0.0016 * pm10 + 0.06),
        "aod_max": F.least(F.lit(1.6), 0.0021 * pm10 + 0.09),
    }
