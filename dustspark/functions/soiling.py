"""Exposure model: effective dust-days, loss, energy, cost, risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.functions.cleaning import at_least, clamp, nonzero


def dust_factor(pm10: Column, dust: Column, wind: Column, gust: Column, rh: Column,
                irradiation: Column, bias: Column) -> Column:
    """Effective dust-days of one day (1 = an average day).

    A zero wind, gust or humidity counts as missing, like a null.
    """
    load = F.coalesce(pm10, dust)
    ratio = F.coalesce(clamp(load / C.REFERENCE_PM10, 0.20, 5.0), F.lit(1.0))
    w = clamp(nonzero(gust, nonzero(wind, 3.0)), 0.0, 28.0)
    wind_mult = (F.when(w <= 8.0, 0.55 + 0.075 * w)
                 .otherwise(F.greatest(F.lit(0.35), 1.15 - 0.055 * (w - 8.0))))
    humid = 0.85 + 0.006 * F.greatest(F.lit(0.0), nonzero(rh, 30.0) - 25.0)
    sun = 0.9 + 0.03 * clamp(F.coalesce(irradiation, F.lit(6.0)), 0.0, 8.5)
    return clamp(bias * ratio * wind_mult * humid * sun, 0.05, 3.5)


def loss_pct(exposure: Column, lmax: Column, tau: Column) -> Column:
    raw = lmax * (1.0 - F.exp(-at_least(exposure, 0.0) / tau))
    return 100.0 * F.when(raw > C.MAX_LOSS_FRAC, C.MAX_LOSS_FRAC).otherwise(raw)


def mass_from_loss(loss: Column) -> Column:
    frac = clamp(loss, 0.0, 99.0) / 100.0
    return -9.0 * F.ln(F.greatest(F.lit(1e-6), 1.0 - frac))


def marginal_loss(exposure: Column, lmax: Column, tau: Column) -> Column:
    return 100.0 * (lmax / tau) * F.exp(-exposure / tau)


def season_factor(doy: Column) -> Column:
    """Dust seasonality: spring main peak, autumn secondary peak."""
    spring = (doy - 60) / 45.0
    autumn = (doy - 300) / 32.0
    return 1.0 + 0.65 * F.exp(-spring * spring) + 0.35 * F.exp(-autumn * autumn)


def year_irradiation(doy: Column, summer: Column, winter: Column) -> Column:
    return winter + (summer - winter) * (1.0 + F.cos(2 * F.pi() * (doy - 180) / 365.0)) / 2.0


def performance_ratio(tcell: Column, tair: Column, peak_ghi: Column) -> Column:
    cell = F.coalesce(tcell, nonzero(tair, 35.0) + nonzero(peak_ghi, 800.0) * 0.028)
    derate = 1.0 + C.EXPOSURE_TEMP_COEFF * F.greatest(F.lit(0.0), cell - 25.0)
    return clamp(C.EXPOSURE_PR * derate, 0.45, 0.95)


def day_irradiation(irradiation: Column, peak_ghi: Column) -> Column:
    return F.coalesce(irradiation, nonzero(peak_ghi, 800.0) * 6.0 / 1000.0)


def cleaning_cost(capacity_kwp: Column, per_mwp: Column | float | None = None, wet: bool = False) -> Column:
    rate = C.CLEANING_COST_SAR_PER_MWP if per_mwp is None else per_mwp
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    mwp = F.greatest(capacity_kwp / 1000.0, F.lit(0.001))
    return mwp * rate * F.lit(C.WET_CLEANING_MULTIPLIER if wet else 1.0)


def water_litres(capacity_kwp: Column, litres_per_mwp: float = C.WATER_LITRES_PER_MWP) -> Column:
    return F.lit(litres_per_mwp) * capacity_kwp / 1000.0


def _steps(value: Column, low: float, high: float) -> Column:
    v = F.coalesce(value, F.lit(0.0))
    return F.when(v >= high, 2).when(v >= low, 1).otherwise(0)


def weather_risk_score(gust: Column, pm10: Column, aod: Column) -> Column:
    return _steps(gust, 10.0, 14.0) + _steps(pm10, 150.0, 250.0) + _steps(aod, 0.45, 0.8)


def loss_risk_score(loss: Column) -> Column:
    return _steps(loss, 12.0, 25.0)


def risk_label(score: Column) -> Column:
    return (F.when(score >= 5, "severe").when(score >= 3, "high")
            .when(score >= 1, "moderate").otherwise("low"))
