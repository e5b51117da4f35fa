"""Column expressions of hydrology and climate."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def water_year(date: Column) -> Column:
    """October starts the next water year."""
    return (F.year(date) + (F.month(date) >= 10).cast("int")).cast("int")


def decimal_year(date: Column) -> Column:
    return F.year(date) + (F.dayofyear(date) - 1) / 365.25


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))


def season_of(month: Column) -> Column:
    """DJF, MAM, JJA or SON; any other month number is an error."""
    return (
        F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").when(month.isin(9, 10, 11), "SON").otherwise(F.raise_error(F.concat(F.lit("not a month: "), month.cast("string"))))
    )


def air_pressure(elevation: Column, method: str = "asce") -> Column:
    """kPa at an elevation in metres, by the standard exponent or the one derived from the gas constant."""
    exponent = 5.26 if method == "asce" else 9.8 / (0.0065 * 286.9)
    return 101.3 * F.pow((293.0 - 0.0065 * elevation) / 293.0, F.lit(exponent))


def vapour_pressure(pressure: Column, humidity: Column) -> Column:
    """kPa from air pressure and specific humidity."""
    return pressure * humidity / (0.622 + 0.378 * humidity)


def kelvin_to_celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0."""
    return F.when(a + b != 0, (a - b) / (a + b)).otherwise(0.0)


# Reliabilities of usable values, the fill, the valid range and the scale of a vegetation index; the quality
# bits of cloud and its like; the scale and offset of surface reflectances.
GOOD_RELIABILITY = [0, 1]
INDEX_FILL, INDEX_LOW, INDEX_HIGH, INDEX_SCALE = -3000, -2000, 10000, 1e-4
CLOUD_BITS = 0b111110
REFLECTANCE_SCALE, REFLECTANCE_OFFSET = 0.0000275, -0.2


def valid_index(value: Column, reliability: Column) -> Column:
    """Whether a stored vegetation index is usable; unknown values are not."""
    return F.coalesce(reliability.isin(GOOD_RELIABILITY) & (value != INDEX_FILL) & value.between(INDEX_LOW, INDEX_HIGH), F.lit(False))


def scaled_index(value: Column, reliability: Column) -> Column:
    """The physical index of usable stored values."""
    return F.when(valid_index(value, reliability), value * INDEX_SCALE)


def clear_index(red: Column, nir: Column, quality: Column) -> Column:
    """The vegetation index of stored reflectances where none of the cloud bits is set, null elsewhere and without light."""
    r, n = (band * REFLECTANCE_SCALE + REFLECTANCE_OFFSET for band in (red, nir))
    return F.when((quality.bitwiseAND(CLOUD_BITS) == 0) & (n + r != 0), (n - r) / (n + r))


def logistic(value: Column, middle: float, scale: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(value - middle) / scale))


def gate_blend(height: Column, scale: Column | float, near: Column, far: Column) -> Column:
    """near where the height is 0, far where it is large: weights exp(-height / scale) and the rest."""
    near_share = F.exp(-F.greatest(height, F.lit(0.0)) / scale)
    return near_share * near + (1 - near_share) * far


def pinball(observed: Column, predicted: Column, tau: float) -> Column:
    e = observed - predicted
    return F.greatest(tau * e, (tau - 1) * e)


def cauchy_weight(residual: Column, scale: float) -> Column:
    return 1.0 / (1.0 + F.pow(residual / scale, F.lit(2)))


def ratio_or_null(a: Column, b: Column) -> Column:
    """a / b where b is positive."""
    return F.when(b > 0, a / b)
