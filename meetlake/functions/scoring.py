"""Column expressions that judge a value against its reference range."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WARN = 0.2


def _parts(value: str, low: str, high: str) -> tuple[Column, Column, Column, Column, Column]:
    v, lo, hi = F.col(value), F.col(low), F.col(high)
    none = v.isNull() | (lo.isNull() & hi.isNull())
    return v, lo, hi, none, F.greatest(F.when(v < lo, lo - v).otherwise(0.0), F.when(v > hi, v - hi).otherwise(0.0))


def status(value: str = "value", low: str = "ref_low", high: str = "ref_high") -> Column:
    """good inside, warn up to a fifth of the width (or of the only bound) outside, bad beyond, na without data."""
    v, lo, hi, none, beyond = _parts(value, low, high)
    both = lo.isNotNull() & hi.isNotNull()
    width = F.greatest(F.when(both, hi - lo).otherwise(F.abs(F.coalesce(hi, lo))), F.lit(1e-9))
    return F.when(none, "na").when(beyond <= 0, "good").when(beyond <= WARN * width, "warn").otherwise("bad")


def penalty(value: str = "value", low: str = "ref_low", high: str = "ref_high") -> Column:
    """0 inside, rising to 1 at a whole width (or bound, 1 at least) outside; null without data."""
    v, lo, hi, none, beyond = _parts(value, low, high)
    width = F.when(lo.isNotNull() & hi.isNotNull(), F.greatest(hi - lo, F.lit(1e-9))).otherwise(F.greatest(F.abs(F.coalesce(hi, lo)), F.lit(1.0)))
    return F.when(none, F.lit(None).cast("double")).otherwise(F.least(F.lit(1.0), beyond / width))


def bad_side_z(value: Column, mean: Column, std: Column, better: Column, low: Column, high: Column) -> Column:
    """The z-score in the direction that counts as worse; 0 on the better side."""
    z = (value - mean) / std
    inside = F.when(low.isNotNull() & high.isNotNull(), F.greatest(F.lit(0.0), F.when(value >= (low + high) / 2, z).otherwise(-z))).otherwise(F.abs(z))
    own = F.when(better == "lower", F.greatest(F.lit(0.0), z)).when(better == "higher", F.greatest(F.lit(0.0), -z)).otherwise(inside)
    return F.when(value.isNull() | (std <= 0), 0.0).otherwise(own)


def sane(c: Column) -> Column:
    """The value, null where it is not a finite number."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def delta_direction(delta: Column, better: Column, unit: float) -> Column:
    """better, worse or same: a change of less than half a display unit is none; where inside is better, it has no direction."""
    sign = F.when(better == "higher", F.sign(delta)).when(better == "lower", -F.sign(delta)).otherwise(0.0)
    return F.when(delta.isNull() | (F.abs(delta) < unit / 2) | (sign == 0), "same").when(sign > 0, "better").otherwise("worse")
