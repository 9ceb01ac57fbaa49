"""Guarded numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def is_finite(c: Column) -> Column:
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (d != INF) & (d != -INF)


def clamp01(c: Column) -> Column:
    """Null and non-finite become 0 (a bare greatest/least would give 1)."""
    d = c.cast("double")
    return F.when(is_finite(d), F.greatest(F.lit(0.0), F.least(F.lit(1.0), d))).otherwise(F.lit(0.0))


def optional_float(c: Column, minimum: float | None = None) -> Column:
    d = c.try_cast("double")
    ok = is_finite(d)
    if minimum is not None:
        ok = ok & (d >= minimum)
    return F.when(ok, d)


def falsy_to(c: Column, default: float) -> Column:
    """`x or default` for numbers: null and 0 give the default."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def nutrition_array(c: Column) -> Column:
    """Seven doubles: bad values 0, short arrays padded."""
    seven = F.slice(F.concat(F.coalesce(c.cast("array<double>"), F.array().cast("array<double>")),
                             F.array_repeat(F.lit(None).cast("double"), 7)), 1, 7)
    return F.transform(seven, lambda x: F.when(is_finite(x), x).otherwise(F.lit(0.0)))


def non_negative_nutrition(c: Column) -> Column:
    return F.transform(nutrition_array(c), lambda x: F.when(x >= 0, x).otherwise(F.lit(0.0)))


def nutrition_present(c: Column) -> Column:
    """All seven slots finite and not negative."""
    first = F.slice(c.cast("array<double>"), 1, 7)
    ok = (F.size(first) == 7) & F.forall(first, lambda x: F.coalesce(is_finite(x) & (x >= 0), F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def bucket_name(c: Column, thresholds) -> Column:
    """`le_t` for the first threshold that is not below the value, else `gt_last`."""
    d = c.cast("double")
    out = F.when(~is_finite(d), F.lit("unknown"))
    for t in thresholds:
        out = out.when(d <= t, F.lit(f"le_{t:g}"))
    return out.otherwise(F.lit(f"gt_{thresholds[-1]:g}"))


def risk_bucket(c: Column) -> Column:
    d = c.cast("double")
    return (F.when(~is_finite(d), "unknown").when(d < 0.25, "low")
            .when(d < 0.55, "medium").otherwise("high"))


def status_ladder(risk: Column, confidence: Column) -> Column:
    return (F.when((confidence >= 0.65) & (risk >= 0.75), "known_bad")
            .when(risk >= 0.55, "suspected_bad")
            .when((confidence >= 0.65) & (risk <= 0.20), "known_good")
            .when((confidence >= 0.35) & (risk <= 0.35), "suspected_good")
            .otherwise("unknown"))


def decay_weight(exposed_at: Column, reported_at: Column, tau: float = 18.0, window: float = 48.0) -> Column:
    hours = F.greatest(F.lit(0.0), (F.unix_micros(reported_at) - F.unix_micros(exposed_at)) / 3.6e9)
    return F.when(hours > window, F.lit(0.0)).otherwise(F.exp(-hours / tau))


def time_cyclic(ts: Column) -> tuple[Column, Column]:
    angle = (F.hour(ts) + F.minute(ts) / 60.0) * (2 * 3.141592653589793 / 24)
    return F.sin(angle), F.cos(angle)


def macro_ratios(nutrition: Column) -> tuple[Column, Column]:
    """Protein to carbs and protein to calories; arrays short of seven count as zeros."""
    full = F.size(nutrition) >= 7
    calories, protein, carbs = (F.when(full, nutrition[i]).otherwise(0.0) for i in (0, 4, 6))

    def safe(ratio: Column) -> Column:
        return F.when(is_finite(ratio), ratio).otherwise(F.lit(0.0))

    return safe(F.try_divide(protein, carbs + 1e-5)), safe(F.try_divide(protein, calories + 1e-5))


def parse_timestamp(c: Column) -> Column:
    """ISO text; a trailing Z and a missing zone mean UTC; bad text gives null."""
    text = c.cast("string")
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$")
    return F.when(iso, text.try_cast("timestamp"))


def match_pct(recipe_id: Column) -> Column:
    return F.lit(85) + F.abs(recipe_id) % 14


def half_up(c: Column, digits: int = 0) -> Column:
    """floor(x + .5), the rounding of the client side."""
    k = float(10 ** digits)
    return F.floor(c * k + 0.5) / k


def hash_unit(*cols: Column, seed: int = 42) -> Column:
    """Deterministic number in [0, 1) for splits and samples: eight md5 digits of the seed and the columns, so that
    any engine with md5 draws the same."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(2**32))
