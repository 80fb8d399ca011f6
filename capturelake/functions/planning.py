"""Manual exposure and focus planning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capturelake.functions.imaging import java_round
from capturelake.policies import TARGET_EXPOSURE_NS, Policy, threshold

MANUAL_SENSOR = 1


def contains(values: Column, wanted: int) -> Column:
    """Membership where a missing array is false."""
    return F.coalesce(F.array_contains(values, F.lit(wanted)), F.lit(False))


def manual_sensor_supported(capabilities: Column) -> Column:
    return contains(capabilities, MANUAL_SENSOR)


def lock_focus(distance: Column, min_focus_distance: Column) -> Column:
    """Focus distance held between 0 and the closest supported one; nulls are skipped."""
    return F.least(F.greatest(F.lit(0.0), distance), min_focus_distance)


def _clamp(v: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, v))


def plan_exposure(state: dict[str, Column], caps: dict[str, Column], policy: Policy | str) -> Column:
    """struct(exposure_ns, iso, reason) for one still request.

    ``state``: exposure_time_ns, iso, focus_distance, lens_state, af_state (latest known).
    ``caps``: manual, exposure_min, exposure_max, iso_min, iso_max.
    The product exposure·ISO is kept while moving towards the target shutter time.
    """
    limit_exp, limit_iso = threshold(policy, "max_exposure_ns"), threshold(policy, "max_iso")
    lo_e = caps["exposure_min"].cast("long")
    hi_e = F.least(caps["exposure_max"].cast("long"), limit_exp)
    lo_i = caps["iso_min"].cast("long")
    hi_i = F.least(caps["iso_max"].cast("long"), limit_iso)
    product = state["exposure_time_ns"].cast("double") * state["iso"].cast("double")

    first = _clamp(F.lit(TARGET_EXPOSURE_NS).cast("long"), lo_e, hi_e)
    wanted_iso = F.ceil(F.try_divide(product, first))
    needed = F.ceil(F.try_divide(product, hi_i))
    below, above = wanted_iso < lo_i, wanted_iso > hi_i
    exposure = (F.when(below, _clamp(java_round(F.try_divide(product, lo_i)), lo_e, hi_e))
                .when(above, _clamp(needed, lo_e, hi_e))
                .otherwise(first))
    iso = _clamp(java_round(F.try_divide(product, exposure)), lo_i, hi_i)

    af_ok = F.coalesce(state["af_state"].isin(0, 2, 4), threshold(policy, "plan_null_af_ok"))
    missing = state["exposure_time_ns"].isNull() | state["iso"].isNull() | state["focus_distance"].isNull()
    no_range = (caps["exposure_min"].isNull() | caps["exposure_max"].isNull()
                | caps["iso_min"].isNull() | caps["iso_max"].isNull())
    reason = (F.when(~F.coalesce(caps["manual"], F.lit(False)), "manual_unsupported")
              .when(missing, "no_metadata")
              .when(F.coalesce(state["lens_state"], F.lit(0)) != 0, "lens_moving")
              .when(~af_ok, "af_not_converged")
              .when(no_range, "range_unavailable")
              .when((lo_e > hi_e) | (lo_i > hi_i), "range_invalid")
              .when(above & (needed > hi_e), "too_dark")
              .when((exposure > limit_exp) | (iso > limit_iso), "limit_exceeded")
              .otherwise("ok"))
    ok = reason == "ok"
    return F.struct(F.when(ok, exposure).alias("exposure_ns"),
                    F.when(ok, iso).cast("int").alias("iso"), reason.alias("reason"))
