"""Trade candidates: entry, stop, target and why one is refused. Sizes are in units of the risk; the ledger gives it a currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reward to risk that is looked for: 2.0, 2.1, ... 4.0.
REWARDS = [round(2 + 0.1 * i, 10) for i in range(21)]


def sign(direction: Column) -> Column:
    return F.when(direction == "bullish", 1.0).otherwise(-1.0)


def gates(min_atr_pct: float | None = None, max_atr_pct: float | None = None, min_vol_ratio: float | None = None, max_vol_ratio: float | None = None, min_trend_eff: float | None = None) -> Column:
    """The reason why the regime forbids a trade, or null; a regime that isn't known forbids none."""
    eff = F.col("trend_eff") * sign(F.col("direction"))
    checks = [
        (min_atr_pct, F.col("atr_pct") < (min_atr_pct or 0), "atr_too_low"),
        (max_atr_pct, F.col("atr_pct") > (max_atr_pct or 0), "atr_too_high"),
        (min_vol_ratio, F.col("vol_ratio") < (min_vol_ratio or 0), "volume_too_low"),
        (max_vol_ratio, F.col("vol_ratio") > (max_vol_ratio or 0), "volume_too_high"),
        (min_trend_eff, eff < (min_trend_eff or 0), "inefficient_trend"),
    ]
    return F.coalesce(*[F.when(bad, why) for limit, bad, why in checks if limit is not None], F.lit(None).cast("string"))


def entry_price(buffer_atr: float = 0.0, slippage_pct: float = 0.0) -> Column:
    s = sign(F.col("direction"))
    return (F.col("close") + s * buffer_atr * F.col("atr")) * (1 + s * slippage_pct / 100)


def stop_price(entry: Column, offset: int = 0, buffer_atr: float = 0.0, fallback_atr: float = 2.0, width: float = 1.0) -> Column:
    """Beyond the swing ``offset`` back on the far side of the entry (the first, if there are fewer), or else ``fallback_atr`` ATRs away."""
    s = sign(F.col("direction"))
    kind = F.when(s > 0, "L").otherwise("H")
    own = F.filter("swings", lambda p: (p["type"] == kind) & ((entry - p["price"]) * s > 0))
    anchor = F.coalesce(F.try_element_at(own, F.lit(-1 - offset)), F.try_element_at(own, F.lit(1)))["price"]
    stop = F.coalesce(anchor - s * buffer_atr * F.col("atr"), entry - s * fallback_atr * F.col("atr"))
    return entry - (entry - stop) * width


def _blocked(levels: Column, entry: Column, target: Column, atr: Column, buffer: float) -> Column:
    low, high = F.least(entry, target), F.greatest(entry, target)
    return F.exists(levels, lambda x: ((x > low) & (x < high)) | (F.abs(x - target) < buffer * atr))


def reward(levels: Column, entry: Column, stop: Column, atr: Column, buffer: float = 0.5) -> Column:
    """The least reward on the grid whose target no level blocks or is near; null if all are blocked."""
    s = F.when(entry > stop, 1.0).otherwise(-1.0)
    clear = F.filter(F.array(*[F.lit(r) for r in REWARDS]), lambda r: ~_blocked(levels, entry, entry + s * r * F.abs(entry - stop), atr, buffer))
    return F.try_element_at(clear, F.lit(1))


def blocking(levels: Column, entry: Column, stop: Column) -> Column:
    """The levels that lie within the grid's reach."""
    s = F.when(entry > stop, 1.0).otherwise(-1.0)
    far = REWARDS[-1]
    return F.filter(F.array_sort(levels), lambda x: ((x - entry) * s > 0) & ((x - entry) * s <= far * F.abs(entry - stop)))


def anchor_level(levels: Column, target: Column, direction: Column, atr: Column, max_atr: float = 1.0) -> Column:
    """The nearest level beyond the target, within ``max_atr`` ATRs."""
    s = sign(direction)
    near = F.filter(levels, lambda x: ((x - target) * s > 0) & ((x - target) * s <= max_atr * atr))
    return F.array_min(F.transform(near, lambda x: F.struct(F.abs(x - target).alias("d"), x.alias("level"))))["level"]


def widest_stop(levels: Column, entry: Column, direction: Column, atr: Column, max_stop_atr: float = 3.0, buffer: float = 0.5) -> Column:
    """The widest stop on a grid of 0.1 ATRs that no level is near and that some reward is clear for: (stop, rr)."""
    s = sign(direction)
    steps = [round(0.1 * i, 10) for i in range(int(round(max_stop_atr * 10)), 4, -1)]
    tried = F.transform(F.array(*[F.lit(w) for w in steps]), lambda w: F.struct((entry - s * w * atr).alias("stop"), reward(levels, entry, entry - s * w * atr, atr, buffer).alias("rr")))
    good = F.filter(tried, lambda t: t["rr"].isNotNull() & ~F.exists(levels, lambda x: F.abs(x - t["stop"]) < buffer * atr))
    return F.try_element_at(good, F.lit(1))


def risk_candidates(signals: DataFrame, max_stop_atr: float = 4.0, buffer: float = 0.5, spacing: bool = True, **regime: float) -> DataFrame:
    """Candidates of signals (close, atr, swings, levels and the regime): the swing stop with the least clear reward, or the widest clear stop.

    reject_reason: a gate's, no_risk, stop_too_wide, stop_crosses_level or no_clear_target.
    """
    rows = signals.withColumn("entry", entry_price())
    rows = rows.withColumn("stop", stop_price(F.col("entry"), buffer_atr=0.1))
    distance = F.abs(F.col("entry") - F.col("stop"))
    lv = F.col("levels")
    crosses = F.exists(lv, lambda x: (x > F.least("entry", "stop")) & (x < F.greatest("entry", "stop")))
    rows = rows.withColumn("rr", reward(lv, F.col("entry"), F.col("stop"), F.col("atr"), buffer))
    why = F.coalesce(gates(**regime), F.when(~(distance > 0), "no_risk").when(distance > max_stop_atr * F.col("atr"), "stop_too_wide").when(crosses, "stop_crosses_level").when(F.col("rr").isNull(), "no_clear_target"))
    rows = rows.withColumn("reject_reason", why)
    if spacing:
        second = F.when(F.col("reject_reason").isin("stop_crosses_level", "no_clear_target", "stop_too_wide"), widest_stop(lv, F.col("entry"), F.col("direction"), F.col("atr"), max_stop_atr, buffer))
        rows = rows.withColumn("_w", second)
        found = F.col("_w.rr").isNotNull()
        rows = rows.withColumns({"stop": F.when(found, F.col("_w.stop")).otherwise(F.col("stop")), "rr": F.when(found, F.col("_w.rr")).otherwise(F.col("rr")), "spaced": found, "reject_reason": F.when(found, F.lit(None).cast("string")).otherwise(F.col("reject_reason"))}).drop("_w")
    return rows.withColumn("target", F.col("entry") + sign(F.col("direction")) * F.col("rr") * F.abs(F.col("entry") - F.col("stop")))


def atr_bracket(signals: DataFrame, stop_atr: float = 1.5, target_atr: float = 3.0, atr: str = "pivot_atr") -> DataFrame:
    """A bracket around the close, by the ATR at the pivot's bar; refused where that is not known."""
    s, a = sign(F.col("direction")), F.col(atr)
    ok = F.coalesce(a > 0, F.lit(False))
    return signals.withColumns(
        {
            "entry": F.col("close"),
            "stop": F.when(ok, F.col("close") - s * stop_atr * a),
            "target": F.when(ok, F.col("close") + s * target_atr * a),
            "reject_reason": F.when(~ok, "no_atr"),
        }
    )


def sized(candidates: DataFrame, balance: Column, risk_pct: float = 1.0, multiplier: Column | None = None) -> DataFrame:
    """risk_amount, size and reward_amount for a balance."""
    risk = balance * risk_pct / 100 * (multiplier if multiplier is not None else F.lit(1.0))
    return candidates.withColumns({"risk_amount": risk, "size": F.try_divide(risk, F.abs(F.col("entry") - F.col("stop"))), "reward_amount": risk * F.try_divide(F.abs(F.col("target") - F.col("entry")), F.abs(F.col("entry") - F.col("stop")))})
