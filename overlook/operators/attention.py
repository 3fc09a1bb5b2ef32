"""Inspection patches and the choice of patches within a time budget."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import bearing


def polar_patches(points: DataFrame, by: str, width_deg: int, band: float, radius: float, cell_km2: float) -> DataFrame:
    """points (by, dx, dy, reward) in bins of ring and sector, empty bins kept; the last ring takes what lies beyond."""
    sectors, rings = 360 // width_deg, int(radius / band)
    sector = F.least(F.floor(bearing(F.col("dx"), F.col("dy")) / width_deg), F.lit(sectors - 1))
    ring = F.least(F.floor(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) / band), F.lit(rings - 1))
    found = points.groupBy(by, (ring * sectors + sector).cast("int").alias("patch")).agg((F.count("*") * cell_km2).alias("visible_km2"), (F.sum("reward") * cell_km2).alias("reward"))
    every = points.select(by).distinct().withColumn("patch", F.explode(F.sequence(F.lit(0), F.lit(sectors * rings - 1))))
    inner = F.floor(F.col("patch") / sectors) * band
    full = math.radians(width_deg) * ((inner + band) ** 2 - inner**2) / 2 / 1e6
    return every.join(found, [by, "patch"], "left").select(by, "patch", full.alias("full_km2"), F.coalesce("visible_km2", F.lit(0.0)).alias("visible_km2"), F.coalesce("reward", F.lit(0.0)).alias("reward"))


def _items(patches: DataFrame, by: str, rate: float, overhead: float, quantum: float) -> DataFrame:
    """(by, items) with each group's patches in order, their cost in units of time and their reward."""
    area = F.when(F.coalesce(F.col("full_km2") >= 0, F.lit(False)) & ~F.isnan(F.col("full_km2").cast("double")), F.col("full_km2")).otherwise(F.raise_error(F.lit("a patch's area is unknown or negative")).cast("double"))
    units = F.greatest(F.lit(1), F.ceil((area / rate + overhead) / quantum - 1e-9)).cast("int")
    checked = F.when(F.col("reward") < 0, F.raise_error(F.lit("a reward is negative")).cast("double")).otherwise(F.col("reward"))
    return patches.withColumn("reward", checked).where("reward is not null").groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("patch"), units.alias("u"), F.col("reward").cast("double").alias("v")))).alias("items"))


def knapsack(patches: DataFrame, by: str, budget: float, rate: float = 0.02, overhead: float = 0.5, quantum: float = 0.25) -> DataFrame:
    """(by, score) of the exact best choice of patches (by, patch, full_km2, reward) in each group; a negative reward raises, as does an area that is negative or unknown; a patch of unknown reward can't be chosen.

    A fold over the group's patches in order, with one best reward per unit of time: array functions
    alone, and a group's patches are as many as its bins.
    """
    capacity = math.floor(budget / quantum + 1e-9)
    items = _items(patches, by, rate, overhead, quantum)
    best = F.expr(f"""aggregate(items, transform(sequence(0, {capacity}), t -> 0D),
        (b, x) -> transform(b, (old, t) -> if(t >= x.u and b[t - x.u] + x.v > old + 1e-14, b[t - x.u] + x.v, old)), b -> b[{capacity}])""")
    return items.select(by, best.alias("score"))


def chosen(patches: DataFrame, by: str, budget: float, rate: float = 0.02, overhead: float = 0.5, quantum: float = 0.25) -> DataFrame:
    """(by, score, patches, minutes) of the exact best choice: the fold of `knapsack` with the list of chosen patches beside each best reward."""
    capacity = math.floor(budget / quantum + 1e-9)
    kind = patches.schema["patch"].dataType.simpleString()
    items = _items(patches, by, rate, overhead, quantum)
    best = F.expr(f"""aggregate(items, transform(sequence(0, {capacity}), t -> named_struct('v', 0D, 'u', 0, 'p', cast(array() as array<{kind}>))),
        (b, x) -> transform(b, (old, t) -> if(t >= x.u and b[t - x.u].v + x.v > old.v + 1e-14, named_struct('v', b[t - x.u].v + x.v, 'u', b[t - x.u].u + x.u, 'p', concat(b[t - x.u].p, array(x.patch))), old)), b -> b[{capacity}])""")
    return items.select(by, best.alias("m")).select(by, F.col("m.v").alias("score"), F.col("m.p").alias("patches"), (F.col("m.u") * quantum).alias("minutes"))


#: The middle mix and budget at which one cost at a time is changed, and the changes.
MIDDLE = (0.5, 30.0)
CHANGES = {"width20": {"width": 20}, "width45": {"width": 45}, "rate0.01": {"rate": 0.01}, "rate0.04": {"rate": 0.04}, "overhead0": {"overhead": 0.0}, "overhead1": {"overhead": 1.0}}


def scenarios(points: DataFrame, mixes: list[float], budgets: list[float], cell_km2: float, width: int = 30, band: float = 500.0, radius: float = 2000.0, rate: float = 0.02, overhead: float = 0.5, quantum: float = 0.25) -> DataFrame:
    """(id, scenario, strategy, score) of targets in sight (id, dx, dy, summer, winter, other): for each mix of seasons and each budget the exact choice of patches, an even look, and no
    limit; and the exact choice under each of CHANGES to the costs at the middle mix and budget. Mixes and budgets are short fixed lists; a patch's
    rewards for all mixes are made side by side, so that targets are read once."""

    def patches_of(mix: float, wide: int) -> DataFrame:
        reward = ((1 - mix) * F.col("summer") + mix * F.col("winter")) * F.col("other")
        return polar_patches(points.select("id", "dx", "dy", reward.alias("reward")), "id", wide, band, radius, cell_km2)

    costs = {"rate": rate, "overhead": overhead, "quantum": quantum}
    named = lambda df, scenario, strategy: df.select("id", F.lit(scenario).alias("scenario"), F.lit(strategy).alias("strategy"), F.col("score"))
    parts = []
    for mix in mixes:
        p = patches_of(mix, width)
        full = p.groupBy("id").agg(F.sum("reward").alias("score"))
        both = sweep(p, "id", list(budgets), **costs)
        for b in budgets:
            at = f"winter{mix:g}_minutes{b:g}"
            one = both.where(F.col("budget") == float(b))
            parts += [named(one.withColumn("score", F.col(s)), f"{s}_{at}", s) for s in ("selective", "uniform")] + [named(full, f"none_{at}", "none")]
    if MIDDLE[0] in mixes:
        for name, change in CHANGES.items():
            p = patches_of(MIDDLE[0], change.get("width", width))
            parts.append(named(knapsack(p, "id", MIDDLE[1], **{**costs, **{k: v for k, v in change.items() if k != "width"}}), name, "selective_sensitivity"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def sweep(patches: DataFrame, by: str, budgets: list[float], **costs) -> DataFrame:
    """(by, budget, selective, uniform) for a fixed list of budgets: the exact choice of patches, and the score if the time went evenly over all that is visible."""
    rate = costs.get("rate", 0.02)
    whole = patches.groupBy(by).agg(F.sum("reward").alias("reward"), F.sum("visible_km2").alias("km2"))
    out = None
    for b in budgets:
        one = knapsack(patches, by, b, **costs).join(whole, by)
        even = F.when(F.col("km2") > 0, F.col("reward") * F.least(F.lit(1.0), b * rate / F.col("km2"))).otherwise(0.0)
        one = one.select(by, F.lit(float(b)).alias("budget"), F.col("score").alias("selective"), even.alias("uniform"))
        out = one if out is None else out.union(one)
    return out
