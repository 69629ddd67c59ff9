"""Progress, rates and estimates over ordered event tables.

Each has a batch form (windows and ordered folds); the stateful streaming
forms are in jobs.py and watch.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vocab

# Stages in order, their weights, and older names for them.
STAGES = (("recon", 1.0), ("discover", 1.5), ("download", 3.0), ("normalize", 1.5), ("analyze", 6.0), ("correlate", 1.0), ("verify", 4.0), ("report", 0.5))
ALIASES = {
    "queued": "recon", "scan": "analyze", "inline_scan": "analyze", "recursive_scan": "analyze", "beautify": "normalize",
    "runtime": "verify", "starting": "recon", "working": "analyze", "done": "report",
}
RATE_WINDOW_S, EMA_ALPHA, STALE_S = 12, 0.35, 45.0
RATIO_LIMITS, RATIO_ALPHA = (0.25, 4.0), 0.35


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def stage(name: Column) -> Column:
    """The stage of an emitted name; unknown ones count as analysis."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return vocab.choose(low, {n: n for n, _ in STAGES} | ALIASES, F.lit("analyze"))


def durations(events: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """Seconds from each stage change of a key to the next."""
    w = Window.partitionBy(key).orderBy(at)
    changed = events.withColumn("before", F.lag(name).over(w)).filter(F.col("before").isNull() | (F.col("before") != F.col(name)))
    until = F.lead(at).over(w)
    return changed.select(key, name, at, (_micros(until) - _micros(F.col(at))).alias("micros"))


def monotonic(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Progress that never falls: the running maximum of a key."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("progress", F.max(value).over(w))


def weighted_percent(stage_: Column, fraction: Column) -> Column:
    """Percent of the whole when `fraction` of a stage is done."""
    whole, before = sum(w for _, w in STAGES), 0.0
    out = F.lit(0.0)
    for name, weight in STAGES:
        share = F.lit(before) + F.lit(weight) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))
        out = F.when(stage_ == name, share / whole * 100).otherwise(out)
        before += weight
    return out


def window_rate(events: DataFrame, key: str, at: str, amount: str, seconds: int = RATE_WINDOW_S) -> DataFrame:
    """Amount a second over the last `seconds` up to each event."""
    w = Window.partitionBy(key).orderBy(_micros(F.col(at))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("rate", F.sum(amount).over(w) / F.lit(float(seconds)))


def ewma(values: Column, alpha: float, start: float | None = None) -> Column:
    """Exponentially weighted mean of an array, in its order."""
    first = F.lit(start) if start is not None else values[0]
    rest = values if start is not None else F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, first.cast("double"), lambda s, x: F.lit(1.0 - alpha) * s + F.lit(alpha) * x)


def tuned_ratio(samples: DataFrame, key: str, at: str, actual: str, predicted: str) -> DataFrame:
    """Each key's actual-to-predicted ratio, clamped and averaged in order."""
    low, high = RATIO_LIMITS
    ratio = F.greatest(F.lit(low), F.least(F.lit(high), F.col(actual) / F.col(predicted)))
    good = samples.filter((F.col(predicted) > 0) & (F.col(actual) > 0)).withColumn("ratio", ratio)
    ordered = good.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("ratio").alias("r")))).alias("all"))
    return ordered.select(key, F.size("all").cast("long").alias("samples"), ewma(F.transform("all", lambda s: s["r"]), RATIO_ALPHA, 1.0).alias("ratio"))


def cost_seconds(bytes_: Column) -> Column:
    """Predicted seconds to analyze one file."""
    return F.lit(0.35) + F.lit(20.0) * F.pow(bytes_ / F.lit(1_000_000.0), F.lit(1.7))


def staleness(quiet_seconds: Column) -> Column:
    return F.exp(-quiet_seconds / F.lit(STALE_S))


# Work and seconds from which a rate is trusted, limits of weights and of rises, and the longest estimate.
CONFIDENT_AT, CONFIDENT_S, WEIGHTS, RISE, SLACK_S, LONGEST_S = 0.35, 8.0, (0.05, 0.95), 1.6, 3.0, 900.0


def observed_confidence(fraction: Column, elapsed: Column) -> Column:
    """How far a measured rate is to be trusted: by work done and time watched."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction / CONFIDENT_AT, elapsed / CONFIDENT_S))


def model_weight(observed: Column, model: Column, quiet_seconds: Column) -> Column:
    """The cost model's part of an estimate: it leads while little was measured,
    and again when progress has been quiet."""
    return F.greatest(F.lit(WEIGHTS[0]), F.least(F.lit(WEIGHTS[1]), model * (F.lit(1.0) - observed * staleness(quiet_seconds))))


def blended_eta(observed_eta: Column, observed: Column, model_eta: Column, model: Column, quiet_seconds: Column, previous: Column) -> Column:
    """Seconds left: the measured and the model's estimate by weight (the
    model's alone where nothing was measured), rising no faster than a share
    of the previous one, and never beyond a horizon that grows with the work."""
    w = model_weight(observed, model, quiet_seconds)
    mixed = F.coalesce((F.lit(1.0) - w) * observed_eta + w * model_eta, model_eta)
    limited = F.when(mixed > previous, F.least(mixed, previous * (F.lit(RISE) + 1.2 * model) + SLACK_S + 30.0 * model)).otherwise(mixed)
    horizon = F.greatest(F.lit(LONGEST_S), F.least(3.0 * model_eta + 60.0, F.lit(5400.0)))
    return F.greatest(F.lit(0.0), F.least(limited, horizon))


def eta_basis(observed_eta: Column, weight: Column) -> Column:
    return F.when(observed_eta.isNull() | (weight >= 0.7), "workload model").when(weight >= 0.35, "blended").otherwise("observed rate")


def heartbeat_age(events: DataFrame, key: str, at: str, now: Column) -> DataFrame:
    """Seconds since the last event of each key."""
    return events.groupBy(key).agg(((_micros(now) - _micros(F.max(at))) / F.lit(1e6)).alias("age"))


def retained_jobs(jobs: DataFrame, now: Column, seconds: int = 3600, most: int = 64) -> DataFrame:
    """Jobs (job_id, finished_at) that are kept: unfinished ones, and of those
    finished in the last `seconds` the newest, `most` in all."""
    fresh = jobs.filter(F.col("finished_at").isNull() | (_micros(F.col("finished_at")) >= _micros(now) - seconds * 1_000_000))
    return fresh.orderBy(F.col("finished_at").desc_nulls_first(), F.desc("job_id")).limit(most)
