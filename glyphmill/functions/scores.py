"""Ratios, scores and bucket arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def reduction_ratio(before: Column, after: Column) -> Column:
    """The share saved; 0 on growth and for nothing."""
    return F.when((before > 0) & (after < before), (before - after) / before).otherwise(F.lit(0.0))


def compression_ratio(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.lit(1.0)).when(after == 0, before.cast("double")).otherwise(before / after)


def cost_estimate(tokens: Column, rate_per_million: float | None) -> Column:
    if rate_per_million is None or not math.isfinite(rate_per_million) or rate_per_million <= 0:
        return F.lit(None).cast("double")
    return tokens / F.lit(1e6) * F.lit(float(rate_per_million))


def hour_bucket(ts: Column) -> Column:
    return F.date_trunc("HOUR", ts)


def day_bucket(ts: Column) -> Column:
    return F.date_trunc("DAY", ts)


def cache_hits(hits: Column, lookups: Column) -> Column:
    return F.least(hits, lookups)


def hit_rate(hits: Column, lookups: Column) -> Column:
    return F.when(lookups > 0, F.least(hits, lookups) / lookups)


def normalize_keyword(relevance: Column, best: Column) -> Column:
    return F.when(best > 0, F.least(F.greatest(relevance / best, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def normalize_graph(dependents: Column, most: Column) -> Column:
    return F.when(most > 0, F.log1p(dependents.cast("double")) / F.log1p(most.cast("double"))).otherwise(F.lit(0.0))


def normalize_recency(age_days: Column, half_life_days: float, mtime: Column | None = None) -> Column:
    decayed = F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life_days)
    return decayed if mtime is None else F.when(mtime <= 0, F.lit(0.0)).otherwise(decayed)


# The default weights of the signals.
WEIGHTS = {"keyword": 1.0, "semantic": 0.0, "symbol": 1.5, "graph": 0.5, "recency": 0.3}
HOP_DECAY = 0.4


def validate(weights: dict[str, float]) -> dict[str, float]:
    for k, w in weights.items():
        if k not in WEIGHTS or not math.isfinite(w) or w < 0:
            raise ValueError(f"bad weight {k}={w}")
    if not any(w > 0 for w in weights.values()):
        raise ValueError("all weights are 0")
    return weights


def score(signals: dict[str, Column], hops: Column, weights: dict[str, float] = WEIGHTS, hop_decay: float = HOP_DECAY) -> Column:
    out = F.lit(0.0)
    for k, s in signals.items():
        if weights.get(k):
            out = out + F.lit(weights[k]) * s
    return out * F.pow(F.lit(hop_decay), hops.cast("double"))


def symbol_score(name: Column, terms: list[str]) -> Column:
    low = F.lower(name)
    each = [F.when(low == t, 1.0).when(low.startswith(t), 0.7).when(low.contains(t), 0.4).otherwise(0.0) for t in terms]
    return F.greatest(*each, F.lit(0.0))


def match_reason(text_hit: Column, symbol_hit: Column, related: Column) -> Column:
    return F.when(related, "related").when(text_hit & symbol_hit, "content_and_symbol").when(symbol_hit, "symbol").otherwise("content")


def unit(vector: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: (x / norm).cast("float"))).otherwise(vector)


def similarity(a: Column, b: Column) -> Column:
    """The dot product of unit vectors within -1 and 1; 0 if their lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(0.0))
