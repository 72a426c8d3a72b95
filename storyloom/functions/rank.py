"""Ranking expressions. `as_of` is always explicit, so that a result can be had again."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from .text import hours_between


def _age(as_of: Column, ts: Column) -> Column:
    return F.greatest(F.lit(0.0), hours_between(as_of, ts))


def recency(as_of: Column, event_time: Column, last_activity: Column, s: Settings = DEFAULT) -> Column:
    age = 0.7 * _age(as_of, event_time) + 0.3 * _age(as_of, last_activity)
    return F.pow(F.lit(0.5), age / s.half_life_h)


def _share(value: Column, norm: float) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), value.cast("double"))) / math.log1p(norm))


def score(authority: Column, independent: Column, velocity: Column, recency_multiplier: Column, relevance: Column | None = None, s: Settings = DEFAULT) -> Column:
    base = s.w_authority * _share(authority, s.authority_norm) + s.w_breadth * _share(independent, s.breadth_norm) + s.w_velocity * _share(velocity, s.velocity_norm)
    own = F.lit(0.0) if relevance is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), relevance))
    return F.round(base * recency_multiplier + s.w_relevance * own, 6)


def relevance(topic_list: Column, affinity: Column) -> Column:
    """The largest weight, within 0 to 1, that a map from topic to weight has for any of the topics."""
    best = F.array_max(F.transform(topic_list, lambda t: F.coalesce(F.try_element_at(affinity, t), F.lit(0.0))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(best, F.lit(0.0))))
