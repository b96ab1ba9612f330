"""Metric names of training logs: one spelling, word sets, loss tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The loss vocabularies, best name first.
TRAIN_LOSS = ("train_loss", "loss", "training_loss", "tr_loss")
VAL_LOSS = ("val_loss", "valid_loss", "validation_loss")


def normalised(key: Column) -> Column:
    """Lower case, one underscore for any run of separators, none at the ends."""
    folded = F.regexp_replace(F.lower(F.trim(key)), r"[\s_/.\-]+", "_")
    return F.regexp_replace(folded, "^_+|_+$", "")


def words(key: Column) -> Column:
    """The distinct words of a name in sorted order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normalised(key), "_"), lambda w: w != "")))


def is_loss(key: Column) -> Column:
    return F.contains(normalised(key), F.lit("loss"))


def not_finite(value: Column) -> Column:
    return F.isnan(value) | value.isin(float("inf"), float("-inf"))


def first_of(metrics: Column, names: Sequence[str]) -> Column:
    """The value of the first vocabulary name whose words a metric has."""
    entries = F.map_entries(metrics)

    def named(name: str) -> Column:
        wanted = F.array(*[F.lit(w) for w in sorted(set(name.split("_")))])
        return F.get(F.filter(entries, lambda e: words(e["key"]) == wanted), F.lit(0))["value"]

    return F.coalesce(*[named(n) for n in names])


def has_loss(metrics: Column) -> Column:
    return F.exists(F.map_keys(metrics), is_loss)


def bad_losses(metrics: Column) -> Column:
    """Names of the loss metrics whose value is NaN or infinite, sorted."""
    bad = F.map_filter(metrics, lambda k, v: is_loss(k) & not_finite(v))
    return F.array_sort(F.map_keys(bad))
