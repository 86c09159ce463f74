"""Weights of an edge and what is read off a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def st_mismatch(a: Column, b: Column) -> Column:
    """Whether two sequence types differ; a missing one never does."""
    return F.coalesce(F.nullif(a, F.lit("")) != F.nullif(b, F.lit("")), F.lit(False))


def composite_weight(snp: Column, days: Column, mismatch: Column, snp_cutoff: float = 20, day_cutoff: int = 14, alpha: float = 0.4, beta: float = 0.4, gamma: float = 0.2) -> Column:
    """alpha * snp / cutoff + beta * days / cutoff + gamma if the types differ; a cutoff below 1 counts as 1."""
    x = F.lit(alpha) * (snp.cast("double") / F.lit(float(max(snp_cutoff, 1))))
    y = F.lit(beta) * (days.cast("double") / F.lit(float(max(day_cutoff, 1))))
    return x + y + F.lit(gamma) * F.when(mismatch, 1.0).otherwise(0.0)


def similarity(weight: Column) -> Column:
    """exp(-weight)."""
    return F.exp(-weight)


def floor_weight(weight: Column) -> Column:
    """The weight as a path length: at least 1e-6."""
    return F.greatest(weight, F.lit(1e-6))


def stability_class(score: Column) -> Column:
    """stable from 0.9, uncertain from 0.7, else unstable."""
    return F.when(score >= 0.9, "stable").when(score >= 0.7, "uncertain").otherwise("unstable")


def grade(mean: Column) -> Column:
    """A from 0.9, B from 0.75, else C."""
    return F.when(mean >= 0.9, "A").when(mean >= 0.75, "B").otherwise("C")
