"""Mixing sources to target weights by Poisson replication.

A document of a source with mean repetition rate r is used k times, k being the inverse of the Poisson distribution with
mean r at a uniform number hashed from seed and doc_id, and at most max_repeats. The rate is set so that the tokens of
the documents so repeated meet the source's target: the sum grows with the rate, so a grid of rates is summed in one
pass over the (source, tokens, uniform) table and the bracket refined. A source whose target exceeds max_repeats times
its tokens is used max_repeats times throughout. Copies are then brought into a global random order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainweave.functions.ids import clean_name
from strainweave.llm import tokens
from strainweave.plans.shared import cut

#: Rates per pass, and passes: the rate is found to one part in GRID ** PASSES of its first bracket.
GRID, PASSES = 32, 4
#: Most sources: the table of targets is small by its nature, and checked.
MAX_SOURCES = 10_000


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash of seed and doc_id."""
    h = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52))
    return (h.cast("double") + 0.5) / float(1 << 52)


def poisson_steps(rate: float, most: int) -> list[float]:
    """P(X <= k) for k = 0 .. most - 1 of a Poisson number X with that mean."""
    if rate <= 0:
        return [1.0] * most
    total, out = 0.0, []
    for k in range(most):  # in logarithms: exp(-rate) alone is 0 from 745 on
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(min(total, 1.0))
    return out


def copies(u: Column, steps: Column) -> Column:
    """The inverse of the distribution at u: how many of the ascending steps lie below u."""
    return F.size(F.filter(steps, lambda s: s < u))


def _targets(targets: DataFrame) -> list:
    rows = targets.select(clean_name(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return sorted(rows, key=lambda r: r.source)


def _summed(sized: DataFrame, grids: dict[str, list[list[float]]]) -> dict[str, list[int]]:
    """Tokens per source for each of its rates: one sum a rate, combined in every map task; sources are few, so the sums are."""
    steps = sized.sparkSession.createDataFrame(list(grids.items()), "source string, grid array<array<double>>")
    g = sized.join(F.broadcast(steps), "source")
    sums = g.groupBy("source").agg(*[F.sum(F.col("n_tokens") * copies(F.col("u"), F.get("grid", F.lit(i)))).alias(f"t{i}") for i in range(GRID + 1)])
    out = {s: [0] * len(v) for s, v in grids.items()}
    for r in sums.collect():
        out[r.source] = [r[f"t{i}"] or 0 for i in range(len(out[r.source]))]
    return out


def plan(docs: DataFrame, targets: DataFrame, seed: int = 17, path: str | None = None) -> tuple[DataFrame, list[dict]]:
    """(doc_id, source, n_tokens, u) of the documents of all target sources, written; and per source what it is to give."""
    wanted = _targets(targets)
    names = docs.sparkSession.createDataFrame([(r.source,) for r in wanted], "source string")
    own = docs.select("doc_id", "text", clean_name(F.col("source")).alias("source")).join(F.broadcast(names), "source", "left_semi")
    sized = cut(own.select("doc_id", "source", tokens.n_tokens(F.col("text"), path).alias("n_tokens"), uniform(F.col("doc_id"), seed).alias("u")), "sized")
    has = {r.source: r.t for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    total = sum(has.values())
    plans = []
    for r in wanted:
        have, want, most = has.get(r.source, 0), (r.target_share or 0.0) * total, max(0, r.max_repeats or 0)
        plans.append({"source": r.source, "target_share": r.target_share, "target_tokens": round(want), "source_tokens": have, "max_repeats": most, "full": have * most <= want, "low": 0.0, "high": 0.0})
    open_ = [p for p in plans if not p["full"] and p["target_tokens"]]
    for p in open_:
        p["high"] = 4.0 * p["max_repeats"] + 40.0  # here practically every document has max_repeats copies
    for _ in range(PASSES if open_ else 0):
        rates = {p["source"]: [p["low"] + (p["high"] - p["low"]) * i / GRID for i in range(GRID + 1)] for p in open_}
        sums = _summed(sized, {p["source"]: [poisson_steps(x, p["max_repeats"]) for x in rates[p["source"]]] for p in open_})
        for p in open_:
            got, at = sums[p["source"]], rates[p["source"]]
            i = max((i for i in range(GRID + 1) if got[i] <= p["target_tokens"]), default=0)
            p["low"], p["high"] = at[i], at[min(i + 1, GRID)]
    for p in plans:
        p["rate"] = None if p["full"] else p["low"]
        p["steps"] = [0.0] * p["max_repeats"] if p["full"] else poisson_steps(p["low"], p["max_repeats"]) if p["low"] else []
    return sized, plans


def _steps(docs: DataFrame, plans: list[dict]) -> DataFrame:
    return F.broadcast(docs.sparkSession.createDataFrame([(p["source"], p["steps"]) for p in plans], "source string, steps array<double>"))


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 17, path: str | None = None, name: str = tokens.NAME) -> DataFrame:
    """(doc_id, source, copy_no, position_key, tokenizer, text): the mixture in global random order, named with the tokenizer.

    How often a document is used follows from its hash and its source's rate, so texts meet the small broadcast table
    of rates and travel once, in the sort by position_key (a hash of seed, doc_id and copy), range-partitioned over all
    tasks. Sources are trimmed, in any case; documents of other or null sources are left out. Null and empty texts have
    no tokens and are repeated like others. Rows repeated under one doc_id are repeated alike. Empty input gives an
    empty mixture.
    """
    _, plans = plan(docs, targets, seed, path or tokens.vocabulary(name))
    texts = docs.select("doc_id", clean_name(F.col("source")).alias("source"), "text").join(_steps(docs, plans), "source")
    k = texts.withColumn("k", copies(uniform(F.col("doc_id"), seed), F.col("steps"))).filter("k > 0")
    rows = k.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy_no"), "text")
    return rows.select("doc_id", "source", "copy_no", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no").alias("position_key"), F.lit(name).alias("tokenizer"), "text").orderBy("position_key", "doc_id", "copy_no")


def shares(docs: DataFrame, targets: DataFrame, seed: int = 17, path: str | None = None, name: str = tokens.NAME) -> DataFrame:
    """Per source of the targets the tokens and share aimed at and reached, named with the tokenizer."""
    sized, plans = plan(docs, targets, seed, path or tokens.vocabulary(name))
    used = sized.join(_steps(docs, plans), "source").withColumn("k", copies(F.col("u"), F.col("steps"))).groupBy("source").agg(F.sum(F.col("k") * F.col("n_tokens")).alias("actual_tokens"), F.count_if(F.col("k") > 0).alias("n_used"), F.count("*").alias("n_documents"), F.max("k").alias("most_copies"))
    schema = "source string, target_share double, target_tokens bigint, source_tokens bigint, max_repeats int, rate double"
    wanted = docs.sparkSession.createDataFrame([(p["source"], p["target_share"], p["target_tokens"], p["source_tokens"], p["max_repeats"], p["rate"]) for p in plans], schema)
    got = F.coalesce("actual_tokens", F.lit(0).cast("bigint"))
    everything = F.sum(got).over(Window.partitionBy(F.lit(0)))  # one row a source
    return wanted.join(used, "source", "left").select("source", "target_share", "target_tokens", "source_tokens", "max_repeats", "rate", got.alias("actual_tokens"), F.try_divide(got, everything).alias("actual_share"), F.coalesce("n_used", F.lit(0).cast("bigint")).alias("n_used"), F.coalesce("n_documents", F.lit(0).cast("bigint")).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.lit(name).alias("tokenizer"))
