"""Hamming distances of aligned sequences without forming all pairs.

A symbol string becomes 64-bit words, per position one bit of each plane and one for whether the base counts; a distance
is then a sum of bit_count over words. Close pairs come from the pigeonhole principle: two strings that differ in at
most k places agree in one of k + 1 bands, and nearly agree in one of fewer, longer bands, under whose nearby values a
word is looked up. Strings with masked places, which agree with anything, are compared as a
query set in blocks. A search takes a stated query set against all rows, in blocks.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainweave.plans.shared import cut

#: Rows of one block of a query set.
BLOCK = 1024
#: Most values under which a word is looked up.
MAX_PROBES = 4096


def sign_word(vector: Column, floor: float = 0.0) -> Column:
    """A vector of up to 64 numbers as one word: bit i is set where the number i is >= 0. A longer one is an error."""
    return _checked(vector, F.aggregate(F.transform(vector, lambda x, i: F.when(x >= floor, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)))


def _checked(vector: Column, word: Column) -> Column:
    return F.when(F.size(vector) <= 64, word).when(vector.isNotNull(), F.raise_error(F.lit("a word holds 64 places")).cast("bigint"))


def valid_word(vector: Column, unsure: float) -> Column:
    """Bit i is set where the number i is at least `unsure` away from 0: the others are masked like N."""
    return _checked(vector, F.aggregate(F.transform(vector, lambda x, i: F.when(F.abs(x) >= unsure, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)))


def word_distance(a: Column, b: Column, valid: Column | None = None) -> Column:
    """Places in which two words differ, of the valid ones."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x if valid is None else x.bitwiseAND(valid))


def search_words(rows: DataFrame, queries: DataFrame, node: str, most: int, masked: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, node, distance) of all rows within `most` of a query, itself left out. rows and queries: node, word (, valid).

    The query set is cut into blocks and every row meets every block once: an equi-join on the block's number.
    """
    n = max(1, -(-queries.count() // block))
    cols = ["word", "valid"] if masked else ["word"]
    q = queries.select(F.pmod(F.xxhash64(node), F.lit(n)).alias("__b"), F.col(node).alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in cols])
    r = rows.select(node, *cols, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("__b"))
    valid = F.col("valid").bitwiseAND(F.col("q_valid")) if masked else None
    d = word_distance(F.col("word"), F.col("q_word"), valid)
    return r.join(q, "__b").select("query_id", node, d.cast("int").alias("distance")).filter((F.col("query_id") != F.col(node)) & (F.col("distance") <= most))


def probe_plan(most: int, bits: int = 64, max_probes: int = MAX_PROBES) -> list[tuple[int, int, int]]:
    """(low, high, radius) of the bands of a word: two words within `most` differ in at most `radius` places of one of them.

    A row is looked up under every value within the radius, at most max_probes of them over all bands. Of the numbers of
    bands that allow it the one is taken by which the fewest of all pairs meet; with most + 1 bands the radius is 0.
    """
    plans = []
    for bands in range(1, min(most + 1, bits) + 1):
        cuts = [round(i * bits / bands) for i in range(bands + 1)]
        radius = [(most + 1) // bands - 1 + (i < (most + 1) % bands) for i in range(bands)]
        plan = list(zip(cuts, cuts[1:], radius))
        volume = [sum(math.comb(h - l, i) for i in range(r + 1)) for l, h, r in plan]
        if sum(volume) <= max(max_probes, bands):
            plans.append((sum(v / 2 ** (h - l) for v, (l, h, _) in zip(volume, plan)), sum(volume), plan))
    return min(plans)[2] if plans else [(i, i + 1, 0) for i in range(bits)]


def close_words(rows: DataFrame, node: str, most: int, bits: int = 64) -> DataFrame:
    """(src, dst, distance) of all pairs of rows within `most`, src < dst, exact: some band of the word nearly agrees.

    Every pair is a row of the result; where copies abound and pairs of classes are enough, close_classes is the form.
    """
    return close_candidates(rows, node, most, bits).filter(F.col("distance") <= most).select("src", "dst", "distance")


def close_candidates(rows: DataFrame, node: str, most: int, bits: int = 64) -> DataFrame:
    """(src, dst, distance) of the pairs that meet in a band, each in the first where it does: what close_words compares."""
    if most >= bits:
        raise ValueError("all pairs are within the limit")
    plan = probe_plan(most, bits)
    part = lambda word, low, high: F.call_function("shiftrightunsigned", F.call_function("shiftleft", word, F.lit(64 - high)), F.lit(64 - high + low))
    banded = rows.select(node, "word", F.posexplode(F.array(*[part(F.col("word"), low, high) for low, high, _ in plan])).alias("band", "value"))
    masks = [(i, sum(1 << p for p in places)) for i, (low, high, r) in enumerate(plan) for n in range(r + 1) for places in combinations(range(high - low), n)]
    flips = rows.sparkSession.createDataFrame(masks, "band int, mask bigint")
    asked = banded.join(F.broadcast(flips), "band").select("band", F.col("value").bitwiseXOR(F.col("mask")).alias("value"), F.col(node).alias("src"), F.col("word").alias("src_word"))  # at most MAX_PROBES masks
    there = banded.select("band", "value", F.col(node).alias("dst"), F.col("word").alias("dst_word"))
    d = asked.join(there, ["band", "value"]).filter("src < dst").withColumn("x", F.col("src_word").bitwiseXOR(F.col("dst_word")))
    # a pair may meet in several bands; the first of them reports it
    meets = F.array(*[F.bit_count(F.col("x").bitwiseAND(F.lit(_mask(low, high)))) <= r for low, high, r in plan])
    return d.filter(F.array_position(meets, True) == F.col("band") + 1).select("src", "dst", F.bit_count("x").cast("int").alias("distance"))


def close_classes(rows: DataFrame, node: str, most: int, bits: int = 64) -> DataFrame:
    """(src, dst, distance) of all pairs of classes of equal words within `most`, src < dst, and of the members of each class.

    A class is named by its smallest node; every other member has one row (class, member, 0), so copies, however many,
    are never expanded into pairs. Rows with a null word or node have none; repeated rows count once.
    """
    rows = rows.filter(F.col("word").isNotNull() & F.col(node).isNotNull()).select(node, "word")
    classes = cut(rows.groupBy("word").agg(F.min(node).alias(node)), "classes")  # written: a word with very many rows is split in the join
    members = rows.select(F.col(node).alias("dst"), "word").join(classes.select("word", F.col(node).alias("src")), "word").filter("dst > src").select("src", "dst", F.lit(0).alias("distance")).distinct()
    return close_words(classes, node, most, bits).unionByName(members)


def close_rows(rows: DataFrame, node: str, most: int, bits: int = 64) -> DataFrame:
    """close_words by way of classes: distinct words are compared, and the pairs of classes then give the pairs of rows."""
    rows = cut(rows.filter(F.col("word").isNotNull() & F.col(node).isNotNull()).select(node, "word"), "rows")
    classes = cut(rows.groupBy("word").agg(F.min(node).alias("class")), "classes")
    of = cut(rows.join(classes, "word").select(node, "class"), "class-of")
    pairs = close_words(classes, "class", most, bits).unionByName(classes.select(F.col("class").alias("src"), F.col("class").alias("dst"), F.lit(0).alias("distance")))
    at = lambda end, name: of.select(F.col("class").alias(end), F.col(node).alias(name))
    both = pairs.join(at("src", "a"), "src").join(at("dst", "b"), "dst").filter((F.col("src") != F.col("dst")) | (F.col("a") < F.col("b")))
    return both.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "distance")


def _mask(low: int, high: int) -> int:
    m = ((1 << high) - 1) ^ ((1 << low) - 1)
    return m - (1 << 64) if m >= 1 << 63 else m


def sequence_distance(a: Column, b: Column) -> Column:
    """Places in which two aligned sequences differ and neither has N or a gap."""
    bad = lambda c: c.isin("N", "-")
    return F.aggregate(F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: F.when((x != y) & ~bad(x) & ~bad(y), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)


def check_sequences(seqs: DataFrame) -> None:
    """Refuses an empty input, empty sequences, and sequences of different lengths."""
    r = seqs.agg(F.count("*").alias("n"), F.min(F.length("seq")).alias("low"), F.max(F.length("seq")).alias("high")).first()
    if not r["n"]:
        raise ValueError("no sequences")
    if not r["high"]:
        raise ValueError("all sequences are empty")
    if r["low"] != r["high"]:
        raise ValueError(f"sequences differ in length ({r['low']} to {r['high']}): align first")


def close_sequences(seqs: DataFrame, most: int) -> DataFrame:
    """(src, dst, d) of all pairs of sequences within `most` differences, src < dst; seqs has isolate_id and seq.

    The sequence is cut into more bands than most + 1. Two sequences that are masked in few of them (at most `spare` each)
    share a band that is whole in both and equal, and meet there by its hash; only ids travel, and the sequences are
    fetched for pairs that met. Sequences masked in more bands are a query set against all, in blocks.
    """
    check_sequences(seqs)
    s = seqs.select("isolate_id", F.upper("seq").alias("seq"))
    size = s.agg(F.max(F.length("seq")).alias("n")).first()["n"]
    bands = min(4 * (most + 1), size)
    spare = max(0, (bands - most - 1) // 2)
    cuts = [round(i * size / bands) for i in range(bands + 1)]
    parts = F.array(*[F.substring("seq", cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(bands)])
    hashes = F.transform(parts, lambda x: F.when(~x.rlike("[N-]"), F.xxhash64(x)))
    s = s.select("isolate_id", "seq", F.explode(F.array(hashes)).alias("hashes"))
    s = cut(s.withColumn("masked", F.size(F.filter("hashes", lambda h: h.isNull())) > spare if bands > most else F.lit(True)), "sequences")
    banded = s.filter("not masked").select("isolate_id", F.posexplode("hashes").alias("band", "value")).filter("value is not null")
    side = lambda p: banded.select("band", "value", F.col("isolate_id").alias(p))
    met = side("src").join(side("dst"), ["band", "value"]).filter("src < dst").select("src", "dst").distinct()
    of = lambda p, *k: s.select(*k, F.col("isolate_id").alias(p), F.col("seq").alias(f"{p}_seq"))
    plain = met.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", "src_seq", "dst_seq")
    m = s.filter("masked")
    blocks = max(1, -(-m.count() // BLOCK))
    q = of("a", "masked").filter("masked").drop("masked").withColumn("b", F.pmod(F.xxhash64("a"), F.lit(blocks)))
    r = of("o", "masked").withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    # of two masked sequences the smaller one asks
    asked = r.join(q, "b").filter((F.col("a") != F.col("o")) & (~F.col("masked") | (F.col("a") < F.col("o")))).select(F.least("a", "o").alias("src"), F.greatest("a", "o").alias("dst"), F.col("a_seq").alias("src_seq"), F.col("o_seq").alias("dst_seq"))
    return plain.unionByName(asked).select("src", "dst", sequence_distance(F.col("src_seq"), F.col("dst_seq")).alias("d")).filter(F.col("d") <= most)
