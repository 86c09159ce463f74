"""References to records that do not exist, are withdrawn, or arrive later.

References are pre-aggregated per key and period, once; that gives the heavy keys. Rows of heavy keys are checked against
a broadcast of their few counterparts, all others by shuffle anti-joins, and both results are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainweave.functions.ids import clean_id
from strainweave.operators.skew import HEAVY_ROWS, MAX_HEAVY, split_by
from strainweave.plans.shared import cut

#: Most withdrawn periods of heavy keys that are broadcast (some 60 bytes each); more are met by a salted shuffle.
MAX_PIECES = 100_000
#: Rows of a heavy key that share a salt, and most salts of a key.
SALT_ROWS, MAX_SALTS = 50_000, 1024


def references(df: DataFrame, table: str, time: str, key: str = "isolate_id", row_id: str = "row_id") -> DataFrame:
    """(ref_table, row_id, key, at, period) of the rows with an id. A row without a time has period null."""
    return df.select(F.lit(table).alias("ref_table"), F.col(row_id).alias("row_id"), clean_id(F.col(key)).alias("key"), F.col(time).cast("timestamp_ntz").alias("at")).filter("key is not null").withColumn("period", F.substring(F.col("at").cast("string"), 1, 7))


def records(df: DataFrame, key: str = "isolate_id", valid_from: str = "received_at", valid_to: str = "withdrawn_at") -> DataFrame:
    """(key, valid_from, valid_to) of the records; valid_to null: never withdrawn. A record without a start is never valid."""
    return df.select(clean_id(F.col(key)).alias("key"), F.col(valid_from).cast("timestamp_ntz").alias("valid_from"), F.col(valid_to).cast("timestamp_ntz").alias("valid_to")).filter("key is not null and valid_from is not null")


def reference_groups(refs: DataFrame) -> DataFrame:
    """References per table, key and period, with map-side combination."""
    return refs.groupBy("ref_table", "key", "period").agg(F.count("*").alias("n_refs"))


def heavy_references(groups: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(key, n_refs) of the keys with at least heavy_rows references, the largest MAX_HEAVY of them, written."""
    sums = groups.groupBy("key").agg(F.sum("n_refs").alias("n_refs"))
    return cut(sums.filter(F.col("n_refs") >= heavy_rows).orderBy(F.desc("n_refs"), "key").limit(MAX_HEAVY), "heavy-references")


def withdrawn_pieces(recs: DataFrame) -> DataFrame:
    """(key, period, piece_from, piece_to): the validity of withdrawn records, cut at the ends of months, so that a key's is spread."""
    months = F.sequence(F.trunc(F.col("valid_from").cast("date"), "month"), F.trunc(F.col("valid_to").cast("date"), "month"), F.expr("interval 1 month"))
    cut_up = recs.filter("valid_to > valid_from").withColumn("month", F.explode(months))
    pieces = cut_up.select("key", F.substring(F.col("month").cast("string"), 1, 7).alias("period"), F.greatest("valid_from", F.col("month").cast("timestamp_ntz")).alias("piece_from"), F.least("valid_to", F.add_months("month", 1).cast("timestamp_ntz")).alias("piece_to"))
    return pieces.filter("piece_from < piece_to").groupBy("key", "period", "piece_from").agg(F.max("piece_to").alias("piece_to"))


def _not_open(refs: DataFrame, opened: DataFrame) -> DataFrame:
    return refs.alias("r").join(opened.alias("f"), (F.col("r.key") == F.col("f.key")) & (F.col("r.at") >= F.col("f.open_from")), "left_anti")


def _not_covered(refs: DataFrame, pieces: DataFrame, *salt: str) -> DataFrame:
    r, p = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"p.{c}"))
    same = [r(c) == p(c) for c in ("key", "period", *salt)]
    covered = (r("at") >= p("piece_from")) & (r("at") < p("piece_to"))
    for s in same:
        covered = s & covered
    return refs.alias("r").join(pieces.alias("p"), covered, "left_anti")


def orphans_split(refs: DataFrame, recs: DataFrame, heavy: DataFrame, max_pieces: int = MAX_PIECES) -> tuple[DataFrame, DataFrame]:
    """orphans_at of the references of heavy keys, and of all others.

    Heavy keys: their earliest open starts, at most one a key, are broadcast; so are their withdrawn periods where a
    count shows at most max_pieces of them. More are joined by key, month and salt, the rows of a key spread over its salts.
    """
    first = recs.filter("valid_to is null").groupBy("key").agg(F.min("valid_from").alias("open_from"))
    pieces = withdrawn_pieces(recs)
    hot, cold = split_by(refs, heavy.select("key"), "key")
    few = F.broadcast(heavy.select("key"))  # at most MAX_HEAVY rows, and so is what it leaves of first
    hot = _not_open(hot, F.broadcast(first.join(few, "key", "left_semi")))
    heavy_pieces = cut(pieces.join(few, "key", "left_semi"), "heavy-pieces")
    if heavy_pieces.count() <= max_pieces:
        hot = _not_covered(hot, F.broadcast(heavy_pieces))
    else:
        salts = heavy.select("key", F.least(F.ceil(F.col("n_refs") / SALT_ROWS), F.lit(MAX_SALTS)).cast("int").alias("salts"))
        spread = hot.join(F.broadcast(salts), "key").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int"))
        every = heavy_pieces.join(F.broadcast(salts), "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        hot = _not_covered(spread, every, "salt").select(refs.columns)
    return hot, _not_covered(_not_open(cold, first), pieces)


def orphans_at(refs: DataFrame, recs: DataFrame, heavy_rows: int = HEAVY_ROWS, max_pieces: int = MAX_PIECES, groups: DataFrame | None = None) -> DataFrame:
    """The references with no record of their key that is valid at their time (valid_from <= at < valid_to).

    Records never withdrawn come down to the earliest start per key. Withdrawn ones are cut at the ends of months and
    joined by key and month, so that even a key with very many records and references is spread. groups: reference_groups
    of refs, where they are at hand. Null times have no valid record: they are orphans. Repeated rows come out as often as they go in.
    """
    hot, cold = orphans_split(refs, recs, heavy_references(reference_groups(refs) if groups is None else groups, heavy_rows), max_pieces)
    return hot.unionByName(cold)


def orphans_anywhere(refs: DataFrame, known: DataFrame, heavy_rows: int = HEAVY_ROWS, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The references of heavy keys, and of all others, whose key isn't in known (column key, repeated or not)."""
    heavy = heavy_references(reference_groups(refs) if groups is None else groups, heavy_rows).select("key")
    known = known.filter("key is not null").select("key").distinct()
    hot, cold = split_by(refs, heavy, "key")
    return hot.join(F.broadcast(known.join(F.broadcast(heavy), "key", "left_semi")), "key", "left_anti"), cold.join(known, "key", "left_anti")


def orphan_report(groups: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """References and orphans per table and period: groups of all references, parts of the orphans.

    Each part is counted per key and period first, so that a key of any weight is combined before it is summed up.
    """
    counted = None
    for part in parts:
        one = reference_groups(part).withColumnRenamed("n_refs", "n_orphans")
        counted = one if counted is None else counted.unionByName(one)
    k = counted.groupBy("ref_table", "period").agg(F.sum("n_orphans").alias("n_orphans"))
    n = groups.groupBy("ref_table", "period").agg(F.sum("n_refs").alias("n_refs"))
    return n.alias("n").join(k.alias("k"), F.col("n.ref_table").eqNullSafe(F.col("k.ref_table")) & F.col("n.period").eqNullSafe(F.col("k.period")), "left").select("n.ref_table", "n.period", "n_refs", F.coalesce("n_orphans", F.lit(0).cast("bigint")).alias("n_orphans"))


def _isolate_parts(snp: DataFrame, mlst: DataFrame, epi: DataFrame, heavy_rows: int, max_pieces: int) -> tuple[DataFrame, list[DataFrame]]:
    """The groups of all references, written by one pass over the tables; and the parts of the orphans."""
    # dst names an isolate too, but is no reference: groups of their own, without a period, from the same pass
    loaded = F.substring(F.col("loaded_at").cast("timestamp_ntz").cast("string"), 1, 7)
    ends = snp.select(F.explode(F.array(*[F.struct(F.lit(t).alias("ref_table"), clean_id(F.col(c)).alias("key"), p.alias("period")) for t, c, p in (("snp_matrix", "isolate_id", loaded), ("dst", "dst", F.lit(None).cast("string")))])).alias("e")).select("e.*").filter("key is not null")
    others = references(mlst, "mlst", "received_at").unionByName(references(epi, "epi", "received_at")).select("ref_table", "key", "period")
    groups = cut(reference_groups(ends.unionByName(others)), "reference-groups")
    to_epi = references(snp, "snp_matrix", "loaded_at").unionByName(references(mlst, "mlst", "received_at"))
    hot, cold = orphans_split(to_epi, records(epi), heavy_references(groups.filter(F.col("ref_table").isin("snp_matrix", "mlst")), heavy_rows), max_pieces)
    named = groups.filter(F.col("ref_table").isin("snp_matrix", "dst"))
    epi_hot, epi_cold = orphans_anywhere(references(epi, "epi", "received_at"), named, heavy_rows, groups.filter("ref_table = 'epi'"))
    return groups.filter("ref_table <> 'dst'"), [hot, cold, epi_hot, epi_cold]


def isolate_orphans(snp: DataFrame, mlst: DataFrame, epi: DataFrame, heavy_rows: int = HEAVY_ROWS, max_pieces: int = MAX_PIECES) -> DataFrame:
    """snp_matrix and mlst rows without valid metadata at their time, and epi rows that no distance names."""
    hot, cold, epi_hot, epi_cold = _isolate_parts(snp, mlst, epi, heavy_rows, max_pieces)[1]
    return hot.unionByName(cold).unionByName(epi_hot).unionByName(epi_cold)


def isolate_report(snp: DataFrame, mlst: DataFrame, epi: DataFrame, heavy_rows: int = HEAVY_ROWS, max_pieces: int = MAX_PIECES) -> DataFrame:
    """References and orphans of the three tables per table and month."""
    return orphan_report(*_isolate_parts(snp, mlst, epi, heavy_rows, max_pieces))
