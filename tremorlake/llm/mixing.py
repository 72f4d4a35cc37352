"""Mixing sources to target weights.

Words are summed per source, targets follow the weights with a ceiling on repetition, and each document is taken
floor(rate) times plus once more with probability equal to the fraction, decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAX_RATE = 3
SEED = 17


def ranked(sizes: DataFrame, order: list[Column]) -> DataFrame:
    """``sizes`` with ``rank`` from 0, written: sorted by ranges, numbered within each, and each range's begin added.

    The driver gets the number of rows of each range.
    """
    numbered = common.materialize(sizes.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, begins, total = F.shiftright("__at", 33), {}, 0
    for r in numbered.groupBy(part.alias("part")).count().orderBy("part").collect():
        begins[r["part"]] = total
        total += r["count"]
    begin = F.create_map(*[F.lit(x) for kv in begins.items() for x in kv])[part] if begins else F.lit(0)
    return numbered.withColumn("rank", (begin + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__at")


def source_targets(sizes: DataFrame, weight_of_rank: Column, max_rate: int = MAX_RATE) -> DataFrame:
    """Per-source targets from per-source sizes (columns ``source, source_size, n_docs``).

    Sources rank by code point, null last; ``weight_of_rank`` maps ``rank`` (from 0) to a weight. Shares of the whole
    size follow the weights; a target stops at ``max_rate`` times its source's size and the excess is shared again by
    weight among the others. The level of sharing rises as sources fill, each time by one sum over all of them, until no
    more fill; no task holds all sources. Empty input gives no rows.
    """
    sources = ranked(sizes, [F.col("source").isNull(), F.col("source")])
    sources = sources.withColumn("weight", weight_of_rank.cast("long")).withColumn("cap", (F.lit(max_rate) * F.col("source_size")).cast("long"))
    sources = common.materialize(sources, "sources")
    first = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left, weight_left, filled = first["size"] or 0, first["weight"] or 0, 0
    while True:
        full = (F.col("cap").cast("double") * F.lit(float(weight_left)) <= F.col("weight").cast("double") * F.lit(float(left))) if weight_left else F.lit(True)
        now = sources.where(full).agg(F.count("*").alias("n"), F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
        if now["n"] == filled:
            break
        filled, left, weight_left = now["n"], first["size"] - now["cap"], first["weight"] - now["weight"]
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(left).cast("long") / F.lit(weight_left or 1).cast("long"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return sources.withColumn("target", target).withColumn("rate", rate).select("source", "n_docs", "source_size", "weight", "target", "rate")


def mix_sources(docs: DataFrame, weight_of_rank: Column, max_rate: int = MAX_RATE, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``rate`` and ``copies`` (how often the mix takes it).

    A document's extra copy depends on ``doc_id`` and ``seed`` alone, so reruns agree and repeated rows (same id) are
    taken alike. Null or empty text has size 0. Null sources are one source. No document is taken more than
    ``max_rate`` times. Other columns stay; those named like the added ones are replaced. An empty table gives no rows.
    """
    own = ["size", "source_size", "target", "rate", "copies"]
    sized = docs.drop(*own).withColumn("size", common.count_words(F.col("text")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = common.materialize(source_targets(sizes, weight_of_rank, max_rate), "targets").select(
        "source", F.col("n_docs").alias("__n_docs"), "source_size", "target", "rate"
    )
    out = common.join_back(sized, targets, "source", "__n_docs", F.col("doc_id")).drop("__n_docs")
    whole = F.floor("rate")
    extra = (common.unit_hash(F.lit(seed), F.col("doc_id")) < F.col("rate") - whole).cast("long")
    return out.withColumn("copies", whole + extra)


def emit_mix(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row of ``columns`` for every copy taken."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


def take_mix(docs: DataFrame, weight_of_rank: Column, max_rate: int = MAX_RATE, seed: int = SEED) -> DataFrame:
    """The mix itself: a row of ``docs`` for every copy taken, its columns unchanged whatever their names.

    Rows are treated as by ``mix_sources``: null text and sources, repeated rows and an empty table too.
    """
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    taken = emit_mix(mix_sources(whole, weight_of_rank, max_rate, seed), ["__doc"])
    return taken.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])


def cycle_1_2_3(rank: str = "rank") -> Column:
    """Weights 1, 2, 3, repeating, by rank."""
    return F.col(rank) % 3 + 1
