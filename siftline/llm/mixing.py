"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, but at most ``most``
times its size; what is cut off there is shared anew by weight. Within a source
a document is due in proportion to its own weight, which grows with its length
(a document of ``half`` words weighs half as much as a very long one), but at
most ``most`` times; the scale is set so that the words due add up to the
target. The whole part of what is due is certain. For the rest, documents are ranked by
``odds(u) / odds(p)`` with ``u`` uniform by a hash of the id and ``p`` the
fractional part, their inclusion probability, and the first ones are taken until
the source's words come nearest to its target. The cut in the ranking is found
from sums by bucket of rank, then within one bucket, so no source is ever sorted
whole, and nothing by source comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import count_words, materialize, read_table, whole_row

BUCKETS = 4096
#: Document weights are multiples of one over this.
STEPS = 64
WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
HALF = 50.0


def _weight(half: float) -> Column:
    """Weight of a document by its size, from 0 for no words up to 1, in ``STEPS`` steps."""
    return F.when(F.col("size") > 0, F.ceil(STEPS * F.col("size") / (F.col("size") + F.lit(half))) / STEPS).otherwise(0.0)


def targets(totals: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """``key, source_size, target`` by source; ``totals``: source, size. Weights are dealt in order of code points, null last.

    Sources are numbered by range of the order, and the level at which shares are
    cut off is found from sums, so a source may be as small as an address.
    """
    order = [F.col("source").isNull(), F.col("source")]
    dealt = totals.repartitionByRange(*order).sortWithinPartitions(*order).select("source", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k"))
    dealt = materialize(dealt, "sources")
    parts = dealt.groupBy(F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = parts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    turn = F.pmod(F.col("before") + F.col("k"), F.lit(len(weights))).cast("int")
    rows = materialize(dealt.join(before, F.col("part") == F.col("p")).select("source", "size", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight")), "weights")
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    level = whole["size"] / whole["weight"] if whole["weight"] else 0.0
    while True:
        over = F.lit(level) * F.col("weight") > most * F.col("size")
        cut = rows.agg(F.coalesce(F.sum(F.when(over, most * F.col("size"))), F.lit(0.0)).alias("off"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        new = (whole["size"] - cut["off"]) / cut["open"] if cut["open"] else level
        if new <= level:
            break
        level = new
    return rows.select(F.col("source").alias("key"), F.col("size").alias("source_size"), F.least(F.lit(level) * F.col("weight"), most * F.col("size")).alias("target"))


def scales(cells: DataFrame, most: float) -> DataFrame:
    """``key, source_size, target, scale``: with it the words due, each document at most ``most`` times, add up to the target.

    ``cells``: key, source_size, target, weight, size, a row for each weight of a source.
    """
    heavier = Window.partitionBy("key").orderBy(F.desc("weight"))
    ahead, here = heavier.rowsBetween(Window.unboundedPreceding, -1), heavier.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # If all heavier documents are due the most, this scale gives the rest to the others.
    left = F.col("target") - most * F.coalesce(F.sum("size").over(ahead), F.lit(0))
    rest = F.sum(F.col("size") * F.col("weight")).over(here)
    tried = cells.withColumn("scale", F.when(rest > 0, F.greatest(left, F.lit(0.0)) / rest))
    fits = F.col("scale") * F.col("weight") <= most * (1 + 1e-12)
    best = F.max(F.when(fits, F.struct("weight", "scale")))["scale"]
    return tried.groupBy("key", "source_size", "target").agg(F.coalesce(best, F.when(F.max("target") > 0, F.lit(most * STEPS)).otherwise(0.0)).alias("scale"))


def _uniform(seed: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def _ranked(rows: DataFrame, seed: int, most: float, half: float) -> DataFrame:
    """Adds ``copies`` (certain), ``rank`` in (0, 1) by Pareto order, and ``id`` for ties. Needs size, scale, doc_id."""
    due = F.least(_weight(half) * F.col("scale"), F.lit(most))
    copies = F.floor(due)
    p, u = due - copies, _uniform(seed)
    q = u / (1 - u) * (1 - p) / p
    return rows.withColumns({"copies": copies.cast("long"), "rank": F.when(p > 0, q / (1 + q)), "id": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))})


def plan(sizes: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 7, half: float = HALF) -> DataFrame:
    """A row for each source: its size, target, scale of what is due, and the last rank and id taken.

    ``sizes``: doc_id, source, size, written out already.
    """
    cells = materialize(sizes.groupBy("source", _weight(half).alias("weight")).agg(F.sum("size").alias("size")), "cells")
    goal = targets(cells.groupBy("source").agg(F.sum("size").alias("size")), weights, most)
    table = materialize(scales(cells.join(goal, F.col("source").eqNullSafe(F.col("key"))), most), "targets")
    ranked = _ranked(sizes.join(table, F.col("source").eqNullSafe(F.col("key"))), seed, most, half)
    bucket = F.coalesce(F.floor(F.col("rank") * BUCKETS), F.lit(BUCKETS))
    dealt = ranked.select("key", "target", "size", "copies", "rank", "id", bucket.alias("bucket"))
    sums = dealt.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("copies")).alias("certain"))
    sums = materialize(sums, "buckets")
    certain = sums.groupBy(F.col("key").alias("k")).agg(F.sum("certain").alias("certain"))
    by_rank = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    need = table.join(certain, F.col("key").eqNullSafe(F.col("k"))).select("key", (F.col("target") - F.col("certain")).alias("need"))
    border = sums.where(F.col("bucket") < BUCKETS).select("key", "bucket", "words", F.coalesce(F.sum("words").over(by_rank), F.lit(0)).alias("before"))
    border = border.join(need.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).where("before < need and before + words >= need").select("k", F.col("bucket").alias("last"), "before", "need")
    border = materialize(border, "border")
    inside = dealt.join(border, F.col("key").eqNullSafe(F.col("k")) & (F.col("bucket") == F.col("last"))).groupBy("k", "rank", "id", "before", "need").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("k").orderBy("rank", "id")
    inside = inside.withColumn("till", F.col("before") + F.sum("size").over(order))
    near = inside.where((F.col("till") <= F.col("need")) | (F.col("till") - F.col("need") <= F.col("need") - (F.col("till") - F.col("size"))))
    last = near.groupBy("k").agg(F.max(F.struct("rank", "id")).alias("cut"))
    # Where not even the bucket's first document comes nearer, all buckets below it are taken; where the need is beyond all buckets, all.
    full = need.where("need > 0").select(F.col("key").alias("n"))
    cuts = table.join(last, F.col("key").eqNullSafe(F.col("k")), "left").drop("k").join(border.select("k", "last"), F.col("key").eqNullSafe(F.col("k")), "left").drop("k").join(full.withColumn("some", F.lit(True)), F.col("key").eqNullSafe(F.col("n")), "left")
    nothing, everything = F.lit(-1.0), F.lit(2.0)
    rank = F.when(F.col("cut").isNotNull(), F.col("cut.rank")).when(F.col("last").isNotNull(), F.col("last") / BUCKETS).when(F.col("some"), everything).otherwise(nothing)
    return materialize(cuts.select("key", "source_size", "target", "scale", rank.alias("cut_rank"), F.coalesce("cut.id", F.lit(-(1 << 63)).cast("long")).alias("cut_id")), "cuts")


def _apply(rows: DataFrame, cuts: DataFrame, seed: int, most: float, half: float) -> DataFrame:
    found = _ranked(rows.join(cuts, F.col("source").eqNullSafe(F.col("key"))), seed, most, half)
    more = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("id") <= F.col("cut_id")))
    return found.withColumn("copies", F.col("copies") + F.coalesce(more, F.lit(False)).cast("long"))


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), count_words(F.col("text")).alias("size"))


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 7, half: float = HALF) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    ``taken`` counts repeats. A null, empty or white text has size 0 and is never
    taken; a null source is a source. Rows that share a source, an id and a size
    are taken alike; of equal ranks the lesser id goes first. A source without words
    has target 0, no rows give no rows. Texts of any length count whole, in one
    pass. Other columns are ignored. With ``half`` 0 all documents of a source
    weigh the same.
    """
    sizes = materialize(_sizes(docs), "sizes")
    found = _apply(sizes, plan(sizes, weights, most, seed, half), seed, most, half)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def repeat_mixed(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 7, half: float = HALF) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them.

    Nulls, empty and very long texts, ties and repeated rows are taken as by
    ``mix``: rows without words go. No rows give no rows.
    """
    sizes = materialize(_sizes(docs), "sizes")
    cuts = plan(sizes, weights, most, seed, half).select("key", "scale", "cut_rank", "cut_id")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), count_words(F.col("text")).alias("size"), whole_row(docs))
    found = _apply(rows, cuts, seed, most, half)
    return found.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("k")).select("row.*")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))
