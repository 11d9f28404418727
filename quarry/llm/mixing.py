"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words; of a document the mix takes whole copies. Longer documents are worth more of them:
a document of size class k (the bits of its number of words) has the expected copies c = min(cap, level * (BASE + k)),
with the level of its source such that the expected words are the target. floor(c) copies are certain, and the fraction
left is the inclusion probability p of one more, which so differs between the documents of a source. All documents of a
source are ranked by random odds divided by inclusion odds, q = (u / (1 - u)) / (p / (1 - p)), with u a hash of the
document, and taken in that order until the words that are left to the source are spent. So the size of the sample is
fixed (to half a document at the margin) and not only expected, and a document is taken with a chance near its p.

The cut in the ranking is found from sums over bins of q / (1 + q), and over finer bins within the bin that holds it;
rows are ordered only within that finer bin, so no task gathers a source. Targets and levels come from passes over one
row a source and size class.

Nulls: a null text has no words and is taken 0 words; null sources form one source, the last. Reruns agree; rows
alike in id and text are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import looked_up, ranked, staged, words

BINS = 4096
#: The weight of a document is this and its size class together.
BASE = 8
#: What is left of a fraction below this is rounding.
TINY = 1e-9


def targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """Add ``target`` to (source, source_size, n): shares by weight, in the order of sources, capped at ``cap`` sizes.

    The excess over a cap goes to the sources below theirs by weight, until none is above: all uncapped sources
    end with the same target a weight, which rounds of one aggregate each find.
    """
    name = F.get("source", F.lit(0))
    numbered, _ = ranked(sizes, [name.isNull(), F.encode(F.coalesce(name, F.lit("")), "utf-8")], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("global_row") % len(weights) + 1).cast("int"))
    s = staged(numbered.select("source", "source_size", "n", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")), "mix-weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        over = F.col("most") <= F.col("weight") * F.lit(level)
        spent, open_weight = s.agg(F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        if not open_weight:
            break
        new = (share * total - (spent or 0.0)) / open_weight
        if new <= level * (1 + 1e-12):
            break
        level = new
    return s.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(float(level))))


def levels(classes: DataFrame, cap: float) -> DataFrame:
    """For (source, k, words, target): the expected copies of each class, at a level that makes the expected words the target.

    Classes of the greatest weight reach ``cap`` first. With the classes above k at their cap, the others share what is
    left by weight; the level is that of the greatest k which doesn't exceed its cap then.
    """
    weight = F.col("k") + F.lit(BASE)
    down = W.partitionBy("source").orderBy(F.desc("k"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * weight).over(down.rowsBetween(0, W.unboundedFollowing))
    level = F.when(rest > 0, (F.col("target") - F.lit(float(cap)) * above) / rest)
    fits = (level * weight <= F.lit(float(cap)) * (1 + 1e-12)) & (level >= 0)
    out = classes.withColumn("level", F.when(fits, level))
    out = out.withColumn("level", F.max_by("level", F.when(F.col("level").isNotNull(), F.col("k"))).over(W.partitionBy("source")))
    return out.withColumn("copies", F.least(F.lit(float(cap)), F.coalesce("level", F.lit(0.0)) * weight))


def _cut(rows: DataFrame, bin_: str, taken: Column) -> DataFrame:
    """source, the bin in which its words up to there first reach ``rest``, and the words before that bin."""
    sums = rows.groupBy("source", bin_).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first(taken).alias("taken"))
    upto = F.col("taken") + F.sum("words").over(W.partitionBy("source").orderBy(bin_))
    cuts = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words")).where((F.col("before") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
    return cuts.groupBy("source").agg(F.min(bin_).alias(f"cut_{bin_}"), F.min_by("before", bin_).alias(f"before_{bin_}"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (words), copies, inclusion (p) and q of every row of ``docs``, with its text's hash."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    # A source is told apart as an array, so that null is a value like others.
    rows = docs.select(
        doc_id.alias("doc_id"), F.array(F.col(source_col)).alias("source"), F.size(words(text)).cast("long").alias("size"), F.xxhash64(F.col(id_col), text).alias("text_hash"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"), F.md5(text.cast("binary"))).cast("binary")).alias("draw"),
    )
    rows = staged(rows.withColumn("k", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)), "mix-rows")
    classes = staged(rows.groupBy("source", "k").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-classes")
    by_source = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n")), list(weights), share, cap)
    n_sources, n_rows = by_source.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    planned = levels(classes.join(by_source.select("source", "source_size", "target"), "source"), cap)
    planned = planned.withColumn("whole", F.floor(F.col("copies") + TINY)).withColumn("p", F.greatest(F.lit(0.0), F.col("copies") - F.col("whole")))
    planned = planned.withColumn("p", F.when(F.col("p") < 2 * TINY, 0.0).otherwise(F.col("p")))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("whole") * F.col("words")).over(W.partitionBy("source")))
    planned = staged(planned.withColumn("rest", rest).select("source", "k", "n", "source_size", "target", "whole", "p", "rest"), "mix-plan")

    # u lies strictly between 0 and 1, and so does v = q / (1 + q), which is in the order of q.
    u = (F.conv(F.substring("draw", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    drawn = looked_up(rows, planned, ["source", "k"], "n", planned.count(), n_rows).drop("n", "k").withColumn("u", u)
    drawn = drawn.withColumn("v", F.when(F.col("p") > 0, F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + (1 - F.col("u")) * F.col("p"))))
    drawn = staged(drawn.withColumn("bin", F.floor(F.col("v") * BINS)).withColumn("fine", F.floor(F.col("v") * (BINS * BINS))).drop("u"), "mix-odds")
    sizes = by_source.select("source", "n")
    cuts = staged(_cut(drawn.where("v is not null"), "bin", F.lit(0)).join(sizes, "source"), "mix-cuts")
    near = looked_up(drawn.where("v is not null"), cuts, "source", "n", n_sources, n_rows).where("bin = cut_bin")
    finer = _cut(near, "fine", F.col("before_bin"))
    cuts = staged(cuts.join(finer, "source").unionByName(sizes.join(cuts, "source", "left_anti"), allowMissingColumns=True), "mix-cuts")

    at = looked_up(drawn, cuts, "source", "n", n_sources, n_rows)
    inside = at.where((F.col("bin") == F.col("cut_bin")) & (F.col("fine") == F.col("cut_fine")))
    in_order = W.partitionBy("source").orderBy("v", "draw", "doc_id")
    # A document whose middle lies before the cut is in: the margin is half a document.
    middle = F.col("before_fine") + F.sum("size").over(in_order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2
    inside = inside.withColumn("more", (middle <= F.col("rest")).cast("int"))
    outside = at.where(F.col("cut_fine").isNull() | F.col("v").isNull() | (F.col("fine") != F.col("cut_fine")))
    # A source without a cut has no words left to spend, or no more than its documents hold.
    below = F.coalesce(F.when(F.col("cut_fine").isNull(), F.col("rest") > TINY * F.col("target")).otherwise(F.col("fine") < F.col("cut_fine")) & F.col("v").isNotNull(), F.lit(False))
    out = inside.unionByName(outside.withColumn("more", below.cast("int"))).withColumn("copies", (F.col("whole") + F.col("more")).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", F.col("p").alias("inclusion"), (F.col("v") / (1 - F.col("v"))).alias("q"), "text_hash")
