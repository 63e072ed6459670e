"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source gets a target of words. Each of its documents is taken ``floor(target / source size)`` times for
certain; of the words that are left, each document has a chance of one more copy in proportion to its size, so
that the expected words are those left. Chances that would pass 1 are copies that are certain, too: with sizes
from the largest on, that is the first size at which the factor of the rest keeps chances within 1. For the other
copies, documents are ranked by ``(u / (1 - u)) / (p / (1 - p))`` (random odds over inclusion odds), and the
first ones are taken until the source's words come closest to its target.

``u`` comes from a digest of the id, so reruns agree. Defined results: null texts have size 0, the
null source is a source of its own and comes last, null ids share one ``u``; rows with equal id,
source and size share their fate. Columns beyond the named ones are kept and never read, whatever
their names are. Nothing is gathered by source: the cut of a source comes from a histogram of ranks
(``BINS`` rows a source at most), and only the documents of the bin that holds the cut are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialize

#: Rank bins a source: the documents of one of them are sorted, all others are decided by their bin.
BINS = 4096
_COLUMNS = ("_id", "_source", "_size", "_u")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(doc_id: Column, seed: int) -> Column:
    """A value strictly between 0 and 1 that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _measured(docs: DataFrame, seed: int) -> list[Column]:
    return [docs["doc_id"].alias("_id"), docs["source"].alias("_source"), word_count(docs["text"]).alias("_size"), unit(docs["doc_id"], seed).alias("_u")]


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets of the sources: ``share`` of all words by weight, none above ``most`` times its size.

    ``sizes`` has a row a source (_source, source_size). The excess of full sources goes to the others
    by weight until none is above: with the sources in order of cap over weight, that is the first
    level at which the next source is not full. The windows here run over one row a source.
    """
    everyone = Window.partitionBy()
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy("_fill", "_rank")
    return (
        ranked.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_fill", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(everyone) * F.lit(float(share)))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_open"))
        .withColumn("_theta", F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "_rank", "_level"))).over(everyone)["_level"])
        .withColumn("target", F.least("_cap", F.coalesce(F.col("_weight") * F.col("_theta"), F.col("_cap"))))
        .select("_source", "source_size", "target")
    )


def _certain() -> Column:
    """Whether a row that has _size and its source's _factor gets its further copy for certain."""
    return F.col("_size") * F.col("_factor") >= 1


def _odds() -> Column:
    """Random odds over inclusion odds of a row that has _size, _u and its source's _factor; null without a chance."""
    chance = F.col("_size") * F.col("_factor")
    return F.when((chance > 0) & (chance < 1), (F.col("_u") / (1 - F.col("_u"))) * ((1 - chance) / chance))


def _bin(odds: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(F.lit(float(BINS)) * (odds / (1 + odds))))


def _factors(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(_s, _factor, _sure): chance by word of each source's documents, and the words of its certain further copies."""
    sizes = sized.where("_size > 0").groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_rows"))
    words = F.col("_size").cast("decimal(38,0)") * F.col("_rows")
    down = Window.partitionBy("_source").orderBy(F.col("_size").desc())
    sizes = sizes.withColumn("_larger", F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double"))
    sizes = sizes.withColumn("_squares", F.sum(words * F.col("_size")).over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double"))
    sizes = sizes.join(sources.select(F.col("_source").alias("_s"), "_rest"), F.col("_source").eqNullSafe(F.col("_s")))
    sizes = sizes.withColumn("_factor", (F.col("_rest") - F.col("_larger")) / F.col("_squares")).where(F.col("_factor") * F.col("_size") <= 1)
    return sizes.groupBy("_s").agg(F.max(F.struct("_size", "_factor", "_larger")).alias("_first")).select("_s", "_first._factor", F.col("_first._larger").alias("_sure"))


def mixing_plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(measured documents, one row a source with target, certain copies, chances and cut)."""
    sized = materialize(docs.select(*_measured(docs, seed)), "mixing-sizes")
    sizes = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    sources = source_targets(sizes, weights, share, most)
    sources = sources.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = materialize(sources.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")), "mixing-sources")
    factors = _factors(sized, sources)
    sources = sources.join(factors, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    sources = materialize(sources.withColumns({"_factor": F.coalesce("_factor", F.lit(0.0)), "_rest": F.col("_rest") - F.coalesce("_sure", F.lit(0.0))}), "mixing-chances")

    one = sized.join(sources, sized["_source"].eqNullSafe(sources["_source"])).drop(sources["_source"])
    one = one.withColumn("_odds", _odds()).where(F.col("_odds").isNotNull())
    one = one.withColumn("_bin", _bin(F.col("_odds")))
    bins = one.groupBy("_source", "_bin").agg(F.sum("_size").alias("_words"), F.max("_rest").alias("_rest"))
    upto = Window.partitionBy("_source").orderBy("_bin")
    bins = bins.withColumn("_before", F.sum("_words").over(upto) - F.col("_words"))
    # the bin in which the words so far reach the target; if none does, the last
    cut = bins.where(F.col("_before") < F.col("_rest")).groupBy("_source").agg(F.max(F.struct("_bin", "_before")).alias("_cut")).select(F.col("_source").alias("_s"), "_cut.*")
    cut = cut.select("_s", F.col("_bin").alias("_cut_bin"), "_before")
    edge = one.join(cut, one["_source"].eqNullSafe(cut["_s"]) & (one["_bin"] == cut["_cut_bin"]))
    edge = edge.groupBy("_source", "_odds", "_id", "_size").agg(F.count(F.lit(1)).alias("_rows"), F.max("_rest").alias("_rest"), F.max("_before").alias("_before"))
    upto = Window.partitionBy("_source").orderBy("_odds", F.col("_id").asc_nulls_first(), "_size")
    edge = edge.withColumn("_own", F.col("_size") * F.col("_rows")).withColumn("_after", F.sum("_own").over(upto) + F.col("_before"))
    last = edge.where(F.col("_after") + F.col("_after") - F.col("_own") <= 2 * F.col("_rest"))
    last = last.groupBy("_source").agg(F.max(F.struct("_odds", F.coalesce("_id", F.lit(-(1 << 63))).alias("_id"), "_size")).alias("_last"))
    plan = sources.join(cut.select("_s", "_cut_bin"), sources["_source"].eqNullSafe(F.col("_s")), "left").drop("_s")
    last = last.withColumnRenamed("_source", "_s")
    plan = plan.join(last, plan["_source"].eqNullSafe(last["_s"]), "left").drop("_s")
    return sized, materialize(plan, "mixing-plan")


def _copies() -> Column:
    """Copies of a row that has _id, _size, _u and its source's plan."""
    odds = _odds()
    own = F.struct(odds.alias("_odds"), F.coalesce("_id", F.lit(-(1 << 63))).alias("_id"), F.col("_size").alias("_size"))
    taken = odds.isNotNull() & ((_bin(odds) < F.col("_cut_bin")) | ((_bin(odds) == F.col("_cut_bin")) & F.coalesce(own <= F.col("_last"), F.lit(False))))
    return F.col("_whole") + F.coalesce(_certain() | taken, F.lit(False)).cast("long")


def mixing_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    sized, plan = mixing_plan(docs, **how)
    rows = sized.join(plan.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * _copies()).alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    seed = how.get("seed", 7)
    _, plan = mixing_plan(docs, **how)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *_measured(docs, seed))
    rows = rows.join(plan.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
    return rows.withColumn("_n", _copies()).where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_row.*")
