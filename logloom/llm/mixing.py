"""Mixing sources to target weights by exponential-key sampling.

Targets: the budget is shared by weight; no source gets more than ``REPEATS``
times its size, and what is over goes to the others by weight. That is a water
level: order the sources by cap per weight and fill.

Sampling: each document has the key -ln(u) / w, with u from a digest of the
document and w its quality weight; taking the least keys is a weighted sample
without replacement. A source first takes whole epochs, then documents by key
until their running sum comes nearest to the rest of its target.

No source is sorted as a whole. Keys fall into buckets of some
``BUCKET_DOCS`` documents, sums per bucket (partial sums before the shuffle)
tell in which bucket the rest of the target ends, and only that one bucket of
each source is sorted. What comes out is one cut key per source.

Only DataFrame functions are used. Rules: null text has size 0; null sources
are one source, the last; documents of size 0 take nothing; equal keys (rows
repeated exactly) are taken together; an empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.frames import stored
from logloom.sources.workspace import broadcast_if_small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BUCKET_DOCS = 2000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for texts of at least 50 words of 4 to 10 letters on average, spaces
    included, else 0.5."""
    usual = (size >= 50) & (F.length(text) >= 4 * size) & (F.length(text) <= 10 * size)
    return F.when(usual, 1.0).otherwise(0.5)


def sample_key(doc_id: Column, text: Column, weight: Column, seed: int = 0) -> Column:
    """-ln(u) / weight, u in (0, 1] from 52 bits of a digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def keyed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, key`` of every document: the only pass over texts."""
    text = docs["text"].cast("string")
    sized = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), text.alias("text"), n_words(text).alias("size"))
    weight = quality_weight(F.col("text"), F.col("size"))
    return sized.select("doc_id", "source", "size", sample_key(F.col("doc_id"), F.col("text"), weight, seed).alias("key"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source, n_docs, source_size, target``: one row per source.

    The windows run over one summed row per source.
    """
    sizes = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    choice = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", choice).withColumn("cap", F.lit(repeats) * F.col("source_size"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = filling.rowsBetween(Window.unboundedPreceding, 0)
    budget = F.lit(share) * F.sum("source_size").over(everything)
    level = (budget - (F.sum("cap").over(so_far) - F.col("cap"))) / (F.sum("weight").over(everything) - F.sum("weight").over(so_far) + F.col("weight"))
    full = weighed.withColumn("budget", budget).withColumn("capped", level * F.col("weight") >= F.col("cap"))
    spent = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    left = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("budget") - spent) / left)
    return full.select("source", "n_docs", "source_size", target.alias("target"))


def mix_plan(rows: DataFrame, **options) -> DataFrame:
    """``source, source_size, target, epochs, cut_key``: a document is taken
    ``epochs`` times, and once more if its key is at most ``cut_key``."""
    goal = stored(targets(rows, **options), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = goal.withColumn("n_buckets", F.ceil(F.col("n_docs") / BUCKET_DOCS)).withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("n_buckets")), F.col("n_buckets") - 1)
    dealt = rows.join(goal, same).select("of", "doc_id", "size", "key", "rest", bucket.alias("bucket"))
    sums = dealt.groupBy("of", "bucket", "rest").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("before", upto - F.col("size")).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest")))
    ends = ends.select(F.col("of").alias("end_of"), F.col("bucket").alias("end_bucket"), "before")
    last = dealt.join(ends, F.col("of").eqNullSafe(F.col("end_of")) & (F.col("bucket") == F.col("end_bucket")))
    here = Window.partitionBy("of").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("end", F.col("before") + F.sum("size").over(here))
    nearest = (F.col("end") <= F.col("rest")) | ((F.col("end") - F.col("size") <= F.col("rest")) & (F.col("end") - F.col("rest") < F.col("rest") - (F.col("end") - F.col("size"))))
    # with no document of the last bucket taken, the cut is the bucket's lower bound
    least = -F.log(1 - F.min("bucket") / F.first("n_buckets"))
    cut = last.join(goal.select(F.col("of").alias("goal_of"), "n_buckets"), F.col("of").eqNullSafe(F.col("goal_of"))).groupBy("of").agg(F.coalesce(F.max(F.when(nearest, F.col("key"))), least).alias("cut_key"))
    cut = cut.withColumnRenamed("of", "cut_of")
    plan = goal.join(cut, F.col("of").eqNullSafe(F.col("cut_of")), "left")
    return plan.select(F.col("of").alias("source"), "source_size", "target", "epochs", "cut_key")


def times_taken() -> Column:
    return F.col("epochs") + F.when(F.col("key") <= F.col("cut_key"), 1).otherwise(0)


def mixed(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    rows = stored(keyed(docs, seed), "keys")
    plan = stored(mix_plan(rows, **options), "mix").withColumnRenamed("source", "of")
    joined = rows.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "size", "source_size", "target", (times_taken() * F.col("size")).cast("long").alias("taken"))


def mixture(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    plan = stored(mix_plan(stored(keyed(docs, seed), "keys"), **options), "mix")
    plan = plan.select(F.col("source").alias("mix_source"), "epochs", "cut_key")
    size = n_words(F.col("text").cast("string"))
    key = sample_key(docs["doc_id"].cast("long"), docs["text"].cast("string"), quality_weight(docs["text"].cast("string"), size), seed)
    inner = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["source"].cast("string").alias("source"), key.alias("key"))
    joined = inner.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("mix_source")))
    copies = joined.select("row", F.explode(F.sequence(F.lit(1), F.when(times_taken() > 0, times_taken()).cast("int"))).alias("copy"))
    return copies.select("row.*")
