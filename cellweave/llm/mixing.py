"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source takes its target in words: whole epochs of all its documents first, then a fraction of one more.
For that, a document of weight w gets the key -ln(u) / w with u in (0, 1) from a hash of its id, and documents
are taken by rising key until the budget is met; the last one in part. Sources may be large: keys are cut into
buckets of a few rows each, sums of buckets place every bucket in its source, and only then are rows ordered
within their bucket. Buckets follow the law of the keys themselves: a source's keys are a mixture of exponentials,
one for each power of two that its weights fall under, whose shares are counted first. The mean target of all
sources is set by windows over one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of the sources in the order of their names, repeating; their share of all sizes; epochs at most.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
#: Rows that a bucket of a source stands for.
BUCKET = 20_000
#: Cells of a source besides those.
CELLS = 16
SEED = "mix-1"
#: Quality weights of a document: label 1, label 0, no label.
QUALITY = (1.0, 0.25, 0.5)


def words(text: Column | str) -> Column:
    """Number of maximal runs of characters other than space and tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit(key: Column | str) -> Column:
    """A number in (0, 1) from a hash of the key as text; a null key counts as empty text."""
    col = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(col.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_rows, target) of (source, size): the share of all sizes in proportion to the weights.

    A source stops at epochs times its size; what is over goes to the others by weight, until none is above.
    That fixes a level: targets are the lesser of level * weight and the stop. With sources by stop / weight,
    the level is that of the first prefix of stopped sources after which the next doesn't stop."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double"))
    s = s.withColumn("stop", F.col("source_size") * F.lit(epochs)).withColumn("ratio", F.col("stop") / F.col("w"))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    s = s.withColumn("all", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("all_w", F.sum("w").over(every))
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("stop").over(before), F.lit(0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return s.select("source", "source_size", "n_rows", F.least(F.coalesce(F.col("level") * F.col("w"), F.col("stop").cast("double")), F.col("stop").cast("double")).alias("target"))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, u) of each document; the text goes no further."""
    return docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), words(text).alias("size"), unit(key).alias("u"))


def mix(docs: DataFrame, quality: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE) -> DataFrame:
    """(key, size, source_size, target, taken) of every document; taken is in words, repeats counted.

    quality: (doc_id, weight), weights over 0; a document without one, or of null key, has the weight of no
    label. Rows of one key share u and weight; equal rows are taken in any order, with the same result. Null
    texts have size 0 and take nothing; a null source is a source, the last. An empty table gives no rows;
    extra columns don't matter. Reruns agree: nothing is random.
    """
    rows = sized(docs, key, text, source)
    if quality is not None:
        by_key = quality.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max("weight").alias("weight"))
        rows = rows.join(by_key, "key", "left")
    else:
        rows = rows.withColumn("weight", F.lit(None).cast("double"))
    rows = rows.withColumn("weight", F.coalesce("weight", F.lit(QUALITY[2]))).withColumn("rank", -F.log("u") / F.col("weight"))
    goal = targets(sized(docs, key, text, source), share)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goal = goal.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()).drop("source")
    rows = rows.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    power = F.floor(F.log2("weight")).cast("int").alias("power")
    law = rows.groupBy("name", "none", power).agg(F.count("*").alias("n")).groupBy("name", "none").agg(F.sort_array(F.collect_list(F.struct("power", "n"))).alias("law"))
    goal = goal.join(law, ["name", "none"])
    # one row a source: their number is that of distinct names; Spark broadcasts it if it is small
    rows = rows.join(goal, ["name", "none"])
    # the share of a source's keys below one, by the counted weights: it rises with the key, so cells keep their order
    below = F.aggregate("law", F.lit(0.0), lambda acc, x: acc + x["n"] * (1 - F.exp(-F.col("rank") * F.pow(F.lit(2.0), x["power"] + 0.5))))
    rows = rows.withColumn("cell", F.floor(below / F.col("n_rows") * (F.floor(F.col("n_rows") / BUCKET) + CELLS)).cast("long"))
    cells = rows.groupBy("name", "none", "cell").agg(F.sum("size").alias("cell_size"))
    ahead = W.partitionBy("name", "none").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("name", "none", "cell", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)).alias("ahead"))
    rows = rows.join(cells, ["name", "none", "cell"])
    inner = W.partitionBy("name", "none", "cell").orderBy("rank", "key", "size").rowsBetween(W.unboundedPreceding, -1)
    so_far = F.col("ahead") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    part = F.least(F.greatest(F.col("rest") - so_far, F.lit(0)), F.col("size"))
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from quality labels; other values than 0 and 1, and null, count as no label."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, QUALITY[0]).when(F.col("quality") == 0, QUALITY[1]).otherwise(QUALITY[2]).alias("weight"))
