"""Mixing sources to target weights: Efraimidis-Spirakis sampling up to word budgets. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlake.llm.common import fresh, rows_of, stage_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"


def words(text: Column) -> Column:
    """Number of runs without white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Weight of a document: 1, or 0.5 where the mean word is shorter than 3 or longer than 12 characters or there is none."""
    mean = (F.length(text) - size) / F.greatest(size, F.lit(1))
    return F.when(mean.between(3, 12) & (size > 0), F.lit(1.0)).otherwise(F.lit(0.5))


def exponential_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, where u in (0, 1) comes from the first 52 bits of md5(seed, doc_id): the smallest keys are a weighted sample."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**52)) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Sources by code point, null last, weigh weights[0], weights[1], ..., repeating. Each gets its part of share times
    all words, `most` times its own at most; what is above goes to the others by weight. That is one level for all
    that are not full, found by taking sources in order of most * source_size / weight: the first that its level
    does not fill, and all after it, share what is left. Levels only fall from there on, so the largest of those is
    the first one's. One row a source passes through one task.
    """
    cycle = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    opened = ranked.withColumn("level", level).withColumn("open", F.when(F.col("ratio") > F.col("level"), F.col("level")))
    final = F.max("open").over(whole)
    return opened.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def prefix_sums(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, key) with `ahead`: the words of the rows of the same source with smaller keys.

    Rows are dealt by ranges of (source, key), so a large source lies in many tasks; sums within a task and the sums
    of the tasks before make the whole. The dealt rows are stored first, since the ranges come from a sample.
    """
    dealt = stage_table(rows.repartitionByRange("source", "key", "doc_id").withColumn("task", F.spark_partition_id()), "mix-dealt")
    inside = Window.partitionBy("source", "task").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = dealt.groupBy("source", "task").agg(F.sum("size").alias("sum")).withColumn("offset", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    tasks = tasks.select(F.col("source").alias("s"), F.col("task").alias("t"), "offset")
    here = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return here.join(tasks, F.col("source").eqNullSafe(F.col("s")) & (F.col("task") == F.col("t"))).withColumn("ahead", F.col("inside") + F.col("offset")).drop("s", "t", "task", "inside", "offset")


def mixed_documents(docs: DataFrame, **rule: object) -> DataFrame:
    """The rows of docs as often as the mix takes them. Rows equal in doc_id and text are taken alike."""
    own_id, own_text, own_source, copies, copy = fresh(docs.columns, "mix_id", "mix_text", "mix_source", "mix_copies", "mix_copy")
    taken = mix(docs, **rule).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_text), F.col("source").alias(own_source), F.col("copies").alias(copies))
    taken = taken.groupBy(own_id, own_text, own_source).agg(F.max(copies).alias(copies)).where(F.col(copies) > 0)
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col("source").eqNullSafe(F.col(own_source)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(own_text))
    return docs.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, text_hash: one row for each row of docs, `copies` times of which go into the mix.

    Each source gives as many whole epochs as its target has; documents with the smallest keys follow while more than
    half of the document lies below what is left of the target, so a source misses it by half a document at most.
    Null and empty texts have size 0, no words to give, and as many copies as there are whole epochs. Ties of keys
    go by doc_id, size and a hash of the text, so only equal rows count in any order. Texts of any length count whole. Runs agree.
    Columns but doc_id, source and text stay behind. An empty table gives an empty result.
    """
    text = F.col("text")
    sized = rows_of(docs, doc_id=F.col("doc_id"), source=F.col("source"), text=text, size=words(text))
    rows = stage_table(sized.select("doc_id", "source", "size", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), exponential_key(F.col("doc_id"), quality(text, F.col("size")), seed).alias("key")), "mix-rows")
    goals = stage_table(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets").withColumnRenamed("source", "s")
    # the offset of a task and the target of a source join on few distinct keys: AQE splits what a large source skews
    placed = prefix_sums(rows).join(goals, F.col("source").eqNullSafe(F.col("s")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    more = (F.col("epochs") < most) & (F.col("size") > 0) & (F.col("ahead") + F.col("size") / 2 < left)
    placed = placed.withColumn("epochs", epochs).withColumn("copies", F.col("epochs") + more.cast("long"))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "text_hash")
