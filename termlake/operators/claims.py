"""Claims with their sources, contradictions between them, held mentions and the queue of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.functions.units import TOLERANCE
from termlake.operators.impact import sentence


def claim_id(source_file: Column, doc_version: Column, line_range: Column, predicate: Column, value: Column, unit: Column) -> Column:
    """sha1 over six fields joined by spaces, a null unit counting as empty: the same claim read again keeps its id."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha1(F.concat_ws(" ", *map(empty, (source_file, doc_version, line_range, predicate, value, unit))))


def retract(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """claims without those of documents (source_file), which are about to be read again."""
    return claims.join(documents.select("source_file").distinct(), "source_file", "left_anti")


def contradictions(sides: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """keys, sides, min_value, max_value of groups of sides (keys, value, dimension, approximate) that disagree. No winner is named.

    Approximate and unparsed values stay out; a group needs two sides of one dimension, none counting as one. If any
    pair differs by more than the tolerance, the smallest and the largest do, so no pairs are formed.
    """
    measured = sides.where("value is not null and not approximate")
    grouped = measured.groupBy(*keys).agg(F.count("*").alias("sides"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.countDistinct(F.coalesce("dimension", F.lit(""))).alias("dimensions"), F.max("dimension").alias("dimension"))
    low, high = F.col("min_value"), F.col("max_value")
    apart = (high - low) / F.greatest(F.abs(low), F.abs(high)) > tolerance
    return grouped.where((F.col("sides") >= 2) & (F.col("dimensions") == 1) & F.when(F.col("dimension").isNull(), low != high).otherwise((low != high) & apart)).select(*keys, "sides", "min_value", "max_value")


def unique_labels(index: DataFrame) -> DataFrame:
    """(label_key, to) of labels that exactly one concept has."""
    return index.where(F.size("concepts") == 1).select("label_key", F.col("concepts")[0].alias("to"))


def restate(claims: DataFrame, index: DataFrame) -> DataFrame:
    """claims (surface, ...) with concept_id, status and, where they have such columns, gap_key, resolved_by and resolution_score, by the
    index as it is now, in both directions; doing it twice changes nothing. Labels match as they are: the fold of plurals merges
    entries of the queue and resolves nothing."""
    found = claims.withColumn("label_key", T.normalise(F.col("surface"))).join(unique_labels(index), "label_key", "left")
    held = F.col("to").isNull()
    made = {"concept_id": F.col("to"), "status": F.when(held, "held").otherwise("active")}
    own = {"gap_key": F.when(held, T.merge_key(F.col("surface"))), "resolved_by": F.when(held, "abstain").otherwise("exact"), "resolution_score": F.when(held, 0.0).otherwise(1.0)}
    return found.withColumns(made | {name: value for name, value in own.items() if name in claims.columns}).drop("to", "label_key")


def restate_totals(claims: DataFrame) -> DataFrame:
    """(claims, active, held)"""
    return claims.agg(F.count("*").alias("claims"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "held").alias("held"))


def impact(held: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """(surface, mention_count, document_count, sentence): what each draft label (surface) would resolve of held (gap_key, source_file);
    without drafts, what a label for each key would."""
    if drafts is not None:
        held = held.join(drafts.select(T.merge_key(F.col("surface")).alias("gap_key")).distinct(), "gap_key")
    by_file = held.groupBy("gap_key", "source_file").agg(F.count("*").alias("n"))
    found = by_file.groupBy("gap_key").agg(F.sum("n").alias("mention_count"), F.count("source_file").alias("document_count"))
    return found.select(F.col("gap_key").alias("surface"), "mention_count", "document_count", sentence(F.col("mention_count"), F.col("document_count")).alias("sentence"))


def held_surfaces(claims: DataFrame) -> DataFrame:
    """The distinct merge keys (gap_key) that claims (gap_key, status) are held under."""
    return claims.where("status = 'held'").select("gap_key").distinct()


def reresolve_backlog(claims: DataFrame, index: DataFrame, fold: bool = False) -> DataFrame:
    """claims (gap_key, concept_id, status, ...) where held ones whose merge key is a label of exactly one concept become active. With
    `fold` labels are folded as well, so that a label in the plural promotes what a preview, which folds it, promises.

    `promoted` says which did, so the documents to index again are those of promoted claims. Active claims stay as they are.
    """
    single = unique_labels(index).withColumnRenamed("label_key", "gap_key")
    if fold:
        single = single.groupBy(T.merge_key(F.col("gap_key")).alias("gap_key")).agg(F.min("to").alias("to"), F.max("to").alias("also"))
        single = single.where(F.col("to") == F.col("also")).drop("also")
    promoted = (F.col("status") == "held") & F.col("to").isNotNull()
    found = claims.join(single, "gap_key", "left").withColumn("promoted", F.coalesce(promoted, F.lit(False)))
    return found.withColumn("concept_id", F.when(F.col("promoted"), F.col("to")).otherwise(F.col("concept_id"))).withColumn("status", F.when(F.col("promoted"), "active").otherwise(F.col("status"))).drop("to")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """stored with the rows of new in place of those with equal keys; of new rows with equal keys the last by `order`. Null keys equal each other."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in new.columns if c not in keys)), F.struct(*order)).alias("row")).select(*keys, "row.*")
    marks = last.select(*(F.col(k).alias(f"new_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys]
    return stored.join(marks, same, "left_anti").unionByName(last)
