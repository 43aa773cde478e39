"""What an edit would do, before it is saved: mentions resolved, names taken, children moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.functions import text as T


def surfaces(labels: Column) -> Column:
    """The sorted distinct merge keys of an array of labels; empty ones are left out."""
    keys = F.transform(F.filter(labels, lambda x: x.isNotNull()), T.merge_key)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != "")))


def surfaces_of(spark: SparkSession, labels: list[str]) -> list[str]:
    row = spark.createDataFrame([(labels,)], "labels array<string>").select(surfaces(F.col("labels")).alias("keys")).first()
    return list(row["keys"])


def mentions(held: DataFrame, drafts: DataFrame) -> DataFrame:
    """(draft_id, claim_id, ...) of held claims (claim_id, gap_key, source_file, line_range, ...) that a label of drafts (draft_id,
    labels) would resolve, each once a draft, by file and line range."""
    keys = drafts.select("draft_id", F.explode(surfaces(F.col("labels"))).alias("gap_key"))
    return keys.join(held, "gap_key").dropDuplicates(["draft_id", "claim_id"]).orderBy("draft_id", "source_file", "line_range", "claim_id")


def collisions(drafts: DataFrame, labels: DataFrame, names: DataFrame) -> DataFrame:
    """(draft_id, concept_id, message) where another concept of the draft's scheme has one of its labels, as the resolver reads them.

    drafts: draft_id, concept_id, scheme_id, labels; a null scheme is the one that the concept is in, and a new concept without
    one is compared with all. labels: concept_id, scheme_id, label; names: concept_id, pref_label.
    """
    own = labels.groupBy("concept_id").agg(F.min("scheme_id").alias("own_scheme"))
    asked = drafts.join(own, "concept_id", "left").withColumn("scheme", F.coalesce("scheme_id", "own_scheme"))
    keys = F.array_distinct(F.filter(F.transform(F.filter("labels", lambda x: x.isNotNull()), T.normalise), lambda k: k != ""))
    asked = asked.select("draft_id", F.col("concept_id").alias("draft_concept"), "scheme", F.explode(keys).alias("label_key"))
    known = labels.select("concept_id", "scheme_id", "label", T.normalise(F.col("label")).alias("label_key"))
    taken = asked.join(known, "label_key").where((F.col("concept_id") != F.col("draft_concept")) & (F.col("scheme").isNull() | (F.col("scheme") == F.col("scheme_id"))))
    said = F.concat(F.lit("“"), "label", F.lit("” is already a term for "), F.coalesce("pref_label", F.col("concept_id").cast("string")), F.lit("."))
    return taken.join(names, "concept_id", "left").select("draft_id", "concept_id", said.alias("message")).distinct()


def reparented(drafts: DataFrame, broader: DataFrame) -> DataFrame:
    """(draft_id, gained, lost) of drafts (draft_id, concept_id, parent) of existing concepts whose parent would change; lost is null
    where there was none."""
    now = broader.groupBy(F.col("child").alias("concept_id")).agg(F.min("parent").alias("was"))
    moved = drafts.where("parent is not null").join(now, "concept_id", "left").where(~F.col("parent").eqNullSafe(F.col("was")))
    return moved.select("draft_id", F.col("parent").alias("gained"), F.col("was").alias("lost"))


def sentence(mention_count: Column, document_count: Column) -> Column:
    """What the review card says; nothing where nothing would be resolved."""
    said = F.concat(F.lit(SENTENCE[0]), T.plural(mention_count, "mention"), F.lit(SENTENCE[1]), T.plural(document_count, "document"), F.lit(SENTENCE[2]))
    return F.when(mention_count > 0, said).otherwise("")


# The parts of the sentence.
SENTENCE = ("Adding this alternative term will resolve ", " across ", ".")


def preview(drafts: DataFrame, held: DataFrame, labels: DataFrame, names: DataFrame, broader: DataFrame) -> DataFrame:
    """(draft_id, surfaces, mention_count, document_count, sentence, gained, lost, n_findings) for each of drafts (draft_id, concept_id,
    scheme_id, parent, labels). The mentions and findings themselves are mentions() and collisions()."""
    counted = mentions(held, drafts).groupBy("draft_id").agg(F.count("*").alias("mention_count"), F.countDistinct("source_file").alias("document_count"))
    known = labels.select("concept_id").distinct().withColumn("known", F.lit(True))
    moved = reparented(drafts.join(known, "concept_id", "left_semi"), broader)
    found = collisions(drafts, labels, names).groupBy("draft_id").agg(F.count("*").alias("n_findings"))
    out = drafts.select("draft_id", surfaces(F.col("labels")).alias("surfaces"))
    for part in (counted, moved, found):
        out = out.join(part, "draft_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    counts = zero("mention_count"), zero("document_count")
    return out.select("draft_id", "surfaces", counts[0].alias("mention_count"), counts[1].alias("document_count"), sentence(*counts).alias("sentence"), "gained", "lost", zero("n_findings").alias("n_findings"))
