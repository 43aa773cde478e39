"""Reading the published vocabulary: schemes and their top terms, a concept's card, machine signals, where a concept may go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.operators import graph as G
from termlake.operators.publishing import DCT, LABELS, REVISED, VERSION, Views, skos
from termlake.operators.resolution import MACHINE, english_names

#: Properties of a card; all others of a concept are left out of it.
CARD = tuple(skos(x) for x in (*LABELS, "definition", "notation", "scopeNote", "changeNote", "inScheme", "broader", "related", "topConceptOf")) + tuple(
    f"<{DCT}{x}>" for x in ("modified", "contributor", "isReplacedBy")
) + (VERSION, REVISED, "<http://www.w3.org/2002/07/owl#deprecated>")
MATCHES = ("exactMatch", "closeMatch", "broadMatch")


def labels_in_order(labels: DataFrame) -> DataFrame:
    """(concept_id, kind, language, label) in the order that an index is built in."""
    return labels.select("concept_id", "kind", "language", "label").orderBy("concept_id", "kind", "language", "label")


def describe(quads: DataFrame, subject: str) -> DataFrame:
    """All published quads of one subject."""
    return quads.where((F.col("subject") == f"<{subject}>") & (F.col("graph") == "published"))


def child_counts(broader: DataFrame) -> DataFrame:
    """(concept_id, child_count): distinct children of every parent."""
    return broader.groupBy(F.col("parent").alias("concept_id")).agg(F.countDistinct("child").alias("child_count"))


def references(concepts: DataFrame, names: DataFrame, broader: DataFrame) -> DataFrame:
    """concepts (concept_id, ...) with pref_label, which is the id where there is none in English, and child_count."""
    named = concepts.join(names, "concept_id", "left").withColumn("pref_label", F.coalesce("pref_label", F.col("concept_id").cast("string")))
    return named.join(child_counts(broader), "concept_id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0).cast("long")))


def children(broader: DataFrame, concepts: DataFrame, names: DataFrame) -> DataFrame:
    """(parent, concept_id, pref_label, definition, child_count) of every child, by parent and label."""
    own = concepts.select("concept_id", "definition").distinct()
    return references(broader.select("parent", F.col("child").alias("concept_id")).distinct().join(own, "concept_id"), names, broader).orderBy("parent", "pref_label", "concept_id")


def scheme_tree(v: Views, include_machine: bool = False, machine: tuple[str, ...] = MACHINE) -> tuple[DataFrame, DataFrame]:
    """Schemes (scheme_id, title, description, concept_count) by id, and their top terms (scheme_id, concept_id, pref_label,
    definition, child_count) by label. A title is English, or any, or else the id. Machine schemes are hidden unless asked for."""
    counts = v.concepts.where("scheme_id is not null").groupBy("scheme_id").agg(F.countDistinct("concept_id").alias("concept_count"))
    of = lambda name: v.facts.where(F.col("predicate") == f"<{DCT}{name}>")
    titles = of("title").groupBy(F.col("concept_id").alias("scheme_id")).agg(F.min(F.struct(F.coalesce(F.col("language") != "en", F.lit(False)).alias("other"), "value")).alias("t"))
    told = of("description").groupBy(F.col("concept_id").alias("scheme_id")).agg(F.max("value").alias("description"))
    schemes = counts.join(titles, "scheme_id", "left").join(told, "scheme_id", "left")
    schemes = schemes.select("scheme_id", F.coalesce("t.value", T.slug(F.col("scheme_id"))).alias("title"), "description", "concept_count")
    if not include_machine:
        schemes = schemes.where(~T.slug(F.col("scheme_id")).isin(list(machine)))
    tops = v.facts.where(F.col("predicate") == skos("topConceptOf")).select("concept_id", F.col("value").alias("scheme_id")).distinct().join(schemes.select("scheme_id"), "scheme_id")
    own = v.concepts.select("concept_id", "definition").distinct()
    top = references(tops.join(own, "concept_id"), english_names(v.labels), v.broader)
    return schemes.orderBy("scheme_id"), top.select("scheme_id", "concept_id", "pref_label", "definition", "child_count").orderBy("scheme_id", "pref_label", "concept_id")


def machine_signals(v: Views) -> DataFrame:
    """(concept_id, signal, unit, notation, match, scope_note): the machine terms that are mapped to a business concept, by name."""
    first = v.facts.groupBy("concept_id").agg(*(F.min(F.when(F.col("predicate").endswith(f"{name}>"), F.col("value"))).alias(name) for name in ("otelSignal", "otelUnit", "notation", "scopeNote")))
    mapped = v.links.where(F.col("predicate").isin(list(MATCHES))).select(F.col("subject").alias("machine"), F.col("target").alias("concept_id"), F.col("predicate").alias("match"))
    found = mapped.join(first.withColumnRenamed("concept_id", "machine"), "machine", "left")
    return found.select("concept_id", F.col("otelSignal").alias("signal"), F.col("otelUnit").alias("unit"), "notation", "match", F.col("scopeNote").alias("scope_note")).orderBy("concept_id", F.coalesce("signal", F.lit("")), F.coalesce("notation", F.lit("")))


def concept_detail(v: Views) -> DataFrame:
    """The card of every concept: labels by language, definition by language, sorted other labels, notes, scheme, parent, related
    terms by label, version and who changed it. Children and signals, which may be many, are rows of children() and machine_signals().

    One aggregation over the properties of a card. Of a single-valued property that occurs twice the largest value holds.
    """
    names = english_names(v.labels)
    own = v.facts.where(F.col("predicate").isin(list(CARD)))
    named = own.join(names.select(F.col("concept_id").alias("value"), F.col("pref_label").alias("target_label")), "value", "left")
    of = lambda predicate: F.col("predicate") == predicate
    one = lambda predicate, name: F.max(F.when(of(predicate), F.col("value"))).alias(name)
    listed = lambda predicate, name: F.sort_array(F.collect_set(F.when(of(predicate), F.col("value")))).alias(name)
    spoken = named.where(of(skos("prefLabel")) | of(skos("definition"))).groupBy("concept_id", "predicate", F.coalesce("language", F.lit("en")).alias("language")).agg(F.max("value").alias("value"))
    by_language = lambda predicate, name: F.map_from_entries(F.array_sort(F.collect_list(F.when(of(predicate), F.struct("language", "value"))))).alias(name)
    spoken = spoken.groupBy("concept_id").agg(by_language(skos("prefLabel"), "pref_label"), by_language(skos("definition"), "definition"))
    target = F.struct(F.coalesce("target_label", T.slug(F.col("value"))).alias("pref_label"), F.col("value").alias("concept_id"))
    card = named.groupBy("concept_id").agg(
        listed(skos("altLabel"), "alt_labels"), listed(skos("hiddenLabel"), "hidden_labels"), one(skos("notation"), "notation"), one(skos("scopeNote"), "scope_note"),
        one(skos("changeNote"), "change_note"), one(skos("inScheme"), "scheme_id"), F.max(F.when(of(skos("broader")), target)).alias("parent"),
        F.sort_array(F.collect_set(F.when(of(skos("related")), target))).alias("related"), F.coalesce(F.max(F.when(of(VERSION), F.col("value").try_cast("int"))), F.lit(1)).alias("version"),
        one(f"<{DCT}modified>", "modified"), one(f"<{DCT}contributor>", "contributor"), F.coalesce(F.bool_or(F.when(of("<http://www.w3.org/2002/07/owl#deprecated>"), F.lower("value") == "true")), F.lit(False)).alias("deprecated"),
        F.max(F.when(of(f"<{DCT}isReplacedBy>"), target)).alias("replaced_by"), F.coalesce(F.bool_or(of(skos("topConceptOf"))), F.lit(False)).alias("is_top"),
    )
    known = v.concepts.select("concept_id").distinct()
    return known.join(card, "concept_id", "left").join(spoken, "concept_id", "left").join(child_counts(v.broader), "concept_id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0).cast("long")))


def parent_candidates(moving: DataFrame, concepts: DataFrame, names: DataFrame, broader: DataFrame, machine: tuple[str, ...] = MACHINE, top_only: bool = True) -> DataFrame:
    """(root, concept_id, pref_label): where each of moving (root) may be put: top terms of business schemes, or all terms of them, but
    itself and what is below it. The moving concepts are a stated set; terms are dealt to each of them by a join on a block number."""
    offered = concepts.where(~F.coalesce(T.slug(F.col("scheme_id").cast("string")).isin(list(machine)), F.lit(False)))
    offered = (offered.where("is_top") if top_only else offered).select("concept_id").distinct().join(names, "concept_id", "left")
    asked = moving.select("root").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(15))))
    met = asked.join(offered.withColumn("block", F.pmod(F.xxhash64("concept_id"), F.lit(16)).cast("int")), "block").where("root <> concept_id")
    under = G.below(moving, broader).select("root", F.col("node").alias("concept_id"))
    return met.join(under, ["root", "concept_id"], "left_anti").select("root", "concept_id", F.coalesce("pref_label", F.col("concept_id").cast("string")).alias("pref_label")).orderBy("root", "pref_label", "concept_id")
