"""The two checks that a deployment runs over its corpus and its vocabulary. Each finding is a row; none means that all is well."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.operators import graph as G
from termlake.operators import ingestion as I
from termlake.operators import registry as R
from termlake.operators.publishing import Views

LEAST_CONCEPTS = 20


def _said(rows: DataFrame, check: str, *parts) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.concat_ws(" ", *parts).alias("finding"))


def mentions(docs: DataFrame, phrase: str) -> DataFrame:
    """(source_file, n) of documents (source_file, text) that hold the phrase, whatever its case and inner white space."""
    return docs.select("source_file", T.phrase_count(F.col("text"), phrase).cast("long").alias("n")).where("n > 0")


def word_totals(docs: DataFrame) -> DataFrame:
    """(documents, words)"""
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(T.word_count(F.col("text"))), F.lit(0)).cast("long").alias("words"))


def apart(sides: DataFrame) -> DataFrame:
    """(subject, n_values) of sides (subject, source, value) with two distinct values at least."""
    return sides.groupBy("subject").agg(F.countDistinct("value").alias("n_values")).where("n_values >= 2")


def corpus(registry: DataFrame, present: DataFrame, docs: DataFrame, sides: DataFrame, labels: DataFrame, gap: str, gap_mentions: int, gap_documents: int, least: int = LEAST_CONCEPTS) -> DataFrame:
    """(check, finding). registry and present: as in registry.compare(); docs: source_file, is_html, raw, text (readable); sides: subject,
    source, value, claims that must disagree and stand in their sources; labels: concept_id, label; gap: a phrase that must be counted
    as given and be no label."""
    read = sides.join(docs.select(F.col("source_file").alias("source"), "text"), "source", "left")
    counted = mentions(docs, gap).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("d"))
    html = docs.where("is_html")
    cover = I.vocabulary_coverage(labels, docs)
    rules = (
        _said(R.compare(registry, present), "registry", "filename", "finding"),
        _said(R.incomplete(registry), "registry", "filename", F.lit("has no"), "field"),
        _said(read.where("text is null or not contains(text, value)"), "contradiction", "subject", F.lit("is not said in"), "source"),
        _said(sides.select("subject").distinct().join(apart(sides), "subject", "left_anti"), "contradiction", "subject", F.lit("has one value only")),
        _said(counted.where((F.col("n") != gap_mentions) | (F.col("d") != gap_documents)), "gap", F.col("n").cast("string"), F.lit("mentions in"), F.col("d").cast("string"), F.lit("documents")),
        _said(labels.where(T.normalise(F.col("label")) == T.normalise(F.lit(gap))), "gap", F.lit("is a label of"), F.col("concept_id").cast("string")),
        _said(html.where(F.size(T.entities(F.col("raw"))) == 0), "html", "source_file", F.lit("has no entities")),
        _said(html.where(F.contains("text", F.lit("<")) | (F.size(T.entities(F.col("text"))) > 0)), "html", "source_file", F.lit("is not flat")),
        _said(cover.where(F.col("mentioned") < least), "coverage", F.lit("only"), F.col("mentioned").cast("string"), F.lit("concepts are mentioned")),
    )
    return functools.reduce(DataFrame.unionByName, rules)


def warning_histogram(findings: DataFrame) -> DataFrame:
    """(message, n) of findings that do not block."""
    return findings.where("severity <> 'violation'").groupBy("message").agg(F.count("*").alias("n"))


def concepts_per_scheme(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("scheme_id").agg(F.countDistinct("concept_id").alias("n"))


def vocabulary(v: Views, absent_labels: list[str], absent_stems: list[str], unmapped: DataFrame, expected_unmapped: DataFrame, cards: DataFrame) -> DataFrame:
    """(check, finding). Labels and stems that must be in no label; tokens (token) that lead to nothing, found and expected; cards
    (concept_id, predicate, value) that must be among the facts, null values standing for any."""
    from termlake.operators.telemetry import expectations

    gate = G.gate_views(v)
    have = v.facts.select("concept_id", "predicate", "value")
    named = cards.where("value is not null").join(have, ["concept_id", "predicate", "value"], "left_anti")
    some = cards.where("value is null").join(have.select("concept_id", "predicate").distinct(), ["concept_id", "predicate"], "left_anti").select("concept_id", "predicate", "value")
    rules = (
        _said(gate.where("severity = 'violation'"), "gate", "concept_id", "message"),
        _said(v.labels.where(T.normalise(F.col("label")).isin([*absent_labels, ""]) & (T.normalise(F.col("label")) != "")), "gap", "label", F.lit("is a label")),
        _said(v.labels.where(T.holds_stem(F.col("label"), absent_stems)) if absent_stems else v.labels.limit(0), "gap", "label", F.lit("is a label")),
        _said(expectations(unmapped, expected_unmapped), "mapping", "token", "finding"),
        _said(named.unionByName(some), "card", "concept_id", F.lit("lacks"), "predicate", F.coalesce("value", F.lit(""))),
    )
    return functools.reduce(DataFrame.unionByName, rules)
