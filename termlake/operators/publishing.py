"""A vocabulary edit from draft to version: archive, insert, gate, conditional write, audit."""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.operators import graph as G
from termlake.operators.runs import RunLog
from termlake.sources import quads as Q
from termlake.sources.quads import current_version, lexical
from termlake.sources.turtle import RDF, SCHEMA

SKOS = "http://www.w3.org/2004/02/skos/core#"
DCT = "http://purl.org/dc/terms/"
VERSION = "<http://www.w3.org/2002/07/owl#versionInfo>"
REVISED = "<http://www.w3.org/ns/prov#wasRevisionOf>"
LABELS = {"prefLabel": "pref", "altLabel": "alt", "hiddenLabel": "hidden"}
#: Properties whose target must be a concept.
LINKS = ("broader", "related", "exactMatch", "closeMatch", "broadMatch")
HISTORY = "history/"
ATTEMPTS, PAUSE = 3, 0.1


class Refused(Exception):
    """The vocabulary as it would be breaks rules; `findings` says which."""

    def __init__(self, findings: list[tuple[str, str]]) -> None:
        super().__init__("; ".join(f"{concept} {message}" for concept, message in findings))
        self.findings = findings


@dataclass
class Draft:
    """An edit of one concept. Fields that are None stay as they are; labels, definition and notes are edited in `language` only."""

    concept: str
    scheme: str | None = None
    pref: str | None = None
    alt: list[str] | None = None
    hidden: list[str] | None = None
    definition: str | None = None
    parent: str | None = None
    language: str = "en"
    scope_note: str | None = None
    change_note: str | None = None
    related: list[str] | None = field(default=None)

    def labels(self) -> list[str]:
        return [x for x in (self.pref, *(self.alt or ()), *(self.hidden or ())) if x]


def skos(name: str) -> str:
    return f"<{SKOS}{name}>"


@dataclass
class Views:
    """The published graph as the gate and the browser read it."""

    concepts: DataFrame  # concept_id, scheme_id, definition, is_top
    labels: DataFrame  # concept_id, scheme_id, label, language, kind, is_literal
    broader: DataFrame  # child, parent
    links: DataFrame  # subject, predicate, target, is_iri: all of LINKS
    schemes: DataFrame  # scheme_id
    facts: DataFrame  # concept_id, predicate, value, language: all properties


def published(quads: DataFrame) -> DataFrame:
    """(concept_id, predicate, value, language, object) of the published graph only."""
    own = quads.where("graph = 'published'")
    return own.select(lexical(F.col("subject")).alias("concept_id"), "predicate", lexical(F.col("object")).alias("value"), F.col("lang").alias("language"), "object")


def views(quads: DataFrame) -> Views:
    own = published(quads)
    of = lambda name: own.where(F.col("predicate") == skos(name))
    typed = lambda name: own.where((F.col("predicate") == f"<{RDF}type>") & (F.col("object") == skos(name))).select("concept_id").distinct()
    facts = own.groupBy("concept_id").agg(F.min(F.when(F.col("predicate") == skos("definition"), F.col("value"))).alias("definition"), F.bool_or(F.col("predicate") == skos("topConceptOf")).alias("is_top"))
    schemes = of("inScheme").select("concept_id", F.col("value").alias("scheme_id")).distinct()
    concepts = typed("Concept").join(schemes, "concept_id", "left").join(facts, "concept_id", "left").select("concept_id", "scheme_id", "definition", "is_top")
    kinds = F.create_map(*(F.lit(x) for name, kind in LABELS.items() for x in (skos(name), kind)))
    labels = own.withColumn("kind", F.try_element_at(kinds, F.col("predicate"))).where("kind is not null").join(schemes, "concept_id")
    labels = labels.select("concept_id", "scheme_id", F.col("value").alias("label"), "language", "kind", F.col("object").startswith('"').alias("is_literal"))
    links = own.where(F.col("predicate").isin([skos(name) for name in LINKS]))
    links = links.select(F.col("concept_id").alias("subject"), F.regexp_extract("predicate", "#(\\w+)>$", 1).alias("predicate"), F.col("value").alias("target"), F.col("object").startswith("<").alias("is_iri"))
    broader = links.where("predicate = 'broader'").select(F.col("subject").alias("child"), F.col("target").alias("parent"))
    return Views(concepts, labels, broader, links, typed("ConceptScheme").withColumnRenamed("concept_id", "scheme_id"), own.drop("object"))


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(Q.version_path(spark, path, version)) if version else spark.createDataFrame([], SCHEMA)


def history_graph(concept: str, version: int) -> str:
    return f"{HISTORY}{concept}/{version}"


def apply(quads: DataFrame, draft: Draft, version: int, author: str | None = None, now: str | None = None, replace_all: bool = False) -> DataFrame:
    """quads with the published concept copied to the history graph of the version before, if there is one, and the draft merged over it.

    Fields that the draft leaves out stay, other languages' labels too; with replace_all they go, and only history keeps them.
    """
    quoted = lambda text: '"' + re.sub(r'(["\\])', r"\\\1", text).replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    said = lambda text: (f"{quoted(text)}@{draft.language}", draft.language)
    subject = f"<{draft.concept}>"
    edited: dict[str, list[tuple[str, str | None]]] = {VERSION: [(f'"{version}"', None)]}
    if version > 1:
        edited[REVISED] = [(f"<{history_graph(draft.concept, version - 1)}>", None)]
    for name, value in (("modified", now), ("contributor", author)):
        if value is not None:
            edited[f"<{DCT}{name}>"] = [(quoted(value), None)]
    one = lambda value: value and [value]
    texts = {"prefLabel": one(draft.pref), "altLabel": draft.alt, "hiddenLabel": draft.hidden, "definition": one(draft.definition), "scopeNote": one(draft.scope_note), "changeNote": one(draft.change_note)}
    for name, values in texts.items():
        if values is not None:
            edited[skos(name)] = [said(v) for v in values]
    for name, targets in (("inScheme", one(draft.scheme)), ("broader", one(draft.parent)), ("related", draft.related)):
        if targets is not None:
            edited[skos(name)] = [(f"<{target}>", None) for target in targets]
    mine = (F.col("subject") == subject) & (F.col("graph") == "published")
    replaced = mine if replace_all else mine & F.col("predicate").isin(list(edited)) & (F.col("lang").isNull() | (F.col("lang") == draft.language))
    kept = quads.where(~F.coalesce(replaced, F.lit(False)))
    rows = [(subject, p, o, "published", lang, None) for p, values in edited.items() for o, lang in values]
    rows.append((subject, f"<{RDF}type>", skos("Concept"), "published", None, None))
    fresh = quads.sparkSession.createDataFrame(rows, SCHEMA)
    if version > 1:
        kept = kept.unionByName(quads.where(mine).withColumn("graph", F.lit(history_graph(draft.concept, version - 1))))
    return kept.unionByName(fresh).distinct()


def concept_version(quads: DataFrame, concept: str) -> int:
    """The version that the published concept carries, 0 for a new one."""
    mine = quads.where((F.col("subject") == f"<{concept}>") & (F.col("graph") == "published") & (F.col("predicate") == VERSION))
    return int(mine.agg(F.coalesce(F.max(lexical(F.col("object")).try_cast("bigint")), F.lit(0)).alias("n")).first()["n"])


def publish(log: RunLog, path: str, draft: Draft, author: str, note: str | None = None, attempts: int = ATTEMPTS, gaps: DataFrame | None = None) -> dict:
    """Publish a draft as the next version below path: {run_id, version, concept_version, warnings, surfaces, closes, history, watermark}.

    The gate reads the vocabulary as it would be; violations raise Refused and nothing is written. When another writer
    was first, the draft is replayed over what that one wrote, `attempts` times in all, then VersionConflict is raised. The audit
    row follows the write. `surfaces` are the merge keys of the draft's labels, `closes` those that the queue `gaps` (gap_key) has.
    """
    from termlake.operators.impact import surfaces_of

    spark = log.spark
    for attempt in range(1, attempts + 1):
        base = current_version(spark, path)
        before = read_version(spark, path, base)
        number = concept_version(before, draft.concept) + 1
        after = apply(before, draft, number, author, log.clock().isoformat(timespec="seconds"))
        findings = [(r["concept_id"], r["message"], r["severity"]) for r in G.gate_views(views(after)).collect()]
        if broken := [(c, m) for c, m, severity in findings if severity == "violation"]:
            raise Refused(broken)
        try:
            version = Q.publish(after, path, base)
        except Q.VersionConflict:
            if attempt == attempts:
                raise
            time.sleep(PAUSE * attempt)
            continue
        run_id = f"publish-{uuid.uuid4().hex[:12]}"
        history = history_graph(draft.concept, number - 1) if number > 1 else ""
        watermark = Q.digest(read_version(spark, path, version))
        surfaces = surfaces_of(spark, draft.labels())
        closes = sorted(r["gap_key"] for r in gaps.where(F.col("gap_key").isin(surfaces)).select("gap_key").distinct().collect()) if gaps is not None else []
        log.write_audit(draft.concept, log.clock(), run_id, number, author, note, history, watermark)
        return {"run_id": run_id, "version": version, "concept_version": number, "warnings": [(c, m) for c, m, _ in findings], "surfaces": surfaces, "closes": closes, "history": history, "watermark": watermark}
    raise ValueError("attempts must be 1 at least")
