"""Documents to claims in one job: chunk, extract, gate, resolve, hold or activate, tag, retract, insert, compare."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.functions import units as U
from termlake.operators import claims as C
from termlake.operators import documents as D
from termlake.operators import gaps as Q
from termlake.operators import resolution as R
from termlake.scratch import stage

#: chunks (source_file, doc_type, chunk_no, start_line, end_line, heading, text) -> facts (source_file, chunk_no, subject, predicate, value,
#: unit, snippet, confidence)
Extractor = Callable[[DataFrame], DataFrame]
CONFIDENCE = 0.8
REJECTED_SNIPPET, REJECTED_FIELD = 500, 200
CLAIM = (
    "claim_id", "subject_concept", "subject_surface", "predicate", "value", "unit", "source_file", "doc_version", "line_range", "snippet",
    "confidence", "resolved_by", "resolution_score", "run_id", "status", "gap_key",
)


def field_extractor(chunks: DataFrame) -> DataFrame:
    """Facts of lines with three fields, `subject | predicate | value` or with colons: what stands in for a model that reads prose."""
    field = r"[^:|\n]*[^:|\s]"
    line = rf"(?m)^[\t *|-]*({field})[\t ]*[:|][\t ]*({field})[\t ]*[:|][\t ]*([^|\n]*[^|\s])[\t |]*$"
    found = chunks.select("source_file", "chunk_no", F.explode(F.regexp_extract_all("text", F.lit(line), F.lit(0))).alias("snippet"))
    part = lambda i: F.trim(F.regexp_extract("snippet", line, i))
    return found.select("source_file", "chunk_no", part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("value"), F.lit(None).cast("string").alias("unit"), F.trim("snippet").alias("snippet"), F.lit(CONFIDENCE).alias("confidence"))


@dataclass
class Ingested:
    """What a run made, as tables; `claims` are all stored ones after it."""

    chunks: DataFrame  # source_file, doc_type, doc_version, chunk_no, start_line, end_line, heading, text, concepts
    rejections: DataFrame  # source_file, reason, subject, snippet
    new_claims: DataFrame
    claims: DataFrame
    misses: DataFrame  # for a GapQueue
    conflicts: DataFrame  # group_key, claim_id: members of groups that disagree
    retracted: DataFrame  # claim_id


def gated(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """facts with reason, null where they pass, and line_range as in the document. sources: source_file, all (no, line).

    A snippet is sought in the readable text, white space apart; one bad fact drops no other.
    """
    texts = sources.select(F.col("source_file").alias("doc_id"), F.array_join("all.line", "\n").alias("text"), F.col("all.no").alias("numbers"))
    found = D.locate_all(facts.select(F.col("source_file").alias("doc_id"), "snippet"), texts).withColumnsRenamed({"doc_id": "source_file"})
    placed = facts.join(found, ["source_file", "snippet"], "left")
    reason = (
        F.when(F.coalesce(T.normalise(F.col("subject")), F.lit("")) == "", "empty subject").when(F.coalesce(T.stripped(F.col("snippet")), F.lit("")) == "", "empty snippet")
        .when(F.col("start").isNull(), "snippet not in the source").when(F.col("predicate").isNull() | F.col("value").isNull() | ~F.coalesce(F.col("confidence"), F.lit(CONFIDENCE)).between(0, 1), "not a fact")
    )
    lines = F.concat_ws("-", F.col("first_line").cast("string"), F.col("last_line").cast("string"))
    return placed.select(*facts.columns, reason.alias("reason"), lines.alias("line_range"))


def claim_groups(claims: DataFrame) -> DataFrame:
    """claims as sides of what may disagree: group_key of subject, or held surface by merge key, and predicate key; value, dimension, approximate."""
    subject = F.coalesce("subject_concept", F.concat(F.lit("held:"), "gap_key"))
    read = claims.withColumn("q", U.parse_quantity(F.col("value"), F.col("unit")))
    key = F.concat_ws("|", subject, U.predicate_key(F.col("predicate")))
    return read.select("claim_id", key.alias("group_key"), F.coalesce("q.canonical", "q.value").alias("value"), F.col("q.dimension").alias("dimension"), F.coalesce("q.approximate", F.lit(False)).alias("approximate"))


def contradicting(claims: DataFrame) -> DataFrame:
    """(group_key, claim_id): every measured side of each group that disagrees; members of one group conflict with each other."""
    sides = claim_groups(claims)
    apart = C.contradictions(sides, ["group_key"]).select("group_key")
    return sides.where("value is not null and not approximate").join(apart, "group_key", "left_semi").select("group_key", "claim_id").distinct()


def conflict_pairs(members: DataFrame) -> DataFrame:
    """(claim_id, conflicts_with) of contradicting(): all ordered pairs of each group. A reader of one claim joins members on group_key
    instead, which is linear; the pairs are for the export to quads."""
    other = members.select("group_key", F.col("claim_id").alias("conflicts_with"))
    return members.join(other, "group_key").where("claim_id <> conflicts_with").select("claim_id", "conflicts_with").distinct()


def claims_of(facts: DataFrame, run_id: str | None) -> DataFrame:
    """Claims of resolved facts; a fact whose subject resolves to no concept is held under its merge key."""
    held = F.col("concept_id").isNull()
    made = C.claim_id(F.col("source_file"), F.col("doc_version"), F.col("line_range"), F.col("predicate"), F.col("value"), F.col("unit"))
    return facts.select(
        made.alias("claim_id"), F.col("concept_id").alias("subject_concept"), F.col("surface").alias("subject_surface"), "predicate", "value", "unit", "source_file", "doc_version", "line_range",
        "snippet", F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence"), F.col("stage").alias("resolved_by"), F.col("score").alias("resolution_score"), F.lit(run_id).cast("string").alias("run_id"),
        F.when(held, "held").otherwise("active").alias("status"), F.when(held, T.merge_key(F.col("surface"))).alias("gap_key"),
    ).distinct()


def tagged(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """chunks with the sorted distinct concepts of the claims (subject_concept, source_file, line_range) whose lines they overlap."""
    spans = claims.where("subject_concept is not null").select("source_file", "subject_concept", D.line_range(F.col("line_range")).alias("r"))
    spans = spans.where("r is not null").select("source_file", "subject_concept", F.col("r.start").alias("a_start"), F.col("r.end").alias("a_end")).distinct()
    places = chunks.select("source_file", "chunk_no", F.col("start_line").alias("b_start"), F.col("end_line").alias("b_end"))
    found = D.overlap_join(spans, places, "source_file").groupBy("source_file", "chunk_no").agg(F.sort_array(F.collect_set("subject_concept")).alias("concepts"))
    return chunks.join(found, ["source_file", "chunk_no"], "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))


def ingest(docs: DataFrame, index: DataFrame, stored: DataFrame, extract: Extractor = field_extractor, run_id: str | None = None, at: Column | None = None,
           vectors: DataFrame | None = None, embed: Callable[[Column], Column] | None = None) -> Ingested:
    """One job over all of docs (source_file, doc_version, doc_type, is_html, text), newest versions only.

    What `stored` holds of these documents is retracted before what they say now is inserted, so reading them again changes
    nothing. Contradictions are sought once, in all stored claims. Extraction runs once: its facts are stored.
    """
    sources = D.source_lines(docs.select(F.col("source_file").alias("doc_id"), "text", "is_html")).withColumnRenamed("doc_id", "source_file")
    about = docs.select("source_file", "doc_version", "doc_type")
    chunks = D.chunk_lines(sources.withColumnRenamed("source_file", "doc_id")).withColumnRenamed("doc_id", "source_file").join(about, "source_file")
    chunks = stage(chunks, "chunks")
    facts = stage(gated(extract(chunks), sources), "facts")
    bad = facts.where("reason is not null")
    rejections = bad.select("source_file", "reason", F.substring("subject", 1, REJECTED_FIELD).alias("subject"), F.substring("snippet", 1, REJECTED_SNIPPET).alias("snippet"))
    good = facts.where("reason is null").join(about.select("source_file", "doc_version"), "source_file").withColumnRenamed("subject", "surface")
    resolved = stage(R.resolve(good.drop("chunk_no", "reason"), index, vectors, embed=embed), "resolved")
    new = claims_of(resolved, run_id)
    retracted = stored.join(docs.select("source_file").distinct(), "source_file", "left_semi").select("claim_id").distinct()
    claims = stage(C.retract(stored, docs).select(*CLAIM).unionByName(new.select(*CLAIM)).distinct(), "claims")
    place = F.concat_ws(":", "source_file", "line_range")
    missed = resolved.where("stage = 'abstain'").select(
        "surface", F.lit(None).cast("string").alias("merge_as"), F.lit("ingestion").alias("source"), F.col("snippet").alias("text"), place.alias("locator"), "doc_version",
        (F.current_timestamp() if at is None else at).alias("at"), F.lit(Q.ADD_LABEL).alias("gap_type"), F.col("shortlist").alias("suggestions"), F.lit(None).cast("string").alias("scheme"), F.lit(run_id).cast("string").alias("run_id"),
    )
    return Ingested(tagged(chunks, new), rejections, new, claims, missed, contradicting(claims), retracted)


def counts(run: Ingested, documents: int) -> dict[str, int]:
    """What a run did, in the numbers that its steps report."""
    status = {r["status"]: r["n"] for r in run.new_claims.groupBy("status").agg(F.count("*").alias("n")).collect()}
    rejected, chunks = run.rejections.count(), run.chunks.count()
    active, held = status.get("active", 0), status.get("held", 0)
    return {
        "documents": documents, "chunks": chunks, "vectors": chunks, "facts_extracted": active + held, "claims_active": active, "claims_held": held,
        "conflicts": run.conflicts.select("group_key").distinct().count(), "gaps": run.misses.count(), "rejections": rejected,
    }


def steps(n: dict[str, int]) -> list[tuple[str, dict[str, int]]]:
    """The six rows of a run, of counts()."""
    return [
        ("register", {"documents": n["documents"]}), ("chunk_and_index", {"chunks": n["chunks"], "vectors": n["vectors"]}),
        ("extract", {"facts": n["facts_extracted"], "rejections": n["rejections"]}),
        ("resolve", {"active": n["claims_active"], "held": n["claims_held"], "gaps": n["gaps"]}),
        ("detect_conflicts", {"conflicts": n["conflicts"]}), ("persist", {"claims": n["claims_active"] + n["claims_held"]}),
    ]


def merged(runs: list[dict[str, int]]) -> dict[str, int]:
    """The counts of several runs added up."""
    return {name: sum(run.get(name, 0) for run in runs) for run in runs for name in run}


def to_quads(claims: DataFrame, namespace: str, conflicts: DataFrame | None = None) -> DataFrame:
    """Claims as quads of the facts graph, a row a property; null properties have none. conflicts: claim_id, conflicts_with."""
    text, node = T.literal, lambda c: F.concat(F.lit(f"<{namespace}"), c, F.lit(">"))
    number = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#decimal>'))
    subject = F.concat(F.lit(f"<{namespace}claim/"), "claim_id", F.lit(">"))
    said = {"predicate": "predicate", "value": "value", "unit": "unit", "sourceFile": "source_file", "docVersion": "doc_version", "lineRange": "line_range", "snippet": "snippet", "subjectSurface": "subject_surface", "heldSurface": "gap_key", "runId": "run_id"}
    rows = {name: text(F.col(column)) for name, column in said.items()} | {
        "confidence": number(F.col("confidence")), "resolutionScore": number(F.col("resolution_score")), "resolvedBy": node(F.concat(F.lit("stage/"), "resolved_by")),
        "status": node(F.col("status")), "subject": node(F.col("subject_concept")),
    }
    pairs = F.array(*(F.struct(F.lit(f"<{namespace}{name}>").alias("predicate"), value.alias("object")) for name, value in rows.items()), F.struct(F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>").alias("predicate"), F.lit(f"<{namespace}Claim>").alias("object")))
    out = claims.select(subject.alias("subject"), F.inline(F.filter(pairs, lambda p: p["object"].isNotNull())))
    if conflicts is not None:
        out = out.unionByName(conflicts.select(subject.alias("subject"), F.lit(f"<{namespace}conflictsWith>").alias("predicate"), F.concat(F.lit(f"<{namespace}claim/"), "conflicts_with", F.lit(">")).alias("object")))
    null = F.lit(None).cast("string")
    return out.select("*", F.lit("facts").alias("graph"), null.alias("lang"), null.alias("datatype")).distinct()


def read_claims(claims: DataFrame, concept_id: str | None = None) -> DataFrame:
    """All claims, held ones too, or those of one concept, by predicate, file and lines; confidence, stage and score are there in both."""
    rows = claims if concept_id is None else claims.where(F.col("subject_concept") == concept_id)
    return rows.orderBy("predicate", "source_file", "line_range", "claim_id")


def vocabulary_coverage(labels: DataFrame, docs: DataFrame, most: int = 4) -> DataFrame:
    """(concepts, mentioned, percent): how many concepts of labels (concept_id, label) occur as whole words in docs (text).

    Runs of up to `most` words of the texts are joined with the labels' keys; a longer label is sought by its first `most` words and
    then in the text.
    """
    keys = labels.select("concept_id", T.normalise(F.col("label")).alias("key")).where("key <> ''").distinct()
    keys = keys.withColumn("head", F.array_join(F.slice(F.split("key", " "), 1, most), " "))
    tokens = docs.select(F.monotonically_increasing_id().alias("row"), T.normalise(F.col("text")).alias("body"))
    longest = keys.agg(F.coalesce(F.max(F.size(F.split("head", " "))), F.lit(1))).first()[0]
    runs = F.split("body", " ") if longest == 1 else T.ngrams(F.split("body", " "), longest)["phrase"]  # none longer than the labels
    said = tokens.select("row", F.explode(runs).alias("head")).join(keys.select("head"), "head", "left_semi").distinct()
    short = keys.where("key = head").join(said.select("head").distinct(), "head", "left_semi").select("concept_id")
    long = keys.where("key <> head").join(said, "head").join(tokens, "row").where(T.whole_word_in(F.col("key"), F.col("body"))).select("concept_id")
    found = short.union(long).distinct().withColumn("said", F.lit(1))
    whole = keys.select("concept_id").distinct().join(found, "concept_id", "left").agg(F.count("*").alias("concepts"), F.count("said").alias("mentioned"))
    return whole.withColumn("percent", F.when(F.col("concepts") > 0, F.floor(100 * F.col("mentioned") / F.col("concepts"))).otherwise(F.lit(0).cast("long")))
