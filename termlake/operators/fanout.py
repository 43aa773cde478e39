"""What follows a publication: rebuild the index, re-resolve the backlog, tag the documents again, close the run."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.operators import claims as C
from termlake.operators import documents as D
from termlake.operators import ingestion as I
from termlake.operators import publishing as P
from termlake.operators import resolution as R
from termlake.operators import runs
from termlake.operators import vectors as V
from termlake.operators.gaps import GapQueue
from termlake.scratch import hadoop
from termlake.sources import quads as Q


class IndexStore:
    """Indexes below `path`, each in a folder of its own; a pointer, written last, names the folder that holds.

    A folder begins with the watermark of its index and is never written again, so whoever holds an index keeps it, also when another
    one of the same watermark is published.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def publish(self, index: DataFrame, watermark: str, vectors: DataFrame | None = None) -> None:
        """Write an index, and the vectors (label, concept_id, scheme_id, label_vector) of its labels if there are any, and make it current."""
        name = f"{watermark}-{uuid.uuid4().hex}"
        index.write.parquet(f"{self.path}/index/{name}/labels")
        if vectors is not None:
            vectors.select("label", "concept_id", "scheme_id", "label_vector").write.parquet(f"{self.path}/index/{name}/vectors")
        jvm = self.spark.sparkContext._jvm
        waiting, store = hadoop(self.spark, f"{self.path}/waiting/{name}")
        out = store.create(waiting, False)
        out.write(name.encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        pointer = jvm.org.apache.hadoop.fs.Path(f"{self.path}/current")
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(waiting, pointer, options)

    def watermark(self) -> str | None:
        """Of which graph the current index was built; None without one."""
        name = self._current()
        return name and name.rpartition("-")[0]

    def _current(self) -> str | None:
        place, store = hadoop(self.spark, f"{self.path}/current")
        if not store.exists(place):
            return None
        stream = store.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def load(self) -> DataFrame | None:
        """The index that the pointer names; None without one."""
        name = self._current()
        return self.spark.read.parquet(f"{self.path}/index/{name}/labels") if name else None

    def vectors(self) -> DataFrame | None:
        """The vectors of the current index's labels; None if it was published without."""
        name = self._current()
        if name is None:
            return None
        place, store = hadoop(self.spark, f"{self.path}/index/{name}/vectors")
        return self.spark.read.parquet(str(place)) if store.exists(place) else None


@dataclass
class Workspace:
    """Where a deployment keeps its tables; `sources` gives documents (source_file, doc_version, doc_type, is_html, text)."""

    spark: SparkSession
    path: str
    log: runs.RunLog
    gaps: GapQueue
    sources: Callable[[], DataFrame]
    embed: Callable[[Column], Column] = R.hash_embedding

    @property
    def vocabulary(self) -> str:
        return f"{self.path}/vocabulary"

    @property
    def index(self) -> IndexStore:
        return IndexStore(self.spark, f"{self.path}/resolver")

    def quads(self) -> DataFrame:
        return P.read_version(self.spark, self.vocabulary, Q.current_version(self.spark, self.vocabulary))

    def table(self, name: str) -> DataFrame | None:
        """The newest version of a table of claims or vectors."""
        version = Q.current_version(self.spark, f"{self.path}/{name}")
        return self.spark.read.parquet(Q.version_path(self.spark, f"{self.path}/{name}", version)) if version else None

    def store(self, name: str, rows: DataFrame) -> int:
        return Q.publish(rows, f"{self.path}/{name}", Q.current_version(self.spark, f"{self.path}/{name}"))


def rebuild_index(w: Workspace, event: dict) -> dict[str, int]:
    """Build the index of the published labels and make it current; collisions raise, and the run ends there."""
    quads = w.quads()
    labels = P.views(quads).labels
    index = R.build_index(labels.select("concept_id", F.col("scheme_id"), "label", "kind"))
    named = labels.select("label", "concept_id", "scheme_id").distinct().withColumn("label_vector", w.embed(F.col("label")))
    w.index.publish(index, Q.digest(quads), named)
    return {"labels": w.index.load().count(), "concepts": labels.select("concept_id").distinct().count()}


def reresolve_backlog(w: Workspace, event: dict) -> dict[str, int]:
    """Held claims whose merge key is a label now go live, the gaps of these keys close, and the event learns which documents changed.
    Documents are those of claims that moved, and no others."""
    index, claims = w.index.load(), w.table("claims")
    if index is None:
        raise RuntimeError("no index: it must be rebuilt first")
    if claims is None:
        return {"mentions_resolved": 0, "gaps_closed": 0}
    moved = C.reresolve_backlog(claims.withColumnsRenamed({"subject_concept": "concept_id"}), index, fold=True)
    promoted = moved.where("promoted")
    done = promoted.agg(F.count("*").alias("n"), F.countDistinct("gap_key").alias("keys")).first()
    if done["n"]:
        files = sorted(r["source_file"] for r in promoted.select("source_file").distinct().collect())
        closed = promoted.select("gap_key", F.col("concept_id").cast("string").alias("concept_id")).distinct()
        known = closed.join(w.gaps.entries().select("gap_key"), "gap_key", "left_semi")
        w.gaps.close(known, event.get("run_id", ""))
        exact = {"resolved_by": F.when(F.col("promoted"), "exact").otherwise(F.col("resolved_by")), "resolution_score": F.when(F.col("promoted"), 1.0).otherwise(F.col("resolution_score")), "gap_key": F.when(~F.col("promoted"), F.col("gap_key"))}
        w.store("claims", moved.withColumns(exact).drop("promoted").withColumnsRenamed({"concept_id": "subject_concept"}).select(*I.CLAIM))
        event["documents"] = sorted({*event.get("documents", ()), *files})
    return {"mentions_resolved": done["n"], "gaps_closed": done["keys"]}


def reindex_documents(w: Workspace, event: dict) -> dict[str, int]:
    """Tag and embed again the chunks of the documents that the event names, or that the run's notes name if it does not, by the same
    overlap of lines as at ingestion; other documents keep their vectors."""
    names = event.get("documents") or documents_of(w, event.get("run_id", ""))
    claims = w.table("claims")
    if not names or claims is None:
        return {"documents_reindexed": 0, "chunks": 0}
    docs = w.sources().where(F.col("source_file").isin(list(names)))
    sources = D.source_lines(docs.select(F.col("source_file").alias("doc_id"), "text", "is_html"))
    chunks = D.chunk_lines(sources).withColumnRenamed("doc_id", "source_file").join(docs.select("source_file", "doc_version", "doc_type"), "source_file")
    fresh = V.chunk_vectors(I.tagged(chunks, claims), w.embed(F.col("text")))
    stored = w.table("vectors")
    if stored is not None:
        fresh = stored.join(docs.select("source_file").distinct(), "source_file", "left_anti").select(*fresh.columns).unionByName(fresh)
    w.store("vectors", fresh)
    own = w.table("vectors").where(F.col("source_file").isin(list(names)))
    return {"documents_reindexed": own.select("source_file").distinct().count(), "chunks": own.count()}


def documents_of(w: Workspace, run_id: str) -> list[str]:
    """Documents that a step of the run wrote down."""
    notes = [r["note"] for r in w.log.steps(run_id).where("sk like '%reresolve%'").select("note").collect()]
    return sorted({name for note in notes if note for name in note.split("\n")})


#: The steps after a publication, in their order.
STEPS: tuple[tuple[str, Callable[[Workspace, dict], dict[str, int]]], ...] = (
    ("rebuild_index", rebuild_index), ("reresolve_gaps", reresolve_backlog), ("reindex_documents", reindex_documents),
)


class UnknownStep(ValueError):
    pass


def run_step(w: Workspace, name: str, event: dict) -> dict[str, int]:
    """One step by its name."""
    for known, step in STEPS:
        if known == name:
            return step(w, event)
    raise UnknownStep(name)


def summary(counts: dict[str, int]) -> str:
    """What a run did, in words; parts that are 0 are left out."""
    said = (("mentions_resolved", "mention", "resolved"), ("documents_reindexed", "document", "reindexed"), ("gaps_closed", "gap", "closed"))
    return " · ".join(f"{n} {noun}{'' if n == 1 else 's'} {done}" for key, noun, done in said if (n := counts.get(key, 0)))


def after_publication(w: Workspace, event: dict, wait: float = 2.0) -> dict[str, int]:
    """Run all steps for an event (run_id, concept_id), each with its row, and close the run with the sum of what they counted."""
    made = [(name, lambda e, step=step: step(w, e)) for name, step in STEPS]
    counts = runs.run_steps(w.log, event["run_id"], "publish", made, event, wait=wait)
    w.log.write_run(event["run_id"], "publish", "succeeded", counts, summary(counts))
    return counts


def start_ingest(w: Workspace, run_id: str) -> None:
    """A row that says the run waits, written before any work, so that it can be asked for at once."""
    w.log.write_run(run_id, "ingest", "queued")


def ingest(w: Workspace, run_id: str, only: list[str] | None = None, extract: I.Extractor = I.field_extractor) -> dict[str, int]:
    """Ingest all sources, or those named, into the workspace; a failure is recorded and raised."""
    try:
        if w.index.load() is None:
            rebuild_index(w, {})
        docs = w.sources()
        if only is not None:
            found = {r["source_file"] for r in docs.where(F.col("source_file").isin(only)).select("source_file").collect()}
            if unknown := sorted(set(only) - found):
                raise ValueError(f"not registered: {unknown}")
            docs = docs.where(F.col("source_file").isin(only))
        stored = w.table("claims")
        empty = w.spark.createDataFrame([], ", ".join(f"{c} {'double' if c in ('confidence', 'resolution_score') else 'string'}" for c in I.CLAIM))
        done = I.ingest(docs, w.index.load(), empty if stored is None else stored, extract, run_id)
        n = I.counts(done, docs.count())
        w.store("claims", done.claims)
        fresh = V.chunk_vectors(done.chunks, w.embed(F.col("text")))
        kept = w.table("vectors")
        w.store("vectors", fresh if kept is None else kept.join(docs.select("source_file").distinct(), "source_file", "left_anti").select(*fresh.columns).unionByName(fresh))
        w.gaps.record(done.misses)
    except Exception as error:
        w.log.write_run(run_id, "ingest", "failed", note=str(error)[:500])
        raise
    for i, (name, counted) in enumerate(I.steps(n), 1):
        w.log.write_step(run_id, i, name, "done", counted)
    w.log.write_run(run_id, "ingest", "succeeded", n)
    return n


def full_reset(w: Workspace, seed: DataFrame, run_id: str, dry_run: bool = False, most: int = 500) -> dict[str, int]:
    """The published graph as the seed has it, history gone, every claim restated, closed gaps open again (`most` at most), the index
    rebuilt, and a run to say so. dry_run counts and writes nothing."""
    claims, before = w.table("claims"), w.quads()
    fresh = Q.seed(before.where(~F.coalesce(F.col("graph").startswith(P.HISTORY), F.lit(False))), seed, force=True)
    closed = w.gaps.entries().where("status = 'actioned'").orderBy("gap_key").limit(most)
    counts = {"history_dropped": before.where(F.col("graph").startswith(P.HISTORY)).select("graph").distinct().count(), "gaps_reopened": closed.count(), "claims": claims.count() if claims is not None else 0}
    if dry_run:
        return counts
    Q.publish(fresh, w.vocabulary, Q.current_version(w.spark, w.vocabulary))
    rebuild_index(w, {})
    if claims is not None:
        again = C.restate(claims.withColumnsRenamed({"subject_surface": "surface", "subject_concept": "concept_id"}), w.index.load())
        w.store("claims", again.withColumnsRenamed({"surface": "subject_surface", "concept_id": "subject_concept"}).select(*I.CLAIM))
    w.gaps.reopen(closed)
    w.log.write_run(run_id, "reset", "succeeded", counts)
    return counts
