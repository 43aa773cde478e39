"""Labels, exact and vector resolution, phrase sweeps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.functions.text import FUNCTION_WORDS, word_folder
from termlake.operators import similarity as S
from termlake.scratch import stage
from termlake.tasks import ship

ship(__name__)

CLEAR, MARGIN, SHORTLIST = 0.82, 0.05, 5
#: Schemes of machine names.
MACHINE = ("telemetry",)


RANK = {"pref": 3, "hidden": 2, "alt": 1}


def owners(labels: DataFrame) -> DataFrame:
    """(label_key, concept_id, scheme_id, kind): each owner of each label key once, empty keys left out; pref goes before hidden, hidden before alt."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair)), F.col("kind")), F.lit(0))
    keyed = labels.withColumn("label_key", T.normalise(F.col("label"))).where("label_key <> ''")
    return keyed.groupBy("label_key", "concept_id", "scheme_id").agg(F.max_by("kind", rank).alias("kind"))


def label_index(labels: DataFrame) -> DataFrame:
    """(label_key, n_concepts, concepts, schemes, kind) of labels (concept_id, scheme_id, label, kind).

    `concepts` are all owners in order, one entry exactly if the owner is unique. Schemes are governed and few.
    """
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair)), F.col("kind")), F.lit(0))
    grouped = owners(labels).groupBy("label_key")
    found = grouped.agg(F.sort_array(F.collect_set("concept_id")).alias("concepts"), F.sort_array(F.collect_set("scheme_id")).alias("schemes"), F.max_by("kind", rank).alias("kind"))
    return found.select("label_key", F.size("concepts").cast("long").alias("n_concepts"), "concepts", "schemes", "kind")


class Collision(ValueError):
    """Labels that several concepts of one scheme have."""


def build_index(labels: DataFrame) -> DataFrame:
    """label_index(), refused with Collision if any scheme has a label twice; the message names 20 of these at most."""
    if found := label_collisions(labels).orderBy("scheme_id", "label_key").limit(20).collect():
        raise Collision("; ".join(f"{r['label_key']!r} has {r['n_concepts']} concepts in {r['scheme_id']}" for r in found))
    return label_index(labels)


def english_names(labels: DataFrame) -> DataFrame:
    """(concept_id, pref_label): the last preferred label, in text order, in English or no language."""
    own = labels.where("kind = 'pref' and (language is null or language = 'en')")
    return own.groupBy("concept_id").agg(F.max("label").alias("pref_label"))


def label_collisions(labels: DataFrame) -> DataFrame:
    """(scheme_id, label_key, n_concepts) of keys that several concepts of a scheme have: one aggregation, no self-join."""
    keyed = labels.withColumn("label_key", T.normalise(F.col("label"))).where("label_key <> ''")
    return keyed.groupBy("scheme_id", "label_key").agg(F.countDistinct("concept_id").alias("n_concepts")).where("n_concepts > 1")


def resolve_exact(mentions: DataFrame, index: DataFrame, key: str = "label_key") -> DataFrame:
    """mentions with concept_id where exactly one concept has their key; several or none abstain, and stage says which."""
    n = F.size("concepts")
    found = mentions.join(index.select(key, "concepts"), key, "left")
    stage = F.when(F.col("concepts").isNull(), "miss").when(n == 1, "exact").otherwise("collision")
    return found.select(*mentions.columns, F.when(n == 1, F.col("concepts")[0]).alias("concept_id"), stage.alias("stage"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest_labels(vectors: DataFrame, labels: DataFrame, k: int = SHORTLIST, tile_bytes: int = S.TILE_BYTES) -> DataFrame:
    """(vec_id, rank, label, score): the k nearest of labels (label, label_vector) to vectors (vec_id, embedding), exactly and by tiles.
    Scores are rounded before they are ranked, ties go by label."""
    found = S.nearest(vectors, labels.select("label", "label_vector"), k, "vec_id", "embedding", "label_vector", ["label"], tile_bytes=tile_bytes)
    return found.select("vec_id", "label", "score", "rank")


def _listed(labels: DataFrame, machine: tuple[str, ...]) -> DataFrame:
    """Labels of schemes that are listed."""
    return labels.where(~F.coalesce(F.col("scheme_id").isin(list(machine)), F.lit(False))).select("label", "concept_id", "label_vector")


def shortlists(asked: DataFrame, labels: DataFrame, k: int = SHORTLIST, machine: tuple[str, ...] = MACHINE, tile_bytes: int = S.TILE_BYTES) -> DataFrame:
    """(vec_id, near): nearest_concepts() of distinct asked (vec_id, embedding) as an array (concept_id, label, score), the best first."""
    wanted = asked.where("embedding IS NOT NULL")
    found = S.shortlists(wanted, _listed(labels, machine), k, "vec_id", "embedding", "label_vector", ["label", "concept_id"], group="concept_id", tile_bytes=tile_bytes)
    if found is not None:
        return found.select("vec_id", F.transform("near", _near).alias("near"))
    ranked = nearest_concepts(wanted, labels, k, machine, tile_bytes)
    ranks = F.array_sort(F.collect_list(F.struct("rank", "concept_id", "label", "score")))
    return ranked.groupBy("vec_id").agg(F.transform(ranks, _near).alias("near"))


def _near(x: Column) -> Column:
    return F.struct(x["concept_id"].cast("string").alias("concept_id"), x["label"].alias("label"), x["score"].cast("double").alias("score"))


def nearest_concepts(vectors: DataFrame, labels: DataFrame, k: int = SHORTLIST, machine: tuple[str, ...] = MACHINE, tile_bytes: int = S.TILE_BYTES) -> DataFrame:
    """(vec_id, rank, concept_id, label, score): the k nearest concepts by their best label of labels (label, concept_id, scheme_id,
    label_vector); the first label wins ties. Machine schemes are never listed, though they match exactly."""
    found = S.nearest(vectors, _listed(labels, machine), k, "vec_id", "embedding", "label_vector", ["label", "concept_id"], group="concept_id", tile_bytes=tile_bytes)
    return found.select("vec_id", "concept_id", "label", "score", "rank")


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic unit vector of a text, for tests and for those without a model: its words hashed to places and signs; zeros without words."""
    place = lambda h: F.pmod(h, F.lit(dim))
    sums = lambda hashed: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(F.filter(hashed, lambda h: place(h) == d), F.lit(0.0), lambda s, h: s + F.when(F.call_function("shiftright", h, F.lit(40)) % 2 == 0, 1.0).otherwise(-1.0)))
    return T.let(F.transform(T.words(text), lambda w: F.xxhash64(w)), lambda hashed: T.unit(sums(hashed)))


def resolve(mentions: DataFrame, index: DataFrame, vectors: DataFrame | None = None, aliases: DataFrame | None = None, embed: Callable[[Column], Column] | None = None,
            clear: float = CLEAR, margin: float = MARGIN, k: int = SHORTLIST) -> DataFrame:
    """mentions (id, surface) with normalised, lookup, concept_id, stage, score, label_kind, collision, shortlist.

    First exact: a key of one concept resolves with score 1, a key of several abstains and names them all. What is in no label
    goes to the vectors (label, concept_id, scheme_id, label_vector), if there are any and an `embed`: the best concept resolves if
    its score is clear and far enough from the second. All else abstains and keeps its shortlist. aliases (original, corrected), both
    normalised, change what is looked up and never the surface; then label_kind is `alias`. Each mention is one row.

    Each distinct surface is normalised and goes through the cascade once, and mentions meet what is found for theirs.
    """
    surfaces = mentions.select("surface").distinct().select("surface", F.coalesce(T.normalise(F.col("surface")), F.lit("")).alias("normalised"))
    if vectors is not None and embed is not None:  # read twice: by the search and by what is made of it
        surfaces = stage(surfaces, "surfaces")
    found = _cascade(surfaces, ["surface"], index, vectors, aliases, embed, clear, margin, k).withColumnRenamed("surface", "said_surface")
    made = [c for c in found.columns if c != "said_surface"]
    return mentions.join(found, F.col("surface").eqNullSafe(F.col("said_surface")), "left").select(*(mentions[c] for c in mentions.columns), *made)


def _cascade(keyed: DataFrame, columns: list[str], index: DataFrame, vectors: DataFrame | None, aliases: DataFrame | None, embed: Callable[[Column], Column] | None, clear: float, margin: float, k: int) -> DataFrame:
    """resolve() of rows whose `normalised` is known; `columns` are given as they are."""
    if aliases is not None:
        keyed = keyed.join(aliases.select(F.col("original").alias("normalised"), "corrected"), "normalised", "left")
        keyed = keyed.withColumn("lookup", F.coalesce("corrected", "normalised")).drop("corrected")
    else:
        keyed = keyed.withColumn("lookup", F.col("normalised"))
    own = index.select(F.col("label_key").alias("lookup"), "concepts", F.col("kind").alias("of_kind"))
    found = keyed.join(own, "lookup", "left")
    found = found.withColumn("hits", F.when(F.col("normalised") == "", 0).otherwise(F.coalesce(F.size("concepts"), F.lit(0))))
    near = "array<struct<concept_id: string, label: string, score: double>>"
    if vectors is not None and embed is not None:
        asked = found.where("hits = 0 and normalised <> ''").select(F.col("lookup").alias("vec_id")).distinct().withColumn("embedding", embed(F.col("vec_id")))
        found = found.join(shortlists(asked, vectors, k).withColumnRenamed("vec_id", "lookup"), "lookup", "left")
    else:
        found = found.withColumn("near", F.lit(None).cast(near))
    found = found.withColumn("shortlist", F.when((F.col("hits") == 0) & (F.col("normalised") != ""), F.coalesce("near", F.expr(f"cast(array() as {near})"))).otherwise(F.expr(f"cast(array() as {near})")))
    best, second = F.get(F.col("shortlist"), F.lit(0)), F.get(F.col("shortlist"), F.lit(1))
    sure = F.coalesce((best["score"] >= clear) & (second.isNull() | (F.round(best["score"] - second["score"], 4) >= margin)), F.lit(False))
    exact = F.col("hits") == 1
    return found.select(
        *columns, "normalised", "lookup",
        F.when(exact, F.col("concepts")[0].cast("string")).when(sure, best["concept_id"]).alias("concept_id"),
        F.when(exact, "exact").when(sure, "embedding").otherwise("abstain").alias("stage"),
        F.when(exact, 1.0).otherwise(F.coalesce(best["score"], F.lit(0.0))).alias("score"),
        F.when(exact & (F.col("lookup") != F.col("normalised")), "alias").when(exact, F.col("of_kind")).alias("label_kind"),
        F.when(F.col("hits") > 1, F.transform("concepts", lambda c: c.cast("string"))).otherwise(F.array().cast("array<string>")).alias("collision"),
        "shortlist",
    )


def known_instances(mentions: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """mentions whose key is one of known: machine numbers match exactly or not at all."""
    return mentions.join(known.select(key).distinct(), key, "left_semi")


def prune_aliases(aliases: DataFrame, index: DataFrame) -> DataFrame:
    """aliases (original, corrected) without those whose original is a label, or has several words while the corrected form is a label."""
    labels = index.select(F.col("label_key").alias("original"))
    kept = aliases.join(labels, "original", "left_anti")
    several = kept.where(F.col("original").contains(" ")).join(index.select(F.col("label_key").alias("corrected")), "corrected", "left_anti")
    return kept.where(~F.col("original").contains(" ")).unionByName(several.select(*kept.columns))


def close_aliases(words: DataFrame, known: DataFrame) -> DataFrame:
    """(original, corrected) of words (word) that are within their edit budget of exactly one nearest known (word): what stands in
    for a model that corrects spelling. Candidates share what is left when up to the budget of letters is deleted."""
    a = deletions(words.select(F.col("word").alias("original")).distinct(), "original", T.edit_budget(F.col("original")))
    b = deletions(known.select(F.col("word").alias("corrected")).distinct(), "corrected", F.lit(3))
    near = a.join(b, "variant").where((b["deleted"] <= a["budget"]) & (F.col("original") != F.col("corrected"))).select("original", "corrected").distinct()
    near = near.withColumn("distance", F.levenshtein("original", "corrected")).where(F.col("distance") <= T.edit_budget(F.col("original")))
    best = near.groupBy("original").agg(F.min("distance").alias("distance"))
    return near.join(best, ["original", "distance"]).groupBy("original").agg(F.count("*").alias("n"), F.min("corrected").alias("corrected")).where("n = 1").drop("n")


def deletions(words: DataFrame, word: str, budget: Column) -> DataFrame:
    """words with budget, and a row for each `variant` that is left when `deleted` letters, up to the budget, are taken out of the word."""
    rows = words.withColumn("budget", budget).withColumn("deleted", F.lit(0)).withColumn("variant", F.col(word))
    out = rows
    for n in range(1, 4):
        rows = rows.where(f"budget >= {n} and length(variant) >= 1").withColumn("at", F.explode(F.sequence(F.lit(1), F.length("variant"))))
        rows = rows.withColumn("variant", F.concat(F.expr("substring(variant, 1, at - 1)"), F.expr("substring(variant, at + 1)"))).withColumn("deleted", F.lit(n)).drop("at").distinct()
        out = out.unionByName(rows)
    return out


def margin_verdict(ranked: DataFrame, clear: float = CLEAR, margin: float = MARGIN) -> DataFrame:
    """(vec_id, verdict): the first label if its score is clear and the second is far enough below, else `abstain`."""
    top = ranked.groupBy("vec_id").agg(F.max_by("label", -F.col("rank")).alias("label"), F.max("score").alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    sure = (F.col("best") >= clear) & (F.col("second").isNull() | (F.round(F.col("best") - F.col("second"), 4) >= margin))
    return top.select("vec_id", F.when(sure, F.col("label").cast("string")).otherwise("abstain").alias("verdict"))


def sweep_runs(questions: DataFrame, index: DataFrame, most: int = 4) -> DataFrame:
    """(id, text, runs) for each question: at each word from the left the longest phrase that is a label, whose words
    are consumed. A run is (start, size, label_key), start counted from 1."""
    # the words are a column first, so a text is split once and not for each phrase
    tokens = questions.select("id", T.question_words(F.col("text")).alias("tokens"))
    # each word is folded once, before its phrases are made: a phrase's key has the keys of its words
    folded = tokens.select("id", "tokens", F.transform("tokens", T.normalise).alias("norms")).select("id", F.explode(T.ngrams(F.col("tokens"), most)).alias("g"), "norms")
    own = F.filter(F.slice("norms", F.col("g.start"), F.col("g.size")), lambda w: w != "")
    phrases = folded.select("id", "g.start", "g.size", F.array_join(own, " ").alias("label_key"))
    hits = phrases.join(index.select("label_key"), "label_key", "left_semi")
    longest = hits.groupBy("id", "start").agg(F.max(F.struct("size", "label_key")).alias("best"))
    runs = longest.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "best.size", "best.label_key"))).alias("runs"))
    none = "cast(array() as array<struct<start: int, size: int, label_key: string>>)"
    kept = F.expr(f"""aggregate(runs, named_struct('until', 1, 'kept', {none}), (s, r) -> if(r.start >= s.until,
        named_struct('until', r.start + r.size, 'kept', array_append(s.kept, named_struct('start', r.start, 'size', r.size, 'label_key', r.label_key))), s)).kept""")
    return questions.select("id", "text").join(runs.select("id", kept.alias("runs")), "id", "left").withColumn("runs", F.coalesce("runs", F.expr(none)))


def greedy_sweep(questions: DataFrame, index: DataFrame, most: int = 4) -> DataFrame:
    """(id, terms): the labels of sweep_runs()."""
    return sweep_runs(questions, index, most).select("id", F.col("runs.label_key").alias("terms"))


#: Looks of the second pass at each question.
LOOKS = 12
_FOUND = "array<struct<start: int, size: int, phrase: string, lookup: string>>"


def _span_finder(most: int, lookups: int | None):
    """(id, tokens, starts, sizes of runs) to (id, start, size, phrase, key) of phrases that a look can fall on: none of their words is
    consumed or, at an edge, a function word or empty. With `lookups`, the looks of a question, those are left out that no look reaches,
    whatever the looks before it take: of phrases that are wholly apart and that no longer one touches, each costs a look of its own."""
    stops = frozenset(["", *FUNCTION_WORDS])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = word_folder()
        for batch in batches:
            rows, starts, sizes, phrases, keys = [], [], [], [], []
            for row, (tokens, run_starts, run_sizes) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                norms = [fold(x) for x in tokens]
                free, wide = [True] * len(norms), [False] * len(norms)
                for start, size in zip(run_starts, run_sizes, strict=True):
                    free[start - 1 : start - 1 + size] = [False] * size
                room = [0] * (len(norms) + 1)  # unconsumed words from here on
                for i in range(len(norms) - 1, -1, -1):
                    room[i] = room[i + 1] + 1 if free[i] else 0
                edge = [x not in stops for x in norms]
                spent = 0
                for size in range(most, 0, -1):
                    apart, here = 0, []
                    for i in range(len(norms) - size + 1):
                        if room[i] < size or not edge[i] or not edge[i + size - 1]:
                            continue
                        if lookups is not None and spent >= lookups:
                            break
                        if i >= apart and not any(wide[i : i + size]):
                            spent, apart = spent + 1, i + size
                        here.append(i)
                        rows.append(row)
                        starts.append(i + 1)
                        sizes.append(size)
                        phrases.append(" ".join(tokens[i : i + size]))
                        keys.append(" ".join(x for x in norms[i : i + size] if x))
                    if lookups is not None and spent >= lookups:
                        break
                    for i in here:
                        wide[i : i + size] = [True] * size
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.string()), pa.array(keys, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "size", "phrase", "key"])

    return find


def _spans(swept: DataFrame, most: int, aliases: DataFrame | None, lookups: int) -> DataFrame:
    """(id, start, size, phrase, said, lookup) of the phrases of swept (id, text, runs) that one of `lookups` looks can fall on; said is an
    alias. Aliases are looked at first, so with them no phrase is left out for its place."""
    given = swept.select("id", T.question_words(F.col("text")).alias("tokens"), F.col("runs.start").alias("starts"), F.col("runs.size").alias("sizes"))
    kind = given.schema["id"].dataType.simpleString()
    shaped = given.mapInArrow(_span_finder(most, lookups if aliases is None else None), f"id {kind}, start int, size int, phrase string, key string")
    if aliases is not None:
        shaped = shaped.join(aliases.select(F.col("original").alias("key"), F.col("corrected").alias("said")), "key", "left")
    else:
        shaped = shaped.withColumn("said", F.lit(None).cast("string"))
    return shaped.select("id", "start", "size", "phrase", "said", F.coalesce("said", "key").alias("lookup"))


def _looker(lookups: int):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, starts, sizes of runs, spans in the order of the looks) to (id, found)."""
        for batch in batches:
            spans = batch.column(3)
            ends, inner = spans.offsets.to_numpy(), spans.values
            starts, sizes, takes = (inner.field(x).to_pylist() for x in ("start", "size", "takes"))
            at, bounds = [], [0]
            for row, (run_starts, run_sizes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                used, seen = 0, 0
                for start, size in zip(run_starts, run_sizes, strict=True):
                    used |= ((1 << size) - 1) << start
                for i in range(ends[row], ends[row + 1]):
                    words = ((1 << sizes[i]) - 1) << starts[i]
                    if used & words:
                        continue
                    if seen >= lookups:
                        break
                    seen += 1
                    if takes[i]:
                        used |= words
                        at.append(i)
                bounds.append(len(at))
            names = ["start", "size", "phrase", "lookup"]
            taken = pa.StructArray.from_arrays([inner.field(x).take(pa.array(at, pa.int64())) for x in names], names=names)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.array(bounds, np.int32), taken)], names=["id", "found"])

    return look


def _looked(swept: DataFrame, spans: DataFrame, lookups: int) -> DataFrame:
    """(id, found) of swept (id, runs) and spans with `takes`: in the order of the looks a span none of whose words is consumed is looked
    at, `lookups` for each question, and consumes its words if it takes them. Aliases go first, then the longest, then the leftmost."""
    rank = F.struct(F.col("said").isNull().alias("plain"), (-F.col("size")).alias("less"), "start", "size", "phrase", "lookup", "takes")
    runs = swept.select("id", F.col("runs.start").alias("starts"), F.col("runs.size").alias("sizes"))
    ordered = runs.join(spans.groupBy("id").agg(F.array_sort(F.collect_list(rank)).alias("spans")), "id").select("id", "starts", "sizes", "spans")
    return ordered.mapInArrow(_looker(lookups), f"id {ordered.schema['id'].dataType.simpleString()}, found {_FOUND}")


def residual_sweep(swept: DataFrame, most: int = 4, lookups: int = LOOKS, aliases: DataFrame | None = None) -> DataFrame:
    """(id, misses) of swept (id, text, runs): phrases of unconsumed words that are worth reporting, in the order of the looks; one
    that is worth reporting, by its alias if it has one, consumes its words. Nothing is resolved: see second_pass()."""
    spans = _spans(swept, most, aliases, lookups).withColumn("takes", T.worth_reporting(F.coalesce("said", "phrase")))
    found = _looked(swept, spans, lookups).select("id", F.col("found.phrase").alias("misses"))
    return swept.select("id").join(found, "id", "left").withColumn("misses", F.coalesce("misses", F.array().cast("array<string>")))


def second_pass(swept: DataFrame, index: DataFrame, vectors: DataFrame, embed: Callable[[Column], Column], aliases: DataFrame | None = None, most: int = 4, lookups: int = LOOKS,
                floor: float = 0.0, clear: float = CLEAR, margin: float = MARGIN, k: int = SHORTLIST) -> DataFrame:
    """(id, place, start, size, phrase, lookup, concept_id, stage, score, shortlist) of what swept (id, text, runs) left over.

    Every phrase that any question could look at goes through the cascade once, whatever the number of questions with it; then each
    question takes its looks in order. One that the cascade matched, or that is worth reporting, consumes its words; with a `floor`
    the best of the shortlist must reach it to be reported.
    """
    spans = stage(_spans(swept, most, aliases, lookups), "spans")
    asked = spans.select(F.col("lookup").alias("normalised")).distinct()  # made of the keys of words, so it is one
    known = _cascade(asked, [], index, vectors, None, embed, clear, margin, k).select("lookup", "concept_id", "stage", "score", "shortlist")
    known = stage(known, "looked-up")
    top = F.get(F.col("shortlist"), F.lit(0))["score"]
    worth = T.names_something(F.col("lookup")) & F.coalesce(top >= floor, F.lit(False)) if floor else T.names_something(F.col("lookup"))
    takes = F.col("concept_id").isNotNull() | worth
    judged = spans.join(known.select("lookup", takes.alias("takes")), "lookup")
    found = _looked(swept, judged, lookups).select("id", F.posexplode("found").alias("place", "f")).select("id", "place", "f.*")
    return found.join(known, "lookup").select("id", "place", "start", "size", "phrase", "lookup", "concept_id", "stage", "score", "shortlist")


def correction_map(pairs: DataFrame) -> DataFrame:
    """(original, corrected) of pairs that repair: not the same when normalised, not empty, no rewrite, and one reading only."""
    a, b = T.normalise(F.col("original")), T.normalise(F.col("corrected"))
    good = pairs.where((a != "") & (b != "") & (a != b) & ~T.is_rewrite(F.col("original"), F.col("corrected"))).select(a.alias("original"), b.alias("corrected"))
    return good.groupBy("original").agg(F.countDistinct("corrected").alias("n"), F.min("corrected").alias("corrected")).where("n = 1").drop("n")
