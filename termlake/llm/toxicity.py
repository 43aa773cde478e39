"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words of a text and their beginnings. Besides the labels, it is trained on pairs of
sentences that differ only in the group they mention: any change of the score between the two is penalised, so the
mention of a group alone moves no text towards the toxic label.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlake.llm.common import rows_of, ship, stage_table

ship(__name__)

#: Labelled rows that are learned from at most, and bytes of their texts: the first in order of a hash of the id.
SAMPLE_ROWS = 8000
SAMPLE_BYTES = 64_000_000
#: A feature is kept if it occurs in so many sampled texts and its likelihood ratio is at least so large.
LEAST_TEXTS = 3
LEAST_RATIO = 12.0
#: Weight of the penalty on score changes, of the squares of the weights, and steps of training.
GAMMA = 1.0
DECAY = 1e-3
STEPS = 400
#: Words that a worker remembers.
CACHE = 500_000

#: Terms that name groups, in lists of interchangeable ones.
IDENTITIES = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("women", "men"),
    ("woman", "man"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf"),
    ("musulman", "chrétien", "juif", "hindou"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
#: For each shift the term that stands so many places further in its list; lists are rings.
_SHIFTS = [{term: group[(i + shift) % len(group)] for group in IDENTITIES for i, term in enumerate(group)} for shift in range(1, max(map(len, IDENTITIES)))]
_TERMS = _SHIFTS[0].keys()
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features_of_word(word: str) -> list[str]:
    """A lowered word, and its first four and five letters if there are more."""
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


def features(text: str) -> set[str]:
    return {f for word in set(_LETTERS.findall(text.lower())) for f in features_of_word(word)}


def counterfactuals(text: str) -> Iterator[tuple[set[str], set[str]]]:
    """Features of each sentence that names a group, before and after every such term becomes another one of its list; each shift
    along the lists that changes the sentence is one pair, so all terms of a list are tried."""
    lowered = text.lower()
    if _TERMS.isdisjoint(_LETTERS.findall(lowered)):
        return
    for sentence in _SENTENCE.findall(lowered):
        words = _LETTERS.findall(sentence)
        if not _TERMS.isdisjoint(words):
            own, tried = features(sentence), {tuple(words)}
            for shift in _SHIFTS:
                swapped = tuple(shift.get(word, word) for word in words)
                if swapped not in tried:
                    tried.add(swapped)
                    yield own, features(" ".join(swapped))


def _ratio(a: int, b: int, toxic: int, clean: int) -> float:
    """Log-likelihood ratio of a feature in a of toxic and b of clean texts."""
    h = lambda k, n: sum(x * math.log(x / n) for x in (k, n - k) if x)
    return 2 * (h(a, toxic) + h(b, clean) - h(a + b, toxic + clean)) if toxic and clean else 0.0


class Model:
    """weights by feature, and a bias."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> float:
        return _sigmoid(self.bias + sum(self.weights.get(f, 0.0) for f in features(text)))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def _share(toxic: int, clean: int) -> Model:
    """Without both labels: the share of label 1 for every text, 0.5 without any."""
    share = (toxic + 0.5) / (toxic + clean + 1)
    return Model({}, math.log(share / (1 - share)))


def _kept(often: Iterable[tuple[str, int]]) -> dict[str, int]:
    """Places of features (feature, number of toxic texts), those of toxic texts first, and of all that terms for groups have."""
    found = sorted(often, key=lambda x: (x[1] == 0, x[0]))
    names = [f for f, _ in found]
    names += sorted(f for term in _TERMS for f in features_of_word(term))
    return {f: i for i, f in enumerate(dict.fromkeys(names))}


def train(labelled: list[tuple[str, int]], gamma: float = GAMMA, decay: float = DECAY, steps: int = STEPS) -> Model:
    """A model of (text, label) pairs in memory."""
    toxic = sum(label for _, label in labelled)
    clean = len(labelled) - toxic
    if not toxic or not clean:
        return _share(toxic, clean)
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in labelled:
        counts[label].update(features(text))
    both = counts[0].keys() | counts[1].keys()
    place = _kept((f, counts[1][f]) for f in both if counts[0][f] + counts[1][f] >= LEAST_TEXTS and _ratio(counts[1][f], counts[0][f], toxic, clean) >= LEAST_RATIO)
    return fit([(label, *encoded(text, place)) for text, label in labelled], place, gamma, decay, steps)


def encoded(text: str, place: dict[str, int]) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """Places of the text's kept features, and for each counterfactual pair of those that it loses and gains."""
    own = sorted(place[f] for f in features(text) if f in place)
    pairs = list(counterfactuals(text))
    lost = [sorted(place[f] for f in a - b if f in place) for a, b in pairs]
    return own, lost, [sorted(place[f] for f in b - a if f in place) for a, b in pairs]


def fit(rows: list[tuple[int, list[int], list[list[int]], list[list[int]]]], place: dict[str, int], gamma: float = GAMMA, decay: float = DECAY, steps: int = STEPS) -> Model:
    """Weights by gradient steps on the log loss, the squares of weights, and the squares of score changes between counterfactuals.
    rows: label and what encoded() gives."""

    def matrix(lists: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of each entry."""
        at_row, at_column = array("q"), array("q")
        for row, some in enumerate(lists):
            at_row.extend([row] * len(some))
            at_column.extend(some)
        return np.array(at_row, np.int64), np.array(at_column, np.int64)

    label = np.array([r[0] for r in rows], np.float64)
    at, columns = matrix(r[1] for r in rows)
    plus, minus = matrix(x for r in rows for x in r[2]), matrix(x for r in rows for x in r[3])
    pairs = sum(len(r[2]) for r in rows)
    weights, bias = np.zeros(len(place)), math.log(label.sum() / (len(label) - label.sum()))
    m, v = np.zeros(len(place) + 1), np.zeros(len(place) + 1)
    for step in range(1, steps + 1):
        logits = np.bincount(at, weights[columns], len(label)) + bias
        error = (1 / (1 + np.exp(-np.clip(logits, -50, 50))) - label) / len(label)
        slope = np.bincount(columns, error[at], len(place)) + decay * weights / len(place)
        if pairs:
            change = np.bincount(plus[0], weights[plus[1]], pairs) - np.bincount(minus[0], weights[minus[1]], pairs)
            scaled = 2 * gamma * change / pairs
            slope += np.bincount(plus[1], scaled[plus[0]], len(place)) - np.bincount(minus[1], scaled[minus[0]], len(place))
        whole = np.append(slope, error.sum())
        m, v = 0.9 * m + 0.1 * whole, 0.999 * v + 0.001 * whole**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model({f: float(weights[i]) for f, i in place.items() if weights[i]}, float(bias))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = sorted(features(text.as_py() or ""))
            yield pa.RecordBatch.from_pydict({"feature": found, "toxic": pa.array([label] * len(found), pa.int32())}, pa.schema([("feature", pa.string()), ("toxic", pa.int32())]))


def _encode(place: dict[str, int]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            rows = [encoded(text.as_py() or "", place) for text in batch.column(0)]
            own, lost, gained = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(lost, lists), pa.array(gained, lists)], names=["toxic", "own", "lost", "gained"])

    return encode


def learn(sampled: DataFrame, gamma: float = GAMMA) -> Model:
    """A model of sampled (text, toxic). Tasks count features and encode texts; the driver gets the kept features, and of each text
    the places of those, never a text."""
    toxic, clean = sampled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not toxic or not clean:
        return _share(toxic, clean)
    counts = sampled.mapInArrow(_features, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    h = lambda k, n: F.when((k > 0) & (k < n), k * F.log(k / n) + (n - k) * F.log((n - k) / n)).otherwise(0.0)
    ratio = 2 * (h(F.col("a"), F.lit(toxic)) + h(F.col("b"), F.lit(clean)) - h(F.col("a") + F.col("b"), F.lit(toxic + clean)))
    often = counts.where((F.col("a") + F.col("b") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO)).select("feature", "a").collect()
    place = _kept((x["feature"], x["a"]) for x in often)
    rows = sampled.mapInArrow(_encode(place), "toxic int, own array<int>, lost array<array<int>>, gained array<array<int>>").collect()
    return fit(sorted((x["toxic"], list(x["own"]), [list(y) for y in x["lost"]], [list(y) for y in x["gained"]]) for x in rows), place, gamma)


def sample(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """sampled() in memory."""
    return [(x["text"], x["toxic"]) for x in sampled(docs, labels, learn_from, rows, size).orderBy("text").collect()]


def sampled(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """(text, toxic): up to `rows` labelled texts, up to `size` bytes of them, in order of a hash of doc_id; texts that do not fit
    what is left are passed over. Of several labels of an id the largest counts. Texts of equal id and length go together."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(learn_from)
    known = rows_of(docs, doc_id=F.col("doc_id"), bytes=F.coalesce(F.octet_length("text"), F.lit(0))).join(marked, "doc_id")
    known = stage_table(known.groupBy("doc_id", "toxic", "bytes").agg(F.count("*").alias("n")).withColumn("hash", F.md5(F.col("doc_id").cast("string"))), "toxic-known")
    place = F.struct("hash", F.col("doc_id").cast("long").alias("doc_id"), F.col("bytes").cast("long").alias("bytes"))
    taken: list[tuple[int, int, int]] = []
    after = F.lit(True)
    while rows > 0:
        some = known.where(after & (F.col("n") <= rows) & (F.col("n") * F.col("bytes") <= size)).orderBy("hash", "doc_id", "bytes").limit(asked := rows).collect()
        for x in some:
            if x["n"] <= rows and x["n"] * x["bytes"] <= size:
                taken.append((x["doc_id"], x["toxic"], x["bytes"]))
                rows, size = rows - x["n"], size - x["n"] * x["bytes"]
        if len(some) < asked:
            break
        last = some[-1]
        after = place > F.struct(F.lit(last["hash"]).alias("hash"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["bytes"]).cast("long").alias("bytes"))
    ids = docs.sparkSession.createDataFrame(taken, "doc_id bigint, toxic int, bytes int")
    texts = rows_of(docs, doc_id=F.col("doc_id"), text=F.coalesce("text", F.lit(""))).withColumn("bytes", F.octet_length("text"))
    return stage_table(texts.join(F.broadcast(ids), ["doc_id", "bytes"]).select("text", "toxic"), "toxic-sample")


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for each row of docs (doc_id, text); null and empty texts have the score of no features."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = set((text.as_py() or "").lower().split())
                if len(known) > CACHE:
                    known = {}
                for word in words.difference(known):
                    known[word] = tuple({f for part in _LETTERS.findall(word) for f in features_of_word(part) if f in model.weights})
                hits = set().union(*map(known.__getitem__, words))
                out.append(_sigmoid(model.bias + sum(model.weights[f] for f in sorted(hits))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return rows_of(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text")).mapInArrow(score, "doc_id bigint, score double")


def score_documents(docs: DataFrame, labels: DataFrame, learn_from: Column) -> DataFrame:
    """doc_id, score for each row of docs; the model is trained on a bounded sample of the labelled rows that learn_from marks. Texts
    of any length are scored whole; repeated rows and ids are rows of their own; columns but doc_id and text stay behind; an
    empty table gives an empty result, and without labels every score is 0.5."""
    return score_texts(docs, learn(sampled(docs, labels, learn_from)))
