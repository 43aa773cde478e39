"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. Three letters in a row are bound into one vector: the first shifted
twice, the second once, multiplied. A text bundles the vectors of its letter triples, a language those of its texts;
the language whose vector has the largest cosine with a text's is predicted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlake.llm.common import lean, rows_of, ship

ship(__name__)

DIM = 512
SEED = 20
#: Letters with the same code point modulo 1023 share a vector; 0 stands for what is between words.
LETTERS = 1024
UNKNOWN = "und"
#: Texts whose triples are bundled at a time.
TOGETHER = 128


@functools.cache
def _letter_codes() -> np.ndarray:
    return np.array([1 + cp % (LETTERS - 1) if chr(cp).isalpha() else 0 for cp in range(0x10000)], np.uint16)


@functools.cache
def _vectors(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (LETTERS, dim))
    return np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters


def bound(triples: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of triples."""
    first, second, third = _vectors(dim)
    return first[triples >> 20] * second[triples >> 10 & 1023] * third[triples & 1023]


def triples_of(text: str, codes: np.ndarray) -> np.ndarray:
    """Letter triples of the lowered text, runs of other characters being one 0; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if points.max(initial=0) > 0xFFFF:
        letters = np.array([1 + p % (LETTERS - 1) if chr(p).isalpha() else 0 for p in points.tolist()], np.uint16)
    else:
        letters = codes[points]
    padded = np.concatenate([[0], letters, [0]]).astype(np.uint32)
    padded = padded[np.concatenate([[True], (padded[1:] | padded[:-1]) > 0])]
    if len(padded) < 3:
        return np.zeros(0, np.uint32)
    return padded[:-2] << np.uint32(20) | padded[1:-1] << np.uint32(10) | padded[2:]


def _learn(dim: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bundle for each language of a task: its triples are counted first, then bound once each."""
        codes, waiting, held = _letter_codes(), {}, {}

        def merge(lang: str) -> None:
            triples, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            total = held.get(lang, np.zeros(dim))
            for at in range(0, len(triples), 4096):
                total = total + n[at : at + 4096].astype(np.float32) @ bound(triples[at : at + 4096], dim).astype(np.float32)
            held[lang] = total

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                waiting.setdefault(lang, []).append(triples_of(text.as_py(), codes))
                if sum(map(len, waiting[lang][-1:])) > 1_000_000 or len(waiting[lang]) >= 500:
                    merge(lang)
        for lang in list(waiting):
            merge(lang)
        for lang, total in held.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "bundle": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return learn


def learn_profiles(texts: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """The vector of each language of texts (text, lang), rows with a null apart. One row a language and task is shuffled."""
    known = rows_of(texts, text=F.col("text"), lang=F.col("lang")).where("text is not null and lang is not null")
    parts = known.mapInArrow(lean(_learn(dim)), "lang string, bundle array<double>")
    places = parts.select("lang", F.posexplode("bundle").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for row in places.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("bundle")).collect():
        out[row["lang"]] = np.array(row["bundle"])
    return out


def _predict(profiles: dict[str, np.ndarray], dim: int, at: int, names: list[str]):
    langs = sorted(profiles)
    table = np.stack([profiles[x] / max(np.linalg.norm(profiles[x]), 1e-12) for x in langs], axis=1).astype(np.float32) if langs else np.zeros((dim, 0), np.float32)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _letter_codes()
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                counted = [np.unique(triples_of(x.as_py() or "", codes), return_counts=True) for x in batch.column(at)]
                known, where = np.unique(np.concatenate([x for x, _ in counted]), return_inverse=True)
                sums = np.zeros((len(counted), dim), np.float32)
                row_of = np.repeat(np.arange(len(counted)), [len(x) for x, _ in counted])
                counts = np.concatenate([n for _, n in counted]).astype(np.float32)
                for a in range(0, len(known), 8192):  # bounds the dense tables
                    own = (where >= a) & (where < a + 8192)
                    dense = np.zeros((len(counted), min(8192, len(known) - a)), np.float32)
                    dense[row_of[own], where[own] - a] = counts[own]
                    sums += dense @ bound(known[a : a + 8192], dim).astype(np.float32)
                cosines = sums @ table / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
                empty = np.array([len(x) == 0 for x, _ in counted])
                best = cosines.argmax(axis=1) if langs else np.zeros(len(counted), np.int64)
                predicted = [UNKNOWN if e or not langs else langs[b] for e, b in zip(empty, best, strict=True)]
                score = [0.0 if e or not langs else float(min(max(row[b], 0.0), 1.0)) for e, b, row in zip(empty, best, cosines, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predicted, pa.string()), pa.array(score, pa.float64())], names=names)

    return predict


def identify(rows: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", dim: int = DIM, added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """rows with lang_pred and score, the cosine (negative ones as 0); `added` gives these columns other names.

    `und` and 0 where the text is null or has no letter, or no language was learned. Ties go to the first language in order.
    Texts of any length are bundled whole, a part of their triples at a time. Repeated rows and repeated ids are rows of their own.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField(added[0], StringType()), StructField(added[1], DoubleType())])
    return rows.mapInArrow(lean(_predict(profiles, dim, rows.columns.index(text), schema.names)), schema)


def identify_documents(docs: DataFrame, learn_from: Column) -> DataFrame:
    """doc_id, text, lang_pred, score for each row of docs, learned from text and lang of the rows that learn_from marks.

    An empty table gives an empty result. A document that is empty or in no known language is still one row.
    """
    rows = rows_of(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    return identify(rows, learn_profiles(docs.where(learn_from)))
