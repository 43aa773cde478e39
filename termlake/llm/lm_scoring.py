"""Scoring by a deleted-interpolation language model of words.

The probability of a word after another mixes three estimates: relative frequency of the pair, relative frequency of
the word, and an equal share for every known word and one more. The weights depend on how often the context was seen and are
learned by expectation-maximisation on deleted counts: each training occurrence is predicted from all the others.

Counting goes by blocks. A block sends its distinct words and pairs, as hashes in order with its own training counts, to
the tasks of their hash ranges and gets back the counts of the whole corpus, in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlake.llm import blocks as B
from termlake.llm.common import bucketed_table, rows_of, ship, stage_table

ship(__name__)

#: Tokens, about, whose words and pairs one hash range holds.
PART_TOKENS = 2_000_000
#: Bits of a hash beyond the logarithm of the number of tokens: a chance of 2**-24 that a key meets another.
SPARE_BITS = 24
EM_STEPS = 60
#: Contexts by the logarithm of their frequency; 0: never seen.
BUCKETS = 64
#: Bins of an estimate per factor of two, for the weights only.
FINE = 4
END = b""

BLOCKS = "block string, ids array<bigint>, flags array<boolean>, lengths binary, codes binary, keys binary, n_tokens bigint, n_train bigint"
COUNTED = pa.schema([("block", pa.string()), ("part", pa.int32()), ("distinct", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary())])
RESOLVED = "ids array<bigint>, flags array<boolean>, lengths binary, word_counts binary, pair_counts binary, distinct bigint, bins binary, bin_counts binary"


def split_tokens(text: str) -> list[bytes]:
    """Words of the text, A-Z lowered, then one end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from uuid import uuid4

    for x in B.build(batches, split_tokens):
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, x["units"]), dtype="<u8", count=len(x["units"]))
        train = int(x["lengths"][~np.array(x["flags"], bool)].sum())
        yield pa.RecordBatch.from_pydict({"block": [uuid4().hex], "ids": pa.array([x["ids"]], pa.list_(pa.int64())), "flags": pa.array([x["flags"]], pa.list_(pa.bool_())), "lengths": [B.pack_ints(x["lengths"])], "codes": [B.pack_ints(x["codes"])], "keys": [keys.tobytes()], "n_tokens": [len(x["codes"])], "n_train": [train]})


class _Sent:
    """A block's distinct words and pairs in the order in which they are sent: by hash, cut to `bits` bits."""

    def __init__(self, row: dict, bits: int) -> None:
        self.codes, lengths = B.unpack_ints(row["codes"]), B.unpack_ints(row["lengths"]).astype(np.int64)
        keys, shift = np.frombuffer(row["keys"], "<u8"), np.uint64(64 - bits)
        self.lengths = lengths
        self.train = np.repeat(~np.array(row["flags"], bool), lengths)
        self.word_order = np.argsort(keys, kind="stable")
        self.word_keys = keys[self.word_order] >> shift
        end = self.codes[-1]  # every document ends with it, and what ends one stands before the next
        before = np.concatenate([[end], self.codes[:-1]])
        local = before.astype(np.uint64) * np.uint64(len(keys)) + self.codes.astype(np.uint64)
        pairs, self.pair_of = np.unique(local, return_inverse=True)
        first, second = pairs // np.uint64(len(keys)), pairs % np.uint64(len(keys))
        hashed = _mixed(keys[first.astype(np.int64)] * np.uint64(0x9E3779B97F4A7C15) + keys[second.astype(np.int64)])
        self.pair_order = np.argsort(hashed, kind="stable")
        self.pair_keys = hashed[self.pair_order] >> shift

    def train_counts(self) -> tuple[np.ndarray, np.ndarray]:
        words = np.bincount(self.codes[self.train], minlength=len(self.word_order))[self.word_order]
        return words, np.bincount(self.pair_of[self.train], minlength=len(self.pair_order))[self.pair_order]


COLUMNS = ["block", "ids", "flags", "lengths", "codes", "keys"]


def _edges(keys: np.ndarray, parts: int, bits: int) -> list[int]:
    return np.searchsorted(keys, np.array([(p << bits) // parts for p in range(parts)], dtype=np.uint64)).tolist() + [len(keys)]


def _send(parts: int, bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                sent = _Sent(row, bits)
                word_counts, pair_counts = sent.train_counts()
                a, b = _edges(sent.word_keys, parts, bits), _edges(sent.pair_keys, parts, bits)
                for p in range(parts):
                    if a[p] < a[p + 1] or b[p] < b[p + 1]:
                        w, q = slice(a[p], a[p + 1]), slice(b[p], b[p + 1])
                        yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "block": [row["block"]], "words": [B.pack_sorted(sent.word_keys[w])], "word_counts": [B.pack_ints(word_counts[w])], "pairs": [B.pack_sorted(sent.pair_keys[q])], "pair_counts": [B.pack_ints(pair_counts[q])]})

    return send


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """For each list of keys the sums of counts over all lists; the number of keys with a sum."""
    if not keys:
        return [], 0
    known, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate(counts), minlength=len(known))
    ends = np.cumsum([len(x) for x in keys])[:-1]
    return np.split(sums[at].astype(np.uint32), ends), int((sums > 0).sum())


def _count(table: pa.Table) -> pa.Table:
    column = lambda name, of: [of(x.as_py()) for x in table.column(name)]
    words, distinct = _totals(column("words", B.unpack_sorted), column("word_counts", B.unpack_ints))
    pairs, _ = _totals(column("pairs", B.unpack_sorted), column("pair_counts", B.unpack_ints))
    out = {"block": table.column("block").to_pylist(), "part": table.column("part").to_pylist(), "distinct": [distinct] + [0] * (table.num_rows - 1)}
    return pa.table(out | {"words": [B.pack_ints(x) for x in words], "pairs": [B.pack_ints(x) for x in pairs]}, COUNTED)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def _bin(estimate: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 and the negative binary logarithm in quarters."""
    return np.where(estimate > 0, np.minimum(1 + np.floor(-FINE * np.log2(np.where(estimate > 0, estimate, 1))), 255), 0).astype(np.int64)


def _resolve(n_train: int, bits: int):
    def resolve(block: pa.Table, counted: pa.Table) -> pa.Table:
        counted = counted.sort_by("part")
        out: dict[str, list] = {name: [] for name in ("ids", "flags", "lengths", "word_counts", "pair_counts", "distinct", "bins", "bin_counts")}
        for row in block.to_pylist():
            sent = _Sent(row, bits)
            by_word, by_pair = np.zeros(len(sent.word_order), np.uint32), np.zeros(len(sent.pair_order), np.uint32)
            by_word[sent.word_order] = np.concatenate([B.unpack_ints(x.as_py()) for x in counted.column("words")])
            by_pair[sent.pair_order] = np.concatenate([B.unpack_ints(x.as_py()) for x in counted.column("pairs")])
            word, pair = by_word[sent.codes], by_pair[sent.pair_of]
            context = np.concatenate([[word[-1]], word[:-1]])
            # each training occurrence deleted: what the others say of it
            w, q, c = (x[sent.train].astype(np.float64) - 1 for x in (word, pair, context))
            code = (_bucket(c) * 256 + _bin(np.divide(q, c, out=np.zeros_like(q), where=c > 0))) * 256 + _bin(w / max(n_train - 1, 1))
            bins, counts = np.unique(code, return_counts=True)
            for name, value in (("ids", row["ids"]), ("flags", row["flags"]), ("lengths", row["lengths"]), ("word_counts", B.pack_ints(word)), ("pair_counts", B.pack_ints(pair)), ("distinct", sum(counted.column("distinct").to_pylist())), ("bins", B.pack_sorted(bins.astype(np.uint64))), ("bin_counts", B.pack_ints(counts))):
                out[name].append(value)
        kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table(out, pa.schema(list(zip(out, kinds, strict=True))))

    return resolve


def _bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bins, counts in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.RecordBatch.from_pydict({"bin": B.unpack_sorted(bins.as_py()).astype(np.int64), "n": B.unpack_ints(counts.as_py()).astype(np.int64)})


def learn_weights(bins: np.ndarray, counts: np.ndarray, distinct: int, steps: int = EM_STEPS) -> np.ndarray:
    """(BUCKETS, 3) mixture weights of pair, word and equal share from binned deleted estimates, bucket by bucket.

    Buckets without occurrences take the weights of the nearest one below that has some; without any, all weight is
    on words and the equal share. A context never seen gives its pair estimate no weight.
    """
    weights = np.tile(np.array([0.0, 0.9, 0.1]), (BUCKETS, 1))
    middle = lambda b: np.where(b > 0, 2.0 ** (-(b - 0.5) / FINE), 0.0)
    for bucket in range(BUCKETS):
        own = bins // 65536 == bucket
        if not own.any():
            if bucket > 1:
                weights[bucket] = weights[bucket - 1]
            continue
        p = np.stack([middle(bins[own] // 256 % 256), middle(bins[own] % 256), np.full(int(own.sum()), 1 / (distinct + 1))], axis=1)
        n, mix = counts[own].astype(np.float64), np.array([0.4 * (bucket > 0), 0.4, 0.2])
        for _ in range(steps):
            share = p * mix
            mix = (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0)
            mix /= mix.sum()
        mix = np.maximum(mix, 1e-6 * np.array([bucket > 0, 1, 1]))
        weights[bucket] = mix / mix.sum()
    return weights


def _score(weights: np.ndarray, n_train: int, distinct: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                lengths = B.unpack_ints(row["lengths"]).astype(np.int64)
                word, pair = (B.unpack_ints(row[k]).astype(np.float64) for k in ("word_counts", "pair_counts"))
                context = np.concatenate([word[-1:], word[:-1]])
                mix = weights[_bucket(context)]
                p = mix[:, 0] * np.divide(pair, context, out=np.zeros_like(pair), where=context > 0) + mix[:, 1] * word / max(n_train, 1) + mix[:, 2] / (distinct + 1)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                base = np.log10((word + 1) / (n_train + (distinct + 1)))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["flags"], pa.bool_()), "n_tokens": lengths, "n_known": np.add.reduceat((word > 0).astype(np.int64), starts), "train_tokens": np.full(len(lengths), n_train), "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts)})

    return score


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    The model learns from the rows that are not held out. base_score has add-one estimates of single words; score is
    the log10 probability of the mixture. Null and empty texts are one end token. The word before a document is the end of
    another. Texts of any length are scored whole; repeated rows and ids are rows of their own; columns but doc_id, text and those of
    held_out stay behind. An empty table gives an empty result; with no training rows every token gets the same probability.
    """
    rows = rows_of(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text"), flag=held_out)
    blocks = bucketed_table(rows.mapInArrow(_to_blocks, BLOCKS), "lm_blocks", "block")
    n_tokens, n_train = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    parts, bits = n_tokens // PART_TOKENS + 1, min(63, max(n_tokens, 1).bit_length() + SPARE_BITS)
    sent = blocks.select(*COLUMNS).mapInArrow(_send(parts, bits), "part int, block string, words binary, word_counts binary, pairs binary, pair_counts binary")
    counted = sent.groupBy("part").applyInArrow(_count, "block string, part int, distinct bigint, words binary, pairs binary")
    resolved = stage_table(blocks.select(*COLUMNS).groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_resolve(n_train, bits), RESOLVED), "lm-resolved")
    distinct = resolved.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    # at most BUCKETS * 256 * 256 rows, of which few thousand occur
    found = resolved.select("bins", "bin_counts").mapInArrow(_bin_rows, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    weights = learn_weights(np.array([x["bin"] for x in found], np.int64), np.array([x["n"] for x in found], np.int64), distinct)
    return resolved.select("ids", "flags", "lengths", "word_counts", "pair_counts").mapInArrow(_score(weights, n_train, distinct), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
