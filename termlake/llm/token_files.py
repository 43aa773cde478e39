"""Token files: one concatenated array of ids a segment, document boundaries in Elias-Fano code.

A segment is a file: magic, counts, the ids of its documents (2 or 4 bytes each), the ends of the documents and their
doc_ids, both as Elias-Fano sequences with the place of every SAMPLE-th one bit, from which select starts. Nothing is
rebuilt when a file is read, and no table of 64-bit offsets exists in the file or in memory. A manifest, written last as
a Spark table, names the segments that count; segments of failed attempts are never in it.
"""

from __future__ import annotations

import json
import operator
import string
import struct
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import compress, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlake.llm.common import lean, rows_of, scratch_path, ship, stage_table

ship(__name__)

MAGIC = b"TLTOKEN2"
#: Ids of a segment, about; a longer document is a segment of its own.
SEGMENT_IDS = 8_000_000
#: Every so many-th one bit of a high part has its place stored: an eighth of a bit for each value.
SAMPLE = 256
#: Documents that are read at a time.
TOGETHER = 512
#: Words that a worker remembers.
CACHE = 900_000


class EliasFano:
    """A non-decreasing sequence of integers: low bits apart, high parts in unary, and places of some ones to select from."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        # so many values at a time end at a byte
        parts = [np.packbits(((values[a : a + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little") for a in range(0, n, 65536)] if low_bits else []
        ones = np.zeros((top >> low_bits) + n, np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        ones[places] = 1
        low = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return cls(n, low_bits, low, np.packbits(ones, bitorder="little"), places[::SAMPLE].astype("<u4" if len(ones) < 1 << 32 else "<u8"))

    def select(self, i: int) -> int:
        """The i-th value: the place of the i-th one in the high part, less i, and its low bits."""
        return int(self.range(i, i + 1)[0])

    def range(self, a: int, b: int) -> np.ndarray:
        """The values from the a-th to before the b-th, unsigned 64-bit, by select of both ends: only their part is decoded."""
        if not 0 <= a < b <= self.n:
            if a == b:
                return np.zeros(0, np.uint64)
            raise IndexError((a, b))
        first, after = a // SAMPLE, (b - 1) // SAMPLE + 1
        begin = int(self.samples[first])
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : (end + 7) // 8], bitorder="little")[begin % 8 :]
        places = np.flatnonzero(bits)[a - first * SAMPLE : b - first * SAMPLE] + begin
        high = places.astype(np.uint64) - np.arange(a, b, dtype=np.uint64)
        if not self.low_bits:
            return high
        begin = a * self.low_bits
        raw = np.unpackbits(self.low[begin // 8 : (b * self.low_bits + 7) // 8], bitorder="little")[begin % 8 :]
        low = raw[: (b - a) * self.low_bits].reshape(b - a, self.low_bits).astype(np.uint64)
        return high << np.uint64(self.low_bits) | (low << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def dump(self) -> bytes:
        head = struct.pack("<QBBQQQ", self.n, self.low_bits, self.samples.itemsize, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        """Views of `data`; no table is built."""
        n, low_bits, wide, a, b, c = struct.unpack_from("<QBBQQQ", data)
        at = 34
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, f"<u{wide}", c, at + a + b))


def write_segment(doc_ids: list[int | None], ends: np.ndarray, ids: bytes, width: int) -> bytes:
    """The bytes of a segment; ends are the numbers of ids up to the end of each document. doc_ids ascend, nulls first."""
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    coded, names = EliasFano.of(ends).dump(), EliasFano.of(known.astype(np.uint64) - np.uint64(least % (1 << 64))).dump()
    return MAGIC + struct.pack("<BQQqQQ", width, len(doc_ids), len(doc_ids) - len(known), least, len(ids), len(coded)) + ids + coded + names


class Segment:
    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.width, self.n, self.nulls, self.least, n_bytes, n_coded = struct.unpack_from("<BQQqQQ", data, 8)
        at = 49
        self.ids = np.frombuffer(data, f"<u{self.width}", n_bytes // self.width, at)
        self.ends = EliasFano.load(data[at + n_bytes : at + n_bytes + n_coded])
        self.names = EliasFano.load(data[at + n_bytes + n_coded :])

    def bounds(self, a: int, b: int) -> np.ndarray:
        """First id of the a-th document and the ends of all from it to before the b-th, by select."""
        ends = self.ends.range(max(a - 1, 0), b).astype(np.int64)
        return ends if a else np.concatenate([[0], ends])

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        some = self.names.range(max(a - self.nulls, 0), max(b - self.nulls, 0)) + np.uint64(self.least % (1 << 64))
        return [None] * (b - a - len(some)) + some.view(np.int64).tolist()


#: Bytes as the printable characters that byte-level vocabularies write for them: printable ones stand for themselves.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
_MARKS = string.punctuation.encode()
_SHOWN_IN_LINE = {b: c for b, c in _SHOWN.items() if b != 32}


class WordEncoder:
    """Ids of a text, as bytes, by a memory of words.

    For tokenizers that lower-case, drop white space, split into runs of letters, digits and other characters, and end
    words with a suffix: there a text's ids are those of its words, and A-Z may be lowered first. Lower-case letter
    words go to the model together, joined by spaces and cut after each end of a word; ASCII marks that follow a word
    are encoded apart. All other words go through the library one by one, and so do whole texts that hold a special token in
    any case, and all texts if the tokenizer is of another kind.
    """

    def __init__(self, tokenizer_json: str, width: int) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.kind = f"<u{width}"
        self.known: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.by_word = self._by_word(told := json.loads(tokenizer_json))
        self.added = [token["content"].encode().lower() for token in told.get("added_tokens", [])]
        self.marks = {token[:1] for token in self.added}
        if self.by_word:
            ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            for token, i in self.tokenizer.get_vocab().items():
                ends[i] = token.endswith(told["model"]["end_of_word_suffix"])
            self.ends = ends
            self.model = Tokenizer.from_str(json.dumps(told | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))

    @staticmethod
    def _by_word(told: dict) -> bool:
        steps = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
        splits = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = splits[0].get("pattern", {}).get("Regex", "") if splits else ""
        normalised = any(token["normalized"] for token in told.get("added_tokens", []))
        return not normalised and bool(told["model"].get("end_of_word_suffix")) and steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"] and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def _learn(self, words: list[bytes]) -> None:
        letters, marked, other = [], [], []
        for word in words:
            if word.isalpha():  # ASCII ones
                letters.append(word)
            elif (stem := word.rstrip(_MARKS)).isalpha():
                marked.append((word, stem, word[len(stem) :]))
            else:
                other.append(word)
        stems = {stem for _, stem, _ in marked}.difference(self.known, letters)
        self.known.update(zip(letters, self._stems([word.decode() for word in letters]), strict=True))
        own = dict(zip(stems, self._stems([word.decode() for word in stems]), strict=True))
        wide: list[tuple[bytes, str, str]] = []
        rest: list[str] = []
        for word in other:
            text = word.decode("utf-8", "surrogatepass")
            stem = text.rstrip(string.punctuation)
            if stem.isalpha() and stem.islower() and unicodedata.is_normalized("NFC", stem):
                wide.append((word, stem, text[len(stem) :]))
            else:
                rest.append(text)
        shown = list({stem for _, stem, _ in wide})
        shown = dict(zip(shown, self._stems(shown), strict=True))
        new = sorted({tail.decode() for _, _, tail in marked}.union(tail for _, _, tail in wide).difference(self.tails))
        self.tails.update(zip(new, self._library(new), strict=True))
        self.known.update((word, (own.get(stem) or self.known[stem]) + self.tails[tail.decode()]) for word, stem, tail in marked)
        self.known.update((word, shown[stem] + self.tails[tail]) for word, stem, tail in wide)
        self.known.update(zip((x.encode("utf-8", "surrogatepass") for x in rest), self._library(rest), strict=True))
        if len(self.tails) > CACHE // 10:
            self.tails = {"": b""}

    def _stems(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case letter words."""
        out: list[bytes] = []
        size = int(self.kind[2])
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            shown = " ".join(some)
            if not shown.isascii():
                shown = shown.encode().decode("latin-1").translate(_SHOWN_IN_LINE)
            ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, dtype=np.int64)
            edges = ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
            raw = ids.astype(self.kind).tobytes()
            out += [raw[a:b] for a, b in zip([0, *edges[:-1]], edges, strict=True)] if len(edges) == len(some) else self._library(some)
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self._library([x.decode("utf-8", "surrogatepass") for x in texts])
        split: list[list[bytes] | None] = []
        for x in texts:
            lowered = x.lower()
            # special tokens are looked for before anything is lowered, and lowering could make one
            split.append(None if any(mark in lowered for mark in self.marks) and any(token in lowered for token in self.added) else lowered.split())
        found = [list(map(self.known.get, words or ())) for words in split]
        unknown: set[bytes] = set()
        missing = [list(compress(range(len(ids)), map(operator.is_, ids, repeat(None)))) if None in ids else [] for ids in found]
        for words, places in zip(split, missing, strict=True):
            unknown.update(map((words or []).__getitem__, places))
        if unknown:
            if len(self.known) + len(unknown) > CACHE:  # the words met first are the frequent ones
                self.known = dict(islice(self.known.items(), CACHE // 2))
            self._learn(list(unknown))
            for words, ids, places in zip(split, found, missing, strict=True):
                for i in places:
                    ids[i] = self.known[words[i]]
        whole = iter(self._library([x.decode("utf-8", "surrogatepass") for x, words in zip(texts, split, strict=True) if words is None]))
        return [next(whole) if words is None else b"".join(ids) for words, ids in zip(split, found, strict=True)]


def _encoder(tokenizer_json: str, width: int) -> WordEncoder:
    """The encoder of this worker, kept from task to task."""
    kept = sys.__dict__.setdefault("_termlake_encoders", {})
    key = (hash(tokenizer_json), width)
    if key not in kept:
        kept.clear()
        kept[key] = WordEncoder(tokenizer_json, width)
    return kept[key]


def write_tokens(docs: DataFrame, tokenizer_json: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the ids of docs (doc_id, text), each document's followed by end_id, and return the manifest.

    Documents are in ascending order of doc_id, nulls first, rows with the same id by text. Null and empty texts give
    end_id alone; a text longer than a segment is one of its own; an empty table gives no segment. Columns but doc_id and text stay behind. `path` must be a folder that all executors can write, as a URI.
    Manifest: task, seq, path, n_docs, n_ids, first, the number of ids in all earlier segments.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = path or scratch_path(spark, "tokens")
    width = 2 if max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    end = np.array([end_id], f"<u{width}").tobytes()
    ordered = rows_of(docs, doc_id=F.col("doc_id").cast("long"), text=F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", F.col("text").cast("binary").alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, seq = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer_json, width)
        names: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // width for x in parts])
            name = f"{root}/{task:06d}-{seq:04d}.tok"
            with store.open_output_stream(own := f"{name}.{uuid4().hex}") as out:
                out.write(write_segment(names, ends, b"".join(parts), width))
            store.move(own, name)
            return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [f"{folder}/{task:06d}-{seq:04d}.tok"], "n_docs": [len(names)], "n_ids": [int(ends[-1])]})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for name, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    names.append(name)
                    parts.append(ids + end)
                    held += len(ids) // width + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
                        names, parts, held, seq = [], [], 0, seq + 1
        if names:
            yield flush()

    manifest = stage_table(ordered.mapInArrow(lean(write), "task int, seq int, path string, n_docs bigint, n_ids bigint"), "token-manifest")
    before = Window.orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit integers) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place) as data:
                    segment = Segment(data.read())
                for at in range(0, segment.n, TOGETHER):
                    until = min(at + TOGETHER, segment.n)
                    bounds = segment.bounds(at, until)
                    a, b = bounds[:-1], bounds[1:]
                    ids = [segment.ids[x:y].astype("<u4").tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    out = {"doc_id": pa.array(segment.doc_ids(at, until), pa.int64()), "start": first + a, "n_tokens": b - a, "ids_crc32": [zlib.crc32(x) for x in ids]}
                    yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    spread = manifest.select("path", "first").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def read_document(manifest: DataFrame, place: int) -> np.ndarray:
    """The ids of the document with that many documents before it, read from one segment by select."""
    from pyarrow import fs

    before = Window.orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1)
    row = manifest.withColumn("docs_before", F.coalesce(F.sum("n_docs").over(before), F.lit(0))).where((F.col("docs_before") <= place) & (F.col("docs_before") + F.col("n_docs") > place)).first()
    if row is None:
        raise IndexError(place)
    store, name = fs.FileSystem.from_uri(row["path"])
    with store.open_input_stream(name) as data:
        segment = Segment(data.read())
    at = place - row["docs_before"]
    a, b = segment.bounds(at, at + 1)
    return segment.ids[a:b]
