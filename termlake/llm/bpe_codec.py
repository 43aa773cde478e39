"""Byte-level BPE by a global shuffle of distinct words.

Documents are split into words with their positions, a word being a run of whole matches of the split pattern that
never continues across its edges. Each distinct word of the corpus is encoded once, in the task that its hash names;
its ids go back to the blocks that hold it, where documents are put together by position. Decoding joins ids with the
table of token bytes.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from termlake.llm import blocks as B
from termlake.llm.common import bucketed_table, lean, lean_pair, lean_table, rows_of, ship, small_batches

ship(__name__)

#: Unicode's White_Space, which the split pattern's \s stands for.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space belongs to what follows; of several white spaces the last is apart. These edges are edges of PATTERN too.
WORDS = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Fixed value: the split pattern whose edges WORDS has. Another one is refused, as its words may end elsewhere.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of distinct words, about, that one hash partition should hold.
PART_BYTES = 2_500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def split_words(text: str) -> list[bytes]:
    return [word.encode("utf-8", "surrogatepass") for word in WORDS.findall(text)]


def token_table(ranks: dict[bytes, int]) -> list[bytes | None]:
    """Token bytes by id; None where no token has the id."""
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from uuid import uuid4

    for x in B.build(batches, split_words):
        # a random name will do: the table of blocks is written once and then read
        yield pa.RecordBatch.from_pydict({"block": [uuid4().hex], "ids": pa.array([x["ids"]], pa.list_(pa.int64())), "lengths": [B.pack_ints(x["lengths"])], "codes": [B.pack_ints(x["codes"])], "words": [B.pack_units(x["units"])], "word_bytes": [sum(map(len, x["units"]))]})


BLOCKS = "block string, ids array<bigint>, lengths binary, codes binary, words binary, word_bytes bigint"


def _parts_of(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)) % np.uint64(parts)


def _send(parts: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = B.unpack_units(packed.as_py())
                part = _parts_of(words, parts)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64)).tolist()
                order = order.tolist()
                for p in range(parts):
                    if edges[p] < edges[p + 1]:
                        yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "block": [block], "words": [B.pack_units([words[i] for i in order[edges[p] : edges[p + 1]]])]})

    return send


def _encoding(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    """The encoding of this worker, kept from task to task."""
    kept = sys.__dict__.setdefault("_termlake_encodings", {})
    key = (pattern, hash(frozenset(ranks.items())))
    if key not in kept:
        kept.clear()
        kept[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return kept[key]


def _encode_part(ranks: dict[bytes, int], pattern: str):
    def encode(table: pa.Table) -> pa.Table:
        """Encode each distinct word of a hash partition once, then give each block its words' ids in the order it sent them."""
        encoding = _encoding(ranks, pattern)
        ids: dict[bytes, bytes] = {}
        out: dict[str, list] = {"block": table.column("block").to_pylist(), "part": table.column("part").to_pylist(), "counts": [], "flat": []}
        for packed in table.column("words"):
            words = B.unpack_units(packed.as_py())
            for word in words:
                if word not in ids:
                    ids[word] = array("I", encoding.encode_ordinary(word.decode("utf-8", "surrogatepass"))).tobytes()
            found = [ids[word] for word in words]
            out["counts"].append(B.pack_ints(np.fromiter(map(len, found), dtype=np.uint32, count=len(found)) // np.uint32(4)))
            out["flat"].append(B.pack_ints(np.frombuffer(b"".join(found), dtype="<u4")))
        return pa.table(out, ENCODED)

    return encode


ENCODED = pa.schema([("block", pa.string()), ("part", pa.int32()), ("counts", pa.binary()), ("flat", pa.binary())])


def _reassemble(parts: int):
    def reassemble(block: pa.Table, encoded: pa.Table) -> pa.Table:
        encoded = encoded.sort_by("part")
        doc_ids, n_tokens, out = [], [], []
        for row in block.to_pylist():
            words = B.unpack_units(row["words"])
            order = np.argsort(_parts_of(words, parts), kind="stable").tolist()
            table: list[bytes] = [b""] * len(words)
            del words
            at = 0
            for counts, flat in zip(encoded.column("counts"), encoded.column("flat"), strict=True):
                sizes = B.unpack_ints(counts.as_py()).astype(np.int64) * 4
                ends = np.cumsum(sizes)
                raw = B.unpack_ints(flat.as_py()).tobytes()
                for i, a, b in zip(order[at : at + len(sizes)], (ends - sizes).tolist(), ends.tolist(), strict=True):
                    table[i] = raw[a:b]
                at += len(sizes)
            at = 0
            codes = B.unpack_ints(row["codes"])
            for doc_id, length in zip(row["ids"], B.unpack_ints(row["lengths"]).tolist(), strict=True):
                ids = b"".join(map(table.__getitem__, codes[at : at + length].tolist()))
                at += length
                doc_ids.append(doc_id)
                n_tokens.append(len(ids) // 4)
                out.append(ids)
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "ids": pa.array(out, pa.binary())})

    return reassemble


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids for each row of docs (doc_id, text): ids are little-endian unsigned 32-bit integers.

    The same ids as tiktoken's encode_ordinary of the whole text; any pattern but SPLIT raises ValueError. Null and empty texts have none; a doc_id that occurs
    twice gives two rows; an empty table gives an empty result. A block and a hash partition of distinct words,
    both of fixed size, bound the memory of a task; a text longer than a block is one of its own. Ranks are of the size of the
    vocabulary. Columns but doc_id and text stay behind.
    """
    if pattern != SPLIT:
        raise ValueError(f"words cannot be cut for the pattern {pattern!r}")
    small_batches(docs.sparkSession)
    texts = rows_of(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text"))
    blocks = bucketed_table(texts.mapInArrow(lean(_to_blocks), BLOCKS), "bpe_blocks", "block")
    total = blocks.agg(F.sum("word_bytes")).first()[0] or 0
    parts = int(total // PART_BYTES) + 1
    sent = blocks.select("block", "words").mapInArrow(lean(_send(parts)), "part int, block string, words binary")
    encoded = sent.groupBy("part").applyInArrow(lean_table(_encode_part(ranks, pattern)), "block string, part int, counts binary, flat binary")
    whole = blocks.select("block", "ids", "lengths", "codes", "words")
    return whole.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(lean_pair(_reassemble(parts)), "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows of encoded with `decoded`, the bytes of their ids. Unknown ids raise; null ids give null.

    A broadcast join with the table (id, token bytes): ids are its places, so a batch of ids is joined by one take, whose
    values stand one after the other as the decoded texts. The table has the size of the vocabulary.
    """
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])
    table = pa.array(token_table(ranks), pa.large_binary())
    at = encoded.columns.index("ids")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[bytes | None] = []
            for ids in batch.column(at):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                found = table.take(pa.array(np.frombuffer(ids.as_buffer(), "<u4")))
                if found.null_count:
                    raise ValueError("an id that no token has")
                texts.append(_values(found) if len(found) else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)

    return encoded.mapInArrow(lean(join), schema)


def _values(found: pa.Array) -> bytes:
    """The values of an array without nulls, one after the other."""
    _, offsets, values = found.buffers()
    ends = np.frombuffer(offsets, "<i8", len(found) + 1, 8 * found.offset)
    return values[int(ends[0]) : int(ends[-1])].to_pybytes()
