"""Lines, chunks, citations."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlake.functions import text as T
from termlake.tasks import ship, small_batches

ship(__name__)

CHUNK_TOKENS = 400
#: A heading, with white space as patterns of the JVM have it.
_HEADING = re.compile(T.HEADING, re.ASCII)
#: White space as patterns of the JVM have it.
SPACES = r"[ \t\n\x0b\f\r]+"
LONG_SPACES = r"[ \t\n\x0b\f\r]{2,}"
#: Lines of a bucket that intervals of a document are joined by.
BUCKET = 64
#: So many snippets of a document are looked for without an automaton.
FEW = 4


def _split(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")


def _with_offsets(rows: DataFrame) -> DataFrame:
    """rows (doc_id, row, line_no, line) with start_offset, one character counted for each break; by a window over a document's lines."""
    before = Window.partitionBy("doc_id", "row").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")
    return rows.select("doc_id", "line_no", start.alias("start_offset"), "line")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, start_offset, line), offsets counted in characters with one for each break."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").select("doc_id", "row", F.posexplode(_split(F.col("text"))).alias("i", "line"))
    return _with_offsets(rows.withColumn("line_no", F.col("i") + 1))


def _html_array(markup: Column, decode: Callable[[Column], Column] = T.unescape) -> Column:
    """(no, line) of lines of markup that say something, each flattened by itself and numbered as in the markup."""
    clean = T.blank_comments(F.regexp_replace(F.coalesce(markup, F.lit("")), "\r\n?", "\n"))
    flat = F.transform(F.split(clean, "\n"), lambda x, i: F.struct((i + 1).alias("no"), T.flatten_html(x, decode).alias("line")))
    return F.filter(flat, lambda x: x["line"] != "")


def html_lines(pages: DataFrame, decode: Callable[[Column], Column] = T.unescape) -> DataFrame:
    """(doc_id, line_no, start_offset, line) of pages (doc_id, markup): each line flattened by itself, blank ones gone,
    line_no as in the markup, offsets in the text that remains."""
    rows = pages.select("doc_id", F.monotonically_increasing_id().alias("row"), "markup").select("doc_id", "row", F.explode(_html_array(F.col("markup"), decode)).alias("z"))
    return _with_offsets(rows.select("doc_id", "row", F.col("z.no").alias("line_no"), F.col("z.line").alias("line")))


def locate(snippet: Column, text: Column) -> Column:
    """(start, end) of the snippet in the text, counted in characters from 0, end excluded; null if it is not there.

    First as it stands, then with any white space between its words: the match is found in the original text, so no
    map from a collapsed one is needed. Empty snippets are nowhere.
    """
    words = F.split(F.trim(F.regexp_replace(snippet, r"\s+", " ")), " ")
    pattern = F.concat(F.lit(r"\Q"), F.array_join(F.transform(words, lambda w: F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q"))), r"\E\s+\Q"), F.lit(r"\E"))
    exact = F.position(snippet, text)
    found = F.when(exact > 0, snippet).otherwise(F.regexp_substr(text, pattern))
    start = F.when(exact > 0, exact).otherwise(F.regexp_instr(text, pattern))
    return F.when((F.trim(F.regexp_replace(snippet, r"\s+", " ")) != "") & (start > 0), F.struct((start - 1).alias("start"), (start - 1 + F.length(found)).alias("end")))


class Finder:
    """Where snippets begin and end in one text, which is read once for all as they stand, and once more for those that differ in white space."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def line(self, offset: int) -> int:
        """The line, from 0, of an offset."""
        return bisect.bisect_left(self.breaks, offset)

    @staticmethod
    def first(snippets: Iterable[str], text: str) -> dict[str, int]:
        """The first place of each snippet that the text has; an automaton of all meets each character once, few are looked for in turn."""
        snippets = set(snippets)
        if len(snippets) <= FEW:
            return {x: at for x in snippets if (at := text.find(x)) >= 0}
        import ahocorasick

        automaton, missing, found = ahocorasick.Automaton(), set(snippets), {}
        for snippet in missing:
            automaton.add_word(snippet, snippet)
        automaton.make_automaton()
        for end, snippet in automaton.iter(text):
            if snippet in missing:
                missing.discard(snippet)
                found[snippet] = end - len(snippet) + 1
                if not missing:
                    break
        return found

    def places(self, snippets: Iterable[str]) -> dict[str, tuple[int, int]]:
        """(start, end) of each snippet that is there, as locate() has them."""
        loose = {x: re.sub(SPACES, " ", x).strip(" ") for x in set(snippets)}
        loose = {x: y for x, y in loose.items() if y}
        out = {x: (at, at + len(x)) for x, at in self.first(loose, self.text).items()}
        rest = {x: y for x, y in loose.items() if x not in out}
        if rest:
            # a run of white space is one character of the collapsed text, so only longer runs shift what comes after them
            runs = [(m.start(), m.end() - m.start() - 1) for m in re.finditer(LONG_SPACES, self.text)]
            shifts = [0, *itertools.accumulate(n for _, n in runs)]
            starts = [start - shift for (start, _), shift in zip(runs, shifts)]
            origin = lambda at: at + shifts[bisect.bisect_left(starts, at)]
            found = self.first(rest.values(), re.sub(SPACES, " ", self.text))
            out |= {x: (origin(found[y]), origin(found[y] + len(y) - 1) + 1) for x, y in rest.items() if y in found}
        return out


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, snippet, text, numbers), those of a document together and its text before its snippets."""
    doc_id, source, wanted = None, None, set()
    out: dict[str, list] = {name: [] for name in ("doc_id", "snippet", "start", "end", "first_line", "last_line")}

    def place() -> None:
        if source is None or not wanted:
            return
        finder, numbers = Finder(source[0].as_py()), source[1].as_py()
        number = lambda offset: numbers[i] if numbers and (i := finder.line(offset)) < len(numbers) else finder.line(offset) + 1
        for snippet, (start, end) in finder.places(wanted).items():
            for name, value in zip(out, (doc_id, snippet, start, end, number(start), number(max(end - 1, start))), strict=True):
                out[name].append(value)

    def taken() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))
        for values in out.values():
            values.clear()
        return made

    for batch in batches:
        kinds = (batch.schema.field("doc_id").type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for own, snippet, *text in zip(batch.column("doc_id").to_pylist(), batch.column("snippet").to_pylist(), batch.column("text"), batch.column("numbers"), strict=True):
            if own != doc_id:
                place()
                doc_id, source, wanted = own, None, set()
            if snippet is not None:
                wanted.add(snippet)
            elif source is None:  # the first, of a document that is there twice
                source = text
        yield taken()
    place()
    if out["doc_id"]:
        yield taken()


def locate_all(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, snippet, start, end, first_line, last_line) of wanted (doc_id, snippet) that are in their text of texts (doc_id, text,
    numbers), as locate() finds them; numbers are those of its lines, 1 and up where null.

    Snippets meet their document once: a text is in one task, read once or twice for all its snippets, and in no row of theirs. Tasks
    read documents one after the other, in the order of their ids, so none is a group with a start of its own.
    """
    small_batches(texts.sparkSession)
    known = texts.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lit(None).cast("string").alias("snippet"), "text", F.col("numbers").cast("array<int>").alias("numbers"))
    asked = wanted.where("doc_id IS NOT NULL AND snippet IS NOT NULL").select("doc_id", "snippet", F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<int>").alias("numbers"))
    kind = known.schema["doc_id"].dataType.simpleString()
    met = known.unionByName(asked).repartition("doc_id").sortWithinPartitions("doc_id", F.asc_nulls_last("text"))
    return met.mapInArrow(_place, f"doc_id {kind}, snippet string, start bigint, end bigint, first_line bigint, last_line bigint")


def line_of(offset: Column, text: Column) -> Column:
    """The line, from 1, that a character offset from 0 lies in."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n"))


def source_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, is_html) as (doc_id, all): the (no, line) that can be cited, of text as it stands, of markup flattened."""
    whole = F.split(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n$", ""), "\n")
    plain = F.transform(whole, lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))
    return docs.select("doc_id", F.when(F.coalesce("is_html", F.lit(False)), _html_array(F.col("text"))).otherwise(plain).alias("all"))


def chunks(docs: DataFrame, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(doc_id, chunk_no, start_line, end_line, heading, text) of docs (doc_id, text): chunk_lines() of plain text."""
    return chunk_lines(source_lines(docs.select("doc_id", "text", F.lit(False).alias("is_html"))), tokens)


def _packed(lines: list[str], tokens: int) -> Iterator[tuple[int, int, int, str | None, str]]:
    """(chunk_no, first line, line after the last, heading, text) of a document's chunks, lines counted from 0."""
    cuts, heads, held, due = [], [], 0, True
    for i, line in enumerate(lines):
        head = _HEADING.match(line) is not None
        if head:
            heads.append(i)
        if due or head:
            cuts.append(i)
            held = 0
        held += len(line.split())
        due = max(1, held * 4 // 3) >= tokens
        held = 0 if due else held
    for chunk_no, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(lines)], strict=True)):
        text = "\n".join(lines[a:b]).strip()
        if text:
            at = bisect.bisect_right(heads, a) - 1
            yield chunk_no, a, b, lines[heads[at]].lstrip("# ").strip(" ") if at >= 0 else None, text


def _pack(tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("doc_id", "chunk_no", "start_line", "end_line", "heading", "text")}
            nos, lines = batch.column("no"), batch.column("line")
            for doc_id, no, line in zip(batch.column("doc_id").to_pylist(), nos, lines, strict=True):
                if not line.is_valid:
                    continue
                no = no.as_py()
                for chunk_no, a, b, heading, text in _packed(line.values.to_pylist(), tokens):
                    for name, value in zip(out, (doc_id, chunk_no, no[a], no[b - 1], heading, text), strict=True):
                        out[name].append(value)
            kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return pack


def chunk_lines(sources: DataFrame, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(doc_id, chunk_no, start_line, end_line, heading, text) of sources (doc_id, all).

    A heading opens a section; in a section, lines are packed until their estimate reaches `tokens`. Blank chunks are left
    out, white space at both ends too. Each line is read once, so the work grows with the number of lines.
    """
    small_batches(sources.sparkSession)
    kind = sources.schema["doc_id"].dataType.simpleString()
    rows = sources.select("doc_id", F.col("all.no").cast("array<int>").alias("no"), F.col("all.line").alias("line"))
    return rows.mapInArrow(_pack(tokens), f"doc_id {kind}, chunk_no int, start_line int, end_line int, heading string, text string")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (a_end >= b_start)


def overlap_join(a: DataFrame, b: DataFrame, key: str, size: int = BUCKET) -> DataFrame:
    """a (key, a_start, a_end) with b (key, b_start, b_end) where their lines overlap, each pair once; malformed ranges meet nothing.

    Both sides go to the buckets of `size` lines that they touch, so an interval meets what is near it and not all of its document;
    a pair that shares several buckets is kept in the first of them.
    """
    def dealt(rows: DataFrame, start: str, end: str) -> DataFrame:
        last = F.greatest(F.floor(F.col(end) / size), F.floor(F.col(start) / size))
        return rows.where(F.col(start) <= F.col(end)).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / size), last)))

    met = dealt(a, "a_start", "a_end").join(dealt(b, "b_start", "b_end"), [key, "bucket"])
    first = F.greatest(F.floor(F.col("a_start") / size), F.floor(F.col("b_start") / size))
    return met.where(overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")) & (F.col("bucket") == first)).drop("bucket")


def line_range(text: Column) -> Column:
    """(start, end) of a range such as 3-7, null if it is none."""
    start, end = (F.regexp_extract(text, r"^\s*(-?\d+)\s*-\s*(-?\d+)\s*$", i).try_cast("int") for i in (1, 2))
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def verbatim(snippet: Column, text: Column) -> Column:
    """Whether the snippet stands in the text, white space apart; empty ones never do."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.coalesce((flat(snippet) != "") & F.contains(flat(text), flat(snippet)), F.lit(False))


def gate_facts(facts: DataFrame) -> DataFrame:
    """facts (subject, snippet, text) with reason, null where they pass; nothing is repaired and no fact drops another."""
    reason = F.when(F.coalesce(T.normalise(F.col("subject")), F.lit("")) == "", "empty subject").when(F.coalesce(F.trim("snippet"), F.lit("")) == "", "empty snippet").when(~verbatim(F.col("snippet"), F.col("text")), "snippet not in the source")
    return facts.withColumn("reason", reason)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest order, which for versions is text order."""
    top = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("nth", F.row_number().over(top)).where("nth = 1").drop("nth")
