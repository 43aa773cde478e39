"""Turtle files as quads, each parsed in a task. Files are authored by people; one file is one row."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.tasks import ship

ship(__name__)

SCHEMA = "subject string, predicate string, object string, graph string, lang string, datatype string"
RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>\s]*>)|(?P<text>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<kind>\^\^)|(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<node>_:\w+)"""
    r"""|(?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w%-](?:[\w.%:-]*[\w%:-])?)?)|(?P<word>[A-Za-z]+)|(?P<mark>[;,.\[\]()])""",
    re.DOTALL,
)


class TurtleError(ValueError):
    """A file that is no Turtle; the message names file and line."""


class _Reader:
    def __init__(self, name: str, text: str) -> None:
        self.name, self.text, self.at, self.nodes = name, text, 0, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.kind, self.value = "", ""
        self.found: list[tuple] = []
        self.step()

    def fail(self, what: str) -> TurtleError:
        return TurtleError(f"{self.name}, line {self.text.count(chr(10), 0, self.at) + 1}: {what}")

    def step(self) -> str:
        """Go on to the next token; the value of the one before."""
        before = self.value
        self.kind, self.value = "skip", ""
        while self.kind == "skip":
            if self.at >= len(self.text):
                self.kind, self.value = "end", ""
                return before
            match = TOKEN.match(self.text, self.at)
            if not match:
                raise self.fail(f"unexpected {self.text[self.at]!r}")
            self.kind, self.value, self.at = match.lastgroup or "", match.group(), match.end()
        return before

    def expect(self, value: str) -> None:
        if self.value != value:
            raise self.fail(f"{value!r} expected, not {self.value!r}")
        self.step()

    def resource(self) -> str:
        if self.kind == "iri":
            iri = self.step()[1:-1]
            return f"<{iri if ':' in iri else self.base + iri}>"
        if self.kind == "node":
            return self.step()
        if self.kind == "name":
            prefix, _, rest = self.step().partition(":")
            if prefix not in self.prefixes:
                raise self.fail(f"unknown prefix {prefix!r}")
            return f"<{self.prefixes[prefix]}{rest}>"
        if self.value == "[":
            self.step()
            self.nodes += 1
            node = f"_:n{self.nodes}"
            if self.value != "]":
                self.properties(node)
            self.expect("]")
            return node
        if self.value == "(":
            return self.collection()
        raise self.fail(f"unexpected {self.value!r}")

    def collection(self) -> str:
        """A list as first and rest from its last item on; the node that begins it."""
        self.step()
        items = []
        while self.value != ")":
            if self.kind == "end":
                raise self.fail("')' expected")
            items.append(self.term())
        self.step()
        rest = f"<{RDF}nil>"
        for item in reversed(items):
            self.nodes += 1
            node = f"_:n{self.nodes}"
            self.found += [(node, f"<{RDF}first>", *item), (node, f"<{RDF}rest>", rest, None, None)]
            rest = node
        return rest

    def term(self) -> tuple[str, str | None, str | None]:
        """(object, lang, datatype) as they stand in an N-Quads line."""
        if self.kind == "text":
            raw = self.step()
            inner = raw[3:-3] if raw.startswith('"""') else raw[1:-1]
            quoted = '"' + re.sub(r'\\.|"|\n|\r', lambda m: {'"': '\\"', "\n": "\\n", "\r": "\\r", "\\'": "'"}.get(m.group(), m.group()), inner) + '"'
            if self.kind == "at":
                lang = self.step()[1:]
                return f"{quoted}@{lang}", lang, None
            if self.kind == "kind":
                self.step()
                datatype = self.resource()
                return f"{quoted}^^{datatype}", None, datatype[1:-1]
            return quoted, None, None
        if self.kind == "number" or self.value in ("true", "false"):
            raw = self.step()
            datatype = XSD + ("boolean" if raw in ("true", "false") else "decimal" if "." in raw else "integer")
            return f'"{raw}"^^<{datatype}>', None, datatype
        return self.resource(), None, None

    def properties(self, subject: str) -> None:
        while True:
            predicate = f"<{RDF}type>" if self.value == "a" and self.step() else self.resource()
            self.found.append((subject, predicate, *self.term()))
            while self.value == ",":
                self.step()
                self.found.append((subject, predicate, *self.term()))
            while self.value == ";":
                self.step()
                if self.value in (".", "]"):
                    return
            if self.value in (".", "]") or self.kind == "end":
                return

    def statements(self) -> Iterator[tuple]:
        while self.kind != "end":
            directive = self.value.lower().lstrip("@")
            if directive in ("prefix", "base") and self.kind in ("at", "word"):
                dotted = self.step().startswith("@")
                if directive == "prefix":
                    prefix = self.step().rpartition(":")[0]
                    self.prefixes[prefix] = self.resource()[1:-1]
                else:
                    self.base = self.resource()[1:-1]
                if dotted:
                    self.expect(".")
                continue
            subject = self.resource()
            if not (subject.startswith("_:n") and self.value == "."):
                self.properties(subject)
            self.expect(".")
            yield from self.found
            self.found.clear()


def parse(name: str, text: str, graph: str) -> list[tuple]:
    """Rows of one text, repeated triples once; blank nodes belong to their file."""
    mark = re.sub(r"[^A-Za-z0-9]", "", name)
    own = lambda x: x.replace("_:", f"_:{mark}", 1) if x.startswith("_:") else x
    rows = ((own(s), p, own(o), graph, lang, datatype) for s, p, o, lang, datatype in _Reader(name, text).statements())
    return list(dict.fromkeys(rows))


def scan_turtle(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """(subject, predicate, object, graph, lang, datatype) of the files of a path or pattern, repeated triples once.

    Files are dealt over tasks and parsed there. One that is no Turtle fails the job; the message has its name and line.
    """
    schema = pa.schema([(x, pa.string()) for x in ("subject", "predicate", "object", "graph", "lang", "datatype")])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = parse(name, content.decode("utf-8"), graph)
                yield from pa.Table.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema).to_batches(max_chunksize=50_000)

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content")
    return files.repartition("name").mapInArrow(parsed, SCHEMA).distinct()


def read_turtle(spark: SparkSession, sources: Mapping[str, str], graph: str) -> DataFrame:
    """As scan_turtle(), of texts by file name that the caller has in hand, in the order of the names."""
    rows = [row for name in sorted(sources) for row in parse(name, sources[name], graph)]
    return spark.createDataFrame(list(dict.fromkeys(rows)), SCHEMA)
