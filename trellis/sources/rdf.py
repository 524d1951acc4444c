"""RDF documents: Turtle and RDF/XML readers over whole files, N-Triples by lines, and writers.

N-Triples files split anywhere; Turtle and RDF/XML have no safe split point, so each file is one record and files are read
in parallel. Blank nodes are renamed by a hash of the file's path, so that labels of two files never meet.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.terms import RDF, Term, bnode, iri, lit
from trellis.plans.algebra import Fresh, Triple
from trellis.plans.parser import parse_turtle
from trellis.sources.ntriples import named_apart, read_files, read_permissive, rejects, statements
from trellis.session import through_table
from trellis.sources.store import TripleStore

XML = "http://www.w3.org/XML/1998/namespace"


def _split(tag: str) -> str:
    """ElementTree's {namespace}name as an IRI."""
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class _RdfXml:
    """Node and property elements, typed nodes, attributes as properties, parse types, list items, xml:lang and xml:base."""

    def __init__(self, base: str):
        self.base, self.out, self.fresh = base, [], Fresh()

    def blank(self) -> Term:
        return bnode(self.fresh("x"))

    def resolve(self, base: str, ref: str) -> Term:
        return iri(urljoin(base, ref) if base else ref)

    def subject(self, e: ET.Element, base: str) -> Term:
        get = lambda name: e.get(f"{{{RDF}}}{name}")
        if get("about") is not None:
            return self.resolve(base, get("about"))
        if get("ID") is not None:
            return self.resolve(base, "#" + get("ID"))
        return bnode("n" + get("nodeID")) if get("nodeID") is not None else self.blank()

    def node(self, e: ET.Element, base: str, lang: str | None) -> Term:
        base, lang = e.get(f"{{{XML}}}base", base), e.get(f"{{{XML}}}lang", lang)
        s = self.subject(e, base)
        if _split(e.tag) != RDF + "Description":
            self.out.append(Triple(s, iri(RDF + "type"), iri(_split(e.tag))))
        self.attributes(s, e, base, lang)
        item = 0
        for child in e:
            p = _split(child.tag)
            if p == RDF + "li":
                item += 1
                p = f"{RDF}_{item}"
            self.property(s, iri(p), child, base, lang)
        return s

    def attributes(self, s: Term, e: ET.Element, base: str, lang: str | None) -> bool:
        found = False
        for k, v in e.attrib.items():
            name = _split(k)
            if k.startswith(f"{{{XML}}}") or name in (RDF + x for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType")) or "}" not in k:
                continue
            found = True
            self.out.append(Triple(s, iri(name), self.resolve(base, v) if name == RDF + "type" else lit(v, lang=lang)))
        return found

    def property(self, s: Term, p: Term, e: ET.Element, base: str, lang: str | None) -> None:
        base, lang = e.get(f"{{{XML}}}base", base), e.get(f"{{{XML}}}lang", lang) or None
        kind, children = e.get(f"{{{RDF}}}parseType"), list(e)
        if kind == "Literal":
            inner = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in children)
            o = lit(inner, dt=RDF + "XMLLiteral")
        elif kind == "Resource":
            o = self.blank()
            for child in children:
                self.property(o, iri(_split(child.tag)), child, base, lang)
        elif kind == "Collection":
            o = iri(RDF + "nil")
            for child in reversed(children):
                cell = self.blank()
                self.out += [Triple(cell, iri(RDF + "first"), self.node(child, base, lang)), Triple(cell, iri(RDF + "rest"), o)]
                o = cell
        elif e.get(f"{{{RDF}}}resource") is not None:
            o = self.resolve(base, e.get(f"{{{RDF}}}resource"))
            self.attributes(o, e, base, lang)
        elif e.get(f"{{{RDF}}}nodeID") is not None:
            o = bnode("n" + e.get(f"{{{RDF}}}nodeID"))
        elif children:
            o = self.node(children[0], base, lang)
        else:
            dt = e.get(f"{{{RDF}}}datatype")
            o = self.blank()
            if not self.attributes(o, e, base, lang):
                o = lit(e.text or "", dt=dt) if dt else lit(e.text or "", lang=lang)
        self.out.append(Triple(s, p, o))


def parse_rdfxml(text: str, base: str = "") -> list[Triple]:
    root = ET.fromstring(text)
    reader = _RdfXml(root.get(f"{{{XML}}}base", base))
    lang = root.get(f"{{{XML}}}lang")
    for e in root if _split(root.tag) == RDF + "RDF" else [root]:
        reader.node(e, reader.base, lang)
    return reader.out


_BEFORE_XML = re.compile(r"\A[\ufeff\s]*(?:<!--.*?-->\s*)*<(?:\?xml|!DOCTYPE|rdf:|[A-Za-z][\w.-]*(?::[\w.-]+)?(?:\s[^<>]*)?\sxmlns)", re.S)
_TRIPLE_LINE = re.compile(r"^(?:<[^<>\s]*>|_:\S+)\s+<[^<>\s]*>\s+(?:<[^<>\s]*>|_:\S+|\".*\"\S*)\s*\.\s*(?:#.*)?$")


def guess_syntax(text: str) -> str:
    """rdfxml, turtle or ntriples: XML by its first tag, N-Triples if each line of the document is a triple or a comment."""
    if _BEFORE_XML.match(text):
        return "rdfxml"
    lines = [x for x in (x.strip() for x in text.lstrip("\ufeff").split("\n")) if x and not x.startswith("#")]
    return "ntriples" if lines and all(_TRIPLE_LINE.match(x) for x in lines) else "turtle"


def parse_document(text: str, base: str = "", syntax: str | None = None) -> list[Triple]:
    """Triples of a document; the syntax is guessed where it is not given (N-Triples is read as the Turtle it is)."""
    syntax = syntax or guess_syntax(text)
    return parse_rdfxml(text, base) if syntax == "rdfxml" else parse_turtle(text, base)


def _skolem(t: Term, scope: str) -> Term:
    return bnode(f"d{scope}x{t.value}") if t.kind == "bnode" else t


def load_string(spark: SparkSession, text: str, base: str = "", syntax: str | None = None) -> TripleStore:
    return TripleStore.from_triples(spark, parse_document(text, base, syntax))


def read_documents(spark: SparkSession, path: str, syntax: str | None = None) -> DataFrame:
    """(file, s, p, o, corrupt, reason) of Turtle or RDF/XML files, one task per file at most.

    A file that cannot be parsed gives no triple and one row with its beginning in `corrupt` and the parser's words in
    `reason`. A file is held in memory whole, so large exports should be N-Triples.
    """
    import hashlib

    names = ["file", "s", "p", "o", "corrupt", "reason"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                scope = hashlib.sha1(name.encode()).hexdigest()[:12]
                try:
                    triples = parse_document(content.decode("utf-8"), name, syntax)
                except (ValueError, SyntaxError) as e:
                    cols = [[name], [None], [None], [None], [content[:200].decode("utf-8", "replace")], [f"{type(e).__name__}: {e}"]]
                else:
                    terms = [[_skolem(getattr(t, c), scope).nt for t in triples] for c in "spo"]
                    cols = [[name] * len(triples), *terms, [None] * len(triples), [None] * len(triples)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ", ".join(f"{n} string" for n in names))


@dataclass(frozen=True)
class Load:
    """What RDF files hold: `rows` has one row per statement or failure (file, s, p, o, corrupt, reason)."""

    rows: DataFrame
    by_lines: bool

    @property
    def store(self) -> TripleStore:
        found = statements(self.rows)
        return TripleStore.from_rows(named_apart(found) if self.by_lines else found.select("s", "p", "o"))

    @property
    def rejects(self) -> DataFrame:
        """(file, corrupt, reason): lines, or whole files, that could not be read."""
        return rejects(self.rows)

    def report(self) -> DataFrame:
        """(file, n_statements, n_rejects), one row per file that holds either."""
        counts = self.rows.groupBy("file").agg(F.count("s").alias("n_statements"), F.count("reason").alias("n_rejects"))
        return counts.where("n_statements + n_rejects > 0")


def load(spark: SparkSession, path: str, syntax: str | None = None) -> Load:
    """Read RDF files. N-Triples (named so, or ending in .nt) is read by lines, the rest by whole files.

    What is read is written to the shared folder once; store, rejects and report come from there.
    """
    by_lines = syntax == "ntriples" or syntax is None and path.rstrip("/*").endswith(".nt")
    rows = read_files(spark, path) if by_lines else read_documents(spark, path, syntax)
    return Load(through_table(rows, "load"), by_lines)


def load_files(spark: SparkSession, path: str, syntax: str | None = None) -> TripleStore:
    """The store of RDF files; what could not be read is told by load(...).rejects."""
    return load(spark, path, syntax).store


def statements_of_lines(lines: DataFrame, column: str) -> DataFrame:
    """(s, p, o) of the valid statements among N-Triples lines."""
    return statements(read_permissive(lines, column, [])).select("s", "p", "o")


def write_turtle(triples: DataFrame, path: str, mode: str = "errorifexists", per_line: int = 500) -> None:
    """Lines of one subject with predicates joined by `;`, at most per_line of them a line.

    A subject's triples are spread over tasks, and a task passes them on as they come, so a hot subject is many short lines.
    """
    pair = triples.select("s", F.concat_ws(" ", "p", "o").alias("po"), F.pmod(F.xxhash64("p", "o"), F.lit(16)).alias("slice"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, held = None, []
        for b in batches:
            out = []
            for subject, po in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (subject != s or len(held) >= per_line):
                    out.append(f"{s} {' ; '.join(held)} .")
                    held = []
                s = subject
                held.append(po)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"{s} {' ; '.join(held)} ."], pa.string())], names=["value"])

    pair.repartition("s", "slice").sortWithinPartitions("s").select("s", "po").mapInArrow(run, "value string").write.mode(mode).text(path)
