"""RDF terms: driver-side values and their column form.

A term column is a struct (kind, lex, dt, lang, dir) whose fields are never null, so struct equality is
term identity. Kinds are ordered as SPARQL orders terms: blank node, IRI, literal, triple term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
INTEGER, DECIMAL, DOUBLE, FLOAT = XSD + "integer", XSD + "decimal", XSD + "double", XSD + "float"
STRING, BOOLEAN, DATETIME, DATE = XSD + "string", XSD + "boolean", XSD + "dateTime", XSD + "date"
DURATION = XSD + "dayTimeDuration"
LANG_STRING, DIR_LANG_STRING = RDF + "langString", RDF + "dirLangString"
RDF_TYPE, RDF_FIRST, RDF_REST, RDF_NIL, RDF_REIFIES = (RDF + x for x in ("type", "first", "rest", "nil", "reifies"))
NUMERIC = (INTEGER, DECIMAL, FLOAT, DOUBLE)
#: Derived integer types count as numbers, by the XPath type hierarchy.
DERIVED = tuple(XSD + x for x in ("int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte"))

BNODE, IRI_KIND, LITERAL, TRIPLE = 0, 1, 2, 3
TERM = T.StructType([T.StructField("kind", T.IntegerType(), False), *(T.StructField(n, T.StringType(), False) for n in ("lex", "dt", "lang", "dir"))])
TERM_DDL = "struct<kind:int,lex:string,dt:string,lang:string,dir:string>"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class BNode:
    label: str


@dataclass(frozen=True)
class Lit:
    lex: str
    dt: str = STRING
    lang: str = ""
    dir: str = ""


@dataclass(frozen=True)
class TripleTerm:
    s: object
    p: object
    o: object


def parts(term) -> tuple[int, str, str, str, str]:
    """The five fields of a ground term."""
    if isinstance(term, IRI):
        return IRI_KIND, term.value, "", "", ""
    if isinstance(term, BNode):
        return BNODE, term.label, "", "", ""
    if isinstance(term, Lit):
        return LITERAL, term.lex, term.dt, term.lang, term.dir
    return TRIPLE, to_nt(term), "", "", ""


def term_lit(term) -> Column:
    kind, *rest = parts(term)
    return make(F.lit(kind), *(F.lit(x) for x in rest))


def make(kind: Column, lex: Column, dt: Column, lang: Column, dir_: Column) -> Column:
    return F.struct(kind.cast("int").alias("kind"), lex.alias("lex"), dt.alias("dt"), lang.alias("lang"), dir_.alias("dir"))


def literal(lex: Column, dt: str | Column, lang: Column | None = None, dir_: Column | None = None) -> Column:
    """A literal term; null if the lexical form is null."""
    dt = F.lit(dt) if isinstance(dt, str) else dt
    return F.when(lex.isNotNull(), make(F.lit(LITERAL), lex, dt, F.lit("") if lang is None else lang, F.lit("") if dir_ is None else dir_))


def iri(text: Column) -> Column:
    e = F.lit("")
    return F.when(text.isNotNull(), make(F.lit(IRI_KIND), text, e, e, e))


def bnode(label: Column) -> Column:
    e = F.lit("")
    return F.when(label.isNotNull(), make(F.lit(BNODE), label, e, e, e))


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quoted(text: str) -> str:
    return '"' + "".join(_ESCAPES.get(c, c) for c in text) + '"'


def to_nt(term) -> str:
    """N-Triples form; the canonical key of a triple term."""
    if isinstance(term, IRI):
        return f"<{term.value}>"
    if isinstance(term, BNode):
        return f"_:{term.label}"
    if isinstance(term, TripleTerm):
        return f"<<( {to_nt(term.s)} {to_nt(term.p)} {to_nt(term.o)} )>>"
    out = quoted(term.lex)
    if term.lang:
        return f"{out}@{term.lang}" + (f"--{term.dir}" if term.dir else "")
    return out if term.dt == STRING else f"{out}^^<{term.dt}>"


def nt_column(t: Column) -> Column:
    """N-Triples form of a term column."""
    lex = t["lex"]
    for a, b in _ESCAPES.items():
        lex = F.replace(lex, F.lit(a), F.lit(b))
    text = F.concat(F.lit('"'), lex, F.lit('"'))
    tagged = F.concat(text, F.lit("@"), t["lang"], F.when(t["dir"] != "", F.concat(F.lit("--"), t["dir"])).otherwise(F.lit("")))
    lit_ = F.when(t["lang"] != "", tagged).when(t["dt"] == STRING, text).otherwise(F.concat(text, F.lit("^^<"), t["dt"], F.lit(">")))
    return F.when(t["kind"] == IRI_KIND, F.concat(F.lit("<"), t["lex"], F.lit(">"))).when(t["kind"] == BNODE, F.concat(F.lit("_:"), t["lex"])).when(t["kind"] == TRIPLE, t["lex"]).otherwise(lit_)


def from_parts(kind: int, lex: str, dt: str, lang: str, dir_: str):
    """The inverse of ``parts``."""
    if kind == IRI_KIND:
        return IRI(lex)
    if kind == BNODE:
        return BNode(lex)
    if kind == LITERAL:
        return Lit(lex, dt, lang, dir_)
    from quadlake.parser.turtle import parse_term

    return parse_term(lex)


def number_text(value: float) -> str:
    """Canonical xsd:double form, such as 1.0E0."""
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "INF" if value > 0 else "-INF"
    mantissa, _, exponent = f"{value!r}".lower().partition("e")
    if exponent or value == 0:
        digits = mantissa if "." in mantissa else mantissa + ".0"
        return f"{digits}E{int(exponent or 0)}"
    from decimal import Decimal

    sign, ds, exp = Decimal(mantissa).as_tuple()
    text = "".join(map(str, ds)).lstrip("0")
    power = len(text) + exp - 1
    text = text.rstrip("0") or "0"
    return ("-" if sign else "") + f"{text[0]}.{text[1:] or '0'}E{power}"
