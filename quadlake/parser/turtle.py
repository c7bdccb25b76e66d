"""Turtle and TriG documents (N-Triples and N-Quads are subsets) as quads of terms."""

from __future__ import annotations

from quadlake.parser.sparql import TermReader
from quadlake.terms import IRI, BNode, TripleTerm


class TurtleParser(TermReader):
    def __init__(self, text: str, base: str = "", scope: str = ""):
        super().__init__(text, base)
        self.prefixes = {}
        self.scope = scope
        self.quads: list[tuple] = []

    def new_bnode(self) -> BNode:
        self.fresh += 1
        return BNode(f"g{self.fresh}{self.scope}")

    def named_bnode(self, label: str) -> BNode:
        return BNode(f"b{label}{self.scope}" if self.scope else label)

    def directive(self) -> bool:
        t = self.t
        at = t.kind == "lang" and t.value in ("@prefix", "@base", "@version")
        if not at and not t.word("PREFIX", "BASE", "VERSION"):
            return False
        word = t.next().lstrip("@").upper()
        if word == "VERSION":
            if t.kind != "string":
                raise t.problem("version needs a string")
            t.next()
        elif word == "BASE":
            self.base = self.resolve(t.next()[1:-1])
        else:
            if t.kind != "pname" or not t.value.endswith(":"):
                raise t.problem("a prefix needs a name", expected="prefix:")
            name = t.next()[:-1]
            if t.kind != "iri":
                raise t.problem("a prefix needs an IRI", expected="IRI")
            self.prefixes[name] = self.resolve(t.next()[1:-1])
        if at:
            t.need(".")
        return True

    def parse(self) -> list[tuple]:
        """[(s, p, o, graph or None)]"""
        t = self.t
        while t.kind != "end":
            if self.directive():
                continue
            if t.word("GRAPH"):
                t.next()
                self.block(self.label())
            elif t.at("{"):
                self.block(None)
            elif (self.at_iri() or t.kind == "bnode") and t.peek() == ("punct", "{"):
                self.block(self.label())
            elif t.at("[") and t.peek() == ("punct", "]") and t.peek(2) == ("punct", "{"):
                t.next()
                t.next()
                self.block(self.new_bnode())
            else:
                out: list = []
                self.subject_triples(out)
                graph = None
                if out and (self.at_iri() or t.kind == "bnode"):  # N-Quads
                    graph = self.label()
                self.add(out, graph)
                t.need(".")
        return self.quads

    def label(self):
        return self.iri() if self.at_iri() else self.named_bnode(self.t.next()[2:])

    def block(self, graph) -> None:
        t, out = self.t, []
        t.need("{")
        while not t.take("}"):
            self.subject_triples(out)
            if not t.take("."):
                t.need("}")
                break
        self.add(out, graph)

    def add(self, triples: list, graph) -> None:
        for s, p, o in triples:
            if not isinstance(s, (IRI, BNode)) or not isinstance(p, IRI):
                raise self.t.problem("a subject is an IRI or a blank node, a predicate an IRI")
            self.quads.append((s, p, o, graph))


def parse_turtle(text: str, base: str = "", scope: str = "") -> list[tuple]:
    return TurtleParser(text, base, scope).parse()


def parse_term(text: str):
    """One term in N-Triples form."""
    reader = TurtleParser(text)
    term = reader.node([])
    return term if isinstance(term, (IRI, BNode, TripleTerm)) or term is not None else None
