"""A direct evaluator of a few algebra operators over lists of dicts, for comparison."""

from quadlake.parser import ast as A
from quadlake.terms import Var


def bgp(graph, triples):
    out = [{}]
    for t in triples:
        found = []
        for mu in out:
            for quad in graph:
                new = dict(mu)
                for x, v in zip(t, quad, strict=True):
                    if isinstance(x, Var):
                        if new.setdefault(x.name, v) != v:
                            break
                    elif x != v:
                        break
                else:
                    found.append(new)
        out = found
    return out


def compatible(a, b):
    return all(b.get(k, v) == v for k, v in a.items())


def group(graph, g):
    out = [{}]
    for p in g.parts:
        if isinstance(p, A.Triples):
            out = [a | b for a in out for b in bgp(graph, p.triples) if compatible(a, b)]
        elif isinstance(p, A.Group):
            out = [a | b for a in out for b in group(graph, p) if compatible(a, b)]
        elif isinstance(p, A.Union):
            right = [b for x in p.groups for b in group(graph, x)]
            out = [a | b for a in out for b in right if compatible(a, b)]
        elif isinstance(p, A.Optional_):
            right = group(graph, p.group)
            out = [m for a in out for m in ([a | b for b in right if compatible(a, b)] or [a])]
        elif isinstance(p, A.Minus):
            right = group(graph, p.group)
            out = [a for a in out if not any(compatible(a, b) and a.keys() & b.keys() for b in right)]
    return out
