"""RDF text in and out.

N-Triples and N-Quads are read line by line in parallel; Turtle and TriG documents are read whole, one
task a file, each with its own scope of blank nodes. Documents behind http(s) are copied to the shared folder first.
N-Quads, N-Triples and, with ``write_turtle_parts``, Turtle and TriG are written in parallel; ``write_turtle`` makes one
text of a graph that fits in the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake import terms as R
from quadlake.parser.turtle import parse_turtle
from quadlake.scratch import shared_folder
from quadlake.sources.catalog import QUADS

LINES = (".nt", ".nq", ".ntriples", ".nquads")


#: Media types of line-based formats.
LINE_TYPES = ("application/n-triples", "application/n-quads", "text/plain")
CHUNK = 1 << 20
#: Triples spelled at once in a part.
PART_ROWS = 50_000


def fetch(spark: SparkSession, url: str, timeout: float = 60.0) -> str:
    """Copy a document to the shared folder, a chunk at a time; the copy's suffix tells its format."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"Accept": "application/n-quads, application/n-triples, text/turtle, application/trig;q=0.9, */*;q=0.1"}), timeout=timeout) as reply:
        kind = reply.headers.get_content_type()
        plain = url.split("#")[0].split("?")[0].lower()
        lines = plain.endswith(LINES) or (kind in LINE_TYPES and not plain.endswith((".ttl", ".trig")))
        path = f"{shared_folder(spark)}/loads/{uuid.uuid4().hex}{'.nq' if lines else '.trig'}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
        try:
            while chunk := reply.read(CHUNK):
                out.write(bytearray(chunk))
        finally:
            out.close()
    return path


def load(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """Quads of a file, folder or URL, by its suffix (a URL's also by its media type): .nt and .nq by lines, anything else as Turtle or TriG."""
    if path.lower().startswith(("http://", "https://")):
        return load(spark, fetch(spark, path), path if base is None else base)
    if path.lower().removesuffix(".gz").endswith(LINES):
        return read_lines(spark, path)
    return read_documents(spark, path, base)


def _rows(quads) -> list[tuple]:
    return [(R.parts(s), p.value, R.parts(o), None if g is None else g.value if isinstance(g, R.IRI) else "_:" + g.label) for s, p, o, g in quads]


def _frame(rows: list[tuple]):
    import pyarrow as pa

    term = pa.struct([("kind", pa.int32()), *((n, pa.string()) for n in ("lex", "dt", "lang", "dir"))])

    def terms(i):
        return pa.array([dict(zip(("kind", "lex", "dt", "lang", "dir"), r[i], strict=True)) for r in rows], term)

    return pa.RecordBatch.from_arrays([terms(0), pa.array([r[1] for r in rows], pa.string()), terms(2), pa.array([r[3] for r in rows], pa.string())], ["s", "p", "o", "g"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples or N-Quads; blank node labels are scoped to the load."""
    scope = "x" + uuid.uuid4().hex[:8]

    def run(batches):
        for batch in batches:
            lines = [x for x in batch.column(0).to_pylist() if x and x.strip() and not x.lstrip().startswith("#")]
            yield _frame(_rows(parse_turtle("\n".join(lines), scope=scope)))

    return spark.read.text(path).mapInArrow(run, QUADS).dropDuplicates()


def read_documents(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    files = spark.read.option("wholetext", True).text(path).select("value", F.input_file_name().alias("file"))
    salt = uuid.uuid4().hex[:8]

    def run(batches):
        import zlib

        for batch in batches:
            for text, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scope = f"x{salt}{zlib.crc32(file.encode()):08x}"
                yield _frame(_rows(parse_turtle(text, base if base is not None else file, scope)))

    return files.mapInArrow(run, QUADS).dropDuplicates()


def write_lines(quads: DataFrame, path: str, named: bool = True, mode: str = "error") -> None:
    """N-Quads, or N-Triples with ``named`` off: then a named graph is an error."""
    line = F.concat_ws(" ", R.nt_column(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), R.nt_column(F.col("o")), F.when(F.col("g").startswith("_:"), F.col("g")).otherwise(F.concat(F.lit("<"), F.col("g"), F.lit(">"))), F.lit("."))
    if not named and not quads.where(F.col("g").isNotNull()).isEmpty():
        raise ValueError("N-Triples has no named graphs")
    quads.select(line.alias("value")).write.mode(mode).text(path)


def collect(quads: DataFrame) -> list[tuple]:
    """Driver-side quads of a small graph."""
    out = []
    for r in quads.collect():
        g = r["g"] if "g" in quads.columns else None
        out.append((R.from_parts(*r["s"]), R.IRI(r["p"]), R.from_parts(*r["o"]), None if g is None else R.BNode(g[2:]) if g.startswith("_:") else R.IRI(g)))
    return out


def write_turtle(quads: list[tuple], prefixes: dict[str, str] | None = None) -> str:
    """Turtle, or TriG if there are named graphs; subjects and predicates are grouped with ; and ,."""
    import re

    prefixes = prefixes or {}

    def spell(x) -> str:
        if isinstance(x, R.IRI):
            for name, space in sorted(prefixes.items(), key=lambda kv: -len(kv[1])):
                local = x.value[len(space) :]
                if x.value.startswith(space) and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_\-]*", local):
                    return f"{name}:{local}"
            return f"<{x.value}>"
        if isinstance(x, R.TripleTerm):
            return f"<<( {spell(x.s)} {spell(x.p)} {spell(x.o)} )>>"
        if isinstance(x, R.Lit) and not x.lang and x.dt != R.STRING:
            return f"{R.quoted(x.lex)}^^{spell(R.IRI(x.dt))}"
        return R.to_nt(x)

    out = [f"@prefix {n}: <{s}> ." for n, s in sorted(prefixes.items())]
    graphs: dict = {}
    for s, p, o, g in sorted(quads, key=lambda q: tuple(map(repr, q))):
        graphs.setdefault(g, {}).setdefault(s, {}).setdefault(p, []).append(o)
    for g, subjects in graphs.items():
        pad = "  " if g is not None else ""
        if g is not None:
            out.append(f"{spell(g)} {{")
        for s, arcs in subjects.items():
            body = " ;\n".join(f"{pad}    {'a' if p.value == R.RDF_TYPE else spell(p)} {', '.join(spell(o) for o in os)}" for p, os in arcs.items())
            out.append(f"{pad}{spell(s)}\n{body} .")
        if g is not None:
            out.append("}")
    return "\n".join(out) + "\n"


def write_turtle_parts(quads: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    """Turtle or TriG in parallel: every part is a whole document with all triples of its graphs' subjects."""
    dealt = quads.repartition("g", "s").sortWithinPartitions("g", "s", "p", "o")

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []

        def out():
            text = write_turtle(held, prefixes)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([text])], ["value"])

        for batch in batches:
            for r in batch.to_pylist():
                g = None if r["g"] is None else R.BNode(r["g"][2:]) if r["g"].startswith("_:") else R.IRI(r["g"])
                if len(held) >= PART_ROWS and (held[-1][3], held[-1][0]) != (g, R.from_parts(*r["s"].values())):
                    yield out()
                held.append((R.from_parts(*r["s"].values()), R.IRI(r["p"]), R.from_parts(*r["o"].values()), g))
        if held:
            yield out()

    dealt.mapInArrow(run, "value string").write.text(path)
