import pytest

from quadlake.engine import Engine
from quadlake.parser.turtle import parse_turtle
from quadlake.sources import rdf
from quadlake.sources.catalog import Catalog
from quadlake.update import Conflict, Transaction, commit, snapshot

P = "PREFIX : <urn:x:> "


def engine(spark, text="@prefix : <urn:x:> . :a :p 1 . :b :p 2 . :g { :a :q 3 }"):
    return Engine(Catalog.of(spark, parse_turtle(text)))


def state(e):
    return sorted(((s.value, p.value, getattr(o, "lex", None) or getattr(o, "value", None), g and g.value) for s, p, o, g in rdf.collect(e.catalog.quads)), key=repr)


def test_data_and_modify(spark):
    e = engine(spark)
    new = e.update(P + "INSERT DATA { :a :p 1 . :c :p 4 } ; DELETE DATA { :b :p 2 } ; WITH :g DELETE { ?s :q ?o } INSERT { ?s :r ?o } WHERE { ?s :q ?o }")
    assert state(new) == [("urn:x:a", "urn:x:p", "1", None), ("urn:x:a", "urn:x:r", "3", "urn:x:g"), ("urn:x:c", "urn:x:p", "4", None)]
    assert len(state(e)) == 3  # the old catalog stands
    new = e.update(P + "INSERT { GRAPH ?o2 { ?s :p ?o } } WHERE { ?s :p ?o BIND(:h AS ?o2) }")
    assert new.catalog.named_graphs().count() == 2
    assert state(e.update(P + "DELETE WHERE { ?s :p ?o }")) == [("urn:x:a", "urn:x:q", "3", "urn:x:g")]


def test_graph_operations(spark):
    e = engine(spark)
    assert len(state(e.update(P + "COPY DEFAULT TO :g"))) == 4
    assert {g for *_, g in state(e.update(P + "MOVE :g TO DEFAULT"))} == {None}
    assert len(state(e.update(P + "ADD :g TO DEFAULT"))) == 4
    assert state(e.update("CLEAR ALL")) == [] and len(state(e.update("DROP NAMED"))) == 2
    assert len(state(e.update(P + "MOVE :g TO :g"))) == 3


def test_load_text_and_snapshots(spark, tmp_path):
    path = tmp_path / "d.ttl"
    path.write_text("@prefix : <urn:x:> . :n :p [ :q 1 ] .")
    e = engine(spark).update(f"LOAD <{path}> INTO GRAPH <urn:x:l>")
    assert e.catalog.count() == 5
    assert engine(spark).update("LOAD SILENT </no/such/file.ttl>").catalog.count() == 3
    rdf.write_lines(e.catalog.quads, str(tmp_path / "out.nq"))
    assert rdf.load(spark, str(tmp_path / "out.nq")).count() == 5
    text = rdf.write_turtle(rdf.collect(e.catalog.quads), {"": "urn:x:"})
    assert len(parse_turtle(text)) == 5
    commit(e.catalog, str(tmp_path / "store"))
    again = Engine(snapshot(spark, str(tmp_path / "store")))
    assert again.catalog.count() == 5 and again.ask(P + "ASK { :a :p 1 }")


def test_load_over_http(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    pages = {"/a.ttl": ("text/turtle", "<s> <p> <#o> , [] ."), "/lines": ("application/n-quads", "<urn:x:a> <urn:x:p> \"1\" <urn:x:g> .\n# note\n")}

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            kind, body = pages.get(self.path, (None, ""))
            self.send_response(200 if kind else 404)
            if kind:
                self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"http://127.0.0.1:{server.server_port}"
    try:
        e = Engine(Catalog(spark)).update(f"LOAD <{host}/a.ttl> INTO GRAPH <urn:x:l> ; LOAD <{host}/lines> ; LOAD SILENT <{host}/none>")
        assert e.ask(f"ASK {{ GRAPH <urn:x:l> {{ <{host}/s> <{host}/p> <{host}/a.ttl#o> }} }}") and e.ask(P + "ASK { GRAPH :g { :a :p '1' } }") and e.catalog.count() == 3
        with pytest.raises(Exception, match="404"):
            Engine(Catalog(spark)).update(f"LOAD <{host}/none>")
    finally:
        server.shutdown()


def test_sinks_in_parallel(spark, tmp_path):
    """Every part of a sink is a document of its own; together they hold the whole."""
    from xml.etree import ElementTree

    from quadlake.sources import results

    text = "@prefix : <urn:x:> . " + " ".join(f':s{i} :p {i} , "a\\nb"@en ; :q <<( :s{i} :p :o )>> .' for i in range(40)) + " :g { :a :b [] }"
    e = Engine(Catalog.of(spark, parse_turtle(text)))
    found = e.select(P + "SELECT ?s ?o ?none { ?s :p ?o }", "term").repartition(3)
    results.write_json(found, str(tmp_path / "json"))
    results.write_xml(found, str(tmp_path / "xml"))
    rows = [r for f in (tmp_path / "json").glob("part-*") for r in results.from_json(f.read_text())[1]]
    assert sorted(map(repr, rows)) == sorted(map(repr, results.solutions(found))) and len(rows) == 80
    assert sum(len(list(ElementTree.fromstring(f.read_text()).iter("{http://www.w3.org/2005/sparql-results#}result"))) for f in (tmp_path / "xml").glob("part-*")) == 80
    rdf.write_turtle_parts(e.catalog.quads, str(tmp_path / "ttl"), {"": "urn:x:"})
    parts = [q for f in (tmp_path / "ttl").glob("part-*") for q in parse_turtle(f.read_text())]
    assert len(parts) == e.catalog.count() == 121


def test_concurrent_commits(spark, tmp_path):
    """Of two transactions that start from one version, the second to end fails and changes nothing."""
    path = str(tmp_path / "store")
    assert commit(engine(spark).catalog, path) == 1
    first = Transaction(spark, path).__enter__()
    with pytest.raises(Conflict), Transaction(spark, path) as second:
        second.update(P + "INSERT DATA { :t :p 2 }")
        first.update(P + "INSERT DATA { :t :p 1 }")
        first.__exit__(None, None, None)
    with pytest.raises(Conflict):
        commit(engine(spark).catalog, path, expected=1)
    assert not Engine(snapshot(spark, path)).ask(P + "ASK { :t :p 2 }") and snapshot(spark, path, 1).count() == 3


def test_store_interface(spark):
    c = engine(spark).catalog
    from quadlake.terms import IRI

    assert c.count(p=IRI("urn:x:p")) == 2 and c.count(g=IRI("urn:x:g")) == 1
    assert c.remove_matches(s=IRI("urn:x:a")).count() == 1
