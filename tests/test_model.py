"""Hand-built triples through the read model, and the sinks."""

import json

import pytest
from graphspark import cli
from graphspark.functions import ids, text
from graphspark.operators import model, relations
from graphspark.operators.metadata import entity_metadata
from graphspark.schema import RELATIONS, TRIPLES, is_a, ontology_problems
from graphspark.sinks import publisher
from pyspark.sql import functions as F


class Graph:
    def __init__(self):
        self.rows = []

    def entity(self, id_, kind, name=None, **literals):
        for p, v in {"entityType": kind, "hasName": name or id_, "hasPath": id_, **literals}.items():
            self.rows.append((len(self.rows), id_, f"core:{p}", "L", None, v))
        return self

    def edge(self, s, p, o):
        self.rows.append((len(self.rows), s, f"core:{p}", "E", o, None))
        return self

    def frame(self, spark):
        return spark.createDataFrame(self.rows, TRIPLES)


def small():
    g = Graph().entity("repo", "repository", headBranch="main").entity("T", "type-declaration", typeKind="CLASS", accessibility="public").entity("I", "type-declaration", typeKind="interface")
    for m in ("a", "b"):
        g.entity(m, "method-declaration", methodKind="method").edge("T", "containsMethod", m)
    g.entity("f", "member-declaration", memberKind="field").entity("p", "member-declaration", memberKind="property")
    g.edge("T", "containsMember", "f").entity("x", "method-parameter", parameterOrdinal="0", hasDeclaredTypeText="int").edge("a", "hasMethodParameter", "x")
    for p, o in (("implementsMethod", "b"), ("overridesMethod", "b"), ("calls", "b"), ("calls", "b"), ("readsProperty", "p"), ("writesProperty", "p"), ("readsField", "f"), ("writesField", "f")):
        g.edge("a", p, o)
    return g


def test_all_relation_kinds_resolve(spark):
    t = small().frame(spark)
    m = entity_metadata(t)
    methods = model.of_type(m, "method-declaration").select(F.col("id").alias("method_id"))
    found = relations.method_relations(t, methods, m).collect()
    assert sorted(r.kind for r in found) == sorted(RELATIONS) and {r.status for r in found} == {"Resolved"}


def test_parameters_fall_back_to_text(spark):
    t = small().frame(spark)
    row = model.parameters(t, entity_metadata(t)).first()
    assert (row.type, row.type_status, row.ordinal) == ("int", "SourceTextFallback", 0)


def test_members_without_a_type_are_dropped(spark):
    t = small().frame(spark)
    assert [(r.id, r.kind) for r in model.members(t, entity_metadata(t)).collect()] == [("f", "Field")]


def test_last_value_wins_and_names_default_to_ids(spark):
    g = Graph().entity("r", "repository", headBranch="a")
    g.rows += [(50, "r", "core:headBranch", "L", None, "b"), (60, "only", "core:editCount", "L", None, "x7")]
    got = {r.id: r for r in entity_metadata(g.frame(spark)).collect()}
    assert got["r"].head_branch == "b" and (got["only"].name, got["only"].edit_count) == ("only", 0)


def test_schema_and_ontology():
    assert ontology_problems("1.0", ["core:calls"]) == [] and len(ontology_problems(" ", [None, "x"])) == 2
    with pytest.raises(ValueError):
        is_a("nothing")


def test_text_functions(spark):
    row = spark.range(1).select(
        text.parse_bool(F.lit(" TRUE ")).alias("t"), text.parse_bool(F.lit("yes")).alias("y"), text.parse_int(F.lit("x"), -1).alias("i"), text.plain_reference(F.lit(" global::A.B<C> ")).alias("r"),
        text.could_be_external(F.lit("int?")).alias("e"), text.path_segment(F.lit("  a / b!!c- ")).alias("s"), text.page_path(F.lit("//")).alias("p"), text.clamp_segment(F.lit("x" * 130)).alias("c"),
        text.escape_pipes(F.lit("a|b")).alias("k"), text.snake_case(F.lit("NoProjectScopedMatch")).alias("n"), ids.stable_id("file", F.lit("a")).alias("d"),
        ids.method_key(F.lit("asm"), F.lit(" T "), F.lit("M"), F.lit(1), F.array(F.lit(" int "), F.lit("string"))).alias("m"), ids.namespace_key(F.lit(" ")).alias("g"),
    ).first()
    assert (row.t, row.y, row.i, row.r, row.e, row.s, row.p, len(row.c)) == (True, False, -1, "A.B", False, "a-b-c", "file", 120)
    assert (row.k, row.n, row.m, row.g) == ("a\\|b", "no_project_scoped_match", "method::asm::T::M::1::int|string", "namespace::<global>") and row.d.startswith("file:")


def test_publishing(spark, tmp_path):
    t = small().frame(spark)
    pages = spark.createDataFrame([("types/T.md", "# T"), ("index/i.md", "# I")], "relative_path string, markdown string")
    diagnostics = spark.createDataFrame([("a",), ("a",), ("b",)], "code string")
    done = publisher.publish(t, pages, diagnostics, tmp_path)
    assert done.succeeded and done.promoted and done.edges == t.count() and done.pages == 2
    written = json.loads((tmp_path / "latest/manifest.json").read_text())
    assert written["edgeCount"] == t.count() and written["diagnostics"] == [{"code": "a", "count": 2}, {"code": "b", "count": 1}]
    first = (tmp_path / "latest/graph.graphml").read_text()
    assert first.count("<edge ") == t.count() and (tmp_path / "latest/wiki/types/T.md").read_text() == "# T\n"
    again = publisher.publish(t, pages, diagnostics, tmp_path)
    assert (tmp_path / "runs" / again.run_id / "graph.graphml").read_text() == first
    broken = publisher.publish(t, pages, diagnostics, tmp_path, violations=[f"v{i:02d}" for i in range(25)])
    assert not broken.succeeded and not broken.promoted and "and 5 more" in broken.reason
    assert not publisher.publish(t, pages, diagnostics, tmp_path, failed=True).promoted


def test_graphml_is_in_numeric_order_and_valid(spark, tmp_path, monkeypatch):
    import xml.etree.ElementTree as ET

    from graphspark.operators import publish

    monkeypatch.setattr(publisher, "numbered_nodes", lambda t: publish.numbered_nodes(t).selectExpr("concat('n', 999990 + cast(substr(node_id, 2) as int)) AS node_id", "key", "kind", "label"))
    rows = [(i, f"s{i}", "core:hasName", "L", None, f"a\x01<{i}\ufffe") for i in range(12)]
    nodes, _ = publisher.write_graphml(spark.createDataFrame(rows, TRIPLES), tmp_path / "g.xml")
    ids = [int(n.get("id")[1:]) for n in ET.parse(tmp_path / "g.xml").iter("{http://graphml.graphdrawing.org/xmlns}node")]
    assert nodes == 24 and ids == list(range(999991, 1000015))


def test_branches_and_empty_runs(spark, tmp_path):
    t = spark.createDataFrame([(2, "r", "core:headBranch", "L", None, "late"), (1, "r", "core:headBranch", "L", None, "main"), (1, "r", "core:mainlineBranch", "L", None, " ")], TRIPLES)
    none, diagnostics = publisher.no_run(spark)
    assert none.count() == diagnostics.count() == 0 and publisher.publish_nothing(t, None).succeeded
    publisher.publish(t, spark.createDataFrame([], "relative_path string, markdown string"), diagnostics, tmp_path, repository_id="r")
    written = json.loads((tmp_path / "latest/manifest.json").read_text())
    assert (written["headBranch"], written["mainlineBranch"]) == ("main", "unknown")


def test_closure_meets_nodes_in_the_order_of_edges(spark):
    from graphspark.operators.closure import base_types

    edges = [("a", "z", 1), ("a", "b", 2), ("z", "y", 9), ("z", "c", 4), ("b", "x", 3), ("x", "a", 5), ("c", "t", 6), *[(f"n{i}", f"n{i + 1}", i) for i in range(12)]]
    found = base_types(spark.createDataFrame(edges, "s string, o string, seq long"))
    assert [r.o for r in found.filter("s = 'a'").orderBy("depth", "trail").collect()] == ["z", "b", "c", "y", "x", "t", "a"]
    assert found.filter("s = 'n0'").count() == 12 and base_types(spark.createDataFrame([], "s string, o string")).count() == 0


def test_unknown_methods_are_no_unknown_projects(spark):
    from graphspark.operators import usage

    uses = spark.createDataFrame([("m1", "A.B"), ("m2", "A.B"), ("m3", "A.B"), ("m1", "C")], "method_id string, reference string")
    methods, of = spark.createDataFrame([("m1",), ("m2",)], "method_id string"), spark.createDataFrame([("m1", "p")], "method_id string, project_id string")
    packages = spark.createDataFrame([("k", "A", "a")], "package_id string, name string, canonical_key string")
    got = usage.attributions(uses, methods, of, spark.createDataFrame([("p", "k")], "project_id string, package_id string"), packages).collect()
    assert {(r.method_id, r.reference): r.reason for r in got} == {("m1", "A.B"): "None", ("m2", "A.B"): "SourceProjectNotFound", ("m3", "A.B"): "SourceMethodNotFound", ("m1", "C"): "NoProjectScopedMatch"}


def test_options(tmp_path):
    config = tmp_path / "c.json"
    config.write_text('{"path": "from-config", "max_merge_entries_per_file": 3, "other": 1}')
    got = cli.options(["ingest", "-c", str(config), "-m", "2"])
    assert (got["path"], got["max_merge_entries_per_file"], got["output"]) == ("from-config", 2, "artifacts")
    assert cli.options(["ingest", "-c", "missing.json"])["path"] == "."


def test_predicate_counts_tell_ids_from_literals_and_nulls(spark):
    """Counted against plain distinct counts, over more predicates than a word has bits."""
    from graphspark.operators.edges import predicate_counts
    from graphspark.schema import PREDICATES, TRIPLES

    rows = [(i, f"t:{i % 3}", PREDICATES[i % len(PREDICATES)], "E" if i % 2 else "L", f"t:{i % 5}" if i % 2 else None, None if i % 2 or i % 7 == 0 else f"t:{i % 5}") for i in range(400)]
    rows += [(900, "t:0", PREDICATES[0], "L", None, "t:1"), (901, "t:0", PREDICATES[0], "E", "t:1", None)]
    want = {}
    for seq, s, p, kind, o, v in rows:
        n, ss, oo, last = want.get(p, (0, set(), set(), 0))
        want[p] = (n + 1, ss | {s}, oo | ({(kind, o or v)} if (o or v) is not None else set()), max(last, seq))
    got = {r.p: (r.triples, r.subjects, r.objects, r.last_seq) for r in predicate_counts(spark.createDataFrame(rows, TRIPLES), list(PREDICATES)).collect()}
    assert got == {p: (n, len(ss), len(oo), last) for p, (n, ss, oo, last) in want.items()}



def test_whole_graph_queries_store_no_triples(spark, monkeypatch):
    from graphspark.plans import catalog, fixture

    def refuse(*_, **__):
        raise AssertionError("stored")

    monkeypatch.setattr(fixture, "stored", refuse)
    for name in ("triples_all", "methods_table", "graphml_nodes", "graphml_edges"):
        catalog.queries()[name](spark, "/root/testdata/sf0.001")


def test_plain_triples_hash_to_the_stored_ones(spark):
    from pyspark.sql import functions as F

    from graphspark.functions.ids import hashed
    from graphspark.plans import fixture

    sf = "/root/testdata/sf0.001"
    plain = fixture.plain(spark, sf).select("seq", hashed(F.col("s")).alias("s"), "p", "o_kind", hashed(F.col("o_id")).alias("o_id"), "o_value")
    there = fixture.triples(spark, sf)
    assert plain.count() == there.count() and plain.exceptAll(there).count() == 0


def test_nodes_and_edges_are_numbered_in_order_whatever_the_ids(spark):
    """Ids without a colon, with short or equal starts, and one subject of many triples."""
    from graphspark.operators.publish import numbered_edges, numbered_nodes
    from graphspark.schema import TRIPLES

    names = ["a", "a\nb", "a\x01z", "ab", "ab:", "ab:0", "ab:00zz", "abc:0", "abc:000", "b:éé", "file:1"]
    rows = [(i, s, "core:calls", "E", o, None) for i, (s, o) in enumerate((s, o) for s in names for o in names)] + [(1000 + i, "file:1", "core:hasName", "L", None, f"v{i % 40}" if i % 9 else None) for i in range(200)]
    t = spark.createDataFrame(rows, TRIPLES)
    nodes = numbered_nodes(t).collect()
    assert [r.key for r in sorted(nodes, key=lambda r: r.node_id)] == sorted({r.key for r in nodes}, key=str.encode)
    assert sorted(r.node_id for r in nodes) == [f"n{i:06d}" for i in range(1, len(nodes) + 1)] and len(nodes) == len(names) + 41
    edges = sorted(numbered_edges(t).collect(), key=lambda r: r.edge_id)
    assert [r.edge_id for r in edges] == [f"e{i:06d}" for i in range(1, len(rows) + 1)]
    assert [r.seq for r in edges] == [r.seq for r in sorted(edges, key=lambda r: (r.source.encode(), r.predicate.encode(), r.target.encode(), r.seq))]


def test_edges_are_dealt_as_packed_rows_of_views_not_as_texts(spark):
    from graphspark.plans import catalog

    plan = catalog.queries()["graphml_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "bundle" in plan and "o_value" not in plan


def test_packed_numbers_come_back(spark):
    from graphspark.plans.fixture import Packing

    p = Packing({"a": 0, "b": 7, "c": (1 << 40) - 1, "d": 1 << 30}, "n")
    rows = [(0, 7, (1 << 40) - 1, 1 << 30), (None, 0, None, 5), (0, None, 3, None)]
    df = spark.createDataFrame(rows, "a int, b long, c long, d long").selectExpr(*p.packed())
    assert df.columns == p.longs == ["n0", "n1"]
    assert [tuple(r) for r in df.selectExpr(*p.unpacked().values()).collect()] == rows
