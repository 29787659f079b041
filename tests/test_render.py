from graphspark.operators import pages, render
from graphspark.schema import TRIPLES
from graphspark.streaming.latest import latest_values
from pyspark.sql import functions as F

PATHS = [("P1", "packages/Serilog.md"), ("N", "namespaces/Shop.md"), ("T", "types/Shop/Cart.md"), ("a", "methods/a.md"), ("b", "methods/b.md"), ("proj", "projects/App.md"), ("R", "repositories/repo.md")]


def _frames(spark):
    paths = spark.createDataFrame(PATHS, "id string, path string")
    flat = spark.createDataFrame([("P1", "N", "Shop", "T", "Cart", "a", "Cart.A()", 3), ("P1", "N", "Shop", "T", "Cart", "b", "Cart.B()", 5), ("P1", None, "<global>", "T", "Cart", "a", "Cart.A()", 1)], "package_id string, namespace_id string, namespace_name string, type_id string, type_name string, method_id string, signature string, uses long")
    methods = spark.createDataFrame([("a", "A", "Cart.A()", "Method", "Public", 1, "T", "void", ["int"]), ("b", ".ctor", "Cart.B()", "Constructor", "Public", 0, "T", None, [])], "id string, name string, signature string, kind string, accessibility string, arity int, type_id string, return_type string, parameter_types array<string>")
    return paths, flat, methods


def test_package_page(spark):
    paths, flat, _ = _frames(spark)
    packages = spark.createDataFrame([("P1", "Serilog", "serilog", ["3.1.0"], [], [("src/p.csproj", "App", "proj", "3.1.0", None)])], "id string, name string, canonical_key string, declared_versions array<string>, resolved_versions array<string>, memberships array<struct<project_path: string, project_name: string, project_id: string, declared_version: string, resolved_version: string>>")
    page = render.package_pages(packages, paths, F.lit("r"), flat, flat.filter("false")).first()
    assert page.relative_path == "packages/Serilog.md" and "| [[projects/App|App]] | `src/p.csproj` | `3.1.0` | `-` |" in page.markdown
    tree = page.markdown.split("## Declaration Dependency Usage\n")[1].split("\n")
    assert tree == ["- [[namespaces/Shop|Shop]] (8)", "  - [[types/Shop/Cart|Cart]] (8)", "    - [[methods/b|Cart.B()]] (5)", "    - [[methods/a|Cart.A()]] (3)", "- <global> (1)", "  - [[types/Shop/Cart|Cart]] (1)", "    - [[methods/a|Cart.A()]] (1)"]
    assert "Method Body" not in page.markdown


def test_method_and_type_pages(spark):
    paths, _, methods = _frames(spark)
    types = spark.createDataFrame([("T", "Cart", "Shop.Cart", "Class", "Public", 0, True, [("Base", "X", "ExternalStub")], None)], "id string, name string, path string, kind string, accessibility string, arity int, is_partial_type boolean, bases array<struct<text: string, target_id: string, status: string>>, interfaces array<struct<text: string, target_id: string, status: string>>")
    members = spark.createDataFrame([("f", "total", "Field", "T", "int", None), ("e", "Paid", "EnumMember", "T", None, "2")], "id string, name string, kind string, type_id string, declared_type string, constant_value string")
    relations = spark.createDataFrame([("Calls", "a", "b", None, None, None, "Resolved", None), ("Calls", "a", None, None, "x", "Foo()", "Unresolved", "symbol-unresolved"), ("WritesField", "a", None, "f", None, None, "Resolved", None)], "kind string, source_method_id string, target_method_id string, target_member_id string, external_type_id string, external_type_name string, status string, reason string")
    places = spark.createDataFrame([("a", "c.cs", 3, 5)], "s string, path string, line int, column int")
    found = {p.relative_path: p.markdown for p in render.method_pages(methods, types, relations, members, places, paths, F.lit("r")).collect()}
    a, b = found["methods/a.md"], found["methods/b.md"]
    assert "# Method: A<T1>(int)" in a and "## Calls\n- [[methods/b|ctor()]]\n- Foo() (unresolved, reason: symbol-unresolved)" in a and "## Writes\n- total (field)" in a and "- `c.cs:3:5`" in a
    assert "## Called By\n- [[methods/a|A<T1>(int)]]" in b and "- Return Type: none" in b
    counted = pages.read_write_counts(members.withColumnRenamed("id", "member_id"), relations).withColumnRenamed("member_id", "id")
    rollup = spark.createDataFrame([("T", "P1", 4, 0, 0, 0), ("T", None, 0, 0, 2, 0)], "type_id string, package_id string, declaration_uses long, body_uses long, declaration_unknown long, body_unknown long")
    packages = spark.createDataFrame([("P1", "Serilog")], "id string, name string")
    page = render.type_pages(types, counted, methods, rollup, packages, paths, F.lit("r")).first().markdown
    assert "| total | 0 | 1 |" in page and "- Paid = 2" in page and "- Base (externalstub)" in page and "field_count: 1" in page
    assert "- [[packages/Serilog|Serilog]] (4)\n- Unknown package attribution (2)\n### Method Body Packages\n- none" in page


def test_repository_page(spark):
    paths, _, _ = _frames(spark)
    repository = spark.createDataFrame([("R", "repo", "/r", "main", "main")], "id string, name string, path string, head_branch string, mainline_branch string")
    types = spark.createDataFrame([("T", "Cart", "Shop.Cart")], "id string, name string, path string")
    modules = spark.createDataFrame([("mods/a", "u")], "path string, url string")
    page = render.repository_page(repository, {"Types": types}, types.filter("false"), types.filter("false"), types, modules, paths).first()
    assert "- Types: 1\n- Index" in page.markdown and page.markdown.endswith("- `mods/a` (u)") and "## Types\n- [[types/Shop/Cart|Cart]]" in page.markdown


def test_unique_paths_settle_clashes(spark):
    rows = spark.createDataFrame([("1", "a/x.md", "a/x--c.md", 1), ("2", "a/X.md", "a/x--c.md", 2), ("3", "a/x.md", "a/x--c.md", 3), ("4", "a/x--c--2.md", "a/x--c--2.md", 4)], "id string, candidate string, fallback string, n int")
    assert {r.id: r.path for r in pages.unique_paths(rows, "n").collect()} == {"1": "a/x.md", "2": "a/x--c.md", "3": "a/x--c--3.md", "4": "a/x--c--2.md"}


def test_latest_values_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "e", "core:hasName", "L", None, "old"), (5, "e", "core:hasName", "L", None, "new"), (2, "e", "core:calls", "E", "x", None)], TRIPLES).write.parquet(f"{tmp_path}/in")
    stream = latest_values(spark.readStream.schema(TRIPLES).parquet(f"{tmp_path}/in"))
    done = stream.writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    done.awaitTermination(60)
    assert [tuple(r) for r in spark.table("latest").collect()] == [("e", "core:hasName", "new", 5)]


def test_unknown_page_is_its_lines_in_order(spark):
    """The lines as rows lay out the page; no row or array holds them all."""
    paths, flat, _ = _frames(spark)
    more = flat.drop("package_id").withColumns({"reference": F.concat(F.lit("X."), "method_id"), "attribution_reason": F.lit("no_project_scoped_match"), "resolution_reason": F.lit(None).cast("string")})
    body = more.filter("method_id = 'b'").withColumn("uses", F.lit(7).cast("long"))
    lines = render.unknown_lines(more.withColumn("part", F.lit("D")).unionByName(body.withColumn("part", F.lit("R"))), paths, "part")
    found = {s: [r.line for r in lines.filter(F.col("section") == s).orderBy(*render.ORDER).collect()] for s in "DR"}
    page = render.unknown_page(more, body, paths, "r").first().markdown.split("\n## ")
    assert [p.split("\n")[1:] for p in page[1:]] == [[*found["D"], ""], found["R"]] and len(found["D"]) == 7 and len(found["R"]) == 3
    assert found["R"][2] == "    - [[methods/b|Cart.B()]] -> `X.b` (attribution: no_project_scoped_match) (7)"


def test_unknown_page_query_makes_no_row_of_the_whole_page(spark):
    from graphspark.plans import catalog

    plan = catalog.queries()["unknown_page"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "split(" not in plan
