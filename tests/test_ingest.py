"""A run end to end over a small repository made here."""

from __future__ import annotations

import json
import os
import subprocess
import xml.etree.ElementTree as ET

import pytest
from graphspark import cli, ingest

FILES = {
    "App.sln": 'Project("{FAE04EC0}") = "Shop", "src\\Shop\\Shop.csproj", "{1}"\nEndProject\n',
    "src/Shop/Shop.csproj": '<Project Sdk="x"><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup><ItemGroup><PackageReference Include="Serilog" Version="3.1.0" /></ItemGroup></Project>',
    "src/Shop/Base.cs": "namespace Shop;\npublic interface IRun { void Run(int n); }\npublic class Base { public virtual void Go() { } public enum Mode { A, B = 4, C } }\n",
    "src/Shop/Cart.cs": "using System;\nusing S = Shop;\nnamespace Shop.Orders\n{\n    public partial class Cart : S.Base, IRun, IDisposable\n    {\n        private Serilog.ILogger log;\n        public int Total { get; set; }\n        public Cart(int n) { }\n        public override void Go() { }\n        public void Run(int n) { }\n        public Serilog.Core.Logger Make(string[] names) { return null; }\n    }\n}\n",
    "README.md": "# Shop\n",
}


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("r") / "shop"
    env = os.environ | {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "a@x", "GIT_CONFIG_GLOBAL": "/dev/null"}
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    for args in (["init", "-q", "-b", "main"], ["add", "-A"], ["commit", "-qm", "one"]):
        subprocess.run(["git", "-C", str(root), *args], check=True, env=env)
    return root


def test_a_run(spark, repository, tmp_path):
    options = cli.options(["ingest", "-p", str(repository), "-r", str(tmp_path / "out"), "-a"])
    done = ingest.ingest(spark, options)
    assert done.succeeded and done.promoted and done.exit_code == 0
    latest = tmp_path / "out/latest"
    manifest = json.loads((latest / "manifest.json").read_text())
    assert (manifest["headBranch"], manifest["mainlineBranch"], manifest["pageCount"]) == ("main", "main", done.pages)
    wiki = {str(p.relative_to(latest / "wiki")): p.read_text() for p in (latest / "wiki").rglob("*.md")}
    assert {"repositories/shop.md", "solutions/App.sln.md", "projects/Shop.md", "packages/Serilog.md", "namespaces/Shop/Orders.md", "types/Shop/Orders/Cart.md", "files/src/Shop/Cart.cs.md", "index/repository-index.md"} <= wiki.keys()
    cart = wiki["types/Shop/Orders/Cart.md"]
    assert "- Base (resolved)" in cart and "- IRun (resolved)" in cart and "- IDisposable (externalstub)" in cart and "- Total: int" in cart and "is_partial" not in cart.split("---")[0]
    assert "- [[packages/Serilog|Serilog]] (1)" in cart, "the return type is a use of the project's package"
    mode = wiki["types/Shop/Base/Mode.md"]
    assert "- A = 0" in mode and "- B = 4" in mode and "- C = 5" in mode
    runs = next(text for path, text in wiki.items() if path.startswith("methods/Shop/Orders/Cart/Run"))
    goes = next(text for path, text in wiki.items() if path.startswith("methods/Shop/Orders/Cart/Go"))
    assert "## Implements\n- [[methods/Shop/IRun/Run" in runs and "## Overrides\n- [[methods/Shop/Base/Go" in goes
    assert "| [[projects/Shop|Shop]] | `src/Shop/Shop.csproj` | `3.1.0` | `-` |" in wiki["packages/Serilog.md"] and "## Declaration Dependency Usage" in wiki["packages/Serilog.md"]
    assert "- edit_count: 1" in wiki["files/README.md.md"] and "[[types/Shop/Orders/Cart|Cart]]" in wiki["files/src/Shop/Cart.cs.md"]
    assert "## Types" in wiki["index/repository-index.md"] and "[[types/Shop/Base|Base]]" in wiki["index/repository-index.md"]
    graph = ET.parse(latest / "graph.graphml").getroot()
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(list(graph.iter(f"{ns}node"))) == done.nodes and len(list(graph.iter(f"{ns}edge"))) == done.edges > 100


def test_bound_facts_and_diagnostics(spark, repository):
    found = ingest.discover(spark, str(repository))
    of = {(r.s, r.o_value) for r in found.triples.filter("p = 'core:hasName' AND s LIKE 'method-declaration:%'").collect()}
    go, run = (next(s for s, n in of if n == name) for name in ("Go", "Run"))
    rows = [(run, "core:calls", "E", go, None), (run, "core:dependsOnTypeInMethodBody", "E", "external-type-stub:x", None), ("external-type-stub:x", "core:entityType", "L", None, "external-type-stub"), ("external-type-stub:x", "core:hasName", "L", None, "Other.Thing")]
    bound = spark.createDataFrame(rows, ingest.FACTS)
    pages = {r.relative_path: r.markdown for r in ingest.pages_of(ingest.discover(spark, str(repository), bound)).collect()}
    assert list(pages) == sorted(pages)
    assert any("## Called By\n- [[methods/" in text for path, text in pages.items() if "/Go" in path)
    codes = {r.code for r in found.diagnostics.collect()}
    assert codes == {"type:resolution:fallback"}, "string[] is no plain name"
    assert "string[]" in pages["packages/unknown-package-attribution.md"]


def test_a_missing_repository(spark, tmp_path):
    done = ingest.ingest(spark, cli.options(["ingest", "-p", str(tmp_path / "none"), "-r", str(tmp_path / "out")]))
    assert done.exit_code == 1 and not done.promoted and done.diagnostics == {"repository:path:not-found": 1}
