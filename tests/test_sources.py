import os
import subprocess

from graphspark.sources import csharp, git, readers

CODE = """
using System; using Acme.Core;
using X = Acme.Other;
namespace Shop.Orders;
// class NotThis {}
public partial class Cart<T> : BaseCart, IDisposable where T : class
{
    private readonly int _count = 3, _other;
    public string Name { get; set; } = "x;{";
    public int Total => _count;
    public Cart(int size) : base(size) { if (size > 1) { } }
    public override string ToString() { return "class Y {"; }
    internal static Task<List<T>> Load<U>(this Cart<U> cart, params string[] names, int n = 1) => null;
    void IDisposable.Dispose() { }
    protected internal enum State { New, Paid = 0x10, Done }
    public record Line(string Sku, int Count);
}
public interface IThing { void Run(); }
public delegate void Done(int x);
"""


def test_declarations_of_a_file():
    rows = csharp.Scanner("a.cs", CODE).scan()
    types = {r["name"]: r for r in rows if r["fact"] == "type"}
    assert list(types) == ["Cart", "State", "Line", "IThing", "Done"]
    assert types["Cart"]["bases"] == ["BaseCart", "IDisposable"] and types["Cart"]["arity"] == 1 and types["Cart"]["is_partial"]
    assert types["State"]["declaring_type"] == "Shop.Orders.Cart`1" and types["State"]["accessibility"] == "protectedinternal"
    methods = {r["name"]: r for r in rows if r["fact"] == "method"}
    assert set(methods) == {".ctor", "ToString", "Load", "IDisposable.Dispose", "Run"}
    assert methods["ToString"]["is_override"] and methods["Load"]["is_extension"] and methods["Load"]["arity"] == 1
    assert methods["Load"]["parameters"] == ["Cart<U>", "string[]", "int"] and methods["Load"]["type_text"] == "Task<List<T>>"
    members = {r["name"]: r for r in rows if r["fact"] == "member"}
    assert {n: m["kind"] for n, m in members.items()} == {"_count": "field", "_other": "field", "Name": "property", "Total": "property", "New": "enum-member", "Paid": "enum-member", "Done": "enum-member", "Sku": "record-parameter", "Count": "record-parameter"}
    assert members["_count"]["constant"] == "3" and members["Paid"]["constant"] == "0x10"
    assert rows[0]["imports"] == ["Acme.Core", "System"] and types["Cart"]["line"] == 6
    assert csharp.split_bases("class", ["IA", "Base", "IB"]) == (["Base"], ["IA", "IB"])
    assert csharp.Scanner("b.cs", "namespace {{{ class").scan() == []


def test_declarations_as_a_table(spark):
    files = spark.createDataFrame([("a.cs", CODE), ("b.cs", None)], "path string, text string")
    assert csharp.declarations(files).groupBy("fact").count().count() == 4


def test_project_files(spark):
    files = spark.createDataFrame([
        ("a/App.csproj", '<Project Sdk="x"><PropertyGroup><AssemblyName>My.App</AssemblyName><TargetFrameworks>net9.0; NET8.0;net8.0</TargetFrameworks></PropertyGroup><ItemGroup><PackageReference Include="Serilog" Version="3.1.0" /><PackageReference Update="Polly"><Version> 8 </Version></PackageReference></ItemGroup></Project>'),
        ("b/Broken.csproj", "<Project><unclosed"),
    ], "path string, text string")
    facts = {r.path: r for r in readers.project_facts(files).collect()}
    assert facts["a/App.csproj"].name == "My.App" and facts["a/App.csproj"].target_frameworks == ["NET8.0", "net9.0"]
    assert facts["b/Broken.csproj"].name == "Broken"
    assert sorted((r.package_id, r.declared_version) for r in readers.package_references(files).collect()) == [("Polly", "8"), ("Serilog", "3.1.0")]


def test_solutions(spark):
    files = spark.createDataFrame([
        ("s/All.slnx", '<Solution><Folder Name="x"><Project Path="hidden/h.csproj"/></Folder><Project Path="../src/A/A.csproj"/></Solution>'),
        ("Old.sln", 'Project("{FAE04EC0}") = "B", "src\\B\\B.csproj", "{1}"\nEndProject\nProject("{2150E333}") = "Docs", "docs", "{2}"'),
        ("x.txt", ""),
    ], "path string, text string")
    assert sorted(r.path for r in readers.discover_solutions(files).collect()) == ["Old.sln", "s/All.slnx"]
    assert sorted(tuple(r) for r in readers.solution_projects(files).collect()) == [("Old.sln", "src/B/B.csproj"), ("s/All.slnx", "src/A/A.csproj")]


def test_lock_history_submodules_ontology(spark):
    locks = spark.createDataFrame([("p", '{"libraries": {"A/1.0": {"type": "package"}, "a/2.0": {"type": "package"}, "B/1": {"type": "project"}}}')], "project_path string, text string")
    assert [tuple(r) for r in readers.resolved_packages(locks).collect()] == [("p", "a", "a", "2.0")]
    lines = spark.createDataFrame([("f", "s1\x1f2024-01-01T02:00:00+02:00\x1fAnn\x1fa@x\x1fp1 p2"), ("f", "bad")], "path string, line string")
    history = readers.history_lines(lines)
    row = history.first()
    assert history.count() == 1 and row.ts_utc == "2024-01-01T00:00:00.0000000Z" and row.parents == ["p1", "p2"]
    merged = readers.file_history(history.withColumn("sha", __import__("pyspark").sql.functions.lit("other")), history)
    assert sorted((r.sha, r.is_merge) for r in merged.collect()) == [("other", False), ("s1", True)]
    modules = spark.createDataFrame([(".gitmodules", '[submodule "a"]\n\tpath = mods/a\n\turl = u1\n[submodule "b"]\n\tpath = MODS/a\n\turl = u2')], "path string, text string")
    assert [(r.name, r.path, r.url) for r in readers.submodules(modules).collect()] == [("a", "mods/a", "u1")]
    text = spark.createDataFrame([("o.yaml", 'version: "1.2"\npredicates:\n  - id: core:contains\n  - id: core:calls\n')], "path string, text string")
    assert tuple(readers.ontology(text).select("version", "ids").first()) == ("1.2", ["core:contains", "core:calls"])


def test_scan_files(spark, tmp_path):
    for name in ("a/x.cs", "a/obj/y.cs", "B/z.cs", "a/n.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = readers.scan_files(spark, str(tmp_path), "*.cs")
    assert sorted(r.path for r in found.collect()) == ["B/z.cs", "a/obj/y.cs", "a/x.cs"]
    left = readers.without(found, spark.createDataFrame([("A/OBJ",)], "path string"))
    assert sorted(r.text for r in left.collect()) == ["B/z.cs", "a/x.cs"]


def test_malformed_projects_keep_their_names(spark):
    bad = ["<Project><unclosed></Project>", "<Project/><b/>", "<Project>&bad;</Project>", "<Project><A></B></Project>", "junk", "", None, "<Project><AssemblyName>x</AssemblyName>"]
    good = ["\ufeff<?xml version='1.0'?>\n<!-- <AssemblyName>no</AssemblyName> --><Project><!-- <AssemblyName>no</AssemblyName> --><P><AssemblyName> A&amp;B </AssemblyName></P></Project>\n"]
    files = spark.createDataFrame([(f"f{i}.csproj", x) for i, x in enumerate(bad + good)], "path string, text string")
    assert [r.name for r in readers.project_facts(files).orderBy("path").collect()] == [f"f{i}" for i in range(len(bad))] + ["A&B"]
    solutions = spark.createDataFrame([(f"s{i}.slnx", x) for i, x in enumerate(["<Solution><Project Path='a.csproj'/></Solution>", "<Solution><Project", "", None, "<Solution/>"])], "path string, text string")
    assert [r.project_path for r in readers.solution_projects(solutions).collect()] == ["a.csproj"]


def test_git_history(spark, tmp_path):
    """Author dates, renames, merges with their branch's commits, texts at HEAD and in the working tree."""
    when = iter(range(10, 60))

    def run(*args):
        at = next(when)
        dates = {"GIT_AUTHOR_DATE": f"2024-01-01T{at % 24:02d}:00:00+02:00", "GIT_COMMITTER_DATE": f"2025-06-01T{at % 24:02d}:00:00Z"}
        names = {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "Bob", "GIT_COMMITTER_EMAIL": "b@x", "GIT_CONFIG_GLOBAL": "/dev/null"}
        return subprocess.run(["git", "-C", str(tmp_path), *args], check=True, capture_output=True, text=True, env=os.environ | dates | names).stdout

    def commit(name, text):
        (tmp_path / name).write_text(text)
        run("add", "-A")
        run("commit", "-qm", name)

    run("init", "-q", "-b", "main")
    commit("old.cs", "class A {}\n" * 9)
    run("mv", "old.cs", "new é.cs")
    run("commit", "-qm", "renamed")
    run("checkout", "-qb", "side")
    commit("new é.cs", "class A {}\n" * 9 + "// one\n")
    commit("new é.cs", "class A {}\n" * 9 + "// two\n")
    run("checkout", "-q", "main")
    commit("other.txt", "x")
    run("merge", "-q", "--no-ff", "-m", "merged", "side")
    (tmp_path / "loose.txt").write_bytes(b"a\xff")
    repository, path = str(tmp_path), "new é.cs"
    assert git.tracked_paths(repository) == [path, "other.txt"] and git.mainline_branch(repository) == git.head_branch(repository) == "main" and git.is_dirty(repository)
    found = git.history(spark, repository, [path]).orderBy("ord").collect()
    assert len(found) == 4 and all(r.ts_utc.startswith("2024-01-01T") and r.author_name == "Ann" for r in found)
    merges = git.mainline_merges(spark, repository, [path, "other.txt"], "main")
    (merge,) = merges.collect()
    assert merge.path == path and len(merge.parents) == 2
    commits = git.branch_commits(spark, repository, [(merge.path, merge.sha, merge.parents), ("x", "y", ["no", "such"])])
    assert [r.source_commit_count for r in readers.source_branch_commits(commits, merges).collect()] == [2]
    texts = {r.path: r.text for r in git.head_texts(spark, repository, [path, "loose.txt", "none.txt", "other.txt"]).collect()}
    assert texts == {path: "class A {}\n" * 9 + "// two\n", "loose.txt": "a\ufffd", "other.txt": "x"}
    assert git.tracked_paths(f"{repository}/none") == [] and git.history(spark, f"{repository}/none", ["a"]).count() == 0


def test_aliases_and_constraints(spark):
    code = "using Log = Serilog.Core;\nusing System;\nusing static System.Math;\nnamespace A;\npublic class Box<T, U> : Base<T>, IBox where T : IThing, class where U : new() { }\npublic class Plain { }\n"
    rows = {r.name: r for r in csharp.declarations(spark.createDataFrame([("a.cs", code)], "path string, text string")).collect()}
    assert rows["Box"].aliases == {"Log": "Serilog.Core"} and rows["Box"].imports == ["System"]
    assert rows["Box"].constraints == ["T:IThing&class", "U:new()"] and rows["Box"].bases == ["Base", "IBox"] and rows["Plain"].constraints == []
