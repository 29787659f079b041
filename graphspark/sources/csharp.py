"""A tolerant scanner for C# declarations.

It blanks comments and literals, then walks braces: namespaces (block and file-scoped), types with bases,
generics and modifiers, and inside types fields, properties, methods, constructors, enum and record members.
Bodies are skipped. It reads syntax only; what it can't make out is left out, never an error. Limits: no
preprocessor branches (all are read), no operators, events, indexers or destructors, no local functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_NOISE = re.compile(r'//[^\n]*|/\*.*?\*/|@?\$?@?"""(?:.*?)"""|\$?@"(?:[^"]|"")*"|@?\$"(?:\\.|[^"\\])*"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', re.S)
_MODIFIERS = "public|protected|internal|private|static|abstract|sealed|partial|readonly|ref|unsafe|new|virtual|override|extern|async|const|volatile|required|file"
_TYPE = re.compile(rf"(?P<mods>(?:\b(?:{_MODIFIERS})\s+)*)\b(?P<kind>class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+(?P<name>@?\w+)\s*(?P<generic><[^<>{{}}()]*>)?\s*(?P<params>\((?:[^()]|\([^()]*\))*\))?\s*(?P<bases>:[^{{;]*?)?(?P<where>\bwhere\b[^{{;]*)?(?P<end>[{{;])", re.S)
_DELEGATE = re.compile(rf"(?P<mods>(?:\b(?:{_MODIFIERS})\s+)*)\bdelegate\s+[\w.<>\[\]?, ]+?\s+(?P<name>\w+)\s*(?P<generic><[^<>]*>)?\s*\(", re.S)
_NAMESPACE = re.compile(r"\bnamespace\s+(?P<name>[\w.]+)\s*(?P<end>[{;])")
_USING = re.compile(r"(?:^|(?<=;))\s*(?:global\s+)?using\s+(?!static\b|\()(?:(?P<alias>\w+)\s*=\s*)?(?P<name>[\w.<>,\s]+?)\s*;", re.M)
_METHOD = re.compile(rf"(?P<mods>(?:\b(?:{_MODIFIERS})\s+)*)(?P<type>[\w.]+(?:\s*<[^;{{}}()]*>)?(?:\[[,\s]*\]|\?)*)\s+(?P<name>[\w.]+)\s*(?P<generic><[\w\s,]*>)?\s*\((?P<params>[^;{{}}]*)\)\s*(?:where\b[^{{;=]*)?$", re.S)
_CONSTRUCTOR = re.compile(rf"(?P<mods>(?:\b(?:{_MODIFIERS})\s+)*)(?P<name>\w+)\s*\((?P<params>[^;{{}}]*?)\)\s*(?::\s*(?:base|this)\s*\(.*\))?\s*$", re.S)
_FIELD = re.compile(rf"(?P<mods>(?:\b(?:{_MODIFIERS})\s+)*)(?P<type>[\w.]+(?:\s*<[^;{{}}()]*>)?(?:\[[,\s]*\]|\?)*)\s+(?P<names>\w+\s*(?:=.*)?(?:,\s*\w+\s*(?:=.*)?)*)$", re.S)
_PROPERTY = re.compile(rf"(?P<mods>(?:\b(?:{_MODIFIERS})\s+)*)(?P<type>[\w.]+(?:\s*<[^;{{}}()]*>)?(?:\[[,\s]*\]|\?)*)\s+(?P<name>[\w.]+)\s*$", re.S)
_ATTRIBUTE = re.compile(r"^\s*(?:\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]\s*)+")

SCHEMA = (
    "path string, fact string, namespace string, declaring_type string, name string, kind string, accessibility string, is_partial boolean, arity int, generics array<string>, "
    "bases array<string>, type_text string, constant string, parameters array<string>, parameter_names array<string>, is_override boolean, is_extension boolean, imports array<string>, aliases map<string, string>, constraints array<string>, line int, column int"
)


def blank(text: str) -> str:
    """Comments and literals as spaces, line ends kept, so that places stay the same."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _split(text: str) -> list[str]:
    """Parts at commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*out, text[at:]] if p.strip()]


def accessibility(modifiers: str) -> str:
    words = set(modifiers.split())
    for name, needed in (("public", {"public"}), ("protectedinternal", {"protected", "internal"}), ("privateprotected", {"private", "protected"}), ("protected", {"protected"}), ("private", {"private"})):
        if needed <= words:
            return name
    return "internal"


def _parameters(text: str) -> tuple[list[str], list[str], bool]:
    types, names, this = [], [], False
    for p in _split(text):
        p = re.sub(r"\s+", " ", _ATTRIBUTE.sub("", p).split("=")[0]).strip()
        this = this or p.startswith("this ")
        p = re.sub(r"^(?:(?:this|ref|out|in|params|scoped|readonly) )+", "", p)
        head, _, name = p.rpartition(" ")
        types.append(re.sub(r"\s", "", head.replace("global::", "")) or name)
        names.append(name if head else "")
    return types, names, this


def constraints(head: str) -> list[str]:
    """T:c1&c2 for each where clause of a type's head, all sorted."""
    found = re.finditer(r"\bwhere\s+(\w+)\s*:\s*(.*?)(?=\bwhere\b|[{;]|$)", head, re.S)
    return sorted(f"{m[1]}:{'&'.join(sorted(re.sub(r'\s', '', c) for c in _split(m[2])))}" for m in found)


def _close(text: str, at: int) -> int:
    """The place after the brace that closes the one at `at`."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i + 1
    return len(text)


class Scanner:
    def __init__(self, path: str, text: str):
        self.path, self.raw, self.text, self.rows = path, text, blank(text), []
        self.imports = sorted({m["name"].strip() for m in _USING.finditer(self.text) if not m["alias"]})
        self.aliases = {m["alias"]: re.sub(r"\s", "", m["name"]) for m in _USING.finditer(self.text) if m["alias"]}

    def add(self, fact: str, at: int, **values) -> None:
        line = self.text.count("\n", 0, at) + 1
        column = at - (self.text.rfind("\n", 0, at) + 1) + 1
        blank_row = dict.fromkeys(("namespace", "declaring_type", "name", "kind", "accessibility", "type_text", "constant"), None) | {"is_partial": False, "arity": 0, "generics": [], "bases": [], "parameters": [], "parameter_names": [], "is_override": False, "is_extension": False, "constraints": []}
        self.rows.append({"path": self.path, "fact": fact, **blank_row, **values, "imports": self.imports, "aliases": self.aliases, "line": line, "column": column})

    def scan(self) -> list[dict]:
        self.walk(0, len(self.text), "", None)
        return self.rows

    def walk(self, at: int, end: int, namespace: str, declaring: str | None) -> None:
        """Namespaces and types between two places; bodies of types go to members()."""
        while at < end:
            found = [m for m in (_TYPE.search(self.text, at, end), _NAMESPACE.search(self.text, at, end), _DELEGATE.search(self.text, at, end)) if m]
            if not found:
                return
            m = min(found, key=lambda x: x.start())
            if m.re is _NAMESPACE:
                name = m["name"] if not namespace or m["name"].startswith(namespace + ".") else f"{namespace}.{m['name']}"
                self.add("namespace", m.start("name"), name=name)
                if m["end"] == "{":
                    at = _close(self.text, m.end() - 1)
                    self.walk(m.end(), at - 1, name, None)
                else:
                    namespace, at = name, m.end()
            elif m.re is _DELEGATE:
                self.add("type", m.start("name"), namespace=namespace or "<global>", declaring_type=declaring, name=m["name"], kind="delegate", accessibility=accessibility(m["mods"]), generics=_split((m["generic"] or "<>")[1:-1]), arity=len(_split((m["generic"] or "<>")[1:-1])))
                at = m.end()
            else:
                at = self.type_(m, namespace, declaring)

    def type_(self, m: re.Match, namespace: str, declaring: str | None) -> int:
        generics = _split((m["generic"] or "<>")[1:-1])
        kind, own = m["kind"].split()[0], m["name"] + (f"`{len(generics)}" if generics else "")
        full = f"{declaring}.{own}" if declaring else f"{namespace}.{own}" if namespace else own
        bases = [re.sub(r"\s", "", re.sub(r"\(.*", "", b, flags=re.S)).replace("global::", "").split("<")[0] for b in _split((m["bases"] or ":")[1:])]
        self.add("type", m.start("name"), namespace=namespace or "<global>", declaring_type=declaring, name=m["name"], kind=kind, accessibility=accessibility(m["mods"]), is_partial="partial" in m["mods"].split(), arity=len(generics), generics=generics, bases=bases, constraints=constraints(self.text[m.start() : m.end()]))
        if kind == "record" and m["params"]:
            types, names, _ = _parameters(m["params"][1:-1])
            for t, n in zip(types, names):
                self.add("member", m.start("params"), declaring_type=full, name=n, kind="record-parameter", accessibility="public", type_text=t)
        if m["end"] == ";":
            return m.end()
        end = _close(self.text, m.end() - 1)
        if kind == "enum":
            at = m.end()
            for part in self.text[m.end() : end - 1].split(","):
                name, _, value = _ATTRIBUTE.sub("", part).partition("=")
                if name.strip():
                    self.add("member", at + part.index(name.strip()), declaring_type=full, name=name.strip(), kind="enum-member", accessibility="public", constant=value.strip() or None)
                at += len(part) + 1
        else:
            self.members(m.end(), end - 1, full, m["name"], namespace)
        return end

    def members(self, at: int, end: int, declaring: str, type_name: str, namespace: str) -> None:
        start = at
        while at < end:
            c = self.text[at]
            if c not in "{;}":
                if c in "([":
                    at = self._bracket(at, end)
                elif self.text.startswith("=>", at):  # an expression body runs to its semicolon
                    self.member(start, at, declaring, type_name, True)
                    at = self._semicolon(at, end)
                    start = at
                elif c == "=" and self.text[at - 1] not in "=<>!+-*/" and self.text[at + 1] != "=":
                    stop = self._semicolon(at, end)
                    self.member(start, stop - 1, declaring, type_name, False)
                    at = start = stop
                else:
                    at += 1
                continue
            head = self.text[start:at]
            nested = _TYPE.search(self.text, start, at + 1)
            if nested and c in "{;":
                at = start = self.type_(nested, namespace, declaring)
                continue
            if head.strip():
                self.member(start, at, declaring, type_name, c == "{")
            if c == "{":
                at = _close(self.text, at)
                after = re.compile(r"\s*=(?!=|>)").match(self.text, at, end)
                at = self._semicolon(at, end) if after and "(" not in head else at
            else:
                at += 1
            start = at

    def _bracket(self, at: int, end: int) -> int:
        depth = 0
        for i in range(at, end):
            depth += (self.text[i] in "([") - (self.text[i] in ")]")
            if depth == 0:
                return i + 1
        return end

    def _semicolon(self, at: int, end: int) -> int:
        depth = 0
        for i in range(at, end):
            depth += (self.text[i] in "{([") - (self.text[i] in "})]")
            if self.text[i] == ";" and depth <= 0:
                return i + 1
        return end

    def member(self, start: int, stop: int, declaring: str, type_name: str, body: bool) -> None:
        head = self.text[start:stop]
        lead = _ATTRIBUTE.match(head)
        start += lead.end() if lead else 0
        head = head[lead.end() :] if lead else head
        start += len(head) - len(head.lstrip())
        head = head.strip()
        if m := _CONSTRUCTOR.fullmatch(head):
            if m["name"] == type_name:
                types, names, _ = _parameters(m["params"])
                self.add("method", start + m.start("name"), declaring_type=declaring, name=".ctor", kind="constructor", accessibility=accessibility(m["mods"]), parameters=types, parameter_names=names)
                return
        if m := _METHOD.fullmatch(head):
            types, names, this = _parameters(m["params"])
            words = m["mods"].split()
            self.add("method", start + m.start("name"), declaring_type=declaring, name=m["name"], kind="method", accessibility=accessibility(m["mods"]), arity=len(_split((m["generic"] or "<>")[1:-1])), type_text=re.sub(r"\s", "", m["type"]), parameters=types, parameter_names=names, is_override="override" in words, is_extension=this and "static" in words)
        elif body and (m := _PROPERTY.fullmatch(head)):
            self.add("member", start + m.start("name"), declaring_type=declaring, name=m["name"], kind="property", accessibility=accessibility(m["mods"]), type_text=re.sub(r"\s", "", m["type"]))
        elif not body and (m := _FIELD.fullmatch(head)) and m["type"] not in ("return", "using", "event"):
            for part in _split(m["names"]):
                name, _, value = part.partition("=")
                at = start + head.index(part)
                raw = self.raw[at : at + len(part)].partition("=")[2].strip()
                self.add("member", at, declaring_type=declaring, name=name.strip(), kind="field", accessibility=accessibility(m["mods"]), type_text=re.sub(r"\s", "", m["type"]), constant=(raw if value else None))


def declarations(files: DataFrame) -> DataFrame:
    """All declarations in files (path, text), one row each, in Arrow batches; `fact` is namespace, type, member or method."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("path", pa.string()), ("fact", pa.string()), ("namespace", pa.string()), ("declaring_type", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("accessibility", pa.string()), ("is_partial", pa.bool_()),
            ("arity", pa.int32()), ("generics", pa.list_(pa.string())), ("bases", pa.list_(pa.string())), ("type_text", pa.string()), ("constant", pa.string()), ("parameters", pa.list_(pa.string())),
            ("parameter_names", pa.list_(pa.string())), ("is_override", pa.bool_()), ("is_extension", pa.bool_()), ("imports", pa.list_(pa.string())), ("aliases", pa.map_(pa.string(), pa.string())), ("constraints", pa.list_(pa.string())), ("line", pa.int32()), ("column", pa.int32()),
        ])
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1)):
                found = Scanner(path.as_py(), text.as_py() or "").scan()
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return files.select("path", "text").mapInArrow(run, SCHEMA)


def split_bases(kind: str, bases: list[str]) -> tuple[list[str], list[str]]:
    """Base types and interfaces: of a class or record the first name that does not look like an interface is the base."""
    if kind == "interface":
        return bases, []
    if kind == "struct":
        return [], bases
    base = next((b for b in bases if not re.match(r"I[A-Z]", b.rpartition(".")[2])), None)
    return ([base] if base else []), [b for b in bases if b is not base]
