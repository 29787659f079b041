"""String functions of the graph: names, paths, locations, page paths and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SEGMENT = 120


def parse_bool(v: Column) -> Column:
    """'true' in any letter case, blanks around it allowed; anything else is false."""
    return F.coalesce(F.lower(F.trim(v)) == "true", F.lit(False))


def parse_int(v: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(v).try_cast("int"), F.lit(default))


def parse_utc(v: Column) -> Column:
    """For ordering only: text that is no timestamp comes before all others."""
    return F.coalesce(F.try_to_timestamp(v), F.to_timestamp(F.lit("0001-01-01 00:00:00")))


def utc_text(v: Column) -> Column:
    """An ISO timestamp in UTC with seven decimals and Z; text that is no timestamp stays as it is."""
    t = F.try_to_timestamp(v)
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS'Z'"), v)


def plain_reference(v: Column) -> Column:
    """A type reference without blanks around it, global:: and type arguments."""
    return F.substring_index(F.regexp_replace(F.trim(v), "global::", ""), "<", 1)


def method_reference(v: Column) -> Column:
    """Like plain_reference, with type arguments kept."""
    return F.regexp_replace(F.trim(v), "global::", "")


def signature_part(v: Column) -> Column:
    """A parameter type for comparison: without global:: and any white space."""
    return F.regexp_replace(F.regexp_replace(v, "global::", ""), r"\s", "")


def could_be_external(v: Column) -> Column:
    """Whether a reference is a plain dotted name, so that a stub may stand for it."""
    return (F.length(v) > 0) & v.rlike(r"^[\p{L}\p{Nd}_.]+$")


def looks_like_interface(v: Column) -> Column:
    return F.element_at(F.split(v, r"\."), -1).rlike(r"^I\p{Lu}")


def dotted_prefixes(v: Column) -> Column:
    """a.b.c -> [a, a.b, a.b.c]"""
    parts = F.split(v, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def path_ancestors(v: Column) -> Column:
    """src/a/b.cs -> [src, src/a, src/a/b.cs]: the path and every directory above it."""
    parts = F.split(F.regexp_replace(v, r"\\", "/"), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def directory_of(v: Column) -> Column:
    clean = F.regexp_replace(v, r"\\", "/")
    return F.when(F.contains(clean, F.lit("/")), F.regexp_replace(clean, "/[^/]*$", "")).otherwise(F.lit(""))


def file_name(v: Column) -> Column:
    return F.substring_index(F.regexp_replace(v, r"\\", "/"), "/", -1)


def extension(v: Column) -> Column:
    """With its dot; empty without one."""
    return F.regexp_extract(file_name(v), r"(\.[^.]*)$", 1)


def file_stem(v: Column) -> Column:
    return F.regexp_replace(file_name(v), r"\.[^.]*$", "")


def file_kind(path: Column) -> Column:
    # The kinds of tracked files by extension.
    kinds = {
        ".cs": "dotnet-source", ".sln": "solution", ".slnx": "solution", ".csproj": "project", ".props": "msbuild", ".targets": "msbuild",
        ".md": "documentation", ".json": "configuration", ".yaml": "configuration", ".yml": "configuration",
    }
    out, ext = F.lit("other"), F.lower(extension(path))
    for suffix, kind in kinds.items():
        out = F.when(ext == suffix, kind).otherwise(out)
    return out


def snake_case(v: Column) -> Column:
    return F.lower(F.regexp_replace(v, r"(?<!^)([A-Z])", "_$1"))


def sort_key(*parts: Column) -> Column:
    """Blank-trimmed parts joined by bars and compared as one string."""
    return F.concat_ws("|", *[F.trim(F.coalesce(p, F.lit(""))) for p in parts])


def location(path: Column, line: Column, column: Column) -> Column:
    return F.concat_ws("|", path, line.cast("string"), column.cast("string"))


def parse_location(v: Column) -> Column:
    """path|line|column as a struct; null unless there are three parts and both numbers are positive."""
    parts = F.split(v, r"\|")
    line, column = F.get(parts, F.lit(1)).try_cast("int"), F.get(parts, F.lit(2)).try_cast("int")
    good = (F.size(parts) == 3) & (line > 0) & (column > 0)
    return F.when(good, F.struct(F.get(parts, F.lit(0)).alias("path"), line.alias("line"), column.alias("column")))


def clamp_segment(v: Column) -> Column:
    """At most MAX_SEGMENT characters; longer ones end in twelve digits of their hash."""
    short = F.substring(v, 1, MAX_SEGMENT - 14)
    trimmed = F.regexp_replace(short, "-+$", "")
    head = F.when(trimmed == "", short).otherwise(trimmed)
    return F.when(F.length(v) <= MAX_SEGMENT, v).otherwise(F.concat(head, F.lit("--"), F.substring(F.sha2(v.cast("binary"), 256), 1, 12)))


def path_segment(v: Column) -> Column:
    """Letters, digits and ._- stay; any run of others becomes one dash; dashes at the ends go."""
    dashed = F.regexp_replace(F.trim(v), r"[^\p{L}\p{Nd}._-]+", "-")
    return clamp_segment(F.regexp_replace(dashed, r"^-+|-+$", ""))


def page_path(v: Column) -> Column:
    """Every segment of a path made safe; 'file' if nothing is left."""
    parts = F.filter(F.split(F.regexp_replace(v, r"\\", "/"), "/"), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.lit("file")).otherwise(F.array_join(F.transform(parts, path_segment), "/"))


def wiki_link(path: Column, alias: Column | None = None) -> Column:
    """[[target|alias]], the target without .md."""
    target = F.regexp_replace(path, r"(?i)\.md$", "")
    if alias is None:
        return F.concat(F.lit("[["), target, F.lit("]]"))
    name = F.trim(F.coalesce(alias, F.lit("")))
    return F.when(name == "", F.concat(F.lit("[["), target, F.lit("]]"))).otherwise(F.concat(F.lit("[["), target, F.lit("|"), name, F.lit("]]")))


def escape_pipes(v: Column) -> Column:
    return F.regexp_replace(v, r"\|", r"\\|")


def inline_list(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v, ", "), F.lit("]"))
