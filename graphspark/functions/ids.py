"""Identities: hash ids and the natural keys they are made from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(entity_type: Column | str, natural_key: Column) -> Column:
    """type:sha256(type:key), in lower-case hex."""
    t = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    return F.concat(t, F.lit(":"), F.sha2(F.concat(t, F.lit(":"), natural_key).cast("binary"), 256))


def hashed(plain: Column) -> Column:
    """The stable id of a `type:key` text."""
    return F.concat(F.substring_index(plain, ":", 1), F.lit(":"), F.sha2(plain.cast("binary"), 256))


def literal_id(value: Column) -> Column:
    """The key of a literal node: literals of equal text are one node."""
    return F.concat(F.lit("literal:"), F.upper(F.sha2(value.cast("binary"), 256)))


def namespace_key(name: Column) -> Column:
    clean = F.trim(F.coalesce(name, F.lit("")))
    return F.concat(F.lit("namespace::"), F.when(clean == "", "<global>").otherwise(clean))


def type_key(assembly: Column, namespace: Column, signature: Column) -> Column:
    return F.concat_ws("::", F.lit("type"), F.trim(assembly), F.trim(namespace), F.trim(signature))


def member_key(type_: Column, kind: Column, signature: Column) -> Column:
    return F.concat_ws("::", F.lit("member"), F.trim(type_), F.lower(kind), F.trim(signature))


def method_key(assembly: Column, type_: Column, name: Column, arity: Column, parameter_types: Column) -> Column:
    """Return types take no part: overloads differ by name, arity and parameters only."""
    return F.concat_ws("::", F.lit("method"), F.trim(assembly), F.trim(type_), F.trim(name), arity.cast("string"), F.array_join(F.transform(parameter_types, lambda x: F.trim(x)), "|"))


def parameter_key(method: Column, ordinal: Column, name: Column) -> Column:
    return F.concat_ws(":", method, ordinal.cast("string"), name)
