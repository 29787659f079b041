"""Closed sets of kinds: text of any letter case to its name, 'Unknown' otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds as the graph spells them, and their names.
ACCESSIBILITY = {"public": "Public", "internal": "Internal", "protected": "Protected", "protectedinternal": "ProtectedInternal", "private": "Private", "privateprotected": "PrivateProtected"}
TYPE_KIND = {"interface": "Interface", "class": "Class", "record": "Record", "struct": "Struct", "enum": "Enum", "delegate": "Delegate"}
MEMBER_KIND = {"field": "Field", "property": "Property", "enum-member": "EnumMember", "record-parameter": "RecordParameter"}
METHOD_KIND = {"method": "Method", "constructor": "Constructor"}
STATUS = {
    "type-declaration": "Resolved", "method-declaration": "Resolved", "member-declaration": "Resolved", "external-type-stub": "ExternalStub",
    "external-method-stub": "ExternalStub", "external-member-stub": "ExternalStub", "unresolved-type-reference": "SourceTextFallback",
}


def named(v: Column, names: dict[str, str], default: str = "Unknown", fold: bool = True) -> Column:
    out, key = F.lit(default), F.lower(v) if fold else v
    for text, name in names.items():
        out = F.when(key == text, name).otherwise(out)
    return out


def resolution_status(entity_type: Column) -> Column:
    """Of a reference by its target's type; Unresolved if that is missing or another."""
    return named(entity_type, STATUS, "Unresolved", fold=False)
