"""Monikers, descriptors and SCIP symbols as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TYPE_KINDS = ("class", "interface", "type", "type_alias", "typealias", "enum", "struct", "trait", "record", "annotation", "union", "typedef", "protocol", "delegate", "template")
CALLABLE_KINDS = ("function", "method", "constructor", "func")
NAMESPACE_KINDS = ("module", "namespace", "package")


def escaped(name: Column) -> Column:
    """A bare word stays; anything else goes between backticks, its own backticks doubled."""
    quoted = F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))
    return F.when(name.rlike(r"^[A-Za-z0-9_$]+$"), name).otherwise(quoted)


def descriptor(name: Column, kind: Column) -> Column:
    suffix = F.when(kind.isin(*TYPE_KINDS), "#").when(kind.isin(*CALLABLE_KINDS), "().").when(kind.isin(*NAMESPACE_KINDS), "/").otherwise(".")
    return F.concat(escaped(name), suffix)


def owner_part(owner: Column) -> Column:
    return F.when(owner.isNotNull() & (owner != ""), F.concat(escaped(owner), F.lit("#"))).otherwise("")


def moniker(path: Column, owner: Column, name: Column, kind: Column, line: Column, col: Column) -> Column:
    """file#Owner#name().@line:col"""
    return F.concat(path, F.lit("#"), owner_part(owner), descriptor(name, kind), F.lit("@"), line.cast("string"), F.lit(":"), col.cast("string"))


def scip_symbol(scheme: str, repo: Column, path: Column, owner: Column, name: Column, kind: Column) -> Column:
    """Scheme, package part with doubled spaces, file as a namespace, then the descriptors."""
    package = F.when(F.coalesce(repo, F.lit("")) == "", ".").otherwise(F.replace(repo, F.lit(" "), F.lit("  ")))
    return F.concat(F.lit(scheme + " . "), package, F.lit(" . "), escaped(path), F.lit("/"), owner_part(owner), descriptor(name, kind))
