"""Table schemas and fixed values of the code graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

FILES = "id long, path string, lang string, mtime_ms double, size long, hash string"
_RANGE = "s_line int, s_col int, e_line int, e_col int"
SYMBOLS = (
    f"id long, moniker string, file_id long, name string, kind string, {_RANGE}, name_s_line int, name_s_col int, name_e_line int, name_e_col int, "
    "exported boolean, export_name string, owner_type string, is_static boolean, is_abstract boolean, visibility string, param_count int, variadic boolean"
)
REFS = f"id long, file_id long, name string, role string, {_RANGE}, receiver string, enclosing string, arg_count int"
IMPORTS = "id long, file_id long, source string, kind string, imported_name string, local_name string, is_static boolean"
SCOPES = f"id long, file_id long, idx int, parent_idx int, {_RANGE}"
SCOPE_DEFS = "id long, file_id long, scope_idx int, name string, symbol_moniker string"
OCCURRENCES = f"id long, symbol_id long, file_id long, {_RANGE}, role string, enclosing_id long, provenance string, confidence double"

#: Fixed values.
PROVENANCE_RANK = {"syntactic": 1, "scoped": 2, "typed": 3, "scip": 4, "lsp": 5}
CALL_ROLES = ("call", "reference")
INHERITANCE_ROLES = ("extends", "implements")
ECMASCRIPT = ("typescript", "tsx", "javascript")
PRECISE = ("same-file", "import", "package", "scoped", "typed", "scip", "lsp")
FANOUT_CAP = 8
PRECISE_FLOOR = 0.9
IMPACT_FLOOR = 0.1
MAX_RESULTS, MAX_DEPTH, MAX_BUDGET = 500, 10, 50_000
MAX_FILE_BYTES = 512 * 1024
FILE_CAP, TYPED_FILE_CAP, MAX_FILES = 20_000, 500, 100_000
TOP_LEVEL = "(top level)"
CLASS_KINDS = ("class", "interface", "abstract_class", "struct", "trait", "type", "module", "enum")


@dataclass(frozen=True)
class Index:
    """The tables that queries read. Any may be the proxy's or a snapshot's."""

    files: DataFrame
    symbols: DataFrame
    occurrences: DataFrame
    refs: DataFrame | None = None
    imports: DataFrame | None = None
    scopes: DataFrame | None = None
    scope_defs: DataFrame | None = None


def limited(value: int, most: int, name: str = "limit") -> int:
    """A positive whole number within its ceiling."""
    if isinstance(value, bool) or not isinstance(value, int) or not 0 < value <= most:
        raise ValueError(f"{name} has to be a whole number from 1 to {most}")
    return value
