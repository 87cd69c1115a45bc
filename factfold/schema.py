"""Explicit schemas of the fact and registry tables, and the dimensions of coded columns.

Booleans are stored as 0/1 integers and ids as longs: the file in the upper half, the index within the file in the lower.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FLAGS = "is_definition is_implicit is_static is_virtual is_const is_inline is_pure is_override has_internal_linkage is_external is_variadic is_deleted is_defaulted is_explicit is_final is_abstract is_polymorphic has_extern_storage is_noexcept".split()
_TYPE_FLAGS = "is_pointer is_lvalue_reference is_rvalue_reference is_forwarding_reference is_const is_pack".split()
_ints = lambda names: ", ".join(f"{n} int" for n in names)

FACTS = {
    "symbol": f"id long, identity string, node int, kind int, sub_kind int, lang int, properties int, usr string, qualified_name string, line int, col int, offset int, access string, ref_qualifier string, constant_evaluation string, {_ints(_FLAGS)}",
    "symbol_allocator": "file_id long, next_index long",
    "definition": "symbol_id long, file_id long, offset int, size int",
    "enumeration": "symbol_id long, underlying_type long, is_scoped int, has_fixed_underlying_type int",
    "enumerator": "symbol_id long, value string, initializer_expression string",
    "variable_initializer": "symbol_id long, expression string, evaluated_kind string, evaluated_value string",
    "parameter": f"symbol_id long, position int, name string, type long, line int, col int, offset int, region_offset int, region_size int, {_ints(_TYPE_FLAGS)}, has_default int",
    "parameter_default": "symbol_id long, position int, expression string, evaluated_kind string, evaluated_value string",
    "template_argument": "symbol_id long, position int, name string, type_id long, is_parameter_pack int, is_non_type int, is_template_template int",
    "template_parameter": f"symbol_id long, position int, value string, type_id long, {_ints(_TYPE_FLAGS)}, kind int, pack_index int",
    "relation": "source_id long, destination_id long, kind int, position int, access string, is_virtual_base int, is_implicit int, is_lexical int, count int",
}
REGISTRY = {
    "semantic_universe": "id long, key string, name string, policy string",
    "repository": "id long, name string, kind string, remote_url string, active_clone_id long, semantic_universe_id long",
    "clone": "id long, repository_id long, path string, label string",
    "component": "id long, name string, path string, kind string, version string, repository_id long, semantic_universe_id long",
    "directory": "id long, component_id long, path string",
    "file": "id long, directory_id long, name string, mtime double, md5 string, compile_options string, driver string, working_directory string, indexed int, indexed_at timestamp, args_overridden int",
    "label": "name string, path string",
}
SKELETON = {
    "declarations": "usr string, name string, kind string, file string, line int, col int, is_def int",
    "uses": "usr string, kind string, file string, line int, col int",
    "occurrences": "location string, kind string, roles int, usr string",
    "cfg_edges": "function string, block int, successor int",
    "edits": "file string, offset int, length int, text string",
    "findings": "file string, offset int, check string",
    "nodes": "id long, parent_id long, kind string, family string, is_implicit boolean, attrs map<string,string>",
}

#: Codes of the stored columns.
NODES = {1: "Function", 2: "Record", 3: "Enumeration", 4: "Variable", 5: "Symbol", 6: "Enumerator"}
RELATIONS = dict(enumerate("Calls Inherits Contains Specializes Instantiates Overrides Uses FieldOf MethodOf ConstructValue ConstructTemp ConstructHeap ConstructCopy ConstructMove FactoryConstruct Destroy Friend DispatchCalls AliasOf OfType ReturnType ParamType TemplateArgumentType".split(), 1))
TEMPLATE_PARAMETERS = {1: "Type", 2: "NonType", 3: "Template", 4: "Pack"}
ACCESS = ["public", "protected", "private", "none"]
REF_QUALIFIERS = ["none", "lvalue", "rvalue"]
CONSTANT_EVALUATION = ["none", "constexpr", "consteval", "constinit"]
VALUE_KINDS = ["integer", "floating", "boolean", "string", "none"]

#: child table, its columns, parent table, its key
FOREIGN_KEYS = [
    *((t, "symbol_id", "symbol", "id") for t in ("definition", "enumeration", "enumerator", "variable_initializer", "parameter", "template_argument", "template_parameter")),
    ("relation", "source_id", "symbol", "id"),
    ("relation", "destination_id", "symbol", "id"),
]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], (FACTS | REGISTRY | SKELETON)[table])


def dimension(spark: SparkSession, codes: dict[int, str]) -> DataFrame:
    """(code, name) of a coded column, small enough to broadcast by construction."""
    return spark.createDataFrame(list(codes.items()), "code int, name string")
