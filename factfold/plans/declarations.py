"""Facts from nested declaration rows.

A translation unit comes as one row per declaration, tagged by kind, with its bases, parameters and template slots nested in it. ``route``
turns each row, in one pass and without a shuffle, into an array of tagged facts: what goes to the symbol table and to each side
table, the edges, and what was skipped or failed. ``Facts`` writes these once, in one folder per table, so that the source is scanned
once and a table that is asked for reads its own rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factfold.functions import text
from factfold.operators.lineage import cut

BASE = "struct<usr:string,name:string,access:string,is_virtual:boolean,is_dependent:boolean>"
PARAMETER = "struct<name:string,type:string,type_text:string,default_text:string>"
SLOT = "struct<name:string,kind:string,type:string,is_pack:boolean>"
#: usr and type hold usrs; a type is null where it can't be named and empty where it is built in.
DECLARATION = (
    "seq long, file string, is_indexed boolean, is_system boolean, kind string, usr string, qualified_name string, line int, col int, offset long, size long, is_definition boolean, "
    "owner string, access string, type string, expression string, is_scoped boolean, is_fixed boolean, "
    f"bases array<{BASE}>, parameters array<{PARAMETER}>, slots array<{SLOT}>"
)
#: What is said of declarations that can't be taken; the first two kinds are skipped without an error.
SKIPPED = ["system header", "outside indexed files"]
CALLABLE, RECORDS, TYPED, DEFINED = ["function", "method"], ["record"], ["field", "variable", "alias", "enum"], ["function", "method", "record"]
_FACT = "struct<sink:string,other:string,position:int,name:string,value:string,code:string,flag:boolean,flag2:boolean,line:int,col:int,offset:long,size:long>"


def problem() -> Column:
    """Why a declaration is not taken, null if it is; the first reason counts."""
    kind, c = F.col("kind"), F.col
    return (
        F.when(c("line").isNull(), "invalid source location").when(F.coalesce("is_system", F.lit(False)), SKIPPED[0]).when(~F.coalesce("is_indexed", F.lit(False)), SKIPPED[1])
        .when(F.coalesce("usr", F.lit("")) == "", "invalid USR").when(kind.isin(DEFINED) & c("is_definition") & ((c("offset") < 0) | (c("size") < 0)), "invalid source range")
        .when(kind.isin(TYPED) & c("type").isNull(), "invalid type")
    )


def _fact(sink: str, **values: Column) -> Column:
    kinds = dict(x.split(":") for x in _FACT.removeprefix("struct<").removesuffix(">").split(","))
    return F.struct(F.lit(sink).alias("sink"), *(values.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items() if k != "sink"))


def _some(when: Column, fact: Column) -> Column:
    """An array of the fact, or of none."""
    return F.when(when, F.array(fact)).otherwise(F.array().cast(f"array<{_FACT}>"))


def _each(items: str, fact, when: Column | None = None) -> Column:
    every = F.transform(F.coalesce(items, F.array().cast({"bases": f"array<{BASE}>", "parameters": f"array<{PARAMETER}>", "slots": f"array<{SLOT}>"}[items])), fact)
    return every if when is None else F.when(when, every).otherwise(F.array().cast(f"array<{_FACT}>"))


def _edge(kind: str, other: Column, **values: Column) -> Column:
    return _fact("relation", code=F.lit(kind), other=other, **{"position": F.lit(0)} | values)


def facts() -> Column:
    """The facts of a declaration that is taken."""
    c, kind = F.col, F.col("kind")
    named = lambda t: F.coalesce(t, F.lit("")) != ""
    lost = F.filter(F.coalesce("bases", F.array().cast(f"array<{BASE}>")), lambda b: ~F.coalesce(b["is_dependent"], F.lit(False)) & ~named(b["usr"]))
    whole = (F.size(lost) == 0) & kind.isin(RECORDS) & c("is_definition")
    inherits = _each("bases", lambda b, i: F.when(~F.coalesce(b["is_dependent"], F.lit(False)), _edge("Inherits", b["usr"], position=i, value=b["access"], flag=F.coalesce(b["is_virtual"], F.lit(False)))), whole)
    return F.flatten(F.array(
        _some(F.lit(True), _fact("symbol", name=c("qualified_name"), code=kind, value=c("access"), flag=c("is_definition"), line=c("line"), col=c("col"), offset=c("offset"))),
        _some(kind.isin(DEFINED) & c("is_definition"), _fact("definition", offset=c("offset"), size=c("size"))),
        _each("parameters", lambda p, i: _fact("parameter", position=i, name=p["name"], other=p["type"], value=p["type_text"], flag=p["default_text"].isNotNull()), kind.isin(CALLABLE)),
        F.filter(_each("parameters", lambda p, i: F.when(p["default_text"].isNotNull(), _fact("parameter_default", position=i, value=p["default_text"], code=text.constant(p["default_text"])["kind"])), kind.isin(CALLABLE)), lambda f: f.isNotNull()),
        _each("slots", lambda s, i: _fact("template_argument", position=i, name=s["name"], code=s["kind"], other=s["type"], flag=F.coalesce(s["is_pack"], F.lit(False)))),
        _some(kind == "enum", _fact("enumeration", other=c("type"), flag=F.coalesce("is_scoped", F.lit(False)), flag2=F.coalesce("is_fixed", F.lit(False)))),
        _some(kind == "enumerator", _fact("enumerator", value=c("expression"), code=text.constant(c("expression"))["kind"])),
        _some(kind.isin("field", "variable") & c("expression").isNotNull(), _fact("variable_initializer", value=c("expression"), code=text.constant(c("expression"))["kind"])),
        F.filter(inherits, lambda f: f.isNotNull()),
        _some(kind.isin(RECORDS) & c("is_definition") & (F.size(lost) > 0), _fact("problem", code=F.lit("error"), value=F.concat(F.lit("cannot resolve base '"), F.get(lost, 0)["name"], F.lit("' of '"), c("qualified_name"), F.lit("': base declaration is unavailable")))),
        _some((kind == "method") & named(c("owner")), _edge("MethodOf", c("owner"), value=c("access"))),
        _some((kind == "field") & named(c("owner")), _edge("FieldOf", c("owner"), value=c("access"))),
        _some((kind == "enumerator") & named(c("owner")), _edge("Contains", c("owner"))),
        _some(kind.isin("field", "variable") & named(c("type")), _edge("OfType", c("type"))),
        _some((kind == "alias") & named(c("type")), _edge("AliasOf", c("type"))),
        F.filter(_each("parameters", lambda p, i: F.when(named(p["type"]), _edge("ParamType", p["type"], position=i)), kind.isin(CALLABLE)), lambda f: f.isNotNull()),
    ))


def route(declarations: DataFrame) -> DataFrame:
    """(usr, seq, file, sink, other, position, name, value, code, flag, flag2, line, col, offset, size) of declarations (DECLARATION).

    A declaration that is not taken gives one row to ``problem``: code skip for system headers and files that are not indexed, error for
    all else, as text. A record with a base that is neither dependent nor known keeps its other facts, has no base edges and gives an
    error; dependent bases are left out in silence.
    """
    why = F.col("problem")
    failed = _fact("problem", code=F.when(why.isin(SKIPPED), "skip").otherwise("error"), value=F.concat(F.lit("cannot extract symbol '"), F.coalesce("qualified_name", F.lit("")), F.lit("': "), why))
    every = F.when(why.isNotNull(), F.array(failed)).otherwise(facts())
    return declarations.withColumn("problem", problem()).select("usr", "seq", "file", F.explode(every).alias("f")).select("usr", "seq", "file", "f.*")


class Facts:
    """The tables of one run over declarations, from one scan of them; repeated sightings are left to the merge of each table."""

    #: columns of each table and what of a fact they are
    TABLES = {
        "symbol": {"usr": "usr", "seq": "seq", "file": "file", "qualified_name": "name", "kind": "code", "access": "value", "is_definition": "flag", "line": "line", "col": "col", "offset": "offset"},
        "definition": {"usr": "usr", "seq": "seq", "file": "file", "offset": "offset", "size": "size"},
        "parameter": {"usr": "usr", "seq": "seq", "position": "position", "name": "name", "type": "other", "type_text": "value", "has_default": "flag"},
        "parameter_default": {"usr": "usr", "seq": "seq", "position": "position", "expression": "value", "evaluated_kind": "code"},
        "template_argument": {"usr": "usr", "seq": "seq", "position": "position", "name": "name", "kind": "code", "type": "other", "is_pack": "flag"},
        "enumeration": {"usr": "usr", "seq": "seq", "underlying_type": "other", "is_scoped": "flag", "has_fixed_underlying_type": "flag2"},
        "enumerator": {"usr": "usr", "seq": "seq", "value": "value", "evaluated_kind": "code"},
        "variable_initializer": {"usr": "usr", "seq": "seq", "expression": "value", "evaluated_kind": "code"},
        "relation": {"source": "usr", "seq": "seq", "kind": "code", "destination": "other", "position": "position", "access": "value", "is_virtual_base": "flag"},
        "problem": {"usr": "usr", "seq": "seq", "severity": "code", "message": "value"},
    }

    def __init__(self, declarations: DataFrame):
        self.rows = cut(route(declarations), by="sink")

    def table(self, name: str) -> DataFrame:
        return self.rows.where(F.col("sink") == name).select(*(F.col(f).alias(c) for c, f in self.TABLES[name].items()))


def template_values(rows: DataFrame, owner: str, values: str, rounds: int = 64) -> DataFrame:
    """(owner, position, value, pack_index, depth) of template values given as a VARIANT: an array whose elements are values or packs, which
    are arrays of the same kind, of any depth.

    Values are numbered in the order in which they stand, packs opened. pack_index is the place within the outermost pack, -1 outside of
    packs; depth is how many packs a value is in. Empty packs give no rows. Each round opens one level of what is still nested, and
    the loop ends when nothing is.
    """
    opened = lambda v: F.posexplode(F.try_variant_get(v, "$", "array<variant>")).alias("__i", "v")
    nested = cut(rows.select(F.col(owner).alias("__owner"), F.array().cast("array<int>").alias("path"), F.col(values).alias("v")).where(F.col("v").isNotNull()))
    leaves = None
    for _ in range(rounds):
        each = cut(nested.select("__owner", "path", opened(F.col("v"))).select("__owner", F.array_append("path", F.col("__i")).alias("path"), "v"))
        is_pack = F.schema_of_variant("v").startswith("ARRAY")
        own = each.where(~is_pack).select("__owner", "path", F.try_variant_get("v", "$", "string").alias("value"))
        leaves = own if leaves is None else leaves.unionByName(own)
        nested = cut(each.where(is_pack))
        if nested.isEmpty():
            break
    else:
        raise RuntimeError(f"packs are nested more than {rounds} deep")
    listed = leaves.groupBy("__owner").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("all"))  # one declaration's values
    each = listed.select(F.col("__owner").alias(owner), F.posexplode("all").alias("position", "l"))
    depth = F.size("l.path") - 1
    return each.select(owner, "position", "l.value", F.when(depth > 0, F.col("l.path")[1]).otherwise(-1).alias("pack_index"), depth.alias("depth"))
