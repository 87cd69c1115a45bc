"""Packed flags to columns and back, and kind numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from factfold import schema

#: First bit, width and the names of the values, of the symbol flags of stored schema version 2.
SYMBOL_FIELDS = {"access": (0, 2, schema.ACCESS), "ref_qualifier": (9, 2, schema.REF_QUALIFIERS), "constant_evaluation": (22, 2, schema.CONSTANT_EVALUATION)}
#: The bit of each flag between and beyond those fields.
SYMBOL_BITS = {
    "is_definition": 2, "is_implicit": 3, "is_static": 4, "is_virtual": 5, "is_const": 6, "is_inline": 7, "is_pure": 8, "is_override": 11, "has_internal_linkage": 12,
    "is_external": 13, "is_variadic": 14, "is_deleted": 15, "is_defaulted": 16, "is_explicit": 17, "is_final": 18, "is_abstract": 19, "is_polymorphic": 20,
    "has_extern_storage": 21, "is_noexcept": 24,
}


def bit(flags: Column, place: int) -> Column:
    return F.shiftrightunsigned(flags, place).bitwiseAND(F.lit(1)).cast("int")


def field(flags: Column, place: int, width: int, names: Sequence[str]) -> Column:
    """The name of a multi-bit value; values beyond the names are the last name."""
    value = F.shiftrightunsigned(flags, place).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    return F.element_at(F.array(*map(F.lit, names)), F.least(value, F.lit(len(names) - 1)) + 1)


def decode(flags: Column, places: Mapping[str, int]) -> list[Column]:
    return [bit(flags, p).alias(name) for name, p in places.items()]


def encode(places: Sequence[tuple[Column, int]]) -> Column:
    """The sum of the set bits of 0/1 or boolean columns; null counts as 0."""
    parts = [F.shiftleft(F.coalesce(c.cast("long"), F.lit(0)), p) for c, p in places]
    return sum(parts[1:], parts[0])


def encode_field(name: Column, place: int, names: Sequence[str]) -> Column:
    return F.shiftleft((F.array_position(F.array(*map(F.lit, names)), name) - 1).cast("long"), place)


def renumber(kind: Column, first: int, by: int) -> Column:
    """Kinds from ``first`` on are moved, as between two numberings that differ by inserted kinds."""
    return F.when(kind >= first, kind + by).otherwise(kind)


def classify(kind: Column, groups: Mapping[str, Sequence], other: str) -> Column:
    out = F.lit(other)
    for name, kinds in groups.items():
        out = F.when(kind.isin(*kinds), F.lit(name)).otherwise(out)
    return out
