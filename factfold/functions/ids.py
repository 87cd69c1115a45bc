"""Packed ids and identity strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = (1 << 32) - 1


def pack_id(file: Column, index: Column) -> Column:
    return F.shiftleft(file.cast("long"), 32).bitwiseOR(index.cast("long").bitwiseAND(F.lit(_LOW)))


def file_of(packed: Column) -> Column:
    """Unsigned, so that files from 2**31 on survive."""
    return F.shiftrightunsigned(packed, 32)


def index_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_LOW))


def identity(usr: Column, name: Column, kind: Column, line: Column, col: Column) -> Column:
    """A symbol's usr if it has one, else its declaration's name, kind and place."""
    has = usr.isNotNull() & (usr != "")
    return F.when(has, F.concat(F.lit("usr:"), usr)).otherwise(F.concat_ws(":", F.lit("decl"), name, kind.cast("string"), line.cast("string"), col.cast("string")))


def identity_key(file: Column, usr: Column, ident: Column) -> Column:
    """What makes sightings one symbol: the usr across all files, else the identity within one file."""
    return F.when(usr.isNotNull() & (usr != ""), F.concat(F.lit("u"), usr)).otherwise(F.concat_ws("\x1f", F.lit("d"), file.cast("string"), ident))
