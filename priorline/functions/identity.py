"""Stable identities and name folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented Latin letters and the plain letters they fold to.
_ACCENTED = "áàâäãåāçčćéèêëēěíìîïīñńóòôöõøōšśúùûüūýÿžźż"
_PLAIN = "aaaaaaaccceeeeeeiiiiinnooooooossuuuuuyyzzz"


def canonical_json(columns: list[str]) -> Column:
    """FN-26: JSON of the columns in name order, NaN as null, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def content_id(columns: list[str], length: int = 64) -> Column:
    """FN-26: hex SHA-256 over the canonical JSON, cut to ``length`` characters."""
    return F.substring(F.sha2(canonical_json(columns), 256), 1, length)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def fold_name(name: Column) -> Column:
    """NRM-16: lower case, accents off, letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(name), _ACCENTED, _PLAIN), "[^a-z0-9]", "")


def snake_case(name: str) -> str:
    """NRM-1: one column name from camelCase to snake_case."""
    out = ""
    for i, ch in enumerate(name):
        boundary = ch.isupper() and i > 0 and (name[i - 1].islower() or name[i - 1].isdigit() or (
            i + 1 < len(name) and name[i + 1].islower() and name[i - 1] != "_"))
        out += ("_" if boundary else "") + ch.lower()
    return out
