"""Hashes over canonical JSON: sorted keys, no blanks, text unescaped, nulls kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(text: Column) -> Column:
    """JSON string literal; characters outside ASCII stay as they are."""
    return F.when(text.isNull(), "null").otherwise(
        F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    )


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """Render a column of the given type with object keys in sorted order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        body = [
            F.concat(F.lit(f'"{f.name}":'), canonical_json(value[f.name], f.dataType)) for f in fields
        ]
        text = F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda v: canonical_json(v, kind.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        return quoted(value)
    elif isinstance(kind, T.BooleanType):
        text = F.when(value, "true").otherwise("false")
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "null").otherwise(text)


def digest(value: Column, kind: T.DataType) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(value, kind), 256)
