"""JSON payloads: keys sorted at every level, nulls kept, times as ISO text; and fields of payloads read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhound.functions.ids import iso


def sorted_fields(value: Column, kind: T.DataType) -> Column:
    """``value`` with the fields of all its structs in the order of their names."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[sorted_fields(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sorted_fields(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(value)))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso(value)
    return value


def json_object(frame: DataFrame, columns: list[str]) -> Column:
    """One JSON object of the columns of ``frame``."""
    kind = T.StructType([frame.schema[c] for c in columns])
    return F.to_json(sorted_fields(F.struct(*columns), kind), {"ignoreNullFields": "false"})


def field(payload: Column, path: str, kind: str = "string") -> Column:
    """A field of a JSON text, such as ``$.alert_evidence.alert_count``; null where it is missing or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(payload), path, kind)
