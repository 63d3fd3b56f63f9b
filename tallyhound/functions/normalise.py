"""Column expressions that clean raw text. Bad input becomes null or the default, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that mean null, and texts that mean true or false.
NULL_TOKENS = ("", "nan", "none", "null", "<na>", "nat")
TRUE_TOKENS = ("true", "t", "yes", "y", "1", "1.0")
FALSE_TOKENS = ("false", "f", "no", "n", "0", "0.0")


def text(value: Column) -> Column:
    """Stripped; null tokens are null."""
    stripped = F.trim(value.cast("string"))
    return F.when(~F.lower(stripped).isin(*NULL_TOKENS), stripped)


def identifier(value: Column, prefix: str | None = None) -> Column:
    """Upper case, runs of white space as one underscore; the prefix is added where it is missing."""
    clean = F.upper(F.regexp_replace(text(value), r"\s+", "_"))
    if not prefix:
        return clean
    return F.when(clean.startswith(prefix.upper()), clean).otherwise(F.concat(F.lit(prefix.upper()), clean))


def country(value: Column) -> Column:
    return F.upper(text(value))


def currency(value: Column, default: str = "USD") -> Column:
    return F.coalesce(F.upper(text(value)), F.lit(default))


def boolean(value: Column, default: bool = False) -> Column:
    token = F.lower(text(value))
    return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False).otherwise(default)


def number(value: Column, default: float | None = None, kind: str = "double") -> Column:
    parsed = text(value).try_cast(kind)
    if kind == "double":
        parsed = F.when(~F.isnan(parsed), parsed)
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast(kind))


def timestamp(value: Column) -> Column:
    """UTC wall-clock time; null where it can't be parsed."""
    return text(value).try_cast("timestamp_ntz")


def score(value: Column, default: float = 0.0) -> Column:
    """Clipped to 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(number(value), F.lit(default))))


def clip_score(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))))


def missing_to_null(frame: DataFrame) -> DataFrame:
    """NaN in floating columns as null."""
    floats = [f.name for f in frame.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return frame.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else frame


def ensure_columns(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds absent columns as typed nulls."""
    absent = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in frame.columns}
    return frame.withColumns(absent) if absent else frame


def require_columns(frame: DataFrame, columns: tuple[str, ...], name: str) -> None:
    absent = sorted(set(columns) - set(frame.columns))
    if absent:
        raise ValueError(f"{name} lacks the columns {', '.join(absent)}")


def id_list(value: Column) -> Column:
    """Distinct non-blank members in order, of a JSON list, a comma list or one value held as text."""
    clean = F.trim(value)
    parts = F.when(clean.startswith("["), F.from_json(clean, "array<string>")).otherwise(F.split(clean, ","))
    return unique(F.coalesce(parts, F.array().cast("array<string>")))


def unique(values: Column) -> Column:
    """Distinct stripped members, blanks and nulls dropped, in order."""
    stripped = F.transform(values, lambda x: F.trim(x.cast("string")))
    return F.array_sort(F.array_distinct(F.filter(stripped, lambda x: x.isNotNull() & (x != ""))))


def pg_array(value: Column) -> Column:
    """Members of a text such as {a,b}."""
    return unique(F.split(F.regexp_replace(value, r'[{}"]', ""), ","))
