"""Column functions: names of collections and roles, fields of host variables, and null handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import NULL_TOKENS

#: What counts as a full name and as a role's. The third group keeps its last repetition.
COLLECTION, ROLE = r"^(\w+)\.(\w+)\.((\w+)(\.|$))+", r"^(\w+)\.(\w+)$"
#: The same for word characters of any script.
_COLLECTION, _ROLE = f"(?U){COLLECTION}", f"(?U){ROLE}"


def _group(column: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(column, pattern, group)


def collection_name(name: Column) -> Column:
    """namespace.collection of a full name such as namespace.collection.module; null for other names."""
    return F.when(name.rlike(_COLLECTION), F.concat_ws(".", *(_group(name, _COLLECTION, i) for i in (1, 2))))


def role_name(name: Column) -> Column:
    """namespace.collection.last of a full name, or owner.role; null for other names."""
    full = F.concat_ws(".", *(_group(name, _COLLECTION, i) for i in (1, 2, 3)))
    return F.when(name.rlike(_COLLECTION), full).when(name.rlike(_ROLE), F.concat_ws(".", *(_group(name, _ROLE, i) for i in (1, 2))))


def yaml_field(text: Column, name: str) -> Column:
    """The value of the first line `name: value` or `name=value` that is not indented, without quotes around it."""
    value = F.regexp_extract(text, rf"(?md)^{name} *[:=] *(.+?) *$", 1)
    return F.trim(F.nullif(value, F.lit("")), F.lit('"'))


def variable(text: Column, name: str) -> Column:
    """A field of host variables that are JSON or, failing that, YAML. JSON that repeats a key counts as YAML."""
    return F.when(F.try_parse_json(text).isNotNull(), F.get_json_object(text, f"$.{name}")).otherwise(yaml_field(text, name))


def event_field(data: Column, name: str) -> Column:
    """A field of an event's JSON in which unicode escapes stay as they are written."""
    return F.get_json_object(F.replace(data, F.lit("\\u"), F.lit("\\u005cu")), f"$.{name}")


def without_null_tokens(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS, among: Sequence[str] | None = None) -> DataFrame:
    """df with null for those texts, in the columns `among` (all without it), that mean null in an export."""
    kinds, chosen = dict(df.dtypes), set(df.columns if among is None else among)
    return df.select(*(F.when(~F.col(c).isin(*tokens), F.col(c)).alias(c) if kinds[c] == "string" and c in chosen else F.col(c) for c in df.columns))


def total(column: Column | str) -> Column:
    """A sum that is 0 where there is nothing to add."""
    return F.coalesce(F.sum(column), F.lit(0))


def whole_days(first: Column, last: Column) -> Column:
    """Full days from first to last, at least 0; 0 if either is null."""
    days = F.floor(F.timestamp_diff("MICROSECOND", first, last) / F.lit(86_400_000_000))
    return F.greatest(F.coalesce(days, F.lit(0)), F.lit(0)).cast("long")


def joined_set(column: Column | str) -> Column:
    """The distinct values of a group, sorted and joined by a comma."""
    return F.array_join(F.array_sort(F.collect_set(column)), ", ")


def rounded(amount: Column) -> Column:
    """Two decimals, rounded as numpy rounds binary numbers."""
    return F.rint(amount * 100) / 100
