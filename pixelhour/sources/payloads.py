"""JSON payload text as a ``map<string,string>``.

The map form keeps a key whose value is JSON null, which the time and test-mode
rules need. Numbers, booleans and nested values appear as their JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelhour.functions.staging import staged

PAYLOAD_MAP = "map<string,string>"


def _last_of_each_key(fields: Column) -> Column:
    keys = F.map_keys(fields)
    return F.map_from_entries(
        F.filter(
            F.map_entries(fields),
            lambda entry, i: ~F.array_contains(F.slice(keys, i + F.lit(2), F.size(keys)), entry["key"]),
        )
    )


def parse_fields(payload: Column, options: dict[str, str] | None = None) -> Column:
    """Payload fields; NULL if the text is not a JSON object."""
    return F.from_json(payload, PAYLOAD_MAP, options or {})


def parse_strict(payload: Column) -> Column:
    """Fields of a text that is one JSON object and nothing else; NULL for any other text.

    The parser stops where a value ends. Inside an array, a second value or any
    trailing text shows as another element or an error; inside an object, what
    could close the array early is an error.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    alone = F.from_json(F.concat(F.lit("["), payload, F.lit("]")), f"array<{PAYLOAD_MAP}>", strict)
    inside = F.from_json(F.concat(F.lit('{"a":'), payload, F.lit(',"z":0}')), PAYLOAD_MAP, strict)
    return F.when((F.size(alone) == 1) & (F.size(F.map_keys(inside)) == 2), alone[0])


def unique_fields(fields: Column) -> Column:
    """Parsed fields where the last of several equal keys wins."""
    keys = F.map_keys(fields)
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.when(repeated, _last_of_each_key(fields)).otherwise(fields)


def has_key(fields: Column, key: str) -> Column:
    """True also for an explicit JSON null."""
    return F.map_contains_key(fields, F.lit(key))


def with_fields(df: DataFrame, payload: str = "payload", into: str = "fields", filtered: bool = True,
                strict: bool = False) -> DataFrame:
    """Add the parsed payload, by :func:`parse_strict` if asked.

    ``filtered`` says that rows will be filtered on the fields: each payload is
    then parsed exactly once. Otherwise a plain projection leaves Catalyst free
    to drop the parse when nothing reads it.
    """
    parsed = df.withColumn("__raw_fields", (parse_strict if strict else parse_fields)(F.col(payload)))
    fields = unique_fields(F.col("__raw_fields"))
    with_both = staged(parsed, {into: fields}) if filtered else parsed.withColumn(into, fields)
    return with_both.drop("__raw_fields")


def may_contain_key(payload: Column, key: str) -> Column:
    """A cheap text test that is never false for a payload holding the key.

    A key spelled with escapes contains a backslash, so such rows pass too.
    Used ahead of parsing to skip rows that cannot matter.
    """
    return payload.contains(key) | payload.contains("\\")


def unpivot(df: DataFrame, keep: list[str], fields: str = "fields") -> DataFrame:
    """One row per payload key."""
    return df.select(*keep, F.explode(F.col(fields)).alias("key", "value"))
