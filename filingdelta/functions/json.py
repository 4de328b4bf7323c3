"""Reading model replies that may be malformed JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parsed(text: Column) -> Column:
    """Variant of the text, null when it is no JSON."""
    return F.try_parse_json(text)


def member(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """Type name of a variant; null when the member is absent."""
    return F.schema_of_variant(value)


def is_object(doc: Column) -> Column:
    return F.coalesce(F.startswith(kind(doc), F.lit("OBJECT")), F.lit(False))


def is_reply(text: Column, corrupt: Column) -> Column:
    """Whether the text is a JSON object, also one with members of another shape than asked for.

    ``corrupt``: the column that ``from_json`` fills for such a text; members of the right shape are read all the same.
    """
    return corrupt.isNull() | is_object(parsed(text))


def text_member(doc: Column, name: str) -> Column:
    """The member when it is a string, null otherwise."""
    value = member(doc, name)
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def number_member(doc: Column, name: str) -> Column:
    """The member when it is a number or a boolean, null otherwise."""
    value = member(doc, name)
    numeric = kind(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    flag = F.try_variant_get(value, "$", "boolean").cast("double")
    return F.when(numeric, F.try_variant_get(value, "$", "double")).when(kind(value) == "BOOLEAN", flag)
