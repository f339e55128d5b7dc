"""Lists as texts, in JSON and as literals with single quotes, both ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+\""""
_ITEM = rf"(?:{_QUOTED}|[+-]?[0-9][0-9_]*+(?:\.[0-9]*+)?(?:[eE][+-]?[0-9]++)?|None|True|False)"
_LITERAL = rf"^\s*[\[(]\s*(?:{_ITEM}\s*(?:,\s*{_ITEM}\s*)*+,?\s*)?[\])]\s*$"


def _unquoted(item: Column) -> Column:
    inner = F.substring(item, F.lit(2), F.greatest(F.length(item) - 2, F.lit(0)))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"\\n", "\n"), r"\\t", "\t"), r"\\(.)", "$1")
    quoted = F.substring(item, 1, 1).isin("'", '"')
    return F.when(quoted, F.when(F.contains(inner, F.lit("\\")), plain).otherwise(inner)).when(item == "None", None).otherwise(item)


def read_list(text: Column) -> Column:
    """A struct of values (array<string>), notation and damaged.

    JSON is tried first, then a literal: items in single or double quotes (a backslash before a quote, a backslash, n or t), numbers, None, True,
    False. Numbers stay as they are written; null and None are null elements. A text that neither reads has null values and stays in damaged; a null text
    has nothing.
    """
    json = F.from_json(text, "array<string>")
    is_json = F.startswith(F.trim(text), F.lit("[")) & json.isNotNull() & F.try_parse_json(text).isNotNull()
    items = F.transform(F.regexp_extract_all(text, F.lit(rf"({_ITEM})"), F.lit(1)), _unquoted)
    is_literal = F.rlike(text, F.lit(_LITERAL))
    values = F.when(is_json, json).when(is_literal, items)
    notation = F.when(is_json, "json").when(is_literal, "literal")
    return F.struct(values.alias("values"), notation.alias("notation"), F.when(notation.isNull(), text).alias("damaged"))


def as_json(values: Column) -> Column:
    return F.to_json(values)


def as_literal(values: Column) -> Column:
    """Items in single quotes, null as None; what read_list gives back."""
    quoted = lambda v: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"([\\'])", r"\\$1"), "\n", r"\\n"), "\t", r"\\t"), F.lit("'"))
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.coalesce(quoted(v), F.lit("None"))), ", "), F.lit("]"))
