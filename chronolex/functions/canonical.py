"""Canonical JSON from a column's schema, and the kinds of JSON values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType, TimestampNTZType, TimestampType

#: Characters with a short escape.
SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
CONTROLS = {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in SHORT}


def json_string(text: Column) -> Column:
    """text in quotes: short escapes, other control characters as lower-case \\u00xx, all else as it is."""
    replaced = lambda c, table: reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), table.items(), c)
    short = replaced(text, SHORT)
    return F.concat(F.lit('"'), F.when(short.rlike(r"[\x00-\x1f]"), replaced(short, CONTROLS)).otherwise(short), F.lit('"'))


def canonical_json(column: Column | str, kind: DataType) -> Column:
    """The column as JSON without blanks, keys of structs and maps in order of their code points at every depth, nulls kept.

    Integers and decimals are digits; doubles are as Spark casts them, and must be finite; dates and times are
    ISO texts, times in UTC; keys of maps are texts. Fields of a struct may come in any order: the result is the same.
    """
    c = F.col(column) if isinstance(column, str) else column
    if isinstance(kind, NullType):
        return F.lit("null")
    if isinstance(kind, StructType):
        if len(set(kind.names)) != len(kind.names):
            raise TypeError("a struct has two fields of one name")
        fields = [F.concat(json_string(F.lit(n)), F.lit(":"), canonical_json(c[n], kind[n].dataType)) for n in sorted(kind.names)]
        made = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, MapType):
        if not isinstance(kind.keyType, StringType):
            raise TypeError("keys of maps must be texts")
        keys = F.array_sort(F.map_keys(c))
        made = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(json_string(k), F.lit(":"), canonical_json(c[k], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, ArrayType):
        made = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, StringType):
        made = json_string(c)
    elif isinstance(kind, (DoubleType, FloatType)):
        finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
        made = F.when(finite, c.cast("string")).otherwise(F.raise_error(F.lit("JSON has no such number")))
    elif isinstance(kind, (IntegralType, DecimalType, BooleanType)):
        made = c.cast("string")
    elif isinstance(kind, DateType):
        made = F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd"), F.lit('"'))
    elif isinstance(kind, TimestampType):
        made = F.concat(F.lit('"'), F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"'))
    elif isinstance(kind, TimestampNTZType):
        made = F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"'))
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON")
    return F.when(c.isNull(), F.lit("null")).otherwise(made)


def json_kind(text: Column | str) -> Column:
    """object, array, string, number, boolean or null, as JSON names them; null where the text is no JSON."""
    found = F.schema_of_variant(F.try_parse_json(F.col(text) if isinstance(text, str) else text))
    head = F.regexp_extract(found, r"^[A-Z]+", 0)
    return F.when(head == "OBJECT", "object").when(head == "ARRAY", "array").when(head == "STRING", "string").when(head == "BOOLEAN", "boolean").when(head == "VOID", "null").when(head.isin("BIGINT", "DOUBLE", "DECIMAL"), "number")
