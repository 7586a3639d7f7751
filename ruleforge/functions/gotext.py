"""The text form of event values as columns: what a keyword, a comparison or a group key sees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _float_text(c: Column) -> Column:
    c = c.cast("double")
    java = F.abs(c).cast("string")
    power = F.when(java.contains("E"), F.regexp_extract(java, r"E(-?\d+)", 1).cast("int")).otherwise(F.when(F.abs(c) >= 1, F.length(F.substring_index(java, ".", 1)) - 1).otherwise(-F.length(F.regexp_extract(java, r"\.(0*)", 1)) - 1))
    figures = F.regexp_replace(F.regexp_replace(F.regexp_replace(java, r"E.*$|\.", ""), "^0+", ""), "0+$", "")
    exponent = F.concat(F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
    rest = F.when(F.length(figures) > 1, F.concat(F.lit("."), F.substring(figures, 2, 400))).otherwise(F.lit(""))
    science = F.concat(F.substring(figures, 1, 1), rest, exponent)
    whole = F.when(F.abs(c) < 1e6, c.cast("bigint").cast("string"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures)
    size = F.when((F.abs(c) < 1e6) & (F.abs(c) >= 1e-4), F.when(F.abs(c) >= 1e-3, java).otherwise(small)).otherwise(science)
    signed = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), size)
    special = F.when(F.isnan(c), F.lit("NaN")).when(c == float("inf"), F.lit("+Inf")).when(c == float("-inf"), F.lit("-Inf"))
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), special).when((c == F.floor(c)) & (F.abs(c) < 1e6), whole).otherwise(signed)


def go_text(c: Column, kind: T.DataType, nil: str | None = None) -> Column:
    """The text of a column of the given type; of nulls nil."""
    if isinstance(kind, T.StringType | T.VarcharType | T.CharType):
        text = c
    elif isinstance(kind, T.BinaryType):
        text = F.decode(c, "UTF-8")
    elif isinstance(kind, T.DoubleType | T.FloatType):
        text = _float_text(c)
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        stamp = c.cast("timestamp_ntz")
        text = F.concat(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.regexp_replace(F.date_format(stamp, ".SSSSSS"), r"\.?0+$", ""), F.lit(" +0000 UTC"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: go_text(x, kind.elementType, "<nil>")), " "), F.lit("]"))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{n}:"), go_text(c[n], kind[n].dataType, "<nil>")) for n in sorted(kind.names)]
        text = F.when(c.isNotNull(), F.concat(F.lit("map["), F.concat_ws(" ", *parts), F.lit("]")))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(go_text(e["key"], kind.keyType), F.lit(":"), go_text(e["value"], kind.valueType, "<nil>")))
        text = F.concat(F.lit("map["), F.array_join(entries, " "), F.lit("]"))
    elif isinstance(kind, T.NullType):
        text = F.lit(None).cast("string")
    else:
        text = c.cast("string")
    return text if nil is None else F.coalesce(text, F.lit(nil))


def base64_text(c: Column) -> Column:
    """Bytes in base64 on one line; the built-in function breaks lines."""
    return F.regexp_replace(F.base64(c), "[\\r\\n]", "")
