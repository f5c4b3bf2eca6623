"""Canonical typed row payload and its SHA-256, built from column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def decimal_text(c: str, dtype: str) -> str:
    """Digits without trailing zeros.  Up to six fraction digits are written at the type's own scale, which gives the text of scale 18 for less."""
    precision, scale = map(int, dtype[len("decimal("):-1].split(","))
    own = 0 <= scale <= 6 and precision - scale <= 20
    digits = f"CAST({c} AS STRING)" if own else f"CAST(CAST({c} AS DECIMAL(38,18)) AS STRING)"
    if own and scale == 0:
        return digits
    return f"CASE WHEN {c} = 0 THEN '0' ELSE trim(TRAILING '.' FROM trim(TRAILING '0' FROM {digits})) END"


def canonical_value(name: str, dtype: str) -> str:
    """SQL text of ``["type","text"]`` for one value; equal decimals and equal instants give equal text."""
    c = f"`{name}`"
    if dtype == "string":
        # Only text with quotes, backslashes or control characters needs the JSON writer.
        plain = f"""CASE WHEN {c} RLIKE '["\\\\\\\\\\\\x00-\\\\x1f]' THEN to_json(array('string', {c})) ELSE concat('["string","', {c}, '"]') END"""
        return f"""CASE WHEN {c} IS NULL THEN '["null",null]' ELSE {plain} END"""
    if dtype == "boolean":
        kind, text = "boolean", f"CAST({c} AS STRING)"
    elif dtype in ("tinyint", "smallint", "int", "bigint"):
        kind, text = "integer", f"CAST({c} AS STRING)"
    elif dtype.startswith("decimal"):
        kind, text = "decimal", decimal_text(c, dtype)
    elif dtype.startswith("timestamp"):
        kind, text = "timestamp", f"date_format({c}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
    elif dtype == "date":
        kind, text = "date", f"date_format({c}, 'yyyy-MM-dd')"
    else:
        raise TypeError(f"no canonical text for {dtype}")
    return f"""CASE WHEN {c} IS NULL THEN '["null",null]' ELSE concat('["{kind}","', {text}, '"]') END"""


def canonical_payload(df: DataFrame, dataset: str, columns: Sequence[str] | None = None) -> Column:
    """``{"dataset":...,"fields":[[column,[type,text]],...]}`` as one column expression."""
    kinds = dict(df.dtypes)
    fields = ", ',', ".join(f"""'["{c}",', {canonical_value(c, kinds[c])}, ']'""" for c in columns or df.columns)
    return F.expr(f"""concat('{{"dataset":"{dataset}","fields":[', {fields}, ']}}')""")


def row_hash(df: DataFrame, dataset: str, columns: Sequence[str] | None = None) -> Column:
    return F.sha2(canonical_payload(df, dataset, columns), 256)


def fingerprint_bits(hashed: Column) -> Column:
    """60 bits of a hex digest as a number, for order-free table digests."""
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")
