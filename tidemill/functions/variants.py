"""Ragged JSON as variants: parsed once, read by path and type, its shape inferred, its arrays and maps laid out as rows.

A text that doesn't begin with a whole JSON value is a null variant and is counted apart from a null text; what follows a whole value isn't read. A
field that is missing, or that doesn't cast to the type asked for, is null; strings that spell a
number do cast. The shape of a column is merged from the shapes of its rows by a
partial aggregate, so it takes one pass and no row goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, text: str, name: str = "variant") -> DataFrame:
    """``df`` with the variant of ``text``, and ``{name}_bad``: a text that isn't JSON."""
    v = F.try_parse_json(text)
    return df.withColumns({name: v, f"{name}_bad": F.col(text).isNotNull() & v.isNull()})


def field(variant: str, path: str, kind: str) -> Column:
    """The value at ``path`` (as ``$.a.b[0]``) as ``kind``, else null."""
    return F.try_variant_get(variant, path, kind)


def typed(df: DataFrame, text: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a typed column for each of ``fields``, name to path and type, and ``is_bad``."""
    taken = sorted({"is_bad", *fields} & set(df.columns))
    if taken:
        raise ValueError(f"columns named like results: {taken}")
    v = parsed(df, text, "_variant")
    return v.select(*df.columns, *[field("_variant", path, kind).alias(name) for name, (path, kind) in fields.items()], F.col("_variant_bad").alias("is_bad"))


def shape(df: DataFrame, text: str, *by: str) -> DataFrame:
    """``n``, ``n_bad`` and ``shape``, the type that all rows of a group fit in, by ``by``; shapes that don't agree meet as VARIANT."""
    return parsed(df, text, "_variant").groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("_variant_bad").alias("n_bad"), F.schema_of_variant_agg("_variant").alias("shape"))


def elements(df: DataFrame, text: str, path: str, keep_empty: bool = False) -> DataFrame:
    """``df`` with a row for each element of the array, or entry of the map, at ``path``: ``pos``, ``key`` (null in arrays) and ``value``, a variant.

    Rows without one are left out, or come once with nulls where ``keep_empty``.
    """
    how = "variant_explode_outer" if keep_empty else "variant_explode"
    inner = parsed(df, text, "_variant").withColumn("_at", field("_variant", path, "variant"))
    names = ", ".join(f"r.`{c}`" for c in df.columns)
    return df.sparkSession.sql(f"SELECT {names}, e.pos, e.key, e.value FROM {{rows}} AS r, LATERAL {how}(r._at) AS e", rows=inner)
