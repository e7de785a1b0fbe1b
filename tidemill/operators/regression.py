"""Least squares by group from sufficient statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Below this part of a column's own spread, what the others leave of it counts as nothing.
_SINGULAR = 1e-10


def moments(df: DataFrame, key: str, y: str, xs: list[str]) -> DataFrame:
    """For each key the count, the means and the centred products of all columns: a state that two parts of the data can be merged from.

    One pass with partial sums before the shuffle, for any number of
    regressors. The centred products are kept about running means and merged
    with a correction for the difference of the parts' means, so a large
    mean doesn't swallow a small spread as plain sums of squares would. Rows
    with a null in any of the columns, or a number that isn't finite, don't count.
    """
    names = [y, *xs]
    rows = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    for i in range(len(names)):
        rows = rows.where(F.col(f"x{i}").isNotNull() & (F.abs(F.col(f"x{i}")) < float("inf")))
    means = F.array(*[F.avg(f"x{i}") for i in range(len(names))])
    products = F.array(*[F.covar_pop(f"x{i}", f"x{j}") * F.count("*") for i in range(len(names)) for j in range(i + 1)])
    return rows.groupBy("key").agg(F.count("*").alias("n"), means.alias("means"), products.alias("products"))


def merged(states: DataFrame) -> DataFrame:
    """States from ``moments`` of parts of the data, as one row for each key. Each part enters by its count, means and products alone."""
    total = states.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.size("means")).alias("d"), F.collect_list(F.struct("n", "means", "products")).alias("parts"))

    # Means relative to those of the first part, so that their differences keep their digits.
    off = "(p.means[{0}] - parts[0].means[{0}])"
    shift = f"transform(sequence(0, d - 1), i -> aggregate(parts, 0D, (a, p) -> a + p.n * {off.format('i')}) / n)"
    spread = f"({off.format('i')} - shift[i]) * ({off.format('j')} - shift[j]) * p.n"
    products = f"flatten(transform(sequence(0, d - 1), i -> transform(sequence(0, i), j -> aggregate(parts, 0D, (a, p) -> a + p.products[i * (i + 1) div 2 + j] + {spread}))))"
    total = total.withColumn("shift", F.expr(shift)).withColumn("products", F.expr(products))
    return total.withColumn("means", F.expr("transform(shift, (x, i) -> parts[0].means[i] + x)")).select("key", "n", "means", "products")


def solve(states: DataFrame, xs: list[str]) -> DataFrame:
    """For each key and term: ``coef``, its standard error ``se``, and the key's ``n``, ``r2`` and residual variance ``s2``.

    The normal equations are solved on the executors, one small system for each row.
    Terms are ``intercept`` and ``xs``. A group with fewer rows than terms, or with a
    regressor that the others determine, gets nulls; one with as many rows as terms has no errors.
    """
    k = len(xs)
    kind = states.schema["key"].dataType.simpleString()

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            out: list[tuple] = []
            for i, (n, means, products) in enumerate(zip(b["n"].to_pylist(), b["means"].to_pylist(), b["products"].to_pylist(), strict=True)):
                s = np.zeros((k + 1, k + 1))
                s[np.tril_indices(k + 1)] = products
                s = s + np.tril(s, -1).T
                out += [(i, *row) for row in _terms(n, np.array(means), s, xs)]
            at = pa.array([r[0] for r in out], pa.int64())
            types = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
            columns = [pa.array([r[c + 1] for r in out], t) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b["key"].take(at), *columns], ["key", "term", "coef", "se", "n", "r2", "s2"])

    return states.select("key", "n", "means", "products").mapInArrow(run, f"key {kind}, term string, coef double, se double, n long, r2 double, s2 double")


def _terms(n: int, means: np.ndarray, s: np.ndarray, xs: list[str]) -> list[tuple]:
    k = len(xs)
    names, none = ["intercept", *xs], [(None, None)] * (k + 1)
    spread = np.sqrt(np.diag(s)[1:])
    r2 = s2 = None
    if n >= k + 1 and (spread > 0).all():
        scaled = s[1:, 1:] / np.outer(spread, spread)
        if k == 0 or np.linalg.eigvalsh(scaled).min() > _SINGULAR:
            inverse = np.linalg.inv(scaled) / np.outer(spread, spread)
            coef = inverse @ s[1:, 0]
            left = max(float(s[0, 0] - coef @ s[1:, 0]), 0.0)
            r2 = 1 - left / s[0, 0] if s[0, 0] > 0 else None
            s2 = left / (n - k - 1) if n > k + 1 else None
            first = float(means[0] - coef @ means[1:])
            se = [None] * (k + 1) if s2 is None else [float(np.sqrt(s2 * (1 / n + means[1:] @ inverse @ means[1:]))), *np.sqrt(s2 * np.diag(inverse)).tolist()]
            none = list(zip([first, *coef.tolist()], se, strict=True))
    return [(name, c, e, n, r2, s2) for name, (c, e) in zip(names, none, strict=True)]


def linear(df: DataFrame, key: str, y: str, xs: list[str]) -> DataFrame:
    """Least squares of ``y`` on ``xs`` with an intercept, for each ``key``; null keys are a group."""
    return solve(moments(df, key, y, xs), xs).withColumnRenamed("key", key)
