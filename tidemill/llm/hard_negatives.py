"""Hard negatives: for each anchor and positive the best rows of other labels whose score lies in a window below the positive's.

A score is the inner product of two rows' whole-number components, so it is exact
and ties are real; they go to the smaller id. Rows lie in inverted lists around
centroids of k-means, and each list keeps its radius, the largest distance of its rows to
its centroid c. By Cauchy-Schwarz no row of a list scores above a.c + |a| r nor
below a.c - |a| r for an anchor a. An anchor visits lists in falling order of
that upper bound, a few, then eight times as many, then all others; lists whose bounds
lie outside its window are skipped, and it stops at the first list whose bound is
strictly below its k-th score so far. A bound equal to that score could still hold a tie, so such lists are visited.
Bounds are widened by a part in 10^9, so floating point loses no row.

The first search finds an anchor's positives, the best rows of its own label; the
second its negatives, with one window for each positive. In a round, visits meet
lists by cell in blocks of at most ``BLOCK`` rows on either side, compared by matrix
products of which only k rows for each window leave the task. Centroids are
fitted on at most ``FIT_ROWS`` rows, which moves work about and no result: every row is in a list.
Only the centroids, at most ``CELLS``, and counts by cell go through the driver.

Rows with a null id, label or vector, or with a null or non-finite component,
take no part. Shorter vectors are continued with zeros. Repeated rows are rows of
their own, but an anchor's own id is never its positive, and of several rows with
an anchor's id the one with the least label and vector is the anchor. Scores above 2^53
are rounded to doubles. Empty tables, and anchors without a positive, give no rows. Columns other
than the three named don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm import vectors as v
from tidemill.llm.common import forget, keep

#: Lists visited in the first round; each later round takes so many times more.
FIRST, WIDER = 8, 8
#: Bounds of a window without bounds.
OPEN = 1 << 62

_WINDOWS = "array<struct<w:int,lo:bigint,hi:bigint,kth:bigint>>"


@dataclass
class Lists:
    """``rows``: cell, id, label, q, a kept table. ``centers``, ``radius`` and ``sizes`` are by cell."""

    rows: DataFrame
    centers: np.ndarray
    radius: np.ndarray
    sizes: dict[int, int]


def whole(rows: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """A kept table of id, label and whole-number components, and the number of components."""
    found = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("x"))
    found = found.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.usable(F.col("x")))
    found = keep(found.withColumn("q", F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("double"))).drop("x"), "vectors", sweep=False)
    size = found.agg(F.max(F.size("q"))).first()[0] or 0
    return found.withColumn("q", v.padded(F.col("q"), size)), size


def index(rows: DataFrame, size: int, cells: int | None = None) -> Lists | None:
    """Inverted lists of rows of ``whole``, none of no rows."""
    n = rows.count()
    if not n or not size:
        return None
    fit = keep(v.sample(rows, n, "id").select("q"), "fit", sweep=False)
    centers = v.centroids(fit, "q", n, cells)
    forget(fit)

    def assign(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in v.batches(found):
            d = v.squared(x := v.matrix(b["q"], size), centers)
            cell = d.argmin(1)
            far = np.sqrt(np.square(x - centers[cell]).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b["id"], b["label"], b["q"], pa.array(far, pa.float64())], ["cell", "id", "label", "q", "far"])

    placed = keep(rows.mapInArrow(assign, "cell int, id long, label long, q array<double>, far double"), "lists", sweep=False)
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()
    radius = np.full(len(centers), -1.0)
    for s in stats:
        radius[s["cell"]] = s["r"]
    return Lists(placed.drop("far"), centers, radius, {s["cell"]: s["n"] for s in stats})


def search(asked: DataFrame, found_in: Lists, k: int, same: bool) -> DataFrame:
    """The ``k`` best rows of each window of each query: qid, w, rank, id, score; a kept table.

    ``asked``: qid (distinct ids, whose own rows are left out), label, q, windows. A row's
    label must be the query's where ``same``, else another; a hundred times its score must lie in lo to hi.
    """
    centers, radius, size = found_in.centers, found_in.radius, found_in.centers.shape[1]
    best, at, width = None, 0, FIRST

    while at < len(centers):
        visits = keep(asked.mapInArrow(_visits(centers, radius, at, at + width), f"cell int, qid long, label long, q array<double>, windows {_WINDOWS}"), "visits", sweep=False)
        at, width = at + width, width * WIDER
        rows, visits_cut = v.in_blocks(found_in.rows, visits, found_in.sizes)
        key = ("cell", "_block", "_part")
        got = rows.groupBy(*key).cogroup(visits_cut.groupBy(*key)).applyInArrow(_compare(size, k, same), "qid long, w int, id long, score long")
        both = got if best is None else got.unionByName(best.drop("rank"))
        rank = F.row_number().over(W.partitionBy("qid", "w").orderBy(F.desc("score"), "id"))
        merged = keep(both.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "w", "rank", "id", "score"), "best", sweep=False)
        forget(visits, *([best] if best is not None else []))
        best = merged
        if at < len(centers):
            kth = best.where(F.col("rank") == k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
            with_kth = F.transform("windows", lambda x: F.struct(x["w"].alias("w"), x["lo"].alias("lo"), x["hi"].alias("hi"), F.element_at("kth", x["w"]).alias("kth")))
            asked = keep(asked.drop("kth").join(kth, "qid", "left").select("qid", "label", "q", F.when(F.col("kth").isNull(), F.col("windows")).otherwise(with_kth).alias("windows")), "asked", sweep=False)
    return best


def _visits(centers: np.ndarray, radius: np.ndarray, low: int, high: int):  # noqa: ANN202
    """From queries the visits at the places ``low`` to ``high`` of their orders of lists."""

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in v.batches(found, 256):
            x = v.matrix(b["q"], centers.shape[1])
            middle, reach = x @ centers.T, np.sqrt(np.square(x).sum(1))[:, None] * radius[None, :]
            slack = 1 + 1e-9 * (np.abs(middle) + reach)
            upper, lower = middle + reach + slack, middle - reach - slack
            upper[:, radius < 0] = -np.inf
            order = np.argsort(-upper, axis=1, kind="stable")[:, low:high]
            windows = b["windows"]
            each = windows.flatten()
            lo, hi, kth = (each.field(i).fill_null(-OPEN).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2, 3))
            owner = np.repeat(np.arange(len(x)), windows.value_lengths().to_numpy(zero_copy_only=False))
            up, down = np.take_along_axis(upper, order, 1)[owner], np.take_along_axis(lower, order, 1)[owner]
            fits = (100 * up >= lo[:, None]) & (100 * down <= hi[:, None]) & (up >= kth[:, None]) & np.isfinite(up)
            wanted = np.zeros(order.shape, bool)
            np.logical_or.at(wanted, owner, fits)
            q, place = np.nonzero(wanted)
            rows = b.take(pa.array(q))
            yield pa.RecordBatch.from_arrays([pa.array(order[q, place], pa.int32()), *(rows[c] for c in ("qid", "label", "q", "windows"))], ["cell", "qid", "label", "q", "windows"])

    return run


def _compare(size: int, k: int, same: bool):  # noqa: ANN202
    """From a block of rows and a part of the visits of one cell the ``k`` best rows of each window."""

    def run(rows: pa.Table, visits: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))]
        if rows.num_rows and visits.num_rows:
            rows = rows.sort_by("id")  # of equal scores the first is the one with the smallest id
            ids, labels, x = rows["id"].to_numpy(), rows["label"].to_numpy(), v.matrix(rows["q"], size)
            for at in range(0, visits.num_rows, 256):
                some = visits.slice(at, 256).combine_chunks()
                qid, own = some["qid"].to_numpy(), some["label"].to_numpy()
                score = v.matrix(some["q"], size) @ x.T
                may = ((labels[None, :] == own[:, None]) == same) & (ids[None, :] != qid[:, None])
                windows = some["windows"].combine_chunks()
                each = windows.flatten()
                owner = np.repeat(np.arange(len(qid)), windows.value_lengths().to_numpy(zero_copy_only=False))
                w, lo, hi = (each.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                for turn in range(int(np.bincount(owner, minlength=1).max())):  # one window of each query at a time
                    first = np.searchsorted(owner, np.arange(len(qid))) + turn
                    has = (first < len(owner)) & (owner[np.minimum(first, len(owner) - 1)] == np.arange(len(qid)))
                    who, win = np.nonzero(has)[0], first[has]
                    s = np.where(may[who] & (100 * score[who] >= lo[win, None]) & (100 * score[who] <= hi[win, None]), score[who], -np.inf)
                    for _ in range(min(k, len(ids))):
                        top = s.argmax(1)
                        value = s[np.arange(len(who)), top]
                        good = np.isfinite(value)
                        if not good.any():
                            break
                        out.append((qid[who[good]], w[win[good]], ids[top[good]], value[good].astype(np.int64)))
                        s[np.arange(len(who)), top] = -np.inf
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["qid", "w", "id", "score"])

    return run


def mine(
    rows: DataFrame, anchor: Callable[[Column], Column], id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, cells: int | None = None,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor``: from an id the condition that it is an anchor's. Negatives score between ``low`` and ``high`` hundredths of the positive.
    """
    spark = rows.sparkSession
    table, size = whole(rows, id_col, F.col("label") if label is None else label, vector_col, scale)
    found_in = index(table, size, cells)
    if found_in is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    queries = found_in.rows.where(anchor(F.col("id")))
    queries = queries.groupBy(F.col("id").alias("qid")).agg(F.min(F.struct("label", "q")).alias("r")).select("qid", "r.label", "r.q")
    window = lambda w, lo, hi: F.struct(w.cast("int").alias("w"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.lit(None).cast("long").alias("kth"))
    anchors = keep(queries.withColumn("windows", F.array(window(F.lit(0), F.lit(-OPEN), F.lit(OPEN)))), "anchors", sweep=False)
    near = search(anchors, found_in, positives, same=True)
    asked = near.groupBy("qid").agg(F.sort_array(F.collect_list(window(F.col("rank"), F.col("score") * low, F.col("score") * high))).alias("windows"))
    asked = keep(anchors.drop("windows").join(asked, "qid"), "asked", sweep=False)
    far = search(asked, found_in, negatives, same=False)
    pairs = near.select("qid", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(pairs, ["qid", "w"]).select(
        F.col("qid").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
