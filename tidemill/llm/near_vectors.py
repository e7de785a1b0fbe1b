"""Near duplicates among embeddings by cosine, by product quantisation over inverted lists.

Vectors are scaled to length 1 in double precision; equal vectors are one class with
a weight. Cosine ``least`` is then a distance d = sqrt(2 - 2 least). Classes lie in
coarse lists around k-means centroids c; the residual x - c is cut into subspaces and
each part is written as the nearest of at most 256 code words. A list keeps its
radius, a row its code and the length e of what the code leaves out.

*Sufficient probes.* A vector y of list b is compared with its own list and with those
lists a < b that can hold a vector within d: y must lie within d + radius(a) of a,
and within d of the plane midway between a and b, since everything on a's side of it is
nearer to a. No other list can hold a link that isn't found from its other end.

*Table lookups.* y gets a table of the inner products of its parts with all code words, which holds for
all lists. A row's approximate distance is the sum of its code's entries, with what depends on y and the centroid alone and
on the row alone; as it is off by at most e, rows beyond d + e can't link. All others get an exact cosine. So
neither step loses a link; only the rounding of doubles at the limit itself is open.

*Rounds.* Lists are bundled to about a block of rows, large ones cut in pieces, and a row goes once to each bundle
in which it must be compared, however many of its lists that are. Nearly all rows may have to go to nearly all bundles, as vectors
without clusters do, so bundles are dealt to rounds by counts made before: no round shuffles
more rows than the table has (``ROUND`` at least; one piece of a list may take twice its visitors), and its shuffle files go before the next.
Scratch space is thus in proportion to the table; the time is not, where the bounds part nothing.

*Groups.* Rows within half the angle of ``least`` of their centroid's direction all link with each
other by the triangle inequality. They are counted, not compared, so a
group of near copies costs as many steps as it has rows; centroids that close to an
earlier one are dropped, so that such a group is one list. Compared blocks give counts by row and the edges of
a spanning forest, never all pairs, each summed over a block. Blocks have a sixteenth of the table on either side,
``BLOCK`` / 8 to ``BLOCK`` * 8 rows, dealt by a hash of their number.

Centroids and codes are fitted on at most ``FIT_ROWS`` rows; every row is indexed.
Only they and counts by list go through the driver. Kept tables hold vectors as they are given, with their lengths.

Rows with a null id, and null, zero and non-finite vectors, link with nothing.
Shorter vectors are continued with zeros. Repeated rows link with each other. Empty
tables give no rows. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import vectors as v
from tidemill.llm.common import forget, keep
from tidemill.llm.components import components

LEAST = 0.95
SUBSPACES = 8
WORDS = 256
ROUNDS = 8
#: What distances are widened by for floating point, and squared ones for tables in single precision.
SLACK = 1e-6
SINGLE = 2e-5
#: Rows that a round may shuffle at least; otherwise as many as the table has.
ROUND = 1 << 20


@dataclass
class Quantiser:
    centers: np.ndarray
    words: list[np.ndarray]  # by subspace

    @property
    def cuts(self) -> list[slice]:
        ends = np.cumsum([0, *(w.shape[1] for w in self.words)])
        return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and lengths of what they leave out."""
        rest = x - self.centers[cell]
        code = np.stack([v.squared(rest[:, s], w).argmin(1) for s, w in zip(self.cuts, self.words, strict=True)], axis=1).astype(np.uint8)
        left = rest - np.concatenate([w[code[:, i]] for i, w in enumerate(self.words)], axis=1)
        return code, np.sqrt(np.square(left).sum(1))

    def tables(self, y: np.ndarray, kind: type = np.float64) -> list[np.ndarray]:
        """By subspace, the inner products of all code words (rows) with the parts of ``y`` (columns)."""
        return [w.astype(kind) @ y[:, s].T.astype(kind) for s, w in zip(self.cuts, self.words, strict=True)]

    def fixed(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What of a row's approximate squared distance doesn't depend on the other vector."""
        out, c = np.zeros(len(code)), self.centers[cell]
        for i, (s, w) in enumerate(zip(self.cuts, self.words, strict=True)):
            out += np.square(w).sum(1)[code[:, i]] + 2 * (c[:, s] * w[code[:, i]]).sum(1)
        return out

    def lookup(self, y: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """Approximate squared distances of all ``y`` to the rows of a list with these codes."""
        own = self.fixed(np.full(len(code), cell), code)
        return np.maximum(np.square(y - self.centers[cell]).sum(1)[:, None] + own[None, :] - 2 * summed(self.tables(y), code).T, 0)


def summed(tables: list[np.ndarray], code: np.ndarray) -> np.ndarray:
    """The sums of the entries of codes (rows) for all columns of ``tables``."""
    out = tables[0][code[:, 0]]
    for i, t in enumerate(tables[1:], 1):
        out += t[code[:, i]]
    return out


def fit(rows: DataFrame, size: int, least: float, cells: int | None) -> Quantiser:
    """``rows``: a kept table of x, vectors of length 1."""
    n = rows.count()
    some = keep(v.sample(rows, n, "x").select("x"), "fit", sweep=False)
    found = v.centroids(some, "x", n, cells)
    tight = 2 * math.sin(math.acos(least) / 4)
    centers = np.empty((0, size))
    for c in found:
        if not len(centers) or v.squared(c[None], centers).min() > tight**2:
            centers = np.vstack([centers, c])
    subs = np.array_split(np.arange(size), min(SUBSPACES, size))

    def residuals(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            x = v.matrix(b["x"], size)
            rest = x - centers[v.squared(x, centers).argmin(1)]
            for i, s in enumerate(subs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i), pa.int32()), v.lists(np.ascontiguousarray(rest[:, s]), pa.float64())], ["sub", "r"])

    def learn(key: tuple, part: pa.Table) -> pa.Table:
        i = key[0].as_py()
        r = v.matrix(part["r"], len(subs[i]))
        r = r[np.lexsort(r.T)]
        w = r[np.unique(np.linspace(0, len(r) - 1, WORDS).astype(int))].copy()
        for _ in range(ROUNDS):
            near = v.squared(r, w).argmin(1)
            n = np.bincount(near, minlength=len(w))
            total = np.stack([np.bincount(near, weights=c, minlength=len(w)) for c in r.T], axis=1)
            w[n > 0] = total[n > 0] / n[n > 0, None]
        return pa.table([pa.array([i], pa.int32()), pa.array([w.ravel().tolist()], pa.list_(pa.float64()))], names=["sub", "w"])

    got = some.mapInArrow(residuals, "sub int, r array<double>").groupBy("sub").applyInArrow(learn, "sub int, w array<double>").collect()
    forget(some)
    words = {r["sub"]: np.array(r["w"]).reshape(-1, len(subs[r["sub"]])) for r in got}
    return Quantiser(centers, [words[i] for i in range(len(subs))])


def _place(q: Quantiser, size: int, half: float):  # noqa: ANN202
    directions = q.centers / np.maximum(np.sqrt(np.square(q.centers).sum(1, keepdims=True)), 1e-300)

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in v.batches(found):
            x = v.matrix(b["x"], size)
            cell = v.squared(x, q.centers).argmin(1)
            code, e = q.encode(x, cell)
            far = np.sqrt(np.square(x - q.centers[cell]).sum(1))
            core = np.arccos(np.clip((x * directions[cell]).sum(1), -1, 1)) <= half
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *b.columns, codes, pa.array(e), pa.array(far), pa.array(core)], ["cell", *b.schema.names, "code", "e", "far", "core"])

    return run


@dataclass
class Probes:
    """The lists that rows must be compared with, and their bundles. ``idle``: lists of core rows alone."""

    centers: np.ndarray
    radius: np.ndarray
    idle: np.ndarray
    reach: float
    first: np.ndarray  # cells that bundles begin with

    def cells(self, begin: int, end: int) -> tuple[int, int]:
        """The cells of bundles from ``begin`` up to ``end``."""
        ends = np.append(self.first, len(self.centers))
        return int(ends[begin]), int(ends[end])

    def may(self, x: np.ndarray, own: np.ndarray, core: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether rows must be compared with the lists from ``low`` up to ``high``, and their squared distances to these centroids."""
        some, cells = self.centers[low:high], np.arange(low, high)
        d2, mine = v.squared(x, some), np.square(x - self.centers[own]).sum(1)
        between = np.sqrt(v.squared(self.centers, some))[own]
        may = (np.sqrt(d2) <= self.reach + self.radius[None, low:high]) & (d2 - mine[:, None] <= 2 * self.reach * between + SLACK) & (cells[None, :] < own[:, None])
        at = np.flatnonzero((own >= low) & (own < high))
        may[at, own[at] - low] = ~(core[at] & self.idle[own[at]])
        return may, d2

    def bundles(self, b: pa.RecordBatch, begin: int, end: int) -> np.ndarray:
        """Rows by bundles from ``begin`` up to ``end``: whether they must go there."""
        low, high = self.cells(begin, end)
        may, _ = self.may(_units(b, self.centers.shape[1]), b["cell"].to_numpy(), b["core"].to_numpy(zero_copy_only=False), low, high)
        return np.logical_or.reduceat(may, self.first[begin:end] - low, axis=1)

    def count(self, found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(self.first), np.int64)
        for b in v.batches(found):
            total += self.bundles(b, 0, len(self.first)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["bundle", "visits"])

    def visits(self, begin: int, end: int):  # noqa: ANN201
        def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in v.batches(found):
                y, bundle = np.nonzero(self.bundles(b, begin, end))
                rows = b.take(pa.array(y))
                yield pa.RecordBatch.from_arrays([pa.array(bundle + begin, pa.int32()), *rows.columns], ["bundle", *rows.schema.names])

        return run


def _units(rows: pa.Table | pa.RecordBatch, size: int) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    return v.matrix(rows["raw"], size) / rows["norm"].to_numpy()[:, None]


def bundled(sizes: np.ndarray, block: int) -> np.ndarray:
    """The first cells of bundles: neighbouring lists of at most ``block`` rows together, or a larger one alone."""
    first, total = [0], 0
    for cell, n in enumerate(sizes):
        if total and total + n > block:
            first.append(cell)
            total = 0
        total += n
    return np.array(first)


def rounds(rows: np.ndarray, visits: np.ndarray, block: int, most: int) -> list[list[tuple[int, int, int, int, int]]]:
    """Bundles in rounds that shuffle ``most`` rows, or one piece of a bundle: bundle, its pieces and parts of its visits, and the pieces due, from and up to."""
    out, total = [[]], 0
    for k, (r, n) in enumerate(zip(rows.tolist(), visits.tolist(), strict=True)):
        if not r or not n:
            continue
        pieces, parts, done = -(-r // block), -(-n // block), 0
        cost = n + -(-r // pieces) * parts
        while done < pieces:
            fits = max(most - total, 0) // cost
            if not fits and out[-1]:
                out.append([])
                total = 0
                continue
            some = min(max(fits, 1), pieces - done)
            out[-1].append((k, pieces, parts, done, done + some))
            total, done = total + some * cost, done + some
    return [x for x in out if x]


def forest(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of the links between ``a`` (rows) and ``b`` (columns), about as many as there are linked ids."""
    i, j = links.any(1), links.any(0)
    m, a, b = links[np.ix_(i, j)], a[i], b[j]
    if m.sum() <= len(a) + len(b):
        r, c = np.nonzero(m)
        return a[r], b[c]
    top = np.arange(len(b))
    while True:
        left = np.where(m, top[None, :], len(b)).min(1)
        new = np.minimum(top, np.where(m, left[:, None], len(b)).min(0))
        new = new[new]
        if (new == top).all():
            return np.concatenate([a, b]), np.concatenate([b[left], b[top]])
        top = new


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of the edges between ``a`` and ``b``, one for each id at most."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    s, t = at[: len(a)], at[len(a) :]
    top = np.arange(len(ids))
    while (top[s] != top[t]).any():
        low = np.minimum(top[s], top[t])
        for end in (top[s], top[t]):
            np.minimum.at(top, end, low)
        while (top[top] != top).any():
            top = top[top]
    child = top != np.arange(len(ids))
    return ids[child], ids[top[child]]


def _compare(q: Quantiser, probes: Probes, size: int, least: float):  # noqa: ANN202
    """From a piece of a bundle and a part of its visits: ``kind`` 0 gives ``a`` ``b`` more links, 1 is an edge."""

    def run(key: tuple, rows: pa.Table, visits: pa.Table) -> pa.Table:
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if not rows.num_rows or not visits.num_rows:
            return pa.table([np.empty(0, np.int32), left[0], right[0]], names=["kind", "a", "b"])
        low, high = probes.cells(key[0].as_py(), key[0].as_py() + 1)
        rows = rows.sort_by("cell")
        x, code = _units(rows, size), np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        cell, uid, n, core = (rows[c].to_numpy() for c in ("cell", "uid", "n", "core"))
        limit = ((q.fixed(cell, code) - np.square(probes.reach + rows["e"].to_numpy()) - SINGLE) / 2).astype(np.float32)
        begun = np.searchsorted(cell, np.arange(low, high + 1))
        their_links, links_of = np.zeros(visits.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
        everyone = visits["uid"].to_numpy()
        for at in range(0, visits.num_rows, 256):
            some = visits.slice(at, 256)
            y, (own, their, m, their_core) = _units(some, size), (some[c].to_numpy() for c in ("cell", "uid", "n", "core"))
            may, d2 = probes.may(y, own, their_core, low, high)
            tables, need = q.tables(y, np.float32), (d2 / 2).astype(np.float32)
            for k in np.flatnonzero(may.any(0) & (np.diff(begun) > 0)):
                who = np.flatnonzero(may[:, k])
                if 2 * len(who) > len(y):
                    who, mine = np.arange(len(y)), tables
                else:
                    mine = [t[:, who] for t in tables]
                for r in range(begun[k], begun[k + 1], 1024):
                    part = slice(r, min(r + 1024, begun[k + 1]))
                    near = summed(mine, code[part])
                    near -= limit[part, None]
                    near = near >= need[who, k][None, :]
                    if not near.any():
                        continue
                    i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                    links = near[np.ix_(i, j)] & may[who[j], k][None, :]
                    i, j = i + r, who[j]
                    # Within a list each pair counts once, and core rows are linked already.
                    links &= (own[j] != low + k)[None, :] | ((their[j][None, :] < uid[i][:, None]) & ~(their_core[j][None, :] & core[i][:, None]))
                    links &= x[i] @ y[j].T >= least
                    if links.any():
                        their_links[at + j] += n[i] @ links
                        links_of[i] += links @ m[j]
                        for found, ids in zip((left, right), forest(links.T, their[j], uid[i]), strict=True):
                            found.append(ids)
        a, b = spanning(np.concatenate(left), np.concatenate(right))
        count = np.concatenate([their_links, links_of])
        at = np.flatnonzero(count)
        kind = np.repeat(np.array([0, 1], np.int32), [len(at), len(a)])
        return pa.table([kind, np.concatenate([np.concatenate([everyone, uid])[at], a]), np.concatenate([count[at], b])], names=["kind", "a", "b"])

    return run


def classes(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` as id, h, g, and the distinct vectors: uid, h, g, rep, n, x; h and g are 128 bits of the vector, null where it can't link."""
    each, distinct = _classes(rows, id_col, vector_col)
    return each, distinct.withColumn("x", _unit())


def _unit() -> Column:
    return F.transform(F.col("raw").cast("array<double>"), lambda c: c / F.col("norm"))


def _classes(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """As ``classes``, with a kept table that has vectors as given, and their lengths, in place of x."""
    x = F.col("x").cast("array<double>")
    norm2 = F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c)
    can = F.col("id").isNotNull() & v.usable(F.col("x")) & (norm2 > 0) & (norm2 < float("inf"))
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    key = lambda *seed: F.when(can, F.xxhash64(*seed, F.col("x")))
    found = found.withColumn("h", key()).withColumn("g", key(F.lit("g")))
    distinct = found.where("h IS NOT NULL").groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("x").alias("x"))
    raw = F.col("x") if found.schema["x"].dataType.simpleString() == "array<float>" else x
    distinct = distinct.select(F.monotonically_increasing_id().alias("uid"), "h", "g", "rep", "n", raw.alias("raw"), F.sqrt(norm2).alias("norm"))
    return found.select("id", "h", "g"), keep(distinct, "classes")


def dedup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, cells: int | None = None) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` for each row."""
    spark = rows.sparkSession
    each, distinct = _classes(rows, id_col, vector_col)
    size = distinct.agg(F.max(F.size("raw"))).first()[0] or 0
    counts, edges = spark.createDataFrame([], "uid long, links long"), spark.createDataFrame([], "a long, b long")
    if size:
        kind = distinct.schema["raw"].dataType.simpleString()
        some = distinct.withColumns({"x": v.padded(_unit(), size), "raw": v.padded(F.col("raw"), size, kind)})
        q, placed = lists(some, kind, size, least, cells)
        vectors, distinct = distinct, keep(distinct.drop("raw", "norm"), "classes", sweep=False)
        forget(vectors)
        counts, edges = links(placed, q, size, least)
    comps = components(edges, "a", "b").select(F.col("node").alias("uid"), "comp")
    comps = keep(comps.join(distinct.select("uid", "rep"), "uid"), "comps", sweep=False)
    first = comps.groupBy("comp").agg(F.min("rep").alias("component_id"))
    labels = comps.join(first, "comp").select("uid", "component_id")
    info = distinct.select("uid", "h", "g", "rep", "n").join(counts, "uid", "left").join(labels, "uid", "left").where("n > 1 OR links IS NOT NULL")
    info = info.select("h", "g", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    found = each.join(info, ["h", "g"], "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return found.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def lists(distinct: DataFrame, kind: str, size: int, least: float = LEAST, cells: int | None = None) -> tuple[Quantiser, DataFrame]:
    """The index: a quantiser, and a kept table of coded rows by cell. ``kind``: the type of ``raw``."""
    q = fit(distinct.select("x"), size, least, cells)
    shape = f"cell int, uid long, n long, x array<double>, raw {kind}, norm double, code binary, e double, far double, core boolean"
    placed = distinct.select("uid", "n", "x", "raw", "norm").mapInArrow(_place(q, size, math.acos(least) / 2 - SLACK), shape)
    return q, keep(placed.drop("x"), "lists", sweep=False)


def links(placed: DataFrame, q: Quantiser, size: int, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Links by class, weighted, and edges that connect what is linked. The kept table ``placed`` goes."""
    spark, core = placed.sparkSession, F.col("core")
    stats = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("far").alias("r"), F.count(F.when(core, 1)).alias("cores"), F.sum(F.when(core, F.col("n"))).alias("weight"), F.min(F.when(core, F.col("uid"))).alias("root"))
    stats = keep(stats, "stats", sweep=False)
    radius, idle, sizes = np.full(len(q.centers), -np.inf), np.ones(len(q.centers), bool), np.zeros(len(q.centers), np.int64)
    for s in stats.collect():
        radius[s["cell"]], idle[s["cell"]], sizes[s["cell"]] = s["r"], s["cores"] == s["rows"], s["rows"]
    n = int(sizes.sum())
    block = min(max(n // 16, v.BLOCK // 8), v.BLOCK * 8)
    probes = Probes(q.centers, radius, idle, math.sqrt(2 - 2 * least) + SLACK, bundled(sizes, block))
    visitors = placed.select("cell", "uid", "n", "raw", "norm", "core")
    visit = f"bundle int, cell int, uid long, n long, raw {placed.schema['raw'].dataType.simpleString()}, norm double, core boolean"
    asked = np.zeros(len(probes.first), np.int64)
    for r in visitors.mapInArrow(probes.count, "bundle int, visits long").groupBy("bundle").agg(F.sum("visits").alias("visits")).collect():
        asked[r["bundle"]] = r["visits"]
    key = ("bundle", "_piece", "_part")
    dealt = lambda c: F.pmod(F.xxhash64(F.lit(c), F.col("uid")), F.col(c)).cast("int")
    got = spark.createDataFrame([], "kind int, a long, b long")
    for some in rounds(np.add.reduceat(sizes, probes.first), asked, block, max(ROUND, n)):
        begin, end = some[0][0], some[-1][0] + 1
        grid = spark.createDataFrame(some, "bundle int, _pieces int, _parts int, _from int, _to int")
        of = spark.createDataFrame([(c, s[0]) for s in some for c in range(*probes.cells(s[0], s[0] + 1))], "cell int, bundle int").join(grid, "bundle")
        tasks = sum(parts * (to - at) for _, _, parts, at, to in some)
        rows = placed.select("cell", "uid", "n", "raw", "norm", "code", "e", "core").join(F.broadcast(of), "cell").withColumn("_piece", dealt("_pieces")).where("_piece >= _from AND _piece < _to")
        rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_pieces", "_parts", "_from", "_to").repartition(tasks, *key)
        came = visitors.where(F.col("cell") >= probes.cells(begin, end)[0]).mapInArrow(probes.visits(begin, end), visit)
        came = came.join(F.broadcast(grid), "bundle").withColumn("_part", dealt("_parts"))
        came = came.withColumn("_piece", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1))).drop("_pieces", "_parts", "_from", "_to").repartition(tasks, *key)
        got = got.unionByName(keep(rows.groupBy(*key).cogroup(came.groupBy(*key)).applyInArrow(_compare(q, probes, size, least), "kind int, a long, b long"), "links"))
    tight = placed.where("core").select("cell", "uid", "n").join(F.broadcast(stats.where("cores > 1").select("cell", "weight", "root")), "cell")
    tight = keep(tight, "tight", sweep=False)
    forget(placed)
    counts = got.where("kind = 0").select(F.col("a").alias("uid"), F.col("b").alias("links")).unionByName(tight.select("uid", (F.col("weight") - F.col("n")).alias("links")))
    edges = got.where("kind = 1").select("a", "b").unionByName(tight.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    return counts.groupBy("uid").agg(F.sum("links").alias("links")), edges
