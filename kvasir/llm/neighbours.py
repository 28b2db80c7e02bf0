"""The most similar vectors of every vector.

Method. The vectors, scaled to length one, are projected by independent Gaussian matrices (2-stable: the squared
difference of two projections, over that of the vectors, is chi-square with as many degrees of freedom as dimensions are
compared). Each projection is indexed by a kd-tree in two levels. Its upper cells are the blocks that Spark distributes;
every block builds the lower levels over its rows and is searched row by row: first the row's own leaf, which gives the
distance d of its k-th neighbour, then one leaf after the other by the projected distance of their boxes, d shrinking on
the way, until the chi-square test rejects a neighbour nearer than d in the next leaf and so in all after it. Visited
leaves are verified with the whole vectors. Leaves, not single points, are the increments, as one matrix product verifies
a leaf.

The border of a block doesn't end the search. A row whose projection lies so near to a cut that the test does not reject
a neighbour of at least the lowest similarity beyond it is also put into the block beyond. It is enough to do so from the
lower to the upper side, as the two rows of a pair then meet in the upper one. Cuts halve the rows with these copies
counted, a cell that still has more than ``block_rows`` rows is cut again, and each block is one task, so no task grows
with the data.

A third of all rows may share one vector: equal vectors are one point of the index, and their records are linked to the
first of them afterwards, so that no block grows with the number of copies.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvasir.operators.joins import hottest_keys, skew_left_join
from kvasir.sources.tables import cut

UNIT = 32767.0  # length-one components are kept as 16-bit integers, which changes a cosine by less than 0.0003
DIMS = 12  # of a projection
LEAST_SAMPLE = 32  # rows of the sample in a cell that is cut by it
ROUNDS = 12  # of cutting again
SEED = 20240607


def parse_vector(text: str | None, size: int) -> np.ndarray | None:
    """The vector of a JSON text, or None unless it is exactly ``size`` finite numbers that aren't all zero."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, list) or len(value) != size or not {float, int}.issuperset(map(type, value)):
        return None
    try:
        v = np.array(value, dtype=np.float64)
    except OverflowError:
        return None
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0 or np.isnan(v).any():
        return None
    v /= top
    return v / math.sqrt(float(v @ v))


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """``id, vec``: each usable vector, scaled to length one, as 16-bit integers; other rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is not None and (v := parse_vector(t, size)) is not None:
                    ids.append(i)
                    vecs.append(np.rint(v * UNIT).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], ["id", "vec"])

    return df.select(F.col(id_col).cast("bigint"), F.col(vec_col)).mapInArrow(run, "id bigint, vec binary")


def chi_square_quantile(p: float, dof: int) -> float:
    """The value below which a chi-square variable of ``dof`` degrees of freedom lies with probability ``p``."""

    def below(x: float) -> float:
        a, z = dof / 2, x / 2
        if z <= 0:
            return 0.0
        term = total = 1 / a
        n = 1
        while term > 1e-12 * total and n < 500:
            term *= z / (a + n)
            total += term
            n += 1
        return min(1.0, math.exp(-z + a * math.log(z) - math.lgamma(a)) * total)

    lo, hi = 0.0, 200.0
    for _ in range(70):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return lo


def projections(trees: int, size: int) -> np.ndarray:
    """``trees`` independent 2-stable projection matrices."""
    return np.random.default_rng(SEED).normal(size=(trees, size, DIMS)).astype(np.float32)


class Cells:
    """The upper levels of a kd-tree: nodes with a dimension and a cut, or leaves, which are the blocks."""

    def __init__(self, margin: float):
        self.margin, self.dims, self.cuts, self.left = margin, [-1], [0.0], [-1]

    def blocks(self) -> list[int]:
        """The leaves."""
        return [i for i, d in enumerate(self.left) if d < 0]

    def grow(self, node: int, y: np.ndarray, weight: float, most: int) -> None:
        """Cut the leaf ``node`` until each leaf has at most ``most`` rows, ``weight`` for each row of the sample ``y``."""
        todo = [(node, y)]
        while todo:
            at, own = todo.pop()
            if len(own) * weight <= most or len(own) < LEAST_SAMPLE:
                continue
            d = int(np.argmax(own.std(0)))
            v = np.sort(own[:, d])
            # The cut that halves the rows, of which the lower ones within the margin are on both sides.
            below = np.arange(1, len(v) + 1)
            above = len(v) - np.searchsorted(v, v - self.margin, side="right")
            i = int(np.argmin(np.abs(below - above)))
            cut = float(v[i])
            if max(below[i], above[i]) > 0.9 * len(v):
                continue  # too small a cell for the margin, or one point
            self.dims[at], self.cuts[at], self.left[at] = d, cut, len(self.left)
            self.dims += [-1, -1]
            self.cuts += [0.0, 0.0]
            self.left += [-1, -1]
            low, high = own[own[:, d] <= cut], own[own[:, d] > cut - self.margin]
            todo += [(self.left[at], low), (self.left[at] + 1, high)]

    def of(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their blocks; a row near a cut is in several."""
        dims, cuts, left = np.array(self.dims), np.array(self.cuts, np.float32), np.array(self.left)
        rows, nodes, done = np.arange(len(y)), np.zeros(len(y), np.int64), []
        while len(rows):
            leaf = left[nodes] < 0
            done.append((rows[leaf], nodes[leaf]))
            rows, nodes = rows[~leaf], nodes[~leaf]
            v = y[rows, dims[nodes]]
            low, high = v <= cuts[nodes], v > cuts[nodes] - np.float32(self.margin)
            rows, nodes = np.concatenate([rows[low], rows[high]]), np.concatenate([left[nodes[low]], left[nodes[high]] + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])


class _Best:
    """The ``k`` nearest rows found so far of each row of a block."""

    def __init__(self, n: int, k: int, floor: float):
        self.k, self.sim, self.idx = k, np.full((n, k), floor, np.float32), np.full((n, k), -1, np.int32)

    def add(self, rows: np.ndarray, cols: np.ndarray, sims: np.ndarray) -> None:
        """Take in the pairs, of which a row may have any number; no pair comes twice."""
        if not len(rows):
            return
        order = np.lexsort((-sims, rows))
        rows, cols, sims = rows[order], cols[order], sims[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        keep = place < self.k
        own = rows[first]
        new_sim, new_idx = np.full((len(own), self.k), -2, np.float32), np.full((len(own), self.k), -1, np.int32)
        which = np.repeat(np.arange(len(own)), np.diff(np.r_[first, len(rows)]))[keep]
        new_sim[which, place[keep]], new_idx[which, place[keep]] = sims[keep], cols[keep]
        sim, idx = np.hstack([self.sim[own], new_sim]), np.hstack([self.idx[own], new_idx])
        top = np.argsort(-sim, axis=1, kind="stable")[:, : self.k]
        self.sim[own], self.idx[own] = np.take_along_axis(sim, top, 1), np.take_along_axis(idx, top, 1)


def search_block(x: np.ndarray, y: np.ndarray, k: int, floor: float, leaf: int, p_stop: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` most similar other rows of each row of a block, and their cosines; -1 where fewer reach ``floor``.

    ``x`` are the vectors, ``y`` their projections. The kd-tree's leaves hold at most ``leaf`` rows.
    """
    n, m = y.shape
    members: list[np.ndarray] = []
    boxes: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(np.arange(n), np.full(m, -np.inf, np.float32), np.full(m, np.inf, np.float32))]
    while todo:
        own, lo, hi = todo.pop()
        d = int(np.argmax(y[own].std(0))) if len(own) > leaf else 0
        at = np.median(y[own, d]) if len(own) > leaf else 0
        left = y[own, d] <= at
        if len(own) <= leaf or left.all():  # nothing to split: all rows lie on one point of the projection
            members.append(own)
            boxes.append((lo, hi))
            continue
        lower, upper = lo.copy(), hi.copy()
        upper[d] = lower[d] = at
        todo += [(own[left], lo, upper), (own[~left], lower, hi)]
    best = _Best(n, k, floor)

    def verify(rows: np.ndarray, cols: np.ndarray, home: bool) -> None:
        for part in np.array_split(rows, max(1, len(rows) * len(cols) // 1_000_000)):
            s = x[part] @ x[cols].T
            if home:
                s[part[:, None] == cols[None, :]] = -2
            need = best.sim[part, k - 1]
            if home and len(cols) > k:  # so that a dense leaf doesn't yield all its pairs
                need = np.maximum(need, np.partition(s, len(cols) - k, axis=1)[:, len(cols) - k])
                a, b = np.nonzero(s >= need[:, None])
            else:
                a, b = np.nonzero(s > need[:, None])
            best.add(part[a], cols[b], s[a, b])

    for own in members:
        verify(own, own, home=True)
    # Each leaf's projected distance from each row, in units of what the test allows a neighbour at distance 1.
    quantile = np.array([1.0] + [chi_square_quantile(p_stop, f) for f in range(1, m + 1)], np.float32)
    far = np.empty((n, len(members)), np.float32)
    for at, (own, (lo, hi)) in enumerate(zip(members, boxes)):
        square, outside = np.zeros(n, np.float32), np.zeros(n, np.int64)
        for d in np.flatnonzero(np.isfinite(lo) | np.isfinite(hi)):
            off = np.maximum(np.maximum(lo[d] - y[:, d], y[:, d] - hi[d]), 0)
            square += off * off
            outside += off > 0
        far[:, at] = square / quantile[outside]
        far[own, at] = np.inf
    order = np.argsort(far, axis=1, kind="stable").astype(np.int32)
    far = np.take_along_axis(far, order, 1)
    rows = np.arange(n)
    for step in range(len(members) - 1):  # one further leaf of each row whose test hasn't stopped it
        near = 2 - 2 * np.maximum(best.sim[rows, k - 1], floor)  # the squared distance a further neighbour must beat
        rows = rows[far[rows, step] <= near]
        if not len(rows):
            break
        leaf_of = order[rows, step]
        by_leaf = np.argsort(leaf_of, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(leaf_of[by_leaf]) > 0])
        for part in np.split(by_leaf, begin[1:]):
            verify(rows[part], members[leaf_of[part[0]]], home=False)
    best.sim[best.idx < 0] = np.nan
    return best.idx, best.sim


def fit_cells(points: DataFrame, mats: np.ndarray, n: int, *, size: int, margin: float, block_rows: int, sample_rows: int) -> list[Cells]:
    """The upper cells of each projection, cut until each has at most ``block_rows`` of the ``n`` rows of ``points``.

    Each round takes a sample of at most about ``sample_rows`` rows and counts all rows of each cell; cells that are too
    large are cut again by a sample of their own rows. A cell that no cut makes smaller stays as it is.
    """
    cells, large = [Cells(margin) for _ in mats], None
    if n <= block_rows:
        return cells

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
        for b in batches:
            if b.num_rows:
                raw = b.column(0).to_pylist()
                x = _floats(raw, size)
                for t, mat in enumerate(mats):
                    yield t, raw, *cells[t].of(x @ mat)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(c.left), np.int64) for c in cells]
        for t, _, _, nodes in blocks_of(batches):
            total[t] += np.bincount(nodes, minlength=len(total[t]))
        for t, own in enumerate(total):
            nodes = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), t)), pa.array(nodes), pa.array(own[nodes])], ["tree", "node", "n"])

    for turn in range(ROUNDS):
        if turn:
            rows = points.select("vec").mapInArrow(count, "tree bigint, node bigint, n bigint").groupBy("tree", "node").agg(F.sum("n").alias("n"))
            found = {(r.tree, r.node): r.n for r in rows.where(F.col("n") > block_rows).collect()}
            large = {k: c for k, c in found.items() if large is None or large.get(k) != c}  # the others can't be cut
            if not large:
                break
        share = min(1.0, sample_rows / (sum(large.values()) if large else n))
        seen = points.where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, raw, rows, nodes in blocks_of(batches):
                at = np.flatnonzero([(t, i) in large for i in nodes.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), pa.array(nodes[at]), pa.array([raw[i] for i in rows[at]], pa.binary())], ["tree", "node", "vec"])

        if large:
            got = seen.mapInArrow(keep, "tree bigint, node bigint, vec binary").toArrow()
            tree, node, x = got["tree"].to_numpy(), got["node"].to_numpy(), _floats(got["vec"].to_pylist(), size)
            for t, i in sorted(large):
                cells[t].grow(i, x[(tree == t) & (node == i)] @ mats[t], 1 / share, block_rows)
        else:
            x = _floats(seen.toArrow().column(0).to_pylist(), size)
            for t, mat in enumerate(mats):
                cells[t].grow(0, x @ mat, 1 / share, block_rows)
    return cells


def _floats(raw: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.int16).reshape(-1, size).astype(np.float32) / np.float32(UNIT)


def most_similar(
    df: DataFrame,
    id_col: str = "id",
    vec_col: str = "embedding",
    *,
    k: int = 5,
    floor: float = 0.85,
    size: int = 64,
    trees: int = 3,
    block_rows: int = 32_768,
    leaf: int = 512,
    p_border: float = 0.4,
    p_stop: float = 0.8,
    sample_rows: int = 65_536,
) -> DataFrame:
    """``id, other, sim``: the ``k`` most similar other usable rows of every usable row, of those with a cosine of ``floor`` or more.

    Rows repeated with the same id are one row. Vectors that are null, not JSON, of another length than ``size``, not
    finite or all zero are no rows; an empty table gives none. Between equal cosines the smaller id comes first. Other
    columns of ``df`` are not read. ``trees``, the number of projections, and the probabilities at which the test
    stops at the border of a block (``p_border``) and within it (``p_stop``) set the accuracy; measured recall is in the
    README. ``sample_rows`` bounds the rows that cuts are fitted on at a time.
    """
    points = cut(
        unit_vectors(df, id_col, vec_col, size).groupBy("vec").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    )
    n = points.count()
    mats = projections(trees, size)
    margin = math.sqrt(chi_square_quantile(p_border, 1) * (2 - 2 * floor))
    cells = fit_cells(points, mats, n, size=size, margin=margin, block_rows=block_rows, sample_rows=sample_rows)
    numbers = {at: i for i, at in enumerate((t, node) for t in range(trees) for node in cells[t].blocks())}
    number = [np.array([numbers.get((t, node), -1) for node in range(len(cells[t].left))]) for t in range(trees)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _floats(b.column(0).to_pylist(), size)
            for t in range(trees):
                rows, nodes = cells[t].of(x @ mats[t])
                own = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(number[t][nodes], pa.int32()), own.column(1), own.column(0)], ["block", "id", "vec"])

    tree_of = [t for t, _ in numbers]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        table = table.take(pa.compute.sort_indices(table.column("id")))  # so that ties don't depend on the order of arrival
        ids = table.column("id").to_numpy()
        x = _floats(table.column("vec").to_pylist(), size)
        x /= np.linalg.norm(x, axis=1)[:, None]
        idx, sim = search_block(x, x @ mats[tree_of[table.column("block")[0].as_py()]], k, floor, leaf, p_stop)
        a, b = np.nonzero(idx >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[idx[a, b]]), pa.array(sim[a, b])], ["id", "other", "sim"])

    # Each block is one partition: blocks are numbered, and a row's partition is the number of its block.
    placed = points.select("vec", "id").mapInArrow(place, "block int, id bigint, vec binary").repartitionById(len(numbers), F.col("block"))
    links = placed.mapInArrow(search, "id bigint, other bigint, sim float")
    links = links.groupBy("id", "other").agg(F.max("sim").alias("sim"))

    # Records with equal vectors: each links to the first k others, and other points' links lead to the first k of them.
    rows = unit_vectors(df, id_col, vec_col, size)
    several = points.where(F.col("last") > F.col("id")).select(F.col("id").alias("point"), "vec")
    if not several.isEmpty():
        copies = cut(skew_left_join(rows, several, "vec").where("point is not null").select("point", "id").distinct())
        hot = hottest_keys(copies, "point")
        rank = F.row_number().over(Window.partitionBy("point").orderBy("id"))
        firsts = copies.withColumn("rank", rank).where(F.col("rank") <= k + 1)
        first_ids = firsts.groupBy("point").agg(F.sort_array(F.collect_list("id")).alias("firsts"))
        own = skew_left_join(copies, first_ids, "point", hot)
        equal = own.select("id", F.explode("firsts").alias("other")).where("id <> other").withColumn("sim", F.lit(1.0).cast("float"))
        ahead = first_ids.withColumnRenamed("point", "other")
        spread = links.join(ahead, "other", "left").select("id", F.explode(F.coalesce("firsts", F.array("other"))).alias("other"), "sim")
        # A point's own links hold for each of its records; those with k or more equal others need none.
        few = own.where(F.size("firsts") <= k).select(F.col("point").alias("id"), F.col("id").alias("record"))
        many = first_ids.where(F.size("firsts") > k).select(F.col("point").alias("id"))
        spread = spread.join(many, "id", "left_anti").join(few, "id", "left").select(F.coalesce("record", "id").alias("id"), "other", "sim")
        links = spread.unionByName(equal)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))
    return links.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "other", "sim")


def similar_pairs(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", **params) -> DataFrame:
    """``id_a, id_b`` with ``id_a < id_b``: the distinct unordered pairs of :func:`most_similar`."""
    links = most_similar(df, id_col, vec_col, **params)
    return links.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
