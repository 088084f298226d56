"""Exact top-k by inner product: a KD-tree per shard, searched best first with bounds of its boxes.

Space is cut into cells at medians of the widest sides, found on a bounded sample
(it decides how even the cells are, nothing else), and each cell's points are a
shard; a cell of too many points, such as equal ones, is dealt to several. Every
cell has a tight box around all of its points. A shard's tree splits at medians
of the widest sides too, with tight boxes; the largest inner product that a box
allows is known from its corners. A query visits boxes by that bound and stops
when the next one cannot reach its kth best score.

A query first goes to the cell of the best bound. The kth best score found there
travels with it to those other cells alone whose bound reaches it. A task holds
one shard at a time: its points come first and make the tree, then its queries
pass in blocks.

Defined cases: vectors that are null, or hold null or non-finite components, and
rows with a null id take no part; vectors of different lengths are not compared;
rows that share an id are no candidates of a query of that id, and queries that
share an id count once, with the smaller vector; ties go to the smaller id,
equal rows each take a rank; an empty table gives no rows; other columns are not
carried.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, forget, written

#: Vectors of a shard, queries of a block, vectors of a leaf.
SHARD, BLOCK, LEAF = 16_384, 1_024, 128
#: Vectors on which the cells are found, at most about; boxes that a task compares queries with at a time.
SAMPLE, BOXES = 65_536, 16_384


class Tree:
    """A KD-tree over whole-number vectors."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        self.lo, self.hi, self.child, self.span = [], [], [], []
        place = np.arange(len(ids))
        todo = [(0, len(ids), None, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = points[place[a:b]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            node = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.child.append([-1, -1])
            self.span.append((a, b))
            if parent is not None:
                self.child[parent][side] = node
            width = hi - lo
            if b - a <= leaf or not width.size or not width.any():  # equal vectors cannot be split and need not be
                continue
            half = (b - a) // 2
            place[a:b] = place[a:b][np.argpartition(part[:, int(width.argmax())], half)]
            todo += [(a, a + half, node, 0), (a + half, b, node, 1)]
        self.ids, self.points = ids[place], points[place]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray):
        """For each query (ids, scores) of its k best of at least ``floor``, best first, ties to the smaller id."""
        bound = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T
        for q in range(len(queries)):
            best_ids, best = np.zeros(0, np.int64), np.zeros(0, self.points.dtype)
            kth = floor[q]
            heap = [(-bound[q, 0], 0)]
            while heap:
                most, node = heapq.heappop(heap)
                if -most < kth:
                    break
                left, right = self.child[node]
                if left >= 0:
                    for c in (left, right):
                        if bound[q, c] >= kth:
                            heapq.heappush(heap, (-bound[q, c], c))
                    continue
                a, b = self.span[node]
                score = self.points[a:b] @ queries[q]
                at = np.flatnonzero((score >= kth) & (self.ids[a:b] != own[q]))
                if len(at):
                    ids, score = np.concatenate([best_ids, self.ids[a:b][at]]), np.concatenate([best, score[at]])
                    top = np.lexsort((ids, -score))[:k]
                    best_ids, best = ids[top], score[top]
                    if len(top) == k:
                        kth = max(kth, best[-1])
            yield best_ids, best


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _cuts(points: np.ndarray, cells: int) -> list[tuple[int, int, int, int]]:
    """(axis, threshold, child below or at it, child above) of each cut; a child of -1 - c is cell c."""
    out: list = []

    def cut(part: np.ndarray, cells: int) -> int:
        nonlocal made
        if cells > 1 and len(part) >= 16:
            axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
            at = int(np.sort(part[:, axis])[(len(part) - 1) // 2])
            below = part[:, axis] <= at
            if not below.all():
                me = len(out)
                out.append(None)
                out[me] = (axis, at, cut(part[below], cells // 2), cut(part[~below], cells - cells // 2))
                return me
        made += 1
        return -made

    made = 0
    if cut(points, cells) < 0:
        return []
    return out


def _placed(cuts: dict[int, list]):
    """Each point with its cell."""

    def run(batches):
        for batch in batches:
            size = np.asarray(batch.column(2))
            cell = np.zeros(len(size), np.int64)
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                if not cuts.get(dim):
                    continue
                x, node = _matrix(batch.column(1).take(pa.array(rows))), np.zeros(len(rows), np.int64)
                axis, at, low, high = (np.array(c) for c in zip(*cuts[dim], strict=True))
                while (open_ := np.flatnonzero(node >= 0)).size:
                    n = node[open_]
                    node[open_] = np.where(x[open_, axis[n]] <= at[n], low[n], high[n])
                cell[rows] = -1 - node
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "v", "dim", "cell"])

    return run


def _part_boxes(batches):
    """The box of each cell's points of a batch."""
    for batch in batches:
        key = np.stack([np.asarray(batch.column(2)), np.asarray(batch.column(3))])
        for dim, cell in np.unique(key, axis=1).T.tolist():
            rows = np.flatnonzero((key[0] == dim) & (key[1] == cell))
            x = _matrix(batch.column(1).take(pa.array(rows)))
            yield pa.RecordBatch.from_pylist([{"dim": dim, "cell": cell, "n": len(rows), "lo": x.min(axis=0).tolist(), "hi": x.max(axis=0).tolist()}], pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))]))


def _whole_box(t: pa.Table) -> pa.Table:
    lo, hi = (_matrix(t.column(c).combine_chunks()) for c in ("lo", "hi"))
    return pa.table({"dim": t.column("dim")[:1], "cell": t.column("cell")[:1], "n": [int(np.sum(t.column("n").to_numpy()))], "lo": [lo.min(axis=0).tolist()], "hi": [hi.max(axis=0).tolist()]}, schema=t.schema)


def _routed(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], kind, block: int, best_only: bool):
    """The queries with a cell each: that of the best bound among the boxes, or those whose bound reaches the floor."""

    def run(batches):
        for batch in (whole.slice(i, block) for whole in batches for i in range(0, whole.num_rows, block)):
            size = np.asarray(batch.column(2))
            for dim in np.unique(size).tolist():
                if dim not in boxes:
                    continue
                rows = np.flatnonzero(size == dim)
                some = batch.take(pa.array(rows))
                q = _matrix(some.column(1)).astype(kind)
                cell, lo, hi = boxes[dim]
                bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
                if best_only:
                    r, c = np.arange(len(rows)), bound.argmax(axis=1)
                else:
                    floor = some.column(3)
                    reach = np.where(np.asarray(floor.is_null())[:, None], True, bound >= np.asarray(floor.fill_null(0)).astype(kind)[:, None])
                    reach &= cell[None, :] != np.asarray(some.column(4))[:, None]  # seen before
                    r, c = np.nonzero(reach)
                for i in range(0, len(r), block):
                    part = some.take(pa.array(r[i : i + block]))
                    arrays = [part.column(0), part.column(1), part.column(2), part.column(3), pa.array(cell[c[i : i + block]].astype(np.int32)), pa.array(bound[r, c][i : i + block].astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["id", "v", "dim", "floor", "cell", "bound"])

    return run


_FOUND = "query_id long, vec_id long, score long"


def _searched(k: int, leaf: int, block: int, kind):
    """Rows of one shard after the other, points before queries."""

    def run(batches):
        now, points, tree = None, [], None
        for batch in (whole.slice(i, block) for whole in batches for i in range(0, whole.num_rows, block)):
            key = np.stack([np.asarray(batch.column(c)) for c in range(4)])  # dim, cell, part, what
            first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            for a, b in zip(first.tolist(), np.append(first[1:], key.shape[1]).tolist(), strict=True):
                part, shard = batch.slice(a, b - a), tuple(key[:3, a].tolist())
                if shard != now:
                    now, points, tree = shard, [], None
                ids, v = np.asarray(part.column(4)), _matrix(part.column(5)).astype(kind)
                if key[3, a] == 0:
                    points.append((ids, v))
                    continue
                if tree is None:
                    if not points:
                        continue
                    tree, points = Tree(np.concatenate([i for i, _ in points]), np.concatenate([x for _, x in points]), leaf), [(None, None)]
                lowest = -np.inf if kind is np.float64 else -(1 << 63)
                floor = part.column(6)
                floor = np.where(np.asarray(floor.is_null()), lowest, np.asarray(floor.fill_null(0)).astype(kind))
                found = list(tree.search(v, ids, k, floor))
                size = [len(i) for i, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, size)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([x for _, x in found]).astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def top_k(points: DataFrame, queries: DataFrame, *, k: int = 20, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. Both frames have ``id`` long and ``v``, an array of long."""
    whole = lambda df: df.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).select(F.col("id").cast("long").alias("id"), "v")
    points = whole(bound_batches(points)).withColumn("dim", F.size("v"))
    asked = whole(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).withColumn("floor", F.lit(None).cast("long"))
    asked = written(asked, "queries")
    largest = F.max(F.array_max(F.transform("v", F.abs)))
    sizes = points.groupBy("dim").agg(F.count("*").alias("n"), largest.alias("most")).collect()  # a row for each length of vectors
    n, most = sum(r["n"] for r in sizes), max([0, *(r["most"] for r in sizes), asked.agg(largest).first()[0] or 0])
    kind = np.float64 if most * most * max([1, *(r["dim"] for r in sizes)]) < 1 << 53 else np.int64  # exact either way
    few = points if n <= sample else points.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    few = few.select("dim", "v").toArrow() if n > shard else None
    cuts: dict[int, list] = {}
    for r in sizes:
        if r["n"] > shard:
            mine = few.filter(pc.equal(few.column("dim"), r["dim"])).column("v").combine_chunks()
            cuts[r["dim"]] = _cuts(_matrix(mine), -(-r["n"] // shard)) if len(mine) else []
    placed = written(points.mapInArrow(_placed(cuts), "id long, v array<long>, dim int, cell int"), "points")
    box = "dim int, cell int, n long, lo array<long>, hi array<long>"
    boxes = written(placed.mapInArrow(_part_boxes, box).groupBy("dim", "cell").applyInArrow(_whole_box, box), "boxes")
    parts = F.ceil(F.col("n") / shard).cast("int")
    dealt = placed.join(boxes.select("dim", "cell", parts.alias("parts")), ["dim", "cell"])
    # equal rows of a hot id are spread too: the part also depends on the place
    shards = dealt.select("dim", "cell", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), "parts").cast("int").alias("part"), F.lit(0).alias("what"), "id", "v", F.lit(None).cast("long").alias("floor"))

    def blocks():
        """The boxes, so many at a time."""
        these: dict[int, list] = {}
        for i, r in enumerate(boxes.select("dim", "cell", "lo", "hi").toLocalIterator(), 1):
            these.setdefault(r["dim"], []).append((r["cell"], r["lo"], r["hi"]))
            if i % BOXES == 0:
                yield these
                these = {}
        yield these

    def routed(some: DataFrame, best_only: bool) -> DataFrame:
        out = None
        for some_boxes in blocks():
            arrays = {d: (np.array([c for c, _, _ in x]), np.array([lo for _, lo, _ in x], kind), np.array([hi for _, _, hi in x], kind)) for d, x in some_boxes.items()}
            part = some.mapInArrow(_routed(arrays, kind, block, best_only), "id long, v array<long>, dim int, floor long, cell int, bound double")
            out = part if out is None else out.union(part)
        return out

    def search(at: DataFrame) -> DataFrame:
        to = at.join(boxes.select("dim", "cell", parts.alias("parts")), ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("what"), "id", "v", "floor")
        by = ["dim", "cell", "part"]
        both = shards.join(to.select(*by).distinct(), by, "left_semi").union(to)
        return both.repartition(*by).sortWithinPartitions(*by, "what").mapInArrow(_searched(k, leaf, block, kind), _FOUND)

    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = W.partitionBy("id").orderBy(F.desc("bound"), "cell")
    start = written(routed(asked, True).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r"), "start")
    first = written(search(start), "first")
    found = first
    if cuts:
        kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).alias("kth"))
        # a cell of several parts gives each part's best: the kth of all is at least any part's kth
        again = start.join(kth, "id", "left").select("id", "v", "dim", F.col("kth").alias("floor"), "cell")
        found = first.union(search(written(routed(again, False).drop("bound"), "routes")))
    out = written(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ranked")
    forget(placed, asked, boxes, start, first)
    return out


def whole_numbers(vector: str, factor: float = 64.0):
    """floor(factor x) of each component; null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double"))))
