"""Approximate nearest neighbours by a forest of random-projection trees.

Queries are the rows whose id is divisible by ``EVERY``; they are searched among all rows.

Every tree has one random direction per depth (orthonormal within the tree) and splits each node at the median of its
vectors' projections, learned from a sample of ``SAMPLE`` rows. Every row is a member of one leaf per tree. One priority
queue over all trees holds the branches that a query hasn't taken, by the sum of the squared distances to the planes that
lie between, and gives the query the leaves of the whole forest in the order of that distance, up to a radius. The radius
is learned: among rows of the sample, the share ``RECALL`` of the true neighbours lie within it in some tree. So queries
ask few leaves where the vectors have structure and many where they have none, at any size; in a larger table neighbours
are nearer than in the sample, which errs on the safe side.

Members and queries meet by a shuffle on the leaf. A leaf that holds more than ``BLOCK`` members, as one with a third of
all rows equal may, is cut into blocks, and its queries go to each of them: a task holds one block of members and streams
the queries past it, so that its memory depends on neither the leaf nor the table. All candidates of a leaf that might be
among its best are compared again in double precision, and each query's best of every leaf are merged. Sent to all tasks
are the directions, the medians and the number of blocks of each leaf, whose size depends on the depth alone, which the
sample bounds.

Similarity is the cosine, rounded to ``DIGITS`` digits. Cases. Rows with a null id, or whose vector is null, empty, zero,
not finite or of another length than most, are neither queries nor neighbours. Rows of equal id are one item, whether
their vectors are equal or not; the best similarity counts. An item is no neighbour of itself. Ties go to the lesser id.
With fewer than ``k`` others there are fewer rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.runs import group_starts, whole_keys
from corpusflow.llm.text import mix
from corpusflow.session import materialize

NEIGHBOURS = 10
EVERY = 50
TREES = 4
#: Members that a leaf holds on average, until the sample bounds the depth, and members that one task holds at once.
LEAF = 128
BLOCK = 8192
DIGITS = 6
#: Candidates of single precision that may be wrong by this much are compared again.
SLACK = 1e-5
RECALL = 0.95
#: Rows of the sample whose true neighbours in it set the radius.
CALIBRATION = 512
SAMPLE = 65_536
LEAST_IN_SAMPLE = 16
_SEED = 5


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(values.to_pylist()), dtype=np.float32).reshape(-1, width)


@dataclass
class Forest:
    directions: np.ndarray  # trees x depth x width
    medians: np.ndarray  # trees x nodes, by level
    radius: float = 0.0

    @classmethod
    def build(cls, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF) -> Forest:
        width = sample.shape[1]
        wanted = int(np.ceil(np.log2(max(1, rows / leaf))))
        depth = max(0, min(wanted, width, int(np.log2(max(1, len(sample) / LEAST_IN_SAMPLE)))))
        rng = np.random.default_rng(_SEED)
        directions = np.stack([np.linalg.qr(rng.normal(size=(width, width)))[0][:, :depth].T for _ in range(trees)]).astype(np.float32).reshape(trees, depth, width)
        medians = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            node = np.zeros(len(sample), dtype=np.int64)
            for d in range(depth):
                p, first = sample @ directions[t, d], (1 << d) - 1
                order = np.lexsort((p, node))
                starts = np.searchsorted(node[order], np.arange((1 << d) + 1))
                for j in range(1 << d):
                    if starts[j + 1] > starts[j]:
                        medians[t, first + j] = np.median(p[order[starts[j] : starts[j + 1]]])
                node = 2 * node + (p > medians[t, first + node])
        return cls(directions, medians)

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nw,tdw->ntd", x, self.directions)

    def leaves(self, p: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree (rows x trees)."""
        trees = np.arange(p.shape[1])
        node = np.zeros(p.shape[:2], dtype=np.int64)
        for d in range(self.depth):
            node = 2 * node + (p[:, :, d] > self.medians[trees, (1 << d) - 1 + node])
        return node

    def distance(self, p: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Sums of squared distances to the planes between each row of projections and its given leaf of each tree."""
        trees = np.arange(p.shape[1])
        far, node = np.zeros(p.shape[:2]), np.zeros(p.shape[:2], dtype=np.int64)
        for d in range(self.depth):
            side = leaves >> (self.depth - 1 - d) & 1
            gap = p[:, :, d] - self.medians[trees, (1 << d) - 1 + node]
            far += np.where((gap > 0) != (side > 0), gap * gap, 0)
            node = 2 * node + side
        return far

    def calibrate(self, sample: np.ndarray, k: int, recall: float = RECALL) -> Forest:
        """Set the radius by the true ``k`` nearest neighbours of some rows among the sample."""
        rows = np.random.default_rng(_SEED).permutation(len(sample))[:CALIBRATION]
        k = min(k, len(sample) - 1)
        if k > 0 and self.depth:
            s = sample[rows] @ sample.T
            s[np.arange(len(rows)), rows] = -9
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            p = np.repeat(self.project(sample[rows]), k, axis=0)
            far = self.distance(p, self.leaves(self.project(sample[near.ravel()]))).min(axis=1)
            self.radius = float(np.quantile(far, recall, method="higher"))
        return self

    def probes(self, p: np.ndarray) -> list[tuple[int, int]]:
        """The (tree, leaf) within the radius of one row of projections, nearest first, from one queue over all trees."""
        queue = [(0.0, t, 0, 0) for t in range(p.shape[0])]
        rows, medians, depth, radius, out = p.tolist(), self.medians, self.depth, self.radius, []
        while queue and queue[0][0] <= radius:
            far, t, d, node = heapq.heappop(queue)
            while d < depth:
                gap = rows[t][d] - medians[t, (1 << d) - 1 + node]
                side = gap > 0
                heapq.heappush(queue, (far + gap * gap, t, d + 1, 2 * node + (not side)))
                node, d = 2 * node + side, d + 1
            out.append((t, node))
        return out


def unit_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """id, x (bytes of a float32 unit vector) of the usable rows, equal rows once, and the vectors' length."""
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).cast("array<float>").alias("v")).where("id is not null and size(v) > 0")
    usual = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    width = usual[0]["w"] if usual else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            norm = np.sqrt((x * x).sum(axis=1))
            ok = np.isfinite(norm) & (norm > 0)
            x = (x[ok] / norm[ok, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(ok)), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "x"])

    return rows.where(F.size("v") == width).mapInArrow(run, "id bigint, x binary").dropDuplicates(["id", "x"]), width


def best(who: np.ndarray, asked: np.ndarray, ids: np.ndarray, members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, neighbour and similarity of the ``k`` best items of each query row; ``ids`` ascend and may repeat."""
    items = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    s = asked @ members.T
    s[who[:, None] == ids[None, :]] = -9
    by_item = s if len(items) == len(ids) else np.maximum.reduceat(s, items, axis=1)
    n = min(k, by_item.shape[1])
    last = -np.partition(-by_item, n - 1, axis=1)[:, n - 1]
    row, col = np.nonzero((s >= last[:, None] - SLACK) & (s > -2))
    exact = np.empty(len(row))
    for start in range(0, len(row), 1 << 15):
        part = slice(start, start + (1 << 15))
        exact[part] = np.einsum("ij,ij->i", asked[row[part]].astype(np.float64), members[col[part]].astype(np.float64))
    return ranked(row, ids[col], exact.round(DIGITS), k, who)


def ranked(row: np.ndarray, near: np.ndarray, score: np.ndarray, k: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best different neighbours of every row, best first, ties by the lesser id."""
    order = np.lexsort((-score, near, row))
    row, near, score = row[order], near[order], score[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (near[1:] != near[:-1])
    row, near, score = row[first], near[first], score[first]
    order = np.lexsort((near, -score, row))
    row, near, score = row[order], near[order], score[order]
    ok = np.arange(len(row)) - np.searchsorted(row, row) < k
    return who[row[ok]], near[ok], score[ok]


def nearest(
    vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL,
    block: int = BLOCK, id_column: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """vec_id, rank from 1, neighbour_id, similarity: the ``k`` nearest found of every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    units, width = unit_vectors(vectors, id_column, column)
    units = materialize(units, "ann-units")
    sample = units.orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE).select("x").toArrow()
    x = _matrix(sample.column("x"), width)
    forest = Forest.build(x, units.count(), trees, leaf).calibrate(x, k, recall)
    size = 1 << forest.depth
    shared = spark.sparkContext.broadcast(forest)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        total = np.zeros(trees * size, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            total += np.bincount((np.arange(trees) * size + f.leaves(f.project(x))).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["leaf", "n"])

    counted = units.mapInArrow(homes, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    blocks = np.ones(trees * size, dtype=np.int64)
    blocks[counted.column("leaf").to_numpy()] = -(-counted.column("n").to_numpy() // block)
    first_cell = spark.sparkContext.broadcast(np.concatenate([[0], np.cumsum(blocks)]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, cells = shared.value, first_cell.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x = _matrix(batch.column("x"), width)
                p = f.project(x)
                home = np.arange(trees) * size + f.leaves(p)
                ids = batch.column("id").to_numpy()
                # any spread will do that is the same when a task runs again
                spread = mix(ids.view(np.uint64) ^ (x.view(np.uint32).astype(np.uint64) * np.arange(1, 2 * width, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
                own = cells[home] + (spread[:, None] % (cells[home + 1] - cells[home]).astype(np.uint64)).astype(np.int64)
                row, cell, query = [np.repeat(np.arange(len(x)), trees)], [own.ravel()], [np.zeros(own.size, dtype=bool)]
                for i in np.flatnonzero(ids % every == 0):
                    asked = np.array([t * size + n for t, n in f.probes(p[i])], dtype=np.int64)
                    places = np.concatenate([np.arange(cells[a], cells[a + 1]) for a in asked])
                    row.append(np.full(len(places), i))
                    cell.append(places)
                    query.append(np.ones(len(places), dtype=bool))
                out = batch.take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell)), pa.array(np.concatenate(query)), *out.columns], names=["cell", "query", "id", "x"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, members before queries: only one cell's members are held."""
        now, held, members = None, [], None
        for batch in batches:
            cell, query = batch.column("cell").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            starts = group_starts(pa.table({"c": cell, "q": query.astype(np.int8)}), ["c", "q"])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if cell[a] != now:
                    now, held, members = cell[a], [], None
                part = batch.slice(a, b - a)
                ids, x = part.column("id").to_numpy(), _matrix(part.column("x"), width)
                if not query[a]:
                    held.append((ids, x))
                    continue
                if not held:
                    continue
                if members is None:
                    every_id = np.concatenate([i for i, _ in held])
                    order = np.argsort(every_id, kind="stable")
                    members = every_id[order], np.concatenate([v for _, v in held])[order]
                for start in range(0, len(ids), 256):
                    q, n, s = best(ids[start : start + 256], x[start : start + 256], *members, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(s)], names=["q", "n", "s"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, ["q"]):
            who, row = np.unique(table.column("q").to_numpy(), return_inverse=True)
            q, n, s = ranked(row, table.column("n").to_numpy(), table.column("s").to_numpy(), k, who)
            rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rank.astype(np.int32)), pa.array(n), pa.array(s)], names=["vec_id", "rank", "neighbour_id", "similarity"])

    placed = units.mapInArrow(place, "cell bigint, query boolean, id bigint, x binary")
    hits = placed.repartition("cell").sortWithinPartitions("cell", "query").mapInArrow(search, "q bigint, n bigint, s double")
    return hits.repartition("q").sortWithinPartitions("q").mapInArrow(merge, "vec_id bigint, rank int, neighbour_id bigint, similarity double")
