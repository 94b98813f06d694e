"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``VIRTUAL`` points on a ring of 2^60 positions. A key belongs to the arc that ends at the first point
clockwise of its hash and goes to that point's shard, unless the shard is full; then it continues clockwise. A shard
holds at most ``ceil((1 + SLACK) * keys / shards)`` keys. The sweep runs clockwise from position 0, twice around at most;
at each point, keys that overflowed from earlier arcs come before the arc's own, and an arc's keys come in ring order.
The sweep needs the count of each arc only, so the driver plans it on shards x virtual rows however many keys there are,
and the keys join the plan on their rank within the arc.

Cases. A null key is hashed as ''. Repeated keys share a position, count one by one and may end in neighbouring shards
where the first is full. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.ranking import md5_position, prefix_rank
from corpusflow.session import materialize

SHARDS = 64
VIRTUAL = 128
SLACK = 0.05


class Ring:
    """Points of the shards; ``names`` defaults to shard-0 and so on, and adding a name moves no other point."""

    def __init__(self, shards: int = SHARDS, virtual: int = VIRTUAL, names: list[str] | None = None):
        self.names = names or [f"shard-{i}" for i in range(shards)]
        points = sorted((int(hashlib.md5(f"{n}/{v}".encode()).hexdigest()[:15], 16), s) for s, n in enumerate(self.names) for v in range(virtual))
        self.positions = np.array([p for p, _ in points], dtype=np.int64)
        self.shards = [s for _, s in points]

    def arcs(self, positions: np.ndarray) -> np.ndarray:
        """The index of the first point at or after each position; past the last point it is the first."""
        return (np.searchsorted(self.positions, positions, side="left") % len(self.positions)).astype(np.int32)

    def sweep(self, counts: dict[int, int], slack: float = SLACK) -> list[tuple[int, int, int, int, int]]:
        """(arc, first rank, keys, shard, hops) rows."""
        room = [-(-int(np.ceil((1 + slack) * sum(counts.values()))) // len(self.names))] * len(self.names)
        waiting: deque[tuple[int, int, int]] = deque()
        rows, n = [], len(self.shards)
        for step in range(2 * n):
            point = step % n
            if step < n and counts.get(point):
                waiting.append((point, 0, counts[point]))
            shard = self.shards[point]
            while waiting and room[shard]:
                arc, first, keys = waiting.popleft()
                taken = min(keys, room[shard])
                room[shard] -= taken
                rows.append((arc, first, taken, shard, step - arc))
                if taken < keys:
                    waiting.appendleft((arc, first + taken, keys - taken))
        return rows


def assign(docs: DataFrame, ring: Ring | None = None, slack: float = SLACK, key: str = "doc_id") -> DataFrame:
    """For every row: doc_id, shard, position on the ring, hops (points passed because their shards were full)."""
    ring = ring or Ring()
    arc_of = F.pandas_udf(lambda p: pd.Series(ring.arcs(p.to_numpy())), "int")
    keyed = docs.select(docs[key].alias("doc_id")).withColumn("position", md5_position(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = materialize(keyed.withColumn("arc", arc_of("position")), "ring-keys")
    counts = {r["arc"]: r["n"] for r in keyed.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per point at most
    rows = ring.sweep(counts, slack)
    planned = docs.sparkSession.createDataFrame(rows, "arc int, base bigint, keys bigint, shard int, hops int")
    ranked = prefix_rank(keyed, ["arc"], "position", ["doc_id"], sum(counts.values()))
    # the plan has at most two rows per point plus one per shard, whatever the table's size
    return ranked.join(F.broadcast(planned), "arc").where("rank >= base and rank < base + keys").select("doc_id", "shard", "position", "hops")
