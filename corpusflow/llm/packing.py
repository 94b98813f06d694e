"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

A document longer than ``CAPACITY`` tokens is cut into full pieces and a rest; nothing is truncated. The plan places
lengths from the longest down, each into the open bins with the least room that is enough, many at once: bins of equal
content are one entry of the plan with a count. The result is exactly that of best-fit decreasing over single pieces,
while work and size of the plan depend on the capacity only. Pieces then take their places by joining the plan on length
and on their rank within the length.

``pack_in_order`` packs rows that have a run each, such as those of a mixture: every run is planned by itself, by a task
that sees its histogram only, and the sequences of a run come before those of the next one.

Cases. Documents without tokens (null or empty text) have no piece. A null ``doc_id`` stays null. Repeated rows are each
packed, told apart by ``copy`` from 0. An empty table gives an empty packing. Pieces of equal length are ranked by the
hash of doc_id, then by doc_id, text, copy and piece. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusflow.llm.tokens import token_count
from corpusflow.operators.ranking import md5_position, prefix_rank
from corpusflow.session import materialize

CAPACITY = 2048
#: Tokens of a run of sequences that are packed together.
RUN = 4096 * CAPACITY


@dataclass
class Group:
    """Bins of equal content; per placed length: length, rank of the first piece, pieces a bin, offset in the bin."""

    first: int
    count: int
    room: int
    placed: list[tuple[int, int, int, int]] = field(default_factory=list)

    def split(self, count: int) -> tuple[Group, Group]:
        rest = [(n, base + count * each, each, at) for n, base, each, at in self.placed]
        return Group(self.first, count, self.room, list(self.placed)), Group(self.first + count, self.count - count, self.room, rest)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces a bin, bins, first bin, offset) rows of best-fit decreasing."""
    rooms: list[int] = []
    groups: dict[int, list[Group]] = {}
    bins = 0

    def put(group: Group) -> None:
        if group.room not in groups:
            groups[group.room] = []
            insort(rooms, group.room)
        groups[group.room].append(group)

    def take(room: int) -> Group:
        group = groups[room].pop(0)
        if not groups[room]:
            del groups[room]
            rooms.pop(bisect_left(rooms, room))
        return group

    done: list[Group] = []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                group = Group(bins, -(-left // each), capacity)
                bins += group.count
            else:
                group = take(rooms[at])
                each = group.room // length
            if left >= each:
                if left // each < group.count:
                    group, rest = group.split(left // each)
                    put(rest)
            else:
                if group.count > 1:
                    group, rest = group.split(1)
                    put(rest)
                each = left
            group.placed.append((length, rank, each, capacity - group.room))
            group.room -= each * length
            rank += each * group.count
            left -= each * group.count
            (put if group.room else done.append)(group)
    done += [g for gs in groups.values() for g in gs]
    return [(length, base, each, g.count, g.first, at) for g in done if g.placed for length, base, each, at in g.placed]


def _cut(rows: DataFrame, capacity: int) -> DataFrame:
    """The pieces of rows(doc_id, key, copy, tokens, ...)."""
    return (
        rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(tokens - 1) div {capacity}"))))
        .withColumn("start", F.col("piece") * capacity)
        .withColumn("length", F.least(F.lit(capacity), F.col("tokens") - F.col("start")).cast("int"))
        .withColumn("position", md5_position(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("piece").cast("string"))))
    )


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokens: Column | None = None) -> DataFrame:
    """doc_id, copy, piece, start (its first token), length of every piece, with its rank within the length."""
    tokens = token_count(docs["text"]) if tokens is None else tokens
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.md5(docs["text"].cast("string")).alias("key"), tokens.cast("bigint").alias("tokens"))
    rows = rows.where("tokens > 0").groupBy("doc_id", "key", "tokens").agg(F.count(F.lit(1)).alias("copies"))
    cut = _cut(rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))), capacity)
    cut = materialize(cut.select("doc_id", "key", "copy", "piece", "start", "length", "position"), "pack-pieces")
    return prefix_rank(cut, ["length"], "position", ["doc_id", "key", "copy", "piece"], cut.count())


def pack(docs: DataFrame, capacity: int = CAPACITY, tokens: Column | None = None) -> DataFrame:
    """bin, bin_offset, doc_id, copy, piece, doc_offset, n_tokens: the place of every piece."""
    ranked = materialize(pieces(docs, capacity, tokens), "pack-ranked")
    histogram = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    schema = "length int, base bigint, each bigint, bins bigint, first_bin bigint, at bigint"
    planned = docs.sparkSession.createDataFrame(plan(histogram, capacity), schema)
    # the plan's size depends on the capacity alone, so it can always be sent to every task
    return _placed(ranked.join(F.broadcast(planned), "length"))


def _placed(joined: DataFrame) -> DataFrame:
    placed = joined.where("rank >= base and rank < base + each * bins")
    within = F.col("rank") - F.col("base")
    return placed.select(
        (F.col("first_bin") + F.floor(within / F.col("each"))).alias("bin"), (F.col("at") + within % F.col("each") * F.col("length")).alias("bin_offset"),
        "doc_id", "copy", "piece", F.col("start").alias("doc_offset"), F.col("length").cast("bigint").alias("n_tokens"),
    )


def pack_in_order(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The places of the pieces of rows(doc_id, key, tokens, copy, run), as ``pack`` gives them, run after run."""
    cut = materialize(_cut(rows, capacity).select("run", "doc_id", "key", "copy", "piece", "start", "length", "position"), "pack-pieces")
    # a run is bounded, so no bucket within one is needed
    ranked = prefix_rank(cut, ["run", "length"], "position", ["doc_id", "key", "copy", "piece"], 1)
    schema = "run bigint, length int, base bigint, each bigint, bins bigint, first_bin bigint, at bigint"

    def plan_run(group: pd.DataFrame) -> pd.DataFrame:
        found = plan(dict(zip(group["length"].tolist(), group["n"].tolist())), capacity)
        return pd.DataFrame([(group["run"].iloc[0], *row) for row in found], columns=["run", "length", "base", "each", "bins", "first_bin", "at"])

    histogram = cut.groupBy("run", "length").agg(F.count(F.lit(1)).alias("n"))
    planned = materialize(histogram.groupBy("run").applyInPandas(plan_run, schema), "pack-plan")
    used = planned.groupBy("run").agg(F.max(F.col("first_bin") + F.col("bins")).alias("n"))
    # one row per RUN tokens: a single task orders them
    before = used.select("run", (F.sum("n").over(W.orderBy("run")) - F.col("n")).alias("_before"))
    planned = planned.join(before, "run").withColumn("first_bin", F.col("first_bin") + F.col("_before")).drop("_before")
    return _placed(ranked.join(planned, ["run", "length"]))
