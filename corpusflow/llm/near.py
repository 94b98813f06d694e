"""Near duplicates by MinHash and an LSH forest.

A text is the set of its runs of ``SHINGLE`` words (lower case, letters and digits only; a shorter text is one run).
Texts of equal words are one vertex. Each of ``TREES`` trees sorts the vertices by its own order of the signature's
values. Within a tree, vertices that share the first ``LEAST_DEPTH`` values form a region; a region is sorted by the
following ``DEPTH`` values and each vertex is paired with the next ``REACH`` in order, which are those with the longest
common prefixes. So depth adapts to the region: where few texts share a prefix, the pairs have that prefix only, and where
thousands do, neighbours agree in as many values as the region's density allows. Pairs are verified by the share of
equal values in their whole signatures; verified pairs are joined to groups as connected components.

That finds nearly all. The rest is found exactly: where a region holds vertices of several groups and more of them than
``REACH`` pairs up, all its vertices of different groups are compared, in blocks of ``BLOCK`` by ``BLOCK`` that are tasks
of their own, and groups are joined where a pair passes. So two texts that pass the threshold and share a region in any
tree are in one group, however many others there are. Copies cost nothing there: a region of one group is left out.

The trees are range-partitioned by (region, order), so that a region with most of the texts is spread over many tasks;
pairs across the borders of partitions are added afterwards. The number of pairs is linear in the number of texts however
large a group is, and a group of thousands of copies stays connected through its neighbours in order and the trees.

Cases. Null, empty and wordless texts are never near anything; each such row stays. A row whose ``doc_id`` is null is not
compared and stays. Of repeated rows (equal ``doc_id`` and equal words) one stays. The document of a group that stays is
the one of least ``doc_id``. An empty table gives an empty result. Other columns are not read; ``deduplicate`` returns
them untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusflow.llm.runs import group_starts, whole_keys
from corpusflow.llm.text import Tokens, mix, slices
from corpusflow.operators.components import connected_components
from corpusflow.session import materialize

SHINGLE = 3
HASHES = 128
TREES = 20
LEAST_DEPTH = 2
#: Values that order a region, ``BITS`` bits of each.
DEPTH = 7
BITS = 9
REACH = 3
BLOCK = 1024
THRESHOLD = 0.5
_SEED = 20240229
_rng = np.random.default_rng(_SEED)
_mult = (_rng.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_add = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_orders = np.stack([_rng.permutation(HASHES)[: LEAST_DEPTH + DEPTH] for _ in range(TREES)])


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Hashes of the word runs of all texts, the offset of each text's first, and a 128-bit key of each text's words."""
    tokens = Tokens(texts)
    words = tokens.normalized()
    offsets, counts = tokens.offsets, tokens.counts
    raw = words.tobytes()
    keys = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(offsets[:-1], offsets[1:])]
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(n)])
    text_of = np.repeat(np.arange(len(n)), n)
    first = np.arange(starts[-1]) - starts[text_of] + offsets[text_of]
    last = offsets[1:][text_of]
    hashes = np.zeros(len(first), dtype=np.uint64)
    for j in range(size):
        at = first + j
        inside = at < last
        part = np.zeros(len(first), dtype=np.uint64)
        part[inside] = words[at[inside]]
        hashes = mix(hashes * np.uint64(3) + part + np.uint64(j + 1))
    return hashes, starts, keys


def signatures(texts: pa.Array) -> tuple[np.ndarray, list[bytes | None]]:
    """MinHash signatures (texts x HASHES); rows of wordless texts are meaningless and have no key."""
    hashes, starts, keys = shingles(texts)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(keys), HASHES), dtype=np.uint32)
    if len(full):
        at = starts[:-1][full]
        for j in range(HASHES):
            out[full, j] = np.minimum.reduceat(low * _mult[j] + _add[j], at)
    return out, keys


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            values, keys = signatures(part.column("text"))
            # minima of a long text are small numbers, whose upper bits are all 0: scrambled, any of their bits tell them apart
            wide = mix(values.astype(np.uint64))
            picked = wide[:, _orders]  # texts x trees x depth
            region = np.zeros(picked.shape[:2], dtype=np.uint64) + np.arange(1, TREES + 1, dtype=np.uint64)
            for j in range(LEAST_DEPTH):
                region = mix(region * np.uint64(5) + picked[:, :, j])
            order = np.zeros(picked.shape[:2], dtype=np.uint64)
            for j in range(LEAST_DEPTH, LEAST_DEPTH + DEPTH):
                order = (order << np.uint64(BITS)) | (picked[:, :, j] >> np.uint64(64 - BITS))
            short = wide.astype(np.uint16)
            n = len(keys)
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * TREES, pa.int32()), pa.array(np.ascontiguousarray(m).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in short], pa.binary()), lists(region), lists(order)],
                names=["doc_id", "key", "signature", "regions", "orders"],
            )


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of equal signature values per pair."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, HASHES) for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((one == two).mean(axis=1))], names=["a", "b", "similarity"])


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key, signature and tree positions of every row with a doc_id, as a written table."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return materialize(rows.mapInArrow(_sketch, "doc_id bigint, key binary, signature binary, regions array<bigint>, orders array<bigint>"), "near-sketch")


_pairs = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("region", pa.int64()), ("part", pa.int32()), ("place", pa.int32())])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each key with the next ``REACH`` of its region; rows come sorted by region and order.

    The first and last ``REACH`` rows of a partition are passed on as rows with ``region``, for pairs across partitions.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    row = lambda k, r, place: (k, None, r, part, place)
    head: list[tuple] = []
    tail: list[tuple] = []
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.table({"region": batch.column("region"), "key": batch.column("key")})
        table = now if held is None else pa.concat_tables([held, now])
        before = 0 if held is None else len(held)
        region, keys = table.column("region").to_numpy(), table.column("key").combine_chunks()
        for step in range(1, REACH + 1):
            i = np.flatnonzero(region[step:] == region[:-step])
            i = i[i + step >= before]  # pairs within what is held were made before
            none = pa.nulls(len(i), pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), keys.take(pa.array(i + step)), none, none.cast(pa.int32()), none.cast(pa.int32())], schema=_pairs)
        if len(head) < REACH:
            head += [row(k, r, len(head) + j) for j, (k, r) in enumerate(zip(now.column("key")[: REACH - len(head)].to_pylist(), now.column("region")[: REACH - len(head)].to_pylist()))]
        held = table.slice(max(0, len(table) - REACH)).combine_chunks()
    if held is not None:
        tail = [row(k, r, REACH + j) for j, (k, r) in enumerate(zip(held.column("key").to_pylist(), held.column("region").to_pylist()))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*head, *tail), _pairs.types)], schema=_pairs)


def candidate_pairs(vertices: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of neighbours in the trees of ``vertices(key, regions, orders)``."""
    trees = vertices.select("key", F.explode(F.arrays_zip("regions", "orders")).alias("t")).select(F.col("t.regions").alias("region"), F.col("t.orders").alias("order"), "key")
    # vertices of equal order have another neighbour in every tree
    tie = F.xxhash64("key", "region")
    rows = trees.repartitionByRange("region", "order", tie).sortWithinPartitions("region", "order", tie).select("region", "key")
    found = materialize(rows.mapInArrow(_neighbours, "a binary, b binary, region bigint, part int, place int"), "near-pairs")
    # at most 2 * REACH rows per partition; rows that are both first and last of theirs are taken once
    across, run = [], []
    for r in sorted(found.where("region is not null").collect(), key=lambda r: (r["part"], r["place"])):
        if (r["a"], r["region"]) not in [x[:2] for x in run]:
            across += [(bytes(k), bytes(r["a"])) for k, x, part in run[-REACH:] if x == r["region"] and part != r["part"]]
            run = [*run[-REACH:], (r["a"], r["region"], r["part"])]
    pairs = found.where("region is null").select("a", "b").union(found.sparkSession.createDataFrame(across, "a binary, b binary"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` whose signatures agree in at least ``threshold`` of their values."""
    with_a = pairs.join(vertices.select(F.col("key").alias("a"), F.col("signature").alias("sa")), "a")
    with_both = with_a.join(vertices.select(F.col("key").alias("b"), F.col("signature").alias("sb")), "b").select("a", "b", "sa", "sb")
    return with_both.mapInArrow(_agreement, "a binary, b binary, similarity double").where(F.col("similarity") >= threshold).select("a", "b")


def _rest(vertices: DataFrame, named: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, ga, gb) between groups that share a region; ``named`` has key and group of every vertex."""
    grouped = vertices.select("key", "regions").join(named, "key")
    members = grouped.select(F.explode("regions").alias("region"), "key", "group")
    name = F.xxhash64("group")
    crowded = members.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).where(f"n > {REACH + 1} and lo <> hi")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.join(crowded.select("region", blocks.alias("blocks")), "region").withColumn("block", F.pmod(F.xxhash64("key", "region"), F.col("blocks")).cast("int"))
    placed = placed.join(vertices.select("key", "signature"), "key")
    # a member meets every block of its region: it is on the left of its own and the later ones, on the right of the earlier
    every = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = every.select(F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "region", (F.col("block") <= F.col("other")).alias("left"), (F.col("block") == F.col("other")).alias("own"), "key", "group", "signature")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, ["task", "region"]):
            starts = group_starts(table, ["task", "region"])
            keys, groups = table.column("key").to_pylist(), table.column("group").to_pylist()
            number = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            of = np.array([number[g] for g in groups], dtype=np.int64)
            values = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
            left, own = (table.column(c).to_numpy() for c in ("left", "own"))
            root = list(range(len(number)))
            out = []
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                at = np.arange(start, end)
                one = at[left[at]]
                two = one if own[start] else at[~left[at]]
                for first in range(0, len(one), 64):
                    rows = one[first : first + 64]
                    same = (values[rows][:, None, :] == values[two][None, :, :]).mean(axis=2) >= threshold
                    same &= of[rows][:, None] != of[two][None, :]
                    for x, y in zip(*np.nonzero(same)):
                        i, j = int(rows[x]), int(two[y])
                        gi, gj = of[i], of[j]
                        while root[gi] != gi:
                            root[gi] = root[root[gi]]
                            gi = root[gi]
                        while root[gj] != gj:
                            root[gj] = root[root[gj]]
                            gj = root[gj]
                        if gi != gj:
                            root[gi] = gj
                            out.append((keys[i], keys[j], groups[i], groups[j]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*out) if out else [[]] * 4)], names=["a", "b", "ga", "gb"])

    return every.repartition("task", "region").sortWithinPartitions("task", "region").mapInArrow(compare, "a binary, b binary, ga binary, gb binary")


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For every row with a doc_id: doc_id, rep_id (the least doc_id of its group), links (the other texts that it was
    found to be near), keep (whether the row stays)."""
    rows = sketch(docs)
    # the same words give the same signature, so any row of a key will do
    vertices = materialize(rows.where("key is not null").select("key", "signature", "regions", "orders").dropDuplicates(["key"]), "near-vertices")
    links = materialize(verified(candidate_pairs(vertices), vertices, threshold), "near-links")
    groups = connected_components(links, "near")
    named = vertices.select("key").join(groups, F.col("key") == F.col("v"), "left").select("key", F.coalesce("component", "key").alias("group"))
    named = materialize(named, "near-groups")
    more = materialize(_rest(vertices, named, threshold), "near-rest")
    joined = connected_components(more.select(F.col("ga").alias("a"), F.col("gb").alias("b")), "near-rest")
    named = named.join(joined, F.col("group") == F.col("v"), "left").select("key", F.coalesce("component", "group").alias("_g"))
    both = links.select("a", "b").union(more.select("a", "b"))
    counted = both.select(F.explode(F.array("a", "b")).alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_links"))
    named = named.join(counted, F.col("key") == F.col("_k"), "left").select("key", "_g", F.coalesce("_links", F.lit(0).cast("bigint")).alias("links"))
    of_rows = rows.select("doc_id", "key").join(named, "key", "left")
    least = of_rows.where("_g is not null").groupBy("_g").agg(F.min("doc_id").alias("_rep"))
    joined = of_rows.join(least, "_g", "left").withColumn("rep_id", F.coalesce("_rep", "doc_id"))
    first = F.row_number().over(W.partitionBy("doc_id", "_g").orderBy("key")) == 1
    return joined.select("doc_id", "rep_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), (F.col("_g").isNull() | ((F.col("doc_id") == F.col("rep_id")) & first)).alias("keep"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = near_groups(docs, threshold)
    # a doc_id goes if none of its rows stays; repeated rows of one that stays are cut to one per text
    gone = groups.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("keep").alias("_keep")).where("not _keep").select("_gone")
    kept = docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
    same = W.partitionBy(F.col("doc_id").cast("bigint"), F.md5(F.col("text").cast("string"))).orderBy(F.lit(0))
    repeated = F.col("doc_id").isNotNull() & (F.trim(F.coalesce(F.col("text").cast("string"), F.lit(""))) != "")
    return kept.withColumn("_cf_row", F.when(repeated, F.row_number().over(same)).otherwise(1)).where("_cf_row = 1").drop("_cf_row")
