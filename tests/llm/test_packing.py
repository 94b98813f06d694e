from __future__ import annotations

import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.llm import packing


def brute(lengths, capacity):
    """Best-fit decreasing, one piece at a time: the rooms that are left."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return Counter(rooms)


def rooms_of(plan, capacity):
    used = Counter()
    for length, _, each, bins, first, _ in plan:
        for b in range(first, first + bins):
            used[b] += each * length
    return Counter(capacity - u for u in used.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120))
def test_plan_equals_one_by_one(lengths):
    plan = packing.plan(dict(Counter(lengths)), 30)
    assert rooms_of(plan, 30) == brute(lengths, 30)
    ranks = defaultdict(list)
    for length, base, each, bins, _, _ in plan:
        ranks[length] += range(base, base + each * bins)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in Counter(lengths).items()}


def test_plan_is_small_for_many_documents():
    rng = random.Random(1)
    plan = packing.plan({n: rng.randint(1, 10**9) for n in range(1, 2049)}, 2048)
    assert len(plan) < 40_000


def test_pack(spark):
    rng = random.Random(2)
    lengths = [rng.choice([rng.randint(1, 40), rng.randint(1, 250)]) for _ in range(400)]
    docs = spark.createDataFrame([(i, "abcd" * n) for i, n in enumerate(lengths)], "doc_id bigint, text string").repartition(4)
    rows = packing.pack(docs, 64).collect()
    pieces = [x for n in lengths for x in [64] * (n // 64) + ([n % 64] if n % 64 else [])]
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin"]].append((r["bin_offset"], r["n_tokens"]))
    assert Counter(64 - sum(n for _, n in b) for b in bins.values()) == brute(pieces, 64)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
    covered = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["doc_offset"] == covered[r["doc_id"]]
        covered[r["doc_id"]] += r["n_tokens"]
    assert covered == dict(enumerate(lengths))


def test_other_token_counts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id bigint, text string")
    rows = packing.pack(docs, 4, F.size(F.split("text", " "))).collect()
    assert {(r["doc_id"], r["bin"], r["n_tokens"]) for r in rows} == {(1, 0, 3), (2, 0, 1)}


def test_odd_rows(odd, empty):
    rows = packing.pack(odd, 64).collect()
    copies = Counter((r["doc_id"], r["copy"]) for r in rows if r["doc_id"] in (1, 2))
    # two equal rows of document 1 are two copies, its other text is one more with copy 0
    assert copies == {(1, 0): 2, (1, 1): 1, (2, 0): 1}
    assert {r["doc_id"] for r in rows} == {1, 2, 4, None, 6, 7, 8, 9}
    assert packing.pack(empty).count() == 0


def test_runs_keep_the_order_and_the_shares_of_a_mixture(spark):
    from corpusflow.llm import mixing

    docs = spark.createDataFrame([(i, "abcd" * (1 + i * 37 % 90), "big" if i % 4 else "small") for i in range(600)], "doc_id bigint, text string, source string").repartition(3)
    mixed = mixing.mix_documents(docs, {"big": 0.5, "small": 0.5}, block=64)
    placed = mixing.in_order(mixed, 2000)
    rows = [r.asDict() for r in packing.pack_in_order(placed, 100).collect()]
    run = {(r["doc_id"], r["copy"]): r for r in placed.collect()}
    assert len(run) == mixed.count()
    # every token of every copy is placed once, and no two pieces overlap
    seen, bins = {}, {}
    for r in rows:
        seen.setdefault((r["doc_id"], r["copy"]), []).append((r["doc_offset"], r["n_tokens"]))
        bins.setdefault(r["bin"], []).append((r["bin_offset"], r["n_tokens"], run[(r["doc_id"], r["copy"])]["run"]))
    assert {k: sum(n for _, n in v) for k, v in seen.items()} == {k: r["tokens"] for k, r in run.items()}
    for parts in bins.values():
        at = 0
        for start, n, _ in sorted(parts):
            assert start == at
            at += n
        assert at <= 100 and len({x for _, _, x in parts}) == 1
    order = [bins[b][0][2] for b in sorted(bins)]
    assert sorted(bins) == list(range(len(bins))) and order == sorted(order), "sequences of a run come before those of the next"
    for k in range(max(order) + 1):
        own = [r for r in run.values() if r["run"] == k]
        share = sum(r["tokens"] for r in own if r["source"] == "small") / sum(r["tokens"] for r in own)
        assert abs(share - 0.5) < 0.1
    # within a run, the plan is that of best fit over its pieces alone
    for k in (0, 1):
        lengths = sorted((r["n_tokens"] for r in rows if run[(r["doc_id"], r["copy"])]["run"] == k), reverse=True)
        rooms = []
        for n in lengths:
            fit = min((x for x in rooms if x >= n), default=None)
            if fit is None:
                rooms.append(100 - n)
            else:
                rooms.remove(fit)
                rooms.append(fit - n)
        assert sorted(rooms) == sorted(100 - sum(n for _, n, _ in v) for v in bins.values() if v[0][2] == k)


def test_runs_odd_rows(odd, empty):
    from corpusflow.llm import mixing

    rows = packing.pack_in_order(mixing.in_order(odd.union(odd.where("doc_id = 2").withColumn("source", F.lit("z"))), 1000)).collect()
    assert sorted(r["copy"] for r in rows if r["doc_id"] == 2) == [0, 1], "copies are numbered through all sources"
    assert {r["doc_id"] for r in rows} == {1, 2, 4, None, 6, 7, 8, 9} and len({(r["doc_id"], r["copy"], r["piece"], r["bin"], r["bin_offset"]) for r in rows}) == len(rows)
    assert packing.pack_in_order(mixing.in_order(empty, 1000)).count() == 0
