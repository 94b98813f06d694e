from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import pytest

from corpusflow.llm import mixing


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "abcd" * (1 + i * 37 % 90), "big" if i % 4 else ("small" if i % 8 else "tiny")) for i in range(400)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)


def test_blocks_are_equal_and_nothing_is_lost(corpus):
    rows = mixing.mixture(corpus, block=128).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["slot"]].append(r)
    assert sorted(slots) == list(range(len(slots)))
    for pieces in slots.values():
        assert len({p["source"] for p in pieces}) == 1
        at = 0
        for p in sorted(pieces, key=lambda p: p["slot_offset"]):
            assert p["slot_offset"] == at
            at += p["n_tokens"]
        assert at == 128
    seen = Counter()
    for r in rows:
        if r["epoch"] == 0:
            seen[r["doc_id"]] += r["n_tokens"]
    assert seen == {r["doc_id"]: len(r["text"]) // 4 for r in corpus.collect()}


def test_shares_hold_in_every_run_of_slots(corpus):
    weights = {"big": 0.5, "small": 0.3, "tiny": 0.2}
    rows = mixing.mixture(corpus, weights, block=64).select("slot", "source").distinct().collect()
    order = [s for _, s in sorted((r["slot"], r["source"]) for r in rows)]
    assert len(order) > 150
    for start in range(0, len(order) - 50, 10):
        part = Counter(order[start : start + 50])
        assert all(abs(part[s] - 50 * w) <= 4 for s, w in weights.items())


def test_equals_brute_force(corpus):
    """Streams, points and ranks by plain loops."""
    import hashlib

    docs = sorted((r["source"], int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16), r["doc_id"], len(r["text"]) // 4) for r in corpus.collect())
    stream = defaultdict(list)
    for s, _, d, n in docs:
        stream[s] += [(d, i) for i in range(n)]
    w = {s: round(len(t) ** mixing.ALPHA) for s, t in stream.items()}
    edges, total, c = [], sum(w.values()), 0
    for s in sorted(w):
        c += w[s]
        edges.append((c * 2**31 // total, s))
    need = {s: -(-len(t) // 128) for s, t in stream.items()}
    used, schedule, i = Counter(), [], 0
    while any(used[s] < need[s] for s in need):
        u = i * mixing.STEP % 2**31
        s = next(s for high, s in edges if u < high)
        schedule.append((s, used[s]))
        used[s] += 1
        i += 1
    want = Counter()
    for slot, (s, k) in enumerate(schedule):
        for t in range(k * 128, k * 128 + 128):
            want[(slot, s, t // len(stream[s]), stream[s][t % len(stream[s])][0])] += 1
    found = Counter()
    for r in mixing.mixture(corpus, block=128).collect():
        found[(r["slot"], r["source"], r["epoch"], r["doc_id"])] += r["n_tokens"]
    assert found == want


def test_documents_repeat_as_scheduled(corpus):
    times = Counter(r["doc_id"] for r in mixing.mix_documents(corpus, block=128).collect())
    starts = Counter(r["doc_id"] for r in mixing.mixture(corpus, block=128).collect() if r["doc_offset"] == 0)
    assert times == starts and set(times) == set(range(400))


def test_a_target_bounds_the_mixture(corpus):
    weights = {"big": 0.02, "small": 0.49, "tiny": 0.49}
    free = mixing.mixture(corpus, weights, block=64).select("slot").distinct().count()
    rows = mixing.mixture(corpus, weights, block=64, target=6400).collect()
    slots = {r["slot"]: r["source"] for r in rows}
    assert free > 1000 and sorted(slots) == list(range(100)) and sum(r["n_tokens"] for r in rows) == 6400
    assert all(abs(Counter(slots.values())[s] - 100 * w) <= 2 for s, w in weights.items())
    times = Counter(r["doc_id"] for r in mixing.mix_documents(corpus, weights, block=64, target=6400).collect())
    assert times == Counter(r["doc_id"] for r in rows if r["doc_offset"] == 0)
    assert mixing.mixture(corpus, weights, block=64, target=200 * 6400).select("slot").distinct().count() == 20_000
    assert mixing.mixture(corpus.where("false"), weights, block=64, target=6400).count() == 0


def test_odd_rows(odd, empty):
    rows = mixing.mixture(odd, block=16).collect()
    assert {r["source"] for r in rows} == {"a", "b", "c", ""}
    assert {r["doc_id"] for r in rows} == {1, 2, 4, None, 6, 7, 8, 9}
    mixed = mixing.mix_documents(odd, block=16)
    assert mixed.columns == odd.columns
    kept = mixed.collect()
    assert sum(r["doc_id"] == 1 and r["text"].startswith("A clean") for r in kept) >= 2 and all(r["text"] for r in kept)
    assert mixing.mixture(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    assert mixing.mixture(odd, {"a": 1.0, "b": 0.0, "zz": 5.0, "c": None}, block=16).select("source").distinct().collect() == [("a",)]


def test_sql_agrees_on_odd_rows(odd, monkeypatch):
    documents = odd.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    columns = ["slot", "source", "source_rank", "epoch", "slot_offset", "doc_id", "doc_offset", "n_tokens"]
    want = con.sql(f"select {', '.join(columns)} from ({mixing.SQL})").fetchall()
    found = [tuple(r) for r in mixing.mixture(odd).select(*columns).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, want))
