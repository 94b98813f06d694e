from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from corpusflow.llm import packing

rng = random.Random(31)
word = lambda: "".join(rng.choice("bcdfghlm") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
SECRET = "ghp_" + "".join(rng.choice("abcdefABCDEF0123456789") for _ in range(36))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    docs, labels = [], []
    for i in range(300):
        text = prose(rng.randint(40, 200))
        if i % 10 == 0:
            text += " You idiot, you stupid moron! " + prose(10) + " Worthless scum, you idiot."
        docs.append([i, text, "en", f"src{i % 3}"])
        labels.append((i, 1, int(i % 10 == 0)))
    for i in range(300, 340):
        docs.append([i, docs[1][1], "en", "src1"])
    docs[5][1] += f" token {SECRET} end."
    docs += [[400, None, "en", "src0"], [401, "", None, None], [None, prose(50), "en", "src0"], [402, prose(9000), "en", "src2"]]
    df = spark.createDataFrame([(*d, None if d[1] is None else len(d[1]), 1) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint, `key` int")
    df.write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root), docs


def test_stages_by_brute_force(spark, tables):
    root, raw = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, root)
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == columns
            docs = spark.createDataFrame(seen[name], docs.schema)
    ids = lambda n: {r["doc_id"] for r in seen[n]}
    toxic = {i for i in range(300) if i % 10 == 0}
    assert ids("toxicity") == {d[0] for d in raw} - toxic
    assert ids("near_dedup") == ids("toxicity") - set(range(300, 340)), "of a group the least number stays"
    assert [r["text"] for r in seen["secrets"] if r["doc_id"] == 5][0].endswith("token [SECRET] end.")
    assert len(seen["secrets"]) == len(seen["near_dedup"])
    times = Counter(r["doc_id"] for r in seen["mixing"])
    assert set(times) == ids("secrets") - {400, 401}, "every document with text is in the mixture"
    packed = defaultdict(int)
    bins = defaultdict(int)
    for r in seen["packing"]:
        packed[(r["doc_id"], r["copy"])] += r["n_tokens"]
        bins[r["bin"]] += r["n_tokens"]
    text = {r["doc_id"]: r["text"] for r in seen["mixing"]}
    assert packed == {(i, c): max(1, len(text[i]) // 4) for i, n in times.items() for c in range(n)}
    assert max(bins.values()) <= packing.CAPACITY


def test_run_equals_the_stages(spark, tables):
    root, _ = tables
    rows = __spark_entry__.queries()["pipeline"](spark, root)
    assert rows.columns == ["bin", "bin_offset", "doc_id", "copy", "piece", "doc_offset", "n_tokens"]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, docs.collect()))


def test_empty_tables(spark, tables, tmp_path):
    root, _ = tables
    for name in ("documents", "labels"):
        spark.read.parquet(f"{root}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_entry_names_every_operator():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
