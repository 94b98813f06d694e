from __future__ import annotations

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusflow.config import CHAT, ONE_SHOT
from corpusflow.engine import Engine
from corpusflow.operators import incremental
from corpusflow.sources import parsers
from corpusflow.sources.scan import corpus, files, jsonl, latest_per_id, parse
from corpusflow.sources.session_store import SessionStore
from corpusflow.sources.sinks import write_jsonl, write_parquet
from corpusflow.streaming.ingest import event_counts, ingest_stream


def zipped(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def docx(*paragraphs: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    return zipped(word__document_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>")


def pptx(*slides: str) -> bytes:
    return zipped(**{f"ppt__slides__slide{i}_xml": f"<p:sld {A}>{s}</p:sld>" for i, s in enumerate(slides, 1)})


def shape(text: str) -> str:
    return f"<p:sp><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"


TABLE = "<a:tbl>" + "".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in r) + "</a:tr>" for r in (["a", "b"], ["1", "2"])) + "</a:tbl>"


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "data"
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "cache.md").write_text("# Cache\nThe cache keeps lines close to the core.\n\n## Policy\nIt evicts the oldest line first.")
    (root / "sub" / "parts.csv").write_text('name,size\n"bolt, long",3\nnut,2\n')
    (root / "sub" / "note.txt").write_text("Latency matters. Bandwidth matters too. The bus is shared.")
    (root / "plan.docx").write_bytes(docx("First paragraph.", " ", "Second one."))
    (root / "deck.pptx").write_bytes(pptx(shape("Roadmap"), shape("Risks") + TABLE))
    (root / "bad.docx").write_bytes(b"not a zip")
    (root / "skip.bin").write_bytes(b"\0")
    (root / ".hidden" / "no.md").write_text("# no")
    (root / ".no.txt").write_text("no")
    return root


def test_scan_and_parse(spark, folder):
    found = files(spark, str(folder))
    assert {p.rsplit("/", 1)[-1] for (p,) in found.select("path").collect()} == {"cache.md", "parts.csv", "note.txt", "plan.docx", "deck.pptx", "bad.docx", "skip.bin"}
    units = {(r["source_path"].rsplit("/", 1)[-1], r["locator"]): r for r in parse(found).collect()}
    assert set(units) == {("cache.md", "md-section:1"), ("cache.md", "md-section:2"), ("parts.csv", "csv:all"), ("note.txt", "text:all"), ("plan.docx", "doc:all"), ("deck.pptx", "slide:1"), ("deck.pptx", "slide:2"), ("deck.pptx", "slide:2/table:1"), ("bad.docx", None)}
    assert units[("bad.docx", None)]["error"].startswith("BadZipFile") and units[("bad.docx", None)]["content"] is None
    assert units[("plan.docx", "doc:all")]["content"] == "First paragraph.\n\nSecond one."
    table = units[("parts.csv", "csv:all")]
    assert table["content"] == 'name,size\n"bolt, long",3\nnut,2' and table["metadata"]["num_rows"] == 2 and list(table["metadata"]["columns"]) == ["name", "size"]
    assert units[("deck.pptx", "slide:2")]["content"] == "Risks" and units[("deck.pptx", "slide:2/table:1")]["content"] == "a,b\n1,2"
    assert list(units[("cache.md", "md-section:2")]["metadata"]["heading_path"]) == ["Cache", "Policy"]


def fake_e5():
    """An encoder of the e5 family whose vectors tell the prefix of what it saw; a local class, as workers lack this module."""

    class Fake:
        name = "fake-e5"

        def encode(self, texts):
            import numpy as np

            return np.array([[t.startswith("passage: "), t.startswith("query: "), t.startswith("passage: query: "), 1.0] for t in texts], dtype=np.float32)

    return Fake()


def test_questions_and_passages_have_their_own_prefixes(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), encoder=fake_e5())
    engine.build(str(folder))
    assert {tuple(r["emb_full"]) for r in engine._corpus().collect()} == {(1.0, 0.0, 0.0, 1.0)}
    top = engine.stages(engine._one("What is cached?"))["dense_full"].collect()
    assert {r["score"] for r in top} == {1.0}, "a passage and a question agree in the last place only"


def test_vectors_are_reused(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    first = engine.build(str(folder))
    assert first["vectors_encoded"] > 0
    again = engine.build(str(folder))
    assert again["vectors_encoded"] == 0 and again["items"] == first["items"]
    (folder / "more.txt").write_text("Another file of one sentence.")
    assert engine.build(str(folder))["vectors_encoded"] == 1
    items = engine._corpus().select("item", "source_path", "chunk_index").orderBy("item").collect()
    assert [r["item"] for r in items] == list(range(len(items))) and [(r["source_path"], r["chunk_index"]) for r in items] == sorted((r["source_path"], r["chunk_index"]) for r in items)
    other = Engine(spark, str(tmp_path / "index"), encoder=fake_e5())
    assert other.build(str(folder))["vectors_encoded"] > 1


def test_parse_options_choose_readers(folder):
    from corpusflow.config import ParseOptions

    asked = {}

    def partition(data, path, strategy, languages):
        asked.update(strategy=strategy, languages=languages)
        return [parsers.Element("Table", "t", 1, "<table><tr><td>a</td><td>b</td></tr></table>")]

    readers = parsers.readers_for(ParseOptions(engine="elements", pdf_strategy="fast", ocr_languages=("eng", "deu")), partition)
    assert readers[".pdf"](b"", "x.pdf")[0].content == "a,b" and asked == {"strategy": "fast", "languages": ("eng", "deu")}
    assert parsers.readers_for(ParseOptions(engine="elements", infer_tables=False), partition)[".pdf"](b"", "x.pdf")[0].content == "t"
    images = parsers.readers_for(ParseOptions(captions=True, caption_tokens=7), ocr=lambda b, languages: "/".join(languages), caption=lambda b, tokens: f"{tokens} words")
    assert images[".png"](b"", "x.png")[0].content == "Caption: 7 words\n\nOCR: eng"
    assert parsers.readers_for(ParseOptions(), ocr=lambda b: "o", caption=lambda b: "c")[".png"](b"", "x.png")[0].content == "o"
    assert parsers.readers_for(ParseOptions(pdf_tables_as_csv=False))[".pdf"].keywords == {"tables_as_csv": False}
    with pytest.raises(ValueError):
        parsers.readers_for(ParseOptions(engine="elements"))


def test_readers_plug_in():
    read = parsers.image_reader(lambda b: "words", lambda b: "a cat")
    assert read(b"", "x.png")[0].content == "Caption: a cat\n\nOCR: words"
    assert parsers.image_reader(lambda b: " ")(b"", "x.png") == []
    elements = lambda data, path: [parsers.Element("Title", "T", 1), parsers.Element("Text", " "), parsers.Element("Table", "flat", 2, "<table><tr><td>a</td><td>b</td></tr></table>")]
    units = parsers.element_reader(elements)(b"", "x.pdf")
    assert [(u.content, u.locator) for u in units] == [("T", "page:1/elt:Title"), ("a,b", "page:2/elt:Table")]

    def fails(data, path):
        raise ValueError

    assert parsers.element_reader(fails, parsers.read_text)(b"plain", "x.txt")[0].content == "plain"
    table = parsers.table_unit([[None, ""], ["a", "b"], ["1"]], 3, 1)
    assert table.content == "a,b\n1," and table.locator == "page:3/table:1"
    assert parsers.table_unit([["a", "a"], ["1", "2"]], 1, 1).content.startswith("0,1\na,a")
    assert parsers.table_unit([[None]], 1, 1) is None


def test_engine_from_files_to_answer(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    first = engine.build(str(folder))
    assert first["files_parsed"] == 7 and first["items"] == first["chunks"] > 5
    again = engine.build(str(folder))
    assert again["files_parsed"] == 0 and again["chunks"] == first["chunks"], "nothing changed, so nothing is parsed"
    (folder / "sub" / "note.txt").write_text("Latency matters most of all. Bandwidth is second.")
    (folder / "plan.docx").unlink()
    third = engine.build(str(folder))
    assert third["files_parsed"] == 1
    assert spark.read.parquet(str(tmp_path / "index/units")).where("source_path like '%plan.docx'").count() == 0
    answer = engine.answer("What does the cache evict?", ONE_SHOT)
    assert "[1]" in answer.text and "cache.md" in answer.sources
    assert answer.info["fused_results"] >= answer.info["final_results"] >= 1
    table = engine.answer("Which row of the table has the bolt?", ONE_SHOT)
    assert "parts.csv" in table.sources
    session = engine.sessions.new("s1")
    engine.ask("What about latency?", session, CHAT)
    engine.ask("And bandwidth?", session, CHAT)
    assert engine.sessions.context(session).count("Previous Q: ") == 2
    assert list(engine.explain_retrieval("cache", CHAT))[-1] == "final"
    assert engine.doctor()["postings"] is True
    found = corpus(spark, str(tmp_path / "index/corpus"))
    assert found.select(F.min("item"), F.max("item"), F.count_distinct("item")).first() == (0, third["items"] - 1, third["items"])


def test_sessions(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "s"))
    assert store.context("none") == "" and store.list().count() == 0 and store.resume() is None
    now = dt.datetime(2024, 5, 2, 12)
    for i in range(4):
        store.add("a", f"q{i}", "x" * (200 + (i == 3)), ts=now - dt.timedelta(hours=30 - i))
    store.add("b", "q", "short", info={"k": 1}, ts=now - dt.timedelta(hours=24) + dt.timedelta(seconds=1))
    assert store.resume(now) == "b" and store.resume(now + dt.timedelta(hours=1)) is None
    lines = store.context("a").split("\n")
    assert lines[0] == "Previous Q: q1" and lines[1] == "Previous A: " + "x" * 200 and lines[-1] == "Previous A: " + "x" * 200 + "..."
    assert [r["session_id"] for r in store.list().collect()] == ["b", "a"]
    stats = store.stats("a").first()
    assert (stats["exchanges"], stats["mean_question"]) == (4, 2.0)
    assert store.history("a", 2).count() == 2 and store.export("a", str(tmp_path / "out")) == 4
    store.clear("a")
    assert store.load("a").count() == 0 and store.load("b").count() == 1
    store.add("a", "new", "y")
    assert store.load("a").count() == 1
    with pytest.raises(ValueError):
        store.load("../x")


def test_incremental(spark):
    t = dt.datetime(2024, 1, 1)
    now = spark.createDataFrame([("same", t, 1), ("later", dt.datetime(2024, 1, 2), 1), ("longer", t, 2), ("settings", t, 1), ("new", t, 1)], "path string, mtime timestamp, size bigint")
    old = spark.createDataFrame([("same", t, 1, "h"), ("later", t, 1, "h"), ("longer", t, 1, "h"), ("settings", t, 1, "g"), ("gone", t, 1, "h")], "path string, mtime timestamp, size bigint, config_hash string")
    status = {r["path"]: r["status"] for r in incremental.diff(now, old, "h").collect()}
    assert status == {"same": "unchanged", "later": "changed", "longer": "changed", "settings": "changed", "new": "new", "gone": "deleted"}
    assert {r["path"] for r in incremental.to_parse(now, old, "h").collect()} == {"later", "longer", "settings", "new"}
    rate = incremental.hit_rate(incremental.diff(now, old, "h")).first()
    assert (rate["files"], rate["hits"], rate["hit_rate"]) == (5, 1, 0.2)
    assert incremental.hit_rate(incremental.diff(now.where("false"), old.where("false"), "h")).first()["hit_rate"] == 0


def test_sinks_and_lookups(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "é"), ("a", 2, "y"), ("b", 1, None)], "id string, n int, t string")
    assert write_parquet(df, str(tmp_path / "p")) == 3 and write_jsonl(df, str(tmp_path / "j")) == 3
    assert jsonl(spark, str(tmp_path / "j"), "id string, n int, t string").where("t = 'é'").count() == 1
    assert {(r["id"], r["n"], r["t"]) for r in latest_per_id(df, "n").collect()} == {("a", 2, "y"), ("b", 1, None)}


def test_streams(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest_stream(spark, str(folder), out, state).awaitTermination(120)
    first = spark.read.parquet(out).count()
    (folder / "more.txt").write_text("Another text. It is new.")
    ingest_stream(spark, str(folder), out, state).awaitTermination(120)
    assert spark.read.parquet(out).count() == first + 1, "only the new file is read"
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5), "a"), (dt.datetime(2024, 1, 1, 0, 59), "a"), (dt.datetime(2024, 1, 1, 3), "b")], "ts timestamp, event_type string")
    assert {(r["event_type"], r["n"]) for r in event_counts(events).collect()} == {("a", 2), ("b", 1)}
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("counted").count() == 2
