from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.config import ChunkOptions
from corpusflow.operators import assembly, chunking
from corpusflow.sources.parsers import markdown_sections

CASES = {
    0: "intro\n# A\nx\n### B\ny\n## C\nz",
    1: "### Deep\nx\n# Top\ny",
    2: "#tag\nx",
    3: "\n\n# A\nx",
    4: "plain only",
    5: "# A\n```\n# not code-aware\n```",
}


def frame(spark, cases=CASES):
    return spark.createDataFrame(list(cases.items()), "doc_id bigint, text string")


def test_sections_equal_the_loop(spark):
    rows = chunking.markdown_sections(frame(spark)).orderBy("doc_id", "section_index").collect()
    for key, text in CASES.items():
        found = [(list(r["heading_path"]), r["content"]) for r in rows if r["doc_id"] == key]
        assert found == markdown_sections(text)
    paths = [list(r["heading_path"]) for r in rows if r["doc_id"] == 0]
    assert paths == [[], ["A"], ["A", "B"], ["A", "C"]]
    assert [list(r["heading_path"]) for r in rows if r["doc_id"] == 1] == [["Deep"], ["Top"]], "depth counts ancestors, not levels"


def test_heading_lines(spark):
    rows = chunking.heading_lines(frame(spark, {0: "# A\n## B\n### C\nx\n## D\ny\n#### E\n# F\nz"})).orderBy("line_no").collect()
    assert [(r["line"], r["h1"], r["h2"], r["h3"]) for r in rows] == [("x", "A", "B", "C"), ("y", "A", "D", None), ("#### E", "A", "D", None), ("z", "F", None, None)]


def test_table_blocks(spark):
    blocks = lambda t: [(r["is_table"], r["content"]) for r in chunking.table_blocks(frame(spark, {0: t})).orderBy("block").collect()]
    assert blocks("p\n| a | b |\n|---|:---:|\n| 1 | 2 |\nafter") == [(False, "p"), (True, "| a | b |\n|---|:---:|\n| 1 | 2 |"), (False, "after")]
    assert blocks("a | b\n--- | ---\n1 | 2") == [(True, "a | b\n--- | ---\n1 | 2")]
    assert blocks("a | b\n---\n1 | 2") == [(False, "a | b\n---\n1 | 2")], "one column is no table"
    assert blocks("\n \n") == []


def units(spark, rows):
    schema = "source_path string, source_type string, ordinal int, content string, metadata struct<page_number:int,slide_number:int,heading_path:array<string>,columns:array<string>,num_rows:int,element_type:string,content_format:string>"
    return spark.createDataFrame([(p, t, o, c, (None, s, None, None, None, None, f)) for p, t, o, c, s, f in rows], schema)


def test_slides(spark):
    rows = [("d", "pptx", i, c, i + 1, None) for i, c in enumerate(["one", " ", "three", " ", " "])] + [("e", "pptx", 0, "alone", 1, None)]
    slides = units(spark, rows).select("source_path", "ordinal", "content", F.col("metadata.slide_number").alias("slide_number"))
    assert {(r["source_path"], r["locator"]) for r in chunking.slide_chunks(slides).collect()} == {("d", "pptx-slide:1"), ("d", "pptx-slide:3"), ("e", "pptx-slide:1")}
    windows = {r["locator"]: r["content"] for r in chunking.slide_windows(slides).collect()}
    assert windows == {"pptx-window:1-2": "one", "pptx-window:2-3": "three", "pptx-window:3-4": "three"}


def test_dispatch(spark):
    rows = [
        ("a.md", "md", 0, "# T\nbody one", None, None), ("a.md", "md", 1, "a | b\n--- | ---\n1 | 2", None, None),
        ("b.csv", "csv", 0, "h\n1\n2", None, "csv"), ("c.txt", "txt", 0, "First. Second one.", None, None), ("c.txt", "txt", 1, " ", None, None), ("d.pptx", "pptx", 0, "s1", 1, None),
        ("e.pdf", "pdf", 0, "h,k\n1,2", None, "csv"), ("f", None, 0, "untyped. Text here.", None, None),
    ]
    found = {(r["source_path"], r["locator"]): r for r in chunking.chunk_units(units(spark, rows), ChunkOptions(50, 0.1)).collect()}
    assert set(found) == {("a.md", "md-chunk:1"), ("a.md", "md-chunk:2"), ("b.csv", "csv-chunk:1"), ("c.txt", "txt-chunk:1"), ("d.pptx", "pptx-slide:1"), ("e.pdf", "pdf-chunk:1"), ("f", "doc-chunk:1")}
    assert found[("a.md", "md-chunk:1")]["content"] == "body one" and list(found[("a.md", "md-chunk:1")]["heading_path"]) == ["T"]
    assert found[("b.csv", "csv-chunk:1")]["content"] == "h\n1\n2"
    again = chunking.chunk_units(units(spark, rows).repartition(7), ChunkOptions(50, 0.1))
    assert {r["id"] for r in again.collect()} == {r["id"] for r in found.values()}, "ids don't depend on partitions"


def test_neighbours_of_images(spark):
    schema = "id string, source_path string, page_number int, source_type string, element_type string, ordinal int, content string"
    rows = [("i", "p", 1, "image", None, 0, "x"), ("j", "p", None, "image", None, 1, "x"), ("a", "p", 1, "md", None, 2, " t1 "), ("b", "p", 1, "pdf", "Title", 3, "t2"), ("c", "p", 1, "pdf", "Table", 4, "no"), ("d", "p", 2, "md", None, 5, "no"), ("e", "p", None, "txt", None, 6, "z" * 700), ("f", "p", None, "txt", None, 7, "late")]
    found = {r["id"]: r["nearby"] for r in assembly.page_neighbours(spark.createDataFrame(rows, schema)).collect()}
    assert found == {"i": "t1\n\nt2", "j": "z" * 600 + "…"}
