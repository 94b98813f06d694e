from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from corpusflow.config import CHAT, ONE_SHOT, ChunkOptions, ParseOptions, config_hash
from corpusflow.encoders import HashingEncoder, OfflineGenerator, document_prefix, encode_column, encode_tokens_column
from corpusflow.functions import ids, tables, text, vectors
from corpusflow.operators import assembly


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ids(spark):
    import hashlib

    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert one(spark, ids.document_id(F.lit("/a/é"))) == sha("doc::/a/é")
    assert one(spark, ids.chunk_id(F.lit("d"), F.lit("page:1"), F.lit("t"))) == sha("chunk::d::page:1::" + sha("t")[:16])


def test_linearize(spark):
    assert one(spark, tables.linearize(F.lit(" \n"))) == "Empty table."
    assert one(spark, tables.linearize(F.lit("a, b,\n1, 2,3\n\n4"))) == "Table with 2 rows and 3 columns: a, b, . Row 1: a=1, b=2. Row 2: a=4."
    many = "k\n" + "\n".join(map(str, range(11)))
    assert one(spark, tables.linearize(F.lit(many))).endswith("Row 10: k=9. … 1 more rows not shown.")
    assert one(spark, tables.linearize(F.lit("only,header"))) == "Table with 0 rows and 2 columns: only, header."


def test_preview(spark):
    assert tables.markdown_preview('a,b\n"x, y",2') == "| a | b |\n| --- | --- |\n| x, y | 2 |"
    assert tables.markdown_preview(" ") == "" and tables.markdown_preview(None) == ""
    assert tables.markdown_preview("a\n" + "z" * 41).endswith("z" * 40 + "… |")
    assert tables.markdown_preview("a\n" + "\n".join("123456789")).count("\n") == 7
    rows = spark.createDataFrame([("a\n1",), (None,)], "t string").select(tables.csv_preview("t").alias("p")).collect()
    assert [r["p"] for r in rows] == ["| a |\n| --- |\n| 1 |", ""]


def test_html_tables():
    html = "<p>x</p><table><tr><th>a</th><th>b</th></tr><tr><td>1, 2</td><td> 3\n4 </td></tr></table><table><tr><td>z</td></tr></table>"
    assert tables.html_tables_to_csv(html) == 'a,b\n"1, 2",3 4\nz'
    assert tables.html_tables_to_csv(None) == ""


def test_sniffing():
    assert tables.sniff_csv("a,b\n1,2")[0] == [["a", "b"], ["1", "2"]]
    assert tables.sniff_csv("a;b\n1;2")[0] == [["a", "b"], ["1", "2"]]
    assert tables.sniff_csv("a b\n1 2")[0] == [["a", "b"], ["1", "2"]]
    assert tables.sniff_csv("x\ny") == ([["x"], ["y"]], False)


def test_vectors(spark):
    v = F.array(*[F.lit(x).cast("float") for x in (3.0, 4.0)])
    assert one(spark, vectors.dot(v, v)) == 25
    assert [round(x, 6) for x in one(spark, vectors.l2_normalise(v))] == [0.6, 0.8]
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.l2_normalise(zero)) == [0.0, 0.0]
    assert one(spark, vectors.mean_pool(F.array(v, zero))) == [1.5, 2.0]
    assert one(spark, vectors.mean_pool(F.array(v))) == [3.0, 4.0]
    assert one(spark, vectors.mean_pool(F.array().cast("array<array<double>>"))) == []
    assert one(spark, vectors.max_sim(F.array(v, zero), F.array(v, zero))) == 25


def test_summary_and_full_text(spark):
    none = F.lit(None).cast("string")
    strings = F.lit(None).cast("array<string>")
    full = lambda kind, content, path=strings, near=none: one(spark, assembly.full_text(F.lit(kind), none, F.lit(content), path, near))
    assert full("image", "Caption: a cat\n\nOCR: hello", near=F.lit("by")) == "Figure caption: a cat. \nFigure text (OCR): hello. \nNearby context: by"
    assert full("image", "just text") == "Figure text (OCR): just text."
    assert full("md", "body", F.array(F.lit("A"), F.lit(""), F.lit("B"))) == "Section: A > B.\nbody"
    assert full("txt", "plain") == "plain"
    summary = lambda kind, content, cols=strings, n=F.lit(None).cast("int"): one(spark, assembly.summary_text(F.lit(kind), none, F.lit(content), cols, n))
    assert summary("csv", "") == "This table summarizes multiple rows across columns table columns."
    assert summary("csv", "", F.array(F.lit("a")), F.lit(3)) == "This table summarizes 3 rows across columns a."
    assert summary("image", "Figure caption: a cat. \nmore") == "This figure a cat."
    assert summary("txt", "\n first\nsecond") == "first"
    assert summary("txt", "y" * 281) == "y" * 280 + "…"


def test_rounding_keeps_the_sign_of_zero(spark):
    found = one(spark, F.transform(F.array(*map(F.lit, (-1e-9, -0.0, 0.0, 2.6e-6, -2.6e-6, 1.5, 1e308))), lambda x: vectors.rounded(x, 6)))
    assert list(map(repr, found[:3])) == ["-0.0", "-0.0", "0.0"] and found[3:] == [3e-6, -3e-6, 1.5, 1e308]
    assert one(spark, vectors.rounded(F.lit(0.5), 0)) == 1 and one(spark, vectors.rounded(F.lit(-2.5), 0)) == -3


def test_labels_and_blocks(spark):
    label = lambda page, slide: one(spark, assembly.citation_label(F.lit(2), F.lit("a.pdf"), F.lit(page).cast("int"), F.lit(slide).cast("int")))
    assert [label(3, None), label(0, 4), label(None, None), label(0, 0)] == ["[2] a.pdf (page 3)", "[2] a.pdf (page 4)", "[2] a.pdf", "[2] a.pdf"]
    block = lambda kind, preview, body="t": one(spark, assembly.context_block(F.lit(1), F.lit(kind), F.lit(7), F.lit(preview), F.lit(body)))
    assert block("pptx", "p") == "[1] Slide 7:\nt"
    assert block("csv", "| a |") == "[1] Table preview (first rows/cols):\n| a |\n\nDetails: t"
    assert len(block("txt", "", "z" * 3000)) == 2204


def test_citation_coverage(spark):
    cover = lambda t: one(spark, text.citation_coverage(F.lit(t)))
    assert cover("A [1]. B [2]. C [3]. D. E.") == 0.6
    assert cover("") is None
    assert one(spark, assembly.checked_answer(F.lit("A [1]. B [2]. C [3]. D. E."))) == "A [1]. B [2]. C [3]. D. E."
    assert one(spark, assembly.checked_answer(F.lit("A. B [1]."))).endswith(assembly.NOTE)


def test_configs():
    assert ChunkOptions(10, 0.9) == ChunkOptions(50, 0.5) and ChunkOptions().overlap_tokens == 36
    assert (ONE_SHOT.per_doc, ONE_SHOT.final_k, ONE_SHOT.mmr) == (8, 10, False) and (CHAT.per_doc, CHAT.final_k, CHAT.mmr) == (4, 8, True)
    with pytest.raises(ValueError):
        ONE_SHOT.replace(final_k=21)
    assert config_hash(ParseOptions()) != config_hash(ParseOptions(captions=True)) and len(config_hash("a")) == 16


def test_encoders(spark):
    encoder = HashingEncoder(32)
    x = encoder.encode(["alpha beta", "beta ALPHA", "", "c"])
    assert (x[0] == x[1]).all() and not x[2].any() and math.isclose(float((x[0] ** 2).sum()), 1, rel_tol=1e-5)
    rows = spark.createDataFrame([("alpha beta",), (None,)], "t string").select(encode_column(encoder, F.col("t")).alias("v"), encode_tokens_column(encoder, F.col("t")).alias("m")).collect()
    assert [round(v, 5) for v in rows[0]["v"]] == [round(float(v), 5) for v in x[0]] and not any(rows[1]["v"])
    assert len(rows[0]["m"]) == 2 and rows[1]["m"] == []
    assert document_prefix("intfloat/e5-base") == "passage: " and document_prefix("other") == ""
    assert OfflineGenerator().generate("", "Question: q\n\nContext:\n[1] One two. Three.\n\n[2] Four") == "One two [1]. Four [2]."
