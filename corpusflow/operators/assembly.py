"""From ranked items to a cited prompt, and from units to the texts that encoders see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusflow.functions.tables import linearize
from corpusflow.functions.text import citation_coverage, is_blank, strip

BLOCK_CHARS = 2200
NEARBY_CHARS = 600
SUMMARY_CHARS = 280
PROSE = ("Title", "NarrativeText", "List", "Paragraph")
LEAST_CITED = 0.6
NOTE = "\n\nNote: some statements carry no citation; please check them against the sources."
SYSTEM = (
    "Answer from the numbered context alone. Be brief and exact, join what comes from one document into one passage, "
    "keep its lists and tables, and put the number of the block, as in [1], right after each claim it supports. "
    "Where the context has no answer, say that you do not know."
)
TASK = "Answer briefly, cite the blocks by number after each claim, use nothing but the context, and end with a list of sources."


def page_neighbours(units: DataFrame, most: int = NEARBY_CHARS, empty: bool = False) -> DataFrame:
    """id, nearby: texts of the prose units on the same page of the same file, for every image.

    Units are taken in order until their lengths exceed ``most`` characters; the joined text is cut there. Blank units
    don't count, unless ``empty``.
    units(id, source_path, page_number, source_type, element_type, ordinal, content); a page may be null.
    """
    prose = units.where((F.col("element_type").isin(*PROSE) | F.col("source_type").isin("md", "txt")) & (F.lit(empty) | ~is_blank(F.col("content"))))
    # of a text longer than ``most`` the rest is never shown, and nothing follows it
    near = prose.select(F.col("id").alias("_id"), F.col("source_path").alias("_path"), F.col("page_number").alias("_page"), F.col("ordinal").alias("_at"), F.substring(strip(F.col("content")), 1, most + 1).alias("_text"))
    images = units.where("source_type = 'image'").select("id", "source_path", "page_number")
    pairs = images.join(near, (images.source_path == near._path) & images.page_number.eqNullSafe(near._page) & (images.id != near._id))
    before = F.coalesce(F.sum(F.length("_text")).over(W.partitionBy("id").orderBy("_at", "_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = pairs.withColumn("_before", before).where(F.col("_before") <= most)
    joined = taken.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_id", "_text"))), lambda x: x["_text"]), "\n\n").alias("t"), F.count("_text").alias("n"))
    joined = joined.withColumn("t", F.when(F.col("n") > 0, F.col("t")))
    return joined.select("id", F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit("…"))).otherwise(F.col("t")).alias("nearby"))


def full_text(source_type: Column, content_format: Column, content: Column, heading_path: Column, nearby: Column, empty: bool = False) -> Column:
    """What the full vector is made of: a table in sentences, an image's caption and text, a section under its path.

    Empty captions, neighbours and sections leave nothing, or with ``empty`` the words that lead to them.
    """
    content = F.coalesce(content, F.lit(""))
    captioned = content.startswith("Caption:")
    parts = F.split(content, "OCR:", 2)
    edges = lambda text: F.trim(text, F.lit(" \t\n"))
    caption = F.when(captioned, edges(F.replace(F.get(parts, F.lit(0)), F.lit("Caption:"), F.lit("")))).otherwise("")
    ocr = F.when(captioned, edges(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))).otherwise(content)
    piece = lambda lead, text, end, shown=F.lit(empty): F.when(shown & text.isNotNull() | (F.coalesce(text, F.lit("")) != ""), F.concat(F.lit(lead), text, F.lit(end)))
    figure = F.concat_ws(" \n", piece("Figure caption: ", caption, ".", captioned & F.lit(empty)), piece("Figure text (OCR): ", ocr, "."), piece("Nearby context: ", nearby, ""))
    path = F.array_join(F.filter(heading_path, lambda h: F.coalesce(h, F.lit("")) != ""), " > ")
    section = F.concat(F.lit("Section: "), path, F.lit("."), F.when(F.lit(empty) | (content != ""), F.concat(F.lit("\n"), content)).otherwise(""))
    return (
        F.when((F.coalesce(content_format, F.lit("")) == "csv") | (source_type == "csv"), linearize(content))
        .when(source_type == "image", F.when(figure == "", content).otherwise(figure))
        .when(F.coalesce(F.size(heading_path), F.lit(0)) > 0, section)
        .otherwise(content)
    )


def summary_text(source_type: Column, content_format: Column, text: Column, columns: Column, num_rows: Column) -> Column:
    """What the summary vector is made of: a table's columns, a figure's caption or the first line of the text."""
    names = F.when(F.coalesce(F.size(columns), F.lit(0)) > 0, F.array_join(F.slice(columns, 1, 10), ", ")).otherwise("table columns")
    table = F.concat(F.lit("This table summarizes "), F.coalesce(num_rows.cast("string"), F.lit("multiple")), F.lit(" rows across columns "), names, F.lit("."))
    first = F.get(F.split(text, "\n", 2), F.lit(0))
    figure = F.concat(F.regexp_replace(F.regexp_replace(F.replace(first, F.lit("Figure caption:"), F.lit("This figure")), r"^\p{Zs}+|\p{Zs}+\z", ""), r"[.]+\z", ""), F.lit("."))
    line = F.get(F.split(strip(text), "\n", 2), F.lit(0))
    short = F.when(F.length(line) > SUMMARY_CHARS, F.concat(F.regexp_replace(F.substring(line, 1, SUMMARY_CHARS), r"\p{Zs}+\z", ""), F.lit("…"))).otherwise(line)
    return (
        F.when((F.coalesce(content_format, F.lit("")) == "csv") | (source_type == "csv"), table)
        .when(source_type == "image", F.when(text.contains("Figure caption:"), figure).otherwise("This figure supports the section around it."))
        .otherwise(short)
    )


def slide_label(number: Column) -> Column:
    return F.when(number.isNull(), F.lit("Slide")).otherwise(F.concat(F.lit("Slide "), number.cast("string")))


def citation_label(rank: Column, path: Column, page: Column, slide: Column) -> Column:
    """``[n] path (page p)``; without a page, or with page 0, the slide's number; without either no bracket."""
    shown = F.coalesce(F.nullif(page, F.lit(0)), F.nullif(slide, F.lit(0)))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), path, F.when(shown.isNotNull(), F.concat(F.lit(" (page "), shown.cast("string"), F.lit(")"))).otherwise(""))


def context_block(rank: Column, source_type: Column, slide: Column, preview: Column, text: Column) -> Column:
    """A numbered block of the prompt: a slide under its label, a table's preview before its text, or the text."""
    body = F.substring(strip(text), 1, BLOCK_CHARS)
    number = F.concat(F.lit("["), rank.cast("string"), F.lit("] "))
    return (
        F.when(source_type == "pptx", F.concat(number, slide_label(slide), F.lit(":\n"), body))
        .when(F.coalesce(preview, F.lit("")) != "", F.concat(number, F.lit("Table preview (first rows/cols):\n"), preview, F.lit("\n\nDetails: "), body))
        .otherwise(F.concat(number, body))
    )


def prompts(blocks: DataFrame) -> DataFrame:
    """query_id, user: the question and its blocks(query_id, question, rank, block) in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    joined = blocks.groupBy("query_id").agg(F.first("question").alias("question"), F.array_join(ordered, "\n\n").alias("context"))
    return joined.select("query_id", F.concat(F.lit("Question: "), "question", F.lit("\n\nContext:\n"), "context", F.lit("\n\n" + TASK)).alias("user"))


def checked_answer(answer: Column) -> Column:
    """The answer, with a note where fewer than 60 % of its sentences are cited."""
    return F.when(citation_coverage(answer) < LEAST_CITED, F.concat(answer, F.lit(NOTE))).otherwise(answer)
