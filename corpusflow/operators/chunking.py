"""From parsed units to chunks: by headings, by sentences, by rows and by slides.

Inputs are units (document_id, source_path, source_type, ordinal, content, metadata). Windows are per document, so each
strategy shuffles by document once at most; sentence and row packing don't shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusflow.config import ChunkOptions
from corpusflow.functions.ids import chunk_id, document_id, fingerprint
from corpusflow.functions.text import is_blank, sentences, strip, token_len
from corpusflow.operators import segments

_dashes = "[ \\t]*:?---+:?[ \\t]*"
DELIMITER_ROW = f"^[ \\t]*[|]?{_dashes}([|]{_dashes})+[|]?[ \\t\\r]*$"
CUT = "\n\n---\n\n"


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no from 0, line: one row per line, line ends gone."""
    return docs.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("line_no", "line"))


def markdown_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section_index from 1, level, title, heading_path, content of each section.

    A line whose first sign is ``#`` opens a section, however deep, and is its first line. Text before the first heading
    is a section without path. The path drops as many headings as the new one's level asks for and takes the new one.
    """
    rows = lines_of(docs, key, text).withColumn("_s", strip("line"))
    rows = rows.withColumn("_h", F.col("_s").startswith("#"))
    by_line = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.sum(F.col("_h").cast("int")).over(by_line))
    level = F.length(F.regexp_extract("_s", "^#+", 0))
    title = strip(F.regexp_replace("_s", "^#+", ""))
    sections = rows.groupBy(key, "_n").agg(
        F.max(F.when(F.col("_h"), level)).alias("level"),
        F.max(F.when(F.col("_h"), title)).alias("title"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"),
    )
    # the path is a fold over the document's headings so far
    headings = F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "title"))).over(W.partitionBy(key).orderBy("_n").rowsBetween(W.unboundedPreceding, 0))
    path = F.aggregate(headings, F.array().cast("array<string>"), lambda p, h: F.concat(F.when(h["level"] <= F.size(p), F.slice(p, 1, h["level"] - 1)).otherwise(p), F.array(h["title"])))
    first = F.row_number().over(W.partitionBy(key).orderBy("_n"))
    return sections.select(key, first.alias("section_index"), "level", "title", path.alias("heading_path"), "content")


def heading_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, line, h1, h2, h3 of every line that is no heading of these levels: the headings it stands under."""
    rows = lines_of(docs, key, text).withColumn("_l", F.length(F.regexp_extract(strip("line"), "^(#{1,3})[ \t]", 1)))
    rows = rows.withColumn("_t", strip(F.regexp_replace(strip("line"), "^#{1,3}[ \t]+", "")))
    by_line = W.partitionBy(key).orderBy("line_no")
    upto = by_line.rowsBetween(W.unboundedPreceding, 0)
    for n in (1, 2, 3):
        # a heading of a higher level ends the lower ones
        rows = rows.withColumn(f"_m{n}", F.when(F.col("_l").between(1, n), F.struct(F.when(F.col("_l") == n, F.col("_t")).alias("t"))))
        rows = rows.withColumn(f"h{n}", F.last(f"_m{n}", ignorenulls=True).over(upto)["t"])
    return rows.where("_l = 0").select(key, "line_no", "line", "h1", "h2", "h3")


def table_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, block from 1, is_table, content: runs of lines, with each pipe table as one block.

    A table is a line with a pipe over a delimiter row of two columns or more, and goes on as long as lines have a pipe.
    Blank blocks are dropped. ``keep`` names further columns by which blocks are parted.
    """
    rows = docs if "line_no" in docs.columns else lines_of(docs, key, text)
    order = W.partitionBy(key, *keep).orderBy("line_no")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    piped = F.col("line").contains("|")
    rows = rows.withColumn("_head", piped & F.coalesce(F.lead("line").over(order).rlike(DELIMITER_ROW), F.lit(False)))
    rows = rows.withColumn("_under", F.coalesce(F.lag("_head").over(order), F.lit(False)))
    # a run of piped or delimiter lines; tables start at a head and last until the run ends
    rows = rows.withColumn("_stop", F.sum((~(piped | F.col("_under"))).cast("int")).over(upto))
    rows = rows.withColumn("_in", F.max(F.col("_head").cast("int")).over(W.partitionBy(key, *keep, "_stop").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)) == 1)
    rows = rows.withColumn("_in", F.col("_in") & (piped | F.col("_under")))
    before = F.lag("_in").over(order)
    # inside a table a further head is one of its rows
    opens = before.isNull() | (before != F.col("_in"))
    rows = rows.withColumn("_block", F.sum(opens.cast("int")).over(upto))
    out = rows.groupBy(key, *keep, "_block").agg(F.first("_in").alias("is_table"), F.min("line_no").alias("_at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    out = out.where(~is_blank(F.col("content")))
    return out.select(key, *keep, F.row_number().over(W.partitionBy(key).orderBy("_at")).alias("block"), "is_table", F.regexp_replace("content", "\n+$", "").alias("content"))


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentence_no from 0, sentence."""
    return docs.select(key, F.posexplode(sentences(F.col(text))).alias("sentence_no", "sentence"))


def apply_segments(rows: DataFrame, function: Callable, *arguments: object, text: str = "content", spans: bool = False) -> DataFrame:
    """``rows`` with chunk_index from 1 and chunk, one row per chunk of the column ``text``; no shuffle.

    The other columns ride along in the batch. With ``spans``, start and end are added.
    """
    extra = "chunk_index int, chunk string" + (", start int, end int" if spans else "")
    carried = [f for f in rows.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, chunks, starts, ends = [], [], [], [], []
            for i, value in enumerate(batch.column(text).to_pylist()):
                for n, chunk in enumerate(function(value, *arguments), 1):
                    at.append(i)
                    number.append(n)
                    chunks.append(chunk[0] if spans else chunk)
                    if spans:
                        starts.append(chunk[1])
                        ends.append(chunk[2])
            taken = batch.select([f.name for f in carried]).take(pa.array(at, pa.int64()))
            columns = [*taken.columns, pa.array(number, pa.int32()), pa.array(chunks, pa.string())]
            names = [*(f.name for f in carried), "chunk_index", "chunk"]
            if spans:
                columns += [pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
                names += ["start", "end"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def slide_chunks(units: DataFrame) -> DataFrame:
    """Each non-blank slide by itself; chunk_index counts blank slides too."""
    order = W.partitionBy("source_path").orderBy("slide_number", "ordinal")
    rows = units.withColumn("chunk_index", F.row_number().over(order))
    rows = rows.where(~is_blank(F.col("content")))
    return rows.select("source_path", "chunk_index", F.concat(F.lit("pptx-slide:"), F.col("chunk_index").cast("string")).alias("locator"), "content", "slide_number")


def slide_windows(units: DataFrame) -> DataFrame:
    """Every two neighbouring slides together, blank ones left out of the text; nothing where both are blank."""
    order = W.partitionBy("source_path").orderBy("slide_number", "ordinal")
    rows = units.withColumns({"_next": F.lead("content").over(order), "_more": F.lead(F.lit(1)).over(order), "_last": F.lead("slide_number").over(order), "_n": F.row_number().over(order)}).where("_more = 1")
    text = F.array_join(F.filter(F.array(F.coalesce("content", F.lit("")), F.coalesce("_next", F.lit(""))), lambda x: ~is_blank(x)), CUT)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    rows = rows.select(
        "source_path", F.coalesce(F.when(F.col("slide_number") != 0, F.col("slide_number")), F.col("_n")).cast("int").alias("chunk_index"),
        F.concat(F.lit("pptx-window:"), number("slide_number"), F.lit("-"), number("_last")).alias("locator"), text.alias("content"), "slide_number",
    )
    return rows.where(~is_blank(F.col("content")))


def chunk_units(units: DataFrame, options: ChunkOptions | None = None) -> DataFrame:
    """Chunks of parsed units, each by the strategy of its type; see ``schema.CHUNK``."""
    options = options or ChunkOptions()
    budget = (options.target_tokens, options.overlap_tokens)
    units = units.where(~is_blank(F.col("content")) | (F.col("source_type") == "pptx")).withColumn("source_type", F.coalesce("source_type", F.lit("")))
    no_strings = F.lit(None).cast("array<string>")
    nothing = {"page_number": F.lit(None).cast("int"), "slide_number": F.lit(None).cast("int"), "heading_path": no_strings, "columns": no_strings, "num_rows": F.lit(None).cast("int"), "element_type": F.lit(None).cast("string")}

    in_order = F.sort_array(F.collect_list(F.struct("ordinal", "content")))
    files = units.where("source_type = 'md'").groupBy("source_path").agg(F.array_join(F.transform(in_order, lambda x: x["content"]), "\n\n").alias("text"))
    under = heading_lines(files, "source_path")
    blocks = table_blocks(under, "source_path", keep=("h1", "h2", "h3")).withColumn("heading_path", F.array_compact(F.array("h1", "h2", "h3")))
    plain = apply_segments(blocks.where("not is_table").select("source_path", "block", "heading_path", "content"), segments.split_recursive, *budget)
    whole = blocks.where("is_table").select("source_path", "block", "heading_path", F.lit(1).alias("chunk_index"), F.col("content").alias("chunk"))
    pieces = plain.unionByName(whole)
    number = F.row_number().over(W.partitionBy("source_path").orderBy("block", "chunk_index"))
    markdown = pieces.select("source_path", F.lit("md").alias("source_type"), number.alias("chunk_index"), F.col("chunk").alias("content"), "heading_path", F.lit("markdown").alias("content_format"))
    markdown = markdown.withColumn("locator", F.concat(F.lit("md-chunk:"), F.col("chunk_index").cast("string"))).withColumns({k: v for k, v in nothing.items() if k != "heading_path"})

    slides = units.where("source_type = 'pptx'").select("source_path", "ordinal", "content", F.col("metadata.slide_number").alias("slide_number"))
    decks = slide_chunks(slides).withColumn("content_format", F.lit("pptx_slide")).unionByName(slide_windows(slides).withColumn("content_format", F.lit("pptx_slide_window")))
    decks = decks.withColumn("source_type", F.lit("pptx")).withColumns({k: v for k, v in nothing.items() if k != "slide_number"})

    carried = ["page_number", "slide_number", "heading_path", "columns", "num_rows", "element_type", "content_format"]
    others = units.where("source_type not in ('md', 'pptx')").select("source_path", "source_type", "ordinal", "content", *[F.col(f"metadata.{c}").alias(c) for c in carried])
    by_rows = F.coalesce(F.col("content_format") == "csv", F.lit(False)) | (F.col("source_type") == "csv")
    packed = apply_segments(others.where(~by_rows), lambda t, n, o: [x[0] for x in segments.pack_sentences(t, n, o)], *budget)
    rows = apply_segments(others.where(by_rows), segments.pack_rows, *budget)
    kind = F.when(F.col("source_type") == "", "doc").otherwise(F.col("source_type"))
    rest = packed.unionByName(rows).withColumn("locator", F.concat(kind, F.lit("-chunk:"), F.col("chunk_index").cast("string"))).withColumnRenamed("chunk", "content")

    columns = ["source_path", "source_type", "chunk_index", "content", "locator", *carried]
    every = markdown.select(*columns).unionByName(decks.select(*columns)).unionByName(rest.select(*columns))
    every = every.withColumn("document_id", document_id(F.col("source_path")))
    return every.select(
        chunk_id(F.col("document_id"), F.col("locator"), F.col("content")).alias("id"), "document_id", "source_path", "source_type", F.col("chunk_index").cast("int").alias("chunk_index"),
        "locator", "content", token_len(F.col("content")).alias("num_tokens"), fingerprint(F.col("content")).alias("content_sha1"), *carried,
    )
