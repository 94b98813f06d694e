"""Scans of folders, tables of units and stored sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.ids import chunk_id, document_id
from corpusflow.schema import CHUNK, METADATA_FIELDS, UNIT
from corpusflow.sources.parsers import IMAGES, READERS, Reader


def visible(path: Column) -> Column:
    """Whether no part of a path starts with a dot."""
    return ~path.rlike(r"(^|/)\.[^/]")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


KINDS = {"text": [".txt", ".log"], "markdown": [".md", ".markdown"], "csv": [".csv"], "docx": [".docx"], "pptx": [".pptx"], "pdf": [".pdf"], "image": IMAGES}
KNOWN = {x for extensions in KINDS.values() for x in extensions}


def parser_name(ext: Column) -> Column:
    """The reader of an extension; null for what isn't read."""
    out = F.lit(None).cast("string")
    for name, extensions in KINDS.items():
        out = F.when(ext.isin(*extensions), name).otherwise(out)
    return out


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, size, content of every visible file below ``root``; the content is read only where it is used."""
    base = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.substring(F.col("path"), F.length(F.lit(root.rstrip("/"))) + F.instr("path", root.rstrip("/")), F.lit(1 << 30))
    return base.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content", below.alias("_below")).where(visible(F.col("_below"))).drop("_below")


def parse(found: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Units of files(path, content); see ``schema.UNIT``.

    Files of unknown type have none. A file of a known type that no reader is given for, such as an image, and one whose
    reader fails are each a row with an error, so that nothing is skipped unseen.
    """
    readers = {**READERS, **(readers or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                kind = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
                base = dict.fromkeys(METADATA_FIELDS) | {"file_name": name}
                if kind not in readers:
                    if kind in KNOWN:
                        rows.append((path, kind[1:], 0, None, None, base, f"no reader is given for {kind}"))
                    continue
                try:
                    units = readers[kind](bytes(content), path)
                except Exception as error:  # one bad file must not end the scan
                    rows.append((path, kind[1:], 0, None, None, base, f"{type(error).__name__}: {error}"))
                    continue
                for n, u in enumerate(units):
                    rows.append((path, u.source_type, n, u.locator, u.content, base | {k: v for k, v in u.metadata.items() if k in base}, None))
            yield pd.DataFrame(rows, columns=["source_path", "source_type", "ordinal", "locator", "content", "metadata", "error"])

    fields = {x.strip().split(" ")[0]: x.strip().split(" ", 1)[1] for x in _split(UNIT)}
    schema = ", ".join(f"{c} {fields[c]}" for c in ("source_path", "source_type", "ordinal", "locator", "content", "metadata", "error"))
    units = found.select("path", "content").mapInPandas(run, schema)
    units = units.withColumn("document_id", document_id(F.col("source_path")))
    return units.withColumn("id", chunk_id(F.col("document_id"), F.col("locator"), F.coalesce("content", F.lit(""))))


def _split(schema: str) -> list[str]:
    """Top-level parts of a DDL string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, and the schema is given, so that the file is read once."""
    return spark.read.schema(schema).json(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).parquet(path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Items that have both vectors."""
    return spark.read.parquet(path).where((F.size("emb_summary") > 0) & (F.size("emb_full") > 0))


def latest_per_id(rows: DataFrame, order: str) -> DataFrame:
    """One row per id, the last one by ``order``."""
    other = [c for c in rows.columns if c != "id"]
    picked = rows.groupBy("id").agg(F.max_by(F.struct(*other), order).alias("_r"))
    return picked.select("id", *[F.col(f"_r.{c}").alias(c) for c in other])
