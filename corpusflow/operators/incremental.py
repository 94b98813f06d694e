"""Re-ingest of what changed: files against the manifest of the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(files: DataFrame, manifest: DataFrame, config_hash: str) -> DataFrame:
    """path, status of every file and every entry: unchanged, changed, new or deleted.

    Unchanged means equal modification time, size and settings. files(path, mtime, size); see ``schema.MANIFEST``.
    """
    old = manifest.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.col("config_hash").alias("_hash"))
    both = files.select("path", "mtime", "size").join(old, F.col("path") == F.col("_path"), "full_outer")
    same = F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size")) & (F.col("_hash") == config_hash)
    status = F.when(F.col("path").isNull(), "deleted").when(F.col("_path").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return both.select(F.coalesce("path", "_path").alias("path"), status.alias("status"))


def to_parse(files: DataFrame, manifest: DataFrame, config_hash: str) -> DataFrame:
    """The files that no entry covers."""
    current = manifest.where(F.col("config_hash") == config_hash).select("path", "mtime", "size")
    return files.join(current, ["path", "mtime", "size"], "left_anti")


def reusable(stored: DataFrame, files: DataFrame, manifest: DataFrame, config_hash: str) -> DataFrame:
    """Rows of ``stored`` (with source_path) whose files are unchanged."""
    current = manifest.where(F.col("config_hash") == config_hash).select("path", "mtime", "size")
    kept = files.select("path", "mtime", "size").join(current, ["path", "mtime", "size"], "left_semi")
    return stored.join(kept.select(F.col("path").alias("source_path")), "source_path", "left_semi")


def hit_rate(status: DataFrame) -> DataFrame:
    """files, hits and their share, deleted files aside."""
    present = status.where("status <> 'deleted'")
    hit = F.col("status") == "unchanged"
    return present.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(hit.cast("bigint")), F.lit(0)).alias("hits"), F.round(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)), 6).alias("hit_rate"))
