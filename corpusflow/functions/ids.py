"""Identities derived from content: the same input gets the same id on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(path: Column) -> Column:
    return F.sha1(F.concat(F.lit("doc::"), path))


def fingerprint(content: Column) -> Column:
    """The first 16 hex digits of SHA-1."""
    return F.substring(F.sha1(content), 1, 16)


def chunk_id(document: Column, locator: Column, content: Column) -> Column:
    return F.sha1(F.concat(F.lit("chunk::"), document, F.lit("::"), locator, F.lit("::"), fingerprint(content)))
