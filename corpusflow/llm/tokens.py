"""The length of a text in tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def token_count(text: Column) -> Column:
    """One token per four characters, at least one for a text that has any; 0 for null and empty texts.

    It needs no vocabulary, counts every script alike and stays inside generated code. Operators take any other
    non-negative integer column in its place, such as the count of a tokenizer.
    """
    n = F.length(text.cast("string"))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / CHARS_PER_TOKEN))).cast("bigint")
