"""Sessions as an append-only table of exchanges."""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.sessions import chat_context, last_exchanges, resumable, session_list, session_stats
from corpusflow.schema import EXCHANGE

_name = re.compile(r"[A-Za-z0-9_-]{1,80}")


class SessionStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def new(self, name: str | None = None) -> str:
        return self._checked(name or f"session_{dt.datetime.now():%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:6]}")

    def _checked(self, name: str) -> str:
        if not _name.fullmatch(name):
            raise ValueError("a session's name has letters, digits, - and _ only")
        return name

    def exchanges(self) -> DataFrame:
        """All exchanges that no later clearing covers."""
        try:
            rows = self.spark.read.schema(EXCHANGE).parquet(self.path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], EXCHANGE)
        cleared = rows.where("question is null").groupBy("session_id").agg(F.max("seq").alias("_cleared"))
        return rows.where("question is not null").join(cleared, "session_id", "left").where("_cleared is null or seq > _cleared").drop("_cleared")

    def load(self, session: str) -> DataFrame:
        return self.exchanges().where(F.col("session_id") == self._checked(session)).orderBy("seq")

    def _append(self, session: str, question: str | None, answer: str | None, sources: str | None, info: dict[str, str] | None, ts: dt.datetime | None) -> None:
        try:
            last = self.spark.read.schema(EXCHANGE).parquet(self.path).where(F.col("session_id") == session).agg(F.max("seq")).first()[0]
        except AnalysisException:
            last = None
        row = (session, (last or 0) + 1, ts or dt.datetime.now(), question, answer, sources, info)
        self.spark.createDataFrame([row], EXCHANGE).write.mode("append").parquet(self.path)

    def add(self, session: str, question: str, answer: str, sources: str = "", info: dict[str, object] | None = None, ts: dt.datetime | None = None) -> None:
        self._append(self._checked(session), question, answer, sources, {k: str(v) for k, v in (info or {}).items()}, ts)

    def clear(self, session: str) -> None:
        self._append(self._checked(session), None, None, None, None, None)

    def history(self, session: str, n: int | None = None) -> DataFrame:
        rows = self.load(session)
        return (last_exchanges(rows, n) if n else rows).orderBy("seq")

    def context(self, session: str) -> str:
        found = chat_context(self.load(session)).first()
        return found["context"] if found else ""

    def list(self, n: int = 10) -> DataFrame:
        return session_list(self.exchanges(), n)

    def resume(self, now: dt.datetime | None = None) -> str | None:
        found = resumable(self.exchanges(), str(now or dt.datetime.now())).first()
        return found["session_id"] if found else None

    def stats(self, session: str) -> DataFrame:
        return session_stats(self.load(session))

    def export(self, session: str, path: str) -> int:
        rows = self.load(session)
        total = rows.count()
        rows.withColumn("exported_at", F.current_timestamp()).withColumn("total_exchanges", F.lit(total)).coalesce(1).write.mode("overwrite").json(path)
        return total
