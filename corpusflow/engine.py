"""The engine: builds an index from a folder and answers questions from it.

The index is a folder of Parquet tables: manifest, units, chunks, corpus (items with texts and vectors), postings,
vocabulary and stats. It is built once and read by every question. What is unchanged since the last build is reused.
"""

from __future__ import annotations

import importlib.util
import os
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.config import CHAT, ONE_SHOT, ChunkOptions, ParseOptions, RetrievalConfig, config_hash
from corpusflow.encoders import QUERY_PREFIX, Encoder, Generator, HashingEncoder, OfflineGenerator, Reranker, document_prefix, encode_column, rerank
from corpusflow.functions.tables import csv_preview
from corpusflow.functions.text import SLIDE_WORDS, TABLE_WORDS, mentions
from corpusflow.operators import assembly, incremental, retrieval
from corpusflow.operators.chunking import chunk_units
from corpusflow.operators.ranking import numbered
from corpusflow.session import materialize
from corpusflow.sources.parsers import Reader, readers_for
from corpusflow.sources.scan import corpus, files, parse
from corpusflow.sources.session_store import SessionStore
from corpusflow.sources.sinks import write_parquet


@dataclass
class Answer:
    text: str
    sources: str
    info: dict[str, object]


class Engine:
    def __init__(
        self, spark: SparkSession, index: str, encoder: Encoder | None = None, generator: Generator | None = None, reranker: Reranker | None = None,
        readers: dict[str, Reader] | None = None, partition: Callable | None = None, ocr: Callable | None = None, caption: Callable | None = None, parse_options: ParseOptions | None = None, chunk_options: ChunkOptions | None = None,
    ):
        self.spark, self.index = spark, index.rstrip("/")
        self.encoder, self.generator, self.reranker = encoder or HashingEncoder(), generator or OfflineGenerator(), reranker
        self.parse_options, self.chunk_options = parse_options or ParseOptions(), chunk_options or ChunkOptions()
        self.readers = {**readers_for(self.parse_options, partition, ocr, caption), **(readers or {})}
        self.sessions = SessionStore(spark, f"{self.index}/sessions")

    def _path(self, name: str) -> str:
        return f"{self.index}/{name}"

    def _stored(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._path(name))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    # ---- build ----

    def build(self, root: str, skip: tuple[str, ...] = (), force: bool = False) -> dict[str, int]:
        """Scan, chunk, encode and index ``root``; ``skip`` names stages (parse, chunk, embed) to take as they are."""
        done: dict[str, int] = {}
        if "parse" not in skip:
            done |= self._parse(root, force)
        if "chunk" not in skip:
            done["chunks"] = write_parquet(chunk_units(self._stored("units").where("error is null"), self.chunk_options), self._path("chunks"))
        if "embed" not in skip:
            done |= self._embed()
        return done

    def _parse(self, root: str, force: bool) -> dict[str, int]:
        found = files(self.spark, root)
        settings = config_hash(self.parse_options)
        manifest, old = self._stored("manifest"), self._stored("units")
        if manifest is None or old is None or force:
            todo, kept = found, None
        else:
            manifest = materialize(manifest, "manifest")
            todo, kept = incremental.to_parse(found, manifest, settings), incremental.reusable(old, found, manifest, settings)
        units = parse(todo, self.readers)
        parsed = todo.count()
        units = units if kept is None else units.unionByName(kept)
        # the old table is among the inputs, so the new one is written beside it first
        units = materialize(units, "units")
        count = write_parquet(units, self._path("units"))
        new = found.select("path", "mtime", "size", F.lit(settings).alias("config_hash"))
        write_parquet(new, self._path("manifest"))
        return {"files_parsed": parsed, "units": count}

    def _embed(self) -> dict[str, int]:
        chunks = self._stored("chunks").withColumn("ordinal", F.col("chunk_index"))
        nearby = assembly.page_neighbours(chunks)
        rows = chunks.join(nearby, "id", "left")
        rows = rows.withColumn("full_text", assembly.full_text(F.col("source_type"), F.col("content_format"), F.col("content"), F.col("heading_path"), F.col("nearby")))
        rows = rows.withColumn("summary_text", assembly.summary_text(F.col("source_type"), F.col("content_format"), F.col("full_text"), F.col("columns"), F.col("num_rows")))
        # items are numbered in the order of files and chunks
        rows = numbered(rows.drop("nearby"), ["source_path", "chunk_index", "id"], "item")
        done = {"vectors_encoded": self._encode(rows)}
        vectors = self._stored("vectors").where(F.col("encoder") == self._encoder_hash())
        for text, name in (("summary_text", "emb_summary"), ("full_text", "emb_full")):
            rows = rows.withColumn("_key", F.sha1(text)).join(vectors.select(F.col("key").alias("_key"), F.col("vector").alias(name)), "_key", "left").drop("_key")
        done["items"] = write_parquet(rows, self._path("corpus"), ["source_type"])
        texts = self._corpus().select("item", F.col("full_text").alias("text"))
        done["postings"] = write_parquet(retrieval.postings(texts).repartition("term").sortWithinPartitions("term"), self._path("postings"))
        write_parquet(retrieval.bm25_stats(texts), self._path("stats"))
        done["terms"] = write_parquet(retrieval.vocabulary(self._stored("postings"), self._stored("stats")), self._path("vocabulary"))
        return done

    def _encoder_hash(self) -> str:
        return config_hash(type(self.encoder).__name__, self.encoder.name, document_prefix(self.encoder.name))

    def _encode(self, rows: DataFrame) -> int:
        """Encode the texts of which no vector by this encoder is stored yet; each text once. Returns their number."""
        texts = rows.select("summary_text").union(rows.select("full_text")).toDF("text").where("text is not null")
        texts = texts.groupBy(F.sha1("text").alias("key")).agg(F.first("text").alias("text"))
        known = self._stored("vectors")
        if known is not None:
            texts = texts.join(known.where(F.col("encoder") == self._encoder_hash()).select("key"), "key", "left_anti")
        new = texts.select("key", F.lit(self._encoder_hash()).alias("encoder"), encode_column(self.encoder, F.col("text")).alias("vector"))
        new = materialize(new, "vectors")
        count = new.count()
        if count or known is None:
            new.write.mode("append").parquet(self._path("vectors"))
        return count

    def _corpus(self) -> DataFrame:
        return corpus(self.spark, self._path("corpus"))

    # ---- search ----

    def stages(self, questions: DataFrame, config: RetrievalConfig = ONE_SHOT) -> dict[str, DataFrame]:
        """Every step's ranked list for questions(query_id, question), by name; the last is ``final``."""
        items = self._corpus()
        # questions come from users; their vectors use the corpus's encoder
        asked = questions.withColumn("vector", encode_column(self.encoder, F.col("question"), QUERY_PREFIX))
        asked = materialize(asked, "questions")
        out: dict[str, DataFrame] = {}
        out["dense_summary"] = retrieval.dense_topk(asked, items.select("item", F.col("emb_summary").alias("vector")), config.k_summary)
        out["dense_full"] = retrieval.dense_topk(asked, items.select("item", F.col("emb_full").alias("vector")), config.k_full)
        texts = questions.select("query_id", F.col("question").alias("text"))
        index = [self._stored(n) for n in ("postings", "vocabulary", "stats")]
        scores = materialize(retrieval.bm25_scores(texts, *index), "scores")
        out["sparse"] = retrieval.zero_filled(scores, texts, items, config.k_sparse) if config.keep_zero else retrieval.top(scores, config.k_sparse)
        fused = retrieval.rrf([(out["dense_summary"], config.weights[0]), (out["dense_full"], config.weights[1]), (out["sparse"], config.weights[2])], config.rrf_constant)
        out["fused"] = fused = materialize(fused, "fused")
        if config.inject:
            fused = self._inject(fused, questions, scores, items, config)
        named = items.select("item", "document_id")
        out["capped"] = capped = retrieval.cap_per_document(fused.join(named, "item").select("query_id", "item", "rank", "document_id"), config.per_doc)
        passages = items.select("item", F.col("full_text"), F.when((F.col("source_type") == "csv") | (F.col("content_format") == "csv"), F.col("content")).alias("_csv"))
        pool = capped.where(F.col("rank") <= config.pool).join(passages, "item").join(questions, "query_id")
        shown = F.concat(csv_preview(F.col("_csv")), F.lit("\n"), F.col("full_text")) if config.previews else F.col("full_text")
        pool = pool.withColumn("passage", F.when(F.col("_csv").isNotNull(), shown).otherwise(F.col("full_text")))
        ranked = rerank(pool, self.reranker, config.pool, config.top_reranked) if self.reranker else retrieval.lexical_rerank(pool, config.pool, config.top_reranked)
        out["reranked"] = ranked = materialize(ranked.select("query_id", "item", "rank", "score"), "reranked")
        if config.mmr:
            vectors = items.select("item", F.col("emb_full").alias("vector"))
            candidates = ranked.join(vectors, "item").join(asked.select("query_id", F.col("vector").alias("query_vector")), "query_id")
            final = retrieval.mmr(candidates, config.final_k, config.lambda_mmr)
        elif config.coherence:
            final = retrieval.coherence(ranked.join(named, "item"), config.final_k)
        else:
            final = ranked.where(F.col("rank") <= config.final_k)
        out["final"] = final.select("query_id", "item", "rank")
        return out

    def _inject(self, fused: DataFrame, questions: DataFrame, scores: DataFrame, items: DataFrame, config: RetrievalConfig) -> DataFrame:
        tables = items.where((F.col("source_type") == "csv") | (F.col("content_format") == "csv")).select("item")
        wants = questions.where(mentions(F.col("question"), TABLE_WORDS)).select("query_id")
        fused = retrieval.inject(fused, retrieval.zero_filled(scores, wants, tables, 20))
        if not config.slide_hints:
            return fused
        hinted = F.lit(False)
        for hint in config.slide_hints:
            hinted = hinted | F.lower("source_path").contains(hint.lower())
        slides = items.where((F.col("source_type") == "pptx") & hinted).select("item")
        wants = questions.where(mentions(F.col("question"), SLIDE_WORDS)).select("query_id")
        return retrieval.inject(fused, retrieval.first_items(wants, slides, 30))

    def search(self, questions: DataFrame, config: RetrievalConfig = ONE_SHOT) -> DataFrame:
        """query_id, rank, item, label, block: the final contexts of all questions."""
        return self._blocks(self.stages(questions, config)["final"], config)

    def _blocks(self, final: DataFrame, config: RetrievalConfig) -> DataFrame:
        items = self._corpus().select("item", "id", "source_path", "source_type", "page_number", "slide_number", "full_text", F.when((F.col("source_type") == "csv") | (F.col("content_format") == "csv"), F.col("content")).alias("_csv"))
        rows = final.join(items, "item").withColumn("preview", csv_preview(F.col("_csv")) if config.previews else F.lit(""))
        label = assembly.citation_label(F.col("rank"), F.col("source_path"), F.col("page_number"), F.col("slide_number"))
        block = assembly.context_block(F.col("rank"), F.col("source_type"), F.col("slide_number"), F.col("preview"), F.col("full_text"))
        return rows.select("query_id", "rank", "item", "id", label.alias("label"), block.alias("block"))

    def explain_retrieval(self, question: str, config: RetrievalConfig = ONE_SHOT) -> dict[str, DataFrame]:
        """One table per step for a single question."""
        return self.stages(self._one(question), config)

    def _one(self, question: str) -> DataFrame:
        return self.spark.createDataFrame([(0, question)], "query_id bigint, question string")

    # ---- answers ----

    def answer(self, question: str, config: RetrievalConfig = ONE_SHOT, context: str = "") -> Answer:
        began = time.time()
        asked = self._one(question)
        steps = self.stages(asked, config)
        rows = self._blocks(steps["final"], config).orderBy("rank").collect()  # at most final_k rows
        prompt = f"Question: {question}\n\nContext:\n" + "\n\n".join(r["block"] for r in rows) + f"\n\n{assembly.TASK}"
        system = config.system_prompt or assembly.SYSTEM
        if context:
            system = f"{system}\n\nThe conversation so far:\n{context}"
        text = self.generator.generate(system, prompt, config.timeout)
        if config.check_citations:
            text = self.spark.range(1).select(assembly.checked_answer(F.lit(text))).first()[0]
        lists = [df.select(F.lit(name).alias("step")) for name, df in steps.items()]
        found = {r["step"]: r["n"] for r in reduce(DataFrame.union, lists).groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts = {f"{name}_results": found.get(name, 0) for name in steps}
        info = {"model_used": type(self.generator).__name__, **counts, "generation_time_s": round(time.time() - began, 3), "sources_count": len(rows)}
        return Answer(text, "\n".join(r["label"] for r in rows), info)

    def ask(self, question: str, session: str, config: RetrievalConfig = CHAT) -> Answer:
        """An answer in a session: its last exchanges are context, and the new one is stored."""
        answer = self.answer(question, config, self.sessions.context(session))
        self.sessions.add(session, question, answer.text, answer.sources, answer.info)
        return answer

    def doctor(self) -> dict[str, bool]:
        """Which optional readers, settings and tables are there."""
        modules = {m: importlib.util.find_spec(m) is not None for m in ("pypdf", "pdfplumber", "tiktoken")}
        settings = {v: v in os.environ for v in ("GENERATOR_BASE_URL", "GENERATOR_API_KEY")}
        return {**modules, **settings, **{t: self._stored(t) is not None for t in ("manifest", "units", "chunks", "corpus", "postings")}}
