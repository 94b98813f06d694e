"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are laid end to end in a shuffled order and read round and round in blocks of ``BLOCK`` tokens.
Slot i of the mixture has the point frac(i / golden ratio), computed in 31-bit integers; the source whose interval of
cumulative weights holds the point fills the slot with its next block. Any run of slots then has nearly the target
shares. Slots are ranked per source and joined with the blocks of equal rank.

The mixture has as many slots as it takes until every block of every source is used once, so no document is lost;
sources that the weights favour over their size start again (``epoch`` 1 and so on). Without given weights a source
weighs its tokens to the power ``ALPHA``, which favours small sources. Given weights may be far from the sizes and make
such a mixture very long; with ``target`` it has that many tokens instead (rounded up to a block), and what its slots
don't reach is left out.

Cases. A null source is the source ''. Documents without tokens (null or empty text) fill no slot and are not in the
mixture. A null ``doc_id`` is a value like any other. Repeated rows (equal doc_id, source and text) lie side by side and
count as one document as long as all of them together; rows of equal doc_id and other text are documents of their own.
Given weights that are null, not positive or of sources without documents are ignored; a source without a weight gets
no slot, and so does one whose share is below 2^-31. An empty table gives an empty mixture. Other columns are not read;
``mix_documents`` returns them untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusflow.llm.tokens import token_count
from corpusflow.operators.ranking import md5_position, prefix_rank
from corpusflow.session import materialize

BLOCK = 8192
ALPHA = 0.7
BITS = 31
#: 2^31 / golden ratio, made odd so that the points of 2^31 slots are all different
STEP = 1327217885
#: Slots of a source that its interval may lack against its share; the golden sequence lacks fewer in 2^31 slots.
SLACK = 16


def _text_key(docs: DataFrame) -> list[Column]:
    return [
        docs["doc_id"].cast("bigint").alias("_cf_id"),
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("_cf_source"),
        F.md5(docs["text"].cast("string")).alias("_cf_key"),
    ]


def layout(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Each document's place in the stream of its source: doc_id, source, key, tokens, start."""
    tokens = token_count(docs["text"]) if tokens is None else tokens
    rows = docs.select(*_text_key(docs), tokens.cast("bigint").alias("tokens")).where("tokens > 0")
    rows = (
        rows.groupBy(F.col("_cf_id").alias("doc_id"), F.col("_cf_source").alias("source"), F.col("_cf_key").alias("key"))
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("position", md5_position(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    )
    rows = materialize(rows, "mix-rows")
    ranked = prefix_rank(rows, ["source"], "position", ["doc_id", "key"], rows.count(), weight="tokens", before="start")
    return materialize(ranked.select("doc_id", "source", "key", "tokens", "start"), "mix-layout")


def intervals(laid: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """Per source: total tokens and its interval [low, high) of points."""
    sums = laid.groupBy("source").agg(F.sum("tokens").alias("total"))
    if weights is None:
        sums = sums.withColumn("w", F.round(F.pow(F.col("total").cast("double"), F.lit(alpha))).cast("decimal(20,0)"))
    else:
        good = {k or "": v for k, v in weights.items() if v and v > 0}
        unit = 1e9 / sum(good.values()) if good else 1.0
        given = laid.sparkSession.createDataFrame([(k, int(round(v * unit))) for k, v in good.items()], "source string, w bigint")
        sums = sums.join(given, "source").withColumn("w", F.col("w").cast("decimal(20,0)"))
    # one row per source: a single task orders them
    order = W.orderBy("source")
    cumulated = sums.withColumns({"c": F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("decimal(20,0)"), "all": F.sum("w").over(W.partitionBy()).cast("decimal(20,0)")})
    cumulated = cumulated.withColumn("high", F.expr(f"cast(c * {1 << BITS} div all as bigint)"))
    return cumulated.select("source", "total", F.coalesce(F.lag("high").over(order), F.lit(0)).alias("low"), "high").where("high > low")


def schedule(laid: DataFrame, block: int = BLOCK, weights: dict[str, float] | None = None, alpha: float = ALPHA, target: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(slots, sources): slot, source, source_rank; and source, total, slots of each source."""
    spark = laid.sparkSession
    sources = materialize(intervals(laid, weights, alpha).withColumn("need", F.ceil(F.col("total") / F.lit(block))), "mix-sources")
    most = sources.agg(F.max(F.ceil((F.col("need") + SLACK) * (1 << BITS) / (F.col("high") - F.col("low"))))).first()[0] or 0
    if target is not None:
        most = -(-target // block) if most else 0
    cells = 1024
    per = (1 << BITS) // cells
    points = spark.range(int(most)).select(F.col("id").alias("slot"), (F.col("id") % (1 << BITS) * STEP % (1 << BITS)).alias("u"))
    spread = sources.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {per}"), F.expr(f"(high - 1) div {per}"))))
    slots = points.withColumn("cell", F.expr(f"u div {per}")).join(spread, "cell").where("u >= low and u < high").select("slot", "source", "need")
    slots = materialize(slots, "mix-slots")
    ranked = materialize(prefix_rank(slots, ["source"], "slot", [], int(most), rank="source_rank", span=max(1, int(most))), "mix-ranked")
    last = ranked.agg(F.max("slot")).first()[0] if target is not None else ranked.where("source_rank = need - 1").agg(F.max("slot")).first()[0]
    ranked = ranked.where(F.col("slot") <= F.lit(-1 if last is None else last)).select("slot", "source", "source_rank")
    used = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("slots"))
    return ranked, sources.join(used, "source").select("source", "total", "slots")


def _epochs(laid: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    return laid.join(sources, "source").withColumn("epochs", F.ceil((F.col("slots") * block - F.col("start")) / F.col("total"))).where("epochs > 0")


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, alpha: float = ALPHA, tokens: Column | None = None, target: int | None = None) -> DataFrame:
    """The mixture's pieces: slot, source, source_rank, epoch, slot_offset, doc_id, doc_offset, n_tokens."""
    laid = layout(docs, tokens)
    slots, sources = schedule(laid, block, weights, alpha, target)
    rounds = _epochs(laid, sources, block).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs") - 1)))
    rounds = rounds.withColumn("lo", F.col("epoch") * F.col("total") + F.col("start")).withColumn("hi", F.least(F.col("lo") + F.col("tokens"), F.col("slots") * block))
    pieces = rounds.withColumn("source_rank", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    begin = F.greatest("lo", F.col("source_rank") * block)
    end = F.least("hi", (F.col("source_rank") + 1) * block)
    pieces = pieces.select("source", "source_rank", "epoch", (begin - F.col("source_rank") * block).alias("slot_offset"), "doc_id", (begin - F.col("lo")).alias("doc_offset"), (end - begin).alias("n_tokens"))
    # the slots grow with the data: no broadcast, however few there are
    return pieces.join(slots.hint("merge"), ["source", "source_rank"]).select("slot", "source", "source_rank", "epoch", "slot_offset", "doc_id", "doc_offset", "n_tokens")


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, alpha: float = ALPHA, target: int | None = None) -> DataFrame:
    """``docs`` as the mixture uses it: each document once per epoch in which a slot holds its first token."""
    laid = layout(docs)
    _, sources = schedule(laid, block, weights, alpha, target)
    times = _epochs(laid, sources, block).select(F.col("doc_id").alias("_cf_id2"), F.col("source").alias("_cf_source2"), F.col("key").alias("_cf_key2"), F.col("epochs").cast("int").alias("_cf_times"))
    keyed = docs.select("*", *_text_key(docs))
    joined = keyed.join(times, keyed["_cf_id"].eqNullSafe(times["_cf_id2"]) & (keyed["_cf_source"] == times["_cf_source2"]) & (keyed["_cf_key"] == times["_cf_key2"]))
    return joined.withColumn("_cf_epoch", F.explode(F.sequence(F.lit(1), F.col("_cf_times")))).select(*[joined[c] for c in docs.columns])


def in_order(docs: DataFrame, run: int, tokens: Column | None = None) -> DataFrame:
    """doc_id, source, key, tokens, copy, run: the rows of a mixture in runs of about ``run`` tokens each.

    A source's documents lie in the shuffled order of their stream, their first copies before their second ones; where a
    row lies in its source's stream, between 0 and 1, gives its run. So every run holds the same share of each source.
    """
    tokens = token_count(docs["text"]) if tokens is None else tokens
    rows = docs.select(*_text_key(docs), tokens.cast("bigint").alias("tokens")).where("tokens > 0")
    rows = rows.groupBy(F.col("_cf_id").alias("doc_id"), F.col("_cf_source").alias("source"), F.col("_cf_key").alias("key"), "tokens").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows.withColumn("position", md5_position(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "order-rows")
    sums = rows.groupBy("source").agg(F.sum("tokens").alias("once"), F.sum(F.col("tokens") * F.col("copies")).alias("all"))
    runs = max(1, -(-(sums.agg(F.sum("all")).first()[0] or 0) // run))
    laid = prefix_rank(rows, ["source"], "position", ["doc_id", "key", "tokens"], rows.count(), weight="tokens", before="start").join(sums, "source")
    # a document of several sources has its copies numbered through
    earlier = F.sum("copies").over(W.partitionBy("doc_id", "key", "tokens").orderBy("source")) - F.col("copies")
    every = laid.withColumn("first", earlier).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    place = (F.col("nth") * F.col("once") + F.col("start")) / F.col("all")
    return every.select("doc_id", "source", "key", "tokens", (F.col("first") + F.col("nth")).alias("copy"), F.least(F.lit(runs - 1), F.floor(place * runs)).cast("bigint").alias("run"))


SQL = f"""
WITH counted AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(text) AS key,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens
  FROM documents
), grouped AS (
  SELECT doc_id, source, key, sum(tokens)::BIGINT AS tokens FROM counted WHERE tokens > 0 GROUP BY doc_id, source, key
), laid AS (
  SELECT doc_id, source, tokens, coalesce(sum(tokens) OVER (PARTITION BY source
    ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id NULLS FIRST, key NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM grouped
), weighed AS (
  SELECT source, sum(tokens)::BIGINT AS total, round(pow(sum(tokens)::DOUBLE, {ALPHA}))::HUGEINT AS w FROM laid GROUP BY source
), cumulated AS (
  SELECT source, total, (sum(w) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING))::HUGEINT * {1 << BITS} // (sum(w) OVER ())::HUGEINT AS high FROM weighed
), interval_of AS (
  SELECT source, total, coalesce(lag(high) OVER (ORDER BY source), 0)::BIGINT AS low, high::BIGINT AS high, ceil(total / {BLOCK})::BIGINT AS need FROM cumulated
), points AS (
  SELECT unnest(range((SELECT max(ceil((need + {SLACK}) * {1 << BITS}.0 / (high - low)))::BIGINT FROM interval_of WHERE high > low))) AS slot
), ranked AS (
  SELECT slot, source, need, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS source_rank
  FROM points JOIN interval_of ON slot % {1 << BITS} * {STEP} % {1 << BITS} >= low AND slot % {1 << BITS} * {STEP} % {1 << BITS} < high
), slots AS (
  SELECT slot, source, source_rank FROM ranked WHERE slot <= (SELECT max(slot) FROM ranked WHERE source_rank = need - 1)
), used AS (
  SELECT source, count(*) * {BLOCK} AS room FROM slots GROUP BY source
), rounds AS (
  SELECT laid.*, total, room, unnest(range(ceil((room - start) / total)::BIGINT)) AS epoch
  FROM laid JOIN used USING (source) JOIN weighed USING (source)
), placed AS (
  SELECT doc_id, source, epoch, epoch * total + start AS lo, least(epoch * total + start + tokens, room) AS hi FROM rounds
), pieces AS (
  SELECT *, unnest(range(lo // {BLOCK}, (hi - 1) // {BLOCK} + 1)) AS source_rank FROM placed
)
SELECT slot, source, source_rank, epoch, greatest(lo, source_rank * {BLOCK}) - source_rank * {BLOCK} AS slot_offset, doc_id,
  greatest(lo, source_rank * {BLOCK}) - lo AS doc_offset,
  least(hi, (source_rank + 1) * {BLOCK}) - greatest(lo, source_rank * {BLOCK}) AS n_tokens
FROM pieces JOIN slots USING (source, source_rank)
"""
