"""How the driver's tables stand in for the model's relations, in DataFrames and in DuckDB SQL.

``embeddings`` are the items' vectors (their first half plays the summary vector), ``label`` is an item's document, and
the vector of a ``benchmark`` question is the row of ``embeddings`` with its number: no encoder made those vectors, so
this is a convention, not a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: documents with headings of three levels and pipe tables put in at fixed lines."""

    def line(x, i):
        head = F.when(i % 7 == 0, F.concat(F.lit("# "), x)).when(i % 7 == 3, F.concat(F.lit("## "), x)).when(i % 7 == 5, F.concat(F.lit("### "), x)).otherwise(x)
        return F.when(i % 11 == 4, F.concat(F.lit("a | b\n--- | ---\n1 | "), x)).otherwise(head)

    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


MARKDOWN = """md AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE
    WHEN (i - 1) % 11 = 4 THEN 'a | b' || chr(10) || '--- | ---' || chr(10) || '1 | ' || x
    WHEN (i - 1) % 7 = 0 THEN '# ' || x WHEN (i - 1) % 7 = 3 THEN '## ' || x WHEN (i - 1) % 7 = 5 THEN '### ' || x ELSE x END), chr(10)) AS text
  FROM documents
), md_lines AS (
  SELECT doc_id, u.i - 1 AS line_no, u.line AS line FROM (
    SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'line': x})) AS u FROM md)
)"""


def brand_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_brand, content: the parts of each brand as CSV text."""
    row = F.concat_ws(",", "p_name", "p_type", F.col("p_size").cast("string"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"])
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.concat(F.array(F.lit("name,type,size")), rows), "\n").alias("content"))


BRAND_CSV = """brand_csv AS (
  SELECT p_brand, 'name,type,size' || chr(10) || string_agg(p_name || ',' || p_type || ',' || p_size, chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY p_brand
)"""


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_path, slide_number, ordinal, content: conversations as decks, with every third slide blank."""
    blank = F.col("turn") % 3 == 2
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source_path"), F.col("turn").cast("int").alias("slide_number"), F.lit(0).alias("ordinal"), F.when(blank, " \n").otherwise(F.col("text")).alias("content"))


SLIDES = """slides AS (
  SELECT conv_id::VARCHAR AS source_path, turn::INTEGER AS slide_number, CASE WHEN turn % 3 = 2 THEN ' ' || chr(10) ELSE text END AS content FROM conversations
)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units of several types, eight to a page of a file."""
    kind = F.col("doc_id") % 4
    first = F.substring_index("text", "\n", 1)
    content = F.when(kind == 0, F.concat(F.lit("Caption: "), first, F.lit("\n\nOCR: "), F.length("text").cast("string"))).when(kind == 2, F.concat(F.lit("name,size\n"), F.replace("text", F.lit(" "), F.lit(",")))).otherwise(F.col("text"))
    types = F.when(kind == 0, "image").when(kind == 1, "md").when(kind == 2, "csv").otherwise("txt")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("source_path"), F.floor(F.col("doc_id") / 8).cast("int").alias("page_number"), types.alias("source_type"), F.lit(None).cast("string").alias("element_type"),
        F.col("doc_id").alias("ordinal"), content.alias("content"), F.when(kind == 1, F.array("source", "lang")).alias("heading_path"),
        F.when(kind == 2, F.array(F.lit("name"), F.lit("size"))).alias("columns"), F.when(F.col("doc_id") % 8 == 2, F.lit(7)).alias("num_rows"),
    )


UNITS = """units AS (
  SELECT doc_id AS id, lang AS source_path, (doc_id // 8)::INTEGER AS page_number,
    CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'md' WHEN 2 THEN 'csv' ELSE 'txt' END AS source_type, doc_id AS ordinal,
    CASE doc_id % 4 WHEN 0 THEN 'Caption: ' || string_split(text, chr(10))[1] || chr(10) || chr(10) || 'OCR: ' || length(text)
      WHEN 2 THEN 'name,size' || chr(10) || replace(text, ' ', ',') ELSE text END AS content,
    CASE WHEN doc_id % 4 = 1 THEN [source, lang] END AS heading_path, CASE WHEN doc_id % 4 = 2 THEN ['name', 'size'] END AS columns,
    CASE WHEN doc_id % 8 = 2 THEN 7 END AS num_rows
  FROM documents
), near AS (
  SELECT a.id, trim(b.content, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) AS t, b.ordinal,
    coalesce(sum(length(trim(b.content, ' ' || chr(9) || chr(10) || chr(12) || chr(13)))) OVER (PARTITION BY a.id ORDER BY b.ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM units a JOIN units b ON a.source_path = b.source_path AND a.page_number = b.page_number AND a.id <> b.id
  WHERE a.source_type = 'image' AND b.source_type IN ('md', 'txt')
), nearby AS (
  SELECT id, CASE WHEN length(t) > 600 THEN substr(t, 1, 600) || '…' ELSE t END AS nearby
  FROM (SELECT id, string_agg(t, chr(10) || chr(10) ORDER BY ordinal) AS t FROM near WHERE before <= 600 GROUP BY id)
)"""


def linearized_sql(content: str) -> str:
    """CSV text in sentences, as a SQL expression over a column."""
    return f"""(SELECT CASE WHEN len(ls) = 0 THEN 'Empty table.' ELSE array_to_string(list_concat(
      ['Table with ' || (len(ls) - 1) || ' rows and ' || len(h) || ' columns: ' || array_to_string(h[1:20], ', ') || '.'],
      list_transform(ls[2:11], lambda r, i: 'Row ' || i || ': ' || array_to_string(list_filter(list_transform(string_split(r, ',')[1:len(h)], lambda c, k: CASE WHEN h[k] <> '' THEN h[k] || '=' || trim(c, ' ' || chr(9)) END), lambda p: p IS NOT NULL), ', ') || '.'),
      CASE WHEN len(ls) - 1 > 10 THEN ['… ' || (len(ls) - 11) || ' more rows not shown.'] ELSE [] END), ' ') END
    FROM (SELECT ls, list_transform(string_split(ls[1], ','), lambda c: trim(c, ' ' || chr(9))) AS h FROM (
      SELECT list_filter(string_split({content}, chr(10)), lambda x: trim(x, ' ' || chr(9)) <> '') AS ls)))"""


FULL_TEXT = f"""texts AS (
  SELECT units.*, CASE source_type
    WHEN 'csv' THEN {linearized_sql("content")}
    WHEN 'image' THEN 'Figure caption: ' || trim(replace(string_split(content, 'OCR:')[1], 'Caption:', ''), ' ' || chr(10) || chr(9)) || '.' || ' ' || chr(10)
      || 'Figure text (OCR): ' || trim(array_to_string(string_split(content, 'OCR:')[2:], 'OCR:'), ' ' || chr(10) || chr(9)) || '.' || coalesce(' ' || chr(10) || 'Nearby context: ' || nearby, '')
    WHEN 'md' THEN 'Section: ' || array_to_string(heading_path, ' > ') || '.' || chr(10) || content
    ELSE content END AS full_text
  FROM units LEFT JOIN nearby USING (id)
)"""


# ---- retrieval ----


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, question: every other benchmark text asks for a table, every third for a slide."""
    kind = F.when(F.col("item_id") % 2 == 0, " Which Table row?").otherwise("").alias("t")
    slide = F.when(F.col("item_id") % 3 == 0, " Which slide?").otherwise("")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", kind, slide).alias("question"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return questions(spark, sf_dir).join(vectors, "query_id")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, document_id, vectors, text, kind of every document that has a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").cast("string").alias("document_id"), F.col("embedding").alias("vector"), F.slice("embedding", 1, 32).alias("summary"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text", "lang", F.concat("source", F.lit("/"), "lang").alias("source_path"), F.col("text").contains("|").alias("is_table"))
    # the vectors are the smaller side; texts are moved, not sorted
    return docs.join(vectors.hint("shuffle_hash"), "item").withColumn("is_slide", F.col("lang") == "de")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.operators.sessions import exchanges

    return exchanges(table(spark, sf_dir, "conversations"))


EXCHANGES = """exchanges AS (
  SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, text AS question, CASE WHEN next_role = 'assistant' THEN next_text END AS answer
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'
)"""


def file_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files as the users' events leave them, and a manifest from before 20 January that has lost and gained entries."""
    events = table(spark, sf_dir, "events").withColumn("path", F.concat(F.lit("/data/user"), F.col("user_id").cast("string"), F.lit(".md")))
    state = lambda df: df.groupBy("path").agg(F.max("ts").alias("mtime"), F.count(F.lit(1)).alias("size"))
    now = state(events.where("user_id % 10 <> 3"))
    before = state(events.where((F.col("user_id") % 2 == 0) | (F.col("ts") < F.lit("2024-01-20").cast("timestamp"))).where("user_id % 7 <> 1"))
    return now, before.withColumn("config_hash", F.when(F.col("path").contains("9"), "old").otherwise("now"))


FILES = """ev AS (
  SELECT '/data/user' || user_id || '.md' AS path, user_id, ts FROM events
), now AS (
  SELECT path, max(ts) AS mtime, count(*) AS size FROM ev WHERE user_id % 10 <> 3 GROUP BY path
), manifest AS (
  SELECT path, max(ts) AS mtime, count(*) AS size, CASE WHEN contains(path, '9') THEN 'old' ELSE 'now' END AS config_hash
  FROM ev WHERE (user_id % 2 = 0 OR ts < TIMESTAMP '2024-01-20') AND user_id % 7 <> 1 GROUP BY path
), status AS (
  SELECT coalesce(n.path, m.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN m.path IS NULL THEN 'new'
    WHEN n.mtime = m.mtime AND n.size = m.size AND m.config_hash = 'now' THEN 'unchanged' ELSE 'changed' END AS status
  FROM now n FULL OUTER JOIN manifest m ON n.path = m.path
)"""


def dot_sql(a: str, b: str) -> str:
    return f"round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]), 9)"


#: Every ranked list of the hybrid queries as one chain of CTEs.
RETRIEVAL = f"""questions AS (
  SELECT item_id AS query_id, text || CASE WHEN item_id % 2 = 0 THEN ' Which Table row?' ELSE '' END || CASE WHEN item_id % 3 = 0 THEN ' Which slide?' ELSE '' END AS question FROM benchmark
), asked AS (
  SELECT query_id, question, embedding AS vector FROM questions JOIN embeddings ON query_id = vec_id
), items AS (
  SELECT vec_id AS item, label::VARCHAR AS document_id, embedding AS vector, embedding[1:32] AS summary, text, contains(text, '|') AS is_table, lang = 'de' AS is_slide, source || '/' || lang AS source_path
  FROM embeddings JOIN documents ON vec_id = doc_id
), dense_summary AS (
  SELECT query_id, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank
    FROM (SELECT query_id, item, {dot_sql("asked.vector[1:32]", "items.summary")} AS score FROM asked, items)) WHERE rank <= 60
), dense_full AS (
  SELECT query_id, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank
    FROM (SELECT query_id, item, {dot_sql("asked.vector", "items.vector")} AS score FROM asked, items)) WHERE rank <= 60
), words AS (
  SELECT item, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM items
), posts AS (
  SELECT item, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT item, unnest(w) AS term, len(w) AS dl FROM words) GROUP BY item, term
), stats AS (
  SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words
), raw_idf AS (
  SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts, stats GROUP BY term
), vocab AS (
  SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf FROM raw_idf
), query_terms AS (
  SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(string_split_regex(lower(question), '\\s+'), lambda x: x <> '')) AS term FROM questions) GROUP BY query_id, term
), bm25 AS (
  SELECT query_id, item, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM query_terms JOIN vocab USING (term) JOIN posts USING (term), stats GROUP BY query_id, item
), sparse AS (
  SELECT query_id, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM bm25) WHERE rank <= 60
), lists AS (
  SELECT query_id, item, 0 AS list, rank, 0.9 / (60 + rank) AS part FROM dense_summary
  UNION ALL SELECT query_id, item, 1, rank, 1.2 / (60 + rank) FROM dense_full UNION ALL SELECT query_id, item, 2, rank, 0.8 / (60 + rank) FROM sparse
), fused AS (
  SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list, seen) AS rank
  FROM (SELECT query_id, item, round(sum(part), 12) AS score, min(list) AS list, arg_min(rank, list) AS seen FROM lists GROUP BY query_id, item)
), table_top AS (
  SELECT * FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, item) AS rank
    FROM (SELECT query_id, items.item, score FROM questions CROSS JOIN items LEFT JOIN bm25 USING (query_id, item) WHERE is_table AND regexp_matches(lower(question), 'table|column|row|csv|spreadsheet'))) WHERE rank <= 20
), slide_top AS (
  SELECT * FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY item) AS rank FROM questions CROSS JOIN items WHERE is_slide AND regexp_matches(lower(question), 'slide|deck|presentation|pptx|powerpoint')) WHERE rank <= 30
), with_tables AS (
  SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY list, place) AS rank FROM (
    SELECT query_id, item, min(list) AS list, arg_min(rank, list) AS place FROM (SELECT query_id, item, 0 AS list, rank FROM table_top UNION ALL SELECT query_id, item, 1, rank FROM fused) GROUP BY query_id, item)
), injected AS (
  SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY list, place) AS rank FROM (
    SELECT query_id, item, min(list) AS list, arg_min(rank, list) AS place FROM (SELECT query_id, item, 0 AS list, rank FROM slide_top UNION ALL SELECT query_id, item, 1, rank FROM with_tables) GROUP BY query_id, item)
)"""


def chain_sql(name: str, source: str, cap: int, pool: int, topn: int) -> str:
    """Cap and lexical rerank of a ranked list, as CTEs ``<name>_capped`` and ``<name>_reranked``."""
    words = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda x: x <> ''))"
    return f"""{name}_capped AS (
  SELECT query_id, item, document_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (
    SELECT query_id, item, document_id, rank, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS nth FROM {source} JOIN items USING (item)) WHERE nth <= {cap}
), {name}_scored AS (
  SELECT query_id, item, document_id, rank, round(len(list_intersect({words("question")}, {words("substr(text, 1, 2000)")})) / greatest(len({words("question")}), 1), 9) AS score
  FROM {name}_capped JOIN questions USING (query_id) JOIN (SELECT item, text FROM items) USING (item) WHERE rank <= {pool}
), {name}_reranked AS (
  SELECT * FROM (SELECT query_id, item, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, item) AS rank FROM {name}_scored) WHERE rank <= {topn}
)"""


def mmr_sql(name: str, source: str, k: int, weight: float) -> str:
    """Greedy picks from a reranked list, one per round of a recursion, as CTE ``<name>``."""
    return f"""{name}_cand AS (
  SELECT r.query_id, r.item, r.rank, i.vector, list_dot_product(a.vector::DOUBLE[], i.vector::DOUBLE[]) AS near FROM {source} r JOIN items i USING (item) JOIN asked a USING (query_id)
), {name} AS (
  SELECT query_id, item, 1 AS rank, score, [item] AS picked FROM (SELECT query_id, item, round(near, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(near, 9) DESC, rank) AS n FROM {name}_cand) WHERE n = 1
  UNION ALL
  SELECT query_id, item, next_rank, score, list_append(picked, item) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS n FROM (
      SELECT c.query_id, c.item, c.rank, m.rank + 1 AS next_rank, m.picked,
        round({weight} * c.near - (1 - {weight}) * (SELECT max(list_dot_product(c.vector::DOUBLE[], s.vector::DOUBLE[])) FROM items s WHERE list_contains(m.picked, s.item)), 9) AS score
      FROM {name} m JOIN {name}_cand c USING (query_id) WHERE m.rank < {k} AND NOT list_contains(m.picked, c.item))) WHERE n = 1
)"""


def coherent_sql(source: str, k: int) -> str:
    return f"""SELECT query_id, item, document_id, is_top, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_top DESC, old) AS rank FROM (
    SELECT query_id, item, document_id, rank AS old, document_id IS NOT DISTINCT FROM first_value(document_id) OVER (PARTITION BY query_id ORDER BY n DESC, seen, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS is_top
    FROM (SELECT *, count(*) OVER (PARTITION BY query_id, document_id) AS n, min(rank) OVER (PARTITION BY query_id, document_id) AS seen FROM {source}))) WHERE rank <= {k}"""
