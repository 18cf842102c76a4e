"""Chunking, terms and BM25 over the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import catalog, chunking, evidence, lexical
from ..session import scratch_path
from ..sources import files
from ..sources.tables import spread, table
from .registry import query

WS = r"\s\x{0b}\x1c-\x1f\x{85}\p{Z}"
TERMS = r"regexp_extract_all(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"
DOC_TERMS = TERMS.format("text")

CHUNKS = rf"""
p AS (SELECT *, regexp_extract_all(text, '[^{WS}]+[{WS}]*') AS w,
             length(regexp_extract(text, '^[{WS}]*')) AS lead FROM documents),
n AS (SELECT *, len(w) AS n, CASE WHEN len(w) <= 180 THEN 0 ELSE CAST(ceil((len(w) - 180) / 150.0) AS INT) END AS last
      FROM p WHERE len(w) > 0),
c AS (SELECT *, CAST(unnest(range(0, last + 1)) AS INT) AS chunk_no FROM n),
s AS (SELECT *, lead + length(array_to_string(w[1:chunk_no * 150], '')) AS span_start,
             least(180, n - chunk_no * 150) AS token_count,
             regexp_replace(array_to_string(w[chunk_no * 150 + 1:chunk_no * 150 + 180], ''), '[{WS}]+$', '') AS chunk_text
      FROM c),
chunks AS (SELECT * EXCLUDE (w, lead, n, last), span_start + length(chunk_text) AS span_end FROM s)
"""

CHUNK_ID = """sha256('{"chunking":{"chunker_version":"word-span-v1","max_tokens":180,'
 || '"normalization":"frozen-normalized-utf8","overlap":30,"tokenizer_version":"unicode-word-regex-v1"},"end":'
 || span_end || ',"revision":"' || doc_id || '","start":' || span_start || '}')"""


def bm25_sql(docs: str, key: str, allowed: str = "TRUE", queries: str = "benchmark") -> str:
    return f"""
d AS (SELECT {key}, {allowed} AS ok, {DOC_TERMS} AS t FROM {docs}),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
tf AS (SELECT {key}, ok, l, term, count(*) AS tf FROM (SELECT {key}, ok, len(t) AS l, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qtf
      FROM (SELECT item_id AS query_id, unnest({DOC_TERMS}) AS term FROM {queries}) GROUP BY ALL),
sc AS (SELECT query_id, {key}, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
              / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a))), 9) AS score
       FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN st WHERE ok GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM sc WHERE score > 0),
top AS (SELECT * FROM ranked WHERE rank <= 10)
"""


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select(*columns))


def chunk_texts(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return chunking.chunk_spans(documents(spark, sf, "doc_id", "text", *columns))


@query("chunk_documents", f"""WITH {CHUNKS}
SELECT {CHUNK_ID} AS chunk_id, doc_id, chunk_no, span_start, span_end, token_count, chunk_text FROM chunks""")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunk_texts(spark, sf)
    cid = chunking.chunk_id(F.col("doc_id"), F.col("span_start"), F.col("span_end"), chunking.ChunkConfig())
    return chunks.select(cid.alias("chunk_id"), "doc_id", "chunk_no", "span_start", "span_end", "token_count", "chunk_text")


@query("chunk_inventory", f"""WITH {CHUNKS},
a AS (SELECT source, lang, count(*) AS source_count FROM documents GROUP BY ALL),
b AS (SELECT source, lang, count(*) AS chunk_count, sum(token_count)::BIGINT AS chunk_tokens FROM chunks GROUP BY ALL)
SELECT source, lang, source_count, coalesce(chunk_count, 0) AS chunk_count, coalesce(chunk_tokens, 0) AS chunk_tokens
FROM a LEFT JOIN b USING (source, lang)""")
def chunk_inventory(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "lang")
    return chunking.chunk_inventory(docs, chunk_texts(spark, sf, "source", "lang"), ["source", "lang"])


@query("chunk_run_inventory", f"""WITH {CHUNKS}
SELECT 'all' AS profile_id, '1' AS profile_version,
 '{{"chunker_version":"word-span-v1","max_tokens":180,"normalization":"frozen-normalized-utf8","overlap":30,"tokenizer_version":"unicode-word-regex-v1"}}' AS config,
 count(*) FILTER (source IS DISTINCT FROM 'src0') AS document_count, count(*) FILTER (source = 'src0') AS definition_count,
 (SELECT count(*) FROM chunks) AS chunk_count, (SELECT sum(token_count)::BIGINT FROM chunks) AS chunk_tokens FROM documents""")
def chunk_run_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """The inventory of a run over all documents, those of one source counted as definitions."""
    kind = F.when(F.col("source") == "src0", "definition").otherwise("document")
    sources = table(spark, sf, "documents").select(kind.alias("kind"))
    return chunking.run_inventory(sources, chunk_texts(spark, sf), chunking.ChunkConfig(), profile_id="all", profile_version="1")


@query("chunk_clause_overlap", f"""WITH {CHUNKS},
l AS (SELECT doc_id, [{{
        'clause_id': doc_id || ':' || i,
        'a': length(array_to_string(string_split(text, chr(10))[1:i], chr(10))) + CASE WHEN i > 0 THEN 1 ELSE 0 END,
        'b': length(array_to_string(string_split(text, chr(10))[1:i + 1], chr(10)))}}
        FOR i IN range(0, len(string_split(text, chr(10))))] AS lines FROM documents)
SELECT doc_id, chunk_no, len(hit) AS clauses, array_to_string(list_sort([x.clause_id FOR x IN hit]), ',') AS clause_ids
FROM (SELECT c.doc_id, c.chunk_no, [x FOR x IN l.lines IF x.a < c.span_end AND x.b > c.span_start] AS hit
      FROM chunks c JOIN l ON l.doc_id = c.doc_id)""")
def chunk_clause_overlap(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "doc_id", "text").withColumn("_lines", F.split("text", "\n"))
    docs = docs.withColumn("_starts", tx.running_starts(F.col("_lines"), gap=1))
    clauses = F.transform("_lines", lambda line, i: F.struct(
        F.concat(F.col("doc_id"), F.lit(":"), i).alias("clause_id"), F.get("_starts", i).alias("span_start"),
        (F.get("_starts", i) + F.length(line)).alias("span_end")))
    chunks = chunking.chunk_spans(docs.select("doc_id", "text", clauses.alias("_clauses")), clauses="_clauses")
    return chunks.select("doc_id", "chunk_no", F.size("clause_ids").alias("clauses"), F.array_join("clause_ids", ",").alias("clause_ids"))


def _off(at: str) -> str:
    head = f"substring(text, 1, {at})"
    return f"CASE WHEN lang IN ('de', 'fr') THEN {at} + length({head}) - length(replace({head}, chr(10), '')) ELSE {at} END"


@query("raw_offset_map", f"""WITH {CHUNKS}
SELECT doc_id, chunk_no, lang, span_start, span_end, {_off('span_start')} AS raw_start, {_off('span_end')} AS raw_end FROM chunks""")
def raw_offset_map(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets in raw texts whose line ends were CRLF, here those in German and French."""
    crlf = F.col("lang").isin("de", "fr")
    return chunking.chunk_spans(documents(spark, sf, "doc_id", "text", "lang"), crlf=crlf).select(
        "doc_id", "chunk_no", "lang", "span_start", "span_end", "raw_start", "raw_end")


@query("construct_chunks", f"""WITH {CHUNKS}
SELECT {CHUNK_ID} AS chunk_id, CAST(doc_id AS VARCHAR) AS document_revision_id, source AS source_id, span_start AS normalized_start,
       span_end AS normalized_end, token_count, sha256(text) AS normalized_sha256, 'document_chunk' AS projection_kind,
       'documents/normalized/' || doc_id || '.md' AS source_locator FROM chunks""")
def construct_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with declared hashes checked, joined to nothing: the link is part of the same row."""
    docs = documents(spark, sf, "doc_id", "text", "source").select(
        F.lit("document").alias("kind"), F.col("source").alias("source_id"),
        F.col("doc_id").cast("string").alias("document_revision_id"), "text",
        F.sha2("text", 256).alias("normalized_sha256"), F.lit(None).cast("string").alias("raw_sha256"),
        F.lit(False).alias("crlf"),
        F.expr("cast(array() as array<struct<clause_id:string,span_start:int,span_end:int>>)").alias("clauses"))
    chunks = chunking.construct_chunks(docs, profile_id="all")
    return chunks.select(
        "chunk_id", "document_revision_id", "source_id", "normalized_start", "normalized_end", "token_count",
        "normalized_sha256", F.lit("document_chunk").alias("projection_kind"),
        F.concat(F.lit("documents/normalized/"), "document_revision_id", F.lit(".md")).alias("source_locator"))


@query("bm25_topk", f"WITH {bm25_sql('documents', 'doc_id')} SELECT query_id, doc_id, score, rank FROM top")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25_search(documents(spark, sf, "doc_id", "text"), table(spark, sf, "benchmark"),
                               key=["doc_id"], query_key="item_id")


@query("bm25_index_topk", f"""WITH {bm25_sql('documents', 'doc_id', "source IN ('src0', 'src3', 'src7')")}
SELECT query_id, doc_id, score, rank FROM top""")
def bm25_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Build an index once, store it, and search what was stored, limited to some sources."""
    path = scratch_path(spark, "index")
    lexical.write_index(documents(spark, sf, "doc_id", "text", "source"), path, key=["doc_id"], carry=["source"])
    return lexical.search_index(spark, path, table(spark, sf, "benchmark"), key=["doc_id"], query_key="item_id",
                                allowed=F.col("source").isin("src0", "src3", "src7"))


@query("bm25_chunk_topk", f"""WITH {CHUNKS},
cd AS (SELECT doc_id, chunk_no, chunk_text AS text FROM chunks),
{bm25_sql('cd', 'doc_id, chunk_no')} SELECT query_id, doc_id, chunk_no, score, rank FROM top""")
def bm25_chunk_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The retrieval path as a user runs it: chunk every document, then rank chunks."""
    chunks = chunk_texts(spark, sf).select("doc_id", "chunk_no", "chunk_text")
    return lexical.bm25_search(chunks, table(spark, sf, "benchmark"), key=["doc_id", "chunk_no"],
                               text="chunk_text", query_key="item_id")


@query("bm25_chunk_lineage", f"""WITH {CHUNKS},
cd AS (SELECT doc_id, chunk_no, chunk_text AS text FROM chunks),
{bm25_sql('cd', 'doc_id, chunk_no')},
r AS (SELECT query_id, doc_id, chunk_no, score, rank, source AS source_id, doc_id::VARCHAR AS document_revision_id, span_start, span_end, 'lexical' AS origin_stage
  FROM top JOIN chunks USING (doc_id, chunk_no))
SELECT * FROM r""")
def bm25_chunk_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """The best chunks of every query with where they come from."""
    chunks = chunk_texts(spark, sf, "source")
    found = lexical.bm25_search(chunks.select("doc_id", "chunk_no", "chunk_text"), table(spark, sf, "benchmark"), key=["doc_id", "chunk_no"],
                                text="chunk_text", query_key="item_id")
    placed = chunks.select("doc_id", "chunk_no", F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("document_revision_id"),
                           "span_start", "span_end")
    return lexical.with_lineage(found, placed, ["doc_id", "chunk_no"]).drop("row")


@query("bm25_allowed_sources", f"""WITH {bm25_sql('documents', 'doc_id', "source IN ('src0', 'src3', 'src7')")}
SELECT query_id, doc_id, score, rank FROM top""")
def bm25_allowed_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates limited to some sources; the statistics stay those of all documents."""
    docs = documents(spark, sf, "doc_id", "text", "source")
    return lexical.bm25_search(docs, table(spark, sf, "benchmark"), key=["doc_id"], query_key="item_id",
                               allowed=F.col("source").isin("src0", "src3", "src7"))


@query("term_statistics", f"""WITH t AS (SELECT doc_id, unnest({DOC_TERMS}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS doc_freq, count(*) AS coll_freq FROM t GROUP BY term""")
def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.term_statistics(documents(spark, sf, "text"), "text")


@query("term_frequencies", f"""WITH t AS (SELECT doc_id, unnest({DOC_TERMS}) AS term FROM documents)
SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL""")
def term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.term_frequencies(documents(spark, sf, "doc_id", "text"), ["doc_id"], "text")


@query("document_lengths", f"""SELECT doc_id, len({DOC_TERMS}) AS length FROM documents""")
def document_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.document_lengths(documents(spark, sf, "doc_id", "text"), ["doc_id"], "text")


@query("average_length", f"""SELECT count(*) AS n, round(coalesce(avg(len({DOC_TERMS})), 0), 9) AS avgdl FROM documents""")
def average_length(spark: SparkSession, sf: str) -> DataFrame:
    lengths = lexical.document_lengths(documents(spark, sf, "doc_id", "text"), ["doc_id"], "text")
    return lengths.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("length"), F.lit(0.0)), 9).alias("avgdl"))


@query("tokenize_documents", f"""SELECT doc_id, CAST(unnest(range(0, len(t))) AS INT) AS pos, unnest(t) AS term
FROM (SELECT doc_id, {DOC_TERMS} AS t FROM documents)""")
def tokenize_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "doc_id", "text")
    return docs.select("doc_id", F.posexplode_outer(tx.terms("text")).alias("pos", "term")).where("pos is not null")


@query("tokenize_conversations", f"""SELECT conv_id, turn, CAST(unnest(range(0, len(t))) AS INT) AS pos, unnest(t) AS term
FROM (SELECT conv_id, turn, {DOC_TERMS} AS t FROM conversations)""")
def tokenize_conversations(spark: SparkSession, sf: str) -> DataFrame:
    turns = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    return turns.select("conv_id", "turn", F.posexplode_outer(tx.terms("text")).alias("pos", "term")).where("pos is not null")


@query("profile_membership", """
WITH r AS (SELECT doc_id FROM labels WHERE quality = 1), s AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'document' AS kind, CAST(d.doc_id AS VARCHAR) AS source_id, sha256(d.text) AS content_sha256 FROM documents d
WHERE d.doc_id IN (SELECT doc_id FROM r) OR d.doc_id IN (SELECT doc_id FROM s)
UNION ALL SELECT 'definition', CAST(item_id AS VARCHAR), sha256(text) FROM benchmark""")
def profile_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Documents a profile names by snapshot or by revision, plus its definitions."""
    labels = table(spark, sf, "labels")
    revision = F.col("doc_id").cast("string")
    docs = table(spark, sf, "documents").select(
        revision.alias("snapshot_id"), revision.alias("document_revision_id"), "text")
    chosen = catalog.profile_members(
        docs, labels.where("quality = 1").select(revision.alias("snapshot_id")),
        labels.where("toxic = 1").select(revision.alias("document_revision_id")))
    definitions = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("definition_id"), "text", F.sha2("text", 256).alias("content_sha256"))
    merged = catalog.sources_of_profile(chosen, definitions)
    return merged.select("kind", "source_id", F.sha2("text", 256).alias("content_sha256"))


@query("catalog_last_wins", """
SELECT content_sha256, doc_id, source FROM (SELECT sha256(text) AS content_sha256, doc_id, source,
  row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC) AS n FROM documents) WHERE n = 1""")
def catalog_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog keyed by content: of several rows with one key the last counts."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    keyed = docs.select(F.sha2("text", 256).alias("content_sha256"), "doc_id", "source")
    return catalog.last_wins(keyed, ["content_sha256"], "doc_id")


@query("required_lookup", """
SELECT l.doc_id, l.quality, d.source, d.lang FROM labels l JOIN documents d USING (doc_id)""")
def required_lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return catalog.require(table(spark, sf, "labels").select("doc_id", "quality"), docs, ["doc_id"], "document")


@query("hybrid_union", """
WITH a AS (SELECT d.lang AS query_id, 'label:' || d.doc_id AS evidence_id, 0 AS side,
                  '{"lang":"' || lang || '","sha256":"' || sha256(text) || '"}' AS locator
           FROM documents d JOIN labels l USING (doc_id)),
b AS (SELECT lang, 'doc:' || doc_id, 1, '{"lang":"' || lang || '","sha256":"' || sha256(text) || '"}' FROM documents),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT query_id, evidence_id, locator FROM (SELECT *, row_number() OVER (PARTITION BY query_id, locator
  ORDER BY side, evidence_id) AS n FROM u) WHERE n = 1""")
def hybrid_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two candidate lists per query; copies of one locator keep the first only."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    locator = F.to_json(F.struct("lang", F.sha2("text", 256).alias("sha256")))
    keyed = docs.select("doc_id", F.col("lang").alias("query_id"), locator.alias("locator"))
    labelled = keyed.join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    name = lambda prefix: F.concat(F.lit(prefix), F.col("doc_id"))
    return evidence.hybrid_union(
        labelled.select("query_id", name("label:").alias("evidence_id"), "locator"),
        keyed.select("query_id", name("doc:").alias("evidence_id"), "locator"))


@query("pin_fallback", f"""
WITH {bm25_sql('documents', 'doc_id')},
pins AS (SELECT item_id AS query_id, doc_id AS source_id FROM benchmark JOIN documents ON item_id = doc_id)
SELECT query_id, doc_id AS source_id, score, rank, 'bm25' AS origin_stage FROM top
UNION ALL
SELECT query_id, source_id, 0.0, NULL, 'public_pin_fallback' FROM pins
WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.query_id = pins.query_id AND top.doc_id = pins.source_id)""")
def pin_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Every query pins one document, which stays even without lexical overlap."""
    ranked = bm25_topk(spark, sf).select("query_id", F.col("doc_id").alias("source_id"), "score", "rank",
                                         F.lit("bm25").alias("origin_stage"))
    pins = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")).join(
        table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("source_id")), "query_id")
    return evidence.pin_fallback(ranked, pins)


@query("archive_member_names", r"""
WITH n AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS name FROM pages),
p AS (SELECT page_id, name, [x FOR x IN string_split(replace(name, chr(92), '/'), '/') IF x NOT IN ('', '.')] AS parts FROM n)
SELECT page_id, NOT (name LIKE '/%' OR len(parts) = 0 OR list_contains(parts, '..') OR coalesce(parts[1] LIKE '%:', FALSE)) AS safe,
       list_extract(string_split(rtrim(name, '/'), '/'), -1) AS base_name FROM p""")
def archive_member_names(spark: SparkSession, sf: str) -> DataFrame:
    """Member-name rules applied to the paths of the crawled pages."""
    names = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("name"))
    return names.select("page_id", files.safe_member("name").alias("safe"), files.base_name("name").alias("base_name"))


@query("label_dispatch", """
SELECT doc_id, CASE WHEN contains(text, 'tion') THEN 'tion' WHEN contains(text, 'eaux') THEN 'eaux' WHEN contains(text, 'the') THEN 'the'
  WHEN contains(text, 'und') THEN 'und' END AS label FROM documents""")
def label_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """First matching label in a fixed order of priority."""
    return documents(spark, sf, "doc_id", "text").select("doc_id", tx.first_label("text", ("tion", "eaux", "the", "und")).alias("label"))
