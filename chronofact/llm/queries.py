"""Registered queries of the pipeline operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.registry import Query
from ..sources.tables import table
from . import bpe, caps, dialogue, html_main_text, jaccard, licenses, mixing, piece_codec, quality, sharding, token_counts, toxicity, whitening
from .columns import words
from .near import stored

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WS = r"\x20\x09-\x0D"
WORDS = rf"regexp_extract_all(coalesce(text, ''), '[^{WS}]+')"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_html_main_text")
def op1_html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return html_main_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return toxicity.detect(docs, labels).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf, "documents").select("doc_id", "text"))


def mix_sql() -> str:
    """The contract of the mix, with plain running sums."""
    return rf"""
d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '|' || len({WORDS}) || '|' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
        2.0::DOUBLE * source_size AS cap FROM s),
k AS (SELECT a.source, (1.5::DOUBLE * (SELECT sum(source_size) FROM w)
          - coalesce((SELECT sum(b.cap) FROM w b WHERE b.cap / b.w < a.cap / a.w), 0))
        / (SELECT sum(b.w) FROM w b WHERE b.cap / b.w >= a.cap / a.w) AS level, a.cap / a.w AS full_at FROM w a),
l AS (SELECT w.*, (SELECT max(level) FROM k WHERE level <= full_at) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS whole,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(least(size, whole - c), 0) + greatest(least(size, whole - c - source_size), 0))::BIGINT AS taken FROM p"""


@query("op4_mixing", "WITH " + mix_sql())
def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in training order with the words that the mix takes of each."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    # the texts are read once: what follows needs their sizes and digests only
    narrow = stored(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("n"),
                                F.md5(F.coalesce("text", F.lit(""))).alias("content")), "mixing-sizes")
    mixed = mixing.mix(narrow, F.col("n"), content=F.col("content"), rows=narrow.count())
    return mixing.in_training_order(mixed).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs)
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens", "over_limit")


@query("op6_bpe_codec")
def op6_bpe_codec(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.round_trip(docs).select("doc_id", "n_tokens", F.sha2("packed_ids", 256).alias("ids_sha256"),
                                       F.sha2("decoded", 256).alias("decoded_sha256"))


QUALITY_CTE = rf"""
q_base AS (SELECT doc_id, coalesce(text, '') AS _text, {WORDS} AS ws,
    regexp_replace(coalesce(text, ''), '[{WS}]', '', 'g') AS solid FROM documents),
q_win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM q_base, unnest(range(1, len(ws) - 1)) AS u(i)),
q_rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i FROM q_win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
    unnest([0, 1, 2]) AS t(o) GROUP BY doc_id),
q_lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(_text, chr(10))) AS line FROM q_base)
    WHERE regexp_matches(line, '[^{WS}]') GROUP BY doc_id),
q_counts AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(solid)::BIGINT AS word_chars,
    (length(_text) - length(regexp_replace(_text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines,
    len(list_filter(ws, lambda w: regexp_matches(w, '\p{{L}}'))) AS n_lettered
    FROM q_base LEFT JOIN q_rep r USING (doc_id) LEFT JOIN q_lines l USING (doc_id)),
q_failed AS (SELECT *, {" OR ".join(r.sql for r in quality.BASE)} AS base_failed FROM q_counts),
q_kept AS (SELECT * EXCLUDE (n_lines, n_lettered), NOT (base_failed OR ({") OR (".join(r.sql for r in quality.RULES)})) AS kept FROM q_failed)"""


@query("op8_quality_rules", f"WITH {QUALITY_CTE} SELECT * FROM q_kept")
def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_ngram_jaccard", rf"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
      FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id
      JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 10 * count(*) >= 8 * (x.n + y.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c),
k AS (SELECT a AS doc_id, count(*) AS n FROM l GROUP BY a)
SELECT doc_id, min(c) AS class_id, coalesce(any_value(k.n), 0) AS n_links, doc_id = min(c) AS kept
FROM r LEFT JOIN k USING (doc_id) GROUP BY doc_id""")
def op7_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of near copies with the number of links of each document, copies included."""
    return jaccard.near_copies(table(spark, sf, "documents").select("doc_id", "text"))


@query("op9_embedding_near_dedup", f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= {caps.COSINE}),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(any_value(k.n), 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept
FROM r LEFT JOIN k USING (vec_id) GROUP BY vec_id""")
def op9_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return caps.near_embeddings(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"))


def shard_sql() -> str:
    """Placement looked up in the table, given as four hexadecimal digits a slot."""
    digits = sharding.packed(sharding.lookup_table(SHARDS)).hex()
    return f"""WITH p AS (SELECT doc_id, (('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT % {sharding.SLOTS})::INT AS slot FROM documents)
SELECT doc_id, slot, ('0x' || substring('{digits}', slot * 4 + 1, 4))::INT AS shard FROM p"""


@query("op10_sharding", shard_sql())
def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(table(spark, sf, "documents").select("doc_id"), "doc_id", SHARDS)


@query("op11_piece_codec")
def op11_piece_codec(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return piece_codec.round_trip(docs).select("doc_id", "n_tokens", F.sha2("packed_ids", 256).alias("ids_sha256"),
                                               F.sha2("decoded", 256).alias("decoded_sha256"))


def repair_sql() -> str:
    """Edits as a recursion over the rows of a conversation and the four states of the role pattern."""
    table = []
    for byte in range(256):  # the checksum's table, from its polynomial
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    shifts = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    inserts = [(q, q, "") for q in range(4)] + [(0, 2, "I"), (1, 2, "I"), (2, 3, "I"), (3, 2, "I"), (0, 3, "II"), (1, 3, "II")]
    moves = [f"({q}, 'D', '', {5 * len(i) + 2}, '{i}D', {at})" for q, at, i in inserts]
    moves += [f"({q}, 'K', '{x}', {5 * len(i)}, '{i}K', {to})" for q, at, i in inserts for (base, x), to in shifts.items() if base == at]
    moves += [f"({q}, 'R', '', {5 * len(i) + 1}, '{i}R', {to})" for q, at, i in inserts for (base, x), to in shifts.items() if base == at and x != "s"]
    return f"""WITH RECURSIVE
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes,
    {table}::BIGINT[] AS crc FROM conversations),
k AS (SELECT * EXCLUDE (bytes, crc), xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS solid FROM d),
o AS (SELECT conv_id, turn, role, text, role[1] AS initial,
    CASE WHEN solid = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN solid[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    row_number() OVER w AS i, lag(role[1]) OVER w || role[1] AS pair FROM n
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
a AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'b')::BIGINT AS blank,
    count_if(fault = 'd')::BIGINT AS duplicate, count_if(fault = 't')::BIGINT AS truncated,
    count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(*) AS n FROM o GROUP BY conv_id),
m(q, edit, initial, weight, letters, q2) AS (VALUES {", ".join(moves)}),
p AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, '000000000' AS w FROM a
    UNION ALL SELECT conv_id, i, q2, min(w) FROM (SELECT p.conv_id, o.i, m.q2, lpad((left(w, 9)::BIGINT + m.weight
        + CASE WHEN fault = 't' AND edit <> 'D' THEN 5 ELSE 0 END)::VARCHAR, 9, '0') || substr(w, 10) || letters AS w
      FROM p JOIN o ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.i = p.i + 1 JOIN m ON m.q = p.q
        AND (edit = 'D' OR (fault NOT IN ('b', 'd') AND (edit = 'R' OR m.initial = o.initial)))) GROUP BY conv_id, i, q2),
e AS (SELECT a.conv_id, min(lpad((left(w, 9)::BIGINT + z.weight)::VARCHAR, 9, '0') || substr(w, 10) || z.letters) AS w
    FROM a JOIN p ON p.conv_id IS NOT DISTINCT FROM a.conv_id AND p.i = a.n
    JOIN (VALUES (0, 0, ''), (3, 0, ''), (2, 5, 'I'), (1, 10, 'II')) AS z(q, weight, letters) ON z.q = p.q GROUP BY a.conv_id),
l AS (SELECT conv_id, k, substr(w, 9 + k, 1) AS edit FROM e, unnest(range(1, len(w) - 8)) AS u(k)),
g AS (SELECT *, count_if(edit <> 'I') OVER s AS i, count_if(edit <> 'D') OVER s AS place FROM l WINDOW s AS (PARTITION BY conv_id ORDER BY k)),
h AS (SELECT g.*, o.role, o.text, max(CASE WHEN place = 1 AND edit = 'K' AND o.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g.conv_id) AS led
    FROM g LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM g.conv_id AND o.i = g.i AND edit <> 'I'),
r AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS sha FROM h WHERE edit <> 'D' GROUP BY conv_id)
SELECT t.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(w, 9)::BIGINT, 0) AS cost,
  coalesce(substr(w, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) t LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id"""


@query("op13_dialogue_repair", repair_sql())
def op13_dialogue_repair(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return dialogue.summarise(dialogue.damage(turns), times=F.col("times"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
