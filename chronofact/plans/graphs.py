"""Graph projection of a ledger of customers, and the streaming ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import instants
from ..operators import graph, ledger, lexical
from ..operators.skew import slice_bounds
from ..session import scratch_path
from ..sources.tables import spread, table
from ..streaming import ingest, validate
from . import ledgers
from .registry import query
from .retrieval import TERMS
from .values import stable_sql

CENTS = "CAST(round(c_acctbal * 100) AS BIGINT)"

# Per customer one record: it is a member of a nation, has a segment, a
# balance, a share of a hundred as a fraction, and whether it is in debt.
EDGES = f"""
a AS (SELECT c_custkey, c_name, 0 AS pos, 'MEMBER_OF' AS predicate, 'entity_ref' AS ty, 'N' || c_nationkey AS v FROM customer
  UNION ALL SELECT c_custkey, c_name, 1, 'DRIVER_STATUS', 'enum', c_mktsegment FROM customer
  UNION ALL SELECT c_custkey, c_name, 2, 'REPORTED_MEASURE', 'integer', CAST({CENTS} AS VARCHAR) FROM customer
  UNION ALL SELECT c_custkey, c_name, 3, 'REPORTED_MEASURE', 'rational', {CENTS} || '/100' FROM customer
  UNION ALL SELECT c_custkey, c_name, 4, 'REPORTED_MEASURE', 'boolean', CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END FROM customer),
edges AS (SELECT 'r' || c_custkey AS record_id, c_custkey || ':' || pos AS assertion_id, pos, 'C' || c_custkey AS subject_id, predicate, ty AS object_type,
  CASE WHEN ty = 'entity_ref' THEN v ELSE 'value:' || c_custkey || ':' || pos END AS target_id,
  'DRIVER "' || c_name || '" [id=C' || c_custkey || '] ' || predicate || ' ' || CASE WHEN ty = 'entity_ref'
    THEN 'FLEET "' || n_name || '" [id=' || v || ']' ELSE predicate || ' = ' || v || ' [id=value:' || c_custkey || ':' || pos || ']' END AS fact
  FROM a LEFT JOIN nation ON ty = 'entity_ref' AND v = 'N' || n_nationkey)
"""


def customer_records(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")

    def assertion(pos: int, predicate: str, kind: str, value) -> F.Column:
        return F.struct(
            F.concat("c_custkey", F.lit(f":{pos}")).alias("assertion_id"), F.concat(F.lit("C"), "c_custkey").alias("subject_id"),
            F.lit(predicate).alias("predicate"), F.concat(F.lit('{"type":"%s","value":' % kind), value, F.lit("}")).alias("object"),
            F.lit("2024-01-01").cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
            F.lit(None).cast("timestamp_ntz").alias("event_time"))

    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    body = F.array(
        assertion(0, "MEMBER_OF", "entity_ref", F.concat(F.lit('"N'), F.col("c_nationkey"), F.lit('"'))),
        assertion(1, "DRIVER_STATUS", "enum", quoted(F.col("c_mktsegment"))),
        assertion(2, "REPORTED_MEASURE", "integer", cents.cast("string")),
        assertion(3, "REPORTED_MEASURE", "rational", F.concat(F.lit('{"n":'), cents, F.lit(',"d":100}'))),
        assertion(4, "REPORTED_MEASURE", "boolean", F.when(F.col("c_acctbal") < 0, "true").otherwise("false")))
    customers = spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"))
    return customers.select(
        F.concat(F.lit("r"), "c_custkey").alias("record_id"), F.lit("registry").alias("source_id"),
        F.lit("2024-01-02").cast("timestamp_ntz").alias("known_at"), F.col("c_custkey").alias("commit_seq"),
        F.lit("assert").alias("operation"), body.alias("assertions"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    drivers = table(spark, sf, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("entity_id"), F.lit("DRIVER").alias("entity_type"), F.col("c_name").alias("name"))
    fleets = table(spark, sf, "nation").select(
        F.concat(F.lit("N"), "n_nationkey").alias("entity_id"), F.lit("FLEET").alias("entity_type"), F.col("n_name").alias("name"))
    return drivers.unionByName(fleets)


def customer_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges(customer_records(spark, sf), entities(spark, sf))


@query("graph_edges", f"""WITH {EDGES} SELECT {stable_sql('edge', 'assertion_id')} AS edge_id, record_id, assertion_id, subject_id, predicate,
 target_id, object_type, fact FROM edges""")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return customer_edges(spark, sf).select(
        "edge_id", "record_id", "assertion_id", "subject_id", "predicate", "target_id", "object_type", "fact")


@query("graph_nodes", f"WITH {EDGES} SELECT subject_id AS node_id FROM edges UNION SELECT target_id FROM edges")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nodes(customer_edges(spark, sf))


@query("graph_episodes", f"""WITH {EDGES} SELECT record_id, count(*) AS assertion_count,
 'record_id=' || record_id || ' source_id=registry known_at=2024-01-02T00:00:00.000000Z operation=assert' || chr(10) ||
 string_agg('{graph.TRIPLE_LABEL}: ' || fact || '; {graph.PREDICATE_LABEL}: ' || predicate || '; valid: [2024-01-01T00:00:00.000000Z, {graph.UNBOUNDED_LABEL})',
   chr(10) ORDER BY pos) AS text FROM edges GROUP BY record_id""")
def graph_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.episodes(customer_records(spark, sf), customer_edges(spark, sf))


EVENT_RECORDS = ledgers.FAULTED.split("src AS (")[0].rstrip().rstrip(",").replace("CAST(json_extract(props, '$.k') AS INT) AS k", "-1 AS k")


@query("graph_event_episodes", f"""WITH {EVENT_RECORDS}
SELECT record_id, len(opened) AS assertion_count, 'record_id=' || record_id || ' source_id=' || source_id || ' known_at=' ||
 strftime(known_at, '%Y-%m-%dT%H:%M:%S.%fZ') || ' operation=' || operation || (CASE WHEN len(targets) > 0 THEN ' targets=' || array_to_string(targets, ',') ELSE '' END) ||
 (CASE WHEN len(opened) = 0 THEN '' ELSE chr(10) || '{graph.TRIPLE_LABEL}: ENTITY "' || ledger_id || '" [id=' || ledger_id || '] {ledgers.PREDICATE} {ledgers.PREDICATE} = ' ||
   CASE WHEN event_id % 11 = 0 THEN '?/100' ELSE CAST(round(e.value * 100) AS BIGINT)::VARCHAR END || ' [id=value:' || record_id || ']; {graph.PREDICATE_LABEL}: {ledgers.PREDICATE}; valid: ' ||
   strftime(known_at, '%Y-%m-%dT%H:%M:%S.%fZ') || '; sources: ' ||
   CASE WHEN event_id % 7 = 0 THEN '?[?]' WHEN event_id % 5 = 0 THEN 'events[' || record_id || ',?]' ELSE 'events[' || record_id || ',' || source_id || ']' END END) AS text
FROM r JOIN (SELECT event_id, value FROM events) e ON e.event_id = r.input_order""")
def graph_event_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """An episode for every record of the event ledger, retractions included, with targets and source references.

    Some sources, clauses and fractions lack a part, which must leave a gap and no more.
    """
    records = ledgers.ledger_records(spark, sf)
    at = F.col("input_order")
    clauses = F.when(at % 7 != 0, F.when(at % 5 == 0, F.array("record_id", F.lit(None).cast("string"))).otherwise(F.array("record_id", "source_id")))
    refs = F.array(F.struct(F.when(at % 7 != 0, "events").alias("document_revision_id"), clauses.alias("clause_ids")))
    cited = records.withColumn("assertions", F.transform("assertions", lambda a: a.withField("source_refs", refs).withField(
        "object", F.when(at % 11 == 0, F.lit('{"type":"rational","value":{"d":100}}')).otherwise(a["object"]))))
    return graph.episodes(cited, graph.edges(cited, entities(spark, sf)))


@query("graph_lineage", f"""WITH {EDGES} SELECT {stable_sql('edge', 'assertion_id')} AS edge_id, record_id, assertion_id,
 count(*) OVER (PARTITION BY record_id) AS assertion_count FROM edges""")
def graph_lineage(spark: SparkSession, sf: str) -> DataFrame:
    made = customer_edges(spark, sf)
    return graph.lineage(made, graph.episodes(customer_records(spark, sf), made))


@query("graph_query_text", """SELECT CAST(o_orderkey AS VARCHAR) AS query_id, 'Which fleet does the driver of order ' || o_orderkey || ' belong to?' || chr(10) ||
 'DRIVER "' || c_name || '" [id=C' || o_custkey || ']' || chr(10) || 'FLEET "' || n_name || '" [id=N' || n_nationkey || ']' || chr(10) || 'known_as_of=' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') || chr(10) ||
 'time_scope=current' || chr(10) || 'snapshot=' || o_orderpriority || chr(10) || 'snapshot=' || o_orderstatus AS text
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def graph_query_text(spark: SparkSession, sf: str) -> DataFrame:
    home = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    asked = table(spark, sf, "orders").join(home, "o_custkey").select(
        F.col("o_orderkey").cast("string").alias("query_id"),
        F.concat(F.lit("Which fleet does the driver of order "), "o_orderkey", F.lit(" belong to?")).alias("query"),
        F.array(F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("N"), "c_nationkey")).alias("entity_refs"),
        F.col("o_orderdate").alias("known_as_of"), F.lit("current").alias("time_scope"),
        F.array("o_orderpriority", "o_orderstatus").alias("snapshot_refs"))
    return graph.query_text(asked, entities(spark, sf))


@query("graph_edge_search", f"""WITH {EDGES},
d AS (SELECT assertion_id, {TERMS.format('fact')} AS t FROM edges),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
tf AS (SELECT assertion_id, l, term, count(*) AS tf FROM (SELECT assertion_id, len(t) AS l, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT s_suppkey AS query_id, unnest({TERMS.format("n_name || ' #' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')")}) AS term
   FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY ALL),
sc AS (SELECT query_id, assertion_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a))), 9) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY ALL)
SELECT query_id, assertion_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, assertion_id) AS rank FROM sc)
WHERE rank <= 5""")
def graph_edge_search(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed search over edge facts: one query per supplier, five edges each."""
    made = customer_edges(spark, sf).select("assertion_id", F.col("fact").alias("text"))
    asked = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.concat("n_name", F.lit(" #"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("text"))
    return lexical.bm25_search(made, asked, key=["assertion_id"], query_key="s_suppkey", top_k=5)


@query("graph_repeat_write", f"""WITH {EDGES} SELECT predicate, count(*) AS edges, count(DISTINCT assertion_id) AS distinct_edges FROM edges GROUP BY predicate""")
def graph_repeat_write(spark: SparkSession, sf: str) -> DataFrame:
    """A part of the edges is written, then all of them, then all again: each is stored once."""
    made = customer_edges(spark, sf).select("edge_id", "assertion_id", "predicate")
    path = scratch_path(spark, "edges")
    graph.append_new(path, made.where("predicate = 'MEMBER_OF'"), "edge_id")
    graph.append_new(path, made.unionByName(made), "edge_id")
    return graph.append_new(path, made, "edge_id").groupBy("predicate").agg(
        F.count("*").alias("edges"), F.countDistinct("assertion_id").alias("distinct_edges"))


@query("ledger_capabilities", """
WITH e AS (SELECT *, max(CASE WHEN event_type = 'error' THEN ts END) OVER b AS le,
  max(CASE WHEN event_type = 'purchase' THEN ts END) OVER b AS p, max(CASE WHEN event_type = 'signup' THEN ts END) OVER b AS s,
  max(CASE WHEN event_type = 'view' THEN ts END) OVER b AS v, max(CASE WHEN event_type = 'click' THEN ts END) OVER b AS c
  FROM events WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, CASE event_type WHEN 'purchase' THEN p WHEN 'signup' THEN s WHEN 'view' THEN v WHEN 'click' THEN c ELSE greatest(p, s, v, c) END AS prior FROM e),
r AS (SELECT CASE WHEN event_type = 'error' THEN 'retract' WHEN prior > coalesce(le, TIMESTAMP '1970-01-01') THEN 'replace' ELSE 'assert' END AS operation
  FROM a WHERE event_type <> 'error' OR prior > coalesce(le, TIMESTAMP '1970-01-01'))
SELECT operation, count(*) AS records, CAST(sum(CASE WHEN operation = 'retract' THEN 0 ELSE 1 END) AS BIGINT) AS point_assertions FROM r GROUP BY operation""")
def ledger_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Records per operation and the point assertions they carry."""
    return ledgers.ledger_records(spark, sf).groupBy("operation").agg(
        F.count("*").alias("records"), F.sum(F.size("assertions")).alias("point_assertions"))


@query("ingest_resume", """WITH k AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
e AS (SELECT event_id AS position, CAST(event_id AS VARCHAR) AS name FROM k WHERE k <> 3),
d AS (SELECT event_id AS position, CASE WHEN event_type = 'error' THEN 'x' || event_id ELSE CAST(event_id AS VARCHAR) END AS name FROM k
      WHERE event_type <> 'signup' AND event_id <= (SELECT 0.9 * max(event_id) FROM events)
      UNION ALL SELECT event_id, CAST(event_id AS VARCHAR) FROM k WHERE event_type = 'view' AND k = 1 AND event_id <= (SELECT 0.9 * max(event_id) FROM events)),
g AS (SELECT position, min(name) AS done_name, count(*) AS n FROM d GROUP BY position)
SELECT position, done_name, expected_name, problem FROM (SELECT coalesce(g.position, e.position) AS position, done_name, e.name AS expected_name,
  CASE WHEN n > 1 THEN 'repeated' WHEN n IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unexpected' WHEN done_name <> e.name THEN 'changed' END AS problem
  FROM g FULL JOIN e ON g.position = e.position WHERE g.position IS NOT NULL OR e.position <= (SELECT max(position) FROM d)) WHERE problem IS NOT NULL""")
def ingest_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Where an ingested sequence, broken off, with gaps, changes and repeats, departs from the expected one."""
    name, k = F.col("event_id").cast("string"), F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf, "events").select(F.col("event_id").alias("position"), name.alias("name"), "event_type", k.alias("k"))
    reached = 0.9 * rows.agg(F.max("position")).first()[0]
    changed = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), "name")).otherwise(F.col("name"))
    some = rows.where("event_type <> 'signup'").withColumn("name", changed).unionByName(rows.where("event_type = 'view' and k = 1"))
    return graph.resume_violations(some.where(F.col("position") <= reached), rows.where("k <> 3"))


@query("stream_ledger_ingest", f"""WITH {ledgers.VIEW}
SELECT assertion_id, logical_fact_id, source_id, object, strftime(known_from, '%Y-%m-%dT%H:%M:%S.%fZ') AS known_from,
       strftime(known_to, '%Y-%m-%dT%H:%M:%S.%fZ') AS known_to FROM v""")
def stream_ledger_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Events arrive as a file stream, are stored once, and the view is read from what was stored."""
    schema = table(spark, sf, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stored = scratch_path(spark, "ingest")
    ingest.append(arriving, f"{stored}/records", f"{stored}/checkpoint").awaitTermination()
    once = ingest.stored_once(spark.read.schema(schema).parquet(f"{stored}/records"), "event_id")
    records = ledgers.event_records(once, slice_bounds(once, "ts", keys=["user_id"])).drop("user_id", "props", "prev", "ts")
    return ledger.as_of_view(records, ledgers.as_of()).select(
        "assertion_id", "logical_fact_id", "source_id", F.col("assertion.object").alias("object"),
        instants.utc_text("known_from").alias("known_from"), instants.utc_text("known_to").alias("known_to"))


@query("stream_validation", f"""WITH {ledgers.FAULTED}
, firsts AS (SELECT *, row_number() OVER (PARTITION BY input_order, pos, least(c, 2) ORDER BY c) AS nth FROM found)
SELECT violation, count(*) AS n, count(DISTINCT ledger_id) AS ledgers FROM firsts WHERE nth = 1 GROUP BY violation""")
def stream_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Records arrive in three parts, each read by a query that starts anew from the state of the one before it."""
    events = table(spark, sf, "events")
    bounds = slice_bounds(events, "ts", keys=["user_id"])
    records = ledgers.faulted_records(events, bounds)
    arriving, found, checkpoint, whole = (scratch_path(spark, f"validate-{name}") for name in ("in", "out", "state", "all"))
    records.write.parquet(whole)
    stored = spark.read.parquet(whole)
    at = F.unix_micros(F.col("known_at").cast("timestamp"))
    third, more = stored.select(at.cast("double").alias("t")).approxQuantile("t", [1 / 3, 2 / 3], 0.01)
    for low, high in ((None, third), (third, more), (more, None)):
        part = stored if low is None else stored.where(at > low)
        (part if high is None else part.where(at <= high)).write.mode("append").parquet(arriving)
        validate.report(spark.readStream.schema(stored.schema).parquet(arriving), ledgers.sources(spark), found, checkpoint).awaitTermination()
    return spark.read.parquet(found).groupBy("violation").agg(F.count("*").alias("n"), F.countDistinct("ledger_id").alias("ledgers"))
