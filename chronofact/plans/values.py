"""Identifiers, hashes, exact arithmetic, policies and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import exact, identity, instants
from ..operators import closed_schema, inventory, manifest, policy
from ..sources.tables import spread, table
from .registry import query

CENTS = "CAST(round({0} * 100) AS BIGINT)"
cents = lambda c: F.round(F.col(c) * 100).cast("bigint")

UUID5 = """lower(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' ||
 substr('89ab', CAST(('0x' || substr({h}, 17, 1))::INT % 4 AS INT) + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"""
NAMESPACE_HEX = identity.NAMESPACE.replace("-", "")


def stable_sql(object_type: str, key: str) -> str:
    return UUID5.format(h=f"sha1(unhex('{NAMESPACE_HEX}') || encode('{object_type}:' || {key}))")


ORDER_JSON = f"""'{{"cents":' || {CENTS.format('o_totalprice')} || ',"custkey":' || o_custkey || ',"date":"' ||
 strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') || '","orderkey":' || o_orderkey || ',"priority":"' || o_orderpriority ||
 '","status":"' || o_orderstatus || '"}}'"""


def order_json():
    return identity.canonical_row({
        "orderkey": F.col("o_orderkey"), "custkey": F.col("o_custkey"), "status": F.col("o_orderstatus"),
        "cents": cents("o_totalprice"), "date": instants.utc_text("o_orderdate"), "priority": F.col("o_orderpriority")})


@query("canonical_row_hash", f"""SELECT o_orderkey, sha256({ORDER_JSON} || chr(10)) AS content_sha256, sha256({ORDER_JSON}) AS identity_sha256 FROM orders""")
def canonical_row_hash(spark: SparkSession, sf: str) -> DataFrame:
    js = order_json()
    return table(spark, sf, "orders").select(
        "o_orderkey", identity.content_hash(js).alias("content_sha256"), identity.identity_hash(js).alias("identity_sha256"))


@query("canonical_json_text", """SELECT event_id, '{"k":' || json_extract(props, '$.k') || '}' AS canonical FROM events""")
def canonical_json_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", identity.canonical_text("props").alias("canonical"))


@query("stable_ids", f"SELECT c_custkey, {stable_sql('customer', 'c_custkey')} AS stable_id FROM customer")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", identity.stable_id("customer", "c_custkey").alias("stable_id"))


@query("component_seeds", """
SELECT s_suppkey, CAST(CAST('0x' || substr(sha256('42|suppliers|' || s_suppkey), 1, 16) AS UBIGINT) AS DECIMAL(20, 0)) AS seed FROM supplier""")
def component_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", identity.component_seed("suppliers", "s_suppkey").alias("seed"))


@query("utc_instants", """SELECT event_id, strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%S.%fZ') AS utc FROM events""")
def utc_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Local times that carry the offset +07:00, as canonical UTC text."""
    local = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+07:00"))
    return table(spark, sf, "events").select("event_id", instants.utc(local).alias("utc"))


@query("rational_normalize", f"""
SELECT l_orderkey, l_linenumber, x // g AS n, q // g AS d FROM (SELECT *, gcd(x, q) AS g FROM
  (SELECT l_orderkey, l_linenumber, {CENTS.format('l_extendedprice')} AS x, CAST(l_quantity AS BIGINT) AS q FROM lineitem))""")
def rational_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Exact unit price of every line in lowest terms."""
    price = exact.rational(cents("l_extendedprice"), F.col("l_quantity").cast("bigint"))
    lines = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"))
    return lines.select("l_orderkey", "l_linenumber", price.alias("r")).select(
        "l_orderkey", "l_linenumber", "r.n", "r.d")


@query("cancel_rate", """
SELECT c_custkey, cancelled, completed, CASE WHEN cancelled + completed > 0 THEN cancelled // gcd(cancelled, cancelled + completed) END AS n,
  CASE WHEN cancelled + completed > 0 THEN (cancelled + completed) // gcd(cancelled, cancelled + completed) END AS d
FROM (SELECT c_custkey, count(*) FILTER (o_orderstatus = 'F') AS cancelled, count(*) FILTER (o_orderstatus = 'O') AS completed
      FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)""")
def cancel_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Exact cancel rate per customer; undefined where nothing finished."""
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("cancelled"), F.count_if(F.col("o_orderstatus") == "O").alias("completed"))
    zero = F.lit(0).cast("bigint")
    rows = table(spark, sf, "customer").select("c_custkey").join(counts, "c_custkey", "left").select(
        "c_custkey", F.coalesce("cancelled", zero).alias("cancelled"), F.coalesce("completed", zero).alias("completed"))
    return rows.withColumn("r", exact.cancel_rate("cancelled", "completed")).select(
        "c_custkey", "cancelled", "completed", "r.n", "r.d")


@query("revenue_charge", """
SELECT o_custkey, o_orderdate, revenue, greatest(280000 - revenue, 0) // 5 AS charge
FROM (SELECT o_custkey, o_orderdate, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS revenue FROM orders GROUP BY ALL)""")
def revenue_charge(spark: SparkSession, sf: str) -> DataFrame:
    """Charge on the daily revenue of each customer."""
    daily = table(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(
        F.sum(F.round("o_totalprice").cast("bigint")).alias("revenue"))
    return daily.withColumn("charge", exact.revenue_charge("revenue"))


@query("rating_and_acceptance", """
WITH a AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'bike_partner' ELSE 'taxi_driver' END AS program,
  count(*) FILTER (o_orderstatus = 'O') AS acc, count(*) AS n, sum(6 - CAST(o_orderpriority[1] AS INT))::BIGINT AS stars
  FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT c_custkey, program, acc // gcd(acc, n) AS acc_n, n // gcd(acc, n) AS acc_d, stars // gcd(stars, n) AS rating_n, n // gcd(stars, n) AS rating_d,
  program = 'bike_partner' AND 2 * acc < n AS auto_accept, 20 * stars > 97 * n AS rating_met FROM a""")
def rating_and_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    """Acceptance and mean rating per customer as exact fractions, against fixed thresholds."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("acc"), F.count("*").alias("n"),
        F.sum(F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("stars"))
    program = F.when(F.col("c_mktsegment") == "MACHINERY", exact.ACCEPT_PROGRAM).otherwise("taxi_driver")
    rows = table(spark, sf, "customer").select("c_custkey", program.alias("program")).join(orders, "c_custkey").select(
        "c_custkey", "program", exact.rational("acc", "n").alias("a"), exact.rational("stars", "n").alias("r"))
    return rows.select(
        "c_custkey", "program", F.col("a.n").alias("acc_n"), F.col("a.d").alias("acc_d"), F.col("r.n").alias("rating_n"),
        F.col("r.d").alias("rating_d"), exact.auto_accept("program", F.col("a")).alias("auto_accept"),
        exact.rating_condition(F.col("r")).alias("rating_met"))


TREE_LEVELS = ", ".join(
    f"b{i} AS (SELECT block // 1024 AS block, sha256(string_agg(digest, '' ORDER BY block)) AS digest, CAST(sum(entries) AS BIGINT) AS entries "
    f"FROM b{i - 1} GROUP BY block // 1024)" for i in range(2, 8))
BLOCKS = f"""b1 AS (SELECT block, sha256(string_agg(h, '' ORDER BY o_orderkey)) AS digest, count(*) AS entries FROM (
  SELECT o_orderkey // 1024 AS block, o_orderkey, sha256({ORDER_JSON} || chr(10)) AS h FROM orders) GROUP BY block)"""


@query("keyed_digest", """WITH l4 AS (SELECT sha256(c_name) AS k, sha256('{"id":' || c_custkey || ',"name":"' || c_name || '"}' || chr(10)) AS h FROM customer),
d4 AS (SELECT substr(k, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY k)) AS d, count(*) AS n FROM l4 GROUP BY 1),
d3 AS (SELECT substr(p, 1, 3) AS p, sha256(string_agg(d, '' ORDER BY p)) AS d, sum(n) AS n FROM d4 GROUP BY substr(p, 1, 3)),
d2 AS (SELECT substr(p, 1, 2) AS p, sha256(string_agg(d, '' ORDER BY p)) AS d, sum(n) AS n FROM d3 GROUP BY substr(p, 1, 2)),
d1 AS (SELECT substr(p, 1, 1) AS p, sha256(string_agg(d, '' ORDER BY p)) AS d, sum(n) AS n FROM d2 GROUP BY substr(p, 1, 1))
SELECT sha256(string_agg(d, '' ORDER BY p)) AS digest, CAST(sum(n) AS BIGINT) AS rows FROM d1""")
def keyed_digest(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of a table whose key is text."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return inventory.keyed_tree_digest(customers, "c_name", identity.canonical_row({"id": F.col("c_custkey"), "name": F.col("c_name")}))


@query("block_digests", f"WITH {BLOCKS} SELECT block, digest, entries FROM b1")
def block_digests(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.block_digests(table(spark, sf, "orders"), "o_orderkey", order_json())


@query("logical_digest", f"WITH {BLOCKS}, {TREE_LEVELS} SELECT digest, entries AS rows FROM b7")
def logical_digest(spark: SparkSession, sf: str) -> DataFrame:
    """One digest of the whole orders table, computed as a tree."""
    return inventory.tree_digest(table(spark, sf, "orders"), "o_orderkey", order_json()).select("digest", "rows")


def policy_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier issues a policy; the rule kind depends on its balance."""
    key = F.concat(F.lit("S"), F.col("s_suppkey"))
    kind = F.when(F.col("s_acctbal") > 5000, policy.FLEET_RULE).otherwise(policy.REGION_RULE)
    return table(spark, sf, "supplier").select(
        "s_suppkey", identity.stable_id("policy_version", key).alias("policy_version_id"), kind.alias("rule_kind"),
        identity.stable_id("region", "s_nationkey").alias("required_region_id"),
        F.lit("2026-09-15T17:00:00.000000Z").alias("evaluation_time"))


@query("policy_rule_rows", f"""SELECT s_suppkey, key AS policy_key, version, {stable_sql('rule', "key || ':' || version")} AS rule_id,
  {stable_sql('policy_version', "key || ':' || version")} AS policy_version_id, CASE WHEN s_acctbal > 5000 THEN '{policy.FLEET_RULE}' ELSE '{policy.REGION_RULE}' END AS rule_kind,
  {stable_sql('region', 's_nationkey')} AS required_region_id, CASE WHEN s_acctbal > 5000 THEN '2026-09-15T17:00:00.000000Z' END AS evaluation_time
FROM (SELECT *, 'S' || s_suppkey AS key, unnest(['v1', 'v2']) AS version FROM supplier)""")
def policy_rule_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of every supplier's policy as rule rows; only rules about incidents have an instant."""
    fleet = F.col("s_acctbal") > 5000
    issued = table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("S"), "s_suppkey").alias("policy_key"), F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("version"),
        F.when(fleet, policy.FLEET_RULE).otherwise(policy.REGION_RULE).alias("rule_kind"), identity.stable_id("region", "s_nationkey").alias("required_region_id"),
        F.when(fleet, "2026-09-15T17:00:00.000000Z").alias("evaluation_time"))
    return policy.rule_rows(issued)


def _sql_body(template: str) -> str:
    body = template.replace("'", "''").replace("{region}", "' || region || '").replace("{time}", "2026-09-15T17:00:00.000000Z")
    return f"'{body}'"


POLICY = f"""
rules AS (SELECT s_suppkey, {stable_sql('policy_version', "'S' || s_suppkey")} AS version, s_acctbal > 5000 AS fleet,
                 {stable_sql('region', 's_nationkey')} AS region FROM supplier),
bodies AS (SELECT *, '# Synthetic control policy ' || version || chr(10) || chr(10) AS head,
  CASE WHEN fleet THEN {_sql_body(policy.SCOPE_BODY)} ELSE {_sql_body(policy.REGION_BODY)} END AS b1,
  CASE WHEN fleet THEN {_sql_body(policy.EXCEPTION_BODY)} END AS b2 FROM rules),
clauses AS (SELECT s_suppkey, 1 AS ord, CASE WHEN fleet THEN 'scope' ELSE 'region' END AS section, b1 AS body, length(head) AS a, version FROM bodies
  UNION ALL SELECT s_suppkey, 2, 'exception', b2, length(head) + length(b1) + 1, version FROM bodies WHERE fleet)
"""


@query("policy_text", f"WITH {POLICY} SELECT s_suppkey, head || b1 || chr(10) || coalesce(b2 || chr(10), '') AS text FROM bodies")
def policy_text(spark: SparkSession, sf: str) -> DataFrame:
    return policy.render(policy_rules(spark, sf)).select("s_suppkey", "text")


@query("policy_clauses", f"""WITH {POLICY} SELECT s_suppkey, ord AS "order", section AS section_id, {stable_sql('policy_clause', "version || ':' || section")} AS clause_id,
 a AS span_start, a + length(body) AS span_end, sha256('"' || body || '"' || chr(10)) AS content_sha256 FROM clauses""")
def policy_clauses(spark: SparkSession, sf: str) -> DataFrame:
    rendered = policy.render(policy_rules(spark, sf))
    return rendered.select("s_suppkey", F.explode("clauses").alias("c")).select(
        "s_suppkey", "c.order", "c.section_id", "c.clause_id", "c.span_start", "c.span_end", "c.content_sha256")


@query("policy_verification", "SELECT s_acctbal > 5000 AS fleet, count(*) AS rendered, count(*) FILTER (s_suppkey % 5 = 0) AS broken FROM supplier GROUP BY ALL")
def policy_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Re-slices and re-hashes every clause; every fifth text has been changed in one character."""
    rendered = policy.render(policy_rules(spark, sf))
    changed = F.concat(F.left("text", F.length("text") - 3), F.lit("~"), F.right("text", F.lit(2)))
    rendered = rendered.withColumn("text", F.when(F.col("s_suppkey") % 5 == 0, changed).otherwise(F.col("text")))
    broken = policy.render_violations(rendered).groupBy("rule_kind").agg(F.count("*").alias("b"))
    return rendered.groupBy("rule_kind").agg(F.count("*").alias("rendered")).join(broken, "rule_kind", "left").select(
        (F.col("rule_kind") == policy.FLEET_RULE).alias("fleet"), "rendered", F.coalesce("b", F.lit(0).cast("bigint")).alias("broken"))


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Scenario manifests derived from orders; the values break rules here and there."""
    key = F.col("o_orderkey")
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    final = F.col("o_orderstatus") == "F"
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return spread(orders).select(
        text("S", key).alias("scenario_id"),
        F.when(F.col("o_totalprice") > 400000, "source_conflict").when(F.col("o_totalprice") > 300000, "observation_mask")
        .when(F.col("o_totalprice") > 250000, "retraction_branch").when(F.col("o_totalprice") < 5000, "rewrite").otherwise("base").alias("mutation_type"),
        F.when(F.col("o_orderstatus") == "P", text("P", F.col("o_custkey"))).alias("parent_variant_id"),
        F.when(F.col("o_totalprice") > 400000, F.concat(F.lit('{"logical_fact_id":"f","removed_record_ids":[],"added_record_ids":["'), key, F.lit('"],"invariant_refs":["i"]}')))
        .when(F.col("o_totalprice") > 300000, F.concat(F.lit('{"seed_record_ids":["'), key, F.lit('"],"removed_record_ids":["r"],"closure_policy":"'),
              F.when(low, "keep").otherwise("remove_dependents"), F.lit('","invariant_refs":["i"]}')))
        .when(F.col("o_totalprice") > 250000, F.lit('{"target_assertion_ids":[],"removed_record_ids":[],"added_record_ids":["a"],"invariant_refs":["i"]}'))
        .otherwise(F.lit("{}")).alias("mutation_spec"),
        F.when(low, "free_text").otherwise("source_grounded").alias("gold_track"),
        F.when(~urgent, "T02").alias("task_id"), F.when(urgent | final, "state").alias("foundation_task"),
        F.array(F.lit("snap")).alias("public_snapshot_refs"),
        F.array(text("", F.col("o_custkey")), text("", key)).alias("semantic_case_ids"),
        F.when(final, F.array(F.lit("q1"), F.lit("q1"))).otherwise(F.array(F.lit("q1"))).alias("query_ids"), F.lit(42).alias("seed"))


@query("manifest_violations", """
WITH m AS (SELECT 'S' || o_orderkey AS scenario_id, o_totalprice AS p, o_orderstatus = 'P' AS parent, o_orderpriority = '1-URGENT' AS urgent,
   o_orderpriority = '5-LOW' AS low, o_orderstatus = 'F' AS final, CAST(o_custkey AS VARCHAR) AS c1, CAST(o_orderkey AS VARCHAR) AS c2,
   NOT (o_totalprice < 5000 OR o_totalprice > 250000) AS base FROM orders)
SELECT scenario_id, 'unknown mutation type' AS violation FROM m WHERE p < 5000
UNION ALL SELECT scenario_id, 'unknown gold track' FROM m WHERE low
UNION ALL SELECT scenario_id, 'neither one task nor one foundation task' FROM m WHERE NOT urgent AND final
UNION ALL SELECT scenario_id, 'a base has a parent or a mutation' FROM m WHERE base AND parent
UNION ALL SELECT scenario_id, 'a mutation without a parent' FROM m WHERE NOT base AND NOT parent
UNION ALL SELECT scenario_id, 'mutation details do not fit the type' FROM m WHERE (p > 250000 AND p <= 300000) OR (p > 300000 AND p <= 400000 AND low)
UNION ALL SELECT scenario_id, 'semantic_case_ids is not sorted without repeats' FROM m WHERE c1 >= c2
UNION ALL SELECT scenario_id, 'query_ids is not sorted without repeats' FROM m WHERE final""")
def manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.violations(manifests(spark, sf))


@query("unknown_manifest_keys", """SELECT event_id, unnest(CASE event_type WHEN 'click' THEN [] WHEN 'view' THEN ['w', 'x'] ELSE ['k'] END) AS unknown_key FROM events""")
def unknown_manifest_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that a closed schema of ``v`` and ``n`` does not allow: none, two or one by event type."""
    kind = F.col("event_type")
    json = F.when(kind == "click", '{"n":1,"v":{"k":2}}').when(kind == "view", '{"w":[],"n":null,"x":{"n":1}}').otherwise(F.col("props"))
    lines = table(spark, sf, "events").select("event_id", json.alias("line"))
    return manifest.unknown_keys(lines, ["v", "n"], json="line", keep=["event_id"])


def manifest_text(changes: dict[str, str]) -> str:
    """A sound manifest as JSON text with some members replaced, or left out where the change is empty."""
    sound = {
        "schema_version": '"1.1"', "release_spec_version": '"0.2.0"', "dataset_version": '"orders-1"', "world_id": '"w"', "scenario_id": '"s"',
        "scenario_variant_id": '"v"', "parent_variant_id": "null", "mutation_type": '"base"', "mutation_spec": "{}", "ledger_id": '"l"', "scope_id": '"c"',
        "gold_track": '"source_grounded"', "task_id": '"T02"', "foundation_task": "null", "policy_snapshot_refs": '[{"kind":"real_snapshot","id":"p"}]',
        "public_snapshot_refs": '["a"]', "semantic_case_ids": '["b"]', "query_ids": '["q"]', "split_group": '"g"', "seed": "42"}
    return "{" + ",".join(f'"{k}":{v}' for k, v in (sound | changes).items() if v) + "}"


#: A manifest for each remainder of an order's key, and what is wrong with it: path, problem, expected, found.
MANIFESTS: list[tuple[str, list[tuple[str, str, str, str | None]]]] = [
    (manifest_text({}), []),
    (manifest_text({"schema_version": '"1.0"'}), [("$.schema_version", "value", "1.1", "1.0")]),
    (manifest_text({"world_id": "7"}), [("$.world_id", "type", "string", "integer")]),
    (manifest_text({"policy_snapshot_refs": '[{"kind":"real_snapshot","id":"p"},{"kind":"other","id":"x"}]'}),
     [("$.policy_snapshot_refs[1].kind", "value", "real_snapshot|synthetic_version", "other")]),
    (manifest_text({"policy_snapshot_refs": '[{"kind":"synthetic_version","id":""}]'}), [("$.policy_snapshot_refs[0].id", "length", "at least 1", "0")]),
    (manifest_text({"policy_snapshot_refs": '[{"kind":"real_snapshot","id":"p","note":{"n":1}}]'}),
     [("$.policy_snapshot_refs[0].note", "unknown key", "nothing", "a value")]),
    (manifest_text({"query_ids": "[]"}), [("$.query_ids", "length", "at least 1", "0")]),
    (manifest_text({"query_ids": '["q",5,true]'}), [("$.query_ids[1]", "type", "string", "integer"), ("$.query_ids[2]", "type", "string", "boolean")]),
    (manifest_text({"ledger_id": ""}), [("$.ledger_id", "missing", "string", None)]),
    (manifest_text({"seed": '"42"'}), [("$.seed", "type", "integer", "string")]),
    (manifest_text({"mutation_type": '"observation_mask"', "mutation_spec": '{"seed_record_ids":["a"],"removed_record_ids":["r"],"closure_policy":"keep","invariant_refs":["i"]}'}),
     [("$.mutation_spec.closure_policy", "value", "remove_dependents", "keep")]),
    (manifest_text({"mutation_type": '"source_conflict"', "mutation_spec": '{"logical_fact_id":"f","removed_record_ids":[],"added_record_ids":[1.5],"invariant_refs":["i"]}'}),
     [("$.mutation_spec.added_record_ids[0]", "type", "string", "number")]),
    (manifest_text({"mutation_type": '"retraction_branch"', "mutation_spec": '{"target_assertion_ids":["t"],"removed_record_ids":[],"added_record_ids":["a"],"why":null}'}),
     [("$.mutation_spec.why", "unknown key", "nothing", "a value"), ("$.mutation_spec.invariant_refs", "missing", "array", None)]),
    (manifest_text({"mutation_spec": '{"x":{"y":[]}}'}), [("$.mutation_spec.x", "unknown key", "nothing", "a value")]),
    ("[1]", [("$", "type", "object", "array")]),
    (manifest_text({"parent_variant_id": "5", "seed": "43"}), [("$.parent_variant_id", "type", "string or null", "integer"), ("$.seed", "value", "42", "43")]),
    ('{"schema_version":', [("$", "syntax", "JSON", None)]),
]


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


@query("manifest_schema_findings", f"""SELECT o_orderkey, path, problem, expected, found FROM orders JOIN (VALUES {", ".join(
    f"({n}, {', '.join(map(_quoted, finding))})" for n, (_, wrong) in enumerate(MANIFESTS) for finding in wrong)}) t(n, path, problem, expected, found)
  ON o_orderkey % {len(MANIFESTS)} = n""")
def manifest_schema_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of orders, most of them broken at some depth, against the closed schema."""
    texts = F.array(*[F.lit(text) for text, _ in MANIFESTS])
    rows = table(spark, sf, "orders").select("o_orderkey", F.get(texts, (F.col("o_orderkey") % len(MANIFESTS)).cast("int")).alias("value"))
    return closed_schema.schema_findings(rows, manifest.manifest_schema("orders-1"), keep=("o_orderkey",))


@query("bridge_no_incident", """
SELECT c_custkey AS driver_id, c_nationkey AS fleet_id, n_regionkey AS region_id FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
 AND o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1998-01-01')""")
def bridge_no_incident(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose nation lies in the required region, without a pending order known in time."""
    members = table(spark, sf, "customer").select(F.col("c_custkey").alias("driver_id"), F.col("c_nationkey").alias("fleet_id"))
    bases = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("fleet_id"), F.col("n_regionkey").alias("region_id"),
        F.when(F.col("r_name") == "ASIA", F.col("r_regionkey")).alias("required_region_id"))
    incidents = table(spark, sf, "orders").where(
        (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp_ntz"))).select(
        F.col("o_custkey").alias("driver_id"))
    return policy.bridge(members, bases, incidents)
