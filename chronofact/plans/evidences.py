"""Selection, coverage, inventories, evaluation and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import coverage, evaluation, evidence, inventory, lexical, tablediff
from ..operators.skew import fits_broadcast, lookup_join, number_rows, slice_bounds
from ..session import scratch_path
from ..sources.tables import spread, table
from .registry import query
from .retrieval import WS, bm25_sql
from .values import stable_sql

WORDS = rf"len(regexp_extract_all(text, '[^{WS}]+'))"
BUDGET, CAP = 1800, 3
PUBLIC_BUDGET, PUBLIC_ITEMS = 120, 4


def greedy_sql(items: str, budget: int, cap: int) -> str:
    """The plain sequential scan: every item of every query, one after the other."""
    return f"""
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY eligible DESC, score DESC, rank, evidence_id) AS rn FROM {items}),
g AS (SELECT query_id, 0::BIGINT AS rn, 0::BIGINT AS spent, []::VARCHAR[] AS kinds, FALSE AS took, NULL::VARCHAR AS evidence_id
      FROM (SELECT DISTINCT query_id FROM o)
      UNION ALL
      SELECT g.query_id, o.rn, CASE WHEN fits THEN g.spent + o.cost ELSE g.spent END,
             CASE WHEN fits THEN list_append(g.kinds, o.kind) ELSE g.kinds END, fits, o.evidence_id
      FROM (SELECT * FROM g) g JOIN o ON o.query_id = g.query_id AND o.rn = g.rn + 1,
      LATERAL (SELECT o.eligible AND g.spent + o.cost <= {budget} AND len([k FOR k IN g.kinds IF k = o.kind]) < {cap} AS fits) f),
picked AS (SELECT query_id, evidence_id, len(kinds) AS pick, spent FROM g WHERE took)
"""


TURNS = f"""
items AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, 't' || turn AS evidence_id, role AS kind, CAST(length(text) AS DOUBLE) AS score,
   CAST(turn AS BIGINT) AS rank, role <> 'system' AS eligible, {WORDS} AS cost FROM conversations)"""
DOCS = f"""
items AS (SELECT lang AS query_id, 'd' || doc_id AS evidence_id, source AS kind, CAST(n_chars % 997 AS DOUBLE) AS score,
   CAST(doc_id AS BIGINT) AS rank, coalesce(toxic, 0) = 0 AS eligible, {WORDS} AS cost FROM documents LEFT JOIN labels USING (doc_id))"""


def turn_items(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "conversations")).select(
        F.col("conv_id").cast("string").alias("query_id"), F.concat(F.lit("t"), "turn").alias("evidence_id"),
        F.col("role").alias("source_kind"), F.length("text").cast("double").alias("score"), F.col("turn").cast("bigint").alias("rank"),
        F.when(F.col("role") == "system", "ineligible").otherwise("eligible").alias("eligibility"),
        tx.word_count("text").alias("token_cost"))


def document_items(spark: SparkSession, sf: str, query_id: str = "lang", kind: str = "source") -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "source", "lang", "n_chars"))
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id", "left").select(
        F.col(query_id).alias("query_id"), F.concat(F.lit("d"), "doc_id").alias("evidence_id"), F.col(kind).alias("source_kind"),
        (F.col("n_chars") % 997).cast("double").alias("score"), F.col("doc_id").cast("bigint").alias("rank"),
        F.when(F.coalesce("toxic", F.lit(0)) == 0, "eligible").otherwise("ineligible").alias("eligibility"),
        tx.word_count("text").alias("token_cost"))


@query("select_evidence", f"WITH RECURSIVE {TURNS}, {greedy_sql('items', BUDGET, CAP)} SELECT * FROM picked")
def select_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of each conversation as evidence."""
    return evidence.select_evidence(turn_items(spark, sf), token_budget=BUDGET, per_source_cap=CAP)


@query("select_evidence_documents", f"WITH RECURSIVE {DOCS}, {greedy_sql('items', BUDGET, CAP)} SELECT * FROM picked")
def select_evidence_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Few queries with very many candidates each: all documents of a language."""
    return evidence.select_evidence(document_items(spark, sf), token_budget=BUDGET, per_source_cap=CAP)


PUBLIC = f"""
c AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, 't' || turn AS evidence_id, role AS kind, CAST(length(text) AS DOUBLE) AS score,
   CAST(turn AS BIGINT) AS rank, {WORDS} AS cost, turn = 1 AS pinned FROM conversations),
g AS (SELECT query_id, 0 AS n, 0::BIGINT AS spent, []::VARCHAR[] AS ids, []::VARCHAR[] AS kinds FROM (SELECT DISTINCT query_id FROM c)
  UNION ALL
  SELECT query_id, n + 1, spent + cost, list_append(ids, evidence_id), list_append(kinds, kind) FROM (
    SELECT g.*, c.evidence_id, c.kind, c.cost, row_number() OVER (PARTITION BY g.query_id ORDER BY NOT c.pinned,
      len([k FOR k IN g.kinds IF k = c.kind]), c.kind, c.score DESC, c.rank, c.evidence_id) AS r
    FROM g JOIN c ON c.query_id = g.query_id WHERE g.n < {PUBLIC_ITEMS} AND g.spent + c.cost <= {PUBLIC_BUDGET}
      AND NOT list_contains(g.ids, c.evidence_id)) WHERE r = 1),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC) AS r FROM g) WHERE r = 1)
"""


def public_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return turn_items(spark, sf).withColumn("pinned", F.col("rank") == 1)


@query("select_public", f"""WITH RECURSIVE {PUBLIC}
SELECT f.query_id, c.evidence_id, c.kind AS source_kind, list_position(f.ids, c.evidence_id) AS pick, c.cost AS token_cost
FROM fin f JOIN c ON c.query_id = f.query_id WHERE list_contains(f.ids, c.evidence_id)""")
def select_public(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.select_public(public_candidates(spark, sf), token_budget=PUBLIC_BUDGET, max_items=PUBLIC_ITEMS)[0]


@query("public_exclusions", f"""WITH RECURSIVE {PUBLIC}
SELECT f.query_id, c.evidence_id, c.kind AS source_kind, c.cost AS token_cost,
  CASE WHEN f.spent + c.cost > {PUBLIC_BUDGET} THEN 'token_budget_exceeded' ELSE 'selected_item_cap_reached' END AS reason,
  f.spent AS tokens_spent, {PUBLIC_BUDGET} AS token_budget, f.n AS selected_items, {PUBLIC_ITEMS} AS max_items,
  f.spent + c.cost <= {PUBLIC_BUDGET} AS would_fit_tokens
FROM fin f JOIN c ON c.query_id = f.query_id WHERE NOT list_contains(f.ids, c.evidence_id)""")
def public_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.select_public(public_candidates(spark, sf), token_budget=PUBLIC_BUDGET, max_items=PUBLIC_ITEMS)[1]


INVENTORIES = """
d AS (SELECT 'documents/' || source || '/' || doc_id || '.md' AS path, sha256(text) AS h FROM documents WHERE lang <> 'es'),
a AS (SELECT 'documents/' || source || '/' || doc_id || '.md' AS path,
        sha256(CASE WHEN lang = 'fr' THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END) AS h FROM documents WHERE lang <> 'de'),
f AS (SELECT path, d.h AS declared_sha256, a.h AS actual_sha256, CASE WHEN a.h IS NULL THEN 'missing' WHEN d.h IS NULL THEN 'unexpected'
        WHEN d.h <> a.h THEN 'mismatched' ELSE 'match' END AS state FROM d FULL JOIN a USING (path))
"""


def inventories(spark: SparkSession, sf: str) -> DataFrame:
    """Declared against actual: German files are missing, Spanish ones new, French line ends changed."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"))
    path = F.concat(F.lit("documents/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path")
    changed = F.when(F.col("lang") == "fr", F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return inventory.diff(docs.where("lang <> 'es'").select(path, F.sha2("text", 256).alias("sha256")),
                          docs.where("lang <> 'de'").select(path, F.sha2(changed, 256).alias("sha256")))


@query("inventory_diff", f"WITH {INVENTORIES} SELECT * FROM f")
def inventory_diff(spark: SparkSession, sf: str) -> DataFrame:
    return inventories(spark, sf)


@query("inventory_summary", f"""WITH {INVENTORIES} SELECT count(*) FILTER (state <> 'unexpected') AS declared,
 count(*) FILTER (state <> 'missing') AS checked, count(*) FILTER (state = 'match') AS matched, count(*) FILTER (state = 'missing') AS missing,
 count(*) FILTER (state = 'mismatched') AS mismatched, count(*) FILTER (state = 'unexpected') AS unexpected,
 CASE WHEN count(*) = count(*) FILTER (state = 'match') THEN 'pass' ELSE 'fail' END AS status FROM f""")
def inventory_summary(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.summary(inventories(spark, sf))


RECIPES = """
recipes AS (SELECT DISTINCT user_id AS subject_id, w AS week, user_id || ':w' || w AS recipe_key,
  TIMESTAMP '2024-01-01' + to_days(CAST(7 * w AS INT)) AS window_start, TIMESTAMP '2024-01-08' + to_days(CAST(7 * w AS INT)) AS window_end
  FROM events, (VALUES (0), (1), (2), (3), (4)) t(w)),
members AS (SELECT recipe_key, event_id AS member_id, CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'cancelled'
  ELSE 'pending' END AS outcome FROM recipes JOIN events ON user_id = subject_id
  WHERE ts >= window_start AND ts < window_end AND event_type IN ('purchase', 'error', 'signup'))
"""


def recipes(spark: SparkSession, sf: str) -> DataFrame:
    """Per user and week of January: the terminal events of three sources."""
    weeks = F.array(*[F.struct(
        F.lit(w).alias("week"), F.lit(f"2024-01-{1 + 7 * w:02d}").cast("timestamp_ntz").alias("window_start"),
        F.lit(f"2024-01-{8 + 7 * w:02d}" if w < 4 else "2024-02-05").cast("timestamp_ntz").alias("window_end")) for w in range(5)])
    users = table(spark, sf, "events").select(F.col("user_id").alias("subject_id")).distinct()
    return users.select("subject_id", F.explode(weeks).alias("w")).select(
        F.concat("subject_id", F.lit(":w"), "w.week").alias("recipe_key"), "subject_id", "w.window_start", "w.window_end",
        F.array(F.lit("purchase"), F.lit("error"), F.lit("signup")).alias("source_set"))


def coverage_events(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "cancelled").otherwise("pending")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("member_id"), F.col("user_id").alias("subject_id"), F.col("event_type").alias("source_id"),
        F.col("ts").alias("event_time"), outcome.alias("outcome"))


@query("coverage_outcomes", f"""WITH {RECIPES} SELECT recipe_key, outcome, count(member_id) AS members
FROM recipes LEFT JOIN members USING (recipe_key) GROUP BY ALL""")
def coverage_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    scope = recipes(spark, sf)
    return coverage.outcomes(scope, coverage.members(scope, coverage_events(spark, sf)))


@query("coverage_digests", f"""WITH {RECIPES},
h AS (SELECT recipe_key, sha256(CAST(member_id AS VARCHAR)) AS h FROM members),
p AS (SELECT recipe_key, substr(h, 1, 3) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL),
w AS (SELECT recipe_key, sum(n)::BIGINT AS n, sha256(string_agg(d, '' ORDER BY b)) AS d FROM p GROUP BY recipe_key),
m AS (SELECT r.*, coalesce(n, 0) AS members, coalesce(d, '{coverage.EMPTY_DIGEST}') AS members_digest FROM recipes r LEFT JOIN w USING (recipe_key)),
c AS (SELECT recipe_key, members, members_digest, sha256('{{"members_digest":"' || members_digest || '","source_set":"error,purchase,signup","subject_id":"'
  || subject_id || '","window_end":"' || strftime(window_end, '%Y-%m-%d %H:%M:%S') || '","window_start":"' || strftime(window_start, '%Y-%m-%d %H:%M:%S') || '"}}' || chr(10)) AS content_digest
  FROM m)
SELECT *, {stable_sql('coverage_artifact', 'content_digest')} AS artifact_id FROM c""")
def coverage_digests(spark: SparkSession, sf: str) -> DataFrame:
    scope = recipes(spark, sf)
    return coverage.digests(scope, coverage.members(scope, coverage_events(spark, sf)))


@query("coverage_violations", f"""WITH {RECIPES},
g AS (SELECT recipe_key, right(recipe_key, 1) AS w FROM recipes),
f AS (SELECT *, CASE w WHEN '0' THEN [] WHEN '1' THEN ['window starts late'] WHEN '2' THEN ['subject differs'] WHEN '3' THEN ['sources differ', 'source delivered nothing']
  ELSE ['window is not declared half-open', 'recipe is not registered'] END AS v FROM g)
SELECT recipe_key, violation, CASE WHEN violation = 'source delivered nothing' THEN 'mystery' END AS source_id FROM (SELECT recipe_key, unnest(v) AS violation FROM f)""")
def coverage_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Recipes narrowed, turned to another subject, given a silent source or not registered, by week."""
    registered = recipes(spark, sf)
    week = F.right("recipe_key", F.lit(1))
    asked = registered.withColumns({
        "window_start": F.when(week == "1", F.col("window_start") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("window_start")),
        "subject_id": F.when(week == "2", F.col("subject_id") + 1).otherwise(F.col("subject_id")),
        "source_set": F.when(week == "3", F.array_append("source_set", F.lit("mystery"))).otherwise(F.col("source_set")),
        "bounds": F.when(week == "4", "observed").otherwise("half-open")})
    return coverage.recipe_violations(asked, coverage_events(spark, sf), registered.where(week != "4"))


@query("coverage_rates", f"""WITH {RECIPES},
req AS (SELECT DISTINCT user_id || ':w' || w AS recipe_key FROM events, (VALUES (0), (1), (2), (3), (4), (9)) t(w)),
s AS (SELECT recipe_key, count(member_id) AS n, count(*) FILTER (outcome = 'cancelled') AS c, count(*) FILTER (outcome = 'completed') AS k
  FROM recipes LEFT JOIN members USING (recipe_key) GROUP BY recipe_key)
SELECT recipe_key, CASE WHEN n IS NULL THEN 'missing_coverage' ELSE 'complete' END AS status, coalesce(n, 0) AS enumerated_members,
  CASE WHEN c + k > 0 THEN c // gcd(c, c + k) END AS rate_n, CASE WHEN c + k > 0 THEN (c + k) // gcd(c, c + k) END AS rate_d
FROM req LEFT JOIN s USING (recipe_key)""")
def coverage_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Cancel rate of each requested scope; week 9 has no coverage recipe."""
    scope = recipes(spark, sf)
    users = table(spark, sf, "events").select("user_id").distinct()
    weeks = F.array(*[F.lit(w) for w in (0, 1, 2, 3, 4, 9)])
    requests = users.select("user_id", F.explode(weeks).alias("week")).select(
        F.concat("user_id", F.lit(":w"), "week").alias("recipe_key"))
    return coverage.cancel_rates(requests, scope, coverage.members(scope, coverage_events(spark, sf)))


SUPPORT = f"""
{bm25_sql('documents', 'doc_id')},
items AS (SELECT CAST(top.query_id AS VARCHAR) AS query_id, 'd' || doc_id AS evidence_id, lang AS kind, top.score, CAST(top.rank AS BIGINT) AS rank,
   coalesce(toxic, 0) = 0 AS eligible, {WORDS} AS cost FROM top JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)),
{greedy_sql('items', BUDGET, CAP)},
cand AS (SELECT query_id, evidence_id FROM items WHERE eligible),
places AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark),
atoms AS (SELECT CAST(item_id AS VARCHAR) AS query_id, 'd' || doc_id AS evidence_id, lang AS modality, toxic = 0 AS available,
   CASE WHEN quality = 1 THEN 'primary' ELSE 'secondary' END AS role FROM labels JOIN documents USING (doc_id) JOIN places ON doc_id % n = place),
att AS (SELECT a.*, c.evidence_id IS NOT NULL AS in_candidates, p.evidence_id IS NOT NULL AS in_selected
  FROM atoms a LEFT JOIN cand c USING (query_id, evidence_id) LEFT JOIN picked p USING (query_id, evidence_id))
"""


def candidate_items(docs: DataFrame, labels: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What the search returns for benchmark queries, with what the selection looks at."""
    found = lexical.bm25_search(docs.select("doc_id", "text"), benchmark, key=["doc_id"], query_key="item_id")
    return lexical.looked_up(found, docs, ["doc_id"]).join(labels.select("doc_id", "toxic"), "doc_id", "left").select(
        F.col("query_id").cast("string").alias("query_id"), F.concat(F.lit("d"), "doc_id").alias("evidence_id"), F.col("lang").alias("source_kind"),
        "score", F.col("rank").cast("bigint").alias("rank"),
        F.when(F.coalesce("toxic", F.lit(0)) == 0, "eligible").otherwise("ineligible").alias("eligibility"), tx.word_count("text").alias("token_cost"))


def support(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as required evidence of benchmark queries, dealt over all of them; candidates are what the search returns for them."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    labels = table(spark, sf, "labels")
    items = candidate_items(docs, labels, table(spark, sf, "benchmark"))
    chosen = evidence.select_evidence(items, token_budget=BUDGET, per_source_cap=CAP)
    candidates = items.where("eligibility = 'eligible'")
    benchmark = table(spark, sf, "benchmark").select("item_id")
    places = number_rows(benchmark, "item_id", slice_bounds(benchmark, "item_id"), "place").select(F.col("item_id").cast("string").alias("query_id"), "place")
    dealt = lookup_join(labels.withColumn("place", F.col("doc_id") % benchmark.count()), places, ["place"], "inner",
                        small_fits=fits_broadcast(places), salt=F.col("doc_id"))
    atoms = dealt.join(docs.select("doc_id", "lang"), "doc_id").select(
        "query_id", F.concat(F.lit("d"), "doc_id").alias("evidence_id"), F.col("lang").alias("modality"),
        (F.col("toxic") == 0).alias("available"), F.when(F.col("quality") == 1, "primary").otherwise("secondary").alias("role"))
    return evaluation.attribute_support(atoms, candidates, chosen)


@query("support_attribution", f"WITH RECURSIVE {SUPPORT} SELECT * FROM att")
def support_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return support(spark, sf)


@query("missing_roles", f"""WITH RECURSIVE {SUPPORT} SELECT query_id, role, CASE WHEN NOT available THEN 'intentionally_unavailable'
  WHEN NOT in_candidates THEN 'missing_from_candidates' ELSE 'selection_dropped_required_evidence' END AS reason, count(*) AS atoms
  FROM att WHERE NOT (available AND in_candidates AND in_selected) GROUP BY ALL""")
def missing_roles(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.missing_roles(support(spark, sf))


@query("evidence_recall", f"""WITH RECURSIVE {SUPPORT} SELECT modality, count(*) AS required, count(*) FILTER (in_candidates) AS candidate_hits,
  count(*) FILTER (in_candidates AND in_selected) AS selected_hits, round(count(*) FILTER (in_candidates) / count(*), 9) AS candidate_recall,
  round(count(*) FILTER (in_candidates AND in_selected) / count(*), 9) AS selected_recall FROM att GROUP BY modality""")
def evidence_recall(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.modality_recall(support(spark, sf))


@query("query_completeness", f"""WITH RECURSIVE {SUPPORT},
qc AS (SELECT query_id, count(*) AS atoms, count(*) FILTER (NOT available) AS unavailable, count(*) FILTER (available AND NOT in_candidates) AS missing,
  count(*) FILTER (in_candidates AND NOT in_selected) AS dropped, bool_and(in_candidates) AS candidate_complete,
  bool_and(in_candidates AND in_selected) AS selected_complete FROM att GROUP BY query_id)
SELECT *, candidate_complete AND NOT selected_complete AS selection_loss, CASE WHEN unavailable > 0 THEN 'intentionally_unavailable'
  WHEN missing > 0 THEN 'missing_from_candidates' WHEN dropped > 0 THEN 'selection_dropped_required_evidence' ELSE 'none' END AS earliest_failing_stage FROM qc""")
def query_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.query_completeness(support(spark, sf))


@query("stage_latency", """
WITH t AS (SELECT event_type AS stage, CAST(round(value * 100) AS BIGINT) AS ticks FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ticks) AS rn, count(*) OVER (PARTITION BY stage) AS n FROM t)
SELECT stage, n AS denominator, CAST(sum(ticks) AS BIGINT) AS total_ticks, min(ticks) AS min_ticks, max(ticks) AS max_ticks,
  min(ticks) FILTER (rn >= ceil(0.5::DOUBLE * n)) AS p50_ticks, min(ticks) FILTER (rn >= ceil(0.95::DOUBLE * n)) AS p95_ticks FROM r GROUP BY stage, n""")
def stage_latency(spark: SparkSession, sf: str) -> DataFrame:
    timings = table(spark, sf, "events").select(
        F.col("event_type").alias("stage"), F.round(F.col("value") * 100).cast("bigint").alias("ticks"))
    return evaluation.latency_statistics(timings)


TRACES = """
t AS (SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total,
  CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type <> 'error'), 0) AS BIGINT) AS stages,
  arg_max(event_type, event_id) AS last_type, count(*) FILTER (event_type IN ('view', 'click')) AS candidates,
  count(*) FILTER (event_type = 'purchase') AS selections, count(*) FILTER (event_type = 'error') AS exclusions FROM events GROUP BY user_id),
traces AS (SELECT c_custkey AS query_id, coalesce(candidates, 0) AS candidate_count, coalesce(selections, 0) AS selection_count,
  coalesce(exclusions, 0) AS exclusion_count, coalesce(candidates, 0) >= 30 AS truncated, CASE WHEN user_id IS NULL THEN 'no_result' WHEN last_type = 'error' THEN 'failed' ELSE 'completed_retrieval' END
  AS runtime_status, total, stages, total >= stages AS invariant_pass FROM customer LEFT JOIN t ON c_custkey = user_id)
"""


#: Views and clicks of a query that a trace may list.
CANDIDATES = 30


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as queries: views and clicks are candidates, purchases selections, errors exclusions."""
    ticks = F.round(F.col("value") * 100).cast("bigint")
    kind = F.col("event_type")
    stages = {"candidate": kind.isin("view", "click"), "selection": kind == "purchase", "exclusion": kind == "error"}
    done = table(spark, sf, "events").groupBy(F.col("user_id").alias("query_id")).agg(
        F.sum(ticks).alias("total"), F.coalesce(F.sum(F.when(kind != "error", ticks)), F.lit(0).cast("bigint")).alias("stages"),
        F.when(F.max_by("event_type", "event_id") == "error", "failed").otherwise("completed_retrieval").alias("runtime_status"),
        *[F.count_if(rows).alias(f"{name}_count") for name, rows in stages.items()])
    queries = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"))
    zero = F.lit(0).cast("bigint")
    found = evaluation.terminal_traces(queries, done).withColumn("invariant_pass", F.col("total") >= F.col("stages"))
    counted = found.withColumns({f"{n}_count": F.coalesce(f"{n}_count", zero) for n in stages})
    return counted.withColumn("truncated", F.col("candidate_count") >= CANDIDATES)


@query("retrieval_traces", f"""WITH RECURSIVE {SUPPORT},
c AS (SELECT query_id, count(*) AS candidate_count, count(*) FILTER (eligible) AS eligible_count FROM items GROUP BY query_id),
p AS (SELECT query_id, count(*) AS selection_count FROM picked GROUP BY query_id)
SELECT CAST(item_id AS VARCHAR) AS query_id, coalesce(candidate_count, 0) AS candidate_count, coalesce(eligible_count, 0) AS eligible_count,
  coalesce(selection_count, 0) AS selection_count, coalesce(eligible_count, 0) - coalesce(selection_count, 0) AS exclusion_count, 10::BIGINT AS candidate_limit,
  coalesce(candidate_count, 0) >= 10 AS truncated, CASE WHEN candidate_count > 0 THEN 'completed_retrieval' ELSE 'no_result' END AS runtime_status
FROM benchmark LEFT JOIN c ON c.query_id = CAST(item_id AS VARCHAR) LEFT JOIN p ON p.query_id = CAST(item_id AS VARCHAR)""")
def retrieval_traces(spark: SparkSession, sf: str) -> DataFrame:
    """A trace of every benchmark query through search, eligibility and selection."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    benchmark = table(spark, sf, "benchmark")
    # search results are stored: three stages read them, and the search runs once
    path = scratch_path(spark, "candidates")
    candidate_items(docs, labels, benchmark).write.parquet(path)
    items = spark.read.parquet(path)
    chosen = evidence.select_evidence(items, token_budget=BUDGET, per_source_cap=CAP)
    traced = evaluation.stage_traces(benchmark.select(F.col("item_id").cast("string").alias("query_id")), {
        "candidate": items, "eligible": items.where("eligibility = 'eligible'"), "selection": chosen}, {"candidate": 10})
    return traced.withColumn("exclusion_count", F.col("eligible_count") - F.col("selection_count"))


@query("terminal_traces", f"WITH {TRACES} SELECT * FROM traces")
def terminal_traces(spark: SparkSession, sf: str) -> DataFrame:
    return traces(spark, sf)


@query("terminal_status_counts", f"""WITH {TRACES} SELECT runtime_status, count(*) AS n, count(*) FILTER (invariant_pass) AS invariant_ok FROM traces GROUP BY ALL""")
def terminal_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return traces(spark, sf).groupBy("runtime_status").agg(
        F.count("*").alias("n"), F.count_if("invariant_pass").alias("invariant_ok"))


@query("table_compare", """WITH l AS (SELECT o_orderkey AS key, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
r AS (SELECT key, o_custkey, o_orderstatus, CASE WHEN key % 1009 = 0 THEN cents + 1 ELSE cents END AS cents FROM l WHERE key % 997 <> 0
  UNION ALL SELECT -key - 1, o_custkey, o_orderstatus, cents FROM l WHERE key % 1013 = 0)
SELECT coalesce(l.key, r.key) AS key, CASE WHEN r.key IS NULL THEN 'lost' WHEN l.key IS NULL THEN 'added' ELSE 'changed' END AS state
FROM l FULL OUTER JOIN r ON l.key = r.key WHERE l.key IS NULL OR r.key IS NULL
  OR (l.o_custkey, l.o_orderstatus, l.cents) IS DISTINCT FROM (r.o_custkey, r.o_orderstatus, r.cents)""")
def table_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The orders against a copy in which a few are changed, lost and added, by their digest trees."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    ours = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", "o_orderstatus", cents.alias("cents"))
    theirs = ours.where("key % 997 <> 0").withColumn("cents", F.when(F.col("key") % 1009 == 0, F.col("cents") + 1).otherwise(F.col("cents"))).unionByName(
        ours.where("key % 1013 = 0").withColumn("key", -F.col("key") - 1))
    paths = [scratch_path(spark, f"tree-{side}") for side in ("left", "right")]
    for rows, path in zip((ours, theirs), paths, strict=True):
        tablediff.write_tree(rows, path, "key", F.to_json(F.struct("o_custkey", "o_orderstatus", "cents")))
    return tablediff.differences(spark, *paths)
