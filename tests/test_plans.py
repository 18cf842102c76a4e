"""What the physical plans must and must not contain."""

import re

import pytest

from chronofact.operators import lexical
from chronofact.plans import load

FOLDER = "/root/testdata/sf0.001"
QUERIES = load().QUERIES


def plan_of(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_ledger_ingest"}))
def test_no_cross_join_and_no_window_without_key(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A window without a key would gather its input in one partition first.
    assert not re.search(r"Window \[.*\n.*Sort .*\n.*Exchange SinglePartition", plan)


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_chunk_topk", "select_evidence", "select_evidence_documents", "select_public",
                                  "hybrid_union"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    assert "Partial" in "".join(re.findall(r"WindowGroupLimit.*", plan_of(spark, name)))


@pytest.mark.parametrize("name", ["chunk_documents", "raw_offset_map", "construct_chunks", "chunk_clause_overlap", "document_lengths"])
def test_texts_are_chunked_where_they_lie(spark, name):
    exchanges = re.findall(r"Exchange (\w+)", plan_of(spark, name))
    assert set(exchanges) <= {"RoundRobinPartitioning"}  # only the spread of a small scan


@pytest.mark.parametrize("name,columns", [
    ("ledger_as_of", {"event_id", "ts", "user_id", "event_type", "value"}), ("stage_latency", {"event_type", "value"}),
    ("interval_eligible", {"o_orderkey", "o_orderdate", "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag"}),
    ("chunk_documents", {"doc_id", "text"}), ("bridge_no_incident", {"c_custkey", "c_nationkey", "n_nationkey", "n_regionkey", "r_regionkey",
                                                                     "r_name", "o_custkey", "o_orderstatus", "o_orderdate"})])
def test_scans_read_only_what_is_used(spark, name, columns):
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(spark, name)))))
    assert read and read <= columns


@pytest.mark.parametrize("name,predicate", [
    ("ledger_as_of", "LessThanOrEqual(ts"), ("point_eligible", "GreaterThanOrEqual(ts"), ("bridge_no_incident", "EqualTo(o_orderstatus,P)"),
    ("hybrid_union", "IsNotNull(doc_id)")])
def test_filters_reach_the_scan(spark, name, predicate):
    assert predicate in " ".join(re.findall(r"PushedFilters: \[([^\]]*)\]", plan_of(spark, name)))


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_chunk_topk", "bm25_allowed_sources"])
def test_terms_are_counted_before_they_travel(spark, name):
    """Only a small scan of whole texts may be spread; rows that carry a term meet one exchange by key."""
    found = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("REPARTITION_BY_COL" in line for line in found)
    for at, line in enumerate(found):
        if "REPARTITION_BY_NUM" in line:
            depth = line.index("Exchange")
            below = next(b for b in found[at + 1:] if b.index(b.lstrip(" :+-|")) > depth)
            assert "FileScan" in below or "Scan parquet" in below or "ColumnarToRow" in below, below
            assert "term" not in below and "_tf" not in below


SEARCHES = ["bm25_chunk_lineage", "bm25_topk", "evidence_recall", "missing_roles", "pin_fallback", "query_completeness", "retrieval_traces"]


@pytest.mark.parametrize("name", SEARCHES)
def test_a_task_of_a_search_holds_no_share_of_the_texts(spark, monkeypatch, name):
    """What is sorted, gathered or joined by document takes memory that grows with the texts."""
    plans, search = [], lexical.bm25_search

    def noted(*args, **named):
        found = search(*args, **named)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(lexical, "bm25_search", noted)
    QUERIES[name](spark, FOLDER)
    assert plans
    for plan in plans:
        assert "MapInArrow" in plan
        below = plan[plan.index("MapInArrow"):]
        assert not re.search(r"Sort|Aggregate|Join", below[:below.index("FileScan")])


@pytest.mark.parametrize("name", ["validate_ledger", "ledger_violations"])
def test_validation_looks_back_once(spark, name):
    plan = plan_of(spark, name)
    # one window makes the seeded records, one looks back over closings, openings and records
    assert len(re.findall(r"Window \[", plan)) <= 2 and plan.count("Scan parquet") <= 1
