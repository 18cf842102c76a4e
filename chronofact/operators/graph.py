"""Knowledge-graph projection of a ledger: episodes, nodes, edges, lineage.

``entities``: entity_id, entity_type, name. An assertion's ``object`` is JSON
text ``{"type": ..., "value": ...}`` of type entity_ref, enum, integer,
rational or boolean. Nodes and edges are plain DataFrames.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import identity, instants
from .skew import fits_broadcast, lookup_join

# Labels of the rendered text.
PREDICATE_LABEL = "Quan hệ/vị từ"
TRIPLE_LABEL = "Bộ ba bắt buộc"
UNBOUNDED_LABEL = "không giới hạn"
#: Stands in texts where a value is null, so that nothing around it is lost.
GAP = "?"


def assertions(records: DataFrame) -> DataFrame:
    """One row per assertion with its record, in record position."""
    return records.select(
        "record_id", "source_id", "known_at", "commit_seq", "operation",
        F.posexplode("assertions").alias("pos", "a"),
    ).select("record_id", "source_id", "known_at", "commit_seq", "operation", "pos", "a.*")


def _tag(name: str) -> Column:
    return F.get_json_object("object", f"$.{name}")


def shown(value: Column | str) -> Column:
    """``value`` as text, with :data:`GAP` for null."""
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(GAP))


def _listed(items: Column, text) -> Column:
    """``text`` of each item, joined by commas; a null list is a gap, an empty one empty."""
    return F.coalesce(F.array_join(F.transform(items, text), ","), F.lit(GAP))


def value_text(object_type: Column) -> Column:
    """Text of a literal object: rationals as n/d, booleans in lower case."""
    return F.when(object_type == "rational", F.concat(shown(_tag("value.n")), F.lit("/"), shown(_tag("value.d")))).otherwise(
        shown(_tag("value")))


def named(kind: Column, name: Column, node: Column) -> Column:
    return F.concat(kind, F.lit(' "'), name, F.lit('" [id='), node, F.lit("]"))


def edges(records: DataFrame, entities: DataFrame) -> DataFrame:
    """One edge per assertion; a literal object becomes a node of its own. Nulls leave a gap in ``fact``, never the whole of it."""
    rows = assertions(records).withColumn("object_type", _tag("type"))
    is_ref = F.col("object_type") == "entity_ref"
    rows = rows.withColumn("target_id", F.when(is_ref, _tag("value")).otherwise(
        F.concat(F.lit("value:"), "assertion_id")))
    s = entities.select(F.col("entity_id").alias("subject_id"), F.col("entity_type").alias("_st"), F.col("name").alias("_sn"))
    o = entities.select(F.col("entity_id").alias("target_id"), F.col("entity_type").alias("_ot"), F.col("name").alias("_on"))
    # Few subjects and few targets may own most assertions, and literals have no target to look up.
    subjects = lookup_join(rows, s, ["subject_id"], "left", small_fits=fits_broadcast(s), salt=F.col("assertion_id"))
    looked_up = lookup_join(subjects.where(is_ref), o, ["target_id"], "left", small_fits=fits_broadcast(o), salt=F.col("assertion_id"))
    joined = looked_up.unionByName(subjects.where(~is_ref | F.col("object_type").isNull()), allowMissingColumns=True)
    subject = named(F.coalesce("_st", F.lit("ENTITY")), shown(F.coalesce("_sn", "subject_id")), shown("subject_id"))
    literal = F.concat(shown("predicate"), F.lit(" = "), value_text(F.col("object_type")), F.lit(" [id="), shown("target_id"), F.lit("]"))
    target = F.when(is_ref, named(F.coalesce("_ot", F.lit("ENTITY")), shown(F.coalesce("_on", "target_id")), shown("target_id"))) \
        .otherwise(literal)
    return joined.select(
        identity.stable_id("edge", F.col("assertion_id")).alias("edge_id"), "record_id", "assertion_id", "pos",
        "subject_id", "predicate", "target_id", "object_type", "known_at", "source_id", "operation",
        F.concat(subject, F.lit(" "), shown("predicate"), F.lit(" "), target).alias("fact"),
        *[c for c in ("valid_from", "valid_to", "event_time", "source_refs", "qualifiers") if c in rows.columns])


def nodes(edge_rows: DataFrame) -> DataFrame:
    """Distinct end points. Duplicates combine on the map side."""
    ends = edge_rows.select(F.explode(F.array("subject_id", "target_id")).alias("node_id"))
    return ends.distinct()


def _valid(edge_rows: DataFrame) -> Column:
    def end(name: str) -> Column:
        missing = F.lit(UNBOUNDED_LABEL)
        return F.coalesce(instants.utc_text(name), missing) if name in edge_rows.columns else missing

    interval = F.concat(F.lit("["), end("valid_from"), F.lit(", "), end("valid_to"), F.lit(")"))
    if "event_time" not in edge_rows.columns:
        return interval
    return F.when(F.col("event_time").isNotNull(), instants.utc_text("event_time")).otherwise(interval)


def _provenance(edge_rows: DataFrame) -> Column:
    """Qualifiers, then document revisions with their clauses, of those that the assertions carry."""
    parts = []
    if "qualifiers" in edge_rows.columns:
        pairs = F.array_sort(F.map_entries("qualifiers"))
        listed = _listed(pairs, lambda e: F.concat(shown(e["key"]), F.lit("="), shown(e["value"])))
        parts.append(F.when(F.size("qualifiers") > 0, F.concat(F.lit("; qualifiers: "), listed)))
    if "source_refs" in edge_rows.columns:
        refs = _listed(F.col("source_refs"), lambda r: F.concat(
            shown(r["document_revision_id"]), F.lit("["), _listed(r["clause_ids"], shown), F.lit("]")))
        parts.append(F.when(F.size("source_refs") > 0, F.concat(F.lit("; sources: "), refs)))
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts]) if parts else F.lit("")


def episodes(records: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Text of every record: provenance, targets, then one line per assertion with its sources.

    A record without assertions, such as a retraction, has its head line only.
    The assertions of a record lay in one row before, so the group is bounded.
    Nulls leave a gap; no record, line or source disappears.
    """
    line = F.concat(F.lit(f"{TRIPLE_LABEL}: "), shown("fact"), F.lit(f"; {PREDICATE_LABEL}: "), shown("predicate"),
                    F.lit("; valid: "), _valid(edge_rows), _provenance(edge_rows))
    grouped = edge_rows.select("record_id", "pos", line.alias("line")).groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    head = F.concat(F.lit("record_id="), shown("record_id"), F.lit(" source_id="), shown("source_id"), F.lit(" known_at="),
                    shown(instants.utc_text("known_at")), F.lit(" operation="), shown("operation"))
    if "target_assertion_ids" in records.columns:
        targets = F.coalesce(F.array_join(F.transform("target_assertion_ids", shown), ","), F.lit(""))
        head = F.concat(head, F.when(targets != "", F.concat(F.lit(" targets="), targets)).otherwise(F.lit("")))
    heads = records.select("record_id", head.alias("_head"))
    grouped = grouped.withColumnRenamed("record_id", "_record")
    lines = F.coalesce("_l", F.array().cast(grouped.schema["_l"].dataType))
    return heads.join(grouped, F.col("record_id").eqNullSafe(F.col("_record")), "left").select(
        "record_id", F.size(lines).alias("assertion_count"),
        F.array_join(F.concat(F.array("_head"), F.transform(lines, lambda x: x["line"])), "\n").alias("text"))


def query_text(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Query text followed by the public context: its entities, time scope and snapshots, each in the given order.

    ``queries``: query_id, query, entity_refs array, known_as_of, snapshot_refs
    array and, if there is one, time_scope text. Null lists are empty.
    """
    e = entities.select(F.col("entity_id").alias("_ref"), "entity_type", "name")
    asked = queries.select("query_id", F.posexplode("entity_refs").alias("_pos", "_ref"))
    shown = named(F.coalesce("entity_type", F.lit("ENTITY")), F.coalesce("name", "_ref"), F.col("_ref"))
    found = asked.join(e, "_ref", "left").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("_pos", shown.alias("t")))).alias("_e"))
    scope = [F.concat(F.lit("time_scope="), "time_scope")] if "time_scope" in queries.columns else []
    named_entities = F.array_join(F.transform("_e", lambda x: x["t"]), "\n")
    snapshots = F.array_join(F.transform("snapshot_refs", lambda x: F.concat(F.lit("snapshot="), x)), "\n")
    return queries.join(found, "query_id", "left").select("query_id", F.concat_ws(
        "\n", "query", named_entities, F.concat(F.lit("known_as_of="), instants.utc_text("known_as_of")), *scope,
        F.when(F.size("snapshot_refs") > 0, snapshots)).alias("text"))


def lineage(edge_rows: DataFrame, episode_rows: DataFrame) -> DataFrame:
    """Edge to episode to record: the locator of every edge."""
    known = episode_rows.select("record_id", "assertion_count")
    return edge_rows.select("edge_id", "record_id", "assertion_id").join(known, "record_id")


def ordered(value: Column, kind: T.DataType) -> Column:
    """``value`` in a form that can be compared: maps, at any depth, as their sorted entries."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(
            ordered(e["key"], kind.keyType).alias("k"), ordered(e["value"], kind.valueType).alias("v")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: ordered(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[ordered(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), fields)
    return value


def one_copy(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest by all other columns, maps by their sorted entries, so repeats choose alike."""
    others = [f for f in rows.schema.fields if f.name != key]
    if not others:
        return rows.distinct()
    by = F.struct(*[ordered(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}") for i, f in enumerate(others)])
    return rows.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{f.name}`") for f in others]), by).alias("_r")).select(
        *[F.col(c) if c == key else F.col(f"_r.`{c}`").alias(c) for c in rows.columns])


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Idempotent write: rows whose key is new are added, repeats change nothing."""
    return existing.unionByName(one_copy(incoming.join(existing.select(key), key, "left_anti").select(*incoming.columns), key))


def append_new(path: str, incoming: DataFrame, key: str) -> DataFrame:
    """Append to the table at ``path`` what has a new key, and return the table. Writing twice adds nothing."""
    spark = incoming.sparkSession
    stored = spark.read.schema(incoming.schema)
    try:
        known = stored.parquet(path).select(key)
    except AnalysisException:  # the first write
        known = incoming.select(key).limit(0)
    one_copy(incoming.join(known, key, "left_anti").select(*incoming.columns), key).write.mode("append").parquet(path)
    return stored.parquet(path)


def resume_violations(done: DataFrame, expected: DataFrame) -> DataFrame:
    """Positions at which what was ingested is not an exact prefix of what is expected.

    Both have position and name. ``problem`` is ``repeated``, ``unexpected``,
    ``changed``, or ``missing`` for an expected position at or before the last
    ingested one. No row means ingestion may resume after the last position.
    """
    last = done.agg(F.max("position")).first()[0]
    d = done.groupBy("position").agg(F.min("name").alias("done_name"), F.count("*").alias("_n"))
    e = expected.select("position", F.col("name").alias("expected_name"))
    prefix = e.where(F.col("position") <= F.lit(last)) if last is not None else e.limit(0)
    problem = (F.when(F.col("_n") > 1, "repeated").when(F.col("_n").isNull(), "missing").when(F.col("expected_name").isNull(), "unexpected")
               .when(F.col("done_name") != F.col("expected_name"), "changed"))
    return d.join(prefix, "position", "full_outer").select(
        "position", "done_name", "expected_name", problem.alias("problem")).where("problem is not null")


def resume_position(done: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: the first position to ingest next, null when all is done, and the number of violations before it."""
    bad = resume_violations(done, expected)
    first_bad = bad.agg(F.min("position").alias("p"), F.count("*").alias("n")).first()
    last = done.agg(F.max("position")).first()[0]
    after = expected if last is None else expected.where(F.col("position") > F.lit(last))
    following = after.agg(F.min("position").alias("next"))
    return following.select(F.coalesce(F.lit(first_bad["p"]), "next").cast(expected.schema["position"].dataType).alias("position"),
                            F.lit(first_bad["n"]).alias("violations"))
