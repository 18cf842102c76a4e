"""Evidence union, pins and budgeted selection.

A greedy selection looks at one list per query in order, which does not split
over tasks. Both selectors therefore first drop the items that can never be
taken, by an exact rule, so that the list left per query is bounded by the
budget and the caps and not by the data:

Once an item of some kind and cost has been refused, every later item of that
kind and cost is refused too, because the remaining budget only shrinks and
counts only grow. So of the items of one kind and cost only the first ones, as
many as can be selected, can ever be selected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _leading(items: DataFrame, keys: list[str], order: list[Column], count: int) -> DataFrame:
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return items.withColumn("_nth", nth).where(F.col("_nth") <= count).drop("_nth")


def _cost_class(token_budget: int) -> Column:
    """The cost, with all unaffordable costs in one class.

    A filter on the cost would do as well, but the optimizer moves it down to
    the scan, where a cost counted from text is then counted twice.
    """
    return F.least("token_cost", F.lit(token_budget + 1))


def _affordable(item: Column, token_budget: int) -> Column:
    """The item, or null, which ``collect_list`` leaves out."""
    return F.when(F.col("token_cost") <= token_budget, item)


def select_evidence(items: DataFrame, *, token_budget: int, per_source_cap: int = 3) -> DataFrame:
    """Greedy selection per query: an item that does not fit is skipped and the scan goes on.

    ``items``: query_id, evidence_id, source_kind, score, rank, eligibility,
    token_cost. At most ``per_source_cap`` items of a source kind are taken.
    Returns query_id, evidence_id, pick (from 1), spent (tokens after the pick).
    """
    usable = items.where(F.col("eligibility") == "eligible").withColumn("_class", _cost_class(token_budget))
    order = [F.desc("score"), F.asc("rank"), F.asc("evidence_id")]
    kept = _leading(usable, ["query_id", "source_kind", "_class"], order, per_source_cap)
    ranked = F.struct((-F.col("score")).alias("s"), F.col("rank").alias("r"), F.col("evidence_id").alias("id"),
                      F.col("source_kind").alias("kind"), F.col("token_cost").cast("bigint").alias("cost"))
    lists = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(_affordable(ranked, token_budget))).alias("items"))
    empty = F.filter(F.transform("items", lambda i: F.struct(
        i["id"].alias("id"), i["kind"].alias("kind"), i["cost"].alias("spent"))), lambda _: F.lit(False))

    def step(state: Column, item: Column) -> Column:
        used = F.size(F.filter(state["taken"], lambda t: t["kind"] == item["kind"]))
        spent = state["spent"] + item["cost"]
        entry = F.struct(item["id"].alias("id"), item["kind"].alias("kind"), spent.alias("spent"))
        fits = (used < per_source_cap) & (spent <= token_budget)
        return F.when(fits, F.struct(spent.alias("spent"), F.array_append(state["taken"], entry).alias("taken"))) \
            .otherwise(state)

    start = F.struct(F.lit(0).cast("bigint").alias("spent"), empty.alias("taken"))
    taken = lists.select("query_id", F.aggregate("items", start, step)["taken"].alias("taken"))
    return taken.select("query_id", F.posexplode("taken").alias("pos", "t")).select(
        "query_id", F.col("t.id").alias("evidence_id"), (F.col("pos") + 1).alias("pick"), F.col("t.spent").alias("spent"))


def select_public(candidates: DataFrame, *, token_budget: int, max_items: int) -> tuple[DataFrame, DataFrame]:
    """Balanced selection per query; returns (selected, excluded).

    ``candidates``: query_id, evidence_id, source_kind, score, rank, token_cost,
    pinned. At every step the candidates that still fit the budget compete:
    pinned ones first, then the kind with the fewest picks, then the kind name,
    then score, rank and id. The selection ends when nothing fits or
    ``max_items`` are taken. Every other candidate is returned with a reason
    and the final budget state.
    """
    order = [F.desc("score"), F.asc("rank"), F.asc("evidence_id")]
    usable = candidates.withColumn("_class", _cost_class(token_budget))
    kept = _leading(usable, ["query_id", "source_kind", "_class", "pinned"], order, max(max_items, 1))
    item = F.struct((~F.col("pinned")).alias("late"), F.lit(0).alias("used"), F.col("source_kind").alias("kind"),
                    (-F.col("score")).alias("s"), F.col("rank").alias("r"), F.col("evidence_id").alias("id"),
                    F.col("token_cost").cast("bigint").alias("cost"))
    lists = kept.groupBy("query_id").agg(F.collect_list(_affordable(item, token_budget)).alias("items"))
    none = F.filter("items", lambda _: F.lit(False))

    def step(state: Column, _: Column) -> Column:
        open_items = F.filter(state["left"], lambda i: state["spent"] + i["cost"] <= token_budget)
        used = lambda kind: F.size(F.filter(state["taken"], lambda t: t["kind"] == kind))
        competing = F.transform(open_items, lambda i: i.withField("used", used(i["kind"])))
        best = F.array_min(competing)
        return F.transform(F.array(best), lambda pick: F.when(pick.isNull(), state).otherwise(F.struct(
            (state["spent"] + pick["cost"]).alias("spent"),
            F.array_append(state["taken"], pick).alias("taken"),
            F.filter(open_items, lambda i: i["id"] != pick["id"]).alias("left"),
        )))[0]

    start = F.struct(F.lit(0).cast("bigint").alias("spent"), none.alias("taken"), F.col("items").alias("left"))
    # Items that no longer fit never fit again, so each step passes on a shorter list.
    steps = F.sequence(F.lit(1), F.lit(max_items)) if max_items > 0 else F.expr("cast(array() as array<int>)")
    state = lists.select("query_id", F.aggregate(steps, start, step).alias("st"))
    taken = state.select("query_id", F.posexplode("st.taken").alias("pos", "t"))
    selected = taken.select("query_id", F.col("t.id").alias("evidence_id"), F.col("t.kind").alias("source_kind"),
                            (F.col("pos") + 1).alias("pick"), F.col("t.cost").alias("token_cost"))
    final = state.select("query_id", F.col("st.spent").alias("tokens_spent"), F.size("st.taken").alias("selected_items"))
    zero = F.lit(0)
    rest = candidates.join(selected.select("query_id", "evidence_id"), ["query_id", "evidence_id"], "left_anti")
    fits = F.col("tokens_spent") + F.col("token_cost") <= token_budget
    excluded = rest.join(final, "query_id", "left").withColumns({
        "tokens_spent": F.coalesce("tokens_spent", zero.cast("bigint")),
        "selected_items": F.coalesce("selected_items", zero),
    }).select(
        "query_id", "evidence_id", "source_kind", "token_cost",
        F.when(~fits, "token_budget_exceeded").otherwise("selected_item_cap_reached").alias("reason"),
        "tokens_spent", F.lit(token_budget).alias("token_budget"), "selected_items",
        F.lit(max_items).alias("max_items"), fits.alias("would_fit_tokens"))
    return selected, excluded


def hybrid_union(*candidates: DataFrame, locator: str = "locator", order: list[str] | None = None) -> DataFrame:
    """Union in which the first candidate of each canonical locator is kept.

    Inputs count in argument order, then by ``order`` (a total order within an
    input). The rank limit drops further copies before the shuffle.
    """
    sides = [df.withColumn("_side", F.lit(i)) for i, df in enumerate(candidates)]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    ordering = ["_side", *(order or ["evidence_id"])]
    first = F.row_number().over(W.partitionBy("query_id", locator).orderBy(*ordering))
    return merged.withColumn("_nth", first).where("_nth = 1").drop("_nth", "_side")


def pin_fallback(ranked: DataFrame, pins: DataFrame) -> DataFrame:
    """Ranked results plus every pinned source that lexical search did not return.

    ``ranked``: query_id, source_id, score, rank, origin_stage; ``pins``:
    query_id, source_id. A pin without overlap enters with score 0.0, ranked
    after the results of its query in source order.
    """
    missing = pins.select("query_id", "source_id").distinct().join(
        ranked.select("query_id", "source_id"), ["query_id", "source_id"], "left_anti")
    added = missing.select("query_id", "source_id", F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("rank"),
                           F.lit("public_pin_fallback").alias("origin_stage"))
    return ranked.select("query_id", "source_id", "score", "rank", "origin_stage").unionByName(added)
