"""Rendering of policy rules to text with exact clause spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import identity, text as tx

# The wording of rendered policies.
FLEET_RULE = "fleet_region_without_open_incident"
REGION_RULE = "operating_region_requirement"
HEADING = "# Synthetic control policy {version}\n\n"
SCOPE_BODY = (
    "A driver satisfies the fleet-region premise only when an active MEMBER_OF assertion "
    "links the driver to a fleet whose active BASED_IN assertion is {region}."
)
EXCEPTION_BODY = (
    "At {time}, the rule is not satisfied when the same driver has "
    "an incident membership with INCIDENT_STATUS=open. Absence requires a complete published "
    "incident-register coverage artifact for that driver and time."
)
REGION_BODY = "The required active OPERATES_IN region for this policy version is {region}."
INCIDENT_TOKEN = "INCIDENT_STATUS=open"


def _fill(template: str, **values: Column) -> Column:
    """The template with its placeholders replaced by columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = rest.find("{")
        if at < 0:
            parts.append(F.lit(rest))
            break
        end = rest.index("}", at)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[rest[at + 1:end]])
        rest = rest[end + 1:]
    return F.concat(*parts)


def rule_rows(issued: DataFrame) -> DataFrame:
    """``issued`` (policy_key, version, rule_kind, required_region_id, ...) with rule_id and policy_version_id, the rows that :func:`render` takes."""
    name = F.concat("policy_key", F.lit(":"), "version")
    return issued.withColumns({"rule_id": identity.stable_id("rule", name), "policy_version_id": identity.stable_id("policy_version", name)})


def render(rules: DataFrame) -> DataFrame:
    """Rules with policy_version_id, rule_kind, required_region_id, evaluation_time
    gain the rendered text and its clauses in order."""
    region, version = F.col("required_region_id"), F.col("policy_version_id")
    body = lambda section, text: F.struct(F.lit(section).alias("section"), text.alias("body"))
    fleet = F.array(body("scope", _fill(SCOPE_BODY, region=region)),
                    body("exception", _fill(EXCEPTION_BODY, time=F.col("evaluation_time"))))
    plain = F.array(body("region", _fill(REGION_BODY, region=region)))
    rows = rules.withColumn("_bodies", F.when(F.col("rule_kind") == FLEET_RULE, fleet).otherwise(plain)) \
        .withColumn("_head", _fill(HEADING, version=version)) \
        .withColumn("_at", tx.running_starts(F.transform("_bodies", lambda b: b["body"]), gap=1))

    def clause(b: Column, i: Column) -> Column:
        start = F.length("_head") + F.get("_at", i)
        return F.struct(
            identity.stable_id("policy_clause", F.concat(version, F.lit(":"), b["section"])).alias("clause_id"),
            b["section"].alias("section_id"), (i + 1).alias("order"), F.lit("rule").alias("kind"),
            start.alias("span_start"), (start + F.length(b["body"])).alias("span_end"),
            F.lit("unicode_codepoints_half_open").alias("coordinate_system"),
            identity.content_hash(identity.json_string(b["body"])).alias("content_sha256"),
            F.lit("generated_from_canonical_ast").alias("text_review_state"))

    lines = F.transform("_bodies", lambda b: F.concat(b["body"], F.lit("\n")))
    return rows.select(*rules.columns, F.concat("_head", F.array_join(lines, "")).alias("text"),
                       F.transform("_bodies", clause).alias("clauses"))


def render_violations(rendered: DataFrame) -> DataFrame:
    """Rendered policies whose spans, hashes or required words are wrong."""
    wrong = F.exists("clauses", lambda c: c["content_sha256"] != identity.content_hash(
        identity.json_string(tx.span("text", c["span_start"], c["span_end"]))))
    problem = F.when(wrong, "a clause does not match its place in the text").when(
        ~F.contains("text", F.col("required_region_id")), "the text does not name the required region").when(
        (F.col("rule_kind") == FLEET_RULE) & ~F.contains("text", F.lit(INCIDENT_TOKEN)),
        "the text lacks the exception for open incidents")
    return rendered.withColumn("violation", problem).where("violation is not null")


def bridge(members: DataFrame, bases: DataFrame, open_incidents: DataFrame) -> DataFrame:
    """Drivers whose fleet is based in the required region and who have no open incident.

    ``members``: driver_id, fleet_id; ``bases``: fleet_id, region_id,
    required_region_id; ``open_incidents``: driver_id.
    """
    premise = members.join(bases.where("region_id = required_region_id"), "fleet_id")
    return premise.join(open_incidents.select("driver_id"), "driver_id", "left_anti").select("driver_id", "fleet_id", "region_id")
