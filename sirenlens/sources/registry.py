"""The team registry: JSON documents exploded into ownership and panel tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenlens.session import materialize

OPERAND = "struct<kind:string,value:string>"
PREDICATE = (
    "struct<leaf_no:int,kind:string,field:string,op:string,negated:boolean,"
    f"operands:array<{OPERAND}>,nested:boolean,macro:boolean>"
)
VARIABLE = "struct<name:string,type:string,value:string,values:array<string>,all_selected:boolean>"
PANEL = (
    "struct<panel_id:string,schema:string,sql:string,parse_state:string,parse_error:string,"
    f"predicates:array<{PREDICATE}>,variables:array<{VARIABLE}>>"
)
TEAM = (
    "struct<team_id:string,display_name:string,v1_operators:array<string>,v2_operator:string,"
    "weekly_review:struct<enabled:boolean>,planning:struct<v1_rule_effort_days:double>,"
    f"panels:array<{PANEL}>>"
)
DOCUMENT = f"struct<registry_version:string,teams:array<{TEAM}>>"


@dataclass(frozen=True)
class Registry:
    """The registry as tables. ``teams`` carries the document's version and byte hash."""

    teams: DataFrame
    team_operators: DataFrame
    panels: DataFrame
    panel_variables: DataFrame
    panel_predicates: DataFrame


def registry_entries(documents: DataFrame) -> DataFrame:
    """One row per team entry of the registry documents in ``text``."""
    loaded = documents.select(
        F.sha2("text", 256).alias("registry_sha256"),
        F.from_json("text", DOCUMENT).alias("d"),
    )
    return loaded.select(
        "registry_sha256",
        F.col("d.registry_version").alias("registry_version"),
        F.posexplode("d.teams").alias("entry_no", "t"),
    )


def registry_tables(entries: DataFrame) -> Registry:
    teams = entries.select(
        "registry_sha256",
        "registry_version",
        "entry_no",
        F.col("t.team_id").alias("team_id"),
        F.col("t.display_name").alias("display_name"),
        F.col("t.v2_operator").alias("v2_operator"),
        F.coalesce(F.size("t.v1_operators"), F.lit(0)).alias("v1_operator_count"),
        F.coalesce(F.col("t.weekly_review.enabled"), F.lit(False)).alias("weekly_review"),
        F.col("t.planning.v1_rule_effort_days").alias("v1_rule_effort_days"),
    )
    owned = F.concat(
        F.transform(
            F.coalesce("t.v1_operators", F.array().cast("array<string>")),
            lambda o: F.struct(F.lit("v1").alias("alert_schema"), o.alias("operator")),
        ),
        F.when(
            F.col("t.v2_operator").isNotNull(),
            F.array(
                F.struct(
                    F.lit("v2").alias("alert_schema"), F.col("t.v2_operator").alias("operator")
                )
            ),
        ).otherwise(F.array().cast("array<struct<alert_schema:string,operator:string>>")),
    )
    team_operators = entries.select(
        F.col("t.team_id").alias("team_id"), F.inline(owned)
    ).distinct()
    panels = entries.select(
        F.col("t.team_id").alias("team_id"), F.posexplode("t.panels").alias("panel_no", "p")
    ).select(
        "team_id",
        "panel_no",
        F.col("p.panel_id").alias("panel_id"),
        F.col("p.schema").alias("alert_schema"),
        F.col("p.sql").alias("sql"),
        F.coalesce(F.col("p.parse_state"), F.lit("parsed")).alias("parse_state"),
        F.col("p.parse_error").alias("parse_error"),
        F.col("p.predicates").alias("predicates"),
        F.col("p.variables").alias("variables"),
    )
    keys = ("team_id", "panel_id", "alert_schema")
    return Registry(
        teams=teams,
        team_operators=team_operators,
        panels=panels.drop("predicates", "variables"),
        panel_variables=panels.select(*keys, F.inline("variables")),
        panel_predicates=panels.select(*keys, F.inline("predicates")),
    )


def registry_from_text(documents: DataFrame) -> Registry:
    return registry_tables(registry_entries(documents))


def resident(documents: DataFrame) -> Registry:
    """The registry over written entries, read once and of known size to every join."""
    return registry_tables(materialize(registry_entries(documents), "registry"))


def load_registry(spark: SparkSession, path: str) -> Registry:
    """Registry documents from files, hashed over their exact bytes."""
    files = spark.read.format("binaryFile").load(path)
    return resident(files.select(F.decode("content", "UTF-8").alias("text")))


def registry_from_string(spark: SparkSession, text: str) -> Registry:
    return resident(spark.createDataFrame([(text,)], "text string"))


def registry_problems(reg: Registry) -> DataFrame:
    """What makes a registry unusable, as rows ``(problem, subject, detail)``; empty when valid."""
    duplicate_team = (
        reg.teams.groupBy("team_id")
        .count()
        .where("count > 1")
        .select(
            F.lit("duplicate_team").alias("problem"),
            F.col("team_id").alias("subject"),
            F.col("count").cast("string").alias("detail"),
        )
    )
    no_operator = reg.teams.where(
        (F.col("v1_operator_count") == 0) & F.col("v2_operator").isNull()
    ).select(F.lit("no_operator").alias("problem"), F.col("team_id"), F.lit(None).cast("string"))
    owners = reg.team_operators.select("operator", "team_id").distinct()
    contested = (
        owners.groupBy("operator")
        .agg(F.count("*").alias("n"), F.min("team_id").alias("first_owner"))
        .where("n > 1")
        .select(
            F.lit("operator_claimed_twice"),
            F.col("operator"),
            F.concat_ws(":", "first_owner", F.col("n").cast("string")),
        )
    )
    duplicate_panel = (
        reg.panels.groupBy("team_id", "panel_id")
        .count()
        .where("count > 1")
        .select(F.lit("duplicate_panel"), F.col("panel_id"), F.col("team_id"))
    )
    duplicate_variable = (
        reg.panel_variables.groupBy("team_id", "panel_id", "name")
        .count()
        .where("count > 1")
        .select(F.lit("duplicate_variable"), F.col("name"), F.col("panel_id"))
    )
    v = F.col
    missing_value = reg.panel_variables.where(
        (v("type").isin("constant", "interval") & v("value").isNull())
        | ((v("type") == "custom") & v("values").isNull())
    ).select(F.lit("variable_without_value"), F.col("name"), F.col("panel_id"))
    return (
        duplicate_team.union(no_operator)
        .union(contested)
        .union(duplicate_panel)
        .union(duplicate_variable)
        .union(missing_value)
    )
