"""Proposals that a model made about events: repaired, checked against the allowed values, tied together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import canonicalize_name, normalize_text

#: Fixed values.
ENTITY_TYPES = (
    "person", "user", "assistant", "project", "method", "paper", "code_repository", "benchmark", "dataset", "model", "metric", "task",
    "preference", "location", "time", "organization", "product", "medical_entity", "other",
)
PREDICATES = (
    "has_attribute", "has_preference", "prefers", "rejects", "uses_benchmark", "refers_to_method", "has_design_choice", "has_requirement",
    "has_problem", "has_solution", "updates_previous_choice", "asks_to_optimize", "belongs_to_project", "current_subproblem", "mentions_evidence",
    "did_action", "will_do_action", "said", "other",
)

SCHEMA = (
    "memory_worthy boolean, event_category string, importance int, topic string, reason string, "
    "entities array<struct<surface:string,canonical_name:string,entity_type:string,confidence:double>>, "
    "facts array<struct<subject:string,predicate:string,object:string,text:string,fact_type:string,temporal_scope:string,confidence:double>>"
)


def _or(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def _allowed(c: Column, values: tuple[str, ...]) -> Column:
    return F.when(c.isin(*values), c).otherwise(F.lit("other"))


def _share(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _or(c, 0.8)))


def sanitize_event_analyses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with the proposal in the JSON text ``raw``, repaired, instead of it.

    What is missing gets its default; an importance outside 1 to 5 and a confidence outside 0 to 1 go to the nearest
    bound. Types and predicates that are not allowed become ``other``; names and texts lose surplus white space. An
    entity needs a surface or a canonical name, which stands in for the other; a fact needs subject, object and text.
    ``valid`` says whether ``raw`` was a JSON object; otherwise all is default."""
    a = F.from_json(raw, SCHEMA)
    parsed = df.withColumn("_a", a).withColumn("valid", F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False)))
    none = lambda c: F.nullif(normalize_text(c), F.lit(""))

    def entity(e):
        surface, name = none(e["surface"]), none(e["canonical_name"])
        return F.struct(F.coalesce(surface, name).alias("surface"), F.coalesce(name, surface).alias("canonical_name"), _allowed(e["entity_type"], ENTITY_TYPES).alias("entity_type"), _share(e["confidence"]).alias("confidence"))

    def fact(f):
        return F.struct(
            f["subject"].alias("subject"), _allowed(f["predicate"], PREDICATES).alias("predicate"), f["object"].alias("object"), normalize_text(f["text"]).alias("text"),
            _or(f["fact_type"], "general").alias("fact_type"), _or(f["temporal_scope"], "unknown").alias("temporal_scope"), _share(f["confidence"]).alias("confidence"),
        )

    said = lambda c: _or(c, "") != ""
    entities = F.transform(F.filter(F.coalesce("_a.entities", F.array().cast("array<struct<surface:string,canonical_name:string,entity_type:string,confidence:double>>")), lambda e: e.isNotNull() & (none(e["surface"]).isNotNull() | none(e["canonical_name"]).isNotNull())), entity)
    no_facts = F.array().cast("array<struct<subject:string,predicate:string,object:string,text:string,fact_type:string,temporal_scope:string,confidence:double>>")
    facts = F.transform(F.filter(F.coalesce("_a.facts", no_facts), lambda f: f.isNotNull() & said(f["subject"]) & said(f["object"]) & said(f["text"])), fact)
    return parsed.select(
        *[c for c in df.columns if c != raw], "valid",
        _or(F.col("_a.memory_worthy"), True).alias("memory_worthy"), _or(F.col("_a.event_category"), "general").alias("event_category"),
        F.greatest(F.lit(1), F.least(F.lit(5), _or(F.col("_a.importance"), 3))).alias("importance"), F.col("_a.topic").alias("topic"),
        entities.alias("entities"), facts.alias("facts"), _or(F.col("_a.reason"), "").alias("reason"),
    )


def tied_facts(analyses: DataFrame) -> DataFrame:
    """``analyses`` with facts whose subject and object are the canonical names of entities of the same event, wherever
    they name one by its surface or by its name; ``tied`` counts the ends that do."""
    def entity_of(end):
        hit = F.filter("entities", lambda e: canonicalize_name(e["surface"]).eqNullSafe(canonicalize_name(end)) | canonicalize_name(e["canonical_name"]).eqNullSafe(canonicalize_name(end)))
        return F.try_element_at(F.transform(hit, lambda e: e["canonical_name"]), F.lit(1))

    ties = F.transform("facts", lambda f: f.withField("subject", F.coalesce(entity_of(f["subject"]), f["subject"])).withField("object", F.coalesce(entity_of(f["object"]), f["object"])))
    count = F.aggregate("facts", F.lit(0), lambda n, f: n + entity_of(f["subject"]).isNotNull().cast("int") + entity_of(f["object"]).isNotNull().cast("int"))
    return analyses.withColumn("tied", count).withColumn("facts", ties)
