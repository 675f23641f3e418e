"""Update batches of actors: one table of samples from several layouts, and keys that a role must not see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a batch must not hold, for each role.
FORBIDDEN = {
    "memory_builder": ("benchmark_target_question", "benchmark_answer", "oracle_graph", "oracle_node", "oracle_edge", "generated_training_question", "question_type", "reward_report"),
    "question_agent": ("benchmark_target_question", "benchmark_answer", "test_label"),
}


def _get(v, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _list(v, path: str) -> Column:
    """The array at ``path``; without one an empty array."""
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _parsed(batches: DataFrame, json_col: str) -> Column:
    return F.try_parse_json(F.col(json_col))


def merged_samples(batches: DataFrame, role: str, json_col: str = "batch") -> DataFrame:
    """Every sample of all records' batches of ``role`` in one table, whatever the layout: (record_id, batch_ord,
    layout, entry, place, group_id, selected, sample).

    ``batches`` holds (record_id, batch_ord, ``json_col``). A batch lists ``items``, ``samples`` or ``groups`` with
    ``samples``, or several of these; ``entry`` is a sample's place in its list or its group's, ``place`` that within
    the group. A batch's role is its ``actor_role``, else ``role``; items and samples have a ``role`` too; one that
    gives none belongs. Group ids get the record's id in front. A group without samples is a row with a null sample.
    An item or sample counts as selected unless it says otherwise, a group's sample only if it says so. Texts that are
    no JSON objects have no rows."""
    v = F.col("v")
    named = F.coalesce(F.nullif(_get(v, "$.actor_role"), F.lit("")), F.nullif(_get(v, "$.role"), F.lit("")), F.lit(role))
    rows = batches.select(F.coalesce("record_id", F.lit("unknown")).alias("record_id"), "batch_ord", _parsed(batches, json_col).alias("v"))
    # read once: what follows takes the parsed text apart by column functions only
    rows = rows.where(F.schema_of_variant("v").startswith("OBJECT")).where(named == role)
    none = F.lit(None)

    def entry(layout, i, place, group, selected, sample):
        return F.struct(
            F.lit(layout).alias("layout"), i.cast("int").alias("entry"), place.cast("int").alias("place"), group.alias("group_id"),
            F.coalesce(selected, F.lit(layout != "groups")).alias("selected"), sample.alias("sample"),
        )

    def flat(layout, fallback):
        group = lambda x: F.coalesce(F.nullif(_get(x, "$.group_id"), F.lit("")), fallback)
        each = F.transform(_list(v, f"$.{layout}"), lambda x, i: entry(layout, i, none, group(x), _get(x, "$.selected_for_update", "boolean"), F.to_json(x)))
        return F.filter(each, lambda e: F.coalesce(F.get_json_object(e["sample"], "$.role"), F.lit(role)) == role)

    def of_group(g, i):
        group = F.coalesce(_get(g, "$.group_id"), F.lit(""))
        each = F.transform(_list(g, "$.samples"), lambda x, k: entry("groups", i, k, group, _get(x, "$.selected_for_update", "boolean"), F.to_json(x)))
        empty = F.array(entry("groups", i, none, group, F.lit(False), F.lit(None).cast("string")))
        return F.when(F.size(each) == 0, empty).otherwise(each)

    batch_id = F.coalesce(_get(v, "$.batch_id"), F.lit("samples"))
    grouped = F.flatten(F.transform(_list(v, "$.groups"), of_group))
    out = rows.select("record_id", "batch_ord", F.explode(F.concat(flat("items", F.lit("")), flat("samples", batch_id), grouped)).alias("e"))
    return out.select("record_id", "batch_ord", "e.layout", "e.entry", "e.place", F.concat_ws("_", "record_id", "e.group_id").alias("group_id"), "e.selected", "e.sample")


def merge_totals(merged: DataFrame) -> DataFrame:
    """What a merged batch holds: groups of the grouped layout, samples of all layouts, selected ones."""
    is_group = (F.col("layout") == "groups") & F.coalesce(F.col("place") == 0, F.lit(True))
    return merged.agg(
        F.count_if(is_group).alias("num_groups"),
        F.count("sample").alias("num_samples"),
        F.count_if(F.col("selected") & F.col("sample").isNotNull()).alias("num_selected_samples"),
    )


def unmerged(batches: DataFrame, merged: DataFrame, role: str, json_col: str = "batch") -> DataFrame:
    """(record_id, batch_ord, listed, merged) of batches of ``role`` from which samples were lost or doubled; by
    lists whose members name no other role. Empty after a sound merge."""
    v = F.col("v")
    mine = lambda path: F.size(F.filter(_list(v, path), lambda x: F.coalesce(_get(x, "$.role"), F.lit(role)) == role))
    in_groups = F.aggregate(_list(v, "$.groups"), F.lit(0), lambda n, g: n + F.size(_list(g, "$.samples")))
    named = F.coalesce(F.nullif(_get(v, "$.actor_role"), F.lit("")), F.nullif(_get(v, "$.role"), F.lit("")), F.lit(role))
    rows = batches.select(F.coalesce("record_id", F.lit("unknown")).alias("record_id"), "batch_ord", _parsed(batches, json_col).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    counts = rows.where(named == role).select("record_id", "batch_ord", (mine("$.items") + mine("$.samples") + in_groups).alias("listed"), F.lit(0).alias("merged"))
    seen = merged.where("sample is not null").select("record_id", "batch_ord", F.lit(0).alias("listed"), F.lit(1).alias("merged"))
    both = counts.unionByName(seen).groupBy("record_id", "batch_ord").agg(F.sum("listed").alias("listed"), F.sum("merged").alias("merged"))
    return both.where("listed <> merged")


def batch_violations(batches: DataFrame, role: str, row_id: str = "record_id", json_col: str = "batch") -> DataFrame:
    """(row_id, path, key) of keys that ``role`` must not see, at the places where a batch may carry them: in the
    batch itself, its groups, their samples and those samples' ``context``, its items and their ``metadata``. Deeper
    ones are left to L1. A role other than the memory builder has the question agent's list."""
    keys = FORBIDDEN.get(role, FORBIDDEN["question_agent"])

    def hits(v, path):
        found = [F.when(_get(v, f"$.{k}", "variant").isNotNull(), F.struct(F.concat(path, F.lit(f".{k}")).alias("path"), F.lit(k).alias("key"))) for k in keys]
        return F.array_compact(F.array(*found))

    at = lambda name, i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))

    def in_sample(path):
        return lambda s, j: F.concat(hits(s, F.concat(path, F.lit("."), at("samples", j))), hits(_get(s, "$.context", "variant"), F.concat(path, F.lit("."), at("samples", j), F.lit(".context"))))

    def in_group(g, i):
        return F.concat(hits(g, at("groups", i)), F.flatten(F.transform(_list(g, "$.samples"), in_sample(at("groups", i)))))

    def in_item(x, i):
        return F.concat(hits(x, at("items", i)), hits(_get(x, "$.metadata", "variant"), F.concat(at("items", i), F.lit(".metadata"))))

    v = F.col("v")
    rows = batches.select(F.col(row_id).alias("row_id"), _parsed(batches, json_col).alias("v")).where("v is not null")
    every = F.concat(hits(v, F.lit("batch")), F.flatten(F.transform(_list(v, "$.groups"), in_group)), F.flatten(F.transform(_list(v, "$.items"), in_item)))
    return rows.select("row_id", F.explode(every).alias("h")).select("row_id", "h.path", "h.key")
