"""Memory that grows slice by slice, and summaries that are merged batch by batch, without reading history again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import stable_id
from ..sources.durable import durable
from .memory import PLAN_MARKERS, PREFERENCE_MARKERS, MemoryConfig, enters_memory, session_nodes, turn_ids, turn_nodes

#: What is known of a session and of a record after a version; rows of a later version replace those of an earlier one.
SESSIONS = "record_id string, session_id string, n bigint, last_ord bigint, event_ids array<string>, fact_ids array<string>"
RECORDS = "record_id string, build_step bigint, kept bigint, sessions bigint, preference boolean, plan boolean"
NODES = (
    "record_id string, node_id string, node_type string, content string, status string, confidence double, abstraction_level int, "
    "source_session_ids array<string>, source_turn_ids array<string>, source_event_ids array<string>, node_ord bigint, op string"
)
EDGES = "record_id string, source string, target string, edge_type string, confidence double, op string"
#: Facts that a session's abstract covers.
COVERED = 5


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of every key the row of the highest version."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("row")).select(*keys, "row.*")


def memory_delta(records: DataFrame, sessions: DataFrame, turns: DataFrame, cfg: MemoryConfig = MemoryConfig(), by: str = "session") -> dict[str, DataFrame]:
    """What a slice of turns changes: nodes and edges with an ``op`` (add or remove), and the new state rows of the
    sessions and records that it touches.

    Turns that a session already holds are ignored, so a slice may come twice. A session may come in parts: its summary
    is written anew, its abstract, whose id names the number of turns, is replaced. ``build_step`` goes up by the
    slice's sessions, or by its turns with ``by="turn"``, as far as memory doesn't hold them; what memory leaves out it
    doesn't know again."""
    if by not in ("session", "turn"):
        raise ValueError(f"slices are by session or turn, not {by}")
    held = sessions.select("record_id", "session_id", F.col("n").alias("n0"), F.col("last_ord").alias("last0"), F.col("event_ids").alias("events0"), F.col("fact_ids").alias("facts0"))
    known = turns.join(held, ["record_id", "session_id"], "left").join(records.select("record_id", F.col("kept").alias("kept0")), "record_id", "left")
    once = known.withColumn("_rn", F.row_number().over(Window.partitionBy("record_id", "event_id").orderBy("event_ord"))).where("_rn = 1").drop("_rn")
    new = durable(once.where(~F.coalesce(F.array_contains("events0", F.col("event_id")), F.lit(False))))
    order = Window.partitionBy("record_id").orderBy("event_ord", "event_id")
    kept = new.where(enters_memory(cfg)).withColumn("kept_ord", F.row_number().over(order) + F.coalesce("kept0", F.lit(0)))
    kept = durable(kept if cfg.max_event_nodes is None else kept.where(F.col("kept_ord") <= cfg.max_event_nodes))
    event, fact = turn_ids()
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("kept_ord", c))), lambda x: x[c])
    none = F.array().cast("array<string>")
    grown = (
        kept.withColumn("fact_id", fact)
        .groupBy("record_id", "session_id")
        .agg(F.count(F.lit(1)).alias("more"), F.max("kept_ord").cast("long").alias("last_ord"), ordered("event_id").alias("ids"), ordered("fact_id").alias("facts"), *[F.first(c).alias(c) for c in ("n0", "events0", "facts0")])
        .select(
            "record_id", "session_id", "n0", "facts0", (F.col("more") + F.coalesce("n0", F.lit(0))).alias("n"), "last_ord",
            F.concat(F.coalesce("events0", none), "ids").alias("event_ids"), F.slice(F.concat(F.coalesce("facts0", none), "facts"), 1, COVERED).alias("fact_ids"),
        )
    )
    grown = durable(grown)
    many = grown.where("n >= 2")
    add, remove = F.lit("add").alias("op"), F.lit("remove").alias("op")
    nodes = turn_nodes(kept).unionByName(session_nodes(many)).select("*", add)
    was = many.where("n0 >= 2").select("record_id", "session_id", F.col("n0").alias("n"), "last_ord", F.lit(None).cast("array<string>").alias("event_ids"))
    nodes = nodes.unionByName(session_nodes(was).where("node_type = 'abstract'").select("*", remove))
    derived = kept.select("record_id", fact.alias("source"), event.alias("target"), F.lit("DERIVED_FROM").alias("edge_type"), F.lit(0.6).alias("confidence"), add)

    def covers(rows, n, facts, op):
        return rows.select("record_id", stable_id("mem_abs", "record_id", "session_id", n).alias("source"), F.explode(facts).alias("target"), F.lit("ABSTRACTS").alias("edge_type"), F.lit(0.45).alias("confidence"), op)

    edges = derived.unionByName(covers(many, "n", "fact_ids", add)).unionByName(covers(many.where("n0 >= 2"), "n0", "facts0", remove))
    texts = F.lower(F.concat("speaker", F.lit(" said: "), "text"))
    says = lambda markers: F.coalesce(F.max(F.when(F.col("_kept"), texts.rlike(markers))), F.lit(False))
    marked = new.join(kept.select("record_id", "event_id", F.lit(True).alias("_kept")), ["record_id", "event_id"], "left")
    # steps count what the slice has, kept or not, but nothing that was there before
    steps = (F.countDistinct("session_id") if by == "session" else F.count(F.lit(1))).alias("steps")
    opened = F.countDistinct(F.when(F.col("_kept") & F.col("n0").isNull(), F.col("session_id"))).alias("opened")
    per = marked.groupBy("record_id").agg(steps, F.count("_kept").alias("more"), opened, says(PREFERENCE_MARKERS).alias("p"), says(PLAN_MARKERS).alias("w"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    no = lambda c: F.coalesce(c, F.lit(False))
    state = per.join(records.select("record_id", "build_step", "kept", "sessions", "preference", "plan"), "record_id", "left").select(
        "record_id", (zero("build_step") + F.col("steps")).alias("build_step"), (zero("kept") + F.col("more")).alias("kept"),
        (zero("sessions") + F.col("opened")).alias("sessions"), (no("preference") | F.col("p")).alias("preference"), (no("plan") | F.col("w")).alias("plan"),
    )
    return {"nodes": nodes, "edges": edges, "sessions": grown.select("record_id", "session_id", "n", "last_ord", "event_ids", "fact_ids"), "records": state}


class MemoryTable:
    """Memory in a folder of Parquet, a version for each slice.

    A version holds only what its slice changed. It counts once the last of its tables is written, so a slice that died
    half way is simply applied again, and a reader of version n never sees later slices."""

    SCHEMAS = {"nodes": NODES, "edges": EDGES, "sessions": SESSIONS, "records": RECORDS}

    def __init__(self, spark: SparkSession, folder: str, cfg: MemoryConfig = MemoryConfig(), by: str = "session"):
        self.spark, self.folder, self.cfg, self.by = spark, folder.rstrip("/"), cfg, by

    def version(self) -> int:
        """The last complete version; 0 before the first."""
        n = 0
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        system = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        while system.exists(path(f"{self.folder}/records/version={n + 1}/_SUCCESS")):
            n += 1
        return n

    def _rows(self, name: str, version: int | None) -> DataFrame:
        last = self.version() if version is None else version
        if last == 0:
            return self.spark.createDataFrame([], f"{self.SCHEMAS[name]}, version int")
        paths = [f"{self.folder}/{name}/version={v}" for v in range(1, last + 1)]
        return self.spark.read.schema(f"{self.SCHEMAS[name]}, version int").option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def apply(self, turns: DataFrame) -> int:
        """Adds a slice; returns its version."""
        last = self.version()
        delta = memory_delta(self.records(last), latest(self._rows("sessions", last), "record_id", "session_id"), turns, self.cfg, self.by)
        for name in ("nodes", "edges", "sessions", "records"):
            delta[name].write.mode("overwrite").parquet(f"{self.folder}/{name}/version={last + 1}")
        return last + 1

    def records(self, version: int | None = None) -> DataFrame:
        return latest(self._rows("records", version), "record_id").drop("version")

    def nodes(self, version: int | None = None) -> DataFrame:
        """The memory's nodes after a version, with the version that each is from."""
        return latest(self._rows("nodes", version), "record_id", "node_id").where("op = 'add'").drop("op")

    def edges(self, version: int | None = None) -> DataFrame:
        return latest(self._rows("edges", version), "record_id", "source", "target", "edge_type").where("op = 'add'").drop("op")

    def summaries(self, version: int | None = None) -> DataFrame:
        """M8 from the state alone."""
        text = lambda c, t: F.when(F.col(c), F.lit(t)).otherwise(F.lit(""))
        changes = F.concat(F.lit("The user provided information across "), F.col("sessions").cast("string"), F.lit(" sessions and "), F.col("kept").cast("string"), F.lit(" retained user turns."))
        return self.records(version).select(
            "record_id", F.lit("").alias("user_profile"), text("preference", "The user has expressed preferences in the conversation.").alias("stable_preferences"),
            text("plan", "The user has mentioned plans or intentions.").alias("active_plans"), changes.alias("recent_changes"), F.lit("").alias("cross_session_abstractions"),
        )


#: A mergeable summary: whatever the cut into batches and their order, merging gives the same.
TOTALS = "n bigint, sums map<string,double>, counts map<string,bigint>, failures map<string,bigint>"


def batch_totals(rows: DataFrame, keys: list[str], values: list[str], failures: str = "failure_types") -> DataFrame:
    """What a batch of judged rows adds up to by ``keys``: rows, sums and numbers of the values that are not null,
    and how often each failure occurs."""
    pairs = lambda f: F.map_from_arrays(F.array(*[F.lit(v) for v in values]), F.array(*[f(v) for v in values]))
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pairs(lambda v: F.coalesce(F.sum(v), F.lit(0)).cast("double")).alias("sums"), pairs(F.count).alias("counts"))
    kinds = rows.select(*keys, F.explode(failures).alias("_name")).groupBy(*keys, "_name").agg(F.count(F.lit(1)).alias("_value"))
    found = kinds.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias("failures"))
    empty = F.create_map().cast("map<string,bigint>")
    return per.hint("merge").join(found.hint("merge"), keys, "left").select(*keys, "n", "sums", "counts", F.coalesce("failures", empty).alias("failures"))


def merged_totals(*batches: DataFrame, keys: list[str]) -> DataFrame:
    """Several summaries as one, by addition; nothing that was judged is read again."""
    rows = batches[0]
    for more in batches[1:]:
        rows = rows.unionByName(more)
    out = rows.groupBy(*keys).agg(F.sum("n").alias("n"))
    for column, kind in (("sums", "double"), ("counts", "bigint"), ("failures", "bigint")):
        each = rows.select(*keys, F.explode(column).alias("_name", "_value")).groupBy(*keys, "_name").agg(F.sum("_value").cast(kind).alias("_value"))
        one = each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_value")))).alias(column))
        out = out.hint("merge").join(one.hint("merge"), keys, "left")
    return out.select(*keys, "n", "sums", "counts", F.coalesce("failures", F.create_map().cast("map<string,bigint>")).alias("failures"))


def averages(totals: DataFrame, values: list[str]) -> DataFrame:
    """Means of a summary, null where no value was."""
    mean = lambda v: F.when(F.col("counts")[v] > 0, F.col("sums")[v] / F.col("counts")[v]).alias(f"average_{v}")
    return totals.select(*[c for c in totals.columns if c not in ("sums", "counts")], *[mean(v) for v in values])
