"""Stream of feature updates into the log and the current-value tables.

Every micro-batch writes under its own name, so a batch that runs again after a failure
replaces its log rows and is not merged twice. Updates that cannot be applied go to a
quarantine table; they neither stop the stream nor get lost.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.fields import ttl_or_default
from tidemark.model import FeatureViewSpec
from tidemark.operators import registry
from tidemark.operators.validate import parse_rows
from tidemark.plans.materialize import utc_now
from tidemark.plans.store import FeatureTables
from tidemark.sources.online_table import OnlineTable

# Marks a TTL that is to be taken from the view.
VIEW_TTL = "view"

# Views of a batch that are written side by side.
VIEWS_AT_ONCE = 4

# What is kept of an update; `raw` is its text, for those that do not parse.
COLUMNS = [
    "message_id",
    "feature_view",
    "entity_id",
    "features",
    "event_timestamp",
    "schema_version",
    "produced_at",
    "logged",
    "ingest_seq",
    "raw",
]


def distinct_messages(updates: DataFrame, within: str) -> DataFrame:
    """Drop repeated message ids that arrive up to `within` apart, by production time."""
    return updates.withWatermark("produced_at", within).dropDuplicatesWithinWatermark(["message_id"])


def _numbered(updates: DataFrame) -> DataFrame:
    """Streaming rows with their place in the order of reading; streams have no built-in row number."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            yield batch.append_column("ingest_seq", pa.array(range(at, at + batch.num_rows), pa.int64()))
            at += batch.num_rows

    schema = T.StructType([*updates.schema.fields, T.StructField("ingest_seq", T.LongType())])
    return updates.mapInArrow(number, schema)


def apply_batch(
    store: FeatureTables,
    batch: DataFrame,
    name: str,
    *,
    now: dt.datetime,
    ttl: int | str | None = VIEW_TTL,
) -> None:
    """Write one batch of update messages to log, current values and quarantine.

    `ttl=None` uses the global default for every view, a number that many seconds.
    """
    if "ingest_seq" not in batch.columns:
        batch = batch.withColumn("ingest_seq", F.monotonically_increasing_id())
    for name_, kind in (("raw", "string"), ("schema_version", "int")):
        if name_ not in batch.columns:
            batch = batch.withColumn(name_, F.lit(None).cast(kind))
    batch = batch.select(*COLUMNS).persist()
    kept = [batch]
    try:
        specs, older = _specs_of(store, batch)
        known = F.coalesce(F.col("feature_view").isin(list(specs)), F.lit(False))
        refused = batch.where(~known).select(*COLUMNS, F.lit("no such view").alias("problem"))

        def one(view: str) -> DataFrame:
            # Log, current values and quarantine each read the checked rows; unkept, each would parse all
            # payloads again, and a filter on `problem` several times for each row.
            checked = _checked(batch.where(F.col("feature_view") == view), specs[view], older.get(view, {})).persist()
            kept.append(checked)
            _write(store, specs[view], checked.where("problem IS NULL"), name, now, ttl)
            return checked.where("problem IS NOT NULL").withColumn("features", F.col("payload")).select(*COLUMNS, "problem")

        # Views are independent of each other; a few are written side by side.
        with ThreadPoolExecutor(VIEWS_AT_ONCE) as pool:
            for bad in pool.map(inheritable_thread_target(store.spark)(one), sorted(specs)):
                refused = refused.unionByName(bad)
        refused.write.mode("overwrite").parquet(f"{store.root}/quarantine/batch={name}")
    finally:
        for rows in kept:
            rows.unpersist()


def _specs_of(store: FeatureTables, batch: DataFrame) -> tuple[dict[str, FeatureViewSpec], dict[str, dict[int, list[str]]]]:
    """Current specs of the active views in a batch, and the feature names of the older versions
    that some of its messages were written under."""
    seen = batch.select(F.col("feature_view").alias("name"), F.col("schema_version").alias("written_under")).distinct()
    seen = seen.where(F.col("name").isNotNull())
    versions = store.versions()
    views = registry.views_with_spec(store.catalog(), versions).select("name", "spec", "schema_version")
    used = views.join(seen, "name")
    under = versions.select(
        F.col("feature_view").alias("name"), F.col("version").alias("written_under"), F.col("spec.features.name").alias("names")
    )
    found = used.join(under, ["name", "written_under"], "left").collect()
    specs = {r["name"]: FeatureViewSpec.from_row(r["spec"]) for r in found}
    older: dict[str, dict[int, list[str]]] = {}
    for r in found:
        if r["names"] is not None and r["written_under"] != r["schema_version"]:
            older.setdefault(r["name"], {})[r["written_under"]] = r["names"]
    return specs, older


def _checked(messages: DataFrame, spec: FeatureViewSpec, older: Mapping[int, list[str]]) -> DataFrame:
    """Messages against the current spec; what an older version had and the spec has dropped is ignored."""
    retired = None
    for version, names in sorted(older.items()):
        known = F.array(*[F.lit(n) for n in names]).cast("array<string>")
        under = F.col("schema_version") == version
        retired = F.when(under, known) if retired is None else retired.when(under, known)
    checked = parse_rows(messages.withColumn("payload", F.col("features")), spec, retired=retired)
    untimed = F.col("event_timestamp").isNull()
    return checked.withColumn("problem", F.when(untimed, "no event time").otherwise(F.col("problem")))


def _write(
    store: FeatureTables, spec: FeatureViewSpec, rows: DataFrame, name: str, now: dt.datetime, ttl: int | str | None
) -> None:
    # Rows that the writer has put into the log already are not appended again.
    new = rows.where(~F.coalesce("logged", F.lit(False)))
    store.log.append(spec, new, now=now, batch=name)
    table = OnlineTable(store.spark, f"{store.root}/online", spec)
    seconds = ttl_or_default(spec.ttl_seconds if ttl == VIEW_TTL else ttl)
    table.upsert(rows, now=now, ttl=seconds, batch=name)


def propagate(
    store: FeatureTables,
    updates: DataFrame,
    checkpoint: str,
    *,
    query: str = "updates",
    ttl: int | str | None = VIEW_TTL,
    dedupe_within: str | None = None,
    clock: Callable[[], dt.datetime] = utc_now,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Start the stream. `updates` are message columns as `read_updates` gives them, with
    the arrival order in `ingest_seq` if there is one; `clock` sets each batch's write time.
    """
    if dedupe_within:
        if "ingest_seq" not in updates.columns:
            # Numbered before the shuffle, which does not keep the order of arrival.
            updates = _numbered(updates)
        updates = distinct_messages(updates, dedupe_within)

    def each(batch: DataFrame, batch_id: int) -> None:
        apply_batch(store, batch, f"{query}-{batch_id}", now=clock(), ttl=ttl)

    writer = updates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
