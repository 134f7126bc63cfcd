"""Current-value table of a view: a compacted base plus the batches written since.

A batch never rewrites the table. It adds a delta with one merged row per entity and then
one record to the list of parts, so a batch is visible as a whole or not at all, and a batch name
that is already listed is not applied twice. Reads merge base and deltas field by field;
`compact` folds them into a new base and names the batches it covers, so a batch that another
writer lists meanwhile is still read after it. Writers do not wait for each other: each batch has
a folder of its own, and batches that took the same number count in the order of their names. Of two
compactions at once the one that is listed second does not count.

Writes compact by themselves, so that reads merge few deltas: once `COMPACT_AFTER` deltas have a
`COMPACT_SHARE` of the base's bytes between them, or when there are `MOST_DELTAS`.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fields import as_timestamp, epoch_ms, expires_at, ttl_or_default
from tidemark.model import FeatureViewSpec
from tidemark.operators.lookup import unexpired
from tidemark.operators.merge import merge_fields, since_reset
from tidemark.session import plan_bytes
from tidemark.sources.commits import Commits, State
from tidemark.sources.tables import empty, folder_bytes, recast, types_key

COMPACT_AFTER, COMPACT_SHARE, MOST_DELTAS = 16, 0.1, 128
# A base is cut into buckets of about this size, so that a lookup reads few of them.
BUCKET_BYTES = 512 << 20
MAX_BUCKETS = 4096
STATE = ["event_ts_ms", "written_at", "expires_at", "deleted"]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("int")


def _nothing() -> State:
    return {"batches": {}, "parts": []}


def _apply(state: State, record: dict) -> None:
    """Add a delta, unless its batch is listed, or a base, unless it was made of another than the newest."""
    parts = state["parts"]
    if record["kind"] == "delta":
        if record["batch"] not in state["batches"]:
            state["batches"][record["batch"]] = record["seq"]
            parts.append(record)
    elif [p["path"] for p in parts if p["kind"] == "base"] == record["over"]:
        state["parts"] = [record, *(p for p in parts if p["kind"] == "delta" and p["path"] not in record["covers"])]


class OnlineTable:
    def __init__(self, spark: SparkSession, root: str, spec: FeatureViewSpec) -> None:
        self.spark = spark
        self.spec = spec
        self.path = f"{root.rstrip('/')}/{spec.name}"
        self.features = spec.feature_names
        # Batches that were written under other types are read with their own and converted.
        self._types = types_key(spec.online_schema())

    # --- manifest ------------------------------------------------------------------------

    def _commits(self) -> Commits:
        return Commits(self.spark, f"{self.path}/manifest", _nothing, _apply)

    def _position(self, batch: str) -> tuple[int, bool]:
        """The highest number that a part has and whether `batch` is listed already."""
        state, _ = self._commits().state()
        numbers = [*state["batches"].values(), *(p["seq"] for p in state["parts"])]
        return max(numbers, default=0), batch in state["batches"]

    def _publish(self, seq: int, kind: str, path: str, **more: Any) -> None:
        size = folder_bytes(self.spark, path)
        self._commits().add({"seq": seq, "kind": kind, "path": path, "types": self._types, "bytes": size, **more})

    def _parts(self) -> list[dict]:
        """The newest base and the deltas that no base covers: what is left since a compaction."""
        return self._commits().state()[0]["parts"]

    # --- writes --------------------------------------------------------------------------

    def upsert(
        self,
        updates: DataFrame,
        *,
        now: Any,
        ttl: Column | int | None = None,
        batch: str | None = None,
        order: tuple[str, ...] = ("ingest_seq",),
    ) -> int:
        """Merge updates into the table and return how many update rows went in.

        The fields an update sets replace the current ones, the others stay; every write
        resets the time to live of the whole row.
        """
        batch = batch or uuid.uuid4().hex
        written = as_timestamp(now)
        newest = merge_fields(
            updates.withColumn("event_ts_ms", epoch_ms(F.col("event_timestamp"))),
            self.features,
            order=order,
            last=["event_ts_ms"],
            extra=[F.count("*").alias("n_updates")],
        )
        delta = (
            newest.withColumn("written_at", written)
            .withColumn("expires_at", expires_at(F.col("written_at"), ttl_or_default(ttl, self.spec.ttl_seconds)))
            .withColumn("deleted", F.lit(False))
        )
        n = self._add(delta, batch)
        self._tidy(now)
        return n

    def delete(self, entities: DataFrame, *, now: Any, batch: str | None = None) -> int:
        """Remove the current rows of the listed entities."""
        written = as_timestamp(now)
        marks = entities.select("entity_id").distinct().select(
            "entity_id",
            *[
                F.lit(None).cast(f.dataType).alias(f.name)
                for f in self.spec.online_schema().fields
                if f.name not in ("entity_id", "written_at", "deleted")
            ],
            written.alias("written_at"),
            F.lit(True).alias("deleted"),
            F.lit(1).cast("long").alias("n_updates"),
        )
        return self._add(marks, batch or uuid.uuid4().hex)

    def _add(self, delta: DataFrame, batch: str) -> int:
        newest, known = self._position(batch)
        if known:
            return 0
        seq = newest + 1
        # Folder names must not depend on what characters a batch name has. Attempts at one batch have
        # folders of their own, of which the first that is listed counts.
        path = f"{self.path}/delta/seq={seq}/part={uuid.uuid5(uuid.NAMESPACE_URL, batch).hex}-{uuid.uuid4().hex}"
        delta.sortWithinPartitions("entity_id").write.parquet(path)
        n = self.spark.read.schema("n_updates long").parquet(path).agg(F.sum("n_updates")).first()[0] or 0
        self._publish(seq, "delta", path, batch=batch)
        return n

    def _tidy(self, now: Any) -> None:
        """Compact when the deltas are many, by the rule above."""
        parts = self._parts()
        deltas = [p["bytes"] for p in parts if p["kind"] == "delta"]
        base = sum(p["bytes"] for p in parts if p["kind"] == "base")
        if len(deltas) >= COMPACT_AFTER and (sum(deltas) >= COMPACT_SHARE * base or len(deltas) >= MOST_DELTAS):
            self.compact(now=now)

    def compact(self, *, now: Any, buckets: int | None = None) -> None:
        """Fold all listed batches into a new base without the expired rows.

        The base is partitioned by a hash of the entity; large buckets become several files.
        """
        parts = self._parts()
        if not any(p["kind"] == "delta" for p in parts):
            return
        seq = max(p["seq"] for p in parts) + 1
        path = f"{self.path}/base/seq={seq}/part={uuid.uuid4().hex}"
        merged = self._merged(parts, now=now)
        buckets = buckets or max(1, min(MAX_BUCKETS, plan_bytes(merged) // BUCKET_BYTES))
        (
            merged.withColumn("bucket", _bucket(buckets))
            .hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", "entity_id")
            .write.partitionBy("bucket")
            .parquet(path)
        )
        covers = [p["path"] for p in parts if p["kind"] == "delta"]
        over = [p["path"] for p in parts if p["kind"] == "base"]
        self._publish(seq, "base", path, buckets=buckets, covers=covers, over=over)

    # --- reads ---------------------------------------------------------------------------

    def _needed(self, base: DataFrame, wanted: DataFrame | None, buckets: int) -> DataFrame:
        """The base without the buckets that hold none of the wanted entities."""
        if wanted is None or buckets == 1:
            return base
        # At most `MAX_BUCKETS` numbers, whatever the number of entities.
        hit = [r[0] for r in wanted.select(_bucket(buckets).alias("bucket")).distinct().collect()]
        return base.where(F.col("bucket").isin(hit)) if len(hit) < buckets else base

    def current(self, *, now: Any, only: DataFrame | None = None) -> DataFrame:
        """Unexpired rows at `now`; `only` restricts the entities before anything is merged."""
        return self._merged(self._parts(), now=now, only=only)

    def _merged(self, parts: list, *, now: Any, only: DataFrame | None = None) -> DataFrame:
        schema = self.spec.online_schema()
        if not parts:
            return empty(self.spark, schema)
        wanted = only.select("entity_id").distinct() if only is not None else None
        number = [T.StructField("seq", T.LongType()), T.StructField("part", T.StringType())]
        bucket = T.StructField("bucket", T.IntegerType())
        writes = None
        for kind in ("base", "delta"):
            chosen = [p for p in parts if p["kind"] == kind]
            if not chosen:
                continue
            extra = [*number, bucket] if kind == "base" else number
            full = T.StructType([*schema.fields, *extra])
            part = None
            for types in sorted({p["types"] or "" for p in chosen}):
                reader = self.spark.read.option("basePath", f"{self.path}/{kind}")
                paths = [p["path"] for p in chosen if (p["types"] or "") == types]
                same = types == self._types
                read = reader.schema(full).parquet(*paths) if same else recast(reader.parquet(*paths), full)
                part = read if part is None else part.unionByName(read)
            if kind == "base":
                # A base comes before every delta, also before one that took a lower number.
                part = self._needed(part, wanted, chosen[0]["buckets"]).drop("bucket").withColumn("seq", F.lit(0).cast("long"))
            writes = part if writes is None else writes.unionByName(part)
        if wanted is not None:
            writes = writes.join(wanted, "entity_id", "left_semi")
        if len(parts) == 1:
            merged = writes.where("not deleted")
        else:
            order = ("seq", "part")
            merged = merge_fields(since_reset(writes, order=order), self.features, order=order, last=STATE)
        return unexpired(merged.select(*schema.fieldNames()), as_timestamp(now))
