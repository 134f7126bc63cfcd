"""Append-only feature log: one Parquet table per view with typed columns.

Layout: `<root>/<view>/types=<key>/part=<id>/event_date=<day>/` and, beside it, the list of parts that
count. Files are never changed: a batch that is written again goes to a new part, and one record swaps
it for the old one, also where the types have changed in between. A reader takes the parts that are
listed when it starts. Days let a time bound skip files, and rows are sorted by entity and time inside
each file. Parts of one schema lie together: those written before a feature changed its type are read
with their own types and converted.

Every batch gets a number when it is first begun and keeps it when it is written again. Rows carry it
as `batch_seq`, so (`batch_seq`, `ingest_seq`) is the order of arrival over all batches. `pack` joins
small parts; of what is written again later, the older rows in a packed part are skipped.
"""

from __future__ import annotations

import base64
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fields import as_timestamp
from tidemark.model import FeatureViewSpec
from tidemark.sources.commits import Commits, State
from tidemark.sources.tables import empty, folder_bytes, recast, types_key

PARTITIONS = [T.StructField("event_date", T.DateType())]
#: Parts below this size are joined by `pack`, into parts of about this size.
PACK_BYTES = 256 << 20
#: Size of the sketches of entities, as a power of two: a standard error of 1.6 %.
SKETCH_LOG2 = 12


def _name(path: str) -> str:
    return path.rsplit("part=", 1)[1]


def _nothing() -> State:
    return {"begun": {}, "written": {}, "cleared": 0, "parts": []}


def _apply(state: State, record: dict) -> None:
    """Add a record of the list: a batch begun, a part written, parts packed into one, or all removed."""
    kind, parts = record["kind"], state["parts"]
    if kind == "begin":
        state["begun"].setdefault(record["batch"], record["number"])
    elif kind == "write":
        seq, first = record["seqs"][0], state["written"].get(str(record["seqs"][0]), [record["number"]])[0]
        # The records of its first and its newest writing, and what that wrote.
        state["written"][str(seq)] = [first, record["number"], record["part"]["path"]]
        state["parts"] = [p for p in parts if p["seqs"] != [seq]] + [{**record["part"], "seqs": [seq], "skip": []}]
        _skip(state, seq, record["part"]["path"])
    elif kind == "pack":
        live = {p["path"]: p for p in parts}
        covered = [live[path] for path in record["covers"] if path in live]
        # A batch that was written again since the packing began counts by its newer part.
        stale = set(record["seqs"]) - {s for p in covered for s in p["seqs"] if s not in p["skip"]}
        packed = {**record["part"], "seqs": record["seqs"], "skip": sorted(stale)}
        state["parts"] = [p for p in parts if p["path"] not in record["covers"]] + [packed]
    elif kind == "clear":
        state["parts"], state["cleared"] = [], record["number"]
        for seq, (first, last, _) in state["written"].items():
            state["written"][seq] = [first, last, None]


def _skip(state: State, seq: int, path: str) -> None:
    for part in state["parts"]:
        if part["path"] != path and seq in part["seqs"] and seq not in part["skip"]:
            part["skip"].append(seq)


class FeatureLog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, view: str) -> str:
        return f"{self.root}/{view}"

    def _commits(self, view: str) -> Commits:
        return Commits(self.spark, f"{self.path(view)}/parts", _nothing, _apply)

    def _number(self, view: str, batch: str) -> int:
        """The number of a batch: the one it was first begun under."""
        commits = self._commits(view)
        known = commits.state()[0]["begun"].get(batch)
        if known is not None:
            return known
        commits.add({"kind": "begin", "batch": batch})
        return commits.state()[0]["begun"][batch]

    def append(self, spec: FeatureViewSpec, rows: DataFrame, *, now: Any, batch: str | None = None) -> int:
        """Add typed rows of a view and return how many were written.

        `created_at`, `ingest_seq`, `message_id` and `feature_keys` are filled in where the
        rows lack them; a missing event time becomes `now`. Rows without `feature_keys` set the
        features they have a column for, so that others keep their current values. A batch that is
        named again replaces what was written under its name, whatever the types were.
        """
        number = self._number(spec.name, batch or uuid.uuid4().hex)
        given = set(rows.columns)
        fill = {
            "created_at": as_timestamp(now),
            "ingest_seq": F.monotonically_increasing_id(),
            "message_id": F.lit(None).cast("string"),
            "feature_keys": F.array(*[F.lit(n) for n in spec.feature_names if n in given]).cast("array<string>"),
        }
        columns = []
        for field in spec.log_schema().fields:
            if field.name == "batch_seq":
                value = F.lit(number)
            elif field.name in given:
                value = F.col(field.name)
            else:
                value = fill.get(field.name, F.lit(None))
            columns.append(value.cast(field.dataType).alias(field.name))
        filled = rows.select(*columns).withColumn("event_timestamp", F.coalesce("event_timestamp", as_timestamp(now)))
        part = self._write(spec, filled)
        # Counted from the files, since task metrics can count a retried task twice.
        written = self.spark.read.schema(spec.log_schema()).parquet(part["path"])
        found = written.agg(
            F.count(F.lit(1)).alias("rows"),
            F.unix_micros(F.min("event_timestamp")).alias("first"),
            F.unix_micros(F.max("event_timestamp")).alias("last"),
            F.hll_sketch_agg("entity_id", SKETCH_LOG2).alias("entities"),
        ).first()
        sketch = base64.b64encode(found["entities"]).decode() if found["entities"] else None
        self._summaries(spec.name).publish(f"{_name(part['path'])}.json", {**found.asDict(), "entities": sketch})
        self._commits(spec.name).add({"kind": "write", "seqs": [number], "part": part})
        return found["rows"]

    def _summaries(self, view: str) -> Commits:
        """A file for every writing of a batch, which has a few kilobytes whatever the batch's size."""
        return Commits(self.spark, f"{self.path(view)}/summaries", dict, lambda state, record: None)

    def sketched_stats(self, view: str) -> DataFrame:
        """Rows, about how many entities, first and last event time, without reading the log.

        One summary for each batch is read; packed parts need none, and a batch that was written
        again counts as it is now. Sketches of 2 ** SKETCH_LOG2 registers merge without loss; the
        count of entities is within 5 % of the truth (three standard errors). An empty log has 0
        rows, 0 entities and no times.
        """
        state, _ = self._commits(view).state()
        paths = [f"{self.path(view)}/summaries/{_name(path)}.json" for _, _, path in state["written"].values() if path]
        schema = "rows long, first long, last long, entities binary"
        told = self.spark.read.schema(schema).json(paths) if paths else self.spark.createDataFrame([], schema)
        return told.agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("entities")), F.lit(0)).alias("about_entities"),
            F.timestamp_micros(F.min("first")).alias("min_timestamp"),
            F.timestamp_micros(F.max("last")).alias("max_timestamp"),
        )

    def _write(self, spec: FeatureViewSpec, rows: DataFrame) -> dict:
        """Write a new part, which nobody reads before it is listed."""
        types = types_key(spec.log_schema())
        target = f"{self.path(spec.name)}/types={types}/part={uuid.uuid4().hex}"
        (
            rows.withColumn("event_date", F.to_date("event_timestamp"))
            # Splits days that are large and joins days that are small.
            .hint("rebalance", "event_date")
            .sortWithinPartitions("event_date", "entity_id", "event_timestamp")
            .write.partitionBy("event_date")
            .parquet(target)
        )
        return {"path": target, "types": types, "bytes": folder_bytes(self.spark, target)}

    def _rows(self, spec: FeatureViewSpec, parts: list[dict]) -> DataFrame:
        """The rows of some parts, each under its own types and without batches written again since."""
        schema = T.StructType([*spec.log_schema().fields, *PARTITIONS])
        current = types_key(spec.log_schema())
        kinds: dict[tuple, list[str]] = {}
        for part in parts:
            kinds.setdefault((part["types"], tuple(part["skip"])), []).append(part["path"])
        log = None
        for (types, skip), paths in sorted(kinds.items()):
            reader = self.spark.read.option("basePath", f"{self.path(spec.name)}/types={types}")
            if types == current:
                found = reader.schema(schema).parquet(*paths)
            else:
                found = recast(reader.parquet(*paths), schema)
            if skip:
                found = found.where(~F.col("batch_seq").isin(list(skip)))
            found = found.select(*schema.fieldNames())
            log = found if log is None else log.unionByName(found)
        return empty(self.spark, schema) if log is None else log

    def read(self, spec: FeatureViewSpec, *, start: Any = None, end: Any = None, entity: str | None = None) -> DataFrame:
        """Rows of a view, with a time range that also skips whole days.

        Features added to the spec after a file was written read as null, and so do values that
        have no form in a type the spec has changed to.
        """
        log = self._rows(spec, self._commits(spec.name).state()[0]["parts"])
        if start is not None:
            log = log.where((F.col("event_timestamp") >= as_timestamp(start)) & (F.col("event_date") >= F.to_date(as_timestamp(start))))
        if end is not None:
            log = log.where((F.col("event_timestamp") <= as_timestamp(end)) & (F.col("event_date") <= F.to_date(as_timestamp(end))))
        if entity is not None:
            log = log.where(F.col("entity_id") == entity)
        return log.drop("event_date")

    def read_batch(self, spec: FeatureViewSpec, batch: str) -> DataFrame:
        state, _ = self._commits(spec.name).state()
        number = state["begun"].get(batch)
        parts = [p for p in state["parts"] if number in p["seqs"] and number not in p["skip"]]
        return self._rows(spec, parts).where(F.col("batch_seq") == number).drop("event_date")

    def changes(self, spec: FeatureViewSpec, since: int = 0) -> tuple[DataFrame | None, int]:
        """Rows of the batches written after the record `since`, and the newest record's number.

        Only parts that hold such batches are read; packing makes nothing new. None instead of rows
        if something that had been written by then has been replaced or removed, so that new rows
        alone do not tell what has changed.
        """
        state, newest = self._commits(spec.name).state()
        fresh = {int(seq) for seq, (_, last, _) in state["written"].items() if last > since}
        again = [first for first, last, _ in state["written"].values() if first <= since < last]
        if since and (again or state["cleared"] > since):
            return None, newest
        parts = [p for p in state["parts"] if fresh & set(p["seqs"])]
        rows = self._rows(spec, parts)
        if any(set(p["seqs"]) - fresh for p in parts):
            rows = rows.where(F.col("batch_seq").isin(sorted(fresh)))
        return rows.drop("event_date"), newest

    def pack(self, spec: FeatureViewSpec, *, target_bytes: int = PACK_BYTES) -> int:
        """Join parts below `target_bytes`, in the order of arrival, into parts of about that size.

        Returns how many parts were joined. The number of parts is bounded by the volume afterwards:
        of any two neighbours left, one at least was that large. Rows stay as they are, also for who
        is reading meanwhile; values of older types are converted. Parts that are no longer listed
        stay on disk until `vacuum`.
        """
        commits = self._commits(spec.name)
        parts, _ = commits.state()
        small = sorted((p for p in parts["parts"] if p["bytes"] < target_bytes), key=lambda p: p["seqs"][0])
        groups: list[list[dict]] = [[]]
        for part in small:
            if sum(p["bytes"] for p in groups[-1]) + part["bytes"] > target_bytes:
                groups.append([])
            groups[-1].append(part)
        joined = 0
        for group in groups:
            if len(group) > 1:
                part = self._write(spec, self._rows(spec, group).drop("event_date"))
                seqs = sorted({s for p in group for s in p["seqs"] if s not in p["skip"]})
                commits.add({"kind": "pack", "seqs": seqs, "part": part, "covers": [p["path"] for p in group]})
                joined += len(group)
        return joined

    def vacuum(self, spec: FeatureViewSpec, *, older_than_seconds: int = 7 * 86400) -> int:
        """Remove parts that are not listed any more and that nobody has begun to read since; how many.

        A part that is being written is not listed either, so the age must be longer than any write
        or read takes.
        """
        listed = {p["path"] for p in self._commits(spec.name).state()[0]["parts"]}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(spec.name)}/types=*/part=*")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        before = self.spark._jvm.System.currentTimeMillis() - 1000 * older_than_seconds
        names = {p.rsplit("/", 1)[1] for p in listed}
        old = [s.getPath() for s in fs.globStatus(path) or [] if s.getModificationTime() <= before]
        gone = [p for p in old if p.getName() not in names]
        for folder in gone:
            fs.delete(folder, True)
        return len(gone)

    def delete(self, spec: FeatureViewSpec) -> int:
        """Remove all rows of a view and return how many there were."""
        n = self.read(spec).count()
        self._commits(spec.name).add({"kind": "clear"})
        return n
