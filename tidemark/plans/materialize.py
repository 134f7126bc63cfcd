"""Batch refresh of current-value tables from the log, and its run records.

A refresh of the whole log picks the newest row of every entity. An incremental one keeps those rows
and the number of the last log record it has seen: it reads the batches written since, late rows
among them, and writes the entities whose newest row is a new one.
"""

from __future__ import annotations

import datetime as dt
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import ARRIVAL, RUNS, FeatureViewSpec
from tidemark.operators.latest import latest_in_range, latest_per_entity, ordering
from tidemark.sources.commits import Commits, State
from tidemark.sources.feature_log import FeatureLog
from tidemark.sources.online_table import OnlineTable
from tidemark.sources.tables import add_records, empty, records, rows, types_key

NEWEST = ("event_timestamp", *ARRIVAL)
#: Parts of the kept newest rows that are merged by reading before they are joined.
KEPT_PARTS = 8


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def newest_rows(
    log: DataFrame, *, start: Any = None, end: Any = None, as_of_end: bool = False
) -> DataFrame:
    """What a refresh writes: the newest row per entity that lies in the range."""
    return latest_in_range(log, start=start, end=end, as_of_end=as_of_end, order=NEWEST)


def _nothing() -> State:
    return {"mark": 0, "types": None, "parts": []}


def _apply(state: State, record: dict) -> None:
    # Of two refreshes at once the second starts from a mark that is gone; the next one repeats its work.
    if record["over"] == state["mark"]:
        state.update(mark=record["mark"], types=record["types"], parts=record["parts"])


class NewestRows:
    """The newest log row of every entity of a view, brought up to date batch by batch."""

    def __init__(self, log: FeatureLog, root: str, spec: FeatureViewSpec) -> None:
        self.log = log
        self.spec = spec
        self.path = f"{root.rstrip('/')}/{spec.name}"
        self._commits = Commits(log.spark, f"{self.path}/marks", _nothing, _apply)

    def _rows(self, parts: list[str]) -> DataFrame:
        schema = self.spec.log_schema()
        return self.log.spark.read.schema(schema).parquet(*parts) if parts else empty(self.log.spark, schema)

    def read(self) -> DataFrame:
        return latest_per_entity(self._rows(self._commits.state()[0]["parts"]), order=NEWEST)

    def advance(self) -> tuple[DataFrame, dict]:
        """The rows that have become the newest of their entities, and the record to `keep` then.

        Log batches seen before are not read again, unless one of them has been replaced or the
        view's types have changed: then all are. One row per entity leaves each task, and of the
        kept rows only those of the entities concerned are merged.
        """
        state, _ = self._commits.state()
        over, types = state["mark"], types_key(self.spec.log_schema())
        fresh, mark = self.log.changes(self.spec, over) if state["types"] == types else (None, 0)
        parts = state["parts"]
        if fresh is None:
            parts, (fresh, mark) = [], self.log.changes(self.spec)
        path = f"{self.path}/part={uuid.uuid4().hex}"
        latest_per_entity(fresh, order=NEWEST).select(*self.spec.log_schema().fieldNames()).write.parquet(path)
        new = self._rows([path])
        winners = new
        if parts:
            known = self._rows(parts).join(new.select("entity_id"), "entity_id", "left_semi")
            before = known.groupBy("entity_id").agg(F.max(ordering(NEWEST)).alias("_before"))
            joined = new.join(before, "entity_id", "left")
            winners = joined.where(F.col("_before").isNull() | (ordering(NEWEST) > F.col("_before"))).drop("_before")
        return winners, {"over": over, "mark": mark, "types": types, "parts": [*parts, path]}

    def keep(self, record: dict) -> None:
        """Make the outcome of `advance` the state; what failed before this is done again."""
        if len(record["parts"]) > KEPT_PARTS:
            path = f"{self.path}/part={uuid.uuid4().hex}"
            joined = latest_per_entity(self._rows(record["parts"]), order=NEWEST)
            joined.select(*self.spec.log_schema().fieldNames()).write.parquet(path)
            record = {**record, "parts": [path]}
        self._commits.add(record)


class Materializer:
    def __init__(self, spark: SparkSession, log: FeatureLog, online_root: str, runs_path: str) -> None:
        self.spark = spark
        self.log = log
        self.online_root = online_root
        self.runs_path = runs_path

    def run(
        self,
        view: str,
        spec: FeatureViewSpec | None,
        *,
        start: Any = None,
        end: Any = None,
        as_of_end: bool = False,
        incremental: bool = False,
        now: dt.datetime | None = None,
    ) -> dict:
        """Refresh one view; failures are recorded and raised.

        An incremental refresh reads the log batches since the last one and writes the entities
        whose newest row has changed; the others keep their time to live. It takes no range.
        """
        if incremental and (start is not None or end is not None or as_of_end):
            raise ValueError("an incremental refresh takes no range")
        now = now or utc_now()
        job = {
            "job_id": str(uuid.uuid4()),
            "feature_view": view,
            "start_time": start,
            "end_time": end,
            "status": "running",
            "entities_materialized": 0,
            "created_at": now,
            "completed_at": None,
            "error": None,
        }
        self._record(job)
        try:
            if spec is None:
                raise LookupError(f"no active view '{view}'")
            table = OnlineTable(self.spark, self.online_root, spec)
            batch = f"run-{job['job_id']}"
            if incremental:
                kept = self.newest(spec)
                newest, record = kept.advance()
                count = table.upsert(newest, now=now, batch=batch)
                kept.keep(record)
            else:
                # Only a cut at `end` may drop log rows before the newest one is picked.
                log = self.log.read(spec, end=end if as_of_end else None)
                count = table.upsert(newest_rows(log, start=start, end=end), now=now, batch=batch)
            job.update(status="completed", entities_materialized=count)
        except Exception as error:
            job.update(status="failed", error=str(error))
            raise
        finally:
            job["completed_at"] = max(utc_now(), now) if now.tzinfo else utc_now()
            self._record(job)
        return job

    def newest(self, spec: FeatureViewSpec) -> NewestRows:
        """The newest rows that incremental refreshes of a view keep."""
        return NewestRows(self.log, f"{self.online_root}-newest", spec)

    def _record(self, job: dict) -> None:
        values = tuple(job[name] for name in RUNS.fieldNames())
        add_records(rows(self.spark, [values], RUNS), self.runs_path)

    def runs(self, view: str | None = None, job_id: str | None = None) -> DataFrame:
        """One row per run in its newest state, newest run first."""
        return current_runs(records(self.spark, self.runs_path, RUNS), view, job_id)


def current_runs(states: DataFrame, view: str | None = None, job_id: str | None = None) -> DataFrame:
    """Fold run records to the newest state of each run, by view or id, newest run first."""
    if view is not None:
        states = states.where(F.col("feature_view") == view)
    if job_id is not None:
        states = states.where(F.col("job_id") == job_id)
    state = F.struct(*[c for c in states.columns if c != "job_id"])
    newest = F.max_by(state, F.struct(F.col("completed_at").isNotNull(), "completed_at"))
    return (
        states.groupBy("job_id").agg(newest.alias("_s")).select("job_id", "_s.*").orderBy(F.desc("created_at"), "job_id")
    )
