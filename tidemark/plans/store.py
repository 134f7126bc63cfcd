"""The public surface: schemas, writes, reads, statistics and refreshes of feature views."""

from __future__ import annotations

import datetime as dt
import json
import logging
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.codecs import decode_untyped
from tidemark.functions.fields import as_timestamp, stored_text
from tidemark.model import ARRIVAL, SCHEMA_VERSIONS, SPEC_TYPE, SPINE, VIEW_EVENTS, FeatureViewSpec
from tidemark.operators import registry
from tidemark.operators.asof import asof_join
from tidemark.operators.latest import latest_for_entities, latest_per_entity
from tidemark.operators.lookup import choose_features, missing_entities, online_lookup
from tidemark.operators.stats import offline_stats, online_count
from tidemark.operators.validate import parse_rows
from tidemark.plans.materialize import Materializer, utc_now
from tidemark.sources.feature_log import FeatureLog
from tidemark.sources.messages import (
    CHANGES_TOPIC,
    UPDATES_TOPIC,
    change_messages,
    check_mode,
    keyed,
    send,
    update_messages,
)
from tidemark.sources.online_table import OnlineTable
from tidemark.sources.tables import add_records, records, rows

logger = logging.getLogger(__name__)

# Kinds of problems that an error lists.
SHOWN_PROBLEMS = 10

PROPOSALS = T.StructType([T.StructField("spec", SPEC_TYPE), T.StructField("compatibility_mode", T.StringType())])


class IncompatibleSchema(ValueError):
    """A proposed schema breaks the compatibility mode it was proposed under."""


class FeatureTables:
    """All tables live under `root`, which every executor must reach.

    `updates` and `changes` are sinks for update and schema-change messages, given as
    `format` plus options; without one nothing is published.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        *,
        updates: Mapping[str, str] | None = None,
        changes: Mapping[str, str] | None = None,
    ) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.updates = updates
        self.changes = changes
        self.log = FeatureLog(spark, f"{self.root}/log")
        self.materializer = Materializer(spark, self.log, f"{self.root}/online", f"{self.root}/runs")

    # --- schemas and catalog -------------------------------------------------------------

    def versions(self) -> DataFrame:
        return records(self.spark, f"{self.root}/schema_versions", SCHEMA_VERSIONS)

    def catalog(self) -> DataFrame:
        return registry.catalog(records(self.spark, f"{self.root}/view_events", VIEW_EVENTS))

    def register_schema(
        self, spec: FeatureViewSpec, mode: str = "BACKWARD", *, now: dt.datetime | None = None
    ) -> int:
        """Register a version of a view and return its number."""
        check_mode(mode)
        proposal = self.spark.createDataFrame([(spec.as_row(), mode)], PROPOSALS)
        outcome = self._register(proposal, now or utc_now()).first()
        if not outcome["accepted"]:
            raise IncompatibleSchema(f"refused under {mode}: {'; '.join(outcome['errors'])}")
        return outcome["version"]

    def register_schemas(self, proposals: DataFrame, *, now: dt.datetime | None = None) -> DataFrame:
        """Register one proposed spec for each of many views; refused ones change nothing.

        The outcome is written once and everything else reads it back, so that versions
        and catalog cannot disagree.
        """
        names = proposals.groupBy("spec.name").count()
        if not names.where("count > 1").isEmpty():
            raise ValueError("propose one schema per view at a time")
        return self._register(proposals, now or utc_now())

    def _register(self, proposals: DataFrame, now: dt.datetime) -> DataFrame:
        decisions = f"{self.root}/decisions/batch={uuid.uuid4().hex}"
        registry.decide(self.versions(), proposals).write.parquet(decisions)
        decided = self.spark.read.parquet(decisions)
        accepted = decided.where("accepted")
        stamp = as_timestamp(now)
        new_versions = accepted.select(
            "feature_view", "version", "spec", "compatibility_mode", stamp.alias("created_at")
        )
        new_events = accepted.select(
            F.col("feature_view").alias("name"),
            "spec.entity_column",
            "spec.timestamp_column",
            F.col("version").alias("schema_version"),
            "spec.ttl_seconds",
            "spec.tags",
            "spec.description",
            F.lit(True).alias("is_active"),
            stamp.alias("changed_at"),
        )
        add_records(new_versions, f"{self.root}/schema_versions")
        add_records(new_events, f"{self.root}/view_events")
        if self.changes:
            self._publish(change_messages(registry.change_feed(accepted), now=now), self.changes, CHANGES_TOPIC)
        return decided

    def check_schema(self, spec: FeatureViewSpec) -> dict:
        """Compatibility of a spec with the newest version, without registering it."""
        proposal = self.spark.createDataFrame([(spec.as_row(), "NONE")], PROPOSALS)
        return registry.dry_run(self.versions(), proposal).first().asDict()

    def get_schema(self, view: str, version: int | None = None) -> DataFrame:
        return registry.get_schema(self.versions(), view, version)

    def list_schema_versions(self, view: str) -> DataFrame:
        return registry.list_versions(self.versions(), view)

    def latest_version_number(self, view: str) -> int | None:
        return self.versions().where(F.col("feature_view") == view).agg(F.max("version")).first()[0]

    def list_views(self) -> DataFrame:
        return registry.views_with_spec(self.catalog(), self.versions()).drop("spec").orderBy("name")

    def view_listing(self) -> DataFrame:
        return registry.view_listing(registry.views_with_spec(self.catalog(), self.versions()))

    def view_exists(self, view: str) -> bool:
        return not registry.active(self.catalog()).where(F.col("name") == view).isEmpty()

    def deactivate_view(self, view: str, *, now: dt.datetime | None = None) -> bool:
        """Retire a view and keep its data; false if there never was such a view."""
        if self.catalog().where(F.col("name") == view).isEmpty():
            return False
        event = (view, None, None, None, None, None, None, False, now or utc_now())
        add_records(rows(self.spark, [event], VIEW_EVENTS), f"{self.root}/view_events")
        return True

    def load_spec(self, view: str, version: int) -> FeatureViewSpec | None:
        found = self.versions().where((F.col("feature_view") == view) & (F.col("version") == version)).first()
        return FeatureViewSpec.from_row(found["spec"]) if found else None

    def spec(self, view: str) -> FeatureViewSpec:
        """Current spec of an active view."""
        views = self.catalog().where(F.col("name") == view)
        versions = self.versions().where(F.col("feature_view") == view)
        found = registry.views_with_spec(views, versions).select("spec").first()
        if found is None:
            raise LookupError(f"no active view '{view}'")
        return FeatureViewSpec.from_row(found["spec"])

    # --- writes --------------------------------------------------------------------------

    def source_rows(self, view: str, source: DataFrame) -> DataFrame:
        """Rows of a source table as log rows, by the column names of the view's spec."""
        spec = self.spec(view)
        return source.select(
            F.col(spec.entity_column).cast("string").alias("entity_id"),
            F.col(spec.timestamp_column).cast("timestamp").alias("event_timestamp"),
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.struct().fields],
        )

    def write_rows(
        self, view: str, typed_rows: DataFrame, *, now: dt.datetime | None = None, batch: str | None = None
    ) -> int:
        """Append typed rows to the log of a view."""
        return self.log.append(self.spec(view), typed_rows, now=now or utc_now(), batch=batch)

    def write_features(
        self,
        view: str,
        json_rows: DataFrame,
        *,
        now: dt.datetime | None = None,
        batch: str | None = None,
        producer_id: str = "api",
    ) -> int:
        """Check JSON rows, append them to the log and publish them as updates.

        One invalid row refuses the whole request before anything is written. A publishing
        failure is logged only: the log has the rows, and a refresh brings them online.
        """
        spec = self.spec(view)
        now, batch = now or utc_now(), batch or uuid.uuid4().hex
        parsed = parse_rows(json_rows, spec)
        kinds = parsed.where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))
        # The most frequent problems are shown; the counts cover all rows.
        shown = kinds.select(
            "*", F.sum("n").over(Window.partitionBy()).alias("all"), F.count("*").over(Window.partitionBy()).alias("kinds")
        )
        problems = shown.orderBy(F.desc("n"), "problem").limit(SHOWN_PROBLEMS).collect()
        if problems:
            first = problems[0]
            more = f"; and {first['kinds'] - len(problems)} more problems" if first["kinds"] > len(problems) else ""
            listed = "; ".join(f"{p['problem']} ({p['n']})" for p in problems)
            raise ValueError(f"{first['all']} rows refused for '{view}': {listed}{more}")
        typed = parsed.drop("problem").withColumn("message_id", F.uuid())
        n = self.log.append(spec, typed, now=now, batch=batch)
        if self.updates:
            # Read back, so that the messages carry the ids the log has.
            logged = self.log.read_batch(spec, batch)
            version = self.latest_version_number(view)
            messages = update_messages(
                logged, spec, schema_version=version, producer_id=producer_id, now=now, logged=True
            )
            self._publish(keyed(messages), self.updates)
        return n

    def _publish(self, keyed_rows: DataFrame, sink: Mapping[str, str], topic: str = UPDATES_TOPIC) -> None:
        try:
            send(keyed_rows, sink, topic)
        except Exception as error:
            logger.warning("publishing failed: %s", error)

    def delete_view_data(self, view: str) -> int:
        return self.log.delete(self.spec(view))

    # --- offline reads -------------------------------------------------------------------

    def spine(self, pairs: Sequence[tuple[str, dt.datetime]]) -> DataFrame:
        """A spine from a short list of pairs."""
        return self.spark.createDataFrame([(i + 1, e, t) for i, (e, t) in enumerate(pairs)], SPINE)

    def get_historical_features(
        self,
        view: str,
        spine: DataFrame,
        names: Sequence[str] | None = None,
        *,
        fill_defaults: bool = False,
        ordered: bool = False,
        **options: Any,
    ) -> DataFrame:
        """Features of each spine row as they were known at its label time.

        `fill_defaults` replaces null features of matched rows by the spec's defaults;
        `ordered` sorts by `spine_id`. Further options go to `asof_join`. Days of the log
        after the last label are not read.
        """
        spec = self.spec(view)
        chosen = choose_features(spec.feature_names, names)
        log = self.log.read(spec, end=spine.agg(F.max("label_timestamp")).scalar())
        found = asof_join(
            spine,
            log.select("entity_id", "event_timestamp", *ARRIVAL, *chosen),
            ties=ARRIVAL,
            features=chosen,
            nested="features",
            **options,
        )
        if fill_defaults:
            defaults = {f.name: f.default for f in spec.features}
            filled = [_with_default(name, spec, defaults.get(name)) for name in chosen]
            features = F.when(F.col("features").isNotNull(), F.struct(*filled))
            found = found.withColumn("features", features)
        return found.orderBy("spine_id") if ordered else found

    def latest(self, view: str, entities: DataFrame | None = None) -> DataFrame:
        """Newest log row of every entity, or of the listed ones."""
        log = self.log.read(self.spec(view))
        order = ("event_timestamp", *ARRIVAL)
        if entities is None:
            return latest_per_entity(log, order=order)
        return latest_for_entities(log, entities, order=order)

    # --- current values ------------------------------------------------------------------

    def online(self, view: str) -> OnlineTable:
        return OnlineTable(self.spark, f"{self.root}/online", self.spec(view))

    def get_online_features(
        self,
        view: str,
        ids: DataFrame,
        names: Sequence[str] | None = None,
        *,
        now: dt.datetime | None = None,
        typed: bool = True,
    ) -> tuple[DataFrame, DataFrame]:
        """Current values of the requested ids, and the ids that have none.

        With `typed=False` the values come as the text a hash store would hold, and lists as the
        numbers that this text spells.
        """
        table = self.online(view)
        current = table.current(now=now or utc_now(), only=ids)
        features = table.features
        if not typed:
            current = current.select(
                "entity_id",
                *[
                    F.when(F.array_contains("feature_keys", f.name), _untyped(c, f.dataType)).alias(f.name)
                    for f, c in zip(table.spec.struct().fields, stored_text(table.spec))
                ],
            )
        found = online_lookup(ids, current, names, features=features).where("found").drop("found")
        return found, missing_entities(ids, current)

    def delete_online_features(self, view: str, ids: DataFrame, *, now: dt.datetime | None = None) -> int:
        return self.online(view).delete(ids, now=now or utc_now())

    def feature_stats(self, view: str, *, now: dt.datetime | None = None) -> DataFrame:
        """One row of log statistics and the number of entities online."""
        offline = offline_stats(self.log.read(self.spec(view)))
        online = online_count(self.online(view).current(now=now or utc_now()), now or utc_now())
        return offline.select(F.lit(view).alias("feature_view"), "*", online.scalar().alias("online_entities"))

    def feature_stats_sketched(self, view: str) -> DataFrame:
        """Log statistics out of what was summed up at writing; entities within 5 %, the rest exact."""
        return self.log.sketched_stats(self.spec(view).name).select(F.lit(view).alias("feature_view"), "*")

    # --- refreshes -----------------------------------------------------------------------

    def materialize(self, view: str, **options: Any) -> dict:
        try:
            spec = self.spec(view)
        except LookupError:
            spec = None
        return self.materializer.run(view, spec, **options)

    def materialize_all(self, *, parallel: int = 4, **options: Any) -> list[dict]:
        """Refresh every active view; a failed one is recorded and does not stop the rest."""

        def one(view: str) -> dict:
            try:
                return self.materialize(view, **options)
            except Exception as error:
                return {"feature_view": view, "status": "failed", "error": str(error)}

        views = [r["name"] for r in registry.active(self.catalog()).select("name").orderBy("name").collect()]
        with ThreadPoolExecutor(parallel) as pool:
            return list(pool.map(inheritable_thread_target(self.spark)(one), views))

    def runs(self, view: str | None = None, job_id: str | None = None) -> DataFrame:
        return self.materializer.runs(view, job_id)


def _untyped(text: Column, dtype: T.DataType) -> Column:
    plain, numbers = decode_untyped(text)
    return numbers if isinstance(dtype, T.ArrayType) else plain


def _with_default(name: str, spec: FeatureViewSpec, default: Any) -> Any:
    value = F.col("features")[name]
    if default is not None:
        dtype = spec.struct()[name].dataType
        parsed = F.from_json(F.lit(json.dumps({"v": default})), T.StructType([T.StructField("v", dtype)]))
        value = F.coalesce(value, parsed["v"])
    return value.alias(name)
