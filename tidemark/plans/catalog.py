"""The registered queries: every operator over the benchmark tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.codecs import decode_untyped, decode_value, encode_value
from tidemark.functions.fields import epoch_ms, expires_at, parse_payload, ttl_or_default
from tidemark.model import SCHEMA_CHANGE_MESSAGE, UPDATE_MESSAGE, Feature, FeatureViewSpec
from tidemark.operators import registry
from tidemark.operators.asof import asof_join
from tidemark.operators.compat import audit, check_compatibility, spec_diff
from tidemark.operators.latest import latest_for_entities, latest_in_range, latest_per_entity, within
from tidemark.operators.lookup import (
    choose_features,
    delete_entities,
    missing_entities,
    online_lookup,
    unexpired,
    wide_listing,
)
from tidemark.operators.merge import merge_fields
from tidemark.operators.positions import with_positions
from tidemark.operators.stats import offline_stats, offline_stats_by_view, online_count, view_stats
from tidemark.operators.validate import parse_rows, unknown_features
from tidemark.plans.materialize import current_runs
from tidemark.plans.store import FeatureTables
from tidemark.plans.views import (
    CUSTOMER_ORDERS,
    USER_ACTIVITY,
    of_type,
    payload_k,
    schema_versions,
    table,
    user_activity,
    view_events,
)
from tidemark.session import pinned, scratch_path, stored
from tidemark.sources.feature_log import FeatureLog
from tidemark.sources.messages import (
    change_messages,
    keyed,
    read_feature_rows,
    read_spine,
    spine_from_arrays,
    update_messages,
)
from tidemark.streaming.propagate import apply_batch, propagate

Query = Callable[[SparkSession, str], DataFrame]

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
NOW = dt.datetime(2024, 1, 30, 12, 0, 0)
WINDOW = (dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 29, 12, 0, 0))
ACTIVITY = USER_ACTIVITY.feature_names
ORDER_FEATURES = CUSTOMER_ORDERS.feature_names


def ntz(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def labels(activity: DataFrame, shift: str | None = None) -> DataFrame:
    """A spine out of events: their times are the label times."""
    at = F.col("ts") + F.expr(shift) if shift else F.col("ts")
    return activity.select(F.col("event_id").alias("spine_id"), "user_id", at.alias("label_timestamp"))


def activity_join(spine: DataFrame, log: DataFrame, names: list[str], **options: object) -> DataFrame:
    return asof_join(spine, log, by="user_id", log_ts="ts", ties=["event_id"], features=names, **options)


# --- point in time -----------------------------------------------------------------------


def pit_user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = user_activity(spark, sf_dir)
    return activity_join(labels(of_type(activity, "error")), of_type(activity, "click"), ["value", "k"])


def pit_orders_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    spine = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "o_custkey", F.col("l_shipdate").alias("label_timestamp")
    )
    log = orders.select("o_custkey", "o_orderdate", "o_orderkey", *ORDER_FEATURES)
    return asof_join(
        spine, log, by="o_custkey", log_ts="o_orderdate", ties=["o_orderkey"], features=ORDER_FEATURES
    )


def pit_before_any_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), ntz(dt.datetime(1994, 12, 31)).alias("label_timestamp")
    )
    orders = table(spark, sf_dir, "orders")
    return asof_join(
        spine, orders, by="o_custkey", log_ts="o_orderdate", ties=["o_orderkey"], features=ORDER_FEATURES
    )


def pit_day_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = user_activity(spark, sf_dir)
    return activity_join(labels(activity, "INTERVAL '-1' DAY"), activity, ACTIVITY)


def pit_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = user_activity(spark, sf_dir)
    return activity_join(labels(activity), activity, ACTIVITY)


def pit_duplicate_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = user_activity(spark, sf_dir)
    spine = labels(of_type(activity, "error", "signup"))
    return activity_join(spine.unionAll(spine), of_type(activity, "purchase"), ["value"])


def pit_feature_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = user_activity(spark, sf_dir)
    names = choose_features(ACTIVITY, ["k", "not_a_feature", "event_type"])
    return activity_join(labels(of_type(activity, "view")), of_type(activity, "click", "signup"), names)


def pit_hot_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five entities hold everything, so each is cut into time slices."""
    activity = user_activity(spark, sf_dir)
    spine = activity.select(
        F.col("event_id").alias("spine_id"),
        "event_type",
        (F.col("ts") + F.expr("INTERVAL '-1' HOUR")).alias("label_timestamp"),
    )
    return asof_join(
        spine,
        activity.select("event_type", "ts", "event_id", "user_id", "k"),
        by="event_type",
        log_ts="ts",
        ties=["event_id"],
        features=["user_id", "k"],
        strategy="window",
        hot_rows=500,
    )


def pit_one_hot_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events belong to one entity that has just more rows than one task is to sort."""
    activity = user_activity(spark, sf_dir).withColumn("all", F.lit("all"))
    spine = of_type(activity, "error").select(F.col("event_id").alias("spine_id"), "all", F.col("ts").alias("label_timestamp"))
    log = of_type(activity, "click", "purchase").select("all", "ts", "event_id", "value", "k")
    rows = spine.count() + log.count()
    return asof_join(
        spine, log, by="all", log_ts="ts", ties=["event_id"], features=["value", "k"], strategy="window", hot_rows=rows - 1
    )


def pit_short_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for a few entities out of the whole log; the log is not shuffled for it."""
    pairs = [(i, u, dt.datetime(2024, 1, 5 + 5 * i, 12)) for i in range(5) for u in (1, 2, 3)]
    spine = spark.createDataFrame(pairs, "spine_id long, user_id long, label_timestamp timestamp_ntz")
    return activity_join(spine, user_activity(spark, sf_dir), ACTIVITY)


def pit_monthly_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few label instants against the whole order log, which stays where it is."""
    orders = table(spark, sf_dir, "orders")
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    spine = orders.select("o_orderpriority", month.alias("label_timestamp")).distinct()
    log = orders.select("o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")
    return asof_join(
        spine,
        log,
        by="o_orderpriority",
        log_ts="o_orderdate",
        ties=["o_orderkey"],
        features=["o_totalprice", "o_orderstatus"],
        strategy="marks",
    )


def pit_array_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spines given as parallel arrays of ids and times, numbered by position."""
    activity = user_activity(spark, sf_dir)
    arrays = of_type(activity, "purchase").select(
        "event_id",
        F.array(F.col("user_id"), F.col("user_id") + 1, F.col("user_id")).alias("ids"),
        F.array(F.col("ts"), F.col("ts"), F.col("ts") + F.expr("INTERVAL '-2' DAY")).alias("times"),
    )
    spine = spine_from_arrays(arrays, "ids", "times").withColumnRenamed("entity_id", "user_id")
    log = of_type(activity, "view").withColumnRenamed("event_id", "seq")
    return asof_join(spine, log, by="user_id", log_ts="ts", ties=["seq"], features=["value"])


# --- latest rows and refreshes -----------------------------------------------------------


def latest_activity(spark: SparkSession, sf_dir: str, **options: object) -> DataFrame:
    """JSON is parsed for the newest rows only."""
    columns = ["ts", "event_id", "value", "event_type", "props"]
    events = table(spark, sf_dir, "events")
    newest = latest_in_range(events, by="user_id", ts="ts", order=["ts", "event_id"], columns=columns, **options)
    return newest.withColumn("k", payload_k()).drop("props")


def latest_activity_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_activity(spark, sf_dir)


def latest_order_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return latest_per_entity(orders, by="o_custkey", order=["o_orderdate", "o_orderkey"])


def latest_for_entities_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return latest_for_entities(
        table(spark, sf_dir, "orders"),
        wanted.withColumnRenamed("c_custkey", "o_custkey"),
        by="o_custkey",
        order=["o_orderdate", "o_orderkey"],
    )


def latest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    newest = latest_per_entity(vectors, by="label", order=["vec_id"])
    return newest.select(
        "label",
        "vec_id",
        F.size("embedding").cast("long").alias("dims"),
        F.element_at("embedding", 1).alias("first_value"),
        F.element_at("embedding", -1).alias("last_value"),
    )


def materialize_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_activity(spark, sf_dir, start=ntz(WINDOW[0]), end=ntz(WINDOW[1]))


def materialize_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_activity(spark, sf_dir, start=ntz(WINDOW[0]), end=ntz(WINDOW[1]), as_of_end=True)


def materialize_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register the view, load the log, refresh the current values and read them back."""
    store = FeatureTables(spark, scratch_path(spark, "materialize"))
    store.register_schema(USER_ACTIVITY, now=NOW)
    activity = user_activity(spark, sf_dir)
    typed = store.source_rows("user_activity", activity).withColumn("ingest_seq", F.monotonically_increasing_id())
    store.write_rows("user_activity", typed, now=NOW, batch="load")
    store.materialize("user_activity", start=WINDOW[0], now=NOW)
    return online_columns(store)


def online_columns(store: FeatureTables) -> DataFrame:
    current = store.online("user_activity").current(now=NOW)
    return current.select(
        F.col("entity_id").cast("long").alias("user_id"),
        *ACTIVITY,
        "event_ts_ms",
        F.unix_seconds("expires_at").alias("expires_s"),
    )


# --- current values ----------------------------------------------------------------------


def current_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_fields(
        user_activity(spark, sf_dir), ACTIVITY, by="user_id", order=["ingest_seq"], last=["ts"]
    ).drop("feature_keys")


def field_merge_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_fields(user_activity(spark, sf_dir), ACTIVITY, by="user_id", order=["ingest_seq"])
    return merged.withColumn("feature_keys", F.array_join("feature_keys", ","))


def field_merge_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_fields(user_activity(spark, sf_dir), ACTIVITY, by="user_id", order=["ts", "event_id"])
    return merged.withColumn("feature_keys", F.array_join("feature_keys", ","))


def requested_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers ask; users without activity are missing."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")


def online_lookup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = current_values(spark, sf_dir)
    return online_lookup(requested_ids(spark, sf_dir), values, by="user_id", features=ACTIVITY)


def online_feature_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = current_values(spark, sf_dir)
    ids = requested_ids(spark, sf_dir)
    return online_lookup(ids, values, ["k", "unknown"], by="user_id", features=ACTIVITY).where("found").drop("found")


def missing_entities_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_entities(requested_ids(spark, sf_dir), current_values(spark, sf_dir), by="user_id")


def delete_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = requested_ids(spark, sf_dir).where("c_mktsegment = 'BUILDING'")
    return delete_entities(current_values(spark, sf_dir), gone, by="user_id")


def expiring_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest rows with a time to live in hours from `k`, where 0 stands for the default."""
    newest = latest_activity(spark, sf_dir)
    ttl = F.when(F.col("k") < 30, 0).otherwise(F.col("k") * 3600).cast("int")
    return newest.withColumn("expires_at", expires_at(F.col("ts"), ttl_or_default(ttl)))


def online_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = epoch_ms(F.col("ts").cast("timestamp"))
    return expiring_values(spark, sf_dir).select("user_id", "k", "expires_at", ms.alias("event_ts_ms"))


def online_unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unexpired(expiring_values(spark, sf_dir), ntz(NOW))


def online_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_count(expiring_values(spark, sf_dir), ntz(NOW))


def wide_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_listing(
        table(spark, sf_dir, "events"), EVENT_TYPES, by="user_id", key="event_type", value="value", order=["ts", "event_id"]
    )


# --- statistics --------------------------------------------------------------------------


def offline_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline_stats(table(spark, sf_dir, "events"), entity="user_id", ts="ts")


def offline_stats_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline_stats_by_view(table(spark, sf_dir, "events"), view="event_type", entity="user_id", ts="ts")


def view_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    online = online_count(expiring_values(spark, sf_dir), ntz(NOW), by=["event_type"])
    return view_stats(offline_stats_views(spark, sf_dir), online, view="event_type")


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records as large as the order table: each order starts a run, most finish."""
    orders = table(spark, sf_dir, "orders")
    started = orders.select(
        F.col("o_orderkey").cast("string").alias("job_id"),
        F.concat(F.lit("view_"), F.col("o_custkey")).alias("feature_view"),
        F.lit("running").alias("status"),
        F.lit(0).cast("long").alias("entities_materialized"),
        F.col("o_orderdate").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"),
    )
    done = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count("*").alias("n"), F.max("l_shipdate").alias("at"))
        .join(orders.where("o_orderstatus <> 'O'"), "o_orderkey")
        .select(
            F.col("o_orderkey").cast("string").alias("job_id"),
            F.concat(F.lit("view_"), F.col("o_custkey")).alias("feature_view"),
            F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"),
            F.when(F.col("o_orderstatus") == "F", F.col("n")).otherwise(0).alias("entities_materialized"),
            F.col("o_orderdate").alias("created_at"),
            F.col("at").alias("completed_at"),
        )
    )
    return current_runs(started.unionByName(done))


# --- rows, values and messages -----------------------------------------------------------


def raw_payload(activity: DataFrame) -> DataFrame:
    """Events as JSON updates; the error type carries a name no schema has."""
    payload = (
        F.when(F.col("event_type") == "error", F.to_json(F.struct("k", F.col("value").alias("severity"))))
        .when(F.col("event_type") == "view", F.to_json(F.struct("event_type")))
        .when(F.col("event_type") == "click", F.to_json(F.struct("event_type", "k")))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct("value", "event_type")))
        .otherwise(F.to_json(F.struct("value", "event_type", "k")))
    )
    return activity.select(
        "event_id", F.col("user_id").cast("string").alias("entity_id"), "ts", "ingest_seq", "event_type", payload.alias("features")
    )


def unknown_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_payload(user_activity(spark, sf_dir))
    names = unknown_features(F.json_object_keys("features"), ACTIVITY)
    return raw.select("event_id", F.array_join(names, ",").alias("unknown"))


def validate_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_payload(user_activity(spark, sf_dir)).drop("event_type")
    parsed = parse_rows(raw, USER_ACTIVITY)
    return parsed.select("event_id", F.size("feature_keys").cast("long").alias("n_keys"), *ACTIVITY, "problem")


def typed_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = user_activity(spark, sf_dir)
    k, kind = F.col("k").cast("string"), F.col("event_type")
    raw = (
        F.when(kind == "click", k)
        .when(kind == "view", F.concat(F.lit(" "), k, F.lit(" ")))
        .when(kind == "purchase", F.concat(k, F.lit(".5")))
        .when(kind == "signup", F.when(F.col("k") < 50, "Yes").otherwise("FALSE"))
        .otherwise(F.concat(F.lit("["), k, F.lit(", "), F.col("user_id").cast("string"), F.lit("]")))
    )
    text = activity.select("event_id", raw.alias("raw"))
    numbers = decode_value(F.col("raw"), "list_int64")
    return text.select(
        "event_id",
        decode_value(F.col("raw"), "float64").alias("as_float"),
        decode_value(F.col("raw"), "int64").alias("as_int"),
        decode_value(F.col("raw"), "bool").alias("as_bool"),
        F.get(numbers, F.lit(0)).alias("list_first"),
        F.get(numbers, F.lit(1)).alias("list_second"),
    )


def text_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity = user_activity(spark, sf_dir).withColumn("high", F.col("k") > 50)
    activity = activity.withColumn("pair", F.array("k", "user_id")).withColumn(
        "maybe", F.when(F.col("event_type") == "click", F.col("k"))
    )
    cells = ["event_type", "k", "high", "pair", "maybe", "value"]
    return activity.select(
        "event_id", *[encode_value(F.col(c), activity.schema[c].dataType).alias(f"{c}_text") for c in cells]
    )


def update_message_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates as keyed JSON messages, parsed again as the stream does."""
    rows = user_activity(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("message_id"),
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("ts").alias("event_timestamp"),
        "feature_keys",
        *ACTIVITY,
    )
    sent = keyed(update_messages(rows, USER_ACTIVITY, schema_version=3, now=NOW))
    received = sent.select("key", F.from_json("value", UPDATE_MESSAGE).alias("m"))
    parsed = received.select(
        "key",
        F.col("m.message_id").cast("long").alias("message_id"),
        "m.feature_view",
        "m.schema_version",
        "m.producer_id",
        parse_payload(F.col("m.features"), USER_ACTIVITY).alias("payload"),
    )
    return parsed.select(*parsed.columns[:-1], "payload.*")


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as files of JSON lines and read back as feature rows."""
    events = table(spark, sf_dir, "events")
    path = scratch_path(spark, "json-rows")
    events.select(
        F.col("event_id").cast("string").alias("entity_id"),
        F.struct("user_id", "event_type").alias("features"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("event_timestamp"),
    ).write.json(path)
    return read_feature_rows(spark, path).select(
        F.col("entity_id").cast("long").alias("event_id"),
        F.get_json_object("features", "$.user_id").cast("long").alias("user_id"),
        F.get_json_object("features", "$.event_type").alias("event_type"),
        F.col("event_timestamp").cast("timestamp_ntz").alias("ts"),
    )


def array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as one spine file `[[id, time], …]` for each type, and read back with positions.

    The ids hold quotes, backslashes and brackets.
    """
    path = scratch_path(spark, "array-file")
    of_file = Window.partitionBy("event_type").orderBy("event_id")
    pair = F.to_json(
        F.array(
            F.concat(F.lit('"}],[{\\'), F.col("event_id").cast("string")),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        )
    )
    events = table(spark, sf_dir, "events").where(F.col("event_type").isNotNull())
    head = F.when(F.row_number().over(of_file) == 1, "[").otherwise("")
    tail = F.when(F.lead("event_id").over(of_file).isNull(), "]").otherwise(",")
    lines = events.select("event_type", F.concat(head, pair, tail).alias("value"))
    lines.write.partitionBy("event_type").text(path)
    return read_spine(spark, path).select(
        F.col("spine_id").alias("position"),
        F.substring_index("entity_id", "\\", -1).cast("long").alias("event_id"),
        F.col("label_timestamp").cast("timestamp_ntz").alias("ts"),
    )


def typed_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates some of which carry values that do not fit their types."""
    activity = user_activity(spark, sf_dir)
    payload = (
        F.when(F.col("event_type") == "click", F.to_json(F.struct((F.col("k") + 0.5).alias("k"))))
        .when(F.col("event_type") == "view", F.to_json(F.struct(F.col("event_type").alias("value"))))
        .otherwise(F.to_json(F.struct("k", "value")))
    )
    raw = activity.select(
        "event_id", F.col("user_id").cast("string").alias("entity_id"), payload.alias("features")
    )
    parsed = parse_rows(raw, USER_ACTIVITY)
    good = F.col("problem").isNull()
    return parsed.select("event_id", "problem", F.when(good, F.col("k")).alias("k"), F.when(good, F.col("value")).alias("value"))


def partial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are logged whole, purchases without `k`: the newest click's `k` stays current."""
    activity = user_activity(spark, sf_dir)
    log = FeatureLog(spark, scratch_path(spark, "partial"))
    rows = activity.select(
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.col("event_id").alias("ingest_seq"),
        "event_type",
        "value",
        "k",
    )
    log.append(USER_ACTIVITY, of_type(rows, "click"), now=NOW, batch="clicks")
    log.append(USER_ACTIVITY, of_type(rows, "purchase").drop("k"), now=NOW, batch="purchases")
    merged = merge_fields(log.read(USER_ACTIVITY), ACTIVITY, order=["event_timestamp", "ingest_seq"])
    return merged.select(F.col("entity_id").cast("long").alias("user_id"), *ACTIVITY)


def retyped_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks were logged while `k` was a number; now it is text, and all of the log is read so."""
    rows = user_activity(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.col("event_id").alias("ingest_seq"),
        "event_type",
        "k",
    )
    log = FeatureLog(spark, scratch_path(spark, "retyped"))
    old = FeatureViewSpec("v", (Feature("event_type", "string"), Feature("k", "int64")))
    new = FeatureViewSpec("v", (Feature("event_type", "string"), Feature("k", "string"), Feature("later", "float64")))
    log.append(old, of_type(rows, "click"), now=NOW)
    log.append(new, of_type(rows, "view").withColumn("k", F.concat(F.lit("k"), F.col("k"))), now=NOW)
    return log.read(new).select(F.col("ingest_seq").alias("event_id"), "event_type", "k", "later")


def replayed_after_retype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of clicks is logged, views follow, then the view's types change and the batch is
    delivered again with half of its rows: it counts once, as it was delivered last."""
    rows = user_activity(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.col("event_id").alias("ingest_seq"),
        "event_type",
        "k",
    )
    log = FeatureLog(spark, scratch_path(spark, "replayed"))
    old = FeatureViewSpec("v", (Feature("event_type", "string"), Feature("k", "int64")))
    new = FeatureViewSpec("v", (Feature("event_type", "string"), Feature("k", "string")))
    log.append(old, of_type(rows, "click"), now=NOW, batch="updates-7")
    log.append(old, of_type(rows, "view"), now=NOW, batch="updates-8")
    again = of_type(rows, "click").where(F.col("ingest_seq") % 2 == 0)
    log.append(new, again.withColumn("k", F.concat(F.lit("k"), F.col("k"))), now=NOW, batch="updates-7")
    log.pack(new)
    return log.read(new).select(F.col("ingest_seq").alias("event_id"), "event_type", "k")


def activity_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Activity as log rows in three batches that overlap in time."""
    rows = user_activity(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.col("event_id").alias("ingest_seq"),
        *ACTIVITY,
    )
    return [rows.where(F.col("ingest_seq") % 3 == n) for n in range(3)]


def refresh_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log grows by three batches, late rows among them; after each a refresh that reads the
    new batch alone: current values as from one refresh of the whole log."""
    store = FeatureTables(spark, scratch_path(spark, "incremental"))
    store.register_schema(USER_ACTIVITY, now=NOW)
    for n, batch in enumerate(activity_batches(spark, sf_dir)):
        store.write_rows("user_activity", batch, now=NOW, batch=f"load-{n}")
        store.materialize("user_activity", incremental=True, now=NOW)
    return online_columns(store)


def stats_from_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a log of three batches, one of them written twice, from the summaries; whether
    the number of entities is as near as promised is told by counting them."""
    log = FeatureLog(spark, scratch_path(spark, "sketched"))
    batches = activity_batches(spark, sf_dir)
    for n in (0, 1, 2, 1):
        log.append(USER_ACTIVITY, batches[n], now=NOW, batch=f"load-{n}")
    stats = log.sketched_stats(USER_ACTIVITY.name)
    exact = log.read(USER_ACTIVITY).agg(F.countDistinct("entity_id")).scalar()
    return stats.select(
        "total_rows",
        (F.abs(F.col("about_entities") - exact) <= 0.05 * exact).alias("near"),
        F.col("min_timestamp").cast("timestamp_ntz").alias("min_timestamp"),
        F.col("max_timestamp").cast("timestamp_ntz").alias("max_timestamp"),
    )


def untyped_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored text read without types: lists come back as numbers."""
    orders = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("["), F.col("o_custkey"), F.lit(", "), F.col("o_orderkey"), F.lit("]")))
    raw, numbers = decode_untyped(F.coalesce(text, F.col("o_orderpriority")))
    return orders.select(
        "o_orderkey", raw.alias("raw"), F.get(numbers, F.lit(0)).alias("first"), F.get(numbers, F.lit(1)).alias("second")
    )


# --- streaming ---------------------------------------------------------------------------


def streamed_store(spark: SparkSession, sf_dir: str) -> FeatureTables:
    """Run the events file as a stream of updates into a new store. Signups go to a view
    that does not exist, errors carry an unknown feature."""
    store = FeatureTables(spark, scratch_path(spark, "stream"))
    store.register_schema(USER_ACTIVITY, now=NOW)
    schema = table(spark, sf_dir, "events").schema
    # As a pattern the path is right for a file and for a folder of files.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events[.]parquet")
    query = propagate(store, event_updates(events), f"{store.root}/checkpoint", clock=lambda: NOW)
    query.awaitTermination()
    return store


def event_updates(events: DataFrame) -> DataFrame:
    """Events as update messages, delivered out of order."""
    raw = raw_payload(
        events.withColumn("k", payload_k()).withColumn("ingest_seq", (F.col("event_id") + F.col("k") * 97) * 128 + F.col("k"))
    )
    view = F.when(F.col("event_type") == "signup", "no_such_view").otherwise("user_activity")
    return raw.select(
        F.col("event_id").cast("string").alias("message_id"),
        view.alias("feature_view"),
        "entity_id",
        "features",
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.col("ts").cast("timestamp").alias("produced_at"),
        F.lit(False).alias("logged"),
        "ingest_seq",
    )


def stream_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updates in two batches, the second one applied again: log and current values as if
    each had come once."""
    store = FeatureTables(spark, scratch_path(spark, "batches"))
    store.register_schema(USER_ACTIVITY, now=NOW)
    # Read by every batch and for the middle, so built once.
    updates = stored(event_updates(table(spark, sf_dir, "events")), "updates")
    early = F.col("ingest_seq") < updates.agg((F.min("ingest_seq") + F.max("ingest_seq")) / 2).scalar()
    for name, batch in (("b-0", updates.where(early)), ("b-1", updates.where(~early)), ("b-1", updates.where(~early))):
        apply_batch(store, batch, name, now=NOW)
    logged = store.log.read(USER_ACTIVITY).groupBy("entity_id").agg(F.count("*").alias("n_logged"))
    current = store.online(USER_ACTIVITY.name).current(now=NOW)
    return current.join(logged, "entity_id").select(
        F.col("entity_id").cast("long").alias("user_id"), *ACTIVITY, "n_logged"
    )


def stream_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches whose event times are whole days, so that most tie; the first is delivered
    again after the others. Of equal times the later batch wins, in it the later place."""
    store = FeatureTables(spark, scratch_path(spark, "ties"))
    store.register_schema(USER_ACTIVITY, now=NOW)
    number = F.col("message_id").cast("long")
    days = event_updates(table(spark, sf_dir, "events")).withColumns(
        {"event_timestamp": F.date_trunc("day", "event_timestamp"), "ingest_seq": -number}
    )
    updates = stored(days, "updates")
    for n in (0, 1, 2, 0):
        apply_batch(store, updates.where(number * 7 % 3 == n), f"b-{n}", now=NOW)
    newest = store.latest(USER_ACTIVITY.name).select(
        "entity_id", F.col("message_id").cast("long").alias("newest_event"), F.col("value").alias("newest_value")
    )
    return newest.join(store.online(USER_ACTIVITY.name).current(now=NOW), "entity_id").select(
        F.col("entity_id").cast("long").alias("user_id"), "newest_event", "newest_value", *ACTIVITY
    )


def stream_current_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_columns(streamed_store(spark, sf_dir))


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = streamed_store(spark, sf_dir)
    return store.log.read(USER_ACTIVITY).select(
        F.col("message_id").cast("long").alias("event_id"),
        F.col("entity_id").cast("long").alias("user_id"),
        F.col("event_timestamp").cast("timestamp_ntz").alias("ts"),
        F.size("feature_keys").cast("long").alias("n_keys"),
        *ACTIVITY,
    )


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = streamed_store(spark, sf_dir)
    refused = spark.read.parquet(f"{store.root}/quarantine")
    return refused.select(F.col("message_id").cast("long").alias("event_id"), "feature_view", "problem")


# --- schemas -----------------------------------------------------------------------------


def pinned_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry for queries that read it more than once: derived one time only."""
    return pinned(schema_versions(spark, sf_dir))


def versions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = registry.with_is_latest(schema_versions(spark, sf_dir))
    return marked.select(
        "feature_view",
        "version",
        "compatibility_mode",
        "is_latest",
        "created_at",
        F.array_join(F.transform("spec.features", lambda f: F.concat(f["name"], F.lit(":"), f["dtype"])), ",").alias(
            "features"
        ),
    )


def latest_version_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest_version_numbers(schema_versions(spark, sf_dir))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.change_feed(schema_versions(spark, sf_dir))


def compat_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = registry.successive_pairs(schema_versions(spark, sf_dir))
    return audit(pairs, ["feature_view", "version", "mode"])


def compat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = registry.successive_pairs(schema_versions(spark, sf_dir))
    return check_compatibility(pairs).select(
        "feature_view",
        "version",
        "mode",
        "compatible",
        F.size("errors").cast("long").alias("n_errors"),
        F.size("warnings").cast("long").alias("n_warnings"),
    )


def spec_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = registry.successive_pairs(schema_versions(spark, sf_dir))
    return spec_diff(pairs, ["feature_view", "version"])


def register_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every view with its first version registered proposes its second; views that have
    only one version propose that as their first."""
    versions = pinned_versions(spark, sf_dir)
    newest = registry.latest_version_numbers(versions)
    both = versions.join(newest, "feature_view")
    existing = both.where("version = 1 AND latest_version > 1")
    proposals = both.where("version = least(2, latest_version)").select("spec", "compatibility_mode")
    decided = registry.decide(existing.drop("latest_version"), proposals)
    return decided.select(
        "feature_view",
        "version",
        "accepted",
        F.array_join("errors", "; ").alias("errors"),
        F.array_join("warnings", "; ").alias("warnings"),
    )


def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check going back to the first version under the mode stored with the newest."""
    versions = pinned_versions(spark, sf_dir)
    checked = registry.dry_run(versions, versions.where("version = 1").select("spec"))
    return checked.select(
        "feature_view",
        "compatible",
        "mode",
        F.size("errors").cast("long").alias("n_errors"),
        F.size("warnings").cast("long").alias("n_warnings"),
    )


def change_messages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed as keyed messages, parsed again as a consumer does."""
    sent = change_messages(registry.change_feed(schema_versions(spark, sf_dir)), now=NOW)
    received = sent.select("key", F.from_json("value", SCHEMA_CHANGE_MESSAGE).alias("m"))
    return received.select("key", "m.feature_view", "m.old_version", "m.new_version", "m.change_type")


def versions_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of the view of one customer, newest first, with their place in the list."""
    found = registry.list_versions(schema_versions(spark, sf_dir), "view_1")
    return found.select(
        "version", "compatibility_mode", "is_latest", (F.monotonically_increasing_id() + 1).alias("place")
    )


def schema_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version of one view, and the newest of another."""
    versions = schema_versions(spark, sf_dir)
    second = registry.get_schema(versions, "view_2", 2)
    newest = registry.get_schema(versions, "view_4")
    return second.unionByName(newest).select(
        "feature_view", "version", "is_latest", F.size("spec.features").cast("long").alias("n_features")
    )


def view_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.catalog(view_events(spark, sf_dir)).drop("tags")


def active_views_with_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = registry.catalog(view_events(spark, sf_dir))
    return registry.view_listing(registry.views_with_spec(views, schema_versions(spark, sf_dir)))


def count_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.count_views(registry.catalog(view_events(spark, sf_dir)))


def rows_of_active_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("feature_view", F.concat(F.lit("view_"), F.col("o_custkey")))
    kept = registry.only_active(orders, registry.catalog(view_events(spark, sf_dir)))
    return kept.select("feature_view", "o_orderkey", "o_totalprice")


def ordered_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's features as of its time, numbered in the order of the labels."""
    return with_positions(pit_user_activity(spark, sf_dir), ["spine_id"])


def views_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active views with their places in the listing by name."""
    return with_positions(active_views_with_spec(spark, sf_dir), ["name"])


def runs_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view's runs with their places in its history, newest first, and how many it has."""
    return with_positions(run_history(spark, sf_dir), ["-created_at", "job_id"], within=["feature_view"], total="runs")


def log_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = within(table(spark, sf_dir, "events"), "ts", ntz(WINDOW[0]), ntz(WINDOW[1]))
    return ranged.select("event_id", "user_id", "ts")


QUERIES: dict[str, Query] = {
    "pit_user_activity": pit_user_activity,
    "pit_orders_ties": pit_orders_ties,
    "pit_before_any_data": pit_before_any_data,
    "pit_day_before": pit_day_before,
    "pit_inclusive": pit_inclusive,
    "pit_duplicate_spine": pit_duplicate_spine,
    "pit_feature_subset": pit_feature_subset,
    "pit_hot_entities": pit_hot_entities,
    "pit_monthly_marks": pit_monthly_marks,
    "pit_array_spine": pit_array_spine,
    "pit_one_hot_entity": pit_one_hot_entity,
    "pit_short_list": pit_short_list,
    "latest_per_entity": latest_activity_per_user,
    "latest_with_ties": latest_order_with_ties,
    "latest_for_entities": latest_for_entities_query,
    "latest_vectors": latest_vectors,
    "log_time_range": log_time_range,
    "materialize_window": materialize_window,
    "materialize_as_of": materialize_as_of,
    "materialize_job": materialize_job,
    "run_history": run_history,
    "field_merge_arrival": field_merge_arrival,
    "field_merge_event_time": field_merge_event_time,
    "online_lookup": online_lookup_query,
    "online_feature_subset": online_feature_subset,
    "missing_entities": missing_entities_query,
    "delete_online": delete_online,
    "online_expiry": online_expiry,
    "online_unexpired": online_unexpired,
    "online_count": online_count_query,
    "wide_pivot": wide_pivot,
    "offline_stats": offline_stats_query,
    "offline_stats_by_view": offline_stats_views,
    "view_stats": view_stats_query,
    "unknown_features": unknown_features_query,
    "validate_updates": validate_updates,
    "typed_decode": typed_decode,
    "text_encode": text_encode,
    "update_messages": update_message_fields,
    "stream_current_values": stream_current_values,
    "stream_log": stream_log,
    "stream_quarantine": stream_quarantine,
    "stream_two_batches": stream_two_batches,
    "json_rows": json_rows,
    "array_file": array_file,
    "typed_refusals": typed_refusals,
    "partial_rows": partial_rows,
    "untyped_read": untyped_read,
    "retyped_history": retyped_history,
    "change_messages": change_messages_query,
    "versions_listed": versions_listed,
    "schema_of_version": schema_of_version,
    "versions_latest": versions_latest,
    "latest_version_numbers": latest_version_numbers,
    "change_feed": change_feed,
    "compat_audit": compat_audit,
    "compat_summary": compat_summary,
    "spec_changes": spec_changes,
    "register_schemas": register_schemas,
    "dry_run": dry_run,
    "view_catalog": view_catalog,
    "active_views_with_spec": active_views_with_spec,
    "count_views": count_views,
    "rows_of_active_views": rows_of_active_views,
    "replayed_after_retype": replayed_after_retype,
    "stream_ties": stream_ties,
    "refresh_incremental": refresh_incremental,
    "stats_from_sketches": stats_from_sketches,
    "ordered_training_rows": ordered_training_rows,
    "views_by_name": views_by_name,
    "runs_newest_first": runs_newest_first,
}
