"""Feature views over the benchmark tables.

Times in those files carry no zone and stay that way inside queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import Feature, FeatureViewSpec
from tidemark.operators.registry import number_within

USER_ACTIVITY = FeatureViewSpec(
    "user_activity",
    (Feature("value", "float64"), Feature("event_type", "string"), Feature("k", "int64", default=0)),
    entity_column="user_id",
    timestamp_column="ts",
    ttl_seconds=7 * 86400,
)
CUSTOMER_ORDERS = FeatureViewSpec(
    "customer_orders",
    (
        Feature("o_totalprice", "float64"),
        Feature("o_orderstatus", "string"),
        Feature("o_orderpriority", "string"),
    ),
    entity_column="o_custkey",
    timestamp_column="o_orderdate",
)
DOC_VECTORS = FeatureViewSpec(
    "doc_vectors",
    (Feature("embedding", "list_float64"), Feature("label", "int64")),
    entity_column="vec_id",
)

# Which features an update of each event type sets; the rest of the row stays as it was.
UPDATE_KEYS = {
    "click": ["event_type", "k"],
    "error": ["k"],
    "purchase": ["value", "event_type"],
    "signup": ["value", "event_type", "k"],
    "view": ["event_type"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payload_k() -> Column:
    """The number that events carry as JSON."""
    return F.get_json_object("props", "$.k").cast("long")


def user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with `k` from their JSON, an arrival order that differs from event order,
    and the features each update sets."""
    events = table(spark, sf_dir, "events")
    k = payload_k()
    keys: Column = F.array().cast("array<string>")
    for kind, names in UPDATE_KEYS.items():
        keys = F.when(F.col("event_type") == kind, F.array(*[F.lit(n) for n in names])).otherwise(keys)
    return events.select(
        "user_id",
        "ts",
        "event_id",
        "value",
        "event_type",
        k.alias("k"),
        # Delivered k * 97 places late; the low part keeps it unique.
        ((F.col("event_id") + k * 97) * 128 + k).alias("ingest_seq"),
        keys.alias("feature_keys"),
    )


def of_type(activity: DataFrame, *kinds: str) -> DataFrame:
    return activity.where(F.col("event_type").isin(*kinds))


def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry as large as the order tables: each customer is a view, each order one
    version of its schema and each line a feature of that version."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    # Fixed for this data set: how line columns read as feature properties.
    dtypes, defaults = ["float64", "int64", "string"], [None, "0", '"none"']
    dtype = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    default = F.when(F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") == "R", 2).otherwise(1)).otherwise(0)
    place = (F.col("l_linenumber") * (1 << 35) + F.col("l_partkey")) * (1 << 20) + F.col("l_suppkey") % (1 << 20)
    # A repeated name keeps its first place and its last definition. There are five names,
    # so an order of any size reduces to a few numbers in one hash aggregation.
    names = range(5)
    at = {n: F.when(F.col("l_partkey") % 5 == n, place) for n in names}
    reduced = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        *[F.min(at[n]).alias(f"first_{n}") for n in names],
        *[F.max_by(dtype * 3 + default, at[n]).alias(f"last_{n}") for n in names],
    )
    found = [
        F.when(
            F.col(f"first_{n}").isNotNull(),
            F.struct(
                F.col(f"first_{n}").alias("first"),
                F.lit(f"f{n}").alias("name"),
                F.get(F.array(*[F.lit(d) for d in dtypes]), (F.col(f"last_{n}") / 3).cast("int")).alias("dtype"),
                F.get(F.array(*[F.lit(d) for d in defaults]), F.col(f"last_{n}") % 3).alias("default"),
            ),
        )
        for n in names
    ]
    listed = F.sort_array(F.array_compact(F.array(*found)))
    features = F.transform(listed, lambda f: F.struct(f["name"], f["dtype"], f["default"]))
    # Numbered with a few numbers for a spec, which is spelt out only afterwards.
    numbered = number_within(orders.join(reduced, "o_orderkey"), by=["o_custkey"], ts="o_orderdate", order=["o_orderkey"])
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    mode = (
        F.when(F.col("o_orderpriority").startswith("1"), "FORWARD")
        .when(F.col("o_orderpriority").startswith("2"), "FULL")
        .when(F.col("o_orderpriority").startswith("3"), "NONE")
        .otherwise("BACKWARD")
    )
    view = F.concat(F.lit("view_"), F.col("o_custkey"))
    return numbered.select(
        view.alias("feature_view"),
        "version",
        F.struct(
            view.alias("name"),
            F.when(F.col("o_orderstatus") == "P", "account_id").otherwise("entity_id").alias("entity_column"),
            F.when(early, "event_time").otherwise("event_timestamp").alias("timestamp_column"),
            features.alias("features"),
        ).alias("spec"),
        mode.alias("compatibility_mode"),
        F.col("o_orderdate").alias("created_at"),
    )


def view_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog changes as large as the order table: an order registers the customer's view,
    a failed one retires it."""
    orders = table(spark, sf_dir, "orders")
    numbered = number_within(orders, by=["o_custkey"], ts="o_orderdate", order=["o_orderkey"])
    retired = (F.col("o_orderstatus") == "P") & F.col("o_orderpriority").startswith("5")
    return numbered.select(
        F.concat(F.lit("view_"), F.col("o_custkey")).alias("name"),
        F.lit("entity_id").alias("entity_column"),
        F.lit("event_timestamp").alias("timestamp_column"),
        F.col("version").alias("schema_version"),
        F.when(F.col("o_orderstatus") == "F", 3600).otherwise(0).alias("ttl_seconds"),
        F.create_map().cast("map<string,string>").alias("tags"),
        F.col("o_orderpriority").alias("description"),
        (~retired).alias("is_active"),
        # One change per second and version keeps the order of a day's changes.
        (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("version").cast("decimal(18,6)"))).alias("changed_at"),
    )
