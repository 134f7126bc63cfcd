"""JSON edges: feature rows, label spines, specs and keyed update messages."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.fields import as_timestamp, message_key, parse_timestamp, payload_json
from tidemark.model import FEATURE_ROWS, MODES, SPEC_TYPE, UPDATE_MESSAGE, FeatureViewSpec
from tidemark.sources.arrays import array_elements

# Delivery settings of the update producer.
KAFKA_PRODUCER = {
    "kafka.acks": "all",
    "kafka.enable.idempotence": "true",
    "kafka.compression.type": "gzip",
}
# Topic names and the start position of the update consumer. How many updates a
# micro-batch takes is left to the source, as a cap would hold the stream to so many per trigger.
UPDATES_TOPIC = "feature-updates"
CHANGES_TOPIC = "schema-changes"
KAFKA_CONSUMER = {"startingOffsets": "earliest"}


def read_feature_rows(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Feature rows from files that each hold a JSON array of objects or one object per line.

    `kind` says that all files are "lines" or "array"s. Without it all files are read once more to
    tell: one is an array if its first character that is not white space is a bracket, and the names
    of the files come to the driver. Files of either kind are split over tasks. Features out of arrays
    are written anew without spaces.
    """
    if kind not in (None, "lines", "array"):
        raise ValueError(f"unknown kind of files {kind!r}")
    schema = "entity_id string, features string, event_timestamp string"
    arrays, lines = ([path] if kind == "array" else []), ([path] if kind == "lines" else [])
    if kind is None:
        heads = _first_characters(spark, path).collect()
        arrays = [r["file"] for r in heads if r["head"] == "["]
        lines = [r["file"] for r in heads if r["head"] != "["]
    parts = []
    if arrays:
        row = F.from_json("element", schema).alias("_row")
        parts.append(array_elements(spark, arrays, "}").select(row).select("_row.*"))
    if lines:
        parts.append(spark.read.schema(schema).json(lines))
    raw = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return raw.withColumn("event_timestamp", parse_timestamp(F.col("event_timestamp"))).select(
        FEATURE_ROWS.fieldNames()
    )


def _first_characters(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        # Lines of a block keep their order, and so does the number each row is given.
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", r"^\s+", "").alias("text"),
    )
    first = F.min_by(F.substring("text", 1, 1), F.struct("block", "at"))
    return lines.where(F.col("text") != "").groupBy("file").agg(first.alias("head"))


def read_spine(spark: SparkSession, path: str) -> DataFrame:
    """A spine from files `[[entity_id, iso_timestamp], …]`, each numbered in its order from 0.

    Files are split over tasks; the rows are sorted by file and number.
    """
    pair = F.from_json("element", "array<string>").alias("_p")
    pairs = array_elements(spark, path, "]").orderBy("file", "position").select("position", pair)
    return pairs.select(
        F.col("position").cast("long").alias("spine_id"),
        F.get("_p", F.lit(0)).alias("entity_id"),
        parse_timestamp(F.get("_p", F.lit(1))).alias("label_timestamp"),
    )


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """View specs from JSON files, with the fixed default column names filled in.

    Defaults stay JSON text, so the features are read as text objects first.
    """
    text = spark.read.option("wholetext", "true").text(path)
    outer = (
        "name string, entity_column string, timestamp_column string, features array<string>, "
        "ttl_seconds int, tags map<string,string>, description string"
    )
    spec = F.from_json("value", outer)
    features = F.transform(
        spec["features"],
        lambda f: F.struct(
            F.get_json_object(f, "$.name").alias("name"),
            F.get_json_object(f, "$.dtype").alias("dtype"),
            F.coalesce(F.get_json_object(f, "$.description"), F.lit("")).alias("description"),
            _json_default(f).alias("default"),
            F.coalesce(
                F.from_json(F.get_json_object(f, "$.tags"), "map<string,string>"),
                F.create_map().cast("map<string,string>"),
            ).alias("tags"),
        ),
    )
    no_tags = F.create_map().cast("map<string,string>")
    return text.select(
        F.struct(
            spec["name"].alias("name"),
            F.coalesce(spec["entity_column"], F.lit("entity_id")).alias("entity_column"),
            F.coalesce(spec["timestamp_column"], F.lit("event_timestamp")).alias("timestamp_column"),
            features.alias("features"),
            spec["ttl_seconds"].alias("ttl_seconds"),
            F.coalesce(spec["tags"], no_tags).alias("tags"),
            F.coalesce(spec["description"], F.lit("")).alias("description"),
        )
        .cast(SPEC_TYPE)
        .alias("spec")
    )


def _json_default(feature: Any) -> Any:
    """The default's JSON text as it is written, quotes included; a JSON null counts as no default.

    A text value is told from a number or a list of the same spelling by its kind.
    """
    bare = F.from_json(feature, "struct<default:string>")["default"]
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(feature), "$.default", "variant"))
    quoted = F.to_json(F.struct(bare.alias("d")))
    # Lists hold numbers only, which are listed with a space after the comma.
    listed = F.regexp_replace(bare, r",\s*", ", ")
    # The object has five characters before its one value and a brace after it.
    return F.when(kind == "STRING", F.substr(quoted, F.lit(6), F.length(quoted) - 6)).when(kind.startswith("ARRAY"), listed).otherwise(bare)


def spine_from_arrays(rows: DataFrame, entity_ids: str, timestamps: str) -> DataFrame:
    """Zip two parallel arrays into spine rows that keep their position."""
    others = [c for c in rows.columns if c not in (entity_ids, timestamps)]
    zipped = F.arrays_zip(F.col(entity_ids).alias("entity_id"), F.col(timestamps).alias("label_timestamp"))
    return rows.select(*others, F.posexplode(zipped).alias("position", "_z")).select(
        *others, (F.col("position") + 1).cast("long").alias("spine_id"), "_z.entity_id", "_z.label_timestamp"
    )


def update_messages(
    rows: DataFrame, spec: FeatureViewSpec, *, schema_version: int, producer_id: str = "api", now: Any, logged: bool = False
) -> DataFrame:
    """Typed rows as update messages. Rows without `message_id` get a new one.

    `logged` tells the stream that the log already holds the row.
    """
    message_id = F.coalesce("message_id", F.uuid()) if "message_id" in rows.columns else F.uuid()
    return rows.select(
        message_id.alias("message_id"),
        F.lit(spec.name).alias("feature_view"),
        "entity_id",
        payload_json(spec).alias("features"),
        F.col("event_timestamp").cast("timestamp").alias("event_timestamp"),
        F.lit(schema_version).alias("schema_version"),
        F.lit(producer_id).alias("producer_id"),
        as_timestamp(now).alias("produced_at"),
        F.lit(logged).alias("logged"),
    )


def keyed(messages: DataFrame) -> DataFrame:
    """Messages as key and JSON value; the key keeps one entity's updates in order.

    The payload is JSON text already and is spliced in rather than quoted.
    """
    envelope = F.to_json(F.struct(*[c for c in messages.columns if c != "features"]))
    value = F.concat(F.lit('{"features":'), F.col("features"), F.lit(","), F.substr(envelope, F.lit(2)))
    return messages.select(message_key(F.col("feature_view"), F.col("entity_id")).alias("key"), value.alias("value"))


def change_messages(changes: DataFrame, *, now: Any) -> DataFrame:
    """A change feed as keyed messages."""
    body = changes.select(
        F.uuid().alias("message_id"),
        "feature_view",
        "old_version",
        "new_version",
        "change_type",
        as_timestamp(now).alias("produced_at"),
    )
    nulls = {"ignoreNullFields": "false"}
    return body.select(F.col("feature_view").alias("key"), F.to_json(F.struct("*"), nulls).alias("value"))


def send(keyed_rows: DataFrame, sink: Mapping[str, str], topic: str = UPDATES_TOPIC) -> None:
    """Write keyed messages to a sink given as `format` plus its options.

    `topic` is that of a Kafka sink that names none.
    Kafka needs its connector on the class path; a file format needs `path`.
    """
    options = dict(sink)
    fmt = options.pop("format")
    if fmt == "kafka":
        options = {**KAFKA_PRODUCER, "topic": topic, **options}
    keyed_rows.write.format(fmt).mode("append").options(**options).save()


def parse_messages(raw: DataFrame) -> DataFrame:
    """Update messages out of keyed rows; text that does not parse leaves null fields.

    With Kafka the offset is the arrival order, since one entity stays in one partition.
    Other sources have no such column, and rows then count in the order they are read.
    """
    text = F.col("value").cast("string")
    arrival = [F.col("offset").alias("ingest_seq")] if "offset" in raw.columns else []
    parsed = raw.select(text.alias("raw"), F.from_json(text, UPDATE_MESSAGE).alias("_m"), *arrival)
    return parsed.select("_m.*", *(["ingest_seq"] if arrival else []), "raw")


def read_updates(spark: SparkSession, source: Mapping[str, str], schema: str = "key string, value string") -> DataFrame:
    """Streaming update messages from Kafka or from a folder of files."""
    options = dict(source)
    fmt = options.pop("format")
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        options = {**KAFKA_CONSUMER, "subscribe": UPDATES_TOPIC, **options}
    else:
        reader = reader.schema(schema)
    return parse_messages(reader.options(**options).load())


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown compatibility mode {mode!r}")
    return mode
