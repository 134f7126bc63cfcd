"""Point-in-time (as-of) left join of a label spine to a feature log.

Each spine row receives the newest log row of its entity whose time is not after the
label's. Spine rows without such a row are kept with null features, duplicates stay, and
equal log times are settled by the tie columns.

Two plans compute it, picked by size:

* `window` — one shuffle by entity and a running `last`. Entities with more rows than
  `hot_rows` are cut into time slices of about equal row counts; the newest log row of the
  slices before a slice is put in front of it as a seed, so that no slice has to look
  outside itself. A single instant that alone fills several slices is salted.
* `marks` — for a spine small enough to broadcast against a large log. Each log row is
  assigned to the first label instant it is visible to and only the newest row per
  instant survives the map side, so the log itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import broadcast_limit, pinned, sized_bytes, unsized

# Rows of one entity that a single sort task takes comfortably.
HOT_ROWS = 4_000_000
# Slices one hot entity is cut into at most; this bounds the array joined to its rows.
MAX_SLICES = 1024
# Sampled rows per slice when cut points are chosen. They only steer balance.
SAMPLES_PER_SLICE = 32
# A row takes at least about this many bytes, whatever the compression; inputs whose size rules out
# enough rows for a hot entity are not searched.
ROW_BYTES = 1
# A spine of so many rows is always small, however large or small the log is.
SHORT_SPINE_ROWS = 10_000
# Bound on broadcast cut points and label instants, in array elements.
MAX_BROADCAST_ITEMS = 2_000_000
# The log must be this many times the broadcast limit before `marks` pays off.
LARGE_LOG_FACTOR = 64
# Spine rows with a null key match nothing and are spread over this many groups.
NULL_GROUPS = 1024


def asof_join(
    spine: DataFrame,
    log: DataFrame,
    *,
    by: str | Sequence[str] = "entity_id",
    spine_ts: str = "label_timestamp",
    log_ts: str = "event_timestamp",
    ties: Sequence[str] = (),
    features: Sequence[str] | None = None,
    feature_ts: str = "feature_timestamp",
    nested: str | None = None,
    strategy: str = "auto",
    hot_rows: int | None = HOT_ROWS,
    bound_log: bool = False,
) -> DataFrame:
    """As-of left join; returns the spine's columns, the features and `feature_ts`.

    `nested` puts the features into one struct column that is null where nothing matched.
    Looking for hot entities reads the keys and times of large inputs once more;
    `hot_rows=None` leaves that out where no entity is known to be hot.
    `bound_log` adds `log_ts <= max(spine_ts)`, which reaches the scan and pays off when
    the log runs on long after the last label and the spine is cheap to read.
    """
    by = [by] if isinstance(by, str) else list(by)
    if features is None:
        features = [c for c in log.columns if c not in {*by, log_ts, *ties}]
    if strategy not in ("auto", "window", "marks"):
        raise ValueError(f"unknown strategy {strategy!r}")

    if bound_log:
        log = log.where(F.col(log_ts) <= spine.agg(F.max(spine_ts)).scalar())
    log = log.select(
        *by,
        F.col(log_ts).alias("_ts"),
        F.struct(*ties).alias("_tie") if ties else F.lit(0).alias("_tie"),
        F.struct(F.col(log_ts).alias("ts"), F.struct(*features).alias("row")).alias("_hit"),
    ).where(_all_set([*by, "_ts"]))

    marks = None
    if strategy != "window":
        marks = _small_marks(spine, log, by, spine_ts, forced=strategy == "marks")
    if marks is not None:
        joined = _marks_join(spine, log, by, spine_ts, marks)
    else:
        bounds = _hot_bounds(spine, log, by, spine_ts, hot_rows)
        joined = _window_join(spine, log, by, spine_ts, bounds)

    found = (
        [F.col("_hit.row").alias(nested)]
        if nested
        else [F.col("_hit.row")[name].alias(name) for name in features]
    )
    kept = [F.col(c) for c in spine.columns]
    return joined.select(*kept, *found, F.col("_hit.ts").alias(feature_ts))


def _all_set(columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNotNull()
    return condition


def _count_below(sorted_array: Column, value: Column, limit: int) -> Column:
    """Number of elements of an ascending array below `value`, by bisection."""
    steps = [1 << i for i in reversed(range(max(1, limit.bit_length())))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(sorted_array, at + step - 1) < value, at + step).otherwise(at),
    )


def _spread(df: DataFrame, groups: Column | int) -> Column:
    """A group number that depends on a row's content and partition only."""
    plain = [f.name for f in df.schema.fields if not _has_map(f.dataType)]
    groups = F.lit(groups) if isinstance(groups, int) else groups
    return F.pmod(F.xxhash64(*plain, F.spark_partition_id()), groups.cast("long"))


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.MapType, T.VariantType))


# --- window plan -------------------------------------------------------------------------


def _window_join(
    spine: DataFrame, log: DataFrame, by: list[str], spine_ts: str, bounds: DataFrame | None
) -> DataFrame:
    spread = _spread(spine, NULL_GROUPS)
    whole_row = F.struct(*[F.col(c) for c in spine.columns])
    probes = spine.select(*by, F.col(spine_ts).alias("_ts"), whole_row.alias("_spine"), spread.alias("_spread"))
    keyed = _all_set([*by, "_ts"])

    if bounds is None:
        build = log.withColumn("_slice", F.lit(0)).withColumn("_salt", F.lit(0).cast("long"))
        probes = probes.withColumn("_slice", F.when(keyed, 0).otherwise(-1)).withColumn(
            "_salt", F.when(keyed, F.lit(0).cast("long")).otherwise(F.col("_spread"))
        )
    else:
        placed = _place(log, by, bounds)
        # The one visible row of a salted instant reaches its probes as a seed.
        build = (
            placed.where(F.col("_salts") == 1)
            .withColumn("_salt", F.lit(0).cast("long"))
            .select(*log.columns, "_slice", "_salt")
            .unionByName(_seeds(placed.where(F.col("_cuts").isNotNull()), by, bounds, log))
        )
        probes = (
            _place(probes, by, bounds)
            .withColumn("_slice", F.when(keyed, F.col("_slice")).otherwise(-1))
            .withColumn(
                "_salt",
                F.when(keyed, F.pmod(F.col("_spread"), F.col("_salts").cast("long"))).otherwise(F.col("_spread")),
            )
        )

    tie_type = log.schema["_tie"].dataType
    hit_type = log.schema["_hit"].dataType
    group = [*by, "_slice", "_salt"]
    rows = build.select(
        *group, "_ts", F.lit(0).alias("_side"), "_tie", "_hit", F.lit(None).cast(spine.schema).alias("_spine")
    ).unionByName(
        probes.select(
            *group,
            "_ts",
            F.lit(1).alias("_side"),
            F.lit(None).cast(tie_type).alias("_tie"),
            F.lit(None).cast(hit_type).alias("_hit"),
            "_spine",
        )
    )
    # Log rows sort before spine rows of the same instant: the bound is inclusive.
    running = (
        Window.partitionBy(*group)
        .orderBy("_ts", "_side", "_tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_hit", F.last("_hit", ignorenulls=True).over(running))
        .where(F.col("_side") == 1)
        .select("_spine.*", "_hit")
    )


def _hot_bounds(
    spine: DataFrame, log: DataFrame, by: list[str], spine_ts: str, hot_rows: int | None
) -> DataFrame | None:
    """Cut points of the entities that hold more than `hot_rows` rows, or None.

    One row per hot entity with ascending `_cuts`; slice i holds `(cuts[i-1], cuts[i]]`
    and `_salts[i]` says over how many groups its spine rows are spread.
    """
    if hot_rows is None:
        return None
    if hot_rows >= HOT_ROWS:
        # No entity has more rows than there are; files tell their row counts without being read.
        if sized_bytes(spine) + sized_bytes(log) <= hot_rows * ROW_BYTES or spine.count() + log.count() <= hot_rows:
            return None
    keys = (
        spine.select(*by, F.col(spine_ts).alias("_ts"))
        .where(_all_set([*by, "_ts"]))
        .unionByName(log.select(*by, "_ts"))
    )
    hot = pinned(keys.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows))
    n_hot = hot.count()
    if n_hot == 0:
        return None

    # At most total_rows / hot_rows entities are hot, so this side stays small.
    per_slice = F.greatest(F.lit(float(hot_rows)), F.col("_n") / MAX_SLICES)
    hot = hot.withColumn("_rate", F.least(F.lit(1.0), SAMPLES_PER_SLICE / per_slice)).withColumn(
        "_step", F.greatest(F.lit(1), F.round(per_slice * F.col("_rate")).cast("int"))
    )
    sample = keys.join(_sized(hot, n_hot), by).where(F.rand(17) < F.col("_rate"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("_ts"))
    cuts = (
        sample.withColumn("_nth", nth)
        .where(F.col("_nth") % F.col("_step") == 0)
        .groupBy(*by, "_ts")
        .agg(F.count("*").alias("_weight"))
    )
    # An instant that is cut point more than once gets a slice of its own, which starts
    # one microsecond earlier, the resolution of a timestamp.
    heavy = F.col("_weight") > 1
    before = F.col("_ts") - F.expr("INTERVAL '0.000001' SECOND")
    points = cuts.select(
        *by,
        F.explode(
            F.when(
                heavy,
                F.array(
                    F.struct(before.alias("ts"), F.lit(1).cast("long").alias("salts")),
                    F.struct(F.col("_ts").alias("ts"), F.col("_weight").alias("salts")),
                ),
            ).otherwise(F.array(F.struct(F.col("_ts").alias("ts"), F.lit(1).cast("long").alias("salts"))))
        ).alias("_p"),
    )
    points = points.groupBy(*by, F.col("_p.ts").alias("ts")).agg(F.max("_p.salts").alias("salts"))
    sorted_points = F.sort_array(F.collect_list(F.struct("ts", "salts")))
    bounds = pinned(
        points.groupBy(*by)
        .agg(sorted_points.alias("_points"))
        .select(
            *by,
            F.col("_points.ts").alias("_cuts"),
            F.concat(F.col("_points.salts"), F.array(F.lit(1).cast("long"))).alias("_slot_salts"),
        )
    )
    # A sample may be too small for a cut; the entity is then one slice, just over the limit.
    return None if bounds.isEmpty() else bounds


def _sized(small: DataFrame, items: int) -> DataFrame:
    """Broadcast a table whose counted size allows it; beyond that Spark shuffles."""
    return F.broadcast(small) if items <= MAX_BROADCAST_ITEMS else small


def _place(df: DataFrame, by: list[str], bounds: DataFrame) -> DataFrame:
    """Add each row's slice and the number of groups that slice is salted over."""
    items = bounds.agg(F.sum(F.size("_cuts"))).first()[0]
    placed = df.join(_sized(bounds, items), by, "left")
    at = _count_below(F.col("_cuts"), F.col("_ts"), 4 * MAX_SLICES)
    placed = placed.withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(at))
    salts = F.coalesce(F.get("_slot_salts", F.col("_slice")), F.lit(1).cast("long"))
    return placed.withColumn("_salts", salts)


def _seeds(placed: DataFrame, by: list[str], bounds: DataFrame, log: DataFrame) -> DataFrame:
    """For each slice of a hot entity the newest log row known before it.

    A salted instant is seeded with the newest row up to and including itself.
    """
    tails = placed.groupBy(*by, "_slice").agg(F.max_by("_hit", F.struct("_ts", "_tie")).alias("_tail"))
    slices = bounds.select(*by, F.posexplode("_slot_salts").alias("_slice", "_salts"))
    order = Window.partitionBy(*by).orderBy("_slice")
    earlier = F.last("_tail", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    so_far = F.last("_tail", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        slices.join(tails, [*by, "_slice"], "left")
        .withColumn("_hit", F.when(F.col("_salts") > 1, so_far).otherwise(earlier))
        .where(F.col("_hit").isNotNull())
        .select(
            *by,
            # A null time sorts first within the slice.
            F.lit(None).cast(log.schema["_ts"].dataType).alias("_ts"),
            F.lit(None).cast(log.schema["_tie"].dataType).alias("_tie"),
            "_hit",
            "_slice",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt"),
        )
    )


# --- marks plan --------------------------------------------------------------------------


def _small_marks(
    spine: DataFrame, log: DataFrame, by: list[str], spine_ts: str, forced: bool
) -> DataFrame | None:
    """Distinct label instants per entity, if they are few enough to broadcast."""
    limit = broadcast_limit(spine.sparkSession)
    short = unsized(spine) and spine.count() <= SHORT_SPINE_ROWS
    if not forced and not short and (sized_bytes(spine) > limit or sized_bytes(log) < LARGE_LOG_FACTOR * limit):
        return None
    distinct = spine.select(*by, F.col(spine_ts).alias("_mark")).where(_all_set([*by, "_mark"])).distinct()
    per_entity = distinct.groupBy(*by).agg(F.count("*").alias("_n"))
    total, widest = per_entity.agg(F.sum("_n"), F.max("_n")).first()
    if (total or 0) > MAX_BROADCAST_ITEMS or (widest or 0) > MAX_SLICES:
        if forced:
            raise ValueError("the spine has too many label instants for strategy 'marks'")
        return None
    return distinct.groupBy(*by).agg(F.sort_array(F.collect_list("_mark")).alias("_marks"))


def _marks_join(
    spine: DataFrame, log: DataFrame, by: list[str], spine_ts: str, marks: DataFrame
) -> DataFrame:
    visible = (
        log.join(F.broadcast(marks), by)
        .withColumn("_slot", _count_below(F.col("_marks"), F.col("_ts"), MAX_SLICES))
        .where(F.col("_slot") < F.size("_marks"))
    )
    newest = visible.groupBy(*by, "_slot").agg(F.max_by("_hit", F.struct("_ts", "_tie")).alias("_hit"))
    running = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        marks.select(*by, F.posexplode("_marks").alias("_slot", spine_ts))
        .join(newest, [*by, "_slot"], "left")
        .withColumn("_hit", F.last("_hit", ignorenulls=True).over(running))
        .drop("_slot")
    )
    return spine.join(filled, [*by, spine_ts], "left")
