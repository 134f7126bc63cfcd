"""Schema versions and the view catalog as jobs over append-only tables.

`versions` has the columns of `SCHEMA_VERSIONS`, `events` those of `VIEW_EVENTS`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.compat import check_compatibility

# Versions of one view that one task looks through.
VERSIONS_AT_ONCE = 1024
SPEC_COLUMNS = ("entity_column", "timestamp_column", "schema_version", "ttl_seconds", "tags", "description")


def number_within(
    rows: DataFrame, *, by: Sequence[str], ts: str, order: Sequence[str], as_name: str = "version"
) -> DataFrame:
    """1, 2, 3, … within each `by` group, ordered by `ts` and then `order`.

    Rows are ranked per day and the days' row counts are summed up in front of them, so a
    group that holds most of the rows is still sorted in many tasks. Rows without a time
    come first.
    """
    days = rows.withColumn("_day", F.to_date(ts))
    counts = days.groupBy(*by, "_day").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col("_day").alias("_on"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    same = F.col("_day").eqNullSafe(F.col("_on"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rank = F.row_number().over(Window.partitionBy(*by, "_day").orderBy(ts, *order))
    return days.withColumn("_rank", rank).join(offsets, same).select(
        *rows.columns, (F.col("_rank") + F.col("_offset")).cast("int").alias(as_name)
    )


def latest_version_numbers(versions: DataFrame, view: str = "feature_view") -> DataFrame:
    return versions.groupBy(view).agg(F.max("version").alias("latest_version"))


def with_is_latest(versions: DataFrame, view: str = "feature_view") -> DataFrame:
    """Mark the one newest version of each view; derived, so it cannot go stale."""
    # Numbers are added up before they meet, so that no task gets all rows of a view.
    newest = versions.groupBy(F.col(view).alias("_view")).agg(F.max("version").alias("_newest"))
    joined = versions.join(newest, F.col(view).eqNullSafe(F.col("_view")), "left")
    return joined.withColumn("is_latest", F.col("version") == F.col("_newest")).drop("_view", "_newest")


def latest_versions(versions: DataFrame, view: str = "feature_view") -> DataFrame:
    """The newest version row of every view."""
    columns = [c for c in versions.columns if c != view]
    newest = F.max_by(F.struct(*columns), "version")
    return versions.groupBy(view).agg(newest.alias("_row")).select(view, "_row.*")


def get_schema(versions: DataFrame, feature_view: str, version: int | None = None) -> DataFrame:
    """The newest or the given version of one view; empty when there is none."""
    of_view = with_is_latest(versions.where(F.col("feature_view") == feature_view))
    return of_view.where(F.col("is_latest") if version is None else F.col("version") == version)


def list_versions(versions: DataFrame, feature_view: str) -> DataFrame:
    of_view = versions.where(F.col("feature_view") == feature_view)
    return with_is_latest(of_view).orderBy(F.desc("version"))


def change_type(version: Column) -> Column:
    return F.when(version == 1, "create").otherwise("update")


def change_feed(versions: DataFrame, view: str = "feature_view") -> DataFrame:
    """One change per version. Versions of a view are consecutive, so no window is needed."""
    version = F.col("version")
    return versions.select(
        view,
        F.when(version > 1, version - 1).alias("old_version"),
        version.alias("new_version"),
        change_type(version).alias("change_type"),
    )


def successive_pairs(versions: DataFrame, view: str = "feature_view") -> DataFrame:
    """Each version beside the one before it, in one pass over the versions.

    Versions of a view are numbered without gaps. They are looked through in stretches, so that a
    view with most of the versions is spread over tasks; the last of a stretch goes to the next too.
    """
    stretch = F.floor(F.col("version") / VERSIONS_AT_ONCE)
    is_last = F.pmod("version", F.lit(VERSIONS_AT_ONCE)) == VERSIONS_AT_ONCE - 1
    dealt = versions.select(
        view,
        "version",
        F.col("spec").alias("new_spec"),
        F.col("compatibility_mode").alias("mode"),
        F.explode(F.when(is_last, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))).alias("_stretch"),
    )
    before = F.lag("new_spec").over(Window.partitionBy(view, "_stretch").orderBy("version"))
    return (
        dealt.withColumn("old_spec", before)
        .where((F.col("_stretch") == stretch) & F.col("old_spec").isNotNull())
        .drop("_stretch")
    )


def decide(versions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Outcome of registering one proposed spec per view.

    `proposals` has `spec` and `compatibility_mode`. The first version of a view is taken
    unchecked; later ones are checked against the newest version under the mode of the
    proposal. Returns `accepted`, `version` (null if refused), `errors` and `warnings`.
    """
    current = latest_versions(versions).select(
        "feature_view", F.col("version").alias("_current"), F.col("spec").alias("_old")
    )
    asked = proposals.withColumn("feature_view", F.col("spec.name"))
    paired = asked.join(current, "feature_view", "left")
    checked = check_compatibility(paired, old="_old", new="spec", mode="compatibility_mode")
    following = F.coalesce(F.col("_current"), F.lit(0)) + 1
    return (
        checked.withColumn("accepted", F.col("compatible"))
        .withColumn("version", F.when(F.col("compatible"), following))
        .select("feature_view", "version", "accepted", "spec", "compatibility_mode", "errors", "warnings")
    )


def dry_run(versions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Check proposed specs against the newest versions under the modes stored with them."""
    current = latest_versions(versions).select(
        "feature_view", F.col("spec").alias("_old"), F.col("compatibility_mode").alias("_mode")
    )
    asked = proposals.select(F.col("spec.name").alias("feature_view"), F.col("spec").alias("_new"))
    paired = asked.join(current, "feature_view", "left").withColumn("mode", F.coalesce("_mode", F.lit("NONE")))
    # Fixed value: the note given when a view has no schema yet.
    first = F.array(F.lit("No existing schema — first registration is always compatible."))
    checked = check_compatibility(paired, old="_old", new="_new")
    return checked.select(
        "feature_view",
        "compatible",
        "mode",
        "errors",
        F.when(F.col("_old").isNull(), first).otherwise(F.col("warnings")).alias("warnings"),
    )


def catalog(events: DataFrame) -> DataFrame:
    """Current catalog. Registering again updates a view but never revives a retired one."""
    registered = F.when(F.col("is_active"), F.col("changed_at"))
    return (
        events.groupBy("name")
        .agg(
            # Of registrations at one instant the higher version is the later one.
            F.max_by(F.struct(*SPEC_COLUMNS), F.when(registered.isNotNull(), F.struct(registered, "schema_version"))).alias("_spec"),
            F.min("changed_at").alias("created_at"),
            F.max("changed_at").alias("updated_at"),
            F.bool_and("is_active").alias("is_active"),
        )
        .select("name", "_spec.*", "created_at", "updated_at", "is_active")
    )


def active(views: DataFrame) -> DataFrame:
    return views.where("is_active")


def views_with_spec(views: DataFrame, versions: DataFrame) -> DataFrame:
    """Active views with the features of their current version; without one they drop out."""
    specs = versions.select(
        F.col("feature_view").alias("name"), F.col("version").alias("schema_version"), "spec", "spec.features"
    )
    return active(views).join(specs, ["name", "schema_version"])


def view_listing(views: DataFrame) -> DataFrame:
    """Listing columns of views that carry their features, by name."""
    return views.select(
        "name",
        "entity_column",
        "schema_version",
        F.size("features").alias("feature_count"),
        F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated"),
    ).orderBy("name")


def count_views(views: DataFrame) -> DataFrame:
    return active(views).agg(F.count("*").alias("views"))


def only_active(rows: DataFrame, views: DataFrame, view: str = "feature_view") -> DataFrame:
    """Rows that belong to an active view."""
    names = active(views).select(F.col("name").alias(view))
    return rows.join(names, view, "left_semi")
