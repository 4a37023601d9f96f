"""Layer registry and run history as small keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def upsert(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed rows replace those of the same name in place; new names come last."""
    last = registry.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("_last"))
    old = registry.select("name", "position")
    placed = changes.drop("position").join(old, "name", "left").crossJoin(F.broadcast(last))  # one row
    fresh = F.row_number().over(Window.partitionBy(F.col("position").isNull()).orderBy("name"))
    placed = placed.withColumn("position", F.coalesce("position", F.col("_last") + fresh)).drop("_last")
    return registry.join(changes.select("name"), "name", "left_anti").unionByName(placed.select(registry.columns))


def remove(registry: DataFrame, names: list[str]) -> DataFrame:
    return registry.filter(~F.col("name").isin(names))


def reorder(registry: DataFrame, names: list[str]) -> DataFrame:
    """Positions after ``names``, which must be all names of the registry."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("name")) - 1
    if sorted(r["name"] for r in registry.select("name").collect()) != sorted(names):
        raise ValueError("every layer must be named once")
    return registry.withColumns({"position": place, "z_index": place})


def visible(registry: DataFrame) -> DataFrame:
    return registry.filter("is_visible").orderBy("z_index", "position")


def set_opacity(registry: DataFrame, name: str, opacity: float) -> DataFrame:
    """Opacity held to 0 to 1, fill at 0.8 of it; changes up to 0.001 are ignored."""
    value = min(1.0, max(0.0, opacity))
    here = (F.col("name") == name) & (F.abs(F.col("opacity") - value) > 0.001)
    return registry.withColumns({"opacity": F.when(here, value).otherwise(F.col("opacity")), "fill_opacity": F.when(here, 0.8 * value).otherwise(F.col("fill_opacity"))})


def hierarchy(layers: DataFrame) -> DataFrame:
    """Layers per group, script and run with all sub-totals."""
    return layers.rollup("group_name", "script", "run_id").agg(F.count("*").alias("n_layers"), F.grouping_id().alias("level"))


def history(events: DataFrame) -> DataFrame:
    """Events newest first."""
    return events.orderBy(F.desc("timestamp"), F.desc("event_id"))


def recent_scripts(runs: DataFrame, most: int = 5) -> DataFrame:
    """The scripts used last, most recent first, then by name."""
    return runs.groupBy("processor", "script").agg(F.max("used_at").alias("used_at")).withColumn("rank", F.row_number().over(Window.partitionBy("processor").orderBy(F.desc("used_at"), "script"))).filter(F.col("rank") <= most)


def latest_script(runs: DataFrame) -> DataFrame:
    """Per processor the script used last; the first by name on ties."""
    return recent_scripts(runs, 1).drop("rank")


def restore(registry: DataFrame, saved: DataFrame, columns: list[str]) -> DataFrame:
    """Saved values by name; names that are gone are skipped."""
    old = saved.select("name", *[F.col(c).alias(f"_{c}") for c in columns])
    return registry.join(old, "name", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def lineage(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Layers with script, inputs and outputs of their run, else their own
    recorded file."""
    return registry.join(runs, "run_id", "left").withColumn("input", F.coalesce(F.get("inputs", F.lit(0)), "input_file")).withColumn("reprocess", F.coalesce(F.get("outputs", F.lit(0)), "input"))
