"""Persona rows: lookup with fallback and parameter defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Retrieval defaults of the chat service.
RETRIEVAL_DEFAULTS = {
    "k": 50,
    "include_nearby": True,
    "time_window_minutes": 30,
    "nearby_per_result": 8,
    "max_total_results": 50,
    "lambda_mult": 0.6,
}
DEFAULT_MAX_TOKENS = 500


def visible(personas: DataFrame) -> DataFrame:
    """Persona rows without the header row that documents the format."""
    return personas.where(~F.col("_type").eqNullSafe("schema")) if "_type" in personas.columns else personas


def lookup(personas: DataFrame, persona_id: str | None, order: str = "seq") -> DataFrame:
    """The persona with this id, else the first one."""
    wanted = F.col("id").eqNullSafe(persona_id) if persona_id else F.lit(False)
    return visible(personas).orderBy((~wanted).cast("int"), order).limit(1)


def matched(requests: DataFrame, personas: DataFrame, order: str = "seq") -> DataFrame:
    """Requests with their persona id, or the first persona's where theirs is unknown.

    Joins on the persona id; Spark broadcasts the catalogue while it is small.
    """
    known = visible(personas).select(F.col("id").alias("persona_id"), F.col("id").alias("_found"))
    first = visible(personas).orderBy(order).limit(1).select("id").scalar()
    joined = requests.join(known, "persona_id", "left")
    return joined.withColumn("used_persona", F.coalesce("_found", first)).drop("_found")


def parameter(name: str) -> Column:
    """A retrieval parameter: the persona's own, else the default."""
    return F.coalesce(F.col(f"rag_params.{name}"), F.lit(RETRIEVAL_DEFAULTS[name]))


def with_parameters(personas: DataFrame) -> DataFrame:
    own = {name: parameter(name) for name in RETRIEVAL_DEFAULTS}
    own["max_tokens"] = F.coalesce("model_params.max_tokens", F.lit(DEFAULT_MAX_TOKENS))
    return visible(personas).withColumns(own)


def parsed(text: Column) -> Column:
    """A JSON object as a map of open values; anything else, and broken JSON, gives NULL."""
    value = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value.cast("map<string,variant>"))


def merged(old: Column, change: Column) -> Column:
    """Open values (maps to VARIANT) with those of a change put over them; keys that the change does not name stay.

    A NULL side counts as empty; two NULLs give NULL. A JSON null in the change is a value like any other.
    """
    kept = F.map_filter(old, lambda name, _: ~F.coalesce(F.map_contains_key(change, name), F.lit(False)))
    both = F.map_concat(kept, change)
    return F.coalesce(both, change, old)


def merged_all(changes: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One map of open values for each key: of every name the value of the latest change that holds it.

    The changes are told apart name by name, so a key with many changes is cut to one row a name in every
    task before anything is shuffled. NULL maps change nothing; a key with no values gives no row. Changes
    of the same order number are taken by their JSON text, the larger one.
    """
    names = changes.select(F.col(key), F.col(order), F.explode(value).alias("_name", "_value"))
    texts = names.withColumn("_text", F.to_json("_value"))
    latest = texts.groupBy(key, "_name").agg(F.max(F.struct(order, "_text"))["_text"].alias("_text"))
    pairs = F.sort_array(F.collect_list(F.struct("_name", "_text")))
    return latest.groupBy(key).agg(
        F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["_name"], F.parse_json(p["_text"])))).alias(value)
    )


def open_value(values: Column, name: str, kind: str) -> Column:
    """The value of a name in a map of open values as a Spark type, NULL where it is missing or of another kind."""
    return F.try_variant_get(values[name], "$", kind)


def catalogue(created: DataFrame, changes: DataFrame, deleted: DataFrame) -> DataFrame:
    """Personas after all changes of their parameters, without those that were deleted.

    `created` holds id, name, seq and params (open values or NULL), `changes` id, seq and params, `deleted` ids.
    Later changes go over earlier ones, name by name, and all over what a persona was created with. Changes of
    unknown ids and of deleted personas have no effect; a NULL id is never changed nor deleted.
    """
    late = merged_all(changes.where(F.col("id").isNotNull()), "id", "seq", "params").withColumnRenamed("params", "_late")
    left = visible(created).join(deleted.select("id").where(F.col("id").isNotNull()), "id", "left_anti")
    return left.join(late, "id", "left").withColumn("params", merged(F.col("params"), F.col("_late"))).drop("_late")
