"""Raw model answers to validated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenmill import schemas
from screenmill.functions.text import trim_white
from screenmill.vocab import MITIGATION, REVIEW_BELOW, SIGNIFICANCE


def unfenced(text: Column) -> Column:
    """Without code fences, trimmed."""
    parts = F.split(F.coalesce(text, F.lit("")), "```")
    # a fence opens every second part, with the language's name before the code
    code = F.transform(parts, lambda p, k: trim_white(F.when(k > 0, F.regexp_replace(p, "^json", "")).otherwise(p)))
    return trim_white(F.array_join(code, ""))


def salvaged(text: Column, schema: str, key: str | None, mode: str) -> Column:
    """The array of objects in an answer, null if none can be read.

    mode: "object" (whole text, else the outermost {...}; a bare list is accepted), "list" (whole text, else the
    outermost [...]), "bare_list" (the outermost [...] with fences untouched, else the whole text).
    """
    clean = unfenced(text) if mode != "bare_list" else F.coalesce(text, F.lit(""))
    inner = F.regexp_extract(clean, r"(?s)\{.*\}" if mode == "object" else r"(?s)\[.*\]", 0)
    as_list = lambda t: F.when(F.trim(t).startswith("["), F.from_json(t, schema))
    as_object = lambda t: F.when(F.trim(t).startswith("{"), F.from_json(t, f"struct<{key}:{schema}>")[key])
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    whole = valid(clean)
    if mode == "object":
        return F.coalesce(as_object(whole), as_list(whole), F.when(whole.isNull(), as_object(valid(inner))))
    if mode == "list":
        return F.coalesce(as_list(whole), as_object(whole) if key else F.lit(None), F.when(whole.isNull(), as_list(valid(inner))))
    return F.coalesce(as_list(valid(inner)), as_list(whole))


def valid_confidence(text: Column) -> Column:
    """A JSON number clamped to 0..1 and rounded to two places; 0.5 if it is none."""
    number = F.when(text.rlike(r"^-?\d"), text.try_cast("double"))
    return F.round(F.least(F.greatest(F.coalesce(number, F.lit(0.5)), F.lit(0.0)), F.lit(1.0)), 2)


def valid_significance(text: Column, lower: bool = True) -> Column:
    s = F.lower(text) if lower else text
    return F.when(s.isin(*SIGNIFICANCE), s).otherwise("none")


def parse_cells(answers: DataFrame, by: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """One row for each cell of each answer (column text), in order (pos); nothing for answers that can't be read."""
    cells = answers.select(*by, F.posexplode_outer(salvaged(F.col("text"), schemas.CELLS, "cells", "object")).alias("pos", "c")).filter("c IS NOT NULL")
    det = F.col("c.determination")
    mitigation = F.filter(F.coalesce(det["mitigation"], F.array().cast("array<string>")), lambda m: F.lower(m).isin(*MITIGATION))
    confidence = valid_confidence(det["confidence"])
    text = lambda c: F.coalesce(c, F.lit(""))
    return cells.select(
        *by,
        "pos",
        text(F.col("c.action")).alias("action"),
        text(F.col("c.category")).alias("category"),
        text(F.col("c.framework")).alias("framework"),
        valid_significance(det["significance"]).alias("significance"),
        confidence.alias("confidence"),
        text(det["reasoning"]).alias("reasoning"),
        mitigation.alias("mitigation"),
        (confidence < REVIEW_BELOW).alias("needs_review"),
    )


def parse_ground_truth(answers: DataFrame, by: tuple[str, ...] = ("evaluation_id",)) -> DataFrame:
    rows = answers.select(*by, F.posexplode_outer(salvaged(F.col("text"), schemas.TRUTH, None, "list")).alias("pos", "c")).filter("c IS NOT NULL")
    name = F.trim(F.lower(F.coalesce("c.category_name", F.lit("unknown"))))
    mitigation = F.filter(F.coalesce("c.mitigation", F.array().cast("array<string>")), lambda m: m.isin(*MITIGATION))
    return rows.select(*by, "pos", name.alias("category_name"), valid_significance(F.lower(F.col("c.significance"))).alias("significance"), mitigation.alias("mitigation"), F.coalesce("c.evidence", F.lit("")).alias("evidence"))


def parse_regulations(answers: DataFrame, by: tuple[str, ...] = ("project_id",)) -> DataFrame:
    rows = answers.select(*by, F.posexplode_outer(salvaged(F.col("text"), schemas.REGULATIONS, None, "bare_list")).alias("pos", "c")).filter("c IS NOT NULL")
    return rows.select(*by, "pos", *(F.coalesce(f"c.{k}", F.lit("")).alias(k) for k in ("name", "description", "jurisdiction", "citation")))


def parse_projects(answers: DataFrame) -> DataFrame:
    """project_id, project_type, scale, location and actions; any failure gives the defaults, falsy actions go."""
    clean = unfenced(F.col("text"))
    p = F.from_json(F.when(F.try_parse_json(clean).isNotNull(), clean), schemas.PROJECT)
    given = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), default)
    actions = F.filter(F.coalesce(p["actions"], F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != "")
    return answers.select("project_id", *(given(p[k], F.lit("unknown")).alias(k) for k in ("project_type", "scale")), given(p["location"], F.coalesce("coordinates", F.lit("unknown"))).alias("location"), actions.alias("actions"))


def with_actions(projects: DataFrame) -> DataFrame:
    """Three default actions from the project's type where it has none."""
    kind = F.coalesce("project_type", F.lit("unknown"))
    defaults = F.array(*(F.concat(kind, F.lit(f" — {step}")) for step in ("site preparation", "construction", "operation")))
    return projects.withColumn("actions", F.when(F.coalesce(F.size("actions"), F.lit(0)) > 0, F.col("actions")).otherwise(defaults))
