"""The impact matrix and the parts of the report that derive from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenmill.functions.text import truncate_text
from screenmill.vocab import LAYER_CATEGORIES, REVIEW_BELOW


def project_categories(layers: DataFrame) -> DataFrame:
    """project_id and categories of non-empty layers in a fixed order; air quality once, then noise and traffic."""
    named = layers.groupBy("project_id").agg(F.collect_set(F.when(F.length("payload") > 2, F.col("layer"))).alias("there"))
    found = F.array_compact(F.array(*(F.when(F.array_contains("there", layer), category) for layer, category in LAYER_CATEGORIES)))
    return named.select("project_id", F.concat(found, F.when(F.array_contains(found, "air_quality"), F.array().cast("array<string>")).otherwise(F.array(F.lit("air_quality"))), F.array(F.lit("noise"), F.lit("traffic"))).alias("categories"))


def source_status(layers: DataFrame) -> DataFrame:
    """Retrieved, or no data, for each known layer of each project."""
    there = layers.groupBy("project_id").agg(F.collect_set(F.when(F.length("payload") > 2, F.col("layer"))).alias("there"))
    rows = F.array(*(F.struct(F.lit(layer).alias("layer"), F.when(F.array_contains("there", layer), "Retrieved").otherwise("No data / Error").alias("status")) for layer, _ in LAYER_CATEGORIES))
    return there.select("project_id", F.explode(rows).alias("r")).select("project_id", "r.*")


def evaluation_grid(projects: DataFrame, categories: DataFrame, regulations: DataFrame) -> DataFrame:
    """Every action x category x framework of a project that is to be judged."""
    frameworks = regulations.groupBy("project_id").agg(F.collect_set("name").alias("frameworks"))
    joined = projects.select("project_id", "actions").join(categories, "project_id").join(frameworks, "project_id")
    return joined.select("project_id", F.explode("actions").alias("action"), "categories", "frameworks").select("project_id", "action", F.explode("categories").alias("category"), "frameworks").select("project_id", "action", "category", F.explode("frameworks").alias("framework"))


def matrix(cells: DataFrame, projects: DataFrame, wide: list[str] | None = None) -> DataFrame:
    """Every category x action of a project (arrays of projects) with its last cell; wide: these categories as columns."""
    grid = projects.select("project_id", F.explode("actions").alias("action"), "categories").select("project_id", "action", F.explode("categories").alias("category"))
    last = cells.groupBy("project_id", "action", "category").agg(F.max_by(F.struct("significance", "confidence", "needs_review"), "pos").alias("c"))
    long = grid.join(last, ["project_id", "action", "category"], "left").select("project_id", "action", "category", "c.*")
    return long if wide is None else long.groupBy("project_id", "action").pivot("category", wide).agg(F.first("significance"))


def highlights(cells: DataFrame, threshold: float = REVIEW_BELOW) -> DataFrame:
    """Cells of low confidence (missing: 1) as excerpts with their clarity."""
    confidence = F.coalesce("confidence", F.lit(1.0))
    return cells.filter(confidence < threshold).select("project_id", "pos", F.concat("category", F.lit(" / "), "action", F.lit(": "), "significance").alias("excerpt"), F.least(confidence + 0.1, F.lit(1.0)).alias("regulatory_clarity"))


def disclaimers(cells: DataFrame, threshold: float = REVIEW_BELOW) -> DataFrame:
    review = F.coalesce("needs_review", F.lit(False)) | (F.coalesce("confidence", F.lit(1.0)) < threshold)
    return cells.filter(review).select("project_id", "pos", "action", "category", "significance", "confidence")


def _listed(*fields: str):
    return F.transform(F.sort_array(F.collect_list(F.struct("pos", *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields)))


def by_category(cells: DataFrame) -> DataFrame:
    return cells.groupBy("project_id", "category").agg(F.count(F.lit(1)).alias("n_cells"), _listed("action", "significance", "confidence").alias("cells"))


def by_mitigation(cells: DataFrame) -> DataFrame:
    """Cells under each of their kinds of mitigation."""
    return cells.withColumn("kind", F.explode("mitigation")).groupBy("project_id", F.lower("kind").alias("mitigation")).agg(F.count(F.lit(1)).alias("n_cells"), _listed("action", "category").alias("cells"))


def report_metadata(cells: DataFrame, outputs: DataFrame, threshold: float = REVIEW_BELOW) -> DataFrame:
    flags = cells.groupBy("project_id").agg(F.count_if(F.coalesce("confidence", F.lit(1.0)) < threshold).alias("low_confidence"), F.count_if(F.col("needs_review")).alias("human_review"))
    calls = outputs.groupBy("project_id").agg(F.count(F.lit(1)).alias("llm_calls"), F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"))
    return flags.join(calls, "project_id", "full_outer").fillna(0)


def matrix_markdown(long: DataFrame) -> DataFrame:
    """A Markdown table of each project's matrix: a row for each category, a column for each action."""
    cell = F.coalesce(F.concat("significance", F.lit(" ("), F.format_string("%.2f", F.col("confidence")), F.lit(")")), F.lit("—"))
    rows = long.select("project_id", "category", "action", cell.alias("cell")).groupBy("project_id", "category").agg(F.sort_array(F.collect_list(F.struct("action", "cell"))).alias("cells"))
    line = F.concat(F.lit("| "), "category", F.lit(" | "), F.array_join(F.transform("cells", lambda c: c["cell"]), " | "), F.lit(" |"))
    per = rows.select("project_id", "category", line.alias("line"), F.transform("cells", lambda c: c["action"]).alias("actions"))
    made = per.groupBy("project_id").agg(F.first("actions").alias("actions"), F.sort_array(F.collect_list(F.struct("category", "line"))).alias("lines"))
    head = F.concat(F.lit("| Category | "), F.array_join("actions", " | "), F.lit(" |\n|"), F.repeat(F.lit("---|"), F.size("actions") + 1))
    return made.select("project_id", F.concat(head, F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("markdown"))


def query_text(projects: DataFrame, flags: DataFrame) -> DataFrame:
    """The retrieval query of each project from its description and its layers' flags."""
    joined = projects.join(flags, "project_id", "left")
    part = lambda label, c, default: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit(default)))
    parts = (("Project type", "project_type", "unknown"), ("Scale", "scale", "unknown"), ("Coordinates", "coordinates", "unknown"), ("In SFHA", "in_sfha", "false"), ("T&E species count", "species_count", "0"), ("Wetland features", "wetland_count", "0"), ("Prime farmland", "is_prime", "false"))
    return joined.select("project_id", F.concat_ws(" | ", *(part(*p) for p in parts)).alias("query_text"))


def prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """The excerpts of each query's hits in the order of rank, numbered, after its text."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("breadcrumb"), F.lit("\n"), truncate_text(F.col("content")))
    excerpts = hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("excerpts"))
    return queries.join(excerpts, "query_id", "left").select("query_id", F.concat_ws("\n\n", "query_text", "excerpts").alias("prompt"))
