"""Scores of impact matrices against ground truth that is merged from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenmill.functions.text import normalize_category
from screenmill.operators.knn import knn
from screenmill.vocab import SCORE_WEIGHTS, SCORED_CATEGORIES, SIGNIFICANCE


def scale(significance):
    """Place on the scale of severity; null for other values."""
    return F.coalesce(*(F.when(significance == name, F.lit(n)) for name, n in SIGNIFICANCE.items()))


def label_of(number):
    return F.coalesce(*(F.when(number == n, F.lit(name)) for name, n in SIGNIFICANCE.items()))


def sample_chunks(chunks: DataFrame, max_chunks: int = 40) -> DataFrame:
    """Up to max_chunks of each evaluation: first tables, up to half of them, then others of the first 4 * max_chunks."""
    order = [F.asc("chunk_label"), F.asc("id")]
    w = Window.partitionBy("evaluation_id")
    ranked = chunks.withColumn("any_rank", F.row_number().over(w.orderBy(*order))).withColumn("table_rank", F.row_number().over(w.orderBy(F.desc("has_table"), *order)))
    tables = F.col("has_table") & (F.col("table_rank") <= max(1, max_chunks // 2))
    chosen = ranked.filter(tables | (F.col("any_rank") <= 4 * max_chunks)).withColumn("tier", F.when(tables, 0).otherwise(1))
    return chosen.withColumn("rank", F.row_number().over(w.orderBy("tier", *order))).filter(F.col("rank") <= max_chunks).select(*chunks.columns, "tier", "rank")


def merge_ground_truth(truth: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Per project and category name the entry of highest significance; ties go to the newest document, then list order.

    first_pos is where the name was first seen: later matching breaks ties by it.
    """
    rows = truth.join(evaluations.select("evaluation_id", "project_id", "uploaded_at"), "evaluation_id").filter("project_id IS NOT NULL")
    seen = F.struct((-F.unix_micros("uploaded_at")).alias("t"), (-F.col("evaluation_id")).alias("e"), "pos")
    best = F.struct((-scale(F.col("significance"))).alias("s"), *(F.col("seen")[k].alias(k) for k in ("t", "e", "pos")))
    return rows.withColumn("seen", seen).groupBy("project_id", "category_name").agg(F.min("seen").alias("first_pos"), F.min_by(F.struct("significance", "mitigation", "evidence"), best).alias("v")).select("project_id", "category_name", "first_pos", "v.*")


def match_categories(truth: DataFrame) -> DataFrame:
    """project_id, category and the ground-truth entry that matches each scored category (null: none).

    The same normalised name, else the entry that shares most words with it; ties go to the earliest.  Entries with one
    normalised name keep the first's place and the last's values.
    """
    norm = truth.withColumn("norm", normalize_category(F.col("category_name"))).groupBy("project_id", "norm").agg(F.min("first_pos").alias("at"), F.max_by(F.struct("category_name", "significance", "evidence"), "first_pos").alias("v"))
    spark = truth.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(c,) for c in SCORED_CATEGORIES], "category string").withColumn("wanted", normalize_category(F.col("category"))))
    words = wanted.select("category", "wanted", F.explode(F.split("wanted", " ")).alias("word"))
    shared = norm.select("project_id", "norm", "at", "v", F.explode(F.array_distinct(F.split("norm", " "))).alias("word")).filter("word <> ''").join(F.broadcast(words), "word")
    best = shared.groupBy("project_id", "category", "wanted", "norm", "at", "v").agg(F.countDistinct("word").alias("n"))
    rank = F.struct((F.col("norm") == F.col("wanted")).alias("exact"), F.col("n"))
    w = Window.partitionBy("project_id", "category").orderBy(F.desc(rank), "at")
    found = best.withColumn("r", F.row_number().over(w)).filter("r = 1").select("project_id", "category", "v.*")
    grid = truth.select("project_id").distinct().crossJoin(wanted.select("category"))
    return grid.join(found, ["project_id", "category"], "left")


def agent_significance(cells: DataFrame) -> DataFrame:
    """Most severe significance per project and category; other values are ignored."""
    return cells.groupBy("project_id", "category").agg(label_of(F.coalesce(F.max(scale(F.col("significance"))), F.lit(0))).alias("agent_significance"))


def category_labels(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """TP, FP, FN or TN of each scored category of each project that has cells or truth."""
    spark = cells.sparkSession
    scored = F.broadcast(spark.createDataFrame([(c,) for c in SCORED_CATEGORIES], "category string"))
    projects = cells.select("project_id").union(truth.select("project_id")).distinct()
    joined = projects.crossJoin(scored).join(agent_significance(cells), ["project_id", "category"], "left").join(match_categories(truth), ["project_id", "category"], "left")
    agent, real = F.coalesce("agent_significance", F.lit("none")), F.coalesce("significance", F.lit("none"))
    label = F.when((agent != "none") & (real != "none"), "TP").when(agent != "none", "FP").when(real != "none", "FN").otherwise("TN")
    return joined.select("project_id", "category", label.alias("label"), agent.alias("agent_significance"), real.alias("gt_significance"), F.col("category_name").alias("gt_matched_name"), F.col("evidence").alias("gt_evidence"))


def scores(labels: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Per project precision, recall, F1, ordinal accuracy, coverage and the weighted total, with the labels' details.

    Without positives P (or R) is 1; F1 is 0 if P + R is 0; accuracy counts TP, FP and FN by their distance on the scale.
    """
    n = lambda k: F.count_if(F.col("label") == k)
    distance = F.abs(scale(F.col("agent_significance")) - scale(F.col("gt_significance")))
    value = F.when(F.col("label") == "TN", None).when(distance == 0, 1.0).when(distance == 1, 0.5).otherwise(0.0)
    named = lambda k: F.sort_array(F.collect_list(F.when(F.col("label") == k, F.col("category"))))
    detail = F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", F.struct("label", "agent_significance", "gt_significance", "gt_matched_name", "gt_evidence")))))
    per = labels.groupBy("project_id").agg(n("TP").alias("n_tp"), n("FP").alias("n_fp"), n("FN").alias("n_fn"), F.coalesce(F.avg(value), F.lit(0.0)).alias("accuracy"), F.count(value).alias("significance_samples"), named("TP").alias("tp"), named("FP").alias("fp"), named("FN").alias("fn"), detail.alias("per_category"))
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(1.0)
    per = per.withColumn("p", ratio(F.col("n_tp"), F.col("n_fp"))).withColumn("r", ratio(F.col("n_tp"), F.col("n_fn"))).withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    per = per.join(coverage, "project_id", "left") if coverage is not None else per.withColumn("coverage", F.lit(None).cast("double"))
    a, b, c = SCORE_WEIGHTS
    covered = F.coalesce("coverage", F.lit(0.0))
    r4 = lambda x: F.round(x, 4)
    return per.select("project_id", r4(F.col("f")).alias("category_f1"), r4(F.col("p")).alias("category_precision"), r4(F.col("r")).alias("category_recall"), r4(F.col("accuracy")).alias("significance_accuracy"), r4(covered).alias("semantic_coverage"), r4(a * F.col("f") + b * F.col("accuracy") + c * covered).alias("overall_score"), "significance_samples", "tp", "fp", "fn", "per_category")


def first_reasonings(cells: DataFrame, n: int = 10) -> DataFrame:
    """The first n non-empty reasonings of each project in the order of its cells."""
    w = Window.partitionBy("project_id").orderBy("pos")
    return cells.filter("trim(reasoning) <> ''").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).select("project_id", "k", "reasoning")


def semantic_coverage(reasonings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per project the mean over its reasonings (with vectors) of the best similarity to a chunk of its documents.

    The most chunks similar are found within the project only; a project without chunks gets 0.
    """
    queries = reasonings.withColumn("query_id", F.concat_ws(":", F.col("project_id").cast("string"), F.col("k").cast("string")))
    best = knn(queries, chunks, 1, scope="project_id")
    joined = queries.select("project_id", "query_id").join(best.select("query_id", "similarity"), "query_id", "left")
    return joined.groupBy("project_id").agg(F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("coverage"))
