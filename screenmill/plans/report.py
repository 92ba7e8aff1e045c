"""Queries on answers, matrices, scores and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenmill.operators import answers as A
from screenmill.operators import matrix as M
from screenmill.operators import scoring as S
from screenmill.operators import spatial as P
from screenmill.plans.registry import Tables, query
from screenmill.sources.io import spread
from screenmill.vocab import SCORED_CATEGORIES

LEVELS = ("none", "minimal", "moderate", "significant", "severe")


def picked(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def answers(t: Tables):
    """Answers of a model made of conversation turns: fenced JSON with one cell, or plain text."""
    k = F.col("conv_id") * 7 + F.col("turn")
    cell = F.concat(F.lit('```json\n{"cells": [{"action": "act '), (k % 4).cast("string"), F.lit('", "category": "'), picked(SCORED_CATEGORIES, k % 8), F.lit('", "framework": "NEPA", "determination": {"significance": "'), F.initcap(picked(LEVELS, k % 5)), F.lit('", "confidence": '), (k % 13 / 10).cast("string"), F.lit(', "reasoning": "because '), (k % 3).cast("string"), F.lit('", "mitigation": ["Avoidance", "other"]}}]}\n```'))
    return t.conversations.select(F.col("conv_id").alias("project_id"), F.col("turn").alias("run_id"), F.when(k % 6 == 0, F.coalesce("text", F.lit(""))).otherwise(cell).alias("text"))


CATS = "['" + "', '".join(SCORED_CATEGORIES) + "']"
CELLS = f"""cells AS (SELECT conv_id AS project_id, turn AS run_id, 'act ' || (k % 4) AS action, {CATS}[k % 8 + 1] AS category, 'NEPA' AS framework, ['none', 'minimal', 'moderate', 'significant', 'none'][k % 5 + 1] AS significance,
 least(k % 13 / 10.0, 1.0)::DOUBLE AS confidence, 'because ' || (k % 3) AS reasoning FROM (SELECT *, conv_id * 7 + turn AS k FROM conversations) WHERE k % 6 <> 0)"""


def cells(t: Tables):
    return A.parse_cells(answers(t), ("project_id", "run_id"))


@query(f"WITH {CELLS} SELECT project_id, run_id, action, category, framework, significance, confidence, reasoning, 1 AS n_mitigation, confidence < 0.6 AS needs_review FROM cells")
def parsed_cells(t: Tables):
    return cells(t).select("project_id", "run_id", "action", "category", "framework", "significance", "confidence", "reasoning", F.size("mitigation").alias("n_mitigation"), "needs_review")


@query(f"WITH {CELLS} SELECT project_id, category || ' / ' || action || ': ' || significance AS excerpt, round(least(confidence + 0.1, 1.0), 2) AS regulatory_clarity FROM cells WHERE confidence < 0.6")
def low_confidence_highlights(t: Tables):
    return M.highlights(cells(t)).select("project_id", "excerpt", F.round("regulatory_clarity", 2).alias("regulatory_clarity"))


@query(f"WITH {CELLS} SELECT project_id, action, category, confidence FROM cells WHERE confidence < 0.6")
def disclaimer_items(t: Tables):
    return M.disclaimers(cells(t)).select("project_id", "action", "category", "confidence")


@query(f"WITH {CELLS} SELECT project_id, category, count(*) AS n_cells, string_agg(action || '/' || significance || '/' || printf('%.1f', confidence), ', ' ORDER BY run_id) AS cells FROM cells GROUP BY 1, 2")
def cells_by_category(t: Tables):
    text = F.transform("cells", lambda c: F.concat_ws("/", c["action"], c["significance"], F.format_string("%.1f", c["confidence"])))
    return M.by_category(ordered_cells(t)).select("project_id", "category", "n_cells", F.array_join(text, ", ").alias("cells"))


@query(f"WITH {CELLS} SELECT project_id, 'avoidance' AS mitigation, count(*) AS n_cells, string_agg(action || '/' || category, ', ' ORDER BY run_id) AS cells FROM cells GROUP BY 1")
def cells_by_mitigation(t: Tables):
    text = F.transform("cells", lambda c: F.concat_ws("/", c["action"], c["category"]))
    return M.by_mitigation(ordered_cells(t)).select("project_id", "mitigation", "n_cells", F.array_join(text, ", ").alias("cells"))


def ordered_cells(t: Tables):
    return cells(t).withColumn("pos", F.col("run_id").cast("int"))


@query(f"""WITH {CELLS}, p AS (SELECT DISTINCT conv_id AS project_id FROM conversations), g AS (SELECT project_id, 'act ' || a AS action, unnest({CATS}) AS category FROM p, range(4) r(a)),
l AS (SELECT project_id, action, category, arg_max(significance, run_id) AS significance FROM cells GROUP BY 1, 2, 3) SELECT g.*, l.significance FROM g LEFT JOIN l USING (project_id, action, category)""")
def impact_matrix(t: Tables):
    projects = t.conversations.select(F.col("conv_id").alias("project_id")).distinct().select("project_id", F.array(*(F.lit(f"act {a}") for a in range(4))).alias("actions"), F.array(*map(F.lit, SCORED_CATEGORIES)).alias("categories"))
    return M.matrix(ordered_cells(t), projects).select("project_id", "action", "category", "significance")


@query(f"""WITH {CELLS} SELECT project_id, category, ['none', 'minimal', 'moderate', 'significant'][max(list_position(['none', 'minimal', 'moderate', 'significant'], significance))] AS agent_significance FROM cells GROUP BY 1, 2""")
def agent_significance(t: Tables):
    return S.agent_significance(cells(t))


@query(f"""WITH {CELLS}, r AS (SELECT project_id, reasoning, row_number() OVER (PARTITION BY project_id ORDER BY run_id) AS k FROM cells) SELECT project_id, k, reasoning FROM r WHERE k <= 10""")
def first_reasonings(t: Tables):
    return S.first_reasonings(ordered_cells(t))


def truth(t: Tables):
    """Labelled documents as entries of ground truth; a document is an evaluation of its source's project."""
    d = F.col("doc_id")
    return t.labels.select(d.alias("evaluation_id"), F.lit(0).alias("pos"), F.replace(picked(SCORED_CATEGORIES, d % 8), F.lit("_"), F.lit(" ")).alias("category_name"), picked(LEVELS[:4], (d % 3) * F.col("quality") + F.col("toxic")).alias("significance"), F.array(F.lit("avoidance")).alias("mitigation"), d.cast("string").alias("evidence"))


def evaluations(t: Tables):
    return t.documents.select(F.col("doc_id").alias("evaluation_id"), F.col("source").alias("project_id"), F.timestamp_seconds(F.col("doc_id") % 100).alias("uploaded_at"))


TRUTH = f"""truth AS (SELECT doc_id AS evaluation_id, replace({CATS}[doc_id % 8 + 1], '_', ' ') AS category_name, (doc_id % 3) * quality + toxic AS s, source AS project_id, doc_id % 100 AS tm FROM labels JOIN documents USING (doc_id)),
merged AS (SELECT project_id, category_name, arg_max(s, (s, tm, evaluation_id)) AS s, arg_max(evaluation_id, (s, tm, evaluation_id)) AS e FROM truth GROUP BY 1, 2)"""


@query(f"WITH {TRUTH} SELECT project_id, category_name, ['none', 'minimal', 'moderate', 'significant'][s + 1] AS significance, e::VARCHAR AS evidence FROM merged")
def merged_ground_truth(t: Tables):
    return S.merge_ground_truth(truth(t), evaluations(t)).select("project_id", "category_name", "significance", "evidence")


def agent_cells(t: Tables):
    """The agent's cells of a source's project: every document gives one."""
    d = F.col("doc_id")
    return t.documents.select(F.col("source").alias("project_id"), d.alias("pos"), picked(SCORED_CATEGORIES, (d * 3) % 8).alias("category"), F.when(d % 40 == 0, picked(LEVELS, d % 5)).otherwise("none").alias("significance"))


SCORES = f"""{TRUTH}, agent AS (SELECT source AS project_id, {CATS}[(doc_id * 3) % 8 + 1] AS category, max(CASE WHEN doc_id % 40 = 0 AND doc_id % 5 < 4 THEN doc_id % 5 ELSE 0 END) AS a FROM documents GROUP BY 1, 2),
g AS (SELECT p.project_id, c.category, coalesce(a, 0) AS a, coalesce(s, 0) AS s FROM (SELECT DISTINCT source AS project_id FROM documents) p CROSS JOIN (SELECT unnest({CATS}) AS category) c
 LEFT JOIN agent USING (project_id, category) LEFT JOIN (SELECT project_id, replace(category_name, ' ', '_') AS category, s FROM merged) m USING (project_id, category)),
l AS (SELECT *, CASE WHEN a > 0 AND s > 0 THEN 'TP' WHEN a > 0 THEN 'FP' WHEN s > 0 THEN 'FN' ELSE 'TN' END AS label FROM g)"""


@query(f"WITH {SCORES} SELECT project_id, category, label FROM l")
def category_labels(t: Tables):
    return S.category_labels(agent_cells(t), S.merge_ground_truth(truth(t), evaluations(t))).select("project_id", "category", "label")


@query(f"""WITH {SCORES}, n AS (SELECT project_id, count(*) FILTER (label = 'TP') AS tp, count(*) FILTER (label = 'FP') AS fp, count(*) FILTER (label = 'FN') AS fn,
 coalesce(avg(CASE WHEN label = 'TN' THEN NULL WHEN abs(a - s) = 0 THEN 1.0 WHEN abs(a - s) = 1 THEN 0.5 ELSE 0.0 END), 0) AS acc FROM l GROUP BY project_id),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS q FROM n),
f AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END AS f FROM r)
SELECT project_id, round(f, 4) AS category_f1, round(p, 4) AS category_precision, round(q, 4) AS category_recall, round(acc, 4) AS significance_accuracy, round(0.4 * f + 0.4 * acc, 4) AS overall_score,
 tp + fp + fn AS significance_samples, tps, fps, fns FROM f JOIN (SELECT project_id, {', '.join(f"coalesce(string_agg(category, ',' ORDER BY category) FILTER (label = '{x.upper()}'), '') AS {x}s" for x in ('tp', 'fp', 'fn'))} FROM l GROUP BY project_id) USING (project_id)""")
def project_scores(t: Tables):
    return S.scores(S.category_labels(agent_cells(t), S.merge_ground_truth(truth(t), evaluations(t)))).select("project_id", "category_f1", "category_precision", "category_recall", "significance_accuracy", "overall_score", "significance_samples", *(F.array_join(c, ",").alias(f"{c}s") for c in ("tp", "fp", "fn")))


@query("""WITH q AS (SELECT label AS project_id, vec_id AS k, embedding FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT label, embedding FROM embeddings),
b AS (SELECT project_id, k, max(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS sim FROM q JOIN c ON label = project_id GROUP BY 1, 2) SELECT project_id, round(avg(sim), 4) AS coverage FROM b GROUP BY project_id""")
def semantic_coverage(t: Tables):
    reasonings = t.embeddings.filter("vec_id % 50 = 0").select(F.col("label").alias("project_id"), F.col("vec_id").alias("k"), "embedding")
    return S.semantic_coverage(reasonings, t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("project_id"))).select("project_id", F.round("coverage", 4).alias("coverage"))


@query("""WITH c AS (SELECT source AS evaluation_id, doc_id AS id, lpad(doc_id::VARCHAR, 9, '0') AS chunk_label, doc_id % 4 = 0 AS has_table FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY chunk_label) AS a, row_number() OVER (PARTITION BY evaluation_id ORDER BY NOT has_table, chunk_label) AS b FROM c),
s AS (SELECT *, CASE WHEN has_table AND b <= 10 THEN 0 ELSE 1 END AS tier FROM r WHERE (has_table AND b <= 10) OR a <= 80),
k AS (SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY tier, chunk_label) AS rank FROM s) SELECT evaluation_id, id, tier, rank FROM k WHERE rank <= 20""")
def sampled_chunks(t: Tables):
    rows = t.documents.select(F.col("source").alias("evaluation_id"), F.col("doc_id").alias("id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("chunk_label"), (F.col("doc_id") % 4 == 0).alias("has_table"))
    return S.sample_chunks(rows, 20).select("evaluation_id", "id", "tier", "rank")


def sites(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("project_id"), (F.lit(35) + (k * 37) % 1000 / 100).alias("lat"), (F.lit(-90) + (k * 53) % 1000 / 100).alias("lon"))


def features(t: Tables):
    k = F.col("p_partkey")
    return t.part.select(k.alias("feature_id"), (F.lit(35) + (k * 71) % 2000 / 200).alias("lat"), (F.lit(-90) + (k * 29) % 2000 / 200).alias("lon"), F.col("p_type").alias("kind"))


SITES = """sites AS (SELECT c_custkey AS project_id, 35 + (c_custkey * 37) % 1000 / 100 AS slat, -90 + (c_custkey * 53) % 1000 / 100 AS slon FROM customer),
features AS (SELECT p_partkey AS feature_id, 35 + (p_partkey * 71) % 2000 / 200 AS lat, -90 + (p_partkey * 29) % 2000 / 200 AS lon, p_type AS kind FROM part)"""


@query(f"WITH {SITES} SELECT project_id, feature_id FROM sites JOIN features ON lat BETWEEN slat - 0.0501 AND slat + 0.0501 AND lon BETWEEN slon - 0.0501 AND slon + 0.0501")
def features_in_box(t: Tables):
    return P.features_in_box(sites(t), features(t), 0.0501).select("project_id", "feature_id")


@query(f"""WITH {SITES}, d AS (SELECT project_id, kind, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - slat) / 2), 2) + cos(radians(slat)) * cos(radians(lat)) * pow(sin(radians(lon - slon) / 2), 2)))) AS m
 FROM sites JOIN features ON abs(lat - slat) < 0.2 AND abs(lon - slon) < 0.3) SELECT project_id, count(*) AS n, count(DISTINCT kind) AS n_kinds, round(min(m)) AS nearest FROM d WHERE m <= 10000 GROUP BY project_id""")
def features_within(t: Tables):
    return P.summary_within(sites(t), features(t), "kind", 10000).select("project_id", "n", "n_kinds", F.round("nearest").alias("nearest"))


def readings(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select((F.lit(35) + (k * 71) % 2000 / 200).alias("lat"), (F.lit(-90) + (k * 29) % 2000 / 200).alias("lon"), F.when(k % 2 == 0, "ozone").otherwise("pm25").alias("param"), F.to_date("o_orderdate").alias("date"), F.when(k % 9 != 0, (k % 100).cast("double")).alias("arithmetic_mean"), F.when(k % 5 == 0, "N").otherwise("Y").alias("validity_indicator"), F.when(k % 4 != 0, (k % 60).cast("int")).alias("aqi"))


@query(f"""WITH {SITES}, r AS (SELECT 35 + (o_orderkey * 71) % 2000 / 200 AS lat, -90 + (o_orderkey * 29) % 2000 / 200 AS lon, CASE WHEN o_orderkey % 2 = 0 THEN 'ozone' ELSE 'pm25' END AS param, o_orderkey AS k
 FROM orders WHERE o_orderdate::DATE BETWEEN date '1995-12-31' - 365 AND date '1995-12-31')
SELECT project_id, param, round(avg(k % 100) FILTER (k % 9 <> 0 AND k % 5 <> 0), 2) AS mean, (max(k % 100) FILTER (k % 9 <> 0 AND k % 5 <> 0))::DOUBLE AS max, round(avg(k % 60) FILTER (k % 4 <> 0), 1) AS mean_aqi,
 count(*) FILTER (k % 9 <> 0 AND k % 5 <> 0) AS samples FROM sites JOIN r ON lat BETWEEN slat - 0.1001 AND slat + 0.1001 AND lon BETWEEN slon - 0.1001 AND slon + 0.1001 GROUP BY 1, 2""")
def air_baseline(t: Tables):
    return P.air_baseline(sites(t), readings(t), "1996-01-01", 365, 0.1001)


def squares(t: Tables):
    """Suppliers as square zones of half a degree."""
    k = F.col("s_suppkey")
    x, y = F.lit(-90.0013) + (k * 17) % 100 / 10, F.lit(35.0017) + (k * 43) % 100 / 10
    corner = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    return t.supplier.select(k.alias("zone_id"), F.array(corner(0, 0), corner(0.5, 0), corner(0.5, 0.5), corner(0, 0.5)).alias("ring"), F.concat(F.lit("Z"), (k % 5).cast("string")).alias("fld_zone"), F.when(k % 3 == 0, "T").otherwise("F").alias("sfha_tf"))


@query(f"""WITH {SITES}, z AS (SELECT s_suppkey AS k, -90.0013 + (s_suppkey * 17) % 100 / 10 AS x, 35.0017 + (s_suppkey * 43) % 100 / 10 AS y FROM supplier)
SELECT project_id, k AS zone_id FROM sites JOIN z ON slon > x AND slon < x + 0.5 AND slat > y AND slat < y + 0.5 AND NOT (slon > x + 0.1013 AND slon < x + 0.4013 AND slat > y + 0.1013 AND slat < y + 0.3013)
UNION ALL SELECT project_id, k FROM sites JOIN z ON slon > x + 1 AND slon < x + 1.3 AND slat > y AND slat < y + 0.3""")
def sites_in_parts_and_holes(t: Tables):
    """Suppliers as zones of two squares, the larger with a hole, their edges cut into many points."""
    k = F.col("s_suppkey")
    x, y = F.lit(-90.0013) + (k * 17) % 100 / 10, F.lit(35.0017) + (k * 43) % 100 / 10
    steps = F.sequence(F.lit(0), F.lit(199))

    def box(left, low, wide, tall):
        along = lambda n: n.cast("double") / 200
        sides = (lambda n: (along(n) * wide, F.lit(0.0)), lambda n: (F.lit(wide), along(n) * tall), lambda n: ((1 - along(n)) * wide, F.lit(tall)), lambda n: (F.lit(0.0), (1 - along(n)) * tall))
        point = lambda side, n: F.struct((x + left + side(n)[0]).alias("x"), (y + low + side(n)[1]).alias("y"))
        cut = lambda side: F.transform(steps, lambda n: point(side, n))
        return F.concat(*map(cut, sides))

    zones = spread(t.supplier.select("s_suppkey"), 500).select(k.alias("zone_id"), F.array(box(0, 0, 0.5, 0.5), box(0.1013, 0.1013, 0.3, 0.2), box(1, 0, 0.3, 0.3)).alias("rings"))
    return P.sites_in_polygons(sites(t), zones).select("project_id", "zone_id")


@query(f"""WITH {SITES}, z AS (SELECT s_suppkey AS k, -90.0013 + (s_suppkey * 17) % 100 / 10 AS x, 35.0017 + (s_suppkey * 43) % 100 / 10 AS y FROM supplier),
h AS (SELECT project_id, bool_or(k % 3 = 0) AS in_sfha, count(DISTINCT k % 5) AS n_zones FROM sites JOIN z ON slon > x AND slon < x + 0.5 AND slat > y AND slat < y + 0.5 GROUP BY 1)
SELECT project_id, coalesce(in_sfha, false) AS in_sfha, coalesce(n_zones, 0)::INT AS n_zones FROM sites LEFT JOIN h USING (project_id)""")
def flood_status(t: Tables):
    return P.flood_status(sites(t), squares(t)).select("project_id", "in_sfha", F.size("zones").alias("n_zones"))


@query(f"""WITH {SITES}, z AS (SELECT s_suppkey AS k, -90.0013 + (s_suppkey * 17) % 100 / 10 AS x, 35.0017 + (s_suppkey * 43) % 100 / 10 AS y FROM supplier),
c AS (SELECT p_partkey % 100 + 1 AS k, arg_max(p_name, (p_size, p_name)) AS compname, (arg_max(p_partkey, (p_size, p_name)) % 8)::VARCHAR AS nirrcapcl FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT project_id, z.k::VARCHAR AS mukey, compname, nirrcapcl, CASE nirrcapcl WHEN '1' THEN 'Prime Farmland' WHEN '2' THEN 'Prime Farmland' WHEN '3' THEN 'Farmland of Statewide Importance' ELSE 'Not prime farmland' END AS farmland_class, nirrcapcl IN ('1', '2') AS is_prime FROM sites JOIN z ON slon > x AND slon < x + 0.5 AND slat > y AND slat < y + 0.5 JOIN c ON c.k = z.k""")
def dominant_soil(t: Tables):
    parts = t.part.select((F.col("p_partkey") % 100 + 1).cast("string").alias("mukey"), F.col("p_partkey").alias("cokey"), F.col("p_name").alias("compname"), (F.col("p_partkey") % 8).cast("string").alias("nirrcapcl"), F.col("p_size").alias("comppct_r"), F.when(F.col("p_partkey") % 2 == 0, "Yes").otherwise("No").alias("majcompflag"))
    return P.dominant_soil(sites(t), squares(t).withColumn("mukey", F.col("zone_id").cast("string")), parts).select("project_id", "mukey", "compname", "nirrcapcl", "farmland_class", "is_prime")


@query("""SELECT c_custkey AS project_id, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'endangered_species' END, CASE WHEN c_custkey % 3 = 0 THEN 'wetlands' END, 'air_quality', 'noise,traffic') AS categories FROM customer""")
def project_categories(t: Tables):
    k = F.col("c_custkey")
    layers = t.customer.select(k.alias("project_id"), F.explode(F.array(*(F.struct(F.lit(n).alias("layer"), F.when(k % m == 0, '{"count": 1}').otherwise("{}").alias("payload")) for n, m in (("usfws_species", 2), ("nwi_wetlands", 3), ("epa_aqs", 5))))).alias("l")).select("project_id", "l.*")
    return M.project_categories(layers).select("project_id", F.array_join("categories", ",").alias("categories"))
