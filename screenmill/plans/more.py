"""Queries on listings, parsed answers, prompts, layers and saved runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenmill.functions import text as X
from screenmill.operators import answers as A
from screenmill.operators import browse as B
from screenmill.operators import chunking as C
from screenmill.operators import knn as K
from screenmill.operators import matrix as M
from screenmill.operators import merge as G
from screenmill.operators import metrics as R
from screenmill.operators import spatial as P
from screenmill.plans.registry import OUTPUTS, Tables, query
from screenmill.plans.report import CELLS, SITES, cells, features, ordered_cells, sites, squares
from screenmill.plans.search import chunks
from screenmill.plans.text import CHUNKS, sections_of


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS uploaded_at FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7")
def ready_listing(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("pending").alias("status"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("uploaded_at"), F.lit(b"x").alias("blob"))
    return B.listing(rows, ready_only=True, project_id=7).withColumn("status", F.lit("F")).drop("project_id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'intro' ELSE (doc_id % 12)::VARCHAR END AS chapter FROM documents")
def chunks_in_document_order(t: Tables):
    d = F.col("doc_id")
    rows = t.documents.select(d.alias("id"), F.when(d % 4 == 0, "intro").otherwise((d % 12).cast("string")).alias("chapter"), F.col("source").alias("section_number"), d.alias("chunk_index"))
    return B.document_order(rows).select("id", "chapter")


@query("SELECT vec_id AS id, 'c' || label AS citation, label::INT AS token_count, vec_id % 5 <> 0 AS embedded FROM embeddings")
def lifted_metadata(t: Tables):
    meta = F.struct(F.concat(F.lit("c"), F.col("label").cast("string")).alias("citation"), F.lit("b").alias("breadcrumb"), F.col("label").cast("int").alias("token_count"))
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.lit("x").alias("content"), meta.alias("metadata"), F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("embedding"))
    return B.lifted(rows).select("id", "citation", "token_count", "embedded")


@query("SELECT vec_id AS id, label FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING label % 2 = 0)")
def restricted_chunks(t: Tables):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    return B.restricted(rows, rows.filter("label % 2 = 0"), "label").select("id", "label")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ecfr_xml' WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'pa_code' ELSE 'federal' END END AS parser FROM documents")
def routed_parsers(t: Tables):
    d = F.col("doc_id")
    kind = F.when(d % 3 == 0, "application/xml").when(d % 3 == 1, "application/pdf").otherwise("text/plain")
    page = F.when(d % 2 == 0, F.concat(F.lit("Pennsylvania Code "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return t.documents.select("doc_id", X.route_parser(kind, page).alias("parser"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN round(35 + s_suppkey / 100.0, 2) END AS lat, CASE WHEN s_suppkey % 4 <> 0 THEN round(-90 - s_suppkey / 100.0, 2) END AS lon FROM supplier")
def parsed_coordinates(t: Tables):
    k = F.col("s_suppkey")
    text = F.concat(F.format_string("%.2f", 35 + k / 100), F.when(k % 2 == 0, F.lit(", ")).otherwise(" "), F.format_string("%.2f", -90 - k / 100), F.when(k % 4 == 0, F.lit(" 7")).otherwise(""))
    return t.supplier.select("s_suppkey", X.coordinates(text).alias("c")).select("s_suppkey", "c.lat", "c.lon")


@query("SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) || ' of ' || upper(p_brand[1]) || lower(p_brand[2:]) AS title FROM (SELECT p_partkey, split_part(p_type, ' ', 1) AS p_type, p_brand FROM part)")
def titlecased(t: Tables):
    return t.part.select("p_partkey", X.titlecase(F.upper(F.concat(F.substring_index("p_type", " ", 1), F.lit(" OF "), "p_brand"))).alias("title"))


@query("""SELECT conv_id AS evaluation_id, turn, CASE WHEN turn % 2 = 0 THEN 'wetlands' ELSE 'unknown' END AS category_name, CASE WHEN turn % 3 = 0 THEN 'moderate' ELSE 'none' END AS significance, 1 AS n_mitigation
FROM conversations WHERE turn % 5 <> 4""")
def parsed_ground_truth(t: Tables):
    k = F.col("turn")
    entry = F.concat(F.lit("Here it is:\n[{"), F.when(k % 2 == 0, F.lit('"category_name": " WETLANDS ", ')).otherwise(""), F.lit('"significance": "'), F.when(k % 3 == 0, "Moderate").otherwise("huge"), F.lit('", "mitigation": ["avoidance", "Avoidance"], "evidence": "e"}]\nDone.'))
    rows = t.conversations.select(F.col("conv_id").alias("evaluation_id"), k.alias("turn"), F.when(k % 5 != 4, entry).otherwise("none found").alias("text"))
    return A.parse_ground_truth(rows, ("evaluation_id", "turn")).select("evaluation_id", "turn", "category_name", "significance", F.size("mitigation").alias("n_mitigation"))


@query("SELECT conv_id AS project_id, turn, 'Rule ' || turn AS name, role AS jurisdiction, '' AS citation FROM conversations")
def parsed_regulations(t: Tables):
    text = F.concat(F.lit('permits: [{"name": "Rule '), F.col("turn").cast("string"), F.lit('", "jurisdiction": "'), "role", F.lit('"}] end'))
    return A.parse_regulations(t.conversations.select(F.col("conv_id").alias("project_id"), "turn", text.alias("text")), ("project_id", "turn")).select("project_id", "turn", "name", "jurisdiction", "citation")


@query("""SELECT c_custkey AS project_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'unknown' END AS project_type, CASE WHEN c_custkey % 3 = 0 THEN 'L' || c_custkey ELSE '1, 2' END AS location,
CASE WHEN c_custkey % 3 = 0 THEN 'dig' ELSE 'unknown — site preparation' END AS first_action, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 3 END AS n_actions FROM customer""")
def parsed_projects(t: Tables):
    k = F.col("c_custkey")
    text = F.concat(F.lit('```json\n{"project_type": "'), "c_mktsegment", F.lit('", "location": "L'), k.cast("string"), F.lit('", "actions": ["dig", ""]}\n```'))
    rows = t.customer.select(k.alias("project_id"), F.when(k % 3 == 0, text).otherwise(F.col("c_name")).alias("text"), F.lit("1, 2").alias("coordinates"))
    return A.with_actions(A.parse_projects(rows)).select("project_id", "project_type", "location", F.element_at("actions", 1).alias("first_action"), F.size("actions").alias("n_actions"))


@query(f"""WITH {CELLS}, c AS (SELECT project_id, count(*) FILTER (confidence < 0.6) AS low FROM cells GROUP BY 1), o AS (SELECT conv_id AS project_id, count(*) AS n, sum(turn)::BIGINT AS tokens FROM conversations GROUP BY 1)
SELECT project_id, coalesce(low, 0) AS low_confidence, coalesce(low, 0) AS human_review, n AS llm_calls, tokens FROM o LEFT JOIN c USING (project_id)""")
def report_metadata(t: Tables):
    outputs = t.conversations.select(F.col("conv_id").alias("project_id"), F.col("turn").alias("input_tokens"), F.lit(0).alias("output_tokens"))
    return M.report_metadata(cells(t), outputs)


@query(f"""WITH {CELLS}, l AS (SELECT project_id, category, action, arg_max((significance, confidence), run_id) AS v FROM (SELECT project_id, category, action, significance, confidence, run_id FROM cells) GROUP BY 1, 2, 3)
SELECT project_id, count(DISTINCT category) AS n_rows FROM l GROUP BY project_id""".replace("arg_max((significance, confidence), run_id) AS v", "max(run_id) AS v"))
def matrix_tables(t: Tables):
    long = ordered_cells(t).groupBy("project_id", "category", "action").agg(F.max_by(F.struct("significance", "confidence"), "pos").alias("c")).select("project_id", "category", "action", "c.*")
    made = M.matrix_markdown(long)
    return made.select("project_id", (F.size(F.split("markdown", "\n")) - 2).cast("long").alias("n_rows"))


@query("""SELECT c_custkey AS project_id, layer, CASE WHEN (c_custkey + k) % 2 = 0 THEN 'Retrieved' ELSE 'No data / Error' END AS status FROM customer,
(VALUES ('usfws_species', 0), ('nwi_wetlands', 1), ('ejscreen', 2)) v(layer, k)""")
def layer_status(t: Tables):
    named = (("usfws_species", 0), ("nwi_wetlands", 1), ("ejscreen", 2))
    rows = F.array(*(F.struct(F.lit(n).alias("layer"), F.when((F.col("c_custkey") + k) % 2 == 0, '{"n": 1}').otherwise("{}").alias("payload")) for n, k in named))
    layers = t.customer.select(F.col("c_custkey").alias("project_id"), F.explode(rows).alias("l")).select("project_id", "l.*")
    return M.source_status(layers).filter(F.col("layer").isin(*(n for n, _ in named)))


@query("""SELECT c_custkey AS project_id, a AS action, c AS category, f AS framework FROM customer, (VALUES ('build'), ('run')) v1(a), (VALUES ('noise'), ('traffic')) v2(c), (VALUES ('NEPA'), ('CWA'), ('ESA')) v3(f)""")
def evaluation_grid(t: Tables):
    projects = t.customer.select(F.col("c_custkey").alias("project_id"), F.array(F.lit("build"), F.lit("run")).alias("actions"))
    categories = projects.select("project_id", F.array(F.lit("noise"), F.lit("traffic")).alias("categories"))
    regulations = projects.select("project_id", F.explode(F.array(*map(F.lit, ("NEPA", "CWA", "ESA", "NEPA")))).alias("name"))
    return M.evaluation_grid(projects, categories, regulations)


@query("""SELECT s_suppkey AS project_id, 'Project type: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'road' ELSE 'unknown' END || ' | Scale: unknown | Coordinates: ' || s_suppkey || ' | In SFHA: ' || CASE WHEN s_suppkey % 3 = 0 THEN 'true' ELSE 'false' END
|| ' | T&E species count: 0 | Wetland features: ' || CASE WHEN s_suppkey % 3 = 0 THEN '4' ELSE '0' END || ' | Prime farmland: false' AS query_text FROM supplier""")
def project_query_texts(t: Tables):
    k = F.col("s_suppkey")
    projects = t.supplier.select(k.alias("project_id"), F.when(k % 2 == 0, "road").alias("project_type"), F.lit(None).cast("string").alias("scale"), k.alias("coordinates"))
    flags = t.supplier.filter("s_suppkey % 3 = 0").select(k.alias("project_id"), F.lit(True).alias("in_sfha"), F.lit(None).cast("int").alias("species_count"), F.lit(4).alias("wetland_count"), F.lit(None).cast("boolean").alias("is_prime"))
    return M.query_text(projects, flags)


@query("""SELECT item_id AS query_id, 'q' || item_id || chr(10) || chr(10) || '[1] b' || chr(10) || CASE WHEN length(text) > 300 THEN text[:300] || '...' ELSE text END AS prompt FROM benchmark""")
def screening_prompts(t: Tables):
    rows = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_text"), F.lit(1).alias("rank"), F.lit("b").alias("breadcrumb"), F.col("text").alias("content"))
    return M.prompts(rows.select("query_id", "query_text"), rows)


@query("""SELECT c_nationkey AS site, c_mktsegment AS property, round(avg(c_custkey % 16) FILTER (c_custkey % 3 <> 0), 2) AS mean FROM customer GROUP BY 1, 2""")
def forecast_means(t: Tables):
    rows = t.customer.groupBy(F.col("c_nationkey").alias("site"), F.col("c_mktsegment").alias("property")).agg(F.collect_list(F.struct(F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 16).cast("double")).alias("value"))).alias("values"))
    return P.forecast_means(rows)


@query(f"""WITH {SITES}, h AS (SELECT project_id, feature_id, kind FROM sites JOIN features ON lat BETWEEN slat - 0.0501 AND slat + 0.0501 AND lon BETWEEN slon - 0.0501 AND slon + 0.0501)
SELECT project_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT kind)), '|') AS kinds, array_to_string(list_sort(list(feature_id)), '|') AS ids FROM h GROUP BY project_id""")
def feature_summary(t: Tables):
    made = P.summary_in_box(sites(t), features(t), "kind", 0.0501)
    texts = made.select("project_id", F.col("count").alias("n"), F.array_join("types", "|").alias("kinds"), F.array_join("features", "|").alias("ids"))
    return P.for_sites(sites(t), P.written(texts, "summaries")).drop("site_lat", "site_lon")


@query(f"""WITH {SITES}, z AS (SELECT s_suppkey AS k, -90.0013 + (s_suppkey * 17) % 100 / 10 AS x, 35.0017 + (s_suppkey * 43) % 100 / 10 AS y FROM supplier)
SELECT project_id, z.k % 4 AS county, z.k AS tract, CASE WHEN z.k % 5 <> 0 THEN round((z.k * 10 - z.k * 3) / (z.k * 10), 4) END AS minority_share, CASE WHEN z.k % 2 = 0 AND z.k > 0 THEN 0.25 END AS poverty_share FROM sites JOIN z ON slon > x AND slon < x + 0.5 AND slat > y AND slat < y + 0.5""")
def site_demographics(t: Tables):
    k = F.col("s_suppkey")
    tracts = squares(t).select(F.lit(42).alias("state"), (F.col("zone_id") % 4).alias("county"), F.col("zone_id").alias("tract"), "ring")
    acs = t.supplier.select(F.lit(42).alias("state"), (k % 4).alias("county"), k.alias("tract"), F.when(k % 5 != 0, k * 10).otherwise(0).alias("race_total"), (k * 3).alias("white_nh"), F.when(k % 2 == 0, k * 4).otherwise(0).alias("poverty_total"), k.alias("below_poverty"))
    return P.demographics(sites(t), tracts, acs).select("project_id", "county", "tract", "minority_share", "poverty_share")


@query(f"""WITH {OUTPUTS}, f AS (SELECT run_id, agent, max(input_tokens) AS i, max(output_tokens) AS o, max(duration_ms) AS d, max(cost_usd) AS c FROM outputs GROUP BY 1, 2)
SELECT run_id, round(sum(c), 2) AS total_cost_usd, sum(i)::BIGINT AS total_input_tokens, sum(o)::BIGINT AS total_output_tokens, sum(d)::BIGINT AS total_duration_ms FROM f GROUP BY run_id""")
def saved_runs(t: Tables):
    per = t.outputs().groupBy("run_id", "agent").agg(*(F.max(c).alias(c) for c in ("input_tokens", "output_tokens", "duration_ms", "cost_usd")))
    payloads = per.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("agent", F.struct("input_tokens", "output_tokens", "duration_ms", "cost_usd")))).alias("agents")).withColumn("project_id", F.lit(1)).withColumn("started_at", F.lit("2026-01-01T00:00:00Z"))
    return R.build_runs(payloads)[0].select("run_id", F.round("total_cost_usd", 2).alias("total_cost_usd"), "total_input_tokens", "total_output_tokens", "total_duration_ms")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'ready' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE 1 END AS chunks_total, CASE WHEN o_orderkey % 2 <> 0 THEN 'old' END AS status_message FROM orders""")
def applied_status(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("chunks_total"), F.lit("old").alias("status_message"))
    updates = rows.select("id", F.when(F.col("id") % 2 == 0, "ready").alias("status"), F.when(F.col("id") % 3 == 0, 9).alias("chunks_total"))
    return G.apply_status(rows, updates)


@query("SELECT event_id::VARCHAR AS correlation_id, 'started' AS status, NULL AS chunks_count, NULL AS duration_ms, ts FROM events UNION ALL SELECT event_id::VARCHAR, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'ready' END, event_id % 10, event_id % 1000, ts + INTERVAL 5 SECOND FROM events")
def audit_rows(t: Tables):
    k = F.col("event_id")
    runs = t.events.select(k.cast("string").alias("correlation_id"), F.col("ts").alias("started_at"), (F.col("ts") + F.expr("INTERVAL 5 SECONDS")).alias("finished_at"), (k % 3 != 0).alias("ok"), (k % 1000).alias("duration_ms"), (k % 10).alias("chunks_count"), F.lit(None).cast("string").alias("error_message"))
    return G.audit_pair(runs).select("correlation_id", "status", "chunks_count", "duration_ms", "ts")


#: A chunk's places in its document, beside what CHUNKS has of it.
PLACED = CHUNKS.replace("min(pos) AS first_pos FROM items", "min(pos) AS first_pos, list(pos ORDER BY rn) AS places FROM items")


@query(rf"""WITH RECURSIVE {PLACED}, c AS (SELECT *, list_sort(list_distinct(places)) AS own, floor(first_pos / 40)::INT::VARCHAR AS part FROM chunks),
m AS (SELECT *, 'Title 40 — Protection of Environment > Chapter V — Council on Environmental Quality > Part ' || part || ' > §1500.' || places[1] || CASE WHEN n_sources > 1 THEN '–1500.' || places[-1] ELSE '' END || ' — '
 || array_to_string(list_transform(places, lambda x: 'Title'), ' / ') || CASE WHEN part = '1508' THEN ' [DEFINITION]' ELSE '' END || coalesce(' ' || subsection, '') AS breadcrumb FROM c)
SELECT doc_id, chunk_no::INT AS chunk_no, part, '40 CFR §1500.' || places[1] AS citation, array_to_string(list_transform(own, lambda x: '40 CFR §1500.' || x), '|') AS all_citations, array_to_string(list_transform(own, lambda x: '1500.' || x), '|') AS all_sections,
 '1' AS page_numbers, '' AS cross_references, breadcrumb, subsection, chunk_index::INT AS chunk_index, total_chunks_in_section::INT AS total_chunks_in_section, part = '1508' AS is_definition, is_merged_siblings, token_count::INT AS token_count,
 's-' || doc_id AS source_id, doc_id || '.pdf' AS filename, sha256(doc_id) AS sha256, true AS is_current, 1 AS project_id, sha256('s-' || doc_id || chr(31) || '40 CFR §1500.' || places[1] || chr(31) || chunk_index::INT || chr(31) || coalesce(subsection, '')) AS chunk_id, md5(breadcrumb || chr(10) || chr(10) || body) AS embedding_md5 FROM m""")
def chunk_metadata(t: Tables):
    sources = t.documents.select(F.col("source").alias("doc_id")).distinct().select("doc_id", F.concat(F.lit("s-"), "doc_id").alias("id"), F.concat("doc_id", F.lit(".pdf")).alias("filename"), F.sha2("doc_id", 256).alias("sha256"), F.lit(True).alias("is_current"), F.lit(1).alias("project_id"))
    made = C.build_metadata(C.chunk_regulation(sections_of(t)), sources)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "|").alias(c)
    return made.select("doc_id", "chunk_no", "part", "citation", *map(joined, ("all_citations", "all_sections", "page_numbers", "cross_references")), "breadcrumb", "subsection", "chunk_index", "total_chunks_in_section", "is_definition", "is_merged_siblings", "token_count", "source_id", "filename", "sha256", "is_current", "project_id", "chunk_id", F.md5("embedding_text").alias("embedding_md5"))


@query()
def hashed_embeddings(t: Tables):
    return t.documents.select("doc_id", K.embedder(dim=32)(F.coalesce("text", F.lit(""))).alias("embedding"))


@query("SELECT label::VARCHAR AS source, count(*) AS n FROM embeddings GROUP BY 1")
def chunk_totals(t: Tables):
    return B.chunk_counts(chunks(t), "source")


@query("""SELECT project_id, printf('POLYGON((%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f))', x - 0.05, y - 0.05, x + 0.05, y - 0.05, x + 0.05, y + 0.05, x - 0.05, y + 0.05, x - 0.05, y - 0.05) AS wkt
FROM (SELECT c_custkey AS project_id, (35 + (c_custkey * 37) % 1000 / 100)::DOUBLE AS y, (-90 + (c_custkey * 53) % 1000 / 100)::DOUBLE AS x FROM customer)""")
def site_boxes(t: Tables):
    return sites(t).select("project_id", X.box_wkt(F.col("lat"), F.col("lon"), 0.05).alias("wkt"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN make_timestamp(2024, 1 + (o_orderkey % 12)::INT, 15, 10, (o_orderkey % 60)::INT, 0.0) END AS started_at FROM orders")
def started_at(t: Tables):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("2024-"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit("-15T10:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":00"), F.when(k % 2 == 0, "Z").otherwise(""))
    return t.orders.select(k.alias("id"), X.parse_started_at(F.when(k % 3 == 0, F.concat(F.lit("soon "), text)).otherwise(text)).cast("timestamp_ntz").alias("started_at"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'bat' WHEN s_suppkey % 3 = 1 THEN 'myotis' ELSE 'Unknown' END AS name FROM supplier")
def species_names(t: Tables):
    k = F.col("s_suppkey") % 3
    return t.supplier.select("s_suppkey", P.species_name(F.when(k == 0, "bat").when(k == 1, ""), F.when(k < 2, "myotis").otherwise("")).alias("name"))


@query("SELECT doc_id, array_to_string(string_split(coalesce(text, ''), ' ')[1:5], ' ') AS first_words FROM documents")
def capped_lists(t: Tables):
    return t.documents.select("doc_id", F.array_join(X.cap_list(F.split(F.coalesce("text", F.lit("")), " "), 5), " ").alias("first_words"))


@query("""WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey < 12 THEN s_nationkey END AS owner FROM supplier)
SELECT n_nationkey AS project_id, coalesce(array_to_string(list_sort(list(id) FILTER (id IS NOT NULL)), ','), '') AS source_ids, count(id) = 0 AS sees_all FROM nation LEFT JOIN s ON owner = n_nationkey GROUP BY n_nationkey""")
def source_scopes(t: Tables):
    sources = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") < 12, F.col("s_nationkey")).alias("project_id"), F.lit("ready").alias("status"))
    return B.source_scopes(t.nation.select(F.col("n_nationkey").alias("project_id")), sources).select("project_id", F.array_join(F.col("source_ids").cast("array<string>"), ",").alias("source_ids"), "sees_all")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(65533) || 'a' ELSE '§§1501.7 see ' || '\"quoted\" § 4332' END AS text, CASE WHEN doc_id % 3 = 0 THEN '?a' ELSE '' END AS warnings FROM documents")
def recovered_chars(t: Tables):
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit(f"{X.LOST}a")).otherwise(F.lit(f"{X.LOST * 2}1501.7 see {X.LOST}quoted{X.LOST} {X.LOST} 4332"))
    return t.documents.select("doc_id", X.recover_chars(raw).alias("text")).withColumn("warnings", F.array_join(X.lost_contexts(F.col("text")), "|"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'App' WHEN 1 THEN 'AppIII' WHEN 2 THEN 'AppB' WHEN 3 THEN 'App_some_thing' ELSE 'AppC' END AS appendix, CASE WHEN doc_id % 2 = 0 THEN 'Heading of ' || doc_id ELSE 'Heading § ' || doc_id END AS title FROM documents""")
def appendix_ids(t: Tables):
    k, number = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    raw = F.when(k == 0, "").when(k == 1, "Appendix iii to Part 800").when(k == 2, "B").when(k == 3, "some  thing").otherwise("appendix c")
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("§ "), number, F.lit(".  Heading of "), number)).otherwise(F.concat(F.lit("Heading § "), number))
    return t.documents.select("doc_id", X.appendix_id(raw).alias("appendix"), X.strip_section_prefix(head, number).alias("title"))


@query("""WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'ecfr' ELSE 'pdf' END AS source_type, o_custkey AS cfr_title, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey::VARCHAR END AS cfr_part, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS effective_date, o_orderkey AS u FROM orders)
SELECT id, source_type, cfr_title, cfr_part, effective_date, CASE WHEN id % 4 = 0 THEN 'new' ELSE 'old' END AS filename, CASE WHEN id % 4 = 0 THEN 'pending' ELSE 'ready' END AS status, CASE WHEN id % 4 <> 0 THEN 7 END AS chunks_total FROM t WHERE cfr_part IS NOT NULL OR effective_date IS NOT NULL""")
def upserted_sources(t: Tables):
    k = F.col("o_orderkey")
    rows = t.orders.select(k.alias("id"), F.when(k % 2 == 0, "ecfr").otherwise("pdf").alias("source_type"), F.col("o_custkey").alias("cfr_title"), F.when(k % 3 != 0, k.cast("string")).alias("cfr_part"), F.when(k % 5 != 0, k).alias("effective_date"), F.lit("old").alias("filename"), F.lit("ready").alias("status"), F.lit(7).alias("chunks_total")).filter("cfr_part IS NOT NULL OR effective_date IS NOT NULL")
    again = rows.filter("id % 4 = 0").select((F.col("id") + 10_000_000).alias("id"), *G.SOURCE_KEY, F.lit("new").alias("filename"))
    return G.upsert_sources(rows, again)


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'set' WHEN vec_id % 2 = 0 THEN '00000000-0000-4000-8000-' || lpad(vec_id::VARCHAR, 12, '0') END AS source_id FROM embeddings""")
def backfilled_sources(t: Tables):
    k = F.col("vec_id")
    shaped = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(k.cast("string"), 12, "0"))
    rows = t.embeddings.select(k.alias("id"), F.when(k % 3 == 0, "set").alias("source_id"), F.when(k % 2 == 0, shaped).otherwise("file.pdf").alias("metadata_source"))
    return G.backfill_source_id(rows).select("id", "source_id")


@query("SELECT conv_id * 1000 + turn AS evaluation_id, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'new' ELSE role END AS categories FROM conversations UNION ALL SELECT -1 - (conv_id * 1000 + turn), 'new' FROM conversations WHERE (conv_id + turn) % 8 = 0")
def upserted_truths(t: Tables):
    key = F.col("conv_id") * 1000 + F.col("turn")
    rows = t.conversations.select(key.alias("evaluation_id"), F.col("role").alias("categories"))
    sum_ = F.col("conv_id") + F.col("turn")
    new = lambda when, key: t.conversations.filter(when).select(key.alias("evaluation_id"), F.lit("new").alias("categories"))
    return G.upsert_ground_truth(rows, new(sum_ % 4 == 0, key).unionByName(new(sum_ % 8 == 0, -1 - key)))
