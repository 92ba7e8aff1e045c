"""Queries on vectors, listings and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenmill.operators import browse as B
from screenmill.operators import knn as K
from screenmill.operators import merge as G
from screenmill.operators import nearest as N
from screenmill.plans.registry import SQL, Tables, query
from screenmill.sources.buckets import BucketTable
from screenmill.sources.io import work_folder


def vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def asked(t: Tables):
    return t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


KNN = """s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS ql, c.label AS cl, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim
 FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings c)"""


@query(f"""WITH {KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s)
SELECT query_id, rank, chunk_id, round(sim, 5) AS similarity FROM r WHERE rank <= 8""")
def nearest_chunks(t: Tables):
    return K.knn(asked(t), vectors(t), 8).withColumn("similarity", F.round("similarity", 5))


@query(f"""WITH {KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s WHERE ql = cl)
SELECT query_id, rank, chunk_id, round(sim, 5) AS similarity FROM r WHERE rank <= 5""")
def nearest_chunks_in_scope(t: Tables):
    return K.knn(asked(t), vectors(t), 5, scope="label").withColumn("similarity", F.round("similarity", 5))


@query(SQL["nearest_chunks"])
def nearest_chunks_by_index(t: Tables):
    """The same through a written index, with shells small enough for these tables to have several."""
    index = N.build_index(vectors(t), work_folder(t.spark, "nearest"), shell_rows=256)
    return index.search(asked(t), 8).withColumn("similarity", F.round("similarity", 5))


@query(SQL["nearest_chunks_in_scope"])
def nearest_in_scope_by_index(t: Tables):
    index = N.build_index(vectors(t), work_folder(t.spark, "nearest"), scope="label", shell_rows=64)
    return index.search(asked(t), 5, scope="label").withColumn("similarity", F.round("similarity", 5))


@query(f"""WITH {KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s)
SELECT query_id, round(min(sim), 4) AS min_similarity, round(max(sim), 4) AS max_similarity, round(avg(sim), 4) AS mean_similarity, count(*) AS n_hits FROM r WHERE rank <= 8 GROUP BY query_id""")
def hit_statistics(t: Tables):
    s = K.hit_stats(K.knn(asked(t), vectors(t), 8))
    return s.select("query_id", *(F.round(c, 4).alias(c) for c in ("min_similarity", "max_similarity", "mean_similarity")), "n_hits")


def chunks(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("source"), (F.col("vec_id") % 3 != 0).alias("is_current"), (F.col("label") % 4).cast("string").alias("part"))


@query("""WITH c AS (SELECT label::VARCHAR AS source, vec_id % 3 <> 0 AS is_current, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT source, is_current, n, (SELECT sum(n) FROM c)::BIGINT AS total FROM c""")
def corpus_composition(t: Tables):
    return B.corpus_stats(chunks(t))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0 AND label % 4 = 1")
def filtered_chunks(t: Tables):
    return B.filtered(chunks(t), {"is_current": True, "part": "1", "statute": None}).select("id")


@query("""WITH s AS (SELECT s_suppkey AS source_id, CASE WHEN s_nationkey < 12 THEN s_nationkey END AS owner FROM supplier), p AS (SELECT n_nationkey AS project_id FROM nation),
own AS (SELECT project_id, source_id FROM p JOIN s ON owner = project_id) SELECT * FROM own UNION ALL SELECT p.project_id, source_id FROM p, s WHERE p.project_id NOT IN (SELECT project_id FROM own)""")
def scoped_sources(t: Tables):
    """Suppliers are sources, assigned to the first nations; the other nations' projects see all of them."""
    sources = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") < 12, F.col("s_nationkey")).alias("project_id"), F.lit("ready").alias("status"))
    return B.scoped_sources(t.nation.select(F.col("n_nationkey").alias("project_id")), sources)


@query("SELECT vec_id AS id, label FROM embeddings ORDER BY label, vec_id LIMIT 25 OFFSET 50")
def third_page(t: Tables):
    return B.page_of(t.embeddings.select(F.col("vec_id").alias("id"), "label"), ["label", "id"], 3, 25)


@query("SELECT count(*) AS total, 200 AS per_page, ceil(count(*) / 200.0)::BIGINT AS total_pages FROM documents")
def page_numbers(t: Tables):
    return B.page_info(t.documents, 1000)


@query("""SELECT 'documents' AS table_name, count(*) AS row_count, 5 AS column_count FROM documents UNION ALL SELECT 'orders', count(*), 6 FROM orders UNION ALL SELECT 'embeddings', count(*), 3 FROM embeddings""")
def table_statistics(t: Tables):
    return B.table_stats({n: getattr(t, n) for n in ("documents", "orders", "embeddings")})


@query("SELECT max(coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END, ''), '1990-01-01')) AS current_date FROM orders")
def latest_version(t: Tables):
    return B.latest_version(t.orders.select(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("amendment_date"), F.lit("1990-01-01").alias("date")))


def stored(t: Tables):
    """Lines as stored chunks with a key whose part is null for some, and an id."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("citation"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("chunk_index")).agg(F.max("l_partkey").alias("id"), F.max("l_suppkey").alias("body"))


STORED = """target AS (SELECT l_orderkey AS citation, CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END AS chunk_index, max(l_partkey) AS id, max(l_suppkey) AS body FROM lineitem GROUP BY 1, 2),
updates AS (SELECT citation, chunk_index, id + 1000000 AS id, body + 5 AS body FROM target WHERE citation % 4 = 0 UNION ALL SELECT citation + 10000000, chunk_index, id, body FROM target WHERE citation % 8 = 0)"""


def changes(t: Tables):
    s = stored(t)
    return s.filter("citation % 4 = 0").select("citation", "chunk_index", (F.col("id") + 1000000).alias("id"), (F.col("body") + 5).alias("body")).unionByName(s.filter("citation % 8 = 0").withColumn("citation", F.col("citation") + 10000000))


@query(f"""WITH {STORED} SELECT coalesce(t.citation, u.citation) AS citation, CASE WHEN t.citation IS NULL THEN u.chunk_index ELSE t.chunk_index END AS chunk_index, coalesce(t.id, u.id) AS id, coalesce(u.body, t.body) AS body
FROM target t FULL JOIN updates u ON t.citation = u.citation AND t.chunk_index IS NOT DISTINCT FROM u.chunk_index""")
def upserted_chunks(t: Tables):
    return G.upsert(stored(t), changes(t), ["citation", "chunk_index"], keep=["id"])


@query(f"""WITH {STORED} SELECT citation, chunk_index, id, body FROM target ANTI JOIN (SELECT DISTINCT citation FROM updates) u USING (citation) UNION ALL SELECT citation, chunk_index, id, body FROM updates""")
def replaced_partitions(t: Tables):
    return G.replace_partitions(stored(t), changes(t), "citation")


@query(SQL["upserted_chunks"])
def upserted_in_buckets(t: Tables):
    """The same on a stored table: the changes are written as a delta, and the touched buckets compacted."""
    table = BucketTable.create(stored(t), work_folder(t.spark, "buckets"), ["citation", "chunk_index"], buckets=16, keep=("id",))
    table.write(changes(t))
    table.compact()
    return table.read()


@query(SQL["replaced_partitions"])
def replaced_in_buckets(t: Tables):
    """The same on a stored table whose groups are replaced, read without compaction."""
    table = BucketTable.create(stored(t), work_folder(t.spark, "buckets"), ["citation"], buckets=16, keyed=False)
    table.write(changes(t))
    return table.read()


@query("""WITH s AS (SELECT sha256(coalesce(text, '')) AS sha256, doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN source END AS project_id, doc_id % 3 = 0 AS new FROM documents),
f AS (SELECT sha256, arg_min(id, (new, id)) AS id, arg_min(coalesce(project_id, '-'), (new, id)) AS p, arg_max(project_id, id) FILTER (new AND project_id IS NOT NULL) AS moved FROM s GROUP BY sha256)
SELECT sha256, id, coalesce(moved, nullif(p, '-')) AS project_id FROM f""")
def inserted_or_got(t: Tables):
    rows = t.documents.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("project_id"))
    return G.insert_or_get(rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0"), "sha256", ["id"], moves=["project_id"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_deleted(t: Tables):
    gone = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return G.cascade_delete(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), gone, "l_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS o_custkey FROM orders")
def project_set_null(t: Tables):
    gone = t.customer.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return G.set_null(t.orders.select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus IN ('F', 'O') THEN 'pending' ELSE o_orderstatus END AS status,
CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus IN ('F', 'O') THEN 0 ELSE o_custkey END AS chunks_total, o_orderkey % 3 = 0 AND o_orderstatus IN ('F', 'O') AS transitioned FROM orders""")
def guarded_transition(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("chunks_total"))
    return G.transition(rows, rows.filter("id % 3 = 0"), ["F", "O"], "pending", {"chunks_total": 0}).withColumn("chunks_total", F.col("chunks_total").cast("long"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN 'interrupted' END AS status_message FROM orders""")
def swept_rows(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("status_message"))
    return G.sweep_stuck(rows, stuck=("P",))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 77 ELSE o_custkey END AS project_id, o_orderkey % 2 = 0 AS matched FROM orders""")
def assigned_sources(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"))
    return G.assign(rows, rows.filter("id % 2 = 0"), 77).withColumn("project_id", F.col("project_id").cast("long"))


@query("""SELECT user_id AS correlation_id, max(ts) AS ts, arg_max(event_type, (ts, event_type)) AS status, max(event_id % 1000) AS duration_ms, max(event_id % 10) AS chunks_count FROM events GROUP BY user_id""")
def audit_outcomes(t: Tables):
    log = t.events.select(F.col("user_id").alias("correlation_id"), "ts", F.col("event_type").alias("status"), (F.col("event_id") % 1000).alias("duration_ms"), (F.col("event_id") % 10).alias("chunks_count"), F.lit(None).cast("string").alias("error_message"))
    return G.audit_outcomes(log).drop("error_message")


@query("SELECT vec_id AS id, vec_id % 7 <> 0 AS dimension_ok FROM embeddings")
def checked_dimensions(t: Tables):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("embedding"))
    return G.check_dimension(rows, 64).select("id", "dimension_ok")


@query("""WITH s AS (SELECT doc_id, count(*) AS n FROM documents, range(3) r(k) WHERE doc_id % 4 <> 0 GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 3 END::BIGINT AS sections_count, CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 THEN 0 ELSE 3 END::BIGINT AS chunks_count,
CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'no sections found' WHEN doc_id % 5 = 0 THEN 'no chunks produced' END AS status_message FROM documents""")
def ingest_status(t: Tables):
    docs = t.documents.select("doc_id")
    sections = docs.filter("doc_id % 4 <> 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    return G.ingest_status(docs, sections, sections.filter("doc_id % 5 <> 0"))
