"""Queries on texts: sections, chunks, citations, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenmill.functions import text as X
from screenmill.operators import chunking as C
from screenmill.operators import merge as G
from screenmill.operators import sections as S
from screenmill.plans.registry import Tables, query
from screenmill.sources.buckets import BucketTable
from screenmill.sources.io import intake_files, work_folder
from screenmill.sources.xml_sections import parse_regulation_xml
from screenmill.streaming.events import ingest


def cited(t: Tables):
    """Texts with citations made of the documents' keys; every document is a section of a part of 50."""
    d = F.col("doc_id")
    body = F.concat(F.lit("See §"), (1500 + d % 9).cast("string"), F.lit("."), (d % 40).cast("string"), F.lit("(b) and §§"), (1500 + d % 7).cast("string"), F.lit("."), (d % 11).cast("string"), F.lit(", 42 U.S.C. §"), (4300 + d % 90).cast("string"), F.lit(", section "), (d % 300).cast("string"), F.lit("(2)(C); 25 Pa. Code § "), (100 + d % 20).cast("string"), F.lit("."), (d % 30).cast("string"), F.lit("(a), 32 P.S. § 693."), (d % 9).cast("string"), F.lit(" ok "), F.coalesce("text", F.lit("")))
    own = F.concat(F.lit("40 CFR §"), (1500 + d % 9).cast("string"), F.lit("."), (d % 41).cast("string"))
    return t.documents.select("doc_id", body.alias("body"), own.alias("citation"))


REFS = """r AS (SELECT doc_id, '40 CFR §' || (1500 + doc_id % 9) || '.' || (doc_id % 41) AS own, ['40 CFR §' || (1500 + doc_id % 9) || '.' || (doc_id % 40), '40 CFR §' || (1500 + doc_id % 7) || '.' || (doc_id % 11),
 '42 USC §' || (4300 + doc_id % 90), 'NEPA §' || (doc_id % 300), '25 Pa. Code § ' || (100 + doc_id % 20) || '.' || (doc_id % 30), '32 P.S. § 693.' || (doc_id % 9), '25 Pa. Code § 693.' || (doc_id % 9)] AS refs FROM documents)"""


@query(f"WITH {REFS}, u AS (SELECT doc_id, own, unnest(refs) AS ref FROM r) SELECT DISTINCT doc_id, ref FROM u WHERE ref <> own")
def cross_references(t: Tables):
    return cited(t).select("doc_id", F.explode_outer(X.cross_references(F.col("body"), F.col("citation"))).alias("ref")).filter("ref IS NOT NULL")


@query(f"""WITH {REFS}, u AS (SELECT DISTINCT own AS src, unnest(refs) AS dst FROM r), k AS (SELECT DISTINCT own FROM r)
SELECT src, dst, k.own IS NOT NULL AS resolved FROM u LEFT JOIN k ON dst = k.own WHERE src <> dst""")
def resolved_references(t: Tables):
    return S.resolve_references(cited(t))


@query(f"""WITH {REFS}, u AS (SELECT DISTINCT own AS src, unnest(refs) AS dst FROM r), p AS (SELECT * FROM u WHERE src <> dst), k AS (SELECT DISTINCT own AS citation FROM r)
SELECT citation, coalesce(a, 0) AS cites, coalesce(b, 0) AS cited_by FROM k LEFT JOIN (SELECT src, count(*) AS a FROM p GROUP BY 1) x ON x.src = citation LEFT JOIN (SELECT dst, count(*) AS b FROM p GROUP BY 1) y ON y.dst = citation""")
def citation_degrees(t: Tables):
    return S.citation_degrees(S.resolve_references(cited(t)), cited(t))


@query(f"""WITH RECURSIVE {REFS}, u AS (SELECT DISTINCT own AS src, unnest(refs) AS dst FROM r), p AS (SELECT * FROM u WHERE src <> dst), q AS (SELECT DISTINCT own AS start FROM r WHERE doc_id % 50 = 0),
c AS (SELECT start, dst AS citation FROM q JOIN p ON src = start UNION SELECT start, dst FROM c JOIN p ON src = citation) SELECT start, citation FROM c""")
def reachable_citations(t: Tables):
    """From the sections of every fiftieth document over the citations of all."""
    return S.reachable(S.resolve_references(cited(t)), cited(t).filter("doc_id % 50 = 0")).select("start", "citation")


@query(r"""SELECT p_partkey, trim(array_to_string(list_filter(string_split_regex(regexp_replace(lower(p_type || ' Resources & the ' || p_brand), '[^a-z0-9 ]', ' ', 'g'), ' +'),
 lambda w: w NOT IN ('', 'and', 'or', 'the', 'of', 'a', 'an', 'impact', 'impacts', 'resource', 'resources', 'environmental', 'section', 'assessment')), ' ')) AS norm FROM part""")
def normalized_categories(t: Tables):
    return t.part.select("p_partkey", X.normalize_category(F.concat("p_type", F.lit(" Resources & the "), "p_brand")).alias("norm"))


def state_pages(t: Tables):
    """Every document as a page of the state code: an opening section, a subchapter with its text as a section, a source note and a reserved section."""
    d = F.col("doc_id")
    text = F.concat(F.lit("CHAPTER 105. DAMS\n105.1. Contents\n§ 105.99. Opening.\nfirst words\nSubchapter B. DAMS\nGENERAL PROVISIONS\n§ 105."), (d % 50).cast("string"), F.lit(". Heading of it.\n4/12/26, 11:28 AM\n"), F.coalesce("text", F.lit("")), F.lit("\n  12/140 \nSource\nThe provisions, effective January "), (1 + d % 28).cast("string"), F.lit(", 1979.\n§ 105.72. [Reserved].\nlost\n"))
    return t.documents.select("doc_id", F.lit(1).alias("page"), text.alias("text"))


@query("""WITH b AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS body FROM documents)
SELECT doc_id, '105.' || (doc_id % 50) AS section, 'Heading of it' AS title, md5(body) AS body_md5, '25 Pa. Code § 105.' || (doc_id % 50) AS citation, 'B' AS part,
 'January ' || (1 + doc_id % 28) || ', 1979' AS effective_date FROM b WHERE body <> ''
UNION ALL SELECT doc_id, '105.99', 'Opening', md5('first words'), '25 Pa. Code § 105.99', NULL, NULL FROM documents""")
def state_sections(t: Tables):
    found = S.assemble_state_sections(state_pages(t))
    return found.select("doc_id", "section", "title", F.md5("body").alias("body_md5"), "citation", "part", "effective_date")


def report_blocks(t: Tables):
    """Documents as reports: a chapter, headings 1.1 and 1.2 in bold, and the lines in between in their own sizes."""
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line")).filter("trim(line) <> ''")
    body = lines.select("doc_id", F.lit(1).alias("page"), (F.col("n") * 2 + 10).alias("block_no"), F.col("line").alias("text"), (F.lit(10.0) + F.length("line") % 3).alias("max_size"), (F.length("line") % 11 == 0).alias("is_bold"))
    head = lambda no, text: t.documents.select("doc_id", F.lit(1).alias("page"), F.lit(no).alias("block_no"), F.lit(text).alias("text"), F.lit(14.0).alias("max_size"), F.lit(True).alias("is_bold"))
    return body.unionByName(head(1, "Chapter 4: Resources")).unionByName(head(9, "4.1 Water")).unionByName(head(13, "4.1.2 Groundwater"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
c AS (SELECT doc_id, 10.0 + length(line) % 3 AS size, count(*) AS n, min(n) AS p0 FROM l WHERE trim(line) <> '' AND length(line) % 11 <> 0 GROUP BY 1, 2)
SELECT documents.doc_id, coalesce(s, 11.0)::DOUBLE AS body_size FROM documents LEFT JOIN (SELECT doc_id, arg_min(size, (-n, p0)) AS s FROM c GROUP BY doc_id) b ON b.doc_id = documents.doc_id""")
def report_body_sizes(t: Tables):
    return S.body_sizes(report_blocks(t))


#: Sections between headings; an ancestor of a heading is one before it that no later one of its depth or less replaces.
REPORTS = r"""l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
b AS (SELECT doc_id, n * 2 + 10 AS bno, line AS text, 10.0 + length(line) % 3 AS size, length(line) % 11 = 0 AS bold FROM l WHERE trim(line, ' ') <> ''
 UNION ALL SELECT doc_id, unnest([1, 9, 13]), unnest(['Chapter 4: Resources', '4.1 Water', '4.1.2 Groundwater']), 14.0, true FROM documents),
plain AS (SELECT doc_id, size, count(*) AS n, min(bno) AS p0 FROM b WHERE NOT bold GROUP BY 1, 2),
c AS (SELECT b.*, trim(text) AS s, coalesce(body, 11.0) AS body FROM b LEFT JOIN (SELECT doc_id, arg_min(size, (-n, p0)) AS body FROM plain GROUP BY doc_id) USING (doc_id)),
k AS (SELECT *, CASE WHEN regexp_matches(s, '(?i)^Chapter\s+\d+\s*[:\-]?\s*.+?$') THEN 'chapter' WHEN (size > body * 1.15 OR bold) AND regexp_matches(s, '^\d+(\.\d+){0,3}\s+\S.*$') THEN 'section' END AS kind FROM c),
h AS (SELECT doc_id, bno, kind, CASE WHEN kind = 'chapter' THEN regexp_extract(s, '(?i)^Chapter\s+(\d+)', 1) ELSE regexp_extract(s, '^(\d+(?:\.\d+){0,3})\s', 1) END AS number,
 trim(CASE WHEN kind = 'chapter' THEN regexp_extract(s, '(?i)^Chapter\s+\d+\s*[:\-]?\s*(.+?)$', 1) ELSE regexp_extract(s, '^\d+(?:\.\d+){0,3}\s+(\S.*)$', 1) END) AS title FROM k WHERE kind IS NOT NULL),
d AS (SELECT *, CASE WHEN kind = 'chapter' THEN -1 ELSE len(string_split(number, '.')) - 1 END AS depth, CASE WHEN kind = 'chapter' THEN 'Chapter ' || number || ': ' || title ELSE number || ' ' || title END AS label, row_number() OVER (PARTITION BY doc_id ORDER BY bno) AS no FROM h),
path AS (SELECT x.doc_id, x.no, string_agg(y.label, ' > ' ORDER BY y.depth) AS breadcrumb FROM d x JOIN d y ON y.doc_id = x.doc_id AND y.no <= x.no
 AND NOT EXISTS (SELECT 1 FROM d z WHERE z.doc_id = x.doc_id AND z.no > y.no AND z.no <= x.no AND z.depth <= y.depth) GROUP BY 1, 2),
o AS (SELECT k.doc_id, (SELECT max(no) FROM d WHERE d.doc_id = k.doc_id AND d.bno < k.bno) AS no, bno, text FROM k WHERE kind IS NULL),
t AS (SELECT doc_id, no, trim(string_agg(text, chr(10) ORDER BY bno), ' ' || chr(9) || chr(10) || chr(13)) AS body, bool_or(regexp_matches(text, '(?m)^\s*\|.*\|\s*$')) AS has_table_hint FROM o WHERE no IS NOT NULL GROUP BY 1, 2),
made AS (SELECT doc_id, no::INT AS pos, string_split(number, '.')[1] AS chapter, CASE WHEN kind = 'section' THEN number END AS section_number, CASE WHEN kind = 'chapter' THEN label ELSE title END AS section_title, breadcrumb, body, 1 AS page_start, 1 AS page_end, has_table_hint FROM t JOIN d USING (doc_id, no) JOIN path USING (doc_id, no))"""


@query(f"WITH {REPORTS} SELECT * FROM made")
def report_sections(t: Tables):
    return S.assemble_report_sections(report_blocks(t))


@query(r"""WITH t AS (SELECT page_id, html FROM pages) SELECT page_id, length(x) AS n, md5(x) AS text_md5 FROM (SELECT page_id,
regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<b\b[^>]*>', chr(1), 'g'), '(?i)</b>', chr(2), 'g'), '(?i)</p>|<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'),
'&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&sect;', '§'), '&mdash;', '—'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \t]+', ' ', 'g') AS x FROM t)""")
def page_marked_text(t: Tables):
    x = X.marked_text(F.col("html"))
    return t.pages.select("page_id", x.alias("x")).select("page_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("text_md5"))


@query()
def federal_sections(t: Tables):
    """Pages as the federal print: a part and a section in bold before each page's HTML."""
    head = F.concat(F.lit("<b>PART "), (1500 + F.col("page_id") % 9).cast("string"), F.lit("—NEPA AND PLANNING</b><b>§"), (1500 + F.col("page_id") % 9).cast("string"), F.lit(".3 When to prepare.</b>"), F.coalesce("html", F.lit("")))
    return S.assemble_federal_sections(t.pages.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), head.alias("html")))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 51, 0) + 1, 462)) AS p0 FROM w WHERE len(w) > 0)
SELECT doc_id, (p0 / 462)::BIGINT AS chunk_index, md5(array_to_string(w[p0 + 1 : p0 + 512], ' ')) AS content_md5 FROM s""")
def generic_chunks(t: Tables):
    return C.chunk_generic(t.documents).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"))


def sections_of(t: Tables):
    """Documents as sections of a part for each source, with a label every 300 words."""
    letters = F.array(*map(F.lit, "abcdefghijklmnopqrstuvwxyz"))
    mark = lambda k: F.concat(F.lit("("), F.element_at(letters, ((k / 300).cast("int") % 26) + 1), F.lit(") "))
    marked = lambda words: F.when(F.size(words) > 900, F.transform(words, lambda w, k: F.when(k % 300 == 0, F.concat(mark(k), w)).otherwise(w))).otherwise(words)
    labelled = F.array_join(X.let(X.tokens(F.coalesce("text", F.lit(""))), marked), " ")
    null = F.lit(None).cast("string")
    return t.documents.select(
        F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("pos"), F.lit("cfr_regulation").alias("document_type"), F.concat(F.lit("1500."), F.col("doc_id").cast("string")).alias("section"), F.lit("Title").alias("title"), labelled.alias("body"),
        F.concat(F.lit("40 CFR §1500."), F.col("doc_id").cast("string")).alias("citation"), F.array(F.lit(1)).alias("pages"), (F.col("doc_id") / 40).cast("int").cast("string").alias("part"), null.alias("part_title"), null.alias("parent_statute"), null.alias("statute_title"), null.alias("effective_date"),
    )


#: Chunks by two passes in recursive queries: paragraphs fill bins, then small neighbours go forward, then what is left goes back.
CHUNKS = r"""w0 AS (SELECT source AS doc_id, doc_id AS pos, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
w1 AS (SELECT doc_id, pos, list_filter(string_split_regex(array_to_string(CASE WHEN len(w) > 900 THEN list_transform(w, lambda x, k: CASE WHEN (k - 1) % 300 = 0 THEN '(' || chr((97 + ((k - 1) // 300) % 26)::INT) || ') ' || x ELSE x END) ELSE w END, ' '), '\s+'), lambda x: x <> '') AS w FROM w0),
parted AS (SELECT doc_id, pos, floor(pos / 40)::INT::VARCHAR AS part, w, len(w) AS n FROM w1),
toks AS (SELECT doc_id, pos, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM parted WHERE n > 1500 AND part <> '1508'),
para0 AS (SELECT doc_id, pos, i, x, sum(CASE WHEN i = 1 OR regexp_matches(x, '^\([a-z]\)$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pos ORDER BY i) AS p FROM toks),
para AS (SELECT doc_id, pos, p, list(x ORDER BY i) AS w, count(*) AS n FROM para0 GROUP BY 1, 2, 3),
pack AS (SELECT doc_id, pos, p, n AS filled, 0 AS bin FROM para WHERE p = 1
 UNION ALL SELECT q.doc_id, q.pos, q.p, CASE WHEN k.filled + q.n > 700 THEN q.n ELSE k.filled + q.n END, CASE WHEN k.filled + q.n > 700 THEN k.bin + 1 ELSE k.bin END FROM pack k JOIN para q ON q.doc_id = k.doc_id AND q.pos = k.pos AND q.p = k.p + 1),
bins AS (SELECT doc_id, pos, bin, flatten(list(w ORDER BY p)) AS w, list_filter(list(CASE WHEN regexp_matches(w[1], '^\([a-z]\)$') THEN w[1] END ORDER BY p), lambda x: x IS NOT NULL) AS labels FROM pack JOIN para USING (doc_id, pos, p) GROUP BY 1, 2, 3),
pieces AS (SELECT doc_id, pos, bin::INT AS index, count(*) OVER (PARTITION BY doc_id, pos) AS total, coalesce(lag(w[-90:]) OVER (PARTITION BY doc_id, pos ORDER BY bin), []) || w AS w, CASE WHEN len(labels) = 1 THEN labels[1] WHEN len(labels) > 1 THEN labels[1] || '-' || labels[-1] END AS subsection FROM bins
 UNION ALL SELECT doc_id, pos, 0, 1, w, NULL FROM parted WHERE n <= 1500 OR part = '1508'),
items AS (SELECT doc_id, pos, index, total, w, subsection, len(w) AS n, total = 1 AS solo, CASE WHEN floor(pos / 40) <> 1508 THEN floor(pos / 40)::INT END AS k, row_number() OVER (PARTITION BY doc_id ORDER BY pos, index) AS rn FROM pieces),
fwd AS (SELECT doc_id, rn, rn AS g, n AS gn, solo AND n < 200 AS grows, k FROM items WHERE rn = 1
 UNION ALL SELECT i.doc_id, i.rn, CASE WHEN t THEN f.g ELSE i.rn END, CASE WHEN t THEN f.gn + i.n ELSE i.n END, CASE WHEN t THEN f.grows ELSE i.solo AND i.n < 200 END, i.k
 FROM (SELECT f.*, i.rn AS nrn, coalesce(f.grows AND i.solo AND i.k = f.k AND f.gn + i.n <= 1500 AND (f.gn < 200 OR i.n < 200), false) AS t FROM fwd f JOIN items i ON i.doc_id = f.doc_id AND i.rn = f.rn + 1) f JOIN items i ON i.doc_id = f.doc_id AND i.rn = f.nrn),
units AS (SELECT doc_id, g, sum(n) AS n, count(*) AS c, any_value(k) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS un FROM (SELECT doc_id, rn, g, i.n, i.k FROM fwd JOIN items i USING (doc_id, rn)) GROUP BY doc_id, g),
bwd AS (SELECT doc_id, un, un AS h, n AS hn, k FROM units WHERE un = 1
 UNION ALL SELECT u.doc_id, u.un, CASE WHEN u.c = 1 AND u.n < 200 AND u.k = b.k AND b.hn + u.n <= 1500 THEN b.h ELSE u.un END, CASE WHEN u.c = 1 AND u.n < 200 AND u.k = b.k AND b.hn + u.n <= 1500 THEN b.hn + u.n ELSE u.n END, u.k FROM bwd b JOIN units u ON u.doc_id = b.doc_id AND u.un = b.un + 1),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(rn)) - 1 AS chunk_no, count(*) AS n_sources, CASE WHEN count(*) = 1 THEN any_value(subsection) END AS subsection, CASE WHEN count(*) = 1 THEN any_value(index) ELSE 0 END AS chunk_index, CASE WHEN count(*) = 1 THEN any_value(total) ELSE 1 END AS total_chunks_in_section,
 count(*) > 1 AS is_merged_siblings, sum(items.n) AS token_count, trim(array_to_string(flatten(list(w ORDER BY rn)), ' ')) AS body, min(pos) AS first_pos FROM items JOIN fwd USING (doc_id, rn) JOIN units USING (doc_id, g) JOIN bwd USING (doc_id, un) GROUP BY doc_id, h)"""


@query(f"""WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_no::INT AS chunk_no, n_sources::INT AS n_sources, subsection, chunk_index::INT AS chunk_index, total_chunks_in_section::INT AS total_chunks_in_section, is_merged_siblings, token_count::INT AS token_count, md5(body) AS body_md5 FROM chunks""")
def regulation_chunks(t: Tables):
    return C.chunk_regulation(sections_of(t)).select("doc_id", "chunk_no", F.size("sources").alias("n_sources"), "subsection", "chunk_index", "total_chunks_in_section", "is_merged_siblings", "token_count", F.md5("body").alias("body_md5"))


QUANTILES = """r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY token_count) AS k, count(*) OVER (PARTITION BY key) AS c FROM keyed),
j AS (SELECT *, least(greatest(19 * (c + 1) // 20, 1), c - 1) AS j FROM r), d AS (SELECT *, 19 * (c + 1) - 20 * j AS d FROM j)
SELECT key AS {key}, count(*) AS n, count(*) FILTER (total_chunks_in_section > 1) AS n_split, count(*) FILTER (is_merged_siblings) AS n_merged, 0::BIGINT AS n_definitions, min(token_count)::INT AS min_tokens, max(token_count)::INT AS max_tokens, sum(token_count)::DOUBLE / count(*) AS mean_tokens,
 (max(token_count) FILTER (k = (c + 1) // 2) + max(token_count) FILTER (k = c // 2 + 1)) / 2.0 AS median_tokens,
 CASE WHEN max(c) < 20 THEN max(token_count) ELSE floor((max(token_count) FILTER (k = j) * (20 - max(d)) + max(token_count) FILTER (k = j + 1) * max(d)) / 20.0) END::INT AS p95_tokens FROM d GROUP BY key"""


@query(f"WITH RECURSIVE {CHUNKS}, keyed AS (SELECT *, floor(first_pos / 40)::INT::VARCHAR AS key FROM chunks), {QUANTILES.format(key='part')}")
def regulation_chunks_by_part(t: Tables):
    return C.chunk_summary(C.chunk_regulation(sections_of(t)), "part")


@query(f"""WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_no::INT AS chunk_no, token_count::INT AS token_count, CASE WHEN token_count > 1500 THEN 'oversize' ELSE 'runt' END AS problem FROM chunks
WHERE token_count > 1500 OR (token_count < 300 AND floor(first_pos / 40) <> 1508)""")
def runt_report(t: Tables):
    return C.runts(C.chunk_regulation(sections_of(t)), 300).select("doc_id", "chunk_no", "token_count", "problem")


@query(f"WITH RECURSIVE {CHUNKS}, keyed AS (SELECT *, 'cfr_regulation' AS key FROM chunks), {QUANTILES.format(key='document_type')}")
def regulation_chunk_summary(t: Tables):
    return C.chunk_summary(C.chunk_regulation(sections_of(t)))


@query(r"""WITH n AS (SELECT source, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM documents),
r AS (SELECT source, n, row_number() OVER (PARTITION BY source ORDER BY n) AS k, count(*) OVER (PARTITION BY source) AS c FROM n),
j AS (SELECT *, least(greatest(19 * (c + 1) // 20, 1), c - 1) AS j FROM r),
d AS (SELECT *, 19 * (c + 1) - 20 * j AS d FROM j)
SELECT source, (max(n) FILTER (k = (c + 1) // 2) + max(n) FILTER (k = c // 2 + 1)) / 2.0 AS median_tokens,
 CASE WHEN max(c) < 20 THEN max(n) ELSE floor((max(n) FILTER (k = j) * (20 - max(d)) + max(n) FILTER (k = j + 1) * max(d)) / 20.0) END::INT AS p95_tokens FROM d GROUP BY source""")
def token_quantiles(t: Tables):
    return C.exclusive_p95(t.documents.select("source", X.token_count(F.coalesce("text", F.lit(""))).alias("n")), "source", "n")


@query(rf"""WITH {REPORTS}, w AS (SELECT doc_id, pos, body, list_filter(string_split_regex(body, '\s+'), lambda x: x <> '') AS w FROM made),
s AS (SELECT doc_id, pos, w, unnest(range(0, greatest(len(w) - 21, 0) + 1, 120)) AS p0 FROM w WHERE len(w) > 300),
x AS (SELECT doc_id, pos, p0 // 120 AS i, w[p0 + 1 : p0 + 140] AS w, array_to_string(w[p0 + 1 : p0 + 140], ' ') AS content FROM s UNION ALL SELECT doc_id, pos, 0, w, body FROM w WHERE len(w) <= 300)
SELECT doc_id, pos, i::INT AS chunk_index, count(*) OVER (PARTITION BY doc_id, pos)::INT AS total_chunks_in_section, len(w)::INT AS token_count, md5(content) AS content_md5 FROM x""")
def report_chunks(t: Tables):
    sections = S.assemble_report_sections(report_blocks(t))
    return C.chunk_report(sections, most=300, target=140, overlap=20).select("doc_id", "pos", "chunk_index", "total_chunks_in_section", "token_count", F.md5("content").alias("content_md5"))


@query("""SELECT doc_id, 'file-' || source || ' §' || CASE WHEN doc_id % 3 = 0 THEN 'intro' ELSE (doc_id % 9) || '.1' END || ' [p.' || (doc_id % 7) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '-' || (doc_id % 7 + 1) END || '] (' || (doc_id % 5 + 1) || '/5)' AS label FROM documents""")
def chunk_labels(t: Tables):
    d = F.col("doc_id")
    section = F.when(d % 3 != 0, F.concat((d % 9).cast("string"), F.lit(".1")))
    return t.documents.select("doc_id", X.chunk_label(F.concat(F.lit("dir/file-"), "source", F.lit(".pdf")), section, d % 7, d % 7 + d % 2, d % 5, F.lit(5)).alias("label"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\*\*\*(.+?)\*\*\*', '\1', 'g'), '\*\*(.+?)\*\*', '\1', 'g'),
'\*(.+?)\*', '\1', 'g'), '(?m)^#{1,6}\s+', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '(?m)^>\s?', '', 'g'), '(?m)^[*\-]\s+', '- ', 'g')) AS plain_md5 FROM documents""")
def plain_markdown(t: Tables):
    return t.documents.select("doc_id", F.md5(X.strip_markdown(F.coalesce("text", F.lit("")))).alias("plain_md5"))


@query("""WITH s AS (SELECT sha256(coalesce(text, '')) AS sha256, doc_id, source FROM documents) SELECT sha256, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM s GROUP BY sha256""")
def first_of_each_content(t: Tables):
    return G.keep_first(t.documents.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "doc_id", "source"), ["sha256"], ["doc_id"])


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 0 THEN 'not a PDF' WHEN doc_id % 7 = 0 THEN 'empty file' WHEN length(text) + 5 > 10000 AND doc_id % 3 <> 0 THEN 'larger than 10000 bytes' ELSE 'no PDF header' END AS reject_reason
FROM (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n, text FROM documents) WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR n + 5 > 10000 OR doc_id % 3 = 0""".replace("length(text) + 5 > 10000 AND doc_id % 3 <> 0", "n + 5 > 10000"))
def rejected_files(t: Tables):
    d = F.col("doc_id")
    content = F.when(d % 7 == 0, F.lit("")).otherwise(F.concat(F.when(d % 3 == 0, F.lit("html ")).otherwise(F.lit("%PDF-")), F.coalesce("text", F.lit(""))))
    files = t.documents.select(d.cast("string").alias("path"), content.cast("binary").alias("content"), F.when(d % 5 == 0, "text/html").otherwise("application/pdf").alias("content_type"))
    return intake_files(files, 10000)[1]


def regulation_xml(t: Tables):
    """Documents as files of a part with one section; every third is broken."""
    d = F.col("doc_id").cast("string")
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), r"[<&\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    hierarchy = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(' hierarchy_metadata="{&quot;citation&quot;:&quot;36 CFR 800.'), d, F.lit('&quot;}"'))).otherwise("")
    xml = F.concat(F.lit('<DIV5 TYPE="PART" N="800"><HEAD>PART 800</HEAD><DIV6 TYPE="SUBPART"><DIV8 TYPE="SECTION" N="800.'), d, F.lit('"'), hierarchy, F.lit("><HEAD>§ 800."), d, F.lit("  Heading</HEAD><P>"), safe, F.lit("<I>kept</I><FTREF>gone</FTREF></P></DIV8></DIV6></DIV5>"))
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("<DIV5>")).otherwise(xml).cast("binary").alias("content"))


@query("""SELECT doc_id::VARCHAR AS doc_id, 1 AS pos, '800.' || doc_id AS section, 'Heading' AS title, CASE WHEN doc_id % 2 = 0 THEN '36 CFR 800.' || doc_id ELSE '800 CFR §800.' || doc_id END AS citation, '800' AS part, 'PART 800' AS part_title FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id::VARCHAR, 0, NULL, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 3 = 0""")
def xml_sections(t: Tables):
    return parse_regulation_xml(regulation_xml(t)).select("doc_id", "pos", "section", "title", "citation", "part", "part_title")


@query(r"""WITH x AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[<&\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g') || 'kept', ' ' || chr(9) || chr(10) || chr(13)) AS body FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id::VARCHAR AS doc_id, '800.' || doc_id AS section, md5(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS body_md5 FROM x""")
def xml_bodies(t: Tables):
    found = parse_regulation_xml(regulation_xml(t)).filter("section IS NOT NULL")
    return found.select("doc_id", "section", F.md5("body").alias("body_md5"))


@query(r"""WITH n AS (SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '[<&\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g') || 'kept', '\s+'), lambda x: x <> '')) AS n FROM documents WHERE doc_id % 3 <> 0),
c AS (SELECT *, CASE WHEN n <= 1500 THEN 1 ELSE ceil(n / 610.0)::INT - (n - 610 * (ceil(n / 610.0)::INT - 1) < 200)::INT END AS c FROM n)
SELECT CASE WHEN doc_id % 2 = 0 THEN 'a/' ELSE 'b/' END || doc_id AS path, 1::BIGINT AS sections_count, c::BIGINT AS chunks_count, 'ready' AS status, NULL AS status_message FROM c
UNION ALL SELECT min('a/' || doc_id), 0, 0, 'failed', 'no sections found' FROM documents WHERE doc_id % 6 = 0""")
def ingested_files(t: Tables):
    """Two batches into an empty store: files of even ids, then all files under other names; what came before isn't taken in again."""
    folder = work_folder(t.spark, "store")
    files = regulation_xml(t)
    named = lambda prefix: files.select(F.concat(F.lit(prefix), "doc_id").alias("path"), "content")
    ingest(named("a/").filter("doc_id % 2 = 0"), folder, buckets=8)
    ingest(named("b/"), folder, buckets=8)
    return BucketTable(t.spark, f"{folder}/status").read().drop("doc_id")


@query(r"""WITH x AS (SELECT page_id, trim(regexp_replace(coalesce(html, ''), '[<&\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM pages)
SELECT page_id::VARCHAR AS doc_id, k::INT AS pos, CASE k WHEN 1 THEN '9.' || page_id WHEN 2 THEN 'AppB' ELSE 'App' || page_id END AS section, CASE k WHEN 1 THEN 'Scope' WHEN 2 THEN 'Appendix B to Part 9—Forms' ELSE 'Tables' END AS title,
CASE k WHEN 1 THEN '9 CFR §9.' || page_id WHEN 2 THEN '9 CFR App. Appendix B' ELSE 'own ' || page_id END AS citation, md5(CASE k WHEN 1 THEN 'first' || chr(10) || chr(10) || 'second' WHEN 2 THEN replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)) ELSE '' END) AS body_md5 FROM x, (SELECT unnest([1, 2, 3]) AS k)""")
def xml_appendices(t: Tables):
    """Pages as files of a part with a section in a nested subpart, an appendix that holds the page, and one with its own citation."""
    k = F.col("page_id").cast("string")
    safe = F.regexp_replace(F.coalesce("html", F.lit("")), r"[<&\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    one = F.concat(F.lit('<DIV5 TYPE="PART" N="9"><HEAD>PART 9</HEAD><AUTH>x</AUTH><DIV6 TYPE="SUBPART"><HEAD>A</HEAD><DIV6 TYPE="SUBPART"><DIV8 TYPE="SECTION" N="9.'), k, F.lit('"><HEAD>§ 9.'), k, F.lit(" Scope</HEAD><P>first</P><P> </P><P>second</P></DIV8></DIV6></DIV6>"))
    two = F.concat(F.lit('<DIV7 TYPE="SUBJGRP"><DIV8 TYPE="SECTION" N="9.0"/></DIV7><DIV9 TYPE="APPENDIX" N="Appendix B"><HEAD>Appendix B to Part 9—Forms</HEAD><P>'), safe, F.lit("</P></DIV9>"))
    three = F.concat(F.lit('<DIV9 TYPE="APPENDIX" N="'), k, F.lit('" hierarchy_metadata="{&quot;citation&quot;: &quot;own '), k, F.lit('&quot;}"><HEAD>Tables</HEAD></DIV9></DIV5>'))
    docs = t.pages.select(k.alias("doc_id"), F.concat(one, two, three).cast("binary").alias("content"))
    return parse_regulation_xml(docs).select("doc_id", "pos", "section", "title", "citation", F.md5("body").alias("body_md5"))
