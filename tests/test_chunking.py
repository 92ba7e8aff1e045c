"""Chunking: sizes, merging, overlap; random documents against plain loops over lists."""

from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from screenmill import schemas
from screenmill.functions import text as X
from screenmill.operators import chunking as C
from screenmill.operators.knn import embedder

LEAST, MOST, TARGET, OVERLAP = 20, 150, 70, 9


def section(doc, pos, body, kind="cfr_regulation", part="1500", statute=None, title=None):
    return (doc, pos, kind, f"{part}.{pos}", "T", body, f"c{pos}", [1], part, None, statute, title, None)


def chunks(spark, rows):
    made = C.chunk_regulation(spark.createDataFrame(rows, schemas.SECTION), LEAST, MOST, TARGET, OVERLAP)
    return [([s.section for s in r.sources], r.body, r.subsection, r.chunk_index, r.total_chunks_in_section, r.token_count, r.is_merged_siblings) for r in sorted(made.collect(), key=lambda r: (r.doc_id, r.chunk_no))]


def words(n, tag="w"):
    return " ".join(f"{tag}{k}" for k in range(n))


def sizes(spark, *rows):
    return [(len(c[0]), c[5]) for c in chunks(spark, [section("d", k, words(n), **more) for k, (n, more) in enumerate(rows)])]


def test_small_neighbours_share_a_chunk_within_a_part_only(spark):
    assert sizes(spark, (10, {}), (5, {})) == [(2, 15)]
    assert sizes(spark, (10, {}), (5, {"part": "1501"})) == [(1, 10), (1, 5)]
    assert sizes(spark, (10, {"part": "1508"}), (5, {"part": "1508"})) == [(1, 10), (1, 5)]
    assert sizes(spark, (10, {"kind": "state_code"}), (5, {"kind": "state_code"})) == [(1, 10), (1, 5)]
    assert sizes(spark, (10, {"kind": "statute", "statute": "S", "title": "I"}), (5, {"kind": "statute", "statute": "S", "title": "II"})) == [(1, 10), (1, 5)]


def test_what_is_left_small_goes_back(spark):
    assert sizes(spark, (70, {}), (5, {})) == [(2, 75)]
    assert sizes(spark, (149, {}), (5, {})) == [(1, 149), (1, 5)]
    assert sizes(spark, (10, {}), (60, {}), (60, {}), (5, {})) == [(2, 70), (2, 65)]


def test_split_by_labels_with_overlap(spark):
    body = f"head words here. (a) {words(60, 'a')} (b) {words(60, 'b')} (c) {words(200, 'c')} (d) {words(3, 'd')}"
    got = chunks(spark, [section("d", 1, body)])
    assert [c[2] for c in got][:3] == ["(a)", "(b)", "window-0"]
    assert got[1][1].startswith(" ".join(got[0][1].split()[-OVERLAP:]))
    assert got[-1][1].endswith("(d) d0 d1 d2") and {w for w in body.split()} <= {w for c in got for w in c[1].split()}
    # the small rest goes back to the window before it
    assert [c[3] for c in got] == [*range(len(got) - 1), 0] and got[-1][4] == 1 and got[-1][6] and {c[4] for c in got[:-1]} == {len(got) + 1}


def test_window_variants(spark):
    df = spark.createDataFrame([(words(1300),)], "t string")
    row = df.select(C.WORDS.windows(C.WORDS.split(df.t), 700, 90, False).alias("a"), C.WORDS.windows(C.WORDS.split(df.t), 700, 90, True).alias("b")).first()
    assert [len(x.split()) for x in row.a] == [700, 690, 80]
    assert [len(x.split()) for x in row.b] == [700, 690]


def plain_merge(units):
    """units: (tokens, key, solo) in order; groups of their numbers, by two passes over lists."""
    groups, k = [], 0
    while k < len(units):
        group, total = [k], units[k][0]
        if units[k][2] and total < LEAST:
            for j in range(k + 1, len(units)):
                n, key, solo = units[j]
                if not solo or key is None or key != units[k][1] or total + n > MOST or (total >= LEAST and n >= LEAST):
                    break
                group.append(j)
                total += n
        groups.append(group)
        k = group[-1] + 1
    out = []
    for group in groups:
        n = sum(units[j][0] for j in group)
        if out and len(group) == 1 and n < LEAST and units[group[0]][1] is not None and units[out[-1][-1]][1] == units[group[0]][1] and n + sum(units[j][0] for j in out[-1]) <= MOST:
            out[-1] += group
        else:
            out.append(group)
    return out


def test_merging_equals_two_passes_over_lists(spark):
    rng = random.Random(1)
    rows, want = [], []
    for doc in range(60):
        units = []
        part = "1500"
        for pos in range(rng.randint(1, 14)):
            part = rng.choice([part, part, part, "1501", "1508"])
            n = rng.choice([rng.randint(1, 30), rng.randint(1, 150)])
            rows.append(section(f"{doc:02}", pos, words(n), part=part))
            units.append((n, None if part == "1508" else part, True))
        want += [(len(g), sum(units[k][0] for k in g)) for g in plain_merge(units)]
    assert [(len(c[0]), c[5]) for c in chunks(spark, rows)] == want


def test_report_chunks(spark):
    body = "\n\n".join([words(100, "a"), words(40, "b"), words(20, "c"), words(400, "d"), words(5, "e")])
    rows = spark.createDataFrame([("d", 1, body, False), ("d", 2, "| x |\n", False)], "doc_id string, pos int, body string, has_table_hint boolean")
    got = sorted(C.chunk_report(rows, MOST, TARGET, OVERLAP).collect(), key=lambda r: (r.pos, r.chunk_index))
    assert [r.token_count for r in got if r.pos == 1] == [140, 20, 70, 70, 70, 70, 70, 70, 34, 5]
    assert [(r.has_table, r.total_chunks_in_section) for r in got if r.pos == 2] == [(True, 1)]


def breadcrumbs(spark, *cases):
    """cases: (sources, subsection, definition)."""
    kinds = f"n int, sources array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in schemas.SOURCE.split(','))}>>, subsection string, definition boolean"
    rows = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], kinds)
    made = rows.select("n", X.breadcrumb(F.col("sources"), F.col("subsection"), F.col("definition")).alias("b")).collect()
    return [r.b for r in sorted(made)]


def source(kind, section, title, citation, part=None, part_title=None, statute=None, statute_title=None):
    return (kind, section, title, citation, [1], part, part_title, statute, statute_title, None)


def test_breadcrumbs_of_all_kinds(spark):
    a = source("cfr_regulation", "1501.1", "Purpose", "40 CFR §1501.1", "1501", "NEPA and Planning")
    b = source("cfr_regulation", "1501.3", "When to prepare", "40 CFR §1501.3", "1501", "NEPA and Planning")
    nepa = source("statute", "101", "Policy", "NEPA §101", statute="NEPA", statute_title="Title I")
    other = source("statute", "2", "Aim", "X §2", statute=None)
    order = source("executive_order", "1", "Policy", "EO 11514 §1", statute="Executive Order 11514")
    state = source("state_code", "105.1", "Definitions", "25 Pa. Code § 105.1", "A", None)
    head = "Title 40 — Protection of Environment > Chapter V — Council on Environmental Quality > Part 1501 — NEPA and Planning > "
    assert breadcrumbs(spark, ([a], "(a)-(c)", False), ([a, b], None, False), ([nepa], None, False), ([other], "(a)", False), ([order], None, False), ([state], None, True)) == [
        head + "§1501.1 — Purpose (a)-(c)",
        head + "§1501.1–1501.3 — Purpose / When to prepare",
        "NEPA (42 USC §4321 et seq.) > Title I > Policy (NEPA §101)",
        "Statute > Aim (X §2) (a)",
        "Executive Order 11514 (1970) — Protection and Enhancement of Environmental Quality > Policy (EO 11514 §1)",
        "Title 25 — Environmental Protection > Chapter 105 — Dam Safety and Waterway Management > Subchapter A > § 105.1 — Definitions [DEFINITION]",
    ]


def test_metadata_of_a_merged_chunk(spark):
    rows = [section("d", 1, "see §1502.2 and 42 USC §4332"), section("d", 2, "| a | b |")]
    made = C.chunk_regulation(spark.createDataFrame(rows, schemas.SECTION), LEAST, MOST, TARGET, OVERLAP)
    known = spark.createDataFrame([("d", "s-d", "d.pdf", "aa", True, 5)], "doc_id string, id string, filename string, sha256 string, is_current boolean, project_id int")
    r = C.build_metadata(made, known).first()
    assert (r.all_sections, r.all_citations, r.page_numbers, r.cross_references) == (["1500.1", "1500.2"], ["c1", "c2"], [1], ["40 CFR §1502.2", "42 USC §4332"])
    assert (r.has_table, r.is_merged_siblings, r.source_id, r.filename, r.project_id) == (True, True, "s-d", "d.pdf", 5)
    assert r.embedding_text == r.breadcrumb + "\n\n" + r.body and r.chunk_id == hashlib.sha256(b"s-d\x1fc1\x1f0\x1f").hexdigest()


def test_hashed_embeddings_equal_the_formula(spark):
    text = "some words and some Words again"
    got = spark.createDataFrame([(text,), ("",)], "t string").select(embedder(dim=16)("t").alias("v")).collect()
    want = [0.0] * 16
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        want[h % 16] += 1.0 if h >> 31 else -1.0
    norm = sum(x * x for x in want) ** 0.5
    assert [round(x, 5) for x in got[0].v] == [round(x / norm, 5) for x in want] and set(got[1].v) == {0.0}


def test_part_1508_are_definitions_in_the_summary(spark):
    made = "'cfr_regulation' AS document_type, '1' AS section, 't' AS title, 'a few words' AS body, 'c' AS citation, array(1) AS pages, string(1507 + id % 2) AS part, string(null) AS part_title, string(null) AS parent_statute, string(null) AS statute_title, string(null) AS effective_date"
    chunks = C.chunk_regulation(spark.range(6).selectExpr("'d' AS doc_id", "int(id) AS pos", *made.split(", ")))
    assert {r.part: r.n_definitions for r in C.chunk_summary(chunks, "part").collect()} == {"1507": 0, "1508": 3}
