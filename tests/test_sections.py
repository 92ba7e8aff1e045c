"""Assembly of sections and text functions, with hand-made rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from screenmill.functions import text as X
from screenmill.operators import sections as S
from screenmill.sources.io import read_files, read_table, write_table
from screenmill.sources.xml_sections import parse_part


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("line", "kind", "section", "title"),
    [
        ("§ 105.14. Review of applications.", "section", "105.14", "Review of applications"),
        ("§ 105.72. [Reserved].", "reserved", None, None),
        ("Subchapter B. DAMS AND RESERVOIRS", "subchapter", None, "DAMS AND RESERVOIRS"),
        ("APPENDIX A", "appendix", None, None),
        ("CHAPTER 105. DAM SAFETY", "chapter_title", None, None),
        ("Cross References", "meta_block", None, None),
        ("GENERAL PROVISIONS", "group", None, "GENERAL PROVISIONS"),
        ("SOME OTHER CAPITALS", "body", None, None),
        ("105.14. Review of applications.", "toc_entry", None, None),
        ("105.14.", "toc_entry", None, None),
        ("   ", "body", None, None),
    ],
)
def test_classify_line(spark, line, kind, section, title):
    c = one(spark, line, X.classify_line)
    assert (c.kind, c.section, c.title) == (kind, section, title)


def test_cross_references(spark):
    text = "as in §1508.9, §§1501.7(b)(2), 42 U.S.C. §4332, section 102(2)(C); 25 Pa. Code § 105.14(b), § 105.13(d), 32 P.S. §§ 693.1 and §1501.3"
    got = spark.createDataFrame([(text, "40 CFR §1501.3")], "t string, c string").select(X.cross_references(F.col("t"), F.col("c")).alias("r")).first().r
    assert got == ["40 CFR §1508.9", "40 CFR §1501.7", "42 USC §4332", "NEPA §102", "25 Pa. Code § 105.14", "25 Pa. Code § 105.13", "25 Pa. Code § 693.1", "32 P.S. § 693.1"]


def test_recover_and_collapse(spark):
    assert one(spark, "��1501.7 PART 1501�NEPA [42 USC � 4332] say �yes�", X.recover_chars) == '§§1501.7 PART 1501—NEPA [42 USC § 4332] say "yes"'
    assert one(spark, " responsi-\nbilities   of\tall ", X.collapse) == "responsibilities of all"


def test_nested_quotes_and_what_stays_lost(spark):
    lost = X.LOST
    assert one(spark, f"a {lost}{lost}b x{lost} c{lost} d", X.recover_chars) == 'a ""b x" c" d'
    assert one(spark, f"{lost * 4}a{lost}b{lost}c{lost}d{lost}", X.recover_chars) == f'{lost * 2}""a"b"c"d"'
    left = f"{'x' * 30}{lost}{'y' * 30}"
    assert one(spark, left, X.recover_chars) == left
    assert one(spark, left, X.lost_contexts, "string") == [f"{'x' * 20}?{'y' * 20}"]
    assert one(spark, "none", X.lost_contexts) == []


def test_blocks_of_spans(spark):
    spans = [("d", 1, 1, 0, "Bold", 12.0, True), ("d", 1, 1, 1, "plain", 10.0, False), ("d", 1, 2, 0, "bold words", 9.0, True), ("d", 1, 2, 1, "x", 9.0, False), ("d", 1, 3, 0, "  ", 9.0, True)]
    rows = S.blocks_of_spans(spark.createDataFrame(spans, "doc_id string, page int, block_no int, span_no int, text string, size double, is_bold boolean")).orderBy("block_no").collect()
    assert [(r.text, r.max_size, r.is_bold) for r in rows] == [("Bold plain", 12.0, False), ("bold words x", 9.0, True)]


def test_write_table_replaces_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v int, part string")
    write_table(rows, str(tmp_path / "t"), ["part"])
    write_table(spark.createDataFrame([(3, "b")], rows.schema), str(tmp_path / "t"), ["part"], "overwrite")
    assert sorted((r.v, r.part) for r in read_table(spark, str(tmp_path / "t")).collect()) == [(1, "a"), (3, "b")]
    (tmp_path / "x.pdf").write_bytes(b"%PDF-")
    assert [r.content_type for r in read_files(spark, str(tmp_path / "x.pdf")).collect()] == ["application/pdf"]


def test_state_sections(spark):
    page = "105.1. Contents\n§ 105.1. Purpose.\nFirst line\n12/140\nsecond line\nSource\nAdopted, effective January 3, 1979.\nSubchapter B. DAMS\n§ 105.81. Permits.\n§ 105.82. [Reserved].\nnot kept\n§ 105.83. Design.\ntext\nAPPENDIX A\n§ 105.99. Never.\nx"
    rows = S.assemble_state_sections(spark.createDataFrame([("d", 1, page)], "doc_id string, page int, text string")).orderBy("pos").collect()
    assert [(r.section, r.body, r.part, r.effective_date) for r in rows] == [("105.1", "First line\nsecond line", None, "January 3, 1979"), ("105.83", "text", "B", None)]
    empty = S.empty_state_sections(spark.createDataFrame([("d", 1, page)], "doc_id string, page int, text string")).collect()
    assert [r.section for r in empty] == ["105.81"]


def test_report_sections(spark):
    blocks = [(1, 1, "front matter", 11.0, False), (1, 2, "Chapter 4: Resources", 18.0, True), (1, 3, "intro", 11.0, False), (2, 1, "4.1 Water Resources", 14.0, True), (2, 2, "| a | b |", 11.0, False), (2, 3, "4.1.2 Groundwater", 12.0, True), (3, 1, "deep", 11.0, False), (3, 2, "4.2 Air", 14.0, True), (4, 1, "air text", 11.0, False), (4, 2, "5.1 None", 14.0, True)]
    df = spark.createDataFrame([("d", *b) for b in blocks], "doc_id string, page int, block_no int, text string, max_size double, is_bold boolean")
    rows = S.assemble_report_sections(df).orderBy("pos").collect()
    assert [(r.section_number, r.breadcrumb, r.page_start, r.page_end, r.has_table_hint) for r in rows] == [
        (None, "Chapter 4: Resources", 1, 1, False),
        ("4.1", "Chapter 4: Resources > 4.1 Water Resources", 2, 2, True),
        ("4.1.2", "Chapter 4: Resources > 4.1 Water Resources > 4.1.2 Groundwater", 2, 3, False),
        ("4.2", "Chapter 4: Resources > 4.2 Air", 3, 4, False),
    ]


def test_federal_sections(spark):
    html = "<b>TABLE OF CONTENTS</b><p>skip</p><b>PART 1501—NEPA AND AGENCY PLANNING</b><b>§1501.3 When to prepare an</b><b>assessment.</b><p>Agencies shall.</p><b>THE NATIONAL ENVIRONMENTAL POLICY</b><b>TITLE I</b><b>Sec. 102 [42 USC § 4332].</b><p>The Congress</p>"
    rows = S.assemble_federal_sections(spark.createDataFrame([("d", 1, html)], "doc_id string, page int, html string")).orderBy("pos").collect()
    assert [(r.document_type, r.citation, r.body, r.part_title) for r in rows] == [("cfr_regulation", "40 CFR §1501.3", "Agencies shall.", "Nepa and Agency Planning"), ("statute", "NEPA §102", "The Congress", None)]
    assert rows[0].title == "When to prepare an assessment"


def test_xml_errors_are_rows():
    assert list(parse_part("a", b""))[0][-1].startswith("ValueError")
    assert list(parse_part("a", b"<x"))[0][-1].startswith("ParseError")
    rows = list(parse_part("a", b'<DIV5 TYPE="PART" N="800"><HEAD>P</HEAD><DIV9 TYPE="APPENDIX" N="Appendix A to Part 800"><HEAD>A</HEAD><P>x<I>y</I><FTREF>z</FTREF>w</P></DIV9></DIV5>'))
    assert [(r[2], r[3], r[5], r[-1]) for r in rows] == [("appendix", "Appendix A to Part 800", "xyw", None)]


def test_scalar_functions(spark):
    assert one(spark, "THE PROTECTION OF WATERS", X.titlecase) == "The Protection of Waters"
    assert one(spark, "Appendix III", X.appendix_id) == "AppIII"
    assert one(spark, "40.1, -75.2", X.coordinates).lat == 40.1
    assert one(spark, "40.1", X.coordinates) is None
    assert one(spark, "x (a) one (b) two", X.labelled_paragraphs) == [("", "x"), ("(a)", "(a) one"), ("(b)", "(b) two")]
    assert one(spark, "**bold** [a](b) `c`\n# head\n* item", X.strip_markdown) == "bold a c\nhead\n- item"


def test_citations_that_overlap(spark):
    """Each kind is looked for in the whole text, so one mention may be part of another's."""
    cases = {
        "under section 42 U.S.C. § 4332": ["42 USC §4332", "NEPA §42"],
        "see § 5 U.S.C. § 552": ["5 USC §552"],
        "section 32 P.S. § 693.1": ["NEPA §32", "25 Pa. Code § 693.1", "32 P.S. § 693.1"],
        "§§1501.7(b), § 1502.14 and §1501.7; Section 102(2)(C), 42 usc 4332A": ["40 CFR §1501.7", "40 CFR §1502.14", "42 USC §4332A", "NEPA §102"],
        "25 Pa. Code § 105.14a and §§ 105.15": ["25 Pa. Code § 105.14a", "25 Pa. Code § 105.15"],
        "no mention": [],
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: r.refs for r in rows.select("t", X.cross_references(F.col("t"), F.lit("40 CFR §1.1")).alias("refs")).collect()} == cases
    own = rows.select("t", X.cross_references(F.col("t"), F.lit("NEPA §42")).alias("refs")).first()
    assert own.refs == ["42 USC §4332"]


def test_citation_graph(spark):
    rng = random.Random(4)
    names = [f"s{k}" for k in range(40)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(60)] + [("s1", "s1"), ("s0", "hub"), ("s0", "hub")] + [(n, "hub") for n in names]
    refs = spark.createDataFrame(pairs, "src string, dst string")
    out = {n: {b for a, b in pairs if a == n} for n in [*names, "hub"]}

    def depths(start):
        found, frontier, depth = {}, {start}, 0
        while frontier:
            depth += 1
            frontier = {b for a in frontier for b in out.get(a, ())} - set(found)
            found |= dict.fromkeys(frontier, depth)
        return found

    starts = spark.createDataFrame([(n,) for n in (*names[:7], "hub", "none", None)], "citation string")
    got = {(r.start, r.citation): r.depth for r in S.reachable(refs, starts).collect()}
    assert got == {(n, b): d for n in names[:7] for b, d in depths(n).items()}
    near = {(r.start, r.citation): r.depth for r in S.reachable(refs, starts, 2).collect()}
    assert near == {k: d for k, d in got.items() if d <= 2}
    sections = spark.createDataFrame([(n,) for n in (*names, "hub", "alone", None)], "citation string")
    degrees = {r.citation: (r.cites, r.cited_by) for r in S.citation_degrees(refs, sections).collect()}
    assert degrees == {n: (len(out.get(n, set()) - {n}), len({a for a, b in pairs if b == n and a != n})) for n in (*names, "hub", "alone")}
    assert S.reachable(refs.limit(0), starts).count() == 0


def test_xml_is_read_as_a_stream(spark):
    """A file is refused as a whole if its end is broken; memory doesn't grow with the number of sections."""
    import tracemalloc

    section = lambda k: f'<DIV8 TYPE="SECTION" N="9.{k}"><HEAD>H</HEAD><P>{"word " * 400}</P></DIV8>'
    sizes = {}
    for n in (200, 4000):
        content = ('<DIV5 TYPE="PART" N="9"><HEAD>T</HEAD>' + "".join(map(section, range(n))) + "<ODD/></DIV5>").encode()
        tracemalloc.start()
        count = 0
        for row in parse_part("a", content):
            count += 1
            assert row[1] == count and row[8] == "T" and row[9][-1] == "unexpected ODD of None skipped"
        sizes[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count == n
        (bad,) = parse_part("a", content[:-3])
        assert bad[-1].startswith("ParseError")
    # the warnings of each section stay, about 100 bytes, as does nothing else
    assert sizes[4000] < sizes[200] + 4000 * 400
    (other,) = parse_part("a", b"<DIV6><x></DIV6>")
    assert other[-1].startswith("ParseError")
    (wrong,) = parse_part("a", b"<DIV6><x/></DIV6>")
    assert wrong[-1].startswith("ValueError: expected a DIV5")


def test_tree_and_stream_give_the_same_rows(monkeypatch):
    from screenmill.sources import xml_sections as M

    section = '<DIV8 TYPE="SECTION" N="1.{0}"><HEAD>§ 1.{0} H<FTREF>x</FTREF></HEAD><P>a<I>b</I>c</P><X><P>no</P></X><P> </P></DIV8>'
    inside = section.format(2) + '<HEAD>sub</HEAD><DIV6 TYPE="SUBPART"><DIV6 TYPE="OTHER"/>' + section.format(3) + "</DIV6>" + section.format(4)
    files = [
        f'<DIV5 TYPE="PART" N="1"><AUTH>x</AUTH><HEAD>P</HEAD><HEAD>Q</HEAD>{section.format(1)}<DIV6 TYPE="SUBPART">{inside}</DIV6><DIV7 TYPE="SUBJGRP">{section.format(5)}</DIV7><DIV9 TYPE="APPENDIX" N="A"/></DIV5>',
        f'<DIV5 TYPE="PART" N="1"><DIV6 TYPE="SUBPART"><HEAD>only here</HEAD>{section.format(1)}</DIV6></DIV5>', '<DIV5 TYPE="PART"/>', "<DIV5>", "<DIV5/>", "<DIV6><x></DIV6>", "<DIV6><x/></DIV6>", "", " ", '<DIV5 TYPE="PART"><DIV8></DIV5>',
    ]
    tree = [list(M.parse_part("a", x.encode())) for x in files] + [list(M.parse_part("a", None))]
    monkeypatch.setattr(M, "WHOLE_BYTES", -1)
    assert tree == [list(M.parse_part("a", x.encode())) for x in files] + [list(M.parse_part("a", None))]
    assert [len(rows) for rows in tree] == [5, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]


def test_trimmed_white_space_is_that_of_the_pattern(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    texts = spark.createDataFrame([(f"{c}a {c}b{c} \n{c}",) for c in chars] + [("",), (" \n",), (None,)], "x string")
    assert texts.filter(~X.trim_white(F.col("x")).eqNullSafe(F.regexp_replace("x", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_labels_are_those_of_the_pattern(spark):
    rng = random.Random(3)
    texts = spark.createDataFrame([("".join(rng.choices(["(a)", "(b)", *" .:;\nx("], k=rng.randrange(20))),) for _ in range(3000)], "x string")
    marked = F.regexp_replace("x", r"(?:^|(?<=[.:;\s]))(\([a-z]\))(?=\s)", "\x00$1")
    parts = F.filter(F.transform(F.split(marked, "\x00"), X.trim_white), lambda p: p != "")
    assert texts.filter(F.transform(X.labelled_paragraphs(F.col("x")), lambda p: p["text"]) != parts).count() == 0
    assert texts.filter(F.size(parts) > 1).count() > 100
