"""Assembly of sections from lines, blocks and spans, with window functions that share one ordering per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenmill.functions import text as X
from screenmill.sources.io import written


def _joined(pos: Column, value: Column, when: Column, sep: str) -> Column:
    """The values where the condition holds, in the order of pos."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct(pos.alias("p"), value.alias("v"))))), lambda x: x["v"]), sep)


def _pages(when: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(when, F.col("page"))))


def lines_of(pages: DataFrame, text: Column) -> DataFrame:
    """doc_id, page, pos and line of every line: pos orders the lines of a document."""
    return pages.select("doc_id", "page", F.posexplode_outer(F.split(text, "\n")).alias("n", "line")).filter("n IS NOT NULL").withColumn("pos", F.struct("page", "n")).drop("n")


def assemble_state_sections(pages: DataFrame) -> DataFrame:
    """Sections of the state code from page texts (doc_id, page, text).

    A section's heading opens it; the next heading, a subchapter, a reserved heading or an appendix closes it, and an
    appendix ends the document.  Lines before the first heading, tables of contents, chapter titles and group headings
    enter no body.  The texts under Authority, Source, Cross References and Notes are kept apart.  Sections with an empty
    body are dropped; `empty_state_sections` lists them.
    """
    return _state_sections(pages).filter("body <> ''")


def empty_state_sections(pages: DataFrame) -> DataFrame:
    return _state_sections(pages).filter("body = ''").select("doc_id", "section", F.concat(F.lit("empty body for § "), "section").alias("warning"))


def _state_sections(pages: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines_of(pages, X.strip_browser_noise(F.col("text"))).withColumn("c", X.classify_line(F.col("line"))).select("doc_id", "page", "pos", X.trim_white(F.col("line")).alias("line"), "c.*")
    rows = rows.withColumn("ended", F.max((F.col("kind") == "appendix").cast("int")).over(w)).withColumn("started", F.max((F.col("kind") == "section").cast("int")).over(w))
    rows = rows.filter("ended = 0 AND started = 1")
    opens = F.col("kind").isin("section", "reserved", "subchapter")
    part = F.when(F.col("kind") == "subchapter", F.struct("letter", "title"))
    rows = rows.withColumn("no", F.sum(opens.cast("int")).over(w)).withColumn("sub", F.last(part, ignorenulls=True).over(w))
    inside = Window.partitionBy("doc_id", "no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.last("meta", ignorenulls=True).over(inside))
    body = (F.col("kind") == "body") & (F.col("line") != "")
    meta = lambda name: F.nullif(_joined(F.col("pos"), F.col("line"), body & (F.col("block") == name), " "), F.lit(""))
    head = F.col("kind") == "section"
    made = rows.groupBy("doc_id", "no").agg(
        F.min(F.when(head, F.col("pos"))).alias("pos"),
        F.max(F.when(head, F.col("section"))).alias("section"),
        F.max(F.when(head, F.col("title"))).alias("title"),
        _joined(F.col("pos"), F.col("line"), body & F.col("block").isNull(), "\n").alias("body"),
        _pages(head | (body & F.col("block").isNull())).alias("pages"),
        F.max(F.when(head, F.col("sub"))).alias("sub"),
        *(meta(m).alias(m) for m in ("authority", "source_history", "cross_references", "notes_of_decisions")),
    )
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("int")
    return made.filter("section IS NOT NULL").select(
        "doc_id", number.alias("pos"), F.lit("state_code").alias("document_type"), "section", "title", "body", F.concat(F.lit("25 Pa. Code § "), "section").alias("citation"), "pages",
        F.col("sub.letter").alias("part"), F.col("sub.title").alias("part_title"), F.lit(None).cast("string").alias("parent_statute"), F.lit(None).cast("string").alias("statute_title"),
        X.effective_date(F.col("source_history")).alias("effective_date"), "authority", "source_history", "cross_references", "notes_of_decisions",
    )


def blocks_of_spans(spans: DataFrame) -> DataFrame:
    """Blocks of a report from spans (doc_id, page, block_no, span_no, text, size, is_bold): bold if at least half of the characters are."""
    size = F.char_length("text")
    made = spans.groupBy("doc_id", "page", "block_no").agg(
        X.trim_white(_joined(F.col("span_no"), F.col("text"), F.lit(True), " ")).alias("text"), F.max("size").alias("max_size"), (F.sum(F.when(F.col("is_bold"), size).otherwise(0)) * 2 >= F.sum(size)).alias("is_bold"), F.sum(size).alias("n")
    )
    return made.filter("text <> '' AND n > 0").drop("n")


def body_sizes(blocks: DataFrame) -> DataFrame:
    """doc_id and the commonest size of non-bold blocks (rounded to a tenth; ties: seen first; none: 11)."""
    plain = blocks.filter(~F.col("is_bold")).groupBy("doc_id", F.round("max_size", 1).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "block_no")).alias("at"))
    best = plain.groupBy("doc_id").agg(F.min_by("size", F.struct((-F.col("n")).alias("n"), "at")).alias("body_size"))
    return blocks.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("body_size", F.lit(11.0)).alias("body_size"))


def assemble_report_sections(blocks: DataFrame) -> DataFrame:
    """Sections of reports from blocks (doc_id, page, block_no, text, max_size, is_bold).

    A chapter starts its own path of headings; a numbered heading of depth d takes those of depth d and more off the
    path.  Text before the first heading and headings without text give no section.
    """
    rows = blocks.join(body_sizes(blocks), "doc_id").withColumn("c", X.classify_heading(F.col("text"), F.col("max_size"), F.col("is_bold"), F.col("body_size")))
    rows = rows.select("doc_id", "page", F.struct("page", "block_no").alias("pos"), "text", "c.kind", "c.number", "c.title")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("no", F.sum(F.col("kind").isNotNull().cast("int")).over(w)).withColumn("depth", F.when(F.col("kind") == "section", F.size(F.split("number", r"\.")) - 1))
    label = F.when(F.col("kind") == "chapter", F.concat(F.lit("Chapter "), "number", F.lit(": "), "title")).otherwise(F.concat("number", F.lit(" "), "title"))
    rows = rows.withColumn("label", label)
    last = lambda when: F.last(F.when(when, F.struct("pos", "label")), ignorenulls=True).over(w)
    rows = rows.withColumn("chapter_at", last(F.col("kind") == "chapter"))
    for d in range(4):
        rows = rows.withColumn(f"at{d}", last(F.col("depth") == d))
    # an entry of depth k stands if no chapter and no entry of a smaller depth came after it
    path = [F.col("chapter_at.label")]
    for d in range(4):
        own = F.col(f"at{d}")
        stands = own.isNotNull()
        for above in (F.col("chapter_at"), *(F.col(f"at{k}") for k in range(d))):
            stands = stands & (above.isNull() | (above["pos"] < own["pos"]))
        path.append(F.when(stands, own["label"]))
    rows = rows.withColumn("path", F.concat_ws(" > ", *path)).filter("no > 0")
    head, body = F.col("kind").isNotNull(), F.col("kind").isNull()
    made = rows.groupBy("doc_id", "no").agg(
        F.max(F.when(head, F.struct("kind", "number", "title", "path", "page"))).alias("h"),
        X.trim_white(_joined(F.col("pos"), F.col("text"), body, "\n")).alias("body"),
        F.count(F.when(body, True)).alias("n"),
        F.max("page").alias("page_end"),
        F.coalesce(F.bool_or(F.when(body, X.has_table(F.col("text")))), F.lit(False)).alias("has_table_hint"),
    )
    chapter = F.col("h.kind") == "chapter"
    return made.filter("n > 0").select(
        "doc_id", F.col("no").cast("int").alias("pos"), F.substring_index("h.number", ".", 1).alias("chapter"), F.when(~chapter, F.col("h.number")).alias("section_number"),
        F.when(chapter, F.concat(F.lit("Chapter "), "h.number", F.lit(": "), "h.title")).otherwise(F.col("h.title")).alias("section_title"), F.col("h.path").alias("breadcrumb"),
        "body", F.col("h.page").alias("page_start"), "page_end", "has_table_hint",
    )


def bold_spans(pages: DataFrame) -> DataFrame:
    """Bold and plain spans of pages (doc_id, page, html) in order, white space collapsed, empty ones left out."""
    marked = X.recover_chars(X.marked_text(F.col("html")))
    cut = F.split(F.regexp_replace(marked, rf"(?s){X.BOLD}(.*?){X.PLAIN}", "\x03B$1\x03P"), "\x03")
    rows = pages.select("doc_id", "page", F.posexplode_outer(cut).alias("n", "raw")).filter("n IS NOT NULL")
    span = X.collapse(F.regexp_replace(F.when(F.col("n") == 0, F.col("raw")).otherwise(F.substring("raw", 2, 1 << 30)), f"[{X.BOLD}{X.PLAIN}]", ""))
    return rows.select("doc_id", "page", F.struct("page", "n").alias("pos"), ((F.col("n") > 0) & F.col("raw").startswith("B")).alias("bold"), span.alias("span")).filter("span <> ''")


def assemble_federal_sections(pages: DataFrame) -> DataFrame:
    """Sections of the federal print from page HTML (doc_id, page, html).

    Banners in bold switch the mode (regulation, table of contents, index, three statutes, executive order); the mode
    decides what a bold heading is.  Contents and index are skipped, page furniture enters no body, part and statute
    title are carried forward, and a bold span right after an open heading continues its title.  A section stays if it
    has a body or a title.
    """
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mode = F.when(F.col("bold"), F.coalesce(X.boundary(F.col("span")), F.when(F.col("span").rlike(X.PART_SPAN), "cfr")))
    rows = bold_spans(pages).withColumn("mode", F.coalesce(F.last(mode, ignorenulls=True).over(w), F.lit("unknown")))
    rows = rows.withColumn("c", F.when(F.col("bold"), X.classify_bold(F.col("span"), F.col("mode")))).select("doc_id", "page", "pos", "span", "mode", "bold", "c.*")
    rows = rows.filter(~F.col("mode").isin("toc", "index") & ~F.coalesce(F.col("kind") == "noise", F.lit(False)))
    heading = F.col("kind").isin("cfr_section", "nepa_section", "eqia_section", "caa_section", "eo_section")
    closes = heading | F.col("kind").isin("part", "title_heading") | F.col("kind").startswith("boundary_")
    rows = rows.withColumn("part_at", F.last(F.when(F.col("kind") == "part", F.struct("number", "title")), ignorenulls=True).over(w)).withColumn("title_at", F.last(F.when(F.col("kind") == "title_heading", F.col("number")), ignorenulls=True).over(w))
    rows = rows.withColumn("no", F.sum(F.coalesce(closes, F.lit(False)).cast("int")).over(w))
    inside = Window.partitionBy("doc_id", "no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("plain_before", F.sum((~F.col("bold")).cast("int")).over(inside))
    more = F.col("bold") & (F.col("kind") == "unknown") & (F.col("plain_before") == 0)
    body = F.col("kind").isNull() | ((F.col("kind") == "unknown") & (F.col("plain_before") > 0))
    made = rows.groupBy("doc_id", "no").agg(
        F.max(F.when(heading, F.struct("kind", "number", "title", "part", "part_at", "title_at", "mode"))).alias("h"),
        _joined(F.col("pos"), F.col("span"), more, " ").alias("more"),
        X.trim_white(_joined(F.col("pos"), F.col("span"), body, " ")).alias("body"),
        _pages(F.lit(True)).alias("pages"),
    ).filter("h IS NOT NULL")
    kind, number = F.col("h.kind"), F.col("h.number")
    title = F.regexp_replace(F.trim(F.concat_ws(" ", "h.title", F.nullif("more", F.lit("")))), r"\.+$", "")
    statute = F.when(F.col("h.mode") == "nepa", "NEPA").when(F.col("h.mode") == "eqia", "Environmental Quality Improvement Act").when(F.col("h.mode") == "caa", "Clean Air Act").when(F.col("h.mode") == "eo", "Executive Order 11514")
    usc = F.when(kind == "nepa_section", F.concat(F.lit("NEPA §"), number)).when(kind.isin("eqia_section", "caa_section"), F.concat(F.lit("42 USC §"), number))
    is_cfr = kind == "cfr_section"
    return made.filter((F.col("body") != "") | (title != "")).select(
        "doc_id", F.col("no").cast("int").alias("pos"), F.when(is_cfr, "cfr_regulation").when(kind == "eo_section", "executive_order").otherwise("statute").alias("document_type"), number.alias("section"), title.alias("title"), "body",
        F.when(is_cfr, F.concat(F.lit("40 CFR §"), number)).when(kind == "eo_section", F.concat(F.lit("EO 11514 §"), number)).otherwise(usc).alias("citation"), "pages",
        F.col("h.part").alias("part"), F.when(F.col("h.part_at.number") == F.col("h.part"), F.col("h.part_at.title")).alias("part_title"), F.when(~is_cfr, statute).alias("parent_statute"),
        F.when(kind == "nepa_section", F.concat(F.lit("Title "), "h.title_at")).alias("statute_title"), F.lit(None).cast("string").alias("effective_date"),
    )


def resolve_references(chunks: DataFrame) -> DataFrame:
    """src, dst and whether dst is a section of the corpus, for each citation in chunks (chunk_id, citation, body)."""
    refs = chunks.select(F.col("citation").alias("src"), F.explode_outer(X.cross_references(F.col("body"), F.col("citation"))).alias("dst")).filter("dst IS NOT NULL").distinct()
    known = chunks.select(F.col("citation").alias("dst")).distinct().withColumn("resolved", F.lit(True))
    return refs.join(known, "dst", "left").select("src", "dst", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def citation_degrees(references: DataFrame, sections: DataFrame) -> DataFrame:
    """citation, cites and cited_by: how many others each of the sections (citation) cites and is cited by, of references (src, dst)."""
    pairs = references.filter("src <> dst").select("src", "dst").distinct()
    # one row of +1 for each end, combined before the shuffle, so that a section that all others cite is no hot key
    ends = pairs.select(F.col("src").alias("citation"), F.lit(1).alias("cites"), F.lit(0).alias("cited_by")).unionByName(pairs.select(F.col("dst").alias("citation"), F.lit(0).alias("cites"), F.lit(1).alias("cited_by")))
    none = sections.filter("citation IS NOT NULL").select("citation", F.lit(0).alias("cites"), F.lit(0).alias("cited_by"), F.lit(True).alias("own"))
    both = ends.withColumn("own", F.lit(False)).unionByName(none)
    return both.groupBy("citation").agg(F.sum("cites").alias("cites"), F.sum("cited_by").alias("cited_by"), F.max("own").alias("own")).filter("own").drop("own")


def reachable(references: DataFrame, starts: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """start, citation and depth of all that the starts (citation) lead to over references (src, dst), by the fewest steps.

    Breadth first: each round joins what was new in the last one, and only that, with the references; rounds are written,
    so a lost executor costs one.  A start that leads back to itself has itself at the depth of its shortest circle.
    """
    edges = written(references.select("src", F.col("dst").alias("citation")).distinct(), "citation-edges")
    frontier, found, depth = starts.filter("citation IS NOT NULL").select(F.col("citation").alias("start"), "citation").distinct(), None, 0
    while most_rounds is None or depth < most_rounds:
        depth += 1
        after = frontier.withColumnRenamed("citation", "src").join(edges, "src").select("start", "citation").distinct()
        if found is not None:
            after = after.join(found, ["start", "citation"], "left_anti")
        after = written(after.withColumn("depth", F.lit(depth)), "citation-round")
        found = after if found is None else found.unionByName(after)
        if after.isEmpty():
            break
        if depth % 16 == 0:  # keeps the plan short
            found = written(found, "citation-found")
        frontier = after.select("start", "citation")
    return found
