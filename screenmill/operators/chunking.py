"""Sections to chunks of bounded token counts.

What a section needs for itself (its paragraphs' bins, windows, overlaps) are column functions over the arrays of its own
row, in time that grows with its length: tokens are looked up by place, and folds keep short arrays.  Only small
neighbours have to meet.  Who meets whom is decided on narrow rows, sorted over all tasks (operators/runs.py), so a
document is never one task's work; only the texts of small sections that share a chunk are grouped, and a chunk is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenmill import schemas
from screenmill.functions import text as X
from screenmill.operators.runs import Rule, grouped, in_order, numbered
from screenmill.sources.io import written
from screenmill.vocab import MAX_TOKENS, MIN_TOKENS, OVERLAP_TOKENS, TARGET_TOKENS

SOURCE_FIELDS = [f.strip().split(" ")[0] for f in schemas.SOURCE.split(",")]
PIECE = "array<struct<text:string,subsection:string>>"


class Tokens:
    """A tokenizer as column functions: text to an array of tokens, and tokens to text.

    adds_up: texts joined by a space have as many tokens as all of them.
    """

    def __init__(self, split: Callable[[Column], Column] = X.tokens, glue: str = " ", adds_up: bool = True):
        self.split, self.glue, self.adds_up = split, glue, adds_up

    def count(self, text: Column) -> Column:
        return F.size(self.split(text))

    def text(self, tokens: Column) -> Column:
        return F.array_join(tokens, self.glue)

    def windows(self, tokens: Column, size: int, overlap: int, stop_at_end: bool) -> Column:
        """Texts of windows of size tokens; stop_at_end: none begins once a window has reached the last token."""
        return X.windows(tokens, size, overlap, stop_at_end, self.glue)


WORDS = Tokens()


#: Items of the inner folds of a scan: what is made so far is copied once for each.
SCAN_ITEMS = 256


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column], Column], kind: str) -> Column:
    """out(state) after each of the items, where step makes the next state from the state and the item.

    A fold within a fold: an array that grows by each item is copied each time, so it is kept short.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / SCAN_ITEMS) - 1, F.lit(0))), lambda b: F.slice(items, (b * SCAN_ITEMS + 1).cast("int"), SCAN_ITEMS))

    def one(acc: Column, item: Column) -> Column:
        return X.let(step(acc["state"], item), lambda s: F.struct(s.alias("state"), F.concat(acc["made"], F.array(out(s))).alias("made")))

    def block(acc: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("made")), one)
        return X.let(inner, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["made"], F.array(x["made"])).alias("made")))

    whole = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("made"))
    return F.aggregate(blocks, whole, block, lambda acc: F.flatten(acc["made"]))


def bins(weights: Column, most: int, limit: int) -> Column:
    """The bin of each of the weights, in order: one heavier than most is alone, the others share bins up to the limit."""

    def place(state: Column, weight: Column) -> Column:
        alone = weight > most
        opens = (state["bin"] < 0) | alone | (state["filled"] > most) | (state["filled"] + weight > limit)
        return F.struct(F.when(opens, state["bin"] + 1).otherwise(state["bin"]).alias("bin"), F.when(opens, weight).otherwise(state["filled"] + weight).alias("filled"))

    return scan(weights, F.struct(F.lit(-1).alias("bin"), F.lit(0).alias("filled")), place, lambda s: s["bin"], "int")


def binned(parts: Column, of: Column) -> Column:
    """The parts of each bin as an array of arrays; bins are neighbours."""

    def cut(of: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(of) - 1), lambda i: (i == 0) | (F.get(of, i) != F.get(of, i - 1)))
        return X.let(firsts, lambda f: F.transform(f, lambda low, k: X.span(parts, low, F.coalesce(F.get(f, k + 1), F.size(of)))))

    return X.let(of, cut)


def overlapped(pieces: Column, overlap: int, tokens: Tokens) -> Column:
    """Each piece behind the last tokens of the one before it, as it then is, if that has more than the overlap.

    With what it got, a piece still is a stretch of all pieces' tokens that ends where its own do, so what the next one
    gets is found by place; only its length has to be carried from piece to piece.
    """

    def added(own: Column) -> Column:
        sizes = F.transform(own, F.size)
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("held"))
        step = lambda s, n: F.struct((s["end"] + n).alias("end"), (n + F.when(s["held"] > overlap, overlap).otherwise(0)).alias("held"))
        states = scan(sizes, start, step, lambda s: s, "struct<end:int,held:int>")

        def behind(all_tokens: Column, states: Column) -> Column:
            before = lambda k: F.get(states, k - 1)
            tail = lambda k: tokens.text(X.span(all_tokens, before(k)["end"] - overlap, before(k)["end"]))
            text = lambda p, k: F.when((k > 0) & (before(k)["held"] > overlap), F.concat(tail(k), F.lit(" "), p["text"])).otherwise(p["text"])
            return F.transform(pieces, lambda p, k: F.struct(text(p, k).alias("text"), p["subsection"].alias("subsection")))

        return X.let(F.flatten(own), lambda t: X.let(states, lambda s: behind(t, s)))

    return X.let(F.transform(pieces, lambda p: tokens.split(p["text"])), added)


def named_windows(windows: Column) -> Column:
    return F.transform(windows, lambda t, k: F.struct(t.alias("text"), F.concat(F.lit("window-"), k.cast("string")).alias("subsection")))


def pieces_of(body: Column, most: int, target: int, overlap: int, tokens: Tokens) -> Column:
    """array of struct(text, subsection) of a section over the largest size: labelled paragraphs share bins, others are cut into windows."""

    def by_labels(parts: Column) -> Column:
        weights = F.transform(parts, lambda p: tokens.count(p["text"]))

        def made(group: Column) -> Column:
            own = lambda text: F.array(F.struct(text.alias("text"), X.subsection_label(F.transform(group, lambda p: p["label"])).alias("subsection")))
            cut = lambda text: X.let(tokens.split(text), lambda t: F.when(F.size(t) > most, named_windows(tokens.windows(t, target, overlap, False))).otherwise(own(text)))
            return X.let(F.array_join(F.transform(group, lambda p: p["text"]), " "), cut)

        return X.let(F.flatten(F.transform(binned(parts, bins(weights, most, target)), made)), lambda pieces: overlapped(pieces, overlap, tokens))

    whole = lambda: X.let(tokens.split(body), lambda t: named_windows(tokens.windows(t, target, overlap, False)))
    return X.let(X.labelled_paragraphs(body), lambda parts: F.when(F.size(parts) > 1, by_labels(parts)).otherwise(whole()))


def sibling_key(document_type: Column, part: Column, parent_statute: Column, statute_title: Column) -> Column:
    """Sections with one key may share a chunk; null for those that never do."""
    named = lambda *c: F.concat_ws("\x1f", document_type, *(F.coalesce(x, F.lit("")) for x in c))
    return F.when((document_type == "cfr_regulation") & ~part.eqNullSafe(F.lit("1508")), named(part)).when(document_type == "statute", named(parent_statute, statute_title)).when(document_type == "executive_order", named(parent_statute))


def chunk_regulation(sections: DataFrame, least: int = MIN_TOKENS, most: int = MAX_TOKENS, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS, tokens: Tokens = WORDS) -> DataFrame:
    """Chunks of regulation sections, in the order of their documents.

    A section over the largest size is split by itself; small neighbours with one sibling key share chunks.  Definitions
    are neither split nor merged.
    """
    body = X.trim_white(F.coalesce("body", F.lit("")))
    rows = sections.select("doc_id", "pos", F.struct(*SOURCE_FIELDS).alias("source"), body.alias("body"), X.is_definition(F.col("document_type"), F.col("part"), F.col("section")).alias("is_definition")).withColumn("n", tokens.count(F.col("body")))
    whole = F.array(F.struct(F.col("body").alias("text"), F.lit(None).cast("string").alias("subsection")))
    split = F.when(F.col("is_definition") | (F.col("n") <= most), whole).otherwise(pieces_of(F.col("body"), most, target, overlap, tokens))
    key = F.when(~F.col("is_definition"), sibling_key(*(F.col(f"source.{c}") for c in ("document_type", "part", "parent_statute", "statute_title"))))
    # outer: else a filter that no array is empty is put before all this, and computes the pieces once more
    cut = rows.select("doc_id", "pos", "source", "is_definition", "n", X.has_table(F.col("body")).alias("has_table"), key.alias("key"), split.alias("pieces"))
    items = cut.select("*", F.size("pieces").alias("total"), F.posexplode_outer("pieces").alias("index", "piece")).drop("pieces").withColumn("n", F.when(F.col("total") == 1, F.col("n")).otherwise(tokens.count(F.col("piece.text"))))
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "chunk-items")
    marks = chunk_marks(items.select("doc_id", "pos", "index", "item", "n", "key", (F.col("total") == 1).alias("solo")), least, most)
    # each piece's text meets the number of its chunk; only those that share one meet each other
    fields = F.struct("pos", "index", "n", "total", "source", "piece", "has_table", "is_definition")
    met = items.join(marks, "item").select("doc_id", "chunk_no", "pieces", fields.alias("x"))
    alone = met.filter("pieces = 1").select(
        "doc_id", "chunk_no", F.array("x.source").alias("sources"), F.col("x.piece.text").alias("body"), F.col("x.piece.subsection").alias("subsection"), F.col("x.index").alias("chunk_index"), F.col("x.total").alias("total_chunks_in_section"),
        F.col("x.has_table").alias("has_table"), F.col("x.is_definition").alias("is_definition"), F.lit(False).alias("is_merged_siblings"), F.col("x.n").alias("token_count"),
    )
    shared = met.filter("pieces > 1").groupBy("doc_id", "chunk_no").agg(F.sort_array(F.collect_list("x")).alias("own"))
    text = F.trim(F.array_join(F.transform("own", lambda x: x["piece"]["text"]), " "))
    shared = shared.select(
        "doc_id", "chunk_no", F.transform("own", lambda x: x["source"]).alias("sources"), text.alias("body"), F.lit(None).cast("string").alias("subsection"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks_in_section"),
        F.exists("own", lambda x: x["has_table"]).alias("has_table"), F.element_at("own", 1)["is_definition"].alias("is_definition"), F.lit(True).alias("is_merged_siblings"), F.aggregate("own", F.lit(0), lambda a, x: a + x["n"]).alias("token_count"),
    )
    if not tokens.adds_up:
        shared = shared.withColumn("token_count", tokens.count(F.col("body")))
    return alone.unionByName(shared)


def chunk_marks(items: DataFrame, least: int, most: int) -> DataFrame:
    """item, chunk_no and pieces, how many the chunk has, of pieces (doc_id, pos, index, item, n, key, solo: a whole section).

    A chunk that begins with a small whole section takes the whole sections that follow, while it or the next is small
    and the sum isn't too large; then a small piece that stays alone goes to the chunk before it, if the sum isn't too
    large.  Both passes are greedy groupings of sorted rows; the groups of the first are the rows of the second.
    """
    rule = Rule(least, most)
    placed = in_order(items, ["doc_id", "pos", "index", "item"])
    rows = placed.select("*", F.col("solo").alias("may"), (F.col("solo") & (F.col("n") < least)).alias("opens"))
    first = written(placed.select("item", "at", "doc_id", "key", "n").join(grouped(rows, rule), "at"), "chunk-groups")
    own = F.min_by(F.struct("doc_id", "key"), "at").alias("own")
    units = first.groupBy(F.col("begin").alias("at")).agg(own, F.sum("n").cast("int").alias("n"), F.count(F.lit(1)).alias("pieces"))
    units = units.select("at", F.shiftright("at", 33).cast("int").alias("task"), "own.doc_id", "own.key", "n", "pieces", ((F.col("pieces") == 1) & (F.col("n") < least)).alias("may"), (F.col("n") <= most).alias("opens"))
    units = written(units, "chunk-units")
    joined = units.select("at", "doc_id", "pieces").join(grouped(units, rule).withColumnRenamed("begin", "chunk"), "at")
    chunks = numbered(joined.groupBy(F.col("chunk").alias("at")).agg(F.min("doc_id").alias("doc_id"), F.sum("pieces").alias("pieces")))
    of = joined.select(F.col("at").alias("begin"), "chunk").join(chunks.select(F.col("at").alias("chunk"), F.col("number").alias("chunk_no"), "pieces"), "chunk")
    return first.select("item", "begin").join(of, "begin").select("item", "chunk_no", "pieces")


def chunk_report(sections: DataFrame, most: int = MAX_TOKENS, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS, tokens: Tokens = WORDS) -> DataFrame:
    """Chunks of report sections: paragraphs share bins up to the largest size, longer ones are cut into windows."""

    def slices(parts: Column) -> Column:
        weights = F.transform(parts, tokens.count)
        cut = lambda text: X.let(tokens.split(text), lambda t: F.when(F.size(t) > most, tokens.windows(t, target, overlap, True)).otherwise(F.array(text)))
        return F.flatten(F.transform(binned(parts, bins(weights, most, most)), lambda group: X.let(F.array_join(group, "\n\n"), cut)))

    cut = F.when(tokens.count(F.col("body")) <= most, F.array("body")).otherwise(X.let(X.paragraphs(F.col("body")), slices))
    made = sections.withColumn("slices", cut).select("*", F.size("slices").alias("total_chunks_in_section"), F.posexplode_outer("slices").alias("chunk_index", "content"))
    return made.drop("slices", "body").withColumn("has_table", F.col("has_table_hint") | X.has_table(F.col("content"))).withColumn("token_count", tokens.count(F.col("content")))


def chunk_generic(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_index and content of token windows over plain documents."""
    made = docs.select("doc_id", F.posexplode_outer(X.token_windows(F.coalesce("text", F.lit("")), size, overlap, True)).alias("chunk_index", "content"))
    return made.filter("chunk_index IS NOT NULL")


def build_metadata(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """The typed metadata of chunks of regulation documents, with what is known of their source file."""
    first = F.element_at("sources", 1)
    named = lambda c: F.array_distinct(F.transform("sources", lambda s: s[c]))
    body = F.col("body")
    path = X.breadcrumb(F.col("sources"), F.col("subsection"), F.col("is_definition"))
    made = chunks.select(
        "doc_id", "chunk_no", *(first[c].alias(c) for c in SOURCE_FIELDS if c != "pages"), named("citation").alias("all_citations"), named("section").alias("all_sections"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("sources", lambda s: F.coalesce(s["pages"], F.array().cast("array<int>")))))).alias("page_numbers"),
        X.cross_references(body, first["citation"]).alias("cross_references"), path.alias("breadcrumb"), "subsection", "chunk_index", "total_chunks_in_section", "has_table", "is_definition", "is_merged_siblings", "token_count",
        X.embedding_text(path, body).alias("embedding_text"), "body",
    )
    known = sources.select("doc_id", F.col("id").alias("source_id"), "filename", "sha256", "is_current", "project_id")
    return made.join(known, "doc_id", "left").withColumn("chunk_id", F.sha2(F.concat_ws("\x1f", F.coalesce("source_id", F.lit("")), "citation", F.col("chunk_index").cast("string"), F.coalesce("subsection", F.lit(""))), 256))


def chunk_summary(chunks: DataFrame, key: str = "document_type") -> DataFrame:
    """Per document type (or part, where a chunk has one): chunks, split, merged and defining ones, and token counts with the exclusive 95th percentile.

    Exact without sorting all rows: token counts are few different values, so cumulated numbers of them do.
    """
    by = chunks.select(F.element_at("sources", 1)[key].alias(key), "token_count", "total_chunks_in_section", "is_merged_siblings", "is_definition").filter(F.col(key).isNotNull())
    flags = by.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("total_chunks_in_section") > 1).alias("n_split"), F.count_if("is_merged_siblings").alias("n_merged"), F.count_if("is_definition").alias("n_definitions"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.avg("token_count").alias("mean_tokens"))
    return flags.join(exclusive_p95(by, key, "token_count"), key)


def exclusive_p95(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, median and p95: the 19th of 20 exclusive quantiles, truncated; the largest value below 20 rows."""
    from pyspark.sql import Window

    counts = df.groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("k").orderBy("v")
    ranked = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("k")))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("v")))
    n = F.col("n")
    made = ranked.withColumn("j", F.least(F.greatest(F.floor(19 * (n + 1) / 20), F.lit(1)), n - 1)).withColumn("d", 19 * (n + 1) - 20 * F.col("j"))
    median = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    p95 = F.floor((at(F.col("j")) * (20 - F.max("d")) + at(F.col("j") + 1) * F.max("d")) / 20)
    return made.groupBy(F.col("k").alias(key)).agg(median.alias("median_tokens"), F.when(F.max("n") < 20, F.max("v")).otherwise(p95).cast("int").alias("p95_tokens"))


def runts(chunks: DataFrame, least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> DataFrame:
    """Chunks over the largest size, and small ones that are no definitions."""
    kind = F.when(F.col("token_count") > most, "oversize").when((F.col("token_count") < least) & ~F.col("is_definition"), "runt")
    return chunks.withColumn("problem", kind).filter("problem IS NOT NULL")
