"""Quality rules as a short-circuit cascade (DataFrame functions only).

Every rule is a test of a document's measures.  On a sample each rule's cost is timed, against a job that tests nothing,
and one job counts which rules reject together.  The order is greedy: next comes the rule with most rejections per cost
among the documents that the rules before it leave.  In that order the first rule that rejects ends the work on a
document: measures that only later rules need are never computed for it.  The order changes the cost, never the verdict.

Words are runs of characters other than the six ASCII white-space characters.  Rows: a null text counts as empty and has
no words (so `too_few_words` rejects it); every row yields one row; other columns are ignored; an empty table yields an
empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, keyed_texts, whole_text

WHITE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
NGRAM = 5


def let(value: Column, use) -> Column:
    """use(value) with the value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([^{WHITE}]+)"), F.lit(1))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words in windows of NGRAM words of which the text has two or more."""

    def count(words: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(words) - (NGRAM - 1)), lambda k: F.xxhash64(F.slice(words, k, NGRAM)))
        found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        return F.when(F.size(words) > NGRAM, found).otherwise(F.lit(0))

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def repeated(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            twice = F.filter(s, lambda e, i: F.coalesce(same(i, i + 1), F.lit(False)) | F.coalesce(same(i, i - 1), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda e: e["k"]))

        # each window adds the words that the one before it has not covered
        start = F.struct(F.lit(0).alias("n"), F.lit(-NGRAM).alias("at"))
        step = lambda acc, k: F.struct((acc["n"] + F.least(F.lit(NGRAM), k - acc["at"])).alias("n"), k.alias("at"))
        return F.aggregate(let(ranked, repeated), start, step, lambda acc: acc["n"])

    return let(words, count).cast("long")


def lines_of(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))


#: The measures that rules may need, by the text and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)),
    "n_symbols": lambda text, words: n_symbols(text),
    "n_dup_lines": lambda text, words: n_dup_lines(text),
    "n_repeat_words": lambda text, words: n_repeat_words(words),
    "n_digits": lambda text, words: F.regexp_count(text, F.lit("[0-9]")).cast("long"),
    "n_lines": lambda text, words: F.size(lines_of(text)).cast("long"),
    "n_cut_lines": lambda text, words: F.size(F.filter(lines_of(text), lambda x: x.rlike(f"(?:\\.\\.\\.|…)[{WHITE}]*$"))).cast("long"),
    "n_bullets": lambda text, words: F.size(F.filter(lines_of(text), lambda x: x.rlike(f"^[{WHITE}]*[-*•]\\x20"))).cast("long"),
}
#: Those that every row shows.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects a document if the test of its measures holds; needs: the measures that it reads."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Column], Column]


#: The base rules of the contract, then the method's own.
BASE = (
    Rule("too_few_words", ("n_words",), lambda m: m["n_words"] < 10),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 20),
)
RULES = (
    Rule("symbols", ("n_words", "n_symbols"), lambda m: m["n_symbols"] * 10 > m["n_words"]),
    Rule("repeated_lines", ("n_words", "n_dup_lines"), lambda m: m["n_dup_lines"] * 5 > m["n_words"]),
    Rule("short_words", ("n_words", "word_chars"), lambda m: m["word_chars"] < m["n_words"] * 2),
    Rule("long_words", ("n_words", "word_chars"), lambda m: m["word_chars"] > m["n_words"] * 20),
    Rule("digits", ("word_chars", "n_digits"), lambda m: m["n_digits"] * 2 > m["word_chars"]),
    Rule("cut_lines", ("n_lines", "n_cut_lines"), lambda m: m["n_cut_lines"] * 2 > m["n_lines"]),
    Rule("bullets", ("n_lines", "n_bullets"), lambda m: m["n_bullets"] * 10 > m["n_lines"] * 9),
)


def test_of(rule: Rule, text: Column, words: Column, ready: tuple[str, ...] = ()) -> Column:
    """Whether the rule rejects; ready: measures that are columns already, the others are computed where the test is."""
    needed = F.struct(*((F.col(k) if k in ready else MEASURES[k](text, words)).alias(k) for k in rule.needs))
    return let(needed, rule.rejects)


def cascade(order: tuple[Rule, ...] | list[Rule], text: Column, words: Column, ready: tuple[str, ...] = ()) -> Column:
    """Name of the first rule that rejects, null if none does: branches of a condition, so later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(order):
        out = F.when(test_of(rule, text, words, ready), F.lit(rule.name)).otherwise(out)
    return out


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the text, its words and the measures that every row shows."""
    cut = keyed_texts(docs).select("doc_id", "text", words_of(F.col("text")).alias("words"))
    return cut.select("doc_id", "text", "words", *(MEASURES[k](F.col("text"), F.col("words")).alias(k) for k in SHOWN))


def ranked_rules(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, sample_rows: int = 2000) -> list[tuple[Rule, float, float]]:
    """The rules in greedy order, each with the share that it rejects of what is left and its seconds, on about sample_rows rows."""
    n = docs.count()
    # the sample is a bounded table that is read again and again; it only sets the order of the rules
    text, words = F.col("text"), F.col("words")
    drawn = keyed_texts(docs).sample(min(1.0, sample_rows / max(n, 1)), 7)
    sample = drawn.select("text", words_of(text).alias("words")).coalesce(1).persist()

    def seconds(test: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            sample.select(F.count_if(test)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    try:
        patterns = [(r["count"], [r[f"r{k}"] for k in range(len(rules))]) for r in sample.groupBy(*(test_of(rule, text, words).alias(f"r{k}") for k, rule in enumerate(rules))).count().collect()]
        nothing = seconds(F.size(words) < 0)
        cost = [max(seconds(test_of(rule, text, words)) - nothing, 1e-4) for rule in rules]
    finally:
        sample.unpersist()
    out, left = [], list(range(len(rules)))
    while left:
        total = max(1, sum(c for c, _ in patterns))
        gain = {k: sum(c for c, hit in patterns if hit[k]) / total for k in left}
        best = min(left, key=lambda k: (-gain[k] / cost[k], rules[k].name))
        out.append((rules[best], gain[best], cost[best]))
        patterns = [(c, hit) for c, hit in patterns if not hit[best]]
        left.remove(best)
    return out


def quality(docs: DataFrame, order: list[Rule] | None = None) -> DataFrame:
    """The shown measures with base_failed and kept; the order of the rules is estimated if not given.

    base_failed is due for every row, so the base rules come first; the method's own follow as a cascade.
    """
    order = order if order is not None else [r for r, _, _ in ranked_rules(docs, RULES)]
    own = [r for r in order if r not in BASE]
    row = F.struct(*SHOWN)
    base = BASE[0].rejects(row) | BASE[1].rejects(row)
    judged = measures(docs).withColumn("base_failed", base)
    kept = F.when(F.col("base_failed"), False).otherwise(cascade(own, F.col("text"), F.col("words"), SHOWN).isNull())
    return judged.select("doc_id", *SHOWN, "base_failed", kept.alias("kept"))


def filter_quality(docs: DataFrame, order: list[Rule] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects; here the cascade spares all measures that a rejected document doesn't need."""
    order = order if order is not None else [r for r, _, _ in ranked_rules(docs)]
    # the rows are one column, so that theirs may have any names
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), whole_text().alias("text")).withColumn("words", words_of(F.col("text")))
    return rows.filter(cascade(order, F.col("text"), F.col("words")).isNull()).select("row.*")


QUALITY_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
g AS (SELECT r, unnest(range(1, len(words) - 3)) AS k, words FROM w WHERE len(words) >= 5),
h AS (SELECT r, k, words[k : k + 4] AS win FROM g),
c AS (SELECT r, k, count(*) OVER (PARTITION BY r, win) AS n FROM h),
p AS (SELECT r, k, k - lag(k, 1, -5) OVER (PARTITION BY r ORDER BY k) AS gap FROM c WHERE n > 1),
d AS (SELECT r, sum(least(5, gap)) AS n_repeat_words FROM p GROUP BY r),
m AS (SELECT w.r, doc_id, text, len(words) AS n_words, list_sum(list_transform(words, lambda x: length(x))) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
a AS (SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '[0-9]')) AS n_digits, len(lines) AS n_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]\x20'))) AS n_bullets FROM m LEFT JOIN d USING (r))
SELECT * EXCLUDE (n_digits, n_lines, n_cut_lines, n_bullets), (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (10 * n_symbols > n_words OR 5 * n_dup_lines > n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_digits > word_chars OR 2 * n_cut_lines > n_lines OR 10 * n_bullets > 9 * n_lines) AS kept
FROM a
"""
