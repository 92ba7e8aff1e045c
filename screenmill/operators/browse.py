"""Listing and paging of tables, composition of the corpus, filters of searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = ("part", "document_type", "statute", "section", "agency", "jurisdiction", "source", "is_current", "is_definition")


def page_of(df: DataFrame, order: list, page: int = 1, per_page: int = 25, max_per_page: int = 200) -> DataFrame:
    """One page in the order; sizes are clamped to 1..max_per_page, pages to 1 and more."""
    size = min(max(per_page, 1), max_per_page)
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def page_info(df: DataFrame, per_page: int = 25, max_per_page: int = 200) -> DataFrame:
    size = min(max(per_page, 1), max_per_page)
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(size).alias("per_page"), F.ceil(F.col("total") / size).alias("total_pages"))


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    rows = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Chunks per source and currency, the largest first, with the total."""
    by = chunks.groupBy("source", "is_current").agg(F.count(F.lit(1)).alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).orderBy(F.desc("n"), "source", "is_current")


def chunk_counts(chunks: DataFrame, key: str | None = None) -> DataFrame:
    return chunks.groupBy(*([key] if key else [])).agg(F.count(F.lit(1)).alias("n"))


def filtered(chunks: DataFrame, filters: dict) -> DataFrame:
    """Equality on a fixed list of columns; None values are skipped, other names raise."""
    for name, value in filters.items():
        if name not in FILTERS:
            raise ValueError(f"unknown filter {name!r}; known: {', '.join(FILTERS)}")
        if value is not None:
            chunks = chunks.filter(F.col(name) == value)
    return chunks


def source_scopes(projects: DataFrame, sources: DataFrame) -> DataFrame:
    """project_id, source_ids (its own ready sources, in order) and sees_all, true where it has none and so sees every ready source.

    A search of a project that sees all needs no filter: the sources need not be listed for it.
    """
    own = sources.filter("status = 'ready' AND project_id IS NOT NULL").groupBy("project_id").agg(F.sort_array(F.collect_list("id")).alias("source_ids"))
    named = projects.select("project_id").join(own, "project_id", "left")
    return named.select("project_id", F.coalesce("source_ids", F.array().cast(own.schema["source_ids"].dataType)).alias("source_ids"), F.col("source_ids").isNull().alias("sees_all"))


def scoped_sources(projects: DataFrame, sources: DataFrame) -> DataFrame:
    """project_id and source_id: the scopes as pairs, for listings of few projects; searches take source_scopes."""
    ready = sources.filter("status = 'ready'").select(F.col("id").alias("source_id"))
    scopes = source_scopes(projects, sources)
    own = scopes.filter("NOT sees_all").select("project_id", F.explode("source_ids").alias("source_id"))
    # one row with all ready sources meets the projects that see them; it is as long as the listing asked for
    every = ready.groupBy(F.lit(True).alias("sees_all")).agg(F.collect_list("source_id").alias("all_ids"))
    return own.unionByName(scopes.join(every, "sees_all").select("project_id", F.explode("all_ids").alias("source_id")))


def listing(df: DataFrame, ready_only: bool = False, project_id=None, newest: str = "uploaded_at") -> DataFrame:
    """Rows newest first, without the content column."""
    if ready_only:
        df = df.filter("status = 'ready'")
    if project_id is not None:
        df = df.filter(F.col("project_id") == project_id)
    return df.drop("blob").orderBy(F.desc(newest), F.desc("id"))


def document_order(chunks: DataFrame) -> DataFrame:
    """By chapter as a number (none: 0), section as text, chunk."""
    return chunks.orderBy(F.coalesce(F.expr("try_cast(chapter AS int)"), F.lit(0)), F.asc_nulls_last("section_number"), F.asc_nulls_last("chunk_index"))


def lifted(chunks: DataFrame) -> DataFrame:
    """Citation, breadcrumb and token count out of metadata, and whether there is a vector."""
    return chunks.select("id", "content", *(F.col("metadata")[c].alias(c) for c in ("citation", "breadcrumb", "token_count")), F.col("embedding").isNotNull().alias("embedded"))


def latest_version(versions: DataFrame) -> DataFrame:
    """Latest amendment date, or issue date where there is none; null without versions."""
    return versions.agg(F.max(F.coalesce(F.nullif("amendment_date", F.lit("")), F.nullif("date", F.lit("")))).alias("current_date"))


def restricted(chunks: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """The chunks of a set of sources or evaluations."""
    return chunks.join(sources.select(key).distinct(), key, "left_semi").select(chunks.columns)
