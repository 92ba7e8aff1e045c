"""URL filtering by a temporal join with dated lists (DataFrame functions only).

A list is a log of dated changes: on `day` an `entry` (a host, standing for all its subdomains, or a host with a path
prefix) is added to or removed from a `category`.  The changes of an entry become validity intervals [from, to): an add
opens one, the next removal closes it.  A capture is looked up by its host, its host's parent domains and its path
prefixes, and the entries that were active on the day of its fetch decide: an as-of join on an equality of keys with a
comparison of dates.  The page's content is never shuffled, only keys; equal captures are looked up once.  Keys that a
large share of all look-ups have, as those of a host with a third of all captures, are dealt to many tasks, to which
their entries alone are copied.

Hosts are compared without case and without a dot at their end; an address (IPv4, or IPv6 in brackets) has no parent
domains.  Rows: a null or unparsable URL or a null day matches nothing and is allowed; every capture yields one row; of
changes on one day a removal counts after an add; repeated changes count once; an empty list allows all; other columns are
ignored.  Of an entry the scheme, `*.`, the port, blanks around it and slashes at its end are dropped; one without a host
or with a query takes no effect, and rejected_entries() lists such with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with more than this share of all look-ups is dealt to several tasks; so there are at most as many such keys.
HOT_KEYS, LEAST_SPLIT = 4096, 1000


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1)
    return F.regexp_replace(F.lower(host), r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)


def lookup_keys(host: Column, path: Column, deepest: Column) -> Column:
    """The host, its parent domains of at least two labels, and the host with each prefix of the path that ends a part.

    deepest: the most parts that a prefix of an entry has; longer ones can't match and aren't built.
    """
    address = host.rlike(r"^(?:\[.*\]|[0-9]+(?:\.[0-9]+){3})$")
    labels = F.when(address, F.array(host)).otherwise(F.split(host, r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    most = F.least(F.size(parts), deepest)
    prefixes = F.when(most > 0, F.transform(F.sequence(F.lit(1), most), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


#: An entry: a scheme, `*.` and a port are allowed and say nothing more than the host does.
ENTRY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://|(?![A-Za-z][A-Za-z0-9+.-]*://))(?:\*?\.)?(\[[^\]/?#@]*\]|[^/?#:@*\[\]]+?)\.?(?::[0-9]*)?(?:/([^?#]*))?$"


def entry_of(entry: Column) -> Column:
    """The host in lower case, with the parts of the path that aren't empty; null if the entry is none."""
    text = F.trim(entry)
    host = F.lower(F.regexp_extract(text, ENTRY, 1))
    return F.when(host != "", F.array_join(F.concat(F.array(host), F.filter(F.split(F.regexp_extract(text, ENTRY, 2), "/"), lambda x: x != "")), "/"))


def rejected_entries(changes: DataFrame) -> DataFrame:
    """The changes of a log that can't take effect, with a reason."""
    reason = (
        F.when(F.coalesce(F.trim("entry"), F.lit("")) == "", "no entry")
        .when(F.col("day").isNull(), "no day")
        .when(F.col("entry").rlike(r"[?#]"), "a query or fragment, which no look-up has")
        .when(entry_of(F.col("entry")).isNull(), "no host")
    )
    return changes.withColumn("reject_reason", reason).filter("reject_reason IS NOT NULL")


def intervals(changes: DataFrame) -> DataFrame:
    """entry, category, valid_from, valid_to (null: still active) of a log of changes (entry, category, day, action)."""
    # hosts are the same in either case, paths are not
    log = changes.select(entry_of(F.col("entry")).alias("entry"), "category", "day", "action").filter("entry IS NOT NULL AND day IS NOT NULL").groupBy("entry", F.coalesce("category", F.lit("")).alias("category"), "day").agg(F.min((F.col("action") == "add").cast("int")).alias("adds"))
    w = Window.partitionBy("entry", "category").orderBy("day")
    state = log.withColumn("before", F.lag("adds").over(w)).filter("before IS NULL OR before <> adds")
    state = state.withColumn("valid_to", F.lead("day").over(w))
    return state.filter("adds = 1").select("entry", "category", F.col("day").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """The captures (page_id, url, fetched_on) with n_entries, category and blocked as of the day of the fetch.

    category is the first in alphabetical order of those active, null if none.
    """
    rows = captures.select("page_id", "url", "fetched_on")
    # what decides is the URL and the day, so equal captures are looked up once
    asked = rows.filter("url IS NOT NULL AND fetched_on IS NOT NULL").select("url", "fetched_on").distinct()
    deepest = changes.agg(F.coalesce(F.max(F.size(F.split(entry_of(F.col("entry")), "/")) - 1), F.lit(0)).alias("deepest"))
    url = F.trim("url")
    keys = asked.crossJoin(F.broadcast(deepest)).select("url", "fetched_on", F.explode_outer(lookup_keys(host_of(url), path_of(url), F.col("deepest"))).alias("entry")).filter("entry IS NOT NULL")
    # where a key is hot, its look-ups are dealt to parts and its entries copied to each; the list of such keys is bounded
    totals = keys.groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    share = totals.agg(F.greatest(F.ceil(F.sum("n") / HOT_KEYS), F.lit(LEAST_SPLIT)).alias("most"))
    hot = F.broadcast(totals.crossJoin(F.broadcast(share)).filter("n > most").select("entry", F.ceil(F.col("n") / F.col("most")).cast("int").alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("url", "fetched_on"), F.col("parts")).cast("int"), F.lit(0))
    dealt = keys.join(hot, "entry", "left").select("url", "fetched_on", "entry", part.alias("part"))
    active = intervals(changes).join(hot, "entry", "left").select("entry", "category", "valid_from", "valid_to", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    hits = (
        dealt.join(active, ["entry", "part"])
        .filter("fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to)")
        .groupBy("url", "fetched_on")
        .agg(F.count(F.lit(1)).alias("n_entries"), F.min("category").alias("category"))
    )
    return rows.join(hits, ["url", "fetched_on"], "left").select("page_id", "url", "fetched_on", F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), "category", F.col("n_entries").isNotNull().alias("blocked"))
