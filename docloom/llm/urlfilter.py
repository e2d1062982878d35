"""URL filters as of the time of a fetch; DataFrame functions only.

List entries are dated: one adds a pattern to the list, a later one removes it. They become validity intervals,
and each capture is joined with the entries that were active when it was fetched. A pattern is a domain, which
covers its subdomains, or a host with the first segments of a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import written
from docloom.llm.decontaminate import _may_hit

#: Up to so many intervals (of about 100 bytes) the list is broadcast; beyond, it is joined by a shuffle.
MAX_BROADCAST = 500_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dot; empty if the URL has none."""
    return F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::\d*)?(?:[/?#]|\s*$)", 1)


def path_of(url: Column) -> Column:
    """Path as it stands in the URL, without query, fragment and the slashes around it."""
    return F.regexp_replace(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/++([^?#]*)", 1), r"(?<!/)/++\s*+$", "")


def patterns_of(host: Column, path: Column, labels: int, segments: int) -> Column:
    """Every pattern of a list that could cover a URL: each suffix of its host of up to `labels` labels, and the host with each beginning of its path of up to `segments` segments.

    With the list's own largest numbers nothing is left out, and the work on a URL doesn't grow with the square of its length.
    """
    ends, starts = F.split(F.substring_index(host, ".", -labels), r"\."), F.slice(F.split(path, "/+", segments + 1), 1, max(1, segments))
    domains = F.transform(F.sequence(F.lit(1), F.size(ends)), lambda k: F.array_join(F.slice(ends, k, F.size(ends)), "."))
    places = F.transform(F.sequence(F.lit(1), F.size(starts)), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(starts, 1, k), "/")))
    none = F.array().cast("array<string>")
    by_domain = F.when(host != "", domains).otherwise(none) if labels else none
    by_place = F.when((host != "") & (path != ""), places).otherwise(none) if segments else none
    return F.array_distinct(F.concat(by_domain, by_place))


def intervals(entries: DataFrame) -> DataFrame:
    """entries (pattern, action 'add' or 'remove', at timestamp) -> (pattern, active_from, active_to), to excluded, null if open.

    Of entries of one pattern at one time a removal counts. Adding what is listed and removing what isn't change
    nothing. Entries with a null pattern, time or another action are left out. Patterns lose slashes and dots
    around them; their host is lower-cased.
    """
    clean = F.regexp_replace(F.trim("pattern"), r"^[./]+|[./]+$", "")
    host = F.lower(F.regexp_extract(clean, r"^[^/]*", 0))
    rows = entries.where("at is not null and action in ('add', 'remove')").select(F.concat(host, F.regexp_replace(clean, r"^[^/]*", "")).alias("pattern"), "action", "at").where("pattern is not null and pattern <> ''")
    rows = rows.groupBy("pattern", "at").agg(F.max(F.col("action") == "remove").alias("removed"))
    order = Window.partitionBy("pattern").orderBy("at")
    changes = rows.withColumn("before", F.lag("removed", 1, True).over(order)).where("removed <> before")
    return changes.withColumn("active_to", F.lead("at").over(order)).where("not removed").select("pattern", F.col("at").alias("active_from"), "active_to")


def filtered(captures: DataFrame, entries: DataFrame, fetched: Column, id_col: str = "page_id", url_col: str = "url", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(page_id, host, fetched_at, blocked, pattern, listed_at, n_patterns): one row per row of captures.

    n_patterns counts the entries that cover the URL and were active at `fetched`; pattern is the longest of them
    (no two have one length) and listed_at when it was added. A capture with a null or hostless URL or no
    time isn't blocked. Repeated rows are all kept. An empty list blocks nothing; an empty table gives an empty
    result. Other columns are not read.
    """
    url = F.coalesce(captures[url_col], F.lit(""))
    rows = captures.select(captures[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), fetched.alias("fetched_at"), F.monotonically_increasing_id().alias("row"))
    active = intervals(entries)
    parts = F.size(F.split("pattern", r"[./]"))
    place = F.col("pattern").contains("/")
    segments = F.size(F.split("pattern", "/")) - 1
    of = active.agg(F.count("*").alias("n"), F.max(F.when(~place, parts)).alias("labels"), F.max(F.when(place, segments)).alias("segments")).first()
    patterns = patterns_of(F.col("host"), F.col("path"), of.labels or 0, of.segments or 0)
    few = of.n <= max_broadcast
    if not few:
        rows, active = written(rows, "captures"), written(active, "active")  # rows are joined again below, by numbers that must not change
    keys = rows.select("row", *(["page_id", "host"] if few else []), "fetched_at", (F.explode_outer if few else F.explode)(patterns).alias("key"))
    if not few:  # most keys, such as the last label of a host, are in no list, and aren't shuffled
        keys = _may_hit(keys.withColumn("seed", F.xxhash64("key")), active.select(F.xxhash64("pattern").alias("seed"))).drop("seed")
    covers = (keys.key == active.pattern) & (keys.fetched_at >= active.active_from) & (active.active_to.isNull() | (keys.fetched_at < active.active_to))
    joined = keys.join(F.broadcast(active), covers, "left") if few else keys.join(active, covers)
    # the keys of a row are side by side, so partial aggregation leaves one row of each before the shuffle
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), "pattern", "active_from"))).alias("best")
    own = [F.first(c).alias(c) for c in ("page_id", "host", "fetched_at")] if few else []
    found = joined.groupBy("row").agg(*own, F.count("pattern").alias("n_patterns"), best)
    if not few:
        found = rows.join(found, "row", "left").withColumn("n_patterns", F.coalesce("n_patterns", F.lit(0)))
    return found.select("page_id", "host", "fetched_at", (F.col("n_patterns") > 0).alias("blocked"), "best.pattern", F.col("best.active_from").alias("listed_at"), "n_patterns")
