"""URL filters by dated lists: entries become validity intervals, and an as-of join evaluates every capture.

An entry says that a list adds or removes a pattern at some time. Per list and pattern, the entries in order of time give
intervals [valid_from, valid_to) in which the pattern is active. A capture is evaluated against what was active when it was
fetched, not against today's list. Patterns are of three kinds:

* ``host``: this host only;
* ``domain``: this host and all hosts below it;
* ``prefix``: host and path segments, and everything below.

A capture is exploded into the keys that could match it, and an equi-join on kind and key with the interval as condition does the
rest. Keys of a hot host are salted, the (much smaller) lists carry every salt. All of it is DataFrame functions.

Edge cases
----------
* null or malformed url (no ``scheme://host``): no host, no keys, never blocked; null fetch time: no entry is active;
* scheme, user, port, a final dot of the host and upper case do not matter for hosts; paths match as written;
* several entries of one pattern at one time: ``add`` wins; entries that repeat the state before change nothing;
* null list, pattern, action or time: the entry is ignored; an action other than add or remove and a kind other than the three too;
* repeated captures: each is returned; empty lists leave all unblocked; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute url; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", ""))
    return F.when(host != "", host)


def segments_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, valid_from, valid_to) from (list, kind, pattern, action, at); valid_to is null while active."""
    key = F.when(F.col("kind") == "prefix", F.concat(F.lower(F.regexp_extract("pattern", r"^([^/]*)", 1)), F.regexp_replace(F.regexp_extract("pattern", r"^[^/]*(.*)$", 1), r"/+$", "")))
    key = key.otherwise(F.lower(F.regexp_replace("pattern", r"\.+$", "")))
    entries = entries.select("list", "kind", key.alias("key"), "action", "at").dropna().filter(F.col("action").isin("add", "remove"))
    states = entries.groupBy("list", "kind", "key", "at").agg(F.max((F.col("action") == "add")).alias("on"))
    by_time = Window.partitionBy("list", "kind", "key").orderBy("at")
    changes = states.withColumn("before", F.coalesce(F.lag("on").over(by_time), F.lit(False))).filter("`on` <> before")
    return changes.withColumn("valid_to", F.lead("at").over(by_time)).filter("`on`").select("list", "kind", "key", F.col("at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """(id_col, url_col, host, time_col, n_entries, lists, blocked) of every capture; lists are the names of those with an active entry, sorted."""
    active = intervals(entries)
    depth = active.filter("kind = 'prefix'").agg(F.max(F.size(F.split("key", "/"))).alias("d")).first()["d"] or 1
    captures = captures.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{time_col}`").alias("time"))
    captures = captures.select("*", host_of(F.col("url")).alias("host"))

    labels, segments = F.split("host", r"\."), segments_of(F.col("url"))
    above = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice("labels", i, F.size("labels")), ".").alias("key")))
    below = F.transform(F.sequence(F.lit(0), F.least(F.size("segments"), F.lit(depth - 1))), lambda i: F.struct(F.lit("prefix").alias("kind"), F.array_join(F.concat(F.array("host"), F.slice("segments", F.lit(1), i)), "/").alias("key")))
    exact = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("key")))
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).alias("salt")
    keys = captures.filter("host is not null and time is not null").distinct().select("id", "url", "time", salt, labels.alias("labels"), segments.alias("segments"), "host")
    keys = keys.select("id", "url", "time", "salt", F.explode(F.concat(above, exact, below)).alias("k")).select("id", "url", "time", "salt", "k.kind", "k.key")
    salted = active.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = keys.join(salted, ["kind", "key", "salt"]).filter((F.col("valid_from") <= F.col("time")) & (F.col("valid_to").isNull() | (F.col("time") < F.col("valid_to"))))
    found = met.groupBy("id", "url", "time").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("list")).alias("lists"))
    found = found.select(F.col("id").alias("i"), F.col("url").alias("u"), F.col("time").alias("t"), "n", "lists")
    out = captures.join(found, (F.col("id").eqNullSafe(F.col("i"))) & (F.col("url") == F.col("u")) & (F.col("time") == F.col("t")), "left")
    n = F.coalesce("n", F.lit(0)).alias("n_entries")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", F.col("time").alias(time_col), n, F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), F.col("n").isNotNull().alias("blocked"))
