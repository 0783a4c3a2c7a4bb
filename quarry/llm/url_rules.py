"""URL rules as a sort-merge range join.

A rule (host, path) fits its host and every subdomain when the URL's path starts with the rule's path; the
longest fitting rule decides. With the host reversed label by label, "host and path prefix" is an interval of
canonical keys ``reversed host, path``: it opens at the key itself and closes after every longer path.

A URL is looked up under each of its host suffixes. Lookups and rule openings / closings are sorted together;
a running sum of openings and closings is the depth of the stack of active nested rules, and the rule on top
at a lookup is the last one opened at the lookup's depth. Everything is built-in expressions and two windows.

A URL is looked up under those suffixes only that some rule has. How many lookups each of them gets is counted
first, by host ahead of the shuffle; a suffix of more than ``per_salt`` lookups is split: its lookups are
dealt over salts by row, and its rules repeated for each salt. So a suffix that holds most rows spreads over many tasks,
and the rules of all others are there once.

Defined results: a NULL URL, or one without ``://``, has empty host and path and no rule. Repeated rows stay.
A rule with a NULL or empty host, or a NULL path, is ignored; of two rules with the same host and path the
blocking one counts. Between equally long rules the one with the longer host wins. Extra page columns with
other names are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialise

#: Lookups of one host suffix that are swept together.
PER_SALT = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    rest = F.substring_index(_after_scheme(url), "#", 1)
    return F.translate(F.substring_index(F.substring_index(rest, "?", 1), "/", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_after_scheme(url), "#", 1), "?", 1)
    at = F.instr(rest, "/")
    return F.when(at > 0, F.substring(rest, at, F.char_length(rest))).otherwise("")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def _suffixes(host: Column) -> Column:
    """Reversed labels of every host suffix: ``a.b.c`` gives ``c``, ``c.b``, ``c.b.a``."""
    labels = F.reverse(F.split(host, "\\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))


def rule_table(rules: DataFrame) -> DataFrame:
    """Clean rules: reversed host, path, rule text, verdict (one row per host and path)."""
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    clean = rules.where("host <> '' AND path IS NOT NULL").select(host.alias("host"), "path", "verdict")
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    return clean.select(F.array_join(F.reverse(F.split("host", "\\.")), ".").alias("suffix"), "path",
                        F.concat("host", "path").alias("rule"), "verdict", F.char_length("host").alias("host_len"))


def heat(urls: DataFrame, rules: DataFrame, per_salt: int) -> DataFrame:
    """(suffix, salts) for the suffixes of rules: into how many parts the lookups of ``urls(host)`` are dealt."""
    hosts = urls.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    asked = hosts.select(F.explode(_suffixes(F.col("host"))).alias("suffix"), "n").groupBy("suffix").agg(F.sum("n").alias("n"))
    known = rules.select("suffix").distinct().join(asked, "suffix", "left")
    return known.select("suffix", (F.floor(F.coalesce("n", F.lit(0)) / per_salt) + 1).cast("int").alias("salts"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", per_salt: int = PER_SALT) -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has columns host, path, verdict."""
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    row = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(url_col).alias("url"))
    row = row.select(F.monotonically_increasing_id().alias("rid"), "row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    r = rule_table(rules)
    hot = materialise(heat(pages.select(host_of(F.col(url_col)).alias("host")), r, per_salt), "url-heat")
    none = F.lit(None)
    look = row.select("rid", "row", "host", "path", F.explode(_suffixes(F.col("host"))).alias("suffix")).join(hot, "suffix", "left")
    # the payload travels with the lookup of the whole host only
    whole = F.col("suffix") == F.array_join(F.reverse(F.split("host", "\\.")), ".")
    look = look.withColumn("page", F.when(whole, F.struct("row", "host", "path"))).where("salts IS NOT NULL OR page IS NOT NULL")
    # hosts that no rule names have nothing to sweep
    idle = look.where("salts IS NULL").select("rid", "page", none.cast("struct<size:int,host_len:int,rule:string,verdict:string>").alias("top"))
    look = look.where("salts IS NOT NULL").select(
        "suffix", F.pmod("rid", "salts").cast("int").alias("salt"), F.col("path").cast("binary").alias("key"), F.lit(1).alias("kind"), "rid", "page",
        none.cast("struct<size:int,host_len:int,rule:string,verdict:string>").alias("r"), F.lit(0).alias("step"))
    r = r.join(hot, "suffix").select("suffix", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "path",
                                     F.struct(F.char_length("rule").alias("size"), "host_len", "rule", "verdict").alias("r"))
    blank = [none.cast("long").alias("rid"), none.cast(look.schema["page"].dataType).alias("page")]
    opens = r.select("suffix", "salt", F.col("path").cast("binary").alias("key"), F.lit(0).alias("kind"), *blank, "r", F.lit(1).alias("step"))
    # 0xFF is in no UTF-8 text: it closes the interval after all longer paths
    closes = r.select("suffix", "salt", F.concat(F.col("path").cast("binary"), F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), *blank,
                      none.cast(look.schema["r"].dataType).alias("r"), F.lit(-1).alias("step"))
    events = look.unionByName(opens).unionByName(closes)
    sweep = Window.partitionBy("suffix", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("depth", F.sum("step").over(sweep))
    # a closing row leaves the stack one lower: it never opens a slot, so only openings and lookups matter
    slot = Window.partitionBy("suffix", "salt", "depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    top = F.when(F.col("depth") > 0, F.last("r", ignorenulls=True).over(slot))
    found = events.withColumn("top", top).where("kind = 1").select("rid", "page", "top").unionByName(idle)
    best = found.groupBy("rid").agg(F.max("top").alias("top"), F.first("page", ignorenulls=True).alias("page"))
    return best.select("page.row.*", "page.host", "page.path", F.col("top.rule").alias("rule"),
                       F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
