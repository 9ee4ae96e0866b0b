"""Addresses judged by host and path rules: every rule waits under its rarest token, an address asks its own tokens only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.llm.common import ascii_lower

ALLOW, BLOCK = "allow", "block"
#: Rules up to this number are broadcast; a larger rule table meets the addresses by a shuffled join.
BROADCAST_RULES = 200_000
MARKERS = 4096
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BETWEEN = "[^0-9A-Za-z]+"


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def _literal(col: Column, star: str) -> Column:
    """A rule's text as a regular expression in which only ``*`` is special."""
    return F.regexp_replace(F.regexp_replace(col, "([^0-9A-Za-z/*])", r"\\$1"), r"\*", star)


def compiled(rules: DataFrame) -> DataFrame:
    """rule, verdict, size, pattern and tokens of every rule ``(host, path, verdict)``.

    A token is a run of ASCII letters and digits that an address must hold whole:
    runs that touch a ``*``, or end a path, could go on in the address and do not count.
    A rule without tokens has the empty one, which every address asks for.
    """
    host, path = ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    open_run = r"[0-9A-Za-z]*\*[0-9A-Za-z]*"
    whole = F.concat_ws(" ", F.regexp_replace(host, open_run, " "), F.regexp_replace(F.regexp_replace(path, open_run, " "), "[0-9A-Za-z]+$", ""))
    tokens = F.array_remove(F.array_distinct(F.split(whole, BETWEEN)), "")
    return rules.select(
        F.concat(host, path).alias("rule"),
        "verdict",
        F.char_length(F.concat(host, path)).alias("size"),
        F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), _literal(host, "[^/]*"), F.lit("(?![^/])"), _literal(path, ".*")).alias("pattern"),
        F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit(""))).alias("tokens"),
    ).distinct()


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(target, BETWEEN))


def rule_index(rules: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """Each compiled rule once, under the one of its tokens that the fewest addresses hold (ties: first in text order)."""
    spread = rules.select("*", F.explode("tokens").alias("token")).drop("tokens")
    wanted = spread.select("token").distinct()
    held = targets.select(F.explode(_tokens(F.col("target"))).alias("token"))
    counts = held.join(F.broadcast(wanted) if few else wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rare = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")
    return spread.join(counts, "token", "left").groupBy("rule", "verdict", "size", "pattern").agg(F.min(rare)["token"].alias("token"))


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = ALLOW,
               broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every page.

    A rule ``(host, path, verdict)`` fits its host and all subdomains if the path
    starts with the rule's; ``*`` stands for any run of characters (in a host: up to the
    path). The longest fitting rule decides, ties go to the later rule, then verdict, in text order;
    pages that no rule fits get ``default`` and a null rule.

    The project keeps no table of addresses, so this works on any table with an id and an address.

    An address meets only the rules that wait under one of its tokens, and only those run their regular
    expression. Rules are broadcast when there are at most ``broadcast_rules``; more are joined by token, where
    a frequent token holds few rules, as each waits under its rarest, and its addresses can be split.
    One shuffle brings an address's fits together: fits are combined on the map side,
    within a partition of the input, so repeated rows cost one group and no group is larger than a partition's rows.

    Null addresses, and those without ``://``, have an empty host and path. Null ids stay.
    Repeated rows come back as often. Repeated rules count once. No pages, no rows; no rules, all ``default``.
    Other columns of both tables are ignored.
    """
    few = rules.limit(broadcast_rules + 1).count() <= broadcast_rules
    rows = pages.select(pages[page_id].alias("page_id"), pages[url].cast("string").alias("url"))
    addressed = rows.select("*", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("target"))
    index = rule_index(compiled(rules.select("host", "path", "verdict")), addressed, few)
    # every address also asks for a token that no rule has, so each row comes through once
    marker = F.concat(F.lit(" "), F.pmod(F.xxhash64("page_id", "url"), F.lit(MARKERS)).cast("string"))
    asked = addressed.select(
        "page_id", "url", "target", F.spark_partition_id().alias("part"),
        F.explode(F.array_union(F.array(marker, F.lit("")), _tokens(F.col("target")))).alias("token"),
    )
    met = asked.join(F.broadcast(index) if few else index, "token", "left")
    itself, fits = F.startswith("token", F.lit(" ")), F.coalesce(F.regexp_like("target", F.col("pattern")), F.lit(False))
    best = (
        met.where(itself | fits)
        .groupBy("page_id", "url", "part")
        .agg(F.max(F.when(fits, F.struct("size", "rule", "verdict"))).alias("r"), F.count_if(itself).cast("int").alias("n"))
    )
    out = best.select("page_id", "url", "r", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy"))
    return out.select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"),
    )
