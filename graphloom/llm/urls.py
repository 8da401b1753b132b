"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of rules that are broadcast; a larger index is joined by shuffles.
BROADCAST_BYTES = 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A pattern on `host + path`, an action, a rank (the highest that fits wins, then the smaller name), and literal
    tokens that every text it fits holds as whole tokens, lower-cased. Without a token a rule is tried on every URL."""

    name: str
    pattern: str
    action: str
    rank: int
    tokens: tuple[str, ...]
    listed: bool = True


def address_rule(action: str, rule: str) -> Rule:
    """The rule of `host/path`: fits the host and its subdomains, on paths that start with the path. Longest wins."""
    host, slash, path = rule.partition("/")
    pattern = rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    whole = re.findall("[a-z0-9]+", host.lower()) + re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(rule, pattern, action, 1000 + len(rule), tuple(whole))


def word_rule(action: str, word: str) -> Rule:
    """Fits where a word stands as a token of host or path."""
    return Rule(f"word:{word}", rf"(?i)(?:^|[^a-z0-9]){re.escape(word)}(?:$|[^a-z0-9])", action, 0, (word,), listed=False)


#: Words of addresses that hold no prose.
UNWANTED_WORDS = ("adserver", "banner", "casino", "doubleclick", "escort", "gambling", "porn", "poker", "tracker", "viagra", "xxx")
DEFAULT_RULES = tuple(word_rule("block", w) for w in UNWANTED_WORDS)


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_lower(c), F.lit("([a-z0-9]+)"), 1))


def candidates(addresses: DataFrame, rules: list[Rule]) -> DataFrame:
    """(host, path, name, pattern, action, rank, listed): the rules that each address (host, path) fetches, not yet tried.

    A rule is filed under the one of its tokens that fewest addresses hold; an address fetches the rules filed under its
    own tokens, and those without a token.
    """
    spark, text = addresses.sparkSession, F.concat("host", "path")
    numbered = [(k, r.name, r.pattern, r.action, r.rank, r.listed) for k, r in enumerate(rules)]
    table = spark.createDataFrame(numbered, "id int, name string, pattern string, action string, rank int, listed boolean")
    literal = sorted({t for r in rules for t in r.tokens})
    counts = {}
    if literal:
        seen = addresses.select(F.explode(tokens_of(text)).alias("token"))
        wanted = spark.createDataFrame([(t,) for t in literal], "token string")
        rows = seen.join(_small(wanted, literal), "token").groupBy("token").count()
        counts = {r["token"]: r["count"] for r in rows.collect()}  # a row per literal of the rules
    filed = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else "", k) for k, r in enumerate(rules)]
    index = spark.createDataFrame(filed, "token string, id int").join(table, "id").drop("id")
    index = _small(index, [r.name + r.pattern for r in rules])
    keys = F.array_append(tokens_of(text), F.lit(""))
    return addresses.select("host", "path", F.explode(keys).alias("token")).join(index, "token").drop("token")


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the listed rule that decides, else null) and verdict; columns of those names are replaced.

    Each distinct address (host and path) is judged once, by the rules that it fetches from the index; only those run as
    regular expressions. Ties of rank go to the smaller name. Null URLs and those without :// have an empty host and
    path, which only a rule without tokens can fit. Repeated rows each get a verdict.
    """
    pages = pages.drop("host", "path", "rule", "verdict").select("*", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    looked = candidates(pages.select("host", "path").distinct(), rules)
    looked = looked.where(F.expr("regexp_like(concat(host, path), pattern)"))
    won = looked.groupBy("host", "path").agg(F.min_by(F.struct("name", "action", "listed"), F.struct(-F.col("rank"), "name")).alias("won"))
    out, won = pages.alias("p"), won.alias("w")
    out = out.join(won, (F.col("p.host") == F.col("w.host")) & (F.col("p.path") == F.col("w.path")), "left")
    rule = F.when(F.col("w.won.listed"), F.col("w.won.name"))
    return out.select("p.*", rule.alias("rule"), F.coalesce("w.won.action", F.lit(default)).alias("verdict"))


def _small(df: DataFrame, texts: list[str]) -> DataFrame:
    return F.broadcast(df) if sum(map(len, texts)) + 64 * len(texts) <= BROADCAST_BYTES else df
