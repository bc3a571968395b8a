r"""URL filters: allow and block rules found through their rarest literal token.

A rule is ``(host, path, verdict)``. It fits a URL whose host is the rule's host or a subdomain of it and whose path
starts with the rule's path. Every rule becomes one regular expression over ``host + path`` and is filed under that one
of its whole literal tokens that the fewest URLs hold. A URL is cut into the same tokens; its tokens fetch candidate
rules, and only those run their expressions. Of the rules that fit, the longest (host and path together) decides, then
the longer host, then ``block`` before ``allow``.

Tokens are host labels (``h:example``) and whole path segments (``p:en``). The last segment of a rule's path is a
prefix, so it is a token only when a ``/`` follows it. A rule with neither host nor whole segment is filed under the
empty token, which every URL holds.

Defined results: a null URL or one without ``://`` has an empty host and path, and gets the default verdict; repeated
rows are judged one by one; extra columns are not looked at; an empty table gives an empty table. A very long URL is
split into all its tokens, as any other.

Everything is DataFrame expressions. Up to ``inline_rules`` rules the index is a map literal inside the projection, which a URL's
tokens are looked up in: no shuffle, no skew. Beyond that, URL tokens are joined to the index and candidates are reduced per URL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, quoted

#: (host, path, verdict)
Rule = tuple[str, str, str]

_META = re.compile(r"([\\.^$|?*+()\[\]{}])")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(rest, "/", 1)
    return ascii_lower(host), rest.substr(F.length(host) + 1, F.length(rest))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: its labels, its segments and the empty token."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(""))))


def rule_tokens(host: str, path: str) -> list[str]:
    """Tokens that every URL that the rule fits is sure to hold."""
    found = [f"h:{x}" for x in host.split(".")] if host else []
    return found + [f"p:{x}" for x in path.split("/")[1:-1]] or [""]


def rule_pattern(host: str, path: str) -> str:
    quote = lambda x: _META.sub(r"\\\1", x)
    own = rf"(?:[^/]*\.)?{quote(host)}" if host else "[^/]*"
    return rf"^{own}{quote(path)}" if path else rf"^{own}(?:/|$)"


def token_counts(urls: DataFrame, tokens: Sequence[str], url: str = "url") -> dict[str, int]:
    """In how many of all URLs each of the rules' tokens occurs; as many rows as the rules have tokens."""
    host, path = split_url(F.col(url))
    held = F.array_intersect(url_tokens(host, path), F.array(*map(F.lit, tokens)))
    rows = urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def index_rules(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[tuple[str, str, str, str]]]:
    """token -> rules as (host, path, verdict, pattern), each under its rarest token."""
    out: dict[str, list[tuple[str, str, str, str]]] = {}
    for host, path, verdict in dict.fromkeys(rules):
        key = min(rule_tokens(host, path), key=lambda t: (counts.get(t, 0) if t else float("inf"), t))
        out.setdefault(key, []).append((host, path, verdict, rule_pattern(host, path)))
    return out


def filter_urls(urls: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", inline_rules: int = 64) -> DataFrame:
    """``urls`` with the columns host, path, rule and verdict (which replace columns of those names)."""
    spark = urls.sparkSession
    names = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    own = urls.select(*[F.col(quoted(c)) for c in names])
    host, path = split_url(F.col(url))
    if not rules:
        return own.select("*", host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    counts = token_counts(own, sorted({t for h, p, _ in rules for t in rule_tokens(h, p)}), url)
    index = index_rules(rules, counts)
    # What decides among the rules that fit is the greatest struct.
    rank = lambda h, p, v: (len(h) + len(p), len(h), v == "block")
    if sum(map(len, index.values())) <= inline_rules:
        as_struct = lambda h, p, v, rx: F.struct(*[F.lit(x).alias(n) for n, x in zip(("n", "nh", "b", "rule", "verdict", "rx"), (*rank(h, p, v), h + p, v, rx), strict=True)])
        found = F.create_map(*[x for key, held in index.items() for x in (F.lit(key), F.array(*[as_struct(*r) for r in held]))])
        cut = own.withColumns({"host": host, "path": path}).withColumn("__tokens", url_tokens(F.col("host"), F.col("path")))
        line = F.concat("host", "path")
        # Only the rules that the tokens fetch run their expressions, and the greatest of no fits at all is null.
        fetched = F.flatten(F.array_compact(F.transform("__tokens", lambda t: F.try_element_at(found, t))))
        cut = cut.withColumn("__best", F.array_max(F.filter(fetched, lambda r: F.rlike(line, r["rx"]))))
        return cut.select(*[F.col(quoted(c)) for c in names], "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"))
    table = spark.createDataFrame([(k, *rank(h, p, v), h + p, v, rx) for k, held in index.items() for h, p, v, rx in held], "token string, n int, nh int, b boolean, rule string, verdict string, rx string")
    lines = own.select(F.col(url).alias("__url")).distinct()
    h, p = split_url(F.col("__url"))
    lines = lines.select("__url", F.concat(h, p).alias("line"), F.explode(url_tokens(h, p)).alias("token"))
    fits = lines.join(table, "token").where(F.expr("line rlike rx"))
    won = fits.groupBy("__url").agg(F.max(F.struct("n", "nh", "b", "rule", "verdict")).alias("__best"))
    out = own.join(won, own[url].eqNullSafe(won["__url"]), "left")
    return out.select(*[own[quoted(c)] for c in names], host.alias("host"), path.alias("path"), F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"))
