"""URL filters: pattern rules indexed by their rarest literal token.

A rule's pattern is text with `*` for any run, `^` for a separator or the end, and `||` in front for the start of the host or
of one of its labels. Its literal tokens are the letter and digit runs that must stand whole in any matching URL. The counts of these
tokens over all URLs (one aggregation over the few tokens that rules have) choose the rarest; a URL's tokens
then fetch candidate rules, and only those run their regular expression. Rules without a whole token are tried on every URL.

Defined cases: a null URL, or one without "://", has empty host and path and fits no rule; its verdict is the default. Blocks
and exceptions: an exception rule (allow) beats a block rule. Duplicate rows give equal verdicts; extra columns are ignored.
Matching is row by row: no shuffle of pages, and each worker holds only the rules.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    verdict: str
    pattern: str


#: The host and path rules that come first; the longest that fits decides.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)

#: Production parameters: pattern rules for all other URLs.
PATTERN_RULES = tuple(
    PatternRule(*x)
    for x in (
        ("block", "||casino-win^"), ("block", "||casino^"), ("block", "-casino^"), ("block", "||free-bets^"), ("block", "||bets^"), ("block", "||poker^"), ("block", "||slots^"), ("block", "||jackpot^"),
        ("block", "||cheap-pills^"), ("block", "||pills^"), ("block", "||viagra^"), ("block", "||pharmacy-discount^"), ("block", "||adult^"), ("block", "||porn^"), ("block", "||xxx^"), ("block", "||sex^"),
        ("block", "^casino^"), ("block", "^porn^"), ("block", "||payday-loans^"), ("block", "||replica-watches^"), ("block", "||torrent^"), ("block", "||warez^"), ("block", "^wp-login.php^"), ("block", "^phpmyadmin^"),
        ("block", "/ads/banner*.gif^"), ("block", "^doubleclick^"), ("block", "||tracker*.example^"), ("allow", "||news*.casino-report.example^"), ("allow", "/adult-education/"), ("allow", "||sex-education^"),
    )
)

_TOKEN = r"[a-z0-9]+"


def regex(pattern: str) -> str:
    """The pattern as a regular expression (also valid in RE2) over the lower-cased URL."""
    body, head = pattern, ""
    if pattern.startswith("||"):
        body, head = pattern[2:], r"^[^/?#]*://([^/?#]*\.)?"
    parts = {"*": ".*", "^": r"([^a-z0-9_.%-]|[.-]|$)"}
    return head + "".join(parts.get(c, re.escape(c) if not c.isalnum() else c) for c in body)


def tokens(pattern: str) -> list[str]:
    """The runs of letters and digits that stand whole in every URL that the pattern matches.

    A run counts only if the pattern itself ends it on both sides: by a literal of another kind, `^`, or for the left side `||`.
    """
    body, open_left = (pattern[2:], False) if pattern.startswith("||") else (pattern, True)
    found = []
    for m in re.finditer(_TOKEN, body.lower()):
        left = body[m.start() - 1] if m.start() else ("*" if open_left else "^")
        right = body[m.end()] if m.end() < len(body) else "*"
        if left != "*" and right != "*":
            found.append(m[0])
    return found


def parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path as the base rules define them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: tuple[HostRule, ...] = HOST_RULES) -> Column:
    """struct(name, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def index(pages: DataFrame, rules: tuple[PatternRule, ...], url: str = "url") -> dict[str, list[int]]:
    """Rarest token -> numbers of its rules; "" has the rules to be tried on every URL.

    Counts come from all rows, but only for tokens that rules have, so the collected table is bounded by the rules.
    """
    of = [tokens(r.pattern) for r in rules]
    wanted = sorted({t for x in of for t in x})
    seen = pages.select(F.explode(F.array_distinct(F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda t: t.isin(wanted)))).alias("t"))
    count = defaultdict(int, {r["t"]: r["n"] for r in seen.groupBy("t").agg(F.count("*").alias("n")).collect()})
    out: dict[str, list[int]] = defaultdict(list)
    for i, x in enumerate(of):
        out[min(x, key=lambda t: (count[t], t)) if x else ""].append(i)
    return dict(out)


def _matcher(rules: tuple[PatternRule, ...], by_token: dict[str, list[int]], default: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(regex(r.pattern), re.S) for r in rules]
        token, always = re.compile(_TOKEN), by_token.get("", [])

        def judge(url: str | None) -> str:
            if url is None or "://" not in url:
                return default
            low = url.lower()
            tried = {i for t in set(token.findall(low)) for i in by_token.get(t, ())}.union(always)
            hit = {rules[i].verdict for i in tried if compiled[i].search(low)}
            return "allow" if "allow" in hit else "block" if hit else default

        for frame in frames:
            frame["pattern_verdict"] = [judge(u if isinstance(u, str) else None) for u in frame["url"]]
            yield frame

    return run


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", host_rules: tuple[HostRule, ...] = HOST_RULES, rules: tuple[PatternRule, ...] = PATTERN_RULES, default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict for each row."""
    p = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    kind = p.schema["key"].dataType.simpleString()
    m = p.mapInPandas(_matcher(rules, index(pages, rules, url), default), f"key {kind}, url string, pattern_verdict string")
    host, path = parts(F.coalesce(F.col("url"), F.lit("")))
    m = m.select("key", "pattern_verdict", host.alias("host"), path.alias("path"))
    m = m.withColumn("r", host_rule(F.col("host"), F.col("path"), host_rules))
    return m.select(F.col("key").alias(key), "host", "path", F.col("r.name").alias("rule"), F.coalesce("r.verdict", "pattern_verdict").alias("verdict"))


def sql(host_rules: tuple[HostRule, ...] = HOST_RULES, rules: tuple[PatternRule, ...] = PATTERN_RULES, default: str = "allow") -> str:
    """The same as DuckDB SQL that runs every rule on every URL of `pages`."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda r: f"(host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)})"
    ordered = sorted(host_rules, key=lambda r: -len(r.name))
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(r)} THEN {q(of(r))}" for r in ordered) + " END"
    hit = lambda v: " OR ".join(f"regexp_matches(low, {q(regex(r.pattern))}, 's')" for r in rules if r.verdict == v) or "false"
    return f"""
    WITH u AS (SELECT page_id, coalesce(url, '') AS url, lower(coalesce(url, '')) AS low, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
    SELECT page_id, host, path, {case(lambda r: r.name)} AS rule, coalesce({case(lambda r: r.verdict)}, CASE WHEN strpos(low, '://') = 0 THEN {q(default)} WHEN {hit("allow")} THEN 'allow' WHEN {hit("block")} THEN 'block' ELSE {q(default)} END) AS verdict FROM h"""
