"""URL filters: pattern rules stand under their rarest literal token, and a URL runs only the rules its tokens fetch."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

IN_TASK = 20_000  # rules whose index travels with the tasks; a larger rule set is joined by token instead
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words that mark a host or path as advertising, gambling, adult or counterfeit, and pages without text.
BLOCKED_WORDS = ("ads", "adserver", "adult", "banners", "bets", "betting", "casino", "pills", "poker", "porn", "replica", "viagra", "xxx")
BLOCKED_PAGES = ("||*/cgi-bin/", "||*/wp-admin/", "/login^", "/cart^", "?sessionid=", "&sessionid=", ".exe|", ".zip|", ".jpg|", ".png|")


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (kind, rule, action) triples, as constants of the plan."""
    row = lambda r: F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("kind", "rule", "action"), strict=True)])
    return spark.range(1).select(F.inline(F.array(*map(row, rules))))


def default_patterns(spark: SparkSession) -> DataFrame:
    words = [("pattern", f"^{w}^", "block") for w in BLOCKED_WORDS]
    return rules_of(spark, [*words, *(("pattern", p, "block") for p in BLOCKED_PAGES)])


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and the text that rules match, which is all behind the first ``://``; the host's A-Z are lower-cased."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.concat(host, F.regexp_extract(rest, "(?s)^[^/?#]*(.*)$", 1))


def _tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits; the empty token fetches the rules that have none of their own."""
    runs = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(runs, F.array(F.lit("")))))


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(\p{Punct})", r"\\$1")


def compiled(rules: DataFrame) -> DataFrame:
    """Each rule with its regular expression, its literal tokens and its place among rules that fit the same URL.

    A literal token can index a rule only where the pattern bounds it on both sides, so that it is a whole token of every
    URL that fits. A ``*`` or an open end beside it leaves that open.
    """
    rule, site = F.col("rule"), F.col("kind") == "site"
    host, path = F.translate(F.substring_index(rule, "/", 1), UPPER, LOWER), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    of_site = F.concat(F.lit(r"^(?:[^/?#]*\.)?"), _escaped(host), F.when(path == "", r"(?:[/?#]|\z)").otherwise(_escaped(path)))
    body = F.regexp_replace(rule, r"^\|\|?|\|$", "")
    pieces = F.filter(F.split(body, r"\*"), lambda p: p != "")
    symbol = lambda c: F.when(c == "^", r"(?:^|[^A-Za-z0-9]|\z)").otherwise(_escaped(c))

    def piece(p: Column, i: Column) -> Column:
        """The first place of the piece behind the one before; atomic, so that a long URL is read once."""
        lead = F.when((i > 0) | body.startswith("*") | ~rule.startswith("|"), ".*?").when(rule.startswith("||"), r"(?:[^/?#]*?\.)??").otherwise("")
        found = F.concat(lead, F.array_join(F.transform(F.split(p, ""), symbol), ""))
        at_end = (i == F.size(pieces) - 1) & rule.endswith("|") & ~body.endswith("*")
        return F.when(at_end, F.concat(found, F.lit(r"\z"))).otherwise(F.concat(F.lit("(?>"), found, F.lit(")")))

    of_pattern = F.concat(F.lit("^"), F.array_join(F.transform(pieces, piece), ""))
    bounded = F.when(site, F.concat(F.lit("|"), host, F.when(path == "", "/").otherwise(path))).otherwise(rule)
    tokens = F.regexp_extract_all(F.translate(bounded, UPPER, LOWER), F.lit("(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0))
    usable = rules.where(F.length(F.translate("rule", "|*^", "")) > 0).where(F.col("kind").isin("site", "pattern") & F.col("action").isNotNull())
    return usable.select(
        F.concat(F.lit("(?s)"), F.when(site, of_site).otherwise(of_pattern)).alias("regex"), F.array_distinct(tokens).alias("tokens"),
        F.struct(site.alias("site"), F.length("rule").alias("n"), rule.alias("rule"), F.col("action").alias("action")).alias("win"))


def rule_index(rules: DataFrame, texts: DataFrame, small: bool) -> DataFrame:
    """(token, regex, win): every rule under that of its tokens which the fewest URLs of ``texts`` hold."""
    ready = compiled(rules).distinct()
    wanted = ready.select(F.explode("tokens").alias("token")).distinct()
    seen = texts.select(F.explode(_tokens(F.col("text"))).alias("token"))
    seen = seen.join(F.broadcast(wanted), "token", "left_semi") if small else seen
    often = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    held = ready.select("regex", "win", F.explode("tokens").alias("token")).join(often, "token", "left")
    rarest = held.groupBy("regex", "win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return rarest.select("token", "regex", "win").unionByName(ready.where(F.size("tokens") == 0).select(F.lit("").alias("token"), "regex", "win"))


def _won(candidates: Column, text: Column) -> Column:
    """The winning rule: site rules before patterns, then the longest, then the greatest text, ``block`` before ``allow``."""
    return F.array_max(F.transform(F.filter(candidates, lambda c: F.rlike(text, c["regex"])), lambda c: c["win"]))


def _looked_up(index: DataFrame, tokens: Column, text: Column) -> Column:
    """The winner by an index that is a constant of the plan: an array of buckets of rules."""
    rows = index.select(F.xxhash64("token").alias("h"), "token", "regex", "win").collect()  # at most IN_TASK rules
    buckets: list[list] = [[] for _ in range(len(rows) or 1)]
    for r in rows:
        buckets[r.h % len(buckets)].append({"token": r.token, "regex": r.regex, "win": r.win.asDict()})
    shape = "array<array<struct<token: string, regex: string, win: struct<site: boolean, n: int, rule: string, action: string>>>>"
    table = F.from_json(F.lit(json.dumps(buckets)), shape)

    def fetch(t: Column) -> Column:
        return F.filter(F.element_at(table, (F.pmod(F.xxhash64(t), F.lit(len(buckets))) + 1).cast("int")), lambda c: c["token"] == t)

    return _won(F.flatten(F.transform(tokens, fetch)), text)


def judged(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, pattern and verdict of every URL.

    ``rules`` has kind, rule and action. A rule of kind ``site`` is a host with an optional path: it fits that host and its
    subdomains where the URL's path starts with the rule's. One of kind ``pattern`` is literal text in which ``*`` is any
    text, ``^`` a separator (no ASCII letter or digit) or an end, ``||`` at the start a domain, ``|`` at either end that
    end. Case counts, but in hosts. Site rules go before patterns, longer rules before shorter ones; ``rule`` is the site
    rule that decided, ``pattern`` the pattern that did where no site rule fits.

    Rules are indexed by their rarest literal token, counted over all URLs; a URL's tokens fetch candidates, and only these
    run regular expressions. Up to ``IN_TASK`` rules the index travels with the tasks, and pages are not shuffled. Beyond,
    distinct URLs are joined with it by token; rules without a usable token are tried on every URL in both ways.

    A null URL or one without ``://`` has an empty host and path, no rule, and the verdict ``otherwise``. Repeated pages
    keep their rows; rules that are null, empty or of another kind are ignored; columns of ``pages`` named like a
    result are replaced.
    """
    own = ("host", "path", "rule", "pattern", "verdict")
    host, path, text = url_parts(F.col(url_col))
    page = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in own])
    texts = pages.select(text.alias("text")).where("text <> ''")
    rows = pages.select(page.alias("page"), host.alias("host"), path.alias("path"), text.alias("text"))
    small = rules.count() <= IN_TASK
    index = rule_index(rules, texts, small)
    if small:
        won = rows.withColumn("win", _looked_up(index, _tokens(F.col("text")), F.col("text")))
    else:
        fetched = texts.distinct().withColumn("token", F.explode(_tokens(F.col("text")))).join(index, "token")
        won = rows.join(fetched.where(F.rlike("text", F.col("regex"))).groupBy("text").agg(F.max("win").alias("win")), "text", "left")
    w = F.col("win")
    return won.select(
        "page.*", "host", "path", F.when(w["site"], w["rule"]).alias("rule"), F.when(~w["site"], w["rule"]).alias("pattern"),
        F.coalesce(w["action"], F.lit(otherwise)).alias("verdict"))
