"""URL rules against a plain version: all rules on all URLs, by both ways of fetching candidates."""

import random
import re

import pytest

from adtide.llm import registry, urlrules

SITES = [("net/", "block"), ("example.net/en/", "allow"), ("a.net/en/", "block"), ("org", "block"), ("io/p", "block"), ("", "block"), ("*.com/x^", "allow")]
PATTERNS = [("^ads^", "block"), ("/login^", "block"), ("*track*", "block"), ("||good.com^", "allow"), ("|shop.", "block"), (".zip|", "block"), ("q=[1]", "block"),
            ("ads*end", "allow"), ("*", "block"), ("^ads^", "allow"), ("banner", "block")]


def own(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host):]).group(), low + rest[len(host):]


def plain(url):
    host, path, text = own(url)
    if text is None:
        return host, path, None, None, "allow"
    fits = []
    for rule, action in SITES:
        h, slash, p = rule.partition("/")
        p = slash + p
        if rule and (host == h or host.endswith("." + h)) and path.startswith(p) and text:
            fits.append((True, len(rule), rule, action))
    for rule, action in PATTERNS:
        if not rule.strip("|*^"):
            continue
        body = re.sub(r"^\|\|?|\|$", "", rule)
        loose = body.startswith("*") or not rule.startswith("|")
        body = body.strip("*") if loose else body.rstrip("*")
        body = "".join(".*" if c == "*" else "(?:^|[^A-Za-z0-9]|\\Z)" if c == "^" else re.escape(c) for c in body)
        head = "" if loose else r"^(?:[^/?#]*\.)?" if rule.startswith("||") else "^"
        if re.search(head + body + (r"\Z" if rule.endswith("|") and not rule.endswith("*|") else ""), text, re.S):
            fits.append((False, len(rule), rule, action))
    best = max(fits, default=None)
    return host, path, best[2] if best and best[0] else None, best[2] if best and not best[0] else None, best[3] if best else "allow"


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(5)
    hosts = ["x.net", "net", "EXAMPLE.net", "b.a.net", "anet", "good.com", "notgood.com", "good.com.ru", "ads.good.com", "shop.ru", "x.shop.ru", "w.org", "org:8080", "u@io", "io", "*.com", "", "é.io"]
    paths = ["", "/", "/en/", "/EN/", "/en", "/p", "/px/ads/", "/login", "/logins", "/login?x", "/a.zip", "/a.zip#t", "?q=[1]", "/xtrackx", "/ads-1-end", "/x^", "/x", "/banners", "/\nads\nend", "#ads"]
    out = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in paths]
    out += [None, "", "no scheme", "://", "a://b://ads", "mailto:x@y", "http://x.net/" + "a/" * 4000 + "ads", "http://x.ru/ads\u212a/", "http://x.ru/\u212aads/"]
    rng.shuffle(out)
    return out + out[:50]


def run(spark, urls, rules=None):
    df = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id long, url string, Host string, win string, text string").repartition(3)
    rules = rules if rules is not None else urlrules.rules_of(spark, [("site", *r) for r in SITES] + [("pattern", *r) for r in PATTERNS] + [("other", "net/", "allow")])
    return urlrules.judged(df, rules)


@pytest.mark.parametrize("limit", [urlrules.IN_TASK, 0])
def test_judged(spark, urls, limit, monkeypatch):
    monkeypatch.setattr(urlrules, "IN_TASK", limit)
    out = run(spark, urls)
    assert out.columns == ["page_id", "url", "win", "text", "host", "path", "rule", "pattern", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.pattern, r.verdict) for r in out.collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert run(spark, []).count() == 0


def test_only_fetched_rules_run(spark, urls):
    """Each rule stands under one token, the rarest of its own; rules without a bounded token under the empty one."""
    rules = urlrules.rules_of(spark, [("site", "example.net/en/", "block"), ("pattern", "*ads*", "block"), ("pattern", "/page/rare/", "block"), ("pattern", "ads*net", "block")])
    texts = spark.createDataFrame([("a.example.net/en/page/",), ("b.example.net/en/page/",), ("net/page/",), ("c.de/en/rare/",), ("c.de/en/",)], "text string")
    index = {r.win.rule: r.token for r in urlrules.rule_index(rules, texts, True).collect()}
    assert index == {"example.net/en/": "example", "*ads*": "", "/page/rare/": "rare", "ads*net": ""}


@pytest.mark.parametrize("limit", [urlrules.IN_TASK, 0])
def test_no_rules(spark, limit, monkeypatch):
    monkeypatch.setattr(urlrules, "IN_TASK", limit)
    none = urlrules.rules_of(spark, [("site", "net/", "block")]).where("false")
    got = run(spark, ["http://a.net/", None], none).collect()
    assert [(r.rule, r.verdict) for r in sorted(got, key=lambda r: r.page_id)] == [(None, "allow"), (None, "allow")]


def test_query(spark, tmp_path):
    rows = [(1, "https://a.Example.net/en/1", ""), (2, "http://example.net/de/", ""), (3, "http://www.ads-1.example.com/fr/", ""), (4, "http://ok.example.com/fr/", ""), (None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id or 0, r.rule, r.verdict) for r in registry.QUERIES["op11_url_filters"](spark, str(tmp_path)).collect())
    assert got == [(0, None, "allow"), (1, "example.net/en/", "allow"), (2, "net/", "block"), (3, None, "block"), (4, None, "allow")]
