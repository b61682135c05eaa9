"""URL verdicts against every rule tried on every URL."""
import random
import re

import pytest

from pluvia.llm import urls

D = "/root/testdata/sf0.01"
HOSTS = ["net", "a.net", ".net", "example.net", "x.example.net", "xexample.net", "EXAMPLE.com", "m.example.com", "org", "a.org", "net:80", "ads.x.com", "m.Ads-track.example.com", "badads.x.com",
         "casino-win.example.org", "user@example.net", "", "adult-education.x.com", "xxx.adult-education.x.com", "é.net"]
PATHS = ["", "/", "/en/", "/EN/", "/en", "/de/1", "/fr/x/y", "/fr", "/ads/banner/", "/x/ADS/Banner/y", "/login", "/robots.txt", "/a/robots.txt", "/update.scr", "/update.scrx", "/help/login", "//", "/wp-admin/x", "/a b/casino/\n"]
TAILS = ["", "?", "#", "?x=1", "?a=1&redirect=/", "#/en/", "?phpsessid=3", "?PHPSESSID=3#x", "?affiliate_id=", "?x=affiliate_id"]


def base(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(url, rules):
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3:]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:end]), rest[end:].split("#")[0]
    path, target = tail.split("?")[0], host + re.sub("[A-Z]", lambda m: m[0].lower(), tail)
    rule, verdict = base(host, path)
    fits = sorted((r.verdict, r.text) for r in rules if not r.base and target and re.search(r.regex, target, re.DOTALL))
    return host, path, rule, verdict or (fits[0][0] if fits else "allow"), fits[0][1] if fits else None


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(3)
    made = [f"{rnd.choice(['http', 'https', ''])}://{rnd.choice(HOSTS)}{rnd.choice(PATHS)}{rnd.choice(TAILS)}" for _ in range(3000)]
    made += [None, "", "no scheme", "http:/one", "://", "a://b://c", "http://x.com/" + "y/" * 200_000 + "casino/"]
    own = spark.createDataFrame([(10**6 + k, u) for k, u in enumerate(made)] + [(None, "http://a.net/"), (1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    return spark.read.parquet(f"{D}/pages.parquet").select("page_id", "url").union(own).repartition(3).cache()


def test_equals_every_rule_on_every_url(pages):
    rules = urls.default_rules()
    got = sorted((tuple(r) for r in urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "pattern").collect()), key=repr)
    assert got == sorted(((r.page_id, *brute(r.url, rules)) for r in pages.collect()), key=repr)
    assert {r[4] for r in got} == {"allow", "block"} and len({r[5] for r in got}) > 10


def test_few_rules_run(pages):
    """Rules are filed by rare tokens, so that a URL meets few of them."""
    rules, texts = urls.default_rules(), [r.url for r in pages.collect()]
    often = urls.frequencies(pages, {t for r in rules for t in r.tokens})
    index = urls.Index(rules, often)
    for u in texts:
        index.judge(u)
    assert not index.always and index.ran < len(texts) * len(rules) / 20
    for r in rules:
        key = next(t for t, ks in index.filed.items() if any(rules[k] is r for k in ks))
        assert all(often.get(key, 0) <= often.get(t, 0) for t in r.tokens)


def test_own_rules_and_columns(spark, pages):
    rows = spark.createDataFrame([(1, "http://q.com/a.zip", "h", 3), (2, "http://q.com/a.zipx", None, 4)], "page_id long, url string, host string, other int")
    got = urls.judge(rows, [urls.pattern_rule("*.zip|"), urls.base_rule("q.com", "/a.zipx", "allow")])
    assert got.columns == ["page_id", "url", "other", "host", "path", "rule", "verdict", "pattern"]
    assert [(r.verdict, r.rule, r.pattern, r.host) for r in got.orderBy("page_id").collect()] == [("block", None, "*.zip|", "q.com"), ("allow", "q.com/a.zipx", None, "q.com")]
    assert urls.judge(pages.where("false")).count() == 0
