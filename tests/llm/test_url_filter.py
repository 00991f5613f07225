import pytest

from spindrift.llm import url_filter as U


def brute(url, rules):
    host, path = U.split_url(url)
    fit = [(len(h.split(".")), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return (host, path, best[3] if best else None, best[4] if best else "allow")


URLS = [
    "http://Example.ORG/es/1", "http://a.example.org/en/12?x#y", "http://example.org/en/2", "http://example.com/fr/", "http://x.com/de/3", "http://com/de", "http://example.net/de/",
    None, "", "no scheme/org/", "://", "http://", "http://org", "http://org/", "http://badexample.org/es/", "http://example.org?/es/", "http://example.org#/es/", "ftp://example.org/es", "http://example.org//es/",
    "HTTP://EXAMPLE.ORG/ES/", "http://example.org:80/es/", "http://u@example.org/es/", "a://b://example.org/es/", "http://.org/", "http://example.org./es/", "http://É.org/x",
]


@pytest.mark.parametrize("rules", [U.RULES, [("block", "org", "/a/b"), ("allow", "org", "/a/bc/d"), ("block", "x.org", "/"), ("allow", "x.org", "/"), ("allow", "x.org", "/a")]])
def test_trie_equals_brute_force(rules):
    trie = U.build_trie(rules)
    more = [f"http://{h}{p}" for h in ("org", "x.org", "y.x.org", "xx.org") for p in ("", "/", "/a", "/a/", "/a/b", "/a/bc", "/a/bc/d", "/a/bc/de/f", "//a")]
    for url in URLS + more:
        assert U.judge(trie, url) == brute(url, rules), url


def test_bad_rules_are_refused():
    for rule in (("deny", "org", "/"), ("allow", "", "/"), ("allow", "org", "x")):
        with pytest.raises(ValueError):
            U.build_trie([rule])


def test_pages(spark):
    pages = spark.createDataFrame([(i, u, "h", "x", "y") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, html string, host string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in U.filter_urls(pages, U.RULES).collect()}
    assert got == {i: brute(u, U.RULES) for i, u in enumerate([*URLS, URLS[0]])}
    assert U.filter_urls(pages.limit(0), U.RULES).count() == 0
