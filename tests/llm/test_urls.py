import random

from tests.llm import cases  # noqa: F401
from tidemark.llm import url_sweep as us


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        end = min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0], default=len(rest))
        path = rest[cut:end]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [None, "", "no scheme", "http://", "http://example.com", "http://EXAMPLE.com/en/x?a#b", "https://www.example.com/en/",
        "https://www.example.com/fr/", "ftp://a.net/es/1", "http://net/fr/", "http://notnet/fr/", "http://xnet/es/",
        "http://a.b.net/fr", "http://com/", "http://com:80/", "http://com./", "http://.com/", "http://a..com/x",
        "x://y://z.com/p", "http://example.com?q=/en/", "http://example.com#/en/", "http://example.com//en/",
        "HTTP://www.Example.COM/en/é", "http://a\x01b.com/x", "http://u@example.com/en/", "http://example.com/en/\n?x"]


def test_edges_match_brute_force(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://a.com/1", "x", "y")] * 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in us.judge(pages, us.RULES, ranges=5).collect()), key=repr)
    assert got == sorted(((i, *plain(u, us.RULES)) for i, u, *_ in rows), key=repr)


def test_nested_rules_over_many_ranges(spark):
    rng = random.Random(2)
    labels = ["a", "b", "c", "com", "net"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rules = sorted({(rng.choice(["allow", "block"]), rng.choice(hosts), "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 3))))
                    for _ in range(60)})
    rules = list({h + p: (v, h, p) for v, h, p in rules}.values())
    urls = ["http://" + (hosts[0] if rng.random() < 0.4 else rng.choice(hosts)) + "/" + "".join(rng.choice("xy/") for _ in range(4))
            for _ in range(1500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    for r in us.judge(pages, rules, "block", ranges=13).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(urls[r["page_id"]], rules, "block")


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert us.judge(pages, us.RULES).count() == 0
