import random

from loomspark.llm import url_filter as uf
from loomspark.llm.queries import ALLOW, BLOCK


def plain(url, allow, block):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for verdict, rules in (("allow", allow), ("block", block)):
        for rule in rules:
            h, slash, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                fits.append((len(rule), rule, verdict))
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def check(spark, urls, allow, block):
    pages = spark.createDataFrame([(k, u, "x", True) for k, u in enumerate(urls)], "page_id long, url string, host string, rule boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(pages, allow, block).collect()}
    assert got == {k: plain(u, allow, block) for k, u in enumerate(urls)}


def test_contract_rules(spark):
    check(spark, [
        None, "", "no scheme", "http://", "http://net", "http://net/es/1", "http://NET/fr/", "https://a.b.example.com/en/x?y=/fr/", "http://example.com/fr/",
        "http://www.example.com/en/#a", "http://notexample.com/en/", "http://com", "http://com/", "http://x.org?u=http://net/es/", "http://x.net/es", "ftp://u:p@Ö.net:80/fr/\n",
        "http://x.net/es/", "http://x.net/es/", "://net/es/", "http://net/es/://com/",
    ], ALLOW, BLOCK)


def test_random_rules_against_plain_matching(spark):
    random.seed(5)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "com", "x.net", "y.x.net", "q.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/b/", "/a/b/c/"]
    rules = random.sample([h + p for h in hosts for p in paths], 24)
    urls = ["http://" + random.choice(["", "w.", "m.w."]) + random.choice(hosts) + random.choice(paths) + random.choice(["", "?q", "#f"]) for _ in range(400)]
    check(spark, urls, rules[:12], rules[12:])


def test_no_rules_and_empty_table(spark):
    check(spark, ["http://a/b"], [], [])
    assert uf.judge_urls(spark.createDataFrame([], "page_id long, url string"), ALLOW, BLOCK).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = [f"key{k}" for k in range(5000)]
    listed = universe[::7]
    cascade = uf.BloomCascade.build(uf.key_table(spark, listed), uf.key_table(spark, universe))
    assert len(cascade.levels) > 1
    got = uf.key_table(spark, universe).where(cascade.contains(uf.F.col("key"))).collect()
    assert sorted(r.key for r in got) == sorted(listed)
    assert sum(level.bits for level in cascade.levels) < 16 * len(listed)
