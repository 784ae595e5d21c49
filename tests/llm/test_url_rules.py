import random

from textpair.llm import url_rules as ur


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for rule, verdict in rules:
        name, tail = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            best = max(best or (0, "", ""), (len(rule), rule, verdict))
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "http://NET/", "https://a.Example.NET/en/x?y#z", "http://example.net", "http://example.net/en", "http://xexample.net/en/",
    "http://example.com/de/1", "http://b.example.com/fr/1", "http://x.org/fr/1", "http://org/fr/", "http://org-x/fr/", "http://user@example.net:80/en/", "http://a..net/", "http://net./",
    "http://www.spam-farm.example.org/en/", "http://é.net/ü", "http://example.net/en/://net/", "a://b?c://example.net/en/", "http://x.net\\y/", "http://" + "a." * 120 + "net/", "http://" + "b." * 100_000 + "example.net/en/q",
]


def test_equals_brute_force(spark):
    rows = list(enumerate(URLS)) + [(5, URLS[5]), (None, URLS[9])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS _row")
    got = sorted([(r.page_id, r.host, r.path, r.rule, r.verdict, r.list_rule) for r in ur.judge(pages).collect()], key=str)
    want = []
    for page_id, url in rows:
        host, path, base = brute(url, ur.BASE_RULES)
        listed = brute(url, ur.LIST_RULES)[2]
        want.append((page_id, host, path, base and base[1], (base or listed or (0, "", "allow"))[2], listed and listed[1]))
    assert got == sorted(want, key=str)
    assert ur.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_many_nested_rules(spark):
    rng = random.Random(6)
    hosts = ["a", "b.a", "c.b.a", "cb.a", "b", "a.b"]
    rules = list({f"{rng.choice(hosts)}/{'/'.join(rng.choice('xy') for _ in range(rng.randrange(4)))}" for _ in range(60)})
    rules = [(r, rng.choice(("block", "allow"))) for r in rules]
    urls = [f"http://{rng.choice(['', 'z.'])}{rng.choice(hosts)}/{'/'.join(rng.choice('xy') for _ in range(rng.randrange(6)))}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule for r in ur.judge(pages, rules, [("q/", "block")]).collect()}
    for i, url in enumerate(urls):
        best = brute(url, rules)[2]
        assert got[i] == (best and best[1]), url


def test_equal_rules_block(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert ur.judge(pages, [("b/", "allow"), ("b/", "block")]).first().verdict == "block"
