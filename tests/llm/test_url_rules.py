import random
import re

from quarry.llm import url_rules as U

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("example.org", "/en/12", "allow"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("b.com", "", "block"), ("b.com", "/fr", "allow"), ("EXAMPLE.net", "/", "allow"),
         ("x.org", "/", "allow"), ("x.org", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("a.org", None, "block")]


def brute(url):
    t = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", t)[0]
    path = re.match(r"[^?#]*", t[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for h, p, v in RULES:
        if h and p is not None:
            h = h.lower()
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((len(h + p), len(h), h + p, v))
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_against_brute_force(spark):
    r = random.Random(3)
    urls = [None, "", "no scheme", "http://", "http://org", "http://org/", "x://A.B.com?x", "http://b.com#f", "ftp://xb.com/fr/", "http://x.org/a://b",
            "http://..org/", "http://com/fr/é", "http://example.org/en/" + "1" * 5000, "http://x.org/\U0010ffff/"]
    for _ in range(400):
        host = ".".join(r.choices(["a", "b", "example", "x", "Example"], k=r.randrange(0, 4)) + [r.choice(["org", "com", "net", "ORG"])])
        urls.append(f"http://{host}{r.choice(['', '/', '/es/', '/es', '/en/1', '/en/12/3', '/en/2', '/fr/x', '/de/'])}{r.choice(['', '?q=/es/', '#/'])}")
    urls += ["http://hot.example.org/en/12"] * 300
    pages = spark.createDataFrame([(k // 2, u, "clash", k) for k, u in enumerate(urls)], "page_id long, url string, HOST string, rid int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(tuple(x) for x in U.judge(pages, rules, per_salt=50).select("rid", "host", "path", "rule", "verdict").collect())
    assert got == [(k, *brute(u)) for k, u in enumerate(urls)]
    assert U.judge(pages, rules.limit(0)).where("rule IS NULL AND verdict = 'allow'").count() == len(urls)
    assert U.judge(pages.limit(0), rules).count() == 0


def test_no_python_on_executors(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = U.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_rules_are_repeated_for_hot_suffixes_only(spark):
    r = random.Random(4)
    hosts = [f"h{r.randrange(300)}.org" for _ in range(300)] + ["hot.com"] * 900
    rules = [(f"h{i}.org", f"/{j}", "block") for i in range(300) for j in range(20)] + [("com", "/", "allow"), ("never.net", "/", "block")]
    pages = spark.createDataFrame([(k, f"http://{h}/{k % 25}") for k, h in enumerate(hosts)], "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    heat = {x.suffix: x.salts for x in U.heat(pages.select(U.host_of(pages.url).alias("host")), U.rule_table(table), 100).collect()}
    assert heat["com"] == 10 and heat["net.never"] == 1 and sum(heat.values()) == len(heat) + 9 and "org" not in heat
    got = {x.page_id: (x.rule, x.verdict) for x in U.judge(pages, table, per_salt=100).collect()}
    for k, h in enumerate(hosts):
        want = ("com/", "allow") if h == "hot.com" else (f"{h}/{str(k % 25)}", "block") if k % 25 < 20 else (f"{h}/2", "block")
        assert got[k] == want, (k, h)
