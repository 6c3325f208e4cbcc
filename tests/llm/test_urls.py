from riskweave.llm import urls as U

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/")]


def test_judge(spark):
    cases = [
        ("https://WWW.Example.org/es/1?x#y", "block", "example.org/es/"),
        ("https://notexample.org/es/1", "allow", "org/"),
        ("http://a.org", "allow", None),
        ("http://bad.com", "block", None),
        ("http://sub.bad.com?q", "block", None),
        ("http://notbad.com/", "allow", None),
        ("http://bad.com/fr/x", "allow", "com/fr/"),
        ("http://half.net/in/page", "block", None),
        ("http://half.net/in", "allow", None),
        ("http://half.net/one.html#f", "block", None),
        ("http://half.net/one.html/", "allow", None),
        ("nothing", "allow", None),
        (None, "allow", None),
        ("", "allow", None),
        ("http:///x", "allow", None),
    ]
    listed = spark.createDataFrame([("BAD.com/",), ("bad.com",), ("half.net/in/",), ("half.net/one.html",), (None,), ("",)], "form string")
    df = spark.createDataFrame([(i, u, "h", "v") for i, (u, _, _) in enumerate(cases)] * 2, "page_id long, url string, host string, verdict string")
    got = U.judge(df, listed, RULES).collect()
    assert len(got) == 2 * len(cases)
    for x in got:
        assert (x.verdict, x.rule) == cases[x.page_id][1:], cases[x.page_id]
    assert {r.host for r in got if r.page_id == 0} == {"www.example.org"}
    assert U.judge(df.limit(0), listed, RULES).count() == 0
    assert {r.verdict for r in U.judge(df.where("page_id = 3"), listed.limit(0), RULES).collect()} == {"allow"}


def test_bloom_has_no_false_negative(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '.com/') form")
    assert U.possible(listed, listed, 64).count() == 3000
    other = spark.range(3000).selectExpr("concat('n', id, '.com/') form")
    assert U.possible(other, listed, 1024).count() < 300


def test_hot_forms_urls_and_clashing_names(spark):
    rows = [(i, "http://bad.com/same" if i % 3 == 0 else None if i % 3 == 1 else f"http://s{i}.bad.com/{i}", "a", "b", "c", i, "d") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, _url string, _hit string, hit string, salt int, link string")
    listed = spark.createDataFrame([("bad.com/",)], "form string")
    got = U.judge(df, listed, RULES).collect()
    assert len(got) == 300 and all(x.verdict == ("allow" if x.url is None else "block") for x in got)
    assert all((x._url, x._hit, x.hit, x.salt, x.link) == ("a", "b", "c", x.page_id, "d") for x in got)


def test_rules_of_one_length(spark):
    rules = [("allow", "b.com", "/x"), ("block", "b.com", "/"), ("block", "com", "/xab"), ("allow", "a.b.com", "")]
    got = U.judge(spark.createDataFrame([("http://a.b.com/xab",), ("http://b.com/x",), ("http://b.com/y",)], "url string"), spark.createDataFrame([], "form string"), rules).collect()
    assert {x.url: (x.rule, x.verdict) for x in got} == {"http://a.b.com/xab": ("com/xab", "block"), "http://b.com/x": ("b.com/x", "allow"), "http://b.com/y": ("b.com/", "block")}


def test_random_pages_against_plain_python(spark):
    import random

    r = random.Random(6)
    names, tops = ["a", "bad", "b.bad", "x-y", "EXAMPLE"], ["com", "org", "net"]
    listed = ["bad.com/", "example.net/p/", "x-y.org/q", "a.net/p/q/r"]
    urls = [f"http{r.choice(['', 's'])}://{r.choice(['', 'w.', 'W.v.'])}{r.choice(names)}.{r.choice(tops)}{r.choice(['', '/', '/p', '/p/', '/q', '/p/q/r', '/fr/p', '/es/'])}{r.choice(['', '?q', '#f', '?a#b'])}" for _ in range(600)]
    got = {x.url: x for x in U.judge(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame([(x,) for x in listed], "form string"), RULES).collect()}
    for u in urls:
        rest = u.split("://")[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        whole = path or "/"
        hosts = [".".join(host.split(".")[i:]) for i in range(len(host.split(".")))]
        forms = {h + p for h in hosts for p in {whole, *(whole[: i + 1] for i, c in enumerate(whole) if c == "/")}}
        want = max(fits)[2] if fits else "block" if forms & set(listed) else "allow"
        assert got[u].verdict == want and (got[u].host, got[u].path) == (host, path), u
