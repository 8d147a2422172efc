from rooftally.llm.components import connected_components
from rooftally.llm.queries import op6_url_filter
from rooftally.llm.url_filter import RULES, page_edges, url_filter

RULE_SCHEMA = "host string, path string, action string"


def judged(spark, pages, edges=None, rules=RULES):
    df = spark.createDataFrame([(k, u, h, "c", "n") for k, (u, h) in enumerate(pages)],
                               "page_id long, url string, html string, rule string, node string")
    extra = None if edges is None else spark.createDataFrame(edges, "src string, dst string")
    out = url_filter(df, spark.createDataFrame(list(rules), RULE_SCHEMA), extra).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}


def test_rules_and_parts(spark):
    urls = ["http://a.net/x", "https://NET/", "http://b.net", "http://A.Example.NET/en/1?q#f", "http://example.net/EN/", "no scheme/x",
            None, "", "http://x.example.com/de/1", "http://notexample.com/de/", "ftp://q.org/fr/?a", "http://org/fr", "x://h?p/y://z",
            "://only", "http://p.net:80/x", "http://éa.net/ü", "x" * 200_000 + "://a.net/" + "y" * 200_000]
    got = judged(spark, [(u, None) for u in urls])
    assert got.pop(len(urls) - 1) == ("a.net", "/" + "y" * 200_000, "net/", "block")
    assert [got[k] for k in range(len(urls) - 1)] == [
        ("a.net", "/x", "net/", "block"), ("net", "/", "net/", "block"), ("b.net", "", None, "allow"),
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/EN/", "net/", "block"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("x.example.com", "/de/1", "example.com/de/", "block"),
        ("notexample.com", "/de/", None, "allow"), ("q.org", "/fr/", "org/fr/", "allow"), ("org", "/fr", None, "allow"),
        ("h", "", None, "allow"), ("only", "", None, "allow"), ("p.net:80", "/x", None, "allow"), ("éa.net", "/ü", "net/", "block")]


def test_decisions_travel_over_aliases(spark):
    link = '<head><LINK rel="canonical" href="{}"></head>'
    pages = [("http://bad.net/x", ""), ("http://good.org/a", link.format("//bad.net/x#top")),
             ("https://good.org/b", "<meta http-equiv='refresh' content=\"0; url=/a\">"),
             ("http://x.org/fr/1", link.format("http://good.org/b")),  # an allow rule of its own stays
             ("http://far.com/1", "<!-- " + link.format("http://bad.net/x") + " --><script>'" + link.format("http://bad.net/x") + "'</script>"),
             ("http://far.com/2", "<link rel=stylesheet href=http://bad.net/x><link href=/3 rel='nofollow canonical'>"),
             ("http://far.com/3", None), ("http://y.com/", link.format("http://unseen.net/q&amp;r")), ("http://log.com/1", ""),
             ("http://y.com", ""), ("http://y.com/", link.format("mailto:a@bad.net"))]
    got = judged(spark, pages, [("http://log.com/1", "http://far.com/2"), (None, "http://bad.net/x"), ("http://far.com/3", "http://good.org/a?")])
    assert [got[k][3] for k in range(len(pages))] == ["block", "block", "block", "allow", "allow", "allow", "allow", "block", "allow", "block",
                                                      "block"]
    got = judged(spark, pages, [("http://far.com/3", "https://good.org/b#x")])
    assert got[5][3] == got[6][3] == "block" and got[3][3] == "allow"


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, 100 + k) for k in range(50)] + [(7000, 7000), (None, 3), (300, 301), (301, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len({got[k] for k in range(51)}) == 1 and len({got[1000], *(got[100 + k] for k in range(50))}) == 1
    assert got[300] == got[301] and got[7000] == 7000 and len(set(got.values())) == 4 and len(got) == 51 + 51 + 3
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_relative_addresses(spark):
    page = "http://h.org/dir/page?q=1"
    hrefs = ["other", "/root", "?z=2", "//k.com", "HTTP://K.com/x", "#frag", "javascript:x", ""]
    df = spark.createDataFrame([(page, f'<link rel=canonical href="{h}">') for h in hrefs], "url string, html string")
    assert sorted(r.dst for r in page_edges(df).collect() if r.dst) == sorted(
        ["h.org/dir/other", "h.org/root", "h.org/dir/page?z=2", "k.com/", "k.com/x"])


def test_empty_table(spark):
    assert judged(spark, []) == {}
    assert op6_url_filter(spark, "/root/testdata/sf0.001").count() > 0
