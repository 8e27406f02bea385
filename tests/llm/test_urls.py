from sessionloom.llm import urls
from sessionloom.llm.queries import RULES

PAGES = [
    (1, "http://example.com/en/x"), (2, "https://WWW.Example.com/en/?q"), (3, "http://a.net/es/1#t"), (4, None), (5, "no-scheme"),
    (6, "http://other.org/page/"), (7, "https://www.other.org/page?x=1"), (8, "http://other.org/else"), (9, "http://com/"),
    (10, "http://xcom/en/"), (11, "http://a.b.net"), (12, "ftp://a://b.com/c"), (13, "http://other.org/page/"), (14, ""),
    (15, "http:///only/path"), (16, "http://Ünï.example.com/en/y"), (17, "http://a.net/fr/"), (18, "http://h\nost.com/a\nb?c"),
]


def judged(table, pages, listed):
    pages = table(pages, "page_id bigint, url string")
    listed = table([(u,) for u in listed], "url string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, RULES, listed).collect()}


def test_rules_and_list(table):
    out = judged(table, PAGES, ["http://other.org/page", "https://www.other.org/page#x", None, "bad"])
    assert out == {
        1: ("example.com", "/en/x", "example.com/en/", "block"),
        2: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("a.net", "/es/1", "net/es/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("other.org", "/page/", None, "block"), 7: ("www.other.org", "/page", None, "block"),
        8: ("other.org", "/else", None, "allow"), 9: ("com", "/", "com/", "allow"), 10: ("xcom", "/en/", None, "allow"),
        11: ("a.b.net", "", None, "allow"), 12: ("a:", "//b.com/c", None, "allow"), 13: ("other.org", "/page/", None, "block"),
        14: ("", "", None, "allow"), 15: ("", "/only/path", None, "allow"),
        16: ("Ünï.example.com", "/en/y", "example.com/en/", "block"), 17: ("a.net", "/fr/", "net/fr/", "block"),
        18: ("h\nost.com", "/a\nb", "com/", "allow"),
    }


def test_empty_list_and_empty_pages(table):
    assert judged(table, PAGES, [])[6][3] == "allow"
    assert judged(table, [], ["http://other.org/page"]) == {}


def test_filter_passes_every_listed_key_whether_broadcast_or_joined(spark, table):
    listed = table([(f"k{i}",) for i in range(500)], "key string")
    rows = table([(i, f"k{i % 1000}" if i % 7 else None) for i in range(3000)], "id int, key string")
    for limit in (urls.BROADCAST_BYTES, 0):
        out = urls.in_list(rows, listed, "key", "id", limit).collect()
        assert len(out) == 3000
        assert all(r["listed"] == bool(r["key"] and int(r["key"][1:]) < 500) for r in out)


def test_few_false_positives(spark):
    keys = spark.range(20_000).selectExpr("concat('in', id) AS key")
    blocks = -(-20_000 * urls.BITS_PER_KEY // urls.BLOCK_BITS)
    bloom = urls.blocked_bloom(keys, "key", blocks)
    assert bloom.count() <= blocks
    probe = spark.range(20_000).selectExpr("concat('out', id) AS key")
    probe = probe.withColumn("block", urls._block(probe["key"], blocks)).join(bloom, "block")
    for i, mask in enumerate(urls._masks(probe["key"])):
        probe = probe.where(probe[f"lane{i}"].bitwiseAND(mask) == mask)
    assert probe.count() < 200


def test_plan_has_no_python(spark, table):
    plan = urls.judge(
        table(PAGES, "page_id bigint, url string"), RULES, table([("http://a.b/c",)], "url string")
    )._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
