from pyspark.sql import functions as F

from pressmill.llm import url_filter as uf

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1")]


def test_cascade_is_exact(spark):
    listed = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    listed = listed.unionByName(listed.limit(9)).unionByName(spark.createDataFrame([(None,), ("outside",)], "key string"))
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = uf.build(listed, universe)
    assert len(cascade.levels) > 2
    got = {r.key: r.found for r in universe.select("key", cascade.holds(F.col("key")).alias("found")).collect()}
    assert got == {f"k{n}": n % 7 == 0 and n < 21000 for n in range(20000)}
    extra = spark.createDataFrame([("outside",), (None,)], "key string")
    assert [r.found for r in extra.select(cascade.holds(F.col("key")).alias("found")).collect()] == [True, False]
    assert uf.build(listed, universe, most_bits=100) is None


def test_pages(spark):
    urls = [
        "http://WWW.Example.org/es/1?x=1", "https://example.org/en/12", "https://example.org/en/2", "http://notexample.org",
        "http://bad.com", "http://m.bad.com?q=/es/", "http://verybad.com/#x", "ftp://x.org://bad.com/", "bad.com/no-scheme", "", None,
        "http://bad.com/" + "p" * 50000, "://", "http:///path",
    ]
    pages = spark.createDataFrame([(n, u, "clash") for n, u in enumerate(urls)] + [(4, urls[4], "again")], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("bad.com",)], "key string")
    want = {
        0: ("www.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"),
        2: ("example.org", "/en/2", "org/", "allow"), 3: ("notexample.org", "", None, "allow"), 4: ("bad.com", "", None, "block"),
        5: ("m.bad.com", "", None, "block"), 6: ("verybad.com", "/", None, "allow"), 7: ("x.org:", "//bad.com/", None, "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"),
        11: ("bad.com", "/" + "p" * 50000, None, "block"), 12: ("", "", None, "allow"), 13: ("", "/path", None, "allow"),
    }
    for bits in (uf.MOST_BITS, 1):
        got = [tuple(r) for r in uf.judge_pages(pages, listed, RULES, bits).collect()]
        assert sorted(got) == sorted([(n, *row) for n, row in want.items()] + [(4, *want[4])])
    empty = uf.judge_pages(pages.limit(0), listed.limit(0), RULES)
    assert empty.collect() == []
    assert {r.verdict for r in uf.judge_pages(pages, listed.limit(0), []).collect()} == {"allow"}
