"""Texts are tidied only where there is something to tidy, with the results of all rules applied to all texts."""

from itertools import product

from pyspark.sql import functions as F

from pressmill.functions import markdown as md
from pressmill.functions.html import html_to_markdown, visible_text
from pressmill.functions.text import strip, sub

PARTS = ["# a", "##", "#  ", "\n", "\n\n", "\t\n", "b", "[x]( )", "![y]()", "---", " https://x.com", " "]


def plainly(text):
    """One cleaning by the rules as they are listed."""
    rows = F.filter(F.split(text, "\n"), lambda line: ~md.matches_any(line, md.NOISE_LINES))
    blank = lambda line: strip(line) == ""
    kept = F.element_at(
        F.transform(
            F.array(rows),
            lambda r: F.filter(r, lambda line, i: ~blank(line) | ((i > 0) & ~blank(F.try_element_at(r, i)))),
        ),
        1,
    )
    out = F.array_join(F.transform(kept, lambda line: F.when(blank(line), "").otherwise(line)), "\n")
    for pattern, replacement in md.CLEAN_UPS:
        out = sub(out, pattern, replacement)
    return strip(out)


def test_clean_twice_is_the_rules_twice(spark):
    texts = ["".join(parts) for parts in product(PARTS, repeat=4)]
    texts += ["ſhare this", "  By me", " ٣ min read", "-- x", "— - _\n", "Written  by", "followed", "  http://a.github.com"]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string").repartition(8)
    told = df.select(
        "t",
        md.clean_twice(F.col("t")).alias("twice"),
        plainly(plainly(F.col("t"))).alias("plain"),
        md.is_noise_line(F.col("t")).alias("noise"),
        md.matches_any(F.col("t"), md.NOISE_LINES).alias("listed"),
    )
    wrong = told.filter(~F.col("twice").eqNullSafe(F.col("plain")) | ~F.col("noise").eqNullSafe(F.col("listed")))
    assert [tuple(row) for row in wrong.limit(5).collect()] == []


def test_white_space_beside_tags_and_own_private_signs(spark):
    pages = {
        "<p> a\t b </p>\n<P>c  *d_</P >": "a b\n\nc \\*d\\_",
        "<p>xyz</p><!-- gone --><p CLASS = 'ads'>ad</p>": "xyz",
        "a < b": "a < b",
        "<div>one<b> two </b>three</div>": "one **two** three",
    }
    rows = spark.createDataFrame([(k, v) for k, v in pages.items()], "html string, want string")
    got = rows.select("want", html_to_markdown(F.col("html")).alias("got"), visible_text(F.lit(" &lt;b\n")).alias("v")).collect()
    assert [row["got"] for row in got] == [row["want"] for row in got]
    assert {row["v"] for row in got} == {"<b"}
