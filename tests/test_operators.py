"""Operators on small tables, with brute force where a result can be had by it."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from pressmill.operators import (
    chunking,
    extraction,
    incremental,
    nearest,
    politeness,
    reports,
    retrieval,
    routing,
    transcripts,
    vectors,
)

INDEX = """
<!-- <div class="table-issue"></div> -->
<div class="table-issue"><p class="title-table-issue"><a href="/issues/73">Seventy-three</a></p>
  <p class="text-table-issue">23rd May 2021</p></div>
<div class="row table-issue"><p class="title-table-issue"><a class="x" href="issues/2">Two</a></p>
  <p class="text-table-issue"> 22nd December 2023 </p></div>
<div class="table-issues">none</div>
"""
ISSUE = """
<body><h3 class="topic-title" data-v>First</h3> <hr>
<div data-v><a href="https://a.b/c?x=1&amp;y=2" data-url="zz" class="post-title">Down &amp; up</a> <br>3 minutes read.<br><br>
 "Told" by <i>one</i> of them.
 <br><br><b>Read</b> it later via <a href="z">Pocket</a>.<br><b> Share</b><br><br></div></div></div>
<div class="row"><div><h3 class="topic-title">Second</h3>
<div><div>inside</div><a href="https://n.o/1" class="post-title">Nested</a><span>5 minutes read</span> Begun <br>on<br>and<br>cut</div>
stray <div>untitled</div><div><a class='big post-title' href='/q'>Bare</a> 1 minute read</div></div></div><div>after</div>
"""


def test_list_issues(spark):
    pages = spark.createDataFrame([("https://p.org/issues/", INDEX)], "url string, html string")
    rows = extraction.list_issues(pages).orderBy("item_of.current").collect()
    assert [(r.num, r.url, r.date, tuple(r.item_of)) for r in rows] == [
        (73, "https://p.org/issues/73", datetime.date(2021, 5, 23), (0, 2)),
        (2, "https://p.org/issues/2", datetime.date(2023, 12, 22), (1, 2)),
    ]
    first = extraction.list_issues(pages, limit=1).collect()
    assert [(r.num, tuple(r.item_of)) for r in first] == [(73, (0, 2))]
    assert extraction.list_issues(pages, limit=0).count() == 2


def test_bad_date_is_null(one):
    assert one(extraction.issue_date, "someday") is None


def test_extract_articles(spark):
    issues = spark.createDataFrame(
        [(7, (2, 9), ISSUE)], "num int, item_of struct<current:int,total:int>, html string"
    )
    rows = extraction.extract_articles(issues).collect()
    assert [(r.title, r.url, r.reading_time, r.summary, tuple(r.item_of)) for r in rows] == [
        ("Down & up", "https://a.b/c?x=1&y=2", 3, '"Told" by one of them.', (0, 4)),
        ("Nested", "https://n.o/1", 5, "Begun on and", (1, 4)),
        ("Bare", "/q", 0, "", (2, 4)),
    ]
    assert all(r.issue_num == 7 and tuple(r.parent_item_of) == (2, 9) for r in rows)


def test_sections_as_siblings(spark):
    flat = "<h3 class='topic-title'>A</h3><div>1</div><div>2</div><h3 class='topic-title'>B</h3><div><a class='post-title' href='u'>t</a></div>"
    issues = spark.createDataFrame(
        [(1, (0, 1), flat)], "num int, item_of struct<current:int,total:int>, html string"
    )
    assert [tuple(r.item_of) for r in extraction.extract_articles(issues).collect()] == [(0, 3)]


GOOD = "<html><body><article>" + "<p>A paragraph of some length.</p>" * 10 + "</article></body></html>"


def responses(spark, rows):
    return spark.createDataFrame(
        rows, "url string, status int, headers map<string,string>, body binary"
    )


LANDED = [
    ("http://p.org/", 200, {}, GOOD.encode(), "complete", GOOD),
    ("http://p.org/", 403, {}, GOOD.encode(), "needs_javascript", ""),
    ("http://p.org/", 503, None, GOOD.encode(), "needs_javascript", ""),
    ("http://p.org/", 200, {"Server": "any"}, GOOD.encode(), "needs_javascript", ""),
    ("http://p.org/", 200, {}, b"<p>Enable JavaScript, please</p>", "needs_javascript", ""),
    ("http://p.org/", 200, {}, (GOOD + "Cloudflare").encode(), "needs_javascript", ""),
    ("https://x.com/a", 403, {}, None, "complete", ""),
    ("https://a.medium.com/b", 200, {}, GOOD.encode(), "needs_javascript", ""),
    ("http://p.org/", 200, {}, None, "needs_javascript", ""),
    ("http://p.org/", None, None, GOOD.encode() + b"\xff", "complete", GOOD + "�"),
]


def test_route(spark):
    df = responses(spark, [case[:4] for case in LANDED]).coalesce(1)
    rows = routing.route(df, body="body", status="status", headers="headers").collect()
    assert [(r.route, r.content) for r in rows] == [case[4:] for case in LANDED]


def test_routes_are_disjoint_and_rejoin(spark):
    pages = spark.createDataFrame(
        [(i, f"http://p.org/{i % 3}", GOOD if i % 2 else "short") for i in range(12)],
        "id int, url string, html string",
    )
    routed = routing.route(pages)
    complete, waiting = routing.split_routes(routed)
    assert complete.count() == 6 and waiting.count() == 6
    rendered = spark.createDataFrame(
        [("http://p.org/0", "<a>"), ("http://p.org/0", "<b>")], "url string, html string"
    )
    merged = routing.merge_routes(routed, rendered)
    rows = sorted((r.id, r.route, r.content) for r in merged.collect())
    assert len(rows) == 12
    assert {c for i, _, c in rows if i % 2 == 0} == {"<b>", ""}


def test_complete_pages_takes_either_table(spark):
    landed = spark.createDataFrame(
        [("http://p.org/a", GOOD), ("http://p.org/b", "short"), ("http://p.org/c", None)],
        "url string, html string",
    )
    rendered = spark.createDataFrame(
        [(f"http://p.org/{n}", f"<p>{n}") for n in "abd"], "url string, html string"
    )
    rows = {r.url[-1]: (r.route, r.content) for r in routing.complete_pages(landed, rendered).collect()}
    assert rows == {
        "a": ("complete", GOOD), "b": ("needs_javascript", "<p>b"),
        "c": ("needs_javascript", ""), "d": ("needs_javascript", "<p>d"),
    }


def test_quality_columns(spark):
    df = routing.with_quality(spark.createDataFrame([(GOOD.encode(),)], "html binary"))
    row = df.first()
    assert row.content_length == row.text_length == len(GOOD)
    assert row.has_html_structure and row.has_article_content
    assert not row.is_blocked and not row.needs_javascript


def chunks_of(spark, text, **how):
    df = spark.createDataFrame([("p", "m", text)], "path string, meta string, text string")
    rows = chunking.split_documents(df, **how).orderBy("chunk_no").collect()
    assert all(r.path == "p" and r.meta == "m" for r in rows)
    assert [r.chunk_no for r in rows] == list(range(len(rows)))
    return [r.text for r in rows]


def test_chunks_hold_everything(spark):
    random.seed(5)
    words = ["".join(random.choices("abcdé\U0001f600", k=random.randint(1, 14))) for _ in range(900)]
    text = "".join(w + random.choice([" ", " ", " ", "\n", "\n\n"]) for w in words)
    for size, overlap in ((200, 50), (80, 10), (2000, 50)):
        chunks = chunks_of(spark, text, size=size, overlap=overlap)
        assert len(chunks) > 1 and all(0 < len(c) <= size for c in chunks)
        whole = [w for w in text.split()]
        seen = " ".join(chunks).split()
        at = 0
        for word in seen:
            # carried words repeat, none is lost or cut
            if at < len(whole) and word == whole[at]:
                at += 1
        assert at == len(whole)


def test_long_word_is_cut(spark):
    chunks = chunks_of(spark, "x" * 500, size=200, overlap=50)
    assert "".join(chunks) == "x" * 500


def test_short_and_blank_texts(spark):
    assert chunks_of(spark, "  short \n") == ["short"]
    assert chunks_of(spark, " \n ") == []


def test_chunks_break_at_blank_lines_first(spark):
    text = "# Head\n\n" + "a" * 60 + "\n" + "b" * 60 + "\n\n" + "c" * 100
    assert chunks_of(spark, text, size=150, overlap=10)[0] == text[:129]


def test_windows(spark):
    text = "".join(chr(97 + i % 26) for i in range(300))
    assert chunks_of(spark, text, size=100, overlap=20, fixed=True) == [
        text[0:100], text[80:180], text[160:260], text[240:300],
    ]
    assert chunks_of(spark, "", fixed=True) == [""]


def test_skip_existing_issues(spark):
    issues = spark.createDataFrame([(1,), (2,), (3,)], "num int")
    stored = spark.createDataFrame([(2,), (2,)], "issue_num int")
    kept = incremental.skip_existing_issues(issues, stored)
    assert sorted(r.num for r in kept.collect()) == [1, 3]
    assert incremental.skip_existing_issues(issues, stored, force_all=True).count() == 3


def test_skip_stored_chunks(spark):
    new = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1)], "path string, chunk_no int")
    stored = spark.createDataFrame([("a", 0)], "path string, chunk_no int")
    assert [tuple(r) for r in incremental.skip_stored_chunks(new, stored).collect()] == [("a", 1)]
    assert incremental.skip_stored_chunks(new, None).count() == 2


def test_vectors_have_length_one(spark):
    df = spark.createDataFrame([("Word word other",), ("",)], "text string")
    full, empty = (r.embedding for r in vectors.embed(df).collect())
    assert math.isclose(sum(x * x for x in full), 1, rel_tol=1e-6) and max(full) > 0.8
    assert set(empty) == {0.0} and len(full) == len(empty) == 64
    wide = vectors.embed(df, dim=200).first().embedding
    assert len(wide) == 200 and math.isclose(max(wide), 2 / math.sqrt(5), rel_tol=1e-6)


def test_embed_with_a_model(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "text string")
    made = vectors.embed_with(df, lambda: lambda texts: [[len(t), 0.5] for t in texts])
    assert [r.embedding for r in made.collect()] == [[2.0, 0.5], [1.0, 0.5]]


def points(spark, n, seed, copies=0, dim=8):
    random.seed(seed)
    rows = [(i, [random.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(copies)]
    random.shuffle(rows)
    return rows


def brute(queries, stored, k):
    out = []
    for qid, q in queries:
        ranked = sorted((math.dist(q, v), vid) for vid, v in stored)[:k]
        out += [(qid, i + 1, vid) for i, (_, vid) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("search", ["shipped", "beyond", "cells", "slices"])
def test_nearest_is_exact_with_copies(spark, search):
    stored = points(spark, 120, 1, copies=60)
    asked = points(spark, 30, 2) + [(99, next(v for i, v in stored if i == 0))]
    s = spark.createDataFrame(stored, "vec_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame(asked, "query_id long, query_vec array<double>")
    if search == "shipped":
        got = nearest.nearest(q, s)
    elif search == "beyond":
        got = nearest.nearest(q, s, shipped=10)
    elif search == "cells":
        got = nearest.nearest_by_cells(q, s, pivots=8)
    else:
        got = nearest.nearest_by_cells(q, s, pivots=8, rows_per_slice=7)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == brute(asked, stored, 4)


def test_nearest_with_few_or_no_vectors(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, query_vec array<double>")
    s = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0])], "vec_id string, embedding array<double>")
    for search in (nearest.nearest, nearest.nearest_by_cells):
        assert [r.vec_id for r in search(q, s).orderBy("rank").collect()] == ["a", "b"]
        assert search(q, s.limit(0)).count() == 0
        assert search(q.limit(0), s).count() == 0


def test_nearest_leaves_out_missing_vectors(spark):
    q = spark.createDataFrame([(1, None), (2, [1.0])], "query_id long, query_vec array<double>")
    s = spark.createDataFrame([(1, None), (2, [3.0])], "vec_id long, embedding array<double>")
    for search in (nearest.nearest, nearest.nearest_by_cells):
        assert [(r.query_id, r.vec_id, r.distance) for r in search(q, s).collect()] == [(2, 2, 2.0)]


def test_approximate_search_recall(spark):
    stored, asked = points(spark, 600, 3), points(spark, 40, 4)
    s = spark.createDataFrame(stored, "vec_id long, embedding array<double>")
    q = spark.createDataFrame(asked, "query_id long, query_vec array<double>")
    truth = {(a, c) for a, _, c in brute(asked, stored, 4)}

    def recall(probes):
        got = nearest.nearest_by_cells(q, s, pivots=16, probes=probes)
        return len({(r.query_id, r.vec_id) for r in got.collect()} & truth) / len(truth)

    assert 0.5 < recall(6) <= recall(16) == 1.0


def test_contexts_and_prompts(spark):
    queries = spark.createDataFrame([(1, "Why?"), (2, "How?")], "query_id int, query string")
    hits = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id int, vec_id string, rank int")
    chunks = spark.createDataFrame([("a", "A"), ("b", "B")], "vec_id string, text string")
    rows = {
        r.query_id: r
        for r in retrieval.with_prompts(retrieval.with_context(queries, hits, chunks)).collect()
    }
    assert rows[1].context == "B\n\nA" and rows[2].context == ""
    assert rows[1].user_prompt == (
        "Context:\nB\n\nA\n\nQuestion: Why?\n\n"
        "Please answer the question based primarily on the provided context"
    )
    assert rows[2].system_prompt.startswith("You are a helpful assistant")


TALK = [
    (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "user", "d"),
    (1, 9, "assistant", "e"), (2, 0, "system", "s"), (2, 1, "user", "  /BYE\t"),
    (2, 2, "assistant", "f"), (3, 5, "user", "bye"), (3, 4, "user", "exit now"),
]


@pytest.mark.parametrize("block_size", [1, 2, 3, 4096])
def test_question_answers(spark, block_size):
    turns = spark.createDataFrame(TALK, "conv_id int, turn int, role string, text string")
    rows = transcripts.question_answers(turns, block_size=block_size).collect()
    assert sorted((r.conv_id, r.question, r.answer) for r in rows if r.conv_id == 1) == [
        (1, "a", "b"), (1, "c", None), (1, "d", "e"),
    ]
    assert sorted((r.conv_id, r.question_turn, r.answer_turn) for r in rows if r.conv_id > 1) == [
        (2, 1, 2), (3, 4, None), (3, 5, None),
    ]


def test_until_exit(spark):
    turns = spark.createDataFrame(TALK, "conv_id int, turn int, role string, text string")
    rows = transcripts.until_exit(turns).collect()
    assert sorted((r.conv_id, r.turn) for r in rows) == [
        (1, 0), (1, 1), (1, 2), (1, 3), (1, 9), (2, 0), (3, 4),
    ]


def sequential(rows, period, last):
    slots, last = {}, dict(last)
    for domain, at, rid in sorted(rows):
        slot = max(at, last[domain] + period) if domain in last else at
        slots[rid] = last[domain] = slot
    return slots


@pytest.mark.parametrize("last", [{}, {"hot": 700, "d1": 10}])
def test_schedule_matches_a_loop(spark, last):
    random.seed(8)
    rows = [
        ("hot" if random.random() < 0.6 else f"d{random.randint(0, 9)}", random.randint(0, 3000), i)
        for i in range(400)
    ]
    requests = spark.createDataFrame(rows, "domain string, at_micros long, request_id long")
    known = (
        spark.createDataFrame(list(last.items()), "domain string, slot long") if last else None
    )
    made = politeness.schedule(requests, period=11, last_slots=known, slices=7)
    got = {r.request_id: r.slot for r in made.collect()}
    assert got == sequential(rows, 11, last)


def test_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "path string")
    rows = reports.count_by(df, "chunks", "path").collect()
    assert sorted(tuple(r) for r in rows) == [("chunks", "a", 2), ("chunks", "b", 1)]
    same, seen = reports.observed(df, "load")
    same.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3}


def test_bad_vectors_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    stored = [(n, [float(n), 0.0, 0.0, 0.0]) for n in range(30)]
    bad = [(100, [nan, 0.0, 0.0, 0.0]), (101, [0.0, None, 0.0, 0.0]), (102, [0.0, 0.0, 0.0]), (103, [0.0] * 5), (104, None), (105, []), (106, [inf, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(bad[:4] + stored + bad[4:], "vec_id long, embedding array<double>").coalesce(1)
    asked = [(1, [4.2, 0.0, 0.0, 0.0]), (2, [nan] * 4), (3, [1.0]), (4, None), (5, [20.0, 0.0, None, 0.0])]
    queries = spark.createDataFrame(asked, "query_id long, query_vec array<double>")
    for search in (nearest.nearest, nearest.nearest_by_cells):
        rows = search(queries, vectors, 2).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in rows) == [(1, 1, 4), (1, 2, 5)]


def test_one_chunk_per_key_whatever_the_run(spark):
    rows = [("p", 1, "b"), ("p", 1, "a"), ("p", 2, "c"), (None, 1, "d"), ("q", 1, "e")]
    chunks = spark.createDataFrame(rows, "path string, chunk_no int, text string")
    stored = chunks.filter("path = 'q'")
    found = {tuple(sorted(map(tuple, incremental.skip_stored_chunks(chunks.repartition(n), stored).collect()))) for n in (1, 3, 7)}
    assert len(found) == 1 and [r[:2] for r in found.pop()] == [("p", 1), ("p", 2)]


def test_first_by_key_tells_nulls_apart(spark):
    from pressmill.operators.incremental import first_by_key

    rows = [(1, None, "x"), (1, "x", None), (1, None, None), (1, "x", "x")]
    found = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, "k int, a string, b string").repartition(3)
        found.add(tuple(first_by_key(df, ["k"]).first()))
    assert len(found) == 1
    assert first_by_key(spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"]).count() == 2


def test_released_tables_are_gone(spark):
    import os

    from pressmill.session import frozen, released

    kept, gone = frozen(spark.range(5)), frozen(spark.range(6))
    released(gone, spark.range(1))
    assert kept.count() == 5 and os.path.isdir(kept._frozen_at) and not os.path.isdir(gone._frozen_at)
