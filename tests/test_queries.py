"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

SF_DIR = "/root/testdata/sf0.001"
FEW = [
    "url_domains",
    "page_routes",
    "page_markdown",
    "clean_documents",
    "issue_articles",
    "chunk_sections",
    "nearest_vectors",
    "question_prompts",
    "chat_answers_small_blocks",
    "polite_schedule",
    "merged_pages",
    "response_bodies",
    "nearest_dirty",
    "nearest_approximate",
    "dirty_page_markdown",
    "article_files",
    "merged_articles",
    "bucketed_chunks",
    "stream_files",
    "stream_counts",
]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not there")
def test_queries_match_their_sql(spark):
    from checks import compare

    assert compare.main(SF_DIR, FEW) == 0


def test_contract():
    import __spark_entry__ as contract

    without = set(contract.queries()) - set(contract.oracle_sql())
    assert {name for name in without if not name.startswith("op") and name != "pipeline"} == set()
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not there")
def test_entry(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark).collect()
    assert len(rows) == 40 and all(r.context and r.user_prompt for r in rows)
