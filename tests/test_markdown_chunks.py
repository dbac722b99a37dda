"""Chunks of Markdown: breaks at headings, whole fences and tables, nothing lost."""

import random
import re

from pressmill.operators import markdown_chunks as m

SIZE, OVERLAP = 120, 10


def cut(each, texts, size=SIZE, overlap=OVERLAP):
    return each(lambda c: m.markdown_sections(c, size, overlap), texts)


def test_breaks_come_before_headings(each):
    text = "intro " * 8 + "\n\n" + "# One\n\n" + "word " * 14 + "\n\nmore text here\n## Two\n" + "last " * 15
    chunks = cut(each, [text])[0]
    assert [chunk.split("\n")[0][:5] for chunk in chunks] == ["intro", "# One", "## Tw"]
    assert all(len(chunk) <= SIZE for chunk in chunks)


def test_a_heading_wins_over_a_later_blank_line(each):
    text = "a" * 30 + "\n# Head\n" + "b" * 30 + "\n\n" + "c" * 100
    assert cut(each, [text])[0][:2] == ["a" * 30, "# Head\n" + "b" * 30]


def test_a_heading_stays_with_what_follows(each):
    text = "x" * 60 + "\n\n## Head\n\n" + "long words " * 30
    chunks = cut(each, [text])[0]
    assert chunks[1].startswith("## Head\n\nlong words")


def test_fences_and_tables_that_fit_stay_whole(each):
    fence = "```py\n# not a heading\n\na = 1\n\nb = 2\n```"
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"
    nested = "~~~~\n```\n~~~\n# no heading\n~~~~"
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        parts = rng.choices([fence, table, nested, "some words of text " * 3, "# Head", "---", "", "one line"], k=12)
        texts.append("\n".join(parts) + "\n" + "end " * 40)
    for text, chunks in zip(texts, cut(each, texts), strict=True):
        for whole in (fence, table, nested):
            wanted = text.count(whole)
            tables_joined = whole == table and (table + "\n" + table) in text
            if not tables_joined:
                assert sum(chunk.count(whole) for chunk in chunks) == wanted, (text, chunks)
        assert all(len(chunk) <= SIZE for chunk in chunks)


def test_what_does_not_fit_is_cut_at_its_lines(each):
    fence = "```\n" + "".join(f"line {n} of the code\n" for n in range(20)) + "```"
    chunks = cut(each, [fence])[0]
    assert len(chunks) > 3 and all(re.fullmatch(r"(```|line \d+ of the code)", line) for chunk in chunks for line in chunk.split("\n"))
    table = "".join(f"| cell {n} | of a long table |\n" for n in range(20))
    chunks = cut(each, [table])[0]
    assert len(chunks) > 3 and all(line.startswith("| cell") and line.endswith("|") for chunk in chunks for line in chunk.split("\n"))
    assert "".join(chunk + "\n" for chunk in chunks) == table


def test_an_open_fence_goes_to_the_end(each):
    text = "word " * 20 + "\n```\ncode\n# no heading\n" + "more code\n" * 20
    assert not any(chunk.startswith("# no heading") for chunk in cut(each, [text])[0])


def test_nothing_is_lost(each):
    rng = random.Random(2)
    parts = ["# h", "###### six", "####### seven", "#no", "```", "~~~", "````x", "| r |", "---", "***", "", "", "  ", "words and more words", "x" * 150, "é", "\t"]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(200)]
    for text, chunks in zip(texts, cut(each, texts, 100, 0), strict=True):
        assert re.sub(r"\s", "", "".join(chunks)) == re.sub(r"\s", "", text)
        assert all(0 < len(chunk) <= 100 for chunk in chunks)
    for text, chunks in zip(texts, cut(each, texts, 100, 12), strict=True):
        assert all(0 < len(chunk) <= 100 for chunk in chunks)


def test_overlap_keeps_to_plain_text(each):
    text = "alpha beta gamma " * 12 + "\n```\n" + "code here\n" * 14 + "```\n# Head\nend words go here " * 4
    chunks = cut(each, [text])[0]
    assert chunks[1].startswith(("beta", "gamma", "alpha"))
    assert not any("code here" in chunk and "# Head" in chunk and chunk.index("code here") < chunk.index("# Head") and "```" not in chunk for chunk in chunks)


def test_defined_results(each):
    assert cut(each, [None, "", " \n\t", "short", "a﷑b " * 40]) [:4] == [None, [], [], ["short"]]
    odd = cut(each, ["a﷑b " * 40])[0]
    assert all("﷑" in chunk for chunk in odd)


def test_heading_paths(each):
    text = "intro\n" + "w " * 50 + "\n# A\n" + "w " * 50 + "\n## B\n```\n# no\n```\n" + "w " * 50 + "\n### C ##\n" + "w " * 50 + "\n## D\n" + "w " * 50 + "\n# E\n" + "w " * 60
    paths = each(lambda c: m.heading_paths(c, SIZE, OVERLAP), [text, "# x", None])
    assert paths[1] == [[]] and paths[2] is None
    assert paths[0][0] == [] and ["A"] in paths[0] and ["A", "B"] in paths[0] and ["A", "B", "C"] in paths[0] and ["A", "D"] in paths[0]
    assert paths[0][-1] == ["E"] and not any("no" in path for path in paths[0])
