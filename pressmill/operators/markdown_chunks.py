"""Chunks of Markdown cut where its structure allows, inside the row.

A text is scanned once for fenced code and lines. The line end behind each of these
gets a mark that tells how good a break it is, put in its place, so that lengths
stay; runs of the greatest length in reach are then cut at their last mark of the
best kind. From best to worst: before a heading, at the border of a fence or a
rule, at a blank line, at a line end, inside a fence or table, at a space, behind a
heading. So a fence or table that fits into a chunk is never cut, and a heading
stays with what follows it unless that has no other break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions.text import explode_positions, find_all, is_blank, let, strip
from pressmill.operators.chunking import CHUNK_SIZE, OVERLAP, sections

#: Marks for line ends: characters that Unicode sets aside for use inside a program.
INSIDE, HEADING, EDGE, UNDER = (chr(0xFDD0 + n) for n in range(4))
MARKS = INSIDE + HEADING + EDGE + UNDER


def _fence(sign: str, count: str, close: str) -> str:
    """A fence whose opening has ``count`` signs, up to a line of ``close`` signs and nothing else."""
    return rf" {{0,3}}{sign}{count}[^{sign}\n]*(?s:.*?)\n {{0,3}}{sign}{close}[ \t]*(?:\n|\z)"


#: Closed fences (the longest openings first), a fence that is never closed, any other line.
FENCES = [_fence(sign, f"{{{n}}}" if n < 5 else "{5,}", f"{{{n},}}") for sign in "`~" for n in (5, 4, 3)]
OPEN_FENCE = r" {0,3}(?:`{3,}[^`\n]*|~{3,}[^~\n]*)(?:\n(?s:.*))?\z"
UNITS = "|".join([*FENCES, OPEN_FENCE, r"[^\n]*\n", r"[^\n]+\z"])
IS_FENCE = r"^ {0,3}(?:`{3,}[^`\n]*|~{3,}[^~\n]*)(?:\n|\z)"
IS_HEADING = r"^#{1,6}(?:[ \t\n]|\z)"
IS_RULE = r"^ {0,3}(?:\*{3,}|-{3,}|_{3,})[ \t]*\n?\z"
IS_ROW = r"^ {0,3}\|"


def marked(text: Column) -> Column:
    """The text with marks in the place of the line ends that aren't plain ones."""

    def kinds(units: Column) -> Column:
        return F.transform(
            units,
            lambda u: F.when(u.rlike(IS_FENCE), "f").when(u.rlike(IS_HEADING), "h").when(u.rlike(IS_RULE), "r").when(u.rlike(IS_ROW), "t").when(u == "\n", "b").otherwise("l"),
        )

    def behind(units: Column, names: Column) -> Column:
        """What the line end behind each unit becomes; a blank line belongs to the heading it follows."""
        letters = F.array_join(names, "")

        def one(unit: Column, n: Column) -> Column:
            here, after = F.substring(letters, n + 1, F.lit(1)), F.substring(letters, n + 2, F.lit(1))
            before = F.substring(letters, n, F.lit(1))
            mark = (
                F.when(after == "h", HEADING)
                .when(here.isin("f", "r") | after.isin("f", "r"), EDGE)
                .when((here == "t") & (after == "t"), INSIDE)
                .when((here == "h") | ((here == "b") & (n > 0) & (before == "h")), UNDER)
                .otherwise("\n")
            )
            body = F.regexp_replace(unit, r"\n\z", "")
            inner = F.when(here == "f", F.translate(body, "\n", INSIDE)).otherwise(body)
            return F.when(unit.endswith("\n"), F.concat(inner, mark)).otherwise(inner)

        return F.array_join(F.transform(units, one), "")

    return let(find_all(text, UNITS), lambda units: let(kinds(units), lambda names: behind(units, names)))


def _tail(before: Column, overlap: int) -> Column:
    """The whole words that end a run, back to the last mark: never part of a fence, table or heading."""
    near = F.substring(before, -overlap - 1, overlap + 1)
    kept = F.when(F.length(before) <= overlap, before).otherwise(F.regexp_extract(near, r"(?s)[ \n](.*)\z", 1))
    return F.regexp_extract(kept, rf"([^{MARKS}]*)\z", 1)


def _runs(text: Column, size: int, overlap: int) -> Column:
    """Runs of a marked text."""
    reach = size - overlap
    breaks = [HEADING, EDGE, r"\n\n", r"\n", INSIDE, " ", UNDER]
    ends = [rf".{{0,{reach - (2 if mark == breaks[2] else 1)}}}{mark}" for mark in breaks]
    return find_all(text, "(?s)" + "|".join([rf".{{1,{reach}}}+\z", *ends, rf".{{1,{reach}}}"]))


def markdown_sections(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks of Markdown, at most ``size`` characters each.

    A text that fits is one chunk, a blank or NULL one none. A chunk starts with up
    to ``overlap`` characters of whole words from before it, unless it begins at a
    heading, a fence or a rule, or inside a fence or table. Nothing but white space
    at the ends of chunks is lost. Texts that hold one of the marks themselves are
    cut by ``sections``.
    """

    def chunks(runs: Column) -> Column:
        carried = F.transform(runs, lambda r, n: F.when(n == 0, r).otherwise(F.concat(_tail(F.element_at(runs, n), overlap), r)))
        plain = F.transform(carried, lambda c: strip(F.translate(c, MARKS, "\n" * len(MARKS))))
        return F.filter(plain, lambda c: c != "")

    return (
        F.when(is_blank(text), F.array().cast("array<string>"))
        .when(F.length(text) <= size, F.array(strip(text)))
        .when(text.rlike(f"[{MARKS}]"), sections(text, size, overlap))
        .otherwise(let(let(marked(text), lambda m: _runs(m, size, overlap)), chunks))
    )


def heading_paths(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """For each run of a Markdown text the headings in force where it starts, outermost first.

    One array for the one run of a text that fits. A heading ends those of its own
    and deeper levels. Runs are those that ``markdown_sections`` makes chunks of,
    blank ones too.
    """
    levels = F.sequence(F.lit(1), F.lit(6))
    none = F.array_repeat(F.lit(None).cast("string"), 6)

    def under(stack: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, "^(#{1,6})", 1))
        title = F.regexp_extract(line, r"^#{1,6}[ \t]*(.*?)[ \t#]*$", 1)
        return F.transform(levels, lambda n: F.when(n < level, F.get(stack, n - 1)).when(n == level, title))

    def headings(run: Column, first: Column) -> Column:
        """Heading lines: behind their mark, at the start of a run behind one, or of the text."""
        begun = F.concat(F.when(first, F.lit(HEADING)).otherwise(F.lit("")), run)
        return F.regexp_extract_all(begun, F.lit(rf"{HEADING}(#{{1,6}}(?:[ \t][^\n{MARKS}]*)?)(?=[\n{MARKS}]|\z)"), F.lit(1))

    def paths(runs: Column) -> Column:
        start = F.struct(none.alias("stack"), F.lit(True).alias("first"), F.array().cast("array<array<string>>").alias("out"))

        def step(state: Column, run: Column) -> Column:
            stack = F.aggregate(headings(run, state["first"]), state["stack"], under)
            return F.struct(stack.alias("stack"), run.endswith(HEADING).alias("first"), F.concat(state["out"], F.array(state["stack"])).alias("out"))

        return F.aggregate(runs, start, step, lambda state: F.transform(state["out"], lambda stack: F.filter(stack, lambda t: t.isNotNull())))

    cut = F.when(F.length(text) <= size, F.array(text)).otherwise(_runs(marked(text), size, overlap))
    return let(cut, paths)


def split_markdown(documents: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk of Markdown; every other column is copied to each chunk."""
    keep = [name for name in documents.columns if name != text]
    return explode_positions(documents, keep, markdown_sections(F.col(text), size, overlap), "chunk_no", text)
