"""Documents to chunks. Both cuts are made inside the row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions.text import explode_positions, find_all, is_blank, let, strip

CHUNK_SIZE = 2000
OVERLAP = 50


def windows(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Fixed windows of ``size`` characters, each starting in the one before."""
    step = size - overlap
    count = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)), F.lit(1))
    starts = F.sequence(F.lit(0), (count - 1).cast("int"))
    return F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size)))


def sections(text: Column, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> Column:
    """Chunks cut at the strongest break within reach.

    A text that fits is one chunk. Otherwise it is cut into runs of at most
    ``size - overlap`` characters, each ending with the text, else at the last
    blank line in reach, else the last line end, else the last space, else anywhere; each chunk then
    starts with the whole words, up to ``overlap`` characters, that end the run
    before it. Runs put together give the text back, so nothing is lost.
    """
    reach = size - overlap
    run = "(?s)" + "|".join(
        [rf".{{1,{reach}}}+\z", rf".{{0,{reach - 2}}}\n\n", rf".{{0,{reach - 1}}}\n", rf".{{0,{reach - 1}}} "]
        + [rf".{{1,{reach}}}"]
    )

    def tail(before: Column) -> Column:
        # whole words only: a word reaching back beyond the overlap stays out
        near = F.substring(before, -overlap - 1, overlap + 1)
        kept = F.regexp_extract(near, r"(?s)[ \n](.*)\z", 1)
        return F.when(F.length(before) <= overlap, before).otherwise(kept)

    def carry(runs: Column) -> Column:
        chunks = F.transform(
            runs,
            lambda r, i: F.when(i == 0, r).otherwise(F.concat(tail(F.element_at(runs, i)), r)),
        )
        return F.filter(F.transform(chunks, strip), lambda c: c != "")

    cut = let(find_all(text, run), carry)
    return (
        F.when(is_blank(text), F.array().cast("array<string>"))
        .when(F.length(text) <= size, F.array(strip(text)))
        .otherwise(cut)
    )


def split_documents(
    documents: DataFrame,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    fixed: bool = False,
) -> DataFrame:
    """One row per chunk; every other column is copied to each chunk."""
    cut = windows if fixed else sections
    keep = [c for c in documents.columns if c != text]
    return explode_positions(
        documents, keep, cut(F.col(text), size, overlap), "chunk_no", text
    )
