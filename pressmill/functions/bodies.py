"""Bytes of a response: compression, content type, decoding."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.functions.text import let, strip, sub

REPLACEMENT = "�"

# Charset labels by how their bytes are read. Windows-1252 is
# Latin-1 with 27 printable characters in place of C1 controls, Latin-9 is
# Latin-1 with eight characters replaced.
UTF8_LABELS = ["utf-8", "utf8", "iso-8859-1"]
LATIN1_LABELS = ["latin-1", "latin1", "l1", "iso8859-1"]
ASCII_LABELS = ["us-ascii", "ascii"]
CP1252_LABELS = ["windows-1252", "cp1252"]
LATIN9_LABELS = ["iso-8859-15", "latin-9", "latin9"]
UTF16_LABELS = ["utf-16le", "utf-16be"]
NATIVE_LABELS = UTF8_LABELS + LATIN1_LABELS + ASCII_LABELS + CP1252_LABELS + LATIN9_LABELS
CP1252_FROM = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_TO = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
LATIN9_FROM = "¤¦¨´¸¼½¾"
LATIN9_TO = "€ŠšŽžŒœŸ"


def header(headers: Column, name: str) -> Column:
    """Value of a header whatever the case of its name; NULL when absent."""
    entries = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(entries, F.lit(1))["value"]


def declared_charset(headers: Column) -> Column:
    value = F.regexp_extract(
        header(headers, "content-type"), r"(?i);\s*charset\s*=\s*[\"']?([^\s;\"']+)", 1
    )
    return F.nullif(F.lower(value), F.lit(""))


def valid_utf8(body: Column) -> Column:
    """UTF-8 text with every malformed sequence replaced."""
    return F.make_valid_utf8(body.cast("string"))


def lenient_utf8(body: Column) -> Column:
    """UTF-8 text with every malformed sequence left out."""
    return F.replace(valid_utf8(body), F.lit(REPLACEMENT), F.lit(""))


def decode_body(body: Column, charset: Column) -> Column:
    """Text of a body under its declared charset.

    A missing label and ISO-8859-1, which servers send when they do not know, are
    read as UTF-8. Single-byte families that differ from Latin-1 by a few signs are
    translated; any other label is a codec of Python's, asked in Arrow batches for
    the rows that declare one. Damaged units are replaced one by one; a label no
    codec knows is read as UTF-8.
    """
    other = charset.isNotNull() & ~charset.isin(*NATIVE_LABELS)
    coded = by_codec(F.when(other, body), F.when(other, charset))
    latin1 = F.decode(body, "ISO-8859-1")
    cp1252 = F.translate(sub(latin1, "[\x81\x8d\x8f\x90\x9d]", REPLACEMENT), CP1252_FROM, CP1252_TO)
    return (
        F.when(charset.isin(*LATIN1_LABELS), latin1)
        .when(charset.isin(*CP1252_LABELS), cp1252)
        .when(charset.isin(*LATIN9_LABELS), F.translate(latin1, LATIN9_FROM, LATIN9_TO))
        .when(charset.isin(*ASCII_LABELS), sub(latin1, "[\x80-\xff]", REPLACEMENT))
        .when(other, coded)
        .otherwise(valid_utf8(body))
    )


@F.arrow_udf(T.StringType())
def by_codec(body: pa.Array, charset: pa.Array) -> pa.Array:
    """Text of bytes under the codec of that name, with replacement characters; UTF-8 where there is none."""
    texts = []
    for data, label in zip(body.to_pylist(), charset.to_pylist(), strict=True):
        if data is None or label is None:
            texts.append(None)
            continue
        try:
            text = data.decode(label, errors="replace")
        except (LookupError, UnicodeError, ValueError):
            text = data.decode("utf-8", errors="replace")
        texts.append(text.encode("utf-8", "replace").decode("utf-8") if isinstance(text, str) else None)
    return pa.array(texts, pa.string())


def compression(body: Column) -> Column:
    """Kind of compression the first bytes tell of, or NULL."""

    def starts(*prefixes: bytes) -> Column:
        size = len(prefixes[0])
        return F.substring(body, 1, size).isin(*[F.lit(p) for p in prefixes])

    return (
        F.when(starts(b"\x1f\x8b"), "gzip")
        .when(starts(b"BZh"), "bzip2")
        .when(starts(b"\x78\x9c", b"\x78\x01", b"\x78\xda"), "zlib")
    )


def content_type(headers: Column, body: Column) -> Column:
    declared = strip(F.substring_index(F.lower(header(headers, "content-type")), ";", 1))
    named = F.lower(header(headers, "content-type"))

    def sniff(head: Column) -> Column:
        return (
            F.when(head.startswith("<!doctype html") | head.contains("<html"), "text/html")
            .when(head.startswith("{") | head.startswith("["), "application/json")
            .when(head.startswith("<?xml"), "application/xml")
            .otherwise("text/plain")
        )

    sniffed = let(F.lower(lenient_utf8(F.substring(body, 1, 1000))), sniff)
    return (
        F.when(F.coalesce(named, F.lit("")) != "", declared)
        .when(body.isNull(), "unknown")
        .otherwise(sniffed)
    )
