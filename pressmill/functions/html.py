"""HTML to Markdown, mostly with built-in expressions.

Elements that are left out go first: those nest, which patterns can't follow, so
pages that have any are walked tag by tag in Arrow batches. Then the text is cut
into units (tags, text runs, and whole ``pre``, ``code`` and ``a`` elements), each
unit is rewritten by itself, and the joined result goes through a short chain of
replacements. Elements that HTML leaves open are closed where their container
ends. Among what is kept, elements nested in one of the same name are told apart
for unordered lists only.
"""

from __future__ import annotations

import re
from collections import Counter
from html.entities import html5, name2codepoint

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.functions.markdown import clean_twice
from pressmill.functions.nesting import NUMBER_CLOSE, NUMBER_OPEN, unnested
from pressmill.functions.text import contains_any, find_all, fixed_map, is_blank, let, strip, sub, sub_where

# What is left out with its contents.
DROPPED_TAGS = [
    "head",
    "nav",
    "footer",
    "iframe",
    "form",
    "header",
    "aside",
    "button",
    "noscript",
    "svg",
    "path",
]
DROPPED_CLASSES = [
    "nav",
    "footer",
    "sidebar",
    "ads",
    "comments",
    "social-share",
    "related-posts",
    "subscription",
]
DROPPED_ROLES = ["navigation", "complementary"]
# Fixed values of HTML: elements without contents, and those that end where one of
# the second list begins, up to the element of the third that holds them.
EMPTY_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
BLOCKS = (
    "h[1-6]|p|blockquote|article|div|section|ol|ul|li|dl|dt|dd|"
    "table|thead|tbody|tfoot|tr|td|th|pre"
)

TAGS = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
MARKED = re.compile(r"""(?i)(?<![^\s"'])(class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TAG = r"</?[a-zA-Z][^>]*>|<[!?][^>]*>"
# Private characters that stand for a tag between two steps.
STRONG_OPEN, STRONG_CLOSE = "\ue000", "\ue001"
EM_OPEN, EM_CLOSE = "\ue002", "\ue003"
BLOCK_OPEN, BLOCK_CLOSE = "\ue004", "\ue005"
LI_OPEN, LI_CLOSE = "\ue006", "\ue007"
QUOTE_OPEN, QUOTE_CLOSE = "\ue008", "\ue009"
ANGLE_OPEN, ANGLE_CLOSE = "\ue00a", "\ue00b"
SCOPE_END = "\ue00c"
LIST_OPEN, LIST_CLOSE = "\ue00d", "\ue00e"
GAP = r"[ \t\r\n]"
#: All characters that stand for something between two steps.
PRIVATE = [chr(code) for code in range(0xE000, 0xE011)]
#: The marks that more is to be done for than to take them out.
WORKED_ON = f"[{STRONG_OPEN}-{EM_CLOSE}{LI_OPEN}-{ANGLE_CLOSE}{LIST_OPEN}{LIST_CLOSE}]"


def _open(names: str) -> str:
    """Opening tag after its angle bracket."""
    return rf"(?:{names})(?:[\s/][^>]*)?>"


def close_tag(names: str) -> str:
    return rf"</(?:{names})\s*>"


def open_tag(names: str) -> str:
    return f"<{_open(names)}"


def _to_end(name: str) -> str:
    """Rest of an element after ``<``, unless it is self-closed; one that is never closed runs to the end."""
    return rf"{name}(?:[\s/][^>]*)?(?<!/)>.*?(?:{close_tag(name)}|\z)"


def _closed(name: str) -> str:
    """Rest of an element that is closed, after ``<``."""
    return rf"{_open(name)}.*?{close_tag(name)}"


# Each pattern opens with one plain character, which lets a scan skip quickly.
REST_OF_TAG = r"/?[a-zA-Z][^>]*>|[!?][^>]*>"
MAY_HIDE = "(?i)<(?:!--|script|style)"
UNSEEN = "(?is)<(?:!--.*?-->|" + "|".join(_to_end(t) for t in ("script", "style")) + ")"
SEEN_LAST = re.compile(UNSEEN.replace(r"\z", r"\Z"))
# References that HTML knows without a closing semicolon, long ones first.
UNENDED = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
NESTING = ["ol|ul", "table", "b|strong", "i|em"]
MAY_WALK = (
    rf"(?is)<(?:(?:{'|'.join(DROPPED_TAGS)})[\s/>]|!--|script|style|"
    + "|".join(rf"(?:{names})[\s/>].*<(?:{names})[\s/>]" for names in NESTING)
    + ")"
)
MARKED_TAG = r"(?i)[\s\"'](?:class|role)\s*="
UNITS = "(?is)[^<]+|<(?:" + "|".join(_closed(t) for t in ("pre", "code", "a")) + f"|{REST_OF_TAG})|<"
BLOCK_UNITS = "(?is)[^<]+|<(?:" + "|".join(
    _closed(t) for t in ("table", "ol", *(f"h{n}" for n in range(1, 7)))
) + f"|{REST_OF_TAG})|<"
# Units that become more than a mark or stay what they are.
SPECIAL = r"(?i)\A<(?:a|pre|code|img)[\s/>]"
SPECIAL_BLOCK = r"(?i)\A<(?:h[1-6]|ol|table)[\s/>]"
# White space beside a tag; one plain set of signs first.
BESIDE_TAG = rf"[<>](?:(?<={GAP}<)|(?<=>){GAP})"
# What a tag becomes; any other tag leaves nothing but its text.
MARKS = {
    "<p": f"{BLOCK_OPEN}\n\n",
    "</p": f"{BLOCK_CLOSE}\n\n",
    "<ul": f"{BLOCK_OPEN}{LIST_OPEN}",
    "</ul": f"{LIST_CLOSE}{BLOCK_CLOSE}",
    **{f"<{t}": BLOCK_OPEN for t in ("div", "dl", "dt", "dd")},
    **{f"</{t}": BLOCK_CLOSE for t in ("div", "dl", "dt", "dd")},
    **{f"</{t}": SCOPE_END for t in ("article", "section", "main", "body", "html")},
    **{f"<{t}": STRONG_OPEN for t in ("b", "strong")},
    **{f"</{t}": STRONG_CLOSE for t in ("b", "strong")},
    **{f"<{t}": EM_OPEN for t in ("i", "em")},
    **{f"</{t}": EM_CLOSE for t in ("i", "em")},
    "<li": f"{BLOCK_OPEN}{LI_OPEN}",
    "</li": f"{LI_CLOSE}{BLOCK_CLOSE}",
    "<blockquote": f"{BLOCK_OPEN}{QUOTE_OPEN}",
    "</blockquote": f"{QUOTE_CLOSE}{BLOCK_CLOSE}",
}


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in an opening tag, '' when absent."""
    value = F.regexp_extract(
        tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0
    )
    bare = sub(value, r"(?s)\A\s[^=]*=\s*", "")
    return F.btrim(bare, F.lit("\"'"))


def strip_tags(html: Column) -> Column:
    return sub(html, TAG, "")


def without_unseen(html: Column) -> Column:
    """Comments, scripts and styles taken out."""
    return let(html, lambda h: F.when(h.rlike(MAY_HIDE), sub(h, UNSEEN, "")).otherwise(h))


def _is_dropped(name: str, rest: str) -> bool:
    """Whether an element goes, by its tag or by a class or role."""
    if name in DROPPED_TAGS:
        return True
    for key, *values in MARKED.findall(rest):
        value = next((v for v in values if v), "").lower()
        if key.lower() == "role" and value.strip() in DROPPED_ROLES:
            return True
        if key.lower() == "class" and not set(value.split()).isdisjoint(DROPPED_CLASSES):
            return True
    return False


def drop_elements(html: str) -> str:
    """A page without its unseen and dropped elements, by a walk over the tags with the open elements on a stack.

    A closed-by-itself or empty element is its tag alone; an element ends with
    the one it lies in, and where its kind can't go on; one never closed at the
    top runs to the end.
    """
    html = SEEN_LAST.sub("", html)
    kept: list[str] = []
    open_: list[str] = []
    held: Counter = Counter()
    at, dropped = 0, None

    def cut(depth: int) -> None:
        while len(open_) > depth:
            held[open_.pop()] -= 1

    for tag in TAGS.finditer(html):
        closing, name, rest = tag[1], (tag[2] or "").lower(), tag[3] or ""
        if not name:
            continue
        if closing:
            if not held[name]:
                continue
            depth = len(open_) - 1 - open_[::-1].index(name)
            cut(depth)
            if dropped is not None and depth <= dropped:
                at = tag.end() if depth == dropped else tag.start()
                dropped = None
            continue
        if name in ENDED_BY:
            ended, within = ENDED_BY[name]
            depth = len(open_)
            for place in range(len(open_) - 1, -1, -1):
                if open_[place] in within:
                    break
                if open_[place] in ended:
                    depth = place
            cut(depth)
            if dropped is not None and depth <= dropped:
                at, dropped = tag.start(), None
        alone = name in EMPTY_TAGS or rest.endswith("/")
        if dropped is None and _is_dropped(name, rest):
            kept.append(html[at : tag.start()])
            if alone:
                at = tag.end()
                continue
            dropped = len(open_)
        if not alone:
            open_.append(name)
            held[name] += 1
    if dropped is None:
        kept.append(html[at:])
    return "".join(kept)


@F.arrow_udf(T.StringType())
def without_dropped(html: pa.Array) -> pa.Array:
    """``drop_elements`` and ``unnested`` of each page, in Arrow batches: nesting is beyond patterns."""
    return pa.array([None if page is None else unnested(drop_elements(page)) for page in html.to_pylist()], pa.string())


def without_private(html: Column) -> Column:
    """Private characters of the page's own, as references that are decoded at the end."""
    out = html
    for one in PRIVATE:
        out = F.replace(out, F.lit(one), F.lit(f"&#{ord(one)};"))
    # the first two bytes of all of them, sought before the text is decoded
    may = F.contains(html.cast("binary"), F.lit(PRIVATE[0].encode()[:2]))
    return F.when(may & html.rlike(f"[{PRIVATE[0]}-{PRIVATE[-1]}]"), out).otherwise(html)


def is_walked(html: Column) -> Column:
    """Whether a page may have elements to leave out, or nested ones of a kind."""
    lower = F.lower(html)
    marked = html.contains("=") & contains_any(lower, ["class", "role"]) & html.rlike(MARKED_TAG)
    return html.rlike(MAY_WALK) | marked


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, each decoded once."""
    common = {n: chr(c) for n, c in sorted(name2codepoint.items())}
    names = fixed_map(common | {n[:-1]: text for n, text in sorted(html5.items()) if n.endswith(";")})

    def character(code: Column) -> Column:
        usable = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        # guarded so that no bytes outside the character set reach decode
        safe = F.when(usable, code).otherwise(F.lit(0xFFFD))
        return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")

    def one(unit: Column) -> Column:
        name = F.btrim(unit, F.lit("&;"))
        digits = F.regexp_replace(name, r"\A#[xX]?0*", "")
        short = F.length(digits) <= 7
        decimal = F.when(short, F.concat(F.lit("0"), digits).try_cast("long")).otherwise(0)
        hexadecimal = F.when(short, F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("long")).otherwise(0)
        return (
            F.when(~unit.startswith("&"), unit)
            .when(unit.rlike(r"\A&#[0-9]+;\z"), character(decimal))
            .when(unit.rlike(r"\A&#[xX]"), character(hexadecimal))
            .otherwise(F.coalesce(F.try_element_at(names, name), unit))
        )

    pattern = r"&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&[a-zA-Z][a-zA-Z0-9]*;|" + f"&(?:{UNENDED})(?![=a-zA-Z0-9;])|[^&]+|&"

    def decoded(t: Column) -> Column:
        return F.array_join(F.transform(find_all(t, pattern), one), "")

    return let(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def visible_text(html: Column) -> Column:
    """Text of an element: tags off, every text run trimmed, runs joined."""

    def joined(h: Column) -> Column:
        runs = find_all(F.concat(F.lit(">"), h), r">([^<>]+)", 1)
        return F.when(contains_any(h, ["<", ">"]), F.array_join(F.transform(runs, strip), "")).otherwise(strip(h))

    return strip(decode_entities(let(html, joined)))


def _plain_text(run: Column) -> Column:
    """White space as a browser shows it, Markdown characters escaped."""
    ended = sub_where(run, ["\n", "\r"], r"[ \t\r\n]*[\r\n][ \t\r\n]*", "\n")
    spaced = sub_where(ended, ["  ", "\t"], r"[ \t]{2,}|\t", " ")
    return sub_where(spaced, ["*", "_"], r"([*_])", r"\\$1")


def _image(tag: Column) -> Column:
    title = attribute(tag, "title")
    tail = F.when(title == "", "").otherwise(F.concat(F.lit(' "'), title, F.lit('"')))
    return F.concat(
        F.lit("!["), attribute(tag, "alt"), F.lit("]("), attribute(tag, "src"), tail, F.lit(")")
    )


def _small(unit: Column) -> Column:
    """A tag or a text run."""
    return (
        F.when(~unit.startswith("<"), _plain_text(unit))
        .when(unit.rlike(r"(?i)\A<img[\s/>]"), _image(unit))
        .otherwise(unit)
    )


def _link(unit: Column) -> Column:
    opening = F.regexp_extract(unit, r"(?s)\A<[^>]*>", 0)
    inner = sub(unit, r"(?is)\A<[^>]*>|</a\s*>\z", "")
    label = F.array_join(F.transform(find_all(inner, rf"{TAG}|[^<]+|<"), _small), "")

    def build(link: Column) -> Column:
        href, title, text = link["href"], link["title"], strip(link["label"])
        before = F.when(link["label"].startswith(" "), " ").otherwise("")
        after = F.when(link["label"].endswith(" "), " ").otherwise("")
        tail = F.when(title == "", "").otherwise(F.concat(F.lit(' "'), title, F.lit('"')))
        bare = (F.replace(text, F.lit(r"\_"), F.lit("_")) == href) & (title == "")
        return (
            F.when(is_blank(strip_tags(link["label"])) & ~link["label"].contains("!["), "")
            .when(href == "", F.concat(before, text, after))
            .when(bare, F.concat(F.lit(ANGLE_OPEN), href, F.lit(ANGLE_CLOSE)))
            .otherwise(
                F.concat(before, F.lit("["), text, F.lit("]("), href, tail, F.lit(")"), after)
            )
        )

    fields = F.struct(
        attribute(opening, "href").alias("href"),
        attribute(opening, "title").alias("title"),
        label.alias("label"),
    )
    return let(fields, build)


def _unit(unit: Column) -> Column:
    preformatted = F.concat(F.lit("\n\n```\n"), strip_tags(unit), F.lit("\n```\n\n"))
    code = let(
        strip_tags(unit),
        lambda t: F.when(is_blank(t), "").otherwise(F.concat(F.lit("`"), strip(t), F.lit("`"))),
    )
    return (
        F.when(~unit.startswith("<"), _plain_text(unit))
        .when(~unit.rlike(SPECIAL), unit)
        .when(unit.rlike(r"(?is)\A<a[\s/>].*</a\s*>\z"), _link(unit))
        .when(unit.rlike(r"(?is)\A<pre[\s/>].*</pre\s*>\z"), preformatted)
        .when(unit.rlike(r"(?is)\A<code[\s/>].*</code\s*>\z"), code)
        .otherwise(_small(unit))
    )


def _mark(unit: Column) -> Column:
    marks = fixed_map(MARKS)  # a unit is a tag, a sole bracket or a run without one
    name = F.lower(F.regexp_extract(unit, r"\A</?[a-zA-Z][a-zA-Z0-9]*", 0))
    marked = F.coalesce(F.try_element_at(marks, name), F.lit(""))
    return F.when(unit.startswith("<") & (unit != "<"), marked).otherwise(unit)


def _marked(html: Column) -> Column:
    """Text with its tags put as marks."""
    return F.array_join(F.transform(find_all(html, rf"{TAG}|[^<]+|<"), _mark), "")


def _heading(unit: Column) -> Column:
    level = F.substring(unit, 3, 1).cast("int")
    text = strip(sub(sub(unit, r"(?i)</?(?:h[1-6]|p|div)(?:[\s/][^>]*)?>", " "), rf"{GAP}+", " "))
    return F.concat(
        F.lit(f"{BLOCK_OPEN}\n\n"), F.repeat(F.lit("#"), level), F.lit(" "), _marked(text),
        F.lit(f"{BLOCK_CLOSE}\n\n"),
    )


def _numbered_list(unit: Column) -> Column:
    """Ordered items numbered from ``start``."""
    opening = F.regexp_extract(unit, r"(?s)\A<[^>]*>", 0)
    start = F.coalesce(attribute(opening, "start").try_cast("int"), F.lit(1))
    parts = F.split(sub(unit, r"(?is)\A<[^>]*>|</ol\s*>\z|</li\s*>", ""), r"(?i)<li(?:[\s/][^>]*)?>")
    items = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda item, i: F.concat(
            (i + start).cast("string"), F.lit(". "), strip(sub(item, r"(?i)</?p(?:\s[^>]*)?>", "\n"))
        ),
    )
    return _marked(F.concat(F.lit("<ul>"), F.array_join(items, "\n"), F.lit("</ul>")))


def _table(unit: Column) -> Column:
    """Rows between bars, with a rule under a heading row.

    A table whose first row is not made of heading cells gets an empty one.
    """
    rows = find_all(unit, rf"(?is){open_tag('tr')}(.*?){close_tag('tr')}", 1)

    def line(row: Column) -> Column:
        cells = find_all(row, rf"(?is){open_tag('td|th')}(.*?){close_tag('td|th')}", 1)
        shown = F.transform(
            cells,
            lambda c: F.concat(
                F.lit(" "), strip(sub(sub(c, r"(?i)</?p(?:\s[^>]*)?>", " "), r"\n", " ")), F.lit(" |")
            ),
        )
        return F.concat(F.lit("|"), F.array_join(shown, ""))

    def build(rows: Column) -> Column:
        first = F.element_at(rows, 1)
        width = F.regexp_count(first, F.lit(r"(?i)<t[dh](?:[\s/][^>]*)?>"))
        heads = F.regexp_count(first, F.lit(r"(?i)<th(?:[\s/][^>]*)?>"))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
        empty = F.concat(F.lit("|"), F.repeat(F.lit("  |"), width))
        text = F.transform(rows, line)
        body = F.slice(text, F.lit(2), F.size(text))
        whole = F.when(
            width == heads, F.concat(F.slice(text, 1, 1), F.array(rule), body)
        ).otherwise(F.concat(F.array(empty, rule), text))
        return F.when(F.size(rows) == 0, strip_tags(unit)).otherwise(F.array_join(whole, "\n"))

    return F.concat(
        F.lit(f"{BLOCK_OPEN}\n\n"), _marked(let(rows, build)), F.lit(f"{BLOCK_CLOSE}\n\n")
    )


def _block(unit: Column) -> Column:
    return (
        F.when(~unit.startswith("<"), unit)
        .when(~unit.rlike(SPECIAL_BLOCK), _mark(unit))
        .when(unit.rlike(r"(?is)\A<h[1-6][\s/>].*</h[1-6]\s*>\z"), _heading(unit))
        .when(unit.rlike(r"(?is)\A<ol[\s/>].*</ol\s*>\z"), _numbered_list(unit))
        .when(unit.rlike(r"(?is)\A<table[\s/>].*</table\s*>\z"), _table(unit))
        .otherwise(_mark(unit))
    )


def _emphasis(text: Column, opening: str, closing: str, mark: str) -> Column:
    """Paired marks, then marks left open: those end with their block, or with
    the scope they stand in when another block starts first."""
    # white space at the inner edges goes outside, a lasting space only
    out = sub_where(text, [f"{opening} "], rf"{opening} {GAP}*", f" {opening}")
    out = sub_where(out, [opening], rf"{opening}{GAP}+", opening)
    out = let(
        out,
        lambda t: F.when(t.contains(closing), _pairs(t, opening, closing, mark)).otherwise(t),
    )
    return let(out, lambda t: F.when(t.contains(opening), _open_marks(t, opening, mark)).otherwise(t))


def _pairs(text: Column, opening: str, closing: str, mark: str) -> Column:
    out = sub(text, rf"{GAP}*+(?<= ){closing}", f"{closing} ")
    out = sub(out, rf"{GAP}++{closing}", closing)
    for _ in range(2):
        out = sub(out, f"{opening}{closing}", "")
        out = sub(out, f"{opening}([^{opening}{closing}]++){closing}", f"{mark}$1{mark}")
    return F.replace(out, F.lit(closing), F.lit(""))


def _open_marks(text: Column, opening: str, mark: str) -> Column:
    space = " \t\r\n"
    ends = f"{opening}{BLOCK_OPEN}{BLOCK_CLOSE}{SCOPE_END}"
    out = sub(text, f"{opening}([^{ends}]++){BLOCK_CLOSE}", f"{mark}$1{mark}{BLOCK_CLOSE}")

    def to_scope_end(scope: Column) -> Column:
        left_open = F.length(scope) - F.length(F.replace(scope, F.lit(opening), F.lit("")))
        body = F.rtrim(
            F.replace(scope, F.lit(opening), F.lit(mark)),
            F.lit(f"{BLOCK_OPEN}{BLOCK_CLOSE}{space}"),
        )
        shut = F.concat(body, F.repeat(F.lit(mark), left_open), F.lit(f"{BLOCK_CLOSE}\n\n"))
        return F.when(scope.contains(opening), shut).otherwise(scope)

    return F.array_join(F.transform(F.split(out, SCOPE_END), to_scope_end), SCOPE_END)


def _quotes(text: Column) -> Column:
    """Lines of quotes, marked by the depth at which they stand.

    The walk over the pieces between marks keeps the depth, at which a piece was
    shown last, and the text so far.
    """
    state = T.StructType(
        [T.StructField("depth", T.IntegerType()), T.StructField("shown", T.IntegerType()), T.StructField("done", T.StringType())]
    )

    def marked(piece: Column, depth: Column) -> Column:
        lines = sub(strip(piece), r"\n{3,}", "\n\n")
        mark = F.repeat(F.lit("> "), depth)
        return F.concat(mark, F.replace(lines, F.lit("\n"), F.concat(F.lit("\n"), mark)))

    def step(acc: Column, piece: Column) -> Column:
        depth, shown = acc["depth"], acc["shown"]
        opened = F.when(piece == QUOTE_OPEN, 1).when((piece == QUOTE_CLOSE) & (depth > 0), -1).otherwise(0)
        # between two pieces of one quote a line of the shallower, else a blank line
        between = F.when(shown > 0, F.concat(F.lit("\n"), F.rtrim(F.repeat(F.lit("> "), F.least(shown, depth))), F.lit("\n"))).otherwise("\n\n")
        added = (
            F.when(piece.isin(QUOTE_OPEN, QUOTE_CLOSE), F.when((opened == -1) & (depth == 1), "\n\n").otherwise(""))
            .when(depth == 0, piece)
            .when(is_blank(piece), "")
            .otherwise(F.concat(between, marked(piece, depth)))
        )
        left = F.when((opened == -1) & (depth == 1), 0).when((opened != 0) | (depth == 0) | is_blank(piece), shown).otherwise(depth)
        return F.struct((depth + opened).alias("depth"), left.alias("shown"), F.concat(acc["done"], added).alias("done")).cast(state)

    pieces = find_all(text, f"[{QUOTE_OPEN}{QUOTE_CLOSE}]|[^{QUOTE_OPEN}{QUOTE_CLOSE}]+")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("shown"), F.lit("").alias("done"))
    return F.aggregate(pieces, start.cast(state), step, lambda acc: acc["done"])


def _items(text: Column) -> Column:
    """List items on lines of their own, set in by the depth of their list.

    The text is cut where items start; the walk over the pieces keeps the depth
    at which the lists before a piece leave it. A list is set off by blank lines
    unless it stands in another list.
    """
    state = T.StructType(
        [
            T.StructField("depth", T.IntegerType()),
            T.StructField("done", T.ArrayType(T.StringType())),
        ]
    )
    marks = f"{LIST_OPEN}{LIST_CLOSE}{LI_CLOSE}"

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"]
        opened = F.regexp_count(piece, F.lit(LIST_OPEN))
        closed = F.regexp_count(piece, F.lit(LIST_CLOSE))
        own = F.regexp_extract(piece, f"(?s)\\A[^{marks}]*", 0)
        rest = F.substring(piece, F.length(own) + 1, F.length(piece))
        inside = sub(sub(rest, f"{LIST_CLOSE}(?=[^{marks}])", "\n"), f"[{marks}]", "")
        around = F.when(
            closed >= depth, sub(sub(rest, LI_CLOSE, ""), f"[{LIST_OPEN}{LIST_CLOSE}]+", "\n\n")
        ).otherwise(inside)
        # further lines of an item line up with its text
        inset = F.concat(F.lit("\n"), F.repeat(F.lit("  "), F.greatest(depth, F.lit(1))))
        number = F.regexp_extract(own, rf"\A\s*{NUMBER_OPEN}(-?\d+){NUMBER_CLOSE}", 1)
        plain = sub(own, rf"\A\s*{NUMBER_OPEN}-?\d+{NUMBER_CLOSE}", "")
        body = F.replace(sub(strip(plain), r"\n{3,}", "\n\n"), F.lit("\n"), inset)
        sign = F.when(number == "", "- ").otherwise(F.concat(number, F.lit(". ")))
        bullet = F.concat(F.repeat(F.lit("  "), F.greatest(depth - 1, F.lit(0))), sign)
        item = F.concat(F.lit("\n"), bullet, body, around)
        before = F.concat(own, around)
        return F.struct(
            (depth + opened - closed).alias("depth"),
            F.concat(
                acc["done"], F.array(F.when(F.size(acc["done"]) == 0, before).otherwise(item))
            ).alias("done"),
        ).cast(state)

    pieces = F.split(sub(text, f"{LI_OPEN}{GAP}*{LI_CLOSE}", "\n"), LI_OPEN)
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("done"))
    return F.aggregate(
        pieces, start.cast(state), step, lambda acc: F.array_join(acc["done"], "")
    )


def convert_html(html: Column) -> Column:
    """Markdown of a page before it is cleaned."""
    plain = without_private(html)
    out = F.coalesce(without_dropped(F.when(is_walked(html), plain)), plain)
    out = F.array_join(F.transform(find_all(out, UNITS), _unit), "")
    beside = rf"(?i){GAP}*(</?(?:{BLOCKS})(?:[\s/][^>]*)?>){GAP}*"
    out = let(out, lambda t: F.when(t.rlike(BESIDE_TAG), sub(t, beside, "$1")).otherwise(t))
    out = F.array_join(F.transform(find_all(out, BLOCK_UNITS), _block), "")
    out = let(out, lambda t: F.when(t.rlike(WORKED_ON), _without_marks(t)).otherwise(_without_scopes(t)))
    return decode_entities(out)


def _without_scopes(text: Column) -> Column:
    for mark in (BLOCK_OPEN, BLOCK_CLOSE, SCOPE_END):
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def _without_marks(text: Column) -> Column:
    """Marks of emphasis, lists, quotes and bare links worked into the text."""
    out = _emphasis(text, STRONG_OPEN, STRONG_CLOSE, "**")
    out = _emphasis(out, EM_OPEN, EM_CLOSE, "*")
    out = _without_scopes(out)
    listed = lambda t: t.contains(LI_OPEN) | t.contains(LIST_OPEN)
    out = let(out, lambda t: F.when(listed(t), _items(t)).otherwise(t))
    out = let(out, lambda t: F.when(t.contains(QUOTE_OPEN) | t.contains(QUOTE_CLOSE), _quotes(t)).otherwise(t))
    for mark, sign in ((ANGLE_OPEN, "<"), (ANGLE_CLOSE, ">")):
        out = F.replace(out, F.lit(mark), F.lit(sign))
    return out


def html_to_markdown(html: Column) -> Column:
    """Markdown of a page, cleaned twice: the second pass sees what the first left."""
    return clean_twice(convert_html(html))
