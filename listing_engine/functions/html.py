"""Field-level extraction from markup as expressions.

Elements are found by tag and class and end at their own closing tag, however
many elements of the same tag they contain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listing_engine.functions.text import bound, decode_entities, html_text

I = "(?is)"


def _attr(name: str, value: str) -> str:
    return rf"""[^>]*\b{name}=["'][^"']*{value}[^"']*["'][^>]*"""


def _open(tag: str, cls: str | None, attr: str = "class") -> str:
    return rf"<{tag}\b{_attr(attr, cls) if cls else '[^>]*'}>"


def _pieces(html: Column, tag: str) -> Column:
    """Markup cut before each opening and closing tag of that name."""
    return F.split(html, rf"{I}(?=<{tag}\b[^>]*>|</{tag}\s*>)")


def _spans(pieces: Column, tag: str, opening: str) -> Column:
    """(first, last) piece of each outermost element whose opening tag matches:
    `last` is the piece that starts with its own closing tag, or one past the
    end if it is never closed. One pass that counts open tags."""
    kind = "struct<at: int, depth: int, first: int, spans: array<struct<first: int, last: int>>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("first"), F.array().cast("array<struct<first: int, last: int>>").alias("spans"))

    def step(s: Column, piece: Column) -> Column:
        opens, closes = piece.rlike(rf"{I}^<{tag}\b[^>]*>"), piece.rlike(rf"{I}^</{tag}\s*>")
        inside = s["depth"] > 0
        begins = ~inside & opens & piece.rlike(rf"{I}^{opening}")
        depth = s["depth"] + F.when(inside & closes, -1).when((inside & opens) | begins, 1).otherwise(0)
        done = inside & closes & (s["depth"] == 1)
        span = F.array(F.struct(s["first"].alias("first"), s["at"].alias("last")))
        return F.struct(
            (s["at"] + 1).alias("at"),
            depth.alias("depth"),
            F.when(begins, s["at"]).otherwise(s["first"]).alias("first"),
            F.when(done, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"),
        ).cast(kind)

    def end(s: Column) -> Column:
        return F.when(s["depth"] > 0, F.concat(s["spans"], F.array(F.struct(s["first"].alias("first"), s["at"].alias("last"))))).otherwise(s["spans"])

    return F.aggregate(pieces, start.cast(kind), step, end)


def _balanced(html: Column, tag: str, opening: str, outer: bool = False) -> Column:
    """Markup of the outermost such elements, each up to its own closing tag; `outer`: with both tags."""

    def cut(pieces: Column) -> Column:
        def markup(x: Column) -> Column:
            inside = F.array_join(F.slice(pieces, x["first"] + 1, x["last"] - x["first"]), "")
            if outer:
                closing = F.regexp_extract(F.coalesce(F.get(pieces, x["last"]), F.lit("")), rf"{I}^</{tag}\s*>", 0)
                return F.concat(inside, closing)
            return F.regexp_replace(inside, r"(?s)^<[^>]*>", "")

        return F.transform(_spans(pieces, tag, opening), markup)

    return bound(_pieces(html, tag), cut)


def elements(html: Column, tag: str, cls: str | None = None, attr: str = "class") -> Column:
    """Inner markup of the outermost such elements, each up to its own closing
    tag; markup without elements of one tag inside each other needs no count."""
    opening = _open(tag, cls, attr)
    nested = lambda flat: F.exists(flat, lambda x: x.rlike(rf"{I}<{tag}\b[^>]*>"))
    found = lambda h: bound(
        F.regexp_extract_all(h, F.lit(rf"{I}{opening}(.*?)</{tag}\s*>"), 1), lambda flat: F.when(nested(flat), _balanced(h, tag, opening)).otherwise(flat)
    )
    return bound(F.coalesce(html, F.lit("")), found)


def element(html: Column, tag: str, cls: str | None = None, attr: str = "class") -> Column:
    """Inner markup of the first such element, NULL when absent."""
    opening = _open(tag, cls, attr)
    inner = lambda whole: F.regexp_replace(whole, rf"{I}^<[^>]*>|</{tag}\s*>$", "")

    def first(h: Column) -> Column:
        whole = F.regexp_extract(h, rf"{I}{opening}.*?</{tag}\s*>", 0)
        flat = lambda x: F.when(x.rlike(rf"{I}^<[^>]*>.*<{tag}\b[^>]*>"), F.get(_balanced(h, tag, opening), F.lit(0))).otherwise(inner(x))
        return bound(whole, lambda x: F.when(F.length(x) > 0, flat(x)))

    return bound(html, first)


def outer_element(html: Column, tag: str, cls: str | None = None, attr: str = "class") -> Column:
    """The first such element with its tags, up to its own closing tag, '' when absent."""
    opening = _open(tag, cls, attr)
    first = lambda h: F.coalesce(F.get(_balanced(h, tag, opening, outer=True), F.lit(0)), F.lit(""))
    return bound(F.coalesce(html, F.lit("")), lambda h: F.when(h.rlike(rf"{I}{opening}"), first(h)).otherwise(""))


def without_elements(html: Column, tag: str, opening: str) -> Column:
    """Markup without the outermost elements whose opening tag matches."""

    def rest(pieces: Column) -> Column:
        def kept(spans: Column) -> Column:
            return F.transform(
                pieces,
                lambda piece, i: F.when(F.exists(spans, lambda x: (x["first"] <= i) & (i < x["last"])), F.lit(""))
                .when(F.exists(spans, lambda x: x["last"] == i), F.regexp_replace(piece, rf"{I}^</{tag}\s*>", ""))
                .otherwise(piece),
            )

        return F.array_join(bound(_spans(pieces, tag, opening), kept), "")

    return bound(html, lambda h: F.when(h.rlike(rf"{I}{opening}"), bound(_pieces(h, tag), rest)).otherwise(h))


def text_of(html: Column, tag: str, cls: str | None = None, attr: str = "class", only: tuple[str, ...] | None = None) -> Column:
    """Plain text of the first such element, '' when absent; `only`: names of the entities to decode, None for all."""
    return html_text(F.coalesce(element(html, tag, cls, attr), F.lit("")), only)


def attribute(html: Column, tag: str, name: str, cls: str | None = None) -> Column:
    """Attribute of the first such tag, whatever the attribute order."""
    tag_text = F.regexp_extract(html, rf"{I}<{tag}\b{_attr('class', cls) if cls else '[^>]*'}>", 0)
    value = F.regexp_extract(tag_text, rf"""{I}\b{name}=["']([^"']*)["']""", 1)
    return decode_entities(F.nullif(value, F.lit("")))


def section(html: Column, heading_class: str, titles: str, body_class: str) -> Column:
    """List items of the block that directly follows a heading."""
    pattern = rf"{I}{_open('h2', heading_class)}\s*(?:{titles})\s*</h2>\s*({_open('div', body_class)}.*)$"
    items = elements(F.coalesce(element(F.regexp_extract(html, pattern, 1), "div", body_class), F.lit("")), "li")
    return F.transform(items, lambda x: html_text(x))


def linked_data(html: Column, schema: str) -> Column:
    """JSON-LD blocks of the page as one array of structs; a block that is no
    JSON is skipped, a list contributes its members and an @graph its nodes."""
    raw = F.regexp_extract_all(
        F.coalesce(html, F.lit("")), F.lit(rf"{I}<script\b{_attr('type', 'application/ld.json')}>(.*?)</script>"), 1
    )
    listed = F.transform(raw, lambda x: F.when(F.trim(x).startswith("["), x).otherwise(F.concat(F.lit("["), x, F.lit("]"))))
    none = F.array().cast(f"array<{schema}>")
    blocks = F.flatten(F.transform(listed, lambda x: F.coalesce(F.from_json(x, f"array<{schema}>"), none)))
    graph = f"struct<`@graph`:array<{schema}>>"
    graphs = F.flatten(F.transform(listed, lambda x: F.coalesce(F.from_json(x, f"array<{graph}>"), F.array().cast(f"array<{graph}>"))))
    nodes = F.flatten(F.transform(graphs, lambda g: F.coalesce(g["@graph"], none)))
    return F.filter(F.concat(blocks, nodes), lambda b: b.isNotNull())


def first_of(blocks: Column, pick) -> Column:
    """First non-NULL value over the blocks."""
    return F.get(F.filter(F.transform(blocks, pick), lambda v: v.isNotNull()), F.lit(0))


def first_group(text: Column, *patterns: str, flags: str = "(?iU)") -> Column:
    """Group 1 of the first pattern that occurs, NULL when none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, flags + p, 1), F.lit("")) for p in patterns])


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, rf"{I}<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
