"""Text, number, date and list expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words kept in lower case inside a Spanish title.
LOWER_WORDS = ("de", "del", "la", "las", "los", "y", "el", "i", "d'", "d")
# Operation synonyms.
OPERATION_SYNONYMS = {
    "sell": "venta",
    "rent": "alquiler",
    "alquiler con opcion a compra": "alquiler",
}
# Named HTML entities as the standard library lists them; a non-breaking space counts as a blank.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"nbsp": " ", "apos": "'"}


def _fold_table(form: str) -> tuple[str, str]:
    """Characters of the Latin, Greek and punctuation blocks that reduce to one
    base character once decomposed and stripped of combining marks."""
    src, dst = [], []
    for cp in [*range(0xA0, 0x0590), *range(0x1E00, 0x2200), *range(0xFF01, 0xFF5F)]:
        ch = chr(cp)
        if unicodedata.category(ch) == "Mn":
            continue
        base = "".join(c for c in unicodedata.normalize(form, ch) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_CANONICAL = _fold_table("NFD")
_COMPATIBLE = _fold_table("NFKD")
# Compatibility characters that expand to several characters.
_EXPANDING = {c: unicodedata.normalize("NFKD", c) for c in "¼½¾…™№ﬀﬁﬂﬃﬄ"}


def strip_accents(c: Column, compatible: bool = False) -> Column:
    """X2. `compatible` also folds NFKD forms such as ² or ª."""
    table = _COMPATIBLE if compatible else _CANONICAL
    if compatible:
        for ch, plain in _EXPANDING.items():
            c = F.replace(c, F.lit(ch), F.lit(plain))
    return F.regexp_replace(F.translate(c, *table), r"\p{Mn}", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def normalize_text(c: Column) -> Column:
    """X1"""
    s = strip_accents(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), compatible=True)
    s = F.translate(s, ";|/\\><", ",,,,,,")
    s = F.replace(F.replace(s, F.lit(" ,"), F.lit(",")), F.lit(", "), F.lit(","))
    return squeeze(s)


def normalize_term(c: Column) -> Column:
    """X31"""
    s = strip_accents(F.lower(squeeze(c)))
    return squeeze(F.regexp_replace(s, r"\s*/\s*", "/"))


def normalize_agency(c: Column) -> Column:
    """Upper case without accents, single spaces (agency names)."""
    return F.upper(strip_accents(squeeze(c), compatible=True))


# ------------------------------------------------------------------ numbers
def to_float(c: Column) -> Column:
    """Decimal comma accepted, NULL on failure and for NaN."""
    number = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(number), number)


def to_int(c: Column) -> Column:
    """Truncation through double, NULL on failure."""
    return F.trim(c.cast("string")).try_cast("double").try_cast("int")


def _leading(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def locale_number(c: Column) -> Column:
    """X5: '1.234,56 €' style; 0 when nothing numeric leads the text."""
    s = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[€$\s ]", "")
    both = s.contains(",") & s.contains(".")
    s = F.translate(F.when(both, F.replace(s, F.lit("."), F.lit(""))).otherwise(s), ",", ".")
    s = F.regexp_replace(s, r"[^0-9.\-]", "")
    return F.coalesce(_leading(s, r"^(-?(?:\d+\.?\d*|\.\d+))").try_cast("double"), F.lit(0.0))


def digits_int(c: Column, default: int | None = 0) -> Column:
    """Keep digits and sign. With a default, JS-style prefix parse; without,
    separators go first and anything unparsable is NULL."""
    s = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^0-9\-]", "")
    if default is None:
        return s.try_cast("bigint")
    return F.coalesce(_leading(s, r"^(-?\d+)").try_cast("bigint"), F.lit(default))


def first_number_int(c: Column) -> Column:
    """First number of the text, thousands dot, decimal comma, truncated."""
    s = _leading(c, r"(\d+(?:[.,]\d+)?)")
    s = F.translate(F.replace(s, F.lit("."), F.lit("")), ",", ".")
    return s.try_cast("double").try_cast("bigint")


def spanish_number(c: Column) -> Column:
    """Keep digits, dots and commas; thousands dot, decimal comma."""
    s = F.regexp_replace(c, r"[^\d,.]", "")
    return F.translate(F.replace(s, F.lit("."), F.lit("")), ",", ".").try_cast("double")


def digits_only(c: Column) -> Column:
    """Units removed, every remaining digit kept in order."""
    s = F.regexp_replace(c, r"€|EUR|eur|m²|m2", "")
    return F.nullif(F.regexp_replace(s, r"\D", ""), F.lit("")).try_cast("bigint")


# ------------------------------------------------------------------ urls, dates
def canonical_url(c: Column, host: str) -> Column:
    """Https, fixed host, path only, no trailing slash."""
    s = c.cast("string")
    absolute = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]+"
    path = F.when(s.rlike(absolute), F.regexp_replace(s, absolute, "")).when(
        s.startswith("/"), s
    ).otherwise(F.concat(F.lit("/"), s))
    path = F.regexp_replace(path, r"[?#].*$", "")
    path = F.regexp_replace(path, r";[^/]*$", "")
    return F.regexp_replace(F.concat(F.lit(f"https://{host}"), path), r"/+$", "")


def iso_day(c: Column) -> Column:
    """Date of an ISO text, cut at the T."""
    return F.substring_index(c.cast("string"), "T", 1).try_cast("date")


def date_in_text(c: Column) -> Column:
    """First dd/mm/yyyy or yyyy-mm-dd inside a text."""
    s = _leading(c, r"(\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2})")
    day = F.when(s.contains("/"), F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2)))
    return F.coalesce(day, s).try_cast("date")


# ------------------------------------------------------------------ lists
def clean_list(a: Column) -> Column:
    """Trimmed, non-empty, first occurrences."""
    trimmed = F.transform(a, lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: F.length(x) > 0))


def parse_list_field(c: Column) -> Column:
    """X9"""
    return clean_list(F.split(normalize_text(c), ","))


def list_literal(c: Column, scalar: str = "empty") -> Column:
    """Python or JSON list literal to array; text that is no literal
    becomes one element, 'null'/'' no element. `scalar` says what a JSON scalar
    becomes: "empty" or "self"."""
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    none = F.array().cast("array<string>")
    parsed = F.from_json(s, "array<string>", {"allowSingleQuotes": "true"})
    is_scalar = s.rlike(r"""^(?:-?\d+(?:\.\d+)?|true|false|"[^"]*"|'[^']*')$""")
    plain = F.regexp_replace(s, r"""^["']|["']$""", "")
    return (
        F.when((s == "") | F.lower(s).isin("null", "none"), none)
        .when(s.startswith("[") & s.endswith("]") & parsed.isNotNull(), parsed)
        .when(is_scalar, none if scalar == "empty" else F.array(plain))
        .otherwise(F.array(s))
    )


def preference_tokens(c: Column) -> Column:
    """Normalized tokens of a list literal or of comma-separated text."""
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    items = F.transform(list_literal(s, "self"), lambda x: normalize_text(x))
    listed = F.array_distinct(F.filter(items, lambda x: F.length(x) > 0))
    return F.when(s.startswith("["), listed).otherwise(parse_list_field(s))


def operation_tokens(tokens: Column) -> Column:
    """X27 over an array of normalized tokens."""
    def canonical(t: Column) -> Column:
        out = t
        for word, target in OPERATION_SYNONYMS.items():
            out = F.when(t == word, target).otherwise(out)
        return out

    return F.array_distinct(F.filter(F.transform(tokens, canonical), lambda t: F.length(t) > 0))


def token_list(a: Column) -> Column:
    """Report form of a token array."""
    kept = F.array_distinct(F.filter(a, lambda t: F.length(t) > 0))
    return F.coalesce(F.nullif(F.array_join(kept, ", "), F.lit("")), F.lit("-"))


def clean_zone(c: Column) -> Column:
    """Zone text out of a tuple or dict literal."""
    pair = r"'municipio':\s*'([^']+)'.*'barrio':\s*'([^']+)'"
    from_tuple = _leading(c, r"^\('([^']+)'")
    from_dict = F.when(c.rlike(pair), F.concat_ws(" / ", F.regexp_extract(c, pair, 1), F.regexp_extract(c, pair, 2)))
    plain = F.regexp_replace(c, r"""^["']|["']$""", "")
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "Desconocido").otherwise(
        F.coalesce(from_tuple, from_dict, plain)
    )


# ------------------------------------------------------------------ words
def title_case(c: Column) -> Column:
    """X16"""
    def word(w: Column, i: Column) -> Column:
        low = F.lower(w)
        cap = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
        return F.when((i > 0) & low.isin(*LOWER_WORDS), low).otherwise(cap)

    words = F.filter(F.split(squeeze(c), " "), lambda w: F.length(w) > 0)
    return F.array_join(F.transform(words, word), " ")


def singular_es(c: Column) -> Column:
    """Single words lose es / s; compounds stay."""
    t = F.trim(c)
    n = normalize_term(t)
    cut = lambda k: F.substring(t, F.lit(1), F.length(t) - k)
    return F.when(t.contains(" "), t).when(n.endswith("es"), cut(2)).when(n.endswith("s"), cut(1)).otherwise(t)


def plural_variants(term: Column) -> Column:
    """Spellings under which a vocabulary term is searched, longest first."""
    s = F.when(~term.endswith("s"), F.concat(term, F.lit("s")))
    es = F.when(~term.endswith("es"), F.concat(term, F.lit("es")))
    several = F.filter(F.array(es, s, term), lambda x: x.isNotNull())
    return F.when(term.contains(" ") | term.contains("/"), F.array(term)).otherwise(several)


def looks_like(kind: str, term: Column) -> Column:
    """X32 over a normalized term: operation, numeric, quantity or condition."""
    if kind == "operation":
        return term.rlike(r"\b(venta|alquiler)\b")
    if kind == "numeric":
        return term.rlike(r"\d|m2|m²|€|eur")
    if kind == "quantity":
        return term.rlike(r"\b(habitaci[oó]n(es)?|ba[nñ]os?|sal[oó]n(es)?)\b")
    if kind == "condition":
        suffix = term.rlike(r"([ai]d[oa]s?)\b")
        return term.startswith("a ") | term.startswith("en ") | (~term.contains(" ") & suffix)
    raise ValueError(kind)


# ------------------------------------------------------------------ html
#: Entities that most markup makes do with; the ampersand comes last, so that nothing is decoded twice.
FREQUENT = ("nbsp", "euro", "quot", "apos", "lt", "gt", "amp")
_OTHER = rf"&(?!(?:{'|'.join(FREQUENT)});)(?:\w+|#\d+|#[xX][0-9a-fA-F]+);"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` evaluated once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decode_entities(c: Column) -> Column:
    """Named and numeric entities to characters, each once; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^&(\w+);", 1)
        ten, sixteen = F.regexp_extract(piece, r"^&#(\d{1,7});", 1), F.regexp_extract(piece, r"(?i)^&#x([0-9a-f]{1,6});", 1)
        code = F.coalesce(F.nullif(ten, F.lit("")), F.conv(F.nullif(sixteen, F.lit("")), 16, 10)).cast("int")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        sign = F.when(valid, F.when(code == 160, F.lit(" ")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        sign = bound(F.coalesce(F.try_element_at(names, name), sign), lambda x: F.when(x.isNotNull(), F.concat(x, F.regexp_replace(piece, r"^&[^;]*;", ""))))
        return F.coalesce(sign, piece)

    def any_entity(x: Column) -> Column:
        return F.array_join(F.transform(F.split(x, "(?=&)"), decoded), "")

    def frequent(x: Column) -> Column:
        for name in FREQUENT:
            x = F.replace(x, F.lit(f"&{name};"), F.lit(ENTITIES[name]))
        return x

    return bound(c, lambda x: F.when(~x.contains("&"), x).when(x.rlike(_OTHER), any_entity(x)).otherwise(frequent(x)))


def html_text(c: Column, only: tuple[str, ...] | None = None) -> Column:
    """Markup to plain text; `only`: names of the entities to decode, None for all."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    if only is None:
        return squeeze(decode_entities(bare))
    for name in only:
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(ENTITIES[name]))
    return squeeze(bare)


def html_spans(c: Column) -> Column:
    """Texts of the span elements."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?is)<span[^>]*>(.*?)</span>"), 1)
    return F.transform(found, lambda x: html_text(x))


def unlabelled_tokens(c: Column) -> Column:
    """Words left when span elements, commas and stray tags are removed."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<span.*?>.*?</span>", "")
    words = F.split(squeeze(F.replace(s, F.lit(","), F.lit(""))), " ")
    return F.filter(words, lambda w: (F.length(w) > 0) & ~w.contains("<") & ~w.contains(">"))
