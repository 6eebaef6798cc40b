"""Buyer preference text -> constraints, as expressions (N1-N4, N7-N10, stages of N5).

`text` is the plain text of the preference block with single spaces.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from listing_engine.functions.text import (
    digits_only,
    normalize_term,
    singular_es,
    squeeze,
)
from listing_engine.operators.filters import drop_noise_locations

# Quantity words of the preference texts.
ROOMS, BATHS, LIVING = r"habitaci[oó]n(?:es)?", r"ba[nñ]os?", r"sal[oó]n(?:es)?"
# The two spellings of the home city, as a pair.
CITY_PAIR = r"alcoy\s*/\s*alcoi|alcoi\s*/\s*alcoy"
# Normalized quantity terms that are no property type.
QUANTITY_TERMS = ("habitacion", "habitación", "habitaciones", "baño", "banio", "banos", "baños", "salon", "salones")
ALIAS_TERMS = ("piso", "apartamento")
ALIAS_TYPE, ROOM_TYPE, GENERIC_TYPE = "Pisos/ Apartamentos", "Habitación", "Inmueble"
# Markers of the flags.
POLYGON, ALL_LISTINGS = r"pol[ií]gono definido", "todos los inmuebles"

ANY = "(?iu)"
WORD = "(?iuU)"
NUMBER = r"([\d.\s,]+)"
_LETTER = "A-Za-zÁÉÍÓÚÑáéíóúñ"
SLASH_TAIL = rf"[{_LETTER}][{_LETTER}\s\-]*/\s*[{_LETTER}][{_LETTER}\s\-]*\s*$"


def _nfkc_table() -> tuple[str, str]:
    src, dst = [], []
    for cp in [*range(0xA0, 0x250), *range(0x2000, 0x2200), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKC", chr(cp))
        if len(base) == 1 and base != chr(cp):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_NFKC = _nfkc_table()


def let(value: Column, body) -> Column:
    """Bind a value once for an expression that uses it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ------------------------------------------------------------------ numbers
def operations(text: Column) -> Column:
    """Operations in order of appearance; a euro amount alone means a sale."""
    t = normalize_term(F.coalesce(text, F.lit("")))
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(venta|alquiler)\b"), 1))
    none = F.array().cast("array<string>")
    return F.when(F.size(found) > 0, found).when(t.rlike(r"\d[\d.\s,]*\s*€"), F.array(F.lit("venta"))).otherwise(none)


def _first_range(text: Column, rules: list[tuple[str, bool, bool]], number) -> Column:
    """The first pattern that occurs decides both ends. A rule says whether its
    pattern carries a lower and an upper bound; a single group serves both."""
    out = None
    null = F.lit(None).cast("bigint")
    for pattern, has_lo, has_hi in rules:
        p = ANY + pattern
        groups = pattern.count("(") - pattern.count("(?:")
        lo = number(F.regexp_extract(text, p, 1)) if has_lo else null
        hi = number(F.regexp_extract(text, p, groups)) if has_hi else null
        value = F.struct(lo.alias("lo"), hi.alias("hi"))
        hit = text.rlike(p)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(null.alias("lo"), null.alias("hi")))


def quantity_range(text: Column, label: str) -> Column:
    """struct(lo, hi) of rooms, baths or living rooms."""
    rules = [
        (rf"entre\s*(\d+)\s*{label}\s*a\s*(\d+)\s*{label}", True, True),
        (rf"de\s*(\d+)\s*{label}\s*a\s*(\d+)\s*{label}", True, True),
        (rf"desde\s*(\d+)\s*{label}", True, False),
        (rf"hasta\s*(\d+)\s*{label}", False, True),
        (rf"(\d+)\s*{label}", True, True),
    ]
    return _first_range(text, rules, lambda c: c.try_cast("bigint"))


def _unit_range(text: Column, unit: str, order: tuple[str, str]) -> Column:
    both = {
        "entre": rf"entre\s*{NUMBER}\s*{unit}\s*a\s*{NUMBER}\s*{unit}",
        "de": rf"de\s*{NUMBER}\s*{unit}\s*a\s*{NUMBER}\s*{unit}",
    }
    rules = [(both[o], True, True) for o in order]
    rules += [(rf"desde\s*{NUMBER}\s*{unit}", True, False), (rf"hasta\s*{NUMBER}\s*{unit}", False, True)]
    return _first_range(text, rules, digits_only)


def area_range(text: Column) -> Column:
    """N3"""
    return _unit_range(text, "m[²2]", ("entre", "de"))


def price_range(text: Column) -> Column:
    """N4"""
    return _unit_range(text, "€", ("de", "entre"))


def numeric_context(text: Column) -> Column:
    """An explicit number of rooms, baths or living rooms occurs."""
    alternatives = [rf"\b(?:hasta|desde)\s*\d+\s*{ROOMS}\b"]
    for label in (ROOMS, BATHS, LIVING):
        alternatives += [rf"\b\d+\s*{label}\b", rf"\b(?:entre|de)\s*\d+\s*{label}\s*a\s*\d+\b"]
    return squeeze(text).rlike(WORD + "|".join(alternatives))


def flags(text: Column) -> Column:
    """N9"""
    coded = F.array(
        F.when(text.rlike(ANY + POLYGON), "polygon"),
        F.when(text.rlike(ANY + ALL_LISTINGS), "todos_los_inmuebles"),
        F.when(text.rlike(WORD + r"\bbusca inmueble\b"), "busca_inmueble_generico"),
    )
    return F.filter(coded, lambda x: x.isNotNull())


# ------------------------------------------------------------------ locations
def clean_location(c: Column) -> Column:
    """One location token: dangling conjunction, commas and spaces removed."""
    s = F.regexp_replace(F.translate(c, *_NFKC), WORD + r"\b[oy]\s*$", "")
    return squeeze(F.regexp_replace(s, r"^[ ,]+|[ ,]+$", ""))


def _is_all(c: Column) -> Column:
    return normalize_term(c) == ALL_LISTINGS


def _without_all_tail(c: Column) -> Column:
    inner = lambda x: F.regexp_extract(x, r"\(([^)]*)\)\s*$", 1)
    cut = lambda x: F.rtrim(F.regexp_replace(x, r"\([^)]*\)\s*$", ""))
    return let(c, lambda x: F.when(_is_all(inner(x)), cut(x)).otherwise(x))


def _slash_split(c: Column) -> Column:
    """struct(left, right) of 'X City / Province' where the pair starts inside
    the token; NULL otherwise."""
    def halves(at: Column) -> Column:
        left = clean_location(F.substring(c, F.lit(1), at - 1))
        right = clean_location(F.substring(c, at, F.length(c)))
        return F.when(at > 1, F.struct(left.alias("left"), right.alias("right")))

    return let(F.regexp_instr(c, F.lit(SLASH_TAIL)), halves)


def _filled(a: Column) -> Column:
    return F.filter(a, lambda x: F.length(x) > 0)


def _split_tail(c: Column) -> Column:
    return let(
        _slash_split(c),
        lambda p: F.when(p.isNotNull(), _filled(F.array(p["left"], p["right"]))).otherwise(F.array(c)),
    )


def _drop_tail_while(parts: Column, test) -> Column:
    """Remove the trailing elements for which the test holds."""
    return let(
        F.array_position(F.transform(F.reverse(parts), lambda p: test(p)), F.lit(False)),
        lambda other: F.when(
            other > 0, F.slice(parts, F.lit(1), (F.size(parts) - other + 1).cast("int"))
        ).otherwise(F.array().cast("array<string>")),
    )


def _candidates(parts: Column) -> Column:
    """Candidates of one 'en ...' segment: with commas one fused token
    'X (City / Province)', without commas the token and its slash tail."""
    none = F.array().cast("array<string>")
    has = lambda c: F.length(c) > 0
    both = F.struct(
        _without_all_tail(clean_location(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " "))).alias("left"),
        _without_all_tail(clean_location(F.element_at(parts, -1))).alias("right"),
    )

    def fuse(p: Column) -> Column:
        left, right = p["left"], p["right"]
        good_left, good_right = has(left) & ~_is_all(left), has(right) & ~_is_all(right)
        return (
            F.when(has(left) & good_right, F.array(F.concat(left, F.lit(" ("), right, F.lit(")"))))
            .when(good_left, F.array(left))
            .when(good_right, F.array(right))
            .otherwise(none)
        )

    def alone(single: Column) -> Column:
        return F.when(has(single), F.filter(_split_tail(single), lambda p: has(p) & ~_is_all(p))).otherwise(none)

    return F.when(F.size(parts) >= 2, let(both, fuse)).when(
        F.size(parts) == 1, let(_without_all_tail(clean_location(F.get(parts, F.lit(0)))), alone)
    ).otherwise(none)


def distinct_by(a: Column, key) -> Column:
    """First element per key, in order, keys empty dropped."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("keys"))

    def step(acc: Column, x: Column) -> Column:
        return let(
            key(x),
            lambda k: F.when(
                (F.length(k) > 0) & ~F.array_contains(acc["keys"], k),
                F.struct(
                    F.concat(acc["out"], F.array(x)).alias("out"), F.concat(acc["keys"], F.array(k)).alias("keys")
                ),
            ).otherwise(acc),
        )

    return F.aggregate(a, start, step, lambda acc: acc["out"])


def locations(text: Column) -> Column:
    """Ordered, distinct location candidates of a preference text."""
    segments = F.split(text, WORD + r"\ben\b")
    segments = _filled(F.transform(F.slice(segments, F.lit(2), F.size(segments)), lambda x: F.trim(x)))
    parts = F.transform(segments, lambda x: F.transform(F.split(x, r"\s*[,，]\s*"), lambda p: F.trim(p)))
    parts = F.transform(parts, lambda p: _drop_tail_while(p, lambda x: x.rlike(ANY + POLYGON)))
    parts = F.transform(parts, lambda p: _drop_tail_while(p, _is_all))
    kept = drop_noise_locations(F.flatten(F.transform(parts, _candidates)))
    return distinct_by(F.flatten(F.transform(kept, _split_tail)), normalize_term)


def _pair(c: Column) -> Column:
    return c.rlike(rf"{ANY}^\s*({CITY_PAIR})\s*$")


def _tidy(t: Column) -> Column:
    s = F.regexp_replace(squeeze(F.regexp_replace(t, r"\s*/\s*", " / ")), r"^[ ,]+|[ ,]+$", "")

    def with_pair(x: Column) -> Column:
        whole = lambda p: F.coalesce((F.length(p["left"]) > 0) & (F.length(p["right"]) > 0), F.lit(False))
        fused = let(
            _slash_split(x),
            lambda p: F.when(whole(p), F.concat(p["left"], F.lit(" ("), p["right"], F.lit(")"))).otherwise(x),
        )
        return F.when(x.contains("("), x).otherwise(fused)

    return let(s, with_pair)


def _suffix_city(out: Column) -> Column:
    """A bare city next to bare quarters becomes their suffix."""
    def apply(city: Column) -> Column:
        return F.transform(
            out,
            lambda s: F.when(~s.contains("(") & ~_pair(s), F.concat(s, F.lit(" ("), city, F.lit(")"))).otherwise(s),
        )

    city = F.trim(F.get(F.filter(out, _pair), F.lit(0)))
    return let(city, lambda c: F.when((F.size(out) >= 2) & c.isNotNull(), apply(c)).otherwise(out))


def _drop_common_suffix(out: Column) -> Column:
    """A city suffix that no other city contradicts says nothing and goes."""
    own = rf"{ANY}\s*\(({CITY_PAIR})\)\s*$"
    foreign = lambda s: let(
        F.regexp_extract(s, r"\(([^)]+)\)\s*$", 1), lambda inner: (F.length(inner) > 0) & ~_pair(inner)
    )
    common = (F.size(out) >= 2) & F.exists(out, lambda s: s.rlike(own)) & ~F.exists(out, foreign)
    return F.when(common, F.transform(out, lambda s: F.trim(F.regexp_replace(s, own, "")))).otherwise(out)


def harmonize_city(tokens: Column) -> Column:
    """One spelling for quarters of the home city over the token list."""
    cut = F.transform(tokens, lambda t: _without_all_tail(F.trim(t)))
    out = F.transform(F.filter(cut, lambda t: (F.length(t) > 0) & ~_is_all(t)), _tidy)
    out = let(let(out, _suffix_city), _drop_common_suffix)
    out = let(out, lambda o: F.when(F.size(o) > 1, F.filter(o, lambda s: ~_pair(s))).otherwise(o))
    return distinct_by(out, lambda s: F.lower(squeeze(s)))


# ------------------------------------------------------------------ types
def word_singular(c: Column) -> Column:
    """Normalized term with every word in the singular."""
    return F.array_join(F.transform(F.split(normalize_term(c), " "), singular_es), " ")


def _has_word(text: Column, word: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"\b\Q"), word, F.lit(r"\E\b")))


def drop_subterms(types: Column) -> Column:
    """Drop a type that occurs as whole words inside another, longer one."""
    def inside_other(t: Column) -> Column:
        n = word_singular(t)
        return F.exists(types, lambda y: (F.length(n) > 0) & (word_singular(y) != n) & _has_word(word_singular(y), n))

    return F.filter(types, lambda t: ~inside_other(t))


def sorted_types(types: Column) -> Column:
    """Distinct, ordered by normalized form."""
    keyed = F.transform(types, lambda t: F.struct(normalize_term(t).alias("k"), t.alias("t")))
    return F.transform(F.sort_array(F.array_distinct(keyed)), lambda x: x["t"])


def canonical_types(types: Column) -> Column:
    """Aliases to one label, first of each normalized form."""
    renamed = F.transform(
        types, lambda t: F.when(normalize_term(singular_es(t)).isin(*ALIAS_TERMS), ALIAS_TYPE).otherwise(t)
    )
    return distinct_by(renamed, normalize_term)


def merge_slash_types(types: Column) -> Column:
    """A type that is one half of an 'X/Y' type of the list is dropped."""
    slashed = F.filter(types, lambda t: t.contains("/"))
    halves = lambda st: F.transform(F.split(st, "/"), lambda p: normalize_term(singular_es(p)))

    def covered(t: Column) -> Column:
        return F.exists(
            slashed,
            lambda st: (st != t)
            & (
                F.array_contains(halves(st), normalize_term(t))
                | F.array_contains(halves(st), normalize_term(singular_es(t)))
            ),
        )

    return sorted_types(F.filter(types, lambda t: ~covered(t)))


def capitalize_first(c: Column) -> Column:
    s = F.ltrim(c)
    return F.when(s.rlike(r"^\p{Ll}"), F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))).otherwise(c)


def has_room_lead(text: Column) -> Column:
    """'Habitación' occurs before the first comma."""
    return normalize_term(text).rlike(r"^[^,]*\bhabitaci[oó]n(es)?\b")


def is_generic(text: Column) -> Column:
    return text.rlike(WORD + r"\bbusca\s+inmueble\b")


def without_quantities(found: Column, numeric: Column) -> Column:
    """Matches (term, source) that only echo a stated quantity go."""
    echo = lambda m: numeric & (m["source"] == "text") & normalize_term(m["term"]).isin(*QUANTITY_TERMS)
    return F.filter(found, lambda m: ~echo(m))


def room_rule(types: Column, lead: Column) -> Column:
    """Rooms are a type only when they come before the first comma."""
    rest = F.filter(types, lambda t: ~normalize_term(t).isin("habitacion", "habitaciones"))
    return F.when(lead, F.array_append(rest, F.lit(ROOM_TYPE))).otherwise(rest)
