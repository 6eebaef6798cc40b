"""Vocabulary induction and the preference parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_engine.functions import prefs as R
from listing_engine.functions import text as X
from listing_engine.operators.dedupe import keep_first_array
from listing_engine.operators.filters import interleaved_chain

# Words that end an "en ..." fragment.
FRAGMENT_END = r"\bo\s+en\b|,|\.|\bpara\b|\bcon\b|\bhasta\b|\bentre\b|\bdesde\b"


def with_plain_text(contacts: DataFrame, column: str = "pref_text") -> DataFrame:
    return contacts.withColumns({"text__": X.html_text(F.col(column)), "spans__": X.html_spans(F.col(column))})


def _mentions(text: Column, part: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.concat(F.lit(R.WORD + r"\b\Q"), part, F.lit(r"\E\b"))), F.lit(False))


def induce_vocabulary(contacts: DataFrame, column: str = "pref_text", key: str = "id") -> DataFrame:
    """(kind, term) learned from where the labelled words occur.

    A label is a type when it is seen in "Busca ... para" at least as often as
    in "en ..." fragments, a condition by its form. Counts are combined per
    task before the shuffle, so a label used by everyone is no hot group.
    """
    base = with_plain_text(contacts.filter(F.col(column).isNotNull()), column)
    busca = F.nullif(X.squeeze(F.regexp_extract("text__", R.WORD + r"\bBusca\b(.*?)(?:\bpara\b|$)", 1)), F.lit(""))
    pieces = F.split("text__", R.WORD + r"\ben\b")
    fragments = F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda seg: X.squeeze(F.element_at(F.split(seg, R.WORD + FRAGMENT_END, 2), 1)),
    )
    spans = (
        base.withColumns({"busca__": busca, "frags__": fragments, "numeric__": R.numeric_context(F.col("text__"))})
        .select(key, "busca__", "frags__", "numeric__", F.posexplode("spans__").alias("pos__", "span__"))
        .withColumn("part", X.squeeze(F.replace("span__", F.lit(","), F.lit(" "))))
        .withColumn("norm", X.normalize_term(F.col("part")))
        .filter(F.length("norm") > 0)
    )
    n = F.col("norm")
    in_busca = _mentions(F.col("busca__"), F.col("part"))
    in_place = F.exists("frags__", lambda f: _mentions(f, F.col("part")))
    quantity = X.looks_like("quantity", n) & (F.col("numeric__") | ~in_busca)
    rows = spans.filter(~X.looks_like("operation", n) & ~X.looks_like("numeric", n) & ~quantity).select(
        "norm",
        "part",
        X.looks_like("condition", n).alias("is_condition"),
        in_busca.cast("bigint").alias("b"),
        in_place.cast("bigint").alias("l"),
        F.struct(F.col(key), F.col("pos__")).alias("at"),
    )
    seen = rows.groupBy("norm", "is_condition").agg(
        F.sum("b").alias("b"),
        F.sum("l").alias("l"),
        F.min_by("part", "at").alias("first_form"),
        F.max_by("part", "at").alias("last_form"),
    )
    types = seen.filter(~F.col("is_condition") & (F.col("b") > 0) & (F.col("b") >= F.col("l"))).select(
        F.lit("type").alias("kind"), R.capitalize_first(X.singular_es(F.col("first_form"))).alias("term")
    )
    cond_norm = X.normalize_term(F.col("last_form"))
    conditions = seen.filter(
        F.col("is_condition") & (cond_norm.startswith("a ") | cond_norm.startswith("en ") | ~cond_norm.contains(" "))
    ).select(F.lit("condition").alias("kind"), F.col("last_form").alias("term"))
    return types.unionByName(conditions).distinct()


def vocabulary_hits(texts: DataFrame, vocab: DataFrame, key: str = "id") -> DataFrame:
    """N5 stage 1 / N6: vocabulary terms found per text as arrays of (term,
    source), one column per kind.

    A text's words are joined with the first words of the spellings by equality;
    only where one meets is the rest of the spelling compared, with what follows
    that word in the text. So neither side is tried against all of the other, no
    word runs are formed, and a long label costs no more than a short one.
    """
    kinds = vocab.select(
        "kind", F.when(F.col("kind") == "type", X.singular_es(F.col("term"))).otherwise(F.col("term")).alias("term")
    ).distinct()
    pieces = lambda c: F.regexp_extract_all(c, F.lit(r"\w+|\W+"), 0)
    is_word = lambda c: c.rlike(r"^\w")
    spelled = (
        kinds.withColumn("spelling", F.explode(X.plural_variants(X.normalize_term(F.col("term")))))
        .withColumns({"word": F.get(pieces(F.col("spelling")), F.lit(0)), "size": F.size(pieces(F.col("spelling")))})
        .filter(is_word(F.col("word")) & (F.col("size") % 2 == 1))  # begins and ends with a word
    )
    source = F.array(
        F.struct(F.lit("text").alias("source"), F.array(X.normalize_term(F.col("text__"))).alias("parts")),
        F.struct(F.lit("span").alias("source"), F.transform("spans__", X.normalize_term).alias("parts")),
    )
    cut = texts.select(key, F.inline(source)).select(key, "source", F.transform("parts", pieces).alias("parts"))
    placed = cut.select(key, "source", F.posexplode("parts").alias("part", "pieces")).select(key, "source", "part", F.posexplode("pieces").alias("at", "word"))
    first = placed.filter(is_word(F.col("word"))).join(spelled, "word")
    # few places of a text begin a term, so the lists stay short
    found = first.groupBy(key, "source").agg(F.collect_set(F.struct("part", "at", "size", "spelling", "kind", "term")).alias("found"))
    same = lambda parts, f: F.array_join(F.slice(F.get(parts, f["part"]), f["at"] + 1, f["size"]), "") == f["spelling"]
    whole = F.filter("found", lambda f: same(F.col("parts"), f))
    hits = cut.join(found, [key, "source"]).select(key, "source", F.explode(whole).alias("f")).groupBy(key, F.col("f.kind").alias("kind"), F.col("f.term").alias("term"))
    hits = hits.agg(F.min("source").alias("source"))
    # one text holds few terms, so the lists below stay short; "span" < "text"
    listed = F.sort_array(F.collect_list(F.struct("term", "source")))
    per_kind = hits.groupBy(key).pivot("kind", ["type", "condition"]).agg(listed)
    return per_kind.withColumnsRenamed({"type": "type_hits", "condition": "condition_hits"})


def parse_preferences(contacts: DataFrame, vocab: DataFrame, key: str = "id", column: str = "pref_text") -> DataFrame:
    """Contacts with their structured preferences: operation, types,
    conditions, counts, area, price, locations and flags."""
    base = with_plain_text(contacts, column)
    joined = base.join(vocabulary_hits(base, vocab, key), key, "left")
    t = F.col("text__")
    none = F.array().cast("array<string>")
    ranges = {
        "rooms": R.quantity_range(t, R.ROOMS), "bath": R.quantity_range(t, R.BATHS), "living": R.quantity_range(t, R.LIVING),
        "area": R.area_range(t), "price": R.price_range(t),
    }
    staged = joined.withColumns({f"{n}__": r for n, r in ranges.items()})
    # the type rules apply one after the other
    found = R.without_quantities(F.coalesce("type_hits", F.array().cast("array<struct<term:string,source:string>>")), R.numeric_context(t))
    staged = staged.withColumn("types", F.transform(found, lambda m: m["term"]))
    for rule in (
        lambda c: R.room_rule(c, R.has_room_lead(t)),
        R.drop_subterms,
        R.canonical_types,
        R.merge_slash_types,
        R.drop_subterms,
        lambda c: F.when(R.is_generic(t), F.array(F.lit(R.GENERIC_TYPE))).otherwise(c),
        lambda c: R.sorted_types(F.transform(c, R.capitalize_first)),
    ):
        staged = staged.withColumn("types", rule(F.col("types")))
    staged = staged.withColumn("locations", R.locations(t)).withColumn("locations", R.harmonize_city(F.col("locations")))
    bounds = {
        "rooms_min": ("rooms", "lo", "int"), "rooms_max": ("rooms", "hi", "int"), "bath_min": ("bath", "lo", "int"),
        "bath_max": ("bath", "hi", "int"), "living_min": ("living", "lo", "int"), "living_max": ("living", "hi", "int"),
        "area_min_m2": ("area", "lo", "double"), "area_max_m2": ("area", "hi", "double"),
        "price_min_eur": ("price", "lo", "double"), "price_max_eur": ("price", "hi", "double"),
    }
    keep = [c for c in contacts.columns if c not in (*bounds, "operation", "types", "conditions", "locations", "flags")]
    hits = F.coalesce("condition_hits", F.array().cast("array<struct<term:string,source:string>>"))
    return staged.select(
        *keep,
        R.operations(t).alias("operation"),
        F.coalesce("types", none).alias("types"),
        F.transform(hits, lambda m: m["term"]).alias("conditions"),
        *[F.col(f"{src}__.{end}").try_cast(kind).alias(name) for name, (src, end, kind) in bounds.items()],
        "locations",
        R.flags(t).alias("flags"),
    )


def distinct_preference_texts(contacts: DataFrame, column: str = "pref_text", key: str = "id") -> DataFrame:
    """One text per distinct word array (the first by key), without the
    long "o en o en" chains."""
    words = contacts.withColumn("words", X.unlabelled_tokens(F.col(column)))
    return keep_first_array(words, "words", key).filter(~interleaved_chain(F.col("words"))).select(key, column)
