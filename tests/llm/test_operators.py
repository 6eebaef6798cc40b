"""Each operator against a plain version of its own, and on odd input."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from listing_engine.llm import byte_bpe, decontamination, fingerprints, language, licenses, near_duplicates, pii, toxicity, url_filters, warc
from tests.llm.conftest import SF

WORD = {c for c in map(chr, range(128)) if c.isascii() and (c.isdigit() or "a" <= c <= "z")}


# ---- fingerprints


def test_fingerprints_follow_the_next_document(spark, documents):
    got = {r["doc_id"]: r for r in fingerprints.op1_fingerprints(spark, SF).collect()}
    rows = sorted((r["doc_id"], r["text"] or "") for r in documents.collect())
    method = fingerprints.OrderMinHash()
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(method.signature(text))
        assert r["near_edited"] == fingerprints.likeness(method.signature(text), method.signature(changed))
        assert r["near_next"] == fingerprints.likeness(method.signature(text), method.signature(other))


def test_fingerprints_of_partitions_meet(spark, documents):
    few = fingerprints.neighbour_fingerprints(documents.limit(40).coalesce(1)).collect()
    many = fingerprints.neighbour_fingerprints(documents.limit(40).repartition(7)).collect()
    assert sorted(few) == sorted(many)


def test_fingerprint_lanes_by_hand():
    method = fingerprints.OrderMinHash(k=3, order=2, lanes=16, block=4)
    wide = fingerprints.OrderMinHash(k=3, order=2, lanes=16)
    for text in ("", "a", "ab", "abc", "abcd", "abcabcabcabc", "the quick brown fox jumps"):
        assert (method.signature(text) == wide.signature(text)).all()  # blocks don't matter
    swapped = wide.signature("lorem ipsum dolor sit amet consectetur"), wide.signature("sit amet consectetur lorem ipsum dolor")
    assert fingerprints.likeness(*swapped) < 0.8  # same k-mers nearly, other order


def test_fingerprints_odd(odd_docs, no_docs):
    rows = fingerprints.neighbour_fingerprints(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["near_next"] <= 1 for r in rows)
    same = {r["fingerprint"] for r in rows if r["n_chars"] == 22}
    assert len(same) == 1
    assert fingerprints.neighbour_fingerprints(no_docs).count() == 0
    alone = fingerprints.neighbour_fingerprints(odd_docs.filter("doc_id = 4")).first()
    assert alone["near_next"] == 1.0


# ---- URL filters


def test_rules(spark):
    urls = [
        ("http://x.org/a", "x.org", "/a", "org/", "allow"), ("HTTP://M.Example.ORG/es/1?q", "m.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"), ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("a://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("a://b.com/fr/x", "b.com", "/fr/x", "com/fr/", "allow"),
        ("a://b.com/de/x", "b.com", "/de/x", "com/de/", "block"), ("a://b.com?/de/", "b.com", "", None, None), ("a://x.org", "x.org", "", None, None),
        (None, "", "", None, None), ("no scheme", "", "", None, None), ("", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None),
    ]
    pages = spark.createDataFrame([(i, u[0], "h", "r") for i, u in enumerate(urls)], "page_id int, url string, host string, rule string")
    rows = sorted(url_filters.judge_urls(pages).collect())
    for r, (_, host, path, rule, verdict) in zip(rows, urls):
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_regression_learns():
    hosts = [f"{'bad' if i % 2 else 'fine'}{i}.net" for i in range(400)]
    model = url_filters.fit(hosts[:300], ["/"] * 300, [i % 2 == 1 for i in range(300)])
    assert ((model.scores(hosts[300:], ["/"] * 100) >= 0.5) == [i % 2 == 1 for i in range(300, 400)]).mean() > 0.95


# ---- byte-level BPE


def _tiktoken():
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, documents):
    library = _tiktoken()
    got = {r["doc_id"]: r for r in byte_bpe.op3_byte_bpe(spark, SF).collect()}
    for r in documents.collect():
        text = r["text"] or ""
        ids = np.array(library.encode_ordinary(text), "<u4")
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_any_text(texts):
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as f:
        replay = byte_bpe._replay(f.read(), public_tokenizers.PATTERN)
    texts = [t for t in texts if not any("\ud800" <= c <= "\udfff" for c in t)]
    for text, ids in zip(texts, replay.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == _LIBRARY.encode_ordinary(text)
        assert replay.decode(np.frombuffer(ids, "<u4")) == text.encode()


_LIBRARY = _tiktoken()



def test_byte_bpe_memory_keeps_words_in_use(monkeypatch):
    """When the memory is full, words that are met again stay, and the ids are the same."""
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 8)
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as f:
        replay = byte_bpe._replay(f.read(), public_tokenizers.PATTERN)
    replay = byte_bpe.Replay(replay.ranks, public_tokenizers.PATTERN)
    asked, plain = [], replay.packed_ids
    monkeypatch.setattr(replay, "packed_ids", lambda words: asked.extend(words) or plain(words))
    texts = [f"usualxyzq {i}abqx " + " ".join(f"zq{i}w{j}k" for j in range(3)) for i in range(20)]
    found = [replay.encode([t])[0] for t in texts]
    assert asked.count(b"usualxyzq") == 1 and len(replay.known) < 40
    fresh = byte_bpe.Replay(replay.ranks, public_tokenizers.PATTERN)
    assert found == fresh.encode(texts)


def test_lower_rank_appears_late():
    """A merge that lets a lower rank appear waits for it, as in one word alone."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 400, b"aba": 300, b"bab": 301, b"abab": 500}
    replay = byte_bpe.Replay(ranks, r"\w+")
    library = tiktoken.Encoding("small", pat_str=r"\w+", mergeable_ranks={t: i for i, t in enumerate(sorted(ranks, key=ranks.get))}, special_tokens={})
    order = {i: ranks[t] for i, t in enumerate(sorted(ranks, key=ranks.get))}
    for n in range(1, 12):
        for word in ("ab" * n, "ab" * n + "a", "b" + "ab" * n, "aab" * n):
            if word.encode() not in ranks:
                assert replay.ids([word.encode()])[0] == [order[i] for i in library.encode_ordinary(word)]


def test_bpe_odd(odd_docs, no_docs):
    rows = byte_bpe.encoded(odd_docs).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows) and len(rows) == odd_docs.count()
    assert byte_bpe.encoded(no_docs).count() == 0


# ---- decontamination


def _words(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_overlaps(spark, odd_docs, no_docs):
    item, filler = _words(40, 1), _words(60, 2)
    changed = [w if i % 9 else "other" for i, w in enumerate(item)]
    half = [w if i % 2 else "other" for i, w in enumerate(item)]
    texts = {1: filler + item + filler, 2: changed, 3: filler, 4: half, 5: filler + item[10:30], 6: item[:9], 7: [w.upper() + "," for w in item], 8: filler + item + filler + item}
    docs = spark.createDataFrame([(k, " ".join(v), "x") for k, v in texts.items()] + [(1, " ".join(texts[1]), "x"), (9, None, ""), (None, " ".join(item), "")], "doc_id long, text string, seed string")
    bench = spark.createDataFrame([(1, " ".join(item), 1), (2, "", 1), (3, None, 1), (None, "x", 1), (4, "too short", 1)], "item_id long, text string, place int")
    found = decontamination.overlaps(docs, bench).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 5, 7, 8} and {r["item_id"] for r in found} == {1}
    at = {(r["doc_id"], r["doc_word"]): r for r in found}
    assert at[1, 60]["n_words"] == at[1, 60]["n_equal"] == 40 and at[2, 0]["n_equal"] == 35 and at[5, 60]["item_word"] == 10
    assert {k[1] for k in at if k[0] == 8} == {60, 160}
    clean = decontamination.decontaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] or -1 for r in clean.collect()) == [-1, 3, 4, 6, 9]
    assert decontamination.overlaps(no_docs, bench).count() == 0 and decontamination.overlaps(docs, bench.limit(0)).count() == 0
    assert decontamination.overlaps(odd_docs, bench).count() == 0


def test_overlaps_shuffled_alike(spark, monkeypatch):
    broadcast = sorted(decontamination.op4_decontamination(spark, SF).collect())
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    assert sorted(decontamination.op4_decontamination(spark, SF).collect()) == broadcast


def _holds(doc, item):
    """Whether any 13 words or more on a diagonal (or the whole of a shorter item) agree in 0.8, by all runs."""
    for d in range(-len(item) + 1, len(doc)):
        same = [doc[i] == item[i - d] for i in range(max(0, d), min(len(doc), d + len(item)))]
        sums = np.concatenate(([0], np.cumsum([1 if s else -4 for s in same])))
        least = min(13, len(item))
        if any((sums[i + least :] >= sums[i]).any() for i in range(len(sums) - least)):
            return True
    return False


def _replaced(words, n, rnd):
    at = set(rnd.sample(range(len(words)), n))
    return [f"n{rnd.random()}".replace(".", "") if i in at else w for i, w in enumerate(words)]


def _against_brute_force(spark, docs, items):
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{name} long, text string")
    found = decontamination.overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert all(r["n_equal"] >= 0.8 * r["n_words"] and r["n_words"] >= min(13, len(items[r["item_id"]])) for r in found)
    for r in found:
        pairs = zip(docs[r["doc_id"]][r["doc_word"] :][: r["n_words"]], items[r["item_id"]][r["item_word"] :][: r["n_words"]], strict=True)
        assert sum(a == b for a, b in pairs) == r["n_equal"]
    return {r["doc_id"] for r in found}, {i for i, d in enumerate(docs) if any(_holds(d, item) for item in items)}


def test_parts_whose_outer_windows_miss(spark):
    """14 to 15 words of a longer item, the third and the third last replaced: hits lie in the middle alone."""
    rnd, item = random.Random(4), _words(60, 41)
    docs = []
    for n in (13, 14, 15):
        for at in range(0, 40, 4):
            part = item[at : at + n]
            docs.append(_words(20, at) + part[:2] + ["x"] + part[3:] + _words(20, n))
            docs.append(_words(20, at) + part[:2] + ["x"] + part[3:-3] + ["y"] + part[-2:] + _words(20, n))
    two = item[:20] + _words(30, 8) + item[50:]
    docs += [two, _words(30, 1), _replaced(item, 30, rnd)]
    got, want = _against_brute_force(spark, docs[:-2:2] + docs[-2:], [item])
    assert got == want and want


def test_every_overlap_has_a_seed():
    """All substitutions that leave 0.8 of up to 24 words: some mask fits between them."""
    for n in range(1, 25):
        masks = [*decontamination.MASKS, *decontamination.SHORT.get(n, ())]
        laid = [sum(1 << at + i for i, sign in enumerate(m) if sign == "1") for m in masks for at in range(n - len(m) + 1)]
        for changed in combinations(range(n), n // 5):  # fewer substitutions leave more
            gone = sum(1 << c for c in changed)
            assert any(not gone & m for m in laid), (n, changed)


def test_short_and_changed_items(spark):
    """Whole items of 1 to 30 words within 0.8, and parts of 13 words and more of a longer one."""
    rnd, items, docs = random.Random(6), [_words(60, 42)], []
    for n in range(1, 31):
        items.append(_words(n, 500 + n))
        docs += [_words(20, n) + _replaced(items[-1], rnd.randint(0, n // 5 + (k > 3)), rnd) + _words(20, 90 + n) for k in range(5)]
        docs.append(items[-1])
    for n in (13, 14, 15, 20, 30):
        docs += [_words(20, n) + _replaced(items[0][at : at + n], n // 5, rnd) + _words(20, 90 + n) for at in range(0, 30, 3)]
    got, want = _against_brute_force(spark, docs, items)
    assert got == want


def test_whole_items_are_found(spark, documents):
    """Every document that holds an item word by word is reported."""
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    items = {r["item_id"]: split(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d["doc_id"], k) for d in documents.collect() for k, item in items.items() if f" {' '.join(item)} " in f" {' '.join(split(d['text']))} " and len(item) >= 11}
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontamination.op4_decontamination(spark, SF).collect()}


# ---- licenses


def _license_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if c.isascii() else c
        if c in WORD or c > "\x7f":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def test_base_phrases(spark, documents, odd_docs, no_docs):
    extra = spark.createDataFrame([(1, "MIT License, mit license; the Apache license. GENERAL public  license"), (2, "mit\nlicense mit"), (3, "mit licenses"), (4, "\u212ait mit licensé")], "doc_id long, text string")
    for docs in (documents, odd_docs, extra):
        got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(docs).collect()}
        for d in docs.collect():
            words = _license_words(d["text"])
            hits = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
            r = got[d["doc_id"], len(words)]
            places = [h[0] for h in hits]
            assert (r["n_base"], r["first_word"], r["last_word"]) == (len(hits), min(places, default=None), max(places, default=None))
            assert r["base_labels"] == ",".join(sorted({h[1] for h in hits})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert licenses.scan(no_docs).count() == 0


def test_templates_with_changes(spark):
    words = licenses.TEMPLATES[0][0].split()
    texts = [" ".join(words), " ".join([*words[:8], "really", *words[8:]]), " ".join(words[:9] + words[10:]), " ".join(words[:5]), " ".join(reversed(words))]
    rows = sorted(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r["labels"] for r in rows] == ["mit", "mit", "mit", "", ""] and rows[0]["score"] == 1.0 and 0.7 <= rows[1]["score"] <= 1


# ---- PII


@given(st.integers(1, 3000))
@settings(max_examples=30, deadline=None)
def test_feistel_is_a_permutation(n):
    f = pii.Feistel("key")
    assert sorted(f.permute(i, n, "x") for i in range(n)) == list(range(n))


def test_pseudonyms():
    text = "Card 4111 1111 1111 1111, mail jo.smith@mail.example.org, call +1 (632) 555-4827 on 2024-02-29 or 31.12.1999; IBAN DE89 3704 0044 0532 0130 00, 10.1.2.3, 078-05-1120, password=abc12345"
    new, counts = pii.pseudonymized(text)
    assert counts == {"card": 1, "email": 1, "phone": 1, "date": 2, "iban": 1, "ipv4": 1, "ssn": 1, "secret": 1}
    for value in ("4111 1111 1111 1111", "jo.smith@", "555-4827", "2024-02-29", "31.12.1999", "3704 0044", "10.1.2.3", "078-05-1120", "abc12345"):
        assert value not in new
    found = pii._EACH["card"].search(new)[0]
    assert pii.luhn_sum(found.replace(" ", "")) % 10 == 0 and len(found) == 19
    assert pii.pseudonymized(new)[1] == counts  # all pseudonyms are valid values themselves
    assert pii.pseudonymized("x 4111 1111 1111 1111 y")[0][2:21] == new[5:24]  # equal values stay linked
    other = pii.pseudonymized(text, "another key")[0]
    assert other != new
    clean = "Version 3.14 of 12 apples, 2024-13-45, 999.1.1.1, 4111 1111 1111 1112, a@b, tokens are 5"
    assert pii.pseudonymized(clean) == (clean, {})


def test_values_at_every_distance_from_a_sign():
    """As many words as may be between a digit or '@' and a value: the same as a scan of the whole text."""
    values = ("password: hunterhunter", 'token = "abcdef123456"', "NL91 ABNA 0417 1643 00", "DE89 3704 0044 0532 0130 00", "4111 1111 1111 1111", "+1 (632) 555-4827", "jo.smith@mail.example.org", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1")
    for sign in ("5", "a@b", "token"):
        for value in values:
            alone = pii.pseudonymized(value)[0]
            assert alone != value
            for n in range(40):
                before = f"Room {sign} " + "one\t" * (n // 2) + "two " * (n - n // 2)
                assert pii.pseudonymized(f"{before}{value} end") == (f"{before}{alone} end", pii.pseudonymized(value)[1]), (sign, n, value)
    rnd = random.Random(3)
    for _ in range(300):
        text = " ".join(rnd.choice([*values, "7", "x@", *["word"] * 9]) for _ in range(60))
        whole = [m.start() for m in pii._ANY.finditer(text)]
        near = [m.start() for a, b in pii._neighbourhoods(text) for m in pii._ANY.finditer(text, a, b)]
        assert near == whole


def test_pii_odd(odd_docs, no_docs):
    done = pii.pseudonymize(odd_docs)
    assert sorted(done.columns) == sorted(odd_docs.columns) and [r["text"] for r in done.filter("doc_id = 0").collect()] == [None]
    assert done.count() == odd_docs.count() and pii.pseudonymize(no_docs).count() == 0


# ---- language


def test_language_held_out(spark, documents):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.op7_language(spark, f"{SF}/../sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert len(right) > 200 and np.mean(right) > 0.95


def test_filters_hold_what_was_put_in():
    grams = {f"l{i}": np.random.default_rng(i).integers(0, 2**63, 500).astype(np.uint64) for i in range(10)}
    filters = language.BitSlicedFilters.build(grams)
    for bit, name in enumerate(sorted(grams)):
        assert ((filters.contains(grams[name]) >> bit) & 1).all()
    strange = np.random.default_rng(99).integers(0, 2**63, 20_000).astype(np.uint64)
    seen = np.array([np.mean((filters.contains(strange) >> b) & 1) for b in range(10)])
    assert np.abs(seen - filters.wrong).max() < 0.01


def test_language_odd(odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in language.identify(odd_docs).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == rows[2]["lang_pred"] == "und" and rows[5]["lang_pred"] == "en"
    assert language.identify(no_docs).count() == 0
    assert language.identify(odd_docs.filter("lang is null")).filter("lang_pred <> 'und'").count() == 0


# ---- WARC


def _warc_wanted(rows):
    best = {}
    for page, html in rows:
        if page is not None:
            best[html or ""] = max(best.get(html or "", page), page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        kept = best.get(html or "")
        again = kept is not None and (page is None or page < kept)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", kept if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [0, 500_000])
def test_warc_round_trip(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", limit)
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "Ü\r\n\r\nWARC/1.1\r\n\r\n"), (6, "b" * 300_000), (None, "a"), (None, "only"), (7, "b" * 300_000), (7, "b" * 300_000)]
    pages = spark.createDataFrame([(p, f"http://x/{p}\r\nWARC-Type: evil" if p == 1 else None, h, "z") for p, h in rows], "page_id long, url string, html string, digest string")
    (tmp_path / "t").mkdir()
    pages.write.parquet(str(tmp_path / "t/pages.parquet"))
    got = sorted((tuple(r) for r in warc.op8_warc(spark, str(tmp_path / "t")).collect()), key=repr)
    assert got == _warc_wanted(rows)
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_warc_pages(spark):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in warc.op8_warc(spark, SF).collect()), key=repr) == _warc_wanted(rows)


def test_warc_predicates_reach_the_reader(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x"), (3, "http://b/c", "y")], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    path = str(tmp_path / "w")
    df = warc.read_warc(spark, path, payload=False)
    assert df.filter("record_type = 'revisit'").count() == 1 and [r["payload"] for r in df.collect()] == [None] * 3
    chosen = warc.read_warc(spark, path, where=F.expr("target_uri like 'http://b%' and record_type = 'response'"))
    assert {r["record_id"] for r in chosen.collect()} == {"<urn:page:2>", "<urn:page:3>"}
    assert spark.read.format("warc").option("recordType", "revisit").load(path).count() == 1
    reader = warc.PushingWarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("content_length",), 3)]))
    assert len(left) == 1 and len(reader.wanted) == 1
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 1


# ---- near-duplicates


def _components(prints, ids):
    """Brute force over all pairs of fingerprints."""
    codes = np.array(sorted(set(prints)), np.uint64)
    lead = {int(c): int(c) for c in codes}

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i, c in enumerate(codes):
        for d in codes[i + 1 :][np.bitwise_count(codes[i + 1 :] ^ c) <= 4]:
            lead[max(root(int(c)), root(int(d)))] = min(root(int(c)), root(int(d)))
    least = {}
    for p, i in zip(prints, ids):
        least[root(p)] = min(least.get(root(p), i), i)
    return {i: least[root(p)] for p, i in zip(prints, ids)}


def _simhash(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    for c in "\t\n\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    n = min(4, len(words))
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []
    h = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark, documents, odd_docs):
    got = {r["doc_id"]: r for r in near_duplicates.op9_near_duplicates(spark, SF).collect()}
    rows = [(r["doc_id"], _simhash(r["text"])) for r in documents.collect()]
    want = _components([p for _, p in rows], [i for i, _ in rows])
    assert {i: (f"{p:016x}", want[i]) for i, p in rows} == {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()}
    found = near_duplicates.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count() and {r["component_id"] for r in found if r["doc_id"] in (0, 1, 2)} == {0}
    assert len(near_duplicates.deduplicated(odd_docs).filter("doc_id in (5, 6)").collect()) == 1


@pytest.mark.parametrize("part", [16, 8192])
def test_links_of_chains_and_balls(spark, monkeypatch, part):
    monkeypatch.setattr(near_duplicates, "PART", part)
    rnd = random.Random(5)
    codes = {rnd.getrandbits(64) for _ in range(300)}
    for _ in range(6):
        c = rnd.getrandbits(64)
        for _ in range(60):  # chains
            codes.add(c)
            c ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6)))
        codes |= {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(150)}  # balls
    codes = sorted(codes)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    want = _components(codes, signed)
    roots = {r["node"]: r["root"] for r in near_duplicates.components(near_duplicates.star_links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    groups, wanted = defaultdict(set), defaultdict(set)
    for s in signed:
        groups[roots.get(s, s)].add(s)
        wanted[want[s]].add(s)
    assert set(map(frozenset, groups.values())) == set(map(frozenset, wanted.values()))


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**63, 20).astype(np.uint64)
    codes = np.unique(np.concatenate([a ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for _ in range(40)]))
    codes = codes[np.argsort(near_duplicates.gray_rank(codes))]
    index = near_duplicates.GrayIndex(codes, leaf=8, fan=4)
    found = {(int(i), int(j)) for x, y in index.links(4) for i, j in zip(x, y)}
    assert found == {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 4}


def _changed(words, every):
    """Every `every`-th word replaced; J of five-word shingles is about (1 - 5/every) / (1 + 5/every)."""
    return [w if i % every else f"new{i}" for i, w in enumerate(words)]


def test_similar_texts(spark, documents):
    rows = []
    for k in range(40):
        base = _words(400, 100 + k)
        rows += [(10 * k, base), (10 * k + 1, _changed(base, 100)), (10 * k + 2, _changed(base, 8)), (10 * k + 3, base[:200] + _words(200, 900 + k))]
    docs = spark.createDataFrame([(i, "  ".join(w).upper() if i % 2 else " ".join(w)) for i, w in rows] + [(5, None), (7, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.similar_texts(docs).collect()}
    assert all(got[10 * k + 1] == 10 * k for k in range(40))  # J of 0.9
    assert all(got[10 * k + j] == 10 * k + j for k in range(40) for j in (2, 3))  # J of 0.2 and 0.3
    assert got[5] == got[7] == 5


def test_similar_texts_of_documents(spark):
    """All pairs at 0.8 by brute force; what is linked below 0.65 would be a loss of clean documents."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/../sf0.01/documents.parquet").collect()}
    sets = {i: frozenset(near_duplicates.shingles(t or "", 5)) for i, t in docs.items()}
    prints = {i: np.frombuffer(near_duplicates.wide_simhash(t or ""), "<u8") for i, t in docs.items()}
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.similar_texts(spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")).collect()}
    allowed = near_duplicates.wide_distance(0.8)[1]
    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if min(len(sets[i]), len(sets[j])) < 0.6 * max(len(sets[i]), len(sets[j])):
                continue
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            likeness = both / either if either else 1.0
            if likeness >= 0.9:
                assert got[i] == got[j], (i, j, likeness)
            if np.bitwise_count(prints[i] ^ prints[j]).sum() <= allowed:
                assert likeness > 0.6, (i, j, likeness)


@pytest.mark.parametrize("part", [40, 32_768])
def test_wide_links_of_a_large_group(spark, monkeypatch, part):
    monkeypatch.setattr(near_duplicates, "WIDE_PART", part)
    base = _words(300, 3)
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(150)] + [" ".join(_words(300, 50 + i)) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.similar_texts(docs).collect()}
    assert got == {i: 0 if i < 150 else i for i in range(250)}


def _brute_components(texts):
    """Components of all pairs at 0.8 of the distinct five-word shingles."""
    sets = [frozenset(near_duplicates.shingles(t, 5)) for t in texts]
    lead = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if lead[i] != lead[j] and 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                low, high = sorted((lead[i], lead[j]))
                lead = [low if x == high else x for x in lead]
    return dict(enumerate(lead))


@pytest.mark.parametrize("part", [16, 2048])
def test_similar_texts_by_brute_force(spark, monkeypatch, part):
    """Pairs from 0.75 to 0.9, short texts, and a large family at about 0.65 to 0.7 of each other."""
    monkeypatch.setattr(near_duplicates, "EXACT_PART", part)
    rnd = random.Random(8)

    def turned(words, n):
        at = set(rnd.sample(range(len(words)), n))
        return [f"n{rnd.random()}" if i in at else w for i, w in enumerate(words)]

    texts = []
    for k in range(150):
        base = _words(rnd.choice((60, 200, 400)), 300 + k)
        texts += [base, base[: rnd.randint(len(base) * 78 // 100, len(base) * 90 // 100)], turned(base, max(1, len(base) * rnd.randint(15, 30) // 1000))]
        short = _words(rnd.randint(3, 45), 700 + k)
        texts += [short, short[:-1], short[: -rnd.randint(1, 9)]]
    family = _words(400, 5)
    texts += [turned(family, 8) for _ in range(200)]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.similar_texts(docs).collect()}
    assert got == _brute_components(texts)


def test_near_duplicates_empty(no_docs):
    assert near_duplicates.similar_texts(no_docs).count() == 0
    assert near_duplicates.near_duplicates(no_docs).count() == 0 and near_duplicates.deduplicated(no_docs).count() == 0


# ---- toxicity


def test_toxicity_held_out(spark):
    sf = f"{SF}/../sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op10_toxicity(spark, sf).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    seen = Counter((toxic[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in toxic)
    # the small tables label many texts as toxic that share no word with others
    assert seen[1, 1] > 0.5 * (seen[1, 0] + seen[1, 1]) and seen[0, 1] < 0.02 * (seen[0, 0] + seen[0, 1])


def test_toxicity_misspelt():
    rnd = random.Random(1)
    plain = [" ".join(_words(rnd.randint(5, 80), i)) for i in range(400)]
    texts = [f"{t} horrible {t}" if i % 2 else t for i, t in enumerate(plain)]
    model = toxicity.fit(texts, [i % 2 for i in range(400)])
    low, high = model.scores([plain[2], plain[2].replace(" ", " horribble ", 3)])
    assert low < 0.5 < high


def test_toxicity_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(None, 1, 1), (5, 0, None), (6, 1, 1), (6, 1, 1), (3, 0, 0), (4, 0, 0), (7, 0, 7)], "doc_id long, score int, toxic int")
    rows = toxicity.toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["toxicity_score"] <= 1 for r in rows)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert {r["toxicity_score"] < 0.5 for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect()} == {True}
