"""The training-data operators on small rows: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import itertools
import math
import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwise.llm import bpe, decontaminate, graph, jaccard_join, language, licenses, line_rules, rule_ensemble, shards, suffix_tree, text_stats, url_filter

# Names the operators use inside, and results of other operators.
CLASH = ("score", "k1", "k2", "h", "n", "row", "_row", "_parts", "_lines", "_stats", "_xh", "_id", "_leak", "shard", "word", "host", "item", "tile", "root", "kept", "_at", "_in")


def rng(seed=1):
    return random.Random(seed)


def words(r, n, size=400):
    return [f"w{r.randrange(size)}x" for _ in range(n)]


def spelled(w):
    """A word of letters for one with digits."""
    return w.translate(str.maketrans("0123456789", "abcdefghij"))


ODD = [None, "", " \n\t ", "a", "Ünïcode  wörds\u2003here", "one two three", "x" * 70_000, "spam " * 5_000]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, a repeated row, and columns with clashing names."""
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(ODD)]
    rows += [rows[3], rows[5], (None, "null id text of some words", None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# ---- language ----


def test_language_learns_and_knows_the_unknown(spark, odd, nothing):
    texts = {"aa": "the quick brown fox and the lazy dog " * 5, "bb": "der schnelle braune fuchs und der faule hund " * 5}
    train = spark.createDataFrame([(t, lang) for lang, t in texts.items()] + [(None, "aa"), ("", "bb"), ("12 34", None)], "text string, lang string")
    profiles = language.prototypes(train)
    assert sorted(profiles) == ["aa", "bb"]
    got = {r.doc_id: r for r in language.identify(odd, profiles, keep=("doc_id",)).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[0].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(odd, profiles, keep=("doc_id", "score")).count() == odd.count()
    probe = spark.createDataFrame([("the dog and the fox",), ("der hund und der fuchs",), ("123 !?",)], "text string")
    assert [r.lang_pred for r in language.identify(probe, profiles).collect()] == ["aa", "bb", "und"]
    assert language.prototypes(nothing) == {} and language.identify(nothing, profiles).count() == 0
    assert {r.lang_pred for r in language.identify(probe, {}).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_vectors():
    letters = language.Letters(64, 3)
    keys, counts = letters.count("Abc abc")
    assert counts.sum() == 7  # " ab", "abc", "bc " twice each, and "c a"
    expected = np.zeros(64)
    padded = " abc abc "
    for i in range(len(padded) - 2):
        v = [np.roll(letters.letter(ord(c)).astype(int), k) for k, c in enumerate(padded[i : i + 3])]
        expected += v[0] * v[1] * v[2]
    assert np.array_equal(letters.bundle(keys, counts), expected)


# ---- byte-level BPE ----


def reference_ids(text):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    return enc.encode_ordinary(text)


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (50, 12)])
def test_bpe_is_the_library(spark, odd, nothing, chunk, overlap):
    tricky = ["  \n\n x\t\ty   z", "don't we'll  'sabc 123abc  ", "é" * 300, "a b " * 100 + " " * 80 + "end", "日本語テキスト" * 30, "\u2028 \x85 x"]
    df = odd.unionByName(spark.createDataFrame([(100 + i, t, None, None, 0) for i, t in enumerate(tricky)], odd.schema[:5]), allowMissingColumns=True)
    if chunk == 50:
        df = df.filter("length(coalesce(text, '')) < 5000")
    rows = bpe.round_trip(df, chunk=chunk, overlap=overlap).collect()
    assert len(rows) == df.count() and set(CLASH) <= set(rows[0].asDict())
    for r in rows:
        ids = reference_ids(r.text or "")
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.round_trip(nothing).count() == 0


def test_stitch_stops_where_nothing_is_certain():
    assert bpe.stitch([(0, [], [10, 12]), (1, [9, 12], [20]), (2, [20], [])]) == [0, 12, 20]
    assert bpe.stitch([(0, [], [10]), (1, [11], [20]), (2, [20], [])]) == [0]


# ---- shards ----


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards_are_exact_and_keep_every_row(odd, n):
    rows = shards.shuffle_into_shards(odd, n, blocks=5).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(n)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards_of_nothing_and_of_one_key(spark, nothing):
    assert shards.shuffle_into_shards(nothing, 4).count() == 0
    same = spark.createDataFrame([(1, "x")] * 100, "doc_id long, text string")
    assert sorted(r["count"] for r in shards.shuffle_into_shards(same, 8).groupBy("shard").count().collect()) == [12] * 4 + [13] * 4


def test_shards_are_a_uniform_shuffle(spark):
    df = spark.range(40).withColumnRenamed("id", "doc_id")
    seen = Counter()
    for seed in range(8):
        for r in shards.shuffle_into_shards(df, 4, seed=seed, blocks=4).collect():
            seen[(r.doc_id // 20, r.shard)] += 1
    assert all(20 <= c <= 60 for c in seen.values()) and len(seen) == 8  # 40 expected


def test_matrix_margins():
    m = shards.communication_matrix([5, 0, 9, 3], 3, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 9, 3] and m.sum(axis=0).tolist() == [6, 6, 5]


# ---- URLs ----


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.ORG/es/1", "http://x.example.org/en/12?casino", "http://shop.com/fr/casino", "http://shop.com/de/",
        "http://casino.net/", "http://casinos.net/", "http://cheap-pills.net/", "http://cheap-cheap.net/", "a://b://c/d", "http://h?x=/y", "http://net#f",
    ]
    df = spark.createDataFrame([(i, u, 1, "z") for i, u in enumerate(urls)], "page_id int, url string, host int, verdict string")
    rows = {r.page_id: r.url_verdict for r in url_filter.judge_urls(df).collect()}
    got = [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(len(urls))]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/1", "example.org/es/", "block"),
        ("x.example.org", "/en/12", "example.org/en/1", "block"), ("shop.com", "/fr/casino", "com/fr/", "allow"), ("shop.com", "/de/", "com/de/", "block"),
        ("casino.net", "/", None, "block"), ("casinos.net", "/", None, "allow"), ("cheap-pills.net", "/", None, "block"),
        ("cheap-cheap.net", "/", None, "allow"), ("b:", "//c/d", None, "allow"), ("h", "", None, "allow"), ("net", "", None, "allow"),
    ]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


# ---- suffix tree ----


def brute_base(train, text):
    counts = Counter()
    for t in train:
        counts.update((t or "").encode().lower().split())
        counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    tokens = [*(text or "").encode().lower().split(), "end"]
    return len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)


@pytest.mark.parametrize("kept", [1 << 18, 20])
def test_suffix_tree_base_and_gain(spark, odd, monkeypatch, kept):
    monkeypatch.setattr(suffix_tree, "KEPT_WORDS", kept)
    r = rng(5)
    texts = [" ".join(w for _ in range(40) for w in ("alpha", "beta", r.choice(["gamma", "delta"]))) for _ in range(20)]
    train = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")
    model, counts = suffix_tree.train(train)
    assert len(model.states) > 1
    rows = suffix_tree.score(odd, model, counts, keep={"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
    assert len(rows) == odd.count()
    for row in rows:
        n, known, total, base = brute_base([*texts, None, ""], row.text)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (n, known, total)
        assert row.base_score == pytest.approx(base, rel=1e-9) and row.score < 0
    probe = spark.createDataFrame([(texts[0],)], "text string")
    first = suffix_tree.score(probe, model, counts, keep={"i": F.lit(1)}).first()
    assert first.score > 0.5 * first.base_score  # less than half the bits of the base


def test_suffix_tree_without_training(spark, odd, nothing):
    model, counts = suffix_tree.train(nothing)
    rows = suffix_tree.score(odd, model, counts, keep={"doc_id": F.col("doc_id")}).collect()
    assert len(rows) == odd.count() and {r.base_score for r in rows} == {0.0} and {r.train_tokens for r in rows} == {0}
    assert suffix_tree.score(nothing, model, counts, keep={"doc_id": F.col("doc_id")}).count() == 0


def test_a_pair_is_named_about_once(spark, monkeypatch):
    r = rng(21)
    base = words(r, 120, 5_000)
    texts = [" ".join(base)]
    for _ in range(60):  # near copies, many of them just beyond the threshold
        ws = list(base)
        for k in r.sample(range(120), r.choice((2, 3, 3))):
            ws[k] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(ws))
    seen, plain = [], jaccard_join.settled

    def settled(df, what):
        out = plain(df, what)
        if what == "apart":
            seen.append((out.count(), out.select("x", "y").distinct().count()))
        return out

    monkeypatch.setattr(jaccard_join, "settled", settled)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {row.doc_id: row.component_id for row in jaccard_join.near_copies(df).collect()}
    _, roots = brute_components(texts, 5, 80, 100)
    assert [found[i] for i in range(len(texts))] == roots and 1 < len(set(roots)) < len(texts)
    assert sum(rows for rows, _ in seen) <= 3 * sum(pairs for _, pairs in seen), seen


def test_every_end_of_a_pair_is_looked_at(spark):
    """The largest member of a tile of single sets doesn't ask, and may be nobody's nearest."""
    bits = {1: bytes(32), 2: b"\x01" + bytes(31), 3: b"\x00\xff" + bytes(30)}
    places = spark.createDataFrame([(7, h) for h in bits], "tile long, h long")
    roots = spark.createDataFrame([(h, h) for h in bits], "h long, root long")
    shapes = spark.createDataFrame([(h, 36, bytearray(b)) for h, b in bits.items()], "h long, n long, bits binary")
    found = {p: jaccard_join._tile_pairs(places, roots, shapes, 80, 100, p).select("x", "y").collect() for p in ("ends", "nearest", "all")}
    assert sorted(r.x for r in found["ends"]) == [1, 2, 3] and 3 not in {h for r in found["nearest"] for h in (r.x, r.y)}
    assert sorted((r.x, r.y) for r in found["all"]) == [(1, 2), (1, 3)]


# ---- decontamination ----

QUESTION = (
    "Every morning the baker called Anna sells 12 loaves for 3.50 dollars each, then Anna walks 5 km home. How much does Anna earn when Peter buys 12 loaves more?"
)


def test_leaks_and_other_names(spark, nothing):
    renamed = QUESTION.replace("Anna", "Maria").replace("12", "99").replace("5 km", "7 miles")
    mixed = QUESTION.replace("then Anna", "then Clara").replace("does Anna", "does Sofia")
    texts = [f"Some text. {QUESTION} And more.", renamed, mixed, None, "", "1 2 3 4 5 6 7 8 9 10 11 12", QUESTION.lower(), "a clean text of quite ordinary words that nobody asked"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, QUESTION)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH})
    items = spark.createDataFrame([(7, QUESTION), (8, None), (9, ""), (10, "1 2 3 4 5 6 7 8 9 10"), (11, "too short an item here")], "item_id long, text string")
    found = decontaminate.find_leaks(df, items).select("doc_id", "item_id").collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in found) == [(-1, 7), (0, 7), (0, 7), (1, 7), (5, 10), (6, 7)]
    left = decontaminate.without_leaks(df, items)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 7]
    assert decontaminate.find_leaks(df, items.limit(0)).count() == 0 and decontaminate.without_leaks(df, items.limit(0)).count() == df.count()
    assert decontaminate.find_leaks(nothing, items).count() == 0


def test_leaks_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    df = spark.createDataFrame([(1, QUESTION), (2, "nothing of it at all")], "doc_id long, text string")
    items = spark.createDataFrame([(7, QUESTION)], "item_id long, text string")
    assert [(r.doc_id, r.consistent) for r in decontaminate.find_leaks(df, items).collect()] == [(1, True)]


def held_by(spark, item, *texts, **options):
    """The numbers of the texts that hold the item."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    return sorted(r.doc_id for r in decontaminate.find_leaks(df, items, **options).collect())


def test_each_occurrence_has_its_own_slots(spark):
    variant, other = QUESTION.replace("12 loaves", "99 loaves"), QUESTION.replace("12 loaves", "45 loaves")
    stray = "the baker called Anna sells 77 loaves for 3.50 dollars each"
    equal = QUESTION.replace("12 loaves", "4 loaves").replace("5 km", "4 km")
    mixed = QUESTION.replace("then Anna", "then Clara").replace("does Anna", "does Sofia")
    texts = [f"{QUESTION} And then. {variant}", f"{variant} And then. {other}", f"{QUESTION} Once more, {stray}.", equal, mixed]
    assert held_by(spark, QUESTION, *texts) == [0, 1, 2, 3]


def test_long_passages_and_items_of_numbers(spark):
    r = rng(3)
    item = " ".join(spelled(w) for w in words(r, 250, 10_000))
    part = " ".join(item.split()[60:160])
    assert held_by(spark, item, f"before it {part} behind it", " ".join(item.split()[60:68])) == [0]
    assert held_by(spark, "What is 12 times 15?", "They ask: what is 12 times 15", "what is 12 times 16", "what is 15 times 12") == [0]


def test_names_that_start_sentences_and_copies_in_any_case(spark):
    item = "Tom has 3 apples and some pears. Tom gives 2 apples to his old friend. Tom eats the other apples today. Tom then buys 5 more."
    assert held_by(spark, item, item.replace("Tom", "Ann"), item, item.replace("Tom eats", "Ann eats").replace("Tom gives", "Bob gives")) == [0, 1]
    assert held_by(spark, QUESTION, QUESTION.lower(), QUESTION.upper(), QUESTION.title()) == [0, 1, 2]


# ---- quality rules ----


def brute_repeat(ws):
    at = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = set()
    for i in range(len(ws) - 7):
        if at[tuple(ws[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def test_counts_are_plain_counts():
    r = rng(3)
    for text in [*ODD, *(" ".join(words(r, n, 3)) for n in (7, 8, 9, 30, 90)), "a\na\n\n \n a\nb|#\n"]:
        c, t = text_stats.counts_of(text), text or ""
        ws = t.encode().split()
        assert c["n_words"] == len(ws) and c["n_repeat_words"] == brute_repeat(ws)
        assert c["word_chars"] == sum(len(w.decode()) for w in ws) and c["n_symbols"] == sum(ch in "#*$%&|<>" for ch in t)
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert c["n_dup_lines"] == len(lines) - len(set(lines))


def test_frequent_lines_go_and_depleted_documents(spark, odd, nothing):
    r = rng(9)
    good = [" ".join(words(r, 40)) for _ in range(30)]
    rows = [(i, f"{g}\nShared  FOOTER line of a host", "h", 5) for i, g in enumerate(good)]
    rows += [(100 + i, f"{' '.join(words(r, 10))}\n" + "shared footer line of a host\n" * 2, "h", 5) for i in range(3)]
    rows += [(200, rows[0][1], "h", 5), (201, rows[0][1], "other", 5), (None, rows[1][1], "h", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumns({c: F.lit(7) for c in CLASH})
    judged = {row.doc_id: row for row in line_rules.judge_lines(df, keep=("doc_id",)).collect()}
    assert judged[0].kept and judged[0].removed_words == 6 and judged[201].removed_words == 0
    assert judged[100].removed_words == 12 and not judged[100].kept and not judged[100].base_failed
    clean = {row.doc_id: row for row in line_rules.clean_documents(df).collect()}
    assert set(clean) == {*range(30), 200, 201, None} and clean[0].text == good[0] and clean[0].n_chars == len(good[0])
    assert clean[201].text == rows[0][1] and clean[201].n_chars == 5 and clean[0].score == 7
    got = line_rules.judge_lines(odd, keep=("doc_id", "score")).collect()
    assert len(got) == odd.count() and not any(x.kept for x in got)
    assert line_rules.clean_documents(nothing).count() == 0 and line_rules.judge_lines(nothing, keep=("doc_id",)).count() == 0


# ---- quality classifier ----


def test_rules_come_from_tree_paths():
    debug = """RandomForest (uid=x) with 1 trees
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 0 <= 3.0)
      Predict: 0.0
     Else (feature 0 > 3.0)
      Predict: 1.0
    Else (feature 2 > 0.5)
     Predict: 0.0
"""
    c = rule_ensemble.Condition
    assert rule_ensemble.rules_of(debug) == [(c(2, False, 0.5),), (c(0, False, 3.0), c(2, False, 0.5)), (c(0, True, 3.0), c(2, False, 0.5)), (c(2, True, 0.5),)]


def test_ensemble_learns_held_out(spark, odd, nothing):
    r = rng(11)
    rows = []
    for i in range(400):
        ws, bad = words(r, 60, 5_000), i % 4 == 0
        rows.append((i, " ".join(w + "###" for w in ws) if bad else " ".join(ws), 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumns({c: F.lit(7) for c in CLASH})
    labels = df.select("doc_id", "quality").filter("doc_id % 5 <> 0")
    model = rule_ensemble.train_on(df, labels)
    assert 0 < len(model.rules) < 200
    stated, stats = rule_ensemble.with_statistics(df)
    got = stated.select("doc_id", "quality", model.score(stats).alias("p")).filter("doc_id % 5 = 0").collect()
    assert sum((x.p >= 0.3) == bool(x.quality) for x in got) == len(got) and all(0 <= x.p <= 1 for x in got)
    kept = rule_ensemble.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == 300
    assert rule_ensemble.keep_good(odd, model).columns == odd.columns
    none = rule_ensemble.train_on(nothing, labels)
    assert none.rate == 0.5 and rule_ensemble.keep_good(odd, none).count() == odd.count()
    one = rule_ensemble.train_on(df, labels.filter("quality = 1"))
    assert one.rate == 1.0


# ---- licenses ----


def brute_phrases(text):
    import re

    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    at = [(i, label) for i in range(len(ws)) for phrase, label in licenses.PHRASES if ws[i : i + len(phrase.split())] == phrase.split()]
    return len(ws), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), sorted({x for _, x in at})


def test_licenses(spark, odd, nothing):
    texts = [
        "Released under the MIT License.", "Licensed under CC BY-NC 4.0 and CC BY 4.0", "All rights reserved. ALL RIGHTS RESERVED, all rights",
        "this work is licensed under the GNU General Public License, version 3", "apache license", "a license of another kind", "cc by cc by",
        "general public license général public license", "Rights reserved all", "x " * 3_000 + "Licensed under the Apache License, Version 2.0 " + "y " * 3_000,
    ]
    df = odd.unionByName(spark.createDataFrame([(50 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    rows = licenses.scan_licenses(df).collect()
    assert len(rows) == df.count()
    by_id = {r.doc_id: r for r in rows}
    for r in df.select("doc_id", "text").collect():
        g = by_id[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute_phrases(r.text)
    labels = [by_id[50 + i].labels for i in range(len(texts))]
    assert labels == [
        ["mit"], ["cc-by", "cc-by-4.0", "cc-by-nc-4.0"], ["proprietary", "reserved"], ["gpl", "gpl-3.0"], [], [], ["cc-by"], ["gpl"], [], ["apache-2.0"],
    ]
    assert licenses.scan_licenses(nothing).count() == 0


def test_licenses_by_title_notice_and_whole_text(spark):
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    whole = dict(licenses.TEXTS[:3])
    texts = ["GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", notice.format(3), notice.format(2), *(t.capitalize() for t in whole.values())]
    texts += [" ".join(t.split()[60:100]) for t in whole.values()]  # a part of a text
    texts += [" ".join(reversed(t.split())) for t in whole.values()] + ["the software is free to use and to copy for any purpose"]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [["gpl", "gpl-3.0"], ["gpl", "gpl-3.0"], ["gpl", "gpl-2.0"], *[["mit"], ["isc"], ["bsl-1.0"]] * 2, [], [], [], []]


def test_places_are_those_of_a_plain_matcher(spark):
    r, index = rng(31), licenses.postings(licenses.TEMPLATES)
    texts = []
    for t in licenses.TEMPLATES:
        ws = t.text.split()
        for edits in (0, 1, 3, len(ws) // 3):
            copy = [*words(r, r.randrange(4)), *ws, *words(r, 3)]
            for _ in range(edits):
                copy[r.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
    got = {x.doc_id: set(x.labels) - set(x.base_labels) for x in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        ws, expected = text.split(), set()
        for k, t in enumerate(licenses.TEMPLATES):
            spots, own = [(w, at) for w, j, at, _ in index if j == k], t.text.split()
            for base in range(-len(own), len(ws)):
                aligned = sum(0 <= base + at < len(ws) and ws[base + at] == w for w, at in spots)
                there = [(a, ws[base + n]) for n, a in enumerate(own) if 0 <= base + n < len(ws)]
                line = f" {' '.join(b for _, b in there)} "
                if aligned >= math.ceil(licenses.MIN_ALIGNED * len(spots)) and sum(a == b for a, b in there) / len(own) >= licenses.MIN_SHARE and all(f" {m} " in line for m in t.must):
                    expected.add(t.label)
        assert got[i] == expected, text


# ---- near copies ----


def brute_components(texts, n, p, q):
    sets = []
    for t in texts:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + n]) for i in range(max(len(ws) - n + 1, 1))} if ws else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("n,p,q", [(4, 85, 100), (5, 80, 100), (1, 60, 100)])
def test_near_copies_are_all_pairs(spark, n, p, q):
    r = rng(17)
    texts: list[str | None] = [None, "", " ", "one", "One", "one two", "a b c d", "a b c d", "d c b a"]
    shared = " ".join(words(r, 50))
    for size in (6, 9, 14, 30, 80, 200, 700):
        for _ in range(3):
            ws = words(r, size)
            texts += [" ".join(ws), " ".join(ws).upper()]
            for edits in (1, 2, size // 40 + 1, size // 25 + 1):
                copy = list(ws)
                for _ in range(edits):
                    k = r.randrange(len(copy))
                    copy[k : k + r.randrange(2)] = [f"new{r.randrange(10**6)}"]
                texts.append(" ".join(copy))
            texts.append(" ".join(ws) + " " + shared)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH})
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.near_copies(df, n=n, similar=p, of=q).collect()}
    sizes, roots = brute_components(texts, n, p, q)
    assert [got[i] for i in range(len(texts))] == list(zip(sizes, roots, strict=True))


def test_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    r = rng(23)
    ws = words(r, 120, 10_000)
    texts = []
    for _ in range(60):
        copy = list(ws)
        for _ in range(r.randrange(4)):
            copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(copy))
    got = jaccard_join.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=4, similar=85, of=100).collect()
    assert [x.component_id for x in sorted(got)] == brute_components(texts, 4, 85, 100)[1]


def test_one_of_each(spark, odd, nothing):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (3, "A b c d e f g"), (None, "a b c d e f g"), (9, None), (9, None), (8, " "), (7, "other words in here now"), (7, "a second text with that id")]
    rows += [(None, "two rows that have no id"), (None, "two rows that have no id"), (None, "quite another row without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH})
    got = jaccard_join.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id or -1), r.text or "") for r in got.collect()) == sorted([
        (3, "A b c d e f g"), (9, ""), (9, ""), (8, " "), (7, "other words in here now"), (7, "a second text with that id"),
        (-1, "two rows that have no id"), (-1, "quite another row without an id"),
    ])
    assert jaccard_join.one_of_each(nothing).count() == 0 and jaccard_join.near_copies(nothing).count() == 0
    assert jaccard_join.near_copies(odd).count() == odd.count()


def test_tiles_meet_whenever_the_threshold_is_reached():
    r = np.random.default_rng(4)
    for p, q in ((85, 100), (80, 100), (50, 100)):
        bands = jaccard_join.Bands(p, q)
        for size in (3, 7, 12, 40, 150, 900):
            for _ in range(30):
                a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
                cut = int(r.integers(0, max(1, size * (q - p) // q) + 1))
                new = int(r.integers(0, max(1, size * (q - p) // q) + 1))
                b = np.unique(np.r_[a[cut:], r.integers(0, 1 << 63, new, dtype=np.uint64)])
                if not len(b) or not jaccard_join.linked(a, b, p, q):
                    continue
                if not np.array_equal(a, b):
                    assert np.intersect1d(jaccard_join.part_keys(a, bands), jaccard_join.part_keys(b, bands)).size
                x, y = jaccard_join.bitmap(a, bands), jaccard_join.bitmap(b, bands)
                size_ = min(len(x), len(y))
                apart = int(np.bitwise_count(jaccard_join.fold(x, size_) ^ jaccard_join.fold(y, size_)).sum())
                assert apart * (p + q) <= (len(a) + len(b)) * (q - p)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (1, 2), *((i, i + 1) for i in range(100, 140)), *((200, i) for i in range(201, 230))]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a int, b int")).collect()}
    expected = {1: 1, 2: 1, 3: 1, 4: 1, 9: 8, 8: 8} | {i: 100 for i in range(100, 141)} | {i: 200 for i in range(200, 230)}
    assert got == expected
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0

