"""License scan by a positional index of the rarest words of license texts, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

# Phrases that alone give a label, by exact words.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    """A license text or notice; `must` are phrases without which it is not there."""

    label: str
    text: str
    must: tuple[str, ...]


# Notices as their licenses word them.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("apache org licenses",),
    ),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction",
        ("permission is hereby granted", "without restriction"),
    ),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "gnu general public license version 2", ("gnu general public license", "version 2")),
    *(
        Template(
            f"gpl-{v}.0",
            "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"
            f" {v} of the license or at your option any later version",
            ("gnu general public license", f"version {v}"),
        )
        for v in "32"
    ),
    Template("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("source and binary forms", "following conditions"),
    ),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("proprietary", "all rights reserved", ("all rights reserved",)),
)

# Texts of licenses, whole but for numbered clauses, which stand each by themselves: text with a number in between is out of step.
TEXTS = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the"
        " software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and"
        " to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not"
        " limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for"
        " any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other"
        " dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and"
        " this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all"
        " implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages"
        " whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the"
        " use or performance of this software",
    ),
    (
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"
        " the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to"
        " whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license"
        " grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software"
        " unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
    ),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other"
        " materials provided with the distribution",
    ),
    (
        "bsd",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific"
        " prior written permission",
    ),
    (
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties"
        " of merchantability and fitness for a particular purpose are disclaimed",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this"
        " software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject"
        " to the following restrictions",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in"
        " source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
)

PASSAGE, STEP = 32, 16  # words of a text's passages, which overlap


def passages(label: str, text: str) -> list[Template]:
    """A license text as overlapping templates; the three words running with most letters are a passage's key phrase."""
    words = text.split()
    starts = range(0, max(len(words) - PASSAGE + STEP, 1), STEP)
    cut = [words[a : a + PASSAGE] for a in starts]
    keys = [max((w[i : i + 3] for i in range(len(w) - 2)), key=lambda p: sum(map(len, p))) for w in cut]
    return [Template(label, " ".join(w), (" ".join(k),)) for w, k in zip(cut, keys, strict=True)]


TEMPLATES = (*NOTICES, *(t for label, text in TEXTS for t in passages(label, text)))

RARE = 3  # index words of a template: its rarest
MIN_ALIGNED = 0.6  # share of the index words that must meet at one relative position
MIN_SHARE = 0.6  # share of a template's words that must then stand in place
PHRASE_SCORE = 0.5  # the score that a phrase alone gives


def padded(text: Column) -> Column:
    """The words, A-Z lower-cased, each between single spaces; null counts as empty."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def idf(templates: Sequence[Template]) -> dict[str, float]:
    """How rare each license word is among the license texts."""
    sets = [set(t.text.split()) for t in templates]
    return {w: math.log(len(sets) / sum(w in s for s in sets)) for w in set().union(*sets)} if sets else {}


def postings(templates: Sequence[Template], rare: int = RARE) -> list[tuple[str, int, int, int]]:
    """(word, template, position, rank) of each template's words of highest IDF; among equals the longer word, then the first."""
    weight, rows = idf(templates), []
    for k, t in enumerate(templates):
        words = t.text.split()
        best = sorted(range(len(words)), key=lambda i: (-weight[words[i]], -len(words[i]), i))[:rare]
        rows += [(words[i], k, i, r) for r, i in enumerate(best)]
    return rows


def phrase_columns(p: Column, phrases: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """Counts, first and last places and labels of exact phrases in padded words."""
    any_of = "|".join(x for x, _ in phrases)
    has = [F.contains(p, F.lit(f" {x} ")) for x, _ in phrases]
    some = has[0]
    for h in has[1:]:
        some = some | h
    # Cut before every start of a phrase, overlapping ones included.
    parts = F.split(p, f" (?=(?:{any_of}) )")
    words = F.length(p) - F.length(F.translate(p, " ", "")) - 1
    before = F.length(F.get(parts, F.lit(0))) - F.length(F.translate(F.get(parts, F.lit(0)), " ", ""))
    last = F.get(parts, F.size(parts) - 1)
    behind = F.length(last) - F.length(F.translate(last, " ", ""))
    labels = F.array_compact(F.array(*(F.when(h, F.lit(label)) for h, (_, label) in zip(has, phrases, strict=True))))
    return {
        "n_words": F.when(p == "  ", 0).otherwise(words).cast("bigint"),
        "n_base": F.when(some, F.size(parts) - 1).otherwise(0).cast("bigint"),
        "first_word": F.when(some, before).cast("bigint"),
        "last_word": F.when(some, words - behind).cast("bigint"),
        "base_labels": F.array_sort(F.array_distinct(labels)),
    }


def _table(rows: Sequence[Sequence[str]]) -> Column:
    """Lists of words as one constant."""
    return F.array(*[F.array(*map(F.lit, r)).cast("array<string>") for r in rows]).cast("array<array<string>>")


def with_places(rows: DataFrame, templates: Sequence[Template], rare: int = RARE) -> DataFrame:
    """Adds `places`, the (template, base) at which enough of a template's index words agree, to rows with the array `w` of a text's words.

    Each place of an index word is looked up in the postings and says where the template would begin (`base`). Sorted, equal beginnings stand
    side by side, so agreement is seen in one run over them, however many places a very long text has. The postings are constants of the plan.
    """
    index = postings(templates, rare)
    need = {k: max(1, math.ceil(MIN_ALIGNED * sum(j == k for _, j, *_ in index))) for k in range(len(templates))}
    by_word: dict[str, list[Column]] = {}
    for word, k, at, _ in index:
        by_word.setdefault(word, []).append(F.struct(F.lit(k).alias("template"), F.lit(at).alias("at"), F.lit(need[k]).alias("need")))
    rarest = sorted(by_word)
    looked_up = F.create_map(*[x for w in rarest for x in (F.lit(w), F.array(*by_word[w]))])
    spots = F.filter(F.transform("w", lambda w, i: F.when(w.isin(rarest), F.struct(i.alias("i"), w.alias("word")))), lambda s: s.isNotNull())
    begun = F.transform(
        "spots", lambda s: F.transform(F.element_at(looked_up, s["word"]), lambda p: F.struct(p["template"].alias("template"), (s["i"] - p["at"]).alias("base"), p["need"].alias("need")))
    )
    agreed = F.filter(F.transform("begun", lambda x, i: F.when(F.get(F.col("begun"), i + x["need"] - 1) == x, x)), lambda x: x.isNotNull())
    return (
        rows.withColumn("spots", F.when(F.arrays_overlap("w", F.array(*map(F.lit, rarest))), spots))
        .withColumn("begun", F.array_sort(F.flatten(begun)))
        .withColumn("places", F.array_distinct(agreed))
        .drop("spots", "begun")
    )


def judged_places(templates: Sequence[Template]) -> Column:
    """The (label, share) of those `places` at which the words in place and the key phrases bear the template out."""
    texts, musts = _table([t.text.split() for t in templates]), _table([[f" {m} " for m in t.must] for t in templates])
    labels = F.array(*[F.lit(t.label) for t in templates])

    def judge(x: Column) -> Column:
        words = F.get(texts, x["template"])
        before = F.least(x["base"], F.lit(0))  # words of the template that would stand before the text
        there = F.slice("w", F.greatest(x["base"], F.lit(0)) + 1, F.greatest(F.size(words) + before, F.lit(0)))
        ours = F.slice(words, F.lit(1) - before, F.size(words))
        same = F.size(F.filter(F.zip_with(there, ours, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda y: y))
        line = F.concat(F.lit(" "), F.array_join(there, " "), F.lit(" "))
        keyed = F.forall(F.get(musts, x["template"]), lambda m: F.contains(line, m))
        return F.struct(F.get(labels, x["template"]).alias("label"), F.when(keyed, same / F.size(words)).otherwise(0.0).alias("share"))

    return F.filter(F.transform("places", judge), lambda j: j["share"] >= MIN_SHARE)


def scan_licenses(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: Sequence[Template] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
) -> DataFrame:
    """One row per row of `df`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays), score.

    Phrases give base labels wherever their words stand consecutively. Templates add labels where enough of their rarest words
    agree in relative position, most of their words stand in place and their key phrases are there. The score is the best such share, PHRASE_SCORE at
    least where a phrase is, else 0. A null text counts as empty: no words, no labels, score 0. Overlapping phrases all count.
    Repeated rows get equal results. One pass over the rows, no shuffle: a template collection must fit the plan, some hundreds do.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), padded(F.col(text)).alias("p"))
    rows = rows.select("doc_id", *(c.alias(n) for n, c in phrase_columns(F.col("p"), phrases).items()), F.split(F.trim("p"), " ").alias("w"))
    held = with_places(rows, templates).withColumn("held", F.coalesce(judged_places(templates), F.array().cast("array<struct<label:string,share:double>>")))
    labels = F.array_sort(F.array_union("base_labels", F.transform("held", lambda j: j["label"])))
    best = F.coalesce(F.array_max(F.transform("held", lambda j: j["share"])), F.lit(0.0))
    floor = F.when(F.col("n_base") > 0, PHRASE_SCORE).otherwise(0.0)
    return held.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), F.greatest(best, floor).alias("score"))
