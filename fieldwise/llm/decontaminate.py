"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question with other numbers or names has the windows of the
original. Windows meet by hash, and each name or number of the question must stand for one of the text in one of its occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, settled

WINDOW = 8  # tokens
MIN_LITERALS = 4  # tokens of an indexed window that are no placeholders
MIN_COVER = 0.5  # share of an item's indexed windows that an occurrence must hold
PASSAGE = 13  # literal tokens of an unbroken passage that is a leak however long its item is
NEAR = 4  # windows that follow each other with at most so many tokens put in or left out belong to one occurrence
BROADCAST_WINDOWS = 500_000  # up to so many benchmark windows (24 bytes each) are broadcast; more are joined by a shuffle

# Placeholders are private-use characters, which are neither letters nor digits.
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"
OPENER = "\ue004"  # marks any other capitalised word: a name where a sentence starts, or only its first word
# A capitalised word within a sentence: behind a lower-case letter, comma or semicolon and one space.
NAME_FORM = r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
OPENER_FORM = rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}{NAME}]\p{{Lu}})\p{{Ll}}+(?![\p{{L}}\p{{N}}])"
NUMBER_FORM = r"(?<![\p{L}\p{N}])\p{Nd}+(?:[.,:/]\p{Nd}+)*"
UNITS = (
    "kilometers", "kilometres", "centimeters", "centimetres", "millimeters", "meters", "metres", "miles", "inches", "feet", "yards", "kilograms",
    "grams", "pounds", "ounces", "liters", "litres", "gallons", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "cents",
    "euros", "percent", "degrees", "mile", "inch", "foot", "yard", "pound", "ounce", "liter", "gallon", "second", "minute", "hour", "day", "week",
    "month", "year", "dollar", "cent", "euro", "degree", "km", "cm", "mm", "kg", "mg", "lb", "oz", "ml", "mph", "kwh", "m", "g", "l", "s", "h",
)
NUMBER_TOKEN = NUMBER + r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
UNIT_FORM = rf"({NUMBER_TOKEN})\s*{OPENER}?((?i:" + "|".join(UNITS) + r"))(?![\p{L}\p{N}])"
BETWEEN = rf"[^\p{{L}}{NUMBER}{NAME}{UNIT}{OPENER}]"

# A text is read in three forms, token by token alike: names within sentences as placeholders, all capitalised words as placeholders, none. EXACT keeps
# numbers and units too, for items that say little besides.
WITHIN, ALL, NONE, EXACT = 1, 2, 4, 8
FORMS = (WITHIN, ALL, NONE)


def tokens_of(text: Column) -> Column:
    """A text's tokens: lower-case runs of letters, those of capitalised words behind the mark NAME or OPENER, numbers behind NUMBER and units behind UNIT.
    Empty for a text without any."""
    plain = _line_of(text)
    return F.when(F.coalesce(plain, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _line_of(text: Column) -> Column:
    """The tokens of a text, one space apart."""
    named = F.regexp_replace(F.regexp_replace(text, NAME_FORM, f" {NAME}$0 "), OPENER_FORM, f" {OPENER}$0 ")
    numbered = F.regexp_replace(F.regexp_replace(named, NUMBER_FORM, f" {NUMBER}$0 "), UNIT_FORM, f"$1 {UNIT}$2 ")
    with_numbers = F.regexp_replace(F.lower(numbered), rf"({NUMBER_TOKEN}){BETWEEN}*|{BETWEEN}+", "$1 ")
    return F.trim(F.when(text.rlike(r"\p{Nd}"), with_numbers).otherwise(F.regexp_replace(F.lower(named), f"{BETWEEN}+", " ")))


def _mark(t: Column) -> Column:
    return F.substring(t, 1, 1)


def _bare(t: Column) -> Column:
    """The word of a token, without the mark of a capitalised one; numbers and units keep theirs."""
    return F.when(_mark(t).isin(NAME, OPENER), F.substr(t, F.lit(2))).otherwise(t)


def _in_form(t: Column, form: int) -> Column:
    if form == EXACT:
        return _bare(t)
    placeholder = F.when(_mark(t).isin(NUMBER, UNIT), _mark(t))
    if form != NONE:
        placeholder = placeholder.when(_mark(t).isin(*((NAME,) if form == WITHIN else (NAME, OPENER))), F.lit(NAME))
    return placeholder.otherwise(_bare(t))


def _read(tokens: Column, form: int) -> Column:
    return F.transform(tokens, lambda t: _in_form(t, form))


def _hash(tokens: Column, form: int) -> Column:
    return F.xxhash64(_read(tokens, form))


def _is_placeholder(t: Column) -> Column:
    return t.isin(NUMBER, NAME, UNIT)


def _literals(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~_is_placeholder(t))


def index_of(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """(item, form, at, size, h, total, w, back): the indexed windows of each item. An item of fewer than n tokens is one window; windows with fewer than
    MIN_LITERALS different literal words say too little and are left out. An item that has no other is one window of all its tokens, in
    the form EXACT. `w` is the window's longest word (one that is literal in every form it is indexed in), `back` that word's place."""
    rows = items.select(F.col(item_id).alias("item"), tokens_of(F.col(text)).alias("tokens")).filter(F.size("tokens") > 0)
    rows = rows.withColumn("size", F.least(F.size("tokens"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("tokens") - F.col("size") + 1)
    at = rows.select("item", "size", "tokens", F.explode(starts).alias("at"))
    cut = at.select("item", "size", (F.col("at") - 1).alias("at"), F.slice("tokens", F.col("at"), F.col("size")).alias("raw"))
    cut = cut.withColumn("literals", F.size(F.array_distinct(_literals(_read(F.col("raw"), WITHIN))))).filter(F.col("literals") >= MIN_LITERALS)
    read = F.explode(F.array(*(F.struct(F.lit(f).alias("form"), _read(F.col("raw"), f).alias("words")) for f in FORMS)))
    kept = cut.select("item", "size", "at", "raw", read.alias("read")).select("item", "size", "at", "raw", "read.form", "read.words")
    kept = kept.filter(F.size(F.array_distinct(_literals(F.col("words")))) >= MIN_LITERALS)
    total = kept.filter(F.col("form") == WITHIN).groupBy("item").agg(F.count("*").alias("total"))
    rich = kept.join(total, "item").select("item", "form", "at", "size", "total", "raw")
    poor = rows.join(total, "item", "left_anti").select(
        "item", F.lit(EXACT).alias("form"), F.lit(0).alias("at"), F.size("tokens").alias("size"), F.lit(1).cast("bigint").alias("total"), F.col("tokens").alias("raw")
    )

    def candidate(t: Column, k: Column) -> Column:
        plain, spoken = ~_mark(t).isin(NUMBER, UNIT, NAME, OPENER), ~_mark(t).isin(NUMBER, UNIT, NAME)
        return F.struct(plain.alias("always"), spoken.alias("spoken"), F.length(t).alias("length"), _bare(t).alias("w"), (-k).alias("k"))

    hashed = F.when(F.col("form") == WITHIN, _hash(F.col("raw"), WITHIN)).when(F.col("form") == ALL, _hash(F.col("raw"), ALL)).when(F.col("form") == NONE, _hash(F.col("raw"), NONE))
    both = rich.unionByName(poor).withColumn("best", F.array_max(F.transform("raw", candidate)))
    return both.select("item", "form", "at", "size", hashed.otherwise(_hash(F.col("raw"), EXACT)).alias("h"), "total", F.col("best.w").alias("w"), (-F.col("best.k")).alias("back")).distinct()


def _windows_at_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(k1, k2, i, size, seen): the windows of each text around the indexed windows' longest words."""
    # The outer form: the plain one adds a filter that makes the tokens twice more.
    each = tokens.select("k1", "k2", "tokens", F.posexplode_outer("tokens").alias("p", "t")).withColumn("w", _bare(F.col("t")))
    met = each.join(F.broadcast(words), "w").select("k1", "k2", "tokens", (F.col("p") - F.col("back")).alias("i"), "size")
    return _cut(met)


def _all_windows(tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """The same for every place of each text."""
    each = tokens.select("k1", "k2", "tokens", F.posexplode_outer("tokens").alias("i", "t"))
    return _cut(each.select("k1", "k2", "tokens", "i", F.explode(F.array(*map(F.lit, sizes))).alias("size")))


def _cut(met: DataFrame) -> DataFrame:
    inside = (F.col("i") >= 0) & (F.col("i") + F.col("size") <= F.size("tokens"))
    return met.filter(inside).select("k1", "k2", "i", "size", F.slice("tokens", F.col("i") + 1, F.col("size")).alias("seen"))


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = WINDOW,
    min_cover: float = MIN_COVER,
) -> DataFrame:
    """(doc_id, item_id, covered, windows, slots, consistent): one row for each row of `documents` and benchmark item it holds.

    A text holds an item when one occurrence has at least `min_cover` of the item's indexed template windows, or an unbroken passage of PASSAGE
    literal tokens, and its slots are consistent: each name or number of the item stands for one name or number of the text. Windows at one
    offset are an occurrence; so are those at offsets NEAR each other, and all of the text. A plain copy, in any case, is the case where each stands
    for itself. An item without a window of MIN_LITERALS words is held where all its words, numbers and units stand one behind the other. Nulls, empty texts
    and texts without letters and digits hold nothing and are held by nothing; a null id is an id like any other; repeated rows give repeated results; copies of a
    text are compared once. Empty tables give no rows.

    Documents are read once. Windows are cut around the longest words of the benchmark's windows, while their counted number is small enough to broadcast; beyond
    that all windows are cut and met by hash in a shuffle. A window that meets carries its own tokens, so no text is read or moved again.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(text, F.lit(2)).alias("k2"))
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("asked"))
    index = settled(index_of(items, item_id, item_text, n), "benchmark-windows")
    forms = {r["form"]: r["count"] for r in index.groupBy("form").count().collect()}  # at most four rows
    few = sum(forms.values()) <= BROADCAST_WINDOWS
    tokens = docs.filter("text is not null").select("k1", "k2", F.split(_line_of(F.col("text")), " ").alias("tokens"))  # [""] for a text without any
    if few:
        windows = _windows_at_words(tokens, index.select("w", "back", "size").distinct())
    else:
        windows = _all_windows(tokens, [r["size"] for r in index.select("size").distinct().collect()])  # the items' different lengths
    lookup = index.select("h", "form", "size", "item", "at", "total")
    read = F.explode(F.array(*(F.struct(F.lit(f).alias("form"), _hash(F.col("seen"), f).alias("h")) for f in sorted(forms) or [WITHIN])))
    met = windows.select("k1", "k2", "i", "size", "seen", read.alias("x")).select("k1", "k2", "i", "size", "seen", "x.*")
    hits = met.join(F.broadcast(lookup) if few else lookup, ["h", "form", "size"])
    lines = hits.groupBy("k1", "k2", "item", "form", "total", (F.col("i") - F.col("at")).alias("offset")).agg(F.collect_set(F.struct("at", "seen")).alias("met"))
    lines = settled(lines, "template-lines")
    found = _occurrences(asked, lines.filter(F.col("form") != EXACT), min_cover)
    whole = lines.filter(F.col("form") == EXACT).select("k1", "k2", "item", "total").distinct().join(asked, "item")
    slots = F.size(F.array_distinct(F.filter(tokens_of(F.col("asked")), lambda t: _mark(t).isin(NUMBER, NAME)))).cast("bigint")
    whole = whole.select("k1", "k2", "item", "total", F.lit(1).cast("bigint").alias("covered"), slots.alias("slots"))
    return (
        docs.select("doc_id", "k1", "k2")
        .join(_sized(settled(found.unionByName(whole), "leaks")), ["k1", "k2"])
        .select("doc_id", F.col("item").alias("item_id"), "covered", F.col("total").alias("windows"), "slots", F.lit(True).alias("consistent"))
    )


def _sized(small: DataFrame) -> DataFrame:
    """Marked for broadcast while its counted rows are few enough."""
    return F.broadcast(small) if small.count() <= BROADCAST_WINDOWS else small


def _occurrences(items: DataFrame, lines: DataFrame, min_cover: float) -> DataFrame:
    """(k1, k2, item, total, covered, slots) of the items that a text holds in a consistent occurrence. `lines` has a row for each offset, with the
    windows that met there and the tokens they were made of."""
    pair = ["k1", "k2", "item", "form"]
    stood = F.transform("met", lambda m: F.transform(m["seen"], lambda t, k: F.struct((m["at"] + k).alias("p"), t.alias("d"))))
    lines = lines.select(*pair, "total", "offset", F.transform("met", lambda m: m["at"]).alias("ats"), F.array_distinct(F.flatten(stood)).alias("stood"))
    # Only where this offset's windows or the text's others can be enough.
    covers = lines.groupBy(*pair).agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("all_covered"))
    long = F.size("stood") >= PASSAGE
    lines = lines.join(covers, pair).filter((F.col("all_covered") >= F.col("total") * min_cover) | long)
    both = lines.join(items.select("item", tokens_of(F.col("asked")).alias("q_tokens")), "item")

    # What stood in the item's slots, as triples (place in the item, the item's value, the text's).
    def slot(x: Column) -> Column:
        q, d = F.get("q_tokens", x["p"]), x["d"]
        named = F.when(F.col("form") == WITHIN, _mark(q) == NAME).when(F.col("form") == ALL, _mark(q).isin(NAME, OPENER)).otherwise(False)
        return F.when(_mark(q) == NUMBER, F.struct(x["p"].alias("p"), q.alias("q"), d.alias("d"))).when(named, F.struct(x["p"].alias("p"), _bare(q).alias("q"), _bare(d).alias("d")))

    both = both.withColumn("places", F.transform("stood", lambda x: x["p"]))
    both = both.withColumn("slots", F.filter(F.transform("stood", slot), lambda v: v.isNotNull()))
    # The literal places of the item in this form, and the shortest passages of PASSAGE of them.
    token = F.when(F.col("form") == WITHIN, _read(F.col("q_tokens"), WITHIN)).when(F.col("form") == ALL, _read(F.col("q_tokens"), ALL)).otherwise(_read(F.col("q_tokens"), NONE))
    both = both.withColumn("literal", F.filter(F.transform(token, lambda t, i: F.when(~_is_placeholder(t), i)), lambda x: x.isNotNull()))
    ends = F.filter(F.transform("literal", lambda a, r: F.struct(a.alias("a"), F.get("literal", r + PASSAGE - 1).alias("b"))), lambda s: s["b"].isNotNull())
    passage = F.exists(
        ends,
        lambda s: (F.size(F.array_intersect(F.sequence(s["a"], s["b"]), "places")) == s["b"] - s["a"] + 1)
        & _consistent(F.filter("slots", lambda v: (v["p"] >= s["a"]) & (v["p"] <= s["b"]))),
    )
    bare = F.array_distinct(F.transform("slots", lambda v: F.struct(v["q"].alias("q"), v["d"].alias("d"))))
    lines = both.select(*pair, "total", "offset", "ats", bare.alias("values"), passage.alias("passage"))
    lines = settled(lines, "template-slots")

    by_offset = lines.select(*pair, "total", "ats", "values", "passage")
    step = F.col("offset") - F.lag("offset").over(Window.partitionBy(*pair).orderBy("offset"))
    chained = lines.withColumn("break", F.when(step <= NEAR, 0).otherwise(1))
    chained = chained.withColumn("chain", F.sum("break").over(Window.partitionBy(*pair).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)))
    together = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("ats", "values")]
    near = chained.groupBy(*pair, "total", "chain").agg(*together, F.lit(False).alias("passage")).drop("chain")
    everywhere = lines.groupBy(*pair, "total").agg(*together, F.lit(False).alias("passage"))
    tried = by_offset.unionByName(near).unionByName(everywhere)
    good = F.col("passage") | ((F.size("ats") >= F.col("total") * min_cover) & _consistent(F.col("values")))
    best = F.max(F.struct(F.size("ats").cast("bigint").alias("covered"), F.size("values").cast("bigint").alias("slots"))).alias("best")
    return tried.filter(good).groupBy("k1", "k2", "item", "total").agg(best).select("k1", "k2", "item", "total", "best.covered", "best.slots")


def _consistent(values: Column) -> Column:
    """Whether each value of the item stands for one of the text."""
    pairs = F.array_distinct(F.transform(values, lambda v: F.struct(v["q"].alias("q"), v["d"].alias("d"))))
    return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda v: v["q"])))


def without_leaks(documents: DataFrame, items: DataFrame, text: str = "text", **kwargs) -> DataFrame:
    """The documents that hold no benchmark item, all columns and repeated rows unchanged."""
    key = F.xxhash64(F.lit(3), text)
    leaks = find_leaks(documents.select(F.col(text).alias("text"), key.alias("doc_id")), items, **kwargs)
    leak = fresh(documents, "_leak")
    bad = settled(leaks.select(F.col("doc_id").alias(leak)).distinct(), "leaking-texts")
    return documents.join(_sized(bad), key == F.col(leak), "left_anti")
