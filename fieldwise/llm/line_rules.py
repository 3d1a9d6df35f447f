"""Quality rules: lines that too many documents of a host share are removed, depleted documents rejected."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_rows, settled
from .text_stats import counts_of, words_of

MIN_DOCS = 20  # a line in no more documents of a host than this always stays
MAX_SHARE = 0.05  # nor does a line go that stands in no more than this share of the host's documents
MIN_LEFT = 0.5  # a document must keep more than this share of its words
MIN_WORDS = 20
MAX_REPEAT = 0.3

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_key(line: bytes) -> int | None:
    """The signed 64-bit hash of a line with A-Z lower-cased and its words one space apart; null without a word."""
    import xxhash

    words = words_of(line.lower())
    if not words:
        return None
    key = xxhash.xxh3_64_intdigest(b" ".join(words))
    return key - (1 << 64) if key >> 63 else key


def content_key(host: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a host's text: its rows may repeat, and ids may be null or equal."""
    return [F.xxhash64(F.lit(1), host, text).alias("k1"), F.xxhash64(host, F.lit(2), text).alias("k2")]


LINES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("host", pa.string()), ("line", pa.int64()), ("words", pa.int64())])


def _lines(piece: pa.RecordBatch) -> pa.Table:
    """A row for each different line of a text: its hash and the words that all its places hold."""
    k1, k2, hosts, lines, words = [], [], [], [], []
    for a, b, host, text in zip(*(piece.column(c).to_pylist() for c in ("k1", "k2", "host", "text")), strict=True):
        found: dict[int, int] = {}
        for raw in (text or "").encode().split(b"\n"):
            key = line_key(raw)
            if key is not None:
                found[key] = found.get(key, 0) + len(raw.split())
        n = len(found)
        k1 += [a] * n
        k2 += [b] * n
        hosts += [host] * n
        lines += found.keys()
        words += found.values()
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((k1, k2, hosts, lines, words), LINES, strict=True)], schema=LINES)


def frequent_lines(df: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(k1, k2, line, words): the lines of each text that stand above the limits of its host.

    Documents are distinct texts of a host, so copies of one text count once. Each text's lines are made
    distinct first, the counts are partial sums, and the key is (host, line): a host with a third of all rows
    is spread by its lines, a line in every document of it is counted before the shuffle.
    """
    rows = df.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text"))
    rows = rows.select("host", "text", *content_key(F.col("host"), F.col("text")))
    lines = map_rows(rows, _lines, "k1 bigint, k2 bigint, host string, line bigint, words bigint")
    once = lines.groupBy("host", "line", "k1", "k2").agg(F.max("words").alias("words"))
    once = settled(once, "text-lines")
    sizes = rows.groupBy("host", "k1", "k2").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    found = once.groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > min_docs)
    found = found.join(sizes, "host").filter(F.col("docs") > F.col("host_docs") * max_share).select("host", "line")
    return once.join(settled(found, "frequent-lines"), ["host", "line"]).select("k1", "k2", "line", "words")


def judge_lines(
    df: DataFrame,
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of `df`: the columns named in `keep`, the base counts, `removed_words`, `base_failed`, `kept`, and the content key.

    A null or empty text has no words: all counts are 0, it fails the base rules and is not kept. A null host is a
    host of its own, shared with the empty name. Repeated rows get equal results; an empty table gives none. A text is depleted
    where the words left are no more than `min_left` of all.
    """
    inside = df.select(
        *(F.col(c).alias(f"in_{i}") for i, c in enumerate(keep)), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("text")
    )
    inside = inside.select(*(f"in_{i}" for i in range(len(keep))), "text", *content_key(F.col("host"), F.col("text")))

    def count(piece: pa.RecordBatch) -> pa.Table:
        found = [counts_of(t) for t in piece.column("text").to_pylist()]
        out = pa.Table.from_batches([piece]).drop_columns(["text"])
        for name in BASE:
            out = out.append_column(name, pa.array([c[name] for c in found], pa.int64()))
        return out

    types = dict(inside.dtypes)
    schema = ", ".join([f"in_{i} {types[f'in_{i}']}" for i in range(len(keep))] + ["k1 bigint", "k2 bigint"] + [f"{n} bigint" for n in BASE])
    counted = map_rows(inside, count, schema)
    removed = frequent_lines(df, text, host, min_docs, max_share).groupBy("k1", "k2").agg(F.sum("words").alias("removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT) * F.col("n_words"))
    return (
        counted.join(removed, ["k1", "k2"], "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("bigint"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("n_words") - F.col("removed_words") > min_left * F.col("n_words")))
        .select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)), "k1", "k2", *BASE, "removed_words", "base_failed", "kept")
    )


def clean_documents(
    df: DataFrame,
    text: str = "text",
    host: str = "source",
    n_chars: str = "n_chars",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """The documents that `judge_lines` keeps, without the lines above the limits; all columns stay as they were.

    Where the frame has the column `n_chars`, it follows the text. Repeated rows stay repeated.
    """
    k1, k2, lines, gone = (fresh(df, c) for c in ("_k1", "_k2", "_lines", "_gone"))
    owner = F.coalesce(F.col(host).cast("string"), F.lit(""))
    keyed = df.withColumns(dict(zip((k1, k2), content_key(owner, F.col(text)), strict=True)))
    drops = frequent_lines(df, text, host, min_docs, max_share).groupBy("k1", "k2").agg(F.sum("words").alias(gone), F.collect_set("line").alias(lines))
    joined = keyed.join(drops.withColumnsRenamed({"k1": k1, "k2": k2}), [k1, k2], "left").drop(k1, k2)
    target = pa_schema(df)

    def clean(piece: pa.RecordBatch) -> pa.Table:
        texts, kept = [], []
        for t, keys, n_gone in zip(*(piece.column(c).to_pylist() for c in (text, lines, gone)), strict=True):
            counts = counts_of(t)
            kept.append(not base_fails(counts) and counts["n_words"] - (n_gone or 0) > min_left * counts["n_words"])
            texts.append(without_lines(t, set(keys)) if keys else t)
        out = pa.Table.from_batches([piece]).drop_columns([lines, gone])
        out = out.set_column(out.schema.get_field_index(text), text, pa.array(texts, target.field(text).type))
        if n_chars in out.column_names:
            sizes = [None if t is None else len(t) for t in texts]
            old = out.column(n_chars).to_pylist()
            sizes = [b if keys else a for a, b, keys in zip(old, sizes, piece.column(lines).to_pylist(), strict=True)]
            out = out.set_column(out.schema.get_field_index(n_chars), n_chars, pa.array(sizes, target.field(n_chars).type))
        return out.filter(pa.array(kept, pa.bool_())).select(target.names)

    return map_rows(joined, clean, df.schema)


def pa_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def base_fails(counts: dict[str, int]) -> bool:
    return counts["n_words"] < MIN_WORDS or 100 * counts["n_repeat_words"] > int(100 * MAX_REPEAT) * counts["n_words"]


def without_lines(text: str, keys: set[int]) -> str:
    return "\n".join([x for x in text.split("\n") if line_key(x.encode()) not in keys])


def oracle() -> str:
    """`judge_lines` over `documents` as DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
with docs as (select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
split_words as (select r, regexp_extract_all(text, '{word}') as w from docs),
words as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from split_words),
windows as (select r, i, array_to_string(w[i:i + {7}], ' ') as win from (select r, w, unnest(range(1, len(w) - 6)) as i from split_words)),
again as (select r, i from windows qualify count(*) over (partition by r, win) > 1),
covered as (select r, count(distinct i + k) as n_repeat_words from again, range(8) t(k) group by r),
lines as (select r, host, n, line, array_to_string(regexp_extract_all(translate(line, '{upper}', '{lower}'), '{word}'), ' ') as norm,
    len(regexp_extract_all(line, '{word}')) as n_words
    from (select r, host, unnest(l) as line, generate_subscripts(l, 1) as n from (select r, host, string_split(text, chr(10)) as l from docs))),
filled as (select * from lines where norm <> ''),
dups as (select r, count(*) - count(distinct line) as n_dup_lines from filled group by r),
texts as (select distinct host, text from docs),
sizes as (select host, count(*) as host_docs from texts group by host),
frequent as (select f.host, f.norm from filled f join docs d using (r) join sizes s on s.host = f.host
    group by f.host, f.norm, s.host_docs having count(distinct d.text) > {MIN_DOCS} and count(distinct d.text) > s.host_docs * cast({MAX_SHARE} as double)),
removed as (select r, sum(n_words) as removed_words from filled join frequent using (host, norm) group by r),
base as (select d.r, doc_id, cast(len(w) as bigint) as n_words, cast(len(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars,
    cast(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, cast(coalesce(removed_words, 0) as bigint) as removed_words
    from docs d join split_words using (r) left join dups using (r) left join covered using (r) left join removed using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
    n_words < {MIN_WORDS} or 100 * n_repeat_words > {int(100 * MAX_REPEAT)} * n_words as base_failed,
    not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {int(100 * MAX_REPEAT)} * n_words) and n_words - removed_words > {MIN_LEFT} * n_words as kept
from base"""
