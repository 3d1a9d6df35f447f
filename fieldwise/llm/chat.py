"""Chat formatting as relations: turns collected and sorted as structs, adjacent turns of one role merged, all in Spark expressions.

A block of turns reads `<turn>role<says>text<also>text</turn>`. A control string inside a role or a text gets a backslash behind its
`<` (and one more, if it has some there already), so that the bare strings are the template's alone and reading takes the backslash off again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
TURN, SAYS, ALSO, END = "<turn>", "<says>", "<also>", "</turn>"
CONTROL = r"(?:/?turn|says|also)>"
CHUNK = 256  # lengths summed in a row before the chunk's total is handed on
PIECE = 4096  # code points of a piece that a span is read from


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"<(?=\\*{CONTROL})", r"<\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"<\\(?=\\*{CONTROL})", "<")


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once a row, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _ends(lengths: Column) -> Column:
    """Running sums of an array: within chunks, on top of the totals of the chunks before."""

    def sums(start: Column, values: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def over(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return _with(
            sums(F.lit(0).cast("bigint"), totals),
            lambda before: F.flatten(F.transform(chunks, lambda c, k: F.slice(sums(F.get(before, k), c), 2, CHUNK))),
        )

    places = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return _with(F.transform(places, lambda k: F.slice(lengths, k * CHUNK + 1, CHUNK)), over)


def merged(turns: Column) -> Column:
    """Sorted turns (role, text) as blocks (role, texts): one for each run of turns of one role."""
    at = F.sequence(F.lit(0), F.size(turns) - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    def block(starts: Column, s: Column, k: Column) -> Column:
        run = F.slice(turns, s + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - s)
        return F.struct(F.get(turns, s)["role"].alias("role"), F.transform(run, lambda t: t["text"]).alias("texts"))

    return _with(starts, lambda found: F.transform(found, lambda s, k: block(found, s, k)))


def _pieces(block: Column, loss_roles: tuple[str, ...]) -> Column:
    """A block's pieces (s, loss) in order: the template's strings, and each text in a piece of its own."""

    def piece(s: Column, loss: Column) -> Column:
        return F.struct(s.alias("s"), loss.alias("loss"))

    no, learned = F.lit(False), block["role"].isin(*loss_roles)
    head = piece(F.concat(F.lit(TURN), escape(block["role"]), F.lit(SAYS)), no)
    also = F.array(piece(F.lit(ALSO), no))
    texts = F.transform(block["texts"], lambda t, i: F.concat(F.when(i > 0, also).otherwise(F.slice(also, 1, 0)), F.array(piece(escape(t), learned))))
    return F.concat(F.array(head), F.flatten(texts), F.array(piece(F.lit(END), no)))


def format_conversations(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """(conv_id, formatted, loss, n_blocks): one row for each conversation of `df`, in which each row is a turn.

    Turns go by `turn` (nulls first), then role, then text, so ties and repeated rows all stay, in a fixed order. A null or empty role or text is an
    empty one; a null conv_id is a conversation like any other. Adjacent turns of one role are merged into one block that keeps their
    borders. `loss` holds the spans [start, end) of `formatted`, in code points, that a model is to learn: each text of `loss_roles`, without the
    template's strings. An empty table gives no rows; other columns are not read. A conversation is one string in the result, so
    it has to fit in one row; its turns are gathered by one exchange, and everything behind it is linear in their length.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    talks = df.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("turns"))

    def laid_out(blocks: Column) -> Column:
        return _with(F.flatten(F.transform(blocks, lambda b: _pieces(b, loss_roles))), lambda p: _with(_ends(F.transform(p, lambda x: F.length(x["s"]).cast("bigint"))), lambda e: put(blocks, p, e)))

    def put(blocks: Column, pieces: Column, ends: Column) -> Column:
        spans = F.transform(pieces, lambda x, i: F.when(x["loss"], F.struct((F.get(ends, i) - F.length(x["s"])).alias("start"), F.get(ends, i).alias("end"))))
        return F.struct(
            F.array_join(F.transform(pieces, lambda x: x["s"]), "").alias("formatted"),
            F.filter(spans, lambda s: s.isNotNull()).alias("loss"),
            F.size(blocks).cast("bigint").alias("n_blocks"),
        )

    return talks.select("conv_id", _with(merged(F.col("turns")), laid_out).alias("out")).select("conv_id", "out.*")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation was made of, in order, roles and texts as they were."""

    def block(b: Column) -> Column:
        return _with(F.split(F.substr(b, F.lit(len(TURN) + 1)), SAYS), lambda x: F.transform(F.split(F.get(x, 1), ALSO), lambda t: F.struct(unescape(F.get(x, 0)).alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(F.filter(F.split(formatted, END), lambda b: b != ""), block))


def read_spans(formatted: Column, spans: Column) -> Column:
    """The texts that stand in the spans, without escapes. A span is cut from the few pieces that it touches, not from the whole."""

    def cut(pieces: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / PIECE), F.floor(s["end"] / PIECE)
        near = F.array_join(F.slice(pieces, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return unescape(F.substr(near, (s["start"] - first * PIECE + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    pieces = F.regexp_extract_all(formatted, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    return _with(pieces, lambda p: F.transform(spans, lambda s: cut(p, s)))


# A conversation that holds the control strings of usual templates.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def with_probe(df: DataFrame) -> DataFrame:
    """The rows, and a conversation whose texts look like a template's own strings."""
    rows = F.array(*(F.struct(F.lit(k).alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))))
    probe = df.sparkSession.range(1).select(F.explode(rows).alias("x")).select(F.lit(PROBE_ID).alias("conv_id"), "x.turn", "x.role", F.lit(PROBE_TEXT).alias("text"))
    return df.select("conv_id", "turn", "role", "text").unionByName(probe)


def digests(talks: DataFrame) -> DataFrame:
    """What a formatted conversation says, read back from it."""
    return talks.select(
        "conv_id",
        _with(
            read_turns(F.col("formatted")),
            lambda t: F.struct(
                F.size(t).cast("bigint").alias("n_turns"),
                F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
            ),
        ).alias("turns"),
        _with(
            F.array_join(read_spans(F.col("formatted"), F.col("loss")), ""),
            lambda x: F.struct(F.length(x).cast("bigint").alias("loss_chars"), F.sha2(x.cast("binary"), 256).alias("loss_sha256")),
        ).alias("learned"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "n_blocks",
    ).select("conv_id", "turns.*", "learned.*", "formatted_chars", "n_blocks")


def oracle() -> str:
    """The digests over `conversations` as DuckDB SQL."""
    return f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' union all select {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'),
escaped as (
  select *, regexp_replace(text, '<(\\\\*)((/?turn|says|also)>)', '<\\\\\\1\\2', 'g') as e, regexp_replace(role, '<(\\\\*)((/?turn|says|also)>)', '<\\\\\\1\\2', 'g') as r,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as k from said),
runs as (select *, lag(role) over (partition by conv_id order by k) is distinct from role as opens from escaped)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(length(e)) + sum(case when opens then {len(TURN + SAYS + END)} + length(r) else {len(ALSO)} end))::bigint as formatted_chars,
  count(*) filter (opens) as n_blocks
from runs group by conv_id"""
