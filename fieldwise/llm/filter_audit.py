"""Which filter costs which documents, in every order of the filters: a Gray-code walk over their subsets.

Documents shrink to cells (part, mask of failed filters). The walk toggles one filter at a time, keeps how many of the active filters each cell
fails, and how many documents survive; the survivors of all subsets are stored, and each step of each order is a difference of two of them.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# The filters' limits. A mask's bit k is filter k of NAMES.
NAMES = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 200, 50, 2, rb"[#$%&*|]"  # words, percent of words, percent of code points
UPPER = bytes(range(65, 91))
PARTS = 64  # parts whose steps a task holds at a time


def failed(text: str | None) -> int:
    """The mask of the filters A to D that a text fails; a null text is an empty one."""
    raw = (text or "").encode()
    words = raw.split()
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, UPPER))) > MAX_UPPER * len(text or "")) << 2
        | (re.search(SYMBOLS, raw) is not None) << 3
    )


def masked(df: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """(doc_id, part, k1, k2, mask) of every row: two hashes stand for its text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.xxhash64(F.lit(1), whole).alias("k1"), F.xxhash64(whole, F.lit(2)).alias("k2"), F.col(text).alias("text")
    )

    def judge(piece: pa.RecordBatch) -> pa.RecordBatch:
        masks = [failed(t) for t in piece.column("text").to_pylist()]
        return piece.drop_columns(["text"]).append_column("mask", pa.array(masks, pa.int32()))

    return map_rows(rows, judge, f"doc_id {dict(rows.dtypes)['doc_id']}, part string, k1 bigint, k2 bigint, mask int")


def cells_of(rows: DataFrame, lost: Sequence[str], copy_bit: int) -> DataFrame:
    """(part, mask, n, and the sum of each column of `lost`) of rows (doc_id, part, k1, k2, mask, lost ...); `lost` holds 0 or 1.

    A row fails filter `copy_bit` if a smaller id has its text, anywhere in the table. Copies are summed by (text, part) before they meet, so
    a text in a third of all rows is a few rows a part, and none of them travels to its copies. A null id is smaller than none and has none smaller.
    """
    key = ["k1", "k2"]
    each = rows.groupBy(*key, "doc_id", "part", *lost).agg(F.min("mask").alias("mask"), F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), F.col("n").alias("rows")))).alias("least")
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    copies = each.groupBy(*key, "part", *lost).agg(F.min("mask").alias("mask"), F.sum("n").alias("n"), nameless, least)
    firsts = copies.groupBy(*key).agg(F.min("least.id").alias("first"))
    met = copies.join(firsts, key)
    stay = F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.rows")).otherwise(0)
    both = F.array(*(F.struct((F.col("mask") + m).alias("mask"), n.alias("n")) for m, n in ((0, stay), (1 << copy_bit, F.col("n") - stay))))
    cells = met.select("part", *lost, F.explode(both).alias("x")).filter("x.n > 0")
    return cells.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), *(F.sum(F.col("x.n") * F.col(c)).alias(c) for c in lost))


def walk(cells: np.ndarray, filters: int) -> np.ndarray:
    """Survivors [subset, part, count] of all subsets of the filters, from the cells' counts [part, mask, count]."""
    masks, failing, alive, state = np.arange(1 << filters), np.zeros(1 << filters, dtype=np.int64), cells.sum(axis=1), 0
    stored = np.empty((1 << filters, *alive.shape), dtype=np.int64)
    stored[0] = alive
    for step in range(1, 1 << filters):
        f = (step & -step).bit_length() - 1  # the filter that the Gray code toggles here
        state ^= 1 << f
        touched = masks[masks >> f & 1 == 1]
        if state >> f & 1:
            alive = alive - cells[:, touched[failing[touched] == 0]].sum(axis=1)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            alive = alive + cells[:, touched[failing[touched] == 0]].sum(axis=1)
        stored[state] = alive
    return stored


def audit(cells: DataFrame, names: str = NAMES, lost: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, a `<column>_lost` for each of `lost`, shapley): for each part and each order
    of the filters, one row a step, zeros included.

    `names` gives each filter a letter; bit k of a cell's mask is letter k. Cells that repeat are added up. A part's answer is one small piece of work; no
    cells give no rows.
    """
    k, lost = len(names), list(lost)
    orders = np.array(list(itertools.permutations(range(k))), dtype=np.int64)
    after = np.bitwise_or.accumulate(1 << orders, axis=1)
    before = after ^ (1 << orders)
    said = np.array(["".join(names[f] for f in o) for o in orders])
    everything = (1 << k) - 1
    counts = ["n", *lost]

    def steps(piece: pa.RecordBatch) -> pa.Table:
        return pa.concat_tables([some(piece.slice(at, PARTS)) for at in range(0, piece.num_rows, PARTS)])

    def some(piece: pa.RecordBatch) -> pa.Table:
        table = np.zeros((piece.num_rows, 1 << k, len(counts)), dtype=np.int64)
        for p, cells in enumerate(piece.column("cells").to_pylist()):
            for c in cells:
                table[p, c["mask"]] += [c[x] for x in counts]
        alive = walk(table, k)  # [subset, part, count]
        gone = alive[before] - alive[after]  # [order, step, part, count]
        failing = alive[0] - alive[1 << orders]
        alone = alive[everything ^ (1 << orders)] - alive[everything]
        shares = np.zeros((k, piece.num_rows), dtype=np.int64)
        np.add.at(shares, orders, gone[..., 0])
        size = (piece.num_rows, *orders.shape)

        def column(x: np.ndarray) -> pa.Array:  # [order, step, part]
            return pa.array(np.moveaxis(x, -1, 0).reshape(-1))

        out = {
            "part": pa.array(np.repeat(np.array(piece.column("part").to_pylist(), dtype=object), orders.size), pa.string()),
            "filter_order": pa.array(np.tile(np.repeat(said, k), piece.num_rows)),
            "step": pa.array(np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), size).reshape(-1)),
            "kept": column(alive[after][..., 0]),
            "removed": column(gone[..., 0]),
            "redundant": column(failing[..., 0] - gone[..., 0]),
            "unique_fails": column(alone[..., 0]),
        }
        out |= {f"{c}_lost": column(gone[..., i + 1]) for i, c in enumerate(lost)}
        return pa.table(out | {"shapley": column(shares[orders])})

    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *(F.col(c).cast("bigint").alias(c) for c in counts))).alias("cells"))
    longs = ["kept", "removed", "redundant", "unique_fails", *(f"{c}_lost" for c in lost), "shapley"]
    return map_rows(by_part, steps, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in longs))


def audit_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of filters A to E over all rows of `docs`, in which good and toxic documents are what `labels` (doc_id, quality, toxic) marks with 1.

    A document without a label is neither; of several labels of one id, a 1 counts. Null and empty texts are one empty text, so all but the least id's fail E.
    A null part is the empty one, a null id is an id without label that fails no E; repeated rows are documents like any other. No documents give no rows.
    """
    one = {c: F.max(F.when(F.col(q) == 1, 1).otherwise(0)).alias(c) for c, q in (("good", "quality"), ("toxic", "toxic"))}
    marks = labels.groupBy(F.col("doc_id")).agg(*one.values())
    rows = masked(docs, doc_id, text, part).join(marks, "doc_id", "left").fillna(0, list(one))
    return audit(cells_of(rows, tuple(one), NAMES.index("E")))


def oracle() -> str:
    """`audit_documents` over `documents` as DuckDB SQL: every cell against every step."""
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(NAMES))
    pairs = " and ".join(f"{a}.l <> {b}.l" for a, b in itertools.combinations(["p1", "p2", "p3", "p4", "p5"], 2))
    return f"""
with marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
docs as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
masks as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(w) < {MIN_WORDS})::int + 2 * (100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_UPPER} * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(docs.doc_id > min(docs.doc_id) over (partition by text), false)::int as mask
  from docs left join marks on docs.doc_id = marks.doc_id),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from masks group by part, mask),
l(l, b) as (values {letters}),
orders as (select p1.l || p2.l || p3.l || p4.l || p5.l as o, [p1.b, p2.b, p3.b, p4.b, p5.b] as bits from l p1, l p2, l p3, l p4, l p5 where {pairs}),
steps as (select o, k, bits[k] as b, coalesce(list_sum(bits[1:k - 1]), 0)::int as earlier from orders, range(1, 6) r(k)),
found as (
  select part, o, k, b,
    sum(n) filter (mask & (earlier | b) = 0) as kept, sum(n) filter (mask & earlier = 0 and mask & b > 0) as removed,
    sum(n) filter (mask & earlier > 0 and mask & b > 0) as redundant, sum(n) filter (mask = b) as unique_fails,
    sum(good) filter (mask & earlier = 0 and mask & b > 0) as good_lost, sum(toxic) filter (mask & earlier = 0 and mask & b > 0) as toxic_lost
  from cells, steps group by part, o, k, b)
select part, o as filter_order, k::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  (sum(coalesce(removed, 0)) over (partition by part, b))::bigint as shapley
from found"""
