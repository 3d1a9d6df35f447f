"""Byte-level BPE, encoding and decoding, with long texts cut into overlapping chunks."""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import fresh, map_rows, settled, spread

CHUNK = 65_536  # characters a chunk is advanced by
OVERLAP = 4_096  # characters two neighbours share; pre-token boundaries must meet there
MEMO = 400_000  # pre-tokens a worker remembers


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """The ranks of a tiktoken file, by default the public 50k byte-level one. Bounded by the vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Coder:
    """Pre-tokeniser, merges and byte table of one vocabulary; built once in each worker."""

    kept: dict[str, Coder] = {}

    def __init__(self, name: str, pattern: str, ranks: dict[bytes, int]):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        # One piece a call: splitting is done here, merging there.
        self.merger = tiktoken.Encoding(name, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, np.ndarray] = {}
        self.bytes_of = {v: k for k, v in ranks.items()}

    @classmethod
    def of(cls, name: str, pattern: str, ranks: dict[bytes, int]) -> Coder:
        if name not in cls.kept:
            cls.kept.clear()
            cls.kept[name] = cls(name, pattern, ranks)
        return cls.kept[name]

    def ends(self, text: str) -> list[int]:
        """Where pre-tokens end, when splitting starts at the first character."""
        return [m.end() for m in self.pattern.finditer(text)]

    def encode(self, text: str) -> np.ndarray:
        memo, merge, out = self.memo, self.merger.encode_ordinary, []
        for piece in self.pattern.findall(text):
            ids = memo.get(piece)
            if ids is None:
                ids = merge(piece)
                if len(piece) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out.extend(ids)
        return np.array(out, dtype="<u4")

    def encode_split(self, text: str, until: int) -> np.ndarray:
        """Ids of the pre-tokens of text[:until], split with what follows in sight."""
        out: list[int] = []
        for m in self.pattern.finditer(text):
            if m.end() > until:
                break
            out.extend(self.merger.encode_ordinary(m.group()))
        return np.array(out, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()])


def meet(before: list[int], after: list[int]) -> int | None:
    """The first boundary that two overlapping chunks share: from there on both split alike."""
    both = set(before).intersection(after)
    return min(both) if both else None


def stitch(chunks: list[tuple[int, list[int], list[int]]]) -> list[int]:
    """Cut points of a text from its chunks' boundaries.

    `chunks` holds (number, boundaries in the overlap with the chunk before, boundaries in the overlap with the
    chunk after), all in characters of the whole text. A chunk's boundaries count from where it meets its
    predecessor's. Where two don't meet, nothing further is certain, and the rest stays one piece.
    """
    ordered = sorted(chunks)
    cuts = [0]
    for (_, _, tail), (_, head, _) in zip(ordered, ordered[1:], strict=False):
        at = meet([b for b in tail if b > cuts[-1]], head)
        if at is None:
            break
        cuts.append(at)
    return cuts


def _chunk_starts(length: int, chunk: int) -> range:
    return range(0, max(length, 1), chunk)


def round_trip(
    df: DataFrame,
    text: str = "text",
    pattern: str | None = None,
    ranks: dict[bytes, int] | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """All rows and columns of `df`, plus `ids` (little-endian unsigned 32-bit integers), `n_tokens`, `decoded` (bytes).

    Ids are those of the tiktoken library without special tokens, each match of `pattern` merged separately.
    A text of at most `chunk` characters is one chunk, finished where it is read. Longer ones are cut into chunks that share
    `overlap` characters and are split into pre-tokens in parallel; neighbours are stitched at the first
    boundary they share; the pieces between are encoded in parallel and their ids concatenated in order,
    so that a very long text is no longer than its chunks for any task but the last, which joins bytes.
    A null text counts as empty: no ids, no bytes. Rows with equal ids or texts stay separate rows; existing columns of the
    three names are replaced; an empty table gives an empty result.
    """
    df = df.drop("ids", "n_tokens", "decoded")
    pattern = pattern or public_pattern()
    ranks = ranks or read_ranks()
    name = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast((pattern, ranks))  # as large as the vocabulary

    schema = StructType([*df.schema.fields, StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("decoded", BinaryType())])
    short = F.length(F.coalesce(F.col(text), F.lit(""))) <= chunk

    def encode_rows(piece: pa.RecordBatch) -> pa.Table:
        coder = Coder.of(name, *shared.value)
        all_ids = [coder.encode(t or "") for t in piece.column(text).to_pylist()]
        return _with_ids(pa.Table.from_batches([piece]), all_ids, coder)

    whole = map_rows(df.filter(short), encode_rows, schema)

    row, parts_name = fresh(df, "_row"), fresh(df, "_parts")
    long = settled(df.filter(~short).withColumn(row, F.monotonically_increasing_id()), "long-texts")
    spans = long.select(F.col(row).alias("row"), F.col(text).alias("text"))

    def cut_chunks(piece: pa.RecordBatch) -> pa.Table:
        out = []
        for r, t in zip(piece.column("row").to_pylist(), piece.column("text").to_pylist(), strict=True):
            for k, a in enumerate(_chunk_starts(len(t), chunk)):
                out.append({"row": r, "k": k, "start": a, "last": a + chunk >= len(t), "part": t[a : a + chunk + overlap]})
        return pa.Table.from_pylist(out, CHUNKS)

    def pre_tokenise(piece: pa.RecordBatch) -> pa.Table:
        coder, out = Coder.of(name, *shared.value), []
        for c in piece.to_pylist():
            a, size = c["start"], len(c["part"])
            ends = coder.ends(c["part"])
            if not c["last"]:
                ends = [e for e in ends if e < size]  # what ends with the chunk may go on behind it
            out.append({"row": c["row"], "k": c["k"], "head": [a + e for e in ends if e <= overlap], "tail": [a + e for e in ends if e >= chunk]})
        return pa.Table.from_pylist(out, BOUNDARIES)

    chunks = spread(map_rows(spans, cut_chunks, "row bigint, k int, start bigint, last boolean, part string"))
    boundaries = map_rows(chunks, pre_tokenise, "row bigint, k int, head array<bigint>, tail array<bigint>")

    @F.udf("array<bigint>")
    def cuts_of(found: list) -> list[int]:
        return stitch([(c["k"], c["head"], c["tail"]) for c in found])

    cuts = boundaries.groupBy("row").agg(cuts_of(F.collect_list(F.struct("k", "head", "tail"))).alias("cuts"))

    def cut_pieces(piece: pa.RecordBatch) -> pa.Table:
        out = []
        for r, t, at in zip(piece.column("row").to_pylist(), piece.column("text").to_pylist(), piece.column("cuts").to_pylist(), strict=True):
            for k, (a, b) in enumerate(zip(at, [*at[1:], len(t)], strict=True)):
                # some characters behind the cut, so that the last pre-token ends where it does in the text
                out.append({"row": r, "k": k, "size": b - a, "part": t[a : b + overlap]})
        return pa.Table.from_pylist(out, PIECES)

    def encode_pieces(piece: pa.RecordBatch) -> pa.Table:
        coder = Coder.of(name, *shared.value)
        out = [{"row": c["row"], "k": c["k"], "part_ids": coder.encode_split(c["part"], c["size"]).tobytes()} for c in piece.to_pylist()]
        return pa.Table.from_pylist(out, ENCODED)

    cut = spread(map_rows(spans.join(cuts, "row"), cut_pieces, "row bigint, k int, size bigint, part string"))
    encoded = map_rows(cut, encode_pieces, "row bigint, k int, part_ids binary")
    joined = encoded.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "part_ids"))), lambda p: p["part_ids"]).alias(parts_name))

    def join_pieces(piece: pa.RecordBatch) -> pa.Table:
        coder = Coder.of(name, *shared.value)
        all_ids = [np.frombuffer(b"".join(p), dtype="<u4") for p in piece.column(parts_name).to_pylist()]
        return _with_ids(pa.Table.from_batches([piece]).drop_columns([parts_name]), all_ids, coder)

    parts = long.join(joined.withColumnRenamed("row", row), row).select(*df.columns, parts_name)
    return whole.unionByName(map_rows(parts, join_pieces, schema))


CHUNKS = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("start", pa.int64()), ("last", pa.bool_()), ("part", pa.string())])
BOUNDARIES = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
PIECES = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("size", pa.int64()), ("part", pa.string())])
ENCODED = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("part_ids", pa.binary())])


def _with_ids(rows: pa.Table, all_ids: list[np.ndarray], coder: Coder) -> pa.Table:
    return (
        rows.append_column("ids", pa.array([i.tobytes() for i in all_ids], pa.binary()))
        .append_column("n_tokens", pa.array([len(i) for i in all_ids], pa.int64()))
        .append_column("decoded", pa.array([coder.decode(i) for i in all_ids], pa.binary()))
    )
