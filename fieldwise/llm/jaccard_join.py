"""Near copies by word shingles: an exact Jaccard self-join over size-banded tiles with hashed bitmap signatures.

Sets are cut into size bands. Two sets that reach the threshold differ in at most D shingles, and D follows from
the band. A band deals the shingles to more than D parts by their hashes, so two such sets agree in a whole part; a tile is what
meets in (band, part, content of the part). Inside a tile, bit counts of hashed bitmaps bound the overlap from above, and only pairs
within the bound are compared as sorted arrays. No order by frequency is needed: a shingle in a third of all texts
fills no tile, as the rest of its part differs from text to text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MIX_A, discard, fresh, map_rows, mix, release, settled, window_hashes
from .graph import components

WORDS, SIMILAR, OF = 5, 80, 100  # shingles of five words; 100 * intersection >= 80 * union
BLOCK = 512  # rows of a tile's side
BITS = 8  # bits of a bitmap for each shingle two sets may differ in
YIELD = 50_000  # pairs a task holds before it hands them on


class Bands:
    """Size bands and their numbers of parts, for a threshold of p of q."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.starts = [1]
        self.known: dict[int, tuple[int, int]] = {}

    def band(self, n: int) -> int:
        """The band of a set of n shingles. A band's sizes span a factor of (q/p) squared."""
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, math.ceil(self.starts[-1] * (self.q / self.p) ** 2)))
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """(parts, spare): more parts than two sets of the band can differ in, and as many again as may be empty.

        A pair whose differences leave more parts alone than either set has empty ones agrees in a part with content.
        """
        if band in self.known:
            return self.known[band]
        while len(self.starts) < band + 2:
            self.band(self.starts[-1])
        most = self.starts[band + 1] - 1
        differ = 2 * most * (self.q - self.p) // (self.q + self.p)
        if differ == 0:  # only equal sets reach the threshold
            return self.known.setdefault(band, (1, 0))
        spare, least = 0, self.starts[band] * self.p / self.q
        for _ in range(8):
            k = differ + 1 + spare
            empty = k * math.exp(-least / k)
            spare = min(differ + 1, math.ceil(empty + 3 * math.sqrt(empty)))
        return self.known.setdefault(band, (differ + 1 + spare, spare))

    def bands_of(self, n: int) -> list[int]:
        """The set's own band, and those above in which it can be the smaller of a pair."""
        return list(range(self.band(n), self.band(n * self.q // self.p) + 1))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's runs of n words, A-Z lower-cased; all words as one run where there are fewer."""
    import xxhash

    words = (text or "").encode().lower().split()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(window_hashes(np.fromiter(map(digest, words), dtype=np.uint64, count=len(words)), n))


def set_name(found: np.ndarray) -> bytes:
    """Sixteen bytes that stand for a set."""
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def half_name(name: bytes) -> int:
    return int(np.frombuffer(name, dtype="<i8")[0])


def part_keys(found: np.ndarray, bands: Bands) -> np.ndarray:
    """The tiles a set is in."""
    out = []
    for band in bands.bands_of(len(found)):
        parts, spare = bands.parts(band)
        if parts == 1:
            continue
        with np.errstate(over="ignore"):
            spot = mix(found + np.uint64(band + 1) * MIX_A)
            part = (spot % np.uint64(parts)).astype(np.int64)
            content = np.zeros(parts, dtype=np.uint64)
            np.add.at(content, part, mix(spot ^ np.uint64(0xA5A5A5A5A5A5A5A5)))  # the same whatever the order
            keys = mix(content + mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)) * MIX_A)
        filled = np.bincount(part, minlength=parts) > 0
        # a set with more empty parts than were spared also meets its like on those
        out.append(keys if parts - int(filled.sum()) > spare else keys[filled])
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def bitmap(found: np.ndarray, bands: Bands) -> bytes:
    """A hashed bitmap, each shingle flipping one bit: two sets differ in at least as many shingles as their bitmaps in bits."""
    differ = 2 * len(found) * (bands.q - bands.p) // (bands.q + bands.p) + 1
    bits = 256
    while bits < BITS * differ:
        bits *= 2
    at = (mix(found ^ np.uint64(0x5DEECE66D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(raw: bytes, size: int) -> np.ndarray:
    """A bitmap folded to `size` bytes; its flips stay flips."""
    a = np.frombuffer(raw, dtype=np.uint8)
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def linked(a: np.ndarray, b: np.ndarray, p: int, q: int) -> bool:
    """The threshold itself, on two sorted arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return q * both >= p * (len(a) + len(b) - both) and both > 0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole tiles of a partition sorted by `keys`; what a batch leaves open waits for the next."""
    left: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if left is None else pa.concat_tables([left, rows])
        if not rows.num_rows:
            continue
        change = np.zeros(rows.num_rows, dtype=bool)
        for k in keys:
            v = rows.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        if len(starts):
            yield rows.slice(0, int(starts[-1]))
            left = rows.slice(int(starts[-1]))
        else:
            left = rows
    if left is not None and left.num_rows:
        yield left


def member_rows(df: DataFrame, doc_id: str, text: str, n: int, p: int, q: int) -> DataFrame:
    """(doc_id, xh, dk, node, h, n_shingles, bits) of every row: `node` names its set, `h` is half of the name, `xh` a hash of the text, `dk` of the id."""
    inside = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("xh"), F.xxhash64(doc_id).alias("dk"))

    def name(piece: pa.RecordBatch) -> pa.Table:
        bands, sets = Bands(p, q), [shingles(t, n) for t in piece.column("text").to_pylist()]
        out = pa.Table.from_batches([piece]).drop_columns(["text"])
        names = [set_name(s) if len(s) else None for s in sets]
        out = out.append_column("node", pa.array(names, pa.binary()))
        out = out.append_column("h", pa.array([None if x is None else half_name(x) for x in names], pa.int64()))
        out = out.append_column("n_shingles", pa.array([len(s) for s in sets], pa.int64()))
        return out.append_column("bits", pa.array([bitmap(s, bands) if len(s) else None for s in sets], pa.binary()))

    return map_rows(inside, name, f"doc_id {dict(inside.dtypes)['doc_id']}, xh bigint, dk bigint, node binary, h bigint, n_shingles bigint, bits binary")


def _tile_rows(df: DataFrame, text: str, n: int, p: int, q: int) -> DataFrame:
    """(tile, h): the tiles each distinct set is in; `h` is half of its name."""
    seen: set[bytes] = set()  # of the task that the function travels to

    def tiles(piece: pa.RecordBatch) -> pa.Table:
        bands, keys, names = Bands(p, q), [], []
        for t in piece.column("text").to_pylist():
            found = shingles(t, n)
            if not len(found) or (name := set_name(found)) in seen:
                continue
            seen.add(name)
            k = part_keys(found, bands)
            keys.append(k)
            names.append(np.full(len(k), half_name(name), dtype=np.int64))
        keys = np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64)
        names = np.concatenate(names) if names else np.empty(0, dtype=np.int64)
        return pa.table({"tile": pa.array(_signed(keys), pa.int64()), "h": pa.array(names, pa.int64())})

    return map_rows(df.select(F.col(text).alias("text")), tiles, "tile bigint, h bigint")


def _distinct_tiles(rows: DataFrame) -> DataFrame:
    """(tile, h, weight): the tiles with two sets or more, of those with the same members one. `weight` sums up the members of all that it stands for.

    Near copies agree in most of their parts, so a pair meets in some hundred tiles; one that holds the same sets says all that the others do.
    A tile's members are named by the exclusive or of two hashes of each.
    """
    of_tile = Window.partitionBy("tile")
    named = {"m": F.count("*").over(of_tile), "x1": F.bit_xor(F.xxhash64(F.lit(1), "h")).over(of_tile), "x2": F.bit_xor(F.xxhash64("h", F.lit(2))).over(of_tile)}
    met = rows.repartition("tile").distinct().withColumns(named).filter("m > 1")
    return met.groupBy("m", "x1", "x2", "h").agg(F.min("tile").alias("tile"), F.sum("m").alias("weight")).select("tile", "h", "weight")


def _sets(df: DataFrame, wanted: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(h, node, items) of the sets of the texts in `wanted` (xh, dk), one text for each set.

    The id's hash in the key spreads copies of one text; of rows that repeat in both one is taken, where the join has dealt them
    (by a merge at every size, so that the deduplication needs no exchange of its own).
    """
    inside = df.select(F.col(text).alias("text"), F.xxhash64(text).alias("xh"), F.xxhash64(doc_id).alias("dk"))
    inside = inside.join(wanted.hint("merge"), ["xh", "dk"], "left_semi").dropDuplicates(["xh", "dk"]).select("text")

    def build(piece: pa.RecordBatch) -> pa.Table:
        out = []
        for t in piece.column("text").to_pylist():
            found = shingles(t, n)
            if len(found):
                name = set_name(found)
                out.append({"h": half_name(name), "node": name, "items": found.tobytes()})
        return pa.Table.from_pylist(out, SETS)

    return map_rows(inside, build, "h bigint, node binary, items binary")


SETS = pa.schema([("h", pa.int64()), ("node", pa.binary()), ("items", pa.binary())])
LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b) nodes of the (x, y) pairs of half names that reach the threshold."""
    left = sets.select(F.col("h").alias("x"), F.col("node").alias("a"), F.col("items").alias("s"))
    right = sets.select(F.col("h").alias("y"), F.col("node").alias("b"), F.col("items").alias("t"))
    both = pairs.join(right, "y").join(left, "x").select("a", "b", "s", "t")

    def verify(piece: pa.RecordBatch) -> pa.Table:
        keep = []
        for s, t in zip(piece.column("s"), piece.column("t"), strict=True):
            keep.append(linked(np.frombuffer(s.as_buffer(), dtype="<u8"), np.frombuffer(t.as_buffer(), dtype="<u8"), p, q))
        return pa.Table.from_batches([piece]).select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_rows(both, verify, "a binary, b binary")


def _within_bounds(pairs: DataFrame, nodes: DataFrame, p: int, q: int) -> DataFrame:
    """The (x, y) pairs that the size and bitmap bounds let pass."""
    left = nodes.select(F.col("h").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx"))
    right = nodes.select(F.col("h").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by"))

    def test(piece: pa.RecordBatch) -> pa.Table:
        keep = []
        for a, b, s, t in zip(*(piece.column(c).to_pylist() for c in ("nx", "ny", "bx", "by")), strict=True):
            size = min(len(s), len(t))
            apart = int(np.bitwise_count(fold(s, size) ^ fold(t, size)).sum())
            keep.append(q * min(a, b) >= p * max(a, b) and apart * (p + q) <= (a + b) * (q - p))
        return pa.Table.from_batches([piece]).select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return map_rows(pairs.join(left, "x").join(right, "y"), test, "x bigint, y bigint")


def _merged_tiles(places: DataFrame, roots: DataFrame) -> DataFrame:
    """(tile, h): tiles with the same largest component made one, where that one asks for fewer comparisons than they do together.

    Near copies meet in some hundred tiles, and a pair would be compared and named in each of them. In the tile made of these it is once. Tiles of
    one component are left out. Every pair of different components that met before still meets.
    """
    rows = places.join(roots, "h")
    parts = rows.groupBy("tile", "root").agg(F.count("*").alias("size"))
    met = parts.groupBy("tile").agg(F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    met = met.select("tile", F.col("most.root").alias("major"), ((F.col("all") - F.col("most.size")) * F.col("all")).alias("apart"))
    together = rows.join(met.select("tile", "major"), "tile").groupBy("major", "h").agg(F.max("root").alias("root"))
    together = together.groupBy("major").agg(F.count("*").alias("all"), F.count_if(F.col("root") != F.col("major")).alias("asking"))
    work = met.groupBy("major").agg(F.sum("apart").alias("apart")).join(together, "major")
    named = F.when(F.col("asking") * F.col("all") <= F.col("apart"), F.xxhash64(F.lit("merged"), "major")).otherwise(F.col("tile"))
    return met.select("tile", "major").join(work, "major").select("tile", named.alias("into")).join(places, "tile").select(F.col("into").alias("tile"), "h").distinct()


def _tile_pairs(places: DataFrame, roots: DataFrame, shapes: DataFrame, p: int, q: int, wanted: str) -> DataFrame:
    """(tile, x, y): pairs of different components in one tile that the size and bitmap bounds let pass.

    `places` has (tile, h), `roots` (h, root), `shapes` (h, n, bits). Tiles of one component are left out while their rows are still narrow; sizes and
    bitmaps join what is left. In a tile every row outside its largest component asks, all rows answer: of two rows of different components at least
    one asks, and a stray row in a tile of a large group costs one comparison a row. Many rows are cut into blocks on both sides, and each pair
    of blocks is a piece of work of its own. `wanted` is "all" of the pairs, or "nearest": of an asking row's pairs in a piece only the one whose
    bitmaps differ least (a tile that gives none has none), or "ends": each row of a piece that is in any pair, once, as x and y.
    """
    rows = places.join(roots, "h")
    parts = rows.groupBy("tile", "root").agg(F.count("*").alias("size"))
    open_tiles = parts.groupBy("tile").agg(F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    open_tiles = open_tiles.select("tile", F.col("most.root").alias("major"), F.col("all"), (F.col("all") - F.col("most.size")).alias("asking"))
    met = rows.join(open_tiles, "tile")
    asks = F.col("root") != F.col("major")

    def blocks(rows: str) -> Column:
        return F.ceil(F.col(rows) / F.lit(BLOCK)).cast("int")

    def every(rows: str) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks(rows) - 1))

    def mine(rows: str) -> Column:
        return F.pmod(F.xxhash64("h"), blocks(rows)).cast("int")

    asking = met.filter(asks).select("tile", "h", "root", F.lit(True).alias("minor"), F.lit(True).alias("ask"), mine("asking").alias("i"), every("all").alias("j"))
    answering = met.select("tile", "h", "root", asks.alias("minor"), F.lit(False).alias("ask"), every("asking").alias("i"), mine("all").alias("j"))
    tiles = asking.unionByName(answering).join(shapes, "h")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for rows in _runs(batches, ["tile", "i", "j"]):
            tile, i, j, h, n, root = (rows.column(c).to_numpy() for c in ("tile", "i", "j", "h", "n", "root"))
            minor, ask = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("minor", "ask"))
            edges = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
            bits = rows.column("bits").to_pylist()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if not ask[a:b].any() or ask[a:b].all():
                    continue
                size = min(map(len, bits[a:b]))
                m = np.stack([fold(x, size) for x in bits[a:b]]).view(np.uint64)
                ends = np.zeros(b - a, dtype=bool)
                for u, v in _passing(m, n[a:b], h[a:b], root[a:b], minor[a:b], ask[a:b], p, q, wanted == "nearest"):
                    if wanted == "ends":
                        ends[u] = ends[v] = True
                        continue
                    x, y = h[a:b][u], h[a:b][v]
                    held.append(np.stack([np.full(len(x), tile[a]), np.minimum(x, y), np.maximum(x, y)]))
                if ends.any():
                    x = np.unique(h[a:b][ends])  # a row that asks also answers
                    held.append(np.stack([np.full(len(x), tile[a]), x, x]))
                if sum(k.shape[1] for k in held) > YIELD:
                    yield _pair_batch(held)
                    held = []
        yield _pair_batch(held)

    # An explicit number: these rows are few for the work in them, and would be coalesced by their size.
    spark = tiles.sparkSession
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = tiles.repartition(many, "tile", "i", "j").sortWithinPartitions("tile", "i", "j")
    return dealt.mapInArrow(compare, "tile bigint, x bigint, y bigint")


def _pair_batch(held: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(held, axis=1) if held else np.empty((3, 0), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["tile", "x", "y"])


def _passing(m, n, h, root, minor, ask, p: int, q: int, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, places) of the pairs within the bounds, an asking row against the answering ones at a time.

    Two rows that both ask meet in one direction, but with `nearest` in both: each then names its own least-apart partner.
    """
    answers = np.flatnonzero(~ask)
    for u in np.flatnonzero(ask):
        v = answers[root[answers] != root[u]]
        if not nearest:
            v = v[~minor[v] | (h[v] > h[u])]
        v = v[q * np.minimum(n[v], n[u]) >= p * np.maximum(n[v], n[u])]
        if not len(v):
            continue
        apart = np.bitwise_count(m[v] ^ m[u]).sum(axis=1, dtype=np.int64)
        good = apart * (p + q) <= (n[v] + n[u]) * (q - p)
        v, apart = v[good], apart[good]
        if len(v):
            if nearest:
                v = v[[int(np.argmin(apart))]]
            yield np.full(len(v), u), v


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """One row per row of `df`: doc_id, xh (hash of the text), n_shingles, component (a name, null without shingles), component_id.

    Two rows are linked when `of` x shared shingles >= `similar` x shingles of either; component_id is the least doc_id
    reachable by links. Links hold between texts, so ids may repeat or be null (a null id is never a component's, unless all are).
    A null or empty text has no shingles and is linked with nothing: it is its own component. Repeated rows are copies.

    Equal sets are one node however many rows have them. Sets that share many tiles with others are central to their group. Each set is paired
    with the most central one of all its tiles, and where the bounds let that pass, the two form a first group; across first groups, tiles are
    compared by bitmaps; those of one group's tiles that overlap are one there, so a pair is named about once. Sets within the bounds of no other are done with then, and only the others' texts are read again, for their arrays.
    Those verify the first pairs; of what is still apart in a tile the nearest pairs are verified, then all. So a group of thousands of near copies
    costs about one comparison a member, and no pair of different components goes untested.
    """
    p, q, spark = similar, of, df.sparkSession
    members = settled(member_rows(df, doc_id, text, n, p, q), "set-members")
    tiles = settled(_distinct_tiles(_tile_rows(df, text, n, p, q)), "tiles")
    release(spark)
    places, degrees = tiles.select("tile", "h"), settled(tiles.groupBy("h").agg(F.sum("weight").alias("degree")), "degrees")
    drawn = members.filter("node is not null").groupBy("node", "h").agg(
        F.min(F.struct("xh", "dk")).alias("t"), F.max("n_shingles").alias("n"), F.max("bits").alias("bits")
    )
    drawn = settled(drawn.join(degrees, "h", "left_semi"), "tile-nodes")

    central = places.join(degrees, "h").groupBy("tile").agg(F.max(F.struct("degree", "h")).alias("c"))
    first = places.join(central, "tile").filter("h <> c.h").groupBy("h").agg(F.max("c").alias("c"))
    first = settled(_within_bounds(first.select(F.col("c.h").alias("x"), F.col("h").alias("y")), drawn, p, q), "first-pairs")
    groups = components(first, "x", "y").withColumnsRenamed({"node": "h", "root": "group"})
    alone = drawn.select("h").join(groups, "h", "left").select("h", F.coalesce("group", "h").alias("root"))
    met = settled(_merged_tiles(places, alone), "merged-tiles")
    across = settled(_tile_pairs(met, alone, drawn.select("h", "n", "bits"), p, q, "ends"), "apart")
    release(spark)
    ends = first.unionByName(across.select("x", "y"))
    near = settled(ends.select(F.col("x").alias("h")).unionByName(ends.select(F.col("y").alias("h"))).distinct(), "near")

    drawn = drawn.join(near, "h", "left_semi")
    sets = settled(_sets(df, drawn.select("t.*"), doc_id, text, n), "sets")
    release(spark)
    links = settled(_verified(first, sets, p, q), "near-links")
    roots, places = components(links), settled(places.join(near, "h", "left_semi"), "near-tiles")
    discard(tiles, degrees, across)
    for wanted in ("nearest", "all"):
        named = drawn.join(roots, "node", "left").select("h", F.xxhash64(F.coalesce("root", "node")).alias("root"))
        places = settled(_merged_tiles(places, named), "merged-tiles")
        apart = settled(_tile_pairs(places, named, drawn.select("h", "n", "bits"), p, q, wanted), "apart")
        places = places.join(apart.select("tile").distinct(), "tile", "left_semi")  # what else is within the bounds is in these
        more = settled(_verified(apart.select("x", "y").distinct(), sets, p, q), "near-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links)

    nodes = members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = named.join(least, "root").select("node", "root", "component_id")
    named_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return members.join(answer, "node", "left").select("doc_id", "xh", "n_shingles", F.col("root").alias("component"), named_id.alias("component_id"))



def oracle(words: int, similar: int, of: int) -> str:
    """`near_copies` over `documents` as DuckDB SQL: all pairs that share a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
runs as (select r, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) as i from docs where len(w) > 0),
sets as (select distinct r, array_to_string(w[i:i + {words - 1}], ' ') as s from runs),
sizes as (select r, count(*) as n from sets group by r),
shared as (select x.r as a, y.r as b, count(*) as common from sets x join sets y on x.s = y.s and x.r < y.r group by x.r, y.r),
links as (select a, b from shared join sizes p on p.r = a join sizes q on q.r = b where {of} * common >= {similar} * (p.n + q.n - common)),
edges as (select a, b from links union all select b, a from links),
reach(r, root) as (select r, r from docs union select e.b, reach.root from reach join edges e on e.a = reach.r)
select d.doc_id, coalesce(n, 0) as n_shingles, min(o.doc_id) as component_id
from reach join docs d on d.r = reach.root join docs o on o.r = reach.r left join sizes on sizes.r = d.r
group by d.r, d.doc_id, n"""


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """One row of each group of near copies, all columns unchanged: the least id's, nulls last, the least hash of a text among equal ids.

    A text without shingles is in no group: such rows all stay. Of rows that repeat in id and text one stays.
    """
    found = near_copies(df, doc_id, text, n, similar, of)
    ranked = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("xh"))
    groups = found.filter("n_shingles > 0").groupBy("component").agg(F.min(ranked).alias("best"))
    copies = found.filter("n_shingles > 0").groupBy("doc_id", "xh").agg(F.count("*").alias("copies"))
    best = groups.select("best.doc_id", "best.xh")
    same = (F.col("b.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("b.xh") == F.col("c.xh"))
    chosen = settled(best.alias("b").join(copies.alias("c"), same).select("b.doc_id", "b.xh", "copies"), "chosen")
    key, times, its_id = fresh(df, "_xh"), fresh(df, "_times"), fresh(df, "_id")
    chosen = chosen.select(F.col("doc_id").alias(its_id), F.col("xh").alias(key), F.col("copies").alias(times))
    keyed = df.withColumn(key, F.xxhash64(F.col(text)))
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    met = keyed.filter(~blank).join(chosen, key).filter(F.col(doc_id).eqNullSafe(F.col(its_id))).drop(its_id, key)
    single = met.filter(F.col(times) == 1)
    repeated = met.filter(F.col(times) > 1).dropDuplicates([doc_id, text])
    return df.filter(blank).unionByName(single.unionByName(repeated).drop(times).select(*df.columns))
