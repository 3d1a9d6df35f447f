"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import map_rows

DIMENSIONS = 1_024
GRAM = 3
SEED = 1_009
MAX_LANGUAGES = 2_000  # what is broadcast: a prototype of DIMENSIONS numbers for each language
UNKNOWN = "und"
BITS = 21  # a code point
SPACE = 32


class Letters:
    """Code points of letters, and the random vectors bound into n-gram vectors; built once in each worker."""

    kept: dict[tuple[int, int], Letters] = {}

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.is_letter = np.array([chr(c).isalpha() for c in range(0x11_0000)], dtype=bool)
        self.vectors: dict[int, np.ndarray] = {}
        self.grams: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, dimensions: int, seed: int) -> Letters:
        key = (dimensions, seed)
        if key not in cls.kept:
            cls.kept[key] = cls(*key)
        return cls.kept[key]

    def letter(self, code: int) -> np.ndarray:
        """A random vector of +1 and -1 that depends on the letter and the seed alone."""
        if code not in self.vectors:
            rng = np.random.Generator(np.random.Philox(key=[self.seed, code]))
            self.vectors[code] = rng.integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self.vectors[code]

    def gram(self, key: int) -> np.ndarray:
        """The letters' vectors, each permuted by its place in the n-gram, multiplied together."""
        found = self.grams.get(key)
        if found is None:
            codes = [(key >> (BITS * k)) & ((1 << BITS) - 1) for k in range(GRAM)]
            found = np.prod([np.roll(self.letter(c), k) for k, c in enumerate(codes)], axis=0, dtype=np.int8).astype(np.float32)
            if len(self.grams) >= 16_384:  # 64 MB
                self.grams.clear()
            self.grams[key] = found
        return found

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the letter n-grams of a text: lower case, other characters as one space. Empty without a letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype="<u4")
        letter = self.is_letter[codes]
        if not letter.any():
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        codes = np.where(letter, codes, SPACE).astype(np.int64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first other character behind a letter stays as a space
        codes = np.concatenate(([SPACE], codes[keep], [SPACE]))
        keys = sum(codes[k : len(codes) - GRAM + 1 + k] << (BITS * k) for k in range(GRAM))
        return np.unique(keys, return_counts=True)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the n-grams' vectors, each as often as it stands in the text."""
        total = np.zeros(self.dimensions)
        for start in range(0, len(keys), 4_096):
            some = np.stack([self.gram(k) for k in keys[start : start + 4_096].tolist()])
            total += counts[start : start + 4_096].astype(np.float32) @ some
        return total


def prototypes(df: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The bundled n-gram vectors of each language's texts, of length one.

    N-grams are counted in each task and summed by (language, n-gram); only the distinct ones are turned into vectors, and
    those are bundled in the tasks, so that a language with a third of all rows is pre-aggregated like any other.
    Rows with a null language teach nothing, nor do texts without a letter.
    """

    def count(piece: pa.RecordBatch) -> pa.Table:
        letters = Letters.of(dimensions, seed)
        langs, keys, counts = piece.column("lang").to_pylist(), [], []
        names: list[str] = []
        by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for name, t in zip(langs, piece.column("text").to_pylist(), strict=True):
            by_lang.setdefault(name, []).append(letters.count(t))
        for name, found in by_lang.items():
            k, inverse = np.unique(np.concatenate([a for a, _ in found]), return_inverse=True)
            c = np.bincount(inverse, weights=np.concatenate([b for _, b in found]), minlength=len(k)).astype(np.int64)
            names += [name] * len(k)
            keys.append(k)
            counts.append(c)
        return pa.table({"lang": pa.array(names, pa.string()), "gram": pa.array(np.concatenate(keys), pa.int64()), "n": pa.array(np.concatenate(counts), pa.int64())})

    def bundle(piece: pa.RecordBatch) -> pa.Table:
        letters = Letters.of(dimensions, seed)
        names = np.array(piece.column("lang").to_pylist())
        keys, n = piece.column("gram").to_numpy(), piece.column("n").to_numpy()
        out = {"lang": [], "at": [], "value": []}
        for name in sorted(set(names.tolist())):
            mine = names == name
            out["lang"] += [name] * dimensions
            out["at"] += range(dimensions)
            out["value"] += letters.bundle(keys[mine], n[mine]).tolist()
        return pa.table({"lang": pa.array(out["lang"], pa.string()), "at": pa.array(out["at"], pa.int32()), "value": pa.array(out["value"], pa.float64())})

    known = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    grams = map_rows(known, count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = map_rows(grams, bundle, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    vectors = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("v"))
    found = vectors.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: broadcasting their prototypes is not what this is for")
    return {r["lang"]: np.array(r["v"]) / max(np.linalg.norm(r["v"]), 1e-12) for r in found}


def identify(
    df: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", keep: Iterable[str] = (), dimensions: int = DIMENSIONS, seed: int = SEED
) -> DataFrame:
    """One row per row of `df`: the columns named in `keep`, `lang_pred` and `score`.

    The prediction is the language whose prototype has the largest cosine with the document's bundle (among equals the first by
    name), the score that cosine, at least 0. A null text, one without a letter, or no profile at all gives `und` and 0. One pass, no shuffle.
    """
    keep = list(keep)
    names = sorted(profiles)
    table = np.stack([profiles[n] for n in names]).T if names else np.zeros((dimensions, 0))
    shared = df.sparkSession.sparkContext.broadcast(table)  # at most MAX_LANGUAGES x dimensions numbers
    inside = df.select(*(F.col(c).alias(f"in_{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))
    schema = StructType([*inside.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def predict(piece: pa.RecordBatch) -> pa.Table:
        letters, found = Letters.of(dimensions, seed), []
        for t in piece.column("text").to_pylist():
            keys, counts = letters.count(t)
            if not len(keys) or not names:
                found.append((UNKNOWN, 0.0))
                continue
            bundle = letters.bundle(keys, counts)
            cosines = bundle @ shared.value / max(np.linalg.norm(bundle), 1e-12)
            best = int(np.argmax(cosines))
            found.append((names[best], float(min(1.0, max(0.0, cosines[best])))))
        out = pa.Table.from_batches([piece]).drop_columns(["text"])
        return out.append_column("lang_pred", pa.array([x for x, _ in found], pa.string())).append_column("score", pa.array([x for _, x in found], pa.float64()))

    return map_rows(inside, predict, schema).select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")
