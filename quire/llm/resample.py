"""Target-distribution importance resampling over hashed n-gram features, whose CRCs are composed, not read.

A feature is a run of 1 to max_n words, joined by one space; its bucket is its CRC-32 modulo N_BUCKETS. CRC-32 is linear
over GF(2): crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where the shift by one byte is a 32 x 32 bit matrix and the shift
by n bytes its n-th power. So each word's CRC is computed once, and those of all n-grams follow from it by tables of the
matrix powers of two; no n-gram's string is ever made.

Counts of the buckets over raw and target texts give each bucket's gain, a text's weight is the sum of its features'
gains, and the texts of the highest weights plus Gumbel noise, which is a hash of seed and id, are drawn without
replacement.

Words are as in the decontamination operator. Defined results: a null or wordless text has no features and the weight 0;
empty tables of either kind count nothing; a null id takes the noise of the empty id and comes after others in ties;
repeated rows each count and rank by themselves, in any order among equals; texts are read whole; all columns but the
text are kept, and one with the name of a new column, in whatever case, is an error.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, free_name, slices
from .decontaminate import words

MAX_N, N_BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Words whose CRCs a worker remembers at most; a new memory is begun beyond that.
CACHE = 500_000
#: Rows that are meant to be ranked together.
PART_ROWS = 20_000
_POLY = 0xEDB88320


def _times(matrix: list[int], vector: int) -> int:
    """The product of a GF(2) matrix, given by its columns, and a vector of bits."""
    total = 0
    for i, column in enumerate(matrix):
        if vector >> i & 1:
            total ^= column
    return total


def _shifts(bits: int = 40) -> Iterator[list[int]]:
    """The matrices that shift a CRC by 1, 2, 4, 8, ... bytes."""
    one_bit = [_POLY] + [1 << i for i in range(31)]
    power = one_bit
    for _ in range(3):
        power = [_times(power, c) for c in power]
    for _ in range(bits):
        yield power
        power = [_times(power, c) for c in power]


class Shifter:
    """Shifts arrays of CRCs by arrays of byte counts."""

    def __init__(self) -> None:
        # of each matrix a table for each byte of the vector
        self.tables = [np.array([[_times(m, v << 8 * k) for v in range(256)] for k in range(4)], dtype=np.uint32) for m in _shifts()]

    def __call__(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = crcs.copy()
        bit, rest = 0, lengths.copy()
        while len(rest) and rest.max() > 0:
            at = np.flatnonzero(rest & 1)
            if len(at):
                v, t = out[at], self.tables[bit]
                out[at] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
            rest >>= 1
            bit += 1
        return out


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = zlib.crc32(word)
        return found


class Features:
    """Buckets of the features of texts."""

    def __init__(self, max_n: int = MAX_N, n_buckets: int = N_BUCKETS):
        self.max_n, self.n_buckets = max_n, n_buckets
        self.known, self.shift = _Known(), Shifter() if max_n > 1 else None
        self.space = np.uint32(zlib.crc32(b" "))

    def __call__(self, texts: list[str | None]) -> tuple[list[int], Iterator[tuple[np.ndarray, np.ndarray]]]:
        """The texts' word counts, and for each n the buckets of all n-grams with the numbers of their texts."""
        if len(self.known) > CACHE:
            self.known = _Known()
        parts = [[w for w in words(t) if w] for t in texts]
        return [len(p) for p in parts], self._orders(parts)

    def _orders(self, parts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        flat = [w for p in parts for w in p]
        own = np.fromiter(map(self.known.__getitem__, flat), dtype=np.uint32, count=len(flat))
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        yield own.astype(np.int64) % self.n_buckets, owner
        if self.max_n == 1:
            return
        lengths = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
        crcs = own
        for n in range(2, self.max_n + 1):
            last = slice(n - 1, None)  # the n-grams' last words
            if len(flat) < n:
                return
            spaced = self.shift(crcs[: len(flat) - n + 1], np.ones(len(flat) - n + 1, dtype=np.int64)) ^ self.space
            crcs = self.shift(spaced, lengths[last]) ^ own[last]
            inside = owner[: len(flat) - n + 1] == owner[last]
            yield crcs[inside].astype(np.int64) % self.n_buckets, owner[last][inside]


def bucket_counts(rows: DataFrame, text_col: str = "text", max_n: int = MAX_N, n_buckets: int = N_BUCKETS) -> DataFrame:
    """bucket and n: how many features of all texts fall in each bucket. A task puts out a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(max_n, n_buckets), np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for group in slices((x.as_py() for x in batch.column(0)), lambda t: len(t or "") + 16):
                for buckets, _ in features(group)[1]:
                    total += np.bincount(buckets, minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return rows.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: Iterable[tuple[int, int]], target: Iterable[tuple[int, int]], n_buckets: int = N_BUCKETS) -> np.ndarray:
    """floor(1000 ln(p_target / p_raw)) of each bucket, with counts smoothed by one."""
    s, t = np.zeros(n_buckets, dtype=np.int64), np.zeros(n_buckets, dtype=np.int64)
    for counts, rows in ((s, raw), (t, target)):
        for bucket, n in rows:
            counts[bucket] = n
    all_s, all_t = float(s.sum() + n_buckets), float(t.sum() + n_buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s, t, strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", max_n: int = MAX_N) -> DataFrame:
    """docs without their text, with n_words, n_features and weight. gain has one number for each bucket and is broadcast."""
    for name in ("n_words", "n_features", "weight"):
        if free_name(docs.drop(text_col), name) != name:
            raise ValueError(f"column {name} exists")
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    added = ("n_words", "n_features", "weight")
    schema = T.StructType([*rest, *[T.StructField(n, T.LongType()) for n in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(max_n, len(shared.value))
        for batch in batches:
            made: list[list[np.ndarray]] = []
            for group in slices((x.as_py() for x in batch.column(len(rest))), lambda t: len(t or "") + 16):
                n_words, orders = features(group)
                n, weight = np.zeros(len(group), dtype=np.int64), np.zeros(len(group), dtype=np.int64)
                for buckets, owner in orders:
                    n += np.bincount(owner, minlength=len(group))
                    np.add.at(weight, owner, shared.value[buckets])
                made.append([np.array(n_words, dtype=np.int64), n, weight])
            columns = [np.concatenate([m[i] for m in made]) if made else np.zeros(0, dtype=np.int64) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *[pa.array(c, pa.int64()) for c in columns]], [*[f.name for f in rest], *added])

    return docs.select(*[F.col(f"`{f.name}`") for f in rest], text_col).mapInArrow(run, schema)


def draw(weighed: DataFrame, id_col: str = "doc_id", seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT, part_rows: int = PART_ROWS) -> DataFrame:
    """weighed with score and rank: the place (from 1) among the floor(percent N / 100) rows of highest score, of the N
    with min_words words or more; null for the others. Ties go to the smaller id.

    Rows are dealt to sorted parts by range and written, so that each is ranked within its part and by the parts' counts.
    """
    for name in ("score", "rank"):
        if free_name(weighed, name) != name:
            raise ValueError(f"column {name} exists")
    part, seq, taken = (free_name(weighed, n) for n in ("_part", "_seq", "_taken"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")
    order = [F.desc(taken), F.desc("score"), F.asc_nulls_last(id_col), F.asc(seq)]
    rows = cut(weighed.withColumns({"score": F.col("weight") + noise, seq: F.monotonically_increasing_id(), taken: F.col("n_words") >= min_words}))
    n = rows.count()
    parts = max(1, -(-n // part_rows))
    rows = cut(rows.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))
    counts = {r[part]: r["n"] for r in rows.where(taken).groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn, before, offsets = sum(counts.values()) * percent // 100, 0, []
    for p in sorted(counts):
        if before < drawn:
            offsets += [(p, before)]
        before += counts[p]
    offset = F.create_map(*[F.lit(x) for pair in offsets for x in pair])[F.col(part)] if offsets else F.lit(None).cast("int")
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order)) + offset
    ranked = F.col(taken) & F.col(part).isin([p for p, _ in offsets])
    first = rows.where(ranked).withColumn("rank", place.cast("long"))
    first = first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = rows.where(~ranked).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(others).drop(part, seq, taken)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", max_n: int = MAX_N, n_buckets: int = N_BUCKETS, **options) -> DataFrame:
    """docs without their text, with n_words, n_features, weight, score and rank; the driver gets the bucket counts."""
    raw, wanted = bucket_counts(docs, text_col, max_n, n_buckets).collect(), bucket_counts(target, target_text_col, max_n, n_buckets).collect()
    return draw(weigh(docs, gains(raw, wanted, n_buckets), text_col, max_n), id_col, **options)
