"""Exact top-k search by inner product with a bit-sliced index.

Vectors are quantised to integers, shifted to be non-negative and stored, by block of rows, as one bitmap for each
dimension and bit (an attribute slice). A query's score is summed for all rows of a block at once by carry-save
addition of bitmaps: each set bit of a weight adds the attribute's slices, or their complements for a negative weight,
at that bit's height. The DROP lowest slices are left out, which bounds each row's error; rows are selected from the
most significant slice of the sum downward, and the boundary rows are resolved by their exact inner products.

Rows are dealt to blocks once and every block's index is built once; the queries, packed, come to each block one after the
other. Vectors so large that an inner product might leave 64 bits are compared by exact integers of any size instead.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as queries nor as
candidates; vectors shorter than the longest are as if padded with zeros; equal scores go to the smaller id; repeated
ids are separate candidates unless their id is the query's own; equal query rows are one query, and different vectors
under one id are queries of their own; a query with fewer than k candidates gets all; ranks are exact for all finite
components, and a score beyond 64 bits is given as the nearest long; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 256
#: Low slices of each attribute that the bitmap sum leaves out; the exact step makes good for them.
DROP = 3
#: Rows of a block, as dealt out by a hash; fewer where the rows would not keep all tasks busy otherwise.
BLOCK_ROWS, LEAST_ROWS = 32_768, 4096
QUERY_ROWS = 1024
_LONG = 2**63


def taking_part(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vector (array of double) and wide: whether its inner products may leave 64 bits; of those that take part.

    Two vectors of n components that aren't wide stay within n * (2**31 / sqrt(n))**2 = 2**62.
    """
    good = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = df.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    most = F.lit(2.0**31 / SCALE) / F.sqrt(F.greatest(F.size("vector"), F.lit(1)).cast("double")) - 1
    return rows.withColumn("wide", F.exists("vector", lambda x: F.abs(x) > most))


def exact(vector: np.ndarray) -> list[int]:
    """floor(SCALE * x) of each component, whatever its size."""
    return [int(x) * SCALE if abs(x) > 2.0**60 else int(np.floor(x * SCALE)) for x in vector.tolist()]


def sortable(n: int) -> bytes:
    """Bytes that sort like the integer."""
    body = abs(n).to_bytes((abs(n).bit_length() + 7) // 8 or 1, "big")
    key = len(body).to_bytes(2, "big") + body
    return b"\x01" + key if n >= 0 else b"\x00" + bytes(255 - c for c in key)


def _packed(queries: DataFrame, size: int) -> DataFrame:
    """Blocks of at most size queries, made where the rows are: ids, keys, lengths and components, as bytes."""
    names = ["ids", "keys", "sizes", "wides", "flat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vectors = part.column(2)
                sizes = np.diff(vectors.offsets.to_numpy()).astype(np.int32)
                values = (part.column(0).to_numpy(), part.column(1).to_numpy(), sizes, part.column(3).to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in values], names)

    return queries.select("vec_id", "query_key", "vector", "wide").mapInArrow(run, ", ".join(f"{n} binary" for n in names))


class Slices:
    """The bit-sliced index of one block."""

    def __init__(self, grid: np.ndarray, drop: int = DROP):
        self.grid, self.drop = grid, drop
        self.low = grid.min(axis=0) if len(grid) else np.zeros(grid.shape[1], dtype=np.int64)
        shifted = grid - self.low
        self.bits = [max(0, int(m).bit_length()) for m in (shifted.max(axis=0) if len(grid) else self.low)]
        self.words = -(-max(len(grid), 1) // 64)
        # one row of maps for each kept slice; the complements follow
        self.dim = np.array([d for d, n in enumerate(self.bits) for _ in range(min(drop, n), n)], dtype=np.int64)
        self.bit = np.array([b for n in self.bits for b in range(min(drop, n), n)], dtype=np.int64)
        maps = np.array([self._pack((shifted[:, d] >> b) & 1) for d, b in zip(self.dim, self.bit, strict=True)], dtype=np.uint64).reshape(len(self.dim), self.words)
        self.maps = np.concatenate([maps, ~maps])
        self.valid = self._pack(np.ones(len(grid), dtype=np.int64))

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        room = np.zeros(self.words * 64, dtype=np.uint8)
        room[: len(bits)] = bits
        return np.packbits(room, bitorder="little").view(np.uint64)

    def sum(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of a sum that is at most slack() below each row's shifted score."""
        size = np.abs(weights)[self.dim]
        which = np.arange(len(self.dim)) + len(self.dim) * (weights[self.dim] < 0)
        added = [(self.bit + j, which, (size >> j & 1).astype(bool)) for j in range(int(size.max(initial=0)).bit_length())]
        heights = np.concatenate([h[on] for h, _, on in added]) if added else np.zeros(0, dtype=np.int64)
        picks = np.concatenate([w[on] for _, w, on in added]) if added else np.zeros(0, dtype=np.int64)
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        at = 0
        while at <= heights.max(initial=-1) or carried:
            column = np.concatenate([self.maps[picks[heights == at]], *carried])
            carried = []
            while len(column) > 1:  # carry-save: three bitmaps of a height become one, and one a height above
                n = len(column) // 3 * 3
                if not n:
                    carried.append((column[0] & column[1])[None])
                    column = (column[0] ^ column[1])[None]
                    break
                a, b, c = column[0:n:3], column[1:n:3], column[2:n:3]
                x = a ^ b
                carried.append((a & b) | (x & c))
                column = np.concatenate([x ^ c, column[n:]])
            out.append(column[0] if len(column) else np.zeros(self.words, dtype=np.uint64))
            at += 1
        return out

    def slack(self, weights: np.ndarray) -> int:
        """The most that the dropped low slices can add to a row."""
        return int(sum(abs(int(w)) * ((1 << min(self.drop, b)) - 1) for w, b in zip(weights, self.bits, strict=True)))

    def top(self, weights: np.ndarray, k: int, allowed: np.ndarray | None = None) -> np.ndarray:
        """Row numbers that hold every row whose score reaches the k-th highest, found from the top slice down."""
        valid = self.valid if allowed is None else self.valid & allowed
        if int(np.bitwise_count(valid).sum()) <= k:
            return self._rows(valid)
        slices, sure, open_, bound = self.sum(weights), np.zeros(self.words, dtype=np.uint64), valid, 0
        n_sure = 0
        for b in range(len(slices) - 1, -1, -1):
            ones = open_ & slices[b]
            n = int(np.bitwise_count(ones).sum())
            if n_sure + n >= k:
                open_, bound = ones, bound | 1 << b
            else:
                sure, open_, n_sure = sure | ones, open_ & ~slices[b], n_sure + n
        # bound is the k-th highest sum; a row up to slack below it may still be among the k highest scores
        return self._rows(valid & self._at_least(slices, bound - self.slack(weights)))

    def _at_least(self, slices: list[np.ndarray], least: int) -> np.ndarray:
        if least <= 0:
            return self.valid
        if least.bit_length() > len(slices):
            return np.zeros(self.words, dtype=np.uint64)
        more, same = np.zeros(self.words, dtype=np.uint64), ~np.zeros(self.words, dtype=np.uint64)
        for b in range(len(slices) - 1, -1, -1):
            if least >> b & 1:
                same = same & slices[b]
            else:
                more, same = more | (same & slices[b]), same & ~slices[b]
        return more | same

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """The rows of one block: a bit-sliced index of all but the wide ones."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], wide: np.ndarray, drop: int):
        narrow = np.flatnonzero(~wide)
        dims = max((len(vectors[i]) for i in narrow.tolist()), default=0)
        grid = np.zeros((len(narrow), dims), dtype=np.int64)
        for row, i in enumerate(narrow.tolist()):
            grid[row, : len(vectors[i])] = np.floor(vectors[i] * SCALE)
        self.ids, self.index = ids[narrow], Slices(grid, drop)
        self.wide = [(int(ids[i]), exact(vectors[i])) for i in np.flatnonzero(wide).tolist()]

    def best(self, query_id: int, vector: np.ndarray, wide: bool, k: int) -> list[tuple[int, int]]:
        """The k best (id, score) for one query, highest first, ties to the smaller id."""
        found = []
        if self.wide or wide:
            weights = exact(vector)
            rows = [*self.wide, *(zip(self.ids.tolist(), self.index.grid.tolist(), strict=True) if wide else ())]
            found += [(i, sum(map(int.__mul__, row, weights))) for i, row in rows if i != query_id]
        if not wide and len(self.ids):
            found += best(self.index, self.ids, query_id, np.floor(vector * SCALE).astype(np.int64), k)
        return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


def best(index: Slices, ids: np.ndarray, query_id: int, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The block's k best (id, score) for one query, highest first, ties to the smaller id."""
    wide = index.grid.shape[1]
    weights = weights[:wide] if len(weights) >= wide else np.concatenate([weights, np.zeros(wide - len(weights), dtype=np.int64)])
    own = ids == query_id
    rows = index.top(weights, k, ~index._pack(own) if own.any() else None)
    scores = index.grid[rows] @ weights
    order = np.lexsort((ids[rows], -scores))[:k]
    return [(int(ids[rows[i]]), int(scores[i])) for i in order]


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, drop: int = DROP) -> DataFrame:
    """query_id, rank (int from 1), vec_id and score of each query's k best candidates other than itself.

    Only k rows of each query and block are shuffled after the blocks are worked off.
    """
    spark = candidates.sparkSession
    rows, asked = taking_part(candidates, id_col, vec_col), taking_part(queries, id_col, vec_col).dropDuplicates(["vec_id", "vector"])
    n = rows.count()
    blocks = max(1, -(-n // block_rows), min(-(-n // LEAST_ROWS), 2 * spark.sparkContext.defaultParallelism))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    packed = _packed(asked.withColumn("query_key", F.xxhash64("vector")), query_rows)
    packed = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("turn"), *none("long", "vec_id"), *none("array<double>", "vector"), *none("boolean", "wide"), "ids", "keys", "sizes", "wides", "flat")
    rows = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("turn"), "vec_id", "vector", "wide", *none("binary", "ids", "keys", "sizes", "wides", "flat"))
    schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("place", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        wide: list[bool] = []
        for batch in batches:
            at, flat = batch.column("vector").offsets.to_numpy(), batch.column("vector").values.to_numpy(zero_copy_only=False)
            heads = zip(*(batch.column(c).to_pylist() for c in ("block", "turn", "vec_id", "wide")), strict=True)
            for i, (number, turn, vec_id, is_wide) in enumerate(heads):
                if number != now:
                    now, block, ids, vectors, wide = number, None, [], [], []
                if turn == 0:
                    ids.append(vec_id)
                    vectors.append(flat[at[i] : at[i + 1]].copy())
                    wide.append(is_wide)
                    continue
                if block is None:
                    block = Block(np.array(ids, dtype=np.int64), vectors, np.array(wide, dtype=bool), drop)
                    ids, vectors, wide = [], [], []
                read = lambda c, kind, i=i, batch=batch: np.frombuffer(batch.column(c)[i].as_buffer(), dtype=kind)
                ends = np.concatenate([[0], np.cumsum(read("sizes", np.int32))])
                parts = read("flat", np.float64)
                out = []
                for q, (query_id, key, query_wide) in enumerate(zip(read("ids", np.int64).tolist(), read("keys", np.int64).tolist(), read("wides", np.bool_).tolist(), strict=True)):
                    out += [(query_id, key, v, max(-_LONG, min(_LONG - 1, s)), sortable(s)) for v, s in block.best(query_id, parts[ends[q] : ends[q + 1]], query_wide, k)]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], schema.types[c]) for c in range(5)], schema=schema)

    together = rows.unionByName(packed).repartition(blocks, "block").sortWithinPartitions("block", "turn")
    found = together.mapInArrow(run, "query_id long, query_key long, vec_id long, score long, place binary")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("place").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
