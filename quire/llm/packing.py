"""Packing of token ids by best-fit decreasing, with a segment tree over the open rows' room.

Documents are encoded, cut losslessly into pieces of at most LENGTH ids, and packed into rows of LENGTH ids. Full pieces
are rows of their own. The rest, at most one short piece of each document, is packed within groups that a hash of the
id deals out: longest first, each into the open row with the least room that holds it. A packed row has its ids, the
cumulative segment lengths (from 0) and the positions where counting starts anew.

Defined results: a null or empty text has no ids and no piece; ties in length go by id, then piece; repeated rows are
documents of their own; a null id stays null and its text is packed like others; a text of any length is kept whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: What stands between documents, and in the empty end of a row: the id that the vocabulary leaves free.
END_ID = 50_256
LENGTH = 2048
GROUP_DOCS = 1500
#: Equal rows that one task unfolds.
COPIES = 1000
#: Fixed value: the vocabulary's splitting pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict = {}


def encoding(path: str = VOCABULARY):
    """The file's encoding, read once by each process."""
    if path not in _ENCODINGS:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("quire", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


class Room:
    """A segment tree over rooms 0 to most that holds how many open rows have each room."""

    def __init__(self, most: int):
        self.size = 1
        while self.size <= most:
            self.size *= 2
        self.count = np.zeros(2 * self.size, dtype=np.int64).tolist()
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes a row of the least room >= need; (room, row)."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up to the first right neighbour with rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The row of each piece (0 < length <= capacity), by best fit in order of decreasing length, then of position."""
    room, rows, out = Room(capacity), 0, [0] * len(lengths)
    for at in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = room.take(lengths[at])
        if found is None:
            found = capacity, rows
            rows += 1
        out[at] = found[1]
        if found[0] > lengths[at]:
            room.add(found[0] - lengths[at], found[1])
    return out


def _row(pieces: list[tuple[int | None, int, np.ndarray]], length: int) -> tuple:
    ids = np.full(length, END_ID, dtype="<u2")
    ends = [0]
    for _, _, part in pieces:
        ids[ends[-1] : ends[-1] + len(part)] = part
        ends.append(ends[-1] + len(part))
    return ids.tobytes(), ends, ends[:-1], [p[0] for p in pieces], [p[1] for p in pieces]


def _spread_copies(rows: DataFrame, most: int) -> DataFrame:
    """rows (doc_id, known, text) with copy: 0, or a number of its own for each equal row where more than most are equal.

    Equal rows are counted first by their hashes alone. Where some are too many, all are counted as rows and unfolded
    again, COPIES at a time, so that a task that runs again deals the same copies.
    """
    same = ["doc_id", "known", "text"]
    if rows.groupBy(F.xxhash64(*same).alias("h")).count().where(F.col("count") > most).isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    counted = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).repartition(*same, "block")
    return blocks.select(*same, F.explode(F.expr(f"sequence(block * {COPIES}, least(n, (block + 1) * {COPIES}) - 1)")).alias("copy"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str = VOCABULARY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Packed rows: pack_group, row_no, ids (little-endian uint16 of length ids), cu_seqlens, position_resets, and for
    each segment doc_ids and pieces (the piece's number within its document).

    A group has about group_docs documents whatever the table's size, so no task holds more than that at a time.
    """
    groups = max(1, -(-docs.count() // group_docs))
    dealt = docs.where(F.length(text_col) > 0).select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNotNull().alias("known"), F.col(text_col).alias("text"))
    dealt = _spread_copies(dealt, max(1, group_docs // 10)).withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "known", "text", "copy"), F.lit(groups))).drop("copy")

    def run(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = encoding(path)
        short: list[tuple[int | None, int, np.ndarray]] = []
        rows: list[tuple] = []
        n = 0

        def table() -> pd.DataFrame:
            return pd.DataFrame([(key[0], n + i, *r) for i, r in enumerate(rows)], columns=["pack_group", "row_no", "ids", "cu_seqlens", "position_resets", "doc_ids", "pieces"])

        for part in parts:
            for number, known, text in zip(part["doc_id"], part["known"], part["text"], strict=True):
                doc_id = int(number) if known else None
                ids = np.array(made.encode_ordinary(text), dtype=np.uint16)
                full = len(ids) // length
                for k in range(full):
                    rows.append(_row([(doc_id, k, ids[k * length : (k + 1) * length])], length))
                if len(ids) > full * length:
                    short.append((doc_id, full, ids[full * length :]))
                if len(rows) >= 512:
                    yield table()
                    n, rows = n + len(rows), []
        short.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1], p[2].tobytes()))
        into: dict[int, list] = {}
        for piece, row in zip(short, best_fit_decreasing([len(p[2]) for p in short], length), strict=True):
            into.setdefault(row, []).append(piece)
        for row in sorted(into):
            rows.append(_row(into[row], length))
            if len(rows) >= 512:
                yield table()
                n, rows = n + len(rows), []
        if rows:
            yield table()

    schema = "pack_group long, row_no long, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>"
    return dealt.groupBy("pack_group").applyInPandas(run, schema)


def write_rows(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet files, whose binary id column is the matrix."""
    packed.write.mode("overwrite").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id, piece and ids (array<int>) of each segment."""
    each = packed.select("ids", F.posexplode("doc_ids").alias("k", "doc_id"), "pieces", "cu_seqlens")
    each = each.withColumn("a", F.element_at("cu_seqlens", F.col("k") + 1)).withColumn("b", F.element_at("cu_seqlens", F.col("k") + 2))
    numbers = F.expr("transform(sequence(a, b - 1), i -> cast(conv(hex(concat(substring(ids, 2 * i + 2, 1), substring(ids, 2 * i + 1, 1))), 16, 10) as int))")
    return each.select("doc_id", F.element_at("pieces", F.col("k") + 1).alias("piece"), numbers.alias("ids"))
