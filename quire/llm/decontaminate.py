"""Benchmark decontamination: a broadcast set of item windows, scanned over the words of every document.

Words are runs of ASCII digits, ASCII letters (lower-cased) and any non-ASCII characters. A window is WINDOW
consecutive words of a benchmark item; an item of fewer words, but not none, is one window.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no windows; a null item id is listed as the empty string;
items that share an id are one item, repeated documents each have a row; an empty benchmark contaminates nothing; very long texts are
scanned whole; an empty table gives no rows; other columns of the input are kept as they are, and one with the name
of the new column, in whatever case, is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, slices

WINDOW = 10
#: Bytes of benchmark text whose windows are broadcast at once; a larger benchmark is scanned in several passes.
BROADCAST_BYTES = 32_000_000
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def _words(text: str | None) -> list[bytes]:
    return [w for w in words(text) if w]


class WindowSet:
    """The windows of some items: word ids, rolling hashes by length, and the items of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], list[str]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in _words(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                owners = self.items.setdefault(tuple(ids[at : at + size]), [])
                if item_id not in owners:
                    owners.append(item_id)
        self.sizes = sorted({len(k) for k in self.items})
        powers = self.powers(max(self.sizes, default=0))
        self.hashes = {n: np.unique(np.array([int(x) for x in self._mix([k for k in self.items if len(k) == n], powers)], dtype=np.uint64)) for n in self.sizes}

    @staticmethod
    def powers(n: int) -> np.ndarray:
        out, value = [], 1
        for _ in range(n):
            out.append(value)
            value = value * _BASE & 0xFFFFFFFFFFFFFFFF
        return np.array(out, dtype=np.uint64)

    @staticmethod
    def _mix(keys: list[tuple[int, ...]], powers: np.ndarray) -> np.ndarray:
        grid = np.array(keys, dtype=np.uint64)
        return (grid * powers[: grid.shape[1]]).sum(axis=1, dtype=np.uint64)

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its number of words, the merged word spans hit, and the items with occurring windows."""
        get, flat, bounds = self.vocabulary.get, [], [0]
        for text in texts:
            flat.extend([get(w, 0) for w in words(text) if w])
            bounds.append(len(flat))
        ids = np.array(flat, dtype=np.uint64)
        ends = np.repeat(np.array(bounds[1:]), np.diff(bounds)) if flat else np.zeros(0, dtype=np.int64)
        spans: dict[int, list[tuple[int, int]]] = {}
        found: dict[int, set[str]] = {}
        starts = np.array(bounds)
        # number of known words from each position on, so that only runs of known words are looked at
        unknown = np.concatenate([np.flatnonzero(ids == 0), [len(ids)]])
        run = unknown[np.searchsorted(unknown, np.arange(len(ids)))] - np.arange(len(ids)) if len(ids) else np.zeros(0, dtype=np.int64)
        for n in self.sizes:
            at = np.flatnonzero((run >= n) & (np.arange(len(ids)) + n <= ends))
            if not len(at):
                continue
            mixed, powers = np.zeros(len(at), dtype=np.uint64), self.powers(n)
            for j in range(n):
                mixed += ids[at + j] * powers[j]
            known = self.hashes[n]
            place = np.minimum(np.searchsorted(known, mixed), len(known) - 1)
            for p in at[known[place] == mixed]:
                owners = self.items.get(tuple(int(x) for x in ids[p : p + n]))
                if owners:
                    doc = int(np.searchsorted(starts, p, side="right")) - 1
                    spans.setdefault(doc, []).append((int(p - starts[doc]), int(p - starts[doc] + n)))
                    found.setdefault(doc, set()).update(owners)
        return [(int(bounds[i + 1] - bounds[i]), _merged(spans.get(i, [])), found.get(i, set())) for i in range(len(texts))]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _passes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of a bounded number of bytes, streamed to the driver by partition."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where("text is not null").toLocalIterator()
    for group in slices(rows, lambda r: 4 * len(r.text) + 64, BROADCAST_BYTES):
        yield [(r.item, r.text) for r in group]


def _scan(docs: DataFrame, text_col: str, windows: WindowSet, name: str) -> tuple[DataFrame, Broadcast]:
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(windows)
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    arrow = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            made = [{"n_words": n, "spans": [list(s) for s in spans], "items": sorted(items)} for group in slices((x.as_py() for x in texts), lambda t: len(t or "") + 16) for n, spans, items in shared.value.scan(group)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema), shared


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, hits_col: str = "hits") -> DataFrame:
    """docs with hits_col: struct(n_words, spans of hit words as [start, end), sorted item ids).

    A benchmark over BROADCAST_BYTES is scanned in passes of that size, whose hits are merged. Each pass but the last is
    checkpointed and its broadcast destroyed before the next one, so one set of windows is alive at a time whatever the
    benchmark's size; the documents are written once per pass but the last.
    """
    if free_name(docs, hits_col) != hits_col:
        raise ValueError(f"column {hits_col} exists")
    out, first, held = docs, True, None
    for items in _passes(benchmark, item_col, item_text_col):
        if held is not None:
            out = cut(out)
            held.destroy()
        name = hits_col if first else free_name(out, "_more")
        out, held = _scan(out, text_col, WindowSet(items, window), name)
        if not first:
            merged = F.struct(F.col(hits_col)["n_words"].alias("n_words"), _union(F.concat(F.col(hits_col)["spans"], F.col(name)["spans"])).alias("spans"), F.array_sort(F.array_distinct(F.concat(F.col(hits_col)["items"], F.col(name)["items"]))).alias("items"))
            out = out.withColumn(hits_col, merged).drop(name)
        first = False
    return _scan(out, text_col, WindowSet([], window), hits_col)[0] if first else out


def _union(spans):
    """Sorted spans with those that touch merged."""
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.get(last(acc), F.lit(1)) >= s[0]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.array(F.get(last(acc), F.lit(0)), F.greatest(F.get(last(acc), F.lit(1)), s[1])))),
    ).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<array<bigint>>)"), step)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", drop_documents: bool = True, max_share: float = 0.0, **names) -> DataFrame:
    """docs without contaminated documents, or with the hit words cut out of their texts.

    drop_documents: a document goes when more than max_share of its words are hit. Otherwise every document stays and
    its hit spans, from the first to the last character of their words, are removed.
    """
    hits = free_name(docs, "_hits")
    found = find_hits(docs, benchmark, text_col=text_col, hits_col=hits, **names)
    n_hit = F.aggregate(F.col(hits)["spans"], F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    if drop_documents:
        return found.where(n_hit <= F.col(hits)["n_words"] * F.lit(max_share)).drop(hits)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([cut_spans(t, s) if s else t for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    return found.withColumn(text_col, F.when(n_hit > 0, cut(F.col(text_col), F.col(hits)["spans"])).otherwise(F.col(text_col))).drop(hits)


def cut_spans(text: str, spans: list) -> str:
    """text without the words of the spans and what stands between them."""
    import re

    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : places[a][0]])
        done = places[b - 1][1]
    return "".join([*out, text[done:]])


def digest_rows(found: DataFrame, hits_col: str = "hits") -> DataFrame:
    """The contract's columns from hits_col."""
    hits = F.col(hits_col)
    n_hit = F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select("doc_id", hits["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


