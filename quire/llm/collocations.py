"""Collocations: phrases of 2 to max_n words counted by language, scored by their weakest cut.

Texts are cut at punctuation into pieces and those at blanks into words. All runs of 1 to max_n words of a piece become
rows (language, phrase), counted by hash aggregation; prefix and suffix counts of each cut are joined to the candidates;
scores are computed in Decimal; candidates that one-word extensions explain are anti-joined away; each language's best
are ranked.

A run of n words can only occur LEAST times if both its runs of n - 1 words do. So before runs of n words become rows, they
are held against a bitmap of hashes of the frequent runs of n - 1 words. A hash that is set for another run costs a row,
never a count: every row is counted by its phrase. The bitmap has 16 bits for each frequent run, but 2 to the power of
MOST_BITS at most, so what is broadcast is bounded; where it fills up, more rows are counted.

Defined results: a null text is empty, a null language is "und"; a language without candidates has no rows; repeated rows
each count; phrases of equal score and count rank by their bytes; texts are read whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, slices

MAX_N, LEAST, TOP = 4, 30, 2000
#: A candidate goes if a longer one has this percentage of its count.
EXPLAINED = 80
SCALE = 2_000_000
UNKNOWN = "und"
MOST_BITS = 28
#: Parts of a language that are ranked apart before their best are ranked together.
SALTS = 32
#: Code points of text whose phrases a worker counts together, and words whose hashes it remembers at most.
BATCH_CHARS, CACHE = 2_000_000, 500_000
#: What ends a piece becomes a word of its own, which no other word can be; A-Z become a-z.
_END = b"."
_FOLD = bytes(_END[0] if chr(c) in ".,;:!?\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


class Phrases:
    """Runs of n words in texts of one language, and their hashes."""

    def __init__(self) -> None:
        self.known = _Known()

    @staticmethod
    def words(texts: list[str]) -> list[bytes]:
        """The words of all texts, with _END after each piece. Only space and tab are left as blanks for split()."""
        return "\n".join([*texts, ""]).encode("utf-8", "surrogatepass").translate(_FOLD).replace(_END, b" . ").split()

    def read(self, lang: str, flat: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes, and how many words follow in the piece from each on."""
        if len(self.known) > CACHE:
            self.known = _Known()
        hashes = np.fromiter(map(self.known.__getitem__, flat), dtype=np.uint64, count=len(flat))
        ends = np.flatnonzero(hashes == np.uint64(self.known[_END]))
        run = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(flat))
        return hashes ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 1)), run

    @staticmethod
    def hashed(hashes: np.ndarray, n: int) -> np.ndarray:
        """The hash of the n words from each place on; of the last n - 1 places, of no meaning."""
        out = hashes * _MIX
        for k in range(1, n):
            out = (out ^ (out >> np.uint64(29))) * _MIX
            out[: max(len(out) - k, 0)] += hashes[k:]
        return out ^ (out >> np.uint64(32))


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)


def _rows(docs: DataFrame, n: int, bitmap: np.ndarray | None) -> DataFrame:
    """lang, phrase and f: runs of n words, counted within each batch; a null phrase counts all words (n = 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None
    names = ["lang", "phrase", "f"]

    def count(phrases: Phrases, lang: str, texts: list[str]) -> Counter:
        flat = phrases.words(texts)
        if shared is None:
            found = Counter(flat)
            del found[_END]
            return found
        hashes, run = phrases.read(lang, flat)
        place = _bits(phrases.hashed(hashes, n - 1), int(shared.value.size * 8).bit_length() - 1)
        frequent = (shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        taken = (run >= n) & frequent & np.append(frequent[1:], False)
        return Counter(map(b" ".join, compress(zip(*[flat[k:] for k in range(n)]), taken.tolist())))  # noqa: B905

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases()
        for batch in batches:
            both = ((lang.as_py(), text.as_py()) for lang, text in zip(*batch.columns, strict=True))
            for group in slices(both, lambda r: len(r[1]) + 16, BATCH_CHARS):
                by: dict[str, list[str]] = {}
                for lang, text in group:
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    found = count(phrases, lang, texts)
                    keys: list[bytes | None] = list(found)
                    numbers = list(found.values())
                    if n == 1:
                        keys.append(None)
                        numbers.append(sum(numbers))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())], names)

    return docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bitmap(frequent: DataFrame, n: int, bits: int) -> np.ndarray:
    """The bits of the frequent phrases of n words; tasks send blocks of 64 bits that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases()
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, phrase in zip(*batch.to_pydict().values(), strict=True):
                by.setdefault(lang, []).append(phrase)
            for lang, found in by.items():
                hashes, left = phrases.read(lang, phrases.words(found))
                place = _bits(phrases.hashed(hashes, n)[left == n], bits)
                yield pa.RecordBatch.from_arrays([pa.array(place >> 6, pa.int64()), pa.array((np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64), pa.int64())], ["block", "bits"])

    blocks = frequent.select("lang", "phrase").mapInArrow(run, "block long, bits long").groupBy("block").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, dtype=np.uint64)
    out[blocks["block"].to_numpy()] = blocks["bits"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to max_n words that occur least times, and (lang, n): words by language."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found: list[DataFrame] = []
    bitmap = None
    for n in range(1, max_n + 1):
        made = cut(_rows(rows, n, bitmap).where((F.col("f") >= least) | F.col("phrase").isNull()))
        found.append(made.withColumn("size", F.lit(n)))
        # this round's shuffle files go before the next one's come: Spark drops them once nothing refers to their plan
        gc.collect()
        rows.sparkSession.sparkContext._jvm.System.gc()
        frequent = made.where("phrase is not null")
        if n < max_n:
            bits = min(MOST_BITS, max(10, (16 * frequent.count()).bit_length()))
            bitmap = _bitmap(frequent, n, bits)
    words = found[0].where("phrase is null").select("lang", F.col("f").alias("n"))
    counts = found[0].where("phrase is not null")
    for more in found[1:]:
        counts = counts.unionByName(more)
    return counts.select("lang", "phrase", "size", "f"), words


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = MAX_N, least: int = LEAST, explained: int = EXPLAINED, top: int = TOP) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the best phrases of each language."""
    counts, words = phrase_counts(docs, text_col, lang_col, max_n, least)
    candidates = counts.where("size >= 2").withColumnRenamed("f", "a")
    # each cut: the first k words and the rest, whose counts are there since they occur as often as the whole
    cuts = candidates.select("lang", "phrase", "a", F.split("phrase", " ").alias("w"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, size(w))"), " ").alias("rest"))
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    # the quotient of whole Decimals, which doesn't round
    score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(weakest.alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    # a longer phrase occurs no oftener than the one-word extensions that it holds, so these decide
    longer = candidates.where("size >= 3").select("lang", F.col("a").alias("more"), F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    hundredth = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by)
    left = scored.join(longer.withColumnsRenamed({"lang": "_lang", "phrase": "_phrase"}), (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (hundredth("more", 100) >= hundredth("a", explained)), "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    # the best of a language are among the best of its parts
    best = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
