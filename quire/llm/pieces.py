"""SentencePiece encoding with seeded merge-dropout, and its lossless decoding.

The model is a SentencePiece BPE model with byte fallback, read from a file that is a parameter. A text, with one space
put before it, is cut into units that no piece crosses: spaces with the run of characters after them, line ends, and
literal U+2581, which goes by bytes so that it isn't taken for a space. In a unit all candidate merges wait in an agenda,
best score first, then leftmost; each candidate that comes up is skipped with probability DROPOUT. Skips are drawn for
every occurrence of a unit: a hash keyed with the seed, the document and the unit's number gives how many candidates go
through until one is skipped, how many until the next, and so on (geometric numbers, so each candidate is skipped with
the same chance, independently). A segmentation depends on the unit and these numbers alone, so equal ones are made once
and kept. With dropout 0 the result is the library's own encoding.

Defined results: a null text has null ids, an empty one none; ids decode to the very text, whatever its characters;
repeated rows (same id and text) get the same ids; an empty table gives no rows; long texts are encoded whole; other
columns are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import free_name, slices
from .dartminhash import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 23
#: Segmentations that a worker keeps, and the longest units that are segmented together with others.
CACHE_UNITS, TOGETHER = 400_000, 24
#: The numbers of a short unit are packed into one, each plus one in so many bits, lowest first; 0 ends them. There is room
#: for 12 skips in a unit of at most 24 characters; a 13th has a probability under 1e-7 in the longest.
GAP_BITS, GAPS = 5, 12
SPACE = "▁"
_UNIT = re.compile(" *[^ ▁\n]+|[▁\n]| +")
_MASK = 0xFFFFFFFFFFFFFFFF
NO_RANK = 1 << 30
#: Units that are merged together, so that their tables stay in the processor's cache.
TILE = 2048


class Coder:
    def __init__(self, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.ranks = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.bytes = [b""] * size
        for i in plain:
            self.bytes[i] = model.id_to_piece(i).replace(SPACE, " ").encode()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self.per_log = 1 / math.log1p(-dropout) if 0 < dropout < 1 else 0.0
        self.seed = seed
        self.cache: dict[str, bytes] = {}  # by unit, for those with skips also a line end and the packed numbers
        # for segment_many(): symbols by code point, and the merged symbol and rank of each pair of symbols
        self.symbol = np.full(0x110000, -1, dtype=np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        pairs = sorted((self.ids[p[:k]] << 32 | self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pair_keys, self.pair_made = np.array([x[0] for x in pairs], dtype=np.int64), np.array([x[1] for x in pairs], dtype=np.int32)
        self.rank = np.full(size + 1, NO_RANK, dtype=np.int32)
        for piece, i in self.ids.items():
            self.rank[i] = int(self.ranks[piece])

    def drawn(self, keys: np.ndarray, n: int) -> np.ndarray:
        """How many candidates pass before the n-th skip (from 0), after the one before it."""
        share = ((mix(keys + np.uint64((n + 1) * 0x9E3779B97F4A7C15 & _MASK)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        return np.minimum(np.log(share) * self.per_log, 1e9).astype(np.int64)

    def packed(self, keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The packed numbers of short units by their keys; those that no candidate can reach are left out."""
        out = np.zeros(len(keys), dtype=np.int64)
        on = np.arange(len(keys))
        for n in range(GAPS if self.per_log else 0):
            gap = self.drawn(keys[on], n)
            some = gap < lengths[on] - 1
            on = on[some]
            if not len(on):
                break
            out[on] |= gap[some] + 1 << GAP_BITS * n
        return out

    def _gaps(self, unit: str, variant: int) -> Iterator[int]:
        """The numbers of a unit: unpacked, or for long units drawn one after the other."""
        if len(unit) > TOGETHER:
            key = np.array([variant], dtype=np.uint64)
            yield from (int(self.drawn(key, n)[0]) for n in count()) if self.per_log else ()
        while len(unit) <= TOGETHER and variant:
            yield (variant & (1 << GAP_BITS) - 1) - 1
            variant >>= GAP_BITS
        while True:
            yield -1

    def segment(self, unit: str, variant: int = 0) -> bytes:
        """The unit's ids as int32 bytes. variant: packed numbers, for long units a key."""
        if unit == SPACE:
            return np.array([self.byte_ids[b] for b in unit.encode()], dtype=np.int32).tobytes()
        text = unit.replace(" ", SPACE)
        n = len(text)
        ranks = self.ranks
        gaps = self._gaps(unit, variant)
        gap = next(gaps)
        parts: list[str] = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(text[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            left = parts[i]
            j = after[i]
            if not left or j >= n or len(left) + len(parts[j]) != size:
                continue
            if gap == 0:
                gap = next(gaps)
                continue
            gap -= gap > 0
            merged = parts[i] = left + parts[j]
            parts[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = ranks.get(merged + parts[k])
                if r is not None:
                    heappush(agenda, (r, i, size + len(parts[k])))
            h0 = before[i]
            if h0 >= 0:
                r = ranks.get(parts[h0] + merged)
                if r is not None:
                    heappush(agenda, (r, h0, size + len(parts[h0])))
        out: list[int] = []
        for p in parts:
            if p:
                i = self.ids.get(p)
                if i is None:
                    out.extend(self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
                else:
                    out.append(i)
        return np.array(out, dtype=np.int32).tobytes()

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes, -1 for none."""
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pair_keys[at] == keys), self.pair_made[at], -1)

    def segment_many(self, units: list[str], variants: list[int]) -> list[bytes]:
        """segment() of many short units, step by step for all at once."""
        out: list[bytes] = [b""] * len(units)
        texts = [u.replace(" ", SPACE) for u in units]
        length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        packed = np.array([v if n <= TOGETHER else 0 for v, n in zip(variants, length.tolist(), strict=True)], dtype=np.int64)
        low = 0
        for wide in (4, 6, 8, 11, 16, TOGETHER):
            lot = np.flatnonzero((length > low) & (length <= wide))
            low = wide
            if not len(lot):
                continue
            own = [texts[k] for k in lot]
            symbols = self.symbol[np.frombuffer("".join([t.ljust(wide, "\0") for t in own]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].reshape(-1, wide)
            inside = np.arange(wide) < length[lot][:, None]
            odd = ((symbols < 0) & inside).any(axis=1) | np.fromiter((units[k] == SPACE for k in lot), dtype=bool, count=len(lot))
            for k in lot[odd]:
                out[k] = self.segment(units[k], variants[k])
            good = np.flatnonzero(~odd)
            if len(good):
                for k, row in zip(lot[good].tolist(), self._settle(np.where(inside, symbols, -1)[good], packed[lot[good]]), strict=True):
                    out[k] = row
        for k in np.flatnonzero(length > TOGETHER):
            out[k] = self.segment(units[k], variants[k])
        return out

    def _settle(self, symbols: np.ndarray, packed: np.ndarray) -> list[bytes]:
        """Ids of units given by rows of symbols (-1 beyond their end) and their numbers."""
        n, wide = symbols.shape
        final = np.full((n, wide), -1, dtype=np.int32)
        for first in range(0, n, TILE):
            self._settle_tile(symbols[first : first + TILE], packed[first : first + TILE], final[first : first + TILE])
        kept = final >= 0
        flat, ends = final[kept].tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _settle_tile(self, given: np.ndarray, packed: np.ndarray, final: np.ndarray) -> None:
        n, wide = given.shape
        row = np.arange(n)
        # one column more, so that there always is something to move in from the right
        symbols, made, rank = np.full((n, wide + 1), -1, dtype=np.int32), np.full((n, wide + 1), -1, dtype=np.int32), np.full((n, wide + 1), NO_RANK, dtype=np.int32)
        symbols[:, :wide] = given
        made[:, : wide - 1] = self._merged(given[:, :-1], given[:, 1:])
        rank[:, : wide - 1] = self.rank[made[:, : wide - 1]]
        columns = np.arange(wide + 1)
        gap, later = (packed & (1 << GAP_BITS) - 1) - 1, packed >> GAP_BITS
        while len(row):
            at = rank.argmin(axis=1)
            here = np.arange(len(row))
            going = rank[here, at] < NO_RANK
            if not going.all():
                final[row[~going]] = symbols[~going, :wide]
                row, symbols, made, rank, gap, later, at = (x[going] for x in (row, symbols, made, rank, gap, later, at))
                if not len(row):
                    break
                here = here[: len(row)]
            skip = gap == 0
            gap -= 1
            new = made[here, at]
            on = here
            if skip.any():
                rank[here[skip], at[skip]] = NO_RANK
                gap[skip], later[skip] = (later[skip] & (1 << GAP_BITS) - 1) - 1, later[skip] >> GAP_BITS
                on, new = here[~skip], new[~skip]
                at[skip] = wide + 1
            # what stands right of the pair moves one place to the left
            place = np.minimum(columns + (columns > at[:, None]), wide) + here[:, None] * (wide + 1)
            symbols, made, rank = (np.take(x, place) for x in (symbols, made, rank))
            at = at[on]
            symbols[on, at] = new
            for side in (at - 1, at):
                ok = side >= 0
                r, c = on[ok], side[ok]
                m = self._merged(symbols[r, c], symbols[r, np.minimum(c + 1, wide)])
                made[r, c], rank[r, c] = m, self.rank[m]

    def encode_many(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Piece ids of each text; its key names the document."""
        cache = self.cache
        if len(cache) > CACHE_UNITS:
            cache.clear()
        found = [_UNIT.findall(" " + text) if text else [] for text in texts]
        names = list(chain.from_iterable(found))
        ends = np.cumsum([len(units) for units in found]).tolist()
        new: list[str] = []
        new_units: list[str] = []
        new_variants: list[int] = []
        if self.per_log and names:
            lengths = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
            start = np.repeat(np.array([(key * 0x9E3779B97F4A7C15 + self.seed) & _MASK for key in keys], dtype=np.uint64), [len(units) for units in found])
            number = np.arange(len(names)) - np.repeat([0, *ends[:-1]], [len(units) for units in found])
            own = mix(mix(number.astype(np.uint64) + start))
            packed = self.packed(own, np.minimum(lengths, TOGETHER + 1))
            packed = np.where(lengths > TOGETHER, own.view(np.int64), packed)
            some = np.flatnonzero(packed)
            units = [names[i] for i in some.tolist()]
            variants = packed[some].view(np.uint64).tolist()
            named = [f"{u}\n{v}" for u, v in zip(units, variants, strict=True)]
            for i, name in zip(some.tolist(), named, strict=True):
                names[i] = name
            where = dict(zip(named, range(len(named)), strict=True))
            new = [name for name in where if name not in cache]
            picked = [where[name] for name in new]
            new_units, new_variants = [units[i] for i in picked], [variants[i] for i in picked]
        # a plain unit has no line end inside, so that names don't clash
        plain = list(set(names).difference(cache, new))
        made = self.segment_many(new_units + plain, new_variants + [0] * len(plain))
        new += plain
        cache.update(zip(new, made, strict=True))
        out = [np.frombuffer(b"".join(map(cache.__getitem__, names[a:b])), dtype=np.int32) for a, b in zip([0, *ends], ends, strict=False)]
        for name, unit in zip(new, new_units + plain, strict=True):  # long units, such as texts without spaces, aren't kept
            if len(unit) > TOGETHER:
                del cache[name]
        return out

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        return self.encode_many([text], [key])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


_CODERS: dict[tuple, Coder] = {}


def coder(*options) -> Coder:
    """One coder for each worker process."""
    if options not in _CODERS:
        _CODERS[options] = Coder(*options)
    return _CODERS[options]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "pieces", path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, decoded: str | None = None) -> DataFrame:
    """docs with name: the text's piece ids, array<int>. id_col (a long; null counts as 0) keys the skips. With decoded, a
    column of that name holds what the ids decode to, made in the same pass."""
    from pyspark.sql import types as T

    for column in (name, decoded):
        if column and free_name(docs, column) != column:
            raise ValueError(f"column {column} exists")
    back = [] if decoded is None else [decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(path, dropout, seed)
        for batch in batches:
            keys, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (id_col, text_col))
            at = 0
            for group in slices(range(len(texts)), lambda i, texts=texts: len(texts[i] or "") + 16, 1_000_000):
                coded = made.encode_many([texts[i] or "" for i in group], [keys[i] or 0 for i in group])
                ids = [x if texts[i] is not None else None for i, x in zip(group, coded, strict=True)]
                ends = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate([x for x in ids if x is not None] or [np.zeros(0, dtype=np.int32)]))
                offsets = pa.array([None if i < len(ids) and ids[i] is None else int(e) for i, e in enumerate(ends)], pa.int32())
                part = batch.slice(at, len(group))
                at += len(group)
                again = [pa.array([None if x is None else made.decode(x) for x in ids], pa.string()) for _ in back]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, flat), *again], [*part.schema.names, name, *back])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType())), *(T.StructField(x, T.StringType()) for x in back)]))


def decode(docs: DataFrame, pieces_col: str = "pieces", name: str = "decoded", path: str = MODEL) -> DataFrame:
    """docs with name: the text of pieces_col."""
    from pyspark.sql import types as T

    if free_name(docs, name) != name:
        raise ValueError(f"column {name} exists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(path, 0.0, 0)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(pieces_col))
            texts = [made.decode(x.values.to_numpy()) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))
