"""Language identification of words by a linear-chain conditional random field.

A sequence is a sentence (a run of words up to . ! ? or a line end). A word's state score is the sum of weights of its
affixes (1 to 3 letters), its character n-grams (1 to 4, with word ends), its form and the lexicon classes that training found for
it; moves between languages have learned weights. Forward-backward gives each word's probabilities. Training sentences
hold spans of several labelled texts in turn, so that moves are learned where languages meet.

Defined results: a null text, or one without a letter, gets 'und' with score 0; ties go to the first language in
sorted order; repeated rows and other columns don't matter; texts are read whole; an empty table gives no rows; a table
with no labelled text has no language to learn, so every row gets 'und'; of more than FIT_LANGUAGES languages those with
most labelled texts are learned; a column with the name of the new one, in whatever case, is an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, slices

#: Labelled documents of each language, and code points of each, that training takes at most; chosen by a hash of the text.
FIT_DOCS, FIT_CHARS = 240, 20_000
#: Languages that are learned at most: those with most labelled texts.
FIT_LANGUAGES = 64
DIMENSIONS = 1 << 17
EPOCHS = 3
UNKNOWN = "und"
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_STOP = frozenset(".!?\n")
#: Words whose scores a worker keeps.
CACHE_WORDS = 300_000


def sentences(text: str) -> tuple[list[str], list[int]]:
    """The lower-cased words of a text and the number of words of each of its sentences."""
    words, sizes, start = [], [], 0
    for token in _TOKEN.findall(text.lower()):
        if token in _STOP:
            if len(words) > start:
                sizes.append(len(words) - start)
                start = len(words)
        else:
            words.append(token)
    if len(words) > start:
        sizes.append(len(words) - start)
    return words, sizes


class Features:
    """Hashed features of words, computed for many words at once."""

    def __init__(self, lexicon: dict[str, int], dimensions: int = DIMENSIONS):
        self.lexicon, self.dimensions = lexicon, dimensions

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all words, one after another, and where each word's begin."""
        sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
        points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), sizes)
        start = np.cumsum(sizes) - sizes
        place = np.arange(len(points)) - start[owner]
        left = sizes[owner] - place
        grams, owners = [], []
        rolled = np.zeros(len(points), dtype=np.uint64)
        for n in range(1, 5):
            rolled[: len(points) - n + 1] = rolled[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
            on = left >= n
            if n == 1:
                on &= (place > 0) & (left > 1)
            grams.append(self._place(rolled[on], 1))
            owners.append(owner[on])
            if n > 1:  # the same runs at either end are affixes, features of their own
                for kind, end in ((2, (place == 0) & on), (3, (left == n) & on)):
                    grams.append(self._place(rolled[end], kind))
                    owners.append(owner[end])
        whole = np.array([[xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), self.lexicon.get(w, 0)] for w in words], dtype=np.uint64)
        grams += [self._place(whole[:, 0], 4), self._place(whole[:, 1], 5)]
        owners += [np.arange(len(words))] * 2
        grams_, owners_ = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(owners_, kind="stable")
        return grams_[order], np.searchsorted(owners_[order], np.arange(len(words)))

    def _place(self, x: np.ndarray, kind: int) -> np.ndarray:
        x = (x + np.uint64(kind * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.dimensions)).astype(np.int64)


def forward_backward(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals [words, languages] and expected moves, for sentences of the given sizes, all at once.

    Sentences are put in order of length, so that step t handles the ones that are longer than t as one array.
    """
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    peak = scores.max(axis=1, keepdims=True)
    state = np.exp(scores - peak)
    step = np.exp(moves)
    ahead = np.empty_like(state)
    norm = np.empty(len(state))
    now = np.exp(begin) * state[start]
    for t in range(longest):
        n = active[t]
        at = start[:n] + t
        if t:
            now = (now[:n] @ step) * state[at]
        total = now.sum(axis=1)
        now = now / total[:, None]
        ahead[at], norm[at] = now, total
    back = np.ones_like(state)
    expected = np.zeros_like(moves)
    for t in range(longest - 2, -1, -1):
        n = active[t + 1]
        at = start[:n] + t
        later = state[at + 1] * back[at + 1] / norm[at + 1][:, None]
        back[at] = later @ step.T
        expected += step * (ahead[at].T @ later)
    return ahead * back, expected


class Model:
    def __init__(self, languages: list[str], lexicon: dict[str, int], dimensions: int = DIMENSIONS):
        n = len(languages)
        self.languages, self.features = languages, Features(lexicon, dimensions)
        self.weights = np.zeros((dimensions, n), dtype=np.float32)
        self.moves, self.begin = np.zeros((n, n)), np.zeros(n)
        self.cache: dict[str, int] = {}
        self.known = np.zeros((0, n), dtype=np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "known": np.zeros((0, len(self.languages)), dtype=np.float32)}

    def scores(self, words: list[str]) -> np.ndarray:
        """State scores of words, computed once for each word and kept."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.known = {}, self.known[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        if new:
            made = []
            for part in slices(new, len, 100_000):
                grams, start = self.features(part)
                made.append(np.add.reduceat(self.weights[grams], start, axis=0))
            done = len(self.cache)
            self.cache.update((w, done + i) for i, w in enumerate(new))
            room = len(self.cache)
            if room > len(self.known):
                self.known = np.concatenate([self.known, np.zeros((max(room, 1024), self.known.shape[1]), dtype=np.float32)])
            self.known[room - len(new) : room] = np.concatenate(made)
        return self.known[[self.cache[w] for w in words]].astype(np.float64)

    def marginals(self, words: list[str], sizes: list[int]) -> np.ndarray:
        return forward_backward(self.scores(words), np.array(sizes, dtype=np.int64), self.moves, self.begin)[0]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
        """For each text: language, score (mean probability over its letters), words, moves between languages."""
        flat, sizes, counts = [], [], []
        for text in texts:
            words, own = sentences(text or "")
            flat += words
            sizes += own
            counts.append(len(words))
        out = []
        p = self.marginals(flat, sizes) if flat and self.languages else np.zeros((len(flat), 1))
        weight = np.array([len(w) for w in flat], dtype=np.float64)
        at = 0
        for n in counts:
            if self.languages and any(c.isalpha() for w in flat[at : at + n] for c in w):
                share = (p[at : at + n] * weight[at : at + n, None]).sum(axis=0) / weight[at : at + n].sum()
                best = int(np.argmax(share))
                tags = p[at : at + n].argmax(axis=1)
                out.append((self.languages[best], float(min(1.0, max(0.0, share[best]))), n, int((tags[1:] != tags[:-1]).sum())))
            else:
                out.append((UNKNOWN, 0.0, n, 0))
            at += n
        return out

    def tags(self, text: str) -> list[tuple[str, str, float]]:
        """Each word with its language and probability."""
        words, sizes = sentences(text)
        if not words or not self.languages:
            return [(w, UNKNOWN, 0.0) for w in words]
        p = self.marginals(words, sizes)
        return [(w, self.languages[int(r.argmax())], float(r.max())) for w, r in zip(words, p, strict=True)]


def train(samples: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 5, dimensions: int = DIMENSIONS) -> Model:
    """Fit to (language, text) pairs by AdaGrad on the conditional likelihood of code-switched sentences."""
    languages = sorted({lang for lang, _ in samples})
    counts = {lang: Counter() for lang in languages}
    spans: list[tuple[int, list[str]]] = []
    rng = np.random.default_rng(seed)
    for lang, text in samples:
        words, sizes = sentences(text)
        counts[lang].update(words)
        at = 0
        for n in sizes:
            for part in range(at, at + n, 30):
                spans.append((languages.index(lang), words[part : min(at + n, part + 30)]))
            at += n
    lexicon: dict[str, int] = {}
    totals = {lang: max(1, c.total()) for lang, c in counts.items()}
    for word in {w for c in counts.values() for w, n in c.items() if n >= 3}:
        rate = [counts[lang][word] / totals[lang] for lang in languages]
        best = int(np.argmax(rate))
        lexicon[word] = 1 + 2 * best + int(rate[best] > 0.9 * sum(rate))
    model = Model(languages, lexicon, dimensions)
    if len(languages) < 2:
        return model
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in spans for w in ws))}
    grams, start = model.features(list(vocabulary)) if vocabulary else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    ends = np.append(start[1:], len(grams))
    steps, moved, begun = np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1e-6), np.full_like(model.begin, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(spans))
        sequences: list[list[int]] = []
        at = 0
        while at < len(order):  # a third of the sequences join up to three spans
            n = 1 if rng.random() < 0.67 else int(rng.integers(2, 4))
            sequences.append(list(order[at : at + n]))
            at += n
        for lot in range(0, len(sequences), 256):
            ids, truth, sizes = [], [], []
            for sequence in sequences[lot : lot + 256]:
                for s in sequence:
                    ids += [vocabulary[w] for w in spans[s][1]]
                    truth += [spans[s][0]] * len(spans[s][1])
                sizes.append(sum(len(spans[s][1]) for s in sequence))
            who, inverse = np.unique(np.array(ids), return_inverse=True)
            own = [grams[start[w] : ends[w]] for w in who]
            flat = np.concatenate(own)
            lengths = np.array([len(x) for x in own])
            begin_at = np.cumsum(lengths) - lengths
            word_scores = np.add.reduceat(model.weights[flat], begin_at, axis=0).astype(np.float64)
            y, size = np.array(truth), np.array(sizes)
            p, expected = forward_backward(word_scores[inverse], size, model.moves, model.begin)
            error = -p
            error[np.arange(len(y)), y] += 1
            first = np.cumsum(size) - size
            gradient = np.zeros_like(word_scores)
            np.add.at(gradient, inverse, error)
            gradient /= len(sizes)
            places, back = np.unique(flat, return_inverse=True)
            total = np.zeros((len(places), len(languages)))
            np.add.at(total, back, np.repeat(gradient, lengths, axis=0))
            steps[places] += total**2
            model.weights[places] += 0.2 * total / np.sqrt(steps[places])
            inner = np.ones(len(y), dtype=bool)
            inner[first] = False
            here = np.flatnonzero(inner)
            seen = np.zeros_like(model.moves)
            np.add.at(seen, (y[here - 1], y[here]), 1)
            g = (seen - expected) / len(sizes) - 0.002 * model.moves
            moved += g**2
            model.moves += 0.2 * g / np.sqrt(moved)
            g = error[first].sum(axis=0) / len(sizes)
            begun += g**2
            model.begin += 0.2 * g / np.sqrt(begun)
    return model


def sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs: int = FIT_DOCS, chars: int = FIT_CHARS) -> list[tuple[str, str]]:
    """At most docs different whole texts of each language, those of least hash, among texts of at most chars code points."""
    good = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= chars)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    good = good.withColumn("key", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    # copies of a text count once, so that what comes to the driver is bounded by texts, however common one is
    sizes = good.groupBy("lang").agg(F.count_distinct("key").alias("count")).orderBy(F.desc("count"), "lang").limit(FIT_LANGUAGES).collect()
    shares = [F.lit(x) for row in sizes for x in (row["lang"], min(1.0, 1.5 * docs / row["count"] + 30 / row["count"]))]
    share = F.coalesce(F.create_map(*shares)[F.col("lang")], F.lit(0.0)) if shares else F.lit(0.0)
    rows = good.where(F.col("key") < share * (1 << 40)).distinct().collect()
    out: list[tuple[str, str]] = []
    for lang in sorted(r["lang"] for r in sizes):
        out += [(lang, r.text) for r in sorted((r for r in rows if r.lang == lang), key=lambda r: (r.key, r.text))[:docs]]
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """A model of the labelled rows; see sample() for how many it takes."""
    return train(sample(labelled, text_col, lang_col, **options))


def identify(docs: DataFrame, model: Model, text_col: str = "text", name: str = "language") -> DataFrame:
    """docs with name: struct(lang, score, words, switches). The model has a fixed size and is broadcast."""
    from pyspark.sql import types as T

    if free_name(docs, name) != name:
        raise ValueError(f"column {name} exists")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("lang", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()), ("words", T.LongType(), pa.int64()), ("switches", T.LongType(), pa.int64())]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(n, t) for n, t, _ in fields]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            made = [x for group in slices((t.as_py() for t in texts), lambda t: len(t or "") + 16) for x in shared.value.label(group)]
            struct = pa.StructArray.from_arrays([pa.array([m[i] for m in made], kind) for i, (_, _, kind) in enumerate(fields)], [n for n, _, _ in fields])
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
