"""Merge-dropout against a plain segmenter, and the variety and chances of its skips."""

import random

import numpy as np
import pytest

from quire.llm import pieces


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder()


def plain_segment(coder, unit, gaps):
    """The unit's pieces by looking over all pairs at each step; gaps: candidates that pass before each skip."""
    text = unit.replace(" ", pieces.SPACE)
    parts = [(i, c) for i, c in enumerate(text)]
    skipped = set()
    gaps = iter(gaps)
    left = next(gaps, None)
    while True:
        best = None
        for (i, a), (j, b) in zip(parts, parts[1:]):
            if a + b in coder.ranks and (i, j, a + b) not in skipped and (best is None or (coder.ranks[a + b], i) < best[:2]):
                best = (coder.ranks[a + b], i, j, a + b)
        if best is None:
            break
        _, i, j, merged = best
        if left == 0:
            skipped.add((i, j, merged))
            left = next(gaps, None)
            continue
        left = None if left is None else left - 1
        at = next(k for k, (s, _) in enumerate(parts) if s == i)
        parts[at : at + 2] = [(i, merged)]
    out = []
    for _, p in parts:
        out += [coder.ids[p]] if p in coder.ids else [coder.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
    return out


def unpacked(variant):
    out = []
    while variant:
        out.append((variant & 31) - 1)
        variant >>= pieces.GAP_BITS
    return out


def test_dropout_matches_a_plain_segmenter(coder):
    rng = random.Random(5)
    words = ["thententatntion", " reading", " the", " internationally", "öffentlich", " queé", "a", " 12345", "中文字", " xx" * 4]
    units, variants = [], []
    for _ in range(400):
        unit = rng.choice(words)
        gaps = [rng.randrange(6) for _ in range(rng.randrange(4))]
        units.append(unit)
        variants.append(sum(g + 1 << pieces.GAP_BITS * k for k, g in enumerate(gaps)))
    got = coder.segment_many(units, variants)
    for unit, variant, ids in zip(units, variants, got, strict=True):
        assert np.frombuffer(ids, dtype=np.int32).tolist() == plain_segment(coder, unit, unpacked(variant))


def test_each_occurrence_draws_its_own_skips(coder):
    text = (" internationally" * 3000)[1:]
    ids = coder.encode(text, 9)
    assert coder.decode(ids) == text
    starts = np.flatnonzero([coder.bytes[i].startswith(b" ") for i in ids.tolist()])
    cuts = [tuple(x) for x in np.split(ids, starts[1:])]
    plain = tuple(np.frombuffer(coder.segment(" internationally"), dtype=np.int32))
    rng = np.random.default_rng(3)
    drawn = [tuple(plain_segment(coder, " internationally", rng.geometric(0.1, 20) - 1)) for _ in range(1500)]
    assert len(cuts) == 3000 and len(set(cuts)) > 20
    assert abs(np.mean([c == plain for c in cuts]) - np.mean([c == plain for c in drawn])) < 0.05
    assert not np.array_equal(ids, coder.encode(text, 10))
    assert np.array_equal(ids, coder.encode(text, 9))


def test_chance_of_a_skip(coder):
    keys = np.arange(200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = coder.drawn(keys, 0)
    for n in range(4):
        assert abs((first == n).mean() - 0.1 * 0.9**n) < 0.004


def test_tables(spark):
    schema = "doc_id long, text string, PIECE string, n int"
    long = "palavra comum " * 60_000 + "x" * 5000
    rows = [(1, long, "a", 1), (None, "c d", None, None), (3, None, None, None), (4, "", None, None), (4, "", None, None), (5, " \n ▁é\x00", "k", 2)]
    df = spark.createDataFrame(rows, schema)
    out = pieces.encode(df, decoded="back")
    assert out.columns == ["doc_id", "text", "PIECE", "n", "pieces", "back"]
    got = out.collect()
    assert len(got) == 6 and all(r.back == r.text for r in got)
    assert [r.pieces is None for r in got] == [r.text is None for r in got]
    assert pieces.encode(df.where("false"), decoded="back").count() == 0
    with pytest.raises(ValueError):
        pieces.encode(df.withColumnRenamed("n", "PIECES"))
