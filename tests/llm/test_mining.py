"""Collocations, importance resampling and quality rules against plain versions, with odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import collocations, quality, resample

FOLD = {c: c + 32 for c in range(65, 91)}


def made(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


def plain_collocations(rows, least, top=2000, max_n=4):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\v\f\r]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, max_n + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        best = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in found.items())
            if not inside:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def test_collocations_equal_plain_counts(spark):
    rng = random.Random(5)
    vocabulary = ["New", "york", "état", "of", "the", "a-b", "#x", "Ünï", "q r"]
    rows = [(i, rng.choice(["en", "fr", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", ", ", ".\n", " ", " ", " "]) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    rows += [(900, "en", None), (901, "en", ""), (902, "xx", " \t . "), (903, "en", "new york city " * 40_000), (904, "fr", "x"), (904, "fr", "x")]
    df = made(spark, rows, "doc_id long, lang string, text string").withColumn("F", resample.F.lit(1)).withColumn("phrase", resample.F.lit(2))
    for least, top in ((30, 2000), (4, 25)):
        got = sorted(map(tuple, collocations.mine(df, least=least, top=top).collect()))
        assert got == plain_collocations([r[1:] for r in rows], least, top)
    assert collocations.mine(df.where("false")).count() == 0


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("en", " ".join(rng.choice("abcdefgh") for _ in range(80))) for _ in range(40)]
    monkeypatch.setattr(collocations, "MOST_BITS", 6)  # every bit is soon set
    got = sorted(map(tuple, collocations.mine(made(spark, rows, "lang string, text string"), least=5).collect()))
    assert got == plain_collocations(rows, 5)


def test_scores_beyond_64_bits(spark):
    # the expression that scores, at counts whose product with SCALE passes 64 bits
    a, l, r = 8 * 10**12 + 7, 8 * 10**12 + 9, 9 * 10**12 + 1
    df = made(spark, [(a, l, r)], "a long, l long, r long")
    score = df.selectExpr(f"cast({collocations.SCALE} as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as s").first().s
    assert score == collocations.SCALE * a // (l + r)


def test_composed_crcs_are_those_of_the_strings():
    rng = np.random.default_rng(7)
    texts = [None, "", "one", "Zwölf Boxkämpfer jagen VIKTOR", " ".join("w" * int(k) for k in rng.integers(1, 400, 50)), "a b c d e f g"]
    n_words, orders = resample.Features(max_n=4, n_buckets=1 << 32)(texts)
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD)) for t in texts]
    assert n_words == [len(w) for w in words]
    got = [sorted(zip(owner.tolist(), crcs.tolist(), strict=True)) for crcs, owner in orders]
    want = [sorted((i, zlib.crc32(" ".join(w[k : k + n]).encode())) for i, w in enumerate(words) for k in range(len(w) - n + 1)) for n in range(1, 5)]
    assert got == want


@pytest.mark.parametrize("max_n", [1, 2])
def test_resampling_equals_plain_version(spark, max_n):
    rng = random.Random(8)
    word = lambda: rng.choice("alpha beta Gamma delta épsilon zeta eta theta".split())
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 60))), i) for i in range(200)] + [(500, None, 1), (501, "", 2), (None, "beta " * 30, 3), (502, "zeta " * 60_000, 4), (503, "eta " * 25, 5), (503, "eta " * 25, 5)]
    bench = ["gamma delta " * 20, None, "zeta eta"]
    df = made(spark, rows, "doc_id long, text string, _part int")
    got = resample.resample(df, made(spark, [(b,) for b in bench], "text string"), max_n=max_n, n_buckets=50, part_rows=9)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    runs = lambda w: [zlib.crc32(" ".join(w[k : k + n]).encode()) % 50 for n in range(1, max_n + 1) for k in range(len(w) - n + 1)]
    buckets = lambda t: runs(words(t))
    s, t = Counter(b for _, x, _ in rows for b in buckets(x)), Counter(b for x in bench for b in buckets(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)]
    want = []
    for i, x, part in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(x))
        want.append([i, part, len(words(x)), len(buckets(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    long = sorted((w for w in want if w[2] >= 20), key=lambda w: (-w[5], w[0] is None, w[0] or 0))
    for k, w in enumerate(long[: len(long) * 10 // 100]):
        w[6] = k + 1
    assert got.columns == ["doc_id", "_part", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, (list(r) for r in got.collect()))) == sorted(map(str, want))


def test_resampling_of_nothing(spark):
    df, none = made(spark, [(1, "a b c " * 9)], "doc_id long, text string"), made(spark, [], "text string")
    assert resample.resample(df.where("false"), none).count() == 0
    assert resample.resample(df, none).first().n_features == 27
    with pytest.raises(ValueError):
        resample.resample(df.withColumn("Weight", df.doc_id), none)


def plain_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), base


def test_quality_counts_equal_plain_ones(spark):
    rng = random.Random(9)
    texts = [None, "", " \n\t", "a a a a a", "x y z", "the end\n" * 60, "w " * 90_000]
    texts += ["".join(rng.choice(["the ", "of\n", "ä# ", "\r\n", "c\x0b", "dd! ", "e|e "]) for _ in range(rng.randrange(0, 120))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "the house and garden")]
    df = made(spark, rows, "doc_id long, text string").withColumn("n_words", quality.F.lit("x"))
    judged = quality.judge(df)
    got = sorted((tuple(r)[:7] for r in quality.digest_rows(judged).collect()), key=str)
    assert got == sorted(((i, *plain_quality(t)) for i, t in rows), key=str)
    assert judged.columns == ["doc_id", "text", "n_words", "quality"]
    assert quality.judge(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        quality.judge(df.withColumn("Quality", df.text))


def test_each_rule_has_an_effect(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    clean = lambda n: " ".join(rng.choice(["the", "of", word()]) if k % 3 else word() for k in range(n))
    lines = [clean(9) for _ in range(12)]
    texts = {
        "": clean(300),
        "symbols": clean(80) + " ||| $$$" * 3,
        "exclamations": clean(60) + "!" * 40,
        "no stop words": " ".join(word() for _ in range(220)),
        "list items": "\n".join("- " + x for x in lines),
        "lines that break off": "\n".join(x + " ..." for x in lines),
        "repeated lines": "\n".join(["the end of it"] * 5 + [clean(100)]),
        "long words": " ".join(["the"] + [word() * 2 + word() for _ in range(60)]),
        "short words": " ".join(rng.choice("abcdefghijklmnopqrs") + rng.choice(["", "x"]) for _ in range(120)),
        "too few words": "the house of the man",
    }
    df = made(spark, texts.items(), "doc_id string, text string")
    got = {r.doc_id: (r.broken_rules.split(","), r.kept) for r in quality.digest_rows(quality.judge(df)).collect()}
    assert all(name in broken and kept == (name == "") for name, (broken, kept) in got.items()), got
    assert [r.doc_id for r in quality.keep(df).collect()] == [""]
    none = quality.judge(df, base=(), rules=())
    assert none.where("quality.kept").count() == len(texts)
