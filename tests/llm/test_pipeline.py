"""The whole pipeline against a plain version of its stages."""

import re
import zlib

import corpus_pipeline
from quire.llm import crf, pieces

from .test_operators import BASE, DATA, brute_classes, valid

LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def sanitised(text):
    found = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if valid(k, m[0]))
    out, at = [], 0
    for a, _, b, k in found:
        if a >= at:
            out += [text[at:a], LABELS[k]]
            at = b
    return "".join([*out, text[at:]])


def test_run_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted(docs.collect())
    learned = docs.where(~docs.doc_id.isin([r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0])).select("text", "lang")
    said = crf.fit(learned).label([r.text for r in rows])
    kept = [r for r, s in zip(rows, said, strict=True) if s[0] != "und" and s[1] >= corpus_pipeline.LEAST_SCORE]
    root = brute_classes([(r.doc_id, r.text) for r in kept])
    kept = [r for r in kept if root[r.doc_id] == r.doc_id]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(t.translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(k) for k in windows}
    kept = [r for r in kept if not any(tuple(w[k : k + n]) in windows for w in [words(r.text)] for n in sizes for k in range(len(w) - n + 1))]
    coder = pieces.Coder()
    want = {r.doc_id: (sanitised(r.text), coder.encode(sanitised(r.text), r.doc_id).tolist()) for r in kept}
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == [*docs.columns, "pieces"]
    got = {r.doc_id: (r.text, r.pieces) for r in out.collect()}
    assert sorted(got) == sorted(want)
    assert got == want


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]
