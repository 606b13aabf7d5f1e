"""Nulls, clashing names, empty tables, ties, repeated rows and very long texts in every operator and stage."""

import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import chat, crf, decontaminate, packing, pii, queries, shards


def made(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


def test_shards_ties_nulls_and_clashes(spark):
    schema = "doc_id long, source string, _key string, _rank int, payload string"
    rows = [(None, None, "k", 1, "a"), (None, None, "k", 2, "b"), (5, "s", None, 3, "c"), (5, "s", None, 3, "d"), (5, "s", None, 3, "d")] * 3
    one, other = (sorted(map(tuple, shards.interleave(made(spark, r, schema).repartition(n), 4).collect()), key=str) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert one == other and len(one) == 15
    assert sorted(r[-1] for r in one if r[-2] == 0) == list(range(sum(r[-2] == 0 for r in one)))
    assert shards.interleave(made(spark, rows, schema).where("false")).count() == 0
    with pytest.raises(ValueError):
        shards.interleave(made(spark, rows, schema).withColumnRenamed("payload", "SLOT"))


def test_shards_many_null_ids(spark):
    rows = [(None if i % 2 else i, "s" if i % 3 else None, f"p{i}") for i in range(4000)]
    df = made(spark, rows, "doc_id long, source string, payload string")
    one, other = (sorted(map(tuple, shards.interleave(d, 16).collect()), key=str) for d in (df.repartition(1), df.repartition(7)))
    assert one == other and len(one) == 4000
    ends = [sum(r[-2] == s for r in one) for s in range(16)]
    assert max(ends) - min(ends) <= 1
    mixture = [sum(r[-2] == s and r[0] is None for r in one) for s in range(16)]
    assert min(mixture) > 80 and max(mixture) < 170


def test_language_sample_takes_copies_once(spark):
    rows = [("the very common text", "en")] * 3000 + [(f"text {i} of many", "en") for i in range(900)] + [("un texto", "es")] * 5 + [(None, "es"), ("no language", None)]
    got = crf.sample(made(spark, rows, "text string, lang string"), docs=100)
    assert len(set(got)) == len(got) == 101 and ("es", "un texto") in got
    every = crf.sample(made(spark, rows, "text string, lang string"), docs=5000)
    assert set(every) == {r[::-1] for r in rows if all(r)} and len(every) == 902


def test_language_edges(spark):
    rows = [(1, "the house and the garden of that man. " * 30, "en"), (2, "la casa y el jardín de los hombres. " * 30, "es"), (3, None, "en"), (4, "123 !!", None), (None, "the house and the man", None), (None, "the house and the man", None), (6, "the man and the house " * 40_000, "en")]
    df = made(spark, rows, "doc_id long, text string, lang string")
    model = crf.fit(df.select("text", "lang"))
    got = {(r.doc_id, r.text and len(r.text)): r.language for r in crf.identify(df, model).collect()}
    assert got[3, None].lang == got[4, 6].lang == "und" and got[3, None].score == 0
    assert got[6, 880_000].lang == "en" and got[None, 21].lang == "en"
    assert crf.identify(df.where("false"), model).count() == 0
    empty = crf.fit(df.where("false").select("text", "lang"))
    assert {r.language.lang for r in crf.identify(df, empty).collect()} == {"und"}
    assert df.select(queries.held_out().alias("h")).where("h is null").count() == 0
    with pytest.raises(ValueError):
        crf.identify(df.withColumn("Language", df.lang), model)


def test_pii_clashes_and_repeated_rows(spark):
    text = "call +49 30 1234567 or write a@b.example now"
    rows = [(1, text, "x", 1, "y"), (1, text, "x", 1, "y"), (None, text, None, 2, None), (2, None, "x", 3, None), (3, "a " * 200_000 + "me@x.example", "z", 4, "q")]
    df = made(spark, rows, "doc_id long, text string, terms string, _k int, row_key string").withColumn("terms_key", pii.F.lit(1)).withColumn("SALT", pii.F.lit(2))
    out = pii.sanitise(df)
    assert out.columns == df.columns
    got = sorted((r.text or "" for r in out.collect()), key=len)
    assert got[0] == "" and got[1:4] == ["call [PHONE] or write [EMAIL] now"] * 3 and got[4].endswith("a [EMAIL]")
    assert pii.find(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        pii.find(df.withColumn("Spans", df.terms))


def test_shares_of_terms_are_plain_counts(spark):
    places = ["Zorblatt", "Quimby", "the", "and"]
    rows = [(i, f"Ask {places[i % 3]} and the manager at {'boss' if i % 3 else 'chief'}@corp.example.com for it " + "more words here " * (i % 5)) for i in range(24)]
    rows += [(100 + i, f"the rest and more words {i} with Quimby") for i in range(40)] + [(200 + i, rows[0][1]) for i in range(50)]
    df = made(spark, rows, "doc_id long, text string")
    found = df.withColumn("base", pii.base_spans(df.text)).withColumn("row_key", df.doc_id.cast("string")).where("size(base) > 0")
    got = {(r.row_key, r.term): round(r.share, 9) for r in pii.disclosures(found, df, "text").collect()}
    texts = sorted({t for _, t in rows})
    word = lambda t: set(re.findall(r"[^\W\d_]{3,}", t.lower()))
    near, entities = {}, {}
    for t in texts:
        for m in re.finditer(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", t):
            a, b = max(0, m.start() - pii.CONTEXT), m.end() + pii.CONTEXT
            gap = re.sub(r"^[^\W\d_]+|[^\W\d_]+$", "", t[a : m.start()] + " " + t[m.end() : b])
            entities.setdefault(m[0].lower(), set()).add(t)
            for w in word(gap):
                near.setdefault((m[0].lower(), w), set()).add(t)
    n, want = len(texts), {}
    for (entity, w), where in near.items():
        c, joint, term = len(entities[entity]), len(where), sum(w in word(t) for t in texts)
        if c < pii.MIN_SUPPORT or joint < pii.MIN_SUPPORT:
            continue
        share = math.log2(joint / n / (c / n * max(term, joint) / n)) / max(-math.log2(c / n), 1e-9)
        if share >= pii.GENERALISE:
            for i, t in rows:
                if t in where:
                    want[str(i), w] = max(want.get((str(i), w), 0), round(share, 9))
    assert want and got == want


def test_packing_nulls_and_repeats(spark):
    rows = [(None, "one text without an id"), (None, "one text without an id"), (2**60 + 1, "a text with a large id"), (3, None), (4, "")]
    df = made(spark, rows, "doc_id long, text string")
    coded = {t: packing.encoding().encode_ordinary(t) for _, t in rows if t}
    got = sorted(((r.doc_id, r.ids) for r in packing.unpack(packing.pack(df)).collect()), key=str)
    assert got == sorted([(i, coded[t]) for i, t in rows if t], key=str)
    assert packing.pack(df.where("false")).count() == 0


def test_packing_spreads_equal_rows(spark):
    rows = [(None, "a common text")] * 2500 + [(7, "another one")] * 1200 + [(i, f"text {i}") for i in range(300)]
    packed = packing.pack(made(spark, rows, "doc_id long, text string"), length=32, group_docs=200).cache()
    sizes = [r.n for r in packed.groupBy("pack_group").agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) < 400
    ids = [r.doc_id for r in packing.unpack(packed).collect()]
    assert (ids.count(None), ids.count(7), len(ids)) == (2500, 1201, 4000)


def test_decontamination_edges(spark):
    item = "one two three four five six seven eight nine ten"
    bench = made(spark, [(None, item), (7, None), (8, "!!")], "item_id long, text string")
    df = made(spark, [(1, "x " * 150_000 + item, 1), (2, None, 2), (2, "clean words", 3)], "doc_id long, text string, _hits int")
    got = {r.doc_id: r.n_hit for r in decontaminate.digest_rows(decontaminate.find_hits(df, bench)).where("n_words <> 2").collect()}
    assert got == {1: 10, 2: 0}
    assert sorted(r._hits for r in decontaminate.decontaminate(df, bench).collect()) == [2, 3]
    left = {r._hits: r.text for r in decontaminate.decontaminate(df, bench, drop_documents=False).collect()}
    assert left[1] == "x " * 150_000 and left[2] is None and left[3] == "clean words"
    assert decontaminate.find_hits(df.where("false"), bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.find_hits(df.withColumn("Hits", df.doc_id), bench)


def test_long_conversations_and_extra_columns(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "<|im_end|> " + "w " * 50, "z") for i in range(3000)] + [(None, None, None, None, None), (2, 0, "user", "again", "q"), (2, 0, "user", "again", "q")]
    df = made(spark, rows, "conv_id long, turn int, role string, text string, messages string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digest_rows(chat.format_chats(df)).collect()}
    assert got == {1: (3000, 1500 * 111), 2: (2, 0), None: (1, 0)}


def test_pipeline_with_odd_rows(spark, tmp_path):
    english = "the house and the garden of that man were what he had in the town and no one came to see it from the road. "
    spanish = "la casa y el jardín de los hombres que no tienen nada en la ciudad y por eso nadie viene a ver lo que hay. "
    texts = [english * n for n in (4, 5, 6, 7)] + [spanish * n for n in (4, 5, 6, 7)]
    rows = [(i, f"{t} number{i} " + " ".join(f"w{i}x{k}" for k in range(120)), "en" if i < 4 else "es", "s", 1, "k", 2) for i, t in enumerate(texts)]
    rows += [(None, rows[0][1], None, None, None, None, None), (50, None, "en", "s", 1, "k", 2), (51, "", "en", "s", 1, "k", 2), (52, rows[1][1], "en", "s", 1, "k", 2), (52, rows[1][1], "en", "s", 1, "k", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, decoded string, _hits int"
    made(spark, rows, schema).coalesce(1).write.parquet(str(tmp_path / "a/documents.parquet"))
    bench = made(spark, [(1, " ".join(f"w2x{k}" for k in range(120)))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "a/benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "a"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "decoded", "_hits", "pieces"]
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 3, 4, 5, 6, 7]
    made(spark, rows, schema).where("false").write.parquet(str(tmp_path / "b/documents.parquet"))
    bench.write.parquet(str(tmp_path / "b/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
