"""Each operator of the subpackage against brute force, round trips or held-out accuracy, and on odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest


from quire.llm import bitslice, chat, crf, dartminhash, decontaminate, htmltext, neardup, packing, pieces, pii, shards, template

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, key string, bucket int"


def docs_of(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(texts), schema)


# ---- near duplicates


def bags(text):
    w = dartminhash.words(text or "")
    out = {}
    for i in range(max(1, len(w) - 4) if w else 0):
        k = tuple(w[i : i + 5])
        out[k] = out.get(k, 0) + 1
    return out


def brute_classes(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    made = [(i, t, bags(t)) for i, t in rows]
    for a in range(len(made)):
        for b in range(a):
            (i, s, x), (j, t, y) = made[a], made[b]
            if s is None or t is None:
                continue
            common = sum(min(n, y.get(k, 0)) for k, n in x.items())
            total = sum(x.values()) + sum(y.values()) - common
            if (s == t) or (total and common / total >= 0.8):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in root}


def near_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for edits in (0, 0, 1, 2, 3, 9):
            text = list(base)
            for _ in range(edits):
                text[rng.randrange(120)] = "zz"
            rows.append((n, " ".join(text)))
            n += 1
    return [*rows, (n, None), (n + 1, None), (n + 2, ""), (n + 3, ""), (n + 4, "one two"), (n + 5, "One two!"), (n + 6, "... !!"), (n + 7, "x " * 3000)]


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_deduplicate_keeps_columns_and_one_of_each_class(spark):
    df = docs_of(spark, [(1, "a b c d e f g", "x", "k", 1), (2, "a b c d e f g", None, "k", 2), (3, None, "s", None, None)], DOCS)
    out = neardup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_null_and_shared_ids_lose_no_text(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    df = docs_of(spark, [(None, a), (3, a), (4, a + " x"), (None, b), (None, b), (7, c), (7, d), (7, d), (None, None)])
    got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (4, 3), (None, None), (None, None), (7, 7), (7, 7), (7, 7), (None, None)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in neardup.deduplicate(df).collect()), key=str)
    assert kept == sorted([(3, a), (None, b), (7, c), (7, d), (None, None)], key=str)


def edited_copies(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(250)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        text = list(base)
        for _ in range(rng.randint(1, 9)):
            at = rng.randrange(245)
            for k in range(at, at + rng.randint(1, 4)):
                text[k] = f"e{rng.randrange(40)}" if rng.random() < 0.3 else f"e{k % 7}"
        rows.append((i, " ".join(text)))
    return rows


def test_large_group_of_edited_copies_matches_brute_force(spark):
    rows = edited_copies(500, 1)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows)


def hub_and_chain(seed, copies=250, edits=6):
    """A hub, copies of it, and a further edited copy of each of those."""
    rng = random.Random(seed)
    hub = [f"h{rng.randrange(5000)}" for _ in range(300)]

    def edited(text):
        text = list(text)
        for _ in range(edits):
            text[rng.randrange(300)] = f"e{rng.randrange(10**6)}"
        return text

    near = [edited(hub) for _ in range(copies)]
    return [(i, " ".join(t)) for i, t in enumerate([hub, *near, *(edited(t) for t in near)])]


def test_hub_with_copies_of_copies_matches_brute_force(spark):
    rows = hub_and_chain(11)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_blocks_of_a_large_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 20)
    rows = hub_and_chain(12, copies=120)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_signatures_estimate_weighted_similarity():
    columns, owner, _ = dartminhash.shingle_columns([" ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(20, 220))])
    made = dartminhash.signatures(columns, owner, 2, 4000)
    assert abs((made[0] == made[1]).mean() - dartminhash.similarity(columns[owner == 0], columns[owner == 1])) < 0.03
    whole = dartminhash.signatures(np.array([5, 5], dtype=np.uint64), np.array([0, 1]), 2, 4000, np.array([1.0, 0.5]))
    assert abs((whole[0] == whole[1]).mean() - 0.5) < 0.04


# ---- sharding


def test_interleave_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "t", rng.choice(["hot", "hot", "b", None, "c"]), "k", 1) for i in range(700)] + [(5, "t", "hot", "k", 2)]
    df = docs_of(spark, rows, DOCS)
    got = sorted((r.shard, r.slot, r.doc_id) for r in shards.interleave(df, 16, bucket_rows=20).collect())
    keyed = [(hashlib.md5(f"{shards.SEED}:{r[0]}".encode()).hexdigest(), r[0], r[2]) for r in rows]
    ranked = []
    for s in {k[2] for k in keyed}:
        own = sorted(k for k in keyed if k[2] == s) if s else sorted((k for k in keyed if k[2] is None), key=lambda k: k[:2])
        ranked += [((2 * i + 1) / (2 * len(own)), k[0], k[1]) for i, k in enumerate(own)]
    n = len(rows)
    want, slots = [], {}
    for i, (_, _, doc) in enumerate(sorted(ranked)):
        shard = i * 16 // n
        want.append((shard, slots.get(shard, 0), doc))
        slots[shard] = slots.get(shard, 0) + 1
    assert got == sorted(want)
    assert max(slots.values()) - min(slots.values()) <= 1
    assert shards.interleave(df.where("false")).count() == 0


# ---- language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect() if r.lang]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    model = crf.train(crf.sample(docs_of(spark, [(t, l) for i, t, l in rows if zlib.crc32(str(i).encode()) % 5], "text string, lang string"), docs=60), epochs=2)
    got = model.label([t for _, t, _ in held])
    assert sum(g[0] == l for g, (_, _, l) in zip(got, held, strict=True)) / len(held) > 0.97
    mixed = "the thing of the entions and thereading. und der keitungen die schlichten"
    assert {t for _, t, _ in model.tags(mixed)} >= {"en", "de"}
    odd = crf.identify(docs_of(spark, [(1, None), (2, ""), (3, "12 ... ²"), (4, "the of and")]), model).collect()
    assert [r.language.lang for r in sorted(odd)] == ["und", "und", "und", "en"]
    assert all(0 <= r.language.score <= 1 for r in odd)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    scores, moves, begin = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, _ = crf.forward_backward(scores, np.array([3, 4]), moves, begin)
    from itertools import product

    for lo, n in ((0, 3), (3, 4)):
        total, want = 0.0, np.zeros((n, 3))
        for path in product(range(3), repeat=n):
            p = np.exp(begin[path[0]] + sum(scores[lo + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            for i, y in enumerate(path):
                want[i, y] += p
        assert np.allclose(got[lo : lo + n], want / total)


def test_language_without_labels(spark):
    model = crf.fit(docs_of(spark, [("a", None)], "text string, lang string"))
    assert crf.identify(docs_of(spark, [(1, "a b")]), model).first().language.lang == "und"


# ---- HTML


def test_main_text():
    tree = htmltext.trained()
    page = '<nav>x</nav><main><h1>T &amp; &#233;</h1>a<b>b</b> c<br>d<p>e<div class="comments"><p>hey you there</p></div><form>f</form><script>if(a<b)</script></main><footer>z'
    assert htmltext.main_text(page, tree) == "T & é\nab c d\ne"
    assert htmltext.main_text(None, tree) == htmltext.main_text("", tree) == ""
    assert htmltext.main_text("<script>never closed <p>x", tree) == ""
    assert htmltext.main_text("<!-- open <p>x", tree) == ""
    assert htmltext.main_text("<article><p>" + "word " * 100000 + "<p>" * 1000, tree).count("word") == 100000


def test_extract_matches_articles(spark):
    rows = htmltext.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    import html

    for r in rows:
        inner = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("<h1>|<p>", inner.replace("<br>", " ")))
        assert r.text == "\n".join(b for b in blocks if b)


# ---- pieces


def test_pieces_equal_the_library_without_dropout_and_round_trip():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain, varied = pieces.Coder(dropout=0.0), pieces.Coder()
    for text in ("Hello  world \n x é ñ 中ö\x00 𝄞 ", " ", "\n", "a" * 3000, "thententatntion of the", ""):
        assert plain.encode(text).tolist() == library.encode(text)
        for key in range(5):
            assert varied.decode(varied.encode(text, key)) == text
    odd = "a▁b ▁ c"
    assert plain.decode(plain.encode(odd)) == odd
    assert len({varied.encode("thententatntion", k).tobytes() for k in range(40)}) > 1
    units = ["▁".replace("▁", " ") + "thententatntion", " of", "x" * 30, "é", "\n", " \x00a"]
    assert varied.segment_many(units, [3] * len(units)) == [varied.segment(u, 3) for u in units]


def test_encode_and_decode_tables(spark):
    df = docs_of(spark, [(1, "a b", "s", "k", 1), (None, "c", None, None, None), (3, None, None, None, None), (4, "", None, None, None)], DOCS)
    out = pieces.decode(pieces.encode(df)).collect()
    assert all(r.decoded == r.text for r in out)
    assert [r.pieces is None for r in out] == [False, False, True, False]
    assert pieces.encode(df.where("false")).count() == 0


# ---- search


def test_search_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(300)] + [(300, None), (301, [None, 1.0]), (302, [float("nan")]), (303, [0.5]), (7, [0.1] * 6)]
    df = docs_of(spark, rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in bitslice.search(df, df.where("vec_id % 50 = 0"), 5, block_rows=64, query_rows=3).collect())
    good = [(i, np.floor(256 * np.pad(np.array(v, dtype=np.float32).astype(float), (0, 6 - len(v)))).astype(int)) for i, v in rows if v and all(x is not None and x == x for x in v)]
    want = []
    for q, w in good:
        if q % 50 == 0:
            best = sorted((-int(w @ v), i) for i, v in good if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


# ---- personal data


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base_list(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans_match_the_plain_patterns(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "a@b@c.d x.y@z.w_q@e.f 1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4 +1 (743) 555-3824 +12 4111 1111 1111 1111 é@a.b é1@a.b 0000000000000000000000 +1.2.3.4.5.6.7.8.9"), (-4, "x@y.z," * 400)]
    got = {r.doc_id: r for r in pii.digest_rows(pii.find(docs_of(spark, rows))).collect()}
    for i, t in rows:
        assert got[i].base_sha256 == hashlib.sha256(base_list(t).encode()).hexdigest()


def test_long_runs_take_linear_time(spark):
    text = "a" * 200_000 + " " + "1" * 100_000 + " b@" + "c.d" * 30_000
    assert pii.digest_rows(pii.find(docs_of(spark, [(1, text)]))).first().n_email == 1


def test_disclosing_terms_are_found_and_removed(spark):
    rows = [(i, f"Ask Zorblatt the manager at boss@corp.example.com number {i} " + "and the rest " * i) for i in range(6)] + [(100 + i, f"the rest and more {i} words") for i in range(60)]
    found = {r.doc_id: r for r in pii.digest_rows(pii.find(docs_of(spark, rows))).collect()}
    assert "term:4:12" in found[0].spans and found[100].spans == ""
    texts = {r.doc_id: r.text for r in pii.sanitise(docs_of(spark, rows)).collect()}
    assert "Zorblatt" not in texts[0] and "[EMAIL]" in texts[0] and texts[103] == rows[9][1]
    assert pii.sanitise(docs_of(spark, rows).where("false")).count() == 0


def test_copies_do_not_hide_disclosing_terms(spark):
    rows = [(i, f"Ask Zorblatt the manager at boss@corp.example.com number {i} " + "and the rest " * i) for i in range(3)] + [(100 + i, f"the rest and more {i} words") for i in range(60)]
    want = {r.doc_id: r.spans for r in pii.find(docs_of(spark, rows)).collect()}
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    got = {r.doc_id: r.spans for r in pii.find(docs_of(spark, rows)).collect()}
    assert any(s.kind == 4 for s in want[0])
    assert got == want | {1000 + i: want[0] for i in range(300)}


# ---- packing


def test_best_fit_decreasing_matches_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        cap = rng.choice([5, 16, 100])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 80))]
        rows = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rows if r[0] + n <= cap]
            (max(fits, key=lambda r: r[0]) if fits else rows.append([0]) or rows[-1])[0] += n
        got = packing.best_fit_decreasing(lengths, cap)
        sums = {}
        for n, r in zip(lengths, got, strict=True):
            sums[r] = sums.get(r, 0) + n
        assert sorted(sums.values()) == sorted(r[0] for r in rows)


def test_packing_is_lossless(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(docs_of(spark, [(-1, None), (-2, ""), (-3, "w " * 9000)]))
    packed = packing.pack(df, length=256)
    texts = {}
    for r in packing.unpack(packed).collect():
        texts.setdefault(r.doc_id, {})[r.piece] = r.ids
    made = packing.encoding()
    for r in df.collect():
        if r.text:
            own = texts[r.doc_id]
            assert sorted(own) == list(range(len(own))) and made.decode([i for k in sorted(own) for i in own[k]]) == r.text
    assert all(len(r.ids) == 512 and r.cu_seqlens[-1] <= 256 and r.position_resets == r.cu_seqlens[:-1] for r in packed.collect())


# ---- decontamination


def test_hits_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((3, 10, 12, 1, 25))] + [(9, None), (10, "..."), (1, "dup w1")]
    rows = [(i, " ".join(rng.choice([*vocabulary, "Ünï", "X-1"]) for _ in range(rng.randint(0, 120)))) for i in range(60)] + [(99, None), (98, "!"), (97, items[4][1].upper())]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: word.findall((t or "").translate(lower))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    bench = docs_of(spark, items, "item_id long, text string")
    for r in decontaminate.digest_rows(decontaminate.find_hits(docs_of(spark, rows), bench)).collect():
        w = words(dict(rows)[r.doc_id])
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())


def test_passes_over_a_large_benchmark_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    whole = sorted(decontaminate.digest_rows(decontaminate.find_hits(docs, bench)).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 9000)
    assert sorted(decontaminate.digest_rows(decontaminate.find_hits(docs, bench)).collect()) == whole


def test_one_pass_over_the_benchmark_is_alive_at_a_time(spark, monkeypatch):
    docs = docs_of(spark, [(1, "one two three four five six seven eight nine ten"), (2, "other words")])
    bench = docs_of(spark, [(i, f"one two three four five six seven eight nine {x}") for i, x in enumerate(("ten", "eleven", "twelve"))], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 100)
    assert len(list(decontaminate._passes(bench, "item_id", "text"))) == 3
    found = decontaminate.find_hits(docs, bench)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted((r.doc_id, r.hits["items"]) for r in found.collect()) == [(1, ["0"]), (2, [])]


def test_decontaminate_cuts_or_drops(spark):
    bench = docs_of(spark, [(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    df = docs_of(spark, [(1, "Before. One two three four five six seven eight nine TEN! After"), (2, "clean"), (3, None)])
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, bench).collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(df, bench, drop_documents=False).collect()}
    assert cut == {1: "Before. ! After", 2: "clean", 3: None}
    assert decontaminate.find_hits(df, bench.where("false")).where("size(hits.items) > 0").count() == 0


# ---- chat


def test_template_language():
    source = "{% set a = 'x' ~ 1 + 2 %}{% for m in ms %}{% if loop.first and m.k == 'a' %}no{% elif m.k == 'b' %}{{ m.v | upper }}{% else %}-{% endif %}"
    t = template.Template(source + "{% generation %}{{ m.v }}{% endgeneration %}{% endfor %}{{ a }}{# c #} {{- 'q}}' -}}  ")
    assert t.render(ms=[{"k": "b", "v": "v1"}, {"k": "z", "v": "w"}]) == ("V1v1-wx12q}}", [(2, 4), (5, 6)])
    assert template.Template("{{ 1 + 2 }}{% if false %}x{% endif %}y").tree == (template.Emit(template.Const("3y")),)
    for bad in ("{{ a.b() }}", "{{ a | nothing }}", "{% if a %}", "{% raw %}", "{{ a"):
        with pytest.raises(template.TemplateError):
            template.Template(bad)
    assert template.Template("{{ a.__class__ }}").render(a="s") == ("", [])


def test_chats_read_back(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "a\nb", "", None, "&n<|"]
    rows = [(c, t, r, said[(c + t) % 6]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", None, "we&ird\nrole<|", "assistant"])]
    rows += [(7, None, "user", "late"), (7, 0, "user", "x"), (7, 0, "user", "x"), (None, 1, "assistant", "n")]
    df = docs_of(spark, rows, "conv_id long, turn long, role string, text string")
    chats = {r.conv_id: r for r in chat.format_chats(df).collect()}
    for c in chats:
        own = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        assert chat.read_back(chats[c].formatted) == [(r, x) for _, _, r, x in own]
        assert [chat.unguard(chats[c].formatted[a:b]) for a, b in chats[c].loss_spans] == [x for _, _, r, x in own if r == "assistant" and x]
    got = {r.conv_id: r for r in chat.digest_rows(chat.format_chats(df)).collect()}
    assert got[7].n_turns == 3 and got[0].loss_chars == len(said[2] or "") + len(said[5] or "")
    assert chat.format_chats(df.where("false")).count() == 0


