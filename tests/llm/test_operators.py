"""The other operators against brute force, the library, exact round trips or held-out accuracy, and their edge cases."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrivano.llm import html, langid, media, mixing, substring, topk, warc
from scrivano.llm.bpe import Bpe, WordBpe
from scrivano.llm.queries import WORD_BPE

DOCS = "doc_id long, text string"


def rows(spark, data, schema=DOCS):
    return spark.createDataFrame(data, schema)


# --- BPE


def test_bpe_is_the_librarys(spark):
    library = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(1)
    letters = "ab the anin' 'Śé ΣΑΣ İI 12٣\n\t  ing-ing___!!ñ日本語한글😀👍🏽\x1c"
    texts = [None, "", " \n", "a" * 3000, "haha" * 500, "<|endoftext|>x<|startoftext|>", "x" * 100_000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) + rng.choice(["", "<|endoftext|>b"]) for _ in range(400)]
    bpe = Bpe(spark, WORD_BPE)
    df = rows(spark, [(i, t, 5) for i, t in enumerate(texts)], DOCS + ", ids int")
    got = {r.doc_id: r for r in df.withColumn("ids", bpe.encode(F.col("text"))).withColumn("back", bpe.decode(F.col("ids"))).withColumn("b", bpe.round_trip(F.col("text"))).collect()}
    assert all((r.b.ids, r.b.text) == (r.ids, r.back) for r in got.values())
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids, t
        assert got[i].back == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_code_points_of_all_planes():
    """Every seventeenth code point among letters, digits and marks, those unassigned in Python's tables included."""
    library, model = Tokenizer.from_file(WORD_BPE), WordBpe(open(WORD_BPE, "rb").read())
    points = [chr(i) for i in range(0, 0x110000, 17) if not 0xD800 <= i < 0xE000] + list("\u0558\u1c89\U0002cea8")
    texts = [f"ab{c}cd{c} {c}1 <|endoftext|>{c}E" for c in points] + ["".join(points[i : i + 40]) for i in range(0, len(points), 40)]
    for t, ids, want in zip(texts, model.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, t


def test_bpe_speculation_meets_both_outcomes():
    model = WordBpe(open(WORD_BPE, "rb").read())
    merged = []
    exact, model.merge = model.merge, lambda w: merged.append(w) or exact(w)
    model.encode(["the unbelievable thnthstre anininthere of words"])
    assert merged and len(merged) < 6
    assert model.decode(np.array([0, 10**6, 1], "<u4").tobytes()) == b"! \""


def test_bpe_empty_table(spark):
    bpe = Bpe(spark, WORD_BPE)
    assert rows(spark, []).select(bpe.decode(bpe.encode(F.col("text")))).collect() == []


# --- HTML


def test_html_blocks():
    long = "The cat is on the mat and it was the best of times for all of us in the town, as it is to this day."
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site of the day</h1></header><nav><a href=x>Home</a></nav>
    <div id="cookie-banner">{long}</div><div class=content><h2>Title &amp; more</h2><p>{long}</p><p>Short.</p><script>"<p>no</p>"</script>
    <form><p>{long}</p></form><div class="comments"><p>{long}</p></div></div><aside><p>{long}</p></aside><ul><li><a href=x>One link of the many</a></li></ul><footer>{long}</footer>"""
    assert html.main_text(page) == f"Title & more\n{long}\nShort."


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>x", "x"), ("a<b>c</b>d", "acd"), ('<p title="a>b">The x &lt;y&gt; &#65;&nbsp; z</p>', "The x <y> A z"), ("<article><header><h1>A</h1></header><p>b<br><br>c<br>d<p>e</article><div class=ad>f</div>", "A\nb\nc d\ne"), ("<script>x", ""), ("<p>a<!-- b", "a")])
def test_html_edges(page, text):
    assert html.main_text(page) == text


def test_html_long_page():
    page = "<article>" + "<p>" + "word of the " * 20 + "</p>"
    assert html.main_text("<article>" + "<p>word</p>" * 50_000).count("\n") == 49_999 and html.main_text(page)


# --- media


def test_media_round_trip(spark):
    docs = [(1, None), (2, ""), (3, "é" * 288), (4, "x" * 577), (5, "long " * 200_000), (6, "x" * 577)]
    got = {r.doc_id: r for r in media.write_texts(spark, rows(spark, docs)).withColumn("f", media.features(spark, F.col("media"))).collect()}
    for i, t in docs:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        f = got[i].f
        assert (got[i].n_bytes, f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert np.load(io.BytesIO(bytes(got[i].media))).tobytes() == payload
    assert got[4].f.feature == got[6].f.feature and bytes(got[4].media) == bytes(got[6].media)


def test_image_formats():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P2 # c\n4 3\n255\n" + b" ".join(b"%d" % x for x in range(12))) == grey).all()
    assert (media.decode(b"P1\n3 1\n1 0 1") == [[0, 1, 0]]).all() and (media.decode(b"P4\n3 1\n\xa0") == [[0, 1, 0]]).all()
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]] and media.decode(b"P5 1 1 300\n\x01\x02").tolist() == [[258]]
    bmp = b"BM" + (58).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\1\0\x18\0" + b"\0" * 24 + b"\x03\x02\x01\0"
    assert media.decode(bmp).tolist() == [[[1, 2, 3]]]
    assert np.allclose(media.area_resize(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    assert np.allclose(media.area_resize(np.array([[0.0, 3.0]]), 1, 3), [[0, 1.5, 3]])
    assert media.from_tiles(media.to_tiles(grey, 2)).shape == (4, 2, 2)


# --- substrings


def brute_windows(docs, w):
    first = {}
    for i, t in docs:
        words = (t or "").encode().split()
        for k in range(len(words) - w + 1):
            if i is not None:
                key = tuple(words[k : k + w])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        words = (t or "").encode().split()
        gone = set()
        for k in range(len(words) - w + 1):
            if i is not None and first[tuple(words[k : k + w])] < i:
                gone.update(range(k, k + w))
        out.append((i, len(words), len(gone), b" ".join(x for k, x in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("w", [8, 20, 50])
def test_substrings(spark, w):
    rng = random.Random(w)
    passages = [[f"p{rng.randrange(500)}" for _ in range(rng.randrange(w // 2, 3 * w))] for _ in range(8)] + [["same"] * (2 * w)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(passages)[rng.randrange(5) :] if rng.random() < 0.6 else [f"o{rng.random()}" for _ in range(rng.randrange(w))]
        docs.append((i, " ".join(words)))
    docs += [(90, docs[5][1]), (91, docs[5][1]), (91, docs[5][1]), (None, docs[5][1]), (92, None), (93, ""), (94, " ".join(passages[0])), (94, " ".join(passages[1]))]
    df = rows(spark, [(i, t, 1) for i, t in docs], DOCS + ", row int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.dedup_substrings(df, w).collect()), key=str)
    assert got == brute_windows(docs, w)


def test_substrings_empty_and_long(spark):
    assert substring.dedup_substrings(rows(spark, [])).count() == 0
    text = " ".join(map(str, range(100_000)))
    got = {r.doc_id: r.n_removed for r in substring.dedup_substrings(rows(spark, [(1, text), (2, "x " + text)])).collect()}
    assert got == {1: 0, 2: 100_000}


# --- mixing


def test_mixing(spark):
    rng = random.Random(4)
    docs = [(i, "w " * rng.randrange(1, 90), rng.choice("abcdef")) for i in range(900)] + [(1000, None, "a"), (1001, "", "b"), (1002, "one two", None), (None, "x y z", "c"), (7, "w", "zz"), (7, "w", "zz")]
    df = rows(spark, docs, DOCS + ", source string")
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect())) and len(got) == len(docs)
    sizes: dict = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            goal[s] = 2 * sizes[s]
            left -= goal[s]
        open_ -= full
    goal |= {s: level * weight[s] for s in open_}
    source = {(i, len((t or "").split())): s for i, t, s in docs}
    taken: dict = {}
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
    for s in "abcdef":
        assert abs(taken[s] - goal[s]) <= 3


def test_mixing_has_unequal_chances(spark):
    """Over many seeds a document is taken as often as its class's expected copies say, longer ones more often."""
    rng = random.Random(8)
    docs = [(i, "w " * rng.choice([1, 3, 12, 50, 200]), "ab"[i % 2]) for i in range(400)]
    df = rows(spark, docs, DOCS + ", source string")
    size = {i: len(t.split()) for i, t, _ in docs}
    taken: dict = {}
    for salt in range(9):
        got = mixing.mix(df.withColumn("doc_id", F.col("doc_id") + salt * 1000)).collect()
        for r in got:
            kind = ("ab"[r.doc_id % 2], size[r.doc_id % 1000])
            taken.setdefault(kind, []).append(r.copies)
        assert max(r.copies for r in got) <= 2
    rates = {k: sum(v) / len(v) for k, v in taken.items()}
    for s in "ab":
        whole = sum(size[i] for i, _, x in docs if x == s)
        goal = got[0].target if "ab"[got[0].doc_id % 2] == s else next(r.target for r in got if "ab"[r.doc_id % 2] == s)
        words = {n: sum(size[i] for i, _, x in docs if x == s and size[i] == n) for n in (1, 3, 12, 50, 200)}
        low, high = 0.0, 2.0  # what expected copies a binary digit stands for
        for _ in range(60):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(2, c * n.bit_length()) * w for n, w in words.items()) < goal else (low, c)
        if goal < 2 * whole - 1e-6:
            for n in (3, 12, 50):
                assert abs(rates[s, n] - min(2, c * n.bit_length())) < 0.15, (s, n)
            assert rates[s, 1] < rates[s, 12] < rates[s, 200] + 1e-9


def test_mixing_odd_columns(spark):
    df = rows(spark, [(1, "a b", "s", 1, 2), (2, None, "s", 1, 2), (None, "c", None, 1, 2)], DOCS + ", source string, size int, rank int")
    assert sorted((r.doc_id or 0, r.size) for r in mixing.mix(df).collect()) == [(0, 1), (1, 2), (2, 0)]


def test_mixing_edges(spark):
    schema = DOCS + ", source string"
    assert mixing.mix(rows(spark, [], schema)).count() == 0
    assert [r.taken for r in mixing.mix(rows(spark, [(1, None, "a"), (2, "", None)], schema)).collect()] == [0, 0]


# --- language


def test_langid(spark):
    rng = random.Random(5)
    stock = {"en": "the and of to in is that thing with have ing", "fr": "le la les des est que dans pour une avec été", "de": "der die das und ist nicht ein für mit auf über"}
    docs = []
    for i in range(600):
        lang = rng.choice(list(stock))
        docs.append((i, " ".join(rng.choice(stock[lang].split()) for _ in range(rng.randrange(5, 60))), lang))
    docs += [(1000, None, "en"), (1001, "1234 !!", "en"), (1002, "the and of that", None), (None, "the thing is that", "fr"), (1003, "der und die " * 30_000, None)]
    df = rows(spark, docs, DOCS + ", lang string")
    model = langid.learn(df)
    got = {r.doc_id: r for r in df.select("doc_id", langid.held_out(F.col("doc_id")).alias("out"), langid.predict(df, model, F.col("text")).alias("p"), "lang").collect()}
    held = [r for r in got.values() if r.out and r.lang and r.p.lang != "und"]
    assert len(held) > 100 and sum(r.p.lang == r.lang for r in held) / len(held) > 0.97
    assert all(r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.p.score <= 1 for r in got.values())
    assert got[1000].p == ("und", 0.0) and got[1001].p == ("und", 0.0) and got[1002].p.lang == "en" and got[None].p.lang == "en" and got[1003].p.lang == "de"


def test_langid_with_nothing_to_learn(spark):
    df = rows(spark, [(1, "x", None)], DOCS + ", lang string")
    assert langid.learn(df) is None
    assert df.select(langid.predict(df, None, F.col("text")).alias("p")).first().p.lang == "und"


# --- top-k


def brute_top(vectors, query, k):
    whole = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in whole:
        if query(i):
            scores = sorted(((-sum(a * b for a, b in zip(v, u)), j) for j, u in whole if j != i and len(u) == len(v)))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "TASKS", 5)
    rng = random.Random(6)
    vectors = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(5)]) for i in range(120)]
    vectors += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (210, [1.0, 2.0]), (220, [0.5, 0.5]), (300, [1e12, -1e12, 1.0, 2.0, 3.0]), (None, [1.0] * 5), (301, vectors[3][1])]
    got = topk.top_k(spark, rows(spark, vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 4)
    limit = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    assert {tuple(r) for r in got.collect()} == {(a, b, c, limit(s)) for a, b, c, s in brute_top(vectors, lambda i: i % 10 == 0, 4)}


def test_topk_ties_repeats_and_odd_columns(spark):
    """Equal vectors by the hundred, a repeated row, and columns named as the operator's own."""
    vectors = [(i, [1.0, 2.0], "x", 1) for i in range(300)] + [(300, [0.0, 0.0], "x", 1)] * 2 + [(301, [], "x", 1), (400, [], "x", 1)]
    df = rows(spark, vectors, "vec_id long, embedding array<double>, mark string, q int")
    got: dict = {}
    for r in topk.top_k(spark, df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [*range(1, 11)], 100: [*range(10)], 200: [*range(10)], 300: [*range(10)], 400: [301]}


def test_topk_empty(spark):
    assert topk.top_k(spark, rows(spark, [], "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0).count() == 0


# --- WARC

PAGES = "page_id long, url string, html string"


def test_warc(spark):
    rng = random.Random(7)
    bodies = ["<p>é" + "x" * n for n in (0, 50, 94, 95, 96, 4000)] + [None, "", "y" * 300_000]
    pages = [(i, rng.choice([None, "http://a.b/é \r\nx"]), rng.choice(bodies)) for i in range(200)] + [(None, "u", bodies[5]), (5, "u", bodies[5])]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(warc.write(spark, rows(spark, pages, PAGES).repartition(3))).collect()), key=str)
    first: dict = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        origin = first.get(h or "") if len(raw) >= 100 else i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if origin == i else "revisit", None if origin == i else origin))
    assert got == sorted(want, key=str)


def test_warc_hot_payload_and_odd_columns(spark):
    """One payload on half the pages; a third of the pages empty; columns of clashing names."""
    body = "<p>" + "x" * 200
    pages = [(i, f"u{i}", body if i % 2 else "" if i % 3 else f"<p>{i}" + "y" * 150, "d", 1) for i in range(3000)]
    df = rows(spark, pages, PAGES + ", digest string, key int").repartition(7)
    got = {r.page_id: r for r in warc.read(warc.write(spark, df)).collect()}
    assert len(got) == 3000 and got[1].record_type == "response" and all(got[i].refers_to == 1 for i in range(3, 3000, 2))
    assert all(got[i].record_type == "response" for i in range(0, 3000, 2))


def test_warc_revisits_name_their_response(spark):
    body = "z" * 300
    archives = warc.write(spark, rows(spark, [(1, "http://a/1", body), (2, "http://a/2", body)], PAGES).coalesce(1))
    system, place = warc._open(archives.first().path)
    with system.open_input_stream(place) as stream:
        found = {h["X-Page-ID"]: (h, p) for h, p in warc.read_records(stream)}
    first, again = found["1"][0], found["2"][0]
    assert found["1"][1] == body.encode() and found["2"][1] == b""
    assert again["WARC-Refers-To"] == first["WARC-Record-ID"] != again["WARC-Record-ID"] and again["WARC-Refers-To-Target-URI"] == "http://a/1"


def test_warc_format(tmp_path):
    out = io.BytesIO()
    out.close, closed = (lambda: None), out
    writer = warc.Writer(out)
    raw = [warc.record("response", i, f"http://x/{i}", f"<p>page {i} of many</p>".encode() * 20, "d" * 64, None) for i in range(300)]
    for r in raw:
        writer.add(r)
    writer.close()
    data = closed.getvalue()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and len(data) < sum(map(len, raw)) / 3
    assert [h["X-Page-ID"] for h, _ in warc.read_records(io.BytesIO(data))] == [str(i) for i in range(300)]
    with pytest.raises(Exception):
        list(warc.read_records(io.BytesIO(data[:-5])))


def test_warc_empty(spark):
    assert warc.read(warc.write(spark, rows(spark, [], PAGES))).count() == 0
