"""Each registered query of the ten operators on whole tables, against the library, a brute force or another parser.

Those with SQL are held against it in tests/test_oracle.py.
"""

import hashlib
import html.parser
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from scrivano.llm import langid, media, queries
from scrivano.llm.queries import WORD_BPE

sys.path.insert(0, str(Path(__file__).parent))
import test_line_runs  # noqa: E402
import test_simhash  # noqa: E402

SF = "/root/testdata/sf0.001"
KINDS = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
COLUMNS = {
    "op1_bpe": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    "op2_simhash": "doc_id long, fingerprint string, component_id long",
    "op3_html": "page_id long, url string, text string, n_chars long",
    "op5_media": "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    "op6_substring": "doc_id long, n_words long, n_removed long, kept_sha256 string",
    "op7_mixing": "doc_id long, size long, source_size long, target double, taken long",
    "op8_langid": "doc_id long, held_out boolean, lang_pred string, score double",
    "op9_topk": "query_id long, rank int, vec_id long, score long",
    "op10_warc": "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
}


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    kinds = {f.name: f.dataType for f in queries.queries()[name](spark, SF).schema}
    for c in COLUMNS[name].split(", "):
        assert kinds[c.split()[0]] == KINDS[c.split()[1]]


def rows(spark, name):
    return queries.queries()[name](spark, SF).collect()


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_op1(spark, docs):
    library = Tokenizer.from_file(WORD_BPE)
    want = set()
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert {tuple(r) for r in rows(spark, "op1_bpe")} == want


def test_op2(spark, docs):
    assert {tuple(r) for r in rows(spark, "op2_simhash")} == test_simhash.brute(docs)


class Articles(html.parser.HTMLParser):
    """Blocks of articles, by Python's own parser."""

    def __init__(self):
        super().__init__()
        self.inside = self.breaks = 0
        self.blocks, self.part = [], ""

    def end(self):
        if self.part.split():
            self.blocks.append(" ".join(self.part.split()))
        self.part, self.breaks = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        elif tag == "br":
            self.breaks += 1
            self.end() if self.breaks > 1 else self.handle_data(" ")
        elif tag not in ("b", "i", "a"):
            self.end()

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a"):
            self.end()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside:
            self.part += data
            self.breaks = self.breaks if data.isspace() else 0


def test_op3(spark):
    want = set()
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        p = Articles()
        p.feed(r.html or "")
        p.close()
        p.end()
        text = "\n".join(p.blocks)
        want.add((r.page_id, r.url, text, len(text)))
    assert {tuple(r) for r in rows(spark, "op3_html")} == want


def test_op4(spark, docs):
    want = {(i, 0 if t is None else t.count("\n") + 1, lost, sha((kept or "").encode())) for (i, kept, lost), t in zip(test_line_runs.brute(docs), [t for _, t in sorted(docs, key=lambda d: str((d[0],)))])}
    got = {(r.doc_id, r.n_removed, r.kept_sha256) for r in rows(spark, "op4_lines")}
    assert got == {(i, lost, digest) for i, _, lost, digest in want} and any(lost for _, lost, _ in got)


def test_op5(spark, docs):
    got = {r.doc_id: r for r in rows(spark, "op5_media")}
    for i, t in docs:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        stored = media.store_text(t)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(stored), sha(stored))


def kernel_row(text):
    """Places of a text's n-grams of one to three letters, one by one."""
    low = text.lower()
    c = [32, *(ord(x) if x.isalpha() else 32 for k, x in enumerate(low) if k == 0 or x.isalpha() or low[k - 1].isalpha()), 32]
    out, m = set(), 2**32
    for n in (1, 2, 3):
        for k in range(len(c) - n + 1):
            g = c[k]
            for x in c[k + 1 : k + n]:
                g = (g * 0x01000193 + x) % m
            out.add(((g * 0x9E3779B1 % m) ^ ((g >> 15) * n % m)) >> 19)
    return out


def test_op8_scores_are_the_kernels(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(table)
    got = {r.doc_id: r for r in rows(spark, "op8_langid")}
    landmarks = [set(np.flatnonzero(model.landmarks[:, k]).tolist()) for k in range(model.landmarks.shape[1])]
    near = 0
    for i, t in docs[:60]:
        if not t or not any(map(str.isalpha, t)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        own = kernel_row(t)
        kernel = np.array([len(own & x) / np.sqrt(len(own) * len(x)) for x in landmarks])
        scores = kernel @ model.weights
        assert got[i].lang_pred == model.languages[int(scores.argmax())]
        near += abs(got[i].score - min(1, max(0, (scores.max() + 1) / 2))) < 1e-3
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert near >= 0.95 * len([1 for _, t in docs[:60] if t])


def test_media_columns(spark):
    ppm = b"P6 2 2 255\n" + bytes(range(12))
    images = [(1, ppm), (2, b"P5 2 1 255\n\x01"), (3, None), (4, b""), (5, b"P5 0 0 255\n"), (6, b"BM"), (7, b"P1\n2 1\n1 7"), (8, b"P5 3 1 255\n\x01\x05\x03"), (9, b"P2\nx y"), (8, b"P5 3 1 255\n\x01\x05\x03")]
    df = spark.createDataFrame(images, "id int, image binary")
    got = {r.id: r for r in df.select("id", media.image_tiles(spark, df.image, 2).alias("t"), media.image_hash(spark, df.image).alias("h")).collect()}
    assert media.from_tiles(bytes(got[1].t)).tolist() == [np.arange(12).reshape(2, 2, 3).tolist()]
    assert media.from_tiles(bytes(got[8].t)).tolist() == [[[1, 5], [255, 255]], [[3, 255], [255, 255]]] and len(got[8].h) == 16
    assert all(got[i].t is None and got[i].h is None for i in (2, 3, 4, 5, 6, 7, 9))


def test_results_outlive_a_pipeline(spark):
    """What other queries have made stays readable when a pipeline runs in between."""
    import corpus_pipeline

    held = [queries.queries()[n](spark, SF) for n in ("op2_simhash", "op6_substring", "op7_mixing", "op10_warc")]
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert all(x.count() > 0 for x in held)
