"""Cases that reviews found."""

import json
import random
import re
import zipfile

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scrivano import constants as C
from scrivano.functions import mail
from scrivano.functions import text as T
from scrivano.operators import curate, email, rewrite
from scrivano.sources import archives


def test_cut_references_of_pages(spark, tmp_path):
    pages = ["<title>a &amp</title><p>b &amp; c</p>", "&lt &lt; &ampx; &amp;lt; &&amp; &nope;", "&copy&reg;&nbsp", "", None]
    rows = [(i, p) for i, p in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["html_unescaped"]).fetchall()
    assert sorted((r.page_id, r.text) for r in entry.queries()["html_unescaped"](spark, str(tmp_path)).collect()) == sorted(want)
    assert mail.unescape_text("&lt&#65") == "<A" and mail.unescape_text("&lt&#65;", closed=True) == "&ltA"


def test_routes_are_computed_once(spark, tmp_path):
    seen, folder = f"{tmp_path}/seen", f"{tmp_path}/routes"

    def noted(batches):
        for batch in batches:
            with open(seen, "a") as f:
                f.writelines(f"{x}\n" for x in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict(batch.to_pydict())

    def lines(name):
        return [json.loads(x) for x in (r.value for r in spark.read.text(f"{folder}/{name}").collect())]

    for texts in (["typed by hand", "a — dash", "word " * 401, "```gone```"], ["only this"]):
        rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(1).mapInArrow(noted, "text string")
        curate.write_routes(curate.curate(rows), folder)
        with open(seen) as f:
            assert sorted(f.read().splitlines()) == sorted(texts)
        open(seen, "w").close()
        if len(texts) > 1:
            assert lines("curated") == [{"text": "typed by hand", "raw_words": 3, "words": 3}]
            assert lines("ai-marked") == [{"text": "a — dash", "raw_words": 3, "words": 3, "excluded": "ai-marker-emdash"}]
            assert [x["words"] for x in lines("quarantine")] == [401]
    assert lines("curated") == [{"text": "only this", "raw_words": 2, "words": 2}]
    assert lines("ai-marked") == lines("quarantine") == []
    assert sorted(p.name for p in (tmp_path / "routes").iterdir()) == ["ai-marked", "curated", "quarantine"]


def test_words_and_long_tokens(spark):
    """Counts as str.split() has them, and long tokens as their pattern has them, whatever the white space."""
    pick = random.Random(1)
    blanks = T._members(C.PY_WS) + "\ufeff\u200b"
    texts = ["", " ", "a", None, "\U0001f600" * 40, "x" * 39 + "\ufeff" + "y" * 39, "x" * 39 + "\x1c" + "y"]
    texts += ["".join(pick.choice([pick.choice(blanks), " ", "a" * pick.randint(1, 45), "é—\U0001f600"]) for _ in range(pick.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.py_word_count(F.col("t")).alias("n"), T.has_long_token(F.col("t")).alias("long"))
    pattern = re.compile("[^%s]{40}" % re.escape(T._members(C.JS_WS)))
    assert {r.i: (r.n, r.long) for r in rows.collect()} == {i: (None, None) if t is None else (len(t.split()), bool(pattern.search(t))) for i, t in enumerate(texts)}


def mail_of(sender, text):
    return f"From x\nFrom: {sender}\nDate: Thu, 4 Jun 2026 9:05:00 GMT\n\n{text}\n"


def unbounded(spark):
    for name, most in (("maxRecordsPerBatch", 10000), ("maxBytesPerBatch", 1 << 30)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def test_batches_of_mail_are_bounded(spark, tmp_path):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    (tmp_path / "Sent.mbox").write_text("".join(mail_of("a@x.org", "word " * 600) for _ in range(2500)))
    unbounded(spark)
    rows = archives.mail_messages(spark, str(tmp_path)).coalesce(1)
    found = rows.mapInArrow(sizes, "n long").collect()
    assert sum(r.n for r in found) == 2500 and max(r.n for r in found) <= 1000


def test_mail_is_parsed_for_its_owner_and_once_more(spark, tmp_path):
    """And messages of one place in two archives of one name stay two."""
    (tmp_path / "a-Sent.mbox").write_text(mail_of("a@x.org", "five words that I wrote"))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Sent.mbox", mail_of("a@x.org", "five other words I wrote"))
    rows = email.ingest(spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow parse") == 2
    assert sorted(r.text for r in rows.collect()) == ["five other words I wrote", "five words that I wrote"]


def test_headers_are_parsed_as_ever():
    for sender in ("Ann <a@x.org>", "=?utf-8?b?w6k=?= <b@y.org>", "bad <", "a@b, c@d", "", "x" * 1200):
        raw = f"From: {sender}\nContent-Type: text/html; charset=nope\n\nhello".encode()
        want = str(archives.email.message_from_bytes(raw, policy=archives.email.policy.default)["from"])
        assert [archives.mail_fields(raw)[i] for i in (0, 2, 3)] == [archives.mail_fields(raw)[i] for i in (0, 2, 3)] == [want, "html", "hello"]


def test_batches_of_texts_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    texts = spark.range(2500).select(F.lit("the cat and the dog").alias("text")).coalesce(1)
    for run in (lambda: rewrite.inject_typos(texts, {"teh": "the"}, 20.0), lambda: rewrite.rewrite(texts, [("none", lambda q: q)])):
        unbounded(spark)
        found = run().mapInArrow(sizes, "n long").collect()
        assert sum(r.n for r in found) == 2500 and max(r.n for r in found) <= 1000
