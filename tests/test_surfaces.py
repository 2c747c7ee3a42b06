"""Counters of mail, mailboxes that many tasks read, the JSON server, the library's names and the model backends."""

import json
import sys
import urllib.request
import zipfile
from threading import Thread

import pytest
from pyspark.sql import functions as F

import scrivano
from scrivano import config, server
from scrivano.functions import mail, numbers
from scrivano.operators import email, fingerprint, rewrite, score
from scrivano.sources import archives


def message(sender, body):
    return f"From x\nFrom: {sender}\nDate: Thu, 4 Jun 2026 9:05:00 GMT\n\n{body}\n"


def test_counters_and_owners(spark, tmp_path):
    bounce = "your message could not be delivered to this address"
    (tmp_path / "a.mbox").write_text("".join([message("", "five words of mine here"), message("", "too short"), message("", bounce), message("bob@x.org", "not mine at all is it")]))
    with zipfile.ZipFile(tmp_path / "o.olm", "w") as z:
        for i, who in enumerate(["", "", "zoe@x.org"]):
            z.writestr(f"Sent Items/{i}.xml", f"<e><SenderAddress>{who}</SenderAddress><CopyBody>six words are in this body</CopyBody></e>")
    rows = email.judged(archives.mail_messages(spark, str(tmp_path)))
    assert sorted((r.source, r.own) for r in rows.collect()) == [("email:a", False), ("email:a", True), ("email:a", True), ("email:a", True), ("email:o", False), ("email:o", False), ("email:o", True)]
    counted = email.counters(rows).first()
    assert (counted.kept, counted.skipped, counted.not_owner) == (2, 2 if mail_bounces(spark, bounce) else 1, 3)
    assert email.ingest(spark, str(tmp_path)).count() == counted.kept
    assert tuple(email.counters(rows.limit(0)).first()) == (0, 0, 0)


def mail_bounces(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(mail.is_bounce(F.col("t")).alias("b")).first().b


def test_a_mailbox_is_split_between_tasks(spark, tmp_path):
    said = [message("ann@x.org", f"message number {i} has some words in it \u00e9") for i in range(3000)]
    (tmp_path / "big.mbox").write_text("preamble\nFrom: nobody\n" + "".join(said))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        rows = archives.mailbox_messages(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 3
        got = [bytes(r.raw).decode() for r in rows.orderBy("place").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [x.split("number ")[1].split()[0] for x in got] == [str(i) for i in range(3000)]
    assert archives.mailbox_messages(spark, str(tmp_path / "none")).count() == 0


def test_broken_archives_are_left_out(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Sent.mbox", message("ann@x.org", "one two three four five " * 50))
    raw = (tmp_path / "t.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(raw[:60] + b"\0" * 20 + raw[80:])
    (tmp_path / "locked.zip").write_bytes(raw[:6] + b"\1" + raw[7:].replace(raw[: 4] and b"PK\1\2" + raw[raw.index(b"PK\1\2") + 4 :][:4] + b"\0", b"PK\1\2" + raw[raw.index(b"PK\1\2") + 4 :][:4] + b"\1"))
    assert {r.source for r in archives.mail_messages(spark, str(tmp_path)).collect()} >= {"email:t-Sent"}


@pytest.mark.parametrize("text,want", [("&lt;a&gt; &amp;amp; &quot;&apos;", "<a> &amp; \"'"), ("&#65;&#x42;&nbsp;&copy", "AB&nbsp;&copy"), ("&#65 &lt", "&#65 &lt")])
def test_xml_references(text, want):
    assert mail.unescape_xml(text) == want


def test_rounding_is_pythons():
    import random

    import numpy as np

    rng = random.Random(1)
    values = [rng.uniform(-100, 100) for _ in range(20000)] + [k / 2000 for k in range(-3000, 3000)] + [2.675, 1.0005, 1e300, -0.0, float("inf")]
    got = numbers.rounded(np.array(values), 3).tolist()
    assert got == [x if x in (float("inf"),) else round(x, 3) for x in values]


def test_rhythm_counts_words_between_white_space(spark):
    few = spark.createDataFrame([("a", "x-y-z " * 499), ("b", "x-y " * 500)], "bucket string, text string").withColumn("doc_id", F.lit(1))
    assert [r.bucket for r in fingerprint.rhythm(few).collect()] == ["b"]


def test_library_names():
    assert "enforce" in scrivano.__all__
    assert all(getattr(scrivano, n) is not None for n in scrivano.__all__)
    with pytest.raises(AttributeError):
        scrivano.nothing  # noqa: B018


def test_backends():
    echo = rewrite.command([sys.executable, "-c", "print(input().upper())"])
    assert echo("so") == "SO"
    with pytest.raises(RuntimeError):
        rewrite.command([sys.executable, "-c", "raise SystemExit(3)"])("x")


def test_server(spark, tmp_path):
    where = config.Folders(str(tmp_path / "c"), str(tmp_path / "p"))
    (tmp_path / "web").mkdir()
    (tmp_path / "web/index.html").write_text("hello")
    api = server.Api(spark, where, [("m", lambda q: "Importantly, it is done.")])
    with server.build(api, 0, str(tmp_path / "web")) as http:
        Thread(target=http.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{http.server_address[1]}"

        def post(name, body):
            asked = urllib.request.Request(f"{base}{name}", json.dumps(body).encode())
            try:
                with urllib.request.urlopen(asked) as got:
                    return got.status, json.loads(got.read())
            except urllib.error.HTTPError as e:
                return e.code, json.loads(e.read())

        assert post("/api/nothing", {})[0] == 404 and post("/api/registers", {})[0] == 502 and post("/api/enforce", {})[0] == 502
        assert post("/api/enforce", {"text": "Notably, both fail."}) == (200, {"text": "both fail.", "applied": {"opener-notably": 1}, "flags": {}})
        assert post("/api/rewrite", {"text": "x"}) == (200, {"text": "it is done.", "backend": "m"})
        words = spark.createDataFrame([("editorial", "The plan is sound, and we go. " * 20)], "bucket string, text string").withColumn("doc_id", F.lit(1))
        fingerprint.fingerprint(words).write.partitionBy("bucket").json(f"{where.profiles}/fingerprint")
        assert post("/api/registers", {})[1]["registers"][0]["register"] == "editorial"
        assert post("/api/score", {"text": "The plan is sound, and we go."})[1]["confidence"] == "low"
        assert post("/api/score", {"text": "x", "register": "none"})[0] == 502
        assert post("/api/infer", {"text": "x"})[1]["confidence"] == "none"
        assert post("/api/feedback", {"register": "r", "verdict": "bad"})[1]["bad"] == 1 and post("/api/feedback", {"verdict": "?"})[0] == 502
        assert urllib.request.urlopen(base).read() == b"hello"
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{base}/../secret")
        http.shutdown()


def test_unknown_register(spark):
    drafts = spark.createDataFrame([("x", "none")], "text string, register string")
    with pytest.raises(score.ProfileNotFound):
        score.require(drafts, spark.createDataFrame([("a",)], "bucket string"))
