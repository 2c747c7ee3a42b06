"""Given cases of the functions and operators, and edge cases."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from scrivano import config
from scrivano.functions import lang, mail
from scrivano.functions import text as T
from scrivano.functions.numbers import py_round
from scrivano.operators import chat, curate, email, extract, fingerprint, registers, rewrite, rules, score, typos
from scrivano.sources import archives, corpus


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_lang(spark):
    cases = {
        "kalimera, tha se paro tilefono meta, eimai edo kai perimeno": "gr-latn",
        "ela re file pame gia kafe tora?": "gr-latn",
        "Καλημέρα, θα σε πάρω τηλέφωνο": "el",
        "can you check the webhook retries and add a test": "en",
        "re-run the na tests before the release": "en",
        "1234 !!": "other",
    }
    assert values(spark, lang.detect, list(cases)) == list(cases.values())


def test_lang_split(spark):
    greek = "Η γάτα κάθεται στο χαλί και ο σκύλος κοιμάται έξω στον κήπο όλη τη μέρα χωρίς καμία έγνοια για τίποτα"
    english = "the cat sits on the mat and the dog sleeps out in the garden all day long without a care"
    rows = [(1, f"{greek}\n\n{english}"), (2, f"Καλημέρα,\n\n{english}"), (3, ""), (4, f"{english}\n\n{english}\n\n{greek}")]
    got = sorted((r.doc_id, r.chunk, r.lang, r.text) for r in lang.split(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id").collect())
    assert got == [(1, 0, "el", greek), (1, 1, "en", english), (2, 0, "en", rows[1][1]), (3, 0, "other", ""), (4, 0, "en", f"{english}\n\n{english}"), (4, 1, "el", greek)]


@pytest.mark.parametrize("digits,pairs", [(0, {0.5: 0, 1.5: 2, 2.5: 2, 3.5: 4, 2.4: 2, 2.6: 3}), (2, {1.2345: 1.23, 2.675: 2.67, 0.125: 0.12})])
def test_round(spark, digits, pairs):
    rows = spark.createDataFrame([(x,) for x in pairs], "x double").select("x", py_round(F.col("x"), digits).alias("y")).collect()
    assert {r.x: r.y for r in rows} == pairs


def test_rules_selftest(spark):
    assert rules.selftest(spark) == {"rules": 9, "tests": 11, "failures": 0, "said": []}


def test_rule_overlay(spark):
    own = [{"id": "opener-worth-noting", "kind": "replace", "pattern": r"(\w+) is\s+(\w+)", "replacement": r"\2 $ \g<1>"}, {"id": "new", "kind": "flag", "pattern": r"\bx\b"}]
    loaded = rules.load_rules(json.dumps(own))
    assert [r.id for r in loaded][:2] == ["opener-worth-noting", "opener-importantly"] and loaded[-1].id == "new" and len(loaded) == 10
    row = rules.enforce(spark.createDataFrame([("this is it",)], "text string"), loaded).first()
    assert row.enforced == "it $ this" and row.applied == {"opener-worth-noting": 1}
    assert rules.load_rules("{not json") == rules.RULES
    assert rules.load_rules('[{"id": "a", "kind": "odd", "pattern": "x"}]') == rules.RULES


def test_ascii_border(spark):
    df = spark.createDataFrame([("éa re",)], "text string")
    assert rules.enforce(df, [rules.Rule("a", "flag", r"\ba")]).first().flags == {"a": 1}


def test_curate(spark):
    texts = ["{\"a\": 1, \"b\": 2}", "before\n```code```\nError: boom\nafter the fence", "a — b", "", "w " * 401, "x" * 40 + "\nok"]
    rows = curate.curate(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r.route for r in rows] == ["dropped", "curated", "ai-marked", "dropped", "quarantine", "curated"]
    assert rows[1].text == "before\n \nafter the fence" and rows[5].text == "ok"


def test_registers(spark):
    rows = registers.tag(spark.createDataFrame([("hey ok thanks lol",), ("",), ("fix the api and run the test",)], "text string")).collect()
    assert rows[0].register == "informal" and rows[0].register_scores.informal == 8.3
    assert rows[1].register == "technical-instruction" and rows[2].register == "technical-instruction"


def test_salvage(spark):
    body = "Please check the api and fix the token.\n\n" + "word " * 500 + "\n\nnow that is done, run the tests please"
    assert values(spark, curate.salvaged, [body, "one paragraph please", body.replace("token", "to—ken")]) == ["Please check the api and fix the token.\n\nnow that is done, run the tests please", None, None]


def test_text_functions(spark):
    assert values(spark, T.demojibake, ["Ã©tude", "étude", "Καλ", "plain"]) == ["étude", "étude", "Καλ", "plain"]
    assert values(spark, T.splitlines, ["a\r\nb\n", "", "a\x85b", "\n"]) == [["a", "b"], [], ["a", "b"], [""]]
    assert values(spark, T.typo_tokens, ["Hello", "abcdefghijklmnopqrst"]) == [["ello"], ["abcdefghijklmn", "opqrst"]]
    assert values(spark, T.keep, ["[Pasted text #1 +2 lines] hi", "/x", "+", "<a> b", "Caveat: x", "ok"]) == ["hi", None, None, None, None, "ok"]
    assert values(spark, T.stem, ["a/b.c.zip", ".hidden"]) == ["b.c", ".hidden"]


def test_mail(spark):
    dates = {"Thu, 4 Jun 2026 9:05:00 GMT": "Thu, 04 Jun 2026 09:05:00 +0000", "31 Feb 2026 10:00 +0000": "31 Feb 2026 10:00 +0000", "1 Jan 69 10:00 +0000": "Wed, 01 Jan 1969 10:00:00 +0000"}
    assert values(spark, mail.format_date, list(dates)) == list(dates.values())
    assert values(spark, mail.from_address, ["Ann <Ann@Example.org>"]) == ["ann@example.org"]
    assert values(spark, mail.year, ["Thu, 04 Jun 2026 10:00", "1717491600000", "2026-06-04T10:00"]) == [2026, None, None]
    assert values(spark, mail.clean, ["hi all team here today\nOn Mon, Jan 1, Bob wrote:\n> old", "a\n-- \nsig", "> q\nown"]) == ["hi all team here today", "a", "own"]
    assert values(spark, mail.unescape, ["&amp;&#65;&#x42;&hellip;&#150;&nope; &lt"]) == ["&AB…–&nope; <"]


def test_fingerprint(spark):
    docs = spark.createDataFrame([(1, "a b c. D e!", "x"), (2, "hello there friend", "one"), (3, "", "none")], "doc_id long, text string, bucket string")
    rows = {r.bucket: r for r in fingerprint.fingerprint(docs).collect()}
    assert rows["one"].sentence_len.p90 is None and tuple(rows["x"].sentence_len) == (2.5, 2.5, 2.0)
    assert rows["none"].words == 1 and rows["x"].punct_per_1k_words == {".": 200.0, "!": 200.0}
    assert [tuple(o) for o in rows["x"].top_sentence_openers] == [("a", 1), ("d", 1)]


def test_buckets(spark):
    rows = spark.createDataFrame([("b", "1 Jan 2022"), ("b", "1 Jan 2023"), ("b", "1 Jan 2024"), ("b", None)], "bucket string, ts string")
    assert sorted(r.bucket for r in fingerprint.buckets(rows).collect()) == ["b", "b", "b", "b", "b-pre2023", "b-recent"]
    name = spark.range(1).select(fingerprint.source_bucket("email", F.lit("email:my-account")).alias("n")).first().n
    assert name == "email-my"


def test_typos(spark):
    docs = spark.createDataFrame([("b", "the the the there teh walking jumpped " + "jumped " * 6)], "bucket string, text string").withColumn("text", F.concat("text", F.lit(" with with with wiht")))
    words = spark.createDataFrame([("with",), ("jumped",), ("walk",), ("there",)], "form string")
    assert {(r.typo, r.correction, r.n) for r in typos.catalog(docs, words).collect()} == {("wiht", "with", 1), ("jumpped", "jumped", 1)}
    assert typos.dictionary(spark, "/nowhere/at/all").count() == 0


def test_score(spark):
    docs = spark.createDataFrame([(1, "We go. we stay, and wait! It's fine.", "r")], "doc_id long, text string, bucket string")
    prints = fingerprint.fingerprint(docs)
    same = score.score(spark.createDataFrame([("We go. we stay, and wait! It's fine.", "r")], "text string, register string"), prints).first()
    assert same.fidelity > 90 and same.confidence == "low" and same.signals == 0
    with pytest.raises(Exception, match="no fingerprint"):
        score.score(spark.createDataFrame([("x", "other")], "text string, register string"), prints).collect()
    none = score.infer(spark.createDataFrame([(1, "x")], "k int, text string"), prints, "k").first()
    assert (none.register, none.confidence) == ("editorial", "none")


def test_inject_typos():
    text = "the cat and the dog " * 60
    out, n = rewrite.inject(text, {"teh": "the", "hte": "the"}, 20.0)
    assert n == round(20 * 300 / 1000) and out.count("teh") == n and "hte" not in out
    assert rewrite.inject(text, {"teh": "the"}, 20.0) == (out, n)
    assert rewrite.inject("", {}, 20.0) == ("", 0)
    assert rewrite.string_hash("") == 2166136261 and rewrite.string_hash("a") == 0xE40C292C


def test_model_calls(spark):
    def broken(_):
        raise OSError("down")

    drafts = spark.createDataFrame([("a draft",)], "text string")
    row = rewrite.rewrite(drafts, [("first", broken), ("second", lambda q: "Importantly, done.")]).first()
    assert (row.backend, row.rewritten, row.error) == ("second", "done.", None)
    assert rewrite.rewrite(drafts, [("first", broken)]).first().error == "down"
    row = rewrite.judge(drafts, [("m", lambda q: 'so: {"overall": 7, "evidence": ["x"]} ok')]).first()
    assert (row.overall, row.evidence, row.register_match) == (7.0, ["x"], None)


def test_transcripts(spark, tmp_path):
    line = lambda content, **more: json.dumps({"type": "user", "message": {"content": content}, "timestamp": "2026-01-01"} | more)
    for folder in ("-home-a-projects-tool", ".archive/old"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "-home-a-projects-tool/s1.jsonl").write_text("\n".join([line("hello you"), "{bad", "[1]", line([{"type": "text", "text": "two"}, {"type": "image"}, {"type": "text", "text": "hello you"}]), line("no", isSidechain=True), json.dumps({"type": "assistant", "message": {"content": "x"}})]))
    (tmp_path / ".archive/old/s2.jsonl").write_text(line("archived") + "\r\n" + line([{"type": "text", "text": 5}]))
    rows = extract.extract(spark, str(tmp_path)).collect()
    assert sorted((r.project, r.session, r.words, r.text) for r in rows) == [("old", "s2", 1, "archived"), ("tool", "s1", 1, "two"), ("tool", "s1", 2, "hello you")]
    assert extract.extract(spark, str(tmp_path / "none")).count() == 0


def test_chat(spark, tmp_path):
    def thread(*said):
        return json.dumps({"messages": [{"sender_name": s, "timestamp_ms": i, "content": c} for i, (s, c) in enumerate(said)]})

    with zipfile.ZipFile(tmp_path / "facebook-a-2024.zip", "w") as z:
        z.writestr("x/inbox/t1/message_1.json", thread(("AnÃ©", "hello to you all"), ("B", "not mine at all")))
        z.writestr("x/inbox/t2/message_1.json", thread(("AnÃ©", "see https://x.y now please"), ("C", "x")))
        z.writestr("x/inbox/t3/message_1.json", "{bad")
    (tmp_path / "message_1.json").write_text(thread(("AnÃ©", "short one"), ("AnÃ©", "three words here")))
    got = sorted((r.source, r.text) for r in chat.ingest(spark, str(tmp_path)).collect())
    assert got == [("chat:chat", "three words here"), ("chat:facebook", "hello to you all"), ("chat:facebook", "see   now please")]


def test_mailboxes(spark, tmp_path):
    def message(sender, body, kind="text/plain"):
        return f"From x\nFrom: {sender}\nDate: Thu, 4 Jun 2026 9:05:00 GMT\nContent-Type: {kind}\n\n{body}\n"

    own = message("Ann <ann@x.org>", "this is what I wrote today") + message("ann@x.org", "<p>and &amp; this one is html</p><style>x</style>", "text/html") + message("bob@x.org", "not mine at all is it")
    (tmp_path / "sent.mbox").write_text("preamble\n" + own)
    with zipfile.ZipFile(tmp_path / "take.zip", "w") as z:
        z.writestr("a/Sent Mail.mbox", message("eve@x.org", "one two three four five"))
        z.writestr("a/Inbox.mbox", message("eve@x.org", "never read this message at all"))
    with zipfile.ZipFile(tmp_path / "o.olm", "w") as z:
        z.writestr("Sent Items/1.xml", "<e><OPFMessageCopySentTime>2026-06-04T10:00:00</OPFMessageCopySentTime><OPFMessageCopySenderAddress><a OPFContactEmailAddressAddress=\"zoe@x.org\"/></OPFMessageCopySenderAddress><OPFMessageCopyBody>six words are in this body</OPFMessageCopyBody></e>")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    got = sorted((r.source, r.ts, r.text) for r in email.ingest(spark, str(tmp_path)).collect())
    assert got == [
        ("email:o", "2026-06-04T10:00:00", "six words are in this body"),
        ("email:sent", "Thu, 04 Jun 2026 09:05:00 +0000", "and & this one is html"),
        ("email:sent", "Thu, 04 Jun 2026 09:05:00 +0000", "this is what I wrote today"),
        ("email:take-Sent Mail", "Thu, 04 Jun 2026 09:05:00 +0000", "one two three four five"),
    ]
    assert archives.split_mbox(b"x\nFrom a\nb\n") == [b"b\n"]


def test_strict_reader(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "words": 1}\n\n')
    assert corpus.read_jsonl(spark, str(tmp_path / "a.jsonl"), "text string, words int").count() == 1
    (tmp_path / "b.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):
        corpus.read_jsonl(spark, str(tmp_path / "b.jsonl"), "text string, words int").collect()


def test_folders(tmp_path):
    assert config.folders({}, str(tmp_path)).corpus == f"{tmp_path}/corpus"
    assert config.folders({"SCRIVANO_HOME": "/h", "SCRIVANO_PROFILES": "/p"}) == config.Folders("/h/corpus", "/p")


def test_feedback(spark, tmp_path):
    rows = spark.createDataFrame([("r", v) for v in ("bad", "bad", "bad", "good", "odd")], "register string, verdict string")
    row = rewrite.feedback_counts(rows).first()
    assert (row.good, row.fine, row.bad, row.due) == (1, 0, 3, True)
    corpus.append_feedback(rewrite.feedback_rows(rows.withColumn("note", F.lit("n" * 600))), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).where("length(note) = 500").count() == 5


