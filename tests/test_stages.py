"""The commands over folders, from transcripts to a score, and the stream."""

import json

import pytest

from scrivano import cli
from scrivano.streaming import transcripts as stream


@pytest.fixture
def home(tmp_path, monkeypatch):
    monkeypatch.setenv("SCRIVANO_HOME", str(tmp_path))
    folder = tmp_path / "t/-projects-tool"
    folder.mkdir(parents=True)
    body = "Please check the api and fix the token.\n\n" + "word " * 500 + "\n\nnow that is done, run the tests please"
    texts = ["fix the build, please. It's broken!", "hey ok thanks lol", body, "a — b c d", "hey ok thanks lol"]
    (folder / "s.jsonl").write_text("\n".join(json.dumps({"type": "user", "message": {"content": t}, "timestamp": f"2026-01-0{i + 1}"}) for i, t in enumerate(texts)))
    (tmp_path / "draft.txt").write_text("fix the build, please. It's broken!")
    return tmp_path


def test_commands(spark, home, capsys):
    assert cli.main(["curate"]) == 1
    assert cli.main(["extract", str(home / "t")]) == 0
    for command in ("curate", "tag", "salvage", "fingerprint"):
        assert cli.main([command]) == 0
    rows = {r.bucket: r.messages for r in spark.read.json(str(home / "profiles/fingerprint")).collect()}
    assert rows == {"technical-instruction": 2, "informal": 1}
    assert cli.main(["score", str(home / "draft.txt"), "--register", "technical-instruction"]) == 0
    assert cli.main(["enforce", str(home / "draft.txt")]) == 0 and cli.main(["rules", "--test"]) == 0 and cli.main(["rules"]) == 0
    said = capsys.readouterr().out
    assert '"fidelity"' in said and '"deltas"' in said and '"failures": 0' in said and '"id": "bold-sprinkle"' in said
    lines = [r.value for r in spark.read.text(str(home / "corpus/stats.md")).collect()]
    assert lines[2] == "Messages: 4, words: 531, duplicates skipped: 1" and lines[-1] == "| tool | 4 | 531 |"
    assert [r.value for r in spark.read.text(str(home / "corpus/stats-curated.md")).collect()][-2:] == ["AI-marked: 1 messages", "Dropped: 0"]
    assert cli.main(["score", str(home / "draft.txt"), "--register", "none"]) == 1
    assert "no fingerprint for register none" in capsys.readouterr().err


def test_overlay_and_models(spark, home, capsys, monkeypatch):
    (home / "overlay.json").write_text(json.dumps([{"id": "own", "kind": "replace", "pattern": "build", "replacement": "house"}]))
    assert cli.main(["enforce", str(home / "draft.txt"), "--overlay", str(home / "overlay.json")]) == 0
    assert "fix the house" in capsys.readouterr().out
    assert cli.main(["rewrite", str(home / "draft.txt")]) == 1
    assert cli.main(["rewrite", str(home / "draft.txt"), "--backend", "builtins:str"]) == 0
    assert "fix the build" in capsys.readouterr().out


def test_stream(spark, home):
    stream.run(spark, str(home / "t/*/*.jsonl"), str(home / "out"), str(home / "check")).awaitTermination()
    rows = spark.read.parquet(str(home / "out")).collect()
    assert sorted(r.route for r in rows) == ["ai-marked", "curated", "curated", "quarantine"]
    assert all(r.lang == "en" for r in rows)


def test_windowed_counts(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert sum(r.n for r in stream.windowed_counts(events).collect()) == events.count()
