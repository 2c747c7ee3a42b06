"""Commands: each stage and report over folders.

Stages print aggregates, never texts, names or addresses. `enforce` and `rewrite` print the given draft as they leave it, and
their reports go to stderr.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scrivano import config, schemas
from scrivano.operators import chat, curate, email, extract, fingerprint, registers, rewrite, rules, score, typos
from scrivano.sources import archives, corpus


class Failed(Exception):
    """A command that can't go on; its message is what the user is told."""


def _known(found, said: str):
    if found is None:
        raise Failed(said)
    return found


def _rules(args) -> list[rules.Rule]:
    """The built-in rules, with the overlay file where one is given."""
    return rules.load_rules(open(args.overlay, encoding="utf-8").read() if args.overlay else None)


def _backends(args) -> list[rewrite.Backend]:
    """Callables named as module:function, in the order in which they are asked."""
    found = []
    for name in args.backend or ():
        module, _, function = name.partition(":")
        found.append((name, getattr(importlib.import_module(module), function)))
    if not found:
        raise Failed("name a model with --backend module:function")
    return found


def _profiles(spark, where):
    try:
        return spark.read.schema(schemas.PROFILE).json(f"{where.profiles}/fingerprint")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise Failed("fingerprint first") from None


def run_extract(spark, where, args) -> None:
    root = config.transcript_root(args.path)
    rows = extract.extract(spark, root)
    rows.orderBy("file", "line_no", "block_no").drop("file", "line_no", "block_no").write.mode("overwrite").json(f"{where.corpus}/raw-sessions.jsonl")
    every = extract.messages(extract.transcripts.user_blocks(extract.transcripts.sessions(spark, root))).withColumn("at", F.struct("file", "line_no", "block_no"))
    corpus.write_lines(extract.stats(every, "at"), f"{where.corpus}/stats.md", ["part", "at"])
    stored = corpus.read_jsonl(spark, f"{where.corpus}/raw-sessions.jsonl", schemas.RAW)
    print(json.dumps({"messages": stored.count(), "bands": {r.band: r.messages for r in extract.length_bands(stored).collect()}}))


def run_curate(spark, where, args) -> None:
    raw = _known(corpus.optional_jsonl(spark, f"{where.corpus}/raw-sessions.jsonl", schemas.RAW), "extract first")
    done = curate.curate(raw)
    curate.write_routes(done, where.corpus)
    corpus.write_lines(curate.stats(done), f"{where.corpus}/stats-curated.md", ["at"])
    print(json.dumps({r.route: [r.messages, r.words] for r in curate.route_totals(done).collect()}))


def run_tag(spark, where, args) -> None:
    rows = _known(corpus.optional_jsonl(spark, f"{where.corpus}/curated", schemas.CURATED), "curate first")
    registers.tag(rows).write.mode("overwrite").json(f"{where.corpus}/tagged.jsonl")
    stored = corpus.read_jsonl(spark, f"{where.corpus}/tagged.jsonl", schemas.TAGGED, placed=True)
    print(json.dumps({r.register: [r.messages, r.words] for r in registers.distribution(stored, "place").collect()}))


def run_salvage(spark, where, args) -> None:
    rows, own = (_known(corpus.optional_jsonl(spark, f"{where.corpus}/{n}", schemas.CURATED, placed=True), "curate first") for n in ("quarantine", "curated"))
    curate.salvage(rows, own, ["place"]).drop("place").write.mode("overwrite").json(f"{where.corpus}/salvaged.jsonl")


def run_chat(spark, where, args) -> None:
    corpus.write_by_source(chat.ingest(spark, args.path or f"{where.corpus}/inbox", args.owner), f"{where.corpus}/chat-export.jsonl")
    stored = corpus.read_jsonl(spark, f"{where.corpus}/chat-export.jsonl", schemas.CHAT)
    print(json.dumps({"kept": stored.count(), "words": {r.lang: r.words for r in chat.words_by_language(stored).collect()}}))


def run_email(spark, where, args) -> None:
    inbox = args.path or f"{where.corpus}/inbox"
    email.ingest(spark, inbox).write.mode("overwrite").json(f"{where.corpus}/email-sent.jsonl")
    counted = email.counters(email.judged(archives.mail_messages(spark, inbox))).first()
    print(json.dumps(counted.asDict()))


def run_fingerprint(spark, where, args) -> None:
    parts = corpus.listing(spark, where.corpus)
    if all(p is None for p in parts):
        raise Failed("there is no corpus")
    english, cadence = fingerprint.corpus_buckets(*parts)
    prints = fingerprint.fingerprint(english, order="place")
    found = typos.catalog(english, typos.dictionary(spark, args.words))
    rates = typos.rates(found, prints)
    corpus.write_profiles(prints.join(rates, "bucket", "left"), f"{where.profiles}/fingerprint")
    found.write.mode("overwrite").partitionBy("bucket").json(f"{where.profiles}/typos")
    corpus.write_profiles(fingerprint.rhythm(cadence.withColumn("bucket", F.concat("bucket", F.lit("-rhythm"))), order="place"), f"{where.profiles}/rhythm")


def run_enforce(spark, where, args) -> None:
    row = rules.enforce(corpus.whole_text(spark, args.path), _rules(args)).first()
    print(row.enforced)
    print(json.dumps({"applied": row.applied, "flags": row.flags}), file=sys.stderr)


def run_score(spark, where, args) -> None:
    drafts = corpus.whole_text(spark, args.path).withColumn("register", F.lit(args.register))
    prints = _profiles(spark, where)
    score.require(drafts, prints)
    row = score.score(drafts, prints, _rules(args)).withColumn("deltas", score.deltas()).first()
    said = {"fidelity": round(row.fidelity, 1), "confidence": row.confidence, "model_ism_signals": row.signals, "deltas": {k: [v.text, v.register] for k, v in row.deltas.items()}}
    if args.judge:
        judged = rewrite.judge(drafts, _backends(args)).first()
        said["judge"] = {k: judged[k] for k in ("register_match", "quirk_fidelity", "model_ism_freedom", "overall", "evidence", "backend", "error")}
    print(json.dumps(said))


def run_rewrite(spark, where, args) -> None:
    drafts = corpus.whole_text(spark, args.path)
    for name in ("guide", "avoid"):
        if getattr(args, name):
            drafts = drafts.withColumn(name, F.lit(open(getattr(args, name), encoding="utf-8").read()))
    row = rewrite.rewrite(drafts, _backends(args), _rules(args)).first()
    if row.rewritten is None:
        raise Failed(f"no model answered: {row.error}")
    print(row.rewritten)
    print(json.dumps({"backend": row.backend, "applied": row.applied, "flags": row.flags}), file=sys.stderr)


def run_blind(spark, where, args) -> None:
    """Texts of the author and of the generated file in random order, and apart from them the truth."""
    tagged = _known(corpus.optional_jsonl(spark, f"{where.corpus}/tagged.jsonl", schemas.TAGGED), "tag first")
    shown = rewrite.blind_sample(rewrite.blind_candidates(tagged, args.register), rewrite.generated_snippets(corpus.whole_text(spark, args.path)), args.n, args.seed).collect()
    for i, r in enumerate(shown, 1):
        print(f"--- {i}\n{r.text}")
    print(json.dumps({i: r.truth for i, r in enumerate(shown, 1)}), file=sys.stderr)


def run_rules(spark, where, args) -> int:
    if not args.test:
        for r in rules.rules_table(spark, _rules(args)).orderBy("position").collect():
            print(json.dumps({"id": r.id, "kind": r.kind, "tests": r.tests}))
        return 0
    found = rules.selftest(spark)
    for line in found.pop("said"):
        print(line, file=sys.stderr)
    print(json.dumps(found))
    return int(found["failures"] > 0)


def run_serve(spark, where, args) -> None:
    from scrivano import server

    server.serve(spark, where, args.port)


COMMANDS = {"extract": run_extract, "curate": run_curate, "tag": run_tag, "salvage": run_salvage, "ingest-chat": run_chat, "ingest-email": run_email, "fingerprint": run_fingerprint, "enforce": run_enforce, "score": run_score, "rewrite": run_rewrite, "blind": run_blind, "rules": run_rules, "serve": run_serve}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scrivano")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("path", nargs="?")
    parser.add_argument("--register", default="editorial")
    parser.add_argument("--owner")
    parser.add_argument("--words", default="/usr/share/dict/words")
    parser.add_argument("--overlay", help="a JSON file of rules that replace or follow the built-in ones")
    parser.add_argument("--guide", help="a style guide for the model")
    parser.add_argument("--avoid", help="what the model should avoid")
    parser.add_argument("--backend", action="append", help="module:function, from prompt to answer; the first that answers counts")
    parser.add_argument("--judge", action="store_true")
    parser.add_argument("--test", action="store_true")
    parser.add_argument("-n", type=int, default=5)
    parser.add_argument("--seed", type=int, default=1)
    parser.add_argument("--port", type=int, default=4177)
    args = parser.parse_args(argv)
    try:
        return COMMANDS[args.command](SparkSession.builder.getOrCreate(), config.folders(), args) or 0
    except (Failed, score.ProfileNotFound) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
