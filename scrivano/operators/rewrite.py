"""Rewriting by an injected model, typing errors put back, blind samples and feedback."""

from __future__ import annotations

import json
import re
import subprocess
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivano.functions import text as T
from scrivano.operators import rules
from scrivano.sources.shared import small_batches

Backend = tuple[str, Callable[[str], str]]
VERDICTS = ("good", "fine", "bad")


def prompt(draft: Column, guide: Column | None = None, avoid: Column | None = None) -> Column:
    """What a model is asked: the style guide, what to avoid, and the draft."""
    parts = [F.lit("Rewrite the draft so that it reads as its author writes. Keep meaning and facts. Answer with the text alone.\n")]
    for name, part in (("STYLE", guide), ("AVOID", avoid), ("DRAFT", draft)):
        if part is not None:
            parts += [F.when(part.isNotNull(), f"== {name} =="), part]
    return F.concat_ws("\n", *parts)


def ask(df: DataFrame, question: str, backends: Sequence[Backend], out: str = "answer") -> DataFrame:
    """df with the first backend's answer that comes, the backend's name, and the last error where none did."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, names, errors = [], [], []
            for q in batch.column(question).to_pylist():
                answer = name = error = None
                for name, call in backends:
                    try:
                        answer, error = call(q), None
                        break
                    except Exception as e:  # noqa: BLE001  the next backend is asked
                        name, error = None, str(e)
                answers.append(answer), names.append(name), errors.append(error)
            kept = [i for i, n in enumerate(batch.schema.names) if n not in (out, "backend", "error")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(x, pa.string()) for x in (answers, names, errors))], names=[*(batch.schema.names[i] for i in kept), out, "backend", "error"])

    kept = [f for f in df.schema.fields if f.name not in (out, "backend", "error")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` string", "backend string", "error string"])
    return df.mapInArrow(run, schema)


def command(argv: Sequence[str], timeout: float = 600) -> Callable[[str], str]:
    """A backend that a local program is: the prompt goes to its standard input, its standard output is the answer."""

    def run(question: str) -> str:
        done = subprocess.run(list(argv), input=question, capture_output=True, text=True, timeout=timeout)
        if done.returncode or not done.stdout.strip():
            raise RuntimeError(done.stderr.strip()[-200:] or f"{argv[0]} gave no answer")
        return done.stdout.strip()

    return run


def http(url: str, headers: dict[str, str], request: Callable[[str], dict], answer: Callable[[dict], str], timeout: float = 300) -> Callable[[str], str]:
    """A backend behind a URL: request makes the JSON that is posted, answer takes the text out of the JSON that comes."""

    def run(question: str) -> str:
        asked = urllib.request.Request(url, json.dumps(request(question)).encode(), {"Content-Type": "application/json", **headers})
        with urllib.request.urlopen(asked, timeout=timeout) as got:
            return answer(json.loads(got.read()))

    return run


def rewrite(drafts: DataFrame, backends: Sequence[Backend], own_rules: list[rules.Rule] | None = None) -> DataFrame:
    """drafts (text, and guide and avoid if they have them) with the model's text after the rules."""
    guide, avoid = (F.col(c) if c in drafts.columns else None for c in ("guide", "avoid"))
    answered = ask(drafts.withColumn("prompt", prompt(F.col("text"), guide, avoid)), "prompt", backends)
    return rules.enforce(answered, own_rules, "answer", "rewritten")


def json_object(text: Column) -> Column:
    """The text from the first { to the last }, as a variant; null where it is no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def judge(drafts: DataFrame, backends: Sequence[Backend]) -> DataFrame:
    """drafts with four scores and evidence of a model beside any other score, or an error."""
    keys = ("register_match", "quirk_fidelity", "model_ism_freedom", "overall")
    question = F.concat_ws("\n", F.lit(f"Judge from 0 to 100 whether the text is its author's: a JSON object of {', '.join(keys)} and evidence, a list of up to three phrases."), F.lit("== TEXT =="), F.col("text"))

    def checked(call: Callable[[str], str]) -> Callable[[str], str]:
        def run(q: str) -> str:
            found = re.search(r"(?s)\{.*\}", call(q))
            if not found:
                raise ValueError("no JSON in the answer")
            return json.dumps(json.loads(found[0]))

        return run

    answered = ask(drafts.withColumn("question", question), "question", [(n, checked(c)) for n, c in backends])
    found = F.try_parse_json("answer")
    return answered.select("*", *(F.try_variant_get(found, f"$.{k}", "double").alias(k) for k in keys), F.try_variant_get(found, "$.evidence", "array<string>").alias("evidence")).drop("question", "answer")


def string_hash(text: str) -> int:
    """FNV-1a of 32 bits over UTF-16 units."""
    h = 2166136261
    units = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (h ^ (units[i] | units[i + 1] << 8)) * 16777619 & 0xFFFFFFFF
    return h


def random_numbers(seed: int) -> Iterator[float]:
    """The mulberry32 generator."""
    state, mask = seed & 0xFFFFFFFF, 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & mask
        x = (state ^ state >> 15) * (1 | state) & mask
        x = (x + ((x ^ x >> 7) * (61 | x) & mask) & mask) ^ x
        yield ((x ^ x >> 14) & mask) / 4294967296


def inject(text: str, catalog: dict[str, str], rate: float) -> tuple[str, int]:
    """Typing errors of a catalog (typo to correction, in order) at a rate in a thousand words.

    Words are chosen by a shuffle that depends on the text; each keeps its place in the original text.
    """
    by_word: dict[str, str] = {}
    for typo, correct in catalog.items():
        by_word.setdefault(correct, typo)
    count = round(rate * len(re.findall(r"[a-z']+", text.lower())) / 1000)
    if count <= 0:
        return text, 0
    places = [(m.start(), m[0]) for m in re.finditer(r"\b[a-z']+\b", text, re.ASCII) if m[0] in by_word]
    numbers = random_numbers(string_hash(text))
    for i in range(len(places) - 1, 0, -1):
        j = int(next(numbers) * (i + 1))
        places[i], places[j] = places[j], places[i]
    for start, word in places[:count]:
        text = text[:start] + by_word[word] + text[start + len(word) :]
    return text, len(places[:count])


def inject_typos(df: DataFrame, catalog: dict[str, str], rate: float, text: str = "text") -> DataFrame:
    """df with text_typos and typos_injected; the catalog is one register's, of bounded size."""
    small_batches(df.sparkSession)

    @F.arrow_udf("struct<text: string, n: long>")
    def run(texts: pa.Array) -> pa.Array:
        done = [(None, 0) if t is None else inject(t, catalog, rate) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["text", "n"])

    return df.withColumn("_i", run(F.col(text))).withColumns({"text_typos": F.col("_i.text"), "typos_injected": F.col("_i.n")}).drop("_i")


def blind_candidates(tagged: DataFrame, register: str) -> DataFrame:
    n = T.py_word_count(F.col("text"))
    return tagged.where((F.col("register") == register) & (n >= 25) & (n <= 120))


def generated_snippets(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(T.paragraphs(F.col("text"))).alias("text")).withColumn("text", T.js_trim(F.col("text"))).where(T.py_word_count(F.col("text")) >= 15)


def _order(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("text")).cast("binary"))


def blind_sample(own: DataFrame, generated: DataFrame, n: int, seed: int) -> DataFrame:
    """n of the author's texts and n generated ones in random order, cut to what is shown; the seed fixes them."""

    def some(df: DataFrame, truth: str, salt: int) -> DataFrame:
        return df.select("text").orderBy(_order(seed + salt), "text").limit(n).select(F.substring("text", 1, 400).alias("text"), F.lit(truth).alias("truth"))

    return some(own, "author", 0).unionByName(some(generated, "model", 1)).orderBy(_order(seed + 2), "text")


def blind_rate(answers: DataFrame) -> DataFrame:
    """The share of right answers (truth, answer); null where there are none."""
    return answers.agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("answer")).cast("int")).alias("rate"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Verdicts of each register, and whether a look at the profile is due: three bad ones, and more bad than good."""
    counts = [F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in VERDICTS]
    return feedback.where(F.col("verdict").isin(*VERDICTS)).groupBy("register").agg(*counts).withColumn("due", (F.col("bad") >= 3) & (F.col("bad") > F.col("good")))


def feedback_rows(df: DataFrame) -> DataFrame:
    return df.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "register", "verdict", F.substring("note", 1, 500).alias("note"))
