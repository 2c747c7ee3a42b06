"""Stylometric scores of drafts against fingerprints, without any model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivano import constants as C
from scrivano.functions import text as T
from scrivano.operators import rules

FULL_WORDS, CLEAR_MARGIN = 250, 15.0
HINTS = ((30000, "high", "deep sampling"), (8000, "medium", "usable; more samples would help"), (0, "low", "thin sampling; add more writing"))


class ProfileNotFound(LookupError):
    """A draft names a register that has no fingerprint."""


def metrics(drafts: DataFrame, text: str = "text") -> DataFrame:
    """drafts with n_words (1 at least) and the six measures, unrounded; sent_p50 is the upper median of all sentences."""
    t = F.col(text)
    df = drafts.withColumns({"n_words": F.greatest(F.size(T.words(t)), F.lit(1)), "_s": T.sentences(t)})
    lengths = F.array_sort(F.transform("_s", lambda s: F.size(T.words(s))))
    k = F.col("n_words")

    def per(count: Column) -> Column:
        return count * F.lit(1000.0) / k

    return df.withColumns({
        "emdash_per_1k": per(T.occurrences(t, "—")), "comma_per_1k": per(T.occurrences(t, ",")), "excl_per_1k": per(T.occurrences(t, "!")), "contractions_per_1k": per(T.contractions(t)),
        "sent_p50": F.coalesce(F.get(lengths, F.floor(F.size("_s") / 2).cast("int")), F.lit(0)),
        "lower_start_rate": F.size(F.filter("_s", T.first_is_lower)) / F.greatest(F.size("_s"), F.lit(1)).cast("double"),
    }).drop("_s")


def references(prints: DataFrame) -> DataFrame:
    """register and the six reference values (ref_ and the metric's name) of fingerprints."""

    def mark(p: str) -> Column:
        return F.coalesce(F.try_element_at("punct_per_1k_words", F.lit(p)), F.lit(0.0))

    values = (mark("—"), mark(","), mark("!"), F.col("contractions_per_1k"), F.col("sentence_len.p50"), F.col("lowercase_sentence_start_rate"))
    return prints.select(F.col("bucket").alias("register"), *(v.cast("double").alias(f"ref_{m[0]}") for m, v in zip(C.METRICS, values)))


def fidelity(measured: DataFrame) -> DataFrame:
    """measured (metrics, ref_ columns, signals) with fidelity (0 to 100, unrounded) and confidence."""
    damp = F.least(F.lit(1.0), F.col("n_words") / 250.0)
    penalty = weight = F.lit(0.0)
    for name, scale, w, noisy in C.METRICS:
        own = F.lit(w) * damp if noisy else F.lit(w)
        penalty = penalty + F.least(F.abs(F.col(name) - F.col(f"ref_{name}")) / scale, F.lit(1.0)) * own
        weight = weight + own
    value = F.greatest(F.lit(0.0), (1 - penalty / weight) * (1 - F.least(F.col("signals") * 0.06, F.lit(0.4)))) * 100
    return measured.withColumns({"fidelity": value, "confidence": F.when(F.col("n_words") >= FULL_WORDS, "ok").otherwise("low")})


def with_signals(drafts: DataFrame, own_rules: list[rules.Rule] | None = None, text: str = "text") -> DataFrame:
    return rules.enforce(drafts, own_rules, text).withColumn("signals", rules.signals(F.col("applied"), F.col("flags"))).drop("applied", "flags", "enforced")


def score(drafts: DataFrame, prints: DataFrame, own_rules: list[rules.Rule] | None = None) -> DataFrame:
    """drafts (text, register) with metrics, references, signals, fidelity and confidence; an unknown register is an error."""
    joined = with_signals(metrics(drafts), own_rules).join(references(prints), "register", "left")
    missing = F.raise_error(F.concat(F.lit("no fingerprint for register "), F.coalesce("register", F.lit("(none)"))))
    return fidelity(joined.withColumn("ref_sent_p50", F.when(F.col("ref_contractions_per_1k").isNull(), missing.cast("double")).otherwise(F.col("ref_sent_p50"))))


def require(drafts: DataFrame, prints: DataFrame) -> None:
    """Raises ProfileNotFound where a draft names a register that has no fingerprint."""
    missing = drafts.select("register").distinct().join(prints.select(F.col("bucket").alias("register")), "register", "left_anti").limit(5).collect()
    if missing:
        raise ProfileNotFound("no fingerprint for register " + ", ".join(sorted(r.register or "(none)" for r in missing)))


def deltas() -> Column:
    """A map from each metric to its values in the text and in the register."""
    return F.create_map(*(x for m in C.METRICS for x in (F.lit(m[0]), F.struct(F.col(m[0]).cast("double").alias("text"), F.col(f"ref_{m[0]}").alias("register")))))


def sampling(words: Column) -> tuple[Column, Column]:
    """Confidence and hint for a register's number of words."""
    level = hint = None
    for least, name, said in reversed(HINTS):
        level = F.lit(name) if level is None else F.when(words >= least, name).otherwise(level)
        hint = F.lit(said) if hint is None else F.when(words >= least, said).otherwise(hint)
    return level, hint


def _choosable(prints: DataFrame) -> DataFrame:
    """Without those split off for years before 2023."""
    return prints.where(~F.col("bucket").endswith("-pre2023"))


def registers_info(prints: DataFrame) -> DataFrame:
    """Registers to choose from, in order of name: those split off for years before 2023 aren't."""
    level, hint = sampling(F.col("words"))
    return _choosable(prints).select(F.col("bucket").alias("register"), "words", level.alias("confidence"), hint.alias("hint")).orderBy("register")


def infer(drafts: DataFrame, prints: DataFrame, key: str, own_rules: list[rules.Rule] | None = None) -> DataFrame:
    """For each draft the register of the highest fidelity among those of more than low confidence: key, register, score,
    margin to the second (the score itself where there is none) and confidence. Drafts are measured once.

    The few profiles of one person go to each draft; the planner broadcasts them if their size allows.
    """
    refs = references(_choosable(prints).where(sampling(F.col("words"))[0] != "low"))
    scored = fidelity(with_signals(metrics(drafts), own_rules).drop("register").join(refs, F.lit(True))).select(key, "register", "fidelity")
    by = Window.partitionBy(key).orderBy(F.desc("fidelity"), F.desc("register"))
    best = scored.withColumns({"place": F.row_number().over(by), "second": F.lead("fidelity").over(by)}).where("place = 1")
    best = best.withColumn("margin", F.col("fidelity") - F.coalesce("second", F.lit(0.0)))
    found = drafts.select(key).join(best, key, "left")
    level = F.when(F.col("register").isNull(), "none").when(F.col("margin") >= CLEAR_MARGIN, "high").otherwise("low")
    return found.select(key, F.coalesce("register", F.lit("editorial")).alias("register"), F.col("fidelity").alias("score"), "margin", level.alias("confidence"))
