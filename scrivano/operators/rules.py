"""Rules that remove, replace or flag phrases: ordered folds of Column expressions."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano import constants as C

KINDS = ("remove", "replace", "flag")


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    pattern: str
    replacement: str = ""
    tests: tuple = field(default_factory=tuple)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"rule {self.id}: there is no kind {self.kind}")


def _rule(raw: dict) -> Rule:
    return Rule(raw["id"], raw["kind"], raw["pattern"], raw.get("replacement") or "", tuple(raw.get("tests") or ()))


RULES = [_rule(r) for r in C.RULES]


def load_rules(overlay: str | None = None) -> list[Rule]:
    """The built-in rules with an overlay (JSON text): the same id replaces in place, a new one comes last.

    An overlay that isn't an array of rules leaves the built-in ones; entries before a bad one count.
    """
    rules = list(RULES)
    try:
        for raw in json.loads(overlay) if overlay else ():
            rule = _rule(raw)
            at = next((i for i, r in enumerate(rules) if r.id == rule.id), None)
            if at is None:
                rules.append(rule)
            else:
                rules[at] = rule
    except (ValueError, KeyError, TypeError, AttributeError):
        pass
    return rules


def java_pattern(pattern: str) -> str:
    """A pattern of the rules' dialect for this engine: \\b is an ASCII border, \\s the wide white-space set."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two, c = pattern[i : i + 2], pattern[i]
        if two == r"\b" and not inside:
            out.append(C.ASCII_BORDER)
            i += 2
        elif two == r"\s":
            out.append(C.JS_WS if inside else f"[{C.JS_WS}]")
            i += 2
        elif c == "\\":
            out.append(two)
            i += 2
        else:
            inside = c == "[" or inside and c != "]"
            out.append(c)
            i += 1
    return "".join(out)


def java_replacement(text: str) -> str:
    r"""\1 to \9, \0, \g<n> and \\ of a replacement for this engine, whose own signs are quoted."""

    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            return f"${m[1] or m[2]}"
        if m[3] is not None:
            return "\\\\" if m[3] == "\\" else re.sub(r"([\\$])", r"\\\1", m[3])
        return f"\\{m[0]}"

    return re.sub(r"\\(?:([0-9])|g<([0-9]+)>|(.))|[$\\]", one, text, flags=re.S)


def enforce(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", out: str = "enforced") -> DataFrame:
    """df with the rewritten text, and maps `applied` and `flags` of counts above zero.

    Rules run in their order, so flags are counted on what earlier rules have left.
    """
    rules = RULES if rules is None else rules
    df = df.withColumn(out, F.col(text))
    for i, r in enumerate(rules):
        p = java_pattern(r.pattern)
        if r.kind == "flag":
            df = df.withColumn(f"_r{i}", F.regexp_count(out, F.lit(f"(?i){p}")))
        else:
            df = df.withColumn(f"_r{i}", F.regexp_count(out, F.lit(p))).withColumn(out, F.regexp_replace(out, p, java_replacement(r.replacement) if r.kind == "replace" else ""))

    def counts(flag: bool) -> Column:
        chosen = [(i, r) for i, r in enumerate(rules) if (r.kind == "flag") == flag]
        if not chosen:
            return F.create_map().cast("map<string, int>")
        return F.map_filter(F.map_from_arrays(F.array(*(F.lit(r.id) for _, r in chosen)), F.array(*(F.col(f"_r{i}") for i, _ in chosen))), lambda _, v: v > 0)

    df = df.withColumns({"applied": counts(False), "flags": counts(True), out: F.regexp_replace(out, r"[ \t]{2,}", " ")})
    return df.drop(*(f"_r{i}" for i in range(len(rules))))


def signals(applied: Column, flags: Column) -> Column:
    """The number of all hits."""
    return F.aggregate(F.concat(F.map_values(applied), F.map_values(flags)), F.lit(0), lambda a, v: a + v)


def rules_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    return spark.createDataFrame([(i, r.id, r.kind, r.pattern, r.replacement, len(r.tests)) for i, r in enumerate(RULES if rules is None else rules)], "position int, id string, kind string, pattern string, replacement string, tests int")


def selftest(spark: SparkSession, rules: list[Rule] | None = None) -> dict:
    """Runs each rule's own cases and, for the built-in rules, the cases of the whole fold: numbers of rules, tests and
    failures, and what is said of each failure."""
    failures = tests = 0
    said = []
    for own in [[r] for r in (RULES if rules is None else rules)] + ([RULES] if rules is None else []):
        cases = list(own[0].tests) if len(own) == 1 else C.PIPELINE_TESTS
        if not cases:
            continue
        got = enforce(spark.createDataFrame([(i, c["in"]) for i, c in enumerate(cases)], "i int, text string"), own).orderBy("i").collect()
        for case, row in zip(cases, got):
            tests += 1
            if "out" in case and row.enforced != case["out"] or "flags" in case and sum(row.flags.values()) != case["flags"]:
                failures += 1
                said.append(f"{own[0].id if len(own) == 1 else 'pipeline'}: {case['in']!r} gave {row.enforced!r} and {sum(row.flags.values())} flags")
    return {"rules": len(RULES if rules is None else rules), "tests": tests, "failures": failures, "said": said}
