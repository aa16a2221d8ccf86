"""Quality rules: a decision list learned by sequential covering, and the statistics that it reads.

All statistics are built-in expressions over the text. The learner works on the statistics of labelled texts: it
grows a conjunction of thresholds by information gain on part of them, prunes it on the rest, keeps it while it is
precise there, takes away what it covers, and goes on. The list becomes one ordered conditional expression; the
first rule that holds decides, and a text that no rule covers is kept. The rules reject; the default keeps.

The list is learned from at most `per_class` labelled rows of either label, drawn by a hash of their ids, whose
statistics alone come to the driver. Statistics, thresholds and verdicts are of every whole text.

Defined cases: a null text has no words and zero statistics; blank lines are never repeated lines; texts of fewer
than three words have no windows; with no labelled row, or one label only, the list is empty and only base_failed
decides; labels that are null, repeated or of unknown ids teach nothing or once; repeated rows get equal verdicts; an
empty table gives an empty result; other columns pass through unless a statistic takes the name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PER_CLASS = 2500
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: What rules may test, from the statistics.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "exclaim_per_word": "n_exclaims / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, computed once wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """How many words stand in a three-word window that the text has twice or more."""

    def of_windows(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(placed, of_placed))

    def of_placed(placed: Column) -> Column:
        """placed: windows in the order of their hashes; equal ones are neighbours, so one sort finds them all."""

        def same(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))

        return covered(F.sort_array(F.transform(F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, x: F.struct((x + 3).alias("end"), (a["n"] + x + 3 - F.greatest(a["end"], x)).alias("n")), lambda a: a["n"])

    def windows_of(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) >= 3, _let(words, lambda w: _let(windows_of(w), of_windows))).otherwise(0).cast("long")


def with_statistics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with the statistics, all long."""
    own = [*BASE, "n_lines", "n_capitals", "n_digits", "n_exclaims", "n_distinct"]
    keep = [c for c in docs.columns if c.lower() not in own]
    hidden = "_q_"
    text = F.coalesce(F.col(f"{hidden}text"), F.lit(""))
    df = docs.withColumn(f"{hidden}text", F.col(text_col).cast("string"))
    trimmed = F.btrim(text, F.lit(SPACE))
    df = df.select(*keep, f"{hidden}text", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+")).alias(f"{hidden}words"), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias(f"{hidden}lines"))
    w, lines = F.col(f"{hidden}words"), F.col(f"{hidden}lines")
    df = df.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        _count(text, "0123456789").alias("n_digits"),
        _count(text, "!").alias("n_exclaims"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        _repeated(w).alias("n_repeat_words"),
    )
    return df.select(*keep, *own)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """A conjunction; what it covers is rejected."""

    tests: tuple[Test, ...]

    def holds(self, row: dict) -> bool:
        return all(t.holds(row) for t in self.tests)

    def sql(self) -> str:
        return " AND ".join(t.sql() for t in self.tests)


def _best_test(bad: list[dict], good: list[dict], features: list[str]) -> tuple[float, Test | None]:
    """The test of the greatest information gain over rejecting all of bad and good."""
    p0, n0, best = len(bad), len(good), (0.0, None)
    before = math.log2(p0 / (p0 + n0))
    for f in features:
        rows = sorted([(r[f], 1) for r in bad] + [(r[f], 0) for r in good])
        p = n = 0
        for i in range(len(rows) - 1):
            p, n = p + rows[i][1], n + 1 - rows[i][1]
            if rows[i][0] == rows[i + 1][0]:
                continue
            middle = (rows[i][0] + rows[i + 1][0]) / 2
            for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                if a and (gain := a * (math.log2(a / (a + b)) - before)) > best[0]:
                    best = (gain, Test(f, above, middle))
    return best


def _grow(bad: list[dict], good: list[dict], features: list[str], most: int) -> Rule:
    tests: list[Test] = []
    while good and len(tests) < most:
        gain, test = _best_test(bad, good, features)
        if test is None or gain <= 0:
            break
        tests.append(test)
        bad, good = [r for r in bad if test.holds(r)], [r for r in good if test.holds(r)]
    return Rule(tuple(tests))


def _worth(rule: Rule, bad: list[dict], good: list[dict]) -> tuple[float, int, int]:
    p, n = sum(map(rule.holds, bad)), sum(map(rule.holds, good))
    return (p - n) / (p + n) if p + n else -1.0, p, n


def _prune(rule: Rule, bad: list[dict], good: list[dict]) -> Rule:
    """The beginning of the conjunction that is worth most on rows that it was not grown on."""
    return max((Rule(rule.tests[:k]) for k in range(len(rule.tests), 0, -1)), key=lambda r: _worth(r, bad, good)[0])


def learn(rows: list[dict], *, precision: float = 0.9, most_tests: int = 4, least: int = 5, most_rules: int = 24) -> list[Rule]:
    """Rules in order from rows of features with a label: 0 is to be rejected, 1 kept."""
    features = list(FEATURES)
    grow = [r for r in rows if r["part"] != 0]
    check = [r for r in rows if r["part"] == 0]
    rules: list[Rule] = []
    while len(rules) < most_rules:
        bad, good = ([r for r in grow if r["label"] == y] for y in (0, 1))
        held_bad, held_good = ([r for r in check if r["label"] == y] for y in (0, 1))
        if len(bad) < least or not good:
            break
        rule = _prune(_grow(bad, good, features, most_tests), held_bad, held_good) if (g := _grow(bad, good, features, most_tests)).tests else g
        if not rule.tests:
            break
        _, p, n = _worth(rule, held_bad + bad, held_good + good)
        _, hp, hn = _worth(rule, held_bad, held_good)
        if p < least or p < precision * (p + n) or (hp + hn and hp < precision * (hp + hn)):
            break
        rules.append(rule)
        grow, check = [r for r in grow if not rule.holds(r)], [r for r in check if not rule.holds(r)]
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> list[dict]:
    own = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    drawn = own.where("label = 0").orderBy(*order).limit(per_class).union(own.where("label = 1").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"])
    features = [F.expr(sql).cast("double").alias(name) for name, sql in FEATURES.items()]
    rows = with_statistics(texts).select("doc_id", "label", base_failed().alias("failed"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)).alias("part"), *features).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["doc_id"]) if not r["failed"]]


def verdict(rules: list[Rule]) -> Column:
    """Whether a text is kept, as one ordered conditional expression."""
    if not rules:
        return F.lit(True)
    out = F.when(F.expr(rules[0].sql()), False)
    for rule in rules[1:]:
        out = out.when(F.expr(rule.sql()), False)
    return out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule], *, text_col: str = "text") -> DataFrame:
    """docs with statistics, base_failed and kept."""
    found = with_statistics(docs, text_col=text_col).withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = learn(labelled_rows(docs, labels))
    return judge(docs.select("doc_id", "text"), rules).select("doc_id", *BASE, "base_failed", "kept")
