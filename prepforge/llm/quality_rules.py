"""Quality rules: text statistics and a decision list learned by sequential covering, all in DataFrame operations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepforge.llm.tables import Scratch, fold, only

WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5
RULES, CONDITIONS = 8, 3            # longest decision list, longest conjunction
PRECISION = 0.9                     # share of low quality that a rule needs on the rows kept back for pruning
SUPPORT = 3                         # and the least number of low-quality rows among them

RATIOS = [0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9,
          1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 7.0, 8.0, 10.0]
COUNTS = [float(x) for k in range(5) for x in (10 ** k, 2 * 10 ** k, 5 * 10 ** k)]
#: what conditions may ask, as expressions over the statistics, each with its possible thresholds
FEATURES: dict[str, tuple[str, list[float]]] = {
    "words": ("n_words", COUNTS),
    "word_length": ("word_chars / greatest(n_words, 1)", RATIOS),
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", RATIOS),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", RATIOS),
    "repeated_lines": ("n_dup_lines / greatest(n_lines, 1)", RATIOS),
    "words_per_line": ("n_words / greatest(n_lines, 1)", COUNTS),
    "marks_per_word": ("n_marks / greatest(n_words, 1)", RATIOS),
    "capitals": ("n_capitals / greatest(word_chars, 1)", RATIOS),
    "distinct_words": ("n_distinct / greatest(n_words, 1)", RATIOS),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that occur twice or more. Linear but for a sort in texts with repeats."""
    def covered(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(x["window"] == F.get(ordered, i)["window"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1)),
                                      lambda x: x["at"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(at, first, lambda a, k: F.struct(
            (a["n"] + F.least(F.lit(width), k - a["last"])).alias("n"), k.alias("last")))["n"]

    def in_windows(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("window"), i.alias("at"))))
        # only texts with a repeated window need to know which ones
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(ordered, covered)).otherwise(0)

    def in_hashes(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - width)
        window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])
        return let(F.transform(starts, window), in_windows)

    return F.when(F.size(words) >= width, let(F.transform(words, lambda w: F.xxhash64(w)), in_hashes)).otherwise(0)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and counts of every whole text; no shuffle, no Python.

    ``n_words, word_chars`` (code points in words), ``n_symbols`` (``#*$%&|<>``),
    ``n_lines`` (with a word), ``n_dup_lines`` (of those, equal to an earlier
    one), ``n_repeat_words`` (words in windows of five words that occur twice or
    more in the text), ``n_distinct`` words, ``n_marks`` (``!?``), ``n_capitals``
    (A-Z). A null text has none of them.
    """
    text = F.col("text")
    without = lambda chars: F.length(F.translate(text, chars, ""))
    rows = only(docs, doc_id=id_col, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = rows.select(
        "doc_id", "text",
        F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        without(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length(text) - without("#*$%&|<>")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        (F.length(text) - without("!?")).cast("long").alias("n_marks"),
        (F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"))
    return rows


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature][0])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a text that meets all conditions of one is of low quality."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self) -> Column:
        """The list as one conditional expression over the statistics."""
        out: Column | None = None
        for rule in self.rules:
            out = F.when(_all(rule), False) if out is None else out.when(_all(rule), False)
        return F.lit(True) if out is None else out.otherwise(True)


def _all(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def _cells(rows: DataFrame) -> dict[str, list[list[int]]]:
    """Per feature and threshold bin: low and high quality among growing rows, low and high among pruning rows.

    One aggregate; its result has as many rows as there are features and bins.
    """
    def bin_of(value: Column, cuts: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda t: value > t))

    bins = F.array(*[F.struct(F.lit(name).alias("feature"), bin_of(F.expr(expr), cuts).alias("bin"))
                     for name, (expr, cuts) in FEATURES.items()])
    low, grow = F.col("low") == 1, F.col("grow")
    counted = (rows.select("low", "grow", F.explode(bins).alias("cell")).groupBy("cell.feature", "cell.bin")
               .agg(*[F.count_if(c) for c in (low & grow, ~low & grow, low & ~grow, ~low & ~grow)]).collect())
    out = {name: [[0, 0, 0, 0] for _ in range(len(cuts) + 1)] for name, (_, cuts) in FEATURES.items()}
    for name, at, *cell in counted:
        out[name][at] = cell
    return out


def _total(cells: dict[str, list[list[int]]]) -> list[int]:
    return [sum(c[k] for c in next(iter(cells.values()))) for k in range(4)]


def _best(cells: dict[str, list[list[int]]], taken: list[Condition]) -> Condition | None:
    """The condition with the largest information gain on the growing rows."""
    p0, n0 = _total(cells)[:2]
    if not p0 or not n0:
        return None
    start, best, gain = math.log2(p0 / (p0 + n0)), None, 1e-9
    for name, (_, cuts) in FEATURES.items():
        below = [0, 0]
        for at, threshold in enumerate(cuts):
            below = [below[0] + cells[name][at][0], below[1] + cells[name][at][1]]
            for above, p, n in ((True, p0 - below[0], n0 - below[1]), (False, *below)):
                condition = Condition(name, above, threshold)
                if p and (p < p0 or n < n0) and condition not in taken:
                    found = p * (math.log2(p / (p + n)) - start)
                    if found > gain:
                        best, gain = condition, found
    return best


def learn_rules(statistics: DataFrame, labels: DataFrame, label: str = "quality") -> DecisionList:
    """Sequential covering of the labelled rows of low quality (label 0).

    Only ids whose crc32 does not leave 1 modulo 3 teach. Two thirds of them
    grow rules, one condition at a time by information gain; the others prune
    each rule to the prefix that is purest there, and end the list when a rule
    has less than PRECISION or SUPPORT. Thresholds come from fixed grids, counts
    from all labelled rows: each step is one aggregate over narrow rows.
    """
    scratch = Scratch(statistics.sparkSession, "rules")
    known = (only(labels, doc_id="doc_id", label=label).where("doc_id IS NOT NULL AND label IN (0, 1)")
             .groupBy("doc_id").agg(F.min("label").alias("label")))
    rows = scratch.write(
        statistics.join(known, "doc_id").where((fold("doc_id", 3) != 1) & ~base_failed())
        .withColumn("low", (F.col("label") == 0).cast("int"))
        .withColumn("grow", F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) != 0))
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < RULES:
        open_, rule = rows.where(DecisionList(tuple(rules)).keeps()), []
        cells = _cells(open_)
        prefixes = []
        while len(rule) < CONDITIONS and (condition := _best(cells, rule)):
            rule.append(condition)
            cells = _cells(open_.where(_all(tuple(rule))))
            p, n = _total(cells)[2:]
            prefixes.append(((p + 1) / (p + n + 2), -len(rule), p))
        if not prefixes:
            break
        purity, length, support = max(prefixes)
        if purity < PRECISION or support < SUPPORT:
            break
        rules.append(tuple(rule[:-length]))
    scratch.drop(rows)
    return DecisionList(tuple(rules))


def apply_rules(statistics: DataFrame, rules: DecisionList) -> DataFrame:
    """``statistics`` with ``base_failed`` and ``kept``: false if the base rules fail, else as the list decides."""
    return (statistics.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & rules.keeps()))
