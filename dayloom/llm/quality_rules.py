"""Quality rules: a decision list of threshold conjunctions, learnt from labelled statistics.

Texts are measured and judged by Spark's own functions only, and measured once. The
measurements of the labelled texts that pass the base rules are put into a fixed grid of
cells, with the number of good and bad texts in each. Sequential covering works on counts of
these cells alone: a rule grows by the condition with the highest gain on one
part of the texts, is pruned on the other part, and is kept if it still is
precise there; the cells it covers are set aside before the next rule. The cells of a
candidate that is not kept are set aside for growing only, so that it hides no other
rule. A rule grows as long as a condition gains and leaves out some of the texts, and
rules are looked for until no condition covers `MIN_SUPPORT` bad texts with a gain; as
each candidate sets cells aside, the number of cells bounds the work. Up to `HELD_CELLS`
cells are read once and kept by the driver; more stay a table, which is read for each
step. The list becomes one ordered CASE expression.

Null and empty texts have no words and fail the base rules. Labels without a
quality are not used, and where an id is labelled more than once the lowest
counts. Without labels of both kinds the list is empty: only base rules reject.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from dayloom.llm.expressions import count_of, let, words
from dayloom.llm.tables import crc_of, settle

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
# Of a digest packed with its place in the text, the bits that the place takes.
PLACE_BITS = 24
MIN_PRECISION, MIN_SUPPORT = 0.97, 3
# So many cells are held by the driver, as arrays of some 30 MB.
HELD_CELLS = 1_000_000
# A threshold may give up this share of the gain to stay further from good texts.
SLACK = 0.9
_RATIOS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)
# What a condition may speak about, and the thresholds it may use.
GRID: dict[str, tuple[float, ...]] = {
    "symbol_share": _RATIOS, "repeat_share": _RATIOS, "dup_line_share": _RATIOS, "upper_share": _RATIOS,
    "exclamation_share": _RATIOS, "digit_share": _RATIOS,
    "word_length": (2.5, 3.0, 3.5, 4.0, 4.5, 5.5, 6.0, 6.5, 7.0, 8.0, 10.0, 15.0),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    return reduce(and_, (c.holds() for c in rule), F.lit(True))


def _windows(ws: Column) -> Column:
    """A digest for each three-word window."""
    return F.transform(
        F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)),
    )


def _compared(windows: Column) -> Column:
    """Places of the windows that come twice or more, by sorted pairs of digest and place."""

    def repeated(placed: Column) -> Column:
        return F.transform(
            F.filter(
                placed,
                lambda e, j: F.coalesce(e["h"] == F.get(placed, j - 1)["h"], F.lit(False))
                | F.coalesce(e["h"] == F.get(placed, j + 1)["h"], F.lit(False)),
            ),
            lambda e: e["at"],
        )

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("at")))
    return let(F.sort_array(pairs), repeated)


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds `n_repeat_words`: words in `windows` that the text has twice or more.

    Each step is a select of its own, and uses what the one before made more than once, so
    that Spark keeps them apart: sets and sorts of numbers then run as compiled code. A
    window's digest and place are packed into one number. The digest loses bits by that; if
    links between equal ones leave other than the number of distinct whole digests, or if
    there are more places than fit, whole digests are compared.
    """
    windows, packed, links, places = map(F.col, ("windows", "packed", "links", "places"))
    kept, n = df.columns, F.size("windows")
    place = F.lit((1 << PLACE_BITS) - 1)
    pairs = F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(place)).bitwiseOR(i.cast("long")))
    df = df.select("*", F.size(F.array_distinct(windows)).alias("distinct"))
    df = df.select("*", F.when((F.col("distinct") < n) & (n <= 1 << PLACE_BITS), F.sort_array(pairs)).alias("packed"))

    def linked(x: Column, j: Column) -> Column:
        same = F.shiftrightunsigned(x.bitwiseXOR(F.get(packed, j + 1)), PLACE_BITS) == 0
        return F.when(same, j).otherwise(F.lit(-1))

    df = df.select("*", F.array_remove(F.transform(packed, linked), -1).alias("links"))
    here, there = (F.transform(links, lambda j: F.get(packed, j + d).bitwiseAND(place)) for d in (0, 1))
    found = (
        F.when(F.col("distinct") == n, F.expr("cast(array() as array<bigint>)"))
        .when(n - F.size(links) == F.col("distinct"), F.array_union(here, there)).otherwise(_compared(windows))
    )
    df = df.select(*kept, found.alias("places"))
    next_two = F.array_union(F.transform(places, lambda x: x + 1), F.transform(places, lambda x: x + 2))
    return df.select(*kept, F.size(F.array_union(places, next_two)).cast("long").alias("n_repeat_words"))


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: its counts, its shares, and whether it fails the base rules."""
    text, marks = F.col("text"), F.col("marks")
    plain = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    listed = let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            _windows(ws).alias("windows"),
        ),
    )
    with_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    lines = let(
        with_word, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup"))
    )
    # One pass over the text leaves the characters that are counted.
    left = F.regexp_replace(text, f"[^{SYMBOLS}A-Z0-9!]+", "").alias("marks")
    counted = _with_repeats(
        plain.select("id", listed.alias("w"), lines.alias("l"), left).select(
            "id", "w.n_words", "w.word_chars", "w.windows", "l", count_of(marks, f"[{SYMBOLS}]").alias("n_symbols"),
            count_of(marks, "[A-Z]").alias("upper"), count_of(marks, "[0-9]").alias("digits"), count_of(marks, "!").alias("exclamations"),
        )
    )

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    n_words, repeats = F.col("n_words"), F.col("n_repeat_words")
    return counted.select(
        "id", "n_words", "word_chars", "n_symbols", F.col("l.dup").cast("long").alias("n_dup_lines"), "n_repeat_words",
        ((n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)).alias("base_failed"),
        share(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"), share(repeats, n_words).alias("repeat_share"),
        share(F.col("l.dup"), F.col("l.n")).alias("dup_line_share"), share(F.col("upper"), F.col("word_chars")).alias("upper_share"),
        share(F.col("exclamations"), n_words).alias("exclamation_share"), share(F.col("digits"), F.col("word_chars")).alias("digit_share"),
        share(F.col("word_chars"), n_words).alias("word_length"),
    )


def cells(measurements: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Good and bad labelled texts in each cell of the grid, apart for growing and pruning.

    A cell is given by, for each feature, how many thresholds the value exceeds.
    """
    marked = (
        labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_column).alias("id"))
        .agg(F.min("quality").alias("quality"))
    )
    bins = [
        reduce(lambda a, b: a + b, ((F.col(name) > t).cast("int") for t in thresholds)).alias(name)
        for name, thresholds in GRID.items()
    ]
    part = (crc_of(F.col("id")) % 3 == 0).alias("prune")
    return (
        measurements.where(~F.col("base_failed")).join(marked, "id").select(*bins, part, "quality")
        .groupBy(*GRID, "prune")
        .agg(F.sum((F.col("quality") == 0).cast("long")).alias("bad"), F.sum((F.col("quality") != 0).cast("long")).alias("good"))
    )


def _exceeds(condition: Condition, bins: Column | np.ndarray) -> Column | np.ndarray:
    """The condition on a cell: a value above a threshold exceeds it and all lower ones."""
    exceeded = GRID[condition.feature].index(condition.threshold) + 1
    return bins >= exceeded if condition.above else bins < exceeded


def _covered(rule: Rule) -> Column:
    return reduce(and_, (_exceeds(c, F.col(c.feature)) for c in rule), F.lit(True))


class _Spread:
    """Cells that stay a table: each sum is a query."""

    def __init__(self, cells: DataFrame):
        self.cells = cells

    def by_bin(self, rule: Rule) -> dict[tuple[str, int], tuple[int, int]]:
        """Bad and good texts to grow from that the rule covers, for each feature and bin."""
        inside = self.cells.where(~F.col("prune")).where(_covered(rule))
        entries = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("bin")) for f in GRID))).alias("e")
        sums = inside.select(entries, "bad", "good").groupBy("e.f", "e.bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        return {(row.f, row.bin): (row.bad, row.good) for row in sums.collect()}

    def to_prune(self, rules: list[Rule]) -> list[tuple[int, int]]:
        """Bad and good texts of the pruning part that each rule covers."""
        sums = [
            F.sum(F.when(_covered(rule), F.col(kind)).otherwise(0)).alias(f"{kind}{i}")
            for i, rule in enumerate(rules) for kind in ("bad", "good")
        ]
        row = self.cells.where(F.col("prune")).agg(*sums).first()
        return [(row[f"bad{i}"] or 0, row[f"good{i}"] or 0) for i in range(len(rules))]

    def without(self, rule: Rule) -> _Spread:
        return _Spread(self.cells.where(~_covered(rule)))


class _Held:
    """The same with cells held by the driver: each sum is a pass over its arrays."""

    def __init__(self, bins: dict[str, np.ndarray], prune: np.ndarray, bad: np.ndarray, good: np.ndarray):
        self.bins, self.prune, self.bad, self.good = bins, prune, bad, good

    @classmethod
    def of(cls, cells: DataFrame) -> _Held:
        short = [F.col(f).cast("tinyint").alias(f) for f in GRID]
        table = cells.select(*short, "prune", "bad", "good").toArrow()
        *bins, prune, bad, good = (column.to_numpy() for column in table.columns)
        return cls(dict(zip(GRID, bins)), prune, bad, good)

    def _inside(self, rule: Rule) -> np.ndarray:
        return reduce(and_, (_exceeds(c, self.bins[c.feature]) for c in rule), np.ones(len(self.bad), bool))

    def by_bin(self, rule):
        at = np.flatnonzero(~self.prune & self._inside(rule))
        counts = {}
        for f, thresholds in GRID.items():
            bins = self.bins[f][at]
            bad, good, n = np.zeros((3, len(thresholds) + 1), np.int64)
            for sums, added in ((bad, self.bad[at]), (good, self.good[at]), (n, 1)):
                np.add.at(sums, bins, added)
            counts |= {(f, int(k)): (int(bad[k]), int(good[k])) for k in np.flatnonzero(n)}
        return counts

    def to_prune(self, rules):
        insides = (self.prune & self._inside(rule) for rule in rules)
        return [(int(self.bad[inside].sum()), int(self.good[inside].sum())) for inside in insides]

    def without(self, rule):
        at = np.flatnonzero(~self._inside(rule))
        return _Held({f: b[at] for f, b in self.bins.items()}, self.prune[at], self.bad[at], self.good[at])


Cells = _Spread | _Held


def _best_condition(left: Cells, rule: Rule) -> tuple[Condition | None, int, int]:
    """The condition that gains most when it is added, with the bad and good texts then covered."""
    counts = left.by_bin(rule)
    first = next(iter(GRID))
    total_bad = sum(b for (f, _), (b, _) in counts.items() if f == first)
    total_good = sum(g for (f, _), (_, g) in counts.items() if f == first)
    if not total_bad:
        return None, total_bad, total_good
    found = _condition_of(counts, total_bad, total_good, total_bad + total_good)
    if found[1] + found[2] == total_bad + total_good:
        # The correction for small counts lets a condition that all fulfil gain, again and again.
        found = _condition_of(counts, total_bad, total_good, total_bad + total_good - 1)
    return found


def _condition_of(
    counts: dict[tuple[str, int], tuple[int, int]], total_bad: int, total_good: int, most: int
) -> tuple[Condition | None, int, int]:
    """The same among the conditions that cover `most` texts or fewer."""
    best, gain = (None, total_bad, total_good), 0.0
    before = math.log2(total_bad / (total_bad + total_good))
    for feature, thresholds in GRID.items():
        for above in (False, True):
            tried = []
            bad = good = 0
            for number, threshold in enumerate(thresholds):
                bad += counts.get((feature, number), (0, 0))[0]
                good += counts.get((feature, number), (0, 0))[1]
                p, n = (total_bad - bad, total_good - good) if above else (bad, good)
                if p >= MIN_SUPPORT and p + n <= most:
                    here = p * (math.log2((p + 1) / (p + n + 2)) - before)
                    tried.append((here, p, n, Condition(feature, above, threshold)))
            if tried and max(tried, key=lambda x: x[0])[0] > gain + 1e-9:
                gain = max(tried, key=lambda x: x[0])[0]
                # Of thresholds about as good, the one that rejects least.
                _, p, n, condition = min((x for x in tried if x[0] >= SLACK * gain), key=lambda x: x[1] + x[2])
                best = (condition, p, n)
    return best


def _precisions(left: Cells, rules: list[Rule]) -> list[tuple[float, int]]:
    """Precision on the pruning part, and bad texts covered, of each rule."""
    counts = left.to_prune(rules)
    return [(bad / (bad + good) if bad + good else 0.0, bad) for bad, good in counts]


def learn(statistics: DataFrame) -> list[Rule]:
    """The decision list, from counts in cells; up to `HELD_CELLS` are read once, more of them for each step."""
    few = statistics.limit(HELD_CELLS + 1).count() <= HELD_CELLS
    rules: list[Rule] = []
    left = growing = _Held.of(statistics) if few else _Spread(statistics)
    while True:
        grown: Rule = ()
        while True:
            condition, _, good = _best_condition(growing, grown)
            if condition is None:
                break
            grown = (*grown, condition)
            if not good:
                break
        if not grown:
            return rules
        rule = grown
        while len(rule) > 1:
            shorter = [rule[:i] + rule[i + 1 :] for i in range(len(rule))]
            (whole, _), *others = _precisions(left, [rule, *shorter])
            (precision, _), simpler = max(zip(others, shorter), key=lambda x: x[0])
            if precision < whole:
                break
            rule = simpler
        precision, support = _precisions(left, [rule])[0]
        if precision >= MIN_PRECISION and support >= MIN_SUPPORT:
            rules.append(rule)
            left, growing = left.without(rule), growing.without(rule)
        else:
            growing = growing.without(grown)


def rule_of(rules: list[Rule]) -> Column:
    """The first rule that rejects a text, as text; null where none does."""
    if not rules:
        return F.lit(None).cast("string")
    # One flat CASE: nested ones are as deep as there are rules.
    return reduce(lambda fires, rule: fires.when(_holds(rule), F.lit(" and ".join(map(str, rule)))), rules, F)


def judged(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: base counts, base verdict, verdict, and the rule that rejected it."""
    measurements = settle(measured(docs, id_column, text_column))
    rules = learn(settle(cells(measurements, labels, id_column)))
    rule = F.when(~F.col("base_failed"), rule_of(rules))
    return measurements.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & rule.isNull()).alias("kept"), rule.alias("rule"),
    )
