"""URL filters: rules first, then the ratio of two character models.

A rule fits its host and all subdomains where the path starts with the rule's;
the longest rule wins. URLs that a rule decides are the examples: one
variable-order Markov model is estimated from the accepted and one from the
rejected ones. A URL that no rule decides is judged by the difference of the two
models' log-likelihoods per character, against a threshold calibrated on examples
that the models have not seen.

Characters are read as one of a fixed set of symbols, so that counts, models and
what is broadcast have one size whatever the data. The models see the whole URL
behind its scheme, with query and fragment. Null URLs and those without `://` have
an empty host and path; of the latter the models see the text as it is.
Where examples of one kind are missing, everything that no rule decides is
allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dayloom.llm.tables import per_row, utf8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = _LOWER + "0123456789" + "./-_~%?#=&"
# Symbols: 0 before the start, 1 at the end, 2 for any other character, then the letters.
SYMBOLS = 3 + len(_LETTERS)
ORDER = 3
_CODES = bytes(3 + _LETTERS.index(chr(b).lower()) if b < 128 and chr(b).lower() in _LETTERS else 2 for b in range(256))
# Scores are counted for calibration in bins of this width, within these bounds.
_BIN, _BOUND = 0.01, 10.0
# Share of the accepted examples that the threshold may block.
MISTAKES = 0.005


@dataclass(frozen=True)
class Rule:
    allow: bool
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From behind the first `://` to the next `/`, `?` or `#`, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to the next `?` or `#`; else empty."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def deciding_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Number of the longest rule that fits, or null."""
    ordered = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), rules[i].text))
    return F.coalesce(
        *(
            F.when(
                ((host == rules[i].host) | host.endswith("." + rules[i].host)) & path.startswith(rules[i].path), F.lit(i)
            )
            for i in ordered
        ),
        F.lit(None).cast("int"),
    )


def contexts(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all symbols with their contexts, where each URL's begin)."""
    coded = b"".join(bytes(ORDER) + u.translate(_CODES) + b"\1" for u in urls)
    codes = np.frombuffer(coded, np.uint8).astype(np.int64)
    number = np.zeros(len(codes) - ORDER, np.int64)
    for back in range(ORDER, -1, -1):
        number = number * SYMBOLS + codes[ORDER - back : len(codes) - back]
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    starts = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return number[np.repeat(starts, sizes) + within], np.cumsum(sizes) - sizes


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Of each symbol after each context of `ORDER` symbols; shorter contexts smooth longer ones.

    Witten-Bell: the more different symbols follow a context, the more weight
    the next shorter one gets; a context without counts leaves all to it.
    """
    shorter = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(ORDER + 1):
        here = counts.reshape((-1,) + (SYMBOLS,) * (order + 1)).sum(0) if order < ORDER else counts.reshape((SYMBOLS,) * (order + 1))
        total = here.sum(-1, keepdims=True)
        kinds = (here > 0).sum(-1, keepdims=True)
        base = np.broadcast_to(shorter, here.shape)
        shorter = np.where(total > 0, (here + kinds * base) / np.maximum(total + kinds, 1), base)
    return np.log(shorter).ravel()


@dataclass(frozen=True)
class UrlModel:
    """Log-likelihood ratio of each symbol after its context, and the calibrated threshold."""

    ratio: np.ndarray | None
    threshold: float = 0.0

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Mean log-likelihood ratio per symbol: positive looks accepted."""
        if self.ratio is None or not urls:
            return np.zeros(len(urls))
        numbers, begins = contexts(urls)
        sums = np.add.reduceat(self.ratio[numbers].astype(np.float64), begins)
        return sums / np.diff(np.append(begins, len(numbers)))


def _count_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context number, accepted, count), summed over each batch."""
    for batch in batches:
        accepted = np.array(batch.column(1).to_pylist(), bool)
        urls = utf8(batch.column(0))
        for kind in (False, True):
            chosen = [u for u, a in zip(urls, accepted) if a == kind]
            if chosen:
                numbers, counts = np.unique(contexts(chosen)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers), pa.array([kind] * len(numbers)), pa.array(counts.astype(np.int64))],
                    names=["number", "accepted", "n"],
                )


def _examples(judged: DataFrame, calibration: bool) -> DataFrame:
    """URLs that a rule decides; every fifth distinct URL is kept for calibration."""
    fold = (F.crc32(F.col("text").cast("binary")) % 5 == 0) == F.lit(calibration)
    return judged.where(F.col("accepted").isNotNull() & fold).select("text", "accepted")


def fit(judged: DataFrame) -> UrlModel:
    """The model from (text, accepted); its counts have one size whatever the data."""
    spark = judged.sparkSession
    counted = (
        _examples(judged, False).mapInArrow(_count_symbols, "number bigint, accepted boolean, n bigint")
        .groupBy("number", "accepted").agg(F.sum("n").alias("n")).toArrow()
    )
    kinds = counted["accepted"].to_numpy()
    counts = np.zeros((2, SYMBOLS ** (ORDER + 1)))
    for kind in (0, 1):
        chosen = kinds == bool(kind)
        counts[kind][counted["number"].to_numpy()[chosen]] = counted["n"].to_numpy()[chosen]
    if not counts.sum(1).all():
        return UrlModel(None)
    ratio = (log_probabilities(counts[1]) - log_probabilities(counts[0])).astype(np.float32)
    shared = spark.sparkContext.broadcast(ratio)

    def compute():
        model = UrlModel(shared.value)
        return lambda text: [pa.array(model.scores(utf8(text)))]

    bins = (
        per_row(_examples(judged, True), ["accepted"], ["text"], compute, "score double")
        .select("accepted", F.floor(F.greatest(F.least("score", F.lit(_BOUND)), F.lit(-_BOUND)) / _BIN).alias("bin"))
        .groupBy("bin").agg(F.sum(F.col("accepted").cast("long")).alias("good"), F.count("*").alias("n")).collect()
    )
    return UrlModel(ratio, _threshold([(r.bin, r.good, r.n - r.good) for r in bins]))


def _threshold(bins: list[tuple[int, int, int]]) -> float:
    """The bin border that rejects most while it blocks at most `MISTAKES` of the accepted examples; the middle of ties."""
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    at = {b: (g, r) for b, g, r in bins}
    low = int(-_BOUND / _BIN)
    best, chosen, kept_out, rejected = 0, [low], 0, 0
    for border in range(low, -low + 2):
        if kept_out <= MISTAKES * good and rejected >= best:
            chosen = [*chosen, border] if rejected == best else [border]
            best = rejected
        g, r = at.get(border, (0, 0))
        kept_out, rejected = kept_out + g, rejected + r
    return chosen[len(chosen) // 2] * _BIN if bad else -_BOUND


def filter_urls(pages: DataFrame, rules: list[Rule], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row for each page: host, path, the rule that decides or null, verdict, and the models' score."""
    url = F.coalesce(F.col(url_column), F.lit(""))
    whole = F.when(F.instr(url, "://") > 0, _after_scheme(url)).otherwise(url).alias("text")
    parts = pages.select(F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), whole)
    by_rule = parts.withColumn("number", deciding_rule(F.col("host"), F.col("path"), rules))
    allows = F.array(*(F.lit(r.allow) for r in rules)) if rules else F.array().cast("array<boolean>")
    names = F.array(*(F.lit(r.text) for r in rules)) if rules else F.array().cast("array<string>")
    judged = by_rule.select(
        "id", "host", "path", F.get(names, F.col("number")).alias("rule"), F.get(allows, F.col("number")).alias("accepted"),
        "text",
    )
    shared = pages.sparkSession.sparkContext.broadcast(fit(judged))

    def compute():
        model = shared.value

        def work(text, accepted):
            scores = model.scores(utf8(text))
            allowed = (scores >= model.threshold) | (model.ratio is None)
            verdicts = [a if by is None else by for a, by in zip(allowed.tolist(), accepted.to_pylist())]
            return [pa.array(["allow" if v else "block" for v in verdicts], pa.string()), pa.array(scores)]

        return work

    scored = per_row(judged, ["id", "host", "path", "rule"], ["text", "accepted"], compute, "verdict string, score double")
    return scored.withColumnRenamed("id", id_column)
