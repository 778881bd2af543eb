"""Quality classifier: a linear-chain conditional random field that labels every line good or bad.

Each line with a word is one position; its features describe the line and its
two neighbours. The field is trained on texts whose lines all carry the text's
label, from a bounded sample of labelled rows. A text's score is the mean of its
lines' forward-backward marginals, weighted by their lengths.

Only the text enters a score. Texts without such a line, null ones among them,
get the share of good texts in the sample; with no labelled rows at all every
score is one half. Blank lines are no positions and carry no weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dayloom.llm.tables import crc32, crc_of, per_row, rows_where, utf8

# Labelled rows that the field is trained on, those of the lowest hashes, and all
# their lines together; the text that reaches this bound gives its first lines.
SAMPLE_ROWS, SAMPLE_LINES = 4000, 400_000
_WORD = r"[^ \t\n\x0B\f\r]"
HELD_OUT_FOLDS, HELD_OUT = 4, 2
LIMIT = 0.7
PART_BYTES = 2_000_000

_CLASSES = (b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b"!", b".,;:?", bytes(range(128, 256)))
_MEMBER = np.zeros((len(_CLASSES), 256), np.uint8)
for _row, _members in enumerate(_CLASSES):
    _MEMBER[_row, list(_members)] = 1
_OWN = len(_CLASSES) + 6
# The features of a neighbouring line that are looked at: its classes and repeats.
_NEAR = [0, 1, 3, 6, 7]
FEATURES = 1 + _OWN + 2 * len(_NEAR)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines with a word, their lengths in bytes, lines of each text)."""
    lines: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    own = []
    for number, text in enumerate(texts):
        previous = None
        for line in text.split(b"\n"):
            words = line.split()
            if not words:
                continue
            n = len(words)
            same = sum(map(bytes.__eq__, words, words[1:]))
            own.append((
                same / n, 1.0 - len(set(words)) / n, float(line == previous), n < 4,
                words[-1][-1:] in b".!?", np.log1p(len(line) / n),
            ))
            lines.append(line)
            counts[number] += 1
            previous = line
    if not lines:
        return np.zeros((0, FEATURES)), np.zeros(0), counts
    sizes = np.array(list(map(len, lines)), np.int64)
    codes = np.frombuffer(b"".join(lines), np.uint8)
    starts = np.cumsum(sizes) - sizes
    shares = np.stack([np.add.reduceat(member[codes], starts, dtype=np.int64) for member in _MEMBER], 1) / sizes[:, None]
    # Shares count most where they are small.
    shares = shares / (shares + 0.05)
    here = np.concatenate([shares, np.array(own, float)], 1)
    first = np.zeros(len(lines), bool)
    begins = np.cumsum(counts) - counts
    first[begins[counts > 0]] = True
    last = np.roll(first, -1)
    before = np.where(first[:, None], here, np.roll(here, 1, 0))[:, _NEAR]
    after = np.where(last[:, None], here, np.roll(here, -1, 0))[:, _NEAR]
    return np.concatenate([np.ones((len(lines), 1)), here, before, after], 1), sizes.astype(float), counts


@dataclass
class LineField:
    """Weights of the good state against the bad one, and scores of the four transitions."""

    weights: np.ndarray
    transitions: np.ndarray
    prior: float

    def _steps(self, counts: np.ndarray):
        """For each position: the lines at it in all texts that are long enough, longest texts first."""
        order = np.argsort(-counts, kind="stable")
        begins = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        for at in range(int(sizes[0]) if len(sizes) else 0):
            yield begins[: np.searchsorted(-sizes, -at, "left")] + at

    def passes(self, features: np.ndarray, counts: np.ndarray):
        """(marginals of the states at each line, expected transitions, log of the sum over all rows of states)."""
        n = len(features)
        emission = np.zeros((n, 2))
        emission[:, 1] = features @ self.weights
        forward, scale = np.zeros((n, 2)), np.zeros(n)
        steps = list(self._steps(counts))
        turn = np.exp(self.transitions)
        top = emission.max(1, keepdims=True)
        weight = np.exp(emission - top)
        for at, lines in enumerate(steps):
            arrived = weight[lines] if at == 0 else (forward[lines - 1] @ turn) * weight[lines]
            total = arrived.sum(1)
            forward[lines], scale[lines] = arrived / total[:, None], total
        backward = np.ones((n, 2))
        pairs = np.zeros((2, 2))
        for at in range(len(steps) - 1, 0, -1):
            lines = steps[at]
            message = weight[lines] * backward[lines] / scale[lines][:, None]
            pairs += np.einsum("ni,nj->ij", forward[lines - 1], message) * turn
            backward[lines - 1] = message @ turn.T
        return forward * backward, pairs, np.log(scale).sum() + top.sum()

    def scores(self, texts: list[bytes]) -> list[float]:
        out: list[float] = []
        at = 0
        while at < len(texts):
            begin, size = at, 0
            while at < len(texts) and (at == begin or size < PART_BYTES):
                size += len(texts[at])
                at += 1
            out += self._scores(texts[begin:at])
        return out

    def _scores(self, texts: list[bytes]) -> list[float]:
        features, sizes, counts = line_features(texts)
        good = self.passes(features, counts)[0][:, 1] if len(features) else np.zeros(0)
        owner = np.repeat(np.arange(len(texts)), counts)
        total = np.bincount(owner, sizes, len(texts))
        mean = np.bincount(owner, sizes * good, len(texts)) / np.maximum(total, 1e-300)
        return np.clip(np.where(counts > 0, mean, self.prior), 0.0, 1.0).tolist()


def train(samples: list[tuple[np.ndarray, int]], rounds: int = 200, rate: float = 0.15, ridge: float = 0.5) -> LineField:
    """A field that makes each text's label likely on all its lines; gradient ascent with adaptive steps."""
    field = LineField(np.zeros(FEATURES), np.zeros((2, 2)), 0.5)
    samples = [s for s in samples if len(s[0])]
    if not samples:
        return field
    features = np.concatenate([f for f, _ in samples])
    counts = np.array([len(f) for f, _ in samples], np.int64)
    labels = np.array([label for _, label in samples])
    states = np.repeat(labels, counts)
    wanted = features[states == 1].sum(0)
    stays = np.array([(counts - 1)[labels == s].sum() for s in (0, 1)], float)
    n = len(samples)
    parameters = np.zeros(FEATURES + 4)
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, rounds + 1):
        field.weights, field.transitions = parameters[:FEATURES], parameters[FEATURES:].reshape(2, 2)
        marginals, pairs, _ = field.passes(features, counts)
        slope = np.append(wanted - features.T @ marginals[:, 1], (np.diag(stays) - pairs).ravel()) / n
        slope -= ridge / n * parameters
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        parameters = parameters + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return LineField(parameters[:FEATURES].copy(), parameters[FEATURES:].reshape(2, 2).copy(), float(labels.mean()))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> LineField:
    """The field from labelled rows outside the held-out fold; at most `SAMPLE_ROWS` of them, and `SAMPLE_LINES` lines."""
    key = F.col(id_column)
    usable = (
        labels.where(F.col("quality").isNotNull() & key.isNotNull() & (crc_of(key) % HELD_OUT_FOLDS != HELD_OUT))
        .groupBy(key.alias("id")).agg(F.min("quality").alias("quality"))
        .select("id", (F.col("quality") > 0).cast("int").alias("label"), F.xxhash64("id").alias("draw"))
    )
    worded = docs.select(key.alias("id"), F.col(text_column).alias("text")).where(F.col("text").rlike(_WORD))
    # Bounded, and so small enough to broadcast.
    chosen = usable.join(worded.select("id"), "id", "left_semi").orderBy("draw", "id").limit(SAMPLE_ROWS)
    joined = worded.join(F.broadcast(chosen), "id").select("label", "draw", F.xxhash64("text").alias("mark"), "text")

    def count():
        return lambda text: [pa.array([sum(1 for line in raw.split(b"\n") if line.split()) for raw in utf8(text)], pa.int64())]

    counted = (
        per_row(joined, ["draw", "mark"], ["text"], count, "lines bigint").orderBy("draw", "mark").limit(SAMPLE_ROWS)
        .collect()
    )
    limit: dict[tuple[int, int], int] = {}
    rest, rows = SAMPLE_LINES, 0
    for row in counted:
        if rest <= 0:
            break
        place = (row.draw, row.mark)
        limit[place] = max(limit.get(place, 0), min(row.lines, rest))
        rest, rows = rest - row.lines, rows + 1
    shared = docs.sparkSession.sparkContext.broadcast(limit)

    def compute():
        limits = shared.value

        def work(draw, mark, text):
            out = []
            for place, raw in zip(zip(draw.to_pylist(), mark.to_pylist()), utf8(text)):
                out.append(line_features([raw])[0][: limits[place]].tobytes() if place in limits else None)
            return [pa.array(out, pa.binary())]

        return work

    sampled = (
        per_row(joined, ["label", "draw", "mark"], ["draw", "mark", "text"], compute, "features binary")
        .where(F.col("features").isNotNull()).orderBy("draw", "mark").limit(max(rows, 1)).collect()
    )
    samples, rest = [], SAMPLE_LINES
    for row in sampled:
        features = np.frombuffer(row.features).reshape(-1, FEATURES)[:rest]
        rest -= len(features)
        samples.append((features, row.label))
    return train(samples)


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: whether it is held out, its score, and the predicted label."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_column, text_column))

    def compute():
        field = shared.value

        def work(ids, text):
            scores = field.scores(utf8(text))
            held_out = [crc32(i) % HELD_OUT_FOLDS == HELD_OUT for i in ids.to_pylist()]
            return [
                pa.array(held_out, pa.bool_()), pa.array(scores, pa.float64()),
                pa.array([int(s >= LIMIT) for s in scores], pa.int32()),
            ]

        return work

    return per_row(
        docs, [id_column], [id_column, text_column], compute, "held_out boolean, score double, predicted int"
    )


def good_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows whose score is high enough, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_column, text_column))

    def verdict():
        field = shared.value
        return lambda text: [s >= LIMIT for s in field.scores(utf8(text))]

    return rows_where(docs, [text_column], verdict)
