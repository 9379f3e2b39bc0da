"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, hash_sample, load
from .hashing import byte_texts
from .toxicity import fit_logistic, labelled

FOLDS = 3
HELD_OUT = 1
#: Of the folds that may be learned from, 0 fits the field and 2 calibrates the score.
FIT, CALIBRATION = 0, 2
#: Largest numbers of documents that these two learn from: the ones with the smallest hashes of their ids.
FIT_ROWS, CALIBRATION_ROWS = 3_000, 10_000
#: Lines that the field learns from at most: documents are left out from where their lines, added up by the hashes of ids, exceed it.
FIT_LINES = 300_000
#: In fitting, a longer text is several sequences of so many lines; scoring takes a text as one.
SEQUENCE_LINES = 200
#: Times that the lines' labels are refined, and the share of a text's length that keeps its document's label.
REFINEMENTS, KEPT_SHARE = 2, 0.5

_SYMBOLS = b"#$%&*@^~_=+<>{}[]\\/`"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
N_FEATURES = 12


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines x N_FEATURES, lengths in bytes) of a text's lines; an empty text has one line."""
    lines = text.split(b"\n")
    copies = Counter(lines)
    rows = []
    for line in lines:
        n = len(line)
        words = line.split()
        k = len(words)
        upper, lower = n - len(line.translate(None, _UPPER)), n - len(line.translate(None, _LOWER))
        letters = upper + lower
        symbols = n - len(line.translate(None, _SYMBOLS))
        digits = n - len(line.translate(None, b"0123456789"))
        rows.append((
            n, k, upper / (letters + 1), digits / (n + 1), symbols / (n + 1), symbols / (k + 1), line.count(b"|") / (k + 1),
            (line.count(b"!") + line.count(b"?")) / (k + 1), len(set(words)) / (k + 1), copies[line] > 1 and n > 0, line[-1:] in (b".", b"?", b"!"), line.count(b".") / (k + 1),
        ))
    x = np.array(rows, float)
    lengths = x[:, 0].copy()
    x[:, 0], x[:, 1] = np.log1p(x[:, 0]) / 4, np.log1p(x[:, 0]) / 4 - np.log1p(x[:, 1]) / 4
    return x, lengths


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after, and an intercept; zeros beyond the ends."""
    zero = np.zeros((1, x.shape[1]))
    return np.hstack([x, np.vstack([zero, x[:-1]]), np.vstack([x[1:], zero]), np.ones((len(x), 1))])


def marginals(score: np.ndarray, stay_bad: float, to_good: float, to_bad: float, stay_good: float) -> list[float]:
    """Forward-backward: probability that each line is good, by its score (good against bad) and factors of the steps."""
    odds = [exp(v) for v in np.clip(score, -30, 30).tolist()]
    forward, bad, good = [], 1.0, 1.0
    first = True
    for w in odds:
        if first:
            b, g, first = 1.0, w, False
        else:
            b, g = bad * stay_bad + good * to_bad, (bad * to_good + good * stay_good) * w
        total = b + g
        bad, good = b / total, g / total
        forward.append(good)
    out = [0.0] * len(odds)
    bad, good = 1.0, 1.0
    for t in range(len(odds) - 1, -1, -1):
        g, b = forward[t] * good, (1 - forward[t]) * bad
        out[t] = g / (g + b)
        w = odds[t]
        bad, good = stay_bad * bad + to_good * w * good, to_bad * bad + stay_good * w * good
        total = bad + good
        bad, good = bad / total, good / total
    return out


class Sequences:
    """Sequences of lines, side by side: a step of a recursion is one array operation over all that are as long."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.live = np.array([int((lengths > t).sum()) for t in range(int(lengths.max()))])
        self.start = np.concatenate(([0], np.cumsum(self.live)))
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        within = np.concatenate([np.arange(n) for n in lengths])
        self.place = self.start[within] + np.repeat(rank, lengths)  # of each line, in the order in which they were given

    def step(self, t: int) -> slice:
        return slice(self.start[t], self.start[t + 1])

    def run(self, score: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability that each line is good, expected steps from state to state), by forward-backward over placed scores."""
        emit = np.stack([np.ones_like(score), np.exp(score)], axis=1)
        forward, backward = np.ones((len(score), 2)), np.ones((len(score), 2))
        last = len(self.live)
        for t in range(last):
            own, n = self.step(t), self.live[t]
            f = emit[own] if t == 0 else (forward[self.step(t - 1)][:n] @ factor) * emit[own]
            forward[own] = f / f.sum(1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(last - 1, 0, -1):
            own, n = self.step(t), self.live[t]
            right, before = emit[own] * backward[own], self.start[t - 1]
            joint = forward[before : before + n, :, None] * factor[None] * right[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = right @ factor.T
            backward[before : before + n] = b / b.sum(1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(1), expected

    def observed(self, labels: np.ndarray) -> np.ndarray:
        """Steps from state to state of placed labels."""
        out = np.zeros((2, 2))
        for t in range(1, len(self.live)):
            before = self.start[t - 1]
            np.add.at(out, (labels[before : before + self.live[t]], labels[self.step(t)]), 1)
        return out


def ascend(sequences: Sequences, x: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps_log: np.ndarray, steps: int, free: np.ndarray, rate: float = 0.08, ridge: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Steps up the conditional likelihood of the lines' labels, from (weights, log factors of a step from state to state), of which
    only those that are ``free`` (0 or 1) move."""
    width, total, observed = x.shape[1], len(x), sequences.observed(labels)
    moments = [np.zeros(width + 4), np.zeros(width + 4)]
    for step in range(1, steps + 1):
        good, expected = sequences.run(np.clip(x @ weights, -30, 30), np.exp(steps_log))
        slope = np.concatenate([x.T @ (labels - good) / total - ridge * weights, ((observed - expected) / total - ridge * steps_log).ravel()])
        for m, power, decay in ((0, 1, 0.9), (1, 2, 0.99)):
            moments[m] = decay * moments[m] + (1 - decay) * slope**power
        move = free * rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights, steps_log = weights + move[:width], steps_log + move[width:].reshape(2, 2)
    return weights, steps_log


def refined(good: np.ndarray, doc: np.ndarray, label: np.ndarray, length: np.ndarray, share: float = KEPT_SHARE) -> np.ndarray:
    """Labels of lines from the probability that each is good: the likelier one, but in each document the lines that fit its label
    best keep it, up to ``share`` of its length (one at least). Lines are grouped by document."""
    own = label[doc]
    fit = np.where(own == 1, good, 1 - good)
    order = np.lexsort((-fit, doc))
    weight = (length + 1)[order]
    before = np.cumsum(weight) - weight
    first = np.flatnonzero(np.diff(doc[order], prepend=-1))
    at = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
    whole = np.add.reduceat(weight, first)
    out = (good > 0.5).astype(int)
    keeps = before - before[first][at] < share * whole[at]
    out[order[keeps]] = own[order[keeps]]
    return out


def fit_field(texts: list[np.ndarray], labels: np.ndarray, lengths: list[np.ndarray], steps: int = 150, again: int = 60, refinements: int = REFINEMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, 2 x 2 log factors of a step from state to state) from texts (lines x features), their labels and their lines' lengths.

    At first every line has its document's label, and only its own features count: no neighbours, no steps, which would make all lines of a
    text alike. By what a line says for itself the labels are refined. From these the whole field learns, refines them, and learns on."""
    n = np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), n)
    cut = np.concatenate([np.full(c, SEQUENCE_LINES) if not r else np.append(np.full(c, SEQUENCE_LINES), r) for c, r in (divmod(int(k), SEQUENCE_LINES) for k in n)])
    sequences = Sequences(cut)
    x = np.empty((int(n.sum()), texts[0].shape[1]))
    x[sequences.place] = np.concatenate(texts)
    lines = labels[doc].astype(int)
    weights, steps_log = np.zeros(x.shape[1]), np.zeros((2, 2))
    alone = np.concatenate([np.ones(N_FEATURES), np.zeros(2 * N_FEATURES), np.ones(1), np.zeros(4)])
    for round_ in range(refinements + 1):
        placed = np.empty(len(lines), int)
        placed[sequences.place] = lines
        weights, steps_log = ascend(sequences, x, placed, weights, steps_log, again if round_ > 1 else steps, alone if round_ == 0 and refinements else np.ones(len(alone)))
        good = sequences.run(np.clip(x @ weights, -30, 30), np.exp(steps_log))[0][sequences.place]
        lines = refined(good, doc, labels.astype(int), np.concatenate(lengths))
    return weights, steps_log


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [line_features(t) for t in byte_texts(batch.column("text"))]
        flat = [pa.array([f[k].ravel() for f in found], pa.list_(pa.float64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *flat], ["doc_id", "label", "x", "lengths"])


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, steps_log = model
        (stay_bad, to_good), (to_bad, stay_good) = np.exp(steps_log).tolist()
        for batch in batches:
            share, lines, mean = [], [], []
            for text in byte_texts(batch.column("text")):
                x, lengths = line_features(text)
                score = with_neighbours(x) @ weights
                good = np.array(marginals(score, stay_bad, to_good, to_bad, stay_good))
                weight = lengths + 1
                share.append(float(np.clip(good @ weight / weight.sum(), 0.0, 1.0)))
                mean.append(float(np.clip(score, -30, 30) @ weight / weight.sum()))
                lines.append(len(lengths))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(share, pa.float64()), pa.array(mean, pa.float64()), pa.array(lines, pa.int64())], ["doc_id", "good_share", "mean_score", "n_lines"])

    return run


def _sample(rows: DataFrame, part: int, size: int, features, schema: str) -> DataFrame:
    own = rows.filter((F.col("fold") == part) & F.col("label").isNotNull()).select("doc_id", "label", "text")
    return hash_sample(own, size, lambda some: some.mapInArrow(features, schema))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text: (doc_id, held_out, score, predicted, good_share, n_lines).

    A linear-chain conditional random field labels each line good or bad from features of its form and of the
    lines before and after (length, letters' case, digits, symbols, separators, repeated lines and words). It
    learns from a bounded sample of documents (FIT_ROWS, and FIT_LINES lines in all; whole texts). Their lines first have the
    document's label, then the one that the field finds likelier, while at least half of a text's length keeps the document's. So lines of a
    text differ. The share of the text that is good by forward-backward marginals, weighted by line length, is calibrated to the
    score on another bounded sample.

    Nulls: null and empty texts are one empty line; a null id is carried along, belongs to the fold of the empty text
    and has no label; repeated rows score alike; a doc_id with contradictory labels has none. Without labels of
    both kinds the score is 0.5 for all. Language, source and id are no inputs. Other columns are not looked at.
    """
    rows = labelled(docs, labels, "quality", FOLDS)
    table = _sample(rows, FIT, FIT_ROWS, _features, "doc_id long, label int, x array<double>, lengths array<double>").toArrow().combine_chunks()
    y = table.column("label").to_numpy().astype(int) if table.num_rows else np.zeros(0, int)
    width = 3 * N_FEATURES + 1
    model, beta = (np.zeros(width), np.zeros((2, 2))), np.zeros(3)
    x, lengths = ([v.values.to_numpy() for v in table.column(c)] for c in ("x", "lengths"))
    few = int(np.searchsorted(np.cumsum([len(v) for v in lengths]), FIT_LINES, side="right")) if len(lengths) else 0
    y, x, lengths = y[:few], x[:few], lengths[:few]
    if len(set(y.tolist())) == 2:
        model = fit_field([with_neighbours(v.reshape(-1, N_FEATURES)) for v in x], y, lengths)
        seen = _sample(rows, CALIBRATION, CALIBRATION_ROWS, _calibration(model), "doc_id long, label int, good_share double, mean_score double").toArrow()
        z = seen.column("label").to_numpy().astype(float) if seen.num_rows else np.zeros(0)
        if len(set(z.tolist())) == 2:
            share, mean = (seen.column(c).to_numpy() for c in ("good_share", "mean_score"))
            beta = fit_logistic(np.column_stack([np.ones(len(z)), np.log((share + 1e-3) / (1 - share + 1e-3)), mean]), z)
        else:
            beta = np.array([0.0, 1.0, 0.0])
    found = rows.select("doc_id", "text").mapInArrow(_scores(model), "doc_id long, good_share double, mean_score double, n_lines long")
    z = F.lit(float(beta[0])) + F.lit(float(beta[1])) * F.log((F.col("good_share") + 1e-3) / (1 - F.col("good_share") + 1e-3)) + F.lit(float(beta[2])) * F.col("mean_score")
    scored = found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0)))))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "good_share", "n_lines")


def _calibration(model):
    scores = _scores(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in scores(iter([batch])):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), out.column("good_share"), out.column("mean_score")], ["doc_id", "label", "good_share", "mean_score"])

    return run


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
