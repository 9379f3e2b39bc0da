"""Toxicity by class-conditional Kneser-Ney models."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, hash_sample, load, materialize, small_enough

FOLDS = 5
HELD_OUT = 0
#: Largest number of rows that calibrate the score, each by the models without its own counts.
CALIBRATION_ROWS = 20_000
#: Letters of a word's stem, which rare words back off to.
STEM_CHARS = 4
#: What the toxic model takes off the count of a word and of a stem.
WORD_DISCOUNT, STEM_DISCOUNT = 1.5, 10.0
#: Words of a run, the stretch of a sentence whose likelihoods are compared, and what is added to its length in the mean.
RUN_WORDS, RUN_PRIOR = 4, 4
#: Runs whose differences are features of their own, the largest first.
TOP_RUNS = 3
#: Words with counts (28 bytes each) in a broadcast; the most frequent ones, if there are more. The others are joined.
BROADCAST_WORDS = 4_000_000
#: Labels (16 bytes a row) up to this number are broadcast.
BROADCAST_LABELS = 1_000_000

_BREAKS = ".!?\n"
_TOKEN = re.compile(rf"\w+|[{_BREAKS}]")
_COUNTS = ["toxic", "ordinary", "stem_toxic", "stem_ordinary", "stem_types"]


@dataclass
class Classes:
    """What the counts of single words are set against: a few numbers."""

    n_toxic: float = 0.0  # words of the class
    n_ordinary: float = 0.0
    types: float = 0.0  # different words and stems of both
    stems: float = 0.0
    word_discounts: tuple[float, float] = (0.0, 0.0)  # toxic, ordinary
    stem_discounts: tuple[float, float] = (0.0, 0.0)
    word_mass: float = 1.0  # what the discounts leave to the backoff, the same in both classes
    stem_mass: float = 1.0

    def ratios(self, known: np.ndarray, counts: np.ndarray, own: np.ndarray | None = None, label: int | None = None, length: int = 0) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary) by the rows of ``counts`` (_COUNTS). ``own``, counts of words and stems in a text
        of ``label`` with ``length`` words, is taken out first."""
        if not (self.n_toxic and self.n_ordinary):
            return np.zeros(len(counts))
        shared = (counts[:, 4] + 1) / (self.types + self.stems + 1)
        share = (known + 0.5) / (counts[:, 4] + 1)
        logs = []
        for c, total in ((0, self.n_toxic), (1, self.n_ordinary)):
            word, stem = counts[:, c], counts[:, 2 + c]
            if own is not None and label == 1 - c:
                word, stem, total = word - own[:, 0], stem - own[:, 1], max(1.0, total - length)
            by_stem = np.maximum(stem - self.stem_discounts[c], 0) / total + self.stem_mass * shared
            logs.append(np.log(np.maximum(word - self.word_discounts[c], 0) / total + self.word_mass * by_stem * share))
        return logs[0] - logs[1]


@dataclass
class Table:
    """Counts by hash, sorted: of words with their stems, and of stems for the words that no text of a class has."""

    words: np.ndarray
    word_counts: np.ndarray
    stems: np.ndarray
    stem_counts: np.ndarray
    whole: bool  # whether these are all words

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)

    def lookup(self, word: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, counts): a word that isn't known has its stem's counts only."""
        at, known = self.find(self.words, word)
        counts = np.zeros((len(word), 5))
        counts[known] = self.word_counts[at[known]]
        at, there = self.find(self.stems, stem)
        there &= ~known
        counts[there, 2:] = self.stem_counts[at[there]]
        return known, counts


def _hashes(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)).view(np.int64)


class Batch:
    """Texts as numbers of their different words; sentence ends have the first numbers."""

    def __init__(self, texts: list[str | None]):
        number = defaultdict(count().__next__)
        for b in _BREAKS:
            number[b]
        self.tokens = []
        for text in texts:
            found = _TOKEN.findall((text or "").lower())
            self.tokens.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        words = list(number)[len(_BREAKS) :]
        stem = defaultdict(count().__next__)
        self.stem_of = np.fromiter((stem[w[:STEM_CHARS]] for w in words), np.int64, len(words))
        self.words, self.stems = _hashes(words), _hashes(list(stem))

    def sentences(self, text: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, starts of the runs): a run ends after RUN_WORDS words, and where its sentence ends."""
        tokens = self.tokens[text]
        is_word = tokens >= len(_BREAKS)
        place = np.arange(len(tokens))
        last = np.maximum.accumulate(np.where(is_word, -1, place)) if len(tokens) else place
        within = (place - last - 1)[is_word]
        return tokens[is_word] - len(_BREAKS), np.flatnonzero(within % RUN_WORDS == 0)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, stem, toxic, ordinary) of labelled texts, combined within a batch."""
    for batch in batches:
        read = Batch(batch.column("text").to_pylist())
        counts = np.zeros((2, len(read.words)), np.int64)
        for k, label in enumerate(batch.column("label").to_pylist()):
            counts[1 - label] += np.bincount(read.sentences(k)[0], minlength=len(read.words))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (read.words, read.stems[read.stem_of], *counts)], ["word", "stem", "toxic", "ordinary"])


def _run_features(ratio: np.ndarray, starts: np.ndarray) -> list[float]:
    """TOP_RUNS largest means of a run, mean of all, log of the number of runs."""
    if not len(ratio):
        return [0.0] * (TOP_RUNS + 2)
    length = np.diff(starts, append=len(ratio))
    runs = np.sort(np.add.reduceat(ratio, starts) / (length + RUN_PRIOR))[::-1][:TOP_RUNS]
    return [*runs.tolist(), *[0.0] * (TOP_RUNS - len(runs)), float(ratio.sum() / (len(ratio) + RUN_PRIOR)), float(np.log1p(len(starts)))]


def _batch_features(batch: pa.RecordBatch, classes: Classes, table: Table) -> tuple[list[int], np.ndarray]:
    """Numbers of words, and the features of each text. A batch with labels has its texts taken out of the counts; one with the columns
    of ``_joined`` has counts of words that the table lacks."""
    read = Batch(batch.column("text").to_pylist())
    known, counts = table.lookup(read.words, read.stems[read.stem_of])
    labels = batch.column("label").to_pylist() if "label" in batch.schema.names else None
    more = batch.column("found") if "found" in batch.schema.names else None
    ratio = classes.ratios(known, counts)
    lengths, features = [], []
    for k in range(batch.num_rows):
        words, starts = read.sentences(k)
        if len(words) and (labels or more):
            mine, inverse, times = np.unique(words, return_inverse=True, return_counts=True)
            there, rows = known[mine], counts[mine]
            if more and more[k].is_valid:
                found = more[k].values
                at, extra = Table.find(found.field("word").to_numpy(), read.words[mine])
                extra &= ~there
                for c, name in enumerate(_COUNTS):
                    rows[extra, c] = found.field(name).to_numpy()[at[extra]]
                there = there | (extra & (found.field("known").to_numpy(zero_copy_only=False)[at] if len(found) else False))
            own = None
            if labels:
                stem = read.stem_of[mine]
                own = np.column_stack([times, np.bincount(stem, times)[stem]])
            each = classes.ratios(there, rows, own, labels and labels[k], len(words))[inverse]
        else:
            each = ratio[words]
        lengths.append(len(words))
        features.append(_run_features(each, starts))
    return lengths, np.array(features).reshape(-1, TOP_RUNS + 2)


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x = _batch_features(batch, *shared.value)
            columns = {c: batch.column(c) for c in batch.schema.names if c in ("doc_id", "label")} | {"n": pa.array(n, pa.int64())}
            columns |= {f"x{k}": pa.array(x[:, k]) for k in range(x.shape[1])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _kept(shared, beta: np.ndarray, column: str):
    """The rows that aren't predicted to be toxic, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(column)], ["text"])
            x = _batch_features(texts, *shared.value)[1]
            yield batch.filter(pa.array(beta[0] + x @ beta[1:] < 0))

    return run


def _missing(shared):
    """(d1, d2, word, stem) of the different words of a text that the table lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value[1]
        for batch in batches:
            read = Batch(batch.column("text").to_pylist())
            lacks = ~table.find(table.words, read.words)[1]
            words = [np.unique(read.sentences(k)[0]) for k in range(batch.num_rows)]
            words = [w[lacks[w]] for w in words]
            all_words, times = np.concatenate([*words, np.empty(0, np.int64)]), [len(w) for w in words]
            keys = [np.repeat(batch.column(c).to_numpy(), times) for c in ("d1", "d2")]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (*keys, read.words[all_words], read.stems[read.stem_of[all_words]])], ["d1", "d2", "word", "stem"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Newton's method for a ridge logistic regression; the first column is the intercept."""
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        move = np.linalg.solve(hessian, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return beta


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int) -> DataFrame:
    """(doc_id, text, label, fold): a document without label, or with contradictory ones, has a null label."""
    known = labels.groupBy("doc_id").agg(F.min(column).alias("low"), F.max(column).alias("high")).filter("low = high AND doc_id IS NOT NULL").select(F.col("doc_id").alias("label_id"), F.col("low").cast("int").alias("label"))
    known = materialize(known)
    side = F.broadcast(known) if small_enough(known, BROADCAST_LABELS) else known
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "text", "label", fold(F.col("doc_id"), folds).alias("fold"))


def mass_of(counts: np.ndarray, n: np.ndarray, discount: float) -> float:
    """Share of the occurrences that a discount takes, where ``n`` expressions have each of ``counts``."""
    return float((np.minimum(counts, discount) * n).sum() / (counts * n).sum())


def discount_of(counts: np.ndarray, n: np.ndarray, mass: float) -> float:
    """The discount that takes a share of ``mass``."""
    low, high = 0.0, float(counts.max())
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if mass_of(counts, n, middle) < mass else (low, middle)
    return low


@dataclass
class Model:
    classes: Classes
    table: Table
    words: DataFrame  # all counts, in the shared folder
    stems: DataFrame


def _by_count(table: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """How many rows have each count above 0: at most the root of twice the corpus's words."""
    found = table.filter(F.col(column) > 0).groupBy(F.col(column).alias("c")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    return found.column("c").to_numpy().astype(float), found.column("n").to_numpy().astype(float)


def fit_model(rows: DataFrame) -> Model:
    """Counts of every word and stem of both classes, over all rows with a label but the held-out fold's."""
    own = rows.filter((F.col("fold") != HELD_OUT) & F.col("label").isin(0, 1)).select("text", "label")
    found = own.mapInArrow(_class_counts, "word long, stem long, toxic long, ordinary long")
    words = materialize(found.groupBy("word", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    stems = materialize(words.groupBy("stem").agg(F.sum("toxic").alias("stem_toxic"), F.sum("ordinary").alias("stem_ordinary"), F.count(F.lit(1)).alias("stem_types")))
    total = stems.agg(F.sum("stem_toxic").alias("toxic"), F.sum("stem_ordinary").alias("ordinary"), F.sum("stem_types").alias("types"), F.count(F.lit(1)).alias("stems")).first()
    n_toxic, n_ordinary, types, n_stems = (float(total[c] or 0) for c in ("toxic", "ordinary", "types", "stems"))
    classes = Classes(n_toxic, n_ordinary, types, n_stems)
    if n_toxic and n_ordinary:
        for level, table, columns, discount in (("word", words, ("toxic", "ordinary"), WORD_DISCOUNT), ("stem", stems, ("stem_toxic", "stem_ordinary"), STEM_DISCOUNT)):
            mass = mass_of(*_by_count(table, columns[0]), discount)
            discounts = (discount, discount_of(*_by_count(table, columns[1]), mass))
            setattr(classes, f"{level}_mass", mass)
            setattr(classes, f"{level}_discounts", discounts)
    whole = types <= BROADCAST_WORDS
    head = words
    if not whole:  # the words that occur most, as many as fit
        often, n = _by_count(words.select((F.col("toxic") + F.col("ordinary")).alias("both")), "both")
        order = np.argsort(-often)
        fits = np.flatnonzero(np.cumsum(n[order]) <= BROADCAST_WORDS)
        head = words.filter(F.col("toxic") + F.col("ordinary") >= (float(often[order][fits[-1]]) if len(fits) else float("inf")))
    head = head.join(stems, "stem").select("word", *[F.col(c).cast("float") for c in _COUNTS]).toArrow()
    tail = stems.select("stem", *[F.col(c).cast("float") for c in _COUNTS[2:]]).filter(F.lit(whole)).toArrow()
    arrays = []
    for key, columns, part in (("word", _COUNTS, head), ("stem", _COUNTS[2:], tail)):
        keys = part.column(key).to_numpy()
        order = np.argsort(keys)
        arrays += [keys[order], np.column_stack([part.column(c).to_numpy() for c in columns]).astype(np.float32).reshape(-1, len(columns))[order]]
    return Model(classes, Table(*arrays, whole), words, stems)


def _joined(rows: DataFrame, model: Model, shared) -> DataFrame:
    """``rows`` with the counts of the words that the broadcast lacks, as array ``found`` (null: none). Each different text
    is looked up once, by two hashes."""
    keyed = rows.withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(7), "text")})
    lacks = keyed.select("d1", "d2", "text").dropDuplicates(["d1", "d2"]).mapInArrow(_missing(shared), "d1 long, d2 long, word long, stem long")
    counted = model.words.drop("stem").withColumn("known", F.lit(True))
    found = lacks.join(counted, "word", "left").join(model.stems, "stem", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in _COUNTS]
    entry = F.struct("word", F.coalesce("known", F.lit(False)).alias("known"), *numbers)
    by_text = found.groupBy(F.col("d1").alias("t1"), F.col("d2").alias("t2")).agg(F.array_sort(F.collect_list(entry)).alias("found"))
    return keyed.join(by_text, (F.col("d1") == F.col("t1")) & (F.col("d2") == F.col("t2")), "left").drop("d1", "d2", "t1", "t2")


_SCHEMA = "n long, " + ", ".join(f"x{k} double" for k in range(TOP_RUNS + 2))


def _featured(rows: DataFrame, model: Model, shared) -> DataFrame:
    """(doc_id, label if ``rows`` has it, n, x0, x1, ...) of rows (doc_id, text, label)."""
    schema = "doc_id long, " + ("label int, " if "label" in rows.columns else "") + _SCHEMA
    return (rows if model.table.whole else _joined(rows, model, shared)).mapInArrow(_features(shared), schema)


def fit(rows: DataFrame) -> tuple[Model, object, np.ndarray]:
    """Models, their broadcast and the calibration, from ``labelled`` rows; the held-out fold's labels are not looked at."""
    model = fit_model(rows)
    shared = rows.sparkSession.sparkContext.broadcast((model.classes, model.table))
    seen = rows.filter((F.col("fold") != HELD_OUT) & F.col("label").isin(0, 1)).select("doc_id", "label", "text")
    sample = hash_sample(seen, CALIBRATION_ROWS, lambda some: _featured(some, model, shared)).toArrow()
    y = sample.column("label").to_numpy().astype(float)
    x = np.column_stack([np.ones(len(y)), *(sample.column(f"x{k}").to_numpy() for k in range(TOP_RUNS + 2))])
    return model, shared, fit_logistic(x, y) if len(y) else np.array([-3.0, *[0.0] * (TOP_RUNS + 2)])


def _scored(rows: DataFrame, model: Model, shared, beta: np.ndarray) -> DataFrame:
    found = _featured(rows.select("doc_id", "text"), model, shared)
    z = sum((F.lit(float(b)) * F.col(f"x{k}") for k, b in enumerate(beta[1:])), F.lit(float(beta[0])))
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))))
    return found.withColumn("score", score)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text: (doc_id, held_out, score, predicted, n_words, top_ratio, mean_ratio).

    Two interpolated Kneser-Ney models give p(word | class) in toxic and in ordinary texts. Counts of a word in a class are
    discounted, and what the discounts take goes to the word's stem (its first letters), whose counts in the class are discounted in turn; what
    these leave goes to continuation counts that both classes share: how many different words a stem begins, and a word's
    share in them. So a rare expression says what others of its stem say, and an unknown one nothing. The smaller class is
    discounted by fixed numbers; the other by those that leave the same mass to the backoff, so that words which are rare in both don't
    speak for the smaller class. The models know every word of all labelled rows outside the held-out fold: there are no least counts, and
    the tables grow with the input.

    Sentences are cut into runs of RUN_WORDS words, and the log-likelihoods of each run are compared, normalised by its length; one
    toxic line isn't drowned by a long text. The score is calibrated on the largest differences of runs, the mean over the text
    and the number of runs, by logistic regression on at most CALIBRATION_ROWS labelled rows, each without its own counts.

    Up to BROADCAST_WORDS words the models go to the workers whole. Beyond, the most frequent ones do, and the other words of each
    different text are joined with their counts: the same scores, at the cost of a shuffle.

    Words are compared by 64-bit hashes. Nulls: null and empty texts score as having no word; a null id is carried along, belongs to the
    fold of the empty text and has no label; repeated rows score alike; a doc_id with contradictory labels has none, nor one with a
    label other than 0 and 1. Without labels of both kinds, all texts of a length score alike. Language, source and id are no inputs.
    Other columns are not looked at.
    """
    rows = labelled(docs, labels, "toxic", FOLDS)
    scored = _scored(rows, *fit(rows))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("n").alias("n_words"), F.col("x0").alias("top_ratio"), F.col(f"x{TOP_RUNS}").alias("mean_ratio"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted to be toxic, all columns; each row goes by its own text, with or without an id."""
    rows = labelled(docs, labels, "toxic", FOLDS)
    model, shared, beta = fit(rows)
    if model.table.whole:
        return docs.mapInArrow(_kept(shared, beta, "text"), docs.schema)
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text").dropDuplicates(["doc_id", "text"])
    toxic = _scored(texts, model, shared, beta).filter("score >= 0.5").select(F.col("doc_id").alias("toxic_text")).distinct()
    return docs.join(toxic, F.xxhash64("text") == F.col("toxic_text"), "left_anti")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
