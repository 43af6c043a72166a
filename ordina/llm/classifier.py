"""Quality classifier by co-training: a text view and a metadata view teach each other, then score together."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality_rules import MEASURES, measure
from .words import Vocabulary

#: Labelled rows that the views are fitted on at most. All other rows, however many, are what they teach each other on.
FIT_LABELLED = 4000
#: One labelled row in so many is held out to calibrate the views.
HELD = 4
ROUNDS = 3
#: Steps of a round, each a pass over all rows.
STEPS = 3
#: A view teaches the other the rows whose calibrated probability is this sure; one that cannot tell teaches nothing.
SURE = 0.95
#: All pseudo-labels of a view together count at most so many times its labels.
PSEUDO = 1.0
SOURCES = 64
#: Hashed counts of words and of word pairs in the text view.
GRAMS = 128
#: Rows that partial sums of all tasks are added up in before they come to the driver.
SLOTS = 16


def text_view(text: str | None, vocabulary: Vocabulary) -> list[float]:
    """Features of the whole text: measures, and shares of hashed words and word pairs; null counts as empty."""
    m = dict(zip(MEASURES, measure(text, vocabulary), strict=True))
    words, chars, lines = max(1, m["n_words"]), max(1, m["word_chars"]), max(1, m["n_lines"])
    data = (text or "").encode()
    total = max(1, len(data))
    digits = total - len(data.translate(None, b"0123456789"))
    marks = total - len(data.translate(None, b".,;:?"))
    codes = vocabulary.codes(data.lower().split())
    grams = np.bincount(np.concatenate([codes, Vocabulary.windows(codes, 2)]).astype(np.uint64) % np.uint64(GRAMS), minlength=GRAMS) if len(codes) else np.zeros(GRAMS)
    return [
        float(m["n_words"] < 10), m["n_symbols"] / chars, m["n_dup_lines"] / lines, m["n_repeat_words"] / words, m["n_upper"] / chars, m["n_bangs"] / words,
        m["word_chars"] / words / 10, np.log1p(words / lines) / 5, digits / total, marks / words, float(m["n_symbols"] > 0.02 * chars), float(m["n_repeat_words"] > 0.2 * words), float(m["n_upper"] > 0.5 * chars),
        *np.sqrt(grams / max(1, grams.sum())).tolist(),
    ]


TEXT_WIDTH = 13 + GRAMS
LANGS = ("en", "de", "fr", "es")
META_WIDTH = len(LANGS) + 1 + SOURCES + 4


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Features of what is known without reading: language, hashed source, stated length."""
    out = [0.0] * META_WIDTH
    out[LANGS.index(lang) if lang in LANGS else len(LANGS)] = 1.0
    out[len(LANGS) + 1 + xxhash.xxh3_64_intdigest((source or "").encode()) % SOURCES] = 1.0
    size = np.log1p(max(0, n_chars or 0)) / 5
    out[-4:] = [size, size * size, float((n_chars or 0) < 100), float(n_chars is None)]
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, bound: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss, or with ``bound`` its largest curvature anywhere, a step by which
    never overshoots; they add up over parts of the rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = _sigmoid(x @ w)
    return x.T @ (p - y), (x * (0.25 if bound else (p * (1 - p))[:, None])).T @ x


def _step(w: np.ndarray, gradient: np.ndarray, curve: np.ndarray, penalty: float) -> np.ndarray:
    return w - np.linalg.solve(curve + np.diag(np.full(len(w), penalty + 1e-9)), gradient + penalty * w)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the intercept."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        new = _step(w, *_sums(x, y, w), ridge * max(1.0, len(y)) / 100)
        w, moved = new, np.abs(new - w).max()
        if moved < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    """Both views' weights, each view's calibration (slope, offset), and the weights that combine them."""

    views: tuple[np.ndarray, np.ndarray]
    calibrate: np.ndarray
    combine: np.ndarray

    def levels(self, views: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Calibrated log odds of each view."""
        return [c[0] * _logit(x, w) + c[1] for x, w, c in zip(views, self.views, self.calibrate, strict=True)]

    def scores(self, views: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.levels(views)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.combine[0] * a + self.combine[1] * b + self.combine[2])


def _calibrated(views: tuple[np.ndarray, np.ndarray], held: Sequence[np.ndarray], y: np.ndarray) -> Model:
    """Calibration and combination on held-out rows; a view that points the wrong way there counts for nothing."""
    fit = []
    for x, w in zip(held, views, strict=True):
        slope, offset = logistic(_logit(x, w)[:, None], y, 1e-2)
        fit.append((slope, offset) if slope > 0 else (0.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    model = Model(views, np.array(fit), np.zeros(3))
    levels = np.array(model.levels(held)).T
    combine = logistic(levels, y, 1e-2)
    for v in (0, 1):
        if combine[v] < 0:
            alone = logistic(levels[:, 1 - v : 2 - v], y, 1e-2)
            combine = np.zeros(3)
            combine[1 - v], combine[2] = max(0.0, alone[0]), alone[1]
    return replace(model, combine=combine)


#: Adds up, over all rows without a label, each view's sums on what the other is sure of: (gradient, curvature, rows).
Teach = Callable[[Model], list[tuple[np.ndarray, np.ndarray, int]]]


def taught(model: Model, views: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """``Teach`` for one part of the rows."""
    p = [_sigmoid(x) for x in model.levels(views)]
    out = []
    for v in (0, 1):
        sure = (p[1 - v] >= SURE) | (p[1 - v] <= 1 - SURE)
        y = (p[1 - v][sure] > 0.5).astype(float)
        out.append((*_sums(views[v][sure], y, model.views[v], True), int(sure.sum())))
    return out


def fit(views: Sequence[np.ndarray], y: np.ndarray, teach: Teach, rounds: int = ROUNDS) -> Model:
    """Co-trains on labelled rows (views, y in 0/1) and on what ``teach`` adds up over all others.

    Every HELD-th labelled row is held out for calibration. With fewer than 20 labelled rows, or only one class among
    those fitted on or held out, every document gets the share of good labels, or 0.5.
    """
    out = np.arange(len(y)) % HELD == HELD - 1
    if len(y) < 20 or any(len(set(part.tolist())) < 2 for part in (y[out], y[~out])):
        p = min(0.99, max(0.01, y.mean())) if len(y) else 0.5
        flat = (np.zeros(TEXT_WIDTH + 1), np.zeros(META_WIDTH + 1))
        return Model(flat, np.zeros((2, 2)), np.array([0.0, 0.0, np.log(p / (1 - p))]))
    known, held = [x[~out] for x in views], [x[out] for x in views]
    own, n = y[~out], int((~out).sum())
    model = _calibrated((logistic(known[0], own), logistic(known[1], own)), held, y[out])
    for _ in range(rounds):
        moved = model
        for _ in range(STEPS):
            more = teach(replace(model, views=moved.views))
            made = []
            for v, (gradient, curve, rows) in enumerate(more):
                weight = PSEUDO * min(1.0, n / max(1, rows))
                g, c = _sums(known[v], own, moved.views[v], True)
                made.append(_step(moved.views[v], g + weight * gradient, c + weight * curve, 1e-2 * n / 100))
            moved = replace(moved, views=(made[0], made[1]))
        model = _calibrated(moved.views, held, y[out])
    return model


Columns = tuple[str, str, str, str, str]
COLUMNS: Columns = ("doc_id", "text", "lang", "source", "n_chars")


def _narrow(df: DataFrame, columns: Columns) -> DataFrame:
    id_col, text_col, lang_col, source_col, chars_col = columns
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(chars_col).cast("long").alias("n_chars"), F.col(text_col).cast("string").alias("text"))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary()
    for batch in batches:
        text = [np.array(text_view(t.as_py(), vocabulary), np.float32).tobytes() for t in batch.column(4)]
        meta = [np.array(meta_view(*row), np.float32).tobytes() for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], names=["doc_id", "text", "meta"])


def features(df: DataFrame, columns: Columns = COLUMNS) -> DataFrame:
    """doc_id and both views of every row as 32-bit numbers, staged: whole texts are read once."""
    return common.stage(_narrow(df, columns).mapInArrow(_features, "doc_id long, text binary, meta binary"), "classifier-features")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(float)


def _teach(rows: DataFrame) -> Teach:
    """Sums over a table of features: one row per task, added up in SLOTS rows, which come to the driver."""
    sizes = (TEXT_WIDTH + 1, META_WIDTH + 1)

    def flat(sums: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        return np.concatenate([x.ravel() for g, c, n in sums for x in (g, c, np.array([float(n)]))])

    def run(model: Model):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for whole in batches:
                for at in range(0, whole.num_rows, 4000):
                    batch = whole.slice(at, 4000)
                    more = flat(taught(model, (_matrix(batch.column(0), TEXT_WIDTH), _matrix(batch.column(1), META_WIDTH))))
                    total = more if total is None else total + more
            if total is not None:
                slot = xxhash.xxh3_64_intdigest(total.tobytes()) % SLOTS
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

        return part

    def added(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums are added in the order of their bytes, so that no order of tasks changes a rounding.
        parts = sorted(x for batch in group for x in batch.column("sums").to_pylist())
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([sum(np.frombuffer(x) for x in parts).tobytes()], pa.binary())], names=["sums"])

    def teach(model: Model) -> list[tuple[np.ndarray, np.ndarray, int]]:
        made = rows.select("text", "meta").mapInArrow(run(model), "slot int, sums binary").repartition(SLOTS, "slot").mapInArrow(added, "sums binary").collect()
        total = sum((np.frombuffer(x) for x in sorted(bytes(r.sums) for r in made)), np.zeros(sum(k + k * k + 1 for k in sizes)))
        out, at = [], 0
        for k in sizes:
            out.append((total[at : at + k], total[at + k : at + k + k * k].reshape(k, k), int(total[at + k + k * k])))
            at += k + k * k + 1
        return out

    return teach


def train_on(rows: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", rounds: int = ROUNDS) -> Model:
    """``train`` on a table of ``features``."""
    seeded = lambda *more: F.xxhash64(F.lit(5), "doc_id", *more)
    named = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    some = F.broadcast(named.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(seeded(), "doc_id").limit(FIT_LABELLED))
    known = rows.join(some, "doc_id").groupBy("doc_id", "text", "meta").agg(F.max("y").alias("y")).orderBy(seeded("text", "meta"), "doc_id", "text", "meta").limit(FIT_LABELLED).collect()
    views = [np.frombuffer(b"".join(bytes(r[c]) for r in known), np.float32).reshape(-1, width).astype(float) for c, width in (("text", TEXT_WIDTH), ("meta", META_WIDTH))]
    return fit(views, np.array([r.y for r in known], float), _teach(rows.join(some.select("doc_id"), "doc_id", "left_anti")), rounds)


def train(df: DataFrame, labels: DataFrame, label_col: str = "quality", columns: Columns = COLUMNS) -> Model:
    """Fits on at most FIT_LABELLED labelled rows, chosen by hash, and on all rows without a label.

    * a label other than 0 and 1, and one without an id, is left out; of labels that contradict each other the good one
      counts; rows that repeat id and features count once, and rows of one id with different texts are each labelled;
    * an empty table, or too few labels, gives a flat model (see ``fit``).

    In each round both views take steps on their labels and on all rows that the other view, calibrated on
    held-out labels, is sure of: executors add up gradients and curvatures, about thirty thousand numbers, which
    come to the driver. What both views learn from unlabelled rows grows with the table, and its weight does not.
    """
    return train_on(features(df, columns), labels, label_col, columns[0])


def score_on(rows: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``score`` on a table of ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                a, b, both = (np.round(s, 6) for s in model.scores((_matrix(batch.column(1), TEXT_WIDTH), _matrix(batch.column(2), META_WIDTH))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= threshold)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return rows.select("doc_id", "text", "meta").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def score(df: DataFrame, model: Model, columns: Columns = COLUMNS, threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, text_score, meta_score, score, kept (score >= threshold).

    Scores are the views' calibrated probabilities of good quality and their combination, to 6 decimals.

    * null or empty text, null language, source or length have features of their own; null ids and repeated
      rows are carried through; an empty table gives an empty result; other columns are not read.
    """
    return score_on(_narrow(df, columns).mapInArrow(_features, "doc_id long, text binary, meta binary"), model, threshold)
