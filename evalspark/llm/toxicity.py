"""Toxicity categories by a classifier chain.

Categories are predicted one after the other; the linear model of a category reads, besides words and beginnings of words, the probabilities
of the categories before it. While learning, those come from models that did not see the row (out of fold), so that later models learn
from probabilities as good as those they will meet. Every model is a logistic regression by follow-the-regularised-leader.

Labels say only whether a row is toxic. The other categories are derived from it and the text: markers are cells that (nearly) only toxic
training rows have; ``repeated`` are toxic rows with at least three markers, ``dense`` toxic rows in which one word in fifty or more is a marker.
Callers with labels of their own give them to ``fit_chain``.

``fit`` learns from at most ``max_rows`` labelled rows (smallest id hash), which one task holds as features; scoring reads all rows.

Defined results: null, empty and wordless texts get the probabilities of the biases; rows without label, or with one other than 0 and 1, teach
nothing; without labelled rows every probability is 0.5 and nothing is toxic. Repeated rows and rows without id are scored like
any other. Other columns pass through ``score`` untouched.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from evalspark.llm import hashedmodel as H
from evalspark.llm.quality import slices, training_rows

CATEGORIES = ("toxic", "repeated", "dense")
MAX_ROWS, FOLDS, MIN_MARKED, SURE, CHAIN = 8_000, 3, 5, 0.95, 4.0
SIZE = 1 << H.BITS
RATES = {"alpha": 1.0, "l1": 8.0, "l2": 1.0}


def _row(cells: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and values of a row: its words, the earlier probabilities, the bias."""
    at = np.concatenate([cells, SIZE + np.arange(len(earlier)), [SIZE + len(CATEGORIES)]])
    return at, np.concatenate([np.ones(len(cells)), CHAIN * earlier, [1.0]])


def _train(rows: list[np.ndarray], earlier: np.ndarray, labels: np.ndarray, use: np.ndarray) -> np.ndarray:
    model = H.Ftrl(SIZE + len(CATEGORIES) + 1, **RATES)
    for i in use:
        model.learn(*_row(rows[i], earlier[i]), float(labels[i]))
    return model.weights()


def _predict(rows: list[np.ndarray], earlier: np.ndarray, use: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.array([H.sigmoid(w[(r := _row(rows[i], earlier[i]))[0]] @ r[1]) for i in use])


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """Weights (categories x cells) of the chain; labels: rows x categories in the order of the chain."""
    n, m = labels.shape
    out_of_fold, models = np.zeros((n, m)), []
    fold = np.arange(n) % folds
    for j in range(m):
        for f in range(folds):
            w = _train(rows, out_of_fold[:, :j], labels[:, j], np.flatnonzero(fold != f))
            held = np.flatnonzero(fold == f)
            out_of_fold[held, j] = _predict(rows, out_of_fold[:, :j], held, w)
        models.append(_train(rows, out_of_fold[:, :j], labels[:, j], np.arange(n)))
    return np.stack(models)


def derived_labels(rows: list[np.ndarray], words: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """toxic, repeated, dense for rows given as distinct cells and their numbers of words."""
    everywhere, in_toxic = np.zeros(SIZE), np.zeros(SIZE)
    for cells, t in zip(rows, toxic):
        everywhere[cells] += 1
        if t:
            in_toxic[cells] += 1
    marker = (in_toxic >= MIN_MARKED) & (in_toxic >= SURE * everywhere)
    count = np.array([int(marker[c].sum()) for c in rows])
    return np.stack([toxic, toxic & (count >= 3), toxic & (count * 50 >= np.maximum(words, 1))], 1).astype(float)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> np.ndarray:
    def featured(batches):
        for b in batches:
            for at, part in slices(b.column(0)):
                groups, n = H.word_groups(part)
                cell, _, rows = H.presence(groups, n)
                words = np.diff(groups[0][1])
                yield pa.RecordBatch.from_arrays([b.column(2).slice(at, n), b.column(1).slice(at, n), pa.array(words, pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(cell, pa.int32()))], ["turn", "label", "words", "cell"])

    def learned(batches):
        rows, words, toxic = [], [], []
        for b in batches:
            toxic += b.column(1).to_pylist()
            words += b.column(2).to_pylist()
            rows += [x.values.to_numpy() for x in b.column(3)]
        if rows:
            w = fit_chain(rows, derived_labels(rows, np.array(words), np.array(toxic) == 1))
        else:
            w = np.zeros((len(CATEGORIES), SIZE + len(CATEGORIES) + 1))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()])], ["w"])
    rows = training_rows(docs, labels, label, max_rows).mapInArrow(featured, "turn bigint, label int, words bigint, cell array<int>")
    row = rows.repartition(1).sortWithinPartitions("turn", "label").mapInArrow(learned, "w binary").first()
    if row is None:  # a plan known to be empty runs no task at all
        return np.zeros((len(CATEGORIES), SIZE + len(CATEGORIES) + 1))
    return np.frombuffer(bytes(row["w"]), np.float32).reshape(len(CATEGORIES), -1).astype(np.float64)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with a probability p_<category> for each category, predicted along the chain."""
    used = np.flatnonzero((weights[:, :SIZE] != 0).any(0))
    spread = docs.sparkSession.sparkContext.broadcast((used, weights[:, used], weights[:, SIZE:]))

    def run(batches):
        cells, own, rest = spread.value
        place = np.full(SIZE, -1, np.int32)
        place[cells] = np.arange(len(cells))
        for b in batches:
            out = np.zeros((len(CATEGORIES), len(b)))
            for at, part in slices(b.column(b.schema.get_field_index(text_col))):
                groups, n = H.word_groups(part)
                keys = []
                for number, (g, r) in enumerate(groups):
                    p = place[H.cells_of(g, number)]
                    hit = np.flatnonzero(p >= 0)
                    keys.append((np.searchsorted(r, hit, side="right") - 1) * SIZE + p[hit])
                key = np.unique(np.concatenate(keys))
                row, cell = key // SIZE, key % SIZE
                earlier: list[np.ndarray] = []
                for j in range(len(CATEGORIES)):
                    z = np.bincount(row, own[j][cell], n) + rest[j, -1]
                    for i, p in enumerate(earlier):
                        z = z + rest[j, i] * CHAIN * p
                    earlier.append(H.sigmoid(z))
                out[:, at:at + n] = earlier
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x) for x in out]], [*b.schema.names, *[f"p_{c}" for c in CATEGORIES]])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(f"p_{c}", DoubleType()) for c in CATEGORIES]]))
