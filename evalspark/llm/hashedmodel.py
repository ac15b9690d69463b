"""Hashed text features and a logistic regression trained with follow-the-regularised-leader updates, in numpy inside tasks.

A text becomes a sparse vector over 2**BITS cells. For style it holds word runs of 1 and 2 and runs of up to 3 word shapes; a shape keeps only
the kind of each byte (capital, small letter, digit, blank, other sign as it is) with repeats folded, and a line end is a word of its own
there, so that layout and punctuation count as well as words. For single words it holds words and their beginnings. Nothing but the text is used.
"""
import numpy as np
import pyarrow as pa

from evalspark.llm import textcodes as T

BITS = 20
SCALE = 10.0
_KIND = np.arange(256, dtype=np.uint8)
_KIND[0x41:0x5B] = ord("A")
_KIND[0x61:0x7B] = ord("a")
_KIND[0x80:] = ord("a")
_KIND[0x30:0x3A] = ord("0")
_KIND[[0x09, 0x0B, 0x0C, 0x0D]] = 0x20


def _shapes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word's shape with line ends as words, and row offsets."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = _KIND[raw]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) & ~((kind[1:] == 0x20) & (kind[:-1] == 0x0A))
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    keep[inner] = True
    kept = kind[keep]
    places = np.concatenate([[0], np.cumsum(keep)])[offsets]
    # each line end becomes a byte between two blanks
    width = np.where(kept == 0x0A, 3, 1)
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.full(at[-1], 0x20, np.uint8)
    ends = kept == 0x0A
    out[at[:-1][~ends]] = kept[~ends]
    out[at[:-1][ends] + 1] = 0x01
    h, _, _, rows = T.words(out, at[places], lower=False)
    return h, rows


def style_groups(text: pa.Array) -> tuple[list, int]:
    """Word runs of 1 and 2 and word-shape runs of 1 to 3, each as hashes with row offsets; and the number of rows."""
    raw, offsets = T.utf8(text)
    h, _, _, rows = T.words(raw, offsets, letters_only=True)
    shape, shape_rows = _shapes(raw, offsets)
    return [(h, rows), T.grams(h, rows, 2), (shape, shape_rows), T.grams(shape, shape_rows, 2), T.grams(shape, shape_rows, 3)], len(offsets) - 1


def word_groups(text: pa.Array) -> tuple[list, int]:
    """Words and their beginnings, which stand for a stem."""
    raw, offsets = T.utf8(text)
    h, first, last, rows = T.words(raw, offsets, letters_only=True)
    return [(h, rows), *[(_beginnings(raw, first, last, size), rows) for size in (4, 5, 6, 7)]], len(offsets) - 1


def cells_of(g: np.ndarray, number: int) -> np.ndarray:
    return (T.mix(g + np.uint64(number + 1)) >> np.uint64(64 - BITS)).astype(np.int64)


def frequencies(groups: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, value, row offsets): SCALE times the share of each cell in its group of features."""
    keys, values = [], []
    for number, (g, r) in enumerate(groups):
        size = np.diff(r)
        keys.append((np.repeat(np.arange(n, dtype=np.int64), size) << BITS) | cells_of(g, number))
        values.append(np.repeat(SCALE / np.maximum(size, 1), size))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(at, np.concatenate(values), len(key))
    return key & ((1 << BITS) - 1), value, np.searchsorted(key >> BITS, np.arange(n + 1))


def frequency_dots(groups: list, n: int, weights: np.ndarray) -> np.ndarray:
    """The dot product of each row's frequencies with the weights, without building them."""
    total = np.zeros(n)
    for number, (g, r) in enumerate(groups):
        sums = np.concatenate([[0.0], np.cumsum(weights[cells_of(g, number)])])
        total += (sums[r[1:]] - sums[r[:-1]]) * SCALE / np.maximum(np.diff(r), 1)
    return total


def presence(groups: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, 1, row offsets): which cells a row has."""
    key = np.unique(np.concatenate([(np.repeat(np.arange(n, dtype=np.int64), np.diff(r)) << BITS) | cells_of(g, number)
                                    for number, (g, r) in enumerate(groups)]))
    return key & ((1 << BITS) - 1), np.ones(len(key)), np.searchsorted(key >> BITS, np.arange(n + 1))


def _beginnings(raw: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes of each word, A-Z lower-cased."""
    out = np.full(len(first), size, np.uint64)
    for i in range(size):
        at = np.minimum(first + i, last - 1)
        byte = np.where(first + i < last, T._LOWER[raw[at]] if len(raw) else 0, 0)
        out = out * np.uint64(0x100000001B3) + byte.astype(np.uint64)
    return T.mix(out)


class Ftrl:
    """Follow-the-regularised-leader (proximal) for logistic loss, one example at a time."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.2, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, cells=slice(None)) -> np.ndarray:
        z = self.z[cells]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[cells])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, cells: np.ndarray, values: np.ndarray, label: float, weight: float = 1.0) -> None:
        w = self.weights(cells)
        g = (sigmoid(w @ values) - label) * weight * values
        n = self.n[cells]
        self.z[cells] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[cells] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def dots(cell: np.ndarray, value: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sparse dot product of each row with the weights; an empty row gives 0."""
    total = np.concatenate([[0.0], np.cumsum(weights[cell] * value)])
    return total[rows[1:]] - total[rows[:-1]]
