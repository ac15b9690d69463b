"""Words of whole Arrow text columns as 64-bit hashes, in numpy, for use inside tasks.

A column's UTF-8 buffer is read as it is; words are found and hashed for all its rows at once. Two different words
share a hash with a chance of about 2**-64 a pair.
"""
import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CODES = np.arange(256, dtype=np.uint8)
_LETTERS = np.zeros(256, bool)
_LETTERS[0x30:0x3A] = _LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if _powers["n"] < n:
        size = max(n, SEGMENT + 4096)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def _cuts(gap: np.ndarray, size: int) -> list[int]:
    """Segment ends of about ``size`` bytes that never cut a word; gap: which bytes separate words."""
    ends, at, n = [], 0, len(gap)
    while n - at > size:
        to = at + size
        back = np.flatnonzero(gap[max(at, to - 65536):to])
        if len(back):
            to = max(at, to - 65536) + int(back[-1]) + 1
        else:
            while to < n and not gap[to]:
                step = np.flatnonzero(gap[to:to + size])
                to = to + int(step[0]) if len(step) else min(n, to + size)
        ends.append(to)
        at = to
    ends.append(n)
    return ends


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, letters_only: bool = False):
    """Hash of each word, its first byte, its end, and the n + 1 offsets of the rows into these.

    Words are runs of bytes other than the six ASCII blanks; with ``letters_only`` runs of ASCII letters, digits and
    bytes above 127, so that punctuation separates too. Only A-Z are lower-cased.
    """
    fold, gap_of = (_LOWER if lower else _CODES), (~_LETTERS if letters_only else _SPACE)
    hashes, firsts, lasts = [], [], []
    gap_all = gap_of[raw]
    row_start = np.zeros(len(raw) + 1, bool)
    row_start[offsets] = True
    at = 0
    for to in _cuts(gap_all, SEGMENT) if len(raw) else []:
        gap = gap_all[at:to]
        new = row_start[at:to]
        begins = ~gap
        begins[1:] &= gap[:-1] | new[1:]
        stops = ~gap
        stops[:-1] &= gap[1:] | new[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        up, down = _power_tables(to - at + 1)
        total = np.zeros(to - at + 1, np.uint64)
        np.cumsum(_VALUES[fold[raw[at:to]]] * up[:to - at], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        firsts.append(s + at)
        lasts.append(e + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    last = np.concatenate(lasts) if lasts else np.zeros(0, np.int64)
    return h, first, last, np.searchsorted(first, offsets)


def grams(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside a row, and the row offsets into these."""
    counts = np.maximum(np.diff(rows) - k + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], counts) + np.repeat(rows[:-1], counts)
    return run_hash([h[at + j] for j in range(k)]), starts


def run_hash(parts: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0x100000001B3) + p)
    return out


def shingle_sets(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of k words by row, sorted; a shorter row is one shingle, a row without words none."""
    g, starts = grams(h, rows, k)
    counts, n_words = np.diff(starts), np.diff(rows)
    short = np.flatnonzero((counts == 0) & (n_words > 0))
    row = np.repeat(np.arange(len(counts)), counts)
    if len(short):
        whole = np.array([run_hash([h[i:i + 1] for i in range(rows[r], rows[r + 1])])[0] for r in short], np.uint64)
        g, row = np.concatenate([g, whole]), np.concatenate([row, short])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    if len(g):
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        g, row = g[keep], row[keep]
    return g, np.searchsorted(row, np.arange(len(counts) + 1))
