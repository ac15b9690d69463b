"""Periodic runs of words by a sparse diagonal table, and texts with their repeats dropped.

A run is a stretch of words with smallest period q and length >= max(min_length, 2 q) that no neighbouring word extends. On the diagonal of lag q (word
j against word j - q) it is a stretch of at least max(q, min_length - q) equal words. Instead of all earlier occurrences of every word, whose number grows
with the square of a word's frequency, the table looks at blocks of W words: a diagonal stretch of q >= 2 W words holds a whole block that starts at a
multiple of W, so each such block looks up its earlier occurrences at lags 2 W to 4 W only. Each one lengthens its diagonal's stretch by a block; a stretch that
the next block does not lengthen is emitted at once, grown at both ends by words. A level costs at most two lookups a word, whatever the
text repeats, and levels double W until no block of W words occurs twice.

Blocks are named exactly: the name of 2 W words is the rank of the pair of names of its halves. No hashes, no cut of long texts.
"""
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12
BYTES_AT_ONCE = 4 << 20     # text that is worked on together; a longer text is taken alone
SPAN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _pair_names(names: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of blocks of 2 * step words; those that occur once get negative names of their own. Also the repeated ones: names and places, sorted by both."""
    n = len(names)
    out = -np.arange(1, n + 1, dtype=np.int64)
    at = np.flatnonzero((names[:n - step] >= 0) & (names[step:] >= 0)) if n > step else np.zeros(0, np.int64)
    key = names[at] * np.int64(n) + names[at + step]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    repeated = np.repeat(sizes > 1, sizes)
    name = np.repeat(starts, sizes)[repeated]
    at = at[repeated]
    out[at] = name
    return out, name, at


def _stretches(name: np.ndarray, at: np.ndarray, texts: np.ndarray, width: int, lags: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, begin, end) of the diagonals' stretches of whole blocks: blocks at multiples of ``width`` against their earlier occurrences."""
    n = len(texts)
    key = name * np.int64(n + 1) + at
    mine = np.flatnonzero(at % width == 0)
    base, j = name[mine] * np.int64(n + 1), at[mine]
    low = np.searchsorted(key, base + np.maximum(j - lags[1] + 1, 0))
    high = np.searchsorted(key, base + j - lags[0], side="right")
    found = np.maximum(high - low, 0)
    later = np.repeat(j, found)
    earlier = at[np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)]
    same = texts[later] == texts[earlier]
    later, lag = later[same] // width, (later - earlier)[same]
    cell = lag * np.int64(n // width + 2) + later
    order = np.argsort(cell, kind="stable")
    cell, lag, later = cell[order], lag[order], later[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(cell) != 1])) if len(cell) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(cell))[:len(first)] - 1
    return lag[first], later[first] * width, (later[last] + 1) * width


def word_runs(words: np.ndarray, texts: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, sorted by start and period.

    ``words`` holds word numbers (>= 0) of several texts one after another, ``texts`` the text of each word; a word below 0 that occurs once stands
    between two texts.
    """
    if min_length < 2:
        raise ValueError("a run has at least two words")
    n = len(words)
    levels, width = [np.where(words < 0, -np.arange(1, n + 1), words)], 1
    order = np.argsort(levels[0], kind="stable")
    order = order[levels[0][order] >= 0]
    name, at = levels[0][order], order
    while 4 * width - 1 <= -(-min_length // 2):
        names, name, at = _pair_names(levels[-1], width)
        levels.append(names)
        width *= 2
    lags, found = (1, 4 * width), []
    while len(at):
        lag, begin, end = _stretches(name, at, texts, width, lags)
        for half in reversed(range(len(levels) - 1)):  # a neighbouring block does not match whole, so what is left is below the width
            step, names = 1 << half, levels[half]
            grows = end + step <= n
            here = np.where(grows, end, 0)
            end = end + np.where(grows & (names[here] == names[np.maximum(here - lag, 0)]) & (here >= lag), step, 0)
            grows = begin - step >= lag
            here = np.where(grows, begin - step, lag)
            begin = begin - np.where(grows & (names[here] == names[here - lag]), step, 0)
        size = end - begin
        good = size >= np.maximum(lag, min_length - lag)
        found.append((begin[good] - lag[good], size[good] + lag[good], lag[good]))
        names, name, at = _pair_names(levels[-1], width)
        levels.append(names)
        width *= 2
        lags = (2 * width, 4 * width)
    start, length, period = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    # A stretch with several periods is one run of the smallest; two maximal stretches of different periods are different stretches otherwise.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _worked(texts: list[bytes], min_length: int) -> Iterator[tuple[int, list[dict], str]]:
    """For each text the number of its words, its runs and the text without their repeats."""
    split = [t.split() for t in texts]  # bytes.split cuts at [\x20\x09-\x0D]+ exactly
    known: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.full(int((sizes + 1).sum()), -1, np.int64)
    owner = np.repeat(np.arange(len(split)), sizes + 1)
    inside = np.ones(len(words), bool)
    inside[starts + sizes] = False
    words[inside] = np.fromiter(map(known.setdefault, chain.from_iterable(split), count()), np.int64, int(sizes.sum()))
    start, length, period = word_runs(words, owner, min_length)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    keep = np.cumsum(marks)[:-1] == 0
    text_of = owner[start] if len(start) else np.zeros(0, np.int64)
    cuts = np.searchsorted(text_of, np.arange(len(split) + 1))
    start = start - starts[text_of] if len(start) else start
    for i, own in enumerate(split):
        lo, hi = cuts[i], cuts[i + 1]
        if lo < hi:
            left = keep[starts[i]:starts[i] + sizes[i]].tolist()
            own = [w for w, k in zip(own, left) if k]
        yield int(sizes[i]), [{"start": s, "length": n, "period": p} for s, n, p in zip(start[lo:hi].tolist(), length[lo:hi].tolist(), period[lo:hi].tolist())], b" ".join(own).decode(errors="replace")


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """All other columns of ``docs`` with n_words, runs (by start, then period) and collapsed: the words that no run holds after its first period, joined by blanks.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, told apart by their bytes. A null or empty text has no words, no runs and an empty collapsed
    text. Rows are independent: repeated rows give repeated results, an empty table none, columns named like an output are replaced. Memory holds one
    batch of BYTES_AT_ONCE or one longer text.
    """
    others = [f for f in docs.schema.fields if f.name not in (text_col, "n_words", "runs", "collapsed")]
    source = docs.select(*[f"`{f.name}`" for f in others], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("collapsed"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "n_words bigint", f"runs {SPAN}", "collapsed string"])
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            upto = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                spent = upto[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(upto, spent + BYTES_AT_ONCE, side="right")))
                sizes, runs, collapsed = zip(*_worked(texts[at:end], min_length))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes, pa.int64()), pa.array(runs, span), pa.array(collapsed, pa.string())],
                                                 [*part.schema.names[:-1], "n_words", "runs", "collapsed"])
                at = end
    return source.mapInArrow(work, schema)


def longest(runs: Column) -> Column:
    """Of an array of runs the longest one; ties go to the smallest start, then period. Null without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["n"]).alias("length"), best["period"].alias("period")))


def run_lines(runs: Column) -> Column:
    """A line start,length,period for each run."""
    return F.concat_ws("", F.transform(runs, lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))


def plant_period(text: Column, key: Column) -> Column:
    """Texts of one key in ten (by crc32 of the key) with everything after a certain word made periodic; other texts as they are.

    With h = crc32(key), g = h // 10 and n words: where h % 10 = 0 and n > 0, each word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    spec = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), F.size(w).cast("bigint").alias("n")))
    spec = F.transform(spec, lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), (g % s["n"]).alias("a")))
    spec = F.transform(spec, lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), s["a"].alias("a"), (1 + F.floor((s["n"] - s["a"]) / (3 + g % 8))).alias("p")))
    planted = F.transform(spec, lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), s["n"] - 1), lambda i: F.get(
        s["w"], F.when(i >= s["a"], s["a"] + (i - s["a"]) % s["p"]).otherwise(i).cast("int"))), " "))[0]
    return F.when((h % 10 == 0) & F.regexp_like(text, F.lit("[^\\x20\\x09-\\x0D]")), planted).otherwise(text)
