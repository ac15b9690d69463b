"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of n words may stand in a document with up to e = n * rate word edits (insert, drop, replace). Cut into e + 1 pieces, at least one
piece then occurs unchanged, so every exact hit of a piece opens a window of the document that is wide enough for the whole item, and the
window is decided by Myers' bit-parallel edit distance (one machine integer of n bits a word of text). Words are runs of letters and digits
(bytes above 127 count as letters), A-Z lower-cased, so that blanks and punctuation do not matter.

The pieces of a block of test items go to every task; a block holds at most ``max_words`` words of test items, and more items mean more
blocks, each a scan of its own over the documents. Documents are never shuffled.

Defined results: null, empty or wordless texts hold nothing, and a test item that is null or has no word matches nothing. A document is named by
its id; rows that share one are searched on their own and their findings come back together. Rows without id are not reported by
``matches`` (a filter keeps them unless its rows match). Items that share an id are all searched, each by its own text; items without id are not
reported. Several places or texts of one item id in one document give one row, that of the smallest distance (of equal ones, of fewest item words).
Other columns are ignored.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import textcodes as T

RATE, MAX_WORDS = 0.2, 400_000


def word_hashes(text: str) -> np.ndarray:
    return T.words(*T.utf8(pa.array([text])), letters_only=True)[0]


def pieces_of(words: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """(first word, words) of budget + 1 pieces of nearly equal length."""
    ends = np.linspace(0, len(words), budget + 2).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(ends[:-1], ends[1:])]


def myers(pattern: list[int], text: list[int]) -> int:
    """Smallest edit distance between the pattern and any stretch of the text."""
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    places: dict[int, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    up, down, score = full, 0, n
    best = n
    for w in text:
        equal = places.get(w, 0)
        x = equal | down
        zero = (((equal & up) + up) ^ up) | equal
        plus, minus = down | ~(zero | up) & full, up & zero
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full  # a stretch may begin anywhere, so nothing is carried in
        minus = minus << 1 & full
        up, down = minus | ~(x | plus) & full, plus & x
        if score < best:
            best = score
    return best


class Items:
    """Pieces of test items in tables by piece length. Items are known by their place among the different (id, text); ``ids`` has the ids."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.ids: list[int] = []
        self.words: dict[int, list[int]] = {}
        self.budget: dict[int, int] = {}
        found: dict[int, list] = {}
        for item, (name, text) in enumerate(dict.fromkeys(items)):
            self.ids.append(name)
            w = word_hashes(text)
            if not len(w):
                continue
            self.words[item] = w.tolist()
            self.budget[item] = budget = int(len(w) * rate)
            for at, size in pieces_of(w, budget):
                found.setdefault(size, []).append((int(T.run_hash([w[i:i + 1] for i in range(at, at + size)])[0]), item, at))
        self.tables = {}
        for size, rows in found.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            flags = np.zeros(1 << 20, bool)
            flags[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.tables[size] = (keys, [r[1:] for r in rows], flags)

    def search(self, h: np.ndarray, rows: np.ndarray) -> dict[tuple[int, int], int]:
        """{(row, item): smallest distance within the budget} of all rows."""
        windows: dict[tuple[int, int], set] = {}
        for size, (keys, who, flags) in self.tables.items():
            g, starts = T.grams(h, rows, size)
            maybe = np.flatnonzero(flags[(g >> np.uint64(44)).astype(np.int64)])
            at = np.searchsorted(keys, g[maybe])
            at[at == len(keys)] = 0
            hit = keys[at] == g[maybe]
            maybe, at = maybe[hit], at[hit]
            row = np.searchsorted(starts, maybe, side="right") - 1
            upto = np.searchsorted(keys, g[maybe], side="right")
            for place, first, last, r in zip((maybe - starts[row]).tolist(), at.tolist(), upto.tolist(), row.tolist()):
                for item, offset in who[first:last]:
                    windows.setdefault((r, item), set()).add(place - offset)
        out = {}
        for (r, item), begins in windows.items():
            pattern, budget = self.words[item], self.budget[item]
            low, best, done = rows[r], budget + 1, None
            for begin in sorted(begins):
                a, b = max(0, begin - budget), min(int(rows[r + 1] - low), begin + len(pattern) + budget)
                if done is not None and a <= done[1]:
                    done = (done[0], max(done[1], b))
                    continue
                if done is not None:
                    best = min(best, myers(pattern, h[low + done[0]:low + done[1]].tolist()))
                done = (a, b)
                if best == 0:
                    break
            if best and done is not None:
                best = min(best, myers(pattern, h[low + done[0]:low + done[1]].tolist()))
            if best <= budget:
                out[(r, item)] = best
        return out


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, max_words: int) -> list[list[tuple[int, str]]]:
    """Test items in blocks of at most ``max_words`` words (one item at least), read in id order without holding more than one block's text
    beyond what the caller keeps."""
    blocks, size = [[]], 0
    ordered = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(item_col, text_col).orderBy(item_col, text_col)
    for r in ordered.toLocalIterator():
        n = len(word_hashes(r[1]))
        if size + n > max_words and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((r[0], r[1]))
        size += n
    return [b for b in blocks if b]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", rate: float = RATE, max_words: int = MAX_WORDS) -> DataFrame:
    """(id, item_id, distance, item_words) of all test items that stand in a document within their budget of word edits."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    found = None
    for block in blocks_of(benchmark, item_col, item_text_col, max_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)  # at most max_words words

        def run(batches, sent=sent):
            items = Items(sent.value, rate)
            for b in batches:
                ids, column = b.column(0), b.column(1)
                _, offs = T.utf8(column)
                at = 0
                while at < len(b):
                    to = max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 20), side="right")) - 1)
                    h, _, _, starts = T.words(*T.utf8(column.slice(at, to - at)), letters_only=True)
                    got = items.search(h, starts)
                    yield pa.RecordBatch.from_pydict({
                        "id": [ids[at + r].as_py() for r, _ in got], "item_id": [items.ids[i] for _, i in got], "distance": list(got.values()),
                        "item_words": [len(items.words[i]) for _, i in got]}, schema=pa.schema([(c, pa.int64()) for c in ("id", "item_id", "distance", "item_words")]))
                    at = to
        part = rows.mapInArrow(run, "id bigint, item_id bigint, distance bigint, item_words bigint")
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "id bigint, item_id bigint, distance bigint, item_words bigint")
    nearest = found.groupBy("id", "item_id").agg(F.min(F.struct("distance", "item_words")).alias("nearest"))
    return nearest.select("id", "item_id", "nearest.distance", "nearest.item_words")
