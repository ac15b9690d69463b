"""Packing of token pieces into sequences: cutting stock by column generation.

A document of n ids gives whole sequences of ``length`` ids and one rest. Rests are counted by length class (``step`` ids wide, rounded
up). A linear program over that histogram asks for the fewest sequences; its columns are patterns, how many rests of each class one
sequence takes. Only patterns that help are made: the program's prices go into a knapsack over the sequence length, solved by dynamic programming, and its
best filling becomes the next column, until no filling is worth more than a sequence. The fractional solution is rounded down, the few rests left over are
filled by falling length. Histogram, program and patterns have at most length / step rows, whatever the number of documents.

Rests are ranked within their class (counts by class and hash bucket first, then ranks inside a bucket), and a rank points to a pattern, a sequence of
that pattern, and a place in it. Offsets are running sums of true lengths in a sequence.

Defined results: a null or empty text is the single id that ends a document. Rows are packed one by one, so repeated rows and rows without id are packed
as often as they come. A very long text is many whole sequences. An empty table gives no pieces. Other columns are ignored.
"""
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm import textcodes as T
from evalspark.llm.shared import kept
from evalspark.llm.tokens import encoder

LENGTH, STEP, BUCKETS = 1024, 8, 64


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 0,
                 with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, turn [, ids]) per piece: whole sequences, then the rest."""
    def run(batches):
        tool = encoder(vocabulary)
        for b in batches:
            column = b.column(1)
            _, offs = T.utf8(column)
            at = 0
            while at < len(b):
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 19), side="right")) - 1)
                ids, rows = tool.encode(column.slice(at, to - at).fill_null("").to_pylist())
                out: dict = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for r, doc in enumerate(b.column(0).slice(at, to - at).to_pylist()):
                    own = np.append(ids[rows[r]:rows[r + 1]], end_id).astype("<u4")
                    for s in range(0, len(own), length):
                        piece = own[s:s + length]
                        out["doc_id"].append(doc)
                        out["start"].append(s)
                        out["length"].append(len(piece))
                        out["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                        out["doc_tokens"].append(len(own))
                        if with_ids:
                            out["ids"].append(piece.astype(np.int32).tolist())
                if not with_ids:
                    del out["ids"]
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.list_(pa.int32()) if c == "ids" else pa.int64()) for c in out]))
                at = to
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of a filling with repetition, and how often it takes each of the ascending sizes; a price of 0 or less buys nothing."""
    helpful = np.flatnonzero(prices > 1e-12)
    if len(helpful) < len(prices):
        value, some = knapsack(sizes[helpful], prices[helpful], capacity) if len(helpful) else (0.0, np.zeros(0))
        taken = np.zeros(len(sizes))
        taken[helpful] = some
        return value, taken
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.searchsorted(sizes, c, side="right")
        if not fits:
            continue
        value = best[c - sizes[:fits]] + prices[:fits]
        k = int(value.argmax())
        best[c], choice[c] = (value[k], k) if value[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    taken, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            taken[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), taken


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4_000, gap: float = 4e-3) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) covering the demand: the linear program by column generation, rounded down, rests by falling size.

    Revised simplex from pairs that fill a sequence and patterns of one size; it ends when no pattern is worth more than 1 + ``gap``, which bounds the
    program's value from below within that factor, or after ``rounds`` patterns. Every piece is placed either way.
    """
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(np.maximum(capacity // sizes, 1).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    place = {int(x): k for k, x in enumerate(sizes)}
    for k, x in enumerate(sizes.tolist()):  # the scarcer of two sizes that fill a sequence begins as their pair
        other = place.get(capacity - x)
        if other is not None and other != k and (demand[k], k) < (demand[other], other):
            columns[:, k] = inverse[:, k] = 0
            columns[[k, other], k] = inverse[k, k] = 1
            inverse[other, k] = -inverse[other, other]
    amount = inverse @ demand
    for _ in range(rounds):
        prices = inverse.sum(0)
        worth, pattern = knapsack(sizes, prices, capacity)
        if worth <= 1 + gap:
            break
        direction = inverse @ pattern
        useful = direction > 1e-9
        if not useful.any():
            break
        ratio = np.where(useful, np.maximum(amount, 0) / np.where(useful, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = amount - step * direction
        amount[out] = step
        columns[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
    times = np.floor(np.maximum(amount, 0) + 1e-6).astype(np.int64)
    left = demand.astype(np.int64).copy()
    plan = []
    for k in np.argsort(-times, kind="stable"):
        pattern = columns[:, k].astype(np.int64)
        n = int(times[k])
        if n and pattern.any():
            n = min(n, int((left[pattern > 0] // pattern[pattern > 0]).min()))
            if n:
                plan.append((pattern, n))
                left -= n * pattern
    order = np.argsort(-sizes, kind="stable")
    while left.any():
        pattern, room = np.zeros(m, np.int64), capacity
        for k in order:
            take = int(min(left[k], room // sizes[k]))
            pattern[k], room = take, room - take * sizes[k]
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, n))
        left -= n * pattern
    return plan


def _slots(plan: list[tuple[np.ndarray, int]], classes: list[int]) -> list[tuple]:
    """(class, first rank, ranks, per sequence, first sequence, first place): where the ranks of a class go."""
    used, out, base = dict.fromkeys(classes, 0), [], 0
    for pattern, n in plan:
        place = 0
        for k in np.flatnonzero(pattern):
            per = int(pattern[k])
            out.append((classes[k], used[classes[k]], n * per, per, base, place))
            used[classes[k]] += n * per
            place += per
        base += n
    return out


def pack(pieces: DataFrame, length: int = LENGTH, step: int = STEP, buckets: int = BUCKETS) -> DataFrame:
    """pieces with sequence_id and offset. Whole sequences follow the packed ones in their numbering."""
    spark = pieces.sparkSession
    rests = pieces.where(F.col("length") < length).withColumns({
        "_class": F.ceil(F.col("length") / step).cast("int"),
        "_bucket": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(buckets)).cast("int")})
    totals = kept(rests.groupBy("_class", "_bucket").agg(F.count("*").alias("n")), "totals")  # at most length / step * buckets rows
    histogram = sorted((r["_class"], r["n"]) for r in totals.groupBy("_class").agg(F.sum("n").alias("n")).collect())
    classes = [c for c, _ in histogram]
    plan = cutting_stock(np.array(classes, np.int64), np.array([n for _, n in histogram], float), length // step)
    packed = sum(n for _, n in plan)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rests.withColumn("_in", F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
    ranked = ranked.join(F.broadcast(totals.select("_class", "_bucket", before.alias("_before"))), ["_class", "_bucket"]) \
        .withColumn("_rank", F.col("_in") + F.col("_before"))
    slots = spark.createDataFrame(_slots(plan, classes) or [(0, 0, 0, 1, 0, 0)], "_c int, _from bigint, _ranks bigint, _per bigint, _base bigint, _place bigint")
    slots = slots.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("_from", "_ranks", "_per", "_base", "_place"))).alias("_slots"))
    # one row of patterns per class, at most length / step of each: bounded by the histogram
    at = ranked.join(F.broadcast(slots), F.col("_class") == F.col("_c")).withColumn(
        "_s", F.element_at(F.filter("_slots", lambda s: s["_from"] <= F.col("_rank")), -1))
    inside = F.col("_rank") - F.col("_s._from")
    placed = at.withColumn("sequence_id", F.col("_s._base") + F.floor(inside / F.col("_s._per"))).withColumn("_at", F.col("_s._place") + inside % F.col("_s._per"))
    running = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    names = pieces.columns
    first = placed.withColumn("offset", F.coalesce(running, F.lit(0))).select(*names, "sequence_id", "offset")
    whole = pieces.where(F.col("length") == length).select(*names, (F.monotonically_increasing_id() + F.lit(packed)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return first.unionAll(whole)
