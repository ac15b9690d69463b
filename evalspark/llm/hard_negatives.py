"""Hard negatives: for every anchor its best rows of the same label, and for each of those the best rows of other labels inside a window of its score.

Rows are ordered along a Hilbert curve over the components that vary most and packed into blocks of a Parquet table, each with the least and greatest value of
every component (its zone). Interval arithmetic on a zone bounds the scores of any anchor with the block's rows; a block is read for a group of anchors only if it
can hold a row for one of their windows: upper bound >= the window's lower limit or the score of its last place so far, lower bound <= its upper limit.
A first round reads few promising blocks a group and fixes those last places, a second one reads whatever the bounds leave. Nothing is approximate.

Scores are integer products of floor(scale * x). Single precision is used where every product and partial sum is whole in it, else double, exact up to
2**53; beyond that scores are rounded as doubles are, and beyond a long cut to its limits.
"""
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.shared import kept

AXES, BITS = 8, 4           # components along which the curve runs, bits of each
BLOCKS_PER_PART = 4         # blocks that one packing task makes
PARTS_PER_PAGE = 256        # packing tasks whose zones one task compares with a group at a time
BLOCKS_PER_CHUNK = 64       # blocks that one task reads for a group of anchors
SEEDS_PER_PAGE = 2          # blocks of a page that a group reads in the first round
LIMIT = float(2**63 - 1024)
PACKED = "block bigint, size int, ids array<bigint>, labels array<bigint>, data binary, low binary, high binary"


# ---------------------------------------------------------------- the curve
def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows) with ``bits`` bits a coordinate; bits * columns below 63."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns of every level, the coarsest first
        bit = np.int64(1) << level
        low = bit - 1
        for i in range(dims):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= np.where(turned, 0, swap)
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[dims - 1] >> level) & 1 == 1, (np.int64(1) << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def _whole(column: pa.Array, scale: float) -> np.ndarray:
    """Rows of equal length as floor(scale * x) in double."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(np.float64(scale) * values), -1e300, 1e300).reshape(len(column), -1)


def _lengths(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _profile(rows: DataFrame, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length: the AXES components of greatest variance with mean and deviation. A few numbers a length."""
    def sums(batches):
        for batch in batches:
            column = batch.column(0)
            sizes = _lengths(column)
            for size in np.unique(sizes):
                if size:
                    x = _whole(column.filter(pa.array(sizes == size)), scale).clip(-1e100, 1e100)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(size), size), pa.int32()), pa.array(np.arange(size), pa.int32()),
                                                      pa.array(np.full(int(size), float(len(x)))), pa.array(x.sum(0)), pa.array((x * x).sum(0))], ["size", "axis", "n", "s", "q"])
    totals = rows.select("v").mapInArrow(sums, "size int, axis int, n double, s double, q double").groupBy("size", "axis").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = totals.select("size", "axis", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0)))).alias("dev"))
    best = Window.partitionBy("size").orderBy(F.desc("dev"), "axis")
    out: dict = {}
    for r in spread.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= AXES).orderBy("size", "_r").collect():
        out.setdefault(r["size"], []).append((r["axis"], r["mean"], r["dev"]))
    return {size: tuple(np.array(c) for c in zip(*found)) for size, found in out.items()}


# ---------------------------------------------------------------- blocks and zones
def _compact(x: np.ndarray) -> bytes:
    """Single precision where it holds the numbers exactly, else double; the length tells which."""
    small = x.astype(np.float32)
    return (small if (small == x).all() else x).tobytes()


def _matrix(data: bytes, rows: int, size: int) -> np.ndarray:
    if not size:
        return np.zeros((rows, 0), np.float32)
    return np.frombuffer(data, np.float32 if len(data) == 4 * rows * size else np.float64).reshape(rows, size)


def _packed(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Blocks of at most ``most`` rows (size, h, id, label, data) of one vector length, neighbours on the curve together, ids in order inside a block."""
    parts = max(1, -(-rows.count() // (BLOCKS_PER_PART * most)))
    ranged = rows.repartitionByRange(parts, "size", "h", "id").sortWithinPartitions("size", "h", "id")

    def blocks(batches):
        def block(part):
            size = part[0][0].as_py()
            order = np.argsort(part[2].to_numpy(), kind="stable")
            x = np.stack([_matrix(d, 1, size)[0].astype(np.float64) for d in part[4].to_pylist()])[order]
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([part[2].to_numpy()[order]]), pa.array([part[3].to_numpy()[order]]),
                                               pa.array([_compact(x)], pa.binary()), pa.array([x.min(0).tobytes()], pa.binary()), pa.array([x.max(0).tobytes()], pa.binary())],
                                              ["size", "ids", "labels", "data", "low", "high"])
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows:
                sizes = held.column(0).to_numpy()
                same = int(np.searchsorted(sizes, sizes[0], side="right"))
                if same < most and same == held.num_rows:
                    break  # may go on in the next batch
                part, held = held.slice(0, min(same, most)), held.slice(min(same, most))
                yield block([c.combine_chunks() for c in part.columns])
        while held is not None and held.num_rows:
            sizes = held.column(0).to_numpy()
            same = min(most, int(np.searchsorted(sizes, sizes[0], side="right")))
            part, held = held.slice(0, same), held.slice(same)
            yield block([c.combine_chunks() for c in part.columns])
    packed = ranged.mapInArrow(blocks, PACKED.partition(", ")[2])
    return kept(packed.select(F.monotonically_increasing_id().alias("block"), "*"), name)


def _bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each row of ``a`` with any point of each zone."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
    slack = 1e-9 * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T)  # rounding, and nothing for small numbers
    return least - slack, most + slack


# ---------------------------------------------------------------- windows
def _group_of(row: dict) -> dict:
    """A group of anchors with its windows: one row of low, high and last-place limits for each anchor and slot."""
    ids, size = np.array(row["ids"], np.int64), row["size"]
    out = {"ids": ids, "labels": np.array(row["labels"], np.int64), "x": _matrix(row["data"], len(ids), size)}
    w = row["windows"] or []
    out["slots"] = sorted({x["slot"] for x in w})
    shape = (len(ids), len(out["slots"]))
    out["low"], out["high"] = np.full(shape, np.inf), np.full(shape, -np.inf)  # without a window nothing is wanted
    at = {s: i for i, s in enumerate(out["slots"])}
    place = np.searchsorted(ids, [x["id"] for x in w]) if w else []
    for p, x in zip(place, w):
        out["low"][p, at[x["slot"]]] = -np.inf if x["low"] is None else max(x["low"], x["last"] if x["last"] is not None else x["low"])
        out["high"][p, at[x["slot"]]] = np.inf if x["high"] is None else x["high"]
        if x["low"] is None and x["last"] is not None:
            out["low"][p, at[x["slot"]]] = x["last"]
    return out


WINDOWS = "array<struct<id:bigint,slot:int,low:bigint,high:bigint,last:bigint>>"
HEADER = f"grp bigint, size int, ids array<bigint>, labels array<bigint>, data binary, windows {WINDOWS}"


def _choose(groups: DataFrame, pages: DataFrame, last_page: dict[int, int], same_label: bool, seeds: bool) -> DataFrame:
    """(grp, block, best): blocks that can hold a row for a window of the group; with ``seeds`` only the most promising of each page."""
    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                g = _group_of(row)
                if not g["slots"]:
                    continue
                zones = row["zones"]
                low, high = (np.stack([_matrix(z[k], 1, row["size"])[0] for z in zones]) for k in ("low", "high"))
                least, most = _bounds(g["x"].astype(np.float64), low, high)
                few, many = (np.array([z[k] for z in zones]) for k in ("first_label", "last_label"))
                fits = (g["labels"][:, None] >= few) & (g["labels"][:, None] <= many) if same_label else ~((few == many) & (g["labels"][:, None] == few))
                wanted = np.zeros(least.shape, bool)
                for s in range(len(g["slots"])):
                    wanted |= (most >= g["low"][:, s:s + 1]) & (least <= g["high"][:, s:s + 1])
                wanted &= fits
                hits = np.flatnonzero(wanted.any(0))
                best = np.where(wanted, most, 0.0).sum(0) / np.maximum(wanted.sum(0), 1)
                if seeds:
                    hits = hits[np.argsort(-(best * wanted.sum(0))[hits], kind="stable")[:SEEDS_PER_PAGE]]
                numbers = np.array([z["block"] for z in zones], np.int64)[hits]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hits), row["grp"], np.int64)), pa.array(numbers), pa.array(best[hits])], ["grp", "block", "best"])
    every = F.lit(None).cast("array<bigint>")
    for size, last in last_page.items():
        every = F.when(F.col("size") == size, F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))).otherwise(every)
    paired = groups.withColumn("page", F.explode(every)).join(pages, ["size", "page"])
    return paired.mapInArrow(work, "grp bigint, block bigint, best double")


def _exact_type(a: np.ndarray, c: np.ndarray):
    """Single precision if every product and partial sum is whole in it, else double."""
    most = np.abs(a).max(0, initial=0).astype(np.float64) * np.abs(c).max(0, initial=0).astype(np.float64)
    return np.float32 if most.sum() < 2**24 else np.float64


def _read(chosen: DataFrame, groups: DataFrame, blocks: DataFrame, same_label: bool, k: int) -> DataFrame:
    """(id, slot, score, other): for each window the best k rows of every chunk of the chosen blocks.

    A task gets a group once for each chunk and then the chunk's blocks, best bound first; it holds one of them at a time.
    """
    line = Window.partitionBy("grp").orderBy("block")  # numbers of blocks only
    chosen = chosen.withColumn("chunk", F.floor((F.row_number().over(line) - 1) / BLOCKS_PER_CHUNK))
    body = chosen.join(blocks, "block").select("grp", "chunk", (-F.col("best")).alias("turn"), "size", "ids", "labels", "data", F.lit(None).cast(WINDOWS).alias("windows"))
    head = groups.join(chosen.select("grp", "chunk").distinct(), "grp").select(
        "grp", "chunk", F.lit(float("-inf")).alias("turn"), "size", "ids", "labels", "data", "windows")
    stream = head.unionByName(body).repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "turn")

    def work(batches) -> Iterator[pa.RecordBatch]:
        def flush(g):
            rows, cols, place = np.nonzero(np.isfinite(g["best"]))
            score = np.clip(g["best"][rows, cols, place], -LIMIT, LIMIT)
            return pa.RecordBatch.from_arrays([pa.array(g["ids"][rows]), pa.array(np.array(g["slots"], np.int32)[cols]), pa.array(score.astype(np.int64)),
                                               pa.array(g["other"][rows, cols, place])], ["id", "slot", "score", "other"])
        g = None
        for batch in batches:
            for r in range(len(batch)):
                row = batch.slice(r, 1).to_pylist()[0]
                if row["turn"] == -math.inf:
                    if g:
                        yield flush(g)
                    g = _group_of(row)
                    shape = (len(g["ids"]), len(g["slots"]), k)
                    g["best"], g["other"] = np.full(shape, -np.inf, np.float64), np.zeros(shape, np.int64)
                else:
                    ids = np.array(row["ids"], np.int64)
                    _meet(g, ids, np.array(row["labels"], np.int64), _matrix(row["data"], len(ids), row["size"]), same_label, k)
        if g:
            yield flush(g)
    return stream.mapInArrow(work, "id bigint, slot int, score bigint, other bigint")


def _meet(g: dict, ids: np.ndarray, labels: np.ndarray, c: np.ndarray, same_label: bool, k: int) -> None:
    """One block against one group: better rows take their places in ``best`` and ``other``. Ids are in order, so the first of equal scores has the smallest."""
    kind = _exact_type(g["x"], c)
    score = g["x"].astype(kind) @ c.astype(kind).T
    fits = g["labels"][:, None] == labels[None, :]
    fits = fits & (g["ids"][:, None] != ids[None, :]) if same_label else ~fits
    score[~fits] = -np.inf
    for s in range(len(g["slots"])):
        last = np.maximum(g["low"][:, s], g["best"][:, s, -1])  # an equal score may still win by its id
        rows = np.flatnonzero((score.max(1, initial=-np.inf) >= last) & (g["high"][:, s] > -np.inf))
        if not len(rows):
            continue
        x = score[rows]
        x[(x > g["high"][rows, s:s + 1]) | (x < last[rows, None])] = -np.inf
        found, who = np.full((len(rows), k), -np.inf, np.float64), np.zeros((len(rows), k), np.int64)
        line = np.arange(len(rows))
        for place in range(min(k, len(ids))):
            at = x.argmax(1)
            found[:, place], who[:, place] = x[line, at], ids[at]
            x[line, at] = -np.inf
        found, who = np.concatenate([g["best"][rows, s], found], 1), np.concatenate([g["other"][rows, s], who], 1)
        order = np.lexsort((who, -found), axis=1)[:, :k]
        g["best"][rows, s], g["other"][rows, s] = np.take_along_axis(found, order, 1), np.take_along_axis(who, order, 1)


def _search(groups: DataFrame, windows: DataFrame, blocks: DataFrame, pages: DataFrame, last_page: dict[int, int], same_label: bool, k: int, name: str) -> DataFrame:
    """(id, slot, score, other, rank): the best k rows of each window (grp, id, slot, low, high), in two rounds."""
    def with_windows(w: DataFrame) -> DataFrame:
        per = w.groupBy("grp").agg(F.collect_list(F.struct("id", "slot", "low", "high", "last")).alias("windows"))  # at most group rows times slots
        return groups.join(per, "grp").select("grp", "size", "ids", "labels", "data", "windows")
    order = Window.partitionBy("id", "slot").orderBy(F.desc("score"), "other")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = kept(with_windows(windows.withColumn("last", F.lit(None).cast("bigint"))), f"{name}-windows")
    seeds = kept(_choose(first, pages, last_page, same_label, True), f"{name}-seeds")
    near = kept(_read(seeds, first, blocks, same_label, k), f"{name}-near")
    last = ranked(near).where(F.col("rank") == k).select("id", "slot", F.col("score").alias("last"))
    second = kept(with_windows(windows.join(last, ["id", "slot"], "left")), f"{name}-narrowed")
    rest = kept(_choose(second, pages, last_page, same_label, False).join(seeds.select("grp", "block"), ["grp", "block"], "left_anti"), f"{name}-rest")
    far = _read(rest, second, blocks, same_label, k)
    return kept(ranked(near.unionByName(far)), f"{name}-found")


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = 4096, group: int = 1024) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the columns of ``vectors``. An anchor's positives are its best ``positives`` other rows of the same label; for each, the best ``negatives`` rows of other
    labels with low % of its score <= score <= high % of it are returned. Higher scores come first, ties by smaller id.

    Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; rows of one id count as one, the one with the least
    (label, vector); vectors of different lengths never meet; empty vectors score 0; labels are whole numbers; other columns are ignored; an empty table
    gives no rows. Equal vectors and hot labels are spread over blocks by id.
    """
    clean = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & clean).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), v.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    axes = _profile(rows, scale)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("row")).select("id", "row.*")

    def turned(batches):
        for batch in batches:
            sizes = _lengths(batch.column(2))
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                if size:
                    x = _whole(part.column(2), scale)
                    axis, mean, dev = axes[int(size)]
                    cells = np.floor((x[:, axis] - mean) / np.maximum(dev, 1e-300) * (2.0 ** BITS / 4) + 2.0 ** (BITS - 1)).clip(0, 2 ** BITS - 1)
                    h = hilbert_index(np.nan_to_num(cells), BITS)
                else:
                    x, h = np.zeros((len(part), 0)), np.zeros(len(part), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), size), pa.int32()), pa.array(h), part.column(0), part.column(1),
                                                  pa.array([_compact(v) for v in x], pa.binary()), part.column(3)], ["size", "h", "id", "label", "data", "anchor"])
    curve = kept(rows.select("id", "label", "v", "anchor").mapInArrow(turned, "size int, h bigint, id bigint, label bigint, data binary, anchor boolean"), "curve")
    blocks = _packed(curve, block, "blocks")
    groups = _packed(curve.where("anchor"), group, "anchors").withColumnRenamed("block", "grp")
    zone = blocks.select("size", F.struct("block", "low", "high", F.array_min("labels").alias("first_label"), F.array_max("labels").alias("last_label")).alias("zone"))
    page = F.floor(F.shiftright("zone.block", 33) / PARTS_PER_PAGE)  # the upper bits of a block's number are its packing task
    pages = kept(zone.groupBy("size", page.alias("page")).agg(F.collect_list("zone").alias("zones")), "zones")
    last_page = dict(pages.groupBy("size").agg(F.max("page")).collect())  # one number a vector length
    member = groups.select("grp", F.explode("ids").alias("id"))
    nothing = F.lit(None).cast("bigint")
    wanted = member.select("grp", "id", F.lit(0).alias("slot"), nothing.alias("low"), nothing.alias("high"))
    best = _search(groups, wanted, blocks, pages, last_page, True, positives, "positives").select("id", F.col("rank").alias("slot"), F.col("score").alias("ps"), F.col("other").alias("positive_id"))
    wide = F.col("ps").cast("decimal(30,0)")
    windows = member.join(best, "id").select("grp", "id", "slot", F.ceil(wide * low / 100).cast("bigint").alias("low"), F.floor(wide * high / 100).cast("bigint").alias("high"))
    found = _search(groups, windows.where("low <= high"), blocks, pages, last_page, False, negatives, "negatives")
    return found.join(best, ["id", "slot"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"),
                                                   F.col("ps").alias("positive_score"), F.col("score").alias("negative_score"))
