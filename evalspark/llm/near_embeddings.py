"""All pairs of vectors with cosine >= threshold, by PCA-ordered tiled comparison.

Vectors are normalised and turned into the basis of their principal components, largest variance first. Blocks of ``block``
vectors meet in tiles, one tile for each pair of blocks. A tile adds up the products of leading dimensions a few at a time; what the
remaining dimensions can still add is at most the product of both suffix norms, so that a pair whose sum plus that bound stays
below the threshold is out, and a tile without pairs left stops. The pairs that stay are decided by their cosine in double precision on the vectors as
they came. Blocks are ranges of the first component, and a tile is not made when the limits of two blocks in the leading
components keep their vectors further apart than the threshold allows.

Neighbouring blocks are written once as a row, a group, and not shuffled: tasks read two groups each (Spark's cartesian product of the written files) and
make the tiles of their blocks. Disk is in proportion to the table, whatever the number of tiles.

Equal vectors count once with their number, so copies are never paired. The tiles of a task give back per vector how many others it links with, and a
spanning forest of their links; components follow from the forests.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component, has no links, and neither has a row without id.
Vectors of different length never link. Rows that share an id and vector count once and come back as often as they came; an id on different
vectors sums their links and takes the smallest component. Other columns are ignored.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.shared import Kept, components, kept

STEPS = (8, 16, 24, 32, 48)
PIECE = 512                 # vectors a side of what is multiplied at a time
GROUP = 16 << 20            # bytes of the neighbouring blocks in a row, 8 blocks at most
HELD = 128 << 20            # bytes of blocks that a task keeps turned
FULL = 1 << 20              # rows that a task gathers before it merges them
PAIR = 40_000               # a pair taken alone costs as much as this many in one more dimension of a product
CORNERS = 6


def usable(vector: Column) -> Column:
    v = F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return sound & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _bytes(x: np.ndarray) -> bytes:
    """Half the bytes where single precision holds the numbers exactly; the length tells which."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return (small if (small == x).all() else x).tobytes()


def _rows(data, rows: int, size: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * rows * size else np.float64).reshape(rows, size)


def principal_basis(vectors: DataFrame, size: int) -> np.ndarray:
    """Orthogonal basis by falling variance; the second moments are summed in the tasks (size x size numbers each)."""
    def moments(batches):
        total = np.zeros((size, size))
        for b in batches:
            u = _unit(_matrix(b.column(0)))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])
    cells = vectors.mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    flat = np.zeros(size * size)
    for r in cells.collect():
        flat[r["i"]] = r["x"]
    _, basis = np.linalg.eigh(flat.reshape(size, size))
    return np.ascontiguousarray(basis[:, ::-1])


def _sides(df: DataFrame) -> int:
    """Parts of a table whose pairs give every core some tasks."""
    return 2 * math.isqrt(df.sparkSession.sparkContext.defaultParallelism) + 2


def _groups(nodes: DataFrame, n: int, basis: np.ndarray, size: int, block: int) -> Kept:
    """(grp, ids, counts, data, low, high) of ``n`` nodes: ranges of the first component, a few blocks of ``block`` vectors each."""
    def turned(batches):
        for b in batches:
            if len(b):
                first = (_unit(_matrix(b.column(1))) @ basis[:, 0]).tolist()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first)], ["node", "v", "copies", "c"])
    blocks = max(1, -(-n // block))
    most = max(1, min(8, GROUP // (8 * size * block), blocks // _sides(nodes))) * block
    spread = nodes.mapInArrow(turned, f"node bigint, v {nodes.schema['v'].dataType.simpleString()}, copies bigint, c double")
    ranged = spread.repartitionByRange(max(1, -(-blocks * block // most)), "c", "node").sortWithinPartitions("c", "node")

    def packed(batches):
        def row(part):
            raw = _matrix(part.column(1))
            y = _unit(raw) @ basis[:, :CORNERS]
            return pa.RecordBatch.from_arrays([
                *(pa.array([part.column(k).to_numpy().astype("<i8").tobytes()], pa.binary()) for k in (0, 2)), pa.array([_bytes(raw)], pa.binary()),
                pa.array([y.min(0).tolist()]), pa.array([y.max(0).tolist()])], ["ids", "counts", "data", "low", "high"])
        waiting = []
        for b in batches:
            waiting.append(b)
            while sum(map(len, waiting)) >= most:
                all_rows = pa.Table.from_batches(waiting)
                yield row(all_rows.slice(0, most))
                waiting = all_rows.slice(most).to_batches()
        if sum(map(len, waiting)):
            yield row(pa.Table.from_batches(waiting))
    rows = ranged.mapInArrow(packed, "ids binary, counts binary, data binary, low array<double>, high array<double>")
    return Kept(rows.select(F.monotonically_increasing_id().alias("grp"), "*"), "groups")


def _pairs(groups: DataFrame, threshold: float, size: int) -> DataFrame:
    """A row, columns ending in _a and _b, for each two groups that can hold a pair: |x - y|**2 = 2 - 2 cos bounds the gap of their limits.

    Nothing is shuffled or broadcast. Of the two orders of a pair one is taken, by parity, so that tasks of both orders have work.
    """
    n, id_bytes = groups.agg(F.count("*"), F.sum(F.octet_length("ids"))).first()
    wide = max(_sides(groups), -(-(id_bytes or 0) * size // (2 * GROUP)))  # a task reads that much on either side
    a, b = (groups.coalesce(max(1, min(n, wide))).select(*(F.col(c).alias(f"{c}_{side}") for c in groups.columns)) for side in "ab")
    gap = F.lit(0.0)
    for k in range(min(CORNERS, size)):
        apart = F.greatest(F.col("low_a")[k] - F.col("high_b")[k], F.col("low_b")[k] - F.col("high_a")[k], F.lit(0.0))
        gap = gap + apart * apart
    even = sum((F.shiftright(c, 33) + F.col(c) for c in ("grp_a", "grp_b")), F.lit(0)).bitwiseAND(F.lit(1)) == 0
    once = (F.col("grp_a") == F.col("grp_b")) | ((F.col("grp_a") < F.col("grp_b")) == even)
    return a.join(b.hint("shuffle_replicate_nl"), once & (gap <= 2 - 2 * threshold + 1e-9)).drop("low_a", "high_a", "low_b", "high_b")


def _suffix_norms(p: np.ndarray, ends: list[int]) -> list[np.ndarray]:
    """For each cut the norm of what the dimensions from there on hold."""
    left = np.cumsum((p.astype(np.float64) ** 2)[:, ::-1], 1)[:, ::-1]
    return [np.sqrt(left[:, e]).astype(np.float32) if e < p.shape[1] else np.zeros(len(p), np.float32) for e in ends]


def _first_cut(px, py, rx, ry, ends: list[int], limit: np.float32) -> int:
    """The cut that costs least: leading dimensions for all pairs, the others for the share of pairs that a sample of both blocks leaves."""
    x, y = (np.unique(np.linspace(0, len(p) - 1, 128).astype(np.int64)) for p in (px, py))
    cost = []
    for e, a, b in zip(ends, rx, ry):
        left = (px[x, :e] @ py[y, :e].T + a[x][:, None] * b[y][None, :] >= limit).mean()
        cost.append(e + min(PAIR * left, 8 * ends[-1]))  # where many are left a whole product is taken
    return int(np.argmin(cost))


class Turned:
    """Vectors of a block: of length 1 as they came, in the basis, and what each cut leaves."""

    def __init__(self, x: np.ndarray, basis: np.ndarray):
        self.unit = _unit(x)
        y = self.unit @ basis
        self.low, self.high, self.p = y[:, :CORNERS].min(0), y[:, :CORNERS].max(0), y.astype(np.float32)
        self.ends = [s for s in STEPS if s < self.p.shape[1]] + [self.p.shape[1]]
        self.left = _suffix_norms(self.p, self.ends)

    def apart(self, other: "Turned", threshold: float) -> bool:
        """True where the limits of both leave no room for a pair."""
        gap = np.maximum(np.maximum(self.low - other.high, other.low - self.high), 0.0)
        return gap @ gap > 2 - 2 * threshold + 1e-9


def _cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[i[s:s + 65536]], y[j[s:s + 65536]]) for s in range(0, len(i), 65536))])


def tile_links(x: Turned, y: Turned, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of x and y with cosine >= threshold; with ``same`` only pairs above the diagonal.

    Pieces of PIECE x PIECE stay in the processor's cache. The bound of a piece is one product: the suffix norms stand as one more dimension behind the leading
    ones. Pairs left go on dimension by dimension alone, unless a piece keeps so many that its whole product is cheaper.
    """
    ux, uy, px, py, rx, ry, ends = x.unit, y.unit, x.p, y.p, x.left, y.left, x.ends
    limit = np.float32(threshold - 1e-4)  # single precision only rules out; the decision is made in double
    cut = _first_cut(px, py, rx, ry, ends, limit)
    a, b = (np.concatenate([p[:, :ends[cut]], r[cut][:, None]], 1) for p, r in ((px, rx), (py, ry)))
    out_i, out_j, few = [], [], []
    for lo in range(0, len(px), PIECE):
        for at in range(lo if same else 0, len(py), PIECE):
            bound = a[lo:lo + PIECE] @ b[at:at + PIECE].T
            rows = np.flatnonzero(bound.max(1) >= limit)  # most rows have no pair left
            if not len(rows):
                continue
            i, j = np.divmod(np.flatnonzero(bound[rows] >= limit), bound.shape[1])
            i, j = rows[i] + lo, j + at
            if same and at == lo:
                i, j = i[i < j], j[i < j]
            if len(i) > PIECE * PIECE // 16:
                cos = (ux[lo:lo + PIECE] @ uy[at:at + PIECE].T)[i - lo, j - at]
                edge = np.flatnonzero(np.abs(cos - threshold) < 1e-12)
                cos[edge] = _cosines(ux, uy, i[edge], j[edge])
                out_i.append(i[cos >= threshold])
                out_j.append(j[cos >= threshold])
            elif len(i):
                few.append((i, j))
    left_i, left_j = (np.concatenate(k) for k in zip(*few)) if few else ((), ())
    for s in range(0, len(left_i), 65536):
        i, j = left_i[s:s + 65536], left_j[s:s + 65536]
        done = ends[cut]
        total = np.einsum("ij,ij->i", px[i, :done], py[j, :done])
        for k in range(cut + 1, len(ends) - 1):
            if not len(i):
                break
            total = total + np.einsum("ij,ij->i", px[i, done:ends[k]], py[j, done:ends[k]])
            done = ends[k]
            near = total + rx[k][i] * ry[k][j] >= limit
            i, j, total = i[near], j[near], total[near]
        hit = _cosines(ux, uy, i, j) >= threshold
        out_i.append(i[hit])
        out_j.append(j[hit])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what (a, b) connects: star steps over whole arrays until labels rest."""
    if not len(a):
        return a, b
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[:len(a)], flat[len(a):]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _merged(counts: list, links: list) -> tuple[list, list]:
    """What several tiles found, as one: a count for each vector, one forest."""
    if counts:
        ids, at = np.unique(np.concatenate([i for i, _ in counts]), return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, at, np.concatenate([n for _, n in counts]))
        counts = [(ids, total)]
    if links:
        links = [_forest(*(np.concatenate(side) for side in zip(*links)))]
    return counts, links


def _found(counts: list, links: list):
    for ids, n in counts:
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(np.zeros(len(ids), np.int64)), pa.array(np.zeros(len(ids), bool))], ["node", "n", "b", "is_link"])
    for a, b in links:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.zeros(len(a), np.int64)), pa.array(b), pa.array(np.ones(len(a), bool))], ["node", "n", "b", "is_link"])


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block: int = 4096) -> DataFrame:
    """One row per row of vectors: id, n_links, component, kept."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    good = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    # a node is a distinct vector, named by the smallest id that has it and, for ids with several vectors, told apart by its hash
    hashed = good.select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    owners = hashed.select("id", "h", "g", F.size("v").alias("s")).distinct().groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("s").alias("s"))
    nodes = kept(owners.select(F.xxhash64("h", "g").alias("node"), "id", "copies", "h", "g", "s"), "nodes")
    results, read = [], []
    for size, n in [tuple(r) for r in nodes.groupBy("s").count().orderBy("s").collect()]:
        own = hashed.where(F.size("v") == size)
        basis = principal_basis(own.select("v"), size)
        distinct = own.groupBy("h", "g").agg(F.first("v").alias("v")).join(nodes.select("h", "g", "node", "copies"), ["h", "g"])
        written = _groups(distinct.select("node", "v", "copies"), n, basis, size, block)
        read.append(written)

        def compare(batches, size=size, basis=basis):
            held, most, counts, links, waiting = {}, max(2, HELD // (12 * size * block)), [], [], 0

            def turned(key, data, lo):
                """The block of a group that begins at ``lo``; of those kept the one not used for longest goes first."""
                found = held.pop((key, lo), None) or Turned(data[lo:lo + block].astype(np.float64), basis)
                if len(held) >= most:
                    held.pop(next(iter(held)))
                held[key, lo] = found
                return found
            for batch in batches:
                for r in range(len(batch)):
                    get = lambda n: batch.column(batch.schema.get_field_index(n))[r]
                    keys = [get(f"grp_{s}").as_py() for s in "ab"]
                    ids, many = ([np.frombuffer(get(f"{f}_{s}").as_buffer(), "<i8") for s in "ab"] for f in ("ids", "counts"))
                    data = [_rows(get(f"data_{s}").as_buffer(), len(i), size) for s, i in zip("ab", ids)]
                    for lo in range(0, len(ids[0]), block):
                        for at in range(lo if keys[0] == keys[1] else 0, len(ids[1]), block):
                            x, y, same = turned(keys[0], data[0], lo), turned(keys[1], data[1], at), keys[0] == keys[1] and lo == at
                            i, j = tile_links(x, y, threshold, same) if not x.apart(y, threshold) else ((), ())
                            if not len(i):
                                continue
                            i, j = i + lo, j + at
                            for own_ids, k, n in ((ids[0], i, many[1][j]), (ids[1], j, many[0][i])):
                                total = np.bincount(k, n)
                                linked = np.flatnonzero(total)
                                counts.append((own_ids[linked], total[linked].astype(np.int64)))
                                waiting += len(linked)
                            links.append(_forest(ids[0][i], ids[1][j]))
                            waiting += len(links[-1][0])
                            if waiting > FULL:
                                counts, links = _merged(counts, links)
                                waiting = len(counts[0][0]) + len(links[0][0])
                                if waiting > FULL // 2:
                                    yield from _found(counts, links)
                                    counts, links, waiting = [], [], 0
            yield from _found(*_merged(counts, links))
        results.append(_pairs(written.df, threshold, size).mapInArrow(compare, "node bigint, n bigint, b bigint, is_link boolean"))
    known = rows.where("id IS NOT NULL").select("id", F.xxhash64(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).alias("node"), usable(F.col("v")).alias("ok"))
    if results:
        found = results[0]
        for more in results[1:]:
            found = found.unionAll(more)
        found = kept(found, "found")
        for table in read:
            table.drop()
        groups = components(found.where("is_link").select(F.col("node").alias("a"), "b"))
        counts = found.where("NOT is_link").groupBy("node").agg(F.sum("n").alias("n"))
        per_node = nodes.select("node", "id", "copies").join(counts, "node", "left").join(groups, "node", "left").select(
            "node", "id", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("grp"))
        per_node = kept(per_node, "per-node")
        first = per_node.groupBy("grp").agg(F.min("id").alias("component"))
        labelled = kept(per_node.join(first, "grp").select("node", "n_links", "component"), "labelled")
    else:
        labelled = nodes.select("node", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    per_id = known.where("ok").distinct().join(labelled, "node").groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component").alias("component"))
    out = rows.select("id").join(per_id, "id", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component", "id").alias("component")) \
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
