"""Exact distributions of resampled sums on a lattice (T-02, T-04, T-05, T-09).

A bootstrap mean of outcomes such as -1, 0, 1 and a sum with random signs take values on a lattice, and their distributions need no draws: the
characteristic function of a sum is the product of those of its terms, which depends on the distinct values and their counts only. A probability is then a
sum over N frequencies. N is chosen so that the mass beyond the window of N lattice points is below 2 * exp(-REACH**2 / 2) (Hoeffding's inequality), so the result
holds to about 1e-15 whatever the number of rows; frequencies whose factor is below exp(-FAINT) are left out, and once a partial product is that small
the rest of it is not computed. For random signs, blocks of frequencies, wide ones first, are left out together where a bound on the factors inside is that
small: the window grows with the rows, the frequencies that count hardly do.

Spark reduces rows to distinct values with counts on the map side; the frequencies of a group are spread over tasks and their parts summed. A
group's distinct values are held by one task and must be at most ``max_cells``: a lattice bounds them by its span, not by the rows. For random signs
``signs_in_chunks`` takes the groups with more: chunks of values give their part of each factor that counts.
"""
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.ranges import attach
from evalspark.session import cut_lineage, shuffle_width

REACH = 8.6                 # half a window in Hoeffding deviations: 1.7e-16 outside
FAINT = 60.0
MAX_CELLS = 1 << 17         # distinct values of a group
MAX_FREQUENCIES = 1 << 60
AT_ONCE = 1 << 14           # frequencies a task works on at a time
PIECE = 1 << 20             # frequencies of the smallest part worth a task of its own
BINS = 1 << 12              # of sizes, to find the tilt of a group in chunks
SOME = 1 << 16              # sizes of such a group, or one a chunk, by which frequencies are left out


def lattice_position(value: Column, step: float) -> Column:
    """The value in lattice steps; a value off the lattice stops the job."""
    at = value.cast("double") / F.lit(float(step))
    return F.when(F.abs(at - F.round(at)) <= 1e-6, F.round(at).cast("bigint")).when(at.isNotNull(), F.raise_error(F.concat(F.lit("not on the lattice: "), value.cast("string"))).cast("bigint"))


def cells(counted: DataFrame, by: list[str], max_cells: int = MAX_CELLS) -> DataFrame:
    """(by, cells, n) of counted values (by, a, c): one row a group. A group with more distinct values than ``max_cells`` gets null cells."""
    sizes = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("_d"), F.sum("c").alias("n"))
    fits = attach(counted, sizes, by).where(F.col("_d") <= max_cells)
    held = fits.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("a", "c"))).alias("cells"))
    held = held.withColumn("cells", F.when(F.size("cells") > 0, F.col("cells")))  # without groups an aggregate of no rows is one row
    return attach(sizes, held, by).select(*by, "cells", "n")


def _fields(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in by)


def _pieces(total: int, pieces: int) -> int:
    return max(1, min(pieces, -(-total // PIECE)))


# ---------------------------------------------------------------- bootstrap means
class MeanDistribution:
    """The sum of n draws with replacement from values ``a`` (whole lattice steps) with counts ``c``, n the sum of ``c``."""

    def __init__(self, a: np.ndarray, c: np.ndarray):
        self.n, self.centre = int(c.sum()), int(sum(int(x) * int(y) for x, y in zip(a, c)))  # n times the mean: the centre of the sum
        width = int(a.max() - a.min())
        window = min(REACH * math.sqrt(self.n) * width, 2.0 * self.n * width) + 2
        self.size = max(8, 2 * math.ceil(window / 2))
        share, apart = c / self.n, a - self.centre / self.n
        keep_k, keep_f = [], []
        for lo in range(0, self.size // 2 + 1, AT_ONCE):
            k = np.arange(lo, min(lo + AT_ONCE, self.size // 2 + 1))
            t = 2 * np.pi * k / self.size
            re, im = np.zeros(len(k)), np.zeros(len(k))
            for s in range(0, len(a), 64):
                x = t[:, None] * apart[None, s:s + 64]
                re -= 2 * (np.sin(x / 2) ** 2) @ share[s:s + 64]
                im += np.sin(x) @ share[s:s + 64]
            # log of |1 + re + i im| without the loss of digits near 1
            size = 0.5 * self.n * np.log1p(np.maximum(2 * re + re * re + im * im, -1 + 1e-16))
            near = size > -FAINT
            keep_k.append(k[near])
            keep_f.append(np.exp(size[near]) * np.exp(1j * self.n * np.arctan2(im[near], 1 + re[near])))
        self.k, self.f = np.concatenate(keep_k), np.concatenate(keep_f)
        self.weight = np.where((self.k == 0) | (2 * self.k == self.size), 1.0, 2.0)  # the other half are conjugates

    def below(self, y: int) -> float:
        """P(sum <= centre + y); the window begins half its size below the centre."""
        count = y + self.size // 2
        if count < 1:
            return 0.0
        if count >= self.size:
            return 1.0
        t = 2 * np.pi * self.k / self.size
        half = np.where(self.k == 0, 1.0, np.sin(t / 2))
        run = np.where(self.k == 0, count, np.sin(count * t / 2) / half) * np.exp(-1j * t * ((y - self.size // 2 + 1) / 2))  # sum of exp(-i t s) over the window up to y
        return float((self.weight * (self.f * run).real).sum() / self.size)

    def quantile(self, p: float) -> int:
        """Smallest lattice point of the sum with probability of at least p up to it."""
        low, high = -self.size // 2, self.size // 2
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.below(mid) >= p - 1e-13 else (mid + 1, high)
        return self.centre + low


def bootstrap_interval(df: DataFrame, value: str, step: float = 1.0, by: list[str] | None = None, confidence: float = 0.95, max_cells: int = MAX_CELLS) -> DataFrame:
    """(by, n, observed, ci_low, ci_high): percentile interval of the bootstrap mean, as infinitely many draws would give it (T-02).

    Limits are the smallest means with a probability of at least (1 -+ confidence) / 2 up to them. Null values are left out; a group without values is not
    returned; one with more than ``max_cells`` distinct values has null limits (``resample.paired_bootstrap`` draws for it).
    """
    return interval_of_counts(cut_lineage(value_counts(df, value, step, by)), step, by, confidence, max_cells)


def value_counts(df: DataFrame, value: str, step: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """(by, a, c): how often each lattice point occurs; all that the distributions need. Null values are left out."""
    at = df.where(F.col(value).isNotNull()).select(*(by or []), lattice_position(F.col(value), step).alias("a"))
    return at.groupBy(*(by or []), "a").agg(F.count(F.lit(1)).alias("c"))


def interval_of_counts(counted: DataFrame, step: float = 1.0, by: list[str] | None = None, confidence: float = 0.95, max_cells: int = MAX_CELLS) -> DataFrame:
    """``bootstrap_interval`` of values that are counted already, for example over exclusion masks."""
    by = by or []
    rows = cells(counted, by, max_cells)
    limits = ((1 - confidence) / 2, (1 + confidence) / 2)

    def run(batches):
        for pdf in batches:
            out = []
            for held in pdf["cells"]:
                if held is None:
                    out.append((None, None))
                    continue
                a, c = (np.array([x[f] for x in held], dtype=np.int64) for f in "ac")
                dist = MeanDistribution(a, c)
                out.append(tuple(dist.quantile(p) / dist.n * step for p in limits))
            yield pdf[[*by, "n"]].assign(ci_low=[x[0] for x in out], ci_high=[x[1] for x in out]).astype({"ci_low": "float64", "ci_high": "float64"})
    found = rows.repartition(*by).mapInPandas(run, _fields(rows, by) + "n bigint, ci_low double, ci_high double") if by else \
        rows.where("n IS NOT NULL").mapInPandas(run, "n bigint, ci_low double, ci_high double")
    means = counted.groupBy(*by).agg((F.sum(F.col("a") * F.col("c")) * F.lit(float(step)) / F.sum("c")).alias("observed"))
    return attach(found, means, by).select(*by, "n", "observed", "ci_low", "ci_high")


# ---------------------------------------------------------------- random signs
def _times(k: np.ndarray, m: np.ndarray, size: int) -> np.ndarray:
    """k * m modulo size, of integers below size."""
    if size < 1 << 31:
        return k * m % size
    if size < 1 << 50:  # the quotient in double precision is off by one at most, and the rest is right modulo 2**64
        return (k * m - (k.astype(np.float64) * m / size).astype(np.int64) * size) % size
    return (k.astype(object) * m % size).astype(np.int64)


def _spectrum(k: np.ndarray, size: np.ndarray, turn: np.ndarray, period: int, at: int, tilt: float) -> np.ndarray:
    """What frequencies add to the tail from ``at`` on: logarithm and argument of the factor times the sum of exp(-(tilt + i t) m) over half a window."""
    t = 2 * np.pi * k / period
    turn = turn - 2 * np.pi * _times(k, np.full(1, at % period), period) / period
    half = period // 2
    with np.errstate(invalid="ignore", divide="ignore"):
        last = 2 * np.pi * _times(k, np.full(1, half), period) / period
        run = np.where((k == 0) & (tilt == 0), half, np.expm1(-tilt * half - 1j * last) / np.expm1(-tilt - 1j * t))
    weight = np.where((k == 0) | (2 * k == period), 1.0, 2.0)
    return weight * np.exp(size) * (np.exp(1j * turn) * run).real


def _factors(k: np.ndarray, step: np.ndarray, chance: np.ndarray, many: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm and argument that some sizes give to the factor of a frequency."""
    angle = (2 * np.pi / period) * _times(k[:, None], step[None, :], period)
    # |1 - q + q e^(i v)|^2 = 1 - 4 q (1 - q) sin^2(v / 2)
    size = 0.5 * np.log1p(np.maximum(-4 * chance * (1 - chance) * np.sin(angle / 2) ** 2, -1 + 1e-16)) @ many
    return size, np.mod(np.arctan2(chance * np.sin(angle), 1 - chance + chance * np.cos(angle)) * many, 2 * np.pi).sum(1)


class SignedSum:
    """Upper tail of a sum of sizes ``a`` > 0 (``c`` of each) with fair random signs, from ``x`` on; x > 0 is itself such a sum.

    Taken as the sum u of the sizes with a plus. The signs are tilted so that u has its mean at the wanted point: a small tail then keeps its digits.
    """

    def __init__(self, a: np.ndarray, c: np.ndarray, x: int):
        self.a, self.c = a.astype(np.int64), c.astype(np.float64)
        total = sum(int(s) * int(n) for s, n in zip(a, c))
        self.unit = int(np.gcd.reduce(self.a)) if len(a) else 1
        self.at, self.whole = (x + total) // 2, total
        spread = math.sqrt(sum(int(s) ** 2 * int(n) for s, n in zip(a, c)))
        self.size = max(8, 2 * math.ceil(min(REACH * spread / self.unit + 2, 2.0 * total / self.unit + 2) / 2))
        self.only_end = self.at >= total  # every sign alike
        if not self.only_end:
            self.tilt = self._tilted()
            power = self.tilt * self.a
            self.chance = 1 / (1 + np.exp(-np.minimum(power, 700)))
            self.log_scale = float((self.c * (np.logaddexp(0, power) - math.log(2))).sum()) - self.tilt * self.at

    def _mean(self, tilt: float) -> float:
        return float((self.c * self.a / (1 + np.exp(-np.minimum(tilt / self.unit * self.a, 700)))).sum())

    def _tilted(self) -> float:
        low, high = 0.0, 1.0
        while self._mean(high) < self.at and high < 1e6:
            high *= 2
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if self._mean(mid) < self.at else (low, mid)
        return low / self.unit

    def frequencies(self) -> int:
        return self.size // 2 + 1

    def _audible(self, first: int, end: int, step: np.ndarray, chance: np.ndarray, many: np.ndarray):
        """Frequencies first <= k < end, AT_ONCE at most at a time, without blocks all of whose factors are below exp(-FAINT).

        Inside a block the angle of a size lies within the angle at its middle and half its width; the nearest point to a whole turn bounds the factor. Sizes that
        turn too far inside a block say nothing about it; blocks that remain are cut into eight, and the last ones are computed frequency by frequency.
        """
        width = AT_ONCE  # as wide as the smallest size can judge
        while np.pi / 2 * int(step.min()) / self.size * width * 8 <= 0.6:
            width *= 8

        def inside(lows, width):
            if width == 32:
                for s in range(0, len(lows), AT_ONCE // width):
                    k = (lows[s:s + AT_ONCE // width, None] + np.arange(width, dtype=np.int64)).ravel()
                    yield k[k < end]
                return
            near = np.flatnonzero(np.pi / 2 * step / self.size * width <= 0.6)
            lows = lows[self._bounds(lows + width // 2, width / 2, step[near], chance[near], many[near]) > -FAINT] if len(near) else lows
            width //= 8
            lows = (lows[:, None] + width * np.arange(8, dtype=np.int64)).ravel()
            lows = lows[lows < end]
            for s in range(0, len(lows), 1 << 13):
                yield from inside(lows[s:s + (1 << 13)], width)
        for start in range(first, end, width << 10):
            yield from inside(np.arange(start, min(start + (width << 10), end), width, dtype=np.int64), width)

    def _bounds(self, middle: np.ndarray, reach: float, step: np.ndarray, chance: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Upper bounds on the logarithm of the factor's modulus for all frequencies within ``reach`` of the middles; not finished where it is faint already."""
        out = np.zeros(len(middle))
        for lo in range(0, len(middle), AT_ONCE):
            at = np.arange(lo, min(lo + AT_ONCE, len(middle)))
            for s in range(0, len(step), 32):
                half = (np.pi / self.size) * _times(middle[at, None], step[None, s:s + 32], self.size)
                off = np.maximum(np.minimum(half, np.pi - half) - (np.pi / self.size) * reach * step[None, s:s + 32], 0.0)
                q = chance[s:s + 32]
                out[at] += 0.5 * np.log1p(np.maximum(-4 * q * (1 - q) * np.sin(off) ** 2, -1 + 1e-16)) @ many[s:s + 32]
                at = at[out[at] > -FAINT]
                if not len(at):
                    break
        return out

    def part(self, first: int, end: int) -> float:
        """The sum over frequencies first <= k < end; all parts together times exp(log_scale) are the tail."""
        order = np.random.default_rng(0).permutation(len(self.a))  # mixed sizes make a product faint early
        step = (self.a // self.unit % self.size)[order]
        chance, many = self.chance[order], self.c[order]
        out = 0.0
        for k in self._audible(first, end, step, chance, many):
            size, turn = np.zeros(len(k)), np.zeros(len(k))
            for s in range(0, len(step), 32):
                more = _factors(k, step[s:s + 32], chance[s:s + 32], many[s:s + 32], self.size)
                size, turn = size + more[0], turn + more[1]
                near = size > -FAINT
                if not near.all():
                    k, size, turn = k[near], size[near], turn[near]
                if not len(k):
                    break
            if len(k):
                out += float(_spectrum(k, size, turn, self.size, self.at // self.unit, self.tilt * self.unit).sum())
        return out / self.size

    def tail(self) -> float:
        return 2.0 ** -float(self.c.sum()) if self.only_end else math.exp(self.log_scale) * self.part(0, self.frequencies())


def two_sided_signs(sizes: DataFrame, observed: DataFrame, by: list[str], max_cells: int = MAX_CELLS, max_frequencies: int = MAX_FREQUENCIES) -> DataFrame:
    """(by, sign_p, log10_p): P(|sum| >= |x|) of sizes (by, a, c) with random signs, x from ``observed`` (by, x).

    Null where a group has more cells or needs more frequencies than allowed. A group without sizes has p = 1.
    """
    held = attach(observed.select(*by, F.abs("x").alias("x")), cells(sizes, by, max_cells), by)
    pieces = 4 * shuffle_width(sizes.sparkSession)

    def spread(batches):
        for batch in batches:
            keys, held_cells, sums, counts = [batch.column(c) for c in by], batch.column("cells"), batch.column("x").to_pylist(), batch.column("n").to_pylist()
            for i, (x, n) in enumerate(zip(sums, counts)):
                def row(known=None, first=0, end=0, a=None, c=None):
                    rest = (pa.array([v], t) for v, t in ((x, pa.int64()), (a, pa.binary()), (c, pa.binary()), (first, pa.int64()), (end, pa.int64()), (known, pa.float64())))
                    return pa.RecordBatch.from_arrays([*(k.slice(i, 1) for k in keys), *rest], [*by, "x", "a", "c", "first", "end", "known"])
                if not held_cells[i].is_valid or x == 0:
                    yield row(None if not held_cells[i].is_valid and n is not None else 0.0)
                    continue
                a, c = (held_cells[i].values.field(f).to_numpy(zero_copy_only=False) for f in "ac")
                s = SignedSum(a, c, int(x))
                if s.only_end:
                    yield row((1 - s.c.sum()) * math.log10(2))
                elif s.frequencies() > max_frequencies:
                    yield row()
                else:
                    m = _pieces(s.frequencies(), pieces)
                    cuts = [s.frequencies() * j // m for j in range(m + 1)]
                    for lo, hi in zip(cuts, cuts[1:]):  # a piece at a time; two plain arrays instead of a list of pairs
                        yield row(None, lo, hi, a.astype("<i8").tobytes(), c.astype("<i8").tobytes())

    def add(batches):
        for batch in batches:
            parts, scales = [], []
            for i in range(batch.num_rows):
                a, c, x, lo, hi = (batch.column(f)[i] for f in ("a", "c", "x", "first", "end"))
                s = SignedSum(*(np.frombuffer(v.as_buffer(), "<i8") for v in (a, c)), x.as_py()) if a.is_valid else None
                parts.append(s.part(lo.as_py(), hi.as_py()) if s else None)
                scales.append(s.log_scale if s else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in [*by, "known"]), pa.array(parts, pa.float64()), pa.array(scales, pa.float64())], [*by, "known", "part", "scale"])
    fields = _fields(observed, by)
    pieces_of = held.select(*by, "x", "cells", "n").mapInArrow(spread, fields + "x bigint, a binary, c binary, first bigint, end bigint, known double")
    # The number is given, so that small rows with much work are not put together in few tasks.
    parts = pieces_of.repartition(pieces, *by, "first").mapInArrow(add, fields + "known double, part double, scale double")
    for c in ("known", "part", "scale"):
        parts = parts.withColumn(c, F.nanvl(c, F.lit(None).cast("double")))
    return _two_sided(parts, by)


def _two_sided(parts: DataFrame, by: list[str]) -> DataFrame:
    total = parts.groupBy(*by).agg(F.max("known").alias("known"), F.sum("part").alias("part"), F.max("scale").alias("scale"))
    # Twice the tail in logarithms, so that a p below the smallest double still has one.
    log10 = F.coalesce("known", (F.log("part") + F.col("scale") + F.log(F.lit(2.0))) / F.log(F.lit(10.0)))
    return total.withColumn("log10_p", F.when(log10 > 0, 0.0).otherwise(log10)).select(*by, F.pow(F.lit(10.0), F.col("log10_p")).alias("sign_p"), "log10_p")


class TiltedSum(SignedSum):
    """A ``SignedSum`` known by its total, its spread and by bins (``a`` their mean size, ``c`` their count), which are enough for tilt and window."""

    def __init__(self, a: np.ndarray, c: np.ndarray, total: int, spread: float, x: int):
        self.a, self.c, self.unit, self.at = a, c, 1, (x + total) // 2
        self.size = max(8, 2 * math.ceil(min((REACH + 0.4) * spread + 2, 2.0 * total + 2) / 2))  # the bins' tilt is off by far less than 0.4 deviations
        self.tilt = self._tilted()


def _chances(a: np.ndarray, tilt: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.minimum(tilt * a, 700)))


def signs_in_chunks(sizes: DataFrame, observed: DataFrame, by: list[str], max_cells: int = MAX_CELLS) -> DataFrame:
    """(by, sign_p, log10_p) as ``two_sided_signs`` gives them, for the groups with more than ``max_cells`` sizes.

    Bins of the sizes give tilt and window, SOME of the sizes (those that occur most) leave frequencies out: every factor is 1 at most, so some of them bound the
    product. For the few frequencies left every chunk of ``max_cells`` sizes adds its logarithms, so no task holds a group.
    """
    a = F.col("a").cast("double")
    known = sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("_d"), F.sum("c").alias("n"), F.sum(F.col("a") * F.col("c")).alias("total"), F.sqrt(F.sum(a * a * F.col("c"))).alias("spread"),
                                   F.max("a").alias("top")).where(F.col("_d") > max_cells).withColumn("chunks", F.ceil(F.col("_d") / max_cells).cast("int"))
    many = attach(sizes, known.select(*by, "top", "chunks"), by).where("chunks IS NOT NULL")
    binned = many.groupBy(*by, F.floor(a / F.col("top") * BINS).alias("_bin")).agg(F.sum("c").alias("c"), F.sum(a * F.col("c")).alias("ac"))
    bins = binned.groupBy(*by).agg(F.collect_list(F.struct("c", "ac")).alias("bins"))
    held = many.groupBy(*by, "chunks", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int").alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("c")).alias("fewer"), F.xxhash64("a").alias("h"), "a", "c"))).alias("cells"))
    some = held.groupBy(*by).agg(F.flatten(F.collect_list(F.slice("cells", F.lit(1), F.ceil(F.lit(SOME) / F.col("chunks")).cast("int")))).alias("some"))
    groups = attach(attach(attach(observed.select(*by, F.abs("x").alias("x")), known, by), bins, by), some, by).where("chunks IS NOT NULL")
    pieces, fields = 4 * shuffle_width(sizes.sparkSession), _fields(observed, by)
    plain = "x bigint, total bigint, chunks int, period bigint, tilt double"

    def batch_of(keys, names, *columns):
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(v, t) for v, t in columns)], [*by, *names])

    def spread_pieces(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda f: batch.column(batch.schema.get_field_index(f))[i]
                x, total, n = (get(f).as_py() for f in ("x", "total", "n"))
                keys, names = [batch.column(f).slice(i, 1) for f in by], ["x", "total", "chunks", "period", "tilt", "a", "c", "first", "end", "known"]

                def row(known=None, period=0, tilt=0.0, a=None, c=None, first=0, end=0):
                    return batch_of(keys, names, *(([v], t) for v, t in ((x, pa.int64()), (total, pa.int64()), (get("chunks").as_py(), pa.int32()), (period, pa.int64()), (tilt, pa.float64()),
                                                                        (a, pa.binary()), (c, pa.binary()), (first, pa.int64()), (end, pa.int64()), (known, pa.float64()))))
                if x == 0 or x >= total:
                    yield row(0.0 if x == 0 else (1 - n) * math.log10(2))
                    continue
                c, ac = (get("bins").values.field(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in ("c", "ac"))
                s = TiltedSum(ac / c, c, total, get("spread").as_py(), x)
                a, c = (get("some").values.field(f).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for f in "ac")
                m = _pieces(s.frequencies(), pieces)
                cuts = [s.frequencies() * j // m for j in range(m + 1)]
                for lo, hi in zip(cuts, cuts[1:]):
                    yield row(None, s.size, s.tilt, a, c, lo, hi)

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda f: batch.column(batch.schema.get_field_index(f))[i]
                keep = [batch.column(f).slice(i, 1) for f in [*by, "x", "total", "chunks", "period", "tilt", "known"]]
                names = [*by, "x", "total", "chunks", "period", "tilt", "known", "k"]
                if not get("a").is_valid:
                    yield pa.RecordBatch.from_arrays([*keep, pa.array([None], pa.binary())], names)
                    continue
                s = SignedSum.__new__(SignedSum)
                s.size = get("period").as_py()
                step, many = (np.frombuffer(get(f).as_buffer(), "<i8") for f in "ac")
                chance = _chances(step, get("tilt").as_py())
                for k in s._audible(get("first").as_py(), get("end").as_py(), step % s.size, chance, many.astype(np.float64)):
                    left = np.zeros(len(k))
                    for lo in range(0, len(step), 32):
                        left = left + _factors(k, step[lo:lo + 32] % s.size, chance[lo:lo + 32], many[lo:lo + 32].astype(np.float64), s.size)[0]
                        k, left = k[left > -FAINT], left[left > -FAINT]
                        if not len(k):
                            break
                    for lo in range(0, len(k), 1 << 12):
                        yield pa.RecordBatch.from_arrays([*keep, pa.array([k[lo:lo + (1 << 12)].astype("<i8").tobytes()], pa.binary())], names)

    def factors(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda f: batch.column(batch.schema.get_field_index(f))[i]
                period, tilt, x = (get(f).as_py() for f in ("period", "tilt", "x"))
                a, c = (get("cells").values.field(f).to_numpy(zero_copy_only=False) for f in "ac")
                k, step, chance, many = np.frombuffer(get("k").as_buffer(), "<i8"), a % period, _chances(a, tilt), c.astype(np.float64)
                size, turn = np.zeros(len(k)), np.zeros(len(k))
                for lo in range(0, len(step), 32):
                    more = _factors(k, step[lo:lo + 32], chance[lo:lo + 32], many[lo:lo + 32], period)
                    size, turn = size + more[0], np.mod(turn + more[1], 2 * np.pi)
                if k[0] == 0:  # a row for what the tilt weighs: the logarithm of cosh(tilt a / 2)
                    y = tilt * a / 2
                    weight = np.where(y < 1, np.log1p(2 * np.sinh(np.minimum(y, 1) / 2) ** 2), y + np.log1p(np.exp(-2 * y)) - math.log(2)) @ many
                    k, size, turn = np.append(k, -1), np.append(size, weight), np.append(turn, 0.0)
                keep = [batch.column(f).take(pa.array([i] * len(k))) for f in [*by, "x", "total", "period", "tilt"]]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(k), pa.array(size), pa.array(turn)], [*by, "x", "total", "period", "tilt", "k", "size", "turn"])

    def add(batches):
        for batch in batches:
            get = lambda f: batch.column(batch.schema.get_field_index(f)).to_numpy(zero_copy_only=False)
            k, size, turn, x, total, period, tilt = (get(f) for f in ("k", "size", "turn", "x", "total", "period", "tilt"))
            part, scale = np.full(len(k), np.nan), np.where(k < 0, size - tilt * x / 2, np.nan)
            for key in set(zip(x[k >= 0].tolist(), total[k >= 0].tolist(), period[k >= 0].tolist(), tilt[k >= 0].tolist())):
                own = np.flatnonzero((k >= 0) & (x == key[0]) & (total == key[1]) & (period == key[2]) & (tilt == key[3]))
                part[own] = _spectrum(k[own], size[own], turn[own], key[2], (key[0] + key[1]) // 2, key[3]) / key[2]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f)) for f in by), pa.array(part), pa.array(scale)], [*by, "part", "scale"])
    # The number is given, so that small rows with much work are not put together in few tasks.
    planned = groups.select(*by, "x", "total", "chunks", "n", "spread", "bins", "some").mapInArrow(spread_pieces, f"{fields}{plain}, a binary, c binary, first bigint, end bigint, known double")
    found = planned.repartition(pieces, *by, "first").mapInArrow(search, f"{fields}{plain}, known double, k binary")
    asked = found.where("k IS NOT NULL").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    parts = attach(held.drop("chunks"), asked, [*by, "_chunk"]).where("k IS NOT NULL").select(*by, "x", "total", "period", "tilt", "k", "cells") \
        .mapInArrow(factors, f"{fields}x bigint, total bigint, period bigint, tilt double, k bigint, size double, turn double")
    whole = parts.groupBy(*by, "x", "total", "period", "tilt", "k").agg(F.sum("size").alias("size"), F.sum("turn").alias("turn"))
    sums = whole.mapInArrow(add, f"{fields}part double, scale double").select(*by, *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("part", "scale")), F.lit(None).cast("double").alias("known"))
    sums = sums.unionAll(found.where("known IS NOT NULL").select(*by, F.lit(None).cast("double").alias("part"), F.lit(None).cast("double").alias("scale"), "known"))
    return _two_sided(sums, by)


def sign_flip_exact(df: DataFrame, value: str, step: float = 1.0, by: list[str] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """(by, n, observed_sum, observed, sign_flip_p, log10_p): the randomisation p that all sign assignments give (T-04)."""
    return signs_of_counts(cut_lineage(value_counts(df, value, step, by)), step, by, max_cells)


def signs_of_counts(counted: DataFrame, step: float = 1.0, by: list[str] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """``sign_flip_exact`` of values that are counted already."""
    by = by or []
    sums = counted.groupBy(*by).agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.col("a") * F.col("c")), F.lit(0)).alias("x"))
    sizes = counted.where("a <> 0").groupBy(*by, F.abs("a").alias("a")).agg(F.sum("c").alias("c"))
    p = two_sided_signs(sizes, sums, by, max_cells)
    return attach(sums, p, by).select(*by, "n", (F.col("x") * F.lit(float(step))).alias("observed_sum"), (F.col("x") * F.lit(float(step)) / F.col("n")).alias("observed"),
                                      F.col("sign_p").alias("sign_flip_p"), "log10_p")


def gap_difference_exact(wide: DataFrame, value: str = "gap_difference", step: float = 1.0, by: list[str] | None = None, confidence: float = 0.95) -> DataFrame:
    """Interval and randomisation p of the cross-model gap difference, both exact (T-05, A-24, C-16)."""
    return gap_difference_of_counts(cut_lineage(value_counts(wide, value, step, by)), step, by, confidence)


def gap_difference_of_counts(counted: DataFrame, step: float = 1.0, by: list[str] | None = None, confidence: float = 0.95) -> DataFrame:
    interval = interval_of_counts(counted, step, by, confidence).drop("n", "observed")
    return attach(signs_of_counts(counted, step, by), interval, by or [])
