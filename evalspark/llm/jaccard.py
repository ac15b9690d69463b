"""Set-similarity join on word shingles by PartEnum signatures, and the groups of documents that it links.

A document's set holds the distinct shingles of ``k`` words. Sizes are cut into bands. In a band two sets of Jaccard similarity t
or more differ in at most d features, so the feature domain is cut into more than d / 2 parts, one of which differs in at most
one feature; each part is cut again into ``SECOND`` pieces, and one signature is made for each choice of all pieces but one. Two such sets
share a signature. A set near the upper end of its band also signs for the next one. Signatures over no feature at all are left out of
a set that has spare parts enough to do without, and kept otherwise; either way no link is lost.

Equal sets count once (their node is a 64-bit digest of the set). The few nodes of a short run of equal signatures (up to ``RUN``) are
paired and screened by parity bitmaps: two bitmaps differ in at most as many bits as their sets in features, so a pair that differs in more
than the similarity allows is none. Of a longer run only neighbours in sorted order are screened at first. What these pairs connect is a
group already, and a run inside one group needs no more. The others are compared run by run in blocks of bounded size, bitmaps block against
block, nodes of the run's main group with the rest only; a task gives back a spanning forest of the pairs left. Where that would cost more, a run is
cut by pairs of signatures first, as a pair not yet found shares several long runs. For the same reason a node stays out of its longest runs, all but
one of as many as a pair shares. No run is closed transitively before it is screened.
The components of all screened pairs are candidate groups. They are cut into blocks in the same way, and pairs of blocks are compared
exactly on the texts: intersections of all their sets come from one product of incidence matrices, again with a spanning forest of the links
as result. A last pass of components gives the linked groups.

Defined results: words are runs of bytes other than ASCII blanks after lower-casing A-Z; a text of fewer than ``k`` words is one shingle; a
null, empty or blank text has an empty set and is linked with nothing. Rows without an id are returned with their set size and no component
and link nothing. Repeated rows come back as often as they came; rows that share an id stand each for its own set.
"""
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm import textcodes as T
from evalspark.llm.shared import components, kept

SECOND = 3
BLOCK, BLOCK_SETS = 150_000, 512
RARE, RUN, TAGS = 12, 16, 64
#: Bytes of content that a task turns into sets at a time.
PIECE = 1 << 20
#: Rows of candidates up to which they go to the texts by broadcast (some 80 bytes each); beyond, both sides are shuffled.
SENT = 600_000


class Bands:
    """Size bands and the number of first-level parts of each, for similarity >= num / den."""

    def __init__(self, num: int, den: int, largest: int, ratio: float = 1.6):
        ratio = max(ratio, den / num)
        self.num, self.den = num, den
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, int(low[-1] * ratio)))
        self.low = np.array(low, np.int64)
        high = self.low[1:] - 1
        # |a ^ b| <= (1 - t) / (1 + t) * (|a| + |b|), and |a| + |b| is at most twice the band's largest size
        self.differ = (den - num) * 2 * high // (den + num)
        need = self.differ // 2 + 1
        self.spare = 1 + need // 10
        #: Similar sets share at least so many signatures of a band.
        self.common = self.spare + 1 - self.spare // 2
        self.parts = np.where(self.differ > 0, need + self.spare, 0)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1

    def signs_next(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether a set of this size can be similar to a set in the next band."""
        return size * self.den >= self.low[np.minimum(band + 1, len(self.low) - 1)] * self.num


def signatures(features: np.ndarray, rows: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all sets given as sorted features with row offsets."""
    size = np.diff(rows)
    out_sig, out_row = [], []
    band = bands.of(np.maximum(size, 1))
    for step in (0, 1):
        tag = band + step
        chosen = np.flatnonzero((size > 0) & (tag < len(bands.parts)) & (bands.signs_next(size, band) if step else True))
        chosen = chosen[bands.parts[tag[chosen]] > 0]
        if not len(chosen):
            continue
        parts, spare = bands.parts[tag[chosen]], bands.spare[tag[chosen]]
        n = size[chosen]
        owner = np.repeat(np.arange(len(chosen)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(rows[chosen], n)
        seed = T.mix(tag[chosen].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
        x = T.mix(features[at] ^ seed[owner])
        base = np.cumsum(parts * SECOND) - parts * SECOND
        slot = base[owner] + ((x >> np.uint64(8)) % (parts * SECOND).astype(np.uint64)[owner]).astype(np.int64)
        total, filled = np.zeros(int((parts * SECOND).sum()), np.uint64), np.zeros(int((parts * SECOND).sum()), np.int32)
        np.add.at(total, slot, T.mix(x))
        np.add.at(filled, slot, 1)
        total, filled = total.reshape(-1, SECOND), filled.reshape(-1, SECOND)
        whose = np.repeat(np.arange(len(chosen)), parts)
        part = np.arange(len(whose)) - np.repeat(np.cumsum(parts) - parts, parts)
        subsets = list(combinations(range(SECOND), SECOND - 1))
        empty = np.stack([filled[:, c].sum(1) == 0 for c in subsets])
        weak = np.bincount(whose[empty.any(0)], minlength=len(chosen))
        sure = weak <= spare // 2
        for c, none in zip(subsets, empty):
            use = ~none | ~sure[whose]
            w = whose[use]
            mark = (tag[chosen][w].astype(np.uint64) << np.uint64(40)) + (part[use].astype(np.uint64) << np.uint64(8)) + np.uint64(c[0] * 16 + c[1])
            sums = total[use]
            whole = T.mix(T.mix(mark) + sums[:, c[0]] + np.uint64(3) * sums[:, c[1]])
            out_sig.append(whole & ~np.uint64(TAGS - 1) | tag[chosen][w].astype(np.uint64))  # the band stays readable
            out_row.append(chosen[w])
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_row)


def _sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, row offsets and the digest of each row's set."""
    h, _, _, rows = T.words(*T.utf8(text))
    features, offs = T.shingle_sets(h, rows, k)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(features ^ np.uint64(0x51ED27)))])
    digest = T.mix(sums[offs[1:]] - sums[offs[:-1]] + np.diff(offs).astype(np.uint64))
    return features, offs, digest.view(np.int64)


def _pieces(batch: pa.RecordBatch, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    column = batch.column(batch.schema.get_field_index("text"))
    _, offs = T.utf8(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def set_digests(docs: DataFrame, k: int) -> DataFrame:
    """(id, node, n, bits): digest, size and parity bitmap of each row's set. One scan, nothing shuffled."""
    def run(batches):
        for whole in batches:
            for batch in _pieces(whole):
                features, offs, digest = _sets(batch.column(1), k)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest), pa.array(np.diff(offs)), parities(features, offs)], ["id", "node", "n", "bits"])
    return docs.mapInArrow(run, "id bigint, node bigint, n bigint, bits binary")


def parities(features: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Per set, a bitmap of as many bits as the next power of two at least its size (64 at least): which bits an odd number of features hit."""
    size = np.diff(offs)
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    base = np.cumsum(width) - width
    at = np.repeat(base, size) + (T.mix(features ^ np.uint64(0x7A31)) & np.repeat(width - 1, size).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little")
    ends = np.concatenate([[0], np.cumsum(width // 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(packed)])


def screened(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps do not rule them out; pairs: (a, b, n_a, n_b, bits_a, bits_b)."""
    def run(batches):
        for batch in batches:
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            keep = []
            for n_a, n_b, x, y in zip(cols["n_a"].to_pylist(), cols["n_b"].to_pylist(), cols["bits_a"], cols["bits_b"]):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                while len(x) > len(y):  # the parity of a folded bitmap is that of both halves
                    x = x[:len(x) // 2] ^ x[len(x) // 2:]
                while len(y) > len(x):
                    y = y[:len(y) // 2] ^ y[len(y) // 2:]
                keep.append(int(np.bitwise_count(x ^ y).sum()) * (den + num) <= (den - num) * (n_a + n_b))
            yield pa.RecordBatch.from_arrays([cols["a"].filter(pa.array(keep, pa.bool_())), cols["b"].filter(pa.array(keep, pa.bool_()))], ["a", "b"])
    return pairs.mapInArrow(run, "a bigint, b bigint")


def set_signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(sig, node): signatures of each set; a set met again in the same task signs once, so copies do not heap up."""
    def run(batches):
        seen: set[int] = set()
        bands = Bands(num, den, 1 << 10)
        for whole in batches:
            for batch in _pieces(whole):
                features, offs, digest = _sets(batch.column(1), k)
                new = np.array([d not in seen and not seen.add(d) for d in digest.tolist()], bool)
                if len(seen) > 500_000:
                    seen = set()
                size = np.diff(offs)
                if len(size) and size.max() * 3 > bands.low[-1]:
                    bands = Bands(num, den, int(size.max()) * 8)
                keep = np.repeat(new, size)
                offs = np.concatenate([[0], np.cumsum(np.where(new, size, 0))])
                sig, row = signatures(features[keep], offs, bands)
                for at in range(0, len(sig), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(sig[at:at + 200_000].view(np.int64)), pa.array(digest[row[at:at + 200_000]])], ["sig", "node"])
    return docs.where(F.col("id").isNotNull()).mapInArrow(run, "sig bigint, node bigint")


def _folded(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Bitmaps as rows of ``width`` words; the parity of a folded bitmap is that of both halves."""
    out = []
    for x in rows:
        while len(x) > width:
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        out.append(x)
    return np.stack(out)


def screened_forest(bits: list[np.ndarray], size: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs that bitmaps do not rule out; sides as for ``linked``."""
    width = np.array([len(x) for x in bits])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    kinds = np.unique(width)
    for k, narrow in enumerate(kinds):
        mine = np.flatnonzero(width == narrow)
        for wide in kinds[k:k + 2]:  # similar sets differ in width by one step at most
            other = np.flatnonzero(width == wide)
            x, y = _folded([bits[i] for i in mine], narrow), _folded([bits[i] for i in other], narrow)
            for lo in range(0, len(mine), 128):
                part = mine[lo:lo + 128]
                apart = np.zeros((len(part), len(other)), np.int64)
                for word in range(narrow):
                    apart += np.bitwise_count(x[lo:lo + 128, word][:, None] ^ y[None, :, word])
                hit = apart * (den + num) <= (den - num) * (size[part][:, None] + size[other][None, :])
                hit &= (part[:, None] < other[None, :]) if wide == narrow else True
                cross = (side[part][:, None] != side[other][None, :]) | (side[part][:, None] == 2)
                i, j = np.nonzero(hit & cross)
                found.append((part[i], other[j]))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    return _forest((a, b), len(bits))


def by_tile(tiles: DataFrame, pairs_of) -> DataFrame:
    """Links (a, b) that ``pairs_of(table, cuts)`` gives for tables of whole tiles; cuts: first row of each tile, and the end."""
    def groups(table):
        key = table.column("tile").to_numpy()
        return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])

    def links(table):
        out = pairs_of(table, groups(table))
        return pa.RecordBatch.from_pylist([{"a": int(a), "b": int(b)} for a, b in out], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            cuts = groups(rest)
            whole = int(cuts[-2]) if len(cuts) > 1 else 0
            at = 0
            while at < whole:  # some complete groups at a time
                size = np.cumsum(np.diff(_offsets(rest.column("content")))[at:whole])
                to = cuts[np.searchsorted(cuts, at + int(np.searchsorted(size, PIECE)) + 1)]
                to = min(int(to), whole)
                yield links(rest.slice(at, to - at))
                at = to
            rest = rest.slice(whole)
        if rest is not None and len(rest):
            yield links(rest)
    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a bigint, b bigint")


def _offsets(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())])


def screen_blocks(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """Spanning pairs inside tiles that bitmaps do not rule out; tiles: (tile, side, node, n, content = bitmap)."""
    def pairs_of(table, cuts):
        node, side, size = (table.column(c).to_numpy() for c in ("node", "side", "n"))
        bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("content")]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for a, b in screened_forest(bits[lo:hi], size[lo:hi], side[lo:hi], num, den):
                yield node[lo + a], node[lo + b]
    return by_tile(tiles, pairs_of)


def runs(sigs: DataFrame) -> DataFrame:
    """(a, b, long): all pairs of a run of up to RUN nodes with equal signature; of a longer run its rows (signature, node)."""
    ordered = sigs.repartition("sig").sortWithinPartitions("sig", "node")

    def pairs(sig, node, first_long):
        if len(sig) > 1:
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
            sig, node = sig[new], node[new]
        cuts = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1, [len(sig)]])
        long = np.repeat(np.diff(cuts) > RUN, np.diff(cuts))
        long[:cuts[1]] |= first_long
        out = [(sig[long], node[long], long[long])]
        for step in range(1, RUN):
            at = np.flatnonzero((sig[step:] == sig[:-step]) & ~long[:-step])
            if not len(at):
                break
            out.append((node[at], node[at + step], long[at]))
        return [np.concatenate(x) for x in zip(*out)]

    def run(batches):
        sig = node = np.zeros(0, np.int64)
        long = False
        for batch in batches:
            sig, node = np.concatenate([sig, batch.column(0).to_numpy()]), np.concatenate([node, batch.column(1).to_numpy()])
            if not len(sig):
                continue
            open_from = int(np.searchsorted(sig, sig[-1]))
            parts = []
            if open_from:
                parts.append(pairs(sig[:open_from], node[:open_from], long))
                long = False
            sig, node = sig[open_from:], node[open_from:]
            if len(np.unique(node)) > RUN or long and len(node) > 1:  # a long run is handed on as it comes; its last node stays
                parts.append(pairs(sig, node, True))
                sig, node, long = sig[-1:], node[-1:], True
            for a, b, flag in parts:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(flag)], ["a", "b", "long"])
        if len(sig):
            a, b, flag = pairs(sig, node, long)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(flag)], ["a", "b", "long"])
    return ordered.mapInArrow(run, "a bigint, b bigint, long boolean").groupBy("a", "b").agg(F.max("long").alias("long"))


def _common(bands: Bands, tag: str = "tag"):
    return F.element_at(F.array(*[F.lit(int(x)) for x in bands.common]), F.col(tag) + 1)


def ranked(rows: DataFrame, bands: Bands, *order: str) -> DataFrame:
    """Rows (sig, node, tag, ...) of the nodes that have at least as many in their band as similar sets share: only those can have a pair here alone.

    ``held`` counts them. ``first`` marks those but the last ``common - 1`` of a node and band, in an order of the signatures that is the same for all
    nodes: of the signatures that a pair shares, the first has ``common - 1`` shared ones behind it, so each pair has one where both its rows are first.
    """
    mine = Window.partitionBy("node", "tag")
    held = rows.drop("held", "first").withColumn("held", F.count(F.lit(1)).over(mine)).where(F.col("held") >= _common(bands))
    at = F.row_number().over(mine.orderBy(*order, "sig"))
    return held.withColumn("first", at <= F.col("held") - _common(bands) + 1)


def long_rows(found: DataFrame, bands: Bands) -> DataFrame:
    """(sig, node, tag, run, held, first): rows of the long runs, ``run`` a run's rows, the shortest runs first.

    A pair that no short run has shows in at least ``Bands.common`` of them.
    """
    rows = found.where("long").select(F.col("a").alias("sig"), F.col("b").alias("node"), F.expr(f"cast(a & {TAGS - 1} AS int)").alias("tag"))
    return ranked(rows.join(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("run")), "sig"), bands, "run")


def neighbours(rows: DataFrame) -> DataFrame:
    """(a, b): nodes next to each other in a run."""
    order = Window.partitionBy("sig").orderBy("node")
    return rows.select(F.lag("node").over(order).alias("a"), F.col("node").alias("b")).where("a IS NOT NULL AND a <> b").distinct()


def mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (sig, node, ...) of the runs whose nodes do not all lie in one group; labels: (node, grp), a node without one is its own."""
    ends = rows.join(labels, "node", "left").groupBy("sig").agg(F.min(F.coalesce("grp", "node")).alias("lo"), F.max(F.coalesce("grp", "node")).alias("hi"))
    return rows.join(ends.where("lo < hi").select("sig"), "sig")


def signature_pairs(rows: DataFrame, bands: Bands) -> DataFrame:
    """(sig, node): hashes of two signatures of a node at a time, such that similar sets, which share ``Bands.common``, have one in common.

    A band's signatures are dealt to ``common - 1`` classes, one of which holds two shared ones; pairs are made inside a class.
    """
    dealt = rows.withColumn("class", F.pmod(F.xxhash64("sig"), _common(bands) - 1))
    each = dealt.groupBy("node", "tag", "class").agg(F.array_sort(F.collect_set("sig")).alias("s"))
    both = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.xxhash64(x, y))))
    return each.select(F.explode(both).alias("sig"), "node")


def run_shapes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per run: (sig, home, c, homes, others): its most frequent group, its nodes, and the blocks of those in that group and of the others."""
    sizes = rows.join(labels, "node", "left").groupBy("sig", F.coalesce("grp", "node").alias("grp")).agg(F.count(F.lit(1)).alias("m"))
    shape = sizes.groupBy("sig").agg(F.max(F.struct("m", "grp")).alias("top"), F.sum("m").alias("c"))
    blocks = [F.ceil(x / BLOCK_SETS).cast("int").alias(name) for name, x in (("homes", F.col("top.m")), ("others", F.col("c") - F.col("top.m")))]
    return shape.select("sig", F.col("top.grp").alias("home"), "c", *blocks)


def costly(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig): runs that pairs of signatures cut at less cost than blocks compare them. rows: as ``ranked`` gives them."""
    shape = kept(run_shapes(rows, labels).where((F.col("c") > BLOCK_SETS) & (F.col("others") > 1)), "shape")
    pairs = rows.join(shape.select("sig"), "sig", "left_semi").groupBy("sig").agg((F.sum(F.col("held") - 1) / 2).alias("pairs"))
    return shape.join(pairs, "sig").where(F.col("pairs") < F.col("c") * (F.col("homes") + F.col("others"))).select("sig")


def by_cost(rows: DataFrame, cut: DataFrame, bands: Bands) -> tuple[DataFrame, DataFrame]:
    """Rows (sig, node, tag) of the runs to be cut, and those rows of the others that are to be compared.

    The runs to be cut come last in the order, so that a pair that shares any other run has one of those in which both its rows are first. The runs
    that the pairs left share are all cut.
    """
    marked = ranked(rows.join(cut.withColumn("cut", F.lit(1)), "sig", "left").withColumn("cut", F.coalesce("cut", F.lit(0))), bands, "cut", "run")
    return rows.join(cut, "sig", "left_semi").select("sig", "node", "tag"), marked.where("first AND cut = 0").select("sig", "node", "tag")


def run_tiles(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(tile, side, node): blocks of runs to be compared. Nodes of a run's most frequent group meet the others only, not each other."""
    shape = run_shapes(rows, labels)
    placed = rows.join(labels, "node", "left").join(shape, "sig").withColumn("at_home", F.coalesce("grp", "node") == F.col("home"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("at_home"), F.col("homes")).otherwise(F.col("others"))).cast("int")

    def tile(i, kind, j):  # two tiles of one hash would be compared as one
        return F.xxhash64("sig", i, F.lit(kind), j)

    def upto(count):
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.col("own")
    homely = F.transform(upto(F.col("others")), lambda i: F.struct(tile(i, "h", mine).alias("tile"), F.lit(1).alias("side")))
    met = F.transform(upto(F.col("homes")), lambda j: F.struct(tile(mine, "h", j).alias("tile"), F.lit(0).alias("side")))
    among = F.transform(upto(F.col("others")), lambda j: F.struct(
        tile(F.least(mine, j), "o", F.greatest(mine, j)).alias("tile"), F.when(j == mine, 2).when(mine < j, 0).otherwise(1).alias("side")))
    single = F.array(F.struct(F.col("sig").alias("tile"), F.lit(2).alias("side")))
    return placed.withColumn("own", own).select("node", F.inline(
        F.when(F.col("c") <= BLOCK_SETS, single).when(F.col("at_home"), homely).otherwise(F.concat(met, among))))


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of different groups."""
    at, to = (labels.select(F.col("node").alias(c), F.col("grp").alias(f"grp_{c}")) for c in "ab")
    return pairs.join(at, "a", "left").join(to, "b", "left").where("coalesce(grp_a, a) <> coalesce(grp_b, b)").select("a", "b")


def _forest(pairs: tuple[np.ndarray, np.ndarray], n: int) -> list[tuple[int, int]]:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    kept_links = []
    for a, b in zip(pairs[0].tolist(), pairs[1].tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            kept_links.append((a, b))
    return kept_links


def linked(features: np.ndarray, offs: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among sets; sets on sides 0 and 1 are compared across, otherwise (side 2) all with all."""
    n = len(offs) - 1
    size = np.diff(offs)
    if n == 2:
        both = len(np.intersect1d(features[:offs[1]], features[offs[1]:], assume_unique=True))
        return [(0, 1)] if both and den * both >= num * (size.sum() - both) else []
    ids, code, count = np.unique(features, return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    use = shared[code]
    owner, col = np.repeat(np.arange(n), size)[use], rank[code[use]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    common = np.zeros((n, n), np.float32)
    rare = (count[shared] <= RARE)[col]
    o, c = owner[rare], col[rare]
    for step in range(1, RARE):  # features of few sets: their pairs one by one
        at = np.flatnonzero(c[step:] == c[:-step])
        np.add.at(common, (o[at], o[at + step]), 1)
    common += common.T
    owner, col = owner[~rare], col[~rare]
    frequent = np.cumsum(count[shared] > RARE) - 1
    col = frequent[col]
    width = max(64, min(8192, (8 << 20) // max(n, 1)))
    for at in range(0, int(frequent[-1]) + 1 if len(frequent) else 0, width):
        lo, hi = np.searchsorted(col, [at, at + width])
        x = np.zeros((n, width), np.float32)
        x[owner[lo:hi], col[lo:hi] - at] = 1
        common += x @ x.T
    inter = common.astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    hit = np.triu((inter > 0) & (den * inter >= num * union), 1)
    if (side != 2).any():
        hit &= side[:, None] != side[None, :]
    return _forest(np.nonzero(hit), n)


def compare_blocks(tiles: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) inside tiles; tiles: (tile, side, node, content = text)."""
    def pairs_of(table, cuts):
        features, offs, digest = _sets(table.column("content"), k)
        node, side = (table.column(c).to_numpy() for c in ("node", "side"))
        good = digest == node  # an id may stand on several texts; only the one that made the node counts
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = np.flatnonzero(good[lo:hi]) + lo
            rows = rows[np.sort(np.unique(node[rows], return_index=True)[1])]
            if len(rows) < 2:
                continue
            part = np.concatenate([features[offs[r]:offs[r + 1]] for r in rows])
            sizes = offs[rows + 1] - offs[rows]
            for a, b in linked(part, np.concatenate([[0], np.cumsum(sizes)]), side[rows], num, den):
                yield node[rows[a]], node[rows[b]]
    return by_tile(tiles, pairs_of)


def tiles_of(members: DataFrame, bands: Bands, block: int = BLOCK) -> DataFrame:
    """(tile, side, id, node): pairs of blocks inside each candidate group whose sizes can be similar.

    members: (grp, id, node, n). A block holds about ``block`` shingles of one size band; a group that fits one block is one tile.
    """
    low = F.array(*[F.lit(int(x)) for x in bands.low])
    banded = members.withColumn("band", F.size(F.filter(low, lambda x: x <= F.col("n"))))
    volume = banded.groupBy("grp", "band").agg(F.sum("n").alias("v"), F.count("*").alias("c"))
    nb = F.greatest(F.ceil(F.col("v") / block), F.ceil(F.col("c") / BLOCK_SETS)).cast("int")
    group = volume.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("band", nb.alias("nb")))).alias("nb"),
                                      ((F.sum("v") <= block) & (F.sum("c") <= BLOCK_SETS)).alias("one"))
    placed = banded.join(group, "grp")
    own = F.pmod(F.xxhash64("node"), F.element_at("nb", F.col("band"))).cast("int")

    def tile(b1, i, b2, j):
        return F.concat_ws(":", F.col("grp").cast("string"), b1.cast("string"), i.cast("string"), b2.cast("string"), j.cast("string"))

    def others(band):
        count = F.coalesce(F.try_element_at("nb", band), F.lit(0))
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    mine, band = F.col("own"), F.col("band")
    placed = placed.withColumn("own", own)
    same = F.transform(others(band), lambda j: F.struct(
        tile(band, F.least(mine, j), band, F.greatest(mine, j)).alias("tile"), F.when(j == mine, 2).when(mine < j, 0).otherwise(1).alias("side")))
    up = F.transform(others(band + 1), lambda j: F.struct(tile(band, mine, band + 1, j).alias("tile"), F.lit(0).alias("side")))
    down = F.transform(others(band - 1), lambda j: F.struct(tile(band - 1, j, band, mine).alias("tile"), F.lit(1).alias("side")))
    single = F.array(F.struct(F.col("grp").cast("string").alias("tile"), F.lit(2).alias("side")))
    return placed.select("id", "node", "n", F.inline(F.when(F.col("one"), single).otherwise(F.concat(same, up, down))))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of docs: id, n_shingles, component (smallest id reachable by links of similarity >= num / den)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = kept(set_digests(rows, k), "sets")
    with_set = sets.where("n > 0 AND id IS NOT NULL")
    nodes = kept(with_set.groupBy("node", "n").agg(F.min("id").alias("id"), F.first("bits").alias("bits")), "nodes")
    found = kept(runs(set_signatures(rows, k, num, den)), "runs")
    bands = Bands(num, den, int(nodes.agg(F.max("n")).first()[0] or 1) * 3)  # the largest sets may sign for the band above theirs

    def screen(pairs):
        one, two = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
        return screened(pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), num, den)
    long = kept(long_rows(found, bands), "long")
    near = kept(screen(found.where("NOT long").select("a", "b").unionAll(neighbours(long.where("first")))), "near")
    labels = kept(components(near).withColumnRenamed("component", "grp"), "labels")
    before = long.count()
    long = kept(ranked(mixed(long, labels), bands, "run"), "long")
    if 10 * long.count() < 9 * before:  # a node that loses its last outsiders leaves, which may settle other runs
        long = kept(ranked(mixed(long, labels), bands, "run"), "long")
    cut, direct = by_cost(long, kept(costly(long, labels), "cut"), bands)
    direct = kept(mixed(direct, labels), "direct")
    again = kept(runs(signature_pairs(ranked(cut, bands), bands)), "runs")
    dense = mixed(again.where("long").select(F.col("a").alias("sig"), F.col("b").alias("node")), labels)
    blocks = run_tiles(dense.unionAll(direct.select("sig", "node")), labels).join(nodes.select("node", "n", F.col("bits").alias("content")), "node")
    tried = screen_blocks(blocks, num, den)
    candidates = components(near.unionAll(screen(across(again.where("NOT long").select("a", "b"), labels))).unionAll(tried))
    nodes = nodes.drop("bits")
    tiles = kept(tiles_of(nodes.join(candidates.withColumnRenamed("component", "grp"), "node"), bands), "tiles")
    few = tiles.count() <= SENT
    texts = (F.broadcast(tiles) if few else tiles).join(rows, "id").select("tile", "side", "node", F.col("text").alias("content"))
    groups = kept(components(compare_blocks(texts, k, num, den)).join(nodes, "node"), "groups")
    smallest = groups.groupBy("component").agg(F.min("id").alias("first_id"))
    together = kept(groups.join(smallest, "component").select("node", "first_id"), "together")
    classes = kept(nodes.join(together, "node", "left").select("node", F.coalesce("first_id", "id").alias("component")), "classes")
    found = sets.join(classes, (sets["node"] == classes["node"]) & (sets["n"] > 0), "left")
    return found.select(sets["id"], sets["n"].alias("n_shingles"), F.when(sets["id"].isNotNull(), F.coalesce("component", sets["id"])).alias("component"))
