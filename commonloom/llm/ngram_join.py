"""N-gram Jaccard join of documents by count vectors in an R-tree.

Documents with equal shingle sets are one node. Two sets with a Jaccard similarity of p or more have
a shingle in common that is among the first (1 - p) / (1 + p) * size + 1 of the smaller set and the
first (1 - p) * size + 1 of the larger one, in any one order of all shingles; here rare ones come
before those that are met often, so that texts that only share a template don't meet. Nodes of
like sizes that share such a shingle form a block. In each block a node's shingles are hashed into groups, and the counts of the groups are the points of a
packed R-tree. Boxes are compared from the root down: the sum of coordinate minima bounds the
overlap of any two points in them from above, and so it does for two points. Boxes whose points
are already connected are not compared, so that a group of near copies costs about as much as it
has members.

What the bound connects is a class of candidates. The texts of each class then meet in one unit,
which the same tree searches with every shingle as a group of its own; that overlap is exact, so
only true links connect. Classes too large for one unit are cut into parts that have some members
in common, and then whatever stands outside of the largest connected part is compared with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commonloom.llm.common import HOT, NO_ID, SMALL, arrow_slices, checkpointed, components, join_hot, join_keyed, join_wide, mix64, semi_keyed, whole_units, word_codes, word_hashes

#: Members of a leaf of the tree, and children of a box.
LEAF, FAN = 16, 8
#: Members and shingles that one unit compares, at most; larger blocks and classes are split.
TILE, SHINGLES = 2048, 4_000_000
#: Rows of a block that are gathered at once.
GATHERED = 4096
#: Members that all parts of a split class have in common, at most.
HUBS = 32
#: Shingles that the order knows to be frequent, at most (a few MB), and how often a task's or a block's must be seen to count.
FREQUENT, OFTEN = 200_000, 8
#: Times that shingles of overfull blocks are added to the frequent ones.
ROUNDS = 3
_PLACE = 0x9E3779B97F4A7C15


def by_doc(doc: np.ndarray) -> np.ndarray:
    """A stable order by small numbers; by counting where they fit 16 bits."""
    return np.argsort(doc.astype(np.uint16) if len(doc) and doc.max() < 1 << 16 else doc, kind="stable")


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each lower-cased text, by text and hash; the texts they're of; each text's number of them."""
    codes, distinct, counts = word_codes(pc.ascii_lower(pc.fill_null(texts, "")))
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(codes):
        return np.zeros(0, dtype=np.uint64), doc, counts
    hashes, ends = word_hashes(distinct)[codes], np.repeat(np.cumsum(counts), counts)
    place = np.arange(len(codes))
    starts = np.flatnonzero((place + words <= ends) | ((counts < words)[doc] & (place == ends - counts[doc])))
    value = np.zeros(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            at = starts + k
            inside = at < ends[starts]
            factor = np.uint64(pow(_PLACE, k + 1, 1 << 64))
            value += np.where(inside, (hashes[np.minimum(at, len(codes) - 1)] + np.uint64(1)) * factor, np.uint64(0))
    value, doc = mix64(value), doc[starts]
    order = np.argsort(value)
    order = order[by_doc(doc[order])]
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, doc, np.bincount(doc, minlength=len(counts)).astype(np.int64)


def _sums(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums by place modulo 2^64, in two halves that floats hold exactly."""
    low = np.bincount(at, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), size).astype(np.uint64)
    high = np.bincount(at, (values >> np.uint64(32)).astype(np.float64), size).astype(np.uint64)
    with np.errstate(over="ignore"):
        return low + (high << np.uint64(32))


def signatures(value: np.ndarray, doc: np.ndarray, size: int) -> list[np.ndarray]:
    return [_sums(v, doc, size).view(np.int64) for v in (value, mix64(value ^ np.uint64(0x2545F491)))]


class Often:
    """Counts of the shingles that many sets of a task share; the rarest are forgotten when there are too many."""

    def __init__(self) -> None:
        self.value, self.times = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def add(self, value: np.ndarray) -> None:
        value, times = np.unique(value, return_counts=True)
        some = times >= OFTEN // 2
        both, at = np.unique(np.concatenate([self.value, value[some]]), return_inverse=True)
        times = np.bincount(at, np.concatenate([self.times, times[some]]), len(both)).astype(np.int64)
        if len(both) > FREQUENT // 4:
            best = np.sort(np.argpartition(-times, FREQUENT // 4)[: FREQUENT // 4])
            both, times = both[best], times[best]
        self.value, self.times = both, times


def leading(value: np.ndarray, doc: np.ndarray, n: np.ndarray, percent: int, often: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which shingles come so early in their set that a similar set has one of them in common, which so early that a similar one of at least the same size has, and each shingle's place in its set.

    `value` is sorted by text and hash. `often`, sorted, come last, by `level` and hash. Sets so small that only equal ones reach `percent` have none.
    """
    rank = np.zeros(len(value), dtype=np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, value), len(often) - 1)
        rank = np.where(often[at] == value, level[at], 0)
    order = by_doc(rank)
    order = order[by_doc(doc[order])]  # within a text, by rank and hash
    first, able = np.cumsum(n) - n, n * (100 - percent) >= percent
    place = np.empty(len(value), dtype=np.int64)
    place[order] = np.arange(len(value)) - first[doc]
    any_size, larger = (np.where(able, n - least + 1, 0)[doc] for least in (-(-percent * n // 100), -(-2 * percent * n // (100 + percent))))
    return place < any_size, place < larger, place


def size_bounds(percent: int) -> np.ndarray:
    """Where classes of sizes begin; similar sets are in one class or in neighbouring ones."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return np.array(bounds, dtype=np.int64)


def size_salt(n: np.ndarray, percent: int, up: int) -> np.ndarray:
    """A hash of each size's class, or of the next."""
    return mix64(np.searchsorted(size_bounds(percent), n, "right").astype(np.uint64) + np.uint64(up))


def block_keys(value: np.ndarray, doc: np.ndarray, n: np.ndarray, percent: int, often: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of blocks, the texts they're of, how many shingles of the text stand from the shared one on, and whether the text may be the smaller one of a pair there.

    A pair meets in the size class of its larger set, so that smaller sets stand in the next class too; there the number of shingles is negative.
    """
    any_size, larger, place = leading(value, doc, n, percent, often, level)
    key = [value[p] ^ size_salt(n, percent, k)[doc[p]] for k, p in enumerate((any_size, larger))]
    rest = n[doc] - place
    owner = np.concatenate([doc[any_size], doc[larger]])
    return np.concatenate(key).view(np.int64), owner, np.concatenate([rest[any_size], -rest[larger]]), np.concatenate([larger[any_size], np.ones(len(key[1]), dtype=bool)])


#: Groups that a set's shingles are counted in: a fourth of its size, within these bounds.
LEAST_GROUPS, MOST_GROUPS = 64, 4096


def groups_of(n: np.ndarray) -> np.ndarray:
    groups = np.full(len(n), LEAST_GROUPS, dtype=np.int64)
    while (grow := (groups < MOST_GROUPS) & (4 * groups < n)).any():
        groups[grow] *= 2
    return groups


def points_of(value: np.ndarray, doc: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Each set's counts. Groups go by the hash's leading bits, so that neighbours of a longer point add up to a shorter one."""
    groups = groups_of(n)
    first = np.cumsum(groups) - groups
    shift = np.uint64(64) - np.log2(groups).astype(np.uint64)
    counts = np.bincount(first[doc] + (value >> shift[doc]).astype(np.int64), minlength=int(groups.sum()))
    return [c.astype("<u1" if c.max() < 1 << 8 else "<u8").tobytes() for c in np.split(counts, first[1:])] if len(n) else []


def same_length(raw: list[bytes], n: np.ndarray, groups: int | None = None) -> np.ndarray:
    """Points as rows of `groups` counts, or of as many as the shortest has."""
    lengths = groups_of(n)
    groups = int(lengths.min()) if groups is None else groups
    out = np.empty((len(raw), groups), dtype=np.int32)
    kinds = np.array([len(r) for r in raw]) * 8192 + lengths
    for kind in np.unique(kinds):
        some = np.flatnonzero(kinds == kind)
        length = int(kind % 8192)
        counts = np.frombuffer(b"".join(raw[i] for i in some), dtype=f"<u{kind // 8192 // length}").reshape(len(some), groups, -1)
        out[some] = counts.sum(axis=2)
    return out


def overlap_allows(bound: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of `bound` would make sets of summed `sizes` similar: percent * union <= 100 * overlap."""
    return (100 + percent) * bound >= percent * sizes


class Tree:
    """A packed R-tree over points of a unit: leaves of neighbours in order of side, size and mass, boxes of `FAN` boxes above them."""

    def __init__(self, n: np.ndarray, coarse: np.ndarray, percent: int, label: np.ndarray, side: np.ndarray | None) -> None:
        self.percent = percent
        side = np.zeros(len(n), dtype=np.int8) if side is None else side
        self.order = order = np.lexsort((coarse[:, 1], coarse[:, 0], n, side))
        self.n, self.label, self.side = n[order], label[order].copy(), side[order]
        self.two_sided = self.side[-1] > 0
        self.pairs: list[tuple[int, int]] = []
        cuts = np.arange(0, len(n), LEAF)
        self.levels = [(cuts, np.append(cuts[1:], len(n)), *self._boxes(coarse[order], self.n, self.n, cuts))]
        while len(self.levels[-1][0]) > 1:
            lo, hi, tops, least, most = self.levels[-1]
            cuts = np.arange(0, len(lo), FAN)
            self.levels.append((lo[cuts], hi[np.append(cuts[1:], len(lo)) - 1], *self._boxes(tops, least, most, cuts)))

    def _bounds(self, i: int, begin: int, stop: int) -> np.ndarray:
        """The most that a point's set can overlap with those of a range of points."""
        raise NotImplementedError

    @staticmethod
    def _boxes(tops: np.ndarray, least: np.ndarray, most: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.maximum.reduceat(tops, cuts, axis=0), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)

    def connect(self) -> list[tuple[int, int]]:
        """A spanning forest of the pairs that the bound leaves, as places in the unit; pairs of one label, or of one side other than 0, don't count."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, a, b = todo.pop()
            lo, hi, *_ = self.levels[level]
            if not self._may(level, a, b):
                continue
            if not level:
                self._compare(lo[a], hi[a], lo[b], hi[b])
                continue
            below = len(self.levels[level - 1][0])
            ones, twos = (range(x * FAN, min(x * FAN + FAN, below)) for x in (a, b))
            todo += [(level - 1, x, y) for x in ones for y in twos if x < y]
            todo += [(level - 1, x, x) for x in ones if a == b]  # the nearest first, so that they connect
        return self.pairs

    def _may(self, level: int, a: int, b: int) -> bool:
        """May points of two boxes be similar, on different sides and not connected yet?"""
        lo, hi, tops, least, most = self.levels[level]
        if 100 * most[a] < self.percent * least[b] or 100 * most[b] < self.percent * least[a]:
            return False
        if self.two_sided and self.side[lo[a]] == self.side[hi[b] - 1]:
            return False
        one, two = self.label[lo[a] : hi[a]], self.label[lo[b] : hi[b]]
        if one[0] == two[0] and (one == one[0]).all() and (two == one[0]).all():
            return False
        return a == b or bool(overlap_allows(np.minimum(tops[a], tops[b]).sum(), least[a] + least[b], self.percent))

    def _compare(self, lo: int, hi: int, start: int, stop: int) -> None:
        for i in range(lo, hi):
            begin = max(start, i + 1)
            if begin >= stop:
                break
            fits = (self.label[begin:stop] != self.label[i]) & (100 * self.n[begin:stop] >= self.percent * self.n[i]) & (100 * self.n[i] >= self.percent * self.n[begin:stop])
            if self.two_sided:
                fits &= self.side[begin:stop] != self.side[i]
            if not fits.any():
                continue
            fits &= overlap_allows(self._bounds(i, begin, stop), self.n[i] + self.n[begin:stop], self.percent)
            for j in np.flatnonzero(fits) + begin:
                if self.label[i] != self.label[j]:
                    self.pairs.append((int(self.order[i]), int(self.order[j])))
                    self.label[self.label == self.label[j]] = self.label[i]


class Points(Tree):
    """Of counts by group."""

    def __init__(self, counts: np.ndarray, n: np.ndarray, *rest) -> None:
        super().__init__(n, counts.reshape(len(n), LEAST_GROUPS, -1).sum(axis=2), *rest)
        self.counts = counts[self.order]

    def _bounds(self, i: int, begin: int, stop: int) -> np.ndarray:
        return np.minimum(self.counts[i], self.counts[begin:stop]).sum(axis=1)


class Sets(Tree):
    """Of whole sets, each shingle a group of its own: the bound is the overlap."""

    def __init__(self, sets: list[np.ndarray], *rest) -> None:
        n = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        groups = (np.concatenate(sets) >> np.uint64(64 - (LEAST_GROUPS.bit_length() - 1))).astype(np.int64)
        super().__init__(n, np.bincount(owner * LEAST_GROUPS + groups, minlength=len(n) * LEAST_GROUPS).reshape(len(n), LEAST_GROUPS), *rest)
        distinct, self.flat = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True)
        self.ends = np.concatenate([[0], np.cumsum(self.n)])
        self.seen = np.zeros(len(distinct), dtype=bool)

    def _bounds(self, i: int, begin: int, stop: int) -> np.ndarray:
        mine = self.flat[self.ends[i] : self.ends[i + 1]]
        self.seen[mine] = True
        found = np.add.reduceat(self.seen[self.flat[self.ends[begin] : self.ends[stop]]], self.ends[begin:stop] - self.ends[begin], dtype=np.int64)
        self.seen[mine] = False
        return found


def stars(left: list[int], right: list[int]) -> tuple[list[int], list[int]]:
    """Each linked node other than the smallest it is connected with, and that one."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for a, b in zip(left, right, strict=True):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return list(parent), [top(x) for x in parent]


def connected(tree: Tree, node: np.ndarray) -> tuple[list[int], list[int]]:
    """What the pairs of a unit's tree connect (see `stars`)."""
    pairs = tree.connect()
    return stars([int(node[i]) for i, _ in pairs], [int(node[j]) for _, j in pairs])


def numbers(node: np.ndarray) -> np.ndarray:
    return np.unique(node, return_inverse=True)[1]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def leaf_pairs(raw: list[bytes], n: np.ndarray, node: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the bound leaves in all units of one leaf at once: by size, then in the fewest groups, then in all that both have."""
    unit = np.repeat(np.arange(len(sizes)), sizes)
    small = (sizes <= LEAF)[unit]
    left, right = [], []
    for step in range(1, LEAF):
        a = np.flatnonzero((unit[step:] == unit[:-step]) & small[step:])
        b = a + step
        fits = (percent * n[a] <= 100 * n[b]) & (percent * n[b] <= 100 * n[a]) & (node[a] != node[b])
        left.append(a[fits])
        right.append(b[fits])
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return a, b
    some, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    coarse = same_length([raw[i] for i in some], n[some], LEAST_GROUPS)
    x, y = at[: len(a)], at[len(a) :]
    bound = np.concatenate([np.minimum(coarse[x[k : k + 8192]], coarse[y[k : k + 8192]]).sum(axis=1) for k in range(0, len(x), 8192)])
    fits = overlap_allows(bound, n[a] + n[b], percent)
    a, b = a[fits], b[fits]
    fine = [np.minimum(*same_length([raw[i], raw[j]], n[[i, j]])).sum() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    fits = overlap_allows(np.array(fine, dtype=np.int64), n[a] + n[b], percent)
    return a[fits], b[fits]


def _search_points(percent: int):
    """Over rows of points sorted by block: each block's connections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_units(batches, ("_block",), "_point"):
            node, n, raw = part.column("_node").to_numpy(), part.column("_n").to_numpy(), part.column("_point").to_pylist()
            a, b = leaf_pairs(raw, n, node, np.diff(starts), percent)
            left, right = node[a].tolist(), node[b].tolist()
            for k in np.flatnonzero(np.diff(starts) > LEAF):
                unit = slice(starts[k], starts[k + 1])
                more = connected(Points(same_length(raw[unit], n[unit]), n[unit], percent, numbers(node[unit]), None), node[unit])
                left += more[0]
                right += more[1]
            yield pa.RecordBatch.from_pydict(dict(zip(("a", "b"), stars(left, right), strict=True)), schema=_LINKS)

    return run


def _search_texts(percent: int, words: int):
    """Over rows of texts sorted by unit: each unit's true connections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_units(batches, ("_class", "_x", "_y"), "_text"):
            node, label, side = (part.column(c).to_numpy() for c in ("_node", "_label", "_side"))
            value, doc, n = shingle_sets(part.column("_text"), words)
            sets, left, right = np.split(value, np.cumsum(n)[:-1]), [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                real = np.flatnonzero(n[lo:hi]) + lo
                if len(real) > 1:
                    a, b = connected(Sets([sets[i] for i in real], percent, numbers(label[real]), side[real]), node[real])
                    left += a
                    right += b
            yield pa.RecordBatch.from_pydict({"a": left, "b": right}, schema=_LINKS)

    return run


class Order:
    """The shingles known to be frequent, which come last in the order, and their levels."""

    def __init__(self) -> None:
        self.value, self.level = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def add(self, value: np.ndarray, level: np.ndarray) -> bool:
        """Were there new ones?"""
        both = np.concatenate([self.value, value])
        kept, first = np.unique(both, return_index=True)
        fresh = len(kept) > len(self.value)
        self.value, self.level = kept, np.concatenate([self.level, level])[first]
        return fresh


def _most_frequent(counted: DataFrame) -> pd.DataFrame:
    """The rows with the largest `_times`, at most `FREQUENT` of them, with the `_level` of that number."""
    level = (F.floor(F.log2("_times")) + 1).cast("int")
    found, least = 0, 99
    for row in counted.groupBy(level.alias("_level")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_level")).collect():  # a row for each power of two
        if (found := found + row["_n"]) > FREQUENT:
            break
        least = row["_level"]
    return counted.withColumn("_level", level).where(F.col("_level") >= least).toPandas()


def _gathered(keys: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """The distinct sets of each shared block as `_members`, in pieces if there are many; of few ones only those that may have a partner there."""
    pieces = F.pmod(F.xxhash64("_s1"), F.ceil(F.col("_rows") / GATHERED)).alias("_piece")

    def gather(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_block", "_rows", pieces).agg(F.collect_set(F.struct("_s1", "_n", "_rest")).alias("_members"))

    found = gather(keys.join(shared.where(F.col("_rows") < HOT), "_block"))
    hot = shared.where(F.col("_rows") >= HOT)
    if not hot.isEmpty():  # these are few, since each has so many rows
        found = found.unionByName(gather(keys.join(F.broadcast(hot) if hot.count() <= SMALL else hot, "_block")))

    def partners(x: Column, y: Column) -> Column:
        # if the shared shingle is the first that they share, no more than what follows it in either is their overlap
        like = (percent * x["_n"] <= 100 * y["_n"]) & (percent * y["_n"] <= 100 * x["_n"]) & (F.greatest(x["_rest"], y["_rest"]) > 0) & (x["_s1"] != y["_s1"])
        return like & overlap_allows(F.least(F.abs(x["_rest"]), F.abs(y["_rest"])), x["_n"] + y["_n"], percent)

    may = F.filter("_members", lambda x: F.exists("_members", lambda y: partners(x, y)))
    whole = (F.size("_members") <= LEAF) & (F.col("_rows") <= GATHERED)  # of a piece, partners may stand in others
    found = found.withColumn("_members", F.when(whole, may).otherwise(F.col("_members")))
    return found.where((F.size("_members") > 1) | (F.col("_rows") > GATHERED))


def jaccard_groups(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, `n_shingles`, and `component_id`, the smallest id that can be reached over links.

    Two documents link when 100 * overlap >= `percent` * union of their sets of distinct shingles
    of `words` words of the text with A-Z lower-cased; a text of fewer words is one shingle, and a
    text without words, or null, has none and links with nothing: it is its own component. Rows
    that share an id are one document with several texts. Rows with a null id have no component
    (null) and link with nothing. Other columns are not read; an empty table gives an empty result.
    """
    if not 67 <= percent <= 100 or words < 1:
        raise ValueError("percent must be from 67 to 100, and words at least 1")  # below, too many shingles lead
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text_col).alias("_text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = Often()
        for part in arrow_slices(batches, "_text"):
            value, doc, n = shingle_sets(part.column("_text"), words)
            s1, s2 = signatures(value, doc, len(n))
            _, distinct = np.unique(s1, return_index=True)
            once = np.zeros(len(n), dtype=bool)
            once[distinct] = True
            often.add(value[once[doc]])
            yield pa.RecordBatch.from_pydict({"_id": part.column("_id"), "_n": n, "_s1": s1, "_s2": s2, "_size": pc.fill_null(pc.binary_length(part.column("_text")), 0).cast(pa.int64()), "_row": np.ones(len(n), dtype=bool)})
        if len(often.value):
            none = np.zeros(len(often.value), dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"_id": none, "_n": often.times, "_s1": often.value.view(np.int64), "_s2": none, "_size": none, "_row": none.astype(bool)})

    def keys_of(often: np.ndarray, level: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in arrow_slices(batches, "_text"):
                value, doc, n = shingle_sets(part.column("_text"), words)
                key, owner, rest, short = block_keys(value, doc, n, percent, often, level)
                yield pa.RecordBatch.from_pydict({"_block": key, "_s1": _sums(value, doc, len(n)).view(np.int64)[owner], "_n": n[owner], "_rest": rest, "_short": short})

        return run

    def describe_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "_text"):
            value, doc, n = shingle_sets(part.column("_text"), words)
            points = points_of(value, doc, n)
            yield pa.RecordBatch.from_pydict({"_node": part.column("_id"), "_n": n, "_point": pa.array(points, pa.binary())}).filter(pa.array(n > 0))

    described = checkpointed(source.mapInArrow(describe, "_id long, _n long, _s1 long, _s2 long, _size long, _row boolean"))
    rows = described.where("_row").drop("_row")
    named = F.col("_id") != NO_ID
    nodes = rows.where(named & (F.col("_n") > 0)).groupBy("_s1", "_s2").agg(F.min("_id").alias("_node"), F.max("_size").alias("_size"), F.count(F.lit(1)).alias("_times"))
    nodes = checkpointed(nodes)

    counted = described.where("NOT _row").groupBy(F.col("_s1").alias("_value")).agg(F.sum("_n").alias("_times")).where(F.col("_times") >= OFTEN)
    order, table = Order(), _most_frequent(counted)
    order.add(table["_value"].to_numpy(np.int64).view(np.uint64), table["_level"].to_numpy(np.int64))
    for left in range(ROUNDS, -1, -1):
        keys = source.where(named).mapInArrow(keys_of(order.value, order.level), "_block long, _s1 long, _n long, _rest long, _short boolean")
        shared = keys.groupBy("_block").agg(F.min("_s1").alias("_low"), F.max("_s1").alias("_high"), F.max("_rest").alias("_own"), F.max("_short").alias("_any"), F.count(F.lit(1)).alias("_rows"))
        shared = checkpointed(shared.where("_low <> _high AND _own > 0 AND _any").select("_block", "_rows"))
        inside = checkpointed(_gathered(keys.drop("_short"), shared, percent))
        crowded = inside.where(F.col("_rows") > TILE).groupBy("_block").agg(F.sum(F.size("_members")).alias("_times"), F.max(F.array_max("_members._n")).alias("_most"))
        crowded = checkpointed(crowded.where(F.col("_times") > TILE))
        if not left or crowded.isEmpty():
            break
        # texts that share a shingle with so many are to meet by others; which class a block is of is one of two
        table = _most_frequent(crowded)
        key, most, level = table["_block"].to_numpy(np.int64).view(np.uint64), table["_most"].to_numpy(np.int64), table["_level"].to_numpy(np.int64)
        if not order.add(np.concatenate([key ^ size_salt(most, percent, up) for up in (0, 1)]), np.concatenate([level, level])):
            break
    inside = inside.select("_block", F.array_sort("_members._s1").alias("_set"), ((F.col("_rows") > GATHERED) | (F.size("_members") > TILE)).alias("_large"))
    # near copies have most of their leading shingles in common: of blocks with the same members one is enough
    single = inside.where("NOT _large").groupBy("_set").agg(F.min("_block").alias("_block"), F.lit(False).alias("_large"))
    single = single.unionByName(inside.where("_large")).select("_block", "_large", F.explode("_set").alias("_s1"))
    members = checkpointed(single.join(nodes.select("_s1", "_node"), "_s1").select("_block", "_node", "_large"))
    few, large = members.where("NOT _large"), members.where("_large")
    wanted = checkpointed(few.select(F.col("_node").alias("_id")).distinct())
    points = checkpointed(semi_keyed(source, wanted, ["_id"]).mapInArrow(describe_points, "_node long, _n long, _point binary"))
    blocks = few.select("_block", "_node").join(points, "_node").repartition("_block").sortWithinPartitions("_block")
    met = blocks.mapInArrow(_search_points(percent), "a long, b long")
    hubs = large.join(large.groupBy("_block").agg(F.min("_node").alias("_least")), "_block").select("_node", "_least")
    classes = components(met.union(hubs))
    roots = _verified(source, classes, nodes.select(F.col("_node").alias("_id"), "_size"), percent, words)

    rooted = nodes.join(roots.select(F.col("a").alias("_node"), F.col("b").alias("_root")), "_node", "left").select("_s1", "_s2", "_times", F.coalesce("_root", "_node").alias("_root"))
    linked = named & (F.col("_n") > 0)
    found = join_hot(rows.where(linked), checkpointed(rooted), ["_s1", "_s2"], "_times").unionByName(rows.where(~linked), allowMissingColumns=True)
    kind = docs.schema[id_col].dataType
    own = F.nullif(F.col("_id"), F.lit(NO_ID))
    return found.select(
        own.cast(kind).alias(id_col), F.col("_n").alias("n_shingles"), F.when(named, F.coalesce("_root", "_id")).cast(kind).alias("component_id")
    )


def _verified(source: DataFrame, classes: DataFrame, sizes: DataFrame, percent: int, words: int) -> DataFrame:
    """The true connections within classes of candidates (`node, root` of nodes other than roots), as nodes `a` and the smallest `b` they are connected with."""
    members = checkpointed(classes.select(F.col("node").alias("_id"), F.col("root").alias("_class")).union(classes.select("root", "root").distinct()))
    bulk = members.join(sizes, "_id").groupBy("_class").agg(F.count(F.lit(1)).alias("_m"), F.sum("_size").alias("_bytes"))
    parts_of = F.greatest(F.ceil(F.col("_m") / TILE), F.ceil(F.col("_bytes") / (4 * SHINGLES))).cast("int")
    few = F.greatest(F.lit(1), F.least(F.lit(HUBS), F.floor(F.col("_m") / (8 * parts_of)))).cast("int")  # an eighth of a part at most
    large = checkpointed(bulk.select("_class", parts_of.alias("_parts"), few.alias("_hubs")).where("_parts > 1"))
    shape = "a long, b long"

    def search(units: DataFrame) -> DataFrame:
        unit = ["_class", "_x", "_y"]
        return units.select(*unit, "_side", "_label", F.col("_id").alias("_node"), "_text").repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_search_texts(percent, words), shape)

    none, zero = F.lit(0), F.lit(0).cast("byte")
    whole = checkpointed(join_keyed(members, large.select("_class"), ["_class"], "left_anti"))
    whole_found = search(join_wide(source, whole, ["_id"]).select("_class", none.alias("_x"), none.alias("_y"), zero.alias("_side"), F.col("_id").alias("_label"), "_id", "_text"))
    if large.isEmpty():
        return checkpointed(whole_found)
    split = checkpointed(join_keyed(members, large, ["_class"]))
    hubs = split.groupBy("_class", F.pmod(F.xxhash64("_id"), "_hubs").alias("_nth")).agg(F.min("_id").alias("_id"), F.min("_parts").alias("_parts"))
    own = split.select("_class", "_id", F.pmod(F.xxhash64("_id", F.lit(5)), "_parts").cast("int").alias("_x"))
    parts = own.union(hubs.select("_class", "_id", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_x"))).distinct()
    first = search(join_wide(source, checkpointed(parts), ["_id"]).select("_class", "_x", none.alias("_y"), zero.alias("_side"), F.col("_id").alias("_label"), "_id", "_text"))
    first = checkpointed(first)
    labels = components(first).withColumnRenamed("node", "_id")
    labelled = checkpointed(split.join(labels, "_id", "left").select("_class", "_parts", "_id", F.coalesce("root", "_id").alias("_label")))
    giant = labelled.groupBy("_class", "_label").agg(F.count(F.lit(1)).alias("_n")).groupBy("_class").agg(F.max_by("_label", F.struct("_n", "_label")).alias("_giant"), F.sum("_n").alias("_m"), F.max("_n").alias("_most"))
    giant = giant.select("_class", "_giant", F.ceil((F.col("_m") - F.col("_most")) / TILE).cast("int").alias("_probes")).where("_probes > 0")
    left = checkpointed(join_keyed(labelled, checkpointed(giant), ["_class"]))
    place = F.pmod(F.xxhash64("_id", F.lit(5)), "_parts").cast("int")
    probe = F.pmod(F.xxhash64("_id", F.lit(7)), "_probes").cast("int")
    bases = left.select("_class", "_id", "_label", place.alias("_x"), F.explode(F.sequence(F.lit(0), F.col("_probes") - 1)).alias("_y"), F.lit(1).cast("byte").alias("_side"))
    probes = left.where("_label <> _giant").select("_class", "_id", "_label", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_x"), probe.alias("_y"), F.lit(2).cast("byte").alias("_side"))
    second = checkpointed(search(join_wide(source, checkpointed(bases.union(probes)), ["_id"])))
    return checkpointed(whole_found.union(components(first.union(second)).select("node", "root")))


def op2(docs: DataFrame) -> DataFrame:
    return jaccard_groups(docs, percent=90, words=3)
