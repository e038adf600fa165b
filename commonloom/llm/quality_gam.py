"""Quality classifier: a generalised additive model with pairwise interactions.

Numeric features of a text are cut into bins; cyclic boosting grows one shallow tree on one
feature after another, and afterwards on pairs of features, and adds each to that feature's or
pair's lookup table. A score is the logistic function of a sum of table entries, looked up for
whole batches at a time. The model is fitted on the driver to a bounded sample of labelled rows
(`max_labelled`); everything else runs over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commonloom.llm.common import arrow_slices, carried, held_out, may_learn, text_of, with_columns_back, word_codes
from commonloom.llm.quality_rules import covered, duplicate_lines, repeat_lengths

FEATURES = (
    "log_chars", "log_words", "word_length", "line_words", "upper", "digits", "marks", "symbols", "bangs", "high_bytes", "distinct_words", "common_word", "repeated_pairs", "repeated_windows", "longest_repeat", "duplicate_lines",
    "marked_words", "longest_word",
)

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[ord("!")] = 5
_CLASS[128:] = 6


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends[1:]] - total[ends[:-1]]


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of `FEATURES` for each text; null counts as empty, all zeros."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    raw = texts.cast(pa.large_binary())
    size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8)
    kind = _CLASS[data]
    shares = [_per_text(kind == c, ends) / np.maximum(size, 1) for c in range(1, 7)]
    codes, distinct, n = word_codes(texts)
    word_ends = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    words = np.maximum(n, 1)
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    marked = pc.match_substring_regex(distinct, r"[#*$%&|<>!]").to_numpy(zero_copy_only=False)
    of_word, marked = (length[codes], marked[codes]) if len(codes) else (codes, codes)
    seen, times = np.unique(doc * (len(distinct) + 1) + codes, return_counts=True)
    owner = seen // (len(distinct) + 1)
    most, longest, widest = (np.zeros(len(n), dtype=np.int64) for _ in range(3))
    np.maximum.at(most, owner, times)
    np.maximum.at(widest, doc, of_word)
    repeats = repeat_lengths(codes, n)
    np.maximum.at(longest, doc, repeats)
    lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False).astype(np.int64) + 1
    columns = [
        np.log1p(size), np.log1p(n), _per_text(of_word, word_ends) / words, n / lines, *shares,
        np.bincount(owner, minlength=len(n)) / words, most / words,
        _per_text(repeats >= 2, word_ends) / words, _per_text(covered(repeats, 3, 3), word_ends) / words, np.log1p(longest),
        np.array([duplicate_lines(t) for t in texts.to_pylist()], dtype=np.int64) / lines,
        _per_text(marked, word_ends) / words, np.log1p(widest),
    ]
    return np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)


@dataclass
class Gam:
    """Bin edges, one table a feature, and tables for pairs of features on coarser bins."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    start: float
    coarse: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> tuple[np.ndarray, float]:
    """The best tree of few leaves over ordered bins: each bin's value, and the gain."""
    parts, gain = [(0, len(grad))], 0.0
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, -1, 0)
        for p, (a, b) in enumerate(parts):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gains = worth(a, cut) + worth(cut, b) - worth(a, b)
                at = int(np.argmax(gains))
                best = max(best, (float(gains[at]), p, int(cut[at])))
        if best[1] < 0:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
        gain += best[0]
    value = np.empty(len(grad))
    for a, b in parts:
        value[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return value, gain


def _cross(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best tree on two features that cuts each once: values of the grid, and the gain."""
    sums = [np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (grad, hess)]
    r, c = np.arange(1, grad.shape[0]), np.arange(1, grad.shape[1])

    def block(s, rows, cols):
        top = s[r][:, c]
        all_rows, all_cols, all_ = s[-1][c][None, :], s[r][:, -1][:, None], s[-1, -1]
        return {(0, 0): top, (0, 1): all_cols - top, (1, 0): all_rows - top, (1, 1): all_ - all_cols - all_rows + top}[rows, cols]

    quarters = {q: (block(sums[0], *q), block(sums[1], *q)) for q in ((0, 0), (0, 1), (1, 0), (1, 1))}
    gains = sum(a**2 / (b + ridge) for a, b in quarters.values()) - sums[0][-1, -1] ** 2 / (sums[1][-1, -1] + ridge)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    value = np.empty_like(grad)
    for (p, q), (a, b) in quarters.items():
        value[slice(i + 1, None) if p else slice(0, i + 1), slice(j + 1, None) if q else slice(0, j + 1)] = a[i, j] / (b[i, j] + ridge)
    return value, float(gains[i, j])


def fit(x: np.ndarray, y: np.ndarray, max_bins: int = 32, rounds: int = 150, pairs: int = 6, pair_rounds: int = 60, rate: float = 0.1, ridge: float = 1.0) -> Gam:
    """Cyclic boosting: each round grows a tree of three leaves on each feature in turn; then the same on the pairs with the largest gain.

    Without rows, or with one class only, all scores are that class's smoothed share.
    """
    features = len(FEATURES) if not len(x) else x.shape[1]
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not len(x) or y.min() == y.max():
        return Gam([np.zeros(0)] * features, [np.zeros(1)] * features, [], [], start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) for j in range(features)]
    model = Gam(edges, [np.zeros(len(e) + 1) for e in edges], [], [], start)
    b = model.bins(x)
    total = np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            grad, hess = slopes()
            step, _ = _tree(np.bincount(b[:, j], grad, len(table)), np.bincount(b[:, j], hess, len(table)), 3, ridge)
            table += rate * step
            total += rate * step[b[:, j]]
    coarse = b // model.coarse
    sizes = [(len(e)) // model.coarse + 1 for e in edges]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[:, i] * sizes[j] + coarse[:, j], values, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    grad, hess = slopes()
    able = [j for j in range(features) if sizes[j] > 1]
    gains = [(_cross(grid(i, j, grad), grid(i, j, hess), ridge)[1], i, j) for n, i in enumerate(able) for j in able[n + 1 :]]
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            grad, hess = slopes()
            step, _ = _cross(grid(i, j, grad), grid(i, j, hess), ridge)
            table += rate * step
            total += rate * step[coarse[:, i], coarse[:, j]]
    return model


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """A model from at most `max_labelled` rows that may be learned from, in order of a hash of their ids.

    Rows without a label or text count for nothing; of several labels of one id the smallest holds.
    """
    known = labels.where(F.col(label).isNotNull() & may_learn(F.col(id_col))).groupBy(id_col).agg(F.min(label).cast("int").alias("_y"))
    picked = known.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)  # so many rows of two numbers at most
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).where(F.col(text_col).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, text_col):
            x = text_features(part.column(text_col))
            yield pa.RecordBatch.from_pydict({"_y": part.column("_y"), "_x": pa.array(list(x), pa.list_(pa.float64()))})

    table = rows.select("_y", text_col).mapInArrow(run, "_y int, _x array<double>").toPandas()
    table = table.assign(_key=table["_x"].map(tuple)).sort_values(["_key", "_y"])  # so that tasks' order doesn't count
    x = np.array(table["_x"].tolist(), dtype=np.float64).reshape(len(table), len(FEATURES))
    return fit(x, (table["_y"].to_numpy() == 1).astype(np.float64))


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs` with `quality_score` (0 to 1), by text alone.

    Null and empty texts are scored as empty ones. A column of that name is replaced.
    """
    rows = docs.select(carried(docs, "quality_score", needed=(id_col, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, text_col):
            scores = model.score(text_features(text_of(part, text_col)))
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(scores, pa.float64())], names=["_row", "quality_score"])

    schema = T.StructType([rows.schema["_row"], T.StructField("quality_score", T.DoubleType())])
    return with_columns_back(rows.mapInArrow(run, schema), "quality_score")


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs.select("doc_id", "text"), learn(docs, labels)).withColumnRenamed("quality_score", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
