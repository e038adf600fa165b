"""Quality rules: repetition inside a document, from a suffix array of its words.

The suffix array is built by prefix doubling in numpy for a slice of documents at once; suffixes
of different documents never compare equal. Only suffixes that still share their class are sorted
again, and the ranks of all rounds give the longest common prefixes of neighbours. A suffix's
larger neighbour value is the longest substring from there that occurs twice; the spans of all
long enough ones are united, which covers each maximal repeated substring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from commonloom.llm.common import WHITE, arrow_slices, word_codes


def repeat_lengths(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest word sequence from there that also starts elsewhere in its document.

    Keeps four bytes a word for each doubling of the longest repeat, beside a few arrays of the words.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    key = doc * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    ends = np.repeat(np.cumsum(counts), counts)
    number = np.int32 if n < 1 << 31 else np.int64
    levels, step = [rank.astype(number)], 1
    shared = ~fresh
    shared[:-1] |= ~fresh[1:]
    active = order[shared]
    while len(active):
        after = active + step
        following = np.where(after < ends[active], rank[np.minimum(after, n)], -1)
        mine = rank[active]
        by = np.lexsort((following, mine))
        active, mine, following = active[by], mine[by], following[by]
        first = np.ones(len(active), dtype=bool)
        first[1:] = mine[1:] != mine[:-1]
        fresh = first.copy()
        fresh[1:] |= following[1:] != following[:-1]
        at = np.arange(len(active))
        place = mine + at - np.maximum.accumulate(np.where(first, at, 0))
        rank[active] = place[np.maximum.accumulate(np.where(fresh, at, 0))]
        levels.append(rank.astype(number))
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        active = active[shared]
        step *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank[:n]] = np.arange(n)
    near = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    left, right = suffixes[near], suffixes[near + 1]
    length = np.zeros(len(near), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + length, right + length
        inside = (a < n) & (b < n)
        same = inside & (levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)])
        length += same << k
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, left, length)
    np.maximum.at(longest, right, length)
    return longest


def covered(lengths: np.ndarray, least: int, size: int | None = None) -> np.ndarray:
    """Which words lie in a span that starts where `lengths` has `least` or more; `size`: the spans' length instead."""
    n = len(lengths)
    start = np.flatnonzero(lengths >= least)
    stop = start + (lengths[start] if size is None else size)
    edge = np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def quality_rules(
    docs: DataFrame, min_words: int = 50, max_window_percent: int = 50, min_repeat: int = 10, max_covered_percent: int = 25, max_longest: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id of each row, its counts (see `COLUMNS`) and verdicts.

    A document is kept unless it has under `min_words` words, more than `max_window_percent` of
    them in repeated 3-word windows, more than `max_covered_percent` in repeats of `min_repeat`
    words or more, or a repeat of over `max_longest` words. A null or empty text has no words
    and fails. Repeated rows each give a row; other columns are not read; an empty table gives
    an empty result. Texts are read whole; a very long one is a slice of its own, whose memory
    grows with its words (see `repeat_lengths`).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, text_col):
            texts = pc.fill_null(part.column(text_col), "")
            codes, distinct, n = word_codes(texts)
            lengths = repeat_lengths(codes, n)
            doc = np.repeat(np.arange(len(n)), n)
            longest = np.zeros(len(n), dtype=np.int64)
            np.maximum.at(longest, doc, lengths)
            repeat_words = _sums(covered(lengths, 3, 3), n)
            in_repeats = _sums(covered(lengths, min_repeat), n)
            chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
            failed = (n < min_words) | (100 * repeat_words > max_window_percent * n)
            repeats = (100 * in_repeats > max_covered_percent * n) | (longest > max_longest)
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: part.column(id_col),
                    "n_words": n,
                    "word_chars": _sums(chars[codes] if len(codes) else codes, n),
                    "n_symbols": pc.count_substring_regex(texts, "[#*$%&|<>]").cast(pa.int64()),
                    "n_dup_lines": pa.array([duplicate_lines(t) for t in texts.to_pylist()], pa.int64()),
                    "n_repeat_words": repeat_words,
                    "covered_words": in_repeats,
                    "longest_repeat": longest,
                    "base_failed": failed,
                    "kept": ~failed & ~repeats,
                }
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {COLUMNS}")


def op10(docs: DataFrame) -> DataFrame:
    return quality_rules(docs)
