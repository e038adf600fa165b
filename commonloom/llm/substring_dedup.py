"""Substring dedup: repeated passages, located by sharded Aho-Corasick automata.

Each window of words is filed under the smallest hash of the phrases in it, which equal windows
share; neighbouring windows with the same phrase form one passage. Only passages whose phrase was
met elsewhere go on, as text, to the shard of that phrase, equal ones added up on the way. A shard
confirms which windows recur and joins those that always follow each other to stretches. Each
distinct stretch is compiled into the shard's automaton once, from whichever passage has it, and
all passages are streamed through it: the automaton alone says where in them the stretches are.
What it finds is carried back to all documents that hold the passage.

A phrase with many distinct passages, such as a line that stands in a third of all documents, is
split: its windows are counted one by one in Spark, and those that recur are filed as passages
under their own hashes, so that a phrase never brings more than a bounded number to one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commonloom.llm.common import arrow_slices, attach_keyed, carried, checkpointed, join_hot, join_keyed, mix64, row_key, semi_keyed, text_of, with_columns_back, word_codes, word_hashes, words_of

#: Words of the phrases that windows are filed under, at most.
PHRASE = 8
#: Windows of a passage at most; more only follow each other under one phrase in periodic text.
MOST = 64
#: Letters of passages for which one automaton is compiled, about.
SHARD = 1 << 20
#: Distinct passages of a phrase up to which they go to its shard; beyond that they are split into windows.
CROWD = 1024


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the `n` words from each word on, of as many as there are such; built from hashes of powers of two."""
    total, power, length, out, used = len(hashes), hashes, 1, None, 0
    while True:
        if n & length:
            if out is None:
                out = power
            else:
                keep = max(0, total - used - length + 1)
                with np.errstate(over="ignore"):
                    out = mix64(out[:keep] * np.uint64(0xD6E8FEB86659FD93) + power[used : used + keep])
            used += length
        if length * 2 > n:
            return out[: max(0, total - n + 1)]
        with np.errstate(over="ignore"):
            power = mix64(power[: max(0, len(power) - length)] * np.uint64(0xA0761D6478BD642F) + power[length:])
        length *= 2


def passages(codes: np.ndarray, hashes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The passages of a slice of documents: document, first window, number of windows, phrase hash, content hash, and whether the phrase stands in it twice.

    `hashes`: of the distinct words that `codes` number.
    """
    n = len(codes)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none, none, none, none.astype(bool)
    phrase = max(1, min(PHRASE, window // 2))
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    value = gram_hashes(hashes[codes], phrase)
    reach = window - phrase + 1
    left = right = np.arange(len(value))
    done = 1
    least = value
    while done < reach:  # the minimum over `done` places, and its first and last place
        step = min(done, reach - done)
        a, b = least[:-step], least[step:]
        la, lb, ra, rb = left[:-step], left[step:], right[:-step], right[step:]
        left, right, least = np.where(b < a, lb, la), np.where(b <= a, rb, ra), np.minimum(a, b)
        done += step
    starts = np.flatnonzero(np.arange(len(least)) + window <= (first + counts)[doc[: len(least)]])
    if not len(starts):
        return none, none, none, none, none, none.astype(bool)
    low = least[starts]
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (low[1:] != low[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[starts][1:] != doc[starts][:-1])
    at = np.arange(len(starts))
    fresh |= (at - np.maximum.accumulate(np.where(fresh, at, 0))) % MOST == 0
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(starts)))
    end = starts[begin + size - 1]
    begin = starts[begin]
    return doc[begin], begin - first[doc[begin]], size, least[begin].view(np.int64), _contents(hashes[codes], begin, size + window - 1), left[begin] != right[end]


def _contents(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of the words of each stretch, from prefix sums of a polynomial modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(words), base, dtype=np.uint64))
        down = np.cumprod(np.full(len(words), pow(base, -1, 1 << 64), dtype=np.uint64))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * up)])
        return mix64((total[start + length] - total[start]) * down[start] + length.astype(np.uint64)).view(np.int64)


def _recurring(texts: list[str], times: np.ndarray, phrase: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """The word spans of each passage that recurring windows cover, found by an automaton of the distinct recurring stretches."""
    codes, distinct, counts = word_codes(pa.array(texts, pa.string()))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if len(codes) < window:
        return spans
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    value = gram_hashes(word_hashes(distinct)[codes], window)
    starts = np.flatnonzero(np.arange(len(value)) + window <= (first + counts)[owner[: len(value)]])
    mine = owner[starts]
    with np.errstate(over="ignore"):
        key = value[starts] ^ mix64(phrase[mine].astype(np.int64).view(np.uint64))
    _, at = np.unique(key, return_inverse=True)
    total = np.bincount(at, weights=times[mine])
    again = total[at] > 1
    starts, mine, at = starts[again], mine[again], at[again]
    if not len(starts):
        return spans
    # two windows belong to one stretch if neither is ever met without the other, so that no passage holds a part of a stretch
    follows = np.flatnonzero((starts[1:] == starts[:-1] + 1) & (mine[1:] == mine[:-1]))
    _, pair = np.unique(at[follows] * len(total) + at[follows + 1], return_inverse=True)
    met = np.bincount(pair, weights=times[mine[follows]])[pair] if len(pair) else np.zeros(0)
    fresh = np.ones(len(starts), dtype=bool)
    fresh[follows[(met == total[at[follows]]) & (met == total[at[follows + 1]])] + 1] = False
    begin = np.flatnonzero(fresh)
    stop = starts[np.append(begin[1:], len(starts)) - 1] + window
    _, once = np.unique(at[begin], return_index=True)
    begin, stop = begin[once], stop[once]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    split: dict[int, list[str]] = {}
    for i, lo, hi in zip(mine[begin].tolist(), starts[begin].tolist(), stop.tolist(), strict=True):
        words = split.setdefault(i, texts[i].split(" "))
        automaton.add_word(" " + " ".join(words[lo - first[i] : hi - first[i]]) + " ", hi - lo)
    automaton.make_automaton()
    for i, text in enumerate(texts):
        found = [(end, n) for end, n in automaton.iter(f" {text} ")]
        if not found:
            continue
        ends = np.cumsum(np.array([len(w) + 1 for w in split.get(i) or text.split(" ")]))  # where the space after each word stands
        last = np.searchsorted(ends, [end for end, _ in found]) + 1
        for lo, hi in sorted(zip((last - [n for _, n in found]).tolist(), last.tolist(), strict=True)):
            if spans[i] and lo <= spans[i][-1][1]:
                spans[i][-1] = (spans[i][-1][0], max(hi, spans[i][-1][1]))
            else:
                spans[i].append((lo, hi))
    return spans


def _search(window: int):
    """Over distinct passages sorted by phrase: those with recurring windows, and the word spans these cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, int], tuple[int, int, str, int]] = {}  # a repeated row's passages come repeatedly
        size, last = 0, None

        def close() -> pa.RecordBatch:
            held = list(rows.values())
            spans = _recurring([h[2] for h in held], np.array([h[3] for h in held]), np.array([h[0] for h in held], dtype=np.int64), window)
            keep = [(h[0], h[1], s, h[3]) for h, s in zip(held, spans, strict=True) if s]
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keep], pa.int64()),
                    pa.array([k[1] for k in keep], pa.int64()),
                    pa.array([[x for span in k[2] for x in span] for k in keep], pa.list_(pa.int32())),
                    pa.array([k[3] for k in keep], pa.int64()),
                ],
                names=["_phrase", "_hash", "_spans", "_times"],
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("_phrase", "_hash", "_passage", "_times")), strict=True):
                if size >= SHARD and row[0] != last:
                    yield close()
                    size = 0
                rows[row[:2]] = row
                size, last = size + len(row[2]), row[0]
        if rows:
            yield close()

    return run


def _without_crowds(source: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """`places` with the passages of phrases that have more than `CROWD` distinct ones replaced by their recurring windows, each under a phrase of its own."""
    counted = places.select("_phrase", "_hash").distinct().groupBy("_phrase").agg(F.count(F.lit(1)).alias("_n"))
    crowds = checkpointed(counted.where(F.col("_n") > CROWD).select("_phrase"))
    if crowds.isEmpty():
        return places

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "_text"):
            codes, distinct, counts = word_codes(part.column("_text"))
            hashes = word_hashes(distinct)
            doc, start, size, phrase, _, _ = passages(codes, hashes, counts, window)
            ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(size)])
            begin = (np.cumsum(counts) - counts)[doc] + start
            at = np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])
            windows = gram_hashes(hashes[codes], window).view(np.int64)[at] if len(at) else np.zeros(0, dtype=np.int64)
            keys = {c: part.column(c).take(pa.array(doc)) for c in ("_k1", "_k2")}
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(windows))
            yield pa.RecordBatch.from_pydict({"_phrase": phrase, "_windows": lists, **keys, "_start": start.astype(np.int32)})

    held = source.mapInArrow(split, "_phrase long, _windows array<long>, _k1 long, _k2 long, _start int")
    held = checkpointed(join_keyed(held, crowds, ["_phrase"], "left_semi"))
    single = held.select("_phrase", "_k1", "_k2", "_start", F.posexplode("_windows").alias("_at", "_hash"))
    single = single.select(F.xxhash64("_phrase", "_hash").alias("_phrase"), "_hash", "_k1", "_k2", (F.col("_start") + F.col("_at")).alias("_start"), F.lit(1).alias("_size"))
    again = checkpointed(single.groupBy("_phrase", "_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_phrase", "_hash"))
    recurring = checkpointed(join_keyed(single, again, ["_phrase", "_hash"]))
    return join_keyed(places, crowds, ["_phrase"], "left_anti").unionByName(recurring)


def filed_passages(source: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The places of passages that may have repeats, and the distinct passages as text with the number of their places."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "_text"):
            codes, distinct, counts = word_codes(part.column("_text"))
            doc, start, size, phrase, content, twice = passages(codes, word_hashes(distinct), counts, window)
            keys = {c: part.column(c).take(pa.array(doc)) for c in ("_k1", "_k2")}
            yield pa.RecordBatch.from_pydict({"_phrase": phrase, "_hash": content, "_twice": twice, **keys, "_start": start.astype(np.int32), "_size": size.astype(np.int32)})

    filed = source.mapInArrow(file, "_phrase long, _hash long, _twice boolean, _k1 long, _k2 long, _start int, _size int")
    again = filed.groupBy("_phrase").agg(F.count(F.lit(1)).alias("_n"), F.max("_twice").alias("_any")).where("_n > 1 OR _any").select("_phrase")
    places = checkpointed(filed.select("_phrase", "_hash", "_k1", "_k2", "_start", "_size").join(again, "_phrase"))
    places = _without_crowds(source, places, window)
    place = F.struct("_k1", "_k2", "_start", "_size")
    distinct = places.groupBy("_phrase", "_hash").agg(F.count(F.lit(1)).alias("_times"), F.min(place).alias("_at"))
    wanted = distinct.groupBy("_at._k1", "_at._k2").agg(F.collect_list(F.struct("_phrase", "_hash", "_times", "_at._start", "_at._size")).alias("_plan"))
    wanted = checkpointed(wanted)  # of equal passages one is copied

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "_text", 1 << 20):
            flat, counts = words_of(part.column("_text"))
            words, first = flat.to_pylist(), (np.cumsum(counts) - counts).tolist()
            out: dict[str, list] = {c: [] for c in ("_phrase", "_hash", "_times", "_passage")}
            for i, plan in enumerate(part.column("_plan").to_pylist()):
                for p in plan:
                    lo = first[i] + p["_start"]
                    for c, v in zip(out, (p["_phrase"], p["_hash"], p["_times"], " ".join(words[lo : lo + p["_size"] + window - 1])), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("_phrase", pa.int64()), ("_hash", pa.int64()), ("_times", pa.int64()), ("_passage", pa.string())]))

    holders = semi_keyed(source, wanted, ["_k1", "_k2"])
    copied = holders.join(wanted, ["_k1", "_k2"]).mapInArrow(copy, "_phrase long, _hash long, _times long, _passage string")
    return places, copied


def repeated_spans(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `_k1, _k2` (see `row_key`) of texts with repeats, and `removed`: their sorted, disjoint word spans as from, to, from, to, ..."""
    source = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    places, copied = filed_passages(source, window)
    sharded = copied.repartition("_phrase").sortWithinPartitions("_phrase")
    found = checkpointed(sharded.mapInArrow(_search(window), "_phrase long, _hash long, _spans array<int>, _times long"))
    back = join_hot(places.select("_phrase", "_hash", "_k1", "_k2", "_start"), found, ["_phrase", "_hash"], "_times", wide=True)
    moved = back.select("_k1", "_k2", F.transform("_spans", lambda x: x + F.col("_start")).alias("_spans")).distinct()
    return checkpointed(moved.groupBy("_k1", "_k2").agg(F.collect_list("_spans").alias("removed")))


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", new_text: str = "kept_text") -> DataFrame:
    """All rows and columns of `docs` with `n_words`, `n_removed` and the words that are left, joined by one space.

    Every word covered by `window` consecutive words that also start anywhere else goes, in all
    places. Null and empty texts have no words and give an empty text. Rows repeated whole repeat
    each other; of rows that share an id each text counts. Columns named as the new ones are
    replaced; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, window, id_col, text_col)
    rows = docs.select(carried(docs, "n_words", "n_removed", new_text, needed=(id_col, text_col)), *row_key(id_col, text_col))
    joined = attach_keyed(rows, spans, ["_k1", "_k2"]).select("_row", "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, text_col):
            flat, counts = words_of(text_of(part, text_col))
            first = np.cumsum(counts) - counts
            edge = np.zeros(len(flat) + 1, dtype=np.int64)
            for i, lists in enumerate(part.column("removed").to_pylist()):
                for spans in lists or ():
                    np.add.at(edge, first[i] + np.array(spans[::2]), 1)
                    np.add.at(edge, first[i] + np.array(spans[1::2]), -1)
            stay = np.cumsum(edge)[:-1] == 0
            doc = np.repeat(np.arange(len(counts)), counts)
            left = np.bincount(doc[stay], minlength=len(counts))
            ends = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
            texts = pc.binary_join(pa.ListArray.from_arrays(ends, flat.filter(pa.array(stay))), " ")
            yield pa.RecordBatch.from_pydict({"_row": part.column("_row"), "n_words": counts, "n_removed": counts - left, new_text: texts})

    schema = T.StructType([joined.schema["_row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(new_text, T.StringType())])
    return with_columns_back(joined.mapInArrow(run, schema), "n_words", "n_removed", new_text)


def op8(docs: DataFrame) -> DataFrame:
    found = substring_dedup(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
