"""Exact dedup by an exchange of Golomb-coded fingerprints.

Each slice of the input sends the owners of hash ranges its sorted distinct 48-bit fingerprints,
coded as Golomb-Rice differences, with one bit for those it holds twice itself. A group of copies
therefore costs one entry a slice, however large it is. Owners answer each slice with a bitmap of
the fingerprints that others hold too. Only rows so marked are suspects: their texts are shuffled,
grouped by the text itself (map-side combined), and so verified byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commonloom.llm.common import NO_ID, ascii_lower, checkpointed, join_hot, row_key, semi_keyed, shuffle_partitions

BITS = 48
#: Rows of a slice, at most; a slice is part of one input partition.
SLICE_BITS = 17
#: Fingerprints that one owner decodes, about.
OWNED = 4_000_000


def golomb_encode(values: np.ndarray, base: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct numbers from `base` on as (k, unary quotients, k-bit remainders) of their differences."""
    gaps = np.diff(values.astype(np.int64), prepend=base)
    k = max(0, int(gaps.mean()).bit_length() - 1)
    ends = np.cumsum((gaps >> k) + 1)
    unary = np.zeros(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 1
    rest = (gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes, base: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, dtype=np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.int64) << k
    if k:
        bits = np.unpackbits(np.frombuffer(rest, dtype=np.uint8))[: n * k].reshape(n, k).astype(np.int64)
        gaps += bits @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum(gaps) + base


def _range_start(owner: int, owners: int) -> int:
    return -(-(owner << BITS) // owners)


def _owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    starts = np.array([_range_start(i, owners) for i in range(owners)], dtype=np.int64)
    return np.searchsorted(starts, values, "right") - 1


def _send(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            src, fp = (batch.column(c).to_numpy() for c in ("_src", "_fp"))
            for s in np.unique(src):
                pieces.setdefault(int(s), []).append(fp[src == s])
        for s, parts in pieces.items():
            values, times = np.unique(np.concatenate(parts), return_counts=True)
            owner = _owner_of(values, owners)
            out: dict[str, list] = {c: [] for c in ("_owner", "_src", "_n", "_k", "_unary", "_rest", "_twice")}
            for o in np.unique(owner):
                mine = owner == o
                k, unary, rest = golomb_encode(values[mine], _range_start(int(o), owners))
                for c, v in zip(out, (int(o), s, int(mine.sum()), k, unary, rest, np.packbits(times[mine] > 1).tobytes()), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("_owner", pa.int32()), ("_src", pa.int64()), ("_n", pa.int32()), ("_k", pa.int32()), *((c, pa.binary()) for c in ("_unary", "_rest", "_twice"))]))

    return run


def _answer(owners: int):
    def run(sent: pd.DataFrame) -> pd.DataFrame:
        base = _range_start(int(sent["_owner"].iloc[0]), owners)
        values = [golomb_decode(n, k, u, r, base) for n, k, u, r in zip(sent["_n"], sent["_k"], sent["_unary"], sent["_rest"], strict=True)]
        twice = [np.unpackbits(np.frombuffer(t, dtype=np.uint8))[:n] for n, t in zip(sent["_n"], sent["_twice"], strict=True)]
        distinct, at = np.unique(np.concatenate(values), return_inverse=True)
        held = np.bincount(at, weights=1 + np.concatenate(twice), minlength=len(distinct)) > 1
        flags = np.split(held[at], np.cumsum(sent["_n"])[:-1])
        return pd.DataFrame({"_src": sent["_src"], "_owner": sent["_owner"], "_dup": [np.packbits(f).tobytes() for f in flags], "_n": sent["_n"]})

    return run


def _mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    values, at = np.unique(rows["_fp"].to_numpy(), return_inverse=True)
    answers = answers.sort_values("_owner")
    flags = [np.unpackbits(np.frombuffer(d, dtype=np.uint8))[:n] for n, d in zip(answers["_n"], answers["_dup"], strict=True)]
    suspect = np.concatenate(flags).astype(bool) if flags else np.zeros(len(values), dtype=bool)
    return rows.drop(columns=["_fp", "_src"]).assign(_suspect=suspect[at])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, `keep_id`, `group_size`, `kept`, `text_sha256` and `suspect`.

    Texts count as equal when they are after lower-casing A-Z; null counts as empty. The largest
    id of a group stays; null ids rank below all others, and a group with null ids only keeps them
    all. Rows repeated with the same id are counted each and marked alike. `suspect` is true where
    the fingerprint exchange found a second holder; only those rows' texts are compared. Columns
    other than the two named are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    k1, k2 = row_key(id_col, text_col)
    keyed = docs.select(k1, k2, text.alias("_text"))
    sha = F.sha2(F.col("_text").cast("binary"), 256)
    prints = keyed.select("_k1", "_k2", F.unhex(sha).alias("_sha"), F.shiftright(F.monotonically_increasing_id(), SLICE_BITS).alias("_src"))
    prints = checkpointed(prints.withColumn("_fp", F.conv(F.hex(F.substring("_sha", 1, BITS // 8)), 16, 10).cast("long")))
    owners = max(shuffle_partitions(spark), -(-prints.count() // OWNED))
    sent = prints.select("_src", "_fp").mapInArrow(_send(owners), "_owner int, _src long, _n int, _k int, _unary binary, _rest binary, _twice binary")
    answers = sent.groupBy("_owner").applyInPandas(_answer(owners), "_src long, _owner int, _dup binary, _n int")
    marked = checkpointed(prints.groupBy("_src").cogroup(answers.groupBy("_src")).applyInPandas(_mark, "_k1 long, _k2 long, _sha binary, _suspect boolean"))
    suspects = checkpointed(marked.where("_suspect").select("_k1", "_k2").distinct())
    groups = semi_keyed(keyed, suspects, ["_k1", "_k2"]).groupBy("_text").agg(F.max("_k1").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    groups = checkpointed(groups.where("_size > 1").select(F.unhex(sha).alias("_sha"), "_keep", "_size", F.col("_size").alias("_times")))
    found = join_hot(marked.where("_suspect"), groups, ["_sha"], "_times", "left").unionByName(marked.where("NOT _suspect"), allowMissingColumns=True)
    single = F.col("_size").isNull()
    kind = docs.schema[id_col].dataType

    def as_id(key):
        return F.nullif(key, F.lit(NO_ID)).cast(kind)

    return found.select(
        as_id(F.col("_k1")).alias(id_col),
        as_id(F.coalesce("_keep", "_k1")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("_k1") == F.col("_keep"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        F.col("_suspect").alias("suspect"),
    )


def op6(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
