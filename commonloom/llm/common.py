"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, `[\x20\x09-\x0D]`.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What a null id is keyed as inside joins.
NO_ID = -(2**63)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; `lower` is the quick way where the text is all ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def third(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """Null ids are not held out, and not learned from either (see `may_learn`)."""
    return F.coalesce(third(doc_id) == 1, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    return F.coalesce(third(doc_id) != 1, F.lit(False))


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells rows apart in joins: the id and, for repeated ids, a hash of the text.

    Rows equal in both are copies of one another and get the same answer.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return key.alias("_k1"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_k2")


def quoted(name: str) -> str:
    """A column's name for `F.col`, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def carried(df: DataFrame, *new: str, needed: tuple[str, ...] = ()) -> Column:
    """The columns of `df` as one struct `_row`, so that none clashes with an operator's own; without those that `new` ones replace, unless `needed`."""
    gone = {n.lower() for n in new} - {n.lower() for n in needed}
    return F.struct(*(F.col(quoted(c)) for c in df.columns if c.lower() not in gone)).alias("_row")


def with_columns_back(df: DataFrame, *new: Column | str) -> DataFrame:
    """The carried columns and new ones."""
    row = df.schema["_row"].dataType
    names = [c if isinstance(c, str) else df.select(c).columns[0] for c in new]
    return df.select(*(F.col("_row")[f.name].alias(f.name) for f in row if f.name not in names), *new)


def give_back() -> None:
    """Returns what a worker process has freed to the machine, so that one task's peak isn't held through the next ones."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of a batch, or of the rows it carries (see `carried`)."""
    return batch.column(name) if name in batch.schema.names else pc.struct_field(batch.column("_row"), [name])


def arrow_slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `most_bytes` of text, so that memory follows neither the batch size nor long rows' neighbours."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(text_of(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of all texts in order, and each text's number of words."""
    pieces = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    owner = pc.list_parent_indices(pieces)
    flat = pc.list_flatten(pieces)
    real = pc.greater(pc.binary_length(flat), 0)
    flat, owner = flat.filter(real), owner.filter(real)
    return flat, np.bincount(owner.to_numpy(), minlength=len(texts)).astype(np.int64)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """As `words_of`, with the words as numbers into an array of the distinct ones."""
    flat, counts = words_of(texts)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
    return x


#: Bytes of a word that are hashed for all words at once; longer words are hashed one by one.
_AT_ONCE = 48


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word, the same on every executor; byte by byte over all words that are long enough."""
    import xxhash

    words = distinct.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, dtype=np.uint8)
    length = np.diff(offsets)
    order = np.argsort(-length)
    start, length = offsets[:-1][order], length[order]
    value = length.astype(np.uint64) + np.uint64(0x27220A95FE1D83D5)
    with np.errstate(over="ignore"):
        for k in range(min(int(length[0]), _AT_ONCE)):
            n = int(np.searchsorted(-length, -k))  # words longer than k
            step = (value[:n] ^ data[start[:n] + k]) * np.uint64(0x9E3779B97F4A7C15)
            value[:n] = step ^ (step >> np.uint64(29))
    for i in range(int(np.searchsorted(-length, -_AT_ONCE))):
        value[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + length[i]].tobytes())
    out = np.empty(len(value), dtype=np.uint64)
    out[order] = mix64(value)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the cluster names in spark.checkpoint.dir.

    Only on a single machine (local mode, as in tests) may it be unset; a temporary folder is then taken.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` kept as files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows up to which a side of a join of a few numbers is broadcast (some tens of MB); beyond that both sides are shuffled.
SMALL = 1_000_000
#: Rows of one key from which on the key is joined by broadcast; there are at most a `HOT`-th as many such keys as rows.
HOT = 100_000


def join_keyed(large: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner", most: int | None = None) -> DataFrame:
    """Joins with a table of few narrow columns that has been kept (see `checkpointed`): broadcast if its counted rows are few, else shuffled."""
    return large.join(F.broadcast(keyed) if keyed.count() <= (SMALL if most is None else most) else keyed, on, how)


def _may_have(large: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
    """`large` with `_may`: false where a bitmap of hashed keys shows that `keyed` has no partner. The bitmap has at most `SMALL` rows of 256 bits, whatever the size of `keyed`."""
    place = F.pmod(F.xxhash64(*on), F.lit(max(SMALL, 1) * 256))
    part, bit = F.expr("_place div 64 % 4"), F.expr("shiftleft(1L, cast(_place % 64 as int))")
    bits = F.array(*(F.bit_or(F.when(part == p, bit).otherwise(F.lit(0).cast("long"))) for p in range(4)))
    bitmap = keyed.select(place.alias("_place")).groupBy(F.expr("_place div 256").alias("_slot")).agg(bits.alias("_bits"))
    placed = large.withColumn("_place", place).withColumn("_slot", F.expr("_place div 256"))
    known = placed.join(F.broadcast(bitmap), "_slot", "left")
    may = F.expr("coalesce(getbit(element_at(_bits, cast(_place div 64 % 4 + 1 as int)), cast(_place % 64 as int)) = 1, false)")
    return known.withColumn("_may", may).drop("_slot", "_place", "_bits")


def semi_keyed(large: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
    """The rows of a wide table that have a partner in a kept narrow one; rows without one are not shuffled, but for those that a bitmap can't tell."""
    if keyed.count() <= SMALL:
        return large.join(F.broadcast(keyed.select(*on)), on, "left_semi")
    return _may_have(large, keyed, on).where("_may").drop("_may").join(keyed.select(*on), on, "left_semi")


def join_wide(large: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
    """An inner join of a wide table with a kept narrow one that may have several rows a key; else as `semi_keyed`."""
    if keyed.count() <= SMALL:
        return large.join(F.broadcast(keyed), on)
    return _may_have(large, keyed, on).where("_may").drop("_may").join(keyed, on)


def attach_keyed(large: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
    """A left join with a kept table whose rows stand for few of `large`'s: only rows that have a partner are shuffled, and those that a bitmap can't tell."""
    if keyed.count() <= SMALL:
        keys = F.broadcast(keyed.select(*on))
        met, alone = large.join(keys, on, "left_semi"), large.join(keys, on, "left_anti")
    else:
        known = _may_have(large, keyed, on)
        met, alone = known.where("_may").drop("_may"), known.where("NOT _may").drop("_may")
    return met.join(keyed, on, "left").unionByName(alone, allowMissingColumns=True)


def mark_keyed(large: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
    """As `attach_keyed`, for a table of narrow rows, which is broadcast whole while it is small."""
    return large.join(F.broadcast(keyed), on, "left") if keyed.count() <= SMALL else attach_keyed(large, keyed, on)


def join_hot(large: DataFrame, keyed: DataFrame, on: list[str], times: str, how: str = "inner", wide: bool = False) -> DataFrame:
    """An inner or left join with a kept table of one row a key, whose column `times` counts the key's rows in `large`; broadcast while small, if its rows aren't `wide`.

    Beyond that the few keys with at least `HOT` rows are broadcast, so that none of them gathers its rows in one task.
    """
    if not wide and keyed.count() <= SMALL:
        return large.join(F.broadcast(keyed.drop(times)), on, how)
    hot = keyed.where(F.col(times) >= HOT)
    if not 0 < hot.count() <= max(SMALL, 1):
        return large.join(keyed.drop(times), on, how)
    hot = F.broadcast(hot.drop(times))
    cold = large.join(hot.select(*on), on, "left_anti").join(keyed.where(F.col(times) < HOT).drop(times), on, how)
    return large.join(hot, on).unionByName(cold)


def whole_units(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], wide: str, most_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by `keys` as batches of whole units, rows with equal keys, of about `most_bytes` of the column `wide`; and where units begin and the last ends."""

    def starts_of(batch: pa.RecordBatch) -> np.ndarray:
        fresh = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            fresh |= column[1:] != column[:-1]
        return np.flatnonzero(fresh) + 1

    def cut(parts: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        starts = np.concatenate([[0], starts_of(batch), [batch.num_rows]])
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(wide)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])[starts]
        at = 0
        while at < len(starts) - 1:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1)
            yield batch.slice(starts[at], starts[stop] - starts[at]), starts[at : stop + 1] - starts[at]
            at = stop

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield from cut(held)
            held = []
        starts = starts_of(batch)
        if len(starts):
            yield from cut([*held, batch.slice(0, starts[-1])])
            held = [batch.slice(starts[-1])]
        else:
            held.append(batch)
    if held:
        yield from cut(held)
    give_back()


def components(links: DataFrame) -> DataFrame:
    """The smallest number that can be reached from each end of the links `a, b`: rows `node, root` of nodes other than roots.

    Alternates the large-star and small-star steps of connected components until nothing changes;
    each is a minimum with map-side combination and a join of narrow rows, whose hubs adaptive execution splits.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("_m").alias("b")), F.struct("a", F.col("_m").alias("b")))).alias("_e"))
        edges = checkpointed(small.select("_e.a", "_e.b").where("a <> b").distinct())
