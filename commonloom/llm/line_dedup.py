"""Line dedup (native): only DataFrame and SQL functions.

Hashes of long lines are range-partitioned with document and position as further keys, so that
one line held by a third of all documents still spreads over many partitions. Within a partition
a sorted stream marks the first occurrence in each document; those are counted with map-side
combination. What is returned is a keep bitmap for each document in 64-line words, of which only
those that lose a line are stored, and no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commonloom.llm.common import WHITE, ascii_lower, attach_keyed, carried, checkpointed, join_hot, row_key, with_columns_back


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep bitmaps of the rows that lose lines: `_k1, _k2` (see `row_key`), `n_dropped`, `keep_words`.

    `keep_words` maps the number of a 64-line word to its bits, 1 for a line that stays; words
    that aren't listed keep all lines. A null or empty text is one empty line, which never goes.
    Documents are told apart by id; rows that share an id count as one document. A line
    repeated within the document that keeps it stays there as often as it stands. Null ids rank
    below all others. An empty table gives an empty result; other columns are never read.
    """
    rows = docs.select(*row_key(id_col, text_col), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("_lines"))
    lines = rows.select("_k1", "_k2", F.posexplode("_lines").alias("_pos", "_line")).where(F.char_length("_line") >= min_chars)
    keyed = lines.select("_k1", "_k2", "_pos", ascii_lower(F.btrim("_line", F.lit(WHITE))).alias("_key")).where(F.char_length("_key") >= min_chars)
    hashed = keyed.select(F.xxhash64(F.lit(1), "_key").alias("_h1"), F.xxhash64(F.lit(2), "_key").alias("_h2"), "_k1", "_k2", "_pos")
    hashed = checkpointed(hashed)
    ranged = hashed.repartitionByRange("_h1", "_h2", F.col("_k1").desc())
    in_doc = W.partitionBy("_h1", "_h2", "_k1").orderBy("_pos", "_k2")
    first = ranged.withColumn("_nth", F.row_number().over(in_doc)).where("_nth = 1")
    common = first.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_docs"), F.max("_k1").alias("_keeper")).where(F.col("_docs") >= min_docs)
    gone = join_hot(hashed, checkpointed(common), ["_h1", "_h2"], "_docs").where("_k1 <> _keeper").select("_k1", "_k2", "_pos")
    words = gone.groupBy("_k1", "_k2", F.expr("_pos div 64").cast("int").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, _pos % 64))").alias("_bits"))
    return words.groupBy("_k1", "_k2").agg(
        F.sum(F.bit_count("_bits")).alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("_word", F.bitwise_not("_bits").alias("_bits")))).alias("keep_words"),
    )


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", new_text: str = "kept_text") -> DataFrame:
    """All rows and columns of `docs` with `n_lines`, `n_dropped`, `keep_words` and the text that is left.

    `keep_words` is null where all lines stay; only texts that lose lines are shuffled. Columns of those names in `docs` are replaced.
    """
    bitmaps = checkpointed(line_bitmaps(docs, min_chars, min_docs, id_col, text_col))
    rows = docs.select(carried(docs, "n_lines", "n_dropped", "keep_words", new_text, needed=(id_col, text_col)), *row_key(id_col, text_col))
    joined = attach_keyed(rows, bitmaps, ["_k1", "_k2"])
    whole = F.coalesce(F.col("_row")[text_col], F.lit(""))
    lines = F.split(whole, "\n")

    def stays(_line, at):
        word = F.try_element_at(F.col("keep_words"), F.floor(at / 64).cast("int"))
        return F.coalesce(F.getbit(word, at % 64) == 1, F.lit(True))

    left = F.when(F.col("keep_words").isNull(), whole).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    dropped = F.coalesce("n_dropped", F.lit(0)).cast("long")
    return with_columns_back(joined, F.size(lines).cast("long").alias("n_lines"), dropped.alias("n_dropped"), "keep_words", left.alias(new_text))


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns, from `line_dedup` with its production parameters."""
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
