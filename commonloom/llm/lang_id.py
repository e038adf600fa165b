"""Language identification: unigram models over pieces, summed over all segmentations.

The pieces are all those of a fixed public vocabulary, in lower case. For each language the pieces'
probabilities are estimated by expectation maximisation over all words of a bounded sample of
labelled documents, and a word's probability is the sum over all ways to cut it into pieces, by a
forward algorithm that runs over many words at once and keeps its sums scaled, so that words may be
of any length. A document's score is the posterior of its language over all its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commonloom.llm.common import arrow_slices, checkpointed, held_out, join_keyed, may_learn, mix64, word_codes

UNKNOWN = "und"
#: Letters whose pieces are looked up at once, and words of so many letters together; they bound memory only.
BLOCK, TOGETHER = 1024, 1_000_000
#: Words that a worker remembers the scores of, and their letters; beyond that it starts afresh.
REMEMBERED, LETTERS = 300_000, 8_000_000


class Vocabulary:
    """Pieces in lower case, numbered from 1 (0: any other single letter), found by the hash of their letters."""

    SLOTS = 19

    def __init__(self, names: list[str]) -> None:
        self.size, self.longest = len(names), max(map(len, names))
        self.keys = np.zeros(1 << self.SLOTS, dtype=np.uint64)
        self.values = np.full(1 << self.SLOTS, -1, dtype=np.int32)
        self.probes = 1
        for value, name in enumerate(names, 1):
            key = np.zeros(1, dtype=np.uint64)
            for letter in name:
                key = self.longer(key, np.array([ord(letter)], dtype=np.uint64))
            key, slot = self._slot(key)
            at, tries = int(slot[0]), 1
            while self.values[at] >= 0:
                at, tries = (at + 1) % len(self.keys), tries + 1
            self.keys[at], self.values[at] = key[0], value
            self.probes = max(self.probes, tries)

    @staticmethod
    def longer(hashes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (hashes + letters + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def _slot(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = mix64(hashes)
        return keys, (keys >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, or -1."""
        keys, slots = self._slot(hashes)
        found = np.full(keys.shape, -1, dtype=np.int32)
        for step in range(self.probes):
            at = (slots + step) % len(self.keys)
            found = np.where(self.keys[at] == keys, self.values[at], found)
        return found

    def lattice(self, letters: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """For each word, each start from `lo` to `hi` and each length: the piece there (-1: none)."""
        words, n = letters.shape
        grid = np.full((words, hi - lo, self.longest), -1, dtype=np.int32)
        hashes = np.zeros((words, hi - lo), dtype=np.uint64)
        for k in range(1, min(self.longest, n - lo) + 1):
            starts = min(hi, n - k + 1) - lo
            hashes = self.longer(hashes[:, :starts], letters[:, lo + k - 1 : lo + k - 1 + starts])
            grid[:, :starts, k - 1] = self.find(hashes)
        grid[:, :, 0] = np.maximum(grid[:, :, 0], 0)
        return grid


@lru_cache(maxsize=2)
def pieces(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))}
    return Vocabulary(sorted(n for n in names if n))


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length at once, with the mark of a word's begin: their places in `words`, and their letters."""
    lengths: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        lengths.setdefault(len(w) + 1, []).append(i)
    for n, places in lengths.items():
        step = max(1, min(8_000, TOGETHER // n))
        for a in range(0, len(places), step):
            some = places[a : a + step]
            yield np.array(some), np.array(["▁" + words[i] for i in some], dtype=f"<U{n}").view(np.uint32).reshape(len(some), n).astype(np.uint64)


def _forward(letters: np.ndarray, vocabulary: Vocabulary, chance: np.ndarray, every: bool = False, back: bool = False) -> np.ndarray:
    """For each word and language the log of the summed probability of all segmentations; with `every`, of those up to each end (first axis), or `back` from each begin on.

    `chance`: piece by language, last row 0. Sums over the last few ends are kept as numbers, scaled to their maximum from time to time.
    """
    words, n = letters.shape
    most = vocabulary.longest
    recent, scale = np.zeros((words, most, chance.shape[1])), np.zeros((words, chance.shape[1]))
    recent[:, 0] = 1
    logs = np.zeros((n + 1, words, chance.shape[1])) if every else None
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        first, last = (n - hi, n - lo) if back else (max(0, lo - most + 1), hi)
        grid = vocabulary.lattice(letters, first, last)
        for end in range(lo + 1, hi + 1):
            k = np.arange(1, min(most, end) + 1)
            pieces = grid[:, n - end - first, k - 1] if back else grid[:, end - k - first, k - 1]
            new = np.einsum("wkl,wkl->wl", chance[pieces], recent[:, (end - k) % most])
            recent[:, end % most] = new
            if every:
                logs[end] = np.log(new) + scale
            if not end % 8:
                top = recent.max(axis=1)
                recent /= top[:, None]
                scale += np.log(top)
    return logs if every else np.log(recent[:, n % most]) + scale


@dataclass
class LanguageModel:
    languages: list[str]
    chance: np.ndarray  # piece by language, with a last row of zeros for what is no piece
    path: str

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The log probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        for at, letters in _by_length(words):
            out[at] = _forward(letters, pieces(self.path), self.chance)
        return out


def _expect(words: list[str], times: np.ndarray, vocabulary: Vocabulary, chance: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of words seen `times` often."""
    uses = np.zeros(len(chance))
    for at, letters in _by_length(words):
        n = letters.shape[1]
        ahead = _forward(letters, vocabulary, chance, every=True)[:, :, 0].T
        behind = _forward(letters, vocabulary, chance, every=True, back=True)[::-1, :, 0].T
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            grid = vocabulary.lattice(letters, lo, hi)
            for k in range(1, min(vocabulary.longest, n - lo) + 1):
                stop = min(hi, n - k + 1)
                piece = grid[:, : stop - lo, k - 1]
                part = np.exp(ahead[:, lo:stop] + behind[:, lo + k : stop + k] - ahead[:, n:]) * times[at][:, None]
                uses += np.bincount(np.where(piece < 0, len(uses) - 1, piece).ravel(), (part * chance[piece, 0]).ravel(), len(uses))
    uses[-1] = 0
    return uses


def fit(counts: dict[str, dict[str, int]], path: str, rounds: int = 3, prior: float = 0.05) -> LanguageModel:
    """Piece probabilities by expectation maximisation from each language's word counts; `prior` is added to each use."""
    vocabulary = pieces(path)
    size = vocabulary.size + 2
    languages = sorted(counts)
    chance = np.zeros((size, len(languages)))
    for column, language in enumerate(languages):
        words = sorted(counts[language])
        times = np.array([counts[language][w] for w in words], dtype=np.float64)
        guess = np.zeros((size, 1))
        guess[:-1] = 1 / size
        for _ in range(rounds):
            uses = _expect(words, times, vocabulary, guess) + prior
            uses[-1] = 0
            guess[:, 0] = uses / uses.sum()
        chance[:, column] = guess[:, 0]
    chance[0] = 1e-6  # letters outside the vocabulary tell nothing
    return LanguageModel(languages, chance, path)


def learn(docs: DataFrame, path: str | None = None, max_docs: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from all words of at most `max_docs` whole documents of each language that may be learned from, those with the smallest hashes of their ids.

    Rows with a null language or text count for nothing; a document repeated counts as often as it stands.
    """
    path = path or vocabulary_path()
    fit_for = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & may_learn(F.col(id_col)))
    fit_for = fit_for.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    counts = checkpointed(fit_for.groupBy("_lang").agg(F.count(F.lit(1)).alias("_rows")))
    span = 1 << 32
    # about four times as many as are wanted are left of a large language, so that no task sorts more
    some = join_keyed(fit_for.withColumn("_hash", F.pmod(F.xxhash64("_id"), F.lit(span))), counts, ["_lang"]).where(F.col("_hash") * F.col("_rows") <= F.lit(4.0 * max_docs * span))
    order = W.partitionBy("_lang").orderBy("_hash", "_id")
    picked = some.select("_id", "_lang", "_hash").distinct().withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= max_docs)
    rows = join_keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")), checkpointed(picked.select("_id", "_lang")), ["_id", "_lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "_text"):
            codes, distinct, n = word_codes(pc.utf8_lower(pc.fill_null(part.column("_text"), "")))
            language = part.column("_lang").dictionary_encode()
            of = np.repeat(language.indices.to_numpy(), n)
            seen, times = np.unique(of.astype(np.int64) * (len(distinct) + 1) + codes, return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {"_lang": language.dictionary.take(pa.array(seen // (len(distinct) + 1))), "_word": distinct.take(pa.array(seen % (len(distinct) + 1))), "_n": times.astype(np.int64)}
            )

    words = rows.select("_lang", "_text").mapInArrow(run, "_lang string, _word string, _n long").groupBy("_lang", "_word").agg(F.sum("_n").alias("_n"))
    table = words.toPandas()
    return fit({lang: dict(zip(g["_word"], g["_n"], strict=True)) for lang, g in table.groupby("_lang")}, path)


class _Scorer:
    """Remembers the scores of words within a worker."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.letters = model, 0
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def scores(self, words: list[str]) -> np.ndarray:
        place = self.place
        new = [w for w in words if w not in place]
        self.letters += sum(map(len, new))
        if place and (len(place) + len(new) > REMEMBERED or self.letters > LETTERS):
            place.clear()
            self.table, new = self.table[:0], words
            self.letters = sum(map(len, new))
        if new:
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.word_scores(new)])
        return self.table[[place[w] for w in words]]


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each row with `lang_pred` and `score`, from the text alone.

    Without text or without any letter the answer is `und` with score 0; so it is for all rows if
    no language was learned. Of languages with the same score the first by name is taken. Words of
    any length are scored whole, in time in proportion to their letters. Repeated rows each give a
    row; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for part in arrow_slices(batches, text_col):
            texts = pc.utf8_lower(pc.fill_null(part.column(text_col), ""))
            lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            codes, distinct, n = word_codes(texts)
            best, sure = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
            if model.languages:
                total = np.zeros((len(texts), len(model.languages)))
                if len(codes):
                    doc = np.repeat(np.arange(len(n)), n)
                    scores = scorer.scores(distinct.to_pylist())
                    for j in range(total.shape[1]):
                        total[:, j] = np.bincount(doc, scores[codes, j], len(n))
                chance = np.exp(total - total.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                best = np.where(lettered, chance.argmax(axis=1), best)
                sure = np.where(lettered, chance.max(axis=1), 0.0)
            yield pa.RecordBatch.from_pydict({id_col: part.column(id_col), "lang_pred": pa.array(names[best], pa.string()), "score": sure})

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def op1(docs: DataFrame) -> DataFrame:
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
