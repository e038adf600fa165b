"""Byte-pair encoding by speculation and verification.

Greedy longest match proposes tokens for each distinct word of a batch. A proposal is what the
merges give if each token is what its own bytes merge to and no pair of neighbours would have
merged across their border; both are tested for all distinct tokens and pairs of a batch at once,
in numpy. Only words that fail are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from commonloom.llm.common import arrow_slices

#: Fixed value: how the vocabulary's authors split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.iinfo(np.int32).max
#: Bytes up to which a word is merged by plain search.
SHORT = 48
#: Distinct words that a worker remembers; beyond that it starts afresh.
REMEMBERED = 400_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies, by the published rule."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def newer_letters() -> str:
    """Letters and numbers of `regex` that the tokenizers library's older tables don't know as such, as ranges of a character class.

    Only those can differ that Python's own table doesn't have yet, so few are asked about.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    unassigned = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn")
    found = [c for kind, first in ((r"\p{L}", "a"), (r"\p{N}", "1")) for c in regex.findall(kind, unassigned) if len(split(first + c)) > 1]
    return "".join(f"\\U{ord(c):08x}" for c in found)


class Bpe:
    """A byte-level BPE vocabulary file, with tables for checking proposals."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {b: i for i, b in self.bytes_of.items()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.bytes_of.update({i: t.encode() for t, i in self.specials.items()})
        names = spec["model"]["vocab"]
        size = max(self.bytes_of) + 1
        self.size = size
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            left, right, whole = names[a], names[b], names[a + b]
            self.merge[left, right] = (rank, whole)
            made.setdefault(whole, (left, right, rank))
        keys = np.array([a * size + b for a, b in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merge.values()], dtype=np.int32)[order]
        self.left_of = np.full(size, -1, dtype=np.int32)
        self.right_of = np.full(size, -1, dtype=np.int32)
        self.rank_of = np.full(size, -1, dtype=np.int32)
        for whole, (left, right, rank) in made.items():
            self.left_of[whole], self.right_of[whole], self.rank_of[whole] = left, right, rank
        self.own = np.full(size, -1, dtype=np.int8)  # does a token's text merge to it? -1: not yet known
        self.lengths = np.zeros(size, dtype=np.int64)
        for i, b in self.bytes_of.items():
            self.lengths[i] = len(b)
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.reach: dict[bytes, int] = {}  # the longest token that begins with two bytes
        for b in self.ids:
            self.reach[b[:2]] = max(self.reach.get(b[:2], 1), len(b))

    @cached_property
    def newer(self) -> regex.Pattern | None:
        return regex.compile(f"[{newer_letters()}]") if newer_letters() else None

    @cached_property
    def careful(self) -> regex.Pattern:
        """The splitting pattern without the newer letters and numbers."""
        newer = newer_letters()
        old = {kind: rf"[\p{{{kind}}}--[{newer}]]" for kind in "LN"}
        other = rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]"
        return regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", other).replace(r"\p{L}+", f"{old['L']}+").replace(r"\p{N}+", f"{old['N']}+"), regex.V1)

    def pieces(self, text: str) -> list[str]:
        """The words of a text that merges don't cross; special tokens stand alone."""
        split = self.split
        try:
            text.encode("latin-1")  # the quick way to see that no letter is new
        except UnicodeEncodeError:
            if self.newer is not None and self.newer.search(text):
                split = self.careful
        if self.special is None or not any(s in text for s in self.specials):
            return split.findall(text)
        out: list[str] = []
        for part in self.special.split(text):
            if part in self.specials:
                out.append(part)
            else:
                out += split.findall(part)
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match; single bytes are always in the vocabulary."""
        found = self.ids.get(word)
        if found is not None:
            return [found]
        out, at, n, ids, reach = [], 0, len(word), self.ids, self.reach
        while at < n:
            for stop in range(min(n, at + reach.get(word[at : at + 2], 1)), at, -1):
                found = ids.get(word[at:stop])
                if found is not None:
                    out.append(found)
                    at = stop
                    break
        return out

    def merge_exactly(self, word: bytes) -> list[int]:
        """All merges in order of rank, leftmost first: by plain search in short words, with a heap over a linked list in long ones."""
        token = [self.byte_ids[b] for b in word]
        if len(token) <= SHORT:
            merge, none = self.merge.get, (NEVER, -1)
            found = [merge(pair, none) for pair in zip(token, token[1:], strict=False)]
            while found:
                best = min(found)
                if best[1] < 0:
                    break
                i = found.index(best)
                token[i : i + 2] = [best[1]]
                del found[i]
                if i:
                    found[i - 1] = merge((token[i - 1], token[i]), none)
                if i < len(found):
                    found[i] = merge((token[i], token[i + 1]), none)
            return token
        after, before = [*range(1, len(token)), -1], [*range(-1, len(token) - 1)]
        heap = [(*self.merge[pair], i, pair) for i, pair in enumerate(zip(token, token[1:], strict=False)) if pair in self.merge]
        heap = [(rank, i, pair, whole) for rank, whole, i, pair in heap]
        heapq.heapify(heap)
        while heap:
            _, i, pair, whole = heapq.heappop(heap)
            j = after[i]
            if token[i] != pair[0] or j < 0 or token[j] != pair[1]:
                continue
            token[i], token[j] = whole, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (got := self.merge.get((token[a], token[b]))):
                    heapq.heappush(heap, (got[0], a, (token[a], token[b]), got[1]))
        return [t for t in token if t >= 0]

    def own_text(self, tokens: np.ndarray) -> np.ndarray:
        """Which tokens are what their own bytes merge to."""
        for t in np.unique(tokens[self.own[tokens] < 0]):
            self.own[t] = self.merge_exactly(self.bytes_of[int(t)]) == [int(t)]
        return self.own[tokens] == 1

    def _edge(self, tokens: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that hold the outermost byte as merging goes on, and the ranks that end each; last is the token itself, never ended."""
        chain, ends = [tokens], [np.full(len(tokens), NEVER, dtype=np.int32)]
        while True:
            inner = part[chain[-1]]
            if (inner < 0).all():
                break
            stop = inner < 0
            ends.append(np.where(stop, ends[-1], self.rank_of[chain[-1]]))
            chain.append(np.where(stop, chain[-1], inner))
        return np.stack(chain[::-1]), np.stack(ends[::-1])

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of neighbours: true where merging never joins what lies on both sides of the border.

        Goes through time: at each step the tokens at the border meet until the earlier of them is
        merged away from it; they'd join if their pair's rank comes before that. Of equal ranks the
        leftmost merge comes first.
        """
        lefts, left_ends = self._edge(left, self.right_of)
        rights, right_ends = self._edge(right, self.left_of)
        n = len(left)
        every = np.arange(n)
        i, j = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        apart = np.ones(n, dtype=bool)
        for _ in range(len(lefts) + len(rights)):
            x, y, x_end, y_end = lefts[i, every], rights[j, every], left_ends[i, every], right_ends[j, every]
            key = x.astype(np.int64) * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            apart &= ~((rank < x_end) & (rank <= y_end) & (rank != NEVER))
            i += (x_end <= y_end) & (i < len(lefts) - 1)
            j += (y_end < x_end) & (j < len(rights) - 1)
        return apart

    def learn(self, words: list[str]) -> None:
        """Ids of words not yet known: proposals for all, checked together, and exact merging for those that fail."""
        raw = [w.encode() for w in words]
        guesses = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, guesses), dtype=np.int64, count=len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), dtype=np.int32, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        fine = np.bincount(owner, weights=~self.own_text(flat), minlength=len(words)) == 0
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inside):
            pairs, back = np.unique(flat[inside].astype(np.int64) * self.size + flat[inside + 1], return_inverse=True)
            apart = self.stay_apart((pairs // self.size).astype(np.int32), (pairs % self.size).astype(np.int32))
            fine[owner[inside[~apart[back]]]] = False
        for w, r, g, ok in zip(words, raw, guesses, fine, strict=True):
            self.known[w] = array("I", g if ok else self.merge_exactly(r)).tobytes()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if not self.known:
            self.known.update({s: array("I", [i]).tobytes() for s, i in self.specials.items()})
        new = list(set().union(*pieces) - self.known.keys())
        if new:
            self.learn(new)
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in p]), dtype=np.uint32) for p in pieces]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return ""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.flat[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_ids(batches: Iterator[pa.RecordBatch], text_col: str, path: str) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    """Slices of the batches with their texts and ids; null texts are empty."""
    coder = bpe(path)
    for part in arrow_slices(batches, text_col, 2 << 20):
        texts = [t or "" for t in part.column(text_col).to_pylist()]
        yield part, texts, coder.encode_batch(texts)


def bpe_round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Each row's id with `ids` (array of int), `decoded`, `n_tokens`, `ids_sha256` and `decoded_sha256`.

    Whole texts are encoded, special tokens' strings as those tokens. A null text counts as empty
    and has no ids. Repeated rows each give a row; other columns are not read; an empty table
    gives an empty result. Without `with_ids`, the ids and the decoded text are left out.
    """
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()
    wide = "ids array<int>, decoded string, " if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for part, _, ids in token_ids(batches, text_col, path):
            texts = [coder.decode(i) for i in ids]
            out = {id_col: part.column(id_col)}
            if with_ids:
                out |= {"ids": pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            out |= {
                "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            }
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {wide}n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7(docs: DataFrame) -> DataFrame:
    return bpe_round_trip(docs, with_ids=False)
