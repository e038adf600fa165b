"""A small table of documents with everything odd in it, and plain Python ways to the same results."""

import hashlib
import random
from collections import Counter

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, `n words` int, kept boolean, _row double"


def lower(text):
    return (text or "").encode().translate(LOWER).decode()


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows(seed=1):
    """Ids and texts: nulls, empty and very long texts, copies, near copies, shared lines and passages, ties, odd spaces and letters."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(pool) for _ in range(n))

    line, passage, base = "A line that a good many documents have in common, Ä too.", prose(60), prose(120)
    texts = [None, "", " ", "\n", "\n\n \t", "one", "one two", "One  two", "one two three", "a b c a b c", "x" * 300, "no\x00nul", "<|endoftext|> x", " nb sp", " ", "É é ß SS"]
    texts += [prose(rng.randint(1, 90)) for _ in range(12)]
    texts += [f"{prose(20)}\n  {line.upper() if i % 2 else line} \n{prose(9)}" for i in range(7)]
    texts += [f"{prose(10)}\n{line}\n{line.replace('A line', 'a LINE')}\n"]
    texts += [f"{prose(30)} {passage} {prose(30)}" for _ in range(3)]
    texts += [base, base, base.upper().replace("ẞ", "ß"), base + " tail", "head " + base, base.replace(" ", "\n")]
    texts += [" ".join([*base.split()[:i], "changed", *base.split()[i + 1 :]]) for i in (5, 60, 110)]
    texts += ["spam spam " * 80, ("loop " * 7 + "end ") * 20, prose(30_000), "longword" * 20_000]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[25], (None, base), (None, None)]


def odd_docs(spark, rows=None):
    rows = odd_rows() if rows is None else rows
    full = [(i, t, ("en", "de", None)[n % 3], None if n % 5 == 0 else f"s{n % 2}", None, "clash", 1, None, 0.5) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def by_row(df, *columns):
    """Rows as a multiset, keyed by what comes first."""
    return Counter(tuple(r) for r in df.select(*columns).collect())


def shingles(text, n=3):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def removed_by_windows(texts, window=35):
    """For each text its words and which of them go."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((w, gone))
    return out
