"""Encoding, packing, extraction and the quality rules."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from odd import odd_docs, odd_rows, sha, words

from commonloom.llm import bpe, html_extract, packing, quality_rules

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    pool = [chr(rng.choice([rng.randint(0, 0x24F), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF), rng.randint(97, 122)])) for _ in range(400)]
    pool += ["<|endoftext|>", " ", "  ", "\n\n", "the", "ing", "'s", "aaaa", "###"] * 15
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_ids_are_the_librarys(library):
    coder = bpe.Bpe(PATH)
    rng = random.Random(1)
    texts = [*random_texts(3000), *("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 70))) for _ in range(3000)), "a" * 5000]
    for text, ids, packed in zip(texts, coder.encode_batch(texts), map(packing.encoder(PATH), texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want == packed.tolist()
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_speculation_is_checked_both_ways():
    """A proposal is taken exactly where exact merging gives it."""
    coder = bpe.Bpe(PATH)
    rng = random.Random(2)
    pairs = np.array([(rng.randrange(50256), rng.randrange(50256)) for _ in range(3000)] + [(rng.randrange(256), rng.randrange(256)) for _ in range(1000)], dtype=np.int32)
    apart = coder.stay_apart(pairs[:, 0], pairs[:, 1])
    for (a, b), says in zip(pairs.tolist(), apart, strict=True):
        assert says == (coder.merge_exactly(coder.bytes_of[a] + coder.bytes_of[b]) == [a, b])


def test_broken_bytes_decode_as_the_librarys(library):
    coder = bpe.Bpe(PATH)
    ids = [coder.ids[b"\xc3"], coder.ids[b"a"], coder.ids[b"\xe4"], coder.ids[b"\xbd"]]
    assert coder.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_op7(spark, library):
    rows = odd_rows()
    want = defaultdict(set)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i].add((len(ids), __import__("hashlib").sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), sha(t or "")))
    found = bpe.op7(odd_docs(spark)).collect()
    assert len(found) == len(rows)
    assert all(tuple(r)[1:] in want[r["doc_id"]] for r in found)
    full = bpe.bpe_round_trip(odd_docs(spark)).where("doc_id = 35").first()
    assert full["ids"] == library.encode(full["decoded"], add_special_tokens=False).ids


def test_best_fill_is_the_best():
    rng = random.Random(4)
    for _ in range(400):
        counts = defaultdict(int)
        for _ in range(rng.randrange(8)):
            counts[rng.randint(1, 30)] += rng.randint(1, 3)
        room = rng.randrange(90)
        sums = {0}
        for n, times in counts.items():
            for _ in range(times):
                sums |= {s + n for s in sums if s + n <= room}
        picked = packing.best_fill(sorted(counts), counts, room)
        assert all(0 < k <= counts[n] for n, k in picked.items())
        assert sum(n * k for n, k in picked.items()) == max(sums)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(spark, library, capacity):
    rows = odd_rows()
    pieces = packing.pack(odd_docs(spark), capacity=capacity).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        assert p["length"] == len(p["ids"]) > 0
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], dtype="<u4").tobytes())
    want = defaultdict(list)
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, len(ids)].append(ids)
    assert by_doc.keys() == want.keys()
    for key, parts in by_doc.items():
        got = sorted((p["start"], p["ids"]) for p in parts)
        assert sorted(x for _, ids in got for x in ids) == sorted(x for ids in want[key] for x in ids)
        if len(want[key]) == 1:
            assert [x for _, ids in got for x in ids] == want[key][0]
    for parts in by_sequence.values():
        end = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == end
            end += p["length"]
        assert end <= capacity and end & (end - 1) == 0
    assert packing.pack(odd_docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000 + "a", "\n" * 2_000_000, "b<|endoftext|>" + " \n\t" * 700_000 + "b c"])
def test_very_long_white_space(library, text):
    assert packing.encoder(PATH)(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_of_very_long_white_space(spark):
    texts = [" " * 1_200_000 + "a", "short"]
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    for i, text in enumerate(texts):
        got = sorted((p["start"], p["ids"]) for p in pieces if p["doc_id"] == i)
        assert [x for _, ids in got for x in ids] == [*bpe.Bpe(PATH).encode_batch([text])[0].tolist(), 0]


PAGES = [
    ("http://a.org/1", "<html><body><nav><p>menu menu menu menu</p></nav><div class='post-12 main'><h2>Head</h2><p>One &amp; <b>t</b>wo<br>three<p>four</div><div class=sidebar><p>side side side</p></div></body></html>"),
    ("http://A.org/2", "<html><body><div class='main post-7'><h2>Next</h2><p>Text  of\n two &lt;x&gt;</p><div id='comments'><p>a very long comment that goes on and on and on and on</p></div></div><div class=teaser><p>short</p></div></body>"),
    ("http://a.org/3", "<html><body><div class='post-9 main'><p>ok</p></div><div class=list><p>a list that is longer than what the page is really about, by far</p></div></body>"),
    ("http://b.org/", "<article><header><h1>Title</h1><p>by someone</p></header><p>Body<form><p>name</p></form><script>if (a < b) '</p>'</script><!-- <p>no</p> --><ul><li>x<li>y</ul></article><footer><p>foot</p></footer>"),
    (None, "just text &copy; <i>in</i>line"),
    ("odd", None),
    ("odd", ""),
    ("odd", "<p"),
    ("odd", "<" * 300),
    ("http://c.org", "<div>" * 3000 + "deep enough to count as text" + "</div>" * 3000),
    ("http://e.org", "<div class='has-sidebar no-comments'><p>the article</p><div class='sidebar-left'><p>side</p></div></div>"),
    ("http://d.org", "<script>" + "never closed <p>x</p>"),
]


def test_extraction(spark):
    rows = [(n, u, h, "x", "y") for n, (u, h) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _host string").repartition(3)
    out = html_extract.html_extract(pages)
    assert out.columns == ["page_id", "url", "html", "_host", "text", "n_chars"]
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got[0] == "Head One & two three four"
    assert got[1] == "Next Text of two <x>"
    assert got[2] == "ok"  # by the vote of the host's other pages
    assert got[3] == "Title Body x y"
    assert got[4] == "just text © inline"
    assert got[5] == got[6] == got[11] == ""
    assert got[10] == "the article"
    assert got[9] == "deep enough to count as text"
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert html_extract.op9(pages.limit(0)).count() == 0


LONG = "one of the many sentences that the story itself is told in. " * 12
STORY = LONG.strip()
WHOLE = [
    ("article", f"<body><nav><a>Home</a></nav><article><h1>Head</h1><p>lead</p><div class=body><p>{LONG}</p></div></article></body>", f"Head lead {STORY}"),
    ("post", f"<body><div class=post><div class=lead>lead</div><div class=body>{LONG}</div></div></body>", f"lead {STORY}"),
    ("header", f"<body><div class=post><header><h1>Head</h1><p>by</p></header><div class=body>{LONG}</div></div></body>", f"Head {STORY}"),
    ("linked", f"<body><div class=post><h1><a href=x>Head</a></h1><div class=body>{LONG}</div></div></body>", f"Head {STORY}"),
    ("sections", f"<body><main><section class=a>first</section><section class=b>{LONG}</section><section class=c>last</section></main><footer>foot</footer></body>", f"first {STORY} last"),
    ("bare", f"<body><section class=a>first</section><section class=b>{LONG}</section><div class=teaser>no</div></body>", f"first {STORY} no"),
    ("cells", f"<body><div class=page><table><tr><td class=l>left</td><td class=r>{LONG}</td></tr><tr><td>under</td></tr></table></div></body>", f"left {STORY} under"),
    ("cells2", f"<body><article><h1>Head</h1><table><tr><td>left</td><td>{LONG}</td></tr></table></article></body>", f"Head left {STORY}"),
    ("links", f"<body><div class=page><div class=top><a>Home</a> | <a>About</a></div><div class=body>{LONG}</div></div></body>", STORY),
    ("beside", f"<body><h1>Head</h1><p>lead</p><div class=body>{LONG}</div></body>", f"Head lead {STORY}"),
    ("head", f"<body><div class=top><h1>Head</h1></div><div class=body>{LONG}</div></body>", f"Head {STORY}"),
    ("nested", f"<body><main><h1>Head</h1><article><div>{LONG}</div></article></main></body>", f"Head {STORY}"),
    ("outside", f"<body><div class=w><h1>Head</h1><article><div>{LONG}</div></article></div><div class=teaser>no</div></body>", f"Head {STORY}"),
    ("stays", f"<body><p>site</p><article><h1>Head</h1><div>{LONG}</div></article><div class=teaser>no</div></body>", f"Head {STORY}"),
]


def test_extraction_takes_whole_articles(spark):
    """A long inner container takes nothing from the article around it, also where only some pages of a host have a lead."""
    rows = [(n, f"http://{name}.org/{k}", page) for n, (name, page, _) in enumerate(WHOLE) for k in range(3)]
    plain = f"<body><div class=post><div class=body>{LONG}</div></div></body>"
    rows += [(100 + k, f"http://post.org/plain{k}", plain) for k in range(9)]
    got = {(r["page_id"], r["text"]) for r in html_extract.op9(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(n, want) for n, (_, _, want) in enumerate(WHOLE)} | {(100 + k, STORY) for k in range(9)}


MEANT = [
    (f"<article><p>{LONG}</p><div class='share-price'><p>Shares rose.</p></div></article>", f"{STORY} Shares rose."),
    (f"<article><p>{LONG}</p><div class='related-work'><p>What others have found.</p></div><div class='related-posts'><p>Read this as well</p></div></article>", f"{STORY} What others have found."),
    (f"<article><p>{LONG}</p><div class='menu-recipe'><a>Link</a> <a>Another link</a> x</div></article>", STORY),
    (f"<body><form id=aspnet><h1>Head</h1><p>{LONG}</p><input name=x><button>go</button></form></body>", f"Head {STORY}"),
    (f"<body><div class=widget><h1>Head</h1><p>{LONG}</p></div></body>", f"Head {STORY}"),
    (f"<body><article><h1>Head</h1><p>{LONG}</p><div class=comments><article class=comment><p>{LONG * 3}</p></article></div></article></body>", f"Head {STORY}"),
    (f"<body><div class=main-nav><h1><a>Site</a></h1><a>one</a><a>two</a></div><article><p>{LONG}</p></article></body>", STORY),
]


def test_names_that_only_contain_a_mark():
    for page, want in MEANT:
        assert html_extract.extract(page, None) == want


M = 1_000_000
ADVERSE = {
    "stray end tags": "<span>" * (M // 10) + "</b>" * (M // 10),
    "nested spans": "<span><p>x" * (M // 10),
    "open quotes": '<a b="' * (M // 6),
    "one end": '<a b="' * (M // 6 | 1) + ">",
    "open tags": "<div class='a' " * (M // 15),
    "angles": "<" * M,
    "declarations": "<!" * (M // 2),
    "scripts": "<script>" + "</script" * (M // 8),
    "siblings": "<div class=p>" + "<div class=row>some text that is here</div>" * (M // 45) + "</div>",
    "articles": "<div>" * 20_000 + "<article>some text is here</article>" * 20_000,
    "items": "<ul>" + "<li>x" * (M // 5),
    "name": "<a " + "x" * M + ">",
}


@pytest.mark.parametrize("kind", ADVERSE)
def test_long_pages_take_time_in_proportion(kind):
    """Twenty times the page takes at most about that much longer; a quadratic step would take hundreds of times as long."""
    import time

    page, times = ADVERSE[kind], []
    for some in (page[: M // 20], page):
        start = time.process_time()
        path, _ = html_extract.page_vote(some)
        html_extract.extract(some, path or None)
        times.append(time.process_time() - start)
    assert times[1] < max(2.0, 80 * times[0])


def generated_page(rng):
    """A page and its article, written down piece by piece."""
    word = lambda: "".join(rng.choice("abcdefgäß") for _ in range(rng.randint(2, 8)))
    sentence = lambda least=6, most=25: " ".join(word() for _ in range(rng.randint(least, most))) + "."

    def inline(text):
        words = text.split(" ")
        k = rng.randrange(len(words))
        words[k] = rng.choice(["<b>{}</b>", "<em class=x>{}</em>", "{}", "<!-- no -->{}", "<a href='/y'>{}</a>"]).format(words[k])
        return rng.choice([" ", "\n ", "  "]).join(words)

    def block():
        kind = rng.randrange(5)
        if kind == 0:
            items = [sentence(3, 8) for _ in range(rng.randint(1, 4))]
            return "<ul>" + "".join(f"<li>{inline(i)}" + rng.choice(["", "</li>"]) for i in items) + "</ul>", items
        if kind == 1:
            a, b = sentence(), sentence()
            return f"<p>{inline(a)}<br/>{inline(b)}</p>", [a, b]
        if kind == 2:
            a, b = sentence(), word()
            return f"<p>{a} &amp; &#8212;{b} &lt;</p>", [f"{a} & \u2014{b} <"]
        if kind == 3:
            a = sentence()
            return f"<blockquote><p>{inline(a)}</p></blockquote>", [a]
        a = sentence()
        return f"<p>{inline(a)}" + rng.choice(["", "</p>"]), [a]

    noise = lambda: rng.choice([
        f"<div class='ad-{rng.randrange(9)}'>{sentence()}</div>", f"<aside><p>{sentence()}</p></aside>", f"<script>var x = '<p>{word()}</p>';</script>", f"<form><p>{sentence()}</p><input></form>",
        f"<div class='share-buttons'>{word()}</div>", f"<style>p {{ }} </style>", "",
    ])
    head = sentence(2, 6)
    html_parts, text = [f"<h1>{head}</h1>"], [head]
    for _ in range(rng.randint(4, 12)):
        markup, blocks = block()
        html_parts += [markup, noise()]
        text += blocks
    article = "".join(html_parts)
    wrap = rng.choice(["<article>{}</article>", "<main><article>{}</article></main>", "<div id=page><div class='post entry'>{}</div></div>", "<div class=outer><section class=text>{}</section></div>"])
    nav = "<nav><ul>" + "".join(f"<li><a href=/{i}>{word()}</a></li>" for i in range(rng.randint(3, 9))) + "</ul></nav>"
    comments = "<div id=comments>" + "".join(f"<div class=comment><p>{sentence()}</p></div>" for _ in range(rng.randint(0, 9))) + "</div>"
    side = rng.choice([f"<div class='sidebar right'><p>{sentence()}</p></div>", f"<div class=cookie-notice>{sentence()}</div>", ""])
    return f"<!DOCTYPE html><html><head><title>{head}</title></head><body>{nav}{side}{wrap.format(article)}{comments}<footer><p>{sentence()}</p></footer></body></html>", " ".join(text)


def test_generated_pages_give_their_articles(spark):
    rng = random.Random(12)
    made = [generated_page(rng) for _ in range(150)]
    rows = [(n, f"http://h{n % 7}.org/{n}", page) for n, (page, _) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in html_extract.op9(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {n: text for n, (_, text) in enumerate(made)}


def brute_repeats(w):
    n, longest = len(w), [0] * len(w)
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    return longest


def test_suffix_arrays_find_the_longest_repeats():
    rng = random.Random(6)
    for _ in range(150):
        docs = [[rng.randrange(rng.choice([1, 3, 20])) for _ in range(rng.randrange(40))] for _ in range(rng.randrange(5))]
        got = quality_rules.repeat_lengths(np.array([w for d in docs for w in d], dtype=np.int64), np.array([len(d) for d in docs], dtype=np.int64))
        assert got.tolist() == [x for d in docs for x in brute_repeats(d)]


def test_quality_rules(spark):
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) < 3000]
    want = defaultdict(set)
    for i, t in rows:
        w, n = words(t), len(words(t))
        longest = brute_repeats(w)
        spans = {3: [False] * n, 10: [False] * n}
        for at, k in enumerate(longest):
            if k >= 3:
                spans[3][at : at + 3] = [True] * 3
            if k >= 10:
                spans[10][at : at + k] = [True] * k
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = n < 50 or 100 * sum(spans[3]) > 50 * n
        kept = not failed and 100 * sum(spans[10]) <= 25 * n and max(longest, default=0) <= 100
        want[i].add((n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), sum(spans[3]), sum(spans[10]), max(longest, default=0), failed, kept))
    found = quality_rules.op10(odd_docs(spark, rows)).collect()
    assert len(found) == len(rows)
    assert all(tuple(r)[1:] in want[r["doc_id"]] for r in found)
    assert {r["kept"] for r in found} == {True, False}
