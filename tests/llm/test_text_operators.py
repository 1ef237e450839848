"""Operators on single texts: words, statistics, classifier, rules, tokens, packing, files, extraction."""

import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lattica.llm import elias_fano, html_text, packing, quality_model, quality_rules, textstats, token_files, token_trees, vocab
from lattica.llm.textblocks import Words, distinct_shingles

ODD = ["", " ", "a", "\n\n", "one two three", "É ñ ß\tx", "word " * 3000, "x" * 200_000, "same line\nsame line\nother\nsame line", "a b c a b c a b c", "\x1c\x85\xa0 　 tail", "😀 中文 — “q”"]


def docs_of(spark, texts, **extra):
    rows = [(i, t, *extra.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in extra))


def test_words_and_shingles():
    got = Words([t.encode() for t in ODD])
    assert got.count.tolist() == [len(t.encode().lower().split()) for t in ODD]
    for t, s in zip(ODD, distinct_shingles([t.encode() for t in ODD], 3)):
        w = t.encode().lower().split()
        want = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()}
        assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()


def brute_stats(t):
    w = t.encode().split()
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in win:
        seen[x] = seen.get(x, 0) + 1
    hit = {i + j for i, x in enumerate(win) if seen[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in textstats.SYMBOLS for c in t), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("seed", range(3))
def test_statistics_match_brute_force(seed):
    rnd = random.Random(seed)
    texts = ODD + ["".join(rnd.choice(["a ", "b ", "cc ", "\n", "#", "é ", " "]) for _ in range(rnd.randint(0, 200))) for _ in range(50)]
    m = textstats.Measures([t.encode() for t in texts])
    rows = np.arange(len(texts))
    w, b, li = m.get("words", rows), m.get("bytes", rows), m.get("lines", rows)
    got = list(zip(*(x.tolist() for x in (w["n_words"], b["word_chars"], b["symbol"], li["n_dup_lines"], w["n_repeat_words"]))))
    assert got == [brute_stats(t) for t in texts]


def test_rules_order_changes_nothing(spark):
    good = " ".join(f"word{i} and more" for i in range(60))
    texts = [good, None, "", good.upper(), "# $ % " * 80, "same line here\n" * 90, good + " " + "!!! " * 100]
    docs = docs_of(spark, texts, n_words="clash", kept="clash")
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert kept == {0}
    assert quality_rules.keep_good(docs).columns == docs.columns
    raw = [(t or "").encode() for t in texts]
    every = list(range(len(quality_rules.RULES)))
    for order in (every, every[::-1]):
        assert set(np.flatnonzero(quality_rules.cascade(raw, quality_rules.RULES, order)).tolist()) == kept
    out = {r.doc_id: r for r in quality_rules.assess(docs).collect()}
    assert out[0].kept and not out[1].kept and out[1].base_failed and out[1].n_words == 0
    assert quality_rules.assess(docs.limit(0)).count() == 0
    again = docs.unionByName(docs)
    assert quality_rules.assess(again).count() == 2 * len(texts) and quality_rules.keep_good(again).count() == 2


def test_rules_run_by_rejection_per_cost(monkeypatch):
    seen = {g: 0 for g in textstats.GROUPS}
    for name, real in list(textstats.GROUPS.items()):
        def count(texts, name=name, real=real):
            seen[name] += len(texts)
            return real(texts)

        monkeypatch.setitem(textstats.GROUPS, name, count)
    good = [" ".join(f"word{i}x and more{k}" for i in range(60)).encode() for k in range(60)]
    bad = [b"12 34 56 78 90 " * 400] * 140
    order = quality_rules.plan(good + bad)
    assert sorted(order) == list(range(len(quality_rules.RULES)))
    slow = quality_rules.Rule("slow", "words", lambda m: m["n_words"] < 0)
    assert quality_rules.plan(bad, (slow, quality_rules.RULES[7])) == [1, 0]
    assert quality_rules.plan([], quality_rules.RULES) == list(range(len(quality_rules.RULES)))
    seen.update(dict.fromkeys(seen, 0))
    kept = quality_rules.cascade(good + bad, quality_rules.RULES, order)
    assert kept.tolist() == [True] * 60 + [False] * 140
    assert sorted(seen.values())[:4] == [60] * 4  # what the first rules reject is not measured by the rest


@pytest.mark.parametrize("seed", range(3))
def test_further_statistics_match_brute_force(seed):
    rnd = random.Random(seed)
    texts = ODD + ["- a\n * b\n• c ...\nd…\ne"] + ["".join(rnd.choice(["a ", "1 ", "cc... ", "\n", "- ", "é ", " ", "…\n"]) for _ in range(rnd.randint(0, 200))) for _ in range(50)]
    raw = [t.encode() for t in texts]
    a, b, c = textstats.letter_counts(raw), textstats.top_counts(raw), textstats.mark_counts(raw)
    for i, t in enumerate(raw):
        w = t.split()
        lines = [x.strip() for x in t.split(b"\n") if x.strip()]
        assert a["words"][i] == b["words"][i] == len(w)
        assert a["letterless"][i] == sum(not any(y > 127 or chr(y).isalpha() for y in x) for x in w)
        assert b["top"][i] == max((w.count(x) for x in set(w)), default=0)
        assert c["lines"][i] == len(lines) and c["listed"][i] == sum(x[:1] in b"-*" or x.startswith("•".encode()) for x in lines)
        assert c["cut_short"][i] == sum(x.endswith(b"...") or x.endswith("…".encode()) for x in lines)


def test_classifier_learns_and_survives_empty_tables(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 6) for _ in range(60)) + ("###" * 40 if i % 3 == 0 else "") for i in range(300)] + [None, ""]
    docs = docs_of(spark, texts, quality="9")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)] + [(5, None), (7, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_model.score_documents(docs, labels).collect()}
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 300]
    assert held and all(r.predicted == int(r.doc_id % 3 != 0) for r in held)
    assert {r.doc_id for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    none = quality_model.score_documents(docs, labels.limit(0)).collect()
    assert len(none) == 302 and {round(r.score, 6) for r in none} == {0.5}
    assert quality_model.score_documents(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_is_exact(name, drops):
    e, t = vocab.Encoder(P.path(name), drops), Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    rnd = random.Random(3)
    signs = ["a", "É", "ñ", "s", "'s", "'", " ", "  ", "\n", "\t", "1", "23", "!", "?!", "ÿ", "ß", "S", ".", "µ", "ł", "\x1c", "\xa0", "́", "<|endoftext|>", "\0"]
    texts = ODD + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    want = [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want and e.encode_cut(texts) == want and e.encode(texts[::-1]) == want[::-1]


def test_token_trees_follow_edits(spark):
    e = vocab.encoder(P.path("byte_bpe_50k.json"))
    rnd = random.Random(4)
    signs = ["a", "É", "ł", "'s", " ", "  ", "\n", "word", " the", "1", "!", "'"]
    for _ in range(300):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40)))
        tree = token_trees.Tree(text, e, leaf=rnd.choice([1, 2, 4]))
        for _ in range(3):
            a = rnd.randint(0, len(text) + 2)
            b = rnd.randint(a, a + 6)
            new = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 3)))
            s, f = min(a, len(text)), min(b, len(text))
            text = text[:s] + new + text[f:]
            assert tree.edit(a, b, new) == len(e.tokenizer.encode(text, add_special_tokens=False).ids)
            assert tree.text() == text
    long = token_trees.Tree("some words here " * 5000, e)
    long.edit(40_000, 40_004, "x")
    assert long.encoded < 20
    rows = spark.createDataFrame([(1, "abc def", [(0, 3, "xyz")]), (2, None, None), (None, "q", [(None, None, None)])], "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>")
    got = {r.doc_id: r for r in token_trees.counted(rows, "edits", P.path("byte_bpe_50k.json")).collect()}
    assert got[2].n_tokens == got[2].n_tokens_edited == 0 and got[1].n_tokens > 0


def test_packing_is_whole_and_tight(spark):
    rnd = np.random.default_rng(5)
    lengths = rnd.integers(1, 100, 3000)
    where, offset, gaps = packing.pack(lengths, 128)
    used = np.zeros(len(gaps), int)
    for k, o, s in sorted(zip(where.tolist(), offset.tolist(), lengths.tolist())):
        assert o == used[k]
        used[k] += s
    assert (used + gaps == 128).all() and len(gaps) <= -(-lengths.sum() // 128) * 1.02 + 1
    docs = docs_of(spark, ["word " * n for n in (1, 50, 900, 2047, 2048, 5000)] + [None, ""], piece="x", length="y")
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json")).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == by_doc.get(r.doc_id, 0) and 1 <= r.length <= 2048
        by_doc[r.doc_id] = r.start + r.length
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert by_doc == {i: len(t.encode(x.text or "", add_special_tokens=False).ids) + 1 for i, x in enumerate(docs.collect())}
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
    assert packing.pack_documents(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_elias_fano_round_trip():
    rnd = np.random.default_rng(6)
    for n, u in ((0, 1), (1, 1), (5, 3), (1000, 10), (1000, 10**9), (70_000, 10**7)):
        v = np.sort(rnd.integers(0, u, n))
        data = elias_fano.encode(v)
        r = elias_fano.Reader(b"pad" + data, 3)
        assert r.size == len(data) and r.all().tolist() == v.tolist()
        for i in rnd.integers(0, n, min(n, 50)).tolist():
            assert r[i] == v[i]
    v = np.arange(0, 700_000, 7)
    assert len(elias_fano.encode(v)) < len(v) * (2 + math.log2(7) + 1) / 8 + 2000


def test_token_files_read_back(spark):
    texts = ODD + [None, "shared", "shared"]
    docs = spark.createDataFrame([(100 - i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")], "doc_id long, text string, start string")
    rows = sorted(token_files.round_trip(docs, P.path("word_bpe_49k.json")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    at = 0
    by_id = {100 - i: x for i, x in enumerate(texts)} | {None: "no id"}
    for r in rows:
        ids = np.array(t.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(rows) == len(texts) + 1
    assert token_files.round_trip(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0
    data = token_files.pack_file([None, 3, 3], [b"\x01\0\0\0", b"", b"\x02\0\0\0\x03\0\0\0"], 2)
    f = token_files.TokenFile(data)
    assert [f.doc_id(i) for i in range(len(f))] == [None, 3, 3] and [f.ids(i).tolist() for i in range(3)] == [[1], [], [2, 3]]


def test_token_files_of_long_and_repeated_texts(spark, monkeypatch):
    monkeypatch.setattr(token_files, "READ_DOCS", 3)
    texts = ["some words of text " * 60_000, "same", "same", "same"]
    docs = spark.createDataFrame([(k, t) for k, t in zip((4, 2, 2, 2), texts)], "doc_id long, text string")
    rows = sorted(token_files.round_trip(docs, P.path("word_bpe_49k.json")).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    sizes = [len(t.encode(x, add_special_tokens=False).ids) + 1 for x in texts]
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(2, sizes[1])] * 3 + [(4, sizes[0])]
    with pytest.raises(ValueError, match="needs more than 2 bytes"):
        token_files.pack_file([1], [np.array([70_000], "<u4").tobytes()], 2)


def test_packing_of_long_and_repeated_texts(spark):
    docs = docs_of(spark, ["some words of text " * 60_000, "same"]).selectExpr("doc_id", "text", "'x' AS sequence_id")
    rows = packing.pack_documents(docs.unionByName(docs), P.path("byte_bpe_50k.json")).collect()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 and sorted(p)[0][0] == 0 for p in places.values())
    n = len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode("some words of text " * 60_000, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in rows if r.doc_id == 0) == 2 * n and sum(r.doc_id == 1 for r in rows) == 2
    rnd = np.random.default_rng(1)  # within a tenth of the volume of the fewest that could do, in several groups
    cut = spark.createDataFrame([(i, 0, 0, int(x), 0) for i, x in enumerate(rnd.integers(1, 2000, 3000))], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack_pieces(cut, group_pieces=700).select("sequence_id").distinct().count()
    assert got <= cut.agg({"length": "sum"}).first()[0] / 2048 * 1.1


def test_classifier_against_plain_trees(spark):
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = quality_model.fit(x, y, trees=6, depth=3)
    binned = model.bins(x)
    for i in range(400):
        total = model.start
        for t in range(6):
            k = 0
            for _ in range(3):
                k = 2 * k + (2 if binned[i, model.feature[t, k]] > model.split[t, k] else 1)
            total += model.leaf[t, k - 7]
        assert math.isclose(model.score(x[i : i + 1])[0], 1 / (1 + math.exp(-total)))
    p = 1 / (1 + math.exp(-model.start))
    g, h = y - p, np.full(400, p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality_model.RIDGE)
    gains = {(j, b): score(binned[:, j] <= b) + score(binned[:, j] > b) for j in range(3) for b in range(62) if 1 <= h[binned[:, j] <= b].sum() and 1 <= h[binned[:, j] > b].sum()}
    first = model.feature[0, 0], model.split[0, 0]
    assert math.isclose(gains[first], max(gains.values()))
    docs = docs_of(spark, ["a b c " * 30, "d e f " * 30])
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    assert quality_model.score_documents(docs.unionByName(docs), labels).count() == 4


def test_token_counts_of_repeated_rows_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "abc def", [(0, 3, "xyz")], 5)] * 2, "doc_id long, text string, n_tokens array<struct<start:int,end:int,new:string>>, tokens int")
    got = token_trees.counted(rows, "n_tokens", P.path("byte_bpe_50k.json")).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].n_tokens > 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><div class="ad">Buy our very best product now.</div>
<article><h1>Heading &amp; more</h1><p>First   paragraph of text that is
long enough to be content.</p><p>Short.</p><div class="comments"><p>A reader says that this was a wonderful text.</p></div></article>
<aside><p>Other texts that one might read, which go on at some length.</p></aside><form><label>Name</label></form><footer>&copy; someone</footer></body></html>"""


def test_extraction(spark):
    assert html_text.main_blocks(PAGE) == ["Heading & more", "First paragraph of text that is long enough to be content.", "Short."]
    rows = spark.createDataFrame([(1, "u", PAGE, "a"), (2, "u", None, "a"), (3, None, "", "a"), (4, "u", "<p>cut &amp", "a"), (5, "u", "<div" * 5000, "a"), (6, "u", "plain text without any markup, but with some words.", "a")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extracted(rows).collect()}
    assert got[2].text == got[3].text == "" and got[1].n_chars == len(got[1].text) and got[6].text.startswith("plain text")
    assert html_text.extracted(rows.limit(0)).count() == 0


LONG = "This is quite a long paragraph of text, with some clauses in it, which goes on for a while. " * 3


@pytest.mark.parametrize("page,want", [
    (f'<div class="content has-sidebar"><article><h1>T</h1><p>{LONG}</p></article></div><aside>x</aside>', ["T", LONG]),
    (f'<form id="aspnetForm"><main><h1>T</h1><p>{LONG}</p></main></form>', ["T", LONG]),
    (f'<div><p title="the hidden truth">{LONG}</p><p>{LONG}</p></div>', [LONG, LONG]),
    (f'<article class="post related-topic"><h1>T</h1><p>{LONG}</p></article>', ["T", LONG]),
    (f'<article><h1>T</h1><p>{LONG}</p><section class="comments"><article><p>{LONG}</p></article></section></article>', ["T", LONG]),
    (f'<article><h1>T</h1><p>One word</p></article><div id="comments"><p>{LONG}</p><p>{LONG}</p></div>', ["T", "One word"]),
    (f'<article><p>{LONG}</p><p class="ad">{LONG}</p><p>No</p><p>{LONG}</p></article><aside><article><p>{LONG}</p></article></aside>', [LONG, "No", LONG]),
    (f'<article><p>{LONG}</p><p hidden>{LONG}</p></article><div class="related"><article class="teaser"><p>{LONG}</p></article></div>', [LONG]),
    (f'<article><header><h1>Ti</h1><p>by me</p></header><p>{LONG}</p><footer>Posted in x</footer></article>', ["Ti", "by me", LONG]),
    (f'<body><div><a href=x>Home</a> | <a href=y>About</a></div><div><p>{LONG}</p><p>It was so.</p><p>{LONG}</p></div><div>Copyright 2020 | All rights</div>', [LONG, "It was so.", LONG]),
    ("<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000, [LONG]),
])
def test_extraction_of_awkward_markup(page, want):
    assert html_text.main_blocks(page) == [x.strip() for x in want]


def test_extraction_is_a_minimum_cut_over_whole_pages():
    for page in (f"<nav><a href=a>One</a></nav><article><h1>T</h1><p>{LONG}</p><p class=ad>Buy it.</p></article><footer>me</footer>", f"<article><p>{LONG}</p><p>No</p></article><p>Other</p>", f"<div class=content><p>One</p><p>{LONG}</p></div><ul><li><a href=x>Two</a></li></ul>"):
        found = html_text.blocks(page)
        more, links = html_text.Tree(found).graph(found)
        gains, links = html_text.odds(found) + more, links + html_text.edges(found)
        n = len(gains)
        assert n <= 22
        m = np.arange(1 << n)
        cost = sum(np.where(m >> i & 1, max(0, -g), max(0, g)) for i, g in enumerate(gains)) + sum(c * ((m >> a ^ m >> b) & 1) for a, b, c in links)
        kept = html_text.cut([max(0, g) for g in gains], [max(0, -g) for g in gains], links)
        assert cost[sum(1 << i for i, k in enumerate(kept) if k)] == cost.min()
        assert html_text.labels(found) == kept[: len(found)]


def test_extraction_learns_from_plain_markup(spark):
    rnd = random.Random(3)
    say = lambda n: " ".join("word" + str(rnd.randint(0, 99)) for _ in range(n))
    pages = [f"<nav><a href=a>{say(1)}</a><a href=b>{say(2)}</a></nav><article><h1>{say(5)}</h1><p>{say(40)}.</p></article><footer>© {say(3)}</footer>" for _ in range(60)]
    rows = spark.createDataFrame([(i, f"u{i}", p, None) for i, p in enumerate(pages)], "page_id long, url string, html string, n_chars string")
    w = html_text.learned(rows, 30)
    assert w.shape == html_text.PRIOR.shape and (w == html_text.learned(rows.repartition(5), 30)).all()
    assert dict(zip(html_text.FEATURES, w))["linked"] < -3 and dict(zip(html_text.FEATURES, w))["signs"] < 0
    assert (html_text.learned(rows.limit(0)) == html_text.PRIOR).all()
    twice = html_text.extracted(rows.unionByName(rows)).collect()
    assert len(twice) == 120 and all(r.text.count("\n") == 1 for r in twice)


def test_features_see_whole_texts():
    for lead, rest in (("word " * 100, "7A" * 300), ("7A" * 300, " word" * 100)):
        (block,) = html_text.blocks(f"<p>{lead}{rest}</p>")
        got = dict(zip(html_text.FEATURES, html_text.features([block])[0]))
        assert len(block.text) > 1000 and got["digits"] == got["capitals"] == 300 / len(block.text)


def test_minimum_cut_is_least():
    rnd = random.Random(7)
    for _ in range(200):
        n = rnd.randint(1, 7)
        a, b = [rnd.randint(0, 9) for _ in range(n)], [rnd.randint(0, 9) for _ in range(n)]
        edges = [(i, j, rnd.randint(1, 5)) for i in range(n) for j in range(i) if rnd.random() < 0.5]

        def cost(side):
            return sum(b[i] if side[i] else a[i] for i in range(n)) + sum(c for i, j, c in edges if side[i] != side[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        got = html_text.cut(a, b, edges)
        assert cost(got) == best
        least = min(sum(m >> i & 1 for i in range(n)) for m in range(1 << n) if cost([bool(m >> i & 1) for i in range(n)]) == best)
        assert sum(got) == least
