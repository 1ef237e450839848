"""Operators across documents: near duplicates, repeats, tiling, language model, pipeline."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import components, jaccard_join, language_model, log_bloom, repeat_spans, row_filter, suffix_array, tiling
from lattica.llm.textblocks import U64


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def near_copies(rnd, base, n, rate):
    return [" ".join(w if rnd.random() > rate else f"edit{rnd.randint(0, 10**6)}" for w in base) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    texts = [None, "", "one", "ONE", "one two", "a b c d e", "A B C D E", "a b c d e f"]
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 120))]
        texts += near_copies(rnd, base, rnd.randint(1, 12), rnd.choice([0.0, 0.01, 0.03, 0.05]))
    passage = [rnd.choice(words) for _ in range(40)]
    texts += [" ".join(passage + [rnd.choice(words) for _ in range(rnd.randint(5, 40))]) for _ in range(30)]
    rows = list(zip(rnd.sample(range(1000), len(texts)), texts))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == brute_components(rows)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(empty).count() == 0
    alone = spark.createDataFrame([(1, "all of this is different"), (None, "without any id at all"), (None, "without any id at all")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(alone).collect()}
    assert got == {(1, 1), (None, None)}
    assert jaccard_join.one_of_each(alone).count() == 3


def test_one_of_each_tells_unlike_texts_of_one_id_apart(spark):
    names = "doc_id long, text string, key long, row string, doc string"
    rows = [(1, "a b c d e f"), (1, "A b c d e f"), (1, "something else that is said"), (2, "a b  c d e f"), (3, ""), (3, ""), (3, None), (4, "x y " * 60_000)]
    docs = spark.createDataFrame([(*r, 7, "r", "d") for r in rows], names)
    got = sorted((r.doc_id, (r.text or "").lower()[:9]) for r in jaccard_join.one_of_each(docs).collect())
    assert got == [(1, "a b c d e"), (1, "something"), (3, ""), (3, ""), (4, "x y x y x")]
    assert jaccard_join.one_of_each(docs).columns == docs.columns


def test_filters_lose_no_link(spark):
    rnd = np.random.default_rng(5)
    how = jaccard_join.Similarity()
    sets = [np.unique(rnd.integers(0, 400, rnd.integers(1, 90)).astype(U64)) for _ in range(60)]
    sets += [np.unique(np.append(s[rnd.random(len(s)) > 0.1], rnd.integers(400, 500, 3).astype(U64))) for s in sets]
    rows = []
    for k, s in enumerate(sets):
        length = max(1, len(s) - int(how.least_shared(np.int64(len(s)))) + 1)
        rows.append((k, *(jaccard_join._prefix(s, length, other).astype(np.int32).tolist() for other in (False, True))))
    table = spark.createDataFrame(rows, "key long, prefix2 array<int>, prefix3 array<int>")
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    left = {(r.a, r.b) for r in jaccard_join.filtered(spark.createDataFrame(pairs, "a long, b long"), table).collect()}
    links = {(i, j) for i, j in pairs if jaccard_join.verified(sets[i], len(sets[i]), sets[j], len(sets[j]), how)}
    assert links <= left and len(links) > 20 and len(left) < len(pairs) / 2


def test_shared_passage_makes_few_pairs(spark):
    rnd = random.Random(77)
    say = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    passage = say(70)
    docs = spark.createDataFrame([(i, " ".join(passage + say(30))) for i in range(2000)], "doc_id long, text string").repartition(4)
    assert {r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == set(range(2000))
    links, roots = jaccard_join.class_links(docs)  # no pair of them, as none has enough that occurs elsewhere
    assert links.count() == 0 and roots.count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 40)]
    links = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 40)}}


def test_suffix_array_and_prefixes():
    rnd = np.random.default_rng(1)
    for it in range(300):
        t = rnd.integers(97, 97 + rnd.choice([1, 2, 3, 26]), rnd.integers(1, 60)).astype(np.uint8)
        t = np.concatenate([t] * (1 + it % 3))
        b = t.tobytes()
        order = suffix_array.suffix_array(t)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        before, common = suffix_array.permuted_prefixes(t, order)
        for a, c in zip(order[:-1].tolist(), order[1:].tolist()):
            k = 0
            while max(a, c) + k < len(b) and b[a + k] == b[c + k]:
                k += 1
            assert before[c] == a and common[c] == k


def test_suffix_array_recursion_on_real_text():
    words = [f"w{i}e"[-1 - i % 5 :] for i in range(700)]
    rnd = random.Random(12)
    text = " ".join(rnd.choice(words[: rnd.choice([30, 700])]) for _ in range(9000)).encode() * 2
    seen = []
    real = suffix_array._sorted

    def sort(v, size):
        seen.append(size)
        return real(v, size)

    suffix_array._sorted, old = sort, real
    try:
        order = suffix_array.suffix_array(np.frombuffer(text, np.uint8))
    finally:
        suffix_array._sorted = old
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert len(seen) >= 3 and max(seen) > suffix_array.FEW_BUCKETS


def brute_repeats(texts, window):
    count = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        cut = np.zeros(len(t) + 1, int)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                cut[i] += 1
                cut[i + window] -= 1
        gone = cut.cumsum()[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("window,gram", [(40, 16), (25, 10)])
def test_repeats_match_brute_force(spark, window, gram):
    rnd = random.Random(window)
    say = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    passage = [say(rnd.randint(window - 3, 3 * window)) for _ in range(6)]
    texts = [None, "", "ab" * 60, "z" * (window + 1), say(window)]
    for _ in range(60):
        texts.append("".join(rnd.choice([say(rnd.randint(1, 50)), rnd.choice(passage)]) for _ in range(rnd.randint(1, 6))))
    texts += texts[10:14]
    docs = spark.createDataFrame([(i, t, "q", "r") for i, t in enumerate(texts)], "doc_id long, text string, row string, marks string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_spans.report(docs, window, gram).collect()}
    want = brute_repeats([(t or "").encode() for t in texts], window)
    assert got == dict(enumerate(want))
    left = repeat_spans.without_repeats(docs, window, gram)
    assert left.columns == docs.columns and all(r.text.strip() for r in left.collect())


def test_repeats_of_a_hot_passage_and_clashing_names(spark, monkeypatch):
    rnd = random.Random(31)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    hot = say(70)
    texts = [say(rnd.randint(1, 30)) + hot + say(rnd.randint(1, 30)) for _ in range(80)] + [hot] * 12 + [say(100)] * 2
    want = brute_repeats([t.encode() for t in texts], 40)
    names = "doc_id long, text string, row long, row2 string, marks string, doc string, c0 string"
    docs = spark.createDataFrame([(i, t, 1, "a", "b", "c", "d") for i, t in enumerate(texts)], names).repartition(3)
    monkeypatch.setattr(repeat_spans, "SHARD_BYTES", 400)  # more distinct runs of an anchor than fill a shard
    seen = []
    real = repeat_spans._dealt_windows
    monkeypatch.setattr(repeat_spans, "_dealt_windows", lambda *a: seen.append(1) or real(*a))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_spans.report(docs, 40, 16).collect()}
    assert got == dict(enumerate(want)) and seen
    left = repeat_spans.without_repeats(docs, 40, 16)
    assert left.schema == docs.schema and all(r[2:] == (1, "a", "b", "c", "d") for r in left.collect())


def test_repeats_in_a_very_long_text(spark, monkeypatch):
    rnd = random.Random(32)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    monkeypatch.setattr(repeat_spans, "SEGMENT", 3000)
    passages = [say(n) for n in (300, 399, 400, 401, 900)]
    texts = [say(2700) + "".join(p + say(150) for p in passages) + say(9000), *(say(50) + p + say(60) for p in passages)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_spans.report(docs).collect()}
    want = brute_repeats([t.encode() for t in texts], 400)
    assert got == dict(enumerate(want)) and [w[1] >= 400 for w in want[1:]] == [False, False, True, True, True]


def test_repeats_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeat_spans.report(empty).count() == 0 and repeat_spans.without_repeats(empty).count() == 0
    same = spark.createDataFrame([(1, "x y " * 150), (1, "x y " * 150), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in repeat_spans.report(same).collect())
    assert got == [(0, 0), (1, 600), (1, 600)]


def shuffled_bytes(spark, run):
    """What ``run`` writes to shuffles."""
    store, nothing = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm.java.util.ArrayList()

    def written():
        store.listenerBus().waitUntilEmpty(30_000)
        stages = store.statusStore().stageList(nothing, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), nothing)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    out = run()
    return out, written() - before


def test_repeats_move_only_texts_that_meet_a_run_or_a_mark(spark):
    rnd = random.Random(33)
    say = lambda n: "".join(chr(rnd.randint(33, 125)) for _ in range(n))
    shared = [say(500), say(450)]
    texts = [say(3000) for _ in range(300)] + [say(500) + p + say(500) for p in shared for _ in range(3)] + [say(700)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = docs.localCheckpoint()
        got, moved = shuffled_bytes(spark, lambda: {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_spans.report(docs).collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 400)))
    assert 0 < moved < 0.8 * sum(map(len, texts))  # the runs and a few texts; whole texts twice would be more


def test_repeats_without_room_for_the_filter(spark, monkeypatch):
    rnd = random.Random(34)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = say(90)
    texts = [say(rnd.randint(1, 200)) + rnd.choice([passage, ""]) + say(rnd.randint(1, 60)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(row_filter, "FILTER_BYTES", 0)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_spans.report(docs, 40, 16).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 40)))


def test_row_filter(spark):
    rnd = np.random.default_rng(4)
    ids, others = rnd.integers(0, 1 << 63, (2, 50_000)).astype(U64) << U64(1)
    slot = (ids % U64(row_filter.SLICES)).astype(int)
    made = row_filter.Filter({k: row_filter.build(ids[slot == k], 1 << 20) for k in set(slot.tolist())})
    assert made.passes(ids).all() and made.passes(others).mean() < 0.02
    tight = row_filter.Filter({k: row_filter.build(ids[slot == k], 100) for k in set(slot.tolist())})
    assert tight.passes(ids).all() and tight.passes(others).all() and not row_filter.Filter({}).passes(ids).any()
    rows = spark.range(4000).selectExpr("id", "xxhash64(id) AS key").repartition(3)
    kept = {r.id for r in rows.filter(row_filter.passing(rows.filter("id % 10 = 3"), "key")).collect()}
    assert kept >= set(range(3, 4000, 10)) and len(kept) < 500
    assert rows.filter(row_filter.passing(rows.filter("id < 0"), "key")).count() == 0


def test_pipeline_removes_passages_of_over_50_words(spark):
    import corpus_pipeline

    rnd = random.Random(9)
    say = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 8))) for _ in range(n))
    passage = {n: say(n) for n in range(45, 71)}
    assert sum(len(passage[n]) < 400 for n in range(51, 71)) > 10
    own = [(f"{say(80)} end{k}", f"on{k} {say(90)}") for k in range(2 * len(passage))]
    texts = [f"{a} {p if k % 2 else p.upper().replace(' ', chr(10))} {b}" for k, ((a, b), p) in enumerate(zip(own, [p for p in passage.values() for _ in range(2)]))]
    long = " ".join("x" * 30 + say(1) for _ in range(20))  # few words, but over 400 bytes
    texts += [f"{say(60)} {long} {say(60)}" for _ in range(2)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    for k, n in enumerate(n for n in passage for _ in range(2)):
        a, b = own[k]
        assert got[k] == (f"{a}  {b}" if n >= 51 else texts[k]), n
    assert long not in got[len(own)] and long not in got[len(own) + 1]


def test_tiles_of_reordered_passages():
    h = lambda s: np.array([zlib.crc32(w.encode()) for w in s.split()], U64)
    item = h("a b c d e f g h i j k l")
    doc = h("x g h i j k l y z a b c d e f x")
    assert sorted(tiling.tiles(item, doc, 5)) == [(0, 9, 6), (6, 1, 6)]
    assert tiling.tiles(item, h("a b c d"), 5) == [] and tiling.tiles(h(""), doc, 5) == []
    rnd = random.Random(2)
    for _ in range(200):
        p = np.array([rnd.randint(0, 3) for _ in range(rnd.randint(0, 30))], U64)
        q = np.array([rnd.randint(0, 3) for _ in range(rnd.randint(0, 40))], U64)
        laid = tiling.tiles(p, q, 3)
        a, b = [], []
        for i, j, k in laid:
            assert (p[i : i + k] == q[j : j + k]).all()
            a += range(i, i + k)
            b += range(j, j + k)
        assert len(a) == len(set(a)) and len(b) == len(set(b))
        if laid:  # the longest common run is laid first
            longest = max((n for i in range(len(p)) for j in range(len(q)) for n in [next((k for k in range(min(len(p) - i, len(q) - j)) if p[i + k] != q[j + k]), min(len(p) - i, len(q) - j))]), default=0)
            assert max(k for *_, k in laid) == longest


def plain_tiles(item, doc, least):
    """Greedy string tiling as it is defined: all longest common runs of what is free, one after the other."""
    free_i, free_d, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and free_i[i + k] and free_d[j + k] and item[i + k] == doc[j + k]:
                    k += 1
                best.append((-k, i, j))
        if not best or -min(best)[0] < max(1, min(least, len(item))):
            return out
        k, i, j = min(best)
        for d in range(-k):
            free_i[i + d] = free_d[j + d] = False
        out.append((i, j, -k))


def test_tiles_match_the_definition():
    rnd = random.Random(21)
    for n in range(300):
        words = 4 if n % 2 else 30
        p = [rnd.randint(0, words) for _ in range(rnd.randint(0, 45))]
        q = [rnd.randint(0, words) for _ in range(rnd.randint(0, 20))] + p[rnd.randint(0, 20) :] + p[: rnd.randint(0, 30)]
        assert sorted(tiling.tiles(np.array(p, U64), np.array(q, U64), 3)) == sorted(plain_tiles(p, q, 3)), n


def test_decontamination(spark, monkeypatch):
    rnd = random.Random(3)
    say = lambda n: [f"w{rnd.randint(0, 500)}" for _ in range(n)]
    items = [say(30) for _ in range(6)] + [["tiny", "item"]]
    clean = [" ".join(say(100)) for _ in range(10)]
    whole = " ".join(say(20) + items[0] + say(20)).upper() + "."
    turned = " ".join(say(10) + items[1][15:] + say(5) + items[1][:15])
    small = " ".join(say(10) + items[2][:8])
    texts = [*clean, whole, turned, small, None, "", "a Tiny, item: here"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, coverage string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    want = sorted([*range(10), 12, 13, 14])
    assert sorted(r.doc_id for r in tiling.decontaminated(docs, bench).collect()) == want
    best = {r.doc_id: r for r in tiling.overlaps(docs, bench).collect()}
    assert best[10].best_item == 0 and best[10].coverage == 1 and best[11].best_item == 1 and best[11].n_tiles == 2
    monkeypatch.setattr(tiling, "PART_BYTES", 300)  # several broadcasts
    parted = {r.doc_id: r for r in tiling.overlaps(docs, bench).collect()}
    assert {k: (r.best_item, r.coverage, r.n_items) for k, r in parted.items()} == {k: (r.best_item, r.coverage, r.n_items) for k, r in best.items()}
    monkeypatch.setattr(tiling, "PARTS_AT_ONCE", 1)
    assert sorted(r.doc_id for r in tiling.decontaminated(docs, bench).collect()) == want
    monkeypatch.undo()
    twice = tiling.overlaps(docs.unionByName(docs), bench)
    assert twice.count() == 2 * len(texts) and tiling.decontaminated(docs.unionByName(docs), bench).count() == 2 * len(want)
    long = spark.createDataFrame([(1, "some other words " * 40_000 + whole), (2, "some other words " * 40_000)], "doc_id long, text string")
    assert [r.doc_id for r in tiling.decontaminated(long, bench).collect()] == [2]
    assert tiling.decontaminated(docs, bench.limit(0)).count() == len(texts) and tiling.decontaminated(docs.limit(0), bench).count() == 0


def test_log_bloom_filter():
    rnd = np.random.default_rng(4)
    items, counts = rnd.integers(0, 1 << 47, 20_000).astype(U64), np.minimum(rnd.zipf(1.5, 20_000), 10**6)
    f = log_bloom.Filter([log_bloom.build(items[:10_000], counts[:10_000], 1 << 20), log_bloom.build(items[10_000:], counts[10_000:], 1 << 20)])
    bucket = np.repeat([0, 1], 10_000)
    got = f.levels(items, bucket)
    assert (got >= log_bloom.levels(counts)).all() and (got == log_bloom.levels(counts)).mean() > 0.98
    assert (f.levels(rnd.integers(1 << 47, 1 << 48, 20_000).astype(U64), bucket) == 0).mean() > 0.97
    tight = log_bloom.build(items, counts, 2000)
    assert len(tight.data) <= 2000 and tight.least > 1


def test_language_model_base_and_score(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["the", "of", "and", f"x{rnd.randint(0, 300)}"]) for _ in range(rnd.randint(1, 80))) for _ in range(150)]
    texts += [None, "", "The OF\tand", texts[0], texts[0], "never seen words only"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    got = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    rows = [(t or "").encode().lower().split() + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = collections.Counter(w for r, h in zip(rows, held) if not h for w in r)
    n, v = sum(c.values()), len(c)
    for i, r in enumerate(rows):
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[i], len(r), sum(c[w] > 0 for w in r), n)
        assert math.isclose(g.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in r), abs_tol=1e-6)
        assert g.score < 0
    train = [i for i in range(150) if not held[i]]
    assert sum(got[i].score for i in train) > sum(got[i].base_score for i in train)
    twice = language_model.score_documents(docs.filter("doc_id < 5").unionByName(docs.filter("doc_id < 5"))).collect()
    assert len(twice) == 10 and len({(r.doc_id, round(r.base_score, 9)) for r in twice}) == 5
    assert language_model.score_documents(docs.limit(0)).count() == 0


def test_language_model_deals_by_tokens_not_by_splits(spark, monkeypatch):
    texts = [None, "", " ", "one", "\x0b A\tb  c\n", *(" ".join(f"w{i * j % 997}" for j in range(400)) for i in range(50))]
    assert [language_model.token_count([(t or "").encode()]) for t in texts] == [len((t or "").split()) + 1 for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    want = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    dealt, seen = language_model._dealt, []
    monkeypatch.setattr(language_model, "_dealt", lambda blocks, buckets: seen.append(buckets) or dealt(blocks, buckets))
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", 1000)
    got = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    assert seen == [-(-sum(r.n_tokens for r in got.values()) // 1000)] and seen[0] > 4
    for i, r in want.items():
        assert r[:5] == got[i][:5] and math.isclose(r.base_score, got[i].base_score, abs_tol=1e-6)


def test_language_model_stores_blocks_uncompressed_by_the_row(spark, monkeypatch):
    import pyarrow.parquet as pq

    stored, made = language_model.runtime.stored, {}
    monkeypatch.setattr(language_model.runtime, "stored", lambda s, df, tag, *more: made.setdefault(tag, stored(s, df, tag, *more)))
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(30)], "doc_id long, text string").coalesce(1)
    assert language_model.score_documents(docs).count() == 30
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in made["blocks"].inputFiles()]
    chunks = [f.metadata.row_group(g).column(c) for f in files for g in range(f.num_row_groups) for c in range(f.metadata.num_columns)]
    assert chunks and {c.compression for c in chunks} == {"UNCOMPRESSED"}


def test_language_model_leaves_no_count_out(monkeypatch):
    real = log_bloom.build

    def build(items, counts, *bound):
        assert not bound, "a bound on the filter leaves rare pairs out"
        return real(items, counts)

    monkeypatch.setattr(log_bloom, "build", build)
    rnd, buckets = random.Random(8), 3
    blocks = [[" ".join(f"w{int(rnd.paretovariate(0.4)) % 900}" for _ in range(rnd.randint(0, 60))).encode() for _ in range(100)] for _ in range(2)]
    held = [np.array([rnd.random() < 0.2 for _ in texts]) for texts in blocks]
    items = [language_model.Items(texts, ~h, buckets) for texts, h in zip(blocks, held)]
    met = [language_model._met(pa.table({"bucket": [b] * 2, "block": [0, 1], "items": pa.array([i.dealt(b) for i in items], pa.binary())})) for b in range(buckets)]
    rows = [r for m in met for r in m.to_pylist()]
    n, v = (sum(r[c] or 0 for r in rows) for c in ("tokens", "kinds"))
    words = [[[None, *t.split(), None] for t in texts] for texts in blocks]
    taught = [w for ws, h in zip(words, held) for w, x in zip(ws, h) if not x]
    one, two = collections.Counter(x for w in taught for x in w[1:]), collections.Counter(x for w in taught for x in zip(w, w[1:]))
    assert (n, v) == (sum(one.values()), len(one))
    middle = lambda c: float(log_bloom.middle(log_bloom.levels(np.array([c])))[0])
    for k, (texts, h) in enumerate(zip(blocks, held)):
        of = {r["bucket"]: r["answer"] for r in rows if r["block"] == k}
        packed = pa.Codec("zstd", 1).compress(b"".join(texts), asbytes=True)
        block = pa.table({"ids": [list(range(100))], "held": [h.tolist()], "sizes": [[len(t) for t in texts]], "texts": pa.array([packed], pa.binary())})
        got = language_model._scored(block, pa.table({"bucket": list(of), "answer": pa.array(list(of.values()), pa.binary())}), n, v, buckets)
        want = [sum(math.log10((min(middle(two[x, y]), middle(one[x]), middle(one[y])) + 8 * (middle(one[y]) + 1) / (n + v + 1)) / (middle(one[x]) + 8)) for x, y in zip(w, w[1:])) for w in words[k]]
        close = [math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got["score"].to_pylist(), want)]
        assert sum(close) >= 80  # a false membership of the filter can raise a count
        lacking = [i for b in range(buckets) for i in range(*items[k].pair_cut[b : b + 2]) if of[b][9 * (items[k].kind_cut[b + 1] - items[k].kind_cut[b]) + i - items[k].pair_cut[b]] < (items[k].times[i] > 0)]
        assert not lacking


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(6)
    say = lambda n: " ".join(f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{rnd.randint(0, 999)}x" if i % 9 == 8 else rnd.choice(["the", "and", "of", "river", "stone", "light", "walks", "under", "green", "silent"]) for i in range(n))
    letters = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    clean = [letters(120) for _ in range(8)]
    item = letters(30)
    texts = [*clean, clean[0], "# $ % " * 100, letters(60) + " " + item, say(3), None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    assert sorted(r.doc_id for r in now.collect()) == list(range(8))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(range(8))
