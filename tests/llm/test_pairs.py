"""Operators on pairs against brute force, with nulls, copies, empty tables and hot groups."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import ODD, SCHEMA, empty, frame, prose, words
from tidelog.llm import graph, jaccard, near_vectors, passages, shared, topk


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def edited(seed, text, changes):
    r = random.Random(seed)
    w = text.split()
    for _ in range(changes):
        i = r.randrange(len(w))
        w[i : i + 1] = r.choice([[f"new{r.randrange(10**6)}"], [], [w[i], f"more{r.randrange(10**6)}"]])
    return " ".join(w)


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(4000, 4400)] + [(7, 7)]
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()}
    want = roots({n for link in links for n in link}, links)
    assert got == {n: c for n, c in want.items() if any(n in link for link in links if link[0] != link[1])}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_connects_as_all_links_do():
    r = np.random.default_rng(3)
    for _ in range(30):
        a, b = r.integers(0, 40, 60), r.integers(0, 40, 60)
        at = graph.forest(a, b)
        nodes = set(range(40))
        assert roots(nodes, zip(a.tolist(), b.tolist())) == roots(nodes, zip(a[at].tolist(), b[at].tolist()))


def sets(texts):
    out = {}
    for i, t in texts:
        w = words(t)
        out[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    return out


def check_jaccard(df):
    texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    s = sets(texts)
    ids = sorted(s)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if s[a] and s[b] and 0.9 <= len(s[a]) / len(s[b]) <= 1 / 0.9 and 100 * len(s[a] & s[b]) >= 90 * len(s[a] | s[b])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    comp = roots(ids, links)
    assert got == {i: (len(s[i]), comp[i]) for i in ids}
    return links


BASES = [prose(i, n) for i, n in enumerate((3, 9, 12, 20, 40, 80, 150, 400))]


def test_jaccard_join_of_many_sizes(spark):
    texts = ODD + ODD[3:5]
    for i, b in enumerate(BASES):
        texts += [b, b.upper(), b + " end"] + [edited(100 * i + j, b, max(1, len(b.split()) // 60) * (1 + j % 3)) for j in range(8)]
    random.Random(1).shuffle(texts)
    assert len(check_jaccard(frame(spark, texts))) > 30


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_jaccard_join_of_one_large_group(spark, edits):
    """A chain of edits and clouds of near misses around one text and around a copy far from it."""
    texts, last = [], BASES[6]
    for i in range(40):
        last = edited(i, last, edits)
        texts.append(last)
    far = edited(999, BASES[6], 12)
    for base in (BASES[6], far):
        texts += [edited(1000 + i, base, edits + i % 4) for i in range(50)]
    random.Random(edits).shuffle(texts)
    assert check_jaccard(frame(spark, texts))


def test_jaccard_join_of_nothing(spark):
    assert jaccard.jaccard_components(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c", None, None, None, *["x"] * 5), (1, None, None, None, None, *["x"] * 5)], SCHEMA)
    assert [tuple(r) for r in jaccard.jaccard_components(nulls).collect()] == [(1, 0, 1)]
    with pytest.raises(ValueError):
        jaccard.jaccard_components(nulls, percent=80)


@pytest.mark.parametrize("k, percent", [(5, 80), (5, 85), (3, 80), (3, 93)])
def test_near_join_of_other_thresholds(spark, k, percent):
    """Chains and clouds of edits; at 5 words and 0.8 some pairs lie below 0.9 on 3 words."""
    texts = ODD + ODD[3:5]
    for i, b in enumerate(BASES):
        texts += [b, b.upper(), b + " end"] + [edited(100 * i + j, b, max(1, len(b.split()) // 60) * (1 + j % 4)) for j in range(12)]
    last = BASES[6]
    for i in range(30):
        last = edited(i, last, 1 + i % 3)
        texts.append(last)
    random.Random(1).shuffle(texts)
    grams = lambda t: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := words(t)) else set()
    s = {i: grams(t) for i, t in enumerate(texts)}
    links = [(a, b) for b in s for a in range(b) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_components(frame(spark, texts), k=k, percent=percent).collect()}
    comp = roots(s, links)
    assert len(links) > 30 and got == {i: (len(s[i]), comp[i]) for i in s}


def test_near_join_of_overlapping_regions(spark):
    """A cloud around one text, most of it beyond the radius of whichever member is a pivot, so that its regions hold the same members."""
    texts = [edited(1000 + i, BASES[6], 2 + i % 5) for i in range(160)]
    grams = lambda t: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set()
    s = {i: grams(t) for i, t in enumerate(texts)}
    links = [(a, b) for b in s for a in range(b) if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    comp = roots(s, links)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_components(frame(spark, texts)).collect()}
    assert got == {i: comp[i] for i in s}
    assert 10 < len(links) and 10 < len(set(comp.values()))


def test_sub_spaces_leave_few_sets_out():
    r = np.random.default_rng(2)
    for percent in (80, 90):
        for n in (100, 400, 2000):
            h, doc = r.integers(0, 2**63, 40 * n).astype(np.uint64), np.repeat(np.arange(40), n)
            sig, _ = jaccard.signatures(h, doc, np.full(40, n), percent)
            assert len(np.unique(sig)) >= 0.98 * len(sig)  # unrelated sets meet in no empty sub-set


def test_windows_are_the_cartesian_tree():
    r = np.random.default_rng(1)
    for n, width in ((200, 10), (90, 46), (50, 46), (45, 46), (300, 7)):
        v = r.integers(0, 60 if n == 300 else 2**60, n).astype(np.uint64) * np.uint64(2)
        doc = np.repeat([0, 1], [n // 3, n - n // 3])
        got = set(zip(*(x.tolist() for x in passages.windows(v, doc, width))))
        want = set()
        for c in range(n):
            a = b = 0
            while a < width and c - a - 1 >= 0 and doc[c - a - 1] == doc[c] and v[c - a - 1] > v[c]:
                a += 1
            while b < width and c + b + 1 < n and doc[c + b + 1] == doc[c] and v[c + b + 1] >= v[c]:
                b += 1
            if a + b + 1 >= width:
                want.add((c, a, b))
        assert {x[0] for x in got} == {x[0] for x in want}


def repeats(texts, n=50):
    """Words of each document in a run of n words that a document of smaller id has."""
    first, out = {}, defaultdict(set)
    for i, t in sorted((i, t) for i, t in texts if t):
        w = words(t)
        for j in range(len(w) - n + 1):
            key = tuple(w[j : j + n])
            if first.setdefault(key, i) != i:
                out[i].update(range(j, j + n))
    return out


def passage_texts():
    shared = [prose(900 + i, 70, 5000) for i in range(3)]
    texts = list(ODD) + [ODD[9], prose(1, 49, 50)]
    for i in range(60):
        parts = [prose(2000 + i, 40 + i, 5000), shared[i % 3], prose(3000 + i, 30, 5000)]
        if i % 10 == 0:
            parts.insert(1, "all rights reserved by the makers of this text")
        texts.append(" ".join(parts) if i % 4 else "\n".join(parts).upper())
    texts += [texts[20]] * 5 + [prose(5000 + i, 120, 5000) for i in range(10)]
    return texts


def test_repeated_passages_are_all_found(spark):
    texts = list(enumerate(passage_texts()))
    got = passages.repeated_passages(frame(spark, [t for _, t in texts])).collect()
    want, have = repeats(texts), defaultdict(set)
    for r in got:
        assert r["of_doc_id"] < r["doc_id"] and r["similarity"] >= 0.8
        t = texts[r["doc_id"]][1]
        assert words(t[r["start"] : r["end"]]) == words(t)[r["first_word"] : r["last_word"]]
        have[r["doc_id"]].update(range(r["first_word"], r["last_word"]))
    assert want and all(w <= have[i] for i, w in want.items())
    assert set(have) == set(want)  # clean documents are left alone


def test_a_first_document_that_shares_too_little(spark):
    """Document 0 holds 30 words of the passage that the others share as a whole."""
    p = prose(77, 60, 5000).split()
    texts = [prose(1, 60, 5000) + " " + " ".join(p[15:45]) + " " + prose(2, 60, 5000)]
    texts += [prose(10 + i, 60, 5000) + " " + " ".join(p) + " " + prose(50 + i, 60, 5000) for i in range(6)]
    got = {(r["doc_id"], r["of_doc_id"]): (r["first_word"], r["last_word"]) for r in passages.repeated_passages(frame(spark, texts)).collect()}
    assert got == {(i, 1): (60, 120) for i in range(2, 7)}


def test_near_copies_of_a_passage(spark):
    p = prose(77, 90, 5000)
    texts = [prose(10 + i, 60, 5000) + " " + edited(i, p, i % 3) + " " + prose(50 + i, 60, 5000) for i in range(12)]
    got = {r["doc_id"] for r in passages.repeated_passages(frame(spark, texts)).collect()}
    assert len(got) >= 10


def test_cutting_repeats_keeps_one_copy_and_the_rest(spark):
    docs = frame(spark, passage_texts())
    out = {r["doc_id"]: r for r in passages.without_repeats(docs).collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    assert out[0]["text"] is None and not repeats((i, r["text"]) for i, r in out.items())
    every = " \n ".join(" ".join(words(r["text"])) for r in out.values() if r["text"])
    for i in range(3):
        assert prose(900 + i, 70, 5000) in every
    assert all(out[i]["key"] == before[i]["key"] for i in out)
    assert set(before) - set(out) == {len(ODD), *range(len(ODD) + 62, len(ODD) + 67)}  # whole copies
    assert passages.without_repeats(empty(spark)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, unit string, rep string"


def vectors(spark, seed=0, n=150):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, 16))
    base[40:80] = base[0] + r.normal(size=(40, 16)) * 0.12
    rows = [(i, [float(x) for x in v], 1, "u", "r") for i, v in enumerate(base.astype(np.float32))]
    rows += [(1000 + i, rows[5][1], 1, "u", "r") for i in range(6)] + [(2000, [2 * x for x in rows[6][1]], 1, "u", "r")]
    rows += [(3000, None, 1, "u", "r"), (3001, [0.0] * 16, 1, "u", "r"), (3002, [float("nan")] * 16, 1, "u", "r"), (3003, [None] * 16, 1, "u", "r"), (3004, [], 1, "u", "r"), (3005, [1.0, 2.0], 1, "u", "r")]
    return rows, spark.createDataFrame(rows, VECTORS)


@pytest.mark.parametrize("tile", [6000, 37])
def test_near_vectors(spark, tile):
    rows, df = vectors(spark)
    ok = {i: np.array(v, float) for i, v, *_ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    links = [(a, b) for a in ok for b in ok if a < b and cos(ok[a], ok[b]) >= 0.95]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = roots([r[0] for r in rows], links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df, tile=tile).collect()}
    assert len(links) > 100 and got == {i: (n[i], c, i == c) for i, c in comp.items()}
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("block, query_block, parts", [(4096, 1024, 4), (32, 2, 3), (8, 1, 16)])
def test_exact_topk(spark, block, query_block, parts):
    rows, df = vectors(spark, 3)
    ok = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v, *_ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(ok):
        if q % 50 == 0:
            best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:5]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    got = topk.exact_topk(df, F.col("vec_id") % 50 == 0, block=block, query_block=query_block, parts=parts).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want


def test_exact_topk_resolves_what_the_ranges_ship(spark):
    """Of 2,000 vectors in clusters, few pairs pass the cutoff's share; the result is among them."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 32))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.1 * r.normal(size=32)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    three = topk.TopK(df, F.col("vec_id") % 50 == 0, 5, 4, "vec_id", "embedding", 512, 16)
    out = three.run().join(three.rows.select("vec_id", "row"), "vec_id")
    assert out.count() == 40 * 5 and out.join(three.entries, ["query_id", "row"], "left_anti").count() == 0
    assert three.listed.count() <= 40 * 4 * 5
    assert three.entries.count() < 0.35 * 40 * 2000


def test_exact_topk_of_few_and_huge(spark):
    rows = [(0, [1e30, -1.0]), (50, [2.0, 3.0]), (51, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect())
    assert [(r[0], r[1], r[2]) for r in got] == [(0, 1, 50), (0, 2, 51), (50, 1, 0), (50, 2, 51)]
    assert got[3][3] == 512 * 256 + 768 * 256 and got[0][3] == 2**63 - 1
    assert topk.exact_topk(df.limit(0), F.lit(True)).count() == 0


def test_exact_topk_of_a_repeated_query_row(spark):
    rows, df = vectors(spark, 3)
    once = topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect()
    more = df.union(df.filter("vec_id = 50")).union(df.filter("vec_id = 50"))
    got = topk.exact_topk(more, F.col("vec_id") % 50 == 0).collect()
    mine = lambda x: sorted((r["rank"], r["vec_id"], r["score"]) for r in x if r["query_id"] == 50)
    assert len(mine(once)) == 5 and mine(got) == mine(once)


@pytest.mark.parametrize("before", [False, True])
def test_a_common_phrase_beside_a_near_copy(before):
    """60 words with one edit in the middle are 51 / 61 alike; with 8 other words and 5 shared ones, 52 / 86."""
    p, phrase = prose(5, 60, 10**6).split(), "all rights reserved by us".split()
    a = p + prose(6, 8, 10**6).split() + phrase
    b = p[:30] + ["edit"] + p[31:] + prose(7, 8, 10**6).split() + phrase
    if before:
        a, b = a[::-1], b[::-1]
    ids = {w: n for n, w in enumerate(dict.fromkeys(a + b))}
    a, b = (np.array([ids[w] for w in x], np.uint64) for x in (a, b))
    at = 13 if before else 0
    anchors = np.array([[c, at, at + 55, c, at, at + 55] for c in (at + 10, at + 40)])
    want = (at, at + 60, at, at + 60)
    assert [f[:4] for f in passages.verify(a, b, anchors, 5, 50, 0.8)] == [want]
    pair = passages.Pair(a, b, 5)
    assert pair.similarity(0, len(a), 0, len(b)) < 0.8 <= pair.similarity(*want)


def test_near_copies_beside_smaller_documents_that_hold_a_part(spark):
    """Two copies of a passage, one with an edit, and two smaller documents that hold a part of it that is no passage."""
    texts, want = [], set()
    for i in range(30):
        p = prose(700 + i, 60, 10**6).split()
        for n, x in enumerate((p[:36], p[:36], p, p[:40] + ["edit"] + p[41:])):
            texts.append(f"{prose(10000 + 10 * i + n, 30, 10**6)} {' '.join(x)} {prose(20000 + 10 * i + n, 30, 10**6)}")
        want.add((4 * i + 3, 4 * i + 2))
    got = {(r["doc_id"], r["of_doc_id"]) for r in passages.repeated_passages(frame(spark, texts)).collect()}
    assert got == want


def test_every_near_copy_meets(spark):
    """One edit in the middle of 50 words leaves runs of 25 and 24 words and a similarity of 41 / 51."""
    texts = []
    for i in range(400):
        p = prose(500 + i, 50, 10**6).split()
        texts += [f"{prose(3 * i + 10000, 20, 10**6)} {' '.join(x)} {prose(3 * i + 50000 + n, 20, 10**6)}" for n, x in enumerate((p, p[:25] + ["edit"] + p[26:]))]
        texts[-1] = f"{prose(i + 90000, 20, 10**6)} " + texts[-1].split(" ", 20)[20]
    got = {r["doc_id"] for r in passages.repeated_passages(frame(spark, texts)).collect()}
    assert got == set(range(1, 800, 2))


def test_a_settled_member_is_the_partner_of_an_open_one(spark):
    """A and C link, C and B link, A and B don't: B has its row with C."""
    p = prose(1, 60, 10**6).split()
    c, b = p[:30] + ["x"] + p[31:], p[:30] + ["x"] + p[31:45] + ["y"] + p[46:]
    texts = [f"{prose(10 + n, 40, 10**6)} {' '.join(t)} {prose(20 + n, 40, 10**6)}" for n, t in enumerate((p, c, b))]
    got = {(r["doc_id"], r["of_doc_id"]) for r in passages.repeated_passages(frame(spark, texts)).collect()}
    assert got == {(1, 0), (2, 1)}


def test_exact_topk_in_rounds_of_queries(spark):
    """Rounds give what one gives, and leave no entries or lists of theirs behind."""
    rows, df = vectors(spark, 3)
    df = df.withColumn("vec_id", F.when(F.col("vec_id") < 150, F.col("vec_id") * 25).otherwise(F.col("vec_id") * 50 + 7))
    whole = sorted(map(tuple, topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect()))
    three = topk.TopK(df, F.col("vec_id") % 50 == 0, 5, 2, "vec_id", "embedding", 64, 8, 20)
    assert three.rounds == 4 and sorted(map(tuple, three.run().collect())) == whole and len(whole) == 75 * 5
    assert not any(os.path.exists(t.settled_at.removeprefix("file:")) for t in (three.listed, three.cutoff, three.shipped))


def test_regions_are_joined_in_rounds_of_bounded_size(spark, monkeypatch):
    """A round measures about a fourth as many members as there are sets, and leaves nothing but its pairs."""
    monkeypatch.setattr(jaccard, "FEW", 400)
    texts = [edited(1000 + i, BASES[6], 2 + i % 5) for i in range(160)]
    rounds, kept = [], shared.settle

    def settle(df, tag="t"):
        out = kept(df, tag)
        if tag in ("measured", "places", "near"):
            rounds.append((tag, out, out.count()))
        return out

    monkeypatch.setattr(shared, "settle", settle)
    measured = jaccard._measured

    def whole(pairs, sets, percent, *least):
        asked.append(pairs.filter("region").count())
        return measured(pairs, sets, percent, *least)

    asked = []
    monkeypatch.setattr(jaccard, "_measured", whole)
    drops = []
    drop = shared.drop
    monkeypatch.setattr(shared, "drop", lambda s, *t: (drops.extend(t), drop(s, *t)))
    jaccard.near_components(frame(spark, texts))
    assert sum(n > 0 for n in asked) > 1
    places = [t for tag, t, _ in rounds if tag == "places"]
    assert len(places) > 1 and all(any(t is d for d in drops) for t in places)


def test_documents_of_repeated_lines_meet_once():
    """Places of one line in two documents make pairs by the square; a pair's passages are those of all its places."""
    from collections import Counter

    r = __import__("random").Random(3)
    lines = [prose(40 + i, 26, 10**6) for i in range(4)]
    shared = prose(7, 55, 10**6)
    texts = [" ".join([*(f"{r.choice(lines)} {prose(1000 * n + i, 12, 10**6)}" for i in range(40)), shared if n else "", *(f"{r.choice(lines)} {prose(5000 * n + i, 12, 10**6)}" for i in range(40))]) for n in range(3)]
    ids = {w: n for n, w in enumerate(dict.fromkeys(" ".join(texts).split()))}
    a, b, c = (np.array([ids[w] for w in t.split()], np.uint64) for t in (texts[2], texts[1], texts[0]))
    asked, plain = Counter(), passages.Pair._similarity

    def counted(pair, *where):
        asked[where] += 1
        return plain(pair, *where)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(passages.Pair, "_similarity", counted)
        centres = np.arange(len(a) - 11)
        assert [f[1] - f[0] >= 55 for f in passages.meet(a, b, centres, 5, 50, 0.8)] == [True]
        assert passages.meet(a, b, centres, 5, 50, 0.8, most=50) == passages.meet(a, b, centres, 5, 50, 0.8)
        asked.clear()
        assert passages.meet(a, c, centres, 5, 50, 0.8) == []
        assert not asked or max(asked.values()) == 1


def test_runs_that_nothing_continues_are_not_extended(monkeypatch):
    """A line of 30 words, 40 times in two texts among other words, makes 1600 runs and no passage."""
    line, asked = prose(3, 30, 10**6), []
    texts = [" ".join(f"{line} {prose(1000 * n + i, 30, 10**6)}" for i in range(40)) for n in (1, 2)]
    ids = {w: n for n, w in enumerate(dict.fromkeys(" ".join(texts).split()))}
    a, b = (np.array([ids[w] for w in t.split()], np.uint64) for t in texts)
    plain = passages.extend
    monkeypatch.setattr(passages, "extend", lambda *x: asked.append(x) or plain(*x))
    c, d = (x.ravel() for x in np.meshgrid(np.arange(40) * 60, np.arange(40) * 60))
    out, covered = [], np.zeros(len(a), bool)
    passages._extended(passages.Pair(a, b, 5), a, b, c, d - c, 50, 0.8, covered, out)
    assert not out and not asked
    # With the words after it, a line is a passage up to the end of the next line.
    b[1230:1260] = a[630:660]
    b[1245] = 10**9
    passages._extended(passages.Pair(a, b, 5), a, b, c, d - c, 50, 0.8, covered, out)
    assert [x[:4] for x in out] == [(600, 690, 1200, 1290)] and 0 < len(asked) < 100


def test_similarities_of_all_ranges_from_a_start():
    """Against sets, on texts of few words, and asked for in any order."""
    r = np.random.default_rng(5)
    for _ in range(30):
        a, b = (r.integers(0, 3, r.integers(20, 120)).astype(np.uint64) for _ in range(2))
        pair, grams = passages.Pair(a, b, 3), lambda w: {tuple(w[i : i + 3].tolist()) for i in range(len(w) - 2)}
        ends = sorted({(int(y), int(y) + int(r.integers(-3, 3))) for y in r.integers(8, min(len(a), len(b)) - 3, 6)})
        ends = [(y, f) for n, (y, f) in enumerate(ends) if all(f > g for _, g in ends[:n])]
        for x, t, n in [(0, 2, 0), (3, 0, 0), (0, 2, -1), (3, 0, -1)]:
            want = [len(p & q) / max(1, len(p | q)) for y, f in ends[n:] for p, q in [(grams(a[x:y]), grams(b[t:f]))]]
            assert pair.similarities(x, t, ends[n:]).tolist() == want


def test_texts_of_a_join_are_shuffled_in_parts(spark, monkeypatch):
    """All texts at once were on disk for one shuffle, beside all sets."""
    from tidelog.llm import shared

    sets, plain = [], shared.settle

    def settle(df, tag="t"):
        out = plain(df, tag)
        if tag == "sets":
            sets.append(out.count())
        return out

    monkeypatch.setattr(shared, "settle", settle)
    monkeypatch.setattr(jaccard, "FEW", 50)
    texts = [edited(i, prose(i // 2, 60, 5000), i % 2) for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_components(frame(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(200)}
    assert len(sets) > 1 and max(sets) < 0.6 * sum(sets)
