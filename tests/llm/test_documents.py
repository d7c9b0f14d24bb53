"""Operators on single documents against the plain way to do the same."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.common import ODD, empty, frame, prose, words
from tidelog.llm import bpe, langid, lm, packing, pii, queries, text

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = frame(spark, ODD, 10**6).select("doc_id", "text", "lang")
    return rows.union(odd).union(odd.limit(3)).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_language_id_on_held_out_rows(spark, sf_dir):
    got = queries.op1_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["rejected"] for r in got) == 0


def test_language_id_of_odd_texts(spark, docs):
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(frame(spark, ODD), model, ["doc_id", "score", "rejected"], prefix="p_").collect()}
    for i, t in enumerate(ODD):
        und = not re.search(r"[^\W\d_]", t or "")
        assert (got[i]["p_lang_pred"] == "und") == und and (not und or (got[i]["p_score"] == 0 and got[i]["p_rejected"]))
    nothing = langid.fit(empty(spark))
    assert [r["lang_pred"] for r in langid.predict(frame(spark, ["some text"]), nothing, ["doc_id"]).collect()] == ["und"]
    assert langid.predict(empty(spark), model, ["doc_id"]).count() == 0


def test_language_id_equals_plain_centroids(spark, docs, texts):
    """TF-IDF of byte n-grams and cosines with each centroid, in plain Python."""
    model = langid.fit(docs)

    def vector(t):
        folded = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", t.encode().lower() if t.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()))
        tf = Counter()
        for n, odd in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
            for i in range(len(folded) - n + 1):
                x = 0
                for c in folded[i : i + n]:
                    x = (x * 257 + c) % 2**32
                tf[(x * odd % 2**32) >> 19] += 1
        w = {k: (1 + math.log(c)) * model.idf[k] for k, c in tf.items()}
        size = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {k: x / size for k, x in w.items()}

    got = {r["doc_id"]: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    for i, t in texts[:40] + texts[-len(ODD) :]:
        if not re.search(r"[^\W\d_]", t or ""):
            continue
        w = vector(t)
        near = [sum(x * float(c[k]) for k, x in w.items()) for c in model.centroids]
        best = max(near)
        assert got[i]["score"] == pytest.approx(min(1, max(0, best)), abs=1e-4)
        assert near[model.langs.index(got[i]["lang_pred"])] <= best + 1e-9
        assert max(n for n, name in zip(near, model.langs) if name == got[i]["lang_pred"]) == pytest.approx(best, abs=1e-4)


def test_many_short_rows_are_weighed_in_parts(spark, docs):
    model, n = langid.fit(docs), []
    batch = pa.record_batch([pa.array(["ab cd"] * 5000)], names=["text"])
    run = text.by_slice("text", lambda b: n.append(b.num_rows) or b, langid.SLICE, langid.ROWS)
    assert sum(b.num_rows for b in run([batch])) == 5000 and max(n) == langid.ROWS
    names = frame(spark, ["le chat est sur la table"] * 3).withColumnRenamed("key", "__text")
    assert langid.predict(names, model, ["doc_id", "__text"]).count() == 3


def test_foreign_script_is_rejected(spark, docs):
    model = langid.fit(docs)
    (r,) = langid.predict(frame(spark, ["цкщ фывжэ хъщз юбьт " * 30]), model, ["doc_id"]).collect()
    assert r["rejected"] and r["lang_pred"] != "und"


def test_bpe_equals_the_library(docs, texts):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expect = sorted((i, len(ids := want.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    got = sorted(tuple(r) for r in bpe.digests(docs, path, P.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == expect
    rows = bpe.encode(docs, path, P.PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(rows, path, P.PATTERN).collect()}
    assert all(back[i] == (t or "").encode() for i, t in texts)


def test_bpe_of_very_long_words():
    import random

    import tiktoken

    path, r = P.path("byte_bpe_50k.tiktoken"), random.Random(9)
    ranks = bpe.load_ranks(path)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Coder(ranks, P.PATTERN)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(of) for _ in range(n))
    texts = [letters(n) for n in (65, 200, 1000, 8000)] + [letters(n, "aab") for n in (70, 3000)] + ["a" * 100_001, "é" * 500, "!" * 777, "ab" * 50_000]
    for t, got in zip(texts, coder.encode(texts)):
        assert got.tolist() == want.encode_ordinary(t)
    assert b"".join(coder.engine.decode([coder.encode([t])[0] for t in texts])).decode() == "".join(texts)


def test_bpe_refuses_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [999_999])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert bpe.digests(empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


PII_TEXTS = [
    "a@b.c, x..y@z-1.co.uk @no.pe q@w r@s.t@u.v é@ü.de me@x.",
    "1.2.3.4 256.1.1.1 1.2.3.4.5 001.02.3.255 9.9.9",
    "4111 1111 1111 1111, 4111-1111-1111-1112 378282246310005 card 12345678901234567890",
    "amex card: 378282246310005.",
    "+49 (30) 123-4567 call +1 2 +123456789012345678 +1-(202).555 0147.",
    "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001 ssn 123-45-6789 000-12-3456 or 987-65-4321",
    "é 😀 a@b.cc +4912345678", "1" * 3000, "a" * 3000 + "@", "1.2.3." * 400, "12.34.5.6.7.8.9.10.11 1..2.3.4.5 1.2.3.4444",
]


@pytest.mark.parametrize("text", ["7" * 400_000, "7." * 200_000, "1.2.3." * 100_000, "a" * 400_000 + "@", "@" * 200_000, "+1(" * 100_000, "1 2-" * 100_000, "AB12 " * 80_000])
def test_pii_takes_linear_time(text):
    import time

    began = time.perf_counter()
    pii.find(text)
    assert time.perf_counter() - began < 10


def test_pii_base_spans(spark):
    texts = ODD + PII_TEXTS
    got = {r["doc_id"]: r["found"] for r in pii.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i] if s["kind"] in pii.BASE] == base_spans(t or "")
    more = {s["kind"] for i in got for s in got[i]}
    assert {"iban", "ssn", "card_short"} <= more
    assert [t[s["start"] : s["end"]] for t, f in zip(texts, (got[i] for i in range(len(texts)))) for s in f if s["kind"] == "iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert pii.scan(empty(spark)).count() == 0


def test_pii_query_digests(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op3_pii(spark, sf_dir).collect():
        spans = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]


def test_pii_redaction_keeps_all_else(spark):
    docs = frame(spark, ODD + PII_TEXTS)
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert out[0] is None and out[5] == ODD[5] and out[len(ODD)].startswith("<EMAIL>, <EMAIL> @no.pe")
    assert not any(base_spans(t or "") for i, t in out.items() if i >= len(ODD))
    assert pii.redacted(docs).schema == docs.schema


def test_packing_pieces_and_places(docs, texts):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for capacity in (64, 2048):
        got = packing.best_fit(docs, path, capacity).collect()
        pieces = defaultdict(list)
        for i, t in texts:
            ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
            head = len(ids) % capacity if len(ids) > capacity else len(ids)
            cut = [0] * (head > 0) + list(range(head, len(ids), capacity)) + [len(ids)]
            pieces[i] += [(p, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for p, (a, b) in enumerate(zip(cut, cut[1:]))]
        have = defaultdict(list)
        bins = defaultdict(list)
        for r in got:
            have[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in pieces.items()}
        for b in bins.values():
            end = 0
            for offset, n in sorted(b):
                assert offset == end
                end += n
            assert end <= capacity
        total = sum(r["length"] for r in got)
        assert len(bins) <= 1.03 * -(-total // capacity) + 1
    assert packing.best_fit(docs.limit(0), path).count() == 0


def test_packing_of_special_names():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, texts = Tokenizer.from_file(path), ["x <|endoftext|> y", "<|endoftext|>", "plain", "a<|endoftext|>b <|endof"]
    assert [i.tolist() for i in packing.Tokens(path).encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_large_pieces_pair():
    plan = packing.Plan({60: 3, 40: 3, 35: 2, 5: 1}, 100)
    assert plan.bins == 4


def test_lm_scores(spark, docs, texts):
    from tests.llm.common import FOLD, WORD

    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    for order in (1, 2, 3):
        got = lm.score(docs, lm.held_out(F.col("doc_id")), order=order, chunk_bytes=30_000)
        got = sorted((tuple(r) for r in got.collect()))
        grams = [Counter() for _ in range(order + 1)]
        seqs = []
        for i, t in texts:
            s = [0, *WORD.findall((t or "").translate(FOLD)), 1]
            seqs.append((i, s))
            if not held(i):
                for n in range(1, order + 1):
                    grams[n].update(tuple(s[j - n + 1 : j + 1]) for j in range(n - 1, len(s)))
        c = Counter({k[0]: v for k, v in grams[1].items() if k != (0,)})
        total, vocabulary = sum(c.values()), len(c)

        def prob(s, j, n):
            if n == 1:
                return (c[s[j]] + 1) / (total + vocabulary + 1)
            if j - n + 1 < 0:
                return prob(s, j, n - 1)
            return (grams[n][tuple(s[j - n + 1 : j + 1])] + 20 * prob(s, j, n - 1)) / (grams[n - 1][tuple(s[j - n + 1 : j])] + 20)

        want = sorted((i, held(i), len(s) - 1, sum(c[w] > 0 for w in s[1:]), total, sum(math.log10(prob(s, j, 1)) for j in range(1, len(s))), sum(math.log10(prob(s, j, order)) for j in range(1, len(s)))) for i, s in seqs)
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)
    assert lm.score(empty(spark), F.lit(False)).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_probabilities_sum_to_one(order):
    """From every state that a text leads to, over all known words, the end and one unknown word."""
    train, probe = [prose(1, 60, 5), prose(2, 40, 5)], prose(3, 30, 5) + " unknown"
    known = sorted(set(words(" ".join(train))))
    # All n-grams that a word can make after a history of the probe must be asked for.
    w = words(probe)
    asked = [" ".join([*w[max(0, i - order) : i], x]) for i in range(len(w) + 1) for x in [*known, "unknown"]] + [" ".join(w[max(0, i - order) : i]) for i in range(len(w) + 1)]
    seq, first = lm.sequences(pa.array([*train, probe, *asked]))
    by_order = lm.grams(seq, first, order)
    trained, counts = np.repeat(np.arange(len(first) - 1) < 2, np.diff(first)), []
    for g, there in by_order:
        uniq, of = np.unique(g[there], return_inverse=True)
        counts.append(np.bincount(of, trained[there], len(uniq)).astype(np.uint64))
    tokens = sum(len(words(t)) + 1 for t in train)
    auto, word = lm.machine(by_order, counts, tokens, len(known) + 1, 20.0)
    text = word[first[2] : first[3]].tolist()
    vocabulary = {x: int(word[first[0] + 1 + words(train[0]).index(x)]) for x in known}
    choices = [*vocabulary.values(), text[-1], text[-2]]  # the end, and the unknown word
    state = auto.target[auto.arc[text[0]]]
    visited = set()
    for x in text[1:]:
        assert sum(math.exp(auto.step(state, c)[1]) for c in choices) == pytest.approx(1, rel=1e-9)
        visited.add(state)
        state = auto.step(state, x)[0]
    assert auto.states > 1 or order == 1
    assert len(visited) > (5 if order > 1 else 0)


def test_junk_and_a_language_left_out_are_rejected(spark):
    import random

    r = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    junk = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 10))) for _ in range(80)) for _ in range(20)]
    junk += [base64.b64encode(r.randbytes(400)).decode() for _ in range(20)] + [r.randbytes(300).hex() for _ in range(20)]
    model = langid.fit(docs.filter("lang != 'fr'").filter(~langid.held_out(F.col("doc_id"))))
    out = langid.predict(docs.filter("length(text) > 200"), model, ["doc_id", "lang"]).collect()
    left, known = ([x["rejected"] for x in out if (x["lang"] == "fr") == f] for f in (True, False))
    assert sum(left) >= 0.95 * len(left) > 50 and sum(known) <= 0.01 * len(known)
    assert all(x["rejected"] for x in langid.predict(frame(spark, junk), model, ["doc_id"]).collect())


@pytest.mark.parametrize("number", ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "DE89370400440532013000", "ES9121000418450200051332"])
@pytest.mark.parametrize("after", ["", " EUR 500", " BIC X", " A B", ".", " DE89 3704 0044 0532 0130 00"])
def test_words_after_an_iban(number, after):
    t = f"to {number}{after}"
    got = [t[a:b] for k, a, b, _ in pii.find(t) if k == "iban"]
    assert got == [number] + [after.strip()] * after.startswith(" DE")


def test_an_automaton_takes_few_bytes_an_arc():
    """Lists and a dictionary of a chunk's arcs took an executor's memory."""
    import tracemalloc

    seq, first = lm.sequences(pa.array([prose(i, 300, 20_000) for i in range(200)]))
    by_order = lm.grams(seq, first, 2)
    counts = [np.unique(g[there], return_counts=True)[1].astype(np.uint64) for g, there in by_order]
    tracemalloc.start()
    auto, word = lm.machine(by_order, counts, 60_200, 20_000, 20.0)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100 * len(auto.weight)
