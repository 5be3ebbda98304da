"""Spelling variants, collocations and languages against brute force and held-out labels, on small tables with odd rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import lang_centroids, phrase_sketch, spelling_grams
from quillmesh.llm.common import Scratch, read
from quillmesh.llm.lang_centroids import Grams, cluster, fit, identify
from quillmesh.llm.phrase_sketch import Summary, blocks, collocations, frequent_runs
from quillmesh.llm.spelling_grams import bands, bands_of, decompose, frequent_grams, group_spellings, index_keys, most_affected, near_words

DOC = "doc_id bigint, text string, word string, n int, lang string"


def docs(spark, rows):
    """Rows of (doc_id, text, lang) with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, lang) for i, t, lang in rows], DOC)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def edits(word, letters):
    for k in range(len(word) + 1):
        yield from (word[:k] + c + word[k:] for c in letters)
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            yield from (word[:k] + c + word[k + 1 :] for c in letters if c != word[k])


@pytest.mark.parametrize("seed", range(4))
def test_one_edit_always_shares_a_key(seed):
    rng, letters = random.Random(seed), "abé"
    all_bands = bands(7)
    assert all_bands == [(7, 3), (8, 4), (12, 6)]
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 11, 12, 13, 16])))
        frequent = {"": 64} | {g: rng.choice([65, 900]) for q in range(2, 7) for g in map("".join, itertools.islice(itertools.product(letters, repeat=q), 300)) if rng.random() < 0.7}
        frequent = {g: n for g, n in frequent.items() if all(g[:k] in frequent for k in range(2, len(g)))}
        for other in edits(word, letters):
            if len(other) < 7:
                continue
            shared = set(bands_of(len(word), all_bands)) & set(bands_of(len(other), all_bands))
            assert any(index_keys(word, frequent, all_bands[k][1]) & index_keys(other, frequent, all_bands[k][1]) for k in shared), (word, other)
        q = all_bands[bands_of(len(word), all_bands)[0]][1]
        grams = decompose(word, frequent, q)
        assert len(grams) > most_affected(grams, q)


def brute_words(rows, least=7, least_n=2):
    upper = "".join(chr(c) for c in range(65, 91))
    low, found = str.maketrans(upper, upper.lower()), Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if ("a" <= c.translate(low) <= "z") or "À" <= c <= "ÿ":
                run += c.translate(low)
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                found[run] += len(run) >= least
            run = ""
    return {w: n for w, n in found.items() if n >= least_n}


def brute_forms(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    top = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: top[w] if w in top and words[top[w]] >= 10 * words[w] else None for w in words}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def test_spellings_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeéÀß") for _ in range(rng.randint(7, 14))) for _ in range(25)] + ["statione", "stationed", "stations", "ABCDEFGH", "×÷×÷×÷×÷"]
    rows = []
    for doc in range(60):
        words = []
        for w in rng.choices(base, weights=[300] * 3 + [3] * (len(base) - 3), k=60):
            words.append(rng.choice(list(edits(w, "abz"))) if rng.random() < 0.2 else w)
        rows.append((doc, " ".join(words).upper() if doc % 9 == 0 else ",".join(words)))
    rows += [(42 + k, f"{w} " * n) for k in range(2) for w, n in (("chainedq", 300), ("chainedqr", 30), ("chainedqrs", 2))]
    rows += [(None, "stationed stationed\x00stationed"), (7, None), (8, ""), (3, "stationed " * 20_000), (3, "stationed " * 20_000), (9, "x" * 50_000), (9, "x" * 50_000)]
    monkeypatch.setattr(spelling_grams, "FREQUENT", 8)  # read on the driver: dictionaries then have frequent grams in a small table
    got = group_spellings(docs(spark, [(*r, "en") for r in rows]))
    want = brute_forms(brute_words(rows))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    assert group_spellings(docs(spark, [])).count() == 0


def test_near_words_of_hot_grams(spark):
    """Thousands of words with one beginning and one ending: no list of a key holds more than a bounded number of them."""
    rng = random.Random(2)
    words = sorted({"common" + "".join(rng.choice("abcdefgh") for _ in range(4)) + "ending" for _ in range(3000)})
    table = spark.createDataFrame([(w,) for w in words], "word string")
    scratch = Scratch(spark)
    got = {tuple(r) for r in near_words(table, scratch, 7).collect()}
    cuts = {}
    for w in words:
        for k in range(len(w)):
            cuts.setdefault((k, w[:k] + w[k + 1 :]), []).append(w)
    assert got == {(a, b) for ws in cuts.values() for a, b in itertools.combinations(ws, 2) if a < b}
    (held,) = frequent_grams(table, [(7, 6)])
    assert held["commo"] == len(words) and max(Counter(k for w in words for k in index_keys(w, held, 6)).values()) <= 8 * 8 * 16


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(1)
    for least in (3, 10, 40):
        keys = np.concatenate([rng.integers(0, 200_000, 60_000), np.repeat(np.arange(10**6, 10**6 + 50), least), rng.zipf(1.3, 20_000) % 10**6]).astype(np.uint64)
        rng.shuffle(keys)
        summary, exact = Summary(len(keys) // least + 1), Counter(keys.tolist())
        for part in np.array_split(keys, 30):
            summary.add(*np.unique(part, return_counts=True))
            summary.settle()
        assert summary.error < least and len(summary.keys) <= summary.capacity
        assert set(summary.survivors(least).tolist()) >= {k for k, n in exact.items() if n >= least}
        assert all(exact[k] - summary.error <= n <= exact[k] for k, n in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
        assert len(summary.survivors(least)) < len(exact) / 2 or least == 3


@pytest.mark.parametrize("size", [16, 300, 1 << 22])
def test_blocks_lose_and_repeat_nothing(monkeypatch, size):
    monkeypatch.setattr(phrase_sketch, "BLOCK", size)
    rng = random.Random(size)
    rows = [(rng.choice(["en", "de"]), " ".join(rng.choice(["A", "b", "É", "c.", "\t"]) for _ in range(rng.choice([0, 1, 5, 900])))) for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + 7]]) for k in (0, 1)], names=["lang", "text"]) for a in range(0, 40, 7)]
    got = Counter()
    for block in blocks(iter(batches), 3):
        for k, starts, hashes in block.runs(3):
            assert len(starts) == len(hashes)
            phrases, n = block.exact(starts, k)
            for p, c in zip(phrases, n.tolist(), strict=True):
                got[block.lang, p.decode(), k] += c
    assert got == brute_runs(rows)


def brute_runs(rows):
    found = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in (1, 2, 3):
                found.update(("und" if lang is None else lang, " ".join(w[i : i + k]), k) for i in range(len(w) - k + 1))
    return found


def brute_collocations(rows, top=2000):
    f = brute_runs(rows)
    cand = {(lang, p): a for (lang, p, k), a in f.items() if k > 1 and a >= 10}
    total = Counter()
    for (lang, _, k), a in f.items():
        total[lang] += a * (k == 1)
    out = {}
    for (lang, p), a in cand.items():
        w = p.split(" ")
        cuts = [(10**6 * a * a // (f[lang, " ".join(w[:k]), k] * f[lang, " ".join(w[k:]), len(w) - k]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        longer = [b for (other, q), b in cand.items() if other == lang and len(q.split(" ")) > len(w) and f" {p} " in f" {q} "]
        if not any(100 * b >= 50 * a for b in longer):
            out.setdefault(lang, []).append((-score, -a, p.encode(), f[lang, " ".join(w[:k]), k], f[lang, " ".join(w[k:]), len(w) - k]))
    return {(lang, rank + 1, p.decode(), -a, left, right, total[lang], -s) for lang, rows in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


def test_collocations_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["new", "york", "city", "State", "of", "the", "é", "x\u00a0y", "<b>"]
    texts = [" ".join(rng.choices(words, weights=[9, 9, 5, 4, 3, 3, 2, 1, 1], k=rng.randint(1, 60))).replace("new york", rng.choice(["new york", "new york city", "new, york"])) for _ in range(150)]
    rows = [(k, t, rng.choice(["en", "de", None, "und"])) for k, t in enumerate(texts)]
    rows += [(None, "new york", "en"), (5, None, "fr"), (6, "", "fr"), (7, "one two", "fr"), (8, "same " * 30_000, "es"), (8, "same " * 30_000, "es"), (9, "z" * 100_000, "it"), (10, "a b.a b\ra b", "pt")] + [(11, "twice seen pair", "nl")] * 10
    plain = [(lang, t) for _, t, lang in rows]
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = {tuple(r) for r in collocations(docs(spark, rows)).select(*columns).collect()}
    assert got == brute_collocations(plain) and len(got) > 50
    assert {tuple(r) for r in collocations(docs(spark, rows), top=3).select(*columns).collect()} == brute_collocations(plain, 3)
    runs, total = frequent_runs(docs(spark, rows), 3, 10, Scratch(spark))
    assert {(r.lang, r.phrase, r.k): r.f for r in runs.collect()} == {k: n for k, n in brute_runs(plain).items() if n >= 10}
    assert collocations(docs(spark, [])).count() == 0


def test_letter_grams_equal_brute_force(monkeypatch):
    grams = Grams()
    rng = random.Random(4)
    for text in ["", "a", "1 2!", "Ab  c", "été 1 ÉTÉ", "字漢字", "".join(rng.choice("ab é.1\n") for _ in range(500)), " a" * 40]:
        spaced = " " + re.sub("[^a-zéßà-ÿ字漢]+", " ", text.lower()) + " "
        spaced = re.sub(" +", " ", spaced)
        singles = {}
        want = np.zeros(lang_centroids.DIMENSIONS, np.int64)
        for k in range(1, 5):
            for i in range(len(spaced) - k + 1):
                g = spaced[i : i + k]
                if g == " ":
                    continue
                if g not in singles:
                    h = sum(((0 if c == " " else ord(c)) + j + 1) * int(grams.factor[j]) for j, c in enumerate(g)) % 2**64
                    singles[g] = ((h ^ h >> 31) * 0x9E3779B97F4A7C15 % 2**64) >> 51
                want[singles[g]] += 1
        got = grams.counts(text)
        assert (got is None) == (not any(c.isalpha() for c in text))
        if got is not None:
            assert (got == want).all()
            for size in (1, 2, 7, 64):
                monkeypatch.setattr(lang_centroids, "SLICE", size)
                assert (grams.counts(text) == want).all()
            monkeypatch.setattr(lang_centroids, "SLICE", 1 << 19)


def test_clusters_part_two_kinds():
    rng = np.random.default_rng(0)
    rows = np.abs(np.vstack([rng.normal([1, 0, 0, 0.2], 0.05, (60, 4)), rng.normal([0, 1, 0.1, 0], 0.05, (40, 4))])).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    middles, radii = cluster(rows, 2)
    own = np.argmax(rows @ middles.T, 1)
    assert len(set(own[:60])) == len(set(own[60:])) == 1 and own[0] != own[-1]
    assert np.allclose(np.linalg.norm(middles, axis=1), 1, atol=1e-5) and (radii < 0.05).all()
    same, _ = cluster(np.repeat(rows[:1], 9, 0), 4)
    assert len(same) == 1 and np.allclose(same[0], rows[0])


def test_languages_by_held_out_documents(spark):
    table = read(spark, "/root/testdata/sf0.01", "documents")
    rows = identify(table).join(table.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(held) > 150 and (held.lang_pred == held.lang).mean() > 0.97
    assert (held[held.n_chars > 200].lang_pred == held[held.n_chars > 200].lang).mean() > 0.99
    assert held.accepted.mean() > 0.9 and held.score.between(0, 1).all()
    right, wrong = held[held.lang_pred == held.lang].score, held[held.lang_pred != held.lang].score
    assert right.mean() > 0.9 and (wrong.empty or wrong.mean() < right.mean())
    assert {zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id} == {True} and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows[~rows.held_out].doc_id)


def test_labels_of_held_out_documents_are_never_read(spark):
    table = read(spark, "/root/testdata/sf0.01", "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    twisted = table.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    plain, other = (sorted(map(tuple, identify(t).select("doc_id", "lang_pred", "score").collect())) for t in (table, twisted))
    assert plain == other


def test_languages_of_odd_rows(spark):
    rows = [(k, "the cat and the dog sat on the mat " * 3, "en") for k in range(40)] + [(100 + k, "der hund und die katze auf dem dach " * 3, "de") for k in range(40)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "123 !?", "en"), (203, "the dog", None), (None, "die katze", "de"), (204, "the mat " * 200_000, None), (204, "the mat " * 200_000, None), (205, "ωμέγα καὶ ἄλφα", None)]
    got = {}
    for r in identify(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(r.lang_pred, r.score, r.accepted) for k in (200, 201, 202) for r in got[k]] == [("und", 0.0, False)] * 3
    assert [got[k][0].lang_pred for k in (203, None, 204)] == ["en", "de", "en"] and len(got[204]) == 2 and got[204][0] == got[204][1]
    assert not got[205][0].accepted and got[205][0].lang_pred in ("en", "de")
    assert identify(docs(spark, [])).count() == 0
    assert [(r.lang_pred, r.score) for r in identify(docs(spark, [(1, "text", None)])).collect()] == [("und", 0.0)]
    assert fit(docs(spark, rows), F.lit(True), languages=1).names in (["de"], ["en"])
