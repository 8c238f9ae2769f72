"""Rank fusion, n-gram cosines, postings and chunks against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenta.operators import char_vectors, retrieval


@pytest.mark.parametrize("least", [1, 2])
def test_fused_ranks_every_positive_score(spark, least):
    turn = random.Random(4)
    # document 0 is 1st in one signal and far behind in the other; many scores are equal, some are not over 0
    a = {0: 99.0} | {i: float(turn.randrange(-5, 60)) for i in range(1, 400)}
    b = {0: 0.5} | {i: float(turn.randrange(-5, 60)) for i in range(100, 500)}
    want = {}
    for name, scores in (("a", a), ("b", b)):
        for place, k in enumerate(sorted((k for k in scores if scores[k] > 0), key=lambda k: (-scores[k], k)), 1):
            want.setdefault(k, {})[name] = place
    rrf = {k: (sum(1 / (60 + p) for p in own.values()), sorted(own)) for k, own in want.items() if len(own) >= least}
    best = sorted(rrf, key=lambda k: (-rrf[k][0], k))
    frames = {n: spark.createDataFrame(list(s.items()), "k long, score double") for n, s in (("a", a), ("b", b))}
    got = sorted(retrieval.fused(frames, "k", 500, least).collect(), key=lambda r: r["rank"])
    assert {r.k: (pytest.approx(r.rrf), r.signals) for r in got} == rrf and len(got) == len(rrf)
    top = sorted(retrieval.fused(frames, "k", 10, least).collect(), key=lambda r: r["rank"])
    assert [(r.k, r.signals) for r in top] == [(k, rrf[k][1]) for k in best[:10]]


def _cosines(docs, query):
    """Plain tf-idf cosines of character 3- to 5-grams; docs: (key, text), texts of a key belong together."""

    def grams(texts):
        words = [f" {w} " for t in texts for w in re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower()) if w]
        return Counter(w[i : i + n] for w in words for n in (3, 4, 5) for i in range(len(w) - n + 1))

    own = {k: grams([t for key, t in docs if key == k]) for k in {k for k, _ in docs}}
    df, asked = Counter(g for c in own.values() for g in c), grams([query])
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items()}
    norm = lambda c: math.sqrt(sum(((1 + math.log(n)) * idf[g]) ** 2 for g, n in c.items() if g in idf))
    dot = {k: sum((1 + math.log(n)) * (1 + math.log(asked[g])) * idf[g] ** 2 for g, n in c.items() if g in asked) for k, c in own.items()}
    return {k: dot[k] / (norm(c) * norm(asked)) for k, c in own.items() if c.keys() & asked.keys()}


@pytest.mark.parametrize("counts", [1, 50, 1 << 21])
def test_char_tfidf_of_odd_texts_and_repeated_keys(spark, monkeypatch, counts):
    """Blocks of any size give one answer; keys may repeat or be null, texts may be null, of many letters, or of one."""
    monkeypatch.setattr(char_vectors, "COUNTS", counts)
    turn = random.Random(5)
    words = ["the", "Thee", "a", "aaaaaaa", "größe", "𝒳𝒴𝒵ß", "nul\0\0", "x\x1cy", "license", "ſt"]
    texts = [" ".join(turn.choices(words, k=turn.randrange(1, 30))) + turn.choice(["", "\n", " end", "\x0b z"]) for _ in range(60)]
    texts += [None, "", " \n", "".join(map(chr, range(0x4E00, 0x9000))) + " the", "a" * 5000]
    docs = [(i % 50 if i != 7 else None, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "k int, text string").repartition(3)
    assert counts > 1 or char_vectors.blocks(frame, "k", "text").count() > 10
    got = {r.k: r.cosine for r in retrieval.char_tfidf(frame, "k", "the license the größe zzzz").collect()}
    assert got == pytest.approx(_cosines(docs, "the license the größe zzzz"), abs=1e-9)


def test_grams_of_more_letters_than_fit_one_number():
    words = [bytes(chr(c) + chr(c + 1) + chr(0x10FFFF - c) + "ab" * 2, "utf-8") for c in range(0x1000, 0xD000)]
    names, which, edges = char_vectors.grams_of(words)
    assert len(set(names)) == len(names)
    for i in range(0, len(words), 997):
        w = f" {words[i].decode()} "
        assert sorted(names[g] for g in which[edges[i] : edges[i + 1]]) == sorted(w[j : j + n] for n in (3, 4, 5) for j in range(len(w) - n + 1))


def test_char_tfidf_writes_no_grams_of_documents(spark, tmp_path):
    """What is written on the way stays under four times the texts; all documents' grams were tens of times as large."""
    turn = random.Random(6)
    words = ["".join(turn.choices("abcdefghij", k=8)) for _ in range(3000)]
    frame = spark.createDataFrame([(i, " ".join(turn.choices(words, k=400))) for i in range(1000)], "k long, text string")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert retrieval.char_tfidf(frame, "k", words[0]).count() > 0
    assert sum(p.stat().st_size for p in tmp_path.rglob("part-*")) < 4 * 1000 * 400 * 9


def _terms(docs):
    """Plain counts of stems by key."""
    out = {}
    for k, t in docs:
        for token in re.findall(r"[a-z0-9£$%]+", (t or "").lower()):
            if len(token) >= 2:
                out.setdefault(k, Counter())[retrieval.stem_of(token)] += 1
    return out


TEXTS = ["Policies policy £5 a %% organised organisation", "", None, "x y z", "Ärger über used uses étés", "lies lie dies£ THE the licensed licensing"]


def test_stem_of_is_the_column_stem(spark):
    tokens = sorted({a + s + b for a in ("", "a", "car", "orga", "polic", "tie£") for s in ("", *retrieval.SUFFIXES) for b in ("", "e", "s", "es")} - {""})
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", retrieval.stem(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == {t: retrieval.stem_of(t) for t in tokens}


@pytest.mark.parametrize("repeats", [False, True])
def test_postings_count_where_texts_lie(spark, repeats):
    """One row for each key and term, also where keys repeat or are null; without repeats no row is shuffled."""
    docs = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS * 4)] + ([(1, "more the"), (None, "the"), (0, "policy")] if repeats else [])
    posts = retrieval.postings(spark.createDataFrame(docs, "k long, text string").repartition(4), "k")
    want = {(k, t): n for k, own in _terms(docs).items() for t, n in own.items()}
    rows = posts.collect()
    assert {(r.k, r.term): r.tf for r in rows} == want and len(rows) == len(want)
    plan = posts._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "Aggregate" not in plan


def test_bm25_of_repeated_keys(spark):
    """Rows of a key are one document."""
    docs = [(i % 17, t) for i, t in enumerate(TEXTS * 8)]
    got = {r.k: r.bm25 for r in retrieval.bm25_texts(spark.createDataFrame(docs, "k long, text string").repartition(4), "k", "the licence policies policies").collect()}
    own, asked = _terms(docs), _terms([(0, "the licence policies policies")])[0]
    mean = sum(sum(c.values()) for c in own.values()) / len(own)
    df = {t: sum(t in c for c in own.values()) for t in asked}
    want = {k: sum(qf * math.log(1 + (len(own) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, qf in asked.items() if t in c) for k, c in own.items() if c.keys() & asked.keys()}
    assert got == pytest.approx(want)


def test_chunks_leave_in_small_batches():
    """A batch of many long documents comes back in batches of about BATCH_CHARS, with the chunks of each document."""
    texts = ["# Part\n\n" + f"Sentence {i} of a long text. " * 2000 for i in range(200)] + [None, ""]
    given = pa.RecordBatch.from_pydict({"doc_key": [str(i) for i in range(len(texts))], "body": texts})
    sent = list(retrieval.chunk_batches(iter([given])))
    assert len(sent) > 5 and max(sum(map(len, b["text"].to_pylist())) for b in sent) < retrieval.BATCH_CHARS + 1300
    got = [tuple(r.values()) for b in sent for r in b.to_pylist()]
    assert got == [c for i, t in enumerate(texts) if t for c in retrieval.chunks_of(str(i), t)]
