"""Stages of the corpus pipeline against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenta.llm import decontam, line_dedup, near_copies, simhash, toxicity, url_filter
from lumenta.llm import sentencepiece_sampling as sp
from tests.llm import brute


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def sets(text: str | None, n: int = 5) -> frozenset:
    words = brute.low(text or "").split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def kept(docs: list[tuple[int, str | None]]) -> set[int]:
    """Least ids of the components of all pairs of similarity 0.8 or more."""
    own, at = {d: sets(t) for d, t in docs}, {d: d for d, _ in docs}

    def root(d: int) -> int:
        return d if at[d] == d else root(at[d])

    ids = sorted(own)
    for i, b in enumerate(ids):
        for a in ids[:i]:
            small, large = sorted((len(own[a]), len(own[b])))
            if 5 * small >= 4 * large and jaccard(own[a], own[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {d for d in ids if root(d) == d}


def edited(turn: random.Random, words: list[str], places: int) -> str:
    out = list(words)
    for i in turn.sample(range(len(out)), places):
        out[i] = f"new{turn.random()}"
    return " ".join(out)


def fixture() -> list[tuple[int, str | None]]:
    turn, docs = random.Random(7), []
    for _ in range(40):
        words = [f"w{turn.randrange(5000)}" for _ in range(turn.randrange(30, 300))]
        docs.append(" ".join(words))
        docs += [edited(turn, words, max(1, len(words) * k // 100)) for k in (0, 1, 2, 3, 5)]
    common = [f"c{i}" for i in range(60)]  # a passage that many clean documents share
    docs += [" ".join(common + [f"u{turn.random()}" for _ in range(25)]) for _ in range(60)]
    near = [f"n{i}" for i in range(200)]  # copies near one source, and often not near each other
    docs += [edited(turn, near, 3) for _ in range(60)] + [" ".join(near)]
    docs += [None, "", " \n", "a b", "A  b", "a b c"]
    turn.shuffle(docs)
    return list(enumerate(docs))


class TestNearCopies:
    def test_fixture(self, spark, monkeypatch):
        docs = fixture()
        want = kept(docs)
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        got = corpus_pipeline.drop_near_copies(spark, frame, "")
        assert got.columns == frame.columns
        assert {r.doc_id for r in got.collect()} == want
        assert {r.doc_id for r in simhash.representatives(frame).collect()} != want
        monkeypatch.setattr(near_copies, "SAMPLE", 1)  # neither the order of shingles nor the size of groups changes a result
        monkeypatch.setattr(near_copies, "GROUP", 8)
        assert {r.doc_id for r in near_copies.representatives(frame).collect()} == want

    def test_documents(self, spark, sf_dir):
        frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
        assert {r.doc_id for r in near_copies.representatives(frame).collect()} == kept([(r.doc_id, r.text) for r in frame.collect()])

    def test_null_ids_repeats_and_empty(self, spark):
        frame = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "a b c"), (None, None), (5, "x y z")], "doc_id long, text string")
        got = sorted(((r.doc_id, r.text) for r in near_copies.representatives(frame).collect()), key=str)
        assert got == sorted([(None, "a b c"), (3, "a b c"), (None, None), (5, "x y z")], key=str)
        assert near_copies.representatives(frame.limit(0)).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "This line is in many of the documents, so all but one of them lose it."


def corpus() -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Documents, labels and benchmark items: toxic, clean, sharing lines, near copies, with benchmark passages, null and empty."""
    turn = random.Random(11)
    prose = lambda n: " ".join(f"w{turn.randrange(400)}" for _ in range(n))
    items = [(i, prose(25)) for i in range(4)]
    texts, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        body = prose(40) + (" scum filth scum vile" if toxic else " kind words")
        texts.append(f"{body}\n{LINE}\n{prose(8)}" if i % 5 == 1 else body)
        labels.append((i, 1 - int(i % 12 == 0), int(toxic)))
    base = prose(200).split()
    texts += [edited(turn, base, 3) for _ in range(5)]
    texts += [f"{prose(12)} {items[i][1]} {prose(12)}" for i in range(4)]
    texts += [None, "", "x"]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    docs, labels, items = corpus()
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{at}/{name}.parquet")
    return f"file://{at}"


class TestStages:
    def test_each_stage_and_the_whole(self, spark, folder, monkeypatch):
        """Each stage on what the plain versions of those before it kept, then run() on everything."""
        rows, _, items = corpus()
        frame = lambda held: spark.createDataFrame(held, DOCS)
        plain = lambda out: sorted((tuple(r) for r in out.collect()), key=str)
        labels = spark.read.parquet(f"{folder}/labels.parquet")

        chain = toxicity.train(frame(rows), labels)
        left = [r for r in rows if chain.probabilities(None if r[1] is None else r[1].encode())[-1] < 0.5]
        out = corpus_pipeline.drop_toxic(spark, frame(rows), folder)
        assert out.columns == frame(rows).columns and plain(out) == sorted(left, key=str)
        kept_ids = {r[0] for r in left}
        assert not kept_ids & {i for i in range(0, 240, 4)} and {i for i in range(240) if i % 4} <= kept_ids

        lines = brute.lines([(r[0], r[1]) for r in left])
        out = corpus_pipeline.drop_common_lines(spark, frame(left), folder)
        left = [(d, None if t is None else lines[d][2], a, b, len(lines[d][2]) if t is not None else n) for d, t, a, b, n in left]
        got = {r.doc_id: r for r in out.collect()}
        assert {d: r.text for d, r in got.items()} == {r[0]: r[1] for r in left} and all(r.text is None or r.n_chars == len(r.text) for r in got.values())
        assert sum(x[1] for x in lines.values()) > 20

        want = kept([(r[0], r[1]) for r in left])
        out = corpus_pipeline.drop_near_copies(spark, frame(left), folder)
        assert {r.doc_id for r in out.collect()} == want and len(want) < len(left)
        left = [r for r in left if r[0] in want]

        hit = brute.contaminated([(r[0], r[1]) for r in left], items)
        out = corpus_pipeline.drop_contaminated(spark, frame(left), folder)
        left = [r for r in left if not hit[r[0]][-1]]
        assert {r.doc_id for r in out.collect()} == {r[0] for r in left} and sum(x[-1] for x in hit.values()) == 4

        try:
            vocabulary = sp.vocabulary(sp.MODEL)
        except OSError:
            pytest.skip("no vocabulary here")
        for out in (corpus_pipeline.encode(spark, frame(left), folder), corpus_pipeline.run(spark, folder)):
            seen: dict[int, list] = {}
            for r in out.collect():
                seen.setdefault(r.doc_id, []).append((r["rank"], sp.text_of(r.ids, vocabulary)))
            assert set(seen) == {r[0] for r in left}
            for d, t, *_ in left:
                assert all(text == (t or "") for _, text in seen[d]) and sorted(k for k, _ in seen[d]) == ([1, 2] if t else [1])

    def test_empty(self, spark, folder):
        none = spark.createDataFrame([], DOCS)
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, none, folder).count() == 0, name


INTERNAL = ["__doc", "__keys", "__n_lines", "__n_dropped", "__node", "__gone", "__hit_spans", "__hit_items", "__host", "__upper", "__p_toxic", "__p_low_quality", "__text", "__bytes", "__kept", "__in", "node", "fp", "key", "least", "doc", "spans", "a`b"]


class TestClashes:
    @pytest.mark.parametrize(
        "operator",
        [
            lambda d, s, f: line_dedup.deduplicated(d, counts=False),
            lambda d, s, f: line_dedup.deduplicated(d).select(*[F.col(f"`{c.replace('`', '``')}`") for c in d.columns]),
            lambda d, s, f: toxicity.clean(d, s.read.parquet(f"{f}/labels.parquet").limit(0)),
            lambda d, s, f: simhash.representatives(d),
            lambda d, s, f: near_copies.representatives(d),
            lambda d, s, f: decontam.decontaminated(d, s.read.parquet(f"{f}/benchmark.parquet")),
            lambda d, s, f: decontam.matched(d, s.read.parquet(f"{f}/benchmark.parquet"))[0].select(*[F.col(f"`{c.replace('`', '``')}`") for c in d.columns]),
            lambda d, s, f: url_filter.kept(d, s.createDataFrame([], "host string, good long")),
        ],
        ids=["lines", "line counts", "toxicity", "simhash", "near copies", "decontaminated", "matched", "urls"],
    )
    def test_internal_names_as_extra_columns(self, spark, folder, operator):
        rows = [(1, "some words here", "x://a.io/"), (2, "other words there", None), (None, None, "x://b.io/")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, url string")
        for i, name in enumerate(INTERNAL):
            docs = docs.withColumn(name, F.lit(i) if i % 2 else F.lit(str(i)))
        out = operator(docs, spark, folder)
        assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
