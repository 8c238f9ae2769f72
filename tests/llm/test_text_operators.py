"""Line dedup, near copies, repeated passages, decontamination and personal data against plain versions."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from lumenta.llm import decontam, line_dedup, pii, queries, simhash, suffix_dedup
from tests.llm import brute

DOCS = "doc_id long, text string, fp string, key long, n int"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows, schema=DOCS):
    """Extra columns have names that the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)


def by_id(rows):
    return {r[0]: tuple(r[1:]) for r in rows}


PASSAGE = " ".join(f"word{i}" for i in range(60))
ODD = [(1, None), (2, ""), (3, "\n\n"), (4, PASSAGE), (5, "Ä" + PASSAGE + "\n" + PASSAGE), (6, "x" * 30_000), (7, "x y"), (8, "X Y"), (9, PASSAGE[:200]), (10, "é" * 500)]


class TestLines:
    def test_documents(self, spark, sf_dir, docs):
        got = by_id(queries.op1_line_dedup(spark, sf_dir).collect())
        assert got == {d: (n, x, brute.sha(t)) for d, (n, x, t) in brute.lines(docs).items()}

    def test_odd_rows(self, spark):
        line = "A common line that is long enough to count, Ünïcödé"
        rows = ODD + [(20 + i, f"head {i}\n\t{line if i % 2 else line.replace('A c', 'a C')} \ntail") for i in range(6)] + [(40, f"{line}\n{line}")]
        got = by_id(line_dedup.report(frame(spark, rows)).collect())
        assert got == {d: (n, x, brute.sha(t)) for d, (n, x, t) in brute.lines(rows).items()}
        assert got[40][1] == 0 and got[20][1] == 1

    def test_null_ids_repeats_and_columns(self, spark):
        line = "a line of at least forty code points, found in many documents"
        rows = frame(spark, [(None, line), *((i, line) for i in range(4)), (3, line), (None, None)])
        out = line_dedup.deduplicated(rows)
        assert out.columns[:5] == rows.columns
        kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert kept == sorted([(None, ""), (None, None), (0, ""), (1, ""), (2, ""), (3, line), (3, line)], key=str)

    def test_empty(self, spark):
        assert line_dedup.report(frame(spark, [])).count() == 0

    def test_insertions_and_deletions_are_reversible(self, spark, tmp_path):
        line = "a line of at least forty code points, found in many documents"
        index = line_dedup.LineIndex(spark, f"file://{tmp_path}/index")
        rows = [(i, f"{line}\nown {i}") for i in range(6)]
        first = frame(spark, rows[:4])
        index.insert(first)
        assert {r["__n_dropped"] for r in index.apply(first)[0].collect()} == {0}
        index.insert(frame(spark, rows[4:]))
        got = {r.doc_id: r.text for r in index.apply(frame(spark, rows))[0].collect()}
        assert got == {d: t for d, (_, _, t) in brute.lines(rows).items()}
        index.delete(frame(spark, rows[4:]))
        assert {r["__n_dropped"] for r in index.apply(first)[0].collect()} == {0}

    def test_an_index_is_opened_again(self, spark, tmp_path, monkeypatch):
        monkeypatch.setattr(line_dedup, "WHOLE_EVERY", 2)
        lines = [f"common line {i} of at least forty code points, in many documents" for i in range(40)]
        rows = [(d, "\n".join(lines[d:])) for d in range(8)]
        for d, row in enumerate(rows[:7]):
            line_dedup.LineIndex(spark, f"file://{tmp_path}/index", shards=4).insert(frame(spark, [row]))
            assert line_dedup.LineIndex(spark, f"file://{tmp_path}/index", shards=9).shards == 4
        index = line_dedup.LineIndex(spark, f"file://{tmp_path}/index")
        index.delete(frame(spark, rows[6:7]))
        index.insert(frame(spark, rows[7:]))
        left = rows[:6] + rows[7:]
        assert line_dedup.LineIndex(spark, f"file://{tmp_path}/index").version == 9
        assert {r.doc_id: r.text for r in line_dedup.LineIndex(spark, f"file://{tmp_path}/index").apply(frame(spark, left))[0].collect()} == {d: t for d, (_, _, t) in brute.lines(left).items()}
        changed = spark.read.parquet(f"file://{tmp_path}/index/filters/version=1").count()
        assert changed == 0  # one document makes no line common, so no filter is written

    def test_filters_that_are_dealt_out(self, spark, monkeypatch):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
        monkeypatch.setattr(line_dedup, "PART", 20)
        lines = [f"common line {i} of at least forty code points, in many documents" for i in range(60)]
        rows = [(d, "\n".join([*lines[d % 7 :], f"own {d}"])) for d in range(20)]
        got = by_id(line_dedup.report(frame(spark, rows)).collect())
        assert got == {d: (n, x, brute.sha(t)) for d, (n, x, t) in brute.lines(rows).items()}

    def test_full_filters_are_built_anew(self, spark, tmp_path):
        lines = [f"common line {i} of at least forty code points, in many documents" for i in range(300)]
        rows = [(d, "\n".join(lines)) for d in range(6)]
        index = line_dedup.LineIndex(spark, f"file://{tmp_path}/index", shards=2, shard_keys=8)
        index.insert(frame(spark, rows))
        assert {r.doc_id: r.text for r in index.apply(frame(spark, rows))[0].collect()} == {d: t for d, (_, _, t) in brute.lines(rows).items()}
        index.delete(frame(spark, rows[4:]))
        assert {r["__n_dropped"] for r in index.apply(frame(spark, rows[:4]))[0].collect()} == {0}

    def test_a_retry_after_a_failure_is_exact(self, spark, tmp_path, monkeypatch):
        line = "a line of at least forty code points, found in many documents"
        rows = [(i, f"{line}\nown {i}") for i in range(6)]
        index = line_dedup.LineIndex(spark, f"file://{tmp_path}/index")
        with monkeypatch.context() as broken:
            broken.setattr(index, "filters", lambda: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                index.insert(frame(spark, rows))
        assert {r["__n_dropped"] for r in index.apply(frame(spark, rows))[0].collect()} == {0}
        index.insert(frame(spark, rows))
        assert {r.doc_id: r.text for r in index.apply(frame(spark, rows))[0].collect()} == {d: t for d, (_, _, t) in brute.lines(rows).items()}
        index.delete(frame(spark, rows[4:]))
        assert {r["__n_dropped"] for r in index.apply(frame(spark, rows[:4]))[0].collect()} == {0}

    def test_cuckoo_filter(self):
        keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
        own = line_dedup.built(keys)
        assert own.holds(keys).all()
        own.delete(keys[:2500])
        assert own.holds(keys[2500:]).all() and own.holds(keys[:2500]).mean() < 0.01


class TestSimHash:
    def test_documents(self, spark, sf_dir, docs):
        assert by_id(queries.op4_simhash(spark, sf_dir).collect()) == brute.classes(docs)

    def test_odd_rows(self, spark):
        got = by_id(simhash.report(frame(spark, ODD)).collect())
        assert got == brute.classes(ODD)
        assert got[7] == got[8][:1] + (7,) and got[1][0] == "0" * 16

    def test_null_ids_repeats_and_empty(self, spark):
        rows = frame(spark, [(None, "only here is this text found"), (5, "a b c"), (5, "a b c"), (None, "a b c")])
        got = sorted((r.doc_id, r.component_id) for r in simhash.report(rows).where("doc_id is not null").collect())
        assert got == [(5, 5), (5, 5)]
        assert simhash.report(rows).count() == 4
        assert simhash.report(frame(spark, [])).count() == 0
        assert simhash.representatives(rows).columns == rows.columns

    @pytest.mark.parametrize("chunk", [4, 1 << 13])
    def test_chains_and_hot_keys(self, spark, chunk):
        turn = random.Random(3)
        fps = [0]
        for _ in range(60):  # a chain whose ends are far apart
            fps.append(fps[-1] ^ sum(1 << b for b in turn.sample(range(64), 4)))
        fps += [turn.getrandbits(64) for _ in range(100)]
        rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(dict.fromkeys(fps))]
        found = simhash.components(simhash.links(spark.createDataFrame(rows, "node long, fp long"), chunk=chunk)).collect()
        assert all(r.component == 0 for r in found if r.node <= 60)
        assert {r.node for r in found} >= set(range(61))


class TestSuffixes:
    def test_documents(self, spark, sf_dir, docs):
        rows = queries.op7_suffix_dedup(spark, sf_dir).collect()
        assert by_id([r[:5] for r in rows]) == brute.repeats(docs, 400)
        texts = dict(docs)
        for r in rows:
            assert r.n_kept == r.n_bytes - r.n_removed and r.n_kept_chars == len(r.kept_text)
            assert r.n_removed or r.kept_text == (texts[r.doc_id] or "")

    @pytest.mark.parametrize(("length", "seed"), [(40, 16), (60, 60), (25, 8)])
    def test_random_texts(self, spark, length, seed):
        turn = random.Random(length)
        passages = ["".join(turn.choice("ab c") for _ in range(turn.randrange(10, 150))) for _ in range(12)]
        rows = [(i, "".join(turn.choice([turn.choice(passages), "zq" * turn.randrange(30), f"u{turn.random()}"]) for _ in range(turn.randrange(9)))) for i in range(80)]
        rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "zz" * 3000), (104, "ä" * 100)]
        got = by_id([r[:5] for r in suffix_dedup.report(frame(spark, rows), length, seed=seed).collect()])
        assert got == brute.repeats(rows, length)

    def test_passages_of_over_50_words(self, spark, sf_dir, docs):
        short = " ".join(f"w{i}" for i in range(55))  # under 400 bytes
        own = " ".join(f"own{i}" for i in range(60))
        rows = [(1, f"a b {short} c"), (2, "x\n" + short.replace(" ", "\n") + "\ty"), (3, f"{own} and {own}"), (4, " ".join(short.split()[:50])), (5, "a " * 60), (6, "a " * 60), (7, None), (None, f"{own[:200]} {short} {short}")]
        got = {r.doc_id: (r.n_removed, r.n_shared_words, r.n_shared_passages) for r in suffix_dedup.report(frame(spark, rows)).collect()}
        assert got == {1: (0, 55, 1), 2: (0, 55, 1), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 60, 1), 6: (0, 60, 1), 7: (0, 0, 0), None: (0, 110, 1)}
        found = {r.doc_id: (r.n_shared_words, r.n_shared_passages) for r in queries.op7_suffix_dedup(spark, sf_dir).collect()}
        assert found == brute.shared(docs, 51) and any(x[0] for x in found.values())

    @pytest.mark.parametrize(("words", "seed", "split"), [(12, 4, 3), (7, 7, 2), (9, 2, 20)])
    def test_random_words(self, spark, words, seed, split):
        turn = random.Random(words)
        passages = [" ".join(turn.choice(["ab", "c", "ä"]) for _ in range(turn.randrange(3, 40))) for _ in range(10)]
        rows = [(i, turn.choice([" ", "\n "]).join(turn.choice([turn.choice(passages), "zq " * turn.randrange(15), f"u{turn.random()}"]) for _ in range(turn.randrange(9)))) for i in range(60)]
        rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "zz " * 3000), (104, "q " * 50 + passages[0]), (105, rows[5][1] + " ")]
        got = {r.doc_id: (sum(r.shared[1::2]) - sum(r.shared[::2]), len(r.shared) // 2) for r in suffix_dedup.removals(frame(spark, rows), words=words, word_options={"seed": seed, "split": split}).collect()}
        assert got == brute.shared(rows, words)

    def test_null_ids_copies_and_empty(self, spark):
        text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(500))
        out = suffix_dedup.report(frame(spark, [(None, text), (None, text), (1, text), (1, None)])).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in out) == [(0, 500, 500, 1), (0, 500, 500, 1), (1, 0, 0, 0), (1, 500, 500, 1)]
        assert suffix_dedup.report(frame(spark, [])).count() == 0


class TestDecontamination:
    def test_documents(self, spark, sf_dir, docs):
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
        got = by_id(queries.op10_decontamination(spark, sf_dir).collect())
        assert got == brute.contaminated(docs, items)
        assert any(x[-1] for x in got.values())

    def test_odd_rows(self, spark, monkeypatch):
        items = [(1, PASSAGE), (2, "word3 word4"), (3, None), (4, ""), (5, "word5 word5 word5"), (12, "été ça"), (2, "word3 word4")]
        docs = ODD + [(30, "word5 " * 40), (31, "Été ça. ÉTÉ, word3\tWORD4"), (32, " ".join(PASSAGE.split()[:9]))]
        held = spark.createDataFrame(items, "item_id long, text string")
        assert by_id(decontam.report(frame(spark, docs), held).drop("hit_spans", "item_ids").collect()) == brute.contaminated(docs, items)
        # the same in small shards and blocks
        texts = [(t or "").encode() for _, t in docs]
        for shard in (1, 7, 1 << 20):
            monkeypatch.setattr(decontam, "shards", lambda t, i, limit=shard, f=decontam.shards: f(t, i, limit))
            spans, names = decontam.hits(texts, decontam.Tests([(str(n), decontam.words((t or "").encode())) for n, t in items], 10))
            assert [sum(e - s for s, e in decontam.union(x)) for x in spans] == [x[1] for x in brute.contaminated(docs, items).values()]
            assert [len(set(x)) for x in names] == [x[2] for x in brute.contaminated(docs, items).values()]
            monkeypatch.undo()

    def test_empty(self, spark):
        none = spark.createDataFrame([], "item_id long, text string")
        out = decontam.report(frame(spark, ODD), none).collect()
        assert len(out) == len(ODD) and not any(r.contaminated for r in out)
        assert decontam.decontaminated(frame(spark, []), none).count() == 0
        assert decontam.decontaminated(frame(spark, ODD), none).columns == frame(spark, ODD).columns

    def test_longest_matches(self, spark):
        items = spark.createDataFrame([("a", PASSAGE), ("b", "nothing of it")], "item_id string, text string")
        rows = frame(spark, [(1, "x y " + " ".join(PASSAGE.split()[10:30]) + " z"), (2, "word1 word2"), (3, PASSAGE)])
        got = sorted(tuple(r) for r in decontam.longest_matches(rows, items).collect())
        assert got == [("a", 1, 10, 2, 20), ("a", 3, 0, 0, 60)]


class TestPersonalData:
    def test_documents(self, spark, sf_dir, docs):
        got = by_id(pii.found(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "base", "spans").collect())
        for d, t in docs:
            base = brute.personal(t)
            assert got[d][0] == pii.joined(base), d
            assert set(got[d][0].split(",")) <= set(got[d][1].split(","))

    @pytest.mark.parametrize(
        "text",
        ["a@b.c x@y..z a@b@c.d.e @b.c", "1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.3.0255", "4111 1111 1111 1111, 4111-1111-1111-1112", "+49 (30) 123456-78 +1 23 +123456789012345678", "", "a%b+c@d-e.f-g.h", "....@a.b", "0" * 30, "+1" + " " * 20 + "2" * 9, "1 " * 200],
    )
    def test_base(self, text):
        assert pii.spans_of(text)[0] == brute.personal(text)

    @pytest.mark.parametrize(
        ("text", "kind", "source"),
        [
            ("write to jane dot doe at example dot com now", "email", "jane dot doe at example dot com"),
            ("mail jane(at)example(dot)org.", "email", "jane(at)example(dot)org"),
            ("mail jаne@exаmple.com", "email", "jаne@exаmple.com"),
            ("call plus four nine three zero one two three four five six", "phone", "plus four nine three zero one two three four five six"),
            ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
            ("host 10 dot 0 dot 0 dot 1 is up", "ip", "10 dot 0 dot 0 dot 1"),
            ("mail ｊａｎｅ＠example．com", "email", "ｊａｎｅ＠example．com"),
        ],
    )
    def test_disguises(self, text, kind, source):
        base, every = pii.spans_of(text)
        assert source in [text[s:e] for s, e in every[kind]]

    @pytest.mark.parametrize("text", ["look at example.com", "one two three", "The dot product at hand", "we met at noon"])
    def test_prose(self, text):
        assert not any(pii.spans_of(text)[1].values())

    @pytest.mark.parametrize("part", ["x", "1", "a.", "1 ", "1.", " @", " at a", "(dot) ", "+1 ", "a (at) b dot c ", "а"])
    def test_long_texts_take_linear_time(self, part):
        took = []
        for size in (1 << 16, 1 << 19):
            began = time.process_time()
            pii.spans_of("a @ " + part * (size // len(part)))
            took.append(time.process_time() - began)
        assert took[1] < 5 and took[1] < 24 * max(took[0], 0.02)  # eight times the text

    def test_nulls_and_empty(self, spark):
        rows = frame(spark, [(None, "a@b.cd"), (1, None), (1, ""), (1, None)])
        assert sorted((r.doc_id or 0, r.n_email) for r in pii.found(rows).collect()) == [(0, 1), (1, 0), (1, 0), (1, 0)]
        assert pii.found(frame(spark, [])).count() == 0
        assert pii.redact("to a@b.cd, +49 30 1234567") == "to [email], [phone]"
