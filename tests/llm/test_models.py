"""Neighbours, chat repair, URL reputation, toxicity and sampled segmentations: brute force, round trips, held-out accuracy."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenta.llm import ann, chat, queries, toxicity, url_filter
from lumenta.llm import sentencepiece_sampling as sp
from tests.llm import brute


class TestNeighbours:
    def test_recall_and_scores(self, spark, sf_dir):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
        vectors, want = {i: np.array(v, float) for i, v in rows}, brute.nearest(rows)
        got = queries.op2_neighbours(spark, sf_dir).collect()
        assert len(got) == len(want)
        for r in got:
            assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), rel=1e-12, abs=1e-12) and r.vec_id != r.query_id
        pairs = {(q, v) for q, _, v, _ in want}
        assert len(pairs & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(pairs)

    def test_few_are_verified_and_recall_is_kept(self):
        try:
            import pyarrow.parquet as pq

            table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
        except OSError:
            pytest.skip("no test tables here")
        rows = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True))
        ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
        index, want = ann.SortedProjections(ids, np.arange(len(ids)), vectors), {(q, v) for q, _, v, _ in brute.nearest(rows)}
        share, hits = [], 0
        for at in np.flatnonzero(ids % 20 == 0).tolist():
            share.append(len(index.candidates(vectors[at], max(20 * ann.LEAST, int(ann.VERIFIED * len(ids))), int(ann.THRESHOLD * len(index.axes)))) / len(ids))
            hits += len(want & {(int(ids[at]), int(index.ids[x])) for x in index.search(at, vectors[at], 20)[0]})
        assert np.mean(share) < 0.2 and hits >= 0.9 * len(want)

    @pytest.mark.parametrize("n", [300, 70000])
    def test_collisions_of_narrow_and_wide_windows(self, n):
        """Walked or compared by places, an entry's count is the number of projections whose window holds it; the order of queries doesn't matter."""
        vectors = np.random.default_rng(3).standard_normal((n, 8))
        index = ann.SortedProjections(np.arange(n), np.arange(n), vectors, projections=20)
        extra = np.sqrt(np.maximum(0, index.length**2 - (index.vectors**2).sum(axis=1)))
        values = np.hstack((index.vectors, extra[:, None])) @ index.axes.T
        centre = index.axes[:, :-1] @ vectors[5] + index.shift
        for reach in (0.001, 0.05, 1.0, 50.0):
            assert (index.collisions(centre, reach) == (np.abs(values + index.shift - centre) <= reach).sum(axis=1)).all()
        first = [index.candidates(v, 40, 12).tolist() for v in vectors[:20]]
        assert [index.candidates(v, 40, 12).tolist() for v in vectors[19::-1]][::-1] == first

    def test_shards_and_blocks_keep_recall(self, spark):
        turn = np.random.default_rng(5)
        centres = turn.standard_normal((40, 24))
        rows = [(i, (centres[i % 40] + 0.4 * turn.standard_normal(24)).astype(np.float32).tolist()) for i in range(3000)]
        want, frame = brute.nearest(rows), spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = ann.neighbours(frame, shard=1000, block=60).collect()
        assert Counter(r.query_id for r in got) == Counter(q for q, *_ in want)
        assert len({(q, v) for q, _, v, _ in want} & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)

    def test_odd_rows(self, spark):
        nan, inf = float("nan"), float("inf")
        rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0])]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit("x"), "d": F.lit(0)})
        got = sorted(tuple(r) for r in ann.neighbours(frame).collect())
        assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 2, 0.0)]
        assert ann.neighbours(frame.limit(0)).count() == 0

    def test_many_equal_vectors(self, spark):
        rows = [(i, [1.0, 2.0]) for i in range(500)] + [(i, [1.0, float(i % 7)]) for i in range(500, 600)]
        got = sorted(tuple(r) for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
        assert got == sorted(brute.nearest(rows))

    def test_rows_that_repeat_an_id(self, spark):
        rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [2.0, 1.0]), (1, [1.0, 1.0])]
        got = sorted(tuple(r) for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
        assert got == sorted(brute.nearest(rows)) and len(got) == 9


def least_cost(roles: list[str | None]) -> int:
    """Uniform-cost search over (turns read, last role), with one move for each keep, merge, relabel or empty turn."""
    follow = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    queue, seen = [(0, 0, "")], set()
    while queue:
        cost, i, last = heapq.heappop(queue)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(roles) and last != "system":
            return cost
        for role in follow[last or None]:
            heapq.heappush(queue, (cost + chat.INSERT, i, role))
        if i < len(roles):
            for role in (*follow[last or None], *([last] if last else [])):
                label = 0 if roles[i] == role else chat.NAME if roles[i] not in chat.ROLES else chat.RELABEL
                if role in follow[last or None]:
                    heapq.heappush(queue, (cost + label, i + 1, role))
                if role == last:
                    heapq.heappush(queue, (cost + label + chat.MERGE, i + 1, role))
    raise AssertionError


class TestChat:
    SCHEMA = "conv_id long, turn long, role string, text string, key string, part int"

    def frame(self, spark, conversations):
        return spark.createDataFrame([(c, i, r, f"t{i}", "k", 0) for c, own in enumerate(conversations) for i, r in enumerate(own)], self.SCHEMA)

    @pytest.mark.parametrize("chunk", [2, 512])
    def test_costs_are_least_and_turns_legal(self, spark, chunk):
        turn = random.Random(8)
        convs = [list(x) for n in (1, 2, 3) for x in itertools.product(("system", "user", "assistant", None), repeat=n)]
        convs += [[turn.choice(("system", "user", "assistant", "tool", None)) for _ in range(turn.randrange(4, 30))] for _ in range(60)]
        got = {r.conv_id: r for r in chat.rendered(self.frame(spark, convs), chunk).collect()}
        for c, own in enumerate(convs):
            assert got[c].cost == least_cost(own), own
            turns = [x.removeprefix(chat.OPEN).split("\n", 1) for x in got[c].text.split(chat.CLOSE)[:-1]]
            roles = [r for r, _ in turns]
            body = roles[1:] if roles[0] == "system" else roles
            assert body and body == [("user", "assistant")[i % 2] for i in range(len(body))]
            assert [t for _, x in turns for t in x.split("\n") if t] == [f"t{i}" for i in range(len(own))]

    def test_chunks_change_nothing(self, spark):
        turn = random.Random(9)
        convs = [[turn.choice(("system", "user", "assistant", None)) for _ in range(n)] for n in (1, 5, 40, 200)]
        costs = [{r.conv_id: r.cost for r in chat.rendered(self.frame(spark, convs), n).collect()} for n in (3, 16, 512)]
        assert costs[0] == costs[1] == costs[2]

    def test_rows_of_the_query(self, spark):
        """role, op, seq and n_inserted of each turn tell the same story as the rendered text, and cost what it costs."""
        turn = random.Random(4)
        convs = [[turn.choice(("system", "user", "assistant", "tool", None)) for _ in range(n)] for n in (1, 2, 3, 9, 30, 70)]
        got: dict[int, list] = {}
        for r in sorted(chat.repaired(self.frame(spark, convs), 8).collect(), key=lambda r: (r.conv_id, r.seq)):
            got.setdefault(r.conv_id, []).append(r)
        for c, own in enumerate(convs):
            rows = got[c]
            assert [r.seq for r in rows] == list(range(len(own))) and [r.turn for r in rows] == list(range(len(own)))
            cost, last = 0, None
            for r, given in zip(rows, own, strict=True):
                label = 0 if given == r.role else chat.NAME if given not in chat.ROLES else chat.RELABEL
                assert r.cost == label + chat.MERGE * (r.op == "merge") + chat.INSERT * r.n_inserted
                assert r.op == "merge" and r.role == last or r.op in ("keep", "relabel", "insert")
                assert (r.op == "keep") <= (label == 0) and (r.op == "relabel") <= (label > 0)
                cost, last = cost + r.cost, r.role
            assert cost == least_cost(own)

    def test_many_rows_of_one_turn(self, spark):
        rows = [(1, None, "user", f"t{i:04}", "k", 0) for i in range(1500)] + [(None, 3, "assistant", "x", "k", 0)] * 700
        out = chat.repaired(spark.createDataFrame(rows, self.SCHEMA), 16).collect()
        assert sorted(r.seq for r in out if r.conv_id == 1) == list(range(1500)) and sum(r.cost for r in out if r.conv_id == 1) == 1499 * chat.MERGE + chat.INSERT * 0 + sum(r.n_inserted for r in out if r.conv_id == 1) * chat.INSERT
        assert len([r for r in out if r.conv_id is None]) == 700

    def test_tables_turns(self, spark, sf_dir):
        own = spark.read.parquet(f"{sf_dir}/conversations.parquet")
        assert queries.op6_chat_format(spark, sf_dir).count() == own.count()

    def test_odd_rows(self, spark):
        rows = [(None, 0, "user", "a", "k", 1), (None, 1, "user", None, "k", 1), (1, None, None, None, "k", 1), (1, 0, " USER ", "<|im_end|>", "k", 1), (1, 0, " USER ", "<|im_end|>", "k", 1)]
        frame = spark.createDataFrame(rows, self.SCHEMA)
        out = chat.repaired(frame).collect()
        assert len(out) == 5 and all("<|im_end|>" not in r.fragment.replace(chat.CLOSE, "") for r in out)
        assert chat.repaired(frame.limit(0)).count() == 0


class TestUrls:
    def test_parts_and_rules(self, spark):
        rows = [
            (1, "http://WWW.Example.COM/en/70?x#y"), (2, "https://a.com/en/1"), (3, "x://example.net/de/80"), (4, "x://b.net/de/9"), (5, "x://notexample.net/de/80"), (6, "x://a.org/es/"), (7, "x://a.org/ES/"), (8, None), (9, "no scheme"),
            (10, ""), (11, "x://com/en/"), (12, "x://a.com?/en/"), (13, "x://a.com#/en/"), (14, "a://b://c/d"), (None, "x://z.io/p"), (15, "x://Ünï.com/en/"), (15, "x://Ünï.com/en/"), (16, "x://a.com\n/en/1\n2"),
        ]
        frame = spark.createDataFrame([(*r, "h", 1.0) for r in rows], "page_id long, url string, host string, mean double")
        none = spark.createDataFrame([], "host string, good long")
        got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(frame, none).collect()), key=str)
        want = []
        for i, url in rows:
            host, path = "", ""
            if url and "://" in url:
                rest = url.split("://", 1)[1]
                cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
                host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
                path = tail[: min([len(tail), *(tail.find(c) for c in "?#" if c in tail)])]
            fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
            want.append((i or 0, host, path, rule, verdict))
        assert got == sorted(want, key=str)
        assert url_filter.kept(frame, none).columns == frame.columns
        assert url_filter.judged(frame.limit(0), none).count() == 0

    def test_bad_hosts_are_blocked_and_few_outcomes_are_shrunk(self, spark):
        rows = [("bad.x.io", 0)] * 40 + [("bad.x.io", 1)] * 4 + [("good.y.io", 1)] * 60 + [("new.y.io", 0)] + [("z.y.io", 1)] * 30 + [("one.io", None)]
        outcomes = spark.createDataFrame(rows, "host string, good long")
        table = {r.host: r for r in url_filter.Reputation(outcomes).table().collect()}
        assert "one.io" not in table and table["new.y.io"].mean > 0.3 > table["bad.x.io"].mean
        pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(("bad.x.io", "good.y.io", "new.y.io", "other.io"))], "page_id long, url string")
        assert {r.host: r.verdict for r in url_filter.judged(pages, outcomes).collect()} == {"bad.x.io": "block", "good.y.io": "allow", "new.y.io": "allow", "other.io": "allow"}

    def test_hosts_without_outcomes_are_judged_by_domain_and_suffix(self, spark):
        rows = [(f"h{i}.bad.io", int(k < 2)) for i in range(20) for k in range(40)] + [(f"h{i}.good{i}.io", 1) for i in range(20) for _ in range(40)]
        rows += [(f"h.d{i}.xyz", int(k < 2)) for i in range(20) for k in range(40)] + [("a.b.net", 1)] * 2000
        outcomes = spark.createDataFrame(rows, "host string, good long")
        hosts = {"h0.bad.io": "block", "new.bad.io": "block", "h0.good0.io": "allow", "new.good0.io": "allow", "new.other.io": "allow", "new.other.xyz": "block", "new.other.dev": "allow"}
        pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)] + [(99, None)], "page_id long, url string")
        got = {r.host: r for r in url_filter.judged(pages, outcomes).collect()}
        assert {h: got[h].verdict for h in hosts} == hosts and got[""].verdict == "allow"
        own = url_filter.Reputation(outcomes)
        domain = {r.domain: r.m_domain for r in own.domains.collect()}
        m = domain["bad.io"]
        assert got["new.bad.io"].mean == pytest.approx(m, abs=1e-6)
        assert got["new.bad.io"].upper == pytest.approx(m + 1.645 * math.sqrt(m * (1 - m) / (own.k["host"] + 1)), abs=1e-6)
        assert {r.url for r in url_filter.kept(pages, outcomes).collect()} == {f"http://{h}/" for h, v in hosts.items() if v == "allow"} | {None}

    def test_no_python_in_the_plan(self, spark, sf_dir):
        plan = queries.op3_url_filter(spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
        assert plan.split("== Physical Plan ==")[1].count("Exchange") < 30

    def test_public_suffixes(self, spark):
        hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.io",), ("",), ("p.q.r.k12.ny.us",)], "host string")
        public = spark.createDataFrame([("CO.UK",), ("k12.ny.us",), (None,)], "suffix string")
        assert {r.host: (r.suffix, r.domain) for r in url_filter.placed(hosts, public).collect()} == {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.io": ("io", "x.io"), "": ("", ""), "p.q.r.k12.ny.us": ("k12.ny.us", "r.k12.ny.us")}
        assert {r.host: r.domain for r in url_filter.placed(hosts).collect()}["a.b.co.uk"] == "co.uk"

    def test_repeated_labels_count_once(self, spark):
        pages = spark.createDataFrame([(1, "x://a.io/"), (2, "x://a.io/"), (None, "x://a.io/")], "page_id long, url string")
        labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 0), (2, 1, 0), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
        assert sorted(r.good for r in url_filter.page_outcomes(pages, labels).collect()) == [0, 1]


class TestToxicity:
    def test_held_out_accuracy(self, spark):
        data = "/root/testdata/sf0.1"
        try:
            docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
        except Exception:
            pytest.skip("no test tables here")
        held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
        chain = toxicity.train(docs, labels.where(~held))
        own = toxicity.scored(docs.join(labels.where(held), "doc_id"), chain)
        rows = [(r[0], r[1] >= 0.5) for r in own.select("toxic", "__p_toxic").collect()]
        n = Counter((bool(t), p) for t, p in rows)
        assert n[True, True] >= 0.9 * (n[True, True] + n[True, False]), n
        assert n[False, True] <= 0.02 * (n[False, True] + n[False, False]), n

    def test_query_gives_each_document(self, spark, sf_dir):
        out = queries.op8_toxicity(spark, sf_dir)
        assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()

    def test_later_models_use_earlier_predictions(self, spark):
        turn = random.Random(2)
        rows = [(i, " ".join(turn.choice(("bad", "ugly") if i % 3 == 0 else ("fine", "well")) for _ in range(8)), 0, "x") for i in range(300)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, y_0 int, x string")
        labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
        chain = toxicity.train(docs, labels)
        assert len(chain.links[1]) == 1 and chain.links[1][0] > 0
        kept = toxicity.clean(docs, labels)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(300) if i % 3]

    def test_odd_rows(self, spark):
        docs = spark.createDataFrame([(None, "a b"), (1, None), (1, ""), (2, "x" * 100_000)], "doc_id long, text string")
        none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        odd = spark.createDataFrame([(None, 1, 1), (1, None, 0), (2, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
        for labels in (none, odd):
            assert toxicity.clean(docs, labels).count() == 4
            assert toxicity.report(docs.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    try:
        return sp.vocabulary(sp.MODEL)
    except OSError:
        pytest.skip("no vocabulary here")


def segmentations(v: sp.Vocabulary, text: str):
    """All of a short text's segmentations with their log-weights."""
    weight = {v.pieces[i]: (i, w) for i, w in zip(v.ids.tolist(), v.weights.tolist(), strict=True)}
    whole = sp.SPACE + text.replace(" ", sp.SPACE)

    def walk(at: int):
        if at == len(whole):
            yield [], 0.0
            return
        for end in range(at + 1, len(whole) + 1):
            piece = whole[at:end]
            if piece in weight:
                head, w = [weight[piece][0]], weight[piece][1]
            elif end == at + 1:
                own = piece.encode()
                head, w = [v.bytes[b] for b in own], v.byte_weight * len(own)
            else:
                continue
            for tail, rest in walk(end):
                yield head + tail, w + rest

    return {tuple(ids): w for ids, w in walk(0)}


class TestSegmentations:
    @pytest.mark.parametrize("text", ["abc", "to be", "a  b", "é\n!", "中x", "--,"])
    def test_probabilities(self, vocabulary, text):
        every = segmentations(vocabulary, text)
        total = math.log(sum(map(math.exp, every.values())))
        for seed in range(5):
            got = list(sp.samples([(seed, text)], 3, 17, sp.MODEL))
            assert len({tuple(x[2].tolist()) for x in got}) == len(got) == min(3, len(every))
            for _, _, ids, p, _, _ in got:
                assert p == pytest.approx(every[tuple(ids.tolist())] - total, abs=1e-9)
            tops = [x[4] for x in got]
            assert tops == sorted(tops, reverse=True)

    def test_draws_are_without_replacement_and_unbiased(self, vocabulary):
        text, n = "abcd", 4000
        every = segmentations(vocabulary, text)
        total = math.log(sum(map(math.exp, every.values())))
        got = list(sp.samples([(i, text) for i in range(n)], 2, 3, sp.MODEL))
        first = Counter(tuple(x[2].tolist()) for x in got if x[1] == 1)
        for ids, w in every.items():
            p = math.exp(w - total)
            assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        # sums weighted by inclusion scores are unbiased (the last sample is the threshold)
        three = list(sp.samples([(i, text) for i in range(n)], 3, 3, sp.MODEL))
        ones = {ids: len(ids) for ids in every}
        mean = sum(math.exp(x[3] - x[5]) * ones[tuple(x[2].tolist())] for x in three) / n
        assert mean == pytest.approx(sum(math.exp(w - total) * ones[ids] for ids, w in every.items()), rel=0.05)
        pairs = Counter()
        for x in got:
            pairs[x[0]] += 1
        assert set(pairs.values()) == {2}

    def test_batches_change_nothing(self, vocabulary):
        rows = [(i, t) for i, t in enumerate(["one two three", "", None, "Ünïcödé 中文 🙂 text", "a" * 300, "one two three"])]
        whole = [(r, rank, ids.tolist(), p) for r, rank, ids, p, _, _ in sp.samples(rows, 2, 17, sp.MODEL)]
        single = [(i, rank, ids.tolist(), p) for i, row in enumerate(rows) for _, rank, ids, p, _, _ in sp.samples([row], 2, 17, sp.MODEL)]
        assert [x[:3] for x in whole] == [x[:3] for x in single]
        assert [x[3] for x in whole] == pytest.approx([x[3] for x in single])

    def test_round_trip(self, spark, sf_dir, vocabulary):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        texts = {r.doc_id: (r.text or "").replace(sp.SPACE, " ") for r in docs.collect()}
        got = sp.decoded(sp.encoded(docs)).select("doc_id", "rank", "text", "ids").collect()
        assert {r.doc_id for r in got} == set(texts)
        assert all(r.text == texts[r.doc_id] for r in got)
        digests = {(r.doc_id, r.rank): r for r in queries.op5_sentencepiece(spark, sf_dir).collect()}
        assert len(digests) == len(got)
        for r in got:
            own = digests[r.doc_id, r.rank]
            assert own.restored and own.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
            assert own.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()

    def test_units_that_share_a_hash(self, vocabulary, monkeypatch):
        rows, real = [(1, "one two one three two")], sp._powers
        want = [x[2].tolist() for x in sp.samples(rows, 2, 17, sp.MODEL)]
        monkeypatch.setattr(sp, "_powers", lambda n, base: real(n, 1 if base == vocabulary.BASE else base))  # the first hash is a sum of letters
        codes = np.array([ord(c) for c in "abbaab"], np.uint32)
        kind, example = sp.distinct(codes, np.array([0, 2, 4]), np.array([2, 2, 2]))
        assert kind.tolist() in ([0, 1, 0], [1, 0, 1]) and len(example) == 2
        assert [x[2].tolist() for x in sp.samples(rows, 2, 17, sp.MODEL)] == want

    def test_units_that_go_on_after_the_longest_pieces(self, vocabulary):
        for text in ("-" * 17, "-" * 200 + "s", "| " + "=" * 40 + "\n" + "*" * 33, "é🙂中" * 9 + "-" * 17):
            for _, _, ids, *_ in sp.samples([(1, text)], 3, 17, sp.MODEL):
                assert sp.text_of(ids.tolist(), vocabulary) == text

    def test_lattices_hold_pieces_only(self, vocabulary):
        """Of each end in a unit just the pieces that end there, with the probabilities of plain forward sums."""
        weight = {vocabulary.pieces[i]: w for i, w in zip(vocabulary.ids.tolist(), vocabulary.weights.tolist(), strict=True)}
        texts = ["nothing of the kind", "Überraschung 中🙂", "a" * 40]
        batch = sp.Batch(texts, [1, 2, 3], vocabulary)
        lattices, codes, rows = batch.lattices, [ord(c) for t in texts for c in sp.SPACE + t.replace(" ", sp.SPACE)], 0
        for occ, (start, size) in enumerate(zip(np.cumsum(batch.size) - batch.size, batch.size, strict=True)):
            unit, total = "".join(map(chr, codes[start : start + size])), [0.0]
            for end in range(1, size + 1):
                odd = vocabulary.byte_weight * len(unit[end - 1].encode())
                every = {n: total[end - n] + weight.get(unit[end - n : end], odd) for n in range(1, end + 1) if n == 1 or unit[end - n : end] in weight}
                total.append(math.log(sum(map(math.exp, every.values()))))
                row = int(batch.rows(np.array([occ]), np.array([end]))[0])
                own = slice(int(lattices.ptr[row]), int(lattices.ptr[row + 1]))
                assert lattices.length[own].tolist() == list(every)
                assert lattices.probs[own] == pytest.approx([math.exp(x - total[-1]) for x in every.values()])
                rows += 1
        assert rows == len(codes) >= len(lattices.whole)

    def test_texts_of_a_batch_are_drawn_together(self, vocabulary, monkeypatch):
        calls, real = [], sp.uniform
        monkeypatch.setattr(sp, "uniform", lambda *a: calls.append(1) or real(*a))
        count = []
        for n in (20, 400):
            calls.clear()
            assert len(list(sp.samples([(i, "some plain words to be cut") for i in range(n)], 2, 17, sp.MODEL))) == 2 * n
            count.append(len(calls))
        assert count[1] < 2 * count[0]

    def test_k_has_a_bound(self, vocabulary):
        with pytest.raises(ValueError):
            list(sp.samples([(1, "a")], 32, 17, sp.MODEL))

    def test_odd_rows(self, spark, vocabulary):
        rows = [(None, "a b"), (1, None), (1, ""), (2, "word " * 50_000), (2, "word " * 50_000)]
        frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, rank int, ids string")
        out = sp.encoded(frame).collect()
        assert Counter(r.doc_id for r in out) == {None: 2, 1: 2, 2: 4}
        assert all(r.inclusion == 0 and r.n_tokens == 0 for r in out if r.doc_id == 1)
        assert sp.encoded(frame.limit(0)).count() == 0
