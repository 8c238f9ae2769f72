"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations into pieces of a fixed vocabulary are the paths of a lattice. Pieces weigh by their rank (the
vocabulary's scores are merge ranks; a piece's probability falls as 1 / (rank + 10)). Forward sums over the lattice give
the probability of every step, so the search below has exact bounds: the perturbed score of a subtree is a Gumbel
variable with the subtree's log-mass, cut off at its parent's. Best-first (A-star) search pops the k best leaves: k distinct
segmentations, drawn without replacement. The next best score is the threshold for the inclusion scores.

No piece crosses a space, and many characters never stand together in a piece, so a text's lattice is a chain of small
ones, and equal small lattices of a batch are built once. All draws come from a hash of the row's key, the sample's number
and the place in the text: neither batches nor retried tasks change them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.llm.common import bounds, slices, widened

SPACE = "▁"
#: The vocabulary's place on every machine; a parameter of all operators here.
MODEL = os.environ.get("LUMENTA_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SAMPLES, SEED, RANK_OFFSET = 2, 17, 10
#: Characters of texts that are worked on together.
BATCH_CHARS = 1 << 19
_U = np.uint64


class Vocabulary:
    """Pieces with their log-weights, a hash table of them, and the walls that no piece crosses."""

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = own.get_piece_size()
        self.pieces = [own.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if own.is_byte(i)}
        byte_of = {i: b for b, i in self.bytes.items()}
        spelled = [bytes((byte_of[i],)) if i in byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        #: What each piece decodes to: sizes, and starts in one string of bytes.
        self.spelled, self.spelled_size = np.frombuffer(b"".join(spelled), np.uint8), np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.spelled_start = np.cumsum(self.spelled_size) - self.spelled_size
        plain = [i for i in range(n) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int32)
        rank = {i: max(0.0, -own.get_score(i)) for i in plain}
        total = np.log(sum(1 / (r + RANK_OFFSET) for r in rank.values()))
        self.ids, self.weights = np.array(plain), np.array([-np.log(rank[i] + RANK_OFFSET) - total for i in plain])
        #: The log-weight of each byte of a character that is no piece.
        self.byte_weight = -float(np.log(n + RANK_OFFSET)) - total
        texts = [self.pieces[i] for i in plain]
        self.longest = max(map(len, texts))
        #: All beginnings of pieces, by hash; -1 where a beginning is no piece itself.
        known: dict[str, int] = {}
        for k, t in enumerate(texts):
            for n in range(1, len(t)):
                known.setdefault(t[:n], -1)
            known[t] = k
        self.hashes, self.piece = np.array([self._hash(t) for t in known], _U), np.array([*known.values()], np.int32)
        assert len(set(self.hashes.tolist())) == len(known)
        self.tables: list[np.ndarray] = []
        rest = np.arange(len(known))
        while len(rest):
            table, slot = np.full(1 << 20, -1, np.int32), self._slot(self.hashes[rest], len(self.tables))
            _, first = np.unique(slot, return_index=True)
            table[slot[first]] = rest[first]
            self.tables.append(table)
            rest = np.delete(rest, first)
        #: The place among the beginnings of pieces of each character, or -1.
        self.single = np.full(0x110000, -1, np.int32)
        for i, t in enumerate(known):
            if len(t) == 1:
                self.single[ord(t)] = i
        # walls: odd characters that pieces join only with each other, and the start of a run of spaces
        odd = {c for t in texts for c in t if not c.isalnum() and c != SPACE} | set("\n\t\r")
        pairs = {(a, b) for t in texts for a, b in zip(t, t[1:])}
        while gone := {c for a, b in pairs for c in (a, b) if c in odd and not (a in odd and b in odd)}:
            odd -= gone
        assert all(b != SPACE or a == SPACE for a, b in pairs)
        #: 1 for walls, 2 for the piece sign, 0 for all other characters.
        self.kind = np.zeros(0x110000, np.int8)
        self.kind[[ord(c) for c in odd]] = 1
        self.kind[ord(SPACE)] = 2

    def starts(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where units start in texts that end at ends: at a run of piece signs, at a run of walls, after walls, at a text's start."""
        kind = self.kind[codes]
        new = np.ones(len(codes), bool)
        new[1:] = (kind[1:] != kind[:-1]) & ((kind[1:] > 0) | (kind[:-1] == 1))
        new[ends[ends < len(codes)]] = True
        return np.flatnonzero(new)

    BASE = 0x9E3779B97F4A7C15

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * self.BASE + ord(c) + 1) & ((1 << 64) - 1)
        return h

    @staticmethod
    def _slot(h: np.ndarray, table: int) -> np.ndarray:
        return (((h ^ (h >> _U(29))) * (_U(0xBF58476D1CE4E5B9) + _U(2 * table))) >> _U(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the beginnings of pieces, or -1."""
        out = self.tables[0][self._slot(h, 0)]
        miss = np.flatnonzero(out >= 0)  # an empty slot rules a hash out for all tables
        miss = miss[self.hashes[out[miss]] != h[miss]]
        for k, table in enumerate(self.tables[1:], 1):
            at = out[miss] = table[self._slot(h[miss], k)]
            miss = miss[(at >= 0) & (self.hashes[at] != h[miss])]
        out[miss] = -1
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """The lattices of distinct units, longest first: for each unit and end of a piece in it a row of the pieces that end there, the shortest first.

    Rows go by the end's place in its unit, then by unit: row(unit, end) = off[end - 1] + unit; a row's pieces are the entries from
    ptr[row] to ptr[row + 1]. probs[entry]: probability of this piece, given that one ends there; sums: the same, added up in a row,
    the last of which is whole[row]. place[entry]: the piece's place in the vocabulary, -1 for a character spelled in bytes. codes[row]: the last character.
    """

    def __init__(self, v: Vocabulary, codes: np.ndarray, lengths: np.ndarray):
        base, longest = np.cumsum(lengths) - lengths, int(lengths.max(initial=0))
        units = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")  # that have so many characters at least
        self.off = np.concatenate(([0], np.cumsum(units)))
        n, unit = len(codes), np.repeat(np.arange(len(lengths)), lengths)
        left = np.repeat(base + lengths, lengths) - np.arange(n)
        at = np.repeat(lengths, lengths) - left
        row, before = self.off[at] + unit, np.where(at > 0, self.off[at - 1] + len(lengths), 0) + unit  # of a character as an end, and of the sum before it
        c = codes.astype(_U) + _U(1)
        start, h, found = np.arange(n), c, []
        while len(start):  # only beginnings of pieces are followed on
            w = len(found)
            if w:
                h = h * _U(v.BASE) + c[start + w]
            p = v.find(h) if w else v.single[codes]
            on = np.flatnonzero(p >= 0)
            start, h, p = start[on], h[on], v.piece[p[on]]
            whole = np.flatnonzero(p >= 0)
            first, p = start[whole], p[whole]
            weight = v.weights[p]
            if not w:
                odd = np.ones(n, bool)
                odd[first] = False
                odd = np.flatnonzero(odd)
                first, p, weight = np.concatenate((first, odd)), np.concatenate((p, np.full(len(odd), -1, p.dtype))), np.concatenate((weight, v.byte_weight * utf8_size(codes[odd])))
            found.append((row[first + w], before[first], p, weight))
            on = np.flatnonzero(left[start] > w + 1)
            start, h = start[on], h[on]
        count = np.zeros(n, np.int64)
        for r, *_ in found:
            count[r] += 1
        self.ptr = np.concatenate(([0], np.cumsum(count)))
        size = int(self.ptr[-1])
        self.length, self.place, self.probs, came = np.empty(size, np.int64), np.empty(size, np.int32), np.empty(size), np.empty(size, np.int64)
        free = self.ptr[:-1].copy()
        for w, (r, b, p, weight) in enumerate(found, 1):
            to = free[r]
            free[r] += 1
            self.length[to], came[to], self.place[to], self.probs[to] = w, b, p, weight
        self._weigh(came, count, len(lengths))
        self.sums = self.probs.copy()
        for k in range(1, int(count.max(initial=0))):
            to = self.ptr[np.flatnonzero(count > k)] + k
            self.sums[to] += self.sums[to - 1]
        self.whole = self.sums[self.ptr[1:] - 1]
        self.codes = np.empty(n, np.int64)
        self.codes[row] = codes

    def _weigh(self, came: np.ndarray, count: np.ndarray, n: int) -> None:
        """Turns weights into probabilities by forward sums, for all units that are long enough at once."""
        total = np.zeros(n + len(count))
        edges, rows = self.ptr[self.off].tolist(), self.off.tolist()
        for a, b, x, y in zip(rows, rows[1:], edges, edges[1:], strict=False):
            first, sizes = self.ptr[a:b] - x, count[a:b]
            own = total[came[x:y]] + self.probs[x:y]
            top = np.maximum.reduceat(own, first)
            own -= np.repeat(top, sizes)
            np.exp(own, out=own)
            s = np.add.reduceat(own, first)
            total[n + a : n + b] = top + np.log(s)
            np.divide(own, np.repeat(s, sizes), out=self.probs[x:y])


def utf8_size(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 1 << 64), _U)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def distinct(codes: np.ndarray, start: np.ndarray, size: np.ndarray, base: int = Vocabulary.BASE) -> tuple[np.ndarray, np.ndarray]:
    """Of spans of codes: the number of each one's kind, and an example of each kind, the longest first.

    Spans are grouped by a hash and then compared with their example; should two different ones share a hash, another is taken.
    """
    up, down = _powers(1 << max(20, len(codes).bit_length()), base)
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum((codes.astype(_U) + _U(1)) * up[: len(codes)], out=sums[1:])
    h = (sums[start + size] - sums[start]) * down[start]
    kind = pa.array(h).dictionary_encode().indices.to_numpy().astype(np.int64)
    example = np.empty(int(kind.max(initial=-1)) + 1, np.int64)
    example[kind[::-1]] = np.arange(len(kind))[::-1]
    order = np.argsort(-size[example], kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    example, kind = example[order], place[kind]
    of = example[kind]
    if (size[of] != size).any() or (codes[np.repeat(start[of] - start, size) + np.arange(len(codes))] != codes).any():
        return distinct(codes, start, size, base + 2)
    return kind, example


def uniform(key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, a hash of key and counter."""
    z = counter.astype(_U)
    z *= _U(0x9E3779B97F4A7C15)
    z += key
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> _U(shift)
        z *= _U(factor)
    z ^= z >> _U(31)
    z >>= _U(11)
    u = z.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


class Paths:
    """One sample of each text of docs (in order): steps from edges[i] to edges[i + 1].

    A step is (unit occurrence, end in the unit, entry), in the search's order: unit by unit, from each unit's end to its start.
    before, p: log-probabilities before each step and of all; top: the perturbed score. gap: how unlikely the best that stands
    beside a step is (infinite where nothing does); the least gap of a path is its best branch. fork: the step at which
    the path left its parent, or -1; taken: the entries that were taken there before, or -1.
    """

    def __init__(self, batch: Batch, docs: np.ndarray, sizes: np.ndarray, steps: list[np.ndarray], top: np.ndarray, sample: int, fork: np.ndarray, taken: np.ndarray):
        self.batch, self.docs, self.top, self.fork, self.taken = batch, docs, top, fork, taken
        self.edges, self.occ, self.end, self.entry = np.concatenate(([0], np.cumsum(sizes))), *steps
        self.place = np.full(len(batch.keys), -1)
        self.place[docs] = np.arange(len(docs))
        whole = batch.lattices.whole[batch.rows(self.occ, self.end)]
        own = batch.lattices.probs[self.entry]
        with np.errstate(divide="ignore"):
            lp, beside = np.log(own), np.log(np.maximum(whole - own, 0.0) * (own < 1.0))
        sums = np.concatenate(([0.0], np.cumsum(lp)))
        self.p = sums[self.edges[1:]] - sums[self.edges[:-1]]
        self.before = sums[:-1] - np.repeat(sums[self.edges[:-1]], sizes)
        self.gap = batch.noise(self.occ, self.end, sample) - self.before - beside

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text of the batch the perturbed score of its path's best branch (-inf where there is none), and the step."""
        score, step = np.full(len(self.place), -np.inf), np.full(len(self.place), -1)
        some = np.flatnonzero(np.diff(self.edges))
        if len(some):
            least = np.minimum.reduceat(self.gap, self.edges[some])
            at = np.flatnonzero(self.gap == np.repeat(least, np.diff(self.edges)[some]))
            step[self.docs[some]] = at[np.searchsorted(at, self.edges[some])]
            score[self.docs[some]] = -np.logaddexp(-self.top[some], least)
        return score, step

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of all paths in their texts' order, and where each path's begin and end."""
        v, lattices = self.batch.v, self.batch.lattices
        first = bounds(self.occ)
        run = np.repeat(np.arange(len(first) - 1), np.diff(first))
        turned = first[run] + first[run + 1] - 1 - np.arange(len(run))  # each unit's steps the other way round
        place = lattices.place[self.entry[turned]]
        out = v.ids[place].astype(np.int32)
        odd = np.flatnonzero(place < 0)
        if not len(odd):
            return out, self.edges
        code = lattices.codes[self.batch.rows(self.occ[turned[odd]], self.end[turned[odd]])]
        size, more = np.ones(len(place), np.int64), utf8_size(code)
        size[odd] = more
        at = np.concatenate(([0], np.cumsum(size)))
        out = np.repeat(out, size)
        nth, left = spans(np.zeros_like(more), more), np.repeat(more, more)
        code = np.repeat(code, more)
        head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[left]
        out[spans(at[odd], more)] = v.byte_ids[np.where(nth == 0, head | code >> 6 * (left - 1), 0x80 | code >> 6 * (left - 1 - nth) & 0x3F)]
        return out, at[self.edges]


class Batch:
    """Texts that are sampled together."""

    def __init__(self, texts: list[str], keys: list[int], v: Vocabulary):
        self.v, self.keys = v, np.array(keys, _U)
        codes = np.frombuffer("".join([SPACE + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes == 32, np.uint32(ord(SPACE)), codes)
        ends = np.cumsum([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        start = v.starts(codes, ends)
        self.size = np.diff(start, append=len(codes))
        self.unit, example = distinct(codes, start, self.size)
        lengths = self.size[example]
        self.lattices = Lattices(v, codes[spans(start[example], lengths)], lengths)
        self.first = np.searchsorted(start, np.concatenate(([0], ends)))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.start, self.key = start - np.concatenate(([0], ends))[self.doc], self.keys[self.doc]  # of an occurrence in its text

    def rows(self, occ: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.lattices.off[end - 1] + self.unit[occ]

    def draw(self, occ: np.ndarray, end: np.ndarray, number: int) -> np.ndarray:
        """The numbers of a place in a text; each has 64."""
        return uniform(self.key[occ], (self.start[occ] + end) * 64 + number)

    def noise(self, occ: np.ndarray, end: np.ndarray, sample: int) -> np.ndarray:
        u = self.draw(occ, end, 2 * sample + 1)
        return np.log(-np.log(u, out=u), out=u)

    def descend(self, occ: np.ndarray, end: np.ndarray, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Steps from the given ends to their units' starts, drawn; in order of occurrence, then from the end on. And how many each has."""
        lattices, found = self.lattices, []
        count = np.zeros(len(occ), np.int64)
        origin = np.flatnonzero(end > 0)
        occ, end = occ[origin], end[origin]
        while len(occ):
            row = self.rows(occ, end)
            entry, bar = lattices.ptr[row], self.draw(occ, end, 2 * sample) * lattices.whole[row]
            on = np.flatnonzero(lattices.sums[entry] < bar)
            while len(on):
                entry[on] += 1
                on = on[lattices.sums[entry[on]] < bar[on]]
            found.append((origin, occ, end, entry))
            count[origin] += 1
            end = end - lattices.length[entry]
            go = np.flatnonzero(end)
            origin, occ, end = origin[go], occ[go], end[go]
        out, place = [np.empty(int(count.sum()), np.int64) for _ in range(3)], np.cumsum(count) - count
        for k, (origin, *parts) in enumerate(found):
            at = place[origin] + k
            for to, part in zip(out, parts, strict=True):
                to[at] = part
        return out, count

    def sample(self, k: int) -> tuple[list[Paths], np.ndarray]:
        """The texts' first, second, ... samples, and each text's threshold: the perturbed score of the next (-inf if there is none)."""
        docs = np.arange(len(self.keys))
        top = -np.log(-np.log(uniform(self.keys, np.full(len(docs), 1))))  # the root's log-mass is 0
        steps, count = self.descend(np.arange(len(self.unit)), self.size, 0)
        sizes = np.bincount(self.doc, count, len(docs)).astype(np.int64)
        paths = [Paths(self, docs, sizes, steps, top, 0, np.full(len(docs), -1), np.full((len(docs), k), -1))]
        for s in range(1, k + 1):
            score, step = map(np.stack, zip(*(x.best() for x in paths), strict=True))
            parent = score.argmax(axis=0)
            score, step = score[parent, docs], step[parent, docs]
            on = np.flatnonzero((paths[-1].place >= 0) & (score > -np.inf))
            if s == k:
                bar = np.full(len(docs), -np.inf)
                bar[on] = score[on]
                return paths, bar
            paths.append(self._branch(paths, on, parent[on], step[on], score[on], s))
        raise AssertionError

    def _branch(self, paths: list[Paths], docs: np.ndarray, parent: np.ndarray, step: np.ndarray, score: np.ndarray, s: int) -> Paths:
        """Of each text of docs the best path in the subtree beside a step of a parent, without the entries that were taken from there before."""
        lattices, n = self.lattices, len(docs)
        occ, end, entry, before, first, taken = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n), np.empty(n, np.int64), np.full((n, paths[0].taken.shape[1]), -1)
        for r, x in enumerate(paths):
            own = np.flatnonzero(parent == r)
            t, at = step[own], x.place[docs[own]]
            occ[own], end[own], entry[own], before[own], first[own] = x.occ[t], x.end[t], x.entry[t], x.before[t], x.edges[at]
            again = x.fork[at] == t
            taken[own[again]] = x.taken[at[again]]
            x.gap[t] = np.inf
        taken[:, s - 1] = entry
        row = self.rows(occ, end)
        low, high = lattices.ptr[row], lattices.ptr[row + 1]
        each = low[:, None] + np.arange((high - low).max(initial=1))
        p = np.where((each < high[:, None]) & (each[:, :, None] != taken[:, None, :]).all(axis=2), lattices.probs[np.minimum(each, len(lattices.probs) - 1)], 0.0)
        c = np.cumsum(p, axis=1)
        nth = (c < (self.draw(occ, end, 2 * s) * c[:, -1])[:, None]).sum(axis=1)
        p[np.arange(n), nth] = 0.0
        rest, chosen = p.sum(axis=1), low + nth
        # what comes after in the text
        later = self.first[docs + 1] - occ
        head, after = np.cumsum(later) - later, spans(occ, later)
        ends = self.size[after]
        ends[head] = end - lattices.length[chosen]
        tail, count = self.descend(after, ends, s)
        tails, ahead = np.add.reduceat(count, head) if n else count, step - first
        sizes = ahead + 1 + tails
        fork = np.cumsum(sizes) - sizes + ahead
        steps = [np.empty(int(sizes.sum()), np.int64) for _ in range(3)]
        for to, at_fork, rest_of, name in zip(steps, (occ, end, chosen), tail, ("occ", "end", "entry"), strict=True):
            to[fork], to[spans(fork + 1, tails)] = at_fork, rest_of
            for r, x in enumerate(paths):
                own = np.flatnonzero(parent == r)
                to[spans(fork[own] - ahead[own], ahead[own])] = getattr(x, name)[spans(first[own], ahead[own])]
        made = Paths(self, docs, sizes, steps, score, s, fork, taken)
        made.gap[spans(fork - ahead, ahead)] = np.inf  # these stand beside the parent too
        with np.errstate(divide="ignore"):
            made.gap[fork] = self.noise(occ, end, s) - before - np.log(rest)
        return made


def row_key(doc_id: int | None, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(b"" if doc_id is None else str(doc_id).encode(), seed)


def samples(rows: list[tuple[int | None, str | None]], k: int, seed: int, path: str) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(row, rank, ids, log-probability, perturbed score, inclusion score) for (doc_id, text) rows."""
    if not 0 < k < 32:
        raise ValueError("k must be from 1 to 31: a place's draws have that many numbers")
    first, held, total = 0, [], 0
    for i in range(len(rows) + 1):
        size = len(rows[i][1] or "") if i < len(rows) else 0
        if held and (i == len(rows) or total + size > BATCH_CHARS):
            batch = Batch([t or "" for _, t in held], [row_key(d, seed) for d, _ in held], vocabulary(path))
            made = []
            paths, bar = batch.sample(k)
            for x in paths:
                ids, edges = x.ids()
                made.append((ids, edges.tolist(), x.p.tolist(), x.top.tolist(), inclusion(x.p, bar[x.docs]).tolist(), x.place.tolist()))
            del batch, paths
            for j in range(len(held)):
                for rank, (ids, edges, p, top, scores, place) in enumerate(made, 1):
                    if (at := place[j]) >= 0:
                        yield first + j, rank, ids[edges[at] : edges[at + 1]], p[at], top[at], scores[at]
            first, held, total = i, [], 0
        if i < len(rows):
            held.append(rows[i])
            total += size


def inclusion(p: np.ndarray, bar: np.ndarray) -> np.ndarray:
    """Log-probability that a path of log-probability p passes the threshold."""
    over = p - np.where(np.isneginf(bar), 0.0, bar)
    with np.errstate(divide="ignore"):
        near = np.log(-np.expm1(-np.exp(np.clip(over, -30, 700))))
    return np.where(np.isneginf(bar), 0.0, np.where(over > -30, near, over))


ENCODED = "doc_id long, rank int, n_tokens long, log_prob double, perturbed double, inclusion double, ids array<int>"
DIGEST = ENCODED.replace("ids array<int>", "ids_sha256 string, decoded_sha256 string, restored boolean")


def encoded(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, path: str = MODEL, digest: bool = False) -> DataFrame:
    """Up to k rows (at most 31) for each row of docs (doc_id, text), the best perturbed score first, with the pieces' ids.

    With digest, in place of the ids: their SHA-256 (little-endian 32-bit), that of the text that they decode to, and
    whether that is the source text (a piece sign in the source decodes to a space and counts as one).
    Null and empty texts have one segmentation, into nothing. A text with fewer than k segmentations gives all it has, with
    inclusion score 0 (log of 1). Rows are seeded by their doc_id, so rows that repeat an id and a text repeat its
    samples; null ids share a seed. Spaces become a piece sign and one is put before the text; nothing else is normalised.
    """
    schema = DIGEST if digest else ENCODED
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), *((pa.string(), pa.string(), pa.bool_()) if digest else (pa.list_(pa.int32()),)))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        if digest:
            backs = all_bytes_of([r[6] for r in rows], vocabulary(path))
            rows = [(*r[:6], hashlib.sha256(r[6].astype("<i4").tobytes()).hexdigest(), hashlib.sha256(b).hexdigest(), b == (r[7] or "").replace(SPACE, " ").encode()) for r, b in zip(rows, backs, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            given, rows, tokens = list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), [], 0
            for i, rank, ids, p, top, score in samples(given, k, seed, path):
                rows.append((given[i][0], rank, len(ids), p, top, score, ids, given[i][1]))
                tokens += len(ids)
                if tokens > 1 << 18:
                    yield batch_of(rows)
                    rows, tokens = [], 0
            yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def all_bytes_of(texts: list[np.ndarray], v: Vocabulary) -> Iterator[bytes]:
    """The UTF-8 bytes of the texts that pieces spell, without the space that encoding put before each."""
    ids = np.concatenate([np.zeros(0, np.int32), *texts])
    size = v.spelled_size[ids]
    whole = v.spelled[spans(v.spelled_start[ids], size)].tobytes()
    at = np.concatenate(([0], np.cumsum(size)))[np.cumsum([0, *map(len, texts)])].tolist()
    for a, b in zip(at, at[1:], strict=False):
        yield whole[a:b].removeprefix(b" ")


def bytes_of(ids: np.ndarray, v: Vocabulary) -> bytes:
    return next(all_bytes_of([ids], v))


def text_of(ids: list[int], v: Vocabulary) -> str:
    return bytes_of(np.array(ids, np.int64), v).decode("utf-8", "replace")


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """rows with a column text (in place of one of that name) from their column ids; null ids give null. A piece sign in the source text comes back as a space."""
    return widened(rows, lambda every: [[None if x is None else text_of(x, vocabulary(path)) for x in every]], ["ids"], [("text", "string")])
