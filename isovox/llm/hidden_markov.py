"""Scoring texts with a hidden Markov language model.

States emit classes of words: each word that is frequent enough to be learned is a class of its own, all others are in
classes by their last two bytes, within which a word has its share of the training tokens, plus one. A first guess
comes from clusters of all training texts, made in their tasks and merged level by level; Baum-Welch rounds then gather
counts from every partition of the training texts, until their likelihood stops gaining. The likelihood is exact, by
the scaled forward recursion: a long text is cut in segments that run side by side, so that the number of steps doesn't
follow the longest text. What enters a segment is first taken from a short run over the end of the one before; where
that one's own end then turns out to be another, the segment runs again, until all agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from copy import copy
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovox.llm import _text
from isovox.llm.language_id import fold
from isovox.store import dropped, partitions, written

STATES = 8
#: A word is a class of its own if it makes up this share of the training tokens and occurs so many times at least: a
#: vocabulary that grows with the corpus, and by its share alone is never over half a million words.
OWN_SHARE, OWN_LEAST = 2e-6, 10
#: Words at most whose counts every task has, where no more have a class of their own; the rest meet theirs in a join.
FREQUENT = 1 << 18
#: Classes of all other words.
TAILS = 256
#: Rounds end when one gains less than this share of the log likelihood over the prior's.
GAIN = 1e-3
#: For the first guess: the most frequent classes by which texts are clustered, clusters that a task or a merge leaves,
#: clusters that are merged at once, and those that a merge then joins pair by pair.
TOP, CLUSTERS, MERGED, FINE = 1024, 16, 1024, 128
SEGMENT = 128
#: Tokens of the short runs by which segments begin, and how far what is taken from them may be off what is found.
WARM, AGREE = 32, 1e-6
#: Tokens of the corpus-wide distribution that every state starts from.
PRIOR = 50.0
END = np.uint64(0)
CHUNK = 3 << 20
#: Tokens and texts that a round takes at once.
AT_ONCE, TEXTS = 500_000, 2000
#: Classes whose sums go together from task to task.
WIDE = 512
#: Steps that expected counts of a task are rounded to, in a token.
UNIT = 4096


@dataclass
class Tokens:
    hash: np.ndarray
    tail: np.ndarray
    first: np.ndarray


def tokens(column: pa.Array) -> Tokens:
    """Lower-cased (A-Z) words of each text, then one end."""
    w = _text.words(column, lower=True)
    n = len(w.counts)
    first = w.first + np.arange(n + 1)
    at = np.arange(len(w.start)) + w.doc()
    h = np.full(int(first[-1]), END)
    h[at] = w.hashes()
    tail = np.zeros(len(h), np.int64)
    last = w.data[w.end - 1].astype(np.int64) if len(w.end) else np.zeros(0, np.int64)
    prior = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64) if len(w.end) else last
    tail[at] = (last * 37 + prior * 101) % TAILS
    return Tokens(h, tail, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, tail, n) of a task's tokens, merged as they come."""
    held: list[tuple] = []

    def merged() -> tuple:
        h, tail, n = (np.concatenate(x) for x in zip(*held, strict=True))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        return u, tail[first], np.bincount(back, n).astype(np.int64)

    def rows(x: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["hash", "tail", "n"])

    for part in _text.chunks(batches, limit=CHUNK):
        t = tokens(part.column("text"))
        u, first, n = np.unique(t.hash, return_index=True, return_counts=True)
        held.append((u, t.tail[first], n))
        if sum(len(x[0]) for x in held) > 2_000_000:
            held = [merged()]
            if len(held[0][0]) > 1_500_000:
                yield rows(held.pop())
    if held:
        yield rows(merged())


@dataclass
class Model:
    known: np.ndarray  # sorted hashes of frequent words
    log_count: np.ndarray  # log10(count + 1) of each
    own: np.ndarray  # its class, or -1 for its tail's
    tail_log: np.ndarray  # log10 of each tail's tokens + words + 1
    prior: np.ndarray  # of classes
    emit: np.ndarray  # [class, state], over the prior
    move: np.ndarray
    start: np.ndarray

    @cached_property
    def by_state(self) -> np.ndarray:
        return np.ascontiguousarray(self.emit.T)

    @cached_property
    def _begins(self) -> tuple[np.ndarray, np.uint64]:
        """Where hashes of each first few bits begin among the known ones, four beginnings a word; and the other bits."""
        bits = len(self.known).bit_length() + 2
        other = np.uint64(64 - bits)
        n = np.bincount((self.known >> other).astype(np.int64), minlength=1 << bits)
        return (np.cumsum(n) - n).astype(np.int32), other

    def _sorted_in(self, h: np.ndarray) -> np.ndarray:
        """Where hashes stand in those known, or would, but at the last at most; they are spread evenly, so few steps find them."""
        begins, other = self._begins
        last = len(self.known) - 1
        at = np.minimum(begins[h >> other], last).astype(np.int64)
        below = np.flatnonzero(self.known[at] < h)
        while len(below):
            below = below[at[below] < last]
            at[below] += 1
            below = below[self.known[at[below]] < h[below]]
        return at

    def lookup(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its place among frequent words (-1: elsewhere), its class, whether that is a tail."""
        at = self._sorted_in(t.hash) if len(self.known) else np.zeros(len(t.hash), np.int64)
        at = np.where(self.known[at] == t.hash, at, -1) if len(self.known) else np.full(len(t.hash), -1)
        own = np.where(at >= 0, self.own[at], -1) if len(self.known) else at
        own = np.where(t.hash == END, 0, own)
        tail = own < 0
        return at, np.where(tail, 1 + t.tail, own), tail


class Segments:
    """Segments of texts, the longest first, laid out step by step: the tokens of a step stand side by side.

    Arrays are [state, token], in 32-bit floats scaled at every step; logs and sums over tokens are doubles.
    """

    def __init__(self, classes: np.ndarray, start: np.ndarray, length: np.ndarray, model: Model):
        self.move, self.n, self.length = model.move.astype(np.float32), len(start), length
        self.steps = int(length.max()) if self.n else 0
        self.active = np.searchsorted(-length, -np.arange(self.steps), side="left")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        place = np.concatenate([start[:k] + t for t, k in enumerate(self.active.tolist())]) if self.n else np.zeros(0, np.int64)
        self.classes = classes[place].astype(np.int64, copy=False)
        self.emit = np.take(model.by_state, self.classes, axis=1)

    def forward(self, state: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """From what is expected at the first tokens: states at the ends, the logs of the likelihoods, states at all tokens."""
        state, logs = state.astype(np.float32), np.zeros(self.n)
        every = np.empty(self.emit.shape, np.float32) if keep else None
        for t in range(self.steps):
            k, at = int(self.active[t]), int(self.at[t])
            v = (state[:, :k] if t == 0 else self.move.T @ state[:, :k]) * self.emit[:, at : at + k]
            size = np.maximum(v.sum(axis=0), np.float32(1e-37))
            v /= size
            logs[:k] += np.log(size)
            state[:, :k] = v
            if keep:
                every[:, at : at + k] = v
        return state, logs, every

    def part(self, which: np.ndarray) -> tuple[Segments, np.ndarray]:
        """Some of the segments, by their rising places, and the places of their tokens among all."""
        made = copy(self)
        made.n, made.length = len(which), self.length[which]
        made.steps = int(made.length[0])
        made.active = np.searchsorted(-made.length, -np.arange(made.steps), side="left")
        made.at = np.concatenate([[0], np.cumsum(made.active)])
        flat = np.concatenate([self.at[t] + which[:k] for t, k in enumerate(made.active.tolist())])
        made.classes, made.emit = self.classes[flat], np.take(self.emit, flat, axis=1)
        return made, flat

    def lead(self) -> np.ndarray:
        """What goes back from the first tokens to the ones before, nothing being known of what follows the last."""
        beta = np.ones((len(self.move), self.n), np.float32)
        for t in range(self.steps - 1, -1, -1):
            k, at = int(self.active[t]), int(self.at[t])
            back = self.move @ (self.emit[:, at : at + k] * beta[:, :k])
            beta[:, :k] = back / np.maximum(back.sum(axis=0), np.float32(1e-37))
        return beta

    def backward(self, every: np.ndarray, enter: np.ndarray | None, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chances of the states at all tokens, expected moves less the factor ``move``, what goes back before the first.

        ``enter``: states before the first tokens (None: there are none); ``after``: what follows the last.
        """
        beta, gamma, moves = after.astype(np.float32), np.empty(self.emit.shape, np.float32), np.zeros(self.move.shape)
        for t in range(self.steps - 1, -1, -1):
            k, at = int(self.active[t]), int(self.at[t])
            g = every[:, at : at + k] * beta[:, :k]
            g /= np.maximum(g.sum(axis=0), np.float32(1e-37))
            gamma[:, at : at + k] = g
            if t == 0 and enter is None:
                break
            out = self.emit[:, at : at + k] * beta[:, :k]
            back = self.move @ out
            into = every[:, int(self.at[t - 1]) :][:, :k] if t else enter.astype(np.float32)
            moves += (into / np.maximum((into * back).sum(axis=0), np.float32(1e-37))) @ out.T
            beta[:, :k] = back / np.maximum(back.sum(axis=0), np.float32(1e-37))
        return gamma, moves, beta


class Lattice:
    """The exact recursions over texts, cut in segments: the first of each text, and the others in their order."""

    def __init__(self, classes: np.ndarray, first: np.ndarray, model: Model):
        self.model, self.classes, self.first = model, classes, first
        size = np.diff(first)
        n = -(-size // SEGMENT)
        self.doc = np.repeat(np.arange(len(size)), n)
        nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(n) - n, n)
        start = first[:-1][self.doc] + nth * SEGMENT
        length = np.minimum(SEGMENT, first[1:][self.doc] - start)
        order = np.argsort(-length, kind="stable")
        self.doc, nth, start, length = self.doc[order], nth[order], start[order], length[order]
        head = nth == 0
        self.heads, self.head_doc = Segments(classes, start[head], length[head], model), self.doc[head]
        self.rest, self.rest_doc = Segments(classes, start[~head], length[~head], model), self.doc[~head]
        # Of each other segment the one before (-1: a head) and the head of its text; of all segments the one that follows.
        nth, self.start = nth[~head], start[~head]
        self.before, self.after = np.full(self.rest.n, -1), np.full(self.rest.n, -1)
        place, self.head_after = np.full(len(size), -1), np.full(self.heads.n, -1)
        by = np.argsort(nth, kind="stable")
        for at in np.split(by, np.cumsum(np.bincount(nth)[1:])[:-1]) if len(by) else []:
            d = self.rest_doc[at]
            self.before[at], place[d] = place[d], at
        inner = np.flatnonzero(self.before >= 0)
        self.after[self.before[inner]] = inner
        self.head_of = np.zeros(len(size), np.int64)
        self.head_of[self.head_doc] = np.arange(self.heads.n)
        firsts = np.flatnonzero(self.before < 0)
        self.head_after[self.head_of[self.rest_doc[firsts]]] = firsts

    def _forward(self, keep: bool = False):
        """Logs of likelihoods by text; of both kinds of segments the states at all tokens; what enters the others."""
        m, s = self.model, len(self.model.start)
        log = np.zeros(len(self.first) - 1)
        value, logs, every = self.heads.forward(np.repeat(m.start[:, None], self.heads.n, axis=1), keep)
        log[self.head_doc] += logs
        if not self.rest.n:
            return log, every, None, None
        enter = value[:, self.head_of[self.rest_doc]]
        inner = np.flatnonzero(self.before >= 0)
        if len(inner):
            warm = min(WARM, SEGMENT)
            ends = Segments(self.classes, self.start[self.before[inner]] + SEGMENT - warm, np.full(len(inner), warm), m)
            enter[:, inner] = ends.forward(np.full((s, len(inner)), 1 / s))[0]
        value, logs, more = self.rest.forward(m.move.T @ enter, keep)
        while len(inner):
            inner = inner[np.abs(value[:, self.before[inner]] - enter[:, inner]).max(axis=0) > AGREE]
            if not len(inner):
                break
            enter[:, inner] = value[:, self.before[inner]]
            some, flat = self.rest.part(inner)
            value[:, inner], logs[inner], states = some.forward(m.move.T @ enter[:, inner], keep)
            if keep:
                more[:, flat] = states
            # Those that follow the ones that ran again.
            inner = np.sort(self.after[inner])
            inner = inner[inner >= 0]
        np.add.at(log, self.rest_doc, logs)
        return log, every, more, enter

    def _backward(self, more: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``Segments.backward`` of the segments that aren't heads."""
        s, rest = len(self.model.start), self.rest
        follows = np.ones((s, rest.n), np.float32)
        inner = np.flatnonzero(self.after >= 0)
        if len(inner):
            lead = Segments(self.classes, self.start, np.minimum(rest.length, min(WARM, SEGMENT)), self.model).lead()
            follows[:, inner] = lead[:, self.after[inner]]
        gamma, moves, lead = rest.backward(more, enter, follows)
        while len(inner):
            inner = inner[np.abs(lead[:, self.after[inner]] - follows[:, inner]).max(axis=0) > AGREE]
            if not len(inner):
                break
            some, flat = rest.part(inner)
            states, into = np.take(more, flat, axis=1), enter[:, inner]
            moves -= some.backward(states, into, follows[:, inner])[1]
            follows[:, inner] = lead[:, self.after[inner]]
            gamma[:, flat], more_moves, lead[:, inner] = some.backward(states, into, follows[:, inner])
            moves += more_moves
            inner = np.sort(self.before[inner])
            inner = inner[inner >= 0]
        return gamma, moves, lead

    def likelihood(self) -> np.ndarray:
        """Natural logarithms, one for each text."""
        prior = np.concatenate([[0.0], np.cumsum(np.log(self.model.prior)[self.classes])])
        return self._forward()[0] + prior[self.first[1:]] - prior[self.first[:-1]]

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts: of starts, moves, and emissions [state, class]; and the log likelihood over the prior's."""
        log, every, more, enter = self._forward(True)
        classes, after = len(self.model.prior), np.ones((len(self.model.start), self.heads.n), np.float32)
        if self.rest.n:
            gamma, others, lead = self._backward(more, enter)
            emits = np.stack([np.bincount(self.rest.classes, g, classes) for g in gamma])
            long = self.head_after >= 0
            after[:, long] = lead[:, self.head_after[long]]
        gamma, moves, _ = self.heads.backward(every, None, after)
        head = gamma[:, : self.heads.n].sum(axis=1, dtype=np.float64)
        own = np.stack([np.bincount(self.heads.classes, g, classes) for g in gamma])
        if self.rest.n:
            moves += others
            own += emits
        emits = own
        return head, moves * self.model.move, emits, log.sum(keepdims=True)


def refit(model: Model, head: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Model:
    """The model that expected counts make: emissions with PRIOR tokens of the corpus-wide share, moves and starts with one."""
    emit = (emits + PRIOR * model.prior[None]) / (emits.sum(axis=1, keepdims=True) + PRIOR)
    s = len(head)
    return Model(model.known, model.log_count, model.own, model.tail_log, model.prior, (emit / model.prior[None]).T.astype(np.float32), (moves + 1 / s) / (moves.sum(axis=1, keepdims=True) + 1), (head + 1 / s) / (head.sum() + 1))


def _code(model: Model):
    """The classes of the tokens of each text: what rounds read in place of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.chunks(batches, limit=CHUNK):
            t = tokens(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(t.first.astype(np.int32)), pa.array(model.lookup(t)[1].astype(np.int32)))], ["classes"])

    return run


def _coded(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes and offsets of some texts at a time."""
    for batch in batches:
        lists = batch.column("classes")
        flat, offs = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        at, n = 0, len(lists)
        while at < n:
            to = min(n, at + TEXTS, max(at + 1, int(np.searchsorted(offs, offs[at] + AT_ONCE, side="right")) - 1))
            yield flat[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def clusters(table: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Sums of the rows of counts that are alike: at most ``n`` rows, by spherical k-means over damped counts.

    Rows weigh by their counts, as seeds too: else the few that are like no other take all of them, being short.
    """
    flat, size = np.log1p(table), table.sum(axis=1)
    flat /= np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)
    seeds = [int(size.argmax())]
    near = flat @ flat[seeds[0]]
    while len(seeds) < min(n, len(table)):
        seeds.append(int(((1 - near) * size).argmax()))
        near = np.maximum(near, flat @ flat[seeds[-1]])
    centre, heavy = flat[seeds], flat * size[:, None]
    for k in range(rounds + 1):
        deal = (flat @ centre.T).argmax(axis=1)
        if k < rounds:
            centre = np.stack([heavy[deal == j].sum(axis=0) if (deal == j).any() else c for j, c in enumerate(centre)])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    made = np.stack([table[deal == j].sum(axis=0) for j in range(len(centre))])
    return made[made.any(axis=1)]


def joined(table: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` sums of rows of counts: of many clusters those two become one, again and again, that lose the least likelihood."""
    rows = clusters(table, max(FINE, n)).astype(np.float64)

    def lost(i: int, others: np.ndarray) -> np.ndarray:
        log = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum(axis=-1) - x.sum(axis=-1) * np.log(np.maximum(x.sum(axis=-1), 1e-300))
        return log(rows[i]) + log(others) - log(rows[i] + others)

    loss = np.full((len(rows), len(rows)), np.inf)
    for i in range(len(rows) - 1):
        loss[i, i + 1 :] = lost(i, rows[i + 1 :])
    while len(rows) > n:
        i, j = divmod(int(loss.argmin()), len(rows))
        rows[i] += rows[j]
        rows, loss = np.delete(rows, j, 0), np.delete(np.delete(loss, j, 0), j, 1)
        now = lost(i, rows)
        loss[i, i + 1 :], loss[:i, i] = now[i + 1 :], now[:i]
    return rows


def _rows(table: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.astype(np.float32).tobytes() for r in table], pa.binary())], ["counts"])


def _table(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of counts, in an order that is theirs."""
    return np.frombuffer(b"".join(sorted(column.to_pylist())), np.float32).reshape(-1, width)


def _clustered(rank: np.ndarray, width: int):
    """The clusters of a task's texts; ``rank``: the column of each class, -1: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width), np.float32)
        for classes, first in _coded(batches):
            doc, column = np.repeat(np.arange(len(first) - 1), np.diff(first)), rank[classes]
            some = column >= 0
            table = np.bincount(doc[some] * width + column[some], minlength=(len(first) - 1) * width).astype(np.float32).reshape(-1, width)
            held = np.concatenate([held, clusters(table, CLUSTERS)])
            if len(held) > 4 * CLUSTERS:
                held = clusters(held, CLUSTERS)
        if held.any():
            yield _rows(clusters(held, CLUSTERS))

    return run


def guessed(model: Model, coded: DataFrame) -> Model:
    """States from clusters of all texts: tasks' own, merged in groups of a bounded number until the driver can deal them."""
    states, width = len(model.start), min(TOP, len(model.prior))
    top = np.argsort(-model.prior, kind="stable")[:width]
    rank = np.full(len(model.prior), -1)
    rank[top] = np.arange(width)
    found = written(coded.mapInArrow(_clustered(rank, width), "counts binary"), "clusters")
    while (n := found.count()) > MERGED:
        merge = lambda t: pa.Table.from_batches([_rows(joined(_table(t.column("counts"), width), CLUSTERS))])
        found = written(found.groupBy(F.pmod(F.xxhash64("counts"), F.lit(-(-n // MERGED)))).applyInArrow(merge, "counts binary"), "clusters")
    rows = _table(found.toArrow().column("counts"), width).astype(np.float64)
    dropped(found)
    if not len(rows):
        return model
    prior, emits = model.prior[top] / model.prior[top].sum(), joined(rows, states)
    for _ in range(6):
        shares = (emits + PRIOR * prior) / (emits.sum(axis=1, keepdims=True) + PRIOR)
        deal = (rows @ np.log(shares).T).argmax(axis=1)
        emits = np.stack([rows[deal == j].sum(axis=0) for j in range(states)])
    emit = np.ones((len(model.prior), states), np.float32)
    emit[top] = ((emits + PRIOR * prior) / (emits.sum(axis=1, keepdims=True) + PRIOR) / prior).T
    start = emits.sum(axis=1) + 1
    return replace(model, emit=emit, move=np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), start=start / start.sum())


def _packed(whole: np.ndarray) -> pa.RecordBatch:
    """Columns of a table of whole numbers as blobs of ``WIDE`` columns each, those without a count left out.

    Bytes of the same place stand together, so that the many small counts take little.
    """
    press = zstandard.ZstdCompressor(level=1)
    parts = [(i, np.ascontiguousarray(whole[:, i * WIDE : (i + 1) * WIDE])) for i in range(-(-whole.shape[1] // WIDE))]
    parts = [(i, press.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())) for i, x in parts if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["part", "sums"])


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(np.int64).ravel()


def _expect(model: Model):
    """A task's expected counts: [state, 1 + moves + starts + classes], where state 0 has the log likelihood first.

    They are whole numbers of ``1 / UNIT`` of a token, so that their sums are the same in any order of tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for classes, first in _coded(batches):
            found = Lattice(classes, first, model).expected()
            total = list(found) if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total:
            head, moves, emits, log = total
            gain = np.zeros((len(head), 1))
            gain[0] = log
            yield _packed(np.rint(np.concatenate([gain, moves, head[:, None], emits], axis=1) * UNIT).astype(np.int64))

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the blobs of each part, added as they come."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            x = _unpacked(blob)
            held[part] = held[part] + x if part in held else x
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "sums"])


def expected(model: Model, coded: DataFrame) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The log likelihood over the prior's of all the texts, and their Baum-Welch counts.

    What a task sends, and the driver gets, is bounded by the number of classes.
    """
    states, none = len(model.start), np.zeros(0)
    # Tasks need no words, only classes.
    rows = coded.mapInArrow(_expect(replace(model, known=none, log_count=none, own=none)), "part int, sums binary")
    rows = rows.repartition(partitions(coded.sparkSession), "part").mapInArrow(_summed, "part int, sums binary").toArrow()
    whole = np.zeros((states, 2 + states + len(model.prior)))
    for part, blob in zip(rows.column("part").to_pylist(), rows.column("sums").to_pylist(), strict=True):
        whole[:, part * WIDE : (part + 1) * WIDE] += np.frombuffer(blob, np.int64).reshape(states, -1) / UNIT
    return float(whole[0, 0]), whole[:, 1 + states], whole[:, 1 : 1 + states], whole[:, 2 + states :]


def _threshold(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more; counts are taken by eighths of powers of two."""
    step = F.floor(F.log2(F.col("n")) * 8).cast("int")
    rows = sorted(((r["step"], r["words"], r["low"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("low")).collect()), reverse=True)
    total, least = 0, None
    for _, words, low in rows:
        total += words
        if total > most:
            break
        least = low
    return least if least is not None else 1 << 62


def coded(docs: DataFrame, model: Model) -> DataFrame:
    """(classes) of each text, written."""
    return written(docs.select("text").mapInArrow(_code(model), "classes array<int>"), "classes")


def fit(docs: DataFrame, states: int = STATES, gain: float = GAIN) -> tuple[Model, DataFrame, int, int]:
    """A model of the texts of ``docs`` (doc_id, text), the table of counts (hash, tail, n), its tokens and words.

    Null texts are empty: one end. Repeated rows count as often as they are there. Words of equal counts either all
    have a class of their own or none has. Texts of any length are counted whole; other columns are not read. Without
    any text the model has no word and every class the same share.
    """
    counts = written(docs.select("text").mapInArrow(_count, "hash bigint, tail int, n bigint").groupBy("hash").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")), "counts")
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(OWN_LEAST, OWN_SHARE * n_tokens)
    # The end is always among them, however many words are as frequent.
    often = counts.where((F.col("hash") == int(END)) | (F.col("n") >= min(_threshold(counts, FREQUENT), least))).toArrow()
    h, n, tail = (often.column(c).to_numpy().astype(np.int64) for c in ("hash", "n", "tail"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    h, n, tail = h[order], n[order], tail[order]
    top = np.flatnonzero((n >= least) & (h != END))
    own = np.full(len(h), -1)
    own[top] = 1 + TAILS + np.arange(len(top))
    # Tokens and words of each tail: all of the corpus less the words with a class of their own.
    tails = np.zeros((TAILS, 2))
    for r in counts.where((F.col("hash") != int(END)) & (F.col("n") < least)).groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        tails[r["tail"]] = r["n"], r["k"]
    end = int(n[h == END].sum())
    share = np.concatenate([[end], tails[:, 0], n[top]]) + 1.0
    prior = share / share.sum()
    model = Model(h, np.log10(n + 1.0), own, np.log10(tails.sum(axis=1) + 1), prior, np.ones((len(prior), states), np.float32), np.full((states, states), 1 / states), np.full(states, 1 / states))
    if not end:
        return model, counts, int(n_tokens), int(n_words)
    texts, last = coded(docs, model), -np.inf
    model = guessed(model, texts)
    while True:
        # The likelihood is that of the model before this round's counts.
        log, *found = expected(model, texts)
        model = refit(model, *found)
        if log - last <= gain * abs(log):
            dropped(texts)
            return model, counts, int(n_tokens), int(n_words)
        last = log


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _text.chunks(batches, limit=CHUNK):
            t = tokens(part.column("text"))
            at, classes, tail = model.lookup(t)
            n = np.diff(t.first)
            doc = np.repeat(np.arange(len(n)), n)
            per = lambda x: np.bincount(doc, x, minlength=len(n))
            logs = np.where(at >= 0, model.log_count[at], 0.0) if len(model.known) else np.zeros(len(at))
            within = np.where(tail, logs - model.tail_log[t.tail], 0.0)
            forward = Lattice(classes, t.first, model).likelihood() / np.log(10)
            # The end is never looked up elsewhere: it is frequent or was never seen.
            rare = (at < 0) & (t.hash != END)
            ends = np.concatenate([[0], np.cumsum(per(rare).astype(np.int64))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(t.hash[rare].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(n), pa.array(per(at >= 0).astype(np.int64)), pa.array(per(logs)), pa.array(forward + per(within)), lists],
                ["row", "doc_id", "n_tokens", "known", "logs", "model", "rare"],
            )

    return run


def likelihoods(docs: DataFrame, fitted: tuple[Model, DataFrame, int, int]) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text).

    Null and empty texts are one end. Repeated rows get equal scores; scores are sums of whole texts, however long. Other
    columns are left out, whatever their names; an empty table gives none.
    """
    model, counts, n_tokens, n_words = fitted
    schema = "row bigint, doc_id bigint, n_tokens bigint, known bigint, logs double, model double, rare array<bigint>"
    scored = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_score(model), schema), "scored")
    # Words too rare for every task to know their counts meet them in a join.
    rare = scored.select("row", F.explode("rare").alias("hash")).join(counts.select("hash", "n"), "hash")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    full = scored.drop("rare").join(rare, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("logs") + zero(F.col("more_logs")) - F.col("n_tokens") * float(np.log10(n_tokens + n_words + 1))
    return full.select("doc_id", "n_tokens", (F.col("known") + zero(F.col("more"))).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + zero(F.col("more_logs"))).alias("score"))


def op10_hidden_markov(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fitted = fit(docs.where(fold(F.col("doc_id"), 7) != 2))
    made = likelihoods(docs, fitted)
    return made.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
