"""SentencePiece encoding and decoding with sampled segmentations, without replacement.

A text's segmentations are the paths of a lattice whose edges are vocabulary pieces. No piece
reaches over a line end or from a word to the space mark after it, so the lattice is a chain of
short ones, the units, and equal units share one lattice. A run of space marks is one unit with the
word after it; longer units are cut only at places that no piece crosses, so nothing is lost. Path
probabilities are products of piece weights; backward sums over each unit turn them into edge
probabilities at each position.

Gumbel top-k: give every path its log probability plus Gumbel noise and take the k largest: a
sample without replacement. The noise is drawn top-down. The root's largest value is one Gumbel
draw; where a set of paths with largest value G is split, one part keeps G (chosen by its share)
and the other's largest value is a Gumbel draw for its mass, cut off at G. Following the kept
parts along the lattice gives the best path; at each step the edges not taken are a set left on
the agenda, with its value as exact bound; where a path has become unlikely, those of all further
steps are one set, split when it is popped. A-star search pops the best set k times. The value
that would be popped next is the threshold of the inclusion scores.

Random numbers are hashes of the row's key, the round, the unit's place and the step, so a row's
samples depend on nothing but its text and key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from math import frexp, ldexp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .staging import tokenizer_path, unused

VOCABULARY = "piece_bpe_32k.model"
SAMPLES, ALPHA, SEED = 2, 0.5, 1
#: Rows of an Arrow batch, and characters of the texts whose units share their lattices.
ROWS, GROUP = 2048, 3 << 19
#: Rows of a batch that is handed back with ids.
SLICE = 256
#: Log probability of a beginning from which on its other continuations are one set on the agenda:
#: the chance that it is ever popped, and has to be split, is below 1e-20.
UNLIKELY = -60.0
#: Characters beyond which a unit is cut where no piece crosses.
UNIT = 64
#: Characters left in a unit up to which path weights cannot underflow, and up to which positions
#: are worked on as arrays (and steps of walks; they have so many random numbers for each unit).
PLAIN, LEVELS = 32, 4096
#: So few walks are taken one by one from step ``UNIT`` on.
NARROW = 32
CHUNK = 1 << 18
_MARK = "▁"
#: Stand-ins for a zero character and a literal mark: lone surrogates, which no text has.
_ZERO, _LITERAL = "\udc00", "\udc01"
_SPECIAL = {0xDC00: b"\0", 0xDC01: _MARK.encode()}
#: Bits of a trie node's number.
_NODE = 21


class Vocabulary:
    """Pieces as a trie in a hash table, for walking many positions at once."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.bytes = {}
        pieces = {}
        self.text: list[bytes] = [b""] * n
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.text[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and (_MARK not in p[1:] or not p.strip(_MARK)):
                pieces[p] = (i, max(-sp.get_score(i), 0.0))
                self.text[i] = p.replace(_MARK, " ").encode()
        #: the token of a character without a piece, -1 if it is more than one byte
        self.single = np.array([self.bytes[b] for b in range(128)] + [-1])
        # the model has merge ranks, not probabilities: weights follow Zipf's law over the ranks, summed
        # over the pieces of words; runs of space marks have the last rank
        ranks, words = np.array([min(r, n) for _, r in pieces.values()]), np.array([_MARK not in p[1:] for p in pieces])
        logs = -np.log(ranks + 2) - np.log((1 / (ranks[words] + 2)).sum())
        self.fallback = float(np.exp(alpha * (logs[words].min() - 10)))
        trie: dict[tuple[int, int], int] = {}
        self.piece, self.weight = [-1], [0.0]
        for (p, (i, _)), w in zip(pieces.items(), np.exp(alpha * logs)):
            node = 0
            for c in map(ord, p):
                node = trie.setdefault((node, c), len(self.piece))
                if node == len(self.piece):
                    self.piece.append(-1)
                    self.weight.append(0.0)
            self.piece[node], self.weight[node] = i, w
        self.piece, self.weight = np.array(self.piece, np.int32), np.array(self.weight)
        self.bits = 64 - (4 * len(trie)).bit_length()
        size = 1 << (64 - self.bits)
        #: the key (parent and character) and, in the low bits, the child
        self.children = np.full(size, -1, np.int64)
        keys = np.array([a << 21 | c for a, c in trie], np.int64)
        for key, at, node in zip(keys.tolist(), self._slot(keys).tolist(), trie.values()):
            while self.children[at] >= 0:
                at = (at + 1) & (size - 1)
            self.children[at] = key << _NODE | node
        #: the tokens' texts back to back, where each begins, and its length
        self.flat, self.length = np.frombuffer(b"".join(self.text), np.uint8), np.array([len(t) for t in self.text])
        self.begin = np.cumsum(self.length) - self.length

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * W.GOLDEN) >> np.uint64(self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Child nodes, -1 where there is none."""
        keys = nodes << 21 | chars
        at = self._slot(keys)
        have = self.children.take(at)
        differ = have >> _NODE != keys
        out = have & ((1 << _NODE) - 1)
        out[differ] = -1
        open_ = np.flatnonzero(differ & (have >= 0))
        at = (at[open_] + 1) & (len(self.children) - 1)
        while len(open_):
            have = self.children[at]
            hit = have >> _NODE == keys[open_]
            out[open_[hit]] = have[hit] & ((1 << _NODE) - 1)
            go = ~hit & (have >= 0)
            open_, at = open_[go], (at[go] + 1) & (len(self.children) - 1)
        return out

    def tokens(self, g: Lattices, edges: np.ndarray) -> np.ndarray:
        """Token ids of edges; a fallback edge (piece -1) becomes the bytes of its character."""
        pieces = g.piece.take(edges)
        bad = np.flatnonzero(pieces < 0)
        if not len(bad):
            return pieces
        out, last = [], 0
        for i, c in zip(bad.tolist(), g.chars[g.origin(edges[bad])].tolist()):
            out += [pieces[last:i], np.array([self.bytes[b] for b in _SPECIAL.get(c) or chr(c).encode()])]
            last = i + 1
        return np.concatenate([*out, pieces[last:]]).astype(np.int32)

    def decode(self, ids) -> str:
        """The text of token ids."""
        return self.decoded(ids).decode()

    def decoded(self, ids) -> bytes:
        """The text of token ids as UTF-8."""
        if len(ids) < 64:  # array calls cost more
            return b"".join(map(self.text.__getitem__, ids))[1:]
        ids = np.asarray(ids, np.int64)
        return self.flat[_spans(self.begin[ids], self.length[ids])].tobytes()[1:]


def units_of(text: str) -> list[str]:
    """The units of a text: cut before each space mark and after each line end. ``_split`` has
    those of many texts at once; this, ``_cut`` and ``_numbered`` are its plain form without a
    vocabulary."""
    if "\0" in text or _MARK in text:
        text = text.replace("\0", _ZERO).replace(_MARK, _LITERAL)
    if not text:
        return []
    marked = (_MARK + text.replace(" ", _MARK)).replace(_MARK, "\0" + _MARK).replace("\n", "\n\0").replace("\0\0", "\0")
    return marked.strip("\0").split("\0")


def _cut(units: list[str]) -> list[str]:
    return [u[i:i + UNIT] for u in units for i in range(0, len(u), UNIT)]


@dataclass
class Lattices:
    """Edges of many units' lattices; positions of all units are numbered through, those with more
    characters left in their unit first, and those at which units end from ``len(chars)`` on. The
    edges from a position are ``first`` to ``stop``. ``p`` are the edges' probabilities at their
    start, ``upto`` their running sums, above 1 at a position's last edge."""

    start: np.ndarray
    chars: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    end: np.ndarray
    last: np.ndarray
    piece: np.ndarray
    p: np.ndarray
    upto: np.ndarray

    def origin(self, edges):
        """The positions that edges start from."""
        return np.searchsorted(self.first, edges, side="right") - 1


def lattices(units: list[str], v: Vocabulary) -> Lattices:
    chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<i4")
    return _lattices(chars, np.array([len(u) for u in units], np.int64), v)


def _lattices(chars: np.ndarray, size: np.ndarray, v: Vocabulary) -> Lattices:
    """The lattices of units, given as their characters back to back and their lengths."""
    n, top = len(chars), int(size.max(initial=0))
    order = np.argsort(-size, kind="stable")
    # how many units have so many characters at least, and their first position with so many left
    many = np.bincount(size, minlength=top + 1)[::-1].cumsum()[::-1]
    base = many[::-1].cumsum()[::-1] - many
    start = np.empty(len(size), np.int64)
    start[order] = base[size[order]] + np.arange(len(size))
    stop, shuffled = np.cumsum(size)[order], np.empty(n, np.int64)
    for left in range(1, min(top, LEVELS) + 1):
        shuffled[base[left]:base[left - 1]] = chars[stop[:many[left]] - left]
    for unit, long in enumerate(size[order[:many[LEVELS + 1]]] if top > LEVELS else ()):
        left = np.arange(LEVELS + 1, long + 1)
        shuffled[base[left] + unit] = chars[stop[unit] - left]
    chars, hop = shuffled, np.repeat(many[:0:-1], many[:0:-1])  # a unit's next position is ``hop`` further
    found, count, bad = [], np.zeros(n, np.int32), np.zeros(0, np.int64)
    at = own = np.arange(n)
    node, length = np.zeros(n, np.int64), 1
    while len(own):
        node = v.step(node, chars.take(at))
        ok = np.flatnonzero(node >= 0)
        own, at, node = own.take(ok), at.take(ok), node.take(ok)
        at += hop.take(at)
        has = np.flatnonzero(v.piece.take(node) >= 0)
        found.append((own.take(has), at.take(has).astype(np.int32), node.take(has).astype(np.int32)))
        count[found[-1][0]] += 1
        if length == 1:
            bad = np.flatnonzero(count == 0)
            count[bad] += 1
        more = int(np.searchsorted(own, base[length])) if length <= top else 0
        own, at, node, length = own[:more], at[:more], node[:more], length + 1
    first = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=first[1:])
    edges, fill = int(first[-1]), first[:-1].copy()
    end, node = np.empty(edges, np.int32), np.zeros(edges, np.int32)
    single = fill[bad]
    end[single] = bad + hop[bad]
    fill[bad] += 1
    for own, to, child in found:
        place = fill.take(own)
        end[place], node[place] = to, child
        place += 1
        fill[own] = place
    del found, fill
    piece, w = v.piece.take(node), v.weight.take(node)
    piece[single], w[single] = v.single[np.minimum(chars[bad], 128)], v.fallback
    # backward sums, all positions with as many characters left at once; after the first ones as
    # ``total`` by powers of two
    total = np.ones(n + len(size))
    for left in range(1, min(top, PLAIN) + 1):
        a, b = base[left], base[left - 1]
        own = slice(first[a], first[b])
        w[own] *= total.take(end[own])
        total[a:b] = np.add.reduceat(w[own], first[a:b] - first[a])
    power = np.zeros(n + len(size) if top > PLAIN else 0, np.int32)
    for left in range(PLAIN + 1, min(top, LEVELS) + 1):
        a, b = base[left], base[left - 1]
        own = slice(first[a], first[b])
        to, near = end[own], power.take(end.take(first[a:b]))
        part = w[own] * np.ldexp(total.take(to), power.take(to) - np.repeat(near, count[a:b]))
        total[a:b], more = np.frexp(np.add.reduceat(part, first[a:b] - first[a]))
        w[own] = np.ldexp(part, -np.repeat(more, count[a:b]))
        power[a:b] = near + more
    if top > LEVELS:
        _backward(int(base[LEVELS]), first, end, w, total, power)
    w /= np.repeat(total[:n], count)
    run = np.cumsum(w)
    run -= np.repeat(np.append(0.0, run)[first[:-1]], count)
    upto = run.astype(np.float32)
    upto[first[1:] - 1] = 2
    return Lattices(start, chars, first[:-1], first[1:], end, end >= n, piece, w, upto)


def _backward(n: int, first: np.ndarray, end: np.ndarray, w: np.ndarray, total: np.ndarray, power: np.ndarray) -> None:
    """The backward sums of the first ``n`` positions one by one, from the last."""
    first, end, w, total, power = map(memoryview, (first, end, w, total, power))
    for at in range(n - 1, -1, -1):
        own, near, sum_ = range(first[at], first[at + 1]), power[end[first[at]]], 0.0
        for e in own:
            to = end[e]
            w[e] = part = w[e] * ldexp(total[to], power[to] - near)
            sum_ += part
        total[at], more = frexp(sum_)
        power[at] = near + more
        for e in own:
            w[e] = ldexp(w[e], -more)


def _seeds(keys: np.ndarray, turn: int, purpose: int) -> np.ndarray:
    """One seed per row key for each round and purpose."""
    with np.errstate(over="ignore"):
        return W.mix(W.mix(np.asarray(keys).astype(np.uint64) * W.GOLDEN + np.uint64(16 * turn + purpose)) + W.GOLDEN)


def _uniform(seeds, at) -> np.ndarray:
    """Numbers in (0, 1), by seed and place."""
    with np.errstate(over="ignore"):
        h = W.mix(seeds + (np.asarray(at).astype(np.uint64) + np.uint64(1)) * W.GOLDEN)
    u = (h >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 2.0 ** -53
    return u


def _walk(g: Lattices, pos: np.ndarray, seed: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample a path from each position to its unit's end: edges back to back, and their numbers."""
    steps, step, n = [], 0, len(g.chars)
    many = np.zeros(len(pos), np.int64)
    active = np.flatnonzero(pos < n)
    pos = pos.take(active)
    with np.errstate(over="ignore"):
        seed = (seed + word.astype(np.uint64) * (np.uint64(4096) * W.GOLDEN)).take(active)
    while len(active) and step < (LEVELS if len(active) > NARROW else min(UNIT, LEVELS)):
        u = _uniform(seed, step)
        e = g.first.take(pos)
        look = np.flatnonzero(u > g.upto.take(e))
        at, u = e.take(look), u.take(look)
        while len(look):
            at += 1
            e[look] = at
            go = np.flatnonzero(u > g.upto.take(at))
            look, at, u = look.take(go), at.take(go), u.take(go)
        steps.append((active, e))
        step += 1
        pos = g.end.take(e)
        many[active] = step
        go = np.flatnonzero(pos < n)
        active, seed, pos = active.take(go), seed.take(go), pos.take(go)
    rests = [_further(g, int(at), seed[x:x + 1], step) for x, at in enumerate(pos)]
    many[active] += np.array([len(rest) for rest in rests], np.int64)
    begin = np.cumsum(many) - many
    out = np.empty(int(many.sum()), np.int64)
    for k, (own, e) in enumerate(steps):
        out[begin.take(own) + k] = e
    for own, rest in zip(active.tolist(), rests):
        out[begin[own] + step:begin[own] + many[own]] = rest
    return out, many


def _further(g: Lattices, pos: int, seed: np.ndarray, step: int) -> list[int]:
    """The edges of a path to its unit's end from a later step on, one by one."""
    first, end, upto, n, out = memoryview(g.first), memoryview(g.end), memoryview(g.upto), len(g.chars), []
    while pos < n:
        if step == LEVELS:
            with np.errstate(over="ignore"):
                seed, step = W.mix(W.mix(seed) + W.GOLDEN), 0
        for u in _uniform(seed, np.arange(step, min(step + 256, LEVELS))).tolist():
            e = first[pos]
            while u > upto[e]:
                e += 1
            out.append(e)
            step += 1
            pos = end[e]
            if pos >= n:
                break
    return out


def _spans(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``first, first + 1, ..`` back to back."""
    begin = np.cumsum(many) - many
    return np.repeat(first - begin, many) + np.arange(int(many.sum()))


@dataclass
class Path:
    """A sampled segmentation of one text."""

    edges: np.ndarray
    log_p: np.ndarray  # of the edges
    value: float  # perturbed log probability


def _left_values(value, before, log_rest, u):
    """Largest value of the paths not taken: a Gumbel draw for their mass, cut off at ``value``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-value, np.log(-np.log(u)) - (before + log_rest))


def _log_rest(g: Lattices, edges: np.ndarray) -> np.ndarray:
    """Logs of the probabilities of the other edges from where ``edges`` start."""
    share = g.p.take(edges)
    near = np.flatnonzero(share > 1 - 1e-9)
    out = np.log1p(-np.minimum(share, 1 - 1e-9))
    if len(near):  # a difference would be inexact
        pos = g.origin(edges[near])
        first, many = g.first.take(pos), g.stop.take(pos) - g.first.take(pos)
        others, begin = g.p.take(_spans(first, many)), np.cumsum(many) - many
        others[begin + edges[near] - first] = 0
        with np.errstate(divide="ignore"):
            out[near] = np.log(np.add.reduceat(others, begin))
    return out


def _opened(g: Lattices, value: float, path: Path, j: int, pick: np.ndarray, draw: np.ndarray) -> list[tuple]:
    """The set of the paths that leave ``path`` at its ``j``-th edge or later, with largest value
    ``value``, as sets for each of these edges; the one that has the value first."""
    edges, log_p = path.edges[j:], path.log_p[j:]
    before, log_rest = np.cumsum(log_p) - log_p, _log_rest(g, edges)
    share = np.cumsum(np.exp(before + log_rest - (before + log_rest).max()))
    at = min(int(np.searchsorted(share, float(_uniform(pick, j)) * share[-1], side="right")), len(share) - 1)
    values = _left_values(value, path.log_p[:j].sum() + before, log_rest, _uniform(draw, np.arange(j, j + len(edges))))
    values[at] = np.inf
    unit = np.cumsum(g.last[path.edges]) - g.last[path.edges]
    return [(value if x == at else float(values[x]), path, j + x, int(unit[j + x]), (int(edges[x]),))
            for x in np.argsort(-values, kind="stable").tolist() if values[x] > -np.inf]


def sample(units: np.ndarray, bounds: np.ndarray, keys: np.ndarray, g: Lattices, k: int) -> list[tuple[list[Path], float]]:
    """Per text its ``k`` sampled paths (fewer if it has fewer) and the inclusion threshold.

    ``units``: the texts' units back to back; ``bounds``: where each text's start.
    """
    n = len(bounds) - 1
    out: list[list[Path]] = [[] for _ in range(n)]
    agenda: list[list] = [[] for _ in range(n)]  # (value, path, step, its unit, edges taken there)
    many = np.diff(bounds)
    root = -np.log(-np.log(_uniform(_seeds(keys, 0, 0), 0)))
    # what to do this round: text, its value, path so far, and the place to go on from; on the agenda a
    # set of all further places has no edges taken
    todo = [(d, float(root[d]), None, -1, 0, ()) for d in range(n)]
    for turn in range(1, k + 1):
        heads = []
        walks, picks, rests, cuts = (_seeds(keys, turn, x) for x in range(1, 5))
        for d, value, path, j, _, taken in todo:
            if path is None:
                heads.append((d, value, None, -1, -1, taken))
                continue
            pos = int(g.origin(path.edges[j]))
            options = [e for e in range(int(g.first[pos]), int(g.stop[pos])) if e not in taken]
            share = np.cumsum(g.p[options])
            u = float(_uniform(picks[d], j))
            e = options[min(int(np.searchsorted(share, u * share[-1], side="right")), len(options) - 1)]
            heads.append((d, value, path, j, e, (*taken, e)))
        texts, begin = np.array([t[0] for t in todo], np.int64), np.array([t[4] for t in todo], np.int64)
        whole = many[texts] - begin
        word = _spans(begin, whole)
        pos = g.start.take(units.take(np.repeat(bounds[texts], whole) + word))
        place = np.cumsum(whole) - whole
        for t, (_, _, path, _, e, _) in enumerate(heads):
            if path is not None:  # the unit of the new edge goes on at its end
                pos[place[t]] = g.end[e]
        edges, steps = _walk(g, pos, np.repeat(walks[texts], whole), word)
        behind = np.cumsum(steps)
        cut = np.append(0, behind)[np.append(place, len(word))]
        log_p = np.log(g.p.take(edges))
        base = np.zeros(len(texts))
        for t, (d, value, path, j, e, taken) in enumerate(heads):
            own = slice(cut[t], cut[t + 1])
            if path is None:
                new = Path(edges[own], log_p[own], value)
                j = -1
            else:
                new = Path(np.concatenate([path.edges[:j], [e], edges[own]]), np.concatenate([path.log_p[:j], [np.log(g.p[e])], log_p[own]]), value)
                before = float(new.log_p[:j].sum())
                pos = int(g.origin(e))
                rest = sum(float(g.p[x]) for x in range(int(g.first[pos]), int(g.stop[pos])) if x not in taken)
                if rest > 0:
                    agenda[d].append((float(_left_values(value, before, np.log(rest), float(_uniform(rests[d], j)))), new, j, int(begin[t]), taken))
                base[t] = before + float(new.log_p[j])
            out[d].append(new)
            heads[t] = (d, new, j)
        run = np.cumsum(log_p) - log_p
        shift = base - np.append(run, 0.0)[np.minimum(cut[:-1], len(run))]
        run += np.repeat(shift, np.diff(cut))
        at = np.flatnonzero(run > UNLIKELY)
        owner = np.searchsorted(cut, at, side="right") - 1
        values = np.array([new.value for _, new, _ in heads])
        draws = _left_values(values[owner], run[at], _log_rest(g, edges[at]), _uniform(cuts[texts[owner]], at - cut[owner]))
        drawn = np.searchsorted(owner, np.arange(len(texts) + 1))
        stop = cut[:-1] + np.diff(drawn)  # the further edges of each path: those from here on
        further = np.full(len(texts), -np.inf)
        left = np.flatnonzero(stop < cut[1:])
        if len(left):
            log_own = np.add.reduceat(np.append(log_p, 0.0), np.stack([stop[left], cut[left + 1]], 1).ravel())[::2]
            with np.errstate(divide="ignore"):
                log_rest = np.log(-np.expm1(log_own))
            for x in np.flatnonzero(log_own > -1e-9).tolist():  # a difference would be inexact
                own = slice(stop[left[x]], cut[left[x] + 1])
                log_rest[x] = np.logaddexp.reduce(run[own] - run[own.start] + _log_rest(g, edges[own]))
            further[left] = _left_values(values[left], run[stop[left]], log_rest, _uniform(cuts[texts[left]], stop[left] - cut[left]))
        keep = k + 1 - turn  # as many sets as can still be popped, and the threshold
        for t, (d, new, j) in enumerate(heads):
            own = draws[drawn[t]:drawn[t + 1]]
            best = np.argpartition(-own, keep)[:keep] if len(own) > keep else np.arange(len(own))
            agenda[d] += [(float(own[x]), new, j + 1 + x, int(word[np.searchsorted(behind, cut[t] + x, side="right")]), (int(edges[cut[t] + x]),))
                          for x in best.tolist() if own[x] > -np.inf]
            if further[t] > -np.inf:
                agenda[d].append((float(further[t]), new, j + 1 + int(stop[t] - cut[t]), -1, ()))
            agenda[d].sort(key=lambda a: -a[0])
            del agenda[d][keep:]
        if turn < k:
            todo = []
            for d in range(n):
                if agenda[d]:
                    best = agenda[d].pop(0)
                    if not best[4]:
                        best, *others = _opened(g, *best[:3], *(_seeds(keys[d], turn, x) for x in (5, 6)))
                        agenda[d] = sorted(agenda[d] + others, key=lambda a: -a[0])[:keep]
                    todo.append((d, *best))
    return [(paths, max((a[0] for a in agenda[d]), default=-np.inf)) for d, paths in enumerate(out)]


def log_inclusion(log_p: float, threshold: float) -> float:
    """Log of the probability that a path of this probability beats the threshold."""
    if threshold == -np.inf:
        return 0.0
    x = log_p - threshold
    return float(x) if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


_vocabularies: dict = {}


def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    """The vocabulary, built once per Python worker."""
    if (path, alpha) not in _vocabularies:
        _vocabularies[(path, alpha)] = Vocabulary(path, alpha)
    return _vocabularies[(path, alpha)]


class _Numbers(dict):
    """Numbers of keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _numbered(lists: list[list[str]]) -> tuple[list[np.ndarray], _Numbers]:
    """The units of every list as numbers, and what these are the numbers of."""
    known = _Numbers()
    return [np.fromiter(map(known.__getitem__, units), np.int64, len(units)) for units in lists], known


def _uncrossed(chars: np.ndarray, first: np.ndarray, stop: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The places in units of ``chars``, given by where they start and stop, that no piece crosses."""
    at = _spans(first, stop - first)
    end, reach = np.repeat(stop, stop - first), at + 1
    own, to, node = np.arange(len(at)), at, np.zeros(len(at), np.int64)
    while len(own):
        node = v.step(node, chars.take(to))
        ok = np.flatnonzero(node >= 0)
        own, to, node = own.take(ok), to.take(ok) + 1, node.take(ok)
        has = np.flatnonzero(v.piece.take(node) >= 0)
        reach[own.take(has)] = to.take(has)
        go = np.flatnonzero(to < end.take(own))
        own, to, node = own.take(go), to.take(go), node.take(go)
    return at[1:][np.maximum.accumulate(reach)[:-1] <= at[1:]]


def _split(texts: list[str | None], v: Vocabulary | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of all texts as numbers back to back, and where each text's start; the different
    units' characters back to back, and their lengths. Without a vocabulary units are cut to
    ``UNIT``; with one, longer ones where no piece crosses, and runs of space marks stay whole."""
    chars = np.frombuffer("".join([" " + t if t else "" for t in texts]).encode("utf-32-le"), "<i4").copy()
    mark, literal, zero = (np.flatnonzero(chars == ord(c)) for c in (" ", _MARK, "\0"))
    ends = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
    cut = np.zeros(len(chars) + 1, bool)
    cut[mark] = True
    if v is not None:
        cut[mark[1:][np.diff(mark) == 1]] = False
    cut[np.flatnonzero(chars == ord("\n")) + 1] = True
    cut[ends] = True
    chars[mark], chars[literal], chars[zero] = ord(_MARK), ord(_LITERAL), ord(_ZERO)
    start = np.flatnonzero(cut)
    parts = -(-np.diff(start) // UNIT)
    if parts.max(initial=0) > 1 and v is not None:
        long = np.flatnonzero(parts > 1)
        cut[_uncrossed(chars, start[long], start[long + 1], v)] = True
        start = np.flatnonzero(cut)
    elif parts.max(initial=0) > 1:
        start = np.append(np.repeat(start[:-1], parts) + UNIT * _spans(np.zeros(len(parts), np.int64), parts), len(chars))
    found = pa.Array.from_buffers(pa.large_binary(), len(start) - 1, [None, pa.py_buffer(4 * start), pa.py_buffer(chars)]).dictionary_encode()
    _, offsets, known = found.dictionary.buffers()
    offsets = np.frombuffer(offsets, np.int64)[:len(found.dictionary) + 1] // 4
    known = np.frombuffer(known, "<i4")[:offsets[-1]] if len(start) > 1 else chars
    bounds = np.searchsorted(start, ends)
    return found.indices.to_numpy().astype(np.int64), bounds, known, np.diff(offsets)


def encodings(texts: list[str | None], keys: np.ndarray, v: Vocabulary, k: int, whole: bool = False):
    """Yield per text a list of (token ids, log probability, perturbed value, log inclusion).

    ``whole``: of all segmentations, as ``encode`` and ``digests`` have it; otherwise of those that
    keep to the units of ``units_of``, cut to ``UNIT``.
    """
    # a position in a run of spaces has about four times as many edges
    size = np.concatenate([[0], np.cumsum([len(t) + 6 * t.count("  ") if t else 0 for t in texts])])
    for first, stop in W.chunks(size, GROUP):
        units, bounds, known, long = _split(texts[first:stop], v if whole else None)
        g = _lattices(known, long, v)
        del known
        for lo, hi in W.chunks(size[first:stop + 1], CHUNK):
            some = [d for d in range(lo, hi) if bounds[d] < bounds[d + 1]]
            own = slice(bounds[lo], bounds[hi])
            found = iter(sample(units[own], bounds[[*some, hi]] - bounds[lo], keys[first:stop][some], g, k) if some else ())
            for d in range(lo, hi):
                if bounds[d] == bounds[d + 1]:
                    yield [(np.zeros(0, np.int32), 0.0, 0.0, 0.0)]
                    continue
                paths, threshold = next(found)
                rows = []
                for path in paths:
                    total = float(path.log_p.sum())
                    rows.append((v.tokens(g, path.edges), total, path.value, log_inclusion(total, threshold)))
                yield rows


def _keys(docs: DataFrame, seed: int):
    """Row keys: doc_id, or where that is null a hash of the text, with the seed."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.lit(seed))


def encode(docs: DataFrame, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, path: str | None = None) -> DataFrame:
    """``docs`` with ``samples``: at most ``k`` different segmentations of the whole text, drawn
    without replacement, best value first: ids, log_prob, perturbed, log_inclusion.

    Decoding the ids of any of them gives the text back exactly, whatever its characters. A text
    with fewer than ``k`` segmentations has all of them (log_inclusion 0). A null or empty text
    has one, without ids. Rows of equal doc_id and text have equal samples; null doc_ids are
    keyed by the text. Other columns pass through, but for one named ``samples``, which the
    result replaces.
    """
    docs = docs.drop("samples")
    key, = unused(docs, "_key")
    path = path or tokenizer_path(VOCABULARY)
    names = docs.columns
    at = names.index("text")
    kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, alpha)
        for batch in batches:
            keys = batch.column(key).to_numpy().view(np.uint64)
            encoded = encodings(batch.column(at).to_pylist(), keys, v, k, whole=True)
            for lo in range(0, batch.num_rows, SLICE):
                rows = [[dict(zip(("ids", "log_prob", "perturbed", "log_inclusion"), r)) for r in found] for found in islice(encoded, SLICE)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, SLICE).columns[:-1], pa.array(rows, kind)], names=[*names, "samples"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn(key, _keys(docs, seed)).mapInArrow(
        run, f"{fields}, samples array<struct<ids: array<int>, log_prob: double, perturbed: double, log_inclusion: double>>")


def decode(tokens: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``tokens`` with ``decoded``: the text of a column of token ids; null ids give null."""
    path = path or tokenizer_path(VOCABULARY)
    names = tokens.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else v.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{fields}, decoded string")


_DIGEST = ("doc_id long, n_chars long, n_samples int, n_distinct int, n_pieces string, ids_crc32 string, log_probs string, "
           "log_inclusions string, decoded boolean")


def digests(docs: DataFrame, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, path: str | None = None) -> DataFrame:
    """Per row of ``docs`` the samples of ``encode`` in short: numbers of pieces, checksums of the
    ids, scores (comma-joined, best first), and whether all of them decode to the text."""
    path = path or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, alpha)
        names = [c.split()[0] for c in _DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.bool_()]
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for i, t, found in zip(batch.column("doc_id").to_pylist(), texts, encodings(texts, batch.column("_key").to_numpy().view(np.uint64), v, k, whole=True)):
                crc, raw = [zlib.crc32(ids.tobytes()) for ids, *_ in found], (t or "").encode()
                out.append((i, len(t or ""), len(found), len({ids.tobytes() for ids, *_ in found}), ",".join(str(len(r[0])) for r in found), ",".join(map(str, crc)),
                            ",".join(f"{r[1]:.6f}" for r in found), ",".join(f"{r[3]:.6f}" for r in found), all(v.decoded(r[0]) == raw for r in found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=names)

    return docs.select("doc_id", "text", _keys(docs, seed).alias("_key")).mapInArrow(run, _DIGEST)
