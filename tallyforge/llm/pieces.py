"""SentencePiece encoding by sampling without replacement, and decoding.

A segmentation of a text is a path through the lattice of vocabulary pieces; its probability is proportional to the
product of its pieces' weights (1 - score)^-alpha, score being that of the model file (minus the rank of a BPE piece).
Characters without a piece of their own are byte pieces. Gumbel top-k: every segmentation has its log-probability plus
Gumbel noise; the k with the largest sums are emitted, largest first. They are found by A* over the lattice: exact
backward log-sums give each set of paths "as a path found so far up to a step, different there" its mass, hence its
largest perturbed value (a Gumbel truncated by that of its parent set); the set with the largest value is popped, its
best path sampled step by step, and what remains of it split in the same way. ``log_inclusion`` is the logarithm of the
probability that the segmentation is among the k given the (k+1)-th value; exp(log_prob - log_inclusion) weighs it for
unbiased estimates. ``inclusion`` is that probability, 0 where it is too small for a double.

Work is vectorised: the lattice is cut where no piece can cross (at pairs of characters that no piece has), equal segments
share one backward pass, and all segments of a run of texts are sampled together. Random numbers are hashes of the seed,
the row's key, the sample and the place in the text. Sums over steps are of whole numbers, log-probabilities in units of
1 / ``UNIT`` and probabilities in those of 1 / ``PART``, so that they don't depend on what else is in the run: a row gives
the same bytes wherever it is computed. Every output is decoded; a text that doesn't come back (two segments of one hash)
is encoded again by itself.

Nulls and edge cases: a null text counts as empty; an empty text has one segmentation, without pieces; a text with fewer
than k segmentations gives all it has; a null key is a key of its own; rows of one key and text give the same samples;
an empty table gives no rows. A literal U+2581 is encoded in bytes, so decoding gives back exactly the text. Memory
follows the longest text, at some 100 bytes a character.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import table, tidy

MODEL = "piece_bpe_32k.model"
SAMPLES, ALPHA, SEED = 2, 0.5, 1
CHUNK = 1 << 17
UNIT, PART = 1 << 34, 1 << 50
_U = np.uint64
_SPACE, _LITERAL = 0x2581, 0x110000
_BASE = 0xD1342543DE82EF95
_GOLD = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((_mix(h) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of the locations, below the bounds; -inf for location -inf."""
    g = location - np.log(-np.log(u))
    with np.errstate(invalid="ignore"):
        out = np.minimum(g, bound) - np.log1p(np.exp(-np.abs(g - bound)))
    return np.where(np.isneginf(location), -np.inf, out)


class Vocabulary:
    """The pieces of a model file: lookup by hash of code points, weights, and bytes for decoding."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(i, model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
        self.bytes_at = model.piece_to_id("<0x00>")
        normal = [(i, p, s) for i, p, s in pieces if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.longest = max(len(p) for _, p, _ in normal)
        self.weights = np.zeros(len(pieces))
        for i, _, s in normal:
            self.weights[i] = -alpha * np.log1p(-s)
        # Every beginning of a piece is in the tables; those that are no piece themselves with the id -1.
        entries: dict[int, int] = {}
        for i, p, _ in normal:
            sums, _ = _sums(np.array([ord(c) for c in p], np.uint32))
            keys = _mix(sums[1:]).tolist()
            for key in keys[:-1]:
                entries.setdefault(key, -1)
            entries[keys[-1]] = i
        self.tables, left, bits = [], list(entries.items()), 19
        while left:
            held, ids, rest = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32), []
            shift = _U(7 * len(self.tables))
            for key, i in left:
                at = (key >> int(shift)) & (len(ids) - 1)
                if ids[at] == -2:
                    held[at], ids[at] = key, i
                else:
                    rest.append((key, i))
            self.tables.append((shift, held, ids))
            left, bits = rest, max(10, bits - 3)
        self.single = np.zeros(_LITERAL + 1, bool)
        self.single[[ord(p) for _, p, _ in normal if len(p) == 1]] = True
        # Whether two characters may be neighbours inside of a piece; a collision only leaves out a cut.
        self.together = np.zeros(1 << 20, bool)
        for _, p, _ in normal:
            codes = np.array([ord(c) for c in p], np.uint32)
            self.together[_neighbours(codes)] = True
        raw = [b""] * len(pieces)
        for i, p, _ in normal:
            raw[i] = p.replace(chr(_SPACE), " ").encode()
        for b in range(256):
            raw[self.bytes_at + b] = bytes([b])
        self.raw_at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids; -1 where a longer piece begins so, -2 where none does."""
        out = np.full(len(keys), -2, np.int32)
        for shift, held, ids in self.tables:
            at = ((keys >> shift) & _U(len(ids) - 1)).astype(np.int64)
            hit = np.flatnonzero(held[at] == keys)
            out[hit] = np.maximum(out[hit], ids[at[hit]])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a segmentation in UTF-8."""
        sizes = self.raw_at[ids + 1] - self.raw_at[ids]
        at = np.repeat(self.raw_at[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.raw[at].tobytes()[1:]  # without the space put in front


def _neighbours(codes: np.ndarray) -> np.ndarray:
    """A hash of 20 bits for each pair of adjacent characters."""
    return (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)) >> np.uint32(12)


@lru_cache(4)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


_powers: dict[str, np.ndarray] = {}


def _sums(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash modulo 2^64 and the inverse powers that make substrings comparable."""
    n = len(chars) + 1
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            powers = np.full(max(n, 1 << 16), base, np.uint64)
            powers[0] = 1
            _powers[name] = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros(n, np.uint64)
    np.cumsum(_mix(chars.astype(np.uint64) + _GOLD) * _powers["up"][: n - 1], out=sums[1:])
    return sums, _powers["down"][:n]


class Lattice:
    """Distinct segments, each with a slot for every character and one for its end; backward log-sums at each slot.

    Steps of a slot are entries from ``begin[slot]`` to ``begin[slot] + n_steps[slot]``, longest first.
    """

    def __init__(self, vocab: Vocabulary, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        sizes = ends - starts
        self.first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        n = int((sizes + 1).sum())
        at = np.repeat(starts - self.first, sizes + 1) + np.arange(n)
        to_end = np.repeat(self.first + sizes, sizes + 1) - np.arange(n)
        flat = chars[np.minimum(at, len(chars) - 1)]
        sums, inverses = _sums(flat)
        found, rows = [], np.flatnonzero(to_end >= 1)
        for length in range(1, vocab.longest + 1):
            rows = rows[to_end[rows] >= length]
            if not len(rows):
                break
            ids = vocab.find(_mix((sums[rows + length] - sums[rows]) * inverses[rows]))
            hit = ids >= 0
            found.append((rows[hit], ids[hit], length))
            rows = rows[ids > -2]
        # A character without a piece is a segment of its own, its one step is a byte piece or several.
        alone = np.flatnonzero((to_end == 1) & ~vocab.single[flat])
        found.append((alone, np.full(len(alone), -2, np.int32), 1))
        self.n_steps = np.zeros(n, np.int32)
        for slots, _, _ in found:
            self.n_steps[slots] += 1
        order = np.argsort(to_end.astype(np.uint16) if to_end.max(initial=0) < 1 << 16 else to_end, kind="stable")
        ends_at = np.cumsum(self.n_steps[order])
        self.begin = np.zeros(n, np.int64)
        self.begin[order] = ends_at - self.n_steps[order]
        total = int(ends_at[-1]) if n else 0
        self.ids, self.size, entry_slot = np.zeros(total, np.int32), np.zeros(total, np.int32), np.zeros(total, np.int64)
        fill = self.begin.copy()
        for slots, ids, length in reversed(found):
            spots = fill[slots]
            self.ids[spots], self.size[spots], entry_slot[spots] = ids, length, slots
            fill[slots] += 1
        weight = np.where(self.ids >= 0, vocab.weights[np.maximum(self.ids, 0)], 0.0)
        to, back, self.logp = entry_slot + self.size, np.zeros(n), np.zeros(total)
        cuts = np.concatenate(([0], np.cumsum(np.bincount(to_end, minlength=1))))
        for d in range(1, len(cuts) - 1):
            slots = order[cuts[d] : cuts[d + 1]]
            if not len(slots):
                continue
            low, high = self.begin[slots[0]], self.begin[slots[-1]] + self.n_steps[slots[-1]]
            sums_, heads = weight[low:high] + back[to[low:high]], self.begin[slots] - low
            top = np.maximum.reduceat(sums_, heads)
            steps = self.n_steps[slots]
            back[slots] = top + np.log(np.add.reduceat(np.exp(sums_ - np.repeat(top, steps)), heads))
            self.logp[low:high] = sums_ - np.repeat(back[slots], steps)
        with np.errstate(divide="ignore"):
            self.others = np.log(-np.expm1(np.minimum(self.logp, 0.0)))  # log-probability of the slot's other steps
        self.logp = np.rint(np.minimum(self.logp, 0.0) * UNIT).astype(np.int64)
        self.part = np.rint(np.exp(self.logp / UNIT) * PART).astype(np.int64)
        sums_ = np.cumsum(self.part.view(np.uint64))  # modulo 2^64, as are the differences
        self.upto = (sums_ - np.repeat(np.concatenate((np.zeros(1, np.uint64), sums_))[self.begin[order]], self.n_steps[order])).view(np.int64)
        some = self.n_steps > 0
        self.upto[self.begin[some] + self.n_steps[some] - 1] = 2 * PART


class Store:
    """Lattices of the segments seen so far, one behind the other, so that a task builds that of a common one once.

    Segments are kept until there are ``KEPT``; those of later texts are overwritten by the next run's.
    """

    KEPT = 50_000
    _SLOTS, _ENTRIES = {"begin": np.int64, "n_steps": np.int32}, {"ids": np.int32, "size": np.int32, "logp": np.int64, "others": np.float64, "part": np.int64, "upto": np.int64}

    def __init__(self):
        self.keys, self.first, self.n_slots, self.n_entries = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
        for name, kind in (self._SLOTS | self._ENTRIES).items():
            setattr(self, name, np.zeros(0, kind))

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        array = getattr(self, name)
        if len(array) < at + len(values):
            array = np.concatenate((array[:at], np.zeros(max(at // 2, 1 << 16) + len(values), array.dtype)))
            setattr(self, name, array)
        array[at : at + len(values)] = values

    def slots(self, vocab: Vocabulary, chars: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The first slot of each of the segments, which are distinct and ordered by key."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        first = np.zeros(len(keys), np.int64)
        first[known] = self.first[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            made = Lattice(vocab, chars, starts[new], ends[new])
            first[new] = made.first + self.n_slots
            self._put("begin", self.n_slots, made.begin + self.n_entries)
            self._put("n_steps", self.n_slots, made.n_steps)
            for name in self._ENTRIES:
                self._put(name, self.n_entries, getattr(made, name))
            if len(self.keys) + len(new) <= self.KEPT:
                every, spots = np.concatenate((self.keys, keys[new])), np.concatenate((self.first, first[new]))
                order = np.argsort(every)
                self.keys, self.first = every[order], spots[order]
                self.n_slots += len(made.begin)
                self.n_entries += len(made.ids)
        return first

    def choose(self, slots: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The entry taken at each slot."""
        at, u = self.begin[slots], (u * PART).astype(np.int64)
        miss = np.flatnonzero(self.upto[at] < u)
        while len(miss):
            at[miss] += 1
            miss = miss[self.upto[at[miss]] < u[miss]]
        return at


class Run:
    """The texts of one chunk: characters after a leading space each, segments, and paths sampled so far."""

    def __init__(self, vocab: Vocabulary, store: Store, texts: list[str], seeds: np.ndarray):
        self.vocab, self.lattice, self.n = vocab, store, len(texts)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        chars = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        chars[chars == _SPACE] = _LITERAL
        chars[chars == 32] = _SPACE
        self.chars, self.bounds = chars, np.concatenate(([0], np.cumsum(sizes)))
        self.doc = np.repeat(np.arange(self.n), sizes)
        self.seed = seeds
        # No piece crosses a cut: before each word, around byte pieces, between letters and most signs.
        cut = np.ones(len(chars), bool)
        cut[1:] = ~vocab.together[_neighbours(chars)]
        cut[self.bounds[:-1][sizes > 0]] = True
        self.starts = np.flatnonzero(cut)
        self.ends = np.concatenate((self.starts[1:], [len(chars)])) if len(chars) else self.starts
        sums, inverses = _sums(chars)
        keys = _mix((sums[self.ends] - sums[self.starts]) * inverses[self.starts] + _U(1)) + (self.ends - self.starts).astype(np.uint64)
        keys, one, kind = np.unique(keys, return_index=True, return_inverse=True)
        self.place = np.arange(len(chars), dtype=np.uint64) - np.repeat(self.bounds[:-1], sizes).astype(np.uint64)
        self.slot = np.zeros(len(chars), np.int64)  # the lattice slot behind each character
        if len(chars):
            first = store.slots(vocab, chars, keys, self.starts[one], self.ends[one])
            self.slot = np.repeat(first[kind] - self.starts, self.ends - self.starts) + np.arange(len(chars))

    def _random(self, at: np.ndarray, use: int) -> np.ndarray:
        return _uniform(self.seed[self.doc[at]] + self.place[at] * _U(0xD6E8FEB86659FD93) + _U(use * int(_GOLD) % (1 << 64)))

    def walk(self, path: np.ndarray, at: np.ndarray, until: np.ndarray, use: int) -> None:
        """Samples steps from characters ``at`` to their segments' ends; path gets the entry, -1 inside steps."""
        while len(at):
            steps = self.lattice.choose(self.slot[at], self._random(at, use))
            path[at] = steps
            at = at + self.lattice.size[steps]
            going = at < until
            at, until = at[going], until[going]

    def logs(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters at which steps begin, and the log-probability of each step in units."""
        at = np.flatnonzero(path >= 0)
        return at, self.lattice.logp[path[at]]

    def _before(self, at: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """For each step the log-probability of the steps of its text before it."""
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(logs.view(np.uint64))))
        firsts = np.searchsorted(at, self.bounds[:-1])
        return (sums[:-1] - sums[firsts][self.doc[at]]).view(np.int64) / UNIT

    def _total(self, at: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """The log-probability of the path of each text."""
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(logs.view(np.uint64))))
        return np.diff(sums[np.searchsorted(at, self.bounds)]).view(np.int64) / UNIT

    def samples(self, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Paths of k samples (of all texts), whether each exists (k x n), log-probabilities, and the (k+1)-th value."""
        n = self.n
        path = np.full(len(self.chars), -1, np.int32)
        self.walk(path, self.starts, self.ends, 1)
        value = -np.log(-np.log(_uniform(self.seed + _U(77))))
        paths, there, logp = [path], np.ones((k, n), bool), np.zeros((k, n))
        # Sets still to split: for each path, by the character of the step that differs, their values and excluded steps.
        values: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # characters, values, log-probabilities before
        excluded: list[np.ndarray] = []  # per path, character and entry of the steps taken instead, in one number
        fresh, bound = np.zeros(n, np.int64), value  # from which character on the newest path splits off its own sets
        for j in range(k):
            at, logs = self.logs(paths[j])
            logp[j] = self._total(at, logs)
            before = self._before(at, logs)
            mass = before + self.lattice.others[paths[j][at]]
            mine = there[j][self.doc[at]] & (at >= fresh[self.doc[at]])
            at, mass, before = at[mine], mass[mine], before[mine]
            values.append((at, _truncated(mass, bound[self.doc[at]], self._random(at, 1000 + j)), before))
            excluded.append(np.zeros(0, np.int64))
            best, origin, spot = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, (a, v, _) in enumerate(values):
                if len(a):
                    docs = self.doc[a]
                    heads = np.flatnonzero(np.diff(docs, prepend=-1))
                    top = np.full(n, -np.inf)
                    top[docs[heads]] = np.maximum.reduceat(v, heads)
                    won = (v == top[docs]) & (v > best[docs])
                    origin[docs[won]], spot[docs[won]], best[docs[won]] = i, np.flatnonzero(won), v[won]
            if j == k - 1:
                return paths, there, logp, best
            there[j + 1] = there[j] & (best > -np.inf)
            new = np.full(len(self.chars), -1, path.dtype)
            fresh, bound = self.bounds[1:].copy(), best
            u_pick = _uniform(self.seed + _U((2000 + j) * int(_GOLD) % (1 << 64)))
            u_left = _uniform(self.seed + _U((3000 + j) * int(_GOLD) % (1 << 64)))
            for i in range(j + 1):
                docs = np.flatnonzero(there[j + 1] & (origin == i))
                if len(docs):
                    fresh[docs] = self._part(docs, spot[docs], paths[i], values[i], excluded, i, new, u_pick[docs], u_left[docs], best[docs])
            # The rest of the segments in which the paths part, then all segments behind.
            segment = np.searchsorted(self.starts, fresh, "right") - 1
            parted = there[j + 1] & (fresh < self.bounds[1:])
            inner = parted & (self.starts[segment] < fresh) if len(self.starts) else parted
            own = self.doc[self.starts]
            later = there[j + 1][own] & (self.starts >= fresh[own])
            self.walk(new, np.concatenate((fresh[inner], self.starts[later])), np.concatenate((self.ends[segment[inner]], self.ends[later])), 10 + j)
            paths.append(new)
        raise AssertionError

    def _part(self, docs, spots, path, values, excluded, i, new, u_pick, u_left, best) -> np.ndarray:
        """Lets new paths of texts part from path i at the spots; gives the characters behind the steps taken there.

        The step is another than those taken from there before; the value of what is left of the set becomes smaller.
        """
        at, value, before = values
        c = at[spots]
        slot = self.slot[c]
        n_steps = self.lattice.n_steps[slot].astype(np.int64)
        heads = np.cumsum(n_steps) - n_steps
        row = np.repeat(np.arange(len(docs)), n_steps)
        entry = np.arange(len(row)) - heads[row] + self.lattice.begin[slot][row]
        gone = (entry == path[c][row]) | np.isin(c[row] << 32 | entry, excluded[i])
        free = np.where(gone, 0, np.maximum(self.lattice.part[entry], 1))
        sums = np.cumsum(free)
        sums -= (sums[heads] - free[heads])[row]
        total = sums[heads + n_steps - 1]
        goal = np.minimum((u_pick * total).astype(np.int64), total - 1)
        taken = heads + np.add.reduceat((sums <= goal[row]).astype(np.int64), heads)
        step = entry[taken]
        # The path so far, then the step.
        begins = self.bounds[docs]
        ahead = np.repeat(begins - (np.cumsum(c - begins) - (c - begins)), c - begins) + np.arange((c - begins).sum())
        new[ahead] = path[ahead]
        new[c] = step
        excluded[i] = np.concatenate((excluded[i], c << 32 | step))
        left, open_ = total - free[taken], n_steps - np.add.reduceat(gone.astype(np.int64), heads) > 1
        with np.errstate(divide="ignore"):
            mass = np.where(open_, before[spots] + np.log(left / PART), -np.inf)
        value[spots] = _truncated(mass, best, u_left)
        return c + self.lattice.size[step]

    def pieces(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in order, and the bounds of each text's."""
        at = np.flatnonzero(path >= 0)
        if not len(at):
            return np.zeros(0, np.int32), np.zeros(self.n + 1, np.int64)
        ids = self.lattice.ids[path[at]]
        sizes = np.ones(len(at), np.int64)
        odd = np.flatnonzero(ids == -2)
        codes = np.where(self.chars[at[odd]] == _LITERAL, _SPACE, self.chars[at[odd]])
        sizes[odd] = 1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int64) + (codes > 0xFFFF)
        out = np.repeat(ids, sizes)
        begins = np.concatenate(([0], np.cumsum(sizes)))
        out[begins[:-1][odd]] = codes.astype(np.int32) + self.vocab.bytes_at
        for i in np.flatnonzero(codes > 0x7F):
            b = chr(codes[i]).encode("utf-8", "surrogatepass")
            out[begins[odd[i]] : begins[odd[i]] + len(b)] = np.frombuffer(b, np.uint8).astype(np.int32) + self.vocab.bytes_at
        return out, begins[np.searchsorted(at, self.bounds)]


_ENCODED = "key long, sample int, ids array<int>, n_pieces long, log_prob double, log_inclusion double, inclusion double, round_trip boolean"


def encode(texts: list[str], keys: list[int | None], vocab: Vocabulary, k: int = SAMPLES, seed: int = SEED, store: Store | None = None, again: bool = False) -> Iterator[pa.RecordBatch]:
    """Record batches of ``_ENCODED``, k rows for a text if it has so many segmentations."""
    row, store = 0, store or Store()
    while row < len(texts):
        end, size = row, 0
        while end < len(texts) and (end == row or size + len(texts[end]) <= CHUNK):
            size += len(texts[end]) + 1
            end += 1
        own, ids = texts[row:end], keys[row:end]
        seeds = np.array([(-1 if x is None else x) & (1 << 64) - 1 for x in ids], np.uint64)
        run = Run(vocab, store, own, _mix(seeds + np.array([x is None for x in ids]) * _GOLD) + _U(seed) * _U(0xA0761D6478BD642F))
        if not len(run.chars):
            paths, there, logp, after = [run.slot - 1] * k, np.zeros((k, run.n), bool), np.zeros((k, run.n)), np.full(run.n, -np.inf)
            there[0] = True
        else:
            paths, there, logp, after = run.samples(k)
        raw, done = [t.encode("utf-8", "surrogatepass") for t in own], set()
        for j in range(len(paths)):
            pieces, bounds = run.pieces(paths[j])
            rows = np.flatnonzero(there[j])
            # Texts without a sample j have an empty stretch of pieces.
            plain, sizes = run.vocab.raw_at[pieces + 1] - run.vocab.raw_at[pieces], bounds
            text_at = np.concatenate(([0], np.cumsum(plain)))[sizes]
            whole = b" " + run.vocab.decode(pieces) if len(pieces) else b""
            same = [whole[text_at[i] + 1 : text_at[i + 1]] == raw[i] for i in rows]
            if not all(same) and not again:
                odd = {i for i, ok in zip(rows, same, strict=True) if not ok}
                yield from (b for i in sorted(odd - done) for b in encode([own[i]], [ids[i]], vocab, k, seed, None, True))
                done |= odd
            over = np.minimum(logp[j] - after, 700.0)
            log_inclusion = np.where(over < -30.0, over, np.log(-np.expm1(-np.exp(np.maximum(over, -40.0)))))
            if done:
                rows = np.array([i for i in rows if i not in done], np.int64)
                same = [True] * len(rows)
                pieces = np.concatenate([pieces[bounds[i] : bounds[i + 1]] for i in rows] or [pieces[:0]])
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.diff(bounds)[rows]))).astype(np.int32), pieces)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in rows], pa.int64()),
                    pa.array(np.full(len(rows), j), pa.int32()),
                    lists,
                    pa.array(np.diff(bounds)[rows], pa.int64()),
                    pa.array(logp[j][rows]),
                    pa.array(log_inclusion[rows]),
                    pa.array(np.exp(log_inclusion[rows])),
                    pa.array(same, pa.bool_()),
                ],
                names=[x.split()[0] for x in _ENCODED.split(", ")],
            )
        row = end


def model_path(spark) -> str:
    """The model file: ``spark.tallyforge.pieces.model`` or the public one installed with the tokenizers."""
    given = spark.conf.get("spark.tallyforge.pieces.model", None)
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _shipped(spark, path: str):
    """Gives, in a task, the path of a file that the driver has: it is sent to all executors."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def local() -> str:
        from pyspark import SparkFiles

        return SparkFiles.get(name)

    return local


def encoded(docs: DataFrame, path: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Up to k rows for each row of docs: key, sample, ids, n_pieces, log_prob, its inclusion, and whether ids decode to the text.

    The model file at path is one of the driver's.
    """
    model = _shipped(docs.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, store = vocabulary(model(), alpha), Store()
        for batch in batches:
            # A few rows at a time become Python strings.
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                yield from encode([t or "" for t in part.column(1).to_pylist()], part.column(0).to_pylist(), vocab, k, seed, store)

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(tidy(work), _ENCODED).withColumnRenamed("key", key)


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with ``text``, decoded from the column of piece ids (null ids: null), in place of the ids."""
    kept, model = [c for c in rows.columns if c != ids], _shipped(rows.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model(), ALPHA)
        for batch in batches:
            texts = [None if x is None else vocab.decode(np.array(x, np.int64)).decode("utf-8", "surrogatepass") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    kind = rows.select(*(f"`{c}`" for c in kept), F.lit("").alias("text")).schema
    return rows.mapInArrow(tidy(work), kind)


def query(spark, sf_dir):
    """op9: two sampled segmentations of every document."""
    return encoded(table(spark, sf_dir, "documents"), model_path(spark))
