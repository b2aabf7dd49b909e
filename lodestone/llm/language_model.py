"""Scoring with a gated recurrent language model.

Tokens are lowered words, then one end. Counts of all training tokens give the base
score and the tree of the softmax, which spans the head of the vocabulary, the `HEAD`
most frequent tokens: a class, a slot in the class, and, where a slot holds a bin of
rarer words, the word in the bin. The `FREQUENT` first words have slots of their own;
the rest of the head is put into bins of words of like spelling and rank. A token
beyond the head belongs to a class that its spelling names, inside which counts
decide. So probabilities of all known tokens and one unknown a class sum to one.

The network is a gated recurrent unit in numpy that reads slots. Its state predicts
class, slot and word. Training is truncated backpropagation, the state carried from
window to window; the words of bins learn on the states as they are, many windows at
once. It goes once over every training document, in `ROUNDS` rounds: a hash deals
documents to parts, each part of a round trains a replica from the same weights, and
Spark averages the replicas, each row of a matrix by how often a replica met it. So
the number of updates grows with the corpus, and neither files nor partitions matter.
Scoring carries the state through each whole document, however long.

Tokens are looked up in the head, which every worker holds and `HEAD` bounds; the
tokens beyond it are joined to the counts by shuffle.

Defined results: a null text is empty, and is one token, the end; a null id is no
held-out one; rows that repeat are scored one by one; an empty table gives an empty
result; without training documents every token is unknown; a document longer than a
chunk is a chunk of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from copy import copy
from itertools import pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

FOLDS, HELD = 5, 1
END = " "
HEAD = 200_000
#: Words with a slot of their own, words of a bin, slots of a class.
FREQUENT, BIN, CLASS_SIZE = 512, 64, 64
HIDDEN = 16
LANES, STEPS = 1024, 16
#: Windows that a chunk gives at least, by fewer lanes, so that a small corpus teaches too.
LEAST_WINDOWS = 32
RATE = 0.3
#: Sums of squares at the start of each round, for all but leaves, and for leaves.
CALM, LEAF_CALM = (1e-4, 1e-4, 1e-4), 0.005
ROUNDS = len(CALM)
#: Windows after which the words of bins learn.
LEAF_EVERY = 64
#: A round has a part for PART_TOKENS of its tokens, up to FEW_PARTS; beyond, for MOST_PART_TOKENS.
PART_TOKENS, FEW_PARTS, MOST_PART_TOKENS = 1_000_000, 12, 4_000_000
#: Replicas that one task averages at a time.
FAN = 64
#: Tokens that a worker holds at once, but for a longer document.
CHUNK = 1_000_000
#: States of one scoring block, and rows that meet a softmax at once, so that they stay in the cache.
BLOCK, AT_ONCE = 65_536, 1_024
SPELLINGS = 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def spelling(token: Column) -> Column:
    """Which class a token outside the frequent words belongs to, from its spelling."""
    last = F.substring(token, -1, 1)
    end = F.when(last.isin(".", "!", "?"), 1).when(last.isin(",", ";", ":"), 2).when(last.isin(*"#*$%&|<>"), 3).otherwise(0)
    wide = F.when(F.octet_length(token) > F.char_length(token), 4).otherwise(0)
    return end + wide + F.when(F.octet_length(token) > 6, 8).otherwise(0)


_ENDS = {**dict.fromkeys(b".!?", 1), **dict.fromkeys(b",;:", 2), **dict.fromkeys(b"#*$%&|<>", 3)}


def spelling_of(token: bytes) -> int:
    return _ENDS.get(token[-1], 0) + (0 if token.isascii() else 4) + (8 if len(token) > 6 else 0)


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of each text, all words as numbers, and the words that the numbers stand for; without the ends."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    lists = pc.ascii_split_whitespace(texts)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).copy()
    said = lists.flatten()
    if pc.any(pc.equal(pc.binary_length(texts), 0)).as_py():  # an empty text has no word
        size[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0
        said = said.filter(pc.greater(pc.binary_length(said), 0))
    coded = said.dictionary_encode()
    return size, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each batch, with the same tokens that scoring sees. Texts are split slice by slice, as all words of a
    batch take several times the memory of its texts."""
    for batch in batches:
        found, numbers = [], []
        for k in range(0, len(batch), AT_ONCE):
            _, words, said = tokens(batch.column("text").slice(k, AT_ONCE))
            found.append(words)
            numbers.append(np.bincount(said, minlength=len(words)))
        if found:
            coded = pa.concat_arrays(found).dictionary_encode()
            said = coded.indices.to_numpy(zero_copy_only=False)
            c = np.append(np.bincount(said, np.concatenate(numbers), len(coded.dictionary)), len(batch)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([coded.dictionary, pa.array([END])]), pa.array(c)], names=["token", "c"])


def counts(docs: DataFrame) -> DataFrame:
    """token, c of the training documents (doc_id, text), the end included."""
    train = docs.filter(~held_out(F.col("doc_id"))).select(F.col("text").cast("string"))
    return C.durable(train.mapInArrow(_count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c")))


class Vocabulary:
    """The head of the counts as a tree, and the sums that cover the rest.

    Codes 0 to n_head - 1 are tokens of the head, then come the spelling classes.
    """

    def __init__(self, head: list[tuple[str, int]], total: int, size: int, masses: dict[int, float]):
        """`masses`: sum of c + 0.5 of all known tokens of a spelling class, those of the head included."""
        ranked = sorted(((t, c) for t, c in head if t != END), key=lambda x: (-x[1], x[0]))
        spelt = lambda t: spelling_of(t.encode("utf-8", "surrogatepass"))
        listed = [(END, dict(head).get(END, 0)), *ranked[: FREQUENT - 1], *sorted(ranked[FREQUENT - 1 :], key=lambda x: (spelt(x[0]), -x[1], x[0]))]
        self.total, self.size, self.n_head = total, size, len(listed)
        self.ids = {t.encode("utf-8", "surrogatepass"): k for k, (t, _) in enumerate(listed)}
        c = np.array([c for _, c in listed], dtype=float)
        self.log_c, self.known = np.log(c + 0.5), c > 0
        self.n_single = min(FREQUENT, self.n_head)
        self.n_bins = -(-(self.n_head - self.n_single) // BIN)
        self.n_slots = self.n_single + self.n_bins
        self.n_classes = -(-self.n_slots // CLASS_SIZE)
        mass = np.full(SPELLINGS, 0.5)
        for k, m in masses.items():
            mass[k] += m
        for t, n in ranked:
            mass[spelt(t)] -= n + 0.5
        self.log_mass = np.log(np.maximum(mass, 0.5))
        code = np.arange(self.n_head + SPELLINGS)
        tail = self.n_single + (code - self.n_single) // BIN
        inner = np.where(code < self.n_single, code, tail)
        self.slot_of = np.where(code < self.n_head, inner, code - self.n_head + self.n_slots).astype(np.int32)
        slot = self.slot_of[: self.n_head]
        of_slot = np.bincount(slot, c + 0.5, self.n_slots)
        of_class = np.concatenate([np.bincount(np.arange(self.n_slots) // CLASS_SIZE, of_slot, self.n_classes), np.exp(self.log_mass)])
        self.class_bias = np.log(of_class / of_class.sum())
        self.slot_bias = _padded(np.log(of_slot), CLASS_SIZE)
        self.leaf_bias = _padded(self.log_c[self.n_single :], BIN)

    def slots(self, codes: np.ndarray) -> np.ndarray:
        """The slot of each code; spelling classes come after the slots."""
        return self.slot_of[codes]

    def without_words(self) -> Vocabulary:
        """A copy for workers that meet codes alone."""
        other = copy(self)
        other.ids = {}
        return other

    def codes(self, words: pa.Array) -> np.ndarray:
        """The code of each of `words`."""
        said = words.cast(pa.binary()).to_pylist()
        codes = np.fromiter(map(self.ids.get, said, repeat(-1)), dtype=np.int32, count=len(said))
        beyond = np.flatnonzero(codes < 0)
        codes[beyond] = [self.n_head + spelling_of(said[k]) for k in beyond.tolist()]
        return codes


def _padded(logs: np.ndarray, width: int) -> np.ndarray:
    """`logs` in rows of `width`, the last one filled up with next to no probability."""
    out = np.full(-(-len(logs) // width) * width, -30.0)
    out[: len(logs)] = logs
    out = out.reshape(-1, width)
    return out - out.max(1, keepdims=True, initial=-30.0)


def vocabulary(counted: DataFrame) -> Vocabulary:
    """The most frequent tokens, at most HEAD: those above the count that fits so many."""
    by_count = counted.filter(F.col("token") != END).groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("c").desc()).collect()
    least, held = None, 0
    for row in by_count:
        held += row["n"]
        if held > HEAD:
            break
        least = row["c"]
    head = counted.filter((F.col("token") == END) | (F.col("c") >= (least if least is not None else 1 << 62))).collect()
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    masses = counted.filter(F.col("token") != END).groupBy(spelling(F.col("token")).alias("k")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect()
    return Vocabulary([(r["token"], r["c"]) for r in head], sums[0], sums[1], {r["k"]: float(r["m"]) for r in masses})


#: Bound of every weight. States are within one and biases start below zero, so logits stay below 16 times it, far from where exp overflows.
MOST_WEIGHT = 3.0


def _with_one(states: np.ndarray) -> np.ndarray:
    """`states` with a column of ones, which meets the bias."""
    out = np.ones((len(states), states.shape[1] + 1), dtype=states.dtype)
    out[:, :-1] = states
    return out


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The weights of one softmax, or of each, with the bias as their last row."""
    return np.concatenate((weights, bias[..., None, :]), axis=-2)


def _log_softmax_at(states: np.ndarray, weights: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """log P of `goal` in each row of the softmax of `states` that end with a one, without the other probabilities."""
    out, ones = np.empty(len(goal)), np.ones(weights.shape[1], dtype=states.dtype)
    for k in range(0, len(goal), AT_ONCE):
        x = states[k : k + AT_ONCE] @ weights
        said = x[np.arange(len(x)), goal[k : k + AT_ONCE]]
        np.exp(x, out=x)
        out[k : k + AT_ONCE] = said - np.log(x @ ones)
    return out


def _expected(states: np.ndarray, weights: np.ndarray, back: np.ndarray, live: np.ndarray | None, into: np.ndarray) -> np.ndarray:
    """Of the softmax of `states` that end with a one: adds probabilities times states to `into`, a row a target, and gives
    the mean of the weights by the probabilities of each row. `back` is the turned weights with a column of ones, so that one
    product also gives the sums, and probabilities are never made: states are divided instead."""
    x = states @ weights
    np.exp(x, out=x)
    mean = x @ back
    share = np.reciprocal(mean[:, -1:])
    if live is not None:
        share *= live
    into += x.T @ (states * share)
    return mean[:, :-1] * share


class Network:
    """Gated recurrent unit over slots; class, slot and word softmax over states."""

    def __init__(self, vocab: Vocabulary, weights: dict[str, np.ndarray] | None = None, calm: float | None = CALM[0], kind=np.float32):
        """`calm`: sums of squares to start from; None for a network that only scores, which then shares `weights`."""
        rng = np.random.default_rng(7)
        h, v = HIDDEN, vocab
        n_in, n_out = v.n_slots + SPELLINGS + 1, v.n_classes + SPELLINGS
        self.vocab, self.start, self.n_classes, self.n_slots, self.kind = v, n_in - 1, v.n_classes, v.n_slots, kind
        draw = lambda *s: rng.normal(0, 0.1, s)
        made = weights or {
            "inputs": draw(n_in, 3 * h),
            "recurrent": draw(h, 2 * h),
            "candidate": draw(h, h),
            "classes": draw(h, n_out) * 0.1,
            "class_bias": v.class_bias,
            "slots": draw(v.n_classes, h, CLASS_SIZE) * 0.1,
            "slot_bias": v.slot_bias,
            "leaves": np.zeros((v.n_bins, h, BIN)),
            "leaf_bias": v.leaf_bias,
        }
        self.p = {k: np.array(w, dtype=kind, copy=None if calm is None else True) for k, w in made.items()}
        self.squares = {} if calm is None else {k: np.full_like(w, LEAF_CALM if k.startswith("leaf") or k == "leaves" else calm) for k, w in self.p.items()}

    def run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each step of `x` (steps, lanes); `fresh` resets a lane before the step."""
        n, tape, h = HIDDEN, [], h.copy()
        states, resets = np.empty((*x.shape, n), dtype=self.kind), fresh.any(1)
        # a contiguous matrix a gate; z and r negated, as exp takes them
        gates_in = np.stack((-self.p["inputs"][:, :n], -self.p["inputs"][:, n : 2 * n]))
        gates_by = np.stack((-self.p["recurrent"][:, :n], -self.p["recurrent"][:, n:]))
        new_in, new_by = -2 * self.p["inputs"][:, 2 * n :], -2 * self.p["candidate"]
        for t in range(len(x)):
            if resets[t]:
                h[fresh[t]] = 0
            gates = gates_in.take(x[t], 1)
            gates += h @ gates_by
            np.exp(gates, out=gates)  # MOST_WEIGHT keeps it from overflowing
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates
            rh = r * h
            new = rh @ new_by
            new += new_in.take(x[t], 0)
            np.exp(new, out=new)  # of minus twice the sum; this tanh takes half the time of numpy's
            new += 1
            np.reciprocal(new, out=new)
            new *= 2
            new -= 1
            if keep:
                tape.append((h, z, r, rh, new))
            h = h - new
            h *= z
            h += new
            states[t] = h
        return states, tape

    def split(self, slot: np.ndarray) -> np.ndarray:
        """The class of each slot."""
        return np.where(slot < self.n_slots, slot // CLASS_SIZE, slot - self.n_slots + self.n_classes)

    def log_p(self, states: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """log P of each slot: its class, and the slot in the class."""
        group, states = self.split(slot), _with_one(states)
        p = _log_softmax_at(states, _with_bias(self.p["classes"], self.p["class_bias"]), group)
        order, spans = _by(group, self.n_classes)
        states, place, slots = states.take(order, 0), slot.take(order) % CLASS_SIZE, _with_bias(self.p["slots"], self.p["slot_bias"])
        for c, a, b in spans:
            p[order[a:b]] += _log_softmax_at(states[a:b], slots[c], place[a:b])
        return p

    def log_leaf(self, states: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log P of each word in its bin; `place` counts words from the first bin on."""
        p = np.empty(len(place))
        for bins, rows, live, s, inner in _bins(states, place, self.vocab.n_bins):
            x = s @ _with_bias(self.p["leaves"][bins], self.p["leaf_bias"][bins])
            said = np.take_along_axis(x, inner[..., None], 2)[..., 0]
            np.exp(x, out=x)
            p[rows[live]] = (said - np.log(x @ np.ones(BIN, dtype=x.dtype)))[live]
        return p

    def gradients(self, x: np.ndarray, fresh: np.ndarray, slot: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean loss of class and slot over one window, -1 being no target; and the states."""
        steps, lanes = x.shape
        n = HIDDEN
        states, tape = self.run(x, fresh, h, True)
        flat, goal = states.reshape(-1, n), slot.ravel()
        live = goal >= 0
        goal = np.where(live, goal, self.n_slots + SPELLINGS)
        scale = self.kind(1 / max(1, live.sum()))
        # in order of slots, which is that of classes; rows without a target last
        order = np.argsort(goal.astype(np.int16), kind="stable")
        s, goal = _with_one(flat.take(order, 0)), goal.take(order)
        n_live = int(live.sum())
        live = None if n_live == len(s) else (np.arange(len(s)) < n_live).astype(self.kind)[:, None]
        classes, turned = _with_bias(self.p["classes"], self.p["class_bias"]), np.ascontiguousarray(self.p["classes"].T)
        slots, turned_slots = _with_bias(self.p["slots"], self.p["slot_bias"]), np.ascontiguousarray(self.p["slots"].transpose(0, 2, 1))
        of_classes, of_slots = np.zeros_like(classes.T), np.zeros((*turned_slots.shape[:2], n + 1), dtype=self.kind)
        group, by_goal = self.split(goal[:n_live]), np.empty_like(flat)
        back = _with_one(turned)
        for k in range(0, len(s), AT_ONCE):
            by_goal[k : k + AT_ONCE] = _expected(s[k : k + AT_ONCE], classes, back, live if live is None else live[k : k + AT_ONCE], of_classes)
        by_goal[:n_live] -= turned.take(group, 0)
        inner = int(np.searchsorted(goal, self.n_slots))
        bounds = np.searchsorted(group[:inner], np.arange(self.n_classes + 1)).tolist()
        back = np.concatenate((turned_slots, np.ones((*turned_slots.shape[:2], 1), dtype=self.kind)), 2)
        for c in range(self.n_classes):
            for k in range(bounds[c], bounds[c + 1], AT_ONCE):
                e = min(k + AT_ONCE, bounds[c + 1])
                by_goal[k:e] += _expected(s[k:e], slots[c], back[c], None, of_slots[c])
        by_goal[:inner] -= turned_slots.reshape(-1, n).take(goal[:inner], 0)
        met, sums = _sums(goal[:n_live], s[:n_live])
        of_slots.reshape(-1, n + 1)[met[met < self.n_slots]] -= sums[met < self.n_slots]
        met, sums = _sums(self.split(met), sums)
        of_classes[met] -= sums
        of_classes *= scale
        of_slots *= scale
        of_slots = np.ascontiguousarray(of_slots.transpose(0, 2, 1))
        g = {"classes": of_classes[:, :-1].T, "class_bias": of_classes[:, -1], "slots": of_slots[:, :-1], "slot_bias": of_slots[:, -1]}
        by_goal *= scale
        back_to = np.empty_like(order)
        back_to[order] = np.arange(len(order))
        dh = by_goal.take(back_to, 0)
        dh = dh.reshape(steps, lanes, n)
        dz, dr, dn, held, reset = (np.empty((steps, lanes, n), dtype=self.kind) for _ in range(5))
        to_z, to_r = self.p["recurrent"][:, :n].T.copy(), self.p["recurrent"][:, n:].T.copy()
        back = np.zeros((lanes, n), dtype=self.kind)
        for t in range(steps - 1, -1, -1):
            before, z, r, rh, new = tape[t]
            back = back + dh[t]
            closed = back * (1 - z)
            np.multiply(closed, 1 - new * new, out=dn[t])
            drh = dn[t] @ self.p["candidate"].T
            np.multiply(closed * z, before - new, out=dz[t])
            np.multiply(drh * rh, 1 - r, out=dr[t])
            held[t], reset[t] = before, rh
            back = back * z + drh * r + dz[t] @ to_z + dr[t] @ to_r
            if fresh[t].any():
                back = back * ~fresh[t][:, None]
        dz, dr, dn, held, reset = (a.reshape(-1, n) for a in (dz, dr, dn, held, reset))
        g["recurrent"] = np.hstack((held.T @ dz, held.T @ dr))
        g["candidate"] = reset.T @ dn
        codes = x.ravel().astype(np.int16)
        order = np.argsort(codes, kind="stable")
        codes = codes[order].astype(np.intp)
        (met, of_z), (_, of_r), (_, of_n) = (_sums(codes, d.take(order, 0)) for d in (dz, dr, dn))
        g["inputs"] = (met, np.hstack((of_z, of_r, of_n)))
        return g, states

    def learn(self, x: np.ndarray, fresh: np.ndarray, slot: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One window of truncated backpropagation; the states."""
        g, states = self.gradients(x, fresh, slot, h)
        for k, v in g.items():
            self._move(k, *(v if k == "inputs" else (slice(None), v)))
        return states

    def learn_leaves(self, states: np.ndarray, place: np.ndarray) -> None:
        """One step of the words of each bin that `place` meets."""
        for bins, _, live, s, inner in _bins(states, place, self.vocab.n_bins):
            e = s @ _with_bias(self.p["leaves"][bins], self.p["leaf_bias"][bins])
            np.exp(e, out=e)
            count = live.sum(1, dtype=self.kind)[:, None]
            e *= (live / (e @ np.ones(BIN, dtype=e.dtype)) / count).astype(self.kind)[..., None]
            k, at = np.nonzero(live)
            e[k, at, inner[k, at]] -= (1 / count[k, 0]).astype(self.kind)
            grad = s.transpose(0, 2, 1) @ e
            self._move("leaves", bins, grad[:, :-1])
            self._move("leaf_bias", bins, grad[:, -1])

    def _move(self, name: str, at, grad: np.ndarray) -> None:
        grad = np.minimum(np.maximum(grad, -0.1), 0.1)
        self.squares[name][at] += grad * grad
        moved = self.p[name][at] - RATE * grad / np.sqrt(self.squares[name][at])
        self.p[name][at] = np.minimum(moved if name.endswith("bias") else np.maximum(moved, -MOST_WEIGHT), MOST_WEIGHT)


def _bins(states: np.ndarray, place: np.ndarray, n_bins: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Bins with about as many rows each, batch by batch: bins; and, a row a bin, the rows, which are live, their states with a one, and places in the bin."""
    bin_of = (place // BIN).astype(np.int16)
    order = np.argsort(bin_of, kind="stable")
    count = np.bincount(bin_of, minlength=n_bins)
    begin = np.cumsum(count) - count
    by_count = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    k = 0
    while k < len(by_count):
        most = int(count[by_count[k]])
        bins = by_count[k : k + max(1, AT_ONCE * 8 // most)]
        bins = bins[2 * count[bins] >= most]  # counts fall, so these come first
        k += len(bins)
        step = np.arange(most)
        live = step < count[bins][:, None]
        rows = order[np.where(live, begin[bins][:, None] + step, 0)]
        s = _with_one(states.take(rows.ravel(), 0)).reshape(*rows.shape, -1)
        yield bins, rows, live, s, place[rows] % BIN


def _sums(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the sorted `keys` once, and the sum of its rows."""
    if not len(keys):
        return keys, rows[:0]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(rows, first, axis=0)


def _by(group: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of `group`, and each number below `n` that occurs in it with the span it takes there."""
    order = np.argsort(group.astype(np.int16), kind="stable")
    bounds = np.searchsorted(group[order], np.arange(n + 1))
    return order, [(k, int(bounds[k]), int(bounds[k + 1])) for k in np.flatnonzero(bounds[:-1] < bounds[1:]).tolist()]


def _encode(vocab_sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocab_sent.value
        for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, len(b), AT_ONCE)):
            size, words, said = tokens(batch.column("text"))
            bounds = np.concatenate(([0], np.cumsum(size + 1))).astype(np.int32)
            codes = np.zeros(bounds[-1], dtype=np.int32)  # an end closes each text
            word_codes = vocab.codes(words)
            codes[np.arange(len(said)) + np.repeat(np.arange(len(size)), size)] = word_codes[said]
            inner = codes < vocab.n_head
            at = np.where(inner, codes, 0)
            beyond = np.concatenate(([0], np.cumsum(np.add.reduceat(~inner, bounds[:-1], dtype=np.int32)))).astype(np.int32)
            out = {c: batch.column(c) for c in batch.schema.names if c != "text"} | {
                "n_tokens": pa.array(np.diff(bounds).astype(np.int64)),
                "base": pa.array(np.add.reduceat(np.where(inner, vocab.log_c[at], 0.0), bounds[:-1])),
                "known": pa.array(np.add.reduceat(inner & vocab.known[at], bounds[:-1], dtype=np.int64)),
                "codes": pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds * 4), pa.py_buffer(codes)]),
                "beyond": pa.ListArray.from_arrays(pa.array(beyond), words.take(pa.array(said[word_codes[said] >= vocab.n_head]))),
            }
            yield pa.RecordBatch.from_pydict(out)

    return run


def encoded(docs: DataFrame, vocab_sent, n_parts: int) -> DataFrame:
    """row, doc_id, held_out, part, text_key, n_tokens, base, known, codes, beyond of each row of `docs` (doc_id, text)."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_parts)).cast("int").alias("part"),
        F.xxhash64("text").alias("text_key"),
        F.col("text").cast("string").alias("text"),
    )
    kind = "row long, doc_id long, held_out boolean, part int, text_key long, n_tokens long, base double, known long, codes binary, beyond array<string>"
    return C.durable(rows.mapInArrow(_encode(vocab_sent), kind))


def _codes(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The codes of each row, as views on the batch."""
    codes = batch.column("codes").cast(pa.binary())
    _, at, data = codes.buffers()
    if not len(codes):
        return []
    bounds = np.frombuffer(at, dtype=np.int32)[codes.offset : codes.offset + len(codes) + 1] // 4
    whole = np.frombuffer(data, dtype=np.int32, count=bounds[-1])
    return [whole[a:b] for a, b in pairwise(bounds.tolist())]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], bool]]:
    """Part, codes of documents with about CHUNK tokens, and whether the part ends there; batches are in order of parts."""
    part, held, size = None, [], 0
    for batch in batches:
        for now, codes in zip(batch.column("part").to_pylist(), _codes(batch), strict=True):
            if held and (now != part or size >= CHUNK):
                yield part, held, now != part
                held, size = [], 0
            part = now
            held.append(codes)
            size += len(codes)
    if held:
        yield part, held, True


def _tally(numbers: np.ndarray, n: int) -> np.ndarray:
    """How often each number below `n` occurs, block by block, as bincount widens what it reads."""
    out = np.zeros(n, dtype=np.int64)
    for k in range(0, len(numbers), BLOCK):
        out += np.bincount(numbers[k : k + BLOCK], minlength=n)
    return out


def train_chunk(net: Network, texts: list[np.ndarray], met: dict[str, np.ndarray]) -> None:
    """Trains `net` on the codes of texts laid out in lanes; adds to `met` how often each row of a matrix was met."""
    vocab = net.vocab
    code = np.concatenate(texts)
    fresh = np.zeros(len(code), dtype=bool)
    fresh[np.cumsum([0] + [len(t) for t in texts[:-1]])] = True
    slot = vocab.slots(code)
    x = np.concatenate((np.full(1, net.start, dtype=np.int32), slot[:-1]))
    x[fresh] = net.start
    met["all"] += len(code)
    met["inputs"] += _tally(x, len(met["inputs"]))
    of_slot = _tally(slot, vocab.n_slots + SPELLINGS)[: vocab.n_slots]
    met["slots"] += np.bincount(np.arange(vocab.n_slots) // CLASS_SIZE, of_slot, vocab.n_classes)
    met["leaves"] += of_slot[vocab.n_single :]
    lanes = max(1, min(LANES, len(code) // (STEPS * LEAST_WINDOWS)))
    width = -(-len(code) // lanes)
    width = -(-width // STEPS) * STEPS
    wide = lambda a, fill: np.ascontiguousarray(np.concatenate([a, np.full(lanes * width - len(a), fill, dtype=a.dtype)]).reshape(lanes, width).T)
    x = wide(x, net.start)
    fresh = wide(fresh, True)
    slot = wide(slot, -1)
    code = wide(code, -1)
    h = np.zeros((lanes, HIDDEN), dtype=net.kind)
    for begin in range(0, width, LEAF_EVERY * STEPS):
        some = code[begin : begin + LEAF_EVERY * STEPS]
        tail = (some >= vocab.n_single) & (some < vocab.n_head)
        place, n = some[tail] - vocab.n_single, 0
        rare = np.empty((len(place), HIDDEN), dtype=net.kind)
        for t in range(begin, begin + len(some), STEPS):
            states = net.learn(x[t : t + STEPS], fresh[t : t + STEPS], slot[t : t + STEPS], h)
            h = states[-1].copy()
            met_here = states[tail[t - begin : t - begin + STEPS]]
            rare[n : n + len(met_here)] = met_here
            n += len(met_here)
        net.learn_leaves(rare, place)


#: Which counts of `met` a matrix is averaged by; the others by all tokens, as one row.
ROWS_OF = {"inputs": "inputs", "slots": "slots", "slot_bias": "slots", "leaves": "leaves", "leaf_bias": "leaves"}
#: Leaves, the bulk of the weights, travel in 16 bits.
WIRE = {"leaves": np.float16}
BLOCK_FLOATS = 1 << 16


def _blocks(net: Network, met: dict[str, np.ndarray]) -> Iterator[tuple[str, int, bytes, bytes]]:
    """name, first row, mass of each row and the rows themselves, in blocks; blocks that nothing met are left out."""
    for name, w in net.p.items():
        mass = met[ROWS_OF[name]] if name in ROWS_OF else met["all"]
        w = w.reshape(len(mass), -1) if w.size else w.reshape(0, 1)
        step = max(1, BLOCK_FLOATS // max(1, w.shape[1]))
        for k in range(0, len(w), step):
            if mass[k : k + step].any():
                yield name, k, mass[k : k + step].astype(np.float64).tobytes(), w[k : k + step].astype(WIRE.get(name, np.float32)).tobytes()


REPLICA = "part int, name string, first int, mass binary, rows binary"


def _train(vocab_sent, weights_sent, calm: float):
    """A replica a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net, met = vocab_sent.value, None, {}
        for part, texts, ends in _chunks(batches):
            if net is None:
                net = Network(vocab, weights_sent.value, calm)
                met = {"all": np.zeros(1), "inputs": np.zeros(net.start + 1), "slots": np.zeros(vocab.n_classes), "leaves": np.zeros(vocab.n_bins)}
            train_chunk(net, texts, met)
            if ends:
                for name, first, mass, rows in _blocks(net, met):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([first], pa.int32()), pa.array([mass]), pa.array([rows])], names=["part", "name", "first", "mass", "rows"])
                net = None

    return run


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block for the same block of several replicas, each row by its mass."""
    pdf = pdf.sort_values("part")
    name = pdf["name"].iloc[0]
    total, mean = 0.0, 0.0
    for m, r in zip(pdf["mass"], pdf["rows"], strict=True):  # one by one, as FAN blocks at once take far more
        mass = np.frombuffer(m, dtype=np.float64)
        total = total + mass
        mean = mean + mass[:, None] * np.frombuffer(r, dtype=WIRE.get(name, np.float32)).astype(np.float64).reshape(len(mass), -1)
    mean = mean / np.maximum(total, 1e-9)[:, None]
    return pd.DataFrame([(pdf["part"].iloc[0], name, pdf["first"].iloc[0], total.tobytes(), mean.astype(WIRE.get(name, np.float32)).tobytes())], columns=["part", "name", "first", "mass", "rows"])


def parts_of(train_tokens: int) -> int:
    """Parts of one round."""
    share = train_tokens // ROUNDS
    return max(1, min(FEW_PARTS, share // PART_TOKENS), share // MOST_PART_TOKENS)


def fit(coded: DataFrame, vocab_sent, per_round: int) -> dict[str, np.ndarray]:
    """Weights after ROUNDS rounds of replicas over the parts of `coded`."""
    spark = coded.sparkSession
    weights = Network(vocab_sent.value).p
    train = coded.filter("not held_out").select("part", "doc_id", "text_key", "codes")
    for k in range(ROUNDS):
        own = train.filter((F.col("part") % ROUNDS) == k)
        own = own.repartitionByRange(per_round, "part").sortWithinPartitions("part", "doc_id", "text_key")
        replicas = own.select("part", "codes").mapInArrow(_train(vocab_sent, spark.sparkContext.broadcast(weights), CALM[k]), REPLICA)
        n = per_round
        while n > FAN:
            replicas = replicas.groupBy("name", "first", F.floor(F.col("part") / (FAN * per_round * ROUNDS / n)).alias("group")).applyInPandas(lambda pdf: _mean(pdf), REPLICA)
            n = -(-n // FAN)
        for row in replicas.groupBy("name", "first").applyInPandas(_mean, REPLICA).collect():
            name, mass = row["name"], np.frombuffer(row["mass"], dtype=np.float64)
            w = weights[name].reshape(len(weights[name]), -1) if name in ROWS_OF else weights[name].reshape(1, -1)
            new = np.frombuffer(row["rows"], dtype=WIRE.get(name, np.float32)).reshape(len(mass), -1)
            w[row["first"] : row["first"] + len(mass)][mass > 0] = new[mass > 0]
    return weights


def score_texts(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Sum of log P over the codes of each text, its state carried from end to end.

    Texts are dealt to lanes, longest first, each to the lane that is least full.
    """
    vocab = net.vocab
    lengths = np.array([len(t) for t in texts])
    lanes = int(max(1, min(LANES, lengths.sum() // lengths.max())))
    heap = [(0, k) for k in range(lanes)]
    begin, lane = np.empty(len(texts), dtype=np.int64), np.empty(len(texts), dtype=np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        begin[k], lane[k] = heap[0]
        heapq.heapreplace(heap, (int(begin[k] + lengths[k]), int(lane[k])))
    width = int((begin + lengths).max())
    goal = np.full((width, lanes), -1, dtype=np.int32)
    doc = np.zeros((width, lanes), dtype=np.int32)
    fresh = np.zeros((width, lanes), dtype=bool)
    for k, codes in enumerate(texts):
        goal[begin[k] : begin[k] + lengths[k], lane[k]] = codes
        doc[begin[k] : begin[k] + lengths[k], lane[k]] = k
        fresh[begin[k], lane[k]] = True
    out = np.zeros(len(texts))
    h = np.zeros((lanes, HIDDEN), dtype=net.kind)
    before = np.full((1, lanes), net.start, dtype=np.int32)
    ahead = max(STEPS, BLOCK // lanes)
    most = min(4 * BLOCK + ahead * lanes, int(lengths.sum()))
    rare, n_rare = (np.empty((most, HIDDEN), dtype=net.kind), np.empty(most, dtype=np.int32), np.empty(most, dtype=np.int32)), 0
    for t in range(0, width, ahead):
        now, whose, first = goal[t : t + ahead], doc[t : t + ahead], fresh[t : t + ahead]
        slot = vocab.slots(now)
        x = np.concatenate([before, slot[:-1]])
        x[first] = net.start
        states, _ = net.run(x, first, h, False)
        h, before = states[-1].copy(), slot[-1:].copy()
        live = now >= 0
        out += np.bincount(whose[live], net.log_p(states[live], slot[live]), len(texts))
        tail = (now >= vocab.n_single) & (now < vocab.n_head)
        n_now = np.count_nonzero(tail)
        for held, new in zip(rare, (states[tail], now[tail] - vocab.n_single, whose[tail]), strict=True):
            held[n_rare : n_rare + n_now] = new
        n_rare += n_now
        if n_rare >= 4 * BLOCK or t + ahead >= width:
            s, place, text = (held[:n_rare] for held in rare)
            out += np.bincount(text, net.log_leaf(s, place), len(texts))
            n_rare = 0
        beyond = now >= vocab.n_head
        out -= np.bincount(whose[beyond], vocab.log_mass[now[beyond] - vocab.n_head], len(texts))
    return out


def _score(vocab_sent, weights_sent):
    """`model`, log P but for the counts of the tokens beyond the head.

    Texts of like length are scored together, so that few lanes wait for a long one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(vocab_sent.value, weights_sent.value, None)
        for batch in batches:
            texts = _codes(batch)
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            cut, model = np.cumsum(lengths[order]) // CHUNK, np.empty(len(texts))
            for k in np.unique(cut):
                model[order[cut == k]] = score_texts(net, [texts[i] for i in order[cut == k]])
            yield batch.drop_columns(["codes"]).append_column("model", pa.array(model))

    return run


def language_model_scores(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    counted = counts(docs)
    vocab = vocabulary(counted)
    vocab_sent = spark.sparkContext.broadcast(vocab)
    per_round = parts_of(vocab.total)
    coded = encoded(docs, vocab_sent, per_round * ROUNDS)
    codes_sent = spark.sparkContext.broadcast(vocab.without_words())
    weights_sent = spark.sparkContext.broadcast(fit(coded, codes_sent, per_round))
    rows = coded.select("row", "doc_id", "held_out", "n_tokens", "base", "known", "codes")
    scored = rows.mapInArrow(_score(codes_sent, weights_sent), "row long, doc_id long, held_out boolean, n_tokens long, base double, known long, model double")
    rest = coded.select("row", F.explode("beyond").alias("token")).join(counted, "token", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest"), F.count("c").alias("rest_known"))
    out = scored.join(rest, "row", "left").fillna(0, ["rest", "rest_known"])
    ten = float(np.log(10))
    log_all = float(np.log(vocab.total + 0.5 * (vocab.size + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("rest_known")).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        ((F.col("base") + F.col("rest") - F.col("n_tokens") * log_all) / ten).alias("base_score"),
        ((F.col("model") + F.col("rest")) / ten).alias("score"),
    )


def query(docs: DataFrame) -> DataFrame:
    return language_model_scores(docs.select("doc_id", "text"))
