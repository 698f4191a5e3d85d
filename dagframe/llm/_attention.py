"""A small causal self-attention language model in numpy.

One attention layer reads the embeddings of the preceding subwords and predicts the class of the
next: first one of ``GROUPS`` groups of classes, then one of the group's ``MEMBERS``. The subword follows
from its class by how often it came after the subword before it, smoothed towards its frequency in
the class. Texts are cut into blocks of ``SPAN`` targets, each read with the
``CONTEXT`` subwords before it, so that windows overlap, every token is scored once, and a batch of
blocks is one masked attention.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

SPAN = 32
CONTEXT = 32
WIDTH = 24
GROUPS = 16
MEMBERS = 16
CLASSES = GROUPS * MEMBERS
#: Commonest subwords that the embedding counts as neighbours.
NEIGHBOURS = 512
#: So many occurrences weighs a subword's frequency in its class against the counts of pairs.
SMOOTHING = 5.0
_LENGTH = CONTEXT + SPAN
_REL = np.clip(CONTEXT + np.arange(SPAN)[:, None] - np.arange(_LENGTH)[None, :], -1, _LENGTH - 1)
_FUTURE = _REL < 0
#: Where each weight of a block finds its distance; one beyond all for keys to come.
_FAR = np.where(_FUTURE, _LENGTH, _REL)
_GONE = np.float32(-1e9)
NAMES = ("Wq", "Wk", "Wv", "Wo", "Wh", "b", "Wg", "bg", "Wm", "bm", "R")


def block_parts(ids: np.ndarray, bounds: np.ndarray, start: int, size: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(inputs, targets, text)`` of at most ``size`` blocks at a time; -1 pads. Before its first subword a text has ``start``."""
    n = np.diff(bounds)
    per = -(-n // SPAN)
    # Texts are laid out with padding before them, so that every window is one slice of the layout.
    room = np.concatenate([[0], np.cumsum(n + _LENGTH + 1)])
    flat = np.full(room[-1] + _LENGTH, -1, np.int32)
    flat[np.arange(len(ids)) + np.repeat(room[:-1] + CONTEXT + 1 - bounds[:-1], n)] = ids
    flat[room[:-1] + CONTEXT] = start
    windows = np.lib.stride_tricks.sliding_window_view(flat, _LENGTH + 1)
    ends = np.cumsum(per)
    for k in range(0, int(ends[-1]) if len(ends) else 0, size):
        block = np.arange(k, min(k + size, int(ends[-1])))
        text = np.searchsorted(ends, block, "right")
        first = (block - (ends - per)[text]) * SPAN
        last, got = (n[text] - first)[:, None], windows[room[:-1][text] + first]
        yield np.where(np.arange(-CONTEXT, SPAN) <= last, got[:, :-1], -1), np.where(np.arange(SPAN) < last, got[:, CONTEXT + 1 :], -1), text


def blocks(ids: np.ndarray, bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of ``block_parts`` at once."""
    parts = list(block_parts(ids, bounds, start)) or [(np.zeros((0, _LENGTH), np.int32), np.zeros((0, SPAN), np.int32), np.zeros(0, np.int64))]
    return tuple(np.concatenate(x) for x in zip(*parts))


def initial(embedding: np.ndarray, class_of: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    rng, d = np.random.default_rng(seed), embedding.shape[1]
    p = {k: (rng.standard_normal((d, d)) / np.sqrt(d)).astype(np.float32) for k in ("Wq", "Wk", "Wv", "Wo", "Wh")}
    p |= {"b": np.zeros(d, np.float32), "R": np.zeros(_LENGTH, np.float32)}
    p |= {"Wg": (rng.standard_normal((d, GROUPS)) / np.sqrt(d)).astype(np.float32), "Wm": (rng.standard_normal((GROUPS, d, MEMBERS)) / np.sqrt(d)).astype(np.float32)}
    empty = np.where(np.bincount(class_of, minlength=CLASSES) > 0, 0, -1e4).astype(np.float32).reshape(GROUPS, MEMBERS)
    p |= {"bg": empty.max(axis=1), "bm": empty}
    # The last row stands for padding: id -1. Keys have a column of ones behind them.
    e, ones = np.vstack([embedding, np.zeros((1, d))]).astype(np.float32), (np.arange(len(embedding) + 1) < len(embedding))[:, None]
    return p | {"E": e, "keys": np.hstack([e, ones]).astype(np.float32), "class_of": class_of.astype(np.int32)}


class Room:
    """Arrays that batch after batch is worked out in: new ones are filled with zeros page by page, which takes longer than to reckon with them."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}
        self.views: dict[tuple, np.ndarray] = {}

    def __call__(self, name: str, dtype, *shape: int) -> np.ndarray:
        out = self.views.get((name, dtype, shape))
        if out is None:
            n = math.prod(shape)
            if name not in self.held or self.held[name].size < n or self.held[name].dtype != dtype:
                self.held[name] = np.empty(n, dtype)
                self.views = {k: v for k, v in self.views.items() if k[0] != name}
            out = self.views[name, dtype, shape] = self.held[name][:n].reshape(shape)
        return out


def _forward(p: dict, ids: np.ndarray, room: Room, safe: bool = False):
    """What ``_gradients`` needs, to what the classes are read from, with a column of ones. Exponentials are taken as they are, or less their maximum if ``safe``.

    The embedding stays as it is, so that keys are the embeddings themselves, which queries meet through
    ``Wq Wk'``, and values pass through ``Wv Wo`` once they are averaged: fewer and smaller products, of the same value.
    """
    n, d, keys = len(ids), WIDTH, p["keys"]
    kind, rows = keys.dtype, n * SPAN
    e = keys.take(ids, axis=0, out=room("e", kind, n, _LENGTH, d + 1), mode="wrap")
    read = room("read", kind, rows, 2 * d + 1)
    read.reshape(n, SPAN, -1)[:, :, d:] = e[:, CONTEXT:]
    q = np.matmul(read[:, d : 2 * d], p["Wq"] @ p["Wk"].T * kind.type(1 / np.sqrt(d)), out=room("q", kind, rows, d))
    a = np.matmul(q.reshape(n, SPAN, d), e[:, :, :d].transpose(0, 2, 1), out=room("a", kind, n, SPAN, _LENGTH))
    if safe:
        a += np.where(_FUTURE, _GONE, p["R"][_REL])
        a += np.where(ids < 0, _GONE, np.float32(0))[:, None, :]
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
    else:
        np.exp(a, out=a)
        a *= np.append(np.exp(p["R"]), kind.type(0)).take(_FAR)
    # The column of ones behind the keys adds the weights up; it is 0 where padded.
    o = np.matmul(a, e, out=room("o", kind, n, SPAN, d + 1)).reshape(rows, d + 1)
    total = o[:, d:].copy()
    if not safe and not (total.min() > 1e-30 and total.max() < 1e30):
        return _forward(p, ids, room, True)
    np.divide(o[:, :d], total, out=read[:, :d])
    # tanh(x) as 1 - 2 / (exp(2 x) + 1), and 1 in a column more.
    w = np.zeros((2 * d + 1, d + 1), kind)
    w[:d, :d], w[d : 2 * d, :d], w[2 * d, :d], w[2 * d, d] = p["Wv"] @ p["Wo"], p["Wh"], p["b"], 200
    w *= 2
    h = np.matmul(read, w, out=room("h", kind, rows, d + 1))
    np.exp(h, out=h)
    h += 1
    np.divide(-2, h, out=h)
    h += 1
    return e, read, a, total, h


def _choices(p: dict, h: np.ndarray, c: np.ndarray, room: Room):
    """Logits of the groups, by row, and of the members of the group of each target class ``c``, with rows put in order of the group; that order, each row's place in it, its cuts, ``h`` in it, and the weights with their constants."""
    kind, rows = h.dtype, len(c)
    group = (c // MEMBERS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(rows)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))]).tolist()
    wg, wm = np.vstack([p["Wg"], p["bg"]]), np.concatenate([p["Wm"], p["bm"][:, None, :]], axis=1)
    ordered = h.take(order, axis=0, out=room("ordered", kind, *h.shape), mode="clip")
    members = room("members", kind, rows, MEMBERS)
    for g in range(GROUPS):
        np.matmul(ordered[cuts[g] : cuts[g + 1]], wm[g], out=members[cuts[g] : cuts[g + 1]])
    return np.matmul(h, wg, out=room("groups", kind, rows, GROUPS)), members, order, place, cuts, ordered, wg, wm


def _shares(z: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | int]:
    """``(exp(z - high), its row sums, high)``; ``high`` is each row's maximum where exponentials as they are would be too large or small."""
    ones = np.ones(z.shape[1], z.dtype)
    np.exp(z, out=out)
    sums = out @ ones
    if sums.min() > 1e-30 and sums.max() < 1e30:
        return out, sums, 0
    high = z.max(axis=1)
    np.exp(np.subtract(z, high[:, None], out=out), out=out)
    return out, out @ ones, high


def within(p: dict, prev: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Natural log probability of each subword ``nxt`` given its class and the subword ``prev`` before it."""
    out = p["within"][nxt].astype(float)
    at = np.flatnonzero(out < 0) if "pairs" in p else []
    if len(at):
        a, b = prev[at].astype(np.int64), nxt[at].astype(np.int64)
        n = _looked_up(p["pairs"], p["pair_n"], a * len(p["class_of"]) + b)
        m = _looked_up(p["heads"], p["head_n"], a * CLASSES + p["class_of"][b])
        out[at] = np.log((n + SMOOTHING * np.exp(out[at])) / (m + SMOOTHING))
    return out


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    each, back = np.unique(wanted, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, each), len(keys) - 1)
    return np.where(keys[at] == each, values[at], 0)[back]


def sorted_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order].astype(float)


def untold(p: dict, prev: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, key)`` of what ``within`` found no count for: pairs, and sums over a class, whose keys are ``-1 - key``."""
    at = np.flatnonzero(p["within"][nxt] < 0)
    a, b = prev[at].astype(np.int64), nxt[at].astype(np.int64)
    pair, head = a * len(p["class_of"]) + b, a * CLASSES + p["class_of"][b]
    x, y = (_looked_up(p[k], p[n], keys) == 0 for k, n, keys in (("pairs", "pair_n", pair), ("heads", "head_n", head)))
    return np.concatenate([at[x], at[y]]), np.concatenate([pair[x], -1 - head[y]])


def told_later(p: dict, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the counts ``n`` of keys as ``untold`` names them add to the natural log probability that ``within`` gave without them."""
    pair = keys >= 0
    weight = SMOOTHING * np.exp(np.where(pair, p["within"][np.where(pair, keys, 0) % len(p["class_of"])], 0).astype(float))
    return np.where(pair, 1, -1) * np.log1p(n / weight)


def pair_tables(class_of: np.ndarray, keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """The tables that ``within`` reads, from pairs ``prev * size + next`` and their counts; pairs left out are smoothed over."""
    size = len(class_of)
    keep = np.bincount(class_of, minlength=CLASSES)[class_of[keys % size]] > 1
    order = np.argsort(keys[keep])
    keys, n = keys[keep][order], n[keep][order].astype(float)
    heads, back = np.unique(keys // size * CLASSES + class_of[keys % size], return_inverse=True)
    return {"pairs": keys, "pair_n": n, "heads": heads, "head_n": np.bincount(back, n, minlength=len(heads))}


class Memo:
    """``work(keys, places)`` of many keys, each worked out once, but for those that another has taken the slot of; ``places``: where each is first met."""

    def __init__(self, work, bits: int = 20):
        self.work, self.shift = work, np.uint64(64 - bits)
        # A slot without a value holds a key that belongs to another.
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.zeros(1 << bits)
        self.keys[0] = 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)
        out = self.values.take(slot)
        at = np.flatnonzero(self.keys.take(slot) != keys)
        if len(at):
            each, first, back = np.unique(keys[at], return_index=True, return_inverse=True)
            values, slot = self.work(each, at[first]), slot[at[first]]
            out[at] = values[back]
            # Of keys that share a slot, one leaves itself and its value there.
            slot, one = np.unique(slot, return_index=True)
            self.keys[slot], self.values[slot] = each[one], values[one]
        return out


def within_memo(p: dict) -> Memo:
    """``within`` of pairs ``prev * size + next``."""
    size = len(p["class_of"])
    return Memo(lambda pair, _: within(p, pair // size, pair % size))


def log_probs(p: dict, inputs: np.ndarray, targets: np.ndarray, batch: int = 256, room: Room | None = None, told: Memo | None = None) -> np.ndarray:
    """Natural log probability of each target given what precedes it; 0 where padded. ``told``: of ``within_memo``."""
    out, room, told = np.zeros(targets.shape), room or Room(), told or within_memo(p)
    for k in range(0, len(inputs), batch):
        t = targets[k : k + batch].ravel()
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            h = _forward(p, inputs[k : k + batch], room)[-1]
            c = p["class_of"].take(t, mode="wrap")
            groups, members, order, place, *_ = _choices(p, h, c, room)
            got = _log_share(members, c[order] % MEMBERS, room).take(place)
            got += _log_share(groups, c // MEMBERS, room)
        out[k : k + batch] = np.where(t >= 0, got, 0).reshape(-1, SPAN)
    some = targets >= 0
    out[some] += told(inputs[:, CONTEXT:][some].astype(np.int64) * len(p["class_of"]) + targets[some])
    return out


def _log_share(z: np.ndarray, own: np.ndarray, room: Room) -> np.ndarray:
    _, sums, high = _shares(z, room("shares", z.dtype, *z.shape))
    return z.ravel().take(np.arange(len(own)) * z.shape[1] + own) - high - np.log(sums)


def _gradients(p: dict, inputs: np.ndarray, targets: np.ndarray, room: Room | None = None) -> dict[str, np.ndarray]:
    room, d, n, t = room or Room(), WIDTH, len(inputs), targets.ravel()
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        e, read, a, total, h = _forward(p, inputs, room)
        c, kind, row = p["class_of"].take(t, mode="wrap"), h.dtype, np.arange(len(t))
        groups, members, order, place, cuts, ordered, wg, wm = _choices(p, h, c, room)
        zg, sums_g, _ = _shares(groups, room("zg", kind, *groups.shape))
        zm, sums_m, _ = _shares(members, room("zm", kind, *members.shape))
    weight = np.where(t >= 0, kind.type(1 / max(1, (t >= 0).sum())), kind.type(0))
    zg *= (weight / sums_g)[:, None]
    zg.ravel()[row * GROUPS + c // MEMBERS] -= weight
    weight = weight.take(order)
    zm *= (weight / sums_m)[:, None]
    zm.ravel()[row * MEMBERS + c.take(order) % MEMBERS] -= weight
    g, part, gm = {}, room("part", kind, *h.shape), np.zeros_like(wm)
    for k in range(GROUPS):
        own = slice(cuts[k], cuts[k + 1])
        np.matmul(ordered[own].T, zm[own], out=gm[k])
        np.matmul(zm[own], wm[k].T, out=part[own])
    gg = h.T @ zg
    g["Wg"], g["bg"], g["Wm"], g["bm"] = gg[:d], gg[d], gm[:, :d], gm[:, d]
    dh = np.matmul(zg, wg.T, out=room("dh", kind, *h.shape))
    dh += part.take(place, axis=0, out=room("placed", kind, *h.shape), mode="clip")
    slope = np.multiply(h, h, out=part)
    dh *= np.subtract(1, slope, out=slope)
    gr = read.T @ dh[:, :d]
    g["Wv"], g["Wo"], g["Wh"], g["b"] = gr[:d] @ p["Wo"].T, p["Wv"].T @ gr[:d], gr[d : 2 * d], gr[2 * d]
    do = room("do", kind, len(t), d + 1)
    np.matmul(dh[:, :d], (p["Wv"] @ p["Wo"]).T, out=do[:, :d])
    # Through the softmax: a column more takes each row's mean off.
    np.negative(np.einsum("ij,ij->i", do[:, :d], read[:, :d]), out=do[:, d])
    do /= total
    a *= np.matmul(do.reshape(n, SPAN, d + 1), e.transpose(0, 2, 1), out=room("da", kind, *a.shape))
    near = np.ones(n, kind) @ a.reshape(n, -1)
    g["R"] = np.bincount(_FAR.ravel(), near, minlength=_LENGTH + 1)[:_LENGTH]
    met = np.matmul(a, e[:, :, :d], out=room("met", kind, n, SPAN, d)).reshape(-1, d)
    gq = read[:, d : 2 * d].T @ met * kind.type(1 / np.sqrt(d))
    g["Wq"], g["Wk"] = gq @ p["Wk"], gq.T @ p["Wq"]
    return g


class Trainer:
    """Adam steps over blocks as they come; the embedding stays as it is. ``buffer`` blocks at a time are shuffled and taken."""

    def __init__(self, p: dict, rate: float = 0.01, batch: int = 64, buffer: int = 4096, seed: int = 0):
        self.w = flatten(p)
        self.p, self.m, self.s = restore(p, self.w), np.zeros_like(self.w), np.zeros_like(self.w)
        self.rate, self.batch, self.buffer, self.rng = rate, batch, buffer, np.random.default_rng(seed)
        self.steps = self.seen = self.held = 0
        self.room = Room()
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, inputs: np.ndarray, targets: np.ndarray) -> None:
        self.waiting.append((inputs, targets))
        self.held += len(inputs)
        if self.held >= self.buffer:
            x, y = (np.concatenate(part) for part in zip(*self.waiting))
            whole = len(x) // self.buffer * self.buffer
            for k in range(0, whole, self.buffer):
                self._take(x[k : k + self.buffer], y[k : k + self.buffer])
            self.waiting, self.held = [(x[whole:], y[whole:])], len(x) - whole

    def done(self) -> dict:
        if self.held:
            self._take(*(np.concatenate(part) for part in zip(*self.waiting)))
            self.waiting, self.held = [], 0
        return restore(self.p, self.w.copy())

    def _take(self, inputs: np.ndarray, targets: np.ndarray) -> None:
        self.seen += len(inputs)
        order = self.rng.permutation(len(inputs))
        for k in range(0, len(order), self.batch):
            self.steps += 1
            g = _gradients(self.p, inputs[order[k : k + self.batch]], targets[order[k : k + self.batch]], self.room)
            g = np.concatenate([g[n].ravel() for n in NAMES]).astype(self.w.dtype)
            self.m += 0.1 * (g - self.m)
            self.s += 0.01 * (g * g - self.s)
            rate = np.float32(self.rate / (1 - 0.9**self.steps))
            self.w -= rate * self.m / (np.sqrt(self.s * np.float32(1 / (1 - 0.99**self.steps))) + np.float32(1e-7))


def train(p: dict, inputs: np.ndarray, targets: np.ndarray, epochs: int = 1, **options) -> dict:
    trainer = Trainer(p, **options)
    for _ in range(epochs):
        trainer.add(inputs, targets)
    return trainer.done()


def flatten(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in NAMES])


def restore(p: dict, flat: np.ndarray) -> dict:
    """``p`` with the weights of ``flat``, as views of it where it is of float32."""
    out, at, flat = dict(p), 0, flat.astype(np.float32, copy=False)
    for k in NAMES:
        out[k] = flat[at : at + p[k].size].reshape(p[k].shape)
        at += p[k].size
    return out


def columns_of(counts: np.ndarray) -> np.ndarray:
    """The commonest subwords, whose neighbourhood describes the others."""
    return np.argsort(-counts, kind="stable")[:NEIGHBOURS]


def neighbours(prev: np.ndarray, nxt: np.ndarray, n: np.ndarray, top: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, column, n)`` of counted pairs: how often each subword stands before (columns from 0) and after (from ``NEIGHBOURS``) each of ``top``."""
    col = np.full(size, -1)
    col[top] = np.arange(len(top))
    after, before = col[nxt], col[prev]
    a, b = after >= 0, before >= 0
    return np.concatenate([prev[a], nxt[b]]), np.concatenate([after[a], NEIGHBOURS + before[b]]), np.concatenate([n[a], n[b]])


def features(row: np.ndarray, col: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """One row of neighbour counts for each subword, damped, of length under 1, in whole multiples of 2^-16."""
    x = np.zeros((rows, 2 * NEIGHBOURS))
    x[row, col] = np.sqrt(n)
    return np.rint(x / (np.linalg.norm(x, axis=1, keepdims=True) + 1) * 65536)


def axes(gram: np.ndarray) -> np.ndarray:
    """The main axes of ``features``, from the sum of their products, which is exact in any order."""
    vec = np.linalg.eigh(gram)[1][:, ::-1][:, :WIDTH]
    return vec * np.sign(vec[np.abs(vec).argmax(axis=0), np.arange(WIDTH)]) / 65536


def embed(inputs: np.ndarray, targets: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(embedding, class_of)`` of ``size`` subwords from which follow which, over blocks held in memory."""
    prev, nxt = inputs[:, CONTEXT:].ravel(), targets.ravel()
    ok = (prev >= 0) & (nxt >= 0)
    prev, nxt = prev[ok], nxt[ok]
    count = np.bincount(nxt, minlength=size)
    used = np.flatnonzero(count + np.bincount(prev, minlength=size))
    key, n = np.unique(prev.astype(np.int64) * size + nxt, return_counts=True)
    row, column, n = neighbours(key // size, key % size, n, columns_of(count), size)
    x = features(np.searchsorted(used, row), column, n, len(used))
    return classes(x @ axes(x.T @ x), used, count, seed)


def classes(y: np.ndarray, used: np.ndarray, count: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(embedding, class_of)`` of all subwords from the places ``y`` of those ``used``."""
    y, size = np.rint(y * 4096).astype(np.float32) / 4096, len(count)
    y /= y.std(axis=0, keepdims=True) + 1e-6 if len(used) > 1 else 1
    embedding = np.zeros((size, WIDTH), np.float32)
    embedding[used] = y
    class_of = np.arange(size) % CLASSES
    class_of[used] = np.arange(len(used)) % CLASSES
    if len(used) >= 4 * CLASSES:
        weight = count[used] + 0.1
        group = _clusters(y, weight, GROUPS, seed)
        for g in range(GROUPS):
            # Half of the members are the group's commonest subwords, each for itself; the others are clusters.
            own = np.flatnonzero(group == g)
            own = own[np.argsort(-count[used[own]], kind="stable")]
            class_of[used[own]] = g * MEMBERS + np.arange(len(own)) % MEMBERS
            if len(own) > MEMBERS:
                rest = own[MEMBERS // 2 :]
                class_of[used[rest]] = g * MEMBERS + MEMBERS // 2 + _clusters(y[rest], weight[rest], MEMBERS // 2, seed)
    return embedding, class_of


def _clusters(y: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means, from ``k`` of the points drawn at random."""
    centre = y[np.random.default_rng(seed).choice(len(y), k, replace=False)]
    for _ in range(15):
        near = np.argmin((centre**2).sum(axis=1)[None, :] - 2 * y @ centre.T, axis=1)
        mass = np.bincount(near, weight, minlength=k)
        mean = np.stack([np.bincount(near, y[:, j] * weight, minlength=k) for j in range(y.shape[1])], axis=1)
        centre = np.where(mass[:, None] > 0, mean / np.maximum(mass, 1e-9)[:, None], centre).astype(np.float32)
    return near


def within_class(counts: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """Log probability of each subword given its class, from corpus counts with one half added."""
    c = counts + 0.5
    return np.log(c / np.bincount(class_of, c, minlength=CLASSES)[class_of])
