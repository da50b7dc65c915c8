"""A gated recurrent language model in numpy: its network, training and scores.

Symbols are the most frequent words, one for any other word, and one for a text's
end. A gated recurrent unit reads the symbols before; the next one is read off in two
steps, its class and the symbol within the class, so that a step costs the classes
and one class's members in place of all symbols. Classes split the symbols, sorted by
frequency, into parts of equal mass of the frequencies' square roots.

Training is truncated backpropagation through STEPS symbols, with the state carried
from one window to the next. Scoring carries it through the whole text. Many texts
are read side by side, in lanes; a lane's state is cleared where a text begins.
`fit` finds first weights on some texts; `passed` moves weights by one pass over others,
so that copies moved by different texts can be averaged.
"""

from __future__ import annotations

import heapq

import numpy as np

from .common import ragged

#: Known words, classes, width of embedding and state.
WORDS, CLASSES, WIDTH = 4_094, 64, 32
#: Training: symbols that a gradient passes through, texts side by side (fewer where a pass would have under 64 windows), passes at most, rate, the largest norm of a gradient.
STEPS, LANES, PASSES, RATE, CLIP = 16, 128, 4, 1e-2, 1.0
#: A pass of weights that are to be averaged: texts side by side.
BROAD = 512
#: Scoring: texts side by side, symbols of each between two outputs.
WIDE, WINDOW = 256, 64
#: Rows whose classes' logits are taken at once, which fit a cache.
ROWS = 1024


def classes(counts: np.ndarray, k: int = CLASSES) -> np.ndarray:
    """Bounds of at most ``k`` classes of symbols sorted by falling count."""
    mass = np.cumsum(np.sqrt(np.maximum(counts, 1.0)))
    cut = np.searchsorted(mass, mass[-1] * np.arange(1, k) / k, "left") + 1
    return np.unique(np.concatenate([[0], np.minimum(cut, len(counts)), [len(counts)]]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; exp may overflow, to a sigmoid of 0."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _logits(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, bounded: bool) -> np.ndarray:
    """Logits that ``exp`` takes without overflow or a row of zeros; bounded ones have a bias that saw to it."""
    x = h @ weights
    x += bias
    if not bounded:
        x -= x.max(1, keepdims=True)
    return x


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def _log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of each row at one place."""
    own = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return own - np.log(x @ np.ones(x.shape[1], x.dtype))


class Network:
    """Parameters; symbols are numbers in the order of falling counts."""

    def __init__(self, counts: np.ndarray, seed: int = 0, width: int = WIDTH) -> None:
        """Biases start at the log frequencies, so that an untrained network is the unigram model."""
        rng = np.random.default_rng(seed)
        n, self.bounds, self.width = len(counts), classes(counts), width
        self.class_of = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds)).astype(np.int16)
        share = (counts + 1.0) / (counts + 1.0).sum()
        mass = np.add.reduceat(share, self.bounds[:-1])
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {
            "E": rng.normal(0, 0.3, (n, width)).astype(np.float32), "W": draw(width, 3 * width), "b": np.zeros(3 * width, np.float32), "U": draw(width, 3 * width),
            "C": draw(width, len(mass)) * np.float32(0.1), "c": np.log(mass).astype(np.float32), "O": rng.normal(0, 0.02, (n, width)).astype(np.float32), "o": np.log(share).astype(np.float32),
        }

    def table(self) -> np.ndarray:
        """What each symbol adds to the gates."""
        return self.p["E"] @ self.p["W"] + self.p["b"]

    def flat(self) -> np.ndarray:
        """All parameters as one vector."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def put(self, flat: np.ndarray) -> None:
        """Take all parameters from one vector."""
        parts = np.split(flat, np.cumsum([v.size for v in self.p.values()])[:-1])
        self.p = {k: x.reshape(v.shape).astype(v.dtype) for (k, v), x in zip(self.p.items(), parts, strict=True)}

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target after each state."""
        ranked, edges = self.by_class(target)
        h, target = h[ranked], target[ranked]
        out = np.empty(len(h))
        cls, bias, own_bias, bounded = self.class_of[target], *self.biases()
        for a in range(0, len(h), ROWS):
            out[a : a + ROWS] = _log_share(_logits(h[a : a + ROWS], self.p["C"], bias, bounded), cls[a : a + ROWS])
        for k in range(len(self.bounds) - 1):
            rows = slice(edges[k], edges[k + 1])
            a, b = self.bounds[k], self.bounds[k + 1]
            if edges[k + 1] > edges[k] and b > a + 1:
                out[rows] += _log_share(_logits(h[rows], self.p["O"][a:b].T, own_bias[a:b], bounded), target[rows] - a)
        placed = np.empty_like(out)
        placed[ranked] = out
        return placed

    def biases(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Biases of classes, and of symbols in their class, less the largest; whether logits then stay within 60 of it, as states lie in -1 to 1."""
        c, o = self.p["c"], self.p["o"]
        most = max(np.abs(self.p["C"]).sum(0).max(), np.abs(self.p["O"]).sum(1).max())
        return c - c.max(), o - np.repeat(np.maximum.reduceat(o, self.bounds[:-1]), np.diff(self.bounds)), bool(most < 60)

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of targets by class, and where each class begins in it."""
        cls = self.class_of[target]
        ranked = np.argsort(cls, kind="stable")
        return ranked, np.searchsorted(cls[ranked], np.arange(len(self.bounds)))


def lanes(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts dealt to lanes, the longest first into the shortest lane: texts in lane order and the lanes' bounds among them, long lanes first."""
    k = max(1, min(most, len(lengths)))
    heap, own = [(0, i) for i in range(k)], [[] for _ in range(k)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        total, lane = heap[0]
        own[lane].append(d)
        heapq.heapreplace(heap, (total + int(lengths[d]), lane))
    totals = np.zeros(k, np.int64)
    for total, lane in heap:
        totals[lane] = total
    own = [own[i] for i in np.argsort(-totals, kind="stable")]
    return np.array([d for lane in own for d in lane], np.int64), np.concatenate([[0], np.cumsum([len(lane) for lane in own])])


class Streams:
    """Texts laid out in lanes: for each lane the places of its symbols."""

    def __init__(self, off: np.ndarray, most: int) -> None:
        lengths = np.diff(off)
        order, bounds = lanes(lengths, most)
        self.place = ragged(off[:-1][order], lengths[order])
        ends = np.concatenate([[0], np.cumsum(lengths[order])])[bounds]
        self.first, self.length = ends[:-1], np.diff(ends)

    def windows(self, size: int):
        """Places (step, lane) of each window, and how many lanes are left at each step."""
        for t in range(0, int(self.length.max(initial=0)), size):
            left = np.searchsorted(-self.length, -np.arange(t, min(t + size, int(self.length[0]))), "left")
            at = np.minimum(self.first[: left[0]] + t + np.arange(len(left))[:, None], len(self.place) - 1)
            yield self.place[at], left


def before(ids: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol read before each place, the end's at a text's beginning; and whether a text begins there."""
    begins = np.zeros(len(ids), bool)
    begins[off[:-1][np.diff(off) > 0]] = True
    prev = np.empty_like(ids)
    prev[1:], prev[:1] = ids[:-1], end
    prev[begins] = end
    return prev, begins


def text_log_probs(net: Network, ids: np.ndarray, off: np.ndarray, end: int) -> np.ndarray:
    """Natural log-probability of each whole text of symbols; texts are ``ids[off[i]:off[i+1]]``."""
    table, u, w = net.table(), net.p["U"], net.width
    prev, begins = before(ids, off, end)
    each = np.zeros(len(ids))
    state = np.zeros((WIDE, w), np.float32)
    for place, left in Streams(off, WIDE).windows(WINDOW):
        x, fresh = prev[place], begins[place]
        out = np.empty((len(left), place.shape[1], w), np.float32)
        with np.errstate(over="ignore"):
            for t, n in enumerate(left):
                h = state[:n]
                h[fresh[t, :n]] = 0
                g, q = table[x[t, :n]], h @ u
                gates = g[:, : 2 * w] + q[:, : 2 * w]
                _sigmoid(gates)
                new = np.multiply(gates[:, w:], q[:, 2 * w :])
                new += g[:, 2 * w :]
                np.tanh(new, out=new)
                h -= new
                h *= gates[:, :w]
                h += new
                out[t, :n] = h
        live = np.arange(place.shape[1]) < left[:, None]
        at = place[live]
        each[at] = net.log_probs(out[live], ids[at])
    return np.add.reduceat(np.append(each, 0.0), off[:-1]) * (np.diff(off) > 0)


class Room:
    """Arrays that windows of one size use again."""

    def __init__(self, steps: int, n: int, w: int, kind: np.dtype) -> None:
        self.q, self.dx, self.dq = (np.zeros((steps, n, 3 * w), kind) for _ in range(3))
        self.gates, self.start, self.new, self.after, self.dout = (np.zeros((steps, n, k * w), kind) for k in (2, 1, 1, 1, 1))
        self.d: dict[str, np.ndarray] = {}


def _gradients(net: Network, x: np.ndarray, fresh: np.ndarray, y: np.ndarray, live: np.ndarray, state: np.ndarray, room: Room | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean loss over one window of (step, lane); ``state`` moves on. Lanes that are left come first. Another window in the same ``room`` overwrites them."""
    p, w, (steps, n) = net.p, net.width, x.shape
    left, kind = live.sum(1), p["E"].dtype
    if room is None or room.q.shape[:2] != (steps, n):
        room = Room(steps, n, w, kind)
    if left[-1] < n:
        for a in (room.start, room.dx, room.dq):
            a[:] = 0
    used, symbol = np.unique(x, return_inverse=True)
    symbol = symbol.ravel()
    into = (p["E"][used] @ p["W"] + p["b"])[symbol].reshape(steps, n, 3 * w)
    with np.errstate(over="ignore"):
        for t, k in enumerate(left):
            h, q, g, c, g0 = room.start[t, :k], room.q[t, :k], room.gates[t, :k], room.new[t, :k], into[t, :k]
            h[:] = (room.after[t - 1] if t else state)[:k]
            h[fresh[t, :k]] = 0
            np.matmul(h, p["U"], out=q)
            np.add(g0[:, : 2 * w], q[:, : 2 * w], out=g)
            _sigmoid(g)
            np.multiply(g[:, w:], q[:, 2 * w :], out=c)
            c += g0[:, 2 * w :]
            np.tanh(c, out=c)
            a = room.after[t, :k]
            np.subtract(h, c, out=a)
            a *= g[:, :w]
            a += c
            state[:k] = a
    # rows by class, so that a class's rows are neighbours
    rows = np.flatnonzero(live.ravel())
    target = y.ravel()[rows]
    ranked, edges = net.by_class(target)
    out, target = room.after.reshape(-1, w)[rows[ranked]], target[ranked]
    for name, v in p.items():
        if name not in room.d:
            room.d[name] = np.empty_like(v)
        room.d[name][:] = 0
    d, own, cls = room.d, np.empty_like(out), net.class_of[target]
    bias, own_bias, bounded = net.biases()
    back = np.ascontiguousarray(p["C"].T)
    for a in range(0, len(rows), ROWS):
        mine = slice(a, a + ROWS)
        e = _softmax(_logits(out[mine], p["C"], bias, bounded))
        e[np.arange(len(e)), cls[mine]] -= 1
        d["C"] += out[mine].T @ e
        d["c"] += np.ones(len(e), kind) @ e
        np.matmul(e, back, out=own[mine])
    for i in range(len(net.bounds) - 1):
        mine = slice(edges[i], edges[i + 1])
        a, b = net.bounds[i], net.bounds[i + 1]
        if edges[i + 1] > edges[i] and b > a + 1:
            e = _softmax(_logits(out[mine], p["O"][a:b].T, own_bias[a:b], bounded))
            e[np.arange(len(e)), target[mine] - a] -= 1
            np.matmul(e.T, out[mine], out=d["O"][a:b])
            d["o"][a:b] = np.ones(len(e), kind) @ e
            own[mine] += e @ p["O"][a:b]
    if len(rows) < steps * n:
        room.dout[:] = 0
    room.dout.reshape(-1, w)[rows[ranked]] = own
    dh, back = np.zeros((n, w), kind), np.ascontiguousarray(p["U"].T)
    for t in reversed(range(steps)):
        k = left[t]
        g, h, c, dx, dq = room.gates[t, :k], room.start[t, :k], room.new[t, :k], room.dx[t, :k], room.dq[t, :k]
        z, r, dk = g[:, :w], g[:, w:], dh[:k]
        dk += room.dout[t, :k]
        keep = dk * z
        h = h - c
        h *= keep
        dk -= keep
        one = 1 - g
        np.multiply(h, one[:, :w], out=dx[:, :w])
        c *= c
        np.subtract(1, c, out=c)
        c *= dk
        dx[:, 2 * w :] = c
        c *= r
        dq[:, 2 * w :] = c
        c *= room.q[t, :k, 2 * w :]
        c *= one[:, w:]
        dx[:, w : 2 * w] = c
        dq[:, : 2 * w] = dx[:, : 2 * w]
        np.matmul(dq, back, out=dk)
        dk += keep
        dk[fresh[t, :k]] = 0
    dx = room.dx.reshape(-1, 3 * w)
    d["U"][:], d["b"][:] = room.start.reshape(-1, w).T @ room.dq.reshape(-1, 3 * w), np.ones(len(dx), kind) @ dx
    d["W"][:] = p["E"][x.ravel()].T @ dx
    ranked = np.argsort(symbol.astype(np.int16) if len(used) < 1 << 15 else symbol, kind="stable")
    d["E"][used] = np.add.reduceat((dx @ p["W"].T)[ranked], np.searchsorted(symbol[ranked], np.arange(len(used))))
    for v in d.values():
        v /= max(1, len(rows))
    return d


class Adam:
    """Moments of the gradients."""

    def __init__(self, net: Network) -> None:
        self.m, self.v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
        self.step = 0

    def move(self, net: Network, grads: dict[str, np.ndarray], rate: float) -> None:
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        self.step += 1
        for k, g in grads.items():
            if norm > CLIP:
                g *= CLIP / norm
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.005 * (g * g - self.v[k])
            net.p[k] -= (rate / (1 - 0.9**self.step) * np.sqrt(1 - 0.995**self.step)) * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def _one_pass(net: Network, adam: Adam, prev: np.ndarray, begins: np.ndarray, ids: np.ndarray, off: np.ndarray, most: int, rate: float) -> None:
    """Every symbol once, ``most`` texts side by side or fewer, so that there are at least 64 windows."""
    side = max(8, min(most, len(ids) // (64 * STEPS)))
    state, room = np.zeros((side, net.width), np.float32), None
    for place, left in Streams(off, side).windows(STEPS):
        if room is None or room.q.shape[:2] != place.shape:
            room = Room(*place.shape, net.width, state.dtype)
        live = np.arange(place.shape[1]) < left[:, None]
        adam.move(net, _gradients(net, prev[place], begins[place], ids[place], live, state[: place.shape[1]], room), rate)


def passed(net: Network, prev: np.ndarray, ids: np.ndarray, off: np.ndarray, rate: float) -> None:
    """Move the weights by one pass over all symbols of these texts, each after the symbol ``prev`` before it."""
    if len(ids):
        begins = np.zeros(len(ids), bool)
        begins[off[:-1][np.diff(off) > 0]] = True
        _one_pass(net, Adam(net), prev, begins, ids, off, BROAD, rate)


def fit(counts: np.ndarray, ids: np.ndarray, off: np.ndarray, end: int, seed: int = 0) -> Network:
    """Train on texts of symbols; one in ten is held back, and the pass that scores it best is kept."""
    net = Network(counts, seed)
    lengths = np.diff(off)
    if len(lengths) < 10 or not len(ids):
        return net
    back = np.arange(len(lengths)) % 10 == 9
    part = lambda keep: (ids[ragged(off[:-1][keep], lengths[keep])], np.concatenate([[0], np.cumsum(lengths[keep])]))
    (train, t_off), (held, h_off) = part(~back), part(back)
    prev, begins = before(train, t_off, end)
    adam = Adam(net)
    best, kept = text_log_probs(net, held, h_off, end).sum(), {k: x.copy() for k, x in net.p.items()}
    for epoch in range(PASSES):
        _one_pass(net, adam, prev, begins, train, t_off, LANES, RATE * 0.7**epoch)
        now = text_log_probs(net, held, h_off, end).sum()
        if now <= best:
            break
        best, kept = now, {k: x.copy() for k, x in net.p.items()}
    net.p = kept
    return net
