"""The numerical part of the gated recurrent language model: numpy on the tokens of one task.

Symbols: 0 is the end of a text, 1 to ``HEAD`` - 1 are frequent words in classes of ``WIDTH``, then one symbol
for each class of rare words. The output is factored: a softmax over classes, then one inside a class of
frequent words. What a rare word adds inside its class does not depend on the state and is added elsewhere.

For scoring, texts are dealt to lanes, longest first to the shortest lane, and a lane reads its texts one after the
other; the state is carried through all windows of a text, so the whole text is read. For training, all texts make one
stream, in an order drawn from a seed, that is cut into equal lanes: every token is learned from once, lanes are busy to
the end however long one text is, and the state is carried too, but gradients stop at the edge of a window.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

HEAD, WIDTH, RARE, UNITS = 1024, 64, 48, 16
CLASSES = HEAD // WIDTH
SYMBOLS = HEAD + RARE
SHAPES = {
    "inward": (SYMBOLS, 3 * UNITS), "across": (UNITS, 3 * UNITS), "to_class": (UNITS, CLASSES + RARE), "class_bias": (CLASSES + RARE,),
    "to_word": (CLASSES, UNITS, WIDTH), "word_bias": (CLASSES, WIDTH),
}
LOG10 = 1 / np.log(10.0)
LEAST_RUN = 64  # a training lane is not cut shorter


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial(counts: np.ndarray, seed: int) -> np.ndarray:
    """Starts as the unigram model: biases are log counts of symbols, weights are small."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    smooth = counts + 0.5
    head = smooth[:HEAD].reshape(CLASSES, WIDTH)
    p["class_bias"] = np.log(np.concatenate((head.sum(axis=1), smooth[HEAD:])) / smooth.sum()).astype(np.float32)
    p["word_bias"] = np.log(head / head.sum(axis=1, keepdims=True)).astype(np.float32)
    return np.concatenate([p[k].ravel() for k in SHAPES]).astype(np.float32)


@dataclass
class Lanes:
    """Step-by-lane tables; lanes are ordered by length, so those still busy at a step lead."""

    symbol: np.ndarray  # read at a step
    target: np.ndarray  # to be predicted
    text: np.ndarray  # whose score it adds to; -1 past the end
    start: np.ndarray  # the state is cleared before a text's first step
    length: np.ndarray


def lanes(texts: list[np.ndarray], most: int) -> Lanes:
    """``texts``: symbols without the end."""
    n = max(1, min(most, len(texts)))
    heap, dealt = [(0, k) for k in range(n)], [[] for _ in range(n)]
    for i in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        load, k = heapq.heappop(heap)
        dealt[k].append(i)
        heapq.heappush(heap, (load + len(texts[i]) + 1, k))
    length = np.array([sum(len(texts[i]) + 1 for i in own) for own in dealt])
    order = np.argsort(-length, kind="stable")
    steps = int(length.max()) if len(texts) else 0
    out = Lanes(np.zeros((steps, n), np.int32), np.zeros((steps, n), np.int32), np.full((steps, n), -1, np.int32), np.zeros((steps, n), bool), length[order])
    for k, lane in enumerate(order):
        at = 0
        for i in dealt[lane]:
            s, end = texts[i], at + len(texts[i])
            out.target[at:end, k], out.symbol[at + 1 : end + 1, k] = s, s
            out.text[at : end + 1, k] = i
            out.start[at, k] = True
            at = end + 1
    return out


def stream(texts: list[np.ndarray], most: int, seed: int = 0) -> Lanes:
    """All texts and their ends as lanes of one length; only the last lane may be shorter."""
    order = np.random.default_rng(seed).permutation(len(texts))
    size = np.array([len(texts[i]) + 1 for i in order])
    total = int(size.sum())
    steps = -(-total // max(1, min(most, total // LEAST_RUN)))
    n = -(-total // steps)
    target = np.zeros(n * steps, np.int32)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    for at, i in zip(begin, order):
        target[at : at + len(texts[i])] = texts[i]
    symbol, start, text = np.zeros_like(target), np.zeros(len(target), bool), np.full(len(target), -1, np.int32)
    symbol[1:] = target[:-1]  # before the first symbol of a text comes the end of another, and both are 0
    start[begin] = start[::steps] = True
    text[:total] = 0
    cells = [np.ascontiguousarray(x.reshape(n, steps).T) for x in (symbol, target, text, start)]
    length = np.full(n, steps)
    return Lanes(*cells, length)


def by_unit(x: np.ndarray) -> np.ndarray:
    """(step, lane, unit) as (step, unit, lane): gates are then slices without gaps."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def by_row(x: np.ndarray) -> np.ndarray:
    """(step, unit, lane) as one row of units for each step and lane."""
    return x.transpose(0, 2, 1).reshape(-1, x.shape[1])


def recur(p: dict, symbol: np.ndarray, start: np.ndarray, h: np.ndarray, trace: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States (step, unit, lane) of a window, and the last one; ``trace`` is filled with what gradients need."""
    across, u = np.ascontiguousarray(p["across"].T), UNITS
    given = by_unit(p["inward"][symbol])
    keep = (~start).astype(np.float32)
    steps, n = symbol.shape
    states, gates = np.empty((steps, u, n), np.float32), np.empty((steps, 2 * u, n), np.float32)
    fresh, before, inner = (np.empty_like(states) for _ in range(3))
    for t in range(steps):
        h = np.multiply(h, keep[t], out=before[t])
        a, b, gate, f, s = given[t], across @ h, gates[t], fresh[t], states[t]
        np.add(a[: 2 * u], b[: 2 * u], out=gate)
        np.negative(gate, out=gate)
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        inner[t] = b[2 * u :]
        np.multiply(gate[u:], b[2 * u :], out=f)
        f += a[2 * u :]
        np.tanh(f, out=f)
        np.subtract(h, f, out=s)
        s *= gate[:u]
        s += f
        h = s
    if trace is not None:
        trace |= {"before": before, "fresh": fresh, "inner": inner, "gate": gates, "keep": keep}
    return states, h


SAFE = 60.0  # logits within it need no shift before they are raised: sums stay inside single precision


def _picked(x: np.ndarray, at: np.ndarray, gradient: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The log softmax of each row at one place and, if asked for, its gradient with the sign of a loss. Overwrites ``x``."""
    rows = np.arange(len(x))
    if len(x) and not (x.max() < SAFE and x.min() > -SAFE):
        x -= x.max(axis=1, keepdims=True)
    own = x[rows, at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    if not gradient:
        return own - np.log(total), None
    x *= (1 / total)[:, None]
    x[rows, at] -= 1
    return own - np.log(total), x


def class_of(target: np.ndarray) -> np.ndarray:
    return np.where(target < HEAD, target // WIDTH, target - HEAD + CLASSES)


def emit(p: dict, h: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural-log probability of each target given its state; with ``grad``, also the loss gradient by state."""
    which = class_of(target).astype(np.int16)
    order = np.argsort(which, kind="stable")
    which, sorted_h, column = which[order], h[order], target[order] % WIDTH
    logits = sorted_h @ p["to_class"]
    logits += p["class_bias"]
    logs, d = _picked(logits, which, grad is not None)
    if grad is not None:
        grad["to_class"] += sorted_h.T @ d
        grad["class_bias"] += d.sum(axis=0)
        d = d @ p["to_class"].T
    edges = np.searchsorted(which, np.arange(CLASSES + 1))
    parts = [(c, slice(lo, hi)) for c, (lo, hi) in enumerate(zip(edges, edges[1:])) if lo < hi]
    words = np.empty((edges[-1], WIDTH), np.float32)
    for c, part in parts:
        np.matmul(sorted_h[part], p["to_word"][c], out=words[part])
        words[part] += p["word_bias"][c]
    inner, e = _picked(words, column[: len(words)], grad is not None)
    logs[: len(words)] += inner
    if grad is not None:
        for c, part in parts:
            grad["to_word"][c] += sorted_h[part].T @ e[part]
            grad["word_bias"][c] += e[part].sum(axis=0)
            d[part] += e[part] @ p["to_word"][c].T
    out = np.empty(len(target))
    out[order] = logs
    back = None
    if grad is not None:
        back = np.empty_like(d)
        back[order] = d
    return out, back


def _add_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``into[at] += rows`` with repeats in ``at``: rows of one place are summed next to each other first."""
    order = np.argsort(at.astype(np.int16), kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    into[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def score(flat: np.ndarray, texts: list[np.ndarray], most_lanes: int = 512, window: int = 16) -> np.ndarray:
    """log10 probability of each text's symbols and its end."""
    p, total = unpacked(flat), np.zeros(len(texts))
    if not texts:
        return total
    # no more lanes than the longest text leaves room for: the tables stay within a few times the tokens
    sizes = [len(t) + 1 for t in texts]
    lane = lanes(texts, min(most_lanes, -(-sum(sizes) // max(sizes))))
    h = np.zeros((UNITS, len(lane.length)), np.float32)
    for lo in range(0, len(lane.symbol), window):
        busy = int(np.searchsorted(-lane.length, -lo, "left"))
        cut = (slice(lo, lo + window), slice(0, busy))
        states, h = recur(p, lane.symbol[cut], lane.start[cut], h[:, :busy])
        text = lane.text[cut].ravel()
        real = text >= 0
        logs, _ = emit(p, by_row(states)[real], lane.target[cut].ravel()[real])
        total += np.bincount(text[real], logs, len(texts))
    return total * LOG10


def train(flat: np.ndarray, texts: list[np.ndarray], most_lanes: int = 128, window: int = 16, rate: float = 0.3) -> np.ndarray:
    """One pass of truncated backpropagation over the texts with Adagrad steps; returns new parameters."""
    flat = flat.copy()
    if not texts:
        return flat
    p, lane = unpacked(flat), stream(texts, most_lanes)
    square = np.full(len(flat), 1e-2, np.float32)
    h = np.zeros((UNITS, len(lane.length)), np.float32)
    u, across = UNITS, p["across"]
    for lo in range(0, len(lane.symbol), window):
        cut = slice(lo, lo + window)
        symbol, trace = lane.symbol[cut], {}
        states, h = recur(p, symbol, lane.start[cut], h, trace)
        real = lane.text[cut].ravel() >= 0
        gradient = np.zeros(len(flat), np.float32)
        grad = unpacked(gradient)
        _, back = emit(p, by_row(states)[real], lane.target[cut].ravel()[real], grad)
        outward = np.zeros((len(real), u), np.float32)
        outward[real] = back
        outward = by_unit(outward.reshape(*symbol.shape, u))
        before, fresh, inner, z, r = trace["before"], trace["fresh"], trace["inner"], trace["gate"][:, :u], trace["gate"][:, u:]
        by_fresh, by_z, by_r = (1 - z) * (1 - fresh * fresh), (before - fresh) * z * (1 - z), inner * r * (1 - r)
        inward = np.empty((len(symbol), 3 * u, symbol.shape[1]), np.float32)
        through = np.empty_like(inward)
        dh = np.zeros_like(h)
        for t in reversed(range(len(symbol))):
            dh += outward[t]
            d, m = inward[t], through[t]
            np.multiply(dh, by_z[t], out=d[:u])
            np.multiply(dh, by_fresh[t], out=d[2 * u :])
            np.multiply(d[2 * u :], by_r[t], out=d[u : 2 * u])
            m[: 2 * u] = d[: 2 * u]
            np.multiply(d[2 * u :], r[t], out=m[2 * u :])
            dh *= z[t]
            dh += across @ m
            dh *= trace["keep"][t]
        grad["across"] += np.matmul(before, through.transpose(0, 2, 1)).sum(axis=0)
        _add_rows(grad["inward"], symbol.ravel(), by_row(inward))
        gradient /= max(int(real.sum()), 1)
        norm = float(np.sqrt(gradient @ gradient))
        if norm > 1:
            gradient /= norm
        square += gradient * gradient
        gradient /= np.sqrt(square)
        gradient *= rate
        flat -= gradient
    return flat
