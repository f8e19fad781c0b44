"""A gated recurrent network over word symbols with a class-factored softmax, in numpy.

Symbols are dealt to classes: P(symbol | state) = P(class | state) * P(symbol | class, state).  Words are in classes of
equal number; the end and the symbol of all other words, which are met most, are classes of their own and need no second
factor."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

import numpy as np

#: Classes of words, words in each; the end is symbol 0, then the words, the last symbol stands for all other words.
WORD_CLASSES, MEMBERS, EMBED, STATE = 16, 64, 12, 16
CLASSES, SYMBOLS = WORD_CLASSES + 2, WORD_CLASSES * MEMBERS + 2
F4 = np.float32
# Shapes of the parameters, in the order of the flat vector.
SHAPES = {"e": (SYMBOLS, EMBED), "w": (EMBED, 3 * STATE), "u": (STATE, 3 * STATE), "b": (3 * STATE,), "cw": (STATE, CLASSES), "cb": (CLASSES,),
          "mw": (WORD_CLASSES, STATE, MEMBERS), "mb": (WORD_CLASSES, MEMBERS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def class_of(symbols: np.ndarray) -> np.ndarray:
    """Words' classes come first, then the end's and that of the other words."""
    cls = (symbols - 1) // MEMBERS
    cls[symbols == 0] = WORD_CLASSES
    cls[symbols == SYMBOLS - 1] = WORD_CLASSES + 1
    return cls


def initial(counts: np.ndarray, seed: int = 0) -> np.ndarray:
    """Small random weights; the output offsets are the symbols' own log frequencies."""
    rng = np.random.default_rng(seed)
    flat = (rng.standard_normal(SIZE) * 0.1).astype(F4)
    p = views(flat)
    some = counts + 0.5
    words = some[1:-1].reshape(WORD_CLASSES, MEMBERS)
    by_class = np.concatenate([words.sum(axis=1), some[[0, -1]]])
    p["b"][:] = 0
    p["cb"][:] = np.log(by_class / by_class.sum())
    p["mb"][:] = np.log(words / words.sum(axis=1, keepdims=True))
    p["mw"][:] *= 0.1
    p["cw"][:] *= 0.1
    return flat


def step(p, table, symbols, h):
    """Next state. ``table``: each symbol's input to the gates."""
    x, a = table[symbols], h @ p["u"]
    gates, n = x[:, : 2 * STATE], x[:, 2 * STATE :]
    gates += a[:, : 2 * STATE]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r, an = gates[:, :STATE], gates[:, STATE:], a[:, 2 * STATE :]
    n += r * an
    np.tanh(n, out=n)
    out = h - n
    out *= z
    out += n
    return out


def _by_class(h, symbols):
    """The classes; the rows that are words in order of class, the bounds of each class in them, their states and members."""
    cls = class_of(symbols)
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    ends = np.searchsorted(cls[order], np.arange(WORD_CLASSES + 1)).tolist()
    order = order[: ends[-1]]
    return cls, order, ends, h[order], ((symbols - 1) % MEMBERS)[order]


def _chosen(logits, which):
    """Natural log of the softmax at one place of each row."""
    logits -= logits.max(axis=1, keepdims=True)
    picked = logits[np.arange(len(logits)), which]
    return picked - np.log(np.exp(logits, out=logits).sum(axis=1))


def _softmax_error(logits, which, weight):
    """Gradient of the weighted negative log of the softmax at one place of each row."""
    logits -= logits.max(axis=1, keepdims=True)
    d = np.exp(logits, out=logits)
    d *= (weight / d.sum(axis=1))[:, None]
    d[np.arange(len(d)), which] -= weight
    return d


def log_probability(p, h, symbols):
    """Natural log probability of each symbol given its state (rows of ``h``)."""
    cls, order, ends, by_class, member = _by_class(h, symbols)
    out = _chosen(h @ p["cw"] + p["cb"], cls)
    inside = np.empty(len(order), out.dtype)
    for c in range(WORD_CLASSES):
        a, b = ends[c], ends[c + 1]
        if a < b:
            inside[a:b] = _chosen(by_class[a:b] @ p["mw"][c] + p["mb"][c], member[a:b])
    out[order] += inside
    return out


def gradient(p, g, symbols_in, symbols_out, mask, h):
    """Adds to ``g`` the gradient over one window (time x rows); returns the last state (truncated there)."""
    steps, rows = symbols_in.shape
    table = p["e"] @ p["w"] + p["b"]
    gates, sums = table[symbols_in], np.empty((steps, rows, 3 * STATE), F4)  # what ``step`` has, kept for the way back
    z, r, n, an = gates[:, :, :STATE], gates[:, :, STATE : 2 * STATE], gates[:, :, 2 * STATE :], sums[:, :, 2 * STATE :]
    states = np.empty((steps + 1, rows, STATE), F4)
    states[0] = h
    before, hs = states[:-1], states[1:]
    for t in range(steps):
        a = np.matmul(before[t], p["u"], out=sums[t])
        both = gates[t, :, : 2 * STATE]
        both += a[:, : 2 * STATE]
        np.negative(both, out=both)
        np.exp(both, out=both)
        both += 1
        np.reciprocal(both, out=both)
        n[t] += r[t] * an[t]
        np.tanh(n[t], out=n[t])
        h = np.subtract(before[t], n[t], out=hs[t])
        h *= z[t]
        h += n[t]
    flat, weight = hs.reshape(-1, STATE), mask.ravel().astype(F4) / F4(max(1, mask.sum()))
    cls, order, ends, by_class, member = _by_class(flat, symbols_out.ravel())
    d = _softmax_error(flat @ p["cw"] + p["cb"], cls, weight)
    g["cw"] += flat.T @ d
    g["cb"] += d.sum(axis=0)
    dh_out, inside, weight = d @ p["cw"].T, np.empty_like(by_class), weight[order]
    for c in range(WORD_CLASSES):
        a, b = ends[c], ends[c + 1]
        if a < b:
            d = _softmax_error(by_class[a:b] @ p["mw"][c] + p["mb"][c], member[a:b], weight[a:b])
            g["mw"][c] += by_class[a:b].T @ d
            g["mb"][c] += d.sum(axis=0)
            inside[a:b] = d @ p["mw"][c].T
    dh_out[order] += inside
    dh_out = dh_out.reshape(steps, rows, STATE)
    # What each gate passes back for a unit of the state's gradient.
    to_n, to_z, to_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), an * r * (1 - r)
    da, dn = np.empty((steps, rows, 3 * STATE), F4), np.empty((steps, rows, STATE), F4)
    back, dh = p["u"].T, np.zeros((rows, STATE), F4)
    for t in range(steps - 1, -1, -1):
        dh = dh + dh_out[t]
        np.multiply(dh, to_n[t], out=dn[t])
        np.multiply(dh, to_z[t], out=da[t, :, :STATE])
        np.multiply(dn[t], to_r[t], out=da[t, :, STATE : 2 * STATE])
        np.multiply(dn[t], r[t], out=da[t, :, 2 * STATE :])
        dh = dh * z[t] + da[t] @ back
    da = da.reshape(-1, 3 * STATE)
    g["u"] += before.reshape(-1, STATE).T @ da
    dx = da
    dx[:, 2 * STATE :] = dn.reshape(-1, STATE)
    used = symbols_in.ravel()
    order = np.argsort(used, kind="stable")
    firsts = np.flatnonzero(np.diff(used[order], prepend=-1))
    dtable = np.zeros_like(table)
    dtable[used[order[firsts]]] = np.add.reduceat(dx[order], firsts)
    g["b"] += dtable.sum(axis=0)
    g["w"] += p["e"].T @ dtable
    g["e"] += dtable @ p["w"].T
    return h.copy()


def train(flat: np.ndarray, texts: Iterable[np.ndarray], start: int, window: int = 16, rows: int = 256, rate: float = 0.01) -> tuple[np.ndarray, int]:
    """One pass of truncated backpropagation (Adam) over whole texts of symbols, and the number of symbols.

    ``rows`` texts are read side by side, a window at a time, each with its state carried on; where one ends, the next
    begins.  A window of few symbols, when few texts are left, takes a smaller step."""
    flat = flat.copy()
    p, grad = views(flat), np.zeros_like(flat)
    g, m, v, k, n = views(grad), np.zeros_like(flat), np.zeros_like(flat), 0, 0
    texts, live, at = iter(texts), [], []
    before, h = np.zeros(0, np.int64), np.zeros((0, STATE), F4)
    while True:
        going = [j for j, s in enumerate(live) if at[j] < len(s)]
        new = list(islice((s for s in texts if len(s)), rows - len(going)))
        live, at = [live[j] for j in going] + new, [at[j] for j in going] + [0] * len(new)
        if not live:
            return flat, n
        before = np.concatenate([before[going], np.full(len(new), start)])
        h = np.concatenate([h[going], np.zeros((len(new), STATE), F4)])
        out, mask = np.zeros((window, len(live)), np.int64), np.zeros((window, len(live)), bool)
        for j, s in enumerate(live):
            part = s[at[j] : at[j] + window]
            out[: len(part), j], mask[: len(part), j] = part, True
            at[j] += len(part)
        grad[:] = 0
        h = gradient(p, g, np.vstack([before[None, :], out[:-1]]), out, mask, h)
        before = out[-1]
        norm = float(np.sqrt((grad**2).sum()))
        if norm > 1:
            grad /= norm
        k, now = k + 1, int(mask.sum())
        n += now
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        flat -= F4(rate * min(1, now / (window * 32)) ** 0.5) * (m / F4(1 - 0.9**k)) / (np.sqrt(v / F4(1 - 0.99**k)) + F4(1e-6))


def score(flat: np.ndarray, texts: list[np.ndarray], start: int, window: int = 32, rows: int = 1_024) -> np.ndarray:
    """Natural log probability of each whole symbol sequence; ``rows`` of like length are read together."""
    p = views(flat)
    table = p["e"] @ p["w"] + p["b"]
    out = np.zeros(len(texts))
    order = np.argsort(-np.fromiter(map(len, texts), np.int64, len(texts)), kind="stable")
    for i in range(0, len(texts), rows):
        at = order[i : i + rows]
        out[at] = _score(p, table, [texts[k] for k in at], start, window)
    return out


def _score(p, table, texts: list[np.ndarray], start: int, window: int) -> np.ndarray:
    """``score`` of texts that are all read together, a window at a time; the state of each is carried on, and those
    that have ended leave."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-lengths, kind="stable")
    lengths, total = lengths[order], np.zeros(len(texts))
    h = np.zeros((len(texts), STATE), F4)
    before = np.full(len(texts), start)
    for t0 in range(0, int(lengths[0]) if len(texts) else 0, window):
        live = int(np.searchsorted(-lengths, -t0, side="left"))
        now = np.zeros((window, live), np.int64)
        for j in range(live):
            s = texts[order[j]][t0 : t0 + window]
            now[: len(s), j] = s
        states, symbols, owners = [], [], []
        h = h[:live]
        for t in range(window):
            n = int(np.searchsorted(-lengths, -(t0 + t), side="left"))
            if not n:
                break
            h = h[:n] if n < len(h) else h
            h = step(p, table, before[:n], h)
            before = now[t]
            states.append(h)
            symbols.append(before[:n])
            owners.append(n)
        got = log_probability(p, np.concatenate(states), np.concatenate(symbols))
        at = 0
        for n in owners:
            total[:n] += got[at : at + n]
            at += n
    out = np.zeros(len(texts))
    out[order] = total
    return out
