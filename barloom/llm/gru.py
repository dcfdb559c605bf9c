"""A gated recurrent language model in numpy: truncated backpropagation, and an output softmax factored by classes.

The next token's probability is that of its class times that of the token within its class. Tokens are numbered by
falling frequency and classes are runs of such numbers. Texts are laid end to end in parallel slots; the state starts at
zero with each text and is carried from window to window, so a text of any length is read whole in bounded memory.
"""
from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

REAL = np.float32
ROWS = 1 << 13


@dataclass(frozen=True)
class Shape:
    tokens: int
    hidden: int
    inner: int           # width of the input embedding
    ends: tuple[int, ...]   # one past the last token of each class


def classes(counts: np.ndarray, wanted: int) -> tuple[int, ...]:
    """Ends of about `wanted` classes with near-equal sums of the square roots of their counts (falling)."""
    mass = np.sqrt(counts.astype(np.float64)).cumsum()
    last = np.floor(mass / mass[-1] * wanted * (1 - 1e-12)).astype(int)
    return tuple(int(x) + 1 for x in np.flatnonzero(np.append(last[1:] != last[:-1], True)))


class Model:
    """Named weights; `flat` joins them to one vector, and `restore` takes them back.

    Biases are the last row of `into` and `pick` and the last column of `word`. Inside, a step's values have a row for each
    unit and a column for each slot, so that a gate is one piece of memory.
    """

    def __init__(self, shape: Shape, weights: dict[str, np.ndarray]):
        self.shape, self.w = shape, weights
        self.starts, self.widths = np.array((0, *shape.ends[:-1])), np.diff((0, *shape.ends))
        self.class_of = np.repeat(np.arange(len(shape.ends)), self.widths)

    @classmethod
    def start(cls, shape: Shape, counts: np.ndarray, seed: int) -> Model:
        """Small random weights; the output biases start at the tokens' own frequencies."""
        rng = np.random.default_rng(seed)
        h, d, bounds = shape.hidden, shape.inner, np.array((0, *shape.ends))
        p = np.maximum(counts, 0.5) / np.maximum(counts, 0.5).sum()
        mass = np.add.reduceat(p, bounds[:-1])
        embed, into, again = rng.normal(0, 0.3, (shape.tokens, d)), rng.normal(0, d ** -0.5, (d, 3 * h)), rng.normal(0, 0.5 * h ** -0.5, (h, 3 * h))
        pick, word = rng.normal(0, 0.05, (h, len(mass))), rng.normal(0, 0.05, (shape.tokens, h))
        gate, word0 = np.concatenate([np.zeros(h), np.ones(h), np.zeros(h)]), np.log(p) - np.repeat(np.log(mass), np.diff(bounds))
        return cls(shape, {k: v.astype(REAL) for k, v in {
            "embed": embed, "into": np.vstack([into, gate]), "again": again, "pick": np.vstack([pick, np.log(mass)]), "word": np.column_stack([word, word0])}.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def restore(self, vector: np.ndarray) -> Model:
        parts = np.split(vector.astype(REAL), np.cumsum([v.size for v in self.w.values()])[:-1])
        return Model(self.shape, {k: p.reshape(v.shape).copy() for (k, v), p in zip(self.w.items(), parts)})

    def cell(self) -> np.ndarray:
        """What makes a step's sums of its state, its embedding and 1: the state's part of the new state, both gates (negative) and the input's part."""
        again, into, size = self.w["again"].T, self.w["into"].T, self.shape.hidden
        out = np.zeros((4 * size, size + into.shape[1]), again.dtype)
        out[:size, :size], out[size:3 * size, :size] = again[2 * size:], -again[:2 * size]
        out[size:3 * size, size:], out[3 * size:, size:] = -into[:2 * size], into[2 * size:]
        return out

    def read(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the inputs x (steps x slots); `fresh` marks the first of a text. `keep` collects what backpropagation needs."""
        size, cell, begins, (steps, slots) = self.shape.hidden, self.cell(), fresh.any(1).tolist(), x.shape
        one, kind = np.ones((), cell.dtype), cell.dtype
        given, sums = np.empty((steps, cell.shape[1], slots), kind), np.empty((1 if keep is None else steps, len(cell), slots), kind)
        given[:, size:-1], given[:, -1] = self.w["embed"].take(x, 0).transpose(0, 2, 1), 1
        out, own, h = np.empty((steps, size, slots), kind), np.empty((size, slots), kind), h.T
        parts = zip(sums, sums[:, :size], sums[:, size:2 * size], sums[:, 2 * size:3 * size], sums[:, size:3 * size], sums[:, 3 * size:])
        with np.errstate(over="ignore"):   # a gate is 1 / (1 + inf) = 0 then
            for t, (a, again, r, z, gates, n) in enumerate(parts if keep is not None else itertools.repeat(next(parts), steps)):
                state, after = given[t, :size], out[t]
                state[:] = h
                if begins[t]:
                    state[:, fresh[t]] = 0
                np.matmul(cell, given[t], a)
                np.exp(gates, gates)
                np.add(gates, one, gates)
                np.divide(one, gates, gates)
                np.multiply(again, r, own)
                np.add(n, own, n)
                np.tanh(n, n)
                np.subtract(state, n, after)
                np.multiply(after, z, after)
                np.add(after, n, after)
                h = after
        if keep is not None:
            keep += given, sums
        return out.transpose(0, 2, 1)

    def output(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each token y after state h; with `grads`, their gradients (of words: numbers and rows) and that of h too.

        Rows are sorted by token, and so by class; the logits of a row's class lie end to end. Rows are divided by their sums only after the products.
        """
        pick, word, size, kind = self.w["pick"], self.w["word"], self.shape.hidden, self.w["word"].dtype
        found, back, n = np.empty(len(y)), None, len(y)
        if not n:
            return found, None if grads is None else np.empty((0, size), kind)
        by = np.argsort(y.astype(np.uint16) if self.shape.tokens <= 1 << 16 else y, kind="stable")
        y = y[by]
        c = self.class_of[y]
        h1 = np.empty((n, size + 1), kind)
        h1[:, :size], h1[:, size] = h.take(by, 0), 1
        cuts = np.searchsorted(c, np.arange(len(self.widths) + 1))
        met = np.flatnonzero(np.diff(cuts))
        width = self.widths[c]
        last = width.cumsum()
        begin = last - width
        # Of each class that occurs: its rows, its words and their logits.
        blocks, logits = [], np.empty(int(last[-1]), kind)
        for lo, hi, s, k, o in zip(cuts[met].tolist(), cuts[met + 1].tolist(), self.starts[met].tolist(), self.widths[met].tolist(), begin[cuts[met]].tolist()):
            z, own = logits[o:o + (hi - lo) * k].reshape(hi - lo, k), word[s:s + k]
            np.matmul(h1[lo:hi], own.T, z)
            blocks.append((z, own, lo, hi))
        picks = h1 @ pick
        logs, sums, rows = 0.0, [], np.arange(n) * picks.shape[1]
        for z, at, starts in ((picks.ravel(), rows + c, rows), (logits, begin + y - self.starts[c], begin)):
            if not -60 < z.min() <= z.max() < 60:   # else no exponential leaves its range
                z -= np.maximum.reduceat(z, starts).repeat(np.diff(np.append(starts, len(z))))
            logs = logs + z.take(at)
            np.exp(z, z)
            total = np.add.reduceat(z, starts) if starts is begin else picks @ np.ones(picks.shape[1], kind)
            logs = logs - np.log(total, dtype=np.float64)
            if grads is not None:
                z[at] -= total
            sums.append((kind.type(scale) / total)[:, None])
        found[by] = logs
        if grads is not None:
            grads["pick"] += (h1 * sums[0]).T @ picks
            back = np.empty((n, size), kind)
            # The words of the classes that occur.
            ids = np.flatnonzero((np.diff(cuts) > 0).repeat(self.widths))
            g, scaled, left = np.empty((len(ids), size + 1), kind), h1 * sums[1], 0
            for z, own, lo, hi in blocks:
                np.matmul(z, own[:, :size], back[lo:hi])
                np.matmul(z.T, scaled[lo:hi], g[left:left + len(own)])
                left += len(own)
            grads["word"] = ids, g
            back *= sums[1]
            from_classes = picks @ pick[:size].T
            from_classes *= sums[0]
            from_classes += back
            back = np.empty_like(back)
            back[by] = from_classes
        return found, back

    def gradients(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, valid: np.ndarray, h: np.ndarray, tokens: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of a window's loss, divided by `tokens` and cut at its start, and the states at its end."""
        some, h = self.slopes(x, y, fresh, valid, h, tokens)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        for k, v in some.items():
            if isinstance(v, tuple):
                g[k][v[0]] = v[1]
            else:
                g[k] = v
        return g, h

    def slopes(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, valid: np.ndarray, h: np.ndarray, tokens: int) -> tuple[dict, np.ndarray]:
        """`gradients` without rows that are zero: of weights with a row for each token, numbers and their rows."""
        w, size, kept = self.w, self.shape.hidden, []
        g: dict = {"pick": np.zeros_like(w["pick"])}
        states, whole = self.read(x, fresh, h, kept), valid.all()
        back = self.output(states.reshape(-1, size) if whole else states[valid], y.ravel() if whole else y[valid], g, REAL(1 / tokens))[1]
        if whole:
            dstate = back.reshape(states.shape)
        else:
            dstate = np.zeros(states.shape, states.dtype)
            dstate[valid] = back
        dstate = np.ascontiguousarray(dstate.transpose(0, 2, 1))
        given, sums = kept
        own, r, z, n = (sums[:, k * size:(k + 1) * size] for k in range(4))
        # A step's gradient times these is what the step before has of it directly and that of the step's sums; they do not depend on later steps.
        to = np.empty((len(x), 5, size, x.shape[1]), sums.dtype)
        to[:, 0], rest = z, 1 - z
        np.multiply(rest, 1 - n * n, to[:, 4])
        np.multiply(to[:, 4], r, to[:, 1])
        np.multiply(to[:, 1], own * (1 - r), to[:, 2])
        rest *= z
        np.multiply(rest, given[:, :size] - n, to[:, 3])
        da, begins = np.empty((len(x), 5 * size, x.shape[1]), sums.dtype), fresh.any(1).tolist()
        dh, earlier = np.zeros_like(dstate[0]), np.concatenate([np.eye(size, dtype=sums.dtype), w["again"][:, 2 * size:], w["again"][:, :2 * size]], 1)
        for t, d, k, a, b in zip(range(len(x) - 1, -1, -1), dstate[::-1], to[::-1], da.reshape(to.shape)[::-1], da[::-1, :4 * size]):
            np.add(dh, d, dh)
            np.multiply(dh, k, a)
            np.matmul(earlier, b, dh)
            if begins[t]:
                dh[:, fresh[t]] = 0
        slots_first = da[:, size:].transpose(0, 2, 1)
        d = np.matmul(given[:, :size], slots_first[..., :3 * size]).sum(0)
        g["again"], g["into"] = np.concatenate([d[:, size:], d[:, :size]], 1), np.matmul(given[:, size:], slots_first[..., size:]).sum(0)
        inputs = x.ravel()
        by = np.argsort(inputs.astype(np.uint16) if self.shape.tokens <= 1 << 16 else inputs, kind="stable")
        g["embed"] = sums_by(inputs[by], np.matmul(slots_first[..., size:], w["into"][:-1].T).reshape(len(inputs), -1).take(by, 0))
        return g, states[-1]


def sums_by(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, which must be sorted, and the sums of their rows."""
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(rows, at, axis=0)


def lay_out(lengths: np.ndarray, slots: int) -> list[list[int]]:
    """Texts by slot, longest slot first: each text goes to the slot that is shortest so far, long texts first."""
    heap, out = [(0, s) for s in range(min(slots, len(lengths)))], [[] for _ in range(min(slots, len(lengths)))]
    for k in np.argsort(-lengths, kind="stable"):
        n, s = heapq.heappop(heap)
        out[s].append(int(k))
        heapq.heappush(heap, (n + int(lengths[k]), s))
    return sorted(out, key=lambda texts: -sum(int(lengths[k]) for k in texts))


def walk(texts: list[np.ndarray], begin: int, slots: int, steps: int, room: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of `steps` tokens of all slots that still have some: inputs, tokens, firsts, valid places and text numbers, each steps x slots.
    With `room`, windows become longer as slots end, up to so many places."""
    order = lay_out(np.array([len(t) for t in texts]), slots)
    sizes = np.array([sum(len(texts[k]) for k in s) for s in order])   # falling: the live slots come first
    every = [k for s in order for k in s]
    if not every:
        return
    flat, of = np.concatenate([texts[k] for k in every]).astype(np.int32), np.repeat(np.array(every, np.int32), [len(texts[k]) for k in every])
    first, places = np.append(True, of[1:] != of[:-1]), np.cumsum(sizes) - sizes
    at = 0
    while at < sizes[0]:
        live = int(np.searchsorted(-sizes, -at))   # slots longer than `at`
        upto = at + max(steps, min(room // live, int(sizes[0]) - at))
        valid = np.arange(at, upto)[:, None] < sizes[:live]
        place = np.minimum(places[:live] + np.arange(at, upto)[:, None], len(flat) - 1)
        fresh = first[place] | ~valid
        yield np.where(fresh, begin, flat[place - 1]).astype(np.int32), np.where(valid, flat[place], begin).astype(np.int32), fresh, valid, np.where(valid, of[place], -1)
        at = upto


def score_texts(model: Model, texts: list[np.ndarray], begin: int, slots: int = 512, steps: int = 32) -> np.ndarray:
    """Natural log probability of each text, its end token included."""
    total, h = np.zeros(len(texts)), np.zeros((0, model.shape.hidden), REAL)
    for x, y, fresh, valid, text in walk(texts, begin, slots, steps, slots * steps):
        h = h[:x.shape[1]] if len(h) else np.zeros((x.shape[1], model.shape.hidden), REAL)
        states = model.read(x, fresh, h)
        h = states[-1]
        states, y, text = (v.reshape(valid.size, *v.shape[2:]) if valid.all() else v[valid] for v in (states, y, text))
        logs = [model.output(states[at:at + ROWS], y[at:at + ROWS])[0] for at in range(0, len(y), ROWS)]   # logits of so many rows stay near the processor
        total += np.bincount(text, weights=np.concatenate(logs), minlength=len(texts))
    return total


class Learner:
    """Adagrad over windows; its sums of squared gradients travel with the weights."""

    def __init__(self, model: Model, squares: np.ndarray, rate: float):
        self.model, self.rate = model, rate
        self.squares = model.restore(squares).w

    def step(self, grads: dict) -> None:
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) and len(g[0]) < len(self.squares[k]) else (slice(None), g[1] if isinstance(g, tuple) else g)
            move = g * g
            move += self.squares[k][at]
            self.squares[k][at] = move
            np.sqrt(move, out=move)
            np.divide(g, move, out=move)
            move *= REAL(self.rate)
            self.model.w[k][at] -= move

    def learn(self, texts: list[np.ndarray], begin: int, slots: int, steps: int, share: int) -> int:
        """Learn from one window in `share`; the state passes through all of them. Returns the number of tokens learned from."""
        h, seen = np.zeros((0, self.model.shape.hidden), REAL), 0
        for k, (x, y, fresh, valid, _) in enumerate(walk(texts, begin, slots, steps)):
            h = h[:x.shape[1]] if len(h) else np.zeros((x.shape[1], self.model.shape.hidden), REAL)
            if k % share == 0:
                grads, h = self.model.slopes(x, y, fresh, valid, h, slots * steps)   # a window with few texts left moves little
                self.step(grads)
                seen += int(valid.sum())
            else:
                h = self.model.read(x, fresh, h)[-1]
        return seen
