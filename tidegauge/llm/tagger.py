"""A character tagger in numpy: bidirectional LSTM, linear-chain CRF on top, trained by Adam.

Texts are windows of characters, in training filled up with the number 0. Tags are
"outside" and, for each kind of span, its first and its further characters.

The network reads every character of every window. Only the chain's steps from tag to
tag are left out, where they can change nothing: where "outside" leads so far at each
place that no other tags can make up for it, it is the best path all through.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from numpy.lib.introspect import opt_func_info

FORBIDDEN = -1e4
#: Windows read at a time, and windows whose best tags are sought at a time.
READ, DECODED = 768, 256


def tags_of(spans: list[tuple[int, int, int]], length: int) -> np.ndarray:
    """Tags of a window from its spans ``start, kind, end``, which don't overlap."""
    tags = np.zeros(length, np.int64)
    for start, kind, end in spans:
        tags[start:end] = 2 + 2 * kind
        tags[start] -= 1
    return tags


def spans_of(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """``start, kind, end, confidence`` of a window's spans; a span is as sure as its least sure character."""
    found = []
    for start in np.flatnonzero(tags % 2 == 1).tolist():
        end = start + 1
        while end < len(tags) and tags[end] == tags[start] + 1:
            end += 1
        found.append((start, int(tags[start]) // 2, end, float(sure[start:end].min())))
    return found


def ending(lengths: np.ndarray) -> np.ndarray:
    """Of windows sorted by length, longest first: how many have place 0, 1, ..."""
    return np.searchsorted(-lengths, -np.arange(lengths[0]), "left")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@lru_cache(maxsize=1)
def tanh_is_cheap() -> bool:
    """Whether numpy's tanh costs no more than its exp: so it is with AVX-512, with AVX2 it costs twice that."""
    return any("AVX512" in own["current"] for own in opt_func_info("^tanh$", "float32").get("tanh", {}).values())


# Both take a step in place, from the sums ``z`` at the four gates. In ``z`` are ``gates`` (in ``show``
# the output's, in ``into`` the input's and the forget gate's), then ``new``, the candidate; ``pair`` is that and the cell ``c``.


def _by_tanh(z, gates, show, into, pair, new, c, h) -> None:
    """A sigmoid of x is half of 1 + tanh(x / 2). ``h`` holds twice the state."""
    np.tanh(z, out=z)
    gates += 1
    pair *= into
    c += new
    c *= 0.5
    np.tanh(c, out=new)
    np.multiply(new, show, out=h)


def _by_exp(z, gates, show, into, pair, new, c, h) -> None:
    """A sigmoid of x is 1 / (1 + exp(-x)), tanh of x twice the sigmoid of 2 x, less one. ``h`` holds half the state, ``c`` the cell times -2."""
    np.exp(z, out=z)
    z += 1
    np.divide(1, gates, out=gates)
    np.divide(-4, new, out=new)
    new += 2
    pair *= into
    c += new
    np.exp(c, out=new)
    new += 1
    np.divide(1, new, out=new)
    new -= 0.5
    np.multiply(new, show, out=h)


def _buffer(shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
    """An array that begins where a line of the cache does."""
    size = int(np.prod(shape)) * kind.itemsize
    raw = np.empty(size + 64, np.uint8)
    start = -raw.ctypes.data % 64
    return raw[start:start + size].view(kind).reshape(shape)


class Tagger:
    """Weights are in ``self.w``: axis 0 of the LSTM's is the direction of reading."""

    def __init__(self, characters: int, kinds: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.hidden, self.n_tags = hidden, 1 + 2 * kinds
        scale = 1 / np.sqrt(hidden)
        self.w = {
            "input": rng.normal(0, 0.3, (2, characters, 4 * hidden)),
            "state": rng.normal(0, scale, (2, hidden, 4 * hidden)),
            # Input, forget, output, candidate; cells remember at first.
            "bias": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], hidden), (2, 1)),
            "out": rng.normal(0, scale, (2 * hidden, self.n_tags)),
            "out_bias": np.zeros(self.n_tags),
            "step": np.zeros((self.n_tags, self.n_tags)),
            "first": np.zeros(self.n_tags),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        tag = np.arange(self.n_tags)
        inside = (tag > 0) & (tag % 2 == 0)
        # The further characters of a kind follow its first or further ones only.
        self.step_mask = np.where(inside[None, :] & ~((tag[:, None] == tag[None, :]) | (tag[:, None] == tag[None, :] - 1)), FORBIDDEN, 0).astype(np.float32)
        self.first_mask = np.where(inside, FORBIDDEN, 0).astype(np.float32)

    # -- the network ---------------------------------------------------------------

    def _read(self, chars: np.ndarray):
        """Emissions (window, place, tag), and what backpropagation needs."""
        w, size = self.w, self.hidden
        both = np.stack([chars, chars[:, ::-1]])
        n, length = chars.shape
        h = np.zeros((2, n, size), w["state"].dtype)
        c = np.zeros_like(h)
        states = np.empty((length, 2, n, size), h.dtype)
        saved = []
        side = np.arange(2)[:, None]
        for t in range(length):
            z = w["input"][side, both[:, :, t]] + w["bias"][:, None] + h @ w["state"]
            gates, candidate = _sigmoid(z[..., :3 * size]), np.tanh(z[..., 3 * size:])
            before, old = h, c
            c = gates[..., size:2 * size] * c + gates[..., :size] * candidate
            squashed = np.tanh(c)
            h = gates[..., 2 * size:] * squashed
            states[t] = h
            saved.append((before, old, gates, candidate, squashed))
        seen = np.concatenate([states[:, 0], states[::-1, 1]], 2)
        emissions = (seen @ w["out"] + w["out_bias"]).transpose(1, 0, 2)
        return emissions, (both, seen, saved)

    def _leads(self, chars: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Emissions (place, tag, window) less those of "outside": of all first characters' tags, then of all further ones'.

        ``chars`` is (place, window). Windows are sorted by length, longest first: the first
        ``active[t]`` have a place t, and other values there mean nothing. Steps are taken by
        tanh or by exp, whichever is cheaper here; weights take the signs and factors.
        """
        w, size = self.w, self.hidden
        kind = w["state"].dtype
        order = np.r_[1:self.n_tags:2, 2:self.n_tags:2]
        step, inner, state_by = (_by_tanh, 0.5, 0.5) if tanh_is_cheap() else (_by_exp, -1.0, 2.0)
        inner = np.repeat([inner, inner, inner, 2 * inner], size)

        def by_gate(weights: np.ndarray) -> np.ndarray:
            """Output, input, forget, candidate: next to each other are what is multiplied together."""
            return np.ascontiguousarray(weights.reshape(-1, 4, size)[:, [2, 0, 1, 3]].transpose(1, 0, 2), kind)

        length, n = chars.shape
        found = np.zeros((length, self.n_tags - 1, n), kind)
        found += (w["out_bias"][order] - w["out_bias"][0])[:, None].astype(kind)
        # Buffers are used again at each place, and each gate is a block of its own: strided steps cost more than the sums.
        xs, zs, hs, more = (_buffer(shape, kind) for shape in ((4 * n * size,), (5, n, size), (n, size), (n, self.n_tags - 1)))
        for side in range(2):
            table, state = by_gate((w["input"][side] + w["bias"][side]) * inner), by_gate(w["state"][side] * inner * state_by)
            out = w["out"][side * size:(side + 1) * size]
            out = np.ascontiguousarray((out[:, order] - out[:, :1]) * state_by, kind)
            # The cells are the last block.
            hs[:], zs[4] = 0, 0
            m = 0
            # Where exp is beyond all numbers, one by it is 0, as it should be.
            with np.errstate(over="ignore"):
                for t in range(length) if side == 0 else range(length - 1, -1, -1):
                    if m != active[t]:
                        m = active[t]
                        x, z, h, part = xs[:4 * m * size].reshape(4, m, size), zs[:4, :m], hs[:m], more[:m]
                        parts = z, z[:3], z[0], z[1:3], zs[3:, :m], z[3], zs[4, :m], h
                    np.take(table, chars[t, :m], 1, out=x, mode="clip")
                    np.matmul(h, state, out=z)
                    z += x
                    step(*parts)
                    found[t, :, :m] += np.matmul(h, out, out=part).T
        return found

    def _back(self, d_emissions: np.ndarray, memory) -> dict[str, np.ndarray]:
        both, seen, saved = memory
        w, size = self.w, self.hidden
        d_out = d_emissions.transpose(1, 0, 2)
        length, n = d_out.shape[:2]
        d = {k: np.zeros_like(v) for k, v in w.items()}
        d["out"] = np.einsum("tnh,tnk->hk", seen, d_out, optimize=True)
        d["out_bias"] = d_out.sum((0, 1))
        d_seen = d_out @ w["out"].T
        # As the states were: the second direction read from the end.
        d_states = np.stack([d_seen[..., :size], d_seen[::-1, :, size:]], 1)
        dh, dc = np.zeros((2, n, size), d_out.dtype), np.zeros((2, n, size), d_out.dtype)
        turned = w["state"].transpose(0, 2, 1)
        d_z = np.empty((length, 2, n, 4 * size), d_out.dtype)
        for t in range(length - 1, -1, -1):
            before, old, gates, candidate, squashed = saved[t]
            i, f, o = (gates[..., k * size:(k + 1) * size] for k in range(3))
            dh = dh + d_states[t]
            dc = dc + dh * o * (1 - squashed * squashed)
            dz = d_z[t]
            dz[..., :size] = dc * candidate * i * (1 - i)
            dz[..., size:2 * size] = dc * old * f * (1 - f)
            dz[..., 2 * size:3 * size] = dh * squashed * o * (1 - o)
            dz[..., 3 * size:] = dc * i * (1 - candidate * candidate)
            d["state"] += before.transpose(0, 2, 1) @ dz
            dh, dc = dz @ turned, dc * f
        d["bias"] = d_z.sum((0, 2))
        for side in range(2):
            read = both[side].T.ravel()
            order = np.argsort(read, kind="stable")
            start = np.flatnonzero(np.diff(read[order], prepend=-1))
            d["input"][side][read[order[start]]] = np.add.reduceat(d_z[:, side].reshape(-1, 4 * size)[order], start)
        return d

    # -- the chain -----------------------------------------------------------------

    def _forward_backward(self, emissions: np.ndarray, active: np.ndarray | None = None):
        """Log partition, probability of every tag, and expected number of every step between tags.

        Chances are scaled at each place to add up to one, so products don't vanish. With
        ``active`` as in `_leads`, windows end where they end; then only the
        probabilities at their own places count.
        """
        step, first = np.exp(self.w["step"] + self.step_mask), np.exp(self.w["first"] + self.first_mask)
        n, length, k = emissions.shape
        top = emissions.max(2, keepdims=True)
        likely = np.exp(emissions - top).transpose(1, 0, 2)
        active = np.full(length, n) if active is None else active
        ahead, behind, scale = np.zeros_like(likely), np.ones_like(likely), np.ones((length, n, 1), likely.dtype)
        for t in range(length):
            m = active[t]
            now = likely[t, :m] * (ahead[t - 1, :m] @ step if t else first)
            scale[t, :m] = now.sum(1, keepdims=True)
            ahead[t, :m] = now / scale[t, :m]
        turned = step.T.copy()
        for t in range(length - 2, -1, -1):
            m = active[t + 1]
            behind[t, :m] = (likely[t + 1, :m] * behind[t + 1, :m] / scale[t + 1, :m]) @ turned
        total = np.log(scale[:, :, 0]).sum(0) + top[:, :, 0].sum(1)
        left = ahead[:-1].reshape(-1, k)
        right = (likely[1:] * behind[1:] / scale[1:]).reshape(-1, k)
        return total, (ahead * behind).transpose(1, 0, 2), step * (left.T @ right)

    def loss(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        emissions, memory = self._read(chars)
        step, first = self.w["step"] + self.step_mask, self.w["first"] + self.first_mask
        total, chance, steps = self._forward_backward(emissions)
        n, length, _ = emissions.shape
        rows, places = np.arange(n)[:, None], np.arange(length)[None]
        score = emissions[rows, places, tags].sum(1) + first[tags[:, 0]] + step[tags[:, :-1], tags[:, 1:]].sum(1)
        taken = np.zeros_like(emissions)
        taken[rows, places, tags] = 1
        d = self._back((chance - taken) / n, memory)
        d_step = steps
        np.add.at(d_step, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        d["step"], d["first"] = d_step / n, (chance[:, 0] - taken[:, 0]).sum(0) / n
        return float((total - score).mean()), d

    def _outside(self, leads: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Whether "outside" is surely the best path of a window all through.

        What a span gains over "outside" is at most the leads of its places and the best of
        its steps: into its first character, on, and out or to a next span. These sums are
        followed from the end; if no span gains, no path with spans does.
        """
        step, first = self.w["step"] + self.step_mask, self.w["first"] + self.first_mask
        kinds, kind = self.n_tags // 2, leads.dtype
        begins, inside = np.arange(1, self.n_tags, 2), np.arange(2, self.n_tags, 2)
        gain = step - step[0, 0]
        enter = np.maximum(gain[0, begins], first[begins] - first[0])
        further = np.maximum(gain[begins, inside], gain[inside, inside])
        leave = np.maximum(gain[begins, 0], gain[inside, 0])
        leave = np.maximum(leave, np.maximum((gain[begins][:, begins] - enter).max(1), (gain[inside][:, begins] - enter).max(1)))
        enter, further, leave = (x[:, None].astype(kind) for x in (enter, further, leave))
        # The most that can follow a place; nothing after a window's last one.
        after = np.zeros((kinds, leads.shape[2]), kind)
        spare, most = np.empty_like(after), np.full_like(after, -np.inf)
        for t in range(len(leads) - 1, -1, -1):
            m = active[t]
            ahead = after[:, :m]
            begun = np.add(leads[t, :kinds, :m], ahead, out=spare[:, :m])
            np.maximum(most[:, :m], begun, out=most[:, :m])
            ahead += leads[t, kinds:, :m]
            ahead += further
            np.maximum(ahead, leave, out=ahead)
        # A little to spare for rounding.
        return (most + enter).max(0) < -1e-2

    def _emissions(self, leads: np.ndarray) -> np.ndarray:
        """Emissions (place, window, tag) up to what all tags of a place have in common."""
        emissions = np.zeros((len(leads), leads.shape[2], self.n_tags), leads.dtype)
        emissions[..., 1::2] = leads[:, :self.n_tags // 2].transpose(0, 2, 1)
        emissions[..., 2::2] = leads[:, self.n_tags // 2:].transpose(0, 2, 1)
        return emissions

    def _best(self, emissions: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window (window, place), and how likely each of them is by itself."""
        step, first = self.w["step"] + self.step_mask, self.w["first"] + self.first_mask
        length, n, k = emissions.shape
        # By tag, then window. The steps back are looked for along the best path only.
        best = np.zeros((length, k, n), emissions.dtype)
        best[0] = (first + emissions[0]).T
        for t in range(1, length):
            m = active[t]
            best[t, :, :m] = (best[t - 1, :, None, :m] + step[:, :, None]).max(0) + emissions[t, :m].T
        path, tag = np.zeros((n, length), np.int64), np.zeros(n, np.int64)
        for t in range(length - 1, -1, -1):
            m, on = active[t], active[t + 1] if t + 1 < length else 0
            tag[:on] = (best[t, :, :on] + step[:, tag[:on]]).argmax(0)
            tag[on:m] = best[t, :, on:m].argmax(0)
            path[:m, t] = tag[:m]
        _, chance, _ = self._forward_backward(emissions.transpose(1, 0, 2), active)
        return path, np.take_along_axis(chance, path[:, :, None], 2)[:, :, 0]

    def decode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window, and how likely each of them is by itself."""
        made = []
        for at in range(0, len(chars), DECODED):
            some = np.ascontiguousarray(chars[at:at + DECODED].T)
            active = np.full(len(some), some.shape[1])
            made.append(self._best(self._emissions(self._leads(some, active)), active))
        return np.concatenate([tags for tags, _ in made]), np.concatenate([sure for _, sure in made])

    def spans(self, windows: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
        """`spans_of` every window, whatever its length; a window's spans don't hang on the others."""
        found: list[list] = [[] for _ in windows]
        order = sorted((i for i, w in enumerate(windows) if len(w)), key=lambda i: -len(windows[i]))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            rows = np.concatenate([r for r, _ in held])
            lengths = np.array([len(windows[i]) for i in rows])
            emissions = np.zeros((lengths[0], len(rows), self.n_tags), held[0][1].dtype)
            at = 0
            for r, leads in held:
                emissions[:len(leads), at:at + len(r)] = self._emissions(leads[:lengths[0]])
                at += len(r)
            held.clear()
            for i, length, tags, sure in zip(rows, lengths, *self._best(emissions, ending(lengths))):
                found[i] = spans_of(tags[:length], sure[:length])

        for at in range(0, len(order), READ):
            some = np.array(order[at:at + READ])
            lengths = np.array([len(windows[i]) for i in some])
            chars = np.zeros((len(some), lengths[0]), np.uint8)
            for row, i in zip(chars, some):
                row[:len(windows[i])] = windows[i]
            active = ending(lengths)
            leads = self._leads(np.ascontiguousarray(chars.T, np.intp), active)
            left = np.flatnonzero(~self._outside(leads, active))
            # Few windows have spans: they are gathered, as a place costs about the same for one as for many.
            for k in range(0, len(left), DECODED):
                held.append((some[left[k:k + DECODED]], leads[:, :, left[k:k + DECODED]]))
                if sum(len(r) for r, _ in held) >= DECODED:
                    settle()
        if held:
            settle()
        return found

    # -- training ------------------------------------------------------------------

    def fit(self, chars: np.ndarray, tags: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> list[float]:
        """So many steps of Adam over shuffled windows, the rate falling to a tenth; returns the losses."""
        rng = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        losses, order = [], np.empty(0, np.int64)
        for k in range(1, steps + 1):
            if len(order) < min(batch, len(chars)):
                order = rng.permutation(len(chars))
            some, order = order[:batch], order[batch:]
            loss, grads = self.loss(chars[some], tags[some])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for name, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.999 * square[name] + 0.001 * g * g
                up = mean[name] / (1 - 0.9**k) / (np.sqrt(square[name] / (1 - 0.999**k)) + 1e-8)
                self.w[name] -= (rate * 0.1 ** (k / steps) * up).astype(g.dtype)
        return losses
