"""A causal self-attention model of the next class, in numpy.

Every class has an embedding as query, key, value and input of the hidden layer
(one table, ``t``). A text is cut into blocks of BLOCK inputs; the queries of a
block meet the keys of the block before and of its own, so windows overlap and
each token has the 16 to 31 inputs before it in sight and is scored once. Keys
behind the query, and those of another text, are masked. What attention brings
together, and the last input, make the hidden layer; from it come the next
class's group and, within the group, the class (a softmax of two levels). One
more input of both is how often each class followed the last one in all training
texts, as smoothed logarithms, with weights of their own.

Everything is trained by gradient descent: embeddings, offsets by distance,
hidden layer, outputs and the weights of the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

CLASSES = 1024
END = CLASSES - 1
#: Only inputs: the start of a text, and what fills its last block.
START, PAD, INPUTS = CLASSES, CLASSES + 1, CLASSES + 2
#: Inputs in a block and in sight of it; widths of attention and of the hidden layer.
BLOCK, WIDTH, HIDDEN = 16, 16, 32
SIGHT = 2 * BLOCK
_SCALE = 1 / math.sqrt(WIDTH)
GROUPS = 32
SIZE = CLASSES // GROUPS
#: Weight of all classes' shares beside the followers of one.
SMOOTH = 20.0
#: Tokens in a step of training; tokens worked on at a time, few enough to stay in a core's cache.
STEP, CHUNK = 1 << 13, 1 << 12

Params = dict[str, np.ndarray]
SHAPES = {"t": (INPUTS, 3 * WIDTH + HIDDEN), "near": (SIGHT,), "z": (WIDTH, HIDDEN), "o": (HIDDEN, GROUPS), "ob": (GROUPS,), "m": (GROUPS, HIDDEN, SIZE), "mb": (GROUPS, SIZE), "g": (2,)}

#: How far a key lies before a query, from 0 for the query's own input.
_APART = np.arange(BLOCK)[:, None] + BLOCK - np.arange(SIGHT)[None, :]
_SEEN = (_APART >= 0) & (_APART < SIGHT)
_APART = np.clip(_APART, 0, SIGHT - 1)


def start_params(seed: int = 5) -> Params:
    rng = np.random.default_rng(seed)
    spread = {"t": 0.3, "z": 0.3, "o": 0.02, "m": 0.02}
    params = {k: (rng.standard_normal(s) * spread.get(k, 0)).astype(np.float32) for k, s in SHAPES.items()}
    params["near"] += np.float32(-0.1) * np.arange(SIGHT, dtype=np.float32)
    params["g"] += 1
    return params


def flat(params: Params) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in SHAPES]).astype(np.float64)


def unflat(values: np.ndarray) -> Params:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = math.prod(s)
        out[k] = values[at : at + n].reshape(s).astype(np.float32, copy=False)
        at += n
    return out


def blocks(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, goes_on): the texts' classes (END last) in blocks, each
    text from a block of its own. The input of a target is the class before it,
    START for the first. Where the last block isn't full, inputs are PAD and
    targets -1. ``goes_on``: the block before is of the same text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    count = -(-sizes // BLOCK)
    first = (np.cumsum(count) - count) * BLOCK
    n = int(count.sum())
    inputs, targets = np.full(n * BLOCK, PAD, dtype=np.int32), np.full(n * BLOCK, -1, dtype=np.int32)
    at = np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    if n:
        targets[at] = np.concatenate(texts)
        inputs[at[1:]] = targets[at[:-1]]
        inputs[first] = START
    goes_on = np.ones(n, dtype=bool)
    goes_on[first // BLOCK] = False
    return inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK), goes_on


def portions(x: np.ndarray, y: np.ndarray, goes_on: np.ndarray, tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of about so many tokens at a time. A portion that begins inside a
    text has the block before in front, without targets."""
    step = max(1, tokens // BLOCK)
    for a in range(0, len(x), step):
        lead = int(goes_on[a])
        part = slice(a - lead, a + step)
        own, after = y[part], goes_on[part].copy()
        after[0] = False
        if lead:
            own = own.copy()
            own[0] = -1
        yield x[part], own, after


class Followers:
    """What followed each input in all training texts, as smoothed logarithms:
    of the groups, and of the classes within their group."""

    def __init__(self, counts: np.ndarray):
        shares = counts.sum(axis=0) + 0.5
        self.spare = SMOOTH * shares / shares.sum()
        self.counts = counts.astype(np.float32)
        mass = (counts + self.spare).reshape(INPUTS, GROUPS, SIZE)
        groups = mass.sum(axis=2)
        self.mass, self.whole = groups, groups.sum(axis=1)
        self.group = np.log(groups / groups.sum(axis=1, keepdims=True)).astype(np.float32)
        self.member = np.log(mass / groups[:, :, None]).astype(np.float32)

    def without(self, x: np.ndarray, group: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithms of the target's own group and place in it, if the
        target itself weren't counted."""
        whole = self.whole[x]
        mine, y = self.mass[x, group], group * SIZE + member
        own = np.maximum(self.counts[x, y] - 1, 0) + self.spare[y]
        return np.log((np.maximum(mine - 1, 1e-3) / whole).astype(np.float32)), np.log((own / mine).astype(np.float32))


class Net:
    """The model with its parameters."""

    def __init__(self, params: Params, followers: Followers):
        self.p, self.followers = params, followers

    def logs(self, x: np.ndarray, y: np.ndarray, goes_on: np.ndarray, tokens: int = CHUNK) -> np.ndarray:
        """Natural log-probabilities of all targets, in order."""
        found, weights = [np.zeros(0, dtype=np.float32)], self._weights()
        for part in portions(x, y, goes_on, tokens):
            s = self._forward(*part, weights)
            found.append(np.empty_like(s["log"]))
            found[-1][s["order"]] = s["log"]
        return np.concatenate(found)

    def _weights(self) -> np.ndarray:
        """For each group what leads from the hidden layer, and from a one behind
        it, to all groups and to the group's classes."""
        p = self.p
        w = np.empty((GROUPS, HIDDEN + 1, GROUPS + SIZE), dtype=p["m"].dtype)
        w[:, :HIDDEN, :GROUPS], w[:, HIDDEN, :GROUPS] = p["o"], p["ob"]
        w[:, :HIDDEN, GROUPS:], w[:, HIDDEN, GROUPS:] = p["m"], p["mb"]
        return w

    def _attend(self, x: np.ndarray, goes_on: np.ndarray) -> dict:
        """``a``: the weights of what is in sight, not yet divided by their sums
        (``inverse``: one by these)."""
        p = self.p
        rows = np.take(p["t"], x, axis=0)
        q = rows[..., :WIDTH] * _SCALE
        keys, values = (_sights(rows[..., i * WIDTH : (i + 1) * WIDTH]) for i in (1, 2))
        a = q @ keys.transpose(0, 2, 1)
        a += np.where(_SEEN, p["near"][_APART], -1e9).astype(a.dtype)
        a[~goes_on, :, :BLOCK] = -1e9
        inverse = 1 / _exponentials(a, np.einsum("nii->ni", a[:, :, BLOCK:]))[0]
        z = a @ values
        z *= inverse[..., None]
        return {"rows": rows, "keys": keys, "values": values, "a": a, "inverse": inverse, "z": z}

    def _forward(self, x: np.ndarray, y: np.ndarray, goes_on: np.ndarray, weights: np.ndarray, own: bool = False) -> dict:
        """All that is worked out on the way to the targets' log-probabilities,
        the targets in ``order`` by group; with ``own`` a target isn't counted
        among what follows its input."""
        s = self._attend(x, goes_on)
        at = np.flatnonzero(y >= 0)
        group, member = np.divmod(y.ravel()[at], SIZE)
        order = np.argsort(group.astype(np.uint8), kind="stable")
        at, group, member = at[order], group[order], member[order]
        cuts = np.r_[0, np.cumsum(np.bincount(group, minlength=GROUPS))]
        last, n, every = x.ravel()[at], len(at), np.arange(len(at))
        z = np.take(s["z"].reshape(-1, WIDTH), at, axis=0)
        act = np.ones((n, HIDDEN + 1), dtype=z.dtype)
        hidden = z @ self.p["z"]
        hidden += s["rows"].reshape(-1, 3 * WIDTH + HIDDEN)[:, 3 * WIDTH :][at]
        np.maximum(hidden, 0, out=act[:, :HIDDEN])
        said = np.empty((n, GROUPS + SIZE), dtype=z.dtype)
        said[:, :GROUPS] = np.take(self.followers.group, last, axis=0)
        said[:, GROUPS:] = np.take(self.followers.member.reshape(-1, SIZE), last * GROUPS + group, axis=0)
        if own:
            said[every, group], said[every, GROUPS + member] = self.followers.without(last, group, member)
        both = said * np.repeat(self.p["g"], (GROUPS, SIZE))
        for k in range(GROUPS):
            part = slice(cuts[k], cuts[k + 1])
            both[part] += act[part] @ weights[k]
        logits = both.reshape(n, 2, SIZE)
        chosen = np.stack([both[every, group], both[every, GROUPS + member]], axis=1)
        total, less = _exponentials(logits, chosen)
        log = (chosen - less - np.log(total)).sum(axis=1)
        return s | {"at": at, "order": order, "cuts": cuts, "group": group, "member": member, "mine": z, "act": act, "said": said, "both": both, "total": total, "log": log}

    def gradients(self, x: np.ndarray, y: np.ndarray, goes_on: np.ndarray, tokens: int = CHUNK) -> tuple[float, Params]:
        """The mean loss of some blocks, and its gradients, formed for so many
        tokens at a time."""
        n, loss, grad, weights = int((y >= 0).sum()), 0.0, {}, self._weights()
        for part in portions(x, y, goes_on, tokens):
            s = self._forward(*part, weights, own=True)
            loss -= float(s["log"].sum())
            for k, d in self._backward(part[0], s, weights, n).items():
                if k in grad:
                    grad[k] += d
                else:
                    grad[k] = d
        return loss / n, grad

    def _backward(self, x: np.ndarray, s: dict, weights: np.ndarray, n: int) -> Params:
        """What a portion's losses, divided by ``n``, add to the gradients."""
        p, both, act, at = self.p, s["both"], s["act"], s["at"]
        every = np.arange(len(at))
        parts = both.reshape(-1, 2, SIZE)  # exponentials, then probabilities less the targets' ones
        parts *= (1 / (n * s["total"]))[..., None]
        both[every, s["group"]] -= 1 / n
        both[every, GROUPS + s["member"]] -= 1 / n
        steps, hidden = np.empty_like(weights), np.empty((len(at), HIDDEN), dtype=act.dtype)
        for k in range(GROUPS):
            part = slice(s["cuts"][k], s["cuts"][k + 1])
            np.matmul(act[part].T, both[part], out=steps[k])
            np.matmul(both[part], weights[k, :HIDDEN].T, out=hidden[part])
        hidden *= act[:, :HIDDEN] > 0
        said = np.multiply(s["said"], both, out=s["said"])
        gains = np.ones(len(at), dtype=said.dtype) @ said
        outer = steps[:, :, :GROUPS].sum(axis=0)
        grad = {"o": outer[:HIDDEN], "ob": outer[HIDDEN], "m": steps[:, :HIDDEN, GROUPS:].copy(), "mb": steps[:, HIDDEN, GROUPS:].copy()}
        grad |= {"g": np.array([gains[:GROUPS].sum(), gains[GROUPS:].sum()]), "z": s["mine"].T @ hidden}
        z = np.zeros_like(s["z"])
        z.reshape(-1, WIDTH)[at] = hidden @ p["z"].T
        rows = np.zeros_like(s["rows"])
        rows.reshape(-1, rows.shape[-1])[at, 3 * WIDTH :] = hidden
        a, inverse = s["a"], s["inverse"][..., None]
        mean = np.einsum("nij,nij->ni", z, s["z"])[..., None] * inverse
        z *= inverse
        values = a.transpose(0, 2, 1) @ z
        z *= _SCALE
        mean *= _SCALE
        d = z @ s["values"].transpose(0, 2, 1)
        d -= mean
        d *= a
        grad["near"] = np.bincount(_APART[_SEEN], weights=d.sum(axis=0)[_SEEN], minlength=SIGHT) / _SCALE
        keys = d.transpose(0, 2, 1) @ s["rows"][..., :WIDTH]
        rows[..., :WIDTH] = d @ s["keys"]
        for i, sight in ((1, keys), (2, values)):
            sight[:-1, BLOCK:] += sight[1:, :BLOCK]
            rows[..., i * WIDTH : (i + 1) * WIDTH] = sight[:, BLOCK:]
        order = np.argsort(x.ravel().astype(np.int16), kind="stable")
        sorted_x = x.ravel()[order]
        first = np.flatnonzero(np.r_[True, sorted_x[1:] != sorted_x[:-1]])
        grad["t"] = np.zeros_like(p["t"])
        grad["t"][sorted_x[first]] = np.add.reduceat(np.take(rows.reshape(-1, rows.shape[-1]), order, axis=0), first, axis=0)
        return grad


def _sights(own: np.ndarray) -> np.ndarray:
    """For each block the rows of the block before, and its own."""
    both = np.empty((len(own), SIGHT, WIDTH), dtype=own.dtype)
    both[:, BLOCK:], both[1:, :BLOCK], both[:1, :BLOCK] = own, own[:-1], 0
    return both


def _exponentials(logits: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Turns logits, of which each row holds at least one of ``some``, into
    exponentials, in place; the rows' sums, and what was taken from the logits
    before, so that no sum is too large or too small: each row's highest if they
    lie far apart, else nothing."""
    less = 0.0
    if logits.size and not (logits.max() < 40 and some.min() > -40):
        less = logits.max(axis=-1, keepdims=True)
        logits -= less
        less = less[..., 0]
    np.exp(logits, out=logits)
    flat_rows = logits.reshape(-1, logits.shape[-1])
    return (flat_rows @ np.ones(flat_rows.shape[1], dtype=logits.dtype)).reshape(logits.shape[:-1]), less


class Trainer:
    """Adam over steps of blocks; ``p``'s arrays are parts of one row of numbers."""

    def __init__(self, params: Params, followers: Followers, rate: float = 1.5e-2):
        self.row = flat(params).astype(np.float32)
        self.p = unflat(self.row)
        self.net, self.rate, self.steps, self.tokens, self.loss = Net(self.p, followers), rate, 0, 0, math.nan
        self.one, self.two = np.zeros_like(self.row), np.zeros_like(self.row)

    def step(self, x: np.ndarray, y: np.ndarray, goes_on: np.ndarray) -> None:
        self.loss, grad = self.net.gradients(x, y, goes_on)
        self.steps += 1
        self.tokens += int((y >= 0).sum())
        fix = math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        d = np.concatenate([grad[k].ravel().astype(np.float32, copy=False) for k in SHAPES])
        self.one += np.float32(0.1) * (d - self.one)
        d *= d
        d -= self.two
        d *= np.float32(0.01)
        self.two += d
        np.sqrt(self.two, out=d)
        d += np.float32(1e-8)
        np.divide(self.one, d, out=d)
        d *= np.float32(self.rate * fix)
        self.row -= d

    def fit(self, texts: list[np.ndarray], tokens: int = STEP) -> None:
        """One pass over all blocks of the texts."""
        for part in portions(*blocks(texts), tokens):
            if (part[1] >= 0).any():
                self.step(*part)
