"""A causal self-attention model in numpy: one block over windows of subword numbers, with its gradients.

A window has ``length`` places of which the last ``stride`` are scored, each once; the places before give context, and
places before the start of a text are masked. A place holds the symbol before the one that it predicts. The output is a
softmax in two levels: over classes of symbols, then over the symbols of the class.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class AttentionConfig:
    classes: int = 32
    width: int = 32  # symbols of a class
    dimension: int = 16
    hidden: int = 32
    length: int = 32
    stride: int = 24
    batch: int = 128  # windows at a time when scoring
    seed: int = 5

    @property
    def symbols(self) -> int:
        return self.classes * self.width


def initial(counts: np.ndarray, config: AttentionConfig) -> Weights:
    """Small random weights; the biases say what the counts of the symbols say."""
    rng = np.random.default_rng(config.seed)
    d, m = config.dimension, config.hidden

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    mass = (counts + 0.5).reshape(config.classes, config.width)
    own = mass.sum(axis=1)
    return {
        "embedding": normal(config.symbols + 1, d, scale=0.3), "place": normal(config.length, d, scale=0.1),
        "query": normal(d, d, scale=d**-0.5), "key": normal(d, d, scale=d**-0.5), "value": normal(d, d, scale=d**-0.5), "out": normal(d, d, scale=d**-0.5),
        "up": normal(d, m, scale=d**-0.5), "up_bias": np.zeros(m, np.float32), "down": normal(m, d, scale=0.5 * m**-0.5),
        "class": normal(d, config.classes, scale=0.1), "class_bias": np.log(own / own.sum()).astype(np.float32),
        "member": normal(config.classes, d, config.width, scale=0.1), "member_bias": np.log(mass / own[:, None]).astype(np.float32),
    }


def n_windows(lengths: np.ndarray, config: AttentionConfig) -> np.ndarray:
    """Windows up to and including those of each text."""
    return np.cumsum(-(-lengths // config.stride))


def windows(symbols: np.ndarray, lengths: np.ndarray, config: AttentionConfig, which: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts that lie one after the other in ``symbols``: the symbols at their places, what is to be predicted
    at the scored places, and the number of its text. ``which`` takes some of the windows.

    -1 stands before the start of a text (masked) and after its end (not scored). A text's first place holds the start.
    """
    length, stride = config.length, config.stride
    ends = n_windows(lengths, config)
    window = np.arange(ends[-1] if len(ends) else 0)[which]
    text = np.searchsorted(ends, window, side="right")
    begin = (window - np.concatenate([[0], ends])[text]) * stride  # of the scored places, within the text
    offset = np.cumsum(lengths) - lengths
    place = begin[:, None] + np.arange(stride - length, stride)
    inside = place < lengths[text][:, None]
    at = offset[text][:, None] + place
    # The symbol at a place is the one before it; the start is a symbol of its own.
    held = np.where(place > 0, symbols[np.where(inside & (place > 0), at - 1, 0)], config.symbols)
    held = np.where((place < 0) | ~inside, -1, held)
    scored = slice(length - stride, None)
    wanted = np.where(inside[:, scored], symbols[np.where(inside[:, scored], at[:, scored], 0)], -1)
    return held, wanted.astype(np.int32), text  # short numbers are divided faster


def exponentials(x: np.ndarray) -> np.ndarray:
    """In place. Logits beyond +-60 count as +-60, so that nothing overflows and no sum is 0."""
    return np.exp(np.clip(x, -60, 60, out=x), out=x)


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` as one product of matrices, however many axes ``x`` has."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[-1])


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums along the last axis, which is kept."""
    return (x @ np.ones(x.shape[-1], x.dtype))[..., None]


def _with_one(n: int, like: np.ndarray) -> np.ndarray:
    """Room for ``n`` rows as long as those of ``like`` and a last column of ones, which a product multiplies by a bias."""
    x = np.empty((n, like.shape[-1] + 1), like.dtype)
    x[:, -1] = 1
    return x


def _biased(w: Weights, name: str) -> np.ndarray:
    """Weights with the bias as their last row."""
    return np.concatenate([w[name], w[f"{name}_bias"][..., None, :]], axis=-2)


@cache
def _most(config: AttentionConfig, kind: np.dtype) -> np.ndarray:
    """The largest logit by scored place and seen place: nothing is left of one that the scored place does not see."""
    length, stride = config.length, config.stride
    return np.where(np.arange(length) <= np.arange(length - stride, length)[:, None], 60, -np.inf).astype(kind)


def _seen_exponentials(logits: np.ndarray, held: np.ndarray, config: AttentionConfig) -> np.ndarray:
    """In place, as ``exponentials``. A scored place sees itself and the places before it, none that is masked: those are 0."""
    np.maximum(logits, -60, out=logits)
    np.minimum(logits, _most(config, logits.dtype), out=logits)
    np.exp(logits, out=logits)
    some = np.flatnonzero(held[:, 0] < 0)  # masked places come first; no scored place sees those after a text's end
    if len(some):
        logits[some] *= (held[some] >= 0)[:, None, :]
    return logits


def _forward(w: Weights, held: np.ndarray, config: AttentionConfig) -> dict[str, np.ndarray]:
    """``query`` and ``key`` meet in one product of both, ``value`` and ``out`` in another: places are multiplied by neither alone.
    ``attention`` is not divided by its sums, what it has ``seen`` is. ``h1`` and ``h2`` have a column of ones."""
    tail, d = config.length - config.stride, config.dimension
    h0 = w["embedding"].take(held, axis=0, mode="wrap")  # -1 takes some row, which nobody sees
    h0 += w["place"]
    own = np.ascontiguousarray(h0[:, tail:])
    asked = times(own, w["query"] @ w["key"].T * np.float32(d**-0.5))
    attention = np.matmul(asked, h0.transpose(0, 2, 1))
    _seen_exponentials(attention, held, config)
    share = 1 / np.maximum(_sums(attention), np.float32(1e-30))
    seen = np.matmul(attention, h0)
    seen *= share
    h1 = _with_one(seen.shape[0] * seen.shape[1], seen)
    np.add(_flat(seen) @ (w["value"] @ w["out"]), _flat(own), out=h1[:, :d])
    up = h1 @ _biased(w, "up")
    np.maximum(up, 0, out=up)
    h2 = h1.copy()
    h2[:, :d] += up @ w["down"]
    return {"h0": h0, "own": own, "asked": asked, "attention": attention, "share": share, "seen": seen, "h1": h1, "up": up, "h2": h2}


def log_probabilities(w: Weights, held: np.ndarray, wanted: np.ndarray, config: AttentionConfig) -> np.ndarray:
    """Natural logarithm of the probability of each wanted symbol; 0 where nothing is wanted."""
    places = np.flatnonzero(wanted.ravel() >= 0)
    kind, member = np.divmod(wanted.ravel()[places], config.width)
    hidden, result = _with_one(len(places), w["class"].T), np.empty(len(places))
    classes, members = _biased(w, "class"), _biased(w, "member")
    scored = config.stride * config.batch
    ends = np.searchsorted(places, np.arange(0, wanted.size + scored, scored)).tolist()
    for k, start in enumerate(range(0, len(held), config.batch)):
        at = slice(ends[k], ends[k + 1])
        h = hidden[at]
        _forward(w, held[start : start + config.batch], config)["h2"].take(places[at] - k * scored, axis=0, out=h, mode="clip")
        result[at] = _chosen(h @ classes, kind[at])
    # The members of a class in all windows at once.
    order, spans = _class_spans(kind)
    hidden, member = hidden.take(order, axis=0), member[order]
    found = np.empty(len(places))
    for c, at in spans:
        found[at] = _chosen(hidden[at] @ members[c], member[at])
    result[order] += found
    every = np.zeros(wanted.shape)
    every.reshape(-1)[places] = result
    return every


def _chosen(logits: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Log probability of the chosen column of each row."""
    exponentials(logits)
    own = logits.reshape(-1).take(np.arange(len(choice)) * logits.shape[1] + choice)
    return np.log(own / (logits @ np.ones(logits.shape[1], logits.dtype)))


def _class_spans(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order of places by class, and where in it each class that occurs lies."""
    small = kind.astype(np.min_scalar_type(int(kind.max(initial=0))))  # small numbers are sorted by digits
    order = np.argsort(small, kind="stable")
    ends = np.cumsum(np.bincount(small)).tolist()
    return order, [(c, slice(a, b)) for c, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if a < b] if len(order) else []


def _slopes(logits: np.ndarray, choice: np.ndarray, n: int) -> float:
    """Negative log probability of the chosen columns; in place, its gradient by the logits, divided by ``n``."""
    at = np.arange(len(choice)) * logits.shape[1] + choice
    exponentials(logits)
    sums = _sums(logits)
    flat = logits.reshape(-1)
    loss = -np.log(flat.take(at).astype(np.float64) / sums[:, 0]).sum()
    logits *= 1 / (sums * n)
    flat[at] -= 1 / n
    return loss


def gradient(w: Weights, held: np.ndarray, wanted: np.ndarray, config: AttentionConfig, into: Weights | None = None) -> tuple[float, Weights]:
    """Mean negative log probability of the wanted symbols, and its gradient, which is written to ``into`` if it is given."""
    g = into or {name: np.empty_like(x) for name, x in w.items()}
    d, tail = config.dimension, config.length - config.stride
    f = _forward(w, held, config)
    h0, attention = f["h0"], f["attention"]
    # The scored places, sorted by class, so that the members of a class are one product of matrices and all else is done for all at once.
    places = np.flatnonzero(wanted.ravel() >= 0)
    n = max(len(places), 1)
    kind, member = np.divmod(wanted.ravel()[places], config.width)
    order, spans = _class_spans(kind)
    places, kind, member = places[order], kind[order], member[order]
    h = f["h2"].take(places, axis=0)

    slope = h @ _biased(w, "class")
    loss = _slopes(slope, kind, n)
    both = h.T @ slope
    g["class"][...], g["class_bias"][...] = both[:d], both[d]
    dh = slope @ w["class"].T
    biased, every = _biased(w, "member"), np.zeros((config.classes, d + 1, config.width), h.dtype)
    slope = np.empty((len(h), config.width), h.dtype)
    for c, at in spans:
        np.dot(h[at], biased[c], out=slope[at])
    loss += _slopes(slope, member, n)
    back, turned = np.empty_like(dh), w["member"].transpose(0, 2, 1)
    for c, at in spans:
        own = slope[at]
        np.dot(h[at].T, own, out=every[c])
        np.dot(own, turned[c], out=back[at])
    dh += back
    g["member"][...], g["member_bias"][...] = every[:, :d], every[:, d]

    dh2 = np.zeros((len(f["h2"]), d), dh.dtype)
    dh2[places] = dh
    dup = dh2 @ w["down"].T
    dup *= f["up"] > 0
    np.matmul(f["up"].T, dh2, out=g["down"])
    both = f["h1"].T @ dup
    g["up"][...], g["up_bias"][...] = both[:d], both[d]
    dh1 = dup @ w["up"].T
    dh1 += dh2
    # By the two products of weights, then by each factor.
    both = _flat(f["seen"]).T @ dh1
    np.matmul(both, w["out"].T, out=g["value"])
    np.matmul(w["value"].T, both, out=g["out"])
    dseen = (dh1 @ (w["value"] @ w["out"]).T).reshape(f["seen"].shape)
    dseen *= f["share"]
    da = np.matmul(dseen, h0.transpose(0, 2, 1))
    da -= _sums(dseen * f["seen"])
    da *= attention
    dasked = np.matmul(da, h0)
    both = _flat(f["own"]).T @ _flat(dasked) * np.float32(d**-0.5)
    np.matmul(both, w["key"], out=g["query"])
    np.matmul(both.T, w["query"], out=g["key"])
    dh0 = np.matmul(attention.transpose(0, 2, 1), dseen)  # 0 for places that nobody sees
    dh0 += np.matmul(da.transpose(0, 2, 1), f["asked"])
    dh1 += _flat(dasked) @ (w["key"] @ w["query"].T * np.float32(d**-0.5))
    dh0[:, tail:] += dh1.reshape(f["own"].shape)
    np.sum(dh0, axis=0, out=g["place"])
    g["embedding"][...] = 0
    np.add.at(g["embedding"].reshape(-1), (held.reshape(-1, 1) * d + np.arange(d)).ravel(), dh0.ravel())
    return loss / n, g


def step(state: Weights, g: Weights, turn: int, rate: float) -> None:
    """One step of adaptive moments, the ``turn``-th. The moments stand in ``state`` beside the weights, as ``m.`` and ``v.``."""
    rate *= (1 - 0.98**turn) ** 0.5 / (1 - 0.9**turn)
    for k, slope in g.items():
        m, v = state[f"m.{k}"], state[f"v.{k}"]
        part = slope - m
        part *= 0.1
        m += part
        np.multiply(slope, slope, out=part)
        part -= v
        part *= 0.02
        v += part
        np.sqrt(v, out=part)
        part += 1e-8
        np.divide(m, part, out=part)
        part *= rate
        state[k] -= part


def with_moments(w: Weights) -> Weights:
    return {**w, **{f"{kind}.{k}": np.zeros_like(x) for kind in "mv" for k, x in w.items()}}


def weights_of(state: Weights) -> Weights:
    return {k: x for k, x in state.items() if "." not in k}
