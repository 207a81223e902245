"""A causal self-attention model over subword ids, in numpy.

One layer: masked attention over a window and a layer of rectified units, each added to its input. Every probability comes from that
layer's output by a softmax over classes of ids and one over the ids of a class; the OWN most frequent ids are the members of the classes, in order
of frequency, and the last class is all others, of which each has its share of that class's occurrences. So probabilities sum to one over the
vocabulary. A text is cut into windows of WINDOW ids that overlap by CONTEXT; each id is scored once, in the window where it has the longest context.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

VOCABULARY = 50_257
EDGE = 50_256  # stands before and after each text
BEGIN, OUTSIDE = 65_534, 65_535  # in kept windows: the place before a text, and places beyond it
BITS = 6
CLASSES, MEMBERS = 64, 1 << BITS
OWN = CLASSES * MEMBERS
RARE, PAD = OWN, OWN + 1  # symbols of other ids, and of slots outside the text
WINDOW, CONTEXT, DIM, KEYS, UNITS = 20, 4, 32, 16, 64
STEP = WINDOW - CONTEXT
SHAPES = {
    "e": (OWN + 2, DIM), "pos": (WINDOW, DIM), "q": (DIM, KEYS), "kv": (DIM, KEYS + DIM), "in": (DIM, UNITS), "out": (UNITS, DIM),
    "o": (DIM, CLASSES + 1), "b": (CLASSES + 1,), "m": (CLASSES, DIM, MEMBERS), "mb": (CLASSES, MEMBERS),
}
SIZES = {k: int(np.prod(s)) for k, s in SHAPES.items()}
#: What the layer takes of a slot: its input, key and value, and query, side by side.
WIDE = DIM + KEYS + DIM + KEYS
INPUT, KEY, VALUE, QUERY = slice(0, DIM), slice(DIM, DIM + KEYS), slice(DIM + KEYS, WIDE - KEYS), slice(WIDE - KEYS, WIDE)
#: Windows whose outputs are scored at once, and rows of a softmax.
SCORED, ROWS = 2048, 2048
#: Adam: weights of the means, and the windows of a step.
FIRST, SECOND, BATCH = 0.9, 0.99, 256
#: Weights that Adam handles at once, which stay in a core's cache, and how often a symbol has to occur in a batch to be summed alone.
BLOCK, OFTEN = 1 << 14, 16
_CAUSAL = (np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)
_ONES = np.ones(WINDOW, np.float32)


def windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of n targets that follow each other: where each window's slots are, and which of them are inside its text."""
    k = -(-n // STEP)
    begin = np.cumsum(n) - n
    first = STEP * (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)) - CONTEXT
    at = first[:, None] + np.arange(WINDOW)
    inside = (at >= 0) & (at < np.repeat(n, k)[:, None])
    return np.where(inside, at + np.repeat(begin, k)[:, None], 0), inside


def before(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The id before each target; EDGE before the first of a text."""
    out = np.r_[EDGE, ids[:-1]]
    out[np.cumsum(n) - n] = EDGE
    return out


class Classes:
    """Symbols of ids, and the rare ids' shares, from how often each id occurs. Ties go to the lesser id."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.symbol = np.full(VOCABULARY, RARE, np.int16)
        self.symbol[order[:OWN]] = np.arange(OWN)
        rare = order[OWN:]
        self.share = np.zeros(VOCABULARY)
        self.share[rare] = np.log((counts[rare] + 0.5) / (counts[rare] + 0.5).sum())
        mass = np.r_[counts[order[:OWN]].reshape(CLASSES, MEMBERS).sum(axis=1), counts[rare].sum()] + 0.5
        self.bias = np.log(mass / mass.sum())
        self.members = np.log(counts[order[:OWN]].reshape(CLASSES, MEMBERS) + 0.5)


def start(c: Classes) -> dict[str, np.ndarray]:
    """The weights before training: the biases give the frequencies of classes and members."""
    rng = np.random.default_rng(7)
    w = {k: (rng.standard_normal(s) * (0.1 if k in ("e", "pos") else 0.02 if k in ("o", "m", "out") else DIM**-0.5)).astype(np.float32) for k, s in SHAPES.items()}
    w["b"], w["mb"] = c.bias.astype(np.float32), (c.members - c.members.mean(axis=1, keepdims=True)).astype(np.float32)
    return w


def pack(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def unpack(flat: np.ndarray) -> dict:
    return {k: x.astype(np.float32) for k, x in views(flat).items()}


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights in an array of pack()'s order, not copied."""
    ends = np.cumsum(list(SIZES.values()))
    return {k: flat[end - SIZES[k] : end].reshape(s) for (k, s), end in zip(SHAPES.items(), ends.tolist(), strict=True)}


def wide(w: dict, rows: np.ndarray) -> np.ndarray:
    """Inputs with their keys, values and queries. All are linear in the input, so those of a slot are those of its symbol and of its place, added."""
    return np.concatenate([rows, rows @ w["kv"], rows @ w["q"]], axis=1)


def hidden(w: dict, table: np.ndarray, places: np.ndarray, rows: np.ndarray, inside: np.ndarray) -> dict:
    """Masked attention and the units over a batch of windows, with all that the way back needs. table and places: wide() of symbols and of places; rows
    (of the table) and inside: windows by slots."""
    n = len(rows)
    x = np.take(table, rows, axis=0)
    x += places
    late = x[:, CONTEXT:]
    q, k, v = late[:, :, QUERY], x[:, :, KEY], x[:, :, VALUE]
    s = q @ k.transpose(0, 2, 1)
    np.minimum(s, np.float32(60), out=s)  # far above what occurs; exp does not overflow
    np.exp(s, out=s)
    s *= _CAUSAL
    s[np.flatnonzero(~inside[:, 0]), :, :CONTEXT] *= inside[~inside[:, 0], None, :CONTEXT]  # slots behind a text are masked by the order already
    total = s.reshape(-1, WINDOW) @ _ONES
    seen = (s @ v).reshape(-1, DIM)
    seen /= total[:, None]
    h = (seen.reshape(n, STEP, DIM) + late[:, :, INPUT]).reshape(-1, DIM)
    u = h @ w["in"]
    np.maximum(u, np.zeros_like(u), out=u)  # by an array: quicker than by a number
    y = u @ w["out"]
    y += h
    return {"q": q, "k": k, "v": v, "s": s, "total": total, "seen": seen, "h": h, "u": u, "y": y}


def _softmax(logits: Callable[[], np.ndarray], mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of the logits, up to a factor for each row, its sums, and the logarithm of the share at mine (places in the flat array). Logits are shifted by
    their largest only where the sums say that exp left what it can hold."""
    z = logits()
    own = z.ravel()[mine]
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    if len(z) and not (total.min() > 1e-30 and total.max() < np.inf):
        z = logits()
        z -= z.max(axis=1, keepdims=True)
        own = z.ravel()[mine]
        np.exp(z, out=z)
        total = z.sum(axis=1)
    return z, total, own - np.log(total)


def _by_class(symbols: np.ndarray) -> np.ndarray:
    return np.argsort((symbols >> BITS).astype(np.uint8), kind="stable")  # of small numbers: by counting


def _members(w: dict, y: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Logits of the members of each row's class; rows are in the order of classes."""
    z = np.empty((len(y), MEMBERS), y.dtype)
    for group, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            np.matmul(y[a:b], w["m"][group], out=z[a:b])
            z[a:b] += w["mb"][group]
    return z


def log_probability(w: dict, c: Classes, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The natural logarithm of each target's probability (ids of texts that follow each other, n of each)."""
    symbols, target, out = c.symbol[before(ids, n)], c.symbol[ids].astype(np.int64), np.zeros(len(ids))
    at, inside = windows(n)
    table, places = wide(w, w["e"]), wide(w, w["pos"])
    for a in range(0, len(at), SCORED):
        y, to = [], []
        for b in range(a, min(a + SCORED, len(at)), BATCH):
            p, ok = at[b : b + BATCH], inside[b : b + BATCH]
            good = np.flatnonzero(ok[:, CONTEXT:])
            to.append(p[:, CONTEXT:].ravel()[good])
            y.append(np.take(hidden(w, table, places, np.where(ok, symbols[p], PAD), ok)["y"], good, axis=0))
        y, to = np.concatenate(y), np.concatenate(to)
        mine = np.take(target, to)
        order = _by_class(mine)
        y, to, mine = np.take(y, order, axis=0), np.take(to, order), np.take(mine, order)
        for k in range(0, len(y), ROWS):
            out[to[k : k + ROWS]] = _chances(w, y[k : k + ROWS], mine[k : k + ROWS])
    return out + c.share[ids]


def _chances(w: dict, y: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities of symbols after outputs; rows are in the order of classes."""
    of, at = mine >> BITS, np.arange(len(y))
    cuts = np.searchsorted(of, np.arange(CLASSES + 1)).tolist()
    out, own = _softmax(lambda: y @ w["o"] + w["b"], at * (CLASSES + 1) + of)[2], cuts[-1]
    out[:own] += _softmax(lambda: _members(w, y[:own], cuts), at[:own] * MEMBERS + (mine[:own] & (MEMBERS - 1)))[2]
    return out


def _distinct(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct symbols, the most frequent ones first, how often each occurs, and which of them stands at each place."""
    n = np.bincount(symbols.ravel(), minlength=OWN + 2)
    some = np.flatnonzero(n)
    some = some[np.argsort(-n[some], kind="stable")]
    of = np.zeros(OWN + 2, np.int64)
    of[some] = np.arange(len(some))
    return some, n[some], of[symbols]


def _sums(x: np.ndarray, of: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sums of the rows of x for each number in `of`; n: how often each occurs, in descending order. Those that occur often are summed one by one,
    the others together, their first rows, then their second ones, and so on."""
    x, first = np.take(x, np.argsort(of.astype(np.uint16), kind="stable"), axis=0), np.cumsum(n) - n
    ends = np.searchsorted(-n, -np.arange(OFTEN)).tolist()  # how many occur more than 0, 1, 2 and so on times
    out, often = np.empty((len(n), x.shape[1]), x.dtype), ends[-1]
    ones = np.ones(int(n[0]), x.dtype)
    for k, (a, m) in enumerate(zip(first[:often].tolist(), n[:often].tolist(), strict=True)):
        np.matmul(ones[:m], x[a : a + m], out=out[k])
    out[often:] = x[first[often:]]
    for r, end in enumerate(ends[1:-1], 1):
        out[often:end] += x[first[often:end] + r]
    return out


def gradient(w: dict, symbols: np.ndarray, inside: np.ndarray, targets: np.ndarray, into: np.ndarray | None = None) -> tuple[dict, float]:
    """The gradient of the mean loss over the targets (symbols) of a batch of windows, and that loss. into: an array for it, in pack()'s order."""
    some, times, of = _distinct(symbols)
    rows = w["e"][some]
    n, f = len(symbols), hidden(w, wide(w, rows), wide(w, w["pos"]), of, inside)
    if into is None:
        into = np.empty(sum(SIZES.values()), rows.dtype)
    into.fill(0)
    g = views(into)
    good = np.flatnonzero(inside[:, CONTEXT:])
    mine = targets[:, CONTEXT:].ravel()[good].astype(np.int64)
    order = _by_class(mine)
    good, mine = good[order], mine[order]
    group, place, at, y, scale = mine >> BITS, mine & (MEMBERS - 1), np.arange(len(good)), f["y"][good], rows.dtype.type(1 / max(1, len(good)))
    cuts = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    own, ones = cuts[-1], np.ones(len(y), y.dtype)
    z, total, chance = _softmax(lambda: y @ w["o"] + w["b"], at * (CLASSES + 1) + group)
    loss = -chance.sum()
    z *= (scale / total)[:, None]
    z.ravel()[at * (CLASSES + 1) + group] -= scale
    np.matmul(y.T, z, out=g["o"])
    np.matmul(ones, z, out=g["b"])
    dy = z @ w["o"].T
    z, total, chance = _softmax(lambda: _members(w, y[:own], cuts), at[:own] * MEMBERS + place[:own])
    loss -= chance.sum()
    z *= (scale / total)[:, None]
    z.ravel()[at[:own] * MEMBERS + place[:own]] -= scale
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            np.matmul(y[a:b].T, z[a:b], out=g["m"][k])
            np.matmul(ones[a:b], z[a:b], out=g["mb"][k])
            dy[a:b] += z[a:b] @ w["m"][k].T
    dh = np.zeros_like(f["y"])
    dh[good] = dy
    np.matmul(f["u"].T, dh, out=g["out"])
    du = dh @ w["out"].T
    du *= f["u"] > 0
    np.matmul(f["h"].T, du, out=g["in"])
    dh += du @ w["in"].T
    per, s, dx = (dh / f["total"][:, None]).reshape(n, STEP, DIM), f["s"], np.zeros((n, WINDOW, WIDE), rows.dtype)
    late = dx[:, CONTEXT:]
    late[:, :, INPUT] = dh.reshape(n, STEP, DIM)
    np.matmul(s.transpose(0, 2, 1), per, out=dx[:, :, VALUE])
    ds = per @ f["v"].transpose(0, 2, 1)
    ds -= np.einsum("ij,ij->i", per.reshape(-1, DIM), f["seen"]).reshape(n, STEP, 1)
    ds *= s
    np.matmul(ds.transpose(0, 2, 1), f["q"], out=dx[:, :, KEY])
    np.matmul(ds, f["k"], out=late[:, :, QUERY])
    sums, places = _sums(dx.reshape(-1, WIDE), of.ravel(), times), (np.ones(n, dx.dtype) @ dx.reshape(n, -1)).reshape(WINDOW, WIDE)
    for name, where in (("kv", slice(KEY.start, VALUE.stop)), ("q", QUERY)):
        g[name][:] = rows.T @ sums[:, where] + w["pos"].T @ places[:, where]
    for name, at, part in (("e", some, sums), ("pos", slice(None), places)):
        g[name][at] = part[:, INPUT] + part[:, KEY.start : VALUE.stop] @ w["kv"].T + part[:, QUERY] @ w["q"].T
    return g, float(loss)


class Adam:
    """Steps of a copy of some weights. The means are kept without their factors, which are in the rate."""

    def __init__(self, w: dict):
        self.flat = pack(w)
        self.w, self.steps = views(self.flat), 0
        self.mean, self.square, self.slope, self.spare = np.zeros_like(self.flat), np.zeros_like(self.flat), np.empty_like(self.flat), np.empty(BLOCK, self.flat.dtype)

    def step(self, rate: float) -> None:
        """A step by the gradient in slope, which it overwrites."""
        self.steps += 1
        root = (1 - SECOND) ** 0.5
        rate *= (1 - SECOND**self.steps) ** 0.5 / (1 - FIRST**self.steps) * (1 - FIRST) / root
        for a in range(0, len(self.flat), BLOCK):
            w, g, m, v = (x[a : a + BLOCK] for x in (self.flat, self.slope, self.mean, self.square))
            t = self.spare[: len(w)]
            m *= np.float32(FIRST)
            m += g
            v *= np.float32(SECOND)
            np.multiply(g, g, out=g)
            v += g
            np.sqrt(v, out=t)
            t += np.float32(1e-7 / root)
            np.divide(m, t, out=t)
            t *= np.float32(rate)
            w -= t


def sequences(ids: np.ndarray, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Windows as they are kept for training: the id before the first slot, then the slots' targets; BEGIN before a text, OUTSIDE beyond its ends."""
    out = np.full((len(at), WINDOW + 1), OUTSIDE, np.uint16)
    out[:, 1:] = np.where(inside, ids[at], OUTSIDE)
    early = inside[:, 0]
    out[early, 0] = ids[np.maximum(at[early, 0] - 1, 0)]
    head = np.flatnonzero(~early)  # the first window of a text: its first slot inside is CONTEXT
    out[head, CONTEXT] = BEGIN
    return out


def fit(w: dict, c: Classes, kept: np.ndarray, rate: float) -> dict:
    """The weights after one pass over windows (of sequences()) in their order."""
    own = Adam(w)
    for a in range(0, len(kept), BATCH):
        part = kept[a : a + BATCH].astype(np.int64)
        inside = part[:, 1:] < BEGIN
        known = np.where(part < BEGIN, part, EDGE)
        gradient(own.w, np.where(inside, c.symbol[known[:, :-1]], PAD), inside, c.symbol[known[:, 1:]], own.slope)
        own.step(rate)
    return own.w
