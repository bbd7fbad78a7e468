"""A small causal self-attention model in numpy.

Predicts the next token's class from the tokens before it in its window; the token within
its class follows the corpus counts.  Both factors are proper distributions, and so is their
product over all ids.
"""

from __future__ import annotations

import math

import numpy as np

#: Tokens of a window, how many of them only serve as context (but in a text's first
#: window), and sizes of the model.
LENGTH = 32
OVERLAP = 8
WIDTH = 16
CLASSES = 48
ROWS = 8192
OWN = 6144
#: Width of a random projection.
SKETCH = 32


class Vocabulary:
    """Rows, classes and probabilities of ids, from their counts and the rows' classes."""

    def __init__(self, counts: np.ndarray, classes: np.ndarray | None = None, smooth: float = 0.1) -> None:
        order = np.lexsort((np.arange(len(counts)), -counts))
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        # Frequent ids have an embedding of their own, others share one by remainder.
        self.row = np.where(rank < OWN, rank, OWN + rank % (ROWS - OWN)).astype(np.uint16)
        self.of = (np.zeros(ROWS) if classes is None else classes).astype(np.uint8)[self.row]
        total = np.bincount(self.of, weights=counts + smooth, minlength=CLASSES)
        #: log10 of the probability of an id in its class.
        self.within = np.log10((counts + smooth) / total[self.of])


def profiles(rows: np.ndarray, nexts: np.ndarray, real: np.ndarray) -> np.ndarray:
    """What stands around each row, ``[row, 2 * SKETCH + 1]``: random projections of
    the rows before and after it, summed, and how often it was met."""
    sketch = np.random.default_rng(9).normal(0, 1, (ROWS, SKETCH)).astype(np.float32)
    out = np.zeros((ROWS, 2 * SKETCH + 1), np.float32)
    # Each pair of neighbours once, with how often it was met.
    pairs, often = np.unique(rows[real].astype(np.int64) * ROWS + nexts[real], return_counts=True)
    one, two = pairs // ROWS, pairs % ROWS
    for which, other, at in ((two, one, 0), (one, two, SKETCH)):
        for d in range(SKETCH):
            out[:, at + d] = np.bincount(which, weights=often * sketch[:, d].astype(np.float64)[other], minlength=ROWS)
    out[:, -1] = np.bincount(two, weights=often, minlength=ROWS)
    return out


def cluster(profile: np.ndarray, turns: int = 20) -> np.ndarray:
    """Class of each row: k-means of what stands around it, rows weighing the root of their
    counts; rows hardly met go where the average does."""
    met = profile[:, -1]
    point = profile[:, :-1] / np.maximum(met, 1)[:, None]
    point /= np.sqrt((point**2).sum(axis=1, keepdims=True)) + 1e-6
    weight = np.sqrt(met)
    centre = point[np.argsort(-met, kind="stable")[:CLASSES]].copy()
    for _ in range(turns):
        near = np.argmax(point @ centre.T - (centre**2).sum(axis=1) / 2, axis=1)
        total = np.bincount(near, weights=weight, minlength=CLASSES)
        for d in range(point.shape[1]):
            moved = np.bincount(near, weights=weight * point[:, d], minlength=CLASSES)
            centre[:, d] = np.where(total > 0, moved / np.maximum(total, 1e-9), centre[:, d])
    return near


SHAPES = {
    "embed": (ROWS, WIDTH), "place": (LENGTH, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH),
    "o": (WIDTH, WIDTH), "out": (WIDTH, CLASSES), "bias": (CLASSES,),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parts of a flat array of parameters."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def fresh(seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = rng.normal(0, WIDTH**-0.5, SIZE).astype(np.float32)
    part = views(flat)
    part["embed"] *= 0.5
    part["place"] *= 0.2
    part["out"] *= 0.3
    part["bias"][:] = 0
    return flat


SCALE = np.float32(WIDTH**-0.5)
#: Logits are kept under this (in training also above its negative), so that exponentials
#: need no running maximum.
MOST = np.float32(60)
CAUSAL = np.tri(LENGTH, dtype=np.float32)


class Room:
    """Arrays that are used again step after step: fresh ones cost more than what is
    written into them."""

    def __init__(self, dtype: np.dtype = np.dtype(np.float32)) -> None:
        self.dtype, self.held = dtype, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, self.dtype)
        return self.held[name][:size].reshape(shape)

    def ones(self, size: int) -> np.ndarray:
        found = self("ones", size)
        found[:] = 1
        return found


def _made(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Products of parameters that a window meets together: attention's logits are
    ``x pair x'`` and what it adds is ``a x carry``, so no keys and values are made."""
    return {"pair": (p["q"] @ p["k"].T) * SCALE, "carry": p["v"] @ p["o"], "out": np.concatenate([p["out"], p["bias"][None]])}


def class_scores(p: dict[str, np.ndarray], rows: np.ndarray, wanted: np.ndarray, classes: np.ndarray, room: Room | None = None) -> np.ndarray:
    """log10 probability of the classes at the wanted places of the windows.

    Products and sums go window by window, so that a window's scores do not depend on
    how many others are scored with it.  Windows whose first places only serve as context
    ask nothing there.
    """
    room = room or Room(p["embed"].dtype)
    made, width = _made(p), p["embed"].shape[1]
    every = np.zeros(wanted.shape, np.int64)
    every[wanted] = classes
    found = np.empty(wanted.shape, p["embed"].dtype)
    early = wanted[:, :OVERLAP].any(axis=1)
    for which, skip in ((early, 0), (~early, OVERLAP)):
        some = np.flatnonzero(which)
        if not len(some):
            continue
        windows, asked = len(some), LENGTH - skip
        x = np.take(p["embed"], rows[some], axis=0, out=room("x", windows, LENGTH, width), mode="clip")
        x += p["place"]
        own = room("own", windows, asked, width)
        own[:] = x[:, skip:]
        query = np.matmul(own, made["pair"], out=room("narrow", windows, asked, width))
        a = np.matmul(query, x.transpose(0, 2, 1), out=room("a", windows, asked, LENGTH))
        np.minimum(a, MOST, out=a)
        np.exp(a, out=a)
        a *= CAUSAL[skip:]
        u = np.matmul(a, x, out=room("u", windows, asked, width))
        u /= np.matmul(a, room.ones(LENGTH))[:, :, None]
        h = room("h", windows, asked, width + 1)
        np.matmul(u, made["carry"], out=h[:, :, :width])
        h[:, :, :width] += own
        h[:, :, width] = 1
        logits = np.matmul(h, made["out"], out=room("soft", windows, asked, CLASSES))
        np.minimum(logits, MOST, out=logits)
        told = np.take(logits.ravel(), np.arange(0, logits.size, CLASSES) + every[some, skip:].ravel())
        np.exp(logits, out=logits)
        found[some, skip:] = told.reshape(windows, asked) - np.log(np.matmul(logits, room.ones(CLASSES)))
    return found[wanted] * np.float32(np.log10(np.e))


def _softened(a: np.ndarray) -> None:
    """Exponentials of logits, in place."""
    np.clip(a, -MOST, MOST, out=a)
    np.exp(a, out=a)


def _through(made: dict[str, np.ndarray], x: np.ndarray, classes: np.ndarray, weights: np.ndarray, into: dict[str, np.ndarray], dx: np.ndarray, room: Room) -> np.ndarray:
    """Probabilities of the classes at the last places of windows of inputs ``x``, which
    alone have classes.  Gradients of the weighted loss are added to ``into`` and written
    to ``dx``.

    Exponentials stay undivided: their sums divide the narrower side of each product.  Sums
    are products with ones, and biases meet a column of ones.
    """
    windows, length, width = x.shape
    asked = classes.shape[1]
    number = windows * asked
    flat = lambda z: z.reshape(-1, z.shape[-1])
    # Beside the exponentials go their gradients, beside the queries those of their sums.
    both, sides = room("both", windows, 2 * asked, length), room("sides", windows, 2 * asked, width)
    a, da = both[:, :asked], both[:, asked:]
    own, narrow = room("own", windows, asked, width), room("narrow", number, width)
    xt = x.transpose(0, 2, 1)
    own[:] = x[:, length - asked :]
    query = np.matmul(flat(own), made["pair"], out=narrow).reshape(own.shape)
    np.matmul(query, xt, out=a)
    _softened(a)
    a *= CAUSAL[length - asked :]
    sides[:, asked:] = query
    total = np.matmul(a, room.ones(length)).reshape(-1, 1)
    u = flat(np.matmul(a, x, out=room("u", windows, asked, width)))
    u /= total
    h = room("h", number, width + 1)
    np.matmul(u, made["carry"], out=h[:, :width])
    h[:, :width] += flat(own)
    h[:, width] = 1

    soft = np.matmul(h, made["out"], out=room("soft", number, CLASSES))
    _softened(soft)
    total_soft = soft @ room.ones(CLASSES)
    told, at, weight = soft.ravel(), np.arange(0, number * CLASSES, CLASSES) + classes.ravel(), weights.ravel()
    chances = told[at] / total_soft
    soft *= (weight / total_soft)[:, None]
    told[at] -= weight
    into["out"] += (soft.T @ h).T
    dh = np.matmul(soft, made["out"][:width].T, out=room("dh", number, width))
    into["carry"] += u.T @ dh

    du = np.matmul(dh, made["carry"].T, out=narrow)
    du /= total
    sides[:, :asked] = du.reshape(own.shape)
    np.matmul(du.reshape(own.shape), xt, out=da)
    # What a row's weights share is the product with its own output.
    u *= du
    da -= (u @ room.ones(width)).reshape(windows, asked, 1)
    da *= a
    np.matmul(both.transpose(0, 2, 1), sides, out=dx)
    dquery = flat(np.matmul(da, x, out=room("u", windows, asked, width)))
    into["pair"] += flat(own).T @ dquery
    dh += np.matmul(dquery, made["pair"].T, out=narrow)
    dx[:, length - asked :] += dh.reshape(own.shape)
    return chances


def _change(p: dict[str, np.ndarray], rows: np.ndarray, classes: np.ndarray, real: np.ndarray, into: dict[str, np.ndarray], room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient of the mean loss over real places: of all but embeddings in ``into``, and
    rows and gradients of the embeddings met.  With the real places' probabilities.

    Windows whose first places only serve as context ask nothing there.
    """
    made = _made(p)
    change = {name: np.zeros_like(part) for name, part in made.items()}
    early = real[:, :OVERLAP].any(axis=1)
    order = np.argsort(~early, kind="stable")
    rows, classes, real = rows[order], classes[order], real[order]
    windows, first = len(rows), int(np.count_nonzero(early))
    weights = real * room.dtype.type(1 / max(1, np.count_nonzero(real)))
    x, dx = room("x", windows, LENGTH, WIDTH), room("dx", windows, LENGTH, WIDTH)
    np.take(p["embed"], rows, axis=0, out=x, mode="clip")
    x += p["place"]
    chances = []
    for some, skip in ((slice(0, first), 0), (slice(first, windows), OVERLAP)):
        if some.start < some.stop:
            found = _through(made, x[some], classes[some, skip:], weights[some, skip:], change, dx[some], room)
            chances.append(found[real[some, skip:].ravel()])
    into["out"][:], into["bias"][:] = change["out"][:-1], change["out"][-1]
    into["q"][:], into["k"][:] = change["pair"] @ p["k"] * SCALE, change["pair"].T @ p["q"] * SCALE
    into["v"][:], into["o"][:] = change["carry"] @ p["o"].T, p["v"].T @ change["carry"]
    into["place"][:] = (room.ones(windows) @ dx.reshape(windows, -1)).reshape(LENGTH, WIDTH)
    # Sixteen bits are sorted by their digits.
    order = np.argsort(rows.ravel().astype(np.uint16), kind="stable")
    ranked = rows.ravel()[order]
    first = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
    return ranked[first], np.add.reduceat(dx.reshape(-1, WIDTH)[order], first, axis=0), np.concatenate(chances) if chances else np.ones(0)


def gradient(p: dict[str, np.ndarray], rows: np.ndarray, classes: np.ndarray, real: np.ndarray, into: dict[str, np.ndarray]) -> float:
    """Mean loss over real places; its gradient goes to ``into``."""
    met, found, chances = _change(p, rows, classes, real, into, Room(p["embed"].dtype))
    into["embed"][:] = 0
    into["embed"][met] = found
    return float(-np.log(np.maximum(chances, 1e-30)).sum() / max(1, len(chances)))


#: Parameters that a step changes at once: they stay near the processor.
NEAR = 1 << 14


def _moved(flat: np.ndarray, change: np.ndarray, first: np.ndarray, second: np.ndarray, rate: float, step: int) -> None:
    """One step of Adam, in place; ``change`` is used up."""
    two = (1 - 0.99**step) ** 0.5
    pace, least = np.float32(rate * two / (1 - 0.9**step)), np.float32(1e-8 * two)
    for at in range(0, len(flat), NEAR):
        f, c, m, s = (z[at : at + NEAR] for z in (flat, change, first, second))
        m *= np.float32(0.9)
        s *= np.float32(0.99)
        c *= np.float32(0.1)
        m += c
        c *= c
        s += c
        np.sqrt(s, out=c)
        c += least
        np.divide(m, c, out=c)
        c *= pace
        f -= c


class Rows:
    """Adam of embeddings, of which a step meets few: as :func:`_moved` with 0 for the rest.

    Moments are held as what they were without the decay of all rows, with the root of the
    second, so that a step writes only to rows it meets before it changes all embeddings.
    """

    #: Steps after which the decay is put in, before numbers grow too large.
    DECAY = 256

    def __init__(self, embed: np.ndarray) -> None:
        self.embed = embed
        self.first, self.second, self.root = (np.zeros_like(embed) for _ in range(3))
        self.spare = np.empty(NEAR, embed.dtype)
        self.age = 0

    def move(self, met: np.ndarray, found: np.ndarray, rate: float, step: int) -> None:
        """``found`` is used up."""
        if self.age == self.DECAY:
            for held, decay in ((self.first, 0.9), (self.second, 0.99), (self.root, 0.99**0.5)):
                held *= np.float32(decay**self.age)
            self.age = 0
        self.age += 1
        self.first[met] += found * np.float32(0.1 * 0.9**-self.age)
        found *= found
        found *= np.float32(0.01 * 0.99**-self.age)
        found += self.second[met]
        self.second[met] = found
        self.root[met] = np.sqrt(found, out=found)
        two, shrunk = (1 - 0.99**step) ** 0.5, 0.99 ** (self.age / 2)
        pace, least = np.float32(rate * two / (1 - 0.9**step) * 0.9**self.age / shrunk), np.float32(1e-8 * two / shrunk)
        flat = [z.reshape(-1) for z in (self.embed, self.first, self.root)]
        for at in range(0, self.embed.size, NEAR):
            f, m, r = (z[at : at + NEAR] for z in flat)
            c = self.spare[: len(f)]
            np.add(r, least, out=c)
            np.divide(m, c, out=c)
            c *= pace
            f -= c


def train(flat: np.ndarray, rows: np.ndarray, classes: np.ndarray, real: np.ndarray, rate: float, batch: int = 64, least: int = 300) -> np.ndarray:
    """Parameters after Adam over the windows in the order given: once, or as often as
    makes ``least`` steps."""
    flat = flat.copy()
    p, change, room = views(flat), np.zeros(SIZE, np.float32), Room()
    into, embeddings, rest = views(change), Rows(p["embed"]), slice(p["embed"].size, SIZE)
    first, second = np.zeros(SIZE - rest.start, np.float32), np.zeros(SIZE - rest.start, np.float32)
    starts = list(range(0, len(rows), batch))
    steps = max(least, len(starts)) if starts else 0
    for step in range(1, steps + 1):
        at = starts[(step - 1) % len(starts)]
        some = slice(at, at + batch)
        met, found, _ = _change(p, rows[some], classes[some], real[some], into, room)
        embeddings.move(met, found, rate, step)
        _moved(flat[rest], change[rest], first, second, rate, step)
    return flat


def windows_in(lengths: np.ndarray, size: int = LENGTH) -> np.ndarray:
    """Number of windows over texts of so many tokens."""
    return np.maximum(1, -(-(lengths - OVERLAP) // (size - OVERLAP)))


def window_places(lengths: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of so many tokens in a row: first token, text's end, and how
    many tokens at the front only serve as context."""
    number = windows_in(lengths, size)
    text = np.repeat(np.arange(len(lengths)), number)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    return begin[text] + nth * (size - OVERLAP), begin[text + 1], np.where(nth > 0, OVERLAP, 0)


def score(p: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, before: np.ndarray, lengths: np.ndarray, batch: int = 128) -> np.ndarray:
    """log10 probability of each text: ``ids`` of all texts in a row, ``before`` the id
    that each follows."""
    classes, rows = vocabulary.of[ids], vocabulary.row[before]
    first, end, context = window_places(lengths)
    out, room = np.empty(len(ids)), Room()
    place = np.arange(LENGTH)
    for at in range(0, len(first), batch):
        some = slice(at, at + batch)
        where = first[some, None] + place
        wanted = (where < end[some, None]) & (place >= context[some, None])
        target = where[wanted]
        out[target] = class_scores(p, rows[np.minimum(where, len(ids) - 1)], wanted, classes[target], room)
    out += vocabulary.within[ids]
    # Each text's own sum, whatever stands before it; none is empty, as each has its end.
    return np.add.reduceat(out, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)
