"""Secrets: fixed patterns, and a character network over every further candidate.

Base spans come from three fixed patterns.  Candidates are all runs of letters, digits and
``+ / _ . -`` (with up to two ``=`` after them) of ``LEAST`` characters or more that hold a
digit or small and capital letters beyond the first, and all runs of ``LEAST_NAMED`` or more
that stand right after ``:`` or ``=`` (spaces and a quote between them or not).  A small
convolutional network (:mod:`charconv`) reads each candidate, whole, with ``BEFORE`` bytes
before it and ``AFTER`` after it.

It learns from labelled findings: candidates in base spans are findings, others are not.  As
secrets that no pattern knows stand among the others, a first network learns from the
candidates alone, without their surroundings; others that it takes for findings have no label.
Learning and calibration use every distinct window (windows beyond ``LONGEST`` bytes are
learned from by their first ones, but scored whole), but for a fifth, by digest, which is set
aside for calibration.  Windows are dealt into shards of about ``SHARD`` by hash; shards are
trained on at the same time, both classes weighing alike over all shards, and the parameters
averaged after each of ``ROUNDS`` rounds; one shard alone is trained on in one round.
Log-odds are calibrated by a line fitted to the share set aside, apart for candidates after
``:`` or ``=`` and for others, from the number of windows of either class at each log-odds,
told apart by 1 / ``FINE``.  A threshold finds at least ``RECALL`` of the
findings set aside with as few others as any such threshold: it lies midway between the
log-odds of the last finding needed and of the next other below.  It is never below ``SURE``,
which protects clean text where findings are few or odd.  Candidates beyond it are spans of kind ``model``, unless
they touch a base span.

Positions count code points.  Null text is an empty text and has no spans.  Every row is
scanned by itself, also where ids repeat or are null; an empty table gives an empty result,
and without findings no candidate is taken.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm import charconv
from fieldtally.llm.tables import stored
from fieldtally.llm.text import blocks, word_bounds

#: Windows of a training shard, rounds over several shards, and the steps over a shard and
#: most epochs in all rounds.
SHARD = 1 << 14
ROUNDS = 4
STEPS, EPOCHS = 512, 16
#: Log-odds that are told apart, a unit.
FINE = 1024
LEAST, LEAST_NAMED = 8, 6
BEFORE, AFTER, LONGEST = 24, 8, 256
RECALL, SURE = 0.98, 0.9
KINDS = ("assign", "access", "hex", "model")

# Fixed patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

RUN = np.ones(256, bool)
RUN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_.-"]] = False
_SCANNED = {
    "doc_id": "long", "kinds": "array<int>", "starts": "array<long>", "ends": "array<long>", "c_starts": "array<long>", "c_ends": "array<long>",
    "named": "array<boolean>", "told": "array<boolean>", "windows": "array<binary>", "lefts": "array<int>", "insides": "array<int>",
}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each candidate, in bytes, and whether ``:`` or ``=`` names it."""
    start, end, text = word_bounds(data, at, RUN)
    for _ in range(3):
        end = end - ((end > start) & np.isin(data[np.maximum(end - 1, 0)], list(b".-")))
    for _ in range(3):
        start = start + ((start < end) & np.isin(data[np.minimum(start, len(data) - 1)], list(b".-")))
    own, limit = at[text], at[text + 1]
    padded = np.append(data, np.zeros(3, np.uint8))
    for _ in range(2):
        end = end + ((end < limit) & (padded[end] == 0x3D))
    named, place = np.zeros(len(start), bool), start - 1
    open_ = np.ones(len(start), bool)
    for _ in range(3):
        open_ &= place >= own
        seen = data[np.maximum(place, 0)]
        named |= open_ & ((seen == 0x3A) | (seen == 0x3D))
        open_ &= (seen == 0x20) | (seen == 0x22) | (seen == 0x27)
        place = place - 1
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    digits, small, capitals = count((data >= 0x30) & (data < 0x3A)), count((data >= 0x61) & (data < 0x7B)), count((data >= 0x41) & (data < 0x5B))
    inner = np.minimum(start + 1, end)
    mixed = (capitals[end] > capitals[inner]) & (small[end] > small[start])
    size = end - start
    keep = (size >= LEAST) & ((digits[end] > digits[start]) | mixed) | named & (size >= LEAST_NAMED)
    return start[keep], end[keep], text[keep], named[keep]


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of each document, and its candidates with their windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in blocks(batch.column("text")):
                start, end, text, named = candidates(data, at)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                bounds = np.searchsorted(text, np.arange(last - first + 1)).tolist()
                begin, stop = (points[x] - points[at[text]] for x in (start, end))
                limits, rows = at.tolist(), {k: [] for k in list(_SCANNED)[1:]}
                raw = data.tobytes()
                for i in range(last - first):
                    spans = base_spans(raw[limits[i] : limits[i + 1]].decode())
                    mine = slice(bounds[i], bounds[i + 1])
                    a, b = begin[mine], stop[mine]
                    edges = np.array([(s, e) for s, _, e in spans], np.int64).reshape(-1, 2)
                    # Spans of different kinds may overlap, so the furthest end so far decides.
                    before = np.searchsorted(edges[:, 0], b, side="left")
                    furthest = np.concatenate([[-1], np.maximum.accumulate(edges[:, 1])]) if len(edges) else np.array([-1])
                    left = np.minimum(start[mine] - limits[i], BEFORE)
                    right = np.minimum(limits[i + 1] - end[mine], AFTER)
                    rows["kinds"].append([k for _, k, _ in spans])
                    rows["starts"].append(edges[:, 0])
                    rows["ends"].append(edges[:, 1])
                    rows["c_starts"].append(a)
                    rows["c_ends"].append(b)
                    rows["named"].append(named[mine])
                    rows["told"].append(furthest[before] > a)
                    rows["windows"].append([raw[s - m : e + n] for s, e, m, n in zip(start[mine].tolist(), end[mine].tolist(), left.tolist(), right.tolist())])
                    rows["lefts"].append(left)
                    rows["insides"].append(end[mine] - start[mine])
                kinds = {"array<int>": pa.int32(), "array<long>": pa.int64(), "array<boolean>": pa.bool_(), "array<binary>": pa.binary()}
                columns = [pa.array(v, pa.list_(kinds[_SCANNED[k]])) for k, v in rows.items()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), *columns], list(_SCANNED))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, ", ".join(f"{k} {v}" for k, v in _SCANNED.items()))


def findings(found: DataFrame) -> DataFrame:
    """Distinct windows of either class."""
    each = found.select(F.explode(F.arrays_zip("told", "named", "windows", "lefts", "insides")).alias("c")).select("c.*")
    cut = F.greatest(F.lit(1), F.least(F.col("insides"), F.lit(LONGEST) - F.col("lefts")))
    return each.select("told", "named", F.substring("windows", 1, LONGEST).alias("window"), F.col("lefts").alias("left"), cut.alias("inside")).distinct()


def _line(odds: np.ndarray, told: np.ndarray, number: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of calibrated log-odds, from how many windows of a class have them
    (Newton's steps, halved while they lead away, with a little pull towards leaving the odds
    as they are)."""
    w = np.array([1.0, 0.0])
    x = np.stack([odds, np.ones_like(odds)], axis=1).astype(float)
    loss = lambda w: float(number @ (np.logaddexp(0, x @ w) - told * (x @ w)) + 0.05 * ((w - [1.0, 0.0]) ** 2).sum())
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = 0.1 * (w - [1.0, 0.0])
        step = np.linalg.solve((x * (number * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (number * (p - told)) + pull)
        here = loss(w)
        for _ in range(30):
            if loss(w - step) <= here:
                w = w - step
                break
            step = step / 2
    return float(w[0]), float(w[1])


class Model:
    """The network, and for candidates without and with a name the calibration and threshold."""

    def __init__(self, network: dict, lines: list[tuple[float, float]], thresholds: list[float]) -> None:
        self.network, self.lines, self.thresholds = network, lines, thresholds

    def probability(self, windows: list[bytes], left: np.ndarray, inside: np.ndarray, named: np.ndarray) -> np.ndarray:
        odds = charconv.log_odds(self.network, windows, left, inside)
        a, b = np.array(self.lines).T
        which = named.astype(int)
        return 1 / (1 + np.exp(-np.clip(a[which] * odds + b[which], -30, 30)))


def _columns(rows: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows in order, their left sizes, insides, names and classes, and which are set aside."""
    rows = sorted((r["window"], r["left"], r["inside"], r["named"], r["told"]) for r in rows.to_pylist())
    windows = [w for w, *_ in rows]
    left, inside, named, told = (np.array([r[i] for r in rows], kind) for i, kind in ((1, np.int64), (2, np.int64), (3, bool), (4, bool)))
    return windows, left, inside, named, told, np.array([hashlib.sha256(w).digest()[0] % 5 == 0 for w in windows], bool)


def _alone(windows: list[bytes], left: np.ndarray, inside: np.ndarray) -> list[bytes]:
    return [w[a : a + b] for w, a, b in zip(windows, left.tolist(), inside.tolist())]


def _sure(first: dict, windows: list[bytes], left: np.ndarray, inside: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Findings, and others that the first network does not take for findings."""
    return told | (charconv.log_odds(first, _alone(windows, left, inside), np.zeros_like(left), inside) < 0)


def _counts(windows: DataFrame, first: dict | None) -> tuple[int, int]:
    """How many windows of either class are learned from: others, findings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(2, np.int64)
        for batch in batches:
            texts, left, inside, _, told, aside = _columns(pa.Table.from_batches([batch]))
            use = ~aside if first is None else ~aside & _sure(first, texts, left, inside, told)
            number += np.bincount(told[use].astype(int), minlength=2)
        yield pa.RecordBatch.from_arrays([pa.array([number[0]]), pa.array([number[1]])], ["others", "told"])

    row = windows.mapInArrow(work, "others long, told long").agg(F.sum("others").alias("others"), F.sum("told").alias("told")).first()
    return row["others"] or 0, row["told"] or 0


def _trained(windows: DataFrame, shards: int, first: dict | None) -> dict:
    """The first network, of candidates alone, or with it the second, of candidates with and
    without their surroundings, so that their own form counts too."""
    numbers = _counts(windows, first)
    if not all(numbers):
        return charconv.constant(4.0 if numbers[1] else -4.0)
    weights = np.array([0.5 * sum(numbers) / n for n in numbers])
    rounds = 1 if shards == 1 else ROUNDS
    lots = -(-sum(numbers) * (1 if first is None else 2) // (shards * charconv.BATCH))
    epochs = max(1, min(EPOCHS // rounds, -(-STEPS // (rounds * lots))))
    sizes = [int(np.prod(s)) for s in charconv.SHAPES.values()]
    network = charconv.fresh()
    for _ in range(rounds):
        start = network

        def work(rows: pa.Table) -> pa.Table:
            texts, left, inside, _, told, aside = _columns(rows)
            use = np.flatnonzero(~aside if first is None else ~aside & _sure(first, texts, left, inside, told))
            texts, left, inside, told = [texts[i] for i in use], left[use], inside[use], told[use].astype(np.float32)
            alone, none = _alone(texts, left, inside), np.zeros_like(left)
            if first is None:
                texts, left = alone, none
            else:
                texts, left, inside, told = texts + alone, np.concatenate([left, none]), np.tile(inside, 2), np.tile(told, 2)
            after = charconv.train(start, texts, left, inside, told, weights[told.astype(int)], epochs) if texts else start
            return pa.table({"found": pa.array([np.concatenate([after[k].ravel() for k in charconv.SHAPES])], pa.list_(pa.float32()))})

        # Sums of whole numbers are the same in any order; as many come here as a network has values.
        # By number, so that shards are not put together in one task for their few bytes.
        each = windows.repartition(shards, "shard").groupBy("shard").applyInArrow(work, "found array<float>").select(F.posexplode("found").alias("at", "value"))
        whole = (F.col("value").cast("double") * 2.0**30).cast("long")
        means = each.groupBy("at").agg(F.sum(whole).alias("total"), F.count(F.lit(1)).alias("n")).orderBy("at").toArrow()
        flat = (means.column("total").to_numpy() / means.column("n").to_numpy() / 2.0**30).astype(np.float32)
        network = {k: part.reshape(s) for (k, s), part in zip(charconv.SHAPES.items(), np.split(flat, np.cumsum(sizes)[:-1]))}
    return network


def _calibrated(windows: DataFrame, first: dict, network: dict) -> tuple[list[tuple[float, float]], list[float]]:
    """Lines and thresholds, from the numbers of windows set aside at each log-odds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, left, inside, named, told, aside = _columns(pa.Table.from_batches([batch]))
            use = np.flatnonzero(aside & _sure(first, texts, left, inside, told))
            odds = np.clip(charconv.log_odds(network, [texts[i] for i in use], left[use], inside[use]), -64, 64)
            yield pa.RecordBatch.from_arrays([pa.array(named[use]), pa.array(told[use]), pa.array(np.rint(odds * FINE).astype(np.int64))], ["named", "told", "odds"])

    told_odds = windows.mapInArrow(work, "named boolean, told boolean, odds long").groupBy("named", "told", "odds").agg(F.count(F.lit(1)).alias("n"))
    table = told_odds.orderBy("named", "told", "odds").toArrow()
    named, told, odds, number = (table.column(c).to_numpy(zero_copy_only=False) for c in ("named", "told", "odds", "n"))
    named, told, odds = named.astype(bool), told.astype(bool), odds / FINE
    lines, thresholds = [], []
    for kind in (False, True):
        rows = named == kind
        if not told[rows].any() or told[rows].all():
            rows = np.ones(len(told), bool)
        if not told[rows].any() or told[rows].all():
            lines.append((1.0, 0.0))
            thresholds.append(SURE)
            continue
        a, b = _line(odds[rows], told[rows].astype(float), number[rows])
        known, many = a * odds[rows & told] + b, number[rows & told]
        order = np.argsort(known, kind="stable")
        reached = np.cumsum(many[order])
        needed = known[order][np.searchsorted(reached, int((1 - RECALL) * reached[-1]), side="right")]
        others = a * odds[rows & ~told] + b
        cut = (needed + others[others < needed].max(initial=-30.0)) / 2
        lines.append((a, b))
        thresholds.append(max(SURE, float(1 / (1 + np.exp(-np.clip(cut, -30, 30))))))
    return lines, thresholds


def learn(found: DataFrame) -> Model:
    """From all distinct windows, in shards."""
    windows = stored(findings(found), "windows")
    shards = max(1, -(-windows.count() // SHARD))
    windows = windows.withColumn("shard", F.pmod(F.xxhash64("window", "left", "inside", "named"), F.lit(shards)))
    first = _trained(windows, shards, None)
    network = _trained(windows, shards, first)
    return Model(network, *_calibrated(windows, first, network))


def label(found: DataFrame, model: Model) -> DataFrame:
    """doc_id and the spans of each document: kind, start and end, in order."""
    kept = (model.network, model.lines, model.thresholds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*kept)
        least = np.array(model.thresholds)
        for batch in batches:
            get = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
            windows = batch.column("windows").flatten().to_pylist()
            named, told = get("named").astype(bool), get("told").astype(bool)
            taken = np.zeros(len(windows), bool)
            ask = np.flatnonzero(~told)
            left, inside = get("lefts"), get("insides")
            for i in range(0, len(ask), 4096):
                few = ask[i : i + 4096]
                p = model.probability([windows[j] for j in few], left[few], inside[few], named[few])
                taken[few] = p >= least[named[few].astype(int)]
            at = 0
            out = []
            for kinds, starts, ends, a, b in zip(*(batch.column(c).to_pylist() for c in ("kinds", "starts", "ends", "c_starts", "c_ends"))):
                more = [(s, 3, e) for s, e, t in zip(a, b, taken[at : at + len(a)].tolist()) if t]
                at += len(a)
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted([*zip(starts, kinds, ends), *more])])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return found.mapInArrow(work, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every document."""
    found = stored(scan(docs), "candidates")
    return label(found, learn(found))


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    number = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *number, F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"))
