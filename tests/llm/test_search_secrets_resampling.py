"""Search, secrets and resampling against plain versions, and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import AWKWARD, CLASHING, SCHEMA

from fieldtally.llm import charconv, resampling, search, secrets
from fieldtally.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate([*CLASHING, "item", "terms", "code", "rank", "part", "told", "spans"]) if c not in CLASHING[:i]])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items):
    counted = [(d, len(terms(t)), collections.Counter(terms(t))) for d, t in docs]
    n, total = sum(k > 0 for _, k, _ in counted), sum(k for _, k, _ in counted)
    df = collections.Counter(w for _, _, c in counted for w in c)
    out = []
    for item, text in items:
        found = []
        for d, k, c in counted:
            if k:
                m = 10 + 90 * k * n // total
                score = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
                if score > 0:
                    found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if no else d, -s) for i, (s, no, d) in enumerate(sorted(found)[:10])]
    return sorted(out, key=repr)


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def many_texts():
    """Copies and near copies of texts of common and rare words."""
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 20, 150)))) for _ in range(300)]
    return [(i, texts[i * i % 211] + rng.choice(("", "", " end", " W1"))) for i in range(700)]


@pytest.mark.parametrize("members, segment, area, at_once", [(64, 2048, 1 << 23, 1 << 18), (2, 50, 4000, 60)])
def test_search(spark, awkward, none, monkeypatch, members, segment, area, at_once):
    for name, value in (("MEMBERS", members), ("SEGMENT", segment), ("AREA", area), ("ITEM_TERMS", at_once)):
        monkeypatch.setattr(search, name, value)
    items = [("b", "One TWO three, w1 w2"), ("a", None), ("c", ""), ("c", "?!"), ("d", "sixteen nowhere"), (None, "ab and one"), ("e", "w3 w5 w8 w13 w21 w34 w55 w1"), ("e", "end")]
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id string, text string, rank int")
    assert shown(search.rank(awkward, benchmark)) == plain_search([(d, t) for d, t, *_ in AWKWARD], items)
    rows = many_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert shown(search.rank(docs, benchmark)) == plain_search(rows, items)
    assert search.rank(none, benchmark).count() == search.rank(awkward, benchmark.limit(0)).count() == 0
    assert search.rank(awkward, benchmark).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_blocks_are_skipped(spark):
    """Each block's summary is at least every member's, and far blocks stay shut."""
    rows = many_texts()
    counted = [collections.Counter(terms(t)) for _, t in rows]
    df = collections.Counter(w for c in counted for w in c)
    asked = [["w3", "w5", "w400", "w77"], ["w1", "w2", "w90"]]
    items = search.Items([(i, [(df[w], w, max(1, int(1000 * math.log(1400 / (2 * df[w] + 1))))) for w in ws if df[w]]) for i, ws in enumerate(asked)])
    number = {t: i for i, t in enumerate(items.terms.to_pylist())}
    known = [[(number[w], 1000 * n) for w, n in sorted(c.items()) if w in number] for c in counted]
    sizes = np.array([len(k) for k in known])
    ids, impacts = (np.array([e[i] for k in known for e in k]) for i in (0, 1))
    segment = search.Segment(sizes, ids, impacts)
    of, members, counts, coords, peaks, many = segment.blocks(items)
    at, place = 0, 0
    for term, count, some in zip(of, counts, many):
        own = segment.table[members[at : at + count]]
        beside = items.with_term(term, segment.present)
        most = dict(zip(coords[place : place + some], peaks[place : place + some]))
        assert all(most.get(c, 0) == own[:, np.searchsorted(segment.present, c)].max() for c in beside)
        at, place = at + count, place + some
    row = {"sizes": sizes, "ids": ids, "impacts": impacts, "terms": of, "members": members, "member_counts": counts, "coords": coords, "peaks": peaks, "coord_counts": many}
    best = [search.Best(3) for _ in asked]
    opened = search.search_segment(row, np.arange(len(rows)), np.zeros(len(rows), bool), items, best)
    total = sum(int((of == t).sum()) for ts in items.of for t in ts)
    assert 0 < opened < total


def test_crcs_come_from_prefixes():
    rng, shifts = random.Random(1), resampling.Shifts()
    for _ in range(60):
        texts = ["".join(rng.choice("aé b9 .Z") for _ in range(rng.choice((0, 1, 5, 70, 400)))) for _ in range(rng.randint(1, 6))]
        raw = [t.encode() for t in texts]
        at = np.cumsum([0] + [len(t) for t in raw])
        for n in (1, 3):
            crc, own, words = resampling.feature_crcs(resampling.LOWER[np.frombuffer(b"".join(raw), np.uint8)], at, n, shifts)
            told = [terms(t) for t in texts]
            assert words.tolist() == [len(w) for w in told]
            assert list(zip(own.tolist(), crc.tolist())) == [
                (i, zlib.crc32(" ".join(w[j : j + k]).encode())) for i, w in enumerate(told) for k in range(1, n + 1) for j in range(len(w) - k + 1)
            ]


def plain_resample(docs, items, percent, least, longest=1):
    def buckets(text):
        w = terms(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    own = [(d, len(terms(t)), buckets(t)) for d, t in docs]
    s, t = collections.Counter(b for *_, bs in own for b in bs), collections.Counter(b for x in items for b in buckets(x))
    all_s, all_t = sum(s.values()) + 10_000.0, sum(t.values()) + 10_000.0
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in s}
    out = []
    for d, n, bs in own:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        out.append([d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(may):
        r.append(i + 1 if i < percent * len(may) // 100 else None)
    return sorted((tuple([*r[:4], r[5] if len(r) > 5 else None]) for r in out), key=repr)


@pytest.mark.parametrize("percent, least, longest", [(10, 20, 1), (60, 1, 3), (100, 0, 1), (0, 0, 2)])
def test_resampling(spark, awkward, none, percent, least, longest):
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    texts = ["One two three", None, "", "end of w1 w4"]
    target = spark.createDataFrame([(t, 3) for t in texts], "text string, doc_id int")
    found = resampling.resample(awkward, target, longest, percent=percent, least_words=least)
    assert shown(found.select(names)) == plain_resample([(d, t) for d, t, *_ in AWKWARD], texts, percent, least, longest)
    rows = many_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = resampling.resample(docs, target, longest, percent=percent, least_words=least)
    assert shown(found.select(names)) == plain_resample(rows, texts, percent, least, longest)
    assert resampling.resample(none, target).count() == 0
    assert resampling.resample(awkward, target.limit(0)).count() == len(AWKWARD)


def plain_base(text):
    patterns = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    found, counts = [], []
    for i, (kind, pattern, good) in enumerate(patterns):
        own = [(m.start(), i, m.end(), kind) for m in pattern.finditer(text or "") if good(m)]
        found, counts = found + own, [*counts, len(own)]
    return (*counts, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found)).encode()).hexdigest())


def test_base_secrets(spark, folder, awkward, none):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = QUERIES["op12_secret_scan"](spark, folder).collect()
    assert len(rows) == len(told) and all(tuple(r)[1:5] == plain_base(told[r["doc_id"]]) for r in rows)
    odd = [
        "token=tok: token= abcdefgh", "secret: token: abcdefgh", "PASSWORD='é' Passwd:='abc123' api_key = \"x\"", "ſecret=abcdefgh toKen=abcdef",
        "AKIAAKIA" + "Z9" * 8 + " AKIA12", "é" * 5 + "0" * 23 + " " + "a" * 24 + "g", "token=" + "ab12" * 30_000, "=" * 50 + "a1b2c3d4==" + "é", ".-.-a1b2c3d4e5.-.-",
        "password\n=\nabcdef", None, "", ":abcdef", "=abcde1é", "x\x00token=\x00abcdef",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for r in secrets.spans(docs).collect():
        text, base = odd[r["doc_id"]] or "", [s for s in r["spans"] if s["kind"] != "model"]
        digest = hashlib.sha256(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base).encode()).hexdigest()
        assert digest == plain_base(text)[3], text[:40]
        for s in r["spans"]:
            assert 0 <= s["start"] < s["end"] <= len(text)
            assert s["kind"] != "model" or not any(b["start"] < s["end"] and s["start"] < b["end"] for b in base)
    assert secrets.spans(awkward).count() == len(AWKWARD) and secrets.spans(none).count() == 0


def test_network_finds_unseen_secrets_and_leaves_clean_text(spark):
    rng = random.Random(12)
    value = lambda n, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(n - 1)) + rng.choice("123456789")
    some = lambda: " ".join(rng.choice(("words", "stand", "here", "and", "more", "of", "them")) for _ in range(8))
    texts = [f"{some()} {rng.choice(('token', 'password', 'secret'))} = \"{value(rng.choice((18, 20, 40)))}\" {some()}" for _ in range(160)]
    clean = [f"{some()} {v} {some()}" for _ in range(60) for v in ("10.20.30." + value(3, "0123456789"), value(16, "0123456789"), f"name.{value(2, '0123456789')}@mail1.example.com", "Word3.example", "2024-11-3" + value(1))]
    unseen = [f"{some()} credential = \"{value(20)}\" {some()}" for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate([*texts, *clean, *unseen])), "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.spans(docs).collect()}
    assert sum("model" in got[len(texts) + len(clean) + i] for i in range(len(unseen))) >= 16
    assert sum("model" in got[len(texts) + i] for i in range(len(clean))) <= 3


def test_every_window_is_learned_from(spark, monkeypatch):
    rng = random.Random(5)
    value = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 1)) + rng.choice("123456789")
    texts = [f"a word and token = \"{value(20)}\" here" for _ in range(1300)] + [f"more of 2024-11-{i:04x}.net there" for i in range(1500)]
    texts += [f"a word and credential = \"{value(20)}\" here" for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.findings(secrets.scan(docs))
    assert found.where("told").count() == 1300 and found.where("not told").count() >= 1500
    learned, train = [], secrets._trained
    monkeypatch.setattr(secrets, "SHARD", 512)
    monkeypatch.setattr(secrets, "_trained", lambda windows, shards, first: learned.append((windows.count(), shards)) or train(windows, shards, first))
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.spans(docs).collect()}
    assert learned == [(found.count(), -(-found.count() // 512))] * 2
    assert sum("model" in got[2800 + i] for i in range(20)) >= 16
    assert sum("model" in got[1300 + i] for i in range(1500)) <= 15


def test_convolution_gradient_and_windows_of_any_length(monkeypatch):
    rng = np.random.default_rng(0)
    windows = [bytes(rng.integers(32, 120, n).astype(np.uint8)) for n in (9, 30, 50, 12)]
    left, inside = np.array([2, 10, 24, 0]), np.array([5, 15, 20, 12])
    told, weight = np.array([1, 0, 1, 0.0]), np.ones(4)
    p = charconv.fresh()
    data, part = charconv.rows_of(windows, left, inside)
    whole = charconv.log_odds(p, windows, left, inside)
    assert charconv.gradient(p, data, part, told, weight)[0] == pytest.approx(float((np.logaddexp(0, whole) - told * whole).sum()), rel=1e-5)
    monkeypatch.setattr(charconv, "CHUNK", 7)
    assert np.allclose(charconv.log_odds(p, windows, left, inside), whole, atol=1e-5)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    g = charconv.gradient(p, data, part, told, weight)[1]
    for k in p:
        i = (int(windows[1][12]), 3) if k == "embed" else tuple(n // 2 for n in p[k].shape)
        was, sides = p[k][i], []
        for step in (1e-4, -1e-4):
            p[k][i] = was + step
            sides.append(charconv.gradient(p, data, part, told, weight)[0])
        p[k][i] = was
        assert (sides[0] - sides[1]) / 2e-4 == pytest.approx(float(g[k][i]), rel=1e-3, abs=1e-5)
