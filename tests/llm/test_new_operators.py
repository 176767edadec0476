"""Fingerprints, importance resampling and hard negatives against plain loops."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import fingerprints, hard_negatives, importance, queries

SF = "/root/testdata/sf0.001"


def texts(seed, n, size=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    return [" ".join(r.choice(words) for _ in range(r.randrange(size))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("node", "fp", "part", "role", "loc", "score", "rank", "eligible", "total", "_metadata", "tie")})


ODD = [(None, None), (None, "a b c"), (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (4, "two one"), (5, "É " * 3000), (6, "日本語 <|endoftext|> x"), (7, "x" * 70_000), (8, "!?"), (9, "a-b-c " * 40_000)]


# 11
def slow_fingerprint(text, bits=128):
    import xxhash

    def mix(z):
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return z ^ z >> 31

    words = [xxhash.xxh64_intdigest(w) for w in text.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()]
    votes = [0] * bits
    for n, weight in ((1, 2), (2, 4), (5, 4)):
        counts = {}
        for k in range(len(words) - n + 1):
            h = 0
            for w in words[k : k + n]:
                h = (h * fingerprints._STEP + w) % 2**64
            h = mix((h + n) % 2**64)
            counts[h] = counts.get(h, 0) + 1
        for h, times in counts.items():
            w = round(weight * (1 + math.log2(times)))
            raw = b"".join(mix((h + k * fingerprints._STEP) % 2**64).to_bytes(8, "little") for k in range(bits // 64))
            for i in range(bits):
                votes[i] += w if raw[i // 8] >> (7 - i % 8) & 1 else -w
    return int("".join("1" if v > 0 else "0" for v in votes), 2).to_bytes(bits // 8).hex()


def apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_fingerprints_are_the_plain_votes():
    make = fingerprints.SimHash()
    for t in [*texts(1, 40), *(t or "" for _, t in ODD if t is None or len(t) < 5000)]:
        assert make(t.encode()).hex() == slow_fingerprint(t)
    long = "Ab cd ef " * 300_000
    whole = make(long.encode())
    fingerprints.PART, kept = 1 << 10, fingerprints.PART
    try:
        assert fingerprints.SimHash()(long.encode()) == whole
    finally:
        fingerprints.PART = kept


def check_fingerprints(spark, rows, radius=6, cell=4096):
    got = fingerprints.fingerprint_documents(spark, frame(spark, rows), radius=radius, cell=cell).collect()
    assert len(got) == len(rows)
    make = fingerprints.SimHash()
    found = sorted((r["doc_id"] is None, -(r["doc_id"] or 0), r["fingerprint"], r["edited_sha256"]) for r in got)
    # among ties the order of texts is open, so the rows of the order that was taken are looked up
    tie = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1] or ""]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        new = fingerprints.edited(t or "", after)
        want.append((i is None, -(i or 0), make((t or "").encode()).hex(), hashlib.sha256(new.encode()).hexdigest()))
    assert found == sorted(want)
    fps = sorted({r["fingerprint"] for r in got})
    near = {f: sum(apart(f, g) <= radius for g in fps) - 1 for f in fps}
    group = {f: f for f in fps}
    for _ in fps:
        for a, b in itertools.combinations(fps, 2):
            if apart(a, b) <= radius:
                group[a] = group[b] = min(group[a], group[b])
    low = {}
    for r in got:
        if r["doc_id"] is not None:
            g = group[r["fingerprint"]]
            low[g] = min(low.get(g, r["doc_id"]), r["doc_id"])
    for r in got:
        assert r["n_near"] == near[r["fingerprint"]]
        assert r["class_id"] == low.get(group[r["fingerprint"]])
        assert 0 <= r["near_edited"] <= 1 and r["near_edited"] == 1 - apart(r["fingerprint"], r["edited_fingerprint"]) / 128
    return got


def test_fingerprints_of_odd_rows(spark):
    check_fingerprints(spark, ODD)


def test_fingerprints_of_near_texts(spark):
    r, base = random.Random(5), texts(2, 6, 300)
    rows = [(k, t) for k, t in enumerate(base * 3)]
    for k in range(60):  # dense groups: one word changed
        words = base[k % 3].split()
        words[r.randrange(len(words))] = "other"
        rows.append((100 + k, " ".join(words)))
    got = check_fingerprints(spark, rows, radius=6, cell=8)
    assert any(x["n_near"] > 8 for x in got)  # more than a cell's rows are near each other
    check_fingerprints(spark, rows, radius=3)


def test_fingerprints_of_one_row_and_none(spark):
    (r,) = check_fingerprints(spark, [(3, "alone in here")])
    assert r["near_next"] == 1
    assert fingerprints.fingerprint_documents(spark, frame(spark, [])).count() == 0


def test_links_are_whole_for_every_number_of_blocks(monkeypatch, spark):
    r = random.Random(9)
    fps = [r.getrandbits(128) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in r.sample(range(128), r.randrange(1, 9))) for f in fps for _ in range(4)]
    fps = sorted(set(fps))
    rows = spark.createDataFrame([(k, bytearray(f.to_bytes(16))) for k, f in enumerate(fps)], "node long, fp binary")
    want = {k: n for k, f in enumerate(fps) if (n := sum((f ^ g).bit_count() <= 5 for g in fps) - 1)}
    for blocks in (6, 7, 9):
        monkeypatch.setattr(fingerprints, "choose_blocks", lambda *_, b=blocks: b)
        counts, _ = fingerprints.near_links(rows, 128, 5, 16)
        assert {x["node"]: x["n_near"] for x in counts.collect()} == want
    monkeypatch.undo()
    assert fingerprints.choose_blocks(10**5, 128, 6) < fingerprints.choose_blocks(10**9, 128, 6)


def test_fingerprints_of_edited_texts_are_nearer(spark):
    rows = queries.op11_simhash(spark, SF).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 0.95 * len(rows)
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


# 12
def slow_features(text, n):
    words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return [" ".join(words[k : k + m]) for m in range(1, n + 1) for k in range(len(words) - m + 1)], len(words)


def slow_resample(docs, target, n, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, aim = np.zeros(buckets), np.zeros(buckets)
    for counts, rows in ((raw, [t for _, t in docs]), (aim, target)):
        for t in rows:
            for f in slow_features(t, n)[0]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (raw.sum() + buckets) / ((raw[b] + 1) * (aim.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, t in docs:
        found, n_words = slow_features(t, n)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words >= least))
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = [x[:4] for x in able[: percent * len(able) // 100]]
    return [x[:4] for x in out], drawn


@pytest.mark.parametrize("n,size", [(1, 1 << 16), (3, 40), (2, 7)])
def test_importance_is_the_plain_loop(spark, n, size):
    docs, target = ODD + [(10 + k, t) for k, t in enumerate(texts(3, 120))], [*texts(4, 10), None, ""]
    got = importance.resample(spark, frame(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=97, percent=30, size=size).collect()
    rows, drawn = slow_resample(docs, target, n, 97, 20, 30)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(rows, key=key)
    assert [tuple(r)[:4] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_chunks_hold_the_whole_text():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("ab \n.É-") for _ in range(r.randrange(80))).encode()
        for n, size in ((1, 1), (2, 5), (4, 9)):
            parts = list(importance.chunked(text, n, size))
            assert b"".join(owned for owned, _ in parts) == text.translate(importance._TABLE)
            features = importance.Features(n, 1 << 30)
            whole, cut = features(text)[1], [b for p in parts for b in features(*p)[1]]
            assert sorted(whole) == sorted(cut)


def test_importance_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(spark, frame(spark, []), none).count() == 0
    assert importance.resample(spark, frame(spark, ODD), none).count() == len(ODD)


# 13
def slow_mine(rows, every=50):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(x)) for x in v]
        if any(abs(256 * x) > hard_negatives.LARGEST for x in v):
            continue
        kept.append((i, q, label))
    out = []
    place = lambda i: (i is None, i or 0)
    for i, q, label in kept:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, o, strict=False)), j, m == label) for j, o, m in kept if j != i]
        scored.sort(key=lambda s: (-s[0], place(s[1])))
        for ps, p, _ in [s for s in scored if s[2]][:5]:
            fits = [(s, j) for s, j, same in scored if not same and 50 * ps <= 100 * s <= 95 * ps]
            out += [(i, p, k + 1, j, ps, s) for k, (s, j) in enumerate(fits[:3])]
    return out


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit("x") for c in ("q", "vec", "grp", "blk", "aid", "cell", "positives", "_at")})


def same(got, want):
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def clusters():
    r = np.random.default_rng(3)
    centres = r.normal(size=(8, 6)).astype(np.float32)
    return [(k, [float(np.float32(x)) for x in centres[k % 8] + 0.05 * r.normal(size=6)], int((k // 8) % 3)) for k in range(900)]


def test_hard_negatives_are_the_plain_loop(spark, clusters):
    want = slow_mine(clusters, 20)
    assert want
    for options in ({}, {"group": 5, "block": 50, "pivots": 12, "sample": 100}, {"group": 1, "block": 7, "pivots": 1, "sample": 1}):
        same(hard_negatives.mine(spark, vectors(spark, clusters), every=20, **options).collect(), want)


def test_bounds_keep_rows_from_groups(spark, clusters, monkeypatch):
    """With clusters, far fewer rows are sent than rows times groups."""
    sent = []
    serve = hard_negatives._serve

    def counted(*args):
        out = serve(*args)
        sent.append((out.count(), len({g for gs in args[6].values() for g in gs})))
        return out

    monkeypatch.setattr(hard_negatives, "_serve", counted)
    same(hard_negatives.mine(spark, vectors(spark, clusters), every=20, group=6, pivots=8, sample=200).collect(), slow_mine(clusters, 20))
    for rows, groups in sent:
        assert groups >= 6 and rows < 0.5 * len(clusters) * groups


def test_hard_negatives_of_odd_rows(spark):
    r = random.Random(7)
    v = lambda n=4: [r.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(n)]  # noqa: E731  many ties
    rows = [(k, v(), r.randrange(3)) for k in range(60)]
    rows += [(None, v(), 1), (None, v(), 2), (0, v(), 1), (0, v(), 1), (10, None, 1), (20, v(), None), (30, [1.0, None], 1), (30, [float("nan")] * 4, 1), (30, [float("inf")] * 4, 2), (40, [], 1), (41, [1.0], 2), (42, v(9), 0), (43, [3e38] * 4, 1), (50, [1e5] * 4, 1), (51, [1e5, 1e5, 9e4, 9e4], 2), (52, [2e5] * 4, 1)]
    rows += rows[:8]
    same(hard_negatives.mine(spark, vectors(spark, rows), every=5, block=20, group=3).collect(), slow_mine(rows, 5))
    assert hard_negatives.mine(spark, vectors(spark, [])).count() == 0
    assert hard_negatives.mine(spark, vectors(spark, [(1, [0.5], 1)])).count() == 0
    hot = [(k, [1.0, 0.5], k % 2) for k in range(300)]
    same(hard_negatives.mine(spark, vectors(spark, hot), every=3, group=8, block=32).collect(), slow_mine(hot, 3))
    near = [(k, [1.0 + k / 100, 0.5], k % 2) for k in range(300)]
    same(hard_negatives.mine(spark, vectors(spark, near), every=3, group=8, block=32).collect(), slow_mine(near, 3))


def test_large_components_are_exact(spark):
    r = random.Random(8)
    rows = [(k, [r.uniform(1e5, 2.5e5) for _ in range(40)], k % 3) for k in range(60)]
    rows = [(k, [float(np.float32(x)) for x in v], m) for k, v, m in rows]
    same(hard_negatives.mine(spark, vectors(spark, rows), every=6).collect(), slow_mine(rows, 6))
