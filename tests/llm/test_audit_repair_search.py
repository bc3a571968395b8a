"""Source divergence, structure repair and nearest neighbours against brute force, on small tables with every odd case."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import divergence, neighbours, turn_repair

# 11 ------------------------------------------------------------------------------------------------------------------------

DOCS = "doc_id bigint, text string, lang string, source string, n bigint, item string, value int, term string"


def divergences(rows, k, least=3):
    docs = [(t or "", lang or "", s or "") for _, t, lang, s, *_ in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    said = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)), lang, s) for t, lang, s in docs]
    held, n, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for own, lang, s in said:
        held[lang].update(set(own))
        n[lang, s].update(own)
        whole[lang].update(own)
    out = []
    for lang, s in n:
        kept = [t for t, c in held[lang].items() if c >= least]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        def f(p, q):
            return (p - q) ** 2 // q

        p, q = shares(n[lang, s]), shares(whole[lang])
        terms = [(f(p[t], q[t]), t) for t in kept if n[lang, s][t] and p[t] > q[t]]
        pairs = [(sum(f(p[t], o[t]) for t in kept), x) for x in [b for a, b in n if a == lang and b != s] for o in [shares(n[lang, x])]]
        for part, found in (("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:k]), ("pair", sorted(pairs, key=lambda x: (-x[0], x[1].encode())))):
            out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def sources(seed, n):
    rng = random.Random(seed)
    words = ["Thé", "the", "ÉTÉ", "été", "a", "b", "ab", "abc", "日本", "x" * 3000, "né e", *(f"r{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150))]
    rows = [(i, rng.choice([" ", "1", "-", "\x00"]).join(rng.choices(words, k=rng.choice([0, 1, 5, 60]))), rng.choice(["en", "fr"]), rng.choice(["s1", "s2", "s3", "s3", "s3"]), 1, "clash", 2, "clash") for i in range(n)]
    rows += [(None, None, None, None, None, None, None, None), (1, "only here", None, "s1", 1, "c", 1, "c"), (1, "", "xx", "empty", 1, "c", 1, "c"), (1, "12 3", "xx", "other", 1, "c", 1, "c"), rows[0], rows[0]]
    rows += [(7, "the the", "de", None, 0, "", 0, ""), (8, "the", "de", None, 0, "", 0, ""), (9, "THE", "de", None, 0, "", 0, "")]
    return rows


@pytest.mark.parametrize("k", [5, 200])
def test_divergence(spark, k):
    rows = sources(11, 120)
    got = divergence.divergence(spark.createDataFrame(rows, DOCS).repartition(3), k=k).collect()
    assert sorted(tuple(r) for r in got) == divergences(rows, k)


def test_divergence_of_nothing(spark):
    got = divergence.divergence(spark.createDataFrame([], DOCS))
    assert got.collect() == [] and got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_radix_selection_in_many_rounds(spark):
    """One hot group, values in ties far beyond what is sorted, items that begin alike, groups smaller than k."""
    rng = random.Random(12)
    rows = [("hot", "g", f"same{'x' * 40}{i:05d}", rng.choice([0, 7, 7, 7, 1 << 59, 3])) for i in range(3000)]
    rows += [("cold", str(i % 5), "é" * (i % 7) + str(i), rng.randrange(1 << rng.choice([1, 20, 60]))) for i in range(200)] + [("one", "", "", 0)]
    table = spark.createDataFrame(rows, "lang string, source string, item string, value bigint").repartition(4)
    for k in (1, 40, 1700):
        want = []
        for key in {r[:2] for r in rows}:
            own = sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[3], r[2].encode()))[:k]
            want += [(*r, i) for i, r in enumerate(own, 1)]
        got = divergence.top_by_radix(table, ["lang", "source"], k, small=4, bits=3).select("lang", "source", "item", "value", "rank").collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


# 12 ------------------------------------------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, n int, sha string, first string"


def mended(rows):
    """Of (role, text) in order: blank, duplicate, truncated, illegal, cost, audit, digest, by a shortest path over (row, state)."""
    seen, faults = set(), []
    for r in rows:
        text = r[1].strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not text else "duplicate" if r in seen else "truncated" if text[-1] not in ".!?" else "")
        seen.add(r)
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    edit = {0: 2, 1: 2, 2: 3, 3: 2}
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, q, said = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            break
        if (i, q) in done:
            continue
        done.add((i, q))
        role = {2: "user", 3: "assistant"}
        heapq.heappush(heap, (cost + 5, audit + "I", i, edit[q], (*said, role[edit[q]] + ":")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, said))
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, edit[q], (*said, f"{role[edit[q]]}:{rows[i][1]}")))
                if (to := step.get(rows[i][0][:1], {}).get(q)) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*said, f"{rows[i][0]}:{rows[i][1]}")))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    kinds = Counter(faults)
    return kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def repairs(rows):
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        convs[c].append((t, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in own if t is not None]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *mended([r[1:] for r in own]))
    return out


def conversations(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "Done. \n", "", " \t", "é", "other.", "more?", None]
    rows = []
    for c in range(150):
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts) if rng.random() < 0.4 else f"say {rng.random()}{rng.choice('.!?x')}"))
    rows += [(900, t, "user" if t % 2 == 0 else rng.choice(["assistant", "user"]), f"{t}" + rng.choice([".", ".", "", "!"])) for t in range(700)]
    rows += [(901, t, "user", "again.") for t in range(300)] + [(902, None, "system", f"s{t}.") for t in range(150)] + [(902, 1, "assistant", "x" * 100_000)]
    rows += [(903, 5, "user", "same.")] * 90 + [(None, 1, "user", "hi."), (None, 2, "assistant", "ho."), (904, -3, "assistant", "."), (904, 9, "s", "a.")]
    rng.shuffle(rows)
    return [(*r, 1, "clash", "clash") for r in rows]


_NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("piece", [3, 64])
def test_repair(spark, piece, monkeypatch):
    monkeypatch.setattr(turn_repair, "PIECE", piece)
    rows = conversations(21)
    got = {r["conv_id"]: tuple(r[c] for c in _NAMES) for r in turn_repair.repair(spark.createDataFrame(rows, TURNS).repartition(3), parts=7).collect()}
    want = repairs(rows)
    assert got == want


def test_repair_of_damage(spark):
    rng = random.Random(22)
    rows = [(c, t, role, f"t{rng.randrange(4)}{rng.choice('.?x')}", 1, "", "") for c in range(300) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"][: rng.choice([1, 3, 5])])]
    rows += [(None, None, None, None, None, None, None)]
    damaged = []
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            damaged += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows} | repairs(damaged)
    got = {r["conv_id"]: tuple(r[c] for c in _NAMES) for r in turn_repair.repair_damaged(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == want
    assert turn_repair.repair_damaged(spark.createDataFrame([], TURNS)).collect() == []


# 13 ------------------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, cls int, vec string, score double"


def exact(rows, k=5):
    """query row -> (vec_id, score) of the k nearest other rows, for each query row in order."""
    held = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = defaultdict(list)
    for a, (i, v) in enumerate(held):
        if i % 50 == 0:
            near = sorted((-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), j) for b, (j, w) in enumerate(held) if b != a and len(w) == len(v))
            out[i].append([(j, -s) for s, j in near[:k]])
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(31)
    rows = [(i, np.float32(rng.normal(size=24)).tolist(), 1, "clash", 0.5) for i in range(1500)]
    hot = np.float32(rng.normal(size=24)).tolist()
    rows += [(2000 + i, hot, 1, "", 0.0) for i in range(700)] + [(3000, None, 1, "", 0.0), (3050, [0.0] * 24, 1, "", 0.0), (3100, [1.0, None], 1, "", 0.0), (3150, [float("nan"), 1.0], 1, "", 0.0), (None, hot, 1, "", 0.0)]
    rows += [(3200, [], 1, "", 0.0), (3250, [float("inf")] * 24, 1, "", 0.0), (4000, [1.0, 2.0], 1, "", 0.0), (4001, [2.0, 4.0], 1, "", 0.0), (4002, [-1.0, 2.0], 1, "", 0.0), rows[0], rows[0], (50, hot, 1, "", 0.0), (4050, [1e-30] * 24, 1, "", 0.0), (4051, [1e30] * 24, 1, "", 0.0)]
    got = defaultdict(list)
    for r in neighbours.neighbours(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = exact(rows)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, lists in want.items():
        assert sorted(r for r, _, _ in got[q]) == sorted(i + 1 for one in lists for i in range(len(one)))
        found = Counter((v, round(s, 12)) for _, v, s in got[q])
        total += sum(map(len, lists))
        hits += sum((found & Counter((v, round(s, 12)) for one in lists for v, s in one)).values())
    assert hits / total >= 0.9
    assert [v for _, v, _ in sorted(got[2100])] == [50, 2000, 2001, 2002, 2003]
    assert [v for _, v, _ in sorted(got[4000])] == [4001, 4002]


def test_all_candidates_if_there_are_few(spark):
    rows = [(0, [1.0, 0.0, 0.0], 1, "", 0.0), (1, [-1.0, 0.0, 0.0], 1, "", 0.0), (2, [0.0, 0.0, 1.0], 1, "", 0.0), (100, [5.0], 1, "", 0.0)]
    got = neighbours.neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, tables=1, target=0.01).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2, 0.0), (0, 2, 1, -1.0)]
    assert neighbours.neighbours(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("count", [100, 4096 * 700, 4096 * 70_000])
def test_codes(count):
    """The first code probed is a vector's own, whether or not a second hash refines codes; a rotation keeps lengths."""
    h = neighbours.Hashes(50, count, 3, 7)
    x = neighbours._unit(np.random.default_rng(3).normal(size=(40, 50)))
    assert h.size == 64 and h.codes <= neighbours.MOST_CODES and (count < 10**6 or h.axes)
    for t in range(3):
        order = h.order(x, t)
        assert (order[:, 0] == h.code(x, t)).all() and (np.sort(order, 1) == np.arange(h.codes)).all()
    assert np.allclose((h.turned(x, 0, 0) ** 2).sum(1), 1)
