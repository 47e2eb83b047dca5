"""MinHash near copies, the filter audit and vector codes against brute force, on odd rows and on whole tables."""

import hashlib
import math
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from test_operators import ROWS, SCHEMA, VOCABULARY, words

from ledgerlens.llm import filter_audit, minhash, vector_codes
from ledgerlens.llm.common import table

SF = "/root/testdata/sf0.001"
rng = np.random.default_rng(8)


def near_brute(rows, part=85):
    """(doc_id, size, component, kept) of each row, from all pairs of whole sets."""
    sets = []
    for _, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if (sets[a] and 100 * same >= part * len(sets[a] | sets[b])) or (sets[a] and sets[b] and rows[a][0] is not None and rows[a][0] == rows[b][0]):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        ids[find(k)].append(r[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    out = []
    for k, r in enumerate(rows):
        component = least[find(k)] if sets[k] else r[0]
        out.append((r[0], len(sets[k]), component, component is None or r[0] == component))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def copies(n, changes):
    base = rng.choice(VOCABULARY, 150)
    for k in range(n):
        own = base.copy()
        own[rng.choice(150, 1 + k % changes, replace=False)] = f"u{k}"
        yield " ".join(own)


@pytest.mark.parametrize("turns,block", [(2, 512), (1, 4)])
def test_near_copies(spark, monkeypatch, turns, block):
    monkeypatch.setattr(minhash, "TURNS", turns)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = [(r[0], r[1]) for r in ROWS] + [(1000 + k, t) for k, t in enumerate(copies(80, 7))]
    rows += [(None, t) for t in list(copies(4, 2))] + [(1003, "another text of the same number here"), (1003, "and a third one that is far away")]
    for n in (6, 7, 12, 20, 40):  # small sets, most bins empty
        own = list(rng.choice(VOCABULARY, n + 4))
        rows += [(2000 + n, " ".join(own)), (2100 + n, " ".join([*own, "more"])), (2200 + n, " ".join(["less", "less", *own]))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "r", "q", 1) for i, t in rows], SCHEMA).withColumnsRenamed({"_row": "root", "row": "key"})
    assert got(minhash.near_copies(docs)) == near_brute(rows)
    if block == 4:
        return
    assert minhash.near_copies(docs.limit(0)).count() == 0
    assert got(minhash.near_copies(docs.where("text IS NULL"))) == [(0, 0, 0, True)]
    with pytest.raises(ValueError):
        minhash.near_copies(docs, similarity=(70, 100))


def test_near_copies_of_whole_table(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    assert got(minhash.near_copies(docs)) == near_brute([tuple(r) for r in docs.collect()])


def test_signatures_agree_as_sets_do():
    """The share of agreeing bins estimates the similarity, for sets smaller than the bins too."""
    for size in (3, 12, 100, 2000):
        apart = []
        for _ in range(40):
            values = rng.integers(0, 2**63, size + size // 3, dtype=np.uint64)
            a, b = np.sort(values[:size]), np.sort(values[size // 3 :])
            s = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            apart.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(apart)) < 0.04


def audit_brute(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    failing = []
    for i, text, lang in docs:
        t, w = text or "", words(text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)}
        fails |= {"D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        failing.append((lang or "", i, {f for f in fails if fails[f]}))
    out = []
    for part in {p for p, _, _ in failing}:
        own = [(i, f) for p, i, f in failing if p == part]
        removed_in_all = defaultdict(int)
        rows = []
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                redundant = sum(name in f for _, f in own) - len(gone)
                left = [(i, f) for i, f in left if name not in f]
                removed_in_all[name] += len(gone)
                row = [part, "".join(order), step, len(left), len(gone), redundant, sum(f == {name} for _, f in own)]
                rows.append([*row, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name])
        out += [(*r[:-1], removed_in_all[r[-1]]) for r in rows]
    return sorted(out)


def test_audit(spark):
    rows = [(r[0], r[1], r[2] if k % 7 else None) for k, r in enumerate(ROWS)]
    rows += [(200 + k, t, ["", "fr", "de", None][k % 4]) for k, t in enumerate(["A B C", "x # y", "LOUD " * 120, " ".join(f"v{j}" for j in range(150)), "one", "", None] * 3)]
    rows += [rows[-1], (None, "one", "fr"), (None, None, None), (0, "one", "fr"), (0, "one", "fr"), (-5, "one", "de")]
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(40)] + [(3, None, None), (4, 1, 1), (4, 0, 0), (None, 1, 1), (200, 1, None), (203, None, 1), (900, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"part": docs_extra(), "failed": docs_extra(), "_id": docs_extra(), "digest": docs_extra()})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filter_audit.audit(docs, marks).collect())) == audit_brute(rows, labels)
    assert sorted(map(tuple, filter_audit.audit(docs, marks.limit(0)).collect())) == audit_brute(rows, [])
    assert filter_audit.audit(docs.limit(0), marks).count() == 0


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def codes_brute(rows, parts, entries, rounds):
    """Plain k-means in whole numbers, each distance evaluated."""
    kept = [(i, lab, [math.floor(1024 * float(x)) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = len(kept[0][2])
    cut = [(k * width // parts, (k + 1) * width // parts) for k in range(parts)]
    books = [[r[2][a:b] for r in kept[:entries]] for a, b in cut]

    def assign(p, v):
        a, b = cut[p]
        return min((sum((x - y) ** 2 for x, y in zip(v[a:b], c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p, (a, b) in enumerate(cut):
            near = defaultdict(list)
            for _, _, v in kept:
                near[assign(p, v)[1]].append(v[a:b])
            for e, vs in near.items():
                new[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for i, lab, v in kept:
        best = [assign(p, v) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
        by_label[lab] += out[-1][3]
    return sorted(((i, code, err, by_label[lab], sha) for i, lab, code, err in out), key=str)


VECTORS = "id long, vector array<float>, label string, code string"


def vector_rows(n, width):
    base = rng.normal(size=(n, width)).astype(np.float32)
    rows = [(k, [float(x) for x in v], f"l{k % 3}" if k % 4 else None) for k, v in enumerate(base)]
    rows += [(n, None, "a"), (n + 1, [None] * width, "a"), (n + 2, [float("nan")] * width, "a"), (n + 3, [float("inf")] * width, None), (n + 4, [1.0], "a")]
    return rows + [rows[0], rows[0], rows[5], (None, rows[7][1], None), (2, rows[9][1], "l1"), (n + 5, [0.0] * width, "z"), (n + 6, [0.0] * width, "z")]


@pytest.mark.parametrize("n,width,entries", [(300, 16, 32), (40, 10, 256), (12, 0, 4)])
def test_codes(spark, n, width, entries):
    rows = vector_rows(n, width)
    if not width:
        rows = [r for r in rows if r[0] != n + 4]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    done = vector_codes.encode(vectors, entries=entries)
    assert got(done.select("id", "code", "error", "label_error", "codebooks_sha256")) == codes_brute(rows, 4, entries, 4)


def test_codes_of_nothing(spark):
    vectors = spark.createDataFrame([(1, None, "a", "x"), (2, [float("nan")], "a", "x")], VECTORS)
    assert vector_codes.encode(vectors).count() == 0 and vector_codes.encode(vectors.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.encode(vectors, entries=257)


def test_bounds_spare_evaluations():
    """The pivots' bounds rule entries out where the points lie in groups, and never change the result."""
    centres = rng.integers(-4000, 4000, (64, 16))
    points = centres[rng.integers(0, 64, 3000)] + rng.integers(-60, 60, (3000, 16))
    entries = np.concatenate([centres, centres[:8], centres + 300])
    pivots = vector_codes.far_apart(entries, vector_codes.PIVOTS)
    which, best, evaluated = vector_codes.nearest(points, vector_codes.distances(points, pivots), entries, vector_codes.distances(entries, pivots))
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (which == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert evaluated < every.size / 3
