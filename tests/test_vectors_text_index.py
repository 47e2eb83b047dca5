"""Similar vectors, the text index and value lookup against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerlens.operators import retrieve as r
from ledgerlens.operators import vectors as v

rng = np.random.default_rng(4)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), None if row is None else [float(y) for y in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<double>")


def brute(ids, x, least):
    x = np.array(x)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    sims = unit @ unit.T
    i, j = np.nonzero(sims >= least)
    return sorted((ids[a], ids[b], round(float(sims[a, b]), 6)) for a, b in zip(i, j) if ids[a] < ids[b])


def clustered(n, groups, width, noise):
    centres = rng.normal(size=(groups, width))
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, width)) * noise


@pytest.mark.parametrize("least", [0.3, 0.75])
@pytest.mark.parametrize("block,visitors", [(4096, 1 << 20), (16, 200)])
def test_similar_pairs(spark, least, block, visitors):
    x = [*clustered(500, 12, 16, 0.3), *rng.normal(size=(100, 16))]
    x[40:70] = [x[7]] * 30  # a common vector
    x += [np.zeros(16), 3 * x[7], -x[7]]
    ids = list(rng.permutation(len(x)) + 10)
    got = sorted((p.a, p.b, round(p.similarity, 6)) for p in v.similar_pairs(frame(spark, ids, x), least, block, visitors).collect())
    assert got == brute([int(i) for i in ids], x, least)


def test_similar_pairs_of_odd_tables(spark):
    few = frame(spark, [1, 2, 3], [None, np.zeros(4), np.ones(4)])
    assert v.similar_pairs(few).count() == 0 and v.similar_pairs(few.limit(0)).count() == 0
    with pytest.raises(ValueError):
        v.similar_pairs(few, 0)


def test_vectors_visit_few_cells():
    """No bound is wrong, and vectors in groups are sent to few of the cells."""
    x = v._unit(clustered(3000, 60, 24, 0.12))
    pivots = x[:64]
    home = v._distances(x, pivots).argmin(axis=1)
    own = v._distances(x, pivots)
    size = np.bincount(home, minlength=64)
    low, high = np.zeros((64, 16)), np.zeros((64, 16))
    for c in np.flatnonzero(size):
        low[c], high[c] = own[home == c][:, :16].min(axis=0), own[home == c][:, :16].max(axis=0)
    radius = np.array([own[home == c, c].max(initial=0) for c in range(64)])
    cells = v.Cells(pivots, size, radius, low, high)
    for least, share in ((0.95, 0.05), (0.75, 0.2)):
        reach = math.sqrt(2 - 2 * least)
        i, j = cells.visits(x, home, reach)
        assert len(i) < share * len(x) * 64
        sent = set(zip(i.tolist(), j.tolist()))
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        assert all(home[p] == home[q] or (p, home[q]) in sent or (q, home[p]) in sent for p, q in zip(a.tolist(), b.tolist()))


def test_similarities_of_a_type(spark):
    x = rng.normal(size=(40, 8))
    typed = frame(spark, range(40), x).withColumn("type", F.when(F.col("vec_id") % 4 == 0, "column").otherwise("table"))
    asked = spark.createDataFrame([("q", [float(y) for y in x[3]])], "query_id string, embedding array<double>")
    every, some = v.similarities(typed, asked, -1.0), v.similarities(typed, asked, -1.0, types=["column"])
    assert every.count() == 40 and {p.vec_id for p in some.collect()} == set(range(0, 40, 4))
    best = sorted(every.collect(), key=lambda p: (-p.score, p.vec_id))[:5]
    assert [(p.vec_id, p.score) for p in v.top_k(typed, asked, 5).orderBy("rank").collect()] == [(p.vec_id, p.score) for p in best]


def bm25_brute(chunks, queries, top):
    words = {k: [w for w in re.split(r"[^\w-]+", t.lower()) if w] for k, t in chunks}
    average, n = sum(map(len, words.values())) / len(words), len(words)
    counts = {k: Counter(w) for k, w in words.items()}
    df = Counter(w for c in counts.values() for w in c)
    out = []
    for q, text in queries:
        scores = Counter()
        for term in {w.lower() for w in re.split(r"[^\w-]+", text) if len(w) > 1}:
            idf = max(math.log((n - df[term] + 0.5) / (df[term] + 0.5)), 1e-6) if df[term] else 0
            for k, c in counts.items():
                if c[term]:
                    scores[k] += idf * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * len(words[k]) / average))
        best = sorted(scores, key=lambda k: (-round(scores[k], 9), k))
        out += [(q, place, *k, round(scores[k], 6)) for place, k in enumerate(best[:top], 1)]
    return out


@pytest.mark.parametrize("shard", [7, 1024])
def test_bm25_by_blocks(spark, shard):
    vocabulary = [f"t{i}" for i in range(60)]
    odds = 1 / np.arange(1, 61)
    chunks = [((d, c), "the " + " ".join(rng.choice(vocabulary, rng.integers(0, 40), p=odds / odds.sum()))) for d in range(60) for c in range(3)]
    chunks += [((900, 0), ""), ((901, 0), "alone")]
    queries = [(i, " ".join(["the", *rng.choice(vocabulary, 15)])) for i in range(12)] + [(50, "nowhere"), (51, "alone the"), (52, "")]
    table = spark.createDataFrame([(*k, t) for k, t in chunks], "doc_id int, chunk_index int, content string")
    asked = spark.createDataFrame(queries, "query_id int, query string")
    index = r.text_index(table, shard)
    longest = index.blocks.agg(F.max(F.size("postings"))).first()[0]
    assert longest <= (4 * shard if shard == 7 else len(chunks))  # a word of every chunk is cut into blocks
    for top in (1, 4, None):
        want = {x[:1] + x[2:4]: (x[1], x[4]) for x in bm25_brute(chunks, queries, top)}
        got = {(h.query_id, h.doc_id, h.chunk_index): (h["rank"] if top else want[h.query_id, h.doc_id, h.chunk_index][0], h.relevance) for h in r.bm25(index, asked, top).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in got)


def grams(text):
    return {text[i : i + 3] for i in range(len(text) - 2)} if len(text) >= 3 else {text}


def lookup_brute(values, literals):
    out, rows = [], {(c, value, re.sub(r"\s+", " ", value.strip().lower())) for c, value in values}
    rows = {x for x in rows if len(x[2]) >= 2}
    for literal in literals:
        lit = re.sub(r"\s+", " ", literal.strip().lower())
        if len(lit) < 2:
            continue
        exact = {(literal, c, value, "exact", None) for c, value, normal in rows if lit in normal or normal in lit}
        shared = Counter()
        for c, _, normal in rows:
            shared[c] += len(grams(lit) & grams(normal))
        near = {(literal, c, max(value for k, value, normal in rows if k == c and grams(lit) & grams(normal)), "near", n) for c, n in shared.items() if n >= 2}
        out += exact or near
    return sorted(out, key=str)


def test_lookup_of_many(spark):
    letters = list("abcd ")
    word = lambda low, high: "".join(rng.choice(letters, rng.integers(low, high)))
    values = [(f"c{rng.integers(0, 5)}", word(1, 9)) for _ in range(300)] + [("c1", "Abc"), ("c1", "abc"), ("c2", "abca" * 5)]
    literals = sorted({word(1, 7) for _ in range(60)} | {"zzz", "abca" * 6, "q", "dcdcdc"})
    index = r.value_index(spark.createDataFrame([("t", *x) for x in values], "table_name string, column_name string, value string"))
    found = r.lookup_values(index, spark.createDataFrame([(x,) for x in literals], "literal string")).collect()
    assert sorted(((x.literal, x.column_name, x.sample, x.match, x.shared) for x in found), key=str) == lookup_brute(values, literals)


def test_scores_of_a_shard_make_no_row_a_posting(spark):
    """Postings meet queries by shard: the plan holds no explode of postings, and equal scores of many chunks keep their order over shards."""
    chunks = [(d, 0, "the red fox" if d % 2 else "the dog the") for d in range(200)]
    index = r.text_index(spark.createDataFrame(chunks, "doc_id int, chunk_index int, content string"), 16)
    asked = spark.createDataFrame([(None, "fox"), (1, "the fox"), (2, "dog fox"), (3, "nothing")], "query_id int, query string")
    every = r.bm25(index, asked, None)
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "explode(postings" not in plan
    assert sorted(rows(every.groupBy("query_id").count()), key=str) == sorted([(None, 100), (1, 200), (2, 200)], key=str)
    best = r.bm25(index, asked, 3).where("query_id is not null").orderBy("query_id", "rank").collect()
    assert [(h.query_id, h.doc_id) for h in best if h.query_id == 1] == [(1, 1), (1, 3), (1, 5)] and len({h.relevance for h in best if h.query_id == 1}) == 1
    the = index.blocks.where("term = 'the'").agg(F.sum("n"), F.max("max_tf"), F.min("min_length"), F.sum(F.size("postings"))).first()
    assert tuple(the) == (200, 2, 3, 200)


def test_index_is_all_that_is_written_of_the_texts(spark, tmp_path):
    """T04 filled the disk: chunks, counted words and postings were written one after the other and shuffled twice with their ids."""
    import os
    from pathlib import Path

    from ledgerlens.plans import retrieve_plans as plans
    from ledgerlens.plans.registry import Tables
    from ledgerlens.session import shared_dir

    source = "/root/testdata/sf0.01"
    for table in ("documents", "benchmark", "embeddings"):
        os.symlink(f"{source}/{table}.parquet", tmp_path / f"{table}.parquet")  # a folder that has no index yet
    held = lambda: sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if p.is_file())
    t, before = Tables(spark, str(tmp_path)), held()
    found = plans.t04(t)
    assert found.count() == Tables(spark, source).benchmark.count() * 3 + 3 * t.embeddings.select("label").distinct().count()
    assert held() - before < 1.5 * os.path.getsize(f"{source}/documents.parquet")
    index = plans.text_index(t)
    assert index.blocks.schema["postings"].dataType.elementType.typeName() == "integer"  # a posting is a place, its ids are listed once
    assert "Exchange" not in r.counted_chunks(plans.chunked(t))._jdf.queryExecution().executedPlan().toString()


def test_shards_go_on_over_batches(spark):
    """Shards of seven chunks from batches of three; ids are texts, one is null, and so is a text."""
    words = ["the", "fox", "red", "dog", "ab"]
    chunks = [(f"d{d:02}" if d else None, c, " ".join(rng.choice(words, rng.integers(1, 9))) if d != 5 else None) for d in range(20) for c in range(2)]
    asked = spark.createDataFrame([("a", "the fox"), (None, "dog"), ("b", "red the ab")], "query_id string, query string")
    table = spark.createDataFrame(chunks, "doc_id string, chunk_index int, content string").coalesce(1)
    want = rows(r.bm25(r.text_index(table), asked, None))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        index = r.text_index(table, 7)
        assert sorted(len(x.chunks) for x in index.counted.collect()) == [5, 7, 7, 7, 7, 7]
        assert index.blocks.agg(F.max("n")).first()[0] <= 7 and rows(r.bm25(index, asked, None)) == want
        terms = asked.select(F.explode(F.split("query", " ")).alias("term")).where("term in ('dog', 'ab')")
        assert {x.term for x in r._may_be_asked(index.blocks, terms).collect()} == {"dog", "ab"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
