import re

import corpus_pipeline
from ledgerlens.llm.common import table

SF = "/root/testdata/sf0.001"


def near_copies(texts):
    """Smallest doc_id of each group, by comparing all pairs of shingle sets."""
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    least = {i: i for i in sets}
    order = sorted(sets)
    for a in order:
        for b in order:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = sorted((least[a], least[b]), reverse=True)
                least = {i: new if g == old else g for i, g in least.items()}
    return set(least.values())


def test_stages_keep_columns_and_one_near_copy(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"]
    kept = stages["near_duplicates"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == near_copies({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} <= {r.doc_id for r in docs.collect()}


def odd_documents(spark):
    """Clashing names, nulls, repeated rows and one near copy."""
    base = " ".join(f"w{k}" for k in range(80))
    rows = [(1, base, "en", "a", 300, 7, 8, 9), (2, base + " more", "en", "a", 305, 7, 8, 9), (3, None, None, None, None, 1, 2, 3), (3, None, None, None, None, 1, 2, 3)]
    rows += [(None, "no number here at all\nsecond line", "en", None, 9, 5, 5, 5), (9, "", "en", "b", 0, 0, 0, 0), (10, "a line of words\nanother line of words", "fr", "b", 9, 4, 4, 4)]
    rows += [(11, "a line of words\nanother line of words\nand its own", "fr", "b", 9, 4, 4, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines int, _gone int, n_removed int")


def test_stages_on_clashing_names(spark):
    docs = odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    lines = stages["line_dedup"](spark, docs, SF)
    assert lines.columns == docs.columns
    got = {(r.doc_id, r.text): (r.n_lines, r.n_removed, r._gone) for r in lines.collect()}
    assert got[11, "and its own"] == (4, 4, 4) and got[1, docs.first().text] == (7, 9, 8) and got[3, None] == (1, 3, 2)
    kept = stages["near_duplicates"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 3, 3, None, 9, 10, 11]))
    assert stages["line_dedup"](spark, docs.limit(0), SF).count() == 0 and stages["near_duplicates"](spark, docs.limit(0), SF).count() == 0
