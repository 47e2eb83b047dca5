"""Relationship discovery between columns.

Exact overlap of all column pairs comes from one grouping: every distinct value gets the set of columns that hold it, equal
sets are counted, and only those few counted sets are expanded into pairs. Rows never meet rows, so a value that occurs
everywhere costs as much as any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.names import (
    comments_agree,
    comments_contradict,
    label_similarity,
    name_similarity,
    synonym_groups,
)
from ledgerlens.operators import profile
from ledgerlens.session import cut_lineage

SKETCH_SLOTS = 128
CONTAINMENT_MIN = 0.8
PUBLISH_MIN = 0.95
GREY_MIN = 0.8
JOINABLE_MIN = 0.1
SIMILARITY_MIN = 0.5
CORRELATION_MIN = 0.5
ALIGNED_ROWS_MIN = 5
LOW_CARDINALITY = 32

KEY = ["table_name", "column_name"]


def _distinct(values: DataFrame) -> DataFrame:
    """Distinct trimmed, non-empty values per column (the long table is nearly that already)."""
    trimmed = values.select(*KEY, F.trim("value").alias("value")).where("value <> ''")
    return trimmed.distinct()


def relation_values(tables: Mapping[str, DataFrame], columns: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Distinct values of the columns (all scalar ones by default) with counts, for comparing columns.

    Rows (table_name, column_name, value, folded, chars, cipher, secret, cnt): ``folded`` is the value without case; values over 64 characters are digests, made
    before any shuffle. ``chars``, ``cipher`` and ``secret`` describe the whole value and decide which columns look encrypted.
    """
    text, whole = F.col("value"), F.trim("value")
    facts = F.struct(
        profile.short_value(F.lower(text)).alias("folded"), F.length(whole).alias("chars"), profile.looks_cipher(whole).alias("cipher"), profile.looks_secret(text).alias("secret")
    )
    # a short value is the text itself and gives its facts once it is counted; a long one is read where it stands
    short = F.coalesce(F.octet_length(text) <= profile.DIGEST_OVER, F.lit(True))
    parts = []
    for name, df in tables.items():
        cells = profile.unpivoted(df, columns[name] if columns else profile.scalar_columns(df))
        cells = cells.select("column_name", profile.short_value(text).alias("value"), F.when(~short, facts).alias("facts"))
        counted = cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("cnt"))
        counted = counted.select("column_name", "value", F.coalesce("facts", facts).alias("facts"), "cnt")
        parts.append(counted.select(F.lit(name).alias("table_name"), "column_name", "value", "facts.*", "cnt"))
    return reduce(DataFrame.unionByName, parts)


def skipped_columns(tables: Mapping[str, DataFrame], values: DataFrame) -> list[tuple[str, str]]:
    """Columns that take no part in relations: temporal, large or encrypted ones; ``values`` come from :func:`relation_values`.

    Only facts of columns reach the driver. Characters are counted for the columns alone whose lengths and forms already look encrypted.
    """
    types = [(n, f.name, f.dataType.simpleString()) for n, df in tables.items() for f in df.schema.fields]
    out = {(t, c) for t, c, kind in types if profile.is_temporal(c, kind) or profile.is_large(kind)}
    facts = values.where("chars > 0").groupBy(*KEY).agg(
        F.avg("chars").alias("chars"), F.avg(F.col("cipher").cast("int")).alias("cipher"), F.bool_or("secret").alias("secret")
    )
    suspects: dict[str, list[str]] = {}
    for row in facts.where("secret or (chars >= 24 and cipher >= 0.5 and (cipher >= 0.8 or chars >= 40))").collect():
        if row.secret:
            out.add((row.table_name, row.column_name))
        else:
            suspects.setdefault(row.table_name, []).append(row.column_name)
    if suspects:
        entropy = profile.char_entropy(profile.long_values({n: tables[n] for n in suspects}, suspects))
        out |= {(r.table_name, r.column_name) for r in entropy.where(F.col("entropy") >= profile.CIPHER_ENTROPY).collect()}
    return sorted(out)


def minhash_sketch(values: DataFrame, slots: int = SKETCH_SLOTS) -> DataFrame:
    """Per column the smallest xxhash64 of its distinct values under each of ``slots`` seeds, plus the cardinality."""
    agg = _distinct(values).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("cardinality"),
        *[F.min(F.xxhash64("value", F.lit(i))).alias(f"h{i}") for i in range(slots)],
    )
    return agg.select(*KEY, "cardinality", F.array(*[f"h{i}" for i in range(slots)]).alias("sketch"))


def sketch_containment(sketches: DataFrame, minimum: float = CONTAINMENT_MIN) -> DataFrame:
    """Column pairs of different tables whose estimated containment reaches ``minimum``.

    Only equal slots are joined. No pair is cut off; :func:`containment` is the exact form.
    """
    slots = sketches.select(*KEY, "cardinality", F.size("sketch").alias("n"), F.posexplode("sketch").alias("seed", "h"))
    a, b = slots.alias("a"), slots.alias("b")
    hits = a.join(b, F.expr("a.seed = b.seed and a.h = b.h and a.table_name <> b.table_name"))
    matched = hits.groupBy(
        F.col("a.table_name").alias("child_table"),
        F.col("a.column_name").alias("child_column"),
        F.col("b.table_name").alias("parent_table"),
        F.col("b.column_name").alias("parent_column"),
        F.col("a.cardinality").alias("child_distinct"),
        F.col("b.cardinality").alias("parent_distinct"),
        F.col("a.n").alias("slots"),
    ).agg(F.count(F.lit(1)).alias("matches"))
    jaccard = F.col("matches") / F.col("slots")
    shared = jaccard * (F.col("child_distinct") + F.col("parent_distinct")) / (1 + jaccard)
    out = matched.withColumn("estimated", F.least(F.lit(1.0), shared / F.col("child_distinct")))
    return out.where(F.col("estimated") >= minimum)


def _signatures(values: DataFrame) -> DataFrame:
    """The different sets of columns that hold a value, each with its number of values: the values are shuffled once, all overlaps and cardinalities follow from these few rows."""
    trimmed = values.select(*KEY, F.trim("value").alias("value")).where("value <> ''")
    holders = trimmed.groupBy("value").agg(F.sort_array(F.collect_set(F.struct(*KEY))).alias("holders"))
    return cut_lineage(holders.groupBy("holders").agg(F.count(F.lit(1)).alias("n")))


def shared_values(values: DataFrame, touching: list[str] | None = None) -> DataFrame:
    """Ordered column pairs (a, b) of different tables with the number of distinct values both hold.

    ``touching`` keeps pairs with a column of at least one of these tables.
    """
    return _shared(_signatures(values), touching)


def _shared(signatures: DataFrame, touching: list[str] | None = None) -> DataFrame:
    if touching is not None:
        signatures = signatures.where(F.exists("holders", lambda h: h.getField("table_name").isin(*touching)))
    left = signatures.where(F.size("holders") > 1).select("holders", "n", F.explode("holders").alias("a"))
    pairs = left.select("a", "n", F.explode("holders").alias("b")).where("a.table_name <> b.table_name")
    if touching is not None:
        pairs = pairs.where(F.col("a.table_name").isin(*touching) | F.col("b.table_name").isin(*touching))
    return pairs.groupBy(
        F.col("a.table_name").alias("a_table"),
        F.col("a.column_name").alias("a_column"),
        F.col("b.table_name").alias("b_table"),
        F.col("b.column_name").alias("b_column"),
    ).agg(F.sum("n").alias("shared"))


def _sizes(signatures: DataFrame) -> DataFrame:
    """Distinct values per column."""
    return signatures.select("n", F.explode("holders").alias("h")).groupBy("h.table_name", "h.column_name").agg(F.sum("n").alias("n_distinct"))


def folded_overlaps(values: DataFrame) -> DataFrame:
    """Column pairs of different tables, each once, with the distinct values of either side that the other holds in any case."""
    folded = F.trim("folded" if "folded" in values.columns else F.lower("value"))
    spelled = values.select(*KEY, F.trim("value").alias("value"), folded.alias("folded")).where("value <> ''").distinct()
    spelled = spelled.groupBy(*KEY, "folded").agg(F.count(F.lit(1)).alias("n"))
    holders = spelled.groupBy("folded").agg(F.array_sort(F.collect_list(F.struct(*KEY, "n"))).alias("holders"))
    signatures = holders.where(F.size("holders") > 1).groupBy("holders").agg(F.count(F.lit(1)).alias("times"))
    left = signatures.select("holders", "times", F.explode("holders").alias("a"))
    pairs = left.select("a", "times", F.explode("holders").alias("b")).where("a.table_name < b.table_name")
    return pairs.groupBy(
        F.col("a.table_name").alias("a_table"),
        F.col("a.column_name").alias("a_column"),
        F.col("b.table_name").alias("b_table"),
        F.col("b.column_name").alias("b_column"),
    ).agg(F.sum(F.col("times") * F.col("a.n")).alias("a_shared"), F.sum(F.col("times") * F.col("b.n")).alias("b_shared"))


def cardinalities(values: DataFrame) -> DataFrame:
    """Distinct trimmed, non-empty values per column."""
    return _distinct(values).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_distinct"))


def _with_side(pairs: DataFrame, facts: DataFrame, side: str, columns: list[str]) -> DataFrame:
    renamed = facts.select(
        F.col("table_name").alias(f"{side}_table"),
        F.col("column_name").alias(f"{side}_column"),
        *[F.col(c).alias(f"{side}_{c}") for c in columns],
    )
    return pairs.join(renamed, [f"{side}_table", f"{side}_column"])


def containment(values: DataFrame, touching: list[str] | None = None) -> DataFrame:
    """Exact containment of every column in every column of another table it shares a value with."""
    signatures = _signatures(values)
    pairs = _with_side(_shared(signatures, touching), _sizes(signatures), "a", ["n_distinct"])
    return pairs.select(
        F.col("a_table").alias("child_table"),
        F.col("a_column").alias("child_column"),
        F.col("b_table").alias("parent_table"),
        F.col("b_column").alias("parent_column"),
        "shared",
        F.col("a_n_distinct").alias("child_distinct"),
        (F.col("shared") / F.col("a_n_distinct")).alias("containment"),
    )


def exists_containment(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Distinct child values and how many of them the parent holds, for one pair."""
    keys = child.select(F.col(child_col).cast("string").alias("k")).where("k is not null").distinct()
    known = parent.select(F.col(parent_col).cast("string").alias("k")).distinct()
    hit = keys.join(known.withColumn("hit", F.lit(1)), "k", "left")
    return hit.agg(F.count(F.lit(1)).alias("child_distinct"), F.count("hit").alias("present"))


def is_parent_key(primary: Column, n_distinct: Column, n_rows: Column, null_rate: Column) -> Column:
    """Declared key, or nearly unique, nearly complete and not tiny."""
    ratio = F.when(n_rows == 0, 0.0).otherwise(n_distinct / F.greatest(n_rows, n_distinct))
    return primary | ((ratio >= 0.98) & (null_rate <= 0.05) & (n_distinct >= 8))


def parent_keys(stats: DataFrame, declared: list[tuple[str, str]] = ()) -> DataFrame:
    """Per column: declared or measured parent key, and the weight a key gives to an overlap."""
    primary = reduce(
        lambda a, b: a | b,
        [(F.col("table_name") == t) & (F.col("column_name") == c) for t, c in declared],
        F.lit(False),
    )
    key = is_parent_key(primary, F.col("n_distinct"), F.col("n_rows"), F.col("null_rate"))
    ratio = F.col("n_distinct") / F.greatest("n_rows", "n_distinct")
    weight = F.when(key, 1.0).when((ratio >= 0.8) & (F.col("null_rate") <= 0.05), 0.7).otherwise(0.35)
    return stats.select(*KEY, "n_distinct", "n_rows", key.alias("is_key"), weight.alias("key_weight"))


def measure_relations(values: DataFrame, keys: DataFrame, comments: DataFrame, skip: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Score each unordered column pair of different tables: overlap into the stronger key, names, comments, veto.

    Values are compared without case. Columns named in ``skip`` (see :func:`skipped_columns`) are left out before any value is grouped.
    """
    facts = keys.join(comments, KEY, "left")
    cols = ["n_distinct", "is_key", "key_weight", "comment"]
    for table, column in skip:
        values = values.where(~((F.col("table_name") == table) & (F.col("column_name") == column)))
    j = _with_side(_with_side(folded_overlaps(values), facts, "a", cols), facts, "b", cols)
    into_b, into_a = F.col("a_shared") / F.col("a_n_distinct"), F.col("b_shared") / F.col("b_n_distinct")
    overlap = F.when(F.col("b_key_weight") >= F.col("a_key_weight"), into_b * F.col("b_key_weight")).otherwise(
        into_a * F.col("a_key_weight")
    )
    contradict = comments_contradict(F.col("a_comment"), F.col("b_comment"))
    low = (
        (F.col("a_n_distinct") <= LOW_CARDINALITY)
        & (F.col("b_n_distinct") <= LOW_CARDINALITY)
        & ~F.col("a_is_key")
        & ~F.col("b_is_key")
    )
    shape = F.when(F.col("a_is_key") != F.col("b_is_key"), 1.0).when(F.col("a_is_key") & F.col("b_is_key"), 0.6).otherwise(0.2)
    score = F.when(contradict, 0.0).otherwise(F.least(F.lit(1.0), overlap))
    veto = contradict | low
    status = F.when(veto, "veto").when(score >= PUBLISH_MIN, "publish").when(score >= GREY_MIN, "grey").otherwise("drop")
    return j.select(
        F.concat_ws(".", "a_table", "a_column").alias("left"),
        F.concat_ws(".", "b_table", "b_column").alias("right"),
        F.least(F.lit(1.0), overlap).alias("overlap"),
        score.alias("score"),
        name_similarity(F.col("a_column"), F.col("b_column")).alias("name_score"),
        F.when(contradict, 0).otherwise(comments_agree(F.col("a_comment"), F.col("b_comment"), F.col("a_column"), F.col("b_column"))).alias("comment_score"),
        F.when(contradict, 0.0).otherwise(shape).alias("key_shape"),
        (~F.coalesce(contradict, F.lit(False)) & (F.col("a_is_key") | F.col("b_is_key"))).alias("parent_is_key"),
        veto.alias("veto"),
        status.alias("status"),
    )


def _compatible(a: Column, b: Column) -> Column:
    loose = ["integer", "float", "string"]
    return (a.isin(*loose) & b.isin(*loose)) | (a.isin("datetime", "date") & b.isin("datetime", "date"))


def joinable(values: DataFrame, dtypes: DataFrame, minimum: float = JOINABLE_MIN, max_cardinality: int | None = None) -> DataFrame:
    """Column pairs whose shared values cover at least ``minimum`` of the smaller domain; booleans never join.

    All domains are compared; with ``max_cardinality`` wider ones are left out before any value is grouped.
    """
    if max_cardinality is not None:
        # only names of columns reach the driver
        for row in cardinalities(values).where(F.col("n_distinct") > max_cardinality).collect():
            values = values.where(~((F.col("table_name") == row.table_name) & (F.col("column_name") == row.column_name)))
    signatures = _signatures(values)
    usable = cut_lineage(_sizes(signatures).join(dtypes, KEY).where(~F.col("dtype").rlike("boolean")))
    pairs = _shared(signatures).where("a_table < b_table")
    cols = ["n_distinct", "dtype"]
    j = _with_side(_with_side(pairs, usable, "a", cols), usable, "b", cols)
    rate = F.col("shared") / F.least("a_n_distinct", "b_n_distinct")
    return j.where(_compatible(F.col("a_dtype"), F.col("b_dtype")) & (rate >= minimum)).select(
        F.concat_ws(".", "a_table", "a_column").alias("source_id"),
        F.concat_ws(".", "b_table", "b_column").alias("target_id"),
        rate.alias("confidence"),
        F.col("a_dtype").alias("dtype_a"),
        F.col("b_dtype").alias("dtype_b"),
    )


def _column_pairs(profiles: DataFrame, extra: list[str], same: str) -> DataFrame:
    """Pairs of profile rows from different tables that agree in one field; profiles are a few rows per table."""
    cols = KEY + extra
    a = profiles.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    b = profiles.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, (F.col(f"a_{same}") == F.col(f"b_{same}")) & (F.col("a_table_name") < F.col("b_table_name")))


def _related_names(profiles: DataFrame) -> DataFrame:
    """Column pairs that can have any synonym confidence at all: one meaning, one synonym group, or a shared character.

    Every name similarity above 0 needs a shared character, so nothing is missed; all three are equi-joins.
    """
    name = F.lower("column_name")
    base = profiles.select(*KEY, "semantic_type")
    keys = base.select(
        *KEY,
        F.explode(
            F.concat(
                F.transform(F.array_distinct(F.split(F.replace(name, F.lit("_"), F.lit("")), "")), lambda c: F.concat(F.lit("c:"), c)),
                F.array_compact(F.array(F.when(F.col("semantic_type") != "unknown", F.concat(F.lit("s:"), "semantic_type")))),
                F.transform(synonym_groups(name), lambda g: F.concat(F.lit("g:"), g.cast("string"))),
            )
        ).alias("key"),
    )
    a = keys.select(*[F.col(c).alias(f"a_{c}") for c in KEY], "key")
    b = keys.select(*[F.col(c).alias(f"b_{c}") for c in KEY], "key")
    pairs = a.join(b, "key").where("a_table_name < b_table_name").drop("key").distinct()
    left = base.select(*[F.col(c).alias(f"a_{c}") for c in base.columns])
    right = base.select(*[F.col(c).alias(f"b_{c}") for c in base.columns])
    return pairs.join(left, ["a_table_name", "a_column_name"]).join(right, ["b_table_name", "b_column_name"])


def synonyms(profiles: DataFrame) -> DataFrame:
    """Confidence that two columns mean the same, from semantic type, synonym group and name similarity."""
    j = _related_names(profiles)
    a, b = F.col("a_column_name"), F.col("b_column_name")
    sim = label_similarity(a, b)
    same_type = (F.col("a_semantic_type") == F.col("b_semantic_type")) & (F.col("a_semantic_type") != "unknown")
    group = F.arrays_overlap(synonym_groups(F.lower(a)), synonym_groups(F.lower(b)))
    confidence = (
        F.when(same_type & ((sim > 0.5) | group), 0.95)
        .when(same_type, 0.85)
        .when(group, 0.80)
        .when(sim > 0.7, 0.6)
        .when(sim > 0.5, 0.4)
        .otherwise(0.0)
    )
    out = j.select(
        F.concat_ws(".", "a_table_name", a).alias("source_id"),
        F.concat_ws(".", "b_table_name", b).alias("target_id"),
        sim.alias("name_similarity"),
        same_type.alias("semantic_type_match"),
        confidence.alias("confidence"),
    )
    return out.where("confidence > 0")


def numeric_similarity(stats: DataFrame, minimum: float = SIMILARITY_MIN) -> DataFrame:
    """0.6 of the range overlap plus 0.4 of the mean similarity; columns of one type. Dates count by range overlap alone."""
    j = _column_pairs(stats, ["dtype", "min_value", "max_value", "mean_value"], "dtype")
    overlap = F.least("a_max_value", "b_max_value") - F.greatest("a_min_value", "b_min_value")
    total = F.greatest("a_max_value", "b_max_value") - F.least("a_min_value", "b_min_value")
    largest = F.greatest(F.abs("a_mean_value"), F.abs("b_mean_value"))
    mean_sim = F.when(F.col("a_mean_value").isNotNull() & F.col("b_mean_value").isNotNull() & (largest > 0), 1.0 - F.abs(F.col("a_mean_value") - F.col("b_mean_value")) / largest).otherwise(0.0)
    ranged = overlap / F.nullif(total, F.lit(0.0))
    bounds = [F.col(f"{side}_{c}") for side in "ab" for c in ("min_value", "max_value")]
    empty = reduce(lambda x, y: x | y, [c.isNull() for c in bounds])
    score = (
        F.when(empty | (overlap < 0), 0.0)
        .when(total == 0, 1.0)
        .when(F.col("a_dtype") == "datetime", ranged)
        .otherwise(ranged * 0.6 + mean_sim * 0.4)
    )
    return _similar(j, score, minimum)


def _similar(j: DataFrame, score: Column, minimum: float) -> DataFrame:
    out = j.select(
        F.concat_ws(".", "a_table_name", "a_column_name").alias("source_id"),
        F.concat_ws(".", "b_table_name", "b_column_name").alias("target_id"),
        score.alias("confidence"),
    )
    return out.where(F.col("confidence") >= minimum)


def categorical_similarity(top: DataFrame, minimum: float = SIMILARITY_MIN) -> DataFrame:
    """Shared mass of two columns' most frequent values over their average mass."""
    mass = top.groupBy(*KEY).agg(F.sum("fraction").alias("mass"))
    t = top.join(mass, KEY).select(*KEY, "value", "fraction", "mass")
    a = t.select(*[F.col(c).alias(f"a_{c}") for c in t.columns])
    b = t.select(*[F.col(c).alias(f"b_{c}") for c in t.columns])
    j = a.join(b, (F.col("a_value") == F.col("b_value")) & (F.col("a_table_name") < F.col("b_table_name")))
    agg = j.groupBy("a_table_name", "a_column_name", "b_table_name", "b_column_name", "a_mass", "b_mass").agg(
        F.sum(F.least("a_fraction", "b_fraction")).alias("common")
    )
    return _similar(agg, F.col("common") / ((F.col("a_mass") + F.col("b_mass")) / 2), minimum)


def suffixed_join(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """Inner join on keys compared as text; names found on both sides get ``_a`` and ``_b``."""
    clash = set(a.columns) & set(b.columns)
    left = a.select(*[F.col(c).alias(f"{c}_a" if c in clash else c) for c in a.columns], F.col(a_key).cast("string").alias("_k"))
    right = b.select(*[F.col(c).alias(f"{c}_b" if c in clash else c) for c in b.columns], F.col(b_key).cast("string").alias("_kb"))
    return left.join(right, F.col("_k") == F.col("_kb"), "inner").drop("_k", "_kb")


def cross_table_correlation(
    a: DataFrame, a_key: str, a_cols: list[str], b: DataFrame, b_key: str, b_cols: list[str], minimum: float = CORRELATION_MIN
) -> DataFrame:
    """Pearson correlation of every numeric pair over the rows the inner join would have.

    Each side is reduced to sums per key before the join. Joined sums are products of those, so a key held by a third of
    both tables adds one row instead of their product.
    """
    left = _moments(a, a_key, a_cols, "a")
    right = _moments(b, b_key, b_cols, "b")
    j = left.join(right, "_k")
    aggs = []
    for x in a_cols:
        for y in b_cols:
            na, sa, qa = F.col(f"a_n_{x}"), F.col(f"a_s_{x}"), F.col(f"a_q_{x}")
            nb, sb, qb = F.col(f"b_n_{y}"), F.col(f"b_s_{y}"), F.col(f"b_q_{y}")
            sums = F.struct(
                F.sum(na * nb).alias("n"),
                F.sum(sa * nb).alias("x"),
                F.sum(sb * na).alias("y"),
                F.sum(qa * nb).alias("xx"),
                F.sum(qb * na).alias("yy"),
                F.sum(sa * sb).alias("xy"),
            )
            aggs.append(F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), sums.alias("s")))
    rows = j.agg(F.array(*aggs).alias("pairs")).select(F.explode("pairs").alias("p")).select("p.column_a", "p.column_b", "p.s.*")
    cov = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    vx, vy = F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    r = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx) / F.sqrt(vy))
    out = rows.select("column_a", "column_b", F.col("n").cast("bigint").alias("aligned_rows"), r.alias("coefficient"))
    return out.where((F.col("aligned_rows") >= ALIGNED_ROWS_MIN) & (F.abs("coefficient") >= minimum))


def _moments(df: DataFrame, key: str, cols: list[str], side: str) -> DataFrame:
    """Per key and column: count, sum and sum of squares of the centred values."""
    centre = df.agg(F.struct(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).alias("m")).scalar()
    picked = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("_k"), *[(F.col(c).cast("double") - centre.getField(c)).alias(c) for c in cols]
    )
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).cast("double").alias(f"{side}_n_{c}"),
            F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{side}_s_{c}"),
            F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0)).alias(f"{side}_q_{c}"),
        ]
    return picked.groupBy("_k").agg(*aggs)


def structural_edges(tables: Mapping[str, DataFrame], declared: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """Edges every schema carries: table contains column, and declared foreign keys; confidence 1."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(f"contains:{n}.{c}", n, f"{n}.{c}", "contains", 1.0) for n, df in tables.items() for c in df.columns]
    rows += [(f"fk:{a}.{x}:{b}.{y}", f"{a}.{x}", f"{b}.{y}", "foreign_key", 1.0) for a, x, b, y, _ in declared]
    return spark.createDataFrame(rows, "id string, source_id string, target_id string, type string, confidence double")


def join_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Shared column names of two tables, and whether the name is unique in the second one."""
    parts = []
    for a, left in tables.items():
        for b, right in tables.items():
            for c in [c for c in left.columns if a != b and c in right.columns]:
                per_key = right.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n"))
                fact = per_key.agg(F.coalesce(F.max("n") == 1, F.lit(True)).alias("unique_in_secondary"))
                parts.append(
                    fact.select(F.lit(a).alias("primary_table"), F.lit(b).alias("secondary_table"), F.lit(c).alias("key"), "unique_in_secondary")
                )
    return reduce(DataFrame.unionByName, parts)
