"""Ranking metrics, scorecards and batch scoring over the order scores."""

from pyspark.sql import functions as F

from ledgerlens.operators import score as sc
from ledgerlens.operators import screen as s
from ledgerlens.plans import derived as d
from ledgerlens.plans.registry import query, stored
from ledgerlens.session import scratch_path

SC = f"s AS ({d.SCORES_SQL})"


def scores(t):
    return stored(t, "scores", d.scores)


def curve(score):
    """Distinct scores with running sums from the top."""
    return f"""(SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER () AS tn, sum(pos) OVER () AS tp FROM (
        SELECT {score} AS score, count(*) AS n, sum(label) AS pos FROM s GROUP BY 1) WINDOW w AS (ORDER BY score DESC))"""


@query(
    "M14_ranking_metrics",
    f"WITH {SC} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS candidate, any_value(tn)::BIGINT AS n_rows, any_value(tp)::BIGINT AS n_positive,
            round((sum(pos * (tn - cn + (n + 1) / 2)) - any_value(tp) * (any_value(tp) + 1) / 2) / (any_value(tp) * (any_value(tn) - any_value(tp))), 6) AS auc,
            round(sum(pos / tp * (cp / cn + CASE WHEN cn > n THEN (cp - pos) / (cn - n) ELSE 1 END) / 2), 6) AS pr_auc, round(max(abs(cp / tp - (cn - cp) / (tn - tp))), 6) AS ks
            FROM {curve(c)}"""
        for c in ("teacher_score", "tree_score", "card_score")
    ),
)
def m14(t):
    df = scores(t)
    parts = [sc.ranking_metrics(df, c, "label").select(F.lit(c).alias("candidate"), "*") for c in ("teacher_score", "tree_score", "card_score")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("candidate", "n_rows", "n_positive", *[F.round(c, 6).alias(c) for c in ("auc", "pr_auc", "ks")])


def topk_sql(score, k):
    return f"""SELECT share, k AS selected, score AS threshold, n AS tied, (k - (cn - n))::BIGINT AS slots, hits, round(hits / k, 6) AS precision, round(hits / tp, 6) AS recall,
        round(hits / k / (tp / tn), 6) AS lift, round(k / tn, 6) AS coverage FROM (
          SELECT *, round((cp - pos) + (k - (cn - n)) * pos / n, 6) AS hits FROM (SELECT *, greatest(1, {k}(tn * share))::BIGINT AS k FROM {curve(score)},
            (SELECT unnest([0.01, 0.05, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS share)) WHERE cn >= k AND cn - n < k)"""


_TK = ["precision", "recall", "lift", "coverage", "hits"]


@query("K03_top_share_floor", f"WITH {SC} {topk_sql('teacher_score', 'floor')}")
def k03(t):
    out = sc.tie_aware_top_k(scores(t), "teacher_score", "label", sc.TOP_SHARES, floor=True)
    return out.select(*[F.round(c, 6).alias(c) if c in _TK else F.col(c) for c in out.columns])


@query("K04_top_share_ties", f"WITH {SC} {topk_sql('tree_score', 'ceil')}")
def k04(t):
    out = sc.tie_aware_top_k(scores(t), "tree_score", "label", sc.TOP_SHARES)
    return out.select(*[F.round(c, 6).alias(c) if c in _TK else F.col(c) for c in out.columns])


@query(
    "W10_average_ranks",
    f"WITH {SC} SELECT teacher_score AS value, count(*) AS n, (sum(count(*)) OVER (ORDER BY teacher_score) - (count(*) - 1) / 2)::DOUBLE AS rank FROM s GROUP BY 1",
)
def w10(t):
    return sc.average_ranks(scores(t), "teacher_score")


def rank_sql(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@query(
    "M15_spearman",
    f"WITH {SC} SELECT count(*) AS n_rows, round(corr(a, b), 6) AS spearman FROM (SELECT {rank_sql('teacher_score')} AS a, {rank_sql('card_score')} AS b FROM s)",
)
def m15(t):
    return sc.spearman(scores(t), "teacher_score", "card_score").withColumn("spearman", F.round("spearman", 6))


@query(
    "M16_score_profile",
    f"""WITH {SC} SELECT count(*) AS score_unique, max(n) AS largest_tie, sum(n)::BIGINT AS n_rows, round(max(n) / sum(n), 6) AS largest_tie_rate,
          concat_ws(',', CASE WHEN (SELECT corr(a, b) FROM (SELECT {rank_sql('teacher_score')} AS a, {rank_sql('tree_score')} AS b FROM s)) < 0.95 THEN 'low_teacher_spearman' END,
            CASE WHEN max(n) / sum(n) > 0.5 THEN 'high_score_tie_rate' END) AS risk_flags FROM (SELECT tree_score, count(*) AS n FROM s GROUP BY 1)""",
)
def m16(t):
    df = scores(t)
    rho = sc.spearman(df, "teacher_score", "tree_score").select("spearman").scalar()
    return sc.risk_flags(sc.score_profile(df, "tree_score"), rho, F.lit(0.0), 5, 0.95).withColumn("largest_tie_rate", F.round("largest_tie_rate", 6))


@query("K06_scored_list", f"WITH {SC} SELECT user_id, teacher_score AS score, rank() OVER (ORDER BY teacher_score DESC) AS score_rank FROM s")
def k06(t):
    return sc.scored_list(scores(t), "user_id", "teacher_score")


@query(
    "J15_aligned_scores",
    f"""WITH {SC}, pu AS (SELECT user_id, label, n FROM (SELECT user_id, min(label) AS label, min(label) = max(label) AS same, count(*) AS n FROM s GROUP BY 1) WHERE same),
        al AS (SELECT a.user_id, a.label, a.teacher_score AS teacher, b.tree_score AS tree, c.card_score AS card, a.label = b.label AND a.label = c.label AS agree
               FROM s a JOIN s b USING (user_id) JOIN s c USING (user_id)),
        ok AS (SELECT src, (SELECT max(n) FROM pu) = 1 AND (SELECT bool_and(agree) FROM al) AND (SELECT count(*) FROM s) = (SELECT count(*) FROM al) AS good
               FROM (VALUES ('teacher'), ('tree'), ('card')) x(src))
        SELECT user_id::VARCHAR AS user_id, label, teacher, tree, card, (SELECT count(*) FILTER (WHERE good) FROM ok) AS sources_aligned FROM al""",
)
def j15(t):
    df = scores(t)
    frames = {n: (df.select("user_id", "label", f"{n}_score"), f"{n}_score") for n in ("teacher", "tree", "card")}
    aligned, gates = sc.aligned_scores(frames, "user_id", "label")
    good = gates.agg(F.count_if(F.col("unique_users") & F.col("labels_agree") & F.col("same_users")).alias("n")).scalar()
    return aligned.select("*", good.alias("sources_aligned"))


IMPORTANCE = ["f_lines", "f_status", "f_qty", "f_discount", "f_price", "f_priority", "f_segment", "f_nation", "f_balance", "f_const"]


def card_sql(source="f"):
    """Rules of the two top features: bins of f_lines, values of f_status."""
    return f"""base AS (SELECT avg(label) AS b FROM {source}),
      ed AS (SELECT list_sort(list_distinct(quantile_cont(f_lines::DOUBLE, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM {source}),
      g AS (SELECT 'f_lines' AS feature, 1 AS rank, NULL AS value, CASE WHEN bin > 0 THEN e[bin + 1] END AS lo, CASE WHEN bin < len(e) - 2 THEN e[bin + 2] END AS hi, 1.0 AS weight, label
            FROM (SELECT label, e, len(list_filter(e[2:-2], lambda q: q <= f_lines)) AS bin FROM {source}, ed WHERE f_lines IS NOT NULL)
            UNION ALL SELECT 'f_status', 2, coalesce(f_status, '__MISSING__'), NULL, NULL, 0.6, label FROM {source}),
      r AS (SELECT feature, rank, value, lo, hi, weight, count(*) AS n, sum(label) AS pos FROM g GROUP BY ALL),
      card AS (SELECT *, round((CASE WHEN pos = n THEN 30 WHEN pos > 0 THEN greatest(-30, least(30, ln(pos / n / (SELECT b FROM base)) * 10)) ELSE -30 END)::DOUBLE, 4) AS raw_score FROM r),
      rules AS (SELECT feature, rank, value, lo, hi, raw_score, weight::DOUBLE AS weight, round(raw_score * weight::DOUBLE, 4) AS weighted_score, round(pos / n, 6) AS pos_rate,
                n AS sample_count, pos::BIGINT AS pos_count, (n - pos)::BIGINT AS neg_count FROM card)"""


@query("M11_scorecard", f"WITH f AS (SELECT * FROM ({d.SPLIT_SQL}) WHERE split = 'valid'), {card_sql()} SELECT * FROM rules")
def m11(t):
    valid = d.features(t).where("split = 'valid'")
    return sc.build_scorecard(valid, IMPORTANCE, d.TEXT, "label")


APPLY = """SELECT user_id, round(coalesce((SELECT weighted_score FROM rules WHERE feature = 'f_lines' AND f_lines >= coalesce(lo, f_lines) AND (hi IS NULL OR f_lines < hi)), 0)
    + coalesce((SELECT weighted_score FROM rules WHERE feature = 'f_status' AND value = coalesce(f_status, '__MISSING__')), 0), 6) + 0.0 AS card_score FROM a"""


@query("M12_apply_scorecard", f"WITH a AS ({d.SPLIT_SQL}), f AS (SELECT * FROM a WHERE split = 'valid'), {card_sql()} {APPLY}")
def m12(t):
    df = d.features(t)
    rules = sc.build_scorecard(df.where("split = 'valid'"), IMPORTANCE, d.TEXT, "label")
    return sc.apply_scorecard(df, rules).select("user_id", (F.round("card_score", 6) + 0.0).alias("card_score"))


RULES = [
    sc.TreeRule("R1", 0.05, (("f_lines", "<=", 0.0),)),
    sc.TreeRule("R2", 0.1, (("f_lines", ">", 0.0), ("f_lines", "<=", 3.0))),
    sc.TreeRule("R3", 0.4, (("f_lines", ">", 3.0), ("f_lines", "<=", 5.0), ("f_qty", "<=", 120.0))),
    sc.TreeRule("R4", 0.45, (("f_lines", ">", 3.0), ("f_lines", "<=", 5.0), ("f_qty", ">", 120.0))),
    sc.TreeRule("R5", 0.8, (("f_lines", ">", 5.0),)),
    sc.TreeRule("R6", 0.8, (("f_lines", ">", 5.0),)),
]


def _rule_row(rule):
    """A rule as open lower and closed upper bounds of both features."""
    bounds = {(f, op): v for f, op, v in rule.atoms}
    pick = lambda f, op, missing: bounds.get((f, op), missing)
    return f"""({pick("f_lines", ">", -1e9)}, {pick("f_lines", "<=", 1e9)}, {pick("f_qty", ">", -1e9)}, {pick("f_qty", "<=", 1e9)}, {rule.score}::DOUBLE)"""


@query(
    "M13_apply_tree",
    f"""WITH {SC}, x AS (SELECT user_id, coalesce(f_lines, 0)::DOUBLE AS f_lines, coalesce(f_qty, 0)::DOUBLE AS f_qty FROM ({d.FEATURES_SQL})),
        m AS (SELECT user_id, score FROM x JOIN (VALUES {", ".join(_rule_row(r) for r in RULES)}) r(low, high, low_qty, high_qty, score)
              ON f_lines > low AND f_lines <= high AND f_qty > low_qty AND f_qty <= high_qty GROUP BY user_id, score, low, high, low_qty, high_qty),
        a AS (SELECT x.user_id, max(score)::DOUBLE AS tree_score, count(score) AS n, max(s.tree_score) AS exported FROM x JOIN s USING (user_id) LEFT JOIN m USING (user_id) GROUP BY 1)
        SELECT user_id, tree_score, n::INTEGER AS matched_rules, count(*) OVER () AS n_rows, count(*) FILTER (WHERE n = 0) OVER () AS unmatched,
          count(*) FILTER (WHERE n > 1) OVER () AS multiple, count(*) FILTER (WHERE abs(coalesce(tree_score, 0) - exported) > 0.001) OVER () AS mismatches FROM a""",
)
def m13(t):
    df = d.features(t).select("user_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("f_lines", "f_qty")])
    scored = sc.apply_tree(df, RULES).join(scores(t).select("user_id", F.col("tree_score").alias("exported")), "user_id")
    check = sc.check_tree(scored, "exported").select(F.struct("n_rows", "unmatched", "multiple", "mismatches").alias("c")).scalar()
    return scored.select("user_id", "tree_score", "matched_rules", *[check.getField(c).alias(c) for c in ("n_rows", "unmatched", "multiple", "mismatches")])


@query("M09_models")
def m09(t):
    df = d.features(t)
    return sc.train_models(df, ["f_price", "f_lines", "f_qty", "f_discount", "f_balance"], ["f_status", "f_segment"], "label", "split")[2]


@query("M09_feature_ab")
def m09_ab(t):
    """Kept features against kept and doubtful ones."""
    df = d.features(t)
    return sc.feature_ab(df, s.screening_report(df, d.NUMERIC, d.TEXT, "label", "split"), d.TEXT, "label", "split")


@query("M10_surrogate_tree")
def m10(t):
    df = d.features(t).join(scores(t).select("user_id", "teacher_score"), "user_id")
    feats = ["f_lines", "f_qty", "f_discount"]
    rules = sc.surrogate_rules(df, feats, "teacher_score")
    scored = sc.apply_tree(df.fillna(-1.0, subset=feats), rules)
    leaf = scored.groupBy(F.col("tree_score").alias("leaf_score")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("matched_rules").alias("most_rules"), F.avg("teacher_score").alias("mean_score")
    )
    return leaf


def _unit_sql(j, seed):
    return f"(('0x' || substr(md5('{seed}:' || name || ':' || round || ':' || {j}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"


def bootstrap_sql(first, second, source="s", seed=42):
    """All cells drawn in all rounds, ranked in full."""
    steps = " ".join(f"WHEN u < {p!r} THEN {k}" for k, p in enumerate(sc.POISSON_ONE))
    sums = ", ".join(f"sum({c}) OVER (PARTITION BY round, which ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS c{c}, sum({c}) OVER (PARTITION BY round, which) AS t{c}" for c in ("n", "pos"))
    return f"""ce AS (SELECT {first} AS x0, {second} AS x1, label, count(*) AS n, min(user_id) AS name FROM {source} GROUP BY 1, 2, 3),
        rd AS (SELECT *, unnest(range(1, {sc.ROUNDS + 1})) AS round FROM ce),
        one AS (SELECT name, round, sum(CASE {steps} ELSE {len(sc.POISSON_ONE)} END) AS w FROM (SELECT name, round, {_unit_sql("j", seed)} AS u FROM (SELECT name, round, unnest(range(1, n % 16 + 1)) AS j FROM rd)) GROUP BY 1, 2),
        nm AS (SELECT name, round, n - n % 16 AS m, sqrt(-2 * ln({_unit_sql("'a'", seed)})) * cos(2 * pi() * {_unit_sql("'b'", seed)}) AS z FROM rd WHERE n >= 16),
        mn AS (SELECT name, round, greatest(0, floor(m + sqrt(m::DOUBLE) * z + (z * z - 1) / 6 + 0.5)) AS w FROM nm),
        dr AS (SELECT rd.*, coalesce(one.w, 0) + coalesce(mn.w, 0) AS w FROM rd LEFT JOIN one USING (name, round) LEFT JOIN mn USING (name, round)),
        un AS (SELECT round, 0 AS which, x0 AS x, label, w FROM dr WHERE w > 0 UNION ALL SELECT round, 1, x1, label, w FROM dr WHERE w > 0),
        gr AS (SELECT round, which, x, sum(w) AS n, sum(w * label) AS pos FROM un GROUP BY 1, 2, 3),
        cu AS (SELECT *, {sums} FROM gr),
        ed AS (SELECT *, greatest(1, ceil(tn * 0.1)) AS k FROM cu WHERE tpos > 0 AND tpos < tn),
        pr AS (SELECT round, which, ((cpos - pos) + (k - cn + n) * pos / n) / k AS p FROM ed WHERE cn >= k AND cn - n < k),
        df AS (SELECT round, sum(CASE which WHEN 0 THEN p ELSE -p END) AS d FROM pr GROUP BY 1)
        SELECT round(avg(d), 9) AS difference, round(quantile_cont(d, 0.025), 9) AS ci_lower, round(quantile_cont(d, 0.975), 9) AS ci_upper, count(*) AS rounds FROM df"""


@query("M17_paired_bootstrap", f"WITH {SC}, {bootstrap_sql('teacher_score', 'card_score')}")
def m17(t):
    """Five hundred rounds."""
    out = sc.bootstrap_difference(scores(t), "user_id", "label", "teacher_score", "card_score")
    return out.select(*[F.round(c, 9).alias(c) for c in ("difference", "ci_lower", "ci_upper")], "rounds")


@query("M17_paired_bootstrap_of_groups", f"WITH {SC}, {bootstrap_sql('tree_score', 'card_score')}")
def m17_groups(t):
    """The same with two scores of few values, whose cells hold many rows."""
    out = sc.bootstrap_difference(scores(t), "user_id", "label", "tree_score", "card_score")
    return out.select(*[F.round(c, 9).alias(c) for c in ("difference", "ci_lower", "ci_upper")], "rounds")


def grid_sql(tree, card):
    """Precision of each half and weight of the mix."""
    return f"""h AS (SELECT *, ('0x' || substr(sha256(user_id::VARCHAR), 16, 1))::INTEGER % 2 AS half FROM s),
        f AS (SELECT avg({tree}) AS tm, stddev_pop({tree}) AS ts, avg({card}) AS cm, stddev_pop({card}) AS cs FROM h WHERE half = 0),
        c AS (SELECT half, (0.05 * i)::DECIMAL(4,2)::DOUBLE AS w, label, {tree}, {card} FROM h, range(1, 20) r(i)),
        g AS (SELECT half, w, round(w * (({tree} - tm) / ts) + (1 - w) * (({card} - cm) / cs), 9) AS score, count(*) AS n, sum(label) AS pos FROM c, f GROUP BY 1, 2, 3),
        k AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp, greatest(1, ceil(sum(n) OVER (PARTITION BY half, w) * 0.1)) AS k FROM g WINDOW o AS (PARTITION BY half, w ORDER BY score DESC)),
        p AS (SELECT half, w, ((cp - pos) + (k - cn + n) * pos / n) / k AS p FROM k WHERE cn >= k AND cn - n < k)"""


@query(
    "M18_score_fusion",
    f"""WITH {SC}, {grid_sql("tree_score", "card_score")},
        z AS (SELECT w AS tree_weight, round(max(p) FILTER (WHERE half = 0), 6) AS fit_precision, round(max(p) FILTER (WHERE half = 1), 6) AS eval_precision FROM p GROUP BY 1)
        SELECT *, tree_weight = (SELECT tree_weight FROM z ORDER BY fit_precision DESC, tree_weight LIMIT 1) AS selected FROM z""",
)
def m18(t):
    out = sc.fusion_grid(scores(t), "user_id", "label", "tree_score", "card_score")
    return out.select("tree_weight", F.round("fit_precision", 6).alias("fit_precision"), F.round("eval_precision", 6).alias("eval_precision"), "selected")


def precision_sql(source, score):
    """Expected precision at the top tenth, ties shared."""
    return f"""(SELECT ((cp - pos) + (k - cn + n) * pos / n) / k FROM (SELECT *, greatest(1, ceil(tn * 0.1)) AS k FROM (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER () AS tn
        FROM (SELECT {score} AS x, count(*) AS n, sum(label) AS pos FROM {source} GROUP BY 1) WINDOW w AS (ORDER BY x DESC))) WHERE cn >= k AND cn - n < k)"""


def strategy_sql(tree, card):
    """The choice for one pair of scores, all evidence computed at once."""
    uplift = lambda new, old: f"({new} - {old}) / greatest(abs({old}), 1e-12) >= 0.02"
    return f"""(WITH {SC}, {grid_sql(tree, card)},
        b AS (SELECT tree_weight AS w FROM (SELECT w AS tree_weight, max(p) FILTER (WHERE half = 0) AS fp FROM p GROUP BY 1) ORDER BY fp DESC, tree_weight LIMIT 1),
        e AS (SELECT user_id, label, {tree}, {card}, round(b.w * (({tree} - tm) / ts) + (1 - b.w) * (({card} - cm) / cs), 9) AS fused FROM h, f, b WHERE half = 1),
        b0 AS (WITH {bootstrap_sql(tree, card)}), b1 AS (WITH {bootstrap_sql("fused", tree, "e", 43)}), b2 AS (WITH {bootstrap_sql("fused", card, "e", 44)}),
        v AS (SELECT {precision_sql("s", tree)} AS tp, {precision_sql("s", card)} AS cp, {precision_sql("e", "fused")} AS fp, {precision_sql("e", tree)} AS etp, {precision_sql("e", card)} AS ecp,
              b0.ci_lower AS lo, b0.ci_upper AS hi, b1.ci_lower AS l1, b2.ci_lower AS l2, b.w FROM b0, b1, b2, b),
        won AS (SELECT *, lo > 0 AND {uplift("tp", "cp")} AS tree_wins, hi < 0 AND {uplift("cp", "tp")} AS card_wins,
              l1 > 0 AND l2 > 0 AND {uplift("fp", "etp")} AND {uplift("fp", "ecp")} AS mix_wins FROM v),
        done AS (SELECT *, CASE WHEN tree_wins THEN 'decision_tree' WHEN card_wins THEN 'scorecard' WHEN mix_wins THEN 'fusion' WHEN tp >= cp THEN 'decision_tree' ELSE 'scorecard' END AS strategy,
              NOT (tree_wins OR card_wins) AS tried FROM won)
        SELECT '{tree}' AS tree, '{card}' AS card, strategy,
          CASE WHEN NOT tried THEN 'one_strategy_significantly_better' WHEN mix_wins THEN 'fusion_beats_both' ELSE 'no_significant_difference' END AS reason,
          CASE strategy WHEN 'fusion' THEN w WHEN 'decision_tree' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight, round(tp, 6) AS tree_precision, round(cp, 6) AS card_precision,
          round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper, tried AS fusion_attempted, CASE WHEN tried THEN round(fp, 6) END AS fusion_precision,
          CASE WHEN tried THEN round(l1, 6) END AS over_tree_lower, CASE WHEN tried THEN round(l2, 6) END AS over_card_lower FROM done)"""


STRATEGY_PAIRS = [("tree_score", "card_score"), ("card_score", "tree_score"), ("card_score", "teacher_score")]


@query(
    "M18_strategy_choice",
    " UNION ALL ".join(strategy_sql(a, b) for a, b in STRATEGY_PAIRS),
)
def m18_choice(t):
    """Which of two scores to deploy, or their mix, in both roles."""
    out = sc.strategy_report(scores(t), "user_id", "label", STRATEGY_PAIRS)
    numbers = ["tree_precision", "card_precision", "ci_lower", "ci_upper", "fusion_precision", "over_tree_lower", "over_card_lower"]
    return out.select(*[F.round(c, 6).alias(c) if c in numbers else F.col(c) for c in out.columns])


@query(
    "M19_batch_scoring",
    f"""WITH a AS ({d.SPLIT_SQL}), f AS (SELECT * FROM a WHERE split = 'valid'), {card_sql()}, x AS ({APPLY}) SELECT user_id, card_score AS score, rank() OVER (ORDER BY card_score DESC) AS score_rank FROM x""",
)
def m19(t):
    df = d._features(t)
    rules = sc.build_scorecard(d.features(t).where("split = 'valid'"), IMPORTANCE, d.TEXT, "label")
    path = scratch_path(t.spark, "scored")
    scored = sc.apply_scorecard(df, rules).select("user_id", (F.round("card_score", 6) + 0.0).alias("card_score"))
    scored.write.parquet(path)
    return sc.scored_list(t.spark.read.parquet(path), "user_id", "card_score")
