"""Queries on scores and weights: suppliers by quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import audit, integrity, pick, score
from ..sources.stages import Stages
from .snapshots import _SUPQ, read, supplier_quarters

FACTORS = {"revenue": (0.35, True), "discount": (0.15, False), "quantity": (0.30, True), "tax": (0.20, True)}
CAP, TOP = 0.10, 30


def scored(spark, sf_dir, quarters: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Quarterly factors (revenue under 200,000 taken as missing) with percentile and composite scores; by: within series."""
    q = (supplier_quarters(spark, sf_dir, exact=True) if quarters is None else quarters).withColumn("revenue", F.when(F.round("revenue", 2) >= 200000, F.round("revenue", 2)))
    q = q.withColumns({c: F.round(c, 6) for c in ("discount", "tax")})
    p = q.withColumns({f"{c}_score": score.percentile(c, [*by, "quarter_end"], up) for c, (_, up) in FACTORS.items()})
    total, n = score.composite({f"{c}_score": w for c, (w, _) in FACTORS.items()})
    return p.withColumns({"factor_score": F.round(total, 6), "available_factor_count": n})


def percentile_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("l_suppkey", "quarter_end", *[F.round(f"{c}_score", 6).alias(f"{c}_score") for c in FACTORS])


def composite_score(spark, sf_dir):
    rows = scored(spark, sf_dir).where("available_factor_count >= 3")
    w = Window.partitionBy("quarter_end")
    return rows.select(
        "l_suppkey", "quarter_end", "factor_score", "available_factor_count", F.row_number().over(w.orderBy(F.col("factor_score").desc(), "l_suppkey")).alias("factor_rank"),
        F.rank().over(w.orderBy(F.col("factor_score").desc())).alias("min_rank"), F.count("factor_score").over(w).alias("candidate_count"),
        F.round(score.percentile("factor_score", ["quarter_end"], True, None), 6).alias("factor_score_percentile"),
    )


def score_summary(spark, sf_dir):
    c = F.col("factor_score")
    with Stages(spark) as stages:
        rows = stages.write(scored(spark, sf_dir).select("quarter_end", "factor_score", "available_factor_count"))
        middle = integrity.medians(rows, ["quarter_end"], "factor_score").select("quarter_end", F.round("median", 6).alias("median"))
        counts = rows.groupBy("quarter_end").agg(
            F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"),
            F.count_if(F.col("available_factor_count") == 3).alias("n_three"), F.count_if(F.col("available_factor_count") == 4).alias("n_four"),
        )
        return stages.result(counts.join(middle, "quarter_end", "left"))


def index_weights(spark, sf_dir, quarters: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    return weighted(scored(spark, sf_dir, quarters, by), by)


def weighted(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Capped weights of the best scored rows of each quarter."""
    rows = rows.where("available_factor_count >= 3").withColumn("s", F.pow(F.col("factor_score"), 6))
    return score.build_index(rows, [*by, "quarter_end"], "s", TOP, CAP, "l_suppkey")


def topn_capped_weights(spark, sf_dir):
    return index_weights(spark, sf_dir).select("quarter_end", "l_suppkey", "factor_score", F.round("raw_weight", 8).alias("raw_weight"), F.round("weight", 8).alias("weight"), "weight_capped", F.round("effective_cap", 8).alias("effective_cap"), "n_constituents")


def rebalance_summary(spark, sf_dir):
    s = score.rebalance_summary(index_weights(spark, sf_dir), "quarter_end")
    return s.select("quarter_end", "n", "n_capped", *[F.round(c, 6).alias(c) for c in ("weight_sum", "weight_max", "weight_min", "top5", "hhi", "effective_n")])


def special_removal(spark, sf_dir):
    gone = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    out = score.remove_names(index_weights(spark, sf_dir), gone, "quarter_end", "l_suppkey")
    return out.select("quarter_end", "l_suppkey", F.round("weight", 8).alias("weight"))


def _both_weights(spark, sf_dir, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """Weights of all suppliers, and of those that aren't gated, before percentile scores, for a negative balance."""
    gone = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    quarters = stages.write(supplier_quarters(spark, sf_dir, exact=True))
    return stages.write(index_weights(spark, sf_dir, quarters)), stages.write(index_weights(spark, sf_dir, quarters.join(gone, "l_suppkey", "left_anti")))


def weight_diff(spark, sf_dir):
    with Stages(spark) as stages:
        d = integrity.weight_differences(*_both_weights(spark, sf_dir, stages), "quarter_end", "l_suppkey")
        return stages.result(d.select("quarter_end", F.round("max_weight_diff", 8).alias("max_weight_diff"), "membership_changes"))


def topn_diff(spark, sf_dir):
    with Stages(spark) as stages:
        return stages.result(integrity.set_difference(*_both_weights(spark, sf_dir, stages), "quarter_end", "l_suppkey"))


def determinism_check(spark, sf_dir):
    """The index rebuilt from the same rows in another order and split, against the first build."""
    again = index_weights(spark, sf_dir, supplier_quarters(spark, sf_dir, lambda li: li.repartition(7, F.xxhash64("l_partkey", "l_orderkey")).sortWithinPartitions(F.desc("l_shipdate")), exact=True))
    d = integrity.weight_differences(index_weights(spark, sf_dir), again, "quarter_end", "l_suppkey")
    return d.agg(F.round(F.max("max_weight_diff"), 9).alias("max_weight_diff"), F.sum("membership_changes").alias("membership_changes"))


def rebalance_ledger(spark, sf_dir):
    return integrity.membership_changes(index_weights(spark, sf_dir), "quarter_end", "l_suppkey")


def membership_ledger(spark, sf_dir):
    """Candidates are the suppliers of a quarter but every fifth, which is only scored; those with a negative balance fail the theme."""
    low = F.col("s_acctbal") < 0
    bal = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (~low).alias("theme_eligible"), F.when(low & (F.col("s_suppkey") % 2 == 0), "NEGATIVE_BALANCE").otherwise("").alias("theme_reason"))
    with Stages(spark) as stages:
        rows = stages.write(scored(spark, sf_dir))
        cand = rows.where("l_suppkey % 5 <> 0").select("quarter_end", "l_suppkey").join(bal, "l_suppkey")
        return stages.result(integrity.membership_ledger(cand, rows.where("available_factor_count >= 3").select("quarter_end", "l_suppkey", "factor_score"), weighted(rows), "quarter_end", "l_suppkey"))


def _selected(spark, sf_dir, target: int):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") * 2.0).alias("relevance"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_retailprice")).alias("quality"), (F.col("p_partkey") % 14).cast("double").alias("factors"))
    rows = score.with_minmax(part, "quality", "factors").withColumn("selection_score", score.selection_score("relevance", "quality", "factors"))
    quota = read(spark, sf_dir, "part").select("p_brand").distinct().withColumn("quota", F.when(F.col("p_brand").endswith("1"), 6).otherwise(2))
    out = pick.quota_selection(rows, quota, "p_brand", target, F.col("selection_score").desc(), F.col("relevance").desc(), F.col("p_partkey"))
    return out.select("p_partkey", "p_brand", "selection_score", "stage", "rank")


def selection_rationale(spark, sf_dir):
    """The chosen parts with all parts of their score and a sentence."""
    part = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ticker"), F.col("p_name").alias("entity_name"), F.col("p_brand").alias("theme"), F.col("p_type").alias("sub_theme"), F.col("p_brand").alias("quota_theme"), (F.col("p_size") * 2.0).alias("ai_relevance_score"),
        (F.col("p_size") * 2).alias("candidate_score"), F.col("p_retailprice").alias("data_quality_score"), (F.col("p_partkey") % 14).alias("factor_available_count"),
    )
    rows = score.with_minmax(part.withColumn("f", F.col("factor_available_count").cast("double")), "data_quality_score", "f")
    rows = rows.withColumns({"quality_component": score.minmax("data_quality_score"), "factor_component": score.minmax("f"), "selection_score": score.selection_score("ai_relevance_score", "data_quality_score", "f")})
    quota = read(spark, sf_dir, "part").select(F.col("p_brand").alias("quota_theme")).distinct().withColumn("quota", F.when(F.col("quota_theme").endswith("1"), 6).otherwise(2))
    out = pick.quota_selection(rows, quota, "quota_theme", 100, F.col("selection_score").desc(), F.col("ai_relevance_score").desc(), F.col("ticker"))
    r = audit.selection_rationale(out.withColumnsRenamed({"stage": "selection_stage", "rank": "universe_rank"}))
    return r.select("*", *[F.round(c, 6).alias(f"{c}_") for c in ("quality_component", "factor_component")]).drop("quality_component", "factor_component").withColumnsRenamed({"quality_component_": "quality_component", "factor_component_": "factor_component"})


def quota_selection(spark, sf_dir):
    return _selected(spark, sf_dir, 100)


def quota_trim(spark, sf_dir):
    """Quotas that make more than the target."""
    return _selected(spark, sf_dir, 20)


def quota_summary(spark, sf_dir):
    chosen = quota_selection(spark, sf_dir)
    total = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("matched"))
    rows = total.join(chosen.groupBy("p_brand").agg(F.count("*").alias("selected")), "p_brand", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    return rows.rollup("p_brand").agg(F.sum("matched").alias("matched"), F.sum("selected").alias("selected")).withColumn("p_brand", F.coalesce("p_brand", F.lit("TOTAL")))


def _pct(c: str, up: bool, single: bool = True, by: str = "quarter_end") -> str:
    d = "ASC" if up else "DESC"
    s = f"(rank() OVER (PARTITION BY {by} ORDER BY {c} {d} NULLS LAST) + (count({c}) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {by}) * 100"
    return f"CASE WHEN {c} IS NULL THEN NULL {f'WHEN count({c}) OVER (PARTITION BY {by}) = 1 THEN 50.0' if single else ''} ELSE {s} END"


_NUM = " + ".join(f"coalesce({c}_score * {w}, 0)" for c, (w, _) in FACTORS.items())
_DEN = " + ".join(f"CASE WHEN {c}_score IS NULL THEN 0 ELSE {w} END" for c, (w, _) in FACTORS.items())
_N = " + ".join(f"CAST({c}_score IS NOT NULL AS INTEGER)" for c in FACTORS)


def _scored_sql(rows: str = "supq", by: str = "quarter_end", name: str = "scored") -> str:
    """Factors, percentile scores and composite score of the rows of a table, within the groups of by."""
    return f"""{name}_f AS (SELECT * REPLACE (CASE WHEN round(revenue, 2) >= 200000 THEN round(revenue, 2) END AS revenue, round(discount, 6) AS discount, round(tax, 6) AS tax) FROM {rows}),
{name}_p AS (SELECT *, {", ".join(f"{_pct(c, up, by=by)} AS {c}_score" for c, (_, up) in FACTORS.items())} FROM {name}_f),
{name} AS (SELECT *, round(({_NUM}) / nullif({_DEN}, 0), 6) AS factor_score, {_N} AS available_factor_count FROM {name}_p)"""


def _index_sql(name: str, rows: str, by: str = "quarter_end") -> str:
    """Weights in closed form of capping and sharing out, within the groups of by."""
    w = f"{name}_0 AS (SELECT {by}, l_suppkey, factor_score, pow(factor_score, 6) AS s FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY pow(factor_score, 6) DESC, l_suppkey) <= {TOP}),"
    w += f"{name}_n AS (SELECT {by}, l_suppkey, factor_score, s, count(*) OVER (PARTITION BY {by}) AS n, sum(s) OVER (PARTITION BY {by}) AS total, row_number() OVER (PARTITION BY {by} ORDER BY s DESC, l_suppkey) - 1 AS k, sum(s) OVER (PARTITION BY {by} ORDER BY s DESC, l_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix FROM {name}_0),"
    w += f"{name}_c AS (SELECT *, greatest({CAP}, 1.0 / n) AS cap FROM {name}_n),"
    w += f"{name}_k AS (SELECT {by}, min(k) AS m, arg_min(suffix, k) AS free FROM {name}_c WHERE (1 - k * cap) * s / suffix <= cap + 1e-15 GROUP BY {by}),"
    return w + f"""{name} AS (SELECT {by}, c.l_suppkey, c.factor_score, s, s / total AS raw_weight, cap AS effective_cap, n AS n_constituents, c.k < coalesce(m, n) AS weight_capped,
  CASE WHEN c.k < coalesce(m, n) THEN cap ELSE (1 - m * cap) * s / free END AS weight FROM {name}_c c LEFT JOIN {name}_k USING ({by}))"""


_SCORED = f"{_SUPQ}, {_scored_sql()}"
_IDX = f"{_SCORED}, {_index_sql('idx', 'SELECT * FROM scored WHERE available_factor_count >= 3')}"
_ALLOWED = "allowed AS (SELECT * FROM supq WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0))"
_BOTH = f"{_IDX}, {_ALLOWED}, {_scored_sql('allowed', name='rescored')}, {_index_sql('gated', 'SELECT * FROM rescored WHERE available_factor_count >= 3')}"
_SELECT = """part2 AS (SELECT p_partkey, p_brand, p_size * 2.0::DOUBLE AS relevance, CASE WHEN p_partkey % 9 > 0 THEN p_retailprice END AS quality, CAST(p_partkey % 14 AS DOUBLE) AS factors FROM part),
mm AS (SELECT min(quality) AS q0, max(quality) AS q1, min(factors) AS f0, max(factors) AS f1 FROM part2),
sel AS (SELECT p_partkey, p_brand, relevance, round_even(0.6::DOUBLE * relevance + 0.25::DOUBLE * coalesce((quality - q0) / (q1 - q0) * 100, 50.0::DOUBLE) + 0.15::DOUBLE * coalesce((factors - f0) / (f1 - f0) * 100, 50.0::DOUBLE), 4) AS selection_score,
  CASE WHEN p_brand LIKE '%1' THEN 6 ELSE 2 END AS quota FROM part2, mm),
ranked AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY selection_score DESC, relevance DESC, p_partkey) AS r FROM sel),
rest AS (SELECT *, row_number() OVER (ORDER BY selection_score DESC, relevance DESC, p_partkey) AS f FROM ranked WHERE r > quota),
chosen AS (SELECT p_partkey, p_brand, relevance, selection_score, 'theme_quota' AS stage FROM ranked WHERE r <= quota
  UNION ALL SELECT p_partkey, p_brand, relevance, selection_score, 'shortage_fill' FROM rest WHERE f <= TARGET - (SELECT count(*) FROM ranked WHERE r <= quota)),
quota_selection AS (SELECT p_partkey, p_brand, selection_score, stage, CAST(row_number() OVER (ORDER BY selection_score DESC, relevance DESC, p_partkey) AS INTEGER) AS rank FROM chosen QUALIFY rank <= TARGET)"""
_SELECT, _TRIM = _SELECT.replace("TARGET", "100"), _SELECT.replace("TARGET", "20")
_DAYS = "days AS (SELECT quarter_end, row_number() OVER (ORDER BY quarter_end) AS i FROM (SELECT DISTINCT quarter_end FROM scored))"
ORACLES = {
    "percentile_scores": f"WITH {_SCORED} SELECT l_suppkey, quarter_end, {', '.join(f'round({c}_score, 6) AS {c}_score' for c in FACTORS)} FROM scored",
    "composite_score": f"""WITH {_SCORED} SELECT l_suppkey, quarter_end, factor_score, available_factor_count, row_number() OVER (PARTITION BY quarter_end ORDER BY factor_score DESC, l_suppkey) AS factor_rank,
  rank() OVER (PARTITION BY quarter_end ORDER BY factor_score DESC) AS min_rank, count(factor_score) OVER (PARTITION BY quarter_end) AS candidate_count, round({_pct("factor_score", True, False)}, 6) AS factor_score_percentile
FROM (SELECT * FROM scored WHERE available_factor_count >= 3)""",
    "score_summary": f"""WITH {_SCORED} SELECT quarter_end, count(factor_score) AS n, round(avg(factor_score), 6) AS mean, round(median(factor_score), 6) AS median, min(factor_score) AS min, max(factor_score) AS max,
  count(*) FILTER (available_factor_count = 3) AS n_three, count(*) FILTER (available_factor_count = 4) AS n_four FROM scored GROUP BY quarter_end""",
    "topn_capped_weights": f"WITH {_IDX} SELECT quarter_end, l_suppkey, factor_score, round(raw_weight, 8) AS raw_weight, round(weight, 8) AS weight, weight_capped, round(effective_cap, 8) AS effective_cap, n_constituents FROM idx",
    "rebalance_summary": f"""WITH {_IDX} SELECT quarter_end, count(*) AS n, count(*) FILTER (weight_capped) AS n_capped, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS weight_max, round(min(weight), 6) AS weight_min,
  round(sum(weight) FILTER (r <= 5), 6) AS top5, round(sum(weight * weight), 6) AS hhi, round(1 / sum(weight * weight), 6) AS effective_n
FROM (SELECT *, row_number() OVER (PARTITION BY quarter_end ORDER BY weight DESC, s DESC, l_suppkey) AS r FROM idx) GROUP BY quarter_end""",
    "special_removal": f"WITH {_IDX} SELECT quarter_end, l_suppkey, round(weight / sum(weight) OVER (PARTITION BY quarter_end), 8) AS weight FROM idx WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)",
    "weight_diff": f"""WITH {_BOTH} SELECT quarter_end, round(max(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))), 8) AS max_weight_diff, count(*) FILTER ((coalesce(a.weight, 0) > 0) <> (coalesce(b.weight, 0) > 0)) AS membership_changes
FROM idx a FULL JOIN gated b USING (quarter_end, l_suppkey) GROUP BY quarter_end""",
    "topn_diff": f"""WITH {_BOTH}, x AS (SELECT quarter_end, l_suppkey FROM idx), y AS (SELECT quarter_end, l_suppkey FROM gated)
SELECT *, 'DROPPED' AS change FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT *, 'ADDED' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""",
    "determinism_check": "SELECT CAST(0 AS DOUBLE) AS max_weight_diff, CAST(0 AS BIGINT) AS membership_changes",
    "rebalance_ledger": f"""WITH {_IDX}, {_DAYS.replace("scored", "idx")}, m AS (SELECT i, l_suppkey FROM idx JOIN days USING (quarter_end)),
j AS (SELECT coalesce(a.i, b.i + 1) AS i, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, CASE WHEN b.i IS NULL THEN 'NEW_ADD' WHEN a.i IS NULL THEN 'DROP' ELSE 'MAINTAIN' END AS action
  FROM m a FULL JOIN m b ON a.i = b.i + 1 AND a.l_suppkey = b.l_suppkey)
SELECT quarter_end, l_suppkey, action FROM j JOIN days USING (i)""",
    "membership_ledger": f"""WITH {_IDX}, ok AS (SELECT quarter_end, l_suppkey, factor_score, rank() OVER (PARTITION BY quarter_end ORDER BY factor_score DESC) AS rank FROM scored WHERE available_factor_count >= 3),
days AS (SELECT quarter_end, row_number() OVER (ORDER BY quarter_end) AS i FROM (SELECT DISTINCT quarter_end FROM ok)), m AS (SELECT i, l_suppkey FROM idx JOIN days USING (quarter_end)),
c AS (SELECT quarter_end, l_suppkey, s_acctbal >= 0 AS te, CASE WHEN s_acctbal < 0 AND l_suppkey % 2 = 0 THEN 'NEGATIVE_BALANCE' ELSE '' END AS tr FROM scored JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey % 5 <> 0),
j AS (SELECT coalesce(c.quarter_end, ok.quarter_end) AS quarter_end, coalesce(c.l_suppkey, ok.l_suppkey) AS l_suppkey, coalesce(te, true) AS theme_eligible, tr, factor_score, rank, ok.l_suppkey IS NOT NULL AS data_eligible
  FROM c FULL JOIN ok ON c.quarter_end = ok.quarter_end AND c.l_suppkey = ok.l_suppkey),
r AS (SELECT j.*, a.i IS NOT NULL AS now, b.i IS NOT NULL AS was FROM j JOIN days USING (quarter_end) LEFT JOIN m a ON a.i = days.i AND a.l_suppkey = j.l_suppkey LEFT JOIN m b ON b.i = days.i - 1 AND b.l_suppkey = j.l_suppkey)
SELECT quarter_end, l_suppkey, CASE WHEN was THEN 'IN' ELSE 'OUT' END AS previous_membership, CASE WHEN now THEN 'IN' ELSE 'OUT' END AS current_membership,
  CASE WHEN now AND was THEN 'MAINTAIN' WHEN now THEN 'ADD' WHEN was THEN 'DROP' ELSE 'NONE' END AS action,
  CASE WHEN now THEN 'FACTOR_SCORE_TOP30' WHEN NOT theme_eligible THEN coalesce(nullif(tr, ''), 'THEME_DIRECTNESS_LOW') WHEN NOT data_eligible THEN 'DATA_OR_FACTOR_SCREEN' ELSE 'FACTOR_SCORE_OUTSIDE_TOP30' END AS reason_code,
  factor_score, CAST(rank AS INTEGER) AS rank, theme_eligible, data_eligible FROM r""",
    "quota_selection": f"WITH {_SELECT} SELECT * FROM quota_selection",
    "selection_rationale": """WITH p AS (SELECT p_partkey AS ticker, p_name AS entity_name, p_brand AS theme, p_type AS sub_theme, p_brand AS quota_theme, p_size * 2.0::DOUBLE AS ai_relevance_score, p_size * 2 AS candidate_score, p_retailprice AS data_quality_score, p_partkey % 14 AS factor_available_count FROM part),
mm AS (SELECT min(data_quality_score) AS q0, max(data_quality_score) AS q1, min(factor_available_count)::DOUBLE AS f0, max(factor_available_count)::DOUBLE AS f1 FROM p),
c AS (SELECT p.*, coalesce((data_quality_score - q0) / (q1 - q0) * 100, 50) AS quality_component, coalesce((factor_available_count - f0) / (f1 - f0) * 100, 50) AS factor_component, CASE WHEN theme LIKE '%1' THEN 6 ELSE 2 END AS quota FROM p, mm),
s AS (SELECT *, round_even(0.6::DOUBLE * ai_relevance_score + 0.25::DOUBLE * quality_component + 0.15::DOUBLE * factor_component, 4) AS selection_score FROM c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY selection_score DESC, ai_relevance_score DESC, ticker) AS r FROM s),
rest AS (SELECT *, row_number() OVER (ORDER BY selection_score DESC, ai_relevance_score DESC, ticker) AS f FROM ranked WHERE r > quota),
chosen AS (SELECT * EXCLUDE r, 'theme_quota' AS selection_stage FROM ranked WHERE r <= quota UNION ALL SELECT * EXCLUDE (r, f), 'shortage_fill' FROM rest WHERE f <= 100 - (SELECT count(*) FROM ranked WHERE r <= quota)),
u AS (SELECT *, CAST(row_number() OVER (ORDER BY selection_score DESC, ai_relevance_score DESC, ticker) AS INTEGER) AS universe_rank FROM chosen QUALIFY universe_rank <= 100)
SELECT universe_rank, ticker, entity_name, theme, sub_theme, quota_theme, selection_stage, candidate_score, ai_relevance_score, selection_score, data_quality_score, factor_available_count, round(quality_component, 6) AS quality_component, round(factor_component, 6) AS factor_component,
  theme || '/' || sub_theme || ': candidate score ' || CAST(candidate_score AS INTEGER) || ', selection score ' || printf('%.1f', round(selection_score, 1)) || ' (relevance 60% x ' || printf('%.0f', round(ai_relevance_score, 0)) || ', quality 25% x ' || printf('%.0f', round(quality_component, 0))
  || ', factors 15% x ' || printf('%.0f', round(factor_component, 0)) || '); ' || CASE WHEN selection_stage = 'theme_quota' THEN 'theme quota' ELSE 'shortage fill' END || ', rank ' || universe_rank || '; data quality ' || printf('%.0f', round(data_quality_score, 0)) || ', factors ' || factor_available_count || ' of 13' AS selection_reason_doc FROM u""",
    "quota_trim": f"WITH {_TRIM} SELECT * FROM quota_selection",
    "quota_summary": f"""WITH {_SELECT}, t AS (SELECT p_brand, count(*) AS matched FROM part GROUP BY p_brand), s AS (SELECT p_brand, count(*) AS selected FROM quota_selection GROUP BY p_brand),
r AS (SELECT p_brand, matched, coalesce(selected, 0) AS selected FROM t LEFT JOIN s USING (p_brand))
SELECT p_brand, CAST(matched AS BIGINT) AS matched, CAST(selected AS BIGINT) AS selected FROM r UNION ALL SELECT 'TOTAL', CAST(sum(matched) AS BIGINT), CAST(sum(selected) AS BIGINT) FROM r""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
