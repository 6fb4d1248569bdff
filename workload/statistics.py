"""Multi-seed statistics, training history and experiment-grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions.distributions import t_quantile
from flowmill.operators import experiments, statistics
from flowmill.plans import compare
from workload.fixtures import FAMILY_CTE, RUNS_CTE, family_runs, r6, runs, table
from workload.registry import registry

QUERIES, ORACLES, query = registry()

_METRICS = ("accuracy", "f1_macro", "auc")
# 97.5 % points of Student's t by degrees of freedom, for the SQL side.
_T = "CASE n {} END".format(" ".join(f"WHEN {k + 1} THEN {t_quantile(0.975, k)!r}::DOUBLE" for k in range(1, 7)))


def _summary_sql(m: str) -> str:
    return f"""round(avg({m}),6) AS {m}_mean, round(coalesce(stddev_samp({m}),0),6) AS {m}_std,
    round(CASE WHEN count({m})=1 THEN 0 ELSE max(t)*coalesce(stddev_samp({m}),0)/sqrt(count({m})) END,6) AS {m}_ci95_halfwidth,
    printf('%.4f ± %.4f', avg({m}), coalesce(stddev_samp({m}),0)) AS {m}_mean_std"""


@query(
    "stats_summarize",
    f"""WITH {RUNS_CTE}, s AS (SELECT *, count(*) OVER (PARTITION BY dataset, model) AS n FROM runs), q AS (SELECT *, {_T} AS t FROM s)
    SELECT dataset, model, count(*) AS n_runs, {', '.join(_summary_sql(m) for m in _METRICS)} FROM q GROUP BY dataset, model""",
)
def stats_summarize(spark, sf):
    out = statistics.summarize(runs(spark, sf), ["dataset", "model"])
    return out.select(
        "dataset", "model", "n_runs",
        *[c for m in _METRICS for c in (
            r6(F.col(f"{m}_mean")).alias(f"{m}_mean"), r6(F.col(f"{m}_std")).alias(f"{m}_std"),
            r6(F.col(f"{m}_ci95_halfwidth")).alias(f"{m}_ci95_halfwidth"), F.col(f"{m}_mean_std"),
        )],
    )


_LONG = f"""{RUNS_CTE}, long AS (SELECT dataset, model, seed, 'accuracy' AS metric, accuracy AS value FROM runs UNION ALL
 SELECT dataset, model, seed, 'f1_macro', f1_macro FROM runs UNION ALL SELECT dataset, model, seed, 'auc', auc FROM runs)"""
_PAIRS = f"""{_LONG}, pairs AS (SELECT a.dataset, a.metric, b.model AS other, a.seed, a.value AS va, b.value AS vb, round(a.value-b.value,12) AS d
 FROM long a JOIN long b ON a.dataset=b.dataset AND a.metric=b.metric AND a.seed=b.seed WHERE a.model='m0' AND b.model<>'m0')"""


@query(
    "join_seed_pairs",
    f"WITH {_PAIRS} SELECT dataset, metric, other, CAST(seed AS DOUBLE) AS seed, va AS value_a, vb AS value_b FROM pairs",
)
def join_seed_pairs(spark, sf):
    long = statistics.melt_metrics(runs(spark, sf), ["dataset", "model", "seed"], _METRICS)
    named = statistics.comparison_pairs(long, _comparisons(spark, sf), ["dataset"], "model")
    return named.select(
        "dataset", "metric", F.col("comparison_b").alias("other"), "seed", "value_a", "value_b"
    )


def _comparisons(spark, sf):
    """m0 against every other model that has runs."""
    return runs(spark, sf).select("model").distinct().where("model <> 'm0'").select(
        F.lit("m0").alias("comparison_a"), F.col("model").alias("comparison_b")
    )


# The exact null distribution is counted over all sign patterns of the ranks.
_TESTS = f"""{_PAIRS}, nz AS (SELECT * FROM pairs WHERE d<>0),
 rk AS (SELECT *, rank() OVER (PARTITION BY dataset, metric, other ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, metric, other, abs(d))-1)/2.0 AS r FROM nz),
 w AS (SELECT dataset, metric, other, count(*) AS n, least(coalesce(sum(r) FILTER (d>0),0), coalesce(sum(r) FILTER (d<0),0))::DOUBLE AS stat FROM rk GROUP BY ALL),
 ns AS (SELECT DISTINCT n FROM w),
 sums AS (SELECT ns.n, m.range AS mask, (SELECT coalesce(sum(i.range+1),0) FROM range(30) i WHERE i.range < ns.n AND ((m.range >> i.range) & 1) = 1) AS s FROM ns, range(128) m WHERE m.range < (1 << ns.n)),
 p AS (SELECT w.*, least(1.0::DOUBLE, 2.0::DOUBLE*(SELECT count(*) FROM sums WHERE sums.n=w.n AND s <= stat)/(1 << w.n)) AS p FROM w),
 e AS (SELECT dataset, metric, other, count(*) AS n_pairs, avg(va) AS mean_a, avg(vb) AS mean_b, avg(va-vb) AS mean_difference, median(d) AS median_difference,
  count(*) FILTER (d>0) AS wins_a, count(*) FILTER (abs(d)<=1e-8) AS ties, count(*) FILTER (d<0) AS wins_b FROM pairs GROUP BY ALL),
 tests AS (SELECT e.*, p.stat AS statistic, p.p AS p_value FROM e JOIN p ON p.dataset=e.dataset AND p.metric=e.metric AND p.other=e.other WHERE n_pairs>=2)"""
_EFFECTS = ("mean_a", "mean_b", "mean_difference", "median_difference", "statistic", "p_value")


def _tests(spark, sf):
    long = statistics.melt_metrics(runs(spark, sf), ["dataset", "model", "seed"], _METRICS)
    pairs = statistics.comparison_pairs(long, _comparisons(spark, sf), ["dataset"], "model")
    return pairs.select("dataset", "metric", F.col("comparison_b").alias("other"), "value_a", "value_b")


@query(
    "stats_wilcoxon",
    f"""WITH {_TESTS} SELECT dataset, metric, other, n_pairs, {', '.join(f'round({c},6) AS {c}' for c in _EFFECTS)}, wins_a, ties, wins_b, n_pairs>=6 AS can_reach_0_05 FROM tests""",
)
def stats_wilcoxon(spark, sf):
    out = statistics.paired_signed_rank(_tests(spark, sf), ["dataset", "metric", "other"])
    return out.withColumns({c: r6(F.col(c)) for c in _EFFECTS})


_HOLM = """h AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER (PARTITION BY dataset, metric) - row_number() OVER (PARTITION BY dataset, metric ORDER BY p_value, other) + 1)*p_value) AS step,
 row_number() OVER (PARTITION BY dataset, metric ORDER BY p_value, other) AS pos FROM tests),
 adj AS (SELECT *, max(step) OVER (PARTITION BY dataset, metric ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p_holm FROM h)"""


@query(
    "stats_holm",
    f"WITH {_TESTS}, {_HOLM} SELECT dataset, metric, other, round(p_value,6) AS p_value, round(p_holm,6) AS p_holm, p_holm < 0.05 AS significant_0_05 FROM adj",
)
def stats_holm(spark, sf):
    tests = compare.pairwise_tests(runs(spark, sf), _comparisons(spark, sf), ["dataset"], "model", _METRICS)
    return tests.select(
        "dataset", "metric", F.col("comparison_b").alias("other"),
        r6(F.col("p_value")).alias("p_value"), r6(F.col("p_holm")).alias("p_holm"), "significant_0_05",
    )


# Explicit window runs exist for the first three seeds; the others are back-filled.
_FAMILIES = f"""{RUNS_CTE}, fam AS (SELECT 'main' AS family, dataset, model, seed, CAST(NULL AS INT) AS seq_len, accuracy FROM runs
 UNION ALL SELECT 'window', dataset, model, seed, 16, accuracy FROM runs WHERE model='m0' AND seed<=3)"""


@query(
    "antijoin_reference_rows",
    f"""WITH {_FAMILIES} SELECT family, dataset, model, seed, seq_len, accuracy FROM fam UNION ALL
    SELECT 'window', dataset, model, seed, 16, accuracy FROM fam f WHERE family='main' AND model='m0' AND NOT EXISTS
    (SELECT 1 FROM fam g WHERE g.family='window' AND g.dataset=f.dataset AND g.seed=f.seed AND g.seq_len=16)""",
)
def antijoin_reference_rows(spark, sf):
    base = runs(spark, sf).select("dataset", "model", "seed", "accuracy")
    main = base.withColumns({"family": F.lit("main"), "seq_len": F.lit(None).cast("int")})
    explicit = base.where("model = 'm0' AND seed <= 3").withColumns(
        {"family": F.lit("window"), "seq_len": F.lit(16)}
    )
    everything = main.unionByName(explicit)
    back = statistics.backfill_reference(
        everything, main.where("model = 'm0'"), {"seq_len": F.lit(16)}, ["dataset", "seed", "seq_len"], "window"
    )
    return everything.unionByName(back).select("family", "dataset", "model", "seed", "seq_len", "accuracy")


# --- all families of runs -----------------------------------------------------

_ROW = "family, dataset, model, variant, seed, {} AS seq_len, {} AS leakage_protocol, {} AS record_order, {} AS relative_path, accuracy, f1_macro, auc"


def _backfill_sql(family: str, where: str, keys: str, seq_len="seq_len", protocol="leakage_protocol", order="record_order", path="relative_path") -> str:
    row = _ROW.format(seq_len, protocol, order, path).replace("family,", f"'{family}' AS family,", 1)
    return f"""SELECT * FROM (SELECT {row} FROM family_runs WHERE family = 'main' AND {where}) x
     WHERE NOT EXISTS (SELECT 1 FROM family_runs e WHERE e.family = '{family}' AND {' AND '.join(f'e.{k} = x.{k}' for k in keys.split())})"""


_BACKFILLED = f"""{FAMILY_CTE}, filled AS (SELECT * FROM family_runs
 UNION ALL {_backfill_sql('leakage', "dataset = 'R' AND model IN ('m0', 'm3')", 'model seed leakage_protocol', protocol="'clean'")}
 UNION ALL {_backfill_sql('window', "model = 'm0'", 'dataset seed seq_len', seq_len='16')}
 UNION ALL {_backfill_sql('order_sanity', "model = 'm0'", 'dataset seed record_order', order="'original'")}"""
_BASE_RUNS = "dataset = 'R' AND model = 'm0'"
for _p, _v in compare.BASE_TOKENS.items():
    _path = f"concat('hyper/{_p}/{_v}/seed_', seed, '/metrics.json')"
    _BACKFILLED += f" UNION ALL {_backfill_sql('hyper', _BASE_RUNS, 'relative_path', path=_path)}"
_BACKFILLED += ")"


def _filled(spark, sf):
    return compare.add_reference_rows(family_runs(spark, sf), "m0", "R", ["m0", "m3"])


@query("antijoin_reference_families", f"WITH {_BACKFILLED} SELECT * FROM filled")
def antijoin_reference_families(spark, sf):
    """The base setting of every family, taken from the main runs where no explicit run exists."""
    return _filled(spark, sf)


_SUMMARY_KEYS = {
    "main": ("dataset", "model", "variant"), "leakage": ("leakage_protocol", "model"), "window": ("dataset", "seq_len"),
    "order_sanity": ("dataset", "record_order"), "temporal": ("dataset", "model"),
    "hyper": ("sensitivity_parameter", "sensitivity_value"), "ablation": ("dataset", "ablation_variant"),
}
_SUMMARY_SQL = {
    "hyper": "SELECT *, split_part(relative_path, '/', 2) AS sensitivity_parameter, split_part(relative_path, '/', 3) AS sensitivity_value FROM filled WHERE family = 'hyper'",
    "ablation": "SELECT *, CASE family WHEN 'main' THEN 'full' ELSE variant END AS ablation_variant FROM filled WHERE family = 'ablation' OR (family = 'main' AND model = 'm0')",
}


def _keys_sql(keys: tuple) -> str:
    texts = [f"CAST({k} AS VARCHAR)" for k in keys] + ["NULL"] * (3 - len(keys))
    return ", ".join(f"{t} AS key_{i}" for i, t in enumerate(texts, 1))


_SUMMARISED = " UNION ALL ".join(
    f"SELECT '{name}' AS summary, {_keys_sql(keys)}, accuracy, f1_macro, auc FROM ("
    + _SUMMARY_SQL.get(name, f"SELECT * FROM filled WHERE family = '{name}'") + ")"
    for name, keys in _SUMMARY_KEYS.items()
)


@query(
    "report_family_summaries",
    f"""WITH {_BACKFILLED}, u AS ({_SUMMARISED}), s AS (SELECT *, count(*) OVER (PARTITION BY summary, key_1, key_2, key_3) AS n FROM u), q AS (SELECT *, {_T} AS t FROM s)
    SELECT summary, key_1, key_2, key_3, count(*) AS n_runs, {', '.join(_summary_sql(m) for m in _METRICS)} FROM q GROUP BY summary, key_1, key_2, key_3""",
)
def report_family_summaries(spark, sf):
    """The summary tables of all families, keys as texts, one below the other."""
    out = None
    for name, rows in compare.summaries(_filled(spark, sf), "m0").items():
        keys = [F.col(k).cast("string") for k in _SUMMARY_KEYS[name]]
        keys += [F.lit(None).cast("string")] * (3 - len(keys))
        part = rows.select(
            F.lit(name).alias("summary"), *[k.alias(f"key_{i}") for i, k in enumerate(keys, 1)], "n_runs",
            *[c for m in _METRICS for c in (
                r6(F.col(f"{m}_mean")).alias(f"{m}_mean"), r6(F.col(f"{m}_std")).alias(f"{m}_std"),
                r6(F.col(f"{m}_ci95_halfwidth")).alias(f"{m}_ci95_halfwidth"), F.col(f"{m}_mean_std"),
            )],
        )
        out = part if out is None else out.unionByName(part)
    return out


_VARIANTS = "(VALUES ('no_multiscale'), ('no_attention'), ('no_focal_loss')) v(b)"
_FAMILY_PAIRS = f"""{_BACKFILLED}, arms AS (
 SELECT 'main' AS family, dataset AS context, model AS arm, seed, accuracy, f1_macro, auc FROM filled WHERE family = 'main'
 UNION ALL SELECT 'ablation', dataset, CASE family WHEN 'main' THEN 'full' ELSE variant END, seed, accuracy, f1_macro, auc FROM filled WHERE family = 'ablation' OR (family = 'main' AND model = 'm0')
 UNION ALL SELECT 'leakage', model, leakage_protocol, seed, accuracy, f1_macro, auc FROM filled WHERE family = 'leakage'
 UNION ALL SELECT 'order_sanity', dataset, record_order, seed, accuracy, f1_macro, auc FROM filled WHERE family = 'order_sanity'),
 cmp AS (SELECT DISTINCT 'main' AS family, 'm0' AS a, model AS b FROM filled WHERE family = 'main' AND model <> 'm0' UNION ALL SELECT 'ablation', 'full', b FROM {_VARIANTS}
  UNION ALL SELECT 'leakage', a, 'clean' FROM (VALUES ('attack_cat'), ('id'), ('both')) v(a) UNION ALL SELECT 'order_sanity', 'original', 'shuffled'),
 cells AS (UNPIVOT arms ON accuracy, f1_macro, auc INTO NAME metric VALUE value),
 pairs AS (SELECT x.family AS dataset, x.metric, x.context || '|' || c.a || '|' || c.b AS other, x.seed, x.value AS va, y.value AS vb, round(x.value - y.value, 12) AS d
  FROM cmp c JOIN cells x ON x.family = c.family AND x.arm = c.a JOIN cells y ON y.family = c.family AND y.arm = c.b AND y.context = x.context AND y.metric = x.metric AND y.seed = x.seed)"""
_FAMILY_TESTS = _FAMILY_PAIRS + _TESTS[len(_PAIRS):]


@query(
    "report_family_tests",
    f"""WITH {_FAMILY_TESTS}, named AS (SELECT *, split_part(other, '|', 1) AS context, split_part(other, '|', 2) AS comparison_a, split_part(other, '|', 3) AS comparison_b FROM tests),
    h AS (SELECT *, row_number() OVER (PARTITION BY dataset, context, metric ORDER BY p_value, comparison_a, comparison_b) AS pos, count(*) OVER (PARTITION BY dataset, context, metric) AS m FROM named),
    adj AS (SELECT *, max(least(1.0::DOUBLE, (m - pos + 1) * p_value)) OVER (PARTITION BY dataset, context, metric ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p_holm FROM h)
    SELECT dataset AS family, CASE WHEN dataset <> 'leakage' THEN context END AS dataset, CASE WHEN dataset = 'leakage' THEN context END AS model, metric, comparison_a, comparison_b,
    n_pairs, {', '.join(f'round({c},6) AS {c}' for c in _EFFECTS)}, wins_a, ties, wins_b, round(p_holm,6) AS p_holm, p_holm < 0.05 AS significant_0_05 FROM adj""",
)
def report_family_tests(spark, sf):
    """Every listed comparison of the main, ablation, leakage and order families."""
    tests = compare.family_tests(_filled(spark, sf), "m0", _METRICS)
    return tests.select(
        "family", "dataset", "model", "metric", "comparison_a", "comparison_b", "n_pairs",
        *[r6(F.col(c)).alias(c) for c in _EFFECTS], "wins_a", "ties", "wins_b",
        r6(F.col("p_holm")).alias("p_holm"), "significant_0_05",
    )


@query(
    "history_best_epoch",
    """WITH h AS (SELECT user_id AS run_id, event_id AS epoch, value/500 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    b AS (SELECT *, max(v) OVER (PARTITION BY run_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM h),
    l AS (SELECT *, max(CASE WHEN best IS NULL OR v>best THEN i END) OVER (PARTITION BY run_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS last FROM b),
    s AS (SELECT run_id, max(v) AS best_value, min(CASE WHEN i-last>=10 THEN epoch END) AS stop_epoch FROM l GROUP BY run_id)
    SELECT s.run_id, (SELECT min(epoch) FROM h WHERE h.run_id=s.run_id AND h.v=s.best_value) AS best_epoch, round(best_value,6) AS best_value, stop_epoch FROM s""",
)
def history_best_epoch(spark, sf):
    history = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"), (F.col("value") / 500).alias("val_f1_macro")
    )
    return statistics.best_and_stop_epoch(history).withColumn("best_value", r6(F.col("best_value")))


_DISPLAY = {"m0": "Main", "m1": "MLP", "m2": "CNN", "m3": "GRU"}


@query(
    "report_macro_f1_table",
    f"""WITH {RUNS_CTE} SELECT dataset, CASE model WHEN 'm0' THEN 'Main' WHEN 'm1' THEN 'MLP' WHEN 'm2' THEN 'CNN' ELSE 'GRU' END AS model,
    seed, printf('%.4f', f1_macro) AS macro_f1 FROM runs""",
)
def report_macro_f1_table(spark, sf):
    rows = runs(spark, sf)
    return statistics.macro_f1_report(rows, _DISPLAY, keep=["seed"])


# --- experiment grid ----------------------------------------------------------

_SPEC = experiments.GridSpec(
    datasets=["A", "N", "R"], seeds=[1, 2, 3, 4, 5, 6], models=["m0", "m1", "m2", "m3"], main_model="m0",
    repeated={"A": ["m0", "m1"], "N": ["m0", "m2"], "R": ["m0", "m3"]}, leakage_dataset="R",
    leakage_models=["m0", "m3"], temporal_dataset="A", temporal_models=["m0", "m1"],
)

_HYPER_SQL = " UNION ALL ".join(
    f"SELECT 'hyper' AS family, 'R' AS dataset, 'm0' AS model, 1 AS seed, 'hyper/{p}/{v.replace('.', 'p')}/seed_1' AS output_path, "
    + ("'main/R/m0/seed_1'" if v == experiments.HYPER_BASE[p] else "NULL") + " AS reuse_path"
    for p, values in experiments.HYPER_VALUES.items() for v in values
)
_GRID = f"""ds AS (SELECT unnest(['A','N','R']) AS dataset), sd AS (SELECT unnest([1,2,3,4,5,6]) AS seed), md AS (SELECT unnest(['m0','m1','m2','m3']) AS model),
 rep(dataset, model) AS (VALUES ('A','m0'),('A','m1'),('N','m0'),('N','m2'),('R','m0'),('R','m3')),
 plan AS (
 SELECT 'main' AS family, dataset, model, 1 AS seed, concat('main/',dataset,'/',model,'/seed_1') AS output_path, NULL AS reuse_path FROM ds, md
 UNION ALL SELECT 'main', dataset, model, seed, concat('main/',dataset,'/',model,'/seed_',seed), NULL FROM rep, sd WHERE seed>1
 UNION ALL SELECT 'ablation', dataset, 'm0', seed, concat('ablation/',dataset,'/',v,'/seed_',seed), NULL FROM ds, sd, (SELECT unnest(['no_multiscale','no_attention','no_focal_loss']) AS v)
 UNION ALL SELECT 'window', dataset, 'm0', 1, concat('window/',dataset,'/L',l,'/seed_1'), CASE WHEN l=16 THEN concat('main/',dataset,'/m0/seed_1') END FROM ds, (SELECT unnest([1,8,16,32]) AS l)
 UNION ALL SELECT 'order_sanity', dataset, 'm0', 1, concat('order_sanity/',dataset,'/',o,'/seed_1'), CASE WHEN o='original' THEN concat('main/',dataset,'/m0/seed_1') END FROM ds, (SELECT unnest(['original','shuffled']) AS o)
 UNION ALL SELECT 'leakage', 'R', model, seed, concat('leakage/',pr,'/',model,'/seed_',seed), CASE WHEN pr='clean' THEN concat('main/R/',model,'/seed_',seed) END
  FROM (SELECT unnest(['m0','m3']) AS model), sd, (SELECT unnest(['clean','attack_cat','id','both']) AS pr) WHERE seed<=3
 UNION ALL {_HYPER_SQL}
 UNION ALL SELECT 'temporal', 'A', model, 1, concat('temporal/',model,'/seed_1'), NULL FROM (SELECT unnest(['m0','m1']) AS model))"""


@query(
    "plan_grid",
    f"""WITH {_GRID}, n AS (SELECT l_returnflag AS dataset, l_linenumber AS seed, count(*) AS rows FROM lineitem GROUP BY ALL)
    SELECT family, plan.dataset, model, plan.seed, output_path, reuse_path, coalesce(rows,0) AS rows FROM plan LEFT JOIN n ON n.dataset=plan.dataset AND n.seed=plan.seed""",
)
def plan_grid(spark, sf):
    """The grid, with the number of records each planned run would read."""
    plan = experiments.plan_grid(spark, _SPEC)
    sizes = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("dataset"), F.col("l_linenumber").alias("seed")
    ).agg(F.count(F.lit(1)).alias("rows"))
    return plan.join(sizes, ["dataset", "seed"], "left").select(
        "family", "dataset", "model", "seed", "output_path", "reuse_path", F.coalesce("rows", F.lit(0)).alias("rows")
    )


_DONE = "concat('main/', l_returnflag, '/m', CAST(l_suppkey % 4 AS {}), '/seed_', CAST(l_linenumber AS {}))"


@query(
    "plan_pending",
    f"""WITH {_GRID}, done AS (SELECT {_DONE.format('VARCHAR', 'VARCHAR')} AS p FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_quantity >= 26 THEN 1 ELSE -1 END) >= 0)
    SELECT family, dataset, model, seed, output_path FROM plan WHERE output_path NOT IN (SELECT p FROM done) AND (reuse_path IS NULL OR reuse_path NOT IN (SELECT p FROM done))""",
)
def plan_pending(spark, sf):
    """A run counts as finished if at least half of its records hold 26 pieces or more."""
    run = F.expr(_DONE.format("STRING", "STRING")).alias("output_path")
    balance = F.sum(F.when(F.col("l_quantity") >= 26, 1).otherwise(-1)).alias("balance")
    done = table(spark, sf, "lineitem").groupBy(run).agg(balance).where("balance >= 0").select("output_path")
    pending = experiments.plan_pending(experiments.plan_grid(spark, _SPEC), done)
    return pending.select("family", "dataset", "model", "seed", "output_path")


_VARIANT = "CASE l_suppkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'no_multiscale' WHEN 2 THEN 'no_attention' ELSE 'no_focal_loss' END"


@query(
    "ablation_variants",
    f"""WITH b AS (SELECT {_VARIANT} AS variant, '3,5,7' AS kernel_sizes, 'true' AS channel_attention, 'true' AS temporal_attention, 'true' AS focal_loss, count(*) AS rows, min(l_quantity) AS low FROM lineitem GROUP BY 1)
    SELECT variant, CASE WHEN variant='no_multiscale' THEN '3' ELSE kernel_sizes END AS kernel_sizes, CASE WHEN variant='no_attention' THEN 'false' ELSE channel_attention END AS channel_attention,
    CASE WHEN variant='no_attention' THEN 'false' ELSE temporal_attention END AS temporal_attention, CASE WHEN variant='no_focal_loss' THEN 'false' ELSE focal_loss END AS focal_loss, rows FROM b""",
)
def ablation_variants(spark, sf):
    base = table(spark, sf, "lineitem").groupBy(F.expr(_VARIANT).alias("variant")).agg(
        F.count(F.lit(1)).alias("rows")
    ).withColumns(
        {"kernel_sizes": F.lit("3,5,7"), "channel_attention": F.lit("true"), "temporal_attention": F.lit("true"), "focal_loss": F.lit("true")}
    )
    return experiments.apply_overrides(base)
