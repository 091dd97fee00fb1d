"""Queries that fit and apply models. Trees and iterative fits have no SQL twin; the ridge has."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayside.functions.columns import rounded
from wayside.operators import decide as choose, fatigue, folds, models, peers, scores, spectral
from wayside.operators.ordered import positions
from wayside.operators.quantiles import exact_quantiles
from wayside.plans.catalog_fatigue import STAT_SQL, cycles_sql
from wayside.plans.catalog_peers import ACV, CAR, CAR_SQL, FEATURES, TRUTH, WHOLE, deviated, prepared
from wayside.plans.catalog_rail import psd_sql
from wayside.plans.catalog_scores import OOF, f1_sql, oof
from wayside.plans.catalog_stream import recorded
from wayside.plans.inputs import LI, recordings
from wayside.plans.registry import query, rd
from wayside.session import cut, table



@query(
    "ridge_2feature",
    f"""WITH {LI}, s AS (SELECT count(*) AS n, avg(q) AS m1, avg(pulse) AS m2, avg(x) AS my, count(*) * var_pop(q) + 1 AS a, count(*) * covar_pop(q, pulse) AS b, count(*) * var_pop(pulse) + 1 AS d,
      count(*) * covar_pop(q, x) AS e, count(*) * covar_pop(pulse, x) AS f FROM li),
    w AS (SELECT *, (e * d - b * f) / (a * d - b * b) AS w1, (a * f - b * e) / (a * d - b * b) AS w2 FROM s)
    SELECT rec, {rd("avg(x - (my + w1 * (q - m1) + w2 * (pulse - m2)))", 5)} AS mean_residual, {rd("max(my + w1 * (q - m1) + w2 * (pulse - m2))", 5)} AS largest FROM li, w GROUP BY rec""",
)
def ridge_2feature(spark, sf):
    r = recordings(spark, sf)
    model = models.fit_ridge(r, ["q", "pulse"], "x")
    p = model.predict()
    return r.groupBy("rec").agg(rounded(F.avg(F.col("x") - p), 5).alias("mean_residual"), rounded(F.max(p), 5).alias("largest"))


def _ridge_sql(source: str, features: tuple[str, ...], target: str, alpha: float = 1.0) -> str:
    """Ridge slopes w0, w1, … and means of relation ``source`` by elimination, as relation ``fit``."""
    n, cols = len(features), [*features, target]
    cell = lambda i, j: f"count(*) * covar_pop({cols[i]}, {cols[j]})" + (f" + {alpha}" if i == j else "")
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(cols))
    keep = ", ".join(f"m{i}" for i in range(n + 1))
    steps = [f"e0 AS (SELECT {means}, " + ", ".join(f"{cell(i, j)} AS a{i}{j}" for i in range(n) for j in range(n + 1)) + f" FROM {source})"]
    for k in range(n):  # clear column k from every other row
        out = [f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" if i != k else f"a{i}{j}" for i in range(n) for j in range(n + 1)]
        steps.append(f"e{k + 1} AS (SELECT {keep}, {', '.join(out)} FROM e{k})")
    return ", ".join(steps) + f", fit AS (SELECT {keep}, " + ", ".join(f"a{i}{n} / a{i}{i} AS w{i}" for i in range(n)) + f" FROM e{n})"


_RF = models.RESPONSE_FEATURES


@query(
    "ridge_response",
    f"""WITH {ACV}, tr AS (SELECT * FROM prep WHERE cooling AND car <> {TRUTH} AND dt10 IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _RF)}), {_ridge_sql('tr', _RF, 'dt10')},
    r AS (SELECT case_id, car, CASE WHEN cooling THEN dt10 - (m{len(_RF)} + {' + '.join(f'w{i} * (coalesce({c}, m{i}) - m{i})' for i, c in enumerate(_RF))}) END AS resid FROM prep, fit)
    SELECT case_id, car, {rd("avg(resid)", 5)} AS resid_mean, {rd("quantile_cont(resid, 9e-1)", 5)} AS resid_p90 FROM r GROUP BY case_id, car""",
)
def ridge_response(spark, sf):
    """Expected temperature change learned on healthy cooling rows; mean and 90 % quantile of the residual per car."""
    d = cut(prepared(spark, sf))
    faulty = F.lpad((F.col("case_id") % 8 + 1).cast("string"), 2, "0")
    model = models.fit_ridge(d.where(F.col("cooling") & (F.col("car") != faulty)), models.RESPONSE_FEATURES, "dT_10")
    r = models.response_residual(d, model)
    keys = ["case_id", "car"]
    q = exact_quantiles(r, keys, "resid", {"resid_p90": 0.9})
    both = r.groupBy(*keys).agg(F.avg("resid").alias("resid_mean")).join(q, keys, "left")
    return both.select(*keys, rounded("resid_mean", 5).alias("resid_mean"), rounded("resid_p90", 5).alias("resid_p90"))


@query(
    "car_table",
    f"""WITH {ACV}, {CAR_SQL}, tr AS (SELECT * FROM prep WHERE cooling AND car <> {TRUTH} AND dt10 IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _RF)}), {_ridge_sql('tr', _RF, 'dt10')},
    r AS (SELECT case_id, car, CASE WHEN cooling THEN dt10 - (m{len(_RF)} + {' + '.join(f'w{i} * (coalesce({c}, m{i}) - m{i})' for i, c in enumerate(_RF))}) END AS resid FROM prep, fit),
    rf AS (SELECT case_id, car, avg(resid) AS resid_mean, quantile_cont(resid, 9e-1) AS resid_p90 FROM r GROUP BY case_id, car)
    SELECT case_id, car, {', '.join(WHOLE)}, {", ".join(f"{rd(c)} AS {c}" for c in FEATURES)}, {rd("resid_mean", 5)} AS resid_mean, {rd("resid_p90", 5)} AS resid_p90
    FROM car_f JOIN rf USING (case_id, car)""",
)
def car_table(spark, sf):
    """All features of every car, with what the response model learned on healthy cars does not explain."""
    rows = deviated(spark, sf)
    faulty = F.lpad((F.col("case_id") % 8 + 1).cast("string"), 2, "0")
    model = models.fit_ridge(rows.where(F.col("cooling") & (F.col("car") != faulty)), models.RESPONSE_FEATURES, "dT_10")
    f = peers.car_features(cut(models.response_residual(rows, model)), ["case_id", "car"], CAR.sampled(rows))
    residuals = [rounded(c, 5).alias(c) for c in ("resid_mean", "resid_p90")]
    return f.select("case_id", "car", *WHOLE, *[rounded(c).alias(c) for c in FEATURES], *residuals)


def vector_rows(spark, sf):
    """Vectors with their 64 values as columns and a binary class."""
    e = table(spark, sf, "embeddings")
    names = [f"v{i}" for i in range(64)]
    cols = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]
    return e.select("vec_id", (F.col("label") >= 7).cast("double").alias("y"), *cols), names


@query("rf_scores")
def rf_scores(spark, sf):
    rows, names = vector_rows(spark, sf)
    forest = models.fit_forest(rows, names, "y", models.DOOR_TREES, models.DOOR_LEAF)
    return models.probability(forest, rows, ["vec_id"])


def labelled(spark, sf):
    return oof(spark, sf).withColumn("y", (F.col("label") != "Normal").cast("double"))


@query("lr_scores")
def lr_scores(spark, sf):
    rows = labelled(spark, sf)
    model = models.fit_logistic(rows, ["p1", "p2", "q1", "q2"], "y")
    return models.probability(model, rows, ["unit_id"])


@query("ensemble_scores")
def ensemble_scores(spark, sf):
    """Mean of the forest and the logistic regression, both on all features."""
    rows, names = vector_rows(spark, sf)
    forest = models.fit_forest(rows, names, "y", models.DOOR_TREES, models.DOOR_LEAF)
    logistic = models.fit_logistic(rows, names, "y")
    return models.ensemble([models.probability(m, rows, ["vec_id"]) for m in (forest, logistic)], ["vec_id"])


@query("huber_fit")
def huber_fit(spark, sf):
    """Robust regression of the mean signal of a series on its other statistics."""
    s = cut(fatigue.series_statistics(recordings(spark, sf), ["rec"], "x"))
    features = ["std", "ptp", "skewness", "p95_p05"]
    model = models.fit_huber(s, features, "mean")
    return model.transform(s).select("rec", "mean", "prediction")


@query("oof_table")
def oof_table(spark, sf):
    """Out-of-fold forest probabilities over four family-safe folds."""
    rows, names = vector_rows(spark, sf)
    ranked = folds.ranked(rows, "vec_id")
    unit = ranked.withColumn("fold0", folds.split_even(F.col("pos"), F.col("n"), 4)).withColumn("family", F.floor(F.col("vec_id") / 4))
    placed = cut(folds.family_folds(unit, "family", "vec_id", "fold0"))

    def fit(train, k):
        model = models.fit_forest(train, names, "y", models.DOOR_TREES, seed=k)
        return lambda test: models.probability(model, test, ["vec_id", "y"])

    return models.out_of_fold(placed, "family_fold", range(4), ["vec_id", "y"], fit)


_MODEL = "count(*) AS n, avg(p1) AS m1, avg(q1) AS m2, avg(y) AS my, count(*) * var_pop(p1) + 1 AS a, count(*) * covar_pop(p1, q1) AS b, count(*) * var_pop(q1) + 1 AS d, count(*) * covar_pop(p1, y) AS e, count(*) * covar_pop(q1, y) AS f"
_PICK = lambda seed, k: f"(row_number() OVER (PARTITION BY label ORDER BY md5(unit_id || '-{seed}'), unit_id) - 1) % {k}"
_SIGN = "CASE WHEN label = 'Normal' THEN 'Normal' ELSE 'Side I' END"


@query(
    "nested_thresholds",
    f"""WITH {OOF}, fo AS (SELECT unit_id, {_SIGN} AS label, p1, q1, CASE WHEN label = 'Normal' THEN 0e0 ELSE 1e0 END AS y, {_PICK(7, 5)} AS o_fold, {_PICK(8, 3)} AS i_fold FROM oof),
    st AS (SELECT o, i, {_MODEL} FROM fo, range(5) t(o), range(3) u(i) WHERE o_fold <> o AND i_fold <> i GROUP BY o, i UNION ALL SELECT o, -1, {_MODEL} FROM fo, range(5) t(o) WHERE o_fold <> o GROUP BY o),
    w AS (SELECT *, (e * d - b * f) / (a * d - b * b) AS w1, (a * f - b * e) / (a * d - b * b) AS w2 FROM st),
    inn AS (SELECT o, label, my + w1 * (p1 - m1) + w2 * (q1 - m2) AS p FROM fo JOIN w ON o_fold <> o AND i_fold = i),
    held AS (SELECT o, label, my + w1 * (p1 - m1) + w2 * (q1 - m2) AS p FROM fo JOIN w ON o_fold = o AND i = -1),
    g AS (SELECT r AS cand, round(5e-2 + r * 25e-3, 4) AS tau FROM range(35) t(r)),
    tried AS (SELECT o, cand, tau, label, CASE WHEN p >= tau THEN 'Side I' ELSE 'Normal' END AS pred FROM inn, g), sc AS ({f1_sql('tried', 'o, cand, tau')}),
    tied AS (SELECT *, macro_f1 >= max(macro_f1) OVER (PARTITION BY o) - 1e-12 AS t FROM sc),
    rk AS (SELECT *, row_number() OVER (PARTITION BY o, t ORDER BY cand) AS k, count(*) OVER (PARTITION BY o, t) AS c FROM tied),
    ch AS (SELECT o, tau, macro_f1 AS inner_f1 FROM rk WHERE t AND k = (c - 1) // 2 + 1),
    said AS (SELECT held.o, label, CASE WHEN p >= tau THEN 'Side I' ELSE 'Normal' END AS pred FROM held JOIN ch ON ch.o = held.o), os AS ({f1_sql('said', 'o')})
    SELECT CAST(o AS INTEGER) AS fold, tau, {rd('inner_f1')} AS inner_f1, {rd('macro_f1')} AS outer_f1 FROM ch JOIN os USING (o)""",
)
def nested_thresholds(spark, sf):
    """A threshold for every outer fold, chosen on inner out-of-fold scores of its training rows, and what it scores outside."""
    u = oof(spark, sf).select("unit_id", "label", "p1", "q1")
    outer, inner = (folds.stratified(u.select("unit_id", "label"), "unit_id", "label", k, seed).select("unit_id", F.col("fold").alias(name))
                    for k, seed, name in ((5, 7, "o_fold"), (3, 8, "i_fold")))
    faulty = F.col("label") != "Normal"
    rows = cut(u.withColumns({"y": faulty.cast("double"), "label": F.when(faulty, "Side I").otherwise("Normal")}).join(outer, "unit_id").join(inner, "unit_id"))

    def fit(train, _):
        model = models.fit_ridge(train, ["p1", "q1"], "y")
        return lambda test: test.withColumn("p", model.predict())

    sides = {"p1": F.col("p"), "p2": F.lit(0.0)}
    told = models.nested_out_of_fold(rows, "o_fold", "i_fold", range(5), range(3), ["unit_id", "label"], fit)
    chosen = choose.sweep(told.withColumns(sides), "global", ["outer"]).where("selected").select(
        F.col("outer").alias("fold"), F.col("a").alias("tau"), F.col("macro_f1").alias("inner_f1"))
    held = models.out_of_fold(rows, "o_fold", range(5), ["unit_id", "label"], fit).join(F.broadcast(chosen), "fold")  # five rows
    said = held.withColumn("pred", F.when(F.col("p") >= F.col("tau"), "Side I").otherwise("Normal"))
    outside = scores.macro_f1(said, ["fold"]).select("fold", F.col("macro_f1").alias("outer_f1"))
    return chosen.join(outside, "fold").select("fold", "tau", rounded("inner_f1").alias("inner_f1"), rounded("outer_f1").alias("outer_f1"))


@query("hierarchical_scores")
def hierarchical_scores(spark, sf):
    """Detect a fault from both sides of a vector, then say which side."""
    e = table(spark, sf, "embeddings")
    label = F.when(F.col("label") >= 8, "Side I").when(F.col("label") >= 6, "Side II").otherwise("Normal")
    names = [f"v{i}" for i in range(32)]  # all 64 channels, half of them on each side
    views = F.inline(F.array(*[
        F.struct(F.lit(s).alias("side"), *[F.col("embedding")[2 * i + s - 1].cast("double").alias(n) for i, n in enumerate(names)]) for s in (1, 2)]))
    rows = cut(e.select("vec_id", label.alias("label"), views))
    score = models.fit_hierarchical(rows, "vec_id", names, models.RAIL_TREES)
    return choose.paired_probability(score(rows.drop("label")), "vec_id", "hierarchical")


_ENERGY = [(f"log_rf_energy_range_m_{m}".replace(".", "_"), f"ln(1 + sum(cnt * pow(range, {m})))") for m in fatigue.FEATURE_EXPONENTS]
_ENERGY += [
    (f"log_rf_goodman_su_{su}_m_{m}".replace(".", "_"), f"ln(1 + sum(cnt * pow(range / 2 / greatest(1 - mean / {su}e0, 1e-3), {m})))")
    for su, m in fatigue.FEATURE_GOODMAN]
_ENERGY += [("rf_total_cycles", "sum(cnt)"), ("rf_max_range", "max(range)"), ("rf_p95_range", "quantile_cont(range, 95e-2)")]
_MOMENTS = [
    ("spec_alpha2", "m2 / (sqrt(m0 * m4) + 1e-8)"), ("spec_zero_crossing", "sqrt(m2 / (m0 + 1e-8))"), ("spec_peak_rate", "sqrt(m4 / (m2 + 1e-8))")]


@query(
    "fatigue_features",
    f"""WITH RECURSIVE {LI}, {cycles_sql('li', 'rec', 'i', 'x')}, ce AS (SELECT rec, {', '.join(f"{e} AS {n}" for n, e in _ENERGY)} FROM cyc GROUP BY rec),
    {psd_sql('ps', 'li', 'rec, n', 256, 100.0, 'n')}, mo AS (SELECT rec, sum(p) AS m0, sum(f * f * p) AS m2, sum(f * f * f * f * p) AS m4 FROM ps GROUP BY rec),
    c AS (SELECT rec, x, avg(x) OVER (PARTITION BY rec) AS mu FROM li),
    st AS (SELECT rec, {', '.join(f"{e} AS {n}" for n, e in STAT_SQL.items())} FROM c GROUP BY rec)
    SELECT rec, {', '.join(f"{rd(n, 5)} AS {n}" for n in STAT_SQL)}, {', '.join(f"{rd(e, 5)} AS {n}" for n, e in _MOMENTS)}, {', '.join(f"{rd(n, 5)} AS {n}" for n, _ in _ENERGY)}
    FROM st JOIN ce USING (rec) JOIN mo USING (rec)""",
)
def fatigue_features(spark, sf):
    f = feature_vectors(spark, sf)
    return f.select("rec", *[rounded(c, 5).alias(c) for c in f.columns if c != "rec"])


def feature_vectors(spark, sf):
    """Series statistics, spectral rates and cycle energies of every recording."""
    r, order = recorded(spark, sf)
    stats = fatigue.series_statistics(r, ["rec"], "x")
    placed = positions(r, order, "i", "n").select("rec", "i", "x")
    rates = spectral.spectral_moments(spectral.welch(placed, ["rec"], "i", "x", 100.0, 256), ["rec"])
    cycles = fatigue.cycle_statistics(fatigue.rainflow(r, order, "x"), ["rec"])
    return stats.join(rates, "rec").join(cycles, "rec")


@query("residual_damage")
def residual_damage(spark, sf):
    """Damage estimate S / C and its correction by a robust regression on the log residual."""
    f = cut(feature_vectors(spark, sf))
    base = recordings(spark, sf).groupBy("rec").agg((1 + F.sum("q")).alias("d"))
    s = f.join(base, "rec").withColumn("s", F.expm1("log_rf_energy_range_m_4_0"))
    c = fatigue.scale(s, [], "s", "d")
    est = cut(s.withColumn("estimate", F.col("s") / c.scalar()).withColumn("log_residual", F.ln(F.col("d") / F.col("estimate"))))
    names = [x for x in f.columns if x != "rec"]
    model = models.fit_huber(est, names, "log_residual")
    return models.residual_corrected(est, model, "estimate").select("rec", "d", "estimate", "corrected")
