"""Queries on predictions: interval matching, scores, decision sweeps, folds and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayside.functions.columns import DAY_US, decide, rounded
from wayside.operators import cycles, decide as choose, folds, intervals, ordered, scores
from wayside.plans.catalog_stream import recorded, streamed
from wayside.plans.inputs import EV, LI, STREAM, event_stream, recordings
from wayside.plans.registry import query, rd
from wayside.session import cut, table

CLASSES = scores.CLASSES


# --- intervals ------------------------------------------------------------------------------------

SHORT_GAP = DAY_US * 3 // 4
INTERVALS = (
    EV
    + "".join(
        f""", {n}s AS (SELECT *, CAST(sum(CASE WHEN dt > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY t, seq) AS BIGINT) AS id
  FROM (SELECT *, t - lag(t) OVER (PARTITION BY stream_id ORDER BY t, seq) AS dt FROM ev)),
{n} AS (SELECT stream_id, id, min(t) AS s, max(t) AS e,
  CASE WHEN arg_max(pos, (t, seq)) > arg_min(pos, (t, seq)) THEN 'Open' ELSE 'Close' END AS label FROM {n}s GROUP BY ALL)"""
        for n, gap in (("tru", DAY_US), ("prd", SHORT_GAP))
    )
    + """, pairs AS (SELECT *, inter / CAST((e1 - s1) + (e2 - s2) - inter AS DOUBLE) AS iou FROM (
  SELECT a.stream_id, a.id AS i, b.id AS j, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2,
    CAST(least(a.e, b.e) - greatest(a.s, b.s) AS DOUBLE) AS inter
  FROM tru a JOIN prd b ON a.stream_id = b.stream_id AND a.label = b.label AND a.s < b.e AND b.s < a.e) WHERE inter > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY iou DESC, i, j) AS r FROM pairs),
greedy AS (
  SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST(0 AS DOUBLE) AS iou,
    CAST([] AS BIGINT[]) AS ti, CAST([] AS BIGINT[]) AS pj, false AS taken FROM pairs
  UNION ALL
  SELECT c.stream_id, c.r, c.i, c.j, c.iou,
    CASE WHEN list_contains(ti, c.i) OR list_contains(pj, c.j) THEN ti ELSE list_append(ti, c.i) END,
    CASE WHEN list_contains(ti, c.i) OR list_contains(pj, c.j) THEN pj ELSE list_append(pj, c.j) END,
    NOT (list_contains(ti, c.i) OR list_contains(pj, c.j))
  FROM greedy g JOIN ranked c ON c.stream_id = g.stream_id AND c.r = g.r + 1)"""
)


def _intervals(spark, sf, gap, ident, probability=None):
    rows, stream = streamed(spark, sf)
    s, order = cut(ordered.gap_segments(rows, stream, gap)), stream.within("stream_id", "segment_id")
    both = cycles.bounds(s, order).join(cycles.directions(s, order), list(order.keys))
    label = F.col("operation").alias("label")
    if probability:  # how far the leaf moved, as a stand-in probability of opening
        label = ((F.col("pos_end") - F.col("pos_start") + 99) / 198).alias(probability)
    return both.select("stream_id", label, F.col("segment_id").alias(ident), F.col("start_us").alias("start"), F.col("end_us").alias("end"))


def _pairs(spark, sf):
    true, pred = _intervals(spark, sf, DAY_US, "i"), _intervals(spark, sf, SHORT_GAP, "j")
    return true, pred, intervals.overlaps(true, pred, ["stream_id", "label"])


@query("iou_candidates", f"WITH {INTERVALS.split(', greedy AS')[0]} SELECT stream_id, label, i, j, {rd('iou')} AS iou FROM pairs JOIN (SELECT stream_id, id AS i, label FROM tru) USING (stream_id, i)")
def iou_candidates(spark, sf):
    """Overlapping true and predicted cycles with the same label."""
    return _pairs(spark, sf)[2].drop("lo", "hi").withColumn("iou", rounded("iou"))


@query("iou_matching", f"WITH RECURSIVE {INTERVALS} SELECT stream_id, i, j, {rd('iou')} AS iou FROM greedy WHERE taken")
def iou_matching(spark, sf):
    pairs = _pairs(spark, sf)[2].drop("label")
    return intervals.greedy_matching(pairs, ["stream_id"]).withColumn("iou", rounded("iou"))


@query(
    "iou_f1",
    f"""WITH RECURSIVE {INTERVALS},
    m AS (SELECT stream_id, count(*) AS n_match, sum(iou) AS total FROM greedy WHERE taken GROUP BY ALL),
    c AS (SELECT stream_id, n_true, n_pred, coalesce(n_match, 0) AS n_match, coalesce(total, 0) / n_true AS sr, coalesce(total, 0) / n_pred AS sp,
        CASE WHEN n_match > 0 THEN total / n_match ELSE 0 END AS mi
      FROM (SELECT stream_id, count(*) AS n_true FROM tru GROUP BY ALL) JOIN (SELECT stream_id, count(*) AS n_pred FROM prd GROUP BY ALL)
        USING (stream_id) LEFT JOIN m USING (stream_id))
    SELECT stream_id, n_true, n_pred, n_match, {rd("sr")} AS soft_recall, {rd("sp")} AS soft_precision, {rd("mi")} AS mean_iou,
      {rd("CASE WHEN sr + sp > 0 THEN 2 * sr * sp / (sr + sp) ELSE 0 END")} AS score FROM c""",
)
def iou_f1(spark, sf):
    true, pred, pairs = _pairs(spark, sf)
    matched = intervals.greedy_matching(pairs.drop("label"), ["stream_id"])
    f = scores.interval_f1(true, pred, matched, ["stream_id"])
    whole = {"stream_id", "n_true", "n_pred", "n_match"}
    return f.select(*[c if c in whole else rounded(c).alias(c) for c in f.columns])


_HEAD, _REST = INTERVALS.split(", pairs AS", 1)
SWEEP = _HEAD + """, pp AS (SELECT stream_id, id, (arg_max(pos, (t, seq)) - arg_min(pos, (t, seq)) + 99) / 198e0 AS p FROM prds GROUP BY ALL),
th AS (SELECT r AS cand, round(2e-1 + r * 25e-3, 4) AS tau FROM range(25) t(r)),
blind AS (SELECT *, inter / CAST((e1 - s1) + (e2 - s2) - inter AS DOUBLE) AS iou FROM (
  SELECT a.stream_id, a.id AS i, b.id AS j, a.label, p, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, CAST(least(a.e, b.e) - greatest(a.s, b.s) AS DOUBLE) AS inter
  FROM tru a JOIN prd b ON a.stream_id = b.stream_id AND a.s < b.e AND b.s < a.e JOIN pp ON pp.stream_id = b.stream_id AND pp.id = b.id) WHERE inter > 0),
pairs AS (SELECT cand * 1000000 + stream_id AS stream_id, cand, i, j, iou FROM blind, th WHERE label = CASE WHEN p >= tau THEN 'Open' ELSE 'Close' END),
ranked AS""" + _REST.split("ranked AS", 1)[1]


@query(
    "interval_threshold_sweep",
    f"""WITH RECURSIVE {SWEEP}, s AS (SELECT stream_id // 1000000 AS cand, sum(iou) AS total FROM greedy WHERE taken GROUP BY ALL),
    c AS (SELECT cand, total / (SELECT count(*) FROM tru) AS sr, total / (SELECT count(*) FROM prd) AS sp FROM s), f AS (SELECT cand, round(2e-1 + cand * 25e-3, 4) AS tau, 2 * sr * sp / (sr + sp) AS score FROM c)
    SELECT CAST(cand AS INTEGER) AS cand, tau, {rd("score")} AS score, {rd("(SELECT median(tau) FROM f WHERE score >= (SELECT max(score) FROM f) - 1e-9)")} AS best FROM f""",
)
def interval_threshold_sweep(spark, sf):
    """IoU-F1 of the predicted cycles when their label comes from a probability and a threshold."""
    true, pred = cut(_intervals(spark, sf, DAY_US, "i")), cut(_intervals(spark, sf, SHORT_GAP, "j", "p"))
    pairs = intervals.overlaps(true.select("stream_id", "i", "start", "end"), pred, ["stream_id"])
    named = pairs.join(true.select("stream_id", "i", "label"), ["stream_id", "i"]).join(pred.select("stream_id", "j", "p"), ["stream_id", "j"])
    s = choose.interval_threshold_sweep(named, ["stream_id"], true, pred, "Open", "Close")
    return s.select("cand", "tau", rounded("score").alias("score"), rounded("best").alias("best"))


# --- class scores ---------------------------------------------------------------------------------

OOF = """oof AS (SELECT doc_id AS unit_id, CASE WHEN toxic = 1 THEN 'Side I' WHEN quality = 0 THEN 'Side II' ELSE 'Normal' END AS label,
  (n_chars % 83) / 83e0 AS p0, (n_chars % 97) / 97e0 AS p1, (n_chars % 89) / 89e0 AS p2, (n_chars % 79) / 79e0 AS q1, (n_chars % 73) / 73e0 AS q2
  FROM labels JOIN documents USING (doc_id))"""


def oof(spark, sf):
    """Labelled units with stand-in probabilities made from the text length."""
    part = lambda m: ((F.col("n_chars") % m) / m)
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("unit_id"),
        F.when(F.col("toxic") == 1, "Side I").when(F.col("quality") == 0, "Side II").otherwise("Normal").alias("label"),
        part(83).alias("p0"), part(97).alias("p1"), part(89).alias("p2"), part(79).alias("q1"), part(73).alias("q2"),
    )


DECIDED = "CASE WHEN NOT ({flag}) THEN 'Normal' WHEN {one} >= {two} THEN 'Side I' ELSE 'Side II' END"
GLOBAL = lambda tau: DECIDED.format(flag=f"greatest(p1, p2) >= {tau}", one="p1", two="p2")
PER_SIDE = lambda a, b: DECIDED.format(flag=f"p1 - {a} >= 0 OR p2 - {b} >= 0", one=f"p1 - {a}", two=f"p2 - {b}")
MARGIN = lambda a, d: DECIDED.format(flag=f"greatest(p1, p2) >= {a} AND abs(p1 - p2) >= {d}", one="p1", two="p2")


def f1_sql(source: str, by: str) -> str:
    """Per-class and macro F1 of relation ``source`` (label, pred) grouped by ``by`` columns."""
    g = f"{by}, " if by else ""
    counts = ", ".join(
        f"count(*) FILTER (label = '{c}' AND pred = '{c}') AS tp{i}, count(*) FILTER (label <> '{c}' AND pred = '{c}') AS fp{i}, "
        f"count(*) FILTER (label = '{c}' AND pred <> '{c}') AS fn{i}" for i, c in enumerate(CLASSES))
    f1 = [f"CASE WHEN tp{i} > 0 THEN 2e0 * tp{i} / (2 * tp{i} + fp{i} + fn{i}) ELSE 0e0 END" for i in range(3)]
    return (f"SELECT {g}{', '.join(f'{e} AS f1_{i}' for i, e in enumerate(f1))}, (({f1[0]}) + ({f1[1]}) + ({f1[2]})) / 3 AS macro_f1 "
            f"FROM (SELECT {g}{counts} FROM {source} GROUP BY {by or '()'}) ")


F1_OUT = ", ".join(f"{rd(c)} AS {c}" for c in ("f1_0", "f1_1", "f1_2", "macro_f1"))


def _f1_out(df, *keys):
    return df.select(*keys, *[rounded(c).alias(c) for c in ("f1_0", "f1_1", "f1_2", "macro_f1")])


@query("macro_f1", f"WITH {OOF}, d AS (SELECT label, {GLOBAL('5e-1')} AS pred FROM oof), s AS ({f1_sql('d', '')}) SELECT {F1_OUT} FROM s")
def macro_f1(spark, sf):
    d = oof(spark, sf).withColumn("pred", decide("p1", "p2", "global", 0.5))
    return _f1_out(scores.macro_f1(d, []))


@query(
    "confusion",
    f"""WITH {OOF}, d AS (SELECT label, {GLOBAL('5e-1')} AS pred FROM oof)
    SELECT label, """ + ", ".join(f"count(*) FILTER (pred = '{c}') AS \"{c}\"" for c in CLASSES) + " FROM d GROUP BY label",
)
def confusion(spark, sf):
    return scores.confusion(oof(spark, sf).withColumn("pred", decide("p1", "p2", "global", 0.5)))


@query(
    "mape_score",
    f"""WITH {LI}, m AS (SELECT rec, avg(abs(x - q * 18) / abs(x)) AS mape FROM li GROUP BY rec)
    SELECT rec, {rd("mape")} AS mape, {rd("greatest(0, 1 - mape)")} AS score FROM m""",
)
def mape_score(spark, sf):
    r = recordings(spark, sf).withColumn("pred", F.col("q") * 18)
    m = scores.mape_score(r, ["rec"], "x", "pred")
    return m.select("rec", rounded("mape").alias("mape"), rounded("score").alias("score"))


@query(
    "ape_summary",
    f"""WITH {LI}, a AS (SELECT rec, abs(x - q * 18) / abs(x) AS ape FROM li)
    SELECT rec, {rd("median(ape)")} AS p50, {rd("quantile_cont(ape, 9e-1)")} AS p90, {rd("max(ape)")} AS worst FROM a GROUP BY rec""",
)
def ape_summary(spark, sf):
    r = recordings(spark, sf).withColumn("pred", F.col("q") * 18)
    m = scores.ape_summary(r, ["rec"], "x", "pred")
    return m.select("rec", *[rounded(c).alias(c) for c in ("p50", "p90", "worst")])


@query(
    "score_margin",
    f"""WITH {OOF}, d AS (SELECT label <> 'Normal' AS pos, greatest(p1, p2) AS p FROM oof)
    SELECT count(*) FILTER (p >= 5e-1 AND pos) AS tp, count(*) FILTER (p >= 5e-1 AND NOT pos) AS fp, count(*) FILTER (p < 5e-1 AND pos) AS fn,
      {rd("max(p) FILTER (NOT pos)")} AS normal_max, {rd("min(p) FILTER (pos)")} AS abnormal_min FROM d""",
)
def score_margin(spark, sf):
    d = oof(spark, sf).withColumn("p", F.greatest("p1", "p2"))
    m = scores.margins(d, [], F.col("label") != "Normal", "p", 0.5)
    return m.select("tp", "fp", "fn", rounded("normal_max").alias("normal_max"), rounded("abnormal_min").alias("abnormal_min"))


@query(
    "overall_score",
    f"""WITH s AS (SELECT o_custkey, o_orderstatus, avg(o_totalprice) / 499999 AS score FROM orders GROUP BY ALL)
    SELECT o_custkey, {rd("sum(score) / 4")} AS overall, {rd("avg(score)")} AS average, count(*) AS attempted FROM s GROUP BY ALL""",
)
def overall_score(spark, sf):
    """Three order states play the systems a team attempted, customers the teams."""
    s = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg((F.avg("o_totalprice") / 499999).alias("score"))
    o = scores.overall(s, ["o_custkey"], "score")
    return o.select("o_custkey", rounded("overall").alias("overall"), rounded("average").alias("average"), "attempted")


CANDIDATES = {"c_low": "(p1, p2) at 0.4", "c_mid": "0.5", "c_high": "0.6", "c_margin": "margin", "c_copy": "0.5"}
CAND_SQL = (f"cand AS (SELECT *, {GLOBAL('4e-1')} AS c_low, {GLOBAL('5e-1')} AS c_mid, {GLOBAL('6e-1')} AS c_high, "
            f"{MARGIN('5e-1', '1e-1')} AS c_margin, {GLOBAL('5e-1')} AS c_copy FROM oof)")


def _candidates(spark, sf):
    u = oof(spark, sf)
    for name, tau in (("c_low", 0.4), ("c_mid", 0.5), ("c_high", 0.6), ("c_copy", 0.5)):
        u = u.withColumn(name, decide("p1", "p2", "global", tau))
    return u.withColumn("c_margin", decide("p1", "p2", "margin", 0.5, delta=0.1))


@query(
    "complementarity",
    f"""WITH {OOF}, {CAND_SQL} SELECT label, count(*) FILTER (c_low = label AND c_high = label) AS both_right,
      count(*) FILTER (c_low <> label AND c_high = label) AS only_b, count(*) FILTER (c_low = label AND c_high <> label) AS only_a,
      count(*) FILTER (c_low <> label AND c_high <> label) AS both_wrong FROM cand GROUP BY label""",
)
def complementarity(spark, sf):
    return scores.complementarity(_candidates(spark, sf), "label", "c_low", "c_high")


@query(
    "vector_duplicates",
    f"WITH {OOF}, {CAND_SQL} SELECT *, n_diff = 0 AS identical FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} <> {b}) AS n_diff FROM cand"
        for i, a in enumerate(CANDIDATES) for b in list(CANDIDATES)[i + 1:])
    + ")",
)
def vector_duplicates(spark, sf):
    return scores.vector_differences(_candidates(spark, sf), list(CANDIDATES))


# --- decisions ------------------------------------------------------------------------------------


def _peak(i: int, m: int):
    """Largest magnitude among every m-th value of a vector, from the i-th (0-based) on."""
    return F.array_max(F.transform(F.filter("embedding", lambda x, k: k % m == i), lambda x: F.abs(x.cast("double"))))


def _peak_sql(i: int, m: int) -> str:
    part = f"embedding[{i + 1}:len(embedding):{m}]"
    return f"CAST(greatest(list_max({part}), -list_min({part})) AS DOUBLE)"


@query(
    "decision_rules",
    f"""WITH v AS (SELECT vec_id, {_peak_sql(0, 2)} * 2 AS p1, {_peak_sql(1, 2)} * 2 AS p2 FROM embeddings)
    SELECT vec_id, {GLOBAL('5e-1')} AS by_global, {PER_SIDE('4e-1', '5e-1')} AS by_side, {MARGIN('4e-1', '2e-1')} AS by_margin FROM v""",
)
def decision_rules(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", (_peak(0, 2) * 2).alias("p1"), (_peak(1, 2) * 2).alias("p2"))
    return v.select(
        "vec_id", decide("p1", "p2", "global", 0.5).alias("by_global"),
        decide("p1", "p2", "per_side", 0.4, 0.5).alias("by_side"), decide("p1", "p2", "margin", 0.4, delta=0.2).alias("by_margin"))


def _grid_sql() -> str:
    tau = "round(5e-2 + {i} * 25e-3, 4)"
    return (
        f"g AS (SELECT 'global' AS rule, r AS cand, {tau.format(i='r')} AS a, 0e0 AS b FROM range(35) t(r) "
        f"UNION ALL SELECT 'per_side', r, {tau.format(i='(r // 35)')}, {tau.format(i='(r % 35)')} FROM range(1225) t(r) "
        f"UNION ALL SELECT 'margin', r, {tau.format(i='(r // 7)')}, round((r % 7) * 5e-2, 4) FROM range(245) t(r))")


@query(
    "threshold_sweep",
    f"""WITH {OOF}, {_grid_sql()}, tried AS (SELECT rule, cand, a, b, label,
      CASE rule WHEN 'global' THEN {GLOBAL('a')} WHEN 'per_side' THEN {PER_SIDE('a', 'b')} ELSE {MARGIN('a', 'b')} END AS pred FROM oof, g),
    sc AS ({f1_sql('tried', 'rule, cand, a, b')}),
    tied AS (SELECT *, macro_f1 >= max(macro_f1) OVER (PARTITION BY rule) - 1e-12 AS t FROM sc),
    rk AS (SELECT *, row_number() OVER (PARTITION BY rule, t ORDER BY cand) AS k, count(*) OVER (PARTITION BY rule, t) AS c FROM tied)
    SELECT rule, CAST(cand AS INTEGER) AS cand, a, b, {rd("macro_f1")} AS macro_f1, t AND k = (c - 1) // 2 + 1 AS selected FROM rk""",
)
def threshold_sweep(spark, sf):
    u = oof(spark, sf)
    parts = [choose.sweep(u, rule) for rule in ("global", "per_side", "margin")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.select("rule", "cand", "a", "b", rounded("macro_f1").alias("macro_f1"), "selected")


@query(
    "class_scaling",
    f"""WITH {OOF}, g AS (SELECT CAST(0 AS BIGINT) AS cand, 1e0 AS a, 1e0 AS b UNION ALL SELECT r + 1, 5e-1 + (r // 15) * 25e-2, 5e-1 + (r % 15) * 25e-2 FROM range(225) t(r)),
    tried AS (SELECT cand, a, b, label, CASE WHEN p0 >= p1 * a AND p0 >= p2 * b THEN 'Normal' WHEN p1 * a >= p2 * b THEN 'Side I' ELSE 'Side II' END AS pred FROM oof, g),
    sc AS ({f1_sql('tried', 'cand, a, b')})
    SELECT CAST(cand AS INTEGER) AS cand, a, b, {rd("macro_f1")} AS macro_f1, row_number() OVER (ORDER BY round(macro_f1, 12) DESC, cand) = 1 AS selected FROM sc""",
)
def class_scaling(spark, sf):
    s = choose.class_scaling(oof(spark, sf))
    return s.select("cand", "a", "b", rounded("macro_f1").alias("macro_f1"), "selected")


BLEND = f"""w AS (SELECT unnest([25e-2, 5e-1, 75e-2]) AS w), mix AS (SELECT w, label, w * p1 + (1 - w) * q1 AS p1, w * p2 + (1 - w) * q2 AS p2 FROM {{src}}, w),
    g AS (SELECT r AS cand, round(5e-2 + r * 25e-3, 4) AS a FROM range(35) t(r)),
    tried AS (SELECT w, cand, a, label, {GLOBAL('a')} AS pred FROM mix, g), sc AS ({f1_sql('tried', 'w, cand, a')}),
    tied AS (SELECT *, macro_f1 >= max(macro_f1) OVER (PARTITION BY w) - 1e-12 AS t FROM sc),
    rk AS (SELECT *, row_number() OVER (PARTITION BY w, t ORDER BY cand) AS k, count(*) OVER (PARTITION BY w, t) AS c FROM tied),
    best AS (SELECT w, a AS tau, macro_f1 FROM rk WHERE t AND k = (c - 1) // 2 + 1),
    chosen AS (SELECT *, row_number() OVER (ORDER BY round(macro_f1, 12) DESC, w) = 1 AS chosen FROM best)"""


FOLDED = "fo AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(unit_id || '-7'), unit_id) - 1) % 5 AS fold FROM oof)"


@query(
    "median_selection",
    f"""WITH {OOF}, {FOLDED}, g AS (SELECT r AS cand, round(5e-2 + r * 25e-3, 4) AS a FROM range(35) t(r)),
    tried AS (SELECT k.fold, cand, a, label, {GLOBAL('a')} AS pred FROM fo, g, (SELECT DISTINCT fold FROM fo) k WHERE fo.fold <> k.fold), sc AS ({f1_sql('tried', 'fold, cand, a')}),
    tied AS (SELECT *, macro_f1 >= max(macro_f1) OVER (PARTITION BY fold) - 1e-12 AS t FROM sc),
    rk AS (SELECT *, row_number() OVER (PARTITION BY fold, t ORDER BY cand) AS k, count(*) OVER (PARTITION BY fold, t) AS c FROM tied),
    ch AS (SELECT fold, a AS tau, macro_f1 FROM rk WHERE t AND k = (c - 1) // 2 + 1) SELECT fold, tau, {rd('macro_f1')} AS macro_f1, {rd('median(tau) OVER ()')} AS final_tau FROM ch""",
)
def median_selection(spark, sf):
    """Threshold chosen outside each of five folds, and the median of the five as the final parameter."""
    u = oof(spark, sf)
    placed = u.join(folds.stratified(u.select("unit_id", "label"), "unit_id", "label", 5, 7).drop("label"), "unit_id")
    m = choose.leave_fold_out_thresholds(placed, "fold")
    return m.select("fold", "tau", rounded("macro_f1").alias("macro_f1"), rounded("final_tau").alias("final_tau"))


@query("blend_sweep", f"WITH {OOF}, {BLEND.format(src='oof')} SELECT w, tau, {rd('macro_f1')} AS macro_f1, chosen FROM chosen")
def blend_sweep(spark, sf):
    return choose.blend_sweep(oof(spark, sf)).select("w", "tau", rounded("macro_f1").alias("macro_f1"), "chosen")


PAIRED = """r AS (SELECT vec_id, """ + ", ".join(
    f"least(1, {_peak_sql(i, 5)} * 2) AS {n}" for i, n in enumerate(("own1", "other1", "own2", "other2", "det"))
) + " FROM embeddings)"


@query(
    "paired_probability",
    f"""WITH {PAIRED} SELECT vec_id, {rd("(own1 + other2) / 2")} AS multi_1, {rd("(own2 + other1) / 2")} AS multi_2,
      {rd("det * (own1 + (1 - own2)) / 2")} AS hier_1, {rd("det * (own2 + (1 - own1)) / 2")} AS hier_2 FROM r""",
)
def paired_probability(spark, sf):
    p = lambda i: F.least(F.lit(1.0), _peak(i, 5) * 2)
    views = F.inline(F.array(*[
        F.struct(F.lit(s).alias("side"), p(o).alias("own"), p(o + 1).alias("other"), p(4).alias("detector")) for s, o in ((1, 0), (2, 2))]))
    rows = table(spark, sf, "embeddings").select("vec_id", views)
    multi = choose.paired_probability(rows, "vec_id", "multiclass")
    hier = choose.paired_probability(rows, "vec_id", "hierarchical").select("vec_id", F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    return multi.join(hier, "vec_id").select(
        "vec_id", rounded("p1").alias("multi_1"), rounded("p2").alias("multi_2"), rounded("h1").alias("hier_1"), rounded("h2").alias("hier_2"))


WINDOWS = "win AS (SELECT *, i // greatest(n // 5, 1) AS w FROM li WHERE i // greatest(n // 5, 1) < 5)"


def _windows(spark, sf, k=5):
    """Rows of the k equal consecutive windows of each recording. What is left after k windows, k - 1 rows at most, is in no
    window; a recording of fewer than k rows has one window per row."""
    placed = ordered.positions(*recorded(spark, sf), "i", "n")
    return placed.withColumn("w", F.floor(F.col("i") / F.greatest(F.floor(F.col("n") / k), F.lit(1))).cast("long")).where(F.col("w") < k)


@query("window_slices", f"WITH {LI}, {WINDOWS} SELECT rec, w, count(*) AS n_rows, min(i) AS first_row, {rd('avg(x)')} AS mean_x FROM win GROUP BY ALL")
def window_slices(spark, sf):
    return _windows(spark, sf).groupBy("rec", "w").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("i").alias("first_row"), rounded(F.avg("x")).alias("mean_x"))


@query("window_average", f"WITH {LI}, {WINDOWS}, p AS (SELECT rec, w, avg(x) / 1100 AS p FROM win GROUP BY ALL) SELECT rec, {rd('avg(p)')} AS p FROM p GROUP BY rec")
def window_average(spark, sf):
    """Mean of the per-window probabilities of a recording."""
    per = _windows(spark, sf).groupBy("rec", "w").agg((F.avg("x") / 1100).alias("p"))
    return per.groupBy("rec").agg(rounded(F.avg("p")).alias("p"))


# --- folds ----------------------------------------------------------------------------------------

SPLIT = "CASE WHEN {p} < ({n} % {k}) * ({n} // {k} + 1) THEN {p} // ({n} // {k} + 1) ELSE ({n} % {k}) + ({p} - ({n} % {k}) * ({n} // {k} + 1)) // ({n} // {k}) END"
RANKED = "rk AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)"


@query(
    "block_folds",
    f"""WITH {RANKED} SELECT o_orderkey, pos * 5 // n AS proportional,
      {SPLIT.format(p="((pos - 7 + n) % n)", n="n", k=5)} AS rotated FROM rk""",
)
def block_folds(spark, sf):
    """Contiguous blocks of the orders, by proportion and by even split after rotating the order by 7."""
    r = folds.ranked(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    pos, n = F.col("pos"), F.col("n")
    return r.select("o_orderkey", folds.proportional(pos, n, 5).alias("proportional"), folds.split_even(folds.rotated(pos, n, 7), n, 5).alias("rotated"))


NESTED = f"""rk AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer),
    rep AS (SELECT * FROM (VALUES (0, 0), (1, 11)) t(repeat, off)),
    outer_f AS (SELECT c_custkey, pos, n, repeat, fold, {SPLIT.format(p="((pos - off + n) % n)", n="n", k=5)} = fold AS held FROM rk, rep, range(5) t(fold)),
    inn AS (SELECT *, row_number() OVER (PARTITION BY repeat, fold, held ORDER BY pos) - 1 AS ip, count(*) OVER (PARTITION BY repeat, fold, held) AS m FROM outer_f)"""


@query(
    "nested_blocks",
    f"""WITH {NESTED} SELECT c_custkey, repeat, CAST(fold AS INTEGER) AS fold, held,
      CASE WHEN NOT held THEN {SPLIT.format(p="ip", n="m", k=3)} END AS inner_block FROM inn""",
)
def nested_blocks(spark, sf):
    r = folds.ranked(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return folds.nested_blocks(r, 5, 3, (0, 11))


@query(
    "stratified_folds",
    f"""WITH {OOF} SELECT unit_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5(unit_id || '-7'), unit_id) - 1) % 5 AS fold FROM oof""",
)
def stratified_folds(spark, sf):
    return folds.stratified(oof(spark, sf).select("unit_id", "label"), "unit_id", "label", 5, 7)


@query(
    "group_folds",
    f"""WITH rk AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
    f AS (SELECT *, {SPLIT.format(p="pos", n="n", k=3)} AS fold FROM rk)
    SELECT doc_id, fold, arg_min(fold, doc_id) OVER (PARTITION BY text) AS family_fold FROM f""",
)
def group_folds(spark, sf):
    """Three contiguous folds of the documents; exact copies follow their first member."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("family"))
    r = folds.ranked(d, "doc_id")
    units = r.withColumn("fold", folds.split_even(F.col("pos"), F.col("n"), 3))
    return folds.family_folds(units, "family", "doc_id", "fold").select("doc_id", "fold", "family_fold")


@query(
    "condition_folds",
    f"""WITH v AS (SELECT vec_id, vec_id // 4 AS family, ({_peak_sql(0, 1)} - 2e-1) * 80 AS speed FROM embeddings),
    m AS (SELECT family, median(speed) AS s FROM v GROUP BY ALL)
    SELECT vec_id, family, CAST(greatest(2, CASE WHEN s < 3 THEN 0 WHEN s < 6 THEN 1 WHEN s < 9 THEN 2 WHEN s < 12 THEN 3 WHEN s < 15 THEN 4 ELSE 5 END) AS INTEGER) AS fold
    FROM v JOIN m USING (family)""",
)
def condition_folds(spark, sf):
    u = table(spark, sf, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 4).alias("family"), ((_peak(0, 1) - 0.2) * 80).alias("speed"))
    return folds.condition_folds(u, "family", "speed").select("vec_id", "family", "fold")


@query(
    "loco",
    f"""WITH {EV}, c AS (SELECT DISTINCT stream_id AS held FROM ev)
    SELECT held, count(DISTINCT stream_id) AS train_cases, count(*) AS train_rows, {rd("avg(current)", 5)} AS train_mean FROM c JOIN ev ON stream_id <> held GROUP BY held""",
)
def loco(spark, sf):
    """What each leave-one-case-out fold trains on: cases, rows and mean of all the other streams."""
    m = folds.others_mean(event_stream(spark, sf), "stream_id", "current")
    return m.withColumn("train_mean", rounded("train_mean", 5))


@query(
    "fold_audit",
    f"""WITH {NESTED}, f AS (SELECT i.*, c_nationkey AS family FROM inn i JOIN customer USING (c_custkey)),
    a AS (SELECT 'held_out_once' AS rule, repeat, CAST(NULL AS INTEGER) AS fold, CAST(c_custkey AS VARCHAR) AS key, count(*) FILTER (held) AS n FROM f GROUP BY ALL HAVING count(*) FILTER (held) <> 1),
    b AS (SELECT 'family_crosses' AS rule, repeat, CAST(fold AS INTEGER) AS fold, CAST(family AS VARCHAR) AS key, count(*) FILTER (held) AS n FROM f
      GROUP BY ALL HAVING count(*) FILTER (held) > 0 AND count(*) FILTER (NOT held) > 0)
    SELECT * FROM a UNION ALL SELECT * FROM b""",
)
def fold_audit(spark, sf):
    """Nations play the duplicate families; contiguous blocks split them, so the audit lists every crossing."""
    r = folds.ranked(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("family")), "c_custkey")
    return folds.audit(folds.nested_blocks(r, 5, 3, (0, 11)), "c_custkey", "family", F.col("held"))


@query(
    "truth_fold",
    f"""WITH {INTERVALS.split(', pairs AS')[0]}, b AS (SELECT stream_id, s, (row_number() OVER (PARTITION BY stream_id ORDER BY s) - 1) * 3 // count(*) OVER (PARTITION BY stream_id) AS block FROM prd),
    e AS (SELECT stream_id, block, min(s) AS edge FROM b WHERE block > 0 GROUP BY ALL)
    SELECT tru.stream_id, id AS i, (SELECT count(*) FROM e WHERE e.stream_id = tru.stream_id AND e.edge <= tru.s) AS fold FROM tru""",
)
def truth_fold(spark, sf):
    """True cycles assigned to the blocks of the predicted ones by their start time."""
    pred = _intervals(spark, sf, SHORT_GAP, "j").withColumn("t", F.col("start"))
    placed = ordered.positions(pred, ordered.Order(("stream_id",), "t", ("j",)), "pos", "n")
    blocks = placed.withColumn("block", folds.proportional(F.col("pos"), F.col("n"), 3))
    true = _intervals(spark, sf, DAY_US, "i").select("stream_id", "i", "start")
    return folds.truth_folds(true, blocks, ["stream_id"], "start", 3).select("stream_id", "i", "fold")


@query(
    "balanced_weights",
    f"""WITH {OOF}, c AS (SELECT label, count(*) AS class_n FROM oof GROUP BY ALL)
    SELECT label, class_n, {rd("(SELECT count(*) FROM oof) / (CAST((SELECT count(*) FROM c) AS DOUBLE) * class_n)")} AS weight FROM c""",
)
def balanced_weights(spark, sf):
    w = folds.balanced_weights(oof(spark, sf), "label")
    return w.withColumn("weight", rounded("weight"))


# --- acceptance and calibration -------------------------------------------------------------------

REPEATS = """rep AS (SELECT r AS repeat, unit_id, label, (n_chars * (r + 1) % 97) / 97e0 AS p1, (n_chars * (r + 1) % 89) / 89e0 AS p2,
  (n_chars * (r + 1) % 79) / 79e0 AS q1, (n_chars * (r + 1) % 73) / 73e0 AS q2
  FROM (SELECT unit_id, label, n_chars FROM oof JOIN documents ON doc_id = unit_id), range(3) t(r))"""
GATE_CANDS = f"""cands AS (SELECT 'incumbent' AS candidate, repeat, label, {GLOBAL('6e-1')} AS pred FROM rep
  UNION ALL SELECT 'strict', repeat, label, {GLOBAL('8e-1')} FROM rep
  UNION ALL SELECT 'margin', repeat, label, {MARGIN('6e-1', '2e-1')} FROM rep
  UNION ALL SELECT 'blend', repeat, label, {GLOBAL('8e-1')} FROM (SELECT repeat, label, 75e-2 * p1 + 25e-2 * q1 AS p1, 75e-2 * p2 + 25e-2 * q2 AS p2 FROM rep))"""


@query(
    "gates",
    f"""WITH {OOF}, {REPEATS}, {GATE_CANDS}, sc AS ({f1_sql('cands', 'candidate, repeat')}),
    b AS (SELECT repeat, macro_f1 AS bm, f1_1 AS b1, f1_2 AS b2 FROM sc WHERE candidate = 'incumbent'),
    a AS (SELECT candidate, avg(macro_f1) AS mean, avg(macro_f1) - avg(bm) > greatest(1e-2, stddev_pop(bm)) AS gain, bool_and(macro_f1 >= bm - 1e-12) AS consistent,
      avg(f1_1) >= avg(b1) - 3e-2 AND avg(f1_2) >= avg(b2) - 3e-2 AS fault_classes FROM sc JOIN b USING (repeat) GROUP BY ALL),
    p AS (SELECT *, CASE WHEN candidate = 'blend' THEN mean > (SELECT max(mean) FROM a WHERE candidate IN ('incumbent', 'strict')) + 5e-3 END AS beats_parts FROM a)
    SELECT candidate, {rd("mean")} AS mean, gain, consistent, fault_classes, beats_parts, gain AND consistent AND fault_classes AND coalesce(beats_parts, true) AS qualified FROM p""",
)
def gates(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), "n_chars")
    r = F.col("repeat")
    part = lambda m: ((F.col("n_chars") * (r + 1)) % m) / m
    rep = (
        oof(spark, sf).select("unit_id", "label").join(docs, "unit_id")
        .select("label", "n_chars", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("repeat"))
        .select("repeat", "label", part(97).alias("p1"), part(89).alias("p2"), part(79).alias("q1"), part(73).alias("q2"))
    )
    mix = lambda a, b: 0.75 * F.col(a) + 0.25 * F.col(b)
    tried = F.inline(F.array(*[F.struct(F.lit(n).alias("candidate"), p.alias("pred")) for n, p in {
        "incumbent": decide("p1", "p2", "global", 0.6), "strict": decide("p1", "p2", "global", 0.8),
        "margin": decide("p1", "p2", "margin", 0.6, delta=0.2), "blend": decide(mix("p1", "q1"), mix("p2", "q2"), "global", 0.8),
    }.items()]))
    per = cut(scores.macro_f1(rep.select("repeat", "label", tried), ["candidate", "repeat"]))  # one row per candidate and repeat
    g = scores.gates(per, "incumbent", ["incumbent", "strict"], "blend", 0.01, 0.03, 0.005)
    return g.withColumn("mean", rounded("mean"))


@query(
    "full_calibration",
    f"""WITH {OOF}, {BLEND.format(src='oof')}, rk2 AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
    f AS (SELECT doc_id, arg_min({SPLIT.format(p="pos", n="n", k=3)}, doc_id) OVER (PARTITION BY text) AS fold FROM rk2),
    d AS (SELECT fold, label, w, tau, {GLOBAL('tau')} AS pred FROM (SELECT fold, label, chosen.w, tau, chosen.w * p1 + (1 - chosen.w) * q1 AS p1, chosen.w * p2 + (1 - chosen.w) * q2 AS p2
      FROM oof JOIN f ON doc_id = unit_id JOIN chosen ON chosen.chosen)),
    s AS ({f1_sql('d', 'fold, w, tau')}) SELECT fold, w, tau, {rd("macro_f1")} AS macro_f1 FROM s""",
)
def full_calibration(spark, sf):
    """Three family-safe folds over all units and one decision (weight, threshold) chosen on all out-of-fold rows."""
    u = oof(spark, sf)
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("family"))
    r = folds.ranked(d, "doc_id").withColumn("fold", folds.split_even(F.col("pos"), F.col("n"), 3))
    safe = folds.family_folds(r, "family", "doc_id", "fold").select(F.col("doc_id").alias("unit_id"), F.col("family_fold").alias("fold"))
    chosen = cut(choose.blend_sweep(u).where("chosen").select("w", "tau"))  # one row
    joined = u.join(safe, "unit_id").select(
        "*", chosen.select("w").scalar().alias("w"), chosen.select("tau").scalar().alias("tau"))
    mix = lambda a, b: F.col("w") * F.col(a) + (1 - F.col("w")) * F.col(b)
    pred = decide(mix("p1", "q1"), mix("p2", "q2"), "global", F.col("tau"))
    s = scores.macro_f1(joined.withColumn("pred", pred), ["fold", "w", "tau"])
    return s.select("fold", "w", "tau", rounded("macro_f1").alias("macro_f1"))
