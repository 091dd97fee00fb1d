"""Queries on files, results and their history."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayside.functions.columns import micros, rounded
from wayside.operators import contracts, cycles, history, peers
from wayside.operators.ordered import positions
from wayside.plans.catalog_stream import DIRECTION, ELECTRICAL, KEYS, PHASE, PROFILE, recorded, segmented, segments, streamed
from wayside.plans.inputs import EV, LI, SEG, event_stream
from wayside.plans.registry import query, rd
from wayside.session import cut, table

VERDICT = {"click": "Normal", "view": "Abnormal resistance", "signup": "Unknown", "purchase": "Normal"}
RESULTS = f"""res AS (SELECT stream_id, segment_id, min(t) AS start_us, max(t) AS end_us,
  CASE arg_min(mode, (t, seq)) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in VERDICT.items())} END AS prediction FROM seg GROUP BY ALL)"""


def results(spark, sf):
    """Cycles with a verdict taken from the first event type: some missing, some not allowed."""
    verdict = F.create_map(*[F.lit(x) for pair in VERDICT.items() for x in pair])
    return segments(spark, sf)[0].groupBy(*KEYS).agg(
        F.min("t").alias("start_us"), F.max("t").alias("end_us"),
        verdict[F.min_by("mode", F.struct("t", "seq"))].alias("prediction"))


@query(
    "contract_violations",
    f"""WITH {SEG}, {RESULTS} SELECT stream_id, segment_id, 'missing' AS rule FROM res WHERE prediction IS NULL
    UNION ALL SELECT stream_id, segment_id, 'label' FROM res WHERE prediction NOT IN ('Normal', 'Abnormal resistance')
    UNION ALL SELECT stream_id, segment_id, 'order' FROM res WHERE end_us <= start_us""",
)
def contract_violations(spark, sf):
    return contracts.violations(results(spark, sf), KEYS, contracts.door_rules())


NAME = "c_mktsegment || CAST(c_custkey % 40 AS VARCHAR) || CASE c_custkey % 7 WHEN 0 THEN '.CSV' WHEN 1 THEN '/x.csv' ELSE '.csv' END"
FILES = f"files AS (SELECT c_nationkey AS batch, CASE WHEN c_custkey % 11 = 0 THEN '=' ELSE '' END || {NAME} AS name, CAST(greatest(0, floor(c_acctbal * 1000)) AS BIGINT) AS bytes FROM customer)"


@query(
    "manifest_violations",
    f"""WITH {FILES} SELECT batch, 'unsafe' AS rule, name FROM files WHERE name LIKE '%/%' UNION ALL SELECT batch, 'formula', name FROM files WHERE name LIKE '=%'
    UNION ALL SELECT batch, 'extension', name FROM files WHERE NOT ends_with(name, '.csv') UNION ALL SELECT batch, 'empty', name FROM files WHERE bytes <= 0
    UNION ALL SELECT batch, 'same_name', lower(name) FROM files GROUP BY batch, lower(name) HAVING count(*) > 1
    UNION ALL SELECT batch, 'count', NULL FROM files GROUP BY batch HAVING count(*) > 100 UNION ALL SELECT batch, 'size', NULL FROM files GROUP BY batch HAVING sum(bytes) > 120 * 1024 * 1024""",
)
def manifest_violations(spark, sf):
    """Customers as uploaded files, nations as upload batches."""
    k = F.col("c_custkey")
    ending = F.when(k % 7 == 0, ".CSV").when(k % 7 == 1, "/x.csv").otherwise(".csv")
    files = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("batch"),
        F.concat(F.when(k % 11 == 0, "=").otherwise(""), "c_mktsegment", (k % 40).cast("string"), ending).alias("name"),
        F.greatest(F.lit(0), F.floor(F.col("c_acctbal") * 1000)).cast("long").alias("bytes"))
    return contracts.manifest_violations(files, "batch", ".csv")


@query(
    "id_reconcile",
    """WITH g AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY ALL), f AS (SELECT coalesce(c_custkey, g.id) AS id, c_custkey, n FROM customer FULL JOIN g ON g.id = c_custkey)
    SELECT id, CASE WHEN n IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM f WHERE n IS NULL OR c_custkey IS NULL OR n > 1""",
)
def id_reconcile(spark, sf):
    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    got = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return contracts.reconcile(expected, got, "id")


@query(
    "duplicate_families",
    """WITH f AS (SELECT text, min(doc_id) AS family, count(*) AS members FROM documents GROUP BY text)
    SELECT doc_id, sha256(text) AS digest, family, members FROM documents JOIN f USING (text)""",
)
def duplicate_families(spark, sf):
    return contracts.duplicate_families(table(spark, sf, "documents"), "doc_id", F.col("text"))


SYSTEM = {"1-URGENT": "door", "2-HIGH": "acv", "3-MEDIUM": "rail", "4-NOT SPECIFIED": "shm", "5-LOW": "shm"}
_SYS = "CASE o_orderpriority " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SYSTEM.items()) + " END"
RUNS = f"""runs AS (SELECT o_orderkey AS run_id, {_SYS} AS system, epoch_us(o_orderdate) AS created, o_orderkey AS seq, o_orderstatus AS model, o_totalprice > 450000 AS preview,
  'File' || CAST(o_custkey % 500 AS VARCHAR) || '.csv' AS file_id, o_totalprice AS damage, o_orderstatus AS prediction, CASE WHEN o_orderpriority = '2-HIGH' THEN [o_orderkey - 1, o_orderkey - 2] END AS combined_from FROM orders)"""


def runs(spark, sf):
    """Orders as runs: priority is the system, order date the time, status the model, the customer names the file."""
    system = F.create_map(*[F.lit(x) for pair in SYSTEM.items() for x in pair])
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("run_id"), system[F.col("o_orderpriority")].alias("system"), micros("o_orderdate").alias("created"), key.alias("seq"),
        F.col("o_orderstatus").alias("model"), (F.col("o_totalprice") > 450000).alias("preview"),
        F.concat(F.lit("File"), (F.col("o_custkey") % 500).cast("string"), F.lit(".csv")).alias("file_id"),
        F.col("o_totalprice").alias("damage"), F.col("o_orderstatus").alias("prediction"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.array(key - 1, key - 2)).alias("combined_from"))


@query(
    "latest_results",
    f"""WITH {RUNS}, l AS (SELECT * FROM runs WHERE NOT preview), o AS (SELECT *, row_number() OVER (PARTITION BY system, file_id ORDER BY created DESC, seq DESC) AS r FROM l WHERE system <> 'door'),
    d AS (SELECT arg_max(run_id, (created, seq)) AS run FROM l WHERE system = 'door')
    SELECT system, file_id, run_id, created, model, damage FROM o WHERE r = 1 UNION ALL SELECT system, file_id, run_id, created, model, damage FROM l, d WHERE system = 'door' AND run_id = run""",
)
def latest_results(spark, sf):
    return history.latest(runs(spark, sf).drop("combined_from")).select("system", "file_id", "run_id", "created", "model", "damage")


CUTOFF_US = 883_612_800_000_000  # 1998-01-01


@query(
    "run_history_filter",
    f"""WITH {RUNS}, m AS (SELECT DISTINCT unnest(combined_from) AS id FROM runs)
    SELECT run_id, system, created FROM runs WHERE NOT preview AND system = 'shm' AND created >= {CUTOFF_US} AND run_id NOT IN (SELECT id FROM m WHERE id IS NOT NULL)""",
)
def run_history_filter(spark, sf):
    return history.visible(runs(spark, sf), "shm", F.lit(CUTOFF_US)).select("run_id", "system", "created")


@query(
    "merge_guards",
    f"""WITH {RUNS}, r AS (SELECT runs.*, o_custkey AS grp FROM runs JOIN orders ON o_orderkey = run_id), f AS (SELECT grp, file_id || '/' || run_id % 3 AS fid, r.* EXCLUDE (grp) FROM r),
    w AS (SELECT grp, bool_or(system = 'door') AS door, min(system) <> max(system) AS mixed, min(model) <> max(model) AS models, bool_or(preview) AS preview FROM f GROUP BY ALL),
    d AS (SELECT DISTINCT grp FROM f GROUP BY grp, fid HAVING count(*) > 1)
    SELECT grp, 'door' AS rule FROM w WHERE door UNION ALL SELECT grp, 'mixed_systems' FROM w WHERE mixed UNION ALL SELECT grp, 'several_models' FROM w WHERE models
    UNION ALL SELECT grp, 'preview' FROM w WHERE preview UNION ALL SELECT grp, 'repeated_files' FROM d""",
)
def merge_guards(spark, sf):
    """The runs of each customer as one merge request."""
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("grp"))
    rows = runs(spark, sf).join(owner, "run_id").withColumn(
        "file_id", F.concat("file_id", F.lit("/"), (F.col("run_id") % 3).cast("string")))
    return history.merge_problems(rows, "grp")


@query(
    "selected_export",
    f"""WITH {RUNS}, ch AS (SELECT l_orderkey AS run_id, 'File' || CAST(l_partkey % 500 AS VARCHAR) || '.csv' AS file_id FROM lineitem UNION ALL SELECT run_id, file_id FROM runs),
    w AS (SELECT run_id, file_id, count(*) AS n FROM ch GROUP BY ALL), f AS (SELECT w.*, system, model FROM w LEFT JOIN (SELECT * FROM runs WHERE NOT preview) USING (run_id, file_id)),
    m AS (SELECT system, min(model) <> max(model) AS mixed FROM f WHERE system IS NOT NULL GROUP BY ALL)
    SELECT run_id, file_id, system, CASE WHEN system IS NULL THEN 'unavailable' WHEN n > 1 THEN 'chosen_twice' WHEN mixed THEN 'several_models' ELSE 'ok' END AS status FROM f LEFT JOIN m USING (system)""",
)
def selected_export(spark, sf):
    """Every run is chosen once, and each line item chooses a file that mostly does not belong to its run."""
    r = runs(spark, sf)
    choices = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.concat(F.lit("File"), (F.col("l_partkey") % 500).cast("string"), F.lit(".csv")).alias("file_id"))
    return history.export_choices(choices.unionByName(r.select("run_id", "file_id")), r.drop("combined_from"))


@query(
    "result_listing",
    f"""WITH {RUNS} SELECT run_id, file_id, damage, row_number() OVER (ORDER BY damage DESC, CAST(regexp_extract(file_id, '([0-9]+)', 1) AS INTEGER), run_id) AS place
    FROM (SELECT run_id, 'File' || run_id || '.csv' AS file_id, damage, prediction FROM runs) WHERE contains(lower(file_id), 'ile1') AND prediction = 'F'""",
)
def result_listing(spark, sf):
    r = runs(spark, sf).select("run_id", F.concat(F.lit("File"), F.col("run_id").cast("string"), F.lit(".csv")).alias("file_id"), "damage", "prediction")
    return history.listing(r, "ILE1", "F").select("run_id", "file_id", "damage", "place")


HEAD = history.HEADINGS["door"]


@query(
    "operator_view",
    f"""WITH {SEG}, {RESULTS} SELECT strftime(make_timestamp(start_us), '%d %b %Y, %H:%M:%S') AS "{HEAD['start_time']}",
      strftime(make_timestamp(end_us), '%d %b %Y, %H:%M:%S') AS "{HEAD['end_time']}", prediction AS "{HEAD['prediction']}" FROM res""",
)
def operator_view(spark, sf):
    r = results(spark, sf).select(
        F.timestamp_micros("start_us").alias("start_time"), F.timestamp_micros("end_us").alias("end_time"), "prediction")
    return history.operator_view(r, "door")


@query(
    "label_adjacency",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer),
    b AS (SELECT *, CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1) ELSE (n % 5) + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS block,
      abs(c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey)) AS st FROM r)
    SELECT c_mktsegment, count(*) AS units, round(avg(st), 4) + 0.0 AS mean_step, """ + ", ".join(f"count(*) FILTER (block = {i}) AS block_{i}" for i in range(5)) + " FROM b GROUP BY c_mktsegment",
)
def label_adjacency(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    a = history.label_adjacency(c, "c_mktsegment", "c_custkey", "c_acctbal", 5)
    return a.withColumn("mean_step", rounded("mean_step", 4))


LI_ONCE = LI.replace("li AS (", "li AS MATERIALIZED (", 1)


@query(
    "trace_downsample",
    f"""WITH {LI_ONCE}, s AS MATERIALIZED (SELECT rec, avg(x) AS m, stddev_pop(x) AS sd, arg_min(i, (x, i)) AS lo, arg_max(i, (x, -i)) AS hi FROM li GROUP BY rec),
    d AS MATERIALIZED (SELECT li.rec, i, n, x, abs(x - m) AS o, abs(x - m) > 3 * sd + 1e-12 AS u, lo, hi FROM li JOIN s USING (rec)),
    r AS (SELECT *, least(n, 180) AS m, (n - 1) / greatest(least(n, 180) - 1, 1) AS st, count(*) FILTER (u) OVER (PARTITION BY rec ORDER BY o DESC, i) AS place FROM d),
    k AS (SELECT *, CAST(floor(i / greatest(st, 1)) AS BIGINT) AS j FROM r)
    SELECT rec, i + 1 AS index, {rd("x")} AS value, u AS unusual FROM k WHERE i IN (0, n - 1, lo, hi) OR (u AND place <= 24)
      OR (j < m AND CAST(floor(j * st) AS BIGINT) = i) OR (j + 1 < m AND CAST(floor((j + 1) * st) AS BIGINT) = i)""",
)
def trace_downsample(spark, sf):
    t = history.downsample(*recorded(spark, sf), "x")
    return t.withColumn("value", rounded("value"))


@query(
    "trace_points",
    f"""WITH {EV}, li AS MATERIALIZED (SELECT stream_id AS rec, current AS x, t, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY stream_id) AS n FROM ev WINDOW w AS (PARTITION BY stream_id ORDER BY t, seq)),
    s AS MATERIALIZED (SELECT rec, avg(x) AS m, stddev_pop(x) AS sd, arg_min(i, (x, i)) AS lo, arg_max(i, (x, -i)) AS hi FROM li GROUP BY rec),
    d AS MATERIALIZED (SELECT li.rec, t, i, n, x, m, sd, abs(x - m) AS o, abs(x - m) > 3 * sd + 1e-12 AS u, lo, hi FROM li JOIN s USING (rec)),
    r AS (SELECT *, least(n, 180) AS q, (n - 1) / greatest(least(n, 180) - 1, 1) AS st, count(*) FILTER (u) OVER (PARTITION BY rec ORDER BY o DESC, i) AS place,
      count(*) FILTER (u) OVER (PARTITION BY rec) AS flagged FROM d),
    k AS (SELECT *, CAST(floor(i / greatest(st, 1)) AS BIGINT) AS j FROM r)
    SELECT rec AS stream_id, i + 1 AS index, t AS time, {rd("x")} AS value, u AS unusual, CASE WHEN u AND place <= 24 THEN place END AS extreme, n, {rd("m")} AS mean, {rd("m - 3 * sd")} AS low,
      {rd("m + 3 * sd")} AS high, flagged FROM k WHERE i IN (0, n - 1, lo, hi) OR (u AND place <= 24)
      OR (j < q AND CAST(floor(j * st) AS BIGINT) = i) OR (j + 1 < q AND CAST(floor((j + 1) * st) AS BIGINT) = i)""",
)
def trace_points(spark, sf):
    """Points, times, band and outliers of every stream's trace of the motor current."""
    rows, order = streamed(spark, sf)
    t = history.traces(rows, order, "current")
    whole = ["stream_id", "index", "time", "unusual", "extreme", "n", "flagged"]
    return t.select(*whole, *[rounded(c).alias(c) for c in ("value", "mean", "low", "high")])


@query(
    "trace_summary",
    f"""WITH {LI}, s AS (SELECT rec, count(*) AS n, avg(x) AS mean, 3 * stddev_pop(x) AS reach FROM li GROUP BY rec)
    SELECT rec, s.n, {rd("any_value(mean)")} AS mean, {rd("any_value(mean - reach)")} AS low, {rd("any_value(mean + reach)")} AS high,
      count(*) FILTER (abs(x - mean) > reach + 1e-12) AS flagged FROM li JOIN s USING (rec) GROUP BY rec, s.n""",
)
def trace_summary(spark, sf):
    t = history.trace_summary(recorded(spark, sf)[0], ["rec"], "x")
    return t.select("rec", "n", "flagged", *[rounded(c).alias(c) for c in ("mean", "low", "high")])


EVID = [k for k, _, _ in history.DOOR_EVIDENCE]


@query(
    "evidence_metrics",
    f"""WITH {SEG}, {DIRECTION}, {PROFILE}, {ELECTRICAL}, {PHASE.format(keys='stream_id, segment_id', source='(SELECT *, current AS x FROM segp)')},
    xm AS (SELECT stream_id, segment_id, avg(z) FILTER (bin >= 6 AND bin < 16) AS exc_mid_mean FROM zz GROUP BY ALL),
    vs AS (SELECT stream_id, segment_id, count(*) FILTER (v = 0 AND current > 200) AS stall_rows FROM
      (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY stream_id, segment_id ORDER BY t, seq), pos)) AS v FROM segp) GROUP BY ALL),
    f AS (SELECT el.stream_id, el.segment_id, """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in EVID) + """
      FROM el JOIN ph USING (stream_id, segment_id) JOIN xm USING (stream_id, segment_id) JOIN vs USING (stream_id, segment_id))
    """ + " UNION ALL ".join(f"SELECT stream_id, segment_id, '{k}' AS key, '{label}' AS label, {rd(k)} AS value, '{unit}' AS unit FROM f" for k, label, unit in history.DOOR_EVIDENCE),
)
def evidence_metrics(spark, sf):
    """The eight door metrics of every cycle, as an evidence array and exploded."""
    s, order = segmented(spark, sf)
    placed = cut(cycles.placed_in(s, order))
    profile = cycles.profiles(placed, KEYS).join(cycles.directions(s, order).select(*KEYS, "operation"), KEYS)
    whole = cut(profile.join(s.groupBy(*KEYS).agg((F.avg("current") <= 50).alias("normal")), KEYS))
    excess = cycles.excess(cycles.with_excess(whole, cycles.reference_profile(whole, F.col("normal"))), KEYS)
    features = (
        cycles.electrical(s, order).join(cycles.phases(placed, KEYS), KEYS)
        .join(cycles.velocities(placed, order, "pos").select(*KEYS, "stall_rows"), KEYS).join(excess.select(*KEYS, "exc_mid_mean"), KEYS))
    rows = history.evidence_rows(history.evidence(features, KEYS), KEYS)
    return rows.select(*KEYS, "key", "label", rounded("value").alias("value"), "unit")


@query(
    "evidence_merge",
    f"""WITH {EV}, i AS (SELECT stream_id, mode, 'mean_current' AS key, avg(current) AS value FROM ev GROUP BY ALL UNION ALL SELECT stream_id, mode, 'max_voltage', max(voltage) FROM ev GROUP BY ALL),
    s AS (SELECT key, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM i GROUP BY ALL)
    SELECT stream_id, mode, key, {rd("value")} AS value, n, {rd("mean")} AS mean, {rd("mean - 2 * sd")} AS low, {rd("mean + 2 * sd")} AS high, abs(value - mean) > 2 * sd + 1e-12 AS unusual FROM i JOIN s USING (key)""",
)
def evidence_merge(spark, sf):
    """Evidence of two groups of modes pooled, bands computed anew over all of it."""
    e = event_stream(spark, sf)

    def part(rows):
        per = rows.groupBy("stream_id", "mode").agg(F.avg("current").alias("mean_current"), F.max("voltage").alias("max_voltage"))
        return per.unpivot(["stream_id", "mode"], ["mean_current", "max_voltage"], "key", "value")

    moving = F.col("mode").isin("click", "view")
    merged = part(e.where(moving)).unionByName(part(e.where(~moving)))
    b = peers.bands(merged, ["key"], "value")
    return b.select("stream_id", "mode", "key", "n", "unusual", *[rounded(c).alias(c) for c in ("value", "mean", "low", "high")])


LEAF, FAN = 64, 4


def _tree_sql(levels: int) -> str:
    """Digests of every level of the hash tree of relation ``smp`` (rec, i, t): a lone node goes up unchanged."""
    parts = [f"t0 AS (SELECT rec, i // {LEAF} AS node, sha256(string_agg(t, chr(10) ORDER BY i)) AS d, count(*) AS r FROM smp GROUP BY ALL)",
             "m0 AS (SELECT rec, sum(r) AS n, count(*) AS nodes FROM t0 GROUP BY rec)"]
    for k in range(1, levels + 1):
        parts += [
            f"t{k} AS (SELECT rec, node // {FAN} AS node, CASE WHEN any_value(nodes) = 1 THEN any_value(d) ELSE sha256(string_agg(d, chr(10) ORDER BY node)) END AS d "
            f"FROM t{k - 1} JOIN m{k - 1} USING (rec) GROUP BY rec, node // {FAN})",
            f"m{k} AS (SELECT rec, n, CAST(ceil(nodes / CAST({FAN} AS DOUBLE)) AS BIGINT) AS nodes FROM m{k - 1})"]
    return ", ".join(parts) + f" SELECT rec, CAST(n AS BIGINT) AS n, d AS digest FROM t{levels} JOIN m{levels} USING (rec)"


@query(
    "series_tree",
    """WITH smp AS (SELECT l_suppkey AS rec, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i,
      concat_ws(',', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS t FROM lineitem), """ + _tree_sql(10),
)
def series_tree(spark, sf):
    """Content digest of every long recording, as a tree of SHA-256 digests."""
    rows, order = recorded(spark, sf)
    placed = positions(rows, order, "i", "n")
    text = F.concat_ws(",", F.col("ok").cast("string"), F.col("ln").cast("string"), F.col("q").cast("long").cast("string"))
    return contracts.series_tree(placed, ["rec"], "i", text, LEAF, FAN)
