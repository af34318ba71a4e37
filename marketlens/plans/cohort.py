"""Study, sampling, matching, enrolment and model-evaluation queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from marketlens import bindings as b
from marketlens.functions.numeric import finite
from marketlens.operators import cohort as co
from marketlens.operators import joins as jn
from marketlens.operators import outcomes as oc
from marketlens.operators import stats as st
from marketlens.plans.market import PATHS, PREHISTORY_SQL, SCORED, r6
from marketlens.plans.outcomes import CASES, OUT, cases, joined
from marketlens.registry import query
from marketlens.session import cut_lineage

LO = 1_704_067_200
SWITCH = (b.DAY // 8, b.DAY // 8)
AGE = (b.DAY, 25 * b.DAY)
CONTRAST = ["band", "net_now", "buy_ratio", "vol_mc", "liq_change_now", "anchor_multiple"]


def tail(sql: str) -> str:
    return sql[len(b.SNAP):]


STUDY = b.LAUNCH + tail(SCORED) + tail(PATHS) + tail(PREHISTORY_SQL) + f""",
sw AS (SELECT id, min(pair) OVER w <> max(pair) OVER w AS pair_switch FROM snap
   WINDOW w AS (PARTITION BY mint ORDER BY ts RANGE BETWEEN {SWITCH[0]} PRECEDING AND {SWITCH[1]} FOLLOWING)),
anc AS (SELECT id, mc / first_value(mc) OVER (PARTITION BY mint, pair ORDER BY ts, id) AS anchor_multiple FROM snap),
study AS (SELECT s.*, l.label, l.max_multiple, l.endpoint_multiple, a.anchor_multiple, n.created_ts // 1000 AS created_s,
  CASE WHEN NOT (s.ts - n.created_ts // 1000 BETWEEN {AGE[0]} AND {AGE[1]}) THEN 'age_or_pair'
   WHEN NOT (s.mc BETWEEN 30000 AND 750000 AND s.price > 0 AND s.liq >= 25000 AND s.vol_h1 >= 20000) THEN 'base_or_invalid'
   WHEN s.gate <> 'pass' THEN 'scorer_history'
   WHEN s.ts - {b.PRE} < {LO} OR s.ts + {b.HORIZON + b.LATE} >= {b.NOW} THEN 'split_or_immature'
   WHEN l.reason <> 'covered' THEN l.reason WHEN NOT p.prehistory_ok THEN 'partial_prehistory' WHEN w.pair_switch THEN 'pair_switch'
   ELSE 'eligible' END AS study_reason
  FROM scored s JOIN labelled l USING (id) JOIN pre p USING (id) JOIN sw w USING (id) JOIN anc a USING (id) JOIN launch n ON n.mint = s.mint),
rows_ AS (SELECT * FROM study WHERE study_reason = 'eligible'),
arms AS (SELECT *, unnest(list_filter(['A0', CASE WHEN sig_h1_not_extended THEN 'A1' END,
   CASE WHEN sig_h1_not_extended AND anchor_multiple <= 1.5::DOUBLE THEN 'A2' END], lambda x: x IS NOT NULL)) AS arm FROM rows_ WHERE score >= 5)
"""


def study(spark, sf):
    created = b.snapshots(spark, sf).groupBy("mint").agg(F.min("ts").alias("created_s"))
    d = b.snapshots(spark, sf).join(created, "mint")
    return co.study_rows(d, LO, b.NOW, AGE, b.SPAN, b.PRE, b.HORIZON, b.LATE, b.GAP, SWITCH, b.CHUNK)


def eligible(spark, sf):
    """The rows that pass every gate: few next to the observations, read by several consumers, so written once."""
    d = study(spark, sf).filter("study_reason = 'eligible'")
    return cut_lineage(d.select("id", "mint", "pair", "ts", "score", "label", "max_multiple", "endpoint_multiple", "sig_h1_not_extended", *CONTRAST))


@query("E23 A16", STUDY + "SELECT study_reason, coalesce(label, 'none') AS label, count(*) AS n FROM study GROUP BY ALL")
def study_funnel(spark, sf):
    return study(spark, sf).groupBy("study_reason", F.coalesce("label", F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("P22", STUDY + "SELECT id, arm FROM arms")
def select_arms(spark, sf):
    return co.select_arms(eligible(spark, sf), 1.5, 5).select("id", "arm")


ARM_SQL = """count(*) AS minutes, count(*) FILTER (label = 'run') AS run_minutes, count(*) FILTER (label = 'non_run') AS non_run_minutes,
 round(count(*) FILTER (label = 'run') / count(*), 6) AS run_rate, round(count(*) FILTER (endpoint_multiple >= 2) / count(*), 6) AS endpoint_2x_rate,
 count(DISTINCT mint) AS unique_tokens, count(DISTINCT ts // 86400) AS utc_days"""
ARM_COLS = ["minutes", "run_minutes", "non_run_minutes", "unique_tokens", "utc_days"]


@query("E12 P22", STUDY + f"SELECT arm, {ARM_SQL} FROM arms GROUP BY arm")
def arm_summary(spark, sf):
    return co.arm_summary(co.select_arms(eligible(spark, sf), 1.5, 5), ["arm"]).select("arm", *ARM_COLS, r6("run_rate"), r6("endpoint_2x_rate"))


@query("E12 A6", STUDY + """SELECT arm, count(endpoint_multiple) AS n, count(*) - count(endpoint_multiple) AS missing, round(quantile_cont(endpoint_multiple, 0.25), 6) AS p25,
 round(quantile_cont(endpoint_multiple, 0.5), 6) AS median, round(quantile_cont(endpoint_multiple, 0.75), 6) AS p75, round(avg(endpoint_multiple), 6) AS mean FROM arms GROUP BY arm""")
def arm_endpoint_distribution(spark, sf):
    d = st.distribution(co.select_arms(eligible(spark, sf), 1.5, 5), ["arm"], "endpoint_multiple")
    return d.select("arm", "n", "missing", *[r6(c) for c in ("p25", "median", "p75", "mean")])


GRID = [0.25, 0.5, 1.0, 1.5, 2.0, 4.0]


@query("E13", STUDY + f""", base AS (SELECT r.*, g FROM rows_ r JOIN (SELECT unnest({GRID}::DOUBLE[]) AS g) ON anchor_multiple <= g WHERE score >= 5 AND sig_h1_not_extended),
 s AS (SELECT g, {ARM_SQL}, count(*) FILTER (label = 'run') / count(*) AS raw_rate FROM base GROUP BY g),
 q AS (SELECT *, run_minutes >= 20 AND non_run_minutes >= 20 AND utc_days >= 2 AS qualifies FROM s)
 SELECT g, {', '.join(ARM_COLS)}, run_rate, endpoint_2x_rate, qualifies, coalesce(g = (SELECT arg_min(g, (-raw_rate, g)) FROM q WHERE qualifies), false) AS chosen FROM q""")
def grid_search(spark, sf):
    d = co.grid_search(eligible(spark, sf), GRID, 5)
    return d.select("g", *ARM_COLS, r6("run_rate"), r6("endpoint_2x_rate"), "qualifies", "chosen")


@query("E13 W9", b.SNAP + f""", p AS (SELECT *, mc / max(mc) OVER (PARTITION BY mint ORDER BY ts RANGE BETWEEN {b.PRE} PRECEDING AND 1 PRECEDING) AS ratio FROM snap),
 cells AS (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS depth), bufs AS (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS rise)
 SELECT depth, rise, count(*) AS n, count(DISTINCT mint) AS tokens FROM p, cells, bufs WHERE ratio <= depth AND pc_h1 / 20 >= rise GROUP BY ALL""")
def second_leg_grid(spark, sf):
    """Nine cells of depth below the prior peak and strength of the present rise."""
    from marketlens.operators.features import prior_peak_ratio
    d = prior_peak_ratio(b.snapshots(spark, sf), b.PRE)
    fit = lambda vals, test: F.filter(F.array(*[F.lit(v) for v in vals]), test)
    d = (d.withColumn("depth", F.explode(fit((0.3, 0.5, 0.7), lambda v: F.col("prior_peak_ratio") <= v)))
         .withColumn("rise", F.explode(fit((0.5, 1.0, 2.0), lambda v: F.col("pc_h1") / 20 >= v))))
    return d.groupBy("depth", "rise").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("mint").alias("tokens"))


SAMPLED = STUDY + """, need AS (SELECT ts // 86400 AS day, count(*) AS need FROM rows_ WHERE label = 'run' GROUP BY 1),
 pool AS (SELECT *, row_number() OVER (PARTITION BY ts // 86400 ORDER BY ('0x' || substr(sha256(concat_ws('|', 'seed-1', mint, pair, ts)), 1, 15))::BIGINT, mint, pair, ts) AS rk FROM rows_ WHERE label = 'non_run'),
 sampled AS (SELECT p.* FROM pool p JOIN need n ON n.day = p.ts // 86400 WHERE rk <= need)
"""


def sampled(spark, sf, rows=None):
    return co.hash_sample_by_stratum(eligible(spark, sf) if rows is None else rows, F.expr("ts div 86400"), F.col("label") == "run",
                                     F.col("label") == "non_run", "seed-1", ["mint", "pair", "ts"])


@query("E9", SAMPLED + "SELECT id FROM sampled")
def hash_sample_by_stratum(spark, sf):
    return sampled(spark, sf).select("id")


@query("E14 A6", SAMPLED + """, both_ AS (SELECT 'run' AS grp, * EXCLUDE (rk) FROM (SELECT *, 0 AS rk FROM rows_ WHERE label = 'run') UNION ALL SELECT 'non_run', * EXCLUDE (rk) FROM sampled),
 longer AS (""" + " UNION ALL ".join(f"SELECT grp, '{c}' AS feature, {c} AS value FROM both_" for c in CONTRAST) + """)
 SELECT grp AS "group", feature, count(value) AS n, count(*) - count(value) AS missing, round(quantile_cont(value, 0.25), 6) AS p25,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75 FROM longer GROUP BY ALL""")
def feature_contrast(spark, sf):
    cols = ["group", *CONTRAST]
    rows = eligible(spark, sf)
    d = rows.filter("label = 'run'").withColumn("group", F.lit("run")).select(*cols)
    d = d.unionByName(sampled(spark, sf, rows).withColumn("group", F.lit("non_run")).select(*cols))
    return st.feature_contrast(d, "group", CONTRAST).select("group", "feature", "n", "missing", r6("p25"), r6("median"), r6("p75"))


@query("E5", STUDY + f""", hi AS (SELECT * FROM rows_ WHERE score >= 5), days AS (SELECT ts // 86400 AS day, count(*) FILTER (label = 'run') AS n, count(*) AS d FROM hi GROUP BY 1),
 idx AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS k FROM days),
 draws AS (SELECT rep, ('0x' || substr(md5(concat_ws('|', 'boot', rep, i)), 1, 8))::BIGINT % k AS pick FROM idx, range(2000) r(rep)),
 rates AS (SELECT rep, sum(n) / sum(d) AS rate FROM draws JOIN idx ON idx.i = pick GROUP BY rep),
 srt AS (SELECT list(rate ORDER BY rate) AS s, count(*) AS m FROM rates), tot AS (SELECT count(*) AS clusters, sum(n) / sum(d) AS estimate FROM days)
 SELECT clusters, round(estimate, 6) AS estimate, clusters >= 10 AS readable, CASE WHEN clusters >= 10 THEN round(s[CAST(floor(m * 0.025) AS INT) + 1], 6) END AS p025,
  CASE WHEN clusters >= 10 THEN round(s[CAST(least(m - 1, floor(m * 0.975)) AS INT) + 1], 6) END AS p975 FROM tot, srt""")
def cluster_bootstrap(spark, sf):
    d = eligible(spark, sf).filter("score >= 5").withColumn("day", F.expr("ts div 86400"))
    out = st.cluster_bootstrap(d, "day", (F.col("label") == "run").cast("int"), F.lit(1), 2000, "boot")
    return out.select("clusters", r6("estimate"), "readable", r6("p025"), r6("p975"))


@query("E5", STUDY + """, dl AS (SELECT ts // 86400 AS day, arm, count(*) AS d, count(*) FILTER (label = 'run') AS r, count(*) FILTER (endpoint_multiple >= 2) AS e FROM arms GROUP BY ALL),
 idx AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT day FROM dl)),
 draws AS (SELECT rep, ('0x' || substr(md5(concat_ws('|', 'boot', rep, i)), 1, 8))::BIGINT % k AS pick FROM idx, range(2000) q(rep)),
 rt AS (SELECT rep, arm, sum(r) / sum(d) AS r, sum(e) / sum(d) AS e FROM draws JOIN idx ON idx.i = pick JOIN dl USING (day) GROUP BY ALL),
 lg AS (SELECT arm, 'run_rate' AS rate, list(r ORDER BY r) AS s, count(*) AS m FROM rt GROUP BY arm UNION ALL SELECT arm, 'endpoint_2x_rate', list(e ORDER BY e), count(*) FROM rt GROUP BY arm),
 es AS (SELECT arm, 'run_rate' AS rate, sum(r) / sum(d) AS estimate FROM dl GROUP BY arm UNION ALL SELECT arm, 'endpoint_2x_rate', sum(e) / sum(d) FROM dl GROUP BY arm),
 kk AS (SELECT count(*) AS clusters FROM idx)
 SELECT es.arm, es.rate, clusters, clusters >= 10 AS readable, round(es.estimate, 6) AS estimate, round(es.estimate - b.estimate, 6) AS difference,
  CASE WHEN clusters >= 10 THEN round(s[CAST(least(m - 1, floor(m * 0.025)) AS INT) + 1], 6) END AS p025, CASE WHEN clusters >= 10 THEN round(s[CAST(least(m - 1, floor(m * 0.975)) AS INT) + 1], 6) END AS p975
 FROM es JOIN es b ON b.rate = es.rate AND b.arm = 'A0' JOIN lg ON lg.arm = es.arm AND lg.rate = es.rate, kk""")
def arm_bootstrap(spark, sf):
    """Run and endpoint rates of the nested arms with intervals over days, and their differences to the first arm."""
    d = co.select_arms(eligible(spark, sf), 1.5, 5).withColumn("day", F.expr("ts div 86400"))
    out = st.arm_bootstrap(d, "day", "arm", {"run_rate": F.col("label") == "run", "endpoint_2x_rate": F.col("endpoint_multiple") >= 2}, "A0", 2000, "boot")
    return out.select("arm", "rate", "clusters", "readable", *[r6(c) for c in ("estimate", "difference", "p025", "p975")])


# --- matching ---------------------------------------------------------------------------------

# The grid works on logarithms with a hair of slack; WITHIN_2X decides the border exactly.
LN2 = math.log(2) + 1e-9
WITHIN_2X = "r_entry_mc / entry_mc BETWEEN 0.5D AND 2 AND r_entry_liq / entry_liq BETWEEN 0.5D AND 2"
OK = "points >= 4 AND history_s >= 600 AND entry_mc BETWEEN 30000 AND 750000 AND entry_liq >= 25000 AND vol_h1 >= 20000"
MATCHED = CASES + f""", fa AS (SELECT mint, min(decision_ts) AS first_alert FROM cases WHERE source = 'ALERT' GROUP BY mint),
 al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY decision_ts, id) AS rn FROM cases WHERE source = 'ALERT') WHERE rn = 1 AND {OK}),
 sh AS (SELECT c.*, first_alert FROM cases c LEFT JOIN fa USING (mint) WHERE source = 'SHADOW' AND {OK}),
 cand AS (SELECT a.id AS case_id, s.id AS control_id, a.mint, s.mint AS control_mint, a.decision_ts,
   abs(a.decision_ts - s.decision_ts) / {2.0 * b.DAY}::DOUBLE + abs(ln(a.entry_mc) - ln(s.entry_mc)) + abs(ln(a.entry_liq) - ln(s.entry_liq)) AS distance
   FROM al a JOIN sh s ON s.regime = a.regime AND s.mint <> a.mint AND a.decision_ts - s.decision_ts BETWEEN 0 AND {2 * b.DAY}
   AND NOT coalesce(s.first_alert <= a.decision_ts, false) AND s.entry_mc / a.entry_mc BETWEEN 0.5::DOUBLE AND 2 AND s.entry_liq / a.entry_liq BETWEEN 0.5::DOUBLE AND 2),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY distance, control_id) AS rn FROM cand) WHERE rn = 1)
"""


def _logs(d):
    return (d.withColumn("lmc", F.ln(F.when(F.col("entry_mc") > 0, F.col("entry_mc"))))
            .withColumn("lliq", F.ln(F.when(F.col("entry_liq") > 0, F.col("entry_liq")))))


def nearest(spark, sf):
    from marketlens.operators.tables import first_per_key
    c = cut_lineage(cases(spark, sf))
    alerts = first_per_key(c.filter("source = 'ALERT'"), ["mint"], ["decision_ts", "id"]).filter(OK)
    first = c.filter("source = 'ALERT'").groupBy("mint").agg(F.min("decision_ts").alias("first_alert"))
    shadows = c.filter("source = 'SHADOW'").filter(OK).join(first, "mint", "left")
    keep = ["id", "mint", "regime", "decision_ts", "entry_mc", "entry_liq", "lmc", "lliq"]
    # Matching never sees an outcome: the projections hold identity, time, regime and size only.
    left, right = _logs(alerts).select(*keep), _logs(shadows).select(*keep, "first_alert")
    rule = (F.expr(WITHIN_2X) & (F.col("r_mint") != F.col("mint")) & (F.col("r_decision_ts") <= F.col("decision_ts"))
            & F.coalesce(F.col("r_first_alert") > F.col("decision_ts"), F.lit(True)))
    return jn.nearest_controls(left, right, ["regime"], [("decision_ts", 2 * b.DAY, 2 * b.DAY), ("lmc", LN2, 1.0), ("lliq", LN2, 1.0)],
                               "id", "id", 1, rule, ["first_alert", "entry_mc", "entry_liq"], barred="mint")


@query("E7 J8", MATCHED + "SELECT case_id, control_id, round(distance, 6) AS distance FROM best")
def match_nearest(spark, sf):
    return nearest(spark, sf).select(F.col("id").alias("case_id"), F.col("r_id").alias("control_id"), r6("distance"))


@query("A10", MATCHED + """SELECT count(*) AS control_entries, count(DISTINCT control_mint) AS unique_controls, (SELECT max(n) FROM (SELECT count(*) AS n FROM best GROUP BY control_mint)) AS max_control_reuse,
  count(DISTINCT case_id) AS matched, count(DISTINCT decision_ts // 86400) AS days, count(*) - count(DISTINCT control_mint) AS reused_entries FROM best""")
def control_reuse(spark, sf):
    return co.control_reuse(nearest(spark, sf), "id", "r_mint", F.expr("decision_ts div 86400"))


PAIRED = OUT + MATCHED[len(CASES):] + """,
 pd AS (SELECT m.case_id, m.control_id, a.horizon, a.reason AS ar, s.reason AS sr, a.multiple AS am, s.multiple AS sm FROM best m JOIN reasons a ON a.id = m.case_id
   JOIN reasons s ON s.id = m.control_id AND s.horizon = a.horizon)
"""


def paired(spark, sf):
    j = joined(spark, sf).select("id", "horizon", "multiple", oc.valid_endpoint(b.LATE, b.GAP).alias("reason"))
    j = cut_lineage(j)
    p = nearest(spark, sf).select(F.col("id").alias("case_id"), F.col("r_id").alias("control_id"))
    return co.paired_differences(p, j, j)


@query("E15", PAIRED + """SELECT horizon, coalesce(CASE WHEN NOT (ar = 'eligible' AND sr = 'eligible') THEN ar || ' / ' || sr END, 'complete') AS excluded, count(*) AS n FROM pd GROUP BY ALL""")
def paired_exclusions(spark, sf):
    return paired(spark, sf).groupBy("horizon", F.coalesce("excluded", F.lit("complete")).alias("excluded")).agg(F.count(F.lit(1)).alias("n"))


@query("E15 A6", PAIRED + """SELECT horizon, count(*) FILTER (ar = 'eligible' AND sr = 'eligible') AS n, round(quantile_cont(am - sm, 0.5) FILTER (ar = 'eligible' AND sr = 'eligible'), 6) AS median,
  round(avg(am - sm) FILTER (ar = 'eligible' AND sr = 'eligible'), 6) AS mean FROM pd GROUP BY horizon""")
def paired_differences(spark, sf):
    return st.distribution(paired(spark, sf), ["horizon"], "difference").select("horizon", "n", r6("median"), r6("mean"))


CYCLE = 6 * 3600
CYC = b.LAUNCH + tail(SCORED) + f""", cyc AS (SELECT s.*, s.ts // {CYCLE} AS cycle, s.ts - l.created_ts // 1000 AS age, points >= 4 AND history_s >= 600 AND mc BETWEEN 30000 AND 750000
   AND liq >= 25000 AND vol_h1 >= 20000 AS ok FROM scored s JOIN launch l USING (mint)),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cycle, mint ORDER BY ts DESC, id DESC) AS rn FROM cyc) WHERE rn = 1),
 ev_ AS (SELECT * FROM one WHERE ok AND score >= 7),
 ctl AS (SELECT * FROM one WHERE ok AND score < 7)
"""


def cycle_rows(spark, sf):
    """Last row of each instrument and cycle."""
    from marketlens.operators.features import match_eligible
    from marketlens.operators.tables import last_per_key
    from marketlens.plans.market import scored
    created = b.snapshots(spark, sf).groupBy("mint").agg(F.min("ts").alias("created_s"))
    d = (scored(spark, sf).join(created, "mint").withColumn("cycle", F.expr(f"ts div {CYCLE}"))
         .withColumn("age", F.col("ts") - F.col("created_s")).withColumn("ok", match_eligible())
         .withColumn("entry_mc", F.col("mc")).withColumn("entry_liq", F.col("liq")))
    d = d.select("id", "mint", "pair", "ts", "cycle", "age", "ok", "score", "entry_mc", "entry_liq")
    # Events, controls and funnel all read the cycles: written once.
    return cut_lineage(last_per_key(d, ["cycle", "mint"], ["ts", "id"]))


@query("E8 T2 J8", CYC + f""", c AS (SELECT e.id AS case_id, k.id AS control_id, k.mint, abs(e.age - k.age) / {5.0 * b.DAY}::DOUBLE + abs(ln(e.mc) - ln(k.mc)) + abs(ln(e.liq) - ln(k.liq)) AS distance
   FROM ev_ e JOIN ctl k ON k.cycle = e.cycle AND k.mint <> e.mint AND abs(e.age - k.age) <= {5 * b.DAY} AND k.mc / e.mc BETWEEN 0.5::DOUBLE AND 2 AND k.liq / e.liq BETWEEN 0.5::DOUBLE AND 2)
 SELECT case_id, control_id, rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY distance, mint) AS rank FROM c) WHERE rank <= 3""")
def match_same_cycle(spark, sf):
    rows = _logs(cycle_rows(spark, sf).filter("ok")).select("id", "mint", "cycle", "age", "entry_mc", "entry_liq", "lmc", "lliq", "score")
    events, controls = rows.filter("score >= 7").drop("score"), rows.filter("score < 7").drop("score")
    d = jn.nearest_controls(events, controls, ["cycle"], [("age", 5 * b.DAY, 5 * b.DAY), ("lmc", LN2, 1.0), ("lliq", LN2, 1.0)],
                            "id", "mint", 3, F.expr(WITHIN_2X) & (F.col("r_mint") != F.col("mint")), ["entry_mc", "entry_liq"])
    return d.select(F.col("id").alias("case_id"), F.col("r_id").alias("control_id"), F.col("rank").cast("long").alias("rank"), r6("distance"))


@query("J9", CYC + """, x AS (SELECT e.id AS event, k.score < 7 AS s, k.ok AS b, NOT (k.pair = 'error') AS p FROM ev_ e JOIN one k ON k.cycle = e.cycle AND k.mint <> e.mint)
 SELECT count(*) AS other_entries, count(*) FILTER (s) AS score_below, count(*) FILTER (s AND b) AS basic_eligible, count(*) FILTER (s AND b AND p) AS not_excluded,
  count(DISTINCT CASE WHEN s AND b AND p THEN event END) AS events_with_survivor FROM x""")
def matching_funnel(spark, sf):
    rows = cycle_rows(spark, sf)
    return co.matching_funnel(rows.filter("ok and score >= 7"), rows, "cycle", [
        ("score_below", F.col("score") < 7), ("basic_eligible", F.col("ok")), ("not_excluded", F.col("pair") != "error")])


@query("J8", CYC + f""", c AS (SELECT e.id, count(*) AS candidates, min(abs(e.age - k.age) / {5.0 * b.DAY}::DOUBLE + abs(ln(e.mc) - ln(k.mc)) + abs(ln(e.liq) - ln(k.liq))) AS d
   FROM ev_ e JOIN ctl k ON k.cycle = e.cycle AND abs(e.age - k.age) <= {5 * b.DAY} AND k.mc / e.mc BETWEEN 0.5::DOUBLE AND 2 AND k.liq / e.liq BETWEEN 0.5::DOUBLE AND 2 GROUP BY e.id)
 SELECT id, candidates, round(d, 6) AS nearest FROM c""")
def caliper_candidates(spark, sf):
    rows = _logs(cycle_rows(spark, sf).filter("ok")).select("id", "cycle", "age", "entry_mc", "entry_liq", "lmc", "lliq", "score")
    d = jn.caliper_join(rows.filter("score >= 7"), rows.filter("score < 7"), ["cycle"],
                        [("age", 5 * b.DAY, 5 * b.DAY), ("lmc", LN2, 1.0), ("lliq", LN2, 1.0)]).filter(WITHIN_2X)
    return d.groupBy("id").agg(F.count(F.lit(1)).alias("candidates"), F.round(F.min("distance"), 6).alias("nearest"))


@query("E6")
def match_pairs_greedy(spark, sf):
    """Winners take the nearest unused failure in time order (checked against brute force in the tests)."""
    j = joined(spark, sf).filter(F.col("horizon") == b.HORIZON).withColumn("ok", oc.valid_endpoint(b.LATE, b.GAP) == "eligible")
    j = cut_lineage(j).filter("ok and entry_mc > 0 and entry_liq > 0").select(
        "id", "regime", "decision_ts", "score", F.log10("entry_mc").alias("l10mc"), F.log10("entry_liq").alias("l10liq"), "multiple")
    win, fail = j.filter("multiple >= 2").drop("multiple"), j.filter("multiple <= 0.55").drop("multiple")
    d = jn.greedy_pairs(win, fail, ["regime"], [("l10mc", 0.3, 1.0), ("l10liq", 0.3, 1.0), ("decision_ts", 3 * b.DAY, None), ("score", 1, None)],
                        ["decision_ts", "id"], "id")
    return d.select(F.col("id").alias("winner_id"), F.col("r_id").alias("failure_id"), r6("distance"))


# --- splits, enrolment, stopping, models ------------------------------------------------------

SPLIT_WHY = f"CASE WHEN NOT coalesce(coverage_ok, false) THEN 'coverage' WHEN NOT coalesce(lateness BETWEEN 0 AND {b.LATE} AND observed_ts = decision_ts + horizon + lateness, false) THEN 'timing' WHEN NOT coalesce(multiple > 0, false) THEN 'outcome' END"
SPLIT = OUT + f""", w AS (SELECT *, {SPLIT_WHY} AS why FROM joined WHERE horizon = {b.HORIZON}),
 x AS (SELECT *, CASE WHEN coalesce(sum((why IS NULL)::INT) OVER (PARTITION BY mint ORDER BY decision_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'repeat_mint' ELSE why END AS exclusion FROM w),
 s AS (SELECT *, row_number() OVER (ORDER BY decision_ts, id) AS rn, count(*) OVER () AS n FROM x WHERE exclusion IS NULL),
 t AS (SELECT *, rn <= floor(n * 0.7) AS tr, min(CASE WHEN rn > floor(n * 0.7) THEN decision_ts END) OVER () AS t0 FROM s),
 parts AS (SELECT *, CASE WHEN tr AND observed_ts >= t0 THEN 'embargo' WHEN tr THEN 'train' ELSE 'test' END AS split FROM t)
"""


def _first_eligible(spark, sf):
    j = joined(spark, sf).filter(F.col("horizon") == b.HORIZON)
    return co.first_eligible_split(j, F.expr(SPLIT_WHY), b.CHUNK)


@query("E1", SPLIT + "SELECT coalesce(exclusion, 'kept') AS exclusion, count(*) AS n FROM x GROUP BY 1")
def split_exclusions(spark, sf):
    return _first_eligible(spark, sf).groupBy(F.coalesce("exclusion", F.lit("kept")).alias("exclusion")).agg(F.count(F.lit(1)).alias("n"))


@query("E1 U3", SPLIT + "SELECT id, split FROM parts")
def first_alert_split(spark, sf):
    d = _first_eligible(spark, sf).filter("exclusion is null")
    return st.chronological_split(d, ["decision_ts", "id"], 0.7, "observed_ts").select("id", "split")


@query("E16", SCORED + """, q AS (SELECT * FROM scored s WHERE gate = 'pass' AND score >= 6 AND NOT EXISTS (SELECT 1 FROM snap x WHERE x.mint = s.mint AND x.pair = 'error' AND x.k >= 95))
 SELECT mint, arg_min(id, (ts, id)) AS id, arg_min(NOT (pair = 'error'), (ts, id)) AS valid, count(*) AS attempts FROM q GROUP BY mint""")
def cohort_enroll(spark, sf):
    from marketlens.plans.market import scored
    ex = b.snapshots(spark, sf).filter("pair = 'error' and k >= 95")
    d = co.cohort_enroll(scored(spark, sf), F.expr("gate = 'pass' and score >= 6"), F.col("pair") == "error", ex)
    return d.select("mint", "id", "valid", "attempts")


@query("E18", b.SNAP + """, p AS (SELECT id AS seq, CASE WHEN ts >= 1706400000 AND pair = 'view' THEN NULL ELSE pair = 'purchase' END AS eligible FROM snap),
 wall AS (SELECT min(seq) AS w FROM p WHERE eligible IS NULL), o AS (SELECT seq, sum(eligible::INT) OVER (ORDER BY seq) AS n FROM p, wall WHERE seq < w)
 SELECT CAST(max(n) AS BIGINT) AS eligible_before, min(CASE WHEN n = 150 THEN seq END) AS cutoff, (SELECT w FROM wall) AS first_unresolved, CASE WHEN min(CASE WHEN n = 150 THEN seq END) IS NOT NULL THEN 'sample_limit' ELSE 'time_limit' END AS stop_reason FROM o""")
def sequential_stop(spark, sf):
    d = b.snapshots(spark, sf).select(F.col("id").alias("seq"), F.expr("CASE WHEN ts >= 1706400000 AND pair = 'view' THEN NULL ELSE pair = 'purchase' END").alias("eligible"))
    return co.sequential_stop(d, "seq", "eligible", 150, b.NOW, b.NOW).select(F.col("eligible_before").cast("long").alias("eligible_before"), "cutoff", "first_unresolved", "stop_reason")


@query("E11", b.SNAP + """, p AS (SELECT mint, pair, k, ts // 86400 AS day FROM snap), one AS (SELECT day, mint, max(k) AS k FROM p GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ('0x' || substr(sha256(mint::VARCHAR), 1, 15))::BIGINT, mint) - 1 AS place, count(*) OVER (PARTITION BY day) - 1 AS universe_size FROM one),
 d AS (SELECT *, CASE WHEN universe_size > 0 THEN ('0x' || substr(sha256(concat_ws('|', 'draw', mint, day)), 1, 15))::BIGINT % nullif(universe_size, 0) END AS i FROM o WHERE k >= 97)
 , sd AS (SELECT day, sha256(CAST(to_json(list(mint::VARCHAR ORDER BY mint::VARCHAR)) AS VARCHAR)) AS st FROM one GROUP BY day)
 SELECT d.mint, d.day, d.universe_size, d.i AS draw_index, c.mint AS control, sha256(concat_ws('|', st, d.mint)) AS universe_digest FROM d JOIN sd ON sd.day = d.day LEFT JOIN o c ON c.day = d.day AND c.place = CASE WHEN d.i >= d.place THEN d.i + 1 ELSE d.i END""")
def seeded_control_draw(spark, sf):
    d = b.snapshots(spark, sf).groupBy(F.expr("ts div 86400").alias("day"), "mint").agg(F.max("k").alias("k"))
    return co.seeded_control_draw(d, F.col("k") >= 97, "day", "mint", "draw")


@query("E22", b.SNAP + """, d AS (SELECT mint, ts // 86400 AS day, count(*) AS n, count(*) FILTER (pair = 'purchase') AS h FROM snap GROUP BY ALL),
 c AS (SELECT mint, day, sum(n) OVER w AS total, sum(h) OVER w AS hits FROM d WINDOW w AS (PARTITION BY mint ORDER BY day)),
 e AS (SELECT *, total - lag(total) OVER w AS dt, hits - lag(hits) OVER w AS dh FROM c WINDOW w AS (PARTITION BY mint ORDER BY day)),
 f AS (SELECT *, lag(dt) OVER w AS pt, lag(dh) OVER w AS ph FROM e WINDOW w AS (PARTITION BY mint ORDER BY day)),
 g AS (SELECT *, CASE WHEN dt >= 2 AND pt >= 2 THEN 100 * (dh / dt - ph / pt) END AS s FROM f WHERE pt IS NOT NULL)
 SELECT mint, day, round(s, 6) AS shift_points, CASE WHEN dt < 2 OR pt < 2 THEN 'too_few' WHEN abs(s) >= 40 THEN 'triggered' ELSE 'steady' END AS status FROM g""")
def rate_shift(spark, sf):
    from marketlens.operators.timeline import running
    d = b.snapshots(spark, sf).groupBy("mint", F.expr("ts div 86400").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pair") == "purchase").alias("h"))
    c = running(d, ["mint"], ["day"], 10, {"total": ("sum", "n"), "hits": ("sum", "h")})
    return co.rate_shift(c, ["mint"], ["day"], "hits", "total", 10, 40.0, 2).select("mint", "day", r6("shift_points"), "status")


# Parameters of a small published-style model over document and label columns.
MODEL = {"features": ["n_chars", "words"], "mean": [6000.0, 900.0], "scale": [9000.0, 1300.0], "coefficients": [0.8, -0.4, 0.25]}
DOCS = """WITH docs AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, len(string_split(d.text, ' ')) AS words, l.quality AS y FROM documents d JOIN labels l USING (doc_id)),
 pr AS (SELECT *, 1 / (1 + exp(-least(40.0::DOUBLE, greatest(-40.0::DOUBLE, 0.8::DOUBLE + -0.4::DOUBLE * (n_chars - 6000.0::DOUBLE) / 9000.0::DOUBLE + 0.25::DOUBLE * (words - 900.0::DOUBLE) / 1300.0::DOUBLE)))) AS p FROM docs)
"""


def docs(spark, sf, how="inner"):
    """Documents with their label; a model is fitted on labelled ones and scores all (``how='left'``)."""
    d = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id", how)
    return d.select("doc_id", "lang", "source", "n_chars", F.size(F.split("text", " ")).alias("words"), F.col("quality").alias("y"))


ALL_DOCS = DOCS.replace("JOIN labels", "LEFT JOIN labels")


@query("E3 F6", ALL_DOCS + "SELECT doc_id, round(p, 6) AS probability FROM pr")
def predict(spark, sf):
    return st.predict(docs(spark, sf, "left"), MODEL).select("doc_id", r6("probability"))


@query("E4", DOCS + """, base AS (SELECT avg(y) AS q FROM docs) SELECT lang, count(*) AS n, round(avg(y), 6) AS positive_rate, round(avg((p - y) * (p - y)), 6) AS brier,
 round(avg(-(y * ln(greatest(1e-8, least(1 - 1e-8, p))) + (1 - y) * ln(1 - greatest(1e-8, least(1 - 1e-8, p))))), 6) AS log_loss, round(avg((q - y) * (q - y)), 6) AS base_brier,
 round(avg(-(y * ln(greatest(1e-8, least(1 - 1e-8, q))) + (1 - y) * ln(1 - greatest(1e-8, least(1 - 1e-8, q))))), 6) AS base_log_loss,
 round(avg((p - y) * (p - y) - (q - y) * (q - y)), 6) AS brier_delta FROM pr, base GROUP BY lang""")
def score_probabilities(spark, sf):
    d = st.predict(docs(spark, sf), MODEL)
    base = docs(spark, sf).agg(F.avg("y")).scalar()
    s = st.score_probabilities(d, "y", "probability", base, ["lang"])
    return s.select("lang", "n", *[r6(c) for c in ("positive_rate", "brier", "log_loss", "base_brier", "base_log_loss", "brier_delta")])


STEP = "1 / (1 + exp(-(w0 + w1 * a + w2 * c)))"


@query("E2", DOCS.replace("WITH", "WITH RECURSIVE", 1) + f""", m AS (SELECT avg(n_chars) AS ma, avg(words) AS mc, stddev_pop(n_chars) AS sa, stddev_pop(words) AS sc, count(*) AS n FROM docs),
 z AS (SELECT y::DOUBLE AS y, (n_chars - ma) / sa AS a, (words - mc) / sc AS c, n FROM docs, m),
 it AS (SELECT 0 AS i, 0::DOUBLE AS w0, 0::DOUBLE AS w1, 0::DOUBLE AS w2
  UNION ALL SELECT i + 1, w0 - (g0 * (h11 * h22 - h12 * h12) - g1 * (h01 * h22 - h12 * h02) + g2 * (h01 * h12 - h11 * h02)) / det,
   w1 - (-g0 * (h01 * h22 - h02 * h12) + g1 * (h00 * h22 - h02 * h02) - g2 * (h00 * h12 - h01 * h02)) / det, w2 - (g0 * (h01 * h12 - h02 * h11) - g1 * (h00 * h12 - h02 * h01) + g2 * (h00 * h11 - h01 * h01)) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
   SELECT i, w0, w1, w2, avg(p - y) AS g0, avg((p - y) * a) + w1 / any_value(n) AS g1, avg((p - y) * c) + w2 / any_value(n) AS g2, avg(p * (1 - p)) AS h00, avg(p * (1 - p) * a) AS h01, avg(p * (1 - p) * c) AS h02,
    avg(p * (1 - p) * a * a) + 1.0::DOUBLE / any_value(n) AS h11, avg(p * (1 - p) * a * c) AS h12, avg(p * (1 - p) * c * c) + 1.0::DOUBLE / any_value(n) AS h22
   FROM (SELECT it.*, z.*, {STEP} AS p FROM it, z WHERE i < 25) GROUP BY i, w0, w1, w2))),
 r AS (SELECT w0, w1, w2 FROM it WHERE i = 25),
 v AS (SELECT unnest([{{term: 'intercept', value: w0}}, {{term: 'n_chars', value: w1}}, {{term: 'words', value: w2}}], recursive := true) FROM r)
 SELECT term, round(value, 6) AS value, (SELECT n FROM m) AS rows FROM v""")
def fit_logistic(spark, sf):
    """Coefficients of the penalised logistic model; the SQL takes 25 Newton steps of its own."""
    d = docs(spark, sf)
    m = st.fit_logistic(d, ["n_chars", "words"], "y")
    # One row per coefficient, next to the number of rows each was fitted on.
    each = F.array(*[F.struct(F.lit(n).alias("term"), F.lit(v).alias("value")) for n, v in zip(["intercept", *m["features"]], m["coefficients"])])
    return d.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.explode(each).alias("c")).select("c.term", r6("c.value").alias("value"), "rows")


@query("A6", ALL_DOCS + """SELECT lang, count(n_chars) AS n, count(*) - count(n_chars) AS missing, round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS median,
 round(quantile_cont(n_chars, 0.75), 6) AS p75, round(avg(n_chars), 6) AS mean FROM docs GROUP BY lang""")
def distribution(spark, sf):
    return st.distribution(docs(spark, sf, "left"), ["lang"], "n_chars").select("lang", "n", "missing", *[r6(c) for c in ("p25", "median", "p75", "mean")])
