"""The survey-shaped views as SQL, and helpers to put them in front of an oracle query."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["fx_hh"] = """
SELECT c_custkey AS q_no,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(1 + c_custkey % 6 AS INT) END AS a3,
       CAST(CASE WHEN c_custkey % 20 = 19 THEN 97 ELSE 1 + c_custkey % 20 END AS INT) AS b15,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey % 2 AS INT) END AS c1,
       CAST(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS INT) AS c2
FROM customer WHERE c_custkey % 50 <> 7"""

VIEWS["fx_hm"] = """
SELECT o_custkey AS q_no, o_orderkey AS mem,
       CAST(CASE WHEN o_orderkey % 40 = 0 THEN 9 ELSE 1 + o_orderkey % 2 END AS INT) AS b1,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 125 AS INT) END AS b2,
       CAST(o_orderkey % 8 AS INT) AS e_status
FROM orders WHERE o_orderkey % 60 <> 11"""

VIEWS["fx_tp"] = """
SELECT o.o_custkey AS q_no, l.l_orderkey AS mem,
       CAST(ROW_NUMBER() OVER (PARTITION BY l.l_orderkey
            ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS INT) AS trip_no,
       l.l_partkey AS pk, l.l_suppkey AS sk,
       CASE WHEN o.o_orderdate < TIMESTAMP '1998-06-01 00:00:00' THEN 2011 ELSE 2022 END AS survey_year,
       CAST(CASE l.l_suppkey % 13 WHEN 0 THEN 999 WHEN 11 THEN 99 WHEN 12 THEN NULL
            ELSE l.l_suppkey % 13 END AS INT) AS mode_raw,
       CAST(1 + l.l_partkey % 6 AS INT) AS pur,
       CAST(CASE WHEN l.l_partkey % 25 = 0 THEN NULL ELSE l.l_quantity * 6 END AS DOUBLE) AS joutm,
       CAST(CASE WHEN l.l_partkey % 30 = 0 THEN 9 ELSE 1 + l.l_partkey % 4 END AS INT) AS tiper,
       CAST((l.l_partkey % 24) * 100 + l.l_suppkey % 60 AS INT) AS deptm,
       CAST((l.l_suppkey % 24) * 100 + l.l_partkey % 60 AS INT) AS arrtm,
       CAST(l.l_partkey % 25 AS INT) AS d5, CAST(l.l_suppkey % 27 AS INT) AS d6,
       CAST(1 + l.l_tax * 10 AS DOUBLE) AS wt_trip
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""

VIEWS["fx_lookup"] = "SELECT n_nationkey AS tpusb, CAST(1 + n_regionkey AS INT) AS db26 FROM nation"

VIEWS["fx_joined"] = """
SELECT t.*, m.b1, m.b2, m.e_status, h.a3, h.b15, h.car_availability_raw,
       lo.db26 AS origin_db26, ld.db26 AS dest_db26
FROM fx_tp t
LEFT JOIN fx_hm m ON t.q_no = m.q_no AND t.mem = m.mem
LEFT JOIN (SELECT q_no, a3, b15,
                  CASE WHEN COALESCE(c1,0) + COALESCE(c2,0) <= 0 THEN 0
                       WHEN COALESCE(c1,0) + COALESCE(c2,0) = 1 THEN 1 ELSE 2 END AS car_availability_raw
           FROM fx_hh) h ON t.q_no = h.q_no
LEFT JOIN (SELECT DISTINCT tpusb, db26 FROM fx_lookup) lo ON t.d5 = lo.tpusb
LEFT JOIN (SELECT DISTINCT tpusb, db26 FROM fx_lookup) ld ON t.d6 = ld.tpusb"""

VIEWS["fx_unified"] = """
SELECT CAST(survey_year AS STRING) || '_' || CAST(q_no AS STRING) || '_' || CAST(mem AS STRING) || '_' || CAST(trip_no AS STRING) AS case_id,
       CAST(q_no AS STRING) AS household_id,
       CAST(q_no AS STRING) || '_' || CAST(mem AS STRING) AS person_id,
       trip_no, survey_year,
       COALESCE(a3, -1) AS hh_size,
       COALESCE(car_availability_raw, 0) AS car_availability,
       CASE WHEN b2 IS NULL OR b2 < 0 OR b2 >= 120 THEN -1 WHEN b2 < 15 THEN 1 WHEN b2 < 25 THEN 2
            WHEN b2 < 45 THEN 3 WHEN b2 < 65 THEN 4 ELSE 5 END AS age_group,
       CASE WHEN b1 IN (1, 2) THEN b1 ELSE -1 END AS sex,
       CASE e_status WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 ELSE 7 END AS employment_status,
       CASE WHEN survey_year = 2022 OR b15 IS NULL OR b15 = 97 OR b15 > 19 THEN 0
            WHEN b15 <= 3 THEN 1 WHEN b15 <= 5 THEN 2 WHEN b15 <= 9 THEN 3 WHEN b15 <= 13 THEN 4 ELSE 5 END AS income_group,
       CASE pur WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 1 ELSE 7 END AS trip_purpose,
       CASE WHEN tiper BETWEEN 1 AND 4 THEN tiper ELSE -1 END AS departure_period,
       joutm AS journey_time,
       CAST(COALESCE(origin_db26, 0) AS STRING) AS origin_zone,
       CAST(COALESCE(dest_db26, 0) AS STRING) AS destination_zone,
       CASE WHEN mode_raw BETWEEN 1 AND 9 THEN mode_raw ELSE -1 END AS main_mode,
       COALESCE(wt_trip, 1.0) AS trip_weight,
       CASE WHEN survey_year = 2011 THEN CAST(COALESCE(mode_raw, -1) AS STRING) END AS raw_mode_2011,
       CASE WHEN survey_year = 2011 THEN CAST(COALESCE(pur, -1) AS STRING) END AS raw_purpose_2011
FROM fx_joined"""

VIEWS["fx_clean"] = """
SELECT * FROM fx_unified
WHERE main_mode >= 1 AND trip_purpose >= 1 AND age_group >= 1
  AND (journey_time IS NULL OR journey_time <= 240)"""

VIEWS["fx_pred"] = """
SELECT c.*, CAST(CASE WHEN h % 41 = 0 THEN -1 WHEN h % 3 = 0 THEN main_mode ELSE 1 + h % 9 END AS INT) AS predicted_mode
FROM (SELECT *, CAST(household_id AS BIGINT) * 7 + trip_no * 13 + main_mode AS h FROM fx_clean WHERE survey_year = 2022) c"""

VIEWS["fx_valid"] = "SELECT * FROM fx_pred WHERE COALESCE(predicted_mode, -1) >= 1"

VIEWS["fx_grid"] = """
SELECT m.model, r.fewshot_ratio, s.seed, 17 * m.i + 29 * r.j + s.seed AS shift, 3 + m.i + r.j AS skill
FROM (VALUES ('mnl', 1), ('boosted_trees', 2), ('retrieval', 3)) m(model, i)
CROSS JOIN (SELECT CAST(x AS DOUBLE) AS fewshot_ratio, j FROM (VALUES (0.01, 1), (0.05, 2), (0.10, 3)) v(x, j)) r
CROSS JOIN (VALUES (42), (123), (456)) s(seed)"""

VIEWS["fx_runs"] = """
SELECT g.model, g.fewshot_ratio, g.seed, p.* EXCLUDE (h, predicted_mode),
       CAST(CASE WHEN (p.h + g.shift) % 41 = 0 THEN -1 WHEN (p.h + g.shift) % 10 < g.skill THEN main_mode
            ELSE 1 + (p.h + g.shift) % 9 END AS INT) AS predicted_mode
FROM fx_pred p CROSS JOIN fx_grid g"""

VIEWS["fx_runs_valid"] = "SELECT * FROM fx_runs WHERE predicted_mode >= 1"

VIEWS["fx_responses"] = """
SELECT case_id, main_mode,
  CASE trip_no % 10
    WHEN 0 THEN '{"predicted_mode": ' || CAST(main_mode AS STRING) || ', "confidence": 0.8, "reasoning_brief": "ok"}'
    WHEN 1 THEN 'Sure: {"predicted_mode": 6, "confidence": 0.4} done'
    WHEN 2 THEN '{"predicted_mode": "3 (Tram)", "confidence": "high"}'
    WHEN 3 THEN '{"predicted_mode": 42}'
    WHEN 4 THEN '{"predicted_mode": 42, "mode_code": 8}'
    WHEN 5 THEN '   '
    WHEN 6 THEN 'no json here'
    WHEN 7 THEN '{"mode": 2, "probability": 0.3, "reason": "alias"}'
    WHEN 8 THEN '{"main_mode": 1, "confidence": 1.7}'
    ELSE '{"predicted_mode": null}' END AS raw_response
FROM fx_clean WHERE survey_year = 2022"""

# Domain of the modes, and scores per run in their textbook form.
VIEWS["fx_modes"] = """
SELECT * FROM (VALUES (1, 'Rail'), (2, 'LRT'), (3, 'Tram'), (4, 'Ferry'), (5, 'PLB'), (6, 'Bus'),
                      (7, 'Private Vehicle'), (8, 'Taxi'), (9, 'SPB')) v(mode, mode_label)"""

VIEWS["run_labels"] = """
SELECT DISTINCT model, fewshot_ratio, seed, main_mode AS label FROM fx_runs_valid
UNION SELECT DISTINCT model, fewshot_ratio, seed, predicted_mode FROM fx_runs_valid"""

VIEWS["run_classes"] = """
SELECT l.model, l.fewshot_ratio, l.seed, l.label,
       count(*) FILTER (WHERE p.main_mode = l.label) AS support,
       count(*) FILTER (WHERE p.predicted_mode = l.label) AS predicted,
       count(*) FILTER (WHERE p.main_mode = l.label AND p.predicted_mode = l.label) AS hits
FROM run_labels l JOIN fx_runs_valid p USING (model, fewshot_ratio, seed)
GROUP BY ALL"""

VIEWS["run_micro"] = """
SELECT model, fewshot_ratio, seed, sum(hits) / sum(support) AS accuracy,
       avg(2.0 * hits / (support + predicted)) AS macro_f1,
       sum(support * (2.0 * hits / (support + predicted))) / sum(support) AS weighted_f1
FROM run_classes GROUP BY ALL"""

VIEWS["run_shares"] = """
SELECT r.model, r.fewshot_ratio, r.seed, m.mode,
       COALESCE(sum(p.trip_weight) FILTER (WHERE p.main_mode = m.mode), 0) / sum(p.trip_weight) AS t,
       count(*) FILTER (WHERE p.predicted_mode = m.mode) / count(*) AS p
FROM fx_grid r CROSS JOIN fx_modes m JOIN fx_runs_valid p USING (model, fewshot_ratio, seed)
GROUP BY ALL"""

VIEWS["run_macro"] = """
SELECT model, fewshot_ratio, seed, avg(abs(t - p)) AS mode_share_mae,
       sqrt((sum(a * ln(2 * a / (a + b))) + sum(b * ln(2 * b / (a + b)))) / 2) AS mode_share_js
FROM (SELECT *, (t + 1e-10) / sum(t + 1e-10) OVER w AS a, (p + 1e-10) / sum(p + 1e-10) OVER w AS b
      FROM run_shares WINDOW w AS (PARTITION BY model, fewshot_ratio, seed))
GROUP BY ALL"""

VIEWS["run_metrics"] = """
SELECT * FROM run_micro JOIN run_macro USING (model, fewshot_ratio, seed)"""

# Encoded trips: raw features, their parameters on the first survey, scaled and unit vectors.
FEATURES = ["car_availability", "age_group", "employment_status", "trip_purpose",
            "origin_zone_int", "dest_zone_int", "sex", "departure_period"]
_NUMBERS = range(1, 9)

VIEWS["fx_raw_features"] = """
SELECT *, greatest(car_availability, 0) AS x1, greatest(age_group, 0) AS x2, greatest(employment_status, 0) AS x3,
       greatest(trip_purpose, 0) AS x4, CAST(origin_zone AS INT) AS x5, CAST(destination_zone AS INT) AS x6,
       greatest(sex, 0) AS x7, greatest(departure_period, 0) AS x8
FROM fx_clean"""

VIEWS["fx_params"] = "SELECT " + ", ".join(
    f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in _NUMBERS
) + " FROM fx_raw_features WHERE survey_year = 2011"

VIEWS["fx_scaled"] = "SELECT f.*, " + ", ".join(
    f"(x{i} - m{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END AS z{i}" for i in _NUMBERS
) + " FROM fx_raw_features f CROSS JOIN fx_params"

_LENGTH = "sqrt(" + " + ".join(f"z{i} * z{i}" for i in _NUMBERS) + ")"
VIEWS["fx_unit"] = "SELECT *, " + ", ".join(
    f"z{i} / CASE WHEN len = 0 THEN 1 ELSE len END AS u{i}" for i in _NUMBERS
) + f" FROM (SELECT *, {_LENGTH} AS len FROM fx_scaled)"

VIEWS["fx_split"] = """
SELECT c.* EXCLUDE (rn, n, in_test, rn2, n2),
       CASE WHEN in_test THEN 'test' WHEN rn2 <= greatest(1, floor(n2 * CAST(0.05 AS DOUBLE))) THEN 'few_shot' ELSE 'pool' END AS split
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY main_mode, in_test ORDER BY md5(case_id || ':43'), case_id) AS rn2,
             count(*) OVER (PARTITION BY main_mode, in_test) AS n2
      FROM (SELECT *, rn <= greatest(1, floor(n * CAST(0.2 AS DOUBLE))) AS in_test
            FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY main_mode ORDER BY md5(case_id || ':42'), case_id) AS rn,
                         count(*) OVER (PARTITION BY main_mode) AS n
                  FROM fx_clean WHERE survey_year = 2022))) c"""

_DOT = " + ".join(f"q.u{i} * c.u{i}" for i in _NUMBERS)


def _neighbours(corpus: str, offset: float, k: int) -> str:
    """Brute force: every test trip against every stored trip."""
    return f"""
SELECT query_id, CAST(pos AS INT) AS rank, best[pos]['c'] AS case_id, -best[pos]['s'] AS score
FROM (SELECT q.case_id AS query_id,
             min({{'s': -round(CAST(0.5 AS DOUBLE) * round({_DOT}, 10) + CAST({offset} AS DOUBLE), 12), 'c': c.case_id}}, {k}) AS best
      FROM (SELECT u.* FROM fx_unit u JOIN fx_split s USING (case_id) WHERE s.split = 'test') q
      CROSS JOIN ({corpus}) c GROUP BY q.case_id),
     LATERAL unnest(range(1, len(best) + 1)) AS r(pos)"""


VIEWS["fx_hist_neighbours"] = _neighbours("SELECT * FROM fx_unit WHERE survey_year = 2011", 0.35, 4)
VIEWS["fx_few_neighbours"] = _neighbours(
    "SELECT u.* FROM fx_unit u JOIN fx_split s USING (case_id) WHERE s.split = 'few_shot'", 0.5, 8)


def with_views(sql: str) -> str:
    """The query with the views it uses, directly or through others, as common table expressions."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(VIEWS[name])

    visit(sql)
    if not used:
        return sql.strip()
    texts = [sql, *(VIEWS[name] for name in used)]
    # What several parts read is computed once.
    shared = {name for name in used if sum(len(re.findall(rf"\b{name}\b", t)) for t in texts) > 1}
    ctes = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in shared else ''}({VIEWS[name].strip()})" for name in VIEWS if name in used)
    return f"WITH {ctes}\n{sql.strip()}"
