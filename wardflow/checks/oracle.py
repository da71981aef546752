"""Independent DuckDB SQL for every registered query.

Each statement starts from the driver tables (pre-registered views) and
re-states the star mapping of FIXTURES.md §2 as CTEs, then answers the
report the way the dashboard's SQL does — including the naive many-to-many
joins of the fan-out reports, so the eager-aggregation rewrite is checked
against the original semantics rather than against itself.
"""

from __future__ import annotations


def rd(expr: str, places: int) -> str:
    """Decimal half-away-from-zero rounding returned as DOUBLE."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,10)), {places}) AS DOUBLE)"


def rate(flag: str, places: int = 2) -> str:
    hits = f"COUNT(CASE WHEN {flag} THEN 1 END)"
    return rd(f"CAST({hits} AS DOUBLE) * 100.0 / CAST(COUNT(*) AS DOUBLE)", places)


def _code(prefix: str, key: str) -> str:
    return f"'{prefix}' || CASE WHEN {key} < 9 THEN '0' ELSE '' END || CAST({key} + 1 AS VARCHAR)"


STAR = f"""
WITH
dim_region AS (
    SELECT {_code('R', 'r_regionkey')} AS region_id, r_name AS region_name FROM region),
dim_hospital AS (
    SELECT {_code('H', 'n_nationkey')} AS hospital_id,
           n_name AS hospital_name,
           {_code('R', 'n_regionkey')} AS region_id,
           CASE n_nationkey % 4 WHEN 0 THEN 'Independent / Private'
                                WHEN 1 THEN 'NHS Trust'
                                ELSE 'NHS Foundation Trust' END AS nhs_trust_type,
           n_nationkey % 4 = 0 AS private,
           'CITY_' || CAST(n_nationkey AS VARCHAR) AS city,
           'MODERATE' AS staffing_stress,
           100 + 10 * n_nationkey AS total_beds
    FROM nation),
dim_department AS (
    SELECT DISTINCT 'D_' || p_type AS department_id, p_type AS department_name FROM part),
dim_date AS (
    SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key,
           CAST(d AS DATE) AS full_date, dayname(d) AS day_of_week, isodow(d) AS day_number
    FROM (SELECT unnest(range(make_timestamp(lo, 1, 1, 0, 0, 0), make_timestamp(hi + 1, 1, 1, 0, 0, 0), INTERVAL 1 DAY)) AS d
          FROM (SELECT LEAST(MIN(year(l_shipdate)), (SELECT MIN(year(o_orderdate)) FROM orders)) AS lo,
                       GREATEST(MAX(year(l_shipdate)), (SELECT MAX(year(o_orderdate)) FROM orders)) AS hi FROM lineitem))),
dim_patient AS (SELECT c_custkey AS patient_id FROM customer),
dim_doctor AS (
    SELECT s_suppkey AS doctor_id, {_code('H', 's_nationkey')} AS primary_hospital_id FROM supplier),
dim_diagnosis AS (SELECT DISTINCT p_brand AS diagnosis_id FROM part),
fact_patient_visits AS (
    SELECT l.l_orderkey * 10 + l.l_linenumber AS visit_id,
           o.o_custkey AS patient_id,
           l.l_suppkey AS doctor_id,
           p.p_brand AS diagnosis_category,
           {_code('H', 's.s_nationkey')} AS hospital_id,
           'D_' || p.p_type AS department_id,
           CAST(l.l_shipdate AS TIMESTAMP)
               + to_hours(CAST((l.l_orderkey * 7 + l.l_linenumber) % 24 AS BIGINT)) AS arrival_datetime,
           month(l.l_shipdate) AS month,
           CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS severity_level,
           CASE l.l_linestatus WHEN 'O' THEN 'Emergency' WHEN 'F' THEN 'Elective' END AS admission_type,
           CASE l.l_returnflag WHEN 'R' THEN 'Readmitted' WHEN 'A' THEN 'Discharged'
                               WHEN 'N' THEN 'Transfer' END AS outcome,
           l.l_returnflag = 'R' AND l.l_linestatus = 'O' AS readmission_30_days_flag,
           l.l_linenumber = 7 AS icu_required_flag,
           l.l_quantity * 2 AS wait_time_minutes,
           100 - l.l_quantity AS satisfaction_score
    FROM lineitem l
    JOIN supplier s ON s.s_suppkey = l.l_suppkey
    JOIN part p ON p.p_partkey = l.l_partkey
    JOIN orders o ON o.o_orderkey = l.l_orderkey),
fact_staffing AS (
    SELECT o.o_orderkey AS shift_id,
           {_code('H', 'c.c_nationkey')} AS hospital_id,
           CAST(NULL AS VARCHAR) AS department_id,
           CAST(o.o_orderdate AS DATE) AS shift_date,
           month(o.o_orderdate) AS month,
           o.o_custkey % 6 AS staff_absence_count,
           CAST(o.o_orderkey % 121 AS DOUBLE) / 10.0 AS overtime_hours,
           CAST(500 + o.o_orderkey % 200 AS DOUBLE) / 1000.0 AS burnout_risk_index
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
fact_financials AS (
    SELECT {_code('H', 'c_nationkey')} || '-' || CAST(y AS VARCHAR) || '-' || lpad(CAST(m AS VARCHAR), 2, '0')
               AS financial_record_id,
           {_code('H', 'c_nationkey')} AS hospital_id, y AS year, m AS month,
           revenue,
           CAST(revenue * 0.04 AS DECIMAL(18,2)) AS staffing_cost,
           CAST(revenue * 0.68 AS DECIMAL(18,2)) AS operational_cost,
           CAST(revenue * 0.05 AS DECIMAL(18,2)) AS icu_cost,
           n AS visit_count,
           CAST((c_nationkey * 7 + m) % 30 AS DOUBLE) / 100.0 AS profit_margin,
           CAST(14 + c_nationkey % 6 AS DOUBLE) / 100.0 AS readmission_rate,
           CAST(580 + (c_nationkey % 8) * 10 AS DOUBLE) / 1000.0 AS avg_burnout_index
    FROM (SELECT c.c_nationkey, year(o.o_orderdate) AS y, month(o.o_orderdate) AS m,
                 CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS revenue,
                 COUNT(*) AS n
          FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
          GROUP BY c.c_nationkey, year(o.o_orderdate), month(o.o_orderdate)))
"""


def _p(body: str, ctes: str = "") -> tuple[str, str]:
    return (ctes, body)


def q(body: str, ctes: str = "") -> str:
    extra = f",\n{ctes}\n" if ctes else "\n"
    return STAR.rstrip() + extra + body


V_H = "fact_patient_visits v JOIN dim_hospital h ON v.hospital_id = h.hospital_id"
S_H = "fact_staffing s JOIN dim_hospital h ON s.hospital_id = h.hospital_id"
F_H = "fact_financials f JOIN dim_hospital h ON f.hospital_id = h.hospital_id"

#: Predicate on ``month`` of each period of the year.
PERIODS = {"year": "true", "H1": "month <= 6", "H2": "month > 6"}


def share(flag: str, when: str) -> str:
    """Percentage of the rows of a period that carry ``flag``."""
    hits, every = (f"COUNT(*) FILTER (WHERE {x})" for x in (f"({flag}) AND {when}", when))
    return rd(f"CAST({hits} AS DOUBLE) * 100.0 / CAST(NULLIF({every}, 0) AS DOUBLE)", 2)


def mean_of(column: str, places: int, when: str) -> str:
    return rd(f"AVG({column}) FILTER (WHERE {when})", places)


def figures(*periods: str) -> str:
    """CTEs ``of_visits`` and ``of_shifts``: a row per hospital, its figures named by period."""
    of_visits, of_shifts = [], []
    for name in periods:
        when = PERIODS[name]
        of_visits += [f"COUNT(*) FILTER (WHERE {when}) AS n_{name}",
                      f"{share('readmission_30_days_flag', when)} AS back_{name}",
                      f"{mean_of('wait_time_minutes', 1, when)} AS wait_{name}",
                      f"{mean_of('satisfaction_score', 1, when)} AS content_{name}"]
        of_shifts += [f"COUNT(*) FILTER (WHERE {when}) AS m_{name}",
                      f"{mean_of('burnout_risk_index', 3, when)} AS strain_{name}"]
    return ",\n".join(
        f"{cte} AS (SELECT hospital_id, {', '.join(columns)} FROM {fact} GROUP BY hospital_id)"
        for cte, fact, columns in (("of_visits", "fact_patient_visits", of_visits),
                                   ("of_shifts", "fact_staffing", of_shifts)))


def _outliers(period: str) -> tuple[str, str]:
    zero = {"readmission_rate": "back", "avg_wait_time": "wait", "avg_satisfaction": "content",
            "avg_burnout_index": "strain"}
    measures = ", ".join(f"COALESCE({c}_{period}, 0.0) AS {name}" for name, c in zero.items())
    return _p(f"""SELECT hospital_id, hospital_name, nhs_trust_type, city, staffing_stress,
       CAST(COALESCE(n_{period}, 0) AS BIGINT) AS total_visits, {measures}
FROM dim_hospital LEFT JOIN of_visits USING (hospital_id) LEFT JOIN of_shifts USING (hospital_id)""",
              figures(period))


SANKEY_CTES = f"""links AS (
    SELECT v.hospital_id, v.admission_type AS source_node,
           'Severity ' || CAST(v.severity_level AS VARCHAR) AS target_node, COUNT(*) AS value
    FROM {V_H} GROUP BY v.hospital_id, v.admission_type, v.severity_level
    UNION ALL
    SELECT v.hospital_id, 'Severity ' || CAST(v.severity_level AS VARCHAR) AS source_node,
           v.outcome AS target_node, COUNT(*) AS value
    FROM {V_H} GROUP BY v.hospital_id, v.severity_level, v.outcome),
nodes AS (
    SELECT hospital_id, name,
           ROW_NUMBER() OVER (PARTITION BY hospital_id ORDER BY name) - 1 AS node_index
    FROM (SELECT hospital_id, source_node AS name FROM links
          UNION SELECT hospital_id, target_node AS name FROM links))"""

RADAR_AXES_SQL = """axes AS (SELECT * FROM (VALUES
    (1, 'Wait Time (min)'), (2, 'Satisfaction (%)'), (3, 'Burnout Index'),
    (4, 'Readmissions (%)'), (5, 'Profit Margin (%)'), (6, 'ICU Admits (%)')) t(axis, subject))"""

#: The product of the three facts by hospital and month, then each sector's six figures in axis order.
SECTORS = f"""product AS (
    SELECT hospital_id, wait_time_minutes, satisfaction_score, burnout_risk_index, profit_margin,
           readmission_30_days_flag, icu_required_flag
    FROM fact_patient_visits
    LEFT JOIN (SELECT hospital_id, month, burnout_risk_index FROM fact_staffing) USING (hospital_id, month)
    LEFT JOIN (SELECT hospital_id, month, profit_margin FROM fact_financials) USING (hospital_id, month)),
sectors AS (
    SELECT private, [{rd('AVG(wait_time_minutes)', 1)}, {rd('AVG(satisfaction_score)', 1)},
                     {rd('AVG(burnout_risk_index)', 3)}, {rate('readmission_30_days_flag')},
                     {rd('AVG(profit_margin) * 100.0', 1)}, {rate('icu_required_flag')}] AS figures
    FROM dim_hospital LEFT JOIN product USING (hospital_id) GROUP BY private)"""

ALERT_INPUTS = f"""a AS (
    SELECT h.hospital_id, h.hospital_name,
           {rd('AVG(f.avg_burnout_index)', 3)} AS avg_burnout,
           {rd('AVG(f.profit_margin) * 100.0', 1)} AS avg_profit_margin,
           {rd('AVG(f.readmission_rate) * 100.0', 1)} AS avg_readmit_rate
    FROM dim_hospital h JOIN fact_financials f ON h.hospital_id = f.hospital_id
    GROUP BY h.hospital_id, h.hospital_name)"""

FULL_YEAR = figures("year") + """,
full_year AS (
    SELECT hospital_id, hospital_name, CAST(n_year AS BIGINT) AS total_visits,
           back_year AS readmission_rate_pct, strain_year AS avg_burnout_index,
           back_year > 11.0 AS violates_readmission, strain_year > 0.60 AS violates_burnout,
           back_year > 11.0 AND strain_year > 0.60 AS violates_both
    FROM of_visits JOIN of_shifts USING (hospital_id) JOIN dim_hospital USING (hospital_id))"""

# a hospital counts that has visits and shifts in both halves
HALVES = figures("H1", "H2") + f""",
shift AS (
    SELECT hospital_id, hospital_name, back_H1 AS h1_readmission_rate, back_H2 AS h2_readmission_rate,
           strain_H1 AS h1_burnout, strain_H2 AS h2_burnout,
           {rd('back_H2 - back_H1', 2)} AS readmission_delta, {rd('strain_H2 - strain_H1', 3)} AS burnout_delta
    FROM of_visits JOIN of_shifts USING (hospital_id) JOIN dim_hospital USING (hospital_id)
    WHERE LEAST(n_H1, n_H2, m_H1, m_H2) > 0)"""


def _alert(kind: str, severity: str, value: str, message: str, where: str) -> str:
    return (f"SELECT hospital_id, hospital_name, '{kind}' AS type, '{severity}' AS severity, "
            f"{value} AS value, {message} AS message FROM a WHERE {where}")


def _txt(c: str) -> str:
    return f"COALESCE(CAST({c} AS VARCHAR), 'None')"


#: Alert texts around the hospital's name and the tested figure.
ALERT_NAME = "COALESCE(hospital_name, 'None')"


def _alerts_sql() -> str:
    squeeze = "avg_profit_margin <> 0 AND avg_profit_margin < 15.0"
    margin = f"'Sustainability Alert: ' || {ALERT_NAME} || ' profit margin sits at ' || {_txt('avg_profit_margin')}"
    return "\nUNION ALL\n".join([
        _alert("CRITICAL_BURNOUT", "CRITICAL", "avg_burnout",
               f"'Action Required: ' || {ALERT_NAME} || ' staffing burnout index has reached ' || {_txt('avg_burnout')} "
               "|| ', crossing the 0.630 safety limit.'", "avg_burnout <> 0 AND avg_burnout > 0.63"),
        _alert("STAFFING_STRESS", "WARNING", "avg_burnout",
               f"'Staffing Alert: ' || {ALERT_NAME} || ' staffing stress has reached HIGH due to long wait times "
               "and rising clinician fatigue.'", "hospital_id = 'H03'"),
        _alert("STAFFING_STRESS", "WARNING", "avg_burnout",
               f"'Staffing Alert: ' || {ALERT_NAME} || ' staffing stress index sits at ' || {_txt('avg_burnout')} "
               "|| ', crossing target limits.'", "hospital_id = 'H07'"),
        _alert("FINANCIAL_SQUEEZE", "WARNING", "avg_profit_margin",
               margin + " || '%, violating the 15.0% board sustainability floor.'", squeeze),
        _alert("FINANCIAL_SQUEEZE", "WARNING", "avg_profit_margin",
               margin + " || '%, violating the 16.0% board sustainability floor.'",
               f"NOT ({squeeze}) AND hospital_id = 'H03' AND avg_profit_margin <> 0 AND avg_profit_margin < 16.0"),
        _alert("READMISSION_SPIKE", "WARNING", "avg_readmit_rate",
               f"'Readmission Alert: ' || {ALERT_NAME} || ' 30-day readmission rate sits at ' "
               f"|| {_txt('avg_readmit_rate')} || '%, exceeding the 11.0% NHS ceiling.'",
               "avg_readmit_rate <> 0 AND avg_readmit_rate > 18.0"),
    ])


def report_parts() -> dict[str, tuple[str, str]]:
    """(extra CTEs, final SELECT) per report, before the star prefix."""
    return {
        "overview_kpis": _p(f"""SELECT CAST(COUNT(*) AS BIGINT) AS total_visits,
       CASE WHEN COUNT(*) = 0 THEN CAST(0.0 AS DOUBLE) ELSE {rate('v.readmission_30_days_flag')} END
           AS readmission_rate,
       CASE WHEN COUNT(*) = 0 THEN CAST(0.0 AS DOUBLE) ELSE {rd('AVG(v.wait_time_minutes)', 1)} END
           AS avg_wait_time,
       CASE WHEN COUNT(*) = 0 THEN CAST(0.0 AS DOUBLE) ELSE
           (SELECT {rd('AVG(s.burnout_risk_index)', 3)} FROM {S_H}) END AS avg_burnout_index
FROM {V_H}"""),
        "visits_over_time": _p(f"""SELECT strftime(v.arrival_datetime, '%Y-%m') AS month,
       CAST(COUNT(*) AS BIGINT) AS visits
FROM {V_H} GROUP BY strftime(v.arrival_datetime, '%Y-%m')"""),
        "visits_by_department": _p(f"""SELECT h.hospital_name, d.department_name,
       CAST(COUNT(v.visit_id) AS BIGINT) AS visits
FROM {V_H} JOIN dim_department d ON v.department_id = d.department_id
GROUP BY h.hospital_name, d.department_name"""),
        "daily_heatmap": _p(f"""SELECT CAST(CAST(v.arrival_datetime AS DATE) AS VARCHAR) AS date,
       CAST(COUNT(*) AS BIGINT) AS count
FROM {V_H} GROUP BY CAST(v.arrival_datetime AS DATE)"""),
        "hourly_arrivals": _p(f"""SELECT CAST(hour(v.arrival_datetime) AS BIGINT) AS hour,
       CAST(COUNT(*) AS BIGINT) AS count
FROM {V_H} GROUP BY hour(v.arrival_datetime)"""),
        "hospital_outliers": _outliers("year"),
        "hospital_outliers_h1": _outliers("H1"),
        "hospital_outliers_h2": _outliers("H2"),
        "bump_rankings": _p(f"""SELECT CAST(month AS BIGINT) AS month, hospital_id, hospital_name, back AS readmission_rate,
       CAST(DENSE_RANK() OVER in_month AS BIGINT) AS rank
FROM dim_hospital JOIN (SELECT hospital_id, month, {rate('readmission_30_days_flag')} AS back
                        FROM fact_patient_visits GROUP BY ALL) USING (hospital_id)
WINDOW in_month AS (PARTITION BY month ORDER BY back DESC NULLS FIRST)"""),
        "sankey_links": _p("""SELECT l.hospital_id, l.source_node, l.target_node,
       CAST(s.node_index AS BIGINT) AS source, CAST(t.node_index AS BIGINT) AS target,
       CAST(l.value AS BIGINT) AS value
FROM links l
JOIN nodes s ON s.hospital_id = l.hospital_id AND s.name = l.source_node
JOIN nodes t ON t.hospital_id = l.hospital_id AND t.name = l.target_node""", SANKEY_CTES),
        "sankey_nodes": _p("""SELECT hospital_id, CAST(node_index AS BIGINT) AS node_index, name
FROM nodes""", SANKEY_CTES),
        "sankey_dropped": _p(f"""SELECT v.hospital_id,
       CAST(COUNT(*) FILTER (WHERE v.admission_type IS NULL OR v.severity_level IS NULL) AS BIGINT)
           AS dropped_admission_links,
       CAST(COUNT(*) FILTER (WHERE v.severity_level IS NULL OR v.outcome IS NULL) AS BIGINT)
           AS dropped_outcome_links
FROM {V_H} GROUP BY v.hospital_id"""),
        "severity_weekday_wait": _p(f"""SELECT v.hospital_id, CAST(v.severity_level AS BIGINT) AS severity,
       d.day_of_week AS weekday, CAST(d.day_number AS BIGINT) AS day_num,
       {rd('AVG(v.wait_time_minutes)', 1)} AS avg_wait
FROM {V_H} JOIN dim_date d ON CAST(v.arrival_datetime AS DATE) = d.full_date
GROUP BY v.hospital_id, v.severity_level, d.day_of_week, d.day_number"""),
        "radar_profiles": _p("""SELECT CAST(axis AS BIGINT) AS axis, subject,
       CASE WHEN n.private IS NULL THEN 0.0::DOUBLE ELSE n.figures[axis] END AS NHS,
       CASE WHEN p.private IS NULL THEN 0.0::DOUBLE ELSE p.figures[axis] END AS Private
FROM axes LEFT JOIN sectors n ON n.private = false LEFT JOIN sectors p ON p.private = true""",
                             SECTORS + ",\n" + RADAR_AXES_SQL),
        "diverging_wait": _p(f"""SELECT h.hospital_id, h.hospital_name, h.nhs_trust_type, h.private,
       {rd('AVG(v.wait_time_minutes)', 1)} AS avg_wait_time,
       {rd('AVG(v.wait_time_minutes) - 61.4', 1)} AS divergence
FROM dim_hospital h LEFT JOIN fact_patient_visits v ON h.hospital_id = v.hospital_id
GROUP BY h.hospital_id, h.hospital_name, h.nhs_trust_type, h.private"""),
        "regional_choropleth": _p(f"""SELECT region_id, region_name, {rate('readmission_30_days_flag')} AS readmission_rate,
       {rd('AVG(wait_time_minutes)', 1)} AS avg_wait_time, {rd('AVG(burnout_risk_index)', 3)} AS avg_burnout
FROM dim_region JOIN dim_hospital USING (region_id) LEFT JOIN worked USING (hospital_id)
GROUP BY ALL""", """worked AS (
    SELECT hospital_id, readmission_30_days_flag, wait_time_minutes, burnout_risk_index
    FROM fact_patient_visits
    LEFT JOIN (SELECT hospital_id, month, burnout_risk_index FROM fact_staffing) USING (hospital_id, month))"""),
        "burnout_financials": _p(f"""SELECT h.hospital_id, h.hospital_name,
       {rd('AVG(f.avg_burnout_index)', 3)} AS avg_burnout,
       {rd('AVG(f.profit_margin) * 100.0', 2)} AS profit_margin_pct,
       CAST(SUM(f.revenue) AS DOUBLE) AS revenue,
       CAST(SUM(f.operational_cost) AS DOUBLE) AS operational_cost,
       CAST(SUM(f.visit_count) AS BIGINT) AS visit_count
FROM {F_H} GROUP BY h.hospital_id, h.hospital_name"""),
        "financial_waterfall": _p("""SELECT * FROM (
    SELECT CAST(1 AS BIGINT) AS stage, 'Total Revenue' AS name, revenue AS value FROM t
    UNION ALL SELECT 2, 'Base Staffing Costs', -staffing_cost FROM t
    UNION ALL SELECT 3, 'General Ops Costs', -operational_cost FROM t
    UNION ALL SELECT 4, 'ICU Department Costs', -icu_cost FROM t
    UNION ALL SELECT 5, 'Net Profit Margin', revenue - staffing_cost - operational_cost - icu_cost FROM t)
WHERE (SELECT revenue FROM t) IS NOT NULL""", f"""t AS (
    SELECT CAST(SUM(f.revenue) AS DOUBLE) AS revenue,
           CAST(SUM(f.staffing_cost) AS DOUBLE) AS staffing_cost,
           CAST(SUM(f.operational_cost) AS DOUBLE) AS operational_cost,
           CAST(SUM(f.icu_cost) AS DOUBLE) AS icu_cost
    FROM {F_H})"""),
        "absences_overtime": _p(f"""SELECT CAST(s.month AS BIGINT) AS month,
       CAST(SUM(s.staff_absence_count) AS BIGINT) AS absences,
       {rd('AVG(s.overtime_hours)', 1)} AS overtime_hours
FROM {S_H} GROUP BY s.month"""),
        "burnout_by_month": _p(f"""SELECT h.hospital_id, h.hospital_name, CAST(s.month AS BIGINT) AS month,
       {rd('AVG(s.burnout_risk_index)', 3)} AS burnout
FROM {S_H} GROUP BY h.hospital_id, h.hospital_name, s.month"""),
        "cfo_alerts": _p(_alerts_sql(), ALERT_INPUTS),
        "threshold_flags": _p("SELECT * FROM full_year", FULL_YEAR),
        "sql_threshold_flags": _p("SELECT * FROM full_year", FULL_YEAR),
        "half_year_shift": _p("SELECT * FROM shift", HALVES),
        "double_violators": _p("""SELECT 'H1' AS period, hospital_id, hospital_name,
       h1_readmission_rate AS readmission_rate, h1_burnout AS burnout
FROM shift WHERE h1_readmission_rate > 11.0 AND h1_burnout > 0.60
UNION ALL
SELECT 'H2' AS period, hospital_id, hospital_name,
       h2_readmission_rate AS readmission_rate, h2_burnout AS burnout
FROM shift WHERE h2_readmission_rate > 11.0 AND h2_burnout > 0.60""", HALVES),
        "burnout_violators": _p("""SELECT hospital_id, hospital_name, avg_burnout_index, readmission_rate_pct,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM full_year WHERE violates_burnout) AS violator_count
FROM full_year WHERE violates_burnout""", FULL_YEAR),
    }


# Fixed values of the driver fixture used to spell out pivot columns: the
# department names (part types) and the hospital ids / names (one per nation).
FIXTURE_DEPARTMENTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
FIXTURE_HOSPITAL_IDS = [f"H{k + 1:02d}" for k in range(25)]
FIXTURE_HOSPITAL_NAMES = [f"NATION_{k}" for k in range(25)]
MONTHS_SQL = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"


def _on(base: str, alias: str = "base") -> str:
    """The CTEs of a report plus the report itself as CTE ``alias``."""
    ctes, body = report_parts()[base]
    return (ctes + ",\n" if ctes else "") + f"{alias} AS (\n{body})"


def _stress(b: str, w: str, r: str) -> str:
    return (f"(CASE WHEN {b} > 0.62 THEN 2 WHEN {b} > 0.60 THEN 1 ELSE 0 END"
            f" + CASE WHEN {w} > 90 THEN 2 WHEN {w} > 60 THEN 1 ELSE 0 END"
            f" + CASE WHEN {r} / 100.0 > 0.19 THEN 2 WHEN {r} / 100.0 > 0.15 THEN 1 ELSE 0 END)")


#: Facility-name rules in their order, without regard to case.
SHORTER_NAMES = [
    (r"\s+NHS\s+Foundation\s+Trust", ""), (r"\s+NHS\s+FT", ""), (r"\s+NHS\s+Trust", ""),
    (r"\s+University\s+Hospital", ""), (r"\s+Hospitals", ""), (r"\s+Hospital", ""), (r"\s+Infirmary", ""),
    ("Nuffield Health", "Nuffield"), ("University College London", "UCL"), ("Leeds General", "Leeds Gen"),
    ("Alder Hey Children''s", "Alder Hey Childrens"), ("Harrogate District", "Harrogate Dist"),
]


def _clean_name_sql(col: str) -> str:
    """G11 as nested replacements."""
    out = f"COALESCE({col}, '')"
    for pattern, shorter in SHORTER_NAMES:
        out = f"regexp_replace({out}, '{pattern}', '{shorter}', 'gi')"
    return f"trim({out})"


def shape_parts() -> dict[str, tuple[str, str]]:
    short = "regexp_replace(regexp_replace(regexp_replace(hospital_name, ' Hospital', ''), ' Infirmary', ''), ' NHS FT', '')"
    dept_cols = ",\n       ".join(
        f"CAST(COALESCE(SUM(CASE WHEN department_name = '{d}' THEN visits END), 0) AS BIGINT) AS \"{d}\""
        for d in FIXTURE_DEPARTMENTS)
    hosp_cols = ",\n       ".join(
        f"MAX(CASE WHEN hospital_id = '{h}' THEN readmission_rate END) AS \"{h}\""
        for h in FIXTURE_HOSPITAL_IDS)
    name_cols = ",\n       ".join(
        f"MAX(CASE WHEN hospital_name = '{n}' THEN burnout END) AS \"{n}\""
        for n in FIXTURE_HOSPITAL_NAMES)
    name_sel = ", ".join(f'p."{n}"' for n in FIXTURE_HOSPITAL_NAMES)
    families = ("CASE WHEN contains(lower(department_name), 'emergency') OR contains(lower(department_name), 'accident') THEN 'emergency' "
                "WHEN contains(lower(department_name), 'icu') OR contains(lower(department_name), 'intensive') "
                "OR contains(lower(department_name), 'critical') THEN 'critical care' "
                "WHEN contains(lower(department_name), 'pediatrics') OR contains(lower(department_name), 'child') THEN 'paediatrics' "
                "WHEN contains(lower(department_name), 'cardiology') OR contains(lower(department_name), 'heart') THEN 'cardiology' "
                "WHEN contains(lower(department_name), 'oncology') OR contains(lower(department_name), 'cancer') THEN 'oncology' "
                "WHEN contains(lower(department_name), 'general medicine') OR contains(lower(department_name), 'internal') "
                "THEN 'general medicine' "
                "ELSE 'other-' || CAST((SELECT SUM(ascii(ch)) FROM unnest(string_split(department_name, '')) AS t(ch)) % 6 "
                "AS VARCHAR) END")
    node_stats_ctes = SANKEY_CTES + """,
ends AS (
    SELECT hospital_id, source_node AS name, value AS v_out, 0 AS v_in, false AS as_outcome FROM links
    UNION ALL
    SELECT hospital_id, target_node AS name, 0 AS v_out, value AS v_in,
           starts_with(source_node, 'Severity') AS as_outcome FROM links),
node_stats AS (
    SELECT e.hospital_id, CAST(n.node_index AS BIGINT) AS node_index, e.name,
           CAST(CASE WHEN starts_with(e.name, 'Severity') THEN 1
                     WHEN bool_or(e.as_outcome) OR e.name IN
                          ('Discharged', 'Deceased', 'Readmitted', 'Transfer', 'Referred', 'AMA') THEN 2
                     ELSE 0 END AS BIGINT) AS stage,
           CAST(CASE WHEN SUM(e.v_in) + SUM(e.v_out) = 0 THEN 5 ELSE SUM(e.v_in) + SUM(e.v_out) END
                AS BIGINT) AS value,
           e.name IN ('Readmitted', 'Deceased') AS is_warning
    FROM ends e JOIN nodes n ON n.hospital_id = e.hospital_id AND n.name = e.name
    GROUP BY e.hospital_id, n.node_index, e.name)"""
    return {
        "department_pivot": _p(f"""SELECT {short} AS name, hospital_name,
       {dept_cols}
FROM base GROUP BY hospital_name""", _on("visits_by_department")),
        "department_totals": _p("""SELECT department_name, CAST(SUM(visits) AS BIGINT) AS visits
FROM base GROUP BY department_name""", _on("visits_by_department")),
        "calendar_heatmap": _p(f"""SELECT date, year, count,
       CAST(CASE WHEN count <= 2 THEN 0 WHEN count <= 6 THEN 1 WHEN count <= 11 THEN 2
                 WHEN count <= 16 THEN 3 ELSE 4 END AS BIGINT) AS band,
       CAST(rn // 7 AS BIGINT) AS week_index, CAST(rn % 7 AS BIGINT) AS day_slot,
       CASE WHEN rn % 7 = 0 AND (pm IS NULL OR pm <> m) THEN {MONTHS_SQL}[m] END AS month_label
FROM lagged""", _on("daily_heatmap") + """,
laid AS (
    SELECT date, substr(date, 1, 4) AS year, count,
           ROW_NUMBER() OVER (PARTITION BY substr(date, 1, 4) ORDER BY date) - 1 AS rn,
           CAST(substr(date, 6, 2) AS INTEGER) AS m
    FROM base),
lagged AS (SELECT *, LAG(m, 7) OVER (PARTITION BY year ORDER BY date) AS pm FROM laid)"""),
        "kpi_target_gap": _p(f"""SELECT *,
       CASE WHEN readmission_rate > 11.0 THEN {rd('readmission_rate - 11.0', 2)} END AS excess_points,
       readmission_rate <= 11.0 AS within_target
FROM base""", _on("overview_kpis")),
        "department_families": _p(f"""SELECT department_id, department_name, {families} AS family
FROM dim_department"""),
        "filter_options": _p("""SELECT 'region' AS kind, region_id AS value, COALESCE(region_name, region_id) AS label
FROM dim_region
UNION ALL
SELECT DISTINCT 'trust_type', nhs_trust_type, nhs_trust_type FROM dim_hospital WHERE nhs_trust_type IS NOT NULL
UNION ALL
SELECT 'hospital', hospital_id, COALESCE(hospital_name, hospital_id) FROM dim_hospital"""),
        "readmission_month_pivot": _p(f"""SELECT month,
       {hosp_cols}
FROM base GROUP BY month""", _on("bump_rankings")),
        "sankey_node_stats": _p("SELECT * FROM node_stats", node_stats_ctes),
        "sankey_link_shares": _p(f"""SELECT l.hospital_id, l.source_node, l.target_node,
       CAST(l.value AS BIGINT) AS value,
       {rd('CAST(l.value AS DOUBLE) / CAST(ns.value AS DOUBLE)', 6)} AS share,
       l.target_node IN ('Readmitted', 'Deceased') AS is_warning
FROM links l JOIN node_stats ns ON ns.hospital_id = l.hospital_id AND ns.name = l.source_node""",
                                node_stats_ctes),
        "severity_weekday_grid": _p("""SELECT g.hospital_id, CAST(g.severity AS BIGINT) AS severity, g.weekday,
       substr(g.weekday, 1, 3) AS day,
       CAST(g.day_num AS BIGINT) AS day_num, c.avg_wait,
       CASE WHEN c.avg_wait IS NULL OR c.avg_wait = 0 THEN 'none' WHEN c.avg_wait < 50 THEN '<50'
            WHEN c.avg_wait < 75 THEN '<75' WHEN c.avg_wait < 95 THEN '<95' ELSE '>=95' END AS wait_band,
       CASE WHEN c.avg_wait IS NOT NULL AND c.avg_wait <> 0
            THEN CAST(CAST(floor(c.avg_wait + 0.5) AS BIGINT) AS VARCHAR) || 'm' ELSE '-' END AS label
FROM grid g LEFT JOIN base c
  ON c.hospital_id = g.hospital_id AND c.severity = g.severity AND c.weekday = g.weekday""",
                                   _on("severity_weekday_wait") + """,
grid AS (
    SELECT h.hospital_id, s.severity, w.weekday, w.day_num
    FROM dim_hospital h,
         (VALUES (5), (4), (3), (2), (1)) s(severity),
         (VALUES ('Monday', 1), ('Tuesday', 2), ('Wednesday', 3), ('Thursday', 4),
                 ('Friday', 5), ('Saturday', 6), ('Sunday', 7)) w(weekday, day_num))"""),
        "scatter_focus": _p("SELECT *, COALESCE(hospital_id = 'H07', false) AS is_focus FROM base",
                            _on("burnout_financials")),
        "facility_ledger": _p(f"""SELECT hospital_id, hospital_name, nhs_trust_type, city, total_visits,
       readmission_rate, avg_wait_time, avg_satisfaction, avg_burnout_index,
       COALESCE(nhs_trust_type = 'Independent / Private', false) AS private,
       CAST({_stress('avg_burnout_index', 'avg_wait_time', 'readmission_rate')} AS BIGINT) AS stress_score,
       CASE WHEN avg_burnout_index IS NULL THEN staffing_stress
            WHEN {_stress('avg_burnout_index', 'avg_wait_time', 'readmission_rate')} >= 5 THEN 'CRITICAL'
            WHEN {_stress('avg_burnout_index', 'avg_wait_time', 'readmission_rate')} >= 3 THEN 'HIGH'
            WHEN {_stress('avg_burnout_index', 'avg_wait_time', 'readmission_rate')} >= 1 THEN 'MODERATE'
            ELSE 'LOW' END AS staffing_stress,
       CASE WHEN readmission_rate > AVG(readmission_rate) OVER () + 0.8 THEN 'high'
            WHEN readmission_rate < AVG(readmission_rate) OVER () - 0.8 THEN 'low'
            ELSE 'normal' END AS readmission_band
FROM base""", _on("hospital_outliers")),
        "diverging_bars": _p(f"""SELECT hospital_id, {_clean_name_sql('hospital_name')} AS hospital_name,
       nhs_trust_type, private, avg_wait_time, divergence
FROM base""", _on("diverging_wait")),
        "regional_alarms": _p("""SELECT *, COALESCE(readmission_rate > 17.0, false) AS alarm,
       CAST(floor(avg_wait_time + 0.5) AS BIGINT) AS wait_minutes
FROM base""", _on("regional_choropleth")),
        "sector_gap": _p("""SELECT axis, subject, NHS, Private, gap, unit, nhs_position, private_position,
       CASE WHEN gap > 0 THEN '+' || printf(fmt, abs(gap)) || ' ' || unit || ' above NHS'
            WHEN gap < 0 THEN '-' || printf(fmt, abs(gap)) || ' ' || unit || ' below NHS'
            ELSE 'No gap' END AS gap_text
FROM (
    SELECT axis, subject, NHS, Private,
           CASE WHEN places = 3 THEN """ + rd("Private - NHS", 3) + " ELSE " + rd("Private - NHS", 1) + """ END AS gap,
           unit, CASE WHEN places = 3 THEN '%.3f' ELSE '%.1f' END AS fmt,
           (NHS - lo) / (hi - lo) * 100.0 AS nhs_position,
           (Private - lo) / (hi - lo) * 100.0 AS private_position
    FROM base JOIN (VALUES ('Wait Time (min)', 'min', 1, 45.0::DOUBLE, 90.0::DOUBLE),
                           ('Satisfaction (%)', '%', 1, 62.0, 62.7), ('Burnout Index', 'index', 3, 0.588, 0.598),
                           ('Readmissions (%)', '%', 1, 16.5, 17.4), ('Profit Margin (%)', '%', 1, 20.0, 30.0),
                           ('ICU Admits (%)', '%', 1, 16.0, 17.0)) u(s, unit, places, lo, hi)
      ON u.s = base.subject)""", _on("radar_profiles")),
        "waterfall_bars": _p("""SELECT stage, name, value,
       CASE WHEN stage = 1 OR stage = (SELECT MAX(stage) FROM base) THEN 0.0
            ELSE COALESCE(SUM(value) OVER (ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)
       END AS open,
       CASE WHEN stage = 1 OR stage = (SELECT MAX(stage) FROM base) THEN value
            ELSE COALESCE(SUM(value) OVER (ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)
                 + value END AS close,
       value >= 0 AS is_positive
FROM base""", _on("financial_waterfall")),
        "burnout_month_pivot": _p(f"""SELECT m.month, {MONTHS_SQL}[m.month] AS name, {name_sel}
FROM (SELECT CAST(range AS BIGINT) AS month FROM range(1, 13)) m
LEFT JOIN (SELECT month,
       {name_cols}
    FROM base GROUP BY month) p ON p.month = m.month""", _on("burnout_by_month")),
        "burnout_hospital_list": _p("""SELECT hospital_id, hospital_name, month, burnout FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY hospital_id ORDER BY month DESC NULLS FIRST, hospital_name DESC) AS rn
    FROM base) WHERE rn = 1""", _on("burnout_by_month")),
        "alert_summary": _p("""SELECT label, string_agg(hospital_name, ', ' ORDER BY hospital_name) AS hospitals,
       CAST(COUNT(*) AS BIGINT) AS alerts
FROM (SELECT hospital_name,
             CASE type WHEN 'CRITICAL_BURNOUT' THEN 'Staffing stress'
                       WHEN 'FINANCIAL_SQUEEZE' THEN 'Financial squeeze'
                       WHEN 'READMISSION_SPIKE' THEN 'Readmission spike'
                       WHEN 'STAFFING_STRESS' THEN 'Staffing stress'
                       ELSE regexp_replace(type, '_', ' ') END AS label
      FROM base) GROUP BY label""", _on("cfo_alerts")),
        "deficit_hospitals": _p("""SELECT hospital_id, hospital_name, profit_margin_pct FROM base
WHERE profit_margin_pct < 0""", _on("burnout_financials")),
    }


def label_parts() -> dict[str, tuple[str, str]]:
    """Figures as text, places under a sort, ids as labels."""
    money = "replace(format('{:,}', CAST(round(abs(value)) AS BIGINT)), ' ', '')"
    return {
        "kpi_labels": _p("""SELECT format('{:,}', total_visits) AS total_visits, printf('%.2f', readmission_rate) || '%' AS readmission_rate,
       printf('%.1f', avg_wait_time) || ' min' AS avg_wait_time, printf('%.3f', avg_burnout_index) AS avg_burnout_index FROM base""",
                         _on("overview_kpis")),
        "waterfall_labels": _p(f"""SELECT stage, name, CASE WHEN value < 0 THEN '-' ELSE '' END || '£' || {money} AS label
FROM base""", _on("financial_waterfall")),
        "department_labels": _p("""SELECT department_id,
       CASE WHEN strpos(department_id, '_') > 0 THEN left(department_id, strpos(department_id, '_') - 1) || ' '
                 || substr(department_id, strpos(department_id, '_') + 1) ELSE department_id END AS label FROM dim_department"""),
        "ledger_places": _p("""SELECT ROW_NUMBER() OVER (ORDER BY lower(city), hospital_id) AS place, hospital_id, hospital_name, city
FROM dim_hospital"""),
    }


#: The driver star under other names (part types, nations by key modulo 7), with lower margins.
NAMED = [
    ("n_name AS hospital_name", """CASE n_nationkey % 7 WHEN 0 THEN n_name || ' University Hospital NHS Foundation Trust'
                 WHEN 1 THEN n_name || ' Royal Infirmary' WHEN 2 THEN 'Nuffield Health ' || n_name || ' Hospital'
                 WHEN 3 THEN 'Leeds General ' || n_name || ' Hospitals NHS Trust'
                 WHEN 4 THEN 'Harrogate District ' || n_name || ' hospital'
                 WHEN 5 THEN 'Alder Hey Children''s ' || n_name || ' NHS FT'
                 ELSE 'University College London ' || n_name || ' Hospital Infirmary' END AS hospital_name"""),
    ("p_type AS department_name", """CASE p_type WHEN 'ECONOMY' THEN 'Emergency Department' WHEN 'LARGE' THEN 'Intensive Care Unit'
                 WHEN 'MEDIUM' THEN 'Cardiology' WHEN 'PROMO' THEN 'Ward_7 Annex' WHEN 'SMALL' THEN 'General Medicine'
                 WHEN 'STANDARD' THEN 'Physiotherapy' ELSE p_type END AS department_name"""),
    ("% 30 AS DOUBLE) / 100.0 AS profit_margin", "% 30 AS DOUBLE) / 100.0 - 0.16 AS profit_margin"),
]
STACKED = ["Cardiology", "Emergency Department", "General Medicine", "Intensive Care Unit", "Physiotherapy", "Ward_7 Annex"]
#: Their places: the four that the business order lists, then the others by name.
PLACES = {"Emergency Department": 1, "General Medicine": 2, "Cardiology": 3, "Intensive Care Unit": 4, "Physiotherapy": 5,
          "Ward_7 Annex": 6}


def named_sql(out: dict[str, str]) -> dict[str, str]:
    def named(sql: str) -> str:
        for a, b in NAMED:
            assert a in sql, a
            sql = sql.replace(a, b)
        return sql

    short = "hospital_name"
    for suffix in (" Hospital", " Infirmary", " NHS FT"):  # the first occurrence of each
        short = (f"(CASE WHEN strpos({short}, '{suffix}') > 0 THEN substr({short}, 1, strpos({short}, '{suffix}') - 1) || "
                 f"substr({short}, strpos({short}, '{suffix}') + {len(suffix)}) ELSE {short} END)")
    cells = ", ".join(f"CAST(COALESCE(SUM(visits) FILTER (WHERE department_name = '{d}'), 0) AS BIGINT) AS \"{d}\"" for d in STACKED)
    place = "CASE department_name " + " ".join(f"WHEN '{d}' THEN {n}" for d, n in PLACES.items()) + " END"
    return {
        "named_department_pivot": f"SELECT {short} AS name, hospital_name, {cells} FROM ({named(out['visits_by_department'])}) "
                                  "GROUP BY hospital_name",
        "named_department_stack": f"SELECT CAST({place} AS BIGINT) AS place, department_name, CAST(SUM(visits) AS BIGINT) AS visits "
                                  f"FROM ({named(out['visits_by_department'])}) GROUP BY department_name",
        "named_department_families": named(out["department_families"]),
        "named_diverging_bars": named(out["diverging_bars"]),
        "named_deficit_hospitals": named(out["deficit_hospitals"]),
    }


PRIMARY_KEYS = [
    ("dim_region", "region_id"), ("dim_hospital", "hospital_id"), ("dim_department", "department_id"),
    ("dim_date", "date_key"), ("dim_patient", "patient_id"), ("dim_doctor", "doctor_id"),
    ("dim_diagnosis", "diagnosis_id"), ("fact_patient_visits", "visit_id"), ("fact_staffing", "shift_id"),
    ("fact_financials", "financial_record_id"),
]
FOREIGN_KEYS = [
    ("dim_hospital", "region_id", "dim_region", "region_id"),
    ("dim_doctor", "primary_hospital_id", "dim_hospital", "hospital_id"),
    ("fact_patient_visits", "patient_id", "dim_patient", "patient_id"),
    ("fact_patient_visits", "hospital_id", "dim_hospital", "hospital_id"),
    ("fact_patient_visits", "department_id", "dim_department", "department_id"),
    ("fact_patient_visits", "doctor_id", "dim_doctor", "doctor_id"),
    ("fact_patient_visits", "diagnosis_category", "dim_diagnosis", "diagnosis_id"),
    ("fact_staffing", "hospital_id", "dim_hospital", "hospital_id"),
    ("fact_staffing", "department_id", "dim_department", "department_id"),
    ("fact_staffing", "shift_date", "dim_date", "full_date"),
    ("fact_financials", "hospital_id", "dim_hospital", "hospital_id"),
]
DIMENSION_BOUNDS = [("dim_region", 10_000), ("dim_hospital", 100_000), ("dim_department", 10_000),
                    ("dim_date", 100_000)]


#: Rows that each table of the star must have, from the driver tables alone.
EXPECTED_ROWS = {
    "dim_region": "SELECT COUNT(*) FROM region", "dim_hospital": "SELECT COUNT(*) FROM nation",
    "dim_department": "SELECT COUNT(DISTINCT p_type) FROM part", "dim_date": "SELECT 365 * (hi - lo + 1) + hi // 4 - (lo - 1) // 4 - hi // 100 + (lo - 1) // 100 + hi // 400 - (lo - 1) // 400 "
                "FROM (SELECT MIN(year(d)) AS lo, MAX(year(d)) AS hi FROM (SELECT l_shipdate AS d FROM lineitem UNION ALL "
                "SELECT o_orderdate FROM orders))",
    "dim_patient": "SELECT COUNT(*) FROM customer", "dim_doctor": "SELECT COUNT(*) FROM supplier",
    "dim_diagnosis": "SELECT COUNT(DISTINCT p_brand) FROM part",
    "fact_patient_visits": "SELECT COUNT(*) FROM lineitem", "fact_staffing": "SELECT COUNT(*) FROM orders",
    "fact_financials": "SELECT COUNT(DISTINCT (c_nationkey, date_trunc('month', o_orderdate))) "
                       "FROM orders JOIN customer ON c_custkey = o_custkey",
}

#: Conforming the untidy sheets that ``sources.sheets`` derives: what must come out.
CONFORM = {
    "conform_visits": """SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS visit_id,
       'S' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS doctor_id,
       CASE WHEN l_linenumber <> 6 THEN l_shipdate END AS arrival_datetime,
       CAST(month(l_shipdate) AS INTEGER) AS month,
       CASE WHEN l_linenumber <> 5 THEN l_quantity * 2 END AS wait_time_minutes,
       l_linenumber <> 1 AS icu_required_flag, l_discount >= 0.09 AS complaint_flag,
       true AS mortality_flag, l_returnflag AS ward_notes
FROM lineitem""",
    "conform_flags": """SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS visit_id,
       CASE l_linenumber WHEN 2 THEN false WHEN 4 THEN true WHEN 5 THEN false WHEN 6 THEN true END
           AS icu_required_flag
FROM lineitem""",
    "conform_shifts": """SELECT CAST(o_orderkey AS VARCHAR) AS shift_id, CAST(o_orderdate AS DATE) AS shift_date,
       CAST(month(o_orderdate) AS INTEGER) AS month, CAST(o_custkey % 6 AS INTEGER) AS staff_absence_count,
       CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 121 / 10.0 END AS overtime_hours
FROM orders""",
    "conform_vocabulary": """SELECT CASE p_size % 3 WHEN 0 THEN 'fact_' || lower(p_type) WHEN 1 THEN lower(p_type)
                                ELSE lower(p_type) || '_dim' END AS table_name,
       replace(lower(p_name), ' ', '_') AS column_name, p_brand AS data_type, CAST(p_size AS VARCHAR) AS description,
       CAST(NULL AS VARCHAR) AS uk_context, p_type AS notes
FROM part WHERE p_partkey % 10 NOT IN (0, 1)""",
}


def _key_sql(table: str, key: str, kind: str) -> str:
    ok = ("duplicated_keys = 0" if kind == "unique" else "null_keys = 0 AND duplicated_keys = 0")
    return f"""SELECT *, CASE WHEN {ok} THEN 'ok' ELSE 'violation' END AS status FROM (
    SELECT '{table}' AS table_name, '{key}' AS key_column, '{kind}' AS kind,
           CAST(COUNT(*) AS BIGINT) AS rows,
           CAST(COUNT(*) - COUNT({key}) AS BIGINT) AS null_keys,
           CAST(COUNT(DISTINCT {key}) AS BIGINT) AS distinct_keys,
           (SELECT CAST(COUNT(*) AS BIGINT) FROM (SELECT {key} FROM {table} WHERE {key} IS NOT NULL
                                                  GROUP BY {key} HAVING COUNT(*) > 1)) AS duplicated_keys
    FROM {table})"""


def _ref_sql(table: str, column: str, ref_table: str, ref_column: str) -> str:
    missing = f"NOT EXISTS (SELECT 1 FROM {ref_table} d WHERE d.{ref_column} = f.{column})"
    return f"""SELECT *, CASE WHEN orphans = 0 THEN 'ok' ELSE 'violation' END AS status FROM (
    SELECT '{table}' AS table_name, '{column}' AS column_name, '{ref_table}' AS ref_table,
           '{ref_column}' AS ref_column,
           CAST(COUNT(*) AS BIGINT) AS checked,
           CAST(COUNT(*) FILTER (WHERE {missing}) AS BIGINT) AS orphans,
           CAST(COUNT(DISTINCT f.{column}) FILTER (WHERE {missing}) AS BIGINT) AS orphan_values
    FROM {table} f WHERE f.{column} IS NOT NULL)"""


SECTOR_AGREEMENT = """SELECT private, private_by_type, COUNT(*) AS hospitals,
       CASE WHEN private IS NOT DISTINCT FROM private_by_type THEN 'ok' ELSE 'mismatch' END AS status
FROM (SELECT private, COALESCE(nhs_trust_type = 'Independent / Private', false) AS private_by_type FROM dim_hospital)
GROUP BY private, private_by_type"""


#: Visits of every hospital in every month of the data, months without visits included.
MONTHLY = f"""by_month AS (
    SELECT h.hospital_id, h.hospital_name, m.month_start, COUNT(v.visit_id) AS visits
    FROM dim_hospital h
    CROSS JOIN (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month_start
                FROM (SELECT date_trunc('month', MIN(arrival_datetime)) AS lo,
                             date_trunc('month', MAX(arrival_datetime)) AS hi FROM {V_H})) m
    LEFT JOIN fact_patient_visits v
           ON v.hospital_id = h.hospital_id AND date_trunc('month', v.arrival_datetime) = m.month_start
    GROUP BY ALL),
with_before AS (
    SELECT n.*, b.visits AS before FROM by_month n
    LEFT JOIN by_month b ON b.hospital_id = n.hospital_id AND b.month_start = n.month_start - INTERVAL 1 YEAR)"""

#: Weekly sums per hospital and department from the first to the last week with shifts.
WEEKLY = f"""found AS (
    SELECT s.hospital_id, s.department_id, CAST(date_trunc('week', s.shift_date) AS DATE) AS week,
           CAST(SUM(s.staff_absence_count) AS DOUBLE) AS absences, SUM(s.overtime_hours) AS overtime
    FROM {S_H} GROUP BY ALL),
spans AS (SELECT hospital_id, department_id, MIN(week) AS lo, MAX(week) AS hi FROM found GROUP BY ALL),
weeks AS (
    SELECT x.hospital_id, x.department_id, x.week, COALESCE(f.absences, 0) AS absences, COALESCE(f.overtime, 0) AS overtime
    FROM (SELECT hospital_id, department_id, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week FROM spans) x
    LEFT JOIN found f ON f.hospital_id = x.hospital_id AND f.department_id IS NOT DISTINCT FROM x.department_id
                     AND f.week = x.week),
pairs AS (
    SELECT a.hospital_id, a.department_id, l.lag_weeks, a.absences, b.overtime
    FROM weeks a CROSS JOIN range(9) l(lag_weeks)
    LEFT JOIN weeks b ON b.hospital_id = a.hospital_id AND b.department_id IS NOT DISTINCT FROM a.department_id
                     AND b.week = a.week + l.lag_weeks * INTERVAL 7 DAY)"""


def percent_more(now: str, before: str) -> str:
    return f"CASE WHEN {before} > 0 THEN {rd(f'({now} - {before}) * 100.0 / {before}', 2)} END"


def _slopes(name: str, fact: str, value: str) -> str:
    """Lines of ``value`` over the months of each half, per hospital."""
    parts = [f"{rd(f'{fn}({value}, month) FILTER (WHERE {PERIODS[half]})', 6)} AS {half.lower()}_{name}_{what}"
             for half in ("H1", "H2") for fn, what in (("regr_slope", "slope"), ("regr_r2", "r2"))]
    return f"SELECT hospital_id, {', '.join(parts)} FROM {fact} GROUP BY hospital_id"


def trend_parts() -> dict[str, tuple[str, str]]:
    correlation = "CASE WHEN COUNT(overtime) > 1 THEN CORR(absences, overtime) END"
    lags = f"""SELECT hospital_id, department_id, lag_weeks, COUNT(overtime) AS pairs,
       {rd(correlation, 6)} AS correlation
FROM pairs GROUP BY hospital_id, department_id, lag_weeks"""
    network = f"SELECT lag_weeks, COUNT(overtime) AS pairs, {rd(correlation, 6)} AS correlation FROM pairs GROUP BY lag_weeks"
    per_month = "CAST(winter AS DOUBLE) / 3"
    level = "(CAST(beside AS DOUBLE) / beside_months)"
    return {
        "visit_growth": _p(f"""SELECT hospital_id, hospital_name, strftime(month_start, '%Y-%m') AS month, visits,
       before AS visits_year_ago, {percent_more('visits', 'before')} AS growth_pct FROM with_before""", MONTHLY),
        "visit_growth_by_year": _p(f"""SELECT y.hospital_id, y.hospital_name, y.year, y.months, y.visits,
       CASE WHEN y.months = 12 AND p.months = 12 THEN {percent_more('y.visits', 'p.visits')} END AS growth_pct,
       {percent_more('y.aligned', 'y.before')} AS aligned_growth_pct
FROM years y LEFT JOIN years p ON p.hospital_id = y.hospital_id AND p.year = y.year - 1""", MONTHLY + """,
years AS (SELECT hospital_id, hospital_name, year(month_start) AS year, COUNT(*) AS months,
                 CAST(SUM(visits) AS BIGINT) AS visits, SUM(visits) FILTER (WHERE before IS NOT NULL) AS aligned,
                 SUM(before) AS before FROM with_before GROUP BY ALL)"""),
        "winter_surge": _p(f"""SELECT hospital_id, hospital_name, season, CAST(COALESCE(winter, 0) AS BIGINT) AS winter_visits,
       winter_months, CAST(COALESCE(beside, 0) AS BIGINT) AS beside_visits, beside_months,
       CASE WHEN winter_months = 3 AND beside > 0 THEN {rd(f'({per_month} / {level} - 1) * 100', 2)} END AS surge_pct
FROM (SELECT hospital_id, hospital_name,
             year(month_start) - CASE WHEN month(month_start) < 5 THEN 1 ELSE 0 END AS season,
             SUM(visits) FILTER (WHERE month(month_start) IN (11, 12, 1)) AS winter,
             COUNT(*) FILTER (WHERE month(month_start) IN (11, 12, 1)) AS winter_months,
             SUM(visits) FILTER (WHERE month(month_start) NOT IN (11, 12, 1)) AS beside,
             COUNT(*) FILTER (WHERE month(month_start) NOT IN (11, 12, 1)) AS beside_months
      FROM by_month WHERE month(month_start) NOT IN (5, 6, 7) GROUP BY ALL)""", MONTHLY),
        "absence_overtime_lags": _p(lags, WEEKLY),
        "absence_overtime_network": _p(f"""SELECT *, COALESCE(correlation = MAX(correlation) OVER (), false) AS strongest
FROM ({network})""", WEEKLY),
        "half_year_slopes": _p(f"""SELECT hospital_id, hospital_name, v.* EXCLUDE (hospital_id), s.* EXCLUDE (hospital_id),
       {rd('h2_satisfaction_slope - h1_satisfaction_slope', 6)} AS satisfaction_slope_change,
       {rd('h2_burnout_slope - h1_burnout_slope', 6)} AS burnout_slope_change
FROM dim_hospital h LEFT JOIN ({_slopes('satisfaction', 'fact_patient_visits', 'satisfaction_score')}) v USING (hospital_id)
LEFT JOIN ({_slopes('burnout', 'fact_staffing', 'burnout_risk_index')}) s USING (hospital_id)"""),
    }


def audit_parts() -> dict[str, tuple[str, str]]:
    keys = [_key_sql(t, k, "primary") for t, k in PRIMARY_KEYS] + [_key_sql("dim_date", "full_date", "unique")]
    counts = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS rows, "
        f"CAST(({EXPECTED_ROWS[t]}) AS BIGINT) AS expected FROM {t}" for t, _ in PRIMARY_KEYS)
    counts = f"SELECT *, CASE WHEN rows = expected THEN 'ok' ELSE 'mismatch' END AS status FROM ({counts})"
    bounds = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, CAST(COUNT(*) AS BIGINT) AS rows, CAST({b} AS BIGINT) AS bound, "
        f"CASE WHEN COUNT(*) <= {b} THEN 'ok' ELSE 'violation' END AS status FROM {t}"
        for t, b in DIMENSION_BOUNDS)
    return {
        "audit_keys": _p("\nUNION ALL\n".join(keys)),
        "audit_references": _p("\nUNION ALL\n".join(_ref_sql(*fk) for fk in FOREIGN_KEYS)),
        "audit_row_counts": _p(counts),
        "audit_sector_agreement": _p(SECTOR_AGREEMENT),
        "audit_headline": _p(f"""SELECT 'readmission_rate' AS metric, readmission_rate,
       CAST(17.0 AS DOUBLE) AS expected, CAST(1.0 AS DOUBLE) AS tolerance,
       CASE WHEN abs(readmission_rate - 17.0) <= 1.0 THEN 'ok' ELSE 'off' END AS status
FROM (SELECT {rate('readmission_30_days_flag')} AS readmission_rate FROM fact_patient_visits)"""),
        "audit_dimension_bounds": _p(bounds),
    }


def oracle_sql() -> dict[str, str]:
    parts = {**report_parts(), **shape_parts(), **label_parts(), **trend_parts(), **audit_parts()}
    out = {name: q(body, ctes) for name, (ctes, body) in parts.items()}
    out["facility_ledger_search"] = (
        f"SELECT * FROM ({out['facility_ledger']}) WHERE contains(lower(hospital_name), 'nation_1') "
        "OR contains(lower(city), 'nation_1')")
    out["visits_treemap_text"] = (
        "SELECT hospital_name AS name, string_agg(department_name || '=' || visits, ', ' "
        f"ORDER BY visits DESC, department_name) AS children FROM ({out['visits_by_department']}) GROUP BY 1")
    out["visits_treemap_json"] = (
        "SELECT hospital_name AS name, '[' || string_agg('{\"name\":\"' || department_name || '\",\"value\":' || visits || '}', ',' "
        f"ORDER BY visits DESC, department_name) || ']' AS children FROM ({out['visits_by_department']}) GROUP BY 1")
    out["calendar_heatmap_1997"] = f"SELECT * FROM ({out['calendar_heatmap']}) WHERE year = '1997'"
    out["source_tables"] = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, (SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() "
        f"WHERE table_name = '{t}') AS headers, COUNT(*) AS rows FROM {t}"
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
    out |= named_sql(out)
    for name, (base, where) in SCOPED.items():
        out[name] = _scoped(out[base], where)
    return out | CONFORM


#: Registered reports under a dashboard filter: (report, predicate on the hospitals).
SCOPED = {
    "overview_kpis_region": ("overview_kpis", "region_id = 'R02'"),
    "hospital_outliers_private": ("hospital_outliers", "nhs_trust_type = 'Independent / Private'"),
    "radar_profiles_region": ("radar_profiles", "region_id = 'R02'"),
    "regional_choropleth_private": ("regional_choropleth", "nhs_trust_type = 'Independent / Private'"),
    "sankey_links_hospital": ("sankey_links", "hospital_id = 'H07'"),
    "severity_weekday_wait_hospital": ("severity_weekday_wait", "hospital_id = 'H07'"),
}


def scoped_sql(name: str, where: str) -> str:
    """The oracle of ``name`` with the hospital dimension filtered by ``where``
    (the dashboard filter applied to ``dim_hospital``, as the reports do)."""
    return _scoped(oracle_sql()[name], where)


def _scoped(sql: str, where: str) -> str:
    head, tail = sql.split("dim_department AS (", 1)
    head = head.replace("dim_hospital AS (\n", "dim_hospital AS (SELECT * FROM (\n", 1)
    head = head.rstrip().rstrip(",") + f" WHERE {where}),\n"
    return head + "dim_department AS (" + tail
