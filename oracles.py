"""SQL that recomputes the registered queries row by row, in DuckDB, without the shortcuts of the Spark plans."""

from __future__ import annotations

from ebbtide import fixed_values as fv
from ebbtide.operators.evaluation import RATES
from ebbtide.operators.history import FLAG_COLUMNS, HISTORY, RATIOS, window_columns
from ebbtide.operators.imputing import TWO_EVENT_COLUMNS
from ebbtide.params import Study, ValueParams
from ebbtide.sources.sample_tables import DENSE, SPARSE

FLOATS = {
    "days_between_last_two", "gap_deviation", "mean_gap", "mean_ticket", "ticket_deviation", "total_amount",
    "approval_rate", *RATIOS, "sector",
    *[c for s in (SPARSE, DENSE) for c in window_columns(s.windows) if not c.startswith("sales_")],
}
SALES_SPARSE = """
raw_sales AS (
  SELECT o_custkey AS client_id, o_orderdate AS sold_at,
    CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'qr' WHEN '3-MEDIUM' THEN 'payment_link'
      WHEN '4-NOT SPECIFIED' THEN 'api_checkout' ELSE 'other_device' END AS product,
    CASE WHEN o_orderstatus = 'P' THEN 'REJECTED' ELSE 'APPROVED' END AS status, o_totalprice AS amount
  FROM orders)"""
SALES_DENSE = """
raw_sales AS (
  SELECT user_id AS client_id, ts AS sold_at,
    CASE event_type WHEN 'click' THEN 'mpos' WHEN 'view' THEN NULL WHEN 'signup' THEN 'payment_link'
      WHEN 'purchase' THEN 'qr' ELSE 'other_device' END AS product,
    CASE WHEN event_type = 'error' THEN 'REJECTED' ELSE 'APPROVED' END AS status, value AS amount
  FROM events)"""
CLEAN = f"""
sales AS (
  SELECT client_id, CAST(sold_at AS DATE) AS sale_date, COALESCE(product, '{fv.DEFAULT_PRODUCT}') AS product,
    status, amount FROM raw_sales)"""
ACCOUNTS = f"""
raw_accounts AS (
  SELECT c_custkey AS client_id, CASE WHEN n_nationkey <> 0 THEN n_name END AS province,
    c_mktsegment AS account_type, n_regionkey AS sector
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
accounts AS (
  SELECT client_id, COALESCE(province, '{fv.DEFAULT_PROVINCE}') AS province, account_type,
    CAST(sector AS DOUBLE) AS sector FROM raw_accounts)"""
IN_PERSON = ", ".join(f"'{p}'" for p in fv.IN_PERSON_PRODUCTS)
ONLINE = ", ".join(f"'{p}'" for p in fv.ONLINE_PRODUCTS)
CHANNEL = (
    f"CASE WHEN product IN ({IN_PERSON}) THEN '{fv.IN_PERSON}' "
    f"WHEN product IN ({ONLINE}) THEN '{fv.ONLINE}' ELSE '{fv.OTHER}' END"
)


def near(expression: str, digits: int = 6) -> str:
    """Rounded a hair upwards: a tie in the last digit falls the same way whatever order the sums ran in."""
    return f"round({expression} + {1.3 * 10 ** -(digits + 3):.10f}::DOUBLE, {digits})"


def day(value) -> str:
    return f"DATE '{value}'"


def sales_ctes(study: Study) -> str:
    return (SALES_DENSE if study is DENSE else SALES_SPARSE) + "," + CLEAN


def out(ctes: str, source: str, columns: list[str], floats: set[str] = FLOATS, digits: int = 6) -> str:
    chosen = ", ".join(f"{near(c, digits)} AS {c}" if c in floats else c for c in columns)
    return f"WITH {ctes}\nSELECT {chosen} FROM {source}"


def feature_ctes(study: Study, cut: str | None = None, since: str | None = None, labelled: bool = True) -> str:
    cut = cut or day(study.cut)
    lower = f"AND sale_date >= {since}" if since else ""
    windows, joins, columns = [], [], []
    for d in study.windows:
        windows.append(f"""
w{d} AS (
  SELECT client_id, count(*) AS sales_{d}d, COALESCE(sum(amount), 0) AS amount_{d}d, avg(amount) AS ticket_{d}d
  FROM sales WHERE sale_date > {cut} - {d} AND sale_date <= {cut} {lower} GROUP BY client_id)""")
        joins.append(f"LEFT JOIN w{d} USING (client_id)")
        columns.append(f"COALESCE(sales_{d}d, 0) AS sales_{d}d, amount_{d}d, ticket_{d}d")
    short, longer = study.windows[0], study.windows[1]
    label = ""
    label_join = ""
    if labelled:
        label = ", CASE WHEN r.client_id IS NULL THEN 1 ELSE 0 END AS churned"
        label_join = "LEFT JOIN returned r USING (client_id)"
    tickets = ", ".join(f"COALESCE(ticket_{d}d, 0) AS ticket_{d}d" for d in study.windows)
    return f"""
cohort AS (SELECT DISTINCT client_id FROM sales
  WHERE sale_date > {cut} - {study.cohort_days} AND sale_date <= {cut}),
returned AS (SELECT DISTINCT client_id FROM sales
  WHERE sale_date > {cut} AND sale_date <= {cut} + {study.horizon}),
past AS (SELECT s.* FROM sales s SEMI JOIN cohort USING (client_id) WHERE sale_date <= {cut} {lower}),
ordered AS (SELECT client_id, sale_date - lag(sale_date) OVER (PARTITION BY client_id ORDER BY sale_date) AS gap,
    row_number() OVER (PARTITION BY client_id ORDER BY sale_date) AS place,
    count(*) OVER (PARTITION BY client_id) AS n FROM past),
gaps AS (SELECT client_id, CAST(max(CASE WHEN place = n THEN gap END) AS DOUBLE) AS days_between_last_two,
    stddev_samp(gap) AS gap_deviation FROM ordered GROUP BY client_id),
history AS (
  SELECT client_id,
    CASE WHEN count(*) > 1 THEN (max(sale_date) - min(sale_date)) / (count(*) - 1) END AS mean_gap,
    avg(amount) AS mean_ticket, stddev_samp(amount) AS ticket_deviation, COALESCE(sum(amount), 0) AS total_amount,
    CAST(month(max(sale_date)) AS INTEGER) AS last_sale_month,
    count(*) FILTER (isodow(sale_date) NOT IN (6, 7)) AS weekday_sales,
    count(*) FILTER (isodow(sale_date) IN (6, 7)) AS weekend_sales,
    count(DISTINCT product) AS products,
    bool_or({CHANNEL} = '{fv.ONLINE}') AS sells_online,
    bool_or({CHANNEL} = '{fv.IN_PERSON}') AS sells_in_person,
    bool_or({CHANNEL} = '{fv.ONLINE}') AND bool_or({CHANNEL} = '{fv.IN_PERSON}') AS sells_mixed,
    count(*) AS sales,
    CASE WHEN count(status) = count(*) THEN count(*) FILTER (status = '{fv.APPROVED}') END AS approved,
    CASE WHEN count(status) = count(*) THEN count(*) FILTER (status = '{fv.APPROVED}') END / count(*) AS approval_rate,
    min(sale_date) >= {cut} - {study.new_client_days} AS new_client
  FROM past GROUP BY client_id),
{",".join(windows)},
windowed AS (
  SELECT h.*, g.* EXCLUDE (client_id), {", ".join(columns)}
  FROM history h JOIN gaps g USING (client_id) {" ".join(joins)}),
rated AS (
  SELECT * REPLACE ({tickets}),
    sales_{short}d / greatest(sales_{longer}d * ({short}.0::DOUBLE / {longer}), 1.0) AS activity_change,
    {short}.0::DOUBLE / greatest(sales_{short}d, 1) - mean_gap AS frequency_change,
    (COALESCE(ticket_{short}d, 0) - mean_ticket) / NULLIF(mean_ticket, 0) AS ticket_change
  FROM windowed),
raw_features AS (
  SELECT f.*, a.province, a.account_type, a.sector{label}
  FROM rated f LEFT JOIN accounts a USING (client_id) {label_join}),
features AS (
  SELECT * REPLACE ({", ".join(
      [f"COALESCE(amount_{d}d, 0) AS amount_{d}d" for d in study.windows]
      + [f"COALESCE({c}, {fv.SENTINEL}) AS {c}" for c in TWO_EVENT_COLUMNS])})
  FROM raw_features),
scored AS (
  SELECT *, round(1 / (1 + exp(-(0.8 - activity_change + mean_gap / 400))), 4) AS score FROM features)"""


def all_ctes(study: Study, **options) -> str:
    return f"{sales_ctes(study)},{ACCOUNTS},{feature_ctes(study, **options)}"


def label_ctes(study: Study) -> str:
    cut = day(study.cut)
    return sales_ctes(study) + f""",
active AS (SELECT DISTINCT client_id FROM sales WHERE sale_date > {cut} - {study.cohort_days} AND sale_date <= {cut}),
labels_ AS (SELECT client_id, CAST(CASE WHEN EXISTS (SELECT 1 FROM sales s WHERE s.client_id = a.client_id
    AND s.sale_date > {cut} AND s.sale_date <= {cut} + {study.horizon}) THEN 0 ELSE 1 END AS INTEGER) AS churned
  FROM active a)"""


def hashed(salt: str, seed: int = 123) -> str:
    return f"('0x' || substr(md5(client_id::VARCHAR || ':{seed}{salt}'), 1, 15))::BIGINT"


def split_ctes(study: Study) -> str:
    return label_ctes(study) + f""",
ranked AS (SELECT client_id, churned,
    row_number() OVER (PARTITION BY churned ORDER BY {hashed('')}, client_id) AS place,
    count(*) OVER (PARTITION BY churned) AS n FROM labels_),
split AS (SELECT client_id, churned, place <= ceil(n * {study.train_percent} / 100.0) AS in_train FROM ranked),
train AS (SELECT client_id, churned FROM split WHERE in_train),
sizes AS (SELECT churned, count(*) AS own, max(count(*)) OVER () AS largest FROM train GROUP BY churned),
copied AS (SELECT client_id, churned, own, largest,
    row_number() OVER (PARTITION BY churned ORDER BY {hashed(':copy')}, client_id) AS place
  FROM train JOIN sizes USING (churned)),
balanced AS (SELECT client_id, churned, unnest(range(1, 1 + largest // own
    + CASE WHEN place <= largest % own THEN 1 ELSE 0 END)) AS copy FROM copied)"""


def definition_ctes(study: Study) -> str:
    start, cut = day(study.definition_start), day(study.cut)
    return sales_ctes(study) + f""",
frequency AS (
  SELECT client_id, count(*) AS sales_count, min(sale_date) AS first_sale, max(sale_date) AS last_sale,
    CASE WHEN count(*) > 1 THEN (max(sale_date) - min(sale_date)) / (count(*) - 1) END AS mean_gap,
    {cut} - max(sale_date) AS days_since_last
  FROM sales WHERE sale_date >= {start} AND sale_date <= {cut} GROUP BY client_id),
back AS (SELECT DISTINCT client_id, 1 AS came_back FROM sales WHERE sale_date > {cut}),
flagged AS (
  SELECT f.*, CAST(COALESCE(came_back, 0) AS BIGINT) AS came_back,
    CAST(days_since_last > mean_gap * 3 AS BIGINT) AS left_x3,
    CAST(days_since_last > mean_gap * 2 AS BIGINT) AS left_x2,
    CAST(days_since_last > {study.inactivity_days} AS BIGINT) AS left_60d
  FROM frequency f LEFT JOIN back USING (client_id)),
judged AS (
  SELECT definition, CASE WHEN gone = 1 AND came_back = 0 THEN '{fv.HIT_LEFT}'
    WHEN gone = 1 AND came_back = 1 THEN '{fv.MISS_BACK}' WHEN gone = 0 AND came_back = 1 THEN '{fv.HIT_ACTIVE}'
    WHEN gone = 0 AND came_back = 0 THEN '{fv.MISS_LEFT}' END AS outcome
  FROM (SELECT '{fv.DEFINITION_X3}' AS definition, left_x3 AS gone, came_back FROM flagged
    UNION ALL SELECT '{fv.DEFINITION_X2}', left_x2, came_back FROM flagged
    UNION ALL SELECT '{fv.DEFINITION_60D}', left_60d, came_back FROM flagged)),
evaluated AS (
  SELECT definition, outcome, count(*) AS n,
    round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY definition), 1) AS pct
  FROM judged GROUP BY definition, outcome)"""


def month_ctes(study: Study, since: str | None = None) -> str:
    lower = f"AND sale_date >= {since}" if since else ""
    return sales_ctes(study) + f""",
months AS (
  SELECT client_id, CAST(date_trunc('month', sale_date) AS DATE) AS month, count(*) AS month_sales,
    COALESCE(sum(amount), 0) AS month_volume
  FROM sales WHERE status = '{fv.APPROVED}' {lower} GROUP BY ALL),
clients AS (
  SELECT client_id, count(*) AS active_months, CAST(sum(month_sales) AS BIGINT) AS total_sales,
    sum(month_volume) AS total_volume, avg(month_sales) AS mean_month_sales, avg(month_volume) AS mean_month_volume
  FROM months GROUP BY client_id)"""


def roc_ctes(study: Study) -> str:
    return all_ctes(study) + """,
points AS (SELECT score, count(*) FILTER (churned = 1) AS pos, count(*) FILTER (churned = 0) AS neg
  FROM scored GROUP BY score),
roc AS (
  SELECT score, (score + lead(score) OVER (ORDER BY score DESC)) / 2 AS threshold,
    CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
    CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp,
    CAST(sum(pos) OVER () AS BIGINT) AS positives, CAST(sum(neg) OVER () AS BIGINT) AS negatives FROM points
  UNION ALL SELECT NULL, 'infinity'::DOUBLE, 0, 0, CAST(sum(pos) AS BIGINT), CAST(sum(neg) AS BIGINT) FROM points)"""


BEST_CUT = """SELECT COALESCE(threshold, '-infinity'::DOUBLE) AS t FROM roc
ORDER BY tp::HUGEINT * negatives - fp::HUGEINT * positives DESC, threshold NULLS FIRST LIMIT 1"""


def rates_select(source: str, extra: str = "") -> str:
    """The measures from tp, fp, fn, tn by their textbook formulas."""
    return f"""
cells AS (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n FROM {source}),
basic AS (SELECT *, (tp + tn) / n AS accuracy, tp / NULLIF(tp + fn, 0) AS sensitivity,
    tn / NULLIF(tn + fp, 0) AS specificity, tp / NULLIF(tp + fp, 0) AS ppv, tn / NULLIF(tn + fn, 0) AS npv,
    ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / (n * n) AS expected,
    (tp + fn) / n AS prevalence FROM cells),
rates AS (SELECT *, 1 - accuracy AS error_rate, (accuracy - expected) / NULLIF(1 - expected, 0) AS kappa,
    2 * ppv * sensitivity / NULLIF(ppv + sensitivity, 0) AS f1_yes,
    2 * npv * specificity / NULLIF(npv + specificity, 0) AS f1_no,
    (sensitivity + specificity) / 2 AS balanced_accuracy, greatest(prevalence, 1 - prevalence) AS no_information_rate,
    tp / n AS detection_rate, (tp + fp) / n AS detection_prevalence,
    (abs(fp - fn) - 1) * (abs(fp - fn) - 1) / NULLIF(fp + fn, 0)::DOUBLE AS mcnemar FROM basic)"""


def cell_counts(threshold: str) -> str:
    return f"""count(*) FILTER (score > {threshold} AND churned = 1) AS tp,
    count(*) FILTER (score > {threshold} AND churned = 0) AS fp,
    count(*) FILTER (NOT score > {threshold} AND churned = 1) AS fn,
    count(*) FILTER (NOT score > {threshold} AND churned = 0) AS tn"""


PROVINCE_LEVELS = sorted([fv.DEFAULT_PROVINCE, *[f"NATION_{i}" for i in range(1, 25)]])
ACCOUNT_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NUMERIC = [
    *[c for c in HISTORY if c not in FLAG_COLUMNS and c not in ("sales", "approved")],
    *window_columns(SPARSE.windows), *RATIOS, "sector",
]
SUMMARY = ["minimum", "q1", "median", "mean", "q3", "maximum"]


def summary_sql(ctes: str, source: str, columns: list[str], digits: int) -> str:
    parts = []
    for c in columns:
        parts.append(f"""
SELECT '{c}' AS "column", count({c}) AS present, count(*) - count({c}) AS missing, {near(f"min({c})::DOUBLE", digits)} AS minimum,
  {near(f"quantile_cont({c}::DOUBLE, 0.25)", digits)} AS q1, {near(f"quantile_cont({c}::DOUBLE, 0.5)", digits)} AS median,
  {near(f"avg({c})", digits)} AS mean, {near(f"quantile_cont({c}::DOUBLE, 0.75)", digits)} AS q3,
  {near(f"max({c})::DOUBLE", digits)} AS maximum FROM {source}""")
    return f"WITH {ctes}" + "\nUNION ALL".join(parts)


def correlation_sql(where: str = "") -> str:
    pairs = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]
    parts = [f"SELECT '{a}' AS column_1, '{b}' AS column_2, corr({a}, {b}) AS c FROM f" for a, b in pairs]
    return f"""WITH {all_ctes(SPARSE)}, f AS MATERIALIZED (SELECT * FROM features),
pairs AS ({" UNION ALL ".join(parts)})
SELECT column_1, column_2, round(CASE WHEN isnan(c) THEN NULL ELSE c END, 6) AS correlation FROM pairs {where}"""


LINEAR = [c for c in HISTORY if c not in ("sales", "approved")] + window_columns(SPARSE.windows) + RATIOS


def screen_ctes() -> str:
    """Greedy correlation screen over the balanced rows: pairs in order, one recursion step each."""
    doubles = ", ".join(f"{c}::DOUBLE AS {c}" for c in LINEAR)
    spread = " UNION ALL ".join(f"SELECT '{c}' AS name, {i} AS place FROM b HAVING var_samp({c}) > 0"
                                for i, c in enumerate(LINEAR))
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS variable, '{b}' AS kept, {i} AS i, {j} AS j, abs(corr({a}, {b})) AS strength FROM b"
        for i, a in enumerate(LINEAR) for j, b in enumerate(LINEAR) if i < j)
    whole = split_ctes(SPARSE) + "," + feature_ctes(SPARSE)
    return f"""RECURSIVE {ACCOUNTS.strip()},{whole},
b AS MATERIALIZED (SELECT {doubles}, bal.churned::DOUBLE AS churned FROM balanced bal JOIN features f USING (client_id)),
varying AS ({spread}),
strong AS (SELECT p.*, row_number() OVER (ORDER BY round(strength, 9) DESC, i, j) AS step FROM ({pairs}) p
  WHERE strength > 0.9 AND NOT isnan(strength) AND variable IN (SELECT name FROM varying) AND kept IN (SELECT name FROM varying)),
walk AS (SELECT 0::BIGINT AS step, []::VARCHAR[] AS gone, false AS dropped
  UNION ALL SELECT s.step, CASE WHEN list_contains(w.gone, s.variable) OR list_contains(w.gone, s.kept) THEN w.gone
      ELSE list_append(w.gone, s.variable) END,
    NOT (list_contains(w.gone, s.variable) OR list_contains(w.gone, s.kept))
  FROM walk w JOIN strong s ON s.step = w.step + 1),
screened AS (SELECT name FROM varying WHERE NOT list_contains((SELECT gone FROM walk ORDER BY step DESC LIMIT 1), name))"""


def lambdas_sql(count: int = 6, ratio: float = 1e-3) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS name, abs(corr({c}, churned)) AS c FROM b" for c in LINEAR)
    return f"""WITH {screen_ctes()},
top AS (SELECT max(c) * (SELECT stddev_pop(churned) FROM b) AS largest FROM ({parts}) WHERE name IN (SELECT name FROM screened))
SELECT CAST(i AS INTEGER) AS step, round(largest * {ratio}::DOUBLE ** (i / {count - 1}), 6) AS lambda
FROM top, range({count}) r(i)"""


def flag_ctes() -> str:
    """Counts of one flag against the label: a, b leave with and without it, c, d stay with and without it."""
    return all_ctes(SPARSE) + """,
cells AS (SELECT count(*) FILTER (last_sale_month > 3 AND churned = 1)::DOUBLE AS a,
  count(*) FILTER (last_sale_month <= 3 AND churned = 1)::DOUBLE AS b,
  count(*) FILTER (last_sale_month > 3 AND churned = 0)::DOUBLE AS c,
  count(*) FILTER (last_sale_month <= 3 AND churned = 0)::DOUBLE AS d FROM features)"""


def glm_flag_sql() -> str:
    return f"""WITH {flag_ctes()},
terms AS (SELECT 'late' AS variable, ln(a * d / (b * c)) AS e, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS s FROM cells
  UNION ALL SELECT '(Intercept)', ln(b / d), sqrt(1 / b + 1 / d) FROM cells)
SELECT variable, {near('e')} AS coefficient, {near('s')} AS std_error, {near('e / s')} AS z, {near('exp(e)')} AS odds_ratio FROM terms"""


def glm_flag_summary_sql() -> str:
    return f"""WITH {flag_ctes()},
fits AS (SELECT a + b + c + d AS n,
  -2 * (a * ln(a / (a + c)) + c * ln(c / (a + c)) + b * ln(b / (b + d)) + d * ln(d / (b + d))) AS fitted,
  -2 * ((a + b) * ln((a + b) / (a + b + c + d)) + (c + d) * ln((c + d) / (a + b + c + d))) AS nothing FROM cells)
SELECT {near('fitted')} AS deviance, {near('nothing')} AS null_deviance, {near('fitted + 4')} AS aic,
  CAST(n - 2 AS INTEGER) AS degrees_of_freedom FROM fits"""


def lasso_flag_sql(count: int = 20, ratio: float = 1e-3) -> str:
    """With one flag, the penalty moves the share that leaves by penalty * n * deviation on both sides of the flag."""
    return f"""WITH {flag_ctes()},
shape AS (SELECT *, a + b + c + d AS n, a + c AS with_, b + d AS without_ FROM cells),
spread AS (SELECT *, sqrt(with_ * without_ / n / (n - 1)) AS deviation,
  abs(a / n - with_ / n * (a + b) / n) / sqrt(with_ / n * without_ / n) AS largest, sign(a / with_ - b / without_) AS side FROM shape),
steps AS (SELECT *, i, largest * {ratio}::DOUBLE ** (i / {count - 1}) AS penalty FROM spread, range({count}) r(i)),
shares AS (SELECT *, a / with_ - side * penalty * deviation * n / with_ AS p1,
  b / without_ + side * penalty * deviation * n / without_ AS p0 FROM steps),
fits AS (SELECT i, penalty, CASE WHEN side * (p1 - p0) > 0 THEN p1 ELSE (a + b) / n END AS p1,
  CASE WHEN side * (p1 - p0) > 0 THEN p0 ELSE (a + b) / n END AS p0 FROM shares)
SELECT CAST(i AS INTEGER) AS step, {near('penalty', 4)} AS lambda, {near('ln(p1 / (1 - p1)) - ln(p0 / (1 - p0))', 4)} AS coefficient,
  {near('ln(p0 / (1 - p0))', 4)} AS intercept, true AS optimal FROM fits"""


def stump_sql() -> str:
    """Every cut between two values that leaves 7 rows on each side; the first of the strongest."""
    return f"""WITH {all_ctes(SPARSE)},
v AS (SELECT weekday_sales AS v, count(*) AS n, sum(churned) AS y FROM features GROUP BY ALL),
cuts AS (SELECT (v + lead(v) OVER o) / 2.0 AS threshold, sum(n) OVER o AS ln, sum(y) OVER o AS ly,
  sum(n) OVER () AS tn, sum(y) OVER () AS ty FROM v WINDOW o AS (ORDER BY v)),
gains AS (SELECT *, (ty / tn * (1 - ty / tn) - ln / tn * (ly / ln * (1 - ly / ln))
  - (tn - ln) / tn * ((ty - ly) / (tn - ln) * (1 - (ty - ly) / (tn - ln)))) AS gain
  FROM cuts WHERE threshold IS NOT NULL AND ln >= 7 AND tn - ln >= 7)
SELECT {near('threshold::DOUBLE')} AS threshold, CAST(ln AS BIGINT) AS left_rows, CAST(ly AS BIGINT) AS left_churned, CAST(tn - ln AS BIGINT) AS right_rows,
  CAST(ty - ly AS BIGINT) AS right_churned, {near('gain')} AS gain FROM gains WHERE gain > 0 AND (SELECT count(*) FROM features) >= 15
ORDER BY round(gains.gain, 12) DESC, gains.threshold LIMIT 1"""


COMPARED = {
    "mixed": "score", "activity": "round(1 / (1 + activity_change), 4)", "recency": "round(mean_gap / (mean_gap + 200), 4)",
}
LEADERS = ["auc", "accuracy", "sensitivity", "specificity"]
METRIC_COLUMNS = [
    "accuracy", "error_rate", "kappa", "sensitivity", "specificity", "ppv", "f1_no", "f1_yes", "balanced_accuracy",
]


def comparison_ctes() -> str:
    """Metrics of the three untrained scores, with AUC as the share of rightly ordered pairs."""
    long = " UNION ALL ".join(
        f"SELECT {i} AS place, '{n}' AS model, churned, {e} AS score FROM t" for i, (n, e) in enumerate(COMPARED.items()))
    cells = ", ".join(
        f"count(*) FILTER ({test} AND churned = {c}) AS {name}" for name, test, c in
        (("tp", "score > threshold", 1), ("fp", "score > threshold", 0), ("fn", "NOT score > threshold", 1),
         ("tn", "NOT score > threshold", 0)))
    return f"""{all_ctes(SPARSE)}, t AS MATERIALIZED (SELECT client_id, churned, score, activity_change, mean_gap FROM scored),
three AS MATERIALIZED ({long}),
areas AS (SELECT a.model, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auc
  FROM three a JOIN three b ON a.model = b.model AND a.churned = 1 AND b.churned = 0 GROUP BY a.model),
points AS (SELECT score, count(*) FILTER (churned = 1) AS pos, count(*) FILTER (churned = 0) AS neg
  FROM three WHERE model = 'recency' GROUP BY score),
cuts AS (SELECT (score + lead(score) OVER (ORDER BY score DESC)) / 2 AS threshold,
    sum(pos) OVER (ORDER BY score DESC) * sum(neg) OVER () - sum(neg) OVER (ORDER BY score DESC) * sum(pos) OVER () AS gain
  FROM points),
best AS (SELECT COALESCE(threshold, '-infinity'::DOUBLE) AS t FROM cuts ORDER BY gain DESC, threshold NULLS FIRST LIMIT 1),
cut AS (SELECT *, CASE WHEN model = 'recency' THEN (SELECT t FROM best) ELSE 0.5::DOUBLE END AS threshold FROM three),
c AS (SELECT place, model, threshold, {cells} FROM cut GROUP BY place, model, threshold),
{rates_select('c')},
compared AS (SELECT r.*, auc FROM rates r JOIN areas USING (model))"""


def bag_sql() -> str:
    bounds, below, k_factorial = [], 0.0, 1
    for k in range(20):
        k_factorial *= max(k, 1)
        below += 0.36787944117144233 / k_factorial
        bounds.append(below)
    cases = " ".join(f"WHEN u < {b!r}::DOUBLE THEN {k}.0" for k, b in enumerate(bounds))
    parts = " UNION ALL ".join(
        f"SELECT client_id, {t} AS tree, {hashed(f':bag{t}')} / {float(2**60)!r}::DOUBLE AS u FROM labels_" for t in range(3))
    return f"WITH {label_ctes(SPARSE)} SELECT client_id, tree, CAST(CASE {cases} ELSE 20.0 END AS DOUBLE) AS weight FROM ({parts})"


def histogram_sql() -> str:
    parts = []
    for c in NUMERIC:
        parts.append(f"""SELECT '{c}' AS name, CAST(CASE WHEN hi = lo THEN 1
  ELSE least(floor((v - lo) / ((hi - lo) / 30)), 29) + 1 END AS BIGINT) AS bin, count(*) AS n
FROM (SELECT {c}::DOUBLE AS v, min({c}::DOUBLE) OVER () AS lo, max({c}::DOUBLE) OVER () AS hi FROM f) GROUP BY ALL""")
    return f"WITH {all_ctes(SPARSE)}, f AS MATERIALIZED (SELECT * FROM features)\n" + "\nUNION ALL\n".join(parts)


def oracle_sql() -> dict[str, str]:
    sparse, sales = all_ctes(SPARSE), sales_ctes(SPARSE)
    cut = day(SPARSE.cut)
    windows = window_columns(SPARSE.windows)
    predictors = [c for c in HISTORY if c not in ("sales", "approved")] + windows + RATIOS + [
        "province", "account_type", "sector"]
    table = ["client_id", *predictors, "churned"]
    dense_predictors = [c for c in HISTORY if c not in ("sales", "approved")] + window_columns(DENSE.windows) + RATIOS
    scoring = all_ctes(
        SPARSE, cut="(SELECT max(sale_date) FROM sales)", since=day(SPARSE.scoring_start), labelled=False)
    kpis = month_ctes(SPARSE, day(SPARSE.scoring_start)).split("months AS", 1)[1]
    value = ValueParams()
    loss = f"""{scoring}, months AS {kpis},
scored_kpis AS (
  SELECT client_id, CAST(score > 0.5 AS INTEGER) AS churn, score AS probability,
    COALESCE(mean_month_sales, 0) AS mean_month_sales, COALESCE(mean_month_volume, 0) AS mean_month_volume
  FROM scored LEFT JOIN clients USING (client_id)),
losses AS (SELECT *, probability * mean_month_volume * (sqrt(1 / (1 + {value.rate}::DOUBLE))
    * (1 - (1 / (1 + {value.rate}::DOUBLE)) ** {value.months}) / (1 - 1 / (1 + {value.rate}::DOUBLE))) AS expected_loss
  FROM scored_kpis)"""
    money = {"probability", "mean_month_sales", "mean_month_volume", "expected_loss"}
    many = """
many AS (SELECT o_custkey AS client_id, o_orderpriority AS province, o_orderstatus AS account_type,
  CAST(o_orderkey % 5 AS DOUBLE) AS sector FROM orders)"""
    null_parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing FROM raw_features" for c in predictors)
    flags = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FLAG_COLUMNS)
    dummies = ", ".join(
        [f"CAST(COALESCE(province = '{v}', false) AS DOUBLE) AS \"province_{v}\"" for v in PROVINCE_LEVELS]
        + [f"CAST(COALESCE(account_type = '{v}', false) AS DOUBLE) AS \"account_type_{v}\"" for v in ACCOUNT_LEVELS[1:]])
    medians = ", ".join(
        near(f"COALESCE({c}, (SELECT quantile_cont({c}, 0.5) FROM raw_features))") + f" AS {c}" for c in TWO_EVENT_COLUMNS)
    sweep = " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS threshold, {cell_counts(t)} FROM scored"
        for t in ("0.3", "0.4", "0.5", "0.6", "(SELECT t FROM best)"))
    unpivoted = " UNION ALL ".join(
        f"SELECT client_id, '{c}' AS name, {near(f'{c}::DOUBLE')} AS value FROM f" for c in NUMERIC)
    pivot = ", ".join(
        f"COALESCE(max(n) FILTER (definition = '{d}'), 0) AS {f}_n, COALESCE(max(pct) FILTER (definition = '{d}'), 0) AS {f}_pct"
        for f, d in (("left_x3", fv.DEFINITION_X3), ("left_x2", fv.DEFINITION_X2), ("left_60d", fv.DEFINITION_60D)))
    frequency = "client_id, sales_count, CAST(first_sale AS VARCHAR) AS first_sale, CAST(last_sale AS VARCHAR) AS last_sale, " + near("mean_gap") + " AS mean_gap, days_since_last, came_back"
    sale = "client_id, CAST(sale_date AS VARCHAR) AS sale_date, product, status, amount"
    gap_columns = ["client_id", "sales", "days_between_last_two", "gap_deviation", "mean_gap"]

    def every_gap(study: Study) -> str:
        """Gaps of all clients: a cohort as long as the history."""
        return out(
            sales_ctes(study) + f""",
ordered AS (SELECT client_id, sale_date, sale_date - lag(sale_date) OVER (PARTITION BY client_id ORDER BY sale_date) AS gap,
    row_number() OVER (PARTITION BY client_id ORDER BY sale_date) AS place,
    count(*) OVER (PARTITION BY client_id) AS n FROM sales WHERE sale_date <= {day(study.cut)}),
g AS (SELECT client_id, count(*) AS sales, CAST(max(CASE WHEN place = n THEN gap END) AS DOUBLE) AS days_between_last_two,
    stddev_samp(gap) AS gap_deviation, avg(gap) AS mean_gap FROM ordered GROUP BY client_id)""", "g", gap_columns)

    return {
        "sales_scan": f"WITH {SALES_SPARSE} SELECT client_id, CAST(CAST(sold_at AS DATE) AS VARCHAR) AS sold_at, product, status, amount FROM raw_sales",
        "accounts_scan": f"WITH {ACCOUNTS} SELECT * FROM raw_accounts",
        "sales_star_join": """SELECT o_custkey AS client_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS sold_at, p_type AS product,
  o_orderstatus AS status, l_extendedprice AS amount
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN customer ON o_custkey = c_custkey
WHERE l_returnflag <> 'R' AND o_orderstatus <> 'P'""",
        "accounts_star_join": """SELECT DISTINCT o_custkey AS client_id, n_name AS province, c_mktsegment AS account_type, n_regionkey AS sector
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
        "table_summary": summary_sql(sparse + ", f AS MATERIALIZED (SELECT * FROM features)", "f", NUMERIC, 4),
        "text_summary": f"""WITH {sparse}, v AS (SELECT 'province' AS "column", province AS value FROM features
            UNION ALL SELECT 'account_type', account_type FROM features),
            k AS (SELECT "column", value, count(*) AS n FROM v GROUP BY ALL)
            SELECT "column", CAST(COALESCE(sum(n) FILTER (value IS NOT NULL), 0) AS BIGINT) AS present,
            CAST(COALESCE(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS missing, count(value) AS levels,
            first(value ORDER BY n DESC, value) FILTER (value IS NOT NULL) AS top,
            max(n) FILTER (value IS NOT NULL) AS top_rows FROM k GROUP BY "column" """,
        "clean_sales": f"WITH {sales} SELECT {sale} FROM sales",
        "clean_accounts": f"WITH {ACCOUNTS} SELECT * FROM accounts",
        "definition_window": f"WITH {sales} SELECT {sale} FROM sales WHERE sale_date BETWEEN {day(SPARSE.definition_start)} AND {cut}",
        "sales_derived": f"WITH {sales} SELECT {sale}, CAST(isodow(sale_date) AS INTEGER) AS weekday, {CHANNEL} AS channel, CASE WHEN status IS NOT NULL THEN CAST(status = '{fv.APPROVED}' AS BIGINT) END AS approved FROM sales",
        "active_clients": f"WITH {label_ctes(SPARSE)} SELECT client_id FROM active",
        "active_sales": f"WITH {label_ctes(SPARSE)} SELECT {sale} FROM sales SEMI JOIN active USING (client_id) WHERE sale_date <= {cut}",
        "current_cut": f"WITH {sales} SELECT CAST(max(sale_date) AS VARCHAR) AS cut FROM sales",
        "category_levels": f"""WITH {ACCOUNTS}, pairs AS (SELECT DISTINCT 'province' AS "column", province AS level FROM accounts
UNION SELECT DISTINCT 'account_type', account_type FROM accounts)
SELECT "column", level, row_number() OVER (PARTITION BY "column" ORDER BY level) - 1 AS level_index FROM pairs""",
        "dedup_clients": f"""WITH {many} SELECT client_id, province, account_type, sector FROM many
QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY province, account_type, sector) = 1""",
        "client_frequency": f"WITH {definition_ctes(SPARSE)} SELECT {frequency} FROM flagged",
        "churn_definitions": f"WITH {definition_ctes(SPARSE)} SELECT {frequency}, left_x3, left_x2, left_60d FROM flagged",
        "definition_eval": f"WITH {definition_ctes(SPARSE)} SELECT * FROM evaluated",
        "definition_eval_dense": f"WITH {definition_ctes(DENSE)} SELECT * FROM evaluated",
        "definition_pivot": f"WITH {definition_ctes(SPARSE)} SELECT outcome, {pivot} FROM evaluated GROUP BY outcome",
        "client_gaps": every_gap(SPARSE),
        "client_gaps_dense": every_gap(DENSE),
        "feature_history": out(sparse, "raw_features", ["client_id", *HISTORY]),
        "feature_windows": out(sparse, "windowed", ["client_id", *windows]),
        "feature_ratios": out(sparse, "rated", ["client_id", *RATIOS]),
        "feature_context": out(sparse, "raw_features", ["client_id", "province", "account_type", "sector"]),
        "feature_context_fanout": f"WITH {label_ctes(SPARSE)},{many} SELECT client_id, province, account_type, sector FROM active LEFT JOIN many USING (client_id)",
        "churn_label": f"WITH {label_ctes(SPARSE)} SELECT * FROM labels_",
        "churn_label_dense": f"WITH {label_ctes(DENSE)} SELECT * FROM labels_",
        "label_text": f"WITH {label_ctes(SPARSE)} SELECT client_id, CASE churned WHEN 1 THEN 'Si' ELSE 'No' END AS churned FROM labels_",
        "feature_table": out(sparse, "features", table),
        "feature_table_dense": out(all_ctes(DENSE), "features", ["client_id", *dense_predictors, "churned"]),
        "null_report": f"WITH {sparse} SELECT * FROM ({null_parts}) WHERE missing > 0",
        "impute_zero": out(sparse + f""", z AS (SELECT client_id, {", ".join(f"COALESCE({c}, 0) AS {c}" for c in windows)} FROM raw_features)""", "z", ["client_id", *windows]),
        "impute_sentinel": out(sparse, "features", ["client_id", *TWO_EVENT_COLUMNS]),
        "impute_median": f"WITH {sparse} SELECT client_id, {medians} FROM raw_features",
        "class_balance": f"""WITH {split_ctes(SPARSE)}, parts AS (SELECT 'dataset' AS part, churned FROM labels_
UNION ALL SELECT CASE WHEN in_train THEN 'train' ELSE 'test' END, churned FROM split UNION ALL SELECT 'balanced', churned FROM balanced)
SELECT part, churned, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY part), 6) AS share FROM parts GROUP BY part, churned""",
        "features_long": f"WITH {sparse}, f AS MATERIALIZED (SELECT * FROM features) {unpivoted}",
        "feature_histogram": histogram_sql(),
        "feature_correlation": correlation_sql(),
        "corr_pairs": correlation_sql("WHERE abs(CASE WHEN isnan(c) THEN NULL ELSE c END) > 0.9"),
        "corr_screen": f"WITH {screen_ctes()} SELECT variable, kept, round(strength, 6) AS abs_correlation, dropped FROM strong JOIN walk USING (step)",
        "lasso_lambdas": lambdas_sql(),
        "lasso_penalties": lambdas_sql(20),
        "lasso_flag": lasso_flag_sql(),
        "glm_flag": glm_flag_sql(),
        "glm_flag_summary": glm_flag_summary_sql(),
        "tree_stump": stump_sql(),
        "bag_weights": bag_sql(),
        "impurity_by_group": f"""WITH {sparse}, k AS (SELECT account_type, churned, count(*) AS n FROM features GROUP BY ALL),
p AS (SELECT account_type, n, n / sum(n) OVER (PARTITION BY account_type) AS p, (SELECT count(DISTINCT churned) FROM features) AS classes FROM k),
m AS (SELECT account_type, CAST(sum(n) AS BIGINT) AS n, sum(p * (1 - p)) AS gini, -sum(p * log2(p)) AS entropy,
  CASE WHEN max(classes) > 1 THEN -sum(p * log2(p)) / log2(max(classes)) ELSE 0 END * 0.5 AS entropy_scaled FROM p GROUP BY account_type)
SELECT account_type, n, round(gini, 6) AS gini, round(entropy, 6) AS entropy, round(entropy_scaled, 6) AS entropy_scaled,
  round(abs(gini - entropy_scaled), 6) AS difference FROM m""",
        "stratified_split": f"WITH {split_ctes(SPARSE)} SELECT client_id, churned, in_train FROM split",
        "stratified_split_dense": f"WITH {split_ctes(DENSE)} SELECT client_id, churned, in_train FROM split",
        "oversample": f"WITH {split_ctes(SPARSE)} SELECT client_id, churned, copy FROM balanced",
        "oversample_dense": f"WITH {split_ctes(DENSE)} SELECT client_id, churned, copy FROM balanced",
        "balance_weights": f"""WITH {label_ctes(SPARSE)}, k AS (SELECT churned, count(*) AS own, max(count(*)) OVER () AS largest FROM labels_ GROUP BY churned)
SELECT client_id, churned, round(largest / own, 6) AS weight FROM labels_ JOIN k USING (churned)""",
        "kfold": f"""WITH {label_ctes(SPARSE)} SELECT client_id, churned,
CAST((row_number() OVER (PARTITION BY churned ORDER BY {hashed(':fold')}, client_id) - 1) % 5 AS INTEGER) AS fold FROM labels_""",
        "encoded_features": f"WITH {sparse} SELECT client_id, {flags}, sector, {dummies} FROM features",
        "deterministic_score": out(sparse, "scored", ["client_id", "churned", "score"]),
        "confusion": f"WITH {sparse} SELECT {cell_counts('0.5')} FROM scored",
        "classifier_metrics": f"WITH {sparse}, c AS (SELECT {cell_counts('0.5')} FROM scored), {rates_select('c')} SELECT tp, fp, fn, tn, " + ", ".join(f"round({r}, 6) AS {r}" for r in RATES) + " FROM rates",
        "threshold_sweep": f"WITH {roc_ctes(SPARSE)}, best AS ({BEST_CUT}), c AS ({sweep}), {rates_select('c')} SELECT threshold, " + ", ".join(f"round({r}, 6) AS {r}" for r in ("accuracy", "sensitivity", "specificity", "f1_yes")) + " FROM rates",
        "roc_curve": f"WITH {roc_ctes(SPARSE)} SELECT score, round(threshold, 6) AS threshold, tp, fp, round(tp / positives, 6) AS tpr, round(fp / negatives, 6) AS fpr, positives, negatives FROM roc",
        "auc": f"""WITH {roc_ctes(SPARSE)}, b AS (SELECT pos, neg, (sum(neg) OVER () - sum(neg) OVER (ORDER BY score DESC))::DOUBLE AS below FROM points)
SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc FROM b""",
        "youden": f"""WITH {roc_ctes(SPARSE)} SELECT round(COALESCE(threshold, '-infinity'::DOUBLE), 6) AS threshold, round(tp / positives, 6) AS sensitivity,
round(1 - fp / negatives, 6) AS specificity, round(tp / positives - fp / negatives, 6) AS youden
FROM roc ORDER BY tp::HUGEINT * negatives - fp::HUGEINT * positives DESC, roc.threshold NULLS FIRST LIMIT 1""",
        "score_comparison": f"WITH {comparison_ctes()} SELECT CAST(place AS INTEGER) AS place, model, tp, fp, fn, tn, " + ", ".join(near(c) + f" AS {c}" for c in [*METRIC_COLUMNS, "auc", "threshold"]) + " FROM compared",
        "score_leaderboard": f"WITH {comparison_ctes()} SELECT model, " + ", ".join(near(c) + f" AS {c}" for c in LEADERS) + " FROM compared",
        "score_metrics_long": f"WITH {comparison_ctes()} " + " UNION ALL ".join(f"SELECT model, '{c}' AS metric, {near(c)} AS value FROM compared" for c in LEADERS),
        "best_score": f"WITH {comparison_ctes()} SELECT model, " + ", ".join(near(c) + f" AS {c}" for c in LEADERS) + ", 'Usar ' || model || ' para producción' AS recommendation FROM compared ORDER BY compared.auc DESC, place LIMIT 1",
        "client_month": f"WITH {month_ctes(SPARSE)} SELECT client_id, CAST(month AS VARCHAR) AS month, month_sales, {near('month_volume', 4)} AS month_volume FROM months",
        "monthly_client": f"WITH {month_ctes(SPARSE)} SELECT client_id, active_months, total_sales, {near('total_volume', 4)} AS total_volume, {near('mean_month_sales', 6)} AS mean_month_sales, {near('mean_month_volume', 4)} AS mean_month_volume FROM clients",
        "monthly_global": f"WITH {month_ctes(SPARSE)} SELECT {near('avg(mean_month_sales)', 6)} AS mean_sales, {near('avg(mean_month_volume)', 4)} AS mean_volume FROM clients",
        "score_features": out(scoring, "features", ["client_id", *predictors]),
        "score_kpis": out(loss, "scored_kpis", ["client_id", "churn", *sorted(money - {"expected_loss"})], money, 4),
        "expected_loss": out(loss, "losses", ["client_id", "churn", *sorted(money)], money, 4),
        "expected_loss_total": f"WITH {loss} SELECT round(COALESCE(sum(expected_loss), 0), 2) AS total_expected_loss FROM losses",
        "kpi_summary": summary_sql(loss, "scored_kpis", ["probability", "mean_month_sales", "mean_month_volume"], 4),
        "score_summary": f"WITH {loss} SELECT count(*) AS clients, count(*) FILTER (churn = 1) AS predicted_to_leave, round(count(*) FILTER (churn = 1) * 100.0::DOUBLE / count(*), 2) AS percent FROM scored_kpis",
    }
