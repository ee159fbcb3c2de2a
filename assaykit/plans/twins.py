"""The same queries as DuckDB SQL over the supplied tables."""

from __future__ import annotations

from assaykit.config import RETAIL_COLUMNS

COLUMNS = list(RETAIL_COLUMNS)
TRANSFORMED = [*COLUMNS, "IsCancellation", "Revenue"]
NAME = "online_retail_quality_pipeline"
DATE = r"'^\d{4}-\d{2}-\d{2}T'"


def _q(name: str) -> str:
    return f'"{name}"'


def retail(faulty: bool = False) -> str:
    """CTEs ``base`` and ``retail``; ``run_id`` is the shipping month."""
    adj = "(l_returnflag <> 'R' AND l_orderkey % 50 = 7)"
    quantity = "CASE WHEN l_returnflag = 'R' OR l_orderkey % 50 = 7 THEN -l_quantity ELSE l_quantity END"
    price = f"CASE WHEN {adj} THEN 0.0::double ELSE p_retailprice END"
    date = "strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')"
    if faulty:
        quantity = f"CASE WHEN l_orderkey % 499 = 1 THEN 0 ELSE {quantity} END"
        date = f"CASE WHEN l_orderkey % 499 = 2 THEN 'not-a-date' ELSE {date} END"
        price = f"CASE WHEN l_orderkey % 499 = 3 THEN -p_retailprice ELSE {price} END"
    return f"""base AS MATERIALIZED (
  SELECT l_orderkey,
    (CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END) || CAST(l_orderkey AS VARCHAR) AS "InvoiceNo",
    CAST(l_partkey AS VARCHAR) AS "StockCode",
    CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE p_name END AS "Description",
    CAST({quantity} AS BIGINT) AS "Quantity",
    {date} AS "InvoiceDate",
    {price} AS "UnitPrice",
    CASE WHEN o_custkey % 4 = 0 OR {adj} THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS "CustomerID",
    n_name AS "Country",
    CAST((year(l_shipdate) - 1970) * 12 + month(l_shipdate) AS BIGINT) AS run_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
retail AS (
  SELECT * EXCLUDE (l_orderkey) FROM base
  UNION ALL SELECT * EXCLUDE (l_orderkey) FROM base WHERE l_orderkey % 101 = 3)"""


TRANSFORM = """transformed AS (
  SELECT *, starts_with("InvoiceNo", 'C') AS "IsCancellation", "Quantity" * "UnitPrice" AS "Revenue" FROM retail)"""

SNAPSHOT = """snapshot AS (
  SELECT "InvoiceNo" AS invoice_no, "StockCode" AS stock_code, "Description" AS description,
    CAST("Quantity" AS DOUBLE) AS quantity, "InvoiceDate" AS invoice_date, "UnitPrice" AS unit_price,
    "CustomerID" AS customer_id, "Country" AS country, CAST("IsCancellation" AS BIGINT) AS is_cancellation,
    "Revenue" AS revenue FROM transformed)"""

NEGATIVE = '"Quantity" < 0'
CANCELLED = """starts_with("InvoiceNo", 'C')"""
ADJUSTED = f'({NEGATIVE} AND NOT {CANCELLED} AND "UnitPrice" = 0 AND "CustomerID" IS NULL)'
RULES = {
    "price_negative": '"UnitPrice" < 0',
    "price_zero": '"UnitPrice" = 0',
    "quantity_zero": '"Quantity" = 0',
    "cancelled": CANCELLED,
    "adjustment": ADJUSTED,
    "negative_sale": f"{NEGATIVE} AND NOT {CANCELLED} AND NOT {ADJUSTED}",
    "positive_cancellation": f"{CANCELLED} AND NOT ({NEGATIVE})",
    "bad_date": f'"InvoiceDate" IS NOT NULL AND NOT regexp_matches("InvoiceDate", {DATE})',
}


def metrics(source: str, columns: list[str], batch: bool) -> str:
    """CTE ``metrics``: one row per run (or run 0) with every count."""
    run = "run_id" if batch else "0"
    nulls = ", ".join(f'count(*) FILTER (WHERE {_q(c)} IS NULL) AS {_q("null_" + c)}' for c in columns)
    rules = ", ".join(f"count(*) FILTER (WHERE {p}) AS {n}" for n, p in RULES.items())
    listed = ", ".join(_q(c) for c in columns)
    return f"""keyed AS (SELECT {listed}, {run} AS run_id FROM {source}),
different AS (SELECT run_id, count(*) AS kept FROM (SELECT DISTINCT * FROM keyed) GROUP BY run_id),
metrics AS MATERIALIZED (
  SELECT run_id, n, n - kept AS repeats, * EXCLUDE (run_id, n, kept) FROM (
    SELECT run_id, count(*) AS n, {nulls}, {rules} FROM keyed GROUP BY run_id) JOIN different USING (run_id))"""


def _pct(count: str) -> str:
    return f"round({count} / n * 100, 2)"


def _case(name: str, category: str, branches: list[tuple[str | None, str, str, str, str]]) -> tuple:
    """(name, category, [(condition, status, severity, message SQL, count SQL)])."""
    return name, category, branches


def _rules(columns: list[str], expected: list[str]) -> list[tuple]:
    extra = sorted(set(columns) - set(expected))
    rules = [_case("column_presence", "schema", [(None, "PASS", "INFO", "'All expected columns are present.'", "0")])]
    if extra:
        shown = str(extra).replace("'", "''")
        rules.append(_case("unexpected_columns", "schema", [(
            None, "INFO", "LOW", f"'{len(extra)} unexpected column(s) found: {shown}. "
            "These may indicate schema drift or intentional additions.'", "0")]))
    else:
        rules.append(_case("unexpected_columns", "schema", [
            (None, "PASS", "INFO", "'No unexpected columns detected.'", "0")]))
    rules.append(_case("dtype_compatibility", "schema", [
        (None, "PASS", "INFO", "'All column data types match expectations.'", "0")]))
    policy = {"CustomerID": ("INFO", "INFO", " This is expected for guest transactions."),
              "Description": ("WARNING", "LOW", "")}
    for c in columns:
        status, severity, remark = policy.get(c, ("FAIL", "HIGH", ""))
        n = _q("null_" + c)
        rules.append(_case(f"{c}_completeness", "completeness", [
            (f"{n} = 0", "PASS", "INFO", f"'{c} is 100% complete.'", "0"),
            (None, status, severity, f"'{c} is missing ' || {n} || ' values (' || {_pct(n)} || '%).{remark}'", n)]))
    rules.append(_case("unit_price_validity", "validity", [
        ("price_negative > 0", "FAIL", "HIGH",
         "'UnitPrice is negative in ' || price_negative || ' rows. Prices must be >= 0.'", "price_negative"),
        ("price_zero > 0", "WARNING", "LOW",
         "'UnitPrice is zero in ' || price_zero || ' rows. This may indicate free items or missing data.'",
         "price_zero"),
        (None, "PASS", "INFO", "'All UnitPrice values are > 0.'", "0")]))
    rules.append(_case("quantity_zero", "validity", [
        ("quantity_zero > 0", "FAIL", "MEDIUM",
         "'Quantity is zero in ' || quantity_zero || ' rows. Transactions must have non-zero quantity.'",
         "quantity_zero"),
        (None, "PASS", "INFO", "'No zero-quantity rows found.'", "0")]))
    rules.append(_case("quantity_cancellation_logic", "validity", [
        ("negative_sale + positive_cancellation > 0", "FAIL", "HIGH",
         "'Found ' || negative_sale || ' negative quantities without ''C'' invoice prefix, and ' || "
         "positive_cancellation || ' ''C'' invoices without negative quantity.'",
         "(negative_sale + positive_cancellation)"),
        ("adjustment > 0", "WARNING", "MEDIUM",
         "'Found ' || adjustment || ' negative, zero-price rows without a ''C'' invoice prefix. "
         "They match an administrative-adjustment pattern and should be investigated.'", "adjustment"),
        (None, "PASS", "INFO",
         "'Cancellation logic is consistent. Found ' || cancelled || ' valid cancellations.'", "0")]))
    rules.append(_case("invoice_date_validity", "validity", [
        ("bad_date > 0", "FAIL", "HIGH",
         "'Failed to parse ' || bad_date || ' InvoiceDate values as datetimes.'", "bad_date"),
        (None, "PASS", "INFO", "'All InvoiceDate values parsed successfully.'", "0")]))
    rules.append(_case("duplicate_rows", "uniqueness", [
        ("repeats = 0", "PASS", "INFO", "'No duplicate rows found.'", "0"),
        (None, "WARNING", "MEDIUM",
         f"'Found ' || repeats || ' exact duplicate rows (' || {_pct('repeats')} || '%).'", "repeats")]))
    return rules


def found(columns: list[str] = COLUMNS) -> str:
    """CTE ``found``: the findings of every run."""
    selects = []
    for order, (name, category, branches) in enumerate(_rules(columns, COLUMNS)):
        def choose(position: int, text: bool = False, branches=branches) -> str:
            value = [f"'{b[position]}'" if text else b[position] for b in branches]
            if len(branches) == 1:
                return value[0]
            whens = " ".join(f"WHEN {b[0]} THEN {v}" for b, v in zip(branches[:-1], value[:-1]))
            return f"CASE {whens} ELSE {value[-1]} END"
        count = choose(4)
        selects.append(
            f"SELECT run_id, CAST({order} AS BIGINT) AS check_order, '{name}' AS check_name, '{category}' AS category,"
            f" {choose(1, True)} AS status, {choose(2, True)} AS severity, {choose(3)} AS message,"
            f" CAST({count} AS BIGINT) AS affected_rows, CAST({_pct('(' + count + ')')} AS DOUBLE)"
            " AS affected_percentage FROM metrics")
    return "found AS MATERIALIZED (\n" + "\nUNION ALL ".join(selects) + ")"


SCORES = """weights AS (SELECT unnest(['completeness', 'validity', 'uniqueness', 'schema', 'business_rules']) AS dimension),
graded AS (SELECT *, CASE WHEN status IN ('PASS', 'INFO') THEN 1.0::double WHEN status = 'WARNING' THEN 0.5::double
  ELSE 0.0::double END AS points,
  CASE WHEN check_name = 'quantity_cancellation_logic' THEN 'business_rules' ELSE category END AS dimension FROM found),
dimensions AS (SELECT run_id, dimension, round(sum(points) / count(*) * 20.0, 2) AS score, 20.0::double AS max_score,
  CAST(sum(points) AS VARCHAR) || '/' || count(*) || ' rule points earned.' AS details,
  string_agg(check_name || ':' || status || ':' || CAST(points AS VARCHAR), ',' ORDER BY check_order) AS included_checks
  FROM graded JOIN weights USING (dimension) GROUP BY run_id, dimension),
scores AS MATERIALIZED (SELECT run_id, n AS total_rows, repeats AS duplicate_rows, health_score,
  CASE WHEN health_score >= 90 THEN 'Healthy' WHEN health_score >= 75 THEN 'Warning'
    WHEN health_score >= 50 THEN 'Poor' ELSE 'Critical' END AS health_label,
  CASE WHEN health_score >= 90 THEN 'Excellent' WHEN health_score >= 75 THEN 'Good'
    WHEN health_score >= 50 THEN 'Poor' ELSE 'Critical' END AS dashboard_label
  FROM (SELECT run_id, round(sum(score), 2) AS health_score FROM dimensions GROUP BY run_id)
  JOIN metrics USING (run_id))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


CLEAN = _with(retail())
FAULTY = _with(retail(True))
CHECKED = _with(retail(), metrics("retail", COLUMNS, False), found(), SCORES)
CHECKED_FAULTY = _with(retail(True), metrics("retail", COLUMNS, False), found(), SCORES)
CHECKED_TRANSFORMED = _with(
    retail(), TRANSFORM, metrics("transformed", TRANSFORMED, False), found(TRANSFORMED), SCORES)
MARTS = _with(retail(), TRANSFORM, SNAPSHOT)
RUNS = f"""runs AS (SELECT run_id, '{NAME}' AS pipeline_name,
    TIMESTAMP '1970-01-01 00:00:00' + to_months(CAST(run_id - 1 AS INTEGER)) AS started,
    TIMESTAMP '1970-01-01 00:00:00' + to_months(CAST(run_id - 1 AS INTEGER)) + to_milliseconds(total_rows) AS finished,
    total_rows / 1000.0::double AS duration_seconds, 'COMPLETED' AS status, total_rows AS rows_processed,
    health_score FROM scores),
run_rows AS (SELECT run_id, pipeline_name, strftime(started, '%Y-%m-%dT%H:%M:%S') AS started_at,
    strftime(finished, '%Y-%m-%dT%H:%M:%S') AS finished_at, duration_seconds, status, rows_processed, health_score
    FROM runs),
result_rows AS (SELECT run_id * 1000000 + check_order + 1 AS result_id, * FROM found)"""
HISTORY = _with(retail(True), metrics("retail", COLUMNS, True), found(), SCORES, RUNS)

FINDINGS = """SELECT check_order, check_name, category, status, severity, message, affected_rows,
  affected_percentage FROM found"""
RESULT = """result_id, run_id, check_name, category, status, severity, message, affected_rows, affected_percentage"""
LATEST = "run_id = (SELECT max(run_id) FROM runs)"
SCORE_ROW = "SELECT total_rows, duplicate_rows, health_score, health_label, dashboard_label FROM scores"
DIMENSION_ROWS = "SELECT dimension, score, max_score, details, included_checks FROM dimensions"
PROFILED = {"InvoiceNo": "string", "StockCode": "string", "Description": "string", "Quantity": "bigint",
            "InvoiceDate": "string", "UnitPrice": "double", "CustomerID": "double", "Country": "string"}


def _per_column(template: str, columns: dict[str, str] | list[str]) -> str:
    return "\nUNION ALL ".join(template.format(c=_q(c), name=c, position=i) for i, c in enumerate(columns))


def _numeric(columns: list[str], source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS name, round(min({_q(c)})::double, 4) AS min, round(max({_q(c)})::double, 4) AS max,"
        f" round(avg({_q(c)}), 4) AS mean, round(stddev_samp({_q(c)}), 4) AS std,"
        f" round(median({_q(c)})::double, 4) AS median FROM {source}" for c in columns)


SAMPLES = """SELECT '{name}' AS name, rank, CAST(v AS VARCHAR) AS value FROM (
  SELECT v, row_number() OVER (ORDER BY v) AS rank FROM (SELECT DISTINCT {c} AS v FROM retail WHERE {c} IS NOT NULL))
  WHERE rank <= 5"""
DELTA = """SELECT run_id, pipeline_name, health_score, previous_score, score_delta,
  CASE WHEN score_delta > 0 THEN '↑' WHEN score_delta < 0 THEN '↓' WHEN score_delta = 0 THEN '→' END AS direction
  FROM (SELECT *, round(health_score - previous_score, 2) AS score_delta FROM (SELECT run_id, pipeline_name,
  health_score, lag(health_score) OVER (ORDER BY run_id) AS previous_score FROM runs))"""
TAILS = "WITH tails AS (SELECT l_extendedprice * l_extendedprice * l_extendedprice AS cubed," \
    " CASE WHEN l_orderkey % 499 = 1 THEN 'infinity'::double WHEN l_orderkey % 499 = 2 THEN '-infinity'::double" \
    " WHEN l_orderkey % 499 = 3 THEN 1e300 WHEN l_orderkey % 499 = 4 THEN -1e300 ELSE l_extendedprice END AS outliers," \
    " 1.0::double / (1 + l_orderkey) AS reciprocal FROM lineitem)\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS name, avg(v) AS median FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS r,"
        f" count(*) OVER () AS n FROM tails) WHERE r IN ((n + 1) // 2, n // 2 + 1)" for c in ("cubed", "outliers", "reciprocal"))
MONEY = "CAST(sum(CAST({c} AS DECIMAL(18,4))) AS DOUBLE)"
PRODUCTS = f"""SELECT stock_code, max(description) AS description, {MONEY.format(c='quantity')} AS quantity,
  {MONEY.format(c='revenue')} AS revenue FROM snapshot GROUP BY stock_code ORDER BY revenue DESC, stock_code LIMIT 10"""
DRIFT = [
    ("column_presence", "FAIL", "CRITICAL",
     "1 expected column(s) are missing: ['CustomerID']. Downstream checks will be unreliable.", "count(*)", "100.0"),
    ("unexpected_columns", "WARNING", "MEDIUM",
     "4 unexpected column(s) found: ['Batch', 'Channel', 'Region', 'Store']. "
     "These may indicate schema drift or intentional additions.", "0", "0.0"),
    ("dtype_compatibility", "WARNING", "MEDIUM",
     "1 column(s) have unexpected data types. This may cause arithmetic or join operations to fail.", "0", "0.0"),
]
GATE = ["completeness", "validity", "uniqueness", "schema", "business_rules"]


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TWINS: dict[str, str] = {
    "health_score": CHECKED + SCORE_ROW,
    "health_score_faulty": CHECKED_FAULTY + SCORE_ROW,
    "health_score_digest": CHECKED + SCORE_ROW,
    "category_scores_clean": CHECKED + DIMENSION_ROWS,
    "category_scores_faulty": CHECKED_FAULTY + DIMENSION_ROWS,
    "quality_results": CHECKED + FINDINGS,
    "quality_results_faulty": CHECKED_FAULTY + FINDINGS,
    "quality_results_transformed": CHECKED_TRANSFORMED + FINDINGS,
    "quality_summary": CHECKED_FAULTY + """SELECT (SELECT n FROM metrics) AS total_rows, count(*) AS total_checks,
        count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARNING') AS warnings,
        count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'INFO') AS info FROM found""",
    "quality_records": CHECKED_FAULTY + """SELECT check_name, affected_percentage, affected_percentage AS affected_pct,
        CAST(status = 'PASS' AS BIGINT) AS passed, CAST(status = 'FAIL' AS BIGINT) AS failed FROM found""",
    "acceptable_checks": CHECKED + """SELECT category, count(*) AS checks, count(*) FILTER (WHERE status = 'PASS') AS passed,
        count(*) FILTER (WHERE status IN ('PASS', 'INFO')) AS acceptable FROM found GROUP BY category""",
    "schema_check": CLEAN + "\nUNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS check_order, '{name}' AS check_name, 'schema' AS category, '{status}' AS status,"
        f" '{severity}' AS severity, {_sql_text(message)} AS message, CAST({rows} AS BIGINT) AS affected_rows,"
        f" CAST({pct} AS DOUBLE) AS affected_percentage FROM {'retail' if rows != '0' else '(SELECT 1)'}"
        for i, (name, status, severity, message, rows, pct) in enumerate(DRIFT)),
    "critical_gate": f"""SELECT 0.0::double AS health_score, 'Critical' AS health_label,
        'CRITICAL SCHEMA FAILURE' AS failure_reason, dimension, 0.0::double AS score, 20.0::double AS max_score,
        'CRITICAL SCHEMA FAILURE' AS details FROM (SELECT unnest({GATE}) AS dimension)
        WHERE (SELECT count(*) FROM lineitem) > 0""",
    "completeness": CLEAN + _per_column(
        "SELECT '{name}' AS name, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS missing_count,"
        " round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 2) AS missing_percentage FROM retail", COLUMNS),
    "validity_counts": CHECKED_FAULTY + f"SELECT n AS total_rows, {', '.join(RULES)} FROM metrics",
    "duplicates": CHECKED + "SELECT n AS total_rows, repeats AS duplicate_rows FROM metrics",
    "duplicates_exact": CHECKED + "SELECT n AS total_rows, repeats AS duplicate_rows FROM metrics",
    "duplicates_digest": CHECKED + "SELECT n AS total_rows, repeats AS duplicate_rows FROM metrics",
    "adjustments": CLEAN + f"""SELECT "Country" AS country, count(*) AS adjustment_rows FROM retail
        WHERE {ADJUSTED} GROUP BY 1""",
    "custom_checks": CHECKED + FINDINGS + """
        UNION ALL SELECT 16, 'bulk_orders', 'validity', 'WARNING', 'LOW', b || ' rows have 45 units or more.', b,
          round(b / n * 100, 2) FROM (SELECT count(*) FILTER (WHERE "Quantity" >= 45) AS b, count(*) AS n FROM retail)
          WHERE b > 0
        UNION ALL SELECT 17, 'country_concentration', 'validity', CASE WHEN top * 2 > total THEN 'WARNING' ELSE 'PASS' END,
          'LOW', 'Largest country has ' || top || ' rows.', top, round(top / total * 100, 2) FROM (
          SELECT max(n) AS top, CAST(sum(n) AS BIGINT) AS total FROM (
            SELECT count(*) AS n FROM retail GROUP BY "Country"))""",
    "isolated_failure": CHECKED + """SELECT CASE WHEN check_order >= 11 THEN check_order + 1 ELSE check_order END
          AS check_order, check_name, category, status, severity, message, affected_rows, affected_percentage FROM found
        UNION ALL SELECT 11, 'TariffCheck', 'validity', 'FAIL', 'CRITICAL',
          'The check could not run: rule file is missing', n, 100.0 FROM metrics""",
    "profile_overview": CLEAN + """SELECT rows, CAST(8 AS BIGINT) AS columns,
          'InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country' AS column_names,
          data_bytes, round(data_bytes / 1024 / 1024, 2) AS data_mb FROM (
          SELECT count(*) AS rows, CAST(24 * count(*) + sum(strlen("InvoiceNo") + strlen("StockCode")
            + coalesce(strlen("Description"), 0) + strlen("InvoiceDate") + strlen("Country")) AS BIGINT) AS data_bytes
          FROM retail)""",
    "dataset_structure": CLEAN + "\nUNION ALL ".join(
        f"SELECT count(*) AS rows, CAST({i} AS BIGINT) AS position, '{n}' AS name, '{t}' AS dtype, "
        + (f"CAST(sum(strlen({_q(n)})) AS BIGINT)" if t == "string" else "count(*) * 8") + " AS data_bytes FROM retail"
        for i, (n, t) in enumerate(PROFILED.items())),
    "profile_columns": CLEAN + "\nUNION ALL ".join(
        f"""SELECT '{n}' AS name, '{t}' AS dtype, count(*) FILTER (WHERE {_q(n)} IS NULL) AS null_count,
          round(count(*) FILTER (WHERE {_q(n)} IS NULL) / count(*) * 100, 2) AS null_percentage,
          count(DISTINCT {_q(n)}) AS unique_count,
          (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) FROM (SELECT DISTINCT {_q(n)} AS v FROM retail
            WHERE {_q(n)} IS NOT NULL ORDER BY v LIMIT 5)) AS sample_values FROM retail"""
        for n, t in PROFILED.items()),
    "profile_samples": FAULTY + _per_column(SAMPLES, COLUMNS),
    "profile_numeric": CLEAN + _numeric(["Quantity", "UnitPrice", "CustomerID"], "retail"),
    "profile_numeric_prices": _numeric(["l_extendedprice", "l_discount", "l_orderkey"], "lineitem"),
    "profile_numeric_tails": TAILS,
    "profile_missing": CLEAN + f"""SELECT CAST(missing AS BIGINT) AS total_missing_cells,
          round(missing / (n * 8) * 100, 2) AS total_missing_percentage,
          CAST(affected AS BIGINT) AS columns_with_missing FROM (
          SELECT count(*) AS n, {' + '.join(f'count(*) FILTER (WHERE {_q(c)} IS NULL)' for c in COLUMNS)} AS missing,
          {' + '.join(f'CAST(count(*) FILTER (WHERE {_q(c)} IS NULL) > 0 AS INTEGER)' for c in COLUMNS)} AS affected
          FROM retail)""",
    "profile_missing_columns": CLEAN + "SELECT * FROM (" + _per_column(
        "SELECT '{name}' AS name, count(*) FILTER (WHERE {c} IS NULL) AS missing_count,"
        " round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 2) AS missing_percentage FROM retail",
        COLUMNS) + ") WHERE missing_count > 0",
    "profile_duplicates": CHECKED + f"""SELECT repeats AS duplicate_row_count, {_pct('repeats')} AS duplicate_percentage,
          n - repeats AS unique_rows FROM metrics""",
    "profile_dates": FAULTY + f"""SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS earliest_date,
          strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS latest_date, date_sub('day', min(ts), max(ts)) AS date_span_days,
          (SELECT count(*) FROM retail) - CAST(sum(rows) AS BIGINT) AS invalid_dates,
          min(rows) AS min_transactions_per_day, max(rows) AS max_transactions_per_day,
          round(avg(rows), 1) AS mean_transactions_per_day, count(*) AS total_trading_days FROM (
          SELECT CAST(strptime("InvoiceDate", '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP) AS ts, count(*) AS rows FROM retail
          WHERE regexp_matches("InvoiceDate", {DATE}) GROUP BY 1)""",
    "mixed_dates": """SELECT l_orderkey % 8 AS layout, count(*) AS rows, CAST(0 AS BIGINT) AS bad_dates,
          CAST(0 AS BIGINT) AS wrong_dates, strftime(min(l_shipdate), '%Y-%m-%dT%H:%M:%S') AS earliest,
          strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%S') AS latest FROM lineitem GROUP BY 1""",
    "profile_daily_volume": CLEAN + """SELECT substr("InvoiceDate", 1, 10) AS day, count(*) AS rows
          FROM retail GROUP BY 1""",
    "profile_business": FAULTY + f"""SELECT count(DISTINCT "CustomerID") AS unique_customers,
          count(*) FILTER (WHERE "CustomerID" IS NULL) AS rows_without_customer_id,
          count(DISTINCT "StockCode") AS unique_products, count(DISTINCT "Country") AS unique_countries,
          count(DISTINCT "InvoiceNo") AS unique_invoices, count(*) FILTER (WHERE {CANCELLED}) AS cancellation_invoices,
          round(count(*) FILTER (WHERE {CANCELLED}) / count(*) * 100, 2) AS cancellation_percentage,
          count(*) FILTER (WHERE {NEGATIVE}) AS negative_quantity_rows,
          count(*) FILTER (WHERE "Quantity" = 0) AS zero_quantity_rows,
          count(*) FILTER (WHERE {NEGATIVE} AND NOT {CANCELLED}) AS negative_on_non_cancellation,
          min("Quantity") AS min_quantity, max("Quantity") AS max_quantity,
          count(*) FILTER (WHERE "UnitPrice" = 0) AS zero_price_rows,
          count(*) FILTER (WHERE "UnitPrice" < 0) AS negative_price_rows,
          round(min("UnitPrice"), 2) AS min_price, round(max("UnitPrice"), 2) AS max_price,
          round(avg("UnitPrice"), 2) AS mean_price FROM retail""",
    "profile_top_countries": CLEAN + """SELECT "Country" AS country, count(*) AS rows FROM retail
          WHERE "Country" IS NOT NULL GROUP BY 1 ORDER BY rows DESC, country LIMIT 5""",
    "profile_flags": CLEAN + """, drifted AS (SELECT "InvoiceNo", "StockCode", "Description", "Quantity",
            "InvoiceDate", "UnitPrice", "Country" FROM retail),
          copies AS (SELECT (SELECT count(*) FROM drifted) - count(*) AS d FROM (SELECT DISTINCT * FROM drifted))
          SELECT 'DUPLICATE_ROWS_DETECTED' AS flag, 'WARNING' AS severity,
            format('{:,}', d) || ' fully duplicate rows found.' AS message, NULL::VARCHAR AS note FROM copies WHERE d > 0
          UNION ALL SELECT 'MISSING_EXPECTED_COLUMNS', 'CRITICAL', 'Expected columns not found: [''CustomerID'']', NULL
          UNION ALL SELECT 'UNEXPECTED_EXTRA_COLUMNS', 'INFO',
            'Extra columns present: [''Batch'', ''Channel'', ''Region'', ''Store'']', NULL""",
    "profile_flags_clean": CHECKED + """SELECT 'HIGH_MISSING_CUSTOMER_ID' AS flag, 'WARNING' AS severity,
            format('{:.1f}', "null_CustomerID" / n * 100) || '% of rows have no CustomerID.' AS message,
            'This is expected for guest purchases in retail data.' AS note FROM metrics
            WHERE "null_CustomerID" / n * 100 > 20
          UNION ALL SELECT 'DUPLICATE_ROWS_DETECTED', 'WARNING',
            format('{:,}', repeats) || ' fully duplicate rows found.', NULL FROM metrics WHERE repeats > 0""",
    "transform_retail": _with(retail(), TRANSFORM) + """SELECT * EXCLUDE (run_id)
          REPLACE (CAST("IsCancellation" AS BIGINT) AS "IsCancellation") FROM transformed""",
    "transform_problems": CHECKED_FAULTY + """SELECT CAST(0 AS BIGINT) AS "bad_Quantity",
          CAST(0 AS BIGINT) AS "bad_UnitPrice", bad_date AS "bad_InvoiceDate" FROM metrics""",
    "snapshot_rows": MARTS + "SELECT * FROM snapshot",
    "kpi_summary": MARTS + f"""SELECT count(*) AS total_rows, count(DISTINCT invoice_no) AS invoices,
          count(DISTINCT stock_code) AS products, count(DISTINCT country) AS countries,
          {MONEY.format(c='revenue')} AS total_revenue,
          count(*) FILTER (WHERE is_cancellation = 1) AS cancellation_rows FROM snapshot""",
    "monthly_revenue": MARTS + f"""SELECT substr(invoice_date, 1, 7) || '-01' AS month,
          {MONEY.format(c='revenue')} AS revenue FROM snapshot GROUP BY 1""",
    "top_products": MARTS + PRODUCTS,
    "product_labels": MARTS + f"""SELECT stock_code || ' — ' || coalesce(description, 'Unknown') AS label, revenue
          FROM ({PRODUCTS})""",
    "country_revenue": MARTS + f"""SELECT country, {MONEY.format(c='revenue')} AS revenue FROM snapshot
          WHERE country IS NOT NULL GROUP BY country ORDER BY revenue DESC, country LIMIT 15""",
    "cancellation_rate": MARTS + """SELECT count(*) AS total_rows, CAST(sum(is_cancellation) AS BIGINT) AS cancellation_rows,
          CAST(sum(is_cancellation) AS DOUBLE) / count(*) * 100 AS cancellation_rate FROM snapshot""",
    "sql_query": MARTS + """SELECT country, count(*) AS sales, CAST(sum(quantity) AS BIGINT) AS units FROM snapshot
          WHERE quantity >= 10 AND is_cancellation = 0 GROUP BY country""",
    "batch_scores": HISTORY + "SELECT run_id, total_rows, duplicate_rows, health_score, health_label FROM scores",
    "batch_category_scores": HISTORY + "SELECT run_id, dimension, score, max_score, details FROM dimensions",
    "batch_summary": HISTORY + """SELECT run_id, n AS total_rows, count(*) AS total_checks,
          count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARNING') AS warnings,
          count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'INFO') AS info
          FROM found JOIN metrics USING (run_id) GROUP BY run_id, n""",
    "rescored_runs": HISTORY + "SELECT run_id, health_score, health_label FROM scores",
    "all_runs": HISTORY + "SELECT * FROM run_rows",
    "run_history": HISTORY + "SELECT * EXCLUDE (finished_at) FROM run_rows",
    "latest_run": HISTORY + "SELECT * FROM run_rows ORDER BY run_id DESC LIMIT 1",
    "latest_run_info": HISTORY + """, last AS (SELECT * FROM runs ORDER BY run_id DESC LIMIT 1)
          SELECT 'Run ID' AS metric, CAST(run_id AS VARCHAR) AS value FROM last
          UNION ALL SELECT 'Pipeline', pipeline_name FROM last UNION ALL SELECT 'Status', status FROM last
          UNION ALL SELECT 'Rows Processed', format('{:,}', rows_processed) FROM last
          UNION ALL SELECT 'Duration', format('{:.2f}', duration_seconds) || ' sec' FROM last
          UNION ALL SELECT 'Health Score', format('{:.2f}', health_score) || '/100' FROM last""",
    "recent_runs": HISTORY + "SELECT * FROM run_rows ORDER BY run_id DESC LIMIT 10",
    "score_history": HISTORY + "SELECT * FROM run_rows ORDER BY run_id DESC LIMIT 30",
    "score_trend": HISTORY + """SELECT run_id, started_at, health_score, dashboard_label AS label, 'healthy' AS state
          FROM run_rows JOIN (SELECT run_id, dashboard_label FROM scores) USING (run_id)""",
    "score_delta": HISTORY + DELTA,
    "score_delta_by_name": HISTORY + DELTA,
    "run_series": HISTORY + "SELECT run_id, duration_seconds, rows_processed FROM runs",
    "result_log": HISTORY + f"SELECT {RESULT} FROM result_rows",
    "results_of_run": HISTORY + f"SELECT {RESULT} FROM result_rows WHERE run_id = 320",
    "failed_checks": HISTORY + f"SELECT {RESULT} FROM result_rows WHERE status = 'FAIL'",
    "warning_checks": HISTORY + f"SELECT {RESULT} FROM result_rows WHERE status = 'WARNING' AND run_id = 320",
    "check_details": HISTORY + f"""SELECT check_name, category, status, severity, affected_rows, affected_percentage,
          message FROM found WHERE {LATEST}""",
    "attention": HISTORY + f"""SELECT status, check_name, message, result_id FROM result_rows
          WHERE {LATEST} AND status IN ('FAIL', 'WARNING')""",
    "status_mix": HISTORY + f"SELECT status, count(*) AS count FROM found WHERE {LATEST} GROUP BY status",
    "category_status": HISTORY + f"""SELECT category, status, count(*) AS checks FROM found WHERE {LATEST}
          GROUP BY category, status""",
    "latest_cards": HISTORY + f"""SELECT count(*) AS total_checks, count(*) FILTER (WHERE status = 'FAIL') AS failures,
          count(*) FILTER (WHERE status = 'WARNING') AS warnings FROM found WHERE {LATEST}""",
    "results_per_run": HISTORY + "SELECT run_id, count(*) AS results_stored FROM found GROUP BY run_id",
    "runs_with_results": HISTORY + """SELECT run_id, rows_processed, health_score, quality_results FROM runs JOIN (
          SELECT run_id, string_agg(check_name || ':' || status, ',' ORDER BY check_order) AS quality_results
          FROM found GROUP BY run_id) USING (run_id)""",
    "run_results": HISTORY + """SELECT result_id, run_id, pipeline_name, r.status AS run_status, health_score,
          check_name, f.status FROM result_rows f JOIN runs r USING (run_id)""",
    "orphan_results": HISTORY + """SELECT run_id, count(*) AS results FROM found WHERE run_id IN (
          SELECT run_id FROM runs WHERE run_id % 7 = 0) GROUP BY run_id""",
    "runs_after_removal": HISTORY + """SELECT run_id, rows_processed, health_score FROM runs
          WHERE run_id % 7 <> 0""",
    "run_contracts": HISTORY + """SELECT count(*) FILTER (WHERE duration_seconds < 0) AS duration_negative,
          count(*) FILTER (WHERE rows_processed < 0) AS rows_negative,
          count(*) FILTER (WHERE health_score NOT BETWEEN 0 AND 100) AS score_out_of_range,
          count(*) FILTER (WHERE health_score IS NULL) AS run_nulls FROM runs""",
    "result_contracts": HISTORY + """SELECT count(*) FILTER (WHERE affected_rows < 0) AS rows_negative,
          count(*) FILTER (WHERE affected_percentage NOT BETWEEN 0 AND 100) AS percentage_out_of_range,
          count(*) FILTER (WHERE status NOT IN ('PASS', 'WARNING', 'FAIL', 'INFO')) AS unknown_status,
          count(*) FILTER (WHERE severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO')) AS unknown_severity,
          count(*) FILTER (WHERE message IS NULL) AS result_nulls FROM found""",
    "etl_snapshot": MARTS + "SELECT * FROM snapshot",
    "etl_run": CHECKED_TRANSFORMED + """SELECT CAST(1 AS BIGINT) AS run_id, 'online_retail_etl' AS pipeline_name,
          'SUCCESS' AS status, 'healthy' AS state, total_rows AS rows_processed, health_score,
          (SELECT count(*) FROM found) AS results_stored,
          (SELECT count(*) FROM found WHERE status = 'FAIL') AS quality_failures,
          (SELECT count(*) FROM found WHERE status = 'WARNING') AS quality_warnings FROM scores""",
    "lineage_log": CLEAN + """SELECT 'Online Retail' AS dataset_name,
          unnest(['extraction', 'transformation', 'load']) AS stage, n AS rows FROM (SELECT count(*) AS n FROM retail)""",
    "stored_batches": HISTORY + """SELECT run_id, pipeline_name, status, rows_processed, health_score FROM runs""",
    "compacted_batches": HISTORY + """SELECT run_id, rows_processed, health_score, results_stored FROM runs
          JOIN (SELECT run_id, count(*) AS results_stored FROM found GROUP BY run_id) USING (run_id) WHERE run_id % 5 <> 0""",
    "profile_report": CHECKED + "\nUNION ALL ".join([
        *(f"SELECT 'columns' AS section, CAST({i} AS BIGINT) AS position, '{c}' AS name, CAST({_q('null_' + c)} AS DOUBLE) AS value"
          " FROM metrics" for i, c in enumerate(COLUMNS)),
        *(f"SELECT 'numeric', {i}, '{c}', round(median({_q(c)})::double, 4) FROM retail"
          for i, c in enumerate(("Quantity", "UnitPrice", "CustomerID"))),
        *(f"SELECT 'missing_per_column', {i}, '{c}', CAST({_q('null_' + c)} AS DOUBLE) FROM metrics"
          for i, c in enumerate(("Description", "CustomerID"))),
        """SELECT 'top_countries', row_number() OVER (ORDER BY n DESC, country) - 1, country, CAST(n AS DOUBLE)
          FROM (SELECT "Country" AS country, count(*) AS n FROM retail GROUP BY 1 ORDER BY n DESC, country LIMIT 5)""",
        "SELECT 'quality_flags', 0, 'HIGH_MISSING_CUSTOMER_ID', 1.0 FROM metrics",
        "SELECT 'quality_flags', 1, 'DUPLICATE_ROWS_DETECTED', 0.0 FROM metrics"]),
    "quality_report": CHECKED_FAULTY + """SELECT 'Online Retail' AS dataset_name, CAST(1 AS BIGINT) AS timed, n AS total_rows,
          (SELECT count(*) FROM found) AS total_checks, (SELECT count(*) FROM found WHERE status = 'FAIL') AS failed,
          check_order AS position, check_name, status, affected_rows, affected_percentage AS affected_pct, affected_percentage
          FROM found, metrics""",
    "score_report": CHECKED_FAULTY + """SELECT 'Online Retail' AS dataset_name, health_score, health_label AS status,
          NULL::VARCHAR AS failure_reason, dimension, score, max_score, details FROM dimensions, scores""",
    "lineage_sidecar": CLEAN + """SELECT 'Online Retail' AS dataset_name, n AS rows_extracted, n AS rows_in, n AS rows_out,
          'IsCancellation, Revenue' AS columns_added, CAST(1 AS BIGINT) AS beside_its_output FROM (SELECT count(*) AS n FROM retail)""",
    "csv_scan": CLEAN + """SELECT "Country" AS country, count(*) AS rows, CAST(sum("Quantity") AS BIGINT) AS quantity,
          count("CustomerID") AS with_customer, count("Description") AS with_description,
          min("InvoiceDate") AS first_date,
          'InvoiceNo:string,StockCode:bigint,Description:string,Quantity:bigint,InvoiceDate:string,'
          || 'UnitPrice:double,CustomerID:double,Country:string' AS dtypes FROM retail GROUP BY 1""",
}
