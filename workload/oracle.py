"""The registered queries again as SQL over the raw tables.

The rules that results depend on (draws, weights, word hashes) are stated here once more, in SQL.
"""

from __future__ import annotations

P = 2147483647


def draw(id_: str, stream: int) -> str:
    offset = f"((((({id_}) >> 31) * 15485863 + 7919) * {stream}) % {P})"
    first = f"(((({id_}) % {P}) * 48271 + {offset} + 7) % {P})"
    return f"((({first} * {first}) % {P} * 69621 + 104729 * {stream}) % {P})"


def uniform(id_: str, stream: int) -> str:
    return f"(CAST({draw(id_, stream)} AS DOUBLE) / {P}.0::DOUBLE)"


def pick(values: tuple[str, ...], id_: str, stream: int) -> str:
    array = "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return f"{array}[{draw(id_, stream)} % {len(values)} + 1]"


# Tickers, handling codes, states and hazard areas.
TICKERS = (
    "AAPL", "MSFT", "NVDA", "AMZN", "META", "GOOGL", "GOOG", "TSLA", "AVGO", "NFLX", "COST", "ASML", "AMD", "QCOM",
    "ADBE", "CSCO", "PEP", "TMUS", "INTC", "CMCSA", "TXN", "AMGN", "HON", "VRTX", "AMAT", "INTU", "ISRG", "BKNG",
    "ADP", "LRCX", "SBUX", "GILD", "MRVL", "ADI", "REGN", "KLAC", "PANW", "SNPS", "CDNS", "MU", "CSX", "ORLY",
    "CRWD", "FTNT", "DXCM", "ABNB", "CHTR", "TEAM", "PCAR", "NXPI", "WDAY", "FAST", "ODFL", "ROST", "KDP", "BKR",
    "VRSK", "EXC", "AEP", "CCEP",
)
HANDLING = (
    "automated", "manual_direct", "manual_review", "algorithmic", "direct_access",
)
STATES = (
    "CA", "TX", "FL", "NY", "PA", "IL", "OH", "GA", "NC", "MI",
)
AREAS = (
    "Lifting", "Lacerations", "Material_Handling", "Overhead_Lifting", "Machine_Guarding", "Occ_Disease",
    "Walking_Surfaces", "Elevated_Surfaces",
)

SALES = """sales AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_orderpriority AS region,
         o_totalprice AS transaction_amount, o_orderdate AS "timestamp" FROM orders)"""

CUSTOMERS = """customers AS (
  SELECT c_custkey AS customer_id, c_name AS name,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'CA' WHEN 'MACHINERY' THEN 'NY' WHEN 'AUTOMOBILE' THEN 'TX'
                           WHEN 'FURNITURE' THEN 'FL' WHEN 'HOUSEHOLD' THEN 'PA' END AS state FROM customer)"""

SUMMARY = """
SELECT s.region, c.state, CASE WHEN c.state IN ('CA', 'NY') THEN 'Gold' ELSE 'Silver' END AS customer_tier,
       round(sum(s.transaction_amount), 2) AS total_sales,
       round(avg(s.transaction_amount), 6) AS average_sale_amount,
       count(DISTINCT s.customer_id) AS distinct_customers
FROM sales s JOIN customers c ON s.customer_id = c.customer_id
GROUP BY 1, 2, 3"""

TRADES = """trades AS (
  SELECT CAST(event_id AS VARCHAR) AS trade_id, ts AS trade_timestamp, event_type AS ticker, value AS price,
         user_id + 1 AS quantity, CASE WHEN user_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS trade_side,
         'ACC-TRD-0' || CAST(user_id % 5 + 1 AS VARCHAR) AS executing_account FROM events)"""

BASELINES = """baselines AS (
  SELECT ticker, CAST(trade_timestamp AS DATE) AS trade_date, avg(price) AS avg_price, stddev_samp(price) AS stddev_price
  FROM trades GROUP BY 1, 2)"""

ZSCORES = """zscores AS (
  SELECT t.*, (t.price - b.avg_price) / nullif(b.stddev_price, 0) AS price_z_score
  FROM trades t LEFT JOIN baselines b ON b.ticker = t.ticker AND b.trade_date = CAST(t.trade_timestamp AS DATE))"""

_RATINGS = "['Excellent', 'Good', 'Fair', 'Poor', 'Not Applicable', 'Not Enough Info']"
SURVEYS = (
    "surveys AS (\n  SELECT o_orderkey, 'vault/sample-survey-customer-' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')"
    " || '.pdf' AS survey_filename, CAST(o_orderdate AS DATE) AS survey_date, "
    + ", ".join(f"{_RATINGS}[(o_orderkey + {7 * j}) % 6 + 1] AS rating_{a.lower()}" for j, a in enumerate(AREAS))
    + " FROM orders)"
)

POLICIES = """policies AS (
  SELECT 'POL_' || CAST(c_custkey AS VARCHAR) AS policy_id, 'ACC_' || CAST(c_custkey AS VARCHAR) AS account_id,
         c_name AS account_name, make_date(1995 + c_custkey % 7, 1, 1) AS effective_date,
         make_date(1996 + c_custkey % 7, 1, 1) AS expiration_date,
         CAST(round(c_acctbal * 100) AS BIGINT) AS earned_premium FROM customer)"""

_SLUGS = """'vault/sample-survey-' || replace(lower(p.account_name), '#', '-') || '.pdf' = s.survey_filename"""
ASSIGNED = f"""assigned AS (
  SELECT s.*, p.policy_id, p.account_id, p.earned_premium, p.effective_date, p.expiration_date
  FROM surveys s JOIN policies p ON {_SLUGS} AND s.survey_date BETWEEN p.effective_date AND p.expiration_date)"""


def _scores(source: str) -> str:
    points = "MAP {'Excellent': 10.0::DOUBLE, 'Good': 20.0::DOUBLE, 'Fair': 30.0::DOUBLE, 'Poor': 40.0::DOUBLE}"
    columns = ", ".join(f"map_extract({points}, rating_{a.lower()})[1] AS score_{a.lower()}" for a in AREAS)
    return f"scores AS (SELECT * EXCLUDE ({', '.join('rating_' + a.lower() for a in AREAS)}), {columns} FROM {source})"


CLAIMS = """claims AS (
  SELECT 'ACC_' || CAST(l_suppkey AS VARCHAR) AS account_id, l_extendedprice AS incurred_loss_amount,
         CAST(year(l_shipdate) + 24 AS BIGINT) AS accident_year,
         CASE p_type WHEN 'ECONOMY' THEN 'LIFT_01' WHEN 'SMALL' THEN 'CUT_02' WHEN 'LARGE' THEN 'GUARD_06'
                     WHEN 'MEDIUM' THEN 'CRANE_05' WHEN 'PROMO' THEN 'SLIP_09' WHEN 'STANDARD' THEN 'CLERICAL' END
           AS cause_code
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

# The claim causes of each hazard area.
CAUSES = {
    "Lifting": ("LIFT_01", "STRAIN_04"),
    "Lacerations": ("CUT_02", "SHARP_09"),
    "Material_Handling": ("LOADING_03", "CARGO_11"),
    "Overhead_Lifting": ("CRANE_05", "HOIST_12"),
    "Machine_Guarding": ("GUARD_06", "ELEC_07", "LOTO_13"),
    "Occ_Disease": ("DUST_08", "CHEM_14", "TOXIC_15"),
    "Walking_Surfaces": ("SLIP_09", "TRIP_10", "SURFACE_16"),
    "Elevated_Surfaces": ("FALL_17", "SCAFFOLD_18"),
}
_LOOKUP = ", ".join(f"('{code}', '{area}')" for area, codes in CAUSES.items() for code in codes)
HAZARDS = f"""lookup(code, area) AS (VALUES {_LOOKUP}),
hazards AS (
  SELECT claims.*, coalesce(lookup.area, 'Other') AS hazard_area FROM claims LEFT JOIN lookup ON code = cause_code)"""

LOSSES = """losses AS (
  SELECT account_id, hazard_area, sum(incurred_loss_amount) AS total_hazard_loss
  FROM hazards WHERE accident_year >= 2020 GROUP BY account_id, hazard_area)"""

WEIGHTS = """known AS (SELECT * FROM losses WHERE hazard_area <> 'Other'),
weights AS (
  SELECT hazard_area, sum(total_hazard_loss) / (SELECT sum(total_hazard_loss) FROM known) AS area_weight
  FROM known GROUP BY hazard_area)"""

# One row per survey and area, then the weighted sum per survey.
_LONG = " UNION ALL ".join(f"SELECT o_orderkey, '{a}' AS hazard_area, score_{a.lower()} AS score FROM scores" for a in AREAS)
WEIGHTED = f"""long AS ({_LONG}),
weighted AS (
  SELECT o_orderkey, sum(coalesce(score, 2.5) * coalesce(area_weight, 0.125)) AS total,
         sum(coalesce(area_weight, 0.125)) AS weight
  FROM long LEFT JOIN weights USING (hazard_area) GROUP BY o_orderkey)"""

ACCOUNTS = """accounts AS (
  SELECT 'ACC_' || CAST(o_custkey AS VARCHAR) AS account_id,
         'REC_' || CAST(year(o_orderdate) + 24 AS VARCHAR) || '_' || CAST(o_custkey AS VARCHAR) AS record_id,
         CAST(year(o_orderdate) + 24 AS BIGINT) AS record_year,
         sum(l_extendedprice) AS revenue, sum(l_extendedprice * l_discount) AS total_costs
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, year(o_orderdate))"""

INDEXED = """ratios AS (
  SELECT *, total_costs / nullif(revenue, 0) AS individual_cost_ratio FROM accounts WHERE record_year >= 2020),
indexed AS (
  SELECT record_id, account_id, record_year, individual_cost_ratio,
         avg(individual_cost_ratio) OVER (PARTITION BY record_year) AS market_avg_cost_ratio,
         individual_cost_ratio / nullif(avg(individual_cost_ratio) OVER (PARTITION BY record_year), 0) * 100
           AS performance_index
  FROM ratios)"""

PATHS = """paths AS (
  SELECT o.o_orderkey AS policyholder_id, o.o_orderpriority AS company_name, c.c_name AS inspector_name,
         p.p_brand AS model_name
  FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_brand = 'Brand#17')"""

COMPLIANCE = f"""compliant AS (
  SELECT t.*, 'CAT_DESK_0' || CAST({draw('CAST(trade_id AS BIGINT)', 21)} % 4 + 1 AS VARCHAR) AS reporter_id,
         {pick(("NEW", "RTE", "CAN", "TRD"), 'CAST(trade_id AS BIGINT)', 22)} AS order_event_type,
         {pick(HANDLING, 'CAST(trade_id AS BIGINT)', 23)} AS handling_instructions,
         'SESS-' || md5('session-' || trade_id) AS session_id, trade_timestamp AS reported_timestamp
  FROM trades t)"""

_FLAT = "trade_id, ticker, price, quantity, reporter_id, order_event_type, handling_instructions, session_id, reported_timestamp"
FILLED = """filled AS (
  SELECT trade_id, ticker, price, quantity, trade_timestamp,
         CASE WHEN ticker = 'purchase' THEN 'CAT_DESK_HFT' ELSE 'CAT_DESK_LEGACY' END AS reporter_id,
         CASE WHEN ticker = 'purchase' THEN 'TRD_POST' ELSE 'TRD_HISTORICAL' END AS order_event_type,
         CASE WHEN ticker = 'purchase' THEN 'algorithmic' ELSE 'unspecified' END AS handling_instructions,
         CASE WHEN ticker = 'purchase' THEN 'SESS-BACKFILL' END AS session_id,
         CASE WHEN ticker = 'purchase' THEN TIMESTAMP '2024-02-01 00:00:00' END AS reported_timestamp
  FROM trades WHERE trade_timestamp < TIMESTAMP '2024-01-16 00:00:00')"""
LATER = f"SELECT {_FLAT} FROM compliant WHERE trade_timestamp >= TIMESTAMP '2024-01-16 00:00:00'"

GENERATED_CUSTOMERS = f"""customers AS (
  SELECT c_custkey AS customer_id, CAST(c_custkey AS VARCHAR) || '_name' AS name,
         CASE WHEN {uniform('c_custkey', 1)} < 0.9 THEN 'CA' ELSE {pick(STATES, 'c_custkey', 2)} END AS state,
         TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1577836800 + {draw('c_custkey', 3)} % 31536000) AS signup_date
  FROM customer)"""
GENERATED_SALES = f"""ids AS (SELECT l_orderkey * 8 + l_linenumber AS id FROM lineitem),
sales AS (
  SELECT id AS transaction_id, customer_id, CAST({draw('id', 5)} % 100 AS INTEGER) AS product_id,
         ['West', 'South', 'Northeast', 'Midwest'][customer_id % 4 + 1] AS region,
         {uniform('id', 6)} * 490 + 10 AS transaction_amount,
         TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1640995200 + {draw('id', 7)} % 63072000) AS "timestamp"
  FROM (SELECT id, {draw('id', 4)} % (SELECT count(*) FROM customer) AS customer_id FROM ids))"""

# The rows of the test events lie in January, when New York is five hours behind UTC.
MARKET_TIME = f"""CAST(CAST(ts AS DATE) - CAST(greatest(isodow(CAST(ts AS DATE)) - 5, 0) AS INTEGER) AS TIMESTAMP)
  + to_seconds(34200 + {draw('event_id', 16)} % 23401) + INTERVAL 5 HOUR"""


def _mean_vector(group: str) -> str:
    return f"""entries AS (
  SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
means AS (SELECT {group} AS grp, pos, avg(CAST(x AS DOUBLE)) AS mean FROM entries GROUP BY 1, 2),
queries AS (SELECT grp, list(mean ORDER BY pos) AS q FROM means GROUP BY 1),
distances AS (
  SELECT grp, vec_id, list_cosine_distance(CAST(embedding AS DOUBLE[]), q) AS distance FROM embeddings, queries)"""


def _crc_table() -> list[int]:
    """Remainders of the 256 byte values for the reflected CRC-32 polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


# CRC-32 of the UTF-8 bytes of w, byte by byte.
_CRC = """xor(list_reduce(
    list_transform(range(strlen(w)), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT)),
    lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""


def _buckets(name: str, key: str, text: str, source: str) -> str:
    return f"""{name}_split AS (
  SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source}),
{name}_codes AS (
  SELECT w, {_CRC} % 262144 AS bucket
  FROM (SELECT DISTINCT w FROM {name}_split), (SELECT CAST({_crc_table()} AS BIGINT[]) AS crc_table)),
{name} AS (SELECT {key}, bucket FROM {name}_split JOIN {name}_codes USING (w))"""


WORDS = (
    _buckets("words", "doc_id", "text", "documents")
    + """,
tf AS (SELECT doc_id, bucket, count(*) AS n FROM words GROUP BY 1, 2),
df AS (SELECT bucket, count(*) AS n FROM tf GROUP BY 1),
idf AS (SELECT bucket, ln((total + 1) / (n + 1)::DOUBLE) AS weight FROM df, (SELECT count(*) AS total FROM documents)),
raw AS (SELECT doc_id, bucket, n * weight AS x FROM tf JOIN idf USING (bucket)),
norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY 1 HAVING sum(x * x) > 0),
docs AS (SELECT doc_id, bucket, x / norm AS x FROM raw JOIN norms USING (doc_id))"""
)


def _search(questions: str, k: int) -> str:
    return (
        f"{WORDS},\nquestions AS ({questions}),\n"
        + _buckets("qwords", "qid", "q", "questions")
        + """,
qraw AS (
  SELECT qid, bucket, n * coalesce(weight, (SELECT ln((count(*) + 1)::DOUBLE) FROM documents)) AS x
  FROM (SELECT qid, bucket, count(*) AS n FROM qwords GROUP BY 1, 2) LEFT JOIN idf USING (bucket)),
qvec AS (
  SELECT qid, bucket, x / norm AS x
  FROM qraw JOIN (SELECT qid, sqrt(sum(x * x)) AS norm FROM qraw GROUP BY 1 HAVING sum(x * x) > 0) USING (qid)),
pairs AS (
  SELECT q.qid, d.doc_id, sum(q.x * d.x) AS similarity FROM qvec q JOIN docs d ON d.bucket = q.bucket GROUP BY 1, 2),
distances AS (
  SELECT q.qid, n.doc_id, round(1 - coalesce(similarity, 0), 12) AS distance
  FROM (SELECT DISTINCT qid FROM qvec) q CROSS JOIN norms n LEFT JOIN pairs p ON p.qid = q.qid AND p.doc_id = n.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id) AS rank FROM distances),
found AS (SELECT * FROM ranked WHERE rank <= """
        + str(k)
        + ")"
    )


def _with(*parts_and_select: str) -> str:
    *parts, select = parts_and_select
    return "WITH " + ",\n".join(parts) + "\n" + select


_ZCOLUMNS = "trade_id, trade_timestamp, ticker, price, quantity, trade_side, executing_account"
_TO_WEIGHTS = (CLAIMS, HAZARDS, LOSSES, WEIGHTS)
_TO_SCORES = (*_TO_WEIGHTS, WEIGHTED)
_DAILY = """SELECT CAST(trade_timestamp AS DATE) AS trade_date, ticker, CAST(sum(quantity) AS BIGINT) AS total_volume,
       round(sum(price * quantity) / nullif(sum(quantity), 0), 6) AS vwap FROM trades GROUP BY 1, 2"""
_SUMMARY = _with(SALES, CUSTOMERS, SUMMARY)
_DAILY_SQL = _with(TRADES, _DAILY)
_NEAREST = _mean_vector("0")

ORACLE: dict[str, str] = {
    "a1_scan_parquet": "SELECT * FROM orders",
    "a2_scan_partitioned": "SELECT * FROM lineitem",
    "a3_declared_schema": """SELECT p_partkey, p_name, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice
        FROM part""",
    "a4_clustered_load": _with(SALES, "SELECT * FROM sales"),
    "a5_text_lines": "SELECT unnest(string_split(text, chr(10))) AS value FROM documents",
    "a6_object_listing": "SELECT DISTINCT lang, source FROM documents",
    "a7_catalog_table": "SELECT * FROM orders",
    "a9_parquet_sink": _SUMMARY,
    "a10_partitioned_sink": """SELECT o_orderpriority AS region, count(*) AS n_rows, round(sum(o_totalprice), 2) AS amount
        FROM orders GROUP BY 1""",
    "a11_replace_table": _DAILY_SQL,
    "a12_view": _with(
        SURVEYS, _scores("surveys"), "SELECT o_orderkey, COLUMNS('score_.*') FROM scores"
    ),
    "a14_typed_table": _with(TRADES, "SELECT * FROM trades"),
    "a15_append_visible": """SELECT 'first' AS after_append, count(*) AS n_rows, max(ts) AS latest FROM events
        WHERE ts < TIMESTAMP '2024-01-16 00:00:00' UNION ALL SELECT 'second', count(*), max(ts) FROM events""",
    "a8_literal_lookup": _with(
        CLAIMS,
        f"lookup(code, hazard_area) AS (VALUES {_LOOKUP})",
        """SELECT cause_code, hazard_area, count(*) AS n_claims FROM claims LEFT JOIN lookup ON code = cause_code GROUP BY 1, 2""",
    ),
    "a15_record_batch": _with(
        TRADES,
        """SELECT trade_id, ticker, price, quantity, trade_side, CAST(NULL AS VARCHAR) AS reporter_id FROM trades
        UNION ALL SELECT 'batch-1', 'NVDA', 150.25, 10, 'BUY', 'CAT_DESK_HFT'
        UNION ALL SELECT 'batch-2', 'NVDA', 150.5, 20, NULL, NULL""",
    ),
    "a16_given_schema": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint'
        WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
        WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE column_type END AS type FROM (DESCRIBE {t})"""
        for t in ("orders", "events", "customer")
    ),
    "c4_timed_assignment": """WITH p AS (
        SELECT c_custkey AS user_id, DATE '2024-01-01' + CAST(c_custkey % 25 AS INTEGER) AS start_day,
          DATE '2024-01-01' + CAST(c_custkey % 25 + c_custkey % 4 AS INTEGER) AS end_day FROM customer)
        SELECT event_id, events.user_id, ts, start_day, end_day FROM events JOIN p
        ON events.user_id = p.user_id AND ts >= start_day AND ts < end_day""",
    "j4_survey_ratings": _with(
        SURVEYS,
        "SELECT o_orderkey, o_orderkey % 9 <> 0 AS is_parsed, "
        + ", ".join(
            f"CASE WHEN o_orderkey % 9 <> 0 THEN {c} END AS {c}"
            for c in [*(f"rating_{a.lower()}" for a in AREAS), "survey_date"]
        )
        + " FROM surveys",
    ),
    "k6_drop": """SELECT o_orderstatus, count(*) AS n_rows, 1 AS listed, 0 AS listed_after FROM orders GROUP BY 1""",
    "a16_schema": """SELECT * FROM (VALUES
        ('first', 'trade_id', 'string'), ('first', 'trade_timestamp', 'timestamp_ntz'), ('first', 'ticker', 'string'),
        ('first', 'price', 'double'), ('first', 'quantity', 'bigint'), ('first', 'trade_side', 'string'),
        ('first', 'executing_account', 'string'),
        ('last', 'trade_id', 'string'), ('last', 'trade_timestamp', 'timestamp_ntz'), ('last', 'ticker', 'string'),
        ('last', 'price', 'double'), ('last', 'quantity', 'bigint'), ('last', 'trade_side', 'string'),
        ('last', 'executing_account', 'string'),
        ('last', 'cat_compliance', 'struct<reporter_id:string,order_event_type:string,handling_instructions:string,'
          || 'session_id:string,reported_timestamp:timestamp_ntz>')) AS t("snapshot", "name", "type")""",
    "b1_customer_tier": _with(
        CUSTOMERS, "SELECT *, CASE WHEN state IN ('CA', 'NY') THEN 'Gold' ELSE 'Silver' END AS customer_tier FROM customers"
    ),
    "b2_scores": _with(SURVEYS, _scores("surveys"), "SELECT o_orderkey, COLUMNS('score_.*') FROM scores"),
    "b3_hazard_areas": _with(
        CLAIMS, HAZARDS, "SELECT cause_code, hazard_area, count(*) AS n_claims FROM hazards GROUP BY 1, 2"
    ),
    "b4_struct_field": _with(
        TRADES, COMPLIANCE, "SELECT trade_id, handling_instructions AS handling_type FROM compliant"
    ),
    "b5_all_columns_plus": "SELECT s.*, CAST(year(o_orderdate) AS BIGINT) AS order_year FROM orders s",
    "b6_comparisons": _with(
        CLAIMS,
        HAZARDS,
        """SELECT hazard_area, accident_year, count(*) AS n_claims FROM hazards
        WHERE accident_year >= 2020 AND hazard_area != 'Other' AND cause_code != 'CUT_02' GROUP BY 1, 2""",
    ),
    "b7_outliers": _with(
        TRADES,
        BASELINES,
        ZSCORES,
        "SELECT trade_id, round(price_z_score, 6) AS price_z_score FROM zscores WHERE abs(price_z_score) > 1.5",
    ),
    "b8_between_dates": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS survey_date FROM orders
        WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-01-01'""",
    "b9_safe_ratio": """SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 9) AS tax_per_discount
        FROM lineitem""",
    "b10_null_defaults": _with(
        SURVEYS,
        _scores("surveys"),
        "SELECT o_orderkey, coalesce(score_lifting, 2.5::DOUBLE) AS score_lifting FROM scores",
    ),
    "b11_text_preview": "SELECT doc_id, substr(text, 1, 120) AS text_preview FROM documents",
    "b12_deviation_flag": _with(
        ACCOUNTS, INDEXED, "SELECT record_id, performance_index > 100 AS is_deviating FROM indexed"
    ),
    "c1_broadcast_join": _with(
        SALES,
        CUSTOMERS,
        "SELECT transaction_id, customer_id, region, state, transaction_amount FROM sales JOIN customers USING (customer_id)",
    ),
    "c2_join": _with(
        SALES,
        CUSTOMERS,
        'SELECT transaction_id, customer_id, name, "timestamp" FROM sales JOIN customers USING (customer_id)',
    ),
    "c3_computed_key_left_join": _with(
        SURVEYS,
        POLICIES,
        f"""SELECT s.o_orderkey, s.survey_filename, p.policy_id FROM surveys s LEFT JOIN policies p ON {_SLUGS}
        AND s.survey_date BETWEEN p.effective_date AND p.expiration_date""",
    ),
    "c4_policy_assignment": _with(
        SURVEYS,
        POLICIES,
        ASSIGNED,
        """SELECT o_orderkey, survey_filename, policy_id, account_id, earned_premium, survey_date, effective_date,
        expiration_date FROM assigned""",
    ),
    "c5_zscores": _with(
        TRADES,
        BASELINES,
        ZSCORES,
        """SELECT trade_id, trade_timestamp, ticker, price, quantity, round(price_z_score, 6) AS price_z_score
        FROM zscores""",
    ),
    "c6_equipment_paths": """SELECT o_custkey AS inspector_id, l_orderkey AS policyholder_id, l_partkey AS machine_id
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey WHERE p_brand = 'Brand#17'""",
    "c7_weight_lookup": _with(
        SURVEYS,
        _scores("surveys"),
        *_TO_SCORES,
        "SELECT o_orderkey, round(total / weight, 6) AS mean_score FROM weighted",
    ),
    "c8_matched_by_rule": _with(
        TRADES,
        """SELECT ticker, CASE WHEN ticker = 'purchase' THEN 'CAT_DESK_HFT' ELSE 'CAT_DESK_LEGACY' END AS reporter_id,
        count(*) AS n_trades FROM trades GROUP BY 1, 2""",
    ),
    "c9_distance_to_corpus": _with(
        _mean_vector("label"),
        """SELECT grp AS label, vec_id, round(distance, 6) AS distance
        FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(distance, 12), vec_id) AS rank FROM distances)
        WHERE rank <= 2""",
    ),
    "c10_tenant_read": """SELECT CASE WHEN source < 'src15' THEN 'finance' ELSE 'marketing' END AS principal,
        source AS tenant, doc_id, text FROM documents""",
    "d1_tier_summary": _SUMMARY,
    "d2_losses": _with(
        CLAIMS,
        HAZARDS,
        LOSSES,
        "SELECT account_id, hazard_area, round(total_hazard_loss, 2) AS total_hazard_loss FROM losses",
    ),
    "d3_weights": _with(*_TO_WEIGHTS, "SELECT hazard_area, round(area_weight, 9) AS area_weight FROM weights"),
    "d4_row_count": "SELECT count(*) AS n_rows FROM lineitem",
    "d5_latest_time": "SELECT max(ts) AS latest_trade_timestamp FROM events",
    "d6_distinct_count": "SELECT count(*) AS n_distinct FROM (SELECT DISTINCT event_type FROM events)",
    "d7_table_status": """WITH facts AS (
        SELECT count(*) AS n, count(DISTINCT event_type) AS tickers, max(ts) AS latest FROM events)
        SELECT 'Total Trades' AS metric, format('{:,}', n) AS value FROM facts
        UNION ALL SELECT 'Active Tickers', CAST(tickers AS VARCHAR) FROM facts
        UNION ALL SELECT 'Latest Trade', coalesce(strftime(latest, '%Y-%m-%d %H:%M:%S'), 'N/A') FROM facts""",
    "d8_daily_summary": _DAILY_SQL,
    "d9_baselines": _with(
        TRADES,
        BASELINES,
        """SELECT ticker, trade_date, round(avg_price, 6) AS avg_price, round(stddev_price, 6) AS stddev_price
        FROM baselines""",
    ),
    "d10_composite": _with(
        SURVEYS,
        _scores("surveys"),
        *_TO_SCORES,
        "SELECT o_orderkey, round(total, 6) AS loss_weighted_composite_score FROM weighted",
    ),
    "d11_side_counts": """SELECT count(*) FILTER (WHERE user_id % 2 = 0) AS buys,
        count(*) FILTER (WHERE user_id % 2 <> 0) AS sells FROM events""",
    "e1_market_average": _with(
        ACCOUNTS,
        INDEXED,
        """SELECT record_id, round(individual_cost_ratio, 9) AS individual_cost_ratio,
        round(market_avg_cost_ratio, 9) AS market_avg_cost_ratio FROM indexed""",
    ),
    "e2_share_of_total": """SELECT l_returnflag AS hazard_area,
        round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (), 9) AS area_weight FROM lineitem GROUP BY 1""",
    "e3_performance_index": _with(
        ACCOUNTS,
        INDEXED,
        "SELECT record_id, account_id, record_year, round(performance_index, 6) AS performance_index FROM indexed",
    ),
    "f1_total_sort": _SUMMARY + "\nORDER BY total_sales DESC",
    "f2_latest_rows": _with(TRADES, "SELECT * FROM trades ORDER BY trade_timestamp DESC, trade_id LIMIT 10"),
    "f3_top_rows": _with(SALES, "SELECT * FROM sales ORDER BY transaction_amount DESC, transaction_id LIMIT 5"),
    "f4_sample_rows": _with(
        SURVEYS, "SELECT o_orderkey, survey_filename, rating_lifting FROM surveys ORDER BY o_orderkey LIMIT 5"
    ),
    "f5_nearest": _with(
        _NEAREST, "SELECT vec_id, round(distance, 6) AS distance FROM distances ORDER BY distances.distance, vec_id LIMIT 3"
    ),
    "f6_last_tickers": _with(
        TRADES,
        """SELECT string_agg(ticker, ', ' ORDER BY trade_timestamp, trade_id) AS last_tickers
        FROM (SELECT * FROM trades ORDER BY trade_timestamp DESC, trade_id LIMIT 3)""",
    ),
    "g1_union_all": """SELECT o_orderkey AS key, o_totalprice AS amount FROM orders
        UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem""",
    "g2_union_evolved": _with(
        TRADES,
        COMPLIANCE,
        """SELECT trade_id, price, CAST(NULL AS VARCHAR) AS order_event_type FROM trades
        UNION ALL SELECT trade_id, price, order_event_type FROM compliant""",
    ),
    "g3_distinct": "SELECT DISTINCT o_orderpriority FROM orders",
    "h_scalar_functions": """SELECT o_orderkey, replace(lower(o_orderpriority), ' ', '-') AS slug,
        substr(o_orderpriority, 3, 4) AS part, round(o_totalprice / 7, 2) AS rounded,
        abs(o_totalprice - 200000) AS gap,
        coalesce(o_totalprice / nullif(o_custkey, 0), -1.0::DOUBLE) AS per_customer_key,
        CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp,
        o_orderstatus AS status, ['West', 'East'][o_custkey % 2 + 1] AS side,
        CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands,
        o_totalprice BETWEEN 1000 AND 100000 AS is_small, o_orderstatus IN ('F', 'O') AS is_known FROM orders""",
    "i1_stream_ingest": "SELECT * FROM events",
    "i2_trades": f"""SELECT md5('trade-' || CAST(event_id AS VARCHAR)) AS trade_id,
        {pick(TICKERS, 'event_id', 12)} AS ticker,
        CAST({draw('event_id', 11)} % 285001 + 15000 AS DOUBLE) / 100.0::DOUBLE AS price,
        {draw('event_id', 13)} % 4991 + 10 AS quantity, {pick(("BUY", "SELL"), 'event_id', 14)} AS trade_side,
        'ACC-TRD-0' || CAST({draw('event_id', 15)} % 5 + 1 AS VARCHAR) AS executing_account FROM events""",
    "i3_market_hours": f"SELECT event_id, {MARKET_TIME} AS trade_timestamp FROM events",
    "i4_customers": _with(GENERATED_CUSTOMERS, "SELECT * FROM customers"),
    "i4_sales": _with(
        GENERATED_SALES,
        """SELECT transaction_id, customer_id, product_id, region, round(transaction_amount, 6) AS transaction_amount,
        "timestamp" FROM sales""",
    ),
    "i4_generated_summary": _with(GENERATED_CUSTOMERS, GENERATED_SALES, SUMMARY),
    "i5_compliance": _with(
        TRADES,
        COMPLIANCE,
        """SELECT trade_id, reporter_id, order_event_type, handling_instructions, session_id, reported_timestamp
        FROM compliant""",
    ),
    "j1_string_index": _with(
        TRADES,
        """, ranks AS (SELECT ticker, CAST(row_number() OVER (ORDER BY count(*) DESC, ticker) - 1 AS DOUBLE) AS ticker_index
        FROM trades GROUP BY ticker) SELECT trade_id, ticker, ticker_index FROM trades JOIN ranks USING (ticker)""",
    ),
    "j2_vector_search": _with(
        _NEAREST,
        """SELECT vec_id, round(distance, 3) AS cosine_distance FROM distances
        ORDER BY distances.distance, vec_id LIMIT 2""",
    ),
    "j3_embedding": _with(
        WORDS, "SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, round(x, 9) AS weight FROM docs WHERE x > 0"
    ),
    "j4_extraction": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        json_valid(props) AS is_parsed FROM events""",
    "j5_verbatim_text": "SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars FROM documents",
    "k1_history": """WITH n AS (SELECT count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16 00:00:00') AS early,
        count(*) AS total FROM events)
        SELECT 'append' AS operation, early AS row_count, false AS has_parent, true AS is_current_ancestor FROM n
        UNION ALL SELECT 'merge', early, true, true FROM n UNION ALL SELECT 'append', total, true, true FROM n""",
    "k2_time_travel": _with(
        TRADES, "SELECT * FROM trades WHERE trade_timestamp < TIMESTAMP '2024-01-16 00:00:00'"
    ),
    "k2_latest_at_snapshot": _with(
        TRADES, FILLED, f"SELECT {_FLAT} FROM filled ORDER BY trade_timestamp DESC, trade_id LIMIT 20"
    ),
    "k3_added_column": _with(
        TRADES,
        COMPLIANCE,
        f"""SELECT trade_id, ticker, price, quantity, NULL::VARCHAR AS reporter_id, NULL::VARCHAR AS order_event_type,
        NULL::VARCHAR AS handling_instructions, NULL::VARCHAR AS session_id, NULL::TIMESTAMP AS reported_timestamp
        FROM trades WHERE trade_timestamp < TIMESTAMP '2024-01-16 00:00:00' UNION ALL {LATER}""",
    ),
    "k4_backfill": _with(TRADES, FILLED, f"SELECT {_FLAT} FROM filled"),
    "k5_replace": _with(
        TRADES,
        f""", daily AS ({_DAILY})
        SELECT 'new' AS state, ticker, count(*) AS n_rows, CAST(sum(total_volume) AS BIGINT) AS volume FROM daily
        GROUP BY 1, 2 UNION ALL
        SELECT 'old', ticker, count(*), CAST(sum(quantity) AS BIGINT) FROM trades GROUP BY 1, 2""",
    ),
    "m1_sales_summary": _SUMMARY + "\nORDER BY total_sales DESC",
    "m2_sales_summary_sql": _SUMMARY + "\nORDER BY total_sales DESC",
    "m2_sales_summary_clustered": _SUMMARY + "\nORDER BY total_sales DESC",
    "m3_compliance_review": _with(
        TRADES,
        BASELINES,
        ZSCORES,
        f"SELECT {_ZCOLUMNS}, round(price_z_score, 6) AS price_z_score FROM zscores WHERE abs(price_z_score) > 1.5",
    ),
    "m4_daily_ticker_summary": _DAILY_SQL + " ORDER BY 1, 2",
    "m5_table_life": _with(TRADES, FILLED, COMPLIANCE, f"SELECT {_FLAT} FROM filled UNION ALL {LATER}"),
    "m6_portfolio_scores": _with(
        SURVEYS,
        POLICIES,
        ASSIGNED,
        _scores("assigned"),
        *_TO_SCORES,
        """SELECT survey_filename, policy_id, account_id, earned_premium,
        round(total, 6) AS loss_weighted_composite_score FROM scores JOIN weighted USING (o_orderkey)""",
    ),
    "m6_riskiest_surveys": _with(
        SURVEYS,
        POLICIES,
        ASSIGNED,
        _scores("assigned"),
        *_TO_SCORES,
        """SELECT survey_filename, policy_id, account_id, round(total, 2) AS loss_weighted_composite_score
        FROM scores JOIN weighted USING (o_orderkey)
        ORDER BY loss_weighted_composite_score DESC, survey_filename, policy_id, account_id LIMIT 5""",
    ),
    "m7_account_benchmarks": _with(
        ACCOUNTS,
        INDEXED,
        """SELECT record_id, account_id, record_year, round(individual_cost_ratio, 9) AS individual_cost_ratio,
        round(market_avg_cost_ratio, 9) AS market_avg_cost_ratio, round(performance_index, 6) AS performance_index,
        performance_index > 100 AS is_deviating FROM indexed""",
    ),
    "m7_costliest_accounts": _with(
        ACCOUNTS,
        INDEXED,
        """SELECT record_id, account_id, round(individual_cost_ratio, 2) AS account_cost_ratio,
        round(performance_index, 2) AS performance_index, performance_index > 100 AS is_deviating
        FROM (SELECT * FROM indexed ORDER BY performance_index DESC, record_id LIMIT 5)""",
    ),
    "m8_text_search": _with(
        _search("SELECT 0 AS qid, 'liquid leaks, wet floors, slip and fall hazards' AS q", 2),
        """SELECT doc_id, text, round(distance, 3) AS cosine_distance FROM found JOIN documents USING (doc_id)""",
    ),
    "m8_passage_search": _with(
        _search("SELECT item_id AS qid, text AS q FROM benchmark", 2),
        "SELECT qid AS item_id, doc_id, round(distance, 6) AS distance FROM found",
    ),
    "m9_shared_equipment": _with(PATHS, "SELECT * FROM paths"),
    "m10_handling_features": _with(
        TRADES,
        COMPLIANCE,
        """, ranks AS (SELECT handling_instructions,
          CAST(row_number() OVER (ORDER BY count(*) DESC, handling_instructions) - 1 AS DOUBLE) AS handling_index
          FROM compliant GROUP BY 1)
        SELECT trade_id, handling_instructions AS handling_type, handling_index
        FROM compliant JOIN ranks USING (handling_instructions)""",
    ),
}
# An index changes what is read, not what is found.
ORACLE["j2_indexed_search"] = ORACLE["c9_distance_to_corpus"]
ORACLE["m8_indexed_passages"] = ORACLE["m8_passage_search"]
ORACLE["i1_judged_arrivals"] = ORACLE["d9_baselines"]
ORACLE["m4_running_summary"] = """SELECT CAST(ts AS DATE) AS trade_date, event_type AS ticker,
    CAST(sum(user_id + 1) AS BIGINT) AS total_volume, round(sum(value * (user_id + 1)), 2) AS total_value
    FROM events GROUP BY 1, 2"""
ORACLE["m2_sales_summary_bucketed"] = _SUMMARY
ORACLE["j1_many_labels"] = """WITH l AS (
    SELECT l_orderkey, l_linenumber, p_name || ' ' || CAST(l_partkey AS VARCHAR) || ' ' || CAST(l_suppkey AS VARCHAR) AS label
    FROM lineitem JOIN part ON l_partkey = p_partkey),
    ranks AS (SELECT label, CAST(row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS DOUBLE) AS label_index
    FROM l GROUP BY 1)
    SELECT l_orderkey, l_linenumber, label, label_index FROM l JOIN ranks USING (label)"""
ORACLE["d1_distinct_sketches"] = """SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders,
    count(DISTINCT l_partkey) AS n_parts, true AS orders_within_2_percent, true AS parts_within_2_percent
    FROM lineitem GROUP BY 1"""
ORACLE["c4_stretched_assignment"] = """WITH p AS (SELECT n_nationkey, DATE '2023-12-01' + CAST(n_nationkey * 3 AS INTEGER) AS s,
      DATE '2023-12-01' + CAST(n_nationkey * 3 + n_nationkey * 9 % 200 AS INTEGER) AS e,
      CASE n_nationkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END AS event_type FROM nation)
    SELECT event_id, n_nationkey FROM events JOIN p ON events.event_type = p.event_type AND ts >= s AND ts <= e"""
ORACLE["j3_dense_embedding"] = """SELECT doc_id, CASE WHEN text IS NOT NULL THEN 32 END AS width,
    CASE WHEN text IS NOT NULL THEN true END AS no_longer FROM documents"""
