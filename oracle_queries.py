"""DuckDB SQL for the registered queries: one statement each over the given tables."""

from __future__ import annotations

RUN_AT = "2002-01-01 00:00:00"

# Questions of the retrieval queries.
QUESTIONS = [
    ("q1", "How is Premium brand performing in ASIA?"),
    ("q2", "Which region has the highest cancellation rate?"),
    ("q3", "What is the average revenue per night for Luxury cabins?"),
    ("q4", "Which cabin category generates the most onboard spend?"),
]


def fixed(x: str, scale: int) -> str:
    """A double as a decimal, by its shortest text."""
    return f"CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,{scale}))"


def rnd(x: str, places: int = 2) -> str:
    """Half-up rounding of a double's decimal text."""
    return f"CAST(ROUND({fixed(x, 18)}, {places}) AS DOUBLE)"


def mean(x: str, scale: int | None = None) -> str:
    term = x if scale is None else fixed(x, scale)
    return f"(CAST(SUM({term}) AS DOUBLE) / NULLIF(COUNT({x}), 0))"


def pad(prefix: str, x: str, width: int) -> str:
    digits = f"CAST({x} AS VARCHAR)"
    return f"'{prefix}' || LPAD({digits}, CAST(GREATEST(LENGTH({digits}), {width}) AS INTEGER), '0')"


def money(x: str) -> str:
    return f"COALESCE(format('{{:,.2f}}', CAST({x} AS DOUBLE)), 'nan')"


def pct(x: str) -> str:
    return f"COALESCE(CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR), 'nan')"


def integer(x: str) -> str:
    return f"COALESCE(CAST(CAST({x} AS BIGINT) AS VARCHAR), 'nan')"


CATEGORIES = ["dining", "spa", "excursions", "beverage", "casino", "retail"]
PAIRS = [("A", "F"), ("A", "O"), ("N", "F"), ("N", "O"), ("R", "F"), ("R", "O")]

CTE: dict[str, str] = {}

CTE["places"] = """
SELECT n_nationkey, n_name AS itinerary_name, r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey"""

CTE["dated"] = """
SELECT *, CAST(o_orderdate AS DATE) AS booking_date,
  CAST(DATE_TRUNC('month', CAST(o_orderdate AS DATE)) AS DATE)
    + CAST(38 + (o_orderkey * 37) % 233 AS INTEGER) AS sail_date,
  o_orderstatus = 'F' AS is_cancelled,
  CASE WHEN o_orderkey % 20 < 12 THEN 'Mass' WHEN o_orderkey % 20 < 17 THEN 'Premium'
       ELSE 'Luxury' END AS brand
FROM orders"""

CTE["lead"] = """
SELECT l_orderkey, MIN(p_type) AS lead_type FROM (
  SELECT l_orderkey, l_partkey, ROW_NUMBER() OVER (
    PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) x
JOIN part ON l_partkey = p_partkey WHERE rn = 1 GROUP BY l_orderkey"""

CTE["bookings"] = f"""
SELECT {pad('BK', 'o_orderkey', 7)} AS booking_id, {pad('G', 'o_custkey', 7)} AS guest_id, brand,
  'Ship ' || CAST(o_orderkey % 5 AS VARCHAR) AS ship_name, itinerary_name, region,
  CAST(5 + n_nationkey % 10 AS INTEGER) AS nights,
  COALESCE(lead_type, 'STANDARD') AS cabin_category,
  CAST(1 + o_orderkey % 4 AS INTEGER) AS num_guests, booking_date, sail_date,
  CAST(DATE_DIFF('day', booking_date, sail_date) AS INTEGER) AS booking_window_days,
  CAST(o_totalprice AS DECIMAL(18,2)) AS cabin_price_usd,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(1 + o_orderkey % 4 AS INTEGER) AS DECIMAL(18,2))
    AS total_revenue_usd,
  o_orderpriority AS booking_channel, is_cancelled,
  CASE WHEN is_cancelled THEN sail_date
    - CAST(1 + o_orderkey % DATE_DIFF('day', booking_date, sail_date) AS INTEGER) END AS cancellation_date,
  CASE WHEN is_cancelled THEN
    CASE o_orderkey % 6 WHEN 0 THEN 'Personal' WHEN 1 THEN 'Medical' WHEN 2 THEN 'Price'
      WHEN 3 THEN 'Weather' WHEN 4 THEN 'Work' END END AS cancellation_reason,
  CASE o_orderkey % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'Latitudes' WHEN 2 THEN 'Gold'
    WHEN 3 THEN 'Platinum' ELSE 'Ambassador' END AS loyalty_tier,
  CAST(o_orderdate AS TIMESTAMP) AS _fivetran_synced
FROM dated JOIN customer ON o_custkey = c_custkey
JOIN places ON c_nationkey = n_nationkey
LEFT JOIN lead ON l_orderkey = o_orderkey"""

_cats = ", ".join(
    f"CAST(SUM(CASE WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' "
    f"THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS {c}"
    for c, (f, s) in zip(CATEGORIES, PAIRS)
)
CTE["spend"] = f"""
SELECT {pad('BK', 'o_orderkey', 7)} AS booking_id, {pad('G', 'o_custkey', 7)} AS guest_id, brand,
  sail_date, {', '.join(CATEGORIES)},
  CAST({' + '.join(CATEGORIES)} AS DECIMAL(18,2)) AS total_onboard_spend_usd,
  CAST(o_orderdate AS TIMESTAMP) AS _fivetran_synced
FROM (SELECT l_orderkey, {_cats} FROM lineitem GROUP BY l_orderkey) s
JOIN dated ON l_orderkey = o_orderkey WHERE NOT is_cancelled"""

CTE["pricing"] = f"""
SELECT {pad('PL', 'l_orderkey', 9)} || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
    AS price_log_id,
  brand, itinerary_name, region, p_type AS cabin_category, sail_date,
  CAST(CAST((CAST(ROUND(o_totalprice * 100) AS BIGINT) * (80 + (l_linenumber * 13 + l_partkey) % 41) + 50)
    // 100 AS BIGINT) / 100.0 AS DECIMAL(18,2)) AS price_usd,
  CAST(l_shipdate AS TIMESTAMP) AS recorded_at, CAST(o_orderdate AS TIMESTAMP) AS _fivetran_synced
FROM lineitem JOIN dated ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey"""

CTE["profile"] = """
SELECT guest_id, primary_brand, total_bookings, loyalty_tier FROM (
  SELECT guest_id, brand AS primary_brand,
    ROW_NUMBER() OVER (PARTITION BY guest_id ORDER BY COUNT(*) DESC, brand) AS rn
  FROM bookings GROUP BY guest_id, brand) a
JOIN (SELECT guest_id, COUNT(*) AS total_bookings, MAX_BY(loyalty_tier, CAST(SUBSTR(booking_id, 3) AS BIGINT)) AS loyalty_tier
      FROM bookings GROUP BY guest_id) b USING (guest_id) WHERE rn = 1"""

CTE["guests"] = f"""
SELECT guest_id, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
  REPLACE(LOWER(c_name), '#', '.') || '@example.com' AS email, itinerary_name AS country,
  CASE c_custkey % 5 WHEN 0 THEN '25-34' WHEN 1 THEN '35-44' WHEN 2 THEN '45-54' WHEN 3 THEN '55-64'
    ELSE '65+' END AS age_group,
  primary_brand, CAST(total_bookings AS INTEGER) AS total_bookings, loyalty_tier,
  TIMESTAMP '2002-01-01 00:00:00' AS _fivetran_synced
FROM (SELECT *, {pad('G', 'c_custkey', 7)} AS guest_id FROM customer) c
JOIN places ON c_nationkey = n_nationkey JOIN profile USING (guest_id)"""

CTE["m_revenue"] = f"""
SELECT b.booking_id, b.guest_id, b.brand, ship_name, itinerary_name, region, nights, cabin_category,
  num_guests, booking_date, b.sail_date, booking_window_days, cabin_price_usd, total_revenue_usd,
  booking_channel, is_cancelled, cancellation_reason, loyalty_tier,
  COALESCE(s.total_onboard_spend_usd, 0) AS total_onboard_spend_usd,
  {', '.join(f'COALESCE(s.{c}, 0) AS {c}_spend' for c in CATEGORIES)},
  total_revenue_usd + COALESCE(s.total_onboard_spend_usd, 0) AS total_guest_value_usd,
  CAST(total_revenue_usd AS DOUBLE) / NULLIF(nights, 0) AS revenue_per_night_usd,
  CAST(total_revenue_usd + COALESCE(s.total_onboard_spend_usd, 0) AS DOUBLE) / NULLIF(nights, 0)
    AS total_value_per_night_usd
FROM bookings b LEFT JOIN spend s ON b.booking_id = s.booking_id"""

_rate = "CAST(COUNT(*) FILTER (WHERE {c}) AS DOUBLE) * 100.0 / NULLIF(COUNT(booking_id), 0)"
CTE["m_occupancy"] = f"""
SELECT brand, ship_name, itinerary_name, region, sail_date,
  CAST(MONTH(sail_date) AS INTEGER) AS sail_month, CAST(QUARTER(sail_date) AS INTEGER) AS sail_quarter,
  CAST(YEAR(sail_date) AS INTEGER) AS sail_year,
  COUNT(booking_id) AS total_bookings, COUNT(*) FILTER (WHERE NOT is_cancelled) AS confirmed_bookings,
  COUNT(*) FILTER (WHERE is_cancelled) AS cancelled_bookings,
  CAST(COALESCE(SUM(num_guests) FILTER (WHERE NOT is_cancelled), 0) AS BIGINT) AS total_guests,
  {rnd(_rate.format(c='NOT is_cancelled'))} AS occupancy_rate_pct,
  {rnd(_rate.format(c='is_cancelled'))} AS cancellation_rate_pct,
  {mean('booking_window_days')} AS avg_booking_window_days,
  {mean('cabin_price_usd')} AS avg_cabin_price_usd,
  COALESCE(SUM(total_revenue_usd) FILTER (WHERE NOT is_cancelled), 0) AS total_revenue_usd
FROM bookings GROUP BY ALL"""

CTE["m_ltv"] = """
SELECT m.*, total_cabin_revenue + total_onboard_spend AS total_lifetime_value,
  first_name, last_name, country, age_group, g.loyalty_tier,
  CASE WHEN total_cabin_revenue + total_onboard_spend >= 5000000 THEN 'Platinum'
       WHEN total_cabin_revenue + total_onboard_spend >= 2000000 THEN 'Gold'
       WHEN total_cabin_revenue + total_onboard_spend >= 500000 THEN 'Silver' ELSE 'Bronze' END AS ltv_segment
FROM (
  SELECT b.guest_id, b.brand, COUNT(b.booking_id) AS total_bookings,
    COUNT(*) FILTER (WHERE NOT is_cancelled) AS completed_voyages,
    COUNT(*) FILTER (WHERE is_cancelled) AS cancelled_bookings,
    MIN(booking_date) AS first_booking_date, MAX(booking_date) AS last_booking_date,
    CAST(MAX(booking_date) - MIN(booking_date) AS INTEGER) AS customer_tenure_days,
    COALESCE(SUM(total_revenue_usd) FILTER (WHERE NOT is_cancelled), 0) AS total_cabin_revenue,
    CAST(SUM(cabin_price_usd) FILTER (WHERE NOT is_cancelled) AS DOUBLE)
      / NULLIF(COUNT(cabin_price_usd) FILTER (WHERE NOT is_cancelled), 0) AS avg_cabin_price,
    CAST(SUM(booking_window_days) AS DOUBLE) / COUNT(booking_window_days) AS avg_booking_window_days,
    COALESCE(SUM(s.total_onboard_spend_usd), 0) AS total_onboard_spend
  FROM bookings b LEFT JOIN spend s ON b.booking_id = s.booking_id GROUP BY ALL) m
LEFT JOIN guests g ON m.guest_id = g.guest_id"""

CTE["m_pricing"] = f"""
SELECT p.brand, p.itinerary_name, p.region, p.cabin_category, p.sail_date,
  CAST(DATE_TRUNC('month', p.sail_date) AS DATE) AS sail_month,
  CAST(YEAR(p.sail_date) AS INTEGER) AS sail_year, p.price_usd AS listed_price_usd,
  b.avg_booked AS avg_booked_price_usd,
  {rnd('(b.avg_booked - CAST(p.price_usd AS DOUBLE)) / NULLIF(CAST(p.price_usd AS DOUBLE), 0) * 100')}
    AS price_variance_pct,
  CASE WHEN b.avg_booked > CAST(p.price_usd AS DOUBLE) * CAST(1.05 AS DOUBLE) THEN 'Above List'
       WHEN b.avg_booked < CAST(p.price_usd AS DOUBLE) * CAST(0.95 AS DOUBLE) THEN 'Below List'
       ELSE 'At List' END AS price_position
FROM pricing p LEFT JOIN (
  SELECT itinerary_name, brand, cabin_category, sail_date, {mean('cabin_price_usd')} AS avg_booked
  FROM bookings WHERE NOT is_cancelled GROUP BY 1, 2, 3, 4) b
ON p.itinerary_name = b.itinerary_name AND p.brand = b.brand
  AND p.cabin_category = b.cabin_category AND p.sail_date = b.sail_date"""

_line_cats = ", ".join(
    f"CASE WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' "
    f"THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS {c}"
    for c, (f, s) in zip(CATEGORIES, PAIRS)
)
CTE["line_spend"] = f"""
SELECT {pad('BK', 'o_orderkey', 7)} AS booking_id, {_line_cats},
  CAST(l_extendedprice AS DECIMAL(18,2)) AS total_onboard_spend_usd
FROM lineitem JOIN dated ON l_orderkey = o_orderkey WHERE NOT is_cancelled"""
CTE["m_revenue_line"] = CTE["m_revenue"].replace("JOIN spend s", "JOIN line_spend s")
CTE["m_ltv_line"] = CTE["m_ltv"].replace("JOIN spend s", "JOIN line_spend s")

CTE["occ_q"] = f"""
SELECT brand, region, itinerary_name, sail_year, sail_quarter,
  CAST(SUM(total_bookings) AS BIGINT) AS total_bookings,
  CAST(SUM(confirmed_bookings) AS BIGINT) AS confirmed_bookings,
  CAST(SUM(cancelled_bookings) AS BIGINT) AS cancelled_bookings,
  {rnd(mean('occupancy_rate_pct', 2))} AS avg_occupancy_pct,
  {rnd(mean('cancellation_rate_pct', 2))} AS avg_cancellation_pct,
  {rnd(mean('avg_booking_window_days', 10), 0)} AS avg_booking_window,
  CAST(SUM(total_revenue_usd) AS DOUBLE) AS total_revenue
FROM m_occupancy GROUP BY 1, 2, 3, 4, 5"""

CTE["rev_q"] = f"""
SELECT brand, region, cabin_category, CAST(YEAR(sail_date) AS INTEGER) AS sail_year,
  CAST(QUARTER(sail_date) AS INTEGER) AS sail_quarter, COUNT(*) AS total_bookings,
  {rnd(mean('cabin_price_usd'))} AS avg_cabin_price, {rnd(mean('total_revenue_usd'))} AS avg_revenue,
  {rnd(mean('total_onboard_spend_usd'))} AS avg_onboard_spend,
  {rnd(mean('total_guest_value_usd'))} AS avg_guest_value,
  {rnd(mean('revenue_per_night_usd', 6))} AS avg_rev_per_night
FROM m_revenue WHERE NOT is_cancelled GROUP BY 1, 2, 3, 4, 5"""

CTE["price_q"] = f"""
SELECT brand, region, cabin_category, price_position, CAST(YEAR(sail_date) AS INTEGER) AS sail_year,
  CAST(QUARTER(sail_date) AS INTEGER) AS sail_quarter, COUNT(*) AS records,
  {rnd(mean('listed_price_usd'))} AS avg_listed_price,
  {rnd(mean('avg_booked_price_usd', 6))} AS avg_booked_price,
  {rnd(mean('price_variance_pct', 2))} AS avg_price_variance_pct
FROM m_pricing WHERE avg_booked_price_usd IS NOT NULL AND price_variance_pct IS NOT NULL
GROUP BY 1, 2, 3, 4, 5, 6"""

CTE["card"] = f"""
SELECT region, brand, {rnd(mean('occupancy_rate_pct', 2))} AS avg_occupancy_pct,
  {rnd(mean('cancellation_rate_pct', 2))} AS avg_cancellation_pct,
  CAST(SUM(total_revenue_usd) AS DOUBLE) AS total_revenue,
  CAST(SUM(total_bookings) AS BIGINT) AS total_bookings,
  {rnd(mean('avg_booking_window_days', 10), 0)} AS avg_booking_window
FROM m_occupancy GROUP BY 1, 2"""

CTE["region_card"] = f"""
SELECT region, {rnd(mean('avg_cancellation_pct', 2))} AS avg_cancellation,
  {rnd(mean('avg_occupancy_pct', 2))} AS avg_occupancy,
  CAST(SUM(CAST(total_revenue AS DECIMAL(28,2))) AS DOUBLE) AS total_revenue
FROM card GROUP BY 1"""

_none = "CAST(NULL AS VARCHAR)"
CTE["d_occ"] = f"""
SELECT 'occupancy' AS type, brand, region, itinerary_name AS itinerary, {_none} AS cabin,
  {_none} AS "position", sail_year AS "year", sail_quarter AS quarter,
  brand || ' brand ' || itinerary_name || ' itinerary (' || region || ' region) in Q' || sail_quarter
  || ' ' || sail_year || ': Total bookings were ' || total_bookings || ' with ' || confirmed_bookings
  || ' confirmed and ' || cancelled_bookings || ' cancelled. Occupancy rate was '
  || {pct('avg_occupancy_pct')} || '%. Cancellation rate by region for ' || region || ' was '
  || {pct('avg_cancellation_pct')} || '%. Average booking window was ' || {integer('avg_booking_window')}
  || ' days. Total revenue was $' || {money('total_revenue')} || '.' AS text
FROM occ_q"""
CTE["d_rev"] = f"""
SELECT 'revenue' AS type, brand, region, {_none} AS itinerary, cabin_category AS cabin,
  {_none} AS "position", sail_year AS "year", sail_quarter AS quarter,
  brand || ' brand ' || cabin_category || ' cabins in ' || region || ' region during Q' || sail_quarter
  || ' ' || sail_year || ': Average cabin price was $' || {money('avg_cabin_price')}
  || '. Average total revenue per booking was $' || {money('avg_revenue')}
  || '. Average onboard spend was $' || {money('avg_onboard_spend')}
  || '. Average total guest value was $' || {money('avg_guest_value')}
  || '. Revenue per night averaged $' || {money('avg_rev_per_night')} || '. Based on ' || total_bookings
  || ' confirmed bookings.' AS text
FROM rev_q"""
CTE["d_price"] = f"""
SELECT 'pricing' AS type, brand, region, {_none} AS itinerary, cabin_category AS cabin,
  price_position AS "position", sail_year AS "year", sail_quarter AS quarter,
  brand || ' brand ' || cabin_category || ' cabins in ' || region || ' during Q' || sail_quarter || ' '
  || sail_year || ' were priced ' || price_position || '. Average listed price was $'
  || {money('avg_listed_price')} || ' vs average booked price of $' || {money('avg_booked_price')}
  || '. Price variance was ' || {pct('avg_price_variance_pct')} || '%.' AS text
FROM price_q"""
_nothing = f"""{_none} AS region, {_none} AS itinerary, {_none} AS cabin, {_none} AS "position",
  CAST(NULL AS INTEGER) AS "year", CAST(NULL AS INTEGER) AS quarter"""
CTE["d_agg"] = f"""
SELECT 'aggregate' AS type, brand, {_nothing},
  brand || ' brand cancellation rate and occupancy rate comparison across all regions: '
  || STRING_AGG(region || ': cancellation rate ' || {pct('avg_cancellation_pct')} || '%, occupancy '
  || {pct('avg_occupancy_pct')} || '%, avg booking window ' || {integer('avg_booking_window')}
  || ' days, total revenue $' || {money('total_revenue')}, ' | '
  ORDER BY avg_cancellation_pct DESC, region) AS text
FROM card GROUP BY brand
UNION ALL
SELECT 'aggregate', 'all', {_nothing},
  'Overall cancellation rate by region across all brands (ranked highest to lowest): '
  || STRING_AGG(region || ': avg cancellation rate ' || {pct('avg_cancellation')} || '%, avg occupancy '
  || {pct('avg_occupancy')} || '%, total revenue $' || {money('total_revenue')}, ' | '
  ORDER BY avg_cancellation DESC, region)
FROM region_card"""
CTE["docs"] = """
SELECT 'doc_' || CAST(ROW_NUMBER() OVER (ORDER BY part, last, brand, region NULLS FIRST,
    cabin NULLS FIRST, "year" NULLS FIRST, quarter NULLS FIRST,
    COALESCE(itinerary, "position", '')) - 1 AS VARCHAR) AS doc_id,
  type, brand, region, itinerary, cabin, "position", "year", quarter, text
FROM (SELECT *, 0 AS part, 0 AS last FROM d_occ UNION ALL SELECT *, 1, 0 FROM d_rev
  UNION ALL SELECT *, 2, 0 FROM d_price
  UNION ALL SELECT *, 3, CASE WHEN brand = 'all' THEN 1 ELSE 0 END FROM d_agg) x"""

CTE["scan"] = """
SELECT brand, region, itinerary_name, sail_year, sail_quarter, avg_occupancy_pct AS avg_occupancy,
  avg_cancellation_pct AS avg_cancellation, total_revenue, total_bookings FROM occ_q"""
_scan_order = "avg_occupancy, brand, region, itinerary_name, sail_year, sail_quarter"
CTE["found"] = f"""
SELECT * FROM (SELECT * FROM scan ORDER BY {_scan_order} LIMIT 20) x
WHERE avg_occupancy < 70 OR avg_cancellation > 15"""
CTE["found_all"] = "SELECT * FROM scan WHERE avg_occupancy < 70 OR avg_cancellation > 15"

_action = """'2002-01-01T00:00:00' AS "timestamp", brand, itinerary_name AS itinerary, region,
  avg_occupancy AS current_occupancy, avg_cancellation AS cancellation_rate,
  CAST(NULL AS VARCHAR) AS recommendation, {status} AS status,
  'ACT_20020101000000_' || MD5(brand || '|' || itinerary_name || '|' || region || '|' || sail_year
    || '|' || sail_quarter) AS action_id"""
CTE["proposed"] = f"SELECT {_action.format(status=chr(39) + 'PENDING_APPROVAL' + chr(39))} FROM found_all"
_verdict = """CASE brand WHEN 'Mass' THEN 'APPROVED' WHEN 'Premium' THEN 'REJECTED'
  ELSE 'PENDING_APPROVAL' END"""

_WORDS = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))"


def tfidf(corpus: str, queries: str, k: int = 6) -> dict[str, str]:
    """CTEs ending in ``best(query_id, rank, doc_id, similarity)``."""
    return {
        "d_tf": f"SELECT doc_id, w AS word, COUNT(*) AS tf FROM "
        f"(SELECT doc_id, {_WORDS} AS w FROM {corpus}) x GROUP BY 1, 2",
        "q_tf": f"SELECT query_id, w AS word, COUNT(*) AS tf FROM "
        f"(SELECT query_id, {_WORDS} AS w FROM {queries}) x GROUP BY 1, 2",
        "n_docs": f"SELECT COUNT(*) AS n FROM {corpus}",
        "idf": "SELECT word, LN((MAX(n) + 1) / CAST(COUNT(*) + 1 AS DOUBLE)) + 1 AS idf "
        "FROM d_tf, n_docs GROUP BY word",
        "d_w": "SELECT doc_id, word, tf * idf AS w FROM d_tf JOIN idf USING (word)",
        "q_w": "SELECT query_id, word, tf * COALESCE(idf, LN(CAST(n + 1 AS DOUBLE)) + 1) AS w "
        "FROM q_tf LEFT JOIN idf USING (word), n_docs",
        "d_n": "SELECT doc_id, SQRT(SUM(w * w)) AS norm FROM d_w GROUP BY 1",
        "q_n": "SELECT query_id, SQRT(SUM(w * w)) AS norm FROM q_w GROUP BY 1",
        "sims": f"SELECT query_id, doc_id, {rnd('SUM(d_w.w * q_w.w) / MAX(d_n.norm) / MAX(q_n.norm)', 6)} "
        "AS similarity FROM d_w JOIN q_w USING (word) JOIN d_n USING (doc_id) "
        "JOIN q_n USING (query_id) GROUP BY 1, 2",
        "best": "SELECT query_id, CAST(rn AS INTEGER) AS rank, doc_id, similarity FROM (SELECT *, "
        "ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rn FROM sims) x "
        f"WHERE rn <= {k}",
    }


_asked = ", ".join(f"('{i}', '{t}')" for i, t in QUESTIONS)
CTE["asked"] = f"SELECT * FROM (VALUES {_asked}) v(query_id, text)"
_key = "brand || '/' || region || '/' || itinerary_name || '/' || sail_year || '/' || sail_quarter"
CTE["anomaly_asked"] = f"""
SELECT {_key} AS query_id,
  brand || ' ' || region || ' ' || itinerary_name || ' pricing occupancy' AS text FROM found"""
_context = """
SELECT query_id, STRING_AGG('- ' || text, chr(10) ORDER BY rank) AS context
FROM best JOIN docs USING (doc_id) GROUP BY 1"""

_prompt = f"""'You are a cruise revenue pricing advisor.' || chr(10) || chr(10)
  || 'A revenue anomaly has been detected:' || chr(10) || '- Brand: ' || brand || chr(10)
  || '- Itinerary: ' || itinerary_name || chr(10) || '- Region: ' || region || chr(10)
  || '- Current occupancy: ' || {pct('avg_occupancy')} || '%' || chr(10)
  || '- Cancellation rate: ' || {pct('avg_cancellation')} || '%' || chr(10)
  || '- Total revenue: $' || {money('total_revenue')} || chr(10) || chr(10)
  || 'Relevant market context:' || chr(10) || context || chr(10) || chr(10)
  || 'Provide a specific pricing recommendation to improve occupancy.' || chr(10)
  || 'Include: recommended price adjustment (%), rationale, expected impact.' || chr(10)
  || 'Keep response under 150 words.'"""

CTE["features_base"] = """
SELECT booking_id, guest_id, brand, ship_name, itinerary_name, region, nights, cabin_category, num_guests,
  booking_date, sail_date, booking_window_days, CAST(cabin_price_usd AS DOUBLE) AS cabin_price_usd,
  CAST(total_revenue_usd AS DOUBLE) AS total_revenue_usd,
  CAST(total_onboard_spend_usd AS DOUBLE) AS total_onboard_spend_usd,
  CAST(total_guest_value_usd AS DOUBLE) AS total_guest_value_usd, booking_channel, is_cancelled,
  loyalty_tier FROM m_revenue"""
CTE["codes"] = """
SELECT cabin_category, CAST(ROW_NUMBER() OVER (ORDER BY cabin_category) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT cabin_category FROM bookings) x"""


def feature_sql(condition: str) -> str:
    return f"""
SELECT r.*, l.total_bookings, l.completed_voyages, l.customer_tenure_days,
  CAST(l.total_lifetime_value AS DOUBLE) AS total_lifetime_value, l.avg_cabin_price, l.ltv_segment,
  CAST(MONTH(sail_date) AS INTEGER) AS sail_month, CAST(QUARTER(sail_date) AS INTEGER) AS sail_quarter,
  CAST(YEAR(sail_date) AS INTEGER) AS sail_year, CAST(ISODOW(sail_date) - 1 AS INTEGER) AS sail_dayofweek,
  CASE WHEN MONTH(sail_date) IN (6, 7, 8, 12) THEN 1 ELSE 0 END AS is_peak_season,
  CASE WHEN ISODOW(sail_date) - 1 IN (4, 5) THEN 1 ELSE 0 END AS is_weekend_sail,
  CASE r.brand WHEN 'Premium' THEN 1 WHEN 'Luxury' THEN 2 ELSE 0 END AS brand_enc,
  CASE booking_channel WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3
    WHEN '5-LOW' THEN 4 ELSE 0 END AS channel_enc,
  CASE r.loyalty_tier WHEN 'Latitudes' THEN 1 WHEN 'Gold' THEN 2 WHEN 'Platinum' THEN 3
    WHEN 'Ambassador' THEN 4 ELSE 0 END AS loyalty_enc,
  CASE region WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 WHEN 'MIDDLE EAST' THEN 4
    ELSE 0 END AS region_enc,
  COALESCE(c.code, 0) AS cabin_enc
FROM features_base r LEFT JOIN m_ltv l ON {condition}
LEFT JOIN codes c ON r.cabin_category = c.cabin_category"""


def statement(select: str, extra: dict[str, str] | None = None) -> str:
    """The select with all shared CTEs it can refer to; unused ones cost nothing."""
    import re

    pool = {**CTE, **(extra or {})}
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, body in pool.items():
            if name not in needed and re.search(rf"\b{name}\b", sql) and body is not sql:
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(select)
    ordered = [n for n in pool if n in needed]
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({pool[n]})" for n in ordered) + "\n" + select


def doubles(table: str, columns: list[str]) -> str:
    swaps = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({swaps}) FROM {table}"


_cab_money = ["cabin_price_usd", "total_revenue_usd"]
_rev_money = [
    *_cab_money,
    "total_onboard_spend_usd",
    *[f"{c}_spend" for c in CATEGORIES],
    "total_guest_value_usd",
]
_region_perf = f"""
SELECT region, SUM(total_revenue_usd) AS total_revenue, COUNT(*) AS total_bookings,
  {rnd(mean('total_revenue_usd'))} AS avg_revenue_per_booking
FROM m_revenue WHERE NOT is_cancelled GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
_cell = r"regexp_replace(CAST(CAST({x} AS DECIMAL(38,2)) AS VARCHAR), '(\.\d)0$', '\1')"

ORACLE: dict[str, str] = {
    "stg_bookings": statement(doubles("bookings", _cab_money)),
    "stg_guests": statement("SELECT * FROM guests"),
    "stg_onboard_spend": statement(doubles("spend", [*CATEGORIES, "total_onboard_spend_usd"])),
    "stg_pricing_log": statement(doubles("pricing", ["price_usd"])),
    "mart_revenue": statement(doubles("m_revenue", _rev_money)),
    "mart_occupancy": statement(doubles("m_occupancy", ["total_revenue_usd"])),
    "mart_guest_ltv": statement(
        doubles("m_ltv", ["total_cabin_revenue", "total_onboard_spend", "total_lifetime_value"])
    ),
    "mart_revenue_by_line": statement(doubles("m_revenue_line", _rev_money)),
    "mart_guest_ltv_by_line": statement(
        doubles("m_ltv_line", ["total_cabin_revenue", "total_onboard_spend", "total_lifetime_value"])
    ),
    "mart_pricing_summary": statement(doubles("m_pricing", ["listed_price_usd"])),
    "occupancy_quarterly": statement("SELECT * FROM occ_q"),
    "revenue_quarterly": statement("SELECT * FROM rev_q"),
    "pricing_quarterly": statement("SELECT * FROM price_q"),
    "region_brand_scorecard": statement("SELECT * FROM card"),
    "region_scorecard": statement("SELECT * FROM region_card"),
    "docs_occupancy": statement("SELECT * FROM d_occ"),
    "docs_revenue": statement("SELECT * FROM d_rev"),
    "docs_pricing": statement("SELECT * FROM d_price"),
    "docs_aggregate": statement("SELECT * FROM d_agg"),
    "docs_all": statement("SELECT * FROM docs"),
    "anomaly_report": statement("SELECT * FROM found"),
    "anomaly_report_unlimited": statement("SELECT * FROM found_all"),
    "anomaly_top3": statement(f"SELECT * FROM found ORDER BY {_scan_order} LIMIT 3"),
    "action_log": statement(
        f"SELECT {_action.format(status=chr(39) + 'PENDING_APPROVAL' + chr(39))} "
        f"FROM (SELECT * FROM found ORDER BY {_scan_order} LIMIT 2) x"
    ),
    "action_auto_approved": statement(
        f"SELECT {_action.format(status=chr(39) + 'APPROVED' + chr(39))} "
        f"FROM (SELECT * FROM found ORDER BY {_scan_order} LIMIT 2) x"
    ),
    "action_decisions": statement(f"SELECT * REPLACE ({_verdict} AS status) FROM proposed"),
    "action_status": statement(
        f"""SELECT action_id, brand, itinerary, {_verdict} AS status,
        CASE WHEN brand IN ('Mass', 'Premium') THEN TIMESTAMP '2002-01-01 01:00:00'
             ELSE TIMESTAMP '2002-01-01 00:00:00' END AS "at" FROM proposed"""
    ),
    "anomaly_context": statement(
        "SELECT query_id, context FROM context_rows",
        {**tfidf("docs", "anomaly_asked"), "context_rows": _context},
    ),
    "prompt_table": statement(
        f"""SELECT f.query_id, {_prompt} AS prompt
FROM (SELECT *, {_key} AS query_id FROM found) f JOIN context_rows c USING (query_id)""",
        {**tfidf("docs", "anomaly_asked"), "context_rows": _context},
    ),
    "revenue_watch": statement(
        f"""SELECT {_action.format(status=chr(39) + 'APPROVED' + chr(39))}, {_prompt} AS prompt
FROM (SELECT *, {_key} AS query_id FROM found ORDER BY {_scan_order} LIMIT 2) f
JOIN context_rows c USING (query_id)""",
        {**tfidf("docs", "anomaly_asked"), "context_rows": _context},
    ),
    "question_prompts": statement(
        """SELECT query_id, 'Below are summaries drawn from the booking marts.' || chr(10) || chr(10) || context
  || chr(10) || chr(10)
  || 'Reply to the question in a few sentences. Quote the figures you rely on, and name what the' || chr(10)
  || 'summaries leave open.'
  || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Reply:' AS prompt
FROM asked JOIN context_rows USING (query_id)""",
        {**tfidf("docs", "asked"), "context_rows": _context},
    ),
    "q_region_performance": statement(
        f"SELECT * REPLACE (CAST(total_revenue AS DOUBLE) AS total_revenue) FROM ({_region_perf}) x"
    ),
    "q_region_cancellation": statement(
        f"""SELECT region, CAST(SUM(total_bookings) AS BIGINT) AS total_bookings,
  CAST(SUM(cancelled_bookings) AS BIGINT) AS cancelled_bookings,
  {rnd('CAST(SUM(cancelled_bookings) AS DOUBLE) * 100.0 / NULLIF(SUM(total_bookings), 0)')}
    AS cancellation_rate_pct
FROM m_occupancy GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 10"""
    ),
    "q_brand_region": statement(
        f"""SELECT brand, region, COUNT(*) AS total_bookings,
  CAST(SUM(total_revenue_usd) AS DOUBLE) AS total_revenue,
  {rnd(mean('total_revenue_usd'))} AS avg_revenue_per_booking,
  {rnd(mean('total_guest_value_usd'))} AS avg_guest_value,
  {rnd(mean('cabin_price_usd'))} AS avg_cabin_price
FROM m_revenue WHERE brand = 'Premium' AND region = 'ASIA' AND NOT is_cancelled GROUP BY 1, 2"""
    ),
    "q_suite_rpn": statement(
        f"""SELECT brand, COUNT(*) AS total_bookings,
  {rnd(mean('revenue_per_night_usd', 6))} AS avg_revenue_per_night
FROM m_revenue WHERE brand = 'Luxury' AND cabin_category LIKE '%M%' AND NOT is_cancelled GROUP BY 1"""
    ),
    "q_cabin_spend": statement(
        f"""SELECT cabin_category, CAST(SUM(total_onboard_spend_usd) AS DOUBLE) AS total_onboard_spend,
  {rnd(mean('total_onboard_spend_usd'))} AS avg_onboard_spend, COUNT(*) AS total_bookings
FROM m_revenue WHERE NOT is_cancelled GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
    ),
    "q_tier_ltv": statement(
        f"""SELECT loyalty_tier, COUNT(*) AS guest_brands,
  CAST(SUM(total_lifetime_value) AS DOUBLE) AS total_lifetime_value,
  {rnd(mean('total_lifetime_value'))} AS avg_lifetime_value
FROM m_ltv GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 10"""
    ),
    "q_price_compare": statement(
        f"""SELECT region, brand, avg_listed_price, avg_booked_price, avg_price_variance_pct,
  {rnd('avg_listed_price / NULLIF(MIN(avg_listed_price) OVER (), 0)')} AS ratio_to_lowest
FROM (SELECT region, brand, {rnd(mean('listed_price_usd'))} AS avg_listed_price,
  {rnd(mean('avg_booked_price_usd', 6))} AS avg_booked_price,
  {rnd(mean('price_variance_pct', 2))} AS avg_price_variance_pct
  FROM m_pricing WHERE region = 'ASIA' AND brand IN ('Premium', 'Mass') GROUP BY 1, 2) x"""
    ),
    "q_window_trend": statement(
        f"""SELECT sail_year, sail_quarter, {rnd(mean('avg_booking_window_days', 10))} AS avg_booking_window
FROM m_occupancy WHERE region = 'EUROPE' GROUP BY 1, 2"""
    ),
    "q_overall": statement(
        f"""SELECT brand, CAST(SUM(total_revenue_usd) AS DOUBLE) AS total_revenue, COUNT(*) AS total_bookings,
  {rnd(mean('total_guest_value_usd'))} AS avg_guest_value
FROM m_revenue WHERE NOT is_cancelled GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
    ),
    "q_problem_areas": statement(
        f"""SELECT * FROM (SELECT brand, region, itinerary_name,
  {rnd(mean('occupancy_rate_pct', 2))} AS avg_occupancy,
  {rnd(mean('cancellation_rate_pct', 2))} AS avg_cancellation,
  CAST(SUM(total_bookings) AS BIGINT) AS total_bookings FROM m_occupancy GROUP BY 1, 2, 3) x
WHERE avg_occupancy < 70 OR avg_cancellation > 15
ORDER BY avg_occupancy, brand, region, itinerary_name LIMIT 10"""
    ),
    "q_free_sql": statement(
        """SELECT brand, sail_year, CAST(SUM(confirmed_bookings) AS BIGINT) AS confirmed_bookings
FROM m_occupancy GROUP BY 1, 2"""
    ),
    "result_lines": statement(
        f"""SELECT CAST(0 AS INTEGER) AS line_no,
  'region | total_revenue | total_bookings | avg_revenue_per_booking' AS line
UNION ALL SELECT 1, repeat('-', 60)
UNION ALL SELECT CAST(1 + ROW_NUMBER() OVER (ORDER BY total_revenue DESC, region) AS INTEGER),
  region || ' | ' || {_cell.format(x='total_revenue')} || ' | ' || total_bookings || ' | '
  || {_cell.format(x='avg_revenue_per_booking')} FROM ({_region_perf}) x"""
    ),
    "reply_parsing": r"""SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS statement,
  turn % 2 = 0 AS answerable,
  CASE WHEN role = 'system' THEN 'Question may be outside available data scope.'
    ELSE regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g') END AS reason,
  CASE WHEN role = 'system'
    THEN 'Try asking about brand performance, occupancy, revenue, or pricing.' ELSE role END AS suggestion
FROM conversations""",
    "chat_transcript": """SELECT t.conv_id, CASE WHEN q.turn IS NULL THEN t.turn ELSE q.turn END AS turn,
  t.role, t.text AS content, CAST(NULL AS VARCHAR) AS sql, CAST(NULL AS VARCHAR) AS results
FROM conversations t LEFT JOIN conversations q ON t.role = 'assistant' AND q.role = 'user'
  AND q.conv_id = t.conv_id AND q.turn = t.turn - 1""",
    "dq_unique": """SELECT l_orderkey AS "value", COUNT(*) AS n_records FROM lineitem
WHERE l_orderkey IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1""",
    "dq_not_null": statement("SELECT booking_id FROM bookings WHERE cancellation_reason IS NULL"),
    "dq_accepted": statement(
        """SELECT brand AS "value", COUNT(*) AS n_records FROM bookings
WHERE brand NOT IN ('Mass', 'Premium') GROUP BY 1"""
    ),
    "guest_profile": statement("SELECT * FROM profile"),
    "seasonal_price": statement(
        f"""SELECT *, {rnd('cabin_price_usd * seasonal_factor * early_bird_factor')} AS seasonal_price_usd
FROM (SELECT booking_id, region, sail_date, booking_window_days,
  CAST(cabin_price_usd AS DOUBLE) AS cabin_price_usd,
  CAST(CASE WHEN region = 'AFRICA' AND MONTH(sail_date) IN (12, 1, 2, 3) THEN 1.25
    WHEN region = 'AMERICA' AND MONTH(sail_date) IN (6, 7, 8) THEN 1.30
    WHEN region = 'ASIA' AND MONTH(sail_date) IN (7, 8) THEN 1.35
    WHEN region = 'EUROPE' AND MONTH(sail_date) IN (6, 7, 8) THEN 1.20 ELSE 1.0 END AS DOUBLE)
    AS seasonal_factor,
  CAST(CASE WHEN booking_window_days > 180 THEN 0.85 WHEN booking_window_days > 90 THEN 0.92 ELSE 1.0 END
    AS DOUBLE) AS early_bird_factor FROM bookings) x"""
    ),
    "price_calendar": statement(
        """SELECT brand, itinerary_name, region, cabin_category, sail_date,
  CAST(CASE WHEN region = 'AFRICA' AND MONTH(sail_date) IN (12, 1, 2, 3) THEN 1.25
    WHEN region = 'AMERICA' AND MONTH(sail_date) IN (6, 7, 8) THEN 1.30
    WHEN region = 'ASIA' AND MONTH(sail_date) IN (7, 8) THEN 1.35
    WHEN region = 'EUROPE' AND MONTH(sail_date) IN (6, 7, 8) THEN 1.20 ELSE 1.0 END AS DOUBLE)
    AS seasonal_factor
FROM places, (VALUES ('Mass'), ('Premium'), ('Luxury')) b(brand),
  (SELECT DISTINCT p_type AS cabin_category FROM part) c,
  (SELECT CAST(UNNEST(GENERATE_SERIES(MIN(CAST(o_orderdate AS DATE)), MAX(CAST(o_orderdate AS DATE)),
    INTERVAL 7 DAY)) AS DATE) AS sail_date FROM orders) d"""
    ),
    "horizontal_spend": statement(
        f"SELECT booking_id, CAST({' + '.join(CATEGORIES)} AS DOUBLE) AS total_onboard_spend_usd FROM spend"
    ),
    "cabin_codes": statement("SELECT cabin_category, code FROM codes"),
    "cancellation_rate": statement(
        """SELECT COUNT(*) AS bookings,
  CAST(COUNT(CASE WHEN is_cancelled THEN 1 END) AS DOUBLE) / COUNT(*) AS cancellation_rate FROM bookings"""
    ),
    "feature_frame": statement(feature_sql("r.guest_id = l.guest_id AND r.brand = l.brand")),
    "feature_frame_fanout": statement(feature_sql("r.guest_id = l.guest_id")),
    "stratified_split": statement(
        """SELECT booking_id, is_cancelled,
  ROW_NUMBER() OVER (PARTITION BY is_cancelled ORDER BY MD5(booking_id || '|42'))
    <= CEIL(COUNT(*) OVER (PARTITION BY is_cancelled) * CAST(0.2 AS DOUBLE)) AS is_test FROM bookings"""
    ),
    "upsell_label": statement(
        """SELECT booking_id, CAST(total_onboard_spend_usd AS DOUBLE) AS total_onboard_spend_usd,
  CASE WHEN CAST(total_onboard_spend_usd AS DOUBLE) > (SELECT MEDIAN(CAST(total_onboard_spend_usd AS DOUBLE))
    FROM m_revenue WHERE NOT is_cancelled) THEN 1 ELSE 0 END AS high_spender
FROM m_revenue WHERE NOT is_cancelled"""
    ),
    "metric_auc": statement(
        f"""SELECT CAST((SELECT COUNT(*) FROM bookings WHERE (booking_window_days > 140) = is_cancelled)
    AS DOUBLE) / (SELECT COUNT(*) FROM bookings) AS accuracy,
  {rnd('''(SUM(CASE WHEN is_cancelled THEN avg_rank END) - MAX(p) * (MAX(p) + 1) / 2.0)
    / (CAST(MAX(p) AS DOUBLE) * MAX(n))''', 9)} AS auc_roc
FROM (SELECT is_cancelled, RANK() OVER (ORDER BY booking_window_days)
    + (COUNT(*) OVER (PARTITION BY booking_window_days) - 1) / 2.0 AS avg_rank,
  COUNT(CASE WHEN is_cancelled THEN 1 END) OVER () AS p,
  COUNT(CASE WHEN NOT is_cancelled THEN 1 END) OVER () AS n FROM bookings) x"""
    ),
    "metric_regression": statement(
        f"""SELECT {rnd('AVG(abs(p - y))', 4)} AS mae,
  {rnd('1 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(y))', 6)} AS r2
FROM (SELECT CAST(cabin_price_usd AS DOUBLE) * CAST(2.5 AS DOUBLE) AS p,
  CAST(total_revenue_usd AS DOUBLE) AS y FROM bookings) x"""
    ),
    "cosine_topk": """WITH parts AS (SELECT label, i, AVG(CAST(embedding[i] AS DOUBLE)) AS v
  FROM embeddings, (SELECT UNNEST(RANGE(1, 65)) AS i) d GROUP BY 1, 2),
cents AS (SELECT label, LIST(v ORDER BY i) AS c FROM parts GROUP BY 1),
sims AS (SELECT cents.label AS query_id, vec_id AS doc_id,
  FLOOR(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c) * 1e6 + 0.5) / 1e6 AS similarity
  FROM embeddings, cents)
SELECT query_id, CAST(rn AS INTEGER) AS rank, doc_id, similarity FROM (SELECT *, ROW_NUMBER() OVER (
  PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rn FROM sims) x WHERE rn <= 6""",
    "ivf_quality": "SELECT TRUE AS recall_reached, TRUE AS below_half",
    "lsh_quality": "SELECT TRUE AS recall_reached, TRUE AS fewer_than_all_pairs",
    "tfidf_topk": statement("SELECT * FROM best", tfidf("docs", "asked")),
    "tfidf_documents": statement("SELECT * FROM best", tfidf("documents", "asked")),
}

_rules = [
    ("bookings", "stg_bookings", "booking_id", "unique"),
    ("bookings", "stg_bookings", "booking_id", "not_null"),
    ("bookings", "stg_bookings", "guest_id", "not_null"),
    ("bookings", "stg_bookings", "brand", "not_null"),
    ("bookings", "stg_bookings", "brand", "accepted_values"),
    ("bookings", "stg_bookings", "cabin_price_usd", "not_null"),
    ("guests", "stg_guests", "guest_id", "unique"),
    ("guests", "stg_guests", "guest_id", "not_null"),
    ("spend", "stg_onboard_spend", "booking_id", "not_null"),
    ("spend", "stg_onboard_spend", "booking_id", "unique"),
    ("pricing", "stg_pricing_log", "price_log_id", "unique"),
    ("pricing", "stg_pricing_log", "price_log_id", "not_null"),
]


def _failures(table: str, column: str, test: str) -> str:
    if test == "not_null":
        return f"SELECT COUNT(*) FROM {table} WHERE {column} IS NULL"
    if test == "unique":
        return (
            f"SELECT COUNT(*) FROM (SELECT {column} FROM {table} WHERE {column} IS NOT NULL "
            f"GROUP BY 1 HAVING COUNT(*) > 1) x"
        )
    return f"SELECT COUNT(DISTINCT {column}) FROM {table} WHERE {column} NOT IN ('Mass', 'Premium', 'Luxury')"


ORACLE["dq_suite"] = statement(
    "\nUNION ALL\n".join(
        f"SELECT '{m}' AS model, '{c}' AS \"column\", '{t}' AS test, ({_failures(s, c, t)}) AS failures"
        for s, m, c, t in _rules
    )
)

# Written and read back, the rows are the same.
ORACLE["csv_round_trip"] = ORACLE["stg_guests"]
ORACLE["csv_documents"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
ORACLE["saved_mart"] = ORACLE["mart_occupancy"]
ORACLE["run_log_round_trip"] = ORACLE["action_status"]
ORACLE["table_overwrite"] = statement("SELECT COUNT(*) AS rows_written FROM m_occupancy")
ORACLE["mart_revenue_saved"] = ORACLE["mart_revenue"]
ORACLE["mart_guest_ltv_saved"] = ORACLE["mart_guest_ltv_delivered"] = ORACLE["mart_guest_ltv"]
ORACLE["mart_occupancy_delivered"] = ORACLE["mart_occupancy"]
ORACLE["mart_pricing_delivered"] = ORACLE["mart_pricing_summary"]
ORACLE["index_update"] = ORACLE["index_round_trip"] = statement("SELECT doc_id, text, type, brand FROM docs")


def _model_rows(run: str, trees: int, depth: int, metric: str, groups: str) -> str:
    """Settings, exact sizes of the split by class, and the bound that the score has to reach."""
    test, n = "SUM(CEIL(CAST(0.2 AS DOUBLE) * c))", "SUM(c)"
    rows = [
        ("param", "trees", f"{trees}"), ("param", "depth", f"{depth}"), ("metric", metric, "1"),
        ("metric", "test_rows", f"(SELECT {test} FROM ({groups}) x)"),
        ("metric", "train_rows", f"(SELECT {n} - {test} FROM ({groups}) x)"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{run}' AS run, '{kind}' AS kind, '{key}' AS key, CAST({value} AS DOUBLE) AS value"
        for kind, key, value in rows
    )


_active = "FROM m_revenue WHERE NOT is_cancelled"
_median = f"(SELECT MEDIAN(CAST(total_onboard_spend_usd AS DOUBLE)) {_active})"
ORACLE["model_runs"] = statement(
    _model_rows("cancellation_risk", 200, 4, "auc_roc", "SELECT COUNT(*) AS c FROM bookings GROUP BY is_cancelled")
    + " UNION ALL "
    + _model_rows("revenue_per_night", 200, 5, "r2", f"SELECT COUNT(*) AS c {_active}")
    + " UNION ALL "
    + _model_rows(
        "upsell_propensity", 150, 4, "auc_roc",
        f"SELECT COUNT(*) AS c {_active} GROUP BY CAST(total_onboard_spend_usd AS DOUBLE) > {_median}",
    )
)


def _node_rows(run: str, groups: str) -> str:
    """Every test row and all 18 features agree with the saved nodes."""
    n = f"CAST((SELECT SUM(CEIL(CAST(0.2 AS DOUBLE) * c)) FROM ({groups}) x) AS BIGINT)"
    return f"SELECT '{run}' AS run, {n} AS test_rows, {n} AS same_scores, CAST(18 AS BIGINT) AS same_importances"


ORACLE["gbt_nodes"] = statement(
    _node_rows("cancellation_risk", "SELECT COUNT(*) AS c FROM bookings GROUP BY is_cancelled")
    + " UNION ALL "
    + _node_rows("revenue_per_night", f"SELECT COUNT(*) AS c {_active}")
    + " UNION ALL "
    + _node_rows(
        "upsell_propensity",
        f"SELECT COUNT(*) AS c {_active} GROUP BY CAST(total_onboard_spend_usd AS DOUBLE) > {_median}",
    )
)
