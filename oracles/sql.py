"""SQL twins of the registered queries, written for DuckDB.

The statements share named sub-queries (``CTES``); each statement gets only the ones it
needs. Rounding of averages is done on integers where a tie is possible, so neither
engine's floating point decides it.
"""

from __future__ import annotations

import re

UNMATCHED = 100000000
SEED = "conversion-draw"
KEYWORDS = ["password", "credit card number", "aadhaar", "token"]
SEARCHES = ["ring", "small", "blue bolt", "BRAND#1", "r%g", "ECONOMY,red", "nothing like it"]

MATERIAL = """CASE WHEN p_size % 10 <= 5 THEN '18KT Gold & Diamond'
    WHEN p_size % 10 <= 7 THEN '22KT GOLD' WHEN p_size % 10 = 8 THEN 'Silver' END"""


def half_up(numerator: str, denominator: str, digits: int) -> str:
    """Exact half-up quotient of two non-negative integers, as DOUBLE."""
    scale = 10**digits
    return (
        f"(((2 * {scale} * CAST({numerator} AS HUGEINT) + {denominator}) // (2 * {denominator}))"
        f"::DOUBLE / {scale}::DOUBLE)"
    )


def hash32(*parts: str) -> str:
    text = " || ".join(f"CAST({part} AS VARCHAR)" for part in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


# Constants of the 32-bit Murmur3 hash.
MURMUR_C1, MURMUR_C2 = 0xCC9E2D51, 0x1B873593
MURMUR_M1, MURMUR_M2 = 0x85EBCA6B, 0xC2B2AE35
MURMUR_N = 0xE6546B64
MURMUR_SEED = 42
WORD = 2**32


def _apply(source: str, expression: str) -> str:
    """One step on the running value ``h``; steps nest, so each value is computed once."""
    return f"SELECT user_id, CAST({expression} AS UBIGINT) AS h FROM ({source})"


def _rotated(value: str, bits: int) -> str:
    return f"(({value} << {bits}) % {WORD}) + ({value} >> {32 - bits})"


def _rotate_number(value: int, bits: int) -> int:
    return ((value << bits) | (value >> (32 - bits))) % WORD


def _murmur_block(source: str, block: str) -> str:
    """Mix one prepared block into ``h``."""
    mixed = _apply(source, f"xor(h, CAST({block} AS UBIGINT))")
    turned = _apply(mixed, _rotated("h", 13))
    return _apply(turned, f"(h * 5 + {MURMUR_N}) % {WORD}")


def _murmur_finish(source: str, length: int) -> str:
    steps = [
        f"xor(h, {length}::UBIGINT)",
        "xor(h, h >> 16)",
        f"(h * {MURMUR_M1}::UBIGINT) % {WORD}",
        "xor(h, h >> 13)",
        f"(h * {MURMUR_M2}::UBIGINT) % {WORD}",
        "xor(h, h >> 16)",
    ]
    for step in steps:
        source = _apply(source, step)
    return source


def murmur_sql(source: str, text: str = "") -> str:
    """(user_id, h): signed Murmur3 of an INT key, continued over a constant ASCII text."""
    multiplied = f"SELECT user_id, (user_id::UBIGINT * {MURMUR_C1}::UBIGINT) % {WORD} AS h FROM {source}"
    block = _apply(_apply(multiplied, _rotated("h", 15)), f"(h * {MURMUR_C2}::UBIGINT) % {WORD}")
    value = _murmur_finish(
        f"SELECT user_id, CAST((h * 5 + {MURMUR_N}) % {WORD} AS UBIGINT) AS h FROM"
        f" ({_apply(_apply(block, f'xor(h, {MURMUR_SEED}::UBIGINT)'), _rotated('h', 13))})",
        4,
    )
    if text:
        data = text.encode()
        words = len(data) // 4 * 4
        numbers = [int.from_bytes(data[i : i + 4], "little") for i in range(0, words, 4)]
        for number in [*numbers, *data[words:]]:
            prepared = _rotate_number(number * MURMUR_C1 % WORD, 15) * MURMUR_C2 % WORD
            value = _murmur_block(value, str(prepared))
        value = _murmur_finish(value, len(data))
    return (
        f"SELECT user_id, CASE WHEN h >= {WORD // 2} THEN h::BIGINT - {WORD} ELSE h::BIGINT END AS h"
        f" FROM ({value})"
    )


def recurrence(day: str, leap: str = "ref_date") -> str:
    """Days to the yearly recurrence of a date column; ``leap`` replaces a missing Feb 29."""
    moved = (
        f"try_cast(year(ref_date) || '-' || lpad(month({day})::VARCHAR, 2, '0') || '-'"
        f" || lpad(day({day})::VARCHAR, 2, '0') AS DATE)"
    )
    days = f"date_diff('day', ref_date, coalesce({moved}, {leap}))"
    return f"CAST(CASE WHEN {day} IS NULL THEN 365 ELSE (({days} % 365) + 365) % 365 END AS INTEGER)"


# What each reason of the quarantine is about.
MISSING_REASONS = {"null_user": "user_id", "null_order": "order_id", "null_status": "status", "null_date": "order_date"}


def reasons(bad_dates: bool = False) -> str:
    """Names of the broken rules, joined: a list of all names, kept where its test holds."""
    tests = {"invalid_amount": "(total_amount > 0) IS NOT TRUE"}
    tests |= {name: f"{column} IS NULL" for name, column in MISSING_REASONS.items()}
    if bad_dates:
        tests["bad_date"] = "(order_date IS NULL) < (try_cast(order_date AS DATE) IS NULL)"
    names = ", ".join(f"'{name}'" for name in tests)
    kept = ", ".join(f"({test})" for test in tests.values())
    return f"array_to_string(list_where([{names}], [{kept}]), '; ')"


RAW_COLUMNS = (
    "order_id, user_id, CAST(total_amount AS DOUBLE) AS total_amount, status, order_date,"
    " item_count, created_at"
)
RAW_NULLABLE = (
    "CAST(order_id AS DOUBLE) AS order_id, CAST(user_id AS DOUBLE) AS user_id,"
    " CAST(total_amount AS DOUBLE) AS total_amount, status, order_date, item_count, created_at"
)
SILVER_COLUMNS = (
    "order_id, user_id, CAST(total_amount AS DOUBLE) AS total_amount, status,"
    " CAST(try_cast(order_date AS DATE) AS VARCHAR) AS order_date, item_count, created_at"
)
GOOD = (
    "total_amount > 0 AND user_id IS NOT NULL AND order_id IS NOT NULL"
    " AND status IS NOT NULL AND order_date IS NOT NULL"
)


def features_sql(orders: str, full: bool) -> str:
    engaged = """
      coalesce(c.n, 0) AS cart_adds, CAST(coalesce(c.v, 0) AS DOUBLE) AS cart_value,
      coalesce(w.n, 0) AS wishlist_count, CAST(coalesce(w.v, 0) AS DOUBLE) AS wishlist_value,"""
    birthday = "CAST(coalesce(u.days_to_birthday, 365) AS INTEGER) AS days_to_birthday,"
    joins = """
      LEFT JOIN (SELECT user_id, count(*) AS n, sum(price_inr) AS v FROM m_carts GROUP BY user_id) c
        ON c.user_id = o.user_id
      LEFT JOIN (SELECT user_id, count(*) AS n, sum(price_inr) AS v FROM m_wishlists GROUP BY user_id) w
        ON w.user_id = o.user_id"""
    return f"""
    SELECT o.user_id,
      CAST(date_diff('day', o.last_order_date, r.ref_date) AS INTEGER) AS recency_days,
      CAST(date_diff('day', o.first_order_date, r.ref_date) AS INTEGER) AS tenure_days,
      o.frequency, CAST(o.cents AS DOUBLE) / 100 AS monetary_total,
      {half_up('o.cents', '(100 * o.n)', 2)} AS aov,
      {half_up('o.items', 'o.n', 3)} AS avg_item_count,
      coalesce(i.total_items, 0) AS total_items,
      coalesce(i.distinct_categories, 0) AS distinct_categories,
      coalesce({half_up('i.diamond', 'i.total_items', 4)}, 0) AS diamond_share,
      coalesce({half_up('i.gold', 'i.total_items', 4)}, 0) AS gold_share,{engaged if full else ''}
      CAST(coalesce(u.days_to_anniversary, 365) AS INTEGER) AS days_to_anniversary,
      {birthday if full else ''}
      CAST(coalesce(u.has_milestone, 0) AS INTEGER) AS has_milestone,
      CAST(r.ref_date AS VARCHAR) AS feature_asof_date
    FROM (SELECT user_id, count(DISTINCT order_id) AS frequency,
            CAST(sum(total_amount) * 100 AS BIGINT) AS cents, count(*) AS n,
            CAST(sum(item_count) AS BIGINT) AS items,
            max(order_date) AS last_order_date, min(order_date) AS first_order_date
          FROM {orders} GROUP BY user_id) o
      CROSS JOIN (SELECT max(order_date) AS ref_date FROM {orders}) r
      LEFT JOIN item_counts i ON i.user_id = o.user_id{joins if full else ''}
      LEFT JOIN (SELECT user_id, {recurrence('anniversary_date')} AS days_to_anniversary,
                   {recurrence('date_of_birth')} AS days_to_birthday,
                   CAST(milestone_date IS NOT NULL AS INTEGER) AS has_milestone
                 FROM m_users CROSS JOIN (SELECT max(order_date) AS ref_date FROM {orders})) u
        ON u.user_id = o.user_id"""


STANDARD = {
    "frequency": ("frequency", 0.70),
    "recency_days": ("recency_days", -0.70),
    "monetary_total": ("ln(monetary_total + 1)", 0.50),
    "wishlist_count": ("wishlist_count", 0.50),
    "cart_adds": ("cart_adds", 0.40),
    "tenure_days": ("tenure_days", 0.20),
}

LATENT = " + ".join(
    ["-0.60::DOUBLE"]
    + [f"({weight}::DOUBLE * z_{name})" for name, (_, weight) in STANDARD.items()]
    + [
        "(1.20::DOUBLE * (diamond_share - 0.4::DOUBLE))",
        "(CASE WHEN days_to_anniversary <= 30 THEN 0.80::DOUBLE ELSE 0::DOUBLE END)",
    ]
)

FEATURES = (
    "recency_days, tenure_days, frequency, monetary_total, aov, avg_item_count, total_items,"
    " distinct_categories, diamond_share, gold_share, cart_adds, cart_value, wishlist_count,"
    " wishlist_value, days_to_anniversary, days_to_birthday, has_milestone"
)

# Days after which a state ends, and offers with what calls for them, first come first served.
STATES, STATE_DAYS = ["Active", "Cooling", "Dormant"], [14, 45]
OFFERS = [
    ("days_to_anniversary <= 30", "Anniversary: 40% off making charges on diamond sets"),
    ("diamond_share >= 0.6", "Diamond loyalty: complimentary certification + 25% off making"),
    ("segment = 'High'", "VIP early access to new collection + free resizing"),
    ("cart_adds >= 3", "Cart nudge: 5% off cart above Rs.1L"),
    ("TRUE", "Welcome-back: 3% off next purchase"),
]
# The number of ends passed picks the state; the place of the first true test picks the offer.
STATE = f"({STATES})[1 + len(list_filter({STATE_DAYS}, lambda days: recency_days > days))]"
DIAMOND = "CASE WHEN material ILIKE '%diamond%' THEN 1 ELSE 0 END"

OFFER = "([{offers}])[list_position([{tests}], TRUE)]".format(
    offers=", ".join(f"'{text}'" for _, text in OFFERS),
    tests=", ".join(f"coalesce({test}, FALSE)" for test, _ in OFFERS),
)
RATIONALE = """'segment=' || segment
      || ', propensity=' || CAST(CAST(CAST(CAST(propensity_score AS DECIMAL(9,6)) AS DECIMAL(9,3)) AS DOUBLE) AS VARCHAR)
      || ', diamond_share=' || CAST(CAST(CAST(diamond_share AS DECIMAL(10,4)) AS DECIMAL(10,2)) AS VARCHAR)
      || ', days_to_anniversary=' || CAST(days_to_anniversary AS VARCHAR)"""

SALES = f"""CAST(sum(line_total) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS units_sold,
    CAST(sum(unit_price) AS DOUBLE) / count(unit_price) AS avg_unit_price, avg({DIAMOND}) AS diamond_mix"""
PROPENSITY = """count(DISTINCT user_id) AS customers, round(avg(propensity_score), 9) AS avg_propensity,
    CAST(sum(CAST(monetary_total AS DECIMAL(18,2))) AS DOUBLE) / count(monetary_total) AS avg_lifetime_value"""

CTES: dict[str, str] = {
    "m_users": """
    SELECT CAST(c_custkey AS INTEGER) AS user_id, 'F' || c_custkey AS first_name, c_name AS last_name,
      CASE c_custkey % 50 WHEN 0 THEN NULL WHEN 1 THEN 'nomail'
        ELSE 'user' || c_custkey || '@mail' || (c_custkey % 5) || '.com' END AS email,
      CASE WHEN c_custkey % 50 = 2 THEN '12' ELSE '9' || lpad(c_custkey::VARCHAR, 9, '0') END AS mobile,
      CASE WHEN c_custkey % 97 = 5 THEN DATE '1988-02-29' WHEN c_custkey % 3 = 0 THEN NULL
        ELSE DATE '1985-01-01' + CAST((c_custkey * 53) % 9000 AS INTEGER) END AS anniversary_date,
      CASE WHEN c_custkey % 5 = 0 THEN NULL
        ELSE DATE '1960-01-01' + CAST((c_custkey * 37) % 14000 AS INTEGER) END AS date_of_birth,
      CASE WHEN c_custkey % 4 = 0 THEN DATE '2000-06-01' END AS milestone_date,
      DATE '1994-01-01' + CAST((c_custkey * 17) % 360 AS INTEGER) AS created_at
    FROM customer""",
    "m_orders": """
    SELECT o_orderkey AS order_id, CAST(o_custkey AS INTEGER) AS user_id,
      CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount, o_orderstatus AS status,
      CAST(o_orderdate AS DATE) AS order_date, 1 + o_orderkey % 5 AS item_count,
      CAST(o_orderdate AS DATE) AS created_at
    FROM orders""",
    "m_raw": """
    SELECT CASE WHEN o_orderkey % 101 <> 0 THEN o_orderkey END AS order_id,
      CASE WHEN o_orderkey % 89 <> 0 THEN CAST(o_custkey AS INTEGER) END AS user_id,
      CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 83 = 0 THEN -CAST(o_totalprice AS DECIMAL(18,2))
        ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS total_amount,
      CASE WHEN o_orderkey % 107 <> 0 THEN o_orderstatus END AS status,
      CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN 'garbage'
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
      1 + o_orderkey % 5 AS item_count, strftime(o_orderdate, '%Y-%m-%d') AS created_at
    FROM orders""",
    "m_silver": f"""
    SELECT order_id, user_id, total_amount, status, try_cast(order_date AS DATE) AS order_date, item_count
    FROM m_raw WHERE {GOOD}""",
    "m_items": f"""
    SELECT CAST(o_custkey AS INTEGER) AS user_id, p_type AS category, {MATERIAL} AS material,
      CAST(l_quantity AS BIGINT) AS quantity, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
      CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total, CAST(o_orderdate AS DATE) AS order_date
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "m_carts": """
    SELECT CAST(user_id * 10 + event_id % 10 AS INTEGER) AS user_id, CAST(value AS DECIMAL(18,2)) AS price_inr
    FROM events WHERE event_type = 'click'""",
    "m_wishlists": """
    SELECT CAST(user_id * 10 + event_id % 10 AS INTEGER) AS user_id, CAST(value AS DECIMAL(18,2)) AS price_inr
    FROM events WHERE event_type = 'view'""",
    "m_products": f"""
    SELECT 'SKU-' || p_partkey AS product_id, p_name AS name, p_type AS category, {MATERIAL} AS material,
      CAST(trunc(p_retailprice) AS INTEGER) AS price_inr, p_brand || ' ' || p_name AS description,
      p_type || ',' || p_name AS tags
    FROM part""",
    "item_counts": f"""
    SELECT user_id, count(*) AS total_items, count(DISTINCT category) AS distinct_categories,
      CAST(sum({DIAMOND}) AS BIGINT) AS diamond,
      CAST(sum(CASE WHEN material ILIKE '%gold%' THEN 1 ELSE 0 END) AS BIGINT) AS gold
    FROM m_items GROUP BY user_id""",
    "ref_day": "SELECT max(order_date) AS ref_date FROM m_orders",
    "feat": features_sql("m_orders", True),
    "stats": "SELECT "
    + ", ".join(
        f"avg({expr}) AS {name}_mean, stddev_samp({expr}) AS {name}_std"
        for name, (expr, _) in STANDARD.items()
    )
    + " FROM feat",
    "zscores": "SELECT feat.*, "
    + ", ".join(
        f"({expr} - {name}_mean) / nullif({name}_std, 0) AS z_{name}"
        for name, (expr, _) in STANDARD.items()
    )
    + " FROM feat CROSS JOIN stats",
    "latents": f"SELECT *, {LATENT} AS latent, 1 / (1 + exp(-({LATENT}))) AS propensity FROM zscores",
    "training": f"""
    SELECT user_id, {FEATURES}, round(propensity, 6) AS propensity_true,
      CASE WHEN ({hash32('user_id', f"'{SEED}'")} % 100000) / 100000::DOUBLE < propensity
        THEN 1 ELSE 0 END AS label_conversion
    FROM latents""",
    "ranked": """
    SELECT user_id, propensity_true, row_number() OVER (ORDER BY propensity_true, user_id) AS rank,
      count(*) OVER () AS total FROM training""",
    "deciles": """
    SELECT *, CAST(CASE WHEN rank = 1 THEN 1
      ELSE ((rank - 1) * 10 + (total - 1) - 1) // (total - 1) END AS INTEGER) AS decile FROM ranked""",
    "scores": """
    SELECT user_id, propensity_true AS propensity_score, decile,
      CASE WHEN decile >= 9 THEN 'High' WHEN decile >= 5 THEN 'Medium' ELSE 'Low' END AS segment
    FROM deciles""",
    "c360": """
    SELECT feat.*, propensity_score, segment, decile
    FROM feat LEFT JOIN scores ON scores.user_id = feat.user_id""",
    "offers": f"""
    SELECT user_id, {OFFER} AS recommended_offer, {RATIONALE} AS rationale, propensity_score
    FROM c360 WHERE propensity_score IS NOT NULL""",
    "profiles": """
    SELECT user_id, recency_days, frequency, monetary_total AS lifetime_value, aov, diamond_share,
      wishlist_count, cart_adds, days_to_anniversary FROM feat""",
    "regions": f"""
    SELECT m_users.*, ['North', 'South', 'East', 'West'][CAST({hash32('user_id')} % 4 AS INTEGER) + 1] AS region
    FROM m_users""",
    "masked": """
    SELECT user_id, substr(email, 1, 2) || '***' || regexp_extract(email, '(@.*)$', 1) AS email,
      '******' || right(mobile, 4) AS mobile FROM m_users""",
    "category_kpi": f"""
    SELECT category, units_sold AS units, CAST(round(revenue) AS BIGINT) AS revenue,
      CAST(round(avg_unit_price) AS BIGINT) AS avg_unit_price,
      CAST(CAST(diamond_mix AS DECIMAL(10,3)) AS DOUBLE) AS diamond_mix
    FROM (SELECT category, {SALES} FROM m_items GROUP BY category)""",
    "m_requests": f"""
    SELECT c_custkey * 3 + pos AS request_id,
      ['get_customer_propensity', 'get_customer_profile', 'recommend_next_best_offer'][pos + 1] AS fn,
      CAST(CASE WHEN c_custkey % 50 = 7 THEN c_custkey + {UNMATCHED} ELSE c_custkey END AS INTEGER) AS user_id
    FROM customer, (SELECT unnest([0, 1, 2]) AS pos)""",
    "old_serving": f"""
    SELECT CAST(CASE WHEN user_id % 2 = 0 THEN user_id ELSE user_id + {UNMATCHED} END AS INTEGER) AS user_id,
      round(propensity_score - 0.1::DOUBLE, 6) AS propensity_score, segment, decile FROM scores""",
    "serving": """
    SELECT user_id, propensity_score, segment, decile, true AS refreshed FROM scores
    UNION ALL
    SELECT user_id, propensity_score, segment, decile, false FROM old_serving
    WHERE user_id NOT IN (SELECT user_id FROM scores)""",
    "by_score": """
    SELECT propensity_true AS s, CAST(sum(label_conversion) AS BIGINT) AS pos,
      CAST(sum(1 - label_conversion) AS BIGINT) AS neg FROM training GROUP BY 1""",
    "curve": """
    SELECT *, sum(pos) OVER w AS run_pos, sum(neg) OVER w AS run_neg,
      sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
    FROM by_score WINDOW w AS (ORDER BY s DESC)""",
    "terms": "SELECT "
    + ", ".join(
        [f"{weight}::DOUBLE * z_{name} AS {name}" for name, (_, weight) in STANDARD.items()]
        + [
            "1.2::DOUBLE * (diamond_share - 0.4::DOUBLE) AS diamond_share",
            "CASE WHEN days_to_anniversary <= 30 THEN 0.8::DOUBLE ELSE 0::DOUBLE END AS days_to_anniversary",
        ]
    )
    + " FROM zscores",
    "contributions": " UNION ALL ".join(
        f"SELECT '{name}' AS feature, avg(abs({name} - (SELECT avg({name}) FROM terms)))"
        " AS mean_abs_contribution FROM terms"
        for name in [*STANDARD, "diamond_share", "days_to_anniversary"]
    ),
}


def statement(body: str) -> str:
    """``body`` with the named sub-queries it uses, in order of dependence."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b(?:FROM|JOIN|,)\s*{name}\b", text) and name not in needed:
                visit(CTES[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = ", ".join(f"{name} AS ({CTES[name]})" for name in needed)
    return f"WITH {parts} {body}"


def calls(key: str, unit: str) -> str:
    start = f"strftime(date_trunc('{unit}', ts), '%Y-%m-%d %H:%M:%S')"
    return f"SELECT {key} AS caller, {start} AS period_start, count(*) AS calls FROM events GROUP BY 1, 2"


def guard_sql(table: str, keys: str) -> str:
    checks = [
        (r"regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z][A-Za-z]')", "email"),
        (
            "regexp_matches(text, '(^|[^0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}([^0-9]|$)')",
            "card_number",
        ),
        (
            "regexp_matches(text, '(^|^[ -]|[^0-9 -]|[^0-9][ -])[0-9]{4} [0-9]{4} [0-9]{4}"
            "([^0-9 -]|[ -]([^0-9]|$)|$)')",
            "national_id",
        ),
    ]
    checks += [(f"contains(lower(text), '{word}')", f"keyword:{word}") for word in KEYWORDS]
    cases = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in checks)
    return (
        f"SELECT {keys}, reasons, reasons <> '' AS blocked"
        f" FROM (SELECT *, concat_ws('; ', {cases}) AS reasons FROM {table})"
    )


def search_sql(text: str, literal: bool) -> str:
    columns = ("name", "description", "tags")
    if literal:
        hit = " OR ".join(f"contains(lower({c}), lower('{text}'))" for c in columns)
    else:
        hit = " OR ".join(f"{c} ILIKE '%{text}%'" for c in columns)
    return (
        f"SELECT product_id, name, category, material, price_inr, '{text}' AS query,"
        f" CAST(row_number() OVER (ORDER BY price_inr DESC, product_id) AS INTEGER) AS place"
        f" FROM m_products WHERE {hit}"
    )


#: Searches by the index: short ones, wildcards alone, and escaped signs besides.
INDEX_SEARCHES = [*SEARCHES, "r", "SM", "_", "%", "", "r_d%s", "50\\%", "a\\_b", "\\", "nk_i%l\\", "_" * 30]


def escaped_search_sql(text: str) -> str:
    """As ``search_sql``; a backslash that escapes nothing is doubled first."""
    pattern = re.sub(r"(\\[%_\\])|(\\)", lambda m: m[1] or "\\\\", text)
    hit = " OR ".join(f"{c} ILIKE '%{pattern}%' ESCAPE '\\'" for c in ("name", "description", "tags"))
    return search_sql("", False).replace("name ILIKE '%%' OR description ILIKE '%%' OR tags ILIKE '%%'", hit).replace(
        "'' AS query", f"'{text}' AS query"
    )


def search_many(literal: bool) -> str:
    union = " UNION ALL ".join(search_sql(text, literal) for text in SEARCHES)
    return f"SELECT * FROM ({union}) WHERE place <= 8"


def profile_sql(source: str, numbers: list[str], texts: list[str]) -> str:
    def row(name, filled, distinct, low, high, low_text, high_text, mean, std):
        return (
            f"SELECT {name} AS column_name, count(*) AS row_count, {filled} AS null_count,"
            f" {distinct} AS distinct_count, {low} AS min_number, {high} AS max_number,"
            f" {low_text} AS min_text, {high_text} AS max_text, {mean} AS mean, {std} AS stddev FROM {source}"
        )

    no_number, no_text = "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"
    rows = [row("':table'", "0::BIGINT", no_number, no_number, no_number, no_text, no_text, no_number, no_number)]
    for c in numbers:
        rows.append(
            row(f"'{c}'", f"count(*) - count({c})", f"count(DISTINCT {c})::DOUBLE", f"min({c})::DOUBLE", f"max({c})::DOUBLE",
                no_text, no_text, f"round(avg({c}), 6)", f"round(stddev_samp({c}), 6)")
        )
    for c in texts:
        rows.append(
            row(f"'{c}'", f"count(*) - count({c})", f"count(DISTINCT {c})::DOUBLE", no_number, no_number,
                f"min({c})::VARCHAR", f"max({c})::VARCHAR", no_number, no_number)
        )
    return " UNION ALL ".join(rows)


def _answers() -> str:
    score = "r.fn = 'get_customer_propensity' AND s.user_id IS NOT NULL"
    profile = "r.fn = 'get_customer_profile' AND p.user_id IS NOT NULL"
    offer = "r.fn = 'recommend_next_best_offer' AND o.user_id IS NOT NULL"
    profile_columns = (
        "recency_days frequency lifetime_value aov diamond_share wishlist_count cart_adds days_to_anniversary"
    ).split()
    return (
        "SELECT r.request_id, r.fn, r.user_id,"
        f" ({score}) OR ({profile}) OR ({offer}) AS found,"
        f" CASE WHEN ({score}) OR ({offer}) THEN s.propensity_score END AS propensity_score,"
        f" CASE WHEN {score} THEN s.segment END AS segment,"
        f" CASE WHEN {score} THEN s.decile::DOUBLE END AS decile, "
        + ", ".join(f"CASE WHEN {profile} THEN p.{c}::DOUBLE END AS {c}" for c in profile_columns)
        + f", CASE WHEN {offer} THEN o.recommended_offer END AS recommended_offer,"
        f" CASE WHEN {offer} THEN o.rationale END AS rationale"
        " FROM m_requests r LEFT JOIN scores s ON s.user_id = r.user_id"
        " LEFT JOIN profiles p ON p.user_id = r.user_id LEFT JOIN offers o ON o.user_id = r.user_id"
    )


def rolling_limit(caller: str, seconds: int, limit: int) -> str:
    return (
        f"SELECT caller, count(*) AS calls, count(*) FILTER (WHERE n > {limit}) AS calls_over, max(n) AS most_in_span"
        f" FROM (SELECT {caller} AS caller, count(*) OVER (PARTITION BY {caller} ORDER BY epoch_us(ts)"
        f" RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY caller"
    )


CATEGORIES = ["ECONOMY", "LARGE", "nothing"]


def _json_answers() -> str:
    """Answers to the JSON requests, by the kinds in which they are made."""

    def pick(texts: list[str]) -> str:
        return f"[{', '.join(repr(t) for t in texts)}][(c_custkey // 9) % {len(texts)} + 1]"

    def part(kind: int, fn: str, found: str, columns: str, source: str) -> str:
        return (
            f"SELECT c_custkey AS request_id, '{fn}' AS fn, CASE WHEN {found} IS NULL THEN 'no rows' ELSE 'ok' END AS status,"
            f" {columns} FROM customer {source} WHERE c_custkey % 9 = {kind}"
        )

    profile = ", ".join(
        f"p.{c}::DOUBLE AS {c}"
        for c in (
            "recency_days frequency lifetime_value aov diamond_share wishlist_count cart_adds days_to_anniversary"
        ).split()
    )
    parts = [
        part(0, "get_customer_propensity", "s.user_id",
             "CASE WHEN s.user_id IS NOT NULL THEN 1::DOUBLE END AS place, c_custkey::DOUBLE AS user_id,"
             " s.propensity_score, s.segment, s.decile::DOUBLE AS decile",
             "LEFT JOIN scores s ON s.user_id = c_custkey"),
        part(1, "get_customer_profile", "p.user_id",
             f"CASE WHEN p.user_id IS NOT NULL THEN 1::DOUBLE END AS place, c_custkey::DOUBLE AS user_id, {profile}",
             "LEFT JOIN profiles p ON p.user_id = c_custkey"),
        part(2, "recommend_next_best_offer", "o.user_id",
             "CASE WHEN o.user_id IS NOT NULL THEN 1::DOUBLE END AS place, 2::DOUBLE AS user_id,"
             " o.recommended_offer, o.rationale, o.propensity_score",
             "LEFT JOIN offers o ON o.user_id = 2"),
        part(3, "get_top_prospects", "s.user_id",
             "s.place::DOUBLE AS place, s.user_id::DOUBLE AS user_id, s.propensity_score",
             "LEFT JOIN (SELECT segment, user_id, propensity_score, row_number() OVER (PARTITION BY segment"
             " ORDER BY propensity_score DESC, user_id) AS place FROM scores) s"
             f" ON s.segment = {pick(['High', 'Low', 'None'])} AND s.place <= c_custkey % 7"),
        part(4, "search_products", "h.product_id",
             "h.place::DOUBLE AS place, h.product_id, h.name, h.category, h.material, h.price_inr::DOUBLE AS price_inr",
             f"LEFT JOIN ({search_many(False)}) h ON h.query = {pick(SEARCHES)}"),
        part(5, "get_category_performance", "k.category",
             f"CASE WHEN k.category IS NOT NULL THEN 1::DOUBLE END AS place, {pick(CATEGORIES)} AS category,"
             " k.units::DOUBLE AS units, k.revenue::DOUBLE AS revenue, k.avg_unit_price::DOUBLE AS avg_unit_price,"
             " k.diamond_mix",
             f"LEFT JOIN category_kpi k ON k.category = {pick(CATEGORIES)}"),
        "SELECT c_custkey AS request_id, ['get_customer_profile', 'drop_everything', 'get_customer_propensity']"
        "[c_custkey % 9 - 5] AS fn, CASE WHEN c_custkey % 9 = 6 THEN 'bad JSON' WHEN c_custkey % 9 = 7 THEN 'unknown function'"
        " WHEN c_custkey % 2 = 0 THEN 'missing p_user_id' ELSE 'bad p_user_id' END AS status"
        " FROM customer WHERE c_custkey % 9 >= 6",
    ]
    return " UNION ALL BY NAME ".join(parts)


def _bodies() -> dict[str, str]:
    raw_bronze = f"SELECT {RAW_NULLABLE}, true AS has_source FROM m_raw"
    item_columns = (
        "user_id, category, material, quantity, CAST(unit_price AS DOUBLE) AS unit_price,"
        " CAST(line_total AS DOUBLE) AS line_total, CAST(order_date AS VARCHAR) AS order_date"
    )
    dates = ", ".join(
        f"CAST({c} AS VARCHAR) AS {c}" for c in ("anniversary_date", "date_of_birth", "milestone_date", "created_at")
    )
    clean = f"SELECT {RAW_COLUMNS} FROM m_raw WHERE {GOOD}"
    quarantine = f"SELECT {RAW_NULLABLE}, {reasons()} AS dq_reason FROM m_raw WHERE ({GOOD}) IS NOT TRUE"
    violations = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE ({test}) IS NOT TRUE) AS violations FROM m_raw"
        for rule, test in {
            "valid_amount": "total_amount > 0",
            "has_user": "user_id IS NOT NULL",
            "has_order": "order_id IS NOT NULL",
            "has_status": "status IS NOT NULL",
            "has_date": "order_date IS NOT NULL",
        }.items()
    )
    evaluation = (
        "SELECT count(*) AS n, round(avg(quality), 9) AS groundedness, round(avg(quality), 9) AS correctness,"
        " round(avg(1 - toxic), 9) AS safety FROM labels"
    )
    governed = (
        "user_id, first_name, last_name, {email} AS email, {mobile} AS mobile, region,"
        " CAST(date_of_birth AS VARCHAR) AS date_of_birth, CAST(anniversary_date AS VARCHAR) AS anniversary_date,"
        " CAST(created_at AS VARCHAR) AS created_at"
    )
    hidden = governed.format(
        email="substr(email, 1, 2) || '***' || regexp_extract(email, '(@.*)$', 1)",
        mobile="'******' || right(mobile, 4)",
    )
    split = f"""
            SELECT user_id, label_conversion, place <= n * 75 // 100 AS is_train FROM (
              SELECT user_id, label_conversion, count(*) OVER (PARTITION BY label_conversion) AS n,
                row_number() OVER (PARTITION BY label_conversion
                  ORDER BY {hash32('user_id', f"'{SEED}-split'")}, user_id) AS place
              FROM training)"""
    high_low = (
        "SELECT segment, count(DISTINCT user_id) AS customers,"
        " CAST(sum(CAST(monetary_total AS DECIMAL(18,2))) AS DOUBLE) / count(monetary_total) AS avg_lifetime_value"
        " FROM c360 WHERE segment IN ('High', 'Low') GROUP BY segment"
    )
    category_rank = (
        "SELECT *, CAST(rank() OVER (ORDER BY diamond_mix DESC) AS INTEGER) AS diamond_mix_rank FROM"
        " (SELECT category, CAST(sum(line_total) AS DOUBLE) AS revenue, avg(" + DIAMOND + ") AS diamond_mix"
        " FROM m_items {where} GROUP BY category)"
    )
    doubles = ", ".join(f"CAST({c.strip()} AS DOUBLE) AS {c.strip()}" for c in FEATURES.split(","))
    occasions = (
        "SELECT user_id, {anniversary} AS days_to_anniversary, {birthday} AS days_to_birthday,"
        " CAST(milestone_date IS NOT NULL AS INTEGER) AS has_milestone FROM m_users CROSS JOIN ref_day"
    ).format(anniversary=recurrence("anniversary_date"), birthday=recurrence("date_of_birth"))
    engaged = "SELECT user_id, count(*) AS {n}, CAST(sum(price_inr) AS DOUBLE) AS {v} FROM {t} GROUP BY user_id"
    feb28 = "make_date(year(ref_date), 2, 28)"
    daily_over = f"SELECT * FROM ({calls('user_id', 'day')}) WHERE calls > 5"
    top_drivers = (
        "(SELECT string_agg(feature, ' > ' ORDER BY mean_abs_contribution DESC, feature) FROM"
        " (SELECT * FROM contributions ORDER BY mean_abs_contribution DESC, feature LIMIT 5))"
    )
    return {
        "a01_ingest_orders": raw_bronze,
        "a01_ingest_faulty": """
            SELECT CAST(CASE WHEN k <> 2 THEN order_id END AS DOUBLE) AS order_id,
              CAST(CASE WHEN k NOT IN (2, 3) THEN user_id END AS DOUBLE) AS user_id,
              CAST(CASE WHEN k NOT IN (2, 4) THEN total_amount END AS DOUBLE) AS total_amount,
              CASE WHEN k <> 2 THEN status END AS status,
              CASE k WHEN 1 THEN '[{"key":"coupon","value":"c7"}]'
                WHEN 3 THEN '[{"key":"user_id","value":"7.5"},{"key":"was","value":"' || user_id || '"}]'
                WHEN 4 THEN '[{"key":"total_amount","value":"12.345"}]' END AS _rescued,
              CASE WHEN k = 2 THEN substr('{"order_id":' || order_id || ',"user_id":' || user_id
                || ',"total_amount":', 1, 30) END AS _unreadable
            FROM (SELECT *, order_id % 11 AS k FROM m_orders)""",
        "a01_ingest_growing": """
            SELECT CAST(order_id AS DOUBLE) AS order_id, CAST(user_id AS DOUBLE) AS user_id,
              CASE WHEN NOT (late AND odd) THEN CAST(total_amount AS DOUBLE) END AS total_amount, status,
              CASE WHEN late THEN CAST(order_id * 2 AS DOUBLE) END AS points,
              CASE WHEN late THEN 'c' || (order_id % 5) END AS coupon,
              CASE WHEN late AND odd THEN printf('%.2f', total_amount) || ' EUR' END AS total_amount_string,
              CAST(NULL AS VARCHAR) AS _rescued
            FROM (SELECT *, order_id % 3 <> 0 AS late, order_id % 4 = 1 AS odd FROM m_orders)""",
        "a02_ingest_order_items": f"SELECT {item_columns}, true AS has_source FROM m_items",
        "a03_ingest_users": f"SELECT user_id, first_name, last_name, email, mobile, {dates}, true AS has_source FROM m_users",
        "a04_stream_silver": f"SELECT {SILVER_COLUMNS} FROM m_raw WHERE {GOOD}",
        "a05_batch_scan": (
            "SELECT order_id, user_id, CAST(total_amount AS DOUBLE) AS total_amount, status,"
            " CAST(order_date AS VARCHAR) AS order_date, item_count, CAST(created_at AS VARCHAR) AS created_at FROM m_orders"
        ),
        "a06_replace_table": clean,
        "a07_overwrite_with_new_schema": "SELECT *, TRUE AS scored_at FROM scores",
        "a08_gold_refresh": features_sql("m_silver", False),
        "a08_gold_merged": features_sql("m_silver", False),
        "a09_upsert_scores": "SELECT * FROM serving",
        "a10_serving_projection": "SELECT user_id, propensity_score, segment, decile FROM scores",
        "a11_append_evaluation": f"{evaluation} UNION ALL {evaluation}",
        "a12_payload_log": (
            "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'response' ELSE 'request' END AS direction,"
            " text AS payload, CAST(length(text) AS INTEGER) AS payload_chars FROM conversations"
        ),
        "b01_expectation_counts": violations,
        "b01_expectation_counts_stream": violations,
        "b02_batch_clean": clean,
        "b03_quarantine_safe": quarantine,
        "b03_quarantine_stream": quarantine,
        "b03_quarantine_reference": f"SELECT {RAW_NULLABLE}, {reasons()} AS dq_reason FROM m_raw WHERE NOT ({GOOD})",
        "b03_quarantine_bad_dates": (
            f"SELECT {RAW_NULLABLE}, {reasons(True)} AS dq_reason FROM m_raw"
            f" WHERE ({GOOD} AND try_cast(order_date AS DATE) IS NOT NULL) IS NOT TRUE"
        ),
        "b04_silver_projection": (
            f"SELECT * REPLACE (CAST(order_id AS DOUBLE) AS order_id, CAST(user_id AS DOUBLE) AS user_id)"
            f" FROM (SELECT {SILVER_COLUMNS} FROM m_raw)"
        ),
        "b05_mask_email": "SELECT user_id, email FROM masked",
        "b06_mask_mobile": "SELECT user_id, mobile FROM masked",
        "b07_row_filter_analyst": f"SELECT {hidden} FROM regions WHERE region = 'South'",
        "b07_row_filter_admin": f"SELECT {governed.format(email='email', mobile='mobile')} FROM regions",
        "b08_region_portable": "SELECT user_id, region FROM regions",
        "b08_region_murmur": (
            "SELECT user_id, ['North', 'South', 'East', 'West'][CAST(abs(h) % 4 AS INTEGER) + 1] AS region"
            f" FROM ({murmur_sql('m_users')})"
        ),
        "b09_engagement_state": f"SELECT user_id, recency_days, {STATE} AS engagement_state FROM feat",
        "b10_segment": "SELECT user_id, decile, segment FROM scores",
        "b11_next_best_offer": "SELECT * FROM offers",
        "b12_propensity_lookup": "SELECT user_id, propensity_score, segment, decile FROM scores WHERE user_id = 7",
        "b12_propensity_lookup_absent": "SELECT count(*) AS rows FROM scores WHERE user_id = -1",
        "b13_profile_lookup": "SELECT * FROM profiles WHERE user_id = 7",
        "b14_category_lookup": "SELECT * FROM category_kpi WHERE category = 'LARGE'",
        "b15_search_products": f"SELECT * EXCLUDE (query, place) FROM ({search_sql('ring', False)}) WHERE place <= 8",
        "b15_search_many": search_many(False),
        "b15_search_many_literal": search_many(True),
        "b15_search_index": "SELECT * FROM ("
        + " UNION ALL ".join(map(escaped_search_sql, INDEX_SEARCHES))
        + ") WHERE place <= 8",
        "b15_search_table": search_many(False),
        "b15_search_table_literal": search_many(True),
        "b16_golden_cohort": (
            "SELECT user_id, propensity_score, diamond_share, days_to_anniversary, cart_adds FROM c360"
            " WHERE segment = 'High' AND diamond_share >= 0.6 AND days_to_anniversary <= 30 AND cart_adds > 0"
        ),
        "b16_occasion_cohort": (
            "SELECT user_id, diamond_share, days_to_anniversary, cart_adds FROM feat"
            " WHERE diamond_share >= 0.6 AND days_to_anniversary <= 30 AND cart_adds > 0"
        ),
        "b17_guard_documents": guard_sql("documents", "doc_id"),
        "b17_guard_conversations": guard_sql("conversations", "conv_id, turn"),
        "b18_leakage_safe_features": f"SELECT {FEATURES} FROM training",
        "b19_numeric_features": f"SELECT user_id, {doubles}, propensity_true, label_conversion FROM training",
        "c01_reference_date": "SELECT user_id, CAST(ref_date AS VARCHAR) AS ref_date FROM m_users CROSS JOIN ref_day",
        "c02_column_statistics": "SELECT user_id, round(z_frequency, 6) AS z_frequency FROM zscores",
        "c03_feature_star": "SELECT * FROM feat",
        "c04_customer_360": "SELECT * FROM c360",
        "c05_scores_with_features": "SELECT user_id, segment, propensity_score, diamond_share, cart_adds FROM c360",
        "c06_counts_side_by_side": (
            f"SELECT (SELECT count(*) FROM m_raw WHERE {GOOD}) AS orders_clean,"
            f" (SELECT count(*) FROM m_raw WHERE ({GOOD}) IS NOT TRUE) AS orders_quarantined"
        ),
        "c07_answer_requests": _answers(),
        "c07_json_requests": _json_answers(),
        "d01_as_of_date": "SELECT CAST(ref_date AS VARCHAR) AS ref_date FROM ref_day",
        "d02_order_features": f"""
            SELECT user_id, frequency, CAST(cents AS DOUBLE) / 100 AS monetary_total,
              {half_up('cents', '(100 * n)', 2)} AS aov, {half_up('items', 'n', 3)} AS avg_item_count,
              CAST(last_order_date AS VARCHAR) AS last_order_date, CAST(first_order_date AS VARCHAR) AS first_order_date
            FROM (SELECT user_id, count(DISTINCT order_id) AS frequency, CAST(sum(total_amount) * 100 AS BIGINT) AS cents,
                count(*) AS n, sum(item_count) AS items, max(order_date) AS last_order_date,
                min(order_date) AS first_order_date FROM m_orders GROUP BY user_id)""",
        "d03_item_features": f"""
            SELECT user_id, total_items, distinct_categories, {half_up('diamond', 'total_items', 4)} AS diamond_share,
              {half_up('gold', 'total_items', 4)} AS gold_share FROM item_counts""",
        "d04_cart_features": engaged.format(n="cart_adds", v="cart_value", t="m_carts"),
        "d05_wishlist_features": engaged.format(n="wishlist_count", v="wishlist_value", t="m_wishlists"),
        "d06_occasion_features": occasions,
        "d06_occasion_leap_feb28": (
            f"SELECT user_id, {recurrence('anniversary_date', feb28)} AS days_to_anniversary"
            " FROM m_users CROSS JOIN ref_day"
        ),
        "d07_feature_statistics": "SELECT "
        + ", ".join(f"round({n}_{p}, 6) AS {n}_{p}" for n in STANDARD for p in ("mean", "std"))
        + " FROM stats",
        "d08_sales_by_category_month": (
            "SELECT category, CAST(CAST(date_trunc('month', order_date) AS DATE) AS VARCHAR) AS order_month,"
            f" {SALES} FROM m_items GROUP BY 1, 2"
        ),
        "d09_category_kpi": "SELECT * FROM category_kpi",
        "d10_daily_sales_kpi": (
            "SELECT CAST(o.order_date AS VARCHAR) AS order_date, o.orders, o.revenue, coalesce(i.units, 0) AS units FROM"
            " (SELECT order_date, count(DISTINCT order_id) AS orders, CAST(sum(total_amount) AS DOUBLE) AS revenue"
            " FROM m_orders GROUP BY order_date) o LEFT JOIN"
            " (SELECT order_date, CAST(sum(quantity) AS BIGINT) AS units FROM m_items GROUP BY order_date) i"
            " ON i.order_date = o.order_date"
        ),
        "d11_customer_value_kpi": "SELECT user_id, frequency AS orders, monetary_total AS lifetime_value, aov FROM feat",
        "d12_propensity_measures": f"SELECT segment, {STATE} AS engagement_state, {PROPENSITY} FROM c360 GROUP BY 1, 2",
        "d13_sales_measures_global": f"SELECT {SALES} FROM m_items",
        "d13_propensity_measures_global": f"SELECT {PROPENSITY} FROM c360",
        "d14_measures_with_filter": high_low,
        "d14_group_by_all": high_low,
        "d15_segment_summary": (
            "SELECT segment, count(*) AS customers, round(avg(propensity_score), 4) AS avg_score FROM scores GROUP BY segment"
        ),
        "d16_sync_check": (
            "SELECT segment, count(*) AS customers, (SELECT count(*) FROM serving) AS synced_rows,"
            " (SELECT round(avg(propensity_score), 4) FROM serving) AS avg_propensity FROM serving GROUP BY segment"
        ),
        "d17_evaluation_summary": evaluation,
        "d18_table_profile": profile_sql(
            "(SELECT scores.*, ref_date AS scored_at FROM scores CROSS JOIN ref_day)",
            ["user_id", "propensity_score", "decile"],
            ["segment", "scored_at"],
        ),
        "d18_feature_profile": profile_sql(
            "feat", ["user_id", *[c.strip() for c in FEATURES.split(",")]], ["feature_asof_date"]
        ),
        "d19_usage_per_user_day": calls("user_id", "day"),
        "d20_book_size": (
            "SELECT count(*) AS customers, CAST(sum(CAST(monetary_total AS DECIMAL(18,2))) AS DOUBLE) AS ltv_book,"
            " CAST(sum(CAST(monetary_total AS DECIMAL(18,2))) AS DOUBLE) * 1.0::DOUBLE / 100 AS value_of_lift,"
            " count(*) FILTER (WHERE segment = 'High') AS high_customers,"
            " count(*) FILTER (WHERE segment = 'Medium') AS medium_customers,"
            " count(*) FILTER (WHERE segment = 'Low') AS low_customers FROM c360"
        ),
        "d21_base_rate": "SELECT avg(label_conversion) AS base_rate FROM training",
        "e01_top_prospects": (
            "SELECT user_id, propensity_score FROM scores WHERE segment = 'High'"
            " ORDER BY propensity_score DESC, user_id LIMIT 5"
        ),
        "e01_top_prospects_by_segment": (
            "SELECT * FROM (SELECT segment, user_id, propensity_score, CAST(row_number() OVER (PARTITION BY segment"
            " ORDER BY propensity_score DESC, user_id) AS INTEGER) AS place FROM scores) WHERE place <= 5"
        ),
        "e02_rank_of_measure": category_rank.format(where=""),
        "e03_decile": "SELECT * FROM deciles",
        "e04_average_precision": (
            "SELECT round(sum(pos::DOUBLE / all_pos * run_pos / (run_pos + run_neg)), 9) AS average_precision FROM curve"
        ),
        "e05_roc_auc": (
            "SELECT round(sum(pos * ((all_neg - run_neg) + neg / 2.0::DOUBLE)) / max(all_pos * all_neg), 9) AS roc_auc FROM curve"
        ),
        "e06_brier": "SELECT round(avg((propensity_true - label_conversion) ** 2), 9) AS brier FROM training",
        "e07_precision_at_decile": (
            "SELECT CAST(max(k) AS BIGINT) AS k, round(max(base), 9) AS base_rate, round(avg(y), 9) AS precision_at_k,"
            " round(avg(y) / max(base), 9) AS lift_at_k FROM (SELECT label_conversion AS y,"
            " row_number() OVER (ORDER BY propensity_true DESC, user_id) AS place,"
            " greatest(1, count(*) OVER () // 10) AS k, avg(label_conversion) OVER () AS base FROM training)"
            " WHERE place <= k"
        ),
        "e01_prospects_asked": (
            "SELECT s.segment, place, user_id, propensity_score FROM (SELECT segment, user_id, propensity_score,"
            " row_number() OVER (PARTITION BY segment ORDER BY propensity_score DESC, user_id) AS place FROM scores) s"
            " JOIN (SELECT segment, count(DISTINCT decile) AS n FROM scores GROUP BY segment) a"
            " ON a.segment = s.segment WHERE place <= n"
        ),
        "f01_top_customers_by_value": (
            "SELECT user_id, frequency, monetary_total, aov FROM feat ORDER BY monetary_total DESC, user_id LIMIT 5"
        ),
        "f01_top_drivers": (
            "SELECT feature, round(mean_abs_contribution, 6) AS mean_abs_contribution FROM contributions"
            " ORDER BY contributions.mean_abs_contribution DESC, feature LIMIT 5"
        ),
        "f01_latest_evaluations": " UNION ALL ".join(
            f"{evaluation} WHERE doc_id % 6 >= {run}" for run in range(1, 6)
        ),
        "f02_multi_key_sort": "SELECT * FROM category_kpi ORDER BY revenue DESC, category",
        "f03_sort_by_ordinal": "SELECT segment, count(*) AS customers FROM scores GROUP BY segment ORDER BY 2, 1",
        "g01_layer_row_counts": (
            "SELECT 'orders_bronze' AS layer, count(*) AS rows FROM m_raw"
            f" UNION ALL SELECT 'orders_silver', count(*) FROM m_raw WHERE {GOOD}"
            f" UNION ALL SELECT 'orders_quarantine', count(*) FROM m_raw WHERE ({GOOD}) IS NOT TRUE"
            " UNION ALL SELECT 'customer_features', count(*) FROM feat"
        ),
        "g01_sql_layer_counts": (
            f"SELECT 'orders_clean' AS layer, count(*) AS rows FROM m_raw WHERE {GOOD}"
            f" UNION ALL SELECT 'orders_quarantine', count(*) FROM m_raw WHERE ({GOOD}) IS NOT TRUE"
            " UNION ALL SELECT 'customer_features', count(*) FROM feat"
            " UNION ALL SELECT 'customer_nbo_scores', count(*) FROM scores"
        ),
        "c06_sql_scalar_counts": (
            "SELECT (SELECT count(*) FROM feat) AS feature_rows, (SELECT count(*) FROM scores) AS scored_rows"
        ),
        "r01_user_calls_per_minute": f"SELECT *, calls > 60 AS over_limit FROM ({calls('user_id', 'minute')})",
        "r01_endpoint_calls_per_minute": f"SELECT *, calls > 2000 AS over_limit FROM ({calls('event_type', 'minute')})",
        "r01_users_over_daily_limit": daily_over,
        "r01_rolling_user_limit": rolling_limit("user_id", 6 * 3600, 3),
        "r01_rolling_endpoint_limit": rolling_limit("event_type", 60, 2000),
        "r01_stream_users_over_daily_limit": daily_over,
        "r01_stream_closed_windows": (
            f"SELECT * FROM ({calls('user_id', 'day')}) WHERE CAST(period_start AS TIMESTAMP) + INTERVAL 1 DAY"
            " <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
        ),
        "h01_sql_masks": (
            "SELECT user_id, substr(email, 1, 2) || '***' || regexp_extract(email, '(@.*)$', 1) AS email,"
            " '******' || right(mobile, 4) AS mobile, region = 'South' AS visible FROM regions"
        ),
        "h02_sql_propensity_lateral": (
            "SELECT r.request_id, s.propensity_score, s.segment, s.decile FROM m_requests r"
            " JOIN scores s ON s.user_id = r.user_id"
        ),
        "h02_sql_offers_lateral": "SELECT user_id, recommended_offer, rationale FROM offers",
        "h02_sql_top_prospects": (
            "SELECT user_id, propensity_score FROM scores WHERE segment = 'High'"
            " ORDER BY propensity_score DESC, user_id LIMIT 5"
        ),
        "h02_sql_search_products": f"SELECT * EXCLUDE (query, place) FROM ({search_sql('ring', False)}) WHERE place <= 8",
        "h02_sql_profile_lateral": (
            "SELECT r.request_id, p.* FROM m_requests r JOIN profiles p ON p.user_id = r.user_id"
        ),
        "h02_sql_category_lateral": "SELECT * FROM category_kpi",
        "h04_standard_scores": "SELECT user_id, "
        + ", ".join(f"round(z_{n}, 6) AS z_{n}" for n in STANDARD)
        + " FROM zscores",
        "h05_latent_propensity": (
            "SELECT user_id, round(latent, 6) AS latent, round(propensity, 6) AS propensity FROM latents"
        ),
        "h06_training_dataset": "SELECT * FROM training",
        "h06_label_murmur": (
            "SELECT l.user_id, CASE WHEN (((m.h % 100000) + 100000) % 100000) / 100000::DOUBLE < l.propensity"
            f" THEN 1 ELSE 0 END AS label_conversion FROM latents l JOIN ({murmur_sql('feat', SEED)}) m"
            " ON m.user_id = l.user_id"
        ),
        "h07_stratified_split": split,
        "h09_term_contributions": (
            "SELECT feature, round(mean_abs_contribution, 6) AS mean_abs_contribution FROM contributions"
        ),
        "h10_customer_cards": (
            "SELECT user_id, propensity_score, segment, decile, recency_days, frequency, monetary_total,"
            f" diamond_share, days_to_anniversary, {top_drivers} AS why_top_drivers FROM c360"
        ),
        "q01_revenue_by_category_this_year": category_rank.format(
            where="WHERE year(order_date) = (SELECT year(max(order_date)) FROM m_items)"
        ),
        "q02_high_versus_low": high_low,
        "q03_monthly_revenue_of_category": (
            "SELECT CAST(CAST(date_trunc('month', order_date) AS DATE) AS VARCHAR) AS order_month,"
            " CAST(sum(line_total) AS DOUBLE) AS revenue FROM m_items WHERE category = 'LARGE' AND order_date >="
            " (SELECT date_trunc('month', max(order_date)) - INTERVAL 5 MONTH FROM m_items) GROUP BY 1"
        ),
        "q04_state_with_most_high": (
            f"SELECT {STATE} AS engagement_state, count(DISTINCT user_id) AS customers FROM c360"
            " WHERE segment = 'High' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"
        ),
        "q05_order_value_of_diamond_buyers": f"""
            SELECT user_id IN (SELECT user_id FROM item_counts WHERE diamond > 0) AS diamond_buyer,
              count(*) AS orders, CAST(sum(total_amount) AS DOUBLE) / count(*) AS avg_order_value
            FROM m_orders GROUP BY 1""",
        "q06_top_customers_by_propensity": (
            "SELECT user_id, propensity_score, monetary_total FROM c360"
            " ORDER BY propensity_score DESC NULLS LAST, user_id LIMIT 10"
        ),
        "q07_top_decile_revenue_share": (
            "SELECT CAST(sum(CASE WHEN decile = 10 THEN CAST(monetary_total AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE)"
            " / CAST(sum(CAST(monetary_total AS DECIMAL(18,2))) AS DOUBLE) AS top_decile_share FROM c360"
        ),
        "q08_unit_price_of_categories": (
            "SELECT category, CAST(sum(unit_price) AS DOUBLE) / count(unit_price) AS avg_unit_price FROM m_items"
            " WHERE category IN ('ECONOMY', 'LARGE', 'SMALL') GROUP BY category"
        ),
    }


def oracle_statements() -> dict[str, str]:
    return {name: statement(body) for name, body in _bodies().items()}
