"""Independent SQL for every query, by the plain route, over the same tables.

``{pct(a, b)}`` and ``{mean(x)}`` spell out half-up rounding on whole numbers.
"""

from __future__ import annotations

import re

from orderloom.operators.quality import DISCOUNTS
from orderloom.sources.schemas import ORDERS


def pct(num: str, den: str) -> str:
    return f"((({num})::HUGEINT * 20000 + ({den})) // (2 * nullif(({den})::HUGEINT, 0)))::DOUBLE / 100"


def cents(amount: str) -> str:
    return f"(({amount})::DECIMAL(28,2) * 100)::HUGEINT"


def mean(value: str) -> str:
    micros = f"(sum(({value})::DECIMAL(18,6)) * 1000000)::HUGEINT"
    step = f"(nullif(count({value}), 0)::HUGEINT * 10000)"
    return f"sign({micros}) * ((abs({micros}) * 2 + {step}) // (2 * {step}))::DOUBLE / 100"


def label(moment: str) -> str:
    return f"strftime({moment}, '%Y-%m')"


def gap(earlier: str, later: str) -> str:
    return f"date_diff('month', {earlier}, {later})"


KM = "CASE WHEN floor(l_quantity / 5) < 1 THEN 0.5 ELSE floor(l_quantity / 5)::DOUBLE END"
PROMISE = "round_even((38 + 3.2::DOUBLE * {km}) / 5, 0) * 5"
RIDE = "greatest(3.0::DOUBLE, 6 + 2.3::DOUBLE * {km})"
SHORT = "subzone = 'asia' AND distance_km <= 1"

# -- shared frames -----------------------------------------------------------------------

FRAMES = {
    "main_line": """
        SELECT l_orderkey, l_suppkey, l_quantity, l_tax, p_partkey, lower(p_brand) AS brand, p_size
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                     ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) AS rn FROM lineitem)
        LEFT JOIN part ON p_partkey = l_partkey WHERE rn = 1""",
    "ord": f"""
        SELECT o_orderkey AS order_id,
            'C' || o_custkey || '-' || year(o_orderdate) AS customer_id,
            o_orderdate + (o_orderkey % 1440) * INTERVAL 1 MINUTE AS order_placed_at,
            CASE o_orderstatus WHEN 'F' THEN 'Delivered'
                WHEN 'O' THEN CASE o_orderkey % 10 WHEN 0 THEN 'Returned' WHEN 1 THEN 'Return cancelled'
                              ELSE 'Delivered' END
                ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Rejected' WHEN 1 THEN 'Timed out' ELSE 'Picked up' END
            END AS order_status,
            CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') THEN o_orderpriority END
                AS discount_construct,
            o_totalprice::DECIMAL(18,2) AS total,
            CASE WHEN o_orderkey % 1000 = 0 THEN 6.0::DOUBLE
                 WHEN o_orderkey % 8 = 0 THEN (1 + o_orderkey % 5)::DOUBLE END AS rating,
            CASE WHEN o_orderkey % 40 = 0 THEN 'Wrong item' END AS customer_complaint_tag,
            p_partkey AS restaurant_id, brand AS restaurant_name,
            CASE WHEN l_orderkey IS NOT NULL THEN {KM} END AS distance_km,
            CASE WHEN o_orderkey % 997 = 0 THEN -p_size::DOUBLE
                 WHEN o_orderkey % 50 <> 0 THEN p_size * 7 / 10.0::DOUBLE END AS kpt_duration_minutes,
            CASE WHEN o_orderkey % 53 <> 0 THEN round(l_tax * 100) END AS rider_wait_time_minutes,
            lower(r_name) AS subzone
        FROM orders LEFT JOIN main_line ON l_orderkey = o_orderkey
        LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN region ON r_regionkey = n_regionkey""",
    "ops": f"""
        SELECT order_id,
            CASE WHEN served THEN 'DP' || lpad(supplier::VARCHAR, 9, '0') END AS partner_id,
            CASE WHEN served THEN promised END AS promised_sla_minutes,
            CASE WHEN served THEN actual END AS actual_fulfillment_minutes,
            CASE WHEN served THEN (actual > promised)::INTEGER END AS is_late
        FROM (SELECT *, p_size * 7 / 10.0::DOUBLE + round(l_tax * 100) + {RIDE.format(km='km')}
                        + CASE WHEN supplier % 25 = 0 THEN 14.0::DOUBLE ELSE 0.0::DOUBLE END AS actual,
                     {PROMISE.format(km='km')} AS promised
              FROM (SELECT li.l_orderkey AS order_id, o_orderstatus <> 'P' AS served, p_size, m.l_tax,
                        CASE WHEN li.l_orderkey % 40 = 0 THEN li.l_suppkey ELSE m.l_suppkey END AS supplier,
                        CASE WHEN floor(m.l_quantity / 5) < 1 THEN 0.5
                             ELSE floor(m.l_quantity / 5)::DOUBLE END AS km
                    FROM lineitem li JOIN main_line m ON m.l_orderkey = li.l_orderkey
                    JOIN orders ON o_orderkey = li.l_orderkey))""",
    "ops_unique": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY order_id, partner_id
            ORDER BY promised_sla_minutes NULLS FIRST, actual_fulfillment_minutes NULLS FIRST,
                     is_late NULLS FIRST) AS rn FROM ops) WHERE rn = 1""",
    "first_ops": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY order_id
            ORDER BY partner_id NULLS LAST) AS rn FROM ops_unique) WHERE rn = 1""",
    "partner_count": """
        SELECT order_id, count(DISTINCT partner_id) AS partners_assigned FROM ops GROUP BY order_id""",
    "resolved": """
        SELECT f.*, partners_assigned, partners_assigned > 1 AS was_reassigned
        FROM first_ops f JOIN partner_count USING (order_id)""",
    "seg": """
        SELECT o.*, r.partner_id, r.was_reassigned, r.is_late,
            CASE WHEN r.is_late = 1 THEN 'late' WHEN r.is_late = 0 THEN 'on_time' ELSE 'not_deliverable' END
                AS delivery_status,
            CASE WHEN distance_km <= 1 THEN 'Band_1' WHEN distance_km <= 3 THEN 'Band_2'
                 WHEN distance_km <= 5 THEN 'Band_3' WHEN distance_km > 5 THEN 'Band_4' END AS distance_band
        FROM ord o LEFT JOIN resolved r ON r.order_id = o.order_id""",
    "dlv": "SELECT * FROM seg WHERE delivery_status <> 'not_deliverable'",
    "met": """
        SELECT o.*, r.partner_id, r.is_late FROM ord o JOIN resolved r ON r.order_id = o.order_id""",
    "outlet": """
        SELECT CASE WHEN p_partkey % 100 = 7 THEN -p_partkey - 1 ELSE p_partkey END AS restaurant_id,
            lower(p_brand) AS restaurant_name, lower(p_type) AS subzone, 'metro city' AS city FROM part""",
    "landed": """
        SELECT restaurant_id::VARCHAR AS restaurant_id,
            CASE WHEN order_id % 25 = 1 THEN '  ' || restaurant_name || '  ' ELSE restaurant_name END
                AS restaurant_name,
            CASE WHEN order_id % 25 = 0 THEN upper(subzone) ELSE subzone END AS subzone,
            'Metro City' AS city, order_id::VARCHAR || CASE WHEN copy = 2 THEN '.0' ELSE '' END AS order_id,
            CASE WHEN order_id % 1013 = 0 THEN 'not a date'
                 WHEN (order_id % 20 = 0) <> (copy = 2) THEN strftime(moved, '%Y-%m-%d %H:%M:%S')
                 ELSE strftime(moved, '%I:%M %p, %B %d %Y') END AS order_placed_at,
            order_status, 'Platform Delivery' AS delivery,
            CASE WHEN distance_km < 1 THEN '<1km' ELSE distance_km::INTEGER::VARCHAR || 'km' END AS distance,
            (1 + order_id % 4)::VARCHAR || ' x dish, sauce' AS items_in_order,
            NULL::VARCHAR AS instructions, coalesce(discount_construct, 'null') AS discount_construct,
            (total - (10 + order_id % 15) + order_id % 50 + order_id % 7
                + CASE WHEN order_id % 4 <> 0 THEN order_id % 3 ELSE 0 END + order_id % 5
                + CASE WHEN order_id % 641 = 0 THEN 1 ELSE 0 END)::DECIMAL(18,2)::VARCHAR AS bill_subtotal,
            (10 + order_id % 15)::VARCHAR AS packaging_charges,
            (order_id % 50)::VARCHAR AS restaurant_discount_promo,
            (order_id % 7)::VARCHAR AS restaurant_discount_flat,
            CASE WHEN order_id % 4 <> 0 THEN (order_id % 3)::VARCHAR ELSE 'NaN' END AS gold_discount,
            (order_id % 5)::VARCHAR AS brand_pack_discount, total::VARCHAR AS total,
            coalesce(rating::VARCHAR, '') AS rating, CASE WHEN order_id % 90 = 0 THEN 'cold, "late"' || chr(10) || 'again ' || order_id END AS review,
            NULL::VARCHAR AS cancellation_reason, NULL::VARCHAR AS restaurant_compensation,
            NULL::VARCHAR AS restaurant_penalty,
            CASE WHEN copy = 2 AND order_id % 3 = 1 THEN (order_id % 7 + 0.5::DOUBLE)::VARCHAR ELSE
            coalesce(kpt_duration_minutes::VARCHAR,
                CASE order_id % 3 WHEN 0 THEN 'NaN' WHEN 1 THEN 'null' ELSE '' END) END AS kpt_duration_minutes,
            coalesce(rider_wait_time_minutes::VARCHAR, 'NULL') AS rider_wait_time_minutes,
            CASE order_id % 3 WHEN 0 THEN 'Correctly' WHEN 1 THEN 'Incorrectly' ELSE 'Missed' END
                AS order_ready_marked,
            customer_complaint_tag, customer_id
        FROM (SELECT *, order_placed_at + CASE WHEN copy = 2 THEN order_id % 3 - 1 ELSE 0 END * INTERVAL 1 HOUR AS moved
              FROM ord, range(1, CASE WHEN order_id % 500 = 0 THEN 3 ELSE 2 END) AS copies(copy))""",
    "tidy": "SELECT "
    + ", ".join(f"CASE WHEN {c} NOT IN ('', 'NaN', 'null', 'NULL') THEN {c} END AS {c}" for c in ORDERS)
    + " FROM landed",
    "parsed": "SELECT "
    + ", ".join(
        {
            "order_placed_at": "coalesce(try_strptime(order_placed_at, '%I:%M %p, %B %d %Y'), "
            "try_strptime(order_placed_at, '%Y-%m-%d %H:%M:%S')) AS order_placed_at",
            "distance": "CASE WHEN distance = '<1km' THEN 0.5 "
            "ELSE try_cast(replace(distance, 'km', '') AS DOUBLE) END AS distance_km",
            "restaurant_name": "lower(trim(restaurant_name)) AS restaurant_name",
            "subzone": "lower(trim(subzone)) AS subzone",
            "city": "lower(trim(city)) AS city",
        }.get(c, f"try_cast({c} AS {t.replace('string', 'varchar')}) AS {c}")
        for c, t in ORDERS.items()
    )
    + " FROM tidy",
    "unique_orders": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY order_id
            ORDER BY order_placed_at DESC NULLS LAST, kpt_duration_minutes DESC NULLS LAST) AS rn
            FROM parsed) WHERE rn = 1""",
    "staged": """
        SELECT u.*, o.restaurant_id IS NULL AS is_restaurant_orphaned,
            kpt_duration_minutes < 0 AS is_kpt_invalid, rating > 5 AS is_rating_invalid,
            kpt_duration_minutes IS NULL AS is_kpt_missing,
            rider_wait_time_minutes IS NULL AS is_rider_wait_missing
        FROM unique_orders u LEFT JOIN outlet o ON o.restaurant_id = u.restaurant_id""",
    "landed_seg": """
        SELECT o.restaurant_id, o.subzone, r.is_late,
            CASE WHEN r.is_late = 1 THEN 'late' WHEN r.is_late = 0 THEN 'on_time' ELSE 'not_deliverable' END
                AS delivery_status,
            CASE WHEN distance_km <= 1 THEN 'Band_1' WHEN distance_km <= 3 THEN 'Band_2'
                 WHEN distance_km <= 5 THEN 'Band_3' WHEN distance_km > 5 THEN 'Band_4' END AS distance_band
        FROM staged o LEFT JOIN resolved r ON r.order_id = o.order_id""",
    "landed_dlv": "SELECT * FROM landed_seg WHERE delivery_status <> 'not_deliverable'",
    "first_orders": """
        SELECT customer_id, min(order_placed_at)::DATE AS first_order_date,
            date_trunc('month', min(order_placed_at))::DATE AS cohort_month FROM ord GROUP BY customer_id""",
    "activity": f"""
        SELECT c.cohort_month, o.customer_id, {gap('c.cohort_month', 'o.order_placed_at')} AS m
        FROM ord o JOIN first_orders c ON c.customer_id = o.customer_id""",
    "retention": f"""
        SELECT {label('a.cohort_month')} AS cohort_month, m AS months_since_first_order,
            count(DISTINCT customer_id) AS active_customers, n AS cohort_size,
            {pct('count(DISTINCT customer_id)', 'n')} AS retention_rate
        FROM activity a JOIN (SELECT cohort_month, count(*) AS n FROM first_orders GROUP BY 1) s
            ON s.cohort_month = a.cohort_month GROUP BY a.cohort_month, m, n""",
    "rfm_base": """
        SELECT customer_id, date_trunc('month', min(order_placed_at))::DATE AS cohort_month,
            date_diff('day', max(order_placed_at)::DATE, (SELECT max(order_placed_at)::DATE FROM ord)) AS recency_days,
            count(DISTINCT order_id) AS frequency_orders, sum(total)::DOUBLE AS monetary_total
        FROM ord GROUP BY customer_id""",
    "rfm_scores": """
        SELECT *, ntile(5) OVER (ORDER BY recency_days DESC, customer_id) AS r_score,
            ntile(5) OVER (ORDER BY monetary_total, customer_id) AS m_score,
            (CASE WHEN frequency_orders >= 5 THEN 4 WHEN frequency_orders >= 3 THEN 3
                 ELSE frequency_orders END)::BIGINT AS f_score FROM rfm_base""",
    "rfm": """
        SELECT *, CASE WHEN r_score = 5 AND f_score = 4 AND m_score = 5 THEN 'Champions'
            WHEN r_score >= 4 AND (f_score >= 3 OR m_score = 5) THEN 'Loyal'
            WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'At-risk'
            WHEN r_score = 1 AND f_score = 1 AND m_score = 1 THEN 'Churned' ELSE 'Other' END AS rfm_segment
        FROM rfm_scores""",
    "usage": """
        SELECT customer_id, count(*) AS n, count(discount_construct) AS promo, sum(total) AS spend
        FROM ord GROUP BY customer_id""",
    "partner_rate": f"""
        SELECT partner_id, count(*) AS delivery_count,
            {pct("count(CASE WHEN delivery_status = 'late' THEN 1 END)", 'count(*)')} AS late_rate_pct,
            count(*) < 30 AS is_low_volume FROM dlv GROUP BY partner_id""",
    "outliers": f"""
        SELECT *, late_rate_pct > late_rate_mean + 2 * late_rate_stddev AS late_rate_flag
        FROM partner_rate, (SELECT {mean('late_rate_pct')} AS late_rate_mean,
            round(stddev(late_rate_pct), 2) AS late_rate_stddev FROM partner_rate)""",
    "clean": f"""
        SELECT {mean('late_rate_pct')} AS clean_mean, round(stddev(late_rate_pct), 2) AS clean_stddev
        FROM outliers WHERE NOT late_rate_flag""",
    "zone_band": f"""
        SELECT subzone, distance_band, count(*) AS n, count(CASE WHEN delivery_status = 'late' THEN 1 END) AS late,
            {pct("count(CASE WHEN delivery_status = 'late' THEN 1 END)", 'count(*)')} AS rate FROM dlv GROUP BY ALL""",
    "partner_month": f"""
        SELECT order_month, partner_id, n AS monthly_deliverable_orders, late_rate_pct, is_low_volume,
            month_mean, month_stddev, late_rate_pct > month_mean + 2 * month_stddev AS is_flagged
        FROM (SELECT {label('order_placed_at')} AS order_month, partner_id, count(is_late) AS n,
                 {pct('count(CASE WHEN is_late = 1 THEN 1 END)', 'count(is_late)')} AS late_rate_pct,
                 count(*) < 20 AS is_low_volume
              FROM met WHERE partner_id IS NOT NULL GROUP BY 1, 2)
        JOIN (SELECT order_month, {mean('late_rate_pct')} AS month_mean,
                 round(stddev(late_rate_pct), 2) AS month_stddev
              FROM (SELECT {label('order_placed_at')} AS order_month, partner_id,
                        {pct('count(CASE WHEN is_late = 1 THEN 1 END)', 'count(is_late)')} AS late_rate_pct
                    FROM met WHERE partner_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
        USING (order_month)""",
    "month_orders": """
        SELECT date_trunc('month', order_placed_at)::DATE AS order_month, count(*) AS n,
            sum(total) AS total, coalesce(sum(total) FILTER (discount_construct IS NOT NULL), 0) AS promo
        FROM ord GROUP BY 1""",
    "promo_month": f"""
        SELECT {label('order_month')} AS order_month, total::DOUBLE AS total_revenue,
            promo::DOUBLE AS promo_dependent_revenue, {pct(cents('promo'), cents('total'))} AS pct_promo_dependent
        FROM month_orders""",
    "second_orders": """
        SELECT customer_id, d AS second_date FROM (SELECT customer_id, order_placed_at::DATE AS d,
            row_number() OVER (PARTITION BY customer_id ORDER BY order_placed_at) AS rn FROM ord) WHERE rn = 2""",
    "repeats": f"""
        SELECT {label('cohort_month')} AS cohort_month, count(*) AS cohort_size,
            count(CASE WHEN date_diff('day', first_order_date, second_date) <= 30 THEN 1 END) AS repeat_within_30d_count,
            {pct("count(CASE WHEN date_diff('day', first_order_date, second_date) <= 30 THEN 1 END)", 'count(*)')}
                AS repeat_rate_30d_pct
        FROM first_orders LEFT JOIN second_orders USING (customer_id) GROUP BY cohort_month""",
    "one_time": f"""
        SELECT {label('cohort_month')} AS cohort_month,
            coalesce(sum(spend) FILTER (n = 1), 0)::DOUBLE AS one_time_customer_revenue,
            sum(spend)::DOUBLE AS total_cohort_revenue,
            {pct(cents('coalesce(sum(spend) FILTER (n = 1), 0)'), cents('sum(spend)'))} AS pct_one_time
        FROM first_orders JOIN usage USING (customer_id) GROUP BY cohort_month""",
    "concentration": f"""
        SELECT order_month, subzone, partner_id AS top_partner_id, n AS top_partner_orders,
            all_n AS subzone_total_orders, {pct('n', 'all_n')} AS top_partner_pct,
            {pct('n', 'all_n')} > 30 AS is_concentration_risk, all_n < 100 AS is_low_volume
        FROM (SELECT *, row_number() OVER (PARTITION BY order_month, subzone
                  ORDER BY n DESC, partner_id NULLS LAST) AS rn,
                  (sum(n) OVER (PARTITION BY order_month, subzone))::BIGINT AS all_n
              FROM (SELECT {label('order_placed_at')} AS order_month, subzone, partner_id,
                        count(DISTINCT order_id) AS n FROM met GROUP BY 1, 2, 3)) WHERE rn = 1""",
    "partner_orders": """
        SELECT partner_id, count(resolved.order_id) AS orders
        FROM (SELECT 'DP' || lpad(s_suppkey::VARCHAR, 9, '0') AS partner_id FROM supplier)
        LEFT JOIN resolved USING (partner_id) GROUP BY partner_id""",
    "filled": """
        SELECT order_id, order_status, distance_km,
            coalesce(kpt_duration_minutes, (SELECT median(kpt_duration_minutes) FROM ord)) AS kpt_duration_minutes,
            coalesce(rider_wait_time_minutes, (SELECT median(rider_wait_time_minutes) FROM ord))
                AS rider_wait_time_minutes FROM ord""",
    "months_active": f"""
        SELECT DISTINCT customer_id, date_trunc('month', order_placed_at)::DATE AS month FROM ord""",
    "persist": """
        SELECT cohort_month, a.customer_id, a.month, b.month IS NOT NULL AS followed, a.month = cohort_month AS joining
        FROM months_active a JOIN first_orders USING (customer_id)
        LEFT JOIN months_active b ON b.customer_id = a.customer_id AND b.month = a.month + INTERVAL 1 MONTH
        WHERE a.month < (SELECT max(month) FROM months_active)""",
}


def _rates(*dims: str, floor: int = 30, rows: str = "dlv") -> str:
    keys = ", ".join(dims)
    late = pct("count(CASE WHEN delivery_status = 'late' THEN 1 END)", "count(*)")
    return f"""SELECT {keys}, count(*) AS deliverable_orders, {late} AS late_rate_pct,
        count(*) < {floor} AS is_low_volume FROM {rows} GROUP BY {keys}"""


def _minutes(column: str, out: str) -> str:
    return f"""SELECT subzone, distance_band, count(*) AS order_count, {mean(column)} AS {out},
        count(*) < 30 AS is_low_volume FROM dlv GROUP BY 1, 2"""


def _rolling(grain: str, name: str, prefix: str, frame: str, out: str) -> str:
    late = f"sum(late) OVER (ORDER BY d {frame})"
    count = f"sum(n) OVER (ORDER BY d {frame})"
    return f"""SELECT {name}, n AS {prefix}_deliverable_orders, late AS {prefix}_late_orders,
        ({late})::BIGINT AS rolling_late_count, ({count})::BIGINT AS rolling_deliverable_count,
        {pct(late, count)} AS {out}
        FROM (SELECT {grain} AS d, count(is_late) AS n, count(CASE WHEN is_late = 1 THEN 1 END) AS late FROM seg GROUP BY 1)"""


def _counterfactual(hit: str, rate: str) -> str:
    """``rate`` gives the hypothetical percentage from the sums n, late, tn and tlate."""
    return f"""SELECT n AS deliverable_orders, late AS late_orders, tn AS target_orders,
        tlate AS target_late_orders, {pct('late', 'n')} AS actual_rate_pct, {rate} AS hypothetical_rate_pct,
        round({pct('late', 'n')} - {rate}, 2) AS improvement_pp
        FROM (SELECT count(*) AS n, count(CASE WHEN delivery_status = 'late' THEN 1 END) AS late, count(CASE WHEN {hit} THEN 1 END) AS tn,
            count(CASE WHEN {hit} AND delivery_status = 'late' THEN 1 END) AS tlate FROM dlv)"""


_FLAGGED = "partner_id IN (SELECT partner_id FROM outliers WHERE late_rate_flag)"
_CLEAN = "(SELECT (round(clean_mean * 100))::HUGEINT FROM clean)"

_ISSUES = {
    "second_time_format": "count(CASE WHEN try_strptime(order_placed_at, '%Y-%m-%d %H:%M:%S') IS NOT NULL THEN 1 END)",
    "unreadable_time": "count(CASE WHEN order_placed_at = 'not a date' THEN 1 END)",
    "untidy_text": "count(CASE WHEN lower(trim(restaurant_name)) <> restaurant_name OR lower(trim(subzone)) <> subzone "
    "OR lower(trim(city)) <> city THEN 1 END)",
    "orphaned_restaurant": "count(CASE WHEN restaurant_id IS NULL OR restaurant_id::BIGINT NOT IN "
    "(SELECT restaurant_id FROM outlet) THEN 1 END)",
    "missing_kpt": "count(CASE WHEN kpt_duration_minutes IS NULL THEN 1 END)",
    "missing_rider_wait": "count(CASE WHEN rider_wait_time_minutes IS NULL THEN 1 END)",
    "negative_kpt": "count(CASE WHEN kpt_duration_minutes::DOUBLE < 0 THEN 1 END)",
    "rating_off_scale": "count(CASE WHEN rating::DOUBLE > 5 THEN 1 END)",
    "repeated_order": "count(*) - count(DISTINCT order_id)",
}

_BILL = "bill_subtotal + packaging_charges - (" + " + ".join(f"coalesce({c}, 0)" for c in DISCOUNTS) + ")"

SQL = {
    "a1_csv_source": "SELECT * FROM outlet",
    "a2_null_tokens": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(CASE WHEN {c} IS NULL THEN 1 END) AS null_rows FROM tidy" for c in ORDERS
    ),
    "a3_landing_orders": "SELECT * FROM landed",
    "a4_bulk_append": "SELECT order_status, count(*) AS orders FROM ord GROUP BY 1",
    "a5_row_reconciliation": """
        SELECT *, expected_rows = actual_rows AS ok FROM (
            SELECT 'orders_raw' AS table_name, (SELECT count(*) + count(CASE WHEN o_orderkey % 500 = 0 THEN 1 END) FROM orders)
                AS expected_rows, (SELECT count(*) FROM landed) AS actual_rows
            UNION ALL SELECT 'delivery_ops_fact', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM ops)
            UNION ALL SELECT 'restaurants_dim', (SELECT count(*) FROM part), (SELECT count(*) FROM outlet)
            UNION ALL SELECT 'delivery_partners_dim', (SELECT count(*) + 1 FROM supplier),
                (SELECT count(*) FROM supplier))""",
    "a6_csv_round_trip": """
        SELECT restaurant_name, count(*) AS order_rows, sum(total)::DOUBLE AS total,
            count(kpt_duration_minutes) AS kpt_rows, min(order_placed_at) AS first_order,
            count(review) AS reviews, max(review) AS last_review FROM parsed GROUP BY 1""",
    "a8_layer_tables": "SELECT * FROM first_ops",
    "a9_named_source": "SELECT order_status, count(*) AS orders, sum(total)::DOUBLE AS total FROM ord GROUP BY 1",
    "a10_batch_append": f"SELECT {label('order_month')} AS order_month, n AS orders, total::DOUBLE AS total FROM month_orders",
    "b1_order_dedup": "SELECT order_id, order_placed_at, kpt_duration_minutes, customer_id FROM unique_orders",
    "b2_staged_orders": "SELECT "
    + ", ".join(f"{c}::DOUBLE AS {c}" if t.startswith("decimal") else c for c, t in ORDERS.items() if c != "distance")
    + ", distance_km, is_restaurant_orphaned, is_kpt_invalid, is_rating_invalid, is_kpt_missing,"
    " is_rider_wait_missing FROM staged",
    "b3_text_standardization": "SELECT restaurant_name, subzone, city, count(*) AS order_rows FROM parsed GROUP BY ALL",
    "b4_timestamp_parse": "SELECT order_id, order_placed_at FROM parsed",
    "b5_distance_parse": "SELECT order_id, distance_km FROM parsed",
    "b6_orphan_flag": "SELECT order_id, restaurant_id, is_restaurant_orphaned FROM staged",
    "b7_b8_b9_value_flags": """SELECT order_id, is_kpt_invalid, is_rating_invalid, is_kpt_missing,
        is_rider_wait_missing FROM staged""",
    "b10_ops_dedup": "SELECT * FROM ops_unique",
    "b11_typed_cast": """SELECT is_late, count(*) AS delivery_rows, sum(promised_sla_minutes) AS promised_minutes,
        max(actual_fulfillment_minutes) AS max_actual FROM ops GROUP BY 1""",
    "b12_quality_report": " UNION ALL ".join(
        f"SELECT '{name}' AS issue, {count} AS row_count FROM tidy" for name, count in _ISSUES.items()
    )
    + " UNION ALL SELECT 'repeated_ops_order', count(*) - count(DISTINCT order_id) FROM ops",
    "b13_bill_identity": f"SELECT count({_BILL} + total) AS orders, count(CASE WHEN total <> {_BILL} THEN 1 END) AS violations FROM parsed",
    "b14_drop_unparseable": f"""SELECT {label('order_placed_at')} AS order_month, count(*) AS order_rows
        FROM parsed WHERE order_placed_at IS NOT NULL GROUP BY 1""",
    "b15_response_rate": f"""SELECT count(*) AS delivered_orders, count(rating) AS responses,
        {pct('count(rating)', 'count(*)')} AS response_rate_pct FROM ord WHERE order_status = 'Delivered'""",
    "c1_dimension": """SELECT restaurant_id, arg_min(restaurant_name, order_id) AS restaurant_name,
        arg_min(subzone, order_id) AS subzone FROM ord WHERE restaurant_id IS NOT NULL GROUP BY 1""",
    "c2_bottom_k_exclusion": """SELECT DISTINCT lower(p_brand) AS restaurant_name FROM part
        WHERE lower(p_brand) NOT IN (SELECT restaurant_name FROM ord WHERE restaurant_name IS NOT NULL
            GROUP BY 1 ORDER BY count(*), 1 LIMIT 2)""",
    "c4_median_imputation": "SELECT order_id, kpt_duration_minutes, rider_wait_time_minutes FROM filled",
    "c7_late_flag": "SELECT order_id, is_late FROM resolved",
    "c8_undelivered_mask": """SELECT order_id, CASE WHEN order_status IN ('Delivered', 'Returned', 'Return cancelled')
        THEN was_reassigned END AS was_reassigned FROM resolved JOIN ord USING (order_id)""",
    "c9_late_rate_by_flag": f"""
        SELECT substr(partner_id, -2) IN ('00', '25', '50', '75') AS is_listed, count(is_late) AS orders,
            sum(is_late)::BIGINT AS late_orders, {pct('sum(is_late)', 'count(is_late)')} AS late_rate_pct
        FROM ops WHERE partner_id IS NOT NULL GROUP BY 1
        UNION ALL SELECT NULL, count(is_late), sum(is_late)::BIGINT, {pct('sum(is_late)', 'count(is_late)')}
        FROM ops WHERE partner_id IS NOT NULL""",
    "c10_category_share": """SELECT partner_id, orders,
        orders::DOUBLE / (SELECT sum(orders) FROM partner_orders)::DOUBLE AS share FROM partner_orders""",
    "c12_seeded_sample": """SELECT order_id, customer_id, order_status FROM ord
        ORDER BY md5(order_id::VARCHAR || '11'), order_id LIMIT 40""",
    "c12_one_per_customer": """SELECT customer_id, order_id, order_status FROM (SELECT *, row_number() OVER
        (PARTITION BY customer_id ORDER BY md5(order_id::VARCHAR || '7'), order_id) AS rn FROM ord) WHERE rn = 1""",
    "c13_activity_span": f"""SELECT customer_id, {label('min(order_placed_at)')} AS first_active_month,
        {label('max(order_placed_at)')} AS last_active_month FROM ord GROUP BY 1""",
    "c14_zero_filled_months": f"""
        WITH c AS (SELECT date_trunc('month', order_placed_at)::DATE AS m, subzone, count(*) AS n FROM ord
                   WHERE customer_complaint_tag IS NOT NULL GROUP BY ALL)
        SELECT {label('s.m')} AS order_month, z.subzone, coalesce(c.n, 0) AS orders
        FROM (SELECT unnest(generate_series((SELECT min(m) FROM c), (SELECT max(m) FROM c), INTERVAL 1 MONTH)) AS m) s
        CROSS JOIN (SELECT DISTINCT subzone FROM c) z
        LEFT JOIN c ON c.m = s.m AND c.subzone IS NOT DISTINCT FROM z.subzone""",
    "c15_key_continuation": """SELECT (SELECT max(order_id) FROM ord) + row_number() OVER (ORDER BY user_id, event_id)
        AS order_id, event_id, user_id, event_type FROM events""",
    "c16_persistence_rates": "WITH p AS (SELECT cohort_month, count(CASE WHEN joining THEN 1 END) AS customers, "
    "count(CASE WHEN joining AND followed THEN 1 END) AS active_month1, count(CASE WHEN NOT joining THEN 1 END) AS active_customer_months, "
    "count(CASE WHEN NOT joining AND followed THEN 1 END) AS followed_customer_months FROM persist GROUP BY ROLLUP (cohort_month)) "
    f"SELECT {label('coalesce(p.cohort_month, c.cohort_month)')} AS cohort_month, "
    + ", ".join(
        f"coalesce({c}, 0) AS {c}"
        for c in ("customers", "active_month1", "active_customer_months", "followed_customer_months")
    )
    + f", {pct('active_month1', 'customers')} AS month1_rate_pct, "
    f"{pct('followed_customer_months', 'active_customer_months')} AS persist_rate_pct "
    "FROM p FULL JOIN (SELECT DISTINCT cohort_month FROM first_orders) c ON c.cohort_month = p.cohort_month",
    "c17_average_cohort_size": """SELECT count(*) AS months, sum(n)::BIGINT AS new_customers,
        sum(n)::DOUBLE / count(*) AS avg_new_customers
        FROM (SELECT cohort_month, count(*) AS n FROM first_orders GROUP BY 1)""",
    "d1_partners_per_order": "SELECT * FROM partner_count",
    "d2_lowest_partner_row": "SELECT * FROM first_ops",
    "d3_resolved_assignments": "SELECT * FROM resolved",
    "d4_delivery_segments": """SELECT order_id, order_status, partner_id, was_reassigned, delivery_status,
        distance_band FROM seg""",
    "d5_distance_bands": "SELECT order_id, distance_km, distance_band FROM seg",
    "d6_late_rate_by_restaurant": _rates("restaurant_name"),
    "d6b_late_rate_by_zone": _rates("subzone"),
    "d6b_late_rate_by_partner": _rates("partner_id"),
    "d6c_brand_outlets": f"""
        SELECT *, count(*) OVER (PARTITION BY restaurant_name) AS brand_outlets,
            min(late_rate_pct) FILTER (NOT is_low_volume) OVER (PARTITION BY restaurant_name)
                AS brand_min_late_rate_pct
        FROM ({_rates('restaurant_name', 'restaurant_id', floor=5)})""",
    "d7_counterfactual_partners": _counterfactual(
        _FLAGGED, pct(f"(late - tlate)::HUGEINT * 10000 + tn * {_CLEAN}", "n::HUGEINT * 10000")
    ),
    "d7_counterfactual_brands": _counterfactual(
        "restaurant_name IN ('brand#3', 'brand#7')", pct("late - tlate", "n - tn")
    ),
    "d8_partner_outliers": "SELECT * FROM outliers",
    "d9_clean_baseline_retest": """SELECT o.*, c.*, late_rate_pct > clean_mean + 2 * clean_stddev
        AS flagged_on_clean_baseline FROM outliers o, clean c""",
    "d10_zone_band_late_rate": _rates("subzone", "distance_band"),
    "d6_late_rate_from_landing": _rates("restaurant_id", rows="landed_dlv"),
    "d10_zone_band_from_landing": _rates("subzone", "distance_band", rows="landed_dlv"),
    "d11_possible_kitchen_minutes": _minutes(
        "CASE WHEN kpt_duration_minutes >= 0 THEN kpt_duration_minutes END", "avg_kpt_minutes"
    ),
    "d11_kitchen_minutes": _minutes("kpt_duration_minutes", "avg_kpt_minutes"),
    "d12_rider_wait_minutes": _minutes("rider_wait_time_minutes", "avg_rider_wait_minutes"),
    "d13_partner_mix": f"""SELECT partner_id, count(*) AS order_count,
        {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_of_slice FROM dlv WHERE {SHORT} GROUP BY 1""",
    "d14_zone_band_gaps": f"""
        SELECT subzone, distance_band, n AS deliverable_orders, rate AS late_rate_pct, lo AS peer_min_pct,
            hi AS peer_max_pct, round(rate - hi, 2) AS gap_to_peer_max_pp, own AS own_other_bands_pct,
            round(rate - own, 2) AS gap_to_own_other_bands_pp
        FROM (SELECT a.*,
            (SELECT min(rate) FROM zone_band b WHERE b.distance_band IS NOT DISTINCT FROM a.distance_band
                AND b.subzone <> a.subzone) AS lo,
            (SELECT max(rate) FROM zone_band b WHERE b.distance_band IS NOT DISTINCT FROM a.distance_band
                AND b.subzone <> a.subzone) AS hi,
            (SELECT {pct('sum(late)', 'sum(n)')} FROM zone_band b WHERE b.subzone = a.subzone
                AND b.distance_band IS DISTINCT FROM a.distance_band) AS own
            FROM zone_band a)""",
    "d15_over_representation": f"""
        WITH p AS (SELECT partner_id, count(CASE WHEN {SHORT} THEN 1 END) AS s, count(*) AS n FROM dlv GROUP BY 1),
        l AS (SELECT partner_id, coalesce(s, 0) AS slice_orders, coalesce(n, 0) AS all_orders
              FROM partner_orders LEFT JOIN p USING (partner_id)),
        r AS (SELECT *, {pct('slice_orders', '(SELECT sum(s) FROM p)')} AS slice_share_pct,
              {pct('all_orders', '(SELECT sum(n) FROM p)')} AS overall_share_pct FROM l)
        SELECT *, slice_share_pct > overall_share_pct AS is_over_represented FROM r""",
    "k1_rolling_7day_late_rate": _rolling(
        "order_placed_at::DATE", "d AS order_date", "daily",
        "ROWS BETWEEN 6 PRECEDING AND CURRENT ROW", "rolling_7day_late_rate_pct",
    ),
    "k1_rolling_calendar_days": _rolling(
        "order_placed_at::DATE", "d AS order_date", "daily",
        "RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW", "rolling_7day_late_rate_pct",
    ),
    "k2_rolling_3month_late_rate": _rolling(
        "date_trunc('month', order_placed_at)::DATE", f"{label('d')} AS order_month", "monthly",
        "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW", "rolling_3month_late_rate_pct",
    ),
    "k3_slice_monthly_late_rate": f"""SELECT {label('order_placed_at')} AS order_month,
        count(is_late) AS deliverable_orders, count(CASE WHEN is_late = 1 THEN 1 END) AS late_orders,
        {pct('count(CASE WHEN is_late = 1 THEN 1 END)', 'count(is_late)')} AS late_rate_pct FROM seg WHERE {SHORT} GROUP BY 1""",
    "k4_monthly_partner_outliers": "SELECT * FROM partner_month",
    "k4b_outlier_tally": """SELECT partner_id, count(*) AS months_observed, count(CASE WHEN is_flagged THEN 1 END) AS months_flagged
        FROM partner_month GROUP BY 1 HAVING count(CASE WHEN is_flagged THEN 1 END) > 0""",
    "k5_brand_late_rate": f"""
        SELECT *, monthly_deliverable_orders < brand_avg_monthly_orders * 0.3::DOUBLE AS is_low_volume
        FROM (SELECT *, avg(monthly_deliverable_orders) OVER (PARTITION BY restaurant_name) AS brand_avg_monthly_orders
              FROM (SELECT {label('order_placed_at')} AS order_month, restaurant_name,
                        count(is_late) AS monthly_deliverable_orders,
                        {pct('count(CASE WHEN is_late = 1 THEN 1 END)', 'count(is_late)')} AS late_rate_pct
                    FROM met GROUP BY 1, 2))""",
    "k6_partner_concentration": "SELECT * FROM concentration",
    "k6b_dominance_tally": """SELECT top_partner_id, count(*) AS zone_months_led,
        count(CASE WHEN is_concentration_risk THEN 1 END) AS zone_months_at_risk FROM concentration GROUP BY 1""",
    "e1_cohorts": "SELECT * FROM first_orders",
    "e2_cohort_sizes": f"""SELECT {label('cohort_month')} AS cohort_month, count(*) AS cohort_size
        FROM first_orders GROUP BY first_orders.cohort_month""",
    "e3_retention_matrix": "SELECT * FROM retention",
    "e4_snapshot_date": "SELECT max(order_placed_at)::DATE AS snapshot_date FROM ord",
    "e5_rfm_base": "SELECT * FROM rfm_base",
    "e6_rfm_scores": "SELECT * FROM rfm_scores",
    "e7_rfm_segments": "SELECT customer_id, r_score, f_score, m_score, rfm_segment FROM rfm",
    "e8_segment_summary": f"""SELECT rfm_segment, count(*) AS customers,
        {pct('count(*)', '(SELECT count(*) FROM rfm)')} AS share_pct FROM rfm GROUP BY 1""",
    "e9_segment_share_by_cohort": f"""SELECT {label('r.cohort_month')} AS cohort_month, rfm_segment,
        count(*) AS customers, {pct('count(*)', 'any_value(n)')} AS share_of_cohort_pct
        FROM rfm r JOIN (SELECT cohort_month, count(*) AS n FROM rfm GROUP BY 1) c ON c.cohort_month = r.cohort_month
        GROUP BY r.cohort_month, rfm_segment""",
    "e10_first_order_attribute": """SELECT customer_id, discount_construct IS NOT NULL AS first_order_had_discount
        FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_placed_at, order_id) AS rn
              FROM ord) WHERE rn = 1""",
    "e11_retention_by_first_order": f"""
        WITH f AS (SELECT customer_id, discount_construct IS NOT NULL AS flag FROM (SELECT *, row_number() OVER
                (PARTITION BY customer_id ORDER BY order_placed_at, order_id) AS rn FROM ord) WHERE rn = 1),
        c AS (SELECT flag, cohort_month, m, count(DISTINCT customer_id) AS n
              FROM activity JOIN f USING (customer_id) GROUP BY ALL)
        SELECT flag AS first_order_had_discount, {label('cohort_month')} AS cohort_month,
            m AS months_since_first_order, n AS active_customers, size AS cohort_size,
            {pct('n', 'size')} AS retention_rate
        FROM (SELECT *, first_value(n) OVER (PARTITION BY flag, cohort_month ORDER BY m) AS size FROM c)""",
    "e12_promo_share_sensitivity": " UNION ALL ".join(
        f"""SELECT {t}::BIGINT AS threshold_pct, count(CASE WHEN promo * 100 > n * {t} THEN 1 END) AS promo_customers,
        coalesce(sum(spend) FILTER (promo * 100 > n * {t}), 0)::DOUBLE AS promo_revenue,
        sum(spend)::DOUBLE AS total_revenue,
        {pct(cents(f'coalesce(sum(spend) FILTER (promo * 100 > n * {t}), 0)'), cents('sum(spend)'))}
            AS revenue_share_pct FROM usage"""
        for t in (40, 45, 50, 55, 60, 65, 70)
    ),
    "e13_spend_concentration": "WITH p AS (SELECT *, row_number() OVER (ORDER BY spend DESC, customer_id) AS rn, "
    "count(*) OVER () AS size FROM usage WHERE promo * 2 > n) "
    + " UNION ALL ".join(
        f"""SELECT {t}::BIGINT AS top_pct, count(CASE WHEN rn <= ceil(size * {t} / 100) THEN 1 END) AS customers,
        (sum(spend) FILTER (rn <= ceil(size * {t} / 100)))::DOUBLE AS top_revenue,
        sum(spend)::DOUBLE AS segment_revenue,
        {pct(cents(f'sum(spend) FILTER (rn <= ceil(size * {t} / 100))'), cents('sum(spend)'))}
            AS revenue_share_pct FROM p"""
        for t in (10, 20)
    ),
    "e14_repeat_within_30d": "SELECT * FROM repeats",
    "e15_month_one_retention": "SELECT * FROM retention WHERE months_since_first_order = 1",
    "e16_one_time_revenue": "SELECT * FROM one_time",
    "e17_promo_revenue_share": "SELECT * FROM promo_month",
    "e17b_promo_band_check": "SELECT *, pct_promo_dependent NOT BETWEEN 65 AND 80 AS is_outside_band FROM promo_month",
    "e18_champions_conversion": f"""SELECT {label('cohort_month')} AS cohort_month,
        count(CASE WHEN rfm_segment = 'Champions' THEN 1 END) AS champions, count(*) AS cohort_size,
        {pct("count(CASE WHEN rfm_segment = 'Champions' THEN 1 END)", 'count(*)')} AS conversion_pct
        FROM rfm GROUP BY rfm.cohort_month""",
    "e19_at_risk_mature_cohorts": f"""
        WITH c AS (SELECT cohort_month, count(CASE WHEN rfm_segment = 'At-risk' THEN 1 END) AS n,
            {gap('cohort_month', '(SELECT max(order_placed_at)::DATE FROM ord)')} >= 2 AS mature
            FROM rfm GROUP BY cohort_month),
        t AS (SELECT (sum(n) FILTER (mature))::BIGINT AS mature_n, sum(n)::BIGINT AS all_n FROM c)
        SELECT {label('cohort_month')} AS cohort_month, n AS at_risk_customers, {pct('n', 'mature_n')} AS share_pct,
            mature_n AS mature_at_risk, all_n AS all_at_risk FROM c, t WHERE mature""",
    "e20_complaint_rate": f"""SELECT {label('order_placed_at')} AS order_month, count(order_id) AS total_orders,
        count(customer_complaint_tag) AS complaint_count,
        {pct('count(customer_complaint_tag)', 'count(*)')} AS complaint_rate_per_100
        FROM ord WHERE order_status NOT IN ('Timed out', 'Rejected') GROUP BY 1""",
    "e21_maturity_days": """SELECT *, last_day((cohort_month || '-01')::DATE) + 30
        <= (SELECT max(order_placed_at)::DATE FROM ord) AS is_mature FROM repeats""",
    "e21_maturity_months": f"""SELECT *, {gap("(cohort_month || '-01')::DATE", '(SELECT max(order_placed_at)::DATE FROM ord)')} >= 2
        AS is_mature FROM one_time""",
    "e22_order_frequency": f"""SELECT n AS frequency_orders, count(*) AS customers,
        {pct('count(*)', '(SELECT count(*) FROM usage)')} AS share_pct FROM usage GROUP BY n""",
}

# The same results reached another way.
SQL["k6_concentration_known_partners"] = "SELECT * FROM concentration"
SQL["e3_retention_from_landing"] = "SELECT * FROM retention"
SQL["d9_outliers_from_landing"] = SQL["d9_clean_baseline_retest"]

SQL["a5_counts_from_load"] = SQL["a5_row_reconciliation"]
SQL["d4_segments_from_layers"] = SQL["d4_delivery_segments"]
SQL["k1_from_kept_counts"] = SQL["k1_rolling_7day_late_rate"]
SQL["k2_from_kept_counts"] = SQL["k2_rolling_3month_late_rate"]
SQL["k4_from_kept_counts"] = SQL["k4_monthly_partner_outliers"]
SQL["k6_from_kept_counts"] = SQL["k6_partner_concentration"]
SQL["e20_from_kept_counts"] = SQL["e20_complaint_rate"]
SQL["b12_defects_from_load"] = " UNION ALL ".join(
    f"SELECT '{name}' AS issue, {count} AS row_count FROM tidy"
    for name, count in _ISSUES.items()
    if name not in ("orphaned_restaurant", "repeated_order")
)
SQL["a4_batches_loaded_once"] = """
    SELECT order_status, count(*) AS orders, sum(total)::DOUBLE AS total FROM ord GROUP BY 1
    UNION ALL SELECT 'rows', count(*), NULL FROM ord"""
SQL["a4_new_files_once"] = """
    SELECT restaurant_name, false AS rejected, count(*) AS outlets FROM outlet GROUP BY 1"""
SQL["a1_malformed_rows_kept"] = """
    WITH o AS (SELECT *, restaurant_id % 50 AS k,
               restaurant_id || ',"' || restaurant_name || '","' || subzone || '"' AS begun FROM outlet)
    SELECT restaurant_id::VARCHAR AS restaurant_id,
           CASE k WHEN 3 THEN begun WHEN 4 THEN begun || ',metro city,"a, b"'
                  ELSE restaurant_name || '|' || subzone || '|metro city' END AS content,
           CASE k WHEN 3 THEN 'too few fields' WHEN 4 THEN 'too many fields' END AS reason
    FROM o
    UNION ALL SELECT NULL, count(*)::VARCHAR, 'rows' FROM o
    UNION ALL SELECT NULL, count(CASE WHEN k NOT IN (3, 4) THEN 1 END)::VARCHAR, 'good_rows' FROM o
    UNION ALL SELECT NULL, count(CASE WHEN k = 3 THEN 1 END)::VARCHAR, 'too_few_fields' FROM o
    UNION ALL SELECT NULL, count(CASE WHEN k = 4 THEN 1 END)::VARCHAR, 'too_many_fields' FROM o"""
_GRAINS = {
    "outlet": ("restaurant_id",),
    "brand outlet": ("restaurant_name", "restaurant_id"),
    "zone": ("subzone",),
    "partner": ("partner_id",),
    "zone and band": ("subzone", "distance_band"),
}
_KINDS = {"restaurant_id": "BIGINT"}


def _one_grain(name: str, keys: tuple[str, ...]) -> str:
    columns = dict.fromkeys(c for grain in _GRAINS.values() for c in grain)
    shown = ", ".join(c if c in keys else f"NULL::{_KINDS.get(c, 'VARCHAR')} AS {c}" for c in columns)
    return (
        f"SELECT '{name}' AS grain, {shown}, count(*) AS deliverable_orders, "
        + pct("count(CASE WHEN delivery_status = 'late' THEN 1 END)", "count(*)")
        + f" AS late_rate_pct, count(*) < 30 AS is_low_volume FROM dlv GROUP BY {', '.join(keys)}"
    )


SQL["d6_late_rates_by_grain"] = " UNION ALL ".join(_one_grain(*grain) for grain in _GRAINS.items())

# Frames that differ for single queries.
_OVERRIDES = {
    "k6_concentration_known_partners": {
        "met": FRAMES["met"] + " WHERE r.partner_id IS NOT NULL",
    },
    "e3_retention_from_landing": {
        "first_orders": FRAMES["first_orders"].replace("FROM ord", "FROM staged"),
        "activity": FRAMES["activity"].replace("FROM ord", "FROM staged"),
    },
}


def _needed(sql: str, frames: dict[str, str]) -> list[str]:
    """Frames a statement uses, directly or through others, in definition order."""
    found: set[str] = set()

    def visit(text: str) -> None:
        for name in frames:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                visit(frames[name])

    visit(sql)
    return [name for name in frames if name in found]


def statements() -> dict[str, str]:
    result = {}
    for name, sql in SQL.items():
        frames = {**FRAMES, **_OVERRIDES.get(name, {})}
        body = sql.strip()
        heads = [f"{f} AS ({frames[f]})" for f in _needed(body, frames)]
        if body.startswith("WITH "):
            result[name] = "WITH " + ", ".join([*heads, body[len("WITH "):]])
        else:
            result[name] = "WITH " + ", ".join(heads) + " " + body if heads else body
    return result
