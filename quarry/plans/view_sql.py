"""SQL text of the derived views (FIXTURES.md §C), used only by the DuckDB
oracles.  :func:`with_views` prepends the views a query mentions as CTEs."""

from __future__ import annotations

import re

VIEW_SQL = {
    "v_sales": """SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, CAST(o.o_orderdate AS DATE) AS order_date, n.n_name AS city,
 p.p_brand AS category, p.p_name AS product, CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'cancelled' ELSE 'returned' END AS status,
 l.l_quantity AS quantity, l.l_extendedprice / l.l_quantity AS unit_price, l.l_discount AS discount_rate,
 l.l_extendedprice * (1 - l.l_discount) AS sales, l.l_extendedprice * CAST(0.93 AS DOUBLE) AS cost,
 l.l_extendedprice * (1 - l.l_discount) - l.l_extendedprice * CAST(0.93 AS DOUBLE) AS profit,
 (l.l_extendedprice * (1 - l.l_discount) - l.l_extendedprice * CAST(0.93 AS DOUBLE)) / (l.l_extendedprice * (1 - l.l_discount)) AS profit_rate,
 o.o_orderpriority AS payment_method, c.c_mktsegment AS channel
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
 JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_subs": """SELECT o.o_orderkey AS row_key, o.o_custkey AS customer_id, c.c_name AS company, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month,
 o.o_totalprice AS mrr, CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'high' WHEN o.o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS renewal_risk,
 n.n_name AS manager, CASE o.o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'overdue' ELSE 'failed' END AS payment_status,
 o.o_totalprice AS invoice_amount, CAST(o.o_orderkey % 90 AS INT) AS overdue_days, concat('channel_', CAST(o.o_custkey % 5 AS VARCHAR(8))) AS channel, c.c_mktsegment AS industry,
 CASE WHEN c.c_acctbal < 2000 THEN 'SMB' WHEN c.c_acctbal < 6000 THEN 'Mid' ELSE 'Enterprise' END AS segment, concat('plan_', CAST(o.o_custkey % 3 AS VARCHAR(8))) AS plan,
 CASE WHEN o.o_orderkey % 11 = 0 THEN 'yes' ELSE 'no' END AS churn,
 CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(o.o_orderkey % 11 AS DOUBLE) END AS nps,
 CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE 1 + (o.o_orderkey % 41) / CAST(10 AS DOUBLE) END AS csat,
 CAST(o.o_orderkey % 300 AS DOUBLE) AS usage_hours, CAST(o.o_custkey % 97 AS DOUBLE) AS active_users, CAST(o.o_orderkey % 9 AS DOUBLE) AS tickets, CAST(o.o_orderkey % 4 AS DOUBLE) AS sla_breaches
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "v_pipe": """SELECT o.o_orderkey AS deal_id, o.o_totalprice AS amount, CAST(o.o_orderkey % 101 AS DOUBLE) AS win_rate,
 CASE o.o_orderstatus WHEN 'F' THEN 'closed won' WHEN 'O' THEN 'negotiation' ELSE 'lost' END AS stage, n.n_name AS owner, o.o_orderpriority AS deal_type
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "v_log": """SELECT event_id AS sequence_id, user_id AS task_id, ts, CASE event_type WHEN 'signup' THEN 'task_started' WHEN 'purchase' THEN 'task_completed' WHEN 'error' THEN 'task_failed' ELSE 'node_completed' END AS event_type,
 CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, event_type AS node, value, props AS payload, concat('tenant_', CAST(user_id % 7 AS VARCHAR(8))) AS tenant_id
FROM events""",
    "v_tok": """SELECT event_id AS usage_id, user_id AS task_id, ts AS created_at, CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(event_id % 50 AS BIGINT) AS completion_tokens,
 CASE WHEN event_type = 'view' THEN 'estimated' ELSE 'provider' END AS source, CAST(length(props) AS BIGINT) AS output_bytes FROM events""",
    "v_q": """SELECT o_orderkey AS q_id, CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN concat('total sum by ', o_orderpriority, ' 2025-', CAST(month(o_orderdate) AS VARCHAR(2)))
 WHEN 1 THEN concat('Predict next month for ', n_name) WHEN 2 THEN concat('top customer name in ', n_name) WHEN 3 THEN 'Does price cause churn?'
 WHEN 4 THEN concat('数据质量有哪些明显问题？', n_name, '的总金额；', CAST(year(o_orderdate) AS VARCHAR(4)), '年3月趋势') WHEN 5 THEN 'hello' WHEN 6 THEN 'correlation of price and quantity' ELSE concat('count orders by status in ', n_name) END AS question
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "v_ask": """SELECT q_id, CASE q_id % 16 WHEN 0 THEN n_name || '的续约和账款逾期风险怎样联动' WHEN 1 THEN '各客户分层和套餐的MRR' WHEN 2 THEN '客户成功应优先处理哪些高风险客户，' || r_name
 WHEN 3 THEN n_name || '的获客渠道投放贡献复盘' WHEN 4 THEN '哪些行业适合重点拓展，' || r_name || '市场' WHEN 5 THEN y || '年' || m || '月和' || (13 - m) || '月MRR扩张收缩对比'
 WHEN 6 THEN 'NPS、CSAT和工单与风险有什么关系' WHEN 7 THEN '已完成订单经营总览，' || y || '-' || m || '，满意度' WHEN 8 THEN '订单状态对销售额的影响；利润最高的商品名称是什么，' || n_name
 WHEN 9 THEN '主要利润的集中度 Pareto' WHEN 10 THEN '折扣与利润率的关系' WHEN 11 THEN '支付方式的结构占比' WHEN 12 THEN '销售渠道的退货率和复购率，流失率'
 WHEN 13 THEN 'pipeline 商机总金额按负责人排序' WHEN 14 THEN 'top product name by c_acctbal in ' || r_name ELSE 'monthly trend of c_acctbal in ' || n_name || ' ' || y || '/' || m END AS question
FROM (SELECT o_orderkey AS q_id, n_name, r_name, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey)""",
    "v_dirty": """SELECT * FROM (WITH base AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 29 = 0 THEN -o_totalprice ELSE o_totalprice END AS mrr,
 CAST(1 + o_orderkey % 10 AS DOUBLE) AS quantity, CAST(5 + o_orderkey % 20 AS DOUBLE) AS unit_price,
 CASE WHEN o_orderkey % 31 = 0 THEN CAST(70 AS DOUBLE) WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(0.1 AS DOUBLE) END AS discount_rate, 'EUR' AS currency, concat('ref-', CAST(o_orderkey AS VARCHAR(20))) AS reference FROM orders),
 priced AS (SELECT *, CASE WHEN order_id % 37 = 0 THEN CAST(0 AS DOUBLE) WHEN order_id % 41 = 0 THEN quantity * unit_price + 1 ELSE quantity * unit_price * (1 - CAST(coalesce(CASE WHEN discount_rate <= 1 THEN discount_rate ELSE discount_rate / 100 END, 0) AS DOUBLE)) END AS sales, quantity * unit_price * CAST(0.6 AS DOUBLE) AS cost FROM base),
 full_rows AS (SELECT *, CASE WHEN order_id % 43 = 0 THEN sales - cost + 5 ELSE sales - cost END AS profit, CASE WHEN order_id % 47 = 0 THEN CAST(0.99 AS DOUBLE) WHEN sales = 0 THEN NULL ELSE (sales - cost) / sales END AS profit_rate FROM priced)
SELECT * FROM full_rows UNION ALL SELECT * FROM full_rows WHERE order_id % 53 = 0)""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every derived view it references."""
    used = [name for name in VIEW_SQL if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
