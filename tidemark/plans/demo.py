"""The demo pack over the driver's tables: what the registered planning, guard and card queries run on."""

from __future__ import annotations

from ..operators.packs import Pack, parse

NET_REVENUE_SQL = """
WITH firsts AS (SELECT o_custkey AS custkey, date_trunc('MONTH', min(o_orderdate)) AS first_month FROM orders GROUP BY o_custkey)
SELECT CAST(date_trunc('MONTH', o.o_orderdate) AS DATE) AS order_month,
  CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS net_revenue
FROM orders o JOIN firsts f ON o.o_custkey = f.custkey AND date_trunc('MONTH', o.o_orderdate) = f.first_month
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderstatus = 'F' AND o.o_orderdate >= CAST(:start_date AS TIMESTAMP)
GROUP BY 1
""".strip()

QUESTION = "monthly net revenue of new customers"

DOCUMENT = {
    "id": "pack.demo", "version": "0.1.0", "status": "approved", "title": "Orders demo", "description": "Orders, their lines and customers.", "locale": "en", "owners": ["data"],
    "spaces": [{"id": "space.sales", "title": "Sales", "description": "Orders and revenue"}],
    "tables": [
        {"id": "table.orders", "space_id": "space.sales", "physical_name": "orders", "title": "Orders", "description": "One row an order", "role": "fact", "grain": "order", "primary_key": "o_orderkey", "columns": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"], "pii_level": "none", "status": "approved", "confidence": 1.0},
        {"id": "table.lineitem", "space_id": "space.sales", "physical_name": "lineitem", "title": "Lines", "description": "One row an order line", "role": "fact", "grain": "line", "columns": ["l_orderkey", "l_extendedprice", "l_discount"], "pii_level": "none", "status": "approved", "confidence": 1.0},
        {"id": "table.customer", "space_id": "space.sales", "physical_name": "customer", "title": "Customers", "description": "One row a customer", "role": "dimension", "grain": "customer", "primary_key": "c_custkey", "columns": ["c_custkey", "c_name", "c_mktsegment"], "pii_level": "contains_pii", "status": "approved", "confidence": 1.0},
    ],
    "columns": [
        {"id": f"column.{t}.{c}", "table": t, "name": c, "data_type": d, "nullable": False, "is_pii": c == "c_name", "description": c, "status": "approved"}
        for t, c, d in (("orders", "o_orderkey", "numeric"), ("orders", "o_custkey", "numeric"), ("orders", "o_orderstatus", "string"), ("orders", "o_orderdate", "date"), ("lineitem", "l_orderkey", "numeric"), ("lineitem", "l_extendedprice", "numeric"), ("lineitem", "l_discount", "numeric"), ("customer", "c_custkey", "numeric"), ("customer", "c_name", "string"), ("customer", "c_mktsegment", "string"))
    ],
    "value_dictionaries": [
        {"id": "values.orders.o_orderstatus", "table": "orders", "column": "o_orderstatus", "values": [{"value": "F", "label": "finished", "count": 1}, {"value": "O", "label": "open", "count": 1}, {"value": "P", "label": "pending", "count": 1}], "status": "approved"},
    ],
    "metrics": [
        {"id": "metric.net_revenue", "name": "net_revenue", "label": "net revenue", "description": "Price less discount", "formula_sql": "SUM(l_extendedprice * (1 - l_discount))", "date_basis": "orders.o_orderdate", "required_tables": ["orders", "lineitem"], "default_filters": ["o_orderstatus = 'F'"], "status": "approved", "owner": "finance"},
        {"id": "metric.gross_revenue", "name": "gross_revenue", "label": "gross revenue", "description": "Price", "formula_sql": "SUM(l_extendedprice)", "date_basis": "orders.o_orderdate", "required_tables": ["lineitem"], "default_filters": [], "status": "draft", "owner": "finance"},
    ],
    "business_terms": [
        {"id": "term.new_customer", "term": "new customers", "aliases": ["new customer", "first-time buyers"], "definition": "Customers in the month of their first order", "sql_condition": "order_month = first_month", "related_tables": ["orders", "customer"], "related_metrics": ["metric.net_revenue"],
         "ambiguity_rules": [{"id": "ambiguity.refunds", "target": "metric.net_revenue", "condition": "refunds", "question": "Are returned lines part of revenue?", "required_when": "revenue"}], "status": "approved"},
    ],
    "join_recipes": [
        {"id": "join.orders_lineitem", "left_table": "orders", "right_table": "lineitem", "join_type": "one_to_many", "condition": "orders.o_orderkey = lineitem.l_orderkey", "recommended": True, "warnings": ["orders repeat for each line"], "status": "approved"},
        {"id": "join.orders_customer", "left_table": "orders", "right_table": "customer", "join_type": "many_to_one", "condition": "orders.o_custkey = customer.c_custkey", "recommended": True, "warnings": [], "status": "approved"},
    ],
    "policies": [{"id": "policy.analyst", "roles": ["analyst"], "allowed_tables": ["orders", "lineitem", "customer"], "blocked_columns": ["customer.c_name"], "max_preview_rows": 100, "notes": []}],
    "verified_queries": [{"id": "verified.monthly_net_revenue", "question": QUESTION, "sql": NET_REVENUE_SQL, "related_terms": ["term.new_customer"], "related_metrics": ["metric.net_revenue"], "status": "approved"}],
    "reverse_questions": [{"id": "question.returns", "target": "metric.net_revenue", "question": "Do returned lines count?", "reason": "Lines have a return flag", "status": "open", "answer": None}],
    "metadata": {"source": "demo"},
}


def pack() -> Pack:
    return parse(DOCUMENT)
