"""A catalog of the driver's star schema, and query texts made from its rows whose verdicts follow from how they are made.

``{n}`` stands for a number and ``{s}`` for a text of a row of ``orders``.
"""

from __future__ import annotations

#: table: (columns with types, primary key, foreign keys as column: (table, column)).
STAR = {
    "region": ({"r_regionkey": "INT", "r_name": "VARCHAR"}, ["r_regionkey"], {}),
    "nation": ({"n_nationkey": "INT", "n_name": "VARCHAR", "n_regionkey": "INT"}, ["n_nationkey"], {"n_regionkey": ("region", "r_regionkey")}),
    "customer": ({"c_custkey": "BIGINT", "c_name": "VARCHAR", "c_nationkey": "INT", "c_acctbal": "DOUBLE", "c_mktsegment": "VARCHAR"}, ["c_custkey"], {"c_nationkey": ("nation", "n_nationkey")}),
    "supplier": ({"s_suppkey": "BIGINT", "s_name": "VARCHAR", "s_nationkey": "INT", "s_acctbal": "DOUBLE"}, ["s_suppkey"], {"s_nationkey": ("nation", "n_nationkey")}),
    "part": ({"p_partkey": "BIGINT", "p_name": "VARCHAR", "p_brand": "VARCHAR", "p_type": "VARCHAR", "p_size": "INT", "p_retailprice": "DOUBLE"}, ["p_partkey"], {}),
    "orders": (
        {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR", "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP", "o_orderpriority": "VARCHAR"}, ["o_orderkey"],
        {"o_custkey": ("customer", "c_custkey")},
    ),
    "lineitem": (
        {"l_orderkey": "BIGINT", "l_partkey": "BIGINT", "l_suppkey": "BIGINT", "l_linenumber": "INT", "l_quantity": "DOUBLE", "l_extendedprice": "DOUBLE", "l_returnflag": "VARCHAR"},
        ["l_orderkey", "l_linenumber"], {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")},
    ),
}
WIRE = {
    t: {"columns": columns, "primary_keys": keys, "foreign_keys": [{"column": c, "target_table": a, "target_column": b} for c, (a, b) in links.items()]}
    for t, (columns, keys, links) in STAR.items()
}

#: Correct texts.
SOUND = (
    "SELECT c_name FROM customer WHERE c_acctbal > {n}",
    "SELECT o_orderpriority, count(*) FROM orders WHERE o_orderstatus = '{s}' GROUP BY o_orderpriority",
    "SELECT c.c_name, o.o_totalprice FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > {n}",
    "SELECT c.c_name, count(*) FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey HAVING count(*) > 2",
    "SELECT p_brand, max(p_size) FROM part WHERE p_partkey < {n} GROUP BY p_brand ORDER BY 2 DESC LIMIT 3",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders WHERE o_custkey <> {n})",
    "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = '{s}')",
    "SELECT s_name FROM supplier WHERE s_acctbal BETWEEN 0 AND {n} UNION SELECT c_name FROM customer",
    "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > {n}) SELECT o_custkey FROM big",
    "SELECT c_name FROM customer WHERE c_mktsegment = \"{s}\" AND c_custkey = '{n}'",
    "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey < {n}",
    "SELECT c_name FROM customer AS c JOIN orders AS o JOIN lineitem AS l ON c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey WHERE l_quantity > {n}",
    "SELECT a.c_name FROM customer AS a CROSS JOIN region WHERE a.c_custkey < {n}",
    "SELECT c_name, rank() OVER (ORDER BY c_acctbal) FROM customer WHERE c_custkey > {n}",
    "SELECT upper(p_type), count(*) FROM part WHERE p_size IN (1, 2, {n}) GROUP BY upper(p_type)",
    "SELECT c_name FROM customer AS c WHERE EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey = {n})",
    "SELECT count(DISTINCT o_custkey) FROM orders HAVING count(*) > {n}",
    "SELECT t.k FROM (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) AS t WHERE t.total > {n};",
)
#: Wrong texts by class; each breaks one rule.
FAULTY = {
    "SYNTAX_ERROR": (
        "SELEC c_name FROM customer WHERE c_custkey = {n}", "SELECT c_name, FROM customer WHERE c_custkey = {n}", "SELECT c_name FROM customer WHERE c_custkey = {n} AND",
        "SELECT count(* FROM orders WHERE o_custkey = {n}", "SELECT c_name FROM customer WHERE c_name = '{s}", "SELECT o_custkey FROM orders GROUP o_custkey", "SELECT 1; SELECT {n}", "PRAGMA table_info(orders)",
        "SELECT c_name FROM customer WHERE WHERE c_custkey = {n}",
    ),
    "UNKNOWN_TABLE": ("SELECT c_name FROM customers WHERE c_custkey = {n}", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM client WHERE c_custkey = {n})"),
    "UNKNOWN_COLUMN": ("SELECT c_nme FROM customer WHERE c_custkey = {n}", "SELECT z.c_name FROM customer AS c WHERE c_custkey = {n}", "SELECT o_orderkey FROM orders WHERE price > {n}"),
    "AMBIGUOUS_REFERENCE": (
        "SELECT c_name FROM customer AS a JOIN customer AS b ON a.c_custkey = b.c_custkey WHERE a.c_custkey = {n}",
        "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c.c_custkey FROM customer AS c JOIN nation AS c ON c.c_nationkey = c.n_nationkey AND c.c_custkey < {n})",
    ),
    "DATATYPE_MISMATCH": (
        "SELECT c_name FROM customer WHERE c_acctbal = 'rich' AND c_custkey = {n}", "SELECT c_name FROM customer WHERE c_name = {n}", "SELECT avg(c_name) FROM customer WHERE c_custkey = {n}",
        "SELECT c_name FROM customer WHERE 'rich' < c_acctbal AND c_custkey = {n}", "SELECT p_name FROM part WHERE p_size IN ({n}, 'big')", "SELECT p_name FROM part WHERE p_size BETWEEN {n} AND 'big'",
        "SELECT p_name FROM part WHERE \"p_size\" = 'big' AND p_partkey = {n}", "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = {n})",
        "SELECT c_name FROM customer WHERE c_custkey = {n} UNION SELECT s_name FROM supplier WHERE s_name > {n}", "SELECT sum(DISTINCT p_brand) FROM part WHERE p_partkey = {n}",
    ),
    "SEMANTIC_ERROR": (
        "SELECT c_name FROM customer WHERE c_nationkey = NULL AND c_custkey = {n}", "SELECT c_name FROM customer WHERE NULL <> c_nationkey AND c_custkey = {n}",
        "SELECT o_custkey FROM orders WHERE sum(o_totalprice) > {n}", "SELECT c_name, count(*) FROM customer WHERE c_custkey < {n}", "SELECT p_brand, p_name FROM part WHERE p_partkey < {n} GROUP BY p_brand",
        "SELECT c_name FROM customer WHERE c_custkey < {n} ORDER BY 4", "SELECT c_name FROM customer WHERE c_custkey = {n} UNION SELECT s_name, s_suppkey FROM supplier",
        "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey = {n})", "SELECT cnt(*) FROM orders WHERE o_custkey = {n}",
        "SELECT c_name FROM customer AS c JOIN orders AS o WHERE c.c_custkey = {n}", "SELECT c_name FROM customer WHERE c_custkey = c_custkey AND c_acctbal > {n}",
        "SELECT s_name FROM supplier WHERE s_suppkey < {n} HAVING s_acctbal > 1", "SELECT upper(c_name), count(*) FROM customer WHERE c_custkey < {n}",
        "SELECT s_name FROM supplier WHERE s_suppkey = {n} UNION SELECT c_name FROM customer GROUP BY c_mktsegment",
        "SELECT c_name, count(*) FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_custkey < {n})",
        "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c.c_nationkey FROM customer AS c JOIN orders AS o WHERE o.o_orderkey = {n})",
        "SELECT p_brand, count(*) FROM part WHERE p_partkey < {n} GROUP BY p_brand HAVING p_size > 3",
    ),
}
LABELLED = [(t, "CORRECT") for t in SOUND] + [(t, label) for label, texts in FAULTY.items() for t in texts]

#: What a policy that closes table ``supplier`` and column ``customer.c_acctbal`` says.
CLOSED = (["supplier"], ["customer.c_acctbal"])
GUARDED = [
    ("SELECT s_name FROM supplier WHERE s_suppkey = {n}", True), ('SELECT count(*) FROM "supplier" WHERE s_suppkey = {n}', True), ("SELECT c_acctbal FROM customer WHERE c_custkey = {n}", True),
    ("SELECT * FROM customer WHERE c_custkey = {n}", True), ("SELECT x.* FROM customer AS x JOIN orders AS o ON x.c_custkey = o.o_custkey WHERE o.o_orderkey = {n}", True),
    ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > {n})", True), ("SELECT c_name FROM customer WHERE c_custkey < {n} ORDER BY \"c_acctbal\"", True),
    ("SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = {n})", True),
    ("SELECT c_name FROM customer WHERE c_custkey = {n}", False), ("SELECT count(*) FROM customer WHERE c_custkey < {n}", False), ("SELECT c_custkey AS c_acctbal FROM customer WHERE c_custkey = {n}", False),
    ("SELECT o.* FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE c.c_custkey = {n}", False), ("WITH supplier AS (SELECT o_orderkey FROM orders) SELECT o_orderkey FROM supplier WHERE o_orderkey = {n}", False),
    ("SELECT * FROM orders AS o JOIN (SELECT c_custkey FROM customer) AS q ON q.c_custkey = o.o_custkey WHERE o.o_orderkey = {n}", False),
    ("SELECT c_name FROM customer WHERE c_mktsegment = 'c_acctbal' AND c_custkey = {n}", False),
]

#: Wrong texts, and what each is to become.
BROKEN = [
    ("SELEC c_name FROM customer WHERE c_custkey = {n}", "SELECT c_name FROM customer WHERE c_custkey = {n}"),
    ("SELECT s_name FORM supplier WHERE s_suppkey = {n}", "SELECT s_name FROM supplier WHERE s_suppkey = {n}"),
    ("SELECT p_name, FROM part WHERE p_size = {n}", "SELECT p_name FROM part WHERE p_size = {n}"),
    ("SELECT count(* FROM orders WHERE o_custkey = {n}", "SELECT count(*) FROM orders WHERE o_custkey = {n}"),
    ("SELECT c_mktsegment FROM customer WHERE c_custkey < {n} GROUP c_mktsegment", "SELECT c_mktsegment FROM customer WHERE c_custkey < {n} GROUP BY c_mktsegment"),
    ("SELECT c_name FROM custmer WHERE c_custkey = {n}", "SELECT c_name FROM customer WHERE c_custkey = {n}"),
    ("SELECT n_nmae FROM nation WHERE n_nationkey = {n}", "SELECT n_name FROM nation WHERE n_nationkey = {n}"),
    ("SELECT c_custkey FROM customer WHERE c_name = {n}", "SELECT c_custkey FROM customer WHERE c_name = '{n}'"),
    ("SELECT p_name FROM part WHERE p_partkey = {n} AND p_size > 'twelve'", "SELECT p_name FROM part WHERE p_partkey = {n} AND p_size > 12"),
    ("SELECT r_name FROM region WHERE r_name = NULL OR r_regionkey = {n}", "SELECT r_name FROM region WHERE r_name IS NULL OR r_regionkey = {n}"),
    ("SELECT cnt(*) FROM lineitem WHERE l_orderkey = {n}", "SELECT count(*) FROM lineitem WHERE l_orderkey = {n}"),
    ("SELECT s_name FROM supplier HAVING s_suppkey > {n}", "SELECT s_name FROM supplier WHERE s_suppkey > {n}"),
    ("SELECT p_brand, count(*) FROM part WHERE p_size < {n}", "SELECT p_brand, count(*) FROM part WHERE p_size < {n} GROUP BY p_brand"),
    ("SELECT c.c_name FROM customer AS c JOIN orders AS o WHERE o.o_orderkey = {n}", "SELECT c.c_name FROM customer AS c JOIN orders AS o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey = {n}"),
    ("SELECT p_name FROM part WHERE p_partkey = {n} AND p_size > avg(p_size)", "SELECT p_name FROM part WHERE p_partkey = {n} AND p_size > (SELECT avg(p_size) FROM part)"),
    ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND AND o_custkey = {n}", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey = {n}"),
    ("SELEC c_nmae FORM custmer WHERE c_custkey = {n}", "SELECT c_name FROM customer WHERE c_custkey = {n}"),
    ("SELECT c_name FROM customer WHERE c_custkey = {n}", "SELECT c_name FROM customer WHERE c_custkey = {n}"),
    ("SELECT r_name FROM region WHERE r_regionkey <> NULL", "SELECT r_name FROM region WHERE NOT r_regionkey IS NULL"),
    ("SELECTSELECT r_name FROM region HAVING r_regionkey > 1", "SELECT r_name FROM region WHERE r_regionkey > 1"),
    ("SELECT r_name FROM region HAVING r_regionky > 1", "SELECT r_name FROM region WHERE r_regionkey > 1"),
    ("SELECT p_brand, p_type, count(*) FROM part GROUP BY p_brand", "SELECT p_brand, p_type, count(*) FROM part GROUP BY p_brand, p_type"),
    ("SELECT r_name FROM region WHERE r_regionkey = 1 ORDER BY 3", "SELECT r_name FROM region WHERE r_regionkey = 1 ORDER BY r_name"),
    ("SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey, r_name FROM region)", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)"),
    ("SELECT n_name FROM nation UNION SELECT r_name, r_regionkey FROM region", "SELECT n_name FROM nation UNION SELECT r_regionkey FROM region"),
    ("SELECT n_name FROM nation WHERE n_name = 'PERU", "SELECT n_name FROM nation WHERE n_name = 'PERU'"),
    ("SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment WHERE c_acctbal > 3", "SELECT c_mktsegment, count(*) FROM customer WHERE c_acctbal > 3 GROUP BY c_mktsegment"),
    ("SELECT countDISTINCT o_custkey) FROM orders", "SELECT count(DISTINCT o_custkey) FROM orders"),
    ("SELECT T1.c_name FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.customer_ref", "SELECT T1.c_name FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey"),
    ("SELECT T2.c_name FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey", "SELECT T1.c_name FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey"),
    ("SELECT x.r_name FROM region AS r", "SELECT r.r_name FROM region AS r"),
    ("SELECT T1.n_name FROM nation AS T1 JOIN region AS T1 ON T1.n_regionkey = T1.r_regionkey", "SELECT T1.n_name FROM nation AS T1 JOIN region AS T2 ON T1.n_regionkey = T2.r_regionkey"),
    ("SELECT p_name FROM inventory WHERE p_retailprice > 5 AND p_size = 3", "SELECT p_name FROM part WHERE p_retailprice > 5 AND p_size = 3"),
    ("SELECT average(p_size) FROM part", "SELECT avg(p_size) FROM part"),
    ("SELECT avg(p_name) FROM part", "SELECT avg(CAST(p_name AS REAL)) FROM part"),
    ("SELECT p_name FROM part WHERE p_size > 'about 12 cm'", "SELECT p_name FROM part WHERE p_size > 12"),
    ("SELECT o_custkey FROM orders WHERE count(*) > 3 GROUP BY o_custkey", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 3"),
    ("SELECT r_name FROM region WHERE r_regionkey = r_regionkey", "SELECT r_name FROM region"),
    ("SELECT count(o_custkey, o_orderkey) FROM orders", "SELECT count(o_custkey) FROM orders"),
    ("SELECT c_name FROM customer LIMIT 3 WHERE c_acctbal > 2 GROUP BY c_name", "SELECT c_name FROM customer WHERE c_acctbal > 2 GROUP BY c_name LIMIT 3"),
    ("SELECT c_name FROM customer ORDER BY c_name HAVING count(*) > 1 GROUP BY c_name", "SELECT c_name FROM customer GROUP BY c_name HAVING count(*) > 1 ORDER BY c_name"),
    ("SELECT n_name FROM nation UNION SELECT n_regionkey, n_name FROM nation", "SELECT n_name FROM nation UNION SELECT n_name FROM nation"),
    ("SELECT T1.p_name FROM part AS T1 JOIN supplier AS T1 ON T1.p_partkey = T1.s_suppkey", "SELECT T1.p_name FROM part AS T1 JOIN supplier AS T2 ON T1.p_partkey = T2.s_suppkey"),
    ("SELECT WHERE r_name FROM region", "SELECT r_name FROM region"),
    ("SELECT p_brand, p_type, count(*) FROM part WHERE p_size = {n}", "SELECT p_brand, p_type, count(*) FROM part WHERE p_size = {n} GROUP BY p_brand, p_type"),
    ("SELECT n_name, n_regionkey FROM nation UNION SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT n_name, n_regionkey FROM nation UNION SELECT n_name, n_regionkey FROM nation"),
]
#: Correct texts of one form each, to be mutated.
SEEDS = [
    "SELECT c_name, c_acctbal FROM customer WHERE c_mktsegment = '{s}' ORDER BY c_acctbal DESC",
    "SELECT T1.c_name, count(*) FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey WHERE T2.o_orderkey < {n} GROUP BY T1.c_custkey HAVING count(*) > 1",
    "SELECT p_name FROM part WHERE p_size = {n} AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 5)",
    "SELECT s_name FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier WHERE s_suppkey < {n})",
    "SELECT o_orderstatus, count(*) FROM orders WHERE o_custkey < {n} GROUP BY o_orderstatus",
    "SELECT c_name FROM customer WHERE c_custkey = {n} UNION SELECT s_name FROM supplier",
    "SELECT T1.n_name, T2.n_name FROM nation AS T1 JOIN nation AS T2 ON T1.n_regionkey = T2.n_regionkey WHERE T1.n_nationkey = {n}",
    "SELECT max(o_totalprice), min(o_totalprice) FROM orders WHERE o_orderpriority = '{s}'",
    "SELECT n_name FROM nation WHERE n_regionkey = {n} ORDER BY n_name LIMIT 5",
]
