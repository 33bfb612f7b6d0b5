"""Sort, limit, top-k and distinct."""

from __future__ import annotations

from quern.registry import sql_operator

sql_operator("sort_single", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_custkey")
sql_operator("sort_multi", "SELECT o_orderkey FROM {orders} ORDER BY o_orderstatus DESC, o_orderpriority, o_orderkey")
sql_operator("sort_expr", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey % 97, o_orderkey DESC")
sql_operator("sort_nulls", "SELECT o_orderkey, s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM {orders}) t ORDER BY s NULLS LAST, o_orderkey")
sql_operator("limit", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 17")
sql_operator("offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 17 OFFSET 30")
sql_operator("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql_operator("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
sql_operator("sorter", "SELECT l_orderkey, l_partkey FROM {lineitem} ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber")
