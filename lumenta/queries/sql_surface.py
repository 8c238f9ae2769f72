"""Ad-hoc SQL after admission: one statement for each kind of clause, the same words for both engines."""

from __future__ import annotations

from lumenta.plans.admission import admit
from lumenta.sources import tables

STATEMENTS = {
    "sql_join": "select n_name, count(c_custkey) as n from nation left join customer on n_nationkey = c_nationkey and c_acctbal > 5000 group by n_name",
    "sql_full_join": "select coalesce(c_custkey, s_suppkey) as k, c_name, s_name from customer full join supplier on c_custkey = s_suppkey and c_nationkey = s_nationkey where coalesce(c_custkey, s_suppkey) < 500",
    "sql_cross_join": "select r_name, o.p as priority from region cross join (select distinct o_orderpriority as p from orders) o",
    "sql_join_inner": "select s_name, n_name from supplier join nation on s_nationkey = n_nationkey",
    "sql_join_right": "select n_name, s_suppkey from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 0",
    "sql_join_using": "select o_orderkey, n from orders join (select l_orderkey as o_orderkey, count(*) as n from lineitem group by l_orderkey) x using (o_orderkey)",
    "sql_join_theta": "select a.n_name, count(*) as n from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey group by a.n_name",
    "sql_dates": "select extract(year from o_orderdate) as y, month(o_orderdate) as m, count(*) as n, max(cast(o_orderdate as date)) as latest, datediff(min(cast(o_orderdate as date)), date '1995-01-01') as since from orders group by 1, 2",
    "sql_arrays": "select doc_id, size(split(source, '')) as letters, array_contains(array('en', 'de'), lang) as known from documents",
    "sql_json": "select event_id, cast(get_json_object(props, '$.k') as int) as k from events",
    "sql_exists": "select c_custkey, c_name from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 250000)",
    "sql_not_in": "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)",
    "sql_having": "select o_orderpriority, count(*) as n, max(o_totalprice) as most from orders group by o_orderpriority having count(*) > 10",
    "sql_rollup": "select o_orderpriority, o_orderstatus, count(*) as n from orders group by rollup(o_orderpriority, o_orderstatus)",
    "sql_cube": "select o_orderpriority, o_orderstatus, count(*) as n from orders group by cube(o_orderpriority, o_orderstatus)",
    "sql_grouping_sets": "select l_returnflag, l_linestatus, sum(l_quantity) as q from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())",
    "sql_window": "select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place, lag(o_totalprice) over (partition by o_custkey order by o_totalprice desc, o_orderkey) as above from orders",
    "sql_union": "select c_nationkey as k from customer union select s_nationkey as k from supplier",
    "sql_union_all": "select c_nationkey as k from customer union all select s_nationkey as k from supplier",
    "sql_except": "select c_nationkey as k from customer except select s_nationkey as k from supplier where s_acctbal > 5000",
    "sql_intersect": "select c_nationkey as k from customer intersect select s_nationkey as k from supplier",
    "sql_cte": "with big as (select o_custkey, sum(o_totalprice) as spent from orders group by o_custkey) select o_custkey, round(spent, 2) as spent from big where spent > 0.5 * (select max(spent) from big)",
    "sql_distinct": "select distinct l_returnflag, l_linestatus from lineitem",
    "sql_limit": "select s_suppkey, s_acctbal from supplier order by s_acctbal desc, s_suppkey limit 5 offset 2",
    "sql_scalar": "select p_partkey, upper(substring(p_name, 1, 5)) as head, length(p_name) as n, case when p_size > 25 then 'large' else 'small' end as size_class, abs(p_retailprice - 1000) as off from part",
    "sql_no_from": "select 1 + 1 as two, 'a' as letter",
}


def _asked(sql: str):
    def run(spark, folder):
        views = {t: tables.table(spark, folder, t) for t in tables.TABLES}
        own = admit(spark, sql, views, max_rows=1 << 30)
        if not own.ok:
            raise ValueError("; ".join(f.message for f in own.findings))
        return own.frame

    return run


QUERIES = {k: _asked(sql) for k, sql in STATEMENTS.items()}
#: The same statements where the other engine has other names.
ORACLE = STATEMENTS | {
    "sql_dates": "select extract(year from o_orderdate) as y, month(o_orderdate) as m, count(*) as n, max(cast(o_orderdate as date)) as latest, date_diff('day', date '1995-01-01', min(cast(o_orderdate as date))) as since from orders group by 1, 2",
    "sql_arrays": "select doc_id, length(source) as letters, list_contains(['en', 'de'], lang) as known from documents",
    "sql_json": "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events",
}
