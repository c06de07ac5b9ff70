"""Relational idioms of the evaluation work as plain SQL over the input tables: projections, joins, aggregates, ranks, sets.

A text without ``{...}`` is common to both dialects; a pair has Spark's and the standard one's where they differ.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: (day, status, qty) of shipping, as a start of several queries
DAY = "(select l_linestatus s, cast(l_shipdate as date) d, cast(sum(cast(l_quantity as decimal(18,2))) as double) q from lineitem group by l_linestatus, cast(l_shipdate as date))"
DEVIATION = f"(select s, d, q, avg(q) over (partition by s, month(d)) m from {DAY})"

TEXTS: dict[str, str | tuple[str, str]] = {
    # 2.2 projections, filters, reshape
    "p1_project": "select c_custkey as customer, upper(c_mktsegment) as segment, c_acctbal * 2 as raised from customer",
    "p2_filter": "select o_orderkey, o_totalprice from orders where o_orderstatus in ('F', 'O') and o_totalprice between 1000 and 50000 and o_orderpriority = '1-URGENT'",
    "p3_patterns": "select p_partkey, p_name, substring(p_type, 1, 5) as head from part where p_brand like 'Brand#1%' or p_name like '%9'",
    "p4_mask": "select l_orderkey, l_linenumber, case when not (l_returnflag = 'R') then l_extendedprice end as price from lineitem",
    "p5_keep_where": f"select d, case when count(q) >= 2 then round(avg(q), 6) end as mean_q, count(q) as n from {DAY} x group by d",
    "p6_sentinel": "select c_custkey, nullif(c_nationkey, 7) as nation, case when c_acctbal > 0 then c_acctbal end as balance from customer",
    "p7_pivot": (
        "select * from (select year(l_shipdate) y, l_returnflag f, l_quantity q from lineitem) pivot (cast(sum(cast(q as decimal(18,2))) as double) for f in ('A' as a, 'N' as n, 'R' as r))",
        "select year(l_shipdate) y, " + ", ".join(f"cast(sum(cast(l_quantity as decimal(18,2))) filter (where l_returnflag = '{f}') as double) {f.lower()}" for f in "ANR") + " from lineitem group by 1",
    ),
    "p8_unpivot": (
        "select l_orderkey, l_linenumber, var, y from (select l_orderkey, l_linenumber, l_discount, l_tax from lineitem) unpivot (y for var in (l_discount, l_tax))",
        "select l_orderkey, l_linenumber, 'l_discount' var, l_discount y from lineitem union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem",
    ),
    "p10_reindex": (
        f"select k.s, k.d, x.q from (select s, explode(sequence(a, b)) d from (select s, min(d) a, max(d) b from {DAY} group by s)) k left join {DAY} x on x.s = k.s and x.d = k.d",
        f"select k.s, k.d, x.q from (select s, cast(unnest(generate_series(a, b, interval 1 day)) as date) d from (select s, min(d) a, max(d) b from {DAY} group by s)) k left join {DAY} x on x.s = k.s and x.d = k.d",
    ),
    "p11_expand": (
        "select o_orderkey, lead from orders lateral view explode(sequence(1, 7)) t as lead",
        "select o_orderkey, cast(unnest(generate_series(1, 7)) as int) lead from orders",
    ),
    "p12_bind": (
        "select s_suppkey, pair.n as n, pair.v as v from (select s_suppkey, explode(arrays_zip(array('a', 'b') as n, array(s_acctbal, s_acctbal * 2) as v)) pair from supplier)".replace(" as n, array(", ", array(").replace(" as v)) pair", ")) pair").replace("pair.n as n, pair.v as v", "pair.`0` as n, pair.`1` as v"),
        "select s_suppkey, 'a' n, s_acctbal v from supplier union all select s_suppkey, 'b', s_acctbal * 2 from supplier",
    ),
    "p13_clip": "select c_custkey, greatest(c_acctbal, 0.0) as balance from customer",
    "p14_target_date": (
        "select o_orderkey, date_add(cast(o_orderdate as date), 30) as target from orders",
        "select o_orderkey, cast(cast(o_orderdate as date) + interval 30 day as date) as target from orders",
    ),
    "p15_membership": "select n_nationkey, case when n_regionkey in (select r_regionkey from region where r_name like 'A%') then 'a' else 'other' end as grp from nation",
    "p16_suffix": (
        "select m, regexp_extract(m, '^(.+)_ctx([0-9]+)$', 1) as base, cast(nullif(regexp_extract(m, '^(.+)_ctx([0-9]+)$', 2), '') as int) as context from (select concat(lower(p_brand), '_ctx', p_size) m from part)",
        "select m, regexp_extract(m, '^(.+)_ctx([0-9]+)$', 1) as base, cast(nullif(regexp_extract(m, '^(.+)_ctx([0-9]+)$', 2), '') as int) as context from (select lower(p_brand) || '_ctx' || p_size m from part)",
    ),
    # 2.3 joins
    "j1_inner": "select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey where o_totalprice > 100000",
    "j2_left_default": "select c_custkey, coalesce(has, false) as has_urgent from customer left join (select distinct o_custkey, true as has from orders where o_orderpriority = '1-URGENT') o on o_custkey = c_custkey",
    "j3_composite": "select a.l_orderkey, a.l_linenumber, b.l_quantity as other from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber + 1",
    "j4_full_shifted": (
        f"select coalesce(a.d, b.d) as d, a.q as f, b.q as o from (select d, q from {DAY} where s = 'F') a full join (select date_add(d, 1) d, q from {DAY} where s = 'O') b on a.d = b.d",
        f"select coalesce(a.d, b.d) as d, a.q as f, b.q as o from (select d, q from {DAY} where s = 'F') a full join (select cast(d + interval 1 day as date) d, q from {DAY} where s = 'O') b on a.d = b.d",
    ),
    "j5_semi_all_groups": "select distinct l_partkey from lineitem where l_partkey in (select l_partkey from lineitem group by l_partkey having count(distinct l_returnflag) = (select count(distinct l_returnflag) from lineitem))",
    "j6_reference_row": "select a.p_brand, a.p_size, a.n, round(a.n / b.n, 6) as ratio from (select p_brand, p_size, cast(count(*) as double) n from part group by p_brand, p_size) a left join (select p_size, cast(count(*) as double) n from part where p_brand = 'Brand#11' group by p_size) b on a.p_size = b.p_size",
    "j7_index_intersection": f"select a.d, a.q as f, b.q as o from {DAY} a join {DAY} b on a.d = b.d and a.s = 'F' and b.s = 'O'",
    "j8_complete_rows": f"select d, f, o from (select d, max(case when s = 'F' then q end) f, max(case when s = 'O' then q end) o from {DAY} x group by d) where f is not null and o is not null",
    "j12_nearest": (
        # the values of the 25 nations cut the line into 26 parts; the ends of the nearest filled parts to either side hold the nearest supplier
        """with e as (
          select g, max(struct(v, -k as k)) as hi, min(struct(v, k)) as lo from (
            select case when s_acctbal < 0 then -1 when s_acctbal >= 2400 then 24 else cast(floor(s_acctbal / 100) as int) end g, s_acctbal v, s_suppkey k from supplier) group by g
        ), c as (
          select n_nationkey, abs(hi.v - 100 * n_nationkey) dist, -hi.k k from (select n_nationkey, max_by(hi, g) hi from nation join e on g < n_nationkey group by n_nationkey)
          union all select n_nationkey, abs(lo.v - 100 * n_nationkey), lo.k from (select n_nationkey, min_by(lo, g) lo from nation join e on g >= n_nationkey group by n_nationkey)
        ) select n_nationkey, min_by(k, struct(dist, k)) as near, round(min(dist), 4) as dist from c group by n_nationkey""",
        "select n_nationkey, arg_min(s_suppkey, (abs(s_acctbal - 100 * n_nationkey), s_suppkey)) as near, round(min(abs(s_acctbal - 100 * n_nationkey)), 4) as dist from nation cross join supplier group by n_nationkey",
    ),
    "j15_fallback": "select o_orderkey, coalesce(cast(a.s_suppkey as bigint), cast(b.c_custkey as bigint), -1) as ref, case when a.s_suppkey is not null then 'supplier' when b.c_custkey is not null then 'customer' else 'missing' end as src from orders left join (select s_suppkey from supplier where s_acctbal > 0) a on a.s_suppkey = o_custkey left join (select c_custkey from customer where c_acctbal > 0) b on b.c_custkey = o_custkey",
    "j_anti": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    # 2.4 aggregates
    "a1_groupby": "select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty, min(l_shipdate) as lo, max(l_shipdate) as hi, count(*) as n, round(avg(l_discount), 6) as disc from lineitem group by l_returnflag, l_linestatus",
    "a2_rmse": f"select s, round(sqrt(avg((q - m) * (q - m))), 5) as rmse from {DEVIATION} x group by s",
    "a3_distinct": "select o_orderpriority, count(distinct o_custkey) as customers from orders group by o_orderpriority",
    "a4_share": "select l_returnflag, round(avg(cast(l_discount > 0.05 as int)), 6) as share from lineitem group by l_returnflag",
    "a5_quantiles": (
        "select l_returnflag, round(q[0], 6) as q1, round(q[4], 6) as q5, round(q[8], 6) as q9 from (select l_returnflag, percentile(l_extendedprice, array(0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9)) q from lineitem group by l_returnflag)",
        "select l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) as q1, round(quantile_cont(l_extendedprice, 0.5), 6) as q5, round(quantile_cont(l_extendedprice, 0.9), 6) as q9 from lineitem group by l_returnflag",
    ),
    "a6_median": "select o_orderpriority, round(median(o_totalprice), 4) as mid from orders group by o_orderpriority",
    "a7_weighted_mean": "select p_brand, round(sum(p_size * v) / sum(case when v is not null then p_size end), 6) as wmean, count(*) as n, max(cast(p_size > 45 as int)) = 1 as any_large from (select p_brand, p_size, case when p_partkey % 5 <> 0 then p_retailprice end v from part) group by p_brand",
    "a8_min_count": "select l_suppkey, case when count(l_quantity) >= 25 then cast(sum(cast(l_quantity as decimal(18,2))) as double) end as qty from lineitem where l_returnflag = 'R' group by l_suppkey",
    "a9_stddev": "select l_returnflag, round(stddev_samp(l_quantity), 6) as sd from lineitem group by l_returnflag",
    "a10_corr": (
        "select s, round(case when stddev_pop(q) > 0 and stddev_pop(m) > 0 then corr(q, m) end, 6) as r from " + DEVIATION + " x group by s",
        "select s, round(corr(q, m), 6) as r from " + DEVIATION + " x group by s",
    ),
    "a11_argmin": (
        "select s_nationkey, min_by(s_suppkey, struct(s_acctbal, s_suppkey)) as least from supplier group by s_nationkey",
        "select s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) as least from supplier group by s_nationkey",
    ),
    "a12_argmax_ordered": (
        "select s, max_by(k, struct(v, -rank)) as best from (select s, k, rank, round(avg(q * p), 4) v from (select s, q, k, case when k = -1 then 0 when k = 0 then 1 else 2 end rank, lag(q, 1) over (partition by s, k order by d) * (k + 2) p from (select s, d, q, k from " + DAY + " lateral view explode(array(-1, 0, 1)) e as k)) group by s, k, rank) group by s",
        "select s, arg_max(k, (v, -rnk)) as best from (select s, k, rnk, round(avg(q * p), 4) v from (select s, q, k, case when k = -1 then 0 when k = 0 then 1 else 2 end rnk, lag(q, 1) over (partition by s, k order by d) * (k + 2) p from (select s, d, q, k from " + DAY + " cross join (values (-1), (0), (1)) e(k))) group by s, k, rnk) group by s",
    ),
    "a13_histogram": (
        "select b, count(*) as n from (select cast(least(floor(log10(greatest(o_totalprice, 1.0)) * 2), 10) as int) b from orders) group by b",
        "select b, count(*) as n from (select cast(least(floor(log10(greatest(o_totalprice, 1.0)) * 2), 10) as int) b from orders) group by b",
    ),
    "a14_crosstab": "select l_returnflag, count(case when l_linestatus = 'F' then 1 end) as f, count(case when l_linestatus = 'O' then 1 end) as o from lineitem group by l_returnflag",
    "a15_shares": "select o_orderstatus, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share from orders group by o_orderstatus",
    "a16_two_level": "select m, round(median(mean), 4) as mid from (select s, m, avg(total) mean from (select s, year(d) y, month(d) m, sum(q) total from " + DAY + " x group by s, year(d), month(d)) group by s, m) group by m",
    "a17_transform": f"select s, d, round(q - m, 4) as anomaly from {DEVIATION} x",
    "a18_summary": "select l_returnflag, count(l_tax) as n, round(avg(l_tax), 6) as mean, round(stddev_samp(l_tax), 6) as sd, min(l_tax) as lo, max(l_tax) as hi from lineitem group by l_returnflag",
    "a19_missing_counts": f"select s, d, count(q) over (partition by s order by d rows between 29 preceding and current row) as seen from {DAY} x",
    # 2.5 windows
    "w1_lag": f"select s, d, lag(q, 3) over (partition by s order by d) as before, lead(q, 2) over (partition by s order by d) as after from {DAY} x",
    "w2_row_number": f"select s, d, row_number() over (partition by s order by d) as n from {DAY} x",
    "w3_average_rank": "select p_partkey, p_brand, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / cast(2 as double) as avg_rank from part",
    "w4_event_ids": f"select s, d, sum(change) over (partition by s order by d rows between unbounded preceding and current row) as event from (select s, d, case when coalesce((q > m) <> lag(q > m) over (partition by s order by d), true) then 1 else 0 end change from {DEVIATION} x)",
    "w13_differences": f"select s, d, round(d1, 4) as d1, round(d1 - lag(d1) over (partition by s order by d), 4) as d2 from (select s, d, q - lag(q) over (partition by s order by d) d1 from {DAY} x)",
    "w14_first_valid": f"select s, min(case when q > 20 then d end) as first_valid from {DAY} x group by s",
    "w15_last_observed": (
        f"select s, d, last(case when q > 100 then q end, true) over (partition by s order by d rows between unbounded preceding and current row) as held from {DAY} x",
        f"select s, d, last_value(case when q > 100 then q end ignore nulls) over (partition by s order by d rows between unbounded preceding and current row) as held from {DAY} x",
    ),
    "w16_running_sum": f"select s, d, sum(case when q > 50 then q end) over (partition by s order by d rows between unbounded preceding and current row) as total from {DAY} x",
    "w17_top_n": "select n_nationkey, c_custkey, r from (select c_nationkey n_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) r from customer) where r <= 5",
    "w18_pad": (
        "select c_custkey, concat_ws('|', concat(array_repeat(own[0], cast(ceil(size(own) / 8) * 8 - size(own) as int)), own)) as padded from (select c_custkey, array_sort(collect_list(cast(o_orderkey as string))) own from customer join orders on o_custkey = c_custkey group by c_custkey)",
        "select c_custkey, array_to_string(list_concat(list_transform(range((ceil(len(own) / 8.0) * 8 - len(own))::bigint), lambda x: own[1]), own), '|') as padded from (select c_custkey, list_sort(list(cast(o_orderkey as varchar))) own from customer join orders on o_custkey = c_custkey group by c_custkey)",
    ),
    # 2.6 sorts and limits
    "l1_sort": (
        # places inside parts of like price, after the parts before; the parts are counted first
        """with o as (select o_orderkey, o_totalprice, o_orderpriority p, floor(o_totalprice / 1000) b from orders),
        c as (select p, b, sum(n) over (order by p, b desc rows between unbounded preceding and 1 preceding) before from (select p, b, count(*) n from o group by p, b))
        select coalesce(c.before, 0) + row_number() over (partition by o.p, o.b order by o_totalprice desc, o_orderkey) as n, o_orderkey from o join c on o.p = c.p and o.b = c.b""",
        "select row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) as n, o_orderkey from orders",
    ),
    "l2_worst_ten": "select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 10",
    "l3_custom_order": "select o_orderpriority, case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end as place, count(*) as n from orders group by o_orderpriority",
    "l4_sort_within": (
        "select s_suppkey, a[0] as q1, a[1] as q2, a[2] as q3 from (select s_suppkey, array_sort(array(s_acctbal, cast(s_suppkey as double), 500.0D)) a from supplier)",
        "select s_suppkey, a[1] as q1, a[2] as q2, a[3] as q3 from (select s_suppkey, list_sort([s_acctbal, cast(s_suppkey as double), 500.0]) a from supplier)",
    ),
    "l5_batches": (
        "select cast(floor((row_number() over (partition by c_nationkey order by c_custkey) - 1) / 16) as int) as batch, c_nationkey, c_custkey from customer",
        "select cast(floor((row_number() over (partition by c_nationkey order by c_custkey) - 1) / 16) as int) as batch, c_nationkey, c_custkey from customer",
    ),
    # 2.7 sets
    "u1_union_all": "select s_nationkey as k, 's' as src from supplier union all select c_nationkey, 'c' from customer",
    "u2_intersect": "select o_custkey as k from orders intersect select s_suppkey from supplier",
    "u3_difference": "select c_custkey as k from customer except select o_custkey from orders",
    "u4_distinct": "select distinct l_returnflag, l_linestatus, year(l_shipdate) as y from lineitem",
    "u5_subset": "select count(*) = 0 as is_subset from (select o_custkey from orders except select c_custkey from customer)",
    # 2.8 scalars without functions of their own
    "f_case_cast": (
        "select p_partkey, try_cast(substring(p_brand, 7, 2) as int) as brand_no, try_cast(p_type as int) as bad, greatest(p_size, nullif(p_size, 7), 20) as most from part",
        "select p_partkey, try_cast(substring(p_brand, 7, 2) as int) as brand_no, try_cast(p_type as int) as bad, greatest(p_size, nullif(p_size, 7), 20) as most from part",
    ),
    "f_hash_json": (
        "select event_id, sha2(props, 256) as digest, cast(get_json_object(props, '$.k') as bigint) as k from events",
        "select event_id, sha256(props) as digest, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    ),
    "f_round_even": (
        "select l_orderkey, l_linenumber, bround(l_quantity / 2, 0) as half_even from lineitem",
        "select l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) as half_even from lineitem",
    ),
    "f_format": (
        "select l_returnflag, format_string('%.3f', avg(l_discount)) as text from lineitem group by l_returnflag",
        "select l_returnflag, printf('%.3f', avg(l_discount)) as text from lineitem group by l_returnflag",
    ),
    "f_dates": (
        "select o_orderkey, add_months(cast(o_orderdate as date), 2) as later, cast(date_trunc('month', o_orderdate) as date) as month_start, date_format(o_orderdate, 'MMM') as mon, dayofyear(o_orderdate) as doy from orders",
        "select o_orderkey, cast(cast(o_orderdate as date) + interval 2 month as date) as later, cast(date_trunc('month', o_orderdate) as date) as month_start, strftime(o_orderdate, '%b') as mon, dayofyear(o_orderdate) as doy from orders",
    ),
}


def run(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in TABLES:
        if f" {name}" in text:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


QUERIES = {name: partial(run, t if isinstance(t, str) else t[0]) for name, t in TEXTS.items()}
ORACLE_SQL = {name: t if isinstance(t, str) else t[1] for name, t in TEXTS.items()}
