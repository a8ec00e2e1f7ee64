"""DuckDB SQL for the queries of ``registry``."""

from __future__ import annotations

import numpy as np

from ketspark.operators.reduction import gaussian_matrix

ORACLE_SQL: dict[str, str] = {}
DIMS = 4
VECTORS = "v as (select vec_id, label, " + ", ".join(f"cast(embedding[{i + 1}] as double) as x{i}" for i in range(DIMS)) + " from embeddings)"
XS = [f"x{i}" for i in range(DIMS)]


def sql(name: str, text: str) -> None:
    ORACLE_SQL[name] = text.strip()


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0"


def each(f: str, cols: list[str]) -> str:
    """``f`` with {c} for every column, rounded, under the column's name."""
    return ", ".join(f"{r(f.format(c=c))} as {c}" for c in cols)


# A
sql("sql_loader_batches", """
with b as (select o_orderkey, cast(floor((row_number() over (order by o_orderkey) - 1) / 100) as bigint) as batch_id from orders where o_orderstatus = 'O')
select batch_id, count(*) as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key from b group by batch_id""")
sql("parquet_loader_batches", "select o_orderkey, cast(floor((row_number() over (order by o_orderkey) - 1) / 1000) as bigint) as batch_id from orders")
sql("batch_count", "select greatest(1, cast(ceil(count(*) / 1000) as bigint)) as n_batches from orders")
sql("sql_limit", "select c_custkey, c_name from customer where c_acctbal > 0 order by c_custkey limit 20")
sql("parquet_metadata", "select count(*) as num_rows, cast(6 as bigint) as num_columns, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' as column_names, cast(1000 as bigint) as batch_size, cast(1 as bigint) as num_row_groups, 'angle' as encoder_type from part")
sql("parquet_row_group_batches", """
with b as (select p_partkey, cast(floor((row_number() over () - 1) / 300) as bigint) as batch_id from part)
select batch_id, count(*) as n, min(p_partkey) as first_key, max(p_partkey) as last_key from b group by batch_id""")
sql("read_sample", "select * from part order by p_partkey limit 5")
sql("format_unpivot", 'select p_partkey, \'p_size\' as "column", cast(p_size as double) as value from part union all select p_partkey, \'p_retailprice\', p_retailprice from part')
sql("format_lists", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey")

# B
sql("buffer_sliding_window", "select event_id, value from events order by ts desc, event_id desc limit 100")
sql("buffer_statistics", f"""
with t as (select value from events order by ts desc, event_id desc limit 1000)
select count(*) as size, cast(1000 as bigint) as capacity, count(*) / 1000 as utilization, {r('avg(value)')} as mean_value, {r('stddev_pop(value)')} as std_value, min(value) as min, max(value) as max from t""")
sql("stream_batches_shuffled", "select o_orderkey, cast(floor((row_number() over (order by md5('42-' || o_orderkey), o_orderkey) - 1) / 32) as bigint) as batch_id from orders")
sql("validate_frame", " union all ".join(
    f"select '{c}' as \"column\", count(*) filter ({c} is null or isnan({c})) as n_missing, count(*) filter (isinf({c})) as n_infinite, count(*) filter ({c} is null or isnan({c}) or isinf({c})) = 0 as ok from lineitem"
    for c in ("l_quantity", "l_discount", "l_tax")))
for _m, _f in (("mean", "avg"), ("max", "max"), ("min", "min"), ("sum", "sum")):
    sql(f"batch_aggregate_{_m}", f"select {r(f'{_f}(value)')} as value from events")
sql("batch_process", """
with b as (select o_totalprice, cast(floor((row_number() over (order by o_orderkey) - 1) / 500) as bigint) as batch_id from orders)
select batch_id, count(*) as n, max(o_totalprice) as largest from b group by batch_id""")
sql("batch_statistics", f"""
with c as (select l_discount as x from lineitem union all select l_tax from lineitem)
select (select count(distinct l_returnflag) from lineitem) as n_batches, (select count(*) from lineitem) as n_samples, {r('avg(x)')} as mean, {r('stddev_pop(x)')} as std from c""")

# C
sql("transform_normalize", f"select c_custkey, {r('(c_acctbal - (select min(c_acctbal) from customer)) / (select max(c_acctbal) - min(c_acctbal) from customer)')} as c_acctbal from customer")
sql("transform_standardize", f"select c_custkey, {r('(c_acctbal - (select avg(c_acctbal) from customer)) / (select stddev_pop(c_acctbal) from customer)')} as c_acctbal from customer")
sql("table_checksum", """
with h as (select sha256(concat_ws('|', cast(cast(round(cast(o_orderkey as double) * 100) as bigint) as varchar), cast(cast(round(o_totalprice * 100) as bigint) as varchar))) as s from orders),
p as (select count(*) as n, """ + ", ".join(f"cast(sum(cast('0x' || substr(s, {1 + 8 * k}, 8) as bigint)) as varchar) as p{k}" for k in range(4)) + """ from h)
select n as n_rows, sha256(concat_ws('-', p0, p1, p2, p3)) as checksum from p""")
sql("quality_report", f"""
with c as (select l_quantity as v from lineitem union all select l_extendedprice from lineitem union all select l_discount from lineitem),
q as (select quantile_cont(v, 0.25) as a, quantile_cont(v, 0.75) as b from c),
s as (select 1 - count(*) filter (v is null or isnan(v)) / count(*) as completeness, count(*) filter (v is null or isnan(v) or isinf(v)) = 0 as valid, count(*) filter (v < a - 1.5 * (b - a) or v > b + 1.5 * (b - a)) / count(*) as outlier_ratio from c, q)
select {r('completeness')} as completeness, valid, {r('outlier_ratio')} as outlier_ratio, completeness >= 0.95 and valid and outlier_ratio <= 0.05 as overall from s""")
sql("profile_columns", " union all ".join(f"""
select '{c}' as "column", count({c}) as n, {r(f'avg({c})', 4)} as mean, {r(f'stddev_pop({c})', 4)} as std, min({c}) as min, {r(f'quantile_cont({c}, 0.25)', 4)} as q25, {r(f'quantile_cont({c}, 0.5)', 4)} as median, {r(f'quantile_cont({c}, 0.75)', 4)} as q75, max({c}) as max,
{r(f'avg(power(({c} - m) / s, 3))', 4)} as skewness, {r(f'avg(power(({c} - m) / s, 4)) - 3', 4)} as kurtosis from lineitem, (select avg({c}) as m, stddev_pop({c}) as s from lineitem)""" for c in ("l_quantity", "l_extendedprice", "l_tax")))

# D
_parts = "case when rn < floor(n * 0.7) then 'train' when rn < floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as part"
sql("split_random", f"with t as (select o_orderkey, row_number() over (order by md5('42-' || o_orderkey), o_orderkey) - 1 as rn, count(*) over () as n from orders) select o_orderkey, {_parts} from t")
_ranked = "t as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by md5('42-' || o_orderkey), o_orderkey) - 1 as rn, count(*) over (partition by o_orderpriority) as n from orders)"
sql("split_stratified", f"with {_ranked} select o_orderkey, o_orderpriority, {_parts} from t")
sql("sample_random", "select o_orderkey from orders order by md5('42-' || o_orderkey), o_orderkey limit 100")
sql("sample_stratified", f"with {_ranked} select o_orderkey, o_orderpriority from t where rn < 100 // (select count(distinct o_orderpriority) from orders)")
_labels = "t as (select *, row_number() over (partition by quality order by md5('42-' || doc_id), doc_id) - 1 as rn, count(*) over (partition by quality) as n from labels)"
sql("balance_undersample", f"with {_labels} select doc_id, quality, toxic from t where rn < (select min(n) from t)")
sql("balance_oversample", f"with {_labels}, m as (select max(n) as high from t) select doc_id, quality, cast(k as bigint) as copy from t, m, generate_series(0, cast(floor((high - 1 - rn) / n) as bigint)) as g(k)")
sql("balance_smote", """
with c as (select quality, count(*) as n from labels join documents using (doc_id) group by quality)
select quality, false as synthetic, n from c union all select quality, true, (select max(n) from c) - n from c where n < (select max(n) from c)""")
sql("balance_info", f"with c as (select quality, count(*) as n from labels group by quality) select quality, n, {r('(select max(n) / min(n) from c)')} as imbalance from c")

# E
PART = ["p_size", "p_retailprice"]


def scaled(name: str, f: str) -> None:
    """{c}: the value; {m}, {s}, {lo}, {hi}, {top}, {q1}, {q2}, {q3}: the column's statistics."""
    stats = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}, cast(min({c}) as double) as lo_{c}, cast(max({c}) as double) as hi_{c}, max(abs({c})) as top_{c}, quantile_cont(cast({c} as double), 0.25) as q1_{c}, quantile_cont(cast({c} as double), 0.5) as q2_{c}, quantile_cont(cast({c} as double), 0.75) as q3_{c}" for c in PART)
    out = ", ".join(f"{r(f.format(c=f'cast({c} as double)', **{k: f'{k}_{c}' for k in ('m', 's', 'lo', 'hi', 'top', 'q1', 'q2', 'q3')}))} as {c}" for c in PART)
    sql(name, f"with s as (select {stats} from part) select p_partkey, {out} from part, s")


scaled("scale_standard", "({c} - {m}) / {s}")
scaled("scale_minmax", "({c} - {lo}) / ({hi} - {lo})")
scaled("scale_robust", "({c} - {q2}) / ({q3} - {q1})")
sql("scale_quantum", f"""
with s as (select avg(p_size) as ma, stddev_pop(p_size) as sa, avg(p_retailprice) as mb, stddev_pop(p_retailprice) as sb from part),
z as (select p_partkey, (p_size - ma) / sa as a, (p_retailprice - mb) / sb as b from part, s)
select p_partkey, {r('a / sqrt(a * a + b * b)')} as p_size, {r('b / sqrt(a * a + b * b)')} as p_retailprice from z""")
scaled("range_minmax", "({c} - {lo}) / ({hi} - {lo}) * 2 - 1")
scaled("range_clip", "greatest(least(({c} - {lo}) / ({hi} - {lo}), 1), 0) * 2 - 1")
scaled("range_robust", "({c} - {q1}) / ({q3} - {q1}) * 2 - 1")
scaled("range_sigmoid", "1 / (1 + exp(-(({c} - {lo}) / ({hi} - {lo})))) * 2 - 1")
scaled("decimal_scale", "{c} / power(10, ceil(log10({top})))")
scaled("log_ln", "ln({c} + 1e-10)")
scaled("log_log10", "log10({c} + 1e-10)")
scaled("log_log2", "log2({c} + 1e-10)")
scaled("power_sqrt", "sign({c}) * power(abs({c}), 0.5)")
scaled("power_log", "ln(abs({c}) + 1e-10)")
sql("scaling_params", " union all ".join(f"select '{c}' as \"column\", {r(f'avg({c})')} as mean, {r(f'stddev_pop({c})')} as std, {r(f'cast(min({c}) as double)')} as min, {r(f'cast(max({c}) as double)')} as max from part" for c in PART))
_l1, _l2 = "(" + " + ".join(f"abs({x})" for x in XS) + ")", "sqrt(" + " + ".join(f"{x} * {x}" for x in XS) + ")"
for _m, _f in (("l1", f"{{c}} / {_l1}"), ("l2", f"{{c}} / {_l2}"), ("amplitude", f"{{c}} / {_l2}"), ("probability", f"abs({{c}}) / {_l1}"), ("angle", "{c} - floor({c} / (2 * pi())) * 2 * pi()")):
    sql(f"normalize_{_m}", f"with {VECTORS} select vec_id, {each(_f, XS)} from v")

# F
sql("encode_label", "select c_custkey, dense_rank() over (order by c_mktsegment) - 1 as c_mktsegment_label from customer")
sql("encode_onehot", "select c_custkey, " + ", ".join(f"case when c_mktsegment = '{s}' then 1.0::double else 0.0 end as c_mktsegment_{s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " from customer")
sql("encode_binary", "with t as (select o_orderkey, dense_rank() over (order by o_orderpriority) - 1 as i from orders) select o_orderkey, " + ", ".join(f"cast((i >> {k}) & 1 as bigint) as o_orderpriority_bit{k}" for k in range(3)) + " from t")
sql("encode_target", f"""
with g as (select o_orderpriority, count(*) as n, avg(o_totalprice) as m from orders group by 1), a as (select avg(o_totalprice) as mu from orders)
select o_orderkey, {r('(n * m + mu) / (n + 1)', 4)} as o_orderpriority_target from orders join g using (o_orderpriority), a""")
sql("encode_frequency", f"select p_partkey, {r('count(*) over (partition by p_type) / count(*) over ()')} as p_type_freq from part")
sql("bin_quantile", """
with e as (select list_distinct(quantile_cont(p_retailprice, [0, 0.2, 0.4, 0.6, 0.8, 1])) as edges from part)
select p_partkey, cast(len(list_filter(edges, lambda x: x <= p_retailprice)) - 1 as bigint) as p_retailprice_bin from part, e""")
sql("bin_uniform", """
with s as (select cast(min(p_size) as double) as a, cast(max(p_size) as double) as b from part)
select p_partkey, cast(len(list_filter([a, a + (b - a) / 4, a + (b - a) / 4 * 2, a + (b - a) / 4 * 3, b], lambda x: x <= p_size)) - 1 as bigint) as p_size_bin from part, s""")
_hashed = " union all ".join(f"select p_partkey, cast('0x' || substr(md5('{c}=' || {c}), 1, 8) as bigint) % 64 as bucket, case when cast('0x' || substr(md5('{c}=' || {c}), 9, 8) as bigint) % 2 = 0 then 1.0::double else -1.0 end as value from part" for c in ("p_brand", "p_type"))
sql("hash_features", f"select p_partkey, bucket, sum(value) as value from ({_hashed}) group by 1, 2")

# G
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
sql("feature_anova_f", " union all ".join(f"""
select '{c}' as feature, {r('(sum(n * power(m - mu, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))')} as f_score
from (select l_returnflag, count(*) as n, avg({c}) as m, var_pop({c}) as v from lineitem group by 1), (select avg({c}) as mu from lineitem)""" for c in LINE))
sql("feature_mutual_info", " union all ".join(f"""
select '{c}' as feature, {r('sum(n / t * ln(n * t / (nx * ny)))')} as mi from (
select n, sum(n) over (partition by b) as nx, sum(n) over (partition by l_returnflag) as ny, sum(n) over () as t from (
select len(list_filter(edges, lambda x: x <= {c})) as b, l_returnflag, count(*) as n from lineitem, (select list_distinct(quantile_cont({c}, [0, 0.2, 0.4, 0.6, 0.8, 1])) as edges from lineitem) group by 1, 2))""" for c in ("l_quantity", "l_extendedprice")))
sql("feature_corr_matrix", " union all ".join(f"select '{a}' as a, '{b}' as b, {r(f'corr({a}, {b})')} as corr from lineitem" for i, a in enumerate(LINE) for b in LINE[i + 1 :]))
sql("outliers_iqr", "with q as (select quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.75) as b from orders) select o_orderkey from orders, q where o_totalprice between a - 1.5 * (b - a) and b + 1.5 * (b - a)")
sql("outliers_zscore", "with s as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders) select o_orderkey from orders, s where abs(o_totalprice - m) / (s + 1e-10) < 2")
sql("outliers_distance", "with s as (select avg(o_totalprice) as m from orders), d as (select o_orderkey, abs(o_totalprice - m) as x from orders, s) select o_orderkey from d where x <= (select avg(x) + 2 * stddev_pop(x) from d)")
sql("outlier_ratio", f"with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events) select {r('1 - count(*) filter (value between a - 1.5 * (b - a) and b + 1.5 * (b - a)) / count(*)')} as outlier_ratio from events, q")
sql("outlier_flags", f"with s as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders) select o_orderkey, {r('abs(o_totalprice - m) / s')} as score, abs(o_totalprice - m) / s > 2 as is_outlier from orders, s")
_means = "c as (select label as k, " + ", ".join(f"avg({x}) as c{i}" for i, x in enumerate(XS)) + " from v group by label)"
_dist = "sqrt(greatest(0, 2 - 2 * " + " * ".join(f"power(cos(({{x{i}}} - c{i}) / 2), 2)" for i in range(DIMS)) + "))"
_plain = _dist.format(**{x: x for x in XS})
_near = f"n as (select vec_id, arg_min(k, (d, k)) as cluster from (select vec_id, k, {_plain} as d from v, c) group by vec_id)"
sql("kmeans_assign", f"with {VECTORS}, {_means}, {_near} select vec_id, cast(cluster as bigint) as cluster from n")
sql("kmeans_step", f"with {VECTORS}, {_means}, {_near} select cast(cluster as bigint) as cluster, count(*) as n, " + each("avg({c})", XS) + " from n join v using (vec_id) group by cluster")
_zero = _dist.format(x0="coalesce(y0, 0)", **{x: x for x in XS[1:]})
sql("impute_nearest_centroid", f"""
with {VECTORS}, {_means}, w as (select *, case when vec_id % 7 <> 0 then x0 end as y0 from v),
n as (select vec_id, arg_min(c0, (d, k)) as fill from (select vec_id, k, c0, {_zero} as d from w, c) group by vec_id)
select vec_id, {r('coalesce(y0, fill)')} as x0, {each('{c}', XS[1:])} from w join n using (vec_id)""")
_matrix = gaussian_matrix(DIMS, 2)
sql("random_projection", f"with {VECTORS} select vec_id, " + ", ".join(f"{r(' + '.join(f'{x} * {float(w)!r}' for x, w in zip(XS, _matrix[:, k], strict=True)))} as rp{k}" for k in range(2)) + " from v")

# H
for _n, _k in (("kernel_ry", "power(cos((a.{x} - b.{x}) / 2), 2)"), ("kernel_regressor", "power(cos((a.{x} - b.{x}) * pi()), 2)")):
    sql(_n, f"with {VECTORS} select a.vec_id as i, b.vec_id as j, {r(' * '.join(_k.format(x=x) for x in XS))} as k from v a, v b where a.vec_id % 50 = 0")
_k = " * ".join(f"power(cos((a.{x} - b.{x}) / 2), 2)" for x in XS)
sql("mmd_drift", f"""
with {VECTORS}, e as (select * from v where label % 2 = 0), o as (select * from v where label % 2 = 1),
m as (select greatest(0, (select avg({_k}) from e a, e b) + (select avg({_k}) from o a, o b) - 2 * (select avg({_k}) from e a, o b)) as mmd)
select (select count(*) from e) as reference_size, (select count(*) from o) as new_size, {r('mmd', 9)} as mmd_score, mmd > 0.1 as drift_detected, case when mmd > 0.1 then 'DRIFT DETECTED' else 'STABLE' end as status from m""")

# J
sql("autoencoder_compress", f"with {VECTORS} select vec_id, x0, x1 from v")
sql("autoencoder_decompress", f"with {VECTORS} select vec_id, x0, x1, 0.0::double as x2, 0.0::double as x3 from v")
sql("ensemble_shards", "with t as (select vec_id, (row_number() over (order by vec_id) - 1) % 3 as model from embeddings) select model, count(*) as n, cast(sum(vec_id) as bigint) as ids from t group by model")
sql("series_windows", """
with t as (select cast(ts as date) as day, event_type, round(sum(value), 4) as v from events group by 1, 2),
w as (select event_type, day, v, lead(v, 1) over p as v1, lead(v, 2) over p as v2, lead(v, 3) over p as v3 from t window p as (partition by event_type order by day))
select event_type, cast(day as varchar) as day, v as lag3, v1 as lag2, v2 as lag1, v3 as next from w where v3 is not null""")

# L: gates as rows (number in the circuit, type, qubits, parameter)
_top = "greatest(" + ", ".join(f"abs({x})" for x in XS) + ")"
_norm = _l2


def encoder(name: str, program: list[tuple]) -> None:
    rows = ", ".join(f"{{'no': {n}, 't': '{t}', 'a': {a}, 'b': {'null' if b is None else b}, 'p': {'null' if p is None else f'cast({p} as double)'}}}" for n, (t, a, b, p) in enumerate(program))
    sql(f"encode_{name}", f"with {VECTORS}, g as (select vec_id, unnest([{rows}]) as g from v) select vec_id, cast(g.no as bigint) as gate_no, g.t as type, cast(g.a as bigint) as q0, cast(g.b as bigint) as q1, {r('g.p')} as param from g")


_h = [("h", q, None, None) for q in range(4)]
_cx = [("cx", q, q + 1, None) for q in range(3)]
encoder("rotation", [("ry", q, None, f"x{q}") for q in range(4)])
encoder("angle", [("rx", 0, None, "x0"), ("ry", 1, None, "x1"), ("rz", 2, None, "x2"), ("rx", 3, None, "x3")])
encoder("basis_change", [("ry", q, None, f"x{q} / ({_top} + 1e-10) * pi()") for q in range(4)] + [("sdg", q, None, None) for q in range(4)] + _h)
encoder("feature_map", (_h + [("rz", q, None, f"x{q} * x{q}") for q in range(4)] + _cx) * 2)
encoder("density", [("ry", q, None, f"x{q} / {_norm} * pi()") for q in range(4)] + _cx)
encoder("phase", [("p", q, None, f"x{q} * 2 * pi() / {_top}") for q in range(4)] + [("cp", q, q + 1, f"x{q} * pi() / {_top}") for q in range(3)])
encoder("hybrid", [g for q in range(4) for g in (("ry", q, None, f"x{q} / 4"), ("p", q, None, f"x{q} * 0.75"))] + _cx)
encoder("multi_axis", [g for a, k in enumerate("xyz") for g in [(f"r{k}", q, None, f"x{q} * {1 + a / 4}") for q in range(4)] + _cx])
encoder("iqp", (_h + [("rz", q, None, f"x{q}") for q in range(4)] + [("rzz", q, q + 1, f"x{q} * x{q + 1}") for q in range(3)]) * 2)
encoder("composite", [("ry", q, None, f"x{q}") for q in range(4)] + [("rz", q, None, f"x{q}") for q in range(4)])
encoder("layered", [g for k in range(2) for g in [("ry", q, None, f"x{q} * {1 + k / 2}") for q in range(4)] + [("cx", i, j, None) for i in range(4) for j in range(i + 1, 4)] + [("p", q, None, f"x{q} * {k}") for q in range(4)]])
encoder("data_reuse", [("rx", 0, None, "x0"), ("rx", 1, None, "x1"), ("ry", 2, None, "x0 * (1 + pi() / 2)"), ("ry", 3, None, "x1 * (1 + pi() / 2)")])
encoder("adaptive", [("ry", q, None, f"x{q} / {_norm}") for q in range(4)] + _cx)  # no row of the table is sparse or has values over 2
encoder("hierarchical", [("rx", 0, None, "x0"), ("rx", 1, None, "x1"), ("ry", 2, None, "x0 / 2"), ("ry", 3, None, "x1 / 2"), ("cx", 2, 3, None)])
_three = "sqrt(x0 * x0 + x1 * x1 + x2 * x2)"
sql("statevector_amplitudes", f"with {VECTORS}, a as (select vec_id, unnest([x0 / {_three}, x1 / {_three}, x2 / {_three}, 0]) as amplitude, generate_subscripts([1, 2, 3, 4], 1) - 1 as i from v) select vec_id, i, {r('amplitude')} as amplitude from a")
sql("amplitude_encoding", f"with {VECTORS}, a as (select vec_id, unnest([{', '.join(f'{x} / {_norm}' for x in XS)}, 0, 0, 0, 0]) as amplitude, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8], 1) - 1 as i from v) select vec_id, i, {r('amplitude')} as amplitude from a")
sql("density_matrix", f"with {VECTORS} " + " union all ".join(f"select vec_id, cast({i} as bigint) as i, cast({j} as bigint) as j, {r(f'x{i} * x{j} / ({_norm} * {_norm})')} as value from v" for i in range(4) for j in range(4)))
_list = "[" + ", ".join(XS) + "]"
sql("analyze_rows", f"with {VECTORS} select vec_id, {r(f'len(list_filter({_list}, lambda x: x = 0)) / 4')} as sparsity, {r(f'list_avg({_list})')} as mean, {r(f'list_stddev_pop({_list})')} as std, {r(_top)} as max, {r(_norm)} as norm from v")

# M
sql("circuit_compile", "with n as (select count(*) as n from embeddings) select t as type, n * k as n from n, (values ('ry', 8), ('rz', 16), ('rzz', 6)) as g(t, k)")
sql("circuit_transpile", "select vec_id, cast(30 as bigint) as n_gates from embeddings")
sql("circuit_optimize", "select vec_id, cast(8 as bigint) as n_before, cast(8 as bigint) as n_after from embeddings")
sql("circuit_metrics", "select vec_id, cast(9 as bigint) as depth, cast(22 as bigint) as n_gates, cast(0 as bigint) as n_cx from embeddings")
sql("circuit_cost", "select vec_id, cast(0.1041 as double) as seconds, cast(0.052 as double) as price, cast(0.074 as double) as cost from embeddings")
sql("feasibility", "select l_suppkey, case when l_suppkey % 150 > 127 then 'INFEASIBLE: Too many features' when count(*) * 100 > 10000 then 'EXPENSIVE: Consider reducing samples' else 'FEASIBLE' end as verdict from lineitem group by l_suppkey")
sql("simulated_probabilities", f"with {VECTORS}, s as (select vec_id, power(cos(x0 / 2), 2) as a, power(cos(x1 / 2), 2) as b from v) select vec_id, {r('a * b')} as p0, {r('(1 - a) * b')} as p1, {r('a * (1 - b)')} as p2, {r('(1 - a) * (1 - b)')} as p3 from s")
sql("distributed_encode", "with n as (select count(*) as n from embeddings) select t as type, n * k as n from n, (values ('h', 4), ('rz', 4), ('rzz', 3)) as g(t, k)")
sql("scheduler_order", "select o_orderkey, row_number() over (order by o_orderpriority desc, o_orderkey) - 1 as place from orders")
sql("allocation", "with t as (select s_suppkey, cast(sum(s_suppkey % 5 + 1) over (order by s_suppkey) as bigint) as allocated from supplier) select s_suppkey, allocated, allocated <= 127 as fits from t")
sql("fidelity_estimate", f"with e as (select p_partkey, 1 - power(1 - 1e-3, p_size) as e from part) select p_partkey, {r('greatest(0, 1 - (e + 1e-2 * (1 - e)))')} as fidelity from e")
sql("layout_topk", "select s_suppkey as qubit, abs(s_acctbal) / 100000 as error from supplier order by 2, 1 limit 5")
sql("zne_mitigate", f"""
with t as (select l_partkey, 1 - avg(l_discount) as result from lineitem group by 1), e as (select avg(1 - result) as e from t)
select l_partkey, {r('result', 9)} as result, {r('greatest(0, least(1, result / (1 - e)))', 9)} as mitigated from t, e""")
sql("accuracy_degradation", f"select l_suppkey, {r('greatest(0, (1 - avg(l_tax)) * (1 - 30 * 0.01))')} as degraded from lineitem group by 1")
sql("noise_damping", f"with {VECTORS} select vec_id, {each('{c} / ' + _norm, XS)} from v")
sql("privacy_loss", f"select user_id, {r('0.5 * sqrt(count(*))')} as loss from events group by 1")

# N
sql("integrity_batch", "select count(*) as passed, cast(0 as bigint) as failed from embeddings")
_ps = "[" + ", ".join(f"x0 * 0 + {x} * {x} / ({_norm} * {_norm})" for x in XS) + "]"
sql("encoding_fidelity", f"""
with {VECTORS}, p as (select vec_id, {_ps} as p from v)
select vec_id, {r('list_sum(p)')} as fidelity, {r('list_min(p)')} as min_probability, {r('list_max(p)')} as max_probability, {r('-list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: x * log2(x + 1e-10)))')} as entropy, {r('list_sum(list_transform(p, lambda x: x * x))')} as purity from p""")
sql("audit_statistics", f"select count(*) as total, count(distinct user_id) as unique_users, count(distinct json_extract_string(props, '$.k')) as unique_resources, count(distinct event_type) as event_types, {r('count(*) filter (event_type <> ' + chr(39) + 'error' + chr(39) + ') / count(*)')} as success_rate from events")
sql("user_activity", "select user_id, event_type, count(*) as n from events group by 1, 2")
sql("audit_retention", "select event_id, user_id from events order by ts desc, event_id desc limit 500")
sql("compliance_sensitivity", "with t as (select c_custkey, case when c_custkey % 3 = 0 then 'Email_' || c_name else c_name end as name from customer) select * from t where regexp_matches(lower(name), 'ssn|password|credit_card|phone|email|address')")
sql("resource_limit_violations", "select l_suppkey, sum(l_quantity) as used from lineitem join supplier on l_suppkey = s_suppkey group by l_suppkey, s_acctbal having sum(l_quantity) > abs(s_acctbal) * 2")
sql("retention_violations", "select o_orderkey, date_diff('day', cast(o_orderdate as date), date '2000-01-01') as age_days from orders where date_diff('day', cast(o_orderdate as date), date '2000-01-01') > 2000")
sql("governance_catalog", "select doc_id, coalesce(case when doc_id % 3 <> 0 then source end, 'unknown') as owner, coalesce(lang, 'unknown') as classification, 'unknown' as created_date, coalesce(source, 'unknown') as source from documents")
sql("governance_owners", "select cast(s_nationkey as varchar) as owner, s_suppkey as dataset, count(*) over (partition by s_nationkey) as n from supplier")
sql("lineage_closure", """
with recursive c(dataset, ancestor, depth) as (
select p_partkey, p_partkey // 4, cast(1 as bigint) from part where p_partkey // 4 > 0
union all select dataset, ancestor // 4, depth + 1 from c where ancestor // 4 > 0 and ancestor in (select p_partkey from part))
select * from c""")
_tasks = "t as (select p_partkey as task_id, ['success', 'pending', 'success', 'failed', 'pending'][p_partkey % 5 + 1] as status, p_partkey // 2 as dep from part)"
sql("workflow_ready_tasks", f"with {_tasks} select task_id from t where status = 'pending' and not exists (select 1 from t d where d.task_id = t.dep and d.status <> 'success')")
sql("workflow_status_counts", f"with {_tasks}, s as (select unnest(['pending', 'running', 'success', 'failed', 'skipped', 'cancelled']) as status) select status, (select count(*) from t where t.status = s.status) as n from s")
sql("permission_matrix", """
with u as (select c_custkey, ['admin', 'developer', 'user', 'viewer', 'guest'][c_custkey % 5 + 1] as role from customer), p as (select unnest(['read', 'write', 'delete']) as permission)
select c_custkey, role, permission, role = 'admin' or (permission = 'read' and role <> 'guest') or (permission = 'write' and role = 'developer') as allowed from u, p""")
sql("security_anomalies", "select user_id, count(*) filter (event_type = 'error') as n_failed, count(*) filter (event_type = 'error') > 2 as anomalous from events group by 1")
sql("encryption_round_trip", "select c_custkey, c_name as name from customer")
sql("schedule_by_time", "select event_id, row_number() over (order by ts, event_id) - 1 as place from events")
sql("ext_event_windows", f"select cast(cast(ts as date) as varchar) as start, count(*) as n, {r('avg(value)')} as mean from events group by 1")

# What the first round lacked
_angles = (0.1 * np.random.default_rng(42).standard_normal(DIMS)).tolist()
encoder("parametric", [g for i, x in enumerate(XS) for g in (("ry", i, None, x), ("rz", i, None, repr(_angles[i])))])
sql("batch_merge", "select count(*) as n, max(o_totalprice) as largest from orders")
sql("buffer_flush", f"""
with b as (select value, cast(floor((row_number() over (order by ts, event_id) - 1) / 128) as bigint) as flush_id from events)
select flush_id, count(*) as n, {r('avg(value)')} as mean from b group by flush_id""")
sql("augment_gaussian", "with s as (select " + ", ".join(f"avg({c}) as m{i}, stddev_pop({c}) as s{i}" for i, c in enumerate(("p_size", "p_retailprice"))) + " from part), k as (select range as id from range((select 2 * count(*) from part))) select " + ", ".join(
    f"round(sqrt(-2 * ln((cast('0x' || substr(md5('{42 + i}-' || id), 1, 8) as bigint) + 0.5) / 4294967296)) * cos(2 * pi() * (cast('0x' || substr(md5('{42 + i}-' || id), 9, 8) as bigint) + 0.5) / 4294967296) * s{i} + m{i}, 4) + 0.0 as {c}"
    for i, c in enumerate(("p_size", "p_retailprice"))) + " from k, s union all select round(cast(p_size as double), 4), round(p_retailprice, 4) from part")
sql("qasm_round_trip", ORACLE_SQL["encode_iqp"])
sql("lineage_of_dataset", """
with recursive e as (select p_partkey, p_partkey // 4 as parent from part where p_partkey // 4 > 0),
a as (select p_partkey as dataset, parent as ancestor, cast(1 as bigint) as depth from e where p_partkey = 150 union all select a.dataset, e.parent, a.depth + 1 from a join e on e.p_partkey = a.ancestor)
select dataset, ancestor, depth from a""")
_policies = "p as (select * from (values ('discounts', 'l_discount', 0.09::double), ('bulk', 'l_quantity', 49.0::double), ('none', 'l_tax', 1.0::double)) t(policy, measure, \"limit\"))"
_cells = " union all ".join(f"select l_orderkey || '-' || l_linenumber as key, '{c}' as measure, {c} as value from lineitem" for c in ("l_discount", "l_quantity", "l_tax"))
sql("policy_violations", f'with {_policies}, c as ({_cells}) select policy, key, measure, value, "limit" from c join p using (measure) where value > "limit"')
sql("compliance_report", f'with {_policies}, c as ({_cells}) select policy, measure, "limit", count(value) as n_violations, max(value) as worst from p left join c on c.measure = p.measure and value > "limit" group by all'.replace("select policy, measure,", "select policy, p.measure as measure,"))
_alerts = "with a as (select user_id, 'critical ' || event_type as reason, count(*) as n from events where value > 95 group by 1, 2 union all select user_id, 'failed attempts', count(*) filter (event_type = 'error') from events group by 1 having count(*) filter (event_type = 'error') > 2)"
sql("security_alerts", f"{_alerts} select * from a")
sql("security_report", f"{_alerts} select count(*) as n_events, count(distinct event_type) as n_kinds, (select count(*) from a) as n_alerts from events")
sql("key_rotation", "select c_custkey, c_name as name from customer")
sql("cost_breakdown", f"""
with m as (select vec_id, count(*) as n_gates from ({ORACLE_SQL['encode_iqp']}) group by vec_id)
select count(*) as n_tasks, {r('sum(n_gates * 0.01::double)')} as gate_cost, {r('sum((vec_id % 5 + 1) * 0.001::double)')} as qubit_cost, {r('sum(n_gates * 0.01::double) + sum((vec_id % 5 + 1) * 0.001::double)')} as total_cost from m""")

_rel = [("l_quantity", "l_extendedprice"), ("l_discount", "l_extendedprice"), ("l_tax", "l_extendedprice")]
_f = ["l_quantity", "l_discount", "l_tax"]
sql("feature_relevance", "with f as (" + " union all ".join(f"select {i} as i, '{a}' as feature, abs(corr({a}, {b})) as v from lineitem" for i, (a, b) in enumerate(_rel)) + "), c as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, abs(corr({a}, {b})) as w from lineitem" for a in _f for b in _f if a != b) + f"""),
p1 as (select * from f order by round(v, 12) desc, i limit 1),
p2 as (select f.* from f, p1, c where c.a = p1.feature and c.b = f.feature order by round(round(f.v, 12) - w, 12) desc, f.i limit 1),
p3 as (select * from f where feature not in (select feature from p1 union all select feature from p2))
select cast(k as bigint) as rank, feature, {r('v')} as relevance from (select 0 as k, * from p1 union all select 1, * from p2 union all select 2, * from p3)""")
_vectors = f"with {VECTORS} select vec_id, round(tanh("
sql("neural_net", f"{_vectors}(x0 + x1 + x2 + x3) * {float(np.random.default_rng(42).standard_normal(8).sum() * 0.1)!r}::double), 6) + 0.0 as prediction from v")
sql("meta_learner", f"{_vectors}(x0 + x1 + x2 + x3) * {float(np.random.default_rng(42).standard_normal(4).mean() * 0.1)!r}::double), 6) + 0.0 as prediction from v")
sql("transfer_learning", _vectors + " + ".join(f"x{i} * {float(w)!r}::double" for i, w in enumerate(np.random.default_rng(42).standard_normal(4))) + "), 6) + 0.0 as prediction from v")

# Streams, sources and table functions
sql("stream_buffer_flush", f"""
with b as (select event_type, event_id, value, (row_number() over (partition by event_type order by ts, event_id) - 1) // 128 as flush_id from events)
select event_type, flush_id, count(*) as n, min(event_id) as first_id, {r('avg(value)')} as mean from b group by event_type, flush_id having count(*) = 128""")
sql("stream_ring_statistics", f"""
with b as (select event_type, value, row_number() over (partition by event_type order by ts desc, event_id desc) as back, count(*) over (partition by event_type) as n_seen from events)
select event_type, n_seen, count(*) as size, {r('avg(value)')} as mean, {r('stddev_pop(value)')} as std, {r('min(value)')} as min, {r('max(value)')} as max, {r('avg(value) filter (back <= 10)')} as window_mean
from b where back <= 100 group by event_type, n_seen""")
sql("record_log_filtered", "select doc_id, lang, n_chars from documents where n_chars > 3000")
sql("encode_iqp_sql", ORACLE_SQL["encode_iqp"])
sql("series_windows_sql", ORACLE_SQL["series_windows"])

# Neighbours and digests
_psi = lambda x: f"(ln({x} + 6) - 1 / (2 * ({x} + 6)) - 1 / (12 * ({x} + 6)^2) + 1 / (120 * ({x} + 6)^4) - 1 / (252 * ({x} + 6)^6) + 1 / (240 * ({x} + 6)^8) - " + " - ".join(f"1 / ({x} + {i})" for i in range(6)) + ")"
_side = lambda f, i, sign: f"coalesce({sign} * (x - {f}(x, {i}) over w), 'infinity'::double)"
sql("feature_mutual_info_knn", f"""
with {VECTORS}, c as ({" union all ".join(f"select '{x}' as feature, label, {x} as x from v" for x in XS)}),
s as (select *, row_number() over () as id, cast(count(*) over (partition by feature, label) as double) as size from c qualify size > 1),
d as (select *, {", ".join(f"{_side('lag', i, 1)} as l{i}, {_side('lead', i, -1)} as r{i}" for i in (1, 2, 3))} from s window w as (partition by feature, label order by x, id)),
t as (select id, feature, x, size, least(3, size - 1) as k, case least(3, size - 1) when 1 then least(l1, r1) when 2 then least(r2, greatest(l1, r1), l2) else least(r3, greatest(l1, r2), greatest(l2, r1), l3) end as r from d),
m as (select t.id, cast(count(*) as double) as m from t join s p on p.feature = t.feature and case when t.r > 0 then p.x > t.x - t.r and p.x < t.x + t.r else p.x = t.x end group by t.id),
a as (select feature, count(*)::double as n, avg({_psi('k')}) as near, avg({_psi('size')}) as of_class, avg({_psi('m')}) as within from t join m using (id) group by feature)
select feature, {r(f"greatest(0, {_psi('n')} + near - of_class - within)")} as mi from a""")
_cell = lambda text: f"coalesce(length({text}) || ':' || {text}, '-')"
_leaf = "select rn // 64 as idx, sha256(string_agg(digest, '' order by rn)) as digest, count(*) as n from rows group by 1"
_up = lambda below: f"select idx // 64 as idx, sha256(string_agg(digest, '' order by idx)) as digest, sum(n) as n from {below} group by 1"
sql("table_merkle_root", f"""
with rows as (select row_number() over (order by doc_id) - 1 as rn, sha256({" || ".join(_cell(f"cast({c} as varchar)") for c in ("doc_id", "text", "lang", "source", "n_chars"))}) as digest from documents),
l0 as ({_leaf}), l1 as ({_up('l0')}), l2 as ({_up('l1')}), l3 as ({_up('l2')}), l4 as ({_up('l3')}),
tops as ({" union all ".join(f"select {k} as level, count(*) as size, min(digest) as root, cast(sum(n) as bigint) as n_rows from l{k}" for k in range(5))})
select n_rows, root from tops where size = 1 order by level limit 1""")
sql("table_first_difference", """
with rows as (select row_number() over (order by doc_id) - 1 as rn, n_chars, count(*) over () as n, max(n_chars) over () as top from documents),
f as (select min(rn) // 64 * 64 as first_row, any_value(n) as n from rows where n_chars = top)
select first_row, least(64, n - first_row) as n_rows from f""")
sql("coreset_sensitivity", f"""
with {VECTORS}, s as (select x0, x1, x2, x3, (row_number() over (order by md5(cast(vec_id as varchar)), vec_id) - 1) // 5 as k from v qualify k < 5),
g as (select k, vec_id, min({" + ".join(f"(v.{x} - s.{x}) * (v.{x} - s.{x})" for x in XS)}) as d from v, s group by k, vec_id)
select 'set ' || k as name, {r('sum(d)')} as cost, true as near, (select count(*) from v)::double as weight from g group by k""")
