"""Queries over the bound Parquet tables, each with the SQL that says the same."""

from __future__ import annotations

#: Name: (query, SQL).
SAMPLES: dict[str, tuple[str, str]] = {
    "scan": ("{name = N} where tpch.Nation {name = N}", "select n_name as name from nation"),
    "const_filter": ('{name = N} where tpch.Customer {name = N, segment = "BUILDING"}', "select c_name as name from customer where c_mktsegment='BUILDING'"),
    "prefix": ('{name = N} where tpch.Part {name = N}; N = "red"..', "select p_name as name from part where starts_with(p_name,'red')"),
    "prefix_in_key": ('{name = N} where P = tpch.Part {name = "blue"..}; N = P.name', "select p_name as name from part where starts_with(p_name,'blue')"),
    "deny_prefix": ('{name = N} where tpch.Part {name = N}; N != "red"..', "select p_name as name from part where not starts_with(p_name,'red')"),
    "deny_value": ("{k = K} where tpch.Part {partkey = K, size = S}; S != 11", "select p_partkey as k from part where p_size<>11"),
    "cmp_int": ("{k = K} where tpch.Part {partkey = K, size = S}; S < 10", "select p_partkey as k from part where p_size<10"),
    "cmp_flipped": ("{k = K} where tpch.Part {partkey = K, size = S}; 10 <= S", "select p_partkey as k from part where p_size>=10"),
    "cmp_string": ('{t = T} where feed.Event {type = T}; T > "error"', "select event_type as t from events where event_type>'error'"),
    "cmp_same_row": ("{k = K} where tpch.Part {partkey = K, size = S}; K < S", "select p_partkey as k from part where p_partkey<p_size"),
    "cmp_range": ("{k = K} where tpch.Order {orderkey = K, date = D}; D >= 820454400000000; D < 852076800000000", "select o_orderkey as k from orders where o_orderdate>=timestamp '1996-01-01' and o_orderdate<timestamp '1997-01-01'"),
    "join_shared_var": ("{name = N, type = T} where feed.Event {user = U, type = T}; tpch.Customer {custkey = U, name = N}", "select c_name as name, event_type as type from events join customer on user_id=c_custkey"),
    "join_trailing_field": ("{s = S, c = C} where tpch.Supplier {suppkey = S, nation = N}; tpch.Customer {custkey = C, nation = N}", "select s_suppkey as s, c_custkey as c from supplier join customer on s_nationkey=c_nationkey"),
    "ref_follow": ("{nation = N, region = R} where X = tpch.Region {name = R}; tpch.Nation {name = N, region = X}", "select n_name as nation, r_name as region from nation join region on n_regionkey=r_regionkey"),
    "nested_pattern": ("{name = N} where tpch.Nation {name = N, region = tpch.Region {regionkey = 1}}", "select n_name as name from nation join region on n_regionkey=r_regionkey where r_regionkey=1"),
    "nested_twice": ('{k = K} where tpch.Order {orderkey = K, customer = tpch.Customer {segment = "MACHINERY", nation = tpch.Nation {nationkey = 3}}}', "select o_orderkey as k from orders join customer on o_custkey=c_custkey where c_mktsegment='MACHINERY' and c_nationkey=3"),
    "fetch": ("{customer = C.name, nation = C.nation.name} where C = tpch.Customer _", "select c_name as customer, n_name as nation from customer join nation on c_nationkey=n_nationkey"),
    "fetch_shared": ("{a = C.nation.name, b = C.nation.nationkey, c = C.nation.region.name} where C = tpch.Customer _", "select n_name as a, n_nationkey::bigint as b, r_name as c from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey"),
    "fetch_3_hops": ('{line = L.line, nation = L.order.customer.nation.name} where L = tpch.LineItem {flag = "R"}', "select l_linenumber::bigint as line, n_name as nation from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey where l_returnflag='R'"),
    "fetch_two_refs": ("{part = L.part.name, supplier = L.supplier.name} where L = tpch.LineItem {line = 1}", "select p_name as part, s_name as supplier from lineitem join part on l_partkey=p_partkey join supplier on l_suppkey=s_suppkey where l_linenumber=1"),
    "value_side": ("{k = O.orderkey, total = O.value} where O = tpch.Order _", "select o_orderkey as k, cast(round(o_totalprice*100) as bigint) as total from orders"),
    "value_through_ref": ("{k = L.order.orderkey, total = L.order.value} where L = tpch.LineItem {line = 2}", "select o_orderkey as k, cast(round(o_totalprice*100) as bigint) as total from lineitem join orders on l_orderkey=o_orderkey where l_linenumber=2"),
    "derive": ("{k = K, y = Y} where tpch.Part {partkey = K, size = S}; Y = S + 1", "select p_partkey as k, p_size::bigint+1 as y from part"),
    "derive_chain": ("{z = Z} where tpch.Part {size = S}; Y = S + 1; Z = Y - 3", "select p_size::bigint-2 as z from part"),
    "derive_compare": ("{k = K} where tpch.Part {partkey = K, size = S}; Y = S + K; Y > 150", "select p_partkey as k from part where p_size+p_partkey>150"),
    "derive_vs_field": ("{k = K} where tpch.Part {partkey = K, size = S}; Y = S + 10; K < Y", "select p_partkey as k from part where p_partkey<p_size+10"),
    "derive_through_ref": ("{y = Y} where L = tpch.LineItem {line = N}; Y = L.part.size + N", "select p_size::bigint+l_linenumber as y from lineitem join part on l_partkey=p_partkey"),
    "theta": ("{a = A, b = B} where tpch.Region {regionkey = A}; tpch.Nation {nationkey = B}; B < A", "select r_regionkey::bigint as a, n_nationkey::bigint as b from region, nation where n_nationkey<r_regionkey"),
    "cross_self": ("{a = A, b = B} where tpch.Region {name = A}; tpch.Region {name = B}", "select x.r_name as a, y.r_name as b from region x, region y"),
    "self_join": ("{a = A, b = B} where tpch.Nation {nationkey = A, region = R}; tpch.Nation {nationkey = B, region = R}", "select x.n_nationkey::bigint as a, y.n_nationkey::bigint as b from nation x join nation y on x.n_regionkey=y.n_regionkey"),
    "var_eq_var": ("{a = A} where feed.Event {id = A, user = U}; tpch.Supplier {suppkey = S}; U = S", "select event_id as a from events join supplier on user_id=s_suppkey"),
    "negation": ("{k = O.orderkey} where O = tpch.Order _; !tpch.LineItem {order = O}", "select o_orderkey as k from orders where not exists (select 1 from lineitem where l_orderkey=o_orderkey)"),
    "negation_first": ("{k = K} where !tpch.LineItem {order = O}; O = tpch.Order {orderkey = K}", "select o_orderkey as k from orders where not exists (select 1 from lineitem where l_orderkey=o_orderkey)"),
    "negated_disj": ("{d = D.id} where D = corpus.Doc _; !(corpus.Label {doc = D, quality = 1} | corpus.Label {doc = D, toxic = 1})", "select doc_id as d from documents d where not exists (select 1 from labels l where l.doc_id=d.doc_id and (quality=1 or toxic=1))"),
    "neg_uncorrelated": ("{n = N} where tpch.Region {name = N}; !tpch.Region {regionkey = 99}", "select r_name as n from region where not exists (select 1 from region where r_regionkey=99)"),
    "neg_never": ("{n = N} where tpch.Region {name = N}; !never", "select r_name as n from region"),
    "disjunction": ("{k = K} where tpch.Customer {custkey = K} | tpch.Supplier {suppkey = K}", "select c_custkey as k from customer union all select s_suppkey from supplier"),
    "disj_two_filters": ('{k = K} where tpch.Part {partkey = K, size = 11} | tpch.Part {partkey = K, brand = "Brand#2"}', "select p_partkey as k from part where p_size=11 union all select p_partkey from part where p_brand='Brand#2'"),
    "disj_joined": ("{n = N, k = K} where tpch.Nation {nationkey = N}; X = tpch.Nation {nationkey = N}; tpch.Customer {custkey = K, nation = X} | tpch.Supplier {suppkey = K, nation = X}", "select n_nationkey::bigint as n, c_custkey as k from nation join customer on c_nationkey=n_nationkey union all select n_nationkey::bigint, s_suppkey from nation join supplier on s_nationkey=n_nationkey"),
    "disj_never": ("{k = K} where tpch.Supplier {suppkey = K} | never", "select s_suppkey as k from supplier"),
    "row_bind_disj": ("{k = P.partkey} where P = tpch.Part {size = 5} | tpch.Part {size = 7}", "select p_partkey as k from part where p_size in (5,7)"),
    "unit": ('{a = X, b = "k"} where X = 42', "select 42::bigint as a, 'k' as b"),
    "never": ("{a = X} where X = never", "select 0::bigint as a where false"),
    "const_beside_scan": ("{a = K, b = Z} where tpch.Region {regionkey = K}; Z = 7", "select r_regionkey::bigint as a, 7::bigint as b from region"),
    "const_join": ("{n = N} where Z = 3; tpch.Nation {nationkey = Z, name = N}", "select n_name as n from nation where n_nationkey=3"),
    "alias_constraint": ('{n = Y} where X = tpch.Customer _; Y = X.name; Y = "Customer#00000000"..', "select c_name as n from customer where starts_with(c_name,'Customer#00000000')"),
    "alias_as_key": ("{a = A, b = B} where S = tpch.Supplier _; A = S.suppkey; tpch.Customer {custkey = A, name = B}", "select s_suppkey as a, c_name as b from supplier join customer on s_suppkey=c_custkey"),
    "destructure": ("{r = R, n = N} where C = tpch.Customer {custkey = 7}; {r = X, n = N} = {r = 1, n = 2}; R = X", "select 1::bigint as r, 2::bigint as n from customer where c_custkey=7"),
    "subquery": ('{n = X} where X = (Y where tpch.Nation {name = Y}; Y != "NATION_1"..)', "select n_name as n from nation where not starts_with(n_name,'NATION_1')"),
    "subquery_correlated": ("{k = K, n = X} where tpch.Supplier {suppkey = K, nation = N}; X = (Y where tpch.Nation {name = Y, nationkey = Z}; N = tpch.Nation {nationkey = Z})", "select s_suppkey as k, n_name as n from supplier join nation on s_nationkey=n_nationkey"),
    "whole_key": ("K where tpch.Region K", "select r_regionkey::bigint as regionkey, r_name as name from region"),
    "union_injection": ("{i = I, u = U} where feed.Typed {what = {user = U}, id = I}", "select event_id as i, user_id as u from events where event_type='purchase'"),
    "union_tag": ("{i = I} where feed.Typed {what = {kind = _}, id = I}", "select event_id as i from events where event_type<>'purchase'"),
    "union_constant": ('{i = I} where feed.Typed {what = {kind = "click"}, id = I}', "select event_id as i from events where event_type='click'"),
    "union_select": ("{t = T} where feed.Typed X; T = X.what.kind?", "select event_type as t from events where event_type<>'purchase'"),
    "wide_row": ("{d = L.shipdate, f = L.flag, l = L.line, s = L.status} where L = tpch.LineItem _", "select epoch_us(l_shipdate) as d, l_returnflag as f, l_linenumber::bigint as l, l_linestatus as s from lineitem"),
    "join_leading_ref": ("{k = K, l = N} where O = tpch.Order {orderkey = K}; tpch.LineItem {order = O, line = N}", "select o_orderkey as k, l_linenumber::bigint as l from orders join lineitem on l_orderkey=o_orderkey"),
    "head_fact_pattern": ("tpch.Region {regionkey = 1} where tpch.Nation _", "select (r_regionkey::bigint + 1) as value from nation, region where r_regionkey=1"),
    "head_nested_record": ("{a = {k = K, n = N}, b = 1} where tpch.Nation {nationkey = K, name = N}", "select {'k': n_nationkey::bigint, 'n': n_name} as a, 1::bigint as b from nation"),
    "head_scalar": ("N where tpch.Nation {name = N}", "select n_name as value from nation"),
    "head_reference": ("X where tpch.Nation {region = X}", "select n_regionkey::bigint + 1 as value from nation"),
    "whole_key_join": ("{k = C.custkey} where C = tpch.Customer _; tpch.CustomerName (C.name);", "select a.c_custkey as k from customer a join customer b on a.c_name=b.c_name"),
    "whole_key_prefix": ('N where tpch.CustomerName N; N = "Customer#00000001"..', "select c_name as value from customer where starts_with(c_name,'Customer#00000001')"),
    "whole_key_range": ('N where tpch.CustomerName N; N > "Customer#000000100"', "select c_name as value from customer where c_name>'Customer#000000100'"),
    "nested_partial": ("{i = I, u = U} where feed.Span {at = {user = U}, id = I}", "select event_id as i, user_id as u from events"),
    "nested_constant": ("{i = I, t = T} where feed.Span {at = {user = 7, ts = T}, id = I}", "select event_id as i, epoch_us(ts) as t from events where user_id=7"),
    "nested_access": ("{i = S.id, u = S.at.user} where S = feed.Span _; U = S.at.user; U < 20", "select event_id as i, user_id as u from events where user_id<20"),
    "nested_join": ("{i = I, n = N} where feed.Span {at = {user = U}, id = I}; tpch.Customer {custkey = U, name = N}", "select event_id as i, c_name as n from events join customer on user_id=c_custkey"),
    "constant_fits_constraint": ('{a = X} where X = "abc"; X = "a"..', "select 'abc' as a"),
    "constant_fails_constraint": ('{a = X} where X = "abc"; X = "z"..', "select '' as a where false"),
    "constant_passes_denial": ('{a = X} where X = "abc"; X != "z"..', "select 'abc' as a"),
    "denials_in_conjunction": ('{n = N} where tpch.Part {name = N}; N != "red"..; N != "blue"..', "select p_name as n from part where not starts_with(p_name,'red') and not starts_with(p_name,'blue')"),
    "constraint_and_denial": ('{n = N} where tpch.Part {name = N}; N = "b"..; N != "blue 1"..', "select p_name as n from part where starts_with(p_name,'b') and not starts_with(p_name,'blue 1')"),
    "computed_against_constant": ("{k = K} where tpch.Region {regionkey = K}; Y = 1 + 1; Y < 5", "select r_regionkey::bigint as k from region"),
    "sum_wraps": ("{i = I, y = Y} where feed.Event {id = I}; Y = I + 9223372036854775807", "select event_id as i, case when event_id>0 then event_id-1+(-9223372036854775807-1) else 9223372036854775807 end as y from events"),
    "difference_wraps": ("{i = I, y = Y} where feed.Event {id = I}; Y = -9223372036854775808 - I", "select event_id as i, case when event_id>0 then 9223372036854775807-(event_id-1) else -9223372036854775807-1 end as y from events"),
    "int_underscores": ("{k = K} where tpch.Order {orderkey = K}; K > 1_000", "select o_orderkey as k from orders where o_orderkey>1000"),
    "string_escapes": (r'{n = N} where tpch.Part {name = N}; N = "\u0072e\u0064"..', "select p_name as n from part where starts_with(p_name,'red')"),
    "subquery_nested": ("{n = X} where X = (Y where Y = (Z where tpch.Nation {name = Z}))", "select n_name as n from nation"),
    "subquery_of_a_sum": ("{n = X} where X = (Y where tpch.Nation {nationkey = C}; Y = C + 1)", "select n_nationkey::bigint + 1 as n from nation"),
    "order_of_statements": ('{n = N} where N = "red"..; tpch.Part {name = N}', "select p_name as n from part where starts_with(p_name,'red')"),
    "record_constant": ("{x = A.x, y = A.y} where A = {x = 2, y = 3}", "select 2::bigint as x, 3::bigint as y"),
    "record_constant_join": ("{n = N} where A = {k = 3}; tpch.Nation {nationkey = A.k, name = N}", "select n_name as n from nation where n_nationkey=3"),
    "destructure_field": ("{i = I, u = U} where S = feed.Span _; I = S.id; {user = U, ts = _} = S.at", "select event_id as i, user_id as u from events"),
    "disj_of_outer_values": ("{n = N} where tpch.Part {partkey = A, size = B}; tpch.Customer {custkey = A, name = N} | tpch.Supplier {suppkey = B, name = N}", "select c_name as n from part join customer on c_custkey=p_partkey union all select s_name from part join supplier on s_suppkey=p_size"),
    "negation_of_a_key": ("{k = K} where tpch.Customer {custkey = K}; !tpch.Supplier {suppkey = K}", "select c_custkey as k from customer where not exists (select 1 from supplier where s_suppkey=c_custkey)"),
    "union_in_both": ('{i = I, j = J} where feed.Typed {what = {user = U}, id = I}; feed.Span {at = {user = U}, id = J}; I < J', "select a.event_id as i, b.event_id as j from events a join events b on a.user_id=b.user_id where a.event_type='purchase' and a.event_id<b.event_id"),
    "union_select_in_head": ("X.what.user? where feed.Typed X", "select user_id as value from events where event_type='purchase'"),
    "value_of_text": ("{i = D.id, n = D.chars} where D = corpus.Doc {lang = \"fr\"}", "select doc_id as i, n_chars::bigint as n from documents where lang='fr'"),
    "label_of_doc": ("{i = L.doc.id, l = L.doc.lang} where L = corpus.Label {toxic = 1}", "select d.doc_id as i, lang as l from labels l join documents d on l.doc_id=d.doc_id where toxic=1"),
}
