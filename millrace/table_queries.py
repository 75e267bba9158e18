"""Registered queries of operators that find or relate what is in the given tables, and their DuckDB SQL."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import generators
from millrace.functions.prf import draw, duck_draw, duck_unit, unit
from millrace.operators import compliance, discovery, profile, relations, states, temporal
from millrace.plans import generate, profiler, scenario
from millrace.plans.schema import SchemaGraph
from millrace.sources import catalog, ledger
from millrace.streaming import audits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: _read(spark, sf_dir, t) for t in catalog.table_names(spark, sf_dir)}


# ---- discovery: columns that can be keys, by kind (i: whole numbers, s: texts, t: times)

_KEYED = {
    "region": "r_regionkey:i r_name:s", "nation": "n_nationkey:i n_name:s n_regionkey:i", "customer": "c_custkey:i c_name:s c_nationkey:i c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i", "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s props:s", "documents": "doc_id:i text:s lang:s source:s n_chars:i", "embeddings": "vec_id:i label:i",
    "pages": "page_id:i url:s html:s", "benchmark": "item_id:i text:s", "labels": "doc_id:i quality:i toxic:i", "conversations": "conv_id:i turn:i role:s text:s",
}
_KEYED = {t: [tuple(x.split(":")) for x in own.split()] for t, own in _KEYED.items()}
_EACH = [(t, c, k) for t, own in _KEYED.items() for c, k in own]
_STEM = "case when regexp_matches({c}, '^[^_]{{0,2}}_.') then regexp_replace({c}, '^[^_]*_', '') else {c} end"
_KEYS_SQL = f"""with v as ({' union all '.join(f"select '{t}' as t, '{c}' as c, '{k}' as kind, cast({c} as varchar) as val from {t} where {c} is not null" for t, c, k in _EACH)}),
d as (select t, c, kind, val, count(*) as n from v group by all),
o as (select t, c, count(*) as n_values, max(n) as most from d group by all),
p as (select a.t as "table", a.c as "column", b.t as parent, b.c as parent_column, count(*) as shared from d a join d b using (kind, val) where a.t <> b.t or a.c <> b.c group by all)
select "table", "column", parent, parent_column, round(shared::double / x.n_values, 6) as coverage, x.n_values, y.n_values as n_parent_values,
{_STEM.format(c='"column"')} = {_STEM.format(c='parent_column')} or "column" in (parent || '_' || parent_column, regexp_replace(parent, 's$', '') || '_' || parent_column) as named
from p join o x on x.t = "table" and x.c = "column" join o y on y.t = parent and y.c = parent_column where y.most = 1 and shared >= {discovery.MIN_COVERAGE} * x.n_values"""
_add("key_discovery", lambda spark, d: discovery.inclusions(_all(spark, d)), _KEYS_SQL)


def _unique_sql() -> str:
    asked = []
    for t, own in _KEYED.items():
        names = [c for c, _ in own]
        for width in range(1, discovery.WIDEST + 1):
            for s in itertools.combinations(range(len(names)), width):
                cols = ", ".join(names[i] for i in s)
                whole = " and ".join(f"{names[i]} is not null" for i in s)
                asked.append(f"""select '{t}' as "table", '{cols.replace(" ", "")}' as columns, {width} as width, {sum(1 << i for i in s)} as mask, (select bool_and({whole}) from {t}) as complete from {t} where {whole} having count(*) > 0 and count(*) = count(distinct ({cols}))""")
    return f"""with u as ({' union all '.join(asked)}) select "table", columns, width, complete from u where not exists (select 1 from u o where o."table" = u."table" and o.mask <> u.mask and o.mask & u.mask = o.mask)"""


_add("unique_sets", lambda spark, d: discovery.unique_sets_frame(_all(spark, d)), _unique_sql())
_LABELS_SQL = " union all ".join(f"""select '{t}' as "table", '{c}' as "column", cast({c} as varchar) as value, count(*) as n, count(*) * 100.0::double / (select count({c}) from {t}) as pct from {t} where {c} is not null and (select count(distinct {c}) from {t}) <= {discovery.THRESHOLD} group by {c}""" for t, c, k in _EACH if k != "t")
_add("label_discovery", lambda spark, d: discovery.labels_frame(_all(spark, d)), _LABELS_SQL)


# ---- as-of and interval joins


def _last_order(spark: SparkSession, d: str) -> DataFrame:
    events, orders = _read(spark, d, "events", "event_id", "user_id", "ts"), _read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return temporal.asof_join(events, orders, [("user_id", "o_custkey")], "ts", "o_orderdate", ["o_orderkey", "o_orderdate"], ["o_orderkey"])


_add("asof_last_order", _last_order, """select event_id, user_id, ts, o_orderkey, o_orderdate from events asof left join (select o_custkey, o_orderdate, max(o_orderkey) as o_orderkey from orders group by all) o on user_id = o_custkey and ts >= o_orderdate""")


def _earlier_shipment(spark: SparkSession, d: str) -> DataFrame:
    lines = _read(spark, d, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    found = temporal.asof_join(lines, lines, [("l_partkey", "l_partkey")], "l_shipdate", "l_shipdate", ["l_shipdate", "l_quantity"], ["l_quantity"], strict=True)
    return found.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", F.col("l_shipdate_right").alias("earlier"), F.col("l_quantity_right").alias("earlier_quantity"))


_add("asof_earlier_shipment", _earlier_shipment, """select l.l_partkey, l_orderkey, l_linenumber, l_quantity, l.l_shipdate, r.l_shipdate as earlier, r.q as earlier_quantity from lineitem l asof left join (select l_partkey, l_shipdate, max(l_quantity) as q from lineitem group by all) r on l.l_partkey = r.l_partkey and l.l_shipdate > r.l_shipdate""")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with their order's customer and date."""
    orders = _read(spark, d, "orders", F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("placed"))
    return _read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").join(orders, "l_orderkey")


_LINES = "(select l_orderkey, l_linenumber, l_partkey, l_shipdate, o_custkey as customer, o_orderdate as placed from lineitem join orders on o_orderkey = l_orderkey)"


def _open_lines(spark: SparkSession, d: str) -> DataFrame:
    found = temporal.interval_join(_read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", _lines(spark, d), "placed", "l_shipdate", [("o_custkey", "customer")])
    return found.select("o_orderkey", "o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "placed", "l_shipdate")


_add("interval_open_lines", _open_lines, f"select o_orderkey, o_orderdate, l_orderkey, l_linenumber, l_partkey, placed, l_shipdate from orders join {_LINES} on customer = o_custkey and placed <= o_orderdate and o_orderdate < l_shipdate")
_add("sweep_open_at_orders", lambda spark, d: temporal.open_counts(_read(spark, d, "orders", "o_orderkey", "o_orderdate"), "o_orderdate", _lines(spark, d), "placed", "l_shipdate"), f"with l as (select placed, l_shipdate from {_LINES} where placed < l_shipdate) select o_orderkey, o_orderdate, ((select count(*) from l where placed <= o_orderdate) - (select count(*) from l where l_shipdate <= o_orderdate))::bigint as n_open from orders")


def _open_days(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return temporal.open_counts(temporal.days(lines, "placed", "l_shipdate"), "day", lines, "placed", "l_shipdate")


_add("sweep_open_by_day", _open_days, f"with l as (select placed, l_shipdate from {_LINES}), e as (select unnest(generate_series(min(placed)::date, max(l_shipdate)::date, interval 1 day)) as day from l) select day::timestamp as day, count(l.placed)::bigint as n_open from e left join l on placed <= day and day < l_shipdate group by 1")


# ---- combinations of keys that don't repeat

SEED = 42


def _stocked(spark: SparkSession, d: str) -> DataFrame:
    """Three tenths of all (part, supplier) pairs."""
    parts, suppliers = _read(spark, d, "part", "p_partkey"), _read(spark, d, "supplier", "s_suppkey")
    n = parts.count() * suppliers.count() * 3 // 10
    return relations.unique_pairs(spark, n, [(parts, "p_partkey", "part"), (suppliers, "s_suppkey", "supplier")], "stock", SEED)


def _rounds(n: int) -> str:
    """Both coordinates after n rounds, from row_no, np and ns."""
    if not n:
        return "(select row_no, np, ns, row_no % np as a, row_no // np as b from rows)"
    r = n - 1
    first = f"(select row_no, np, ns, b, (a + {duck_draw(SEED, f'stock.{r}.0', 'b')}) % np as a from {_rounds(r)})"
    return f"(select row_no, np, ns, a, (b + {duck_draw(SEED, f'stock.{r}.1', 'a')}) % ns as b from {first})"


_add("unique_part_suppliers", _stocked, f"""with p as (select p_partkey, row_number() over (order by p_partkey) - 1 as i from part), s as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as i from supplier),
n as (select (select count(*) from part) as np, (select count(*) from supplier) as ns), rows as (select unnest(range(np * ns * 3 // 10)) as row_no, np, ns from n)
select row_no, p_partkey as part, s_suppkey as supplier from {_rounds(relations.ROUNDS)} join p on p.i = a join s on s.i = b""")


# ---- shapes: distributions and rank correlations of given columns, and rows regenerated from a profile


def _ks_sql(e: str, a: str) -> str:
    """The greatest gap between two relations with a column v."""
    return f"""select round(max(abs(ce::double / te - ca::double / ta)), 6) as ks_gap from (select sum(sum(e)) over w as ce, sum(sum(a)) over w as ca, (select count(v) from {e}) as te, (select count(v) from {a}) as ta
from (select v, 1 as e, 0 as a from {e} where v is not null union all select v, 0, 1 from {a} where v is not null) group by v window w as (order by v))"""


def _rank_sql(rows: str) -> str:
    """Spearman's correlation of a relation with columns x and y, without nulls."""
    mean = lambda c: f"(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double)"
    return f"select round(corr(a, b), 6) as correlation from (select {mean('x')} as a, {mean('y')} as b from {rows})"


_FLAGS = "(select l_extendedprice as v from lineitem where l_returnflag {how} 'R')"
_add("ks_gap_returned", lambda spark, d: (lambda df: compliance.ks_gap(df.where("l_returnflag <> 'R'"), "l_extendedprice", df.where("l_returnflag = 'R'"), "l_extendedprice"))(_read(spark, d, "lineitem")), _ks_sql(_FLAGS.format(how="<>"), _FLAGS.format(how="=")))
_add("rank_correlation_lineitem", lambda spark, d: compliance.rank_correlation(_read(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), _rank_sql("(select l_quantity as x, l_extendedprice as y from lineitem)"))
_PAIR, _BINS = ("l_quantity", "l_extendedprice"), profile.BINS


def _shaped_lines(spark: SparkSession, d: str) -> DataFrame:
    """As many lines as there are, with quantity and price drawn together."""
    lines = _read(spark, d, "lineitem", *_PAIR)
    shape = profile.joint_shape(lines, _PAIR)
    ranks = generators.joint_ranks(F.col("id"), SEED, "lines", shape["counts"])
    knots = [[(k / _BINS, v) for k, v in enumerate(edges)] for edges in shape["edges"]]
    return spark.range(lines.count()).select("id", *[F.round(generators.inverse(u, own), 4).alias(c) for u, own, c in zip(ranks, knots, _PAIR, strict=True)])


def _bin(counts: str, x: str) -> str:
    return f"len(list_filter({counts}, lambda e: e <= {x}))"


def _edge(c: str) -> str:
    return "[" + ", ".join(f"round(quantile_cont({c}, {k / _BINS}), 6)" for k in range(_BINS + 1)) + "]"


_AT = f"least(floor(u * {_BINS}), {_BINS - 1})::bigint"
_INVERSE = f"e[{_AT} + 1] + (u - {_AT} / {float(_BINS)}::double) * ((e[{_AT} + 2] - e[{_AT} + 1]) / ({1 / _BINS}::double))"


def _value(column: str, edges: str, at: str, name: str) -> str:
    u = f"(({at} + {duck_unit(duck_draw(SEED, f'lines.rank{name}', 'id'))}) / {float(_BINS)}::double)"
    return f"(select round({_INVERSE.replace('u * ', u + ' * ').replace('(u - ', '(' + u + ' - ').replace('e[', edges + '[')}, 4)) as {column}"


_SHAPED_LINES = f"""(with e as (select {_edge('l_quantity')} as qe, {_edge('l_extendedprice')} as pe from lineitem),
b as (select len(list_filter(qe[2:{_BINS}], lambda v: v <= l_quantity)) as a, len(list_filter(pe[2:{_BINS}], lambda v: v <= l_extendedprice)) as b from lineitem, e),
g as (select x.a, y.b, (select count(*) from b where b.a = x.a and b.b = y.b) as n from range({_BINS}) x(a), range({_BINS}) y(b)),
t as (select a, list(up order by b) as ups, max(up) as total from (select a, b, sum(n) over (partition by a order by b)::bigint as up from g) group by a),
m as (select list(up order by a) as ups, max(up) as total from (select a, sum(total) over (order by a)::bigint as up from t)),
r as (select range as id from range((select count(*) from lineitem))),
i as (select id, {_bin(f'm.ups[:{_BINS - 1}]', duck_draw(SEED, 'lines.bin0', 'id') + ' % m.total')} as a from r, m),
j as (select id, i.a, {_bin(f't.ups[:{_BINS - 1}]', duck_draw(SEED, 'lines.bin1', 'id') + ' % greatest(t.total, 1)')} as b from i join t on t.a = i.a)
select id, {_value('l_quantity', 'qe', 'a', '0')}, {_value('l_extendedprice', 'pe', 'b', '1')} from j, e)"""
_add("shape_lines", _shaped_lines, f"select id, l_quantity, l_extendedprice from {_SHAPED_LINES}")


def _shaped_orders(spark: SparkSession, d: str) -> DataFrame:
    """As many orders as there are, by the quantiles of prices and the months, weekdays and hours of dates."""
    doc = profiler.collect(spark, d, _only(spark, d, "orders"))["tables"]["orders"]
    plan = scenario.from_profile({"tables": {"orders": doc}}).tables["orders"].overrides
    price = F.round(generators.inverse(unit(draw(SEED, "orders.o_totalprice", F.col("id"))), plan["o_totalprice"].value), 4)
    return spark.range(doc["row_count"]).select("id", price.alias("o_totalprice"), generators.dated(F.col("id"), SEED, "orders.o_orderdate", *plan["o_orderdate"].value).alias("o_orderdate"))


def _only(spark: SparkSession, d: str, *tables: str) -> SchemaGraph:
    return catalog.introspect(spark, d, catalog.DRIVER_KEYS).filtered(tables)


def _at(part: str) -> str:
    return duck_draw(SEED, f"orders.o_orderdate.{part}", "id")


_KNOTS = (0.0, *profile.PERCENTILES, 1.0)
_SEGMENTS = " ".join(f"when u < {r!r}::double then q[{k}] + (u - {q!r}::double) * ((q[{k + 1}] - q[{k}]) / ({r!r}::double - {q!r}::double))" for k, (q, r) in enumerate(zip(_KNOTS, _KNOTS[1:], strict=False), 1))
_SHAPED_ORDERS = f"""(with s as (select [min(o_totalprice), {', '.join(f'round(quantile_cont(o_totalprice, {q}), 6)' for q in profile.PERCENTILES)}, max(o_totalprice)] as q, min(o_orderdate) as low, max(o_orderdate) as high,
count(*) filter (where isodow(o_orderdate) <= 5) * 100.0::double / count(*) as ratio, count(*) as n from orders),
m as (select list(month order by month) as months, list(up order by month) as ups, max(up) as total from (select month, sum(n) over (order by month)::bigint as up from (select date_trunc('month', o_orderdate)::date as month, count(*) as n from orders group by 1))),
h as (select list(up order by hour) as ups, max(up) as total from (select hour, sum(n) over (order by hour)::bigint as up from (select g.hour, round(coalesce(max(c.n), 0) * 100.0::double / (select count(*) from orders) * 1000000)::bigint as n from range(24) g(hour) left join (select hour(o_orderdate) as hour, count(*) as n from orders group by 1) c on c.hour = g.hour group by 1))),
r as (select range as id from range((select n from s))),
a as (select id, m.months[len(list_filter(m.ups[:len(m.ups) - 1], lambda e: e <= {_at('month')} % m.total)) + 1] as month from r, m),
b as (select id, month, last_day(month) as last, month + ({_at('day')} % day(last_day(month)))::int as day, {duck_unit(_at('week'))} * 100 < s.ratio as work, ({_at('end')} % 2)::int as coin from a, s),
c as (select *, isodow(day)::int - 1 as week, day + (5 - (isodow(day)::int - 1)) as ahead from b),
w as (select id, day + case when work then case when week = 5 and day = month then 2 when week = 5 then -1 when week = 6 and day = last then -2 when week = 6 then 1 else 0 end
when week >= 5 then 0 when ahead + coin <= last then 5 - week + coin when ahead <= last then 5 - week else -(week + 1) end as day from c),
t as (select id, day::timestamp + to_seconds(len(list_filter(h.ups[:23], lambda e: e <= {_at('hour')} % h.total)) * 3600 + {_at('second')} % 3600) as moment from w, h),
u as (select id, {duck_unit(duck_draw(SEED, 'orders.o_totalprice', 'id'))} as u from r)
select id, round(case {_SEGMENTS} end, 4) as o_totalprice, least(greatest(moment, low::timestamp), high::timestamp) as o_orderdate from t join u using (id), s)"""
_add("shape_orders", _shaped_orders, f"select id, o_totalprice, o_orderdate from {_SHAPED_ORDERS}")
#: How far regenerated rows may be from the given ones: gaps of shares, difference of correlations, points of weekdays.
_TOLERANCE = {"price_gap": 0.05, "quantity_gap": 0.05, "line_price_gap": 0.05, "date_gap": 0.05, "correlation": 0.03, "weekdays": 3.0}


def _fit(spark: SparkSession, d: str) -> DataFrame:
    """A database regenerated from its profile as the command line does it, held against the given one."""
    graph = _only(spark, d, "orders", "lineitem")
    doc = profiler.collect(spark, d, graph, profiler.Options(joint={"lineitem": _PAIR}))
    made = generate.generate(spark, graph, scenario.from_profile(doc).with_counts({t: x["row_count"] for t, x in doc["tables"].items()}), SEED, keyless=("orders", "lineitem"))
    orders, lines = _read(spark, d, "orders"), _read(spark, d, "lineitem")
    days = lambda df: df.select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double").alias("v"))
    both = lambda f, a, b: f(a).toDF("x").join(f(b).toDF("y")).select(F.abs(F.col("x") - F.col("y")))
    found = {
        "price_gap": compliance.ks_gap(orders, "o_totalprice", made["orders"], "o_totalprice"), "date_gap": compliance.ks_gap(days(orders), "v", days(made["orders"]), "v"),
        "weekdays": both(lambda df: df.agg(F.count_if(F.weekday("o_orderdate") < 5) * 100.0 / F.count(F.lit(1))), orders, made["orders"]), "quantity_gap": compliance.ks_gap(lines, "l_quantity", made["lineitem"], "l_quantity"),
        "line_price_gap": compliance.ks_gap(lines, "l_extendedprice", made["lineitem"], "l_extendedprice"),
    }
    found = {name: one.select((F.col(one.columns[0]) <= _TOLERANCE[name]).alias("held")) for name, one in found.items()}
    found["correlation"] = compliance.correlations_near(lines, made["lineitem"], *_PAIR, _TOLERANCE["correlation"])
    out = None
    for name, one in found.items():
        row = one.select(F.lit(name).alias("measure"), F.lit(_TOLERANCE[name]).alias("tolerance"), "held")
        out = row if out is None else out.unionByName(row)
    return out


def _fit_sql() -> str:
    gap = lambda e, a: f"({_ks_sql(e, a)})"
    of = lambda c, t: f"(select {c} as v from {t})"
    share = "(select count(*) filter (where isodow(o_orderdate) <= 5) * 100.0::double / count(*) from {t})"
    found = {
        "price_gap": gap(of("o_totalprice", "orders"), of("o_totalprice", "so")), "date_gap": gap(of("epoch_us(o_orderdate::timestamp)", "orders"), of("epoch_us(o_orderdate)", "so")),
        "weekdays": f"abs({share.format(t='orders')} - {share.format(t='so')})", "quantity_gap": gap(of("l_quantity", "lineitem"), of("l_quantity", "sl")), "line_price_gap": gap(of("l_extendedprice", "lineitem"), of("l_extendedprice", "sl")),
        "correlation": f"abs(({_rank_sql('(select l_quantity as x, l_extendedprice as y from lineitem)')}) - ({_rank_sql('(select l_quantity as x, l_extendedprice as y from sl)')}))",
    }
    rows = " union all ".join(f"select '{n}' as measure, {_TOLERANCE[n]}::double as tolerance, {x} <= {_TOLERANCE[n]} as held" for n, x in found.items())
    return f"with so as materialized (select * from {_SHAPED_ORDERS}), sl as materialized (select * from {_SHAPED_LINES}) {rows}"


_add("shape_fit", _fit, _fit_sql())


# ---- profiles that add up: of three parts merged, against SQL over the whole


def _parts(spark: SparkSession, d: str, table: str, key: str) -> DataFrame:
    whole = _read(spark, d, table)
    return states.merged(states.union(states.states(whole.where(f"{key} % 3 = {k}")) for k in range(3)))


_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _prefix_sql(c: str) -> str:
    """Sign, exponent and 12 bits of a value other than zero, in order; exponents by powers that are exact."""
    e = f"(floor(log2(abs({c})))::int)"
    exact = f"({e} + case when abs({c}) >= pow(2.0::double, {e} + 1) then 1 when abs({c}) < pow(2.0::double, {e}) then -1 else 0 end)"
    size = f"(({exact} + 1023) * 4096::bigint + floor((abs({c}) / pow(2.0::double, {exact}) - 1) * 4096)::bigint)"
    return f"case when {c} = 0 then 0 else {size} end"


def _state_sql(c: str) -> str:
    ranks = ", ".join(f"max(case when start <= floor({q} * (total - 1)) and floor({q} * (total - 1)) < start + n then prefix end) as p{int(q * 100)}" for q in profile.PERCENTILES)
    value = "case when {p} = 0 then 0 else (1 + ({p} % 4096) / 4096.0::double) * pow(2.0::double, {p} // 4096 - 1023) end"
    edges = ", ".join(f"round({value.format(p=f'p{int(q * 100)}')}, 6) as p{int(q * 100)}" for q in profile.PERCENTILES)
    counts = f"select prefix, n, coalesce(sum(n) over (order by prefix rows between unbounded preceding and 1 preceding), 0) as start, sum(n) over () as total from (select {_prefix_sql(f'{c}::double')} as prefix, count(*) as n from lineitem where {c} is not null group by 1)"
    return f"""select '{c}' as "column", s.*, {edges}, 0.0::double as null_rate from (select {ranks} from ({counts})), (select count({c}) as n, min({c})::double as min_val, max({c})::double as max_val, round(avg({c}), 6) as mean_val, round(stddev_samp({c}), 6) as stddev_val from lineitem) s"""


_add("merged_numeric_lineitem", lambda spark, d: states.numeric_profile(_parts(spark, d, "lineitem", "l_orderkey")), " union all ".join(map(_state_sql, _NUMERIC)))
_add("merged_texts_documents", lambda spark, d: states.text_profile(_parts(spark, d, "documents", "doc_id")), " union all ".join(f"""select '{c}' as "column", count(distinct {c}) as cardinality, round(avg(length({c})), 6) as avg_length, min(length({c}))::bigint as min_length, max(length({c}))::bigint as max_length from documents""" for c in ("text", "lang", "source")))
_add("merged_months_orders", lambda spark, d: states.counts_by(_parts(spark, d, "orders", "o_orderkey"), "month"), """select 'o_orderdate' as "column", strftime(o_orderdate, '%Y-%m') as key, count(*) as n from orders group by 2""")


# ---- streams: the given tables as they come, against SQL over the whole


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    return audits.stream(spark, f"{d}/{table}.parquet")


def _drained(spark: SparkSession, df: DataFrame, name: str, mode: str) -> DataFrame:
    return audits.drain(df, audits.scratch(spark, name), mode)


def _stream_orphans(spark: SparkSession, d: str) -> DataFrame:
    thrice = _stream(spark, d, "lineitem").select((F.col("l_orderkey") * 3).alias("k"))
    families = audits.family_states(thrice, "k", _stream(spark, d, "orders"), "o_orderkey")
    return audits.orphans(audits.latest(_drained(spark, families, "families", "update"), ["key"]))


def _stream_early(spark: SparkSession, d: str) -> DataFrame:
    early = audits.early_children(_stream(spark, d, "lineitem"), "l_orderkey", "l_shipdate", _stream(spark, d, "orders"), "o_orderkey", "o_orderdate")
    return audits.appended(_drained(spark, early, "early", "append")).groupBy("key").agg(F.count(F.lit(1)).alias("violations"))


_add("stream_orphans", _stream_orphans, "select count(*) as orphans from (select l_orderkey * 3 as k from lineitem) where k is not null and not exists (select 1 from orders where o_orderkey = k)")
_add("stream_early_lines", _stream_early, "select o_orderkey as key, count(*) as violations from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate group by 1")
_add("stream_densities", lambda spark, d: audits.latest(_drained(spark, audits.densities(_stream(spark, d, "events"), "ts"), "densities", "update"), ["kind", "at"]), "select 'month' as kind, strftime(ts, '%Y-%m') as at, count(*) as n from events group by 2 union all select 'hour', hour(ts)::varchar, count(*) from events group by 2")


# ---- a transaction over two tables: serials come back, children point to their parents' new ones


def _inserted(spark: SparkSession, d: str) -> DataFrame:
    with ledger.Transaction(spark, audits.scratch(spark, "ledger")) as t:
        people = t.insert("customer", _read(spark, d, "customer", "c_custkey", "c_name"), ["c_custkey"])
        parents = people.select(F.col("id").alias("customer_id"), "c_custkey")
        placed = _read(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").join(parents, F.col("o_custkey") == F.col("c_custkey"))
        return t.insert("orders", placed.select("o_orderkey", "customer_id", "o_totalprice"), ["o_orderkey"])


_add("inserted_serials", _inserted, "select row_number() over (order by o_orderkey) as id, o_orderkey, customer_id, o_totalprice from orders join (select c_custkey, row_number() over (order by c_custkey) as customer_id from customer) on c_custkey = o_custkey")
