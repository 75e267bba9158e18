"""The registered queries of the engine itself, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from millrace import table_queries
from millrace.functions import classify, generators, pools
from millrace.functions.prf import bulk, draw, duck_draw, duck_hex, duck_unit
from millrace.operators import audit, compliance, lifecycle, profile, relations, temporal
from millrace.plans import generate, grow, profiler, scenario, schema
from millrace.sources import catalog, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = 42


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _on(table: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(_read(spark, d, table))


# ---- profile

_NULLS = "count(*) filter (where {c} is null) * 100.0::double / nullif(count(*), 0)"


def _numeric_sql(c: str, table: str, before: str = "") -> str:
    p = ", ".join(f"round(quantile_cont({c}::double, {q}), 6) as p{int(q * 100)}" for q in profile.PERCENTILES)
    return f"select {before} min({c}::double) as min_val, max({c}::double) as max_val, round(avg({c}::double), 6) as mean_val, round(stddev_samp({c}::double), 6) as stddev_val, {p}, cast({_NULLS.format(c=c)} as double) as null_rate from {table}"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in catalog.table_names(spark, d):
        one = profile.row_count(_read(spark, d, t)).select(F.lit(t).alias("table"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_add("row_counts", _counts, " union all ".join(f"select '{t}' as \"table\", count(*) as row_count from {t}" for t in _TABLES))
_add("numeric_stats_orders", _on("orders", lambda df: profile.numeric_stats(df, "o_totalprice")), _numeric_sql("o_totalprice", "orders"))
_WIDE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_add("numeric_stats_lineitem", _on("lineitem", lambda df: profile.wide_stats(df, _WIDE)), " union all ".join(_numeric_sql(c, "lineitem", f"'{c}' as \"column\",") for c in _WIDE))
_HOLED = "(select nullif(l_quantity, 10) as q, case when l_linenumber <> 3 then l_shipmode end as m from (select *, l_returnflag as l_shipmode from lineitem))"
_add("numeric_stats_with_nulls", _on("lineitem", lambda df: profile.numeric_stats(df.select(F.nullif("l_quantity", F.lit(10.0)).alias("q")), "q")), _numeric_sql("q", _HOLED))
_add("numeric_stats_empty", _on("orders", lambda df: profile.numeric_stats(df.where("o_orderkey < 0"), "o_totalprice")), _numeric_sql("o_totalprice", "(select * from orders where o_orderkey < 0)"))
_add("cardinality_guard_orders", _on("orders", lambda df: profile.cardinality(df, "o_orderpriority")), f"select count(distinct o_orderpriority) as distinct_count, cast({_NULLS.format(c='o_orderpriority')} as double) as null_rate from orders")


def _shares_sql(c: str, table: str) -> str:
    return f"select cast({c} as varchar) as value, count(*) * 100.0::double / sum(count(*)) over () as pct from {table} where {c} is not null group by {c}"


_add("categorical_orderstatus", _on("orders", lambda df: profile.categorical(df, "o_orderstatus")), _shares_sql("o_orderstatus", "orders"))
_add("categorical_with_nulls", _on("orders", lambda df: profile.categorical(df.select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")), "p")), _shares_sql("p", "(select nullif(o_orderpriority, '5-LOW') as p from orders)"))
_add("guard_lets_through", _on("part", lambda df: profile.guarded_categorical(df, "p_brand")), _shares_sql("p_brand", "part") + " having (select count(distinct p_brand) from part) <= 50")
_add("guard_holds_back", _on("part", lambda df: profile.guarded_categorical(df, "p_name")), _shares_sql("p_name", "part") + " having (select count(distinct p_name) from part) <= 50")
_add("boolean_rate_orders", _on("orders", lambda df: profile.boolean_stats(df.select((F.col("o_orderstatus") == "F").alias("f")), "f")), f"select count(*) filter (where f) * 100.0::double / count(*) as true_rate, cast({_NULLS.format(c='f')} as double) as null_rate from (select o_orderstatus = 'F' as f from orders)")
_STRING = "select count(distinct {c}) as cardinality, round(avg(length({c})), 6) as avg_length, cast(min(length({c})) as bigint) as min_length, cast(max(length({c})) as bigint) as max_length, cast({n} as double) as null_rate from {t}"
_add("string_stats_documents", _on("documents", lambda df: profile.string_stats(df, "text")), _STRING.format(c="text", n=_NULLS.format(c="text"), t="documents"))
_add("string_stats_customer", _on("customer", lambda df: profile.string_stats(df, "c_name")), _STRING.format(c="c_name", n=_NULLS.format(c="c_name"), t="customer"))
_add("timestamp_stats_events", _on("events", lambda df: profile.timestamp_stats(df, "ts")), f"select cast(min(ts) as varchar) as min_ts, cast(max(ts) as varchar) as max_ts, cast({_NULLS.format(c='ts')} as double) as null_rate, count(*) filter (where extract(dow from ts) between 1 and 5) * 100.0::double / count(ts) as weekday_ratio from events")
_add("monthly_density_orders", _on("orders", lambda df: profile.monthly_density(df, "o_orderdate")), "select strftime(date_trunc('month', o_orderdate), '%Y-%m') as month, count(*) as cnt from orders group by 1")
_add("hourly_density_events", _on("events", lambda df: profile.hourly_density(df, "ts")), "select extract(hour from ts)::int as hour, count(*) * 100.0::double / sum(count(*)) over () as pct from events group by 1")
_add("null_rates_wide", _on("lineitem", lambda df: df.select(F.nullif("l_quantity", F.lit(10.0)).alias("q"), F.nullif("l_returnflag", F.lit("R")).alias("f")).agg(profile.null_rate("q").alias("q_null"), profile.null_rate("f").alias("f_null"))), "select cast(count(*) filter (where l_quantity = 10) * 100.0::double / count(*) as double) as q_null, cast(count(*) filter (where l_returnflag = 'R') * 100.0::double / count(*) as double) as f_null from lineitem")
_PAIRS = {"customer_orders": ("customer", "c_custkey", "orders", "o_custkey"), "orders_lineitem": ("orders", "o_orderkey", "lineitem", "l_orderkey"), "part_lineitem": ("part", "p_partkey", "lineitem", "l_partkey"), "nation_customer": ("nation", "n_nationkey", "customer", "c_nationkey"), "region_nation": ("region", "r_regionkey", "nation", "n_regionkey")}
for _name, (_p, _pk, _c, _fk) in _PAIRS.items():
    _q = ", ".join(f"round(quantile_cont(cnt, {q}), 6) as {n}" for q, n in zip(profile.PERCENTILES, ("p25_ratio", "median_ratio", "p75_ratio", "p95_ratio", "p99_ratio"), strict=True))
    _add(f"parent_ratio_{_name}", lambda spark, d, c=_c, fk=_fk: profile.parent_ratio(_read(spark, d, c, fk), fk), f"select round(avg(cnt), 6) as avg_ratio, cast(min(cnt) as bigint) as min_ratio, cast(max(cnt) as bigint) as max_ratio, round(stddev_samp(cnt), 6) as stddev_ratio, {_q} from (select count(*)::double as cnt from {_c} group by {_fk})")
    _add(f"parent_zero_{_name}", lambda spark, d, p=_p, pk=_pk, c=_c, fk=_fk: profile.childless(_read(spark, d, p, pk), pk, _read(spark, d, c, fk), fk), f"select count(*) as zero_count, count(*) * 100.0::double / (select count(*) from {_p}) as zero_rate from {_p} where not exists (select 1 from {_c} where {_fk} = {_pk})")
_add("parent_ratio_null_key", _on("orders", lambda df: profile.parent_ratio(df.select(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("k")), "k")), f"select round(avg(cnt), 6) as avg_ratio, cast(min(cnt) as bigint) as min_ratio, cast(max(cnt) as bigint) as max_ratio, round(stddev_samp(cnt), 6) as stddev_ratio, {_q} from (select count(*)::double as cnt from orders group by case when o_custkey % 7 <> 0 then o_custkey end)")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The long profile of the relational tables."""
    out = None
    for t in ("customer", "supplier", "part", "orders", "lineitem"):
        one = profile.long_profile(_read(spark, d, t), t)
        out = one if out is None else out.unionByName(one)
    return out


_NUMBERS = {
    "customer": "c_custkey c_nationkey c_acctbal", "supplier": "s_suppkey s_nationkey s_acctbal", "part": "p_partkey p_size p_retailprice", "orders": "o_orderkey o_custkey o_totalprice",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax",
}
_LONG = [f"""select '{t}' as "table", '*' as "column", 'row_count' as stat, count(*)::double as "value" from {t}""" for t in _NUMBERS]
_LONG += [f"""select '{t}' as "table", '{c}' as "column", stat, "value" from (unpivot ({_numeric_sql(c, t)}) on columns(*) into name stat value "value")""" for t, cs in _NUMBERS.items() for c in cs.split()]
_add("long_profile", flagship, " union all ".join(_LONG))


# ---- audits

_add("unique_violations", _on("lineitem", lambda df: audit.duplicate_count(df, "l_orderkey", "l_linenumber")), "select cast(coalesce(sum(cnt - 1), 0) as bigint) as duplicate_rows, count(*) as duplicate_keys from (select count(*) as cnt from lineitem group by l_orderkey, l_linenumber having count(*) > 1)")
_add("duplicate_keys", _on("lineitem", lambda df: audit.duplicates(df, "l_orderkey", "l_linenumber")), "select l_orderkey, l_linenumber, count(*) as cnt from lineitem group by 1, 2 having count(*) > 1")
_add("check_violations", _on("part", lambda df: audit.violations(df, null_names=audit.is_null("p_name"), not_positive=audit.not_positive("p_size"), out_of_range=audit.out_of_range("p_size", 10, 40), too_long=audit.too_long("p_name", 12))), "select count(*) filter (where p_name is null) as null_names, count(*) filter (where not p_size > 0) as not_positive, count(*) filter (where not p_size between 10 and 40) as out_of_range, count(*) filter (where length(p_name) > 12) as too_long from part")
_add("parsed_check", _on("part", lambda df: audit.violations(df, bad=audit.parse_check("CHECK ((p_size >= 5) AND (p_size <= 45))")[1])), "select count(*) filter (where not p_size between 5 and 45) as bad from part")
_add("orphan_audit", lambda spark, d: audit.orphans(_read(spark, d, "lineitem", "l_orderkey").select((F.col("l_orderkey") * 3).alias("k")), "k", _read(spark, d, "orders", "o_orderkey"), "o_orderkey"), "select count(*) as orphans from (select l_orderkey * 3 as k from lineitem) where k is not null and not exists (select 1 from orders where o_orderkey = k)")
_add("temporal_audit", lambda spark, d: audit.before_parent(_read(spark, d, "lineitem", "l_orderkey", "l_shipdate"), "l_orderkey", "l_shipdate", _read(spark, d, "orders", "o_orderkey", "o_orderdate"), "o_orderkey", "o_orderdate"), "select count(*) as violations from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate")


# ---- catalog, classification

_add("catalog_tables", lambda spark, d: catalog.tables_frame(spark, catalog.introspect(spark, d)), "select table_name as \"table\", count(*) as n_columns from (" + " union all ".join(f"select '{t}' as table_name, column_name from (describe {t})" for t in _TABLES) + ") group by 1")
_KINDS = "case column_type when 'VARCHAR' then 'string' when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'FLOAT' then 'float' when 'FLOAT[]' then 'array<float>' when 'DOUBLE[]' then 'array<double>' when 'DATE' then 'date' when 'TINYINT' then 'tinyint' when 'SMALLINT' then 'smallint' when 'BOOLEAN' then 'boolean' when 'TIMESTAMP' then 'timestamp_ntz' when 'TIMESTAMP_NS' then 'timestamp_ntz' else column_type end"
_COLUMNS_SQL = " union all ".join(f"select '{t}' as \"table\", cast(row_number() over () - 1 as int) as position, column_name as \"column\", {_KINDS} as type, true as nullable from (describe {t})" for t in _TABLES)
_add("catalog_columns", lambda spark, d: catalog.columns_frame(spark, catalog.introspect(spark, d)), _COLUMNS_SQL)
_add("catalog_keys", lambda spark, d: catalog.keys_frame(spark, catalog.introspect(spark, d, catalog.DRIVER_KEYS)), "select * from (values " + ", ".join(f"('{k.table}', '{k.column}', '{k.parent}', '{k.parent_column}')" for k in catalog.DRIVER_KEYS) + ") t(\"table\", \"column\", parent, parent_column)")
_add("key_orphans", lambda spark, d: catalog.discover_keys(spark, d, catalog.introspect(spark, d, catalog.DRIVER_KEYS)), " union all ".join(f"select '{k.table}.{k.column}' as key, '{k.parent}.{k.parent_column}' as parent, count(*) as orphans from {k.table} c where not exists (select 1 from {k.parent} p where p.{k.parent_column} = c.{k.column})" for k in catalog.DRIVER_KEYS))
_DUPES = "select '{t}' as \"table\", '{k}' as kind, '{c}' as \"columns\", '' as rule, coalesce(sum(n - 1), 0)::bigint as violations from (select count(*) as n from {t} group by {c})"
_BREAKS = "select '{t}' as \"table\", '{k}' as kind, '{c}' as \"columns\", '{r}' as rule, count(*) filter (where {x}) as violations from {t}"


def _constraints_sql() -> str:
    parts = []
    for t, own in catalog.DRIVER_CONSTRAINTS.items():
        for c in own:
            names = ",".join(c.columns)
            parts.append(_BREAKS.format(t=t, k="check", c=names, r=c.text, x=f"not ({c.text})") if c.kind == "check" else _DUPES.format(t=t, k=c.kind, c=names))
    for name, labels in catalog.DRIVER_ENUMS.items():
        t, c = name.split(".")
        parts.append(_BREAKS.format(t=t, k="enum", c=c, r=",".join(labels), x=f"{c} not in ({', '.join(map(repr, labels))})"))
    return " union all ".join(parts)


_add("constraint_violations", lambda spark, d: catalog.constraints_frame(spark, d, catalog.introspect(spark, d, constraints=catalog.DRIVER_CONSTRAINTS, enums=catalog.DRIVER_ENUMS)), _constraints_sql())
_OPTIONS = profiler.Options(exclude_columns=("customer.c_acctbal",), sensitive_patterns=("phone", "comment", "_name"), include_columns=("nation.n_name",))
_add("column_treatment", lambda spark, d: catalog.treatments_frame(spark, catalog.introspect(spark, d, enums=catalog.DRIVER_ENUMS, generated=("orders.o_orderdate",)).filtered(exclude=("pages",)), lambda t, c: profiler.treatment(t, c, _OPTIONS)), f"""select "table", "column", case when "table" = 'orders' and "column" = 'o_orderdate' then 'generated' when "table" = 'customer' and "column" = 'c_acctbal' then 'excluded'
when regexp_matches("column", 'phone|comment|_name') and not ("table" = 'nation' and "column" = 'n_name') then 'sensitive' when "table" || '.' || "column" in ({', '.join(map(repr, catalog.DRIVER_ENUMS))}) then 'categorical'
when type in ('tinyint', 'smallint', 'int', 'bigint', 'float', 'double') then 'numeric' when type in ('date', 'timestamp_ntz') then 'timestamp' when type in ('string', 'boolean') then type else 'skip' end as treatment from ({_COLUMNS_SQL}) where "table" <> 'pages'""")


def _planned_counts(spark: SparkSession, d: str) -> DataFrame:
    known = {t: _read(spark, d, t).count() for t in ("region", "customer")}
    plan = scenario.parse({"tables": {"orders": {"count": "per_parent(customer, 1..4)"}, "events": {"count": "30% of orders"}, "labels": {"count": 12}, "lineitem": {"count": "per_parent(nowhere, 1..2)"}}}).with_counts(known)
    counts = plan.row_counts(("region", "customer", "orders", "events", "labels", "lineitem", "pages"), 7)
    return spark.createDataFrame(list(counts.items()), "`table` string, n_rows long")


_add("scenario_counts", _planned_counts, "with c as (select count(*) as n from customer) select 'region' as \"table\", (select count(*) from region) as n_rows union all select 'customer', n from c union all select 'orders', floor(n * 2.5 + 0.5)::bigint from c union all select 'events', floor(floor(n * 2.5 + 0.5) * 0.3 + 0.5)::bigint from c union all select * from (values ('labels', 12), ('lineitem', 7), ('pages', 7))")
_NAMED = "([a-z][a-z_]*)[^a-z]+([a-z]+)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Names to classify: all columns of the tables, and all names in texts with the length of the longest word after them."""
    found = lambda group: F.regexp_extract_all("text", F.lit(_NAMED), F.lit(group))
    pairs = _read(spark, d, "documents", "text").select(F.explode(F.arrays_zip(found(1).alias("name"), found(2).alias("word"))).alias("x"))
    columns = [(c,) for t in catalog.table_names(spark, d) for c in _read(spark, d, t).columns]
    named = pairs.select("x.name", F.length("x.word").alias("max_length")).unionByName(spark.createDataFrame(columns, "name string"), allowMissingColumns=True)
    return named.groupBy("name").agg(F.max("max_length").alias("max_length"))


_VALUES = f"(select name, max(n)::int as max_length from (select name, length(word) as n from (select unnest(regexp_extract_all(text, '{_NAMED}', 1)) as name, unnest(regexp_extract_all(text, '{_NAMED}', 2)) as word from documents)" + "".join(f" union all select column_name, null from (describe {t})" for t in _TABLES) + ") group by name)"
_add("sensitive_columns", lambda spark, d: _names(spark, d).select("name", classify.sensitive_column(F.col("name")).alias("sensitive")), f"select name, regexp_matches(lower(name), '{'|'.join(classify.SENSITIVE_PATTERNS)}') as sensitive from {_VALUES}")


def _rules_sql() -> str:
    when = []
    for generator, parts, how in classify.NAME_RULES:
        test = {"whole": "name = '{p}'", "part": "contains(name, '{p}')", "word": "list_contains(string_split(name, '_'), '{p}')", "short": f"contains(name, '{{p}}') and coalesce(max_length <= {classify.SHORT}, false)"}[how]
        when.append(f"when {' or '.join('(' + test.format(p=p) + ')' for p in parts)} then '{generator}'")
    return f"select name, case {' '.join(when)} end as generator from {_VALUES}"


_add("semantic_classifier", lambda spark, d: _names(spark, d).select("name", classify.classified(F.col("name"), F.col("max_length")).alias("generator")), _rules_sql())
_HASH = "sha256(list_aggregate(list_sort(list(t || ':' || cols || ';')), 'string_agg', ''))"
_add("source_hash", lambda spark, d: spark.createDataFrame([(profiler.source_hash(catalog.introspect(spark, d)),)], "source_hash string"), f"select {_HASH} as source_hash from (select t, string_agg(c, ',' order by c) as cols from (" + " union all ".join(f"select '{t}' as t, column_name as c from (describe {t})" for t in _TABLES) + ") group by t)")


# ---- generators

_IDS = "(select c_custkey as id from customer)"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    """The customers, for whom values are made."""
    return _read(spark, d, "customer", "c_custkey").withColumnRenamed("c_custkey", "id")


def _dealt(ids: DataFrame) -> DataFrame:
    """Dealt over all tasks: ids are a few bytes in one or few parts of a file, and what is made of one takes long."""
    return ids.repartition(max(16, 2 * ids.sparkSession.sparkContext.defaultParallelism))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _d(key: str, attempt: str = "0") -> str:
    return duck_draw(SEED, key, "id", attempt)


def _p(values, key: str, attempt: str = "0") -> str:
    return f"list_extract({_list(values)}, {_d(key, attempt)} % {len(values)} + 1)"


def _i(key: str, low: int, high: int) -> str:
    return f"({low} + {_d(key)} % {high - low + 1})"


def _r(key: str, low: float, high: float) -> str:
    return f"({float(low)}::double + {duck_unit(_d(key))} * {float(high - low)!r}::double)"


def _c(alphabet: str, n: int, key: str) -> str:
    return f"array_to_string(list_transform(range(1, {n + 1}), lambda k: substring('{alphabet}', ({duck_draw(SEED, key, 'id', 'k')} % {len(alphabet)} + 1)::int, 1)), '')"


_F, _L, _W = _p(pools.FIRST_NAMES, "g.first"), _p(pools.LAST_NAMES, "g.last"), _p(pools.WORDS, "g.word")
_WK = _p(pools.WORDS, "g.word", "{n} * 100 + k")
_SENT = "list_transform([array_to_string(list_transform(range(1, (6 + " + duck_draw(SEED, "g.length", "id", "{n}") + " % 8)::bigint), lambda k: " + _WK + "), ' ')], lambda s: upper(s[1]) || s[2:] || '.')[1]"
_HEX = duck_hex(SEED, "g", "id")
_T0 = "timestamp '2026-01-01 00:00:00'"
_GENERATOR_SQL = {
    "email": f"lower({_F} || '.' || {_L} || '@' || {_p(pools.DOMAINS, 'g.domain')})", "first_name": _F, "last_name": _L, "full_name": f"{_F} || ' ' || {_L}",
    "username": f"lower({_F}) || {_i('g.number', 10, 9999)}", "phone": f"'+1-' || {_i('g.area', 200, 999)} || '-' || {_i('g.exchange', 200, 999)} || '-' || lpad({_i('g.line', 0, 9999)}::varchar, 4, '0')",
    "url": f"'https://' || {_W} || '.' || {_p(pools.TLDS, 'g.tld')} || '/' || {_p(pools.PATHS, 'g.path')}", "password": f"'$2b$10$' || {_c(pools.BCRYPT, 53, 'g')}",
    "slug": " || '-' || ".join(_p(pools.WORDS, "g.word", str(k)) for k in range(3)), "sentence": _SENT.replace("{n}", "0"),
    "paragraph": "array_to_string(list_transform(range(1, (3 + " + _d("g.sentences") + " % 4)::bigint), lambda n: " + _SENT.replace("{n}", "n") + "), ' ')",
    "company": f"{_p(pools.COMPANY_BASES, 'g.base')} || ' ' || {_p(pools.COMPANY_KINDS, 'g.kind')}", "avatar_url": f"'https://avatars.example.com/' || {_i('g', 1, 9999)} || '.png'",
    "uuid": f"substring({_HEX}, 1, 8) || '-' || substring({_HEX}, 9, 4) || '-4' || substring({_HEX}, 14, 3) || '-' || {_p('89ab', 'g.variant')} || substring({_HEX}, 18, 3) || '-' || substring({_HEX}, 21, 12)",
    "token": _HEX, "sku": f"upper({_c(pools.LETTERS, 3, 'g.letters')}) || '-' || lpad({_i('g.digits', 0, 99999)}::varchar, 5, '0')", "money": f"round({_r('g', 0.01, 10000.0)}, 2)",
    "random_int": _i("g", 1, 10000), "random_float": _r("g", 0, 1000), "latitude": f"round({_r('g', -90, 90)}, 6)", "longitude": f"round({_r('g', -180, 180)}, 6)",
    "city": _p(pools.CITIES, "g.city"), "country": _p(pools.COUNTRIES, "g.country"), "country_code": _p(pools.COUNTRY_CODES, "g.country_code"), "postal_code": f"lpad({_i('g', 0, 99999)}::varchar, 5, '0')",
    "street_address": f"{_i('g.number', 1, 9999)} || ' ' || {_p(pools.STREETS, 'g.street')} || ' ' || {_p(pools.STREET_KINDS, 'g.kind')}",
    "datetime_past": f"{_T0} - to_seconds({_i('g', 0, 730 * 86400)})", "datetime_recent": f"{_T0} - to_seconds({_i('g', 0, 7 * 86400)})", "date_future": f"date '2026-01-01' + {_i('g', 0, 364)}::int",
    "ipv4": " || '.' || ".join(_i(f"g.{k}", *e) for k, e in enumerate(((1, 254), (0, 255), (0, 255), (1, 254)))), "bool": f"{duck_unit(_d('g'))} < 0.5",
    "hex_color": f"'#' || upper(substring({_HEX}, 1, 6))", "currency_code": _p(pools.CURRENCIES, "g.currency"), "random_string": _c(pools.ALPHANUMERIC, 16, "g"), "json_empty": "'{}'", "null": "null::varchar", "serial": "id + 1",
}


def _generated(name: str) -> Query:
    return lambda spark, d: _dealt(_ids(spark, d)).select("id", generators.GENERATORS[name](F.col("id"), SEED, "g").alias("value"))


for _name, _sql in _GENERATOR_SQL.items():
    _add(f"gen_{_name}", _generated(_name), f"select id, {_sql} as value from {_IDS}")
_LABELS = ("new", "open", "closed")
_add("gen_enum_pick", lambda spark, d: _ids(spark, d).select("id", generators.enum_pick(F.col("id"), SEED, "g", _LABELS).alias("value")), f"select id, {_p(_LABELS, 'g')} as value from {_IDS}")
_add("weighted_pick", lambda spark, d: _ids(spark, d).select("id", generators.weighted(F.col("id"), SEED, "g", {"paid": 60, "new": 15, "void": -3, "late": 5}).alias("value")), f"select id, case when {duck_unit(_d('g'))} * 80.0::double < 5 then 'late' when {duck_unit(_d('g'))} * 80.0::double < 20 then 'new' else 'paid' end as value from {_IDS}")
_add("typed_keys", lambda spark, d: _ids(spark, d).select("id", generators.weighted(F.col("id"), SEED, "g", {"1": 1, "5": 3}, "int").alias("value")), f"select id, case when {duck_unit(_d('g'))} * 4.0::double < 1 then 1 else 5 end::int as value from {_IDS}")
_add("range_override", lambda spark, d: _ids(spark, d).select("id", generators.ranged(F.col("id"), SEED, "g", 9, 3, "int").alias("whole"), generators.ranged(F.col("id"), SEED, "h", 0.5, 2.5).alias("real"), generators.ranged(F.col("id"), SEED, "t", 19000, 19100, "date").alias("day")), f"select id, (3 + {_d('g')} % 7)::int as whole, {_r('h', 0.5, 2.5)} as real, cast(to_timestamp((19000 * 86400 + {_d('t')} % (100 * 86400 + 1))::bigint) at time zone 'UTC' as date) as day from {_IDS}")
_add("null_mask", lambda spark, d: _ids(spark, d).select("id", generators.with_nulls(F.col("id"), F.col("id"), SEED, "g", 30.0).alias("value")), f"select id, case when {duck_unit(_d('g.null'))} * 100 >= 30 then id end as value from {_IDS}")
_add("unique_integers", lambda spark, d: _ids(spark, d).select(generators.unique_integer(F.col("id"), SEED, 100, 99 + _ids(spark, d).count()).alias("value")).distinct(), "select 99 + row_number() over () as value from customer")


# ---- foreign keys

_add("fk_assignment", lambda spark, d: relations.assign_parent(spark.range(5000), F.col("id"), _read(spark, d, "customer", "c_custkey"), "c_custkey", "cust", SEED), f"with k as (select c_custkey, row_number() over (order by c_custkey) - 1 as idx from customer) select id, c_custkey as cust from (select range as id, {duck_draw(SEED, 'cust.fk', 'range')} % (select count(*) from customer) as i from range(5000)) join k on i = idx")
_add("self_reference", lambda spark, d: relations.assign_earlier_self(_ids(spark, d).select((F.col("id") + 1).alias("id")), "id", "manager", SEED), f"select id, case when id > 1 then {duck_draw(SEED, 'manager.self', 'id')} % greatest(id - 1, 1) + 1 end as manager from (select c_custkey + 1 as id from customer)")
_add("deferred_fk", lambda spark, d: relations.deferred_update(_read(spark, d, "nation", "n_nationkey").withColumn("head", F.lit(None).cast("long")), "n_nationkey", _read(spark, d, "supplier", "s_suppkey"), "s_suppkey", "head", SEED), f"with k as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as idx from supplier) select n_nationkey, s_suppkey as head from nation join k on {duck_draw(SEED, 'head.fk', 'n_nationkey')} % (select count(*) from supplier) = idx")
_add("parent_lookup", lambda spark, d: relations.lookup_parent(_read(spark, d, "lineitem", "l_orderkey"), _read(spark, d, "orders"), "o_orderkey", "o_custkey"), "select o_orderkey as id, o_custkey as parent from lineitem join orders on l_orderkey = o_orderkey where o_custkey is not null")
_SUPPLIED = "(select l_suppkey as id, max(l_partkey)::double as value from lineitem group by 1)"
_add("update_from", lambda spark, d: relations.update_from(_read(spark, d, "supplier", "s_suppkey", "s_acctbal"), "s_suppkey", _read(spark, d, "lineitem", "l_suppkey", "l_partkey").groupBy(F.col("l_suppkey").alias("id")).agg(F.max("l_partkey").cast("double").alias("value")), "s_acctbal"), f"select s_suppkey, coalesce(value, s_acctbal) as s_acctbal from supplier left join {_SUPPLIED} on id = s_suppkey")
_add("cross_join", lambda spark, d: _read(spark, d, "region", "r_regionkey").crossJoin(spark.range(1, 6).withColumnRenamed("id", "g")), "select r_regionkey, range as g from region, range(1, 6)")


# ---- generation of whole tables

_PEOPLE = schema.SchemaGraph(
    (
        schema.Table("people", (schema.Column("id", types.LongType(), identity=True), schema.Column("boss_id", types.LongType()))),
        schema.Table("notes", (schema.Column("id", types.LongType(), identity=True), schema.Column("person_id", types.LongType()), schema.Column("status", types.StringType()), schema.Column("score", types.IntegerType()), schema.Column("price", types.DoubleType()), schema.Column("day", types.DateType()), schema.Column("twice", types.LongType()))),
    ),
    (schema.ForeignKey("people", "boss_id", "people", "id", nullable=True), schema.ForeignKey("notes", "person_id", "people", "id")),
)
_NOTES_PLAN = scenario.parse({"tables": {"people": {"count": 120}, "notes": {"count": "per_parent(people, 3..5)", "null_rates": {"price": 25}, "overrides": {
    "status": {"distribution": {"draft": "20%", "live": "80%"}}, "score": {"range": [1, 5]}, "price": {"range": [0.5, 2.5]}, "day": {"range": ["2024-01-01", "2024-03-01"]}, "twice": {"formula": "_row * 2"}}}}})
_CUSTOMERS = "(select count(*) from customer)"
_PERSON_ROWS, _NOTE_ROWS = ("(select row_number() over () - 1 as r from customer%s)" % x for x in ("", ", range(4)"))
_BOSS, _PERSON = duck_draw(SEED, "boss_id.self", "(r + 1)"), duck_draw(SEED, "person_id.fk", "concat('notes.person_id:', r)")
_STATUS, _SCORE, _PRICE, _HIDDEN, _DAY = (duck_draw(SEED, f"notes.{c}", "r") for c in ("status", "score", "price", "price.null", "day"))


def _people(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """As many people as customers, four notes a person."""
    return generate.generated(spark, _PEOPLE, _NOTES_PLAN.with_counts({"people": _ids(spark, d).count()}), SEED)


_add("generated_people", lambda spark, d: _people(spark, d)["people"], f"select r + 1 as id, case when r > 0 then {_BOSS} % greatest(r, 1) + 1 end as boss_id from {_PERSON_ROWS}")
_add("generated_notes", lambda spark, d: _people(spark, d)["notes"], f"""select r + 1 as id, {_PERSON} % {_CUSTOMERS} + 1 as person_id, case when {duck_unit(_STATUS)} * 100.0::double < 20 then 'draft' else 'live' end as status, (1 + {_SCORE} % 5)::int as score,
case when {duck_unit(_HIDDEN)} * 100 >= 25 then 0.5::double + {duck_unit(_PRICE)} * 2.0::double end as price, cast(to_timestamp((19723 * 86400 + {_DAY} % (60 * 86400 + 1))::bigint) at time zone 'UTC' as date) as day, r * 2 as twice from {_NOTE_ROWS}""")


# ---- sinks

_SINK = ("n_nationkey", "n_name", "n_regionkey")
_add("sql_literal_rows", lambda spark, d: sinks.value_rows(_read(spark, d, "nation", *_SINK).withColumn("n_name", F.concat("n_name", F.lit("'s")))), "select '(' || n_nationkey || ', ''' || replace(n_name || '''s', '''', '''''') || ''', ' || n_regionkey || ')' as \"values\" from nation")
_add("sql_literal_orders", lambda spark, d: sinks.value_rows(_read(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderdate").withColumn("paid", F.nullif((F.col("o_orderkey") % 3 == 0), F.lit(False)))), "select '(' || o_orderkey || ', ' || regexp_replace(regexp_replace(cast(cast(cast(o_totalprice as varchar) as decimal(38,10)) as varchar), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || ', ''' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ''', ' || case when o_orderkey % 3 = 0 then 'TRUE' else 'NULL' end || ')' as \"values\" from orders")
_INSERTS = """select 'INSERT INTO "customer" ("c_custkey", "c_name") VALUES' || chr(10) || string_agg('(' || c_custkey || ', ''' || c_name || ''')', ',' || chr(10) order by nth) || ';' as sql from (select *, row_number() over () - 1 as nth from customer) group by nth // 100"""
_add("insert_statements", lambda spark, d: sinks.insert_statements(_read(spark, d, "customer", "c_custkey", "c_name"), "customer", 100), _INSERTS)
_EXPORT = f"""select '{{"rows":[{{"row_count":' || (select count(*) from orders) || '}}],"status":' || (select cast(to_json(list({{'value': value, 'pct': round(pct, 6)}} order by value)) as varchar) from ({_shares_sql('o_orderstatus', 'orders')})) || '}}' as document"""
_add("offline_export", lambda spark, d: sinks.export_collection({"status": profile.categorical(_read(spark, d, "orders"), "o_orderstatus").withColumn("pct", F.round("pct", 6)), "rows": profile.row_count(_read(spark, d, "orders"))}), _EXPORT)


# ---- compliance

_HALF = "(select * from orders where o_orderkey % 2 = 0)"
_add("distribution_drift", _on("orders", lambda df: compliance.distribution_gap(profile.categorical(df, "o_orderpriority"), profile.categorical(df.where("o_orderkey % 2 = 0 and o_orderpriority <> '1-URGENT'"), "o_orderpriority"))), f"with e as ({_shares_sql('o_orderpriority', 'orders')}), a as ({_shares_sql('o_orderpriority', '(select * from orders where o_orderkey % 2 = 0 and o_orderpriority <> $$1-URGENT$$)')}) select round(max(abs(coalesce(e.pct, 0) - coalesce(a.pct, 0))), 6) as max_gap from e full outer join a using (value)")
_add("ratio_actual", lambda spark, d: compliance.rows_per_parent(_read(spark, d, "orders"), _read(spark, d, "customer")), "select (select count(*) from orders)::double / (select count(*) from customer) as ratio")


def _report(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = _read(spark, d, "orders"), _read(spark, d, "customer")
    half = orders.where("o_orderkey % 2 = 0")
    flag = lambda df: profile.boolean_stats(df.select((F.col("o_orderstatus") == "F").alias("f")), "f").select("true_rate")
    return compliance.report([
        compliance.check("orders:customer", "ratio", compliance.rows_per_parent(orders, customer), compliance.rows_per_parent(half, customer)),
        compliance.check("status true rate", "rate", flag(orders), flag(half)),
        compliance.check("status drift", "rate", spark.range(1).select(F.lit(0.0).alias("none")), compliance.distribution_gap(profile.categorical(orders, "o_orderstatus"), profile.categorical(half, "o_orderstatus"))),
    ])


_GAP = f"(with e as ({_shares_sql('o_orderstatus', 'orders')}), a as ({_shares_sql('o_orderstatus', _HALF)}) select max(abs(coalesce(e.pct, 0) - coalesce(a.pct, 0))) from e full outer join a using (value))"
_TRUE = "(select count(*) filter (where o_orderstatus = 'F') * 100.0::double / count(*) from {t})"
_REPORT = f"""with c as (
  select 'orders:customer' as "check", 'ratio' as kind, (select count(*) from orders)::double / (select count(*) from customer) as e, (select count(*) from {_HALF})::double / (select count(*) from customer) as a
  union all select 'status true rate', 'rate', {_TRUE.format(t='orders')}, {_TRUE.format(t=_HALF)}
  union all select 'status drift', 'rate', 0.0::double, {_GAP})
select "check", kind, round(e, 6) as expected, round(a, 6) as actual, case when kind = 'ratio' then abs(a - e) * 100 <= 5 * abs(e) else abs(a - e) <= 5 end as passed from c"""
_add("compliance_report", _report, _REPORT)
_add("compliance_summary", lambda spark, d: compliance.summary(_report(spark, d)), f"select count(*) filter (where passed) as passed, count(*) filter (where not passed) as failed from ({_REPORT})")


_PROFILE = {"tables": {
    "orders": {"columns": {"status": {"type": "categorical", "distribution": {"F": 48.0, "O": 40.0, "X": 1.0}, "null_rate": 2.0}, "big": {"type": "boolean", "true_rate": 50.0, "null_rate": 0.0}, "price": {"type": "numeric", "min": 0.0, "max": 1.0, "null_rate": 0.0}, "key": {"type": "serial"}}, "parent_ratios": {"customer.o_custkey": {"avg": 10.0, "zero_rate": 2.0}}},
    "customer": {"columns": {"c_acctbal": {"type": "numeric", "min": 0.0, "max": 1.0, "null_rate": 9.0}}},
}}
_HELD = "select o_orderkey as key, case when o_orderstatus <> 'P' then o_orderstatus end as status, o_totalprice > 100000 as big, o_totalprice as price from orders"
_RATE = "select '{k}' as \"check\", '{t}' as \"table\", '{c}' as subject, {e}::double as expected, coalesce(count(*) filter (where {x}) * 100.0::double / nullif(count(*), 0), 0) as actual from {q}"
_CHECKS = " union all ".join([
    _RATE.format(k="null_rate", t="orders", c="status", e=2, x="status is null", q=f"({_HELD})"), _RATE.format(k="null_rate", t="orders", c="big", e=0, x="big is null", q=f"({_HELD})"),
    _RATE.format(k="null_rate", t="orders", c="price", e=0, x="price is null", q=f"({_HELD})"), _RATE.format(k="true_rate", t="orders", c="big", e=50, x="big", q=f"({_HELD})"),
    _RATE.format(k="null_rate", t="customer", c="c_acctbal", e=9, x="c_acctbal is null", q="customer"),
    "select 'ratio', 'orders', 'customer.o_custkey', 9.8::double, (select count(*) from orders)::double / (select count(*) from customer)",
    f"select 'distribution', 'orders', 'status', 0.0::double, max(abs(coalesce(e, 0) - coalesce(pct, 0))) from ({_shares_sql('status', f'({_HELD})')}) full outer join (values ('F', 48.0::double), ('O', 40.0), ('X', 1.0)) v(value, e) using (value)",
])
_add("profile_compliance", lambda spark, d: compliance.profile_checks(_PROFILE, {"orders": _read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), (F.col("o_totalprice") > 100_000).alias("big"), F.col("o_totalprice").alias("price")), "customer": _read(spark, d, "customer")}), f"select \"check\", \"table\", subject, round(expected, 6) as expected, round(actual, 6) as actual, case when \"check\" = 'ratio' then abs(actual - expected) * 100 <= 5 * abs(expected) else abs(actual - expected) <= 5 end as passed from ({_CHECKS})")


# ---- lifecycle: six months from where the orders end; users s_curve at 0.4 from a twentieth of the customers to all, churn 0.1 after two

_BUCKETS = "(select k::int as b, (m + to_months(k::int))::date as b_start, (m + to_months(k::int + 1))::date as b_end from (select date_trunc('month', max(o_orderdate)) + interval 1 month as m from orders), range(6) r(k)) t(b, b_start, b_end)"
_START = f"(select min(b_start) from {_BUCKETS})"
_INITIAL = "(select greatest(count(*) // 20, 1) from customer)"
_MONTHLY = [round(0.6 + m * 5 % 12 / 10, 1) for m in range(12)]


def _bounds(spark: SparkSession, d: str) -> list[tuple[int, date, date]]:
    last = _read(spark, d, "orders", "o_orderdate").agg(F.max("o_orderdate")).first()[0]
    first = date(last.year + last.month // 12, last.month % 12 + 1, 1)
    return lifecycle.bucket_bounds(first, date(first.year + (first.month + 5) // 12, (first.month + 5) % 12 + 1, 1), "month")


def _months(spark: SparkSession, d: str) -> DataFrame:
    bounds = _bounds(spark, d)
    return lifecycle.buckets(spark, bounds[0][1], bounds[-1][2])


def _people_count(spark: SparkSession, d: str) -> tuple[int, int]:
    """Users at first, and at most."""
    n = _ids(spark, d).count()
    return max(n // 20, 1), n


def _from_day_31(spark: SparkSession, d: str) -> DataFrame:
    """Orders by buckets of a month that begin on the last day of the first order's month."""
    orders = _read(spark, d, "orders", "o_orderdate")
    ends = orders.agg(F.last_day(F.min("o_orderdate")).alias("s"), F.date_add(F.max("o_orderdate"), 1).alias("e")).first()
    placed = temporal.interval_join(orders.withColumn("at", F.col("o_orderdate").cast("timestamp_ntz")), "at", lifecycle.buckets(spark, ends.s, ends.e), "b_start", "b_end")
    return placed.groupBy("b", "b_start", "b_end", lifecycle.label(F.col("b_start")).alias("label")).agg(F.count(F.lit(1)).alias("orders"))


_add("buckets_from_day_31", _from_day_31, """with recursive t as (select 0 as b, s as b_start, (s + interval 1 month)::date as b_end, e from (select last_day(min(o_orderdate)) as s, max(o_orderdate)::date + 1 as e from orders)
union all select b + 1, b_end, (b_end + interval 1 month)::date, e from t where b_end < e)
select b, b_start, b_end, strftime(b_start, '%Y-%m') as label, count(*) as orders from t join orders on o_orderdate >= b_start and o_orderdate < b_end group by all""")


def _aged(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their month, counted from the first order's."""
    orders = _read(spark, d, "orders", "o_orderkey", "o_orderdate")
    first = orders.agg(F.min("o_orderdate")).first()[0]
    return orders.select(F.col("o_orderkey").alias("id"), ((F.year("o_orderdate") - first.year) * 12 + F.month("o_orderdate") - first.month).alias("b"))


_AGED = "(select o_orderkey as id, date_diff('month', (select min(o_orderdate) from orders), o_orderdate)::int as b from orders)"
_GROWTH = {
    "linear": (lambda: lifecycle.linear(F.col("b"), 10, 2.5), "cast(round(10 + 2.5 * b::double) as bigint)"),
    "exponential": (lambda: lifecycle.exponential(F.col("b"), 10, 0.04), "cast(round(10 * pow(1.04::double, b)) as bigint)"),
    "s_curve": (lambda: lifecycle.s_curve(F.col("b"), 10, 200, 0.4), "least(greatest(cast(round(200 / (1 + exp(-0.4::double * (b - ln(20.0::double) / 0.4)))) as bigint), case when b = 0 then 10 else 0 end), 200)"),
    "logistic": (lambda: lifecycle.logistic(F.col("b"), 10, 200, 0.9, 3), "least(greatest(cast(round(200 / (1 + exp(-0.9::double * (b - 3)))) as bigint), case when b = 0 then 10 else 0 end), 200)"),
    "custom": (lambda: lifecycle.custom(F.col("b"), [5, 0, 7]), "coalesce(list_extract([5, 0, 7], b + 1), 0)::bigint"),
}
for _name, (_make, _sql) in _GROWTH.items():
    _add(f"growth_{_name}", lambda spark, d, make=_make: _aged(spark, d).select("id", "b", make().alias("n")), f"select id, b, {_sql} as n from {_AGED}")
_REACHED = f"least(greatest(cast(round({_CUSTOMERS} / (1 + exp(-0.4::double * (b - ln({_CUSTOMERS}::double / {_INITIAL}) / 0.4)))) as bigint), case when b = 0 then {_INITIAL} else 0 end), {_CUSTOMERS})"
_NEW = f"(select b, b_start, b_end, greatest(n - lag(n, 1, 0) over (order by b), 0) as new from (select *, {_REACHED} as n from {_BUCKETS}))"


def _user_counts(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.new_counts(_months(spark, d), lifecycle.s_curve(F.col("b"), *_people_count(spark, d), 0.4))


def _users(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.churned(lifecycle.entities(_user_counts(spark, d), "users", SEED), _months(spark, d), "users", SEED, 0.1, 2)


_add("new_by_bucket", lambda spark, d: _user_counts(spark, d).select("b", "new"), f"select b, new from {_NEW}")
_add("seasonal_counts", lambda spark, d: lifecycle.new_counts(_months(spark, d), lifecycle.linear(F.col("b"), *[_ids(spark, d).count()] * 2), factor=lifecycle.season(F.col("b_start"), monthly=_MONTHLY)).select("b", "new"), f"select b, cast(floor({_CUSTOMERS} * list_extract({_MONTHLY}, month(b_start))::double + 0.5) as bigint) as new from {_BUCKETS}")
_SPAN = "(date_diff('day', b_start, b_end) * 86400)"
_ENTITIES = f"(select first + k as id, b as created_b, b_start::timestamp + to_seconds({duck_draw(SEED, 'users.created_at', '(first + k)')} % {_SPAN}) as created_at from (select *, coalesce(sum(new) over (order by b rows between unbounded preceding and 1 preceding), 0)::bigint as first from {_NEW}), unnest(range(1, new + 1)) u(k))"
_CHURN = f"(select e.id, e.created_b, e.created_at, t.b as churn_b, t.b_start::timestamp + to_seconds({duck_draw(SEED, 'users.churned_at', 'e.id')} % {_SPAN}) as churned_at from (select *, created_b + 2 + floor(ln(1 - {duck_unit(duck_draw(SEED, 'users.churn', 'id'))}) / ln(0.9::double))::int as cb from {_ENTITIES}) e left join {_BUCKETS} on t.b = e.cb)"
_add("entity_rows", lambda spark, d: lifecycle.entities(_user_counts(spark, d), "users", SEED), f"select * from {_ENTITIES}")
_add("churn_events", lambda spark, d: _users(spark, d), f"select * from {_CHURN}")
_ACTIVE = f"(select b, born, churned, (sum(born) over (order by b) - sum(churned) over (order by b))::bigint as active, (sum(born) over (order by b))::bigint as total from (select t.b, (select count(*) from {_CHURN} where created_b = t.b) as born, (select count(*) from {_CHURN} where churn_b = t.b) as churned from {_BUCKETS}))"
_add("active_by_bucket", lambda spark, d: lifecycle.active_counts(_users(spark, d), _months(spark, d)), f"select * from {_ACTIVE}")
_PAIRS_SQL = f"(select unnest(range(created_b, least(coalesce(churn_b - 1, 5), 5) + 1))::int as b, id from {_CHURN})"
_add("active_pairs", lambda spark, d: lifecycle.active_pairs(_users(spark, d), 5), f"select b, id from {_PAIRS_SQL}")
_add("follows_ratio", lambda spark, d: lifecycle.follow_ratio(lifecycle.active_counts(_users(spark, d), _months(spark, d)), "orders", SEED, 2.6, 0.5), f"select b, cast(floor(active * 2.6::double * (1 + (2 * {duck_unit(duck_draw(SEED, 'orders.variance', 'b'))} - 1) * 0.5::double) + 0.5) as bigint) as new from {_ACTIVE}")
_add("follows_per_parent", lambda spark, d: lifecycle.follow_per_parent(lifecycle.active_pairs(_users(spark, d), 5), "items", SEED, 1, 3), f"select b, sum(1 + {duck_draw(SEED, 'items.children', chr(40) + 'id || chr(58) || b)')} % 3)::bigint as new from {_PAIRS_SQL} group by b")
_FRAMES = [(date(1997, 3, 5), "day", 64.0), (date(1997, 3, 5), "week", 36.0), (date(1999, 8, 20), "day", 10.0), (date(1999, 8, 20), "week", 58.0), (date(1999, 8, 20), "year", 32.0)]
_FRAMES_SQL = "(values " + ", ".join(f"(date '{a}', '{k}', {w}::double)" for a, k, w in _FRAMES) + ") f(on_day, key, weight)"


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    frames = spark.createDataFrame(_FRAMES, "at date, key string, weight double")
    dates = _read(spark, d, "orders", "o_orderdate").select(F.to_date("o_orderdate").alias("d"))
    return lifecycle.interpolated(frames, dates)


_add("timeline_interpolation", _timeline, f"""with d as (select distinct o_orderdate::date as d from orders),
r as (select d, (select max(on_day) from {_FRAMES_SQL} where on_day <= d) as lo, (select min(on_day) from {_FRAMES_SQL} where on_day >= d) as hi from d),
s as (select d, coalesce(lo, hi) as lo, coalesce(hi, lo) as hi from r),
k as (select distinct s.d, s.lo, s.hi, f.key from s join {_FRAMES_SQL} on f.on_day = s.lo or f.on_day = s.hi),
w as (select k.*, coalesce((select weight from {_FRAMES_SQL} where f.on_day = k.lo and f.key = k.key), 0) as wa, coalesce((select weight from {_FRAMES_SQL} where f.on_day = k.hi and f.key = k.key), 0) as wb from k)
select d, key, round(wa + (wb - wa) * case when lo = hi then 0 else date_diff('day', lo, d)::double / date_diff('day', lo, hi) end, 6) as weight from w""")


def _clamped(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    rows = _read(spark, d, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("born"))
    ts = lifecycle.relative_time(F.col("born"), draw(SEED, "offset", i), "after", 86_400, 60 * 86_400)
    return rows.select("id", lifecycle.clamped(ts, F.col("born"), F.lit("1998-03-01").cast("date"), F.lit("1998-04-01").cast("date")).alias("at"))


_BORN = "(select o_orderkey as id, o_orderdate as born from orders)"
_add("temporal_after_clamped", _clamped, f"select id, least(greatest(born + to_seconds(86400 + {duck_draw(SEED, 'offset', 'id')} % {59 * 86_400 + 1}), greatest(born, timestamp '1998-03-01')), greatest(timestamp '1998-03-31 23:59:59', greatest(born, timestamp '1998-03-01'))) as at from {_BORN}")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    users, months = _users(spark, d), _months(spark, d)
    active = lifecycle.active_counts(users, months)
    return lifecycle.children(lifecycle.follow_ratio(active, "orders", SEED, 2.0), lifecycle.active_pairs(users, 5), users, months, "orders", SEED, "after", 86_400, 60 * 86_400)


def _children_sql(parents: str, counts: str, name: str, parent_key: str, offset_key: str, low: int, high: int) -> str:
    """id, created_b, parent_id, created_at: parents (id, created_b, created_at, churn_b) drawn among those active in a bucket."""
    born = f"(select first + k as id, b as created_b, b_start, b_end from (select c.b, new, b_start, b_end, coalesce(sum(new) over (order by c.b rows between unbounded preceding and 1 preceding), 0)::bigint as first from {counts} c join {_BUCKETS} on t.b = c.b), unnest(range(1, new + 1)) u(k))"
    pool = f"(select b, id as parent_id, row_number() over (partition by b order by id) - 1 as n, count(*) over (partition by b) as size from (select unnest(range(created_b, least(coalesce(churn_b - 1, 5), 5) + 1))::int as b, id from {parents}))"
    lower = "greatest(p.created_at, c.b_start::timestamp)"
    upper = "c.b_end::timestamp - to_seconds(1)"
    ts = f"p.created_at + to_seconds({low} + {duck_draw(SEED, offset_key, 'c.id')} % {high - low + 1})"
    return f"(select c.id, c.created_b, m.parent_id, least(greatest({ts}, {lower}), greatest({upper}, {lower})) as created_at from {born} c join {pool} m on m.b = c.created_b and m.n = {duck_draw(SEED, parent_key, 'c.id')} % m.size join {parents} p on p.id = m.parent_id)"


_TWICE = f"(select b, cast(floor(active * 2.0::double + 0.5) as bigint) as new from {_ACTIVE})"
_add("lifecycle_children", _orders, f"select * from {_children_sql(_CHURN, _TWICE, 'orders', 'orders.parent', 'orders.offset', 86_400, 60 * 86_400)}")


# ---- lifecycle, whole tables: users as above, two orders a month for each active user, items at their order's time

_ID = schema.Column("id", types.LongType(), identity=True)
_SHOP = schema.SchemaGraph(
    (
        schema.Table("users", (_ID, schema.Column("plan", types.StringType()), schema.Column("is_active", types.BooleanType()), schema.Column("created_at", types.TimestampNTZType()), schema.Column("churned_at", types.TimestampNTZType()))),
        schema.Table("orders", (_ID, schema.Column("user_id", types.LongType()), schema.Column("created_at", types.TimestampNTZType()))),
        schema.Table("items", (_ID, schema.Column("order_id", types.LongType()), schema.Column("created_at", types.TimestampNTZType()))),
    ),
    (schema.ForeignKey("orders", "user_id", "users", "id"), schema.ForeignKey("items", "order_id", "orders", "id")),
)


def _grown(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    bounds, (initial, capacity) = _bounds(spark, d), _people_count(spark, d)
    plan = scenario.parse({"lifecycle": {"start": str(bounds[0][1]), "end": str(bounds[-1][2]), "bucket": "month"}, "tables": {
        "users": {"growth": {"model": "s_curve", "initial": initial, "capacity": capacity, "rate": 0.4}, "churn": {"rate": 0.1, "grace_period": 2}, "overrides": {"plan": {"timeline": {str(bounds[0][1]): {"basic": 66, "gold": 34}, str(bounds[4][1]): {"basic": 30, "gold": 42, "trial": 28}}}}},
        "orders": {"growth": {"follows": "users", "ratio": 2.0}, "temporal": {"created_at": {"after": "users.created_at", "offset": "1d..60d"}}},
        "items": {"growth": {"follows": "orders", "ratio": 1.5}, "temporal": {"created_at": {"equals": "orders.created_at"}}},
    }})
    return grow.grown(spark, _SHOP, plan, SEED)


_ORDERS_SQL = _children_sql(_CHURN, _TWICE, "orders", "orders.user_id.parent", "orders.created_at.offset", 86_400, 60 * 86_400)
_WEIGHTS = f"(select b, least(date_diff('day', {_START}, b_start)::double / date_diff('day', {_START}, ({_START} + interval 4 month)::date), 1) as s from {_BUCKETS})"
_PLANS = f"(select b, round(66 - 36 * s, 6) as basic, round(34 + 8 * s, 6) as gold, round(28 * s, 6) as trial from {_WEIGHTS})"
_PICK = duck_unit(duck_draw(SEED, "users.plan", "id"))
_add("lifecycle_users", lambda spark, d: _grown(spark, d)["users"], f"select id, case when {_PICK} * (basic + gold + trial) < basic then 'basic' when {_PICK} * (basic + gold + trial) < basic + gold then 'gold' else 'trial' end as plan, churn_b is null as is_active, created_at, churned_at from {_CHURN} join {_PLANS} on b = created_b")
_add("lifecycle_orders", lambda spark, d: _grown(spark, d)["orders"], f"select id, parent_id as user_id, created_at from {_ORDERS_SQL}")
_PLACED = f"(select *, null::int as churn_b from {_ORDERS_SQL})"
_ITEMS = f"(select b, cast(floor(active * 1.5::double + 0.5) as bigint) as new from (select t.b, (select count(*) from {_ORDERS_SQL} where created_b <= t.b) as active from {_BUCKETS}))"
_ITEMS_SQL = _children_sql(_PLACED, _ITEMS, "items", "items.order_id.parent", "none", 0, 0)
_add("lifecycle_items", lambda spark, d: _grown(spark, d)["items"], f"select i.id, i.parent_id as order_id, o.created_at from {_ITEMS_SQL} i join {_ORDERS_SQL} o on o.id = i.parent_id")


def _early(spark: SparkSession, d: str) -> DataFrame:
    frames = _grown(spark, d)
    early = audit.before_parent(frames["orders"], "user_id", "created_at", frames["users"].withColumnRenamed("created_at", "born"), "id", "born")
    return early.join(audit.orphans(frames["items"], "order_id", frames["orders"], "id"))


_add("lifecycle_order", _early, f"select (select count(*) from {_ORDERS_SQL} c join {_CHURN} p on p.id = c.parent_id where c.created_at < p.created_at) as violations, 0::bigint as orphans")
_add("simulate_plan", lambda spark, d: lifecycle.active_counts(_users(spark, d), _months(spark, d)).join(F.broadcast(_months(spark, d)), "b").select(lifecycle.label(F.col("b_start")).alias("label"), F.col("born").alias("new"), "churned", "active", "total"), f"select strftime(b_start, '%Y-%m') as label, born as new, churned, active, total from {_ACTIVE} join {_BUCKETS} using (b)")
_add("stream_density_batch", lambda spark, d: _density(spark, d), "select date_trunc('hour', ts) as start, count(*) as cnt from events group by 1")


def _density(spark: SparkSession, d: str) -> DataFrame:
    from millrace.streaming.density import hourly_counts

    return hourly_counts(_read(spark, d, "events", "ts")).select(F.col("start").cast("timestamp_ntz").alias("start"), "cnt")


QUERIES |= table_queries.QUERIES
ORACLES |= table_queries.ORACLES


def million(spark: SparkSession) -> DataFrame:
    """One million five-column users, reduced to one row: the bulk rate of the generators."""
    i = F.col("id")
    with bulk():
        columns = [generators.email(i, SEED, "email"), generators.full_name(i, SEED, "name"), generators.sentence(i, SEED, "bio"), generators.boolean(i, SEED, "active"), generators.datetime_past(i, SEED, "created")]
    users = spark.range(1_000_000).select(F.hash(*columns).alias("h"))
    return users.agg(F.sum(F.col("h").cast("long")).alias("checksum"), F.count(F.lit(1)).alias("rows"))
