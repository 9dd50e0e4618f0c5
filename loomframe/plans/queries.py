"""The library's operators as queries over the driver's tables, each with the SQL that gives the same rows.

Doubles that depend on the order of addition are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import loomframe as lf
from loomframe.operators import columns as cols
from loomframe.operators import impute, lineage
from loomframe.sources import synthetic as made

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _round(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema])


# ---- flagship


@query("""
WITH li AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1)
SELECT c_mktsegment, round(sum(li.revenue), 2) AS revenue, count(li.revenue) AS orders
FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1""")
def flagship(t):
    lines = lf.transform("@calc", t("lineitem"), expression="l_extendedprice * (1 - l_discount)", name="revenue").select(F.col("l_orderkey").alias("o_orderkey"), "revenue")
    orders = lf.to(t("orders"), lines, "revenue", "o_orderkey", strategy={"revenue": "sum"})
    customers = t("customer").withColumnRenamed("c_custkey", "o_custkey")
    orders = lf.to(orders, customers, "c_mktsegment", "o_custkey")
    out = lf.transform("@aggregate", orders, by="c_mktsegment", strategy={"revenue": ("revenue", "sum"), "orders": ("revenue", "count")})
    return lf.transform("@sort", _round(out, 2), by="c_mktsegment")


# ---- calculation and formulas


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS result FROM lineitem")
def calc_arith(t):
    return lf.transform("@calc", t("lineitem"), expression="l_extendedprice * (1 - l_discount)").select("l_orderkey", "l_linenumber", "result")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 7) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS gross FROM lineitem")
def calc_multi(t):
    return _round(lf.transform("@calc", t("lineitem"), strategy={"net": "l_extendedprice * (1 - l_discount)", "gross": "net * (1 + l_tax)"}).select("l_orderkey", "l_linenumber", "net", "gross"), 7)


@query("SELECT p_partkey, power(p_size::DOUBLE, power(2.0, 2.0)) AS a, -power(p_size::DOUBLE, 2.0) AS b, (p_size + 2.0) * 3.0 AS c FROM part")
def calc_pow_prec(t):
    return lf.transform("@calc", t("part"), expression=["p_size ** 2 ** 2", "-p_size ** 2", "(p_size + 2) * 3"], name=["a", "b", "c"]).select("p_partkey", "a", "b", "c")


@query("SELECT p_partkey, p_size::DOUBLE % 7.0 AS m, p_size::DOUBLE / nullif((p_size % 5)::DOUBLE, 0) AS d FROM part")
def calc_mod(t):
    return lf.transform("@calc", t("part"), strategy={"m": "p_size % 7", "d": "p_size / (p_size % 5)"}).select("p_partkey", "m", "d")


@query("SELECT n_nationkey, n_name || '-' || n_regionkey::VARCHAR AS tag, CASE WHEN n_regionkey < 2 THEN 'low' ELSE 'high' END AS kind FROM nation")
def calc_strings(t):
    return lf.transform("@calc", t("nation"), strategy={"tag": "n_name + '-' + n_regionkey", "kind": "if_else(n_regionkey < 2, 'low', 'high')"}).select("n_nationkey", "tag", "kind")


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS a, floor(p_retailprice) AS b, ceil(p_retailprice) AS c, greatest(p_size::DOUBLE, 20.0) AS d, round(ln(p_retailprice), 6) AS e, abs(p_size - 25.0) AS f FROM part")
def calc_functions(t):
    return _round(lf.transform("@calc", t("part"), strategy={"a": "sqrt(p_retailprice)", "b": "floor(p_retailprice)", "c": "ceil(p_retailprice)", "d": "max(p_size, 20)", "e": "log(p_retailprice)", "f": "abs(p_size - 25)"}).select("p_partkey", *"abcdef"), 6)


@query("SELECT p_partkey, round((p_retailprice - p_size) / p_retailprice * 100, 6) AS profit_margin_pct FROM part")
def formula_profit_margin(t):
    return _round(lf.formulas.profit_margin_pct(t("part"), revenue="p_retailprice", cost="p_size").select("p_partkey", "profit_margin_pct"), 6)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * 0.123456789 * power(1 + l_tax, l_quantity), 4) AS compound_interest FROM lineitem")
def formula_compound_interest(t):
    return _round(lf.formulas.compound_interest(t("lineitem").withColumn("lent", F.col("l_extendedprice") * 0.123456789), principal="lent", rate="l_tax", periods="l_quantity").select("l_orderkey", "l_linenumber", "compound_interest"), 4)


@query("SELECT p_partkey, CASE WHEN p_size < 18.5 THEN 'underweight' WHEN p_size < 25 THEN 'normal' WHEN p_size < 30 THEN 'overweight' ELSE 'obese' END AS bmi_category FROM part")
def formula_bmi_category(t):
    return lf.formulas.bmi_category(t("part"), bmi="p_size").select("p_partkey", "bmi_category")


@query("SELECT p_partkey, round(0.007184 * power(p_retailprice, 0.725) * power(p_size, 0.425), 6) AS bsa_dubois, round(p_retailprice / power(p_size, 2), 6) AS bmi, round((p_retailprice + 2 * p_size) / 3, 6) AS mean_pressure FROM part")
def formula_medical(t):
    df = lf.formulas.bsa_dubois(t("part"), height="p_retailprice", weight="p_size")
    df = lf.formulas.bmi(df, weight="p_retailprice", height="p_size")
    return _round(lf.formulas.map(df, output="mean_pressure", systolic="p_retailprice", diastolic="p_size").select("p_partkey", "bsa_dubois", "bmi", "mean_pressure"), 6)


# ---- filter, rows, sort


@query("SELECT * FROM orders WHERE o_totalprice >= 200000")
def filter_ge(t):
    return lf.transform("@filter", t("orders"), where="o_totalprice >= 200000")


@query("SELECT * FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'F') OR NOT o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_compound(t):
    return lf.transform("@filter", t("orders"), where="(o_totalprice > 100000 and o_orderstatus = 'F') or not o_orderpriority in ('1-URGENT', '2-HIGH')")


@query("SELECT event_id, user_id FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) WHERE v IS NULL")
def filter_null(t):
    return lf.transform("@filter", _gaps(t), ["event_id", "user_id"], where="v is null")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal <> 0")
def filter_project(t):
    return lf.transform("@filter", t("customer"), ["c_custkey", "c_name"], where="c_mktsegment == 'BUILDING' and c_acctbal != 0")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ASC)::INTEGER AS rank FROM orders")
def sort_multi_rank(t):
    return cols.ranked(t("orders"), ["o_orderdate", "o_orderkey"], ["desc", "asc"], within=["o_custkey"]).select("o_orderkey", "rank")


@query("SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def sort_top(t):
    return lf.transform("@sort", t("customer"), by=["c_acctbal", "c_custkey"], order=["desc", "asc"]).limit(100)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n BETWEEN 25 AND 50")
def rows_range(t):
    return cols.rows(t("orders"), "25-50", "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def rows_last(t):
    return cols.rows(t("orders"), "last:5", "o_orderkey").select("o_orderkey")


@query("SELECT n_regionkey, n_name, n_nationkey FROM nation")
def position_start(t):
    from loomframe.operators.positions import place

    return place(place(t("nation"), ["n_regionkey"], "start"), ["n_name"], "before:n_nationkey")


# ---- aggregate

for _name, _sql in {
    "sum": "round(sum(l_extendedprice), 2)", "mean": "round(avg(l_extendedprice), 4)", "median": "round(median(l_extendedprice), 4)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)",
    "count": "count(l_extendedprice)", "std": "round(stddev_samp(l_extendedprice), 4)", "var": "round(var_samp(l_extendedprice), 1)", "unique_count": "count(DISTINCT l_extendedprice)",
}.items():

    def _one(t, mode=_name):
        digits = {"sum": 2, "var": 1}.get(mode, 4)
        return _round(lf.transform("@aggregate", t("lineitem"), by=["l_returnflag", "l_linestatus"], strategy={"x": ("l_extendedprice", mode)}), digits)

    _one.__name__ = f"agg_{_name}"
    query(f"SELECT l_returnflag, l_linestatus, {_sql} AS x FROM lineitem GROUP BY 1, 2")(_one)


@query("""
WITH n AS (SELECT o_orderstatus, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, arg_min(v, row(-n, v)) AS often, arg_min(v, row(n, v)) AS rarely FROM n GROUP BY 1""")
def agg_mode(t):
    return lf.transform("@aggregate", t("orders"), by="o_orderstatus", strategy={"often": ("o_orderpriority", "most_common"), "rarely": ("o_orderpriority", "least_common")})


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names, arg_min(n_name, n_nationkey) AS first, arg_max(n_name, n_nationkey) AS last FROM nation GROUP BY 1")
def agg_concat(t):
    return lf.transform("@aggregate", t("nation"), by="n_regionkey", strategy={"names": ("n_name", "concat[, ]"), "first": ("n_name", "first"), "last": ("n_name", "last")}, order_by="n_nationkey")


@query("SELECT c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal_sum, round(avg(c_acctbal), 2) AS c_acctbal_mean FROM customer GROUP BY 1")
def agg_several(t):
    return _round(lf.transform("@aggregate", t("customer"), by="c_mktsegment", strategy={"c_acctbal": "sum,mean"}), 2)


# ---- lookup, joins, merge


@query("SELECT o.*, c.c_name AS customer, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def lookup_many_to_one(t):
    return lf.to(t("orders"), t("customer").withColumnRenamed("c_custkey", "o_custkey"), [("c_name", "customer"), "c_mktsegment"], "o_custkey")


for _name, _sql in {
    "sum": "round(sum(o_totalprice), 2)", "count": "count(*)", "mean": "round(avg(o_totalprice), 4)", "min": "min(o_totalprice)", "max": "max(o_totalprice)", "median": "round(median(o_totalprice), 4)", "std": "round(stddev_samp(o_totalprice), 4)",
    "first": "arg_min(o_totalprice, o_orderkey)", "last": "arg_max(o_totalprice, o_orderkey)", "shortest": "arg_min(o_orderpriority, row(strlen(o_orderpriority), o_orderkey))", "longest": "arg_min(o_orderpriority, row(-strlen(o_orderpriority), o_orderkey))",
    "most_common": "arg_min(o_orderpriority, row(-(SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderpriority = o.o_orderpriority), o_orderpriority))",
    "concat[|]": "string_agg(o_orderstatus, '|' ORDER BY o_orderkey)", "unique_count": "count(DISTINCT o_orderpriority)", "forward_fill": "arg_min(o_totalprice, o_orderkey)", "backward_fill": "arg_max(o_totalprice, o_orderkey)",
}.items():

    def _one(t, mode=_name):
        column = {"shortest": "o_orderpriority", "longest": "o_orderpriority", "most_common": "o_orderpriority", "unique_count": "o_orderpriority", "concat[|]": "o_orderstatus"}.get(mode, "o_totalprice")
        out = lf.to(t("customer").select(F.col("c_custkey").alias("o_custkey")), t("orders"), [(column, "x")], "o_custkey", strategy={column: mode}, order_by="o_orderkey")
        return _round(out, 2 if mode == "sum" else 4)

    _one.__name__ = f"lookup_agg_{_name.partition('[')[0]}"
    if _name == "most_common":
        _text = """WITH n AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT o_custkey, arg_min(v, row(-n, v)) AS x FROM n GROUP BY 1)"""
    else:
        _text = f"WITH r AS (SELECT o_custkey, {_sql} AS x FROM orders o GROUP BY 1)"
    query(_text + " SELECT c.c_custkey AS o_custkey, r.x FROM customer c LEFT JOIN r ON c.c_custkey = r.o_custkey")(_one)


@query("""
WITH a AS (SELECT o_custkey, o_orderstatus, count(*) AS orders FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey, o_orderstatus, max(o_totalprice) AS most FROM orders WHERE o_totalprice > 100000 GROUP BY 1, 2)
SELECT a.*, b.most FROM a LEFT JOIN b USING (o_custkey, o_orderstatus)""")
def lookup_composite(t):
    orders = t("orders")
    a = orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))
    b = orders.where("o_totalprice > 100000").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("most"))
    return lf.to(a, b, "most", ["o_custkey", "o_orderstatus"])


for _how, _sql in {"left": "LEFT", "inner": "INNER", "outer": "FULL", "right": "RIGHT"}.items():

    def _one(t, how=_how):
        busy = t("customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
        some = t("nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
        return lf.to(some, busy, "customers", "n_nationkey", join_type=how)

    _one.__name__ = f"join_{_how}_1to1"
    query(f"""SELECT n_nationkey, n_name, customers FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20)
    {_sql} JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS customers FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) USING (n_nationkey)""")(_one)


@query("SELECT s_suppkey, n.n_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey")
def lookup_multi_ref(t):
    nations = t("nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return lf.to(t("supplier"), [nations.where("s_nationkey < 10"), nations.where("s_nationkey >= 10")], "n_name", "s_nationkey").select("s_suppkey", "n_name")


@query("SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')")
def merge_vertical(t):
    return lf.merge([t("orders").where("o_orderstatus = 'F'"), t("orders").where("o_orderstatus = 'O'")], "v")


@query("SELECT n_nationkey, n_name, NULL::INTEGER AS r_regionkey FROM nation UNION ALL SELECT NULL, NULL, r_regionkey FROM region")
def merge_diagonal(t):
    return lf.merge([t("nation").select("n_nationkey", "n_name"), t("region").select("r_regionkey")], "diagonal")


@query("SELECT n_regionkey, n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def merge_horizontal(t):
    return lf.merge([t("nation"), t("region").withColumnRenamed("r_regionkey", "n_regionkey")], "horizontal", by="n_regionkey")


@query("""
WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1)
SELECT (SELECT sum(n) FROM a)::BIGINT AS target_rows, (SELECT count(*) FROM a) AS target_keys, (SELECT count(*) FROM a WHERE n > 1) AS target_repeated,
       (SELECT sum(n) FROM b)::BIGINT AS reference_rows, (SELECT count(*) FROM b) AS reference_keys, (SELECT count(*) FROM b WHERE n > 1) AS reference_repeated,
       (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS missing_in_reference, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS missing_in_target, 'many:1' AS cardinality""")
def lookup_key_report(t):
    return lf.key_report(t("orders"), t("customer").where("c_nationkey < 20").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def join_anti(t):
    from loomframe.operators.lookup import matched

    some = t("customer").where("c_nationkey < 20").withColumnRenamed("c_custkey", "o_custkey")
    return matched(t("orders").select("o_orderkey", "o_custkey"), some, ["o_custkey"], False)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(t):
    from loomframe.operators.lookup import matched

    return matched(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), t("orders"), ["o_custkey"]).withColumnRenamed("o_custkey", "c_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def lookup_repeated_keys(t):
    from loomframe.operators.aggregate import repeated_keys

    return repeated_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT s_suppkey, s_nationkey, r.x FROM supplier LEFT JOIN (SELECT c_nationkey, min(c_nationkey % 5) AS x FROM customer GROUP BY 1) r ON s_nationkey = c_nationkey")
def lookup_agg_auto(t):
    ref = t("customer").select(F.col("c_nationkey").alias("s_nationkey"), (F.col("c_nationkey") % 5).alias("x"))
    return lf.to(t("supplier").select("s_suppkey", "s_nationkey"), ref, "x", "s_nationkey", strategy={"x": "auto"})


@query("WITH n AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT o_custkey, arg_min(v, row(n, v)) AS x FROM n GROUP BY 1) SELECT c_custkey AS o_custkey, x FROM customer LEFT JOIN r ON c_custkey = o_custkey")
def lookup_agg_least_common(t):
    return lf.to(t("customer").select(F.col("c_custkey").alias("o_custkey")), t("orders"), [("o_orderpriority", "x")], "o_custkey", strategy={"o_orderpriority": "least_common"})


@query("SELECT n_nationkey, upper(trim(n_name)) AS u, length(n_name) AS n, coalesce(NULL, n_name) AS c FROM nation")
def calc_text_functions(t):
    return lf.transform("@calc", t("nation"), strategy={"u": "upper(n_name)", "n": "length(n_name)", "c": "coalesce(null, n_name)"}).select("n_nationkey", "u", "n", "c")


@query("SELECT event_id, hour(ts)::INTEGER AS ts_hour, minute(ts)::INTEGER AS ts_minute, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS ts_time_of_day FROM events")
def extract_time(t):
    return lf.transform("@extract", t("events"), "ts", strategy=["hour", "minute", "time_of_day"]).select("event_id", "ts_hour", "ts_minute", "ts_time_of_day")


@query(f"SELECT 'v' AS \"column\", count(*) - count(v) AS null_count FROM {'(SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS v, event_id FROM events)'}")
def analyze_focus_nulls(t):
    return lf.analyze(_gaps(t), columns=["v", "event_id"], focus="nulls")


# ---- rounding, text, dates, units


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 7.0 * 10 + 0.5) / 10 AS q_round FROM lineitem")
def round_standard(t):
    return lf.transform("@round:1", t("lineitem").withColumn("q", F.col("l_extendedprice") / 7.0), "q").select("l_orderkey", "l_linenumber", "q_round")


@query("SELECT l_orderkey, l_linenumber, ceil(l_extendedprice / 7.0 * 10) / 10 AS q_round FROM lineitem")
def round_up(t):
    return lf.transform("@roundup:1", t("lineitem").withColumn("q", F.col("l_extendedprice") / 7.0), "q").select("l_orderkey", "l_linenumber", "q_round")


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 7.0 * 10) / 10 AS down FROM lineitem")
def round_down(t):
    return lf.transform("@rounddown:1", t("lineitem").withColumn("q", F.col("l_extendedprice") / 7.0), "q", strategy={"q": "down"}).select("l_orderkey", "l_linenumber", "down")


@query("SELECT p_partkey, round_even(p_size / 2.0, 0) AS half_round FROM part")
def round_banker(t):
    return lf.transform("@bankers_round", t("part").withColumn("half", F.col("p_size") / 2.0), "half", strategy={"decimals": 0}).select("p_partkey", "half_round")


@query("SELECT p_partkey, str_split(p_name, ' ')[1] AS p_name_1, str_split(p_name, ' ')[2] AS p_name_2, str_split(p_name, ' ')[3] AS p_name_3 FROM part")
def split_name(t):
    return lf.transform("@split", t("part"), "p_name", by=" ", parts=3).select("p_partkey", "p_name_1", "p_name_2", "p_name_3")


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate_year, month(o_orderdate)::INTEGER AS o_orderdate_month, day(o_orderdate)::INTEGER AS o_orderdate_day, hour(o_orderdate)::INTEGER AS o_orderdate_hour FROM orders")
def extract_datetime(t):
    return lf.transform("@extract", t("orders"), "o_orderdate").select("o_orderkey", *[f"o_orderdate_{p}" for p in ("year", "month", "day", "hour")])


@query("SELECT o_orderkey, quarter(o_orderdate)::INTEGER AS o_orderdate_quarter, isodow(o_orderdate)::INTEGER AS o_orderdate_day_of_week, monthname(o_orderdate) AS o_orderdate_month_name, isodow(o_orderdate) >= 6 AS o_orderdate_is_weekend, dayofyear(o_orderdate)::INTEGER AS o_orderdate_day_of_year FROM orders")
def extract_parts(t):
    parts = ["quarter", "day_of_week", "month_name", "is_weekend", "day_of_year"]
    return lf.transform("@extract", t("orders"), "o_orderdate", strategy=parts).select("o_orderkey", *[f"o_orderdate_{p}" for p in parts])


@query("SELECT c_custkey, lower(replace(c_name, '#', '.')) AS email_username, lower(c_mktsegment) || '.example' AS email_domain FROM customer")
def extract_email(t):
    address = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example"))
    return lf.transform("@extract", t("customer").withColumn("email", address), "email").select("c_custkey", "email_username", "email_domain")


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/?#]+)', 1) AS url_scheme, regexp_extract(url, '^([a-z]+)://([^/?#]+)', 2) AS url_host FROM pages")
def extract_url(t):
    return lf.transform("@extract", t("pages"), "url", strategy=["scheme", "host"]).select("page_id", "url_scheme", "url_host")


@query("SELECT p_partkey, nullif(regexp_extract(p_brand, '#(\\d+)', 1), '') AS p_brand_extract FROM part")
def extract_regex(t):
    return lf.transform("@extract", t("part"), "p_brand", expression=r"#(\d+)").select("p_partkey", "p_brand_extract")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '2024-01-01'::TIMESTAMP WHEN 1 THEN '2024-02-29'::TIMESTAMP ELSE '2023-12-31'::TIMESTAMP END AS d FROM nation")
def datetime_partial(t):
    texts = F.when(F.col("n_nationkey") % 3 == 0, "2024-01-01").when(F.col("n_nationkey") % 3 == 1, "2024-02").otherwise("2023")
    return cols.to_datetime(t("nation").withColumn("d", texts), "d", "end").select("n_nationkey", "d")


@query("SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM part)) / ((SELECT max(p_size) - min(p_size) FROM part))::DOUBLE, 9) AS p_size_normalize FROM part")
def scale_normalize(t):
    return _round(lf.transform("@scale", t("part"), "p_size").select("p_partkey", "p_size_normalize"), 9)


@query("SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part), 6) AS p_retailprice_standardize FROM part")
def scale_standardize(t):
    return _round(lf.transform("@scale", t("part"), "p_retailprice", method="standardize").select("p_partkey", "p_retailprice_standardize"), 6)


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' WHEN p_size < 100 THEN 'large' END AS p_size_bin FROM part")
def bin_labels(t):
    return lf.transform("@bin", t("part"), "p_size", strategy={"edges": [0, 10, 30, 100], "labels": ["small", "medium", "large"]}).select("p_partkey", "p_size_bin")


for _kind, _from, _to, _sql in (
    ("weight", "kg", "lb", "p_size / 0.453592"), ("distance", "mile", "km", "p_size * 1609.34 / 1000"), ("temperature", "c", "f", "p_size * 9.0 / 5.0 + 32.0"),
    ("volume", "gal", "l", "p_size * 3.78541"), ("speed", "mph", "kph", "p_size * 0.44704 * 3.6"), ("currency", "USD", "EUR", "p_size * 0.92"),
):

    def _one(t, kind=_kind, source=_from, target=_to):
        spec = {"kind": kind, "from": source, "to": target, "rate": 0.92, "name": "x"}
        return _round(lf.transform("@harmonize", t("part"), strategy={"p_size": spec}).select("p_partkey", "x"), 6)

    _one.__name__ = f"harmonize_{_kind}"
    query(f"SELECT p_partkey, round({_sql}, 6) AS x FROM part")(_one)


# ---- encoding


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderpriority = '{p}')::INTEGER AS \"o_orderpriority_{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders")
def onehot(t):
    out = lf.transform("@onehot", t("orders"), "o_orderpriority")
    return out.select("o_orderkey", *[F.col(f"`{c}`") for c in out.columns if c.startswith("o_orderpriority_")])


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment)::INTEGER - 1 AS c_mktsegment_code FROM customer")
def label(t):
    return lf.transform("@label", t("customer"), "c_mktsegment").select("c_custkey", "c_mktsegment_code")


@query("SELECT l_orderkey, l_linenumber, (dense_rank() OVER (ORDER BY l_suppkey::VARCHAR))::INTEGER - 1 AS l_suppkey_code FROM lineitem")
def label_numbers(t):
    return lf.transform("@label", t("lineitem"), "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey_code")


@query("SELECT 'r_regionkey' AS key, " + ", ".join(f"max(CASE WHEN r_regionkey = {i} THEN r_regionkey::VARCHAR END) AS \"column_{i}\"" for i in range(5)) + " FROM region UNION ALL SELECT 'r_name', " + ", ".join(f"max(CASE WHEN r_regionkey = {i} THEN r_name END)" for i in range(5)) + " FROM region")
def transpose(t):
    return lf.transform("@transpose", lf.transform("@sort", t("region").select(F.col("r_regionkey").cast("string").alias("r_regionkey"), "r_name"), by="r_regionkey"))


# ---- imputation

_GAPS = "(SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS v, CASE WHEN event_id % 5 <> 0 THEN event_type END AS e FROM events)"


def _gaps(t) -> DataFrame:
    return t("events").select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("e"))


@query(f"SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM {_GAPS})), 6) AS v_infer FROM {_GAPS}")
def impute_mean(t):
    return _round(lf.transform("@deduce", _gaps(t), infer="v", method="mean").select("event_id", "v_infer"), 6)


@query(f"SELECT event_id, round(coalesce(v, (SELECT median(v) FROM {_GAPS})), 6) AS v_infer FROM {_GAPS}")
def impute_median(t):
    return _round(lf.transform("@deduce", _gaps(t), infer="v", method="median").select("event_id", "v_infer"), 6)


@query(f"WITH n AS (SELECT e, count(*) AS n FROM {_GAPS} WHERE e IS NOT NULL GROUP BY 1) SELECT event_id, coalesce(e, (SELECT arg_min(e, row(-n, e)) FROM n)) AS e_infer FROM {_GAPS}")
def impute_mode(t):
    return lf.transform("@deduce", _gaps(t), infer="e", method="mode").select("event_id", "e_infer")


@query(f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v_infer FROM {_GAPS}")
def impute_ffill(t):
    return lf.transform("@deduce", _gaps(t), infer="v", method="ffill", order_by="event_id").select("event_id", "v_infer")


@query(f"SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v_infer FROM {_GAPS}")
def impute_bfill(t):
    return lf.transform("@deduce", _gaps(t), infer="v", method="backward_fill", order_by="event_id").select("event_id", "v_infer")


@query(f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v_infer FROM {_GAPS}")
def impute_ffill_groups(t):
    return lf.transform("@deduce", _gaps(t), infer="v", method="forward", order_by="event_id", by="user_id").select("event_id", "v_infer")


@query(f"""
WITH x AS (SELECT event_id, v, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS a1, last_value(v IGNORE NULLS) OVER b AS v1,
  first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER f AS a2, first_value(v IGNORE NULLS) OVER f AS v2 FROM {_GAPS}
  WINDOW b AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING), f AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, v1 + (v2 - v1) * (event_id - a1) / nullif(a2 - a1, 0)), 6) AS v_infer FROM x""")
def impute_interpolate(t):
    return _round(lf.transform("@deduce", _gaps(t), infer="v", method="interpolate", order_by="event_id").select("event_id", "v_infer"), 6)


_SUPPLIERS = "(SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS b FROM supplier)"


@query(f"""
WITH d AS (SELECT x.s_suppkey, y.b, row_number() OVER (PARTITION BY x.s_suppkey ORDER BY sqrt(power(x.s_nationkey - y.s_nationkey, 2)), y.s_suppkey) AS r
  FROM {_SUPPLIERS} x JOIN {_SUPPLIERS} y ON x.s_suppkey <> y.s_suppkey WHERE x.b IS NULL),
g AS (SELECT s_suppkey, avg(b) AS g FROM d WHERE r <= 5 GROUP BY 1)
SELECT x.s_suppkey, round(coalesce(x.b, g.g), 6) AS b_infer FROM {_SUPPLIERS} x LEFT JOIN g USING (s_suppkey)""")
def knn_impute(t):
    gaps = t("supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("b"))
    return _round(lf.transform("@deduce", gaps, infer="b", method="knn", order_by="s_suppkey").select("s_suppkey", "b_infer"), 6)


@query(f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS label, lower(coalesce(text, '')) AS t FROM documents),
w AS (SELECT doc_id, label, list_filter(regexp_split_to_array(t, '[\\x09-\\x0D !-/:-@\\[-`{{-~]+'), lambda x: x <> '' AND x NOT IN ({", ".join(repr(x) for x in impute.STOP_WORDS)})) AS w FROM d),
terms AS (SELECT doc_id, label, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
top AS (SELECT term, count(DISTINCT doc_id) AS df FROM terms WHERE label IS NOT NULL GROUP BY 1 ORDER BY df DESC, term LIMIT 1000),
v AS (SELECT doc_id, term, count(*) * ln((SELECT count(*) FROM d WHERE label IS NOT NULL) / any_value(df)) AS x FROM terms JOIN top USING (term) GROUP BY 1, 2),
norm AS (SELECT doc_id, sqrt(sum(x * x)) AS z FROM v GROUP BY 1),
u AS (SELECT v.doc_id, label, term, x / z AS x FROM v JOIN norm USING (doc_id) JOIN d USING (doc_id) WHERE z > 0),
s AS (SELECT a.doc_id, b.doc_id AS other, any_value(b.label) AS label, round(sum(a.x * b.x), 12) AS s FROM u a JOIN u b ON a.term = b.term WHERE a.label IS NULL AND b.label IS NOT NULL GROUP BY 1, 2),
g AS (SELECT doc_id, arg_max(label, row(s, other)) AS guess FROM s WHERE s > 0 GROUP BY 1)
SELECT doc_id, coalesce(d.label, guess, (SELECT arg_max(label, doc_id) FROM d WHERE label IS NOT NULL)) AS label_infer FROM d LEFT JOIN g USING (doc_id)""")
def tfidf_deduce(t):
    docs = t("documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("label"))
    return impute.tfidf(docs, "label", ["text"], "label_infer", order_by="doc_id").select("doc_id", "label_infer")


for _metric, _weights, _sql, _value in (
    ("manhattan", "uniform", "abs(x.s_nationkey - y.s_nationkey) + abs(x.s_suppkey % 10 - y.s_suppkey % 10)", "avg(b)"),
    ("euclidean", "distance", "sqrt(power(x.s_nationkey - y.s_nationkey, 2) + power(x.s_suppkey % 10 - y.s_suppkey % 10, 2))", "sum(b / (d + 1e-10)) / sum(CASE WHEN b IS NOT NULL THEN 1 / (d + 1e-10) END)"),
):

    def _one(t, metric=_metric, weights=_weights):
        gaps = t("supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 10).alias("digit"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("b"))
        return _round(lf.transform("@deduce", gaps, infer="b", method="knn", against=["s_nationkey", "digit"], order_by="s_suppkey", strategy={"k": 4, "weights": weights, "metric": metric}).select("s_suppkey", "b_infer"))

    _one.__name__ = f"knn_{_metric}_{_weights}"
    query(f"""WITH d AS (SELECT x.s_suppkey, y.b, y.s_suppkey AS o, {_sql} AS d FROM {_SUPPLIERS} x JOIN {_SUPPLIERS} y ON x.s_suppkey <> y.s_suppkey WHERE x.b IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, o) AS r FROM d), g AS (SELECT s_suppkey, {_value} AS g FROM r WHERE r <= 4 GROUP BY 1)
SELECT x.s_suppkey, round(coalesce(x.b, g.g), 4) AS b_infer FROM {_SUPPLIERS} x LEFT JOIN g USING (s_suppkey)""")(_one)


@query(f"""WITH d AS (SELECT x.s_suppkey, y.b, row_number() OVER (PARTITION BY x.s_suppkey ORDER BY y.s_suppkey) AS r FROM {_SUPPLIERS} x JOIN {_SUPPLIERS} y ON x.s_suppkey <> y.s_suppkey WHERE x.b IS NULL),
g AS (SELECT s_suppkey, avg(b) AS g FROM d WHERE r <= 5 GROUP BY 1) SELECT x.s_suppkey, round(coalesce(x.b, g.g), 4) AS b FROM {_SUPPLIERS} x LEFT JOIN g USING (s_suppkey)""")
def knn_in_place(t):
    gaps = t("supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("b"))
    return _round(lf.transform("@knn", gaps, "b", order_by="s_suppkey"))


@query(f"SELECT event_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v_infer FROM {_GAPS}")
def impute_bfill_groups(t):
    return lf.transform("@deduce", _gaps(t), infer="v", method="backward", order_by="event_id", by="user_id").select("event_id", "v_infer")


@query(f"WITH n AS (SELECT e, count(*) AS n FROM {_GAPS} WHERE e IS NOT NULL GROUP BY 1) SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM {_GAPS})), 6) AS v_infer, coalesce(e, (SELECT arg_min(e, row(-n, e)) FROM n)) AS e_infer FROM {_GAPS}")
def impute_auto(t):
    return _round(lf.transform("@deduce", _gaps(t), infer=["v", "e"]).select("event_id", "v_infer", "e_infer"), 6)


# ---- profiles


@query("""
SELECT 'c_custkey' AS "column", 'bigint' AS dtype, count(*) AS count, count(*) - count(c_custkey) AS null_count, 0.0::DOUBLE AS null_pct, count(DISTINCT c_custkey) AS "unique", round(avg(c_custkey), 4) AS mean, round(stddev_samp(c_custkey), 4) AS std, min(c_custkey)::DOUBLE AS min, max(c_custkey)::DOUBLE AS max FROM customer
UNION ALL SELECT 'c_acctbal', 'double', count(*), 0, 0.0, count(DISTINCT c_acctbal), round(avg(c_acctbal), 4), round(stddev_samp(c_acctbal), 4), min(c_acctbal), max(c_acctbal) FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', count(*), 0, 0.0, count(DISTINCT c_mktsegment), NULL, NULL, NULL, NULL FROM customer""")
def analyze_profile(t):
    return _round(lf.scan("@analyze", t("customer"), columns=["c_custkey", "c_acctbal", "c_mktsegment"]))


@query(f"""SELECT 'v' AS "column", 'double' AS dtype, count(*) AS count, count(*) - count(v) AS null_count, round(100.0 * (count(*) - count(v)) / count(*), 4) AS null_pct, count(DISTINCT v) + 1 AS "unique", round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, max(v) AS max FROM {_GAPS}""")
def analyze_nulls(t):
    return _round(lf.analyze(_gaps(t), columns="v"))


@query("""
WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer)
SELECT 'c_acctbal' AS "column", round(any_value(a - 1.5 * (b - a)), 4) AS lower, round(any_value(b + 1.5 * (b - a)), 4) AS upper, count(*) FILTER (c_acctbal < a - 1.5 * (b - a) OR c_acctbal > b + 1.5 * (b - a)) AS outliers FROM customer, q""")
def analyze_outliers(t):
    return _round(lf.analyze(t("customer"), columns="c_acctbal", focus="outliers"))


@query("""SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem
UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem""")
def analyze_corr(t):
    return _round(lf.analyze(t("lineitem"), columns=["l_quantity", "l_extendedprice", "l_tax"], focus="correlations"), 6)


@query("""WITH e AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b FROM part)
SELECT 'p_size' AS "column", least(9, floor((p_size - a) / ((b - a) / 10)))::INTEGER AS bin, round(any_value(a + least(9, floor((p_size - a) / ((b - a) / 10))) * (b - a) / 10), 6) AS low, round(any_value(a + (least(9, floor((p_size - a) / ((b - a) / 10))) + 1) * (b - a) / 10), 6) AS high, count(*) AS rows FROM part, e GROUP BY bin""")
def analyze_distribution(t):
    return _round(lf.analyze(t("part"), columns="p_size", focus="distributions"), 6)


# ---- comparison


def _snapshots(t) -> tuple[DataFrame, DataFrame]:
    """Some rows gone, some new, some changed."""
    old = t("customer").where("c_custkey % 11 <> 0").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    new = t("customer").where("c_custkey % 13 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey") % 20).alias("c_nationkey"), "c_mktsegment")
    return old, new


_OLD = "(SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0)"
_NEW = "(SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey % 20 END AS c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 13 <> 0)"


@query(f"""
WITH j AS (SELECT a.c_custkey AS ka, b.c_custkey AS kb, a.c_name AS na, b.c_name AS nb, a.c_nationkey AS xa, b.c_nationkey AS xb, a.c_mktsegment AS sa, b.c_mktsegment AS sb FROM {_OLD} a FULL JOIN {_NEW} b ON a.c_custkey = b.c_custkey)
SELECT coalesce(kb, ka)::VARCHAR AS c_custkey,
  CASE WHEN ka IS NOT NULL AND kb IS NOT NULL AND na IS DISTINCT FROM nb THEN coalesce(na, 'null') || ' → ' || coalesce(nb, 'null') WHEN kb IS NOT NULL THEN nb ELSE na END AS c_name,
  CASE WHEN ka IS NOT NULL AND kb IS NOT NULL AND xa IS DISTINCT FROM xb THEN coalesce(xa::VARCHAR, 'null') || ' → ' || coalesce(xb::VARCHAR, 'null') WHEN kb IS NOT NULL THEN xb::VARCHAR ELSE xa::VARCHAR END AS c_nationkey,
  coalesce(sb, sa) AS c_mktsegment,
  CASE WHEN ka IS NULL THEN 'new' WHEN kb IS NULL THEN 'deleted' WHEN na IS DISTINCT FROM nb OR xa IS DISTINCT FROM xb THEN 'changed' ELSE 'no_change' END AS _diff_status FROM j""")
def diff_summary(t):
    old, new = _snapshots(t)
    return lf.scan("@diff", old=old, new=new, key="c_custkey")


@query(f"""
SELECT a.c_custkey::VARCHAR AS _key, 'c_name' AS _column, a.c_name AS _old_value, b.c_name AS _new_value, b.c_mktsegment FROM {_OLD} a JOIN {_NEW} b USING (c_custkey) WHERE a.c_name IS DISTINCT FROM b.c_name
UNION ALL SELECT a.c_custkey::VARCHAR, 'c_nationkey', a.c_nationkey::VARCHAR, b.c_nationkey::VARCHAR, b.c_mktsegment FROM {_OLD} a JOIN {_NEW} b USING (c_custkey) WHERE a.c_nationkey IS DISTINCT FROM b.c_nationkey""")
def diff_detail(t):
    old, new = _snapshots(t)
    return lf.scan("@diff", old=old, new=new, strategy={"output": "detail", "context": "c_mktsegment"})


@query("""
SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, 'new' AS _diff_status FROM nation WHERE n_nationkey < 5
UNION ALL SELECT n_nationkey::VARCHAR, n_name, 'no_change' FROM nation WHERE n_nationkey >= 5
UNION ALL SELECT n_nationkey::VARCHAR, n_name, 'duplicate' FROM nation WHERE n_nationkey < 5
UNION ALL SELECT n_nationkey::VARCHAR, lower(n_name), 'duplicate' FROM nation WHERE n_nationkey < 5""")
def diff_duplicates(t):
    nation = t("nation").select("n_nationkey", "n_name")
    other = nation.where("n_nationkey < 5").withColumn("n_name", F.lower("n_name"))
    return lf.scan("@diff", old=nation.unionByName(other).unionByName(nation.where("n_nationkey > 20")), new=nation, key="n_nationkey")


@query("""
SELECT n_nationkey::VARCHAR AS n_nationkey, CASE n_nationkey WHEN 1 THEN 'Americas → Canada (hierarchy)' WHEN 2 THEN 'Brazil → Kenya' ELSE n_name END AS land, CASE WHEN n_nationkey IN (1, 2) THEN 'changed' ELSE 'no_change' END AS _diff_status FROM nation""")
def diff_alias_group(t):
    name = F.col("n_name")
    old = t("nation").select("n_nationkey", F.when(F.col("n_nationkey") == 1, "Americas").when(F.col("n_nationkey") == 2, "Brazil").otherwise(name).alias("Country"))
    new = t("nation").select("n_nationkey", F.when(F.col("n_nationkey") == 1, "Canada").when(F.col("n_nationkey") == 2, "Kenya").otherwise(name).alias("LAND"))
    return lf.scan("@diff", old=old, new=new, key="n_nationkey", strategy={"aliases": {"land": ["country"]}, "groups": {"americas": ["canada", "brazil"]}})


# ---- synthetic data and lineage


@query("SELECT 5 + 3 * i AS number, 'EMP_' || CASE WHEN i < 999 THEN lpad((1 + i)::VARCHAR, 3, '0') ELSE (1 + i)::VARCHAR END AS code FROM range(1200) r(i)")
def synth_sequence(t):
    return made.new(t("region").sparkSession, 1200, {"number": {"type": "sequence", "start": 5, "step": 3}, "code": "increment:start=1:pattern=EMP_[001]"})


@query("SELECT true AS normal_near, true AS uniform_in, true AS poisson_near, true AS beta_in, true AS shares_near, true AS dates_in, true AS phone_fits")
def synth_ranges(t):
    spec = {
        "a": "normal(40, 10)", "u": {"distribution": "uniform", "min": 2, "max": 5}, "p": {"distribution": "poisson", "lambda": 4}, "b": {"distribution": "beta", "alpha": 2, "beta": 5},
        "c": {"values": ["x", "y"], "weights": [0.8, 0.2]}, "d": {"type": "date", "start": "2020-01-01", "end": "2020-12-31"}, "t": {"pattern": "phone", "format": "US"},
    }
    df = made.new(t("region").sparkSession, 20000, spec)
    return df.agg(
        (F.abs(F.avg("a") - 40) < 0.5).alias("normal_near"), ((F.min("u") >= 2) & (F.max("u") <= 5)).alias("uniform_in"), (F.abs(F.avg("p") - 4) < 0.1).alias("poisson_near"),
        ((F.min("b") >= 0) & (F.max("b") <= 1) & (F.abs(F.avg("b") - 2 / 7) < 0.03)).alias("beta_in"), (F.abs(F.avg((F.col("c") == "x").cast("int")) - 0.8) < 0.02).alias("shares_near"),
        ((F.min("d") >= F.lit("2020-01-01").cast("date")) & (F.max("d") <= F.lit("2020-12-31").cast("date"))).alias("dates_in"), F.bool_and(F.col("t").rlike(r"^\+1-\d{3}-\d{3}-\d{4}$")).alias("phone_fits"),
    )


@query("SELECT count(*) + 500 AS rows, count(DISTINCT c_mktsegment) AS segments, 0::BIGINT AS unknown_names, true AS near, true AS many_names FROM customer")
def synth_augment(t):
    c = t("customer")
    more, known = lf.synthetic(c, 500), c.select(F.col("c_name").alias("known"))
    real = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("s"), F.max("c_custkey").alias("last"))
    seen = more.join(known, F.col("c_name") == F.col("known"), "left").crossJoin(F.broadcast(real))
    return seen.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("c_mktsegment").alias("segments"), F.count_if(F.col("known").isNull()).alias("unknown_names"),
        (F.abs(F.avg("c_acctbal") - F.max("m")) < F.max("s") / 5).alias("near"), (F.countDistinct("c_name") == F.count_if(F.col("c_name").isNotNull()) - 500).alias("many_names"),
    )


@query("""WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer)
SELECT c_mktsegment, round(sum(c_acctbal) OVER (PARTITION BY c_mktsegment), 2) AS c_acctbal, n AS _row_id FROM c WHERE c_acctbal > 5000""")
def lineage_rows(t):
    traced = lineage.Traced.start(t("customer"), "c_custkey").filter("c_acctbal > 5000").aggregate("c_mktsegment", {"c_acctbal": "sum"})
    return _round(traced.row_map(), 2)


@query("""WITH g AS (SELECT c_nationkey, sum(c_acctbal) AS s FROM customer WHERE c_acctbal > 0 GROUP BY 1), r AS (SELECT c_nationkey % 5 AS r, sum(s) AS s FROM g WHERE s > 10000 GROUP BY 1)
SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0 AND c_nationkey IN (SELECT c_nationkey FROM g WHERE s > 10000) AND c_nationkey % 5 IN (SELECT r FROM r WHERE r <> 2))""")
def lineage_excluded_groups(t):
    traced = lineage.Traced.start(t("customer"), "c_custkey").filter("c_acctbal > 0").aggregate("c_nationkey", {"s": ("c_acctbal", "sum")}).filter("s > 10000")
    traced = traced.calc({"r": "c_nationkey % 5"}).aggregate("r", {"s": "sum"}).filter("r != 2")
    return lf.analyze(traced, focus="excluded").select("c_custkey")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS _row_id FROM orders")
def lineage_start_text(t):
    return lineage.Traced.start(t("orders"), ["o_orderpriority", "o_orderkey"]).df.select("o_orderkey", "o_custkey", "_row_id")


@query("SELECT c_custkey FROM customer WHERE NOT c_acctbal > 5000")
def lineage_excluded(t):
    return lineage.Traced.start(t("customer"), "c_custkey").filter("c_acctbal > 5000").excluded().select("c_custkey")


@query("""WITH x AS (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS n, c_nationkey FROM customer) WHERE c_nationkey > 5) SELECT min(n) AS first, max(n) AS last FROM x GROUP BY g""")
def lineage_ranges(t):
    return lineage.ranges(lineage.Traced.start(t("customer"), "c_custkey").filter("c_nationkey > 5").df)


# ---- more modes


@query("SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_strict(t):
    return lf.to(t("supplier"), t("nation").withColumnRenamed("n_nationkey", "s_nationkey"), [("n_name", "nation")], "s_nationkey", strategy={"n_name": "strict"}).select("s_suppkey", "nation")


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY 1")
def agg_list(t):
    df = lf.transform("@aggregate", t("nation").withColumn("o", -F.col("n_nationkey")), by="n_regionkey", strategy={"names": ("n_name", "list")}, order_by="o")
    return df.withColumn("names", F.array_join("names", ";"))


@query("SELECT s_nationkey AS k, 'nation ' || s_nationkey AS kind, 'x' AS trimmed FROM supplier GROUP BY 1")
def agg_match(t):
    text = F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))
    df = t("supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.upper(text)).otherwise(text).alias("kind"), F.when(F.col("s_suppkey") % 3 == 0, " x ").otherwise("x").alias("y"))
    return lf.transform("@aggregate", df, by="k", strategy={"kind": ("kind", "auto:anycase"), "trimmed": ("y", "auto:trim")})


@query("SELECT n_name, r_name FROM nation, region WHERE n_nationkey < 5")
def join_cross(t):
    return lf.to(t("nation").where("n_nationkey < 5").select("n_name"), t("region"), "r_name", [], join_type="cross")


@query("SELECT c_custkey, c_name AS name FROM customer")
def to_new(t):
    return lf.to("@new", t("customer"), [("c_name", "name")], "c_custkey")


@query("SELECT count(*) AS rows, count(DISTINCT o_custkey) AS keys, (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 1)) AS repeated_keys, (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1))::BIGINT AS repeated_rows, round((SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)) * 100.0 / count(*), 4)::DOUBLE AS percent, (SELECT string_agg(k || ' (' || n || ')', '; ' ORDER BY n DESC, k) FROM (SELECT o_custkey::VARCHAR AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1 ORDER BY n DESC, k LIMIT 5)) AS examples FROM orders")
def lookup_repeats(t):
    from loomframe.operators.aggregate import repeats

    return _round(repeats(t("orders"), ["o_custkey"]).withColumn("examples", F.array_join("examples", "; ")))


@query("SELECT n_name, n_nationkey, length(n_name) AS n, n_regionkey FROM nation")
def position_calc(t):
    return lf.transform("@calc", t("nation").select("n_name", "n_nationkey", "n_regionkey"), expression="length(n_name)", name="n", position="after:n_nationkey")


@query("SELECT n_nationkey, (n_regionkey = 1)::INTEGER AS \"1\", (n_regionkey = 2)::INTEGER AS \"2\", (n_regionkey = 3)::INTEGER AS \"3\", (n_regionkey = 4)::INTEGER AS \"4\" FROM nation")
def onehot_numbers(t):
    return lf.transform("@onehotencode", t("nation"), "n_regionkey", strategy={"prefix": False, "drop_first": True}).select("n_nationkey", *map(cols.quoted, "1234"))


@query("SELECT o_orderkey, hour(o_orderdate)::INTEGER AS d_hour, month(o_orderdate)::INTEGER AS d_month FROM orders")
def extract_text_time(t):
    return lf.transform("@datetime", t("orders").withColumn("d", F.col("o_orderdate").cast("string")), "d").select("o_orderkey", "d_hour", "d_month")


@query("SELECT c_custkey, 44 + c_nationkey % 3 AS c, 8000 + c_nationkey AS p, 'part' || c_nationkey AS f FROM customer")
def extract_phone_url(t):
    url = F.concat(F.lit("https://h.example:"), (F.col("c_nationkey") + 8000).cast("string"), F.lit("/a?b=c#part"), F.col("c_nationkey").cast("string"))
    df = t("customer").select("c_custkey", F.concat(F.lit("+"), (F.col("c_nationkey") % 3 + 44).cast("string"), F.lit("-555-123-4567")).alias("phone"), url.alias("url"))
    df = lf.transform("@extract", lf.transform("@extract", df, "phone", strategy=["country_code"]), "url", strategy=["port", "fragment"])
    return df.select("c_custkey", F.col("phone_country_code").cast("int").alias("c"), F.col("url_port").alias("p"), F.col("url_fragment").alias("f"))


@query("""WITH o AS (SELECT c_custkey % 10 AS a, c_custkey // 10 AS b, c_nationkey AS q FROM customer), n AS (SELECT a, b, CASE WHEN a % 4 = 0 THEN q + 1 ELSE q END AS q FROM o WHERE a % 9 <> 0)
SELECT o.a::VARCHAR AS a, o.b::VARCHAR AS b, CASE WHEN n.a IS NULL OR o.q = n.q THEN o.q::VARCHAR ELSE o.q || ' → ' || n.q END AS q, CASE WHEN n.a IS NULL THEN 'deleted' WHEN o.q = n.q THEN 'no_change' ELSE 'changed' END AS _diff_status FROM o LEFT JOIN n ON o.a = n.a AND o.b = n.b""")
def diff_key_pair(t):
    old = t("customer").select((F.col("c_custkey") % 10).alias("a"), F.expr("c_custkey div 10").alias("b"), F.col("c_nationkey").alias("q"))
    new = old.where("a % 9 <> 0").withColumn("q", F.when(F.col("a") % 4 == 0, F.col("q") + 1).otherwise(F.col("q")))
    return lf.scan("@diff", old=old, new=new, strategy={"ordered": True})


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, CASE WHEN n_nationkey = 3 THEN 'Nord → Sud' WHEN n_nationkey % 2 = 0 THEN 'Nord' ELSE n_name END AS land, CASE WHEN n_nationkey = 3 THEN 'changed' ELSE 'no_change' END AS _diff_status FROM nation")
def diff_value_aliases(t):
    name, k = F.col("n_name"), F.col("n_nationkey")
    old = t("nation").select("n_nationkey", F.when((k % 2 == 0) | (k == 3), "north").otherwise(name).alias("land"))
    new = t("nation").select("n_nationkey", F.when(k == 3, "Sud").when(k % 2 == 0, "NORD").otherwise(name).alias("land"))
    return lf.scan("@diff", old=old, new=new, key="n_nationkey", strategy={"values": {"land": {"Nord": ["north", "n."]}}})


@query("SELECT 3000::BIGINT AS rows, 3000::BIGINT AS emails, 3000::BIGINT AS uuids, 3000::BIGINT AS codes, 3000::BIGINT AS uk, 3000::BIGINT AS times, 3000::BIGINT AS pairs, 3000::BIGINT AS different_uuids, 3::BIGINT AS different_pairs, 3000::BIGINT AS names, 3000::BIGINT AS places")
def synth_patterns(t):
    spec = {
        "e": {"pattern": "email", "domain": "test.com"}, "u": {"pattern": "uuid"}, "r": {"pattern": "regex", "regex": "[A-Z]{3}-[0-9]{4}"}, "p": {"pattern": "phone", "format": "UK"},
        "t": {"type": "time", "start": "09:00:00", "end": "17:00:00"}, "l": {"type": "linked_list", "levels": [["a", "b", "c"], [1, 2, 3]]}, "n": "name", "c": {"pattern": "address"},
    }
    df = made.new(t("region").sparkSession, 3000, spec)
    fits = lambda c, pattern, name: F.count_if(F.col(c).rlike(pattern)).alias(name)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), fits("e", r"^[a-z]{8}@test\.com$", "emails"), fits("u", r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", "uuids"), fits("r", r"^[A-Z]{3}-[0-9]{4}$", "codes"),
        fits("p", r"^\+44-\d{4}-\d{6}$", "uk"), fits("t", r"^(09|1[0-6]):[0-5]\d:[0-5]\d$|^17:00:00$", "times"), fits("l", r"^(a 1|b 2|c 3)$", "pairs"), F.countDistinct("u").alias("different_uuids"), F.countDistinct("l").alias("different_pairs"),
        fits("n", r"^[A-Z][a-z]+ [A-Z][a-z]+$", "names"), fits("c", r"^\d{1,3} [A-Z][a-z]+ (Street|Road|Lane)$", "places"),
    )


#: Mean and variance of each, rounded to what 200,000 rows give surely.
@query("SELECT 0.3 AS beta_mean, 0.019 AS beta_var, 1.1 AS lognormal_mean, 2.0 AS exponential_mean, 4.0 AS exponential_var, 700.0 AS binomial_mean, 210.0 AS binomial_var, 2000.0 AS poisson_mean")
def synth_moments(t):
    spec = {"b": "beta(3, 7)", "s": "beta(0.5, 0.5)", "l": "lognormal(0, 0.5)", "x": "exponential(0.5)", "n": {"distribution": "binomial", "n": 1000, "p": 0.7}, "p": "poisson(2000)"}
    df = made.new(t("region").sparkSession, 200_000, spec, partitions=8)
    return df.agg(
        F.round(F.avg("b"), 2).alias("beta_mean"), F.round(F.var_samp("b"), 3).alias("beta_var"), F.round(F.avg("l"), 1).alias("lognormal_mean"), F.round(F.avg("x"), 1).alias("exponential_mean"), F.round(F.var_samp("x"), 0).alias("exponential_var"),
        F.round(F.avg("n"), 0).alias("binomial_mean"), F.round(F.var_samp("n"), -1).alias("binomial_var"), F.round(F.avg("p"), 0).alias("poisson_mean"),
    )


# ---- all other named formulas, their inputs in order of appearance taken from x1 to x4

_FORMULAS = {
    "core": {"profit": "x1 - x2", "total_price": "x1 * x2", "discount_amount": "x1 * x2", "net_price": "x1 - x1 * x2", "bsa_mosteller": "0.007184 * power(x1, 0.725) * power(x2, 0.425)"},
    "finance": {"roi": "(x1 - x2) / x2 * 100", "profit_margin": "(x1 - x2) / x1 * 100", "gross_profit": "x1 - x2", "net_profit": "x1 - x2", "break_even": "x1 / (x2 - x4)", "markup": "(x1 - x2) / x2 * 100", "simple_interest": "x1 * x2 * x3", "debt_to_equity": "x1 / x2", "current_ratio": "x1 / x2"},
    "medical": {"heart_rate_max": "220 - x1", "heart_rate_reserve": "x1 - x2", "target_heart_rate_low": "(x1 - x2) * 0.5 + x2", "target_heart_rate_high": "(x1 - x2) * 0.85 + x2", "ideal_body_weight_male": "50 + 0.91 * (x1 - 152.4)", "ideal_body_weight_female": "45.5 + 0.91 * (x1 - 152.4)", "creatinine_clearance": "(140 - x1) * x2 / (72 * x3)", "pulse_pressure": "x1 - x2", "bsa_haycock": "0.024265 * power(x1, 0.3964) * power(x2, 0.5378)", "bmr_male": "10 * x1 + 6.25 * x2 - 5 * x3 + 5", "bmr_female": "10 * x1 + 6.25 * x2 - 5 * x3 - 161", "waist_to_hip_ratio": "x1 / x2"},
    "physics": {"velocity": "x1 / x2", "acceleration": "(x1 - x2) / x3", "force": "x1 * x2", "kinetic_energy": "0.5 * x1 * x2 * x2", "potential_energy": "x1 * 9.81 * x2", "work": "x1 * x2", "momentum": "x1 * x2", "pressure": "x1 / x2", "density": "x1 / x2", "frequency": "1 / x1", "wavelength": "x1 / x2"},
    "chemistry": {"molarity": "x1 / x2", "moles_from_mass": "x1 / x2", "mass_from_moles": "x1 * x2", "dilution_concentration": "x1 * x2 / x3", "percent_yield": "x1 / x2 * 100", "percent_composition": "x1 / x2 * 100", "ideal_gas_pressure": "x1 * 8.314 * x2 / x3", "ideal_gas_volume": "x1 * 8.314 * x2 / x3"},
    "engineering": {"power_electrical": "x1 * x2", "resistance": "x1 / x2", "current": "x1 / x2", "efficiency_pct": "x1 / x2 * 100", "stress": "x1 / x2", "strain": "x1 / x2", "youngs_modulus": "x1 / x2", "flow_rate_volume": "x1 * x2", "reynolds_number": "x1 * x2 * x3 / x4", "capacitance": "x1 / x2"},
    "statistics": {"z_score": "(x1 - x2) / x3", "coefficient_of_variation": "x1 / x2 * 100", "standard_error": "x1 / sqrt(x2)", "percent_error": "(x1 - x2) / x2 * 100", "relative_error_pct": "(x1 - x2) / x1 * 100", "slope": "x1 / x2", "intercept": "x1 - x2 * x3", "predicted_value": "x1 + x2 * x3", "residual": "x1 - x2", "r_squared": "x1 * x1"},
}

for _name, _own in _FORMULAS.items():

    def _one(t, own=_own):
        from loomframe.functions.formulas import identifiers

        df = t("part").select("p_partkey", F.col("p_retailprice").alias("x1"), F.col("p_size").cast("double").alias("x2"), (F.col("p_partkey") % 7 + 1).cast("double").alias("x3"), F.lit(0.25).alias("x4"))
        for name in own:
            inputs = identifiers(lf.formulas.find(name).expression)
            places = ("x1", "x2", "x4") if name == "break_even" else ("x1", "x2", "x3", "x4")
            df = lf.formulas.apply(df, name, output=name, **dict(zip(inputs, places, strict=False)))
        return _round(df.select("p_partkey", *own), 7)

    _one.__name__ = f"formulas_{_name}"
    query(f"SELECT p_partkey, {', '.join(f'round({e}, 7) AS {n}' for n, e in _own.items())} FROM (SELECT p_partkey, p_retailprice AS x1, p_size::DOUBLE AS x2, (p_partkey % 7 + 1)::DOUBLE AS x3, 0.25::DOUBLE AS x4 FROM part)")(_one)
