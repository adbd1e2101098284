"""The registered queries of the document engine, each with the SQL that must give the same rows.

Every query goes through the engine's own API over the whole table it names. Sums of doubles are rounded, since their last
bits depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernstore.functions import paths, scalars
from fernstore.functions.schema import ColumnDef, StoreSchema, violation
from fernstore.functions.validators import EMAIL, UUID, ObjectValidator, Validator, fg
from fernstore.operators import merging, replication, versions
from fernstore.operators.aggregates import avg, count, max_, min_, sum_
from fernstore.operators.ordering import key_ordered
from fernstore.operators.paging import Order, page_rows
from fernstore.plans.query import Query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The unique column of each table that has one.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id"}


def query(sql: str) -> Callable[[Callable[[Tables], DataFrame]], None]:
    def register(fn: Callable[[Tables], DataFrame]) -> None:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        SQL[fn.__name__] = sql

    return register


class Tables:
    """Typed stores over the Parquet tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def df(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def store(self, name: str, df: DataFrame | None = None) -> Query:
        df = self.df(name) if df is None else df
        return Query(lambda: df, KEYS.get(name, df.columns[0]))


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


# --- scans

CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query(f"select {CUSTOMER} from customer")
def scan_all(t):
    return t.store("customer").to_df()


@query(f"select {ORDERS} from orders order by o_orderkey limit 100")
def scan_limit_key_order(t):
    return t.store("orders").to_df(100)


def nation_paths(t: Tables) -> DataFrame:
    n, r = t.df("nation"), t.df("region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat_ws("/", F.lit("region"), "r_name", F.lit("nation"), "n_name").alias("key"), "n_nationkey")


PATHS = "select 'region/' || r_name || '/nation/' || n_name as key, n_nationkey from nation join region on n_regionkey = r_regionkey"


@query(f"select * from ({PATHS}) where key like 'region/ASIA/nation/%'")
def prefix_scan(t):
    return key_ordered(nation_paths(t).where(paths.is_child(F.col("key"), "region/ASIA/nation")))


@query(f"select {ORDERS} from orders where o_orderkey > 500 order by o_orderkey limit 50")
def resumable_scan(t):
    return key_ordered(t.df("orders"), "o_orderkey", 50, after=500)


@query(f"select {ORDERS} from orders where o_orderkey = 42")
def point_get(t):
    return t.store("orders").filter("o_orderkey").equals(42).to_df()


@query("select exists(select 1 from orders where o_orderkey = 42) as found, exists(select 1 from orders where o_orderkey = -1) as missing")
def exists(t):
    o = t.store("orders")
    found = [o.filter("o_orderkey").equals(k).exists() for k in (42, -1)]
    return t.spark.createDataFrame([tuple(found)], "found boolean, missing boolean")


@query("select path, len(list_filter(string_split(path, '/'), lambda s: s <> ''))::int as segments, regexp_replace(path, '/[^/]*$', '') as parent, case when contains(path, '/') then split_part(path, '/', 1) else '_root' end as root from (select 'customer/' || c_custkey || '/orders/' || c_nationkey as path from customer union all select c_mktsegment from customer)")
def path_functions(t):
    c = t.df("customer")
    p = c.select(F.concat_ws("/", F.lit("customer"), F.col("c_custkey").cast("string"), F.lit("orders"), F.col("c_nationkey").cast("string")).alias("path")).unionByName(c.select(F.col("c_mktsegment").alias("path")))
    return p.select("path", paths.n_segments(F.col("path")).alias("segments"), paths.parent_of(F.col("path")).alias("parent"), paths.root_of(F.col("path")).alias("root"))


# --- filters

EVENTS = "event_id, user_id, event_type, value"


def events(t: Tables) -> Query:
    return t.store("events", t.df("events").select(*EVENTS.split(", ")))


@query(f"select {EVENTS} from events where event_type = 'click'")
def filter_eq_string(t):
    return events(t).filter("event_type").equals("click").to_df()


@query(f"select {ORDERS} from orders where o_custkey = 7")
def filter_eq_int(t):
    return t.store("orders").filter("o_custkey").equals(7.0).to_df()  # numbers compare by value, whatever their types


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity = 25")
def filter_eq_double(t):
    return t.store("lineitem").filter("l_quantity").equals(25).to_df().select("l_orderkey", "l_linenumber", "l_quantity")


LINE = "l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice"


def line(q: Query) -> DataFrame:
    return q.to_df().select(*LINE.split(", "))


@query(f"select {LINE} from lineitem where l_quantity > 45")
def filter_gt(t):
    return line(t.store("lineitem").filter("l_quantity").greater_than(45))


@query(f"select {LINE} from lineitem where l_quantity >= 45")
def filter_gte(t):
    return line(t.store("lineitem").filter("l_quantity").greater_than_or_equal(45))


@query(f"select {LINE} from lineitem where l_extendedprice < 5000")
def filter_lt(t):
    return line(t.store("lineitem").filter("l_extendedprice").less_than(5000))


@query(f"select {LINE} from lineitem where l_extendedprice <= 5000")
def filter_lte(t):
    return line(t.store("lineitem").filter("l_extendedprice").less_than_or_equal(5000))


@query(f"select {CUSTOMER} from customer where c_name >= 'Customer#000000010' and c_name < 'Customer#00000005'")
def filter_string_range(t):
    return t.store("customer").filter("c_name").greater_than_or_equal("Customer#000000010").filter("c_name").less_than("Customer#00000005").to_df()


@query(f"select {ORDERS} from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'")
def filter_timestamp_range(t):
    import datetime as dt

    return t.store("orders").filter("o_orderdate").between(dt.datetime(1995, 1, 1), dt.datetime(1996, 1, 1)).to_df()


@query(f"select {LINE} from lineitem where l_returnflag = 'R' and l_quantity > 30 and l_discount <= 0.05")
def filter_conjunction(t):
    return line(t.store("lineitem").filter("l_returnflag").equals("R").filter("l_quantity").greater_than(30).filter("l_discount").less_than_or_equal(0.05))


@query(f"select {ORDERS} from orders where o_orderkey >= 100 and o_orderkey < 200")
def filter_id(t):
    return t.store("orders").filter("o_orderkey").between(100, 200).to_df()


@query("select l_orderkey, l_linenumber, l_linestatus = 'O' as is_open from lineitem where l_linestatus = 'O'")
def filter_bool(t):
    df = t.df("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linestatus") == "O").alias("is_open"))
    return t.store("lineitem", df).filter("is_open").equals(True).to_df()


def words(t: Tables) -> Query:
    return t.store("documents", t.df("documents").select("doc_id", F.split("text", " ").alias("words")))


@query("select doc_id from documents where list_contains(string_split(text, ' '), 'the')")
def array_contains(t):
    return words(t).filter("words").array_contains("the").to_df().select("doc_id")


@query("select doc_id from documents where list_has_any(string_split(text, ' '), ['idiot', 'clown', 'der'])")
def array_contains_any(t):
    return words(t).filter("words").array_contains_any(["idiot", "clown", "der"]).to_df().select("doc_id")


@query("select doc_id from documents where contains(lower(text), 'license')")
def text_search(t):
    return t.store("documents").filter("text").search("License").to_df().select("doc_id")


def with_k(t: Tables) -> Query:
    return t.store("events", t.df("events").select("event_id", "event_type", scalars.json_field(F.col("props"), "k", "bigint").alias("k")))


@query("select event_id, event_type, json_extract_string(props, '$.k')::bigint as k from events where json_extract_string(props, '$.k')::bigint = 7")
def json_field_eq(t):
    return with_k(t).filter("k").equals(7).to_df()


@query("select event_id, event_type, json_extract_string(props, '$.k')::bigint as k from events where json_extract_string(props, '$.k')::bigint between 20 and 39")
def json_field_range(t):
    return with_k(t).filter("k").between(20, 40).to_df()


PART = "p_partkey, p_name, p_brand, p_size"


def part(q: Query) -> DataFrame:
    return q.to_df().select(*PART.split(", "))


@query(f"select {PART} from part where p_size <> 10")
def cmp_ne(t):
    return part(t.store("part").filter("p_size").not_equals(10))


@query(f"select {PART} from part where p_size in (1, 5, 9)")
def cmp_in(t):
    return part(t.store("part").filter("p_size").is_in([1, 5, 9]))


@query(f"select {PART} from part where p_brand not in ('Brand#11', 'Brand#22')")
def cmp_not_in(t):
    return part(t.store("part").filter("p_brand").not_in(["Brand#11", "Brand#22"]))


@query(f"select {PART} from part where p_name like '%e%'")
def cmp_like(t):
    return part(t.store("part").filter("p_name").like("%e%"))


@query(f"select {PART} from part where starts_with(p_brand, 'Brand#1')")
def cmp_starts_with(t):
    return part(t.store("part").filter("p_brand").starts_with("Brand#1"))


@query(f"select {PART} from part where ends_with(p_brand, '3')")
def cmp_ends_with(t):
    return part(t.store("part").filter("p_brand").ends_with("3"))


@query("select event_id from events where nullif(event_type, 'click') is null")
def cmp_is_null(t):
    df = t.df("events").select("event_id", F.nullif("event_type", F.lit("click")).alias("kind"))
    return t.store("events", df).filter("kind").is_null().to_df().select("event_id")


# --- aggregation


@query("select round(coalesce(sum(l_extendedprice), 0.0), 2) as total from lineitem having count(*) > 0")
def agg_sum(t):
    return rounded(t.store("lineitem").aggregate(total=sum_("l_extendedprice")).to_df(), total=2)


@query("select count(l_orderkey) as n from lineitem")
def agg_count(t):
    return t.store("lineitem").aggregate(n=count("l_orderkey")).to_df()


@query("select round(avg(l_discount), 6) as mean from lineitem")
def agg_avg(t):
    return rounded(t.store("lineitem").aggregate(mean=avg("l_discount")).to_df(), mean=6)


@query("select min(l_shipdate) as first from lineitem")
def agg_min(t):
    return t.store("lineitem").aggregate(first=min_("l_shipdate")).to_df()


@query("select max(l_quantity) as most from lineitem")
def agg_max(t):
    return t.store("lineitem").aggregate(most=max_("l_quantity")).to_df()


@query("select c_mktsegment, min(c_name) as first, max(c_name) as last from customer group by c_mktsegment")
def agg_min_max_string(t):
    return t.store("customer").group_by("c_mktsegment").aggregate(first=min_("c_name"), last=max_("c_name")).to_df()


def nullable_events(t: Tables) -> Query:
    """Clicks have no value and no type."""
    e = t.df("events")
    click = F.col("event_type") == "click"
    return t.store("events", e.select("event_id", "user_id", F.when(~click, F.col("event_type")).alias("kind"), F.when(~click, F.col("value")).alias("value")))


NULLABLE = "(select event_id, user_id, case when event_type <> 'click' then event_type end as kind, case when event_type <> 'click' then value end as value from events)"


@query(f"select count(value) as n, count(kind) as kinds from {NULLABLE}")
def agg_count_non_null(t):
    return nullable_events(t).aggregate(n=count("value"), kinds=count("kind")).to_df()


@query(f"select kind, round(coalesce(sum(value), 0.0), 2) as total, round(avg(value), 6) as mean, min(value) as least from {NULLABLE} group by kind")
def agg_sum_all_null_group(t):
    return rounded(nullable_events(t).group_by("kind").aggregate(total=sum_("value"), mean=avg("value"), least=min_("value")).to_df(), total=2, mean=6)


@query("select case when count(event_type) > 0 then 0.0 end::double as total from events")
def agg_sum_of_text(t):
    return t.store("events").aggregate(total=sum_("event_type")).to_df()


@query("select round(sum(l_quantity), 2) as qty, count(l_orderkey) as n, round(avg(l_extendedprice), 4) as mean, min(l_tax) as least, max(l_tax) as most from lineitem")
def agg_multi(t):
    return rounded(t.store("lineitem").aggregate(qty=sum_("l_quantity"), n=count("l_orderkey"), mean=avg("l_extendedprice"), least=min_("l_tax"), most=max_("l_tax")).to_df(), qty=2, mean=4)


@query("select sum(value) as total, count(value) as n from events where event_type = 'none of these' having count(*) > 0")
def agg_global_empty(t):
    return t.store("events").filter("event_type").equals("none of these").aggregate(total=sum_("value"), n=count("value")).to_df()


@query("select l_returnflag, round(sum(l_quantity), 2) as qty, count(l_orderkey) as n from lineitem group by l_returnflag")
def group_one(t):
    return rounded(t.store("lineitem").group_by("l_returnflag").aggregate(qty=sum_("l_quantity"), n=count("l_orderkey")).to_df(), qty=2)


@query("select l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) as total, count(l_orderkey) as n from lineitem group by l_returnflag, l_linestatus")
def group_two(t):
    return rounded(t.store("lineitem").group_by("l_returnflag", "l_linestatus").aggregate(total=sum_("l_extendedprice"), n=count("l_orderkey")).to_df(), total=2)


@query(f"select kind, count(event_id) as n from {NULLABLE} group by kind")
def group_null_key(t):
    return nullable_events(t).group_by("kind").aggregate(n=count("event_id")).to_df()


@query("select l_linestatus, round(sum(l_quantity), 2) as qty, count(l_orderkey) as n from lineitem where l_returnflag = 'R' group by l_linestatus")
def group_filtered(t):
    return rounded(t.store("lineitem").filter("l_returnflag").equals("R").group_by("l_linestatus").aggregate(qty=sum_("l_quantity"), n=count("l_orderkey")).to_df(), qty=2)


# --- sorting, limits, pages


@query(f"select {ORDERS} from orders order by o_totalprice asc nulls last, o_orderkey limit 25")
def sort_asc_limit(t):
    return t.store("orders").sort_by("o_totalprice").to_df(25)


@query(f"select {ORDERS} from orders order by o_totalprice desc nulls last, o_orderkey limit 25")
def sort_desc_limit(t):
    return t.store("orders").sort_by("o_totalprice", "desc").to_df(25)


@query(f"select event_id, kind from {NULLABLE} order by kind desc nulls last, event_id limit 900")
def sort_nulls_last(t):
    return nullable_events(t).sort_by("kind", "desc").to_df(900).select("event_id", "kind")


@query(f"select {ORDERS} from orders where o_orderstatus = 'F' order by o_orderkey limit 1")
def one_first(t):
    return t.store("orders").filter("o_orderstatus").equals("F").to_df(1)


def pages(t: Tables, orders: list[tuple[str, str]], n: int, start=None, end=None) -> DataFrame:
    return page_rows(t.df("customer"), tuple(Order(*o) for o in orders), n, start, end, "c_custkey")


@query(f"select {CUSTOMER} from customer order by c_name, c_custkey limit 20")
def page_first(t):
    return pages(t, [("c_name", "asc")], 20)


@query(f"select {CUSTOMER} from customer where c_name > 'Customer#000000020' order by c_name, c_custkey limit 20")
def page_next(t):
    return pages(t, [("c_name", "asc")], 20, start=(("Customer#000000020",), False))


@query(f"select {CUSTOMER} from customer where c_name > 'Customer#000000140' and c_name < 'Customer#000000160' order by c_name, c_custkey limit 20")
def page_last(t):
    return pages(t, [("c_name", "asc")], 20, start=(("Customer#000000140",), False), end=(("Customer#000000160",), False))


@query(f"select {CUSTOMER} from customer where c_nationkey < 12 or (c_nationkey = 12 and c_acctbal > 1000) order by c_nationkey desc nulls last, c_acctbal asc nulls first, c_custkey limit 40")
def page_compound(t):
    return pages(t, [("c_nationkey", "desc"), ("c_acctbal", "asc")], 40, start=((12, 1000.0), False))


@query(f"select {CUSTOMER} from customer where c_acctbal >= 5000 order by c_acctbal, c_custkey limit 15")
def page_start_at(t):
    return pages(t, [("c_acctbal", "asc")], 15, start=((5000.0,), True))


@query(f"select {CUSTOMER} from customer where c_nationkey < 3 order by c_nationkey, c_custkey limit 500")
def page_end_before(t):
    return pages(t, [("c_nationkey", "asc")], 500, end=((3,), False))


@query(f"select {CUSTOMER} from customer where c_nationkey >= 20 order by c_nationkey desc, c_custkey limit 500")
def page_end_at(t):
    return pages(t, [("c_nationkey", "desc")], 500, end=((20,), True))


@query(f"select {CUSTOMER} from customer where c_mktsegment = 'BUILDING' and c_acctbal > 2000 order by c_acctbal, c_custkey limit 10")
def page_filtered(t):
    rows = t.store("customer").filter("c_mktsegment").equals("BUILDING").rows()
    return page_rows(rows, (Order("c_acctbal"),), 10, ((2000.0,), False), None, "c_custkey")


@query(f"select event_id, kind from {NULLABLE} where kind is not null order by kind asc nulls first, event_id limit 30")
def page_after_null(t):
    return page_rows(nullable_events(t).rows(), (Order("kind"),), 30, ((None,), False), None, "event_id").select("event_id", "kind")


@query(f"select {EVENTS} from events where event_type = 'view' and value >= 10 and value < 20 order by event_id limit 200")
def use_composition(t):
    views = lambda q: q.filter("event_type").equals("view")
    middling = lambda q: q.filter("value").between(10, 20)
    return events(t).use(views).use(middling).to_df(200)


# --- versions


def change_log(t: Tables) -> DataFrame:
    """Events as versions of their users: an error is a tombstone."""
    return t.df("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("commit_txn_id"), "value", (F.col("event_type") == "error").alias("deleted"))


LOG = "(select user_id as key, event_id as commit_txn_id, value, event_type = 'error' as deleted from events)"


def newest_sql(where: str = "true", more: str = "and not deleted") -> str:
    return f"select key, commit_txn_id, value, deleted from (select *, row_number() over (partition by key order by commit_txn_id desc) as n from {LOG} where {where}) where n = 1 {more}"


@query(newest_sql())
def mvcc_latest(t):
    return versions.visible(change_log(t))


@query(newest_sql("commit_txn_id < 500"))
def mvcc_as_of(t):
    return versions.visible(change_log(t), as_of=500)


@query(newest_sql(more="and deleted"))
def mvcc_tombstone(t):
    return versions.newest(change_log(t)).where("deleted")


@query(newest_sql())
def compact_latest(t):
    return versions.compacted(change_log(t))


@query(f"with l as ({newest_sql(more='')}), o as ({newest_sql('commit_txn_id < 700', '')}) select * from (select * from l union select * from o) where not deleted or commit_txn_id >= 700")
def compact_with_reader(t):
    return versions.compacted(change_log(t), oldest_reader=700)


@query(f"select key, commit_txn_id, value * 2 as value, deleted from ({newest_sql()}) where value >= 50")
def compaction_filter(t):
    return versions.compacted(change_log(t), rule=lambda df: df.where("value >= 50").withColumn("value", F.col("value") * 2))


@query("select event_id, ts, value from events where ts >= (select max(ts) from events) - interval 12 hour")
def ttl_expire(t):
    e = t.df("events").select("event_id", "ts", "value")
    now = e.agg(F.max("ts")).first()[0]
    return versions.unexpired(e, F.lit(now), F.expr("interval 12 hours"))


@query(f"select key, commit_txn_id, value, deleted, case when deleted then 'removed' when coalesce(there, false) then 'modified' else 'added' end as change from (select *, lag(not deleted) over (partition by key order by commit_txn_id) as there from {LOG}) where not deleted or coalesce(there, false)")
def change_feed(t):
    return versions.changes(change_log(t))


# --- keyed writes


def staged_orders(t: Tables) -> DataFrame:
    """Every fifth order written again, every tenth removed, and new ones."""
    o = t.df("orders").select("o_orderkey", "o_totalprice")
    rewritten = o.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), (F.col("o_orderkey") % 10 == 0).alias("deleted"))
    return rewritten.unionByName(o.where("o_orderkey % 7 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice", F.lit(False).alias("deleted")))


STAGED = "(select o_orderkey, o_totalprice + 1 as o_totalprice, o_orderkey % 10 = 0 as deleted from orders where o_orderkey % 5 = 0 union all select -o_orderkey, o_totalprice, false from orders where o_orderkey % 7 = 0)"


@query(f"select o_orderkey, o_totalprice from orders where o_orderkey not in (select o_orderkey from {STAGED}) union all select o_orderkey, o_totalprice from {STAGED} where not deleted")
def write_set_overlay(t):
    return versions.overlaid(t.df("orders").select("o_orderkey", "o_totalprice"), staged_orders(t), "o_orderkey")


@query(f"select o_orderkey, deleted from {STAGED} where o_orderkey in (select o_orderkey from orders)")
def insert_existence_check(t):
    return merging.existing(staged_orders(t), t.df("orders"), "o_orderkey").select("o_orderkey", "deleted")


@query(f"select o_orderkey, o_totalprice from {STAGED} where o_orderkey not in (select o_orderkey from orders)")
def insert_new_only(t):
    return merging.creatable(staged_orders(t), t.df("orders"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("select c_custkey, c_name, c_nationkey + case when c_mktsegment = 'BUILDING' then 5 else 0 end as c_nationkey, c_acctbal, c_mktsegment from customer")
def increment(t):
    return merging.incremented(t.df("customer"), "c_nationkey", 5, F.col("c_mktsegment") == "BUILDING")


def patch(t: Tables) -> DataFrame:
    """New segments for every third customer, null for every sixth, and unknown customers."""
    c = t.df("customer").where("c_custkey % 3 = 0")
    segment = F.when(F.col("c_custkey") % 6 != 0, F.lit("PATCHED")).alias("c_mktsegment")
    return c.select("c_custkey", segment).unionByName(c.where("c_custkey % 9 = 0").select((-1 - F.col("c_custkey")).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment")))


MODIFIED = "select c_custkey, c_name, c_nationkey, c_acctbal, case when c_custkey % 6 = 0 then null when c_custkey % 3 = 0 then 'PATCHED' else c_mktsegment end as c_mktsegment from customer"


@query(MODIFIED)
def merge_modify(t):
    return merging.modified(t.df("customer"), patch(t), "c_custkey")


@query(f"{MODIFIED} union all select -1 - c_custkey, null, null, null, 'NEW' from customer where c_custkey % 9 = 0")
def upsert_merge(t):
    return merging.upserted(t.df("customer"), patch(t), "c_custkey")


@query("select event_id, props as before, '{\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\"}' as merged from events")
def merge_json(t):
    e = t.df("events")
    return e.select("event_id", F.col("props").alias("before"), scalars.merged(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("type")))).alias("merged"))


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 1")
def unique_violations(t):
    return merging.repeated(t.df("orders"), ("o_custkey",))


@query("select doc_id, len(list_filter(list_distinct(w), lambda x: not list_contains(w[1:10], x)))::int as removed, len(list_filter(list_distinct(w[1:10]), lambda x: not list_contains(w, x)))::int as added from (select doc_id, string_split(text, ' ') as w from documents)")
def index_diff(t):
    w = F.split("text", " ")
    removed, added = merging.index_changes(w, F.slice(w, 1, 10))
    return t.df("documents").select("doc_id", F.size(removed).alias("removed"), F.size(added).alias("added"))


# --- validation and sanitising


def checked(df: DataFrame, key: str, column: Column, validator: Validator) -> DataFrame:
    """The key, whether a column passes, and the code of its error."""
    _, error = validator.compile(column)
    return df.select(key, error.isNull().alias("valid"), error["code"].alias("code"))


FAILED = "'custom_refinement_failed'"


def verdict(key: str, table: str, *rules: tuple[str, str]) -> str:
    """SQL for ``checked``: rules (condition of failing, code) in order."""
    code = "case " + " ".join(f"when {bad} then {code}" for bad, code in rules) + " end"
    return f"select {key}, {code} is null as valid, {code} as code from {table}"


@query(verdict("c_custkey", "customer", ("length(c_name) < 18", FAILED), ("not starts_with(c_name, 'Customer#')", FAILED), ("not ends_with(c_name, '1')", FAILED)))
def validate_string(t):
    c = t.df("customer")
    return checked(c, "c_custkey", c.c_name, fg.string().min(18).starts_with("Customer#").ends_with("1"))


@query(verdict("c_custkey", "customer", ("c_acctbal < 0", FAILED), ("c_acctbal > 5000", FAILED), ("c_acctbal <> floor(c_acctbal)", FAILED)))
def validate_number(t):
    c = t.df("customer")
    return checked(c, "c_custkey", c.c_acctbal, fg.number().non_negative().max(5000).int())


@query(verdict("event_id", "events", ("try_cast(json_extract_string(props, '$.k') as double) is null", "'invalid_number'"), ("json_extract_string(props, '$.k')::bigint % 5 <> 0", FAILED)))
def validate_number_text(t):
    e = t.df("events")
    return checked(e, "event_id", scalars.json_field(e.props, "k", "string"), fg.number().multiple_of(5).safe())


@query("select event_id, case json_extract_string(props, '$.k') when '1' then true when '0' then false end as flag from events")
def validate_boolean(t):
    e = t.df("events")
    return e.select("event_id", fg.boolean().compile(scalars.json_field(e.props, "k", "string"))[0].alias("flag"))


@query(verdict("o_orderkey", "orders", ("o_orderdate < timestamp '1994-01-01'", FAILED), ("o_orderdate > timestamp '1997-06-30'", FAILED)))
def validate_date(t):
    o = t.df("orders")
    return checked(o, "o_orderkey", o.o_orderdate, fg.date().min("1994-01-01").max("1997-06-30"))


@query(verdict("doc_id", "(select doc_id, string_split(text, ' ') as w from documents)", ("len(list_filter(w, lambda x: length(x) > 12)) > 0", FAILED), ("len(w) < 20", FAILED)))
def validate_array(t):
    d = t.df("documents")
    return checked(d, "doc_id", F.split(d.text, " "), fg.array(fg.string().max(12)).min(20))


@query(verdict("doc_id", "documents", ("lang not in ('en', 'fr')", "'invalid_enum_value'")))
def validate_enum(t):
    d = t.df("documents")
    return checked(d, "doc_id", d.lang, fg.enum("en", "fr"))


def mail(c: str) -> str:
    return f"replace(lower({c}), '#', case when c_custkey % 2 = 0 then '@' else '#' end)"


@query(verdict("c_custkey", "customer", (f"not regexp_matches({mail('c_name')}, '{EMAIL.replace(chr(39), chr(39) * 2)}')", FAILED)))
def validate_email(t):
    c = t.df("customer")
    return checked(c, "c_custkey", F.expr(mail("c_name")), fg.string().email())


@query(verdict("c_custkey", "customer", (f"not regexp_matches(case when c_custkey % 2 = 0 then '12345678-1234-1234-1234-' || lpad(c_custkey::varchar, 12, '0') else c_name end, '{UUID}')", FAILED)))
def validate_uuid(t):
    c = t.df("customer")
    made = F.when(c.c_custkey % 2 == 0, F.concat(F.lit("12345678-1234-1234-1234-"), F.lpad(c.c_custkey.cast("string"), 12, "0"))).otherwise(c.c_name)
    return checked(c, "c_custkey", made, fg.string().uuid())


@query(verdict("page_id", "pages", ("not regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^\\s/?#]+)?[^\\s]*$')", FAILED), ("not contains(url, '7')", FAILED)))
def validate_url(t):
    p = t.df("pages")
    return checked(p, "page_id", p.url, fg.string().url().includes("7"))


@query("select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then c_mktsegment when length(c_mktsegment) = 9 then lower(c_mktsegment) end as value, case when not (c_mktsegment in ('BUILDING', 'MACHINERY') or length(c_mktsegment) = 9) then 'invalid_union' end as code from customer")
def validate_union(t):
    c = t.df("customer")
    value, error = fg.union(fg.enum("BUILDING", "MACHINERY"), fg.string().lower().length(9)).compile(c.c_mktsegment)
    return c.select("c_custkey", value.alias("value"), error["code"].alias("code"))


@query("select event_id, kind is null or length(kind) >= 5 as valid from " + NULLABLE)
def validate_optional(t):
    e = nullable_events(t).rows()
    return e.select("event_id", fg.string().min(5).optional().compile(e.kind)[1].isNull().alias("valid"))


@query("""
select conv_id, turn, role_, n, codes from (
    select conv_id, turn, case when role in ('user', 'assistant') then role end as role_, length(trim(text)) as n,
           concat_ws(',', case when role not in ('user', 'assistant') then 'role:invalid_enum_value' end, case when length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 200 then 'text:custom_refinement_failed' end) as codes
    from conversations)
""".replace("length(trim(text))", "case when length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 200 then length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) end"))
def validate_object(t):
    shape: ObjectValidator = fg.object(role=fg.enum("user", "assistant"), text=fg.string().trim().min(200))
    out = shape.validated(t.df("conversations"))
    codes = F.concat_ws(",", F.transform("_errors", lambda e: F.concat(e["path"], F.lit(":"), e["code"])))
    return out.select("conv_id", "turn", F.col("role").alias("role_"), F.char_length("text").cast("long").alias("n"), codes.alias("codes"))


@query("select doc_id, md5(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s', '', 'g')) as digest from documents")
def sanitize_string(t):
    d = t.df("documents")
    return d.select("doc_id", F.md5(scalars.sanitized(d.text, trim=True, lower=True, no_space=True)).alias("digest"))


@query("""
select event_id, case when try_cast(json_extract(props, '$.k') as bigint) is null then 'k: required'
                      when json_extract_string(props, '$.k')::bigint % 3 = 0 then 'label: expected STRING, got BIGINT' end as why from events
""")
def schema_validation(t):
    schema = StoreSchema("events", (ColumnDef("k", 1, "INT32", nullable=False), ColumnDef("label", 2, "STRING")))
    e = t.df("events")
    k = scalars.json_field(e.props, "k", "bigint")
    doc = F.when(k % 3 == 0, F.to_json(F.struct(k.alias("k"), k.alias("label")))).otherwise(F.to_json(F.struct(k.alias("k"), F.lit("x").alias("label"))))
    return e.select("event_id", violation(doc, schema).alias("why"))


@query("select doc_id, case when text is null then 0 else 1 end as has_text, octet_length(encode(text))::bigint as n_bytes from documents")
def checksum_and_cipher(t):
    """Texts encrypted with their ids as authenticated data, and decrypted again."""
    d = t.df("documents")
    key, aad = F.lit("0123456789abcdef"), F.col("doc_id").cast("string")
    sealed = d.withColumn("c", scalars.encrypted(F.col("text"), key, aad))
    opened = scalars.decrypted(F.col("c"), key, aad)
    return sealed.select("doc_id", (opened.cast("string") == F.col("text")).cast("int").alias("has_text"), F.octet_length(opened).cast("long").alias("n_bytes"))


# --- replication


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.df("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("version"))
    remote = c.where("c_custkey % 3 <> 1").select("c_custkey", F.concat(F.lit("remote "), "c_name").alias("c_name"), F.lit(12).alias("version"))
    return c.where("c_custkey % 3 <> 0"), remote


SIDES = "with l as (select c_custkey, c_name, c_nationkey as version from customer where c_custkey % 3 <> 0), r as (select c_custkey, 'remote ' || c_name as c_name, 12 as version from customer where c_custkey % 3 <> 1) "


@query(SIDES + "select * from l union all select * from r where c_custkey not in (select c_custkey from l)")
def read_local_first(t):
    return replication.read(*sides(t), "LocalFirst", "c_custkey")


@query(SIDES + "select * from r union all select * from l where c_custkey not in (select c_custkey from r)")
def read_cloud_first(t):
    return replication.read(*sides(t), "CloudFirst", "c_custkey")


@query(SIDES + "select coalesce(l.c_custkey, r.c_custkey) as c_custkey, case when r.c_custkey is null or l.version > r.version then l.c_name else r.c_name end as c_name, case when r.c_custkey is null or l.version > r.version then l.version else r.version end as version from l full join r on l.c_custkey = r.c_custkey")
def conflict_last_write_wins(t):
    return replication.resolved(*sides(t), "c_custkey", "LastWriteWins")


@query(SIDES + "select coalesce(l.c_custkey, r.c_custkey) as c_custkey, coalesce(r.c_name, l.c_name) as c_name, coalesce(r.version, l.version) as version from l full join r on l.c_custkey = r.c_custkey")
def conflict_cloud_wins(t):
    return replication.resolved(*sides(t), "c_custkey", "CloudWins")


# --- the store itself, written and read back


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000")
def stored_documents(t):
    """Orders written as JSON documents to a new database and queried by their fields."""
    from fernstore.sources.scratch import scratch_database

    db = scratch_database(t.spark)
    db.write_frame("orders", t.df("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    q = db.store("orders").with_fields("o_orderkey bigint, o_orderstatus string, o_totalprice double").query()
    return q.filter("o_orderstatus").equals("F").filter("o_totalprice").greater_than(100000).to_df().select("o_orderkey", "o_orderstatus", "o_totalprice")


import fernstore.stored_queries  # noqa: E402,F401  registers its queries beside these
