"""The fluent API on small golden tables."""

import random

import pytest
from pyspark.sql import functions as F

from fernstore.errors import IndexRequired, InvalidPath, NotSupported
from fernstore.functions import paths
from fernstore.operators.aggregates import Aggregate, count, max_, min_, sum_
from fernstore.operators.paging import Order, page
from fernstore.plans.query import Query


def query(spark, rows, ddl, **options):
    df = spark.createDataFrame(rows, ddl)
    return Query(lambda: df, df.columns[0], **options)


SALES = [("sale1", "NA", "electronics", 10, 1200.5, 100), ("sale2", "NA", "books", 100, 1500.0, 200), ("sale3", "EU", "electronics", 5, 800.0, 300), ("sale4", "EU", "apparel", 50, 2500.0, 400), ("sale5", "NA", "electronics", 8, 950.5, 500), ("sale6", "APAC", "books", 200, 2200.0, 600), ("sale7", "EU", "electronics", 7, 990.0, 700)]


@pytest.fixture(scope="module")
def sales(spark):
    return query(spark, SALES, "key string, region string, product_category string, units_sold bigint, total_price double, product_id bigint")


def test_aggregates(sales):
    assert sales.aggregate(t=sum_("units_sold")).take() == [{"t": 380.0}]
    got = {r["region"]: (r["s"], r["n"]) for r in sales.group_by("region").aggregate(s=sum_("total_price"), n=count("product_id")).take()}
    assert got == {"APAC": (2200.0, 1), "EU": (4290.0, 3), "NA": (3651.0, 3)}
    got = {r["region"]: r["s"] for r in sales.filter("product_category").equals("electronics").group_by("region").aggregate(s=sum_("total_price")).take(1)}
    assert got == {"EU": 1790.0, "NA": 2151.0}  # take's limit doesn't apply
    assert sales.filter("region").equals("none").aggregate(s=sum_("units_sold")).take() == []


def test_aggregate_errors(sales):
    with pytest.raises(ValueError, match="one\\(\\) cannot be used with an aggregation query. Use .take"):
        sales.group_by("region").aggregate(s=sum_("units_sold")).one()
    with pytest.raises(ValueError, match="at least one aggregation"):
        sales.aggregate()
    with pytest.raises(NotSupported):
        sales.group_by("region").take()
    with pytest.raises(ValueError, match="sortBy"):
        sales.group_by("region").sort_by("region")
    with pytest.raises(TypeError):
        Aggregate("median", "x")
    with pytest.raises(Exception, match="nowhere"):
        sales.filter("nowhere").equals(1).take()


def test_pipes_nulls_and_empty_texts_stay_apart(spark):
    q = query(spark, [(1, "a|b", "c"), (2, "a", "b|c"), (3, None, ""), (4, "NULL", "")], "key int, x string, y string")
    assert len(q.group_by("x", "y").aggregate(n=count("key")).take()) == 4


EMPLOYEES = [("e1", "Alice", 5, "eng", 100000), ("e2", "Bob", 3, "sales", 80000), ("e3", "Charlie", 7, "eng", 140000), ("e4", "Diane", 5, "sales", 110000), ("e5", "Eve", 8, "eng", 180000), ("e6", "Frank", 2, "hr", 75000)]


def test_ranges_and_sorts(spark):
    q = query(spark, EMPLOYEES, "key string, name string, level bigint, department string, salary bigint")
    names = lambda q: [d["name"] for d in q.take()]
    assert names(q.filter("level").greater_than(5)) == ["Charlie", "Eve"]
    assert names(q.filter("level").greater_than_or_equal(5)) == ["Alice", "Charlie", "Diane", "Eve"]
    assert names(q.filter("level").less_than(5)) == ["Bob", "Frank"]
    assert names(q.filter("level").less_than_or_equal(5)) == ["Alice", "Bob", "Diane", "Frank"]
    assert names(q.filter("level").greater_than_or_equal(5).sort_by("level", "desc")) == ["Eve", "Charlie", "Alice", "Diane"]
    assert names(q.filter("level").greater_than_or_equal(5).filter("department").equals("eng")) == ["Alice", "Charlie", "Eve"]
    assert names(q.filter("level").greater_than(10)) == names(q.filter("salary").less_than(50000)) == []
    assert q.sort_by("level").one()["name"] == "Frank"  # sorted, then limited
    assert q.filter("name").equals("Bob").count() == 1 and not q.filter("name").equals("Bo").exists()


def test_composition_leaves_the_query_as_it_was(spark):
    q = query(spark, [("u1", "Alice", "active", "us-east", 5), ("u2", "Bob", "pending", "us-west", 3), ("u3", "Charlie", "active", "us-west", 7), ("u4", "Diane", "active", "us-east", 2)], "key string, name string, status string, region string, level bigint")
    active = lambda q: q.filter("status").equals("active")
    east = lambda q: q.filter("region").equals("us-east")
    assert [d["name"] for d in q.use(active).take()] == ["Alice", "Charlie", "Diane"]
    assert [d["name"] for d in q.use(active).use(east).filter("level").greater_than(3).take()] == ["Alice"]
    assert [d["level"] for d in q.filter("level").greater_than(0).sort_by("level", "desc").take()] == [7, 5, 3, 2]
    assert q.conditions == ()


PRODUCTS = [("p1", "Laptop", ["electronics", "computer", "sale"], [13, 15]), ("p2", "Monitor", ["electronics", "display", "bestseller"], [24, 27]), ("p3", "Desk Chair", ["office", "furniture"], []), ("p4", "Mouse", ["electronics", "computer", "accessory", "bestseller", "home"], [1, 2]), ("p5", "Bad Keyboard", None, [1])]


def test_arrays(spark):
    q = query(spark, PRODUCTS, "key string, name string, tags array<string>, sizes array<bigint>")
    names = lambda q: [d["name"] for d in q.take()]
    assert names(q.filter("tags").array_contains("electronics")) == ["Laptop", "Monitor", "Mouse"]
    assert names(q.filter("sizes").array_contains(24)) == ["Monitor"]
    assert names(q.filter("tags").array_contains("apparel")) == []
    assert names(q.filter("tags").array_contains_any(["sale", "bestseller"])) == ["Laptop", "Monitor", "Mouse"]
    assert names(q.filter("sizes").array_contains_any([13, 27])) == ["Laptop", "Monitor"]
    assert names(q.filter("tags").array_contains_any(["bestseller", "home"])) == ["Monitor", "Mouse"]
    assert names(q.filter("sizes").array_contains(1).filter("tags").array_contains("home")) == ["Mouse"]
    for bad in (lambda f: f.array_contains(["x"]), lambda f: f.array_contains_any("x"), lambda f: f.array_contains_any([])):
        with pytest.raises(TypeError):
            bad(q.filter("tags"))
    with pytest.raises(TypeError):
        q.where("tags", "~=", 1)


def test_strict_mode_wants_an_index(spark):
    indexes = ({"name": "i", "fields": ["status"], "multikey": False}, {"name": "t", "fields": ["tags"], "multikey": True}, {"name": "c", "fields": ["region", "status"], "multikey": False})
    q = query(spark, [("u1", "a", "x", ["t"])], "key string, status string, region string, tags array<string>", strict=True, indexes=indexes)
    assert len(q.filter("status").equals("a").take()) == len(q.filter("tags").array_contains("t").take()) == len(q.take()) == 1
    assert len(q.filter("region").equals("x").filter("status").equals("a").take()) == 1
    for field in ("region", "tags"):
        with pytest.raises(IndexRequired, match="Query requires an index on at least one of the filter fields"):
            q.filter(field).equals("x").take()


STAFF = [("1", "Alice", 7, 1672531200), ("2", "Bob", 5, 1675209600), ("3", "Charlie", 7, 1677628800), ("4", "Diane", 5, 1680307200), ("5", "Eve", 8, 1682899200), ("6", "Frank", 3, 1685577600), ("7", "Grace", 7, 1688169600)]


def test_pages(spark):
    q = query(spark, STAFF, "key string, name string, level bigint, hireDate bigint")
    names = lambda p: [d["name"] for d in p.docs]
    by_name = q.order_by("name").limit(3)
    p = by_name.get()
    assert (names(p), p.has_next_page, p.has_prev_page, p.end_cursor) == (["Alice", "Bob", "Charlie"], True, False, ["Charlie"])
    p = by_name.start_after(*p.end_cursor).get()
    assert (names(p), p.has_next_page, p.has_prev_page) == (["Diane", "Eve", "Frank"], True, True)
    p = by_name.start_after(*p.end_cursor).get()
    assert (names(p), p.has_next_page, p.end_cursor) == (["Grace"], False, ["Grace"])
    p = by_name.start_after("Zebra").get()
    assert (names(p), p.has_next_page, p.end_cursor) == ([], False, None)
    two = q.order_by("level", "desc").order_by("name").limit(4)
    p = two.get()
    assert (names(p), p.end_cursor) == (["Eve", "Alice", "Charlie", "Grace"], [7, "Grace"])
    assert names(two.start_after(7, "Grace").get()) == ["Bob", "Diane", "Frank"]
    doc = q.filter("name").equals("Bob").one()
    assert names(q.order_by("hireDate").limit(2).start_after(doc).get()) == ["Charlie", "Diane"]
    assert names(by_name.start_at("Bob").end_before("Diane").get()) == ["Bob", "Charlie"]
    assert names(by_name.end_at("Bob").get()) == ["Alice", "Bob"]
    assert names(q.filter("level").equals(7).order_by("name").limit(2).get()) == ["Alice", "Charlie"]
    for bad, kind in ((lambda: q.limit(0), TypeError), (lambda: q.start_at(1), ValueError), (lambda: q.limit(2).get(), ValueError), (lambda: q.order_by("name").get(), ValueError), (lambda: q.order_by("name").start_after({"x": 1}), ValueError), (lambda: q.order_by("name", "up"), TypeError)):
        with pytest.raises(kind):
            bad()


def test_pages_against_a_model(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for i in range(60)]
    df = spark.createDataFrame(rows, "key int, x int, y string").cache()
    for dirs in (("asc", "asc"), ("desc", "asc"), ("asc", "desc"), ("desc", "desc")):
        def order(r, dirs=dirs):
            out = []
            for v, d in zip(r[1:], dirs, strict=True):
                n = -1 if v is None else (v if isinstance(v, int) else ord(v))
                out.append(n if d == "asc" else -n)
            return tuple(out)

        want = sorted(rows, key=lambda r: (*order(r), r[0]))
        cursor = rng.choice(rows)
        orders = (Order("x", dirs[0]), Order("y", dirs[1]))
        got = page(df, orders, 100, start=(cursor[1:], False))
        assert [d["key"] for d in got.docs] == [r[0] for r in want if order(r) > order(cursor)]
        got = page(df, orders, 100, end=(cursor[1:], True))
        assert [d["key"] for d in got.docs] == [r[0] for r in want if order(r) <= order(cursor)]


def test_random_queries_against_a_model(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, *range(5)]), rng.choice([None, "a", "ab", "b"]), rng.random() * 10) for i in range(80)]
    q = query(spark, rows, "key int, n int, s string, d double")
    test = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
    for _ in range(12):
        conditions = [(f, rng.choice(list(test)), v) for f, v in rng.sample([("n", rng.randrange(5)), ("s", rng.choice(["a", "ab", "b"])), ("d", rng.random() * 10)], rng.randrange(1, 4))]
        run = q
        for c in conditions:
            run = run.where(*c)
        place = {"n": 1, "s": 2, "d": 3}
        want = [r for r in rows if all(r[place[f]] is not None and test[op](r[place[f]], v) for f, op, v in conditions)]
        assert [d["key"] for d in run.take()] == [r[0] for r in want]
        if want:
            got = run.aggregate(n=count("n"), low=min_("s"), high=max_("d")).take()[0]
            assert got == {"n": sum(r[1] is not None for r in want), "low": min((r[2] for r in want if r[2] is not None), default=None), "high": max(r[3] for r in want)}


def test_plans_push_filters_and_prune_columns(spark):
    q = Query(lambda: spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), "l_orderkey").filter("l_returnflag").equals("R").group_by("l_linestatus").aggregate(s=sum_("l_quantity"))
    plan = q.explain()
    assert "EqualTo(l_returnflag,R)" in plan and "l_comment" not in plan and "l_extendedprice" not in plan
    assert plan.count("HashAggregate") >= 2
    top = Query(lambda: spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey").sort_by("o_totalprice").to_df(5)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().toString()


def test_paths(spark):
    assert paths.document_key("users/", "/u1") == "users/u1" and len(paths.random_id()) == 20
    assert paths.root("a/b/c") == "a" and paths.root("a") == "_root" and paths.parent("a/b/c/d") == "a/b/c"
    for bad in (lambda: paths.check_store("a/b"), lambda: paths.check_document("a/b/c"), lambda: paths.document_key("", "x"), lambda: paths.document_key("x", "")):
        with pytest.raises(InvalidPath):
            bad()
    keys = ["users/u1", "users/u1/posts/p1", "users2/u1", "users/u2", "users/u1/posts_meta"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    assert sorted(r.key for r in df.where(paths.is_child(F.col("key"), "users")).collect()) == ["users/u1", "users/u2"]
