"""Registered queries that go through the database itself: documents are written, changed, maintained and read back.

Each works in a database of its own in the shared folder, over a whole table, and is compared with SQL over that table.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernstore.errors import Conflict, DuplicateKey, KeyNotFound, NotSupported, SchemaViolation
from fernstore.functions import scalars
from fernstore.functions.validators import fg, form_data
from fernstore.operators import replication
from fernstore.operators.aggregates import avg, count, max_, min_, sum_
from fernstore.queries import Tables, query
from fernstore.sources.database import Database, increment
from fernstore.sources.scratch import scratch_database
from fernstore.streaming.feed import ingest_stream, on_collection, on_snapshot
from fernstore.streaming.provider import DatabaseProvider
from fernstore.streaming.replicas import ReplicatedStore, retry_outbox


def nations(t: Tables) -> tuple[Database, list[Any]]:
    """A database with the nations as documents, committed as one batch, and their rows."""
    db, rows = scratch_database(t.spark), t.df("nation").orderBy("n_nationkey").collect()
    batch = db.batch()
    for r in rows:
        batch.make("nations", str(r.n_nationkey), {"name": r.n_name, "region": r.n_regionkey, "visits": r.n_nationkey})
    batch.commit()
    return db, rows


def customers(t: Tables, schema: bool = False) -> Database:
    """A database with the customers as documents, written in parallel."""
    db = scratch_database(t.spark)
    if schema:
        db.register_schema("customers", [{"name": "c_name", "column_id": 1, "type": "STRING"}, {"name": "c_nationkey", "column_id": 2, "type": "INT32"}, {"name": "c_acctbal", "column_id": 3, "type": "DOUBLE"}])
    db.write_frame("customers", t.df("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), "c_custkey")
    return db


def shown(db: Database, store: str = "nations", fields: str = "name string, region int, visits int") -> DataFrame:
    q = db.store(store).with_fields(fields).query()
    return q.to_df().select("id", *(f.split()[0] for f in fields.split(", ")))


NATION = "n_nationkey::varchar as id, n_name as name, n_regionkey as region"


@query(f"select {NATION}, n_nationkey as visits from nation")
def store_batch(t):
    return shown(nations(t)[0])


@query("select case when n_nationkey = 3 then 'again' else n_name end as name, n_nationkey::varchar as id, case when n_nationkey <> 3 then n_regionkey end as region, case when n_nationkey <> 3 then n_nationkey end as visits from nation")
def store_make_and_set(t):
    """Making what exists fails and changes nothing; setting overwrites."""
    db, _ = nations(t)
    for key in ("3", "4"):
        try:
            db.store("nations").item(key).make({"name": "made"})
        except DuplicateKey:
            pass
    db.store("nations").item("3").set({"name": "again"})
    return shown(db)


@query("select n_nationkey::varchar as id, case when n_regionkey = 1 then lower(n_name) else n_name end as name, n_regionkey as region, n_nationkey + case when n_regionkey = 1 then 10 else 0 end as visits from nation union all select 'new', 'upserted', null, null")
def store_modify_upsert_increment(t):
    db, rows = nations(t)
    with db.transaction() as tx:
        for r in rows:
            if r.n_regionkey == 1:
                tx.modify(f"nations/{r.n_nationkey}", {"name": r.n_name.lower(), "visits": increment(7)})
                tx.modify(f"nations/{r.n_nationkey}", {"visits": increment(3)})
        tx.upsert("nations/new", {"name": "upserted"})
    return shown(db)


@query(f"select {NATION}, n_nationkey as visits from nation where n_regionkey <> 2")
def store_remove(t):
    db, rows = nations(t)
    batch = db.batch()
    for r in rows:
        if r.n_regionkey == 2:
            batch.remove("nations", str(r.n_nationkey))
    batch.commit()
    return shown(db)


@query(f"select {NATION}, n_nationkey as visits from nation")
def store_failed_batch(t):
    """A batch of which one step fails changes nothing."""
    db, _ = nations(t)
    try:
        db.batch().remove("nations", "1").make("nations", "2", {"name": "x"}).commit()
    except DuplicateKey:
        return shown(db)
    raise AssertionError("the batch was committed")


@query("select c_custkey::varchar as id, c_name, c_acctbal from customer")
def store_ingest_file(t):
    """A sorted file built from a table and added to a store as it is."""
    db = scratch_database(t.spark)
    c = t.df("customer")
    path = f"{db.files.root}/in"
    db.build_sorted_file(c.select(F.concat(F.lit("customers/"), F.col("c_custkey").cast("string")).alias("key"), F.to_json(F.struct("c_name", "c_acctbal")).alias("value")), path, strict=True)
    db.ingest_file("customers", path, strict=False)
    return shown(db, "customers", "c_name string, c_acctbal double")


@query("select c_custkey::varchar as id, c_name from customer where c_custkey in (7, 70)")
def store_point_reads(t):
    db = customers(t)
    found = [db.store("customers").item(k).one() for k in ("7", "70", "none")]
    return t.spark.createDataFrame([(d["id"], d["c_name"]) for d in found if d], "id string, c_name string")


@query("select true as there, false as absent, false as removed")
def store_exists(t):
    db, _ = nations(t)
    store = db.store("nations")
    store.item("9").remove()
    return t.spark.createDataFrame([(store.item("1").exists(), store.item("x").exists(), store.item("9").exists())], "there boolean, absent boolean, removed boolean")


@query("select 'regions/' || r_name || '/nations/' || n_name as key from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'")
def store_prefix(t):
    """Stores below documents: a prefix gives direct children only."""
    db = scratch_database(t.spark)
    rows = t.df("nation").join(t.df("region"), F.col("n_regionkey") == F.col("r_regionkey")).collect()
    with db.transaction() as tx:
        for r in rows:
            tx.set(f"regions/{r.r_name}", {"k": r.r_regionkey})
            tx.set(f"regions/{r.r_name}/nations/{r.n_name}", {"k": r.n_nationkey})
            tx.set(f"regions/{r.r_name}/nations/{r.n_name}/notes/1", {})
    return db.as_of(db.catalog.last() + 1).get_prefix("regions/ASIA/nations").select("key")


@query(f"select {NATION}, n_nationkey as visits from nation")
def store_snapshot(t):
    """A reader keeps what was committed when it began, whatever is written later."""
    db, _ = nations(t)
    reader = db.as_of(db.catalog.last() + 1)
    db.store("nations").item("1").remove()
    db.store("nations").item("2").modify({"name": "later"})
    return reader.query("nations", "name string, region int, visits int").to_df().select("id", "name", "region", "visits")


@query("select n_nationkey::varchar as id, case when n_nationkey = 2 then 'staged' else n_name end as name from nation where n_nationkey <> 1")
def store_own_writes(t):
    """A transaction reads its own writes; dropped, it leaves nothing."""
    db, _ = nations(t)
    try:
        with db.transaction() as tx:
            tx.remove("nations/1")
            tx.modify("nations/2", {"name": "staged"})
            seen = tx.query("nations", "name string").to_df().select("id", "name").collect()
            raise RuntimeError
    except RuntimeError:
        assert db.store("nations").item("1").exists()
    return t.spark.createDataFrame(seen, "id string, name string")


@query("select 'Conflict' as first, 'KeyNotFound' as second, 'SchemaViolation' as third, 'DuplicateKey' as fourth")
def store_refusals(t):
    db, _ = nations(t)
    db.register_schema("typed", [{"name": "n", "column_id": 1, "type": "INT32", "nullable": False}])
    db.create_index("nations", "by_name", "name", unique=True)

    def refused(fn) -> str:
        try:
            fn()
        except (Conflict, DuplicateKey, KeyNotFound, SchemaViolation) as e:
            return type(e).__name__
        return "none"

    def late(tx):
        tx.modify("nations/1", {"name": "one"})
        db.store("nations").item("1").modify({"name": "two"})

    names = [refused(lambda: db.run(late, first_committer_wins=True)), refused(lambda: db.store("nations").item("x").modify({"a": 1})), refused(lambda: db.store("typed").item("1").make({"n": "text"})), refused(lambda: db.store("nations").item("2").modify({"name": "two"}))]
    return t.spark.createDataFrame([tuple(names)], "first string, second string, third string, fourth string")


@query(f"select {NATION}, n_nationkey + 1 as visits from nation where n_nationkey <> 4")
def store_compact(t):
    """Stores of several folders are rewritten; then no folder holds more than the newest versions."""
    db, rows = nations(t)
    db.run(lambda tx: [tx.modify(f"nations/{r.n_nationkey}", {"visits": increment(1)}) for r in rows])
    db.store("nations").item("4").remove()
    db.store("other").item("1").make({"name": "x"})
    assert db.compact(runs=2) == ["nations"] and db.folders()["nations"] == 1 and db.folders()["other"] == 1
    db.vacuum()
    return shown(db)


@query(f"select {NATION}, n_nationkey as visits from nation where n_regionkey <> 3 and n_nationkey <> 0")
def store_compact_with_rule(t):
    db, _ = nations(t)
    db.store("nations").item("0").remove()
    db.compact(rule=lambda df: df.where(scalars.json_field(F.col("value"), "region", "int") != 3))
    return shown(db)


@query("select c_custkey::varchar as id, c_name, c_acctbal from customer where c_nationkey = 5 and c_acctbal > 0")
def store_typed_columns(t):
    """Declared fields are stored as columns; after an index with backfill a filter on them reaches the scan."""
    db = customers(t, schema=True)
    db.create_index("customers", "by_nation", "c_nationkey", backfill=True)
    return db.store("customers").filter("c_nationkey").equals(5).filter("c_acctbal").greater_than(0).to_df().select("id", "c_name", "c_acctbal")


@query("select c_custkey::varchar as id, case when c_custkey = 8 then 'later' else c_name end as c_name from customer where c_nationkey >= 20 or c_custkey = 8")
def store_typed_versions(t):
    """Typed columns over several versions of a document."""
    db = customers(t, schema=True)
    db.store("customers").item("8").modify({"c_name": "later", "c_nationkey": 24})
    return db.store("customers").filter("c_nationkey").greater_than_or_equal(20).to_df().select("id", "c_name")


@query("select * from (values ('by_region', false, false), ('idx_default_nations_name', false, false), ('tags', false, true)) v(name, is_unique, multikey)")
def store_indexes(t):
    db, _ = nations(t)
    made = [db.create_index("nations", "by_region", ["region"]), db.create_index("nations", "by_region", ["region"]), db.create_index("nations", "tags", "tags", multikey=True), db.create_index("nations", "gone", "x")]
    assert made == ["CREATED", "EXISTED", "CREATED", "CREATED"] and db.delete_index("gone") and not db.delete_index("gone")
    return t.spark.createDataFrame([(i["name"], i["unique"], i["multikey"]) for i in Database(t.spark, db.files.root).list_indexes("nations")], "name string, is_unique boolean, multikey boolean")


@query("select true as mine_refused, count(*) as documents from nation")
def store_unique_across_handles(t):
    """An index that one handle makes binds another that was opened before."""
    db, _ = nations(t)
    other = Database(t.spark, db.files.root)
    db.create_index("nations", "by_name", "name", unique=True)
    try:
        other.store("nations").item("new").make({"name": "NATION_1"})
        refused = False
    except DuplicateKey:
        refused = True
    return t.spark.createDataFrame([(refused, db.store("nations").query().count())], "mine_refused boolean, documents long")


@query("select * from (values (1, ['nations'], false), (2, ['nations'], false), (3, ['other'], false)) v(txn, stores, replaces)")
def store_commits(t):
    db, _ = nations(t)
    db.store("nations").item("1").modify({"visits": 0})
    db.checkpoint()
    db.store("other").item("1").make({})
    again = Database(t.spark, db.files.root)
    assert [c["txn"] for c in again.checkpoint_history()] == [2]
    return again.commits().select(F.col("txn").cast("int").alias("txn"), "stores", "replaces")


@query("select 'nations' as store_path, count(*) as keys, count(*) + 2 as versions, 1 as tombstones from nation")
def store_statistics(t):
    db, _ = nations(t)
    db.store("nations").item("1").remove()
    db.store("nations").item("2").modify({"visits": 0})
    assert db.engine_stats()["commits"] == 3 and db.engine_stats()["stores"] == {"nations": 3}
    return db.stats().select("store_path", "keys", "versions", F.col("tombstones").cast("int").alias("tombstones"))


@query("select count(*) as before, count(*) + 1 as after, 1 as hits from nation")
def store_cached(t):
    db, _ = nations(t)
    before = db.cached("nations").count()
    db.cached("nations")
    db.store("nations").item("new").make({})
    after = db.cached("nations").count()
    hits = db.cache.hits
    db.close()
    return t.spark.createDataFrame([(before, after, hits)], "before long, after long, hits int")


@query("select 'nations/' || n_nationkey as key, 'added' as change, n_name as name from nation union all select 'nations/1', 'modified', 'changed' union all select 'nations/2', 'removed', null")
def listener_of_a_store(t):
    db, _ = nations(t)
    db.store("nations").item("1").modify({"name": "changed"})
    db.store("nations").item("2").remove()
    got: list[dict] = []
    on_collection(db, "nations", got.extend, f"{db.files.root}/_listener")
    return t.spark.createDataFrame([(c["key"], c["change"], c["doc"] and c["doc"]["name"]) for c in got], "key string, change string, name string")


@query("select * from (values (1, 'NATION_1'), (2, 'two'), (3, null)) v(n, name)")
def listener_of_a_document(t):
    db, _ = nations(t)
    got: list = []
    db.store("nations").item("1").modify({"name": "two"})
    db.store("nations").item("1").remove()
    on_snapshot(db, "nations/1", got.append, f"{db.files.root}/_listener")
    return t.spark.createDataFrame([(i + 1, d and d["name"]) for i, d in enumerate(got)], "n int, name string")


@query("select c_custkey::varchar as id, c_name, c_acctbal from customer")
def stream_into_a_store(t):
    db = scratch_database(t.spark)
    source = f"{db.files.root}/in"
    t.df("customer").select("c_custkey", "c_name", "c_acctbal").write.parquet(source)
    stream = t.spark.readStream.schema("c_custkey long, c_name string, c_acctbal double").parquet(source)
    ingest_stream(db, "customers", stream, "c_custkey", f"{db.files.root}/_in").awaitTermination()
    return shown(db, "customers", "c_name string, c_acctbal double")


class Remote:
    """A remote side in memory, which may be out of reach."""

    def __init__(self):
        self.docs: dict[str, dict] = {}
        self.down = False

    def get(self, key):
        return self.docs.get(key)

    def set(self, key, data):
        if self.down:
            raise ConnectionError("out of reach")
        self.docs[key] = data

    def remove(self, key):
        if self.down:
            raise ConnectionError("out of reach")
        self.docs.pop(key, None)

    def on_snapshot(self, key, callback):
        return lambda: None


@query("select 'nations/' || r_regionkey as key, lower(r_name) as name, 1 as replayed_at_least from region where r_regionkey <> 2")
def replica_outbox(t):
    """Writes that the remote side missed wait in the outbox, mapped on their way, and are replayed."""
    db, remote = scratch_database(t.spark), Remote()
    store = ReplicatedStore(db, "nations", remote, to_cloud=lambda d: {**d, "name": d["name"].lower()})
    rows = t.df("region").orderBy("r_regionkey").collect()
    for r in rows:
        remote.down = r.r_regionkey % 2 == 1
        store.set(str(r.r_regionkey), {"name": r.r_name})
    remote.down = False
    store.remove("2")
    replayed = retry_outbox(db, remote)
    assert db.store("_outbox").take() == []
    return t.spark.createDataFrame([(k, d["name"], min(replayed, 1)) for k, d in remote.docs.items()], "key string, name string, replayed_at_least int")


@query("select 'two' as local, 'two' as remote, false as local_after_failure, 'far' as filled, true as listing_refused")
def replica_strategies(t):
    """Two-phase writes, modify and upsert through both sides, a remote document that fills the local store, and what CloudOnly refuses."""
    db, remote = scratch_database(t.spark), Remote()
    store = ReplicatedStore(db, "s", remote, write="TwoPhaseCommit")
    store.set("1", {"name": "one"})
    store.modify("1", {"name": "two"})
    remote.down = True
    try:
        store.upsert("2", {"name": "x"})
    except ConnectionError:
        remote.down = False
    remote.docs["s/9"] = {"name": "far", "id": "9"}
    store.one("9")
    try:
        ReplicatedStore(db, "s", remote, read="CloudOnly").take()
        refused = False
    except NotImplementedError:
        refused = True
    row = (db.store("s").item("1").one()["name"], remote.docs["s/1"]["name"], db.store("s").item("2").exists(), db.store("s").item("9").one()["name"], refused)
    return t.spark.createDataFrame([row], "local string, remote string, local_after_failure boolean, filled string, listing_refused boolean")


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.df("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("version"))
    return c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 3 <> 1").select("c_custkey", F.concat(F.lit("remote "), "c_name").alias("c_name"), F.lit(12).alias("version"))


@query("select c_custkey, c_name, c_nationkey as version from customer where c_custkey % 3 <> 0")
def read_local_only(t):
    return replication.read(*sides(t), "LocalOnly", "c_custkey")


@query("select c_custkey, 'remote ' || c_name as c_name, 12 as version from customer where c_custkey % 3 <> 1")
def read_cloud_only(t):
    return replication.read(*sides(t), "CloudOnly", "c_custkey")


@query("select c_custkey, case when c_custkey % 3 = 0 then 'remote ' || c_name else c_name end as c_name, case when c_custkey % 3 = 2 then c_nationkey + 12 when c_custkey % 3 = 0 then 12 else c_nationkey end as version from customer")
def conflict_by_function(t):
    merge = lambda local, remote: F.struct(local["c_name"].alias("c_name"), (local["version"] + remote["version"]).alias("version"))
    return replication.resolved(*sides(t), "c_custkey", merge)


# --- fields of several types: a third each of numbers, texts and booleans, and every tenth missing


def mixed(t: Tables):
    db = scratch_database(t.spark)
    c = t.df("customer")
    k = F.col("c_custkey")
    value = F.when(k % 10 == 0, F.to_json(F.struct(k.alias("k")))).when(k % 3 == 0, F.to_json(F.struct(k.alias("k"), F.col("c_nationkey").alias("v")))).when(k % 3 == 1, F.to_json(F.struct(k.alias("k"), F.col("c_mktsegment").alias("v")))).otherwise(F.to_json(F.struct(k.alias("k"), (k % 2 == 0).alias("v"))))
    path = f"{db.files.root}/in"
    c.select(F.concat(F.lit("mixed/"), k.cast("string")).alias("key"), value.alias("value")).write.parquet(path)
    db.ingest_file("mixed", path, strict=False)
    return db.store("mixed").query()


MIXED = "(select c_custkey as k, 'mixed/' || c_custkey as key, case when c_custkey % 10 = 0 then 0 when c_custkey % 3 = 0 then 1 when c_custkey % 3 = 1 then 2 else 3 end as kind, case when c_custkey % 10 <> 0 and c_custkey % 3 = 0 then c_nationkey else 0 end as num, case when c_custkey % 10 <> 0 and c_custkey % 3 = 1 then c_mktsegment else '' end as txt, case when c_custkey % 10 <> 0 and c_custkey % 3 = 2 then c_custkey % 2 = 0 else false end as flag from customer)"


@query(f"select sum(num)::double as s, sum(num)::double / count_if(kind > 0) as a, count_if(kind > 0) as n, min(num) filter (where kind = 1)::varchar as low, (case when bool_or(flag) then 'true' else 'false' end) as high from {MIXED}")
def agg_mixed(t):
    out = mixed(t).aggregate(s=sum_("v"), a=avg("v"), n=count("v"), low=min_("v"), high=max_("v")).to_df()
    return out.select("s", "a", "n", *(F.expr(f"try_variant_get({c}, '$', 'string')").alias(c) for c in ("low", "high")))


@query(f"select case kind when 1 then num::varchar when 2 then txt when 3 then flag::varchar end as v, count(*) as n, sum(k)::double as s from {MIXED} group by kind, num, txt, flag")
def group_mixed(t):
    out = mixed(t).group_by("v").aggregate(n=count("k"), s=sum_("k")).to_df()
    return out.select(F.expr("try_variant_get(v, '$', 'string')").alias("v"), "n", "s")


@query(f"select key, row_number() over (order by kind, num, txt, flag, k) as place from {MIXED} qualify place <= 30")
def page_next_mixed(t):
    """Three pages of ten, each from the cursor of the one before."""
    q, keys = mixed(t).order_by("v").order_by("k").limit(10), []
    ordered = q.get()
    while True:
        keys += [d["key"] for d in ordered.docs]
        if len(keys) >= 30:
            break
        ordered = q.start_after(*ordered.end_cursor).get()
    return t.spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "key string, place long")


@query(f"select key, row_number() over (order by kind desc, num desc, txt desc, flag desc, k) as place from {MIXED} qualify place <= 30")
def page_next_mixed_desc(t):
    q, keys = mixed(t).order_by("v", "desc").order_by("k").limit(15), []
    first = q.get()
    keys = [d["key"] for d in first.docs] + [d["key"] for d in q.start_after(first.docs[-1]).get().docs]
    return t.spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "key string, place long")


@query("with p as (select n_name as name, ((row_number() over (order by n_name) - 1) // 4)::int as page, count(*) over () as n from nation) select page, max(name) as last_name, count(*) as docs, (page + 1) * 4 < max(n) as has_next, page > 0 as has_prev from p group by page")
def page_envelopes(t):
    """All pages of a store one after another, a document as the cursor of the next."""
    db, _ = nations(t)
    q, out, page = db.store("nations").order_by("name").limit(4), [], None
    while page is None or page.has_next_page:
        page = (q if page is None else q.start_after(page.docs[-1])).get()
        out.append((len(out), page.end_cursor[0], len(page.docs), page.has_next_page, page.has_prev_page))
    return t.spark.createDataFrame(out, "page int, last_name string, docs long, has_next boolean, has_prev boolean")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 30")
def offset_sorted(t):
    return t.store("orders").sort_by("o_totalprice", "desc").offset(30).to_df(20).select("o_orderkey", "o_totalprice")


@query("select * from (values (5, 'NotSupported', 'ValueError', 'ValueError')) v(groups, no_aggregate, sort_after_group, one_of_groups)")
def aggregate_rules(t):
    """Limits don't apply to aggregates; grouping alone, sorting groups and taking one are refused."""
    q = t.store("nation").group_by("n_regionkey")

    def refused(fn) -> str:
        try:
            fn()
        except (NotSupported, ValueError) as e:
            return type(e).__name__
        return "none"

    made = q.aggregate(n=count("n_name"))
    return t.spark.createDataFrame([(len(made.take(2)), refused(q.to_df), refused(lambda: q.sort_by("n_name")), refused(made.one))], "groups int, no_aggregate string, sort_after_group string, one_of_groups string")


# --- scalars and validators


CRC = "list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(c_name, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)))"


@query(f"select c_custkey, xor({CRC}, 4294967295) as crc from customer")
def checksum(t):
    c = t.df("customer")
    return c.select("c_custkey", scalars.checksum(c.c_name).alias("crc"))


@query("select c_custkey, c_name as opened, true as refused from customer")
def cipher_with_derived_key(t):
    """A key derived from a password opens what it sealed; another password's doesn't."""
    c = t.df("customer")
    key, other = (F.lit(scalars.derived_key(p, b"salt of the store")) for p in ("password", "other"))
    aad = F.col("c_custkey").cast("string")
    sealed = c.withColumn("s", scalars.encrypted(F.col("c_name"), key, aad))
    return sealed.select("c_custkey", scalars.decrypted(F.col("s"), key, aad).cast("string").alias("opened"), scalars.decrypted(F.col("s"), other, aad).isNull().alias("refused"))


@query("select c_custkey, c_mktsegment = 'BUILDING' as has_text, c_nationkey = 5 as has_number from customer")
def json_array_membership(t):
    c = t.df("customer")
    doc = F.to_json(F.struct(F.array("c_mktsegment", F.lit("x")).alias("texts"), F.array("c_nationkey", F.lit(99)).alias("numbers")))
    return c.select("c_custkey", scalars.json_array_contains(doc, "texts", "BUILDING").alias("has_text"), scalars.json_array_contains(doc, "numbers", 5).alias("has_number"))


@query("select count(*) as n, 20 as least, 20 as most from region")
def random_ids(t):
    """Documents without an id get one of 20 letters and digits."""
    db = scratch_database(t.spark)
    with db.transaction() as tx:
        ids = [tx.make("regions", {"name": r.r_name}) for r in t.df("region").collect()]
    out = db.store("regions").with_fields("name string").to_df().where(F.col("id").isin(ids) & F.rlike("id", F.lit("^[A-Za-z0-9]+$")))
    return out.agg(F.countDistinct("id").alias("n"), F.min(F.length("id")).alias("least"), F.max(F.length("id")).alias("most"))


def checked(t: Tables, column, validator) -> DataFrame:
    value, error = validator.compile(column)
    return t.df("customer").select("c_custkey", value.alias("value"), error["code"].alias("code"))


@query("select c_custkey, case when c_custkey % 2 = 0 then '2024-01-02T03:04:05' end as value, case when c_custkey % 2 = 1 then 'custom_refinement_failed' end as code from customer")
def validate_datetime(t):
    return checked(t, F.when(F.col("c_custkey") % 2 == 0, "2024-01-02T03:04:05").otherwise("2024-01-02Tx"), fg.string().datetime())


@query("select c_custkey, case when c_custkey % 5 = 0 then 'invalid_file_type' when c_nationkey < 3 then 'file_too_small' when c_nationkey > 20 then 'file_too_large' end as code from customer")
def validate_file(t):
    file = F.struct(F.when(F.col("c_custkey") % 5 == 0, "text/x").otherwise("image/png").alias("type"), F.col("c_nationkey").alias("size"))
    return checked(t, file, fg.file().types("image/png").min_size(3).max_size(20)).select("c_custkey", "code")


@query("select c_custkey, case when c_nationkey % 2 = 0 then c_mktsegment || '!' end as value, case when c_nationkey % 2 = 1 then 'custom_error' end as code from customer")
def validate_custom_and_transform(t):
    """Preprocessing cuts the number off, a rule of one's own looks at it, a transformation changes what passed."""
    raw = F.concat_ws(":", "c_mktsegment", F.col("c_nationkey").cast("string"))
    even = fg.string().custom(lambda v: F.col("c_nationkey") % 2 == 0).preprocess(lambda c: F.substring_index(c, ":", 1)).postprocess(lambda v: F.concat(v, F.lit("!")))
    return checked(t, raw, even)


@query("select c_custkey, c_name || ',' || c_mktsegment as tags, c_nationkey::varchar as nation, c_acctbal > 0 as rich from customer")
def form_entries(t):
    c = t.df("customer")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    form = form_data(F.array(entry("tags[]", c.c_name), entry("address[nation]", c.c_nationkey), entry("tags[]", c.c_mktsegment), entry("rich", c.c_acctbal > 0)))
    return c.select("c_custkey", F.concat_ws(",", form["tags"]).alias("tags"), form["address.nation"][0].alias("nation"), form["rich"][0].cast("boolean").alias("rich"))


@query("select 'nations' as collection, count(*) as documents, count_if(n_regionkey = 1) as matching, max(n_nationkey)::double as most, count_if(contains(lower(n_name), 'an')) as searched, 'ok' as health from nation")
def provider(t):
    """The provider's interface over a database."""
    p = DatabaseProvider(nations(t)[0])
    return t.spark.createDataFrame(
        [(p.collections()[0], p.aggregate("nations", "count", "name"), len(p.query("nations", [("region", "==", 1)])), p.aggregate("nations", "sum", "visits", [("visits", "==", 24)]), len(p.search("nations", "name", "an")), p.health()["status"])],
        "collection string, documents long, matching long, most double, searched long, health string",
    )


@query("select key, value from (select 'a/1' as key, '{\"n\":1}' as value)")
def documents_that_parse(t):
    """Only documents that are JSON are given as such."""
    db = scratch_database(t.spark)
    path = f"{db.files.root}/in"
    t.spark.createDataFrame([("a/1", '{"n":1}'), ("a/2", "{broken")], "key string, value string").coalesce(1).write.parquet(path)
    db.ingest_file("a", path)
    return t.spark.createDataFrame([("a/1", json.dumps(d, separators=(",", ":"))) for d in db.store("a").take()], "key string, value string")
