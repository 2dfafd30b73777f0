"""Named queries over the driver's tables, each with SQL for the same rows.

Queries that are plain SQL run the same text in both engines; those of the engine's own
operators are DataFrame plans beside their SQL.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import decode_key as codec
from ..functions.keys import memcomparable_key
from ..operators import dml, kv, multimap, resolve, spans
from ..operators.txn import Staged
from ..sources.database import Database
from ..sources.files import shared_dir
from ..sources.wal import Log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents conversations pages".split()


class Tables:
    """The tables of one folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def scratch(t: Tables) -> Database:
    """A new database in the folder that all machines share."""
    return Database(t.spark, f"{shared_dir(t.spark)}/tessel/db-{uuid.uuid4().hex}")


def both(name: str, sql: str) -> None:
    """A query that is the same SQL in both engines."""
    import re

    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = Tables(spark, sf_dir)
        return spark.sql(re.sub(r"\b(from|join|,)\s+(" + "|".join(used) + r")\b", lambda m: f"{m[1]} {{{m[2]}}}", sql), **{t: getattr(tables, t) for t in used})

    QUERIES[name], ORACLES[name] = run, sql


def query(sql: str, name: str | None = None):
    """A DataFrame plan with its SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[name or f.__name__], ORACLES[name or f.__name__] = run, sql
        return f

    return add


# ---- scans, projections, filters -------------------------------------------------------

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
_O = ", ".join(ORDER_COLUMNS)


@query(f"select {_O} from orders order by o_orderkey")
def scan_ordered(t):
    return kv.scan(t.orders.select(*ORDER_COLUMNS), "o_orderkey")


@query(f"select {_O} from orders order by o_orderkey desc")
def scan_reverse(t):
    return kv.scan(t.orders.select(*ORDER_COLUMNS), "o_orderkey", reverse=True)


@query("select * from customer")
def table_scan(t):
    return t.customer


@query("select l_orderkey, l_extendedprice from lineitem")
def project(t):
    return t.lineitem.select("l_orderkey", "l_extendedprice")


@query(f"select {_O} from orders where o_orderkey = 777")
def pk_point(t):
    return kv.get(t.orders, o_orderkey=777).select(*ORDER_COLUMNS)


@query("select conv_id, turn, role, text from conversations where conv_id = 12")
def pk_prefix(t):
    return kv.get(t.conversations, conv_id=12).select("conv_id", "turn", "role", "text")


@query(f"select {_O} from orders where o_orderkey >= 1000 and o_orderkey < 1500")
def pk_range(t):
    return kv.range_scan(t.orders, "o_orderkey", 1000, 1500).select(*ORDER_COLUMNS)


@query(f"select {_O} from orders where o_custkey = 37")
def index_lookup(t):
    db = scratch(t)
    db.create_table("orders", t.orders.select(*ORDER_COLUMNS), primary_key=["o_orderkey"])
    db.create_index("orders", "by_customer", ["o_custkey"])
    return db.lookup("orders", "by_customer", 37)


@query("select o_orderkey, o_totalprice from orders where o_orderkey = 4242", "kv_get")
def kv_get(t):
    return kv.get(t.orders, o_orderkey=4242).select("o_orderkey", "o_totalprice")


@query("select k.k as o_orderkey, o.o_totalprice, o.o_orderkey is not null as found from (select c_custkey * 37 as k from customer) k left join orders o on o.o_orderkey = k.k")
def multi_get(t):
    keys = t.customer.select((F.col("c_custkey") * 37).alias("o_orderkey"))
    return kv.multi_get(keys, t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("select c_name, c_acctbal from customer where c_name >= 'Customer#000000100' order by c_name limit 1")
def lower_bound(t):
    return kv.lower_bound(t.customer, "c_name", "Customer#000000100").select("c_name", "c_acctbal")


@query("select c_name, c_acctbal from customer where c_name > 'Customer#000000100' order by c_name limit 1")
def upper_bound(t):
    return kv.upper_bound(t.customer, "c_name", "Customer#000000100").select("c_name", "c_acctbal")


@query("select o_orderkey, o_totalprice from orders where o_orderkey <= 5000 order by o_orderkey desc limit 1")
def seek_for_prev(t):
    return kv.seek_for_prev(t.orders, "o_orderkey", 5000).select("o_orderkey", "o_totalprice")


@query("select max(o_orderkey) as o_orderkey from orders where o_orderkey < 5000")
def less_than(t):
    return kv.less_than(t.orders, "o_orderkey", 5000)


@query("select max(c_name) as c_name from customer where c_name like 'Customer#0000001%'")
def prefix_max(t):
    return kv.prefix_max(t.customer, "c_name", "Customer#0000001")


@query("select count(*) = 0 as is_empty from orders where o_orderkey >= -50 and o_orderkey < 0")
def range_empty(t):
    return kv.range_empty(t.orders, "o_orderkey", -50, 0)


@query("select c_name, c_nationkey from customer where c_name like 'Customer#00000001%'")
def prefix_scan(t):
    return kv.prefix_scan(t.customer, "c_name", "Customer#00000001").select("c_name", "c_nationkey")


@query("select o_orderkey, o_totalprice from orders where o_orderkey >= 5000 and o_orderkey < 6000")
def range_scan(t):
    return kv.range_scan(t.orders, "o_orderkey", 5000, 6000).select("o_orderkey", "o_totalprice")


@query("select count(*) as n from orders where o_orderkey >= 1000 and o_orderkey < 2000")
def range_count(t):
    return kv.range_count(t.orders, "o_orderkey", 1000, 2000)


@query("select conv_id, turn, octet_length(encode(text)) as value_size from conversations")
def value_size(t):
    return t.conversations.select("conv_id", "turn", F.octet_length("text").cast("long").alias("value_size"))


@query("select count(*) as n_keys, cast(sum(octet_length(encode(c_name))) as bigint) as c_name_bytes, cast(sum(octet_length(encode(c_mktsegment))) as bigint) as c_mktsegment_bytes from customer")
def tree_stats(t):
    return kv.tree_stats(t.customer, "c_name", "c_mktsegment")


@query("""select p.event_id, p.user_id, v.event_id as view_id
from (select * from events where event_type = 'purchase') p
asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts""")
def batch_lower_bound(t):
    timed = t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    probes = timed.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    points = timed.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("view_id"))
    return kv.as_of(probes, points, "user_id", "at", "at", "view_id").select("event_id", "user_id", "view_id")


both("filter", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000")
both("filter_date", "select o_orderkey, o_orderdate from orders where o_orderdate > timestamp '1997-06-01 00:00:00' and o_totalprice > 50000")
both("like_between_in", "select p_partkey, p_name, p_size from part where (p_name like '%a%' and p_size between 5 and 15) or p_brand in ('Brand#11', 'Brand#23')")
both("null_tests", "select o_orderkey, coalesce(x, -1.0) as x, x is null as missing from (select o_orderkey, case when o_orderkey % 10 = 0 then null else o_totalprice end as x from orders) where x is null or x > 200000")
both("expressions", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 2 as twice, nullif(l_linenumber, 3) as not_three, case when l_discount > 0.05 then 'high' when l_discount > 0.02 then 'mid' else 'low' end as band, cast(l_quantity as int) as whole, abs(l_linenumber - 4) as far, upper(l_returnflag) || lower(l_linestatus) as flags from lineitem")

# ---- joins ------------------------------------------------------------------------------

both("join_inner", "select c.c_name, count(*) as n, round(sum(o.o_totalprice), 2) as total from orders o join customer c on o.o_custkey = c.c_custkey group by c.c_name")
both("join_left", "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 300000")
both("join_right", "select c.c_custkey, o.o_orderkey from orders o right join customer c on c.c_custkey = o.o_custkey and o.o_totalprice > 300000")
both("join_full", "select a.k as a_key, b.k as b_key from (select o_orderkey as k from orders where o_orderkey % 2 = 0) a full join (select o_orderkey as k from orders where o_orderkey % 3 = 0) b on a.k = b.k")
both("join_semi", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
both("join_anti", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
both("in_subquery", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
both("join_cross", "select r.r_name, n.n_name from region r cross join nation n")
both("join_multi", "select r.r_name, n.n_name, count(*) as n_customers, round(sum(c.c_acctbal), 2) as balance from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by r.r_name, n.n_name")
both(
    "join_interval",
    """select e.event_id, r.event_id as range_id
from events e, (select user_id, event_id, ts as lo, lead(ts) over (partition by user_id order by ts) as hi from events) r
where e.user_id = r.user_id and r.lo <= e.ts and r.hi > e.ts and e.event_type = 'purchase'""",
)

# ---- aggregates, windows, sorts, sets ---------------------------------------------------

both("agg_global", "select count(*) as n, round(sum(l_quantity), 2) as total, round(avg(l_extendedprice), 4) as mean, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship from lineitem")
both("agg_group", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_quantity), 6) as avg_qty, count(*) as count_order from lineitem group by l_returnflag, l_linestatus")
both("agg_having", "select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_custkey having count(*) > 12")
both("agg_filter", "select l_returnflag, count(*) filter (where l_discount > 0.05) as discounted, sum(case when l_tax > 0.04 then 1 else 0 end) as taxed from lineitem group by l_returnflag")
both("distinct", "select distinct l_orderkey, l_linenumber from lineitem")
both("count_distinct", "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag")
both("rollup_cube", "select l_returnflag, l_linestatus, grouping(l_returnflag) as g, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
both("grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
both("sort", "select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority asc nulls first, o_totalprice desc nulls last, o_orderkey")
both("topk", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
both("set_ops", "(select o_custkey as k from orders where o_totalprice > 150000 intersect select c_custkey from customer where c_acctbal > 0) union select s_suppkey from supplier except select n_nationkey from nation")
both("union_all", "select c_name as name, c_acctbal as balance from customer union all select s_name, s_acctbal from supplier")
both("scalar_subquery", "select p_partkey, p_retailprice from part where p_retailprice > (select avg(p_retailprice) from part)")
both("top_per_group", "select o_custkey, o_orderkey, o_totalprice, rn from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 3")
both("window_ranks", "select c_custkey, rank() over (partition by c_nationkey order by c_mktsegment) as r, dense_rank() over (partition by c_nationkey order by c_mktsegment) as d, count(*) over (partition by c_nationkey) as n, first_value(c_custkey) over (partition by c_nationkey order by c_custkey) as f from customer")
both("window_frames", "select event_id, sum(event_id) over (partition by user_id order by event_id rows between 3 preceding and current row) as around, lag(event_id, 2) over (partition by user_id order by event_id) as two_back, ntile(4) over (partition by user_id order by event_id) as quarter from events")
both("recursive_cte", "with recursive up(k, root) as (select n_nationkey, n_nationkey from nation where n_nationkey < 3 union all select k + 3, root from up where k + 3 < 25) select n.n_name, u.root from up u join nation n on n.n_nationkey = u.k")


@query("select cast(quantile_cont(o_totalprice, 0.5) as double) as p50, cast(quantile_cont(o_totalprice, 0.99) as double) as p99, cast(quantile_cont(o_totalprice, 0.999) as double) as p999 from orders")
def percentiles(t):
    found = spans.percentiles(t.orders, "o_totalprice", [0.5, 0.99, 0.999])
    return t.spark.createDataFrame([tuple(found)], "p50 double, p99 double, p999 double")


# ---- layers and versions ----------------------------------------------------------------

_BASE = "select o_orderkey as k, o_totalprice as v, 'put' as op, 0 as prio from orders"
_FROZEN = "select o_orderkey as k, o_totalprice + 1000 as v, 'put' as op, 1 as prio from orders where o_orderkey % 7 = 0"
_IN_USE = "select o_orderkey as k, o_totalprice + 2000 as v, case when o_orderkey % 13 = 0 then 'del' else 'put' end as op, 2 as prio from orders where o_orderkey % 11 = 0"
_RANGES = "select * from (values (1000, 1100, 1), (5000, 5050, 2), (5040, 5100, 2)) r(lo, hi, prio)"
_LAYERS = f"{_BASE} union all {_FROZEN} union all {_IN_USE}"


def layers(t: Tables) -> list[tuple[int, DataFrame]]:
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    frozen = o.where("k % 7 = 0").select("k", (F.col("v") + 1000).alias("v"), F.lit("put").alias("op"))
    in_use = o.where("k % 11 = 0").select("k", (F.col("v") + 2000).alias("v"), F.when(F.col("k") % 13 == 0, "del").otherwise("put").alias("op"))
    return [(0, o.withColumn("op", F.lit("put"))), (1, frozen), (2, in_use)]


def tombstones(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1000, 1100, 1), (5000, 5050, 2), (5040, 5100, 2)], "lo long, hi long, prio int")


def _newest(source: str, keep: str = "op = 'put'", order: str = "prio") -> str:
    return f"select k, v from (select *, row_number() over (partition by k order by {order} desc) as rn from ({source}) s) where rn = 1 and {keep}"


@query(_newest(_LAYERS))
def layer_merge(t):
    return resolve.merge(layers(t), "k").select("k", "v")


@query(_newest(f"select l.* from ({_LAYERS}) l where not exists (select 1 from ({_RANGES}) r where r.prio > l.prio and l.k >= r.lo and l.k < r.hi)"))
def range_tombstone(t):
    return resolve.merge(layers(t), "k", tombstones(t)).select("k", "v")


@query(" union all ".join(f"select '{m}' as read_mode, count(*) as n, round(sum(v), 2) as total from ({_newest(f'select * from ({_LAYERS}) x where prio <= {p}')}) y" for m, p in resolve.READ_MODES.items()))
def read_modes(t):
    parts = [resolve.merge([x for x in layers(t) if x[0] <= p], "k").agg(F.lit(m).alias("read_mode"), F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total")) for m, p in resolve.READ_MODES.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query(_newest(_LAYERS) + " order by k desc")
def layer_merge_reverse(t):
    return resolve.merge(layers(t), "k").select("k", "v").orderBy(F.desc("k"))


_VERSIONS = "select o_orderkey as k, o_totalprice + version as v, version, o_orderkey % 17 = 0 and version = 2 as deleted from orders join (values (1), (2), (3)) t(version) on o_orderkey % 3 >= version - 1"


def versions(t: Tables) -> DataFrame:
    many = t.orders.withColumn("version", F.explode(F.array(*(F.lit(v) for v in (1, 2, 3))))).where("o_orderkey % 3 >= version - 1")
    return many.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + F.col("version")).alias("v"), "version", ((F.col("o_orderkey") % 17 == 0) & (F.col("version") == 2)).alias("deleted"))


@query(_newest(f"select * from ({_VERSIONS}) x where version <= 2", "not deleted", "version"))
def mvcc_as_of(t):
    return resolve.as_of(versions(t), "k", 2).select("k", "v")


@query(f"select k, version from (select k, version, lead(version) over (partition by k order by version) as following from ({_VERSIONS}) x) where following is not null and not (version <= 1 and following > 1)")
def version_gc(t):
    return resolve.collectable(versions(t), "k", [1]).select("k", "version")


_OLD = "select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 5 <> 0"
_NEW = "select o_orderkey as k, case when o_orderkey % 9 = 0 then o_totalprice + 1 else o_totalprice end as v from orders where o_orderkey % 6 <> 0"


@query(f"select coalesce(a.k, b.k) as k, case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as change, a.v as \"old\", b.v as \"new\" from ({_OLD}) a full join ({_NEW}) b on a.k = b.k where a.k is null or b.k is null or a.v <> b.v")
def snapshot_diff(t):
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.where("k % 6 <> 0").select("k", F.when(F.col("k") % 9 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v"))
    return resolve.difference(o.where("k % 5 <> 0"), new, "k", "v")


_LOG = """select o_orderkey % 500 as k, case when o_orderkey % 13 = 0 then 'del' when o_orderkey % 101 = 0 then 'range' else 'put' end as op, o_orderkey % 500 + 20 as key_hi, o_totalprice as v, o_orderkey as seq from orders"""


def log(t: Tables) -> DataFrame:
    o, k = t.orders, F.col("o_orderkey")
    op = F.when(k % 13 == 0, "del").when(k % 101 == 0, "range").otherwise("put")
    return o.select((k % 500).alias("key"), op.alias("op"), (k % 500 + 20).alias("key_hi"), F.col("o_totalprice").alias("value"), k.alias("seq"))


@query(f"select k as \"key\", v as \"value\" from (select *, row_number() over (partition by k order by seq desc) as rn from ({_LOG}) p where op <> 'range') e where rn = 1 and op = 'put' and not exists (select 1 from ({_LOG}) r where r.op = 'range' and r.seq > e.seq and e.k >= r.k and e.k < r.key_hi)")
def write_batch(t):
    return resolve.replay(log(t))


_TX = "select l_orderkey as tx_id, l_linenumber % 3 as root, l_orderkey % 4 as participants, l_linenumber = 1 as is_commit, l_partkey as k from lineitem"


@query(f"select x.tx_id, x.root, x.k from ({_TX}) x join (select tx_id from ({_TX}) y group by tx_id having count(distinct root) = max(participants) and bool_or(is_commit)) z on x.tx_id = z.tx_id")
def wal_replay(t):
    tx = t.lineitem.select(F.col("l_orderkey").alias("tx_id"), (F.col("l_linenumber") % 3).alias("root"), (F.col("l_orderkey") % 4).alias("participants"), (F.col("l_linenumber") == 1).alias("is_commit"), F.col("l_partkey").alias("k"))
    return resolve.complete(tx).select("tx_id", "root", "k")


@query("select user_id, lo, hi from (select user_id, island, min(lo) as lo, max(hi) as hi from (select *, sum(fresh) over (partition by user_id order by lo, hi rows unbounded preceding) as island from (select *, case when max(hi) over (partition by user_id order by lo, hi rows between unbounded preceding and 1 preceding) >= lo then 0 else 1 end as fresh from (select user_id, event_id as lo, event_id + 200 as hi from events))) group by user_id, island)")
def coalesce_ranges(t):
    return resolve.coalesce_ranges(t.events.select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + 200).alias("hi")), ["user_id"])


def layered(t: Tables) -> Database:
    """A database whose table k, v holds the layers as a base and two writes to its log."""
    db = scratch(t)
    (_, base), (_, frozen), (_, in_use) = layers(t)
    db.create_table("t", base.drop("op"), primary_key=["k"])
    db.write_changes("t", frozen.withColumnRenamed("op", "_op"))
    db.write_changes("t", in_use.withColumnRenamed("op", "_op"), [(5000, 5050)])
    return db


_DRAINED = f"select * from ({_BASE}) a where not (k >= 5000 and k < 5050) union all select * from ({_FROZEN}) b where not (k >= 5000 and k < 5050) union all {_IN_USE}"


@query(_newest(_DRAINED))
def compaction(t):
    db = layered(t)
    db.compact("t")
    return db.layered("t", "trie")


@query(" union all ".join(f"select '{m}' as read_mode, k, v from ({q}) x where k = 77 or k = 5005 or k = 143" for m, q in (("trie", _newest(_BASE)), ("latest", _newest(_DRAINED)))))
def layered_get(t):
    db = layered(t)
    return functools.reduce(DataFrame.unionByName, (db.get("t", mode, k=k).select(F.lit(mode).alias("read_mode"), "k", "v") for mode in ("trie", "latest") for k in (77, 5005, 143)))


_SEGMENTS = "select *, 0 as segment from (select o_orderkey % 3000 as key, o_totalprice as value, o_orderkey as seq, o_orderkey // 8 as tx_id, o_orderkey % 6 <> 0 as is_put, o_orderkey % 8 >= 6 as is_commit from orders where o_orderkey % 2 = 0) a union all select *, 1 from (select o_orderkey % 3000 as key, o_totalprice + 1 as value, o_orderkey as seq, o_orderkey // 8 + 100000000 as tx_id, o_orderkey % 5 <> 0 as is_put, o_orderkey % 8 >= 5 as is_commit from orders where o_orderkey % 2 = 1) b"


@query(f"select key, value from (select *, row_number() over (partition by key order by segment desc, seq desc) as rn from ({_SEGMENTS}) x where tx_id in (select tx_id from ({_SEGMENTS}) y group by tx_id having bool_or(is_commit))) where rn = 1 and is_put")
def wal_append(t):
    db = scratch(t)
    db.sql("create table accounts (key bigint primary key, value double)").collect()
    log, k = Log(db), F.col("o_orderkey")
    for turn, (rest, put, commit) in enumerate(((0, k % 6 != 0, k % 8 >= 6), (1, k % 5 != 0, k % 8 >= 5))):
        entries = t.orders.where(k % 2 == rest).select(k.alias("seq"), (F.floor(k / 8) + turn * 100_000_000).alias("tx_id"), F.lit("accounts").alias("root"), F.when(put, "put").otherwise("del").alias("op"), (k % 3000).alias("key"), (F.col("o_totalprice") + turn).alias("value"), F.lit(1).alias("participants"), commit.alias("is_commit"))
        log.append(entries)
    log.replay()
    return db.table("accounts")


# ---- mutations and constraints ----------------------------------------------------------


def account(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))


_A = "select c_custkey as k, c_acctbal as v from customer"
_COME = "select c_custkey * 2 as k, c_acctbal + 5 as v from customer"


def coming(t: Tables) -> DataFrame:
    return t.customer.select((F.col("c_custkey") * 2).alias("k"), (F.col("c_acctbal") + 5).alias("v"))


@query(f"{_COME} union all select * from ({_A}) a where k not in (select k from ({_COME}) b)")
def upsert(t):
    return dml.upsert(account(t), coming(t), ["k"])


@query(f"select k, v + 1 as v from ({_COME}) x union all select * from ({_A}) a where k not in (select k from ({_COME}) b)")
def insert(t):
    db = scratch(t)
    db.create_table("account", account(t), primary_key=["k"])
    db.insert("account", coming(t).unionByName(coming(t).withColumn("v", F.col("v") + 1)))
    return db.table("account")


@query(f"{_A} union all select * from ({_COME}) a where k not in (select k from ({_A}) b)")
def insert_or_ignore(t):
    return dml.insert_or_ignore(account(t), coming(t), ["k"])


@query(f"{_A} union all select -k - 1, v from ({_A}) x")
def insert_unique(t):
    return dml.insert_unique(account(t), account(t).select((-F.col("k") - 1).alias("k"), "v"), ["k"])


@query(f"select a.k, coalesce(b.v, a.v) as v from ({_A}) a left join ({_COME}) b on a.k = b.k")
def update_existing(t):
    return dml.update_existing(account(t), coming(t), ["k"])


@query(f"select * from ({_A}) a where k not in (select o_custkey from orders where o_totalprice > 250000)")
def delete_key(t):
    return dml.delete(account(t), t.orders.where("o_totalprice > 250000").select(F.col("o_custkey").alias("k")), ["k"])


@query("select o_orderkey, o_totalprice from orders where not (o_orderkey >= 5000 and o_orderkey < 6000)")
def range_delete(t):
    return dml.range_delete(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 5000, 6000)


@query("select o_orderkey, o_totalprice from orders where not (o_totalprice > 150000 and o_orderstatus = 'F')")
def sql_delete(t):
    return dml.delete_where(t.orders, (F.col("o_totalprice") > 150000) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@query("select case when o_orderstatus = 'F' then -o_orderkey else o_orderkey end as o_orderkey, case when o_orderstatus = 'F' then o_totalprice * 2 else o_totalprice end as o_totalprice from orders")
def sql_update(t):
    return dml.update_where(t.orders, F.col("o_orderstatus") == "F", {"o_orderkey": -F.col("o_orderkey"), "o_totalprice": F.col("o_totalprice") * 2}).select("o_orderkey", "o_totalprice")


@query(f"select * from ({_A}) a where not (k >= 100 and k < 200) union all select * from ({_COME}) b where k >= 100 and k < 200")
def splice(t):
    return dml.splice(account(t), coming(t), "k", 100, 200)


@query(f"select b.k, a.v as \"old\", b.v as \"new\" from ({_COME}) b left join ({_A}) a on a.k = b.k")
def replace_returning(t):
    return dml.replace_returning(account(t), coming(t), "k", "v")


@query("select c_custkey as k, case when c_acctbal < 0 then 0.0 else c_acctbal end as v from customer where c_custkey % 4 <> 1")
def nested_txn(t):
    staged = Staged({"account": account(t)})
    staged["account"] = dml.update_where(staged["account"], F.col("v") < 0, {"v": F.lit(0.0)})
    staged.begin()
    staged["account"] = dml.delete_where(staged["account"], F.col("k") % 2 == 0)
    staged.abort()
    staged.begin()
    staged["account"] = dml.delete_where(staged["account"], F.col("k") % 4 == 1)
    staged.commit()
    return staged.changes["account"]


@query(f"select 'account' as name, count(*) as n, round(sum(v), 2) as total from ({_A}) a union all select 'fork', count(*), round(sum(v), 2) from ({_A}) a where v > 0")
def snapshot_fork(t):
    db = scratch(t)
    db.create_table("account", account(t), primary_key=["k"])
    db.fork("account", "fork")
    db.delete("fork", F.col("v") <= 0)
    return functools.reduce(DataFrame.unionByName, (db.table(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total")) for n in ("account", "fork")))


@query("select 'value' as column_name, count(*) as n from events where event_id % 10 = 0 having count(*) > 0")
def violations_not_null(t):
    holed = t.events.select("event_id", F.when(F.col("event_id") % 10 == 0, None).otherwise(F.col("value")).alias("value"))
    return dml.violations_not_null(holed, ["event_id", "value"])


@query("select c_nationkey, c_mktsegment, count(*) as n from customer group by c_nationkey, c_mktsegment having count(*) > 1")
def violations_unique(t):
    return dml.violations_unique(t.customer, ["c_nationkey", "c_mktsegment"])


# ---- sorted multi-maps, keys, subtrees --------------------------------------------------

_PAIRS = "select distinct l_orderkey as k, l_linenumber as v from lineitem"


def pairs(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("v")).distinct()


@query(f"select k, min(v) as first_value, max(v) as last_value, count(*) as n from ({_PAIRS}) p group by k")
def dup_first_last(t):
    return multimap.first_last(pairs(t), "k", "v")


@query(f"select k, count(*) as n from ({_PAIRS}) p group by k")
def dup_count(t):
    return multimap.count(pairs(t), "k")


@query(f"select k, v, lead(v) over (partition by k order by v) as next_dup, lag(v) over (partition by k order by v) as prev_dup from ({_PAIRS}) p")
def cursor_next_prev(t):
    return multimap.moves(pairs(t), "k", "v")


@query(f"select k, lead(k) over (order by k) as next_key, lead(f) over (order by k) as next_first from (select k, min(v) as f from ({_PAIRS}) p group by k)")
def dup_next_nodup(t):
    return multimap.next_key(pairs(t), "k", "v")


@query(f"select k, v from ({_PAIRS}) p where k >= 500 order by k, v limit 1")
def dup_set_range(t):
    return multimap.set_range(pairs(t), "k", "v", 500)


@query(f"select k, v from ({_PAIRS}) p where k = 9 and v >= 2 order by v limit 1")
def dup_get_both_range(t):
    return multimap.get_both_range(pairs(t), "k", "v", 9, 2)


@query(f"select k, v from ({_PAIRS}) p where k < 500 order by k desc, v desc limit 1")
def dup_prev_nodup(t):
    return multimap.previous_key(pairs(t), "k", "v", 500)


@query(f"select k, v from ({_PAIRS}) p where k <> 7 and not (k = 9 and v = 1)")
def dup_delete(t):
    return multimap.delete_pair(multimap.delete_key(pairs(t), "k", 7), "k", "v", 9, 1)


@query("select o_orderkey, '01' || printf('%016X', xor(o_orderkey, (-9223372036854775808)::bigint)) as key_hex from orders", "memcomparable_key")
def memcomparable(t):
    return t.orders.select("o_orderkey", memcomparable_key(t.orders, "o_orderkey").alias("key_hex"))


@query("select c_custkey, '01' || upper(hex(encode(c_name))) || '0000' || '01' || printf('%016X', xor(c_custkey, (-9223372036854775808)::bigint)) as key_hex from customer")
def memcomparable_composite(t):
    return t.customer.select("c_custkey", memcomparable_key(t.customer, "c_name", "c_custkey").alias("key_hex"))


@query("select r.r_name, n.n_name, c.n as n_children from region r join nation n on n.n_regionkey = r.r_regionkey join (select c_nationkey, count(*) as n from customer group by c_nationkey) c on c.c_nationkey = n.n_nationkey")
def subtree_join(t):
    children = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_children"))
    trees = t.nation.join(children, F.col("c_nationkey") == F.col("n_nationkey"))
    return t.region.join(trees, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_children")


# ---- workloads --------------------------------------------------------------------------


@query("""select s.s_id, s.sf_type, c.numberx from
(select c_custkey as s_id, c_nationkey % 4 as sf_type from customer where c_acctbal > 0) s,
(select o_custkey as s_id, cast(o_orderkey % 4 as int) as sf_type, (o_orderkey % 3) * 8 as start_time, (o_orderkey % 3) * 8 + 1 + o_orderkey % 8 as end_time, o_orderkey as numberx from orders) c
where s.s_id = c.s_id and s.sf_type = c.sf_type and c.start_time <= 9 and c.end_time > 9""")
def tatp_new_destination(t):
    k = F.col("o_orderkey")
    facility = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("s_id"), (F.col("c_nationkey") % 4).alias("sf_type"))
    forward = t.orders.select(F.col("o_custkey").alias("s_id"), (k % 4).cast("int").alias("sf_type"), (k % 3 * 8).alias("start_time"), (k % 3 * 8 + 1 + k % 8).alias("end_time"), k.alias("numberx"))
    return facility.join(forward.where("start_time <= 9 and end_time > 9"), ["s_id", "sf_type"]).select("s_id", "sf_type", "numberx")


both("bank_validate", "select count(*) as n_rows, sum(case when kind = 'account' then 1 else 0 end) as n_accounts, sum(case when kind = 'log' then 1 else 0 end) as n_log, round(sum(case when kind = 'account' then amount else 0 end), 2) as balance from (select 'account' as kind, c_acctbal as amount from customer union all select 'log', o_totalprice from orders)")
@query("select o_orderkey, o_totalprice from orders where o_orderpriority = '1-URGENT' and o_totalprice > 1000")
def view(t):
    db = scratch(t)
    db.create_table("orders", t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), primary_key=["o_orderkey"])
    db.sql("create view urgent as select * from orders where o_orderpriority = '1-URGENT'").collect()
    return db.sql("select o_orderkey, o_totalprice from urgent where o_totalprice > :low", {"low": 1000})


@query("select c_custkey, c_name as customer_name, cast(null as varchar(10)) as note from customer")
def alter_add_column(t):
    db = scratch(t)
    db.create_table("customer", t.customer.select("c_custkey", "c_name"), primary_key=["c_custkey"])
    for text in ("alter table customer rename column c_name to customer_name", "alter table customer add column note varchar(10)"):
        db.sql(text).collect()
    return db.table("customer")


@query("select o_custkey, count(*) as n_orders from orders group by o_custkey")
def ctas(t):
    db = scratch(t)
    db.create_table("orders", t.orders.select("o_orderkey", "o_custkey"), primary_key=["o_orderkey"])
    db.sql("create table by_customer as select o_custkey, count(*) as n_orders from orders group by o_custkey").collect()
    return db.table("by_customer")


@query("select c_custkey, c_acctbal + 1 as c_acctbal from customer where c_nationkey < 10 and not (c_custkey >= 100 and c_custkey < 120) union all select c_custkey, c_acctbal from customer where c_nationkey >= 15 and not (c_custkey >= 100 and c_custkey < 120)")
def sql_dml(t):
    db = scratch(t)
    db.create_table("customer", t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), primary_key=["c_custkey"])
    db.sql("update customer set c_acctbal = c_acctbal + :more where c_nationkey < 10", {"more": 1}).collect()
    db.sql("delete from customer where c_nationkey in (select distinct c_nationkey from customer where c_nationkey between 10 and 14)").collect()
    db.remove_range("customer", "c_custkey", 100, 120)
    return db.table("customer").select("c_custkey", "c_acctbal")


# ---- put flags, cursor moves, codecs, subtrees, more aggregates --------------------------

_NEW_PAIRS = "select distinct l_orderkey as k, l_linenumber + 2 as v from lineitem where l_orderkey % 3 = 0 union select -1, 1"


@query(f"""with p as ({_PAIRS}), n as ({_NEW_PAIRS})
select 'upsert' as flag, k, v from (select * from p union select * from n) union all
select 'nooverwrite', k, v from (select * from p union all select * from n where k not in (select k from p)) union all
select 'nodupdata', k, v from (select * from p union all (select * from n except select * from p)) union all
select 'alldups', k, v from (select * from p where k not in (select k from n) union all select * from n) union all
select 'current', k, v from (select * from (select p.* from p left join (select k, max(v) as m from p where k in (select k from n) group by k) x on p.k = x.k and p.v = x.m where x.k is null) union select * from n)""")
def dup_put_flags(t):
    more = t.lineitem.where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") + 2).alias("v")).unionByName(t.spark.sql("select -1 as k, 1 as v"))
    return functools.reduce(DataFrame.unionByName, (multimap.put(pairs(t), more, "k", "v", flag).select(F.lit(flag).alias("flag"), F.col("k").cast("long").alias("k"), F.col("v").cast("long").alias("v")) for flag in multimap.FLAGS))


@query(f"""select * from (select 'lower' as move, k, v from ({_PAIRS}) p where (k, v) >= (9, 2) order by k, v limit 1) union all
select * from (select 'upper', k, v from ({_PAIRS}) p where (k, v) > (9, 2) order by k, v limit 1) union all
select * from (select 'prev', k, v from ({_PAIRS}) p where (k, v) < (9, 2) order by k desc, v desc limit 1) union all
select * from (select 'first', k, v from ({_PAIRS}) p where k = 9 order by v limit 1) union all
select * from (select 'last', k, v from ({_PAIRS}) p where k = 9 order by v desc limit 1)""")
def dup_set_lowerbound(t):
    p = pairs(t)
    moves = {"lower": multimap.set_lowerbound(p, "k", "v", 9, 2), "upper": multimap.set_upperbound(p, "k", "v", 9, 2), "prev": multimap.move_prev(p, "k", "v", 9, 2), "first": multimap.first_dup(p, "k", "v", 9), "last": multimap.last_dup(p, "k", "v", 9)}
    return functools.reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("move"), "k", "v") for name, df in moves.items()))


@query("select c_custkey, c_name, c_acctbal, c_nationkey from customer")
def decode_key(t):
    kinds = {n: k for n, k in t.customer.dtypes if n in ("c_custkey", "c_name", "c_acctbal", "c_nationkey")}
    keyed = t.customer.select(memcomparable_key(t.customer, *kinds).alias("key"))
    return keyed.select(*codec(F.col("key"), **kinds)).select("c_custkey", "c_name", "c_acctbal", "c_nationkey")


@query("select c_custkey, rank() over (partition by c_nationkey order by c_acctbal) as by_key from customer")
def double_key(t):
    keyed = t.customer.withColumn("key", memcomparable_key(t.customer, "c_acctbal"))
    return keyed.select("c_custkey", F.rank().over(Window.partitionBy("c_nationkey").orderBy("key")).alias("by_key"))


@query("select n_nationkey, n_name from nation where n_regionkey = 2 union all select n_nationkey + 100, n_name from nation where n_regionkey = 3")
def subtrees(t):
    trees = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    moved = t.nation.where("n_regionkey = 3").select((F.col("n_nationkey") + 100).cast(dict(t.nation.dtypes)["n_nationkey"]).alias("n_nationkey"), "n_name")
    trees = kv.put_subtree(trees, "n_regionkey", "nations", 3, moved, "n_nationkey").where(kv.is_subtree(trees, "nations"))
    return kv.subtree(trees, "n_regionkey", "nations", 2).unionByName(kv.subtree(trees, "n_regionkey", "nations", 3))


@query(f"select * from ({_A}) a where k not in (select k from ({_COME}) b) union all select k, v from ({_COME}) c where k % 4 <> 0")
def replace(t):
    come = coming(t).withColumn("v", F.when(F.col("k") % 4 != 0, F.col("v")))
    return dml.replace(account(t), come, "k", "v")


both("cube", "select l_returnflag, l_linestatus, grouping(l_returnflag) as g, grouping(l_linestatus) as h, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
both("range_frame", "select o_orderkey, count(*) over (partition by o_custkey order by o_orderkey range between 500 preceding and 500 following) as near from orders")
both("set_ops_all", "(select o_orderstatus as s, o_custkey % 5 as k from orders except all select 'F', c_custkey % 5 from customer) union all (select c_nationkey || '', c_custkey % 3 from customer intersect all select s_nationkey || '', s_suppkey % 3 from supplier)")
both("date_functions", "select o_orderkey, date_trunc('month', o_orderdate) as month, o_orderdate + interval 30 day as due, year(o_orderdate) as y, month(o_orderdate) as m from orders")


@query("select l_returnflag, true as near from lineitem group by l_returnflag")
def approx_distinct(t):
    counted = t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("a"), F.countDistinct("l_orderkey").alias("e"))
    return counted.select("l_returnflag", (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("near"))
