"""The versioned database: modes, versions, transactions, definitions, constraints, streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessel.operators.dml import ConstraintError
from tessel.sources.database import ConflictError, Database, open_database
from tessel.sources.kvstore import KeyValueStore
from tessel.sources.types import SPARK_TYPES, schema, spark_type
from tessel.streaming.ingest import upsert_stream, windowed_counts


@pytest.fixture
def db(spark, tmp_path):
    return open_database(spark, f"file://{tmp_path}/db")


def users(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, name string, age int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_modes(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    with pytest.raises(FileNotFoundError):
        Database(spark, path, "open_existing")
    db = Database(spark, path, "create_only")
    db.create_table("t", users(spark, (1, "a", 2)))
    with pytest.raises(FileExistsError):
        Database(spark, path, "create_only")
    reader = Database(spark, path, "read_only")
    assert reader.table("t").count() == 1
    with pytest.raises(PermissionError):
        reader.clear("t")


def test_versions(spark, db):
    db.create_table("users", users(spark, (1, "Alice", 30), (2, "Bob", 25)), primary_key=["id"])
    old = db.snapshot()
    db.insert("users", users(spark, (2, "Bobby", 26), (3, "Cy", 35)))
    assert rows(old.table("users")) == [(1, "Alice", 30), (2, "Bob", 25)]
    assert rows(db.table("users")) == [(1, "Alice", 30), (2, "Bobby", 26), (3, "Cy", 35)]
    db.fork("users", "copy")
    db.delete("users", F.col("id") == 1)
    assert db.table("copy").count() == 3 and db.table("users").count() == 2
    db.remove_range("copy", "id", 2, 4)
    assert rows(db.table("copy")) == [(1, "Alice", 30)]
    db.compact("users")
    assert db.vacuum() == 0 and db.vacuum(min_age=0) > 0 and db.versions == [db.version] and db.table("users").count() == 2
    assert open_database(spark, db.path, "open_existing").table("copy").count() == 1


def test_conflict(spark, db):
    other = open_database(spark, db.path)
    db.create_table("a", users(spark, (1, "x", 1)))
    with pytest.raises(ConflictError):
        other.create_table("b", users(spark, (1, "x", 1)))
    other.refresh()
    other.create_table("b", users(spark, (1, "x", 1)))


def test_transactions_publish_all_or_nothing(spark, db):
    db.create_table("a", users(spark, (1, "x", 1)), primary_key=["id"])
    db.create_table("b", users(spark, (1, "x", 1)), primary_key=["id"])
    before = db.version
    with pytest.raises(ConstraintError), db.transaction() as tx:
        tx["a"] = tx["a"].withColumn("age", F.lit(9))
        tx["b"] = tx["b"].unionByName(tx["b"])
    assert db.version == before and rows(db.table("a")) == [(1, "x", 1)]
    with db.transaction() as tx:
        tx["a"] = tx["a"].withColumn("age", F.lit(9))
        tx.begin()
        del tx["b"]
        tx.abort()
        tx["b"] = tx["b"].withColumn("age", F.lit(8))
    assert db.version == before + 1 and rows(db.table("a")) == [(1, "x", 9)] and rows(db.table("b")) == [(1, "x", 8)]


def test_definitions(spark, db):
    db.create_table("t", StructType.fromDDL("id int, v string"), primary_key=["id"])
    assert db.table("t").count() == 0
    db.insert("t", spark.createDataFrame([(1, "a"), (2, None)], "id int, v string"))
    db.add_column("t", "n", "int")
    db.rename_column("t", "v", "w")
    assert rows(db.table("t")) == [(1, "a", None), (2, None, None)] and db.table("t").columns == ["id", "w", "n"]
    db.insert("t", spark.createDataFrame([(3, 5)], "id int, n int"))
    db.drop_column("t", "w")
    assert rows(db.table("t")) == [(1, None), (2, None), (3, 5)]
    db.rename_table("t", "s")
    db.create_view("big", "select * from s where n > 3")
    assert rows(db.sql("select id from big where id >= :low", {"low": 0})) == [(3,)]
    db.create_sequence("q", 10, 5)
    assert [db.nextval("q"), db.nextval("q")] == [10, 15]
    db.create_schema("more")
    db.drop_view("big")
    db.drop_table("s")
    assert db.tables() == [] and "more" in db.manifest["schemas"]


def test_constraints_and_indexes(spark, db):
    db.create_table("u", users(spark, (1, "a", 1), (2, "b", 1)), primary_key=["id"], not_null=["name"])
    db.create_index("u", "by_name", ["name"], unique=True)
    db.create_index("u", "by_age", ["age"])
    assert db.lookup("u", "by_age", 1).count() == 2
    for bad in ((3, None, 1), (3, "a", 1)):
        with pytest.raises(ConstraintError):
            db.insert("u", users(spark, bad))
    with pytest.raises(ConstraintError):
        db.update("u", F.col("id") == 2, {"name": F.lit("a")})
    with pytest.raises(ConstraintError):
        db.insert("u", users(spark, (1, "z", 1)), mode="unique")
    db.insert("u", users(spark, (1, "z", 1), (9, "n", 2)), mode="ignore")
    assert rows(db.table("u")) == [(1, "a", 1), (2, "b", 1), (9, "n", 2)]


def test_write_batch(spark, db):
    db.create_table("kv", spark.createDataFrame([(i, f"v{i}") for i in range(6)], "k int, v string"), primary_key=["k"])
    log = spark.createDataFrame([(0, "range", 1, 4, None), (1, "put", 2, None, "new"), (2, "del", 5, None, None)], "seq int, op string, key int, key_hi int, value string")
    db.write_batch("kv", log, "k")
    assert rows(db.table("kv")) == [(0, "v0"), (2, "new"), (4, "v4")]


def test_stream_batches_count_once(spark, db, tmp_path):
    db.create_table("u", StructType.fromDDL("id int, name string, age int"), primary_key=["id"])
    users(spark, (1, "a", 1), (1, "b", 2), (2, "c", 1)).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, name string, age int").parquet(f"{tmp_path}/in")
    query = upsert_stream(stream, db, "u", ["age"], f"{tmp_path}/checkpoint", once=True)
    query.awaitTermination()
    assert rows(db.table("u")) == [(1, "b", 2), (2, "c", 1)]
    assert not db.apply_batch("u", "u", 0, users(spark, (7, "x", 1)))


def test_windowed_counts(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01 00:00:30' + make_interval(0,0,0,0,0,id,0) as ts, 'k' as k from range(5)").write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/ev")
    query = windowed_counts(stream, "ts", "2 minutes", "1 minute", "k").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    assert sum(r.n for r in spark.table("counted").collect()) == 5


def test_key_value_store(spark, db):
    store = KeyValueStore(db)
    store.write([("put", f"key/{i:03}", str(i)) for i in range(40)] + [("range", "key/010", "key/020"), ("put", "key/015", "again"), ("del", "key/000")])
    old = store.snapshot()
    store.delete_range("key/030", "key/999")
    assert old.count() == 30 and store.count() == 20 and store.count("key/010", "key/020") == 1
    assert store.get("key/015") == "again" and store.get("key/010") is None
    assert store.seek("key/016").first().key == "key/020" and store.seek_for_prev("key/016").first().key == "key/015"
    assert (store.first().first().key, store.last().first().key) == ("key/001", "key/029")
    keys = spark.createDataFrame([("key/001",), ("no",)], "key string")
    assert rows(store.multi_get(keys)) == [("key/001", "1", True), ("no", None, False)]


def test_types(spark, db):
    assert len(SPARK_TYPES) == 21
    assert spark_type("decimal(10, 2)").precision == 10 and spark_type("varchar(15)").simpleString() == "string"
    with pytest.raises(TypeError):
        spark_type("POINT")
    db.create_table("t", schema({"id": "INTEGER", "u": "UBIGINT", "d": "DATE", "i": "INTERVAL"}))
    assert [k for _, k in db.table("t").dtypes] == ["int", "decimal(20,0)", "date", "struct<months:int,days:int,micros:bigint>"]


def test_command_line(spark, db):
    from tessel.__main__ import main

    db.create_table("t", users(spark, (1, "a", 1), (2, "b", 1)), primary_key=["id"])
    assert main(["info", db.path], spark)["tables"] == {"t": 2}
    assert main(["verify", db.path], spark)["faults"] == {}
    assert main(["compact", db.path], spark)["version"] == db.version + 1
    assert main(["vacuum", db.path, "--min-age", "0"], spark)["deleted"] == 1


def test_insert_last_row_wins_and_writes_only_its_rows(spark, db):
    db.create_table("u", users(spark, *((i, "x", 0) for i in range(100))), primary_key=["id"])
    base = db.manifest["tables"]["u"]["folder"]
    version = db.insert("u", spark.createDataFrame([(1, "a", 1), (1, "b", 2), (200, "c", 3)], "id int, name string, age int").coalesce(1))
    meta = db.manifest["tables"]["u"]
    assert version == db.version and meta["folder"] == base and meta["log"][0]["puts"] == 2
    assert rows(db.table("u").where("id in (1, 200)")) == [(1, "b", 2), (200, "c", 3)] and db.table("u").count() == 101
    assert db.remove_range("u", "id", 10, 20, count=True) == 10 and db.manifest["tables"]["u"]["folder"] == base
    db.insert("u", users(spark, (15, "again", 1)))
    assert rows(db.table("u").where("id between 9 and 20")) == [(15, "again", 1), (20, "x", 0), (9, "x", 0)]
    assert db.delete("u", F.col("id") >= 99) == 2 and db.update("u", F.col("id") < 2, {"age": F.col("age") + 7}) == 2
    assert rows(db.table("u").where("id < 3 or id > 97")) == [(0, "x", 7), (1, "b", 9), (2, "x", 0), (98, "x", 0)]
    assert db.get("u", "trie", id=1).first().name == "x" and db.get("u", id=1).first().name == "b" and db.get("u", id=10).first() is None
    before = rows(db.table("u"))
    for i in range(20):
        db.insert("u", users(spark, (1000, "n", i)))
    assert len(db.manifest["tables"]["u"]["log"]) < 16 and rows(db.table("u")) == sorted([*before, (1000, "n", 19)], key=repr)
    db.compact("u")
    stats = db.stats("u")
    assert stats["exact"] and stats["rows"] == len(before) + 1 and stats["bytes"] > 0 and rows(db.table("u")) == sorted([*before, (1000, "n", 19)], key=repr)


def test_a_claim_that_is_left_heals(spark, db):
    db.files.LEASE = 0.5
    db.create_table("t", users(spark, (1, "a", 1)))
    name = db._manifest_name(db.version + 1)
    assert db.files._claim(name) == 0
    with pytest.raises(ConflictError):
        db.clear("t")
    import time

    time.sleep(1.2)
    db.clear("t")
    assert open_database(spark, db.path).table("t").count() == 0


def test_vacuum_spares_pins_and_young_folders(spark, db):
    db.create_table("t", users(spark, (1, "a", 1)))
    old, pin = db.snapshot(), db.pin()
    db.update("t", F.lit(True), {"age": F.lit(5)})
    assert db.vacuum() == 0 and db.vacuum(min_age=0) == 0 and rows(old.table("t")) == [(1, "a", 1)]
    db.unpin(pin)
    assert db.vacuum(min_age=0) == 1
    assert old.lag() == 1 and old.keep_within(0) and rows(old.table("t")) == [(1, "a", 5)]


def test_columns_carry_their_rules(spark, db):
    db.create_table("u", users(spark, (1, "a", 1), (2, "b", 2)), primary_key=["id"], not_null=["age"], checks={"old": "age < 100"})
    db.create_index("u", "by_name", ["name"])
    db.insert("u", users(spark, (3, "c", 3)))
    before = db.version
    db.rename_column("u", "name", "title")
    assert db.version == before + 1
    assert rows(db.lookup("u", "by_name", "c")) == [(3, "c", 3)] and rows(db.lookup("u", "by_name", "a")) == [(1, "a", 1)]
    db.compact("u")
    assert rows(db.lookup("u", "by_name", "b")) == [(2, "b", 2)]
    with pytest.raises(ValueError):
        db.drop_column("u", "title")
    for bad in (None, 100):
        with pytest.raises(ConstraintError):
            db.insert("u", spark.createDataFrame([(9, "z", bad)], "id int, title string, age int"))
    db.drop_index("u", "by_name")
    db.drop_column("u", "title")
    db.insert("u", spark.createDataFrame([(4, 4)], "id int, age int"))
    assert rows(db.table("u")) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_index_reads_the_index(spark, db):
    db.create_table("o", spark.range(5000).selectExpr("id", "id % 500 as c", "'x' as v"), primary_key=["id"])
    db.create_index("o", "by_c", ["c"])
    assert [f for f in db.index_entries("o", "by_c").columns] == ["c", "id"]
    db.update("o", F.col("id") == 7, {"c": F.lit(9)})
    db.delete("o", F.col("id") == 509)
    db.remove_range("o", "id", 4000, None)
    assert [r.id for r in db.lookup("o", "by_c", 9).orderBy("id").collect()] == [7, 9, *range(1009, 4000, 500)]
    assert [r.id for r in db.lookup("o", "by_c", 7).orderBy("id").collect()] == list(range(507, 4000, 500))


def test_sql_statements(spark, db):
    run = lambda text, args=None: db.sql(text, args).first()[0]
    run("create table u (id integer primary key, name varchar(10) not null, age int check (age < 200), unique (name))")
    assert run("insert into u values (1, 'a', 10), (2, 'b', 20), (2, 'bb', 21)") == 2
    assert run("insert or ignore into u (id, name) values (1, 'z'), (3, 'c')") == 1
    assert run("update u set age = coalesce(age, 0) + :more where id in (select id from u where id > 1)", {"more": 5}) == 2
    assert rows(db.sql("select * from u where age > :low", {"low": 9})) == [(1, "a", 10), (2, "bb", 26)]
    with pytest.raises(ConstraintError):
        run("insert into u values (9, 'x', 500)")
    with pytest.raises(ConstraintError):
        run("insert into u values (9, 'a', 5)")
    assert run("update u set id = id + 10 where name = 'a'") == 1
    assert run("delete from u where id = 3") == 1
    run("create unique index by_name on u (name)")
    run("create view grown as select id from u where age > 20")
    run("create table if not exists copy as select id, age from u")
    run("alter table copy add column note varchar(5)")
    run("alter table copy rename column age to years")
    run("alter table copy rename to other")
    assert rows(db.sql("select * from grown")) == [(2,)] and rows(db.sql("select * from other")) == [(11, 10, None), (2, 26, None)]
    run("alter table other drop column note")
    run("create schema s")
    run("create table s.t (k bigint, v double)")
    run("insert into s.t select id, age from u")
    assert rows(db.sql("select count(*) as n from s.t")) == [(2,)]
    run("create sequence q start with 5 increment by 2")
    assert db.nextval("q", 3) == 5 and db.nextval("q") == 11
    for text in ("drop index by_name", "drop view grown", "drop sequence q", "drop schema s cascade", "drop table other", "drop table if exists other", "truncate u"):
        run(text)
    assert db.tables() == ["u"] and db.table("u").count() == 0
    with pytest.raises(KeyError):
        run("drop table nothing")


def test_key_value_store_writes_only_its_batch(spark, db):
    store = KeyValueStore(db)
    version = store.put("a", "1")
    base = db.manifest["tables"]["default"]["folder"]
    assert version == db.version and store.write([("put", "b", "2"), ("range", "a", "b"), ("put", "c", "3"), ("del", "c")]) == version + 1
    assert list(store.iterate()) == [("b", "2")] and db.manifest["tables"]["default"]["folder"] == base
    store.flush()
    assert store.get("b", "trie") == "2" and store.roots() == ["default"] and list(store.iterate(reverse=True)) == [("b", "2")]
    blobs = KeyValueStore(db, "blobs", "binary")
    blobs.write([("put", b"\x01", b"x"), ("put", b"\x02", b"y")])
    blobs.delete_range(b"\x00", b"\x02")
    assert [(bytes(k), bytes(v)) for k, v in blobs.iterate()] == [(b"\x02", b"y")]


def test_log_replay(spark, db):
    from tessel.sources.wal import Log

    for name in ("a", "b"):
        db.create_table(name, StructType.fromDDL("key int, value string"), primary_key=["key"])
    log = Log(db)
    shape = "seq int, tx_id int, root string, op string, key int, value string, participants int, is_commit boolean"
    entry = lambda *rows: log.append(spark.createDataFrame(list(rows), shape))
    assert log.replay() == db.version
    entry((1, 1, "a", "put", 1, "x", 2, False), (2, 1, "b", "put", 1, "y", 2, True), (3, 2, "a", "put", 2, "never", 2, False))
    entry((1, 3, "a", "put", 1, "x2", 1, True), (2, 4, "a", "put", 3, "gone", 1, False), (3, 4, "a", "del", 3, None, 1, True))
    before = db.version
    assert log.replay() == before + 1 and log.applied == 1
    assert rows(db.table("a")) == [(1, "x2")] and rows(db.table("b")) == [(1, "y")]
    assert log.replay() == before + 1 and log.truncate() == 2 and log.entries(log.applied) is None
    entry((1, 9, "b", "del", 1, None, 1, True))
    # a crash between the replay and its version leaves nothing behind
    again = Log(open_database(spark, db.path))
    again.replay()
    db.refresh()
    assert db.table("b").count() == 0 and log.segments[-1] == 2 == log.applied


def test_streams_take_bounded_batches(spark, db, tmp_path):
    from tessel.streaming.ingest import read_files

    db.create_table("u", StructType.fromDDL("id int, name string, age int"), primary_key=["id"])
    for i in range(6):
        users(spark, (i % 2, "a", i)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = upsert_stream(read_files(spark, f"{tmp_path}/in", "id int, name string, age int", 1), db, "u", ["age"], f"{tmp_path}/checkpoint", once=True, max_log=2)
    query.awaitTermination()
    db.refresh()
    assert len(query.recentProgress) >= 6 and db.manifest["batches"]["u"] == 5 and len(db.manifest["tables"]["u"]["log"]) <= 2 and db.table("u").count() == 2
