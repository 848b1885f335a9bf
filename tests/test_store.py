"""Bucketed tables: an upsert touches its buckets only, and writers that meet keep each other's rows."""

import pytest
from pyspark.sql import functions as F

from quire.sources import store as S


def rows(spark, ids, value, **more):
    df = spark.createDataFrame([(f"book{i}", k, value) for i in ids for k in range(3)], "textbook_id string, n int, value string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def held(store, table="nodes"):
    return sorted((r.textbook_id, r.n, r.value) for r in store.read(table).collect())


def want(**by):
    return sorted((f"book{i}", k, v) for v, ids in by.items() for i in ids for k in range(3))


@pytest.fixture()
def store(spark, tmp_path):
    return S.Store(spark, f"file://{tmp_path}/store", buckets=16)


def test_an_upsert_reads_and_writes_its_buckets_only(spark, store, monkeypatch):
    store.write("nodes", rows(spark, range(100), "old"))
    before = store.manifest("nodes")
    read = []
    inner = S.Store._files
    monkeypatch.setattr(S.Store, "_files", lambda self, table, made, buckets=None: read.append(buckets) or inner(self, table, made, buckets))
    store.upsert("nodes", rows(spark, [7, 500], "new"))
    after = store.manifest("nodes")
    changed = {b for b in before["files"].keys() | after["files"].keys() if before["files"].get(b) != after["files"].get(b)}
    assert 1 <= len(changed) <= 2 and [set(map(str, x)) for x in read] == [changed] and after["version"] == 2
    assert held(store) == want(old=[i for i in range(100) if i != 7], new=[7, 500])
    paths = {f.split("/data/")[1].rsplit("/", 1)[0] for f in store.get("nodes", "book7").inputFiles()}
    assert len(paths) == 1 and store.get("nodes", "book7").count() == 3 and store.get("nodes", "none").count() == 0


def test_deleting_and_emptying(spark, store):
    store.upsert("nodes", rows(spark, range(5), "a"))  # the first write
    store.delete("nodes", ["book1", "book3", "none"])
    assert held(store) == want(a=[0, 2, 4])
    store.delete("nodes", ["book0", "book2", "book4"])
    assert held(store) == [] and {"textbook_id", "n", "value"} <= set(store.read("nodes").columns)
    store.upsert("nodes", rows(spark, [9], "b"))
    assert held(store) == want(b=[9])
    with pytest.raises(ValueError):
        store.upsert("nodes", rows(spark, [9], "b"), key="value")


def test_new_columns_are_null_in_old_rows(spark, store):
    store.upsert("nodes", rows(spark, range(30), "a"))
    store.upsert("nodes", rows(spark, [3], "b", extra=5))
    store.upsert("nodes", rows(spark, [4], "c"))
    assert {(r.textbook_id, r.extra) for r in store.read("nodes").collect()} == {(f"book{i}", 5 if i == 3 else None) for i in range(30)}


def interleaved(spark, store, monkeypatch, other_ids):
    """A writer of book7 whose commit another writer's upsert of other_ids comes before."""
    store.write("nodes", rows(spark, range(40), "old"))
    other, inner, done = S.Store(spark, store.root), S.Store._written, []

    def written(self, table, df, made):
        out = inner(self, table, df, made)
        if self is store and not done:
            done.append(1)
            other.upsert(table, rows(spark, other_ids, "other"))
        return out

    monkeypatch.setattr(S.Store, "_written", written)
    calls = []
    change = S.Store._replaced
    monkeypatch.setattr(S.Store, "_replaced", lambda self, *a: (calls.append(self), change(self, *a))[1])
    store.upsert("nodes", rows(spark, [7], "mine"))
    return calls.count(store)


def bucket_of(spark, store, i):
    return spark.sql(f"SELECT pmod(xxhash64('book{i}'), {store.buckets})").first()[0]


def test_writers_of_other_buckets_do_not_disturb(spark, store, monkeypatch):
    mine = bucket_of(spark, store, 7)
    far = next(i for i in range(8, 40) if bucket_of(spark, store, i) != mine)
    assert interleaved(spark, store, monkeypatch, [far]) == 1
    assert held(store) == want(old=[i for i in range(40) if i not in (7, far)], mine=[7], other=[far])


def test_a_writer_of_the_same_bucket_is_taken_in(spark, store, monkeypatch):
    mine = bucket_of(spark, store, 7)
    near = next(i for i in range(1000, 2000) if bucket_of(spark, store, i) == mine)
    assert interleaved(spark, store, monkeypatch, [near]) == 2  # done again on the other's table
    assert held(store) == want(old=[i for i in range(40) if i != 7], mine=[7], other=[near])


def test_old_versions_go_and_readers_of_the_last_but_one_stay(spark, store):
    for k in range(6):
        store.upsert("nodes", rows(spark, [k], f"v{k}"))
        if k == 4:
            reader = store.read("nodes")
    assert reader.count() == 15 and len(store._versions("nodes")) == S.VERSIONS and store.read("nodes").count() == 18


def test_tables_without_the_key(spark, store):
    chat = spark.createDataFrame([(1, "user", "hello")], "seq long, role string, content string")
    store.append_chat(chat)
    store.append_chat(chat.withColumn("seq", F.col("seq") + 1))
    assert [r.seq for r in store.read("chat").orderBy("seq").collect()] == [1, 2] and list(store.manifest("chat")["files"]) == ["0"]
