"""The registered queries on the smallest tables against brute force, and the pipeline stage by stage."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_llm import brute_components, brute_jaccard, brute_suffixes, words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def queries():
    import __spark_entry__

    return __spark_entry__.queries()


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_op1(spark, queries):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    ids = [r.vec_id for r in rows]
    comp = brute_components([(ids[a], ids[b]) for a, b in zip(*np.nonzero(links))], set(ids))
    want = sorted(((i, int(d), comp[i], comp[i] == i) for i, d in zip(ids, links.sum(1))), key=str)
    assert rows_of(queries["op1_nn_descent"](spark, SF).select("vec_id", "n_links", "component_id", "kept")) == want


def test_op2(spark, queries, documents):
    got = queries["op2_quality_crf"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    score = {r.doc_id: r for r in queries["op2_quality_crf"](spark, "/root/testdata/sf0.01").collect()}
    held = [(score[r.doc_id].predicted, r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if score[r.doc_id].held_out and r.quality is not None]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.97


def test_op4(spark, queries, documents):
    got = rows_of(queries["op4_suffix_dedup"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert got == brute_suffixes(documents, 400) and sum(r[2] for r in got) > 0


def leaks(text, item):
    """Whether a run of min(13, the item's) aligned words of which 80 % agree, both ends among them, stands in the text."""
    strip = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
    a, b = ([y for x in words_of(t) if (y := x.strip(strip))] for t in (text, item))
    for shift in range(-len(b) + 1, len(a)):
        same = [a[shift + k] == b[k] if 0 <= shift + k < len(a) else None for k in range(len(b))]
        for i in (k for k, s in enumerate(same) if s):
            total = 0
            for j in range(i, len(b)):
                if same[j] is None:
                    break
                total += same[j]
                if same[j] and j + 1 - i >= min(13, len(b)) and total >= 0.8 * (j + 1 - i) - 1e-9:
                    return True
    return False


def test_op5(spark, queries, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    short = [d for d in documents if len((d[1] or "").split()) < 700]
    want = {(i, k) for i, t in short for k, x in items if leaks(t, x)}
    got = {(r.doc_id, r.item_id) for r in queries["op5_spaced_seeds"](spark, SF).collect()}
    assert want and {p for p in got if p[0] in dict(short)} == want


def test_op6(spark, queries, documents):
    assert rows_of(queries["op6_jaccard_join"](spark, SF).select("doc_id", "n_shingles", "component_id")) == brute_jaccard(documents, 3, 90, 100)


def test_op7(spark, queries, documents):
    texts = dict(documents)
    for r in queries["op7_secret_scan"](spark, SF).collect():
        t = texts[r.doc_id] or ""
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        said = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(want)]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and [s for s in r.spans.split(",") if s and not s.startswith("guess")] == said


def test_op9(spark, queries, documents):
    got = queries["op9_size_tiered_shards"](spark, SF).collect()
    hashes = {r.doc_id: r.h for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.xxhash64("text").alias("h")).collect()}
    assert collections.Counter((r.doc_id, r.text_hash) for r in got) == collections.Counter(hashes.items())
    assert len({r.version for r in got}) == 1 and all(r.shard_bytes > 0 for r in got)


def test_op10(spark, queries, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, t in sorted(documents, key=lambda d: d[0]):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries["op10_token_orc"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


# The pipeline's stages


ODD = "doc_id long, text string, lang string, source string, n_chars long, size int, pattern string, `order` int, Score double, __row string, kept int, `a.b` int, tie long, key string, n int, taken int"


def odd(spark, rows):
    """Documents with columns that are named like what stages work with."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "p", 2, 0.1, "r", 3, 4, 5, "k", 6, 7) for i, t, s in rows], ODD)


def prose(rng, n, lines=3):
    words = "river bridge walk home slowly people under old stone light window garden summer paper letter answer".split()
    return "\n".join(" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n)).capitalize() + "." for _ in range(lines))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng, path = random.Random(51), str(tmp_path_factory.mktemp("tables"))
    good = [(k, prose(rng, 12), "ab"[k % 2]) for k in range(60)]
    junk = [(100 + k, "\n".join(rng.choice(["BUY!! NOW!! " * 6, "x%%% y$$$ z&&& " * 5]) for _ in range(3)), "c") for k in range(30)]
    docs = odd(spark, good + junk + [(None, prose(rng, 9), None), (200, None, "a"), (201, "", "a"), (7, good[7][1], "b"), (300, good[3][1], "a"), (301, good[4][1] + " extra", "a"), (400, prose(rng, 5) + "\n" + good[0][1][:10] + "\n" + " ".join(f"bench{k}" for k in range(30)), "b")])
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in good[:40]] + [(i, 0, 0) for i, *_ in junk[:20]] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(30))), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


def test_every_stage_takes_odd_tables(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, docs, folder)
        if name != "tokens":
            assert got.columns == docs.columns, name
        assert got.count() > 0 and f(spark, docs.limit(0), folder).count() == 0, name


def test_quality_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = [r.doc_id for r in stage("quality")(spark, docs, folder).collect()]
    assert set(range(60)) <= set(got) and not set(range(100, 130)) & set(got) and got.count(7) == 2 and {200, 201, None} <= set(got)


def test_near_duplicate_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = [r.doc_id for r in stage("near duplicates")(spark, docs, folder).collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i for i, _, c in brute_jaccard(rows, 5, 80, 100) if i is not None and i == c}
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1 and not {300, 301} & set(got)


def test_decontamination_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = [r.doc_id for r in stage("decontamination")(spark, docs, folder).collect()]
    assert sorted(map(str, got)) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id != 400)


def test_mix_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = stage("mix")(spark, docs, folder)
    times = collections.Counter(r.doc_id for r in got.collect())
    rows = docs.collect()
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(words_of(r.text))
    taken = collections.Counter()
    for r in got.collect():
        taken[r.source] += len(words_of(r.text))
    assert all(n <= 2 * sum(r.doc_id == i for r in rows) for i, n in times.items()) and 200 not in times and 201 not in times
    assert max(taken[s] - 2 * size[s] for s in size) <= 0 and abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())
    again = stage("mix")(spark, docs.repartition(5), folder)
    assert rows_of(again.select("doc_id", "text", "source")) == rows_of(got.select("doc_id", "text", "source"))


def test_run(spark, folder):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} <= set(range(60)) | {None} and len(got) > 50
    assert sorted(r.start for r in got) == np.concatenate([[0], np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1]]).tolist()


def test_vacuum_spares_writers_and_readers(spark, tmp_path):
    from quire.llm import sharding

    store = sharding.Store(spark, f"file://{tmp_path}/s", fan=2, target=1 << 20)
    for k in range(4):
        store.append(spark.range(100 * k, 100 * k + 100))
    before, version = store.read(), store.version()
    pending = store._write(spark.range(5000, 5100).withColumn("__arrival", F.lit(0)), "__arrival", version + 1)  # another writer, before its commit
    store.compact()
    store.vacuum()
    assert len(store.versions()) == sharding.KEPT and before.count() == 400  # a reader of the version before still reads
    other = sharding.Store(spark, store.root)
    other.commit(other.shards() + pending, other.version())
    assert other.read().count() == 500
    store._write(spark.range(9).withColumn("__arrival", F.lit(0)), "__arrival", 99)  # a writer that failed
    lost = lambda: [p for p, *_ in store._files("data") if "v000000000099" in p and p.endswith(".parquet")]
    store.vacuum(keep=1)
    assert lost()
    store.vacuum(keep=1, age=0)
    assert not lost() and store.read().count() == 500 and store.versions() == [store.version()]


def test_shards_keep_columns_of_any_name(spark, tmp_path):
    from quire.llm import sharding

    store = sharding.Store(spark, f"file://{tmp_path}/s", fan=2, target=1 << 20)
    row = "id AS doc_id, id * 2 AS __group, cast(id AS string) AS __name, id * 3 AS `a.b`, id * 4 AS version, id * 5 AS Shard"
    for k in range(4):
        store.append(spark.range(10 * k, 10 * k + 10).selectExpr(*row.split(", ")))
    store.compact()
    want = sorted((i, 2 * i, str(i), 3 * i, 4 * i, 5 * i) for i in range(40))
    assert sorted(tuple(r) for r in store.read().collect()) == want and len(store.shards()) < 4
    got = store.placed().collect()
    assert sorted((r.doc_id, r["__group"], r["__name"]) for r in got) == [w[:3] for w in want] and {r.version for r in got} == {store.version()}
