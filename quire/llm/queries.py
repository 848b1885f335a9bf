"""The queries opN_<name>: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _third(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import neardup

    return neardup.link(table(spark, sf_dir, "embeddings"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), _third() != 1)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (_third() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import wrapper

    return wrapper.extract(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import suffixes

    return suffixes.remove(table(spark, sf_dir, "documents"))


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import decontam

    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"), 3, 90, 100)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"), F.array("source")).select("doc_id", "size", "source_size", "target", "taken")


def op9_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in eight parts and are compacted; each row's shard and what it stores there."""
    from quire.llm import sharding
    from quire.llm.shared import new_path

    docs = table(spark, sf_dir, "documents")
    store = sharding.Store(spark, new_path(spark, "shards"))
    store.append(docs.withColumn("__arrival", F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int")), "__arrival")
    store.compact()
    placed = store.placed()
    if placed is None:
        return docs.select("doc_id", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).alias("version"), F.xxhash64("text").alias("text_hash")).limit(0)
    return placed.select("doc_id", "shard", "shard_bytes", "version", F.xxhash64("text").alias("text_hash"))


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm import tokens

    path = tokens.write_orc(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.digests(spark, path)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; of each third document, by crc32, the text is lower-cased as the tampering to find."""
    from quire.llm import merkle

    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.coalesce(_third() == 0, F.lit(False)), F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))
    return merkle.verify(merkle.manifest(docs, tampered={"text": tampered}))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, of each tenth, by crc32, after its words repeat from some place on."""
    from quire.llm import periodic

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(F.filter(F.split("text", periodic.WORD_BREAK), lambda w: w != ""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", g.alias("g"), F.when(F.coalesce(h % 10 == 0, F.lit(False)), n).alias("n"))
    start = (F.col("g") % F.col("n")).cast("int")
    period = (1 + F.floor((F.col("n") - start) / (3 + F.col("g") % 8))).cast("int")
    text = F.when(F.col("n") > 0, periodic.repeated(F.col("text"), start, period)).otherwise(F.col("text"))
    found = periodic.find(docs.select("doc_id", text.alias("text")))
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    milli = F.expr("(1000 * best.length) div best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(F.array_join(said, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import fingerprints

    return fingerprints.compare_next(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_nn_descent, op2_quality_crf, op3_wrapper_induction, op4_suffix_dedup, op5_spaced_seeds, op6_jaccard_join, op7_secret_scan, op8_source_mix, op9_size_tiered_shards, op10_token_orc, op11_merkle_manifest, op12_periodic_runs, op13_fingerprints)}
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_nn_descent": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b), c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, vec_id = c.c AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op6_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 90 * (x.n + y.n - inter)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)""",
    "op8_source_mix": f"""WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('7:' || doc_id) AS o FROM documents),
s AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source)),
i AS (SELECT *, row_number() OVER (ORDER BY size / w, k) AS i FROM s),
f AS (SELECT 0::BIGINT AS i, (SELECT 1.5::DOUBLE * sum(size)::DOUBLE FROM s) AS rest, (SELECT sum(w)::DOUBLE FROM s) AS open, 0::DOUBLE AS target UNION ALL
SELECT x.i, f.rest - least(2.0::DOUBLE * x.size, f.rest * x.w / f.open), f.open - x.w, least(2.0::DOUBLE * x.size, f.rest * x.w / f.open) FROM f JOIN i x ON x.i = f.i + 1),
t AS (SELECT i.source, i.size AS source_size, f.target, round(f.target)::BIGINT AS words FROM f JOIN i ON i.i = f.i),
q AS (SELECT d.*, t.source_size, t.target, least(2, t.words // greatest(t.source_size, 1)) AS passes, t.words, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, words - passes * source_size - before)))::BIGINT AS taken FROM q""",
    "op11_merkle_manifest": """WITH RECURSIVE poly AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
d AS (SELECT doc_id, lang, source, n_chars, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 3 = 0 AS bad FROM documents, crcs),
f AS (SELECT doc_id, lang, bad, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
coalesce(strlen(text) || ':' || text, '-') AS said, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low FROM d),
leaf AS (SELECT doc_id, lang, sha256(head || said) AS h, CASE WHEN bad THEN sha256(head || low) ELSE sha256(head || said) END AS other FROM f),
n AS (SELECT *, coalesce('1' || lang, '0') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS m FROM leaf),
up AS (SELECT 0 AS k, g, pos, h, m, '' AS pre FROM n UNION ALL SELECT k + 1, g, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (m + 7) // 8, string_agg(h, '' ORDER BY pos) FROM up WHERE m > 1 GROUP BY k, g, pos // 8, m),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS m FROM up WHERE m = 1),
top AS (SELECT 0 AS k, pos, h, m, '' AS pre FROM sub UNION ALL SELECT k + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (m + 7) // 8, string_agg(h, '' ORDER BY pos) FROM top WHERE m > 1 GROUP BY k, pos // 8, m),
walk AS (SELECT doc_id, h, g, 0 AS k, pos, other AS fold, '' AS proof, FALSE AS above FROM n UNION ALL
SELECT w.doc_id, w.h, w.g, CASE WHEN u.pre IS NULL AND NOT w.above THEN 0 ELSE w.k + 1 END, CASE WHEN u.pre IS NULL THEN s.pos ELSE w.pos // 8 END,
CASE WHEN u.pre IS NULL THEN w.fold ELSE sha256(u.pre[1 : 64 * (w.pos % 8)] || w.fold || u.pre[64 * (w.pos % 8) + 65 :]) END, CASE WHEN u.pre IS NULL THEN w.proof ELSE w.proof || u.pre[1 : 64 * (w.pos % 8)] || u.pre[64 * (w.pos % 8) + 65 :] END, w.above OR u.pre IS NULL
FROM walk w JOIN sub s ON s.g = w.g LEFT JOIN (SELECT k, g, pos, pre, FALSE AS above FROM up WHERE k > 0 UNION ALL SELECT k, '', pos, pre, TRUE FROM top WHERE k > 0) u ON u.above = w.above AND u.k = w.k + 1 AND u.pos = w.pos // 8 AND u.g = CASE WHEN w.above THEN '' ELSE w.g END WHERE u.pre IS NOT NULL OR NOT w.above),
last AS (SELECT * FROM walk WHERE above QUALIFY row_number() OVER (PARTITION BY doc_id, h ORDER BY k DESC) = 1)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(l.proof) AS proof_sha256, l.fold AS folded_root, l.fold = r.h AS verified FROM last l JOIN sub s ON s.g = l.g, (SELECT h FROM top WHERE m = 1) r""",
}
