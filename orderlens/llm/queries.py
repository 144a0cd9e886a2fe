"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from orderlens.llm import bpe, exact_search, merkle, near_search, ngram_join, packing, quality, sanitise, secretscan, sharding, slack_packing, toxicity, variants
from orderlens.llm.labelled import held_out

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.packed(_table(spark, directory, "documents"), VOCABULARY, projection=packing.CHECKSUM)


def op2_near_search(spark: SparkSession, directory: str) -> DataFrame:
    return near_search.nearest(_table(spark, directory, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_sanitise(spark: SparkSession, directory: str) -> DataFrame:
    found = sanitise.found(_table(spark, directory, "documents"), ["doc_id"])
    counts = [
        F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(sanitise.KINDS[:4])
    ]
    base = F.filter("spans", lambda s: s["kind"] < 4)
    digest = F.sha2(sanitise.joined(base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, sanitise.joined(F.col("spans")).alias("spans"))


def op4_exact_search(spark: SparkSession, directory: str) -> DataFrame:
    return exact_search.top_k(_table(spark, directory, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op5_sharding(spark: SparkSession, directory: str) -> DataFrame:
    places = sharding.sharded(_table(spark, directory, "documents"), ["lang", "source", "n_chars"], 24)
    return places.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op6_ngram_join(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_join.joined(_table(spark, directory, "documents"), words=4, bound=ngram_join.Bound(85, 100))


def op7_quality(spark: SparkSession, directory: str) -> DataFrame:
    docs = _table(spark, directory, "documents")
    model = quality.fit(docs, _table(spark, directory, "labels"))
    return _judged(quality.scored(docs, model), 0.7)


def op8_secret_scan(spark: SparkSession, directory: str) -> DataFrame:
    found = secretscan.scanned(_table(spark, directory, "documents"))
    base = F.filter("_spans", lambda s: s["kind"] != "random")
    counts = [
        F.size(F.filter("_spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")
    ]
    digest = F.sha2(secretscan.joined(base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secretscan.joined(F.col("_spans")).alias("spans"))


def _of_kind(kind: str | int):
    return lambda span: span["kind"] == kind


def op9_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return bpe.encoded(_table(spark, directory, "documents"), VOCABULARY, projection=bpe.DIGESTS)


def op10_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs = _table(spark, directory, "documents")
    model = toxicity.fit(docs, _table(spark, directory, "labels"))
    return _judged(toxicity.scored(docs, model), 0.3)


def op11_variants(spark: SparkSession, directory: str) -> DataFrame:
    return variants.grouped(_table(spark, directory, "documents"))


def op12_slack_packing(spark: SparkSession, directory: str) -> DataFrame:
    return slack_packing.packed(
        _table(spark, directory, "documents"), WORD_VOCABULARY, projection=slack_packing.CHECKSUM
    )


def op13_merkle(spark: SparkSession, directory: str) -> DataFrame:
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    climbed = merkle.manifest(
        _table(spark, directory, "documents"), ["doc_id", "source", "lang", "n_chars", "text"],
        {"text": F.coalesce(changed, "text")},
    )
    proof = F.sha2("proof", 256).alias("proof_sha256")
    return climbed.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def _judged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_near_search": op2_near_search,
    "op3_sanitise": op3_sanitise,
    "op4_exact_search": op4_exact_search,
    "op5_sharding": op5_sharding,
    "op6_ngram_join": op6_ngram_join,
    "op7_quality": op7_quality,
    "op8_secret_scan": op8_secret_scan,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_variants": op11_variants,
    "op12_slack_packing": op12_slack_packing,
    "op13_merkle": op13_merkle,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op4_exact_search": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM vectors q JOIN vectors r ON q.vec_id <> r.vec_id
            WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scores
        QUALIFY rank <= 20
    """,
    "op11_variants": """
        WITH RECURSIVE crc_table AS (
            SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
                lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), runs AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
            FROM documents
        ), counted AS (
            SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h
            FROM runs WHERE length(run) >= 7 GROUP BY ALL
        ), checksums AS (
            SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                range(1, length(h), 2),
                lambda i: (instr('0123456789ABCDEF', h[i]) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 17)::BIGINT)),
                lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS crc
            FROM counted, crc_table
        ), words AS (
            SELECT CASE WHEN crc % 31 = 0 THEN run[:crc % length(run)] || run[crc % length(run) + 2:] ELSE run END AS word,
                   sum(c)::BIGINT AS n
            FROM checksums GROUP BY 1 HAVING sum(c) >= 2 AND length(word) >= 7
        ), places AS (
            SELECT word, n, unnest(range(length(word))) AS i FROM words
        ), skips AS (
            SELECT word, n, i, word[:i] AS head, word[i + 2:] AS tail FROM places
        ), near AS (
            SELECT a.word, b.word AS other, b.n FROM skips a JOIN skips b
            ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
            UNION
            SELECT s.word, w.word, w.n FROM skips s JOIN words w ON w.word = s.head || s.tail
            UNION
            SELECT w.word, s.word, s.n FROM skips s JOIN words w ON w.word = s.head || s.tail
        ), best AS (
            SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near FROM near
            QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1
        ), forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN other END AS form,
                   CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n
            FROM words w LEFT JOIN best b USING (word)
        ), followed(word, root, step) AS (
            SELECT word, word, 0 FROM forms
            UNION ALL
            SELECT f.word, g.form, step + 1 FROM followed f JOIN forms g ON g.word = f.root WHERE g.form IS NOT NULL
        )
        SELECT f.word, form, max_by(root, step) AS root, n, n_near, form_n
        FROM forms f JOIN followed USING (word) GROUP BY ALL
    """,
    # The checksum's bits and both trees, level by level.
    "op13_merkle": r"""
        WITH RECURSIVE crc_table AS (
            SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
                lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), checksums AS (
            SELECT DISTINCT doc_id, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS crc
            FROM documents, crc_table
        ), written AS (
            SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') ||
                   coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') ||
                   coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
            FROM documents
        ), digests AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS changed
            FROM written
        ), leaves AS (
            SELECT d.doc_id, d.source, leaf, CASE WHEN crc % 2 = 0 THEN changed ELSE leaf END AS start,
                   row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id NULLS FIRST, leaf) - 1 AS idx,
                   dense_rank() OVER (ORDER BY d.source NULLS FIRST) - 1 AS tree, row_number() OVER () AS row
            FROM digests d LEFT JOIN checksums c ON c.doc_id = d.doc_id
        ), nodes(tree, level, idx, digest, n) AS (
            SELECT tree, 0, idx, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
            UNION ALL
            SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3
            FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3
        ), uppers(level, idx, digest, n) AS (
            SELECT 0, tree, digest, count(*) OVER () FROM nodes WHERE n = 1
            UNION ALL
            SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3
            FROM uppers WHERE n > 1 GROUP BY level, idx // 3
        ), runs AS (
            SELECT tree, level, idx // 3 AS run, list(digest ORDER BY idx) AS children, any_value(n) AS n
            FROM nodes WHERE n > 1 GROUP BY ALL
            UNION ALL
            SELECT -1, level, idx // 3, list(digest ORDER BY idx), any_value(n) FROM uppers WHERE n > 1 GROUP BY ALL
        ), climb(row, tree, level, idx, folded, proof) AS (
            SELECT row, CASE WHEN n = 1 THEN -1 ELSE tree END, 0, CASE WHEN n = 1 THEN tree ELSE leaves.idx END, start, ''
            FROM leaves JOIN (SELECT tree AS of, n FROM nodes WHERE level = 0 AND idx = 0) ON tree = of
            UNION ALL
            SELECT row, CASE WHEN n <= 3 THEN -1 ELSE c.tree END,
                   CASE WHEN c.tree = -1 OR n > 3 THEN c.level + 1 ELSE 0 END,
                   CASE WHEN n <= 3 AND c.tree >= 0 THEN c.tree ELSE run END,
                   sha256(array_to_string(list_concat(children[:idx % 3], [folded], children[idx % 3 + 2:]), '')),
                   proof || array_to_string(list_concat(children[:idx % 3], children[idx % 3 + 2:]), '')
            FROM climb c JOIN runs r ON c.tree = r.tree AND c.level = r.level AND c.idx // 3 = r.run
        )
        SELECT l.doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256,
               folded AS folded_root, folded = r.digest AS verified
        FROM leaves l
        JOIN (SELECT row, max_by(folded, strlen(proof)) AS folded, max(proof) AS proof, max_by(level, level) AS top
              FROM (SELECT *, max(strlen(proof)) OVER (PARTITION BY row) AS most FROM climb) WHERE strlen(proof) = most
              GROUP BY row) c USING (row)
        JOIN (SELECT tree, digest FROM nodes WHERE n = 1) s USING (tree), (SELECT digest FROM uppers WHERE n = 1) r
    """,
    "op6_ngram_join": r"""
        WITH RECURSIVE tokens AS (
            SELECT doc_id, list_filter(
                regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\x20\x09-\x0D]+'
                ), lambda w: w <> '') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                END AS shingles
            FROM tokens
        ), elements AS (
            SELECT doc_id, unnest(shingles) AS shingle FROM sets
        ), shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
            FROM elements x JOIN elements y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared
            JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
            WHERE 100 * n >= 85 * (len(x.shingles) + len(y.shingles) - n)
        ), steps AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reached(doc_id, root) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT steps.b, reached.root FROM reached JOIN steps ON steps.a = reached.doc_id
        )
        SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, min(root) AS component_id
        FROM sets JOIN reached USING (doc_id) GROUP BY ALL
    """,
}
