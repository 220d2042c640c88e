"""The queries opN_<name> over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import balls, bestfit, credentials, imatch, jaccard, ladder, licenses, lines, packing, passages, pieces, repeats
from threadloom.llm.shared import shared_table


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document: those that stand alone, and all with the linked weak parts."""
    found = credentials.scan_secrets(_table(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("secrets", lambda x: x["kind"].isin(*credentials.KINDS[:3]))
    linked = F.size(F.filter("secrets", lambda x: x["partner"] >= 0)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), linked.alias("n_linked"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the digest of its whole canonical text, and by its lines that are known notices."""
    found = licenses.scan_licenses(_table(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "license_digest", "license_id", F.array_join("notices", ",").alias("notices"), "n_license_lines")


#: The model that op3 encodes with; a parameter of the environment, as the file isn't part of this repository.
MODEL_FILE = os.environ.get("THREADLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every whole text, and whether decoding gives the text again."""
    with open(MODEL_FILE, "rb") as f:
        model = f.read()
    docs = _table(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = pieces.decode(pieces.encode(docs, model), model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in a batch for every document."""
    return packing.pack(_table(spark, sf_dir).select("doc_id", "text"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document: three-word shingles, similarity of 0.9 or more."""
    return jaccard.jaccard_components(_table(spark, sf_dir).select("doc_id", "text"), words=3, percent=90)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts and the verdict for every document."""
    return lines.quality_rules(_table(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


def op7_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return imatch.edited_pairs(_table(spark, sf_dir).select("doc_id", "text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its host's boilerplate lines."""
    return lines.drop_frequent_lines(_table(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("text"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its runs of 100 bytes that start earlier in the corpus."""
    found = repeats.remove_repeats(_table(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of every document that nearly repeat one of an earlier document, and the class that passages connect it with."""
    docs = _table(spark, sf_dir).select("doc_id", "text")
    found = shared_table(passages.near_passages(docs), "passages-found")
    return passages.summary(docs, found).join(passages.classes(found), "doc_id", "left").withColumn("class_id", F.coalesce("class_id", F.col("doc_id").cast("long")))


#: The vocabulary that op11 encodes with.
VOCABULARY_FILE = os.environ.get("THREADLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in a sequence of 2048 tokens for every piece of every document."""
    pieces_ = bestfit.cut(_table(spark, sf_dir).select("doc_id", "text"), VOCABULARY_FILE, capacity=2048)
    return bestfit.place(pieces_.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


#: Items whose revenues one key of op12's state holds.
ITEMS_A_SHARD = 16_384


def op12_leaderboard_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of every nation's ten best items by revenue, arrival day after arrival day."""
    items = _table(spark, sf_dir, "items")
    events = ladder.sale_events(_table(spark, sf_dir, "sale_lines"), _table(spark, sf_dir, "vendors"), items)
    feed = ladder.change_feed(events, shards=max(8, -(-items.count() // ITEMS_A_SHARD)))
    return feed.withColumnRenamed("board", "nation_id")


def op13_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after five rounds with 40 centroids, and its exact distance."""
    return balls.cluster(balls.scaled_vectors(_table(spark, sf_dir, "embeddings")), size=64, k=40, rounds=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_license_scan": op2_license_scan,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_packing": op4_packing,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_quality_rules": op6_quality_rules,
        "op7_imatch_fingerprints": op7_imatch_fingerprints,
        "op8_line_dedup": op8_line_dedup,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_compact_windows": op10_compact_windows,
        "op11_best_fit_packing": op11_best_fit_packing,
        "op12_leaderboard_feed": op12_leaderboard_feed,
        "op13_ball_tree_clusters": op13_ball_tree_clusters,
    }


_WS = r"[\x20\x09-\x0D]+"
_TRIM = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FREQUENT = r"""
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, chr(0)) AS host FROM documents),
l AS (
  SELECT doc_id, host, text, pos, line, translate(regexp_replace(trim(line, {trim}), '{ws}', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)
  WHERE trim(line, {trim}) <> ''),
frequent AS (
  SELECT host, norm FROM l JOIN (SELECT host, count(*) AS pages FROM d GROUP BY host) USING (host)
  GROUP BY host, norm, pages HAVING count(DISTINCT doc_id) >= {min_pages} AND count(DISTINCT doc_id) > pages * {share})"""


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain assignment of every vector to all centroids, round by round."""
    square = "list_inner_product({a}, {a})"
    to = f"{square.format(a='x.f')} - 2 * list_inner_product(x.f, c.f) + {square.format(a='c.f')}"
    parts = [
        f"x AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS f FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), f) - 1 AS cluster, f FROM x QUALIFY cluster < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT n, arg_min(struct_pack(c := cluster, d := d), d * 64 + cluster) AS best FROM (SELECT x.n, c.cluster, {to} AS d FROM x, c{r} c) GROUP BY n)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT best.c AS cluster, i, sum(CAST(f[i] AS BIGINT)) AS s, count(*) AS m FROM x JOIN a{r} USING (n), range(1, 65) t(i) GROUP BY 1, 2)")
            parts.append(f"m{r} AS (SELECT cluster, list(CAST((s - ((s % m) + m) % m) // m AS DOUBLE) ORDER BY i) AS f FROM s{r} GROUP BY cluster)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.f, c.f) AS f FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT x.vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(CAST(best.d AS BIGINT)) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(CAST(best.d AS BIGINT)) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.f, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM x JOIN a{rounds} USING (n) JOIN c{rounds} c ON c.cluster = best.c"""


def oracle_sql() -> dict[str, str]:
    spell = "lower(coalesce(text, ''))"
    spell = rf"regexp_replace({spell}, '(?m){licenses.COPYRIGHT_LINE}', '', 'g')"
    for a, b in licenses.SPELLINGS:
        spell = f"replace({spell}, '{a}', '{b}')"
    spell = rf"regexp_replace(regexp_replace({spell}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
    spell = spell.replace(r"\n", "\\n")
    canonical = lambda v: f"trim(regexp_replace({spell.replace('coalesce(text, ' + chr(39) * 2 + ')', v)}, '[ \\n]+', ' ', 'g'))"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = lambda pairs: ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(pairs.items()))
    return {
        "op2_license_scan": f"""
WITH known AS (SELECT sha256({canonical('t')}) AS digest, min(id) AS license_id FROM (VALUES {values(licenses.TEXTS)}) k(id, t) GROUP BY 1),
notice AS (SELECT id, {canonical('t')} AS line FROM (VALUES {values(licenses.NOTICES)}) n(id, t)),
d AS (SELECT doc_id, {spell} AS c FROM documents),
x AS (SELECT doc_id, c, sha256(trim(regexp_replace(c, '[ \\n]+', ' ', 'g'))) AS digest FROM d),
hits AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(id))), ',') AS notices, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(c, chr(10)))) AS line FROM d) JOIN notice USING (line) GROUP BY doc_id)
SELECT doc_id, digest AS license_digest, license_id, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_license_lines
FROM x LEFT JOIN known USING (digest) LEFT JOIN hits USING (doc_id)""",
        "op6_quality_rules": f"""
WITH {_FREQUENT.format(trim=_TRIM, ws=_WS, min_pages=20, share=0.1)},
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '') AS words FROM d),
win AS (SELECT doc_id, i, words[i:i+2] AS g FROM w, unnest(range(1, len(words) - 1)) r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) o(k) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
gone AS (SELECT doc_id, sum(len(list_filter(string_split_regex(line, '{_WS}'), lambda x: x <> ''))) AS n FROM l JOIN frequent USING (host, norm) GROUP BY doc_id),
c AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(words) - coalesce(gone.n, 0) AS words_left
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= 0.3 * n_words AS kept, CAST(words_left AS BIGINT) AS words_left
FROM c""",
        "op8_line_dedup": f"""
WITH {_FREQUENT.format(trim=_TRIM, ws=_WS, min_pages=10, share=0.1)},
a AS (
  SELECT doc_id, host, pos, line, trim(line, {_TRIM}) <> '' AS solid, translate(regexp_replace(trim(line, {_TRIM}), '{_WS}', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
m AS (SELECT a.*, solid AND f.norm IS NOT NULL AS dropped FROM a LEFT JOIN frequent f ON a.host = f.host AND a.norm = f.norm)
SELECT doc_id, count(*) FILTER (solid) AS n_lines, count(*) FILTER (dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text
FROM m GROUP BY doc_id""",
        "op13_ball_tree_clusters": _clusters_sql(),
    }
