"""Queries over the driver's tables, each by an operator of this package, and the SQL they must equal.

Snapshots on `events`: a snapshot is a day, an identity a user, a version the day's rows of the user. Trees on
`conversations`: the parent of a turn is (turn - 1) div 2.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import canonical, text
from threadloom.operators import analytics, annotations, graph, memory, object_graph, postings, recall, search, semantic, snapshots, validation

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PHRASE, LITERAL = "the", "100%"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Windows, filters and search over conversations


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def latest_turn_per_conversation(spark, d):
    return snapshots.latest_by(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")])


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')")
def visible_message_filter(spark, d):
    return table(spark, d, "conversations").where(recall.visible(F.col("role"))).select("conv_id", "turn", "role")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def visible_json_filter(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k >= 50")


@query(f"""
WITH d AS (SELECT conv_id, turn, lower(text) AS t FROM conversations),
s AS (SELECT count(*) AS n, avg(greatest(length(t) - 2, 0)) AS mean, count(*) FILTER (contains(t, '{PHRASE}')) AS df FROM d),
h AS (SELECT conv_id, turn, greatest(length(t) - 2, 0) AS dl, len(list_filter(range(1, length(t) - {len(PHRASE)} + 2), lambda i: substring(t, i, {len(PHRASE)}) = '{PHRASE}')) AS tf FROM d WHERE contains(t, '{PHRASE}')),
b AS (SELECT conv_id, turn, -greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS score FROM h, s),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score, turn) AS k FROM b)
SELECT conv_id, turn, round(score, 6) + 0.0 AS score FROM r WHERE k = 1""")
def keyword_search_best_hit(spark, d):
    found = search.search_threads(table(spark, d, "conversations"), PHRASE, group="conv_id", text_col="text", order_col="turn")
    return found.select("conv_id", "turn", (F.round("score", 6) + F.lit(0.0)).alias("score"))


@query(f"""
WITH h AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn DESC) AS k
  FROM conversations WHERE role IN ('user', 'assistant') AND contains(lower(text), '{PHRASE}'))
SELECT conv_id, turn, role, k AS hit_rank FROM h WHERE k <= 2""")
def keyword_search_top_n_budget_input(spark, d):
    found = table(spark, d, "conversations").where(recall.visible(F.col("role")) & search.matches(F.col("text"), PHRASE))
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.col("role") == "user"), F.desc("turn"))
    return found.withColumn("hit_rank", F.row_number().over(order).cast("long")).where("hit_rank <= 2").select("conv_id", "turn", "role", "hit_rank")


@query(r"SELECT doc_id FROM documents WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%\%%%' ESCAPE '\' OR translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%t\_t%' ESCAPE '\'")
def literal_like_escaped(spark, d):
    return table(spark, d, "documents").where(text.like_literal(F.col("text"), "%") | text.contains_ascii_folded(F.col("text"), "T_t")).select("doc_id")


@query("""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
s AS (SELECT count(*) AS n, avg(greatest(length(t) - 2, 0)) AS mean, count(*) FILTER (contains(t, 'tion')) AS df FROM d),
h AS (SELECT doc_id, greatest(length(t) - 2, 0) AS dl, len(list_filter(range(1, length(t) - 2), lambda i: substring(t, i, 4) = 'tion')) AS tf FROM d WHERE contains(t, 'tion'))
SELECT doc_id, CAST(tf AS BIGINT) AS tf, round(-greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM h, s""")
def bm25_phrase(spark, d):
    found = search.bm25(table(spark, d, "documents"), "tion")
    return found.select("doc_id", search.occurrences(F.col("text"), "tion").cast("long").alias("tf"), F.round("score", 6).alias("score"))


@query("""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*) AS n, avg(greatest(length(t) - 2, 0)) AS mean, count(*) FILTER (contains(t, 'license')) AS df FROM d),
h AS (SELECT doc_id, greatest(length(t) - 2, 0) AS dl, len(list_filter(range(1, length(t) - 5), lambda i: substring(t, i, 7) = 'license')) AS tf FROM d WHERE contains(t, 'license'))
SELECT doc_id, CAST(tf AS BIGINT) AS tf, round(-greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM h, s""")
def indexed_phrase_search(spark, d):
    root = f"{graph.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    postings.add_documents(spark, root, "all", table(spark, d, "documents").select("doc_id", "text"))
    return postings.ranked(spark, root, "License").select(F.col("id").alias("doc_id"), "tf", F.round("score", 6).alias("score"))


@query("""
WITH g AS (SELECT conv_id, turn, substring(lower(text), i, 3) AS trigram FROM conversations, unnest(range(1, length(text) - 1)) u(i))
SELECT trigram, count(DISTINCT (conv_id, turn)) AS n_docs, count(*) AS n_occurrences FROM g GROUP BY trigram""")
def trigram_postings(spark, d):
    return search.trigram_postings(table(spark, d, "conversations"), ["conv_id", "turn"], "text")


@query("""
SELECT conv_id, turn, greatest(0, CASE WHEN position('tion' IN lower(text)) > 0 THEN position('tion' IN lower(text)) - 1 - 20 ELSE 0 END) AS text_offset, length(text) AS length
FROM conversations WHERE contains(lower(text), 'tion')""")
def clip_window(spark, d):
    found = table(spark, d, "conversations").where(search.matches(F.col("text"), "tion"))
    return recall.clipped(found, "tion", "text", 80).select("conv_id", "turn", F.col("text_offset").cast("long").alias("text_offset"), F.col("length").cast("long").alias("length"))


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations),
a AS (SELECT conv_id, position AS anchor FROM p WHERE turn = 3)
SELECT p.conv_id, p.turn, p.position - anchor AS distance FROM p JOIN a USING (conv_id) WHERE position >= greatest(0, anchor - 2) AND position < greatest(0, anchor - 2) + 5""")
def context_window(spark, d):
    rows = table(spark, d, "conversations")
    found = recall.context(rows, rows.where("turn = 3"), thread="conv_id", order=[F.asc("turn")], message="turn", limit=5)
    return found.select("conv_id", "turn", F.col("distance").cast("long").alias("distance"))


@query("SELECT a.conv_id, a.turn, b.role AS previous_role, a.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1")
def adjacent_self_join(spark, d):
    rows = table(spark, d, "conversations")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("previous_role"))
    return rows.join(before, ["conv_id", "turn"]).select("conv_id", "turn", "previous_role", "role")


# Vectors


@query("SELECT doc_id, unnest(range(0, greatest(length(text) - 100, 1), 500)) AS chunk_offset FROM documents WHERE length(text) > 0")
def chunk_offsets(spark, d):
    return semantic.chunks(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.col("chunk_offset").cast("long").alias("chunk_offset"))


_COSINE = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"


@query(f"SELECT a.vec_id, round({_COSINE}, 6) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COSINE} DESC, a.vec_id LIMIT 40")
def cosine_top40(spark, d):
    rows = table(spark, d, "embeddings")
    found = semantic.top_similar(rows, rows.where("vec_id = 0"), id_col="vec_id", vector_col="embedding")
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"""
WITH s AS (SELECT a.vec_id, a.label, {_COSINE} AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, a.vec_id LIMIT 40),
r AS (SELECT vec_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank_first, row_number() OVER (ORDER BY label, vec_id) AS rank_second FROM s)
SELECT vec_id, rank_first, rank_second, round(1.0::DOUBLE / (60 + rank_first) + 1.0::DOUBLE / (60 + rank_second), 9) AS fused FROM r""")
def rank_fusion(spark, d):
    rows = table(spark, d, "embeddings")
    found = semantic.top_similar(rows, rows.where("vec_id = 0"), id_col="vec_id", vector_col="embedding")
    fused = semantic.fuse_ranks(found, [F.desc("similarity"), F.asc("vec_id")], [F.asc("label"), F.asc("vec_id")])
    return fused.select("vec_id", "rank_first", "rank_second", F.round("fused", 9).alias("fused"))


# Distributions


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS messages, count(DISTINCT user_id) AS threads FROM events WHERE ts IS NOT NULL GROUP BY 1")
def activity_month(spark, d):
    return analytics.activity_by_month(table(spark, d, "events"), F.col("ts"), "user_id")


@query("""
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS messages, count(DISTINCT o_custkey) AS threads FROM orders GROUP BY 1)
SELECT substring(month, 1, 4) AS year, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(threads) AS BIGINT) AS threads_month_sum FROM m GROUP BY 1""")
def activity_year_sum(spark, d):
    return analytics.activity_by_year(analytics.activity_by_month(table(spark, d, "orders"), F.col("o_orderdate"), "o_custkey"))


@query("SELECT coalesce(role, 'unlabeled') AS role, count(*) AS n FROM conversations GROUP BY 1")
def role_distribution(spark, d):
    return analytics.distribution(table(spark, d, "conversations"), F.col("role"), "role")


@query("SELECT coalesce(event_type, 'unlabeled') AS event_type, count(*) AS n FROM events GROUP BY 1")
def type_distribution(spark, d):
    return analytics.distribution(table(spark, d, "events"), F.col("event_type"), "event_type")


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_key_distribution(spark, d):
    return analytics.distribution(table(spark, d, "events"), F.get_json_object("props", "$.k"), "k")


@query("""
WITH g AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
SELECT o_orderpriority, count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS extra FROM g JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def two_level_group_having(spark, d):
    groups = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n")).where("n > 1")
    return groups.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("extra"))


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def status_counts_conditional(spark, d):
    return analytics.status_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS bytes FROM (SELECT DISTINCT p_partkey, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1")
def distinct_then_sum(spark, d):
    used = table(spark, d, "part").join(table(spark, d, "lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return used.dropDuplicates(["p_partkey"]).groupBy("p_brand").agg(F.sum(F.col("p_size").cast("long")).alias("bytes"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def pivot_zero_fill(spark, d):
    return analytics.pivot_counts(table(spark, d, "events"), ["user_id"], "event_type", ["click", "purchase", "view"])


@query("SELECT l_returnflag, CASE WHEN count(l_tax) = count(*) THEN sum(CAST(l_linenumber AS BIGINT)) END AS total, round(coalesce(count(*) FILTER (l_linestatus = 'O') * 1.0 / nullif(count(*), 0), 0), 6) AS open_share FROM lineitem GROUP BY 1")
def complete_sums_and_ratios(spark, d):
    rows = table(spark, d, "lineitem").withColumn("n", F.col("l_linenumber").cast("long"))
    return rows.groupBy("l_returnflag").agg(analytics.complete_sum("n").alias("total"), text.ratio(F.count_if(F.col("l_linestatus") == "O"), F.count("*")).alias("open_share"))


# Snapshots

_DAYS = """
obs AS (SELECT date_trunc('day', ts) AS snapshot, user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS v FROM events GROUP BY 1, 2),
snap AS (SELECT DISTINCT snapshot FROM obs),
grid AS (SELECT s.snapshot, f.user_id FROM snap s JOIN (SELECT user_id, min(snapshot) AS since FROM obs GROUP BY 1) f ON s.snapshot >= f.since),
filled AS (SELECT g.snapshot, g.user_id, o.n, last_value(o.snapshot IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.snapshot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM grid g LEFT JOIN obs o ON o.snapshot = g.snapshot AND o.user_id = g.user_id),
absent AS (SELECT snapshot, user_id, prior FROM filled WHERE n IS NULL)"""


def _days(spark, d):
    seen = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("snapshot"), "user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("version"))
    return seen, seen.select("snapshot").distinct().withColumn("captured_at", F.col("snapshot"))


@query(f"WITH {_DAYS} SELECT strftime(snapshot, '%Y-%m-%d') AS snapshot, user_id, strftime(prior, '%Y-%m-%d') AS prior_snapshot FROM absent")
def source_absence(spark, d):
    seen, captures = _days(spark, d)
    return snapshots.source_absences(seen, captures, identity="user_id")


@query(f"""
WITH {_DAYS},
ordered AS (SELECT snapshot, lag(snapshot) OVER (ORDER BY snapshot) AS previous FROM snap),
cmp AS (SELECT n.snapshot, p.user_id IS NULL AS added, p.user_id IS NOT NULL AND p.v IS DISTINCT FROM n.v AS changed FROM obs n JOIN ordered USING (snapshot) LEFT JOIN obs p ON p.snapshot = previous AND p.user_id = n.user_id WHERE previous IS NOT NULL)
SELECT strftime(s.snapshot, '%Y-%m-%d') AS snapshot, coalesce(c.added, 0) AS added, coalesce(c.changed, 0) AS changed, coalesce(a.absent, 0) AS absent FROM snap s
LEFT JOIN (SELECT snapshot, count(*) FILTER (added) AS added, count(*) FILTER (changed) AS changed FROM cmp GROUP BY 1) c USING (snapshot)
LEFT JOIN (SELECT snapshot, count(*) AS absent FROM absent GROUP BY 1) a USING (snapshot)""")
def snapshot_deltas(spark, d):
    seen, captures = _days(spark, d)
    return snapshots.snapshot_deltas(seen, captures, identity="user_id")


@query(f"""
WITH {_DAYS}, who AS (SELECT DISTINCT user_id FROM obs)
SELECT w.user_id, strftime(s.snapshot, '%Y-%m-%d') AS snapshot, CASE WHEN o.user_id IS NOT NULL THEN 'present' WHEN a.user_id IS NOT NULL THEN 'absent_in_snapshot' ELSE 'unknown' END AS state
FROM who w CROSS JOIN snap s LEFT JOIN obs o ON o.snapshot = s.snapshot AND o.user_id = w.user_id LEFT JOIN absent a ON a.snapshot = s.snapshot AND a.user_id = w.user_id""")
def presence_history(spark, d):
    seen, captures = _days(spark, d)
    return snapshots.presence_history(seen, captures, seen.select("user_id").distinct(), identity="user_id")


@query(f"""
WITH {_DAYS}, num AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS k FROM snap),
s AS (SELECT user_id, k, n IS NULL AS gone FROM filled JOIN num USING (snapshot)),
i AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, gone ORDER BY k) AS island FROM s)
SELECT user_id, CASE WHEN gone THEN 'absent' ELSE 'present' END AS state, min(k) AS first, max(k) AS last FROM i GROUP BY user_id, gone, island""")
def presence_runs(spark, d):
    seen, captures = _days(spark, d)
    return snapshots.presence_runs(seen, captures, identity="user_id")


@query("""
SELECT event_type AS store, count(*) AS n, sha256(string_agg(event_id || chr(0) || sha256(props) || chr(0) || sha256(CAST(user_id AS VARCHAR)) || chr(0), '' ORDER BY event_id)) AS digest
FROM events GROUP BY event_type""")
def chained_store_digest(spark, d):
    hashed = lambda c: F.sha2(F.col(c).cast("string"), 256)
    rows = table(spark, d, "events").select(F.col("event_type").alias("store"), F.col("event_id").alias("cursor_ordinal"), hashed("props").alias("canonical_row_sha256"), hashed("user_id").alias("decoded_value_sha256"))
    return validation.store_digests(rows)


_STEPS = """
step AS (SELECT o_orderpriority AS graph, l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 15),
edge AS (SELECT DISTINCT graph, source, target FROM step WHERE target IS NOT NULL),
root AS (SELECT DISTINCT o_orderpriority AS graph, l_partkey AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity = 50 AND l_discount = 0)"""


@query(f"""
WITH RECURSIVE {_STEPS},
walk AS (SELECT graph, node, 0 AS depth FROM root UNION SELECT w.graph, e.target, w.depth + 1 FROM walk w JOIN edge e ON w.graph = e.graph AND w.node = e.source WHERE w.depth < 60)
SELECT graph, node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY graph, node""")
def object_graph_reach(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("graph"), F.col("l_partkey").alias("source"), "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    ahead = F.lead("source").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "source"))
    edges = lines.where("l_quantity > 15").select("graph", "source", ahead.alias("target"))
    roots = lines.where("l_quantity = 50 AND l_discount = 0").select("graph", F.col("source").alias("node"))
    return object_graph.reachable_from(edges, roots)


@query(f"""
WITH {_DAYS}, two AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS i FROM snap),
a AS (SELECT user_id, n FROM obs JOIN two USING (snapshot) WHERE i = 1), b AS (SELECT user_id, n FROM obs JOIN two USING (snapshot) WHERE i = 2)
SELECT count(*) FILTER (a.user_id IS NULL) AS added, count(*) FILTER (a.n <> b.n) AS updated, count(*) FILTER (a.n = b.n) AS unchanged, count(*) FILTER (b.user_id IS NULL) AS not_present FROM a FULL JOIN b USING (user_id)""")
def update_summary(spark, d):
    seen, captures = _days(spark, d)
    ranked = seen.join(captures.withColumn("i", F.row_number().over(Window.orderBy("snapshot"))), "snapshot")
    return snapshots.update_summary(ranked.where("i = 1"), ranked.where("i = 2"), "user_id", "n")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'view'")
def latest_feedback(spark, d):
    return snapshots.current_feedback(table(spark, d, "events"), "user_id", "event_id", "event_type", cancel="view")


@query("SELECT count(*) AS identities, (SELECT count(*) FROM (SELECT DISTINCT conv_id, role, sha256(text) FROM conversations)) AS versions, (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn, role, sha256(text) FROM conversations)) AS observations FROM (SELECT DISTINCT conv_id, role FROM conversations)")
def identity_version_observation(spark, d):
    rows = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "role").alias("identity"), F.sha2("text", 256).alias("raw_sha256"), "turn", "text")
    parts = snapshots.decompose(rows, "identity", "raw_sha256", "turn", ["text"])
    counts = [parts[k].agg(F.count("*").alias(k)) for k in ("identities", "versions", "observations")]
    return counts[0].join(counts[1]).join(counts[2])


# Joins and sets


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join_exists(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return semantic.index_changes(urgent, table(spark, d, "customer"), ["c_custkey"])[0].select("c_custkey", "c_name")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer")
def exists_flag(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("u")).distinct()
    return table(spark, d, "customer").join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("u", F.lit(False)).alias("urgent"))


@query("SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_order, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def correlated_latest_value(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"), F.count("*").alias("n"))
    return table(spark, d, "customer").join(last, "c_custkey", "left").select("c_custkey", "last_order", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"))


@query("SELECT 'nation' AS source, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region")
def union_all_tagged(spark, d):
    nation = table(spark, d, "nation").select(F.lit("nation").alias("source"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return nation.unionByName(table(spark, d, "region").select(F.lit("region").alias("source"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


@query("SELECT n_nationkey AS nationkey, 'customers_only' AS side FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT n_nationkey, 'both' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def key_set_diff(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")), table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey"))
    return a.subtract(b).withColumn("side", F.lit("customers_only")).unionByName(a.intersect(b).withColumn("side", F.lit("both")))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_with_total(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")
    return search.page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 25, 50)


# Graphs


def _tree(spark, d):
    rows = table(spark, d, "conversations").withColumn("parent", F.when(F.col("turn") > 0, F.expr("(turn - 1) div 2")))
    return rows, rows.groupBy("conv_id").agg(F.max("turn").alias("tip"))


_WALK = "WITH RECURSIVE t AS (SELECT conv_id, turn, role, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent FROM conversations)"


@query(_WALK + ", w(conv_id, turn, depth) AS (SELECT conv_id, turn, CAST(0 AS BIGINT) FROM t WHERE parent IS NULL UNION ALL SELECT t.conv_id, t.turn, w.depth + 1 FROM t JOIN w ON t.conv_id = w.conv_id AND t.parent = w.turn) SELECT conv_id, turn, depth FROM w")
def reachability(spark, d):
    return graph.reachable(_tree(spark, d)[0], group="conv_id", node="turn", parent="parent")


@query(_WALK + ", tip AS (SELECT conv_id, max(turn) AS turn FROM t GROUP BY 1), w(conv_id, turn, parent, up) AS (SELECT t.conv_id, t.turn, t.parent, 0 FROM t JOIN tip ON t.conv_id = tip.conv_id AND t.turn = tip.turn UNION ALL SELECT t.conv_id, t.turn, t.parent, w.up + 1 FROM t JOIN w ON t.conv_id = w.conv_id AND t.turn = w.parent) SELECT conv_id, turn, CAST(max(up) OVER (PARTITION BY conv_id) - up AS BIGINT) AS depth FROM w")
def branch_walk(spark, d):
    nodes, tips = _tree(spark, d)
    return graph.current_branches(nodes, tips, group="conv_id", node="turn", parent="parent", tip="tip")


_ACTIONS = {"view": "restored", "click": "quoted", "signup": "outdated", "error": "corrected", "purchase": "excluded"}
_ACTION_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ACTIONS.items()) + " END"
_AGENT = _WALK + f""", tip AS (SELECT conv_id, max(turn) AS turn FROM t GROUP BY 1),
w(conv_id, turn, parent) AS (SELECT t.conv_id, t.turn, t.parent FROM t JOIN tip ON t.conv_id = tip.conv_id AND t.turn = tip.turn UNION ALL SELECT t.conv_id, t.turn, t.parent FROM t JOIN w ON t.conv_id = w.conv_id AND t.turn = w.parent),
said AS (SELECT user_id || '-' || (event_id % 8) AS id, event_id, {_ACTION_SQL} AS action, strftime(ts, '%Y-%m-%d') AS since FROM events),
fb AS (SELECT id, arg_max(action, event_id) AS action, arg_max(since, event_id) AS since FROM said GROUP BY id),
m AS (SELECT c.conv_id, c.conv_id || '-' || c.turn AS id, c.role, 'conversation ' || c.conv_id AS title, CAST(100 * c.conv_id + c.turn AS DOUBLE) AS made, c.text FROM conversations c JOIN w ON c.conv_id = w.conv_id AND c.turn = w.turn WHERE c.role IN ('user', 'assistant')),
hit AS (SELECT m.*, fb.action, fb.since FROM m LEFT JOIN fb ON fb.id = m.id AND fb.action <> 'restored' WHERE (contains(lower(text), 'tion') OR contains(lower(title), 'tion')) AND coalesce(fb.action, '') <> 'excluded'),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY contains(lower(text), 'tion') DESC, role = 'user' DESC, made DESC, id) <= 2 ORDER BY made DESC, id LIMIT 20),
n AS (SELECT *, row_number() OVER (ORDER BY made DESC, id) AS rank, position('tion' IN lower(text)) - 1 AS found FROM best),
fold(rank, left_, begin, part) AS (SELECT CAST(0 AS BIGINT), 6000, 0, '' UNION ALL
  SELECT n.rank, left_ - length(substring(n.text, greatest(0, found - least(1400, left_) // 4) + 1, least(1400, left_))), greatest(0, found - least(1400, left_) // 4), substring(n.text, greatest(0, found - least(1400, left_) // 4) + 1, least(1400, left_)) FROM fold JOIN n ON n.rank = fold.rank + 1 WHERE left_ > 0)
SELECT CAST(n.rank AS INTEGER) AS rank, n.id AS message_id, n.role, CAST(f.begin AS INTEGER) AS text_offset, f.part AS text, length(n.text) AS text_length, f.begin > 0 OR length(n.text) > length(f.part) + f.begin AS truncated,
  CASE WHEN action = 'quoted' THEN 'quoted_material' WHEN action IN ('outdated', 'corrected') THEN action WHEN role = 'assistant' THEN 'assistant_response' ELSE 'user_message' END AS evidence_status,
  CASE WHEN action = 'quoted' THEN '{recall.LABELS['quoted_material']}' WHEN role = 'assistant' THEN '{recall.LABELS['assistant_response']}' ELSE '{recall.LABELS['user_message']}' END || title AS citation_label,
  CASE WHEN action = 'outdated' THEN 'outdated' WHEN since > '2024-01-15' THEN 'future' WHEN since IS NOT NULL THEN 'within_user_stated_period' ELSE 'historical_unverified' END AS temporal_status
FROM n JOIN fold f ON f.rank = n.rank"""


@query(_AGENT)
def agent_search(spark, d):
    nodes, tips = _tree(spark, d)
    key = lambda turn: F.concat_ws("-", "conv_id", turn).alias("message_id")
    branch = graph.current_branches(nodes, tips, group="conv_id", node="turn", parent="parent", tip="tip").select("conv_id", key("turn"))
    rows = table(spark, d, "conversations").select("conv_id", key("turn"), "role", "text", F.concat(F.lit("conversation "), "conv_id").alias("title"), (F.col("conv_id") * 100 + F.col("turn")).cast("double").alias("create_time"))
    action = F.create_map(*[F.lit(x) for pair in _ACTIONS.items() for x in pair])[F.col("event_type")]
    log = table(spark, d, "events").select(F.concat_ws("-", "user_id", F.col("event_id") % 8).alias("message_id"), F.col("event_id").alias("entry"), action.alias("action"), F.date_format("ts", "yyyy-MM-dd").alias("valid_from"), F.lit(None).cast("string").alias("valid_until"))
    found = recall.agent_search(rows, branch, log, "Tion", as_of="2024-01-15", thread="conv_id", role="all", per_thread=2, limit=20)
    return found.select("rank", "message_id", "role", "text_offset", "text", "text_length", "truncated", "evidence_status", "citation_label", "temporal_status")


@query(f"""
WITH said AS (SELECT user_id || '-' || (event_id % 8) AS id, arg_max({_ACTION_SQL}, event_id) AS action FROM events GROUP BY 1),
w AS (SELECT conv_id || '-' || turn AS id, 100 * conv_id + turn AS made, string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ') AS w FROM conversations WHERE role = 'user'),
s AS (SELECT id, made, 'I prefer ' || w[1] || '.' AS statement FROM w WHERE len(w) > 1 UNION ALL SELECT id, made, 'I plan to ' || w[2] || '!' FROM w WHERE len(w) > 1),
k AS (SELECT s.*, action, CASE WHEN statement LIKE 'I prefer%' THEN 'preference' ELSE 'plan' END AS kind FROM s LEFT JOIN said ON said.id = s.id AND action <> 'restored' WHERE coalesce(action, '') NOT IN ('excluded', 'quoted', 'corrected') AND length(statement) BETWEEN 6 AND 300),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, statement ORDER BY made DESC, id) AS n, count(*) OVER (PARTITION BY kind, statement) AS all_ FROM k)
SELECT kind, statement, max(all_) AS n_sources, string_agg(id || coalesce(':' || action, ''), ',' ORDER BY n) FILTER (n <= 3) AS sources, CAST(max(made) AS DOUBLE) AS newest FROM r GROUP BY kind, statement""")
def observed_profile(spark, d):
    w = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " ")
    rows = table(spark, d, "conversations").where("role = 'user'").withColumn("w", w).where(F.size("w") > 1)
    spoken = F.concat(F.lit("I prefer "), F.col("w")[0], F.lit(". I plan to "), F.col("w")[1], F.lit("!"))
    rows = rows.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), spoken.alias("text"), (F.col("conv_id") * 100 + F.col("turn")).alias("create_time"))
    action = F.create_map(*[F.lit(x) for pair in _ACTIONS.items() for x in pair])[F.col("event_type")]
    log = table(spark, d, "events").select(F.concat_ws("-", "user_id", F.col("event_id") % 8).alias("message_id"), F.col("event_id").alias("entry"), action.alias("action"))
    listed = F.array_join(F.transform("sources", lambda x: F.concat(x["message"], F.coalesce(F.concat(F.lit(":"), x["action"]), F.lit("")))), ",")
    return memory.observed_profile(rows, log).select("kind", "statement", "n_sources", listed.alias("sources"), "newest")


@query(_WALK + " SELECT conv_id, count(*) AS branch_points, CAST(sum(n - 1) AS BIGINT) AS alternatives FROM (SELECT conv_id, parent, count(*) AS n FROM t WHERE parent IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def branch_points(spark, d):
    return graph.branch_points(_tree(spark, d)[0], group="conv_id", parent="parent")


@query("SELECT role, CAST(sum(n - 1) AS BIGINT) AS repeats FROM (SELECT conv_id, (turn - 1) // 3 AS parent, role, count(*) AS n FROM conversations WHERE turn > 0 AND role IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1")
def sibling_repeats(spark, d):
    rows = table(spark, d, "conversations").withColumn("parent", F.when(F.col("turn") > 0, F.expr("(turn - 1) div 3")))
    return graph.sibling_repeats(rows, group="conv_id", parent="parent", role="role")


# Integrity


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def fk_violations(spark, d):
    return validation.foreign_key_violations(table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal >= 0"), ["o_custkey"], ["c_custkey"]).select("o_orderkey", "o_custkey")


@query("""
WITH decl AS (SELECT o_orderkey AS k, CAST(o_orderkey % 7 AS BIGINT) AS declared FROM orders), act AS (SELECT l_orderkey AS k, count(*) AS found FROM lineitem GROUP BY 1)
SELECT k, coalesce(declared, 0) AS declared, coalesce(found, 0) AS found FROM decl FULL JOIN act USING (k) WHERE coalesce(declared, 0) <> coalesce(found, 0)""")
def count_closure(spark, d):
    declared = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7).alias("declared"))
    return validation.count_closure(declared, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k", "declared")


@query("SELECT 'props' AS \"column\", n FROM (SELECT count(*) FILTER (props IS NOT NULL AND NOT json_valid(props)) AS n FROM events) WHERE n > 0 UNION ALL SELECT 'event_type', n FROM (SELECT count(*) FILTER (event_type IS NOT NULL AND NOT json_valid(event_type)) AS n FROM events) WHERE n > 0")
def json_validity(spark, d):
    return validation.invalid_json(table(spark, d, "events"), ["props", "event_type"])


@query("WITH h AS (SELECT event_type, sha256(concat(length(CAST(event_id AS VARCHAR)), 'v', event_id, '|', length(CAST(user_id AS VARCHAR)), 'v', user_id)) AS h FROM events), r AS (SELECT event_type, substring(h, 1, 3) AS r, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1, 2) SELECT event_type, sha256(string_agg(h, '' ORDER BY r)) AS digest FROM r GROUP BY 1")
def state_digest(spark, d):
    return snapshots.state_digest(table(spark, d, "events"), ["event_id", "user_id"], "event_type")


# Memory

_STATEMENTS = (
    ("m1", "user", "I prefer short answers with examples."),
    ("m2", "user", "I  prefer short\tanswers with examples."),
    ("m3", "assistant", "I prefer long answers."),
    ("m4", "user", "My name is Robin and I live near the sea."),
    ("m5", "user", "I plan to learn the cello next year."),
    ("m6", "user", "Never call me before nine, I like to sleep."),
    ("m7", "user", "I am"),
    ("m8", "user", "The weather was fine yesterday."),
)
_VALUES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _STATEMENTS)


def _ascii_rules() -> str:
    return " ".join(f"WHEN regexp_matches(s, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, p in memory.RULES)


#: All turns of conversations, and the statements above, as phrases that the rules know are rare in the tables.
_TURNS = f"m(id, role, text) AS (SELECT conv_id || '-' || turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {_VALUES}))"


def _turns(spark, d):
    rows = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", "text")
    return rows.unionByName(spark.createDataFrame(list(_STATEMENTS), "id string, role string, text string"))


@query(f"""
WITH {_TURNS}, s AS (SELECT id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM m WHERE role = 'user'),
k AS (SELECT id, text, s, CASE {_ascii_rules()} END AS kind FROM s WHERE length(s) >= 8)
SELECT 'memc_' || substring(sha256(concat(id, chr(0), sha256(text), chr(0), kind)), 1, 32) AS candidate_id, id, kind, s AS statement FROM k WHERE kind IS NOT NULL""")
def candidate_scan(spark, d):
    return memory.scan_candidates(_turns(spark, d), message="id", text_col="text", role_col="role")


@query()
def related_candidates(spark, d):
    found = memory.scan_candidates(_turns(spark, d), message="id", text_col="text", role_col="role")
    return memory.related(found, found)


_EXPLICIT = f"""
WITH {_TURNS}, n AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM m WHERE role = 'user'),
p AS (SELECT id, unnest(regexp_extract_all(line, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+$')) AS x FROM n),
s AS (SELECT id, trim(x, ' ' || chr(9)) AS statement FROM p),
e AS (SELECT id, statement, CASE {_ascii_rules().replace('(s,', '(statement,')} END AS kind FROM s WHERE length(statement) BETWEEN 6 AND 300 AND NOT regexp_matches(statement, '[?？]') AND regexp_matches(statement, '(?i)^(我|本人|I\\s)'))"""


@query(_EXPLICIT + " SELECT id, kind, statement FROM e WHERE kind IS NOT NULL")
def explicit_statements(spark, d):
    return memory.explicit_statements(_turns(spark, d).where("role = 'user'")).select("id", "kind", "statement")


def _groups(spark, d):
    return memory.consolidate(memory.explicit_statements(_turns(spark, d).where("role = 'user'")), kind="kind", text_col="statement", source="id")


@query(_EXPLICIT + r", g AS (SELECT *, lower(trim(regexp_replace(statement, '\s+', ' ', 'g'))) AS norm FROM e WHERE kind IS NOT NULL) SELECT kind, norm, min_by(statement, id) AS statement, count(*) AS n_sources, array_to_string(list_sort(list(id))[1:3], ',') AS sources FROM g GROUP BY kind, norm".replace(r"\\s", r"\s"))
def consolidated_statements(spark, d):
    return _groups(spark, d).select("kind", "norm", "statement", "n_sources", F.array_join("sources", ",").alias("sources"))


@query()
def greedy_budget(spark, d):
    kept = memory.greedy_budget(_groups(spark, d).select("kind", "statement"), "statement", budget_chars=90)
    return spark.createDataFrame([(r["kind"], r["statement"]) for r in kept], "kind string, statement string")


@query("SELECT event_id, sha256('{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS raw_sha256 FROM events")
def canonical_hash(spark, d):
    return table(spark, d, "events").select("event_id", canonical.canonical_hash(F.col("props")).alias("raw_sha256"))


@query("SELECT CASE WHEN url LIKE '%.html' OR url LIKE '%.htm' THEN 'html' ELSE 'other' END AS media_class, count(*) AS n FROM pages GROUP BY 1")
def media_classes(spark, d):
    return table(spark, d, "pages").groupBy(text.media_class(F.col("url")).alias("media_class")).agg(F.count("*").alias("n"))


@query(f"""
WITH m AS (SELECT *, conv_id || '-' || lpad(CAST(turn AS VARCHAR), 6, '0') AS message FROM conversations WHERE role IN ('user', 'assistant') AND contains(lower(text), '{PHRASE}')),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn DESC, message) AS k FROM m)
SELECT message, role, turn FROM r WHERE k <= 2 ORDER BY turn DESC, message LIMIT 20""")
def keyword_hits(spark, d):
    rows = table(spark, d, "conversations").withColumn("message", F.concat_ws("-", "conv_id", F.lpad(F.col("turn").cast("string"), 6, "0")))
    return recall.keyword_hits(rows, PHRASE, thread="conv_id", message="message", text_col="text", role_col="role", time_col="turn", role="all", per_thread=2, limit=20).select("message", "role", "turn")


@query("SELECT conv_id, min(turn) AS create_time, max(turn) AS update_time, count(*) AS messages, coalesce(max_by(text, turn) FILTER (length(trim(text)) > 0), '') AS preview FROM conversations GROUP BY conv_id HAVING bool_or(contains(lower(text), 'in'))")
def group_threads(spark, d):
    return search.group_threads(table(spark, d, "conversations"), "IN", thread="conv_id", time_col="turn")


@query("SELECT strftime(ts, '%Y-%m-%d') AS snapshot, count(*) AS n_events, count(*) FILTER (event_type = 'click') AS n_clicks, count(*) FILTER (event_type = 'none') AS n_none FROM events GROUP BY 1")
def snapshot_list(spark, d):
    rows = table(spark, d, "events").withColumn("snapshot", F.date_format("ts", "yyyy-MM-dd"))
    counted = {"n_events": rows, "n_clicks": rows.where("event_type = 'click'"), "n_none": rows.where("event_type = 'none'")}
    return snapshots.snapshot_list(rows.select("snapshot").distinct(), counted, order="snapshot")


@query("""
WITH e AS (SELECT *, strftime(ts, '%Y-%m') AS snapshot FROM events)
SELECT snapshot, 'diagnostics' AS area, CASE WHEN value < 20 THEN 'error' ELSE 'warning' END AS key, count(*) AS n, 0 AS size_bytes FROM e GROUP BY ALL
UNION ALL SELECT snapshot, 'source_absences', event_type, count(*), 0 FROM e GROUP BY ALL
UNION ALL SELECT snapshot, 'coverage', event_type || '/' || CASE WHEN user_id % 2 = 0 THEN 'parsed' ELSE 'kept' END, count(*), CAST(sum(event_id) AS BIGINT) FROM e GROUP BY ALL""")
def snapshot_quality(spark, d):
    rows = table(spark, d, "events").withColumn("snapshot", F.date_format("ts", "yyyy-MM"))
    faults = rows.select("snapshot", F.when(F.col("value") < 20, "error").otherwise("warning").alias("severity"))
    files = rows.select("snapshot", F.col("event_type").alias("media_class"), F.when(F.col("user_id") % 2 == 0, "parsed").otherwise("kept").alias("handling_status"), F.col("event_id").alias("size_bytes"))
    return snapshots.snapshot_quality(faults, rows.select("snapshot", F.col("event_type").alias("entity_kind")), files)


@query("SELECT conv_id, turn, text || chr(10) || role || chr(10) || chr(10) || text AS text FROM conversations")
def message_texts(spark, d):
    quoted = lambda c: F.substring(F.to_json(F.struct(c.alias("x"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    parts = F.concat(F.lit("["), quoted(F.col("role")), F.lit(',7,"",{"text":'), quoted(F.col("text")), F.lit('},{"text":1}]'))
    raw = F.concat(F.lit('{"content":{"text":'), quoted(F.col("text")), F.lit(',"parts":'), parts, F.lit("}}"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.message_text(raw).alias("text"))


_BARE = "nullif(regexp_extract(rtrim(regexp_replace(rtrim(regexp_replace(url, '[#?].*$', ''), '/'), '^.*?://', ''), '/'), '([^/]*)$', 1), '')"


@query(f"SELECT page_id, {_BARE} AS plain, {_BARE} AS decorated FROM pages")
def asset_references(spark, d):
    rows = table(spark, d, "pages")
    return rows.select("page_id", text.normal_asset_reference(F.col("url")).alias("plain"), text.normal_asset_reference(F.concat(F.lit(" "), "url", F.lit("/?q=1#x "))).alias("decorated"))


@query("SELECT page_id, 'http://127.0.0.1:8767/?source=' || replace(replace(url, ':', '%3A'), '/', '%2F') AS link FROM pages WHERE regexp_full_match(url, '[A-Za-z0-9:/._-]+')")
def source_links(spark, d):
    rows = table(spark, d, "pages").where(F.rlike("url", F.lit("^[A-Za-z0-9:/._-]+$")))
    return rows.select("page_id", recall.source_link(F.col("url")).alias("link"))


@query("SELECT CASE lower(regexp_extract(url, '\\.([^./]+)$', 1)) WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'json' THEN 'application/json' WHEN 'pdf' THEN 'application/pdf' END AS mime, count(*) AS n FROM pages GROUP BY 1")
def mime_types(spark, d):
    return table(spark, d, "pages").groupBy(text.mime_type(F.col("url")).alias("mime")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'conversation' WHEN 1 THEN 'library_file' WHEN 2 THEN 'provider_json:page.' || page_id ELSE 'conversation' END AS kind FROM pages")
def record_kinds(spark, d):
    names = F.array(F.lit("a/conversations-001.json"), F.lit("library_files.json"), F.concat(F.lit("b/page."), "page_id", F.lit(".json")), F.lit("conversations.json"))
    return table(spark, d, "pages").select("page_id", text.record_kind(F.get(names, (F.col("page_id") % 4).cast("int"))).alias("kind"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 0 ELSE turn + 1 END AS n FROM conversations")
def json_lengths(spark, d):
    value = F.when(F.col("turn") % 3 == 0, F.lit('{"a": [1]}')).otherwise(F.concat(F.lit("["), F.expr("repeat('0,', cast(turn AS int))"), F.lit("0]")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.array_length(value).alias("n"))


@query(f"""
WITH {_DAYS}, planted AS (SELECT u.user_id, s.snapshot, p.snapshot AS prior FROM (SELECT DISTINCT user_id FROM obs WHERE user_id % 10 = 0) u, snap s, snap p WHERE abs(date_diff('day', p.snapshot, s.snapshot)) <= 1)
SELECT strftime(snapshot, '%Y-%m-%d') AS snapshot, strftime(prior, '%Y-%m-%d') AS prior_snapshot, user_id, fault FROM (
  SELECT p.*, CASE WHEN p.prior >= p.snapshot THEN 'not_earlier' WHEN t.user_id IS NULL THEN 'not_seen' WHEN h.user_id IS NOT NULL THEN 'still_there' END AS fault
  FROM planted p LEFT JOIN obs t ON t.snapshot = p.prior AND t.user_id = p.user_id LEFT JOIN obs h ON h.snapshot = p.snapshot AND h.user_id = p.user_id) WHERE fault IS NOT NULL""")
def absence_violations(spark, d):
    seen, captures = _days(spark, d)
    before = captures.select(F.col("snapshot").alias("prior_snapshot"))
    near = captures.join(before, F.abs(F.date_diff("snapshot", "prior_snapshot")) <= 1).select("snapshot", "prior_snapshot")
    absences = near.join(seen.where("user_id % 10 = 0").select("user_id").distinct())
    return validation.absence_violations(absences, seen, captures, identity="user_id")


@query("SELECT event_id, repeat('0', 64) AS stored, sha256('{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS found FROM events WHERE event_id % 97 = 0")
def payload_faults(spark, d):
    rows = table(spark, d, "events").withColumn("sha", F.when(F.col("event_id") % 97 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2(F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit("}")), 256)))
    return validation.payload_faults(rows, key="event_id", payload="props", stored="sha")


@query("SELECT conv_id || '-' || turn AS id, CASE turn % 5 WHEN 0 THEN 'missing' ELSE 'differs' END AS fault FROM conversations WHERE turn % 5 < 2 AND text <> '' UNION ALL SELECT 'x-' || conv_id, 'orphan' FROM conversations WHERE turn = 0")
def search_faults(spark, d):
    rows = table(spark, d, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    messages = rows.select("id", F.to_json(F.struct(F.struct("text").alias("content"))).alias("raw"))
    index = rows.where("turn % 5 <> 0").select("id", F.when(F.col("turn") % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return validation.search_faults(messages, index.unionByName(rows.where("turn = 0").select(F.concat(F.lit("x-"), "conv_id").alias("id"), "text")), key="id", raw="raw")


@query("SELECT user_id, event_id, event_type AS topic FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type = 'click' AND event_id % 7 <> 0")
def bookmarks(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("topic"), (F.col("event_id") % 7 == 0).alias("removed"))
    return annotations.bookmarks(log, key="user_id", entry="event_id", topic="click").select("user_id", "event_id", "topic")


@query(_WALK + """, kept AS (SELECT * FROM t WHERE NOT (conv_id % 3 = 0 AND turn = 1)), tip AS (SELECT conv_id, max(turn) AS turn FROM t GROUP BY 1),
w(conv_id, turn, parent) AS (SELECT kept.conv_id, kept.turn, kept.parent FROM kept JOIN tip USING (conv_id, turn) UNION ALL SELECT kept.conv_id, kept.turn, kept.parent FROM kept JOIN w ON kept.conv_id = w.conv_id AND kept.turn = w.parent),
n AS (SELECT conv_id, count(*) AS n, bool_or(parent IS NULL) AS ok FROM w GROUP BY 1)
SELECT conv_id, CASE WHEN ok THEN 'complete' ELSE 'broken' END AS state, CASE WHEN ok THEN n ELSE 0 END AS length FROM tip LEFT JOIN n USING (conv_id)""")
def session_branches(spark, d):
    nodes, tips = _tree(spark, d)
    return graph.session_branches(nodes.where("NOT (conv_id % 3 = 0 AND turn = 1)"), tips, group="conv_id", node="turn", parent="parent", leaf="tip")


@query(f"""
WITH s AS (SELECT a.vec_id, a.label, {_COSINE} AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE a.vec_id % 9 <> 4 ORDER BY similarity DESC, a.vec_id LIMIT 40),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS k FROM s)
SELECT vec_id, label, round(similarity, 6) AS similarity FROM r WHERE k = 1 ORDER BY similarity DESC, vec_id LIMIT 8""")
def semantic_search(spark, d):
    rows = table(spark, d, "embeddings")
    found = semantic.search(rows, rows.where("vec_id = 0"), thread="label", id_col="vec_id", vector_col="embedding", excluded=rows.where("vec_id % 9 = 4"))
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("SELECT conv_id || '' AS snapshot_key, conv_id AS conversation_id, turn AS message_id FROM conversations WHERE conv_id || '-' || turn IN ('1-0', '1-1')")
def citation(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("snapshot_key"), F.col("conv_id").alias("conversation_id"), F.col("turn").alias("message_id"), F.concat_ws("-", "conv_id", "turn").alias("source_id"))
    return snapshots.citation(rows, "1-0").unionByName(snapshots.citation(rows, "1-1"))


@query("SELECT event_type, 'changed' AS state FROM events GROUP BY 1 HAVING bool_or(event_id % 101 = 0) AND bool_or(event_id % 101 <> 0) UNION ALL SELECT event_type, 'removed' FROM events GROUP BY 1 HAVING bool_and(event_id % 101 = 0)")
def digest_changes(spark, d):
    rows = table(spark, d, "events")
    digest = lambda x: snapshots.state_digest(x, ["event_id", "user_id"], "event_type")
    return snapshots.digest_changes(digest(rows), digest(rows.where("event_id % 101 <> 0")), "event_type")


@query(_WALK + ", c AS (SELECT conv_id % 5 AS snapshot, conv_id, parent, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT snapshot, CAST(sum(n) AS BIGINT) AS nodes, CAST(coalesce(sum(n) FILTER (parent IS NULL), 0) AS BIGINT) AS roots, count(*) FILTER (parent IS NOT NULL AND n > 1) AS branch_points, CAST(coalesce(sum(n - 1) FILTER (parent IS NOT NULL), 0) AS BIGINT) AS alternatives FROM c GROUP BY 1) UNPIVOT m ON nodes, roots, branch_points, alternatives INTO NAME metric VALUE value")
def graph_metrics(spark, d):
    nodes = _tree(spark, d)[0].select((F.col("conv_id") % 5).alias("snapshot"), F.when(F.col("parent").isNotNull(), F.struct("conv_id", "parent")).alias("parent"))
    return validation.graph_metrics(nodes, snapshot="snapshot", parent="parent")


@query("""
WITH a AS (SELECT sha256(url) AS sha256, page_id FROM pages WHERE page_id % 10 <> 3)
SELECT sha256, 'assets/sha256/' || substring(sha256, 1, 2) || '/' || sha256 AS path, 'missing' AS fault FROM a GROUP BY sha256 HAVING bool_and(page_id % 10 = 0)
UNION ALL SELECT sha256, 'assets/sha256/' || substring(sha256, 1, 2) || '/' || sha256, 'size' FROM a GROUP BY sha256 HAVING min(page_id) % 10 = 5
UNION ALL SELECT sha256(url), 'assets/sha256/' || substring(sha256(url), 1, 2) || '/' || sha256(url), 'orphan' FROM pages WHERE page_id % 10 = 3""")
def store_faults(spark, d):
    rows = table(spark, d, "pages").withColumn("sha256", F.sha2("url", 256)).withColumn("size", F.length("html").cast("long"))
    place = F.concat_ws("/", F.lit("assets/sha256"), F.substring("sha256", 1, 2), F.col("sha256"))
    files = rows.where("page_id % 10 <> 0").select(place.alias("path"), (F.col("size") + F.when(F.col("page_id") % 10 == 5, 1).otherwise(0)).alias("size"), "sha256")
    return validation.store_faults(rows.where("page_id % 10 <> 3").select("sha256", "size"), files)


@query("""
WITH l AS (SELECT event_type AS file, CASE WHEN event_id % 50 = 0 THEN 'x' ELSE props END AS value FROM events WHERE event_type <> 'view'),
f AS (SELECT file, count(*) AS n, count(*) FILTER (value = 'x') AS bad FROM l GROUP BY 1)
SELECT file, 'invalid' AS fault, bad AS n FROM f WHERE bad > 0 UNION ALL SELECT file, 'records', n FROM f WHERE file <> 'click' UNION ALL SELECT 'click', 'undeclared', n FROM f WHERE file = 'click'
UNION ALL SELECT 'view', 'missing', (SELECT count(*) + 1 FROM events WHERE event_type = 'view')""")
def ndjson_closure(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("file"), F.when(F.col("event_id") % 50 == 0, "x").otherwise(F.col("props")).alias("value"))
    declared = rows.where("file <> 'click'").groupBy("file").agg((F.count("*") + 1).alias("records"))
    return validation.ndjson_closure(declared, rows.where("file <> 'view'"))


@query("SELECT c.conv_id || '-' || c.turn AS candidate_id, b.conv_id, b.turn, b.turn - c.turn AS distance FROM conversations c JOIN conversations b ON b.conv_id = c.conv_id AND abs(b.turn - c.turn) <= 2 WHERE c.turn % 7 = 3")
def source_context(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("depth"))
    candidates = rows.where("turn % 7 = 3").select(F.concat_ws("-", "conv_id", "turn").alias("candidate_id"), "conv_id", "turn")
    return memory.source_context(candidates, rows, thread="conv_id", message="turn").select("candidate_id", "conv_id", "turn", "distance")
