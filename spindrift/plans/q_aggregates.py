"""Queries over aggregates and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as G
from . import views as V
from .registry import query

P, A, KB = V.PREDICTIONS.sql, V.ANNOTATIONS.sql, V.KB.sql


def predictions(s, d):
    p = V.PREDICTIONS(s, d)
    return p.withColumn("prediction", G.lifted(F.array("p1", "p2", "p3", "p4", "p5")))


RANKS = f"""r AS (SELECT *, CASE WHEN p1 = truth THEN 1 WHEN p2 = truth THEN 2 WHEN replace(p3, 'pkg.', '') = truth THEN 3 WHEN p4 = truth THEN 4 WHEN p5 = truth THEN 5 END AS r,
 CASE scope WHEN 'local' THEN 'var' WHEN 'arg' THEN 'arg' ELSE 'ret' END AS g1, CASE WHEN generic THEN 'gen' WHEN cat = 'user-defined' THEN 'usr' ELSE 'ele' END AS g2 FROM {P})"""
RATES = "count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5, round(avg(CASE WHEN r <= 5 THEN 1.0 / r ELSE 0.0 END), 6) AS mrr"


def rounded(df):
    return df.select("cat", "n", *[F.round(c, 6).alias(c) for c in ("top1", "top3", "top5", "mrr")])


@query("A01_split_counters", "SELECT lang, count(*) AS records, count(*) FILTER (WHERE n_chars > 1000) AS long, count(*) FILTER (WHERE contains(text, 'the')) AS tagged FROM documents GROUP BY 1")
def _(s, d):
    t = V.table(s, d, "documents")
    return t.groupBy("lang").agg(F.count("*").alias("records"), F.count_if(F.col("n_chars") > 1000).alias("long"), F.count_if(F.col("text").contains("the")).alias("tagged"))


@query("A02_gold_coverage", "SELECT d.lang, count(*) AS total, count(l.doc_id) AS found, count(*) - count(l.doc_id) AS missing, round(100.0::DOUBLE * count(l.doc_id) / count(*), 2) AS percentage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def _(s, d):
    t = V.table(s, d, "documents").join(V.table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return G.coverage(t, "lang", F.col("quality").isNotNull())


@query("A03_top_k_accuracy", f"WITH {RANKS} SELECT 'all' AS cat, {RATES} FROM r")
def _(s, d):
    p = predictions(s, d).withColumn("r", G.hit_rank(F.col("prediction"), F.col("truth")))
    return rounded(G.metrics(p, "r", F.array(F.lit("all"))))


@query("A03_base_accuracy", f"WITH x AS (SELECT prio AS cat, CASE WHEN p1 = truth THEN 1 WHEN p2 = truth THEN 2 WHEN replace(p3, 'pkg.', '') = truth THEN 3 WHEN p4 = truth THEN 4 WHEN p5 = truth THEN 5 END AS r FROM {P}) SELECT cat, {RATES} FROM x GROUP BY 1")
def _(s, d):
    p = predictions(s, d).withColumn("truth", F.concat("truth", F.lit("[int]"))).withColumn("r", G.hit_rank(F.col("prediction"), F.col("truth"), base=True))
    return rounded(G.metrics(p, "r", F.array("prio")))


@query("A04_mrr", f"WITH {RANKS} SELECT scope, round(sum(CASE WHEN r <= 5 THEN 1.0 / r ELSE 0 END) / count(*), 6) AS mrr FROM r GROUP BY 1")
def _(s, d):
    p = predictions(s, d).withColumn("r", G.hit_rank(F.col("prediction"), F.col("truth")))
    return p.groupBy("scope").agg(F.round(F.sum(F.when(F.col("r") <= 5, 1.0 / F.col("r")).otherwise(0.0)) / F.count("*"), 6).alias("mrr"))


@query("A05_overlapping_groups", f"WITH {RANKS}, g AS (SELECT g1 AS cat, r FROM r UNION ALL SELECT g2, r FROM r UNION ALL SELECT 'all', r FROM r) SELECT cat, {RATES} FROM g GROUP BY 1")
def _(s, d):
    p = predictions(s, d).withColumn("r", G.hit_rank(F.col("prediction"), F.col("truth")))
    return rounded(G.metrics(p, "r", G.metric_groups(F.col("scope"), F.col("cat"), F.col("generic"))))


@query("A06_ranking_summary", f"WITH {RANKS} SELECT count(*) AS rows, count(r) AS recalled, round(count(r)::DOUBLE / count(*), 6) AS recall, round(count(*) FILTER (WHERE r = 1)::DOUBLE / count(*), 6) AS top1, round(count(*) FILTER (WHERE r = 1)::DOUBLE / count(r), 6) AS top1_if_recalled, round(avg(1.0::DOUBLE / r), 6) AS mrr FROM r")
def _(s, d):
    r = predictions(s, d).withColumn("r", G.hit_rank(F.col("prediction"), F.col("truth")))
    n, k, one = F.count("*"), F.count("r"), F.count_if(F.col("r") == 1)
    return r.agg(n.alias("rows"), k.alias("recalled"), F.round(F.try_divide(k, n), 6).alias("recall"), F.round(F.try_divide(one, n), 6).alias("top1"), F.round(F.try_divide(one, k), 6).alias("top1_if_recalled"), F.round(F.avg(1.0 / F.col("r")), 6).alias("mrr"))


@query("A07_weighted_loss", "SELECT o_orderpriority AS part, round(sum(l * n) / sum(n), 4) AS loss FROM (SELECT o_orderpriority, o_custkey, avg(o_totalprice) AS l, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    batches = V.table(s, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.avg("o_totalprice").alias("l"), F.count("*").alias("n"))
    return batches.groupBy(F.col("o_orderpriority").alias("part")).agg(F.round(F.sum(F.col("l") * F.col("n")) / F.sum("n"), 4).alias("loss"))


@query("A08_exact_match", f"SELECT scope, round(avg(CASE WHEN p1 = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {P} GROUP BY 1")
def _(s, d):
    return V.PREDICTIONS(s, d).groupBy("scope").agg(F.round(F.avg((F.col("p1") == F.col("truth")).cast("double")), 6).alias("accuracy"))


@query("A09_token_stats", "SELECT role, count(*) AS samples, round(avg(length(text)), 6) AS avg, min(length(text)) AS min, max(length(text)) AS max, count(*) FILTER (WHERE length(text) > 500) AS over, round(100.0::DOUBLE * count(*) FILTER (WHERE length(text) > 500) / count(*), 2) AS over_pct FROM conversations GROUP BY 1")
def _(s, d):
    return G.token_stats(V.table(s, d, "conversations"), F.length("text"), 500, ["role"]).withColumn("avg", F.round("avg", 6))


@query("A10_percentiles", "SELECT lang, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.9), 4) AS p90, round(quantile_cont(n_chars, 0.95), 4) AS p95, round(quantile_cont(n_chars, 0.99), 4) AS p99 FROM documents GROUP BY ROLLUP (lang)")
def _(s, d):
    p = F.percentile("n_chars", F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    return V.table(s, d, "documents").rollup("lang").agg(p.alias("p")).select("lang", *[F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))])


@query("A11_truncation", "SELECT lang, lim AS \"limit\", count(*) FILTER (WHERE n_chars > lim) AS cut, round(100.0::DOUBLE * count(*) FILTER (WHERE n_chars > lim) / count(*), 2) AS cut_pct, CAST(sum(greatest(0, n_chars - lim)) AS BIGINT) AS removed FROM documents, (VALUES (512), (1024), (4096), (8192)) t(lim) GROUP BY 1, 2")
def _(s, d):
    return G.truncation(V.table(s, d, "documents"), "lang", "n_chars", [512, 1024, 4096, 8192])


@query("A12_rollup", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang)")
def _(s, d):
    return V.table(s, d, "documents").rollup("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("A13_rows_and_projects", f"SELECT scope, count(*) AS rows, count(DISTINCT file) AS projects FROM {A} GROUP BY 1")
def _(s, d):
    return V.ANNOTATIONS(s, d).groupBy("scope").agg(F.count("*").alias("rows"), F.count_distinct("file").alias("projects"))


@query("A14_status_totals", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, round(sum(coalesce(value, 0)), 2) AS total FROM events GROUP BY 1")
def _(s, d):
    return V.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 2).alias("total"))


@query("A15_counts_in_a_row", f"SELECT package, string_agg(kind || '=' || n, ',' ORDER BY kind) AS by_kind FROM (SELECT package, kind, count(*) AS n FROM {KB} GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    c = V.KB(s, d).groupBy("package", "kind").agg(F.count("*").alias("n")).groupBy("package").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("m"))
    return c.select("package", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("by_kind"))


@query("A16_first_wins", f"SELECT package, lower(name) AS canonical, min_by(definition, key) AS definition FROM {KB} GROUP BY 1, 2")
def _(s, d):
    return G.first_wins(V.KB(s, d).withColumn("canonical", F.lower("name")), ["package", "canonical"], "key", ["definition"])


@query("A17_longest_wins", f"SELECT package, name, max_by(key, length(definition) * 10000000 - key) AS key FROM {KB} GROUP BY 1, 2")
def _(s, d):
    return V.KB(s, d).groupBy("package", "name").agg(F.max_by("key", F.struct(F.length("definition"), -F.col("key"))).alias("key"))


@query("A18_votes", "WITH v AS (SELECT l_suppkey AS g, 'T' || (l_partkey % 5) AS answer, l_orderkey * 8 + l_linenumber AS pos FROM lineitem) SELECT g, answer, votes, round(votes / 20.0::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY g ORDER BY votes DESC, f) AS rank FROM (SELECT g, answer, count(*) AS votes, min(pos) AS f FROM v GROUP BY 1, 2)")
def _(s, d):
    v = V.table(s, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.concat(F.lit("T"), F.expr("l_partkey % 5")).alias("answer"), F.expr("l_orderkey * 8 + l_linenumber").alias("pos"))
    return G.votes(v, "g", "answer", "pos").withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("A19_multimap", f"SELECT name, string_agg(key, ',' ORDER BY key) AS keys FROM {KB} GROUP BY 1")
def _(s, d):
    return V.KB(s, d).groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("key")).cast("array<string>"), ",").alias("keys"))


@query("A20_distinct_packages", f"SELECT DISTINCT package FROM {KB}")
def _(s, d):
    return V.KB(s, d).select("package").distinct()


#: Shards that have documents; a part of shard 7 is lost, one of shard 4 is there twice.
@query("A22_residue_coverage", "WITH s AS (SELECT DISTINCT doc_id % 10 AS i FROM documents), c AS (SELECT range AS r, range % 10 AS i FROM range(90)) SELECT r, CASE WHEN i NOT IN (SELECT i FROM s) OR i = 7 AND r % 30 = 7 THEN 0 ELSE 2 END AS n FROM c WHERE i NOT IN (SELECT i FROM s) OR i = 4 OR i = 7 AND r % 30 = 7")
def _(s, d):
    from ..functions.hashing import physical_parts
    from ..operators.checks import residue_faults

    shards = V.table(s, d, "documents").select(F.expr("doc_id % 10").alias("shard")).distinct()
    parts = shards.select("shard", F.explode(physical_parts(F.col("shard"))).alias("p")).select("shard", F.col("p.residue").cast("int").alias("residue"), F.col("p.modulus").cast("int").alias("modulus"))
    seven = shards.where("shard = 7").select("shard", F.explode(F.array(F.lit(17), F.lit(27))).alias("residue"), F.lit(30).alias("modulus"))
    return residue_faults(parts.where("shard <> 7").unionByName(seven).unionByName(parts.where("shard = 4")))


@query("A24_best_restore_source", "SELECT lang, max_by(source, n * 1000000 + c) AS source FROM (SELECT lang, source, count(*) AS n, 1000 - CAST(substr(source, 4) AS INTEGER) AS c FROM documents GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    c = V.table(s, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return c.groupBy("lang").agg(F.max_by("source", F.struct("n", -F.substring("source", 4, 9).cast("int"))).alias("source"))
