"""Queries over windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as X
from ..operators import ranking as R
from ..operators import sets as U
from ..operators import vectors as VEC
from ..operators import verification as VER
from . import views as V
from .q_text import STRICT, sha_int
from .registry import query

A, KB, CALLS = V.ANNOTATIONS.sql, V.KB.sql, V.CALLS.sql
#: Blocks of a hundred vectors: the first is the query, the others its candidates, equal labels are right.
BLOCKS = "(SELECT q.vec_id AS id, c.vec_id AS cand, q.label = c.label AS hit, q.label AS label, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings c ON c.vec_id // 100 = q.vec_id // 100 AND c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)"
#: Each hundredth vector is a query, all that are no queries are its candidates.
EVERY = "(SELECT q.vec_id AS id, c.vec_id AS cand, q.label = c.label AS hit, q.label AS label, c.label AS of, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings c ON c.vec_id % 100 <> 0 WHERE q.vec_id % 100 = 0)"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cand) AS rank FROM {EVERY})"


def blocks(s, d):
    """Each query with the candidates of its block, as in BLOCKS."""
    from ..functions.similarity import cosine

    e = V.table(s, d, "embeddings").withColumn("block", F.expr("vec_id DIV 100"))
    q = e.where("vec_id % 100 = 0").select("block", F.col("vec_id").alias("id"), "label", F.col("embedding").alias("q"))
    c = e.where("vec_id % 100 <> 0").select("block", F.col("vec_id").alias("cand"), F.col("label").alias("c_label"), "embedding")
    return q.join(c, "block").select("id", "cand", (F.col("label") == F.col("c_label")).alias("hit"), "label", F.round(cosine(F.col("q"), F.col("embedding")), 9).alias("score"))


def sides(s, d):
    """Queries and candidates (id, label, vector), as in EVERY."""
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return e.where("id % 100 = 0"), e.where("id % 100 <> 0")


@query("W01_occurrence", f"SELECT pos, row_number() OVER (PARTITION BY file, scope, name ORDER BY pos) - 1 AS occurrence FROM (SELECT DISTINCT ON (pos) * FROM {A} ORDER BY pos, file, scope, name)")
def _(s, d):
    a = V.ANNOTATIONS(s, d).groupBy("pos").agg(F.min(F.struct("file", "scope", "name")).alias("b")).select("pos", "b.*")
    return U.occurrence(a, ["file", "scope", "name"], "pos").select("pos", F.col("occurrence").cast("long").alias("occurrence"))


@query("W02_dedup_first_wins", f"SELECT file || '--' || loc || '--' || name || '--' || scope AS key, min(pos) AS pos FROM {A} GROUP BY 1")
def _(s, d):
    a = V.ANNOTATIONS(s, d).withColumn("key", X.sample_key(*map(F.col, ("file", "loc", "name", "scope"))))
    return a.groupBy("key").agg(F.min("pos").alias("pos"))


@query("W03_gold_rank", f"SELECT id, min(CASE WHEN hit THEN rank END) AS gold_rank FROM {RANKED} GROUP BY 1")
def _(s, d):
    return VEC.first_hits(*sides(s, d)).select("id", "gold_rank")


@query("W04_top_candidates", f"SELECT id, cand, rank FROM {RANKED} WHERE rank <= 10")
def _(s, d):
    return VEC.top(*sides(s, d), 10).select("id", "cand", "rank")


@query("W05_samples_of_split", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def _(s, d):
    return U.first_n(V.table(s, d, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 3)


@query("W06_fallback_negatives", f"WITH h AS (SELECT package, key FROM {KB} WHERE kind = 'class' AND size < 20), n AS (SELECT package, count(*) AS n FROM h GROUP BY 1), p AS (SELECT package, key, row_number() OVER (PARTITION BY package ORDER BY md5('13:' || key), key) AS k FROM {KB} x WHERE kind <> 'function' AND NOT EXISTS (SELECT 1 FROM h WHERE h.package = x.package AND h.key = x.key)) SELECT p.package, key FROM p LEFT JOIN n USING (package) WHERE k <= 40 - coalesce(n, 0)")
def _(s, d):
    kb = V.KB(s, d).select("package", "key", "kind", "size")
    return U.fill_up(kb.where("kind = 'class' AND size < 20"), kb.where("kind <> 'function'"), "package", "key", 40, "13")


@query("W07_hard_negatives", f"SELECT id, cand FROM (SELECT id, cand, row_number() OVER (PARTITION BY id ORDER BY rank) AS k FROM {RANKED} WHERE NOT hit) WHERE k <= 7")
def _(s, d):
    return VEC.top(*sides(s, d), 7, "other").select("id", "cand")


@query("M03_rank_evaluate", f"WITH g AS (SELECT id, label, min(CASE WHEN hit THEN rank END) AS r FROM {RANKED} GROUP BY 1, 2) SELECT label, count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5, round(avg(CASE WHEN r <= 5 THEN 1.0 / r ELSE 0.0 END), 6) AS mrr5 FROM g GROUP BY ROLLUP (label)")
def rank_evaluate(s, d):
    queries, candidates = sides(s, d)
    hits = queries.select("id", "label").join(VEC.first_hits(queries, candidates), "id", "left")
    within = [F.round(F.avg(F.when(F.col("gold_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"top{k}") for k in (1, 3, 5)]
    return hits.rollup("label").agg(F.count("*").alias("n"), *within, F.round(F.avg(F.when(F.col("gold_rank") <= 5, 1.0 / F.col("gold_rank")).otherwise(0.0)), 6).alias("mrr5"))


#: Every seventh query has lost its vector, every fifth its label.
SAMPLES = f"(SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS position, CASE WHEN vec_id // 100 % 5 <> 4 THEN label END AS label, vec_id // 100 % 7 = 3 AS lost FROM embeddings WHERE vec_id % 100 = 0)"


@query("M03_rank_rows", f"WITH s AS {SAMPLES}, r AS (SELECT id, arg_min(of, rank) AS prediction, min(CASE WHEN hit THEN rank END) AS r, string_agg(CASE WHEN rank <= 5 THEN cand::VARCHAR END, ',' ORDER BY rank) AS cands FROM {RANKED} GROUP BY 1) SELECT position, s.id, label, CASE WHEN NOT lost THEN prediction END AS prediction, CASE WHEN NOT lost AND label IS NOT NULL THEN coalesce(r = 1, false) END AS correct, CASE WHEN NOT lost AND label IS NOT NULL THEN r END AS gold_rank, CASE WHEN NOT lost THEN cands END AS cands, CASE WHEN lost THEN 'missing vector or candidates' END AS error FROM s LEFT JOIN r USING (id)")
def _(s, d):
    queries, candidates = sides(s, d)
    place = Window.partitionBy(F.lit(0)).orderBy("id")  # the samples of a run, numbered in its file
    samples = queries.withColumn("position", F.row_number().over(place) - 1).withColumn("label", F.when(F.expr("id DIV 100 % 5 <> 4"), F.col("label"))).withColumn("vector", F.when(F.expr("id DIV 100 % 7 <> 3"), F.col("vector")))
    rows = VEC.rank_batch(samples, candidates, 5)
    return rows.withColumn("cands", F.array_join(F.transform("ranking", lambda x: x["cand"].cast("string")), ",")).drop("ranking")


@query("M02_contrastive_loss", f"WITH p AS (SELECT id, cand, score / 0.07::DOUBLE AS s, row_number() OVER (PARTITION BY id ORDER BY hit DESC, cand) = 1 AND hit AS pos FROM {BLOCKS}), m AS (SELECT id, max(s) AS m, max(CASE WHEN pos THEN s END) AS p FROM p GROUP BY 1) SELECT p.id, round(ln(sum(exp(s - m.m))) + m.m - m.p, 5) AS loss FROM p JOIN m USING (id) WHERE m.p IS NOT NULL GROUP BY p.id, m.m, m.p")
def _(s, d):
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("hit"), "cand"))
    b = blocks(s, d).withColumn("positive", (first == 1) & F.col("hit"))
    return R.contrastive_loss(b, "id", "score", "positive").select("id", F.round("loss", 5).alias("loss"))


#: Every third document is processed and has two candidates, one without a text; the others are raw, and every seventh has no slice.
@query("M04_processed_or_raw", """SELECT doc_id AS id, md5(CASE WHEN doc_id % 3 = 0 THEN 'q ' || doc_id WHEN doc_id % 7 = 0 THEN '' ELSE '[LANGUAGE] ' || lang || chr(10) || '[TARGET_KIND] arg' || chr(10) || '[TARGET_NAME] ' || source || chr(10) || '[INTERPROCEDURAL_SLICE]' || chr(10) || trim(text, ' ') END) AS query,
 CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS candidates, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE source END AS first, lang AS label FROM documents WHERE trim(text, ' ') <> ''""")
def _(s, d):
    t = V.table(s, d, "documents").where(F.trim("text") != "")
    processed, empty = F.expr("doc_id % 3 = 0"), F.expr("doc_id % 7 = 0")
    two = F.array(F.struct(F.lit("a").alias("name"), F.col("text")), F.struct(F.lit("b").alias("name"), F.lit("").alias("text")))
    drawn = F.array(F.struct(F.col("source").alias("name"), F.col("text").alias("definition")), F.struct(F.lit("x").alias("name"), F.lit(None).cast("string").alias("definition")))
    records = t.select(
        F.col("doc_id").alias("id"), F.when(processed, F.concat(F.lit("q "), F.col("doc_id"))).alias("query"), F.when(processed, two).alias("candidates"), F.when(~empty & F.expr("doc_id % 2 = 0"), F.col("text")).alias("slice"), F.when(~empty, F.col("text")).alias("code"),
        F.col("lang").alias("language"), F.lit("arg").alias("scope"), F.col("source").alias("name"), F.when(~processed, drawn).alias("recommendations"), F.concat(F.lit(" "), "lang").alias("label"),
    )
    made = VER.prepared(records)
    return made.select("id", F.md5("query").alias("query"), F.size("candidates").alias("candidates"), F.col("candidates")[0]["name"].alias("first"), "label")


#: Ids are code points. The template of every fifth turn drops blanks at the end of a prompt once an answer follows.
@query("M07_truncate_prompts", """WITH p AS (SELECT conv_id, turn, list_transform(string_split('<' || role || '>' || text || ' ', ''), lambda x: unicode(x)) AS prompt, list_transform(string_split('<' || role || '>' || CASE WHEN turn % 5 = 4 THEN trim(text, ' ') ELSE text || ' ' END || 'label of ' || turn, ''), lambda x: unicode(x)) AS sequence FROM conversations),
 q AS (SELECT *, sequence[1:len(prompt)] = prompt AS kept FROM p)
 SELECT conv_id, turn, CASE WHEN kept THEN least(len(prompt), 40) END AS prompt_size, CASE WHEN kept THEN list_sum(prompt[1:40]) END::BIGINT AS prompt_sum, CASE WHEN kept THEN list_sum(sequence[len(prompt) + 1:len(prompt) + 8]) END::BIGINT AS completion_sum, CASE WHEN NOT kept THEN 'prompt is no prefix' END AS error FROM q""")
def _(s, d):
    def ids(c):
        return F.transform(F.split(c, ""), lambda x: F.ascii(x))

    head = F.concat(F.lit("<"), "role", F.lit(">"))
    answered = F.when(F.expr("turn % 5 = 4"), F.trim("text")).otherwise(F.concat("text", F.lit(" ")))
    t = V.table(s, d, "conversations").select("conv_id", "turn", ids(F.concat(head, "text", F.lit(" "))).alias("prompt"), ids(F.concat(head, answered, F.lit("label of "), F.col("turn"))).alias("sequence"))
    made = VER.truncated(t, "prompt", "sequence", 40, 8)
    total = lambda c: F.when(F.col(c).isNotNull(), F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
    return made.select("conv_id", "turn", F.when(F.col("error").isNull(), F.size("prompt_ids")).alias("prompt_size"), total("prompt_ids").alias("prompt_sum"), total("completion_ids").alias("completion_sum"), "error")



@query("T01_dedup_then_limit", f"SELECT id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS k FROM (SELECT id, of AS label, max(score) AS score FROM {EVERY} GROUP BY 1, 2)) WHERE k <= 5")
def _(s, d):
    return VEC.top_labels(*sides(s, d), 5).select("id", "label", "score")


@query("T02_stable_ties", "SELECT package, key FROM (SELECT p_partkey AS key, 'pkg' || (p_partkey % 25) AS package, row_number() OVER (PARTITION BY p_partkey % 25 ORDER BY p_size DESC, p_partkey) AS k FROM part) WHERE k <= 20")
def _(s, d):
    return U.first_n(V.KB(s, d).select("package", "key", "size"), ["package"], [F.desc("size"), "key"], 20).select("package", "key")


@query("T04_projects_by_hash", f"SELECT project FROM (SELECT DISTINCT {STRICT} AS project FROM {A}) WHERE {sha_int(chr(39) + '13:' + chr(39) + ' || project')} % 10000 >= 3000 ORDER BY {sha_int(chr(39) + '14:' + chr(39) + ' || project')} LIMIT 20")
def _(s, d):
    p = V.ANNOTATIONS(s, d).select(X.strict_project(F.col("file")).alias("project")).distinct()
    return p.where(H.stable_number(F.col("project"), 13) % 10000 >= 3000).orderBy(H.stable_number(F.col("project"), 14)).limit(20)


@query("T05_longest_rows", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40")
def _(s, d):
    return V.table(s, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(40)


@query("T06_stubs_first", "SELECT page_id FROM pages ORDER BY CASE WHEN contains(url, '/en/') THEN 0 ELSE 1 END, url, page_id LIMIT 30")
def _(s, d):
    return V.table(s, d, "pages").select("page_id", "url").orderBy(F.when(F.col("url").contains("/en/"), 0).otherwise(1), "url", "page_id").limit(30).select("page_id")


@query("T08_one_statement_a_line", f"SELECT file, line, min(pos) AS pos FROM {CALLS} GROUP BY 1, 2")
def _(s, d):
    return V.CALLS(s, d).groupBy("file", "line").agg(F.min("pos").alias("pos"))


@query("U01_union_then_dedup", f"SELECT name, min(key) AS key FROM (SELECT name, key FROM {KB} WHERE kind = 'class' UNION ALL SELECT name, key + 1000000 FROM {KB} WHERE kind = 'function') GROUP BY 1")
def _(s, d):
    kb = V.KB(s, d)
    a, b = kb.where("kind = 'class'").select("name", "key"), kb.where("kind = 'function'").select("name", (F.col("key") + 1000000).alias("key"))
    return U.union_first_wins([a, b], [F.col("name")], ["key"])


@query("U02_difference_intersection", f"(SELECT name, 'only' AS side FROM (SELECT name FROM {KB} WHERE kind = 'class' EXCEPT SELECT name FROM {KB} WHERE kind = 'function')) UNION ALL (SELECT name, 'both' FROM (SELECT name FROM {KB} WHERE kind = 'class' INTERSECT SELECT name FROM {KB} WHERE kind = 'function'))")
def _(s, d):
    kb = V.KB(s, d)
    a, b = kb.where("kind = 'class'").select("name"), kb.where("kind = 'function'").select("name")
    return a.subtract(b).withColumn("side", F.lit("only")).unionByName(a.intersect(b).withColumn("side", F.lit("both")))


@query("U03_ordered_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY f) AS roles FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    first = V.table(s, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))  # so only different roles meet
    r = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return r.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))


@query("U04_ranked_sources_union", f"WITH u AS (SELECT 0 AS k, key, name, definition FROM {KB} WHERE kind = 'reexport_alias' UNION ALL SELECT 1, key, name, definition FROM {KB} WHERE kind = 'type_alias' UNION ALL SELECT 2, key, name, definition FROM {KB} WHERE kind = 'class') SELECT definition, name, key FROM (SELECT *, row_number() OVER (PARTITION BY definition ORDER BY k, key) AS r FROM u) WHERE r = 1")
def _(s, d):
    kb = V.KB(s, d)
    parts = [kb.where(F.col("kind") == k).select("definition", "name", "key") for k in ("reexport_alias", "type_alias", "class")]
    return U.union_first_wins(parts, [F.col("definition")], ["key"])


@query("U05_prepend_union", f"SELECT name, min(g) AS generation, min_by(key, g * 100000000 + key) AS key FROM (SELECT name, key, 0 AS g FROM {KB} WHERE kind = 'class' UNION ALL SELECT name, key, -1 FROM {KB} WHERE kind = 'function' UNION ALL SELECT name, key, -2 FROM {KB} WHERE kind = 'type_alias') GROUP BY 1")
def _(s, d):
    kb = V.KB(s, d)
    return U.prepend_union([kb.where(F.col("kind") == k).select("name", "key") for k in ("class", "function", "type_alias")], "name", "key")


@query("U06_stubs_over_runtime", f"WITH s AS (SELECT name, package, min(key) AS key FROM {KB} WHERE kind = 'class' GROUP BY ALL), r AS (SELECT name, package, min(key) AS key FROM {KB} WHERE kind <> 'class' GROUP BY ALL) SELECT coalesce(s.name, r.name) AS name, coalesce(s.package, r.package) AS package, coalesce(s.key, r.key) AS key FROM s FULL JOIN r ON s.name = r.name AND s.package = r.package")
def _(s, d):
    kb = V.KB(s, d)
    a, b = (kb.where(w).groupBy("name", "package").agg(F.min("key").alias("key")) for w in ("kind = 'class'", "kind <> 'class'"))
    return U.preferred(a, b, ["name", "package"], ["key"])


@query("U07_kb_union_ignoring_case", f"SELECT kind, lower(name) AS low, min(key) AS key FROM {KB} GROUP BY 1, 2")
def _(s, d):
    kb = V.KB(s, d).select("kind", "name", "key")
    return U.union_first_wins([kb, kb.withColumn("name", F.upper("name"))], [F.col("kind"), F.lower("name")], ["key"]).select("kind", F.lower("name").alias("low"), "key")
