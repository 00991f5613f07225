"""Queries over join semantics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions.names import fuzzy, ratio
from ..operators import joins as J
from ..operators.name_search import fuzzy_bound
from ..operators.term_search import top_bm25
from . import views as V
from .q_similarity import CX, CY, bm25_sql, dice_sql, words
from .q_text import STRICT
from .registry import query

A, KB, CALLS = V.ANNOTATIONS.sql, V.KB.sql, V.CALLS.sql
IMPORTS = V.View("supplier", {"file": "s_suppkey", "module": "CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'pkg' || CAST(s_suppkey % 30 AS VARCHAR(20)) END", "name": "'c' || CAST(s_suppkey % 420 AS VARCHAR(20))"})
I = IMPORTS.sql  # noqa: E741
MATCH = "lower(k.name) = i.name AND (i.module = '' OR k.module = i.module OR starts_with(k.module, i.module || '.'))"


def matched(s, d, how="inner"):
    i, k = IMPORTS(s, d).alias("i"), V.KB(s, d).alias("k")
    on = (F.lower("k.name") == F.col("i.name")) & ((F.col("i.module") == "") | (F.col("k.module") == F.col("i.module")) | F.col("k.module").startswith(F.concat("i.module", F.lit("."))))
    return i.join(k, on, how)


@query("J01_project_work_items", f"SELECT {STRICT} AS project, count(*) AS n, min(pos) AS first_pos FROM {A} GROUP BY 1")
def _(s, d):
    return V.ANNOTATIONS(s, d).groupBy(X.strict_project(F.col("file")).alias("project")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query("J02_import_matches", f"SELECT i.file, i.module, k.key FROM {I} i JOIN {KB} k ON {MATCH}")
def _(s, d):
    return matched(s, d).select("i.file", "i.module", "k.key")


@query("J03_import_recommendations", f"SELECT i.file, coalesce(k.qualified_name, CASE WHEN i.module = '' THEN i.name ELSE i.module || '.' || i.name END) AS qualified_name, k.key IS NULL AS made_up FROM {I} i LEFT JOIN {KB} k ON {MATCH}")
def _(s, d):
    made = F.when(F.col("i.module") == "", F.col("i.name")).otherwise(F.concat("i.module", F.lit("."), "i.name"))
    return matched(s, d, "left").select("i.file", F.coalesce("k.qualified_name", made).alias("qualified_name"), F.col("k.key").isNull().alias("made_up"))


@query("J04_from_imported_classes", f"SELECT key, name FROM {KB} k WHERE EXISTS (SELECT 1 FROM {I} i WHERE i.name = lower(k.name))")
def _(s, d):
    i = IMPORTS(s, d).select(F.col("name").alias("low"))
    return V.KB(s, d).join(i, F.lower("name") == F.col("low"), "left_semi").select("key", "name")


@query("J05_resolve_calls", f"""WITH m AS (SELECT package AS module, name, min(key) AS key FROM {KB} WHERE kind = 'class' GROUP BY ALL HAVING count(*) = 1), n AS (SELECT name, min(key) AS key FROM {KB} WHERE kind = 'class' GROUP BY ALL HAVING count(*) = 1), q AS (SELECT qualified_name AS callee, min(key) AS key FROM {KB} WHERE kind <> 'class' GROUP BY ALL HAVING count(*) = 1)
SELECT c.pos, coalesce(q.key, m.key, n.key) AS target FROM {CALLS} c LEFT JOIN q USING (callee) LEFT JOIN m ON c.module = m.module AND c.leaf = m.name LEFT JOIN n ON c.leaf = n.name""")
def _(s, d):
    kb = V.KB(s, d)
    classes, others = kb.where("kind = 'class'").select(F.col("package").alias("module"), F.col("name").alias("leaf"), "key"), kb.where("kind <> 'class'").select(F.col("qualified_name").alias("callee"), "key")
    steps = [(J.unique_by(others, ["callee"], "key", "key"), ["callee"], "key"), (J.unique_by(classes, ["module", "leaf"], "key", "key"), ["module", "leaf"], "key"), (J.unique_by(classes, ["leaf"], "key", "key"), ["leaf"], "key")]
    return J.priority_join(V.CALLS(s, d).select("pos", "callee", "module", "leaf"), steps, "target").select("pos", "target")


@query("J06_function_sources", f"""WITH a AS (SELECT qualified_name AS callee, min(key) AS k FROM {KB} GROUP BY 1), b AS (SELECT module AS callee, min(key) AS k FROM {KB} GROUP BY 1), c AS (SELECT name AS leaf, min(key) AS k FROM {KB} GROUP BY 1)
SELECT x.pos, coalesce(a.k, b.k, c.k) AS source FROM {CALLS} x LEFT JOIN a USING (callee) LEFT JOIN b ON x.callee = b.callee LEFT JOIN c ON x.leaf = c.leaf WHERE x.leaf NOT IN ('C1', 'C2', 'C3')""")
def _(s, d):
    kb = V.KB(s, d)
    steps = [(kb.groupBy(F.col(c).alias(k)).agg(F.min("key").alias("k")), [k], "k") for c, k in (("qualified_name", "callee"), ("module", "callee"), ("name", "leaf"))]
    return J.priority_join(V.CALLS(s, d).where(~F.col("leaf").isin("C1", "C2", "C3")).select("pos", "callee", "leaf"), steps, "source").select("pos", "source")


@query("J07_classes_union", f"SELECT q, key FROM (SELECT DISTINCT callee AS q FROM {CALLS}) JOIN {KB} ON name = q UNION ALL SELECT q, key FROM (SELECT DISTINCT callee AS q FROM {CALLS}) JOIN {KB} ON package = split_part(q, '.', 1) WHERE kind = 'class'")
def _(s, d):
    q, kb = V.CALLS(s, d).select(F.col("callee").alias("q")).distinct(), V.KB(s, d)
    by_name = J.union_lookup(q, kb, [(F.col("q"), "name")], ["q", "key"])
    return by_name.unionByName(J.union_lookup(q, kb.where("kind = 'class'"), [(F.substring_index("q", ".", 1), "package")], ["q", "key"]))


@query("J08_call_sites_fallback", f"""WITH t AS (SELECT key, qualified_name, name FROM {KB}), u AS (SELECT callee, leaf, count(*) AS n FROM {CALLS} GROUP BY ALL)
SELECT key, callee, n FROM t JOIN u ON callee = qualified_name UNION ALL SELECT key, callee, n FROM t JOIN u ON leaf = name WHERE qualified_name NOT IN (SELECT callee FROM u)""")
def _(s, d):
    u = V.CALLS(s, d).groupBy("callee", "leaf").agg(F.count("*").alias("n"))
    return J.guarded_fallback(V.KB(s, d).select("key", "qualified_name", "name"), u, ("qualified_name", "callee"), ("name", "leaf"), ["key", "callee", "n"])


@query("J09_unique_qualified_name", f"SELECT lower(package) AS file, name, min(qualified_name) AS qualified_name FROM {KB} GROUP BY 1, 2 HAVING count(*) = 1")
def _(s, d):
    return J.unique_by(V.KB(s, d).withColumn("file", F.lower("package")), ["file", "name"], "qualified_name", "qualified_name")


@query("J10_similar_class_of_file")
def _(s, d):
    from ..functions.python_udfs import sequence_ratio

    a = IMPORTS(s, d).where("module <> ''").select("file", F.col("module").alias("package"), F.col("name").alias("wanted"))
    classes = V.KB(s, d).where("kind = 'class'").groupBy("package", "name").agg(F.min("key").alias("key"))
    near = V.spread(J.different_pairs(a, classes, "package", "wanted", "name")).withColumn("r", sequence_ratio("wanted", "name"))
    equal = F.lower("wanted") == F.lower("name")
    place = F.struct(F.when(equal, 0).otherwise(1).alias("unlike"), "key", "name").alias("place")
    found = near.where(equal | (F.col("r") > 0.78)).join(classes.hint("merge"), ["package", "name"]).groupBy("package", "wanted").agg(F.min(place).alias("place"))
    return a.join(found.hint("merge"), ["package", "wanted"]).groupBy("file", "wanted").agg(F.min("place").alias("place")).select("file", "wanted", "place.name")


@query("J11_name_similarity_top20")
def _(s, d):
    return J.top_similar(V.table(s, d, "nation").select(F.col("n_name").alias("q")), V.KB(s, d).withColumn("text", F.col("definition")), "q", "text", "key", ratio, 0.2, 20)


@query("J13_fuzzy_kb_top20")
def _(s, d):
    q = V.table(s, d, "region").select(F.col("r_name").alias("q"))
    return J.top_similar(q, V.table(s, d, "customer").select(F.col("c_mktsegment").alias("c"), "c_custkey"), "q", "c", "c_custkey", fuzzy, 0.2, 20, fuzzy_bound)


@query("J15_module_inventory")
def _(s, d):
    from ..functions.python_udfs import sequence_ratio

    i = IMPORTS(s, d).where("module <> ''").select("file", F.col("module").alias("package"), F.col("name").alias("wanted"))
    # the best hundred of a wanted name are among the first hundred keys of its best hundred names
    numbered = lambda rows, keys, order: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank <= 100")
    kb, order = V.KB(s, d).select("package", "name", "key"), (F.desc("r"), "name", "key")
    scored = V.spread(J.different_pairs(i, kb, "package", "wanted", "name")).withColumn("r", F.round(sequence_ratio("wanted", "name"), 6))
    names = numbered(scored, ["package", "wanted"], order[:2]).drop("rank")
    best = numbered(names.join(numbered(kb, ["package", "name"], ["key"]).drop("rank").hint("merge"), ["package", "name"]), ["package", "wanted"], order).drop("rank")
    return numbered(i.join(best.hint("merge"), ["package", "wanted"]), ["file", "package"], order).select("file", "package", "key", "rank")


QUERY_DOCS = f"(SELECT doc_id, {words('lower(text)')} AS xt FROM documents WHERE doc_id % 100 = 0)"
ITEMS = f"(SELECT item_id, {words('lower(text)')} AS yt FROM benchmark)"


STOP_WORDS = "and as async await class def else false for from if import in none not or pass return self true with yield".split()


def _words(text):
    return S.tokens(F.lower(text))


def _identifiers(text):
    """Lower-cased identifiers but stop words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)[A-Za-z_]\w*"), F.lit(0)), F.lower)
    return F.filter(found, lambda x: ~x.isin(STOP_WORDS))


def _bm25_matches(s, d, k, above, tokens=_words, items=None):
    """The k best items over a score for each document whose id is divisible by 100, by common words."""
    q = V.table(s, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("id"), tokens("text").alias("tokens"))
    c = (V.table(s, d, "benchmark") if items is None else items).select(F.col("item_id").alias("id"), tokens("text").alias("tokens"))
    return top_bm25(q, c, k, above).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", "rank")


BM = bm25_sql(f"SELECT doc_id, item_id, xt, yt FROM {QUERY_DOCS}, {ITEMS}", "doc_id, item_id") + ", r AS (SELECT doc_id, item_id, round(((xy + yx) / 2) / ((xy + yx) / 2 + 1), 6) AS score FROM t)"


@query("J12_bm25_classes_top5", BM + " SELECT doc_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS k FROM r WHERE score > 0.5) WHERE k <= 5")
def _(s, d):
    return _bm25_matches(s, d, 5, 0.5).drop("rank")


@query("J14_structural_bm25_top20", BM + " SELECT doc_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS k FROM r WHERE score > 0.1) WHERE k <= 20")
def _(s, d):
    return _bm25_matches(s, d, 20, 0.1).drop("rank")


@query("J14_structural_bm25_top20_identifiers")
def _(s, d):
    """Over identifiers, and of equal definitions the first only. J14's SQL has words and every copy."""
    items = V.table(s, d, "benchmark").groupBy("text").agg(F.min("item_id").alias("item_id"))
    return _bm25_matches(s, d, 20, 0.1, _identifiers, items).drop("rank")


@query("T07_best_under_threshold", BM + " SELECT doc_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS k, max(score) OVER (PARTITION BY doc_id) AS best FROM r WHERE score > 0.3) WHERE k <= 5 AND best >= 0.5")
def _(s, d):
    best = F.max("score").over(Window.partitionBy("doc_id"))
    return _bm25_matches(s, d, 5, 0.3).withColumn("best", best).where("best >= 0.5").select("doc_id", "item_id", "score")


SEEDS = V.View("supplier", {"project": "s_nationkey", "seed": "CASE WHEN s_suppkey % 2 = 0 THEN 'pkg' || CAST(s_suppkey % 25 AS VARCHAR(20)) || '.C' || CAST(s_suppkey % 400 AS VARCHAR(20)) ELSE 'C' || CAST(s_suppkey % 400 AS VARCHAR(20)) END", "rank": "s_suppkey % 50"})
PROJECT_KB = "(SELECT *, key % 25 AS project FROM part_kb)"
TOKENS = "list_distinct(regexp_extract_all(lower({}), '([a-z_][a-z0-9_]*)', 1))"
KB_SCORE = f"""WITH part_kb AS (SELECT * FROM {KB}), kb AS (SELECT * FROM {PROJECT_KB} WHERE kind IN ('class', 'type_alias', 'reexport_alias')), seeds AS (SELECT project, lower(seed) AS seed, min(rank) AS r FROM {SEEDS.sql} GROUP BY 1, 2),
target AS (SELECT n_nationkey AS project, n_name, {TOKENS.format("n_name || ' steel c7 pkg3'")} AS tt, {TOKENS.format("'c1 c26 brass promo standard ' || n_name")} AS st FROM nation),
s AS (SELECT kb.project, kb.key, kb.qualified_name, least(coalesce(a.r, 10000), coalesce(b.r, 10000)) AS seed_rank, len(list_intersect(tt, {TOKENS.format("kb.name || ' ' || kb.qualified_name || ' ' || kb.definition")})) AS t, len(list_intersect(st, {TOKENS.format("kb.name || ' ' || kb.qualified_name || ' ' || kb.definition")})) AS c, list_contains(st, lower(kb.name)) AS named
 FROM kb JOIN target USING (project) LEFT JOIN seeds a ON a.project = kb.project AND a.seed = lower(kb.qualified_name) LEFT JOIN seeds b ON b.project = kb.project AND b.seed = lower(kb.name)),
z AS (SELECT project, key, qualified_name, CASE WHEN seed_rank < 10000 THEN 10000 - seed_rank ELSE 0 END + 40 * t + least(25, c) + CASE WHEN named THEN 100 ELSE 0 END AS score FROM s)"""


def kb_scores(s, d):
    from ..operators.retrieval import kb_scores as scores

    words_of = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z_][a-z0-9_]*)"), F.lit(1)))
    kb = V.KB(s, d).withColumn("project", F.expr("key % 25")).where(F.col("kind").isin("class", "type_alias", "reexport_alias"))
    kb = kb.withColumn("words", words_of(F.concat_ws(" ", "name", "qualified_name", "definition")))
    n = V.table(s, d, "nation")
    target = n.select(F.col("n_nationkey").alias("project"), words_of(F.concat("n_name", F.lit(" steel c7 pkg3"))).alias("target_tokens"), words_of(F.concat(F.lit("c1 c26 brass promo standard "), "n_name")).alias("slice_tokens"))
    return scores(kb, SEEDS(s, d), target)


@query("J16_seed_ranks", KB_SCORE + " SELECT project, key, least(seed_rank, 10000) AS seed_rank FROM s WHERE seed_rank < 10000")
def _(s, d):
    return kb_scores(s, d).where("seed_rank < 10000").select("project", "key", "seed_rank")


@query("SC40_kb_score", KB_SCORE + " SELECT project, key, score FROM z")
def _(s, d):
    return kb_scores(s, d).select("project", "key", "score")


@query("T03_kb_top10", KB_SCORE + ", f AS (SELECT *, row_number() OVER (PARTITION BY project, lower(qualified_name) ORDER BY score DESC, key) AS d FROM z) SELECT project, key, score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, lower(qualified_name), key) AS k FROM f WHERE d = 1) WHERE k <= 10")
def _(s, d):
    from ..operators.retrieval import top_types

    return top_types(kb_scores(s, d), 10).select("project", "key", "score", "rank")


@query("J17_gold_or_catalog", f"""WITH c AS (SELECT lower(name) AS n, min_by(key, key) AS key FROM {KB} GROUP BY 1), g AS (SELECT pos, 'c' || (pos % 450) AS gold, 'pkg' || (pos % 25) AS package FROM {A}), r AS (SELECT package, lower(name) AS n, min(key) AS key FROM {KB} GROUP BY 1, 2)
SELECT pos, coalesce(r.key, c.key) AS key, r.key IS NOT NULL AS recommended FROM g LEFT JOIN r ON r.package = g.package AND r.n = gold LEFT JOIN c ON c.n = gold""")
def _(s, d):
    kb = V.KB(s, d).withColumn("gold", F.lower("name"))
    g = V.ANNOTATIONS(s, d).select("pos", F.concat(F.lit("c"), F.expr("pos % 450")).alias("gold"), F.concat(F.lit("pkg"), F.expr("pos % 25")).alias("package"))
    mine = kb.groupBy("package", "gold").agg(F.min("key").alias("mine"))
    any_ = kb.groupBy("gold").agg(F.min("key").alias("other"))
    return g.join(mine, ["package", "gold"], "left").join(any_, "gold", "left").select("pos", F.coalesce("mine", "other").alias("key"), F.col("mine").isNotNull().alias("recommended"))


@query("J18_never_attempted", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(s, d):
    from ..operators.checks import missing

    return missing(V.table(s, d, "customer"), V.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("J19_not_in_kb", f"SELECT DISTINCT c.module, c.leaf FROM {CALLS} c WHERE NOT EXISTS (SELECT 1 FROM {KB} k WHERE k.package = c.module AND k.name = c.leaf)")
def _(s, d):
    k = V.KB(s, d).select(F.col("package").alias("module"), F.col("name").alias("leaf"))
    return V.CALLS(s, d).select("module", "leaf").distinct().join(k, ["module", "leaf"], "left_anti")


@query("J20_foreign_rows", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(s, d):
    return V.table(s, d, "documents").join(V.table(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("J21_status_and_output", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'no output' WHEN l.doc_id IS NULL THEN 'no status' WHEN l.toxic = 1 THEN 'retry' ELSE 'done' END AS state FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def _(s, d):
    o = V.table(s, d, "documents").select("doc_id", F.lit(True).alias("o"))
    state = F.when(F.col("o").isNull(), "no output").when(F.col("toxic").isNull(), "no status").when(F.col("toxic") == 1, "retry").otherwise("done")
    return o.join(V.table(s, d, "labels"), "doc_id", "full").select("doc_id", state.alias("state"))


@query("J22_project_overlap", f"SELECT DISTINCT file FROM {A} WHERE pos % 2 = 0 INTERSECT SELECT file FROM {A} WHERE pos % 2 = 1")
def _(s, d):
    a = V.ANNOTATIONS(s, d)
    return a.where("pos % 2 = 0").select("file").intersect(a.where("pos % 2 = 1").select("file"))


FUNCTIONS = V.View("supplier", {"file": "s_suppkey % 50", "fn": "s_suppkey", "start": "CAST(s_acctbal * 0 AS BIGINT) + s_suppkey * 3 % 40", "stop": "s_suppkey * 3 % 40 + s_suppkey % 90"})
POINTS = V.View("lineitem", {"pos": "l_orderkey * 8 + l_linenumber", "file": "l_suppkey % 50", "line": "l_linenumber * 10 + l_partkey % 10"})


@query("J23_innermost_function", f"SELECT pos, min_by(fn, (stop - start) * 1000000 + start * 1000) AS fn FROM (SELECT p.pos, f.* FROM {POINTS.sql} p JOIN (SELECT file, start, stop, min(fn) AS fn FROM {FUNCTIONS.sql} GROUP BY ALL) f ON p.file = f.file AND p.line BETWEEN f.start AND f.stop) GROUP BY pos")
def _(s, d):
    f = FUNCTIONS(s, d).groupBy("file", "start", "stop").agg(F.min("fn").alias("fn"))
    return J.innermost(POINTS(s, d), f, ["file"], "line", "start", "stop", "fn", ["pos"])


@query("J24_nodes_spanning_line", f"SELECT p.pos, count(*) AS n, min(f.fn) AS first_fn FROM {POINTS.sql} p JOIN {FUNCTIONS.sql} f ON p.file = f.file AND p.line BETWEEN f.start AND f.stop GROUP BY p.pos")
def _(s, d):
    # equal spans count once with their number, equal places look once; a span meets at most as many places as it has lines
    spans = FUNCTIONS(s, d).groupBy("file", "start", "stop").agg(F.count("*").alias("n"), F.min("fn").alias("fn"))
    places = POINTS(s, d).select("file", "line").distinct()
    found = J.range_join(places, spans, ["file"], "line", "start", "stop").groupBy("file", "line").agg(F.sum("n").alias("n"), F.min("fn").alias("fn"))
    return POINTS(s, d).join(found, ["file", "line"]).groupBy("pos").agg(F.sum("n").alias("n"), F.min("fn").alias("first_fn"))


@query("J25_fixtures_to_parameters", f"SELECT a.name, count(*) AS n FROM {A} a JOIN (SELECT DISTINCT 'v' || (s_suppkey % 20) AS name FROM supplier) f USING (name) GROUP BY 1")
def _(s, d):
    f = V.table(s, d, "supplier").select(F.concat(F.lit("v"), F.expr("s_suppkey % 20")).alias("name")).distinct()
    return V.ANNOTATIONS(s, d).join(f, "name").groupBy("name").agg(F.count("*").alias("n"))


@query("J26_arguments_to_parameters", f"""WITH p AS (SELECT key AS part, size % 7 + 1 AS position, 'k' || (size % 5) AS keyword FROM {KB}), c AS (SELECT pos, part, arg, CASE WHEN pos % 3 = 0 THEN 'k' || (pos % 5) END AS keyword FROM {CALLS})
SELECT pos, c.part, 'position' AS by FROM c JOIN p ON c.part = p.part AND c.arg = p.position WHERE c.keyword IS NULL UNION ALL SELECT pos, c.part, 'keyword' FROM c JOIN p ON c.part = p.part AND c.keyword = p.keyword""")
def _(s, d):
    p = V.KB(s, d).select(F.col("key").alias("part"), F.expr("size % 7 + 1").alias("arg"), F.concat(F.lit("k"), F.expr("size % 5")).alias("keyword"))
    c = V.CALLS(s, d).select("pos", "part", "arg", F.when(F.expr("pos % 3 = 0"), F.concat(F.lit("k"), F.expr("pos % 5"))).alias("keyword"))
    by_position = c.where("keyword IS NULL").drop("keyword").join(p, ["part", "arg"]).select("pos", "part", F.lit("position").alias("by"))
    return by_position.unionByName(c.drop("arg").join(p, ["part", "keyword"]).select("pos", "part", F.lit("keyword").alias("by")))


@query("J27_call_to_function", f"WITH q AS (SELECT callee, split_part(callee, '.', -1) AS l FROM (SELECT DISTINCT callee FROM {CALLS})) SELECT callee, min(key) AS key FROM q JOIN {KB} k ON l = split_part(k.qualified_name, '.', -1) GROUP BY 1")
def _(s, d):
    q = V.CALLS(s, d).select("callee").distinct().withColumn("l", X.last_part(F.col("callee")))
    return q.join(V.KB(s, d).withColumn("l", X.last_part(F.col("qualified_name"))), "l").groupBy("callee").agg(F.min("key").alias("key"))


@query("J28_four_call_sites", f"SELECT leaf, pos FROM (SELECT leaf, pos, row_number() OVER (PARTITION BY leaf ORDER BY pos) AS k FROM {CALLS}) WHERE k <= 4")
def _(s, d):
    k = F.row_number().over(Window.partitionBy("leaf").orderBy("pos"))
    return V.CALLS(s, d).select("leaf", "pos").withColumn("k", k).where("k <= 4").drop("k")


@query("J29_definitions_for_call", f"WITH q AS (SELECT DISTINCT callee, leaf FROM {CALLS}), k AS (SELECT key, qualified_name, name FROM {KB}) SELECT callee, key FROM q JOIN k ON qualified_name = callee UNION ALL SELECT callee, key FROM q JOIN k ON name = leaf WHERE callee NOT IN (SELECT qualified_name FROM k)")
def _(s, d):
    q = V.CALLS(s, d).select("callee", "leaf").distinct()
    return J.guarded_fallback(q, V.KB(s, d).select("key", "qualified_name", "name"), ("callee", "qualified_name"), ("leaf", "name"), ["callee", "key"])


@query("J30_two_key_lookup", f"WITH q AS (SELECT DISTINCT module, leaf FROM {CALLS}) SELECT q.module, leaf, key FROM q JOIN {KB} k ON package = q.module AND name = leaf UNION SELECT q.module, leaf, key FROM q JOIN {KB} k ON kind = 'class' AND name = leaf AND qualified_name = q.module || '.' || leaf")
def _(s, d):
    q, kb = V.CALLS(s, d).select("module", "leaf").distinct(), V.KB(s, d)
    first = q.join(kb, (F.col("package") == q["module"]) & (F.col("name") == F.col("leaf"))).select(q["module"], "leaf", "key")
    second = q.join(kb.where("kind = 'class'"), (F.col("name") == F.col("leaf")) & (F.col("qualified_name") == F.concat(q["module"], F.lit("."), F.col("leaf")))).select(q["module"], "leaf", "key")
    return first.union(second).distinct()


@query("J31_imported_or_similar", BM + " SELECT doc_id, item_id, 'similar' AS why FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS k FROM r WHERE score > 0.5) WHERE k <= 5 UNION SELECT doc_id, doc_id // 100 AS item_id, 'imported' FROM documents WHERE doc_id % 100 = 0 AND doc_id // 100 IN (SELECT item_id FROM benchmark)")
def _(s, d):
    m = _bm25_matches(s, d, 5, 0.5)
    imported = V.table(s, d, "documents").where("doc_id % 100 = 0").select("doc_id", F.expr("doc_id DIV 100").alias("item_id")).join(V.table(s, d, "benchmark").select("item_id"), "item_id", "left_semi")
    return m.select("doc_id", "item_id", F.lit("similar").alias("why")).union(imported.select("doc_id", "item_id", F.lit("imported"))).distinct()


@query("J32_same_file_similar", "WITH c AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS t FROM conversations) SELECT a.conv_id, a.turn, b.turn AS other FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE len(list_intersect(a.t, b.t)) * 100 > 8 * len(list_distinct(list_concat(a.t, b.t)))")
def _(s, d):
    c = V.table(s, d, "conversations").select("conv_id", "turn", F.array_distinct(S.tokens(F.lower("text"))).alias("t"))
    o = c.select("conv_id", F.col("turn").alias("other"), F.col("t").alias("o"))
    return c.join(o, "conv_id").where("other < turn").where(F.size(F.array_intersect("t", "o")) * 100 > 8 * F.size(F.array_union("t", "o"))).select("conv_id", "turn", "other")


#: Classes of small files, what files import, names of variables and what models predict, all made from parts' names.
CLASSES = V.View("part", {"file": "CAST(floor(p_partkey / 40) AS BIGINT)", "class": "replace(p_name, ' ', '')", "place": "p_partkey"})
IMPORTED = V.View("part", {"file": "CAST(floor(p_partkey / 40) AS BIGINT) - 1", "class": "replace(p_name, ' ', '')", "place": "p_partkey", "taken": "p_partkey % 3 = 0"})
VARIABLES = V.View("part", {"id": "p_partkey", "file": "CAST(floor(p_partkey / 40) AS BIGINT) - p_partkey % 2", "name": "substr(p_name, 1, 9 + p_size % 20)", "taken": "p_partkey % 5 = 0"})
PREDICTED = V.View("part", {"id": "p_partkey", "project": "CAST(floor(p_partkey / 100) AS BIGINT)", "name": "substr(p_name, 1, 8 + p_size)", "taken": "p_partkey % 20 = 0"})
NPM = V.View("part", {"package": "CAST(floor(p_partkey / 50) AS BIGINT)", "kind": "CASE p_partkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' ELSE 'alias' END", "type": "substr(p_name, 1, 15)", "text": "'{ ' || p_name || ' : ' || p_type || ' }'", "key": "p_partkey"})
ANSWERS = V.View("part", {"id": "p_partkey", "package": "CAST(floor(p_partkey / 50) AS BIGINT)", "answer": "CASE WHEN p_partkey % 2 = 0 THEN '{ ' || p_name || ' }' ELSE substr(p_name, 1, 12) END", "taken": "p_partkey % 7 = 0"})


@query("J33_first_similar_class", dice_sql(f"SELECT id, 0 AS phase, place, name AS x, class AS y FROM {VARIABLES.sql} JOIN {CLASSES.sql} USING (file) WHERE taken UNION ALL SELECT id, 1, place, name, class FROM {VARIABLES.sql} v JOIN {IMPORTED.sql} i USING (file) WHERE v.taken AND i.taken", "id, phase, place") + " SELECT id, replace(p_name, ' ', '') AS class FROM (SELECT id, min_by(place, phase * 1000000000 + place) AS place FROM dice WHERE same OR score > 0.5 GROUP BY 1) JOIN part ON p_partkey = place")
def _(s, d):
    v = VARIABLES(s, d).where("taken").drop("taken")
    return J.first_by_phase(v, ["id"], "name", [(CLASSES(s, d), ["file"]), (IMPORTED(s, d).where("taken").drop("taken"), ["file"])], "class", "place", 0.5)


@query("J34_similar_until_exact", dice_sql(f"SELECT id, place, name AS x, class AS y FROM {PREDICTED.sql} JOIN (SELECT *, CAST(floor(place / 100) AS BIGINT) AS project FROM {CLASSES.sql}) USING (project) WHERE taken", "id, place") + ", e AS (SELECT id, min(place) AS stop FROM dice JOIN part ON p_partkey = place JOIN (SELECT id, name FROM " + PREDICTED.sql + ") USING (id) WHERE score > 0.6 AND lower(name) = lower(replace(p_name, ' ', '')) GROUP BY 1) SELECT id, place FROM dice LEFT JOIN e USING (id) WHERE score > 0.6 AND place <= coalesce(stop, place)")
def _(s, d):
    c = CLASSES(s, d).withColumn("project", F.expr("CAST(floor(place / 100) AS BIGINT)"))
    return J.until_exact(PREDICTED(s, d).where("taken"), ["id"], "name", c, ["project"], "class", "place", 0.6).select("id", "place")


NPM_PAIRS = f"(SELECT id, key, kind, answer AS x, type, text AS y FROM {ANSWERS.sql} JOIN {NPM.sql} USING (package) WHERE taken)"


@query("J36_similar_npm_types", dice_sql(f"SELECT id, key, x, type AS y FROM {NPM_PAIRS} WHERE NOT starts_with(x, '{{')", "id, key") + ", " + bm25_sql(f"SELECT id, key, {words('lower(cx)')} AS xt, {words('lower(cy)')} AS yt FROM (SELECT id, key, {CX} AS cx, {CY} AS cy FROM {NPM_PAIRS} WHERE starts_with(x, '{{'))", "id, key", True).strip().removeprefix("WITH ")
       + f", s AS (SELECT id, key, round(xy / (xy + 1) / CASE WHEN length({CX}) > 5 * length({CY}) OR length({CY}) > 5 * length({CX}) THEN 5 ELSE 1 END, 6) AS score FROM t JOIN {NPM_PAIRS} USING (id, key) UNION ALL SELECT id, key, score FROM dice) SELECT id, key, kind, score FROM s JOIN {NPM_PAIRS} USING (id, key) WHERE score > 0.5")
def _(s, d):
    """By BM25 of the texts if the answer is an object type, else by letter pairs of the names."""
    near = ANSWERS(s, d).where("taken").join(NPM(s, d), "package")
    score = F.when(F.col("answer").startswith("{"), S.bm25_of_texts(F.col("answer"), F.col("text"))).otherwise(S.dice(F.col("answer"), F.col("type")))
    return near.select("id", "key", "kind", F.round(score, 6).alias("score")).where("score > 0.5")


@query("J35_name_or_prefix", f"SELECT DISTINCT q.name AS q, k.key FROM (SELECT DISTINCT 'C' || (s_suppkey % 60) AS name FROM supplier) q JOIN {KB} k ON k.name = q.name OR starts_with(k.name, q.name)")
def _(s, d):
    from ..operators.retrieval import prefix_join

    q = V.table(s, d, "supplier").select(F.concat(F.lit("C"), F.expr("s_suppkey % 60")).alias("q")).distinct()
    return prefix_join(q, "q", V.KB(s, d), "name").select("q", "key")


@query("J37_checksum_conflicts", "SELECT p_name AS path, count(DISTINCT p_size) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1")
def _(s, d):
    from ..operators.checks import checksum_conflicts

    return checksum_conflicts(V.table(s, d, "part").withColumnRenamed("p_name", "path"), "path", "p_size")


@query("J38_alias_to_package", f"WITH a AS (SELECT file, module AS package FROM {I} WHERE module <> ''), c AS (SELECT DISTINCT file, leaf FROM {CALLS}) SELECT c.file, c.leaf, count(*) AS n FROM c LEFT JOIN a ON a.file = c.file JOIN {KB} k ON k.name = c.leaf AND (a.package IS NULL OR k.package = a.package) GROUP BY 1, 2")
def _(s, d):
    a = IMPORTS(s, d).where("module <> ''").select("file", F.col("module").alias("of"))
    c = V.CALLS(s, d).select("file", F.col("leaf").alias("name")).distinct().join(a, "file", "left")
    # records are counted by name, and by name and package, before calls meet them
    packages = V.KB(s, d).groupBy("name", F.col("package").alias("of")).agg(F.count("*").alias("n"))
    names = packages.groupBy("name").agg(F.sum("n").alias("n"))
    found = c.where("of IS NULL").join(names, "name").select("file", "name", "n").unionByName(c.join(packages, ["name", "of"]).select("file", "name", "n"))
    return found.groupBy("file", F.col("name").alias("leaf")).agg(F.sum("n").alias("n"))
