"""Queries over similarities. Pairs of texts come from equi-joins, never from all combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from . import views as V
from .registry import query

#: Each turn of a conversation with the one before it.
PAIRS = "(SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)"


def pairs(s, d):
    c = V.table(s, d, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("x")).join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("y")), ["conv_id", "turn"])


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '\\s+'), lambda w: w <> '')"


def bm25_sql(source: str, keys: str, distinct: bool = False) -> str:
    """Exploded form of the definition: for each shared term, its count in the query times what the document gives it."""
    times = "1" if distinct else "q.f"
    return f"""
WITH p AS ({source}), l AS (SELECT {keys}, len(xt) AS nx, len(yt) AS ny FROM p),
xc AS (SELECT {keys}, w, count(*) AS f FROM (SELECT {keys}, unnest(xt) AS w FROM p) GROUP BY ALL),
yc AS (SELECT {keys}, w, count(*) AS f FROM (SELECT {keys}, unnest(yt) AS w FROM p) GROUP BY ALL),
t AS (SELECT {keys}, sum({times} * ln(1.2::DOUBLE) * 2.5 * d.f / (d.f + 1.5 * (0.25 + 0.75 * ny / ((nx + ny) / 2.0)))) AS xy, sum({times.replace('q.f', 'd.f')} * ln(1.2::DOUBLE) * 2.5 * q.f / (q.f + 1.5 * (0.25 + 0.75 * nx / ((nx + ny) / 2.0)))) AS yx
      FROM xc q JOIN yc d USING ({keys}, w) JOIN l USING ({keys}) GROUP BY {keys})
"""


def dice_sql(source: str, keys: str) -> str:
    """score of (keys, x, y) by letter pairs: rows of a table `dice`."""
    return f"""
WITH dp AS (SELECT {keys}, regexp_replace(lower(x), '\\s+', '', 'g') AS x, regexp_replace(lower(y), '\\s+', '', 'g') AS y FROM ({source})),
dg AS (SELECT {keys}, 0 AS side, substr(x, i, 2) AS g FROM (SELECT *, unnest(range(1, length(x))) AS i FROM dp) UNION ALL SELECT {keys}, 1, substr(y, i, 2) FROM (SELECT *, unnest(range(1, length(y))) AS i FROM dp)),
dc AS (SELECT {keys}, g, count(*) FILTER (WHERE side = 0) AS nx, count(*) FILTER (WHERE side = 1) AS ny FROM dg GROUP BY ALL),
dice AS (SELECT {keys}, x = y AS same, round(CASE WHEN x = y THEN 1 WHEN length(x) < 2 OR length(y) < 2 THEN 0 ELSE 2.0 * sum(least(nx, ny)) / sum(nx + ny) END, 6) AS score FROM dp LEFT JOIN dc USING ({keys}) GROUP BY {keys}, x, y)"""


SYM = bm25_sql(f"SELECT conv_id, turn, {words('x')} AS xt, {words('y')} AS yt FROM {PAIRS}", "conv_id, turn")


@query("SC30_bm25_symmetric", SYM + "SELECT conv_id, turn, round(CASE WHEN nx = 0 AND ny = 0 THEN 1 ELSE coalesce(((xy + yx) / 2) / ((xy + yx) / 2 + 1), 0) END, 6) AS score FROM l LEFT JOIN t USING (conv_id, turn)")
def _(s, d):
    p = pairs(s, d).select("conv_id", "turn", S.tokens(F.col("x")).alias("x"), S.tokens(F.col("y")).alias("y"))
    return p.select("conv_id", "turn", F.round(S.bm25(F.col("x"), F.col("y")), 6).alias("score"))


@query("SC31_score_normalisers", SYM + "SELECT conv_id, turn, round(coalesce(1 - exp(-((xy + yx) / 2) / 10), 0), 6) AS exponential, round(coalesce(2 / (1 + exp(-(xy + yx) / 2)) - 1, 0), 6) AS sigmoid FROM l LEFT JOIN t USING (conv_id, turn)")
def _(s, d):
    p = pairs(s, d).select("conv_id", "turn", S.bm25_raw(S.tokens(F.col("x")), S.tokens(F.col("y"))).alias("raw"))
    return p.select("conv_id", "turn", F.round(S.normalise_score(F.col("raw"), "exponential", average=F.lit(10.0)), 6).alias("exponential"), F.round(S.normalise_score(F.col("raw"), "sigmoid"), 6).alias("sigmoid"))


@query("SC32_bm25_directed", bm25_sql(f"SELECT conv_id, turn, {words('lower(x)')} AS xt, {words('lower(y)')} AS yt FROM {PAIRS}", "conv_id, turn", True) + "SELECT conv_id, turn, round(coalesce(xy / (xy + 1), 0), 6) AS score FROM l LEFT JOIN t USING (conv_id, turn)")
def _(s, d):
    p = pairs(s, d).select("conv_id", "turn", S.tokens(F.lower("x")).alias("x"), S.tokens(F.lower("y")).alias("y"))
    return p.select("conv_id", "turn", F.round(S.bm25_directed(F.col("x"), F.col("y")), 6).alias("score"))


#: DuckDB has no replace-first of a literal other than regexp_replace without the g option.
CLEAN = "regexp_replace(regexp_replace(replace(replace({}, '?', ''), chr(13) || chr(10), ''), '([(<])', '\\1 ', 'g'), '([)>])', ' \\1', 'g')"
CX = f"regexp_replace(regexp_replace({CLEAN.format('x')}, '\\{{', ''), '\\(', '')"
CY = f"regexp_replace(regexp_replace({CLEAN.format('y')}, '\\}}', ''), '\\)', '')"


@query("SC33_bm25_of_texts", bm25_sql(f"SELECT conv_id, turn, {words('lower(cx)')} AS xt, {words('lower(cy)')} AS yt FROM (SELECT conv_id, turn, {CX} AS cx, {CY} AS cy FROM {PAIRS})", "conv_id, turn", True)
       + f", s AS (SELECT conv_id, turn, length({CX}) AS ax, length({CY}) AS ay FROM {PAIRS}) SELECT conv_id, turn, round(coalesce(xy / (xy + 1), 0) / CASE WHEN ax > 5 * ay OR ay > 5 * ax THEN 5 ELSE 1 END, 6) AS score FROM s LEFT JOIN t USING (conv_id, turn)")
def _(s, d):
    return pairs(s, d).select("conv_id", "turn", F.round(S.bm25_of_texts(F.col("x"), F.col("y")), 6).alias("score"))


@query("SC34_dice", """WITH p AS (SELECT a.p_partkey, regexp_replace(lower(a.p_name), '\\s+', '', 'g') AS x, regexp_replace(lower(a.p_type), '\\s+', '', 'g') AS y FROM part a),
g AS (SELECT p_partkey, 0 AS side, substr(x, i, 2) AS g FROM (SELECT *, unnest(range(1, length(x))) AS i FROM p) UNION ALL SELECT p_partkey, 1, substr(y, i, 2) FROM (SELECT *, unnest(range(1, length(y))) AS i FROM p)),
c AS (SELECT p_partkey, g, count(*) FILTER (WHERE side = 0) AS nx, count(*) FILTER (WHERE side = 1) AS ny FROM g GROUP BY ALL)
SELECT p_partkey, round(CASE WHEN x = y THEN 1 WHEN length(x) < 2 OR length(y) < 2 THEN 0 ELSE 2.0 * sum(least(nx, ny)) / sum(nx + ny) END, 6) AS score FROM p LEFT JOIN c USING (p_partkey) GROUP BY p_partkey, x, y""")
def _(s, d):
    return V.table(s, d, "part").select("p_partkey", F.round(S.dice(F.col("p_name"), F.col("p_type")), 6).alias("score"))


@query("SC35_sequence_ratio")
def _(s, d):
    from ..functions.python_udfs import sequence_ratio

    return V.table(s, d, "part").select("p_partkey", F.round(sequence_ratio("p_name", "p_type"), 6).alias("ratio"))


@query("SC36_levenshtein", "SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE, 6) AS score FROM part")
def _(s, d):
    return V.table(s, d, "part").select("p_partkey", F.round(S.levenshtein_ratio(F.col("p_name"), F.col("p_type")), 6).alias("score"))


CODE = "regexp_extract_all(regexp_replace(lower({}), '(//[^\\n]*|/\\*[\\s\\S]*?\\*/)', '', 'g'), '([a-z_$][a-z0-9_$]*|\\S)', 1)"
CODE_PAIRS = f"(SELECT p_partkey, {CODE.format('p_name')} AS xt, {CODE.format('p_name || p_brand || p_type')} AS yt FROM part)"


def code_pairs(s, d):
    return V.table(s, d, "part").select("p_partkey", S.code_tokens(F.col("p_name")).alias("x"), S.code_tokens(F.concat("p_name", "p_brand", "p_type")).alias("y"))


COSINE = f"""WITH p AS {CODE_PAIRS}, xc AS (SELECT p_partkey, w, count(*) AS n FROM (SELECT p_partkey, unnest(xt) AS w FROM p) GROUP BY ALL), yc AS (SELECT p_partkey, w, count(*) AS n FROM (SELECT p_partkey, unnest(yt) AS w FROM p) GROUP BY ALL),
d AS (SELECT p_partkey, sum(x.n * y.n) AS d FROM xc x JOIN yc y USING (p_partkey, w) GROUP BY 1), a AS (SELECT p_partkey, sqrt(sum(n * n)) AS a FROM xc GROUP BY 1), b AS (SELECT p_partkey, sqrt(sum(n * n)) AS b FROM yc GROUP BY 1)"""


@query("SC37_count_cosine", COSINE + " SELECT p_partkey, round((coalesce(d / (a * b), 0) + 1) / 2, 6) AS score FROM p LEFT JOIN d USING (p_partkey) LEFT JOIN a USING (p_partkey) LEFT JOIN b USING (p_partkey)")
def _(s, d):
    return code_pairs(s, d).select("p_partkey", F.round(S.count_cosine(F.col("x"), F.col("y")), 6).alias("score"))


@query("SC38_combined", COSINE + """, j AS (SELECT p_partkey, len(list_intersect(xt, yt)) AS c, len(list_distinct(list_concat(xt, yt))) AS u FROM p)
SELECT p_partkey, round(0.4::DOUBLE * (1 - levenshtein(p_name, p_name || p_brand || p_type) / length(p_name || p_brand || p_type)::DOUBLE) + 0.3::DOUBLE * c / u + 0.3::DOUBLE * (coalesce(d / (a * b), 0) + 1) / 2, 6) AS score
FROM part LEFT JOIN d USING (p_partkey) LEFT JOIN a USING (p_partkey) LEFT JOIN b USING (p_partkey) JOIN j USING (p_partkey)""")
def _(s, d):
    return V.table(s, d, "part").select("p_partkey", F.round(S.combined(F.col("p_name"), F.concat("p_name", "p_brand", "p_type")), 6).alias("score"))


@query("SC39_code_tokens", f"SELECT p_partkey, array_to_string(xt, ' ') AS tokens, len(yt) AS n FROM {CODE_PAIRS}")
def _(s, d):
    return code_pairs(s, d).select("p_partkey", F.array_join("x", " ").alias("tokens"), F.size("y").alias("n"))


@query("U10_token_jaccard", f"SELECT p_partkey, round(len(list_intersect(xt, yt))::DOUBLE / len(list_distinct(list_concat(xt, yt))), 6) AS score FROM {CODE_PAIRS}")
def _(s, d):
    return code_pairs(s, d).select("p_partkey", F.round(S.jaccard(F.col("x"), F.col("y")), 6).alias("score"))


@query("U08_token_overlap", f"SELECT p_partkey, len(list_intersect(list_distinct(xt), list_distinct(yt))) AS common FROM {CODE_PAIRS}")
def _(s, d):
    return code_pairs(s, d).select("p_partkey", F.size(F.array_intersect("x", "y")).alias("common"))


@query("SC41_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(s, d):
    e = V.table(s, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("SC42_masked_mean", """WITH e AS (SELECT vec_id // 10 AS g, vec_id % 3 <> 0 AS m, embedding FROM embeddings), u AS (SELECT g, m, unnest(range(64)) AS i, unnest(embedding) AS v FROM e), a AS (SELECT g, i, sum(v::DOUBLE) FILTER (WHERE m) / greatest(count(*) FILTER (WHERE m), 1) AS x FROM u GROUP BY ALL)
SELECT g AS batch, round(sum(x), 5) AS total, round(max(x), 5) AS top FROM a GROUP BY g""")
def _(s, d):
    from ..operators.aggregates import pooled

    e = V.table(s, d, "embeddings").select(F.expr("vec_id DIV 10").alias("batch"), (F.col("vec_id") % 3 != 0).alias("m"), "embedding")
    return pooled(e, ["batch"], "embedding", "m").groupBy("batch").agg(F.round(F.sum("mean"), 5).alias("total"), F.round(F.max("mean"), 5).alias("top"))


GROUPS = "(SELECT l_orderkey AS g, l_linenumber AS k, l_quantity / 50.0 / 0.07 AS s, l_linenumber = 1 AS pos FROM lineitem)"


@query("SC43_contrastive_loss", f"WITH m AS (SELECT g, max(s) AS m, max(CASE WHEN pos THEN s END) AS p FROM {GROUPS} GROUP BY g) SELECT m.g, round(ln(sum(exp(s - m))) + m.m - m.p, 6) AS loss FROM {GROUPS} x JOIN m ON x.g = m.g WHERE m.p IS NOT NULL GROUP BY m.g, m.m, m.p")
def _(s, d):
    from ..operators.ranking import contrastive_loss

    t = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_quantity") / 50.0).alias("s"), (F.col("l_linenumber") == 1).alias("pos"))
    return contrastive_loss(t, "g", "s", "pos").select("g", F.round("loss", 6).alias("loss"))


@query("SC44_left_padding", "WITH t AS (SELECT conv_id, turn, length(text) % 9 + 1 AS n, max(length(text) % 9 + 1) OVER (PARTITION BY conv_id) AS w FROM conversations) SELECT conv_id, turn, w::INT AS width, (w - n)::INT AS padding, (w - n) * 0 + n AS kept FROM t")
def _(s, d):
    from pyspark.sql import Window

    n = (F.length("text") % 9 + 1).cast("int")
    t = V.table(s, d, "conversations").select("conv_id", "turn", F.sequence(F.lit(1), n).alias("ids"), F.max(n).over(Window.partitionBy("conv_id")).alias("width"))
    p = t.select("conv_id", "turn", "width", S.pad_left(F.col("ids"), F.col("width"), F.lit(0)).alias("p"))
    return p.select("conv_id", "turn", "width", F.size(F.filter("p", lambda x: x == 0)).alias("padding"), F.array_max("p").cast("long").alias("kept"))


@query("SC45_pad_candidates", "WITH t AS (SELECT l_orderkey AS id, l_quantity > 25 AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity > 25) AS k FROM lineitem) SELECT id, count(*) AS candidates, greatest(7, count(*)) AS width, coalesce(min(CASE WHEN p THEN k END), 0) - 1 AS positive FROM t GROUP BY id")
def _(s, d):
    from ..operators.ranking import padded_candidates

    t = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), (F.col("l_quantity") > 25).alias("positive"), F.col("l_partkey").alias("value"))
    return padded_candidates(t, "id", "k", "value", "positive", 7).select("id", "candidates", F.size("padded").alias("width"), "positive")
