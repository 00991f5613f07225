"""Queries over text, hash and filter expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as X
from . import views as V
from .registry import query

A = V.ANNOTATIONS.sql
STRICT = r"""CASE WHEN regexp_full_match(split_part(file, '/', 2) || '/' || split_part(file, '/', 3), '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') THEN split_part(file, '/', 2) || '/' || split_part(file, '/', 3) END"""


def sha_int(e: str, digits: int = 16, f: str = "sha1") -> str:
    return f"CAST('0x' || substr({f}({e}), 1, {digits}) AS UBIGINT)"


@query("SC01_stable_number", f"SELECT DISTINCT file, CAST({sha_int(chr(39) + '13:' + chr(39) + ' || file')} % 10000 AS BIGINT) AS bucket, CAST({sha_int(chr(39) + '13:' + chr(39) + ' || file')} AS VARCHAR) AS number FROM {A}")
def _(s, d):
    n = H.stable_number(F.col("file"), 13)
    return V.ANNOTATIONS(s, d).select("file").distinct().select("file", (n % 10000).cast("long").alias("bucket"), n.cast("string").alias("number"))


@query("SC02_deterministic_split", f"WITH p AS (SELECT DISTINCT source FROM documents), q AS (SELECT source, CAST({sha_int('source', 8)} AS BIGINT) / 4294967295.0::DOUBLE AS x FROM p) SELECT source, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.7::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM q")
def _(s, d):
    return V.table(s, d, "documents").select("source").distinct().select("source", H.deterministic_split(F.col("source")).alias("split"))


@query("SC03_stable_split", f"WITH p AS (SELECT DISTINCT file FROM {A}), q AS (SELECT file, {sha_int('file', 16, 'sha256')}::DOUBLE / 18446744073709551616.0::DOUBLE AS x FROM p) SELECT file, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.7::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM q")
def _(s, d):
    return V.ANNOTATIONS(s, d).select("file").distinct().select("file", H.stable_split(F.col("file")).alias("split"))


@query("SC05_shard_membership", f"SELECT DISTINCT project FROM (SELECT {STRICT} AS project FROM {A}) WHERE {sha_int(chr(39) + '17:' + chr(39) + ' || project')} % 10 = 3")
def _(s, d):
    p = V.ANNOTATIONS(s, d).select(X.strict_project(F.col("file")).alias("project")).distinct()
    return p.where(H.in_shard(F.col("project"), 13, 10, 3))


@query("SC06_physical_partitions", """WITH s AS (SELECT DISTINCT doc_id % 10 AS i FROM documents) SELECT i AS shard, i + 10 * k AS residue, 10 * n AS modulus FROM (SELECT i, CASE i WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS n FROM s), range(3) t(k) WHERE k < n AND i <> 9
UNION ALL SELECT 9, * FROM (VALUES (9, 30), (19, 30), (29, 90), (59, 90), (89, 90)) WHERE 9 IN (SELECT i FROM s)""")
def _(s, d):
    shards = V.table(s, d, "documents").select(F.expr("doc_id % 10").alias("shard")).distinct()
    return shards.select("shard", F.explode(H.physical_parts(F.col("shard"))).alias("p")).select("shard", F.col("p.residue").cast("long").alias("residue"), F.col("p.modulus").cast("long").alias("modulus"))


BUILTIN = "CASE WHEN lower(trim(cat)) IN ('builtin', 'builtins') THEN TRUE WHEN starts_with(lower(trim(origttype)), 'builtins.') THEN TRUE WHEN trim(cat) <> '' OR trim(origttype) <> '' THEN FALSE ELSE lower(regexp_extract(replace(trim(gttype), 'typing.', ''), '^[^\\[<|, .]*')) IN (" + ", ".join(f"'{x}'" for x in X.BUILTIN_TYPES) + ") END"


def _builtin():
    return X.is_builtin(F.col("cat"), F.col("origttype"), F.col("gttype"), F.lit(""))


@query("F01_eligibility", f"SELECT CASE WHEN lower(trim(scope)) <> 'arg' THEN 'non_parameter' WHEN {BUILTIN} THEN 'builtin' WHEN trim(gttype) = '' THEN 'missing_ground_truth' ELSE 'eligible' END AS reason, count(*) AS n FROM {A} GROUP BY 1")
def _(s, d):
    return V.ANNOTATIONS(s, d).groupBy(X.rejection(F.col("scope"), _builtin(), F.col("gttype")).alias("reason")).agg(F.count("*").alias("n"))


@query("F02_builtin_test", f"SELECT cat, origttype, gttype, {BUILTIN} AS builtin, count(*) AS n FROM {A} GROUP BY ALL")
def _(s, d):
    return V.ANNOTATIONS(s, d).groupBy("cat", "origttype", "gttype", _builtin().alias("builtin")).agg(F.count("*").alias("n"))


@query("F03_exporter_filters", f"SELECT pos, name, scope FROM {A} WHERE lower(scope) IN ('arg', 'return') AND NOT ({BUILTIN}) ORDER BY pos LIMIT 500")
def _(s, d):
    return V.ANNOTATIONS(s, d).where(F.lower("scope").isin("arg", "return") & ~_builtin()).select("pos", "name", "scope").orderBy("pos").limit(500)


@query("F04_skip_pattern", f"SELECT p.project, CASE WHEN contains(lower(p.project), 'repo1') THEN 'Repo1' WHEN contains(lower(p.project), 'own3') THEN 'OWN3' END AS pattern, count(*) AS n FROM (SELECT {STRICT} AS project FROM {A}) p GROUP BY ALL")
def _(s, d):
    p = V.ANNOTATIONS(s, d).select(X.strict_project(F.col("file")).alias("project"))
    return p.groupBy("project", X.first_pattern(F.col("project"), ["Repo1", " ", "OWN3"]).alias("pattern")).agg(F.count("*").alias("n"))


@query("F05_timeout_allow_list", "SELECT source, CASE WHEN source IN ('src0', 'src3') THEN 120 ELSE 0 END AS seconds, 120 AS seconds_for_all, count(*) AS n FROM documents GROUP BY ALL")
def _(s, d):
    from ..operators.filters import timeout_for

    t = V.table(s, d, "documents")
    return t.groupBy("source", timeout_for(F.col("source"), 120, ["src0", "src3"]).alias("seconds"), timeout_for(F.col("source"), 120, []).alias("seconds_for_all")).agg(F.count("*").alias("n"))


@query("F06_project_keys", f"""WITH u AS (SELECT page_id, url, rtrim(url, '/') AS r FROM pages), p AS (SELECT page_id, r, list_filter(string_split(r, '/'), lambda x: x <> '') AS a, string_split(r, '/') AS b FROM u)
SELECT page_id, array_to_string(a[-2:], '/') AS url_project, CASE WHEN len(b) >= 2 THEN array_to_string(b[-2:], '/') ELSE r END AS loose_project FROM p""")
def _(s, d):
    none = F.lit(None).cast("string")
    return V.table(s, d, "pages").select("page_id", X.url_project(F.col("url"), none).alias("url_project"), X.loose_project(F.col("url"), none).alias("loose_project"))


@query("F06_project_from_file", f"SELECT {STRICT} AS strict, split_part(file, '/', 2) || '/' || split_part(file, '/', 3) AS by_file, count(*) AS n FROM {A} GROUP BY ALL")
def _(s, d):
    none = F.lit(None).cast("string")
    return V.ANNOTATIONS(s, d).groupBy(X.strict_project(F.col("file")).alias("strict"), X.url_project(none, F.col("file")).alias("by_file")).agg(F.count("*").alias("n"))


@query("F07_slice_field", "SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 0 AND text <> '' THEN text WHEN role <> '' THEN role ELSE '' END) AS slice FROM conversations")
def _(s, d):
    c = V.table(s, d, "conversations")
    return c.select("conv_id", "turn", F.trim(X.truthy(F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(""), F.lit(None).cast("string"), F.col("role"))).alias("slice"))


@query("F08_row_key", f"SELECT file || '--' || loc || '--' || name || '--' || scope AS key, count(*) AS n FROM {A} GROUP BY 1")
def _(s, d):
    return V.ANNOTATIONS(s, d).groupBy(X.sample_key(*map(F.col, ("file", "loc", "name", "scope"))).alias("key")).agg(F.count("*").alias("n"))


@query("F09_canonical_name", f"SELECT gttype, lower(split_part(regexp_replace(replace(gttype, 'typing.', ''), '\\s+', '', 'g'), '.', -1)) AS canonical, count(*) AS n FROM {A} GROUP BY ALL")
def _(s, d):
    return V.ANNOTATIONS(s, d).groupBy("gttype", X.canonical_type_name(F.col("gttype")).alias("canonical")).agg(F.count("*").alias("n"))


@query("F10_target_function_scope", f"SELECT split_part(loc, '@', 1) AS fn, CASE lower(scope) WHEN 'parameter' THEN 'arg' WHEN 'param' THEN 'arg' WHEN 'argument' THEN 'arg' ELSE lower(scope) END AS scope, count(*) AS n FROM {A} GROUP BY ALL")
def _(s, d):
    return V.ANNOTATIONS(s, d).groupBy(X.target_function(F.lit(""), F.col("loc")).alias("fn"), X.target_scope(F.col("scope")).alias("scope")).agg(F.count("*").alias("n"))


@query("F11_location", f"SELECT split_part(loc, '@', 1) AS fn, CAST(split_part(loc, '@', 2) AS INTEGER) AS line, count(*) AS n FROM {A} GROUP BY ALL")
def _(s, d):
    name, line = X.location(F.col("loc"))
    return V.ANNOTATIONS(s, d).groupBy(name.alias("fn"), line.alias("line")).agg(F.count("*").alias("n"))


@query("F15_source_split", f"WITH q AS (SELECT doc_id, lang, CAST({sha_int('source', 8)} AS BIGINT) / 4294967295.0::DOUBLE AS x, CASE lang WHEN 'en' THEN 'Val' WHEN 'de' THEN 'train' ELSE '' END AS told FROM documents) SELECT doc_id, CASE WHEN told = 'Val' THEN 'validation' WHEN told = 'train' THEN 'train' WHEN x < 0.7 THEN 'train' WHEN x < 0.7::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM q")
def _(s, d):
    told = F.when(F.col("lang") == "en", "Val").when(F.col("lang") == "de", "train").otherwise("")
    return V.table(s, d, "documents").select("doc_id", H.source_split(told, F.col("source")).alias("split"))


@query("F17_useful_slice", "SELECT p_partkey, length(p_brand) >= 10 AS by_length, length(p_name) >= 6 OR regexp_matches(p_name, '[=:(><]') AS useful FROM part")
def _(s, d):
    return V.table(s, d, "part").select("p_partkey", (F.length("p_brand") >= 10).alias("by_length"), X.useful_slice(F.col("p_name")).alias("useful"))


@query("F18_exclude_enum", "SELECT doc_id FROM documents WHERE NOT contains(text, 'enum')")
def _(s, d):
    return V.table(s, d, "documents").where(~F.col("text").contains("enum")).select("doc_id")


@query("F19_payload_paths", r"""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'raw_slices/a/' || page_id || '.jsonl' WHEN 1 THEN 'project_kb/x/knowledge_base.json' WHEN 2 THEN 'project_kb/x/other.json' WHEN 3 THEN 'metadata/m.json' WHEN 4 THEN 'shard_manifest.json' ELSE 'raw_slices/a.json' END AS path FROM pages)
SELECT page_id, path, regexp_full_match(path, '(raw_slices/.*\.jsonl|project_status/.*\.json|project_kb/(.*/)?knowledge_base\.json|metadata/.*\.json|runtime_manifest\.json|shard_manifest\.json)') AS included FROM p""")
def _(s, d):
    from ..operators.filters import payload_path

    k, i = F.col("page_id") % 6, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("raw_slices/a/"), i, F.lit(".jsonl"))).when(k == 1, "project_kb/x/knowledge_base.json").when(k == 2, "project_kb/x/other.json").when(k == 3, "metadata/m.json").when(k == 4, "shard_manifest.json").otherwise("raw_slices/a.json")
    return V.table(s, d, "pages").select("page_id", path.alias("path")).withColumn("included", payload_path(F.col("path")))


@query("F20_dataset_id_valid", "SELECT s_suppkey, regexp_full_match(split_part(x, '/', 1), '[A-Za-z0-9][A-Za-z0-9_-]{1,49}') AND regexp_full_match(split_part(x, '/', 2), '[a-z0-9][a-z0-9-]{2,49}') AND length(x) - length(replace(x, '/', '')) = 1 AS valid FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'owner/slug-' || s_suppkey WHEN 2 THEN 'o/Slug' ELSE 'own_er/a' || s_suppkey || '/b' END AS x FROM supplier)")
def _(s, d):
    from ..operators.filters import valid_dataset_id

    k, i = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    x = F.when(k == 0, F.col("s_name")).when(k == 1, F.concat(F.lit("owner/slug-"), i)).when(k == 2, "o/Slug").otherwise(F.concat(F.lit("own_er/a"), i, F.lit("/b")))
    return V.table(s, d, "supplier").select("s_suppkey", valid_dataset_id(x).alias("valid"))


@query("F22_type_shaped", f"SELECT gttype, coalesce(regexp_full_match(split_part(trim(gttype, ' ''\"'), '.', -1), '[A-Z][A-Za-z0-9_]*'), FALSE) OR split_part(gttype, '.', -1) IN ('datetime', 'date', 'time', 'socket') AS shaped, count(*) AS n FROM {A} GROUP BY ALL")
def _(s, d):
    return V.ANNOTATIONS(s, d).groupBy("gttype", X.type_shaped(F.col("gttype")).alias("shaped")).agg(F.count("*").alias("n"))


@query("F23_skip_primitives", f"SELECT gttype, count(*) AS n FROM {A} WHERE NOT (starts_with(gttype, 'string') OR starts_with(gttype, 'number') OR starts_with(gttype, 'str')) GROUP BY 1")
def _(s, d):
    t = F.col("gttype")
    return V.ANNOTATIONS(s, d).where(~(t.startswith("string") | t.startswith("number") | t.startswith("str"))).groupBy("gttype").agg(F.count("*").alias("n"))


@query("SC11_declared_name", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Klass' || doc_id WHEN regexp_full_match(split_part(trim(text), chr(10), 1), '[A-Za-z_$][A-Za-z0-9_$.<>\\[\\], |?]*') THEN split_part(trim(text), chr(10), 1) ELSE '' END AS declared FROM documents")
def _(s, d):
    t = V.table(s, d, "documents")
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x = 1\n  export abstract class Klass"), F.col("doc_id"), F.lit(" {"), F.col("text"), F.lit("}"))).otherwise(F.col("text"))
    return t.select("doc_id", X.declared_name(body).alias("declared"))


@query("SC12_between_markers", "SELECT doc_id, text || ' ' AS section FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, '' FROM documents WHERE doc_id % 3 = 0")
def _(s, d):
    t = V.table(s, d, "documents")
    start = F.when(F.col("doc_id") % 3 == 1, X.PROMPT_STARTS[0]).when(F.col("doc_id") % 3 == 2, X.PROMPT_STARTS[1]).otherwise("")
    end = F.when(F.col("doc_id") % 2 == 0, F.lit(" " + X.PROMPT_END + " rest")).otherwise(" ")
    return t.select("doc_id", X.between_markers(F.concat(F.lit("head "), start, F.col("text"), end)).alias("section"))


@query("SC13_definition_fields", "SELECT p_partkey, 'C' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'm' || p_size || '.' ELSE '' END || 'C' || p_partkey AS qualified_name, CASE WHEN p_partkey % 3 = 0 THEN 'pk' ELSE '' END AS package, CASE WHEN p_partkey % 3 = 0 THEN 'third_party' ELSE 'project' END AS source, CASE WHEN p_partkey % 5 = 0 THEN 'alias' ELSE 'class' END AS kind FROM part")
def _(s, d):
    k = F.col("p_partkey")
    lines = [
        F.concat(F.lit("class C"), k, F.lit("(Base):\n")),
        F.when(k % 2 == 0, F.concat(F.lit("  # module: m"), F.col("p_size"), F.lit("\n"))).otherwise(""),
        F.when(k % 3 == 0, "# package: pk\n").otherwise(""),
        F.when(k % 5 == 0, "# kind: alias\n").otherwise(""),
    ]
    t = V.table(s, d, "part").select("p_partkey", F.concat(*lines).alias("definition"))
    return t.select("p_partkey", *[c.alias(n) for n, c in X.definition_fields(F.col("definition")).items()])


@query("SC14_query_text", "SELECT doc_id, md5('[LANGUAGE] ' || lang || chr(10) || '[TARGET_KIND] arg' || chr(10) || '[TARGET_NAME] ' || source || chr(10) || '[INTERPROCEDURAL_SLICE]' || chr(10) || text) AS h FROM documents")
def _(s, d):
    return V.table(s, d, "documents").select("doc_id", F.md5(X.query_text(F.col("lang"), F.lit("arg"), F.col("source"), F.col("text"))).alias("h"))


@query("SC15_candidate_text", "SELECT item_id, md5('[RECOMMENDATION_TYPE]' || chr(10) || '[TYPE_NAME] n' || item_id || chr(10) || '[TYPE_DEFINITION]' || chr(10) || CASE WHEN item_id % 2 = 0 THEN 'n' || item_id ELSE text END) AS h FROM benchmark")
def _(s, d):
    name = F.concat(F.lit("n"), F.col("item_id"))
    return V.table(s, d, "benchmark").select("item_id", F.md5(X.candidate_text(name, F.when(F.col("item_id") % 2 == 1, F.col("text")))).alias("h"))


@query("SC16_generative_input", "SELECT doc_id, md5('[TARGET_NAME] ' || source || chr(10) || '[TARGET_FUNCTION] f' || chr(10) || '[TARGET_SCOPE] arg' || chr(10) || '[INTERPROCEDURAL_SLICE]' || chr(10) || text || chr(10) || '[RECOMMENDATION_TYPES]' || chr(10) || '[TYPE] ' || lang || chr(10) || '[DEFINITION]' || chr(10) || 'd1' || chr(10) || '[TYPE] B' || chr(10) || '[DEFINITION]' || chr(10) || source) AS h FROM documents")
def _(s, d):
    pair = F.array(F.struct(F.col("lang").alias("type"), F.lit("d1").alias("definition")), F.struct(F.lit("B").alias("type"), F.col("source").alias("definition")))
    return V.table(s, d, "documents").select("doc_id", F.md5(X.generative_input(F.col("source"), F.lit("f"), F.lit("arg"), F.col("text"), pair)).alias("h"))


@query("SC17_chat_messages", "SELECT doc_id, CASE WHEN lang = 'en' THEN 3 ELSE 2 END AS n, 'system|user' || CASE WHEN lang = 'en' THEN '|assistant' ELSE '' END AS roles FROM documents")
def _(s, d):
    m = X.chat(F.lit("You name types."), F.col("text"), F.when(F.col("lang") == "en", F.col("source")))
    return V.table(s, d, "documents").select("doc_id", m.alias("m")).select("doc_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), "|").alias("roles"))


@query("SC18_fix_generated_type", f"""SELECT gttype, CASE gttype WHEN 'typing.List[int]' THEN 'typing.List[int]' WHEN 'str | None' THEN 'typing.Union[str, None]' WHEN 'list[a.B]' THEN 'list[Union[Any, a.B]]' WHEN 'tuple[int]' THEN 'tuple[Union[Any, int]]' WHEN 'Dict[str, any]' THEN 'dict[union[any, str], any]' WHEN '{{a: string}}' THEN 'dict' WHEN '  ' THEN '' ELSE gttype END AS fixed, count(*) AS n FROM {A} GROUP BY ALL""")
def _(s, d):
    return V.ANNOTATIONS(s, d).groupBy("gttype", X.fix_generated_type(F.col("gttype")).alias("fixed")).agg(F.count("*").alias("n"))


@query("SC20_fix_answer", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'object' WHEN 2 THEN p_brand WHEN 3 THEN 'MutableRefObject' || p_size ELSE p_type END AS fixed FROM part")
def _(s, d):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, '"a" | "b"').when(k == 1, "mask: any").when(k == 2, F.concat(F.lit("("), F.col("p_brand"), F.lit(")"))).when(k == 3, F.concat(F.lit("<mask>RefObject"), F.col("p_size"))).otherwise(F.col("p_type"))
    return V.table(s, d, "part").select("p_partkey", X.fix_answer(raw).alias("fixed"))


@query("SC21_quoted_union", "SELECT p_partkey, p_partkey % 3 = 0 AS quoted FROM part")
def _(s, d):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, '"a"|"b c" | "d"').when(k == 1, '"x"|y|"z"').otherwise("plain")
    return V.table(s, d, "part").select("p_partkey", X.quoted_union(raw).alias("quoted"))


@query("SC22_type_cleaning", """SELECT p_partkey, 'Foo' || p_size AS no_import, replace(replace(p_name, '"', ''), '''', '') AS no_quotes, p_type AS after FROM part""")
def _(s, d):
    return V.table(s, d, "part").select(
        "p_partkey",
        X.without_imports(F.concat(F.lit('import("a/b").Foo'), F.col("p_size"))).alias("no_import"),
        X.without_quotes(F.concat(F.lit("'"), F.col("p_name"), F.lit('"'))).alias("no_quotes"),
        X.after_equals(F.concat(F.col("p_brand"), F.lit(" = "), F.col("p_type"), F.lit(" "))).alias("after"),
    )


@query("SC23_window_around", """WITH t AS (SELECT doc_id, text, length(text) AS n, least(greatest(0, n_chars // 2), length(text)) AS i FROM documents), w AS (SELECT *, greatest(0, i - 150) AS a, least(n, i + 151) AS b FROM t)
SELECT doc_id, md5(CASE WHEN a > 0 THEN '...' ELSE '' END || substr(text, a + 1, i - a)) AS before, md5(substr(text, i + 1, b - i) || CASE WHEN b < n THEN '...' ELSE '' END) AS after FROM w""")
def _(s, d):
    before, after = X.window_around(F.col("text"), F.expr("CAST(n_chars DIV 2 AS INT)"))
    return V.table(s, d, "documents").select("doc_id", F.md5(before).alias("before"), F.md5(after).alias("after"))


@query("SC24_file_name", r"SELECT page_id, coalesce(list_filter(string_split(regexp_extract(url, '^[^?#]*'), '/'), lambda x: x <> '')[-1], '') AS name FROM pages")
def _(s, d):
    return V.table(s, d, "pages").select("page_id", X.file_name(F.col("url")).alias("name"))


@query("SC24_same_path", "SELECT s_suppkey, s_suppkey % 2 = 0 AS same, TRUE AS same_any_case FROM supplier")
def _(s, d):
    i = F.col("s_suppkey").cast("string")
    a, b = F.concat(F.lit("/a/./b//"), i), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "/a/b/c/../").otherwise("/A/b/"), i, F.lit("/"))
    return V.table(s, d, "supplier").select("s_suppkey", X.same_path(a, b).alias("same"), X.same_path(a, b, False).alias("same_any_case"))


@query("SC26_replace_quoted", "SELECT p_partkey, '''new'' old \"new\" ''old\"' || p_size AS quoted, 'a = ' || p_size || chr(10) || 'x: <mask> = 1' AS statement FROM part")
def _(s, d):
    t = V.table(s, d, "part")
    code = F.concat(F.lit("a = "), F.col("p_size"), F.when(F.col("p_size") % 2 == 0, "\nx = 1").otherwise("\nx = '1'"))
    original = F.when(F.col("p_size") % 2 == 0, "zz").otherwise('x = "1"')
    return t.select("p_partkey", X.replace_quoted(F.concat(F.lit("'old' old \"old\" 'old\""), F.col("p_size")), "old", "new").alias("quoted"), X.replace_statement(code, original, F.lit("x: <mask> = 1"), F.lit("x")).alias("statement"))


@query("SC27_mask", "SELECT doc_id, md5(replace('mask unmasked ' || text, 'mask', '<mask>')) AS h FROM documents")
def _(s, d):
    return V.table(s, d, "documents").select("doc_id", F.md5(X.masked(F.concat(F.lit("mask unmasked "), F.col("text")))).alias("h"))


@query("SC28_module_name", f"SELECT DISTINCT file, replace(regexp_replace(file, '\\.py$', ''), '/', '.') AS module, 'pkg' AS package FROM {A}")
def _(s, d):
    return V.ANNOTATIONS(s, d).select("file").distinct().select("file", X.module_name(F.col("file")).alias("module"), X.module_name(F.lit("src/pkg/__init__.py")).alias("package"))


@query("F21_row_contract", "SELECT lang, min_by(doc_id, doc_id) FILTER (WHERE NOT (contains(text, 'the') AND n_chars BETWEEN 1 AND 5000)) AS first_bad, min_by(CASE WHEN n_chars NOT BETWEEN 1 AND 5000 THEN 'length' ELSE 'tag' END, doc_id) FILTER (WHERE NOT (contains(text, 'the') AND n_chars BETWEEN 1 AND 5000)) AS error FROM documents GROUP BY lang")
def _(s, d):
    from ..operators.checks import first_error

    rules = [("length", F.col("n_chars").between(1, 5000)), ("tag", F.col("text").contains("the"))]
    return first_error(V.table(s, d, "documents"), "lang", "doc_id", rules)


@query("SC10_split_declarations", "SELECT doc_id, 'A' || doc_id AS name, length(regexp_replace('class A' || doc_id || ': ' || text, '\\s+$', '')) AS size FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'B', 21 FROM documents WHERE text IS NOT NULL")
def _(s, d):
    from ..functions.python_udfs import split_declarations

    t = V.table(s, d, "documents").select("doc_id", F.concat(F.lit("class A"), F.col("doc_id"), F.lit(": "), F.col("text"), F.lit("\nexport interface B {}")).alias("section"))
    return t.select("doc_id", F.explode(split_declarations("section")).alias("x")).select("doc_id", "x.name", F.length("x.definition").alias("size"))


@query("F12_normalize_recommendations")
def _(s, d):
    from ..functions.python_udfs import normalize_recommendations

    raw = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array(F.struct(F.col("lang").alias("name"), F.col("text").alias("definition")), F.struct(F.lit("B").alias("name"), F.lit("d").alias("definition"))))).when(F.col("doc_id") % 3 == 1, F.to_json(F.array(F.lit("class A: pass"), F.col("source")))).otherwise(F.lit(None).cast("string"))
    prompt = F.concat(F.lit(X.PROMPT_STARTS[0]), F.lit("\nclass P: x\n"), F.lit(X.PROMPT_END))
    t = V.table(s, d, "documents").select("doc_id", raw.alias("raw"), prompt.alias("prompt"))
    return t.select("doc_id", F.explode(normalize_recommendations("raw", "prompt")).alias("x")).select("doc_id", "x.name", "x.qualified_name", F.length("x.definition").alias("size"))


@query("SC25_context_windows", "WITH p AS (SELECT doc_id, text, string_split(text, 'ou') AS parts FROM documents), i AS (SELECT doc_id, text, parts, unnest(range(1, len(parts))) AS i FROM p), a AS (SELECT doc_id, text, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + 2 * (i - 1) AS INT) AS place FROM i) SELECT doc_id, place AS \"at\", md5(substr(text, greatest(0, place - 20) + 1, place + 22 - greatest(0, place - 20))) AS h FROM a")
def _(s, d):
    from ..functions.python_udfs import surrounding_matches

    return V.table(s, d, "documents").select("doc_id", F.explode(surrounding_matches("text", F.lit("ou"), F.lit(20))).alias("x")).select("doc_id", "x.at", F.md5("x.context").alias("h"))
