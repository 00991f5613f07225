"""Queries over sources, sinks and steps of the dataset build. Round trips go through the session's shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as X
from ..operators import checks as C
from ..operators import filters as L
from ..operators import sets as U
from ..operators import verification as VER
from ..sources import records as R
from . import views as V
from .q_text import STRICT
from .registry import query

A, KB = V.ANNOTATIONS.sql, V.KB.sql


def folder(s) -> str:
    """A folder of its own that all executors share, deleted when the driver ends; a temporary one only for local masters."""
    root = s.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/spindrift-scratch"
    path = f"{root}/round-trip-{uuid.uuid4().hex}"
    atexit.register(R.remove, s, path)
    return path


def docs(s, d) -> DataFrame:
    return V.table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")


DOCS = "doc_id long, lang string, source string, n_chars long"


@query("S01_read_jsonl", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(s, d):
    R.write_jsonl(docs(s, d), p := folder(s))
    return R.read_jsonl(s, p, DOCS).drop("position")


@query("S04_read_json_list", "SELECT doc_id, n_chars FROM documents")
def _(s, d):
    p = folder(s)
    # a list in each file, as many as there are partitions
    docs(s, d).select("doc_id", "n_chars").groupBy(F.expr("doc_id DIV 1000").alias("g")).agg(F.to_json(F.collect_list(F.struct("doc_id", "n_chars"))).alias("value")).select("value").repartition(4).write.option("lineSep", "\n").text(p)
    lists = s.read.text(p).select(F.explode(F.from_json("value", "array<struct<doc_id: long, n_chars: long>>")).alias("x"))
    return lists.select("x.*")


@query("S06_row_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS \"index\" FROM documents")
def _(s, d):
    return R.with_index(V.table(s, d, "documents").select("doc_id"), "doc_id").select("doc_id", F.col("index").cast("long").alias("index"))


@query("S07_cached_dataset", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    return R.in_memory(docs(s, d), lambda held: held.groupBy("lang").agg(F.count("*").alias("n")))


@query("S08_jsonl_sink", "SELECT conv_id, turn, role, length(text) AS size FROM conversations")
def _(s, d):
    R.write_jsonl(V.table(s, d, "conversations"), p := folder(s))
    return R.read_jsonl(s, p, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.length("text").cast("long").alias("size"))


@query("S09_atomic_publish", "SELECT doc_id, lang FROM documents")
def _(s, d):
    p = folder(s)
    R.publish(docs(s, d).select("doc_id", "lang").limit(1), p)
    R.publish(docs(s, d).select("doc_id", "lang"), p)
    return s.read.parquet(p)


@query("S10_split_partitioned_sink", "SELECT lang AS split, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    R.write_jsonl(docs(s, d).withColumnRenamed("lang", "split"), p := folder(s), ("split",))
    return s.read.schema("doc_id long, source string, n_chars long, split string").json(p).groupBy("split").agg(F.count("*").alias("n"))


@query("S11_project_sink_resume", "SELECT source, count(*) AS n, CAST(sum(CASE WHEN source = 'src1' THEN n_chars + 1 ELSE n_chars END) AS BIGINT) AS chars FROM documents GROUP BY 1")
def _(s, d):
    R.write_jsonl(docs(s, d), p := folder(s), ("source",))
    again = docs(s, d).where("source = 'src1'").withColumn("n_chars", F.col("n_chars") + 1)
    R.write_jsonl(again, p, ("source",), "overwrite")
    return s.read.schema("doc_id long, lang string, n_chars long, source string").json(p).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("S12_append", "SELECT doc_id, 0 AS run FROM documents UNION ALL SELECT doc_id, 1 FROM documents")
def _(s, d):
    p = folder(s)
    for i in (0, 1):
        R.append_rows(docs(s, d).select("doc_id", F.lit(i).alias("run")), p)
    return s.read.schema("doc_id long, run int").json(p)


@query("S13_metrics_csv", "SELECT lang AS cat, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    R.write_metrics(docs(s, d).groupBy(F.col("lang").alias("cat")).agg(F.count("*").alias("n")), p := folder(s))
    return s.read.schema("cat string, n long").option("header", True).csv(p)


PATHS = "(SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'node_modules/x.py' WHEN 2 THEN '.git/y.py' WHEN 3 THEN 'lib/b.ts' ELSE 'src/.hidden.py' END AS path FROM pages)"


def paths(s, d):
    k = F.expr("page_id % 5")
    return V.table(s, d, "pages").select("page_id", F.when(k == 0, "src/a.py").when(k == 1, "node_modules/x.py").when(k == 2, ".git/y.py").when(k == 3, "lib/b.ts").otherwise("src/.hidden.py").alias("path"))


@query("S14_walk_python", f"SELECT page_id, path FROM {PATHS} WHERE path = 'src/a.py'")
def _(s, d):
    return paths(s, d).where(R.wanted(F.col("path"), (".py",), R.SKIPPED))


@query("S15_walk_with_hidden", f"SELECT page_id, path FROM {PATHS} WHERE path LIKE '%.py'")
def _(s, d):
    return paths(s, d).where(R.wanted(F.col("path"), (".py",), [], hidden=True))


@query("S16_walk_typescript", f"SELECT page_id, path FROM {PATHS} WHERE path LIKE '%.ts'")
def _(s, d):
    return paths(s, d).where(R.wanted(F.col("path"), (".ts", ".tsx"), R.SKIPPED))


def kb_files(s, d) -> str:
    kb = V.KB(s, d).select("name", "qualified_name", "package", "module", "kind", F.lit("third_party").alias("source"), "definition")
    R.write_jsonl(kb, p := folder(s), ("package",))
    return p


@query("S18_package_kb", f"SELECT name, module FROM {KB} WHERE package = 'pkg7'")
def _(s, d):
    return R.read_kb(s, kb_files(s, d), ["pkg7"]).select("name", "module")


@query("S19_imported_packages_only", f"SELECT package, count(*) AS n FROM {KB} WHERE package IN (SELECT 'pkg' || (s_suppkey % 30) FROM supplier) GROUP BY 1")
def _(s, d):
    wanted = V.table(s, d, "supplier").select(F.concat(F.lit("pkg"), F.expr("s_suppkey % 30")).alias("package"))
    return R.read_kb(s, kb_files(s, d), wanted).groupBy("package").agg(F.count("*").alias("n"))


@query("S20_modules_and_stdlib", f"SELECT key FROM {KB} WHERE package IN (SELECT 'pkg' || (s_suppkey % 3) FROM supplier) OR package = 'pkg24'")
def _(s, d):
    wanted = V.table(s, d, "supplier").select(F.concat(F.lit("pkg"), F.expr("s_suppkey % 3")).alias("package")).union(s.createDataFrame([("pkg24",)], "package string"))
    return V.KB(s, d).join(wanted.distinct(), "package", "left_semi").select("key")


@query("S21_validated_reader", f"SELECT count(*) AS n, count(name) AS named FROM {KB}")
def _(s, d):
    return R.read_kb(s, kb_files(s, d), strict=True).agg(F.count("*").alias("n"), F.count("name").alias("named"))


@query("S22_merge_package_files", f"SELECT package, count(*) AS n FROM {KB} GROUP BY 1")
def _(s, d):
    return R.read_kb(s, kb_files(s, d)).groupBy("package").agg(F.count("*").alias("n"))


@query("S23_preview", "SELECT substr('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}', 1, 12) || '...' AS json FROM documents ORDER BY doc_id LIMIT 5")
def _(s, d):
    return R.preview(docs(s, d).select("doc_id", "lang").orderBy("doc_id"), 5, 12)


@query("S24_count_lines", "SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> ''")
def _(s, d):
    p = folder(s)
    V.table(s, d, "documents").select("text").write.text(p)
    return s.range(1).select(F.lit(R.count_lines(s, p)).alias("n"))


@query("S25_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(s, d):
    return V.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


COLLIDE = "(SELECT s_suppkey AS i, CASE s_suppkey % 4 WHEN 0 THEN 'A/b' || (s_suppkey % 8) WHEN 1 THEN 'a/B' || ((s_suppkey - 1) % 8) WHEN 2 THEN 'd' || s_suppkey ELSE 'd' || (s_suppkey - 1) || '/f' END AS path FROM supplier)"


@query("S29_path_collisions", f"SELECT lower(path) AS p, 'case' AS fault FROM {COLLIDE} GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT lower(x.path), 'folder' FROM {COLLIDE} x WHERE EXISTS (SELECT 1 FROM {COLLIDE} y WHERE starts_with(lower(y.path), lower(x.path) || '/'))")
def _(s, d):
    i = F.col("s_suppkey")
    path = F.when(i % 4 == 0, F.concat(F.lit("A/b"), i % 8)).when(i % 4 == 1, F.concat(F.lit("a/B"), (i - 1) % 8)).when(i % 4 == 2, F.concat(F.lit("d"), i)).otherwise(F.concat(F.lit("d"), i - 1, F.lit("/f")))
    return C.path_collisions(V.table(s, d, "supplier").select(path.alias("path")), "path")


@query("S30_safe_members", f"SELECT i, path FROM {COLLIDE} WHERE NOT contains(path, '..') AND path NOT LIKE '/%' AND lower(path) IN (SELECT lower(path) FROM {COLLIDE} GROUP BY 1 HAVING count(*) = 1)")
def _(s, d):
    from ..operators.checks import safe_members

    i = F.col("s_suppkey")
    path = F.when(i % 4 == 0, F.concat(F.lit("A/b"), i % 8)).when(i % 4 == 1, F.concat(F.lit("a/B"), (i - 1) % 8)).when(i % 4 == 2, F.concat(F.lit("d"), i)).otherwise(F.concat(F.lit("d"), i - 1, F.lit("/f")))
    return safe_members(V.table(s, d, "supplier").select(i.alias("i"), path.alias("path")), "path")


@query("F13_cap_recommendations", "SELECT source, count(*) AS n, string_agg(text, '|' ORDER BY doc_id) AS texts FROM (SELECT source, lang AS text, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    t = V.table(s, d, "documents").groupBy("source", F.lower("lang").alias("key")).agg(F.min(F.struct("doc_id", "lang")).alias("b"))
    kept = U.first_n(t.select("source", "b.doc_id", "b.lang"), ["source"], ["doc_id"], 10)
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "lang"))), lambda x: x["lang"]), "|").alias("texts"))


@query("F14_completeness", f"SELECT count(*) AS input, count(*) FILTER (WHERE trim(name) = '' OR trim(gttype) = '' OR line > 50) AS dropped FROM {A}")
def _(s, d):
    bad = (F.trim("name") == "") | (F.trim("gttype") == "") | (F.col("line") > 50)
    return V.ANNOTATIONS(s, d).agg(F.count("*").alias("input"), F.count_if(bad).alias("dropped"))


@query("F16_candidate_kinds", f"SELECT key, kind FROM {KB} WHERE kind IN ('class', 'type_alias', 'reexport_alias')")
def _(s, d):
    from ..operators.retrieval import CANDIDATE_KINDS

    return V.KB(s, d).where(F.col("kind").isin(CANDIDATE_KINDS)).select("key", "kind")


@query("F24_resume", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars > 20000)")
def _(s, d):
    t = V.table(s, d, "documents")
    return L.not_done(t.select("source").distinct(), t.where("n_chars > 20000"), "source")


@query("F25_coordinates", "SELECT s_suppkey FROM supplier WHERE s_nationkey = 3 AND s_suppkey % 2 = 0")
def _(s, d):
    t = V.table(s, d, "supplier").withColumn("version", F.expr("s_suppkey % 2").cast("int"))
    return L.coordinates_match(t, {"s_nationkey": 3, "version": 0}).select("s_suppkey")


SPLITS = f"""p AS (SELECT DISTINCT {STRICT} AS project FROM {A}), h AS (SELECT project, CAST('0x' || substr(sha1('13:' || project), 1, 16) AS UBIGINT) % 10000 AS a, CAST('0x' || substr(sha1('14:' || project), 1, 16) AS UBIGINT) AS b, CAST('0x' || substr(sha1('15:' || project), 1, 16) AS UBIGINT) % 10000 AS c FROM p),
t AS (SELECT project FROM h WHERE a >= 7000 ORDER BY b LIMIT 15), s AS (SELECT h.project, CASE WHEN a < 7000 AND c < 1000 THEN 'validation' WHEN a < 7000 THEN 'train' WHEN t.project IS NOT NULL THEN 'test' END AS split FROM h LEFT JOIN t USING (project))"""


def splits(s, d):
    from ..operators.splits import project_splits

    return project_splits(V.ANNOTATIONS(s, d).select(X.strict_project(F.col("file")).alias("project")), seed=13, test_projects=15, validation_ratio=0.1)


@query("SC04_project_splits", f"WITH {SPLITS} SELECT project, split FROM s WHERE split IS NOT NULL")
def _(s, d):
    return splits(s, d)


@query("O01_metadata", f"WITH {SPLITS}, r AS (SELECT {STRICT} AS project, count(*) AS n FROM {A} GROUP BY 1) SELECT split, count(*) AS projects, CAST(sum(n) AS BIGINT) AS rows FROM s JOIN r USING (project) WHERE split IS NOT NULL GROUP BY 1")
def _(s, d):
    r = V.ANNOTATIONS(s, d).groupBy(X.strict_project(F.col("file")).alias("project")).agg(F.count("*").alias("n"))
    return r.join(splits(s, d), "project").groupBy("split").agg(F.count("*").alias("projects"), F.sum("n").alias("rows"))


#: Modules by part: every fiftieth is no Python, the one before it is nested too deeply to be read.
@query("O02_slice_stage", "SELECT p_partkey % 25 AS project, count(*) AS files, count(*) FILTER (WHERE p_partkey % 50 IN (48, 49)) AS failed, min(CASE WHEN p_partkey % 50 IN (48, 49) THEN 'SyntaxError' END) AS error, CAST(sum(CASE WHEN p_partkey % 50 NOT IN (48, 49) THEN 6 END) AS BIGINT) AS statements FROM part GROUP BY 1")
def _(s, d):
    import ast

    from ..operators.projects import by_row
    from .q_code import files

    deep = F.concat(F.lit("x = "), F.repeat(F.lit("("), 400), F.repeat(F.lit(")"), 400))
    sources = files(s, d).withColumn("source", F.when(F.regexp_extract("path", r"(\d+)\.py", 1).cast("int") % 50 == 48, deep).otherwise(F.col("source")))
    done = by_row(sources, ["project"], "source", lambda text: len(ast.parse(text).body), "long")
    return done.groupBy("project").agg(F.count("*").alias("files"), F.count("error").alias("failed"), F.min(F.substring_index("error", ":", 1)).alias("error"), F.sum("result").alias("statements"))


#: A row's hash as the operators make it, for DuckDB.
def hash_sql(*columns):
    return "CAST('0x' || substr(md5(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in columns) + ")), 1, 15) AS HUGEINT)"


#: Sources are projects, languages are splits. Of src3 nothing was attempted, src5 failed.
@query("O03_finalize", f"SELECT e.split, coalesce(r.rows, 0) AS rows, coalesce(r.projects, 0) AS projects, r.digest, e.missing, e.failures FROM (SELECT lang AS split, count(DISTINCT source) FILTER (WHERE source = 'src3') AS missing, count(DISTINCT source) FILTER (WHERE source = 'src5') AS failures FROM documents GROUP BY 1) e LEFT JOIN (SELECT lang AS split, count(*) AS rows, count(DISTINCT source) AS projects, CAST(sum({hash_sql('doc_id', 'text')}) AS VARCHAR) AS digest FROM documents WHERE source NOT IN ('src3', 'src5') GROUP BY 1) r USING (split)")
def _(s, d):
    t = V.table(s, d, "documents").select(F.col("lang").alias("split"), F.col("source").alias("project"), "doc_id", "text")
    statuses = t.select("project").distinct().where("project <> 'src3'").withColumn("error", F.when(F.col("project") == "src5", "failed"))
    return VER.finalize(t.where("project NOT IN ('src3', 'src5')"), t, statuses, "split", "project", ["doc_id", "text"], allow_partial=True)


#: Each document is a file of shard doc_id % 3; every tenth is in all shards, and every 97th of those differs in the last.
MERGED = f"""WITH f AS (SELECT doc_id % 3 AS shard, doc_id AS path, {hash_sql('text')} AS checksum FROM documents UNION ALL SELECT x.shard, doc_id, {hash_sql('text')} + CASE WHEN doc_id % 97 = 0 AND x.shard = 2 THEN 1 ELSE 0 END FROM documents, (VALUES (0), (1), (2)) x(shard) WHERE doc_id % 10 = 0 AND doc_id % 3 <> x.shard),
 p AS (SELECT path, count(*) AS copies, min(checksum) AS a, max(checksum) AS b FROM f GROUP BY 1)"""


def shards(s, d):
    """Files of three shards and the manifest that each carries: splits and their projects. That of shard 2 lacks a project."""
    t = V.table(s, d, "documents").select("doc_id", "lang", "source", VER.row_hash(["text"]).alias("checksum"))
    own = t.select(F.expr("doc_id % 3").alias("shard"), F.col("doc_id").alias("path"), "checksum")
    other = F.explode(F.filter(F.expr("sequence(0L, 2L)"), lambda i: i != F.col("doc_id") % 3))
    more = t.where("doc_id % 10 = 0").select(other.alias("shard"), F.col("doc_id").alias("path"), "checksum")
    more = more.withColumn("checksum", F.when(F.expr("path % 97 = 0 AND shard = 2"), (F.col("checksum") + 1).cast("decimal(38,0)")).otherwise(F.col("checksum")))
    plan = t.select("lang", "source").distinct().withColumn("shard", F.explode(F.expr("sequence(0L, 2L)"))).where("NOT (shard = 2 AND source = 'src3')")
    return own.unionByName(more), plan


@query("O04_merge_shards", MERGED + " SELECT path, copies, CAST(a AS VARCHAR) AS checksum FROM p WHERE a = b")
def _(s, d):
    return VER.merge_shards(*shards(s, d))[0].withColumn("checksum", F.col("checksum").cast("string"))


@query("J37_shard_faults", MERGED + " SELECT 'conflicting file' AS fault, CAST(path AS VARCHAR) AS of FROM p WHERE a <> b UNION ALL SELECT 'manifest differs', '2' WHERE EXISTS (SELECT 1 FROM documents WHERE source = 'src3')")
def _(s, d):
    return VER.merge_shards(*shards(s, d))[1]


#: Faults: of lang en the first row is missing, of de the first is changed, of fr the first is there twice.
VERIFIED = f"""WITH k AS (SELECT lang, min(doc_id) AS first FROM documents GROUP BY 1), a AS (
 SELECT d.*, CASE WHEN d.lang = 'de' AND doc_id = first THEN text || '!' ELSE text END AS now, 'c' || doc_id % 40 AS r1, 'c' || doc_id * 7 % 41 AS r2 FROM documents d JOIN k USING (lang), (VALUES (0), (1)) t(i) WHERE NOT (d.lang = 'en' AND doc_id = first) AND (i = 0 OR d.lang = 'fr' AND doc_id = first)),
 kb AS (SELECT DISTINCT source, 'c' || doc_id % 40 AS key FROM documents WHERE doc_id % 3 <> 0),
 o AS (SELECT lang, count(*) AS outside, min(doc_id) AS first_outside FROM a WHERE NOT EXISTS (SELECT 1 FROM kb WHERE kb.source = a.source AND key = r1) OR NOT EXISTS (SELECT 1 FROM kb WHERE kb.source = a.source AND key = r2) GROUP BY 1),
 b AS (SELECT lang, min(doc_id) FILTER (WHERE NOT (n_chars BETWEEN 50 AND 5000 AND contains(now, 'e'))) AS first_bad, arg_min(CASE WHEN n_chars NOT BETWEEN 50 AND 5000 THEN 'length' ELSE 'letter' END, doc_id) FILTER (WHERE NOT (n_chars BETWEEN 50 AND 5000 AND contains(now, 'e'))) AS error, count(*) AS rows, sum({hash_sql('doc_id', 'now')}) AS h FROM a GROUP BY 1),
 w AS (SELECT lang, count(*) AS n, sum({hash_sql('doc_id', 'text')}) AS h FROM documents GROUP BY 1)"""


@query("O05_verify_dataset", VERIFIED + " SELECT w.lang, coalesce(b.rows, 0) AS rows, coalesce(b.rows, 0) - w.n AS fewer_or_more, b.h IS DISTINCT FROM w.h AS changed, first_bad, error, coalesce(outside, 0) AS outside, first_outside FROM w LEFT JOIN b USING (lang) LEFT JOIN o USING (lang)")
def _(s, d):
    t = V.table(s, d, "documents").select("doc_id", "lang", F.col("source").alias("project"), "text", "n_chars")
    first = t.groupBy("lang").agg(F.min("doc_id").alias("first"))
    at = F.col("doc_id") == F.col("first")
    now = t.join(first, "lang").where(~((F.col("lang") == "en") & at)).withColumn("text", F.when((F.col("lang") == "de") & at, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    now = now.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when((F.col("lang") == "fr") & at, 2).otherwise(1)))).drop("first", "copy")
    now = now.withColumn("names", F.array(F.concat(F.lit("C"), F.expr("doc_id % 40")), F.concat(F.lit("c"), F.expr("doc_id * 7 % 41"))))
    kb = t.where("doc_id % 3 <> 0").select("project", F.concat(F.lit("C"), F.expr("doc_id % 40")).alias("key"))
    rules = [("length", F.col("n_chars").between(50, 5000)), ("letter", F.col("text").contains("e"))]
    return VER.verify(now, VER.manifest(t, "lang", "project", ["doc_id", "text"]), kb, "lang", "doc_id", ["doc_id", "text"], rules, "names")


#: Languages are shards; a project is done if one of its documents has a label.
@query("O06_shard_manifest", "WITH e AS (SELECT lang AS shard, source || '/' || doc_id % 50 AS project, max(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) AS done FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1, 2) SELECT shard, count(*) AS expected, CAST(sum(done) AS BIGINT) AS done, count(*) - CAST(sum(done) AS BIGINT) AS missing, min(CASE WHEN done = 0 THEN project END) AS first_missing FROM e GROUP BY 1")
def _(s, d):
    t = V.table(s, d, "documents").select("doc_id", F.col("lang").alias("shard"), F.concat("source", F.lit("/"), F.expr("doc_id % 50")).alias("project"))
    labelled = t.join(V.table(s, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return C.completeness(t, labelled, "shard", "project")


#: Ten shards by id; the parts of one that no document falls into are missing.
@query("O07_plan_validation", "WITH g AS (SELECT range AS i FROM range(10) WHERE range NOT IN (SELECT doc_id % 10 FROM documents WHERE doc_id % 100 <> 7)) SELECT 9 * count(*) AS faults FROM g")
def _(s, d):
    shards_ = V.table(s, d, "documents").where("doc_id % 100 <> 7").select(F.expr("doc_id % 10").alias("shard")).distinct()
    parts = shards_.select("shard", F.explode(H.physical_parts(F.col("shard"))).alias("p")).select("shard", "p.residue", "p.modulus")
    return C.residue_faults(parts).agg(F.count("*").alias("faults"))


@query("ST1_two_pass", f"SELECT a.scope, count(*) AS n, count(c.key) AS in_catalog FROM {A} a LEFT JOIN (SELECT 'v' || (key % 9) AS name, min(key) AS key FROM {KB} GROUP BY 1) c USING (name) GROUP BY 1")
def _(s, d):
    c = V.KB(s, d).groupBy(F.concat(F.lit("v"), F.expr("key % 9")).alias("name")).agg(F.min("key").alias("key"))
    return V.ANNOTATIONS(s, d).join(c, "name", "left").groupBy("scope").agg(F.count("*").alias("n"), F.count("key").alias("in_catalog"))


@query("ST2_micro_batches", "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def _(s, d):
    def sizes(frames):
        for f in frames:
            yield f.assign(chars=f["text"].str.len())[["role", "chars"]]

    return V.table(s, d, "conversations").select("role", "text").mapInPandas(sizes, "role string, chars long").groupBy("role").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query("ST4_resumable_stream", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    from ..streaming.resume import run_available

    p = folder(s)
    docs(s, d).write.parquet(f"{p}/in")
    run_available(s, f"{p}/in", "doc_id long, lang string, source string, n_chars long", f"{p}/out", f"{p}/state")
    run_available(s, f"{p}/in", "doc_id long, lang string, source string, n_chars long", f"{p}/out", f"{p}/state")  # nothing new
    return s.read.parquet(f"{p}/out").groupBy("lang").agg(F.count("*").alias("n"))


@query("S02_read_records", "SELECT role, count(*) AS n FROM conversations GROUP BY 1")
def _(s, d):
    R.write_jsonl(V.table(s, d, "conversations"), p := folder(s))
    return R.read_jsonl(s, p, "conv_id long, turn long, role string, text string").groupBy("role").agg(F.count("*").alias("n"))


@query("S03_flat_folder", "SELECT item_id, length(text) AS size FROM benchmark")
def _(s, d):
    R.write_jsonl(V.table(s, d, "benchmark"), p := folder(s))
    return s.read.schema("item_id long, text string").json(f"{p}/*.json").select("item_id", F.length("text").cast("long").alias("size"))


@query("S05_typed_json_list", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    p = folder(s)
    # one list in one file: the table has 25 rows at every size
    V.table(s, d, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(p)
    return R.read_json_list(s, p, "n_nationkey int, n_name string")


@query("A21_stage_sums", "SELECT event_type AS stage, count(*) AS calls, round(sum(value), 2) AS total, round(max(value), 6) AS longest FROM events GROUP BY 1")
def _(s, d):
    return V.table(s, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("total"), F.round(F.max("value"), 6).alias("longest"))
