"""Scopes, names and slices of TypeScript projects as tables: files are read one by one, all that relates them is joins.

A node has nested-set labels: it holds whatever begins between its start and its end. A declaration counts in a stretch of its
file, its scope; a name that is used at a place means the declaration of that name whose scope holds the place and begins
last. So looking outward through scopes is one join on (project, path, name) and the latest of what it finds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ts_syntax import File, Node
from ..functions.typescript import initializer_type
from .code_tables import _arrow, _batches
from .shared import Rounds, closure

MASK = "<mask>"
#: Kinds of targets by scope (fixed values), and kinds of nodes that open a scope for what is declared in them.
TARGETS = {"var": ["variable"], "arg": ["parameter"], "ret": ["function", "method"]}
HOLDERS, OWNERS, FUNCTIONS = ("block", "file"), ("class", "interface"), ("function", "method", "arrow")
DECLARED = ("class", "interface", "alias", "enum", "function", "method", "variable", "parameter", "property", "import")
STATEMENTS = ("variable", "statement", "return", "import", "property")
NODE = "kind string, name string, start int, end int, line int, scope_start int, scope_end int, body int, text string, masked string, type string, init string, owner string"
USE = "name string, at int, call boolean, s_start int, s_text string"
KEYWORDS = set("const let var if else for while do return function class new this super typeof await async import export from extends implements true false null undefined switch case break continue try catch finally throw of in as type interface enum public private static".split())
#: What more is told of nodes, uses and calls for whole slices: names that are called (`new ` before those of classes) or used in the first value,
#: names that are returned, the text that a use or call gives, names that it leads to and the scope they are searched in, names shown with it.
TOLD = "tag string, calls array<string>, names array<string>, returned array<struct<name: string, at: int>>, holder string, of_class string, gives string, g_start int, leads array<string>, l_start int, l_end int, passed string, shows array<string>"
#: Methods that put what they are given into a collection (fixed values); texts that short are shown only with one of the marks.
COLLECTING, SHORT, USEFUL = {"push", "add", "filter", "join", "slice"}, 6, "[=:(><]"
FILE, METHOD, ASYNC = "this is a snippet from the file ", "This function {} is a method in class {}", "This is an async declared function, and its return value must be in the Promise<...> format."


def _span(node: Node) -> tuple[int, int]:
    whole = node.more.get("whole")
    return whole if node.kind == "variable" and whole else (node.start, node.end)


def _scope(node: Node) -> Node:
    """What a declaration counts in."""
    if node.kind == "parameter":
        return node.up(*FUNCTIONS) or node
    return node.up(*OWNERS) or node if node.kind in ("property", "method") else node.up(*HOLDERS) or node


def _masked(file: File, node: Node) -> str:
    """The declaration, of a parameter its function, with the mask in place of the type."""
    start, end = _span(node.up(*FUNCTIONS) or node) if node.kind == "parameter" else _span(node)
    typed, text = node.more.get("typed"), file.source
    if typed:
        return f"{text[start : typed[0]].rstrip()} {MASK}{text[typed[1] : end]}"
    at = node.more.get("name_end", node.more.get("head", end))
    at += text[at : at + 1] == "?"
    return f"{text[start:at]}: {MASK}{text[at:end]}"


def nodes_of(source: str, file: File | None = None) -> list[dict]:
    """Declarations, imports and functions of a file, with their scopes."""
    file, out = file or File(source), []
    for n in file.root.walk():
        if n.kind in DECLARED:
            start, end = _span(n)
            scope, inside, owner = _scope(n), n.more.get("body"), n.up(*OWNERS)
            out.append({
                "kind": n.kind, "name": n.name, "start": start, "end": end, "line": source.count("\n", 0, n.start) + 1, "scope_start": scope.start, "scope_end": scope.end,
                "body": inside.start if isinstance(inside, Node) else None, "text": source[start:end], "masked": _masked(file, n) if n.kind in ("variable", "parameter", "function", "method") else None,
                "type": n.more.get("type") or None, "init": n.more.get("init") or None, "owner": ("async " if n.more.get("is_async") else "") + (owner.name if owner is not None and n.kind == "method" else ""),
            })
    return out


def uses_of(source: str, file: File | None = None) -> list[dict]:
    """Names that a file uses, members' names left out, with the statement around each."""
    file, out = file or File(source), []
    for i, (kind, text, at) in enumerate(zip(file.kinds, file.texts, file.starts, strict=True)):
        if kind != "name" or text in KEYWORDS or (i and file.texts[i - 1] in (".", "?.")):
            continue
        node: Node | None = file.at(at)
        while node is not None and node.kind not in STATEMENTS:
            node = node.parent
        if node is not None:
            start, end = _span(node)
            out.append({"name": text, "at": at, "call": file.texts[i + 1 : i + 2] == ["("], "s_start": start, "s_text": source[start:end]})
    return out


def _names(shape: str) -> list[str]:
    return re.findall(r"(\w+) \w+(?:<[^<>]*(?:<[^<>]*>)?[^<>]*>)?(?:, |$)", shape)


def _called(node: Node) -> list[str]:
    """What is called in a node, by the last part of its name."""
    return list(dict.fromkeys(("new " if c.more["new"] else "") + c.name.rpartition(".")[2] for c in node.walk() if c.kind == "call"))


def _to_scope(node: Node, names: list[str]) -> dict:
    root = node.up(*HOLDERS) or node
    return {"leads": names, "l_start": root.start, "l_end": root.end}


def told_of_call(file: File, call: Node) -> dict:
    """The variable that a call's result is kept in, with its statement, else the call; the receiver is shown too."""
    head, dot, _ = call.name.partition(".")
    out, around = {"shows": [head] if dot else []}, call.parent
    while around is not None and around.kind not in (*HOLDERS, "variable"):
        around = around.parent
    if around is not None and around.kind == "variable":
        start, end = _span(around)
        return out | {"gives": file.source[start:end], "g_start": start} | _to_scope(around, [around.name])
    return out | {"gives": file.text(call), "g_start": call.start}


def told_of_use(file: File, at: int, name: str) -> dict:
    """What the use of a name at a place tells: of its statement, and of the names that its value goes on to."""
    node, after = file.at(at), file.source[at + len(name) :].lstrip()[:2]
    if node.kind in ("variable", "parameter", "import") and node.start <= at < node.more.get("name_end", node.end):
        return {}
    if node.kind == "call" and node.more["arguments"][0] <= at < node.more["arguments"][1] and not after.startswith((".", "?.")):
        return told_of_call(file, node) | {"passed": ("new " if node.more["new"] else "") + node.name.rpartition(".")[2]}
    shows: list[str] = []
    while node is not None and node.kind not in (*STATEMENTS, *HOLDERS):
        if node.kind == "call" and node.name.split(".")[0] == name and node.name.rpartition(".")[2] in COLLECTING:
            shows += file.names(*node.more["arguments"])
        node = node.parent
    if node is None or node.kind in (*HOLDERS, "import"):
        return {}
    start, end = _span(node)
    out = {"gives": file.source[start:end], "g_start": start, "shows": shows}
    if node.kind == "variable" and name not in node.more["names"]:
        return out | _to_scope(node, node.more["names"])
    if node.kind == "statement" and not node.more.get("condition"):
        signs = [i for i in file.tokens(start, end) if file.texts[i] == "=" and file.kinds[i] == "mark" and file.at(file.starts[i]) is node]
        if signs:
            x = file.starts[signs[0]]
            left, right = file.source[start:x].strip(), file.source[x + 1 : end].strip().rstrip(";").strip()
            if left == name:
                return out | _to_scope(node, [n for n in file.names(x, end) if n != name and n not in KEYWORDS])
            if right == name:
                return out | {"shows": [*shows, re.split(r"[.\[]", left)[0]]}
    return out


def told_of(source: str) -> Iterator[dict]:
    """Nodes, uses and calls of a file with TOLD."""
    file = File(source)
    nodes = [n for n in file.root.walk() if n.kind in DECLARED]
    for n, row in zip(nodes, nodes_of(source, file), strict=True):
        holder = n.up(*FUNCTIONS) if n.kind == "parameter" else n
        body = holder.more.get("body") if holder is not None else None
        root = body if isinstance(body, Node) else n.up(*HOLDERS) or n
        owner = n.up(*OWNERS) if holder is not None and holder.kind == "method" else None
        returned = [{"name": x, "at": file.source.index(x, c.start)} for c in n.walk() if c.kind == "return" for x in file.names(c.start, c.end) if x not in KEYWORDS] if n.kind in TARGETS["ret"] else []
        names = [x for x in file.names(n.more["name_end"], n.end) if x not in KEYWORDS and x != n.name] if n.kind == "variable" and n.more.get("init") else []
        yield row | {"tag": "node", "calls": _called(n), "names": names, "returned": returned, "holder": (holder.name if holder is not None else "") or "", "of_class": owner.name if owner is not None else "", "l_start": root.start, "l_end": root.end}
    for row in uses_of(source, file):
        yield row | {"tag": "use"} | told_of_use(file, row["at"], row["name"])
    for c in file.root.walk():
        if c.kind == "call":
            told = told_of_call(file, c)
            yield {"tag": "call", "name": c.name.rpartition(".")[2], "owner": c.name, "at": c.start, "text": file.text(c)} | told | {"shows": [*told["shows"], *(x for x in file.names(*c.more["arguments"]) if x not in KEYWORDS)]}


def _table(files: DataFrame, find, shape: str) -> DataFrame:
    names = _names(shape)
    shape = f"project {files.schema['project'].dataType.simpleString()}, path string, {shape}"
    schema = _arrow(shape)
    texts = [i for i, x in enumerate(schema.names) if x in ("text", "masked", "s_text", "gives")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for project, path, source in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    yield from ((project, path, *map(x.get, names)) for x in find(source or ""))

        yield from _batches(each(), schema, lambda row: sum(len(row[i] or "") for i in texts))

    found = files.select("project", "path", "source").mapInArrow(run, shape)
    return Rounds(files.sparkSession).add("found", found)  # read by several joins, so files are read once


def nodes(files: DataFrame) -> DataFrame:
    """(project, path, NODE) of all files (project, path, source)."""
    return _table(files, nodes_of, NODE)


def uses(files: DataFrame) -> DataFrame:
    """(project, path, USE) of all files (project, path, source)."""
    return _table(files, uses_of, USE)


def nodes_and_uses(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables of all files, each read once."""
    more = [x for x in USE.split(", ") if x.split()[0] not in _names(NODE)]

    def find(source: str) -> Iterator[dict]:
        file = File(source)
        yield from nodes_of(source, file)
        yield from uses_of(source, file)

    found = _table(files, find, ", ".join([NODE, *more]))
    return tuple(found.where(f"kind IS {test}").select("project", "path", *_names(shape)) for test, shape in (("NOT NULL", NODE), ("NULL", USE)))


def meant(places: DataFrame, declared: DataFrame, keys: list[str], at: str = "at", want: str = "text") -> DataFrame:
    """keys of places (with project, path, name and `at`) and `found`: where the node that the name means there begins, and its `want`; only those that mean one.

    Like all joins of these tables it is a merge of shuffled rows: targets and nodes grow with the files, and texts that repeat are
    far larger than the files they are read from, so none is sent to all tasks.
    """
    d = declared.where("kind <> 'import'").select("project", "path", "name", "scope_start", "scope_end", F.struct(*dict.fromkeys(("start", want))).alias("found"))
    held = places.select(*dict.fromkeys((*keys, "project", "path", "name", at))).join(d.hint("merge"), ["project", "path", "name"]).where((F.col("scope_start") <= F.col(at)) & (F.col(at) < F.col("scope_end")))
    return held.groupBy(*keys).agg(F.max_by("found", F.struct("scope_start", "found.start")).alias("found"))


def occurrences(declared: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (project, path, scope, name, occurrence) with the columns of the node that they mean; without one none."""
    scope = F.coalesce(*[F.when(F.col("kind").isin(*kinds), s) for s, kinds in TARGETS.items()])
    nth = F.row_number().over(Window.partitionBy("project", "path", "scope", "name").orderBy("start")) - 1
    numbered = declared.withColumn("scope", scope).where("scope IS NOT NULL").withColumn("occurrence", nth.cast("int"))
    return targets.join(numbered.hint("merge"), ["project", "path", "scope", "name", "occurrence"], "left")


def outward(declared: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (project, path, function, name) with `declaration`: what the name means in the function's body; null if nothing."""
    bodies = declared.where(F.col("kind").isin(*TARGETS["ret"]) & F.col("body").isNotNull()).groupBy("project", "path", F.col("name").alias("function")).agg((F.min("body") + 1).alias("at"))
    places = targets.join(bodies.hint("merge"), ["project", "path", "function"])
    found = meant(places, declared, ["project", "path", "function", "name"])
    return targets.join(found.hint("merge"), ["project", "path", "function", "name"], "left").withColumn("declaration", F.col("found.text")).drop("found")


def resolved(used: DataFrame, declared: DataFrame) -> DataFrame:
    """uses with `of`: where the declaration that they mean begins. Members of a class are not meant by their bare names."""
    found = meant(used, declared.where("kind NOT IN ('property', 'method')"), ["project", "path", "name", "at"], want="start")
    return used.join(found.select("project", "path", "name", "at", F.col("found.start").alias("of")).hint("merge"), ["project", "path", "name", "at"])


def block_names(declared: DataFrame, used: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (project, path, scope, name, occurrence) and a `text` for each statement that uses what they mean; that of the declaration is masked."""
    key = ["project", "path", "scope", "name", "occurrence"]
    wanted = occurrences(declared, targets).where("start IS NOT NULL").select(*key, F.col("start").alias("of"), "masked", "kind")
    each = wanted.join(resolved(used, declared).hint("merge"), ["project", "path", "name", "of"])
    own = F.col("s_start") == F.col("of")
    rows = each.where(~(own & (F.col("kind") == "parameter"))).select(*key, F.when(own, F.col("masked")).otherwise(F.col("s_text")).alias("text"), "s_start")
    return rows.distinct()


def tracked(declared: DataFrame, used: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (project, path, function, name) and a `text` for each statement that the parameter's value may come to, through variables."""
    key = ["project", "path", "function", "name"]
    known = resolved(used, declared)
    variables = declared.where("kind = 'variable'").select("project", "path", F.col("start").alias("s_start"), F.col("start").alias("to")).distinct()
    steps = known.select("project", "path", "s_start", "of").join(variables.hint("merge"), ["project", "path", "s_start"]).where("of <> to").select("project", "path", "of", "to")
    reached = closure(steps, "of", "to")
    functions = declared.where(F.col("kind").isin(*TARGETS["ret"])).select("project", "path", F.col("name").alias("function"), F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    parameters = declared.where("kind = 'parameter'").select("project", "path", "name", F.col("start").alias("of"), F.col("scope_start").alias("f_start"))
    start = targets.join(functions.hint("merge"), ["project", "path", "function"]).join(parameters.hint("merge"), ["project", "path", "name", "f_start"]).select(*key, "of")
    every = start.unionByName(start.join(reached.hint("merge"), ["project", "path", "of"]).drop("of").withColumnRenamed("to", "of"))
    return every.join(known.drop("name").hint("merge"), ["project", "path", "of"]).where("s_start <> of OR s_text LIKE '%=%'").select(*key, F.col("s_text").alias("text")).distinct()


def _joined(rows: DataFrame, key: list[str], order: list[str], text: str, alias: str) -> DataFrame:
    """Different texts of each key in order, as one."""
    held = rows.groupBy(*key, text).agg(F.min(F.struct(*order)).alias("o")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("o", F.col(text).alias("t")))).alias("x"))
    return held.select(*key, F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias(alias))


def slices(declared: DataFrame, used: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (project, path, scope, name, occurrence) with `slice`; null where the target isn't there.

    A slice has the file's name, what kind of function it is about, the file's imports, definitions of what the statements call or
    make, the masked declaration, the statements that use it, and for parameters and return values the statements of callers.
    """
    key = ["project", "path", "scope", "name", "occurrence"]
    found = occurrences(declared, targets)
    there = found.where("start IS NOT NULL").select(*key, "kind", "start", "end", "masked", "owner", "body", "scope_start")
    imports = _joined(declared.where("kind = 'import'"), ["project", "path"], ["start"], "text", "imports")
    # what uses a function are its callers
    statements = block_names(declared, used, targets.where("scope <> 'ret'")).where("text NOT LIKE '%<mask>%'")
    mentioned = used.where("call").select("project", "path", F.col("name").alias("called"), "s_start", "at")
    local = statements.select(*key, "s_start").unionByName(there.where("scope = 'var'").select(*key, F.col("start").alias("s_start"))).distinct()
    by_use = local.join(mentioned.hint("merge"), ["project", "path", "s_start"]).select(*key, "called")
    inside = there.where("scope = 'ret'").select(*key, "start", "end").join(mentioned.hint("merge"), ["project", "path"]).where(F.col("at").between(F.col("start"), F.col("end"))).select(*key, "called")
    definitions = declared.where(F.col("kind").isin("function", "class")).select("project", F.col("name").alias("called"), F.col("path").alias("d_path"), F.col("start").alias("d_start"), F.col("text").alias("d_text"))
    helpers = by_use.unionByName(inside).where("called <> name").distinct().join(definitions.hint("merge"), ["project", "called"])
    functions = declared.where(F.col("kind").isin(*TARGETS["ret"])).select("project", "path", F.col("start").alias("scope_start"), F.col("name").alias("function"))
    of = there.where("scope = 'arg'").join(functions.hint("merge"), ["project", "path", "scope_start"]).select(*key, "function").unionByName(there.where("scope = 'ret'").select(*key, F.col("name").alias("function")))
    calls = used.where("call").select("project", F.col("name").alias("function"), F.col("path").alias("c_path"), "s_start", "s_text", "at")
    callers = of.join(calls.hint("merge"), ["project", "function"]).where("NOT startswith(s_text, function)").select(*key, "c_path", "s_start", "s_text")
    parts = [
        _joined(helpers, key, ["d_path", "d_start"], "d_text", "helpers"),
        _joined(statements, key, ["s_start"], "text", "statements"),
        _joined(callers, key, ["c_path", "s_start"], "s_text", "callers"),
    ]
    out = there.join(imports.hint("merge"), ["project", "path"], "left")
    for part in parts:
        out = out.join(part.hint("merge"), key, "left")
    owner = F.regexp_replace("owner", "^async ", "")
    head = [
        F.when((F.col("scope") == "ret") & F.col("owner").startswith("async "), F.lit(ASYNC)),
        F.concat(F.lit(FILE), F.element_at(F.split("path", "/"), -1)),
        F.when((F.col("kind") == "method") & (owner != ""), F.concat(F.lit(METHOD.split("{}")[0]), "name", F.lit(METHOD.split("{}")[1]), owner)),
    ]
    made = out.select(*key, F.concat_ws("\n", *head, "imports", "helpers", "masked", "statements", "callers").alias("slice"))
    return targets.join(made.hint("merge"), key, "left")


def all_told(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, uses and calls of all files with TOLD, each file read once."""
    more = [x for x in USE.split(", ") if x.split()[0] not in _names(NODE)]
    found = _table(files, told_of, ", ".join([NODE, *more, TOLD]))
    return tuple(found.where(f"tag = '{tag}'") for tag in ("node", "use", "call"))


IN = "at >= l_start AND at < l_end"


def reached(start: DataFrame, used: DataFrame) -> DataFrame:
    """start (with project, path, name, l_start, l_end) and the names and scopes that uses of a name in its scope lead to, through any number."""
    other = [c for c in start.columns if c not in ("name", "l_start", "l_end")]
    edges = used.where("size(leads) > 0").select("project", "path", "name", "at", F.explode("leads").alias("lead"), F.col("l_start").alias("to_start"), F.col("l_end").alias("to_end"))
    edges = edges.select("project", "path", "name", "at", F.struct(F.col("lead").alias("name"), F.col("to_start").alias("l_start"), F.col("to_end").alias("l_end")).alias("to"))
    held = edges.select("project", "path", F.col("to").alias("of_"), F.col("to.name").alias("name"), F.col("to.l_start").alias("l_start"), F.col("to.l_end").alias("l_end")).distinct()
    steps = held.join(edges.hint("merge"), ["project", "path", "name"]).where(IN).where("of_ <> to").select("project", "path", "of_", "to")
    far = closure(steps, "of_", "to")
    near = start.join(edges.hint("merge"), ["project", "path", "name"]).where(IN).select(*other, F.col("to").alias("of_"))
    led = near.unionByName(near.join(far.hint("merge"), ["project", "path", "of_"]).select(*other, F.col("to").alias("of_")))
    return start.unionByName(led.select(*other, "of_.name", "of_.l_start", "of_.l_end")).distinct()


def told_texts(start: DataFrame, declared: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sub, d_path, start, text): all that scopes tell of the names in start (keys, project, path, name, l_start, l_end, open) and of
    those they lead to: declarations, uses, what is shown with these, and definitions of what is called with them (sub 0).

    Where a scope does not declare a name and `open` says so, its declaration further out is told last (sub 2).
    """
    rounds = Rounds(declared.sparkSession)  # each is read by several joins, and is much work to find again
    every = rounds.add("reached", reached(start, used))
    place = list(dict.fromkeys((*keys, "project", "path")))
    same = ["project", "path", "name"]
    variables = every.join(declared.where("kind = 'variable'").select(*same, F.col("start").alias("at"), "text", "calls").hint("merge"), same).where(IN)
    variables = rounds.add("variables", variables.select(*place, *[x for x in ("name", "l_start") if x not in place], "at", "text", "calls"))
    uses_ = every.join(used.where("gives IS NOT NULL").select(*same, "at", "gives", "g_start", "passed", "shows").hint("merge"), same).where(IN)
    uses_ = rounds.add("uses", uses_.select(*place, "at", "gives", "g_start", "passed", "shows"))
    plain = declared.where("kind IN ('variable', 'parameter')")
    at_ = list(dict.fromkeys((*place, "name", "at")))
    shown = uses_.select(*place, F.explode("shows").alias("name"), "at").distinct()
    bare = every.where("open").join(variables.select(*place, "name", "l_start").distinct().hint("merge"), [*place, "name", "l_start"], "left_anti").select(*place, "name", F.col("l_start").alias("at"))
    out = meant(shown.withColumn("sub", F.lit(1)).unionByName(bare.withColumn("sub", F.lit(2))), plain, [*at_, "sub"])
    called = variables.select(*place, F.explode("calls").alias("called")).unionByName(uses_.where("passed IS NOT NULL").select(*place, F.col("passed").alias("called"))).distinct()
    rows = [
        variables.select(*keys, F.lit(1).alias("sub"), F.lit("").alias("d_path"), F.col("at").alias("start"), "text"),
        uses_.select(*keys, F.lit(1).alias("sub"), F.lit("").alias("d_path"), F.col("g_start").alias("start"), F.col("gives").alias("text")),
        out.select(*keys, "sub", F.lit("").alias("d_path"), F.col("found.start").alias("start"), F.col("found.text").alias("text")),
        defined(called, declared).select(*keys, F.lit(0).alias("sub"), "d_path", "start", "text"),
    ]
    made = rows[0]
    for r in rows[1:]:
        made = made.unionByName(r)
    return made.distinct()


def defined(called: DataFrame, declared: DataFrame) -> DataFrame:
    """called (project, called) with d_path, start, text of the functions of that name in the project, and of classes where one is made."""
    d = declared.where("kind IN ('function', 'method', 'class', 'interface') AND name <> ''").select("project", F.col("name").alias("leaf"), F.col("path").alias("d_path"), "start", "text", "kind")
    made = F.col("called").startswith("new ")
    named = called.withColumn("leaf", F.regexp_replace("called", "^new ", ""))
    return named.join(d.hint("merge"), ["project", "leaf"]).where(made | F.col("kind").isin(*TARGETS["ret"]))


def _there(declared: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that are there, as columns of their node; `of` is where it begins."""
    key = ["project", "path", "scope", "name", "occurrence"]
    more = ["kind", "text", "masked", "owner", "body", "scope_start", "scope_end", "end", "l_start", "l_end", "calls", "names", "returned", "holder", "of_class"]
    return occurrences(declared, targets).where("start IS NOT NULL").select(*key, F.col("start").alias("of"), *more)


def _is_own(scope_start: str) -> Column:
    """Whether a definition (sub 0) is that of the function that a target is, or is a parameter of."""
    begins = F.when(F.col("scope") == "arg", F.col(scope_start)).otherwise(F.col("of"))
    return (F.col("sub") == 0) & (F.col("scope") != "var") & (F.col("d_path") == F.col("path")) & (F.col("start") == begins)


def block_texts(declared: DataFrame, used: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (project, path, scope, name, occurrence) and a `text` for each thing that the scope tells of what they mean; tables of all_told."""
    key = ["project", "path", "scope", "name_", "occurrence", "of", "masked", "f_start"]
    start = _there(declared, targets).withColumns({"name_": F.col("name"), "f_start": F.col("scope_start")}).select(*key, "name", "l_start", "l_end", (F.col("scope") != "arg").alias("open"))
    rows = told_texts(start, declared, used, key).where(~_is_own("f_start"))
    text = F.when((F.col("start") == F.col("of")) & (F.col("scope") == "var") & (F.col("sub") > 0), F.col("masked")).otherwise(F.col("text"))
    return rows.select("project", "path", "scope", F.col("name_").alias("name"), "occurrence", text.alias("text")).distinct()


def tracked_texts(declared: DataFrame, used: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (project, path, function, name) and a `text` for each thing that the parameter's value may come to; tables of all_told."""
    parameters = declared.where("kind = 'parameter'").select("project", "path", F.col("holder").alias("function"), "name", "l_start", "l_end").distinct()
    key = ["project", "path", "function", "name_"]
    start = targets.join(parameters.hint("merge"), ["project", "path", "function", "name"]).withColumn("name_", F.col("name")).withColumn("open", F.lit(False))
    return told_texts(start, declared, used, key).select("project", "path", "function", F.col("name_").alias("name"), "text").distinct()


def whole_slices(declared: DataFrame, used: DataFrame, calls: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (project, path, scope, name, occurrence) with `slice`, null where the target isn't there; tables of all_told.

    After the file's name, what kind of function it is about and the imports come, by scope: of a variable what it calls and all that its
    scope tells of it and of the names it is made of; of a parameter its function and what the body tells; of a function what it calls,
    what it returns and itself; then callers, with what they are given and what becomes of the result. Equal texts stand once.
    """
    key = ["project", "path", "scope", "name", "occurrence"]
    there = Rounds(declared.sparkSession).add("targets", _there(declared, targets))
    ids = ["project", "path", "scope", "name_", "occurrence", "g", "own", "c_path", "c_at"]
    t = there.withColumn("name_", F.col("name")).withColumns({"g": F.lit(2), "own": F.lit(0), "c_path": F.lit(""), "c_at": F.lit(0)})
    searched = ["name", "l_start", "l_end", "open"]
    first = t.where("scope <> 'ret'").select(*ids, *searched[:3], F.lit(False).alias("open"))
    made_of = t.where("scope = 'var'").withColumn("name", F.explode("names")).select(*ids, *searched[:3], F.lit(True).alias("open"))
    # callers: in the file with all that becomes of the result, in other files the call
    named = t.where("scope <> 'var' AND holder <> ''").select(*ids[:5], "holder", "of_class", F.col("of").alias("t_of"), F.when(F.col("scope") == "arg", F.col("scope_start")).otherwise(F.col("of")).alias("f_start"), F.when(F.col("scope") == "arg", F.col("scope_end")).otherwise(F.col("end")).alias("f_end"))
    c = calls.select("project", F.col("name").alias("holder"), F.col("owner").alias("whole"), F.col("path").alias("c_path"), F.col("at").alias("c_at"), "text", "gives", "g_start", "leads", "l_start", "l_end", "shows")
    met = named.join(c.hint("merge"), ["project", "holder"]).withColumn("own", (F.col("path") != F.col("c_path")).cast("int")).withColumn("g", F.lit(5))
    here = met.where("own = 0 AND (whole = holder OR of_class <> '') AND NOT (c_at >= f_start AND c_at < f_end)")
    away = met.where("own = 1")
    kept = here.withColumn("name", F.explode("leads")).select(*ids, *searched[:3], F.lit(False).alias("open"))
    given = meant(here.select(*ids, F.explode("shows").alias("name"), F.col("c_at").alias("at")).distinct(), declared.where("kind IN ('variable', 'parameter')"), [*ids, "name", "at"])
    told = told_texts(first.unionByName(made_of).unionByName(kept), declared, used, ids)
    none, zero = F.lit("").alias("d_path"), F.lit(0)
    row = [*ids, "sub", "d_path", "start", "text"]
    returned = t.where("scope = 'ret'").withColumn("r", F.explode("returned")).select(*ids, F.col("r.name").alias("name"), F.col("r.at").alias("at")).distinct()
    back = meant(returned, declared.where("kind IN ('variable', 'parameter')"), [*ids, "name", "at"])
    helped = defined(t.where("scope <> 'arg'").select(*ids, F.explode("calls").alias("called")), declared)
    parts = [
        told,
        t.where("scope <> 'var'").select(*ids, zero.alias("sub"), none, "of", "masked").toDF(*row).withColumn("g", F.when(F.col("scope") == "arg", 0).otherwise(4)),
        helped.select(*ids, zero.alias("sub"), "d_path", "start", "text"),
        back.select(*ids, F.lit(1).alias("sub"), none, F.col("found.start").alias("start"), F.col("found.text").alias("text")),
        given.select(*ids, F.lit(-1).alias("sub"), none, F.col("found.start").alias("start"), F.col("found.text").alias("text")),
        here.select(*ids, F.lit(1).alias("sub"), none, F.col("g_start").alias("start"), F.col("gives").alias("text")),
        away.select(*ids, F.lit(1).alias("sub"), none, F.col("c_at").alias("start"), "text"),
    ]
    rows = parts[0].select(*row)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*row))
    rows = rows.withColumnRenamed("name_", "name").join(there.select(*key, F.col("text").alias("own_text"), "masked", "of", "scope_start").hint("merge"), key)
    own = (F.col("scope") == "var") & (F.col("start") == F.col("of")) & (F.col("sub") > 0)
    hidden = F.when((F.col("sub") == 0) & (F.col("g") == 2) & (F.col("scope") == "var"), F.replace("text", "own_text", "masked")).otherwise(F.col("text"))
    # a function isn't its own helper
    rows = rows.where(~(F.col("g").isin(2, 5) & _is_own("scope_start")))
    shown = rows.withColumn("text", F.when(own, F.col("masked")).otherwise(hidden)).where((F.length("text") >= SHORT) | F.col("text").rlike(USEFUL))
    order = F.struct("g", "own", "c_path", "c_at", "sub", "d_path", "start")
    held = shown.groupBy(*key, "text").agg(F.min(order).alias("o")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("o", "text"))).alias("x"))
    body = held.select(*key, F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("told"))
    imports = _joined(declared.where("kind = 'import'"), ["project", "path"], ["start"], "text", "imports")
    out = there.join(imports.hint("merge"), ["project", "path"], "left").join(body.hint("merge"), key, "left")
    head = [
        F.when((F.col("scope") == "ret") & F.col("owner").startswith("async "), F.lit(ASYNC)),
        F.concat(F.lit(FILE), F.element_at(F.split("path", "/"), -1)),
        F.when(F.col("of_class") != "", F.concat(F.lit(METHOD.split("{}")[0]), "holder", F.lit(METHOD.split("{}")[1]), "of_class")),
    ]
    text = F.concat_ws("\n", *head, "imports", F.when(F.col("of_class") != "", F.replace("told", F.lit("this."), F.concat("of_class", F.lit(".")))).otherwise(F.col("told")))
    return targets.join(out.select(*key, text.alias("slice")).hint("merge"), key, "left")


def static_types(declared: DataFrame) -> DataFrame:
    """(project, path, name, data_type, static_type, asked): what is to be told of each variable and function without a type.

    The static type is what the initializer shows; where it shows none, a slice must be asked for.
    """
    untyped = declared.where("type IS NULL").where("kind = 'variable' OR kind = 'function'")
    guess = F.pandas_udf(lambda texts: texts.map(lambda x: initializer_type(x) if x else "any"), "string", F.PandasUDFType.SCALAR)
    shown: Column = F.when((F.col("kind") == "variable") & F.col("init").isNotNull(), F.nullif(guess("init"), F.lit("any")))
    rows = untyped.select("project", "path", "name", "start", F.when(F.col("kind") == "variable", "var").otherwise("Ret").alias("data_type"), shown.alias("static_type"))
    return rows.withColumn("asked", F.col("static_type").isNull())
