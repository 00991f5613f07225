"""Records of the data model made from the driver's tables, once as DataFrames and once as SQL.

Column texts are valid in both dialects, so both sides see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly over many tasks: a narrow table is one task's to read, but what is made of each of its rows takes long.

    The number of tasks is stated, so adaptive execution doesn't put small rows together again.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


class View:
    """source table, {column: expression}"""

    def __init__(self, source: str, columns: dict[str, str]):
        self.source, self.columns = source, columns

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.source).selectExpr(*[f"{e} AS {c}" for c, e in self.columns.items()])

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in self.columns.items())} FROM {self.source})"


def _cases(number: str, values: list[str]) -> str:
    """CASE over number % len(values); values are quoted as they are, so none holds a backslash."""
    quoted = [x.replace("'", "''") for x in values]
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(quoted)) + " END"


#: Type texts of all forms that the functions tell apart.
TYPES = ["int", "typing.List[int]", "pkg.mod.Response", "Dict[str, any]", "Outer.Inner", "str | None", "  ", "list[a.B]", "Optional [ str ]", "tuple[int]", "MyType", "{a: string}"]
CATS = ["", "builtins", "user-defined", "generic", "Builtin", ""]

#: One annotation for each line item; pos is its place in the input.
ANNOTATIONS = View(
    "lineitem",
    {
        "pos": "l_orderkey * 8 + l_linenumber",
        "file": "'repos/own' || CAST(l_suppkey % 7 AS VARCHAR(20)) || '/repo' || CAST(l_suppkey AS VARCHAR(20)) || '/src/pkg/m' || CAST(l_partkey % 20 AS VARCHAR(20)) || '.py'",
        "loc": "'fn' || CAST(l_partkey % 97 AS VARCHAR(20)) || '@' || CAST(l_linenumber * 10 AS VARCHAR(20))",
        "name": "'v' || CAST(l_orderkey % 13 AS VARCHAR(20))",
        "scope": "CASE l_returnflag WHEN 'R' THEN 'Return' WHEN 'A' THEN 'arg' ELSE 'local' END",
        "cat": _cases("l_partkey", CATS),
        "origttype": "CASE WHEN l_orderkey % 5 = 0 THEN 'builtins.int' WHEN l_orderkey % 5 = 1 THEN 'x.Y' ELSE '' END",
        "gttype": _cases("(l_partkey + l_linenumber)", TYPES),
        "line": "l_linenumber * 10",
    },
)

#: A project for each source of documents, code slices in their text.
SLICES = View("documents", {"doc_id": "doc_id", "project": "'own/' || source", "lang": "lang", "source": "source", "text": "text", "n_chars": "n_chars"})

#: One prediction for each order: the truth and five ranked answers.
PREDICTIONS = View(
    "orders",
    {
        "id": "o_orderkey",
        "scope": "CASE o_orderstatus WHEN 'O' THEN 'local' WHEN 'F' THEN 'arg' ELSE 'return' END",
        "cat": "CASE o_custkey % 3 WHEN 0 THEN 'builtins' WHEN 1 THEN 'user-defined' ELSE 'other' END",
        "generic": "o_custkey % 4 = 0",
        "truth": "'T' || CAST(o_custkey % 6 AS VARCHAR(20))",
        "p1": "'T' || CAST(o_orderkey % 6 AS VARCHAR(20))",
        "p2": "'T' || CAST((o_orderkey + 2) % 6 AS VARCHAR(20))",
        "p3": "'pkg.T' || CAST((o_orderkey + 3) % 6 AS VARCHAR(20))",
        "p4": "'T' || CAST((o_orderkey + 1) % 6 AS VARCHAR(20))",
        "p5": "'T' || CAST((o_orderkey + 4) % 6 AS VARCHAR(20))",
        "price": "o_totalprice",
        "cust": "o_custkey",
        "prio": "o_orderpriority",
    },
)

#: Knowledge-base records: parts as classes, functions and aliases of packages.
KB = View(
    "part",
    {
        "key": "p_partkey",
        "name": "'C' || CAST(p_partkey % 400 AS VARCHAR(20))",
        "module": "'pkg' || CAST(p_partkey % 25 AS VARCHAR(20)) || CASE WHEN p_partkey % 3 = 0 THEN '.sub' ELSE '' END",
        "package": "'pkg' || CAST(p_partkey % 25 AS VARCHAR(20))",
        "qualified_name": "'pkg' || CAST(p_partkey % 25 AS VARCHAR(20)) || '.C' || CAST(p_partkey % 400 AS VARCHAR(20))",
        "kind": "CASE p_size % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'type_alias' WHEN 2 THEN 'reexport_alias' WHEN 3 THEN 'function_return' ELSE 'class' END",
        "definition": "p_name || ' ' || p_brand || ' ' || p_type",
        "size": "p_size",
    },
)

#: Call sites of functions: one for each line item.
CALLS = View(
    "lineitem",
    {
        "pos": "l_orderkey * 8 + l_linenumber",
        "callee": "'pkg' || CAST(l_suppkey % 25 AS VARCHAR(20)) || '.C' || CAST(l_partkey % 500 AS VARCHAR(20))",
        "leaf": "'C' || CAST(l_partkey % 500 AS VARCHAR(20))",
        "module": "'pkg' || CAST(l_suppkey % 25 AS VARCHAR(20))",
        "part": "l_partkey",
        "arg": "l_linenumber",
        "line": "l_linenumber * 7",
        "file": "l_suppkey",
        "quantity": "l_quantity",
    },
)
