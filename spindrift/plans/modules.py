"""Small source texts of several shapes that queries put a part's number in, for the driver's tables hold no code.

A project is five parts in a row; each part gives the file of its own shape, and files use each other's names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V

MODELS = """from typing import TypeAlias
from base import Base

Alias{k}: TypeAlias = "list[int]"


class User{k}(Base):
    pass


class Order{k}Factory:
    pass


def make_user{k}(name):
    return User{k}(name)


def load_order{k}(row) -> "Order{k}":
    order = Order{k}Factory.create(row)
    return order
"""
SERVICE = """from models{k} import *
from .helpers import Helper{k} as Aid{k}


def identity{k}(value):
    return value


def fetch{k}(flag):
    user = make_user{k}("a")
    if flag:
        user = Guest{k}()
    return user


def wrap{k}():
    return identity{k}(fetch{k}(True))
"""
STORE = """import db


def first{k}(session):
    return session.query(Row{k}).first()


def get{k}(key):
    found = Row{k}.objects.get(key)
    other = found or None
    return [other, Meta{k}()]
"""
TESTS = """import pytest
from unittest.mock import MagicMock


@pytest.fixture
def client{k}():
    return Client{k}()


def test_one{k}(client{k}, *, extra=None):
    fake = MagicMock(spec=Client{k})
    run{k}(client{k}, mode=fake)
"""
APP = """import models{k} as m


def run{k}(target, mode=None):
    def inner(x):
        return Inner{k}()
    result = kept = inner(target) if mode else mode
    return result


main = run{k}(m.User{k}(), mode=Mode{k}.build())
"""
STORE_TS = """import { Account{k} } from './account{k}';

export class Store{k} {
  items: Account{k}[] = [];
  async find(key: string, limit = 10) {
    const found = lookup{k}(key);
    if (limit > 3) {
      const found = key;
      this.items.push(found);
    }
    return found;
  }
}
export function lookup{k}(name: string, deep?: boolean) {
  let out = new Account{k}(name);
  out.owner = name;
  return out;
}
const main = lookup{k}('a');
let count = 0;
"""
ACCOUNT_TS = """export class Account{k} {
  owner = '';
  constructor(name: string) { this.owner = name; }
}
export const used = lookup{k}('b', true);
"""
SHAPES = {"models": MODELS, "service": SERVICE, "store": STORE, "test_app": TESTS, "app": APP}


def project_files(s, d):
    """(project, path, module, source, place): a file for each part."""
    k = F.expr("CAST(p_partkey DIV 5 AS STRING)")
    shape = F.expr("CAST(p_partkey % 5 AS INT)")
    name = F.concat(F.get(F.array(*map(F.lit, SHAPES)), shape), k)
    source = F.replace(F.get(F.array(*map(F.lit, SHAPES.values())), shape), F.lit("{k}"), k)
    return V.spread(V.table(s, d, "part").select("p_partkey")).select(F.expr("p_partkey DIV 5").alias("project"), F.concat(F.lit("src/"), name, F.lit(".py")).alias("path"), name.alias("module"), source.alias("source"), F.col("p_partkey").alias("place"))


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """The rows of each whole project, `#` standing for its number."""
    values = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    names = columns.split(", ")
    texts = ", ".join(f"replace({c}, '#', CAST(project AS VARCHAR)) AS {c}" if any(isinstance(r[i], str) for r in rows) else c for i, c in enumerate(names))
    return f"SELECT project, {texts} FROM (SELECT p_partkey // 5 AS project FROM part GROUP BY 1 HAVING count(*) = 5), (VALUES {values}) t({columns})"


def typescript_files(s, d):
    """(project, path, source): two files for each part."""
    k = F.col("p_partkey").cast("string")
    each = F.explode(F.array(*[F.struct(F.concat(F.lit(f"src/{name}"), k, F.lit(".ts")).alias("path"), F.replace(F.lit(text), F.lit("{k}"), k).alias("source")) for name, text in (("store", STORE_TS), ("account", ACCOUNT_TS))]))
    return V.spread(V.table(s, d, "part").select("p_partkey")).select(F.col("p_partkey").alias("project"), each.alias("f")).select("project", "f.*")


def parts_sql(columns: str, rows: list[tuple]) -> str:
    """The rows of each part, `#` standing for its number."""
    return rows_sql(columns, rows).replace("SELECT p_partkey // 5 AS project FROM part GROUP BY 1 HAVING count(*) = 5", "SELECT p_partkey AS project FROM part")
