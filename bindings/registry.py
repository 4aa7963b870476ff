"""Query registry and the shared views of the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import tune, tune_size

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one scale."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def sized(t: Tables, name: str) -> Tables:
    """The tables, for a query whose shuffles have about as many rows as the table ``name``."""
    rows = getattr(t, name)
    tune_size(rows.sparkSession, rows.count())
    return t


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` with an optional DuckDB oracle."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def s(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def edges(t: Tables) -> DataFrame:
    """Supplier → part relations, one per line item."""
    c = F.col
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        s("s", c("l_suppkey")).alias("src"),
        s("p", c("l_partkey")).alias("dst"),
        c("l_returnflag").alias("kind"),
        c("l_linestatus").alias("confidence"),
        c("l_orderkey"),
        c("l_linenumber"),
        c("l_quantity"),
        c("l_shipdate"),
    )


EDGES = """e AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, 's' || l_suppkey AS src,
  'p' || l_partkey AS dst, l_returnflag AS kind, l_linestatus AS confidence, l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem)"""


def owners(t: Tables) -> DataFrame:
    """Suppliers belong to their nation, parts to their brand."""
    c = F.col
    return t.supplier.select(s("s", c("s_suppkey")).alias("id"), s("n", c("s_nationkey")).alias("owner")).unionByName(
        t.part.select(s("p", c("p_partkey")).alias("id"), c("p_brand").alias("owner"))
    )


OWNERS = """o AS (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS owner FROM supplier
  UNION ALL SELECT 'p' || p_partkey, p_brand FROM part)"""


def nodes(t: Tables) -> DataFrame:
    """Suppliers and parts as graph nodes with a group, a path, a kind and a confidence."""
    c = F.col
    places = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    return places.select(
        s("s", c("s_suppkey")).alias("id"),
        F.lit("function").alias("kind"),
        c("r_name").alias("group"),
        F.concat_ws("/", "r_name", "n_name", "s_name").alias("path"),
        F.when(c("s_acctbal") < 0, "inferred").otherwise("source").alias("confidence"),
        c("s_name").alias("label"),
    ).unionByName(
        t.part.select(
            s("p", c("p_partkey")).alias("id"),
            F.when(c("p_size") % 5 == 0, "external").otherwise("model").alias("kind"),
            c("p_brand").alias("group"),
            F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path"),
            F.when(c("p_size") % 10 == 0, "unresolved").otherwise("source").alias("confidence"),
            c("p_name").alias("label"),
        )
    )


NODES = """n AS (SELECT 's' || s_suppkey AS id, 'function' AS kind, r_name AS "group", concat_ws('/', r_name, n_name, s_name) AS path,
  CASE WHEN s_acctbal < 0 THEN 'inferred' ELSE 'source' END AS confidence, s_name AS label
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_size % 5 = 0 THEN 'external' ELSE 'model' END, p_brand, concat_ws('/', p_type, p_brand, p_name),
  CASE WHEN p_size % 10 = 0 THEN 'unresolved' ELSE 'source' END, p_name FROM part)"""


def page_paths(t: Tables) -> DataFrame:
    """Pages as files: host/path of the URL, without scheme, query and fragment."""
    address = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    return t.pages.select("page_id", F.regexp_replace(address, "/$", "").alias("path"), "url")


PAGES = r"""pg AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/$', '') AS path, url FROM pages)"""
