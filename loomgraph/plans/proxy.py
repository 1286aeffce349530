"""The code graph's tables as views of the star-schema test tables, so that every operator can be held against SQL.

The same definitions stand in DuckDB SQL in PREFIX. Scores are exact binary fractions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ident
from ..schemas import Index


def proxy(spark: SparkSession, sf_dir: str) -> Index:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    supplier, part, lineitem, orders = read("supplier"), read("part"), read("lineitem"), read("orders")
    n_files, n_parts = supplier.count(), part.count()
    kind = F.col("s_suppkey") % 4
    files = supplier.select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("src/n"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"), F.when(kind == 0, ".ts").when(kind == 1, ".py").when(kind == 2, ".go").otherwise(".java")).alias("path"),
        F.when(kind == 0, "typescript").when(kind == 1, "python").when(kind == 2, "go").otherwise("java").alias("lang"),
    )
    key = F.col("p_partkey")
    s = part.select(
        key.alias("id"), (key % n_files).alias("file_id"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), (F.col("p_size") % 8).cast("string")).alias("name"),
        F.lower("p_type").alias("kind"), F.col("p_size").alias("s_line"), F.lit(0).alias("s_col"), (F.col("p_size") + key % 20).cast("int").alias("e_line"), F.lit(0).alias("e_col"),
        F.col("p_size").alias("name_s_line"), (key % 40).cast("int").alias("name_s_col"), (key % 3 == 0).alias("exported"), F.col("p_brand").alias("owner_type"),
        (key % 5 == 0).alias("is_static"), (key % 7 == 0).alias("is_abstract"), (F.col("p_size") % 4).alias("param_count"), (key % 11 == 0).alias("variadic"),
    )
    paths = files.select(F.col("id").alias("file_id"), "path")
    symbols = s.join(paths, "file_id").withColumn("moniker", ident.moniker(F.col("path"), F.col("owner_type"), F.col("name"), F.col("kind"), F.col("s_line"), F.col("name_s_col"))).drop("path")
    tax, discount = F.round(F.col("l_tax") * 100).cast("int") % 3, F.round(F.col("l_discount") * 100).cast("int")
    occurrences = lineitem.select(
        (F.col("l_orderkey") * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"),
        F.col("l_partkey").alias("symbol_id"), F.col("l_suppkey").alias("file_id"), (F.col("l_orderkey") % 500 + 1).cast("int").alias("s_line"), F.col("l_linenumber").alias("s_col"),
        (F.col("l_orderkey") % 500 + 1).cast("int").alias("e_line"), (F.col("l_linenumber") + 4).alias("e_col"),
        F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "reference").when(F.col("l_linestatus") == "F", "extends").otherwise("implements").alias("role"),
        F.when(F.col("l_linenumber") != 1, (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % n_parts).alias("enclosing_id"),
        F.when(tax == 0, "syntactic").when(tax == 1, "scoped").otherwise("typed").alias("provenance"),
        F.when(discount == 10, F.lit(0.0625)).otherwise((16 - discount).cast("double") / 16).alias("confidence"),
    )
    o = F.col("o_orderkey")
    named = symbols.select(F.col("id").alias("_p"), "name")
    refs = orders.withColumn("_p", o * 13 % n_parts).join(named, "_p").select(
        o.alias("id"), (F.col("o_custkey") % n_files).alias("file_id"), "name", F.when(o % 4 == 0, "extends").otherwise("call").alias("role"),
        (o % 1000).cast("int").alias("s_line"), (o % 7).cast("int").alias("s_col"), (o % 1000).cast("int").alias("e_line"), (o % 7 + 3).cast("int").alias("e_col"),
        F.when(o % 3 == 2, "this").alias("receiver"), F.lit(None).cast("string").alias("enclosing"), (o % 5).cast("int").alias("arg_count"), (o * 3 % n_parts).alias("enclosing_id"),
    )
    # within each ten files, each imports the one seven places on times itself; and each the same one of the ten before
    k = F.col("id")
    to = F.array(k - k % 10 + k * 7 % 10, F.greatest(k - 10, k % 10))
    imports = files.select(F.col("id").alias("file_id"), F.explode(to).alias("to_file")).where(F.col("to_file") < n_files).distinct()
    tree = files.select(F.col("id").alias("file_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("idx"))
    depth = F.floor(F.log2(F.col("idx") + 1) + 1e-9).cast("int")
    width = F.lit(1024) / F.pow(F.lit(2), depth)
    start = (F.col("idx") + 1 - F.pow(F.lit(2), depth)) * width
    scopes = tree.select("file_id", "idx", F.when(F.col("idx") > 0, F.floor((F.col("idx") - 1) / 2).cast("int")).alias("parent_idx"), start.cast("int").alias("s_line"), F.lit(0).alias("s_col"), (start + width - 1).cast("int").alias("e_line"), F.lit(0).alias("e_col"))
    scope_defs = symbols.select("id", "file_id", (F.col("id") % 8).cast("int").alias("scope_idx"), "name", F.when(F.col("id") % 4 != 0, F.col("moniker")).alias("symbol_moniker"))
    return Index(files, symbols, occurrences, refs, imports, scopes, scope_defs)


#: The same tables in DuckDB SQL.
PREFIX = """
WITH RECURSIVE nf AS (SELECT count(*) AS n FROM supplier), np AS (SELECT count(*) AS n FROM part),
files AS (SELECT CAST(s_suppkey AS BIGINT) AS id,
  'src/n' || CAST(s_nationkey AS VARCHAR) || '/s' || CAST(s_suppkey AS VARCHAR) || CASE s_suppkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' ELSE '.java' END AS path,
  CASE s_suppkey % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'go' ELSE 'java' END AS lang FROM supplier),
sy AS (SELECT p_partkey AS id, p_partkey % (SELECT n FROM nf) AS file_id, replace(p_name, ' ', '_') || '_' || CAST(p_size % 8 AS VARCHAR) AS name, lower(p_type) AS kind,
  CAST(p_size AS INT) AS s_line, 0 AS s_col, CAST(p_size + p_partkey % 20 AS INT) AS e_line, 0 AS e_col, CAST(p_size AS INT) AS name_s_line, CAST(p_partkey % 40 AS INT) AS name_s_col,
  p_partkey % 3 = 0 AS exported, p_brand AS owner_type, p_partkey % 5 = 0 AS is_static, p_partkey % 7 = 0 AS is_abstract, CAST(p_size % 4 AS INT) AS param_count, p_partkey % 11 = 0 AS variadic FROM part),
symbols AS (SELECT sy.*, path || '#`' || owner_type || '`#' || name || '.@' || CAST(s_line AS VARCHAR) || ':' || CAST(name_s_col AS VARCHAR) AS moniker FROM sy JOIN files f ON f.id = sy.file_id),
occ AS (SELECT l_orderkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS id, l_partkey AS symbol_id, l_suppkey AS file_id, CAST(l_orderkey % 500 + 1 AS INT) AS s_line, CAST(l_linenumber AS INT) AS s_col,
  CASE WHEN l_returnflag = 'A' THEN 'call' WHEN l_returnflag = 'N' THEN 'reference' WHEN l_linestatus = 'F' THEN 'extends' ELSE 'implements' END AS role,
  CASE WHEN l_linenumber <> 1 THEN (l_orderkey * 7 + l_linenumber) % (SELECT n FROM np) END AS enclosing_id,
  CASE CAST(round(l_tax * 100) AS INT) % 3 WHEN 0 THEN 'syntactic' WHEN 1 THEN 'scoped' ELSE 'typed' END AS provenance,
  CASE CAST(round(l_tax * 100) AS INT) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS prank,
  CASE WHEN CAST(round(l_discount * 100) AS INT) = 10 THEN CAST(0.0625 AS DOUBLE) ELSE CAST(16 - CAST(round(l_discount * 100) AS INT) AS DOUBLE) / 16 END AS confidence FROM lineitem),
refs AS (SELECT o_orderkey AS id, o_custkey % (SELECT n FROM nf) AS file_id, s.name AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'extends' ELSE 'call' END AS role, CAST(o_orderkey % 1000 AS INT) AS s_line,
  CAST(o_orderkey % 7 AS INT) AS s_col, CASE WHEN o_orderkey % 3 = 2 THEN 'this' END AS receiver, CAST(o_orderkey % 5 AS INT) AS arg_count, o_orderkey * 3 % (SELECT n FROM np) AS enclosing_id
  FROM orders JOIN symbols s ON s.id = o_orderkey * 13 % (SELECT n FROM np)),
imports AS (SELECT DISTINCT id AS file_id, to_file FROM (SELECT id, unnest([id - id % 10 + id * 7 % 10, greatest(id - 10, id % 10)]) AS to_file FROM files) WHERE to_file < (SELECT n FROM nf)),
sc0 AS (SELECT f.id AS file_id, CAST(i AS INT) AS idx, CAST(floor(log2(i + 1) + 1e-9) AS INT) AS d FROM files f, range(8) t(i)),
scopes AS (SELECT file_id, idx, CASE WHEN idx > 0 THEN (idx - 1) // 2 END AS parent_idx, CAST((idx + 1 - pow(2, d)) * (1024 / pow(2, d)) AS INT) AS s_line, CAST((idx + 2 - pow(2, d)) * (1024 / pow(2, d)) - 1 AS INT) AS e_line FROM sc0),
scope_defs AS (SELECT id, file_id, CAST(id % 8 AS INT) AS scope_idx, name, CASE WHEN id % 4 <> 0 THEN moniker END AS symbol_moniker FROM symbols),
edges AS (SELECT o.*, t.name AS target, coalesce(c.name, '(top level)') AS source, f.path AS path FROM occ o JOIN symbols t ON t.id = o.symbol_id JOIN files f ON f.id = o.file_id LEFT JOIN symbols c ON c.id = o.enclosing_id)
"""
