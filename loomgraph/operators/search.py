"""Symbol search: prefix terms with BM25 over name, kind and path, a subsequence fallback, and the final ranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schemas import MAX_RESULTS, Index, limited

#: Fixed values.
WEIGHTS = {"name": 10.0, "kind": 1.0, "path": 3.0}
K1, B = 1.2, 0.75
MOST_TERMS = 8


def terms(query: str) -> list[str]:
    return [t.lower() for t in re.findall("[A-Za-z0-9_]+", query) if len(t) >= 2][:MOST_TERMS]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def hits_in(tokens: Column, term: str) -> Column:
    """How often a term stands in a token list: a phrase whose last word is a prefix."""
    *head, last = [w for w in re.split("[^a-z0-9]+", term) if w] or [""]
    n = len(head)
    at = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n, F.lit(1)))

    def fits(i: Column) -> Column:
        ok = F.startswith(F.coalesce(F.try_element_at(tokens, i + n), F.lit("")), F.lit(last)) if last else F.lit(False)
        for k, w in enumerate(head):
            ok = ok & (F.try_element_at(tokens, i + k) == w)
        return F.coalesce(ok, F.lit(False))

    return F.size(F.filter(at, fits))


def bm25(index: Index, query: str) -> DataFrame:
    """(symbol columns, path, score): rows that hold any term; a lower score is better."""
    wanted = terms(query)
    rows = index.symbols.join(index.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    rows = rows.select("*", *[words(F.col(c)).alias("_" + c) for c in WEIGHTS])
    if not wanted:
        return rows.limit(0).withColumn("score", F.lit(0.0)).drop(*["_" + c for c in WEIGHTS])
    length = sum(F.size("_" + c) for c in WEIGHTS)
    counts = [sum(w * hits_in(F.col("_" + c), t) for c, w in WEIGHTS.items()) for t in wanted]
    rows = rows.select("*", length.alias("_length"), *[c.cast("double").alias(f"_t{k}") for k, c in enumerate(counts)])
    facts = rows.agg(F.count("*").alias("n"), F.avg("_length").alias("mean"), *[F.count_if(F.col(f"_t{k}") > 0).alias(f"d{k}") for k in range(len(wanted))]).first()
    import math

    score = F.lit(0.0)
    for k in range(len(wanted)):
        idf = max(1e-6, math.log((facts["n"] - facts[f"d{k}"] + 0.5) / (facts[f"d{k}"] + 0.5)))
        t = F.col(f"_t{k}")
        score = score - idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("_length") / float(facts["mean"] or 1)))
    some = F.lit(False)
    for k in range(len(wanted)):
        some = some | (F.col(f"_t{k}") > 0)
    kept = rows.where(some).withColumn("score", score)
    return kept.drop("_length", *["_" + c for c in WEIGHTS], *[f"_t{k}" for k in range(len(wanted))])


def subsequence_scan(index: Index, token: str) -> DataFrame:
    """Symbols whose lower-cased name has the token's characters in order, in id order."""
    rows = index.symbols.where(paths.subsequence(token.lower(), F.lower("name")))
    return rows.join(index.files.select(F.col("id").alias("file_id"), "path"), "file_id")


def tier(query: str, name: Column) -> Column:
    """0: the name is the query's letters and digits; 1: it holds them in order; else 2."""
    q = re.sub("[^A-Za-z0-9]", "", query).lower()
    return F.when(F.lower(name) == q, 0).when(paths.subsequence(q, F.lower(name)), 1).otherwise(2)


def search(index: Index, query: str, limit: int = 20) -> DataFrame:
    """Best ``limit`` symbols. The pool that is ranked holds four times as many, 40 at least."""
    limited(limit, MAX_RESULTS)
    pool_size = max(4 * limit, 40)
    pool = bm25(index, query).orderBy("score", "moniker").limit(pool_size)
    if len(terms(query)) == 1:
        more = subsequence_scan(index, terms(query)[0]).withColumn("score", F.lit(1.0)).orderBy("id").limit(pool_size)
        few = pool.agg(F.count("*").alias("n")).where(F.col("n") < limit)
        more = more.join(pool.select("moniker"), "moniker", "left_anti").join(F.broadcast(few), F.lit(True), "left_semi")
        pool = pool.unionByName(more, allowMissingColumns=True)
    return pool.withColumn("tier", tier(query, F.col("name"))).orderBy("tier", "score", "moniker").limit(limit)
