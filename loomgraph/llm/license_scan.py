"""License scans as an exact set-similarity join, in DataFrame functions only.

A text block is LINES consecutive lines, from every line on, so that a notice is seen whole where it wraps; its tokens are its
different words. A template matches a block that holds at least THRESHOLD of the template's words. Only words of the templates
matter. They are ordered by the number of lines that hold them, rarest first, counted over all lines. Of t words at least a
have to be shared, so a matching block holds one of the template's first t - a + 1 words (prefix filter), holds a template
words at least (length filter), and the places of the shared word on both sides leave room for a common words (positional
filter). What passes is verified by intersection. The templates are constants of the plan, so the join runs within each row
and nothing is shuffled but the counts.

Besides, fixed base phrases are counted wherever their words stand consecutively, across lines too.

Null texts are empty; empty texts have no words and no labels. Very long texts are read whole, line by line. Repeated rows get
equal results. Rows without a doc_id are kept. An empty table gives no rows. Other columns are not read. A notice that wraps
over more than LINES lines is found only if LINES of them hold enough of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

THRESHOLD, LINES = 0.8, 3
#: Phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and wording of the method's templates; a label may have several.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc0", "this work is dedicated to the public domain under cc0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every character below U+0080 but 0-9, a-z and the line end.
OUTSIDE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def least_shared(n: int, threshold: float = THRESHOLD) -> int:
    """Words of a template of n words that a block has to hold."""
    return next(k for k in range(n + 1) if k >= threshold * n - 1e-9)


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def base_columns(flat: Column) -> dict[str, Column]:
    """Counts and places of the base phrases. flat: the words, each with a space before and after it, so two between words."""
    n_words = F.when(flat == " ", 0).otherwise(F.floor(_count(flat, " ") / 2)).cast("long")
    places, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in BASE.items():
        find = " " + phrase.replace(" ", "  ") + " "
        there = F.contains(flat, F.lit(find))
        before = (_count(F.substring_index(flat, find, 1), " ") / 2).cast("long")
        after = (_count(F.substring_index(flat, find, -1), " ") / 2).cast("long")
        places += F.when(there, _count(flat, find)).otherwise(0)
        firsts.append(F.when(there, before))
        lasts.append(F.when(there, n_words - after - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    return {"n_words": n_words, "n_base": places, "first_word": F.least(*firsts), "last_word": F.greatest(*lasts), "base": F.array_compact(F.array(*labels))}


def matches(block: Column, words: list[str], need: int) -> Column:
    """Whether a block (its template words in the global order) can hold ``need`` of ``words``, in that order, by the filters."""
    n, size = len(words), F.size(block)
    room = F.lit(False)
    for i, w in enumerate(words[: n - need + 1]):
        j = F.array_position(block, w) - 1
        room = room | ((j >= 0) & (F.least(j, F.lit(i)) + 1 + F.least(F.lit(n - i - 1), size - j - 1) >= need))
    return (size >= need) & room


def scan(df: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per document.

    The templates are a short constant list; what comes to the driver and goes into plans is bounded by their words.
    score: 1 with a base phrase, else the best containment of a matching template, else 0.
    """
    sets = [(label, list(dict.fromkeys(wording.split()))) for label, wording in (TEMPLATES if templates is None else templates)]
    words = sorted({w for _, ws in sets for w in ws})
    known = F.array(*map(F.lit, words))
    clean = texts(df).select("doc_id", F.regexp_replace(F.translate("text", UPPER, LOWER), OUTSIDE, " ").alias("clean"))
    lines = clean.select("doc_id", "clean", F.transform(F.split("clean", "\n"), lambda x: F.array_intersect(F.split(x, " "), known)).alias("lines"))
    counted = {r["w"]: r["n"] for r in lines.select(F.explode(F.flatten("lines")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(words, key=lambda w: (counted.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    sets = [(label, sorted(ws, key=place.get), least_shared(len(ws), threshold)) for label, ws in sets]
    fewest = min(need for *_, need in sets)
    prefixes = F.array(*[F.lit(w) for w in sorted({w for _, ws, need in sets for w in ws[: len(ws) - need + 1]})])
    block = F.transform("lines", lambda x, i: F.array_distinct(F.flatten(F.slice("lines", i + 1, F.lit(LINES)))))
    live = F.filter(block, lambda b: (F.size(b) >= fewest) & F.arrays_overlap(b, prefixes))
    in_order = F.array(*map(F.lit, order))
    blocks = lines.select("doc_id", "clean", live.alias("live")).select("doc_id", "clean", F.transform("live", lambda b: F.array_intersect(in_order, b)).alias("blocks"))

    def best(ws: list[str], need: int) -> Column:
        near = F.filter("blocks", lambda b: matches(b, ws, need))
        shared = F.array_max(F.transform(near, lambda b: F.size(F.array_intersect(b, F.array(*map(F.lit, ws))))))
        return F.when(F.col("live_blocks") & (shared >= need), shared / len(ws))

    blocks = blocks.withColumn("live_blocks", F.size("blocks") > 0)
    flat = F.concat(F.lit(" "), F.regexp_replace(F.trim(F.regexp_replace("clean", "[ \n]+", " ")), " ", "  "), F.lit(" "))
    found = blocks.select("doc_id", flat.alias("flat"), *[best(ws, need).alias(f"t{k}") for k, (_, ws, need) in enumerate(sets)])
    hits = [F.col(f"t{k}") for k in range(len(sets))]
    labels = F.array_compact(F.array(*[F.when(h.isNotNull(), F.lit(label)) for h, (label, *_) in zip(hits, sets)]))
    digests = found.select("doc_id", F.when(F.col("flat") == "  ", " ").otherwise(F.col("flat")).alias("flat"), labels.alias("found"), F.array_max(F.array(*hits)).alias("best"))
    digests = digests.select("doc_id", "found", "best", *[c.alias(n) for n, c in base_columns(F.col("flat")).items()])
    return digests.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def scan_sql(table: str = "documents") -> str:
    """The scan's result in DuckDB SQL."""
    values = ", ".join(f"('{label}', {sorted(set(t.split()))!r})" for label, t in TEMPLATES)
    counts = [f"len(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {k}] = ' + repr(x) for k, x in enumerate(p.split()))}))" for p in BASE]
    at = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {k}] = ' + repr(x) for k, x in enumerate(p.split()))})" for p in BASE)
    base = ", ".join(f"CASE WHEN {c} > 0 THEN '{label}' END" for c, label in zip(counts, BASE.values()))
    return f"""
WITH t(label, words) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{OUTSIDE}', ' ', 'g') AS clean FROM {table}),
n AS (SELECT k, doc_id, list_filter(regexp_split_to_array(clean, '[ \\n]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT k, string_split(clean, chr(10)) AS ls FROM d),
b AS (SELECT k, list_distinct(string_split(array_to_string(ls[i : i + {LINES - 1}], ' '), ' ')) AS has FROM (SELECT k, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
f AS (SELECT k, list(DISTINCT label) AS found, max(len(list_intersect(has, words)) / len(words)) AS best FROM b JOIN t ON len(list_intersect(has, words)) >= ceil({THRESHOLD} * len(words) - 1e-9) GROUP BY k),
p AS (SELECT k, doc_id, w, flatten([{at}]) AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM p LEFT JOIN f USING (k)"""
