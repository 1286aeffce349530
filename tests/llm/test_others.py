"""URL filters, chat, neighbours, components, and the pipeline."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann, chat, common, graph, near_dup, packing, queries, simhash, suffix_dedup, toxicity, url_filter

from .fixtures import words


def test_components_equal_union_find(spark):
    r = random.Random(1)
    pairs = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)]
    parent = {n: n for p in pairs for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent if any(n in p and p[0] != p[1] for p in pairs)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_cut_leaves_no_shuffle_files(spark):
    """Without waiting for the driver to collect its garbage: the table is referred to all the time."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    df = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    old = files()
    out = common.cut(df)
    for _ in range(50):
        if files() <= old:
            break
        time.sleep(0.1)
    assert files() <= old and spark.conf.get(common.FILE_CLEANUP, None) is None
    assert sorted(out.collect()) == sorted(df.collect()) and df.collect() == df.collect()  # the table itself can still be run


URLS = [
    (1, "http://A.Example.COM/en/7x?q=1", "a.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "https://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
    (3, "https://shop.net/de/1#t", "shop.net", "/de/1", "net/de/", "block"), (4, "https://x.example.net/de/81", "x.example.net", "/de/81", "example.net/de/8", "allow"),
    (5, "https://dot.com?/en/", "dot.com", "", None, None), (6, None, "", "", None, None), (7, "no scheme/en/", "", "", None, None), (8, "", "", "", None, None),
    (9, "x://notcom/en/", "notcom", "/en/", None, None), (10, "a://b://c.org/es/", "b:", "//c.org/es/", None, None), (None, "http://w.org/es/" + "y" * 5000, "w.org", "/es/" + "y" * 5000, "org/es/", "block"),
    (2, "https://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(r[0], r[1], "h", "v") for r in URLS], "page_id long, url string, host string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_filter.judge(df).collect()}
    assert got == {(r[0], *r[2:]) for r in URLS}
    assert url_filter.judge(df).where("verdict NOT IN ('allow', 'block')").count() == 0
    assert url_filter.judge(df.limit(0)).count() == 0


def test_boosted_trees_learn_and_compile(spark):
    r = random.Random(0)
    rows = [(tuple(r.randrange(url_filter.BINS) for _ in url_filter.FEATURES), 1.0) for _ in range(400)]
    rows = [(b, w, float(b[0] > 5 and b[4] < 7)) for b, w in rows]
    prior, trees = url_filter.boost(rows)
    margin = lambda b: prior + sum(url_filter.value(t, b) for t in trees)
    assert np.mean([(margin(b) > 0) == bool(y) for b, _, y in rows]) > 0.97
    df = spark.createDataFrame([b for b, *_ in rows], ", ".join(f"{f} int" for f in url_filter.FEATURES))
    total = sum((url_filter.as_column(t) for t in trees[1:]), url_filter.as_column(trees[0]))
    assert np.allclose([r[0] for r in df.select(total).collect()], [margin(b) - prior for b, *_ in rows])


def plain_features(urls):
    """Bins of (url, host, path, verdict or None, fold) rows, by the features' definitions."""
    from collections import Counter
    from math import log2

    suffix = lambda h: h.rpartition(".")[2]
    n = Counter(suffix(u[1]) for u in urls)
    out = []
    for url, host, path, verdict, fold in urls:
        others = [v for _, h, _, v, f in urls if v and suffix(h) == suffix(host) and not (verdict and f == fold)]
        rate = (others.count("block") + 1) / (len(others) + 2)
        chars = Counter(url)
        entropy = -sum(c / len(url) * log2(c / len(url)) for c in chars.values()) if url else 0
        raw = [len(url) / 8, path.count("/"), sum(c in "0123456789" for c in url) * 30 / max(1, len(url)), entropy * 2.5, len(re.findall("[?&][^=&#]+=", url)), host.count(".") + 1, -log2(n[suffix(host)] / len(urls)) * 2, rate * 10]
        out.append(tuple(int(min(max(x // 1, 0), url_filter.BINS - 1)) for x in raw))
    return out


def test_url_verdicts_equal_plain_boosting(spark):
    """The query's margins against features by definition, one row per labelled URL, and the trees' values row by row."""
    r = random.Random(5)
    urls = [f"http://{r.choice(['a', 'b.c', 'shop'])}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'es'])}/{r.randrange(1000)}{r.choice(['', '?q=1', '/x'])}" for _ in range(400)]
    urls += urls[:1] * 50 + [None, "", "no scheme"]
    df = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(urls)], "page_id long, url string, suffix string, n int")
    rows = [(x.url or "", x.host, x.path, x.fit and x.fit.verdict, x.fold, tuple(x[f] for f in url_filter.FEATURES)) for x in url_filter.featured(df).collect()]
    assert [x[-1] for x in rows] == plain_features([x[:-1] for x in rows])
    labelled = {x[0]: (x[-1], x[3]) for x in rows if x[3]}
    ones = sum(v == "block" for _, v in labelled.values())
    weight = {"block": len(labelled) / 2 / ones, "allow": len(labelled) / 2 / (len(labelled) - ones)}
    counts = {}
    for b, v in labelled.values():
        w = counts.setdefault(b, [0.0, 0.0])
        w[0] += weight[v]
        w[1] += weight[v] * (v == "block")
    prior, trees = url_filter.boost(sorted((b, *w) for b, w in counts.items()))
    margin = {x[0]: prior + sum(url_filter.value(t, x[-1]) for t in trees) for x in rows}
    got = url_filter.judge(df).collect()
    assert len(got) == len(urls) and len(trees) == url_filter.TREES
    for x in got:
        want = margin[urls[x.page_id] or ""]
        assert abs(x.margin - want) < 1e-6 and x.verdict == (x.verdict if x.rule else "block" if want >= 0 else "allow")
    nulls = url_filter.judge(df.where("url IS NULL")).collect()
    assert [(x.host, x.path, x.rule, x.verdict) for x in nulls] == [("", "", None, "allow")]


def test_native_operators_run_no_python(spark, tmp_path):
    df = spark.createDataFrame([(r[0], r[1]) for r in URLS], "page_id long, url string")
    df.write.parquet(str(tmp_path / "pages"))
    plan = url_filter.judge(spark.read.parquet(str(tmp_path / "pages")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


CHAT = "conv_id long, turn long, text string, role string"


def conversations(n=80):
    r, out = random.Random(4), []
    for c in range(n):
        for t in range(r.randrange(1, 9)):
            role = "system" if t == 0 and c % 3 == 0 else ("user" if (t - (c % 3 == 0)) % 2 == 0 else "assistant")
            mark = r.choice(["", {"system": "System: ", "user": "User: ", "assistant": "### Assistant\n"}[role]])
            out.append((c, t, mark + words(r.randrange(1, 30), c * 10 + t) + ("?" if role == "user" else "."), role))
    return out


def test_chat_turns_and_rendering(spark):
    rows = conversations()
    df = spark.createDataFrame([(c, t, x, r, "clash", 1) for c, t, x, r in rows], CHAT + ", state string, line int")
    model = chat.fit(chat.lines(df, ["role"]))
    out = chat.decode(chat.lines(df.withColumnRenamed("role", "true"), ["true"]), model, "true").toPandas()
    assert len(out) == sum(x.count("\n") + 1 for _, _, x, _ in rows)
    assert (out.role == out.true).mean() > 0.95 and (out.begins == (out.line == 0)).mean() > 0.95
    for _, lines in out.sort_values(["conv_id", "turn", "line"]).groupby("conv_id"):
        text = "".join(lines.rendered)
        turns = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", text, re.S)
        assert "".join(f"<|{r}|>\n{b}<|end|>\n" for r, b in turns) == text and len(turns) == lines.begins.sum()
        assert "".join(b for _, b in turns).split() == " ".join(lines.body).split()
    assert chat.split_marker("Human: hi") == (2, "hi") and chat.split_marker("answers: hi")[0] == 0
    assert chat.split_marker("### Assistant") == (3, "") and chat.split_marker("a")[0] == 0


def best_path(model, emission):
    """The best sum over all state sequences."""
    from itertools import product

    best = (-np.inf, None)
    for path in product(range(chat.STATES), repeat=len(emission)):
        total = model.first[path[0]] + sum(emission[k][s] for k, s in enumerate(path)) + sum(model.step[a, b] for a, b in zip(path, path[1:]))
        best = (total, path) if total > best[0] else best
    return best[1]


def test_viterbi_is_the_best_of_all_paths():
    r = np.random.default_rng(1)
    for n in range(1, 6):
        model = chat.Model(r.random(chat.STATES) * 5, r.random((chat.STATES, chat.STATES)) * 5, [r.random((chat.STATES, k)) * 5 for k in chat.SIZES])
        emission = model.emission([("Q: " if k % 3 == 0 else "") + words(k + 1, k) for k in range(n)])
        assert tuple(chat.viterbi(model, emission)) == best_path(model, emission)


@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_one_long_conversation_over_all_tasks_is_plain_viterbi(spark, tasks, monkeypatch):
    """Neither the model nor the states depend on how many tasks the lines are dealt to."""
    monkeypatch.setattr(chat, "shuffle_partitions", lambda spark: tasks)
    monkeypatch.setattr(chat, "CHUNK", 5)
    rows = [(7 if k < 150 else k, k, r[2], r[3]) for k, r in enumerate(conversations(60))]
    df = spark.createDataFrame(rows, CHAT)
    ordered = chat.lines(df, ["role"])
    assert ordered.rdd.getNumPartitions() == tasks
    model = chat.fit(ordered)
    flat = [(c, t, k, x, role) for c, t, text, role in rows for k, x in enumerate(text.split("\n"))]
    first, step, tables = np.zeros(chat.STATES), np.zeros((chat.STATES, chat.STATES)), [np.zeros((chat.STATES, n)) for n in chat.SIZES]
    for k, (c, _, line, x, role) in enumerate(flat):
        s = 2 * chat.ROLES.index(role) + (line > 0)
        for t, v in zip(tables, chat.observe(x)):
            t[s, v] += 1
        if k and flat[k - 1][0] == c:
            step[2 * chat.ROLES.index(flat[k - 1][4]) + (flat[k - 1][2] > 0), s] += 1
        else:
            first[s] += 1
    plain = chat.Model(first, step, tables)
    assert np.array_equal(plain.first, model.first) and np.array_equal(plain.step, model.step) and all(np.array_equal(a, b) for a, b in zip(plain.tables, model.tables))
    found = chat.decode(ordered.withColumnRenamed("role", "true"), model, "true").orderBy("turn", "line").collect()
    want = []
    for conv in dict.fromkeys(f[0] for f in flat):
        want += chat.viterbi(plain, plain.emission([f[3] for f in flat if f[0] == conv])).tolist()
    assert [(r.role, r.begins) for r in found] == [(chat.ROLES[s // 2], s % 2 == 0) for s in want]


def test_chat_odd_rows(spark):
    odd = [(None, None, None, None), (None, 1, "", "user"), (1, 1, "a\nb", "user"), (1, 1, "a\nb", "user"), (2, 0, "q: " + "word " * 50_000, "other")]
    df = spark.createDataFrame(odd, CHAT)
    model = chat.fit(chat.lines(df, ["role"]))
    got = chat.decode(chat.lines(df.withColumnRenamed("role", "t"), ["t"]), model, "t").collect()
    assert sorted(r.conv_id or 0 for r in got) == [0, 0, 1, 1, 1, 1, 2] and all(r.role in chat.ROLES for r in got)
    none = df.limit(0)
    assert chat.decode(chat.lines(none.withColumnRenamed("role", "t"), ["t"]), chat.fit(chat.lines(none, ["role"])), "t").count() == 0


def brute(rows, every, top):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            out[q] = sorted(((-float((a * b).sum()), i) for i, b in good if i != q))[:top]
    return out


@pytest.mark.parametrize("norms", ["equal", "uniform", "heavy", "one"])
def test_neighbours_are_found(spark, norms):
    r = np.random.default_rng(3)
    x = r.standard_normal((700, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= {"equal": 1, "uniform": r.uniform(0.5, 2, (700, 1)), "heavy": r.lognormal(0, 1, (700, 1)), "one": np.where(np.arange(700) == 77, 100, 1)[:, None]}[norms]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(k, rows[10][1]) for k in range(1000, 1060)]  # a large class of one vector
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (None, [1.0] * 16), (2020, [])]
    df = spark.createDataFrame([(*t, 1, 2, 3, "x", "y") for t in rows] + [(2040, [1.0] * 15, 1, 2, 3, "x", "y")], "vec_id long, embedding array<float>, id int, u int, w int, q string, v string")
    got = ann.nearest(df, block=128, trees=4).toPandas()
    want = brute([(i, v) for i, v in rows], 20, 20)
    assert set(got.query_id) == set(want)
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and (list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id)))
        exact = {i: -s for s, i in want[q]}
        hits += len(set(g.vec_id) & set(exact))
        assert all(abs(exact[i] - s) < 1e-9 for i, s in zip(g.vec_id, g.score) if i in exact)
    assert hits / (20 * len(want)) >= 0.9


def test_neighbour_rounds_write_fewer_tables(spark, monkeypatch):
    """Search rounds share jobs with the same result; a descent round meets its neighbours once, without a second table of live nodes."""
    written = []
    monkeypatch.setattr(ann, "cut", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or common.cut(df))
    x = np.random.default_rng(5).standard_normal((400, 8))
    nodes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    coded = common.cut(ann.quantised(nodes, 8))
    graph = ann.first_graph(coded, 8, 400, 6, 2, 32)
    written.clear()
    graph = ann.descend(graph, coded, 6, 12, 6)
    assert len(written) == 1 and "LeftSemi" not in written[0]
    own = ann.directions(nodes.where("id % 20 = 0"))
    found, tables = {}, {}
    for rounds in (ann.ROUNDS, 1):
        written.clear()
        found[rounds] = sorted(ann.search(graph, coded, own, 4, 64, 12, 4, rounds).collect())
        tables[rounds] = len(written) - 2  # without the packed nodes and the queries
    assert found[ann.ROUNDS] == found[1] and tables[ann.ROUNDS] == -(-tables[1] // ann.ROUNDS) < tables[1]


def test_neighbours_of_tiny_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(20, [1.0, 2.0])], schema)).count() == 0
    few = ann.nearest(spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.0, 1.0]), (22, [1.0, 1.0])], schema)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(20, 1, 22, 1.0), (20, 2, 21, 0.0)]


def test_pipeline_stages_take_effect(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    shared = words(130, 50)
    docs, labels = [], []
    for k in range(240):
        bad = k % 5 == 0
        text = words(80, k) + (" awful creature begone " if bad else " fine day ") + words(40, 1000 + k) + (shared if k % 7 == 1 else "")
        docs.append((k, text if k % 11 else words(90, 4), "en", "s", 1))
        labels.append((k, 1, int(bad and k % 11 != 0)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_array", "packing"]
    kept = {r.doc_id: r.text for r in toxicity.reject(read, toxicity.fit(read, spark.read.parquet(str(tmp_path / "labels.parquet")))).collect()}
    assert all((k % 5 != 0 or k % 11 == 0) for k in kept) and len(kept) > 180
    near = simhash.near_duplicates(spark.createDataFrame(list(kept.items()), "doc_id long, text string")).collect()
    kept = {r.doc_id: kept[r.doc_id] for r in near if r.doc_id == r.component_id}
    from .test_texts import brute_words

    order = sorted(kept)
    gone = brute_words([kept[k] for k in order], 48)
    assert any(g.any() for g in gone)
    split = {k: re.findall(r"\S+\s*", kept[k], re.A) for k in order}
    kept = {k: "".join(x for x, dead in zip(split[k], g) if not dead) for k, g in zip(order, gone)}
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    tokens = packing.Tokens(queries.BYTE_BPE)
    assert out.groupby("doc_id").length.sum().to_dict() == {k: len(tokens.encode(t)) // 4 + 1 for k, t in kept.items()}
    assert suffix_dedup.LENGTH == 400 and suffix_dedup.WORDS.length == 48


def edited(text, every, seed):
    """The text with one word in ``every`` replaced."""
    r, out = random.Random(seed), text.split()
    for k in range(r.randrange(every), len(out), every):
        out[k] = f"new{r.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("first", [4, 0])
def test_pipeline_near_duplicates_equal_brute_force_jaccard(spark, first):
    docs = {k: words(150, k) for k in range(40)}
    docs |= {100 + k: edited(docs[k % 40], (20, 40, 60, 90)[k % 4], k) for k in range(120)}
    docs |= {300 + k: edited(docs[7], 70, 500 + k) for k in range(30)}  # one large group
    docs |= {400: "", 401: " ", 402: "two words", 403: "TWO  words", 404: None}

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {k: shingles(t) for k, t in docs.items()}
    parent = {k: k for k in docs}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in docs:
        for b in docs:
            if a < b and root(a) != root(b) and (sets[a] == sets[b] or len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    df = spark.createDataFrame([*docs.items(), (None, "no id here")], "doc_id long, text string").repartition(3)
    expected = {root(k) for k in docs}
    assert 45 < len(expected) < 160
    got = [r.doc_id for r in near_dup.keep_one(df, first).collect()]
    assert None in got and len(got) == len(expected) + 1
    assert {k for k in got if k is not None} == expected
    if first == 4:  # the SimHash stage left more of them
        assert simhash.keep_one(df).count() > len(expected) + 20
        import corpus_pipeline

        assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()} == expected | {None}
    assert near_dup.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("local_edges", [0, 1000])
def test_components_grow(spark, local_edges):
    r = random.Random(5)
    steps = [[(r.randrange(60), r.randrange(60)) for _ in range(18)] for _ in range(3)] + [[]]
    roots, so_far = None, []
    for step in steps:
        so_far += step
        roots = graph.grown(roots, spark.createDataFrame(step, "a long, b long"), local_edges)
        want = {(x.node, x.root) for x in graph.components(spark.createDataFrame(so_far, "a long, b long")).collect()}
        assert sorted(map(tuple, roots.collect())) == sorted(want)


def test_pipeline_near_duplicates_go_through_simhash(spark):
    r = random.Random(3)
    texts = []
    for _ in range(5):
        words = [f"w{r.randrange(900)}" for _ in range(400)]
        texts += [" ".join(words), " ".join(words[:-1] + ["other"])]
    shingles = near_dup.shingler()
    sets = [shingles(t) for t in texts]
    at = {near_dup.node_of(s): k for k, s in enumerate(sets)}
    prints = [near_dup.fingerprint(s) for s in sets]
    close = {(i, j) for i in range(10) for j in range(i) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 4}
    per = near_dup.signed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {(max(at[x.a], at[x.b]), min(at[x.a], at[x.b])) for x in near_dup.hashed_pairs(per).collect()}
    assert len(close) >= 4 and got == close


def test_pipeline_near_duplicates_take_two_steps_at_every_size(spark, monkeypatch):
    texts = [edited(words(150, 1), (30, 40, 50, 70)[k % 4], k) for k in range(60)]  # buckets of many components
    shingles, calls, real = near_dup.shingler(), [], near_dup.verified
    sets = [shingles(t) for t in texts]
    monkeypatch.setattr(near_dup, "verified", lambda *x: calls.append(0) or real(*x))
    seen = set()
    for n, block in ((6, 256), (60, 256), (60, 7)):
        calls.clear()
        up = list(range(n))
        for _ in range(n):
            up = [min([up[i], *(up[j] for j in range(n) if near_dup.similar(sets[i], sets[j]))]) for i in range(n)]
        df = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")
        assert sorted(r.doc_id for r in near_dup.keep_one(df, 1, **({"block": block} if block != 256 else {})).collect()) == sorted(set(up))
        seen.add(len(calls))
    assert 5 < len(set(up)) < 55 and seen == {1}


def test_pipeline_near_duplicates_share_counts():
    r = np.random.default_rng(2)
    for n, pool in ((12, 40), (60, 5000), (3, 10)):
        s = [np.unique(r.integers(0, pool, 30, dtype=np.uint64)) for _ in range(n)]
        a, b = np.triu_indices(n, 1)
        assert near_dup.common(s, a, b).tolist() == [len(set(s[x].tolist()) & set(s[y].tolist())) for x, y in zip(a, b)]
