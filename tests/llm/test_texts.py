"""Operators on whole texts: against brute force, the libraries, and DuckDB."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from loomgraph.llm import audio, license_scan, near_dup, packing, sentencepiece_codec, simhash, suffix_dedup, toxicity
from loomgraph.llm.queries import BYTE_BPE, PIECE_MODEL

from .fixtures import documents, rows, words


def collected(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, str(r["doc_id"])))


def expected(fn):
    return sorted(((r[0], fn(r[1] or "")) for r in rows()), key=lambda r: (r[0] is None, str(r[0])))


# audio


def test_audio_payload_and_features(spark):
    got = collected(audio.clips(documents(spark)))
    for r, (doc_id, raw) in zip(got, expected(str.encode)):
        n = max(1, -(-len(raw) // 576)) * 576
        payload = raw + b"\xff" * (n - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (doc_id, len(raw), n)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes == n + 44 and audio.wav_read(audio.wav_write(payload)) == (audio.RATE_IN, payload)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256, r.feature) == r.feature
    assert audio.clips(documents(spark, [])).count() == 0


def test_audio_resampling_keeps_a_tone_and_chunks_agree():
    t = np.arange(24_000)
    x = np.sin(2 * np.pi * 440 * t / audio.RATE_IN).astype(np.float32)
    y = audio.resample(x, audio.filter_bank())
    spectrum = np.abs(np.fft.rfft(y))
    assert len(y) == 16_000 and abs(spectrum.argmax() * audio.RATE / len(y) - 440) < 1
    a, raw = audio.Analyser(), np.random.default_rng(0).integers(0, 256, 576 * 1500, dtype=np.uint8).tobytes()
    whole = np.concatenate(list(a.log_mel(raw)))
    small, audio.CHUNK_FRAMES = audio.CHUNK_FRAMES, 192
    try:
        assert np.allclose(np.concatenate(list(a.log_mel(raw))), whole, atol=1e-4)
    finally:
        audio.CHUNK_FRAMES = small


def test_audio_segments_need_the_high_mark_to_open():
    db = np.array([0, 0, 2, 1, 1, 0, 1, 0, 3, 0, 0, 0, 0.0])
    assert audio.Analyser.segments(db / 10).tolist() == [[2, 5], [8, 9]]


def plain_feature(payload):
    """The clip's features sample by sample: each output of the resampler and each mel band as a plain sum."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    bank, taps = audio.filter_bank().astype(float), audio.TAPS
    y = np.zeros(len(x) * 2 // 3)
    for k in range(len(y)):
        base, phase = divmod(k * 3, 2)
        y[k] = sum(bank[phase][t] * x[base - t] for t in range(taps) if 0 <= base - t < len(x))
    n = max(1, -(-len(y) // 128))
    y = np.concatenate([y, np.zeros(256 + n * 128)])
    mel = np.zeros((n, 24))
    for f in range(n):
        spectrum = np.abs(np.fft.rfft(y[f * 128 : f * 128 + 256] * np.hanning(256))) ** 2
        mel[f] = np.log10(spectrum @ audio.mel_matrix().astype(float) + 1e-6)
    db, on, spans = 10 * mel.mean(1), False, []
    for f, v in enumerate(db - np.median(db)):
        if not on and v > audio.HIGH_DB:
            on, spans = True, [*spans, [f, n]]
        elif on and v < audio.LOW_DB:
            on, spans[-1][1] = False, f
    return n, spans, mel


def test_audio_features_equal_plain_sums(spark):
    got = collected(audio.clips(documents(spark)))
    checked = 0
    for r, (_, raw) in zip(got, expected(str.encode)):
        if len(raw) > 4000:
            continue
        n, spans, mel = plain_feature(audio.pad_payload(raw))
        parts = dict(p.split("=") for p in r.feature.split(";"))
        assert int(parts["frames"]) == n and abs(float(parts["active_s"]) - sum(b - a for a, b in spans) * 128 / 8000) < 1e-3
        assert np.allclose([float(v) for v in parts["mel"].split(",")], mel.mean(0), atol=0.02) and np.allclose([float(v) for v in parts["sd"].split(",")], mel.std(0), atol=0.02)
        assert np.allclose(np.array([(s.start_s, s.end_s) for s in r.segments]).reshape(-1, 2), np.array(spans).reshape(-1, 2) * 128 / 8000)
        flat = np.concatenate([t.tensor for t in r.tensors]).reshape(-1, 24)
        assert np.allclose(flat[:n], mel, atol=0.05) and (flat[n:] == -6).all() and len(flat) % audio.TENSOR_FRAMES == 0
        assert r.tensors[0].start_s == 0 and abs(r.tensors[-1].end_s - n * 128 / 8000) < 1e-9
        checked += 1
    assert checked > 15


def test_audio_tensors_have_a_fixed_shape(spark):
    table = audio.clips(documents(spark)).selectExpr("explode(tensors) AS t").select("t.*").toArrow()
    tensors = audio.as_tensor_array(table.column("tensor"))
    assert tensors.to_numpy_ndarray().shape == (table.num_rows, audio.TENSOR_FRAMES, audio.MELS)
    assert all(a < b for a, b in zip(table.column("start_s").to_pylist(), table.column("end_s").to_pylist()))


# sentencepiece


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got = collected(sentencepiece_codec.encode_digests(documents(spark), PIECE_MODEL))
    for r, (doc_id, ids) in zip(got, expected(library.encode)):
        assert (r.doc_id, r.n_tokens) == (doc_id, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    full = collected(sentencepiece_codec.encode_ids(documents(spark), PIECE_MODEL))
    assert [list(r.ids) for r in full] == [e for _, e in expected(library.encode)] and [r.decoded for r in full] == [library.decode(e) for _, e in expected(library.encode)]


def test_sentencepiece_on_random_strings_and_ids():
    import sentencepiece

    library, codec, r = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL), sentencepiece_codec.Codec(PIECE_MODEL), random.Random(5)
    texts = ["".join(r.choice("aabbin  \t\nthe éß▁😀0") for _ in range(r.randrange(60))) for _ in range(2000)]
    assert codec.encode(texts) == [library.encode(t) for t in texts]
    for _ in range(500):
        ids = [r.randrange(3, 400) for _ in range(r.randrange(8))]
        assert codec.decode(ids) == library.decode(ids), ids


# packing


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    library, ours, r = Tokenizer.from_file(BYTE_BPE), packing.Tokens(BYTE_BPE), random.Random(3)
    library.encode_special_tokens = True
    texts = [t or "" for _, t, *_ in rows()] + ["".join(r.choice("ab' s'll1½ \n\tÉéſ中\x1c\x85\xa0,.!") for _ in range(r.randrange(40))) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing_is_gapless_and_tight(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    library.encode_special_tokens = True
    parts = packing.pack(documents(spark), BYTE_BPE, with_ids=True).toPandas()
    want = collections.Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in rows())
    got = collections.Counter()
    for doc_id, p in parts.groupby("doc_id", dropna=False):
        copies = 2 if doc_id == 4 else 1
        p = p.sort_values(["start"])
        ids = [i for part in p.ids.tolist()[::copies] for i in part]
        got[None if pd.isna(doc_id) else int(doc_id), tuple(ids)] += copies
    assert got == want
    for _, s in parts.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    assert parts.sequence_id.nunique() <= -(-parts.length.sum() // 1024) + 1
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(parts.ids, parts.ids_crc32))
    assert packing.pack(documents(spark, []), BYTE_BPE).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_patterns_use_every_length_once(seed):
    r = random.Random(seed)
    counts = {r.randrange(1, 1025): r.randrange(1, 50) for _ in range(r.randrange(1, 80))}
    used = collections.Counter()
    patterns = packing.best_two_fit(counts)
    for lengths, times in patterns:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += times
    assert used == counts
    assert packing.cuts(2500) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cuts(1024) == [(0, 1024)]


# simhash


def reference_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("limit", [4096, 2])
def test_simhash_components(spark, limit):
    base = words(300, 7)
    some = rows() + [(100 + k, base + " " + words(k, 8), "en", "s", 1, 1, 2, 3, "x", 4) for k in range(12)]
    got = collected(simhash.near_duplicates(documents(spark, some), bucket_limit=limit))
    order = sorted(some, key=lambda r: (r[0] is None, str(r[0])))
    prints = [reference_fingerprint(r[1] or "") for r in order]
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((r[0] for r, h in zip(order, group) if h == g and r[0] is not None), default=None) for g in group}
    assert [r.component_id for r in got] == [least[g] for g in group]
    kept = simhash.keep_one(documents(spark, some)).toPandas()
    assert sorted(kept.doc_id.dropna().astype(int)) == sorted({v for v in least.values() if v is not None}) and kept.doc_id.isna().sum() == 1


@pytest.mark.parametrize("keep", [simhash.keep_one, near_dup.keep_one])
def test_rows_that_share_a_doc_id_decide_for_themselves(spark, keep):
    b, z = words(40, 1), words(40, 2)
    some = [(2, b), (4, z), (4, b), (4, z), (None, z), (None, words(40, 3)), (None, words(40, 3)), (7, None), (8, "")]
    got = keep(documents(spark, [(*r, "en", "s", 1, 1, 2, 3, "x", 4) for r in some]))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, b), (4, z), (None, words(40, 3)), (7, None)], key=str)
    assert got.schema == documents(spark).schema


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


# suffix arrays


def test_difference_cover_order_is_the_suffix_array():
    r = random.Random(2)
    for _ in range(1500):
        s = np.array([r.randint(0, r.choice([1, 2, 50])) for _ in range(r.randint(1, 40))])
        assert suffix_dedup.difference_cover_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute_removal(raws, n):
    seen = collections.Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


def brute_words(texts, n):
    """For each text, which of its words a run of n words covers that starts anywhere else too."""
    per = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    seen = collections.Counter(tuple(w[i : i + n]) for w in per for i in range(len(w) - n + 1))
    out = []
    for w in per:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


def passages(n=90):
    """One passage in many contexts, others in two or three, and copies."""
    common, r = words(70, 600), random.Random(9)
    some = [words(r.randrange(5, 120), 700 + k) + " " + common + " " + words(r.randrange(5, 60), 900 + k) for k in range(n)]
    some += [words(60, 1200 + k) + " " + words(55 + k % 9, 1300 + k // 3) + ". " + words(40, 1400 + k) for k in range(n)]
    return some + some[:3] + [words(47, 1), words(47, 1), words(48, 2), words(48, 2)]


@pytest.mark.parametrize("bucket", [256, 2])
def test_repeated_strings_go(spark, bucket, monkeypatch):
    """Over the odd rows, and over passages dealt into many small batches; with buckets of two rows nearly all go by hashes."""
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", ((suffix_dedup.BYTES,), bucket))
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 1 if bucket == 256 else 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        some = rows() + [(1000 + k, t, "en", "s", 1, 1, 2, 3, "x", 4) for k, t in enumerate(passages())]
        got = collected(suffix_dedup.remove_digests(documents(spark, some).repartition(13)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = sorted(((r[0], r[1] or "") for r in some), key=lambda r: (r[0] is None, str(r[0])))
    byte, word = brute_removal([t.encode() for _, t in order], 400), brute_words([t for _, t in order], 48)
    assert sum(g.any() for g in word) > 150 and sum(g.any() for g in byte) > 80
    for r, (doc_id, text), gone, covered in zip(got, order, byte, word):
        raw = text.encode()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
        assert (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (doc_id, len(raw), int(gone.sum()), runs, kept)
        assert r.passage_words == covered.sum()


def test_repeated_passages_of_words_go(spark):
    some = rows() + [(1000 + k, t, "en", "s", 1, 1, 2, 3, "x", 4) for k, t in enumerate(passages())]
    df = documents(spark, some)
    out = suffix_dedup.remove_text(df, suffix_dedup.WORDS)
    assert out.schema == df.schema
    order = [r for r in some if r[0] is not None]
    want = collections.Counter()
    for r, gone in zip(some, brute_words([r[1] or "" for r in some], 48)):
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        want[r[0], tuple(x for x, g in zip(w, gone) if not g)] += 1
    got = collections.Counter((r.doc_id, tuple(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in out.collect())
    assert got == want and len(order) < len(some)


def test_words_don_t_depend_on_parts(monkeypatch):
    raw = ("  " + words(3000, 1) + "\n" + "z" * 5000 + " end ").encode()
    whole = suffix_dedup.word_edges(raw)
    monkeypatch.setattr(suffix_dedup, "PART", 100)
    assert all((a == b).all() for a, b in zip(whole, suffix_dedup.word_edges(raw)))


def test_removal_keeps_columns_and_rows(spark):
    df = documents(spark)
    out = suffix_dedup.remove_text(df)
    assert out.schema == df.schema and out.count() == df.count()
    assert suffix_dedup.remove_digests(documents(spark, [])).count() == 0


# licenses


WRAPPED = [
    "x\nRedistribution and use in source and binary forms, with or without\n * modification, are permitted provided that",
    "This is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL version",
    "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software and",
    "redistribution and use in source\n\n\n\nand binary forms, with or without modification",
]


def test_licenses_equal_sql(spark):
    got = license_scan.scan(documents(spark)).toPandas()
    con = duckdb.connect()
    docs = pd.DataFrame([(r[0], r[1]) for r in rows()], columns=["doc_id", "text"])
    docs["doc_id"] = docs["doc_id"].astype("Int64")
    con.register("documents", docs)
    want = con.execute(license_scan.scan_sql()).df()
    key = list(want.columns)
    canon = lambda d: sorted(tuple(str(None if pd.isna(v) else v if isinstance(v, str) else float(v)) for v in r) for r in d[key].itertuples(index=False))
    assert canon(got) == canon(want)
    assert license_scan.scan(documents(spark, [])).count() == 0
    by_id = got.set_index("doc_id")
    wrapped = license_scan.scan(documents(spark, [(k, t, "en", "s", 1, 1, 2, 3, "x", 4) for k, t in enumerate(WRAPPED)])).toPandas().set_index("doc_id").sort_index()
    assert wrapped.labels.tolist() == ["bsd", "mpl-2.0", "mit", ""]
    assert by_id.loc[11, "labels"] == "apache-2.0,reserved" and by_id.loc[12, "n_base"] == 3 and by_id.loc[13, "first_word"] == 7


# toxicity


def toxic_table(spark, n=600):
    docs, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        docs.append((k, words(60, k) + (" awful creature begone " if bad else " fine day") + words(20, k + 1), "en", "s", 1, 1, 2, 3, "x", 4))
        labels.append((k, 1, int(bad)))
    return documents(spark, docs), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_separates_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.score_documents(docs, labels).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert ((held.predicted == 1) == (held.doc_id % 4 == 0)).mean() > 0.98 and got.score.between(0, 1).all()
    w = toxicity.fit(docs, labels)
    assert 0 < len(w[0]) < 500
    kept = toxicity.reject(docs, w)
    assert kept.schema == docs.schema and set(kept.toPandas().doc_id) == set(got[got.predicted == 0].doc_id)


def reference_ftrl(examples, epochs):
    """FTRL-proximal, one coordinate at a time, as published: w from z and n, then n and z from the gradient."""
    z, n, bias = collections.defaultdict(float), collections.defaultdict(float), 1 << toxicity.BITS

    def weight(i):
        l1 = 0.0 if i == bias else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for features, y in examples:
            w = {i: weight(i) for i in features}
            p = 1 / (1 + np.exp(-max(-35.0, min(35.0, sum(w.values())))))
            g = (p - y) * (toxicity.POSITIVE_WEIGHT if y else 1)
            for i in features:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z) if weight(i)}


def test_toxicity_training_and_scores_equal_plain_ftrl(spark):
    """The query's scores against features by sets of words, pairs and skip-pairs, and FTRL by its definition."""
    docs, labels = toxic_table(spark, 150)
    text = {r.doc_id: r.text for r in docs.collect()}
    hashed = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(text) AS k").collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None}
    names = {}

    def features(t):
        w = [toxicity.words(x.encode())[0] for x in re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower() if t.isascii() else "".join(c.lower() if c < "\x80" else c for c in t))]
        for k in range(len(w)):
            names[int(w[k]) >> (64 - toxicity.BITS)] = 1
        near = [toxicity._mix(np.array([a]) * toxicity.PAIR + b)[0] for a, b in zip(w, w[1:])]
        far = [toxicity._mix(np.array([a]) * toxicity.SKIP + b)[0] for a, b in zip(w, w[2:])]
        return sorted({int(h) >> (64 - toxicity.BITS) for h in [*w, *near, *far]}) + [1 << toxicity.BITS]

    with np.errstate(over="ignore"):
        per = {d: features(t) for d, t in text.items()}
    chosen = sorted((hashed[d], truth[d], d) for d in text if d in truth and zlib.crc32(str(d).encode()) % 3 != 1)
    w = reference_ftrl([(per[d], y) for _, y, d in chosen], toxicity.EPOCHS)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    assert len(w) > 1
    for d, f in per.items():
        assert abs(got[d] - 1 / (1 + np.exp(-sum(w.get(i, 0.0) for i in f)))) < 1e-9


def test_toxicity_odd_rows(spark):
    _, labels = toxic_table(spark, 40)
    got = toxicity.score_documents(documents(spark), labels).toPandas()
    assert len(got) == len(rows()) and got.score.notna().all()
    none = toxicity.score_documents(documents(spark), labels.limit(0)).toPandas()
    assert (none.score == 0).all() and (none.predicted == 0).all()
    assert toxicity.score_documents(documents(spark, []), labels).count() == 0


def test_word_hashes_don_t_depend_on_parts(monkeypatch):
    raw = words(3000, 1).encode()
    whole = toxicity.words(raw)
    toxicity._tables.clear()
    monkeypatch.setattr(toxicity, "PART", 1000)
    assert (toxicity.words(raw) == whole).all()
    toxicity._tables.clear()
