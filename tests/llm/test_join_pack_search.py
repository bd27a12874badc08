import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import ann, bfd_packing, gbt, license, ngram_join, packing, quality_classifier
from sparkloom.llm.tokens import Words, default_path

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, fp string, node long, start long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, -1, "x", -1, -1) for i, t in rows], SCHEMA)


def near_copies(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 30, 120, 400]))]
        for _ in range(r.choice([1, 2, 6])):
            ws = list(base)
            for _ in range(r.randrange(0, 1 + len(ws) // 20)):
                ws[r.randrange(len(ws))] = r.choice(vocabulary)
            rows.append((i, r.choice([" ", "  ", "\n"]).join(ws)))
            i += 1
    shared = " ".join(r.choice(vocabulary) for _ in range(60))
    rows += [(1000 + j, shared + " " + " ".join(r.choice(vocabulary) for _ in range(r.randrange(2, 40)))) for j in range(60)]
    return [*rows, (2000, None), (2001, ""), (2002, "\n \t"), (2003, "one"), (2004, "ONE"), (2005, "Été one"), (2006, "été one")]


@pytest.mark.parametrize("tile", [2048, 8])
@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_classes_match_brute_force(spark, tile, words, percent):
    rows = near_copies()
    got = {r[0]: (r[1], r[2]) for r in ngram_join.classes(table(spark, rows), words=words, percent=percent, tile=tile).collect()}
    assert got == brute.classes(rows, words, percent)


def test_classes_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r[0]: (r[1], r[2]) for r in ngram_join.classes(docs).collect()} == want


def test_classes_of_repeated_rows_and_null_ids(spark):
    t = "a b c d e f"
    rows = [(7, t), (7, t), (5, t), (None, t), (None, None), (9, "z y x w v")]
    got = Counter(map(tuple, ngram_join.classes(table(spark, rows)).collect()))
    assert got == Counter([(7, 3, 5), (7, 3, 5), (5, 3, 5), (None, 3, None), (None, 0, None), (9, 2, 9)])
    kept = ngram_join.distinct(table(spark, rows))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([5, 9, None, None]) and kept.columns == table(spark, []).columns
    assert ngram_join.classes(table(spark, [])).collect() == []


def test_texts_that_share_an_id_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, a), (7, b), (7, a), (3, b), (9, "short"), (None, a), (None, a)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __first string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in ngram_join.distinct(d, words=5, percent=80).collect())
    assert [t for i, t in got if not i] == [a, a] and sorted(t for i, t in got if i) == sorted([a, b, "short"])


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(500, 501)], "a long, b long")
    got = dict(map(tuple, ngram_join.components(edges).collect()))
    assert got == {i: 0 for i in range(200)} | {500: 500, 501: 500}


TEXTS = [(1, "Hello, World! it's 2024 don't  stop\n\nnow"), (2, None), (3, ""), (4, "x<|endoftext|>y <|startoftext|>"), (5, "ΟΔΟΣ ÉCOLE éa \x1c z w"), (6, "word " * 5000), (6, "word " * 5000)]


def test_word_encoder_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(default_path())
    words, texts = Words(default_path()), [t or "" for _, t in TEXTS]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == want


def whole(pieces, text):
    ids = Tokenizer.from_file(default_path()).encode(text or "", add_special_tokens=False).ids + [1]
    for p in pieces:
        part = np.array(ids[p["start"] : p["start"] + p["length"]], dtype="<u4")
        assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids)
    assert sorted((p["start"], p["length"]) for p in pieces)[0][0] == 0 and sum(p["length"] for p in pieces) == len(ids)


@pytest.mark.parametrize("op", [packing, bfd_packing])
def test_packing_is_lossless(spark, op):
    got = op.pack(table(spark, TEXTS)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in TEXTS[:5]:
        whole(by_doc[i], t)
    twice = Counter((r["start"], r["length"], r["ids_crc32"]) for r in by_doc[6])
    assert set(twice.values()) == {2}
    for parts in by_sequence.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
    if op is packing:
        assert all(r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0 for r in got)
    assert op.pack(table(spark, [])).collect() == []


def test_binary_cuts():
    assert packing.cuts(2048 * 2 + 5) == [2048, 2048, 4, 1] and packing.cuts(1) == [1]


def test_best_fit_decreasing_against_a_plain_search():
    r = random.Random(2)
    for _ in range(30):
        lengths = [r.randrange(1, 65) for _ in range(r.randrange(1, 80))]
        row, offset, rows = bfd_packing.best_fit_decreasing(lengths, 64)
        free = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [f for f in free if f >= lengths[i]]
            free.append((free.pop(free.index(min(fits))) if fits else 64) - lengths[i])
        used = Counter()
        for i, k in enumerate(row):
            used[k] += lengths[i]
        assert rows == len(free) and sorted(64 - u for u in used.values()) == sorted(free)
        assert all(u <= 64 for u in used.values()) and min(offset) == 0


def test_matrices_reset_positions(spark, tmp_path):
    bfd_packing.write(table(spark, TEXTS), str(tmp_path / "m"), width=64)
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    lost = Counter()
    for r in rows:
        ids, positions, cu = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4"), r["cu_seqlens"]
        assert len(ids) == len(positions) == 64 and cu[0] == 0 and len(cu) == len(r["doc_ids"]) + 1
        for a, b, d in zip(cu, cu[1:], r["doc_ids"]):
            assert positions[a:b].tolist() == list(range(b - a))
            lost[d] += b - a
    whole_tokens = {i: len(Tokenizer.from_file(default_path()).encode(t or "", add_special_tokens=False).ids) + 1 for i, t in TEXTS}
    assert lost == Counter({i: n * (2 if i == 6 else 1) for i, n in whole_tokens.items()})


def test_registered_packing_returns_matrices(spark, tmp_path):
    from sparkloom.llm.queries import QUERIES

    table(spark, TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op10_bfd_packing"](spark, str(tmp_path)).collect()
    parts = defaultdict(list)
    for r in rows:
        ids, positions, cu = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4"), r["cu_seqlens"]
        assert len(ids) == len(positions) == 2048 and len(cu) == len(r["doc_ids"]) + 1 == len(r["starts"]) + 1 == len(r["doc_tokens"]) + 1
        assert not ids[cu[-1] :].any() and not positions[cu[-1] :].any()
        for a, b, d, s, n in zip(cu, cu[1:], r["doc_ids"], r["starts"], r["doc_tokens"]):
            assert positions[a:b].tolist() == list(range(b - a))
            parts[d].append((s, n, ids[a:b].tolist()))
    for i, t in TEXTS[:5]:
        want = [*Tokenizer.from_file(default_path()).encode(t or "", add_special_tokens=False).ids, 1]
        got = sorted(parts[i])
        assert [x for _, _, ids in got for x in ids] == want and all(n == len(want) for _, n, _ in got)
    assert len(parts) == len({i for i, _ in TEXTS})


def test_buckets_hold_one_length(spark, tmp_path):
    packing.write_buckets(table(spark, TEXTS), str(tmp_path / "b"))
    got = spark.read.parquet(str(tmp_path / "b")).collect()
    assert got and all(len(r["ids"]) == r["length"] == r["bucket"] for r in got)


def test_ann_recall(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = ann.usable(d)
    got = defaultdict(list)
    for r in ann.neighbours(v, v.where("vec_id % 20 = 0"), least=64, rerank=0.2).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = {r["vec_id"]: np.array(r["v"]) for r in v.collect()}
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        assert all(s == pytest.approx(float(x[q] @ x[i]), abs=1e-12) for _, i, s in rows)
        best = sorted((-float(x[q] @ y), i) for i, y in x.items() if i != q)[:20]
        hits += len({i for _, i in best} & {i for _, i, _ in rows})
    assert len(got) == 25 and hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_search_finds_nine_tenths(spark, sf):
    from sparkloom.llm.queries import op7_ann

    folder = f"/root/testdata/{sf}"
    x = {r["vec_id"]: np.array(r["v"]) for r in ann.usable(spark.read.parquet(f"{folder}/embeddings.parquet")).collect()}
    ids = np.array(sorted(x))
    m = np.array([x[i] for i in ids])
    got = defaultdict(set)
    for r in op7_ann(spark, folder).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = sum(len(got[q] & {i for i in ids[np.argsort(-(m @ x[q]), kind="stable")].tolist()[:21] if i != q}) for q in got)
    assert len(got) == sum(i % 20 == 0 for i in x) and hits >= 0.9 * 20 * len(got)


def test_one_longer_vector_leaves_the_others(spark):
    d = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)] + [(99, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    assert ann.usable(d).count() == 50


def test_ann_with_many_equal_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16))
    x[r.random(3000) < 0.4] = x[0]
    v = ann.usable(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for row in ann.neighbours(v, v.where("vec_id % 20 = 0"), block=1000, least=100, rerank=0.3).collect():
        got[row["query_id"]].append(row["vec_id"])
    hits = 0
    for q, ids in got.items():
        s = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(3000), -s)).tolist() if i != q][:20]
        hits += len(set(best) & set(ids))
        if (x[q] == x[0]).all():
            assert sorted(ids) == sorted(best)
    assert len(got) == 150 and hits >= 0.9 * 20 * 150


def test_ann_beside_a_dense_group(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(4000, 48))
    dense = r.random(4000) < 0.35
    x[dense] = x[0] + 0.05 * r.normal(size=(int(dense.sum()), 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = ann.usable(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>"))
    got = defaultdict(set)
    for row in ann.neighbours(v, v.where("vec_id % 40 = 0"), block=2000, least=200).collect():
        got[row["query_id"]].add(row["vec_id"])
    other = [q for q in got if not dense[q]]
    best = {q: {i for i in np.argsort(-(x @ x[q]))[:21].tolist() if i != q} for q in other}
    assert len(got) == 100 and np.mean([len(best[q] & got[q]) / 20 for q in other]) >= 0.9


def test_ann_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(40, [0.0, 0.0]), (41, None), (42, [1.0, None]), (43, [float("nan"), 1.0]), (44, [float("inf"), 1.0]), (None, [1.0, 1.0]), (45, [2.0]), (3, [1.0, 0.0])]
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = ann.neighbours(v, v.where("vec_id % 20 = 0"), block=8).collect()
    for q in (0, 20):
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for i in range(22) if i != q][:20]
    none = ann.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert ann.neighbours(none, none).collect() == []


LICENSES = [
    "Released under the MIT License.",
    "the mit-license; MIT  License mit license",
    "Lincensed undr the Apache Licence, version 2.0",
    "GNU General\nPublic License and Apache License, Version 2.0",
    "Permission is hereby granted, free of charge, to any persn obtaining a copie of",
    "summit licenses general public", "", None, "é" * 40, "word " * 30000 + "mit license",
]


def test_many_phrases_in_one_text():
    got = license.scan("MIT License. " * 100_000)
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (200_000, 100_000, 0, 199_998)


def test_licenses_match_brute_force(spark):
    rows = [*enumerate(LICENSES), (0, LICENSES[0]), (None, "x")]
    for r in license.licenses(table(spark, rows)).collect():
        text = "x" if r["doc_id"] is None else LICENSES[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licenses(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    got = {r["doc_id"]: r for r in license.licenses(table(spark, rows)).collect()}
    assert got[2]["labels"] == "apache" and got[2]["spans"][0]["edits"] > 0 and got[4]["labels"] == "mit" and got[5]["labels"] == ""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: brute.licenses(r["text"]) for r in docs.collect()}
    assert {r[0]: tuple(r[1:6]) for r in license.licenses(docs).collect()} == want


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    truth = [(got[r["doc_id"]], r["quality"]) for r in labels.collect()]
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["score"], q) for r, q in truth if r["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.8 and np.mean([s >= 0.3 for s in good]) > 0.97


def test_classifier_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (77, 0)], "doc_id long, quality int")
    got = quality_classifier.classify(table(spark, TEXTS), labels).collect()
    assert len(got) == len(TEXTS) and len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert len(quality_classifier.classify(table(spark, TEXTS), none).collect()) == len(TEXTS)
    assert quality_classifier.classify(table(spark, []), labels).collect() == []


def test_forest_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    f = gbt.fit(x[:2000], y[:2000])
    assert ((f.score(x[2000:]) > 0.5) == (y[2000:] > 0)).mean() > 0.95
