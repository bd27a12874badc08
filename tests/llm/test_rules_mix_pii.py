import random
import time
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing, pii, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, n long, key string"
SF = "/root/testdata/sf0.01/documents.parquet"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), -1, False, -1, "x") for i, t, s in rows], SCHEMA)


def odd_rows():
    r = random.Random(5)
    vocabulary = ["ab", "Cd", "é", "x#y", "12", "|", "zz.", "\U0001f600b"]
    rows = [(1, None, "a"), (2, "", "a"), (None, "no id here", None), (3, " \t\n\x0b ", "b"), (3, " \t\n\x0b ", "b")]
    for i in range(10, 60):
        ws = [r.choice(vocabulary) for _ in range(r.randrange(60))]
        if i % 3 == 0:
            ws = ws[:9] * 3 + ws
        rows.append((i, "".join(w + r.choice([" ", "  ", "\n", "\n\n", "\t", "\r\n"]) for w in ws), r.choice(["a", "b", None])))
    rows.append((99, " ".join(f"w{i % 997}" for i in range(30000)), "long"))
    return rows


def test_rules_match_brute_force(spark):
    rows = odd_rows()
    got = Counter(tuple(r) for r in quality_rules.judge(table(spark, rows)).select("doc_id", *brute.rules("")).collect())
    assert got == Counter((i, *brute.rules(t).values()) for i, t, _ in rows)


def test_rules_on_whole_table(spark):
    docs = spark.read.parquet(SF)
    want = {r["doc_id"]: tuple(brute.rules(r["text"]).values()) for r in docs.collect()}
    got = {r[0]: tuple(r[1:]) for r in quality_rules.judge(docs).select("doc_id", *brute.rules("")).collect()}
    assert got == want


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(25))
    rows = [(i, f"Share This  page\n{body(i)}", "h") for i in range(30)]
    rows += [(100 + i, "\n".join(["share this page"] * 40 + [" ".join(f"u{i}v{j}" for j in range(21))]), "h") for i in range(3)]
    rows += [(200 + i, body(777), "h") for i in range(40)]
    got = {r["doc_id"]: r for r in quality_rules.judge(table(spark, rows)).collect()}
    assert all(got[i]["kept"] and got[i]["removed_words"] == 3 for i in range(30))
    assert not any(got[100 + i]["kept"] for i in range(3))
    assert all(got[200 + i]["kept"] and got[200 + i]["removed_words"] == 0 for i in range(40)), "exact copies count once"
    clean = {r["doc_id"]: r for r in quality_rules.clean(table(spark, rows)).collect()}
    assert set(clean) == set(range(30)) | {200 + i for i in range(40)}
    assert clean[4]["text"] == body(4) and clean[4]["n_chars"] == len(body(4))


def test_one_of_a_group_of_near_copies_stays(spark):
    line = lambda a, j: " ".join(f"{a}l{j}w{k}" for k in range(12))
    rows = [(i, "\n".join([line(f"a{i}", j) for j in range(4)] + ["share this page"]), "h") for i in range(200)]
    near = [[line("same", j) for j in range(12)] for _ in range(100)]
    for i, lines in enumerate(near):
        lines[i % 12] = line(f"own{i}", 0)
        rows.append((1000 + i, "\n".join([*lines, "share this page"]), "h"))
    got = {r["doc_id"]: r["text"] for r in quality_rules.clean(table(spark, rows)).collect()}
    assert set(range(200)) <= set(got)
    stay = [i for i in got if i >= 1000]
    assert 1 <= len(stay) <= 12
    assert all(got[i] == "\n".join(near[i - 1000]) for i in stay), "whole but for the line that frames other documents"


def test_repeated_rows_stay_in_the_cleaned_table(spark):
    text = " ".join(f"w{j}" for j in range(30))
    got = quality_rules.clean(table(spark, [(1, text, None), (1, text, None), (None, text, "a")]))
    assert got.columns == table(spark, []).columns
    assert sorted((r["doc_id"] or 0, r["source"] or "") for r in got.collect()) == [(0, "a"), (1, ""), (1, "")]


@pytest.mark.parametrize("op", [quality_rules.judge, quality_rules.clean, mixing.mix, mixing.mixed, pii.report, pii.redact])
def test_empty_tables(spark, op):
    assert op(table(spark, [])).collect() == []


def targets(sizes):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1] * len(sizes)))
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in capped}
        level = (total - sum(capped.values())) / sum(rest.values()) if rest else 0
        over = {s: 2.0 * sizes[s] for s, w in rest.items() if w * level >= 2 * sizes[s]}
        if not over:
            return capped | {s: w * level for s, w in rest.items()}
        capped |= over


def test_mix_reaches_targets(spark):
    docs = spark.read.parquet(SF)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(brute.words(r["text"]))
    want, taken = targets(sizes), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    largest = max(r["size"] for r in got)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    again = mixing.mix(docs.repartition(7)).select("doc_id", "taken").collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted(map(tuple, again))


def test_mix_of_odd_rows(spark):
    rows = odd_rows()
    got = mixing.mix(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(brute.words(t))) for i, t, _ in rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    out = mixing.mixed(table(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter({r["doc_id"]: 0 for r in got}) + Counter(
        x for r in got for x in [r["doc_id"]] * r["copies"]
    )


PII = [
    "a@b.c_d@e.f x.y+z@mail-1.example.com. @no bad@ no@dot",
    "1.2.3.4.5 256.1.1.1 0001.002.3.255 1.2.3 999999999999.1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000 12345 4111 1111  1111 1111",
    "+1 (555) 123-4567 +44 20 7946 0958. +1 +12345678 ++123456789 +1234567890123456",
    "é\U0001f600 a@b.cd \U0001f600+123456789012 4111111111111111é1.1.1.1",
    "a" * 50_000 + " " + "1 2 " * 30_000 + "+1" + "2" * 50_000,
    "", None, "+1 555 10.0.0.1 4111 1111 1111 1111@b.cc",
]


def test_base_spans_match_brute_force(spark):
    rows = [(i, t, "s") for i, t in enumerate(PII)] + [(0, PII[0], "s"), (None, PII[1], None)]
    for r in pii.report(table(spark, rows)).collect():
        text = PII[1] if r["doc_id"] is None else PII[r["doc_id"]]
        base = brute.base_spans(text)
        assert r["base_sha256"] == brute.base_sha(text), text and text[:80]
        assert [r[f"n_{k}"] for k in brute.KINDS] == [sum(s[0] == k for s in base) for k in brute.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",")) | {""}


def test_base_spans_on_whole_table(spark):
    docs = spark.read.parquet(SF)
    want = {r["doc_id"]: brute.base_sha(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["base_sha256"] for r in pii.report(docs).collect()} == want


def test_candidates_and_redaction(spark):
    text = "please call (555) 123-4567 or mail joe (at) host (dot) com; version 10.20.30, in 1999-100-200 words"
    row = pii.report(table(spark, [(1, text, "s")])).first()
    found = {tuple(s.split(":")) for s in row["spans"].split(",")}
    assert ("phone", "12", "26") in found and any(k == "email" for k, _, _ in found) and len(found) == 2
    out = pii.redact(table(spark, [(1, text, "s"), (2, "a@b.cd and 1.2.3.4", "s"), (3, None, "s"), (4, "clean", "s")]))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == "please call [PHONE] or mail [EMAIL]; version 10.20.30, in 1999-100-200 words"
    assert got[2]["text"] == "[EMAIL] and [IP]" and got[2]["n_chars"] == 16
    assert got[3]["text"] is None and got[4]["text"] == "clean" and out.columns == table(spark, []).columns


def plain_spans(base, more):
    """The greedy choice, one candidate after the other."""
    taken = []
    for s in sorted((s for s in more if not any(s[0] < b[2] and b[0] < s[2] for b in base)), key=lambda s: (-s[3], s[0], s[1])):
        if not any(s[0] < t[2] and t[0] < s[2] for t in taken):
            taken.append(s)
    return sorted(base + taken)


def plain_redaction(text, spans):
    out, at = [], 0
    for start, kind, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{pii.KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_choice_and_redaction_match_plain_loops(spark):
    r, rows = random.Random(8), []
    for n in [0, 1, 3, 40, 700, 3000]:
        base, more = [], []
        for kind in range(4):
            for into, far, sizes in ((base, 90, (1, 300)), (more, 25, (9, 147))):
                at = 0
                for _ in range(r.randrange(n + 1)):
                    at += r.randrange(far)
                    into.append((at, kind, at + r.randrange(*sizes), 1.0 if into is base else float(r.randrange(3))))
                    at = into[-1][2]
        keep = sorted(b for b in base if r.random() < 0.2)
        length = max([s[2] for s in keep + more], default=0) + 5
        rows.append((n, keep, more, "".join(r.choice("aé\U0001f600 ") for _ in range(length))))
    span = "array<struct<start: bigint, kind: int, end: bigint, score: double>>"
    d = spark.createDataFrame(rows, f"n long, base {span}, more {span}, text string").repartition(3)
    d = d.withColumn("spans", pii.all_spans(F.col("base"), F.col("more")))
    for row in d.withColumn("out", pii.redacted(F.col("text"), F.col("spans"))).collect():
        want = plain_spans([tuple(s) for s in row["base"]], [tuple(s) for s in row["more"]])
        assert [tuple(s) for s in row["spans"]] == want, row["n"]
        assert row["out"] == plain_redaction(row["text"], want), row["n"]


def test_many_spans_in_one_text(spark):
    text = "call (555) 123-4567 or mail a@b.cd " * 20_000
    start = time.monotonic()
    out = pii.redact(table(spark, [(1, text, "s")])).first()["text"]
    assert out == "call [PHONE] or mail [EMAIL] " * 20_000
    assert time.monotonic() - start < 120


def test_native_operators_run_no_python(spark):
    docs = spark.read.parquet(SF)
    for df in (quality_rules.judge(docs), pii.report(docs), mixing.mix(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), plan[:500]
    assert F is not None


def test_names_of_extra_columns_may_clash(spark):
    names = ["row", "own", "copy", "at", "n", "first", "v_doc", "removed", "__doc", "__hash", "__own", "__text", "a.b"]
    text = "write to ann@example.org " + " ".join(f"w{i}" for i in range(30))
    rows = [(i, text + f" {i}", "en", "s", 0, *[f"{n}{i}" for n in names]) for i in range(3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    d = spark.createDataFrame(rows, schema)
    for made in (quality_rules.clean(d), pii.redact(d), mixing.mixed(d)):
        assert made.columns == d.columns
        for r in made.collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names)
