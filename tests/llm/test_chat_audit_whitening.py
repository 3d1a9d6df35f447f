"""Chat formatting, filter audit and whitening against plain versions: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwise.llm import chat, filter_audit, whitening

CLASH = ("turns", "formatted", "loss", "mask", "k1", "n", "good", "toxic", "_x", "x", "cells", "k", "v", "component", "part")


def clashing(df):
    taken = set(df.columns)
    return df.withColumns({c: F.lit(7) for c in CLASH if c not in taken})


# ---- chat ----

CONV = "conv_id long, turn long, role string, text string"


def plain_turns(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, v in talks.items()}


def test_conversations_read_back_as_they_were(spark):
    tricky = [None, "", "<", "\\", "<\\", "<\\/turn>", "</turn>", "<turn>", "<says>x<also>", "<\\\\\\also>", "a</tur", "n>b", "</turn></turn>", "Ünï 😀 </turn> 😀", "<turn>user<says>", "\\### Assistant: </turn> ok"]
    r = random.Random(5)
    rows = [(c, k, r.choice(["user", "assistant", "system", None, "<says>", "a\nb"]), r.choice(tricky)) for c in range(30) for k in range(r.randrange(1, 9))]
    rows += [(40, k // 3, "assistant", f"t{k % 5}") for k in range(700)]  # ties, repeated rows, one long block
    rows += [(41, 0, "user", "😀x" * 40_000), (41, 1, "assistant", "<\\" * 30_000 + "/turn>"), (41, None, "assistant", "before"), (None, 1, "user", "no id"), (None, 2, "assistant", None)]
    talks = chat.format_conversations(clashing(spark.createDataFrame(rows, CONV)))
    read = talks.select("*", chat.read_turns(F.col("formatted")).alias("read"), chat.read_spans(F.col("formatted"), F.col("loss")).alias("learned"))
    got = {x.conv_id: x for x in read.collect()}
    expected = plain_turns(rows)
    assert set(got) == set(expected)
    for conv, turns in expected.items():
        x = got[conv]
        assert [(t.role, t.text) for t in x.read] == turns
        assert x.learned == [t for role, t in turns if role == "assistant"]
        assert x.n_blocks == len(list(itertools.groupby(turns, key=lambda t: t[0])))
        assert re.sub(r"<\\(?=\\*(?:/?turn|says|also)>)", "<", "".join(x.formatted[s.start : s.end] for s in x.loss)) == "".join(x.learned)
        assert x.formatted.count("</turn>") == x.formatted.count("<turn>") == x.n_blocks


def test_chat_digests_probe_and_empty_table(spark):
    nothing = spark.createDataFrame([], CONV)
    assert chat.format_conversations(nothing).count() == 0
    (x,) = chat.digests(chat.format_conversations(chat.with_probe(nothing))).collect()
    said = f"user\n{chat.PROBE_TEXT}\nassistant\n{chat.PROBE_TEXT}\n"
    assert (x.conv_id, x.n_turns, x.turns_sha256) == (-7, 2, hashlib.sha256(said.encode()).hexdigest())
    assert (x.loss_chars, x.loss_sha256) == (len(chat.PROBE_TEXT), hashlib.sha256(chat.PROBE_TEXT.encode()).hexdigest())


def test_chat_learns_from_the_roles_asked_for(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "user", "v"), (1, 3, "assistant", "a")]
    (x,) = chat.format_conversations(spark.createDataFrame(rows, CONV), loss_roles=("user", "system")).select("formatted", "n_blocks", chat.read_spans(F.col("formatted"), F.col("loss")).alias("t")).collect()
    assert x.t == ["s", "u", "v"] and x.n_blocks == 3
    assert x.formatted == "<turn>system<says>s</turn><turn>user<says>u<also>v</turn><turn>assistant<says>a</turn>"


# ---- filter audit ----

DOCS = "doc_id long, text string, source string"


def plain_audit(rows, labels):
    firsts, marks = {}, {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    for i, q, x in (row for row in labels if row[0] is not None):
        g, b = marks.get(i, (0, 0))
        marks[i] = (g | (q == 1), b | (x == 1))
    docs = []
    for i, t, s in rows:
        text = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > firsts[text]}
        docs.append((s or "", {k for k, v in fails.items() if v}, *marks.get(i, (0, 0))))
    out, shares = {}, Counter()
    orders = list(itertools.permutations("ABCDE"))
    for part in {d[0] for d in docs}:
        for order in orders:
            left = [d for d in docs if d[0] == part]
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                all_fail = sum(d[0] == part and f in d[1] for d in docs)
                alone = sum(d[0] == part and d[1] == {f} for d in docs)
                out[part, "".join(order), k + 1] = (len(left), len(gone), all_fail - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone))
                shares[part, f] += len(gone)
    return {key: (*v, shares[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_is_every_order_done_by_hand(spark):
    r = random.Random(11)
    texts = [None, "", " \n", "short one", "A B C # d", "x" * 70_000, "Same Words " * 150, " ".join(f"w{k}" for k in range(250)), " ".join(f"W{k}" for k in range(250)), " ".join(f"w{k}" for k in range(210)) + " | é", "same " * 300]
    rows = [(r.randrange(60), r.choice(texts), r.choice(["s1", "s2", None, ""])) for _ in range(150)]
    rows += [(None, "short one", "s1"), (None, "short one", "s1"), (-5, None, "s2"), *[rows[0]] * 3]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (999, 1, 1), (None, 1, 1)]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(3))
    assert audit_rows(filter_audit.audit_documents(docs, marks)) == plain_audit(rows, labels)


def test_audit_of_nothing_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(spark.createDataFrame([], DOCS), none).count() == 0
    got = audit_rows(filter_audit.audit_documents(spark.createDataFrame([(1, None, None), (2, "", None)], DOCS), none))
    assert len(got) == 600 and {k[0] for k in got} == {""}
    assert got["", "EABCD", 1] == (1, 1, 0, 0, 0, 0, 60 * 1) and got["", "AEBCD", 1][:3] == (0, 2, 0)


def test_walk_stores_the_survivors_of_every_subset():
    cells = np.random.default_rng(3).integers(0, 9, (4, 32, 3))
    stored = filter_audit.walk(cells, 5)
    for subset in range(32):
        alive = cells[:, [m for m in range(32) if not m & subset]].sum(axis=1)
        assert np.array_equal(stored[subset], alive)


# ---- whitening ----

VECS = "vec_id long, embedding array<float>"


def plain_whitening(vectors, most=16):
    x = np.floor(np.array(vectors, dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    z = fit - fit.mean(axis=0)
    values, turned = np.linalg.eigh(z.T @ z / len(fit))
    return fit, values[::-1][:most], turned[:, ::-1][:, :most], x


def check_whitening(rows, vectors, most=16):
    fit, values, turned, x = plain_whitening(list(vectors.values()), most)
    n, s = len(fit), fit.sum(axis=0)
    at = dict(zip(vectors, x, strict=True))
    table = {}
    for r in rows:
        table.setdefault(r.vec_id, {})[r.component] = r
    assert set(table) == set(vectors)
    for i, found in table.items():
        assert sorted(found) == list(range(1, len(found) + 1))
        for r in found.values():
            assert r.n == n and r.deviation == sum(int(v) ** 2 for v in n * at[i] - s)
            assert r.explained == pytest.approx(values[r.component - 1] / np.trace(np.cov(fit.T, bias=True)), rel=1e-9)
            expected = (at[i] - s / n) @ turned[:, r.component - 1] / math.sqrt(values[r.component - 1])
            assert abs(r.whitened) == pytest.approx(abs(expected), abs=1e-6) and r.identity_error < 1e-9
    return table


def test_whitening_is_the_eigenvectors(spark):
    g = np.random.default_rng(8)
    mixed = g.normal(size=(300, 20)) @ (g.normal(size=(20, 20)) * np.geomspace(1, 1e-2, 20))
    vectors = {i: [float(np.float32(v)) for v in row] for i, row in enumerate(mixed)}
    rows = [*vectors.items(), *[(1000 + k, vectors[0]) for k in range(80)], (0, vectors[0])]  # one common vector, a repeated row
    bad = [(2000, None), (2001, []), (2002, [None] * 20), (2003, [math.nan] * 20), (2004, [math.inf] + [0.0] * 19), (2005, [1.0] * 19), (2006, [1e30] * 20)]
    df = clashing(spark.createDataFrame(rows + bad, VECS))
    got = whitening.whiten(df).collect()
    assert len(got) == 16 * len(rows)
    once = {r.vec_id: r for r in got}
    assert set(once) == set(dict(rows))
    check_whitening(got, dict(rows))
    signs = {r.component: r.whitened for r in got if r.vec_id == 0}
    assert all(r.whitened == signs[r.component] for r in got if r.vec_id >= 1000)


def test_whitening_where_dimensions_hang_on_each_other(spark):
    g = np.random.default_rng(9)
    base = g.integers(-50, 50, (60, 3)) / 64
    vectors = {i: [*map(float, (a, b, c, a + b, 7.0, c))] for i, (a, b, c) in enumerate(base)}
    got = whitening.whiten(spark.createDataFrame(list(vectors.items()), VECS)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    check_whitening(got, vectors, 3)


def test_whitening_of_badly_conditioned_vectors(spark):
    g = np.random.default_rng(10)
    a = g.integers(-(10**5), 10**5, 400)
    vectors = {i: [int(v) / 64, int(v + k) / 64, int(m) / 64] for i, (v, k, m) in enumerate(zip(a, *g.integers(0, 3, (2, 400)), strict=True))}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = whitening.whiten(rows).collect()
    assert {r.component for r in got} == {1, 2, 3} and max(r.identity_error for r in got) < 1e-6


def test_whitening_of_nothing_and_of_one_vector(spark):
    assert whitening.whiten(spark.createDataFrame([], VECS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], VECS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECS)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(None, [0.0, 0.0]), (2, [1.0, 0.0])], VECS)).collect()
    assert [(r.component, r.n, r.deviation) for r in two] == [(1, 2, 64**2)] * 2
    assert [x for r in two for x in (abs(r.whitened), r.explained)] == pytest.approx([1.0] * 4, rel=1e-12)


def test_deviations_stay_exact_where_longs_do_not():
    sums = whitening.Sums(10**10, [10**16, 10**16])
    x = np.array([[10**6 + 3, 10**6 - 1]])
    assert sums.deviations(x).tolist() == [[3 * 10**10, -(10**10)]]
    assert whitening.Sums(1, [2**61]).deviations(np.array([[2**60]])).tolist() == [[-(2**60)]]
