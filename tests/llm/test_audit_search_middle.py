"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import fill_middle, filter_audit, topk_search

# 11


def audited(docs, labels):
    """The report document by document and order by order."""
    least = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    parts = {}
    for doc_id, text, source, *_ in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {c for c, f in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), doc_id is not None and doc_id > least[text])) if f}
        parts.setdefault(source or "", []).append((fails, doc_id in good, doc_id in toxic))
    out = set()
    for part, rows in parts.items():
        removed_by, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left, gone = rows, []
            for step, c in enumerate(order, 1):
                here = [r for r in left if c in r[0]]
                lines.append(("".join(order), step, c, len(left) - len(here), len(here), sum(c in r[0] for r in gone), sum(r[0] == {c} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)))
                removed_by[c] += len(here)
                left, gone = [r for r in left if c not in r[0]], gone + here
        out |= {(part, o, s, *rest, removed_by[c]) for o, s, c, *rest in lines}
    return out


def test_audit_against_orders_one_by_one(spark):
    r = random.Random(1)
    texts = [None, "", "A", " \t\n", "a#b", "Ünïcode Ä" * 3, "x " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), " ".join(f"w{i}" for i in range(220)) + " 50%", "long " * 60_000, "a\x0bb\x1cc d" * 90, "same text"]
    docs = [(r.choice([i, i, i, None, 7]), r.choice(texts), r.choice(["s1", "s2", None, "hot", "hot"]), "clash") for i in range(200)]
    docs += docs[:5]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, mask string").repartition(5)
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == 4 * 600 and set(rows) == audited(docs, labels)


def test_audit_of_nothing(spark):
    assert filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_texts_that_share_a_fingerprint_are_told_apart():
    chains = {}
    lost = list(filter_audit._chained([(1, "a", 5), (1, "b", 4), (1, "a", 3), (1, "b", 9), (1, "a", 3), (2, "a", 8)], chains))
    assert lost == [(5, 1), (9, 1)] and chains == {1: [["a", 3], ["b", 4]], 2: [["a", 8]]}


# 12


def best(vectors, k=10):
    whole = [(i, row, [math.floor(1024 * x) for x in v]) for i, (row, v) in enumerate(vectors) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q, v in whole:
        if q is None or q % 100:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), n is None, n or 0) for j, n, w in whole if j != i)
        out += [(q, rank, None if none else n, -s) for rank, (s, none, n) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def search(spark, vectors, **more):
    frame = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, row string").repartition(4)
    return sorted((tuple(r) for r in topk_search.top_k(frame, F.col("vec_id") % 100 == 0, **more).collect()), key=repr)


@pytest.mark.parametrize("more", [{}, {"slab_bytes": 64, "block_rows": 3}, {"block_rows": 50}])
def test_search_against_all_pairs(spark, more):
    r = np.random.default_rng(2)
    vectors = [(i * 10 if i < 60 else i, [float(x) for x in r.normal(0, 0.1, 20) * (1 + i % 3)]) for i in range(120)]
    vectors += [(500 + i, vectors[7][1]) for i in range(15)] + [(100, vectors[3][1]), (100, vectors[3][1]), (None, vectors[3][1])]  # ties, a repeated query, no id
    vectors += [(9001, None), (9002, [None, 1.0]), (9100, [float("nan")] * 20), (9003, [float("inf")] * 20), (9004, []), (9005, [0.5]), (0, [0.0] * 20)]
    assert search(spark, vectors, **more) == best(vectors)


def test_search_of_large_numbers_is_exact(spark):
    vectors = [(100, [1e6, -3.0, 2.5e5]), (1, [1e6, 7.0, 1.0]), (2, [1e6, 7.0, 1.0009765625]), (3, [-1e6, 2.0, 3.0]), (200, [1e30, 1.0, 0.0])]
    got = search(spark, [v for v in vectors if v[0] != 200])
    assert got == best([v for v in vectors if v[0] != 200])
    beyond = [r for r in search(spark, vectors) if r[0] == 200]
    assert [r[2] for r in beyond] == [1, 2, 100, 3] and beyond[0][3] == 2**63 - 1 and beyond[-1][3] == -(2**63)


def test_search_of_few_and_none(spark):
    assert search(spark, [(1, [1.0])]) == [] and search(spark, []) == [] and search(spark, [(100, [1.0])]) == []
    assert search(spark, [(100, [1.0, -1.0]), (7, [0.25, 0.0])]) == [(100, 1, 7, 1024 * 256)]


# 13


def made(doc_id, text, seed="1"):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk", [7, 256, 1000, 65_536])
def test_cuts_against_the_pattern(spark, chunk):
    r = random.Random(chunk)
    alphabet = ["a", "B", "P", "S", "M", "<", ">", " ", "\n", "é", "ß", "😀", "9", "word", "Lorem"]
    texts = [None, "", "a", "é", "<P>", "x<S>y", "<M", "a <P > b", "<<P>>", "<P<S", "😀" * 30, "z" * 3000, "  a\r\n"] + ["".join(r.choices(alphabet, [9, 9, 2, 2, 2, 2, 2, 9, 1, 1, 1, 1, 1, 3, 3], k=r.choice([1, 5, 40, 300, 2500]))) for _ in range(120)]
    docs = [(i if i != 3 else None, t, "kept", 5) for i, t in enumerate(texts)] + [(7, "again and again", "a", 1)] * 2
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, n int").repartition(3)
    done = fill_middle.fill_in_middle(frame, chunk=chunk)
    assert done.columns == ["doc_id", "text", "source", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = done.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((r[:1] + r[3:8] for r in map(tuple, rows)), key=repr) == sorted((made(i, t) for i, t, *_ in docs), key=repr)
    assert all(x.back == (x.text or "") for x in rows) and {x.form for x in rows} == {"plain", "psm", "spm"}


def test_functions_compose_like_one_scan():
    r = random.Random(4)
    text = "".join(r.choices("ab<PSM> .é", k=4000))
    whole = [f[0].tolist() for f in fill_middle.Scan([text]).functions()]
    for cut in (1, 2, 255, 256, 257, 3999):
        ends, units, marks = fill_middle.Scan([text[:cut], text[cut:]]).functions()
        joined = fill_middle.compose((ends[:1], units[:1] + (marks[:1] << 32)), (ends[1:], units[1:] + (marks[1:] << 32)))
        assert joined[0][0].tolist() == whole[0] and (joined[1][0] & 0xFFFFFFFF).tolist() == whole[1] and (joined[1][0] >> 32).tolist() == whole[2]
    assert whole[1][0] == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text)) and whole[2][0] == len(re.findall("<[PSM]>", text))


def test_cuts_of_nothing(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
