"""The training-data operators on small tables: brute force, round trips, and odd rows (nulls, ties, empty tables, other columns)."""

import hashlib
import random
import re
import tracemalloc
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from trackloom.llm import bpe, chat_format, exact_dedup, html_consensus, jaccard_join, language_gru, packing, pii, quality_conv, registry, shared, simhash, tokenizer

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_chars long, gid string, label int"
WORDS = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, "The cat  sat\ton the mat today again", "en", 1, "x", None), (2, "The cat sat on the mat today again", None, 2, None, 1), (3, None, "en", None, None, None), (4, "", "de", 0, None, None),
    (5, WORDS, "en", 3, None, None), (6, WORDS.replace("w30", "zz"), "en", 3, None, None), (6, WORDS.replace("w30", "zz"), "en", 3, None, None), (None, "no id here, call +1 (743) 555-3824", None, None, None, None),
    (7, "ab " * 30_000, "fr", None, None, None), (8, "\n\t ", None, None, None, None), (9, "Ünï ✓ <b>", "de", 9, None, None), (10, "two words", "en", 9, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def linked(docs):
    sets, parent = [(i, shingles(t)) for i, t in docs], {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_jaccard_join(spark, odd, empty):
    base = [f"t{i}" for i in range(200)]
    docs = [(i, " ".join(base[: 8 * i % 50] + [f"x{i % 7}"] + base[8 * i % 50 :])) for i in range(40)] + [(100 + i, " ".join(base[:40] + [f"y{i}_{k}" for k in range(60)])) for i in range(40)]
    assert sorted(rows(jaccard_join.classes(spark.createDataFrame(docs, "doc_id long, text string")))) == linked(docs)
    known = {r[0]: r[1:] for r in rows(jaccard_join.classes(odd))}
    assert known[1] == known[2] == (4, 1) and known[5][1] == known[6][1] == 5 and known[3] == (0, 3) and known[10] == (1, 10)
    assert jaccard_join.classes(empty).count() == 0
    kept = jaccard_join.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4, 5, 7, 8, 9, 10]


def test_jaccard_join_of_common_passages(spark):
    """Texts of nothing but passages that many others have too, and prefixes of one text whose sizes stand 3 to 4 or just beyond."""
    draw = random.Random(5)
    passages = [" ".join(f"p{k}_{i}" for i in range(12)) for k in range(9)]
    texts = [" ".join(draw.sample(passages, draw.randint(1, 7)) + [f"own{i % 11}"] * (i % 3)) for i in range(120)]
    for top in (4, 8, 20, 44, 100):
        texts += [" ".join(f"q{top}_{i}" for i in range(n + 4)) for n in (top, top * 3 // 4, top * 3 // 4 - 1)]
    docs = list(enumerate(texts))
    assert rows(jaccard_join.classes(spark.createDataFrame(docs, "doc_id long, text string"))) == sorted(linked(docs), key=repr)


@pytest.fixture
def stagings(monkeypatch):
    """The tags of the tables that get staged, in order."""
    tags, real = [], shared.staged
    monkeypatch.setattr(shared, "staged", lambda df, tag: (tags.append(tag), real(df, tag))[1])
    return tags


def test_components_end_at_stars(spark, stagings):
    """Stars are the result: they take no round, and repeated or turned edges and loops make no difference."""
    stars = [(9, 1), (9, 1), (1, 9), (4, 1), (7, 2), (5, 5)]
    assert rows(shared.components(spark.createDataFrame(stars, "a long, b long"))) == [(1, 1), (2, 2), (4, 1), (7, 2), (9, 1)]
    assert stagings == ["edges"]
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0
    draw = random.Random(3)
    order = draw.sample(range(300), 300)
    chains = [(order[i], order[i + 1]) for i in range(299) if i % 100 != 99] + [(1000 + draw.randrange(40), 1000 + draw.randrange(40)) for _ in range(30)]
    parent = {x: x for e in chains for x in e if e[0] != e[1]}
    for _ in parent:
        for a, b in chains:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert rows(shared.components(spark.createDataFrame(chains, "a long, b long"))) == sorted(parent.items(), key=repr)


def test_pivot_turns_only_where_many_pairs_are_open(spark, stagings, monkeypatch):
    """60 texts around one passage, unlike but for a few: so few comparisons a row need no turn, and with turns the result is the same."""
    passage = " ".join(f"p{i}" for i in range(44))
    docs = [(i, f"{passage} " + " ".join(f"own{i // 2 if i < 6 else i}_{k}" for k in range(8 - (i % 2 if i < 6 else 0)))) for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = sorted(linked(docs), key=repr)
    assert len({r[2] for r in wanted}) == 57
    assert rows(jaccard_join.classes(table)) == wanted and "token_pivots" not in stagings
    monkeypatch.setattr(jaccard_join, "PAIRS", 0)
    assert rows(jaccard_join.classes(table)) == wanted and "token_pivots" in stagings


def test_near_copies_of_a_family_are_compared_in_proportion(spark, monkeypatch):
    """Copies of one text with two or four words changed: most link with the text itself only, which must be the pivot wherever its id stands."""
    checked, real = [], jaccard_join.verify
    monkeypatch.setattr(jaccard_join, "verify", lambda pairs, *more: (checked.append(pairs.count()), real(pairs, *more))[1])
    draw = random.Random(0)
    base = [f"w{i}" for i in range(150)]

    def changed(i, n):
        words = list(base)
        for at in draw.sample(range(5, 145, 5), n):
            words[at] = f"own{i}_{at}"
        return " ".join(words)

    docs = [(i, changed(i, 0 if i == 77 else 2 if i % 2 else 4)) for i in range(160)]
    wanted = sorted(linked(docs), key=repr)
    assert {r[2] for r in wanted} == {0}
    assert rows(jaccard_join.classes(spark.createDataFrame(docs, "doc_id long, text string"))) == wanted
    assert sum(checked) <= 2 * len(docs)


def test_group_ids_stand_by_the_share_of_frequent_shingles():
    tokens = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2))
    ids = []
    for frequent in (0, 10, 30, 40):
        ranks = np.zeros(1 << 16, np.uint8)
        ranks[(tokens[:frequent] >> np.uint64(48)).astype(np.int64)] = 30
        ids.append(jaccard_join.group_id(tokens, 150, ranks))
    assert ids == sorted(ids) and len({*ids}) == 4 and all(-(1 << 63) <= x < 1 << 63 for x in ids)
    assert jaccard_join.group_id(tokens, 151, ranks) != ids[-1] != jaccard_join.group_id(tokens[:-1], 150, ranks)


class Caught:
    """Stands in for a table, to get the function that a step runs in its tasks."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self

    def repartition(self, *_):
        raise InterruptedError


def traced(run, batches):
    """The blocks that a task gives, and the MB that it held at most."""
    list(run(iter(batches)))  # what is imported on the way stays out of the figure
    tracemalloc.start()
    try:
        found = [row for batch in run(iter(batches)) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        return found, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_sketch_counts_every_shingle_in_little_memory(monkeypatch):
    texts = pa.array(["a " * 150_000, "", None, " ".join(f"w{i % 7919}" for i in range(60_000)), "a " * 20])
    wanted = np.zeros(1 << jaccard_join.SKETCH_BITS, np.int64)
    for found in jaccard_join.shingle_hashes(texts):
        np.add.at(wanted, (found >> np.uint64(64 - jaccard_join.SKETCH_BITS)).astype(np.int64), 1)
    assert wanted.max() > 1 << 17  # beyond 16 bits
    table = Caught()
    monkeypatch.setattr(jaccard_join, "_counted", lambda parts, bits: None)
    jaccard_join.sketch(table)
    found, most = traced(table.run, [pa.RecordBatch.from_arrays([texts], ["text"])])
    got = np.zeros((256, 1 << 16), np.int64)
    for block, part in found:
        got[block] += np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.uint32)
    assert (got.ravel() == wanted).all() and most < 60


def test_bit_tables_are_marked_in_their_own_size(spark):
    hashes = np.random.default_rng(7).integers(-(1 << 63), 1 << 63, 50_000)
    hashes[:1000] = hashes[1000:2000]
    table = Caught()
    with pytest.raises(InterruptedError):
        jaccard_join.bit_table(table, jaccard_join.TOKEN_BITS)
    found, most = traced(table.run, [pa.RecordBatch.from_arrays([pa.array(x)], ["h"]) for x in (hashes[:700], hashes[700:], hashes[:0])])
    wanted = np.zeros(1 << jaccard_join.TOKEN_BITS, bool)
    wanted[(hashes.view(np.uint64) >> np.uint64(64 - jaccard_join.TOKEN_BITS)).astype(np.int64)] = True
    assert b"".join(part for _, part in sorted(found)) == np.packbits(wanted).tobytes() and most < 40


def test_size_classes(spark):
    sizes = [*range(1, 400), 3**9, 4**9, 3 * 10**6, 4 * 10**6]  # in order
    for percent in (50, 75, 90, 100):
        found = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", *(jaccard_join.size_class(F.col("n"), percent, k) for k in (0, -1, 1))).collect()
        own, least, largest = ([r[k] for r in sorted(found)] for k in (1, 2, 3))
        for i, n in enumerate(sizes):
            assert all(least[i] <= own[j] <= largest[i] for j, m in enumerate(sizes) if 100 * min(n, m) >= percent * max(n, m))


def test_exact_dedup(spark, odd, empty):
    got = {r.doc_id: r for r in exact_dedup.groups(odd).collect()}
    assert got[2].keep_id == 1 and not got[2].kept and got[1].group_size == 2 and got[4].keep_id == 3 and got[8].keep_id == 8
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 1 and kept.where("doc_id = 2").count() == 0
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_bpe(spark, odd, empty):
    library = tokenizer.loaded(tokenizer.default_path()).library
    shared_text = " ".join(f"passage{i} word" for i in range(400))
    docs = [(i, f"start{i} " * (50 * i) + shared_text + f" end{i}") for i in range(4)] + [(r[0], r[1]) for r in ODD]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    done = {bytes(r.text_key): r for r in bpe.encode_texts(df.select("text"), tokenizer.default_path()).collect()}
    for _, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = done[hashlib.sha256((text or "").encode()).digest()[:16]]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_texts(empty.select("text"), tokenizer.default_path()).count() == 0


def test_packing(odd, empty):
    got = packing.pack_documents(odd, keep_ids=True).collect()
    library = tokenizer.loaded(tokenizer.default_path()).library
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(b, b[1:])) and b[-1][0] + b[-1][1] <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1
    ids = library.encode(ODD[8][1], add_special_tokens=False).ids + [0]
    assert b"".join(p[3] for p in sorted(pieces[7])) == array("I", ids).tobytes() and len(got) > len(ODD)
    assert packing.pack_documents(empty).count() == 0


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 4, 8, 9)] == [(0, 0), (1, 0), (0, 6), (2, 0), (3, 0)]
    assert bins.place(3) == (1, 7)


def test_simhash(spark, odd, empty):
    docs = odd.where("doc_id is not null and doc_id <> 6").select("doc_id", "text")
    got = {r.doc_id: r for r in simhash.fingerprints(docs).collect()}
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    print_of = simhash.Fingerprinter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].fingerprint == f"{print_of.fingerprint(print_of.words(t)):016x}"
    assert simhash.fingerprints(empty).count() == 0 and simhash.fingerprints(odd).count() == len(ODD)
    prints = [0, 1, 7, 15, 1 << 63, (1 << 63) | 3, 0xFFFF, 0xABCDEF0123456789 - (1 << 64), (1 << 40) | 5]
    signed = [p - (1 << 64) if p >> 63 == 1 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "p long")
    wanted = sorted((a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for a in signed for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert sorted(map(tuple, simhash.within(df, df.withColumnRenamed("p", "q")).select("q", "p", "distance").collect())) == wanted


def test_simhash_gives_the_near_rows(spark, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "HOT_KEY", 5)
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(3)]
    made = [b ^ sum(1 << i for i in r.sample(range(64), k)) for b in base for k in (0, 1, 3, 4, 8, 10, 11, 11, 11, 12, 13) for _ in range(4)] + base
    made += [base[0] ^ sum(1 << i for i in bits) for bits in ([0, 1, 2, 16, 17, 18, 32, 33, 34, 48, 49], range(11), range(53, 64), range(0, 64, 6))]
    df = spark.createDataFrame([(i, f"{m:016x}") for i, m in enumerate(made)], "doc_id long, fingerprint string")
    got = {x.fingerprint: [tuple(n) for n in x.near] for x in simhash.near_prints(df, F.col("doc_id") % 2 == 0).collect()}
    entries = {b: (made.index(b), made.count(b), f"{b:016x}") for b in made}
    wanted = {f"{a:016x}": sorted(((a ^ b).bit_count(), *entries[b]) for b in entries if (a ^ b).bit_count() <= 11) for a in made[::2]}
    assert got == wanted


def test_simhash_of_copies_grows_with_the_rows(spark, tmp_path):
    docs = spark.range(64_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash.op2_simhash(spark, str(tmp_path))
    assert got.count() == 64_000
    asked = got.where("near is not null").select("doc_id", F.size("near").alias("n"), F.col("near")[0].alias("e"), "n_within_3").collect()
    assert len(asked) == 640 and all(r.doc_id % 100 == 0 and r.n == 1 and tuple(r.e) == (0, 0, 64_000, "0" * 16) and r.n_within_3 == 64_000 for r in asked)


@pytest.mark.parametrize("text", ["", "one", "one two", "a b a b a b c", "Ünï ✓ x x x", " ".join(f"w{i % 37}" for i in range(500)), "ab " * 3000])
def test_simhash_by_a_slow_vote(text):
    import math
    from collections import Counter

    import xxhash

    ones, words = (1 << 64) - 1, [xxhash.xxh3_64_intdigest(w) for w in text.split()]
    terms = Counter(words)
    for a, b in zip(words, words[1:]):
        mixed = (a * 0x9E3779B97F4A7C15 + (b ^ b >> 32) * 0xC2B2AE3D27D4EB4F) & ones
        terms[(mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 & ones] += 1
    votes = [sum((1 + math.log(n)) * (1 if t >> bit & 1 else -1) for t, n in terms.items()) for bit in range(64)]
    print_of = simhash.Fingerprinter()
    got = print_of.fingerprint(print_of.words(text))
    assert all(got >> bit & 1 == (v > 0) for bit, v in enumerate(votes) if abs(v) > 1e-3)


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    net = language_gru.fit(language_gru.training_sample(docs, 100), steps=120)
    got = language_gru.predict(docs, net).join(docs.select("doc_id", "lang", (F.length("text")).alias("n")), "doc_id").where("n > 100")
    assert got.where("lang = lang_pred").count() >= 0.9 * got.count()
    known = {r.doc_id: r for r in language_gru.predict(odd, net).collect()}
    assert known[3].lang_pred == known[4].lang_pred == known[8].lang_pred == "und" and known[7].lang_pred in net.labels and 0 <= known[7].score <= 1
    assert language_gru.predict(empty, net).count() == 0
    assert {r.lang_pred for r in language_gru.predict(odd, language_gru.fit([])).collect()} == {"und"}


def test_language_counts_each_byte_once():
    import numpy as np
    import pyarrow as pa

    from trackloom.llm import byte_models

    sizes = np.array([1, 111, 112, 113, 127, 128, 129, 224, 225, 320, 1000])
    got = np.zeros(len(sizes), int)
    for _, lengths, owner, number in byte_models.chunked(pa.array(["x" * n for n in sizes]), language_gru.CHUNK, language_gru.CORE, 4):
        np.add.at(got, owner, language_gru.own_positions(lengths, number, sizes[owner]).sum(1))
    assert got.tolist() == sizes.tolist()


def test_language_gradients():
    import numpy as np

    net, r = language_gru.BiGru(["a", "b"], hidden=3), np.random.default_rng(1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    data, valid, y = r.integers(97, 100, (5, 4)).astype(np.uint8), np.ones((5, 4), bool), np.array([0, 1, 1, 0])
    _, grads = net.gradients(data, valid, y)
    for name, at in (("uf", (1, 2)), ("xb", (98, 4)), ("ob", (1, 0)), ("ub", (7, 1))):
        kept = net.params[name][at]
        losses = []
        for d in (1e-3, -1e-3):
            net.params[name][at] = kept + d
            losses.append(net.gradients(data, valid, y)[0])
        net.params[name][at] = kept
        assert abs((losses[0] - losses[1]) / 2e-3 - grads[name][at]) < 2e-3


def test_quality(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    net = quality_conv.fit(quality_conv.training_sample(docs, labels))
    held = quality_conv.scores(docs.select("doc_id", "text"), net).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    assert held.where((F.col("score") >= 0.7) == (F.col("quality") == 1)).count() >= 0.9 * held.count()
    assert all(0 <= r.score <= 1 for r in quality_conv.scores(odd.select("doc_id", "text"), net).collect())
    assert quality_conv.keep_good(odd, labels.where("doc_id < 0")).count() == len(ODD) and quality_conv.keep_good(odd, labels).columns == odd.columns
    assert quality_conv.scores(empty.select("doc_id", "text"), net).count() == 0


def test_pii(spark, odd, empty):
    text = 'Mr. John Smith, js.1@mail5.example.com, +1 (743) 555-3824, 4111 1111 1111 1111, 10.2.3.4, token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e"; Smith: +1 743 555 3824'
    decoys = "1234567890123456 and 3.14159, version 1.2.3, 12:30, a@b"
    df = spark.createDataFrame([(1, text), (2, text.upper()), (3, decoys), (4, "Frau Ingrid Meyer")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_pii(df, "k").collect()}
    for real in ("John", "Smith,", "js.1@", "743", "4111", "10.2.3.4", "2321bac4"):
        assert real not in got[1]
    digits = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", got[1])[0]
    assert f"+1 {' '.join(digits)}" in got[1] and got[3] == decoys and re.fullmatch(r"Frau (\S+) (\S+)", got[4])[1] in pii.FEMALE_NAMES
    card = re.findall(r"\d{4} \d{4} \d{4} \d{4}", got[1])[0].replace(" ", "")
    assert sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(card)) % 10 == 0
    assert got == {r.doc_id: r.text for r in pii.replace_pii(df, "k").collect()} and pii.replace_pii(empty, "k").count() == 0
    clean = {r.doc_id: r for r in pii.replace_pii(odd, "k").collect()}
    assert clean[3].text is None and clean[7].text == ODD[8][1] and "555-3824" not in clean[None].text
    many = spark.range(3000).select(F.lit("surname").alias("kind"), F.concat(F.lit("Q"), F.conv(F.col("id").cast("string"), 10, 36)).alias("value"), F.lit("u").alias("gender"))
    made = pii.surrogates(many, "k").collect()
    assert len(made) == len({r.surrogate for r in made}) == 3000


def test_pii_carries_names(spark):
    texts = ["Mr. John Smith met us. Smith said so, and SMITH's dog; smith and Smithson.", "John Smith and Anna Keller saw Peter Novak. Keller left, Anna stayed.", "MR. JOHN SMITH came. Smith said it.", "Frau De Vries de Berlin: Vries, de la", "no names in here, but john 4111 1111 1111 1111", "Сергей Иванов и Иванов"]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    for k, hidden in ((0, "smith"), (1, "smith|anna|keller|peter|novak"), (2, "john|smith"), (3, "vries"), (5, "иванов|сергей")):
        assert not re.search(rf"(?i)\b(?:{hidden})\b", got[k].text), got[k].text
    last = re.match(r"Mr\. (\S+) (\S+) met us\. (\S+) said so, and (\S+)'s dog; (\S+) and Smithson\.", got[0].text)
    assert last[2] == last[3] and last[4] == last[2].upper() and last[5] == last[2].lower() and got[0]._pii_n == 4
    upper = re.match(r"MR\. (\S+) (\S+) came\. (\S+) said it\.", got[2].text)
    assert upper[2] == upper[3].upper() == last[4] and upper[1] == last[1].upper()
    assert " de Berlin" in got[3].text and got[3].text.endswith(", de la") and "but john" in got[4].text


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", r"<\s> <\\/s> [\ROLE] \ [x]", "", "<image:1> plain"]
    turns = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "assistant", None, "assistant"], hard))] + [(2, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    made = chat_format.formatted(turns.withColumn("parts", chat_format.text_parts(F.col("text"))))
    got = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in zip(["user", "assistant", "", "assistant"], hard)).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256((hard[1] + hard[3]).encode()).hexdigest() and got[1].n_turns == 4 and got[2].loss_chars == 0
    parts = "array(named_struct('kind','text','text','see ','ref',null,'width',null,'height',null,'seconds',null,'pages',null), named_struct('kind','image','text',null,'ref','a.png','width',28,'height',15,'seconds',null,'pages',null), named_struct('kind','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',1.5D,'pages',null), null)"
    row = chat_format.formatted(turns.limit(1).withColumn("parts", F.expr(parts))).first()
    assert row.segment.endswith("see <image:1><audio:2></s>") and [tuple(a) for a in row.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38)]


PAGE = '<html><head><title>T</title></head><body><div class="menu-3"><a href=x>Home</a></div><div class="cookie-notice">We use cookies</div><div class="wrap"><div class="text-{n}"><h1>Real &amp; {n}</h1><p>First <a href=y>link</a> para.<p>Second<br>line &lt;x&gt;<ul><li>one<li>two</ul><div class="ad">Buy</div><form>Mail</form></div></div><div class="plain">{side}</div><section id="comments"><p>Nice</p></section><script>var a="</div>";</script><footer>(c)</footer></body>'


def test_html(spark):
    pages = [(i, f"http://h.example.com/{i}", PAGE.format(n=i, side="side" if i else "a longer aside than all of the main text, so that this page alone would choose it " * 3)) for i in range(4)] + [(9, None, None), (10, "x", "<p>alone"), (11, "http://z/", '<div class="never closed')]
    got = {r.page_id: r.text for r in html_consensus.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i] == f"Real & {i}\nFirst link para.\nSecond line <x>\none\ntwo"
    assert got[9] == "" and got[10] == "alone" and got[11] == ""


def main_text(page):
    return html_consensus.text_at(*html_consensus.scan(page), None)


LONG = "This is a sentence of the main text, which goes on for a while. " * 8


def test_html_keeps_main_text_beside_articles():
    cards = '<article class="card"><p>A teaser of another page.</p></article>' * 2
    for tag in ("main", "div"):
        got = main_text(f"<body><{tag}><h1>Title</h1><p>{LONG}</p></{tag}>{cards}</body>")
        assert got.startswith(f"Title\n{LONG.strip()}")
    parts = main_text(f"<body><div class=page><div class=intro><h1>Title</h1><p>{LONG[:160]}.</p></div><div class=body><p>{LONG}</p></div></div><div>Label</div></body>")
    assert parts == f"Title\n{LONG[:160].strip()}.\n{LONG.strip()}"
    listed = main_text("<body>" + "".join(f"<article><p>{LONG}{i}</p></article>" for i in range(3)) + "</body>")
    assert listed.count("\n") == 2
    assert main_text(f"<body><article><h1>Title</h1><p>{LONG}</p></article><div><p>Some other text on the side.</p></div></body>") == f"Title\n{LONG.strip()}"


def test_html_class_words_do_not_drop_the_main_text():
    wanted = f"Title\n{LONG.strip()}"
    for name in ("content no-sidebar", "has-sidebar", "elementor-widget-container", "post-share-enabled", "sidebar", "header-fixed"):
        assert main_text(f'<body><div class="{name}"><h1>Title</h1><p>{LONG}</p></div><div class="sidebar"><p>Some other text on the side.</p></div></body>') == wanted
        assert main_text(f'<body><div class="{name}"><article><h2>Title</h2><p>{LONG}</p></article></div><div class="ad"><p>Buy one of these now.</p></div></body>') == wanted
    comments = '<div class="comments"><article class="comment"><p>' + LONG * 3 + "</p></article></div>"
    assert main_text(f"<body><article><h1>Title</h1><p>{LONG}</p></article>{comments}</body>") == wanted
    assert main_text(f"<body><h1>Title</h1><p>{LONG}</p>{comments}</body>") == wanted


def test_queries_and_pipeline(spark):
    import corpus_pipeline

    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name in ("op2_simhash", "op5_exact_dedup", "op6_ngram_jaccard_join", "op7_bpe_chunk_reuse"):
        assert registry.QUERIES[name](spark, DATA).count() == n
    docs = corpus_pipeline.run(spark, DATA)
    assert 0 < docs.select("doc_id").distinct().count() < n


def test_pii_is_injective_and_consistent(spark):
    """Brute force over generated mentions: one surrogate an entity, in every notation and under every title, and no two alike."""
    given = pii.MALE_NAMES[:12] + pii.FEMALE_NAMES[:12] + [f"Xa{c}lo" for c in "bcdfghjklm"]
    titles = ["Mr", "Mrs", "Dr", "Prof"]
    mentions = [(f"{titles[(i + k) % 4]} {g} Zyx{chr(97 + i)}ko", g) for i, g in enumerate(given) for k in range(3)]
    phones = [(f"+1 (743) 555-38{n:02d}", f"(743) 555-38{n:02d}", f"743-555-38{n:02d}") for n in range(20)]
    rows = [(i, m) for i, (m, _) in enumerate(mentions)] + [(1000 + 3 * n + k, f"call {p} now") for n, ps in enumerate(phones) for k, p in enumerate(ps)]
    rows += [(5000, "Mrs O’Neil and Mr D'Angelo"), (5001, "Mr John Smith-Jones")]
    got = {r.doc_id: r.text for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    made = {}
    for i, (m, g) in enumerate(mentions):
        title, first, last = got[i].split(" ")
        assert title == m.split(" ")[0] and made.setdefault(g, first) == first and first not in given and "Zyx" not in last
    assert len(set(made.values())) == len(given)
    numbers = set()
    for n in range(20):
        a, b, c = (re.sub(r"\D", "", got[1000 + 3 * n + k]) for k in range(3))
        assert a == "1" + b and b == c and b != re.sub(r"\D", "", phones[n][1])
        numbers.add(b)
    assert len(numbers) == 20
    assert re.fullmatch(r"Mrs O’[A-Z][a-z]+ and Mr D'[A-Z][a-z]+", got[5000]) and "Neil" not in got[5000] and "Angelo" not in got[5000]
    assert re.fullmatch(r"Mr \S+ [A-Z][a-z]+-[A-Z][a-z]+", got[5001]) and "Smith" not in got[5001]


def test_neighbouring_parts(spark):
    part = lambda kind, text: f"named_struct('kind','{kind}','text',{text},'ref','r','width',1,'height',1,'seconds',1.0D,'pages',1)"
    parts = f"array({part('text', repr('<'))}, {part('text', repr('/s>'))}, null, {part('image', 'null')}, {part('text', repr('['))}, {part('text', repr('INST]'))})"
    turns = spark.createDataFrame([(1, 0, "assistant"), (1, 1, "user")], "conv_id long, turn long, role string")
    made = chat_format.formatted(turns.withColumn("parts", F.expr(parts)))
    segment = made.where("turn = 0").first().segment
    assert segment.count("</s>") == 1 and segment.endswith("</s>") and "[INST]" not in segment
    got = chat_format.read_back(made).first()
    wanted = "</s><image:1>[INST]"
    assert got.n_turns == 2 and got.turns_sha256 == hashlib.sha256(f"assistant\n{wanted}\nuser\n{wanted}\n".encode()).hexdigest()


def test_stitching_is_linear_and_exact():
    import time

    encoder = tokenizer.loaded(tokenizer.default_path())
    blob = "".join(f"{i:x}QmFz" for i in range(160_000))
    for text in (blob, "words before it " * 40 + blob[:50_000] + " and words after it" * 40, "a b " * 3000, "Ünï-cödé, " * 2000):
        parts = [c.decode() for c in bpe.chunks(text.encode())]
        began = time.time()
        got = bpe.stitch([(c, encoder.encode_bytes(c) if i % 2 and len(c) < 9000 else None) for i, c in enumerate(parts)], encoder.encode_bytes)
        assert time.time() - began < 10
        assert got == encoder.encode_bytes(text) == array("I", encoder.library.encode(text, add_special_tokens=False).ids).tobytes()


def test_registered_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, sql in registry.ORACLES.items():
        df = registry.QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        wanted = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert rows(df.select(*columns)) == sorted(wanted, key=repr), name


def test_queries_against_brute_force(spark):
    """Every row of op4 and op7 by the library, of op2's contract by its definition; the columns and ranges of op1, op3, op8, op10."""
    import zlib

    library = tokenizer.loaded(tokenizer.default_path()).library
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    bins = defaultdict(list)
    pieces = set()
    for r in registry.QUERIES["op4_best_fit_packing"](spark, DATA).collect():
        part = (ids[r.doc_id] + [0])[r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(part) == r.length and zlib.crc32(array("I", part).tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
        pieces.add((r.doc_id, r.piece))
    assert pieces == {(i, k) for i, x in ids.items() for k in range(len(x) // 2048 + 1)}
    assert all(sum(n for _, n in b) <= 2048 and sorted(o for o, _ in b) == [sum(n for p, n in b if p < o) for o, _ in sorted(b)] for b in bins.values())
    for r in registry.QUERIES["op7_bpe_chunk_reuse"](spark, DATA).collect():
        assert r.n_tokens == len(ids[r.doc_id]) and r.ids_sha256 == hashlib.sha256(array("I", ids[r.doc_id]).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    order, print_of = sorted(docs, reverse=True), simhash.Fingerprinter()
    known = {i: print_of.fingerprint(print_of.words(t)) for i, t in docs.items()}
    likeness = lambda a, b: 1 - (a ^ b).bit_count() / 64
    for r in registry.QUERIES["op2_simhash"](spark, DATA).collect():
        nxt = order[(order.index(r.doc_id) + 1) % len(order)]
        text = docs[r.doc_id]
        edited = text[: len(text) - len(text) // 2] + docs[nxt][: len(text) // 2]
        changed = print_of.fingerprint(print_of.words(edited))
        assert (r.near_edited, r.near_next) == (likeness(known[r.doc_id], changed), likeness(known[r.doc_id], known[nxt]))
        assert r.n_within_3 == (sum((known[r.doc_id] ^ p).bit_count() <= 3 for p in known.values()) if r.doc_id % 100 == 0 else None)
    for name, n, columns in (("op1_pii_surrogates", len(docs), {"doc_id", "text"}), ("op3_language_gru", len(docs), {"doc_id", "held_out", "lang_pred", "score"}), ("op8_quality_conv", len(docs), {"doc_id", "held_out", "score", "predicted"}), ("op10_html_consensus", 50, {"page_id", "url", "text", "n_chars"})):
        got = registry.QUERIES[name](spark, DATA).collect()
        assert len(got) == n and columns <= set(got[0].asDict())
        assert all(0 <= r.score <= 1 for r in got if "score" in columns) and all(r.n_chars == len(r.text) for r in got if "n_chars" in columns)
        for r in got if "held_out" in columns else ():
            mod, rest = (3, 1) if "lang_pred" in columns else (4, 2)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest)


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    """Nulls, repeats, long texts, an empty table and columns of clashing names pass every stage in sequence."""
    import corpus_pipeline

    for start in (odd.withColumn("score", F.lit(1)).withColumn("row", F.lit("r")).withColumn("c0", F.lit(2)), empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == start.columns, name
            docs = spark.createDataFrame(out.collect(), start.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
        assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}


def test_html_takes_linear_time():
    import time

    for page in ("<div class=sidebar>" * 2000 + "<h1>Title</h1><p>Some text that is long enough.</p>", "<div class=sidebar><h1>T</h1></div>" * 2000, "<div>" * 5000 + "<p>Some text that is long enough.", "<header>" * 3000 + "<p>x", "<span class=ad>" * 5000 + "<p>Some text that is long enough."):
        began = time.process_time()
        main_text(page)
        html_consensus.text_at(*html_consensus.scan(page), "div>" * 50 + "div")
        assert time.process_time() - began < 1.0, page[:30]


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ('<div class=wrap><p>Short intro</p><div class=body><p>{0}</p></div></div>', "Short intro\n{0}"),
        ("<article><h1>T</h1><p>{0} <span class=\"advert\">Buy <span>now</span>!</span>On it goes.</p></article>", "T\n{0} On it goes."),
        ("<article><p>{0}</p><ins class=\"adsbygoogle\">Cheap things here for you.</ins><p>More of it.</p></article>", "{0}\nMore of it."),
        ("<article><p>{0}</p><p hidden>Nobody sees this text here.</p><div style='color:red; display: none'><p>Nor that.</p></div></article>", "{0}"),
        ("<article><p>{0}</p><p data-hidden=\"x\" title=\"hidden\">This is seen by all.</p><p style=\"color: red\">And this.</p></article>", "{0}\nThis is seen by all.\nAnd this."),
        ("<article><p>{0}</p><p>An <span class=ad>unclosed thing stays.</p></article>", "{0}\nAn unclosed thing stays."),
        ("<article><p>{0}</p><p>A <span class=\"add-on lead\">word</span> of it.</p></article>", "{0}\nA word of it."),
    ],
)
def test_html_keeps_and_drops(page, wanted):
    assert main_text(f"<body>{page.format(LONG)}</body>") == wanted.format(LONG.strip())


def test_html_leaves_a_path_that_has_but_a_teaser():
    pages = "<body><div class=a><p>Just a teaser here.</p></div><div class=b><h1>Title</h1><p>" + LONG + "</p></div></body>"
    root, blocks = html_consensus.scan(pages)
    assert html_consensus.text_at(root, blocks, "body>div.a") == f"Title\n{LONG.strip()}" or html_consensus.text_at(root, blocks, "body>div.a").endswith(LONG.strip())
    assert html_consensus.text_at(root, blocks, "body>div.b") == f"Title\n{LONG.strip()}"
