"""SimHash groups, Merkle manifest and spelling variants against plain versions and at their edges."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlor.llm import merkle, minhash, packing, simhash, spelling, tokens

from . import brute
from .test_operators import SCHEMA, corpus, docs, none, prose  # noqa: F401


@pytest.mark.parametrize("width, most, spare", [(4, 1024, 1), (5, 2, 1), (4, 3, 2)])
def test_simhash(docs, none, width, most, spare):  # noqa: F811
    clash = docs.withColumn("key", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("component_id", F.lit(3))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(clash, width=width, most=most, spare=spare).collect()}
    assert got == brute.simhash(corpus(), width)
    assert got[0] == got[1] == got[2] == ("0" * 16, 0)
    assert simhash.near_duplicates(none).collect() == []


def test_simhash_rows_without_id_and_of_one_id(spark):
    a, b = prose(40, 1), prose(40, 2)
    rows = spark.createDataFrame([(None, a), (7, a), (7, b), (5, b), (5, b), (None, prose(40, 3))], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(rows).collect() if r["component_id"] is not None)
    assert got == [(-1, 7), (5, 5), (5, 5), (7, 5), (7, 7)]
    assert [r["doc_id"] for r in simhash.near_duplicates(rows).where("component_id IS NULL").collect()] == [None]


@pytest.mark.parametrize("most, spare, budget", [(1024, 1, 4), (4, 1, 4), (2, 2, 3), (4, 3, 4)])
def test_no_link_is_lost(spark, most, spare, budget):
    r = random.Random(most)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):  # chains of links, at all distances around the budget
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for bit in r.sample(range(64), r.randrange(1, budget + 3)):
                x ^= 1 << bit
    fps |= {0xABCD << 48 | k for k in range(40)}  # dense: all below one node
    signed = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
    label = {x: x for x in fps}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(signed, budget, spare, most).collect()]
    near = lambda a, b: (a ^ b).bit_count() <= budget
    linked = {x: x for x in fps}
    for a, b in edges:
        label[top(a)] = top(b)
    todo = sorted(fps)
    while todo:  # breadth first
        group, next_ = [todo[0]], [todo[0]]
        while next_:
            x = next_.pop()
            new = [y for y in todo if y not in group and near(x, y)]
            group += new
            next_ += new
        for x in group:
            linked[x] = min(group)
        todo = [x for x in todo if x not in group]
    assert all((top(a) == top(b)) == (linked[a] == linked[b]) for a in fps for b in fps)
    assert len(edges) <= len(fps) * len(simhash.layouts(budget, spare)) * (1 if most == 1024 else 8)


def test_layouts_hold_every_bit_once():
    for budget, spare in ((4, 1), (4, 2), (3, 3)):
        for layout in simhash.layouts(budget, spare):
            assert sorted(b for first, bits in layout for b in range(first, first + bits)) == list(range(64))
    keys = np.array([0x0123456789ABCDEF, 1 << 63], np.uint64)
    plain = [(0, 64)]
    assert (simhash._original(keys, plain) == keys).all()


def rows_of(n, sources, seed=1):
    r = random.Random(seed)
    return [{"doc_id": r.choice([None, k, k, k, k // 2]), "source": r.choice(sources), "lang": r.choice([None, "en"]), "n_chars": r.choice([None, k]), "text": r.choice([None, "", "a\nb", f"é\n{k}", "x" * 9000])} for k in range(n)]


@pytest.mark.parametrize("n, sources, levels", [(1, [None], 7), (3, ["a"], 7), (40, [None, "", "b", "é", "z", "Z"], 7), (120, [None, "a", "a", "a", "a"], 1), (120, [f"s{k}" for k in range(30)], 2), (12, [f"s{k}" for k in range(400)], 1)])
def test_manifest(spark, monkeypatch, n, sources, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = rows_of(n, sources)
    rows += rows[:3]
    received = lambda r: r["text"].replace("\n", "") if r["text"] is not None and r["doc_id"] is not None and r["doc_id"] % 2 else r["text"]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for c in ("key", "leaf", "tree", "block", "node", "part", "at", "line", "size", "position", "root"):
        frame = frame.withColumn(c, F.lit("mine"))
    out = merkle.manifest(frame.repartition(3), F.when(F.col("doc_id") % 2 == 1, F.translate("text", "\n", "")).otherwise(F.col("text"))).collect()
    want = brute.merkle(rows, received)
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in out) == sorted(want)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in out)
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in rows)


def test_manifest_of_nothing(none):  # noqa: F811
    assert merkle.manifest(none).collect() == []


def test_manifest_finds_what_was_changed(docs):  # noqa: F811
    assert all(r["verified"] for r in merkle.manifest(docs).collect())
    got = {r["doc_id"]: r["verified"] for r in merkle.manifest(docs, F.when(F.col("doc_id") == 4, F.concat("text", F.lit("."))).otherwise(F.col("text"))).collect()}
    assert [i for i, ok in got.items() if not ok] == [4]


@pytest.mark.parametrize("most", [10_000, 3])
def test_near_words(spark, most):
    r = random.Random(5)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(6, 10))) for _ in range(150)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "b" * 3000, "b" * 2999 + "a"}
    got = spelling.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), most).collect()
    assert len(got) == len({(x["word"], x["near"]) for x in got}) and {(x["word"], x["near"]) for x in got} == brute.near_words(words)


def test_acceptor_is_minimal():
    a = spelling.Acceptor(sorted(["abcing", "abcs", "xbcing", "xbcs"]))
    reached, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in reached:
            reached.add(s)
            todo += a.to[s].values()
    assert len(reached) == 7  # start, a or x, b, c, i, n, end


def test_spelling_forms(spark, none):  # noqa: F811
    words = [("receive", 1000), ("recieve", 3), ("receiv", 200), ("recei", 1), ("receves", 4), ("receiveé", 40), ("another", 7), ("anothet", 7)]
    got = {r["word"]: r for r in spelling.spelling_forms(spark.createDataFrame(words, "word string, n long")).collect()}
    assert (got["receiv"]["form"], got["receiv"]["form_n"], got["recei"]["form"], got["recei"]["root"]) == ("receive", 1000, "receiv", "receive")
    assert (got["recieve"]["form"], got["recieve"]["root"], got["recieve"]["n_near"]) == (None, "recieve", 0)
    assert got["another"]["form"] is None and got["another"]["n_near"] == 1 and got["receive"]["n_near"] == 2
    assert spelling.variants(none).collect() == []


def test_ties_take_the_smallest_word(spark):
    words = [("abcdef", 1), ("abcdeg", 9), ("abcdea", 9), ("zbcdef", 8)]
    got = {r["word"]: r["form"] for r in spelling.spelling_forms(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"abcdef": "abcdea", "abcdeg": None, "abcdea": None, "zbcdef": None}


def test_vocabulary(spark):
    text = "Letters LETTERS lettErs-letters letters short Étéééé x1letters"
    rows = spark.createDataFrame([(None, text), (1, text), (1, text), (2, None), (3, "")], "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(0))
    assert {tuple(r) for r in spelling.vocabulary(rows, every=10**9, min_count=1).collect()} == {("letters", 18), ("Étéééé", 3)}
    misspelt = {r["word"]: r["n"] for r in spelling.vocabulary(rows, every=1, min_count=1).collect()}
    assert sum(misspelt.values()) == 18 and all(len(w) == 6 for w in misspelt)  # letters of six lose one and are too short


def test_rows_without_id_and_of_one_id(spark):
    base = [f"w{k}" for k in range(200)]
    near = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (20, 90, 150)]
    far = prose(200, 7)
    rows = [(None, near[0], 1), (None, near[1], 2), (9, near[2], 3), (9, far, 4), (4, far, 5), (4, far, 6), (None, "", 7), (None, None, 8), (3, " ", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 long").withColumn("all", F.lit("x")).withColumn("node", F.lit("y"))  # noqa: F811
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 0, None, True), (0, 0, None, True), (0, 196, 9, False), (0, 196, 9, False), (3, 0, 3, True), (4, 196, 4, True), (4, 196, 4, True), (9, 196, 4, False), (9, 196, 9, True)]
    left = minhash.keep_one(docs)
    assert left.columns == docs.columns
    kept = sorted(r["h1"] for r in left.collect())
    assert kept[0] == 3 and kept[1] in (5, 6) and kept[2:] == [7, 8, 9]
    lone = minhash.near_duplicates(docs.where("doc_id IS NULL")).where("n_shingles > 0").collect()
    assert [(r["component_id"], r["kept"]) for r in lone] == [(None, True)] * 2 and minhash.keep_one(docs.where("h1 < 3")).count() == 1
    assert minhash.keep_one(docs.limit(0)).collect() == []


def test_recall_among_many_relatives(spark):
    """400 relatives at 0.6 that share their buckets, and for every fourth a partner at 0.80 to 0.85."""
    r = random.Random(1)
    base, texts, partners = [f"w{k}" for k in range(200)], [], []
    shingles = lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    for m in range(400):
        w = list(base)
        for j in r.sample(range(200), 6):
            w[j] = f"x{m}_{j}"
        texts.append(w)
        while m % 4 == 0:
            v = list(w)
            for j in r.sample(range(200), 5):
                v[j] = f"y{m}_{j}"
            a, b = shingles(w), shingles(v)
            if 0.8 <= len(a & b) / len(a | b) <= 0.85:
                partners.append((len(texts) - 1, len(texts)))
                texts.append(v)
                break
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")  # noqa: F811
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs, width=4).collect()}
    caught = sum(got[a] == got[b] for a, b in partners)
    assert len(partners) == 100 and caught >= 95
    assert sum(i != c for i, c in got.items()) <= 100  # relatives are no links


def test_large_groups_of_near_copies_stay_whole(spark, monkeypatch):
    """1,500 copies of copies, most of them linked with the one they come from and few others, all in shared buckets."""
    monkeypatch.setattr(minhash, "BLOCK", 100)
    r = random.Random(3)
    shingles = lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    texts, origin = [[f"w{k}" for k in range(200)]], {}
    sets = [shingles(texts[0])]
    while len(texts) < 1500:
        m, p = len(texts), r.randrange(len(texts) if r.random() < 0.5 else min(20, len(texts)))
        v = list(texts[p])
        for j in r.sample(range(200), r.choice([2, 5, 5, 5])):
            v[j] = f"x{m}_{j}"
        s = shingles(v)
        if 100 * len(s & sets[p]) >= 80 * len(s | sets[p]):
            origin[m] = p
            texts.append(v)
            sets.append(s)
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")  # noqa: F811
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs, width=4).collect()}
    assert len(origin) == 1499 and sum(got[m] != got[p] for m, p in origin.items()) == 0


def test_cells_of_several_batches():
    keys = [(1, 0, 0)] * 3 + [(1, 0, 1)] * 4 + [(2, 0, 0)]
    whole = pa.RecordBatch.from_pylist([{"bucket": b, "i": i, "j": j, "node": k} for k, (b, i, j) in enumerate(keys)])
    for cuts in ([0, 8], [0, 1, 2, 5, 8], [0, 0, 3, 7, 8], list(range(9))):
        got = [c["node"].to_pylist() for c in minhash.whole_cells(iter([whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]))]
        assert got == [[0, 1, 2], [3, 4, 5, 6], [7]]
    assert list(minhash.whole_cells(iter([]))) == []


def test_lots_of_one_hub(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LOT", 3)
    base = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(k, " ".join(base[:k] + ["z"] + base[k + 1 :])) for k in range(30)], "doc_id long, text string")  # noqa: F811
    assert {r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {0}


def test_padding(spark):
    """Sequences of the packing are filled but for a hundredth of their places."""
    r = random.Random(2)
    docs = spark.createDataFrame([(None if k == 7 else k // 2, prose(int(r.lognormvariate(4, 1)) + 1, k)) for k in range(1200)], "doc_id long, text string")  # noqa: F811
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=512).select("doc_id", "sequence_id", "offset", "length").collect()
    ends = {}
    for x in rows:
        ends.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert sorted(ends) == list(range(len(ends))) and sum(x["length"] for x in rows) >= 0.99 * 512 * len(ends)
    assert sum(x["doc_id"] is None for x in rows) >= 1


def test_pieces_are_those_of_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, r = Tokenizer.from_file(path), tokens.ChunkEncoder(path), random.Random(4)
    bits = ["don't", "IT'S", "'s", "''s", ".'s", "Ñandú", "×", "a÷b", "<|startoftext|>", "<|STARTOFTEXT|>", "<", "12a3", "²", "İ", "ſ", "日本", "ﬁ", "...", "a-b_c", "\x00", "\x7f", "ß", "Ÿ", "é", "\x85", "º"]
    texts = ["".join(r.choice(bits) + r.choice(["", "", " ", "\n"]) for _ in range(r.randrange(12))) for _ in range(800)] + ["", None, " "]
    ids, bounds = own.encode(pa.array(texts))
    for k, x in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(x or "", add_special_tokens=False).ids
