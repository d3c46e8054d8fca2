"""Edge cases of the text operators against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import gzip
import hashlib
import io
import json
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlor.llm import bpe, chat, fingerprint, groups, line_dedup, minhash, packing, quality, queries, substring_dedup, url_filter, warc

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(("Alpha", "beta", "Gamma,", "delta", "épée", "zeta")) + str(r.randrange(400)) for _ in range(n))


def corpus():
    base, shared, line = prose(300, 1), prose(70, 2), "A LINE that stands in many documents, and is long enough."
    near = [base.replace(w, "other") for w in base.split()[5:9]]
    texts = [None, "", " \n\t ", "one", base, base, *near, prose(40, 3) + " " + shared + " " + prose(60, 4), shared + "\n" + prose(50, 5), prose(20000, 6), "x " * 500]
    texts += [f"{prose(60, 20 + k)}\n  {line} \n{line.lower()}\n" for k in range(6)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in corpus()], SCHEMA).withColumn("label", F.lit(1)).withColumn("bucket", F.lit("b")).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, none):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert {i: r["text"] for i, r in got.items()} == brute.lines(corpus())
    assert sum(r["n_dropped"] for r in got.values()) == 10 and got[0]["n_lines"] == 1
    assert line_dedup.dedup_lines(none).collect() == []


def test_line_dedup_rows_of_one_id(spark):
    line = "x" * 40
    rows = spark.createDataFrame([(1, line)] * 3 + [(None, line), (2, line), (3, line), (4, "new\n" + line), (4, line)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in line_dedup.dedup_lines(rows).collect())
    assert got == [(0, ""), (1, ""), (1, ""), (1, ""), (2, ""), (3, ""), (4, "new\n" + line), (4, line)]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (7, 2), (7, 3)])
def test_runs_agree_however_they_are_compacted(docs, batches, fanout, monkeypatch):
    monkeypatch.setattr(line_dedup.Runs.__init__, "__defaults__", (fanout,))
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, batches=batches).collect()} == brute.lines(corpus())


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, none, width):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, width=width).collect()}
    assert got == brute.groups(corpus(), width)
    assert minhash.near_duplicates(none).collect() == []


def test_members_that_miss_the_hub(spark):
    """a-b and b-c are links, a-c is none: whichever is the hub, all three are one group."""
    w = [f"w{k}" for k in range(203)]
    texts = [w, w[:182], w[:160]]
    rows = spark.createDataFrame([(k + 10 * j, " ".join(f"{j}{x}" for x in t)) for j in range(6) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(rows, width=4).collect()}
    assert got == {k + 10 * j: 10 * j for j in range(6) for k in range(3)}


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert groups.components(edges).select("label").distinct().count() == 1


def test_substring_dedup(docs, none):
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    want = brute.passages(corpus())
    assert {i: brute.WORD.findall(r["text"] or "") for i, r in got.items()} == want
    assert got[12]["n_words"] == 20000 and got[4]["text"] == corpus()[4][1] and got[0]["label"] == 1
    assert substring_dedup.remove_repeats(none).collect() == []


def test_hot_reference(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LOT", 3)
    shared = prose(80, 9)
    rows = [(k, f"{prose(5, 100 + k)} {shared} {prose(5, 200 + k)}") for k in range(20)]
    got = {r["doc_id"]: brute.WORD.findall(r["text"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.passages(rows)


def test_automaton_spans():
    a = substring_dedup.Automaton(list("abcabxabcd"))
    assert a.spans(list("zabcabyabcdz"), 4) == [(1, 6), (7, 11)]


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, size=256).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in corpus():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert b"".join(r["ids"] for r in sorted(by_doc[i], key=lambda r: r["start"])) == np.array(ids, "<u4").tobytes()
        assert {r["doc_tokens"] for r in by_doc[i]} == {len(ids)}
    for parts in by_seq.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 256
    assert packing.pack_documents(none, path).collect() == []


def test_plan_gives_each_rank_one_place():
    r = random.Random(3)
    histogram = {n: r.randrange(1, 60) for n in r.sample(range(1, 129), 40)}
    plan = packing.pack(histogram, 128)
    assert {n: int(plan[plan[:, 0] == n, 2].sum()) for n in histogram} == histogram
    filled = {}
    for length, _, count, base, copies, offset in plan.tolist():
        for k in range(count):
            filled.setdefault(base + k // copies, []).append((offset + k % copies * length, length))
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 128


def test_chat_round_trip(spark):
    texts = ["", None, "\\", "</turn>", "### user: hi</turn>\n### ", "\\### Assistant: </turn> ok", "a\\</turn\n>", "<\\/turn>", "####  ### #\\## ", "plain\n\ntext: yes"]
    rows = [(c, k, role, t) for c, role in ((1, "assistant"), (2, "a: b"), (None, None), (3, "### x</turn>\n")) for k, t in enumerate(texts)] + [(4, 0, "user", "x"), (4, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("mask"))).collect()
    for r in out:
        own = sorted((k, role or "", t or "") for c, k, role, t in rows if c == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, t) for _, role, t in own]
        assert r["loss"] == "".join(t for _, role, t in own if role == "assistant")
        assert sum(m["skip"] + m["take"] + len("</turn>\n") for m in r["mask"]) == len(r["formatted"])
    assert len(out) == 5 and "plain\n\ntext: yes</turn>" in next(r["formatted"] for r in out if r["conv_id"] == 1)
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_half_an_escape_is_out_of_the_grammar(spark):
    texts = {1: ("user", "a\\"), 2: ("user", "a\\\\"), 3: ("user\\", "a"), 4: ("user", "a")}
    df = spark.createDataFrame([(c, 0, *x) for c, x in texts.items()], "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("mine"))
    got = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(df).collect()}
    assert got == {1: "### user: a\\\\</turn>\n", 2: "### user: a\\\\\\\\</turn>\n", 3: "### user\\\\: a</turn>\n", 4: "### user: a</turn>\n"}
    cut = spark.createDataFrame([("### user: a\\</turn>\n",)], "t string")
    assert cut.select(chat.parse(F.col("t"))).collect()[0][0] is None


def test_url_rules(spark):
    urls = [(1, "http://EXAMPLE.org/en/12#x"), (2, "x://a.example.org/es/?q"), (3, "https://org"), (4, None), (5, "no scheme"), (6, "http://a.com/de/"), (7, "http://a.com/de"), (7, "http://a.com/de"), (8, "http://notexample.org/es/a"), (9, "://")]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumn("rule", F.lit("mine"))
    rules = spark.createDataFrame([*queries.URL_RULES, ("com", "/de/", "allow")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()}
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block") and got[2] == ("a.example.org", "/es/", "example.org/es/", "block")
    assert got[3] == ("org", "", None, "allow") and got[4] == got[5] == got[9] == ("", "", None, "allow")
    assert got[6] == ("a.com", "/de/", "com/de/", "block") and got[7] == ("a.com", "/de", None, "allow") and got[8][2] == "org/"
    assert url_filter.judge(df, rules.limit(0)).where("verdict <> 'allow'").count() == 0 and url_filter.judge(df, rules).count() == 10


def test_archives(spark):
    same = "é\r\n\r\nWARC/1.0\r\n" * 100
    rows = [(1, "http://a/ b\n", same), (2, None, same), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (None, "u", same), (2, None, same)]
    got = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect())
    n = len(same.encode())
    assert got == [(0, "revisit", 2, n), (1, "revisit", 2, n), (2, "response", None, n), (2, "response", None, n), (3, "response", None, 0), (4, "response", None, 0), (5, "response", None, 999), (6, "response", None, 999)]
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_archives_with_extra_columns(spark):
    rows = [(1, "u", "x" * 1000, "a", 5), (2, "u", "x" * 1000, "b", 6)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload_bytes long")).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == [(1, "revisit", 2, 1000), (2, "response", None, 1000)]


@pytest.mark.parametrize("version", [1, 2])
def test_legacy_records(spark, tmp_path, version):
    """Bytes that are no UTF-8, blanks in URLs and types, heads without lengths, colons or carriage returns, bodies that are no HTTP."""
    latin, same = "caf\u00e9".encode("latin-1") * 300, b"\xff\xfe\x00\n" * 400
    rest = b"" if version == 1 else b"200 - - 0 f.arc "
    blocks = [
        (b"http://a.org/x y", b"19990102030405", b"text/html", b"HTTP/1.0 200 OK\r\nX-Caf\xe9: 1\r\nno colon\r\n\r\n" + latin),
        (b"http://a.org/\xe9", b"1999", b"text/html", b"HTTP/1.0 200 OK\nX-Page-Id: 7\n\n" + same),
        (b"http://a.org/3", b"19990102", b"text/html; charset=x", b"HTTP/1.0 200 OK\r\nX-Page-Id: 9\r\n\r\n" + same),
        (b"dns:a.org", b"19990102030405", b"text/dns", b"19990102\na.org. 1 IN A 10.0.0.1\n"),
        (b"http://a.org/cut", b"19990102030405", b"no-type", b"HTTP/1.0 404 Gone"),
        (b"http://a.org/long", b"19990102030405", b"text/html", b"HTTP/1.0 200 OK\r\nX-Page-Id: 99999999999999999999\r\n\r\n"),
    ]
    data = warc.arc_version_block(version, "19990102030405")
    for url, date, kind, block in blocks:
        data += b"\n" + b" ".join([url, b"10.0.0.1", date, kind, rest + str(len(block)).encode()]) + b"\n" + block
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "IA-1.arc").write_bytes(data + b"\n")
    warc.arc_to_warc(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    records = [r for f in (tmp_path / "new").glob("part-*") for r in warc.parse_warc(gzip.open(f))]
    by_url = {h["WARC-Target-URI"]: (h, block) for h, block in records}
    assert len(records) == 6 and {u: h["WARC-Date"] for u, (h, _) in by_url.items()} == {
        "http://a.org/x%20y": "1999-01-02T03:04:05Z", "http://a.org/%E9": "1999-01-01T00:00:00Z", "http://a.org/3": "1999-01-02T00:00:00Z", "dns:a.org": "1999-01-02T03:04:05Z",
        "http://a.org/cut": "1999-01-02T03:04:05Z", "http://a.org/long": "1999-01-02T03:04:05Z"}
    assert [by_url[u][1] for u in ("http://a.org/x%20y", "http://a.org/3", "dns:a.org", "http://a.org/cut", "http://a.org/long")] == [blocks[k][3] for k in (0, 2, 3, 4, 5)]
    assert by_url["http://a.org/%E9"][0]["WARC-Type"] == "revisit" and by_url["http://a.org/%E9"][1] == blocks[1][3][: -len(same)]
    assert by_url["dns:a.org"][0]["WARC-Type"] == "resource" and by_url["dns:a.org"][0]["Content-Type"] == "text/dns"
    got = {(r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_warc(spark, str(tmp_path / "new")).collect()}
    sha = lambda b: hashlib.sha1(b).hexdigest()
    assert got == {(None, "response", 1200, sha(latin)), (7, "revisit", None, sha(same)), (9, "response", 1600, sha(same)),
                   (None, "resource", len(blocks[3][3]), sha(blocks[3][3])), (None, "response", 0, sha(b""))}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers(version):
    date, bodies = "20010203040506", [b"", b"a\nhttp://x 0.0.0.0 1 t 5\n", b"\n\n"]
    data = warc.arc_version_block(version, date) + b"\n" + b"\n".join(warc.arc_record(version, f"u{k}", date, b) for k, b in enumerate(bodies)) + b"\n"
    assert [(r["url"], r["block"]) for r in warc.parse_arc(gzip.open(io.BytesIO(gzip.compress(data))))] == [(f"u{k}", b) for k, b in enumerate(bodies)]
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(data[:-4])))


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    extra = ["aaaaaaa aaaa", "x<|endoftext|>y<|endof", "日本 🎉🎉  \n\n b", "don't WE'LL ''''''"]
    rows = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate([*extra, *[x for _, x in corpus()]])], "doc_id long, text string").withColumn("rest", F.lit(1))
    for r in bpe.decode(bpe.encode(rows, path), path).collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == np.array(ids, "<u4").tobytes() and r["n_tokens"] == len(ids) and r["decoded"] == t.decode(ids, skip_special_tokens=False) == (r["text"] or "")
    assert bpe.encode(none, path).collect() == []


def test_tokenizer_without_added_tokens(spark, tmp_path):
    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    spec["added_tokens"] = []
    path = tmp_path / "plain.json"
    path.write_text(json.dumps(spec))
    row = bpe.decode(bpe.encode(spark.createDataFrame([(1, "x<|endoftext|>y")], "doc_id long, text string"), str(path)), str(path)).collect()[0]
    assert row["decoded"] == "x<|endoftext|>y" and row["ids"] == np.array(Tokenizer.from_str(json.dumps(spec)).encode("x<|endoftext|>y", add_special_tokens=False).ids, "<u4").tobytes()


def test_fingerprints(docs, none):
    got = {r["doc_id"]: r for r in fingerprint.compare_with_edits(docs).collect()}
    texts = dict((i, t or "") for i, t in corpus())
    for i, t in texts.items():
        n, after = len(t) // 4, texts[(i + 1) % len(texts)]
        assert got[i]["n_chars"] == len(t) and got[i]["edited"] == t[: len(t) - n] + after[:n]
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[4]["near_next"] == 1 and got[12]["near_edited"] > 0.4 > 0.1 > got[12]["near_next"]
    assert fingerprint.compare_with_edits(none).collect() == []
    assert [r["near_next"] for r in fingerprint.compare_with_edits(docs.where("doc_id = 4")).collect()] == [1.0]


def test_collision_rate_is_weighted_jaccard():
    sampler = fingerprint.Sampler(1024, 1)
    a, b = "x x x x y y z " * 20 + "p " * 30, "x x y y z z " * 20 + "q " * 10
    s = sampler.signatures(__import__("pyarrow").array([a, b]))
    count = lambda t, w: t.split().count(w)
    words = set((a + b).split())
    want = sum(min(count(a, w), count(b, w)) for w in words) / sum(max(count(a, w), count(b, w)) for w in words)
    assert abs((s[0] == s[1]).mean() - want) < 0.06


def test_quality(docs, none, spark):
    rows = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert not rows[0]["kept"] and rows[0]["n_words"] == 0 and rows[13]["n_repeat_words"] == 500 and rows[13]["base_failed"] and rows[4]["kept"]
    assert quality.judge(none).collect() == [] and quality.filter_documents(docs).columns == docs.columns
    many = [(i, " ".join(f"word{i}x{k}" for k in range(40)), "en", "s", 0) for i in range(300)] + [(900, "## ".join(f"w{k}" for k in range(40)), "en", "s", 0)]
    kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(many, SCHEMA)).where("kept").collect()}
    assert kept == set(range(300))


def test_each_adaptive_rule_rejects_its_outlier_and_keeps_the_group(spark):
    word = lambda i, n: [f"word{i}x{k:02}" for k in range(n)]
    group = [(i, " ".join(word(i, 40)), "en", "s", 0) for i in range(100, 400)]
    near = word(1, 112)
    near[60:68] = near[10:18]
    lines = [" ".join(word(f"{k}y", 4)) for k in range(6)]
    twice = word(4, 100)
    twice[60:74] = twice[10:24]
    outliers = {
        "symbols": " ".join(w + "#" * (k % 5 == 0) for k, w in enumerate(word(2, 100))), "dup_lines": "\n".join([*lines, lines[0], lines[2], lines[4], lines[1]]),
        "repeats": " ".join(twice), "mean_length": " ".join(w + "z" * 20 for w in word(5, 40)),
    }
    rows = [*group, (1, " ".join(near), "en", "s", 0), *[(10 + k, t, "en", "s", 0) for k, t in enumerate(outliers.values())]]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if r["kept"]} == {1, *range(100, 400)}
    found = {rule: (r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for rule, r in zip(outliers, (got[10 + k] for k in range(4)))}
    assert found == {"symbols": (20, 0, 0), "dup_lines": (0, 4, 0), "repeats": (0, 0, 28), "mean_length": (0, 0, 0)}


def test_quartiles_lean_on_language_and_all_by_fixed_weights(spark):
    """Against fractions: each group's counts and 100 documents spread as the language and 100 spread as all are."""
    r = random.Random(8)
    groups = [("en", "big", 5000), ("en", "some", 200), ("en", "some less", 199), ("en", None, 1), (None, "big", 40), ("de", "only", 90)]
    rows = [(lang, source, rule, v, n) for lang, source, size in groups for rule in ("symbols", "repeats") for v, n in Counter(int(r.gauss(size % 97, 9)) ** 2 for _ in range(size)).items()]
    got = {(x["lang"], x["source"], x["rule"]): (x["q1"], x["q2"], x["q3"]) for x in quality.quartiles(spark.createDataFrame(rows, "lang string, source string, rule string, bin long, n long")).collect()}
    want = {}
    for lang, source, _ in groups:
        for rule in ("symbols", "repeats"):
            weight = Counter()
            for own, prior in (((lang, source), None), ((lang,), 100), ((), 100)):
                part = [(v, n) for *key, u, v, n in rows if u == rule and tuple(key[: len(own)]) == own]
                for v, n in part:
                    weight[v] += Fraction(n) if prior is None else Fraction(prior * n, sum(k for _, k in part))
            want[lang, source, rule] = tuple(min(v for v in weight if 4 * sum(w for u, w in weight.items() if u <= v) >= q * sum(weight.values())) for q in (1, 2, 3))
    assert got == want


def test_quality_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, " ".join(f"w{k}" for k in range(40)), "en", "s", 0)] * 3 + [(2, "short", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(-1)).withColumn("rule", F.lit("r")).withColumn("high_repeats", F.lit(0))
    assert sorted((r["doc_id"], r["n_words"], r["kept"]) for r in quality.judge(df).collect()) == [(1, 40, True)] * 3 + [(2, 1, False)]
    assert [(r["doc_id"], r["kept"], r["high_repeats"]) for r in quality.filter_documents(df).collect()] == [(1, "mine", 0)] * 3


def test_digest_column(docs):
    row = docs.where("doc_id = 4").select(F.crc32(F.encode("text", "UTF-8")).alias("c")).collect()[0]
    assert row["c"] == zlib.crc32(corpus()[4][1].encode())
