"""Plans and stored tables that grow with the input and no faster."""

import re

import pytest

from parlor.operators import grants as G
from parlor.operators import search as S
from parlor.workload import fixtures


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def searched(spark):
    texts = [("a", 1, "alpha alpine beta"), ("a", 2, "alpha gamma"), ("b", 1, "alpine"), ("b", 2, "betamax alp"), ("b", 2, "alpha alpha"), (None, 3, "alp beta")]
    docs = spark.createDataFrame(texts, "hub_id string, nid bigint, text string")
    asked = spark.createDataFrame([(1, "alp beta"), (2, "gam-alpha"), (3, "zzz")], "query_id bigint, string string")
    return docs, asked


def test_search_meets_the_queries_within_a_document(searched):
    docs, asked = searched
    for df in (S.index_build(docs), S.word_search(asked, S.index_build(docs), None)):
        assert not re.search(r"hashpartitioning\([^)]*\bword#", _plan(df))


def test_pages_of_the_search_are_those_of_all_hits(searched):
    docs, asked = searched
    index = S.index_build(docs)
    order = lambda r: (r["query_id"], -r["score"], (r["hub_id"] is not None, r["hub_id"]), r["nid"])
    hits = sorted(S.word_search(asked, index, None).collect(), key=order)
    assert len(hits) == 8 and {r["word"] for r in hits} == {"alp", "alpha", "alpine", "beta"}
    for page in (1, 2, 3):
        got = sorted(S.word_search(asked, index, page, 2).collect(), key=order)
        assert got == [r for q in (1, 2) for r in [h for h in hits if h["query_id"] == q][2 * page - 2:2 * page]]


def test_a_view_without_joins_is_not_stored(spark, tmp_path):
    folder = str(tmp_path)
    spark.sql("SELECT 1L event_id, 5L user_id, 'view' event_type, '{}' props UNION ALL SELECT 2L, 5L, 'error', NULL").write.parquet(f"{folder}/events.parquet")
    t = fixtures.Tables(spark, folder)
    assert sorted((r["sys_id"], r["owner_id"], r["intime"]) for r in t.login_log.collect()) == [(1, "u5", 1700000001), (2, "u5", None)]
    assert t.cookie.count() == 2
    stored = {name for _, place, name in fixtures._STORED if place == folder}
    assert stored == {"cookie"}


def test_grant_walks_keep_compressed_tables(spark, monkeypatch):
    def refuse(self, *args, **kwargs):
        raise AssertionError("rows of a checkpoint are not compressed")

    media = spark.createDataFrame([("h", "root", "0"), ("h", "o", "root"), ("h", "f", "o")], "hub_id string, id string, parent_id string")
    rules = spark.createDataFrame([("h", "root", "u1", 1, 7, "x")], "hub_id string, resource_id string, entity_id string, permission int, expiry_time bigint, message string")
    asked = spark.createDataFrame([("h", "u1", "f"), ("h", "u2", "f")], "hub_id string, uid string, node_id string")
    monkeypatch.setattr(type(media), "checkpoint", refuse)
    got = {(r["uid"], r["expiry_time"], r["permission"]) for r in G.effective_grant(asked, media, rules).collect()}
    assert got == {("u1", 7, 1), ("u2", 0, 0)}
