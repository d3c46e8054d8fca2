"""The bounded plan shapes against brute force, with one hot group and tiny blocks."""

import random

from pyspark.sql import functions as F

from conftest import rows
from parlor.plans.skew import count_upto, first_not_excluded, list_in_parts, paginate, rank_in_groups, top_in_groups


def sample(spark, n=400, seed=1):
    rnd = random.Random(seed)
    data = {}
    for _ in range(n):
        group = "hot" if rnd.random() < 0.5 else f"g{rnd.randrange(20)}"
        data[(group, rnd.randrange(-500, 5000))] = rnd.choice("abcdef")
    data = [(g, s, v) for (g, s), v in data.items()]
    return data, spark.createDataFrame(data, "g string, s bigint, v string")


def test_rank_in_groups(spark):
    data, df = sample(spark)
    for desc in (False, True):
        want = []
        for g in {d[0] for d in data}:
            for i, (_, s, v) in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: d[1], reverse=desc), 1):
                want.append((g, s, v, i))
        got = rows(rank_in_groups(df, ["g"], "s", "r", desc, width=7), "g", "s", "v", "r")
        assert got == sorted(want, key=repr)


def test_top_and_pages(spark):
    data, df = sample(spark)
    for k in (1, 5, 60):
        want = []
        for g in {d[0] for d in data}:
            want += [(*d, i) for i, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (d[2], -d[1]))[:k], 1)]
        assert rows(top_in_groups(df, ["g"], [F.col("v").asc(), F.col("s").desc()], k)) == sorted(want, key=repr)
    page = rows(paginate(df, ["g"], [F.col("s").asc()], 2, 10))
    want = [d for g in {d[0] for d in data} for d in sorted((x for x in data if x[0] == g), key=lambda d: d[1])[10:20]]
    assert page == sorted(want, key=repr)


def test_count_upto(spark):
    data, df = sample(spark)
    rnd = random.Random(2)
    probes = [("hot", rnd.randrange(-600, 5100), i) for i in range(200)] + [(f"g{rnd.randrange(25)}", rnd.randrange(5000), 1000 + i) for i in range(100)]
    doubled = df.unionByName(df.where("v = 'a'"))
    all_events = data + [d for d in data if d[2] == "a"]
    got = rows(count_upto(doubled.select("g", "s"), spark.createDataFrame(probes, "g string, s bigint, k bigint"), ["g"], "s", "n", width=11), "g", "s", "k", "n")
    want = [(g, s, k, sum(1 for d in all_events if d[0] == g and d[1] <= s)) for g, s, k in probes]
    assert got == sorted(want, key=repr)


def test_first_not_excluded(spark):
    data, df = sample(spark)
    rnd = random.Random(3)
    groups = sorted({d[0] for d in data})
    members = [(g, f"u{i}") for g in groups for i in range(6)] + [("empty", "u0")]
    hidden = set()
    for g, u in members:
        mine = sorted((d[1] for d in data if d[0] == g), reverse=True)
        for s in mine[: rnd.randrange(0, 4)] + rnd.sample(mine, min(3, len(mine))):
            hidden.add((g, u, s))
        if u == "u5":
            hidden |= {(g, u, s) for s in mine}
    got = rows(first_not_excluded(df, spark.createDataFrame(members, "g string, u string"), spark.createDataFrame(list(hidden), "g string, u string, s bigint"), ["g"], "u", "s", width=13), "g", "u", "s")
    want = [(g, u, max((d[1] for d in data if d[0] == g and (g, u, d[1]) not in hidden), default=None)) for g, u in members]
    assert got == sorted(want, key=repr)


def test_list_in_parts(spark):
    data, df = sample(spark)
    got = {(r.g, r.part): r.l for r in list_in_parts(df, ["g"], "s", F.col("v"), "l", size=9, width=5).collect()}
    for g in {d[0] for d in data}:
        whole = [d[2] for d in sorted((x for x in data if x[0] == g), key=lambda d: d[1])]
        parts = [got[g, p] for p in range(1, -(-len(whole) // 9) + 1)]
        assert [v for p in parts for v in p] == whole
        assert max(map(len, parts)) <= 9


def test_count_upto_with_facts_of_the_group(spark):
    """Small groups in one pass, the hot one in blocks; NULL members own nothing, NULL positions of events lie before all, of probes have no answer."""
    rnd = random.Random(5)
    data = [("hot" if k % 2 else f"g{rnd.randrange(15)}", rnd.randrange(-50, 400), rnd.choice(["a", "b", None]), k) for k in range(300)]
    data = list({(g, s): (g, s, m, t) for g, s, m, t in data}.values()) + [("g1", None, "a", 999), (None, 3, "a", 7)]
    asked = list({(g, rnd.choice(["a", "b", "c", None])): (g, rnd.randrange(-60, 420)) for g in ["hot", "none", *(f"g{i}" for i in range(15))] for _ in range(5)}.items())
    asked = [(g, m, s) for (g, m), (_, s) in asked] + [("hot", f"x{i}", 100) for i in range(40)] + [(None, "a", 5), ("g2", "a", None)]
    for width in (13, 1 << 20):
        got = rows(count_upto(spark.createDataFrame(data, "g string, s bigint, m string, t bigint"), spark.createDataFrame(asked, "g string, m string, s bigint"),
                              ["g"], "s", "n", width, total="all", newest="t", own=("m", "own")), "g", "m", "s", "n", "all", "t", "own")
        want = []
        for g, m, s in asked:
            if g is None or s is None:
                continue
            group = [d for d in data if d[0] == g]
            last = max((d for d in group if d[1] is not None), key=lambda d: d[1], default=(None, None, None, None))
            want.append((g, m, s, sum(d[1] is None or d[1] <= s for d in group), len(group), last[3], sum(m is not None and d[2] == m and d[1] is not None and d[1] > s for d in group)))
        assert got == sorted(want, key=repr)
