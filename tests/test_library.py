"""Brute force and edge cases of verbalisation, rounds, transport, candidates, readers and sinks."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.functions import names
from lodeweave.operators import candidates, evaluate, evidence, models, prompts, rounds, sampling, similarity, transport, verbalize, votes
from lodeweave.sources import readers, writers
from lodeweave.storage import save
from lodeweave.streaming import windows

REL = [(1, "http://x/A_1", "http://x/o/worksAt", "http://x/B_2"), (1, "http://x/B_2", "http://x/o/partOf", "http://x/C_3"), (1, "http://x/A_1", "http://x/o/knows", "http://x/A_1"), (2, "http://x/A_1", "http://x/o/knows", "http://x/D_4")]
ATTR = [(1, "http://x/A_1", "http://x/o/name", "Anna"), (1, "http://x/A_1", "http://x/o/name", "Ann"), (1, "http://x/B_2", "http://x/o/foundedIn", "1900"), (1, "http://x/E_5", "http://x/o/label", "Eve"), (2, "http://x/D_4", "http://x/o/size", "4")]
TRANSLATED = [(k, f"http://x/{n}", f"T{n[0]}") for k in (1, 2) for n in ("A_1", "B_2", "C_3", "D_4", "E_5")]


@pytest.fixture(scope="module")
def graphs(spark):
    return spark.createDataFrame(REL, "kg int, head string, rel string, tail string"), spark.createDataFrame(ATTR, "kg int, entity string, attr string, value string"), spark.createDataFrame(TRANSLATED, "kg int, entity string, translated string")


def told(flags: verbalize.Flags) -> dict:
    """All entities as text, in plain Python."""
    words = {"worksAt": "works at", "partOf": "part of", "knows": "knows", "name": "name", "foundedIn": "founded in", "label": "label", "size": "size"}
    last = lambda u: u.split("/")[-1]
    called = dict(((k, e), t) for k, e, t in TRANSLATED)
    ents = {(k, x) for k, h, _, t in REL for x in (h, t)} | {(k, e) for k, e, _, _ in ATTR}

    def head(k, e):
        own = sorted(v.lower() for k2, e2, a, v in ATTR if (k2, e2) == (k, e) and last(a) in ("name", "label"))
        name = f"{own[0]} " if flags.use_name and own else ""
        url = (called[k, e] if flags.use_translated_url else last(e).replace("_", " ")) + " " if flags.use_url else ""
        return name + url

    def shown(k, e, more):
        text = head(k, e) or "An Entity"
        if more:
            text += " [" + "".join(f" {words[last(a)]}:{v};" for k2, e2, a, v in sorted(ATTR) if (k2, e2) == (k, e)) + "]"
        return text

    out = {}
    for k, e in ents:
        lines = []
        if flags.use_relationship:
            edges = [(r, t, False) for k2, h, r, t in REL if (k2, h) == (k, e)]
            if flags.use_inverse:
                edges += [(r + "_(inv)", h, True) for k2, h, r, t in REL if (k2, t) == (k, e)]
            for r, other, inv in sorted(edges):
                name = words[last(r).removesuffix("_(inv)")]
                a, b = shown(k, e, flags.head_use_attr), shown(k, other, flags.neighbors_use_attr)
                lines.append(f"{b} {name} {a}" if inv else f"{a} {name} {b}")
        if flags.use_attributes:
            lines += [f"{words[last(a)]} {v}" for k2, e2, a, v in sorted(ATTR) if (k2, e2) == (k, e)]
        out[k, e] = "\n".join([head(k, e), *lines])
    return out


@pytest.mark.parametrize("part", range(4))
def test_every_flag(graphs, part):
    rel, attr, translated = graphs
    every = list(itertools.product((False, True), repeat=8))
    for bits in every[part * 5 :: 23]:
        flags = verbalize.Flags(*bits)
        got = {(r["kg"], r["entity"]): r["sequence"] for r in verbalize.full(rel, attr, flags, translated).collect()}
        assert got == told(flags), flags


def test_missing_translation_is_an_error(graphs):
    rel, attr, translated = graphs
    with pytest.raises(ValueError):
        verbalize.full(rel, attr, verbalize.Flags(use_translated_url=True))
    with pytest.raises(Exception, match="no translated name"):
        verbalize.full(rel, attr, verbalize.Flags(use_translated_url=True), translated.where("translated <> 'TC'")).collect()


def test_prompts(spark):
    df = spark.createDataFrame([("x",)], "t string")
    for kind, (system, template) in prompts.TEMPLATES.items():
        got = df.select(prompts.construct(kind, F.col("t"))).first()[0]
        assert template.replace("{}", "x") in got and ("<|im_start|>" in got) == (system is not None)
    with pytest.raises(ValueError):
        prompts.construct("qwen2_chat_template", F.col("t"))


def test_answers_with_any_white_space(spark):
    rows = [("the\tcorrect  answer\nshould   be is : (B)", "b"), ("ANSWER(c)", "c"), ("answer = (D)", "d"), ("answer should (a)", None), ("answer" + " " * 50_000 + "x", None)]
    got = spark.createDataFrame(rows, "t string, want string").withColumn("got", names.parse_answer(F.col("t"))).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_bootstraps_must_be_fewer_than_candidates(spark):
    ranked = spark.createDataFrame([(1, c, c) for c in range(3)], "q long, c long, rk int")
    cand = evidence.bootstrap_orders(ranked, 3).withColumn("text", F.col("c").cast("string"))
    center, gold = spark.createDataFrame([(1, "e")], "q long, text string"), spark.createDataFrame([(1, 2)], "q long, gold long")
    with pytest.raises(Exception, match="as many rounds"):
        evidence.rerank_prompts(center, cand, gold).collect()
    got = evidence.rerank_prompts(center, cand.where("round = 1"), gold).first()
    assert got["prompt"].split("\n")[got["choice"] + 4] == f"({chr(97 + got['choice'])}) 2"


def test_rounds_kill_after_failures(spark):
    ranked = spark.createDataFrame([(q, 10 * q, 1) for q in (1, 2, 3)], "q long, c long, rk int")
    ask = lambda df, k: df.where("q = 1" if k == 0 else "q = 3 and 1 = 0").select("q", "c")
    pool, aligned = rounds.run(ranked, ask, 3, 2, save)
    assert {r["q"]: (r["state"], r["n"]) for r in pool.collect()} == {1: ("aligned", 0), 2: ("killed", 2), 3: ("killed", 2)}
    assert [tuple(r) for r in aligned.collect()] == [(1, 10)]


def test_majority(spark):
    votes = lambda a, b, c: [(1, k, x) for k, x in enumerate(["a"] * a + ["b"] * b + ["c"] * c)]
    make = lambda v: rounds.majority(spark.createDataFrame(v, "q long, round int, c string"), 7).collect()
    assert make(votes(3, 2, 2)) == [] and [r["c"] for r in make(votes(4, 3, 0))] == ["a"]


def test_sinkhorn_by_aggregation_is_the_dense_plan(spark):
    rng = np.random.default_rng(3)
    cost = spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(rng.random((8, 8)))], "q long, c long, cost double")
    a = transport.sinkhorn(cost, 12, 0.2, False).toPandas().sort_values(["q", "c"]).p
    b = transport.sinkhorn_blocks(cost, save, 12, 0.2).toPandas().sort_values(["q", "c"]).p
    assert np.allclose(a, b, atol=1e-12)
    assert np.allclose(transport.sinkhorn(cost, 500, 0.2, False, 1e-12).toPandas().groupby("c").p.sum(), 1 / 8)


def test_refine_against_numpy(spark):
    rng = np.random.default_rng(4)
    n = 7
    feature = np.round(rng.random((n, n)), 6)
    left = [(0, "r", 5), (1, "r", 5), (2, "s", 6), (3, "s", 6)]
    right = [(0, "x", 5), (1, "x", 5), (2, "y", 6), (4, "y", 6)]
    seeds = [(5, 5), (0, 0)]
    frame = lambda rows: spark.createDataFrame(rows, "head long, rel string, tail long")
    cells = spark.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(feature)], "q long, c long, cost double")
    plan, found = transport.refine(cells, frame(left), frame(right), spark.createDataFrame(seeds, "q long, c long"), save, epochs=2)

    def solve(cost):
        k0, t, u = np.exp(-cost / 0.1), np.full((n, n), 1 / n**2), np.full(n, 1 / n)
        for _ in range(10):
            k = k0 * t
            v = 1 / n / (k.T @ u)
            u = 1 / n / (k @ v)
            t = u[:, None] * k * v
        return t

    def share(votes):
        v = np.minimum(votes, 20)
        return 1 - v / v.max() if v.max() else np.ones((n, n))

    t = solve(feature)
    for _ in range(2):
        best = {}
        for i in range(n):
            j = int(np.argmax(t[i]))
            if t[i, j] > t.max() - 0.5 / n and j not in best.values():
                best[i] = j
        best = {i: j for i, j in best.items() if i not in dict(seeds) and j not in dict(seeds).values()} | dict(seeds)
        count = {}
        for h, r, x in left:
            for h2, r2, x2 in right:
                if best.get(h) == h2 and best.get(x) == x2:
                    count[r, r2] = count.get((r, r2), 0) + 1
        align = {r: min((-c, b) for (a, b), c in count.items() if a == r)[1] for r, _ in count}
        homo, rel = np.zeros((n, n)), np.zeros((n, n))
        near = lambda edges, e: {b for a, _, b in edges if a == e} | {a for a, _, b in edges if b == e}
        for i, j in best.items():
            for a in near(left, i):
                for b in near(right, j):
                    homo[a, b] += 1
            for h, r, x in left:
                for h2, r2, x2 in right:
                    if h == i and h2 == j and align.get(r) == r2:
                        rel[x, x2] += 1
        t = solve(share(homo) + share(rel) + feature)
    got = np.zeros((n, n))
    for r in plan.collect():
        got[r["q"], r["c"]] = r["p"]
    assert np.allclose(got, t, atol=1e-9) and {(r["q"], r["c"]) for r in found.collect()} == set(best.items())


def test_train_groups_repeat_what_is_there(spark):
    got = candidates.train_groups(spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "q long, c long"), 6).collect()
    for q, have in ((1, {10, 11}), (2, {20})):
        assert sorted(r["place"] for r in got if r["q"] == q) == [1, 2, 3, 4, 5] and {r["c"] for r in got if r["q"] == q} == have


def test_one_positive_a_query(spark):
    corpus = spark.createDataFrame([(1, "p"), (2, "p")], "id long, text string")
    rows = lambda pos: spark.createDataFrame([("q", pos)], "query string, pos array<string>")
    assert candidates.eval_pairs(rows(["p"]), corpus).first()["pos_id"] == 1
    with pytest.raises(Exception, match="one positive"):
        candidates.eval_pairs(rows(["p", "r"]), corpus).collect()


def test_gold_ranks_in_blocks(spark):
    rng = np.random.default_rng(6)
    v = np.round(rng.random((30, 3)), 1)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    gold = spark.createDataFrame([(i, (i * 7) % 30) for i in range(30)] + [(3, 99)], "q long, gold long")
    for metric in similarity.METRICS:
        want = {(r["q"], r["gold"]): r["rk"] for r in evaluate.gold_rank(similarity.top_k(df, df, None, metric), gold).collect()}
        for rows in (1000, 7):
            assert {(r["q"], r["gold"]): r["rk"] for r in similarity.gold_ranks(df, df, gold, metric, rows).collect()} == want


def test_numbered(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * 37) % 1009)
    got = sampling.numbered(df, ["x"]).orderBy("k").collect()
    assert [r["k"] for r in got] == list(range(1, 1001)) and [r["x"] for r in got] == sorted(r["x"] for r in got) and got[0]["_all"] == 1000
    assert sampling.numbered(df.limit(0), ["x"]).count() == 0


def test_calibration_keeps_empty_bins(spark):
    got = evaluate.calibration(spark.createDataFrame([(0.05, 1), (0.95, 0)], "prob double, label int")).orderBy("bin").collect()
    assert [r["n"] for r in got] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 1] and got[1]["mean_prob"] is None


@pytest.fixture(scope="module")
def pairs(spark):
    """Queries, documents and gold of a small vector graph with a zero vector, equal vectors and a label that is null."""
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 3 if i != 5 else None) for i in range(45)]
    rows[7], rows[30] = (7, [0.0] * 4, 1), (30, rows[29][1], 2)
    e = spark.createDataFrame(rows, "id long, v array<double>, label int")
    return e.where("id < 20"), e.where("id >= 20"), e.where("id < 20").select(F.col("id").alias("q"), (F.col("id") + 20).alias("gold"))


def shuffled(df) -> list[str]:
    """The exchanges of the physical plan."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]


def test_calibration_of_pairs_makes_no_row_a_pair(spark, pairs, monkeypatch):
    q, d, _ = pairs
    monkeypatch.setattr(similarity, "TILE", (3, 7))
    monkeypatch.setattr(similarity, "TASK_CELLS", 100)
    scored = similarity.top_k(q, d, None).join(q.select(F.col("id").alias("q"), "label"), "q").join(d.select(F.col("id").alias("c"), F.col("label").alias("dl")), "c")
    want = evaluate.calibration(scored.select(((F.col("score") + 1) / 2).alias("prob"), (F.col("label") == F.col("dl")).alias("label"))).orderBy("bin").collect()
    got = evaluate.calibration_of_pairs(q, d)
    assert got.orderBy("bin").collect() == want
    assert not [x for x in shuffled(got) if "score" in x or "q#" in x]


def test_loss_of_pairs_makes_no_row_a_pair(spark, pairs, monkeypatch):
    q, d, gold = pairs
    monkeypatch.setattr(similarity, "TILE", (3, 7))
    gold = gold.withColumn("gold", F.when(F.col("q") == 3, 99).otherwise(F.col("gold")))  # no such document
    got = evaluate.contrastive_loss_of_pairs(q, d, gold)
    assert got.orderBy("q").collect() == evaluate.contrastive_loss(similarity.top_k(q, d, None), gold).orderBy("q").collect()


def test_all_pairs_are_not_shuffled_or_sorted(spark, pairs, monkeypatch):
    q, d, _ = pairs
    monkeypatch.setattr(similarity, "TILE", (3, 7))
    for metric in similarity.METRICS:
        got = similarity.all_pairs(q, d, metric)
        assert not shuffled(got)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, similarity.top_k(q, d, None, metric).select("q", "c", "score").collect()))
        assert similarity.all_pairs(q, d, metric, block_rows=6).count() == 20 * 25


def test_csls_and_costs_of_pairs(spark, pairs, monkeypatch):
    q, d, _ = pairs
    monkeypatch.setattr(similarity, "TILE", (3, 7))
    every = similarity.top_k(q, d, None)
    table = lambda df: {(r[0], r[1]): r[2] for r in df.collect()}
    got, want = table(similarity.csls_of_pairs(q, d, 4)), table(similarity.csls(every.select("q", "c", "score"), 4))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.1e-8 for k in got)
    votes = spark.createDataFrame([(0, 21, 30), (0, 44, 3), (9, 20, 7), (9, 99, 1)], "q long, c long, votes long")
    got = table(transport.cost_combined_of_pairs(q, d, votes, 1.0, 2.0))
    want = table(transport.cost_combined([(1.0, transport.cost_votes(every, votes)), (2.0, transport.cost_feature(every))]))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.1e-8 for k in got) and got[9, 20] < got[9, 21] + 2


def test_anchors_of_first_candidates(spark, pairs):
    q, d, _ = pairs
    plan = lambda k: similarity.top_k(q, d, k).select("q", "c", F.col("score").alias("p"))
    assert sorted(map(tuple, transport.anchors(plan(1), 0.3).collect())) == sorted(map(tuple, transport.anchors(plan(None), 0.3).collect()))


@pytest.mark.parametrize("proximal", [False, True])
def test_plans_of_pairs_and_cells_agree(spark, pairs, monkeypatch, proximal):
    """Rows made from vectors and rows packed from cells give the plan of plain numpy, which no single task holds."""
    q, d, gold = pairs
    monkeypatch.setattr(transport, "STEP_CELLS", 60)
    cost = transport.cost_feature(similarity.all_pairs(q, d))
    k0 = np.exp(-cost.toPandas().pivot(index="q", columns="c", values="cost").to_numpy() / 0.1)
    n, m = k0.shape
    t, u = np.full((n, m), 1 / (n * m)), np.full(n, 1 / n)
    for _ in range(10):
        k = k0 * t if proximal else k0
        v = 1 / m / (k.T @ u)
        u = 1 / n / (k @ v)
        t = u[:, None] * k * v
    plan = transport.solve(transport.pair_rows(q, d), 10, 0.1, proximal)
    table = lambda df: df.toPandas().pivot(index="q", columns="c", values="p").to_numpy()
    assert np.allclose(table(plan.cells()), t, rtol=1e-9, atol=0)
    assert np.allclose(table(transport.sinkhorn(cost, 10, 0.1, proximal)), t, rtol=1e-9, atol=0)
    assert "FlatMapGroups" not in plan.cells()._jdf.queryExecution().executedPlan().toString()
    want = evaluate.gold_rank(transport.rerank(plan.cells()), gold).orderBy("q").collect()
    assert plan.gold_ranks(gold).orderBy("q").collect() == want


def test_plan_with_holes(spark):
    cost = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.5), (1, 1, 0.2), (2, 0, 0.3), (2, 2, 0.4)], "q long, c long, cost double")
    p = transport.sinkhorn(cost, 300, 0.3, False).toPandas()
    assert len(p) == 5 and np.allclose(p.groupby("c").p.sum(), 1 / 3, atol=1e-2) and np.allclose(p.groupby("q").p.sum(), 1 / 3)
    with pytest.raises(Exception, match="twice"):
        transport.sinkhorn(cost.unionByName(cost), 1)


@pytest.mark.parametrize("hub", [0, 4, 512])
def test_summaries_of_votes_against_brute_force(spark, monkeypatch, hub):
    """Whatever counts as a hub, each entity's partners, votes, most votes and first best partner are those of all pairs."""
    from collections import Counter

    rng = np.random.default_rng(12)
    monkeypatch.setattr(votes, "HUB", hub)
    anchors = [(f"a{k}", f"b{k}") for k in range(12)]
    edges = [sorted({(f"{side}{min(11, int(rng.integers(14)))}" if rng.random() < 0.7 else f"{side}0", f"n{rng.integers(25)}") for _ in range(110)}) for side in "ab"]
    n = Counter((x, y) for p, x in edges[0] for q, y in edges[1] if p[1:] == q[1:])
    want = {x: (len(own), sum(own.values()), max(own.values()), min(y for y, k in own.items() if k == max(own.values()))) for x in {x for x, _ in n} if (own := {y: k for (z, y), k in n.items() if z == x})}
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    got = votes.structural(frame(anchors, "e1 string, e2 string"), frame(edges[0], "a string, b string"), frame(edges[1], "a string, b string"), save)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_encoder_and_generator(spark):
    df = spark.createDataFrame([(1, "abcabc"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: r["v"] for r in models.encode(df).collect()}
    assert len(got[1]) == 64 and abs(np.linalg.norm(got[1]) - 1) < 1e-9 and not any(got[2]) and not any(got[3])

    def broken():
        raise RuntimeError("no such model")

    class Fails:
        def generate(self, prompts):
            broken()

    assert [r["answer"] for r in models.generate(df.withColumnRenamed("text", "prompt"), "fails", Fails).collect()] == ["Error"] * 3


def test_approximate_search_finds_most(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(200, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    exact = {(r["q"], r["c"]) for r in similarity.top_k(df, df, 5, "l2").collect()}
    near = {(r["q"], r["c"]) for r in models.nearest_approximate(df, df, 5, bucket=1.0, tables=8, radius=2.0).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "links").write_text("1\t2\n3\t4\nbad\n")
    assert sorted(map(tuple, readers.load_links(spark, "dbp15k", str(tmp_path / "links")).collect())) == [(1, 2), (3, 4)]
    (tmp_path / "twice").write_text("1\t2\n1\t4\n")
    with pytest.raises(ValueError, match="linked 2 times"):
        readers.load_links(spark, "DBP15K", str(tmp_path / "twice"))
    (tmp_path / "side").write_text("1@@a\t2@@b\n")
    assert [tuple(r) for r in readers.load_links(spark, "medbbk9k", str(tmp_path / "side")).collect()] == [("a", "b")]
    (tmp_path / "ents").write_text("0\tu0\n1\tu1\n")
    (tmp_path / "rels").write_text("7\tr7\n")
    (tmp_path / "triples").write_text("0\t7\t1\n0\t7\t9\n")
    assert [tuple(r) for r in readers.load_relations(spark, "DBP15K", str(tmp_path / "triples"), str(tmp_path / "ents"), str(tmp_path / "rels")).collect()] == [("u0", "r7", "u1")]
    with pytest.raises(ValueError):
        readers.dataset("other")
    (tmp_path / "names").write_text("eins\nzwei\n")
    assert [tuple(r) for r in readers.numbered_lines(spark, str(tmp_path / "names")).collect()] == [(0, "eins"), (1, "zwei")]
    records = spark.createDataFrame([(f"q{i}", ["p"], ["n"]) for i in range(5)], readers.SFT)
    writers.write_records(records.coalesce(1), str(tmp_path / "sft"))
    assert readers.sft_scan(spark, str(tmp_path / "sft")).count() == 5 and readers.sft_scan(spark, str(tmp_path / "sft"), 2).count() == 2
    key = writers.config_key("zh_en", use_url=True, use_name=False)
    assert key != writers.config_key("zh_en", use_url=True, use_name=True) and key == writers.config_key("zh_en", use_name=False, use_url=True)
    assert writers.read_cache(spark, str(tmp_path), key) is None
    writers.write_cache(spark.range(3), str(tmp_path), key)
    writers.write_cache(spark.range(9), str(tmp_path), key)
    assert writers.read_cache(spark, str(tmp_path), key).count() == 3
    writers.write_cache(spark.range(9), str(tmp_path), key, overwrite=True)
    assert writers.read_cache(spark, str(tmp_path), key).count() == 9


def test_windows_close_behind_the_watermark(spark, tmp_path):
    """Appended results hold closed windows only, and rows that come too late are left out."""
    for k, rows in enumerate(([("2024-01-01 00:10:00", 1), ("2024-01-01 01:10:00", 2)], [("2024-01-01 05:00:00", 4)], [("2024-01-01 00:20:00", 8), ("2024-01-01 09:00:00", 16)])):
        spark.createDataFrame(rows, "t string, v int").select(F.col("t").cast("timestamp").alias("t"), "v").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("t timestamp, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = windows.run_available(windows.windowed(stream, "t", [], "1 hour", "2 hours", total=F.sum("v")), "append").orderBy("start").collect()
    assert [r["total"] for r in got][:2] in ([1, 2], [9, 2]) and 16 not in [r["total"] for r in got]


def test_nearest_approximate_joins_no_pairs(spark, monkeypatch):
    """The buckets are met inside blocks, whatever their size, and recall against brute force is 0.9 at least."""
    from pyspark.ml.feature import BucketedRandomProjectionLSHModel

    def joined(*_, **__):
        raise AssertionError("pairs are joined")

    monkeypatch.setattr(BucketedRandomProjectionLSHModel, "approxSimilarityJoin", joined)
    v = np.random.default_rng(5).normal(size=(300, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    queries = df.where("id % 20 = 0")
    got = models.nearest_approximate(queries, df, 5).collect()
    assert {tuple(r) for r in models.nearest_approximate(queries, df, 5, block_rows=70).collect()} == {tuple(r) for r in got}
    d = np.linalg.norm(v[::20, None] - v[None], axis=2)
    want = {(20 * i, int(c)) for i in range(15) for c in np.argsort(d[i], kind="stable")[:5] if d[i, c] < 1.2}
    assert len(want) > 50 and len({(r["q"], r["c"]) for r in got} & want) >= 0.9 * len(want)
    assert all(abs(r["distance"] - d[r["q"] // 20, r["c"]]) < 1e-6 for r in got) and models.nearest_approximate(df, df.limit(0), 5).isEmpty()


def test_whole_matrices_come_with_equal_values_together(spark):
    """Every pair once with its score, and inside a tile equal scores adjoin, so that Parquet's pages hold them once."""
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(50, 3)), 1)
    frame = lambda ids: spark.createDataFrame([(int(i), v[i].tolist()) for i in ids], "id long, v array<double>").coalesce(1)
    q, d = frame(range(20)), frame(range(20, 50))
    got = similarity.all_pairs(q, d, "inner", digits=0).toArrow().to_pandas()
    want = {(i, j): round(float(v[i] @ v[j])) for i in range(20) for j in range(20, 50)}
    assert len(got) == 600 and {(a, b): int(s) for a, b, s in got.itertuples(index=False)} == {k: x for k, x in want.items()}
    assert got.score.is_monotonic_increasing
    cost = transport.cost_combined_of_pairs(q, d, spark.createDataFrame([(0, 20, 3)], "q long, c long, votes long")).toArrow().to_pandas()
    assert len(cost.drop_duplicates(["q", "c"])) == 600 and cost.cost.is_monotonic_increasing


@pytest.mark.parametrize("shared", [0, 1 << 26])
def test_votes_count_from_shared_partners_as_from_lists(spark, monkeypatch, shared):
    """Partners sent to all workers, or lists of them shuffled to the voters: the same summaries; voters without partners have none."""
    monkeypatch.setattr(votes, "HUB", 2)
    assert votes.SHARED and not monkeypatch.setattr(votes, "SHARED", shared)
    voters = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 12), (4, 10), (4, 13), (5, 11)], "n long, key long")
    partners = spark.createDataFrame([(10, 7), (10, 8), (10, 9), (11, 8), (13, 9)], "key long, m long")
    got = {r[0]: tuple(r)[1:] for r in votes.summaries(voters, partners, save).collect()}
    assert got == {1: (3, 4, 2, 8), 2: (3, 3, 1, 7), 4: (3, 4, 2, 9), 5: (1, 1, 1, 8)}


def test_cells_of_rounded_costs_take_three_bytes(spark):
    """Rows come back the same, holes and costs of more digits too, and rounded ones take less than half the room of doubles."""
    rng = np.random.default_rng(6)
    rounded, exact = np.round(rng.random((9, 4000)), 6), rng.random((3, 4000)) * 40 - 20
    want = np.concatenate((rounded, exact, np.round(exact, 6)))
    want[2, 5] = want[11, 9] = np.inf
    want[3, :3] = 0.0, 15.999999, 16.5
    cells = spark.createDataFrame([(i, 7 * j, float(x)) for (i, j), x in np.ndenumerate(want) if x < np.inf], "q long, c long, cost double").repartition(3)
    kept = []
    rows = transport.cell_rows(cells, lambda df: kept.append(df.cache()) or kept[0])
    got = {int(q): x for batch in kept[0].toArrow().to_batches() for ids, cost in rows.read(iter([batch])) for q, x in zip(ids, cost)}
    assert all(np.array_equal(got[i], want[i]) for i in range(len(want))) and rows.count == len(want)
    size = {r["q"]: sum(len(p["x"]) for p in r["pieces"]) for r in kept[0].collect()}
    assert size[0] == 3 * 4000 and size[2] == 3 * 3999 and size[10] == 8 * 4000


def test_csls_lies_by_columns(spark, tmp_path):
    """Its values hardly repeat, so the ids must cost next to nothing: Parquet takes little more than the eight bytes of the value."""
    rng = np.random.default_rng(7)
    make = lambda first, n: spark.createDataFrame([(first + i, v) for i, v in enumerate(rng.normal(size=(n, 8)).tolist())], "id long, v array<double>").coalesce(1)
    similarity.csls_of_pairs(make(0, 128), make(1000, 6000), 4).write.parquet(str(tmp_path / "csls"))
    assert sum(f.stat().st_size for f in (tmp_path / "csls").glob("*.parquet")) < 8.5 * 128 * 6000
    assert spark.read.parquet(str(tmp_path / "csls")).select("q", "c").distinct().count() == 128 * 6000
