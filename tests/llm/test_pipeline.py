"""The pipeline's stages against brute force, with null, empty, equal and repeated rows among the documents."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeweave.llm import entropy_mix
from lodeweave.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    text = base.where("length(text) between 400 and 2000").orderBy("doc_id").first()["text"]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first()["text"]
    odd = [(9001, None, "en", "src0", None), (9002, "", "en", "src0", 0), (9003, "12 34 !!", "en", "src0", 8), (9004, "this is one row that stands here twice and is kept once", "en", "src0", 1), (9004, "this is one row that stands here twice and is kept once", "en", "src0", 1), (None, text, "en", None, 1), (9005, text + " more", "en", "src1", 1), (9006, f"some words before {item} and some behind", "en", None, 1), (9006, "a clean text under the id of one that is not", "en", "src1", 1), (None, f"other words {item}", "en", "src1", 1)]
    return base.unionByName(spark.createDataFrame(odd, base.schema)).cache()


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_language_stage(spark, docs):
    got = rows(corpus_pipeline.identify_language(spark, docs, SF))
    assert not {9001, 9002, 9003} & {i for i, _ in got} and set(got) <= set(rows(docs))
    clean = [r for r in rows(docs) if len(words(r[1])) >= 30]
    assert len(set(clean) & set(got)) >= 0.99 * len(set(clean))


def test_near_duplicate_stage(spark, docs):
    got = rows(corpus_pipeline.drop_near_duplicates(spark, docs, SF))
    every = sorted(set(rows(docs)), key=str)
    sets = [shingles(t) for _, t in every]
    parent = list(range(len(every)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(every)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(every):
        groups.setdefault(root(k), []).append((i is None, i or 0, k))
    least = {r: min(g)[:2] for r, g in groups.items()}
    assert len(got) == len(groups) == len(set(got))
    kept = [(t is None, i, shingles(t)) for i, t in got]
    assert sorted((i is None, i or 0) for i, _ in got) == sorted(least.values()) and len(kept) == len(got)


def test_decontamination_stage(spark, docs):
    got = rows(corpus_pipeline.drop_contaminated(spark, docs, SF))
    split = lambda t: re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).split()
    items = [split(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def holds(t):
        w = split(t)
        for m in items:
            if len(m) < 5:
                continue
            k = int(len(m) * 0.2)
            last = np.arange(len(m) + 1)
            best = last[-1]
            for x in w:
                now = np.empty_like(last)
                now[0] = 0
                same = np.array([x != y for y in m])
                now[1:] = np.minimum(last[:-1] + same, last[1:] + 1)
                for j in range(1, len(now)):
                    if now[j - 1] + 1 < now[j]:
                        now[j] = now[j - 1] + 1
                last = now
                best = min(best, last[-1])
            if best <= k:
                return True
        return False

    some = [r for r in rows(docs) if len(words(r[1])) < 150]
    assert [r for r in some if r in got] == [r for r in some if not holds(r[1])]
    assert (9006, "a clean text under the id of one that is not") in got and not any(i == 9006 and "before" in t for i, t in got)


def test_mix_stage(spark, docs):
    one = docs.dropDuplicates(["doc_id", "text"]).cache()
    got = corpus_pipeline.mix_sources(spark, one, SF)
    assert got.columns == docs.columns
    taken, size = {}, {}
    for r in got.select("source", "text").collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    for r in one.select("source", "text").collect():
        size[r["source"]] = size.get(r["source"], 0) + len(words(r["text"]))
    goal = {r["source"]: r["target"] for r in entropy_mix.mix(one).select("source", "target").distinct().collect()}
    longest = max(len(words(t)) for _, t in rows(one))
    assert all(abs(taken.get(s, 0) - goal[s]) <= max(0.05 * goal[s], longest) for s in goal)
    assert all(taken.get(s, 0) <= 2 * size[s] for s in goal) and max(got.groupBy("doc_id", "text").count().toPandas()["count"]) == 2


def test_whole_run(spark):
    from tokenizers import Tokenizer

    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r["start"])
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    at = 0
    for r in got:
        ids = np.array([*t.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += r["n_tokens"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "token_files"] and len(got) > 50


def test_empty_documents(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert docs.where(F.lit(False)).count() == 0
