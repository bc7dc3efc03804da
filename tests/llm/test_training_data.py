"""Brute-force comparisons, round trips and edge cases of the ten operators."""

import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import bbit_minhash, decontaminate, entropy_mix, hash_tree, language_id, pii_bootstrap, quality_rules, queries, quote_linking, substring_dedup, token_codec, token_files
from lodeweave.llm.components import connected_components
from lodeweave.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [(9001, None, "en", None, None), (9002, "", None, "src0", 0), (9003, " \n\t ", "en", "src0", 4), (9004, "one", "en", "src0", 3), (9004, "one", "en", "src0", 3), (None, "a text without an id of eight words", "en", "src1", 5), (9005, "word " * 30000, "en", "src1", 5), (9006, "12 34 !!", "en", "src1", 8)]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    return base.unionByName(spark.createDataFrame(ODD, base.schema)).withColumn("kept", F.lit(1)).withColumn("base", F.lit("x")).cache()


@pytest.fixture(scope="module")
def local(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 11), (4, 1), (50, 40), (40, 30), (30, 20), (None, 7)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = dict(connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert {got[k] for k in (1, 2, 3, 4)} == {1} and {got[k] for k in (20, 30, 40, 50)} == {20} and got[1299] == 1000 and 7 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("paired", "rare"), [(1, 1), (1, 3), (4, 16)])
def test_near_duplicates_of_a_large_group(spark, monkeypatch, paired, rare):
    """Copies of one text with up to 14 changed words, drawn from few and many: no link is lost in a large bucket."""
    monkeypatch.setattr(bbit_minhash, "PAIRED", paired)
    monkeypatch.setattr(bbit_minhash, "RARE", rare)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        text = list(base)
        for at in rng.choice(150, int(rng.integers(0, 15)), replace=False):
            text[at] = f"x{rng.integers(3 if i % 2 else 10**6)}"
        rows.append((i, " ".join(text)))
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for _, t in rows]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(root)
        for a, b in itertools.combinations(range(len(rows)), 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    got = {r["doc_id"]: r["component_id"] for r in bbit_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) > 20


def test_near_duplicates_against_brute_force(docs, local):
    got = {r["doc_id"]: r for r in bbit_minhash.near_duplicates(docs, shingle=4).collect()}
    sets = {}
    for i, t, _ in local:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set(zip(*[w[k:] for k in range(4)], strict=False)) if len(w) >= 4 else ({tuple(w)} if w else set())
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    for i in root:
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), find(i))
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert len(got) == len({i for i, _, _ in local})


def test_quality_against_brute_force(docs, local):
    least, share = 1, 0.05
    got = {r["doc_id"]: r for r in quality_rules.line_rules(docs, least=least, share=share).collect()}

    def normal(x):
        return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower())

    every, having, texts = {}, {}, {}
    for i, t, host in local:
        if t is not None:
            every.setdefault(host, set()).add((i, t))
            for x in filter(None, map(normal, t.split("\n"))):
                having.setdefault((host, x), set()).add((i, t))
                texts.setdefault((host, x), set()).add(t)
    common = {k for k, v in having.items() if len(v) > max(least, share * len(every[k[0]])) and len(texts[k]) > least}
    assert common
    for i, t, host in local:
        left = [x for x in (t or "").split("\n") if (host, normal(x)) not in common]
        cut = len((t or "").split("\n")) - len(left)
        n, own = len(words("\n".join(left))), len(words(t))
        depleted = cut > 0 and (n < 0.3 * own or n < 5)
        r = got[i]
        assert (r["n_removed_lines"], r["n_left_words"], r["depleted"]) == (cut, n, depleted)
        assert r["clean_text"] == (None if t is None else "\n".join(left)) and r["kept"] == (not r["base_failed"] and not depleted)
    for i, t, _ in local:
        w, seen, cover = words(t), {}, set()
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        for at in seen.values():
            if len(at) > 1:
                for k in at:
                    cover.update(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))


def test_common_lines_go(spark):
    rows = [(i, f"this line is in all of them\nown words of {chr(97 + i)} " + "abc " * 10, "h") for i in range(8)] + [(100, "this line is in all of them\nx", "h"), (101, "this line is in all of them\nmore words of another host here", None)]
    copies = [(200 + i, "the same text as all of its copies, which is whole", "copied") for i in range(20)]
    got = {r["doc_id"]: r for r in quality_rules.line_rules(spark.createDataFrame(rows + copies, "doc_id long, text string, source string")).collect()}
    assert got[0]["n_removed_lines"] == 1 and "all of them" not in got[0]["clean_text"] and not got[0]["depleted"]
    assert got[100]["depleted"] and not got[100]["kept"] and got[101]["n_removed_lines"] == 0
    assert not any(got[200 + i]["depleted"] for i in range(20))  # one text, however often


def test_planted_line_goes_at_sf001(spark):
    got = quality_rules.line_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).agg(F.sum("n_removed_lines"), F.sum(F.col("depleted").cast("int"))).first()
    assert got[0] >= 100


def test_shards(docs):
    tree = hash_tree.even_tree(24)
    got = hash_tree.assign(docs, tree, tree.grow("region0", "rack0", 24), block_rows=3).toPandas()
    assert len(got) == docs.count()
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 24)).all()
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))


def test_changed_weight_moves_only_its_subtree(spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    tree = hash_tree.even_tree(24)
    heavier = hash_tree.even_tree(24)
    heavier.weights["region1"]["rack2"][7] = 4.0
    a, b = (hash_tree.assign(ids, t).toPandas().set_index("doc_id").sort_index() for t in (tree, heavier))
    moved = a.shard != b.shard
    assert moved.any() and (b.region[moved] == "region1").all()
    inside = moved & (a.region == "region1")
    assert (b.rack[inside] == "rack2").all()


def test_language(docs):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = language_id.fit(docs.where(~held), "text", "lang")
    got = language_id.predict(docs.withColumn("held", held), model).toPandas()
    real = got[(got.doc_id < 9000) & got.held]
    assert (real.lang == real.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    assert set(got[got.doc_id.isin([9001, 9002, 9003, 9006])].lang_pred) == {"und"}
    assert (got[got.doc_id != got.doc_id].lang_pred == "en").all()


def test_personal_data_against_re(docs, local, spark):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    extra = "a@b.c.d@e.f 1.2.3.4.5 300.1.1.1 é +1 (234) 567-8901 4111 1111 1111 1111 9 a.b@c_d@e.f"

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def spans(t):
        out = []
        for k, (name, rx) in enumerate(rules.items()):
            for m in re.finditer(rx, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                if (name == "ip" and max(map(int, m[0].split("."))) > 255) or (name == "card" and not (14 <= len(d) <= 19 and luhn(d))) or (name == "phone" and not 10 <= len(d) <= 15):
                    continue
                out.append((m.start(), k, m.end()))
        return ",".join(f"{list(rules)[k]}:{s}:{e}" for s, k, e in sorted(out))

    got = pii_bootstrap.extract(docs.select("doc_id", "text").unionByName(spark.createDataFrame([(9999, extra)], "doc_id long, text string"))).select("doc_id", "text", pii_bootstrap.describe(F.col("base")).alias("b")).collect()
    assert len(got) == len(local) + 1 and all(r["b"] == spans(r["text"]) for r in got)


def test_patterns_find_unseen(spark):
    rows = [(i, f"text {i} please call contact number +1 (23{i}) 567-8901 today") for i in range(6)] + [(50, "please call contact number 55512345 today"), (51, "an order of 55599999 pieces")]
    got = {r["doc_id"]: r["a"] for r in pii_bootstrap.extract(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii_bootstrap.describe(F.col("added")).alias("a")).collect()}
    assert got[50] == "phone:27:35" and got[51] == "" and got[0] == ""


def test_mix(docs):
    got = entropy_mix.mix(docs, block_rows=50).toPandas()
    again = entropy_mix.mix(docs.repartition(7), block_rows=50).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    total = got["size"].sum()
    per = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"), big=("size", "max"))
    assert abs(per.target.sum() - min(1.5 * total, per.target.sum())) < 1 and (per.target <= 2 * per["size"] + 1e-6).all()


def test_decontamination(spark):
    item = "The quick brown fox jumps over the lazy dog and runs far away into the deep dark wood"
    changed = item.replace("lazy", "sleepy").replace("deep ", "").lower()
    rows = [(1, f"before words {item} after"), (2, f"x {changed}, y"), (3, "The quick brown fox is all that is alike here"), (4, None), (5, ""), (6, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (7, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find(docs, bench).collect()}
    assert set(got) == {1, 2, 6} and got[1]["distance"] == 0 and got[2]["distance"] == 2
    assert (got[1]["start_word"], got[1]["end_word"]) == (2, 20)  # the item has 18 words
    assert decontaminate.find(docs, bench, block_items=1).count() == 3


def test_myers_is_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(60):
        p, t = rng.integers(0, 4, rng.integers(1, 12)).tolist(), rng.integers(0, 4, rng.integers(1, 20)).tolist()
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        assert decontaminate.myers(decontaminate._masks(np.array(p)), len(p), t)[0] == min(row)


def test_codec_round_trip(spark):
    rng = np.random.default_rng(0)
    cases = [np.zeros(0), np.zeros(1), np.arange(70000), rng.integers(0, token_codec.MAX_ID + 1, 40000), np.full(20000, 65535), np.array([token_codec.MAX_ID]), rng.geometric(0.3, 50000), rng.integers(0, 2, 2 * token_codec.BLOCK), np.tile(rng.integers(0, 9000, 500), 40)]
    rows = [(i, bytearray(c.astype("<u4").tobytes())) for i, c in enumerate(cases)] + [(99, None)]
    got = spark.createDataFrame(rows, "i int, ids binary").withColumn("blocks", token_codec.encode("ids")).withColumn("back", token_codec.decode("blocks")).collect()
    assert all(r["back"] == r["ids"] for r in got)
    bits = {r["i"]: 8 * len(r["blocks"]) / max(1, len(cases[r["i"]])) for r in got if r["i"] < 99}
    assert bits[4] < 0.1 and bits[7] < 1.2 and bits[8] < 1  # one id, two even ones, a repeat that order 2 foresees
    blocks = bytes(got[2]["blocks"])
    for broken in (blocks[:-1], blocks[:-1] + bytes([blocks[-1] ^ 1]), b"X" + blocks[1:]):
        with pytest.raises(Exception, match="damaged"):
            spark.createDataFrame([(bytearray(broken),)], "b binary").select(token_codec.decode("b")).collect()
    with pytest.raises(Exception, match="ids must be"):
        spark.createDataFrame([(bytearray(np.array([token_codec.MAX_ID + 1], "<u4").tobytes()),)], "b binary").select(token_codec.encode("b")).collect()


def test_blocks_start_afresh(spark):
    """A block's bytes depend on its own ids only."""
    a, b = (np.random.default_rng(k).geometric(0.05, token_codec.BLOCK).astype("<u4").tobytes() for k in (1, 2))
    rows = spark.createDataFrame([(bytearray(x),) for x in (a, b, a + b)], "ids binary").select(token_codec.encode("ids")).collect()
    assert rows[2][0] == rows[0][0] + rows[1][0]


def test_pieces_equal_the_tokenizer(monkeypatch):
    import pyarrow as pa

    from lodeweave.llm.common import slices

    odd = ["", " a", "a ", "a  b", "a\n\nb", "a\nb c\n", "x\u00a0y z", " ", "a <|endoftext|> b", "tab\there", None, "don't we'll I'M  x", "über straße\nété 123,45 (foo).", "“quoted” – text", "\u3000x", "a\r\nb", "日本 語", "a\u2003b", "🙂 🙂\n🙂", "a <b |c", "end.", "end..", "é. 5. —.", "\u00e9", "I.\nJ! k"]
    encoder = token_files.PieceEncoder(tokenizer_path())
    for limit in (1, 64, 1 << 18):
        got = [x.tolist() for i, j, data, ends in slices(pa.array(odd, pa.string()), limit) for x in encoder.encode(data, ends)]
        assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in odd]
    # long texts are taken in parts
    monkeypatch.setattr(token_files, "PART_BYTES", 16)
    for t in ("one two, three\nfour five. six seven eight nine\nten eleven twelve " * 20 + "end", "a  b" + " word" * 40, "x" * 100 + " y" * 50, " y" * 50):
        raw = np.frombuffer(t.encode(), np.uint8)
        assert encoder.encode(raw, np.array([0, len(raw)]))[0].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_files(docs, local):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = token_files.round_trip(docs, tokenizer_path()).orderBy("start").collect()
    assert len(got) == len(local)
    want, at = {}, 0
    for i, x, _ in local:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) == want[r["doc_id"]]
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(i for i, _, _ in local if i is not None)


def test_passages(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage = word(70)
    altered = [*passage[:35], "other", *passage[36:]]
    rows = [(1, word(80) + passage + word(90)), (2, word(33) + altered + word(60)), (3, word(200)), (4, word(100) + passage), (5, word(120) + passage[:20] + word(100))]
    text = {i: " ".join(w) for i, w in rows}
    text[6] = text[3]
    docs = spark.createDataFrame([*text.items(), (7, None), (8, "short")], "doc_id long, text string")
    got = substring_dedup.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 6}
    assert {r["doc_id"] for r in got if r["removed"]} >= {4, 6}
    assert not any(r["removed"] for r in got if r["doc_id"] in (1, 3))


def test_quotes(spark):
    rows = [(1, 0, "Hello there my friend\nHow are you"), (1, 1, "> hello there  my friend\nI am fine"), (1, 2, "On Mon, X wrote:\n> I am fine\n>> Hello there my friend\nGood"), (1, 3, None), (2, 0, "> I am fine\nx"), (None, None, "> q")]
    got = {(r["conv_id"], r["turn"]): r for r in quote_linking.link(spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("user"))).collect()}
    assert (got[1, 2]["reply_to"], got[1, 2]["thread"], got[1, 2]["depth"], got[1, 2]["clean_text"]) == (1, 0, 2, "Good")
    assert got[1, 1]["clean_text"] == "I am fine" and got[2, 0]["reply_to"] is None and len(got) == 6
    assert got[2, 0]["clean_text"] == "> I am fine\nx"  # linked to nothing, so kept


def test_quotes_wrapped_anew_and_in_part(spark):
    said = "The first thing to do is to read the log of the server, then to look at what it says about the disk."
    rows = [
        (1, 0, said),
        (1, 1, "an answer of other words that nobody has ever said before"),
        (1, 600, "> The first thing to do is to read the\n> log of the server, then to look at what it\n> says about the disk.\nI did that."),
        (1, 601, "> to read the log of the server, then\nwhich one?"),
        (1, 602, "> words of a passage that stands in no message at all\nstays"),
        (1, 1200, said + " Again."),
        (1, 1201, "> the first thing to do is to read the log of the server\nyes, again"),
    ]
    got = {r["turn"]: r for r in quote_linking.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert [got[t]["reply_to"] for t in (600, 601, 602, 1201)] == [0, 0, None, 1200]
    assert got[600]["clean_text"] == "I did that." and got[602]["clean_text"] == rows[4][2] and got[602]["n_quoted_lines"] == 1


def test_quotes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(40)]
    rows, said = [], {}
    for c in range(6):
        for t in range(40):
            text = [" ".join(rng.choice(vocabulary, rng.integers(2, 14))) for _ in range(2)]
            if t and rng.random() < 0.6:
                of = said[c, int(rng.integers(0, t))].split(" ")
                a = int(rng.integers(0, len(of)))
                text.insert(0, "> " + " ".join(of[a : a + int(rng.integers(1, 12))]))
            said[c, t] = " ".join(x for x in text if x[0] != ">")
            rows.append((c, t, "\n".join(text)))

    def keys(ws):
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()

    spoken = {(c, t): keys(said[c, t].split()) | {k for x in text.split("\n") if x[0] != ">" and len(x.split()) < 5 for k in keys(x.split())} for c, t, text in rows}
    want = {}
    for c, t, text in rows:
        own = keys([w for x in text.split("\n") if x[0] == ">" for w in x[2:].split()])
        votes = {}
        for k in own:
            origin = max((o for o in range(t) if k in spoken[c, o]), default=None)
            if origin is not None:
                votes[origin] = votes.get(origin, 0) + 1
        best = max(((n, o) for o, n in votes.items()), default=(0, None))
        want[c, t] = best[1] if own and best[0] >= 0.5 * len(own) else None
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in quote_linking.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 30


def test_passages_with_lost_and_added_words(spark):
    """One word lost or added in the middle, at 51 to 80 words: the 5-word shingle Jaccard is 0.82 and more."""
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, want = [], []
    for k in range(120):
        n = (51, 52, 60, 80)[k % 4]
        passage = word(n)
        edited = passage[: n // 2] + (passage[n // 2 + 1 :] if k % 8 < 4 else ["added", *passage[n // 2 :]])
        rows += [(2 * k, " ".join(word(70) + passage + word(70))), (2 * k + 1, " ".join(word(60) + edited + word(70)))]
        want.append(2 * k + 1)
    got = {r["doc_id"]: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("removed").collect()}
    assert set(got) <= set(want) and len(got) >= 119
    assert all(r["keeper_id"] == i - 1 and 60 <= r["start_word"] and r["end_word"] <= r["n_words"] - 70 for i, r in got.items())


def test_passage_recall_at_the_threshold(spark):
    """One changed word in 51 or 52 words (Jaccard 0.81 and more): recall as the bands are tuned to."""
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows = []
    for k in range(200):
        passage = word(51 + k % 2)
        at = 10 + k % 30
        rows += [(2 * k, " ".join(word(60) + passage + word(60))), (2 * k + 1, " ".join(word(60) + passage[:at] + ["other"] + passage[at + 1 :] + word(60)))]
    got = {r["doc_id"] for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("removed").collect()}
    assert all(i % 2 for i in got) and len(got) >= 198


@pytest.mark.parametrize("paired", [4, 1000])
def test_variants_of_a_passage_meet(spark, monkeypatch, paired):
    """100 variants of one passage, each alike only to the original, end in the original's component, in small and large groups."""
    monkeypatch.setattr(substring_dedup, "PAIRED", paired)
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage = word(55)
    rows = [(0, " ".join(word(60) + passage + word(60)))]
    for k in range(1, 101):
        at = int(rng.integers(0, 55))
        rows.append((k, " ".join(word(60) + passage[:at] + [f"x{k}"] + passage[at + 1 :] + word(60))))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("removed and keeper_id = 0").select("doc_id").distinct().count()
    assert got >= 99


def test_alike_against_brute_force():
    rng = np.random.default_rng(9)
    w, n = 8, 400
    x = rng.integers(1, 40, (n, 2 * w - 1)).astype(np.uint32)
    y = np.where(rng.random(x.shape) < 0.07, rng.integers(1, 40, x.shape), x).astype(np.uint32)
    y[::3] = np.roll(y[::3], 1, axis=1)
    x[::5, :3] = 0
    hit, _ = substring_dedup.alike(x, y, w)

    def best(a, b):
        cut = [[set(v[i : i + w].tolist()) for i in range(w) if v[i : i + w].all()] for v in (a, b)]
        return any(10 * len(s & t) >= 8 * len(s | t) for s in cut[0] for t in cut[1])

    want = np.array([best(a, b) for a, b in zip(x, y, strict=True)])
    assert (hit == want).all() and 20 < want.sum() < 380


def test_patterns_find_identifiers_of_several_tokens(spark):
    """Digit groups with blanks and brackets, and addresses without a digit, in the slots of phones, cards and emails."""
    phone, card, mail = "please call contact number {} today", "he paid with card {} yesterday", "just write to mailbox {} soon"
    rows = [(i, phone.format(f"+1 (23{i % 10}) 567-89{10 + i}")) for i in range(12)]
    rows += [(100 + i, mail.format(f"name{chr(97 + i)}@example.org")) for i in range(12)]
    cards = [d for d in range(4111111111110000, 4111111111110200) if sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(str(d)))) % 10 == 0][:12]
    rows += [(200 + i, card.format(d)) for i, d in enumerate(cards)]
    new = {300: (phone, "(030) 1234 5678", "phone"), 301: (phone, "0171 234 5678", "phone"), 302: (phone, "123 45 6789", "phone"), 303: (card, "4111 1111 1111 1112", "card"), 304: (mail, "john.doe (at) example.org", "email"), 305: (mail, "jane at example dot org", "email")}
    rows += [(i, form.format(x)) for i, (form, x, _) in new.items()] + [(400, "an order of 123 45 6789 pieces"), (401, mail.format("12 34 56"))]
    got = {r["doc_id"]: r["a"] for r in pii_bootstrap.extract(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii_bootstrap.describe(F.col("added")).alias("a")).collect()}
    want = {i: f"{kind}:{form.index('{')}:{form.index('{') + len(x)}" for i, (form, x, kind) in new.items()}
    assert {i: a for i, a in got.items() if a} == want


def test_repeats_inside_a_document_keep_what_is_between(spark):
    """A document holds a passage twice with 400 words of its own between: nothing of these is named, and none is lost."""
    rng = np.random.default_rng(21)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, own = word(80), word(400)
    text = {1: word(60) + passage + word(60), 2: word(90) + passage + own + passage + word(80), 3: word(120)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in text.items()], "doc_id long, text string")
    got = substring_dedup.repeated_passages(df)
    rows = got.collect()
    inside = [r for r in rows if r["doc_id"] == 2]
    assert len({(r["start_word"] < 300) for r in inside}) == 2 and all(r["removed"] for r in inside) and not any(r["removed"] for r in rows if r["doc_id"] == 1)
    assert not any(r["start_word"] < 90 + 80 + 400 and r["end_word"] > 90 + 80 for r in inside)
    left = {r["doc_id"]: r["text"].split(" ") for r in substring_dedup.remove(df, got).collect()}
    assert left[2] == text[2][:90] + own + text[2][-80:] and left[1] == text[1] and left[3] == text[3]


def _similar_sides(rng, w, n):
    """Rows of shingles around an anchor, with repeated ones in some, and partners that differ in a few places."""
    x = rng.integers(1, 1 << 31, (n, 2 * w - 1)).astype(np.uint32)
    for k in range(0, n, 3):
        a = int(rng.integers(0, w))
        x[k, a : a + int(rng.integers(2, w))] = x[k, a]
    y = np.where(rng.random(x.shape) < rng.choice([0.0, 0.02, 0.05, 0.1, 0.3, 0.6], n)[:, None], rng.integers(1, 1 << 31, x.shape), x).astype(np.uint32)
    y[::4] = np.roll(y[::4], 2, axis=1)
    x[::7, : w // 2] = 0
    y[::7, : w // 2] = 0
    y[:, w - 1] = x[:, w - 1]
    return x, y


def test_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(22)
    for w in (10, 46):
        x, y = _similar_sides(rng, w, 600)
        hit, _ = substring_dedup.alike(x, y, w)

        def sketch(v):
            o = np.sort(v, axis=1)
            twice = ((o[:, 1:] == o[:, :-1]) & (o[:, 1:] != 0)).any(axis=1)
            return np.concatenate((np.where(twice, substring_dedup._distinct(o), 0)[:, None].astype(np.uint8), np.where(v == 0, 0, np.maximum(v & 255, 1)).astype(np.uint8)), axis=1)

        a, b = sketch(x), sketch(y)
        may = substring_dedup._may(a, substring_dedup._held(a[:, 1:]), b, substring_dedup._held(b[:, 1:]), w)
        assert hit.sum() > 100 and not (hit & ~may).any() and (~may).sum() > 50


def test_rare_shingles_lose_no_similar_pair(spark):
    """Every pair that is alike shares a shingle that the search looks up, whichever side is open."""
    import pyarrow as pa

    rng = np.random.default_rng(23)
    w = 46
    x, y = _similar_sides(rng, w, 240)
    hit, _ = substring_dedup.alike(x, y, w)
    made = {}
    for open_side in (True, False):
        for name, rows in (("x", x), ("y", y)):
            is_open = (name == "x") == open_side
            for k, v in enumerate(rows):
                seq = v[v != 0].astype(np.uint32)
                pos = w - 1 - int((v[: w - 1] == 0).sum())
                members = pa.array([[{"key": 0, "node": 0, "pos": pos, "open": is_open}]], pa.list_(pa.struct([("key", pa.int64()), ("node", pa.int64()), ("pos", pa.int32()), ("open", pa.bool_())])))
                out = list(substring_dedup._postings(w)(iter([pa.RecordBatch.from_arrays([pa.array([seq.tobytes()], pa.binary()), members], names=["seq", "members"])])))
                made[open_side, name, k] = got = out[0].to_pydict()
                got |= {c: [(x >> shift) & mask for x in got["code"]] for c, shift, mask in (("side", 0, 3), ("rich", 2, 3), ("plain", 4, 255), ("other", 12, 255))}
        for k in np.flatnonzero(hit):
            mine, theirs = (made[open_side, n, k] for n in (("x", "y") if open_side else ("y", "x")))
            every = {s for s, side in zip(theirs["shingle"], theirs["side"], strict=True) if side == 0}
            rich = theirs["rich"][0]
            own = mine["rich"][0]
            # which of a side's shingles are the rarest depends on the group, so any choice must do: as many as looked up, one must be shared
            limit = (mine["plain"][0] if own < 3 else 0) if rich == 1 else mine["other"][0] if own > 1 or rich == 2 else 0
            sides = {}
            for s, side in zip(mine["shingle"], mine["side"], strict=True):
                sides.setdefault(side, []).append(s)
            missing = [sum(s not in every for s in sides[side]) for side in (1, 2) if side in sides]
            enough = [missing[i] < limit or any(s in every for s in sides[side]) and len(sides[side]) <= limit for i, side in enumerate(side for side in (1, 2) if side in sides)]
            assert limit > 0 and any(enough), (k, own, rich, limit, missing)


CLASH = ("h", "h1", "h2", "h3", "d", "d3", "doc", "key", "gone", "lost_words", "c", "c0", "c1", "t", "n", "a", "b", "up", "pc", "rc", "base", "added", "k", "x", "own", "_c", "_d", "_key", "id", "i", "s", "rep", "block", "_row")


def test_clashing_columns_and_empty_tables(spark, docs):
    """Every operator on a table with many other columns of names that it might use itself, and on no rows at all."""
    plain = docs.select("doc_id", "text", "lang", "source")
    wide = plain.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    talk = spark.createDataFrame([(1, 0, "one two three four five six"), (1, 1, "> one two three four five six\nyes")], "conv_id long, turn long, text string")
    wide_talk = talk.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    tree = hash_tree.even_tree(24)
    grown = tree.grow("region0", "rack0", 24)
    ops = {
        "quality": lambda d: quality_rules.line_rules(d),
        "passages": lambda d: substring_dedup.repeated_passages(d),
        "shards": lambda d: hash_tree.assign(d, tree, grown),
        "language": lambda d: language_id.predict(d, language_id.fit(plain, "text", "lang")),
        "private": lambda d: pii_bootstrap.extract(d),
        "mix": lambda d: entropy_mix.mix(d),
        "leaks": lambda d: decontaminate.find(d, bench),
        "tokens": lambda d: token_files.round_trip(d, tokenizer_path()),
        "near": lambda d: bbit_minhash.near_duplicates(d),
    }
    for name, op in ops.items():
        out = op(wide)
        assert op(wide.limit(0)).count() == 0, name
        if name in ("quality", "private"):
            assert set(CLASH) - {"base", "added"} <= set(out.columns)
            assert out.select(*[F.max(c) for c in CLASH if c not in ("base", "added")]).first() is not None
        assert out.count() == op(plain).count(), name
    got = quote_linking.link(wide_talk)
    assert set(CLASH) <= set(got.columns) and got.where("turn = 1").first()["reply_to"] == 0
    assert quote_linking.link(wide_talk.limit(0)).count() == 0
    assert decontaminate.find(plain, bench.limit(0)).count() == 0


def test_mix_meets_its_targets(docs, local):
    """Targets by a water-filling of their own, taken words near them, the dual by a bisection of each source."""
    got = entropy_mix.mix(docs).collect()
    size = {}
    for _, t, s in local:
        size[s] = size.get(s, 0) + len(words(t))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, live, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in live)
        full = {s for s in live if level * weight[s] >= 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in live}
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        live -= full
        if not live:
            break
    taken, longest = {}, max(len(words(t)) for _, t, _ in local)
    for r in got:
        assert abs(r["target"] - target[r["source"]]) <= 1e-6 * max(1, target[r["source"]]) and r["source_size"] == size[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], longest) for s in names)
    for s in names:
        sizes = [len(words(t)) for _, t, x in local if x == s and words(t)]
        if not sizes or target[s] >= 2 * size[s] * (1 - 1e-9):
            continue
        lo, hi = -1.0, 1.0
        rate = lambda z, n: min(2.0, float(np.exp(min(z * n, 50)))) if target[s] > 0 else 0
        total = lambda z: sum(rate(z, n) * n for n in sizes)
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if total(mid) < target[s] else (lo, mid)
        for r in got:
            if r["source"] == s and r["size"]:
                assert abs(r["rate"] - rate(lo, r["size"])) < 1e-4


def test_shards_against_the_law(docs):
    """key: a row's shard follows from its id alone, slots are gapless, and a new shard takes rows only into itself."""
    tree = hash_tree.even_tree(24)
    got = hash_tree.assign(docs, tree, tree.grow("region0", "rack0", 24)).collect()
    by_id, slots = {}, {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
    assert all(len(v) == 1 for v in by_id.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_pairs_of_a_passage_share_their_pieces(spark, monkeypatch):
    """40 pairs of anchors beside each other are verified from a few pieces, not from two a pair, and all are found."""
    import pyarrow as pa

    pairs = spark.createDataFrame([(k, 1, 50 + 2 * k, 1000 + k, 2, 53 + 2 * k) for k in range(40)], substring_dedup.PAIR)
    seq = np.random.default_rng(31).integers(1, 1 << 31, 240).astype(np.uint32)
    seqs = spark.createDataFrame([(1, bytearray(seq[3:].tobytes())), (2, bytearray(seq.tobytes()))], "d long, seq binary")
    links = {(r["a"], r["b"]): (r["a_lo"], r["b_hi"]) for r in substring_dedup._verified(pairs, seqs, 46).collect()}
    assert links == {(k, 1000 + k): (-45, 46 + substring_dedup.PIECE - 1) for k in range(40)}

    def sizes(window):
        def work(batches):
            for b in batches:
                n = sum(len(x) for c in b.columns if pa.types.is_binary(c.type) for x in c.to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())] * 6, names=["a", "b", "a_lo", "a_hi", "b_lo", "b_hi"])

        return work

    monkeypatch.setattr(substring_dedup, "_verify", sizes)
    assert 0 < sum(r["a"] for r in substring_dedup._verified(pairs, seqs, 46).collect()) < 6000


def test_words_are_hashed_in_little_memory():
    """Tables and slices together stay under 40 MB a worker, however many texts there are."""
    import tracemalloc

    import pyarrow as pa

    from lodeweave.llm import common

    column = pa.array([" ".join(f"w{x}" for x in range(k, k + 400)) for k in range(2000)])
    tracemalloc.start()
    hasher, n = common.WordHasher(), 0
    for _, _, data, ends in common.slices(column):
        words, at = hasher(data, ends)
        n += len(words)
        assert len(common.grams(words, 5)) == len(words) - 4 and at[-1] == len(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 * 400 and peak < 40e6


def test_sequences_hold_what_members_need():
    """Of a long text only the shingles around its members stay, and around each of them stands what stands there in the text."""
    import pyarrow as pa

    rng, w = np.random.default_rng(5), 46
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in (3000, 60, 400)]
    places = [[0, 7, 1500, 1530, 2995], [20, 55], [200]]
    member = pa.array([[{"key": k, "node": 10 * k + i, "pos": p} for i, p in enumerate(own)] for k, own in enumerate(places)], pa.list_(pa.struct([("key", pa.int64()), ("node", pa.int64()), ("pos", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7]), pa.array(texts), member], names=["d", "text", "members"])
    again = pa.concat_batches([batch, batch.slice(1, 1)])  # an equal row counts once

    def rows(members):
        cut = pa.RecordBatch.from_arrays([again.column(0), again.column(1), members], names=again.schema.names)
        return [r for b in substring_dedup._sequences(w)(iter([cut])) for r in b.to_pylist()]

    every = pa.array([[{"key": 0, "node": 0, "pos": p} for p in range(len(t.split()) - 4)] for t in again.column(1).to_pylist()], member.type)
    whole, got = rows(every), rows(again.column(2))
    assert [r["d"] for r in got] == [5, 6, 7] and [len(r["seq"]) // 4 for r in whole] == [2996, 56, 396]
    assert [len(r["seq"]) // 4 for r in got] == [53 + 121 + 46, 56, 91]
    for all_of, r, own in zip(whole, got, places, strict=True):
        seq, text = (np.frombuffer(s["seq"], np.uint32) for s in (r, all_of))
        here = np.array([m["pos"] for m in r["members"]])
        assert (substring_dedup._around(seq, here, w) == substring_dedup._around(text, np.array(own), w)).all()


def test_verification_in_slices(spark, monkeypatch):
    """Pieces that take more room than they may are verified slice by slice: no checkpoint holds them all, and no link is lost."""
    seq = np.random.default_rng(32).integers(1, 1 << 31, 200).astype(np.uint32)
    seqs = spark.createDataFrame([(d, bytearray(seq.tobytes())) for d in range(40)], "d long, seq binary")
    pairs = spark.createDataFrame([(1000 + a, a, 100, 1000 + b, b, 100) for a in range(40) for b in range(a)], substring_dedup.PAIR)
    kept, whole = [], substring_dedup.materialize

    def counted(df):
        out = whole(df)
        kept.append(out.count() if "x" in out.columns else 0)
        return out

    monkeypatch.setattr(substring_dedup, "materialize", counted)
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 1000)
    links = substring_dedup._verified(pairs, seqs, 46).select("a", "b").collect()
    assert {(r["a"], r["b"]) for r in links} == {(1000 + a, 1000 + b) for a in range(40) for b in range(a)} and len(links) == 780
    assert sum(kept) == 780 and max(kept) < 400


def test_rare_shingles_in_slices(spark, monkeypatch):
    """The pairs of large groups come in slices of the keys, none in two of them, and all of them come."""
    rng = np.random.default_rng(33)
    seqs, rows = [], []
    for g in range(6):
        base = rng.integers(1, 1 << 31, 91)
        for i in range(40):
            own = base.copy()
            own[rng.choice(91, 4, replace=False)] = rng.integers(1, 1 << 31, 4)
            own[45] = base[45]
            seqs.append((100 * g + i, bytearray(own.astype(np.uint32).tobytes())))
            rows.append((g, 1000 + 100 * g + i, 45, 100 * g + i, True))
    seqs, large = spark.createDataFrame(seqs, "d long, seq binary"), spark.createDataFrame(rows, "key long, node long, pos int, d long, open boolean")

    def slices():
        return [{tuple(r) for r in s.select("key", "a", "b").collect()} for s in substring_dedup._rare_pairs(large, seqs, 46)]

    (whole,) = slices()
    monkeypatch.setattr(substring_dedup, "MEETINGS", 1)
    parts = slices()
    assert len(parts) > 1 and sum(map(len, parts)) == len(whole) and set().union(*parts) == whole and len(whole) == 6 * 40 * 39 // 2


def test_personal_data_counts_by_kind(spark, tmp_path):
    """The query counts the base spans of each kind, not the places that spans have among all."""
    rows = [(1, "10.0.0.1 and x@y.zz"), (2, "+49 30 1234567"), (3, "4111 1111 1111 1111, 4111111111111111"), (4, "a@b.cc d@e.ff g@h.ii"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_pii_bootstrap(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: tuple(r[f"n_{k}"] for k in pii_bootstrap.KINDS) for r in got} == {1: (1, 1, 0, 0), 2: (0, 0, 0, 1), 3: (0, 0, 2, 0), 4: (3, 0, 0, 0), 5: (0, 0, 0, 0)}


def test_a_line_in_many_texts_makes_no_pairs():
    """Members that share no more than a short line are not compared, and no pair that is alike is lost, whichever side is open."""
    rng = np.random.default_rng(9)
    w, n = 46, 120
    draw = lambda *size: rng.integers(1, 2**32, size, dtype=np.uint32)
    line = draw(2 * w - 1)
    place = np.arange(2 * w - 1)
    around = np.where((place >= 40) & (place < 70), line, draw(n, 2 * w - 1))
    found = lambda x, is_open: {p for i, j in substring_dedup._sharing(x, is_open, w) for p in zip(i.tolist(), j.tolist())}
    assert found(around, np.ones(n, bool)) == set()
    for k in range(0, 100, 2):  # near copies, some of which repeat shingles, lack words or end early
        around[k + 1] = np.where(rng.random(2 * w - 1) < 0.06, draw(2 * w - 1), around[k])
        if k % 3 == 0:
            around[k : k + 2, 60:80] = around[k, 45]
        if k % 5 == 0:
            around[k + 1, :-1][place[:-1] > 50] = around[k + 1, 1:][place[:-1] > 50]
        if k % 7 == 0:
            around[k, 85:] = 0
    is_open = rng.random(n) < 0.7
    i, j = np.triu_indices(n, 1)
    hit, _ = substring_dedup.alike(around[i], around[j], w)
    want = {(a, b) for a, b in zip(i[hit].tolist(), j[hit].tolist()) if is_open[a] or is_open[b]}
    got = found(around, is_open)
    assert len(want) > 25 and want <= got and len(got) < len(i) / 4


@pytest.mark.parametrize("paired", [2, 32])
def test_keys_are_clustered_by_one_worker_as_they_are_spread(spark, monkeypatch, paired):
    """The same passages, whether workers cluster whole keys, in slices and without any pair leaving them, or the cluster shares them."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{k}" for k in range(5000)]
    passage = rng.choice(vocabulary, 80)
    rows = []
    for k in range(60):
        own = passage.copy()
        own[rng.choice(80, 3, replace=False)] = rng.choice(vocabulary, 3)
        rows.append((k, " ".join([*rng.choice(vocabulary, 30), *own, *rng.choice(vocabulary, 30)])))
    rows += [(100, "other " + rows[3][1]), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substring_dedup, "PAIRED", paired)

    def clusters():
        out = {}
        for r in substring_dedup.repeated_passages(df).collect():
            out.setdefault(r["component_id"], set()).add((r["doc_id"], r["removed"]))
        return sorted(map(sorted, out.values()))

    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "GROUP", 1)
        spread = clusters()
    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "PIECE_BYTES", 1)
        for gone in ("_verified", "_rare_pairs", "_spread"):
            m.setattr(substring_dedup, gone, None)
        assert clusters() == spread and max(map(len, spread)) > 32
