"""Personal data: base detectors, and bootstrapped contextual extraction on top, on built-in functions only.

The spans that the base detectors find are seeds.  The words around a seed are lexical
patterns; a pattern that also stands around other identifier-like tokens points at
them.  Scores run over the pattern-instance graph for a few rounds, and patterns of
high confidence add the tokens that they surround as spans of the seeds' kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, opened, sealed, text_key

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  Possessive quantifiers, and starting only at a run's first character (or
# where the last match ended), find what the plain forms find, in linear time and without recursion.
EMAIL = r"(?=[A-Za-z0-9._%+-])(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word with a digit in it.
TOKEN = r"(?<![^\x20\x09-\x0D])[^0-9\x20\x09-\x0D]*+[0-9][^\x20\x09-\x0D]*+"
#: Digit groups that adjoin, with blanks, brackets, dots, slashes or dashes between them.
GROUPS = r"(?<![^\x20\x09-\x0D])[+(]?[0-9]++(?![A-Za-z])(?:(?:\x20?[()]\x20?|\x20?[/-]\x20?|[.\x20])[0-9]++(?![A-Za-z]))*+"
#: Words that read like an address: with a spelt-out or bracketed "at", or an "@" that is no email of the base.
ADDRESS = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++|\x20?(?:[(\[{<]\x20?(?:at|AT|@)\x20?[)\]}>]|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]++(?:(?:\x20?[(\[{<]\x20?(?:dot|DOT|\.)\x20?[)\]}>]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++)"
CONTEXT = 64


def _found(text: Column, regex: str) -> Column:
    """array<struct<s, m>>: code-point starts and texts of all matches; what lies between them gives the starts."""
    between = F.transform(F.split(text, regex, -1), lambda x: F.length(x))
    none = F.array().cast("array<int>")

    def starts(gaps: Column, found: Column) -> Column:
        step = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), F.length(m).alias("n")))
        return F.aggregate(step, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, x: F.struct((a["at"] + x["g"] + x["n"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["g"])).alias("out")))["out"]

    both = let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(between, lambda gaps: F.arrays_zip(starts(gaps, found).alias("s"), found.alias("m")))))
    return F.transform(F.coalesce(both, F.array().cast("array<struct<s:int,m:string>>")), lambda x: F.struct(x.getField("s").alias("s"), x.getField("m").alias("m")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip_ok(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(F.expr("0").cast("int") + F.nullif(q, F.lit("")).try_cast("int"), F.lit(0)) <= 255)))


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        one = lambda i: F.substr(d, i, F.lit(1)).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, one(i)).otherwise(2 * one(i) - F.when(one(i) > 4, 9).otherwise(0)))

    return let(F.reverse(_digits(m)), lambda d: F.when(F.length(d).between(14, 19), total(d) % 10 == 0).otherwise(False))


def base_spans(text: Column) -> Column:
    """Sorted array<struct<s, k, e>> of the base spans; k is the kind's place in KINDS, e exclusive."""
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")

    def spans(k: int, regex: str, maybe: Column, ok) -> Column:
        good = F.filter(_found(text, regex), lambda x: ok(x["m"]))
        return F.when(maybe, F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), (x["s"] + F.length(x["m"])).alias("e")))).otherwise(empty)

    digit = text.rlike("[0-9]")
    return F.array_sort(
        F.concat(
            spans(0, EMAIL, F.contains(text, F.lit("@")), lambda m: F.lit(True)),
            spans(1, IP, digit, _ip_ok),
            spans(2, CARD, digit, _luhn),
            spans(3, PHONE, F.contains(text, F.lit("+")), lambda m: F.length(_digits(m)).between(10, 15)),
        )
    )


def candidates(text: Column, spans: Column) -> Column:
    """array<struct<s, k, e, f>> of what patterns may discover outside the spans; k is null, f the form.

    Form 1: runs of digit groups; 2: address-like words; 0: other tokens of 6 or more letters
    and digits, 4 of them digits.  Where they overlap, form 2 goes before 1 and 1 before 0.
    """
    empty = F.array().cast("array<struct<s:int,k:int,e:int,f:int>>")
    core = lambda m: F.regexp_extract(m, r"([A-Za-z0-9][A-Za-z0-9._/-]*[A-Za-z0-9])[^A-Za-z0-9]*$", 1)

    def item(s: Column, m: Column, form: int) -> Column:
        return F.struct(s.alias("s"), F.lit(None).cast("int").alias("k"), (s + F.length(m)).alias("e"), F.lit(form).alias("f"))

    def cut(x: Column) -> Column:
        return let(core(x["m"]), lambda c: item(x["s"] + F.length(F.regexp_extract(x["m"], r"^(.*?)[A-Za-z0-9][A-Za-z0-9._/-]*[A-Za-z0-9][^A-Za-z0-9]*$", 1)), c, 0))

    def like(x: Column) -> Column:
        c = core(x["m"])
        return (F.length(F.regexp_replace(c, "[^A-Za-z0-9]", "")) >= 6) & (F.length(_digits(c)) >= 4)

    def free(rows: Column, taken: Column) -> Column:
        return F.filter(rows, lambda x: ~F.exists(taken, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))

    digit = text.rlike("[0-9]")
    whole = lambda form: lambda x: item(x["s"], x["m"], form)
    address = F.when(text.rlike(r"@|[(\[{<]\x20?(?:at|AT)\x20?[)\]}>]|\x20at\x20"), free(F.transform(_found(text, ADDRESS), whole(2)), spans)).otherwise(empty)
    groups = F.when(digit, free(F.transform(_found(text, GROUPS), whole(1)), spans)).otherwise(empty)
    tokens = F.when(digit, free(F.transform(F.filter(_found(text, TOKEN), like), cut), spans)).otherwise(empty)
    both = let(address, lambda a: F.concat(a, free(groups, a)))
    return let(both, lambda a: F.concat(a, free(tokens, a)))


def _fits(form: Column, kind: Column) -> Column:
    """Whether what has a form may be of a kind: digit groups are no emails, address-like words nothing else."""
    return F.coalesce(F.when(form == 1, kind != 0).when(form == 2, kind == 0), F.lit(True))


def _patterns(left: Column, right: Column) -> Column:
    word = r"[^\x20\x09-\x0D]+"
    l1 = F.lower(F.regexp_extract(left, rf"({word})[\x20\x09-\x0D]*$", 1))
    l2 = F.lower(F.regexp_extract(left, rf"({word}[\x20\x09-\x0D]+{word})[\x20\x09-\x0D]*$", 1))
    r1 = F.lower(F.regexp_extract(right, rf"^[\x20\x09-\x0D]*({word})", 1))
    # no words, no pattern
    some = lambda name, on, *parts: F.when(on != "", F.concat(F.lit(name), *parts))
    return F.array_compact(F.array(some("l1 ", l1, l1), some("l2 ", l2, l2), some("lr ", F.concat(l1, r1), l1, F.lit(" _ "), r1)))


def extract(docs: DataFrame, text_col: str = "text", rounds: int = 3, min_seeds: int = 3, min_confidence: float = 0.6) -> DataFrame:
    """The input's columns with base (sorted base spans) and added (sorted spans that patterns found).

    A span is struct<s, k, e>: code-point start, place in KINDS, exclusive end.  A null text
    counts as empty; an empty table gives no rows.  Copies of a text count once.  A pattern needs
    ``min_seeds`` different seeds of one kind and ``min_confidence``: the mean score of its
    instances (seeds: 1), with one more instance of score 0.  Of kinds that reach an
    instance the most confident wins, then the first.  Columns named base or added are
    replaced, others may have any names.
    """
    given, names = sealed(docs)
    text = F.coalesce(F.col(names[docs.columns.index(text_col)]), F.lit(""))
    spans = given.select(text_key(text).alias("doc"), text.alias("t")).where(F.col("t") != "").withColumn("base", base_spans(F.col("t")))
    items = spans.select("doc", "t", F.concat(F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lit(None).cast("int").alias("f"))), candidates(F.col("t"), F.col("base"))).alias("items"))
    items = items.where(F.size("items") > 0).select("doc", "t", F.explode("items").alias("x"))
    left = F.substr("t", F.greatest(F.lit(1), F.col("x.s") + 1 - CONTEXT), F.least(F.lit(CONTEXT), F.col("x.s")))
    right = F.substr("t", F.col("x.e") + 1, F.lit(CONTEXT))
    inst = F.lower(F.substr("t", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")))
    items = items.select("doc", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.k").alias("k"), F.col("x.f").alias("f"), F.xxhash64(inst).alias("i"), F.transform(_patterns(left, right), lambda p: F.xxhash64(p)).alias("ps"))
    items = materialize(items.distinct())  # the one pass over the texts
    seen = items.where("k is not null").select("doc", F.struct("s", "k", "e").alias("x"), F.lit(True).alias("own"))
    items = items.select("doc", "s", "e", "k", "f", "i", F.explode("ps").alias("p"))
    edges = materialize(items.groupBy("p", "i").agg(F.min("k").alias("k"), F.min("f").alias("f")))
    # patterns that at least min_seeds seeds of one kind share
    seeds = edges.where("k is not null").groupBy("p", "k").agg(F.countDistinct("i").alias("seeds")).where(F.col("seeds") >= min_seeds).select("p", "k")
    live = materialize(seeds)
    edges = materialize(edges.withColumnRenamed("k", "own").join(live, "p").where(F.col("own").isNotNull() | _fits(F.col("f"), F.col("k"))))  # (p, i, own, k): what p says on kind k
    score = None
    for _ in range(rounds):
        if score is None:
            known = edges.withColumn("r", F.coalesce((F.col("own") == F.col("k")).cast("double"), F.lit(0.0)))
        else:
            by_inst = materialize(edges.join(score, ["p", "k"]).groupBy("i", "k").agg(F.avg("c").alias("r0")))
            known = edges.join(by_inst, ["i", "k"]).withColumn("r", F.when(F.col("own").isNull(), F.col("r0")).otherwise((F.col("own") == F.col("k")).cast("double")))
        score = materialize(known.groupBy("p", "k").agg((F.sum("r") / (F.count("*") + 1)).alias("c")))
    best = materialize(score.where(F.col("c") >= min_confidence).select("p", F.col("k").alias("kind"), "c"))
    new = items.where("k is null").join(best, "p").where(_fits(F.col("f"), F.col("kind"))).groupBy("doc", "s", "e").agg(F.max_by("kind", F.struct("c", F.negate("kind"))).alias("k"))
    every = seen.unionByName(new.select("doc", F.struct("s", "k", "e").alias("x"), F.lit(False).alias("own")))
    pick = lambda own: F.array_sort(F.collect_list(F.when(F.col("own") == own, F.col("x"))))
    every = every.groupBy("doc").agg(pick(True).alias("base"), pick(False).alias("added"))
    out = given.withColumn("doc", text_key(text)).join(every.withColumnRenamed("doc", "d"), F.col("doc") == F.col("d"), "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return opened(out, docs, names, {"base": F.coalesce("base", none), "added": F.coalesce("added", none)})


def describe(spans: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(kind, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans merge into the first."""
    kind = F.array(*map(F.lit, KINDS))
    end = F.lit(0)
    start = F.struct(F.lit("").alias("out"), end.alias("at"))
    step = lambda a, x: F.when(x["s"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], x["e"]).alias("at"))).otherwise(F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, x["s"] - a["at"]), F.lit("<"), F.get(kind, x["k"]), F.lit(">")).alias("out"), x["e"].alias("at")))
    return let(F.aggregate(spans, start, step), lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
