"""Quality rules: cross-document line frequency per host, on built-in functions only.

A line is normalised (trimmed, blanks squeezed, lower-cased, digits to 0) and hashed to
128 bits.  Lines that stand in too many documents of one host are removed, and a document that loses too much of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, opened, sealed, text_key

#: Characters that count as symbols (fixed values of the base rules).
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text, runs of anything but the six ASCII blanks; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(w: Column, n: int = 5) -> Column:
    """How many words stand in an n-word window that is found twice or more in the array."""
    size = F.size(w)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))

    def covered(hashes: Column) -> Column:
        # neighbours in hash order that are equal mark a repeat
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        marked = let(ordered, lambda o: F.filter(F.transform(o, lambda x, k: F.when((F.get(o, k - 1)["h"] == x["h"]) | (F.get(o, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()))
        return F.aggregate(
            F.array_sort(marked),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-n).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(n), p - a["last"])).alias("n"), p.alias("last")),
        )["n"]

    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)]))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def normal(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))), "[0-9]", "0")


def base(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text has zeros."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    df = df.withColumn("_stats", let(words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))))
    df = df.withColumns(
        {
            "n_words": F.col("_stats.n"),
            "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": F.col("_stats.r"),
        }
    ).drop("_stats")
    return df.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def line_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", least: int = 5, share: float = 0.05, keep_share: float = 0.3, keep_words: int = 5) -> DataFrame:
    """The input's columns with clean_text, n_removed_lines, n_left_words, depleted, kept and the base columns.

    A normalised line is over the limit if more than max(``least``, ``share`` * documents of
    its host) distinct documents of the host have it, in more than ``least`` different texts;
    so copies of a few texts, however many, reject nothing: they are the de-duplicator's
    affair.  A document is an (id, text); equal rows are one, null ids count by their text.
    A document is depleted if fewer than ``keep_share`` of its words or fewer than
    ``keep_words`` words are left, while something was removed.  kept is false if the base
    rules fail or the document is depleted.  A null host is a host of its own.  A null text
    stays null, has no words, and fails the base rules; an empty table gives no rows.
    Columns of the added names are replaced, others may have any names.  Columns that are
    not used later (clean_text among them) are pruned before any shuffle.
    """
    rows, names = sealed(docs)
    where = dict(zip(docs.columns, names, strict=True))
    host, text, who = F.col(where[host_col]), F.col(where[text_col]), F.col(where[id_col])
    cut = F.split(text, "\n")
    hashed = F.transform(cut, lambda x, i: F.struct(let(normal(x), lambda y: F.struct((y != "").alias("ok"), text_key(y).alias("k"))).alias("s"), i.alias("i"), x.alias("x")))
    given = rows.where(text.isNotNull())
    lines = given.select(host.alias("host"), who.alias("id"), text_key(text).alias("doc"), F.explode(hashed).alias("l"))
    lines = lines.where("l.s.ok").select("host", "id", "doc", F.col("l.s.k.a").alias("a"), F.col("l.s.k.b").alias("b"), F.col("l.i").alias("i"), F.size(words(F.col("l.x"))).alias("n"))

    def documents(of: Column) -> Column:
        """Distinct documents of one text: its ids, null as one more."""
        return F.count_distinct(of) + F.max(F.when(of.isNull(), 1).otherwise(0))

    # copies of a text fall together before the lines are counted over texts
    once = lines.groupBy("host", "a", "b", "doc").agg(documents(F.col("id")).alias("m"))
    total = given.groupBy(host.alias("h1"), text_key(text).alias("doc")).agg(documents(who).alias("m")).groupBy("h1").agg(F.sum("m").alias("all"))
    common = once.groupBy("host", "a", "b").agg(F.sum("m").alias("docs"), F.count("*").alias("texts")).where((F.col("docs") > least) & (F.col("texts") > least))
    common = common.join(total, F.col("host").eqNullSafe(F.col("h1"))).where(F.col("docs") > share * F.col("all"))
    common = common.select(F.col("host").alias("h2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    hit = lines.join(common, F.col("host").eqNullSafe(F.col("h2")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")))
    # copies carry the same lines: each place once
    lost = hit.groupBy("host", "doc", "i").agg(F.first("n").alias("n")).groupBy("host", "doc").agg(F.collect_set("i").alias("gone"), F.sum("n").alias("lost_words"))
    lost = lost.select(F.col("host").alias("h3"), F.col("doc").alias("d3"), "gone", "lost_words")
    own = base(rows, where[text_col]).withColumn("key", text_key(text))
    out = own.join(lost, host.eqNullSafe(F.col("h3")) & (F.col("key") == F.col("d3")), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    left = F.col("n_words") - F.coalesce("lost_words", F.lit(0))
    depleted = F.col("lost_words").isNotNull() & ((left < keep_share * F.col("n_words")) | (left < keep_words))
    added = {
        "clean_text": F.array_join(F.filter(cut, lambda x, i: ~F.array_contains(gone, i)), "\n"),
        "n_removed_lines": F.size(gone).cast("long"),
        "n_left_words": left.cast("long"),
        "depleted": depleted,
        "kept": ~F.col("base_failed") & ~depleted,
    }
    return opened(out, docs, names, added | {c: c for c in BASE})
