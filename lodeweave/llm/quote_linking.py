"""Chat formatting by quotation linking, on built-in functions only.

Lines with the same number of leading ">" that follow each other are a passage.  Passages
are normalised (case, white space, line breaks) and hashed by every five words, or as a
whole if shorter, so a quote that was wrapped anew or cut still meets its origin.  Each
hash is joined to the latest earlier message of the conversation that said it outside
quotes; a passage's hashes vote for its origin, and a message replies to the origin of
most of its quoted words.  Threads follow from the replies, and linked quotes are taken
out of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, materialize, opened, sealed, text_key

QUOTE = r"^([\x20\x09]*>)+"
#: A line that only introduces a quote.
ATTRIBUTION = r"(?i)^[\x20\x09]*(on\b.{0,200}\bwrote|.{1,100}\b(said|wrote|schrieb|escribió|a écrit))[\x20\x09]*:[\x20\x09]*$"
#: Words of a hash.
RUN = 5
#: Turns that one sort takes together when the latest earlier speaker of a hash is looked for.
SPAN = 256


def lines(text: Column) -> Column:
    """array<struct<level, body, raw>> of a text; body is the normalised line without its quote marks."""

    def one(x: Column) -> Column:
        def parts(p: Column) -> Column:
            body = F.trim(F.regexp_replace(F.lower(F.substr(x, F.length(p) + 1, F.length(x))), SPACE, " "))
            return F.struct(F.length(F.regexp_replace(p, "[^>]", "")).alias("level"), body.alias("body"), x.alias("raw"))

        return let(F.regexp_extract(x, QUOTE, 0), parts)

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), one)


def passages(rows: Column) -> Column:
    """array<struct<level, first, last, words>> of ``lines``: runs of lines of one level, their places and words."""
    level = lambda i: F.coalesce(F.get(rows, i)["level"], F.lit(-1))
    places = F.sequence(F.lit(0), F.size(rows) - 1)
    first = F.filter(places, lambda i: level(i) != level(i - 1))
    last = F.filter(places, lambda i: level(i) != level(i + 1))

    def one(x: Column) -> Column:
        own = F.slice(rows, x["first"] + 1, x["last"] - x["first"] + 1)
        words = F.filter(F.split(F.array_join(F.transform(own, lambda y: y["body"]), " "), " "), lambda w: w != "")
        return F.struct(level(x["first"]).alias("level"), x["first"].alias("first"), x["last"].alias("last"), words.alias("words"))

    return F.transform(F.arrays_zip(first.alias("first"), last.alias("last")), one)


def hashes(words: Column) -> Column:
    """array<struct<a, b>>: 128 bits for every RUN words, or for all words if there are fewer; none for none."""

    def of(part: Column) -> Column:
        joined = F.array_join(part, " ")
        return F.struct(F.xxhash64(F.size(part), joined).alias("a"), F.xxhash64(F.lit("second"), joined).alias("b"))

    n = F.size(words)
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return F.when(n >= RUN, F.transform(F.sequence(F.lit(1), n - RUN + 1), lambda i: of(F.slice(words, i, RUN)))).when(n > 0, F.array(of(words))).otherwise(none)


def without(rows: Column, gone: Column) -> Column:
    """The text of ``lines`` without the stretches ``gone`` (array<struct<first, last>>) and the attributions right before them, trimmed."""
    intro = lambda i: F.coalesce((F.get(rows, i)["level"] == 0) & F.get(rows, i)["raw"].rlike(ATTRIBUTION), F.lit(False))
    out = F.flatten(F.transform(gone, lambda g: F.sequence(g["first"] - F.when(intro(g["first"] - 1), 1).otherwise(0), g["last"])))
    left = F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), out)
    return F.trim(F.array_join(F.transform(left, lambda i: F.get(rows, i)["raw"]), "\n"))


def _latest(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """quotes (c, a, b, t, ..) with origin: the latest turn before t of said (c, a, b, t); rows without one go.

    Sorts are per SPAN turns of a conversation's hash, then per the few latest turns of each span.
    """
    span = F.floor(F.col("t") / SPAN).alias("span")
    keys = ["c", "a", "b", "span"]
    said = said.select("c", "a", "b", "t", span).distinct()
    asked = quotes.select("c", "a", "b", "t", span).distinct()
    both = asked.withColumn("o", F.lit(None).cast("long")).unionByName(said.withColumn("o", F.col("t")))
    upto = Window.partitionBy(*keys).orderBy("t", F.col("o").asc_nulls_first())
    inside = both.withColumn("near", F.last("o", ignorenulls=True).over(upto)).where("o is null").drop("o")
    ends = said.groupBy(*keys).agg(F.max("t").alias("end"))
    steps = ends.unionByName(asked.select(*keys).distinct().withColumn("end", F.lit(None).cast("long"))).groupBy(*keys).agg(F.max("end").alias("end"))
    before = steps.withColumn("far", F.max("end").over(Window.partitionBy("c", "a", "b").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).drop("end")
    found = inside.join(before, keys).withColumn("origin", F.coalesce("near", "far")).where("origin is not null").select("c", "a", "b", "t", "origin")
    return quotes.join(found, ["c", "a", "b", "t"])


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", share: float = 0.5, max_rounds: int = 30) -> DataFrame:
    """The input's columns with reply_to, thread, depth, n_quoted_lines and clean_text (columns of these names are replaced, others may have any).

    A quoted passage is linked to the earlier message of its conversation (ties: the latest)
    that was the latest to say most of its hashes, if these are at least ``share`` of all.
    A passage of fewer than RUN words must equal a whole line, or all lines between quotes.
    reply_to is the turn replied to: the origin of most quoted words at the lowest level with a
    link (ties: the latest).  thread is the turn of the message at the reply chain's start,
    depth the number of replies from there; ordered by (conv, thread, turn) every reply
    follows what it replies to.  clean_text has no linked passages and no lines that only
    introduce them; quotes that were linked to nothing stay.  A message with nothing linked, a
    null conversation or a null turn is the start of its own thread; a null text stays null;
    an empty table gives no rows.  Rows that repeat a turn are linked each by its own text, and a
    reply to the turn follows the smallest reply_to of them.  Turns are whole numbers.
    Lineage over replies is resolved by pointer doubling, so chains of n replies take log2(n) rounds.
    """
    rows, names = sealed(messages)
    where = dict(zip(messages.columns, names, strict=True))
    conv, turn, text = F.col(where[conv_col]), F.col(where[turn_col]).cast("long"), F.col(where[text_col])
    usable = rows.where(conv.isNotNull() & turn.isNotNull()).select(conv.alias("c"), turn.alias("t"), text.alias("x"))
    quoting = usable.where(F.contains("x", F.lit(">")) & F.col("x").rlike("(?m)" + QUOTE))
    of = quoting.select("c", "t", text_key(F.col("x")).alias("key"), F.explode(let(lines(F.col("x")), passages)).alias("p")).where("p.level > 0 and size(p.words) > 0")
    quotes = of.select("c", "t", "key", F.col("p.level").alias("level"), F.col("p.first").alias("first"), F.col("p.last").alias("last"), F.size("p.words").alias("n"), F.array_distinct(hashes(F.col("p.words"))).alias("hs")).distinct()
    quotes = materialize(quotes)
    asked = quotes.select("c", "t", "key", "level", "first", "last", "n", F.size("hs").alias("all"), F.explode("hs").alias("h")).select("*", "h.a", "h.b").drop("h")
    # only what is asked for is looked up: conversations with quotes, hashes that are quoted in them
    spoken = usable.join(quotes.select("c").distinct(), "c", "left_semi").select("c", "t", lines(F.col("x")).alias("l"))
    short = lambda l: F.filter(F.transform(F.filter(l, lambda x: (x["level"] == 0) & (x["body"] != "")), lambda x: F.split(x["body"], " ")), lambda w: F.size(w) < RUN)
    whole = lambda l: F.transform(F.filter(passages(l), lambda p: p["level"] == 0), lambda p: p["words"])
    spoken = spoken.select("c", "t", F.explode(F.array_distinct(let(F.col("l"), lambda l: F.flatten(F.transform(F.concat(whole(l), short(l)), hashes))))).alias("h"))
    said = spoken.select("c", "t", "h.a", "h.b").join(asked.select("c", "a", "b").distinct(), ["c", "a", "b"], "left_semi")
    votes = _latest(asked, said).groupBy("c", "t", "key", "level", "first", "last", "n", "all", "origin").agg(F.count("*").alias("votes"))
    best = votes.groupBy("c", "t", "key", "level", "first", "last", "n", "all").agg(F.max(F.struct("votes", "origin")).alias("v")).where(F.col("v.votes") >= share * F.col("all"))
    linked = materialize(best.select("c", "t", "key", "level", "first", "last", "n", F.col("v.origin").alias("origin")))
    near = linked.groupBy("c", "t", "key", "origin").agg(F.sum("n").alias("n"), F.min("level").alias("level"))
    near = near.groupBy("c", "t", "key").agg(F.max_by("origin", F.struct(F.negate("level"), "n", "origin")).alias("reply_to"))
    gone = linked.groupBy("c", "t", "key").agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    parent = materialize(near.join(gone, ["c", "t", "key"]))
    # (message, ancestor, steps), doubled until every ancestor starts its thread
    hops = parent.groupBy("c", "t").agg(F.min("reply_to").alias("up")).withColumn("d", F.lit(1).cast("long"))
    hops = materialize(hops)
    for _ in range(max_rounds):
        above = hops.select("c", F.col("t").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        if hops.join(above, ["c", "up"], "left_semi").isEmpty():
            break
        hops = materialize(hops.join(above, ["c", "up"], "left").select("c", "t", F.coalesce("up2", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")))
    else:
        raise RuntimeError(f"reply chains did not resolve in {max_rounds} rounds")
    roots = hops.select("c", F.col("t").alias("reply_to"), "up", "d")
    told = parent.join(roots, ["c", "reply_to"], "left").select(F.col("c").alias("pc"), F.col("t").alias("pt"), F.col("key").alias("pk"), "reply_to", "gone", "up", "d")
    out = rows.withColumn("key", text_key(text)).join(told, (conv == F.col("pc")) & (turn == F.col("pt")) & (F.col("key") == F.col("pk")), "left")
    first = F.col("reply_to").isNull()
    cleaned = F.when(F.col("gone").isNull(), F.trim(text)).otherwise(let(lines(text), lambda l: without(l, F.col("gone"))))
    marked = F.when(F.contains(text, F.lit(">")), F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(QUOTE)))).otherwise(0)
    added = {
        "reply_to": F.col("reply_to"),
        "thread": F.when(first, turn).otherwise(F.coalesce("up", "reply_to")),
        "depth": F.when(first, F.lit(0)).otherwise(1 + F.coalesce("d", F.lit(0))).cast("long"),
        "n_quoted_lines": F.coalesce(marked, F.lit(0)).cast("long"),
        "clean_text": cleaned,
    }
    return opened(out, messages, names, added)
