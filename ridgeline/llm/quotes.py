"""Quotation linking: reply-ordered conversations without quotes.

Each message is parsed into lines with a quote level (leading ">" marks), consecutive lines of a level
into passages. Quoted passages and their lines are normalised and hashed, and join the hashes of what
earlier messages of the conversation said themselves: of several, the latest before the quote is its
original. A message replies to the message that most of its outermost quotes come from (the latest of
equals); without a match, to the message one turn before.

Cut out are quotes: blocks of consecutive marked lines of which a line or passage has an original, or which
follow a line that introduces a quote, and that line with them. Other marked lines are the writer's own
(code, prompts, comparisons) and stay.

Scale. Joins are on (conversation, hash) or (conversation, turn), never on a conversation alone. Originals
are found by running maxima inside buckets of turns and over buckets, so a line that everyone says and
quotes is many small groups. Threads come from pointer doubling over (conversation, turn): as many rounds
as the logarithm of the deepest reply. The order is two columns, (root_turn, turn): no conversation is
gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

MARKS = r"^(?:[ \t]*>)+"
INTRODUCTION = r"(?i)^(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
BUCKET_TURNS = 4096


def normal(line: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def parsed() -> Column:
    """The lines of a text as structs (at, level, said): number, quote level and normal text; lines without words left out."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
    lines = F.transform(F.split(text_or_empty(), "\r?\n"), lambda x, i: F.struct(i.alias("at"), level(x).alias("level"), normal(F.regexp_replace(x, MARKS, "")).alias("said")))
    return F.filter(lines, lambda x: x["said"] != "")


def passages(messages: DataFrame) -> DataFrame:
    """messages(key, conv_id, turn, text) -> (key, conv_id, turn, at, level, hash, weight): each line, and each passage
    of several lines, by hash of its normal text; at is the number of its first line.

    weight is the number of characters, so that a whole passage counts for more than a chance line.
    """
    keys = ("key", "conv_id", "turn")
    rows = messages.select(*keys, parsed().alias("lines"))
    said = lambda x: (F.xxhash64(x).alias("hash"), F.length(x).alias("weight"))
    lines = rows.select(*keys, F.explode("lines").alias("x")).select(*keys, "x.at", "x.level", *said(F.col("x.said")))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]))
    many = rows.where(F.size("lines") > 1).select(*keys, "lines", starts.alias("starts"))
    many = many.select(*keys, "lines", "starts", F.posexplode("starts").alias("k", "first"))
    stop = F.coalesce(F.get("starts", F.col("k") + 1), F.size("lines"))
    whole = F.array_join(F.transform(F.slice("lines", F.col("first") + 1, stop - F.col("first")), lambda x: x["said"]), " ")
    many = many.where(stop - F.col("first") > 1).select(*keys, F.get("lines", "first").alias("x"), whole.alias("said"))
    return lines.unionByName(many.select(*keys, "x.at", "x.level", *said(F.col("said"))))


def originals(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """quoted(conv_id, turn, hash, ...) with origin: the latest turn before theirs in own(conv_id, turn, hash)."""
    key = ["conv_id", "hash"]
    asked = quoted.withColumn("says", F.lit(None).cast("long"))
    told = own.join(quoted.select(*key).distinct(), key, "left_semi").distinct().withColumn("says", F.col("turn"))
    both = asked.unionByName(told, allowMissingColumns=True).withColumn("bucket", F.floor(F.col("turn") / BUCKET_TURNS))
    earlier = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = both.groupBy(*key, "bucket").agg(F.max("says").alias("last")).withColumn("ahead", F.max("last").over(earlier)).drop("last")
    before = Window.partitionBy(*key, "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("says").over(before)).where("says IS NULL")
    found = near.join(buckets, [*key, "bucket"]).withColumn("origin", F.coalesce("near", "ahead"))
    return found.where("origin IS NOT NULL").drop("bucket", "says", "near", "ahead")


def matched(messages: DataFrame, marked: DataFrame) -> DataFrame:
    """(key, conv_id, turn, at, level, weight, origin): the quoted lines and passages of marked messages that have an original."""
    quoted = passages(marked).where("level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL")
    own = passages(messages.withColumn("key", F.lit(0))).where("level = 0").select("conv_id", "turn", "hash")
    return materialise(originals(quoted, own), "quotes")


def parents(messages: DataFrame, met: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, linked) for each turn: linked tells a quote from the turn before."""
    once = met.groupBy("conv_id", "turn", "hash", "origin").agg(F.min("level").alias("level"), F.max("weight").alias("weight"))
    votes = once.groupBy("conv_id", "turn", "origin").agg(F.min("level").alias("level"), F.sum("weight").alias("weight"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "weight", "origin"))["origin"].alias("quoted_turn"))
    turns = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before"))
    found = turns.join(best, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    return found.select("conv_id", "turn", F.coalesce("quoted_turn", "before").alias("parent_turn"), F.col("quoted_turn").isNotNull().alias("linked"))


def threads(replies: DataFrame) -> DataFrame:
    """Adds root_turn and depth by pointer doubling; a parent is always an earlier turn, so there are no cycles.

    A row is done once its pointer is at a root; only others are joined again, so short conversations
    cost a round or two however deep the deepest is.
    """
    columns = ("conv_id", "turn", "parent_turn", "linked", "root_turn", "depth", "done")
    start = replies.select(
        "conv_id", "turn", "parent_turn", "linked",
        F.coalesce("parent_turn", "turn").alias("root_turn"),
        F.when(F.col("parent_turn").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.col("parent_turn").isNull().alias("done"),
    )
    at = materialise(start, "threads")
    finished = at.where("done")
    while not at.where("NOT done").isEmpty():
        known = finished.unionByName(at.where("NOT done"))
        up = known.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        step = at.where("NOT done").drop("done").join(up, ["conv_id", "root_turn"])
        step = step.withColumns({"root_turn": F.col("next"), "depth": F.col("depth") + F.col("more"), "done": F.col("ends")})
        at = materialise(step.select(*columns), "threads")
        finished = finished.unionByName(at.where("done"))
    return finished.drop("done")


def cut(marked: DataFrame, met: DataFrame) -> DataFrame:
    """marked(key, text) -> (key, n_quoted, own): the number of lines cut as quotes, and the text without them.

    One message's lines are put together in one row, as they came.
    """
    lines = marked.select("key", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    lines = lines.select("key", "at", "line", F.col("line").rlike(MARKS).alias("mark"), F.col("line").rlike(INTRODUCTION).alias("intro"))
    hits = met.select("key", "at").distinct().withColumn("hit", F.lit(True))
    order = Window.partitionBy("key").orderBy("at")
    before = lambda c: F.coalesce(F.lag(c).over(order), F.lit(False))
    rows = lines.join(hits, ["key", "at"], "left").withColumns({"hit": F.coalesce("hit", F.lit(False)), "first": F.col("mark") & ~before("mark"), "under": F.col("mark") & before("intro")})
    rows = rows.withColumn("block", F.sum(F.col("first").cast("int")).over(order))
    whole = Window.partitionBy("key", "block", "mark")
    rows = rows.withColumn("quote", F.col("mark") & F.max(F.col("hit") | F.col("under")).over(whole))
    gone = F.col("quote") | (F.col("intro") & F.coalesce(F.lead("quote").over(order), F.lit(False)))
    kept = rows.withColumn("gone", gone).groupBy("key").agg(F.count_if("quote").alias("n_quoted"), F.collect_list(F.when(~F.col("gone"), F.struct("at", "line"))).alias("left"))
    return kept.select("key", "n_quoted", F.trim(F.array_join(F.transform(F.array_sort("left"), lambda x: x["line"]), "\n"), F.lit(" \t\r\n")).alias("own"))


def link(messages: DataFrame) -> DataFrame:
    """conversations -> (conv_id, turn, role, parent_turn, root_turn, depth, linked, n_quoted, text), a row per row.

    Sorting by (conv_id, root_turn, turn) puts every reply after its message, threads together; depth is the
    number of replies above. n_quoted counts the lines cut as quotes; a text of which none is cut stays as it
    is. Rows without conv_id or turn keep null links, and only introduced quotes are cut from them. Null texts
    stay null, empty ones empty; repeated rows share their links. An empty table gives no rows. Other columns
    are not read.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    marks = F.coalesce(F.contains("text", F.lit(">")), F.lit(False))  # no mark, no quote: most texts are parsed once only
    marked = materialise(rows.where(marks).withColumn("key", F.monotonically_increasing_id()), "marked")  # written, so keys stay
    met = matched(rows, marked)
    placed = threads(parents(rows, met))
    plain = rows.where(~marks).withColumn("n_quoted", F.lit(0).cast("long"))
    changed = marked.join(cut(marked, met), "key")
    changed = changed.withColumn("text", F.when(F.col("n_quoted") > 0, F.col("own")).otherwise(F.col("text"))).drop("key", "own")
    out = plain.unionByName(changed).join(placed, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "parent_turn", "root_turn", "depth", F.coalesce("linked", F.lit(False)).alias("linked"), "n_quoted", "text")


def oracle() -> str:
    """link() in SQL: passages join by their normal text instead of its hash, threads by recursion."""
    marks, intro = MARKS, INTRODUCTION
    return rf"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, string_split_regex(coalesce(text, ''), '\r?\n') AS l, row_number() OVER () AS id FROM conversations),
li AS (SELECT id, conv_id, turn, r.i, l[r.i] AS line, regexp_matches(l[r.i], '{marks}') AS mark, regexp_matches(l[r.i], '{intro}') AS intro,
  length(regexp_replace(regexp_extract(l[r.i], '{marks}'), '[^>]', '', 'g')) AS level,
  trim(regexp_replace(lower(regexp_replace(l[r.i], '{marks}', '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS said FROM m, LATERAL (SELECT unnest(range(1, len(m.l) + 1)) AS i) r),
s AS (SELECT * FROM li WHERE said <> ''),
f AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM f),
p AS (SELECT id, conv_id, turn, level, i, said FROM s UNION ALL
  SELECT id, conv_id, turn, level, min(i), string_agg(said, ' ' ORDER BY i) FROM g GROUP BY id, conv_id, turn, level, run HAVING count(*) > 1),
own AS (SELECT DISTINCT conv_id, turn, said FROM p WHERE level = 0),
q AS (SELECT p.id, p.conv_id, p.turn, p.level, p.i, p.said, max(own.turn) AS origin FROM p JOIN own ON p.conv_id = own.conv_id AND p.said = own.said AND own.turn < p.turn
  WHERE p.level > 0 GROUP BY ALL),
w AS (SELECT conv_id, turn, said, origin, min(level) AS level, max(length(said)) AS weight FROM q GROUP BY ALL),
v AS (SELECT conv_id, turn, origin, min(level) AS level, sum(weight) AS weight FROM w GROUP BY ALL),
b AS (SELECT conv_id, turn, origin FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, weight DESC, origin DESC) AS k FROM v) t WHERE k = 1),
d AS (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
e AS (SELECT d.conv_id, d.turn, coalesce(b.origin, x.turn) AS parent_turn, b.origin IS NOT NULL AS linked FROM d LEFT JOIN b ON d.conv_id = b.conv_id AND d.turn = b.turn LEFT JOIN d x ON x.conv_id = d.conv_id AND x.turn + 1 = d.turn),
t AS (SELECT conv_id, turn, parent_turn, linked, turn AS root_turn, CAST(0 AS BIGINT) AS depth FROM e WHERE parent_turn IS NULL
  UNION ALL SELECT e.conv_id, e.turn, e.parent_turn, e.linked, t.root_turn, t.depth + 1 FROM e JOIN t ON e.conv_id = t.conv_id AND e.parent_turn = t.turn),
c1 AS (SELECT li.*, EXISTS (SELECT 1 FROM q WHERE q.id = li.id AND q.i = li.i) AS hit, coalesce(lag(mark) OVER o, false) AS after_mark, coalesce(lag(intro) OVER o, false) AS after_intro FROM li WINDOW o AS (PARTITION BY id ORDER BY i)),
c2 AS (SELECT *, sum(CASE WHEN mark AND NOT after_mark THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS block FROM c1),
c3 AS (SELECT *, mark AND bool_or(hit OR (mark AND after_intro)) OVER (PARTITION BY id, block, mark) AS quote FROM c2),
c4 AS (SELECT *, quote OR (intro AND coalesce(lead(quote) OVER (PARTITION BY id ORDER BY i), false)) AS gone FROM c3),
c AS (SELECT id, CAST(count(*) FILTER (WHERE quote) AS BIGINT) AS n, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS own FROM c4 GROUP BY id)
SELECT m.conv_id, m.turn, m.role, t.parent_turn, t.root_turn, t.depth, coalesce(t.linked, false) AS linked,
  CASE WHEN m.text IS NULL THEN 0 ELSE c.n END AS n_quoted, CASE WHEN m.text IS NOT NULL AND c.n > 0 THEN trim(c.own, ' ' || chr(9) || chr(10) || chr(13)) ELSE m.text END AS text
FROM m JOIN c ON m.id = c.id LEFT JOIN t ON m.conv_id = t.conv_id AND m.turn = t.turn
"""
