"""Quotation linking for conversations.

Lines are split by their quote level, the number of ">" at their start (blanks
between them allowed). A passage is a run of adjacent quoted lines of one level;
its words (lower case, blanks collapsed, line ends ignored, so that text wrapped
anew is the same) are hashed and joined to the messages of the conversation that
said them without quoting. A passage of ``FEWEST`` words or more may stand anywhere
in such a message, a shorter one must be a whole line of it.

The join is on hashes: of four adjacent words, an original gives those that are the
least among four neighbours, and a passage gives the least of its first four, which
any original that holds it must have chosen too; short passages and short lines give
the hash of the whole. What meets is then compared word by word, once for a message
and a passage. A passage comes from the latest earlier message that says it. A
message replies to the origin of its outermost linked passages (the latest of them),
or else to the turn before it.

Replies make a tree of each conversation. ``thread_position`` orders it so that
every message follows what it replies to, the branches of a message one after
another in the order of their turns. It comes from the tree's Euler tour, ranked by
pointer doubling: rounds grow with the logarithm of a conversation's length, only
conversations that leave the order of turns take part, and each round is written to
the shared folder. The result is each message without quoted lines, with its place
in the thread and by turn, what it replies to and how deep it quotes.

Order within a conversation comes from blocks of ``BLOCK_TURNS`` turns; no
conversation, passage or message's replies are gathered in one task, whatever their
share of the rows.

Null and empty texts give an empty text, no quotes. Messages of the same turn
share their places (a rank), and repeated rows stay; in the tree such a turn replies
to the latest origin of any of them. Messages whose turn is null come first in their
conversation, reply to nothing and are no origins. A null conv_id is a conversation of
its own. Very long texts are compared whole. An empty table has no rows; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Cut, table

BLOCK_TURNS = 4096
GRAM, NEIGHBOURS = 4, 4
FEWEST = GRAM + NEIGHBOURS - 1
BLANKS, MARKS = " \t", " \t>"


def level_of(line: Column) -> Column:
    marks = F.left(line, F.length(line) - F.length(F.ltrim(line, F.lit(MARKS))))
    return F.when(F.contains(line, F.lit(">")), F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).otherwise(F.lit(0))


def normal(text: Column) -> Column:
    """The words of a text without quote marks, in lower case, joined by blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[ \t\r]{2,}|[\t\r]", " "))


def own_lines() -> Column:
    """Lines of level zero."""
    return F.filter(F.split("text", "\n"), lambda x: ~F.startswith(F.ltrim(x, F.lit(BLANKS)), F.lit(">")))


def n_words(normal: Column) -> Column:
    """How many words a normal text has that is not empty."""
    return F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1


def passages() -> Column:
    """Runs of adjacent lines of one level above zero: (level, words joined by blanks)."""
    other = "NOT (get(lines, i {0} 1).level <=> lines[i].level)"
    edges = "filter(transform(lines, (x, i) -> i), i -> lines[i].level > 0 AND " + other + ")"
    joined = lambda a, b: normal(F.array_join(F.transform(F.slice("lines", a + 1, b - a + 1), lambda x: F.ltrim(x["line"], F.lit(MARKS))), " "))
    return F.zip_with(F.expr(edges.format("-")), F.expr(edges.format("+")), lambda a, b: F.struct(F.get("lines", a)["level"].alias("level"), joined(a, b).alias("passage")))


def least(of: str, n: int) -> str:
    """The least of n neighbours in an array, for each place that has so many."""
    return f"transform(slice({of}, 1, greatest(0, size({of}) - {n - 1})), (x, i) -> least(x, {', '.join(f'get({of}, i + {k})' for k in range(1, n))}))"


def grams(words: str) -> str:
    return f"transform(slice({words}, 1, greatest(0, size({words}) - {GRAM - 1})), (x, i) -> hash(x, {', '.join(f'get({words}, i + {k})' for k in range(1, GRAM))}))"


def earlier(rows: DataFrame, by: list[str], value: str, order: str = "turn") -> DataFrame:
    """``by``, ``order`` and ``before``: the greatest ``value`` of rows of lower order with equal ``by``.

    Rows have one of each order; they are looked at in blocks of orders, and blocks by their maxima."""
    blocked = rows.select(*by, order, value, F.floor(F.col(order) / BLOCK_TURNS).alias("_block"))
    back = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy(*by, "_block").agg(F.max(value).alias("_most"))
    blocks = blocks.select(*by, "_block", F.max("_most").over(back(Window.partitionBy(*by).orderBy("_block"))).alias("_last"))
    inside = blocked.select(*by, order, "_block", F.max(value).over(back(Window.partitionBy(*by, "_block").orderBy(order))).alias("_within"))
    return inside.join(blocks, [*by, "_block"]).select(*by, order, F.coalesce("_within", "_last").alias("before"))


def places(rows: DataFrame) -> DataFrame:
    """c, turn, n (messages), position (messages of earlier turns and one) and before (the turn before)."""
    turns = rows.groupBy("c", "turn").agg(F.count(F.lit(1)).alias("n"))
    untimed = turns.where("turn IS NULL").select("c", F.col("n").alias("_first"))
    timed = turns.where("turn IS NOT NULL").withColumn("_block", F.floor(F.col("turn") / BLOCK_TURNS))
    back = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = timed.groupBy("c", "_block").agg(F.sum("n").alias("_n"), F.max("turn").alias("_last"))
    over = back(Window.partitionBy("c").orderBy("_block"))
    blocks = blocks.select("c", "_block", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_start"), F.max("_last").over(over).alias("_last"))
    inside = back(Window.partitionBy("c", "_block").orderBy("turn"))
    ranked = timed.select("c", "turn", "n", "_block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("_within"), F.max("turn").over(inside).alias("_lag"))
    placed = ranked.join(blocks, ["c", "_block"]).join(untimed, "c", "left").select(
        "c", "turn", "n", (F.coalesce("_first", F.lit(0)) + F.col("_start") + F.col("_within") + 1).alias("position"), F.coalesce("_lag", "_last").alias("before")
    )
    return placed.unionByName(turns.where("turn IS NULL").select("c", "turn", "n", F.lit(1).cast("long").alias("position"), F.lit(None).cast("long").alias("before")))


def named_rows(messages: DataFrame) -> DataFrame:
    """c (the conversation, never null), turn, key (of the text), text (never null), marked (it has a ">") and what was given."""
    text = F.coalesce("text", F.lit(""))
    return messages.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")).alias("c"), "conv_id", F.col("turn").cast("long").alias("turn"), "role",
        F.md5(text).alias("key"), text.alias("text"), F.contains(text, F.lit(">")).alias("marked"),
    )


def lines_of() -> Column:
    return F.transform(F.split("text", "\n"), lambda x: F.struct(level_of(x).alias("level"), x.alias("line")))


def said(rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """c, hash (of a passage) and turn of every message that says a quoted passage in its own words."""
    # Only conversations with quotes are taken apart. Written down, they have a size that Spark knows,
    # and texts need not move to meet them. (Others of equal hash are taken apart for nothing.)
    quoting = Cut(quotes.select(F.xxhash64("c").alias("q")).distinct(), "quoting").df
    asked = rows.where("turn IS NOT NULL").withColumn("q", F.xxhash64("c")).join(quoting, "q", "left_semi")
    own = asked.select("c", "turn", F.xxhash64("text").alias("tag"), F.filter(F.transform(own_lines(), normal), lambda x: x != "").alias("own"))
    worded = own.select("c", "turn", "tag", F.filter("own", lambda x: n_words(x) < FEWEST).alias("short"), F.split(F.array_join("own", " "), " ").alias("w"))
    hashed = worded.select("c", "turn", "tag", "short", F.expr(grams("w")).alias("g"))
    # An outer explode: of others Spark would compute the array once more, to see whether it is empty.
    keys = F.array_distinct(F.concat(F.expr(least("g", NEIGHBOURS)), F.transform("short", lambda x: F.hash(x))))
    chosen = hashed.select("c", "turn", "tag", F.explode_outer(keys).alias("gram"))
    wanted = quotes.groupBy("c", "passage", "hash").agg(F.max("turn").alias("last")).withColumn("w", F.split("passage", " "))
    firsts = F.least(*[F.hash(*[F.get("w", F.lit(i + k)) for k in range(GRAM)]) for i in range(NEIGHBOURS)])
    is_short = F.size("w") < FEWEST
    wanted = wanted.select("c", "passage", "hash", "last", is_short.alias("is_short"), F.when(is_short, F.hash("passage")).otherwise(firsts).alias("gram"))
    met = chosen.join(wanted, ["c", "gram"]).where("turn < last").select("c", "turn", "tag", "hash", "passage", "is_short")
    # Repeated messages are looked up once; what is compared is where its text will be.
    met = met.repartition("c", "turn", "tag").distinct()
    around = lambda text, by: F.concat(F.lit(by), text, F.lit(by))
    holds = lambda by: F.contains(around(F.array_join("own", by), by), around(F.col("passage"), by))
    same = F.when(F.col("is_short"), holds("\n")).otherwise(holds(" "))
    return met.join(own, ["c", "turn", "tag"]).where(same).select("c", "hash", "turn").distinct()


def parents(rows: DataFrame) -> DataFrame:
    """c, turn, key, origin (the latest of the outermost linked passages) and n_linked of messages with linked passages."""
    split = rows.where("marked AND turn IS NOT NULL").select("c", "turn", "key", lines_of().alias("lines"))
    every = split.select("c", "turn", "key", F.explode_outer(passages()).alias("p")).where("p.passage <> ''")
    # What a message quotes twice is looked up once. Written down, the quotes have a size that Spark knows.
    quotes = Cut(every.groupBy("c", "turn", "key", F.col("p.passage").alias("passage"), F.md5("p.passage").alias("hash")).agg(F.min("p.level").alias("level")), "quotes").df
    sayers = said(rows, quotes).select("c", "hash", "turn", F.col("turn").alias("said"))
    asked = quotes.select("c", "hash", "turn", F.lit(None).cast("long").alias("said")).distinct()
    # Read twice below, so the search behind them is done once.
    moments = Cut(sayers.unionByName(asked).groupBy("c", "hash", "turn").agg(F.max("said").alias("said")), "moments").df
    origins = earlier(moments, ["c", "hash"], "said").where("before IS NOT NULL")
    found = quotes.join(origins, ["c", "hash", "turn"]).groupBy("c", "turn", "key")
    return found.agg(F.max(F.struct(-F.col("level"), "before"))["before"].alias("origin"), F.count(F.lit(1)).alias("n_linked"))


def threaded(nodes: DataFrame) -> DataFrame:
    """c, turn and thread_position of the nodes of conversations that leave the order of turns.

    Nodes: c, turn, parent (null for the first), before, n, position."""
    left = nodes.where(~F.col("parent").eqNullSafe(F.col("before"))).select("c").distinct()
    above = nodes.select("c", F.col("turn").alias("parent"), F.col("position").alias("p_position"))
    tree = Cut(nodes.join(left, "c", "left_semi").join(above, ["c", "parent"], "left").select("c", "turn", "position", "n", "p_position"), "reply-trees")
    first = tree.df.groupBy("c", F.col("p_position").alias("position")).agg(F.min("position").alias("child")).where("position IS NOT NULL")
    # The next sibling is the least later one: the greatest of lower order, with orders turned round.
    turned = tree.df.where("p_position IS NOT NULL").select("c", "p_position", (-F.col("position")).alias("turned"))
    siblings = earlier(turned.withColumn("value", F.col("turned")), ["c", "p_position"], "value", "turned").select("c", (-F.col("turned")).alias("position"), (-F.col("before")).alias("sibling"))
    joined = tree.df.join(first, ["c", "position"], "left").join(siblings, ["c", "position"], "left")
    # Entering a node counts its messages; leaving it counts nothing.
    enter = F.struct((2 * F.col("position")).alias("e"), F.coalesce(2 * F.col("child"), 2 * F.col("position") + 1).alias("next"), F.col("n").alias("sum"))
    leave = F.struct((2 * F.col("position") + 1).alias("e"), F.coalesce(2 * F.col("sibling"), 2 * F.col("p_position") + 1).alias("next"), F.lit(0).cast("long").alias("sum"))
    now = Cut(joined.select("c", F.explode(F.array(enter, leave)).alias("x")).select("c", "x.*"), "reply-tours")
    while not now.df.where("next IS NOT NULL").isEmpty():
        ahead = now.df.select("c", F.col("e").alias("next"), F.col("next").alias("beyond"), F.col("sum").alias("more"))
        step = now.df.join(ahead, ["c", "next"], "left").select("c", "e", F.col("beyond").alias("next"), (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum"))
        after = Cut(step, "reply-tours")
        now.drop()
        now = after
    entered = now.df.where("e % 2 = 0").select("c", (F.col("e") / 2).cast("long").alias("position"), "sum")
    whole = entered.groupBy("c").agg(F.max("sum").alias("whole"), F.min("position").alias("root"))
    ranked = entered.join(whole, "c").select("c", "position", (F.col("root") + F.col("whole") - F.col("sum")).alias("thread_position"))
    out = Cut(tree.df.join(ranked, ["c", "position"]).select("c", "turn", "thread_position"), "reply-threads")
    now.drop()
    tree.drop()
    return out.df


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_quoted, depth, n_linked, reply_to, by_quote, position and thread_position of every message."""
    rows = named_rows(messages)
    found = Cut(parents(rows), "quote-parents")
    replies = found.df.groupBy("c", "turn").agg(F.max("origin").alias("quoted"))
    nodes = places(rows).join(replies, ["c", "turn"], "left").select("c", "turn", F.coalesce("quoted", "before").alias("parent"), "before", "n", "position")
    nodes = Cut(nodes, "reply-nodes").df
    threads = threaded(nodes.where("turn IS NOT NULL"))
    timed = nodes.join(threads, ["c", "turn"], "left").select(F.col("c").alias("_c"), F.col("turn").alias("_turn"), "before", "position", F.coalesce("thread_position", "position").alias("thread_position"))
    # Quoted lines are left out before texts move.
    rows = rows.withColumn("levels", F.when(F.col("marked"), F.transform(F.split("text", "\n"), level_of))).select(
        "c", "conv_id", "turn", "role", "key",
        F.when(F.col("marked"), F.array_join(own_lines(), "\n")).otherwise(F.col("text")).alias("text"),
        F.greatest(F.size(F.filter("levels", lambda x: x > 0)), F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce(F.array_max("levels"), F.lit(0)).cast("long").alias("depth"),
    )
    out = rows.join(found.df, ["c", "turn", "key"], "left").join(timed, (F.col("c") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_turn")))
    return out.select(
        "conv_id", "turn", "role", "text", "n_quoted", "depth",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("origin", "before").alias("reply_to"),
        F.col("origin").isNotNull().alias("by_quote"),
        "position", "thread_position",
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))


def requoted(messages: DataFrame) -> DataFrame:
    """A conversation table with quotes, made by rule from one without: messages quote one
    or two turns before them, some nested, some wrapped anew, some changed, and all say one common line."""
    earlier_text = lambda k: messages.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"t{k}"))
    rows = messages.join(earlier_text(1), ["conv_id", "turn"], "left").join(earlier_text(2), ["conv_id", "turn"], "left")
    quote = lambda mark, x: f"concat('{mark}', replace({x}, '\\n', concat('\\n', '{mark}')))"
    parts = (
        f"CASE WHEN turn % 3 = 2 THEN {quote('> > ', 't2')} END", f"CASE WHEN turn % 4 <> 3 THEN {quote('> ', 't1')} END",
        "CASE WHEN turn % 4 = 3 THEN concat('> ', replace(replace(t2, '\\n', ' '), '. ', '.\\n> ')) END", "CASE WHEN turn % 5 = 4 THEN '> and more' END", "'Thanks a lot.'", "text",
    )
    return rows.select("conv_id", "turn", "role", F.expr(f"concat_ws('\\n', {', '.join(parts)})").alias("text"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Several steps read the made messages; they are made once.
    return linked(Cut(requoted(table(spark, sf_dir, "conversations")), "requoted").df)


def _sql(source: str) -> str:
    words = r"list_filter(regexp_split_to_array(lower(regexp_replace(l, '^[ \t]*(>[ \t]*)*', '')), '[ \t\r]+'), lambda w: w <> '')"
    return rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS whole FROM {source}),
l AS (SELECT id, conv_id, turn, i, l, length(regexp_replace(regexp_extract(l, '^[ \t]*(>[ \t]*)*'), '[^>]', '', 'g')) AS level, {words} AS ws
  FROM (SELECT id, conv_id, turn, unnest(string_split(whole, chr(10))) AS l, generate_subscripts(string_split(whole, chr(10)), 1) AS i FROM m)),
r AS (SELECT *, sum(edge) OVER (PARTITION BY id ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY id ORDER BY i) = level THEN 0 ELSE 1 END AS edge FROM l)),
quotes AS (SELECT id, conv_id, turn, passage, n, min(level) AS level FROM (
    SELECT id, conv_id, turn, level, array_to_string(flatten(list(ws ORDER BY i)), ' ') AS passage, len(flatten(list(ws))) AS n FROM r WHERE level > 0 AND turn IS NOT NULL GROUP BY id, conv_id, turn, run, level)
  WHERE passage <> '' GROUP BY ALL),
says AS (SELECT id, conv_id, turn, ' ' || array_to_string(flatten(list(ws ORDER BY i)), ' ') || ' ' AS own, list(array_to_string(ws, ' ')) AS own_lines FROM l WHERE level = 0 AND turn IS NOT NULL GROUP BY ALL),
found AS (SELECT q.id, q.conv_id, q.turn, q.level, q.passage, max(s.turn) AS origin FROM quotes q JOIN says s ON q.conv_id IS NOT DISTINCT FROM s.conv_id AND s.turn < q.turn
  AND CASE WHEN n >= {FEWEST} THEN contains(own, ' ' || passage || ' ') ELSE list_contains(own_lines, passage) END GROUP BY ALL),
parents AS (SELECT id, conv_id, turn, max(origin) FILTER (WHERE level = least_level) AS origin, count(*) AS n_linked FROM (SELECT *, min(level) OVER (PARTITION BY id) AS least_level FROM found) GROUP BY ALL),
own AS (SELECT id, coalesce(string_agg(CASE WHEN level = 0 THEN l END, chr(10) ORDER BY i), '') AS text,
  sum(CASE WHEN level > 0 THEN 1 ELSE 0 END)::BIGINT AS n_quoted, max(level)::BIGINT AS depth FROM l GROUP BY id),
turns AS (SELECT conv_id, turn, n, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT conv_id, turn, count(*) AS n FROM m WHERE turn IS NOT NULL GROUP BY ALL)),
nodes AS (SELECT t.*, coalesce((SELECT max(origin) FROM parents p WHERE p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.turn = t.turn), before) AS parent FROM turns t),
paths AS (SELECT conv_id, turn, n, [turn] AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT k.conv_id, k.turn, k.n, list_append(p.path, k.turn) FROM nodes k JOIN paths p ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.parent = p.turn),
placed AS (SELECT id, rank() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS position FROM m),
untimed AS (SELECT conv_id, count(*) AS n FROM m WHERE turn IS NULL GROUP BY conv_id),
threads AS (SELECT p.conv_id, p.turn, (sum(p.n) OVER (PARTITION BY p.conv_id ORDER BY path ROWS UNBOUNDED PRECEDING) - p.n + coalesce(u.n, 0) + 1)::BIGINT AS thread_position
  FROM paths p LEFT JOIN untimed u ON p.conv_id IS NOT DISTINCT FROM u.conv_id)
SELECT m.conv_id, m.turn, m.role, own.text, n_quoted, depth, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(origin, before) AS reply_to, origin IS NOT NULL AS by_quote, position,
  coalesce(thread_position, position) AS thread_position
FROM m JOIN own USING (id) JOIN placed USING (id) LEFT JOIN (SELECT id, origin, n_linked FROM parents) p USING (id)
LEFT JOIN turns t ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.turn = t.turn LEFT JOIN threads h ON m.conv_id IS NOT DISTINCT FROM h.conv_id AND m.turn = h.turn
"""


#: DuckDB SQL for op1 and for the same over conversations with quotes: passages are looked for in
#: every earlier message by comparing texts, and threads are walked from the root.
SQL = _sql("conversations")
_REQUOTED = """(SELECT a.conv_id, a.turn, a.role, concat_ws(chr(10),
  CASE WHEN a.turn % 3 = 2 THEN '> > ' || replace(c.text, chr(10), chr(10) || '> > ') END, CASE WHEN a.turn % 4 <> 3 THEN '> ' || replace(b.text, chr(10), chr(10) || '> ') END,
  CASE WHEN a.turn % 4 = 3 THEN '> ' || replace(replace(c.text, chr(10), ' '), '. ', '.' || chr(10) || '> ') END, CASE WHEN a.turn % 5 = 4 THEN '> and more' END, 'Thanks a lot.', a.text) AS text
  FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 LEFT JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn - 2)"""
QUOTED_SQL = _sql(_REQUOTED)
