"""Chat formatting by quotation linking. DataFrame operations only.

A message's lines are parsed for nested quote marks (``>``, ``> >``, ``>>>``); each run of lines at
one depth is a passage. Unquoted passages are registered whole, by paragraph and by line, each as a
hash of its normalised form (lower case, white space collapsed). A quoted passage, its paragraphs and
its lines are joined on (conversation, hash) to the earliest message that says them, if that came
before. A passage that is not found whole is found by its paragraphs if all are, and a paragraph by
its lines; it then links to the latest message of its parts. A message answers the one that its least nested, then latest such
link names. Answers form threads, and a thread is named
by its first message's turn.

Result, a row for each message: conv_id, thread, position (its place in the thread in order of turns, from
1; messages of one turn share it), turn, role, parent_turn (-1: none), depth (links up to the thread's
first message), n_quotes and n_linked (quoted passages, and how many were found), body (the
text without quotes or the line that introduces one) and formatted. In order of (conv_id, thread,
position) every message stands behind the one that it answers. ``conversations`` puts the messages of
a thread together in that order, in parts of at most ``PART`` positions: one conversation may hold a
third of all rows, and no task holds all of it.

Defined results: a null text counts as empty; empty and blank passages are never linked; a null
conv_id or turn takes part in no link; repeated rows each get a row; messages that share a
conversation and turn share their links' result; ties go to the least nested, then latest original;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

MARKS = r"^((?:[\x20\x09]*>)*)"
# Words that introduce a quotation at a line's end.
INTRO = r"(?:wrote|writes|said|schrieb|escribió|a écrit)[\x20\x09]*:[\x20\x09]*$"
SPACE = r"[\x20\x09-\x0D]+"
#: Positions in a part of a conversation, and turns in a block of a thread that is ranked by itself.
PART, BLOCK = 64, 1024
#: Conversations that quote are broadcast up to this many; what is said in others is not looked at then.
MOST_QUOTING = 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), SPACE, " "), "^ | $", "")


def _hash(text: Column) -> Column:
    return F.md5(normalised(text).cast("binary"))


def lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn, _k, pos, level, content, run, intro of each line; run numbers the passages."""
    rows = messages.select("conv_id", "turn", "_k", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    rows = rows.withColumn("level", F.length(F.regexp_replace(marks, r"[^>]", "")))
    content = F.when(F.col("level") > 0, F.regexp_replace("line", MARKS + r"[\x20\x09]?", "")).otherwise(F.col("line"))
    order = Window.partitionBy("_k").orderBy("pos")
    rows = rows.select("conv_id", "turn", "_k", "pos", "level", content.alias("content"))
    new = (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1))).cast("int")
    intro = (F.col("level") == 0) & F.col("content").rlike(INTRO) & (F.coalesce(F.lead("level").over(order), F.lit(0)) > 0)
    return rows.withColumn("_new", new).withColumn("intro", intro).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _joined(value: str = "content") -> Column:
    """The group's lines in order, one text. A group is part of one message."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", value))), lambda x: x[value]), "\n")


def _parts(text: Column) -> Column:
    """(par, line, text) of a passage (-1, -1), its paragraphs (par, -1) and their lines."""
    part = lambda p, n, t: F.struct(p.cast("int").alias("par"), n.cast("int").alias("line"), t.alias("text"))
    none = F.lit(-1)
    below = F.transform(F.split(text, r"\n[\x20\x09]*\n"), lambda t, p: F.concat(F.array(part(p, none, t)), F.transform(F.split(t, r"\n"), lambda x, n: part(p, n, x))))
    return F.concat(F.array(part(none, none, text)), F.flatten(below))


def quotations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of quoted passages (_k, conv_id, turn, level, run, par, line, h), and first sayings (conv_id, h, said)
    of the conversations that quote, or of all where those are too many."""

    def passages(lines: DataFrame) -> DataFrame:
        return lines.where("NOT intro").groupBy("_k", "conv_id", "turn", "level", "run").agg(_joined().alias("text"))

    filled = normalised(F.col("text")) != ""
    quoted, said = rows.where("level > 0"), rows.where("level = 0")
    those = quoted.where("conv_id IS NOT NULL").select("conv_id").distinct()
    if those.limit(MOST_QUOTING + 1).count() <= MOST_QUOTING:
        said = said.join(F.broadcast(those), "conv_id", "left_semi")
    quoted, said = passages(quoted), passages(said)
    quoted = quoted.select("_k", "conv_id", "turn", "level", "run", F.explode(_parts(F.col("text"))).alias("part"))
    quoted = quoted.select("_k", "conv_id", "turn", "level", "run", "part.*").where(filled).withColumn("h", _hash(F.col("text"))).drop("text")
    pieces = F.array_distinct(F.concat(F.array("text"), F.split("text", r"\n[\x20\x09]*\n"), F.split("text", r"\n")))
    said = said.select("conv_id", "turn", F.explode(pieces).alias("text")).where(filled)
    return quoted, said.select("conv_id", "turn", _hash(F.col("text")).alias("h")).groupBy("conv_id", "h").agg(F.min("turn").alias("said"))


def found_quotes(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """_k, conv_id, turn, level, run, said of each quoted passage; said is null where it is not found."""
    key = ["_k", "conv_id", "turn", "level", "run"]

    def up(parts: DataFrame, by: list[str], whole: Column) -> DataFrame:
        """said of the whole, or else the latest of the parts if all are found."""
        all_found = F.min(F.when(~whole, F.col("said").isNotNull()))
        rows = parts.groupBy(*by).agg(F.max(F.when(whole, F.col("said"))).alias("_whole"), all_found.alias("_all"), F.max(F.when(~whole, F.col("said"))).alias("_last"))
        return rows.select(*by, F.coalesce("_whole", F.when(F.col("_all"), F.col("_last"))).alias("said"))

    parts = quoted.join(said, ["conv_id", "h"], "left").withColumn("said", F.when(F.col("said") < F.col("turn"), F.col("said")))
    return up(up(parts, [*key, "par"], F.col("line") < 0), key, F.col("par") < 0)


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread, depth of messages that answer another, by pointer doubling: the rounds
    grow with the logarithm of the longest chain of answers."""
    at = materialise(links.select("conv_id", "turn", F.col("parent_turn").alias("thread"), F.lit(1).alias("depth")), "threads")
    while True:
        up = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_up"), F.col("depth").alias("_more"))
        joined = at.join(up, ["conv_id", "thread"], "left")
        if joined.where(F.col("_up").isNotNull()).limit(1).count() == 0:
            return at
        at = materialise(joined.select("conv_id", "turn", F.coalesce("_up", "thread").alias("thread"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), "threads")


def positions(answers: DataFrame) -> DataFrame:
    """conv_id, turn, position of the messages that answer another: one more than how many such turns of
    their thread come before, behind the thread's first message. Turns are ranked in blocks of ``BLOCK``,
    and a running sum over the blocks' sizes tells each where it starts."""
    rows = answers.select("conv_id", "thread", "turn", F.floor(F.col("turn") / BLOCK).alias("_block"))
    sizes = rows.groupBy("conv_id", "thread", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id", "thread").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "thread", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "thread", "_block").orderBy("turn"))
    ranked = rows.withColumn("_rank", inside).join(sizes, ["conv_id", "thread", "_block"])
    return ranked.select("conv_id", "turn", (F.col("_start") + F.col("_rank") + 1).alias("position"))


def conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, thread, part, messages (position, turn, role, parent_turn, body): the threads of
    ``format_chats`` in reply order, quotes left out, ``PART`` positions to a row."""
    part = F.floor((F.col("position") - 1) / PART).alias("part")
    message = F.struct("position", "turn", "role", "body", "parent_turn")
    rows = formatted.groupBy("conv_id", "thread", part).agg(F.sort_array(F.collect_list(message)).alias("messages"))
    return rows.select("conv_id", "thread", "part", "messages")


def quoting(messages: DataFrame) -> DataFrame:
    """The messages as if each quoted what came before, so that there is something to link: every turn
    quotes the turn before it, every third one the second line of that turn alone, and every fourth one,
    a level deeper, the turn before that. For tables whose messages quote nothing."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = messages.withColumn("_one", F.lag("text", 1).over(order)).withColumn("_two", F.lag("text", 2).over(order))
    quote = lambda text, marks: F.concat(F.lit(marks), F.regexp_replace(text, "\n", f"\n{marks}"), F.lit("\n"))
    first = F.substring_index("_one", "\n", 1)
    one = F.when(F.col("turn") % 3 == 0, quote(first, "> ")).otherwise(quote(F.col("_one"), "> "))
    two = F.when(F.col("turn") % 4 == 0, quote(F.col("_two"), ">> "))
    text = F.concat(F.when(F.col("_one").isNotNull(), F.lit("They wrote:\n")).otherwise(""), F.coalesce(two, F.lit("")), F.coalesce(one, F.lit("")), F.coalesce("text", F.lit("")))
    return rows.select("conv_id", "turn", "role", text.alias("text"))


def format_chats(messages: DataFrame) -> DataFrame:
    """The rows described above."""
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("_times"))
    rows = rows.withColumn("_k", F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text")).cast("binary"), 256))
    parsed = materialise(lines(rows), "lines")
    quoted, said = quotations(parsed)
    found = materialise(found_quotes(quoted, said).withColumn("_ok", F.col("said").isNotNull()), "quotes")
    links = materialise(found.where("_ok").groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("said")).alias("back"))).alias("_m")).select("conv_id", "turn", (-F.col("_m.back")).alias("parent_turn")), "answers")
    counts = found.groupBy("_k").agg(F.count("*").alias("n_quotes"), F.sum(F.col("_ok").cast("long")).alias("n_linked"))
    bodies = parsed.where("level = 0 AND NOT intro").groupBy("_k").agg(F.regexp_replace(_joined(), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("body"))
    above = threads(links)
    placed = above.join(positions(above), ["conv_id", "turn"])
    out = rows.join(bodies, "_k", "left").join(counts, "_k", "left").join(links, ["conv_id", "turn"], "left").join(placed, ["conv_id", "turn"], "left")
    body = F.coalesce("body", F.lit(""))
    return out.select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), F.coalesce("position", F.lit(1)).cast("long").alias("position"), "turn", "role", F.coalesce("parent_turn", F.lit(-1)).cast("long").alias("parent_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), body.alias("body"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), body, F.lit("\n<|end|>\n")).alias("formatted"), F.explode(F.sequence(F.lit(1), "_times")).alias("_copy"),
    ).drop("_copy")


ORACLE = r"""
WITH RECURSIVE msgs AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS k FROM conversations),
raw AS (
  SELECT conv_id, turn, k, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT *, string_split_regex(text, '\r\n|\r|\n') AS parts FROM msgs)),
lv AS (
  SELECT *, len(regexp_replace(regexp_extract(line, '^((?:[\x20\x09]*>)*)', 1), '[^>]', '', 'g')) AS level FROM raw),
ln AS (
  SELECT conv_id, turn, k, pos, level, CASE WHEN level > 0 THEN regexp_replace(line, '^((?:[\x20\x09]*>)*)[\x20\x09]?', '') ELSE line END AS content FROM lv),
mk AS (
  SELECT *, level = 0 AND regexp_matches(content, '(?:wrote|writes|said|schrieb|escribió|a écrit)[\x20\x09]*:[\x20\x09]*$')
      AND coalesce(lead(level) OVER w, 0) > 0 AS intro,
    CASE WHEN level <> coalesce(lag(level) OVER w, -1) THEN 1 ELSE 0 END AS fresh
  FROM ln WINDOW w AS (PARTITION BY k ORDER BY pos)),
rn AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM mk),
passages AS (
  SELECT k, conv_id, turn, level, run, string_agg(content, chr(10) ORDER BY pos) AS text FROM rn WHERE NOT intro GROUP BY ALL),
quoted AS (
  SELECT *, md5(trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS h FROM passages
  WHERE level > 0 AND trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') <> ''),
pieces AS (
  SELECT conv_id, turn, unnest(list_concat([text], list_concat(string_split_regex(text, '\n[\x20\x09]*\n'), string_split(text, chr(10))))) AS text
  FROM passages WHERE level = 0),
said AS (
  SELECT conv_id, md5(trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS h, min(turn) AS said FROM pieces
  WHERE trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') <> '' GROUP BY ALL),
paragraphs AS (
  SELECT k, conv_id, turn, level, run, unnest(ps) AS text, generate_subscripts(ps, 1) AS par
  FROM (SELECT *, string_split_regex(text, '\n[\x20\x09]*\n') AS ps FROM quoted)),
parts AS (
  SELECT k, conv_id, turn, level, run, 0 AS par, 0 AS line, text FROM quoted
  UNION ALL SELECT k, conv_id, turn, level, run, par, 0, text FROM paragraphs
  UNION ALL SELECT k, conv_id, turn, level, run, par, unnest(generate_series(1, len(string_split(text, chr(10))))), unnest(string_split(text, chr(10))) FROM paragraphs),
hashed AS (
  SELECT * EXCLUDE (text), md5(trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS h FROM parts
  WHERE trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') <> ''),
met AS (
  SELECT p.* EXCLUDE (h), CASE WHEN s.said < p.turn THEN s.said END AS said FROM hashed p LEFT JOIN said s ON p.conv_id = s.conv_id AND p.h = s.h),
by_par AS (
  SELECT k, conv_id, turn, level, run, par, coalesce(max(said) FILTER (line = 0), CASE WHEN bool_and(said IS NOT NULL) FILTER (line > 0) THEN max(said) FILTER (line > 0) END) AS said
  FROM met GROUP BY ALL),
found AS (
  SELECT k, conv_id, turn, level, run, coalesce(max(said) FILTER (par = 0), CASE WHEN bool_and(said IS NOT NULL) FILTER (par > 0) THEN max(said) FILTER (par > 0) END) AS said, (coalesce(max(said) FILTER (par = 0), CASE WHEN bool_and(said IS NOT NULL) FILTER (par > 0) THEN max(said) FILTER (par > 0) END)) IS NOT NULL AS ok
  FROM by_par GROUP BY k, conv_id, turn, level, run),
links AS (
  SELECT conv_id, turn, arg_min(said, level * 1000000000000 - said) AS parent_turn FROM found WHERE ok GROUP BY ALL),
walk AS (
  SELECT conv_id, turn, parent_turn AS above, 1 AS depth FROM links
  UNION ALL SELECT w.conv_id, w.turn, l.parent_turn, w.depth + 1 FROM walk w JOIN links l ON w.conv_id = l.conv_id AND w.above = l.turn),
heads AS (SELECT conv_id, turn, arg_max(above, depth) AS thread, max(depth) AS depth FROM walk GROUP BY ALL),
tops AS (SELECT *, 1 + row_number() OVER (PARTITION BY conv_id, thread ORDER BY turn) AS position FROM heads),
bodies AS (
  SELECT k, regexp_replace(string_agg(content, chr(10) ORDER BY pos), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body
  FROM rn WHERE level = 0 AND NOT intro GROUP BY k),
counts AS (SELECT k, count(*) AS n_quotes, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS n_linked FROM found GROUP BY k)
SELECT m.conv_id, coalesce(t.thread, m.turn) AS thread, CAST(coalesce(t.position, 1) AS BIGINT) AS position, m.turn, m.role, CAST(coalesce(l.parent_turn, -1) AS BIGINT) AS parent_turn, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth,
  CAST(coalesce(c.n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(c.n_linked, 0) AS BIGINT) AS n_linked, coalesce(b.body, '') AS body,
  '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || coalesce(b.body, '') || chr(10) || '<|end|>' || chr(10) AS formatted
FROM msgs m LEFT JOIN bodies b ON m.k = b.k LEFT JOIN counts c ON m.k = c.k
LEFT JOIN links l ON m.conv_id = l.conv_id AND m.turn = l.turn LEFT JOIN tops t ON m.conv_id = t.conv_id AND m.turn = t.turn
"""

#: The same over messages made to quote each other (``quoting``), and put together by thread.
_QUOTED = r"""quoted_messages AS (
  SELECT conv_id, turn, role, CASE WHEN one IS NOT NULL THEN 'They wrote:' || chr(10) ELSE '' END
    || CASE WHEN turn % 4 = 0 AND two IS NOT NULL THEN '>> ' || replace(two, chr(10), chr(10) || '>> ') || chr(10) ELSE '' END
    || CASE WHEN one IS NULL THEN '' WHEN turn % 3 = 0 THEN '> ' || string_split(one, chr(10))[1] || chr(10) ELSE '> ' || replace(one, chr(10), chr(10) || '> ') || chr(10) END
    || coalesce(text, '') AS text
  FROM (SELECT *, lag(text, 1) OVER w AS one, lag(text, 2) OVER w AS two FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST)))"""
_CHATS = ORACLE.replace("row_number() OVER () AS k FROM conversations)", "row_number() OVER () AS k FROM quoted_messages)").replace("WITH RECURSIVE msgs AS", f"WITH RECURSIVE {_QUOTED},\nmsgs AS")
CONVERSATIONS_ORACLE = f"""SELECT conv_id, thread, CAST((position - 1) // {PART} AS BIGINT) AS part, count(*) AS n_messages,
  md5(string_agg(position || ':' || turn || ':' || coalesce(role, '') || ':' || parent_turn || ':' || body, chr(10) ORDER BY position, turn, role NULLS FIRST, body)) AS digest
FROM ({_CHATS}) GROUP BY conv_id, thread, part"""


def conversation_digests(messages: DataFrame) -> DataFrame:
    """conv_id, thread, part, n_messages, digest of the conversations of messages made to quote each other."""
    rows = conversations(format_chats(quoting(messages)))
    line = lambda m: F.concat_ws(":", m["position"], m["turn"], F.coalesce(m["role"], F.lit("")), m["parent_turn"], m["body"])
    return rows.select("conv_id", "thread", "part", F.size("messages").cast("long").alias("n_messages"), F.md5(F.array_join(F.transform("messages", line), "\n").cast("binary")).alias("digest"))
