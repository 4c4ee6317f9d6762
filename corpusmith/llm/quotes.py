"""Chat formatting by quotation linking.

A line's quote level is the number of leading '>' marks. Runs of lines of one
level are passages. A quoted passage is normalised (lower case, white space as
one space, trimmed) and hashed, and joined, within its conversation, to earlier
messages' own passages, paragraphs and lines of the same hash. So are its parts:
its paragraphs, its lines and all its windows of WINDOW words, which may cross
lines, joined to the same of earlier messages. Thus a quote of some lines or
paragraphs, of a sentence within a line, or of a part that was wrapped anew is
found too; only a part of a line of fewer words is too short to tell.

A message answers the message that its quotes of the least level with a match
point to: the one that most of these passages match whole, of equals that of
most matching parts of its other passages, of equals the latest. Without a match
at any level it answers the latest message before it; the first answers none.
n_quotes counts the passages of that level that match the answered message,
whole or in part. The conversation is then laid out as a reply tree, each
message followed by its answers in turn order, without the quotes.

Defined results: a null text is empty; rows with a null conv_id or turn have no
place in a conversation and are left out; repeated rows (same conv_id and turn)
are one message, the one with the least role and text (nulls last); very long texts
are taken apart whole; a message of quotes only stays, with an empty text; attribution lines ("... wrote:") before a
quote are dropped with it; other columns are not read; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions.shared import checked_broadcast, drop_written, written
from corpusmith.functions.ship import map_arrow

from . import textops as T

#: Words of the windows by which parts of messages are compared.
WINDOW = 5
_LEVEL = r"^(?:[ \t]*>)+"
_MESSAGE = ["conv_id", "turn"]


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, one row a message. Only messages of repeated rows are shuffled."""
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), conversations["role"].alias("role"), conversations["text"].alias("text"))
    rows = rows.where("conv_id is not null and turn is not null")
    twice = written(rows.groupBy(*_MESSAGE).agg(F.count("*").alias("n")).where("n > 1").select(*_MESSAGE), "repeated_messages")
    out = rows
    if not twice.isEmpty():
        again = checked_broadcast(twice, 16)
        order = Window.partitionBy(*_MESSAGE).orderBy(F.asc_nulls_last("role"), F.asc_nulls_last("text"))
        least = rows.join(again, _MESSAGE, "left_semi").withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
        out = rows.join(again, _MESSAGE, "left_anti").unionByName(least)
    return out.select(*_MESSAGE, "role", F.coalesce("text", F.lit("")).alias("text"))


def lines(msgs: DataFrame) -> DataFrame:
    """One row a line: n, level, its text without marks, and whether it announces a quote."""
    cut = msgs.select(*_MESSAGE, "role", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    mark = F.regexp_extract("line", _LEVEL, 0)
    level = F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))
    out = cut.withColumn("mark", F.length(mark)).select(*_MESSAGE, "role", "n", level.cast("long").alias("level"), F.expr("trim(substring(line, mark + 1))").alias("body"))
    nxt = F.lead("level").over(Window.partitionBy(*_MESSAGE).orderBy("n"))
    return out.withColumn("next_level", nxt).withColumn("announces", (F.col("level") < F.coalesce("next_level", F.lit(0))) & F.col("body").rlike(r"(?i)\bwrote:$")).drop("next_level")


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\t\n\f\r ]+", " "))


def passages(msgs: DataFrame) -> DataFrame:
    """conv_id, turn, role and parts: the runs of lines of one level, as structs of run, level and passage, in order.

    A message without a line that begins with '>' is one run, made in its row; only others are taken apart by line.
    """
    quoting = F.col("text").rlike(r"(?m)^[ \t]*>")
    body = F.array_join(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), "\n")
    part = F.struct(F.lit(1).cast("long").alias("run"), F.lit(0).cast("long").alias("level"), body.alias("passage"))
    simple = msgs.where(~quoting).select(*_MESSAGE, "role", F.array(part).alias("parts"))
    per = Window.partitionBy(*_MESSAGE).orderBy("n")
    rows = lines(msgs.where(quoting)).where(~F.col("announces"))
    runs = rows.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(per), F.lit(-1))).cast("int")).withColumn("run", F.sum("new").over(per))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]), "\n")
    each = runs.groupBy(*_MESSAGE, "role", "level", "run").agg(text.alias("passage"))
    nested = each.groupBy(*_MESSAGE, "role").agg(F.sort_array(F.collect_list(F.struct("run", "level", "passage"))).alias("parts"))
    return simple.unionByName(nested.select(*simple.columns))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("t", _normal(F.col("t"))).where("t <> ''").withColumn("h", F.xxhash64("t")).drop("t")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every WINDOW consecutive words of each row's t, with the row's other columns."""
    for b in batches:
        for lo, hi in T.slices(b.column("t")):
            rows = b.slice(lo, hi - lo)
            w = T.words(rows.column("t"), T.SPACED)
            inside = np.flatnonzero(T.whole(w.offsets, WINDOW, len(w.starts)))
            found = T.ngram_hashes(T.word_hashes(w), WINDOW)[inside].view(np.int64)
            owner = pa.array(w.owner()[inside])
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(owner) for c in _PASSAGE), pa.array(found)], [*_PASSAGE, "h"])


_PASSAGE = [*_MESSAGE, "level", "run"]


def pieces(parts: DataFrame) -> DataFrame:
    """(conv_id, turn, level, run, h, whole) of each passage as a whole and of its paragraphs, lines and windows."""
    each = parts.select(*_MESSAGE, F.explode("parts").alias("p")).select(*_MESSAGE, "p.level", "p.run", "p.passage")
    whole = _hashed(each.select(*_PASSAGE, F.col("passage").alias("t"))).withColumn("whole", F.lit(1))
    cut = F.explode(F.concat(F.split("passage", r"\n[ \t]*\n"), F.split("passage", "\n")))
    some = _hashed(each.select(*_PASSAGE, cut.alias("t")))
    windows = map_arrow(each.select(*_PASSAGE, _normal(F.col("passage")).alias("t")), _windows, "conv_id long, turn long, level long, run long, h long")
    return whole.unionByName(some.unionByName(windows).withColumn("whole", F.lit(0)))


def links(parts: DataFrame) -> DataFrame:
    """conv_id, turn, source and n_quotes of each message whose quotes match an earlier one. Only conversations that quote are hashed. Written."""
    quoting = written(parts.where(F.exists("parts", lambda p: p["level"] > 0)).select("conv_id").distinct(), "quoting")
    made = written(pieces(parts.join(checked_broadcast(quoting, 8), "conv_id", "left_semi")), "pieces")
    quoted = made.where("level > 0").groupBy(*_PASSAGE, "h").agg(F.max("whole").alias("whole"))
    own = made.where("level = 0").select("conv_id", F.col("turn").alias("source"), "h").distinct()
    hits = quoted.join(own, ["conv_id", "h"]).where("source < turn").groupBy(*_PASSAGE, "source").agg(F.max("whole").alias("whole"), F.count("*").alias("n"))
    votes = hits.groupBy(*_MESSAGE, "level", "source").agg(F.sum("whole").alias("wholes"), F.sum(F.expr("if(whole = 1, 0, n)")).alias("some"), F.count("*").alias("n"))
    best = votes.groupBy(*_MESSAGE).agg(F.max(F.struct((-F.col("level")).alias("near"), "wholes", "some", "source", "n")).alias("b"))
    out = written(best.select(*_MESSAGE, "b.source", F.col("b.n").alias("n_quotes")), "links")
    drop_written(made, quoting)
    return out


def tree(turn: np.ndarray, source: list[int | None]) -> tuple[list[int], list[int], list[int]]:
    """Row of the parent (-1: none), depth and position in the tree's order of one conversation's messages, which come in turn order."""
    row = {int(t): k for k, t in enumerate(turn)}
    parent = [row[s] if s is not None else k - 1 for k, s in enumerate(source)]
    children: list[list[int]] = [[] for _ in parent]
    roots, depth, position = [], [0] * len(parent), [0] * len(parent)
    for k, p in enumerate(parent):
        depth[k] = depth[p] + 1 if p >= 0 else 0
        (children[p] if p >= 0 else roots).append(k)
    stack, done = roots[::-1], 0
    while stack:
        k = stack.pop()
        position[k], done = done, done + 1
        stack += reversed(children[k])
    return parent, depth, position


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (conv_id, turn, source, n_quotes) sorted by conv_id and turn: parent, depth and position. One conversation is held at a time."""

    def out(table: pa.Table) -> pa.RecordBatch:
        conv, turn, source = (table.column(c).combine_chunks() for c in ("conv_id", "turn", "source"))
        conv_, turn_ = conv.to_numpy(), turn.to_numpy()
        begins = np.r_[np.flatnonzero(np.r_[True, conv_[1:] != conv_[:-1]]), len(conv_)]
        inner = np.arange(len(conv_)) - np.repeat(begins[:-1], np.diff(begins))
        parent, depth, position = np.where(inner > 0, np.arange(len(conv_)) - 1, -1), inner.copy(), inner.copy()
        linked = np.flatnonzero(source.is_valid().to_numpy(zero_copy_only=False))
        for c in np.unique(np.searchsorted(begins, linked, "right") - 1):
            lo, hi = int(begins[c]), int(begins[c + 1])
            p, depth[lo:hi], position[lo:hi] = tree(turn_[lo:hi], source.slice(lo, hi - lo).to_pylist())
            parent[lo:hi] = [x + lo if x >= 0 else -1 for x in p]
        return pa.RecordBatch.from_arrays([conv, turn, pa.array(turn_[parent], mask=parent < 0), table.column("n_quotes").combine_chunks(), pa.array(depth.astype(np.int64)), pa.array(position.astype(np.int64))], ["conv_id", "turn", "parent", "n_quotes", "depth", "position"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if held[0].column("conv_id")[0] != b.column("conv_id")[b.num_rows - 1]:
            table = pa.Table.from_batches(held)
            conv = table.column("conv_id").to_numpy()
            cut = int(np.searchsorted(conv, conv[-1]))
            yield out(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield out(pa.Table.from_batches(held))


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 0), turn, parent, depth, role, n_quotes and body of each message, in the order of the reply tree.

    Texts are written once, taken apart; what is shuffled to link and order messages is ids and hashes.
    """
    parts = written(passages(messages(conversations)), "passages")
    found = links(parts)
    rows = parts.select(*_MESSAGE).join(checked_broadcast(found, 32), _MESSAGE, "left").select(*_MESSAGE, "source", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"))
    placed = map_arrow(rows.repartition("conv_id").sortWithinPartitions(*_MESSAGE), _ordered, "conv_id long, turn long, parent long, n_quotes long, depth long, position long")
    placed = written(placed, "places")
    own = F.array_join(F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["passage"]), "\n")
    joined = parts.select(*_MESSAGE, "role", F.trim(own, F.lit(" \n\t")).alias("body")).join(checked_broadcast(placed, 48), _MESSAGE)
    return joined.select("conv_id", "position", "turn", "parent", "depth", "role", "n_quotes", "body")


#: A table of replies that quote, made of any conversations, in words that Spark and DuckDB both read: by message, no quote, one of a
#: whole earlier message, of 80 characters of it, of all of it at the second level, with an attribution line, or of a part and the whole.
QUOTING_SQL = """
select conv_id, turn, role, case when k = 0 or (conv_id + k) % 6 = 0 then text
  when (conv_id + k) % 6 = 1 then '> ' || replace(q, chr(10), chr(10) || '> ') || chr(10) || coalesce(text, '')
  when (conv_id + k) % 6 = 2 then '> ' || replace(substring(q, 5, 80), chr(10), chr(10) || '> ') || chr(10) || coalesce(text, '')
  when (conv_id + k) % 6 = 3 then '>> ' || replace(q, chr(10), chr(10) || '>> ') || chr(10) || coalesce(text, '')
  when (conv_id + k) % 6 = 4 then 'They wrote:' || chr(10) || '> ' || replace(q, chr(10), chr(10) || '> ') || chr(10) || chr(10) || coalesce(text, '')
  else '> ' || replace(substring(q, 5, 80), chr(10), chr(10) || '> ') || chr(10) || 'Yes.' || chr(10) || '> > ' || replace(q, chr(10), chr(10) || '> > ') || chr(10) || coalesce(text, '') end as text
from (select a.conv_id, a.turn, a.role, a.text, a.k, coalesce(b.text, '') as q from
  (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn, role nulls last, text nulls last) - 1 as k from {source} where conv_id is not null and turn is not null) a
  left join (select conv_id, text, row_number() over (partition by conv_id order by turn, role nulls last, text nulls last) - 1 as k from {source} where conv_id is not null and turn is not null) b
  on a.conv_id = b.conv_id and b.k = case when a.k > 0 then (a.conv_id * 7 + a.k * 3) % a.k else -1 end)"""


def quoting(conversations: DataFrame) -> DataFrame:
    """The conversations with quotes of earlier messages put before most messages, to see linking at work."""
    return conversations.sparkSession.sql(QUOTING_SQL, source=conversations.select("conv_id", "turn", "role", "text"))


def reply_ordered_sql(source: str = "conversations") -> str:
    """The same as DuckDB SQL, pieces by their text, with a recursive query for the tree. source: a table or a query in brackets."""
    norm = lambda t: rf"trim(regexp_replace(lower({t}), '[\t\n\f\r ]+', ' ', 'g'))"
    level = r"regexp_extract(line, '^(?:[ \t]*>)+')"
    return rf"""
with recursive m as (select conv_id, turn, role, coalesce(text, '') as text from (
  select *, row_number() over (partition by conv_id, turn order by role nulls last, text nulls last) as k from {source} where conv_id is not null and turn is not null) where k = 1),
l0 as (select conv_id, turn, unnest(range(0, len(ls))) as n, unnest(ls) as line from (select conv_id, turn, regexp_split_to_array(text, '\r?\n') as ls from m)),
l1 as (select conv_id, turn, n, length({level}) - length(replace({level}, '>', '')) as level, trim(line[length({level}) + 1:]) as body from l0),
l2 as (select *, level < coalesce(lead(level) over (partition by conv_id, turn order by n), 0) and regexp_matches(body, '(?i)\bwrote:$') as announces from l1),
l3 as (select *, (level <> coalesce(lag(level) over (partition by conv_id, turn order by n), -1))::int as new from l2 where not announces),
l4 as (select *, sum(new) over (partition by conv_id, turn order by n) as run from l3),
p as (select conv_id, turn, level, run, string_agg(body, chr(10) order by n) as passage from l4 group by all),
ws as (select conv_id, turn, level, run, list_filter(string_split({norm('passage')}, ' '), lambda x: x <> '') as ws from p),
pieces as (
  select conv_id, turn, level, run, 't' || t as h, 1 as whole from (select *, {norm('passage')} as t from p) where t <> '' union all
  select conv_id, turn, level, run, 't' || t, 0 from (select conv_id, turn, level, run, {norm('t')} as t from (
    select conv_id, turn, level, run, unnest(list_concat(regexp_split_to_array(passage, '\n[ \t]*\n'), string_split(passage, chr(10)))) as t from p)) where t <> '' union all
  select conv_id, turn, level, run, 'w' || unnest(list_transform(range(0, len(ws) - {WINDOW} + 1), lambda i: array_to_string(ws[i + 1:i + {WINDOW}], ' '))), 0 from ws where len(ws) >= {WINDOW}),
q as (select conv_id, turn, level, run, h, max(whole) as whole from pieces where level > 0 group by all),
u as (select distinct conv_id, turn as source, h from pieces where level = 0),
hits as (select q.conv_id, q.turn, level, run, source, max(whole) as whole, count(*) as n from q join u on q.conv_id = u.conv_id and q.h = u.h where source < q.turn group by all),
votes as (select conv_id, turn, level, source, sum(whole) as wholes, sum(case when whole = 1 then 0 else n end) as n_some, count(*) as n from hits group by all),
best as (select conv_id, turn, source, n as n_quotes from (select *, row_number() over (partition by conv_id, turn order by level, wholes desc, n_some desc, source desc) as k from votes) where k = 1),
b as (select conv_id, turn, trim(string_agg(passage, chr(10) order by run), ' ' || chr(10) || chr(9)) as body from p where level = 0 group by all),
r as (select m.conv_id, m.turn, m.role, coalesce(source, before) as parent, coalesce(n_quotes, 0) as n_quotes, coalesce(body, '') as body
  from (select *, lag(turn) over (partition by conv_id order by turn) as before from m) m left join b on m.conv_id = b.conv_id and m.turn = b.turn left join best on m.conv_id = best.conv_id and m.turn = best.turn),
t as (select conv_id, turn, [turn] as path from r where parent is null union all
  select r.conv_id, r.turn, list_append(t.path, r.turn) from r join t on r.conv_id = t.conv_id and r.parent = t.turn)
select r.conv_id, row_number() over (partition by r.conv_id order by path) - 1 as position, r.turn, parent, len(path) - 1 as depth, role, n_quotes, body from r join t on r.conv_id = t.conv_id and r.turn = t.turn"""


def quoting_sql(source: str = "conversations") -> str:
    """reply_ordered of quoting as DuckDB SQL."""
    return reply_ordered_sql("(" + QUOTING_SQL.format(source=source) + ")")
