from pyspark.sql import functions as F

from corpusmith.llm import quotes as Q

from ..compare import assert_same, save

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "Hello there\nhow are you\n\nSecond para"),
    (1, 1, "assistant", "> hello   THERE\n> how are you\nfine"),
    (1, 2, "user", "Bob wrote:\n> Second para\n>> nested > x\nok"),
    (1, 3, "user", "> fine\n>> hello there\nmid\n> zzz\nend"),
    (1, 4, "user", ">fine"),
    (2, 5, None, None),
    (2, 5, "x", "a"),
    (2, 9, "x", "> \n>>"),
    (None, 1, "user", "x"),
    (3, None, "user", "x"),
    (3, 1, "user", ""),
    (1, 4, "user", ">fine"),
    (4, 0, "user", "same"),
    (4, 1, "user", "same"),
    (4, 2, "user", "> same\nanswer"),
    (4, 3, "user", "> not there\nfree"),
    (5, 7, "user", "> later\nfirst"),
    (5, 8, "user", "later\r\n"),
    (5, 9, "user", " > > first\n\t> LATER  \nbody"),
]


def by_hand(rows):
    """One conversation at a time, with plain loops."""
    import re

    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None and turn is not None:
            key = (role is None, role or "", text is None, text or "")
            old = convs.setdefault(conv, {}).get(turn)
            if old is None or key < old[0]:
                convs[conv][turn] = (key, role, text or "")
    out = set()
    norm = lambda t: re.sub(r"[\t\n\f\r ]+", " ", t.lower()).strip(" ")
    for conv, turns in convs.items():
        own, done, paths = {}, {}, {}
        for turn in sorted(turns):
            lines = []
            for line in re.split(r"\r?\n", turns[turn][2]):
                mark = (re.match(r"(?:[ \t]*>)+", line) or [""])[0]
                lines.append((mark.count(">"), line[len(mark) :].strip(" ")))
            kept = [(v, b) for i, (v, b) in enumerate(lines) if not (i + 1 < len(lines) and lines[i + 1][0] > v and re.search(r"(?i)\bwrote:$", b))]
            runs = []
            for level, body in kept:
                if not runs or runs[-1][0] != level:
                    runs.append([level, []])
                runs[-1][1].append(body)
            bodies = ["\n".join(b) for v, b in runs if v == 0]
            own[turn] = {norm(u) for b in bodies for u in [b, *re.split(r"\n[ \t]*\n", b), *b.split("\n")]} - {""}
            quoted = [norm("\n".join(b)) for v, b in runs if v == 1]
            votes = {t: sum(q in own[t] for q in quoted) for t in own if t < turn}
            best = max(((n, t) for t, n in votes.items() if n), default=None)
            earlier = [t for t in sorted(turns) if t < turn]
            parent = best[1] if best else earlier[-1] if earlier else None
            paths[turn] = (*paths.get(parent, ()), turn)
            done[turn] = (parent, best[0] if best else 0, "\n".join(bodies).strip(" \n\t"))
        for position, turn in enumerate(sorted(turns, key=paths.__getitem__)):
            out.add((conv, position, turn, done[turn][0], len(paths[turn]) - 1, turns[turn][1], done[turn][1], done[turn][2]))
    return out


def test_by_hand_and_sql(spark, tmp_path):
    table = spark.createDataFrame(ROWS, SCHEMA)
    got = {tuple(r) for r in Q.reply_ordered(table).collect()}
    assert got == by_hand(ROWS)
    save(spark, tmp_path, conversations=table)
    assert_same(Q.reply_ordered(table), tmp_path, Q.reply_ordered_sql())


def test_links(spark):
    parent = {(r.conv_id, r.turn): r.parent for r in Q.reply_ordered(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert parent[1, 1] == 0 and parent[1, 2] == 0 and parent[1, 3] == 1 and parent[1, 4] == 1
    # Of equal messages the latest is answered; without a match the one before; a later message is never answered.
    assert parent[4, 2] == 1 and parent[4, 3] == 2 and parent[5, 7] is None and parent[5, 9] == 8


def test_awkward_rows(spark):
    clash = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in ("n", "line", "level", "body", "h", "t", "run", "source", "path", "parent", "position", "k")})
    assert {tuple(r) for r in Q.reply_ordered(clash).collect()} == by_hand(ROWS)
    assert Q.reply_ordered(clash.where("false")).count() == 0
    long = [(1, 0, "u", "z" * 200_000), (1, 1, "u", "> " + "z" * 200_000 + "\nyes"), *((2, i, "u", f"m{i}") for i in range(150))]
    rows = Q.reply_ordered(spark.createDataFrame(long, SCHEMA)).collect()
    assert {(r.conv_id, r.turn): r.depth for r in rows}[2, 149] == 149
    assert next(r for r in rows if r.conv_id == 1 and r.turn == 1).n_quotes == 1


def test_parts_and_deeper_levels(spark, tmp_path):
    first = "one alpha\ntwo beta\nthree gamma\nfour delta"
    paragraphs = "p one\nmore one\n\np two\nmore two\n\np three"
    sentence = "We met on Monday. The plan is to ship the new parser by the end of May. Nobody objected."
    other = "something else"
    rows = [(1, 0, first), (1, 1, other), (1, 2, "> two beta\n> three gamma\nyes")]
    rows += [(2, 0, paragraphs), (2, 1, other), (2, 2, "> p two\n> more two\n>\n> p three\nyes")]
    rows += [(3, 0, "deep words"), (3, 1, other), (3, 2, ">> deep words\nyes")]
    rows += [(4, 0, sentence), (4, 1, other), (4, 2, "> The plan is to ship\n> the new parser by the end of May.\nyes")]
    rows += [(5, 0, first), (5, 1, other), (5, 2, "> one alpha\n> [...]\n> four delta\nyes")]
    # Whole before parts, level 1 in part before level 2 whole, more parts before fewer, words too few to tell.
    rows += [(6, 0, "kept line"), (6, 1, first), (6, 2, "> kept line\nmid\n> two beta\n> cut\nyes")]
    rows += [(7, 0, first), (7, 1, other), (7, 2, ">> something else\n> two beta\n> cut\nyes")]
    rows += [(8, 0, first), (8, 1, "two beta\nno"), (8, 2, other), (8, 3, "> two beta\n> three gamma\nyes")]
    rows += [(9, 0, sentence), (9, 1, other), (9, 2, "> Nobody objected.\nyes")]
    table = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], SCHEMA)
    save(spark, tmp_path, conversations=table)
    assert_same(Q.reply_ordered(table), tmp_path, Q.reply_ordered_sql())
    got = {(r.conv_id, r.turn): (r.parent, r.n_quotes) for r in Q.reply_ordered(table).collect()}
    assert [got[c, 2] for c in range(1, 6)] == [(0, 1)] * 5
    # Both quotes of conversation 6: one whole of 0, one part of 1.
    assert got[6, 2] == (0, 1) and got[7, 2] == (0, 1) and got[8, 3] == (0, 1) and got[9, 2] == (1, 0)


def test_a_table_of_quotes(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    save(spark, tmp_path, conversations=table)
    made = Q.quoting(table)
    assert_same(made, tmp_path, Q.QUOTING_SQL.format(source="conversations"))
    assert made.where("text like '>%'").count() > 0.4 * made.count()
    rows = Q.reply_ordered(made)
    assert_same(rows, tmp_path, Q.quoting_sql())
    assert rows.where("n_quotes > 0").count() > 0.4 * made.count()
