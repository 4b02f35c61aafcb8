"""Quotation linking against a plain version, and on one very long conversation."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from docloom.llm import threads

SCHEMA = "conv_id long, turn long, role string, text string"


def normal(x):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    return re.sub(r"[ \t\x0b\f\r\n]+", " ", low).strip(" ")


def parse(text):
    """(own lines, passages (level, raw lines))"""
    lines = []
    for x in re.split(r"\r\n|\n|\r", text or ""):
        mark = re.match(r"(?:[ \t]*>)+[ \t]?", x)
        lines.append((mark[0].count(">") if mark else 0, x[mark.end() :] if mark else x))
    kinds = []
    for k, (level, line) in enumerate(lines):
        says = level == 0 and re.search(r"(?i)(wrote|schrieb|a écrit|escribió) ?:[ \t]*$", line) and k + 1 < len(lines) and lines[k + 1][0] > 0
        kinds.append(None if not normal(line) else -1 if says else level)
    passages, before = [], None
    for kind, (level, line) in zip(kinds, lines, strict=True):
        if kind is not None and kind >= 0:
            if kind != before:
                passages.append((level, []))
            passages[-1][1].append(line)
        before = kind
    return "\n".join(x for kind, (level, x) in zip(kinds, lines, strict=True) if level == 0 and kind != -1).strip(), passages


def pieces(raw):
    whole = normal("\n".join(raw))
    return whole, {y for y in [*map(normal, raw), *re.split(r"(?<=[.!?]) ", whole)] if y and y != whole}


def brute(rows):
    """{(conv, turn): (body, n_quoted, n_linked, reply_to, position)}, turns unique"""
    out = {}
    for conv in {r[0] for r in rows}:
        held, own, reply, info = sorted((r[1], r[3]) for r in rows if r[0] == conv), [], {}, {}
        for k, (turn, text) in enumerate(held):
            body, passages = parse(text)
            origin, n = {}, 0
            for level, raw in passages:
                if level:
                    whole, parts = pieces(raw)
                    last = lambda y: max((t for t, units in own if y in units), default=None)
                    at = last(whole)
                    if at is None:
                        votes = {}
                        for y in parts:
                            if (o := last(y)) is not None:
                                votes[o] = votes.get(o, 0) + 1
                        at = max(votes, key=lambda o: (votes[o], o), default=None)
                    if at is not None:
                        n += 1
                        if level == 1:
                            origin[at] = origin.get(at, 0) + len(whole)
            reply[turn] = max(origin, key=lambda o: (origin[o], o)) if origin else held[k - 1][0] if k else None
            info[turn] = (body, sum(1 for level, _ in passages if level), n)
            own.append((turn, {y for level, raw in passages if not level for y in {pieces(raw)[0], *pieces(raw)[1]}}))
        place, stack = {}, [held[0][0]]
        while stack:
            t = stack.pop()
            place[t] = len(place)
            stack += sorted((x for x in reply if reply[x] == t), reverse=True)
        out.update({(conv, t): (*info[t], reply[t], place[t]) for t in reply})
    return out


def made(seed, convs=30):
    rng = random.Random(seed)
    words = ["one", "two", "three", "four", "FIVE", "six"]
    rows = []
    for conv in range(convs):
        texts = []
        for turn in range(rng.randrange(1, 12)):
            lines = []
            for _ in range(rng.randrange(3)):
                if texts and rng.random() < 0.8:
                    old = rng.choice(texts).split("\n")
                    a = rng.randrange(len(old))
                    part = " ".join(old[a : a + 3]) if rng.random() < 0.5 else "\n".join(old[a : a + 3])
                    lines += ["Someone wrote:"] * (rng.random() < 0.5) + ["> " + x for x in part.split("\n")]
                lines += [" ".join(rng.choices(words, k=rng.randrange(1, 5))) + rng.choice(["", ".", "?"]) for _ in range(rng.randrange(3))] + [""] * rng.randrange(2)
            texts.append("\n".join(lines))
            rows.append((conv, turn * 3, "a", texts[-1]))
    return rows


def result(spark, rows, parts=3):
    out = threads.linked(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    return {(x.conv_id, x.turn): (x.body, x.n_quoted, x.n_linked, x.reply_to, x.position) for x in out.collect()}


def test_against_plain_version_and_sql(spark):
    rows = made(1)
    want = brute(rows)
    assert result(spark, rows) == want
    c = duckdb.connect()
    import pandas as pd

    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    c.register("conversations", conversations)
    got = c.sql(threads.OP9_SQL).df().astype(object)
    got = got.where(got.notna(), None)
    assert {(x.conv_id, x.turn): (x.body, x.n_quoted, x.n_linked, x.reply_to, x.position) for x in got.itertuples()} == want


def test_wrapped_quotation_and_branches(spark):
    rows = [
        (1, 0, "a", "A long sentence that a mail program\nwill wrap anew. And one more."), (1, 1, "b", "> A long sentence\n> that a mail program will wrap\n> anew. And one more.\nFirst answer."),
        (1, 2, "c", "> And one more.\nSecond answer."), (1, 3, "a", "> First answer.\nTo b."), (1, 4, "a", "> Second answer.\nTo c."), (1, 5, "b", "> To b.\nAgain."),
    ]
    got = result(spark, rows)
    assert {t: v[3] for (_, t), v in got.items()} == {0: None, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3}
    assert sorted(got, key=lambda k: got[k][4]) == [(1, 0), (1, 1), (1, 3), (1, 5), (1, 2), (1, 4)]


def test_repeated_rows_nulls_and_empty_table(spark):
    rows = [(None, 0, "a", "x"), (None, None, "a", "y"), (2, 1, "a", None), (2, 1, "a", None), (2, 1, "b", "z"), (2, 4, "b", "> z")]
    got = sorted(((x.conv_id or 0, -1 if x.turn is None else x.turn, x.body, x.reply_to, x.position) for x in threads.linked(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert len(got) == 5 and (0, -1, "y", None, 0) in got and (0, 0, "x", None, 1) in got
    assert sorted(x[4] for x in got if x[0] == 2) == [0, 1, 2] and {x[3] for x in got if x[1] == 4} == {1}
    assert threads.linked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_long_conversation(spark):
    """100,000 turns in which two threads alternate, and one line in every message."""
    n = 100_000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("a").alias("role"), F.when(F.col("id") < 2, F.concat(F.lit("word "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("> word "), (F.col("id") - 2).cast("string"), F.lit("\nword "), F.col("id").cast("string"), F.lit("\n\nRegards"))).alias("text"))
    out = threads.linked(rows)
    row = out.agg(F.count("*"), F.count_distinct("position"), F.max("position"), F.count_if(F.col("n_linked") == 1)).first()
    assert row[0] == row[1] == n and row[2] == n - 1 and row[3] == n - 2
    # 0 is followed by its two replies (1 by default, 2 by quotation), 1's thread first
    first = {x.turn: x.position for x in out.filter("turn < 5").collect()}
    assert first[0] == 0 and first[1] == 1 and first[3] == 2 and first[2] == n // 2 + 1 and first[4] == n // 2 + 2
