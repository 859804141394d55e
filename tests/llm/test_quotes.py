"""Quotation linking against a plain version that compares every passage with every earlier message."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from lineament.llm import quotes

FIELDS = "conv_id long, turn long, role string, text string"
MARKS = re.compile(r"[ \t]*(?:>[ \t]*)*")


def level(line):
    return MARKS.match(line)[0].count(">")


def words(line):
    return [w for w in re.split(r"[ \t\r]+", MARKS.sub("", line, count=1).lower()) if w]


def passages(text):
    runs = []
    for line in (text or "").split("\n"):
        if runs and runs[-1][0] == level(line):
            runs[-1][1].extend(words(line))
        else:
            runs.append((level(line), words(line)))
    least = {}
    for depth, ws in runs:
        if depth and ws:
            least[tuple(ws)] = min(depth, least.get(tuple(ws), depth))
    return least


def says(text, passage):
    own = [words(x) for x in (text or "").split("\n") if level(x) == 0]
    if len(passage) < quotes.FEWEST:
        return list(passage) in own
    flat, n = sum(own, []), len(passage)
    return any(tuple(flat[i : i + n]) == passage for i in range(len(flat) - n + 1))


def plain(rows):
    """{(conv_id, turn): (reply_to, by_quote, n_linked, thread_position)} of rows with distinct turns."""
    by = defaultdict(dict)
    for c, t, _, text in rows:
        by[c][t] = text
    out = {}
    for c, messages in by.items():
        order = sorted(messages)
        parent, children = {}, defaultdict(list)
        for k, t in enumerate(order):
            found = []
            for p, depth in passages(messages[t]).items():
                sayers = [s for s in order[:k] if says(messages[s], p)]
                if sayers:
                    found.append((-depth, max(sayers)))
            parent[t] = max(found)[1] if found else order[k - 1] if k else None
            children[parent[t]].append(t)
            out[c, t] = [parent[t], bool(found), len(found)]
        place, stack = 0, [order[0]]
        while stack:
            t = stack.pop()
            place += 1
            out[c, t].append(place)
            stack += reversed(children[t])
    return {k: tuple(v) for k, v in out.items()}


def made(seed, conversations):
    """Conversations with nested, rewrapped, changed, partial and common quotes."""
    r = random.Random(seed)
    word = lambda: r.choice("ab cd ef gh ij kl mn op qr st".split()) + r.choice(["", "a", "x"])
    rows = []
    for c in range(conversations):
        texts = []
        turns = sorted(r.sample(range(12), r.randint(1, 9)))
        for t in turns:
            lines = [" ".join(word() for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 3))] + ["Thanks a lot"] * r.randint(0, 1)
            if texts and r.random() < 0.7:
                for _ in range(r.randint(1, 2)):
                    source = r.choice(texts)
                    kind = r.random()
                    if kind < 0.3:
                        quoted = source.split("\n")
                    elif kind < 0.6:
                        ws = " ".join(x for x in source.split("\n") if not x.startswith(">")).split()
                        a = r.randint(0, len(ws))
                        ws = ws[a : a + r.randint(1, 14)]
                        k = r.randint(1, 8)
                        quoted = [" ".join(ws[i : i + k]) for i in range(0, len(ws), k)]
                    elif kind < 0.8:
                        quoted = [r.choice(source.split("\n")) + r.choice(["", " changed"])]
                    else:
                        quoted = ["thanks  A LOT"]
                    at = r.randint(0, len(lines))
                    lines[at:at] = [r.choice(["> ", ">", " >  "]) + x for x in quoted]
            texts.append("\n".join(lines))
            rows.append((c, t, "user", texts[-1]))
    return rows


@pytest.mark.parametrize("block", [quotes.BLOCK_TURNS, 2])
def test_links_and_threads_equal_the_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(quotes, "BLOCK_TURNS", block)
    rows = made(block, 300)
    got = {(r.conv_id, r.turn): (r.reply_to, r.by_quote, r.n_linked, r.thread_position) for r in quotes.linked(spark.createDataFrame(rows, FIELDS)).collect()}
    want = plain(rows)
    assert sum(v[1] for v in want.values()) > 300 and sum(v[3] != 1 + sorted(t for c, t in want if c == k[0]).index(k[1]) for k, v in want.items()) > 50
    assert got == want


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "user", ""), (1, 1, "user", ""), (1, None, "x", "> nothing"), (None, 0, "x", "a b"), (None, 1, "x", "> A  b"), (2, None, "y", "z"), (3, 0, "a", "w " * 30000), (3, 1, "b", "> " + "w " * 9)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], FIELDS + ", c string, key int")
    out = quotes.linked(frame).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    assert (got[1, None].position, got[1, None].reply_to, got[1, 0].position, got[1, 1].position) == (1, None, 2, 3)
    assert got[None, 1].by_quote and got[None, 1].reply_to == 0 and got[3, 1].by_quote and got[1, 0].text == ""
    assert quotes.linked(frame.where("false")).count() == 0


def test_messages_are_made_and_looked_through_once(spark, monkeypatch, tmp_path):
    """What several steps read is written down, so no step repeats the joins behind it."""
    spark.createDataFrame(made(1, 5), FIELDS).write.parquet(f"{tmp_path}/conversations.parquet")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    plans, earlier, linked = [], quotes.earlier, quotes.linked
    monkeypatch.setattr(quotes, "linked", lambda messages: plans.append(plan(messages)) or linked(messages))
    monkeypatch.setattr(quotes, "earlier", lambda rows, *a: plans.append(plan(rows)) or earlier(rows, *a) if "hash" in a[0] else earlier(rows, *a))
    assert quotes.quoted_conversations(spark, str(tmp_path)).count() == len(made(1, 5))
    assert len(plans) == 2 and not any("Join" in x or "Generate" in x for x in plans)


def test_blanks_and_repeats(spark):
    """Blanks, carriage returns and repeated rows, against the plain version."""
    long = "One two\tthree  four\r\n five six >seven EIGHT"
    rows = [
        (1, 0, "a", f"\t {long}\n\n  ok \t then\r\n"), (1, 1, "b", ">  ok then\n> >\tone two three four five six >seven eight"), (1, 2, "a", " \t>ok\tTHEN \r\n\t"), (1, 3, "b", "> six >seven\n>eight"),
        (2, 0, "a", "w " * 40), (2, 1, "b", "> " + "w " * 39), (2, 2, "c", "> " + "w " * 41), (2, 3, "d", "> w w\n>\n> w"), (2, 4, "e", "> " + "w " * 6),
    ]
    got = [((r.conv_id, r.turn), (r.reply_to, r.by_quote, r.n_linked, r.thread_position)) for r in quotes.linked(spark.createDataFrame(rows, FIELDS)).collect()]
    assert dict(got) == plain(rows) and len(got) == len(rows)
    twice = quotes.linked(spark.createDataFrame(rows + rows, FIELDS)).collect()
    want = plain(rows)
    assert len(twice) == 2 * len(rows) and all((r.reply_to, r.by_quote, r.n_linked) == want[r.conv_id, r.turn][:3] for r in twice)
