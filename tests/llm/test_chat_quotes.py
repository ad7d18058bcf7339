import random

import brute
import pytest

from emberlog.llm import chat_quotes

A = "Shall we meet on Tuesday at noon?\nBring the figures please."
B = "> Shall we meet  on TUESDAY at noon?\n> Bring the figures please.\n\nTuesday is fine with me, thanks."
C = "On Monday Ann wrote:\n> > Shall we meet on Tuesday at noon?\n> > Bring the figures please.\n>\n> Tuesday is fine with me, thanks.\n\nThen I shall bring the cake."
D = "> > > Bring the unknown passage here\n\nNobody said what I quote."


def linked(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")
    return {(r.conv_id, r.turn): r for r in chat_quotes.link(df).collect()}


def test_nested_quotes_build_the_reply_tree(spark):
    got = linked(spark, [(1, 0, "u", A, "x"), (1, 1, "a", B, "x"), (1, 2, "u", C, "x"), (1, 3, "a", D, None)])
    assert [got[1, t].reply_to for t in range(4)] == [None, 0, 1, None]
    assert [got[1, t].depth for t in range(4)] == [0, 1, 2, 0]
    assert got[1, 2].root_turn == 0 and [got[1, t].position for t in range(4)] == [0, 1, 2, 3]
    assert got[1, 1].clean_text == "Tuesday is fine with me, thanks."
    assert got[1, 2].clean_text == "Then I shall bring the cake."
    assert got[1, 2].n_quotes == 2 and got[1, 2].n_linked == 2 and got[1, 3].n_linked == 0


def test_long_chain_and_other_conversations(spark):
    says = [f"This is statement number {i} of the chain." for i in range(20)]
    rows = [(7, 0, "u", says[0], "")] + [(7, i, "u", f"> {says[i - 1]}\n{says[i]}", "") for i in range(1, 20)]
    rows += [(8, 5, "u", f"> {says[3]}\nThe passage is of another conversation.", "")]
    got = linked(spark, rows)
    assert [got[7, i].depth for i in range(20)] == list(range(20))
    assert got[8, 5].reply_to is None


def test_nulls_repeats_and_empty(spark):
    got = linked(spark, [(None, 0, "u", A, ""), (1, None, "u", B, ""), (1, 0, None, None, ""), (2, 0, "u", A, ""), (2, 0, "u", A, ""), (2, 1, "a", "> " + A.replace("\n", "\n> "), ""), (3, 0, "u", "", "")])
    assert got[1, 0].clean_text == "" and got[2, 1].reply_to == 0 and got[2, 1].clean_text == ""
    assert got[None, 0].reply_to is None and got[1, None].reply_to is None
    assert linked(spark, []) == {}


def test_quote_of_a_later_message_is_not_a_reply(spark):
    got = linked(spark, [(1, 0, "u", "> " + A.replace("\n", "\n> ") + "\nI was first with this.", ""), (1, 1, "a", A, "")])
    assert got[1, 0].reply_to is None


def test_conversations_in_reply_order(spark):
    rows = [(1, 0, "u", A, ""), (1, 1, "a", "Something else entirely here.", ""), (1, 2, "a", B, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")
    rows = chat_quotes.conversations(chat_quotes.link(df)).collect()
    assert [(r.position, r.text.split()[0]) for r in rows] == [(0, "Shall"), (1, "Tuesday"), (2, "Something")]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "u", A)], "conv_id long, turn long, role string, text string")
    plan = chat_quotes.link(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_short_quotes_are_counted_and_linked(spark):
    rows = [(1, 0, "u", "Shall I go on?", ""), (1, 1, "a", "> Shall I go on?\n\nWhy not?", ""), (1, 2, "u", "> Why not?\n\nNo.", ""), (1, 3, "a", "> No.\n>\n> \t\n\nI see.", ""), (2, 0, "u", "> No.\nOther.", "")]
    got = linked(spark, rows)
    assert [got[1, t].reply_to for t in range(4)] == [None, 0, 1, 2] and [got[1, t].root_turn for t in range(4)] == [0] * 4
    assert [got[1, t].n_quotes for t in range(4)] == [0, 1, 1, 1] and [got[1, t].n_linked for t in range(4)] == [0, 1, 1, 1]
    assert [got[1, t].position for t in range(4)] == [0, 1, 2, 3] and got[1, 3].clean_text == "I see."
    assert got[2, 0].reply_to is None and got[2, 0].n_quotes == 1 and got[2, 0].n_linked == 0


NAMES = ("reply_to", "root_turn", "depth", "n_quotes", "n_linked", "position", "clean_text")


def mail(seed, n):
    """Conversations of messages that quote earlier ones, quotes of quotes included."""
    rng = random.Random(seed)
    words = ["shall", "we", "Meet", "on", "TUESDAY", "why", "not", "the", "cake", "is", "late", "ok"]
    rows = []
    for conv in range(n // 40):
        said = {}
        step = rng.choice([1, 1, 7, 10**12 + 1])
        base = rng.choice([0, -50, -(10**15)])
        for k in range(rng.choice([2, 10, 40, 100])):
            turn = base + k * step
            own = "\n\n".join(" ".join(rng.choice([*words, f"w{rng.randint(0, 200)}"]) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 2)))
            text = own
            if said and rng.random() < 0.8:
                # mostly the last message, so that chains grow long
                of = max(said) if rng.random() < 0.8 else rng.choice(list(said))
                lines = said[of].split("\n")
                cut = lines[: rng.randint(1, len(lines))] if rng.random() < 0.3 else lines
                quote = "\n".join(rng.choice(["> ", ">", " > "]) + x for x in cut)
                announced = rng.choice(["On Monday Ann wrote:\n", "Am Montag schrieb Eva:\n", ""])
                text = announced + quote + "\n\n" + own
            if rng.random() < 0.03:
                text = rng.choice([None, "", "\n\n", ">", "> > nothing that was said"])
            said[turn] = "\n".join((text or "").split("\n")[:30])
            rows.append((conv, turn, rng.choice("ua"), text))
            if rng.random() < 0.02:
                rows.append((conv, turn, "u", "the same turn once more"))
    rows += [(None, 3, "u", "ok"), (None, 4, "u", "> ok"), (0, None, "u", "> ok"), (0, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    rows = mail(seed, 3000)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_quotes.link(df).collect()
    want = brute.quoted(rows)
    rest = [n for n in NAMES if n != "position"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.conv_id, r.turn, *(r[n] for n in rest)) for r in got), key=str) == sorted(((c, t, *(w[n] for n in rest)) for (c, t, _, _), w in zip(rows, want)), key=str)
    assert max(r.depth for r in got) > 8 and sum(r.n_linked for r in got) > 1000
    # positions: without gaps, trees by roots, turns in a tree
    order = {}
    for r in got:
        order.setdefault(r.conv_id, []).append(r)
    assert all(r.position is None for r in order.pop(None))
    for own in order.values():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        assert [key((r.root_turn, r.turn)) for r in own] == sorted(key((r.root_turn, r.turn)) for r in own)


def test_columns_of_any_name(spark):
    names = ["up", "conv", "turn_", "root", "_marked", "_passages", "h1", "file", "row", "given", "text2", "a.b", "position"]
    rows = [(1, 0, "u", A, *range(len(names))), (1, 1, "a", B, *range(len(names)))]
    df = spark.createDataFrame(rows, ["conv_id", "turn", "role", "text", *names])
    got = chat_quotes.link(df).orderBy("turn").collect()
    assert [r.reply_to for r in got] == [None, 0] and [r.position for r in got] == [0, 1]
    assert all(r[n] == i for r in got for i, n in enumerate(names) if n != "position")


def test_turns_of_any_size(spark):
    turns = [-5, 0, 10**12 + 1, 10**12 + 2, 2**62]
    says = [f"statement {i}" for i in range(5)]
    rows = [(1, t, "u", says[i] if i == 0 else f"> {says[i - 1]}\n{says[i]}", "") for i, t in enumerate(turns)]
    got = linked(spark, rows)
    assert [got[1, t].position for t in turns] == [0, 1, 2, 3, 4] and got[1, 2**62].depth == 4


def test_one_conversation_over_many_files(spark):
    rows = [(1, t, "u", f"statement {t}" if t % 10 == 0 else f"> statement {t - t % 10}\nreply {t}", "") for t in range(2000)]
    got = linked(spark, rows + [(2, 0, "u", "alone", "")])
    assert [got[1, t].position for t in range(2000)] == list(range(2000)) and got[2, 0].position == 0


def test_long_text(spark):
    long = "\n".join(f"line {i}" for i in range(100_000))
    got = linked(spark, [(1, 0, "u", long, ""), (1, 1, "a", "> " + long.replace("\n", "\n> ") + "\n\nyes", "")])
    assert got[1, 1].reply_to == 0 and got[1, 1].clean_text == "yes"
