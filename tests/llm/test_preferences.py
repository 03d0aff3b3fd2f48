import random

from tablesync.llm import preferences as p


def render(role, text):
    return f"<|{role}|>\n{text}\n"


def brute(talks):
    out = []
    for a in talks:
        b = a + 1
        if a % 2 or b not in talks:
            continue
        said = {c: sum(len(t) for r, t in talks[c] if r == "assistant") for c in (a, b)}
        chosen, rejected = (a, b) if said[a] >= said[b] else (b, a)
        x, y = talks[chosen], talks[rejected]
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        row = [a // 2, chosen, rejected, n, "".join(render(*t) for t in x[:n])]
        for side in (x, y):
            text, mask = "", []
            for role, said_text in side[n:]:
                begin = len(text) + len(f"<|{role}|>\n")
                if role == "assistant" and said_text:
                    mask.append((begin, begin + len(said_text)))
                text += render(role, said_text)
            row += [text, mask]
        out.append(tuple(row))
    return sorted(out)


def run(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    made = p.preference_rows(turns, p.pairs_of_neighbours(turns)).collect()
    return sorted((r.pair_id, r.chosen_id, r.rejected_id, r.prompt_turns, r.prompt, r.chosen, [tuple(m) for m in r.chosen_mask], r.rejected, [tuple(m) for m in r.rejected_mask]) for r in made)


def test_against_brute_force(spark):
    rng = random.Random(6)
    talks = {}
    for c in range(0, 60):
        if rng.random() < 0.9:
            talks[c] = [(rng.choice(["user", "assistant"]), rng.choice(["hi", "ünï", "", "a longer turn"])) for _ in range(rng.randint(1, 6))]
            if c % 2 and c - 1 in talks and rng.random() < 0.7:
                k = rng.randint(0, len(talks[c - 1]))
                talks[c] = talks[c - 1][:k] + talks[c][: rng.randint(0, 3)] or talks[c]
    rows = [(c, t, r, x) for c, turns in talks.items() for t, (r, x) in enumerate(turns)]
    assert run(spark, rows) == brute(talks)


def test_odd_rows(spark):
    rows = [(0, 0, None, None), (1, None, "user", "x"), (1, 0, "assistant", "y" * 50_000), (None, 0, "user", "z"), (4, 0, "user", "alone"), (6, 0, "user", "same"), (7, 0, "user", "same"), (7, 0, "user", "same")]
    out = run(spark, rows)
    assert [r[:4] for r in out] == [(0, 1, 0, 0), (3, 6, 7, 1)]
    assert out[1][5] == "" and out[1][7] == render("user", "same")
    assert run(spark, []) == []


def test_every_conversation_meets_another_reply(spark):
    talks = {
        0: [(0, "user", "a"), (1, "assistant", "b"), (2, "user", "c"), (3, "assistant", "d"), (4, "user", "e")], 1: [(0, "user", "x"), (1, "assistant", "y")],
        4: [(0, "user", "alone"), (1, "assistant", "z")], 6: [(0, "user", "no reply")], 7: [(None, "system", None), (0, "user", "q"), (5, "assistant", "r")], 8: [(0, "assistant", "only")],
    }
    rows = [(c, t, r, x) for c, turns in talks.items() for t, r, x in turns] + [(None, 0, "user", "lost")]
    turns = p.with_other_replies(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r.pair_id: r for r in p.preference_rows(turns, p.pairs_of_replies(turns)).collect()}
    shown = {c: (r.prompt_turns, r.chosen, r.rejected) for c, r in got.items()}
    line = render
    assert shown == {
        0: (3, line("assistant", "d") + line("user", "e"), line("assistant", "y")), 1: (1, line("assistant", "y"), line("assistant", "d")),
        4: (1, line("assistant", "z"), ""), 6: (1, "", line("assistant", "r")), 7: (2, line("assistant", "r"), ""),
    }
    assert got[0].prompt == line("user", "a") + line("assistant", "b") + line("user", "c")


def test_the_given_conversations_share_prompts(spark):
    from tablesync.llm.queries import QUERIES

    rows = QUERIES["op3_chat_format"](spark, "/root/testdata/sf0.01").collect()
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id").distinct().count()
    assert len(rows) == talks and sum(r.prompt_turns > 0 for r in rows) > 0.9 * talks
