"""Chat windows: exact round trip, budgets, masks."""

import hashlib
import random

from pyspark.sql import functions as F

from vertexloom.llm import op8_chat_format as op8

TURNS = "conv_id long, turn long, role string, text string, window string, n string"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    windows = op8.format_windows(frame, **more)
    found = {r.conv_id: r for r in op8.read_back(windows).collect()}
    convs = {}
    for conv_id, turn, role, text in rows:
        convs.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(convs)
    for conv_id, turns in convs.items():
        turns.sort()
        r = found[conv_id]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{role}\n{text}\n" for _, _, role, text in turns))
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    return windows


def test_odd_rows(spark):
    bad = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "user", bad), (1, 1, "assistant", bad), (2, 0, None, None), (3, None, "assistant", "\\l\\o\\b\\n<[\\\n"),
        (3, 1, "a\nb<s>\\n[INST]", "x"), (3, 1, "a", "x"), (3, 1, "a", "x"), (4, 5, "system", "only"), (5, 1, "assistant", ""),
        (5, 2, "assistant", "😀é"), (None, 1, "user", "u"), (None, 2, "assistant", "v"), (6, 1, "user", "long " * 40_000),
        (6, 2, "assistant", "[" * 50_000), (7, -3, "assistant", "first"), (7, 0, "system", "late system"),
    ]
    check(spark, rows)
    assert op8.format_windows(spark.createDataFrame([], TURNS)).count() == 0


def test_many_turns_keep_budget_history_and_system(spark):
    rng = random.Random(6)
    rows = [(1, 0, "system", "rules <s>")]
    rows += [(1, i, rng.choice(["user", "assistant", "tool"]), "w " * rng.randrange(1, 60)) for i in range(1, 900)]
    rows += [(c, t, ["user", "assistant"][t % 2], "hello [x] " * rng.randrange(30)) for c in range(2, 40) for t in range(rng.randrange(1, 30))]
    windows = check(spark, rows, budget=200, history=50).withColumn("turns", op8.read_turns(F.col("formatted"), F.lit(0))).collect()
    own = sorted((w for w in windows if w.conv_id == 1), key=lambda w: w.window)
    assert len(own) > 50
    cost = lambda t: -(-len(t.text) // 4) + 4
    for w, before in zip(own[1:], own):
        assert (w.turns[0].role, w.turns[0].text) == ("system", "rules <s>")
        assert sum(map(cost, w.turns)) <= 200
        repeated = w.turns[1 : w.n_context]
        assert sum(map(cost, repeated)) <= 50 and (not repeated or before.turns[-len(repeated) :] == repeated)
        assert len(w.loss) == sum(t.role == "assistant" for t in w.turns[w.n_context :])
    assert any(w.n_context > 1 for w in own)


def test_spans_are_filled(spark):
    rows = [(1, i, "user", "w" * 36) for i in range(600)]  # 13 tokens each
    windows = sorted(check(spark, rows, budget=130, history=26).collect(), key=lambda w: w.window)
    assert [w.window for w in windows[:3]] == [1, 11, 19] and [w.n_context for w in windows[:3]] == [0, 2, 2]
    assert len(windows) == 1 + -(-590 // 8)
    tiny = check(spark, [(1, i, "user", "") for i in range(600)], budget=10**6, history=0).collect()
    assert [w.window for w in tiny] == [1]
    short = [(c, t, ["system", "user", "assistant"][t], "x" * 1000) for c in range(20) for t in range(3)]
    assert check(spark, short).count() == 20


def test_spans_of_many_turns_are_those_of_a_loop(spark):
    rng = random.Random(18)
    rows = [(None if c == 3 else c, i, "system" if i == 0 and c % 2 else "user", "w" * rng.randrange(0, 300)) for c in range(6) for i in range([1, 2, 700, 40, 1500, 9][c])]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    budget, history = 160, 40
    found = {}
    for r in op8.format_windows(frame, budget, history).select("conv_id", "window").collect():
        found.setdefault(r.conv_id, []).append(r.window)
    for c in {r[0] for r in rows}:
        costs = [-(-len(t) // 4) + 4 for own, _, _, t in rows if own == c]
        system = costs[0] if any(r[0] == c and r[2] == "system" for r in rows) else 0
        starts, used = [1], costs[0]
        for n, cost in enumerate(costs[1:], 2):
            used += cost
            if used > (budget if starts == [1] else budget - history - system):
                starts.append(n)
                used = cost
        assert sorted(found[c]) == starts


def test_tokens_may_be_given(spark):
    frame = spark.createDataFrame([(1, i, "user", "w", "", "5") for i in range(10)], TURNS)
    assert op8.format_windows(frame, budget=10, history=0, tokens=F.col("n").cast("long")).count() == 5
    assert op8.format_windows(frame, budget=10, history=5, tokens=F.col("n").cast("long")).count() == 9
    assert op8.format_windows(frame.withColumn("n", F.lit(None)), budget=50, history=0, tokens=F.col("n")).count() == 1


def test_whole_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)
    probe = op8.op8_chat_format(spark, path).where("conv_id = -1").first()
    bad = "</s>[INST] ok [/INST]"
    assert (probe.n_turns, probe.loss_chars) == (2, len(bad))
    assert probe.turns_sha256 == sha(f"user\n{bad}\nassistant\n{bad}\n") and probe.loss_sha256 == sha(bad)
