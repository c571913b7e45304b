"""Conversation logs."""


from offermarket.operators import dialogue


def conversation(spark, turns, conv=1):
    return spark.createDataFrame(
        [(conv, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in turns],
        "conv_id long, turn long, role string, text string",
    )


def contexts(df, n, block):
    got = dialogue.context_window(df, n, block).orderBy("conv_id", "turn").collect()
    return [[item.text for item in row.context] for row in got]


def test_last_ten_messages(spark):
    df = conversation(spark, range(13))
    got = contexts(df, 10, 10_000)
    assert got[12] == [f"m{t}" for t in range(2, 12)]
    assert got[0] == []


def test_blocks_do_not_change_the_context(spark):
    turns = [0, 1, 2, 3, 9, 10, 40, 41, 42, 43, 44, 90]
    df = conversation(spark, turns).unionByName(conversation(spark, range(5), 2))
    expected = contexts(df, 4, 10_000)
    for block in (1, 2, 3, 7):
        assert contexts(df, 4, block) == expected
    texts = [f"m{t}" for t in turns]
    assert expected[: len(turns)] == [texts[max(0, i - 4) : i] for i in range(len(turns))]


def test_append(spark):
    log = conversation(spark, range(2))
    new = spark.createDataFrame(
        [(1, 5, "q1", "a1"), (1, 3, "q0", "a0"), (7, 1, "x", "y")],
        "conv_id long, seq long, question string, answer string",
    )
    got = dialogue.append_turns(log, new).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.role, r.text) for r in got] == [
        (1, 0, "user", "m0"),
        (1, 1, "assistant", "m1"),
        (1, 2, "user", "q0"),
        (1, 3, "assistant", "a0"),
        (1, 4, "user", "q1"),
        (1, 5, "assistant", "a1"),
        (7, 0, "user", "x"),
        (7, 1, "assistant", "y"),
    ]
