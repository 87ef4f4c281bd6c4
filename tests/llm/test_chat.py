from __future__ import annotations

from quirelake.llm import chat


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, position long, error string")


def test_segments_and_loss(spark):
    rows = [(1, 0, "system", "s"), (1, 2, "assistant", ""), (1, 1, "user", "u"), (1, 1, "user", "u")]
    out = sorted(chat.formatted(make(spark, rows)).collect(), key=lambda x: x.position)
    assert "".join(x.text for x in out) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [x.loss for x in out] == [False] * 7 + [True, True]
    assert [x.position for x in out] == list(range(9))
    assert {x.error for x in out} == {None}


def test_faults(spark):
    bad = {
        1: ([(0, "assistant", "a")], "turn 0: assistant after start"),
        2: ([(0, "user", "a"), (1, "user", "b"), (2, "assistant", "c")], "turn 1: user after user"),
        3: ([(0, "user", "a")], "turn 0: ends with user"),
        4: ([(0, "user", "a"), (0, "user", "b"), (1, "assistant", "c")], "turn 0: occurs twice"),
        5: ([(0, "user", "a"), (1, None, "b")], "turn 1: unknown role"),
        6: ([(0, "user", None), (1, "assistant", "b")], "turn 0: no text"),
        7: ([(None, "user", "a"), (1, "assistant", "b")], "no turn"),
        8: ([(0, "robot", "a"), (1, "assistant", "b")], "turn 0: unknown role"),
        None: ([(0, "user", "a"), (1, "assistant", "b")], "no conversation"),
    }
    rows = [(i, *t) for i, (turns, _) in bad.items() for t in turns] + [(9, 5, "user", "x" * 100_000), (9, 7, "assistant", "y")]
    out = chat.formatted(make(spark, rows)).collect()
    assert {x.conv_id: x.error for x in out if x.error} == {i: e for i, (_, e) in bad.items()}
    assert all(x.position == 0 and x.text is None and not x.loss and x.turn == -1 for x in out if x.error)
    assert sum(x.conv_id == 9 for x in out) == 6
    assert chat.formatted(make(spark, [])).count() == 0
