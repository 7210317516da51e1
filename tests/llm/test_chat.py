"""Perspectives of one hand-written dialogue, and awkward turns."""

from playseq.llm.chat import perspectives

TURNS = "conv_id bigint, turn bigint, role string, text string, segment int, position int"


def test_every_speaker_is_the_assistant_once(spark):
    rows = [(1, 2, "bo", "Hi <|im_end|>", 0, 0), (1, 1, "al", "Hello", 0, 0), (1, 0, "system", "Be kind", 0, 0), (1, 3, "al", None, 0, 0)]
    found = perspectives(spark.createDataFrame(rows, TURNS), block_turns=2).orderBy("perspective", "position").collect()
    dialogue = {p: "".join(r.segment for r in found if r.perspective == p) for p in ("al", "bo")}
    assert dialogue["bo"] == (
        "<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>user name=al\nHello<|im_end|>\n"
        "<|im_start|>assistant\nHi < |im_end|><|im_end|>\n<|im_start|>user name=al\n<|im_end|>\n"
    )
    assert len(found) == 8
    for r in found:
        assert dialogue[r.perspective][r.first : r.past] == r.segment
        learned = r.speaker == r.perspective and r.turn != 3
        assert (r.train_first is not None) == learned
        if learned:
            assert dialogue[r.perspective][r.train_first : r.train_past] in ("Hello<|im_end|>", "Hi < |im_end|><|im_end|>")


def test_awkward_turns(spark):
    rows = [
        (None, None, None, None, 0, 0), (None, None, "a", "x", 0, 0), (None, 1, "a", "x", 0, 0), (None, 1, "a", "x", 0, 0),
        (2, 0, "system", "only", 0, 0), (3, 0, None, "nobody", 0, 0),
    ]
    found = perspectives(spark.createDataFrame(rows, TURNS)).orderBy("position").collect()
    assert [(r.conv_id, r.perspective, r.speaker) for r in found] == [(None, "a", "a")] * 3 + [(None, "a", "unknown")]
    assert [r.position for r in found] == [1, 2, 3, 4]
    assert perspectives(spark.createDataFrame([], TURNS)).count() == 0
