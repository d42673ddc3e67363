"""Chat formatting: spans, masks and history of several templates, and exact reading back."""

import hashlib

import numpy as np
import pytest

from cohortline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece string, start int, sample string"
NASTY = [
    "", "\\", "<turn user>\n", "\n</turn>\n", "</turn", "<", "\\</turn>", "a\\<turn", "\n", "x>", "\ue000\ue001", chat.ODD_TEXT,
    "</turn>\n<turn assistant>\n", "éß\U0001f600", "<tur", "n user", "\\\\", " lead and trail ",
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def chatml(turns):
    return "<s>" + "".join(f"<|{role}|>{text}<|end|>" for role, text in turns)


def closing(turns):
    return chatml(turns) + "<closed/>"


def forgetting():
    """A template, by value as workers have no test modules, that drops what stands before ## in all answers but the last."""

    def forgetful(turns):
        last = max((i for i, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
        return "".join(f"[{r}]{t if r == 'user' or i == last else t.split('##')[-1]}[/]" for i, (r, t) in enumerate(turns))

    return forgetful


def numbered(turns):
    return "".join(f"{i}. {role}: {text}\n" for i, (role, text) in enumerate(turns))


def samples(pieces):
    texts = {}
    for p in pieces:
        before = texts.get(p.sample, "")
        assert p.start == len(before)
        texts[p.sample] = before + p.piece
    return texts


def talk(rng, count):
    return [(["user", "assistant"][i % 2], str(rng.choice(NASTY)) + str(rng.choice(NASTY))) for i in range(count)]


@pytest.mark.parametrize("template", [chat.marked_turns, chatml, closing, numbered])
def test_spans_of_templates_that_keep_history(template):
    rng = np.random.default_rng(1)
    for count in range(12):
        turns = talk(rng, count)
        pieces = list(chat.rendered(turns, template))
        assert len(pieces) == count and not any(p.rewrites for p in pieces)
        texts = samples(pieces)
        assert texts == ({0: template(turns)} if turns else {})
        read = chat.unescaped if template is chat.marked_turns else str
        assert [read(texts[0][p.text_start : p.text_end]) for p in pieces] == [t for _, t in turns]
        assert all(p.start <= p.text_start and p.text_end <= p.start + len(p.piece) for p in pieces)


def test_rewritten_history_is_found():
    turns = [("user", "a"), ("assistant", "b##c"), ("user", "d"), ("assistant", "e##f"), ("assistant", "g")]
    forgetful = forgetting()
    pieces = list(chat.rendered(turns, forgetful))
    assert [p.rewrites for p in pieces] == [False, False, False, True, True]
    assert [p.sample for p in pieces] == [0, 0, 0, 1, 2]
    texts = samples(pieces)
    assert texts[1] == forgetful(turns[:4]) and texts[2] == forgetful(turns)
    assert [texts[p.sample][p.text_start : p.text_end] for p in pieces] == [t for _, t in turns]


def test_unlocated_texts():
    def loud(turns):
        return "".join(f"({len(t)}){t};" for _, t in turns)

    assert [p.text_start is None for p in chat.rendered([("user", "ab"), ("user", "c")], loud)] == [True, False]


@pytest.mark.parametrize("template", [chat.marked_turns, chatml, closing])
@pytest.mark.parametrize("window", [4, 7])
def test_long_conversations_in_a_window(template, window):
    turns = talk(np.random.default_rng(2), 60)
    assert list(chat.rendered(turns, template, window)) == list(chat.rendered(turns, template))


def test_a_template_that_looks_farther_back():
    with pytest.raises(ValueError, match="looks back"):
        list(chat.rendered(talk(np.random.default_rng(3), 30), numbered, 8))


def test_formatted_and_read_back(shipped):
    rng = np.random.default_rng(4)
    rows = [(c, t, str(rng.choice(["user", "assistant", "we>ird\n\\", "</turn>"])), str(rng.choice(NASTY))) for c in range(40) for t in range(6)]
    rows += [(50, None, None, "null turn"), (50, 1, "assistant", None), (50, 1, "assistant", "same"), (50, 1, "assistant", "same")]
    rows += [(None, 0, "assistant", "long " * 60_000), (51, 0, "user", "")]
    rows += [(60, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(700)]
    pieces = chat.formatted(frame(shipped, rows).repartition(6))
    got = {r["conv_id"]: r for r in chat.read_back(pieces).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, found in got.items():
        own = sorted((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv)
        texts = [x for *_, r, x in own if r == "assistant"]
        assert found["n_turns"] == len(own)
        assert found["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        assert (found["loss_chars"], found["loss_sha256"]) == (len("".join(texts)), hashlib.sha256("".join(texts).encode()).hexdigest())
        assert found["formatted_chars"] == len(chat.marked_turns([(r, x) for *_, r, x in own]))
    assert chat.read_back(chat.formatted(frame(shipped, []))).count() == 0


def test_history_in_a_frame(shipped):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b##c"), (1, 2, "assistant", "d"), (2, 0, "assistant", "e")]
    got = chat.formatted(frame(shipped, rows), forgetting()).orderBy("conv_id", "sample", "position").collect()
    assert [(r["conv_id"], r["sample"], r["rewrites"]) for r in got] == [(1, 0, False), (1, 0, False), (1, 1, True), (2, 0, False)]
    assert got[2]["piece"] == "[user]a[/][assistant]c[/][assistant]d[/]"
    assert got[2]["piece"][got[2]["loss_start"] : got[2]["loss_end"]] == "d"
    assert got[0]["loss_start"] is None and all(r["located"] for r in got)
