"""Special tokens in texts, against the tokenizers library as it is."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortline.llm import token_file

WORDS = public_tokenizers.path(token_file.VOCABULARY_FILE)
TEXTS = [
    "foo <|endoftext|> bar",
    "foo<|endoftext|>bar, and. more",
    "<|startoftext|>Foo <|ENDOFTEXT|> Bar<|endoftext|>",
    "<|startoftext|><|startoftext|>",
    "no <|special|> one, <|endoftext |>",
    "<|<|endoftext|>|>",
    "",
    "plain Words. here",
]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[::-1], *[[t] for t in TEXTS]])
def test_special_tokens_match_the_library(texts):
    library = Tokenizer.from_file(WORDS)
    found = token_file.WordTokenizer(WORDS).encode(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_in_a_token_file(documents, shipped, tmp_path):
    library = Tokenizer.from_file(WORDS)
    path = str(tmp_path / "tokens")
    token_file.write_token_file(documents([(i, t, "a") for i, t in enumerate(TEXTS)]), path, WORDS)
    got = {r["doc_id"]: r for r in token_file.read_token_file(shipped, path).collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        wanted = [*library.encode(text, add_special_tokens=False).ids, token_file.END_ID]
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == wanted
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(wanted))
        start += len(wanted)


def test_words_of_letters_need_no_offsets(monkeypatch):
    """offsets, most of what an encoding costs, were made for every word."""
    tokenizer = token_file.WordTokenizer(WORDS)
    library = Tokenizer.from_file(WORDS)
    words = ["plain", "Größe", "naïve", "слово", "ΣΑΣ", "語彙", "ﬁn", "ǅ", "ªº", "x" * 3000, "zzqqxxjjvvkk"]
    cut, taken = tokenizer._cut, []

    def counted(some):
        taken.extend(some)
        return cut(some)

    monkeypatch.setattr(tokenizer, "_cut", counted)
    texts = [" ".join(words[i:] + words[:i]) for i in range(len(words))] + ["", " "]
    ids = [np.frombuffer(found, "<u4").tolist() for found in tokenizer.encode(texts)]
    assert ids == [library.encode(text, add_special_tokens=False).ids for text in texts]
    assert set(taken) <= {""}
    # a letter that is lowered to a letter and a mark makes several pieces of a word: offsets tell
    texts = ["İstanbul and İzmir, don't a1b x\u00a0y \u00a0 \u0301e e\u0301 ''", "two İ three", "İ", "last"]
    ids = [np.frombuffer(found, "<u4").tolist() for found in tokenizer.encode(texts)]
    assert ids == [library.encode(text, add_special_tokens=False).ids for text in texts]
    assert "İstanbul" in taken and "don't" in taken
