"""The encoder by runs of texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rivulet.llm import tokens
from rivulet.llm.tokens import Ids, remembered

FILE = public_tokenizers.path("word_bpe_49k.json")


def expected(texts):
    t = Tokenizer.from_file(FILE)
    return [np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


@pytest.mark.parametrize("text", ["Əli", "Ɔkɔ's Ɛ.", "ȺȾb,c", "Ɓaɓ1Ʒ"])
def test_capitals_whose_lower_case_lies_elsewhere(text):
    assert [Ids(FILE).encode(text)] == expected([text])


def test_runs_equal_the_tokenizer(monkeypatch):
    r = random.Random(1)
    letters = [chr(c) for c in range(0x250)] + list("''  ..ab19") * 20
    texts = ["", "   ", "a\x1cb 'sc\x1d\x1e x", "<|endoftext|> a", "日本 x", "''s it's", "a b " * 300] + ["".join(r.choices(letters, k=r.randint(0, 14))) for _ in range(1500)]
    whole = expected(texts)
    monkeypatch.setattr(tokens, "RUN", 200)
    for ids in (Ids(FILE), Ids(FILE, remember=4)):
        assert list(ids.encode_all(texts)) == whole
    assert list(Ids(FILE).encode_all([])) == []


def test_words_outlast_a_task_and_stay_bounded():
    assert remembered(FILE) is remembered(FILE)
    ids = Ids(FILE, remember=20)
    for _ in ids.encode_all(f"w{chr(97 + k % 26)}{chr(97 + k // 26)} often" for k in range(300)):
        assert len(ids) + len(ids.older) <= 20
    list(ids.encode_all(["often"] * 3))
    assert "often" in ids or "often" in ids.older


def test_a_run_looks_each_word_up_once():
    class Counted(Ids):
        n = 0

        def __getitem__(self, word):
            self.n += 1
            return super().__getitem__(word)

    ids = Counted(FILE)
    assert list(ids.encode_all(["one two one"] * 50)) == expected(["one two one"] * 50) and ids.n == 2
