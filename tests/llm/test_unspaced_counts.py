"""Token counts of edited texts without white space."""

import random

import pytest

from corpusflow.llm import token_counts
from corpusflow.llm.word_bpe import WordBpe, vocabulary_path


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(vocabulary_path())


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x4E00, 0x9F00))), "abcdefgh"])
def test_an_edit_in_a_long_run_recounts_little(bpe, letters):
    rng = random.Random(1)
    text = "".join(rng.choice(letters) for _ in range(50_000))
    tree = token_counts.SegmentTree(text, bpe)
    assert tree.tokens[1] == len(bpe.encode(text)) and max(map(len, tree.leaves)) < 1000
    tree.edit(25_000, 25_001, "字")
    assert tree.recounted < 2000 and tree.tokens[1] == len(bpe.encode(tree.text)) and tree.text == text[:25_000] + "字" + text[25_001:]


@pytest.mark.parametrize("letters", ["abcdeXY", "日本語文字漢", "aé1ß!?'s", "a日1。、'", "กขค้า", "한글각ᄀ", "İǅΣς́e", "<|endoftx>", "ab \n日"])
def test_counts_follow_edits_exactly(bpe, letters):
    rng = random.Random(letters)
    for k in range(8):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(2500)))
        text = text[:500] + "<|endoftext|>" + text[500:] if k % 4 == 0 else text
        tree = token_counts.SegmentTree(text, bpe)
        for _ in range(5):
            i = rng.randrange(len(text) + 1)
            j = min(len(text), i + rng.choice([0, 1, 5, 700]))
            new = rng.choice(["", " ", "a", "日本日本", "'", "1", "<|endoftext|>", "".join(rng.choice(letters) for _ in range(400))])
            tree.edit(i, j, new)
            text = text[:i] + new + text[j:]
            assert tree.text == text and tree.tokens[1] == len(bpe.encode(text))
            tree = token_counts.SegmentTree(text, bpe, tree.counts())  # as it is kept
