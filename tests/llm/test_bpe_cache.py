"""A full cache is cleared between texts and words, never under a text's words."""

from corpusflow.llm.word_bpe import WordBpe, vocabulary_path


def test_long_words_beside_others_with_a_full_cache():
    b = WordBpe(vocabulary_path(), cache=3)
    for text in ("alpha beta gamma delta " + "x" * 30 + " zeta eta theta iota", "kappa " + "ab" * 20 + " lambda alpha " + "yz" * 15 + " mu nu"):
        assert list(b.encode(text)) == b.tokenizer.encode(text, add_special_tokens=False).ids
