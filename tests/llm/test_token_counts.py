import random

import public_tokenizers
from tokenizers import Tokenizer

from screenlab.llm.token_counts import Merger, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_equal_to_the_library(odd, odd_rows):
    own = Tokenizer.from_file(PATH)
    want = sorted(
        (str(i), len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 2048)
        for i, t in odd_rows
    )
    got = sorted((str(r[0]), *r[1:]) for r in token_counts(odd, PATH).collect())
    assert got == want


def test_odd_letters_equal_the_library():
    rng, own, table = random.Random(5), Tokenizer.from_file(PATH), Merger(PATH)
    pool = [*"aAbSsΣσςİıẞ' \t\n\x85\xa0᠎​　٣½中é😀!?<|>.", "é", "<|endoftext|>", "'s", "'RE", "aaaa"]
    for _ in range(2000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 25)))
        words, special = table.split(text)
        n = (int(table.counts(words).sum()) if words else 0) + special
        assert n == len(own.encode(text, add_special_tokens=False).ids), repr(text)


def test_runs_of_one_letter():
    own, table = Tokenizer.from_file(PATH), Merger(PATH)
    words = ["a" * n for n in (1, 2, 3, 7, 500)] + ["ab" * 400]
    assert table.counts(words).tolist() == [len(own.encode(w).ids) for w in words]


def test_empty_table(none):
    assert token_counts(none, PATH).count() == 0
