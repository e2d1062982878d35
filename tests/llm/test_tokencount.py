import random
from functools import lru_cache

import public_tokenizers
import pytest
import regex

from docloom.llm import tokencount

SCORES = tokencount.zipf_scores(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def brute(word: bytes) -> tuple[int, int]:
    @lru_cache(None)
    def best(at):
        if at == len(word):
            return 0, 0
        options = []
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in SCORES:
                s, n = best(end)
                options.append((SCORES[word[at:end]] + s, n - 1))
        return max(options)

    s, n = best(0)
    return s, -n


def test_trie_against_brute_force():
    trie = tokencount.UnigramTrie(SCORES)
    r = random.Random(1)
    words = ["".join(r.choice(["the", "ing", "é", " ", "xq", "🙂", "tion"]) for _ in range(r.randrange(0, 7))) for _ in range(300)]
    for w in words:
        assert trie(w) == brute(w.encode()), w
    long = "tion" * 40
    assert trie(long) == brute(long.encode())


def test_bounds_do_not_change_results(monkeypatch):
    monkeypatch.setattr(tokencount, "MAX_NODES", 20)
    trie = tokencount.UnigramTrie(SCORES)
    for w in ["there", "these", "therein", "cat", "the"] * 3:
        assert trie(w) == brute(w.encode())


def test_counts(spark):
    rows = [(1, "There it is, there.", "x"), (2, None, "x"), (3, "", "x"), (None, "a" * 5000, "x"), (1, "There it is, there.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_pretokens, r.n_tokens): r for r in tokencount.token_counts(docs, SCORES, public_tokenizers.PATTERN).collect()}
    words = regex.findall(public_tokenizers.PATTERN, rows[0][1])
    n = sum(brute(w.encode())[1] for w in words)
    assert got[(1, len(words), n)].log_probability == pytest.approx(sum(brute(w.encode())[0] for w in words) / 1e6)
    assert (2, 0, 0) in got and (3, 0, 0) in got
    assert tokencount.token_counts(docs, SCORES, public_tokenizers.PATTERN).count() == 5
    assert tokencount.token_counts(docs.limit(0), SCORES, public_tokenizers.PATTERN).count() == 0
