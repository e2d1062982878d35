"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The best segmentation of a prefix depends on that prefix alone. So distinct pre-tokens go into one trie, each of
whose nodes keeps the forward score of its prefix and the number of pieces that gives it; a prefix that many
pre-tokens share is scored once. A pre-token's count is read at its last node.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections import Counter
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docloom.llm.automaton import SuffixAutomaton
from docloom.llm.common import map_texts, text_of

#: Bounds of a Python worker's trie and table; a full one is emptied, but words are kept for one more generation. Longer pre-tokens are scored by themselves.
MAX_NODES, MAX_WORDS, MAX_LENGTH = 800_000, 350_000, 64
MAX_PIECES = 1_000_000


def zipf_scores(path: str) -> dict[bytes, int]:
    """Scores in millionths of nats for the pieces of a file of ranks: piece of rank r has probability 1 / ((r + 1) H).

    Vocabulary files give an order of pieces but no unigram probabilities; Zipf's law turns the order into them.
    """
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    if len(ranks) > MAX_PIECES:
        raise ValueError(f"{path} has {len(ranks)} pieces; a vocabulary should have {MAX_PIECES} at most")
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -round(1e6 * (math.log(r + 1) + total)) for piece, r in ranks.items()}


class UnigramTrie:
    def __init__(self, scores: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in scores]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes, so it can't cover every text")
        self.pieces = SuffixAutomaton(scores.items())
        self.before: dict[str, tuple[int, int]] = {}  # the table before this one filled up
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        # of each node: score and number of pieces of its prefix, and the state of the pieces' automaton
        self.best, self.count, self.state, self.matched = [0], [0], [0], [0]
        self.words: dict[str, tuple[int, int]] = {}

    def _down(self, word: bytes, keep: bool) -> tuple[int, int]:
        """Down the trie; new nodes get score, number of pieces and state from those of shorter prefixes.

        Of equal scores the fewest pieces count. Without `keep` the trie stays as it is.
        """
        a = self.pieces
        next_, link, longest, ending = a.next, a.link, a.length, a.ending
        child, best_of, count_of, state_of, matched_of = self.child, self.best, self.count, self.state, self.matched
        node, best, count, state, matched = 0, [0], [0], 0, 0
        for at, byte in enumerate(word, 1):
            key = node << 8 | byte
            after = child.get(key) if keep else None
            if after is None:
                if keep:
                    state, matched = state_of[node], matched_of[node]
                go = next_[state].get(byte)
                while go is None:  # the longest suffix that goes on; each byte is a piece
                    state = link[state]
                    matched = longest[state]
                    go = next_[state].get(byte)
                state, matched = go, matched + 1
                top, n = None, 0
                for length, score in ending[state]:
                    if length <= matched:
                        score += best[at - length]
                        if top is None or score > top or score == top and count[at - length] + 1 < n:
                            top, n = score, count[at - length] + 1
                if keep:
                    after = child[key] = len(best_of)
                    best_of.append(top)
                    count_of.append(n)
                    state_of.append(state)
                    matched_of.append(matched)
            else:
                top, n = best_of[after], count_of[after]
            node = after or 0
            best.append(top)
            count.append(n)
        return best[-1], count[-1]

    def __call__(self, text: str) -> tuple[int, int]:
        """(score, number of pieces) of a pre-token."""
        found = self.words.get(text)
        if found is not None:
            return found
        found = self.before.get(text)
        word = text.encode("utf-8", "surrogatepass")
        if found is None and len(word) > MAX_LENGTH:
            return self._down(word, False)
        if len(self.best) > MAX_NODES or len(self.words) > MAX_WORDS:
            self.before = self.words
            self.clear()
        if found is None:
            found = self._down(word, True)
        self.words[text] = found
        return found


@lru_cache(maxsize=1)
def _trie(key: str, broadcast) -> UnigramTrie:
    return UnigramTrie(broadcast.value)


def token_counts(docs: DataFrame, scores: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, log_probability): one row per row of docs, whole texts.

    `pattern` splits a text into pre-tokens; each is cut into the pieces of the highest total score (fewest pieces
    if equal). log_probability is in nats. A null or empty text has zero tokens. Null ids and repeated rows are
    kept; an empty table gives an empty result; other columns are not read.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(scores)
    key = uuid.uuid4().hex  # a Python worker keeps the trie of one call
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("log_probability", pa.float64())])

    def one(ids, texts):
        trie, find = _trie(key, broadcast), regex.compile(pattern).findall
        sizes, tokens, total = [], [], []
        for text in texts:
            words = Counter(find(text.decode("utf-8", "replace")))
            n = score = 0
            for w, k in words.items():
                s, c = trie.words.get(w) or trie(w)
                n += k * c
                score += k * s
            sizes.append(words.total())
            tokens.append(n)
            total.append(score / 1e6)
        return ids, sizes, tokens, total

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).cast("binary").alias("text"))
    return map_texts(rows, one, schema, "doc_id long, n_pretokens long, n_tokens long, log_probability double")
