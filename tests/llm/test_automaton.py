import random

from docloom.llm.automaton import SuffixAutomaton


def test_words_that_end_at_each_position():
    r = random.Random(4)
    for _ in range(200):
        words = {"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 15))}
        a = SuffixAutomaton((w, k) for k, w in enumerate(sorted(words)))
        value = {w: k for k, w in enumerate(sorted(words))}
        text = "".join(r.choice("abcd") for _ in range(40))
        state = matched = 0
        for at, c in enumerate(text, 1):
            while c not in a.next[state] and state:
                state = a.link[state]
                matched = a.length[state]
            state, matched = (a.next[state][c], matched + 1) if c in a.next[state] else (0, 0)
            longest = next((n for n in range(at, 0, -1) if any(text[at - n : at] in w for w in words)), 0)
            assert matched == longest and a.length[a.link[state]] < matched <= a.length[state] or not state
            assert [(n, v) for n, v in a.ending[state] if n <= matched] == [(n, value[text[at - n : at]]) for n in range(at, 0, -1) if text[at - n : at] in words]


def test_no_words():
    assert SuffixAutomaton([]).ending == [[]]
