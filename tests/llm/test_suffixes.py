import numpy as np

from playseq.llm.fm_index import FMIndex
from playseq.llm.suffixes import permuted_common_prefixes, rank_doubling, suffix_array


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 70)), 0).astype(np.uint16)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        order = suffix_array(s)
        assert order.tolist() == want and rank_doubling(s.astype(np.int64)).tolist() == want
        before, common = permuted_common_prefixes(s, order)
        for i, j in zip(want[1:], want[:-1], strict=True):
            same = 0
            while max(i, j) + same < len(s) and s[i + same] == s[j + same]:
                same += 1
            assert before[i] == j and common[i] == same


def test_long_runs_of_one_symbol():
    s = np.append(np.full(5000, 3), 0).astype(np.uint16)
    assert suffix_array(s).tolist() == list(range(5000, -1, -1))


def test_backward_search_finds_every_occurrence():
    rng = np.random.default_rng(1)
    for _ in range(40):
        text = rng.integers(1, 6, rng.integers(1, 200))
        index = FMIndex(text, step=5)
        lengths = rng.integers(1, 5, 20)
        phrases = np.zeros((20, 4), np.int64)
        for k, n in enumerate(lengths):
            phrases[k, :n] = rng.integers(1, 9, n)
        low, high = index.count(phrases, lengths)
        for k, n in enumerate(lengths):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrases[k, :n]).all()]
            rows = np.arange(low[k], max(high[k], low[k]))
            assert sorted(index.locate(rows).tolist()) == want
