"""Bin completion against plain best fit and brute force; BPE of every code point against the library."""

import bisect
import collections
import functools
import random
import struct

import pytest

from vidmart.llm import packing
from vidmart.llm.bpe import WordBpe, word_bpe


def best_fit(lengths, capacity):
    rooms, bins = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        bins += i == len(rooms)
        bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - x)
    return bins


def fewest(lengths, capacity):
    @functools.cache
    def used(mask):  # (full sequences, filled of the open one) is the least over the piece put in last
        if not mask:
            return 0, capacity
        out = []
        for i, x in enumerate(lengths):
            if mask >> i & 1:
                bins, filled = used(mask & ~(1 << i))
                out.append((bins, filled + x) if filled + x <= capacity else (bins + 1, x))
        return min(out)
    return used((1 << len(lengths)) - 1)[0]


def checked(lengths, capacity, **about):
    plan, used = packing.plan_bins(dict(collections.Counter(lengths)), capacity, **about), collections.Counter()
    for pattern, times in plan:
        assert times > 0 and sum(x * n for x, n in pattern.items()) <= capacity
        for x, n in pattern.items():
            used[x] += n * times
    assert used == collections.Counter(lengths)
    return packing.sequences(plan)


def test_never_more_sequences_than_best_fit_decreasing():
    rng, fewer = random.Random(8), 0
    for _ in range(200):
        capacity = rng.choice([20, 50, 100, 512])
        top = rng.choice([capacity, capacity // 2])
        lengths = [rng.randint(1, top) for _ in range(rng.randint(0, 120))]
        got, plain = checked(lengths, capacity, branches=100), best_fit(lengths, capacity)
        counts = dict(collections.Counter(lengths))
        assert packing.sequences(packing.best_fit_decreasing(counts, capacity)) == plain
        assert packing.lower_bound(counts, capacity) <= got <= plain
        fewer += got < plain
    assert fewer  # the search does find better ones


def test_small_plans_are_the_best_there_are():
    rng = random.Random(9)
    for _ in range(150):
        lengths = [rng.randint(2, 14) for _ in range(rng.randint(1, 10))]
        assert checked(lengths, 20, branches=10 ** 6) == fewest(tuple(lengths), 20)


def test_ties_repeats_and_no_pieces():
    assert packing.plan_bins({}) == [] and packing.lower_bound({}) == 0
    assert checked([4096] * 7, 4096) == 7 and checked([2048] * 7, 4096) == 4 and checked([1] * 5000, 4096) == 2
    assert packing.plan_bins({3: 10 ** 9, 1: 10 ** 9}, 4) == [({3: 1, 1: 1}, 10 ** 9)]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("plane", [0, 1, 2, 14])
def test_every_code_point_has_the_librarys_ids(library, plane):
    bpe = word_bpe()
    points = [c for c in range(plane << 16, (plane + 1) << 16) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 500):
        text = "".join(f"a{chr(c)}B {chr(c)}̣'s " for c in points[lo:lo + 500])
        ids = bpe.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_special_tokens=False).ids


def test_a_pretoken_is_looked_up_once_for_all_words_that_hold_it():
    """Words of printable ASCII are made of pretokens that are words too; the ids are the library's."""
    bpe = WordBpe()
    model, seen = bpe.model, []

    class Counted:
        def tokenize(self, symbols):
            seen.append(symbols)
            return model.tokenize(symbols)

    bpe.model = Counted()
    for text in ("hereafter", "hereafter, (hereafter) hereafter's 'sere re's ''s !'ll x'd'd don't", "hereafter9 99 \x7f~ \x01a'b Ünder, ünder", "a'" * 60):
        assert list(memoryview(bpe.encode(text)).cast("I")) == bpe.tok.encode(text, add_special_tokens=False).ids
    assert seen.count("hereafter") == 1
