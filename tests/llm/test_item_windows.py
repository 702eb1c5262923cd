"""A passage of 100 bytes is found wherever it starts in the item."""

import random

import numpy as np

from plumbline.llm import decontaminate


def _words(draw, n):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 8))) for _ in range(n))


def test_passages_of_all_offsets():
    draw = random.Random(11)
    item, around = _words(draw, 80).encode(), _words(draw, 12).encode()
    plain = decontaminate.normal(item)
    index = decontaminate.index_items([7], [item])
    assert list(index.start) == list(range(len(plain) - 99))
    for length in (100, 115):
        starts = [s for s in range(len(plain) - length + 1) if b" " not in (plain[s : s + 1], plain[s + length - 1 : s + length])]
        texts = [around + b" " + plain[s : s + length] + b" " + around for s in starts]
        found = decontaminate.find_leaks(index, texts)
        assert {t for t, *_, e in found if e == 0} == set(range(len(starts)))
        many = np.bincount([t for t, *_, e in found if e == 0], minlength=len(starts))
        assert (many >= length - 99).all()
    changed = bytearray(plain[37:137])
    for at in (5, 20, 35, 50, 65, 80, 95):
        changed[at] = ord("z")
    assert {e for *_, e in decontaminate.find_leaks(index, [around + b" " + bytes(changed) + b" " + around])} == {7}
    changed[12] = ord("z")
    assert all(e > 0 for *_, e in decontaminate.find_leaks(index, [around + b" " + bytes(changed) + b" " + around]))


def test_items_shorter_than_a_window():
    draw = random.Random(12)
    items = [_words(draw, n).encode() for n in (6, 9, 12)]
    index = decontaminate.index_items([1, 2, 3], items)
    texts = [_words(draw, 8).encode() + b" " + t + b" " + _words(draw, 8).encode() for t in items]
    assert {(t, i) for t, i, *_ in decontaminate.find_leaks(index, texts)} == {(0, 0), (1, 1), (2, 2)}
