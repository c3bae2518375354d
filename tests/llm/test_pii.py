"""Personal data in number-like runs of any length."""

import numpy as np
import pytest

from provena.llm import pii


@pytest.mark.parametrize("n", [3, 4, 200])
def test_every_card_of_a_list_is_found(n):
    rng = np.random.default_rng(n)
    cards = []
    for _ in range(n):
        d = "4" + "".join(str(x) for x in rng.integers(0, 10, 14))
        d += next(str(c) for c in range(10) if pii.luhn(d + str(c)))
        cards.append(" ".join(d[i : i + 4] for i in range(0, 16, 4)))
    text = "cards " + " ".join(cards) + " end"
    w, follow = np.full((len(pii.KINDS), len(pii.FEATURES)), 0.0), np.zeros((len(pii.LABELS),) * 2)
    w[:, 0] = -9
    w[pii.KINDS.index("card"), [pii.INDEX["check digit"], pii.INDEX["digits16"]]] = 6
    base = pii.base_spans(text)
    found = [x for s, e in pii.islands(text, base) for x in pii.added(text, s, e, w, follow, {})]
    assert base == [] and [text[s:e] for s, e, _ in found] == cards


def test_a_base_span_in_a_long_run_hides_nothing_beside_it():
    text = "4111 1111 1111 1111 5500 0000 0000 0004 3400 0000 0000 0090 / +1 (222) 333-4444"
    base = pii.base_spans(text)
    assert [k for *_, k in base] == ["phone"] and [text[s:e] for s, e in pii.islands(text, base)] == [text[:59]]
