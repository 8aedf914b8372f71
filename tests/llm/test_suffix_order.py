"""Induced suffix sorting against plain sorting, with queues in memory and in scratch files."""

import random

import numpy as np
import pytest

from panelweave.llm import induced


def common(a, b):
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("budget", [100, 1 << 20])
def test_order_and_prefixes(budget):
    rnd = random.Random(budget)
    for _ in range(300):
        k = rnd.randint(1, 4)
        symbols = []
        for _ in range(rnd.randint(1, 6)):
            symbols += [*rnd.choices(range(97, 97 + k), k=rnd.randint(0, 12)), induced.SEPARATOR]
        symbols.append(0)
        found = list(induced.sorted_suffixes(np.array(symbols, np.int16), budget))[::-1]
        order = [p for _, pos, _ in found for p in pos.tolist()]
        prefixes = [x for _, _, lcp in found for x in lcp.tolist()]
        assert sorted(order) == list(range(len(symbols)))
        for i in range(1, len(order)):
            a, b = symbols[order[i - 1] :], symbols[order[i] :]
            assert prefixes[i] == min(induced.DEPTH, common(a, b)) and a[: induced.DEPTH] <= b[: induced.DEPTH]
    assert induced.Queue.held == 0
