"""What a worker holds between tasks."""

import numpy as np
import psutil

from bobbin.llm.common import give_back


def test_freed_memory_goes_back_to_the_system():
    held = [np.ones(4096) for _ in range(10_000)]
    last = held[-1]
    held = last[:1]
    before = psutil.Process().memory_info().rss
    give_back()
    assert last.sum() == 4096 and len(held) == 1
    assert psutil.Process().memory_info().rss < before - 150_000_000
