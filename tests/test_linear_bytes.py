"""What the passes of a fit send to the driver is bounded, however many rows there are."""

import inspect

from palaver.operators import linear as ln


def test_all_passes_together():
    passes = inspect.signature(ln.fit).parameters["passes"].default
    matrix = 10_009 * 30 * 8  # coefficients of 30 repeats over two vocabularies of 5,000
    assert passes * max(ln.DIRECT_BYTES, matrix) < 600e6
