"""Bounded pieces of Arrow batches."""

from __future__ import annotations


def row_cuts(limit: int):
    """A function from the rows' list lengths to ranges of rows (first, end) of at most ``limit`` entries; a longer row stands alone.

    A batch of Spark has up to 10,000 rows and 64 MB, so that arrays worked out from its entries take memory by the
    lengths of the texts. It is a closure with local imports only, so that executors need no installed copy of this package.
    """

    def cut(lengths):
        import numpy as np

        ends = np.concatenate([[0], np.cumsum(lengths)])
        first = 0
        while first < len(lengths):
            end = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
            yield first, end
            first = end

    return cut
