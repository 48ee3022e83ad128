"""A pass multiplies few zeros: its blocks do not widen with the features of many rows."""

import numpy as np
import pyarrow as pa

from palaver.operators import linear as ln


def batch(n, per_row):
    rows = [{"idx": list(range(k * per_row, (k + 1) * per_row)), "val": [float(k + j) for j in range(per_row)], "y": float(k % 2),
             "weight": 1.0 + k, "fold": k % 3, "picked": [k % 2 == 0, k % 5 != 0]} for k in range(n)]
    return pa.RecordBatch.from_pylist(rows)


def test_blocks_hold_all_values_and_few_zeros():
    n, per_row = 500, 20
    read, whole, cells = ln.Rows.of(batch(n, per_row)), np.zeros((n, n * per_row + 1)), 0
    for some, used, x in read.blocks(n * per_row):
        whole[some, used] += x
        cells += x.size
    assert cells <= 40 * n * per_row  # blocks of 512 rows would hold 500 times the stored values
    assert (whole[:, -1] == 1).all() and (np.count_nonzero(whole[:, :-1], 1) >= per_row - 1).all()
    assert np.array_equal(whole[7, 140:160], np.arange(7, 27)) and whole[7, :-1].sum() == np.arange(7, 27).sum()


def test_slices_empty_rows_and_weights():
    some = batch(70, 3).slice(33)
    read = ln.Rows.of(some)
    assert len(read.y) == 37 and read.idx[0] == 99 and read.picked.shape == (37, 2)
    models = ln.Boundaries(np.zeros((4, 4)), np.array([-1, -1, 0, 2]), np.array([-1, 0, 1, -1]))
    got = read.weights(slice(2, 4), models)  # rows 35 and 36: folds 2 and 0
    assert got.tolist() == [[36.0, 0.0, 0.0, 0.0], [37.0, 37.0, 0.0, 37.0]]
    bare = pa.RecordBatch.from_pylist([{"idx": [], "val": [], "y": 1.0, "weight": 1.0, "fold": 0, "picked": []}], some.schema)
    (_, used, x), = ln.Rows.of(bare).blocks(9)
    assert used.tolist() == [9] and x.tolist() == [[1.0]]
