"""Tiles of a vector search are scored where they stand in their batch."""

import numpy as np
import pyarrow as pa

from tidemark.operators import search


class Batch:
    """A batch that isn't turned into Python objects as a whole."""

    def __init__(self, batch):
        self._batch, self.num_rows = batch, batch.num_rows

    def column(self, name):
        return self._batch.column(name)


def test_tiles_read_in_place():
    ids, cells = np.arange(3, dtype="<i8"), np.eye(3, dtype="<f8")
    row = [pa.array([3, 3], pa.int32()), *(pa.array([x.tobytes()] * 2) for x in (ids[:1], cells[:1], ids, cells))]
    batch = pa.record_batch(row, names=["dim", "query_ids", "query_cells", "ids", "cells"])
    found = [b.to_pydict() for b in search._tiles("dot", 2, 6)([Batch(batch)])]
    assert found == [{"query_id": [0, 0], "id": [0, 1], "score": [1.0, 0.0]}] * 2
