"""Loading the language model holds it once, and finds the first of equal keys."""
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from varietylens.llm.langid import Table


def test_load_in_place(tmp_path):
    n, langs, files = 400_000, 4, []
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, (n, langs))
    for i, part in enumerate(np.array_split(np.arange(n), 4)):
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * langs, pa.int32()), pa.array(counts[part].ravel()))
        files.append(str(tmp_path / f"{i}.parquet"))
        pq.write_table(pa.table({"word": [f"w{j}" for j in part], "n": rows}), files[-1])
    table = Table(files, counts.sum(0).astype(float))
    tracemalloc.start()
    table.load()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.2 * (table.hashes.nbytes + table.logs.nbytes)
    at = table.at(["w0", "none of them", "w399999"])
    want = np.log(counts[[0, -1]] / table.totals + 0.5 / table.totals.max()).astype(np.float32)
    assert at[1] == -1 and np.array_equal(table.logs[at[[0, 2]]], want)
