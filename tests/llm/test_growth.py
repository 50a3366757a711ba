"""Work and memory that must not grow with a group or a file."""

import glob
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tideway.llm import common, decontaminate, simhash


def test_pairs_that_sketches_exclude_never_become_rows():
    r = random.Random(5)
    base = [r.getrandbits(62) for _ in range(220)]
    sets = [np.unique(np.array([*base[:150], *r.sample(base[150:], 10), *(r.getrandbits(62) for _ in range(60))], np.int64)) for _ in range(40)]
    sets += [np.unique(np.array([*s[:-6].tolist(), *(r.getrandbits(62) for _ in range(r.randint(0, 14)))], np.int64)) for s in sets[:10]]
    n = len(sets)
    columns = [np.zeros(n, np.int64), np.arange(n), np.arange(n), np.array([len(s) for s in sets]), np.zeros(n, np.int64), np.full(n, -1)]
    batch = pa.record_batch([*map(pa.array, columns), pa.array([simhash.sketch(s, simhash.FOLDED) for s in sets], pa.binary())], names=["k", "root", "node", "n", "at", "lead", "f"])
    found = {(a, b) for out in simhash._crossing(80)(iter([batch])) for a, b in zip(*(out.column(i).to_pylist() for i in range(2)))}
    alike = lambda x, y: 100 * (m := len(np.intersect1d(x, y))) >= 80 * (len(x) + len(y) - m)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if alike(sets[a], sets[b])}
    assert len(want) >= 8 and want <= found and len(found) <= 3 * len(want)


def test_folded_sketches_lose_no_pair():
    r = random.Random(6)
    sets = []
    for size in (1, 2, 30, 33, 64, 500, 513, 700, 3000):
        own = [r.getrandbits(62) for _ in range(size)]
        sets += [np.unique(np.array(own, np.int64)), np.unique(np.array(own[: max(1, size * 9 // 10)] + [r.getrandbits(62)] * (size > 20), np.int64))]
    n, folded = np.array([len(s) for s in sets], np.int32), np.empty(len(sets), object)
    folded[:] = [simhash.sketch(s, simhash.FOLDED) for s in sets]
    x, y = np.triu_indices(len(sets), 1)
    kept = simhash._near(n, folded, x, y, 80)
    for a, b, k in zip(x, y, kept):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert k or 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both)
    assert max(map(len, folded)) == simhash.FOLDED // 8 and not kept.all()


def test_index_files_hold_few_blocks(spark):
    docs = spark.range(0, 6, 1, 1).selectExpr("id as doc_id", "repeat('some word ', 410000) as text")
    index = decontaminate.written_index(docs)
    sizes = [pq.read_metadata(f).num_rows for f in glob.glob(f"{index.written_path.removeprefix('file://')}/*.parquet")]
    assert sum(sizes) == 6 and max(sizes) <= decontaminate.FILE_BLOCKS
    assert common.written(spark.range(10), "r").count() == 10
