"""What tasks of op1 hold at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessitura.llm import jaccard_join
from tessitura.llm.blocks import BATCH_BYTES, exchange, lean, small_batches


def test_a_bucket_a_task(spark):
    """Buckets that hash to one partition would meet in one task, where there is memory for one."""

    def count(batches):
        found = [b for batch in batches for b in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"n": [len(set(found))], "rows": [len(found)]})

    rows = spark.range(900).selectExpr("int(id % 300) bucket", "cast('x' as binary) payload")
    got = exchange(rows, 300, lean(count), "n long, rows long", direct=True).collect()
    assert [(r.n, r.rows) for r in got] == [(1, 3)] * 300


def test_op1_batches(spark, monkeypatch):
    """No batch that op1 sends to Python has over 4 MB and a row; the session's own setting is as before."""
    seen = spark.sparkContext.accumulator(0)
    most = []
    kept = jaccard_join.kept

    def spy(df, name):
        most.append(spark.conf.get(BATCH_BYTES))
        return kept(df, name)

    monkeypatch.setattr(jaccard_join, "kept", spy)
    before = spark.conf.get(BATCH_BYTES)
    docs = spark.createDataFrame([(i, f"a b c d {i % 3}") for i in range(9)], "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join.jaccard_components(docs).collect()} == {(i, 3, i % 3, 2) for i in range(9)}
    assert set(most) == {"4m"} and spark.conf.get(BATCH_BYTES) == before and before != "4m"

    def measure(batches):
        for batch in batches:
            seen.add(1)
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    wide = spark.range(0, 200, 1, 1).selectExpr("repeat('x', 100000) text")
    with small_batches(spark):
        sizes = [r.n for r in wide.mapInArrow(measure, "n long").collect()]
    assert seen.value == len(sizes) > 3 and max(sizes) < 5 << 20 and sum(sizes) > 200 * 100_000


def test_sets_are_sent_in_pieces(spark, monkeypatch):
    """A set that goes to many units is not gathered for all of them: the links are those of whole batches."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    docs = spark.createDataFrame([(i, " ".join([*base[:i], f"n{i}", *base[i + 1 :]])) for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "SMALL_BLOCK", 4)
    whole = sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()))
    monkeypatch.setattr(jaccard_join, "SENT_BYTES", 5000)
    assert whole == sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()))
    assert {r[2] for r in whole} == {0} and {r[3] for r in whole} == {59}


def test_groups_are_sent_in_pieces():
    """A prefix goes to as many units as its family has blocks; no batch is as large as all of them together."""
    n, blocks, rng = 600, 40, np.random.default_rng(4)
    prefixes = [rng.bytes(8 * int(k)) for k in rng.integers(1, 500, n - 1)] + [rng.bytes(800_000)]
    columns = {"gid": range(n), "part": [0] * n, "n": [9] * n, "members": [1] * n, "family": [-5] * n, "blocks": [blocks] * (n - 1) + [1], "prefix": prefixes}
    batch = pa.RecordBatch.from_pydict({c: list(v) for c, v in columns.items()})
    got = list(jaccard_join.place_groups(iter([batch.slice(0, 0), batch])))
    assert max(b.nbytes for b in got) < 1.1 * jaccard_join.SENT_BYTES < sum(b.nbytes for b in got) / 8
    rows = pa.Table.from_batches(got)
    own = jaccard_join.block_of(np.arange(n), np.zeros(n, np.int64), np.array(columns["blocks"])).tolist()
    wanted = [(g, *sorted((own[g], o)), int(own[g] > o), p) for g, p in enumerate(prefixes) for o in range(columns["blocks"][g])]
    assert sorted(zip(*(rows[c].to_pylist() for c in ("gid", "i", "j", "side", "prefix")), strict=True)) == sorted(wanted)
    assert set(rows["n"].to_pylist()) == {9} and set(rows["family"].to_pylist()) == {-5}


def test_overlaps_hold_one_side():
    """Counts of two blocks of sets, with less than six times the sets of a side held besides."""
    rng = np.random.default_rng(6)
    left, right = ([np.unique(rng.integers(0, 10**6, 5000).astype(np.uint64)) for _ in range(100)] for _ in range(2))
    tracemalloc.start()
    both = jaccard_join.count_overlaps(left, right)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * 8 * 100 * 5000
    wanted = [[len(np.intersect1d(x, y)) for y in right[:9]] for x in left[:9]]
    assert both[:9, :9].tolist() == wanted
    none = [np.zeros(0, np.uint64)] * 2
    assert jaccard_join.count_overlaps(none, right[:3]).tolist() == [[0] * 3] * 2 and jaccard_join.count_overlaps(left[:1], [left[0] + np.uint64(10**7)]).tolist() == [[0]]
