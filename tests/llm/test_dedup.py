from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from galena.llm import exact_dedup, near_dedup
from galena.llm.common import shared_dir


def expected_copies(rows):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            continue
        if t in first:
            out.append((i, first[t]))
        else:
            first[t] = i
    return sorted(out, key=str)


def test_copies_with_nulls_ties_empty_and_long_texts(spark, docs):
    long = "x y " * 200_000
    rows = [(5, "a"), (3, "a"), (3, "a"), (None, "a"), (7, ""), (8, ""), (9, None), (10, None), (11, long), (2, long), (12, long[:-1]), (13, "A"), (14, "a ")]
    got = [tuple(r) for r in exact_dedup.copies(docs(rows)).collect()]
    assert sorted(got, key=str) == expected_copies(rows)
    kept = exact_dedup.keep_first(docs(rows).withColumn("content_hash", F.lit(1)).withColumn("kept_id", F.lit("x")))
    assert kept.columns[-2:] == ["content_hash", "kept_id"]
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [2, 3, 7, 9, 10, 12, 13, 14]


def test_recursion_into_spill_files(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), f"text {rng.integers(0, 700)} " * 5) for i in range(3000)]
    key = [hash(t) for _, t in rows]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows[k : k + 100]], "text": [r[1] for r in rows[k : k + 100]], "h": pa.array(key[k : k + 100], pa.int64())}) for k in range(0, 3000, 100)]
    found = []

    def decide(batch, kept, copied, firsts):
        found.extend(zip([batch.column("doc_id")[r].as_py() for r in copied], firsts, strict=True))
        yield batch.slice(0, len(kept))

    # a table holds a few texts only: several levels of spill files
    kept = sum(b.num_rows for b in exact_dedup.grace(iter(batches), decide, "text", "h", "doc_id", 400, shared_dir(spark)))
    assert sorted(found) == sorted(expected_copies(rows))
    assert kept == len({t for _, t in rows})


def test_equal_hashes_compare_complete_contents():
    table = exact_dedup.ContentTable()
    for k, c in enumerate([b"one", b"two", b"three"]):
        slot, e = table.place(42, c)
        assert e == -1
        table.add(slot, 42, c, k)
    assert [table.tags[table.place(42, c)[1]] for c in (b"three", b"one", b"two")] == [2, 0, 1]


def test_no_documents(spark, docs):
    assert exact_dedup.copies(docs([])).count() == 0
    assert exact_dedup.keep_first(docs([])).count() == 0
    assert near_dedup.groups(docs([])).count() == 0
    assert near_dedup.keep_one(docs([])).columns == docs([]).columns


def test_near_pairs_are_those_of_brute_force(spark, docs, prose, monkeypatch):
    rows = []
    for k in range(60):
        base = prose.text(prose.rng.randint(20, 120))
        rows += [(10 * k + i, prose.edited(base, i)) for i in range(4)]
    points = near_dedup.fingerprints(docs(rows)).withColumnRenamed("doc_id", "point")
    bits, some = near_dedup.simhash([t for _, t in rows])
    assert some.all()
    apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2)
    want = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if apart[i, j] <= near_dedup.TAU}
    assert len(want) > 60
    above = {i: i for i, _ in rows}
    for a, b in sorted(want):
        x, y = (next(k for k in above if above[k] == above[c]) for c in (a, b))
        low, high = sorted((above[x], above[y]))
        above = {k: low if v == high else v for k, v in above.items()}
    degree = Counter(x for pair in want for x in pair)
    for group, deep in ((1 << 21, 1 << 16), (20, 2), (4, 1 << 16)):  # whole groups, and such as are split by two and three segments
        monkeypatch.setattr(near_dedup, "GROUP_POINTS", group)
        monkeypatch.setattr(near_dedup, "DEEP_POINTS", deep)
        got = near_dedup.links(points).collect()
        links = Counter()
        for r in got:
            if r.src == r.dst:
                links[r.src] += r.n_links
        assert links == degree
        roots = {r.node: r.root for r in near_dedup.components(spark.createDataFrame([(r.src, r.dst) for r in got if r.src != r.dst], "src bigint, dst bigint")).collect()}
        assert {k: roots.get(k, k) for k in above} == above


def test_pairs_of_a_group_are_those_of_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (40, 2), np.uint64)
    bits = np.repeat(base, 8, axis=0)
    for row in range(len(bits)):
        for k in rng.integers(0, 128, rng.integers(0, 9)):
            bits[row, k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    hi, lo = bits[:, 0].copy(), bits[:, 1].copy()
    apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2)
    want = {(i, j) for i in range(len(bits)) for j in range(i) if apart[i, j] <= near_dedup.TAU}
    for segments in (1, 2, 3):
        found, first = set(), []
        for start in range(near_dedup.BOXES):
            a, _ = near_dedup.turned(hi, lo, start)
            for key in np.unique(a >> np.uint64(56)):
                mine = np.flatnonzero(a >> np.uint64(56) == key)
                for i, j, d in near_dedup.near_in_group(hi[mine], lo[mine], start, segments):
                    pairs = [(max(x, y), min(x, y)) for x, y in zip(mine[i].tolist(), mine[j].tolist(), strict=True)]
                    assert [apart[p] for p in pairs] == d.tolist()
                    found.update(pairs)
                    once = near_dedup.is_first(hi[mine[i]] ^ hi[mine[j]], lo[mine[i]] ^ lo[mine[j]], start)
                    first += [p for p, o in zip(pairs, once, strict=True) if o]
        assert found == want and len(first) == len(want) == len(set(first))


def test_groups_take_their_lowest_id(spark, docs, prose):
    base, other = prose.text(150), prose.text(150)
    rows = [(9, base), (4, prose.edited(base, 1)), (6, base), (20, other), (21, None), (22, ""), (23, None), (24, ""), (25, "..."), (None, base)]
    rows += [(100 + k, base) for k in range(50)]
    frame = docs(rows).withColumn("kept_id", F.lit(0)).withColumn("point", F.lit(0)).withColumn("hi", F.lit("x"))
    found = near_dedup.groups(frame)
    assert {r.n_links for r in found.collect()} == {1}
    got = {(r.doc_id, r.kept_id) for r in found.collect()}
    assert got == {(9, 4), (6, 4), *((100 + k, 4) for k in range(50))}
    kept = near_dedup.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 4, 20, 21, 22, 23, 24, 25]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "src bigint, dst bigint")
    got = {r.node: r.root for r in near_dedup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
