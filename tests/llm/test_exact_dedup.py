import hashlib

import numpy as np

from corvine.llm import exact_dedup as E
from corvine.session import table


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(str, out))


def test_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    rows += [(10_000, None), (10_001, ""), (None, "x"), (10_002, "x"), (10_002, "x"), (10_003, "long " * 100_000), (10_004, "long " * 100_000), (None, "alone")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = E.exact_dedup(docs, per_block=20).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got) == brute(rows)
    assert E.exact_dedup(docs.limit(0)).collect() == []


def slowly(x, block_bits, r):
    """The slots of a filter by inserting one sorted key after the other."""
    n = 64 - block_bits - r
    out = {}
    last = -1
    for k, c in sorted(x.items()):
        at = max(last + 1, (k >> r) & (2**n - 1))
        out[at] = (k & (2**r - 1), False)
        c -= 1
        while c:
            at += 1
            out[at] = (c & (2**r - 1), True)
            c >>= r
        last = at
    return out


def test_slots_are_those_of_plain_insertion():
    rng = np.random.default_rng(1)
    x = np.sort(np.concatenate([rng.integers(0, 2**16, 700), rng.integers(0, 40, 300)])).astype(np.uint64)
    values, counts = np.unique(x, return_counts=True)
    counts[3] = 70_000  # more than one digit
    f = E.QuotientFilter.of(values, counts.astype(np.int64), 18)
    want = slowly(dict(zip(values.tolist(), counts.tolist())), 64 - 18, f.remainder_bits)
    assert {k: (int(f.slots[k]), bool(f.counters[k])) for k in want} == want
    assert f.slots[[k for k in range(len(f.slots)) if k not in want]].sum() == 0
    again = E.QuotientFilter.unpacked(f.packed())
    keys, got = again.items()
    assert keys.tolist() == values.tolist() and got.tolist() == counts.tolist()
    assert f.occupied.sum() == f.run_ends.sum() == len({k >> f.remainder_bits for k in values.tolist()})


def test_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 500, dtype=np.uint64)
    x = np.concatenate([x, x[:100], x[:10], np.repeat(x[:1], 900), np.array([0, 2**64 - 1, 0], np.uint64)])
    blocks = {}
    for part in np.array_split(rng.permutation(x), 7):
        for b, f in E.filters_of(part, 5):
            blocks.setdefault(b, []).append(E.QuotientFilter.unpacked(f.packed()))
    got = {}
    for b, filters in blocks.items():
        for k, c in zip(*E.QuotientFilter.merged(filters).items(), strict=True):
            got[(b << 59) | int(k)] = int(c)
    values, counts = np.unique(x, return_counts=True)
    assert got == dict(zip(values.tolist(), counts.tolist(), strict=True))
