import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corvine.llm import packing as P
from corvine.session import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_library():
    e = P.Encoder(PATH)
    rng = random.Random(1)
    odd = ["", "<|endoftext|> a", " \n\n  x", "日本語 é ﬁ　x  y", "a" * 5000, " " * 3000, "\x00\x01🤗 can't WE'LL", "\u0085 ١٢٣ ²", *("".join(rng.choices("abé日 \n🤗ñ▁0'\t\r", k=200)) for _ in range(50))]
    for t in odd:
        assert e(t).tolist() == e.slow.encode(t, add_special_tokens=False).ids


def test_documents_are_packed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame([(9999, None), (None, "x y z"), (3, "again")], "doc_id long, text string"))
    rows = P.pack_documents(docs, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for d in docs.collect():
        ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d.doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(P.cuts(len(ids), 2048))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048
    assert len(used) <= 1.02 * sum(used.values()) / 2048 + 2
    assert P.pack_documents(docs.limit(0), PATH).collect() == []


def test_cuts():
    assert P.cuts(2048, 2048) == [(0, 2048)]
    assert P.cuts(2049, 2048) == [(0, 1), (1, 2048)]
    assert P.cuts(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    for _ in range(30):
        capacity = rng.choice([12, 100, 2048])
        counts = {}
        for _ in range(rng.randrange(1, 400)):
            x = rng.randrange(1, capacity + 1)
            counts[x] = counts.get(x, 0) + rng.choice([1, 1, 3])
        seen, used = {}, {}
        for x, rank, n, s, o in P.plan(counts, capacity):
            for k in range(n):
                assert seen.setdefault((x, rank + k), s + k) == s + k
                used.setdefault(s + k, []).append((o, x))
        assert len(seen) == sum(counts.values())
        for v in used.values():
            at = 0
            for o, x in sorted(v):
                assert o == at
                at += x
            assert at <= capacity and sum(3 * x > capacity for _, x in v) <= 2


def test_about_as_few_sequences_as_a_plain_best_fit():
    rng = random.Random(6)
    for _ in range(12):
        capacity = 512
        sizes = [min(capacity, 1 + int(rng.expovariate(1 / rng.choice([40, 120, 260])))) for _ in range(900)]
        gaps: list[int] = []
        for x in sorted(sizes, reverse=True):
            fits = [g for g in gaps if g >= x]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - x)
            else:
                gaps.append(capacity - x)
        counts = {}
        for x in sizes:
            counts[x] = counts.get(x, 0) + 1
        ours = 1 + max(s + n - 1 for _, _, n, s, _ in P.plan(counts, capacity))
        assert ours <= 1.01 * len(gaps) + 1


def test_ids_of_more_documents(spark, sf):
    e = P.Encoder(PATH)
    texts = [r.text or "" for r in table(spark, sf.replace("0.001", "0.01"), "documents").select("text").collect()]
    for t, want in zip(texts, e.slow.encode_batch(texts, add_special_tokens=False), strict=True):
        assert e(t).tolist() == want.ids
