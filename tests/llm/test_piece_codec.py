import random

import numpy as np
import public_tokenizers
import sentencepiece

from corvine.llm import piece_codec as C
from corvine.session import table

PATH = public_tokenizers.path("piece_bpe_32k.model")


def odd():
    rng = random.Random(1)
    return ["", " ", "  a  b\n\tc  ", "é 　ﬁ x​", "▁▁ a▁b  ▁", "<s> </s> <0x41>", "a" * 5000, " " * 300, "x" * 200 + " " + "日本" * 300, "\x00\x01🤗", *("".join(rng.choices("abé日 \n🤗ñ▁0thein", k=300)) for _ in range(40))]


def test_equals_the_library(spark, sf):
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), C.Codec(PATH)
    texts = odd() + [r.text for r in table(spark, sf, "documents").collect()]
    for t, a, b in zip(texts, codec.encode(texts), sp.encode(texts), strict=True):
        assert a.tolist() == b, t[:80]
        assert codec.decode(a) == sp.decode(b)
    assert codec.encode([]) == []


def test_suffix_array_and_ranges():
    rng = random.Random(2)
    s = "".join(rng.choices("ab", k=300))
    codes = np.array([ord(c) for c in s], np.int64)
    order = C.suffix_array(codes, 8)
    heads = [s[i : i + 8] for i in order]
    assert heads == sorted(heads)
    pieces = ["a", "ab", "bba", "abababab", "c", "bc"]
    m = np.full((len(pieces), 8), -1, np.int64)
    for k, p in enumerate(pieces):
        m[k, : len(p)] = [ord(c) for c in p]
    lo, hi = C.occurrence_ranges(codes, order, m, np.array([len(p) for p in pieces]))
    for p, a, b in zip(pieces, lo, hi, strict=True):
        assert sorted(order[a:b].tolist()) == [i for i in range(len(s)) if s.startswith(p, i)]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (2, None), (None, "x"), (3, "a▁b"), (4, "word " * 60_000)], "doc_id long, text string")
    rows = C.encode_documents(docs, PATH, 1000).collect()
    assert len(rows) == 6 and [r.round_trip for r in sorted(rows, key=lambda r: r.doc_id or 0)] == [True, True, True, True, False, True]
    assert C.encode_documents(docs.limit(0), PATH).collect() == []


def test_long_units_in_windows(monkeypatch):
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), C.Codec(PATH)
    rng = random.Random(3)
    texts = ["".join(rng.choices("theinandé🤗", k=k)) for k in (65, 99, 100, 101, 400)] + ["a" * 250, " " * 170]
    monkeypatch.setattr(C, "WINDOW", 50)
    assert [x.tolist() for x in codec.encode(texts)] == sp.encode(texts)


def test_a_very_long_text_without_spaces():
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), C.Codec(PATH)
    text = "".join(random.Random(4).choices("theinandsometimes", k=1_200_000))
    assert codec.encode([text])[0].tolist() == sp.encode(text)


def merged(text, rank):
    s = list(text)
    while True:
        best = min(((rank[s[k] + s[k + 1]], k) for k in range(len(s) - 1) if s[k] + s[k + 1] in rank), default=None)
        if best is None:
            return s
        s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]


def test_pairs_that_stay_apart():
    codec = C.Codec(PATH)
    rank = {codec.texts[i]: int(codec.rank[i]) for i in codec.ids.tolist()}
    rng = np.random.default_rng(5)
    spaces = [i for i in codec.ids.tolist() if set(codec.texts[i]) == {C.SPACE}]
    a = np.concatenate([rng.choice(codec.ids, 3000), np.repeat(spaces, len(spaces))])
    b = np.concatenate([rng.choice(codec.ids, 3000), np.tile(spaces, len(spaces))])
    for x, y, apart in zip(a.tolist(), b.tolist(), codec.stay_apart(a, b).tolist(), strict=True):
        p, q = codec.texts[x], codec.texts[y]
        assert apart == (merged(p + q, rank) == [p, q])
