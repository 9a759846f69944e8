import hashlib
import itertools
import random

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from corvine.llm import bpe_automaton as bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, ids_sha256 long, word string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def plain(library, rows):
    out = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=str)


def test_tables(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, bpe.op12_bpe(spark, sf).collect()), key=str) == plain(library, docs)


def test_edge_cases(spark, library):
    texts = [None, "", " ", "\n\n", "a<|endoftext|> b<|endoftext|>", "x" * 50_000, " " * 3000, "Ünï ﬁ 漢字 😀", "it's 'twas we'll'd", "same", "same"]
    rows = [(i if i % 4 else None, t, "n", 1, "w") for i, t in enumerate(texts)]
    got = bpe.codes(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(library, rows)
    assert bpe.codes(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_random_texts(library, codec):
    r = random.Random(3)
    signs = " '\n\t\r\x0b\x1c\x85\xa0  aastreveldmST1²½Ⅷ!?-_ñé’中文字😀​﻿٣àا́"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(r.choice("ehrstinoa") for _ in range(r.randint(1, 40))) for _ in range(2000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x3000), r.randrange(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(500)]
    texts += [c * k for c in ("a", "ab", " ", "-") for k in range(80)]
    got = list(codec.encode(texts))
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [codec.decode(g) for g in got] == [library.decode(g, skip_special_tokens=False) for g in got]


def test_decoding_replaces_what_is_no_text(library, codec):
    r = random.Random(4)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(8)]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def merged(word, merges):
    """Byte-pair encoding by its definition: each merge in turn, from the left, everywhere."""
    for a, b, ab in merges:
        out = []
        for t in word:
            if out and out[-1] == a and t == b:
                out[-1] = ab
            else:
                out.append(t)
        word = out
    return word


@pytest.mark.parametrize("seed", range(30))
def test_paths_are_the_encodings(seed):
    r = random.Random(seed)
    labels, merges = [b"a", b"b", b"c"], []
    while len(merges) < 12:
        a, b = r.randrange(len(labels)), r.randrange(len(labels))
        if labels[a] + labels[b] not in labels:
            labels.append(labels[a] + labels[b])
            merges.append((a, b, len(labels) - 1))
    m = bpe.Automaton(labels, merges)
    for n in range(8):
        for w in itertools.product(b"abc", repeat=n):
            assert m.encode(bytes(w)) == merged([x - 97 for x in w], merges), bytes(w)
    # an arc leads on exactly where the two tokens stay apart
    live = [t for t in range(len(labels)) if merged([x - 97 for x in labels[t]], merges) == [t]]
    assert live == [t for t in range(len(labels)) if m.live(t)]
    for s, t in itertools.product(live, repeat=2):
        assert m.has_arc(s + 1, t) == (merged([x - 97 for x in labels[s] + labels[t]], merges) == [s, t])


def test_words_are_those_of_the_pattern(codec):
    r = random.Random(5)
    texts = ["".join(r.choice(" '\nasterv1.é½ ") for _ in range(r.randint(1, 30))) for _ in range(3000)]
    for t in texts:
        whole = t + "\n"
        import numpy as np

        starts = bpe.word_starts(np.frombuffer(whole.encode("utf-32-le"), "<u4"), np.array([len(t)])).tolist()
        assert [t[a:b] for a, b in zip(starts, [*starts[1:], len(t)], strict=True)] == regex.findall(public_tokenizers.PATTERN, t)


def test_few_words_held(codec):
    words = bpe.Words(codec.automaton, most=3)
    for w in ["a", " the", "xyz", "hello", "a", " the", "again"] * 3:
        assert words[w] == tuple(codec.automaton.encode(w.encode()))
    assert len(words) <= 3 and len(words.old) <= 3
