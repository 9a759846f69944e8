"""Byte-pair encoding by a tokenization automaton: merges compiled one after the other, words encoded by its transitions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import lean, slices, small_batches
from corvine.session import table

CODES = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
START, NONE, NEVER = 0, -1, 1 << 60


class Automaton:
    """The deterministic automaton whose arcs are tokens and whose paths are exactly the encodings that merges lead to.

    It begins as one state with an arc to itself for every byte, copied for each byte so that all arcs with one label
    lead to a state of their own. Merge number m of a and b puts a gadget where arc a is followed by arc b: the state
    behind a loses its arc b, and a new arc ab, beside every arc a, leads to a copy of the state behind b as it is then.
    So a state is what may follow a token, and n merges make n states and n removals. A copy keeps a
    reference to its origin with the number of the merge that made it, and holds only what it lost itself, with
    the numbers. Whether a state has an arc is read from these tables along the left parts of the token, which
    were arcs before it, and along the origins of the state; transitions found are kept in a table.
    """

    def __init__(self, labels: list[bytes], merges: Iterable[tuple[int, int, int]]):
        """labels: the bytes of each token; merges: (a, b, ab) in order of rank. State t + 1 is that behind token t."""
        self.labels = labels
        self.left, self.made = [-1] * len(labels), [-1] * len(labels)
        self.origin, self.born = [-1] * (len(labels) + 1), [-1] * (len(labels) + 1)
        self.removed: dict[int, int] = {}
        self.table: dict[int, int] = {}
        for m, (a, b, ab) in enumerate(merges):
            if self.made[ab] >= 0:
                raise ValueError("two merges make one token")
            if not (self.live(a) and self.live(b) and self.has_arc(a + 1, b)):
                continue  # earlier merges leave no place where b follows a
            self.left[ab], self.made[ab] = a, m
            self.origin[ab + 1], self.born[ab + 1] = b + 1, m
            self.removed[(a + 1) << 24 | b] = m
        self.longest = max(map(len, labels))
        self.trie: dict[int, dict | int] = {}  # labels by their bytes; the token that ends in a node is under -1
        for t, label in enumerate(labels):
            if label and self.live(t):
                node = self.trie
                for byte in label:
                    node = node.setdefault(byte, {})
                node[-1] = t

    def live(self, token: int) -> bool:
        return self.made[token] >= 0 or len(self.labels[token]) == 1

    def has_arc(self, q: int, token: int) -> bool:
        removed, origin, born = self.removed, self.origin, self.born
        until = NEVER
        while True:
            state, limit = q, NEVER
            while state != -1:  # in the state, or in what it was copied from before the copy was made
                gone = removed.get(state << 24 | token)
                if gone is not None and gone <= until and gone < limit:
                    return False
                limit, state = min(limit, born[state]), origin[state]
            if self.left[token] < 0:
                return True
            until, token = self.made[token], self.left[token]

    def encode(self, word: bytes) -> list[int]:
        """The tokens of a word: of all paths that spell it, the automaton has one.

        From each place the trie offers labels, and the longest whose arc the state has is taken; where none leads on,
        the way goes back by one arc and the place is never entered again, as only one path leads to it. The
        work is the length of the word times that of the longest label at most.
        """
        table, labels, trie, longest = self.table, self.labels, self.trie, self.longest
        n, i, q = len(word), 0, START
        path: list[int] = []
        left: list[list[int]] = []  # labels not yet tried at each place of the path
        dead: set[int] = set()
        offered = None
        while i < n:
            if offered is None:
                offered, node = [], trie
                for byte in word[i : i + longest]:
                    node = node.get(byte)
                    if node is None:
                        break
                    if -1 in node:
                        offered.append(node[-1])
            while offered:
                token = offered.pop()
                to = table.get(q << 24 | token)
                if to is None:
                    to = table[q << 24 | token] = token + 1 if self.has_arc(q, token) else NONE
                if to != NONE and not (dead and i + len(labels[token]) in dead):
                    path.append(token)
                    left.append(offered)
                    i, q, offered = i + len(labels[token]), to, None
                    break
            else:
                if not path:
                    raise ValueError("no path: a byte has no token")
                dead.add(i)
                offered = left.pop()
                i -= len(labels[path.pop()])
                q = path[-1] + 1 if path else START
        if len(table) > 1_000_000:
            table.clear()
        return path

    def decode(self, tokens: Iterable[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, tokens))


#: Classes of characters: what words are made of. Letters, numbers, white space, all else, and the end of a text.
OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: Endings that a word of their own begins with, as in public_tokenizers.PATTERN.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, points):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a < len(m[0]):
                out[a : b + 1] = kind
            else:  # a run across the surrogates
                out[[ord(c) for c in m[0]]] = kind
    return out


def word_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words begin in texts one behind the other, each with an end mark (at the indices `ends`).

    As public_tokenizers.PATTERN splits: runs of one class, with one space before them; of a run of white space before
    a word all but the last character, and that too if it isn't a space; endings behind an apostrophe that begins a word.
    """
    kind = classes()[codes]
    kind[ends] = END
    before = np.concatenate([[END], kind[:-1]]).astype(np.uint8)
    after = np.append(kind[1:], END).astype(np.uint8)
    blank = codes == 32
    blank_before = np.concatenate([[False], blank[:-1]]) & (before == SPACE)
    start = np.where(kind == SPACE, (before != SPACE) | ((after != SPACE) & (after != END)), (before != kind) & ~blank_before)
    start[ends] = False
    marks = np.flatnonzero(start & (codes == 39))
    for ending in CONTRACTIONS:
        fits = marks[marks + len(ending) < len(codes)]
        for k, c in enumerate(ending, 1):
            fits = fits[codes[fits + k] == ord(c)]
        start[fits + 1] = False
        start[fits + 1 + len(ending)] = True
    start[ends] = False
    return np.flatnonzero(start)


class Words(dict):
    """word -> ids, for the words met last: when `most` are held, they become the older half and the older ones go."""

    def __init__(self, automaton: Automaton, most: int = 200_000, longest: int = 64):
        super().__init__()
        self.automaton, self.most, self.longest, self.old = automaton, most, longest, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = tuple(self.automaton.encode(word.encode()))
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Ids of a byte-level BPE file of the tokenizers library, special tokens in texts included, and their bytes."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # printable stand-ins of bytes, in code point order: printable bytes stand for themselves, the others follow
        signs = sorted(ByteLevel.alphabet())
        own = [b for b in range(256) if chr(b) in set(signs)]
        byte_of = {chr(b): b for b in own} | dict(zip((c for c in signs if ord(c) > 255), (b for b in range(256) if b not in own), strict=True))
        vocabulary = spec["model"]["vocab"]
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        labels = [b""] * (1 + max(chain(vocabulary.values(), self.added.values())))
        for piece, i in vocabulary.items():
            labels[i] = bytes(map(byte_of.__getitem__, piece)) if piece not in self.added else piece.encode()
        for piece, i in self.added.items():
            labels[i] = piece.encode()
        merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        self.automaton = Automaton(labels, merges)
        self.words = Words(self.automaton)

    def segments(self, text: str) -> tuple[list[str], list[int]]:
        """The text between special tokens, and these, leftmost first and the longest of those at one place."""
        parts, special = [text], []
        if self.added and any(a in text for a in self.added):
            import re

            found = re.split("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")", text)
            parts, special = found[::2], [self.added[a] for a in found[1::2]]
        return parts, special

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text. Words of all of them are found together."""
        split = [self.segments(t) for t in texts]
        parts = [p for ps, _ in split for p in ps]
        if not parts:
            return
        whole = "\n".join(parts) + "\n"
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = word_starts(np.frombuffer(whole.encode("utf-32-le"), "<u4"), ends)
        bounds = np.searchsorted(starts, np.append(0, ends + 1))
        stops = np.append(starts[1:], len(whole))
        last = bounds[1:][np.diff(bounds) > 0] - 1
        stops[last] = ends[np.diff(bounds) > 0]
        cut = [whole[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        ids = list(map(self.words.__getitem__, cut))
        of = (list(chain.from_iterable(ids[a:b])) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False))
        for ps, special in split:
            out = next(of)
            for token in special:
                out.append(token)
                out.extend(next(of))
            yield out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the labels of their arcs, as UTF-8, with U+FFFD for what isn't."""
        return self.automaton.decode(ids).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """Compiled once in each Python worker."""
    return Codec(path)


def codes(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (of decimal ids, joined by commas) and decoded_sha256.

    Ids are those of Tokenizer.from_file(tokenizer).encode(text, add_special_tokens=False), and the decoded text is that
    of decode(ids, skip_special_tokens=False). Null texts count as empty: no tokens, the hash of the empty text; a null
    doc_id is carried along; repeated rows give repeated rows; texts of any length are encoded whole, in time
    linear in their length; columns beside doc_id and text are not read; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = names = None
        for b in batches:
            c = c or codec(tokenizer)
            names = names or list(map(str, range(len(c.automaton.labels))))
            texts = [t or "" for t in b.column(1).to_pylist()]
            out: list[list] = [[], [], []]
            for i, j in slices(texts, 1_000_000):
                for ids in c.encode(texts[i:j]):
                    out[0].append(len(ids))
                    out[1].append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    out[2].append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, f.type) for x, f in zip(out, list(schema)[1:], strict=True))], schema=schema)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), CODES)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
