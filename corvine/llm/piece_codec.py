"""SentencePiece encoding and decoding: pieces found through a suffix array of the batch, edges relaxed by position."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import lean, slices, small_batches
from corvine.session import table

SPACE = "▁"
#: Ends a unit in the indexed text; no piece holds it.
END = 0x110000
#: Units with more symbols are relaxed one by one, shorter ones all together.
LONG = 64
#: Symbols of a long unit that are indexed at once; windows overlap by the longest piece.
WINDOW = 500_000
#: Places in the memory of pairs.
PAIRS = 2**20
#: Distinct units whose ids are remembered from one slice to the next; beyond, all are forgotten and found anew.
REMEMBERED = 200_000


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of codes, sorted by their next `depth` codes at least, by prefix doubling."""
    n = len(codes)
    padded = np.append(codes + 1, [0, 0])
    key, have = (padded[:n] << 42) | (padded[1 : n + 1] << 21) | padded[2 : n + 2], 3
    while True:
        order = np.argsort(key)
        steps = np.diff(key[order], prepend=-1) != 0
        if have >= depth or steps.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(steps)
        key = rank * (n + 2)
        key[: max(0, n - have)] += rank[have:]
        have *= 2


def occurrence_ranges(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of pieces (codes, as many as lengths says) its range [lo, hi) in the suffix array.

    All pieces are searched together: for one code after the other, two binary searches narrow every range.
    """
    n = len(order)
    lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)
    padded = np.append(codes, np.full(pieces.shape[1] + 1, -1, codes.dtype))
    for d in range(pieces.shape[1]):
        who = np.flatnonzero((lengths > d) & (lo < hi))
        if not len(who):
            break
        want, a, b = pieces[who, d], lo[who], hi[who]
        found = []
        for right in (False, True):
            x, y = a.copy(), b.copy()
            while (open_ := x < y).any():
                mid = (x + y) >> 1
                have = padded[order[np.minimum(mid, n - 1)] + d]
                up = open_ & ((have <= want) if right else (have < want))
                x = np.where(up, mid + 1, x)
                y = np.where(open_ & ~up, mid, y)
            found.append(x)
        lo[who], hi[who] = found
    return lo, np.maximum(lo, hi)


class Codec:
    """Encodes and decodes like the model's own library.

    The model is of the BPE kind: its scores order merges, and ids are not those of a lattice relaxed by summed scores.
    But every prefix of a text has one encoding, of which only the last piece matters for what follows: an edge may go
    on from a prefix exactly when the prefix's last piece and the edge's stay two pieces under the model's merges
    (stable). So edges are relaxed from left to right by that rule, and one edge reaches every position.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {i: int(self.texts[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_ids = np.full(256, sp.unk_id(), np.int64)
        for i, b in self.bytes.items():
            self.byte_ids[b] = i
        silent = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.silent = silent
        self.ids = np.array([i for i in range(n) if i not in silent and i not in self.bytes], np.int64)
        self.lengths = np.array([len(self.texts[i]) for i in self.ids], np.int64)
        self.depth = int(self.lengths.max())
        self.codes = np.full((len(self.ids), self.depth), -1, np.int64)
        for k, i in enumerate(self.ids):
            self.codes[k, : self.lengths[k]] = [ord(c) for c in self.texts[i]]
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.unknown, self.start, self.base = n, n + 1, n + 2  # a character without a piece, and the begin of a unit
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)  # 0 is best, equal scores share one
        self.learn_splits()
        self.pair_keys, self.pair_values = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        # units may only be cut where no piece reaches across
        self.unit = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if not any(re.search(f"[^{SPACE}]{SPACE}", self.texts[i]) for i in self.ids) else re.compile(r"[\s\S]+")
        self.shown = [bytes([self.bytes[i]]) if i in self.bytes else b"" if i in silent else t.replace(SPACE, " ").encode() for i, t in enumerate(self.texts)]
        self.memory: dict[str, int] = {}
        self.stored, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def learn_splits(self) -> None:
        """The two pieces that the last merge of every piece joins, found from short pieces to long ones.

        A piece that the merges never make out of its own text is no edge; nor is it a part of another.
        """
        names = {self.texts[i]: i for i in self.ids.tolist()}
        cuts = [(names[t[:k]], names[t[k:]], i) for t, i in names.items() for k in range(1, len(t)) if t[:k] in names and t[k:] in names]
        left, right, whole = np.array(sorted(cuts), np.int64).reshape(-1, 3).T
        self.joins, self.joined = left * self.base + right, whole  # sorted by the pair
        sizes = np.zeros(self.base, np.int64)
        sizes[self.ids] = self.lengths
        self.made = np.full(self.base, -1, np.int64)  # the rank of the merge that makes a piece; single characters are there from the start
        self.left, self.right = np.arange(self.base), np.arange(self.base)
        real = sizes == 1
        for size in range(2, self.depth + 1):
            who = np.flatnonzero((sizes[whole] == size) & real[left] & real[right])
            who = who[self.stay_apart(left[who], right[who], self.rank[whole[who]])]
            self.left[whole[who]], self.right[whole[who]] = left[who], right[who]
            self.made[whole[who]] = self.rank[whole[who]]
            real[whole[who]] = True
        keep = real[self.ids]
        self.ids, self.lengths, self.codes = self.ids[keep], self.lengths[keep], self.codes[keep]

    def stay_apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges leave pieces a, b (arrays) as they are where they stand side by side.

        Merges are undone from the last on, in the piece that was finished later (of equals the right one, as merges go
        from the left). At no time may the two pieces that face each other have joined: their merge must come after the
        one just undone. before: ranks of merges that come after all of the pieces' own.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max) if before is None else before.copy()
        out = np.zeros(len(a), bool)
        at = np.arange(len(a))
        while len(at):
            key = a * self.base + b
            k = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
            apart = (self.joins[k] != key) | (self.rank[self.joined[k]] >= limit) if len(self.joins) else np.ones(len(at), bool)
            ra, rb = self.made[a], self.made[b]
            ended = (ra < 0) & (rb < 0)
            out[at[apart & ended]] = True
            go = apart & ~ended
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            later = ra > rb
            limit = np.where(later, ra, rb + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """stay_apart() with a memory of pairs; everything goes on from the begin of a unit."""
        key = a * self.base + b
        place = (key ^ (key >> 17)) * 0x2545F4914F6CDD1D >> 23 & (PAIRS - 1)
        new = np.flatnonzero((self.pair_keys[place] != key) & (a != self.start))
        out = self.pair_values[place] | (a == self.start)
        if len(new):
            keys, which = np.unique(key[new], return_inverse=True)
            found = self.stay_apart(keys // self.base, keys % self.base)[which]
            out[new] = found
            # two new pairs may share a place: it keeps one of them whole, as both are written in the same order
            self.pair_keys[place[new]] = key[new]
            self.pair_values[place[new]] = found
        return out

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """The piece at [position, length], or -1: all occurrences of all pieces, in order of position."""
        order = suffix_array(codes, self.depth)
        lo, hi = occurrence_ranges(codes, order, self.codes, self.lengths)
        counts = hi - lo
        which = np.repeat(np.arange(len(self.ids)), counts)
        at = order[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + lo[which]]
        table = np.full((len(codes), self.depth + 1), -1, np.int32)  # a cell for each (position, length) sorts the edges
        table[at, self.lengths[which]] = self.ids[which]
        return table

    def units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units: all ids one after the other, and len(units) + 1 offsets."""
        sizes = np.array([len(u) for u in units], np.int64)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(units)
        short = np.flatnonzero(sizes <= LONG)
        if len(short):
            for k, ids in zip(short.tolist(), self.relaxed([units[k] for k in short], sizes[short]), strict=True):
                out[k] = ids
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[k] = self.relaxed_alone(units[k])
        return np.concatenate(out) if out else np.empty(0, np.int64), np.append(0, np.cumsum([len(x) for x in out]))

    def relaxed(self, units: list[str], sizes: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each of many short units; the n-th positions of all are relaxed together."""
        codes = np.frombuffer("".join(u + "\U0010ffff" for u in units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begins = np.cumsum(sizes + 1) - (sizes + 1)
        codes[begins + sizes] = END
        table = self.edges(codes)
        table[:, 1] = np.where(table[:, 1] < 0, self.unknown, table[:, 1])
        order = np.argsort(-sizes, kind="stable")
        begin, size = begins[order], sizes[order]
        last = np.full(len(codes), self.start, np.int64)  # the piece that ends before a position, and its length
        length = np.zeros(len(codes), np.int64)
        for i in range(1, int(sizes.max()) + 1):
            b = begin[: np.searchsorted(-size, -i, side="right")]
            lens = np.arange(1, min(i, self.depth) + 1)
            ids = table[b[:, None] + i - lens, lens]
            r, c = np.nonzero(ids >= 0)
            edge = ids[r, c].astype(np.int64)
            good = self.stable(last[b[r] + i - lens[c]], edge)
            at = b[r[good]] + i
            last[at], length[at] = edge[good], lens[c[good]]
        steps, at, live = [], begins + sizes, np.arange(len(units))
        while len(live := live[at[live] > begins[live]]):
            steps.append((live, at[live]))
            at[live] -= length[at[live]]
        who, end = (np.concatenate(x) for x in zip(*steps[::-1], strict=True)) if steps else (np.empty(0, np.int64),) * 2
        by = np.lexsort((end, who))
        ids, counts = self.spelled(last[end[by]], codes[end[by] - 1])
        per = np.bincount(who[by], counts, len(units)).astype(np.int64)
        yield from np.split(ids, np.cumsum(per)[:-1])

    def relaxed_alone(self, unit: str) -> np.ndarray:
        """The ids of one long unit, window by window; what is kept of it is one piece for each position."""
        codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(codes)
        last, length = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.uint8)
        last[0] = self.start
        known: dict[int, bool] = {}
        for w in range(0, n, WINDOW):
            until = min(n, w + WINDOW)
            table = self.edges(codes[w : min(n, until + self.depth)])[: until - w]
            table[:, 1] = np.where(table[:, 1] < 0, self.unknown, table[:, 1])
            at, lens = np.nonzero(table >= 0)
            for j, size, edge in zip((at + w).tolist(), lens.tolist(), table[at, lens].tolist(), strict=True):
                if j + size <= n and last[j + size] < 0:
                    before = int(last[j])
                    if (good := known.get(before * self.base + edge)) is None:
                        good = known[before * self.base + edge] = bool(self.stable(np.array([before]), np.array([edge]))[0])
                    if good:
                        last[j + size], length[j + size] = edge, size
        ends = []
        at = n
        while at > 0:
            ends.append(at)
            at -= int(length[at])
        end = np.array(ends[::-1], np.int64)
        return self.spelled(last[end].astype(np.int64), codes[end - 1])[0]

    def spelled(self, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with characters that have no piece (whose codes are given) as bytes, and how many ids each became."""
        counts = np.ones(len(ids), np.int64)
        if (odd := np.flatnonzero(ids == self.unknown)).size:
            spelled = [self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in codes[odd].tolist()]
            counts[odd] = [len(x) for x in spelled]
            ids = np.repeat(ids, counts)
            ids[ids == self.unknown] = np.concatenate(spelled)
        return ids, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit numbers. An empty text has none."""
        if len(self.memory) > REMEMBERED:
            self.memory, self.stored, self.ends = {}, self.stored[:0], self.ends[:1]
        known, old = self.memory, len(self.memory)
        words = [[known.setdefault(u, len(known)) for u in self.unit.findall(SPACE + t.replace(" ", SPACE))] if t else [] for t in texts]
        if len(known) > old:
            new, ends = self.units(list(islice(known, old, None)))
            self.stored = np.append(self.stored, new.astype("<u4"))
            self.ends = np.append(self.ends, self.ends[-1] + ends[1:])
        which = np.fromiter(chain.from_iterable(words), np.int64, sum(map(len, words)))
        n = self.ends[which + 1] - self.ends[which]
        flat = self.stored[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ends[which], n)]
        ends = np.append(0, np.cumsum(n))[np.cumsum([0, *map(len, words)])]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes are joined and read as UTF-8, the space before the first word goes."""
        text = b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


CODED = "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def encode_documents(docs: DataFrame, model: str, chars: int = 4_000_000) -> DataFrame:
    """Whole texts encoded and decoded again, one row per row of docs, with checksums of both.

    Null texts count as empty: no ids. round_trip is false only where the text holds U+2581 itself, which the model
    cannot tell from a space. Texts are handled in slices of about `chars` characters; none is cut, and a very long run
    without spaces is indexed in windows. Repeated rows give repeated results, a null doc_id is carried along; columns
    beside doc_id and text, whatever their names, are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for b in batches:
            codec = codec or Codec(model)
            texts = [t or "" for t in b.column(1).to_pylist()]
            out: list[list] = [[], [], [], []]
            for i, j in slices(texts, chars):
                for t, ids in zip(texts[i:j], codec.encode(texts[i:j]), strict=True):
                    back = codec.decode(ids)
                    for column, value in zip(out, (len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == t), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), CODED)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
