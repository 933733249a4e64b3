"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers cut the same bytes (a space and the text) into tokens; byte
places where a token of both ends cut the text into groups. The two sorted
lists of token ends are merged along a merge path: a binary search on each
diagonal gives where an equal share of the merge begins in either list, so the
merge falls into independent pieces of equal work, which are then merged in
lock-step. Every piece emits its overlaps (one token of each side that share
bytes) and the cuts it meets; the open group at a piece's edge is stitched to
the piece before it by running totals of the cuts.

Texts are split into chunks (white space and the run after it) that no token
of either vocabulary crosses; the distinct chunks of a run of texts are
encoded once by the vocabularies' own libraries. A text with a chunk whose
tokens do not spell its bytes is encoded whole to decide.

Counts over all documents: a pair of ids counts once for each document that
links it. The pairs with the highest counts (a bounded number) are looked up
inside the tasks, all others by a join, so frequent pairs are no hot keys.

Rows: texts that are null or empty or that a vocabulary does not spell exactly
have no tokens (zeros, empty digest). Every row is a document of its own, also
if ids repeat or are null; ties for the highest count all count; a text of any
length is handled whole; an empty table gives no rows. Only ``doc_id`` and
``text`` are read, so further columns cannot clash. The vocabularies' paths are
parameters.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.bpe import byte_symbols
from foldwise.llm.frames import Scratch, record, text_pass
from foldwise.llm.tokens import text_chunks
from foldwise.session import materialize

#: merged ends per piece of the merge path
WIDTH = 256
#: bytes of text whose distinct chunks are encoded together
RUN_BYTES = 3 << 20
#: bytes of joined chunks that a library gets at once
PART_BYTES = 1 << 11
#: pairs with the highest counts that the tasks look up by themselves
CACHED = 1 << 18
#: links of one group above which its distinct ids are paired instead of its places
LARGE = 1 << 12

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C]] = True
#: the piece model's mark for a space, as bytes and as a character
_MARK = "▁"


# --- chunks ------------------------------------------------------------------
def _solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte ``at`` is surely no white space
    (some other characters are taken for white space too)."""
    last, one, two = data[at], data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    wide = (two == 0xE2) & ((one == 0x80) | (one == 0x81)) | (two == 0xE3) & (one == 0x80)
    wide |= (two == 0xE1) & ((one == 0x9A) | (one == 0xA0))
    narrow = (one == 0xC2) & ((last == 0x85) | (last == 0xA0))
    return (last > 0x20) & (last < 0x7F) | (last >= 0x80) & ~wide & ~narrow


def chunk_starts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Byte places at which a text or a chunk inside it begins: white space
    after a character that is none. A pattern that splits before white space
    and a vocabulary without tokens across such places never join chunks."""
    mark = _BLANK[data]
    blank = np.flatnonzero(mark)
    mark[blank] = _solid(data, blank - 1)
    mark[begin[:-1]] = True
    return np.flatnonzero(mark)


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (counts[0] of them), first[1], ..."""
    ends = np.cumsum(counts)
    return np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _slots(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(counts, dtype=np.int64)])


# --- the two vocabularies ----------------------------------------------------
class ByteLevel:
    """A byte-level BPE file. Ranks equal ids there, so the faster of its two
    public libraries encodes; characters whose class may differ between the
    libraries' Unicode tables go to the file's own library."""

    #: characters whose bytes stay below are in both libraries' tables alike
    #: (up to U+04FF; tested for every character)
    SURE = 0xD4

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if order != sorted(order):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        back = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in added}
        self.lengths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True

    def whole(self, text: str) -> list[int]:
        """Of a space and the text."""
        return self.library.encode(" " + text, add_special_tokens=False).ids

    def joined(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.fast.encode_ordinary("".join(texts)), dtype=np.int64)

    def single(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """A sentence-piece BPE model with byte fallback that adds the space itself."""

    LEAD = "x"

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.bytes = [self._bytes(i) for i in range(n)]
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        body = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        edges = _slots(self.lengths)
        inside = np.setdiff1d(chunk_starts(body, edges), edges)
        normal = [i for i in np.searchsorted(edges, inside, side="right") - 1
                  if not (self.library.is_control(int(i)) or self.library.is_unknown(int(i)))]
        if normal:
            raise ValueError(f"{path}: the piece {self.bytes[normal[0]]!r} crosses chunks")
        self.body, self.edges = body, edges

    def _bytes(self, i: int) -> bytes:
        piece = self.library.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace(_MARK, " ").encode()

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text)

    def joined(self, texts: list[str]) -> np.ndarray:
        """The model puts a space before a text: a leading word takes it."""
        got = [i for ids in self.single(texts) for i in ids]
        return np.asarray(got, dtype=np.int64)

    def single(self, texts: list[str]) -> list[list[int]]:
        led = self.library.encode([self.LEAD, *[self.LEAD + t for t in texts]], num_threads=1)
        return [ids[len(led[0]):] for ids in led[1:]]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.body[_spread(self.edges[ids], self.lengths[ids])] if len(ids) else self.body[:0]


_OPEN: dict[tuple, tuple[ByteLevel, Pieces]] = {}


def opened(paths: tuple[str, str]) -> tuple[ByteLevel, Pieces]:
    """One pair of vocabularies per worker process."""
    if paths not in _OPEN:
        _OPEN[paths] = ByteLevel(paths[0]), Pieces(paths[1])
    return _OPEN[paths]


def _encode_chunks(vocab, body: np.ndarray, edges: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all chunks one after the other, first token of each). The chunks
    of ``together`` are encoded as one text: no token crosses from one into
    the next; all others each by itself."""
    sizes = np.diff(edges)
    text = body[np.repeat(together, sizes)].tobytes()
    ends = np.cumsum(sizes[together])
    cuts = ends[np.searchsorted(ends, np.arange(0, len(text), PART_BYTES))]
    parts = np.unique(np.concatenate([[0], cuts, [len(text)]]).astype(np.int64))
    ids = vocab.joined([text[x:y].decode("utf-8") for x, y in zip(parts[:-1], parts[1:])])
    bounds = np.searchsorted(np.cumsum(vocab.lengths[ids]), ends, side="right")
    alone = np.flatnonzero(~together)
    apart = vocab.single([body[edges[k]:edges[k + 1]].tobytes().decode("utf-8") for k in alone])
    counts = np.zeros(len(sizes), dtype=np.int64)
    counts[together] = np.diff(bounds, prepend=0)
    counts[alone] = [len(x) for x in apart]
    first = _slots(counts)
    out = np.empty(first[-1], dtype=np.int64)
    out[np.repeat(together, counts)] = ids[:counts[together].sum()]
    out[np.repeat(~together, counts)] = [i for x in apart for i in x]
    return out, first


def _encode_run(data: np.ndarray, begin: np.ndarray, a: ByteLevel, b: Pieces):
    """Tokens of texts (each led by a space) that lie end to end in ``data``:
    (A ids, first A token of each text, B ids, first B token of each text).
    A text that is not spelled exactly has no tokens."""
    starts = chunk_starts(data, begin)
    places = np.append(starts, len(data))
    every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64)),
                                                                   pa.py_buffer(np.ascontiguousarray(data))])
    coded = every.dictionary_encode()
    code = coded.indices.to_numpy()
    edges = _slots(pc.binary_length(coded.dictionary).to_numpy())
    body = np.frombuffer(coded.dictionary.buffers()[2], dtype=np.uint8)[:edges[-1]]
    solid = _solid(body, edges[1:] - 1)
    a_ids, a_first = _encode_chunks(a, body, edges, solid & (np.maximum.reduceat(body, edges[:-1]) < a.SURE))
    b_ids, b_first = _encode_chunks(b, body, edges, solid)
    a_size = np.add.reduceat(np.append(a.lengths[a_ids], 0), a_first[:-1]) * (np.diff(a_first) > 0)
    spelled = b.spelled(b_ids)
    right = a_size == np.diff(edges)
    if len(spelled) != len(body) or not np.array_equal(spelled, body):
        b_size = np.add.reduceat(np.append(b.lengths[b_ids], 0), b_first[:-1]) * (np.diff(b_first) > 0)
        at = _slots(b_size)
        right &= [np.array_equal(spelled[at[k]:at[k + 1]], body[edges[k]:edges[k + 1]]) for k in range(len(right))]
    of_text = np.searchsorted(starts, begin)
    doubt = np.add.reduceat(np.append(~right[code], False), of_text[:-1]) > 0
    texts = len(begin) - 1
    out = []
    for vocab, ids, first in ((a, a_ids, a_first), (b, b_ids, b_first)):
        counts = np.diff(first)[code]
        counts[doubt[np.searchsorted(begin, starts, side="right") - 1]] = 0
        per = np.diff(_slots(counts)[of_text])
        out.append((ids[_spread(first[code], counts)], per))
    (a_all, a_per), (b_all, b_per) = out
    for t in np.flatnonzero(doubt):
        raw = data[begin[t]:begin[t + 1]].tobytes()
        x, y = a.whole(raw[1:].decode("utf-8")), b.whole(raw[1:].decode("utf-8"))
        if a.lengths[x].sum() == len(raw) and b.spelled(np.asarray(y, dtype=np.int64)).tobytes() == raw:
            a_all = np.insert(a_all, a_per[:t].sum(), x)
            b_all = np.insert(b_all, b_per[:t].sum(), y)
            a_per[t], b_per[t] = len(x), len(y)
    assert len(a_per) == texts == len(b_per)
    return a_all, _slots(a_per), b_all, _slots(b_per)


# --- merge path --------------------------------------------------------------
def split_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many ends of ``a`` lie on the merge path before each diagonal (of
    equal ends ``a``'s goes first): one binary search per diagonal."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        before = a[mid] <= b[diagonals[open_] - 1 - mid]
        low[open_] = np.where(before, mid + 1, low[open_])
        high[open_] = np.where(before, high[open_], mid)


def merge_ends(a: np.ndarray, b: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Overlaps and groups of two lists of token ends over the same bytes.

    Returns (A index, B index, end, group) of every overlap in order. The
    merge is cut into pieces of ``width`` ends; all pieces take their steps
    together. A step stands at token i of A and token j of B; the end it takes
    closes their overlap. Of equal ends A's is taken first, and B's step adds
    no bytes: it is the cut, after which a new group begins.
    """
    total = len(a) + len(b)
    if not total:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z
    diagonals = np.append(np.arange(0, total, width), total)
    i = split_path(a, b, diagonals)
    j = diagonals - i
    steps = np.diff(diagonals)
    last_i, last_j, i, j = i[1:], j[1:], i[:-1].copy(), j[:-1].copy()
    shape = (width, len(steps))
    at_a, at_b, cut = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=bool)
    a_pad, b_pad = np.append(a, np.iinfo(np.int64).max), np.append(b, np.iinfo(np.int64).max)
    for s in range(int(steps.max())):
        take_a = (i < last_i) & ((j >= last_j) | (a_pad[i] <= b_pad[j]))
        take_b = ~take_a & (j < last_j)
        at_a[s], at_b[s] = i, j
        cut[s] = take_b & (i > 0) & (a_pad[i - 1] == b_pad[j])
        i += take_a
        j += take_b
    live = np.arange(width)[:, None] < steps[None, :]
    # each piece numbers its own groups; the cuts of the pieces before it are
    # added, so a group that is open at an edge keeps one number
    inside = np.cumsum(cut, axis=0) - cut
    stitched = inside + _slots(cut.sum(axis=0))[:-1][None, :]
    emit = (live & ~cut).T.ravel()
    x, y = at_a.T.ravel()[emit], at_b.T.ravel()[emit]
    return x, y, np.minimum(a_pad[x], b_pad[y]), stitched.T.ravel()[emit]


def group_sizes(a: np.ndarray, b: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in each group, from the overlaps: the tokens of a
    group's first and last overlap are its first and last tokens."""
    x, y, _, g = merge_ends(a, b, width)
    if not len(g):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    last = np.append(first[1:], len(g)) - 1
    return x[last] - x[first] + 1, y[last] - y[first] + 1


_DECIMALS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(digits from the left, number of digits) of 0, 1, ... up to ``n`` at least."""
    size = 1 << max(16, n.bit_length())
    if size not in _DECIMALS:
        said = np.char.encode(np.arange(size).astype(str), "ascii")
        digits = np.ascontiguousarray(said).view(np.uint8).reshape(size, -1)
        _DECIMALS[size] = digits, (digits > 0).sum(axis=1)
    return _DECIMALS[size]


# --- documents ---------------------------------------------------------------
class Aligned:
    """Tokens and groups of a run of texts (``data``, ``begin`` as ``text_chunks``)."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, paths: tuple[str, str], width: int = WIDTH):
        a, b = opened(paths)
        filled = np.flatnonzero(np.diff(begin) > 0)
        led = np.insert(data, begin[filled], 0x20)
        sizes = np.diff(begin)[filled] + 1
        a_ids, a_first, b_ids, b_first = _encode_run(led, _slots(sizes), a, b) if len(filled) else (
            np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)) * 2
        texts = len(begin) - 1
        self.n_a, self.n_b = np.zeros(texts, dtype=np.int64), np.zeros(texts, dtype=np.int64)
        self.n_a[filled], self.n_b[filled] = np.diff(a_first), np.diff(b_first)
        self.a_ids, self.b_ids = a_ids, b_ids
        self.group_a, self.group_b = group_sizes(np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids]), width)
        # a text's last ends are common to both, so groups stay inside texts
        self.first_group = np.searchsorted(np.cumsum(self.group_a), np.cumsum(self.n_a), side="right")
        self.first_group = np.append(0, self.first_group)

    def texts(self) -> int:
        return len(self.n_a)

    def links(self) -> np.ndarray:
        per = np.append(0, np.cumsum(self.group_a * self.group_b))
        return np.diff(per[self.first_group])

    def written(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        seq, sep = self._in_order()
        digits, widths = _decimals(int(seq.max()) + 1 if len(seq) else 1)
        wide = widths[seq]
        at = _slots(wide + 1)
        out = np.empty(at[-1], dtype=np.uint8)
        for d in range(digits.shape[1]):
            more = np.flatnonzero(wide > d)
            out[at[more] + d] = digits[seq[more], d]
        out[at[1:] - 1] = sep
        ends = at[_slots(self.n_a + self.n_b)]
        return [out[ends[t]:max(ends[t + 1] - 1, ends[t])].tobytes() for t in range(self.texts())]

    def _in_order(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids as written (a group's A ids, then its B ids) and the mark
        after each."""
        n = len(self.a_ids) + len(self.b_ids)
        seq, sep = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
        a_before, b_before = _slots(self.group_a), _slots(self.group_b)
        a_at = np.arange(len(self.a_ids)) + np.repeat(b_before[:-1], self.group_a)
        b_at = np.arange(len(self.b_ids)) + np.repeat(a_before[1:], self.group_b)
        seq[a_at], seq[b_at] = self.a_ids, self.b_ids
        sep[a_at[a_before[1:] - 1]] = ord("|")
        sep[b_at[b_before[1:] - 1]] = ord(";")
        return seq, sep

    def pairs(self, shift: int, large: int = LARGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of every distinct linked pair of ids of every
        text, sorted; a pair is A id << shift | B id."""
        text = np.repeat(np.arange(self.texts()), np.diff(self.first_group))
        size = self.group_a * self.group_b
        a_at, b_at = _slots(self.group_a)[:-1], _slots(self.group_b)[:-1]
        few = np.flatnonzero(size <= large)
        k = _spread(np.zeros(len(few), dtype=np.int64), size[few])
        g = np.repeat(few, size[few])
        bits = shift + 20  # ids of A are below 2**20
        keys = [text[g] << bits | self.a_ids[a_at[g] + k // self.group_b[g]] << shift
                | self.b_ids[b_at[g] + k % self.group_b[g]]]
        times = [np.ones(len(g), dtype=np.int64)]
        for g in np.flatnonzero(size > large):
            x, nx = np.unique(self.a_ids[a_at[g]:a_at[g] + self.group_a[g]], return_counts=True)
            y, ny = np.unique(self.b_ids[b_at[g]:b_at[g] + self.group_b[g]], return_counts=True)
            keys.append((text[g] << bits | (x << shift)[:, None] | y[None, :]).ravel())
            times.append((nx[:, None] * ny[None, :]).ravel())
        keys, times = np.concatenate(keys), np.concatenate(times)
        if len(times) == len(k):
            keys, times = np.unique(keys, return_counts=True)
        else:
            keys, back = np.unique(keys, return_inverse=True)
            times = np.bincount(back, weights=times).astype(np.int64)
        return keys >> bits, keys & ((1 << bits) - 1), times


_TEXT = pa.schema([("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())),
                   ("group_a", pa.list_(pa.int32())), ("group_b", pa.list_(pa.int32()))])


def _lists(values: np.ndarray, first: np.ndarray, kind=pa.int32()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, type=pa.int32()), pa.array(values, type=kind))


def align_documents(docs: DataFrame, a_path: str, b_path: str, width: int = WIDTH) -> DataFrame:
    """(doc_id, a_ids, b_ids, group_a, group_b): the tokens of every text and
    how many of each side every group holds, in order."""
    paths = (a_path, b_path)

    def work(rows, data, begin):
        x = Aligned(data, begin, paths, width)
        return record(_TEXT, rows.column(0).cast(pa.int64()), _lists(x.a_ids, _slots(x.n_a)),
                      _lists(x.b_ids, _slots(x.n_b)), _lists(x.group_a, x.first_group),
                      _lists(x.group_b, x.first_group))

    return text_pass(docs.select("doc_id", "text"), work, "doc_id long, a_ids array<int>, b_ids array<int>, "
                     "group_a array<int>, group_b array<int>")


_DIGEST = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                     ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                     ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_DIGEST_DDL = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
               "pairs array<long>, times array<long>")


def _digests(docs: DataFrame, paths: tuple[str, str], shift: int, width: int) -> DataFrame:
    """Counts, digest and distinct pairs of every row; ``row`` is unique in
    the written table."""

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, data, begin in text_chunks(batch.column(1), RUN_BYTES):
                x = Aligned(data, begin, paths, width)
                text, pair, times = x.pairs(shift)
                first = np.searchsorted(text, np.arange(hi - lo + 1))
                said = [hashlib.sha256(w).hexdigest() if w else "" for w in x.written()]
                yield record(_DIGEST, np.arange(row, row + hi - lo),
                             batch.column(0).slice(lo, hi - lo).cast(pa.int64()), x.n_a, x.n_b,
                             np.diff(x.first_group), x.links(), said, _lists(pair, first, pa.int64()),
                             _lists(times, first, pa.int64()))
                row += hi - lo

    return docs.select("doc_id", "text").mapInArrow(run, _DIGEST_DDL)


def pair_counts(rows: DataFrame, shift: int) -> DataFrame:
    """(pair, a, n): how many rows link each pair of ids."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("a", F.shiftright("pair", shift))


def with_best(counts: DataFrame) -> DataFrame:
    """(pair, n, best): whether no pair of the same A id is linked by more rows.
    The highest counts are one row per A id, so no more than its vocabulary."""
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_SUMMED = pa.schema([*[f for f in _DIGEST if f.name not in ("pairs", "times")], ("n_best", pa.int64()),
                     ("count_sum", pa.int64()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_SUMMED_DDL = _DIGEST_DDL.replace("pairs array", "n_best long, count_sum long, pairs array")


def _sum_cached(rows: DataFrame, pair: np.ndarray, n: np.ndarray, best: np.ndarray) -> DataFrame:
    """Add the links of cached pairs to ``n_best`` and ``count_sum``; pairs
    that are not cached stay in ``pairs``."""

    def run(batches):
        for batch in batches:
            lists, times = batch.column(7), batch.column(8)
            flat, many = lists.flatten().to_numpy(), times.flatten().to_numpy()
            first = _slots(lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            known = pair[at] == flat if len(pair) else np.zeros(len(flat), dtype=bool)
            at = at[known]
            sums = []
            for value in (np.where(best[at], many[known], 0), n[at] * many[known]):
                each = np.zeros(len(flat), dtype=np.int64)
                each[known] = value
                sums.append(np.diff(_slots(each)[first]))
            left = _slots(~known)[first]
            yield record(_SUMMED, *batch.columns[:7], *sums, _lists(flat[~known], left, pa.int64()),
                         _lists(many[~known], left, pa.int64()))

    return rows.mapInArrow(run, _SUMMED_DDL)


def alignment_digest(docs: DataFrame, a_path: str, b_path: str, cached: int = CACHED, width: int = WIDTH) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths = (a_path, b_path)
    shift = int(max(1, opened(paths)[1].library.get_piece_size() - 1)).bit_length()
    spark = docs.sparkSession
    with Scratch(spark) as keep:
        rows = keep(_digests(docs, paths, shift, width), "alignment-rows")
        counts = keep(with_best(keep(pair_counts(rows, shift), "alignment-pairs")), "alignment-counts")
        top = counts.orderBy(F.desc("n"), "pair").limit(cached).toArrow()
        pair = top.column("pair").to_numpy()
        order = np.argsort(pair)
        n, best = top.column("n").to_numpy()[order], top.column("best").to_numpy()[order]
        summed = keep(_sum_cached(rows, pair[order], n, best), "alignment-sums")
        rest = summed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
        rest = rest.select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        rest = rest.join(counts, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("more_best"),
            F.sum(F.col("n") * F.col("times")).alias("more_sum"))
        both = summed.drop("pairs", "times").join(rest, "row", "left")
        out = both.select("doc_id", "n_a", "n_b", "n_groups", "n_links",
                          (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                          (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
        return materialize(out, "alignment")
