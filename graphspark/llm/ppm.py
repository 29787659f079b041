"""Language-model scores by prediction by partial matching (PPM).

Texts are token sequences: A-Z lower-cased, words joined by single spaces, then an end mark. Counts of
every byte after its ORDER preceding bytes are gathered from all training documents and summed down to
shorter contexts, which makes a trie of contexts with the bytes seen after each. A byte is predicted in the
longest context known, with (n - 1/2) / N; if it was not seen there the escape probability d / 2N is paid
(N: bytes counted, d: different ones; method D) and the next shorter context predicts it, without the bytes
already excluded. Below the empty context all bytes not excluded are equally likely. The logarithms add up.

No node is left out, and no task holds the trie. Texts are written as blocks of about BLOCK bytes. A block asks
for the logarithm of each of its different grams (ORDER bytes and the next), with its training count, from the
shard that the gram's last DEPTH bytes of context are dealt to. A shard so receives all grams of its contexts, and with
them all longer contexts' suffixes down to DEPTH; the shorter orders, at most 2^24 grams of three bytes, are summed
apart and broadcast. It builds its part of the trie and answers every block. What a context excludes from
its suffix is the same for every text, so N and d after exclusion are computed once per context and a shard's
grams are scored by vectorised hash look-ups. What a task holds is one block, or the different grams of
one shard: requests wait in an unnamed temporary file meanwhile. Answers travel as 32-bit floats and are summed in 64. A block's different words are counted and
answered in the same way, dealt by their checksum. No key is hot: a shard gets at most one request a block.

Nulls and edge cases: a null or blank text is the end mark alone; a null id counts as the empty text's CRC
(held out); without training documents every byte has 1/256 and the base is that of N = V = 0; repeated rows
train and are scored as often as they occur; a text longer than a block is cut between words; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import fsum
from tempfile import SpooledTemporaryFile
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, materialize, table

ORDER = 6
#: Bytes of context by which grams are dealt to shards.
DEPTH = 3
FOLDS = 10
SMOOTH = 0.1
#: Bytes that UTF-8 never uses: before the text, and its end.
BEFORE, END = b"\xfe", b"\xff"
BLOCK = 8 << 20
#: Bytes of text per shard, and the most shards (tasks).
SHARD_BYTES, MOST_SHARDS = 16 << 20, 1 << 14
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: The block under which shards report their numbers of words.
NO_BLOCK = -1
_SPOOL = 32 << 20
_SUM_AT = 4 << 20


def normal(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def codes(data: bytes, order: int) -> np.ndarray:
    """For each byte after the first `order` (7 at most) of data: itself in the lowest byte, those before it above."""
    padded = bytes(7 - order) + data
    windows = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    return windows.astype(np.uint64) & np.uint64((1 << 8 * (order + 1)) - 1)


def pieces(words: list[bytes], order: int, block: int = BLOCK) -> Iterator[bytes]:
    """The marked text in parts of about `block` bytes that end between words, each after the `order` bytes before it."""
    whole = BEFORE * order + b" ".join(words) + END
    at = order
    while at < len(whole):
        end = len(whole)
        if end - at > block:
            end = whole.rfind(b" ", at, at + block) + 1 or whole.find(b" ", at + block) + 1 or end
        yield whole[at - order : end]
        at = end


def listed_words(text: bytes, sizes: np.ndarray, order: int) -> Iterator[tuple[list[bytes], bool]]:
    """The words of each piece of a block, and whether its text ends there."""
    at = 0
    for size in sizes.tolist():
        last = text[at + size - 1] == END[0]
        yield text[at + order : at + size - last].split(), last
        at += size


_DOCS = pa.list_(pa.struct([("doc", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("cut", pa.bool_()), ("size", pa.int64())]))
_LOW = pa.list_(pa.struct([("gram", pa.int32()), ("n", pa.int64())]))
#: text is compressed; tokens and ends count those of training documents, low their grams of DEPTH bytes.
_BLOCKS = (
    "block long, bytes long, tokens long, ends long, docs array<struct<doc: long, doc_id: long, held_out: boolean, cut: boolean, size: long>>, text binary, "
    "low array<struct<gram: int, n: long>>"
)


def _listed(kind: pa.ListType, *columns) -> pa.Array:
    """One list that holds the rows of the columns."""
    fields = list(kind.value_type)
    rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows).cast(kind)


def _own(sizes: np.ndarray, order: int) -> np.ndarray:
    """Which bytes of a block are not the context before a piece."""
    keep = np.ones(int(sizes.sum()), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(order):
        keep[starts + k] = False
    return keep


def _blocked(order: int, block: int):
    schema = pa.schema([("block", pa.int64()), ("bytes", pa.int64()), ("tokens", pa.int64()), ("ends", pa.int64()), ("docs", _DOCS), ("text", pa.binary()), ("low", _LOW)])
    depth = min(DEPTH, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        doc = number = held = tokens = ends = 0
        docs: list[tuple] = []
        texts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            text = b"".join(texts)
            sizes, learnt = np.array([d[4] for d in docs]), np.array([not d[2] for d in docs])
            training = codes(BEFORE * depth + text, depth)[_own(sizes, order) & np.repeat(learnt, sizes)]
            low, n = np.unique((training & np.uint64((1 << 8 * depth) - 1)).astype(np.uint32), return_counts=True)
            numbers = [pa.array([x], pa.int64()) for x in (base | number, len(text), tokens, ends)]
            packed = zstandard.ZstdCompressor(level=3).compress(text)
            return pa.RecordBatch.from_arrays([*numbers, _listed(_DOCS, *zip(*docs)), pa.array([packed], pa.binary()), _listed(_LOW, low.astype(np.int32), n)], schema=schema)

        for batch in batches:
            for doc_id, text, held_out in zip(*(batch.column(i) for i in range(3))):
                doc_id, held_out, words = doc_id.as_py(), held_out.as_py(), normal(text.as_py())
                if not held_out:
                    tokens, ends = tokens + len(words) + 1, ends + 1
                parts = list(pieces(words, order, block))
                for part in parts:
                    docs.append((base | doc, doc_id, held_out, len(parts) > 1, len(part)))
                    texts.append(part)
                    held += len(part)
                    if held >= block:
                        yield flush()
                        docs, texts, held, tokens, ends, number = [], [], 0, 0, 0, number + 1
                doc += 1
        if docs:
            yield flush()

    return run


def _packed(x: np.ndarray, width: int) -> bytes:
    """Numbers by planes of their lowest `width` bytes, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8")[:, 0]


def _shards_of_grams(grams: np.ndarray, order: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that put ascending grams in order of their shards, and where each shard's begin."""
    context = (grams >> np.uint64(8)) & np.uint64((1 << 8 * min(DEPTH, order)) - 1)
    mixed = (context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return _grouped((mixed % np.uint64(shards)).astype(np.uint16), shards)


def _shards_of_words(words: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    return _grouped(np.fromiter((crc32(w) % shards for w in words), np.uint16, len(words)), shards)


def _grouped(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    return np.argsort(shard, kind="stable"), np.searchsorted(np.sort(shard), np.arange(shards + 1))


def _requested(order: int, shards: int):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("times", pa.binary())])

    def grams_of(text: bytes, sizes: np.ndarray, held_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A block's different grams, ascending, and how often training documents have them."""
        code = codes(BEFORE * order + text, order)[_own(sizes, order)] << np.uint64(1)
        code |= np.repeat(held_out, sizes - order)
        code.sort()
        held = (code & np.uint64(1)).astype(np.int8)
        code >>= np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        return code[first], np.diff(np.append(first, len(code))) - np.add.reduceat(held, first, dtype=np.int64)

    def words_of(text: bytes, sizes: np.ndarray, held_out: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        taught: Counter = Counter()
        asked: set[bytes] = set()
        for (words, _), held in zip(listed_words(text, sizes, order), held_out.tolist()):
            (asked if held else taught).update(words)
        words = sorted(asked.union(taught))
        return words, np.fromiter(map(taught.__getitem__, words), np.int64, len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs, text in zip(*(batch.column(i) for i in range(3))):
                docs, text = pa.RecordBatch.from_struct_array(docs.values), zstandard.ZstdDecompressor().decompress(text.as_py())
                about = text, docs["size"].to_numpy(), docs["held_out"].to_numpy(zero_copy_only=False)
                grams, counts = grams_of(*about)
                words, times = words_of(*about)
                places, begin = _shards_of_grams(grams, order, shards)
                spots, start = _shards_of_words(words, shards)
                rows = []
                for shard in np.flatnonzero((begin[1:] > begin[:-1]) | (start[1:] > start[:-1])):
                    at, own = places[begin[shard] : begin[shard + 1]], spots[start[shard] : start[shard + 1]]
                    named = zstandard.ZstdCompressor(level=1).compress(b" ".join(words[i] for i in own))
                    rows.append((shard, block.as_py(), _packed(grams[at], order + 1), _packed(counts[at], 4), named, _packed(times[own], 4)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def _answered(shared, order: int):
    """shared: a broadcast of the short orders' grams and their counts. Block NO_BLOCK gets the shard's number of training words."""
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("logs", pa.binary()), ("times", pa.binary())])

    def words_in(data: bytes) -> list[bytes]:
        return zstandard.ZstdDecompressor().decompress(data).split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        taught: dict[bytes, int] = {}
        pending, asked = 0, []
        with SpooledTemporaryFile(max_size=_SPOOL) as spool:
            for batch in batches:
                for shard, block, grams, n, words, times in zip(*(batch.column(i) for i in range(6))):
                    grams, words = grams.as_py(), words.as_py()
                    spool.write(grams)
                    spool.write(words)
                    asked.append((block.as_py(), shard.as_py(), len(grams), len(words)))
                    keys.append(_unpacked(grams, order + 1))
                    counts.append(_unpacked(n.as_py(), 4))
                    pending += len(keys[-1])
                    if pending > _SUM_AT + 2 * len(keys[0]):
                        one = _summed(keys, counts)
                        keys, counts, pending = [one[0]], [one[1]], len(one[0])
                    for word, more in zip(words_in(words), _unpacked(times.as_py(), 4).tolist()):
                        taught[word] = taught.get(word, 0) + more
            if not asked:
                return
            grams, n = _summed(keys, counts)
            del keys, counts
            logs = Trie.of(*shared.value, grams[n > 0], n[n > 0].astype(np.int64), order).logs(grams)
            spool.seek(0)
            for block, shard, size, more in asked:
                found = logs[np.searchsorted(grams, _unpacked(spool.read(size), order + 1))]
                times = np.fromiter(map(taught.__getitem__, words_in(spool.read(more))), np.int64)
                row = (block, shard, zstandard.ZstdCompressor(level=3).compress(found.astype("<f4").tobytes()), _packed(times, 8))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
            row = (NO_BLOCK, asked[0][1], None, _packed(np.array([sum(map(bool, taught.values()))]), 8))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    return run


class Lookup:
    """Positions of unsigned 64-bit keys, by open addressing, for arrays of keys at a time."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys) - 1).bit_length()) if len(keys) else 4
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.table = np.full(1 << bits, _EMPTY, dtype=np.uint64)
        self.place = np.full(1 << bits, -1, dtype=np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(todo):
            free = self.place[at] < 0
            self.place[at[free]] = todo[free]
            set_ = self.place[at] == todo
            self.table[at[set_]] = keys[todo[set_]]
            todo, at = todo[~set_], (at[~set_] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of every key, or -1."""
        at = self._home(keys)
        there = self.table[at]
        hit = there == keys
        out = np.where(hit, self.place[at], np.int32(-1))
        live = np.flatnonzero(~hit & (there != _EMPTY))
        at = at[live]
        while len(live):
            at = (at + 1) & self.mask
            there = self.table[at]
            hit = there == keys[live]
            out[live[hit]] = self.place[at[hit]]
            stay = ~hit & (there != _EMPTY)
            live, at = live[stay], at[stay]
        return out


class Trie:
    """Counts of bytes by context, as tables of logarithms (base 10).

    A gram's key is its order in the highest byte, then the context and the byte; a context's key has its
    order and bytes. Keys come sorted, and every gram's suffix is there too.
    """

    @classmethod
    def of(cls, low: np.ndarray, low_counts: np.ndarray, grams: np.ndarray, counts: np.ndarray, order: int) -> Trie:
        """From the grams of the longest order and those of DEPTH bytes, both summed down to the orders below."""
        depth = min(DEPTH, order)
        top = np.uint64(56)
        keys, times = [], []
        for j in range(order + 1):
            own, n = (low, low_counts) if j < depth else (grams, counts)
            if len(own):
                own, n = _summed([own & np.uint64((1 << 8 * (j + 1)) - 1)], [n])
                keys.append(own | (np.uint64(j) << top))
                times.append(n)
        return cls(np.concatenate(keys), np.concatenate(times), order) if keys else cls(np.zeros(0, np.uint64), np.zeros(0, np.int64), order)

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int):
        self.order = order
        self.size = len(keys)
        if not self.size:
            return
        top, low = np.uint64(56), np.uint64((1 << 56) - 1)
        orders, code = (keys >> top).astype(np.int64), keys & low
        contexts = (keys & ~low) | (code >> np.uint64(8))
        first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
        names = contexts[first]
        sizes = np.diff(np.append(first, len(keys)))
        owner, level = np.repeat(np.arange(len(first)), sizes), orders[first]
        n, d = np.add.reduceat(counts, first).astype(np.float64), sizes.astype(np.float64)
        # A gram's suffix and a context's suffix, one byte shorter at the far end; those of order 0 point anywhere.
        masks = np.array([(1 << 8 * j) - 1 for j in range(order + 2)], dtype=np.uint64)
        shorter = np.where(orders > 0, ((np.maximum(orders, 1) - 1).astype(np.uint64) << top) | (code & masks[orders]), 0)
        at = np.minimum(np.searchsorted(keys, shorter), len(keys) - 1)
        excluded = np.add.reduceat(np.where(orders > 0, counts[at], 0), first)
        above = (np.maximum(level, 1) - 1).astype(np.uint64) << top
        suffix = np.searchsorted(names, np.where(level > 0, above | (names & low & masks[np.maximum(level, 1) - 1]), 0))
        suffix = np.minimum(suffix, len(names) - 1)
        root = level == 0
        # What the suffix still predicts and escapes with, once this context's bytes are excluded from it.
        left = np.where(root, 256 - d, n[suffix] - excluded)
        escaping = (d[suffix] - d) / 2
        open_ = ~root & (left > 0) & (escaping > 0)
        fall = np.where(open_, np.log10(np.where(open_, escaping, 1)) - np.log10(np.where(open_, left, 1)), 0.0)
        fallen = np.zeros(len(names))  # escapes from here down to the empty context, this one's first escape not counted
        for j in range(1, order + 1):
            own = level == j
            fallen[own] = fall[own] + fallen[suffix[own]]
        self.fallen = fallen
        self.escape = np.log10(d / 2 / n)
        self.log_n = np.log10(counts - 0.5)
        self.direct = self.log_n - np.log10(n)[owner]
        self.next_total = np.log10(np.maximum(left, 0.5))
        self.suffix = suffix.astype(np.int32)
        levels = np.arange(order + 2)
        self.grams, self.contexts = self._tables(code, np.searchsorted(orders, levels)), self._tables(names & low, np.searchsorted(level, levels))

    @staticmethod
    def _tables(codes_: np.ndarray, bounds: np.ndarray) -> list[tuple[Lookup, int]]:
        return [(Lookup(codes_[a:b]), int(a)) for a, b in zip(bounds, bounds[1:])]

    @staticmethod
    def _find(table_: tuple[Lookup, int], codes_: np.ndarray) -> np.ndarray:
        found = table_[0].find(codes_)
        return np.where(found >= 0, found + np.int32(table_[1]), np.int32(-1))

    def logs(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's last byte after the bytes before it."""
        out = np.full(len(code), -np.log10(256.0))
        if not self.size:
            return out
        live = np.arange(len(code))
        start = np.full(len(code), -1, dtype=np.int32)  # the longest known context, once found
        child = start.copy()  # the context escaped from last
        for j in range(self.order, -1, -1):
            own = code[live] & np.uint64((1 << 8 * (j + 1)) - 1)
            gram = self._find(self.grams[j], own)
            hit = gram >= 0
            fresh = hit & (start < 0)
            out[live[fresh]] = self.direct[gram[fresh]]
            late = hit & (start >= 0)
            s, c = start[late], child[late]
            out[live[late]] = self.escape[s] + self.fallen[s] - self.fallen[c] + self.log_n[gram[late]] - self.next_total[c]
            live, start, child, own = live[~hit], start[~hit], child[~hit], own[~hit]
            begun = start >= 0
            child[begun] = self.suffix[child[begun]]
            new = np.flatnonzero(~begun)
            found = self._find(self.contexts[j], own[new] >> np.uint64(8))
            start[new] = child[new] = found
        begun = start >= 0
        s, c = start[begun], child[begun]
        out[live[begun]] = self.escape[s] + self.fallen[s] - self.next_total[c]
        return out


_SCORED = "doc long, doc_id long, held_out boolean, cut boolean, n_tokens long, n_known long, base_score double, score double"


def _scorer(order: int, shards: int, end_times: int):
    """base_score: of the counts alone, their divisor not yet taken off. Document NO_BLOCK: n_known training words."""
    end_log, end_known = float(np.log10(end_times + SMOOTH)), int(end_times > 0)
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def of_block(docs: pa.RecordBatch, text: bytes, answers: dict[int, tuple[bytes, bytes]]) -> pa.Table:
        sizes = docs["size"].to_numpy()
        grams, inverse = np.unique(codes(BEFORE * order + text, order)[_own(sizes, order)], return_inverse=True)
        places, begin = _shards_of_grams(grams, order, shards)
        listed = list(listed_words(text, sizes, order))
        words = sorted(set().union(*(w for w, _ in listed)))
        spots, start = _shards_of_words(words, shards)
        logs, times = np.empty(len(grams)), np.empty(len(words), np.int64)
        for shard, (answer, found) in answers.items():
            logs[places[begin[shard] : begin[shard + 1]]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(answer), "<f4")
            times[spots[start[shard] : start[shard + 1]]] = _unpacked(found, 8)
        by_word = dict(zip(words, np.log10(times + SMOOTH).tolist()))
        unknown = {words[i] for i in np.flatnonzero(times == 0)}
        scores = np.add.reduceat(logs[inverse], np.cumsum(sizes - order) - (sizes - order))
        n_tokens = [len(w) + last for w, last in listed]
        n_known = [len(w) + last * end_known - (sum(map(unknown.__contains__, w)) if unknown else 0) for w, last in listed]
        base = [fsum(map(by_word.__getitem__, w)) + last * end_log for w, last in listed]
        return pa.table([docs["doc"], docs["doc_id"], docs["held_out"], docs["cut"], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores)], names=names)

    def score_block(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            known = sum(int(_unpacked(x.as_py(), 8)[0]) for x in right["times"])
            return pa.table([pa.array([x], t) for x, t in ((NO_BLOCK, pa.int64()), (None, pa.int64()), (None, pa.bool_()), (None, pa.bool_()), (0, pa.int64()), (known, pa.int64()), (0.0, pa.float64()), (0.0, pa.float64()))], names=names)
        answers = {s.as_py(): (a.as_py(), t.as_py()) for s, a, t in zip(right["shard"], right["logs"], right["times"])}
        docs, text = left["docs"].combine_chunks(), left["text"][0].as_py()
        return of_block(pa.RecordBatch.from_struct_array(docs.values), zstandard.ZstdDecompressor().decompress(text), answers)

    return score_block


def score(docs: DataFrame, order: int = ORDER, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    held_out = crc32_of_id(id_col) % FOLDS == 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    blocks = materialize(rows.mapInArrow(_blocked(order, block), _BLOCKS), "lm-blocks", "none")
    zero = F.lit(0).cast("long")
    size = blocks.agg(F.count(F.lit(1)).alias("blocks"), *[F.coalesce(F.sum(c), zero).alias(c) for c in ("bytes", "tokens", "ends")]).first()
    shards = min(MOST_SHARDS, -(-size.bytes // SHARD_BYTES) or 1)
    requests = blocks.select("block", "docs", "text").mapInArrow(_requested(order, shards), "shard int, block long, grams binary, counts binary, words binary, times binary")
    # At most 2^24 different grams of DEPTH bytes.
    low = blocks.select(F.explode("low").alias("g")).groupBy("g.gram").agg(F.sum("g.n").alias("n")).toArrow().sort_by("gram")
    shared = docs.sparkSession.sparkContext.broadcast((low["gram"].to_numpy().astype(np.uint64), low["n"].to_numpy()))
    answers = requests.repartitionById(shards, F.col("shard")).mapInArrow(_answered(shared, order), "block long, shard int, logs binary, times binary")
    tasks = max(1, min(size.blocks, MOST_SHARDS))
    texts = blocks.select("block", "docs", "text").repartition(tasks, "block")
    both = texts.groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block"))
    scored = materialize(both.applyInArrow(_scorer(order, shards, size.ends), _SCORED), "lm-scored")
    words = scored.filter(F.col("doc") == NO_BLOCK).agg(F.coalesce(F.sum("n_known"), zero).alias("n")).first().n
    log_divisor = float(np.log10(size.tokens + SMOOTH * (words + bool(size.ends) + 1)))
    cut = scored.filter("cut").groupBy("doc").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    )
    every = scored.filter("not cut").drop("cut").unionByName(cut)
    base = (F.col("base_score") - F.col("n_tokens") * F.lit(log_divisor)).alias("base_score")
    return every.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(size.tokens).cast("long").alias("train_tokens"), base, "score")


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
