"""Benchmark decontamination with suffix arrays over the training texts.

Every task turns its documents into shards of word ids, sorts the suffixes of a shard and binary-searches the suffixes
of the test items in it, each by the window that it begins with; suffixes that begin alike are searched once. The
interval of the shard's suffixes that begin with a window gives all its occurrences; those of an item's next suffixes
that go on in the text lengthen a match to the longest verbatim one. Only words of the tests get ids; a suffix that is
not followed by a window's number of such words can't begin a match and is left out of the array, which is exact.

Test items are cut into blocks. A task for each block turns it into arrays, which lie in a file of the shared folder: a few
bytes for each word, and no Python objects. Tasks that search texts hold one block at a time, so their memory follows
the size of a block, not that of the tests. Words are told apart by 64-bit hashes; what they find is compared word by word.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagelore.llm.shared import new_dir, slices
from pagelore.llm.token_files import put
from pagelore.llm.words import CHARACTERS, REMEMBERED, Numbers

WINDOW = 10
#: A block of test items has about so many bytes of text, one item's texts in one block, and takes about nine times as much
#: memory in a task that reads it; texts are read in slices of so many bytes, larger ones if there are several blocks.
BLOCK_BYTES, SLICE, LARGE_SLICE = 32 << 20, 8 << 20, 32 << 20
#: Queries that are searched at once within a task.
AT_ONCE = 1 << 15

#: Lower-cases A-Z and blanks every ASCII character that is neither a letter nor a digit.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


class Tests:
    """A block of test items as arrays.

    hashes: those of its distinct words in order; a word's id is its place, from 1. flat: the ids of all items' words, each
    item followed by zeros. A window is named by the place in flat where it first occurs (places), with its number of
    words (sizes), in order of its words; owners[firsts[w]:firsts[w + 1]] are all its places. blob holds the words joined by
    blanks, from byte offsets on.
    """

    ARRAYS = ("hashes", "flat", "item_starts", "item_sizes", "places", "sizes", "firsts", "owners", "offsets", "blob")

    def __init__(self, items: list, window: int, arrays: dict[str, np.ndarray]) -> None:
        self.items, self.window = items, window
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])
        self.shortest = int(self.sizes.min()) if len(self.sizes) else window
        self.longest = int(self.item_sizes.max()) if len(self.item_sizes) else 0

    @classmethod
    def of(cls, items: list[tuple[object, str]], window: int) -> Tests:
        numbers, names, sizes, coded, lengths, parts = Numbers(), [], [], [], [], []
        for item_id, text in items:
            if found := words(text):
                names.append(item_id)
                sizes.append(len(found))
                coded.append(numbers.of([found]).astype(np.int32))
                lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
                parts.append(b" ".join(found))
        of_words = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers.names), np.uint64, len(numbers.names))
        del numbers
        hashes, rank = np.unique(of_words, return_inverse=True)
        gap, sizes = np.zeros(window, np.int32), np.array(sizes, np.int64)
        flat = np.concatenate([x for c in coded for x in (rank[c].astype(np.int32) + 1, gap)] or [gap])
        starts = np.cumsum(sizes + window) - (sizes + window)
        used = np.concatenate([np.arange(max(1, n - window + 1)) + at for at, n in zip(starts.tolist(), sizes.tolist(), strict=True)] or [np.zeros(0, np.int64)])
        order, same = ordered(flat, used, window)
        firsts = np.concatenate([np.flatnonzero(~same), [len(order)]]).astype(np.int64)
        places = order[firsts[:-1]]
        width = np.repeat(np.minimum(sizes, window), np.maximum(1, sizes - window + 1))[np.searchsorted(used, places)]
        # Bytes of a word and its blank; the gap after an item has none.
        wide = [np.concatenate([n + 1, np.zeros(window, np.int64)]) for n in lengths]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(wide))]) if wide else np.zeros(1, np.int64)
        blob = np.frombuffer(b"".join(x + b" " for x in parts), np.uint8)
        arrays = (hashes, flat, starts, sizes, places, width.astype(np.int32), firsts, order, offsets, blob)
        return cls(names, window, {name: x.astype(np.int32) if x.dtype == np.int64 and len(x) and x.max() < 2**31 else x for name, x in zip(cls.ARRAYS, arrays, strict=True)})

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, items=np.array(self.items, dtype=object), window=self.window, **{name: getattr(self, name) for name in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tests:
        with np.load(io.BytesIO(data), allow_pickle=True) as found:  # a file of this job's own
            return cls(found["items"].tolist(), int(found["window"]), {name: found[name] for name in cls.ARRAYS})

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words by their hashes, 0 for words that no test has."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0).astype(np.int32)

    def said(self, place: int, size: int) -> bytes:
        return self.blob[int(self.offsets[place]) : int(self.offsets[place + size]) - 1].tobytes()

    def item_at(self, place: int) -> tuple[int, int]:
        """The item that a place lies in, and where in it."""
        k = int(np.searchsorted(self.item_starts, place, "right")) - 1
        return k, place - int(self.item_starts[k])


def ordered(flat: np.ndarray, used: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in used in order of the window words from there, and whether each has the same words as the one before."""
    order, same = used, np.zeros(len(used), bool)
    for k in reversed(range(window)):  # radix sort from the last word
        order = order[np.argsort(flat[order + k], kind="stable")]
    same[1:] = True
    for k in range(window):
        at = flat[order + k]
        same[1:] &= at[1:] == at[:-1]
    return order, same


@lru_cache(maxsize=1)
def block(folder: str, name: str) -> Tests:
    """The last block that a worker has read stays with it."""
    store, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    with store.open_input_stream(f"{base}/{name}") as f:
        return Tests.from_bytes(f.read())


class Coder:
    """Texts to hashes of their words; a worker hashes each distinct word once."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.numbers, self.hashes, self.characters = Numbers(), np.zeros(0, np.uint64), 0

    def __call__(self, split: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.hashes) > REMEMBERED or self.characters > CHARACTERS:
            self.clear()
        at = self.numbers.of(split)
        if new := self.numbers.names[len(self.hashes) :]:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
            self.characters += sum(map(len, new))
        ends = np.cumsum([0, *map(len, split)]).tolist()
        return [self.hashes[at[a:b]] for a, b in zip(ends, ends[1:], strict=False)]


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes with a first id above 0, in order of their first depth ids or more (prefix doubling)."""
    starts = np.flatnonzero(sequence)
    rank, done = sequence.astype(np.int64), 1
    order = starts[np.argsort(rank[starts], kind="stable")]
    while done < depth:
        ahead = np.zeros(len(rank), np.int64)
        ahead[: len(rank) - done] = rank[done:]
        key = rank * (int(rank.max()) + 1) + ahead
        order = starts[np.argsort(key[starts], kind="stable")]
        new = np.concatenate([[1], 1 + np.cumsum(np.diff(key[order]) != 0)])
        rank = np.zeros(len(rank), np.int64)
        rank[order] = new
        done *= 2
        if new[-1] == len(order):
            break
    return order


def compare(sequence: np.ndarray, at: np.ndarray, table: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for each query: how the suffix at `at`, cut to the query's size, stands to the query."""
    columns = np.arange(table.shape[1])
    there = sequence[np.minimum(at[:, None] + columns, len(sequence) - 1)]
    differs = (there != table) & (columns < sizes[:, None])
    first = differs.argmax(axis=1)
    rows = np.arange(len(at))
    return np.where(differs[rows, first], np.sign(there[rows, first].astype(np.int64) - table[rows, first]), 0)


def intervals(sequence: np.ndarray, order: np.ndarray, table: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the interval of order whose suffixes begin with it, by binary search of all queries at once."""
    ends = []
    for past in (0, 1):
        low, high = np.zeros(len(table), np.int64), np.full(len(table), len(order), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            below = compare(sequence, order[np.minimum(middle, len(order) - 1)], table, sizes) < past
            low, high = np.where(open_ & below, middle + 1, low), np.where(open_ & ~below, middle, high)
        ends.append(low)
    return ends[0], ends[1]


def shard(split: list[list[bytes]], hashes: list[np.ndarray], tests: Tests) -> list[tuple[list[tuple[int, int]], list[tuple[object, int, int, int]]]]:
    """For each text, given as words and their hashes: spans of hit words, and longest matches (item, start in it, start in
    text, words)."""
    out: list = [([], []) for _ in split]
    if not len(tests.places) or not split:
        return out
    runs, places, owner, size = [], [], [], 0
    ends = np.cumsum([0, *map(len, hashes)]).tolist()
    every = tests.ids(np.concatenate(hashes))
    for i, (begin, end) in enumerate(zip(ends, ends[1:], strict=False)):
        coded = every[begin:end]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], coded > 0, [0]])))
        for first, past in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if past - first >= tests.shortest:
                runs += [coded[first:past], np.zeros(1, np.int32)]
                places.append(size)
                owner.append((i, first))
                size += past - first + 1
    if not runs:
        return out
    sequence = np.concatenate([*runs, np.zeros(tests.window, np.int32)])
    order = suffix_array(sequence, tests.longest)
    places = np.array(places)
    hits: list[list[tuple[int, int]]] = [[] for _ in split]
    columns = np.arange(tests.window)
    for some in range(0, len(tests.places), AT_ONCE):
        sizes = tests.sizes[some : some + AT_ONCE].astype(np.int64)
        table = tests.flat[tests.places[some : some + AT_ONCE].astype(np.int64)[:, None] + columns]
        low, high = intervals(sequence, order, table, sizes)
        for w in np.flatnonzero(high > low).tolist():
            told = tests.said(int(tests.places[some + w]), int(sizes[w]))
            for at in order[low[w] : high[w]].tolist():
                k = int(np.searchsorted(places, at, "right")) - 1
                text, start = owner[k]
                start += at - int(places[k])
                if b" ".join(split[text][start : start + int(sizes[w])]) == told:
                    hits[text].append((start, some + w))
    for i, own in enumerate(hits):
        if own:
            out[i] = _spans(sorted(own), tests)
    return out


def _spans(own: list[tuple[int, int]], tests: Tests) -> tuple[list, list]:
    """Merged spans of hit words, and matches: chains of windows that go on in text and item alike."""
    spans = _merged([(at, at + int(tests.sizes[w])) for at, w in own])
    going: dict[tuple[int, int], list[int]] = {}
    matches = []
    for at, w in own:
        for place in tests.owners[tests.firsts[w] : tests.firsts[w + 1]].tolist():
            item, start = tests.item_at(place)
            line = (item, at - start)
            if line in going and going[line][2] + 1 == start:
                going[line][2] = start
            else:
                going[line] = chain = [at, start, start]
                matches.append((item, chain))
    found = [(tests.items[item], first, at, last - first + min(tests.window, int(tests.item_sizes[item]))) for item, (at, first, last) in matches]
    return spans, found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch put together."""
    out: list[list[int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns in keep, and n_words (long), hit_spans array<struct<start,end>> in words, apart from each other, items
    array of item ids, and matches array<struct<item_id, item_start, doc_start, n_words>>, the longest verbatim matches.

    Words are runs of ASCII letters, digits and all other non-ASCII characters, A-Z in lower case. A window is `window`
    consecutive words of an item, or all words of a shorter one. Items with a null id, or without words, are never
    found. A null text has no words. Each row is judged by itself: ids may be null or repeat. Columns in keep that bear
    the name of a new one are replaced. The items' size is measured first; they are cut into blocks of about block_bytes, or
    of one item, and each row is searched for one block after another within its task.
    """
    clean = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    total = clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + total // block_bytes
    item = clean.schema["item"].dataType
    span = T.StructType([T.StructField(name, T.IntegerType()) for name in ("start", "end")])
    match = T.StructType([T.StructField("item_id", item), *(T.StructField(name, T.IntegerType()) for name in ("item_start", "doc_start", "n_words"))])
    found = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(item)), T.StructField("matches", T.ArrayType(match))])
    fields = [f for f in docs.schema if f.name in keep and f.name not in found.names]
    folder = new_dir(docs.sparkSession, "tests")
    blocks = clean.repartition(n_blocks, "item").mapInArrow(_write(folder, window), "name string")
    names = sorted(r["name"] for r in blocks.collect())  # one for each block
    rows = docs.select(*(F.col(f.name) for f in fields), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(_search(folder, names, [f.name for f in fields], found), T.StructType([*fields, *found]))


def _write(folder: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [(k, x) for batch in batches for k, x in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        name = f"block-{TaskContext.get().partitionId():05d}"
        if items:
            put(folder, name, Tests.of(items, window).to_bytes())
        yield pa.RecordBatch.from_pydict({"name": [name] * bool(items)}, schema=pa.schema([("name", pa.string())]))

    return run


def _search(folder: str, blocks: list[str], names: list[str], kinds: T.StructType):
    arrow = [to_arrow_type(f.dataType) for f in kinds]
    put_span, put_match = (lambda x, keys=keys: dict(zip(keys, x, strict=True)) for keys in (("start", "end"), ("item_id", "item_start", "doc_start", "n_words")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            for rows, texts in slices(batch, "_text", SLICE if len(blocks) < 2 else LARGE_SLICE):
                split = [words(x) for x in texts]
                hashes = coder(split)
                spans: list[list] = [[] for _ in texts]
                matches: list[list] = [[] for _ in texts]
                for name in blocks:
                    for i, (own, more) in enumerate(shard(split, hashes, block(folder, name))):
                        if own:
                            spans[i] = _merged(sorted([*spans[i], *own]))
                            matches[i] += more
                told = [list(map(len, split)), [list(map(put_span, own)) for own in spans], [sorted({m[0] for m in own}) for own in matches], [list(map(put_match, own)) for own in matches]]
                yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in names), *(pa.array(x, kind) for x, kind in zip(told, arrow, strict=True))], [*names, *kinds.names])

    return run


def hit_words(spans: str = "hit_spans") -> F.Column:
    """Number of words in spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
