"""N-gram Jaccard join by token-combination prefixes.

Documents are sets of word shingles; two link when their Jaccard similarity reaches a threshold. Equal sets are one
class throughout. The join runs in four steps, all of them shuffled by Spark:

1. A window of every set, its e + e/3 + 1 smallest shingle hashes (e: how many shingles a partner may lack), is matched
   on single shingles. Of a set with a partner, more than a third of e must occur in other windows; others leave here.
2. For the rest, shingles get exact document frequencies. A set's order is rare shingles first. Its prefix is extended
   until no partner can avoid it: rare shingles are indexed alone, frequent ones in combinations of K within classes.
3. In each index entry one set, the centre, is verified against the others. Links join components; entries whose sets
   all lie in one component are settled. Small open entries then verify what lies in different components, large ones
   take more centres, until none is open. So a large group of near copies costs about as many pairs as it has sets.
4. Components are found by alternating large-star and small-star steps and go back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.shared import dropped, kept, slices
from pagelore.llm.words import CHARACTERS, REMEMBERED, Numbers

#: Shingles of so many documents or more are frequent, and indexed in combinations of K.
FREQUENT, K = 200, 2
#: An open index entry of at most so many sets verifies its pairs at once; larger ones take so many centres at a time.
SMALL_ENTRY, CENTRES = 8192, 1024
#: So many of a set's least entries tell, where sets meet, whether they have met before.
SKETCH = 64

#: A window has a SPARE-th part more shingles than a partner may lack, and one.
SPARE = 3

#: \x20 and \x09-\x0D part words; A-Z become lower case.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def missing(n, num: int, den: int):
    """How many of its n shingles a set may lack in a partner: n - ceil(num * n / den)."""
    return n - (num * n + den - 1) // den


class Shingler:
    """64-bit hashes of the distinct word n-grams of texts, in ascending order."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.clear()

    def clear(self) -> None:
        self.numbers, self.hashes, self.characters = Numbers(), np.zeros(0, np.uint64), 0

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.hashes) > REMEMBERED or self.characters > CHARACTERS:
            self.clear()
        words = [(text or "").encode().translate(_LOWER).split() for text in texts]
        at = self.numbers.of(words)
        if new := self.numbers.names[len(self.hashes) :]:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
            self.characters += sum(map(len, new))
        every, start, out = self.hashes[at], 0, []
        for size in map(len, words):
            out.append(self._grams(every[start : start + size]))
            start += size
        return out

    def _grams(self, h: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        size = min(self.n, len(h))
        mixed = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            mixed = (mixed ^ (h[i : i + len(mixed)] * _MIX[i % len(_MIX)])) * _MIX[-1 - i % 4]
            mixed ^= mixed >> np.uint64(29)
        mixed.sort()
        return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _windows(docs: DataFrame, shingle: int, num: int, den: int, id_type: str) -> DataFrame:
    """id, node (64-bit name of the set, null if empty), n, and the window, empty in a node's later rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Shingler(shingle), set()
        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                nodes, counts, windows = [], [], []
                for found in own(texts):
                    n = len(found)
                    node = xxhash.xxh3_64_intdigest(found.tobytes(), seed=n) - 2**63 if n else None
                    e = missing(n, num, den)
                    windows.append(found[: e + e // SPARE + 1] if n and node not in seen else found[:0])
                    seen.add(node)
                    nodes.append(node)
                    counts.append(n)
                yield pa.RecordBatch.from_arrays([rows.column("_id"), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), _lists(windows)], ["_id", "node", "n", "window"])

    return docs.mapInArrow(run, f"_id {id_type}, node bigint, n bigint, window array<bigint>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node, n and all shingles of the texts whose set bears the name in column node.

    A text that was given twice may come out twice, which costs time but changes no link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Shingler(shingle), set()
        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                found = []
                for x, node in zip(own(texts), rows.column("node").to_pylist(), strict=True):
                    if node not in seen and len(x) and xxhash.xxh3_64_intdigest(x.tobytes(), seed=len(x)) - 2**63 == node:
                        seen.add(node)
                        found.append((node, x))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), _lists([x for _, x in found])], ["node", "n", "shingles"])

    return docs.select("_text", "node").mapInArrow(run, "node bigint, n bigint, shingles array<bigint>")


def _entry(*parts) -> np.ndarray:
    """64-bit names made of whole numbers or arrays of them."""
    mixed = np.uint64(len(parts))
    with np.errstate(over="ignore"):
        for i, part in enumerate(parts):
            mixed = (mixed ^ (np.asarray(part, np.int64).astype(np.uint64) * _MIX[i])) * _MIX[4 + i]
            mixed = mixed ^ (mixed >> np.uint64(32))
    return mixed.view(np.int64) if isinstance(mixed, np.ndarray) else np.array([mixed]).view(np.int64)


def size_class(n: int, num: int, den: int) -> int:
    """Partners' classes differ by at most one."""
    low, k = 1, 0
    while low <= n:
        low, k = max(low + 1, low * den // num + 1), k + 1
    return k


def signatures(n: int, f: np.ndarray, t: np.ndarray, num: int, den: int, frequent: int = FREQUENT) -> np.ndarray:
    """Index entries of a set of n shingles. f: document frequencies of those that two sets or more have, t: the shingles.

    Shingles of one set alone need no entry and fill the prefix first. A prefix is long enough when more than e of its
    shingles would have to be missing before a partner shares no entry with it; a class of c frequent shingles keeps
    up to K - 1 without making an entry, so it counts as c - K + 1.
    """
    least = missing(n, num, den) + 1 - (n - len(t))
    if least <= 0:
        return t[:0]
    order = np.lexsort((t, f))
    f, t = f[order], t[order]
    rare = int(np.searchsorted(f, frequent))
    out = [_entry(t[: min(least, rare)])]
    least -= rare
    if least <= 0:
        return out[0]
    often = t[rare:]
    own = size_class(n, num, den)
    for k in (own - 1, own):  # named after the smaller partner's class
        smallest = 1
        for _ in range(k - 1):
            smallest = max(smallest + 1, smallest * den // num + 1)
        classes = max(1, missing(smallest, num, den) // 8)
        if smallest < 4 * (classes + 1) * K:  # too short to spare K - 1 shingles a class
            out.append(_entry(k, often[:least]))
            continue
        group = often % classes
        by = np.argsort(group, kind="stable")
        first = np.searchsorted(group[by], group[by])
        place = np.zeros(len(often), np.int64)
        place[by] = np.arange(len(often)) - first  # within its class
        covers = np.cumsum(place >= K - 1)
        if len(covers) and covers[-1] >= least:
            used = int(np.searchsorted(covers, least)) + 1
        else:  # the set is used up before the prefix is long enough
            used = len(often)
            out.append(_entry(k, -1, often))
        for c in np.unique(group[:used]):
            held = often[:used][group[:used] == c]
            a, b = np.triu_indices(len(held), 1)
            out.append(_entry(k, held[a], held[b]))
    return np.unique(np.concatenate(out))


def _entries(sets: DataFrame, num: int, den: int, frequent: int) -> DataFrame:
    """entry, node, n, and r, the number of shingles that another set has too."""
    shingles = sets.select("node", F.explode("shingles").alias("t"))
    shared = shingles.groupBy("t").agg(F.count("*").alias("f")).where(F.col("f") > 1)
    common = shingles.join(shared, "t").groupBy("node").agg(F.collect_list(F.struct("f", "t")).alias("common"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, nodes, counts = batch.column("common"), batch.column("node").to_numpy(), batch.column("n").to_numpy()
            ends = common.offsets.to_numpy()
            f, t = (common.values.field(i).to_numpy() for i in (0, 1))
            for low in range(0, batch.num_rows, 200):
                rows = range(low, min(low + 200, batch.num_rows))
                found = [signatures(int(counts[i]), f[ends[i] : ends[i + 1]], t[ends[i] : ends[i + 1]], num, den, frequent) for i in rows]
                at = np.repeat(np.array(rows), list(map(len, found)))
                shared_ = (ends[1:] - ends[:-1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.concatenate(found), nodes[at], counts[at], shared_[at])], ["entry", "node", "n", "r"])

    return sets.select("node", "n").join(common, "node").mapInArrow(run, "entry bigint, node bigint, n bigint, r bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); component is the smallest node reachable."""
    edges = links.select("a", "b").where("a <> b")
    done = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
        before, edges = edges, kept(small.distinct(), "edges")
        if done is not None:
            dropped(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == done:
            labels = kept(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct()), "labels")
            dropped(edges)
            return labels
        done = state


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    own = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    other = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(own, "b").join(other, "a").withColumn("both", both).where(F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num).select("a", "b")


def _links(entries: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame | None:
    """node and component of all linked sets; None if nothing shares an entry.

    A pair's intersection is at most the smaller number of shingles that either set has in common with any set, which
    rules out most pairs before they are verified. Centres are sets of small components with few shingles of their
    own: in a group of near copies that is the text they all come from.
    """
    fits = f"least(r, rc) * {num + den} >= {num} * (n + nc)"
    labels, open_ = None, entries
    while True:
        if labels is None:
            now = open_.withColumns({"component": F.col("node"), "weight": F.lit(1).cast("long")})
        else:
            weights = labels.groupBy("component").agg(F.count("*").alias("weight"))
            now = open_.join(labels.join(weights, "component"), "node", "left").withColumns({"component": F.coalesce("component", "node"), "weight": F.coalesce("weight", F.lit(1))})
        live = now.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high").select("entry", "size")
        rows = kept(now.join(live, "entry"), "open")
        if rows.isEmpty():
            dropped(rows)
            return labels
        first = labels is None
        large = rows if first else rows.where(F.col("size") > SMALL_ENTRY)
        group = F.lit(0) if first else F.pmod("node", F.lit(CENTRES))
        centre = F.min(F.struct("weight", ((F.col("n") - F.col("r")) / F.col("n")).alias("own"), "node", "n", "r", "component")).alias("c")
        centres = large.groupBy("entry", group.alias("_group")).agg(centre).select("entry", F.col("c.node").alias("a"), F.col("c.n").alias("nc"), F.col("c.r").alias("rc"), F.col("c.component").alias("cc"))
        if not first:
            centres = kept(centres, "centres")
        pairs = large.join(centres, "entry").where("node <> a and component <> cc").where(fits).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        if not first:
            small = rows.where(F.col("size") <= SMALL_ENTRY)
            order = Window.partitionBy("node").orderBy("entry")
            least = F.collect_list(F.when(F.col("_k") <= SKETCH, F.col("entry"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
            small = small.withColumn("_k", F.row_number().over(order)).select("entry", "node", "n", "r", "component", least.alias("before"))
            other = small.select("entry", F.col("node").alias("a"), F.col("n").alias("nc"), F.col("r").alias("rc"), F.col("component").alias("cc"), F.col("before").alias("other_before"))
            # One filter, so that the costly test comes last: a pair is emitted where its sets meet first, and maybe
            # again where they met before outside both sketches.
            apart = F.expr(f"a < node and component <> cc and {fits}")
            met = small.join(other, "entry").where(apart & ~F.arrays_overlap("before", "other_before"))
            pairs = pairs.union(met.select("a", F.col("node").alias("b")))
        pairs = kept(pairs.distinct(), "pairs")
        found = _verified(pairs, sets, num, den)
        links = found if first else found.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        links = kept(links, "links")
        older, labels = labels, components(links)
        settled = centres.select("entry", F.col("a").alias("node"))
        left = kept(large.join(settled, ["entry", "node"], "left_anti").select("entry", "node", "n", "r"), "left")
        dropped(open_, rows, pairs, links, older, None if first else centres)
        open_ = left


def jaccard_components(docs: DataFrame, shingle: int = 4, num: int = 85, den: int = 100, text: str = "text", doc_id: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles (long) and component_id, the smallest doc_id reachable by links, for each row of docs.

    Words are parted by \\x20 and \\x09-\\x0D, A-Z in lower case; a text of fewer words than a shingle is one shingle.
    Two sets link when den * intersection >= num * union. A null, empty or blank text has an empty set and links with
    nothing. Rows that repeat an id are linked by their own texts. A null id takes part, and its component_id is the
    smallest id that is not null, or null. Sets and shingles are named by 64-bit hashes.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    windows = kept(_windows(own, shingle, num, den, id_type), "windows")
    members = kept(windows.select("_id", "node", "n"), "members")
    return _joined(own, windows, members, shingle, num, den, frequent).select(F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def _joined(own: DataFrame, kept_windows: DataFrame, members: DataFrame, shingle: int, num: int, den: int, frequent: int) -> DataFrame:
    windows = kept_windows.select("node", F.explode("window").alias("t"))
    shared = windows.groupBy("t").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("t")
    smaller = f"(({num} * n + {den - 1}) div {den})"
    lacking = f"({smaller} - ({num} * {smaller} + {den - 1}) div {den})"
    found = windows.join(shared, "t").groupBy("node").agg(F.count_distinct("t").alias("k"))
    sizes = members.groupBy("node").agg(F.first("n").alias("n"))
    partnered = kept(found.join(sizes, "node").where(f"k > ({lacking}) div {SPARE}").select("node"), "partnered")
    dropped(kept_windows)
    one = members.join(partnered, "node").groupBy("node").agg(F.min("_id").alias("_id"))
    chosen = one.select(F.col("_id").alias("_chosen"), "node")
    sets = kept(_sets(own.join(chosen, F.col("_id").eqNullSafe(F.col("_chosen"))), shingle), "sets")
    dropped(partnered)
    labels = _links(kept(_entries(sets, num, den, frequent), "entries"), sets, num, den)
    dropped(sets)
    least = members.where("node is not null").groupBy("node").agg(F.min("_id").alias("least"))
    if labels is None:
        named = least.select("node", F.col("least").alias("component_id"))
    else:
        whole = least.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = whole.join(whole.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    return members.join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", F.when(F.col("node").isNull(), F.col("_id"))))
