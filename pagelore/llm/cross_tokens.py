"""Cross-tokenizer alignment: which ids of one tokenizer stand for the same bytes as which ids of another.

Rows are shuffled by their full text, so that each distinct text is tokenised and aligned once, whatever its number of
copies. Offsets where tokens of both end cut a text into groups; the tokens of a group are linked. An id pair counts for as
many rows as bear a text with it. Measures of a text go back to its rows by the text's SHA-256.

Neither tokenizer joins what lies on both sides of a blank that follows a visible character, so a text is cut there into
units, and each distinct unit of a worker is tokenised and aligned once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.pieces import BYTE, CONTROL, SPACE, UNKNOWN, Pieces
from pagelore.llm.shared import dropped, kept, slices
from pagelore.llm.words import CHARACTERS, REMEMBERED, Numbers

#: So many id pairs are broadcast at most, after they are counted (about 40 bytes each); more are joined by a shuffle, in
#: which pairs are dealt over so many salts.
BROADCAST_PAIRS, SALTS = 2_000_000, 16
#: Groups of more links than this are counted by distinct ids instead of link by link.
LONG_GROUP = 4096
_CUT = re.compile(r"(?<=\S)(?= )")
#: A blank after white space other than a blank, or several blanks: only then a text isn't cut at every blank.
_ODD = re.compile(r"\s ")


class ByteLevel:
    """Ids of units and each id's bytes, for a byte-level BPE tokenizer's file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        before = told.get("pre_tokenizer") or {}
        self.by_unit = not told.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        level = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(level[c] for c in token) if all(c in level for c in token) else token.encode()

    def __call__(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


class PieceLevel:
    """The same for a piece model that puts a blank before a text; units begin with it or follow a visible character."""

    def __init__(self, path: str) -> None:
        pieces = Pieces(path)
        self.plain, self.by_unit = pieces.plain, pieces.by_word and not (pieces.normalise.mapped or pieces.normalise.squeeze) and pieces.normalise.prefix and pieces.normalise.escape
        self.whole, self.bytes = pieces.whole, []
        for i in range(self.plain.get_piece_size()):
            piece = self.plain.id_to_piece(i)
            kind = BYTE if self.plain.is_byte(i) else CONTROL if self.plain.is_control(i) else UNKNOWN if self.plain.is_unknown(i) else 0
            self.bytes.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else b"" if kind else piece.replace(SPACE, " ").encode())

    def __call__(self, units: list[str]) -> list[list[int]]:
        return self.plain.encode([x.replace(" ", SPACE) for x in units], num_threads=1) if self.by_unit else self.whole.encode([x[1:] for x in units], num_threads=1)


class Aligner:
    """Per distinct unit: ids, groups and linked pairs. A text is the sum of its units."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), PieceLevel(path_b)
        self.by_unit = self.a.by_unit and self.b.by_unit
        self.widths = [np.array(list(map(len, x.bytes)), np.int64) for x in (self.a, self.b)]
        self.names = [list(map(str, range(len(x.bytes)))) for x in (self.a, self.b)]
        self.clear()

    def clear(self) -> None:
        self.numbers, self.characters, self.groups = Numbers(), 0, []
        #: By unit: tokens of a, of b, groups, links, and 1 if the bytes differ.
        self.sums = np.zeros((0, 5), np.int64)
        self.starts, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def units(self, text: str) -> list[str]:
        whole = " " + text
        if not self.by_unit:
            return [whole]
        if _ODD.search(whole):
            return _CUT.split(whole)
        return [" " + x for x in whole[1:].split(" ")] if not whole.endswith(" ") else _CUT.split(whole)

    def _same(self, unit: str, a: list[int], b: list[int]) -> bool:
        raw = unit.encode()
        return b"".join(map(self.a.bytes.__getitem__, a)) == raw == b"".join(map(self.b.bytes.__getitem__, b))

    def _add(self, new: list[str]) -> None:
        """Aligns all new units in a row: the end of a unit is an end of a group, so none goes on over it."""
        ids = [self.a(new), self.b(new)]
        same = [self._same(u, a, b) for u, a, b in zip(new, *ids, strict=True)]
        if not all(same):
            ids = [[x if s else [] for x, s in zip(own, same, strict=True)] for own in ids]
        sizes = [np.fromiter(map(len, own), np.int64, len(new)) for own in ids]
        flat = [np.fromiter(chain.from_iterable(own), np.int64, int(n.sum())) for own, n in zip(ids, sizes, strict=True)]
        ends = [np.cumsum(w[x]) for w, x in zip(self.widths, flat, strict=True)]
        cuts = np.intersect1d(*ends)
        first = [np.concatenate([[0], np.searchsorted(e, cuts, "right")]) for e in ends]  # tokens before each group
        counts = [np.diff(x) for x in first]
        unit = np.searchsorted(np.cumsum(sizes[0]), first[0][:-1], "right")
        product = counts[0] * counts[1]
        short = product <= LONG_GROUP
        of = np.repeat(np.arange(len(cuts)), np.where(short, product, 0))
        k = np.arange(len(of)) - np.repeat(np.cumsum(np.where(short, product, 0)) - np.where(short, product, 0), np.where(short, product, 0))
        links = [unit[of], flat[0][first[0][of] + k // np.maximum(counts[1][of], 1)] << 32 | flat[1][first[1][of] + k % np.maximum(counts[1][of], 1)], np.ones(len(of), np.int64)]
        for g in np.flatnonzero(~short).tolist():
            (a, n), (b, m) = (np.unique(x[f[g] : f[g + 1]], return_counts=True) for x, f in zip(flat, first, strict=True))
            more = [np.full(len(a) * len(b), unit[g]), (a[:, None] << 32 | b).ravel(), np.outer(n, m).ravel()]
            links = [np.concatenate(x) for x in zip(links, more, strict=True)]
        order = np.lexsort((links[1], links[0]))
        of, pairs, times = (x[order] for x in links)
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(pairs) != 0)])) if len(of) else np.zeros(0, np.int64)
        held = np.bincount(of[begins], minlength=len(new))
        self.pairs, self.times = np.concatenate([self.pairs, pairs[begins]]), np.concatenate([self.times, np.add.reduceat(times, begins) if len(begins) else times[:0]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(held)])
        n_groups = np.bincount(unit, minlength=len(new))
        n_links = np.bincount(unit, product, minlength=len(new)).astype(np.int64)
        self.sums = np.concatenate([self.sums, np.stack([*sizes, n_groups, n_links, ~np.array(same, bool)], axis=1)])
        self._tell(flat, first, n_groups)

    def _tell(self, flat: list[np.ndarray], first: list[np.ndarray], n_groups: np.ndarray) -> None:
        a, b = ([names[i] for i in x.tolist()] for names, x in zip(self.names, flat, strict=True))
        fa, fb = (x.tolist() for x in first)
        told = [f"{a[fa[g]]}|{b[fb[g]]}" if fa[g + 1] - fa[g] == 1 == fb[g + 1] - fb[g] else ",".join(a[fa[g] : fa[g + 1]]) + "|" + ",".join(b[fb[g] : fb[g + 1]]) for g in range(len(fa) - 1)]
        cuts = np.cumsum([0, *n_groups]).tolist()
        self.groups += [";".join(told[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Of each text: sums, groups as text, distinct linked pairs (a << 32 | b) and how often each is linked."""
        if len(self.groups) > REMEMBERED or self.characters > CHARACTERS:
            self.clear()
        split = [self.units(x) if x and SPACE not in x else [] for x in texts]
        at = self.numbers.of(split)
        if new := self.numbers.names[len(self.groups) :]:
            self.characters += sum(map(len, new))
            self._add(new)
        ends = np.cumsum([0, *map(len, split)]).tolist()
        out = []
        for begin, end in zip(ends, ends[1:], strict=False):
            own = at[begin:end]
            sums = self.sums[own].sum(axis=0)
            if begin == end or sums[4]:
                out.append((np.zeros(5, np.int64), "", self.pairs[:0], self.times[:0]))
                continue
            units, often = np.unique(own, return_counts=True)
            sizes = self.starts[units + 1] - self.starts[units]
            ends_ = np.cumsum(sizes)
            place = np.repeat(self.starts[units] - (ends_ - sizes), sizes) + np.arange(int(ends_[-1]))
            pairs, inverse = np.unique(self.pairs[place], return_inverse=True)
            times = np.bincount(inverse, self.times[place] * np.repeat(often, sizes), minlength=len(pairs)).astype(np.int64)
            out.append((sums, ";".join(map(self.groups.__getitem__, own.tolist())), pairs, times))
        return out


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Of each row of texts (key, n, text): key, n, n_a, n_b, n_groups, n_links, groups, pairs and times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            for rows, found in slices(batch, "text"):
                made = own(found)
                sums = np.array([x[0] for x in made], np.int64).reshape(-1, 5)
                ends = pa.array(np.cumsum([0, *(len(x[2]) for x in made)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i] for x in made]), kind)) for i, kind in ((2, pa.int64()), (3, pa.int64()))]
                yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("n"), *(pa.array(sums[:, i]) for i in range(4)), pa.array([x[1] for x in made], pa.string()), *lists], ["key", "n", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return texts.select("key", "n", "text").mapInArrow(run, "key binary, n bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>")


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id", broadcast_pairs: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(measures, pairs). measures: a row of docs each, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and
    groups_sha256. pairs: a, b, count and best (whether it is the highest count of a).

    path_a is a byte-level BPE tokenizer's file, path_b a piece model's; a text gets a blank before it. Texts that are
    null or empty, or whose tokens' bytes differ from it, have no tokens: zeros and an empty groups_sha256. Ids may be
    null or repeat; each row counts. Other columns of docs are not read.
    """
    rows = docs.select(F.col(doc_id), F.col(text).cast("string").alias("_text"))
    distinct = rows.where("_text <> ''").groupBy("_text").agg(F.count("*").alias("n"))
    key = F.unhex(F.sha2("_text", 256)).alias("key")
    told = aligned_texts(distinct.select(key, "n", F.col("_text").alias("text")), path_a, path_b).where("n_a > 0")
    texts = kept(told.withColumn("groups_sha256", F.sha2("groups", 256)).drop("groups"), "aligned")
    counts = texts.select("n", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count"))
    counted = kept(counts.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))}), "counts")
    most = counted.groupBy("a").agg(F.max("count").alias("most"))
    pairs = kept(counted.join(most, "a").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")
    dropped(counted)
    links = texts.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("_l")).select("key", F.col("_l.pairs").alias("pair"), F.col("_l.times").alias("times"))
    known = pairs.select("pair", "count", "best")
    if pairs.count() <= broadcast_pairs:
        joined = links.join(F.broadcast(known), "pair")
    else:  # a common pair is linked in most texts
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        joined = links.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(known.select("*", salts), ["pair", "_salt"])
    sums = joined.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    measured = texts.select("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "key")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    measures = rows.select(doc_id, key).join(measured, "key", "left").select(doc_id, *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return measures, pairs.select("a", "b", "count", "best")
