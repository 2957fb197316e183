"""SentencePiece encoding and decoding with offsets.

A text is normalised by longest prefixes of the model's compiled character map while the source offset of every
normalised byte is noted. A copy of the model that no longer normalises encodes the result, and the lengths of the
pieces, summed up, project each piece to a span of source bytes. In a BPE model without pieces that go on over a word's
end each word's pieces are its own, so the model is asked once for each distinct word of a worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.shared import slices
from pagelore.llm.words import WordTable, by_text

SPACE = "▁"
BYTE, CONTROL, UNKNOWN = 6, 3, 2
BPE = 2
#: A word with the marks before it, or marks at the end.
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")


def mapped_strings(blob: bytes) -> dict[bytes, bytes]:
    """The compiled character map's entries: a 4-byte length, a double-array trie of 32-bit units, then the results,
    each ended by a zero byte. All children of a level of the trie are tried at once."""
    if not blob:
        return {}
    n = int.from_bytes(blob[:4], "little")
    units, results = np.frombuffer(blob, "<u4", n // 4, 4), blob[4 + n :]
    jump = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    found, level, symbols = {}, {b"": int(jump(units[0]))}, np.arange(1, 256, dtype=np.uint32)
    while level:
        below = {}
        for prefix, at in level.items():
            places = symbols ^ np.uint32(at)
            fits = places < len(units)
            held = units[np.where(fits, places, 0)]
            for symbol in symbols[fits & ((held & 0x800000FF) == symbols)]:
                place = at ^ int(symbol)
                unit, key = int(units[place]), prefix + bytes([symbol])
                if (unit >> 8) & 1:
                    start = int(units[place ^ jump(unit)]) & 0x7FFFFFFF
                    found[key] = results[start : results.index(b"\0", start)]
                below[key] = place ^ jump(unit)
        level = below
    return found


class Normaliser:
    """What the model's normaliser does, with the source byte of each normalised byte.

    __call__ gives the normalised bytes and an array one longer: the source offset at which each byte's source begins,
    at last the length of the source.
    """

    def __init__(self, spec) -> None:
        mapped = {k.decode(): v.decode() for k, v in mapped_strings(spec.precompiled_charsmap).items()}
        self.mapped, self.longest = mapped, max(map(len, mapped), default=0)
        self.first = re.compile("[" + re.escape("".join(sorted({k[0] for k in mapped}))) + "]") if mapped else None
        self.squeeze, self.prefix, self.escape = spec.remove_extra_whitespaces, spec.add_dummy_prefix, spec.escape_whitespaces

    def replaced(self, text: str) -> tuple[bytes, np.ndarray]:
        source = text.encode()
        if not (self.first and self.first.search(text)):
            return source, np.arange(len(source) + 1)
        out, offsets, at, byte = [], [], 0, 0
        while at < len(text):
            key = next((text[at : at + n] for n in range(min(self.longest, len(text) - at), 0, -1) if text[at : at + n] in self.mapped), None)
            size = len((key or text[at]).encode())
            put = (self.mapped[key] if key else text[at]).encode()
            out.append(put)
            offsets.append(np.full(len(put), byte) if key else np.arange(byte, byte + size))
            at, byte = at + len(key or " "), byte + size
        return b"".join(out), np.concatenate([*offsets, [byte]]).astype(np.int64)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        changed, offsets = self.replaced(text)
        data = np.frombuffer(changed, np.uint8)
        blank = data == 32
        if self.squeeze and len(data):
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            if len(stays := np.flatnonzero(keep)) and blank[stays[-1]]:
                keep[stays[-1]] = False
            data, blank, offsets = data[keep], blank[keep], np.concatenate([offsets[:-1][keep], offsets[-1:]])
        if not len(data):
            return b"", offsets[-1:] * 0 if not len(text) else offsets[-1:]
        mark = SPACE.encode() if self.escape else b" "
        if self.escape:
            widths = np.where(blank, len(mark), 1)
            ends = np.cumsum(widths)
            wide = np.repeat(data, widths)
            for i, value in enumerate(mark):
                wide[(ends - len(mark) + i)[blank]] = value
            data, offsets = wide, np.concatenate([np.repeat(offsets[:-1], widths), offsets[-1:]])
        if self.prefix:
            data = np.concatenate([np.frombuffer(mark, np.uint8), data])
            offsets = np.concatenate([np.full(len(mark), offsets[0]), offsets])
        return data.tobytes(), offsets


class Pieces:
    """Encoder and decoder of one model file, both exact and with source spans."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        self.normalise = Normaliser(model.normalizer_spec)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.widths = np.array([1 if p.type == BYTE else 0 if p.type in (CONTROL, UNKNOWN) else len(p.piece.encode()) for p in model.pieces])
        model.normalizer_spec.precompiled_charsmap = b""
        model.normalizer_spec.name = "identity"
        for flag in ("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces"):
            setattr(model.normalizer_spec, flag, False)
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.by_word = model.trainer_spec.model_type == BPE and not any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in model.pieces if p.type not in (CONTROL, UNKNOWN, BYTE))
        self.words = WordTable(self._encode_words, np.dtype(np.int32))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """words lack the mark that each begins with."""
        found = self.plain.encode([SPACE + w for w in words], num_threads=1)
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        split = []
        for x in texts:
            if not self.by_word or not x.startswith(SPACE):
                split.append([])
            elif SPACE * 2 in x or x.endswith(SPACE):
                split.append([w[1:] for w in UNIT.findall(x)])
            else:
                split.append(x[1:].split(SPACE))
        ids, _, sizes = self.words(split)
        return [np.array(self.plain.encode(x, num_threads=1), np.int32) if x and not words else own for x, words, own in zip(texts, split, by_text(ids, sizes, split), strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text its ids, and the first and last-but-one byte of each piece's source."""
        normalised = [self.normalise(x) for x in texts]
        plain = [x.decode() for x, _ in normalised]
        out = []
        for ids, x, (data, offsets) in zip(self._ids(plain), plain, normalised, strict=True):
            widths = self.widths[ids]
            if widths.sum() != len(data):  # an unknown piece: its width is that of its own text
                widths = np.array([len(p.surface.encode()) for p in self.plain.encode(x, out_type="immutable_proto").pieces])
            ends = np.cumsum(widths)
            out.append((ids, offsets[ends - widths].astype(np.int32), offsets[ends].astype(np.int32)))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode(ids, num_threads=1)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and ids, span_starts, span_ends (array<int>) and decoded (string) of each whole text.

    model is the path of a model file that every machine has. Spans count bytes of the UTF-8 source; a piece made of
    the prefix alone has an empty span. A null or empty text has no pieces and decodes to the empty string. Rows come
    out once each, whatever their ids. Columns in keep that bear one of the four names are replaced.
    """
    fields = [f for f in df.schema if f.name in keep and f.name not in ("ids", "span_starts", "span_ends", "decoded")]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["ids array<int>, span_starts array<int>, span_ends array<int>, decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                coded = own.encode([x or "" for x in texts])
                ends = np.cumsum([0] + [len(x[0]) for x in coded]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[i] for x in coded]))) for i in range(3)]
                decoded = pa.array(own.decode([x[0].tolist() for x in coded]), pa.string())
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in fields), *lists, decoded], [*(f.name for f in fields), "ids", "span_starts", "span_ends", "decoded"])

    return df.select(*(F.col(f.name) for f in fields), F.col(text).cast("string").alias("_text")).mapInArrow(run, out)
