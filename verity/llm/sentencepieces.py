"""SentencePiece encoding and decoding with spans in the original text (operator 1)."""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from verity.llm.common import pieces, utf8

SPACE = "▁".encode()


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: (number, integer or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
        yield key >> 3, message[at : at + size]
        at += size


class Normaliser:
    """Longest-prefix normalisation through a compiled character map, with the source of every byte made.

    The map is a double-array trie of UTF-8 keys followed by the zero-ended replacements that its values point at.
    """

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True):
        self.dummy_prefix, self.squeeze, self.escape = dummy_prefix, squeeze, escape
        size = struct.unpack("<I", charsmap[:4])[0] if charsmap else 0
        self.units = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist() if charsmap else []
        self.replacements = charsmap[4 + size :]
        self.starts = np.zeros(256, bool)
        for byte in range(1, 256) if self.units else ():
            self.starts[byte] = self._child(0, byte) is not None

    def _child(self, node: int, byte: int) -> int | None:
        unit = self.units[node]
        child = node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6)) ^ byte
        return child if child < len(self.units) and self.units[child] & ((1 << 31) | 255) == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        node, found = 0, None
        for k in range(at, len(data)):
            child = self._child(node, data[k]) if data[k] else None
            if child is None:
                break
            node = child
            unit = self.units[node]
            if unit >> 8 & 1:
                leaf = self.units[node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))]
                value = leaf & 0x7FFFFFFF
                found = k + 1 - at, self.replacements[value : self.replacements.index(b"\0", value)]
        return found

    def _mapped(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after the map and the source offset of each. Only places where a key can start are walked."""
        raw, out, source, done = data.tobytes(), [], [], 0
        for at in np.flatnonzero(self.starts[data]).tolist():
            if at < done or raw[at] & 0xC0 == 0x80:
                continue
            if (hit := self.longest(raw, at)) is not None:
                out += [data[done:at], np.frombuffer(hit[1], np.uint8)]
                source += [np.arange(done, at), np.full(len(hit[1]), at)]
                done = at + hit[0]
        return np.concatenate([*out, data[done:]]), np.concatenate([*source, np.arange(done, len(data))])

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes, and for each of them and the end its offset in the original bytes."""
        end = len(data)
        if self.units:
            data, source = self._mapped(data)
        else:
            source = np.arange(end)
        if self.squeeze:  # no spaces at the ends, one at most elsewhere
            blank = data == 32
            keep = ~blank
            keep[1:] |= blank[1:] & ~blank[:-1]
            solid = np.flatnonzero(~blank)
            last = solid[-1] + 1 if len(solid) else 0
            keep[: solid[0] if len(solid) else len(data)] = False
            keep[last:] = False
            if last < len(data):
                end = int(source[last])
            data, source = data[keep], source[keep]
        if self.dummy_prefix and len(data):
            data, source = np.concatenate([[np.uint8(32)], data]), np.concatenate([source[:1], source])
        if self.escape and (data == 32).any():
            blank = data == 32
            times = np.where(blank, len(SPACE), 1)
            places = np.cumsum(times) - times
            source = np.repeat(source, times)
            wide = np.repeat(data, times)
            for k, byte in enumerate(SPACE):
                wide[places[blank] + k] = byte
            data = wide
        return data, np.append(source, end)


class Codec:
    """A model with its normaliser and, for each id, the length of the piece in normalised bytes."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        lengths, spec = [], {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                # 2 unknown, 3 control, 6 byte: these stand for no fixed text
                lengths.append({2: -1, 3: 0, 6: 1}.get(piece.get(3, 1), len(piece[1])))
            elif number == 3:
                spec = dict(_fields(value))
        self.lengths = np.array(lengths, np.int64)
        self.normaliser = Normaliser(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))

    def spans(self, data: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each id in the original bytes. Control ids get an empty span."""
        normal, source = self.normaliser(data)
        sizes = self.lengths[ids]
        if (sizes < 0).any():  # an unknown piece is what lies between its neighbours
            if (sizes < 0).sum() > 1:
                raise ValueError("spans need a model with byte fallback")
            sizes = np.where(sizes < 0, len(normal) - sizes[sizes >= 0].sum(), sizes)
        ends = np.cumsum(sizes)
        if len(ids) and ends[-1] != len(normal):
            raise ValueError(f"pieces cover {ends[-1]} of {len(normal)} normalised bytes")
        return source[ends - sizes], source[ends]


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text with begin and end ids, give each id's span, and decode the ids again.

    Returns id_col, ids, begins and ends (packed little-endian unsigned 32-bit integers, one per id; spans count
    bytes of the original UTF-8 text, end exclusive) and decoded. ``model_path`` is a file that every worker has.

    Null text counts as empty and gives the begin and end ids only. Any length, repeated rows, null ids and an
    empty table are fine; a row is given for each row. Other columns are not read.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("ids", T.BinaryType()),
            T.StructField("begins", T.BinaryType()),
            T.StructField("ends", T.BinaryType()),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path)
        for batch in batches:
            for part in pieces(batch, "_text"):
                data, offsets = utf8(part.column("_text"))
                texts = ["" if t is None else t for t in part.column("_text").to_pylist()]
                coded = model.processor.encode(texts, add_bos=True, add_eos=True, enable_sampling=False, num_threads=1)
                packed, begins, ends = [], [], []
                for k, ids in enumerate(coded):
                    ids = np.array(ids, "<u4")
                    b, e = model.spans(data[offsets[k] : offsets[k + 1]], ids)
                    packed.append(ids.tobytes())
                    begins.append(b.astype("<u4").tobytes())
                    ends.append(e.astype("<u4").tobytes())
                decoded = model.processor.decode(coded) if coded else []
                columns = [part.column(0), pa.array(packed, pa.binary()), pa.array(begins, pa.binary()), pa.array(ends, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text").mapInArrow(run, schema)
