"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by longest-prefix replacement through the model's compiled character map (a double-array trie) while
the source byte of every normalised byte is recorded; the model's merges run on the normalised text; every piece is then
projected through that record to the bytes of the source that it came from.

Merges cannot cross two neighbouring characters that no piece holds side by side. Where the vocabulary allows it, the
normalised text is therefore cut before each word mark and around line feeds, equal segments are encoded once per task and
whole texts are put together from them; the ids are the same as for the uncut text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
#: Segments a task remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 300_000, 64


class CharMap:
    """The compiled character map: a byte count, that many bytes of double-array units, then replacements ended by NUL."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes consumed) of the longest key that ``data`` has at ``at``."""
        units, found = self.units, None
        if not units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node = step(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if not found:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


class Normalizer:
    def __init__(self, spec, suffix: bool):
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix
        self.space = MARK.encode() if self.escape else b" "
        self.plain = not self.map.units and not self.squeeze

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source offset of each of them and of the end)."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            src = np.frombuffer(data, np.uint8)
            wide = len(self.space)
            offsets = np.repeat(np.arange(len(src)), np.where(src == 32, wide, 1)) if wide > 1 else np.arange(len(src))
            out, pad = data.replace(b" ", self.space), np.zeros(wide, np.int64)
            if self.dummy:
                out = out + self.space if self.suffix else self.space + out
                offsets = np.concatenate([offsets, pad + len(src)] if self.suffix else [pad, offsets])
            return out, np.append(offsets, len(src))
        return self._general(data)

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        if found := self.map.longest(data, at):
            return found
        n = 1 if data[at] < 0xC0 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return data[at : at + n], n

    def _general(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, offsets, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(data) and (got := self._prefix(data, at))[0] == b" ":
                at += got[1]
            if at == len(data):
                return b"", np.zeros(1, np.int64)

        def put(piece: bytes, source: int) -> None:
            piece = piece.replace(b" ", self.space)
            out.extend(piece)
            offsets.extend([source] * len(piece))

        if self.dummy and not self.suffix:
            put(b" ", at)
        after_space = self.squeeze
        while at < len(data):
            piece, n = self._prefix(data, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece, at)
                after_space = self.squeeze and piece.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                at = offsets[len(out)]
                del offsets[len(out) :]
        if self.dummy and self.suffix:
            put(b" ", at)
        return bytes(out), np.array([*offsets, at], np.int64)


def _u4(x: int) -> bytes:
    return x.to_bytes(4, "little")


class Encoder:
    """encode(text) -> (ids, begins, ends) with spans in bytes of the source; decode(ids) -> text."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.proc = sentencepiece.SentencePieceProcessor(model_proto=model)
        m = proto.ModelProto()
        m.ParseFromString(model)
        self.normalize = Normalizer(m.normalizer_spec, m.trainer_spec.treat_whitespace_as_suffix)
        bare = m.normalizer_spec
        bare.precompiled_charsmap, bare.add_dummy_prefix, bare.remove_extra_whitespaces, bare.name = b"", False, False, "identity"
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
        kinds = proto.ModelProto.SentencePiece
        self.packed = [_u4(i) for i in range(len(m.pieces))]
        self.width = [_u4(1 if p.type == kinds.BYTE else len(p.piece.encode())) for p in m.pieces]
        whole = {p.piece for p in m.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)}
        self.exact_width = m.trainer_spec.byte_fallback
        cut = self.exact_width and m.trainer_spec.model_type == proto.TrainerSpec.BPE and not any(p.type == kinds.USER_DEFINED for p in m.pieces)
        if cut and not any(MARK in p.lstrip(MARK) for p in whole):
            lone = "\n" if not any("\n" in p and len(p) > 1 for p in whole) else ""
            self.cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if lone else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        else:
            self.cut = lambda text: [text] if text else []
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _widths(self, segment: str) -> bytes:
        got = self.merges.encode(segment, return_type="proto")
        return b"".join([_u4(len(p.surface.encode())) for p in got.pieces])

    def encode(self, text: str, ends: bool = True) -> tuple[bytes, bytes, bytes]:
        """Ids, first and last source byte (exclusive) of each piece, all as little-endian unsigned 32-bit integers."""
        normal, source = self.normalize(text)
        segments = self.cut(normal.decode())
        known = self.known
        new = [s for s in set(segments) if s not in known]
        extra, packed, width = {}, self.packed, self.width
        for s, ids in zip(new, self.merges.encode(new, num_threads=1) if new else [], strict=True):
            extra[s] = (b"".join([packed[i] for i in ids]), b"".join([width[i] for i in ids]) if self.exact_width else self._widths(s))
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                parts = None
            else:
                known.update((s, v) for s, v in extra.items() if len(s) <= LONGEST)
                parts = [known.get(s) or extra[s] for s in segments]
            if parts is None:
                return self.encode(text, ends)
        else:
            parts = [known[s] for s in segments]
        ids = b"".join([p[0] for p in parts])
        to = np.cumsum(np.frombuffer(b"".join([p[1] for p in parts]), "<u4"), dtype=np.int64)
        begin = source[np.concatenate([[0], to[:-1]]).astype(np.int64)] if len(to) else to
        end = source[to] if len(to) else to
        if ends:
            bos, eos = self.packed[self.proc.bos_id()], self.packed[self.proc.eos_id()]
            ids, begin, end = bos + ids + eos, np.concatenate([[0], begin, source[-1:]]), np.concatenate([[0], end, source[-1:]])
        return ids, begin.astype("<u4").tobytes(), end.astype("<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        return self.proc.decode(np.frombuffer(ids, "<u4").tolist())


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, begin_end: bool = True, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns ``keep``, n_tokens, ids, begins, ends (binary: little-endian unsigned 32-bit integers), decoded, for each row.

    ``model`` is the model file's content; it travels with the tasks. ids include the begin and end ids if ``begin_end``;
    their spans are empty. begins and ends are byte offsets in the UTF-8 text; a character that falls back to bytes has one
    span a byte. Null text is encoded as the empty text. doc_id may be null and rows may repeat: a row in, a row out, in any
    order. An empty table gives no rows. Texts are never cut: memory grows with the longest text only. ``prefix`` is put before the
    names of the made columns; a column of ``keep`` that still has the name of a made one is replaced by it.
    """
    made = [
        ("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("begins", T.BinaryType()), ("ends", T.BinaryType()),
        ("decoded", T.StringType())
    ]
    made = [T.StructField(f"{prefix}{n}", t) for n, t in made]
    keep = tuple(c for c in keep if c.lower() not in {f.name.lower() for f in made})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        names = [*(f"{i}" for i in range(len(keep))), *(f.name for f in made)]
        row: Callable = lambda ids, begin, end: (len(ids) // 4, ids, begin, end, encoder.decode(ids))
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = [row(*encoder.encode(t or "", begin_end)) for t in part.column(len(keep)).to_pylist()]
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names
                )

    picked = docs.select(
        *(F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(common.quoted(c)) for c in keep),
        F.col("text").cast("string").alias("text")
    )
    kept = [T.StructField(f"{i}", f.dataType) for i, f in enumerate(picked.schema.fields[:-1])]
    numbered = picked.toDF(*(f.name for f in kept), "text")
    return numbered.mapInArrow(run, T.StructType([*kept, *made])).toDF(*keep, *(f.name for f in made))


def digests(encoded: DataFrame) -> DataFrame:
    spans = F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256")
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
        spans
    )
