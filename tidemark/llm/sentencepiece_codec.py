"""SentencePiece encoding and decoding (operator 9) on the tokenizers library.

The model protobuf is parsed here (pieces, scores, types, trainer and normaliser settings)
and rebuilt as a ``tokenizers`` tokenizer: the precompiled character map, white-space rules
and metaspace marker as normaliser, and a unigram model from the scores, or, for a model of
type BPE, the merges that the scores imply; byte fallback in both.

If no piece holds the marker behind another character (checked on the vocabulary), no token
crosses a word border, so texts are encoded by their distinct chunks in multithreaded
batches.  Every distinct chunk is also encoded by the sentencepiece library: ``parity`` says
whether all chunks of the text agreed.  Ids, counts and decoded text are those of the
tokenizers model throughout.
``roundtrip`` says whether decoding gives the normalised text back.

Null and empty texts have no ids (parity and roundtrip true).  Texts are encoded whole; where
the model has no chunks, a text is encoded in one call.  Ties between segmentations are the
tokenizers library's to break.  Only the named columns are read, so others may have any name.
Repeated rows give equal rows; an empty table gives an empty result."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import INTERNER_LIMIT, Interner, claim, map_arrow, raw_texts, slices, table

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message; length-delimited values as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """What the tokenizer needs from the model file."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unknown = UNIGRAM, False, 0
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                self.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                self.kind, self.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
                self.unknown = own.get(40, 0)
            elif number == 3:
                own = dict(_fields(value))
                self.charsmap = own.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))

    @property
    def chunked(self) -> bool:
        """True if the text may be cut before every marker and round every line feed."""
        apart = all(MARK not in p.lstrip(MARK) and (len(p) == 1 or "\n" not in p)
                    for p, _, t in self.pieces if t in (NORMAL, USER))
        return apart and self.byte_fallback and not self.charsmap and not self.squeeze and self.escape \
            and not any(t == USER for _, _, t in self.pieces)

    def tokenizer(self, normalised: bool = False):
        """A tokenizers tokenizer; ``normalised``: its input is normalised already."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            merges = []
            for piece, score, kind in self.pieces:
                if kind == NORMAL and len(piece) > 1:
                    halves = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
                    merges += [(score, vocab[a], vocab[b], a, b) for a, b in halves if a in vocab and b in vocab]
            merges.sort(key=lambda m: (-m[0], m[1], m[2]))
            model = models.BPE(vocab, [(a, b) for *_, a, b in merges], unk_token=self.pieces[self.unknown][0], fuse_unk=True,
                               byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind} has no tokenizers model here")
        tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if steps and not normalised:
            tokenizer.normalizer = normalizers.Sequence(steps)
        tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                              + ([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []))
        return tokenizer

    def processor(self, dummy_prefix: bool):
        """The sentencepiece library's processor; a repeated message overrides the setting."""
        from sentencepiece import SentencePieceProcessor
        spec = b"\x18" + bytes([dummy_prefix])
        return SentencePieceProcessor(model_proto=self.data + b"\x1a" + bytes([len(spec)]) + spec)

    def piece_bytes(self) -> list[bytes]:
        """What each id decodes to."""
        out = []
        for i, (piece, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            elif i == self.unknown:
                out.append(" ⁇ ".encode())
            else:
                out.append(piece.replace(MARK, " ").encode())
        return out


class Codec:
    """Encodes and decodes texts; each distinct chunk is worked out once per worker."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.model = PieceModel(f.read())
        self.chunked = self.model.chunked
        self.tokenizer = self.model.tokenizer(normalised=self.chunked)
        self.processor = self.model.processor(self.model.dummy_prefix and not self.chunked)
        self.bytes_of = self.model.piece_bytes()
        self.byte_ids = np.array([t == BYTE for _, _, t in self.model.pieces])
        self.reset()

    def reset(self) -> None:
        self.index = Interner()
        self.ids: list[bytes] = []
        self.back: list[bytes] = []
        self.agree: list[bool] = []
        self.fallback: list[int] = []

    _CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.chunked:
            return [text]
        if self.model.dummy_prefix:
            text = " " + text
        return self._CHUNK.findall(text.replace(" ", MARK))

    def _learn(self) -> None:
        todo, self.index.todo = self.index.todo, []
        ours = [e.ids for e in self.tokenizer.encode_batch(todo, add_special_tokens=False)]
        theirs = self.processor.encode([c.replace(MARK, " ") if self.chunked else c for c in todo], num_threads=2) if todo else []
        for a, b in zip(ours, theirs, strict=True):
            ids = np.array(a, "<u4")
            self.agree.append(a == b)
            self.ids.append(ids.tobytes())
            self.fallback.append(int(self.byte_ids[ids].sum()) if a else 0)
            self.back.append(b"".join(map(self.bytes_of.__getitem__, a)))

    def encode(self, texts: list[bytes | None]) -> Iterator[tuple[bytes, int, bool, bytes]]:
        """(ids as little-endian uint32, byte-fallback ids, parity, decoded text) per text."""
        if len(self.index) > INTERNER_LIMIT:
            self.reset()
        look = self.index.__getitem__
        rows = [list(map(look, self.chunks(t.decode("utf-8", "replace")))) if t else [] for t in texts]
        self._learn()
        for row in rows:
            decoded = b"".join(map(self.back.__getitem__, row))
            if row and self.model.dummy_prefix and decoded.startswith(b" "):
                decoded = decoded[1:]
            yield (b"".join(map(self.ids.__getitem__, row)), sum(map(self.fallback.__getitem__, row)),
                   all(map(self.agree.__getitem__, row)), decoded)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        if self.model.dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, with_ids: bool = True, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_crc32, parity, roundtrip[, ids]) of every row."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = claim(("pieces", path), lambda: Codec(path))
        for batch in batches:
            texts = raw_texts(batch.column(1))
            for a, b in slices(texts):
                n, low, crc, parity, same, ids = [], [], [], [], [], []
                for text, (raw, fallback, agree, decoded) in zip(texts[a:b], codec.encode(texts[a:b])):
                    n.append(len(raw) // 4)
                    low.append(fallback)
                    crc.append(zlib.crc32(raw))
                    parity.append(agree)
                    same.append(decoded == (text or b"").replace(MARK.encode(), b" "))
                    if with_ids:
                        ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                columns = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(low, pa.int64()),
                           pa.array(crc, pa.int64()), pa.array(parity, pa.bool_()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "parity", "roundtrip"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, n_byte_tokens bigint, ids_crc32 bigint, parity boolean, roundtrip boolean"
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .transform(map_arrow, run, schema + (", ids array<int>" if with_ids else "")))


def decode(rows: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = claim(("pieces", path), lambda: Codec(path))
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    id_type = rows.schema[id_col].dataType.simpleString()
    return (rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
            .transform(map_arrow, run, f"doc_id {id_type}, text string"))


def op9_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op9_sentencepiece_codec": op9_sentencepiece_codec}
ORACLE: dict[str, str] = {}
