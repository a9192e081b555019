"""SentencePiece encoding and decoding with the tokenizers library as the backend.

The model protobuf is parsed here: pieces with scores and types, model type, byte fallback, the
normaliser's rules and flags, unknown surface.  From these a tokenizers.Tokenizer is rebuilt: the
normaliser, the metaspace marker, and either the unigram scores or, for a BPE model, the merges
that its scores imply, each with byte fallback.

Merges never cross from another character to a marker unless a piece holds a marker inside, so a
text is cut there, and distinct segments are encoded once per batch, on several threads.

Defined results: null or empty text has no ids and decodes to "".  Text of surrogates only never
occurs in Spark strings.  Unknown pieces decode to the model's unknown surface.  Each row is encoded
by its own text, whatever its doc_id; repeated rows give repeated results.  Of equally good merges
the earlier piece wins.  Empty tables give empty results; columns but doc_id and text are not read.
A text of any length is encoded whole; a marker cuts it, so the pieces that are held are words.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import os
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import kept, lean, parts

MARK = "▁"
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of a protobuf message; a value is an int, or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind} in the model file")
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    whitespace_as_suffix: bool = False
    unknown_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_whitespace: bool = True
    escape_whitespace: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                m.pieces.append(piece)
                m.scores.append(score)
                m.types.append(kind)
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        m.kind = v
                    elif n == 24:
                        m.whitespace_as_suffix = bool(v)
                    elif n == 35:
                        m.byte_fallback = bool(v)
                    elif n == 44:
                        m.unknown_surface = v.decode()
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        m.charsmap = v
                    elif n == 3:
                        m.dummy_prefix = bool(v)
                    elif n == 4:
                        m.remove_extra_whitespace = bool(v)
                    elif n == 5:
                        m.escape_whitespace = bool(v)
        if m.kind not in (UNIGRAM, BPE) or m.whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with the marker before words")
        return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces to a third, by the third's score, best first."""
    ids = {p: i for i, p in enumerate(m.pieces) if m.types[i] in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, i in ids.items():
        if m.types[i] == NORMAL:
            found += [(-m.scores[i], i, piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
    return [(a, b) for _, _, a, b in sorted(found, key=lambda x: x[:2])]


class Codec:
    """encode() and decode() of one model; made once per worker from the model's bytes."""

    def __init__(self, data: bytes):
        import tokenizers
        from tokenizers import decoders, models, normalizers

        m = self.model = Model.parse(data)
        unknown = m.types.index(UNKNOWN)
        self.unknown = unknown
        if m.kind == UNIGRAM:
            vocabulary = [(p, s) for p, s in zip(m.pieces, m.scores, strict=True)]
            backend = models.Unigram(vocabulary, unk_id=unknown, byte_fallback=m.byte_fallback)
        else:
            backend = models.BPE(
                {p: i for i, p in enumerate(m.pieces)}, merges_of(m), unk_token=m.pieces[unknown], fuse_unk=True, byte_fallback=m.byte_fallback
            )
        self.tokenizer = tokenizers.Tokenizer(backend)
        self.normalizer = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        inner = any(MARK in p.lstrip(MARK) for p in m.pieces)
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if not inner else re.compile("(?s).+")
        self.surface = []
        for p, k in zip(m.pieces, m.types, strict=True):
            if k == BYTE:
                self.surface.append(bytes([int(p[3:5], 16)]))
            elif k in (CONTROL, UNUSED):
                self.surface.append(b"")
            else:
                self.surface.append((m.unknown_surface if k == UNKNOWN else p.replace(MARK, " ")).encode())
        self.known: dict[str, bytes] = {}  # int32 ids of recent segments

    def normalized(self, text: str) -> str:
        m = self.model
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        if m.remove_extra_whitespace:
            text = re.sub(" +", " ", text.strip(" "))
        if m.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if m.escape_whitespace else text

    def encode(self, texts: list[str | None], most: int = 100_000) -> list[np.ndarray]:
        """Ids per text; segments that are new in this call are encoded in one batch."""
        cut = [self.cut.findall(self.normalized(t)) if t else [] for t in texts]
        known = self.known
        if len(known) > most:
            known.clear()
        new = [s for s in dict.fromkeys(s for c in cut for s in c) if s not in known]
        for at in range(0, len(new), 2_000):
            part = new[at : at + 2_000]
            for s, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[s] = np.array(e.ids, np.int32).tobytes()
        return [self._fused(np.frombuffer(b"".join(map(known.__getitem__, c)), np.int32)) for c in cut]

    def _fused(self, ids: np.ndarray) -> np.ndarray:
        """Unknown ids that follow one another are one, across segments too."""
        if self.model.byte_fallback or len(ids) < 2:
            return ids
        both = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[np.concatenate([[True], ~both])]

    def decode(self, ids) -> str:
        """The text of ids; each byte that is in no UTF-8 character becomes U+FFFD.

        One marker at the start of the first piece that has a surface is the dummy prefix.  A piece
        without a surface parts the bytes around it.
        """
        parts = list(map(self.surface.__getitem__, ids))
        if self.model.dummy_prefix or self.model.remove_extra_whitespace:
            for i, p in zip(range(len(parts)), ids):
                if self.model.types[p] in (CONTROL, UNUSED):
                    continue
                if self.model.types[p] in (NORMAL, USER_DEFINED) and parts[i].startswith(b" "):
                    parts[i] = parts[i][1:]
                break
        if all(parts[1:]):
            return b"".join(parts).decode("utf-8", "one-by-one")
        runs = itertools.groupby(zip(parts, ids), lambda x: self.model.types[x[1]] in (CONTROL, UNUSED))
        return "".join(b"".join(p for p, _ in run).decode("utf-8", "one-by-one") for _, run in runs)


codecs.register_error("one-by-one", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def codec_of(data: bytes) -> Codec:
    """The worker's codec of a model: one at a time, kept from task to task of this operator."""
    return kept(data, lambda: Codec(data))


def _transform(docs: DataFrame, model_path: str, schema: T.StructType, columns: list[str], rows, batch: int) -> DataFrame:
    """Maps batches through rows(codec, columns of the batch); the model travels as a broadcast."""
    with open(model_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already; each thread keeps memory of its own
        codec = codec_of(data.value)
        for b in parts(batches) if "text" in columns else batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays(rows(codec, part), schema=None, names=schema.names)

    return docs.select(*columns).mapInArrow(lean(run, keeps=True), schema)


def encoded(docs: DataFrame, model_path: str, batch: int = 2000) -> DataFrame:
    """(doc_id, ids) per row of docs (doc_id, text)."""
    schema = T.StructType([docs.schema["doc_id"]]).add("ids", T.ArrayType(T.IntegerType()))

    def rows(codec, b):
        return [b.column("doc_id"), pa.array(codec.encode(b.column("text").to_pylist()), pa.list_(pa.int32()))]

    return _transform(docs, model_path, schema, ["doc_id", "text"], rows, batch)


def decoded(encoded: DataFrame, model_path: str, batch: int = 2000) -> DataFrame:
    """(doc_id, text) per row of (doc_id, ids); null ids give null text."""
    schema = T.StructType([encoded.schema["doc_id"]]).add("text", "string")

    def rows(codec, b):
        return [b.column("doc_id"), pa.array([x if x is None else codec.decode(x) for x in b.column("ids").to_pylist()], pa.string())]

    return _transform(encoded, model_path, schema, ["doc_id", "ids"], rows, batch)


def token_report(docs: DataFrame, model_path: str, batch: int = 2000) -> DataFrame:
    """(doc_id, n_tokens, n_bytes_tokens, ids_sha256, decoded_sha256, round_trip) per row of docs.

    ids_sha256 is over the little-endian int32 ids; round_trip says whether the decoded text is the text.
    """
    schema = T.StructType([docs.schema["doc_id"]])
    schema.add("n_tokens", "long").add("n_byte_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("round_trip", "boolean")

    def rows(codec, b):
        texts = b.column("text").to_pylist()
        is_byte = np.array(codec.model.types) == BYTE
        ids = codec.encode(texts)
        back = [codec.decode(x.tolist()) for x in ids]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [
            b.column("doc_id"),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
            pa.array([sha(x.astype("<i4").tobytes()) for x in ids], pa.string()),
            pa.array([sha(t.encode()) for t in back], pa.string()),
            pa.array([t == (s or "") for t, s in zip(back, texts, strict=True)], pa.bool_()),
        ]

    return _transform(docs, model_path, schema, ["doc_id", "text"], rows, batch)


def parity(docs: DataFrame, model_path: str, batch: int = 500) -> DataFrame:
    """(doc_id, equal): whether the rebuilt tokenizer gives the ids that the reference library gives."""
    schema = T.StructType([docs.schema["doc_id"]]).add("equal", "boolean")
    with open(model_path, "rb") as f:
        data = f.read()

    def rows(codec, b):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=data)
        texts = [t or "" for t in b.column("text").to_pylist()]
        theirs = own.encode(texts, num_threads=1)
        return [b.column("doc_id"), pa.array([x.tolist() == y for x, y in zip(codec.encode(texts), theirs, strict=True)], pa.bool_())]

    return _transform(docs, model_path, schema, ["doc_id", "text"], rows, batch)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
