"""SentencePiece models run by the tokenizers library.

The model file's protobuf is read here: pieces with scores and types, the trainer's model type
and byte fallback, the normaliser's character map and white-space rules. From these a tokenizer
is put together, unigram or BPE, batches are encoded by several threads, every text is decoded
again and compared, and parity with the SentencePiece library is verified.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The kinds of pieces in the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
#: A text is encoded in parts of at most about this many characters, and a batch holds about so many.
PART_CHARS = 200_000
BATCH_CHARS = 500_000


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message: integers, or bytes for all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if kind == 2 else size
        if size is None:
            raise ValueError(f"wire type {kind} isn't in use")
        yield number, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    suffix_mark: bool = False

    @property
    def unk_id(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    @property
    def splits_at_marks(self) -> bool:
        """Whether no piece goes on with a mark after another character: then nothing merges across such a place."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in wire_fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in wire_fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in wire_fields(value):
                if n == 3:
                    m.kind = v
                elif n == 24:
                    m.suffix_mark = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in wire_fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    m.escape_whitespaces = bool(v)
    return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    """All ways to put a piece together from two, best score first; a piece's own ways in order of the left part's length."""
    usable = {p for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    ranked = sorted((-score, i, p) for i, (p, score, kind) in enumerate(m.pieces) if kind == NORMAL and len(p) > 1)
    return [(p[:i], p[i:]) for _, _, p in ranked for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]


def build(m: Model):
    """A tokenizer that encodes and decodes as the model says."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.suffix_mark:
        raise ValueError("models that mark the end of words are not supported")
    unk = m.pieces[m.unk_id][0]
    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
    elif m.kind == BPE:
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(m.pieces)}, merges=merges_of(m), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape_whitespaces else " "))
    if m.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    if m.splits_at_marks:
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else [])])
    own = [AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER_DEFINED]
    if own:
        t.add_tokens(own)
    return t


def build_plain(m: Model):
    """A quicker tokenizer for texts without neighbouring marks, or None if the model has rules of its own for white space.

    Where single spaces alone become marks, the library's own mark splitter cuts at the same
    places as the general expression does.
    """
    from tokenizers import normalizers, pre_tokenizers

    if m.charsmap or m.remove_extra_whitespaces or not (m.add_dummy_prefix and m.escape_whitespaces and m.splits_at_marks) or any(k == USER_DEFINED for _, _, k in m.pieces):
        return None
    t = build(m)
    t.normalizer = normalizers.Sequence([])
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=True)
    return t


def is_plain(text: str) -> bool:
    """Whether the text, after the prefix is added, has no two spaces or marks side by side."""
    return bool(text) and not text.startswith(" ") and "  " not in text and MARK not in text


def parts(text: str, m: Model, most: int = PART_CHARS) -> list[str]:
    """Texts whose encodings, put together, are the text's: cut at a space after another character, which the next part's own prefix stands for."""
    if len(text) <= most or not (m.splits_at_marks and m.add_dummy_prefix and m.escape_whitespaces) or m.remove_extra_whitespaces or m.charsmap:
        return [text]
    out, at = [], 0
    space = re.compile(r"(?<=[^ ▁]) (?=.)", re.DOTALL)
    while len(text) - at > most and (cut := space.search(text, at + most)):
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


class Codec:
    """The tokenizer of a model file and, to compare, the SentencePiece library's own reading of it."""

    def __init__(self, data: bytes, threads: int = 2) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        self.model = parse_model(data)
        self.tokenizer = build(self.model)
        self.plain = build_plain(self.model)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads
        self.surface = [self._surface(p, kind) for p, _, kind in self.model.pieces]

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " \u2047 ".encode()
        return (piece.replace(MARK, " ") if self.model.escape_whitespaces else piece).encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [parts(t, self.model) for t in texts]
        flat = [p for ps in cut for p in ps]
        quick = [self.plain is not None and is_plain(p) for p in flat]
        run = lambda t, want: iter(t.encode_batch_fast([p for p, q in zip(flat, quick, strict=True) if q == want], add_special_tokens=False)) if t else iter(())
        fast, general = run(self.plain, True), run(self.tokenizer, False)
        coded = (next(fast if q else general) for q in quick)
        return [next(coded).ids if len(ps) == 1 else [i for _ in ps for i in next(coded).ids] for ps in cut]

    def decode(self, ids: list[int]) -> str:
        """The pieces' bytes, put together, without the prefix that encoding adds."""
        out = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return out.removeprefix(" ") if self.model.add_dummy_prefix else out

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=self.threads)


_CODECS: dict[tuple[int, int], Codec] = {}


def codec(data: bytes, threads: int) -> Codec:
    """One codec for each model and worker process."""
    key = (hash(data), threads)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, threads)
    return _CODECS[key]


def small_batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about BATCH_CHARS characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= BATCH_CHARS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (whether decoding gives the text) and parity (whether the library gives the ids), for every row.

    A null text has null ids, no tokens, and both checks null; an empty one has no ids. With a
    model that changes text as it normalises, round_trip compares with the text as given, so it
    may be false; all ids are returned in any case. Very long texts are encoded in parts that
    give the ids of the whole. The model, whose size bounds what is broadcast, is read by the driver.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, threads)
        for batch in batches:
            for lo, hi in small_batches([t or "" for t in batch.column(1).to_pylist()]):
                part = batch.slice(lo, hi - lo)
                given = part.column(1).to_pylist()
                texts = [t or "" for t in given]
                ids = c.encode(texts)
                parity = [a == b if t is not None else None for t, a, b in zip(given, ids, c.library_ids(texts), strict=True)]
                trip = [c.decode(a) == t if t is not None else None for t, a in zip(given, ids, strict=True)]
                sizes = np.array([len(a) for a in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*(t is None for t in given), False]))
                flat = pa.array(np.concatenate([np.array(a, np.int32) for a in ids]) if ids else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.ListArray.from_arrays(offsets, flat), pa.array(trip, pa.bool_()), pa.array(parity, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip", "parity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean, parity boolean")
