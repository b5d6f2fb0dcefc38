"""SentencePiece encoding and decoding on the tokenizers library, rebuilt from the model file.

The protobuf is read field by field: pieces with score and kind, the trainer's model type, the normaliser's rules. From it are built

* the normaliser: the identity rule, the dummy prefix and the escape of the space by the metaspace marker; models with a
  character map or that drop extra spaces are refused, as the vocabularies at hand have neither;
* the model: for a unigram model the pieces with their scores; for a BPE model the merges, every split of a piece into two
  pieces, ranked by the score of the piece; both with byte fallback;
* the decoder: byte pieces joined, marker to space, one leading space dropped.

A piece holds the marker only at its beginning, or consists of markers, so a text may be cut before each run of markers:
stretches are encoded as batches by several threads, each distinct stretch once while it is held. ``parity`` tells for every document
whether the ids are those of the sentencepiece library, which is asked for every distinct stretch.

Where a model ranks pieces equally (the runs of spaces), the libraries may merge in different order; stretches with two markers
or more therefore are encoded by the reference library's rule: the leftmost of the best-scored pairs first (``merged``).

Defined results: a null text counts as empty; an empty text has no ids; every row gives one row; an empty table gives none;
other columns do not matter.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assay.llm.common import FORGET, documents, map_texts, register
from assay.llm.wordids import Encoded, WordIds, flattened, set_threads, slices

MODEL = "piece_bpe_32k.model"
THREADS = 2
BATCH = 500_000
MARK = "▁"
MARK_BYTES = MARK.encode()
RUNS = re.compile(b"((?:" + MARK_BYTES + b")+)")
FIRST = b"\xff"  # before a stretch that has no marker; no UTF-8 text has this byte
LINE = 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the model file
UNIGRAM, BPE = 1, 2

FIGURES = "n_tokens long, ids_crc32 long, round_trip boolean, parity boolean"


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protobuf message."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            size, at = varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


@dataclass(frozen=True)
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int
    dummy_prefix: bool

    @classmethod
    def parse(cls, data: bytes) -> "Model":
        pieces, scores, kinds, kind, prefix = [], [], [], UNIGRAM, True
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(fields(value))
                prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("only the identity normaliser that keeps all spaces and escapes them is rebuilt")
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind} is neither unigram nor BPE")
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece reaches across a space, so texts cannot be cut there")
        return cls(pieces, scores, kinds, kind, prefix)


def backend(model: Model):
    """A tokenizers-library tokenizer of one stretch (marker and word), without normaliser: stretches come escaped."""
    from tokenizers import Tokenizer, decoders, models

    byte_fallback = BYTE in model.kinds
    unknown = model.kinds.index(UNKNOWN)
    ids = {p: i for i, p in enumerate(model.pieces)}
    if model.kind == UNIGRAM:
        made = Tokenizer(models.Unigram(list(zip(model.pieces, model.scores)), unk_id=unknown, byte_fallback=byte_fallback))
    else:
        usable = {p for p, k in zip(model.pieces, model.kinds) if k in (NORMAL, USER)}
        merges = []
        for piece in sorted(usable, key=lambda p: (-model.scores[ids[p]], ids[p])):
            splits = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
            merges += sorted(splits, key=lambda s: (ids[s[0]], ids[s[1]]))
        made = Tokenizer(models.BPE(vocab=ids, merges=merges, unk_token=model.pieces[unknown], byte_fallback=byte_fallback, fuse_unk=True))
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return made


def merged(model: Model, ids: dict[str, int], text: str) -> list[int]:
    """Ids of a short stretch by the rule itself: of the best-scored neighbouring pairs the leftmost is merged first."""
    parts = list(text)
    while True:
        best, at = -float("inf"), -1
        for i in range(len(parts) - 1):
            j = ids.get(parts[i] + parts[i + 1])
            if j is not None and model.kinds[j] in (NORMAL, USER) and model.scores[j] > best:
                best, at = model.scores[j], i
        if at < 0:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    out = []
    for part in parts:
        if part in ids:
            out.append(ids[part])
        elif BYTE in model.kinds:
            out += [ids[f"<0x{b:02X}>"] for b in part.encode()]
        else:
            out.append(model.kinds.index(UNKNOWN))
    return out


class Encoder:
    """Encodes and decodes whole texts; with ``theirs``, the sentencepiece processor of the same model, it also verifies parity."""

    def __init__(self, data: bytes, threads: int = THREADS, theirs=None):
        self.theirs, self.threads = theirs, threads
        set_threads(threads)
        self.model = Model.parse(data)
        self.made = backend(self.model)
        self.ids = {p: i for i, p in enumerate(self.model.pieces)}
        self.opens = np.array([p.startswith(MARK) for p in self.model.pieces])
        self.words = WordIds(self._encode, limit=150_000)
        self.words.renewed = self._renewed
        self.sound = np.zeros(0, dtype=bool)  # of every held stretch whether decoding its ids gives it again,
        self.same = np.zeros(0, dtype=bool)   # and whether its ids are those of the sentencepiece library

    def forget(self) -> None:
        self.words.clear()
        self._renewed(np.zeros(0, dtype=np.int64))

    def _renewed(self, stay: np.ndarray) -> None:
        self.sound, self.same = self.sound[stay], self.same[stay]

    def _batch(self, texts: list[str]) -> Encoded:
        return flattened([e.ids for e in self.made.encode_batch_fast(texts, add_special_tokens=False)])

    def _encode(self, keys: list[bytes]) -> Encoded:
        ids, sizes = self._encoded(keys)
        held = len(self.words.known) - len(keys)
        want = [k[1:].decode("utf-8", "replace") if k[:1] == FIRST else k.decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ") if MARK_BYTES in k
                else k.decode("utf-8", "replace") for k in keys]
        own = [x.tolist() for x in slices(ids, sizes)]
        got = self.made.decode_batch(own, skip_special_tokens=False)
        self.sound = np.concatenate([self.sound[:held], np.array([a == b for a, b in zip(got, want)], dtype=bool)])
        # The library puts no prefix before an empty text, so a marker alone is compared with its own piece.
        same = [a == (b if w else [self.ids.get(MARK)]) for w, a, b in zip(want, own, self.theirs.encode(want, num_threads=self.threads))] if self.theirs is not None else [False] * len(keys)
        self.same = np.concatenate([self.same[:held], np.array(same, dtype=bool)])
        return ids, sizes

    def _encoded(self, keys: list[bytes]) -> Encoded:
        """Ids of stretches. A key without marker stands for the word with one marker before it."""
        texts = [k.removeprefix(FIRST).decode("utf-8", "replace") for k in keys]
        if not any(MARK_BYTES in k or k[:1] == FIRST for k in keys):
            lines = [MARK + MARK.join(texts[i:i + LINE]) for i in range(0, len(texts), LINE)]
            ids, _ = self._batch(lines)
            opens = np.flatnonzero(self.opens[ids])
            if len(opens) == len(texts):
                return ids, np.diff(np.r_[opens, len(ids)])
        full = [t if k[:1] == FIRST or MARK in t else MARK + t for k, t in zip(keys, texts)]
        out = [e.ids for e in self.made.encode_batch_fast(full, add_special_tokens=False)]
        for i, stretch in enumerate(full):
            if self.model.kind == BPE and MARK * 2 in stretch:
                out[i] = merged(self.model, self.ids, stretch)
        return flattened(out)

    def stretches(self, text: bytes) -> list[bytes]:
        """The escaped text, cut before each run of markers."""
        if not text:
            return []
        if self.model.dummy_prefix and b"  " not in text and text[:1] != b" " and text[-1:] != b" " and MARK_BYTES not in text:
            return text.split(b" ")
        escaped = (MARK_BYTES if self.model.dummy_prefix else b"") + text.replace(b" ", MARK_BYTES)
        cut = RUNS.split(escaped)  # what stands before the first run, then runs and what follows them
        return ([FIRST + cut[0]] if cut[0] else []) + [run + rest for run, rest in zip(cut[1::2], cut[2::2])]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        ids, sizes = self.words([self.stretches(t) for t in texts])
        return list(slices(ids, sizes))

    def checked(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Ids of every text, whether decoding gives the text again, and whether the sentencepiece library gives the same ids.

        Encoding and decoding join what the stretches give, so each held stretch is decoded and compared once, and a text
        passes if all of its stretches do; a marker in the text itself comes back as a space."""
        at, starts = self.words.numbers([self.stretches(t) for t in texts])
        ids, sizes = self.words.gathered(at, starts)
        wrong, other = np.r_[0, np.cumsum(~self.sound[at])], np.r_[0, np.cumsum(~self.same[at])]
        return (list(slices(ids, sizes)), [bool(w == 0) and MARK_BYTES not in t for w, t in zip(wrong[starts[1:]] - wrong[starts[:-1]], texts)],
                (other[starts[1:]] == other[starts[:-1]]).tolist())

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.made.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


@functools.cache
def original(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def encoder(path: str, threads: int) -> Encoder:
    with open(path, "rb") as f:
        made = Encoder(f.read(), threads, original(path))
    FORGET.append(made.forget)  # held stretches do not outlive a task
    return made


def encode_documents(docs: DataFrame, keep: list[str], path: str, threads: int = THREADS, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Columns ``keep`` and, per document: number and crc32 of the ids (little-endian unsigned 32-bit), whether decoding them gives the
    text again, whether they are those of the sentencepiece library, and the ``ids`` themselves."""

    def work(texts: list[bytes]) -> list:
        ids, sound, same = encoder(path, threads).checked(texts)
        return [[len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], sound, same,
                *([[x.astype(np.int32) for x in ids]] if with_ids else [])]

    return map_texts(docs, keep, FIGURES + (", ids array<int>" if with_ids else ""), work, text_col, BATCH)


@register("op9_piece_ids")
def op9_piece_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_documents(documents(spark, root), ["doc_id"], public_tokenizers.path(MODEL), with_ids=False)
