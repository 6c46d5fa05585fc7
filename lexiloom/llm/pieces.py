"""SentencePiece encoding and decoding with the tokenizers library.

The model protobuf is parsed here (wire format, three messages), and its parts are rebuilt:
normaliser (precompiled character map, space rules), the metaspace marker, unigram scores or
BPE merges in score order, and byte fallback. Batches are encoded by several threads. Parity
with the sentencepiece library is verified on given texts before a run.

Defined cases. Null text is empty: no tokens. Texts decode to themselves up to the model's
normaliser and the marker U+2581, which decodes to a space; ``round_trip`` tells whether
they do. Repeated rows are encoded one by one. Empty table: no rows. Extra columns and very
long texts are taken whole.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
THREADS = 2
#: Fixed values of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire}")
        yield tag >> 3, value


def parse(data: bytes) -> Model:
    out = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    out.kind = v
                elif n == 35:
                    out.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.trim_spaces = bool(v)
                elif n == 5:
                    out.escape_spaces = bool(v)
    return out


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs that make a normal piece, best score first, as BPE merges them."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    out = []
    for piece, i in ids.items():
        pairs = [(ids[piece[:k]], ids[piece[k:]]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        out += [(-model.pieces[i][1], i, *pair) for pair in sorted(pairs)]
    return [(model.pieces[a][0], model.pieces[b][0]) for _, _, a, b in sorted(out)]


def splits_at_marks(model: Model) -> bool:
    """Whether no normal piece has a marker behind another character, so that texts may be cut
    before each run of markers without changing any token."""
    return not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind == NORMAL)


def tokenizer(model: Model):
    """The model as a tokenizers ``Tokenizer``."""
    import tokenizers as T
    from tokenizers import models, normalizers, pre_tokenizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(T.Regex(" {2,}"), " ")]
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab=vocab, merges=merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0)
    else:
        raise ValueError(f"model type {model.kind}")
    out = T.Tokenizer(core)
    out.normalizer = normalizers.Sequence(steps)
    if splits_at_marks(model):
        out.pre_tokenizer = pre_tokenizers.Split(T.Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), behavior="isolated")
    out.decoder = decoder(model)
    return out


def decoder(model: Model, strip: bool = True):
    """Markers to spaces, byte pieces to bytes, and the dummy prefix taken off again."""
    from tokenizers import decoders

    steps = [decoders.Replace(MARK, " ")] + [decoders.ByteFallback()] * model.byte_fallback + [decoders.Fuse()]
    return decoders.Sequence(steps + [decoders.Strip(" ", 1, 0)] * (model.dummy_prefix and strip))


def verify(data: bytes, texts: Iterable[str]) -> list[str]:
    """Texts whose ids or decoded form differ from the sentencepiece library's; empty if none."""
    import sentencepiece

    theirs, ours = sentencepiece.SentencePieceProcessor(model_proto=data), Backend(data)
    texts = list(texts)
    ids, ends, back = ours.run(texts)
    theirs_ids = theirs.encode(texts)
    return [t for k, t in enumerate(texts) if ids[ends[k] : ends[k + 1]].tolist() != theirs_ids[k] or back[k] != theirs.decode(theirs_ids[k])]


#: Texts that parity is verified on before every run.
PROBES = ("", " ", "  two  spaces ", "Hello world", "a\nb\tc\r\n", "Ünïcödé ßtraße niño", "日本語 テキスト", "🙂🙃 emoji", "<s></s><unk>", "<0x0A>", "x" * 300, "12345.678", "▁marks▁▁", "é", "\x00\x01")


#: Distinct segments that a worker remembers before it starts anew.
CACHE = 700_000


class Backend:
    """The tokenizer of one worker process.

    Where texts may be cut before runs of markers, a segment's pieces and its decoded text
    don't depend on what stands around it, so each distinct segment of a batch is encoded and
    decoded once; texts are put together from the segments' numbers.
    """

    def __init__(self, data: bytes):
        model = parse(data)
        self.whole = tokenizer(model)
        self.segments = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if splits_at_marks(model) else None
        self.core = tokenizer(model)
        self.core.normalizer = self.core.pre_tokenizer = None
        self.core.decoder = decoder(model, strip=False)
        #: With no character map and no trimming the normaliser only marks spaces.
        plain = not model.charsmap and not model.trim_spaces and model.escape_spaces
        prefix = MARK if model.dummy_prefix else ""
        self.normalise = (lambda t: prefix + t.replace(" ", MARK) if t else "") if plain else self.whole.normalizer.normalize_str
        self.lead = len(prefix)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.back: list[str] = []
        self.flat, self.edge = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, fresh: list[str]) -> None:
        ids = [e.ids for e in self.core.encode_batch_fast(fresh, add_special_tokens=False)]
        self.back += self.core.decode_batch(ids, skip_special_tokens=False)
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
        lengths = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        self.flat = np.concatenate((self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.int32)))
        self.edge = np.concatenate((self.edge, self.edge[-1] + lengths))

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids of all texts, where each text starts and the last ends, decoded texts)."""
        if self.segments is None:
            ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable(ids), np.int32), np.cumsum([0, *map(len, ids)]), self.whole.decode_batch(ids, skip_special_tokens=False)
        if len(self.number) > CACHE:
            self.forget()
        cut = [self.segments.findall(self.normalise(t)) for t in texts]
        self.learn(list(set().union(*cut).difference(self.number)))
        which = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(cut)), np.int64)
        length = self.edge[which + 1] - self.edge[which]
        total = np.concatenate(([0], np.cumsum(length)))
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.edge[which] - total[:-1], length)]
        ends = np.cumsum([0, *map(len, cut)])
        back, names = self.back, which.tolist()
        decoded = ["".join([back[k] for k in names[a:b]]) for a, b in itertools.pairwise(ends.tolist())]
        return ids, total[ends], [d[1:] if self.lead and d[:1] == " " else d for d in decoded]


_LOADED: dict[str, Backend] = {}


def backend(data: bytes, threads: int) -> Backend:
    """One backend per worker process; batches run on ``threads`` threads."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        _LOADED[key] = Backend(data)
    return _LOADED[key]


def encoder(data: bytes, threads: int, columns: tuple[str, ...], slice_chars: int = 1 << 20):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = backend(data, threads)
        for batch in source:
            texts = batch.column("text").to_pylist()
            i = 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars + len(texts[j]) <= slice_chars):
                    chars += len(texts[j])
                    j += 1
                ids, ends, back = tok.run(texts[i:j])
                same = [a == b for a, b in zip(texts[i:j], back)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in columns] + [pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(same)], names=[*columns, "n_tokens", "ids", "round_trip"])
                i = j

    return run


def encoded(docs: DataFrame, path: str = MODEL, threads: int = THREADS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with n_tokens, ids and round_trip of every row.

    A carried column that has the name of a new one is replaced; a carried text stays as it is, null or not.
    """
    with open(path, "rb") as f:
        data = f.read()
    if bad := verify(data, PROBES):
        raise ValueError(f"the rebuilt tokenizer differs on {bad[:3]!r}")
    carry = tuple(c for c in carry if c not in ("n_tokens", "ids", "round_trip"))
    names = tuple(f"c{i}" for i in range(len(carry)))
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = "".join(f"{c} {t}, " for c, t in slim.dtypes if c != "text")
    out = scratch.arrow(slim, encoder(data, threads, names), f"{kinds}n_tokens long, ids array<int>, round_trip boolean")
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names)], "n_tokens", "ids", "round_trip")
