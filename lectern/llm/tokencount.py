"""Token counts of texts under a SentencePiece BPE model, most of them without merging.

``prove`` works offline on the vocabulary. First it shows where no merge can pass: a
blank (the model's own mark for it) stands in no piece behind another character, and a
line feed stands in no piece at all. So a text falls into pre-tokens (a line feed; blanks
and what follows up to the next blank or line feed; the start of a line without a blank)
that are encoded apart from each other, and its tokens are the sum of theirs. Then it
encodes every vocabulary string of that shape alone, and keeps those that give one token.

In a task, pre-tokens of that table are counted as they are; the others are merged by
the library, each different one once for a worker as long as its table of them has room
(``room`` characters; it is emptied when full, which changes no count). Documents do not
meet: one pass, no shuffle. A model for which the proof fails (another normalisation,
pieces that pass such places, user-defined pieces, no byte fallback) is given whole texts.

Nulls and empty texts have 0 tokens and 0 bytes; the model's mark inside a text counts as
a blank and strings of special tokens as plain text, both as in the library; ids may be null
or repeated, equal rows get equal counts, and other columns are never read. A text of any
length is counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The mark that the library writes for a blank.
BLANK = "▁"
PRE_TOKEN = re.compile(r"\n| +[^ \n]*|[^ \n]+")


@dataclass(frozen=True)
class Proof:
    """apart: pre-tokens are encoded apart from each other; whole: those that are one token, with blanks written as blanks."""

    apart: bool
    whole: frozenset[str]


def alone(model: sentencepiece.SentencePieceProcessor, pre_tokens: list[str]) -> list[int]:
    """Tokens of each pre-token where a line feed stands before it, without those before it."""
    before = len(model.encode("\n"))
    return [len(x) - before for x in model.encode(["\n" + p for p in pre_tokens], num_threads=1)]


def plain(serialized: bytes) -> bool:
    """Whether the model merges texts as they are: identity normalisation, a blank put before the text, bytes for unknown characters, no pieces of the user's."""
    try:
        from sentencepiece import sentencepiece_model_pb2 as pb
    except ImportError:
        return False
    m = pb.ModelProto()
    m.ParseFromString(serialized)
    n, t, kinds = m.normalizer_spec, m.trainer_spec, pb.ModelProto.SentencePiece
    return (
        (t.model_type == pb.TrainerSpec.BPE and t.byte_fallback and not t.treat_whitespace_as_suffix)
        and (n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap)
        and not any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in m.pieces)
    )


def prove(serialized: bytes) -> Proof:
    """Of a model's vocabulary, whose size bounds the work."""
    model = sentencepiece.SentencePieceProcessor(model_proto=serialized)
    normal = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    if not plain(serialized) or any(re.search(rf"[^{BLANK}]{BLANK}|\n", p) for p in normal):
        return Proof(False, frozenset())
    shaped = [p for p in ("\n", *(p.replace(BLANK, " ") for p in normal)) if PRE_TOKEN.fullmatch(p)]
    return Proof(True, frozenset(p for p, n in zip(shaped, alone(model, shaped), strict=True) if n == 1))


class Tokens:
    """Counts tokens; knows those of the pre-tokens that it has met."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, proof: Proof, room: int):
        self.model, self.proof, self.room = model, proof, room
        self._forget()

    def _forget(self) -> None:
        self.known, self.held = dict.fromkeys(self.proof.whole, 1), 0

    def of(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """All tokens of each text, and how many of them its pre-tokens gave without merging."""
        if not self.proof.apart:
            return [(len(self.model.encode(t)) if t else 0, 0) for t in texts]
        found = [PRE_TOKEN.findall(" " + t.replace(BLANK, " ")) if t else [] for t in texts]
        new = list(set().union(*found).difference(self.known))
        self.known.update(zip(new, alone(self.model, new), strict=True))
        self.held += sum(map(len, new))
        counts = [(sum(map(self.known.__getitem__, f)), sum(map(self.proof.whole.__contains__, f))) for f in found]
        if self.held > self.room:
            self._forget()
        return counts


def count_tokens(docs: DataFrame, serialized: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", room: int = 4_000_000) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_whole): bytes and tokens of each text, whether the tokens exceed the limit, and how many were counted without merging."""
    common.bounded_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast((serialized, prove(serialized)))  # the model's file and its vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, proof = spread.value
        tokens = Tokens(sentencepiece.SentencePieceProcessor(model_proto=model), proof, room)
        for part in common.slices(batches, "text"):
            counts = np.array(tokens.of(part.column("text").to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(counts[:, 0]), pa.array(counts[:, 0] > limit), pa.array(counts[:, 1])], [id_col, "n_bytes", "n_tokens", "over_limit", "n_whole"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return read.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
