"""Token counts without the tokens: Arrow batches go to the tokenizer's own library, only lengths come back.

A batch of the library holds texts of about `BATCH_CHARS` characters together, so its memory does not depend on how many rows that
is. A longer text is cut into stretches at safe boundaries. In a piece model every merge (or lattice edge) is a piece of the
vocabulary, so a place between two characters that no piece holds side by side is never crossed by a token, and both sides
are tokenised as they are within the whole. What the library puts before a text (a blank, if the model says so) must not be put
before a later stretch: those get a line feed in front, which no piece holds either, and its tokens are subtracted.

The pass is narrow: nothing is shuffled, rows keep their partitions, and a lost task is run again from its split.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import small_batches

#: Characters of a stretch, and of the stretches handed to the library at once.
STRETCH_CHARS, BATCH_CHARS = 1 << 15, 1 << 18
#: What stands before a later stretch; it is only used where no piece of the model holds it.
GUARD = "\n"
#: The blank as pieces have it.
BLANK = "▁"


class PieceModel:
    """A sentencepiece model: lengths of lists of texts, and the places where a text may be cut."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        size = self.sp.get_piece_size()
        special = lambda i: self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i)
        pieces = [self.sp.id_to_piece(i) for i in range(size) if not special(i)]
        self.joined = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.guard = len(self.sp.encode(GUARD))
        # a model that rewrites texts, or joins neighbouring unknown characters, is given whole texts
        same = lambda t: self.sp.normalize(t) in (t.replace(" ", BLANK), BLANK + t.replace(" ", BLANK))
        plain = all(map(same, ("A  ﬁ é ½\t.", " a ", f"{BLANK}a")))
        self.cuts = plain and any(self.sp.is_byte(i) for i in range(size)) and not any(GUARD in p for p in pieces)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.sp.encode(texts, num_threads=1)]

    def stretches(self, text: str, limit: int) -> list[str]:
        """text cut into stretches of `limit` characters or, where no boundary is safe, more."""
        if len(text) <= limit or not self.cuts:
            return [text]
        out, start, n = [], 0, len(text)
        while n - start > limit:
            at = start + limit
            while at < n and text[at - 1 : at + 1].replace(" ", BLANK) in self.joined:
                at += 1
            out.append(text[start:at])
            start = at
        if start < n:
            out.append(text[start:])
        return [out[0], *(GUARD + t for t in out[1:])]


class WholeModel:
    """A .json file of the tokenizers library; texts are never cut, since its steps before the model may look at any neighbour."""

    guard = 0

    def __init__(self, blob: bytes):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(blob.decode())
        self.tok.no_truncation()
        self.tok.no_padding()

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def stretches(self, text: str, limit: int) -> list[str]:
        return [text]


@lru_cache(maxsize=2)
def _model(kind: str, blob: bytes):
    return PieceModel(blob) if kind == "model" else WholeModel(blob)


def batch_lengths(model, texts: list[str], stretch: int = STRETCH_CHARS, batch: int = BATCH_CHARS) -> np.ndarray:
    """Tokens of each text: stretches are gathered up to `batch` characters, whichever text they come from."""
    total = np.zeros(len(texts), np.int64)
    held, owner, chars = [], [], 0

    def flush():
        np.add.at(total, owner, model.lengths(held))
        held.clear(), owner.clear()

    for row, text in enumerate(texts):
        if not text:
            continue
        parts = model.stretches(text, stretch)
        total[row] -= model.guard * (len(parts) - 1)
        for part in parts:
            if held and chars + len(part) > batch:
                flush()
                chars = 0
            held.append(part)
            owner.append(row)
            chars += len(part)
    if held:
        flush()
    return total


def token_counts(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row: UTF-8 bytes, tokens, and whether these are more than `limit`.

    model_path: a sentencepiece .model or a tokenizers .json file, read once on the driver and broadcast (its size is the vocabulary's). Counts are
    those of the library for the whole text without begin, end or added special tokens, truncation or padding. A null or empty text has no bytes and no
    tokens. Repeated rows and null ids come out as often as they came in; other columns are not looked at, whatever their names. An empty
    table gives an empty result.
    """
    small_batches(df.sparkSession)
    kind = model_path.rsplit(".", 1)[-1]
    if kind not in ("model", "json"):
        raise ValueError(f"neither .model nor .json: {model_path}")
    with open(model_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):
        model = _model(kind, shared.value)
        for batch in batches:
            for a, z, _, off in tk.slices(batch.column(1)):
                tokens = batch_lengths(model, batch.column(1).slice(a, z - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a), pa.array(np.diff(off), pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(tk.tidy(count), f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
