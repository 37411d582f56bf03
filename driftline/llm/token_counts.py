"""Token counts by a public tokenizer.

Texts are encoded in batches of about equal bytes inside Arrow functions, which return lengths alone.
A long text is cut where no token can span the cut, so that its parts' counts add up to its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Code points after which a long text is cut at the next safe boundary, and bytes of one batch.
PART, BATCH = 1 << 15, 1 << 20
LIMIT = 4096
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def cuts(text: str, safe: Callable[[str, int], bool], part: int = PART) -> list[int]:
    """Starts of the parts of a text: the first is 0, each other one the first safe boundary ``part`` code points on."""
    out, at = [0], part
    while at < len(text):
        if safe(text, at):
            out.append(at)
            at += part
        else:
            at += 1
    return out


class Pieces:
    """Counts of a SentencePiece model.

    Merges only ever make pieces of the vocabulary, so a boundary is safe if no piece holds its two
    neighbours side by side. A later part is encoded behind a line feed, which is always a byte of
    its own; what the line feed adds is taken off again.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        self.joined = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        self.head = len(m.encode("\n"))
        if any("\n" in p for p in plain) or len(m.encode("\n\n")) != self.head + 1:
            self.joined = None  # a line feed isn't a token of its own: no cuts

    def safe(self, text: str, at: int) -> bool:
        return self.joined is not None and text[at - 1 : at + 1].replace(" ", "▁") not in self.joined

    def parts(self, text: str) -> tuple[list[str], int]:
        """Parts of a text, and the tokens that they have too many."""
        if len(text) <= PART:
            return [text], 0
        at = cuts(text, self.safe)
        out = [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]
        return [out[0], *("\n" + x for x in out[1:])], self.head * (len(out) - 1)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


class Merges:
    """Counts of a ``tokenizers`` file that splits words ahead of merging: cut before a single space between ASCII letters."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def safe(self, text: str, at: int) -> bool:
        return text[at] == " " and text[at - 1] in _LETTERS and text[at + 1 : at + 2] in _LETTERS

    def parts(self, text: str) -> tuple[list[str], int]:
        if len(text) <= PART:
            return [text], 0
        at = cuts(text, self.safe)
        return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])], 0

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]


def open_counter(path: str) -> Pieces | Merges:
    """The counter for a file, by its suffix; other kinds of file are an error."""
    if path.endswith(".model"):
        return Pieces(path)
    if path.endswith(".json"):
        return Merges(path)
    raise ValueError(f"no tokenizer library for {path}")


def lengths(counter: Pieces | Merges, texts: Iterator[str], n: int, batch: int = BATCH) -> np.ndarray:
    """Tokens of each of ``n`` texts: parts are encoded together until they have ``batch`` bytes."""
    out = np.zeros(n, np.int64)
    parts: list[str] = []
    of: list[int] = []
    size = 0

    def flush():
        np.add.at(out, of, counter.lengths(parts))
        parts.clear()
        of.clear()

    for i, text in enumerate(texts):
        found, extra = counter.parts(text)
        out[i] -= extra
        for p in found:
            parts.append(p)
            of.append(i)
            size += len(p.encode())
            if size >= batch:
                flush()
                size = 0
    if parts:
        flush()
    return out


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text; ``path`` is a tokenizer file that all executors have.

    No special tokens are added, nothing is cut off or padded. A null text counts as empty: 0 bytes and
    0 tokens. Repeated rows and null ids are counted each for itself; an empty table gives no rows;
    other columns are not read.
    """
    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counter = None
        for b in batches:
            counter = counter or open_counter(path)
            for lo, hi, buf, offs in tk.slices(b.column("text"), 4 * BATCH):
                raw = buf.tobytes()
                found = lengths(counter, (raw[a:z].decode("utf-8", "replace") for a, z in zip(offs[:-1], offs[1:])), hi - lo)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(found)], ["doc_id", "n_bytes", "n_tokens"])

    return src.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
