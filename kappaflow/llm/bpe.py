"""Exact tokenizer output for whole texts from a bounded memo of text chunks.

A text is cut at places where no token can span the cut; each chunk is encoded
once by the tokenizer library itself and remembered.  Words repeat, so a task
encodes a small share of what it reads.  The memo is bounded (two generations
of ``limit`` chunks, the older one dropped when the younger is full).
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

GAP = re.compile(r"(?<=\S) (?=\S)")
SUB_BATCH_CHARS = 2_000_000


def load(path: str):
    """A tokenizer of the ``tokenizers`` library, single-threaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def odd(chunk: str) -> bool:
    """Whether a piece between two spaces lies next to more white space, so
    that the spaces are no places to cut."""
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


def sub_batches(texts: Iterable[str], size: int = SUB_BATCH_CHARS) -> Iterable[list[str]]:
    """Consecutive texts of about ``size`` characters together; a longer text
    is a batch of its own."""
    out: list[str] = []
    n = 0
    for t in texts:
        out.append(t)
        n += len(t)
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


class ChunkMemo:
    """chunk -> value, for values made in batches by ``make``."""

    def __init__(self, make: Callable[[list[str]], list], limit: int = 300_000,
                 skip: Callable[[str], bool] = lambda c: False):
        self.make, self.limit, self.skip = make, limit, skip
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def values(self, chunks: set[str]) -> dict[str, object]:
        """A dict that holds at least those ``chunks`` that ``skip`` allows."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = []
        for c in chunks:
            if c not in young:
                v = old.get(c)
                if v is None:
                    if not self.skip(c):
                        missing.append(c)
                else:
                    young[c] = v
        if missing:
            young.update(zip(missing, self.make(missing)))
        return young
