"""Encoding of a whole corpus with a public byte-level BPE tokenizer, by cuts that the vocabulary forces.

A pair of neighbouring bytes that occurs inside no token can't be bridged by any merge, so the text may be cut between
them and its fragments encoded on their own. Fragments, mostly words, repeat; each is encoded once per task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.plans.shared import spread

FOLDER = os.environ.get("TARNLAKE_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Fixed value: the pattern that this vocabulary's public tokenizer splits texts with before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fragments that a task remembers, and the longest that it does.
REMEMBERED, LONGEST = 200_000, 64


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def forced_cuts(tokens: Iterable[bytes]) -> list[tuple[int, int]]:
    """The pairs of bytes (last of a fragment, first of the next) between which every text may be cut.

    The pair occurs in no token, so that no merge spans it. It must not change how the pattern splits either, which looks
    ahead after white space only: the left byte ends a character other than white space (an ASCII one, or one of
    several bytes whose last byte ends no white space), and an apostrophe starts a fragment only after an ASCII letter or
    digit, where it always starts a match. A continuation byte never starts a fragment.
    """
    inside = {(a, b) for token in tokens for a, b in zip(token, token[1:])}
    blank = {chr(c).encode()[-1] for c in range(128, 0x3001) if chr(c).isspace()}
    left = [*range(33, 127), *(c for c in range(0x80, 0xC0) if c not in blank)]
    word = {*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
    return [(a, b) for a in left for b in range(256) if not 0x80 <= b < 0xC0 and (a, b) not in inside and (b != 0x27 or a in word)]


class Encoder:
    """Encodes texts; without special tokens, whose strings are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        table = ranks(path)
        self._plain = tiktoken.Encoding("tarnlake", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self._table = np.zeros(1 << 16, bool)
        self._table[[a << 8 | b for a, b in forced_cuts(table)]] = True
        self._known: dict[bytes, list[int]] = {}

    def fragments(self, text: str) -> list[bytes]:
        """The UTF-8 fragments of ``text`` between all forced cuts."""
        raw = text.encode()
        b = np.frombuffer(raw, np.uint8).astype(np.uint16)
        cuts = (np.flatnonzero(self._table[b[:-1] << 8 | b[1:]]) + 1).tolist()
        return [raw[i:j] for i, j in zip([0, *cuts], [*cuts, len(raw)])]

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; none for null and for an empty text."""
        ids: list[int] = []
        if not text:
            return ids
        known = self._known
        for fragment in self.fragments(text):
            found = known.get(fragment)
            if found is None:
                found = self._plain(fragment.decode())
                if len(fragment) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[fragment] = found
            ids += found
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(key, ids) of every row: the token ids of its whole text, an empty list for null and empty texts.

    Rows stay as they are, repeated keys too; other columns aren't read. An empty input gives an empty result.
    """
    path = f"{folder}/{name}.tiktoken"

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        e = encoder(path)
        for batch in batches:
            # rows are encoded in runs, so that the lists of few texts are in memory at once
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([e.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, text), key).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """The columns ``keep`` of every row and ``tokens``, the number of ids of its text."""
    path = f"{folder}/{name}.tiktoken"

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        e = encoder(path)
        for batch in batches:
            n = pa.array([len(e.encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "tokens"])

    kinds = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    return spread(documents.select(*keep, F.col(text).alias("__text")), keep[0]).mapInArrow(count, f"{kinds}, tokens bigint")
