"""Abusive, hateful or sexual content: votes of the nearest labelled passages by exact TF-IDF cosine.

Texts are cut into passages (sentences, interruptions), as one of them is enough. Passages of labelled documents are the
examples; a block-max inverted index finds the nearest of them exactly while skipping most blocks. An example votes with
the share of its readings that were positive, weighted by similarity, so that ordinary sentences that happen to stand in
a positive document are outvoted by their many negative likes.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.plans.shared import materialized, scratch, spread
from tarnlake.plans.skew import salted_join

#: What readers mark.
LABELS = ("abusive", "hateful", "sexual")

#: Examples in a part of the index; all labelled documents give examples, in as many parts as it takes.
PART = 32_768
#: Examples that vote, the power of the cosine that weighs a vote, the weight of the prior, the least cosine of a
#: positive example that counts, passages in a block, and the vote from which a passage is found.
VOTERS, SHARPNESS, PRIOR, LEAST, BLOCK, FOUND = 10, 3, 0.12, 0.3, 32, 0.15
#: Passages that a task remembers.
REMEMBERED = 200_000

#: Digits and signs written for letters, and letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("013457$@€", "oieastsae")
OTHER_SCRIPTS = str.maketrans("аеорсхуіјѕкмтнвАЕОРСХУІЈЅКМТНВαορυν", "aeopcxyijskmthbAEOPCXYIJSKMTHBaopuv")
#: Words by which a passage is taken as German, where any noun has a capital.
GERMAN = frozenset("der die das und ist ich nicht wir du sie ein eine zu mit nach den dem im für hat".split())
NAME = "@name"
_UNSEEN = re.compile("[­​-‏⁠﻿‪-‮]")
_HYPHENATED = re.compile(r"[-‐](?<=\w.)\s*[\r\n]+\s*(?=\w)")
_FOREIGN = re.compile("[\u0370-\u04ff]")
# these begin with what is rare in a text, so that most places are passed over at once
_SPELLED = re.compile(r"[.\-_*·|/~ ](?=[^\W_](?![^\W_]))(?<=(?<![^\W_])[^\W_].)")
_MIXED = re.compile(r"[^\W\d_]*[\d$@€][\w$@€]*")
_SIGN = re.compile(r"[\d$@€]+")
_ASIDE = re.compile(r"\[([^\[\]]*)\]|<([^<>]*)>|\(([^()]*)\)")
_END = re.compile(r"[.!?…](?:[\"'”’»]* |[“”])| [—–-] |[—“”«»]")
_COLON = re.compile(r":\s+(?=\S)")
_TITLE = re.compile(r" (?<=\S )([\"'“‘(]?)[^\W\d_a-zà-ÿ][^\W\d_A-ZÀ-Þ]{2,}(?:[-’'][^\W\d_]+)*")
_ONLY_NAME = re.compile(r"\s*(?:(?:Mrs?|Ms|Dr|Sir|The|M|Mme|Herr|Frau)\.?\s+)?[^\W\d_a-zà-ÿ][^\W\d_]+[.,]?\s*")
_WORD = re.compile(r"@name|[^\W_][\w*'’]*")
_NUMBER = re.compile(r"\d[\d.,   ]*")


def _letters(m: re.Match) -> str:
    """A word of letters and look-alikes in letters alone; a number stays."""
    word = m.group()
    return word.translate(LOOKALIKES) if any(c.isalpha() for c in word) else word


def _unmixed(part: str) -> str:
    """``part`` (words a space apart) with look-alikes undone in the words that have any."""
    out, at = [], 0
    for m in _SIGN.finditer(part):
        if m.start() < at:
            continue
        begin, end = part.rfind(" ", at, m.start()) + 1 or at, part.find(" ", m.end())
        end = len(part) if end < 0 else end
        if m.end() - m.start() < end - begin:
            out += part[at:begin], _MIXED.sub(_letters, part[begin:end])
            at = end
    out.append(part[at:])
    return "".join(out)


def _sentences(part: str) -> Iterator[str]:
    """``part`` cut behind the marks that end a sentence, and at dashes and quotation marks."""
    at = 0
    for m in _END.finditer(part):
        yield part[at : m.start() + (part[m.start()] in ".!?…")]
        at = m.end()
    yield part[at:]


def passages(text: str | None) -> list[str]:
    """The passages of a text in plain spelling: lower case, compatibility forms undone, hidden characters and
    hyphenation gone, spelled-out and look-alike letters joined. Asides in brackets are passages of their own. A word with
    a capital inside a passage stands for any name, but in German."""
    if not text:
        return []
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
        if _FOREIGN.search(text):
            text = text.translate(OTHER_SCRIPTS)
    text = _HYPHENATED.sub("", text)
    asides: list[str] = []

    def aside(m: re.Match) -> str:
        asides.append(next(g for g in m.groups() if g is not None))
        return " "

    text = _ASIDE.sub(aside, text)
    found = []
    for part in (text, *asides):
        part = _SPELLED.sub("", " ".join(part.split()))
        for one in (y for x in _sentences(_unmixed(part)) for y in _COLON.split(x)):
            if len(GERMAN.intersection(one.split())) < 2:
                one = NAME if _ONLY_NAME.fullmatch(one) else _TITLE.sub(rf" \1{NAME}", one)
            if one := one.strip().lower():
                found.append(one)
    return found


def key_of(passage: str) -> str:
    """The words of a passage, a space apart; numbers are one word. Passages of one key are the same to the index."""
    return " ".join(_WORD.findall(_NUMBER.sub(" 0 ", passage)))


def terms_of(key: str) -> tuple[str, ...]:
    """Words and pairs of neighbouring words of a key."""
    words = key.split()
    return (*words, *(f"{a} {b}" for a, b in zip(words, words[1:])))


def terms(passage: str) -> tuple[str, ...]:
    """Words and pairs of neighbouring words; numbers are one word."""
    return terms_of(key_of(passage))


#: Passages whose bounds are computed at once, and blocks of each that are read before the rest is bounded by what they gave.
BATCH, FIRST_BLOCKS = 2048, 4


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each (start, count), one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Batch:
    """Passages as rows of term ids and weights of unit length."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, weights: np.ndarray, size: int):
        self.rows, self.ids, self.weights, self.size = rows, ids, weights, size
        self.begin = np.searchsorted(rows, np.arange(size + 1))

    def take(self, chosen: np.ndarray) -> Batch:
        counts = self.begin[chosen + 1] - self.begin[chosen]
        at = _ranges(self.begin[chosen], counts)
        return Batch(np.repeat(np.arange(len(chosen)), counts), self.ids[at], self.weights[at], len(chosen))


class Vocabulary:
    """Ids of terms, in how many of all documents each stands, and its weight."""

    def __init__(self, df: dict[str, int], documents: int, more: Iterable[str] = ()):
        self.documents, self.default = documents, math.log((documents + 1) / 1.0) + 1
        self.ids = {t: i for i, t in enumerate(dict.fromkeys([*df, *more]))}
        self.counts = np.array([df.get(t, 0) for t in self.ids], np.int64)
        self.idf = np.log((documents + 1) / (self.counts + 1)) + 1

    def rarest(self, ts: tuple[str, ...]) -> int:
        """The documents that the rarest term of ``ts`` stands in."""
        return min((int(self.counts[self.ids[t]]) if t in self.ids else 0 for t in ts), default=0)

    def weigh(self, passages: Sequence[tuple[str, ...]]) -> Batch:
        """Term ids and weights of unit length of each passage; terms without id count in the length only."""
        known, unknown = self.ids, {}
        ids = np.array([known[t] if t in known else -1 - unknown.setdefault(t, len(unknown)) for ts in passages for t in ts], np.int64)
        rows = np.repeat(np.arange(len(passages)), [len(ts) for ts in passages])
        # equal terms of a row are counted
        order = np.lexsort((ids, rows))
        ids, rows = ids[order], rows[order]
        first = np.ones(len(ids), bool)
        first[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(first)
        tf = 1 + np.log(np.diff(np.append(at, len(ids))))
        ids, rows = ids[at], rows[at]
        w = tf * np.where(ids >= 0, self.idf[np.maximum(ids, 0)] if len(self.idf) else 0.0, self.default)
        norm = np.sqrt(np.bincount(rows, w * w, minlength=len(passages)))
        w = (w / np.maximum(norm, 1e-300)[rows]).astype(np.float32)
        keep = ids >= 0
        return Batch(rows[keep], ids[keep], w[keep], len(passages))


class VoteIndex:
    """Labelled passages under an inverted index of TF-IDF weights, in blocks with the greatest weight of each term.

    ``examples`` gives each passage's votes: positive ones, all, and positive ones of each label. Passages are asked in
    batches: bounds of all (passage, block) pairs come from the blocks' greatest weights, and only the pairs whose bound
    reaches what is needed are multiplied out, block by block.
    """

    def __init__(self, examples: dict[tuple[str, ...], tuple[float, ...]], df: dict[str, int] | Vocabulary, documents: int = 0):
        self.vocabulary = df if isinstance(df, Vocabulary) else Vocabulary(df, documents, (t for ts in examples for t in ts))
        # passages made after one pattern begin alike: in this order they share blocks, which keeps the bounds close;
        # those with positive votes come first, as without one of them nearby nothing else needs to be read
        order = sorted(examples, key=lambda ts: (examples[ts][0] <= 0, ts[: (len(ts) + 1) // 2]))
        self.positives = sum(examples[ts][0] > 0 for ts in order)
        self.votes = np.array([examples[ts] for ts in order], np.float64).reshape(len(order), -1 if order else 2 + len(LABELS))
        self.texts = [" ".join(t for t in ts if " " not in t) for ts in order]
        weighed = self.weigh(order)
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        terms_of, blocks_of, most = [], [], []
        for b, at in enumerate(range(0, len(order), BLOCK)):
            part = weighed.take(np.arange(at, min(at + BLOCK, len(order))))
            local, place = np.unique(part.ids, return_inverse=True)
            dense = np.zeros((len(local), part.size), np.float32)
            dense[place, part.rows] = part.weights
            self.blocks.append((local, dense))
            terms_of.append(local)
            blocks_of.append(np.full(len(local), b))
            most.append(dense.max(axis=1, initial=0.0))
        whole = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        terms_of, blocks_of, most = whole(terms_of, np.int64), whole(blocks_of, np.int64), whole(most, np.float64)

        def postings(blocks: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
            """The blocks of each term among the first ``blocks`` with its greatest weight there."""
            of_term = np.argsort(np.where(blocks_of < blocks, terms_of, len(self.ids)), kind="stable")[: int((blocks_of < blocks).sum())]
            return blocks, np.searchsorted(terms_of[of_term], np.arange(len(self.ids) + 1)), blocks_of[of_term], most[of_term]

        # most passages find nothing in the blocks with positive examples, so those have postings of their own
        self._leading, self._all = postings(-(-self.positives // BLOCK)), postings(len(self.blocks))

    def __getstate__(self) -> dict:
        """Without the vocabulary, which all parts of an index share."""
        return self.__dict__ | {"vocabulary": None}

    @property
    def ids(self) -> dict[str, int]:
        return self.vocabulary.ids

    @property
    def default(self) -> float:
        return self.vocabulary.default

    def weigh(self, passages: Sequence[tuple[str, ...]]) -> Batch:
        return self.vocabulary.weigh(passages)

    @staticmethod
    def _bounds(batch: Batch, postings: tuple[int, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The greatest cosine that any example of each block may have with each passage."""
        blocks, begin, block, most = postings
        begin, counts = begin[batch.ids], begin[batch.ids + 1] - begin[batch.ids]
        at = _ranges(begin, counts)
        cell = np.repeat(batch.rows * blocks, counts) + block[at]
        return np.bincount(cell, np.repeat(batch.weights, counts) * most[at], minlength=batch.size * blocks).reshape(batch.size, blocks)

    def _cosines(self, batch: Batch, rows: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(passages, block, cosines with the block's examples) of (passage, block) pairs, block by block."""
        order = np.argsort(blocks, kind="stable")
        rows, blocks = rows[order], blocks[order]
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for mine, b in zip(np.split(rows, cuts), blocks[np.append(0, cuts)] if len(blocks) else ()):
            part = batch.take(mine)
            local, dense = self.blocks[b]
            at = np.minimum(np.searchsorted(local, part.ids), len(local) - 1)
            same = local[at] == part.ids
            asked = np.zeros((len(mine), len(local)), np.float32)
            asked[part.rows[same], at[same]] = part.weights[same]
            yield mine, int(b), asked @ dense

    def likely(self, batch: Batch) -> np.ndarray:
        """Whether any example with positive votes has a cosine of ``LEAST`` or more, of each passage."""
        found = np.zeros(batch.size, bool)
        if self.positives and len(batch.ids):
            rows, asked = np.nonzero(self._bounds(batch, self._leading) + 1e-5 >= LEAST)
            for mine, b, sims in self._cosines(batch, rows, asked):
                found[mine[(sims[:, : self.positives - b * BLOCK] >= LEAST).any(axis=1)]] = True
        return found

    def nearest(self, batch: Batch, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, example, cosine) of the ``k`` examples of greatest cosine above 0 of each passage, exactly; ties by place.

        Examples below the ``least`` cosine of their passage, if that is given, aren't needed and may be missing.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        if not self.blocks or not len(batch.ids):
            return none
        bounds = self._bounds(batch, self._all)
        floor, found = np.zeros(batch.size, np.float32) if least is None else least.copy(), [none]

        def read(rows: np.ndarray, blocks: np.ndarray) -> None:
            for mine, b, sims in self._cosines(batch, rows, blocks):
                r, c = np.nonzero((sims > 0) & (sims >= floor[mine][:, None]))
                found.append((mine[r], b * BLOCK + c, sims[r, c]))

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows, places, sims = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((places, -sims, rows))
            rows, places, sims = rows[order], places[order], sims[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            return rows[rank < k], places[rank < k], sims[rank < k]

        some = min(FIRST_BLOCKS, len(self.blocks))
        first = np.argpartition(-bounds, some - 1, axis=1)[:, :some]
        rows = np.repeat(np.arange(batch.size), some)
        tops = np.take_along_axis(bounds, first, axis=1).ravel()
        good = (tops > 0) & (tops + 1e-5 >= floor[rows])
        read(rows[good], first.ravel()[good])
        found[:] = [best()]
        counts = np.bincount(found[0][0], minlength=batch.size)
        full = counts >= k
        ends = np.cumsum(counts)
        floor[full] = np.maximum(floor[full], found[0][2][ends[full] - 1])
        np.put_along_axis(bounds, first, 0.0, axis=1)
        # the margin covers the rounding of sums of single-precision products
        read(*np.nonzero((bounds > 0) & (bounds + 1e-5 >= floor[:, None])))
        return best()

    def ask(self, passages: Sequence[tuple[str, ...]], voters: int = VOTERS, sharpness: float = SHARPNESS) -> tuple[np.ndarray, np.ndarray]:
        """``ask_parts`` of this index alone: votes, and the place of the example that weighs most (-1 if none)."""
        return ask_parts([(lambda: self, len(self.texts), bool(self.positives))], self.vocabulary, passages, voters, sharpness)[:2]

    def vote(self, passages: Sequence[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """The share of positive votes (any label, then each) of each passage, and the example that weighs most for it."""
        sums, evidence = self.ask(passages)
        return sums[:, [0, *range(2, sums.shape[1])]] / (sums[:, 1:2] + PRIOR), evidence


def ask_parts(parts: Sequence[tuple[Callable[[], VoteIndex], int, bool]], vocabulary: Vocabulary, passages: Sequence[tuple[str, ...]], voters: int, sharpness: float) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """Of each passage the votes of its nearest examples (positive, all, positive of each label), and the place and words of the example that weighs most for it.

    ``parts`` give an index part (loaded when needed), its examples, and whether any is positive; the nearest are those of
    all parts together, ties in their order. Votes weigh the cosine to the power of ``sharpness``; without a positive
    example of cosine ``LEAST`` all are 0 and there is no example.
    """
    sums, evidence = np.zeros((len(passages), 2 + len(LABELS))), np.full(len(passages), -1)
    words: list[str | None] = [None] * len(passages)
    likely = np.zeros(len(passages), bool)
    batches = [(at, vocabulary.weigh(passages[at : at + BATCH])) for at in range(0, len(passages), BATCH)]
    for load, _, positive in parts:
        if positive:
            for at, batch in batches:
                likely[at : at + batch.size] |= load().likely(batch)
    asked = [(at + own, batch.take(own)) for at, batch in batches if len(own := np.flatnonzero(likely[at : at + batch.size]))]
    # of each batch: passage, place, cosine, votes and words of the nearest so far
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, sums.shape[1])), np.zeros(0, object)) for _ in asked]
    place = 0
    for load, size, _ in parts if asked else ():
        index = load()
        texts = np.array([*index.texts, None], object)
        for i, (mine, batch) in enumerate(asked):
            least, full = np.zeros(batch.size, np.float32), np.bincount(best[i][0], minlength=batch.size) >= voters
            if full.any():
                least[full] = best[i][2][np.searchsorted(best[i][0], np.arange(batch.size), "right")[full] - 1]
            rows, places, sims = index.nearest(batch, voters, least)
            new = rows, place + places, sims, index.votes[places], texts[places]
            rows, places, sims, votes, texts_of = (np.concatenate(x) for x in zip(best[i], new))
            order = np.lexsort((places, -sims, rows))
            order = order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order]) < voters]
            best[i] = rows[order], places[order], sims[order], votes[order], texts_of[order]
        place += size
    for (mine, _), (rows, places, sims, votes, texts_of) in zip(asked, best):
        w = np.minimum(1.0, sims.astype(np.float64)) ** sharpness
        near = sims >= LEAST
        for c in range(sums.shape[1]):
            sums[mine, c] = np.bincount(rows, w * votes[:, c] * (near if c != 1 else 1), minlength=len(mine))
        heavy = w * votes[:, 0] * near
        order = np.lexsort((-heavy, rows))
        top = order[np.searchsorted(rows[order], np.unique(rows))]
        top = top[heavy[top] > 0]
        evidence[mine[rows[top]]] = places[top]
        for at, text in zip(mine[rows[top]].tolist(), texts_of[top]):
            words[at] = text
    return sums, evidence, words


#: How the witnesses of positive readings are found: examples asked and sharpness (a wide, soft look), the least share of
#: positive votes of a witness, and how near to a document's most suspicious passage another one must come.
WIDE, SOFT, SUSPECT, NEAR_BEST = 40, 3, 0.35, 0.85
#: What stands in many documents can't be what sets few apart, unless many readings say so. COMMON: the share of all
#: documents that makes a passage half as likely a witness as a unique one of the same document. DOUBT: the negative votes
#: a passage is taken to have that stands in as many documents as are positive, with one positive vote; with more they
#: shrink by its square, as each reading that agrees makes chance less likely.
COMMON, DOUBT = 0.004, 100


Readings = dict[int, list[tuple[float, ...]]]


def witnesses(texts: dict[int, list[tuple[str, ...]]], readings: Readings, df: dict[str, int], documents: int) -> dict[tuple[str, ...], tuple[float, ...]]:
    """Examples with the votes of each: a positive reading counts for the passages that bear it out.

    Readings (any label, then each) are of whole documents, and readers err. A first index gives each passage its
    document's readings; a wide look at its neighbours, and how rare it is in all documents, tell how suspicious it is. A
    positive reading then goes to the document's most suspicious passages, and to none if nothing stands out; for its
    other passages it counts as negative. This is for what one process holds; ``train`` does the same in tasks.
    """

    def collect(share) -> dict[tuple[str, ...], tuple[float, ...]]:
        votes: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0] * (2 + len(LABELS)))
        for doc, rs in readings.items():
            own = set(texts.get(doc, ()))
            sums = [sum(x) for x in zip(*rs)]
            chosen = share(own) if sums[0] else own
            for p in own:
                v = votes[p]
                v[1] += len(rs)
                if p in chosen:
                    v[0] += sums[0]
                    for i, n in enumerate(sums[1:], 2):
                        v[i] += n
        return {p: tuple(v) for p, v in votes.items()}

    index = VoteIndex(collect(lambda own: own), df, documents)
    positive = sum(r[0] for rs in readings.values() for r in rs) / max(1, sum(map(len, readings.values())))
    doubted = sorted({p for doc, rs in readings.items() if any(r[0] for r in rs) for p in texts.get(doc, ())})
    suspicion: dict[tuple[str, ...], tuple[float, float]] = {}
    for p, (up, total) in zip(doubted, index.ask(doubted, WIDE, SOFT)[0][:, :2].tolist()):
        common = min((df.get(t, 0) for t in p), default=0) / max(documents, 1)
        alone = up / (total + PRIOR + DOUBT * common / positive / max(1.0, up) ** 2) if up else 0.0
        suspicion[p] = alone, alone / (1 + common / COMMON)

    def stands_out(own: set[tuple[str, ...]]) -> set[tuple[str, ...]]:
        best = max((suspicion[p][1] for p in own), default=0.0)
        return {p for p in own if suspicion[p][0] >= SUSPECT and suspicion[p][1] >= NEAR_BEST * best}

    return collect(stands_out)


@dataclass
class Model:
    """The parts of the index over all examples, and how a vote maps to the share of positive readings."""

    parts: list[IndexPart]
    vocabulary: Broadcast
    steps: list[tuple[float, float]]

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        """The share of positive readings among documents with about these votes, rising with them."""
        return np.interp(votes, [v for v, _ in self.steps], [p for _, p in self.steps]) if self.steps else votes


def rising_steps(votes: list[float], readings: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The rising function of ``votes`` nearest to the readings' shares (pooled neighbours), as points."""
    pools: list[list[float]] = []
    for v, (positive, n) in sorted(zip(votes, readings)):
        pools.append([v * n, positive, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return [(a / n, p / n) for a, p, n in pools]


def cut_documents(documents: DataFrame) -> DataFrame:
    """(row, doc_id, source, passages, keys) of every row, written once: the distinct passages of its text with the key of each, none for null and blank texts."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[str, str] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [list(dict.fromkeys(passages(t))) for t in part.column(2).to_pylist()]
                if len(known) >= REMEMBERED:
                    known.clear()
                for p in dict.fromkeys(p for own in found for p in own):
                    if p not in known:
                        known[p] = key_of(p)
                texts = pa.list_(pa.string())
                columns = [part.column(0), part.column(1), pa.array(found, texts), pa.array([[known[p] for p in own] for own in found], texts)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "passages", "keys"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    made = spread(rows, "doc_id").mapInArrow(cut, "doc_id bigint, source string, passages array<string>, keys array<string>")
    return materialized(made.select(F.monotonically_increasing_id().alias("row"), "*"), "passages")


def _readings(labels: DataFrame) -> DataFrame:
    """(doc_id, n, up): the readings of a document, and how many of them were positive for any label and for each; a reading of nulls alone is none."""
    one = F.greatest(*LABELS)
    each = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", "annotator").agg(F.max(one).alias("any"), *[F.max(c).alias(c) for c in LABELS]).filter("any is not null")
    return each.groupBy("doc_id").agg(F.count("*").cast("double").alias("n"), F.array(*[F.sum(F.coalesce(F.col(c), F.lit(0)).cast("double")) for c in ("any", *LABELS)]).alias("up"))


class IndexPart(NamedTuple):
    """A written part of an index: where it is, its examples, and whether they have positive votes."""

    path: str
    examples: int
    positive: bool


def _write_index(examples: DataFrame, vocabulary: Broadcast) -> dict[int, list[IndexPart]]:
    """``examples`` (part, key, up, total) as the parts of the index of each ``part``, in order, each made and written by a task.

    Examples with positive votes come first, then words decide, so the order is the same wherever the parts are cut.
    """
    spark, out, most = examples.sparkSession, scratch(examples.sparkSession, "votes"), PART

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from tarnlake.sources.storage import writing

        place, held, n = TaskContext.get().partitionId(), {}, 0

        def flush(kind: tuple[int, bool]) -> str:
            nonlocal n
            path, n = f"{out}/{kind[0]}-{int(kind[1])}-{place}-{n}.part", n + 1
            with writing(path, uuid.uuid4().hex) as f:
                pickle.dump(VoteIndex(held.pop(kind), vocabulary.value), f)
            return path

        def report(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: list(x) for k, x in zip(("part", "negative", "place", "no", "path", "examples"), zip(*found))})

        # rows come in order, so one kind is open at a time
        for batch in batches:
            for part, negative, key, up, total in zip(*(batch.column(c).to_pylist() for c in ("part", "negative", "key", "up", "total"))):
                kind = part, negative
                for old in [k for k in held if k != kind or len(held[k]) >= most]:
                    size = len(held[old])
                    yield report([(*old, place, n, flush(old), size)])
                held.setdefault(kind, {})[terms_of(key)] = (up[0], total, *up[1:])
        for old in list(held):
            size = len(held[old])
            yield report([(*old, place, n, flush(old), size)])

    ordered = [F.col("part"), F.col("negative"), F.split("key", " ")]
    ready = materialized(examples.select(F.col("part").cast("bigint").alias("part"), (F.element_at("up", 1) <= 0).alias("negative"), "key", "up", "total"), "examples")
    spans = max(1, -(-ready.count() // most))
    made = ready.repartitionByRange(spans, *ordered).sortWithinPartitions(*ordered).mapInArrow(write, "part bigint, negative boolean, place bigint, no bigint, path string, examples bigint")
    found: dict[int, list[IndexPart]] = defaultdict(list)
    for r in sorted(made.collect(), key=lambda r: (r["part"], r["negative"], r["place"], r["no"])):
        found[r["part"]].append(IndexPart(r["path"], r["examples"], not r["negative"]))
    return found


def _ask(keys: DataFrame, parts: dict[int, list[IndexPart]], vocabulary: Broadcast, voters: int, sharpness: float) -> DataFrame:
    """(part, key, up, total, rarest, likeness) of those distinct ``keys`` (part, key) that have positive votes in the index of their part, written once.

    A task asks the parts of the index one after another for its keys, and holds two of them at most.
    """
    keys = materialized(keys.filter("key <> ''").select(F.col("part").cast("bigint").alias("part"), "key").distinct(), "asked")

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tarnlake.sources.storage import open_read

        @lru_cache(maxsize=2)
        def load(path: str) -> VoteIndex:
            file, _ = open_read(path)
            with file:
                index = pickle.load(file)
            index.vocabulary = vocabulary.value
            return index

        for batch in batches:
            mine: dict[int, list[str]] = defaultdict(list)
            for part, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine[part].append(key)
            for part, own in mine.items():
                asked = [terms_of(k) for k in own]
                sums, _, words = ask_parts([(partial(load, p.path), p.examples, p.positive) for p in parts.get(part, ())], vocabulary.value, asked, voters, sharpness)
                found = np.flatnonzero(sums[:, 0] > 0).tolist()
                columns = {"part": [part] * len(found), "key": [own[i] for i in found], "up": sums[found][:, [0, *range(2, sums.shape[1])]].tolist(), "total": sums[found, 1]}
                columns |= {"rarest": [vocabulary.value.rarest(asked[i]) for i in found], "likeness": [words[i] for i in found]}
                kinds = (pa.int64(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns.values(), kinds)], names=list(columns))

    spans = max(1, -(-keys.count() // BATCH))
    made = keys.repartition(spans, "part", "key").mapInArrow(ask, "part bigint, key string, up array<double>, total double, rarest bigint, likeness string")
    return materialized(made, "votes")


def _vocabulary(cut: DataFrame, keys: DataFrame) -> Broadcast:
    """The terms of ``keys`` with the documents of ``cut`` that each stands in."""

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list({t for k in batch.column(0).to_pylist() for t in terms_of(k)}), pa.string())], names=["term"])

    names = sorted(r["term"] for r in keys.select("key").distinct().mapInArrow(split, "term string").distinct().collect())
    context = cut.sparkSession.sparkContext
    shared = context.broadcast({t: i for i, t in enumerate(names)})

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, totals, n, known = shared.value, np.zeros(len(shared.value), np.int64), 0, {}
        for batch in batches:
            for own in batch.column(0).to_pylist():
                n += 1
                mine: set[int] = set()
                for key in own:
                    found = known.get(key)
                    if found is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        found = known[key] = [ids[t] for t in terms_of(key) if t in ids]
                    mine.update(found)
                totals[list(mine)] += 1
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([n, *totals[some].tolist()], pa.int64())], names=["term", "n"])

    counts = {r["term"]: r["n"] for r in cut.select("keys").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return context.broadcast(Vocabulary({t: counts.get(i, 0) for i, t in enumerate(names)}, counts.get(-1, 0)))


#: The part of an index that all labelled documents are in; those before it leave out one half, to be asked about it.
WHOLE = 2


def _summed(column: str) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(1 + len(LABELS))])


def train(cut: DataFrame, labels: DataFrame, calibrate: bool = True) -> Model:
    """The model from all labelled ones of ``cut_documents``; document frequencies are counted over all documents.

    Examples, their witnesses (as ``witnesses`` says) and the index are made by tasks, of every labelled document. It is
    calibrated on halves of them, by a hash of their id, if ``calibrate``, which votes don't need. Without labels, or
    without positive ones, all votes are 0. Rows of one id are taken together.
    """
    joined = cut.filter(F.size("keys") > 0).select("doc_id", "keys").join(_readings(labels), "doc_id")
    half = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 2, 1), 16, 10).cast("int") % 2
    one = joined.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"), F.first("n").alias("n"), F.first("up").alias("up"))
    labelled = materialized(one.withColumn("half", half), "labelled")
    asks = F.array(F.lit(WHOLE), 1 - F.col("half")) if calibrate else F.array(F.lit(WHOLE))
    learnt = labelled.withColumn("part", F.explode(asks))
    own = learnt.select("part", "doc_id", "n", "up", F.explode("keys").alias("key")).filter("key <> ''")
    vocabulary = _vocabulary(cut, labelled.select(F.explode("keys").alias("key")))
    examples = materialized(own.groupBy("part", "key").agg(_summed("up").alias("up"), F.sum("n").alias("total")), "readings")

    positive = own.filter(F.col("up")[0] > 0)
    doubted = _ask(positive.select("part", "key"), _write_index(examples, vocabulary), vocabulary, WIDE, SOFT)
    shares = learnt.groupBy("part").agg((F.sum(F.col("up")[0]) / F.sum("n")).alias("share"))
    common, up = F.col("rarest") / F.lit(float(max(vocabulary.value.documents, 1))), F.col("up")[0]
    at_least_one = F.greatest(F.lit(1.0), up)
    alone = up / (F.col("total") + F.lit(PRIOR) + F.lit(float(DOUBT)) * common / F.col("share") / (at_least_one * at_least_one))
    suspicion = doubted.join(F.broadcast(shares), "part").select("part", "key", alone.alias("alone"), common.alias("common")).withColumn("suspicious", F.col("alone") / (1 + F.col("common") / F.lit(COMMON)))
    best = F.max("suspicious").over(Window.partitionBy("part", "doc_id"))
    suspects = salted_join(positive, suspicion.select("part", "key", "alone", "suspicious"), ["part", "key"], F.col("doc_id")).withColumn("best", best)
    chosen = suspects.filter((F.col("alone") >= SUSPECT) & (F.col("suspicious") >= NEAR_BEST * F.col("best"))).groupBy("part", "key").agg(_summed("up").alias("borne"))
    none = F.array(*[F.lit(0.0)] * (1 + len(LABELS)))
    parts = _write_index(examples.join(chosen, ["part", "key"], "left").select("part", "key", F.coalesce("borne", none).alias("up"), "total"), vocabulary)
    if not calibrate or labelled.select("half").distinct().count() < 2:
        return Model(parts[WHOLE], vocabulary, [])

    held = labelled.select("doc_id", F.col("half").cast("bigint").alias("part"), F.explode("keys").alias("key"))
    votes = _ask(held.select("part", "key"), parts, vocabulary, VOTERS, SHARPNESS).select("part", "key", _vote(F.col("up")[0]).alias("vote"))
    tops = salted_join(held, votes, ["part", "key"], F.col("doc_id")).groupBy("doc_id").agg(F.max("vote").alias("vote"))
    points = labelled.join(tops, "doc_id", "left").groupBy(F.coalesce("vote", F.lit(0.0)).alias("vote")).agg(F.sum(F.col("up")[0]).alias("up"), F.sum("n").alias("n")).collect()
    return Model(parts[WHOLE], vocabulary, rising_steps([r["vote"] for r in points], [(r["up"], r["n"]) for r in points]))


def _vote(up: Column) -> Column:
    """The share of positive votes."""
    return up / (F.col("total") + F.lit(PRIOR))


def _voted(cut: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, vote, of each label, passage, likeness) of every row of ``cut_documents``; each key is asked once."""
    asked = _ask(cut.select(F.lit(WHOLE).alias("part"), F.explode("keys").alias("key")), {WHOLE: model.parts}, model.vocabulary, VOTERS, SHARPNESS)
    votes = asked.select("key", *[_vote(F.col("up")[i]).alias(c) for i, c in enumerate(("vote", *LABELS))], "likeness")
    stood = cut.select("row", F.posexplode(F.arrays_zip("passages", "keys"))).select("row", "pos", F.col("col.passages").alias("passage"), F.col("col.keys").alias("key"))
    found = salted_join(stood, votes, ["key"], F.col("row"))
    top = found.groupBy("row").agg(F.max(F.struct("vote", (-F.col("pos")).alias("place"), *LABELS, "passage", "likeness")).alias("top"))
    known = [F.coalesce(F.col(f"top.{c}"), F.lit(0.0)).alias(c) for c in ("vote", *LABELS)]
    return cut.select("row", "doc_id", "source").join(top, "row", "left").select("doc_id", "source", *known, "top.passage", "top.likeness")


def score_documents(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, source, score, vote, abusive, hateful, sexual, passage, likeness) of every document.

    ``vote`` is the greatest vote of the document's passages, wherever in the text, and each label's vote is that
    label's share at that passage; ``score`` is calibrated: the share of positive readings among documents with such
    votes. ``passage`` and ``likeness`` are the evidence: the passage in plain spelling and the labelled example it is
    most like. Null, empty and blank texts have vote 0; repeated rows stay.
    """
    cut = cut_documents(documents)
    made = model or train(cut, labels)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = pa.array(steps.calibrated(batch.column("vote").to_numpy(zero_copy_only=False)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "score"])

    kinds = ", ".join(f"{c} double" for c in ("vote", *LABELS))
    steps = Model([], None, made.steps)
    scored = _voted(cut, made).mapInArrow(score, f"doc_id bigint, source string, {kinds}, passage string, likeness string, score double")
    return scored.select("doc_id", "source", "score", "vote", *LABELS, "passage", "likeness")


def found_documents(documents: DataFrame, labels: DataFrame, threshold: float = FOUND) -> DataFrame:
    """The ``doc_id`` of the documents with a vote of ``threshold`` or more."""
    cut = cut_documents(documents)
    return _voted(cut, train(cut, labels, calibrate=False)).filter(F.col("vote") >= threshold).select("doc_id")


def source_rates(scores: DataFrame, threshold: float = FOUND) -> DataFrame:
    """Of each source, whatever its spelling: documents, found documents, their rate and the mean score. A null source is one of its own."""
    from tarnlake.llm.mixing import source_name

    return (
        scores.groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.count("*").alias("documents"), F.count_if(F.col("vote") >= threshold).alias("found"), F.avg("score").alias("mean_score"))
        .withColumn("rate", F.col("found") / F.col("documents"))
    )
