"""Token ids of a whole corpus by a public byte-level BPE vocabulary: speculate, verify, repair.

Greedy longest match proposes the tokens of each distinct word. A proposal is right if and only if every two
neighbours in it are compatible, that is, if merging their joined bytes gives just these two tokens again;
that is tested for all distinct pairs of a batch at once in numpy. Only words with an incompatible pair are
merged exactly. Distinct words are kept per worker, so a word that comes again costs one lookup.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..runtime import pick

TOKENIZER_DIR = "/opt/tokenizers"
#: Distinct words that a worker keeps; beyond it the store starts anew, which costs time only.
MAX_WORDS = 400_000
#: Words with more bytes are merged with a heap.
LONG_WORD = 48

_SPACE = r"\t-\r \x85\xa0  -     　"
# The public word pattern of this vocabulary family.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{s}\p{{L}}\p{{N}}]+|[{s}]+(?![^{s}])|[{s}]+".format(s=_SPACE)
_ASCII_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the JSON vocabulary: itself if printable, else 256, 257, ..."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, and for each merge its left, right and resulting id; ids grow in order of merging."""

    def __init__(self, token_bytes: dict[bytes, int], merges: np.ndarray):
        self.ids = token_bytes
        self.merges = merges
        n = max(token_bytes.values()) + 1
        self.size = n
        self.left = np.full(n, -1, np.int64)
        self.right = np.full(n, -1, np.int64)
        self.left[merges[:, 2]], self.right[merges[:, 2]] = merges[:, 0], merges[:, 1]
        keys = merges[:, 0] * n + merges[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], merges[order, 2]
        self.base = np.zeros(256, np.int64)
        for b in range(256):
            self.base[b] = token_bytes[bytes([b])]
        self.is_base = self.left < 0

    @classmethod
    def load(cls, name: str, folder: str = TOKENIZER_DIR) -> Vocabulary:
        """``name``.json with a byte-level model if there is one, else ``name``.tiktoken."""
        as_json, as_ranks = Path(folder, f"{name}.json"), Path(folder, f"{name}.tiktoken")
        if as_json.exists():
            model = json.loads(as_json.read_text(encoding="utf-8"))["model"]
            letters = _byte_letters()
            vocab = model["vocab"]
            if model.get("end_of_word_suffix") or not all(c in vocab for c in letters):
                raise ValueError(f"{name} is no byte-level vocabulary")
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
            made = set(merges[:, 2].tolist()) | {vocab[c] for c in letters}
            return cls({bytes(letters[c] for c in t): i for t, i in vocab.items() if i in made}, merges)
        if as_ranks.exists():
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in as_ranks.read_bytes().splitlines() if line)}
            return cls(ranks, np.array([(*_last_merge(t, ranks), i) for t, i in ranks.items() if len(t) > 1], np.int64))
        raise ValueError(f"no vocabulary {name} in {folder}")


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
    """The two tokens that are left of ``token`` before its own merge."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        i = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return ranks[parts[0]], ranks[parts[1]]


class Encoder:
    """Word store of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs = dict(zip(zip(vocabulary.merges[:, 0].tolist(), vocabulary.merges[:, 1].tolist()), vocabulary.merges[:, 2].tolist()))
        self.base = vocabulary.base.tolist()
        unsound = self._unsound()
        self.ids = {t: i for t, i in vocabulary.ids.items() if i not in unsound}
        self.longest = max(map(len, self.ids))
        self.plain, self.full = re.compile(_ASCII_WORD, re.ASCII), regex.compile(_WORD)
        self.reset()

    def _unsound(self) -> set[int]:
        """Tokens whose own bytes are merged to something else: their two halves don't stay apart till the end."""
        v = self.v
        made = v.merges[:, 2]
        return set(made[~self.compatible(v.left[made], v.right[made], made)].tolist())

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.values = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)
        self.repaired = 0

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of token a and of token b leaves just a and b, for many pairs at once.

        The merges inside a and inside b are undone from the latest back. While a part of the seam could
        still meet its neighbour, no merge across the seam may come before the merge that removes the part.
        ``below`` gives, for each pair, a merge that may happen itself: only earlier ones count against it.
        """
        v = self.v
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max) if below is None else below.astype(np.int64).copy()
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * v.size + y
            at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
            across = v.pair_keys[at] == key
            bad = across & (v.pair_ids[at] < limit[live])
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            if not len(live):
                break
            sx, sy = ~v.is_base[x], ~v.is_base[y]
            rank_x, rank_y = np.where(sx, x, -1), np.where(sy, y, -1)
            open_x = rank_x > rank_y  # the later of both merges is undone first
            open_y = ~open_x & sy
            # a merge on the left at equal rank comes first, so on the right an equal one may go before it
            limit[live[open_x]] = x[open_x]
            a[live[open_x]] = v.right[x[open_x]]
            limit[live[open_y]] = y[open_y] + 1
            b[live[open_y]] = v.left[y[open_y]]
            live = live[open_x | open_y]
        return good

    def speculate(self, word: bytes) -> list[int]:
        out, i, n = [], 0, len(word)
        ids, longest = self.ids, self.longest
        while i < n:
            for j in range(min(n, i + longest), i, -1):
                t = ids.get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merging by the rules: always the earliest merge, the leftmost of equal ones."""
        parts = [self.base[b] for b in word]
        if len(parts) > LONG_WORD:
            return self._exact_long(parts)
        pairs = self.pairs
        while len(parts) > 1:
            best, at = 1 << 60, -1
            for i in range(len(parts) - 1):
                t = pairs.get((parts[i], parts[i + 1]))
                if t is not None and t < best:
                    best, at = t, i
            if at < 0:
                break
            parts[at : at + 2] = [best]
        return parts

    def _exact_long(self, parts: list[int]) -> list[int]:
        n, pairs = len(parts), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(t, i, parts[i], parts[i + 1]) for i in range(n - 1) if (t := pairs.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            t, i, x, y = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != x or parts[j] != y:
                continue
            parts[i], gone[j], after[i] = t, True, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (u := pairs.get((t, parts[after[j]]))) is not None:
                    heapq.heappush(heap, (u, i, t, parts[after[j]]))
            if before[i] >= 0 and (u := pairs.get((parts[before[i]], t))) is not None:
                heapq.heappush(heap, (u, before[i], parts[before[i]], t))
        return [p for p, g in zip(parts, gone) if not g]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each."""
        spec = [self.speculate(w) for w in words]
        sizes = np.fromiter(map(len, spec), np.int64, len(spec))
        flat = np.fromiter((t for s in spec for t in s), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys, where = np.unique(flat[inner] * self.v.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(keys // self.v.size, keys % self.v.size)
        wrong = np.unique(owner[inner[~good[where]]]).tolist()
        self.repaired += len(wrong)
        if wrong:
            for i in wrong:
                spec[i] = self.exact(words[i])
            sizes = np.fromiter(map(len, spec), np.int64, len(spec))
            flat = np.fromiter((t for s in spec for t in s), np.int64, int(sizes.sum()))
        return flat.astype(np.int32), sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text ends (from 0)."""
        if len(self.index) > MAX_WORDS:
            self.reset()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                found = self.plain.findall(t) if t.isascii() else self.full.findall(t)
                counts[k] = len(found)
                words += found
        index = self.index
        fresh = [w for w in dict.fromkeys(words) if w not in index]
        if fresh:
            flat, sizes = self.encode_words([w.encode("utf-8", "replace") for w in fresh])
            index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
            self.values = np.concatenate([self.values, flat])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        begin = self.starts[at]
        sizes = self.starts[at + 1] - begin
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        values = self.values[np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(begin, sizes)]
        last = np.concatenate([[0], ends])[np.cumsum(counts)]
        return values, np.concatenate([[0], last])


_ENCODERS: dict[str, Encoder] = {}


def encode_corpus(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text without special tokens, one row per input row.

    A null or empty text has an empty list; text that looks like a control token is ordinary text; repeated
    rows and null ids come out as they are; an empty table gives an empty result. Narrow: no shuffle. The
    vocabulary, whose size is fixed, goes to the workers with the task.
    """
    vocabulary = Vocabulary.load(tokenizer, folder)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    name = f"{folder}/{tokenizer}"
    docs = pick(documents, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(name)
        if encoder is None:
            encoder = _ENCODERS[name] = Encoder(shared.value)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for part in table.to_batches(max_chunksize=2000):
                values, ends = encoder.encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")
