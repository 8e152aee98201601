"""Operator 5: BPE encoding and decoding, with forced boundaries.

The vocabulary is a lower-casing byte-level BPE with word ends. Two bytes that are neighbours in no token of the
vocabulary can't be merged across, so between them a word may be cut for certain; the fragments are encoded apart,
each once per task, and their ids are joined.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from belvane.llm._common import in_small_batches

END = "</w>"
#: As the vocabulary's file states them: how a text is cut into words.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r\x85\p{Z}\p{L}\p{N}]+")
#: Python takes these for white space, Unicode doesn't.
ODD = regex.compile(r"[\x1c-\x1f]")
SPACE = regex.compile(r"[^\t-\r\x85\p{Z}]+")
#: Words whose ids a task remembers, twice: when the newer ones are as many, the older ones go.
REMEMBERED = 300_000
NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Ids, merges and certain cuts of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.ids: dict[str, int] = told["model"]["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in told["model"]["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.letters = byte_letters()
        inside = {(t[k], t[k + 1]) for t in (x.removesuffix(END) for x in self.ids) for k in range(len(t) - 1)}
        #: The pairs of neighbours that some token has; any other pair forces a cut.
        self.joined = inside
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.pieces: dict[str, tuple[bytes, str]] = {}

    def fragments(self, word: str) -> list[str]:
        """``word``, in byte letters, cut where its neighbours are joined in no token."""
        joined = self.joined
        cuts = [k for k, x in enumerate(pairwise(word), 1) if x not in joined]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def merge(self, parts: list[str]) -> list[str]:
        """Neighbours merged in the order of the merges' ranks, the leftmost first among equals."""
        if len(parts) > 48:
            return self._merge_long(parts)
        rank = self.ranks.get
        next_to = [rank(x, NEVER) for x in pairwise(parts)]
        while next_to and (best := min(next_to)) < NEVER:
            k = next_to.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del next_to[k]
            if k:
                next_to[k - 1] = rank((parts[k - 1], parts[k]), NEVER)
            if k < len(next_to):
                next_to[k] = rank((parts[k], parts[k + 1]), NEVER)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same by a heap: a long fragment costs no more than its length times its logarithm."""
        n, ranks = len(parts), self.ranks
        after, before, live = [*range(1, n), -1], [-1, *range(n - 1)], parts[:]
        heap = [(r, k, live[k], live[k + 1]) for k in range(n - 1) if (r := ranks.get((live[k], live[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if live[k] != a or j < 0 or live[j] != b:
                continue
            live[k], live[j] = a + b, ""
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if (r := ranks.get((live[k], live[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, live[k], live[after[k]]))
            if before[k] >= 0 and (r := ranks.get((live[before[k]], live[k]))) is not None:
                heapq.heappush(heap, (r, before[k], live[before[k]], live[k]))
        return [x for x in live if x]

    def fragment(self, letters: str, last: bool) -> tuple[bytes, str]:
        """Ids, as little-endian unsigned 32-bit integers, and tokens, joined by spaces, of one fragment."""
        tokens = self.merge([*letters[:-1], letters[-1] + END] if last else list(letters))
        ids = self.ids
        return array("I", [ids[t] for t in tokens]).tobytes(), " ".join(tokens)

    def word(self, word: str) -> tuple[bytes, str]:
        """The same of a word: its fragments are encoded apart and joined."""
        plain = word.isascii() and word.isalpha()
        cut = self.fragments(word if plain else "".join([self.letters[b] for b in word.encode("utf-8")]))
        if len(cut) == 1:
            found = self.fragment(cut[0], True)
        else:
            parts = []
            for k, x in enumerate(cut, 1):
                key = x + END if k == len(cut) else x
                part = self.pieces.get(key)
                if part is None:
                    part = self.fragment(x, k == len(cut))
                    if len(x) <= 64:
                        if len(self.pieces) >= REMEMBERED:
                            self.pieces.clear()
                        self.pieces[key] = part
                parts.append(part)
            found = b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts])
        return found

    def remember(self, key: str, found: tuple[bytes, str]) -> tuple[bytes, str]:
        if len(key) <= 64:
            if len(self.known) >= REMEMBERED:
                self.older = self.known.copy()
                self.known.clear()
            self.known[key] = found
        return found

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """The same of what stands between white space: one word or several."""
        if found := self.older.get(chunk):
            return self.remember(chunk, found)
        words = SPLIT.findall(chunk)
        if len(words) == 1:
            return self.remember(chunk, self.word(words[0]))
        parts = [self.known.get(w) or self.older.get(w) or self.remember(w, self.word(w)) for w in words]
        return self.remember(chunk, (b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts])))

    def _words(self, text: str) -> list[tuple[bytes, str]]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        chunk, known = self.chunk, self.known
        return [known.get(x) or chunk(x) for x in (SPACE.findall(text) if ODD.search(text) else text.split())]

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids and decoded text of a whole text."""
        text = text or ""
        if not self.at_special or "<|" not in text:
            found = self._words(text)
        else:
            found, at = [], 0
            for m in self.at_special.finditer(text):
                i = self.special[m[0]]
                found += [*self._words(text[at : m.start()]), (array("I", [i]).tobytes(), m[0])]
                at = m.end()
            found += self._words(text[at:])
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found])

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces: the file names no decoder."""
        return " ".join([self.tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for b in batches:
        docs, texts = b.column("doc_id"), b.column("text")
        for at in range(0, b.num_rows, 500):
            ids, said = [], []
            for x in texts.slice(at, 500):
                i, s = v.encode(x.as_py())
                ids.append(i)
                said.append(s)
            ends = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([docs.slice(at, 500), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(said, pa.string())], ["doc_id", "ids", "decoded"])


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for b in batches:
        n, ids_sha, text_sha = [], [], []
        for x in b.column("text"):
            i, s = v.encode(x.as_py())
            n.append(len(i) // 4)
            ids_sha.append(hashlib.sha256(i).hexdigest())
            text_sha.append(hashlib.sha256(s.encode("utf-8")).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded (text) for every row.

    ``path`` names the vocabulary's file, which every executor has at the same place. A null text is encoded as an empty
    one, which has no ids. Repeated rows each come back; other columns are not read. An empty table gives no rows.
    """
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(partial(_encode, path=path or _default_path()), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """As :func:`encode`, but each row's n_tokens and the SHA-256 of its ids (little-endian, 32 bits) and decoded text,
    taken where they are made, so that neither leaves its task. A null text is taken as empty and has no tokens; a text of
    any length is read whole, word by word. Repeated rows each come back; other columns are not read; an empty table gives
    no rows."""
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(partial(_digest, path=path or _default_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
