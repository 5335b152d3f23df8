"""BPE encoding and decoding with a public vocabulary: contiguous rank arrays per short word."""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import words

#: White space as Unicode defines it; str.split() also splits at \x1c-\x1f, which are not white space here.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
_NO_RANK = 1 << 60
#: Bytes up to which words are merged side by side, and one at a time by scans of their rank array; what is longer
#: (base64, number dumps) takes its ranks from a heap, so that its time doesn't grow with the square of its length.
LONG, SCANNED = 24, 400


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model, self.vocab = d["model"], d["model"]["vocab"]
        if d["normalizer"]["type"] != "Sequence" or model["type"] != "BPE" or d["decoder"] is not None:
            raise ValueError("a BPE vocabulary with word ends and no decoder is expected")
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.pattern = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _SPACE.pattern[1:-2]))
        self.token = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = t
        ids = self.vocab
        self.pairs = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        letters = _byte_letters()
        self.inner = [ids[c] for c in letters]
        self.final = [ids[c + self.end] for c in letters]
        self.inner_ids, self.final_ids = np.array(self.inner), np.array(self.final)
        spaced = [(t + " ").encode() for t in self.token]
        self.spaced, self.spaced_lengths = np.frombuffer(b"".join(spaced), np.uint8), np.array([len(t) for t in spaced])
        self.spaced_starts = np.cumsum(self.spaced_lengths) - self.spaced_lengths
        by_key = sorted((a * len(self.token) + b, rank) for (a, b), (rank, _) in self.pairs.items())
        self.keys, self.key_ranks = np.array([k for k, _ in by_key] or [-2]), np.array([r for _, r in by_key] or [_NO_RANK])
        self.merged = np.zeros(len(model["merges"]) + 1, np.int64)
        for rank, new in self.pairs.values():
            self.merged[rank] = new

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token: the parts and the rank of each part with its right neighbour lie in two arrays."""
        if len(data) > SCANNED:
            return self._long_word(data)
        parts = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        pairs, none = self.pairs, (_NO_RANK, -1)
        ranks = [pairs.get((a, b), none)[0] for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            k = ranks.index(least)
            parts[k] = pairs[parts[k], parts[k + 1]][1]
            del parts[k + 1], ranks[k]  # the boundary between the two goes
            if k:
                ranks[k - 1] = pairs.get((parts[k - 1], parts[k]), none)[0]
            if k < len(ranks):
                ranks[k] = pairs.get((parts[k], parts[k + 1]), none)[0]
        return parts

    def _long_word(self, data: bytes) -> list[int]:
        """`word` for a long pre-token: parts know their neighbours, pairs wait in a heap by rank, then by place."""
        parts = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        n, pairs, none = len(parts), self.pairs, (-1, -1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [pairs.get(p, none)[0] for p in zip(parts, parts[1:], strict=False)] + [-1]
        waiting = [rank << 40 | k for k, rank in enumerate(ranks) if rank >= 0]
        heapq.heapify(waiting)
        pop, push = heapq.heappop, heapq.heappush
        while waiting:
            entry = pop(waiting)
            k = entry & 0xFFFFFFFFFF
            if ranks[k] != entry >> 40:
                continue  # the part has another neighbour by now, or is part of something else
            gone = after[k]
            new = parts[k] = pairs[parts[k], parts[gone]][1]
            parts[gone] = ranks[gone] = -1
            after[k] = right = after[gone]
            ranks[k] = -1
            if right < n:
                before[right] = k
                if (rank := pairs.get((new, parts[right]), none)[0]) >= 0:
                    ranks[k] = rank
                    push(waiting, rank << 40 | k)
            left = before[k]
            if left >= 0:
                ranks[left] = rank = pairs.get((parts[left], new), none)[0]
                if rank >= 0:
                    push(waiting, rank << 40 | left)
        return [x for x in parts if x >= 0]

    def _chunks_encoded(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of distinct chunks without white space; their distinct words side by side, a rank array a row."""
        # lower-cased letter by letter: a final sigma has no form of its own here
        low = [c.lower() if "\u03a3" not in c else "".join(map(str.lower, c)) for c in chunks]
        parts = [c if c.isalpha() else tuple(self.pattern.findall(c)) for c in low]
        distinct = list({p for p in parts if isinstance(p, str)}.union(*[p for p in parts if not isinstance(p, str)]))
        data = [w.encode() for w in distinct]
        order = sorted(range(len(data)), key=list(map(len, data)).__getitem__)
        known: dict[str, bytes] = {}
        for k in range(0, len(order), 10_000):
            own = order[k : k + 10_000]
            known.update(zip([distinct[i] for i in own], self._words([data[i] for i in own]), strict=True))
        return [known[p] if isinstance(p, str) else b"".join([known[w] for w in p]) for p in parts]

    def _words(self, data: list[bytes]) -> list[bytes]:
        """`word` for many words at once: a row of parts and a row of ranks for each, the least rank merged in all rows."""
        out: list[bytes] = [b""] * len(data)
        lengths = np.array([len(d) for d in data])
        for k in np.flatnonzero(lengths > LONG).tolist():
            out[k] = array("I", self.word(data[k])).tobytes()
        rows = np.flatnonzero(lengths <= LONG)
        if not len(rows):
            return out
        n = lengths[rows]
        width = int(n.max()) + 1
        parts = np.full((len(rows), width), -1, np.int64)
        flat = np.frombuffer(b"".join([data[k] for k in rows.tolist()]), np.uint8)
        row, starts = np.repeat(np.arange(len(rows)), n), np.cumsum(n) - n
        column = np.arange(len(flat)) - np.repeat(starts, n)
        parts[row, column] = np.where(column == n[row] - 1, self.final_ids[flat], self.inner_ids[flat])
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        at = np.arange(width)
        while len(rows):
            k = np.argmin(ranks, axis=1)
            each = np.arange(len(rows))
            least = ranks[each, k]
            done = least == _NO_RANK
            if done.any():
                packed = parts[done].astype("<u4").tobytes()
                for a, r, m in zip(range(0, len(packed), 4 * width), rows[done].tolist(), n[done].tolist(), strict=True):
                    out[r] = packed[a : a + 4 * m]
                go = ~done
                rows, parts, ranks, n, k, least = rows[go], parts[go], ranks[go], n[go], k[go], least[go]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            parts[each, k] = self.merged[least]
            shift = np.minimum(at[None, :] + (at[None, :] > k[:, None]), width - 1)
            parts = np.take_along_axis(parts, shift, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(at[None, :-1] + (at[None, :-1] >= k[:, None]), width - 2), axis=1)
            n = n - 1
            parts[each, n] = -1
            ranks[each, np.maximum(n - 1, 0)] = _NO_RANK
            ranks[each, k] = self._ranks(parts[each, k], parts[each, k + 1])
            left = np.maximum(k - 1, 0)
            ranks[each, left] = np.where(k > 0, self._ranks(parts[each, left], parts[each, left + 1]), ranks[each, left])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = np.where((a >= 0) & (b >= 0), a * len(self.token) + b, -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_ranks[at], _NO_RANK)

    def _odd(self, text: str) -> bytes:
        """Ids of a text that holds special tokens, or separators that aren't white space."""
        out = []
        for s in self.special_split.split(text) if self.special_split else [text]:
            if s in self.special:
                out.append(array("I", [self.special[s]]).tobytes())
            else:
                out += self._chunks_encoded([c for c in _SPACE.split(unicodedata.normalize("NFC", s)) if c])
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers."""
        odd = {k: self._odd(t) for k, t in enumerate(texts) if _SEPARATORS.search(t) or ("<|" in t and any(s in t for s in self.special))}
        plain = ["" if k in odd else t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for k, t in enumerate(texts)]
        chunks, number, edges = words.chunked(pa.array(plain, pa.string()))
        packed = self._chunks_encoded(chunks)
        lengths = np.array([len(p) // 4 for p in packed], np.int64)
        starts = np.cumsum(lengths) - lengths
        own = lengths[number]
        data = words.gather(np.frombuffer(b"".join(packed), "<u4"), starts[number], own).tobytes()
        ends = np.concatenate(([0], np.cumsum(own)))[edges] * 4
        return [odd.get(k, data[a:b]) for k, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False))]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, packed: list[bytes]) -> list[bytes]:
        """UTF-8 of tokens joined by a space: what a vocabulary without a decoder gives."""
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        lengths = self.spaced_lengths[ids]
        data = words.gather(self.spaced, self.spaced_starts[ids], lengths).tobytes()
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([0, *(len(p) // 4 for p in packed)])]
        return [data[a : max(a, b - 1)] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]

    def decode(self, packed: bytes) -> str:
        return self.decode_all([packed])[0].decode()


_loaded: dict[int, WordBpe] = {}


def _coder(spec: str) -> WordBpe:
    """One coder per Python worker and vocabulary."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(spec)
    return _loaded[key]


def bpe(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Encode every whole text and, with `decode`, decode it again.

    Returns doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) and decoded (string, null without
    `decode`). A null or empty text has no tokens and decodes to the empty string. Repeated rows give repeated rows;
    an empty table gives no rows; other columns are ignored. `vocabulary` is the path of a vocabulary file; the driver
    reads it and broadcasts its text (under 2 MB), so executors need no file.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec.value)
        for batch in batches:
            for part in words.by_size(batch, 1):
                ids = coder.encode_all([t or "" for t in part.column(1).to_pylist()])
                for k in range(0, len(ids), 1000):
                    own = ids[k : k + 1000]
                    back = coder.decode_all(own) if decode else [None] * len(own)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(k, 1000), pa.array([len(x) // 4 for x in own], pa.int64()), pa.array(own, pa.binary()), pa.array(back, pa.binary()).cast(pa.string())],
                        names=["doc_id", "n_tokens", "ids", "decoded"],
                    )
        words.release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
