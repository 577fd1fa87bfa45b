"""Byte-level BPE words: where a text splits, and the ids of one word.

The tokenizer cuts a text into words by a fixed pattern and merges bytes only inside a word.
Both halves are needed apart: words are found for a whole batch of texts at once with numpy,
and a word is encoded once, however often it occurs.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Fixed value: the tokenizer's own split pattern, here only as the description of `word_starts`:
#   's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, by the Unicode properties that the pattern names."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            low, high = ord(m[0][0]), ord(m[0][-1])
            if high - low == len(m[0]) - 1:
                table[low : high + 1] = value
            else:  # a run over the surrogate gap
                table[[ord(c) for c in m[0]]] = value
    # Unicode's White_Space, without the four separators that Python's own class adds
    table[0x1C:0x20] = OTHER
    return table


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the code points that begin a word.

    ``points`` are the code points of several texts end to end, ``first`` flags the first one
    of each text. Words never cross texts.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, bool)
    kind = _classes()[points]
    space = kind == SPACE
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    # a word takes the one blank before it
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (points[:-1] == 0x20) & ~first[1:]
    start &= space | ~blank_before
    # the last of several white spaces stands alone, or begins the next word
    last_space = np.zeros(n, bool)
    last_space[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= first | last_space
    # contractions
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        ends = np.append(np.flatnonzero(first)[1:], n)
        stop = ends[np.searchsorted(ends, quote, side="right")]
        one = points[np.minimum(quote + 1, n - 1)]
        two = points[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "sdmt"]) & (quote + 1 < stop)
        long = ((one == ord("l")) & (two == ord("l")) | (one == ord("v")) & (two == ord("e")) | (one == ord("r")) & (two == ord("e"))) & (quote + 2 < stop)
        hit = short | long
        size = np.where(short, 2, 3)[hit]
        at = quote[hit]
        start[at + 1] = False
        after = at + size
        start[after[after < n]] = True
    return start


class Batch:
    """The words of several texts: a dictionary, and the texts as positions in it.

    ``words`` is an Arrow array of the distinct words in order of appearance, ``codes`` holds
    for each word of the texts its place in ``words``, ``bounds`` where each text begins.
    """

    def __init__(self, words: pa.Array, codes: np.ndarray, bounds: np.ndarray):
        self.words, self.codes, self.bounds = words, codes, bounds


def split_texts(texts: list[str | None], special: str = "") -> Batch:
    """Words of all ``texts`` (None: empty). ``special`` is never split and joins with nothing."""
    parts: list[str] = []
    owner: list[int] = []
    whole: list[int] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        if special and special in text:
            for k, piece in enumerate(text.split(special)):
                if k:
                    whole.append(len(parts))
                    parts.append(special)
                    owner.append(i)
                if piece:
                    parts.append(piece)
                    owner.append(i)
        else:
            parts.append(text)
            owner.append(i)
    joined = "".join(parts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(points)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.cumsum(sizes) - sizes
    first = np.zeros(n, bool)
    first[begins] = True
    start = word_starts(points, first)
    for k in whole:
        start[begins[k] + 1 : begins[k] + sizes[k]] = False
    at = np.flatnonzero(start)
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.cumsum(width, dtype=np.int64) - width
    data = joined.encode()
    offsets = np.append(byte_at[at], len(data)).astype(np.int32)
    array = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    coded = array.dictionary_encode()
    part_word = np.append(np.searchsorted(at, begins), len(at))  # first word of each part
    counts = np.zeros(len(texts) + 1, np.int64)
    np.add.at(counts, np.asarray(owner, np.int64) + 1, np.diff(part_word))
    codes = coded.indices.to_numpy(zero_copy_only=False) if len(at) else np.zeros(0, np.int32)
    return Batch(coded.dictionary, codes, np.cumsum(counts))


def ragged_take(values: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``codes`` of a ragged array end to end, and the size of each."""
    sizes = np.diff(starts)[codes]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64) + np.repeat(starts[:-1][codes] - (ends - sizes), sizes)
    return values[index], sizes


class WordEncoder:
    """Ids of single words for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        if len(self.special) > 1:
            raise ValueError("one special token at most is supported")
        self.special_text = next(iter(self.special), "")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._merge = _ranked(spec)

    def encode(self, words: list[str]) -> list[list[int]]:
        if self._merge is not None:
            one = self._merge
            return [[self.special[w]] if w in self.special else one(w.encode()) for w in words]
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def ragged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same as one flat array and where each word's ids start."""
        ids = self.encode(words)
        starts = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=starts[1:])
        return np.fromiter((i for x in ids for i in x), np.uint32, int(starts[-1])), starts


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(path: str) -> list[tuple[int, bytes]]:
    """(id, bytes) of the whole vocabulary, special tokens with their text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    out = {i: bytes(letters[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    out |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return sorted(out.items())


def _ranked(spec: dict):
    """Merging by rank, where the ids of a vocabulary are its merge order (five times as fast a word); else None."""
    letters = byte_letters()
    model = spec["model"]
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [vocab.get(a + b) for a, b in merges] != [*range(len(letters), len(letters) + len(merges))]:
        return None
    import tiktoken

    ranks = {bytes(letters[c] for c in piece): i for piece, i in vocab.items()}
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker."""
    return WordEncoder(path)
