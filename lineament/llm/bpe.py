"""BPE encoding with forced boundaries, and decoding.

A pair of neighbouring byte symbols that occurs inside no vocabulary token can
never lie inside a token of an encoding, so every such pair is a certain cut.
A word falls into fragments at its cuts; each is encoded by itself, and the
fragments' ids are concatenated. No merge can reach over a cut, so the result
is that of the whole word.

Null texts count as empty; an empty text has no ids. Repeated rows are encoded
each by itself, very long texts whole; an empty table gives none. Words of at most
``LONGEST`` characters are remembered in a bounded table, so that frequent ones
are merged once a worker; longer ones are encoded whenever they come. Kept columns
stay; a made one of the same name gets an underscore before it.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from .shared import enrich

#: Words whose ids a task remembers; the table is emptied when it is full.
REMEMBERED = 200_000
#: The longest word or chunk that is remembered, so that a table is bounded in bytes too.
LONGEST = 48

#: No merge; longer fragments than LONG are merged with a heap; the id in a merge.
NONE, LONG, LOW = 1 << 62, 48, (1 << 32) - 1

#: Characters beyond those for which lower() and the word pattern are known to
#: agree between Python and the tokenizer's own normaliser.
UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0İŉ]|[^\x00-ſ]")
UNUSUAL_ASCII = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    symbols = dict(zip(shown, map(chr, shown))) | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [symbols[b] for b in range(256)]


def tokenizer_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return path


def usual_pattern(pattern: str) -> str:
    """The word pattern for usual characters alone, with their letters and numbers spelt out."""
    usual = [c for c in map(chr, range(0x180)) if not UNUSUAL.match(c)]
    letters, numbers = (re.escape("".join(filter(regex.compile(p).match, usual))) for p in (r"\p{L}", r"\p{N}"))
    return pattern.replace("[\\p{L}]", f"[{letters}]").replace("\\p{L}", letters).replace("\\p{N}", numbers)


def unusual(text: str) -> bool:
    """Whether UNUSUAL is found; an ASCII text is only looked through for four characters."""
    if text.isascii():
        return any(c in text for c in UNUSUAL_ASCII)
    return UNUSUAL.search(text) is not None


class Remembered(dict):
    """Word to ids. A full table becomes the older one, in which words of the
    newer are looked for before they are made: frequent words stay, and at most
    twice ``most`` are held."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word):
        if len(word) > LONGEST:
            return self.make(word)
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


@functools.cache
def shared_bpe(path: str | None, library: bool = False, most: int = REMEMBERED) -> ForcedBoundaryBpe:
    """One encoder a Python worker: what it remembers serves the worker's next tasks too."""
    return ForcedBoundaryBpe(path, library, most)


class ForcedBoundaryBpe:
    """Encoder and decoder for a BPE file with an end-of-word suffix.

    ``library=True`` gives single words to the tokenizers library instead of
    the fragment encoder; splitting and remembering are the same.
    """

    def __init__(self, path: str | None = None, library: bool = False, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        path = tokenizer_path(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # Asked for once: the library makes a new object whenever it is.
        self.tokenize = self.tokenizer.model.tokenize
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        #: A pair of ids as one number, to rank and made id as another.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[left] << 32 | self.vocab[right]] = rank << 32 | self.vocab[left + right]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        #: Each id as four bytes; what is remembered are these, joined.
        self.four = [i.to_bytes(4, "little") for i in range(len(self.names))]
        self.decimals = [str(i) for i in range(len(self.names))]
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = re.compile(usual_pattern(split)).findall
        self.symbols = byte_symbols()
        self.inside = self.pairs_inside()
        self.one = self.library_word if library else self.word
        self.by_word = Remembered(self.part, most)
        self.by_chunk = Remembered(self.chunk, most)
        self.by_symbols = Remembered(self.fragments, most)

    def pairs_inside(self) -> set[str]:
        """Every pair of symbols that stands side by side in some token."""
        n = len(self.suffix)
        found: set[str] = set()
        for token in self.vocab:
            if token.endswith(self.suffix):
                token = token[:-n]
            found.update(map("".join, zip(token, token[1:])))
        return found

    def cuts(self, word: str) -> list[int]:
        """Positions in a word of byte symbols before which a cut is certain."""
        inside = self.inside
        return [i + 1 for i, pair in enumerate(map("".join, zip(word, word[1:]))) if pair not in inside]

    def fragments(self, word: str) -> bytes:
        """Packed ids of a word of byte symbols: its fragments', one after another."""
        ends = [*self.cuts(word), len(word)]
        out: list[int] = []
        start = 0
        for end in ends:
            symbols = list(word[start:end])
            if end == len(word):
                symbols[-1] += self.suffix
            out += self.merge([self.vocab[s] for s in symbols])
            start = end
        return self.pack(out)

    def pack(self, ids) -> bytes:
        return b"".join([self.four[i] for i in ids])

    def merge(self, ids: list[int]) -> list[int]:
        """Merge by rank, then from the left; ``ids`` may be changed."""
        if len(ids) > LONG:
            return self.merge_long(ids)
        get = self.merges.get
        ranks = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            made = ids[i] = best & LOW
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(made << 32 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | made, NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, so that very long runs stay cheap."""
        get, n = self.merges.get, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != best:
                continue
            made = ids[i] = best & LOW
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := get(made << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (m, i))
            if (h := before[i]) >= 0 and (m := get(ids[h] << 32 | made)) is not None:
                heapq.heappush(heap, (m, h))
        return [x for x in ids if x >= 0]

    def visible(self, word: str) -> str:
        """A word as byte symbols; visible ASCII stands for itself."""
        if word.isascii() and word.isprintable():
            return word
        symbols = self.symbols
        return "".join([symbols[b] for b in word.encode()])

    def word(self, word: str) -> bytes:
        return self.fragments(self.visible(word))

    def library_word(self, word: str) -> bytes:
        four = self.four
        return b"".join([four[t.id] for t in self.tokenize(self.visible(word))])

    def part(self, word: str) -> bytes:
        """A word that stands in a chunk with others; it may be remembered as a chunk of its own."""
        ids = self.by_chunk.get(word)
        return self.one(word) if ids is None else ids

    def chunk(self, chunk: str) -> bytes:
        """Packed ids of what stands between white space, in usual characters and lower case."""
        if chunk.isalpha():
            return self.one(chunk)
        words = self.find(chunk)
        if len(words) == 1 and words[0] == chunk:
            return self.one(chunk)
        return b"".join(map(self.by_word.__getitem__, words))

    def packed(self, text: str | None) -> bytes:
        """The ids of a text, each as four bytes."""
        if not text:
            return b""
        out: list[bytes] = []
        for piece in self.specials.split(text) if "<|" in text else (text,):
            if piece in self.special:
                out.append(self.four[self.special[piece]])
            elif unusual(piece):
                plain = self.tokenizer.normalizer.normalize_str(piece)
                words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
                out.extend(map(self.by_symbols.__getitem__, words))
            else:
                out.extend(map(self.by_chunk.__getitem__, piece.lower().split()))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as the library does for a file that names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(self.decimals.__getitem__, ids))


FIELDS = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]


def encoded_digests(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode ``text``; adds n_tokens and the digests of ids and decoded text."""

    def factory():
        bpe = shared_bpe(path)

        def work(texts):
            counts, coded, decoded = [], [], []
            for text in texts:
                ids = bpe.encode(text)
                counts.append(len(ids))
                coded.append(hashlib.sha256(bpe.decimal(ids).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())

        return work

    return enrich(df, text, factory, FIELDS, keep)


def op6(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return encoded_digests(table(spark, sf_dir, "documents"), ["doc_id"])
