"""Exact token counts of every prefix by dynamic programming (operator 7).

For byte-pair encoding the tokens of a string are the tokens of one of its prefixes plus one more token, and a
token may follow another exactly where the two encode together to themselves. So the table over the prefixes of a
word, last token and count, is filled left to right: the last token of a prefix is the one that fits behind the
last token of the prefix it leaves. Prefixes of short words are shared between words, so a word costs its new letters
only; a long word has a table of its own, an entry for each letter. The library only normalises and splits words of
rare letters. The sum over words gives every prefix of a text; truncation and budget questions read the table and encode nothing.

Nulls, ties and odd rows: a null text is empty (0 bytes, 0 tokens); null ids, repeated rows and other columns are
carried as they are, each row counted by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filled, schema_of, slices, small_batches

TOKENIZER = "word_bpe_49k.json"
#: entries after which a table is emptied and filled anew; counts do not depend on it
TABLE = 400_000
#: letters up to which a word's prefixes and count are kept for other words
SHARED = 64
_ODD = re.compile("[^\x21-\x7e¡-ɏ]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else 256 onward."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class PrefixCounter:
    """Token counts of words and of all prefixes of texts, for a byte-level vocabulary with word ends."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.rank = {m: i for i, m in enumerate(merges)}
        self.end = model["end_of_word_suffix"] or ""
        self.longest = max(len(t) for t in self.vocab if t.isascii())
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern)
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) + ")")
        self.letters = byte_letters()
        self.library = Tokenizer.from_file(path)
        self.words: dict[str, int] = {"": 0}
        self.states: dict[str, tuple[str, int]] = {}
        self.follows: dict[tuple[str, str], bool] = {}

    def merge(self, letters: list[str]) -> list[str]:
        """Plain pair merging, used to decide which tokens may stand side by side."""
        parts = list(letters)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _letters(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens encode together to themselves (left empty: whether right does alone)."""
        key = (left, right)
        if (known := self.follows.get(key)) is None:
            if len(self.follows) > TABLE:
                self.follows.clear()
            want = [left, right] if left else [right]
            known = self.follows[key] = self.merge([*list(left), *self._letters(right)]) == want
        return known

    def _step(self, x: str, i: int, state) -> tuple[str, int]:
        """Last token and count of x[:i], from ``state`` of the shorter prefixes."""
        for n in range(min(self.longest, i), 0, -1):
            t = x[i - n : i]
            if t in self.vocab:
                last, count = state(i - n)
                if self.fits(last, t):
                    return t, count + 1
        raise ValueError(x[:i])

    def _state(self, x: str) -> tuple[str, int]:
        """Last token and count of x as the beginning of a longer word."""
        states = self.states
        i = len(x)
        while i and x[:i] not in states:
            i -= 1
        for i in range(i + 1, len(x) + 1):
            states[x[:i]] = self._step(x, i, lambda k: states[x[:k]] if k else ("", 0))
        return states[x]

    def piece(self, x: str) -> int:
        """Tokens of one piece, its last letter marked as the word's end."""
        if len(self.states) > TABLE:
            self.states.clear()
        long_ = None
        if len(x) > SHARED:  # one table for all the places where the last token may begin
            long_ = [("", 0)]
            for i in range(1, len(x)):
                long_.append(self._step(x, i, long_.__getitem__))
        for n in range(min(self.longest, len(x)), 0, -1):
            t = x[-n:] + self.end
            if t in self.vocab:
                last, count = ("", 0) if len(x) == n else long_[len(x) - n] if long_ else self._state(x[:-n])
                if self.fits(last, t):
                    return count + 1
        raise ValueError(x)

    def split(self, w: str) -> list[str]:
        """The pieces of a stretch of text between spaces or line ends, in letters for bytes."""
        if _ODD.search(w):  # the library's Unicode tables decide for rare letters
            return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(w))]
        x = unicodedata.normalize("NFC", w)
        letters = self.letters
        return ["".join([letters[b] for b in p.encode()]) for p in self.pieces.findall(x.lower())]

    def word(self, w: str) -> int:
        """Tokens of a stretch of text between spaces or line ends."""
        return sum(map(self.piece, self.split(w)))

    def _known(self, w: str) -> int:
        if (n := self.words.get(w)) is None:
            if len(self.words) > TABLE:
                self.words.clear()
            n = self.word(w)
            if len(w) <= SHARED:
                self.words[w] = n
        return n

    def ends(self, text: str) -> list[int]:
        """Tokens up to the end of each word (or special string) of the text."""
        out, total = [], 0
        for k, part in enumerate(self.special.split(text) if "<|" in text else [text]):
            for w in [part] if k % 2 else part.replace("\n", " ").split(" "):
                if w:
                    total += 1 if k % 2 else self._known(w)
                    out.append(total)
        return out

    def count(self, text: str) -> int:
        if "<|" in text:
            return sum(1 if k % 2 else self.count_plain(p) for k, p in enumerate(self.special.split(text)))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        ws = text.replace("\n", " ").split(" ")
        get = self.words.get
        got = list(map(get, ws))
        if None in got:
            got = [self._known(w) if n is None else n for w, n in zip(ws, got, strict=True)]
        return sum(got)

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i = 0 .. len(text)."""
        out, total, at = np.zeros(len(text) + 1, np.int64), 0, 0
        cuts = [m.span() for m in self.special.finditer(text)] if "<|" in text else []
        spans = [m.span() for m in re.finditer("[^ \n]+", text)]
        for a, z in spans:
            inner = [c for c in cuts if a <= c[0] < z]
            out[at : a + 1] = total
            for i in range(a + 1, z + 1):
                out[i] = total + (self.count(text[a:i]) if inner else self._known(text[a:i]))
            total, at = int(out[z]), z
        out[at:] = total
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, prefixes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_bytes, n_tokens, over_limit; with ``prefixes`` also word_ends, tokens up to each word's end."""
    ddl = "id long, n_bytes long, n_tokens long, over_limit boolean" + ", word_ends array<int>" * prefixes
    schema = schema_of(ddl)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches, "text"):
            texts = filled(b, "text")
            cols = [b.column("id"), pc.binary_length(texts).cast(pa.int64())]
            if prefixes:
                ends = [c.ends(t) for t in texts.to_pylist()]
                n = np.array([e[-1] if e else 0 for e in ends], np.int64)
            else:
                n = np.array([c.count(t) for t in texts.to_pylist()], np.int64)
            cols += [pa.array(n), pa.array(n > limit)]
            yield pa.record_batch([*cols, *([pa.array(ends, pa.list_(pa.int32()))] if prefixes else [])], schema=schema)

    got = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)
    return got.withColumnRenamed("id", id_col)


def words_within(word_ends: str, budget: int):
    """Column: how many leading words fit a budget of tokens, from ``word_ends`` alone."""
    return F.size(F.filter(word_ends, lambda n: n <= budget))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
