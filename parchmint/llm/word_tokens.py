"""Token ids and prefix token counts under a word-end BPE vocabulary file.

The vocabulary drops white space and never joins text across words, so a text's
ids are those of its words. Texts of code points below U+0180 without special
strings are lower-cased and split over whole batches; distinct words are encoded
once and held in a bounded cache. Other texts go by their chunks between
spaces and line feeds, and chunks that need more than merges go to the library.

``PrefixCounter`` answers for a prefix of any length how many tokens it has. For each
word it stores the count at every prefix, found by dynamic programming: the encoding
of a prefix ends with the one symbol that fits the last symbol of a shorter prefix's
encoding. With the running totals of a text's words, any truncation or budget
is looked up, and nothing is encoded again. Texts of other scripts are split by the library's own normaliser
and splitter; of a long word only as much of the table is made as a budget asks for.
"""

from __future__ import annotations

import bisect
import json
import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.arrowtext import Texts, bounded_batches, keep_cache, pieces, tidied
from parchmint.llm.splitting import Pieces, Recent, shared_prefixes, words

#: Words, and chunks of other texts, that a worker's caches hold; symbol pairs that it remembers.
CACHE_WORDS, CACHE_CHUNKS, CACHE_PAIRS = 800_000, 200_000, 1_000_000
_tokenizers: dict[str, object] = {}
_encoders: dict[str, ChunkIds] = keep_cache({})
_counters: dict[str, PrefixCounter] = keep_cache({})
#: Bytes from which a word's table is not stored: its count comes from the library's merges, its table is made as far as it is asked for.
LONG_WORD = 256
#: Unicode's white space, and the Hangul letters that join the one before them.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_JOINING_HANGUL = ((0x1161, 0x1175), (0x11A8, 0x11C2))
#: Marks that end many words and are words by themselves.
_POINTS = frozenset(".,;:!?")
#: Rank and parts of a symbol that no merge makes.
_BASE = (-1, "", "")


def tokenizer(path: str):
    """The library's tokenizer for a file; loaded once in a worker, without truncation or padding."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _tokenizers[path] = found
    return _tokenizers[path]


def chunks(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class Columns:
    """Results for a column of texts from results for words, or for the chunks of texts that are not plain."""

    def __init__(self, path: str):
        self.model = WordEnd(path)
        self.tokenizer = tokenizer(path)
        self.words, self.chunks = Recent(CACHE_WORDS), Recent(CACHE_CHUNKS)

    def split(self, column: pa.Array) -> tuple[Pieces, np.ndarray]:
        """The words of the plain rows, and the places of the other rows, which have none here."""
        texts = Texts(column)
        plain = self.model.plain(texts)
        if not plain.all():
            texts = Texts(pc.if_else(pa.array(plain), column.cast(pa.large_string()), ""))
        texts.bytes = np.frombuffer(texts.bytes.tobytes().decode().lower().encode(), np.uint8)
        return words(texts), np.flatnonzero(~plain)

    def by_word(self, found: list[bytes]) -> list:
        return self.words.fetch(found, self.of_words)

    def by_chunk(self, text: str) -> list:
        """The results of a text's chunks, in order."""
        parts = chunks(text)
        distinct = list(dict.fromkeys(parts))
        found = dict(zip(distinct, self.chunks.fetch(distinct, self.of_chunks), strict=True))
        return [found[p] for p in parts]

    def of_chunks(self, new: list[str]) -> list:
        split = self.model.split_all(set(new))
        needed = list({w for parts in split.values() for w in parts})
        known = dict(zip(needed, self.by_word(needed), strict=True))
        rest = [c for c in new if c not in split]
        whole = dict(zip(rest, (e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return [self.together([known[w] for w in split[c]]) if c in split else self.of_ids(whole[c]) for c in new]


class ChunkIds(Columns):
    """Little-endian 32-bit ids of texts; the library's merges run once over the words that are new in a batch."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.merges = Tokenizer(self.tokenizer.model)

    @classmethod
    def of(cls, path: str) -> ChunkIds:
        """A worker's encoder for a file."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def of_words(self, new: list[bytes]) -> list[bytes]:
        coded = self.merges.encode_batch_fast(list(map(self.model.spelling, new)), add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in coded]

    together = staticmethod(b"".join)

    @staticmethod
    def of_ids(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def encode_many(self, column: pa.Array) -> list[bytes]:
        """The ids of each text of a column; a null text has none."""
        found, odd = self.split(column)
        ids, at = found.joined(self.by_word(found.distinct))
        out = [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
        for i in odd:
            out[i] = b"".join(self.by_chunk(column[int(i)].as_py()))
        return out


class WordEnd:
    """A word-end BPE file as merges, for dynamic programming over one word's symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        model = read["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        #: For a merged symbol, the rank of its merge and its two parts.
        self.made: dict[str, tuple[int, str, str]] = {}
        for (one, two), rank in self.ranks.items():
            self.made.setdefault(one + two, (rank, one, two))
        split = next(p for p in read["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        self.specials = [t["content"] for t in read["added_tokens"]]
        self.specials_pattern = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.spaced = regex.compile(f"[{_WHITE}]+|[^{_WHITE}]+")
        self._stable = None
        self.marks = {t[0] for t in self.specials}
        #: The most letters of an open and of a closing symbol that ends with three given letters; others have two at most.
        self.reach: dict[str, int] = {}
        self.reach_end: dict[str, int] = {}
        for symbol in self.vocab:
            reach, letters = (self.reach_end, symbol[: -len(self.end)]) if symbol.endswith(self.end) else (self.reach, symbol)
            reach[letters[-3:]] = max(reach.get(letters[-3:], 2), len(letters))
        #: The most letters of any symbol.
        self.longest = max(max(self.reach.values(), default=2), max(self.reach_end.values(), default=2))
        self.fits: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in codes]
        self.letters = {b: chr(b) for b in codes} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def stable(self):
        """A pattern of the least parts that normalise by themselves; made when the first text needs it."""
        if self._stable is None:
            joins = _composing()
            self._stable = regex.compile(f"[{_WHITE}]+|[^{_WHITE}][{joins}]*")
        return self._stable

    def spelling(self, word: bytes) -> str:
        """A word's bytes in the vocabulary's letters."""
        return word.decode() if word.isalnum() else word.decode("latin-1").translate(self.letters)

    def plain(self, texts: Texts) -> np.ndarray:
        """Which rows have only code points below U+0180, whose case every Unicode version agrees on, and no special string.

        U+0130 is left out: its lower case is longer than itself.
        """
        data = texts.bytes
        odd = data >= 0xC6  # the first byte of U+0180
        if data.max(initial=0) >= 128:
            odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
        for mark in self.specials:
            mark = np.frombuffer(mark.encode(), np.uint8)
            at = np.flatnonzero(data[: len(data) - len(mark) + 1] == mark[0]) if len(data) >= len(mark) else np.zeros(0, np.int64)
            for k in range(1, len(mark)):
                at = at[data[at + k] == mark[k]]
            odd[at] = True  # a string across two rows only sends the first of them the longer way
        return texts.sums(odd) == 0

    def merge(self, parts: list[str]) -> list[str]:
        """The encoding of a list of symbols, by the least rank and then the leftmost pair."""
        parts = list(parts)
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spelt(self, symbol: str) -> list[str]:
        if symbol.endswith(self.end) and len(symbol) > len(self.end):
            letters = list(symbol[: -len(self.end)])
            letters[-1] += self.end
            return letters
        return list(symbol)

    def apart(self, a: str, b: str, limit: int) -> bool:
        """Whether no merge of a rank under ``limit`` crosses the seam of two encoded symbols.

        The later of the two symbols' merges is undone again and again; a merge across the
        seam that would have come before it shows that the symbols would not have been.
        """
        ranks, made = self.ranks, self.made
        while ranks.get((a, b), limit) >= limit:
            ra, rb = made.get(a, _BASE), made.get(b, _BASE)
            if ra[0] > rb[0]:
                limit, a = ra[0], ra[2]
            elif rb[0] >= 0:
                limit, b = rb[0] + 1, rb[1]
            else:
                return True
        return False

    def fit(self, one: str, two: str) -> bool:
        """Whether two symbols stay apart when their letters are encoded together."""
        found = self.fits.get((one, two))
        if found is None:
            if len(self.fits) > CACHE_PAIRS:
                self.fits.clear()
            found = self.fits[one, two] = self.apart(one, two, 1 << 60)
        return found

    def whole(self, symbol: str) -> bool:
        """Whether a symbol's letters encode to it."""
        found = self.alone.get(symbol)
        if found is None:
            rank, one, two = self.made.get(symbol, _BASE)
            found = symbol in self.vocab and (rank < 0 or (self.whole(one) and self.whole(two) and self.apart(one, two, rank)))
            if found:
                self.alone[symbol] = True
        return found

    def extend(self, letters: str, last: list[str], inner: list[int]) -> None:
        """Carry the table of open prefixes on to the end of a word's letters.

        Entry i has, for the first i letters within a longer word, the last symbol
        of their encoding and the number of its symbols.
        """
        vocab, alone, fits, reach = self.vocab, self.alone, self.fits, self.reach
        for i in range(len(last), len(letters) + 1):
            first = i - reach.get(letters[i - 3 : i], 2) if i > 3 else 0
            for k in range(first if first > 0 else 0, i):
                symbol = letters[k:i]
                if symbol in vocab and (symbol in alone or self.whole(symbol)) and (k == 0 or fits.get((last[k], symbol)) or self.fit(last[k], symbol)):
                    last.append(symbol)
                    inner.append(inner[k] + 1)
                    break
            else:
                raise ValueError(f"no symbol ends the prefix {letters[:i]!r}")

    def close(self, letters: str, i: int, last: list[str], inner: list[int]) -> int:
        """Tokens of the first i letters as a word of their own: one step from the table."""
        for k in range(max(0, i - self.reach_end.get(letters[i - 3 : i], 2)) if i > 3 else 0, i):
            symbol = letters[k:i] + self.end
            if symbol in self.vocab and self.whole(symbol) and (k == 0 or self.fit(last[k], symbol)):
                return inner[k] + 1
        if i:
            raise ValueError(f"no symbol ends the word {letters[:i]!r}")
        return 0

    def counts(self, word: bytes) -> list[int]:
        """Tokens of each prefix of a word, each taken as a word of its own; the first is 0."""
        return list(self.tables([word])[0])

    def tables(self, new: list[bytes]) -> list:
        """The counts at every prefix of distinct words; in sorted order each goes on from the part that its prefix shares."""
        found = {}
        last, inner, counts = [""], [0], [0]
        order = sorted(new)
        for word, same in zip(order, shared_prefixes(order), strict=True):
            letters = self.spelling(word)
            del last[same + 1 :], inner[same + 1 :], counts[same + 1 :]
            self.extend(letters, last, inner)
            for i in range(len(counts), len(letters) + 1):
                counts.append(self.close(letters, i, last, inner))
            found[word] = bytes(counts) if len(counts) <= 256 else tuple(counts)
        return [found[w] for w in new]

    def counts_within(self, word: bytes, budget: int) -> list[int]:
        """The counts at the first prefixes of a word: at least at all that have ``budget`` tokens or fewer.

        An open prefix has one token more than one of the prefixes that the longest symbol reaches back to.
        Where all of those have ``budget`` tokens, every longer prefix has more.
        """
        letters, reach = self.spelling(word), self.longest
        last, inner, counts = [""], [0], [0]
        for begin in range(0, len(letters), LONG_WORD):
            end = min(begin + LONG_WORD, len(letters))
            self.extend(letters[:end], last, inner)
            for i in range(len(counts), end + 1):
                counts.append(self.close(letters, i, last, inner))
            if end >= reach and min(inner[-reach:]) >= budget:
                break
        return counts

    def split_all(self, chunks: set[str]) -> dict[str, list[bytes]]:
        """Words of chunks as the vocabulary's file normalises and splits them.

        Left out are chunks with special strings, and those of scripts whose case and
        composition differ between Unicode versions.
        """
        out, find, marks = {}, self.split.findall, self.marks
        for c in chunks:
            if c.isascii():
                clean = c.lower()
            elif max(c) < "\u0180":
                clean = unicodedata.normalize("NFC", c).lower()
            else:
                continue
            if clean.isalpha():
                out[c] = [clean.encode()]
            elif clean[-1:] in _POINTS and clean[:-1].isalpha():
                out[c] = [clean[:-1].encode(), clean[-1].encode()]
            elif marks.isdisjoint(c) or not any(s in c for s in self.specials):
                out[c] = [w.encode() for w in find(clean)]
        return out


def _composing() -> str:
    """A pattern's class of the characters that may join one before them: marks, and second parts of compositions."""
    joins = {c for c in range(0x110000) if unicodedata.combining(chr(c))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            joins.add(int(parts[1], 16))
    for begin, end in _JOINING_HANGUL:
        joins.update(range(begin, end + 1))
    return "".join(f"\\U{c:08x}" for c in sorted(joins))


class Split:
    """A text that is not plain, as the library's pieces, and the places where a cut parts nothing.

    A cut stands at no place inside a special string, a run of white space, or a character and
    the marks that compose with it: the prefix's normal form is then a prefix of the text's.
    Where the library composes otherwise than this Python does, cuts stand at white space only.
    """

    def __init__(self, model: WordEnd, library, text: str):
        #: Cuts in code points, and the places in the normal form's bytes that belong to them.
        self.cuts, self.places = [0], [0]
        #: Where in the normal form each piece begins, and its bytes (None: a special string).
        self.begin: list[int] = []
        self.words: list[bytes | None] = []
        whole = model.specials_pattern.split(text) if model.specials else [text]
        for i, span in enumerate(whole):
            if i % 2:
                self.begin.append(self.places[-1])
                self._cut([len(span)], [len(span)])
                self.words.append(None)
            elif span:
                self._span(model, library, span)

    def _cut(self, sizes: list[int], normal: list[int]) -> None:
        for size, length in zip(sizes, normal, strict=True):
            self.cuts.append(self.cuts[-1] + size)
            self.places.append(self.places[-1] + length)

    def _span(self, model: WordEnd, library, span: str) -> None:
        normal = library.normalizer.normalize_str(span)
        for pattern in (model.stable(), model.spaced):
            parts = pattern.findall(span)
            shown = {p: library.normalizer.normalize_str(p) for p in set(parts)}
            if "".join(map(shown.__getitem__, parts)) == normal:
                break
        else:
            parts, shown = [span], {span: normal}
        base = self.places[-1]
        data = np.frombuffer(normal.encode(), np.uint8)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)).tolist()
        for _, (begin, end) in library.pre_tokenizer.pre_tokenize_str(normal):
            self.begin.append(base + at[begin])
            self.words.append(normal[begin:end].encode())
        sizes = {p: len(n.encode()) for p, n in shown.items()}
        self._cut([len(p) for p in parts], [sizes[p] for p in parts])


class PrefixCounter(Columns):
    """Token counts of the prefixes of texts.

    ``count`` adds what the open word's own table has at the cut to the total of the words before it.
    ``longest_prefix`` is the answer to a budget.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.merges = Tokenizer(self.tokenizer.model)

    @classmethod
    def of(cls, path: str) -> PrefixCounter:
        """A worker's counter for a file."""
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]

    def of_words(self, new: list[bytes]) -> list:
        """The counts at every prefix of each word; of a long one its whole count alone, as a number."""
        short = [w for w in new if len(w) < LONG_WORD]
        long = [w for w in new if len(w) >= LONG_WORD]
        found = dict(zip(short, self.model.tables(short), strict=True))
        if long:
            coded = self.merges.encode_batch_fast([self.model.spelling(w) for w in long], add_special_tokens=False)
            found.update((w, len(e.ids)) for w, e in zip(long, coded, strict=True))
        return [found[w] for w in new]

    @staticmethod
    def whole(table) -> int:
        return table if isinstance(table, int) else table[-1]

    @classmethod
    def together(cls, tables: list) -> int:
        return sum(map(cls.whole, tables))

    of_ids = staticmethod(len)

    def totals(self, column: pa.Array) -> np.ndarray:
        """Tokens of whole texts; a null text has none."""
        found, odd = self.split(column)
        out = found.sums([t if isinstance(t, int) else t[-1] for t in self.by_word(found.distinct)])
        for i in odd:
            out[i] = sum(self.by_chunk(column[int(i)].as_py()))
        return out

    def _counts(self, word: bytes, budget: int):
        """Tokens of a word's prefixes by their bytes, each a word itself; of a long word at least of those within a budget.

        A contraction that is cut is an apostrophe and a word.
        """
        table = self.by_word([word])[0]
        if isinstance(table, int):
            return self.model.counts_within(word, budget)
        if len(word) > 1 and word[:1] == b"'" and word[1:].isalpha():
            rest = self.by_word([word[1:]])[0]
            return [0, *(1 + n for n in rest[:-1]), table[-1]]
        return table

    def table(self, text: str) -> tuple[np.ndarray, np.ndarray, list, np.ndarray, np.ndarray]:
        """Where pieces begin in bytes of the normal form, their running totals (0 first) and bytes, cuts in code points, and the cuts' places in bytes."""
        found, odd = self.split(pa.array([text], pa.large_string()))
        if len(odd):
            split = Split(self.model, self.tokenizer, text)
            known = list({w for w in split.words if w is not None})
            sizes = {w: self.whole(t) for w, t in zip(known, self.by_word(known), strict=True)} | {None: 1}
            return np.array(split.begin, np.int64), np.cumsum([0, *(sizes[w] for w in split.words)]), split.words, np.array(split.cuts), np.array(split.places)
        data = np.frombuffer(text.encode(), np.uint8)
        places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        sizes = np.array([self.whole(t) for t in self.by_word(found.distinct)], np.int64)
        return found.begin, np.concatenate([[0], np.cumsum(sizes[found.index])]), [found.distinct[i] for i in found.index], np.arange(len(places)), places

    def count(self, text: str, length: int, table: tuple | None = None) -> int:
        """Tokens of the first ``length`` code points; where no cut stands there, they are encoded."""
        begin, totals, words, cuts, places = table or self.table(text)
        length = min(length, len(text))
        k = int(np.searchsorted(cuts, length))
        if cuts[k] != length:
            return sum(self.by_chunk(text[:length]))
        place = int(places[k])
        i = int(np.searchsorted(begin, place)) - 1  # the last piece that begins before the place
        if i < 0:
            return 0
        size = place - int(begin[i])
        if words[i] is None or size >= len(words[i]):
            return int(totals[i + 1])
        return int(totals[i]) + self._counts(words[i], size)[size]

    def longest_prefix(self, text: str, budget: int) -> int:
        """The most code points up to a cut whose own count is within a budget.

        Any code point may be cut off but those that stand inside a special string, a run of white space or
        a composed character of a text that is not plain (see ``Split``).
        """
        begin, totals, words, cuts, places = self.table(text)
        i = int(np.searchsorted(totals, budget, side="right")) - 1
        if i == len(words):
            return len(text)
        first = int(np.searchsorted(places, begin[i], side="right")) - 1
        if words[i] is None:
            return int(cuts[first])
        left = budget - int(totals[i])
        counts = self._counts(words[i], left)
        end = begin[i] + min(len(counts) - 1, len(words[i]) - 1)
        for k in range(int(np.searchsorted(places, end, side="right")) - 1, first, -1):
            if counts[places[k] - begin[i]] <= left:
                return int(cuts[k])
        return int(cuts[first])


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, limit_chars), one for each row of ``docs``, without special tokens added.

    limit_chars is how many code points of the text fit into ``limit`` tokens: all of a text within the
    limit, else the longest prefix (see ``longest_prefix``). A null text
    counts as empty, with 0 bytes and 0 tokens; blanks have bytes but no tokens. Repeated
    rows and null ids give a row each; an empty table gives none.
    """

    @tidied("token_counts")
    def count(batches):
        counter = PrefixCounter.of(path)
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                texts = batch.column("text")
                sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                totals = counter.totals(texts)
                fits = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                for i in np.flatnonzero(totals > limit):
                    fits[i] = counter.longest_prefix(texts[int(i)].as_py(), limit)
                yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, pa.array(totals, pa.int64()), pa.array(fits)], names=["id", "n_bytes", "n_tokens", "limit_chars"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "id long, n_bytes long, n_tokens long, limit_chars long")
