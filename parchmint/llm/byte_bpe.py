"""Byte-level BPE as a lazily determinised transducer, and streaming decode.

The vocabulary is ranks only. A prefix of a piece has one encoding, which ends
with the one token that fits the last token of a shorter prefix's encoding. A
prefix is open while some token reaches from its end past the bytes read. A
state of the transducer is the set of open prefixes, each as the last token of
its encoding and the node of the vocabulary's trie that the bytes after it
reach; a move outputs the last token of the encoding of what has been read.
Tokens are certain where the paths of all open prefixes meet, so lookahead is
bounded by the longest token. States and moves are made when first met and shared
by all pieces; new pieces of a batch are walked in sorted order, each from the
state at the end of the prefix that it shares with the one before.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.arrowtext import Texts, bounded_batches, keep_cache, pieces, tidied
from parchmint.llm.splitting import BYTE_PATTERN, Pieces, Recent, byte_pieces, gathered, shared_prefixes

#: Pieces that a worker's cache holds; moves that it keeps before it starts afresh.
CACHE_PIECES = 800_000
CACHE_MOVES = 1_000_000
#: Bytes of a piece beyond which its tokens are taken as they become certain.
LONG_PIECE = 1 << 16
#: Bytes that the UTF-8 machine takes at once.
PORTION = 1 << 16
_FAR = 1 << 60
#: The key of a state's entries among its moves.
ENTRIES = -1


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            lines = (line.split() for line in f.read().splitlines() if line)
            self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.lengths = {rank: len(token) for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.fast = pattern == BYTE_PATTERN
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        #: The vocabulary as a trie: a node's child by its byte, the token that ends there, and whether it has children.
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner = bytearray([1])
        for spelt, rank in self.ranks.items():
            node = 0
            for b in spelt:
                below = self.child.get(node << 8 | b)
                if below is None:
                    below = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(0)
                    self.inner[node] = 1
                node = below
            self.token[node] = rank
        #: By rank: each token's decimal id and a space, and its bytes.
        top = max(self.bytes) + 1
        self.decimals = pa.array([b"%d " % i for i in range(top)], pa.large_binary())
        self.spelt = pa.array([self.bytes.get(i, b"") for i in range(top)], pa.large_binary())
        self._restart()
        self.pieces = Recent(CACHE_PIECES)

    def _restart(self) -> None:
        #: A state's entries are its open prefixes, longest lookahead first: last token (0: none, else rank + 1) << 32 | trie node of the bytes after it.
        #: A state itself is the dict of its moves, byte to (state, token), and of its entries.
        self.start = {ENTRIES: (0,)}
        self.states = {(0,): self.start}
        self.n_moves = 0

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token: its bytes encoded with lower ranks only."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.bytes[token]]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(a + b, _FAR), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def fit(self, one: int, two: int) -> bool:
        """Whether two tokens stay apart when their bytes are encoded together."""
        key = one << 32 | two
        found = self.fits.get(key)
        if found is not None:
            return found
        a, b, limit, found = one, two, _FAR, True
        ranks, spelt = self.ranks, self.bytes
        while True:
            if ranks.get(spelt[a] + spelt[b], _FAR) < limit:
                found = False
                break
            ha, hb = self._halves(a), self._halves(b)
            if ha and (not hb or a > b):
                limit, a = a, ha[1]
            elif hb:
                limit, b = b + 1, hb[0]
            else:
                break
        if len(self.fits) > CACHE_MOVES:
            self.fits.clear()
        self.fits[key] = found
        return found

    def _move(self, state: dict, byte: int) -> tuple[dict, int]:
        """The state after a byte, and the token that ends the encoding of the prefix read; made when first met."""
        child, tokens, inner, fits = self.child, self.token, self.inner, self.fits
        after, done = [], -1
        for entry in state[ENTRIES]:
            below = child.get((entry & 0xFFFFFFFF) << 8 | byte)
            if below is None:
                continue
            last, token = entry >> 32, tokens[below]
            if done < 0 and token >= 0 and (not last or fits.get(last - 1 << 32 | token) or self.fit(last - 1, token)):
                done = token
            if inner[below]:
                after.append(entry & ~0xFFFFFFFF | below)
        if done < 0:
            raise ValueError("no token ends here: the ranks lack a byte")
        after.append(done + 1 << 32)
        key = tuple(after)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = {ENTRIES: key}
        self.n_moves += 1
        move = state[byte] = (found, done)
        return move

    def _settled(self, state: dict, ends: list[int]) -> int:
        """Bytes of a prefix whose tokens no further byte can change: where the paths of all open prefixes meet.

        Open prefixes stand at most the longest token behind, so the lookahead is bounded.
        """
        i = len(ends)
        at = {i - self._depth(entry & 0xFFFFFFFF) for entry in state[ENTRIES]}
        while len(at) > 1:
            far = max(at)
            at.discard(far)
            at.add(far - self.lengths[ends[far - 1]])
        return at.pop()

    def _depth(self, node: int) -> int:
        if not self.depths:
            self.depths = [0] * len(self.token)
            for key, below in self.child.items():  # parents were entered first
                self.depths[below] = self.depths[key >> 8] + 1
        return self.depths[node]

    depths: list[int] = []

    def tokens(self, piece: Iterable[int], step: int = 1 << 12) -> Iterator[list[int]]:
        """Tokens of a stream of one piece's bytes; what has become certain is emitted after every ``step`` bytes."""
        state, ends = self.start, []
        for byte in piece:
            state, token = state.get(byte) or self._move(state, byte)
            ends.append(token)
            if len(ends) >= step:
                sure = self._settled(state, ends)
                if sure:
                    yield self._path(ends, sure)
                    del ends[:sure]
        yield self._path(ends, len(ends))

    def _path(self, ends: list[int], i: int) -> list[int]:
        """The tokens of the first i bytes, from the last token of each prefix."""
        lengths, out = self.lengths, []
        while i > 0:
            token = ends[i - 1]
            out.append(token)
            i -= lengths[token]
        out.reverse()
        return out

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        return tuple(i for part in self.tokens(piece) for i in part)

    def encode_pieces(self, wanted: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of distinct pieces; in sorted order each goes on from the prefix that it shares."""
        found: dict[bytes, bytes] = {}
        if self.n_moves > CACHE_MOVES:
            self._restart()
        make, lengths, whole = self._move, self.lengths, self.ranks
        states, ends = [self.start], []
        order = sorted(p for p in wanted if len(p) <= LONG_PIECE)
        for piece in wanted:
            if len(piece) > LONG_PIECE:
                found[piece] = b"".join(array("I", part).tobytes() for part in self.tokens(piece))
        for piece, same in zip(order, shared_prefixes(order), strict=True):
            if same < len(ends):
                del ends[same:], states[same + 1 :]
            rank = whole.get(piece)
            if rank is not None:
                found[piece] = rank.to_bytes(4, "little")
                continue
            state = states[-1]
            for byte in piece[len(ends) :]:
                state, token = state.get(byte) or make(state, byte)
                states.append(state)
                ends.append(token)
            i, out = len(ends), []
            while i > 0:
                token = ends[i - 1]
                out.append(token)
                i -= lengths[token]
            out.reverse()
            found[piece] = array("I", out).tobytes()
        return [found[p] for p in wanted]

    def split(self, column: pa.Array) -> Pieces:
        texts = Texts(column)
        if self.fast:
            return byte_pieces(texts)
        begin, end, at = [], [], 0
        for text in pc.fill_null(column, "").to_pylist():
            sizes = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]).astype(np.int64)
            for m in self.pattern.finditer(text):
                begin.append(at + sizes[m.start()])
                end.append(at + sizes[m.end()])
            at += int(sizes[-1])
        return Pieces(texts, np.array(begin, np.int64), np.array(end, np.int64))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column after each other, and the rows' places in them."""
        found = self.split(column)
        ids, at = found.joined(self.pieces.fetch(found.distinct, self.encode_pieces))
        return ids.view("<u4"), at // 4

    def encode(self, text: str) -> list[int]:
        """Tokens of a text, each match of the pattern by itself."""
        return self.encode_column(pa.array([text], pa.large_string()))[0].tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def stream(self, ids: Iterable[int], size: int = 4096) -> Iterator[str]:
        """Text of a stream of ids, a part for every ``size`` ids, cut only between characters."""
        machine, part = Utf8Machine(), []
        for i in ids:
            part.append(i)
            if len(part) == size:
                yield machine.feed(self.decode_bytes(part))
                part = []
        yield machine.feed(self.decode_bytes(part)) + machine.finish()


class Utf8Machine:
    """An incremental UTF-8 state machine: bytes in any portions, whole characters out.

    Its state is the bytes of the character that is still open. ``lengths`` gives
    for a lead byte how many bytes its character has; a stray continuation or a
    broken character becomes U+FFFD as in the standard decoder.
    """

    lengths = bytes([1] * 128 + [0] * 66 + [2] * 30 + [3] * 16 + [4] * 5 + [0] * 11)

    def __init__(self) -> None:
        self.open = b""

    def feed(self, portion: bytes) -> str:
        data = self.open + portion
        keep = 0
        for back in range(1, min(3, len(data)) + 1):  # a character's last 3 bytes at most can be missing
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                keep = back if self.lengths[lead] > back else 0
                break
        self.open = data[len(data) - keep :]
        return codecs.decode(data[: len(data) - keep], "utf-8", "replace")

    def finish(self) -> str:
        rest, self.open = self.open, b""
        return codecs.decode(rest, "utf-8", "replace")


_models: dict[tuple[str, str], ByteBpe] = keep_cache({})


def model(path: str, pattern: str) -> ByteBpe:
    """A vocabulary's transducer; built once in a worker."""
    if (path, pattern) not in _models:
        _models[path, pattern] = ByteBpe(path, pattern)
    return _models[path, pattern]


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256), one for each row of ``docs``.

    Every text is encoded, and its ids decoded again through the UTF-8 machine in
    portions. A null text counts as empty, without tokens. Repeated rows and null
    ids give a row each; an empty table gives none.
    """

    @tidied("byte_bpe")
    def code(batches):
        bpe = model(path, pattern)
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                ids, at = bpe.encode_column(batch.column("text"))
                decimal, ends = gathered(bpe.decimals, ids, at)
                ids_hash = [hashlib.sha256(decimal[a : max(b - 1, a)]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
                spelt, ends = gathered(bpe.spelt, ids, at)
                text_hash = []
                for a, b in zip(ends, ends[1:], strict=False):
                    digest, machine = hashlib.sha256(), Utf8Machine()
                    for i in range(a, b, PORTION):
                        digest.update(machine.feed(spelt[i : min(i + PORTION, b)].tobytes()).encode())
                    digest.update(machine.finish().encode())
                    text_hash.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at)), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(code, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
