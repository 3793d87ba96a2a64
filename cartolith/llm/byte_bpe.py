"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Encoding a piece by merges in order of rank equals the one segmentation into tokens whose neighbours are
all compatible: the merges, run over the two tokens' bytes alone, would give these two tokens again. That
makes BPE a regular relation. The transducer keeps, after each byte, every way in which the bytes read so
far can still go on: the tokens not yet emitted and a place in the trie of tokens for the one that is
being read. Such a set is one state; its transitions are worked out when they are first taken and kept.
As soon as all ways agree on their first tokens, those are emitted: after no more bytes than the longest
token has. Pieces not seen before step through the transitions together, a byte of each at a time, in whole-array
operations; only transitions taken for the first time are worked out one by one. The table of states and the table
of whole pieces are bounded and begin anew when full.

Decoding joins the tokens' bytes; StreamDecoder gives text for ids that come in parts and uses a state
machine over UTF-8 to hold back a character that is not yet whole.

Edge cases of annotate(): a null text counts as empty; an empty text has 0 tokens and the hashes of no
bytes. Texts are read whole. Rows repeat independently, a null id stays null; other input columns, whatever their
names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common as C

PIECES, STATES, PAIRS = 1_200_000, 300_000, 700_000  # entries kept at most
CHARS = 1 << 20  # of text encoded together; a longer text goes in parts between pieces
NO_PREVIOUS = -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Rows:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.n, self._data = 0, np.zeros(1024, dtype)

    def add(self, values) -> None:
        more = len(values)
        if self.n + more > len(self._data):
            self._data = np.concatenate([self._data[: self.n], np.zeros(max(more, self.n), self._data.dtype)])
        self._data[self.n : self.n + more] = values
        self.n += more

    def all(self) -> np.ndarray:
        return self._data[: self.n]


class _Moves:
    """Transitions by state << 8 | byte, in a table with linear probing: where each leads and what it emits."""

    def __init__(self, bits: int = 12):
        self.n = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.to, self.out = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not there."""
        at = self._place(keys)
        got = self.keys[at]
        left = np.flatnonzero((got != keys) & (got >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            got[left] = self.keys[at[left]]
            left = left[(got[left] != keys[left]) & (got[left] >= 0)]
        at[got != keys] = -1
        return at

    def add(self, keys: np.ndarray, to, out) -> None:
        """keys: all different and not there yet."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            full = self.keys >= 0
            keys, to, out = np.concatenate([self.keys[full], keys]), np.concatenate([self.to[full], to]), np.concatenate([self.out[full], out])
            self.n = 0
            self._make(max(12, int(4 * len(keys)).bit_length()))
        to, out = np.asarray(to, np.int32), np.asarray(out, np.int32)
        self.n += len(keys)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            spot = at[left]
            free = self.keys[spot] < 0
            self.keys[spot[free]] = keys[left[free]]  # of several that want a place the last has it
            won = self.keys[spot] == keys[left]
            self.to[spot[won]], self.out[spot[won]] = to[left[won]], out[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & self.mask


class ByteBpe:
    """ranks: token bytes to id; the id is also the order of merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        child: list[dict[int, int]] = [{}]  # for each node of the trie: byte to node
        ends: list[int] = [-1]
        for data, rank in ranks.items():
            self.token[rank] = data
            node = 0
            for byte in data:
                after = child[node].get(byte)
                if after is None:
                    after = child[node][byte] = len(ends)
                    ends.append(-1)
                    child.append({})
                node = after
            ends[node] = rank
        #: For each node: byte to the next node, whether that one has any further, and the token that ends there or -1.
        self._trie = [{byte: (to, bool(child[to]), ends[to]) for byte, to in x.items()} for x in child]
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self.longest = max(map(len, ranks))
        self._begin_anew()

    def _begin_anew(self) -> None:
        self._states: list[tuple] = [(NO_PREVIOUS, ((), 0))]  # the last token emitted, and the ways; 0 is the start
        self._known: dict[tuple, int] = {self._states[0]: 0}
        self._moves, self._ends = _Moves(), _Moves()  # by what a byte does inside a piece, and as the last of one
        self._out: dict[tuple, int] = {(): 0}  # runs of tokens that are emitted together
        self._out_begin, self._out_n, self._out_tokens = _Rows(np.int64), _Rows(np.int64), _Rows(np.int32)
        self._out_begin.add([0])
        self._out_n.add([0])

    def merged(self, data: bytes, below: int | None = None) -> list[int]:
        """BPE by its definition: the lowest-ranked neighbouring pair first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one (itself twice: a single byte); None: no merges lead to it."""
        if token not in self._halves:
            data = self.token[token]
            parts = [token, token] if len(data) == 1 else self.merged(data, token)
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE over both tokens' bytes gives these two tokens (over right alone, with no token before it).

        The merges that made them are undone from the last to the first; a merge across the border that
        comes before the one just undone would have happened instead.
        """
        known = self._fits.get((left, right))
        if known is not None:
            return known
        x, y, before = left, right, len(self.token) + 1
        fits = self.halves(right) is not None
        while fits and left != NO_PREVIOUS:
            across = self.ranks.get(self.token[x] + self.token[y])
            if across is not None and across < before:
                fits = False
                break
            inner, outer = self.halves(x)[1], self.halves(y)[0]
            if x > y and inner != x or outer == y:
                if inner == x:  # both are single bytes
                    fits = True
                    break
                before, x = x, inner  # the merge in x comes first among equals
            else:
                before, y = y + 1, outer
        if len(self._fits) >= PAIRS:
            self._fits.clear()
        self._fits[left, right] = fits
        return fits

    def _emission(self, tokens: tuple) -> int:
        got = self._out.get(tokens)
        if got is None:
            got = self._out[tokens] = len(self._out)
            self._out_begin.add([self._out_tokens.n])
            self._out_n.add([len(tokens)])
            self._out_tokens.add(tokens)
        return got

    def _go(self, state: int, byte: int) -> tuple[int, int]:
        """The state after a byte, and the number of what is emitted."""
        trie, fits, ways = self._trie, self._fits, []
        last, *now = self._states[state]
        for waiting, node in now:
            move = trie[node].get(byte)
            if move is None:
                continue
            node, further, token = move
            if further:  # a token that no longer one begins with cannot go on
                ways.append((waiting, node))
            if token >= 0:
                before = waiting[-1] if waiting else last
                fit = fits.get((before, token))
                if fit is None:
                    fit = self.compatible(before, token)
                if fit:
                    ways.append(((*waiting, token), 0))
        # tokens that all ways begin with can be emitted
        out, first = 0, ways[0][0]
        n = min([len(w) for w, _ in ways]) if first else 0
        for w, _ in ways:
            while n and w[:n] != first[:n]:
                n -= 1
        if n:
            last, out = first[n - 1], self._emission(first[:n])
            ways = [(w[n:], node) for w, node in ways]
        key = (last, *ways)
        after = self._known.get(key)
        if after is None:
            after = self._known[key] = len(self._states)
            self._states.append(key)
        return after, out

    def _finish(self, state: int, byte: int) -> tuple[int, int]:
        """0, and the number of the tokens still to emit when a piece ends with this byte: those of the one way that ends between tokens."""
        last, *now = self._states[state]
        for waiting, node in now:
            move = self._trie[node].get(byte)
            if move and move[2] >= 0 and self.compatible(waiting[-1] if waiting else last, move[2]):
                return 0, self._emission((*waiting, move[2]))
        raise ValueError("the vocabulary does not hold all bytes")

    @staticmethod
    def _step(table: _Moves, work_out, keys: np.ndarray) -> np.ndarray:
        """Places in a table of the transitions for keys (state << 8 | byte), worked out where they are taken for the first time."""
        at = table.find(keys)
        if (at < 0).any():
            new = np.unique(keys[at < 0])
            moves = [work_out(k >> 8, k & 255) for k in new.tolist()]
            table.add(new, [m[0] for m in moves], [m[1] for m in moves])
            at = table.find(keys)
        return at

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has."""
        if len(self._known) >= STATES:
            self._begin_anew()
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        order = np.argsort(-n, kind="stable")
        begin, n = (np.cumsum(n) - n)[order], n[order]
        state = np.zeros(len(order), np.int64)
        who, what, alive = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], len(order)
        for t in range(int(n[0]) if alive else 0):
            more = alive  # pieces that go on after this byte come before those that end with it
            while more and n[more - 1] <= t + 1:
                more -= 1
            keys = state[:alive] << 8 | data[begin[:alive] + t]
            at, end = self._step(self._moves, self._go, keys[:more]), self._step(self._ends, self._finish, keys[more:])
            state[:more] = self._moves.to[at]
            out = np.concatenate([self._moves.out[at], self._ends.out[end]])
            some = np.flatnonzero(out)
            who.append(some)
            what.append(out[some])
            alive = more
        who, what = order[np.concatenate(who)], np.concatenate(what)
        each = self._out_n.all()[what]
        counts = np.bincount(who, each, len(order)).astype(np.int64)
        in_turn = np.argsort(who, kind="stable")
        return self._out_tokens.all()[_ranges(self._out_begin.all()[what[in_turn]], each[in_turn])], counts

    def piece(self, data: bytes) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        whole = self.ranks.get(data)
        ids = self.pieces([data])[0] if whole is None else [whole]
        return np.asarray(ids, "<u4").tobytes()


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, .. n[i] numbers of each, one after another."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class _Pieces(dict):
    """Pieces seen before, with their ids. A piece that is not there counts as empty for now and is noted as new."""

    def __init__(self):
        self.new: dict[str, None] = {}

    def __missing__(self, piece: str) -> bytes:
        self.new[piece] = None
        return b""


class Tokenizer:
    def __init__(self, path: str, pattern: str):
        import regex

        self.bpe = ByteBpe(read_ranks(path))
        self._pattern = regex.compile(pattern)
        self._known = _Pieces()

    def _learn(self) -> None:
        known, ranks = self._known, self.bpe.ranks
        pieces, known.new = list(known.new), {}
        data = [p.encode("utf-8") for p in pieces]
        whole = [ranks.get(d) for d in data]
        ids, n = self.bpe.pieces([d for d, w in zip(data, whole) if w is None])
        coded, ends = ids.astype("<u4").tobytes(), iter((4 * np.cumsum(n)).tolist())
        at = 0
        for piece, w in zip(pieces, whole):
            if w is None:
                end = next(ends)
                known[piece] = coded[at:end]
                at = end
            else:
                known[piece] = w.to_bytes(4, "little")

    def _code(self, found: list[list[str]]) -> list[bytes]:
        """Ids of each list of pieces, as little-endian 32-bit integers."""
        if len(self._known) > PIECES:
            self._known = _Pieces()
        known, out, again = self._known, [], []
        for i, pieces in enumerate(found):
            before = len(known.new)
            out.append(b"".join(map(known.__getitem__, pieces)))
            if len(known.new) > before or (before and any(p in known.new for p in pieces)):
                again.append(i)
        if known.new:
            self._learn()
            for i in again:
                out[i] = b"".join(map(known.__getitem__, found[i]))
        return out

    def _code_long(self, text: str) -> bytes:
        matches, out = self._pattern.finditer(text), []
        while part := [m[0] for m in islice(matches, CHARS // 4)]:
            out += self._code([part])
        return b"".join(out)

    def encode_many(self, texts: list[str]):
        """Ids of each text as little-endian 32-bit integers, in order."""
        part, size, find = [], 0, self._pattern.findall
        for text in texts:
            if part and size + len(text) > CHARS:
                yield from self._code(list(map(find, part)))
                part, size = [], 0
            if len(text) > CHARS:
                yield self._code_long(text)
            else:
                part.append(text)
                size += len(text)
        if part:
            yield from self._code(list(map(find, part)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_many([text])), "<u4").tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bpe.token.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    gc.disable()  # the tables hold millions of small objects, none in cycles
    return Tokenizer(path, pattern)


def _utf8_machine() -> list[list[int]]:
    """Transitions over bytes: state 0 is between characters, 1 an error, further states wait inside one.

    Ranges of lead bytes with the ranges of the bytes that may follow, as the Unicode standard lists them.
    """
    forms = [
        ((0xC2, 0xDF), [(0x80, 0xBF)]),
        ((0xE0, 0xE0), [(0xA0, 0xBF), (0x80, 0xBF)]), ((0xE1, 0xEC), [(0x80, 0xBF)] * 2),
        ((0xED, 0xED), [(0x80, 0x9F), (0x80, 0xBF)]), ((0xEE, 0xEF), [(0x80, 0xBF)] * 2),
        ((0xF0, 0xF0), [(0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)]), ((0xF1, 0xF3), [(0x80, 0xBF)] * 3),
        ((0xF4, 0xF4), [(0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF)]),
    ]
    table = [[0] * 128 + [1] * 128, [1] * 256]
    waiting: dict[tuple, int] = {}

    def state(rest: tuple) -> int:
        if not rest:
            return 0
        if rest not in waiting:
            waiting[rest] = len(table)
            table.append([1] * 256)
            low, high = rest[0]
            row, after = table[-1], state(rest[1:])
            for b in range(low, high + 1):
                row[b] = after
        return waiting[rest]

    for (low, high), rest in forms:
        for b in range(low, high + 1):
            table[0][b] = state(tuple(rest))
    return table


UTF8 = _utf8_machine()


class StreamDecoder:
    """Text of ids that come in parts; bytes that are no UTF-8 give U+FFFD as bytes.decode("utf-8", "replace") does."""

    def __init__(self, token: list[bytes]):
        self.token, self.held = token, b""

    def feed(self, ids) -> str:
        data = self.held + b"".join(map(self.token.__getitem__, ids))
        whole = len(data) - self._unfinished(data)
        self.held = data[whole:]
        return data[:whole].decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that later bytes can complete."""
        for n in range(1, min(4, len(data) + 1)):
            state = 0
            for b in data[len(data) - n :]:
                state = UTF8[state][b]
            if state > 1 and data[-n] >= 0xC2:
                return n
        return 0

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def _annotate(path: str, pattern: str):
    def run(batches):
        t = tokenizer(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for coded in t.encode_many([x or "" for x in batch.column(1).to_pylist()]):
                ids = np.frombuffer(coded, "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(coded).hexdigest())
                decoder, digest = StreamDecoder(t.bpe.token), hashlib.sha256()
                for at in range(0, len(ids), 8192):
                    digest.update(decoder.feed(ids[at : at + 8192].tolist()).encode("utf-8"))
                digest.update(decoder.finish().encode("utf-8"))
                text_sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(path: str, pattern: str):
    def run(batches):
        t = tokenizer(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in t.encode_many([x or "" for x in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    C.prepare(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_encode(path, pattern), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows that encode() gave; null ids give a null text."""
    C.prepare(ids.sparkSession)

    def run(batches):
        t = tokenizer(path, pattern)
        for batch in batches:
            texts = []
            for x in batch.column(1).to_pylist():
                d = StreamDecoder(t.bpe.token)
                texts.append(None if x is None else d.feed(x) + d.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def annotate(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the bytes they decode to."""
    C.prepare(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        _annotate(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op3_byte_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = path or str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return annotate(C.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
