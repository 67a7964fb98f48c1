"""Operator 8: byte-level BPE by a finite-state transducer that is determinised as it is needed, and streaming decoding.

A sequence of tokens is the encoding of its bytes just if every two neighbours are the encoding of theirs. So a
nondeterministic transducer can guess where tokens end: its states are the token before and the bytes of the one being
read. Determinised, a state is the set of guesses that are still possible, of which there is at most one for each
place where a token may have begun, and so no more than the longest token has bytes. What all guesses agree on is
emitted at once, so output lags behind input by a bounded number of bytes however long a piece is. States and arcs
are made when texts need them for the second time; until then, the guesses are followed one by one.
"""

import base64
import gc
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept with their tokens, states and pairs kept at a time, and tokens handed to the streaming decoder at once.
CACHE, STATES, CHUNK = 3 << 17, 1 << 17, 512
#: Bytes to the end of a piece up to which an arc that is needed for the first time isn't made.
SHORT = 64


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Tokens and their numbers from a file of lines ``base64 number``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The encoding of a piece by merging neighbours, least rank first and of equal ones the leftmost: by definition."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 62))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[x] for x in parts]


def halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens that each token of several bytes is last merged from."""
    out = {}
    for data, n in ranks.items():
        if len(data) > 1:
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank = [ranks.get(parts[i] + parts[i + 1], 1 << 62) for i in range(len(parts) - 1)]
                at = rank.index(min(rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out[n] = ranks[parts[0]], ranks[parts[1]]
    return out


class Transducer:
    """Encodes bytes. A state is the last token that was output and a tuple of guesses, each the tokens since then and
    the node, in the trie of all tokens, of the token being read. Arcs lead from a state by a byte to the next state
    and the tokens to output."""

    def __init__(self, ranks: dict[bytes, int], parts: dict[int, tuple[int, int]] | None = None, states: int = STATES) -> None:
        self.ranks, self.most = ranks, states
        self.token = {n: t for t, n in ranks.items()}
        self.parts = halves(ranks) if parts is None else parts
        self.joined = {x: n for n, x in self.parts.items()}
        self.child: dict[int, int] = {}
        self.whole = [-1]  # token of each node
        for data, n in ranks.items():
            node = 0
            for byte in data:
                key = node << 8 | byte
                below = self.child.get(key)
                if below is None:
                    below = self.child[key] = len(self.whole)
                    self.whole.append(-1)
                node = below
            self.whole[node] = n
        self.agree: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.guesses: list[tuple] = []
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.once: set[int] = set()  # arcs that were needed once
        self.add((-1, (((), 0),)))

    def add(self, state: tuple) -> int:
        at = self.number.setdefault(state, len(self.guesses))
        if at == len(self.guesses):
            self.guesses.append(state)
        return at

    def follows(self, a: int, b: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes: whether, going back through the merges
        that made them, latest first, nothing on either side of the border would have merged sooner."""
        if a < 0:
            return True
        known = self.agree.get(a << 20 | b)
        if known is None:
            if len(self.agree) >= 16 * self.most:
                self.agree.clear()
            known = self.agree[a << 20 | b] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        parts, joined, least = self.parts, self.joined, 1 << 62
        while True:
            over = joined.get((a, b))
            if over is not None and over < least:
                return False
            inner, outer = parts.get(a), parts.get(b)
            if inner is None and outer is None:
                return True
            # of equal ranks the left merge comes first, so a rank on the right also bars its equal across the border
            if outer is None or inner is not None and a > b:
                least, a = a, inner[1]
            else:
                least, b = b + 1, outer[0]

    def arc(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Makes the arc from a state by a byte."""
        last, guesses = self.guesses[at]
        below, whole, agree, found = self.child.get, self.whole, self.agree.get, []
        start, ahead = below(byte), True  # ahead: every guess has a token to show
        for tokens, node in guesses:
            longer = below(node << 8 | byte)
            if longer is not None:
                found.append((tokens, longer))
                if not tokens:
                    ahead = False
            n = whole[node]
            if n >= 0:
                a = tokens[-1] if tokens else last
                good = agree(a << 20 | n)
                if good is None:
                    good = self.follows(a, n)
                if good:
                    found.append(((*tokens, n), start))
        out = ()
        if ahead:
            first = found[0][0]
            if len(found) == 1:
                out, found = first, [((), found[0][1])]
            else:
                shared = min([len(t) for t, _ in found])
                while shared and [1 for t, _ in found if t[:shared] != first[:shared]]:
                    shared -= 1
                if shared:
                    out, found = first[:shared], [(t[shared:], o) for t, o in found]
            if out:
                last = out[-1]
        result = self.arcs[at << 8 | byte] = self.add((last, tuple(found))), out
        return result

    def end(self, at: int) -> tuple[int, ...]:
        """The tokens still to output where the input ends."""
        known = self.ends.get(at)
        if known is None:
            last, guesses = self.guesses[at]
            known = self.ends[at] = next(((*t, n) for t, o in guesses if (n := self.whole[o]) >= 0 and self.follows(t[-1] if t else last, n)), ())
        return known

    def rest(self, at: int, data: bytes) -> tuple[int, ...]:
        """The tokens still to output where only ``data`` follows, from the guesses themselves, without making arcs."""
        last, held = self.guesses[at]
        below, whole, agree = self.child.get, self.whole, self.agree.get
        # guesses as (tokens before, last token, node), where tokens before are nested pairs
        guesses = [((None, t), t[-1] if t else last, node) for t, node in held]
        for byte in data:
            found, start = [], below(byte)
            for before, a, node in guesses:
                longer = below(node << 8 | byte)
                if longer is not None:
                    found.append((before, a, longer))
                n = whole[node]
                if n >= 0:
                    good = agree(a << 20 | n)
                    if good is None:
                        good = self.follows(a, n)
                    if good:
                        found.append(((before, n), n, start))
            guesses = found
        for before, a, node in guesses:
            n = whole[node]
            if n >= 0 and self.follows(a, n):
                tokens = [n]
                while before[0] is not None:
                    before, n = before
                    tokens.append(n)
                return (*before[1], *reversed(tokens))
        return ()

    def encode(self, data: bytes) -> list[int]:
        """Tokens of one piece, from left to right in one pass. An arc is made when it is needed for the second time."""
        out: list[int] = []
        at, arcs, size = 0, self.arcs, len(data)
        for i, byte in enumerate(data):
            key = at << 8 | byte
            step = arcs.get(key)
            if step is None:
                if key not in self.once and size - i <= SHORT:
                    self.once.add(key)
                    out += self.rest(at, data[i:])
                    return out
                step = self.arc(at, byte)
                if len(self.guesses) > self.most or len(self.once) > 4 * self.most:  # start afresh from the state that was reached
                    here = self.guesses[step[0]]
                    self.forget()
                    arcs = self.arcs
                    step = self.add(here), step[1]
            at, tokens = step
            if tokens:
                out += tokens
        out += self.end(at)
        return out


class Pieces(dict):
    """Tokens of pieces as packed int32, encoded when first asked for. What isn't met again before the next turn of
    ``most`` pieces is forgotten."""

    def __init__(self, transducer: Transducer, most: int) -> None:
        super().__init__()
        self.transducer, self.most, self.older = transducer, most, {}

    def __missing__(self, piece: str) -> bytes:
        tokens = self.older.get(piece)
        if tokens is None:
            tokens = array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= SHORT:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = tokens
        return tokens


class Encoder:
    """Texts to tokens: cut into pieces by the pattern, of which frequent ones are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, parts: dict[int, tuple[int, int]] | None = None, cache: int = CACHE) -> None:
        import regex

        self.pieces = regex.compile(pattern).findall
        self.transducer = Transducer(ranks, parts)
        self.known = Pieces(self.transducer, cache)

    def packed(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.pieces(text))), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.packed(text).tolist()


#: States of the UTF-8 machine: 0 between characters, 1 to 3 that many plain continuation bytes to come, 4 to 7 after
#: E0, ED, F0 and F4, whose next byte is restricted, 8 an error. Rows are states, columns bytes.
def _machine() -> list[bytes]:
    table = [bytearray([8]) * 256 for _ in range(9)]
    for b in range(256):
        table[0][b] = 0 if b < 0x80 else 8 if b < 0xC2 else 1 if b < 0xE0 else 4 if b == 0xE0 else 5 if b == 0xED else 2 if b < 0xF0 else 6 if b == 0xF0 else 3 if b < 0xF4 else 7 if b == 0xF4 else 8
    for state, low, high, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        for b in range(low, high + 1):
            table[state][b] = to
    return [bytes(x) for x in table]


MACHINE = _machine()
#: Runs of bytes that take the machine out of state 0; of a first byte, the bits that belong to the character.
_HIGH = re.compile(rb"[\x80-\xff]+")
_BITS = bytes(b & 0x1F if b < 0xE0 else b & 0x0F if b < 0xF0 else b & 0x07 for b in range(256))
BAD = "\ufffd"


class Utf8Stream:
    """Bytes in any portions to text, by the machine: what is held is its state and the bits of the unfinished character. An impossible
    byte ends the character before it, and each such part becomes U+FFFD. In state 0 the machine stays where it is for
    all ASCII bytes, so runs of these are taken at once."""

    def __init__(self) -> None:
        self.state, self.point = 0, 0

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        at, state, point, machine = 0, self.state, self.point, MACHINE
        for m in _HIGH.finditer(data):
            begin, end = m.span()
            if begin > at:
                if state:
                    out.append(BAD)
                    state = 0
                out.append(data[at:begin].decode("ascii"))
            for b in data[begin:end]:
                to = machine[state][b]
                if to == 8:
                    if state:
                        out.append(BAD)
                        state, to = 0, machine[0][b]
                    if to == 8:
                        out.append(BAD)
                        continue
                point = point << 6 | b & 63 if state else _BITS[b]
                state = to
                if not state:
                    out.append(chr(point))
            at = end
        if at < len(data):
            if state:
                out.append(BAD)
                state = 0
            out.append(data[at:].decode("ascii"))
        self.state, self.point = state, point
        return "".join(out)

    def close(self) -> str:
        rest, self.state, self.point = BAD if self.state else "", 0, 0
        return rest


class StreamDecoder:
    """Tokens in any portions to text; unknown numbers raise KeyError."""

    def __init__(self, token: dict[int, bytes]) -> None:
        self.token, self.stream = token, Utf8Stream()

    def feed(self, tokens: list[int]) -> str:
        return self.stream.feed(b"".join(map(self.token.__getitem__, tokens)))

    def close(self) -> str:
        return self.stream.close()

    def decode(self, tokens: list[int], chunk: int = CHUNK) -> str:
        return "".join([self.feed(tokens[i : i + chunk]) for i in range(0, len(tokens), chunk)]) + self.close()


def encoder_of(shared) -> Encoder:
    """This worker's encoder: it lives with the broadcast value, so what it has determinised serves later tasks too."""
    own = shared.value
    if "encoder" not in own:
        own["encoder"] = Encoder(own["ranks"], own["pattern"], own["parts"])
    return own["encoder"]


def encoded(shared):
    """Rows (doc_id, text) to (doc_id, tokens, n_tokens, n_bytes, restored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables hold no cycles, and walking them costs more than encoding
        try:
            yield from rows(batches)
        finally:
            gc.enable()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        decoder = StreamDecoder(encoder.transducer.token)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens, sizes, same = [], [], []
                for text in part.column(1).to_pylist():
                    row = None if text is None else encoder.packed(text)
                    tokens.append(row)
                    sizes.append(None if text is None else len(text.encode()))
                    same.append(None if row is None else decoder.decode(row.tolist()) == text)
                null = pa.array([t is None for t in tokens])
                lengths = np.array([0 if t is None else len(t) for t in tokens])
                flat = np.concatenate([np.zeros(0, np.int32), *(t for t in tokens if t is not None)])
                offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=null)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(lengths, mask=np.array(null)), pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "tokens", "n_tokens", "n_bytes", "restored"])

    return run


def decoded(shared):
    """Rows (doc_id, tokens) to (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = StreamDecoder(encoder_of(shared).transducer.token)
        for batch in batches:
            texts = [None if t is None else decoder.decode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _shared(df: DataFrame, path: str, pattern: str):
    # the size of the vocabulary, which doesn't grow with the data
    ranks = read_ranks(path)
    return df.sparkSession.sparkContext.broadcast({"ranks": ranks, "parts": halves(ranks), "pattern": pattern})


def bpe_encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, tokens, n_tokens, n_bytes, restored): the tokens of every whole text, and whether streaming decoding
    gave the text back.

    A null text has null in all columns but doc_id; an empty text has no tokens, and texts of any length are encoded whole. Of merges of equal rank
    the leftmost comes first. Repeated rows give repeated results; null doc_ids stay null. Other columns may have any names. An empty table gives no rows.
    Special tokens' strings are ordinary text.
    """
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(encoded(_shared(docs, path, pattern)), "doc_id long, tokens array<int>, n_tokens long, n_bytes long, restored boolean")


def bpe_decode(rows: DataFrame, path: str = VOCABULARY, id_column: str = "doc_id", tokens_column: str = "tokens") -> DataFrame:
    """(doc_id, text) of token lists. Null lists give null, bytes that aren't UTF-8 give U+FFFD, unknown tokens fail."""
    own = pick(rows, doc_id=id_column, tokens=tokens_column).select(F.col("doc_id").cast("long"), F.col("tokens").cast("array<int>"))
    return own.mapInArrow(decoded(_shared(rows, path, PATTERN)), "doc_id long, text string")
