"""Exact byte-pair encoding by backtracking over longest token matches.

A vocabulary of byte tokens with merge ranks defines one encoding of a piece
of text. It is found here without running the merges: an Aho-Corasick
automaton gives all tokens that start at each byte; the encoder takes the
longest, checks it against its left neighbour in a table of compatible pairs
(two tokens are compatible if encoding their concatenation gives just these
two), and steps back where no token fits. Decoding reads a table of offsets
into the concatenated token bytes.

Text is cut into pieces first (letters, digits, other signs, white space),
vectorised over a whole batch; each distinct piece is encoded once and kept.
"""

from __future__ import annotations

import base64
import functools

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Distinct pieces that a worker keeps; the table is emptied when full.
KEPT_PIECES = 500_000
#: Pairs of tokens whose compatibility a worker keeps; the table is emptied when full.
KEPT_PAIRS = 2_000_000
#: Pieces longer than this are encoded when met and not kept.
LONGEST_KEPT = 256


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id, from a file of lines with a base64 token and its rank."""
    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranks[i] for i in range(len(ranks))]


@functools.cache
def character_classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    classes = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, points):
            a, b = ord(found[0][0]), ord(found[0][-1])
            # a run never spans the surrogates: no letter stands on either side
            classes[a : b + 1] = kind
    return classes


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """A mask of the code points that begin a piece.

    points holds the code points of all texts, text_starts the place where
    each non-empty text begins. A piece is a run of one class, with one blank
    before it if there is one; of more white space before a run all but the
    last is a piece; 's 'd 'm 't 'll 've 're are pieces where an apostrophe
    begins one.
    """
    n = len(points)
    kind = character_classes()[points]
    begins_text = np.zeros(n + 1, bool)
    begins_text[text_starts] = True
    begins_text[n] = True
    run = np.empty(n + 1, bool)
    run[0] = run[n] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:n])
    run |= begins_text
    starts = run[:n].copy()
    # white space directly before a run of the same text
    head = np.flatnonzero(run[1:n] & (kind[: n - 1] == SPACE) & ~begins_text[1:n]) + 1
    starts[head - 1] = True
    glued = head[points[head - 1] == 32]
    starts[glued] = False
    # apostrophes that begin a piece, directly before a letter
    mark = np.flatnonzero((points[: n - 1] == 39) & starts[: n - 1] & run[1:n] & ~begins_text[1:n] & (kind[1:] == LETTER)) if n > 1 else np.zeros(0, np.int64)
    first = points[mark + 1]
    second = np.where(mark + 2 < n, points[np.minimum(mark + 2, n - 1)], 0)
    second[begins_text[mark + 2]] = 0
    one = np.isin(first, [ord(c) for c in "sdmt"])
    two = ~one & (((first == ord("l")) & (second == ord("l"))) | ((second == ord("e")) & ((first == ord("v")) | (first == ord("r")))))
    for at, length in ((mark[one], 2), (mark[two], 3)):
        starts[at + 1] = False
        after = at + length
        starts[after[after < n]] = True
    return starts


class Encoder:
    """Encodes and decodes with one vocabulary of byte tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {token: i for i, token in enumerate(tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.kept: dict[bytes, np.ndarray] = {}
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by its definition: join the pair of lowest rank, the first such, again and again."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [self.ids.get(a + b, len(self.ids)) for a, b in zip(parts, parts[1:])]
            least = min(ranked)
            if least == len(self.ids):
                break
            at = ranked.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def piece(self, piece: bytes) -> list[int]:
        """The encoding of one piece, in time linear in its length."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        at: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            at[end + 1 - length].append((length, token))  # shorter ones end earlier, so come earlier
        taken: list[int] = []
        stack = [list(at[0])]
        place, dead = 0, [False] * (size + 1)
        places = [0]
        while place < size:
            options = stack[-1]
            while options:
                length, token = options.pop()
                if not dead[place + length] and (not taken or self.compatible(taken[-1], token)):
                    taken.append(token)
                    place += length
                    break
            else:
                # Tokens that are compatible one by one are the encoding of the text they cover, so only one
                # row of tokens ever leads to a place: what fails there once fails for good.
                if not taken:
                    raise ValueError("a byte of the text is no token")
                dead[place] = True
                stack.pop()
                places.pop()
                taken.pop()
                place = places[-1]
                continue
            places.append(place)
            stack.append(list(at[place]) if place < size else [])
        return taken

    def distinct(self, pieces: pa.Array) -> list[np.ndarray]:
        """The encodings of distinct pieces, from the table of kept ones where possible."""
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        out = []
        for piece in pieces.to_pylist():
            ids = self.kept.get(piece)
            if ids is None:
                ids = np.array(self.piece(piece), np.int32)
                if len(piece) <= LONGEST_KEPT:
                    self.kept[piece] = ids
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); null is empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        raw = b"".join(texts.to_pylist())
        counts = np.zeros(len(texts), np.int64)
        if not raw:
            return np.zeros(0, np.int32), counts
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        byte_at_text = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(raw, np.uint8)
        lead = (data & 0xC0) != 0x80
        if lead.all():
            points, byte_at = data, None
            text_at = byte_at_text
        else:
            points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
            byte_at = np.flatnonzero(lead)
            text_at = np.searchsorted(byte_at, byte_at_text)
        starts = np.flatnonzero(piece_starts(points, text_at[:-1][sizes > 0]))
        cuts = starts if byte_at is None else byte_at[starts]
        cuts = np.append(cuts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
        encoded = self.distinct(pieces.dictionary)
        lengths = np.array([len(x) for x in encoded])
        flat = np.concatenate(encoded)
        where = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        index = pieces.indices.to_numpy()
        each = lengths[index]
        ends = np.cumsum(each)
        ids = flat[np.repeat(where[index] - (ends - each), each) + np.arange(ends[-1])]
        total_at = np.concatenate([[0], ends])[np.searchsorted(starts, text_at)]
        return ids, np.diff(total_at)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a list of ids."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        length = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(length)
        return self.bytes[np.repeat(self.offsets[ids] - (ends - length), length) + np.arange(ends[-1])].tobytes()


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, once per process."""
    return Encoder(read_ranks(path))
