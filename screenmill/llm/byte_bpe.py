"""Byte-level BPE by backtracking over the longest matches of an Aho-Corasick automaton.

Bytes are mapped to Latin-1 characters, so that pyahocorasick can look for all tokens in a pre-token at once.  From the
left the longest token that starts at a place is tried; it stands if the token before it and it are compatible, that is
if merging their bytes together gives just these two tokens again.  Compatibility of two neighbours is memoised.  If no
token that starts at a place stands, the token before is taken back and a shorter one tried, and the place is never
visited again, which bounds the steps by the length.  The result equals merging by ranks.

Rows: a null text counts as empty (0 tokens; both digests are those of no bytes); every row yields one row; other
columns are ignored; an empty table yields an empty table.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import keyed_texts, map_arrow

#: Caches and memos are started anew beyond so many entries, keeping the last full one to look in; longer pieces aren't kept: memory stays bounded.
CACHE_ENTRIES, LONGEST_KEPT = 200_000, 100
MEMO_ENTRIES = 1_000_000


#: Count, decimal ids each after a space, and the bytes that these ids decode to.
Coded = tuple[int, bytes, bytes]


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.size_of = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
        self.digits = [b" %d" % i for i in range(len(self.size_of))]
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.memo: dict[int, bool] = {}
        self.words: dict[str, Coded] = {}
        self.old_words: dict[str, Coded] = {}
        self.pieces: dict[str, Coded] = {}
        self.old_pieces: dict[str, Coded] = {}

    def prefix(self, token: int) -> int:
        """The longest other token that the token begins with; -1 if there is none."""
        if token not in self.shorter:
            b = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ranks), -1)
        return self.shorter[token]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            piece = [bytes([b]) for b in self.bytes_of[token]]
            while len(piece) > 2:
                k = min(range(len(piece) - 1), key=lambda i: self.ranks.get(piece[i] + piece[i + 1], token))
                piece[k : k + 2] = [piece[k] + piece[k + 1]]
            self.halves[token] = (self.ranks[piece[0]], self.ranks[piece[1]]) if len(piece) == 2 else None
        return self.halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes together leaves the border between them.

        Looks back in time from the finished tokens: of the two symbols at the border the one that was made later is
        taken apart.  Had the two symbols at the border a merge that comes before the next event, it would have crossed.
        """
        key = left << 20 | right
        good, bound = True, 1 << 60
        while True:
            joint = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joint is not None and joint < bound and self.parts(joint) == (left, right):
                good = False
                break
            a, b = self.parts(left), self.parts(right)
            if a is None and b is None:
                break
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]  # at equal ranks the left merge comes first
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        self.memo[key] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank  # ends come in order, so the longest stays
        size_of, memo, shorter = self.size_of, self.memo, self.shorter
        out: list[int] = []
        open_ = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0] if n else -1
        last = -1
        while at < n:
            while token >= 0:
                end = at + size_of[token]
                if open_[end]:
                    if last < 0:
                        break
                    good = memo.get(last << 20 | token)
                    if good if good is not None else self.compatible(last, token):
                        break
                token = shorter[token] if token in shorter else self.prefix(token)
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                token = out.pop()
                at -= size_of[token]
                last = out[-1] if out else -1
                token = self.prefix(token)
        return out

    def word(self, word: str) -> Coded:
        known = self.words.get(word)
        if known is None:
            known = self.old_words.get(word)
            if known is None:
                ids = self.encode_piece(word.encode())
                known = len(ids), b"".join([self.digits[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids])
            if len(word) > LONGEST_KEPT:
                return known
            if len(self.words) >= CACHE_ENTRIES:
                self.old_words, self.words = self.words, {}
            self.words[word] = known
        return known

    def learn(self, piece: str) -> Coded:
        found = [self.word(w) for w in self.pattern.findall(piece)]
        if len(found) == 1:
            return found[0]
        count, ids, data = zip(*found, strict=True)
        return sum(count), b"".join(ids), b"".join(data)

    def encode(self, text: str) -> Coded:
        """The same of a whole text.

        A single space between two characters that are no white space always begins a pre-token, so texts are cut there
        and the pieces, which recur, are looked up.
        """
        if not text:
            return 0, b"", b""
        first, *cut = text.split(" ")
        if not first or first[-1].isspace():
            return self.learn(text)
        if len(self.pieces) >= CACHE_ENTRIES:
            self.old_pieces, self.pieces = self.pieces, {}
        pieces, old = self.pieces, self.old_pieces
        found = [self.learn(first)]
        for piece in cut:
            known = pieces.get(piece)
            if known is None:
                known = old.get(piece)
                if known is None:
                    if not piece or piece[0].isspace() or piece[-1].isspace():
                        return self.learn(text)
                    known = self.learn(" " + piece)
                if len(piece) <= LONGEST_KEPT:
                    pieces[piece] = known
            found.append(known)
        count, ids, data = zip(*found, strict=True)
        return sum(count), b"".join(ids), b"".join(data)


_LOADED: dict[str, ByteBpe] = {}


def loaded(name: str) -> ByteBpe:
    """The vocabulary of this worker process; each executor opens its installed copy."""
    if name not in _LOADED:
        import public_tokenizers

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[name] = ByteBpe(ranks, public_tokenizers.PATTERN)
    return _LOADED[name]


def encode_decode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids as text and of the bytes that they decode to; no shuffle."""

    def make():
        bpe = loaded(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            digest = lambda b: hashlib.sha256(b).hexdigest()
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([digest(i[1:]) for _, i, _ in rows], pa.string()), pa.array([digest(d) for _, _, d in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return work

    return map_arrow(keyed_texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
