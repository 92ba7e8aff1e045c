"""Token counts by rank-synchronous array merging.

Arrow splits the texts of a piece at white space and tells the chunks apart; those met before are found in a table of ids by
their bytes.  Pre-tokens of the rest lie in one ragged numpy array of symbols.  In every round each sequence's lowest-rank adjacent
pair is found by a segmented minimum and all its occurrences are merged, in all sequences at once; sequences without a
mergeable pair leave the array.  What survives are the tokens.  The result equals the `tokenizers` library's.

Rows: a null text counts as empty (0 tokens, 0 bytes); every row yields one row, repeated rows too; other columns are
ignored; an empty table yields an empty table.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import keyed_texts, map_arrow, mix64, text_bytes

#: Chunks of at most so many 64-bit numbers (without a zero byte) are kept, and so many of them; then the table is started anew.
KEY_NUMBERS, MOST_KEPT = 4, 1 << 20
#: Bytes of text that are encoded at once: chunks are looked up once in each piece.
ENCODED_BYTES = 1 << 21
#: White space for str.split and Arrow, but not for the vocabulary's pattern.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    seen = set(visible)
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class PairTable:
    """Ranks of symbol pairs in an open-addressed table that numpy probes for many pairs at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, bits: int = 20):
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, len(left), np.int32)
        self.none = np.int32(len(left))
        self.made = np.append(made.astype(np.int32), np.int32(-1))
        keys = self._key(left.astype(np.int64), right.astype(np.int64))
        slots = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            at = slots[todo]
            free = self.keys[at] == -1
            first = todo[free][np.unique(at[free], return_index=True)[1]]
            self.keys[slots[first]], self.ranks[slots[first]] = keys[first], first
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left << np.int64(20)) | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left.astype(np.int64), right.astype(np.int64))
        slots = self._slot(keys)
        found = self.keys[slots]
        out = self.ranks[slots]
        wrong = np.flatnonzero((found != keys) & (found != -1))
        while len(wrong):
            slots[wrong] = (slots[wrong] + 1) & self.mask
            found = self.keys[slots[wrong]]
            out[wrong] = self.ranks[slots[wrong]]
            wrong = wrong[(found != keys[wrong]) & (found != -1)]
        out[self.keys[slots] != keys] = self.none
        return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def put_in(ids: np.ndarray, counts: np.ndarray, missing: np.ndarray, new: np.ndarray, new_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of ids, one after another, with the new ones in the places of the missing, which are empty."""
    starts, counts = np.cumsum(counts) - counts, counts.copy()
    starts[missing], counts[missing] = len(ids) + np.cumsum(new_counts) - new_counts, new_counts
    return np.append(ids, new)[ragged(starts, counts)], counts


def binaries(ids: np.ndarray, counts: np.ndarray) -> pa.LargeBinaryArray:
    """Ranges of ids as values of 16-bit numbers."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(2 * np.append(0, np.cumsum(counts))), pa.py_buffer(ids.astype("<u2"))])


def as_lines(chunks: pa.LargeStringArray) -> str:
    """The chunks with a line end after each."""
    return text_bytes(pc.binary_join_element_wise(chunks, *(pa.scalar(x, pa.large_string()) for x in ("", "\n"))))[0].tobytes().decode()


class ChunkTable:
    """Ids of chunks, whose bytes are the keys of an open-addressed table that numpy probes for many chunks at once."""

    def __init__(self, most: int = MOST_KEPT):
        self.most, self.n, self.end = most, 0, 0
        self.shift = np.uint64(64 - (2 * most - 1).bit_length())
        self.mask = (1 << 64 - int(self.shift)) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.keys = np.zeros((most, KEY_NUMBERS), np.uint64)
        self.starts = np.zeros(most, np.int32)
        self.counts = np.zeros(most, np.uint8)
        self.ids = np.zeros(8 * most, np.uint16)

    @staticmethod
    def keys_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each chunk as numbers, filled up with zeros, and whether they tell it from all others."""
        sizes = np.diff(bounds)
        padded = np.append(raw, np.zeros(8 * KEY_NUMBERS, np.uint8))
        window = np.ndarray(len(raw) + 8 * (KEY_NUMBERS - 1) + 1, "<u8", padded, strides=(1,))
        keys = np.zeros((len(sizes), KEY_NUMBERS), np.uint64)
        for k in range(KEY_NUMBERS):
            use = np.flatnonzero(sizes > 8 * k)
            empty = (8 * np.maximum(8 * (k + 1) - sizes[use], 0)).astype(np.uint64)
            keys[use, k] = window[bounds[use] + 8 * k] << empty >> empty
        fits = sizes <= 8 * KEY_NUMBERS
        fits[np.searchsorted(bounds, np.flatnonzero(raw == 0), "right") - 1] = False
        return keys, fits

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        hashes = np.zeros(len(keys), np.uint64)
        for k in range(KEY_NUMBERS):
            hashes = mix64(hashes ^ keys[:, k]) if k < 2 else np.where(keys[:, k] > 0, mix64(hashes ^ keys[:, k]), hashes)
        return (hashes >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        slots = self._slot(keys)
        out = self.slots[slots]
        todo = np.flatnonzero(out >= 0)
        todo = todo[(self.keys[out[todo]] != keys[todo]).any(axis=1)]
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            out[todo] = self.slots[slots[todo]]
            todo = todo[out[todo] >= 0]
            todo = todo[(self.keys[out[todo]] != keys[todo]).any(axis=1)]
        return out

    def ids_of(self, keys: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The kept ids of all chunks, one after another, their counts, and the places of chunks that aren't kept."""
        entries = np.where(fits, self.find(keys), -1)
        counts = np.where(entries < 0, 0, self.counts[entries]).astype(np.int64)
        return self.ids[ragged(self.starts[entries], counts)], counts, np.flatnonzero(entries < 0)

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Keys that differ and aren't in the table, if there is room for them; a full table is started anew."""
        if self.n + len(keys) > self.most or self.end + len(ids) > len(self.ids):
            self.n = self.end = 0
            self.slots.fill(-1)
            if len(keys) > self.most or len(ids) > len(self.ids):
                return
        entries = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.keys[entries], self.counts[entries] = keys, counts
        self.starts[entries] = self.end + np.cumsum(counts) - counts
        self.ids[self.end : self.end + len(ids)] = ids
        self.n, self.end = self.n + len(keys), self.end + len(ids)
        at = self._slot(keys)
        while len(at):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]  # of several the last one stays
            lost = self.slots[at] != entries
            at, entries = (at[lost] + 1) & self.mask, entries[lost]


class WordBpe:
    """The merges of a BPE vocabulary with word ends, as arrays."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        symbols = byte_symbols()
        self.plain = np.array([vocab[c] for c in symbols], np.int32)
        self.final = np.array([vocab[c + suffix] for c in symbols], np.int32)
        self.table = PairTable(*(np.array([vocab[x] for x in part]) for part in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges])))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # no chunk has a line end, so many are cut at once
        self.pattern = regex.compile("\n|" + spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        #: What all special strings begin with: a text without it has none.
        self.mark = os.path.commonprefix(list(self.special))
        self.kept = ChunkTable()

    def merge(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one at least, one after another, and each word's count; raw: the words' bytes."""
        symbol = self.plain[raw]
        last = np.cumsum(lengths) - 1
        symbol[last] = self.final[raw[last]]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(raw))
        done_ids, done_places = [], []
        rank = np.full(len(raw), self.table.none, np.int32)
        if len(raw) > 1:
            rank[:-1] = self.table.rank(symbol[:-1], symbol[1:])
            rank[last] = self.table.none
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < self.table.none, sizes)
            if not live.all():
                done_ids.append(symbol[~live])
                done_places.append(place[~live])
                best = np.repeat(best, sizes)[live]
                symbol, owner, place, rank = symbol[live], owner[live], place[live], rank[live]
                if not len(symbol):
                    break
            else:
                best = np.repeat(best, sizes)
            hit = rank == best
            at = np.flatnonzero(hit)
            # of overlapping occurrences (a a a) the left one wins: every other one of a run
            opens = np.r_[True, np.diff(at) != 1]
            run = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbol[at] = self.table.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # the merged symbol ends where its right part ended
            fresh = (np.cumsum(keep) - 1)[at]
            symbol, owner, place, rank = symbol[keep], owner[keep], place[keep], rank[keep]
            touched = np.zeros(len(symbol), bool)
            touched[fresh] = True
            touched[fresh[fresh > 0] - 1] = True
            touched[:-1] &= owner[1:] == owner[:-1]
            touched[-1] = False
            near = np.flatnonzero(touched)
            rank[near] = self.table.rank(symbol[near], symbol[near + 1])
        ids, places = np.concatenate(done_ids), np.concatenate(done_places)
        order = np.argsort(places, kind="stable")
        first = np.cumsum(lengths) - lengths
        return ids[order], np.diff(np.r_[np.searchsorted(places[order], first), len(ids)])

    def ids_of(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different chunks without white space, one after another, and each chunk's count."""
        keys, fits = ChunkTable.keys_of(*text_bytes(chunks))
        ids, counts, missing = self.kept.ids_of(keys, fits)
        if not len(missing):
            return ids, counts
        words, spans = self.words_of(chunks.take(pa.array(missing)))
        different = words.dictionary_encode()
        word_ids, word_counts = self.word_ids(different.dictionary)
        starts, of = np.cumsum(word_counts) - word_counts, different.indices.to_numpy()
        new = word_ids[ragged(starts[of], word_counts[of])]  # the ids of a chunk's words follow one another
        new_counts = np.diff(np.append(0, np.cumsum(word_counts[of]))[np.append(0, np.cumsum(spans))])
        keep = fits[missing] & (spans != 1)  # chunks of one word are kept as words
        self.kept.add(keys[missing[keep]], new[np.repeat(keep, new_counts)], new_counts[keep])
        return put_in(ids, counts, missing, new, new_counts)

    def word_ids(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, one after another, and each word's count."""
        raw, bounds = text_bytes(words)
        sizes = np.diff(bounds)
        keys, fits = ChunkTable.keys_of(raw, bounds)
        ids, counts, missing = self.kept.ids_of(keys, fits)
        if not len(missing):
            return ids, counts
        new, new_counts = self.merge(raw[ragged(bounds[missing], sizes[missing])], sizes[missing])
        keep = fits[missing]
        self.kept.add(keys[missing[keep]], new[np.repeat(keep, new_counts)], new_counts[keep])
        return put_in(ids, counts, missing, new, new_counts)

    def words_of(self, chunks: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The words of all chunks by the vocabulary's pattern, one after another, and each chunk's number of them."""
        lines = pa.array(self.pattern.findall(as_lines(chunks)), pa.large_string())
        ends = pc.equal(lines, "\n").to_numpy(zero_copy_only=False)
        return lines.filter(pa.array(~ends)), np.diff(np.flatnonzero(ends), prepend=-1) - 1

    def segments(self, text: str) -> list[list[str]]:
        """Chunks of each part of the text between special strings."""
        if self.at_special is None or self.mark not in text:
            return [self.normal(text)]
        return [self.normal(x) for x in self.at_special.split(text)]

    @staticmethod
    def lowered(text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # lower case by single characters, without the final form
        return text.replace("Σ", "σ").lower()

    @classmethod
    def normal(cls, text: str) -> list[str]:
        # str.split also splits at the four ASCII separators, which are no white space for the vocabulary's pattern
        return [x for x in regex.split(r"[^\S\x1c-\x1f]+", cls.lowered(text)) if x]

    def encode_odd(self, text: str) -> bytes:
        """The ids of a text with special strings or separators that only str.split takes for white space."""
        parts = self.segments(text)
        chunks = pa.array([c for p in parts for c in p], pa.large_string()).dictionary_encode()
        all_ids = iter(binaries(*self.ids_of(chunks.dictionary)).take(chunks.indices).to_pylist())
        marks = [self.special[m].to_bytes(2, "little") for m in self.at_special.findall(text)] if len(parts) > 1 else []
        return b"".join(mark + b"".join(itertools.islice(all_ids, len(p))) for mark, p in zip([b"", *marks], parts, strict=True))

    def encode_column(self, texts: pa.Array) -> pa.LargeBinaryArray:
        """The ids of each text as little-endian 16-bit numbers; Arrow splits the texts and tells their chunks apart."""
        odd: dict[int, bytes] = {}
        low = []
        for k, text in enumerate(texts.to_pylist()):
            if (self.special and self.mark in text) or any(c in text for c in SEPARATORS):
                odd[k] = self.encode_odd(text)
                text = ""
            low.append(self.lowered(text))
        split = pc.utf8_split_whitespace(pa.array(low, pa.large_string()))
        chunks = split.values.dictionary_encode()
        ids = binaries(*self.ids_of(chunks.dictionary)).take(chunks.indices)
        # the ids of a text's chunks follow one another: only its bounds are needed
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()]
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(low), [None, pa.py_buffer(bounds), ids.buffers()[2]])
        return pa.array([odd.get(k, x) for k, x in enumerate(out.to_pylist())], pa.large_binary()) if odd else out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_string())).to_pylist()


_LOADED: dict[str, WordBpe] = {}


def loaded(name: str) -> WordBpe:
    """The vocabulary of this worker process; each executor opens its installed copy."""
    if name not in _LOADED:
        import public_tokenizers

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            spec = json.load(f)
        if len(spec["model"]["vocab"]) + len(spec["added_tokens"]) > 1 << 16:
            raise ValueError("ids are kept in 16 bits; this vocabulary has more")
        _LOADED[name] = WordBpe(spec)
    return _LOADED[name]


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every document; no shuffle."""

    def make():
        bpe = loaded(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = pc.binary_length(bpe.encode_column(batch.column(1))).to_numpy() // 2
            size = np.diff(text_bytes(batch.column(1))[1])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return work

    return map_arrow(keyed_texts(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", ENCODED_BYTES)
