"""Removal of repeated 50-byte strings by prefix-free parsing.

A byte is removed if it lies in a string of 50 bytes that also starts in a document with a smaller doc_id.

Parsing: a rolling hash over `GRAM` bytes sets triggers: the trigger of a 50-byte string is its GRAM bytes of smallest
hash.  The successive strings with one trigger make a phrase; a phrase overlaps the next by 49 bytes, so every string lies
whole in one phrase, and no phrase of one trigger can begin within another's strings.  The phrases of all documents are
the dictionary, the order of a document's phrases is its parse.  Since the overlap is as long as the strings are, what
follows a phrase in the parse never decides the order of two strings of 50 bytes: the corpus order (as far as 50 bytes
decide it) is that of the triggers, and within a trigger that of the suffix array of its phrases; the parse tells which
documents stand at each place in it.

1. Documents are packed into blocks of about `block_bytes`.  A block sends each of its different phrases once, by a hash
   of 48 bits beside that of the trigger (32 bits and the shard's), with its smallest doc_id, to a shard by trigger.  The
   shard finds phrases that a smaller document of another block has (all their strings go), and triggers that have
   several phrases, as at the borders of repeated passages.
2. Of these the first block of each phrase sends the bytes.  The shard builds their suffix array by prefix doubling on
   bytes (8, 16, 32, 50), in which equal strings stand side by side, and returns which strings of a phrase a smaller
   document has in another one.
3. The blocks apply what comes back: bits in the order in which they had sent their phrases, so that nothing is matched
   by hashes inside a document.

Hot triggers (of a third of all documents, say, with another phrase in each, as where one passage follows different
texts) would bring all these phrases to one shard.  They are looked for in a bounded number of blocks, which decides the route
only: for them the blocks send a hash of 128 bits for each different string, dealt by that hash, instead of phrases.

Memory: a block is worked on in pieces of a quarter of a megabyte, long texts in overlapping segments; shards are sized by the
bytes of all documents.  Rows: a null text counts as empty; texts under 50 bytes lose nothing; rows with equal doc_id
never remove each other's bytes; a null doc_id counts as larger than all others; every row yields one row; other columns
are ignored; an empty table yields an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_number, from_planes, gathered, grouped_arrow, met_arrow, mix64, planes, powers, release, settled, text_bytes, unzipped, whole_text, zipped

SPAN = 50
GRAM = 20
STRINGS = SPAN - GRAM + 1  # most strings that a phrase can have: it must fit 32 bits of a mask
LAST = np.iinfo(np.int64).max  # stands for a null doc_id
_SEED = np.uint64(0x632BE59BD9B4E019)
_LOW32 = np.uint64(0xFFFFFFFF)
#: Hot triggers are looked for in so many blocks, in which they have more than so many phrases: the list is bounded.
HOT_BLOCKS, HOT_LEAST = 8, 100
#: Bytes of text whose hashes are held at once, about 80 bytes for each.
PARSED_BYTES = 1 << 18
#: Bytes of phrases whose suffixes are sorted at once (more only if one trigger has more).
SORTED_BYTES = 1 << 19


class Phrases:
    """The phrases of texts: row, first and one past the last start of their strings, hashes of trigger and phrase."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        parts = [self._piece(raw, *piece) for piece in text_pieces(bounds)]
        self.row, self.first, self.stop, self.trigger, self.phrase = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2

    @staticmethod
    def _piece(raw: np.ndarray, low: int, bounds: np.ndarray, row: int) -> tuple[np.ndarray, ...]:
        """bounds: of texts or segments, from low; row: the first one's."""
        raw = raw[low : low + int(bounds[-1])]
        n = len(raw)
        power, inverse = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        grams = mix64((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1] + _SEED)
        # the smallest hash of each window of STRINGS grams, with its place in the low bits: ties go to the left
        least = (grams & ~_LOW32) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while 2 * step <= STRINGS:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < STRINGS:
            least = np.minimum(least[: len(least) - (STRINGS - step)], least[STRINGS - step :])
        at = (least & _LOW32).astype(np.int64)
        # strings must end in the text in which they start
        valid = np.zeros(len(at) + 1, np.int8)
        long = np.diff(bounds) >= SPAN
        np.add.at(valid, bounds[:-1][long], 1)
        np.add.at(valid, (bounds[1:] - SPAN + 1)[long], -1)
        valid = np.cumsum(valid[:-1]) > 0
        fresh = np.flatnonzero(valid & np.r_[True, (at[1:] != at[:-1]) | ~valid[:-1]])
        owner = np.searchsorted(bounds, fresh, "right") - 1
        stop = np.minimum(np.r_[fresh[1:], len(at)], bounds[owner + 1] - SPAN + 1)
        length = stop - 1 + SPAN - fresh
        phrase = mix64((sums[fresh + length] - sums[fresh]) * inverse[fresh] + (length * 64 + at[fresh] - fresh).astype(np.uint64) * _SEED)
        # mixed again, as the smallest of many hashes are no even numbers
        return owner + row, fresh + low, stop + low, mix64(grams[at[fresh]]), phrase & np.uint64((1 << 48) - 1)


def text_pieces(bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """(low, bounds from low, first row) of runs of texts of about PARSED_BYTES; a longer text is cut into segments that share SPAN - 1 bytes."""
    k, n = 0, len(bounds) - 1
    while k < n:
        low = int(bounds[k])
        if int(bounds[k + 1]) - low > PARSED_BYTES:
            high = int(bounds[k + 1])
            for at in range(low, high - SPAN + 1, PARSED_BYTES):
                yield at, np.array([0, min(PARSED_BYTES + SPAN - 1, high - at)]), k
            k += 1
            continue
        last = max(k + 1, int(np.searchsorted(bounds, low + PARSED_BYTES, "right")) - 1)
        if int(bounds[last]) - low >= SPAN:
            yield low, bounds[k : last + 1] - low, k
        k = last


def pack48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def shard_edges(sorted_hashes: np.ndarray, n_shards: int) -> np.ndarray:
    """Where the shards, which are ranges of the hashes' high halves, begin in a sorted array, and its end."""
    edges = ((np.arange(n_shards, dtype=np.uint64) << np.uint64(32)) // np.uint64(n_shards)) << np.uint64(32)
    return np.r_[np.searchsorted(sorted_hashes, edges), len(sorted_hashes)]


def first_places(sorted_arrays: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where a new combination begins in arrays that are sorted together."""
    n = len(sorted_arrays[0])
    new = np.zeros(n, bool)
    for x in sorted_arrays:
        new[1:] |= x[1:] != x[:-1]
    if n:
        new[0] = True
    return np.flatnonzero(new)


def string_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the strings of SPAN bytes at the starts."""
    bytes_ = np.lib.stride_tricks.sliding_window_view(raw, SPAN)[starts]
    words = np.zeros((len(starts), 7), np.uint64)
    words.view(np.uint8).reshape(len(starts), 56)[:, :SPAN] = bytes_
    a = b = np.zeros(len(starts), np.uint64)
    for k in range(7):
        a, b = mix64(a * np.uint64(31) + words[:, k] + _SEED), mix64((b ^ words[:, k]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k))
    return a, b


class Block:
    """The documents of a block, their different phrases and, of hot triggers, their different strings."""

    def __init__(self, data: bytes, hot: np.ndarray):
        self.table = unzipped(data)
        self.raw, self.bounds = text_bytes(self.table.column("text").combine_chunks() if isinstance(self.table.column("text"), pa.ChunkedArray) else self.table.column("text"))
        ids = self.table.column("doc_id").combine_chunks() if isinstance(self.table.column("doc_id"), pa.ChunkedArray) else self.table.column("doc_id")
        self.ids = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
        p = Phrases(self.raw, self.bounds)
        is_hot = np.isin(p.trigger, hot) if len(hot) else np.zeros(len(p.row), bool)
        cool = np.flatnonzero(~is_hot)
        self.row, self.first, self.stop = p.row[cool], p.first[cool], p.stop[cool]
        trigger, phrase = p.trigger[cool], p.phrase[cool]
        order = np.lexsort((phrase, trigger))
        starts = first_places((trigger[order], phrase[order]))
        #: of each phrase its number among the different ones, which are sorted by trigger and hash
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
        self.trigger, self.phrase = trigger[order][starts], phrase[order][starts]
        own = self.ids[self.row]
        self.least = np.minimum.reduceat(own[order], starts) if len(starts) else own
        # a phrase of each entry whose document is its smallest
        self.sample = np.zeros(len(starts), np.int64)
        chosen = np.flatnonzero(own == self.least[self.entry]) if len(own) else np.zeros(0, np.int64)
        self.sample[self.entry[chosen]] = chosen
        # strings of hot triggers
        hot_at = np.flatnonzero(is_hot)
        n = p.stop[hot_at] - p.first[hot_at]
        self.string_row = np.repeat(p.row[hot_at], n)
        self.string_first = np.repeat(p.first[hot_at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        a, b = string_hashes(self.raw, self.string_first) if n.sum() else [np.zeros(0, np.uint64)] * 2
        order = np.lexsort((b, a))
        starts = first_places((a[order], b[order]))
        self.string_entry = np.empty(len(order), np.int64)
        self.string_entry[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
        self.string_hash = a[order][starts], b[order][starts]
        self.string_least = np.minimum.reduceat(self.ids[self.string_row][order], starts) if len(starts) else a.astype(np.int64)


def packed_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, n_bytes of text and docs (packed rows doc_id, text and carried ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nth, table in enumerate(gathered(batches, block_bytes)):
            n_bytes = text_bytes(table.column("text").combine_chunks())[1][-1] if table.num_rows else 0
            yield pa.RecordBatch.from_arrays([pa.array([block_number(nth)], pa.int64()), pa.array([int(n_bytes)], pa.int64()), pa.array([zipped(table)], pa.binary())], ["block", "n_bytes", "docs"])
        release()

    return docs.mapInArrow(run, "block long, n_bytes long, docs binary")


def hot_triggers(blocks: DataFrame, most: int, least: int = HOT_LEAST) -> np.ndarray:
    """Sorted triggers that would bring more than most phrases to a shard, judged by some blocks; decides the route only, never a result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                trigger, n = np.unique(Block(data, np.zeros(0, np.uint64)).trigger, return_counts=True)
                chosen = n * HOT_BLOCKS > least / 2
                yield pa.RecordBatch.from_arrays([pa.array(trigger[chosen].view(np.int64)), pa.array(n[chosen])], ["trigger", "n"])
        release()

    # the blocks with the smallest numbers are the same ones whenever they are asked for
    some = [r["block"] for r in blocks.select("block").orderBy("block").limit(HOT_BLOCKS).collect()]
    share = blocks.count() / max(1, len(some))
    found = blocks.filter(F.col("block").isin(some)).select("docs").mapInArrow(run, "trigger long, n long")
    hot = found.groupBy("trigger").agg(F.sum("n").alias("n")).filter((F.col("n") > least) & (F.col("n") * share > most))
    return np.sort(np.array([r["trigger"] for r in hot.select("trigger").collect()], np.int64).view(np.uint64))


PHRASES, STRINGS_KIND = 0, 1


def sent_phrases(blocks: DataFrame, hot: np.ndarray, n_shards: int) -> DataFrame:
    """shard, block, kind and packed hashes of the block's different phrases (kind 0) or strings of hot triggers (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Block(data, hot)
                out = []
                for kind, key in ((PHRASES, own.trigger), (STRINGS_KIND, own.string_hash[0])):
                    edges = shard_edges(key, n_shards)
                    for s in np.flatnonzero(np.diff(edges)).tolist():
                        k = slice(int(edges[s]), int(edges[s + 1]))
                        if kind == PHRASES:
                            parts = (planes(own.least[k].astype("<i8")), (own.trigger[k] & _LOW32).astype("<u4").tobytes(), pack48(own.phrase[k]))
                        else:
                            parts = (planes(own.string_least[k].astype("<i8")), own.string_hash[0][k].astype("<u8").tobytes(), own.string_hash[1][k].astype("<u8").tobytes())
                        out.append((s, kind, b"".join(parts)))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.int8()), pa.array([x[2] for x in out], pa.binary())], ["shard", "block", "kind", "sent"])
        release()

    return blocks.select("block", "docs").mapInArrow(run, "shard int, block long, kind byte, sent binary")


def first_answers(sent: DataFrame) -> DataFrame:
    """block, shard, kind, and two bits for each phrase sent: a smaller document has it; its bytes are asked for.  Of strings the first only."""

    def merge(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        rows, answers = [], []
        for kind, width in ((PHRASES, 18), (STRINGS_KIND, 24)):
            at = np.flatnonzero(kinds == kind)
            if not len(at):
                continue
            data = [table.column("sent")[int(k)].as_py() for k in at]
            sizes = np.array([len(x) // width for x in data])
            ids = np.concatenate([from_planes(x, "<i8", n) for x, n in zip(data, sizes.tolist(), strict=True)])
            if kind == PHRASES:
                first = np.concatenate([np.frombuffer(x, "<u4", n, 8 * n) for x, n in zip(data, sizes.tolist(), strict=True)])
                second = np.concatenate([unpack48(x, n, 12 * n) for x, n in zip(data, sizes.tolist(), strict=True)])
            else:
                first, second = (np.concatenate([np.frombuffer(x, "<u8", n, a * n) for x, n in zip(data, sizes.tolist(), strict=True)]) for a in (8, 16))
            del data
            order = np.lexsort((second, first))
            starts = first_places((first[order], second[order]))
            times = np.diff(np.r_[starts, len(order)])
            gone = np.empty(len(order), bool)
            gone[order] = ids[order] > np.repeat(np.minimum.reduceat(ids[order], starts), times)
            asked = np.zeros(len(order), bool)
            if kind == PHRASES:
                of_trigger = first_places((first[order][starts],))
                several = np.repeat(np.diff(np.r_[of_trigger, len(starts)]) > 1, np.diff(np.r_[starts[of_trigger], len(order)]))
                asked[order] = several
                asked &= ~gone
            ends = np.cumsum(sizes)
            for k, a, b in zip(at.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                if gone[a:b].any() or asked[a:b].any():
                    rows.append(k)
                    answers.append(np.packbits(gone[a:b]).tobytes() + (np.packbits(asked[a:b]).tobytes() if kind == PHRASES else b""))
        own = table.select(["block", "shard", "kind"]).take(pa.array(rows, pa.int64()))
        return own.append_column("bits", pa.array(answers, pa.binary()))

    return grouped_arrow(sent, "shard", merge, "block long, shard int, kind byte, bits binary")


def answered(own: Block, got: pa.Table, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the block's phrases: gone, asked; of its strings: gone."""
    gone, asked, strings = np.zeros(len(own.trigger), bool), np.zeros(len(own.trigger), bool), np.zeros(len(own.string_hash[0]), bool)
    edges = {PHRASES: shard_edges(own.trigger, n_shards), STRINGS_KIND: shard_edges(own.string_hash[0], n_shards)}
    for shard, kind, bits in zip(*(got.column(c).to_pylist() for c in ("shard", "kind", "bits")), strict=True):
        a, b = int(edges[kind][shard]), int(edges[kind][shard + 1])
        size = -(-(b - a) // 8)
        flags = np.frombuffer(bits, np.uint8)
        (gone if kind == PHRASES else strings)[a:b] = np.unpackbits(flags[:size], count=b - a)
        if kind == PHRASES:
            asked[a:b] = np.unpackbits(flags[size:], count=b - a)
    return gone, asked, strings


def asked_bytes(blocks: DataFrame, answers: DataFrame, hot: np.ndarray, n_shards: int) -> DataFrame:
    """shard, block and the asked phrases: their smallest doc_ids, triggers, sizes and bytes."""

    def reply(key: tuple, docs: pa.Table, got: pa.Table) -> pa.Table:
        shards, out = [], []
        if got.num_rows and docs.num_rows:
            own = Block(docs.column("docs")[0].as_py(), hot)
            chosen = np.flatnonzero(answered(own, got, n_shards)[1])
            edges = np.searchsorted(chosen, shard_edges(own.trigger, n_shards))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                entries = chosen[int(edges[s]) : int(edges[s + 1])]
                at = own.sample[entries]
                low, size = own.first[at], own.stop[at] - own.first[at] + SPAN - 1
                text = b"".join([own.raw[a : a + n].tobytes() for a, n in zip(low.tolist(), size.tolist(), strict=True)])
                shards.append(s)
                out.append(b"".join((len(entries).to_bytes(8, "little"), planes(own.least[entries].astype("<i8")), (own.trigger[entries] & _LOW32).astype("<u4").tobytes(), size.astype("<u1").tobytes(), text)))
        return pa.table({"shard": pa.array(shards, pa.int32()), "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "asked": pa.array(out, pa.binary())})

    return met_arrow(blocks.select("block", "docs"), answers.filter(F.col("kind") == PHRASES), "block", reply, "shard int, block long, asked binary")


def suffix_order(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of SPAN bytes at the starts, by their bytes, and the rank of each: equal strings have one rank.

    Prefix doubling: the ranks of all places by 8 bytes give those by 16 and these those by 32, of which two that
    overlap cover a string.
    """
    n = len(raw)
    padded = np.r_[raw, np.zeros(64, np.uint8)].astype(np.uint64)
    key = np.zeros(n + 48, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.r_[padded[k : k + n], np.zeros(48, np.uint64)]

    def ranks(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x)
        out = np.empty(len(x), np.uint64)
        out[order] = np.cumsum(np.r_[False, np.diff(x[order]) != 0]).astype(np.uint64)
        return out

    for shift in (8, 16):
        rank = ranks(key)
        key = (rank << np.uint64(32)) | np.r_[rank[shift:], np.zeros(shift, np.uint64)]
    rank = ranks(key)
    last = ranks((rank[starts] << np.uint64(32)) | rank[starts + SPAN - 32])
    return np.argsort(last, kind="stable"), last


def second_answers(asked: DataFrame) -> DataFrame:
    """block, shard and masks of the strings of the asked phrases, in their order, that a smaller document has in another phrase."""

    def merge(table: pa.Table) -> pa.Table:
        parts, sizes = [], []
        for data in table.column("asked").to_pylist():
            n = int.from_bytes(data[:8], "little")
            sizes.append(n)
            parts.append((from_planes(data, "<i8", n, 8), np.frombuffer(data, "<u4", n, 8 + 8 * n), np.frombuffer(data, np.uint8, n, 8 + 12 * n).astype(np.int64), np.frombuffer(data, np.uint8, -1, 8 + 13 * n)))
        ids, trigger, size, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
        place = np.cumsum(size) - size
        mask = np.zeros(len(ids), np.int64)
        order = np.argsort(trigger, kind="stable")
        edges = np.r_[first_places((trigger[order],)), len(order)]
        upto = np.r_[0, np.cumsum(size[order])]
        a = 0
        while a < len(edges) - 1:
            # whole triggers of about SORTED_BYTES
            b = max(a + 1, int(np.searchsorted(upto[edges], upto[edges[a]] + SORTED_BYTES, "right")) - 1)
            own = order[edges[a] : edges[b]]
            text = np.concatenate([raw[x : x + n] for x, n in zip(place[own].tolist(), size[own].tolist(), strict=True)])
            strings = size[own] - SPAN + 1
            owner = np.repeat(own, strings)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
            by, rank = suffix_order(text, np.repeat(np.cumsum(size[own]) - size[own], strings) + nth)
            starts = first_places((rank[by],))
            smallest = np.repeat(np.minimum.reduceat(ids[owner][by], starts), np.diff(np.r_[starts, len(by)]))
            gone = by[ids[owner][by] > smallest]
            np.add.at(mask, owner[gone], np.int64(1) << nth[gone])
            a = b
        ends = np.cumsum(sizes)
        out = [mask[x - n : x].astype("<u4").tobytes() for x, n in zip(ends.tolist(), sizes, strict=True)]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "kind": pa.array([2] * len(out), pa.int8()), "bits": pa.array(out, pa.binary())})

    return grouped_arrow(asked, "shard", merge, "block long, shard int, kind byte, bits binary")


def removed_bytes(own: Block, got: pa.Table, n_shards: int) -> np.ndarray:
    """Of each byte of the block whether it goes."""
    second = got.filter(pa.compute.equal(got.column("kind"), 2))
    gone, asked, strings = answered(own, got.filter(pa.compute.less(got.column("kind"), 2)), n_shards)
    mask = np.zeros(len(own.trigger), np.uint32)
    chosen = np.flatnonzero(asked)
    edges = np.searchsorted(chosen, shard_edges(own.trigger, n_shards))
    for shard, bits in zip(second.column("shard").to_pylist(), second.column("bits").to_pylist(), strict=True):
        mask[chosen[int(edges[shard]) : int(edges[shard + 1])]] = np.frombuffer(bits, "<u4")
    edge = np.zeros(len(own.raw) + 1, np.int32)
    later = own.ids[own.row] > own.least[own.entry] if len(own.row) else np.zeros(0, bool)
    whole = np.flatnonzero(later | gone[own.entry])
    np.add.at(edge, own.first[whole], 1)
    np.add.at(edge, own.stop[whole] + SPAN - 1, -1)
    part = np.flatnonzero(~later & (mask[own.entry] != 0))
    n = own.stop[part] - own.first[part]
    owner = np.repeat(part, n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    starts = (own.first[owner] + nth)[(mask[own.entry[owner]] >> nth.astype(np.uint32)) & 1 == 1]
    hot = own.string_first[strings[own.string_entry] | (own.ids[own.string_row] > own.string_least[own.string_entry])] if len(own.string_row) else starts[:0]
    for x in (starts, hot):
        np.add.at(edge, x, 1)
        np.add.at(edge, x + SPAN, -1)
    np.cumsum(edge, out=edge)
    return edge[:-1] > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def applied(blocks: DataFrame, answers: DataFrame, hot: np.ndarray, n_shards: int, carried: dict[str, str] | None) -> DataFrame:
    """The result of every row; with carried (names and types of the packed columns) the remaining text and these too."""

    def work(key: tuple, docs: pa.Table, got: pa.Table) -> pa.Table:
        own = Block(docs.column("docs")[0].as_py(), hot)
        gone = removed_bytes(own, got, n_shards)
        bounds = own.bounds
        upto = np.zeros(len(gone) + 1, np.int32)
        np.cumsum(gone, out=upto[1:])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = bounds[:-1][np.diff(bounds) > 0]
        begins[inner] = gone[inner]  # runs of different documents are never joined
        runs = np.zeros(len(gone) + 1, np.int32)
        np.cumsum(begins, out=runs[1:])
        kept = own.raw[~gone].tobytes()
        at = (bounds - upto[bounds]).tolist()
        rest = [kept[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        made = {"doc_id": own.table.column("doc_id"), "n_bytes": np.diff(bounds), "n_removed": np.diff(upto[bounds]).astype(np.int64), "n_spans": np.diff(runs[bounds]).astype(np.int64), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in rest]}
        if carried is not None:
            # a run may begin or end within a character: what is left of such a character goes too
            made["text"] = pa.array([x.decode(errors="ignore") for x in rest], pa.string())
            made |= {name: own.table.column(name) for name in carried}
        return pa.table(made)

    more = "" if carried is None else ", text string" + "".join(f", {name} {kind}" for name, kind in carried.items())
    return met_arrow(blocks.select("block", "docs"), answers, "block", work, RESULT + more)


def remove_repeats(docs: DataFrame, carried: list[str] | None = None, block_bytes: int = 1 << 22, hot: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    hot: sorted triggers to send by strings, if not to be looked for; carried: names of columns of docs; if given, the remaining text and these columns are returned too.  What is left of
    a character that a removed run begins or ends in is not in that text.
    """
    own = [F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")]
    texts = docs.select(*own, *(F.col(f"`{c}`").alias(f"carried_{k}") for k, c in enumerate(carried or ())))
    kinds = None if carried is None else {f"carried_{k}": texts.schema[f"carried_{k}"].dataType.simpleString() for k in range(len(carried))}
    blocks = settled(packed_blocks(texts, block_bytes), "span-blocks", blocks=True)
    n_shards = max(8, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // block_bytes))
    # a shard gets a phrase for about sixteen bytes; twice that from one trigger is too much
    hot = hot_triggers(blocks, block_bytes // 8) if hot is None else hot
    first = settled(first_answers(sent_phrases(blocks, hot, n_shards)), "first-answers")
    second = settled(second_answers(asked_bytes(blocks, first, hot, n_shards)), "second-answers")
    result = applied(blocks, first.unionByName(second), hot, n_shards, kinds)
    if carried is None:
        return result
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", *(F.col(f"carried_{k}").alias(c) for k, c in enumerate(carried) if c not in ("doc_id", "text")))
