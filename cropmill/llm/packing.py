"""Packing of token sequences: first-fit decreasing on a tournament tree, in randomised groups of documents.

Documents are dealt out at random; each task takes its documents in random order, in groups of a bounded number of tokens. A group's
documents give full sequences of their own; what is over of each goes, longest first, to the first bin that has room, found in a
tournament tree of bin capacities. Then the emptiest bins' pieces are cut to fill the gaps of the fullest, until one bin at most is
not full; it is cut into sequences whose lengths are powers of two. So no sequence needs padding.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropmill.storage import small_batches

#: The end mark that follows each document's ids.
END_ID = 1


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, by a byte-level BPE file of the ``tokenizers`` library.

    Where the file's ids follow its merge order, most texts are encoded by ``tiktoken`` over the same vocabulary, which gives the same
    ids sooner. Texts with characters of which the libraries' Unicode tables might differ, or with an added token's string, are always
    encoded by ``tokenizers``.
    """

    #: The pre-token pattern of byte-level BPE vocabularies of this family.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    PLAIN = r"[\t\n\r\x20-\x7eÀ-ɏ‐-‧]*+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = re.compile(self.PLAIN).fullmatch
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._fast()

    def _fast(self) -> Callable[[str], list[int]] | None:
        import tiktoken

        model = json.loads(self.tokenizer.to_str())
        vocab, merges, letters = model["model"]["vocab"], model["model"].get("merges", []), byte_letters()
        pairs = [x if isinstance(x, list) else x.split(" ") for x in merges]
        level = {k: v for k, v in (model.get("pre_tokenizer") or {}).items() if k != "trim_offsets"}
        if level != {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or model.get("normalizer") or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items() if k not in self.added}
        return tiktoken.Encoding("corpus", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if self.fast and self.plain(text) and not any(a in text for a in self.added):
            return np.array(self.fast(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, made once in each Python worker."""
    return Encoder(path)


class Tournament:
    """Bins of equal capacity in the leaves; each inner node has the largest room below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Take ``size`` from the first bin with room for it; its number."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        leaf = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return leaf


def pack_group(lengths: list[int], capacity: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Sequences for documents of the given token counts: lists of (document, start, length).

    Every token lies in one piece; each sequence has ``capacity`` tokens, but for the last few, whose sizes are powers of two.
    """
    full, rest = [], []
    for d, n in enumerate(lengths):
        full += [[(d, s, capacity)] for s in range(0, n - n % capacity, capacity)]
        if n % capacity:
            rest.append((n % capacity, d))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = Tournament(max(1, len(rest)), capacity), []
    for n, d in rest:
        at = tree.first_fit(n)
        while len(bins) <= at:
            bins.append([])
        bins[at].append((d, lengths[d] - n, n))
    used = {id(b): sum(p[2] for p in b) for b in bins}
    bins.sort(key=lambda b: -used[id(b)])
    room = [capacity - used[id(b)] for b in bins]
    i, j = 0, len(bins) - 1
    while i < j:
        if not room[i]:
            i += 1
        elif not bins[j]:
            j -= 1
        else:
            d, s, n = bins[j].pop()
            take = min(n, room[i])
            bins[i].append((d, s, take))
            room[i] -= take
            room[j] += take
            if take < n:
                bins[j].append((d, s + take, n - take))
    out = full + [b for b in bins[: j + 1] if b and sum(p[2] for p in b) == capacity]
    for b in [b for b in bins[: j + 1] if b and sum(p[2] for p in b) != capacity]:
        left, pieces = sum(p[2] for p in b), list(b)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part = []
            while size:
                d, s, n = pieces.pop(0)
                take = min(n, size)
                part.append((d, s, take))
                size -= take
                if take < n:
                    pieces.insert(0, (d, s + take, n - take))
            out.append(part)
    return out


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, group_tokens: int = 4_000_000, seed: int = 17) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``sequence_length``.

    A document's ids are its text's (null: none), then id 1. ``capacity`` is a power of two; a sequence has ``capacity`` ids or a
    smaller power of two. ``group_tokens`` bounds a group (one longer document is a group by itself). Null and repeated document
    ids are packed like any other row; an empty table gives an empty table; columns other than the named ones are ignored.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")])
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"), F.rand(seed).alias("at")).repartition("at").sortWithinPartitions("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ids, bodies, tokens = encoder(tokenizer).encode, [], [], 0
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            cols: list[list] = [[] for _ in range(8)]
            for seq in pack_group([len(b) // 4 for b in bodies], capacity):
                offset, total = 0, sum(p[2] for p in seq)
                for d, s, n in seq:
                    row = (ids[d], s, n, zlib.crc32(memoryview(bodies[d])[4 * s : 4 * (s + n)]), len(bodies[d]) // 4, base + count, offset, total)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    offset += n
                count += 1
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], kind)] + [pa.array(c, pa.int64()) for c in cols[1:]], names=schema.names)

        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            kind = batch.column(0).type
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(key)
                bodies.append(encode(body or "") + end)
                tokens += len(bodies[-1]) // 4
                if tokens >= group_tokens:
                    yield from flush()
                    ids, bodies, tokens = [], [], 0
        yield from flush()

    return dealt.select("id", "body").mapInArrow(run, schema)
