"""Hierarchical multi-length packing of token sequences.

A document is its token ids and one end id.  Its length routes it to the shortest context tier that holds it; what
is longer gives full windows of the longest tier and a tail.  From the longest tier down, each window takes one
document of its tier, then the largest pieces of shorter tiers that fit its gap, then the head of a piece that is
cut to fill the gap exactly.  A window of a tier is full, and tiers are powers of two, so padding arises only in the
last window of a task.  Windows of a tier are dealt to step groups of equal token counts, in snake order of their
attention cost, so groups of a tier cost about the same.

Tasks pack their own documents in bounded blocks: no shuffle, and a lost task is packed again.  Sequence ids hold the
task's number, so they are unique.  Edge cases: a null or empty text is one end id; a document of any length is
handled; repeated rows are packed as often as they stand; an empty table gives no rows; a null id stays null.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.llm import store
from dovetail.llm.blobs import tidy

TIERS = (64, 128, 256, 512, 1024)
END_ID = 0
#: Tokens of a block that are packed together, and of a step group.
BLOCK_TOKENS, STEP_TOKENS = 1 << 20, 8192


@cache
def encoder(ranks_path: str, pattern: str):
    """A byte-level BPE from a file of base64 tokens and ranks; text that looks like a special token is ordinary text."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def fallback(json_path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(json_path)
    found.encode_special_tokens = True
    return found


def encode(text: str | None) -> np.ndarray:
    """Ids of byte_bpe_50k.json (its vocabulary as ranks is read by the faster of two libraries) and the end id."""
    import public_tokenizers

    if not text:
        return np.array([END_ID], np.uint32)
    try:
        ids = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_to_numpy(text, disallowed_special=())
    except (ValueError, RuntimeError):  # the pattern engine gives up on some very long runs
        ids = np.array(fallback(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.append(ids.astype(np.uint32), np.uint32(END_ID))


class Packer:
    """Packs documents of one task; pieces are (length, document, start)."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = tuple(sorted(tiers))
        self.pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}
        self.lengths: dict[int, int] = {}
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []
        self.waiting = 0

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if t >= length)

    def put(self, piece: tuple[int, int, int]) -> None:
        insort(self.pools[self.tier(piece[0])], piece)
        self.waiting += piece[0]

    def add(self, doc: int, length: int) -> None:
        longest, start = self.tiers[-1], 0
        self.lengths[doc] = length
        while length - start >= longest:
            self.windows.append((longest, [(longest, doc, start)]))
            start += longest
        if start < length:
            self.put((length - start, doc, start))

    def fitting(self, gap: int) -> tuple[int, int, int] | None:
        """Takes the largest piece of at most `gap` tokens."""
        for t in reversed(self.tiers):
            pool = self.pools[t]
            if pool and pool[0][0] <= gap:
                found = pool.pop(bisect_right(pool, (gap, 1 << 62, 0)) - 1)
                self.waiting -= found[0]
                return found
        return None

    def head(self, gap: int) -> tuple[int, int, int] | None:
        """Cuts `gap` tokens off the shortest piece there is (all are longer than the gap)."""
        for t in self.tiers:
            if self.pools[t]:
                length, doc, start = self.pools[t].pop(0)
                self.waiting -= length
                self.put((length - gap, doc, start + gap))
                return gap, doc, start
        return None

    def pack(self) -> None:
        """Fills windows until what waits can't fill one more."""
        for t in reversed(self.tiers):
            while self.pools[t] and self.waiting >= t:
                piece = self.pools[t].pop()
                self.waiting -= piece[0]
                window, gap = [piece], t - piece[0]
                while gap:
                    piece = self.fitting(gap) or self.head(gap)
                    window.append(piece)
                    gap -= piece[0]
                self.windows.append((t, window))

    def rest(self) -> None:
        """Empties the pools at the end: full windows of the tiers, then one that is padded."""
        self.pack()
        for t in reversed(self.tiers):
            while self.waiting >= t:
                window, gap = [], t
                while gap:
                    piece = self.fitting(gap) or self.head(gap)
                    window.append(piece)
                    gap -= piece[0]
                self.windows.append((t, window))
        if self.waiting:
            self.windows.append((self.tiers[-1], [p for t in self.tiers for p in self.pools[t]]))
            self.pools = {t: [] for t in self.tiers}
            self.waiting = 0


def step_groups(windows: list[tuple[int, list[tuple[int, int, int]]]], tier: int, step_tokens: int) -> dict[int, int]:
    """Window number to step group of its tier: as many windows in each, dealt in snake order of sum(length**2)."""
    mine = sorted((i for i, w in enumerate(windows) if w[0] == tier), key=lambda i: -sum(p[0] ** 2 for p in windows[i][1]))
    n = max(1, -(-len(mine) // max(1, step_tokens // tier)))
    return {i: (k % n if k // n % 2 == 0 else n - 1 - k % n) for k, i in enumerate(mine)}


def _packing(tiers: tuple[int, ...], step_tokens: int, with_ids: bool):
    def run(batches):
        task = TaskContext.get().partitionId()
        packer, tokens, names = Packer(tiers), {}, {}
        sequence, groups, doc, since = task << 40, 0, 0, 0

        def emit():
            nonlocal sequence, groups, tokens
            rows: dict[str, list] = {k: [] for k in ("id", "start", "length", "crc", "total", "sequence", "offset", "tier", "group", *(["ids"] * with_ids))}
            for t in packer.tiers:
                dealt = step_groups(packer.windows, t, step_tokens)
                for i, g in dealt.items():
                    offset = 0
                    for length, d, start in packer.windows[i][1]:
                        ids = tokens[d][start : start + length]
                        for k, v in zip(rows, (names[d], start, length, zlib.crc32(ids.tobytes()), packer.lengths[d], sequence, offset, t, (task << 40) + groups + g, ids), strict=False):
                            rows[k].append(v)
                        offset += length
                    sequence += 1
                groups += len(set(dealt.values()))
            packer.windows = []
            left = {p[1] for pool in packer.pools.values() for p in pool}
            tokens = {d: tokens[d] for d in left}
            for d in [d for d in names if d not in left]:
                del names[d], packer.lengths[d]
            kinds = {"crc": pa.int64(), "tier": pa.int32(), "ids": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()], list(rows))

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                tokens[doc], names[doc] = encode(text.as_py()), name.as_py()
                packer.add(doc, len(tokens[doc]))
                since += len(tokens[doc])
                doc += 1
                if since >= BLOCK_TOKENS:
                    packer.pack()
                    since = 0
                    yield emit()
        packer.rest()
        yield emit()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, crc (of its ids), total, sequence, offset, tier, group[, ids]."""
    schema = "id long, start long, length long, crc long, total long, sequence long, offset long, tier int, group long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(_packing(tiers, step_tokens, with_ids)), schema)


def digest(packed: DataFrame) -> DataFrame:
    names = {"id": "doc_id", "crc": "ids_crc32", "total": "doc_tokens", "sequence": "sequence_id", "group": "step_group"}
    return packed.select(*[F.col(c).alias(names.get(c, c)) for c in ("id", "start", "length", "crc", "total", "sequence", "offset", "tier", "group")])


def op1_hierarchical_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(store.table(spark, sf_dir, "documents")))
