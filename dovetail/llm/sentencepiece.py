"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all ordinary pieces of a model file.  One pass over a text reports, at each position, all pieces
that end there (the automaton follows its output links); each relaxes the best score at that position.  Characters
that no piece covers cost UNKNOWN less than the lowest score and become byte pieces (or the unknown id).  Ties: the
longer last piece wins.

A boundary between another character and the space sign is always cut when no piece has the sign after another
character, which is checked when the model is loaded; so texts are cut there, and equal words are segmented once for
each task (the store of words has a bounded size).  The model's piece scores decide.  For a model of the BPE kind that is the
best-scoring segmentation, which can differ from that by merge order; decoding gives the text back in either case.

Edge cases.  Null and empty texts have no ids.  Texts of any length decode to themselves (models that normalise are
refused), but for the space sign U+2581 itself, which decodes to a blank as it does in the model's own library.  Repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.llm import store

SPACE = "▁"
UNKNOWN = 10.0
#: Words whose segmentation a task keeps.
KEPT_WORDS = 1 << 19
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Model:
    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], unknown: int, dummy_prefix: bool) -> None:
        """pieces: (text, score) by id, text None for pieces that aren't ordinary."""
        import ahocorasick

        self.unknown, self.byte_ids, self.dummy_prefix = unknown, byte_ids, dummy_prefix
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        self.simple = True
        for i, (text, score) in enumerate(pieces):
            if text:
                self.automaton.add_word(text, (len(text), score, i))
                self.simple &= SPACE not in text.lstrip(SPACE)
        self.automaton.make_automaton()
        self.floor = min((s for t, s in pieces if t), default=0.0) - UNKNOWN
        self.of_byte = {i: b for b, i in byte_ids.items()}
        self.known: dict[str, list[int]] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path; one pass, position by position."""
        n = len(text)
        score, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        score[0] = 0.0
        done = 0

        def settle(upto: int) -> None:
            """Positions without a piece get their character alone."""
            nonlocal done
            while done < upto:
                done += 1
                alone = score[done - 1] + self.floor
                if alone > score[done]:
                    score[done], back[done] = alone, (done - 1, -1)

        for last, (size, value, i) in self.automaton.iter(text):
            settle(last)
            start, end = last + 1 - size, last + 1
            new = score[start] + value
            if new > score[end] or new == score[end] and start < back[end][0]:
                score[end], back[end] = new, (start, i)
        settle(n)
        out: list[int] = []
        at = n
        while at:
            start, i = back[at]
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[start:at].encode())]
            else:
                out.append(self.unknown)
            at = start
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        marked = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        if not self.simple:
            return self.viterbi(marked)
        out: list[int] = []
        known = self.known
        for word in WORDS.findall(marked):
            ids = known.get(word)
            if ids is None:
                ids = self.viterbi(word)
                if len(known) >= KEPT_WORDS:
                    known.clear()
                known[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            b = self.of_byte.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.pieces[i][0] or "")
        out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        if self.dummy_prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


@cache
def load(path: str) -> Model:
    """A model file's pieces, read through the public protocol message (its scores are stored there only)."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    pieces = [(None if p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) else p.id_to_piece(i), p.get_score(i)) for i in range(n)]
    bytes_ = {int(p.id_to_piece(i)[3:-1], 16): i for i in range(n) if p.is_byte(i)}
    prefix = p.normalize("a") == SPACE + "a"
    if p.normalize("a  b ").lstrip(SPACE) != f"a{SPACE}{SPACE}b{SPACE}" or p.normalize("ÀＡ").lstrip(SPACE) != "ÀＡ":
        raise ValueError("this model normalises texts: they would not decode to themselves")
    return Model(pieces, bytes_, p.unk_id(), prefix)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_crc32 and n_bytes (of the decoded text) and, if asked for, ids."""

    def run(batches):
        model = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [model.encode(t.as_py()) for t in part.column(1)]
                raw = [model.decode(x).encode() for x in ids]
                new = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids], pa.int64()), pa.array(map(zlib.crc32, raw), pa.int64()), pa.array(map(len, raw), pa.int64())]
                yield pa.RecordBatch.from_arrays(new + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, ["id", "n_ids", "ids_crc32", "decoded_crc32", "n_bytes"] + ["ids"] * with_ids)

    schema = "id long, n_ids long, ids_crc32 long, decoded_crc32 long, n_bytes long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return encoded(store.table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")
