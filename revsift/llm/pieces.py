"""Operator 9: SentencePiece encoding and decoding with a distinct-chunk table.

When no piece of the model crosses a whitespace marker, a text splits into
marked words (a run of markers and the word after it) whose segmentations do
not depend on each other. Every task keeps a table of the distinct marked
words it has met: each is segmented once, and a document's ids are the
table's ids joined by position. The table is bounded and kept for as long as
the Python worker lives, so it serves later batches and tasks as well.

The segmentation is byte-pair merging by piece score (leftmost first among
equals) with byte fallback, as the sentencepiece library does for BPE models;
the tests compare ids and decoded texts with that library.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import id_text, map_batches

MARK = "▁"
# Words longer than this are segmented through a heap and not kept in the table.
LONG_WORD = 64
# Most entries of one worker's table (about 250 bytes each).
TABLE_ENTRIES = 300_000

_TABLES: dict[str, "PieceTable"] = {}


class PieceTable(dict):
    """Marked word -> (comma-joined ids, number of ids, decoded text)."""

    def __init__(self, model_path: str):
        super().__init__()
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if (train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap
                or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or train.treat_whitespace_as_suffix):
            raise ValueError("only BPE models with byte fallback and no normalisation are read")
        self.dummy = MARK if norm.add_dummy_prefix else ""
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.texts: list[str] = []
        self.bytes_of: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            self.texts.append(p.piece if p.type == 1 else "")
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.bytes_of[i] = int(p.piece[3:5], 16)
            elif p.type == 1:
                self.ids[p.piece] = i
                self.scores[p.piece] = p.score
            elif p.type in (4, 5):
                raise ValueError("models with user-defined or unused pieces are not read")
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.ids):
            raise ValueError("a piece crosses a whitespace marker or a line end")
        # a line end is in no piece, so it is a word of its own
        self.words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall

    def merge_short(self, word: str) -> list[str]:
        syms, scores = list(word), self.scores
        while len(syms) > 1:
            best, at = None, -1
            for i in range(len(syms) - 1):
                s = scores.get(syms[i] + syms[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            syms[at:at + 2] = [syms[at] + syms[at + 1]]
        return syms

    def merge_long(self, word: str) -> list[str]:
        """The same merges for a word of any length: a heap of pairs over a
        linked list of symbols, n log n."""
        syms: list[str | None] = list(word)
        n = len(syms)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                pair = syms[i] + syms[j]
                if (s := self.scores.get(pair)) is not None:
                    heapq.heappush(heap, (-s, i, pair))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, pair = heapq.heappop(heap)
            if syms[i] is None or (j := after[i]) >= n or syms[i] + syms[j] != pair:
                continue
            syms[i], syms[j] = pair, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in syms if s is not None]

    def segment(self, word: str) -> list[int]:
        out = []
        for s in (self.merge_short if len(word) <= LONG_WORD else self.merge_long)(word):
            i = self.ids.get(s)
            if i is None:
                out.extend(self.byte_ids[b] for b in s.encode("utf-8"))
            else:
                out.append(i)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of a run of ids, markers as spaces; neighbouring byte ids are
        read together as UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            if (b := self.bytes_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.texts[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def __missing__(self, word: str):
        ids = self.segment(word)
        entry = (",".join(map(str, ids)), len(ids), self.decode(ids))
        if len(word) <= LONG_WORD:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[word] = entry
        return entry

    def encode(self, text: str) -> tuple[str, int, str]:
        """(comma-joined ids, number of ids, decoded text) of a whole text."""
        if not text:
            return "", 0, ""
        rows = [self[w] for w in self.words(self.dummy + text.replace(" ", MARK))]
        decoded = "".join([r[2] for r in rows])
        if self.dummy and decoded.startswith(" "):
            decoded = decoded[1:]
        return ",".join([r[0] for r in rows]), sum([r[1] for r in rows]), decoded


def piece_table(model_path: str) -> PieceTable:
    if model_path not in _TABLES:
        _TABLES[model_path] = PieceTable(model_path)
    return _TABLES[model_path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_texts: bool = True) -> DataFrame:
    """Encode and decode every whole text: ``doc_id``, ``n_tokens``,
    ``ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256``
    and, with ``with_texts``, ``ids`` (comma-joined) and ``decoded``.

    A null or empty text has no ids and decodes to the empty text. Repeated
    rows give repeated results; other columns are not read. ``model_path``
    must exist on every worker. One pass, no shuffle.
    """
    fields = [StructField("doc_id", docs.schema[id_col].dataType), StructField("n_tokens", LongType()),
              StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    if with_texts:
        fields += [StructField("ids", StringType()), StructField("decoded", StringType())]

    def run(batches):
        table = piece_table(model_path)
        for batch in batches:
            ids, n, sha, dsha, dec = [], [], [], [], []
            for text in batch.column("text"):
                i, k, d = table.encode(text.as_py())
                n.append(k)
                sha.append(hashlib.sha256(i.encode()).hexdigest())
                dsha.append(hashlib.sha256(d.encode()).hexdigest())
                if with_texts:
                    ids.append(i)
                    dec.append(d)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(dsha, pa.string())]
            if with_texts:
                cols += [pa.array(ids, pa.string()), pa.array(dec, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return map_batches(id_text(docs, id_col, text_col), run, StructType(fields))
