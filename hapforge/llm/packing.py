"""Best-fit packing in bulk-synchronous rounds.

Documents are tokenised, ended by one id and cut into pieces of at most the sequence length. The
pieces are range-sorted by length once and written down; a piece's rank among those of its length is
its place in that order. As lengths are whole numbers up to the sequence length, the sorted pieces
and the sorted gaps of open sequences fall into runs of equal size, whose members are told apart by
rank alone. A round sweeps the runs of waiting pieces from long to short; each takes the successor
of its length among the gaps no one has taken in this round, with as many pieces as that gap holds.
Where several runs want one gap the run that ranks first in the sweep wins, its lowest ranks first,
and the rest wait. Pieces that no gap could hold, taken or not, open sequences. Then the gaps are
updated and the next round starts. A round handles runs, never rows, so what the sweeps hold is
bounded by the sequence length; the rows find their sequence and offset from the rank intervals of
their length in one distributed pass.

Tokenising keeps the ids of each run of letters or signs that the tokenizer's pattern finds, so a
worker asks its model once a run and not once an occurrence; the ids are the tokenizer's own.

Defined results: a null text is empty, and an empty text is the end id alone. Rows that repeat an
identifier are packed each on its own. An empty table gives an empty result. Only the identifier and
text columns are read, so names of other columns can't clash.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hapforge.shared import materialize, temporary

SEQUENCE = 4096
END_ID = 1
#: Runs of letters or signs whose ids a worker keeps; then it starts anew.
MEMO_RUNS = 200_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the rest follow from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Lower-case run of letters, one digit or a run of other signs -> its ids as little-endian 32-bit bytes.

    Texts of ASCII and Latin-1 letters are cut by the tokenizer's own pattern, and each run goes to its
    model once; other texts go word by word through the whole tokenizer, and texts that may hold a
    special token's string go there as one.
    """

    #: The tokenizer's pattern over ASCII and the letters of Latin-1.
    RUNS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^a-z0-9\xdf-\xf6\xf8-\xff\\s]+")
    PLAIN = re.compile("[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()

    def __missing__(self, run: str) -> bytes:
        if len(self) >= MEMO_RUNS:
            self.clear()
        tokens = self.model.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet))
        self[run] = out = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return out

    def encode(self, text: str) -> bytes:
        if "oftext|>" in text.lower():  # may hold a special token, which only the whole tokenizer knows
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, self.RUNS.findall(text.lower())))
        # Only ASCII white space cuts words here: the normaliser and the pattern never look across it.
        words = [w.decode() for w in text.encode().split()]
        return b"".join([self.encode(w) if self.PLAIN.fullmatch(w) else np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words])


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut(text: str, ids: WordIds, sequence: int, end_id: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a text."""
    data = ids.encode(text) + end_id.to_bytes(4, "little")
    step = 4 * sequence
    return [(i, at // 4, len(part) // 4, zlib.crc32(part)) for i, at in enumerate(range(0, len(data), step)) if (part := data[at : at + step])]


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    path = path or tokenizer_path()

    def run(batches):
        ids = word_ids(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows, at = [], []
            for i in range(batch.num_rows):
                for piece in cut(texts[i].as_py(), ids, sequence, end_id):
                    rows.append(piece)
                    at.append(i)
            cols = np.array(rows, np.int64).reshape(-1, 4).T
            doc_ids = keys.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(cols[0].astype(np.int32)), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3])], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES)


class Gaps:
    """Open sequences as runs: for each gap size, stretches [first sequence, how many)."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[list[int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in self.runs:
                insort(self.sizes, gap)
                self.runs[gap] = []
            self.runs[gap].append([first, count])

    def successor(self, length: int) -> int | None:
        i = bisect_left(self.sizes, length)
        return self.sizes[i] if i < len(self.sizes) else None

    def take(self, gap: int, most: int) -> tuple[int, int]:
        """Up to ``most`` sequences with this gap: (first, how many)."""
        runs = self.runs[gap]
        first, count = runs[-1]
        n = min(count, most)
        if n == count:
            runs.pop()
            if not runs:
                del self.runs[gap]
                self.sizes.remove(gap)
        else:
            runs[-1] = [first + n, count - n]
        return first, n


def sweep_rounds(counts: dict[int, int], sequence: int = SEQUENCE) -> np.ndarray:
    """Rounds over runs; returns rows (length, first rank, pieces, first sequence, pieces a sequence, offset) of matched ranks."""
    waiting = {n: [0, c] for n, c in counts.items() if c > 0}
    gaps, matched, opened = Gaps(), [], 0

    def place(length: int, first: int, n_seq: int, gap: int, after: Gaps) -> None:
        """Put up to n_seq * per waiting pieces of this length into sequences [first, first + n_seq) that have this gap."""
        rank, count = waiting[length]
        per = gap // length
        n = min(count, n_seq * per)
        matched.append((length, rank, n, first, per, sequence - gap))
        full, over = divmod(n, per)
        after.add(gap - per * length, first, full)
        after.add(gap - over * length, first + full, int(over > 0))
        after.add(gap, first + full + (over > 0), n_seq - full - (over > 0))
        waiting[length] = [rank + n, count - n]

    while waiting:
        after = Gaps()
        for length in sorted(waiting, reverse=True):
            while waiting[length][1] and (gap := gaps.successor(length)) is not None:
                first, n = gaps.take(gap, -(-waiting[length][1] // (gap // length)))
                place(length, first, n, gap, after)
            if waiting[length][1] and after.successor(length) is None:
                n = -(-waiting[length][1] // (sequence // length))
                place(length, opened, n, sequence, after)
                opened += n
        for gap, runs in gaps.runs.items():
            for first, n in runs:
                after.add(gap, first, n)
        gaps = after
        waiting = {k: v for k, v in waiting.items() if v[1]}
    return np.array(matched, np.int64).reshape(-1, 6)


def ranked(pieces: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """The pieces range-sorted and written, each with its partition and place there; and (partition, length, first place, count) runs.

    The runs are at most one a length and partition and one more a partition, for ranges don't overlap.
    """
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.repartitionByRange(n, "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    at = F.monotonically_increasing_id()
    written = materialize(ordered.select("*", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")), "pieces")
    runs = written.groupBy("part", "length").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("length", "part").collect()
    return written, [tuple(r) for r in runs]


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = pieces.sparkSession
    with temporary(spark) as scratch:
        written, runs = ranked(materialize(pieces, "cut"))  # the range sort reads its input twice
        scratch.keep(written)
    counts: dict[int, int] = {}
    shift: dict[tuple[int, int], int] = {}
    for part, length, first, n in runs:
        shift[part, length] = counts.get(length, 0) - first
        counts[length] = counts.get(length, 0) + n
    plan = sweep_rounds(counts, sequence)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = np.array([p * (sequence + 1) + n for p, n in shift], np.int64)
    moves = np.array(list(shift.values()), np.int64)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((plan, keys[order], moves[order]))

    def run(batches):
        plan, keys, moves = sent.value
        starts = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            length, part, at = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "part", "at"))
            rank = at + moves[np.searchsorted(keys, part * (sequence + 1) + length)] if len(at) else at
            m = plan[np.searchsorted(starts, length << 44 | rank, "right") - 1] if len(at) else np.zeros((0, 6), np.int64)
            nth = rank - m[:, 1]
            out = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(m[:, 3] + nth // np.maximum(m[:, 4], 1)), pa.array(m[:, 5] + nth % np.maximum(m[:, 4], 1) * length)], [*out.schema.names, "sequence_id", "offset"])

    return written.mapInArrow(run, f"{PIECES}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    return pack(pieces_of(docs, id_col, text_col, path, sequence, end_id), sequence)
