"""Best-fit packing of tokenized documents: dominance reduction on the counts of lengths, then best fit."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from tokenizers import Tokenizer

from .util import cut, held, map_batches, slices

CAPACITY = 1024
END_ID = 2
#: Parts that a worker remembers; those before them serve once more until so many others have come.
REMEMBERED = 400_000
CLOSE = re.compile(r"\A\s|\s(?:\s|\Z)")
#: Signs before parts, and their bytes in the tokenizer's names of tokens.
SIGNS = {" ": "Ġ", "\n": "Ċ"}


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes. The pre-tokenizer splits before every lone blank and
    around every lone newline, so the ids of a text are those of its parts between these, each with the sign before
    it; parts are encoded once and kept. Texts in which white space meets white space are encoded whole.

    A part's key in the memory is itself after a blank, has its newline after a newline, and a blank at the start."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memory: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.begins = {sign: np.array([n.startswith(name) for n in names]) for sign, name in SIGNS.items()}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def after(self, sign: str, parts: list[str]) -> list[bytes]:
        """Ids of each part with the sign before it, from texts of many such parts: a token that begins with the sign
        begins a part."""
        out = []
        groups = [parts[at : at + 128] for at in range(0, len(parts), 128)]
        for group, raw in zip(groups, self.whole([sign + sign.join(g) for g in groups]), strict=True):
            at = (4 * np.nonzero(self.begins[sign][np.frombuffer(raw, "<u4")])[0]).tolist()
            if len(at) == len(group):
                out += [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)]
            else:
                out += self.whole([sign + p for p in group])
        return out

    @staticmethod
    def parts(text: str) -> list[str] | None:
        """Keys of a text's parts; None if some white space has white space, a start or an end beside it."""
        return None if CLOSE.search(text) else text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 256):
            group = [(t, self.parts(t)) for t in texts[at : at + 256]]
            for _, parts in group:
                if parts:
                    parts[0] = f" {parts[0]}"
            if len(self.memory) > REMEMBERED:
                self.earlier, self.memory = self.memory, {}
            memory, earlier = self.memory, self.earlier
            new = set().union(*[parts for _, parts in group if parts]).difference(memory)
            moved = {k: earlier[k] for k in new if k in earlier}
            memory.update(moved)
            blank, line, start = [], [], []
            for k in new.difference(moved):
                (start if k[:1] == " " else line if k[:1] == "\n" else blank).append(k)
            memory.update(zip(blank, self.after(" ", blank), strict=True))
            memory.update(zip(line, self.after("\n", [k[1:] for k in line]), strict=True))
            memory.update(zip(start, self.whole([k[1:] for k in start]), strict=True))
            for text, parts in group:
                yield self.whole([text])[0] if parts is None else b"".join(map(memory.__getitem__, parts))


def worker_encoder(path: str) -> Encoder:
    """A worker's encoder: what it remembers serves all tasks of this operator that the worker runs."""
    return held(__name__, (path,), lambda: Encoder(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its place: the task and its number among the
    task's pieces of that length. Only documents over the capacity are cut; the first piece takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]):
        encoder, task, seen = worker_encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for b in slices(batches, 1024):
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "number")}
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                start, length, piece = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    number = int(seen[length])
                    seen[length] += 1
                    for k, v in zip(rows, (doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, number), strict=True):
                        rows[k].append(v)
                    start, length, piece = start + length, capacity, piece + 1
            yield rows

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(base, run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long")


Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...), number of such sequences


def reduce(count: list[int], capacity: int) -> list[Pattern]:
    """Martello-Toth dominance on counts by length (count is changed in place): sequences that some best packing
    has, fixed for good. A longest item and an item that fills its sequence exactly dominate every other set with
    it; so does the longest item that fits beside it, if no two others fit there or no two sum to more."""
    fixed: list[Pattern] = []

    def take(items: tuple[tuple[int, int], ...], n: int) -> None:
        if n > 0:
            fixed.append((items, n))
            for length, k in items:
                count[length] -= k * n

    take(((capacity, 1),), count[capacity])
    for a in range(capacity - 1, (capacity - 1) // 2, -1):
        b = capacity - a
        if a > b > 0:
            take(((a, 1), (b, 1)), min(count[a], count[b]))
        elif a == b:
            take(((a, 2),), count[a] // 2)
    changed = True
    while changed:
        changed = False
        for a in range(capacity, 0, -1):
            while count[a]:
                there = [x for x in range(1, capacity + 1) if count[x] - (x == a) > 0]
                room = capacity - a
                fits = [x for x in there if x <= room]
                if not fits:
                    take(((a, 1),), count[a])
                    changed = True
                    break
                smallest = [x for x in fits[:3] for _ in range(min(3, count[x] - (x == a)))]
                best = fits[-1]
                single = len(smallest) < 2 or smallest[0] + smallest[1] > room
                if not single and (len(smallest) < 3 or sum(smallest[:3]) > room):
                    # two may stand beside it, but no three: the longest dominates if no two sum to more than it has
                    single = best >= two_sum(fits, count, a, room)
                if not single:
                    break
                if best == a:
                    take(((a, 2),), count[a] // 2)
                else:
                    # in bulk only while the argument holds for each of them: neither length may run out first
                    take(((a, 1), (best, 1)), min(count[a], count[best]))
                changed = True
    return fixed


def two_sum(fits: list[int], count: list[int], a: int, room: int) -> int:
    """The largest sum up to room of two of the items that are there beside one of length a."""
    best, i, j = 0, 0, len(fits) - 1
    while i <= j:
        s = fits[i] + fits[j]
        if s > room or (i == j and count[fits[i]] - (fits[i] == a) < 2):
            j -= 1
        else:
            best = max(best, s)
            i += 1
    return best


def best_fit(count: list[int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, for all items of a length at once: open sequences alike are one entry."""
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # sorted
    for length in range(capacity, 0, -1):
        n = count[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                items, many = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, items, many = capacity, (), n
            each = min(room // length, n)
            used = min(many, n // each)
            if used < many and items:
                put(open_, rooms, room, (items, many - used))
            put(open_, rooms, room - each * length, ((*items, (length, each)), used))
            n -= used * each
    return [p for group in open_.values() for p in group]


def put(open_: dict[int, list[Pattern]], rooms: list[int], room: int, pattern: Pattern) -> None:
    if room not in open_:
        open_[room] = []
        insort(rooms, room)
    open_[room].append(pattern)


def plan(count: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, how many of the length in each sequence, offset of the first),
    by length and rank. Its size depends on how many lengths there are, not on how many documents."""
    left = list(count)
    patterns = [*reduce(left, capacity), *best_fit(left, capacity)]
    rows, rank, sequence = [], [0] * (capacity + 1), 0
    for items, many in patterns:
        offset = 0
        for length, each in items:
            rows.append((length, rank[length], sequence, each, offset))
            rank[length] += many * each
            offset += length * each
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Null and empty texts are one piece that holds only the end id. Texts of any length are encoded whole. Repeated
    rows are packed each; a null doc_id stays null; no rows give no rows; other columns are ignored, whatever their
    names. Only the counts of the lengths (at most `capacity` numbers) reach the driver: pieces of a length are
    interchangeable, so the packing is planned on counts, and each piece finds its sequence by its rank among those
    of its length. Ranks come from counts by task and length; no group is gathered anywhere."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    made, _ = cut(pieces(docs, path, capacity, end_id), "pieces")
    by_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    count = [0] * (capacity + 1)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        count[r.length] = r.n
    table = spark.sparkContext.broadcast(plan(count, capacity))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).select("task", "length", "before")
    ranked = made.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]):
        t = table.value
        key = (t[:, 0] << 48) + t[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = t[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
            at = rank - row[:, 1]
            yield {c: b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {
                "sequence_id": row[:, 2] + at // row[:, 3], "offset": row[:, 4] + at % row[:, 3] * length
            }

    return map_batches(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
