"""SentencePiece BPE with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import held, map_batches, slices

SPACE = "▁"
#: Chance that a candidate merge is skipped.
DROPOUT = 0.1
#: States of parts' agendas, and chunks, that a worker remembers before it starts anew.
REMEMBERED = 400_000
#: What a part's place in its text, and the place and the rank of a candidate merge, add to the key of its hash.
PART, PLACE, RANK = 0x85EBCA6B, 0x9E3779B1, 0xC2B2AE35
#: Parts of at most this many characters keep their agenda in a list, and its states are remembered; longer ones use a heap.
SHORT = 48
#: Chunks that are drawn for at a time, and documents of a batch that are encoded at a time.
BLOCK, SLICE = 1 << 16, 256
NONE = 1 << 40
#: The same in arrays of 32 bits.
FAR = (1 << 31) - 1
#: Parts of up to so many characters are merged at once.
WIDTHS = (5, 7, 9, 12, 16, 24, SHORT)

WORDS = re.compile(r" *\w+|.", re.S)
CHUNK = re.compile(" *[^ ]+| +")
MASK = 0xFFFFFFFF
PLACES = [i * PLACE & MASK for i in range(SHORT)]


def hashed(key: int, place: int, rank: int) -> int:
    """32 bits of a candidate merge: the last multiplication carries every bit of the key into the upper bits."""
    x = key ^ (place * PLACE & MASK) ^ (rank * RANK & MASK)
    x = (x ^ x >> 16) * 0x7FEB352D & MASK
    return (x ^ x >> 15) * 0x846CA68B & MASK


class Codec:
    """The vocabulary of a BPE model. A piece has blanks only at its start (or nothing else), so a text is cut
    before its words without changing its pieces."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = 0) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.rank: dict[str, int] = {}
        self.piece: dict[str, int] = {}
        self.out: list[bytes] = [b""] * n
        self.byte = [0] * 256
        for i in range(n):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.out[i] = bytes((int(p[3:5], 16),))
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.piece[p] = i
                self.rank[p] = round(-model.get_score(i))
                self.out[i] = p.replace(SPACE, " ").encode()
        if any(SPACE in p.lstrip(SPACE) for p in self.piece):
            raise ValueError("this vocabulary has pieces that span words; texts can't be cut before words")
        self.beside = {p[k : k + 2] for p in self.piece for k in range(len(p) - 1)}
        self.below = int(dropout * (MASK + 1))
        self.seed = seed
        self.rank = {p: r for p, r in self.rank.items() if len(p) > 1}
        self.keys = {r: r * RANK & MASK for r in self.rank.values()}
        self.four = {p: i.to_bytes(4, "little") for p, i in self.piece.items()}
        self.arrays()
        self.forget()

    def arrays(self) -> None:
        """For merges of many parts at once: the id of each character that is a piece, and of each pair of pieces that
        make one, by their ids, the id and rank of what they make."""
        n = len(self.out)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.piece.items():
            if len(p) == 1:
                self.of_char[ord(" " if p == SPACE else p)] = i  # the sign itself is no blank
        found = sorted((self.piece[p[:k]] * n + self.piece[p[k:]], self.piece[p], r) for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in self.piece and p[k:] in self.piece)
        self.pairs = np.array([f[0] for f in found] + [1 << 62], np.int64)
        self.made = np.array([f[1] for f in found] + [-1], np.int32)
        self.ranks = np.array([f[2] for f in found] + [FAR], np.int32)

    def skipped(self, key: int, place: int, rank: int) -> bool:
        return hashed(key, place, rank) < self.below

    def forget(self) -> None:
        self.chunks: dict[str, tuple[int, ...]] = {}  # the first states of a chunk's parts
        self.children: dict[int, int] = {}  # state after a state's k-th candidate is skipped
        self.states: list[tuple[str, tuple[int, ...], int]] = [("", (), 0)]  # part, ordinals of skipped candidates, those before
        self.result: list[bytes] = [b""]  # ids if nothing more is skipped
        self.start, self.count, self.candidates = array("q", [0]), array("q", [0]), array("I", [0])
        self.seen: set[int] = set()  # of parts, and of states with a skipped candidate, that came up once: the hashes

    def again(self, what: object) -> bool:
        """Whether it came up before: what comes up once is not worth remembering."""
        h, n = hash(what), len(self.seen)
        if n > 2 * REMEMBERED:
            self.seen.clear()
        self.seen.add(h)
        return len(self.seen) == n

    def symbols(self, part: str) -> list[str]:
        out = list(part.replace(" ", SPACE))
        if SPACE in part:  # the sign itself is no blank: it keeps its own bytes
            out = ["\0" + SPACE if c == SPACE else s for c, s in zip(part, out, strict=True)]
        return out

    def ids(self, symbols: list[str]) -> bytes:
        try:
            return b"".join(map(self.four.__getitem__, symbols))
        except KeyError:
            pass
        ids = []
        for s in symbols:
            known = self.piece.get(s)
            if known is None:
                ids += [self.byte[b] for b in s.removeprefix("\0" if len(s) > 1 else "").encode("utf-8", "surrogatepass")]
            else:
                ids.append(known)
        return array("I", ids).tobytes()

    def state(self, part: str, skips: tuple[int, ...], before: int) -> int:
        """A new state of a part's agenda: of all candidates that came up, by ordinal, some were skipped, the last of
        them right before the `before`-th. What comes up from there if nothing more is skipped is remembered."""
        symbols, rank = self.symbols(part), self.rank.get
        places = PLACES[: len(symbols)]
        agenda = [rank(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        ordinal, start = 0, len(self.candidates)
        while agenda:
            r = min(agenda)  # the leftmost of equals comes up first
            if r == NONE:
                break
            i = agenda.index(r)
            if ordinal >= before:
                self.candidates.append(places[i] ^ (r * RANK & MASK))
            ordinal += 1
            if ordinal - 1 in skips:
                agenda[i] = NONE
                continue
            p = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], places[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + p, NONE)
            if i < len(agenda):
                agenda[i] = rank(p + symbols[i + 1], NONE)
        self.start.append(start)
        self.count.append(len(self.candidates) - start)
        self.states.append((part, skips, before))
        self.result.append(self.ids(symbols))
        return len(self.states) - 1

    def drawn(self, states: np.ndarray, keys: np.ndarray, alone: dict[int, str]) -> np.ndarray:
        """The last state of parts with these keys: candidates are drawn for all parts at once, and a part whose
        draw skips one goes on in the state that follows, until nothing more is skipped. Parts that come to a state for
        the first time are put into `alone` instead."""
        states = states.copy()
        active = np.nonzero(states >= 0)[0] if self.below else np.zeros(0, np.int64)
        while len(active):
            own = states[active]
            start, count = np.frombuffer(self.start, np.int64)[own], np.frombuffer(self.count, np.int64)[own]
            of, ends = np.repeat(np.arange(len(own)), count), np.cumsum(count)
            place = np.arange(len(of)) - np.repeat(ends - count, count)
            x = keys[active][of] ^ np.frombuffer(self.candidates, np.uint32)[start[of] + place]
            x = (x ^ x >> np.uint32(16)) * np.uint32(0x7FEB352D)  # hashed(), for many at once
            hit = np.nonzero((x ^ x >> np.uint32(15)) * np.uint32(0x846CA68B) < self.below)[0]
            hit = hit[np.diff(of[hit], prepend=-1) > 0]  # the first of each part
            active, place = active[of[hit]], place[hit]
            follow = self.children.get
            for at, key in zip(active.tolist(), (states[active] << 20 | place).tolist(), strict=True):
                child = follow(key)
                if child is None:
                    part, skips, before = self.states[key >> 20]
                    if not self.again(key):
                        alone[at] = part
                        states[at] = -1
                        continue
                    skipped = before + (key & 0xFFFFF)
                    child = self.children[key] = self.state(part, (*skips, skipped), skipped + 1)
                states[at] = child
            active = active[states[active] >= 0]
        return states

    def direct(self, part: str, key: int) -> bytes:
        """A part's ids, drawn by itself."""
        symbols, rank, below, keys = self.symbols(part), self.rank.get, self.below, self.keys
        if len(symbols) > SHORT:
            return self.ids(self.agenda(symbols, key))
        places = PLACES[: len(symbols)]
        agenda = [rank(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (r := min(agenda)) != NONE:  # the leftmost of equals comes up first
            i = agenda.index(r)
            x = key ^ places[i] ^ keys[r]  # hashed(), in place
            x = (x ^ x >> 16) * 0x7FEB352D & MASK
            if (x ^ x >> 15) * 0x846CA68B & MASK < below:
                agenda[i] = NONE
                continue
            p = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del places[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + p, NONE)
            if i < len(agenda):
                agenda[i] = rank(p + symbols[i + 1], NONE)
        return self.ids(symbols)

    def looked_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairs of pieces make, and its rank; negative ids make nothing."""
        wanted = a.astype(np.int64) * len(self.out) + b
        wanted[(a < 0) | (b < 0)] = -1
        at = np.searchsorted(self.pairs, wanted)
        at[self.pairs[at] != wanted] = len(self.pairs) - 1
        return self.made[at], self.ranks[at]

    def directs(self, parts: list[str], keys: np.ndarray) -> list[bytes]:
        """direct() of many parts: those made of characters that are pieces are merged together, by their lengths."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        chars = self.of_char[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        fits = (np.minimum.reduceat(chars, starts) >= 0) & (lengths <= SHORT)
        out = [b"" if fit else self.direct(part, key) for part, key, fit in zip(parts, keys.tolist(), fits.tolist(), strict=True)]
        least = 0
        for width in WIDTHS:
            rows = np.nonzero(fits & (lengths > least) & (lengths <= width))[0]
            least = width
            if len(rows):
                place = np.arange(width + 1)
                symbols = np.where(place < lengths[rows, None], chars[np.minimum(starts[rows, None] + place, len(chars) - 1)], -1)
                self.merge(symbols, keys[rows])
                left = symbols >= 0
                ids, ends = symbols[left].astype("<u4").tobytes(), np.cumsum(left.sum(1)) * 4
                begin = 0
                for row, end in zip(rows.tolist(), ends.tolist(), strict=True):
                    out[row] = ids[begin:end]
                    begin = end
        return out

    def merge(self, symbols: np.ndarray, keys: np.ndarray) -> None:
        """Merges the rows of symbols, ids with negative ones behind them, in place; what goes becomes negative. Each
        step takes one candidate of every row, the leftmost of the lowest rank; a symbol stays where its first
        character was. The last column, which -1 also reaches, is of no symbol."""
        after, before = (np.tile(np.arange(d, d + symbols.shape[1]), (len(symbols), 1)) for d in (1, -1))
        made, ranks = (np.full(symbols.shape, x, np.int32) for x in (-1, FAR))
        made[:, :-1], ranks[:, :-1] = self.looked_up(symbols[:, :-1], symbols[:, 1:])
        own, places = np.arange(len(symbols)), np.arange(symbols.shape[1], dtype=np.uint32) * np.uint32(PLACE)
        while len(own):
            i = ranks[own].argmin(1)
            r = ranks[own, i]
            some = r < FAR
            own, i, r = own[some], i[some], r[some]
            x = keys[own] ^ places[i] ^ r.astype(np.uint32) * np.uint32(RANK)
            x = (x ^ x >> np.uint32(16)) * np.uint32(0x7FEB352D)  # hashed(), for many at once
            skip = (x ^ x >> np.uint32(15)) * np.uint32(0x846CA68B) < self.below
            ranks[own[skip], i[skip]] = FAR
            row, i = own[~skip], i[~skip]
            gone, first = after[row, i], before[row, i]
            last, p = after[row, gone], made[row, i]
            symbols[row, i], symbols[row, gone], ranks[row, gone] = p, -1, FAR
            after[row, i], before[row, last] = last, i
            found = self.looked_up(np.concatenate([symbols[row, first], p]), np.concatenate([p, symbols[row, last]]))
            for kept, new in zip((made, ranks), found, strict=True):
                kept[row, first], kept[row, i] = new[: len(row)], new[len(row) :]

    def agenda(self, symbols: list[str], key: int) -> list[str]:
        """The agenda as a heap, for one chunk of any length."""
        n, rank = len(symbols), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, p) for i in range(n - 1) if (r := rank(p := symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := rank(p := symbols[i] + symbols[j])) is not None:
                heappush(agenda, (r, i, p))

        while agenda:
            r, i, p = heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != p or self.skipped(key, i, r):
                continue
            symbols[i], symbols[j] = p, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def first_states(self, chunk: str) -> tuple[int, ...]:
        """The first states of a chunk's parts; none if one is too long or came up for the first time."""
        if not self.again(chunk):
            return ()
        parts, out = self.apart(chunk), []
        if any(len(p) > SHORT for p in parts):
            return ()
        for part in parts:
            own = self.chunks.get(part)
            out.append(own[0] if own and len(parts) > 1 else self.state(part, (), 0))
        self.chunks[chunk] = tuple(out)
        return self.chunks[chunk]

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; a text gets the model's leading blank. A candidate
        merge that comes up is skipped for good if the hash of seed, text, the part's place in the text, the
        candidate's place and its piece says so, else merged."""
        out: list[list[bytes]] = [[] for _ in texts]
        states: list[int] = []
        alone: dict[int, str] = {}  # parts that are drawn one by one, by their places
        runs: list[tuple[int, int, int, int]] = []  # text, its key, its parts before, parts
        for t, text in enumerate(texts):
            key = zlib.crc32(text.encode("utf-8", "surrogatepass"), self.seed & MASK)
            chunks, at = CHUNK.findall(" " + text) if text else [], 0
            for k in range(0, len(chunks), BLOCK):
                first = len(states)
                for chunk in chunks[k : k + BLOCK]:
                    own = self.chunks.get(chunk) or self.first_states(chunk)
                    if own:
                        states += own
                        continue
                    parts = self.apart(chunk)
                    for part in parts:
                        own = () if len(parts) == 1 else self.chunks.get(part) or self.first_states(part)
                        if not own:
                            alone[len(states)] = part
                        states += own or (-1,)
                runs.append((t, key, at, len(states) - first))
                at += len(states) - first
                if len(states) >= BLOCK:
                    self.flush(states, alone, runs, out)
                    states, alone, runs = [], {}, []
        self.flush(states, alone, runs, out)
        yield from map(b"".join, out)

    def flush(self, states: list[int], alone: dict[int, str], runs: list[tuple[int, int, int, int]], out: list[list[bytes]]) -> None:
        if not states:
            return
        keys = np.concatenate([np.arange(at, at + n, dtype=np.uint32) * np.uint32(PART) ^ np.uint32(key) for _, key, at, n in runs])
        ids = list(map(self.result.__getitem__, self.drawn(np.array(states, np.int64), keys, alone).tolist()))
        if alone:
            for place, own in zip(alone, self.directs(list(alone.values()), keys[list(alone)]), strict=True):
                ids[place] = own
        end = 0
        for t, _, _, n in runs:
            out[t].append(b"".join(ids[end : end + n]))
            end += n
        if len(self.states) > REMEMBERED or len(self.chunks) > REMEMBERED:
            self.forget()

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))

    def apart(self, chunk: str) -> list[str]:
        """A chunk cut between words and other characters wherever no piece has the two characters side by side: no
        merge crosses such a place."""
        if chunk.lstrip(" ").isalnum():  # one word
            return [chunk]
        words = WORDS.findall(chunk)
        out = words[:1]
        for w in words[1:]:
            if (out[-1][-1] + w[0]).replace(" ", SPACE) in self.beside:
                out[-1] += w
            else:
                out.append(w)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def worker_codec(path: str, dropout: float = DROPOUT, seed: int = 0) -> Codec:
    """A worker's codec: what it remembers, at most REMEMBERED states, serves all tasks of this operator that the
    worker runs."""
    return held(__name__, (path, dropout, seed), lambda: Codec(path, dropout, seed))


def encoded(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = 0) -> DataFrame:
    """doc_id, ids (array of int) of every document; null and empty texts have no ids. Another seed gives other cuts."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]):
        codec = worker_codec(path, dropout, seed)
        for part in slices(batches, SLICE):
            yield {"doc_id": part.column(0), "ids": [np.frombuffer(i, "<i4") for i in codec.encode_many([t or "" for t in part.column(1).to_pylist()])]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns in `keep`, and text decoded from the column ids."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    ddl = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "text string"])

    def run(batches: Iterator[pa.RecordBatch]):
        codec = worker_codec(path)
        for b in slices(batches, SLICE):
            ids = b.column(len(keep))
            yield {c: b.column(k) for k, c in enumerate(keep)} | {"text": [None if i is None else codec.decode(np.array(i, np.int64)) for i in ids.to_pylist()]}

    return map_batches(rows.select(*[F.col(f"`{c}`") for c in keep], "ids"), run, ddl)


def round_trip(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = 0) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, lossless: encoded and decoded in one pass.

    ids_crc32 is over the ids as little-endian unsigned 32-bit numbers. Every occurrence of a word has draws of its
    own. Null and empty texts have no ids and decode to an empty text. Texts of any length are encoded whole, word by
    word. Equal texts give equal results, repeated rows too; a null doc_id stays null; no rows give no rows; other
    columns are ignored, whatever their names."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]):
        codec = worker_codec(path, dropout, seed)
        for part in slices(batches, SLICE):
            texts = [t or "" for t in part.column(1).to_pylist()]
            rows: dict[str, list] = {k: [] for k in ("n_ids", "ids_crc32", "decoded_sha256", "lossless")}
            for text, ids in zip(texts, codec.encode_many(texts), strict=True):
                back = codec.decode(np.frombuffer(ids, "<u4"))
                got = (len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text)
                for k, x in zip(rows, got, strict=True):
                    rows[k].append(x)
            yield {"doc_id": part.column(0)} | rows

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean")
