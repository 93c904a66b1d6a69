"""Byte-level BPE in DuckDB, one in-process database per Python worker, fed partition by partition.

Each task cuts its texts into pre-tokens and gives those that it has not met yet to a recursive query. A row is
a token position of a word: its token and the token after it. Each round joins the positions with the merge table
(all pairs of tokens whose bytes together are a token, ranked by that token), takes each word's leftmost pair of
least rank, contracts it, and hands on the words that changed; a word without a pair is done. Ordered
aggregations then string the ids together and, through the vocabulary, the bytes they stand for: the decoder.

Words repeat, so a worker keeps the ids of up to CACHE words that it has met in a second batch (then forgets the half that it
has not met for longest), or with a larger `cache` of that many words, from the first time on: its
memory does not grow with its input, and with CACHE words that come once take none. Every word is decoded as it is learnt; one that decodes to its own bytes stands for them and is not kept twice.
Pre-tokens over LONG bytes, which would take a round per merge over all their positions, are contracted by a heap in
the same order. There is no shuffle; a lost task is simply run again. A worker that has had no such task for IDLE
seconds closes its database and gives all of its memory back.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import tempfile
import threading
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm.common import arrow_map, let_go

#: Words a query takes, words kept by a worker, bytes from which a pre-token goes to the heap, and seconds until an idle worker lets go.
WORDS, CACHE, LONG, IDLE = 8_000, 300_000, 256, 1.0
#: Words kept where encoding is all that an executor does.
WIDE = 900_000
#: Slots that tell whether a word has been met, by its hash; cleared after as many words as an eighth of them. A wrong answer costs memory only.
SLOTS = 1 << 22

#: positions: word, position, the next position, token, the next token. A word keeps its rows of every round r.
ENCODE = """
    CREATE OR REPLACE TEMP TABLE tokens AS
    WITH RECURSIVE state(w, r, p, np, t, nt) AS (
        SELECT w, 0, p, np, t, nt FROM positions
        UNION ALL
        SELECT w, r + 1, p,
               CASE WHEN p = bp THEN after_np ELSE np END,
               CASE WHEN p = bp THEN merged ELSE t END,
               CASE WHEN p = bp THEN after_nt WHEN np = bp THEN merged ELSE nt END
        FROM (
            SELECT s.w, s.r, s.p, s.np, s.t, s.nt, b.bp, b.merged, n.np AS after_np, n.nt AS after_nt
            FROM state s
            JOIN (
                SELECT w, (best // 65536)::INTEGER AS merged, (best % 65536)::INTEGER AS bp, gone
                FROM (
                    SELECT s.w, min(m.token * 65536 + s.p) AS best, arg_min(s.np, m.token * 65536 + s.p) AS gone
                    FROM state s JOIN merges m ON m.pair = s.t * 4294967296 + s.nt
                    GROUP BY s.w
                )
            ) b ON s.w = b.w
            JOIN state n ON n.w = b.w AND n.p = b.gone
            WHERE s.p <> b.gone
        )
    )
    SELECT w, p, t FROM state JOIN (SELECT w, max(r) AS r FROM state GROUP BY w) USING (w, r)
"""
IDS = "SELECT w, string_agg(t::VARCHAR, ' ' ORDER BY p) AS ids, string_agg(v.hex, '' ORDER BY p) AS hex FROM tokens JOIN vocabulary v USING (t) GROUP BY w"
DECODE = "SELECT w, string_agg(v.hex, '' ORDER BY p) AS hex FROM tokens JOIN vocabulary v USING (t) GROUP BY w"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes words by the ranks in a file."""

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        self.ranks = load_ranks(path)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [
            (a << 32 | b, rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None
        ]
        merges = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "token": pa.array([m for _, m in pairs], pa.int64())})
        vocabulary = pa.table({"t": pa.array(list(self.bytes_of), pa.int32()), "hex": [b.hex() for b in self.bytes_of.values()]})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "128MB", "temp_directory": tempfile.gettempdir(), "preserve_insertion_order": False})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.known: dict[str, str] = {}  # the ids of a word, as text
        self.before: dict[str, str] = {}  # those not asked for since known was begun
        self.odd: dict[str, bytes] = {}  # what a word decodes to, if that is not the word
        self.met, self.marks = bytearray(SLOTS), 0

    def _positions(self, words: list[bytes]) -> pa.Table:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        tokens = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        at = (np.arange(len(tokens)) - (np.cumsum(lengths) - lengths)[word]).astype(np.int32)
        last = np.zeros(len(tokens), bool)
        last[np.cumsum(lengths) - 1] = True
        return pa.table(
            {
                "w": word,
                "p": at,
                "np": pa.array(at + 1, pa.int32(), mask=last),
                "t": tokens,
                "nt": pa.array(np.append(tokens[1:], 0).astype(np.int32), pa.int32(), mask=last),
            }
        )

    def _by_query(self, raw: list[bytes]) -> Iterator[tuple[int, str, bytes]]:
        """Of each word its place, its ids as text, and the bytes they decode to."""
        self.db.register("positions", self._positions(raw))
        self.db.execute(ENCODE)
        self.db.unregister("positions")
        found = self.db.sql(IDS).to_arrow_table()
        for w, ids, text in zip(found["w"].to_pylist(), found["ids"].to_pylist(), found["hex"].to_pylist(), strict=True):
            yield w, ids, bytes.fromhex(text)

    def _by_heap(self, word: bytes) -> tuple[str, bytes]:
        """Ids as text and what they decode to: the same contractions in the same order: the least rank first, of equal ranks the leftmost."""
        parts = [word[i : i + 1] for i in range(len(word))]
        before, after = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (rank := self.ranks.get(both := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (rank, i, both))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != len(both) or parts[i] + parts[j] != both:
                continue  # one of the two has changed since
            parts[i], parts[j], after[i] = both, b"", after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        ids = [self.ranks[p] for p in parts if p]
        return " ".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids))

    def learn(self, texts: Iterable[list[str]]) -> dict[str, tuple[str, int, bytes]]:
        """(ids as text, their number, the bytes they decode to) of the words of these texts."""
        wanted = list({w for words in texts for w in words})
        return {w: (ids, ids.count(" ") + 1, self.decoded([w])) for w, ids in zip(wanted, self.meet(wanted), strict=True)}

    def meet(self, wanted: list[str]) -> list[str]:
        """The ids of each of these words (given once each), as text."""
        if len(self.known) + len(self.odd) > self.cache // 2:
            self.known, self.before, self.odd = {}, self.known, {w: b for w, b in self.odd.items() if w in self.known}
        out = list(map(self.known.get, wanted))
        short = []
        for i, ids in enumerate(out):
            if ids is None:
                if (ids := self.before.pop(wanted[i], None)) is not None:
                    out[i] = self.known[wanted[i]] = ids
                    continue
                raw = wanted[i].encode()
                if (rank := self.ranks.get(raw)) is not None:
                    out[i] = str(rank)
                elif len(raw) > LONG:
                    out[i] = self._learnt(wanted[i], *self._by_heap(raw))
                else:
                    short.append((len(raw), i, raw))
        short.sort()  # a query takes as many rounds as its longest word
        for a in range(0, len(short), WORDS):
            part = short[a : a + WORDS]
            for k, ids, decoded in self._by_query([raw for *_, raw in part]):
                i = part[k][1]
                out[i] = self._learnt(wanted[i], ids, decoded)
        return out

    def _learnt(self, word: str, ids: str, decoded: bytes) -> str:
        """Kept from the second time on, or at once where there is room for more than CACHE."""
        slot = hash(word) % SLOTS
        if self.cache > CACHE or self.met[slot]:
            self.known[word] = ids
        else:
            self.marks += 1
            if self.marks > SLOTS // 8:
                self.met, self.marks = bytearray(SLOTS), 0
            self.met[slot] = 1
        if decoded != word.encode():
            self.odd[word] = decoded
        return ids

    def decoded(self, words: Iterable[str]) -> bytes:
        """What the ids of these known words decode to."""
        if self.odd:
            return b"".join([self.odd.get(w) or w.encode() for w in words])
        return "".join(words).encode()

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids, by the ordered aggregation."""
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for row in ids for t in row), np.int32, int(lengths.sum()))
        row = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        self.db.register("given", pa.table({"w": row, "p": np.arange(len(flat), dtype=np.int64), "t": flat}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE tokens AS SELECT * FROM given")
        self.db.unregister("given")
        found = self.db.sql(DECODE).to_arrow_table()
        texts = dict(zip(found["w"].to_pylist(), found["hex"].to_pylist(), strict=True))
        return [bytes.fromhex(texts.get(i, "")) for i in range(len(ids))]


class _Index(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_IDLE: dict[str, Codec] = {}
_LOCK = threading.Lock()
_TIMERS: list[threading.Timer] = []


def _close_idle() -> None:
    with _LOCK:
        while _IDLE:
            _IDLE.popitem()[1].db.close()
    gc.collect()
    let_go()


@contextmanager
def codec(path: str, cache: int = CACHE) -> Iterator[Codec]:
    """The worker's codec for a file, for one task. Tasks that follow closely find it, and the words it knows, again."""
    with _LOCK:
        while _TIMERS:
            _TIMERS.pop().cancel()
        mine = _IDLE.pop(path, None)
    mine = mine or Codec(path)
    mine.cache = cache
    try:
        yield mine
    finally:
        with _LOCK:
            _IDLE[path] = mine
            _TIMERS.append(threading.Timer(IDLE, _close_idle))
            _TIMERS[-1].daemon = True
            _TIMERS[-1].start()


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, at: int, digests: bool, cache: int = CACHE):
    cut = regex.compile(pattern)
    with codec(path, cache) as bpe:
        for batch in batches:
            index = _Index()  # a text is kept as the numbers of its words
            texts = [np.fromiter(map(index.__getitem__, cut.findall(t.as_py() or "")), np.int32) for t in batch.column(at)]
            words = list(index)
            ids_of = bpe.meet(words)
            n, ids, raw = [], [], []
            for text in texts:
                text = text.tolist()
                joined, back = " ".join(map(ids_of.__getitem__, text)), bpe.decoded(map(words.__getitem__, text))
                n.append(joined.count(" ") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest() if digests else joined)
                raw.append(hashlib.sha256(back).hexdigest() if digests else back)
            if digests:
                made = [pa.array(ids, pa.string()), pa.array(raw, pa.string())]
            else:
                flat = np.array(" ".join(i for i in ids if i).split(" ") if any(ids) else [], np.int32)
                made = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat)), pa.array(raw, pa.binary())]
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n, *made], [*batch.schema.names, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("token_ids", "decoded"))])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", digests: bool = False, cache: int = CACHE) -> DataFrame:
    """docs with n_tokens and token_ids (array of int) and decoded (binary: the ids decoded again, the text's UTF-8).

    digests: ids_sha256 and decoded_sha256 instead of the two; the first is over the decimal ids joined by one space.
    Each match of pattern is encoded separately, without special tokens. A null text is empty; an empty text has
    no tokens. All rows and columns of docs stay, repeated ones too; columns named like a result column are replaced.
    """
    made = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("n_tokens", "token_ids", "decoded")
    mine = docs.select(*(c for c in docs.columns if c.lower() not in made))
    kinds = "n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<int>, decoded binary")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mine.schema.fields) + ", " + kinds
    at = mine.columns.index(text_col)
    return arrow_map(mine, lambda it: _encoded(it, path, pattern, at, digests, cache), schema)


def decode(rows: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """rows with decoded (binary) for a column of token ids. Null ids decode to nothing; an id outside the vocabulary, or a null among ids, is an error. A column named like the result is replaced."""
    mine = rows.select(*(c for c in rows.columns if c.lower() != "decoded"))
    at = mine.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path) as bpe:
            for batch in batches:
                ids = [row or [] for row in batch.column(at).to_pylist()]
                if bad := {t for row in ids for t in row} - bpe.bytes_of.keys():
                    raise ValueError(f"ids outside the vocabulary: {sorted(map(str, bad))[:5]}")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bpe.decode(ids), pa.binary())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mine.schema.fields) + ", decoded binary"
    return arrow_map(mine, run, schema)


def digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return encode(docs.select("doc_id", F.col(text_col)), path, pattern, text_col, digests=True, cache=WIDE).drop(text_col)
