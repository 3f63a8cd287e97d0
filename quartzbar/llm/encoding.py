"""Encoding of a corpus with a byte-level vocabulary, by recursive queries per partition.

Each partition keeps an in-memory DuckDB database with the merge table. The words of its documents (split by
the vocabulary's pattern) are encoded once each: token-position rows of all new words join the merge table and
each word contracts its pair of minimum rank, all its places from the left at once (a token that a merge makes
has only merges of higher ranks, so none of them could come in between); a recursive query repeats that until
no word has a pair left, and goes on with the words that have. Ordered aggregation turns positions into ids of
words, and words into ids of documents. Nothing is shuffled or spilled, and memory is bounded by a batch of
texts and a cache of words that is emptied when full.

The recursion keeps a row per position and step, so its cost grows faster than a word's length; words beyond
LONG_WORD bytes take the same contraction with a heap, which is equal step by step.

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text; every
row of the input gives one row; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quartzbar.llm.tokenizers import FOLDER, PATTERN, merge_table

LONG_WORD = 1024
#: Steps of one recursion, bytes of the words in it: their product bounds the rows it keeps.
STEPS, WORD_BYTES = 32, 200_000
#: Characters of texts that are encoded together, words that the cache holds.
BATCH_CHARS, CACHE_WORDS = 4_000_000, 500_000

_CONTRACT = f"""
CREATE OR REPLACE TEMP TABLE contracted AS
WITH RECURSIVE step AS (
  SELECT 0 AS turn, word, pos, token FROM fresh
  UNION ALL
  SELECT turn + 1, word, pos, CASE WHEN taken THEN merged ELSE token END
  FROM (
    SELECT *, lag(taken) OVER (PARTITION BY word ORDER BY pos) AS gone
    FROM (
      -- Of places that overlap, every second one from the left.
      SELECT *, hit AND (k - coalesce(max(CASE WHEN NOT hit THEN k END) OVER (PARTITION BY word ORDER BY pos), 0)) % 2 = 1 AS taken
      FROM (
        SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY word), false) AS hit, min(rank) OVER (PARTITION BY word) AS best
        FROM (
          SELECT *, lead(token) OVER (PARTITION BY word ORDER BY pos) AS following, row_number() OVER (PARTITION BY word ORDER BY pos) AS k FROM step
        ) AS pairs
        LEFT JOIN merges ON merges.l = pairs.token AND merges.r = pairs.following
        WHERE turn < {STEPS}
      ) WHERE best IS NOT NULL
    )
  ) WHERE gone IS NOT TRUE
)
SELECT turn, word, pos, token FROM step JOIN (SELECT word, max(turn) AS turn FROM step GROUP BY word) USING (word, turn)
"""
#: Words that may have a pair left go on.
_FINISHED = f"INSERT INTO encoded SELECT word, list(token ORDER BY pos) FROM contracted WHERE turn < {STEPS} GROUP BY word"
_UNFINISHED = f"CREATE OR REPLACE TEMP TABLE fresh AS SELECT word, pos, token FROM contracted WHERE turn = {STEPS}"
_DECODE = """
SELECT doc, flatten(list(ids ORDER BY place)) AS ids FROM places JOIN encoded USING (word) GROUP BY doc ORDER BY doc
"""


class _Numbers(dict):
    """Words, numbered in the order in which they are first met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def contract_by_heap(tokens: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The fixpoint of contracting the leftmost pair of minimum rank, in n log n steps."""
    n = len(tokens)
    tokens = list(tokens)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = following[i]
        if j < n and (hit := ranks.get((tokens[i], tokens[j]))):
            heapq.heappush(heap, (hit[0], i, tokens[i], tokens[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = following[i]
        if tokens[i] != a or j >= n or tokens[j] != b:
            continue
        tokens[i] = ranks[a, b][1]
        tokens[j] = -1
        following[i] = following[j]
        if following[j] < n:
            before[following[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [t for t in tokens if t >= 0]


class Encoder:
    """Encodes texts with one vocabulary; holds the database of one partition."""

    def __init__(self, name: str, folder: str):
        import duckdb

        self.bytes, merges = merge_table(name, folder)
        self.ranks = {(a, b): (k, c) for k, (a, b, c) in enumerate(merges)}
        self.base = np.array(self.bytes, dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        left, right, merged = (np.array(x, dtype=np.int32) for x in zip(*merges))
        self.db.register("m", pa.table({"l": left, "r": right, "rank": np.arange(len(merges), dtype=np.int64), "merged": merged}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.unregister("m")
        self.split = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.words = _Numbers()
        self.db.execute("CREATE OR REPLACE TABLE encoded (word INTEGER, ids INTEGER[])")

    def learn(self, fresh: list[str], first: int) -> None:
        """Encodes words not met before; they are numbered from first on."""
        raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
        long = [(first + i, contract_by_heap([self.bytes[b] for b in r], self.ranks)) for i, r in enumerate(raw) if len(r) > LONG_WORD]
        if long:
            ids = pa.array([x for _, x in long], pa.list_(pa.int32()))
            self.db.register("longs", pa.table({"word": pa.array([i for i, _ in long], pa.int32()), "ids": ids}))
            self.db.execute("INSERT INTO encoded SELECT * FROM longs")
            self.db.unregister("longs")
        short = [(first + i, r) for i, r in enumerate(raw) if len(r) <= LONG_WORD]
        while short:
            n = size = 0
            while n < len(short) and (n == 0 or size + len(short[n][1]) <= WORD_BYTES):
                size += len(short[n][1])
                n += 1
            self.contract(short[:n])
            short = short[n:]

    def contract(self, words: list[tuple[int, bytes]]) -> None:
        sizes = np.array([len(r) for _, r in words])
        data = np.frombuffer(b"".join(r for _, r in words), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        number = np.array([k for k, _ in words], dtype=np.int32)
        rows = {"word": np.repeat(number, sizes), "pos": (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.int32), "token": self.base[data]}
        self.db.register("rows", pa.table(rows))
        self.db.execute("CREATE OR REPLACE TEMP TABLE fresh AS SELECT * FROM rows")
        self.db.unregister("rows")
        while self.db.execute("SELECT count(*) FROM fresh").fetchall()[0][0]:
            for statement in (_CONTRACT, _FINISHED, _UNFINISHED):
                self.db.execute(statement)

    def encode(self, texts: list[str | None]) -> pa.Array:
        """The ids of each text, as an array of lists."""
        if len(self.words) > CACHE_WORDS:
            self.forget()
        first, sizes = len(self.words), np.zeros(len(texts), dtype=np.int64)
        numbers = []
        for d, text in enumerate(texts):
            if text:
                found = self.split.findall(text)
                sizes[d] = len(found)
                numbers.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
        if not numbers:
            return pa.array([[] for _ in texts], pa.list_(pa.int32()))
        if len(self.words) > first:
            self.learn(list(islice(self.words, first, None)), first)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = {"doc": np.repeat(np.arange(len(texts), dtype=np.int32), sizes), "place": place.astype(np.int32), "word": np.concatenate(numbers)}
        self.db.register("places", pa.table(rows))
        ids = self.db.sql(_DECODE).to_arrow_table().column(1).combine_chunks()
        self.db.unregister("places")
        # Texts without words stand between the others with no ids.
        lengths = np.zeros(len(texts) + 1, dtype=np.int64)
        lengths[1:][sizes > 0] = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), ids.flatten().cast(pa.int32()))


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode_corpus(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """doc_id, ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(name, folder)
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = size = 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size >= BATCH_CHARS or i == len(texts) - 1:
                    encoded = encoder.encode(texts[start : i + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[start : i + 1], pa.int64()), encoded], schema=_OUT)
                    start, size = i + 1, 0

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
