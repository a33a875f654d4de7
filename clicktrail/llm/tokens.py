"""Token counts by byte-pair merging with a heap over a linked list."""

import heapq
import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.common import query, table

LIMIT = 2048
#: Distinct chunks, and as many distinct words, whose counts a Python worker remembers; when full, it starts afresh.  Longer ones than
#: LONGEST are not remembered, so both take some 100 MB at most.
REMEMBERED, LONGEST = 400_000, 64
VOCABULARY = "word_bpe_49k.json"


def merges_in(symbols: list, ranks: dict) -> int:
    """How many pairs of neighbours merge.  The pair with the lowest rank goes first, of equal ranks the leftmost.

    ``symbols`` are ids; ``ranks`` maps a pair of ids to ``(rank, id of the merged symbol)``.  Neighbours are linked by
    position; a heap entry whose pair has changed meanwhile is passed over.
    """
    n = len(symbols)
    if n < 2:
        return 0
    right, left, heap, done = list(range(1, n + 1)), list(range(-1, n - 1)), [], 0
    for i in range(n - 1):
        if found := ranks.get((symbols[i], symbols[i + 1])):
            heap.append((found[0], i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = ranks[a, b][1], None
        right[i] = k = right[j]
        if k < n:
            left[k] = i
        done += 1
        for x, y in ((left[i], i), (i, k)):
            if x >= 0 and y < n and (found := ranks.get((symbols[x], symbols[y]))):
                heapq.heappush(heap, (found[0], x, symbols[x], symbols[y]))
    return done


def _remember(known: dict, piece, n: int) -> None:
    if len(piece) <= LONGEST:
        if len(known) >= REMEMBERED:
            known.clear()
        known[piece] = n


class Counter:
    """Counts tokens as the tokenizer file gives them; its normaliser and splitter are the library's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, library = spec["model"], Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ids, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            stem = a.removesuffix(self.suffix) if self.suffix else a
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[stem + b])
        self.known: dict[bytes, int] = {}
        self.words: dict[str, int] = {}

    def word(self, piece: str) -> int:
        if (n := self.words.get(piece)) is None:
            n = self.merged(piece)
            _remember(self.words, piece, n)
        return n

    def merged(self, piece: str) -> int:
        symbols = [self.ids.get(c) for c in piece[:-1]] + [self.ids.get(piece[-1] + self.suffix)]
        symbols = [s for s in symbols if s is not None]
        return len(symbols) - merges_in(symbols, self.ranks)

    def plain(self, text: str) -> int:
        if text.isascii() and text.isalpha():  # one word, which the normaliser lower-cases and the splitter leaves alone
            return self.word(text.lower())
        return sum(self.word(piece) for piece, _ in self.split(self.normalize(text)) if piece)

    def chunk(self, text: str) -> int:
        """Tokens of a run without ASCII white space; special strings count one each, the leftmost first."""
        total = 0
        while text:
            at, special = min(((i, s) for s in self.special if (i := text.find(s)) >= 0), default=(len(text), ""))
            total += self.plain(text[:at]) + bool(special)
            text = text[at + len(special):]
        return total

    def count(self, text: bytes) -> int:
        """The splitter never joins across white space, so counts of chunks add up and can be remembered."""
        known, total = self.known, 0
        for chunk in text.split():
            n = known.get(chunk)
            if n is None:
                n = self.chunk(chunk.decode("utf-8", "replace"))
                _remember(known, chunk, n)
            total += n
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text; ``path`` is the tokenizer file, on every executor.

    Null and empty texts have no bytes and no tokens.  A text of any length is one pass over its words.  Repeated rows
    get a row each, an empty table none, further columns are ignored.  Nothing is shuffled.
    """

    slim = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"

    def rows(it):
        count = _counter(path).count
        for batch in it:
            texts = batch.column("text").cast(pa.binary())
            tokens = pa.array((count(t.as_py() or b"") for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), tokens], ["doc_id", "n_bytes", "n_tokens"])

    return slim.mapInArrow(rows, schema).withColumn("over_limit", F.col("n_tokens") > limit)


@query("op2_token_counts")
def op2(spark, folder):
    import public_tokenizers

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
