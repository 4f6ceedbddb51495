"""Documents packed into containers of fixed capacity, by vector best fit.

An item has three demands: tokens, one document, and an attention cost, the square of
its length in blocks.  A container has a capacity for each.  Items come in order of
falling length; each goes into the open container that keeps every constraint and
whose remaining capacities, relative to the whole, leave the smallest weighted norm.
Only a document longer than the container is cut, into full containers and a rest.

Items are spread evenly, by a hash of document and piece, over groups of a bounded
number of items, and every group is packed on its own: a task holds one group's lengths
and open containers, never texts.  A group wastes at most its last, unfilled containers.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logosmill.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PACKED = "container string, capacity bigint, bin_id string, doc_id bigint, piece_no int, token_start bigint, token_stop bigint, n_tokens bigint"


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) by the tokenizer file; a null text counts as an empty one.

    The file (a vocabulary of some megabytes) is read in the driver and broadcast, so the
    executors need not have it.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(vocabulary.value).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return documents.select(key, count(F.col(text)).alias("n_tokens"))


class BestFit:
    """Open containers by residual tokens; chooses by the weighted norm of what is left."""

    def __init__(self, tokens: int, documents: int, cost: int, weights: tuple[float, float, float]):
        self.capacity = (tokens, documents, cost)
        self.weights = weights
        self.open: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(tokens + 1)]
        self.filled = 0  # bit r is set if a container with r tokens left is open
        self.count = 0

    def _norm(self, tokens: int, documents: int, cost: int) -> float:
        (a, b, c), (x, y, z) = self.capacity, self.weights
        return x * (tokens / a) ** 2 + y * (documents / b) ** 2 + z * (cost / c) ** 2

    def place(self, size: int, cost: int) -> int:
        """Number of the container for an item; a new one if it fits nowhere."""
        best, at = None, None
        left = self.filled >> size << size
        while left:
            r = (left & -left).bit_length() - 1
            if best is not None and self.weights[0] * ((r - size) / self.capacity[0]) ** 2 >= best:
                break
            for state in self.open[r]:
                d, c = state
                if d >= 1 and c >= cost:
                    norm = self._norm(r - size, d - 1, c - cost)
                    if best is None or norm < best:
                        best, at = norm, (r, state)
            left &= left - 1
        if at is None:
            number, rest = self.count, (self.capacity[0] - size, self.capacity[1] - 1, self.capacity[2] - cost)
            self.count += 1
        else:
            r, (d, c) = at
            numbers = self.open[r][(d, c)]
            number = heapq.heappop(numbers)
            if not numbers:
                del self.open[r][(d, c)]
                if not self.open[r]:
                    self.filled &= ~(1 << r)
            rest = (r - size, d - 1, c - cost)
        if rest[0] > 0 and rest[1] > 0:
            heapq.heappush(self.open[rest[0]].setdefault(rest[1:], []), number)
            self.filled |= 1 << rest[0]
        return number


def pack(
    counts: DataFrame, containers: list[tuple[str, int]], max_documents: int | None = None, max_cost: float | None = None, block: int = 64,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), items_per_group: int = 50_000, key: str = "doc_id",
) -> DataFrame:
    """Pack (key, n_tokens) rows into every kind of container: PACKED rows.

    ``containers``: (name, capacity in tokens).  The attention cost of an item is the
    square of its number of ``block``-token blocks.  ``max_documents`` defaults to one
    document per 32 tokens, at least 16, so a container of very short documents is full
    before its tokens are; ``max_cost`` defaults to the cost of one full-length item
    (of small containers, four blocks' a document), and binds only where it is set lower.  An item that exceeds a
    capacity by itself has a container to itself.  Documents without tokens, repeated keys
    and null keys: an empty document takes no room and is in no container, a repeated key
    is packed once, a null key not at all.  Ties go to the container opened first.
    """
    counts = cut(counts.where(F.col(key).isNotNull() & (F.col("n_tokens") > 0)).groupBy(key).agg(F.max("n_tokens").alias("n_tokens")))
    kinds = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).cast("bigint").alias("capacity")) for n, c in containers])
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.col("capacity"))
    items = counts.select(key, "n_tokens", F.explode(kinds).alias("k")).select(key, "n_tokens", "k.*").select(
        "container", "capacity", key, "n_tokens", F.posexplode(starts).alias("piece_no", "token_start"))
    items = items.withColumn("size", F.least(F.col("capacity"), F.col("n_tokens") - F.col("token_start")))
    number = max((r["n"] for r in items.groupBy("container").agg(F.count("*").alias("n")).collect()), default=0)
    groups = max(1, -(-number // items_per_group))
    items = items.withColumn("grp", F.pmod(F.xxhash64(key, "piece_no"), F.lit(groups)))
    spread = items.repartition(groups * len(containers), "container", "grp").sortWithinPartitions("container", "grp", F.desc("size"), key, "piece_no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fit = None, None
        for batch in batches:
            bins = []
            for name, capacity, group, size in zip(batch.container, batch.capacity, batch.grp, batch["size"]):
                if (name, group) != current:
                    current = (name, group)
                    documents = max_documents or max(16, int(capacity) // 32)
                    fit = BestFit(int(capacity), documents, max_cost or max((-(-int(capacity) // block)) ** 2, 4 * documents), weights)
                bins.append(f"{name}/{group}/{fit.place(int(size), (-(-int(size) // block)) ** 2)}")
            yield pd.DataFrame({
                "container": batch.container, "capacity": batch.capacity, "bin_id": bins, key: batch[key], "piece_no": batch.piece_no,
                "token_start": batch.token_start, "token_stop": batch.token_start + batch["size"], "n_tokens": batch["size"]})

    return spread.mapInPandas(run, PACKED.replace("doc_id", key))
