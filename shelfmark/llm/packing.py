"""Texts put into containers of fixed token capacity with little space unused (problem 8).

Method: conflict-constrained best-fit. Open containers are ordered by what is left in them and carry bitmaps of the sources and
duplicate clusters inside; a successor search goes from the tightest container that has room to the next looser one until a
compatible one is found. Texts are placed in decreasing size.

Conflicts: two texts of one duplicate cluster (equal texts) share no container, as long as the copies are at most half as many as the
containers the tokens need; beyond that a container holds up to twice the average of them, so that copies of a third of all rows do
not force empty space either. Texts of one source share one only up to
the source's quota: ``QUOTA`` times what its share of all texts makes of a container's texts on average, at least ``LEAST_QUOTA``; so a
source with a third of all rows does not force empty space.

Only a text longer than the capacity is divided, into full parts and a rest; full parts fill a container each.

Scale: token counts and quotas are plain aggregates over all rows. Texts are spread over shards of about ``SHARD_TOKENS`` tokens by their
hash, equal texts into as many shards as possible, and each shard is packed by itself; the space lost is less than one
container a shard.

Defined results: null and empty texts have no tokens and no container. Repeated rows (equal doc_id) are one text. A text exactly
as long as the capacity fills a container. Without rows there are no containers.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from shelfmark.llm.arrow import map_batches_from
from shelfmark.session import written

#: Place of the tokenizer's ranks (base64 token and rank a line); read by the driver and broadcast.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that public tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A container holds at most so many times the texts of a source that its share of all texts makes on average, and at least ``LEAST_QUOTA``.
QUOTA = 4
LEAST_QUOTA = 2
#: Tokens that one shard packs, about; a shard is held in one task's memory as small integers.
SHARD_TOKENS = 8_000_000
#: Tasks of one packing at most; beyond that a task packs several shards, one after another.
MAX_TASKS = 10_000
#: Rows of the parameter table of containers at most.
MAX_CLASSES = 10_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, cluster (of equal texts), tokens of each text with tokens; equal doc_ids once."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))
    key = documents.schema["doc_id"].dataType.simpleString()

    def make():
        import tiktoken

        encoding = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})

        def run(c: dict[str, list]) -> dict[str, list]:
            return {"doc_id": c["doc_id"], "source": c["source"], "cluster": c["cluster"], "tokens": [len(encoding.encode_ordinary(t)) for t in c["text"]]}

        return run

    rows = documents.filter((F.length("text") > 0) & F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("cluster"), "text")
    counted = map_batches_from(rows, make, f"doc_id {key}, source string, cluster long, tokens long")
    return counted.groupBy("doc_id").agg(F.max(F.struct("tokens", "source", "cluster")).alias("t")).select("doc_id", "t.source", "t.cluster", "t.tokens")


class Container:
    """An open container: what is left, and bitmaps of the sources and clusters that it holds as often as allowed."""

    __slots__ = ("number", "left", "full_sources", "full_clusters", "count")

    def __init__(self, number: int, capacity: int) -> None:
        self.number, self.left = number, capacity
        self.full_sources = self.full_clusters = 0  # bitmaps of what may not be added
        self.count: dict[tuple[str, int], int] = {}


def best_fit(items: list[tuple[int, int, int]], capacity: int, quota: list[int], cluster_quota: dict[int, int] | None = None) -> list[int]:
    """Container number of each item (tokens, source number, cluster number); items in placing order.

    Tokens are at least 1 and at most the capacity; cluster -1 is none. quota: by source number, the texts of it a container may
    hold; cluster_quota: the same by cluster number where it is more than one.
    """
    order: list[tuple[int, int]] = []  # (left, number) of open containers, sorted
    boxes: list[Container] = []
    out = []
    for tokens, source, cluster in items:
        s, c = 1 << source, 1 << cluster if cluster >= 0 else 0
        i = bisect_left(order, (tokens, -1))
        while i < len(order):  # successor search: the next looser one, until one has no conflict
            box = boxes[order[i][1]]
            if not box.full_sources & s and not box.full_clusters & c:
                del order[i]
                break
            i += 1
        else:
            box = Container(len(boxes), capacity)
            boxes.append(box)
        box.left -= tokens
        n = box.count["s", source] = box.count.get(("s", source), 0) + 1
        if n >= quota[source]:
            box.full_sources |= s
        if c:
            n = box.count["c", cluster] = box.count.get(("c", cluster), 0) + 1
            if n >= (cluster_quota or {}).get(cluster, 1):
                box.full_clusters |= c
        if box.left:
            insort(order, (box.left, box.number))
        out.append(box.number)
    return out


def pack_shard(rows: list[tuple], capacity: int, quota_of: dict[str, int]) -> list[tuple]:
    """(doc_id, part, tokens, container number) of (doc_id, source, cluster, tokens) rows."""
    rows = sorted(rows, key=lambda r: (-r[3], str(r[0])))
    sources = {s: i for i, s in enumerate(sorted({r[1] for r in rows}))}
    quota = [quota_of.get(s, LEAST_QUOTA) for s in sources]
    copies: dict[int, int] = {}
    for r in rows:
        copies[r[2]] = copies.get(r[2], 0) + 1
    clusters = {c: i for i, c in enumerate(sorted(c for c, n in copies.items() if n > 1))}  # single texts need no bit
    needed = -(-sum(r[3] for r in rows) // capacity)
    often = {clusters[c]: -(-2 * n // needed) for c, n in copies.items() if 2 * n > needed and n > 1}
    full, items, what = [], [], []
    for doc, source, cluster, tokens in rows:
        parts = -(-tokens // capacity)
        for p in range(parts):
            n = min(capacity, tokens - p * capacity)
            if n == capacity:
                full.append((doc, p + 1, n))
            else:
                items.append((n, sources[source], clusters.get(cluster, -1)))
                what.append((doc, p + 1, n))
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], i))
    places = best_fit([items[i] for i in order], capacity, quota, often)
    first = max(places, default=-1) + 1
    return [(*what[i], place) for i, place in zip(order, places, strict=True)] + [(*f, first + k) for k, f in enumerate(full)]


def pack(counts: DataFrame, containers: DataFrame) -> DataFrame:
    """container_class, container_id, doc_id, part, tokens: a packing of all texts for each row of containers.

    counts: of :func:`token_counts`. containers is a parameter table that the driver reads; more than ``MAX_CLASSES`` rows are
    refused. Containers without class or with a capacity below 1 are left out.
    """
    spark = counts.sparkSession
    fields = counts.schema["doc_id"].dataType.simpleString()
    schema = f"container_class string, container_id string, doc_id {fields}, part int, tokens long"
    given = containers.filter(F.col("container_class").isNotNull() & (F.col("capacity_tokens") > 0)).select("container_class", "capacity_tokens").distinct()
    classes = sorted(map(tuple, given.limit(MAX_CLASSES + 1).collect()))
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} container classes")
    if not classes:
        return spark.createDataFrame([], schema)
    counts = written(counts, "token-counts")
    totals = counts.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).first()
    n, mean = max(1, totals.n), (totals.tokens or 0) / max(1, totals.n)
    shards = max(1, -(-(totals.tokens or 0) // SHARD_TOKENS))
    # Equal texts go round the shards, so that one shard does not get all copies of a text.
    spread = counts.withColumn("shard", F.pmod(F.xxhash64("cluster", "doc_id"), F.lit(shards)).cast("int"))
    # A source's quota differs from the least only if it has a good part of all texts; there are few of those.
    inside = [max(1.0, capacity / max(1.0, mean)) for _, capacity in classes]
    shares = {r.source: r.k for r in counts.groupBy("source").agg(F.count("*").alias("k")).filter(F.col("k") * QUOTA * max(inside) > LEAST_QUOTA * n).collect()}
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def done() -> pa.RecordBatch:
            (name, capacity), shard = classes[group[0]], group[1]
            quotas = {s: q for s, k in shares.items() if (q := math.ceil(QUOTA * inside[group[0]] * k / n)) > LEAST_QUOTA}
            packed = pack_shard(rows, capacity, quotas)
            cols = [[name] * len(packed), [f"{name}-{capacity}-{shard}-{p[3]}" for p in packed], [p[0] for p in packed], [p[1] for p in packed], [p[2] for p in packed]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            for c, s, *row in zip(*(b.column(x).to_pylist() for x in ("class", "shard", "doc_id", "source", "cluster", "tokens")), strict=True):
                if (c, s) != group:
                    if rows:
                        yield done()
                    group, rows = (c, s), []
                rows.append(tuple(row))
        if rows:
            yield done()

    every = spread.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(len(classes) - 1))))
    return every.repartition(int(min(shards * len(classes), MAX_TASKS)), "class", "shard").sortWithinPartitions("class", "shard").mapInArrow(run, schema)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """container_class, n_containers, n_tokens, unused_share."""
    sums = packed.groupBy("container_class").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("tokens").alias("n_tokens"))
    joined = sums.join(F.broadcast(containers.select("container_class", "capacity_tokens").distinct()), "container_class")
    return joined.select("container_class", "n_containers", "n_tokens", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("unused_share"))
