"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

A test item Q is found in a document D when D holds at least 0.8 of Q's distinct five-word shingles. Plain
MinHash compares sets of like size and loses a short item inside a long document, so the signatures are made
on the item side and depend on its size: items are partitioned by the power of two of their shingle count,
and in the partition of sizes up to u an item keeps its u - ceil(0.8 u) + 1 smallest hash values. At most
u - ceil(0.8 u) shingles of Q may be missing from D, so at least one value of the signature is among D's:
the search has no false negatives. Every candidate is verified on the words themselves.

Documents are streamed past the items and never shuffled. Items travel in blocks of at most BLOCK_BYTES of
text; a larger benchmark takes more passes, so that what is broadcast has a fixed bound.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cadastra.llm.common import map_texts, table
from cadastra.llm.words import WordHashes, pieces, shingle_hashes, texts, words

WIDTH = 5
THRESHOLD = 0.8
BLOCK_BYTES = 8_000_000
_BITS = 22


def required(n: int, threshold: float = THRESHOLD) -> int:
    """Least number of n shingles that makes up the threshold (integers, free of rounding)."""
    return -(-n * round(threshold * 1000) // 1000)


class ItemIndex:
    """Signatures of a block of items, by shingle width."""

    def __init__(self, items: list[tuple[object, bytes]], threshold: float = THRESHOLD, width: int = WIDTH):
        self.threshold = threshold
        self.items: list[tuple[object, int, frozenset, np.ndarray]] = []
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        memo = WordHashes()
        for item_id, raw in items:
            w = words(raw)
            if not w:
                continue
            k = min(width, len(w))
            hashes = shingle_hashes(memo.of(w), k)
            hashes = np.unique(hashes)
            n = len(hashes)
            upper = (1 << n.bit_length()) - 1  # of the size partition that n is in
            signature = hashes[: upper - required(upper, threshold) + 1]
            shingles = frozenset(zip(*(w[j:] for j in range(k))))
            for h in signature.tolist():
                found[k][h].append(len(self.items))
            self.items.append((item_id, k, shingles, hashes))
        self.tables = {}
        for k, by_hash in found.items():
            values = np.array(sorted(by_hash), np.uint64)
            filled = np.zeros(1 << _BITS, bool)
            filled[(values >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables[k] = (values, filled, [by_hash[h] for h in values.tolist()])

    def search(self, raws: list[bytes | None], memo: WordHashes) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of every item found in a text."""
        for start, end in pieces(raws):
            tokens, bounds = [], [0]
            for raw in raws[start:end]:
                tokens += words(raw) if raw else ()
                bounds.append(len(tokens))
            hashes = memo.of(tokens)
            edges = np.array(bounds)
            candidates = set()
            for k, (values, filled, owners) in self.tables.items():
                h = shingle_hashes(hashes, k)
                at = np.flatnonzero(filled[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
                if not len(at):
                    continue
                slot = np.minimum(np.searchsorted(values, h[at]), len(values) - 1)
                hit = values[slot] == h[at]
                at, slot = at[hit], slot[hit]
                row = np.searchsorted(edges, at, side="right") - 1
                inside = at + k <= edges[row + 1]  # a shingle doesn't reach into the next text
                for r, s in zip(row[inside].tolist(), slot[inside].tolist()):
                    candidates.update((r, q) for q in owners[s])
            places: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for r, q in sorted(candidates):
                _, k, shingles, own = self.items[q]
                first, end = bounds[r], bounds[r + 1]
                if (r, k) not in places:
                    places = {(r, k): np.unique(shingle_hashes(hashes[first:end], k), return_index=True)}
                values, at = places[r, k]
                slot = np.minimum(np.searchsorted(values, own), len(values) - 1)
                found = at[slot[values[slot] == own]] + first  # a place of each shingle of the item that may be there
                shared = len(shingles & {tuple(tokens[i : i + k]) for i in found.tolist()})
                if shared >= required(len(shingles), self.threshold):
                    yield start + r, q, shared


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of about block_bytes, one block on the driver at a time."""
    total = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n))
    for b in range(n):
        rows = items.where(F.col(text_col).isNotNull() & (block == b)).select(id_col, text_col).toArrow()
        yield list(zip(rows[id_col].to_pylist(), texts(rows[text_col])))


def find_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per item found in a document: doc id, item id, item_shingles, shared, containment.

    An item of fewer than width words is one shingle of all its words; an item without words is never found.
    Null texts hold nothing. Repeated rows give repeated results. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField(item_id, items.schema[item_id].dataType),
            T.StructField("item_shingles", T.LongType()),
            T.StructField("shared", T.LongType()),
            T.StructField("containment", T.DoubleType()),
        ]
    )
    item_type = to_arrow_type(items.schema[item_id].dataType)
    out = None
    for block in item_blocks(items, item_id, item_text, block_bytes):
        index = spark.sparkContext.broadcast(ItemIndex(block, threshold, width))

        def search(batches, index=index):
            memo, own = WordHashes(), index.value
            for batch in batches:
                found = list(own.search(texts(batch.column(1)), memo))
                rows = [r for r, _, _ in found]
                sizes = [len(own.items[q][2]) for _, q, _ in found]
                shared = [s for _, _, s in found]
                ids = pa.array([own.items[q][0] for _, q, _ in found], item_type)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), ids, pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array([s / n for s, n in zip(shared, sizes)], pa.float64())],
                    names=schema.names,
                )

        part = map_texts(docs.select(id_col, text_col), search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    spark = docs.sparkSession
    threshold, width = options.get("threshold", THRESHOLD), options.get("width", WIDTH)
    schema, at = docs.schema, docs.columns.index(text_col)
    for block in item_blocks(items, options.get("item_id", "item_id"), options.get("item_text", "text"), options.get("block_bytes", BLOCK_BYTES)):
        index = spark.sparkContext.broadcast(ItemIndex(block, threshold, width))

        def clean(batches, index=index):
            memo = WordHashes()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, _, _ in index.value.search(texts(batch.column(at)), memo):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = map_texts(docs, clean, schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items of benchmark."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), bs AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k)
), m AS (
  SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id
)
SELECT doc_id, m.item_id, n.n AS item_shingles, shared, shared::DOUBLE / n.n::DOUBLE AS containment
FROM m JOIN n ON m.item_id = n.item_id WHERE shared * 1000 >= n.n * 800
"""

QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES = {"op9_decontaminate": SQL}
