"""Substring deduplication by sliding sentence spans.

Texts are cut into sentences, and a sentence of more than LONG_WORDS words into parts: after each word of a kind
(CUT_AFTER) that is at least the LEAST_WORDS-th of its part, so that the parts of a passage are soon the same
whatever stands before it. From every sentence the run of the fewest consecutive sentences that hold MIN_WORDS
words is hashed (128 bits): shorter runs repeat by chance and in boilerplate, and a repeated passage of twice that
length has whole runs inside wherever it begins. Equal hashes meet in one aggregation, which finds the first
document of each and whether there are more places; what is not first is a repeat, and the sentences it covers are
removed.

The shuffled rows hold a hash and a place, never text. Copies of a hash merge in the map-side aggregation, and
the join back to the places is between two plain exchanges, so that adaptive execution can split a hash which
a third of all documents share.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.llm.common import map_texts, stage, table
from cadastra.llm.words import mix, pieces, texts

MIN_WORDS = 25
LONG_WORDS, LEAST_WORDS = 20, 8
#: Last characters of the words after which a long sentence may be cut.
CUT_AFTER = "dlrDLR,;:"
#: A sentence with the marks and white space that end it; the pieces make up the whole text.
SENTENCE = r"[^.!?\n]*[.!?\n]+[\x20\x09-\x0D]*|[^.!?\n]+"
WORD = r"[^\x20\x09-\x0D]+"
_SENTENCE, _SPACED = re.compile(SENTENCE.encode()), re.compile(rb"[\x20\x09-\x0D]*" + WORD.encode() + rb"[\x20\x09-\x0D]*")
_CUT_AFTER = frozenset(CUT_AFTER.encode())
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def sentences(raw: bytes) -> list[bytes]:
    """Sentences and parts of long ones; together they are the text."""
    out = []
    for s in _SENTENCE.findall(raw):
        if len(s) <= 2 * LONG_WORDS or len(s.split()) <= LONG_WORDS:
            out.append(s)
            continue
        start = at = n = 0
        for w in _SPACED.findall(s):
            n, at = n + 1, at + len(w)
            if n >= LEAST_WORDS and w.split()[0][-1] in _CUT_AFTER:
                out.append(s[start:at])
                start, n = at, 0
        if start < len(s):
            out.append(s[start:])
    return out


def runs(raws: list[bytes | None], min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """Of all runs: text, pos (first sentence), n (sentences), h1, h2 (128 bits of hash), again (a repeat inside its text)."""
    forms, sizes, bounds = [], [], [0]
    for raw in raws:
        for s in sentences(raw or b""):
            w = s.split()
            forms.append(xxhash.xxh3_128_digest(b" ".join(w)))
            sizes.append(len(w))
        bounds.append(len(forms))
    own, bounds = np.frombuffer(b"".join(forms), np.uint64).reshape(-1, 2), np.array(bounds)
    upto = np.append(0, np.cumsum(sizes)).astype(np.int64)
    start = np.arange(len(forms))
    text = np.repeat(np.arange(len(raws)), np.diff(bounds))
    end = np.searchsorted(upto, upto[:-1] + min_words)
    fits = end <= bounds[text + 1]
    start, text, end = start[fits], text[fits], end[fits]
    n = (end - start).astype(np.uint64)
    # a window's polynomial is a difference of prefix sums, moved to the window's first sentence
    back, forth = (np.cumprod(np.full(len(forms), b, np.uint64)) for b in (_INVERSE, _BASE))
    h = []
    for k in (0, 1):
        prefix = np.append(np.uint64(0), np.cumsum(own[:, k] * back))
        h.append(mix((prefix[end] - prefix[start]) * forth[start] + n))
    order = np.lexsort((start, h[1], h[0], text))
    again = np.zeros(len(start), bool)
    a, b = order[1:], order[:-1]
    again[a] = (text[a] == text[b]) & (h[0][a] == h[0][b]) & (h[1][a] == h[1][b])
    return text, start - bounds[text], end - start, h[0].view(np.int64), h[1].view(np.int64), again


def places(docs: DataFrame, id_col: str, text_col: str, min_words: int, whole: bool) -> DataFrame:
    """One row per run: h1, h2, id, again; whole: with version (of the text under its id), pos and n."""
    names = ["h1", "h2", "id", "again"] + (["version", "pos", "n"] if whole else [])
    kinds = [T.LongType(), T.LongType(), docs.schema[id_col].dataType, T.BooleanType(), T.IntegerType(), T.IntegerType(), T.IntegerType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches):
        for batch in batches:
            raws = texts(batch.column(1))
            for start, end in pieces(raws):
                text, pos, n, h1, h2, again = runs(raws[start:end], min_words)
                own = pa.array(text + start)
                columns = [pa.array(h1), pa.array(h2), batch.column(0).take(own), pa.array(again)]
                if whole:
                    columns += [batch.column(2).take(own), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_texts(versions(docs, id_col, text_col).select("id", "text", *(["version"] if whole else [])), run, schema)


def versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.hash(text).alias("version"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, version, cuts: pos and n of the runs to remove, for documents that have any."""
    first = places(docs, id_col, text_col, min_words, False).groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("places"))
    twice = stage(first.where("places > 1").select("h1", "h2", "first"), "repeated-spans")
    later = places(docs, id_col, text_col, min_words, True).join(twice.hint("merge"), ["h1", "h2"])
    later = later.where(F.col("again") | ~F.col("id").eqNullSafe(F.col("first")))
    return later.groupBy("id", "version").agg(F.collect_set(F.struct("pos", "n")).alias("cuts"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: id, n_sentences, cut (positions removed), n_removed, clean_text.

    The first occurrence of a span, by document id and position, stays; within a document a span that comes
    again is removed too. Null text counts as empty. Rows of one id are one document: they are no repeats of
    each other, whether their texts are the same or not. Rows without an id count as the last document, all
    together. Texts of fewer than min_words words have no run and stay. An empty table gives an empty result.
    """
    cuts = repeated_runs(docs, id_col, text_col, min_words)
    rows = versions(docs, id_col, text_col)
    cuts = cuts.select(F.col("id").alias("cut_id"), F.col("version").alias("cut_version"), "cuts")
    met = rows.join(cuts, (rows["version"] == cuts["cut_version"]) & rows["id"].eqNullSafe(cuts["cut_id"]), "left")
    kinds = [docs.schema[id_col].dataType, T.LongType(), T.LongType(), T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(["id", "n_sentences", "n_removed", "cut", "clean_text"], kinds)])

    def run(batches):
        for batch in batches:
            totals, cut, clean = [], [], []
            for raw, found in zip(texts(batch.column(1)), batch.column(2).to_pylist()):
                all_ = sentences(raw)
                gone = sorted({k for c in found or () for k in range(c["pos"], c["pos"] + c["n"])})
                totals.append(len(all_))
                cut.append(gone)
                if gone:
                    left = set(gone)
                    raw = b"".join(s for k, s in enumerate(all_) if k not in left)
                clean.append(raw)
            removed = pa.array([len(c) for c in cut], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), removed, pa.array(cut, pa.list_(pa.int32())), pa.array(clean, pa.binary()).cast(pa.string())], names=schema.names
            )

    out = map_texts(met.select("id", "text", "cuts"), run, schema)
    return out.select(F.col("id").alias(id_col), "n_sentences", "n_removed", "cut", "clean_text")


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the sentences of non-first repeated spans removed."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", F.array_join("cut", ",").alias("removed"), "clean_text")


SQL = rf"""
WITH s AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SENTENCE}') AS s FROM documents
), p AS (
  SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS k FROM s
), q AS (
  SELECT doc_id, k, CASE WHEN len(regexp_extract_all(t, '{WORD}')) <= {LONG_WORDS} THEN [t]
    ELSE regexp_extract_all(t, '[ 	-]*(?:{WORD}[ 	-]+){{{LEAST_WORDS - 1},}}?[^ 	-]*[{CUT_AFTER}](?:[ 	-]+|\z)|(?s:.+)') END AS parts
  FROM p
), u AS (
  SELECT doc_id, k, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM q
), w AS (
  SELECT doc_id, part, regexp_extract_all(part, '{WORD}') AS w, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS pos FROM u
), c AS (
  SELECT doc_id, pos, part, array_to_string(w, ' ') AS form, len(w) AS n, (sum(len(w)) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS upto FROM w
), f AS (SELECT doc_id, list(form ORDER BY pos) AS forms FROM c GROUP BY doc_id),
r AS (
  SELECT a.doc_id, a.pos, b.pos AS last
  FROM (SELECT doc_id, pos, (upto - n + {MIN_WORDS}) * 1000000000 AS least FROM c) a
  ASOF JOIN (SELECT doc_id, pos, upto * 1000000000 + pos AS held FROM c) b ON a.doc_id = b.doc_id AND a.least <= b.held
), l AS (
  SELECT r.doc_id, pos, last, min(r.doc_id) OVER (PARTITION BY forms[pos + 1:last + 1]) AS first,
         row_number() OVER (PARTITION BY r.doc_id, forms[pos + 1:last + 1] ORDER BY pos) AS k
  FROM r JOIN f ON r.doc_id = f.doc_id
), x AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM l WHERE doc_id <> first OR k > 1),
m AS (
  SELECT c.doc_id, count(*) AS n_sentences, count(x.pos) AS n_removed, string_agg(x.pos::VARCHAR, ',' ORDER BY x.pos) AS removed,
         string_agg(CASE WHEN x.pos IS NULL THEN part END, '' ORDER BY c.pos) AS clean_text
  FROM c LEFT JOIN x ON c.doc_id = x.doc_id AND c.pos = x.pos GROUP BY c.doc_id
)
SELECT d.doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(removed, '') AS removed, coalesce(clean_text, '') AS clean_text
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id
"""

QUERIES = {"op4_sentence_spans": op4_sentence_spans}
ORACLES = {"op4_sentence_spans": SQL}
