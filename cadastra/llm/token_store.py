"""Token-id output as a content-addressed store.

encode -> cut each id stream at content-defined places (rolling hash over the ids) -> name every chunk by its
128-bit digest -> store each distinct chunk once -> per document a recipe, the list of its chunks.

    chunks/    digest, ids (little-endian, 2 bytes where the vocabulary allows, else 4)
    recipes/   in ascending document order: row, doc_id, n_tokens, recipe = (digest 16 B, ids u32)*
    manifest/  one row per recipe file: document range, token count, Merkle root over its recipes

Reading verifies the recipes against the Merkle roots and every chunk against its digest. The checksum of a
document is put together from those of its chunks: crc32 is linear, so each chunk's value is shifted by the
bytes that follow it and the values are xor-ed, a plain aggregate. No document is ever assembled in one task.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.llm.common import BATCH_BYTES, map_texts, new_path, reread, table, worker_state
from cadastra.llm.words import pieces, texts

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: A chunk ends where the low bits of the rolling hash are 0; it has at least MIN_IDS ids and at most MAX_IDS.
MASK, MIN_IDS, MAX_IDS = np.uint32(0xFF << 20), 64, 2048
#: Words remembered since the last turn of the memo; those used since the turn before are remembered too.
MEMO_WORDS = 150_000
#: ASCII marks that may end a word, and letters that have no other form under normalisation and fold one to one.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
LETTERS = "".join(c for c in map(chr, range(256)) if LATIN.fullmatch(c))
MERKLE_BLOCK = 1024
_RECIPE = np.dtype([("digest", "V16"), ("ids", "<u4")])


def byte_letters() -> str:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves, others come after 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(odd)) for b in range(256))


class WordMemo:
    """word -> packed ids. When the young half is full it becomes the old half; words used since then move back."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.young, self.old = encoder, {}, {}

    def of(self, words: list[bytes]) -> list[bytes]:
        out = list(map(self.young.get, words))
        for k, packed in enumerate(out):
            if packed is None:
                word = words[k]
                packed = out[k] = self.old.get(word) or self.encoder.word(word)
                if len(self.young) >= MEMO_WORDS:
                    self.old, self.young = self.young, {}
                self.young[word] = packed
        return out


def gather(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat, sizes long, in the order of at, and their lengths."""
    n = sizes[at]
    source = np.repeat(((np.cumsum(sizes) - sizes)[at] - (np.cumsum(n) - n)).astype(np.int32), n)
    source += np.arange(len(source), dtype=np.int32)
    return flat[source], n


class Encoder:
    """Whole texts to ids.

    A tokenizer that drops white space encodes a text as its words one after another: the distinct words of a
    piece of text are encoded once, frequent ones are remembered, and the ids are gathered by word. Others
    encode whole texts. Where the tokenizer also folds case and keeps letters and marks apart, words are folded
    first, marks at a word's end are encoded by themselves, and Latin words, on which its normalisation and
    splitting do nothing more, go straight to its merge model. Which of these hold is tried on probes.
    """

    def __init__(self, tokenizer_json: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if max(self.tokenizer.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else np.dtype("<u4")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.end = np.array([] if end_id is None else [end_id], self.dtype)
        self.memo = WordMemo(self)
        self.table = byte_letters()
        probe = ["Ab", "c's,", "é.", "x1"]
        self.by_word = self._ids([" ".join(probe), " \n".join(probe)]) == [b"".join(self._ids(probe))] * 2
        latin, marks = ["a", "the", "ABC", "Thandble", "éÀöß", "ñandú", "zzqx", "Straße"], [MARKS.decode(), ".", ",***", "$$$", "?!"]
        self.direct = (
            self.by_word
            and self._ids([w + m for w in latin for m in marks]) == [a + b for a in self._ids(latin) for b in self._ids(marks)]
            and [self._merge(w) for w in latin] == self._ids(latin)
        )

    def _ids(self, items: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def _merge(self, word: str) -> bytes:
        spelled = word.lower()
        if not spelled.isascii():
            spelled = spelled.encode().decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def letters(self, word: bytes) -> bool:
        return self.direct and (word.isascii() and word.isalpha() or LATIN.fullmatch(word.decode()) is not None)

    def word(self, word: bytes) -> bytes:
        if not word:
            return b""
        return self._merge(word.decode()) if self.letters(word) else self._ids([word.decode()])[0]

    def _runs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        packed = self.memo.of(words.cast(pa.binary()).to_pylist())
        return np.frombuffer(b"".join(packed), self.dtype), np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype.itemsize

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for the distinct words of a piece of text."""
        if not self.direct:
            return self._runs(words)
        bare = pc.utf8_rtrim(words, MARKS.decode())
        plain = pc.match_substring_regex(bare, f"^{LATIN.pattern}$")
        stems = pc.if_else(plain, bare, words).dictionary_encode()
        marks = pc.if_else(plain, pc.utf8_ltrim(words, LETTERS), "").dictionary_encode()
        (a, n), (b, m) = self._runs(stems.dictionary), self._runs(marks.dictionary)
        both = np.stack([stems.indices.to_numpy(), marks.indices.to_numpy() + len(n)], 1)
        flat, sizes = gather(np.concatenate([a, b]), np.concatenate([n, m]), both.ravel())
        return flat, sizes.reshape(-1, 2).sum(1)

    def encode(self, raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, the end after each, and where each text begins and the last ends."""
        if not self.by_word:
            each = [np.frombuffer(x, self.dtype) for x in self._ids([(raw or b"").decode() for raw in raws])]
            bounds = np.cumsum([0, *(len(x) + len(self.end) for x in each)])
            return np.concatenate([y for x in each for y in (x, self.end)] or [self.end[:0]]), bounds
        # special tokens are found before case is folded
        folded = [(raw.lower() if self.direct and b"<|" not in raw else raw) if raw else b"" for raw in raws]
        split = pc.ascii_split_whitespace(pa.array(folded, pa.binary()).cast(pa.string()))
        words, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy()[1:]
        flat, sizes = self.distinct(words.dictionary)
        flat, sizes = np.concatenate([flat, self.end]), np.append(sizes, len(self.end))
        at = np.insert(words.indices.to_numpy(), ends, len(sizes) - 1)
        ids, n = gather(flat, sizes, at)
        return ids, np.concatenate([[0], np.cumsum(n)[ends + np.arange(len(raws))]])


@lru_cache(1)
def _gear(seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 1 << 16, np.uint32)


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """Gear hash of the last 32 ids at every position."""
    h = _gear()[ids & 0xFFFF]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if len(h) > k else h[k:]
    return h


def cut_points(ids: np.ndarray, bounds: np.ndarray | None = None) -> list[list[int]] | list[int]:
    """Ends of the chunks of one document, counted from its first id; with bounds those of each of several.

    The hash at a place depends on the 32 ids up to it, and no chunk ends before MIN_IDS ids of its document:
    what stands before a document changes none of its chunks.
    """
    marked = np.flatnonzero((rolling_hash(ids) & MASK) == 0) + 1
    if bounds is None:
        return _cuts(marked.tolist(), len(ids))
    first = np.searchsorted(marked, bounds[:-1], "right").tolist()
    last = np.searchsorted(marked, bounds[1:], "right").tolist()
    marked = marked.tolist()
    return [_cuts([p - start for p in marked[a:b]], end - start) for a, b, start, end in zip(first, last, bounds.tolist(), bounds[1:].tolist())]


def _cuts(marked: list[int], n: int) -> list[int]:
    out, last = [], 0
    for p in marked:
        while p - last > MAX_IDS:
            last += MAX_IDS
            out.append(last)
        if p - last >= MIN_IDS:
            out.append(p)
            last = p
    while n - last > MAX_IDS:
        last += MAX_IDS
        out.append(last)
    if n > last:
        out.append(n)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def write_store(docs: DataFrame, path: str, tokenizer_json: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> None:
    """Write chunks/, recipes/ and manifest/ under path. Null text counts as empty; repeated rows are documents of their own.

    Recipes are in the order of order_col, else of the ids.
    """
    spark = docs.sparkSession
    schema = T.StructType(
        [
            T.StructField("key", T.BinaryType()),
            T.StructField("kind", T.StringType()),
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("payload", T.BinaryType()),
            *([T.StructField("place", docs.schema[order_col].dataType)] if order_col else []),
        ]
    )
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)

    def encode(batches):
        encoder = worker_state(("encoder", vocabulary.value, end_id), lambda: Encoder(vocabulary.value, end_id))
        task, serial, width, seen = TaskContext.get().partitionId(), 0, encoder.dtype.itemsize, set()
        for batch in batches:
            raws = texts(batch.column(1))
            for start, end in pieces(raws, BATCH_BYTES):
                keys, kinds, counts, payloads, owners = [], [], [], [], []
                ids, bounds = encoder.encode(raws[start:end])
                stream = ids.tobytes()
                for i, first, cuts in zip(range(start, end), bounds.tolist(), cut_points(ids, bounds)):
                    recipe, last = [], 0
                    for cut in cuts:
                        chunk = stream[(first + last) * width : (first + cut) * width]
                        name = digest(chunk)
                        recipe.append(name + struct.pack("<I", cut - last))
                        if name not in seen:  # of this task; across tasks the shuffle below decides
                            seen.add(name)
                            keys.append(b"c" + name)
                            kinds.append("chunk")
                            counts.append(cut - last)
                            payloads.append(chunk)
                            owners.append(None)
                        last = cut
                    keys.append(struct.pack(">cIQ", b"r", task, serial))
                    serial += 1
                    kinds.append("recipe")
                    counts.append(last)
                    payloads.append(b"".join(recipe))
                    owners.append(i)
                owned = pa.array(owners, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(kinds), batch.column(0).take(owned), pa.array(counts, pa.int64()), pa.array(payloads, pa.binary())]
                    + [c.take(owned) for c in batch.columns[2:]],
                    names=schema.names,
                )

    place = ["place"] if order_col else []
    rows = docs.select(id_col, text_col, *[F.col(order_col).alias(c) for c in place])
    rows = map_texts(rows, encode, schema)
    first = lambda c: F.first(c).alias(c)
    unique = rows.repartition("key").groupBy("key").agg(first("kind"), first("doc_id"), first("n_tokens"), first("payload"), *map(first, place))
    unique.write.partitionBy("kind").parquet(f"{path}/encoded")
    both = spark.read.schema(schema).parquet(f"{path}/encoded")
    recipes = both.where("kind = 'recipe'").select("doc_id", "n_tokens", F.col("payload").alias("recipe"), *place)
    recipes = recipes.orderBy(*place, F.col("doc_id").asc_nulls_first(), "recipe").drop(*place).withColumn("row", F.monotonically_increasing_id())
    recipes.write.parquet(f"{path}/recipes")
    roots = merkle(read_recipes(spark, path, docs.schema[id_col].dataType))
    roots.write.parquet(f"{path}/manifest")


def read_recipes(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("recipe", T.BinaryType()), T.StructField("row", T.LongType())])
    return reread(spark, f"{path}/recipes", schema).withColumn("part", F.shiftright("row", 33)).withColumn("pos", F.col("row").bitwiseAND((1 << 33) - 1))


def merkle(recipes: DataFrame) -> DataFrame:
    """part -> documents, tokens, root. Leaves hash recipes, blocks hash MERKLE_BLOCK leaves, the root hashes the part's blocks."""
    leaf = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("n_tokens").cast("string"), F.lit("|"), F.hex("recipe")), 256)
    together = lambda c, by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), ""), 256)
    block = F.floor(F.col("pos") / MERKLE_BLOCK).alias("block")
    blocks = recipes.withColumn("leaf", leaf).groupBy("part", block).agg(together("leaf", "pos").alias("node"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    return blocks.groupBy("part").agg(F.sum("n").alias("documents"), F.sum("t").alias("tokens"), together("node", "block").alias("root"))


_POLY = 0xEDB88320


@lru_cache(1)
def _shift_tables() -> list[np.ndarray]:
    """For each bit k of a byte count: tables that advance a crc32 by 2**k zero bytes, by byte of the value."""

    def times(m: list[int], v: int) -> int:
        out = i = 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    m = [_POLY, *(1 << n for n in range(31))]  # one zero bit
    out = []
    for k in range(3 + 48):
        if k >= 3:
            out.append(np.array([[times(m, b << (8 * j)) for b in range(256)] for j in range(4)], np.uint32))
        m = [times(m, x) for x in m]
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each crc32 adds to that of a longer stream, of which n_bytes follow."""
    crc, n_bytes = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k, t in enumerate(_shift_tables()):
        if not (n_bytes >> k).any():
            break
        at = np.flatnonzero((n_bytes >> k) & 1)
        v = crc[at]
        crc[at] = t[0][v & 0xFF] ^ t[1][(v >> 8) & 0xFF] ^ t[2][(v >> 16) & 0xFF] ^ t[3][v >> 24]
    return crc


def read_store(spark: SparkSession, path: str, id_type: T.DataType = T.LongType(), wide: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids), verified: all from the files.

    wide: ids take 4 bytes in the chunks. verified: the recipe file has its Merkle root, all chunks of the
    document are there with their digest, and their lengths add up.
    """
    dtype = np.dtype("<u4" if wide else "<u2")
    chunks = spark.read.schema("key binary, payload binary, kind string").parquet(f"{path}/encoded").where("kind = 'chunk'").select("key", "payload")

    def measure(batches):
        for batch in batches:
            keys, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[1:] for k in keys], pa.binary()),
                    pa.array([zlib.crc32(np.frombuffer(p, dtype).astype("<u4")) for p in payloads], pa.int64()),
                    pa.array([len(p) // dtype.itemsize for p in payloads], pa.int64()),
                    pa.array([digest(p) == k[1:] for k, p in zip(keys, payloads)], pa.bool_()),
                ],
                names=["digest", "crc", "ids", "intact"],
            )

    measured = chunks.mapInArrow(measure, "digest binary, crc long, ids long, intact boolean")
    recipes = read_recipes(spark, path, id_type)

    def refer(batches):
        for batch in batches:
            rows, digests, after, last = [], [], [], []
            for row, recipe in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = np.frombuffer(recipe, _RECIPE)
                ends = np.cumsum(parts["ids"].astype(np.int64))
                rows += [row] * len(parts)
                digests += [recipe[i : i + 16] for i in range(0, len(recipe), 20)]
                after += (ends[-1] - ends).tolist() if len(parts) else []
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(digests, pa.binary()), pa.array(after, pa.int64())], names=["row", "digest", "after"])

    refs = recipes.select("row", "recipe").mapInArrow(refer, "row long, digest binary, after long")

    @F.pandas_udf(T.LongType())
    def shifted(crc, after):
        import pandas as pd

        return pd.Series(shift_crc(crc.to_numpy(), after.to_numpy() * 4).astype(np.int64))

    parts = refs.join(measured.hint("merge"), "digest").select("row", "ids", "intact", shifted("crc", "after").alias("part_crc"))
    sums = parts.groupBy("row").agg(F.bit_xor("part_crc").alias("ids_crc32"), F.sum("ids").alias("found"), F.bool_and("intact").alias("intact"))
    manifest = spark.read.schema("part long, documents long, tokens long, root string").parquet(f"{path}/manifest")
    now = merkle(recipes).select("part", F.col("root").alias("now"))
    files = manifest.join(now, "part", "full").withColumn("sound", F.col("root").eqNullSafe(F.col("now")))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per recipe file
    files = files.select("part", "sound", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("part").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    placed = recipes.select("row", "part", "doc_id", "n_tokens", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("offset"))
    out = placed.join(files, "part").join(sums, "row", "left")
    empty = F.col("n_tokens") == 0
    return out.select(
        "doc_id",
        (F.col("base") + F.col("offset")).alias("start"),
        "n_tokens",
        F.coalesce("ids_crc32", F.lit(0)).alias("ids_crc32"),
        F.coalesce(F.col("sound") & F.when(empty, True).otherwise(F.col("intact") & (F.col("found") == F.col("n_tokens"))), F.lit(False)).alias("verified"),
    )


def read_ids(spark: SparkSession, path: str, id_type: T.DataType = T.LongType(), wide: bool = False) -> DataFrame:
    """One row per chunk of a document, in order: row, doc_id, first (its place in the document), ids array<int>.

    A document's ids are the concatenation by first; they are not gathered here, as one document may be of any length.
    """
    dtype = np.dtype("<u4" if wide else "<u2")
    recipes = read_recipes(spark, path, id_type)
    n = (F.octet_length("recipe") / 20).cast("int")
    refs = recipes.where(n > 0).select("row", "doc_id", "recipe", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).select(
        "row", "doc_id", "k", F.expr("concat(X'63', substring(recipe, k * 20 + 1, 16))").alias("key")
    )
    chunks = spark.read.schema("key binary, payload binary, kind string").parquet(f"{path}/encoded").where("kind = 'chunk'").select("key", "payload")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def unpack(payload):
        return payload.map(lambda p: np.frombuffer(p, dtype).astype(np.int32))

    return refs.join(chunks, "key").select("row", "doc_id", "k", unpack("payload").alias("ids"))


def tokenizer_file(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_store(docs: DataFrame, tokenizer_path: str | None = None, order_col: str | None = None) -> DataFrame:
    """Write a store of docs in the shared folder and read it back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-store")
    write_store(docs, path, tokenizer_file(tokenizer_path), order_col=order_col)
    return read_store(spark, path, docs.schema["doc_id"].dataType)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the store."""
    return token_store(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_store": op2_token_store}
ORACLES: dict[str, str] = {}
