"""Near-duplicate detection by Order MinHash, verified by banded alignment.

k-mers are runs of five words, labelled with their occurrence number, so that repeats count. Each of
BANDS * ROWS hash functions samples the ELL k-mers of smallest value and hashes them in text order: two texts
agree in an entry when they share these k-mers *and* their order. ROWS entries make a band; texts that agree in
a band are candidates. A candidate pair is aligned: the longest common subsequence of the two k-mer sequences
within a diagonal band, L of n and m k-mers, gives the similarity L / (n + m - L), the Jaccard measure of an
order-keeping match. At similarity s a pair needs at most (n + m)(1 - s)/(1 + s) insertions and deletions, so
the band of that half-width loses nothing.

Texts of the same words collapse first (128-bit hash of the word sequence); from there on one representative
stands for its copies, and copies are never paired. Buckets are not expanded into pairs at once either:
members whose size leaves no possible partner in the bucket go (partner_sizes). Then every bucket compares its
members to one of them, the pivot, which is the one with the smallest share of k-mers of its own: the original
of edited copies rather than one of them. What is still in buckets of several components is joined on its
rarest shared k-mers (kmer_pairs): a pair that is similar enough must have one of them in common, so no
link is lost. Alignments take the k-mers' hashes, never the texts. Components are found by hooking to the
smallest label and pointer doubling.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.llm.common import map_texts, stage, table, unstage
from cadastra.llm.words import WordHashes, mix, pieces, shingle_hashes, texts, words

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS, ELL = 14, 2, 2
#: Rounds of pivots, and the shares of the rarest k-mers that are joined after them; the last one must be 1.
ROUNDS = 1
SHARES = (0.1, 1.0)
#: Edges and labels, and pairs to align, that a task works on where tables are small.
ROWS_PER_TASK, PAIRS_PER_TASK = 50_000, 1000
#: Rows of the alignment that share a window.
_STRIP = 256


def edit_budget(n: int, m: int, similarity: float) -> int:
    """Most insertions and deletions between sequences of n and m k-mers at that similarity."""
    return int((n + m) * (1 - similarity) / (1 + similarity) + 1e-9)


def banded_lcs(a: list, b: list, half: int) -> int:
    """Longest common subsequence of a and b over matches at most half off the diagonal.

    Bit-parallel: one row per element of b, one bit per element of a in the window, 0 where the length grows.
    The places of an element in the window are gathered once per strip of rows, so repeats cost no more.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return head + tail
    at: dict = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    found, base, v, width = 0, 0, 0, 0
    near = (1 << (2 * half + 1)) - 1
    for start in range(0, len(b), _STRIP):
        low, high = min(len(a), max(0, start - half)), min(len(a), start + _STRIP + half)
        if low > base:  # columns left of the window are final
            gone = low - base
            found += gone - ((v & ((1 << gone) - 1)).bit_count() if width >= gone else v.bit_count() + gone - width)
            v >>= gone
            width, base = max(0, width - gone), low
        if high - base > width:
            v |= ((1 << (high - base - width)) - 1) << width
            width = high - base
        full = (1 << width) - 1
        masks: dict = {}
        for j in range(start, min(len(b), start + _STRIP)):
            x = b[j]
            u = masks.get(x)
            if u is None:
                places = at.get(x, ())
                places = places[bisect_left(places, base) : bisect_left(places, high)]
                if len(places) < 32:
                    u = 0
                    for i in places:
                        u |= 1 << (i - base)
                else:
                    bits = np.zeros(width, np.uint8)
                    bits[np.array(places) - base] = 1
                    u = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
                masks[x] = u
            if u:
                shift = j - half - base  # where the diagonal band of this row begins
                u &= v & (near << shift if shift >= 0 else near >> -shift)
                if u:
                    v = ((v + u) | (v - u)) & full
    return head + tail + found + width - v.bit_count()


def kmers(tokens: list[bytes], width: int = WIDTH) -> list:
    """The sequence that is aligned; a text of fewer words is one k-mer of all of them."""
    if len(tokens) < width:
        return [tuple(tokens)] if tokens else []
    return list(zip(*(tokens[i:] for i in range(width))))


def aligned(x: list, y: list, least: float = SIMILARITY) -> float:
    """Similarity of two sequences of k-mers; 0 where their lengths rule out the least."""
    if not x or not y:
        return float(x == y)
    budget = edit_budget(len(x), len(y), least)
    if abs(len(x) - len(y)) > budget:
        return 0.0
    common = banded_lcs(x, y, budget)
    return common / (len(x) + len(y) - common)


def similarity(a: list[bytes], b: list[bytes], least: float = SIMILARITY, width: int = WIDTH) -> float:
    """Aligned similarity of two word lists."""
    names: dict = {}
    x, y = ([names.setdefault(g, len(names)) for g in kmers(w, width)] for w in (a, b))
    return aligned(x, y, least)


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, n, np.int64).astype(np.uint64)


def occurrence_labels(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """h with its occurrence number within the row mixed in."""
    key = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return h
    at = np.flatnonzero(np.isin(key, twice))
    at = at[np.argsort(key[at], kind="stable")]  # equal ones together, in text order
    place = np.arange(len(at))
    fresh = np.ones(len(at), bool)
    fresh[1:] = key[at][1:] != key[at][:-1]
    label = (place - np.maximum.accumulate(np.where(fresh, place, 0))).astype(np.uint64)
    out = h.copy()
    out[at] = np.where(label > 0, mix(h[at] + label * np.uint64(0xA24BAED4963EE407)), h[at])
    return out


def order_minhash(h: np.ndarray, starts: np.ndarray, n_entries: int, ell: int = ELL) -> np.ndarray:
    """Entries (rows, n_entries) of k-mer hashes h, of which row r has those from starts[r]; no row is empty."""
    rows = len(starts)
    sizes = np.diff(np.append(starts, len(h)))
    row = np.repeat(np.arange(rows), sizes)
    out = np.zeros((rows, n_entries), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for e, seed in enumerate(_seeds(n_entries)):
        x = mix(h ^ seed)
        y = x.copy()
        picks = []
        for k in range(ell):
            low = np.minimum.reduceat(y, starts)
            at = np.flatnonzero(y == low[row])
            r, first = np.unique(row[at], return_index=True)
            at = at[first]
            picks.append(np.where(k < sizes, at, len(h) + k))
            y[at] = top
        picked = np.sort(np.stack(picks, 1), 1)
        value = np.zeros(rows, np.uint64)
        padded = np.append(h, np.arange(1, ell + 1, dtype=np.uint64))
        for k in range(ell):
            value = mix(value + padded[picked[:, k]])
        out[:, e] = value
    return out


def band_hashes(entries: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(entries), bands), np.uint64)
    for b in range(bands):
        value = np.full(len(entries), b + 1, np.uint64)
        for r in range(rows):
            value = mix(value + entries[:, b * rows + r])
        out[:, b] = value
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, ell: int = ELL, width: int = WIDTH) -> DataFrame:
    """id, sequence (128-bit hash of the words), bands (empty for texts of fewer than width words)."""
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("sequence", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def run(batches):
        memo = WordHashes()
        for batch in batches:
            raws, ids = texts(batch.column(1)), batch.column(0)
            for start, end in pieces(raws):
                names, runs, at = [], [], []
                for i in range(start, end):
                    w = words(raws[i] or b"")
                    names.append(xxhash.xxh3_128_digest(b" ".join(w)))
                    h = shingle_hashes(memo.of(w), width)
                    if len(h):
                        runs.append(h)
                        at.append(i - start)
                lists = [[]] * (end - start)
                if runs:
                    sizes = np.array([len(h) for h in runs])
                    starts = np.cumsum(sizes) - sizes
                    h = occurrence_labels(np.repeat(np.arange(len(runs)), sizes), np.concatenate(runs))
                    found = band_hashes(order_minhash(h, starts, bands * rows, ell), bands, rows).astype(np.int64).tolist()
                    for i, f in zip(at, found):
                        lists[i] = f
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, end - start), pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=schema.names
                )

    return map_texts(docs.select(id_col, text_col), run, schema)


def lists(column: pa.ListArray) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[i:j] for i, j in zip(offsets, offsets[1:])]


def kmer_lists(docs: DataFrame, width: int) -> DataFrame:
    """id, h (labelled k-mer hashes in text order), at and plain (places of those with a label, and their hashes without it) of (id, text)."""
    long_list = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("h", long_list), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("plain", long_list)])

    def array(parts: list[np.ndarray], kind) -> pa.ListArray:
        flat = pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), flat)

    def run(batches):
        memo = WordHashes()
        for batch in batches:
            raws, ids = texts(batch.column(1)), batch.column(0)
            for start, end in pieces(raws):
                labelled, places, plain = [], [], []
                for i in range(start, end):
                    h = shingle_hashes(memo.of(words(raws[i] or b"")), width)
                    own = occurrence_labels(np.zeros(len(h), np.int64), h)
                    at = np.flatnonzero(own != h)
                    labelled.append(own)
                    places.append(at)
                    plain.append(h[at])
                yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), array(labelled, np.int64), array(places, np.int32), array(plain, np.int64)], names=schema.names)

    return map_texts(docs.select("id", "text"), run, schema)


def verify(pairs: DataFrame, listed: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of labels of which a pair of ordered_pairs, by its k-mers (listed: kmer_lists), aligns well enough.

    A few pairs, with their k-mers, are gathered into as many tasks as they need; the joins are as wide as any.
    """
    pairs = stage(pairs, "pairs")
    tasks = pairs.count() // PAIRS_PER_TASK + 1
    side = lambda name: listed.select(F.col("id").alias(name), F.struct("h", "at", "plain").alias(f"of_{name}"))
    # k-mers are sent once to a pair's first document, then to its second
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("la", "lb", "of_a", "of_b")
    if tasks * 4 < int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        both = both.repartition(tasks)

    def sequences(column: pa.StructArray) -> Iterator[list]:
        for h, at, plain in zip(*(lists(column.field(k)) for k in range(3))):
            own = h.copy()
            own[at] = plain
            yield own.tolist()

    def run(batches):
        for batch in batches:
            keep = [aligned(x, y, least) >= least for x, y in zip(sequences(batch.column(2)), sequences(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    alike = map_texts(both, run, T.StructType([T.StructField(c, pairs.schema["a"].dataType) for c in ("a", "b")]))
    return alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def partner_sizes(listed: DataFrame, least: float) -> DataFrame:
    """id, n, lo, hi, own: numbers of k-mers, that a similar text of listed can have at least and at most, that no other holds.

    Of n k-mers those that no other text holds cannot be matched; with m left, a text of k k-mers needs
    n + k <= m (1 + s) / s. That a size alone rules out most pairs of a large bucket is exact, not a cap:
    texts that share a passage, or edited copies too far from all others, have no sizes left.
    """
    alone = listed.select("id", F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    alone = alone.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    n, own = F.col("n"), F.coalesce("alone", F.lit(0))
    most = (n - own) * ((1 + least) / least) - n
    out = listed.select("id", F.size("h").alias("n")).join(alone.hint("merge"), "id", "left")
    out = out.select("id", "n", F.ceil(n * least - 1e-6).cast("long").alias("lo"), F.floor(F.least(n / least, most) + 1e-6).cast("long").alias("hi"), own.alias("own"))
    return stage(out.where("lo <= hi"), "sizes")


def size_class(n):
    return F.floor(F.log(n.cast("double")) / 0.02).cast("long")


def with_partners(open_: DataFrame) -> DataFrame:
    """Of bucket members (band, value, id, label, n, lo, hi) those whose bucket has another component's text of a fitting size.

    A bucket is summed up by size class, of which there are some hundreds at most.
    """
    classes = open_.groupBy("band", "value", size_class(F.col("n")).alias("c")).agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
    held = classes.groupBy("band", "value").agg(F.collect_list(F.struct("c", "l0", "l1")).alias("classes"))
    low, high = size_class(F.col("lo")), size_class(F.col("hi"))
    fits = F.exists("classes", lambda x: x["c"].between(low, high) & ((x["l0"] != F.col("label")) | (x["l1"] != F.col("label"))))
    return open_.join(held.hint("merge"), ["band", "value"]).where(fits).drop("classes")


def ordered_pairs(met: DataFrame) -> DataFrame:
    """a, b (a < b), and their labels la and lb, of rows id, label, p_id, p_label."""
    first = F.col("id") < F.col("p_id")
    label = lambda mine: F.when(first if mine else ~first, F.col("label")).otherwise(F.col("p_label"))
    return met.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b"), label(True).alias("la"), label(False).alias("lb")).distinct()


def kmer_pairs(open_: DataFrame, listed: DataFrame, least: float, share: float) -> DataFrame:
    """ordered_pairs of texts in open buckets, of different labels, that can have enough k-mers in common.

    Only k-mers that texts of several labels hold count. Of m such k-mers, rarest first, a text of n needs
    ceil(n least) in common with any partner: one of the first m - ceil(n least) + 1 is among them, for both sides.
    Sizes, and what can still follow the place of a common k-mer, rule out most pairs inside the join. Of the
    texts that hold a k-mer, those of its most frequent label meet the others only: a large component is not
    paired with itself. share: part of these k-mers, rarest first, that are joined; 1 finds all pairs.
    """
    texts_ = open_.groupBy("id").agg(F.min("label").alias("label"))
    rows = listed.select("id", "h").join(texts_.hint("merge"), "id")
    rows = rows.select("id", "label", F.size("h").alias("n"), F.explode("h").alias("h"))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("often"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    rows = rows.join(shared.select("h", "often").hint("merge"), "h")
    own = W.partitionBy("id")
    rows = rows.withColumn("i", F.row_number().over(own.orderBy("often", "h"))).withColumn("m", F.count(F.lit(1)).over(own))
    most = F.col("m") - F.ceil(F.col("n") * least - 1e-6) + 1
    rows = stage(rows.where(F.col("i") <= F.ceil(most * share)).drop("often"), "rare-kmers")
    held = rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c"))
    held = held.groupBy("h").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    rows = stage(rows.join(held.select("h", "main").hint("merge"), "h"), "rare-kmers")
    other = rows.where("label <> main").select("h", *[F.col(c).alias(f"p_{c}") for c in ("id", "label", "n", "m", "i")])
    apart = (F.col("label") != F.col("p_label")) & ((F.col("label") == F.col("main")) | (F.col("id") < F.col("p_id")))
    left = F.least(F.col("m") - F.col("i"), F.col("p_m") - F.col("p_i")) + 1
    enough = left >= (F.col("n") + F.col("p_n")) * (least / (1 + least)) - 1e-6
    return ordered_pairs(rows.join(other.hint("merge"), (rows["h"] == other["h"]) & apart & enough))


def components(links: DataFrame) -> DataFrame:
    """(id, label) of all linked ids, label the smallest id of the component; stages each round.

    Tasks are as many as the edges need, where that is fewer than the session's shuffle partitions.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(both.distinct(), "edges")
    tasks = edges.count() // ROWS_PER_TASK + 1
    labels = stage(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")).coalesce(tasks), "labels")
    while True:
        near = edges.join(labels.hint("merge"), edges["b"] == labels["id"]).select("a", "label").coalesce(tasks)
        near = near.groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = labels.join(near.hint("merge"), "id").coalesce(tasks).join(far.hint("merge"), "label")
        new = stage(new.select("id", F.least("label", "near", "far").alias("label"), F.col("label").alias("old")).coalesce(tasks), "labels")
        unstage(labels)
        labels = new.select("id", "label")
        labels._staged_path = new._staged_path
        if new.where("label <> old").isEmpty():
            unstage(edges)
            return labels


def relabelled(labels: DataFrame | None, step: DataFrame) -> DataFrame:
    """labels (id, label) with the components of its labels, step; labels that had no link before are ids of step alone."""
    if labels is None:
        return step
    new = labels.join(step.select(F.col("id").alias("label"), F.col("label").alias("new")).hint("merge"), "label", "left")
    fresh = step.join(labels.select("id").hint("merge"), "id", "left_anti")
    return stage(new.select("id", F.coalesce("new", "label").alias("label")).unionByName(fresh), "labels")


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    ell: int = ELL,
    width: int = WIDTH,
    rounds: int = ROUNDS,
    shares: tuple[float, ...] = SHARES,
) -> DataFrame:
    """One row per input row: id, class_id (smallest id of its class), class_size (rows), kept (id is class_id).

    A class is a connected component of texts linked by a similarity of least or more, and of texts of the
    same words. Null texts are empty; texts without words form one class. Texts of fewer than width words only
    join those of the same words. Rows with a null id are left out of classes: class_id null, kept. Rows that
    repeat an id share its class. An empty table gives an empty result.
    """
    usable = docs.where(F.col(id_col).isNotNull())
    all_rows = stage(sketches(usable, id_col, text_col, bands, rows, ell, width), "sketches")
    reps = all_rows.groupBy("sequence").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("bands").alias("bands"))
    exploded = reps.where(F.size("bands") > 0).select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "value"))
    # a bucket of one id has no candidates
    counts = exploded.groupBy("band", "value").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    members = exploded.join(counts.select("band", "value").hint("merge"), ["band", "value"])
    members = stage(members, "members")
    wanted = members.select("id").distinct()
    held = usable.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(wanted.hint("merge"), "id", "left_semi")
    listed = stage(kmer_lists(held.dropDuplicates(["id"]), width), "kmers")
    sizes = partner_sizes(listed, least)
    left = stage(with_partners(members.join(sizes.hint("merge"), "id").withColumn("label", F.col("id"))), "open")
    columns = ("id", "band", "value", "n", "lo", "hi", "own")
    fit = F.col("n").between(F.col("p_lo"), F.col("p_hi")) & F.col("p_n").between(F.col("lo"), F.col("hi"))
    labels = None
    for r in range(rounds + len(shares)):
        if labels is not None:
            open_ = left.select(*columns).join(labels.hint("merge"), "id", "left").withColumn("label", F.coalesce("label", "id"))
            # a bucket without two components of fitting sizes is done
            left = stage(with_partners(open_), "open")
        if left.isEmpty():
            break
        if r < rounds:
            # the pivot is another one each round
            turn = F.struct(F.xxhash64("id", F.lit(r)), F.col("id")) if r else F.struct(F.col("own") / F.col("n"), F.col("id"))
            other = left.groupBy("band", "value").agg(F.min_by(F.struct("id", "label", "n", "lo", "hi"), turn).alias("p"))
            other = other.select("band", "value", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("id", "label", "n", "lo", "hi")])
            pairs = ordered_pairs(left.join(other.hint("merge"), ["band", "value"]).where((F.col("label") != F.col("p_label")) & fit))
        else:
            pairs = kmer_pairs(left, listed, least, shares[r - rounds])
        links = stage(verify(pairs, listed, least), "links")
        if not links.isEmpty():
            labels = relabelled(labels, components(links))
    owner = all_rows.select("id", "sequence").join(reps.select("sequence", "rep").where("copies > 1").hint("merge"), "sequence", "left")
    owner = owner.select("id", F.coalesce("rep", "id").alias("rep"))
    if labels is None:
        classed = owner.withColumn("class_id", F.col("rep"))
    else:
        classed = owner.join(labels.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").withColumn("class_id", F.coalesce("label", "rep"))
    classed = stage(classed.select("id", "class_id"), "classes")
    sizes = classed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")).where("class_size > 1")
    sizes = stage(sizes, "class-sizes")
    out = classed.join(sizes.hint("merge"), "class_id", "left")
    out = out.select(F.col("id").alias(id_col), "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (F.col("id") == F.col("class_id")).alias("kept"))
    unknown = docs.where(F.col(id_col).isNull()).select(F.col(id_col), F.col(id_col).alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(unknown)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those of which another of the class is kept; own columns."""
    gone = near_classes(docs, id_col, text_col, **options).where("not kept").select(id_col)
    return docs.join(stage(gone, "near-gone").hint("merge"), id_col, "left_anti")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their class."""
    return near_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_order_minhash": op1_order_minhash}
ORACLES: dict[str, str] = {}
