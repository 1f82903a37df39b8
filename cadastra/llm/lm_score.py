"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are runs without ASCII white space, A-Z lower-cased, and one end token per text. The model's outcomes are
the words that make up at least one in WORDS of all training tokens (MIN_COUNT of them at least), so that there are
WORDS of them at most and more the larger the corpus; the end; and one outcome for all rarer words. A context of
the two outcomes before predicts a vector, q = R[w2] C2 + R[w1] C1. Outcomes, most frequent first, are the leaves of
a tree of LEVELS levels: the first digits of an outcome's number are its node at each level. Nodes have a vector
and a bias of their own at every level, and P(w | context) is the product, down the tree, of the softmax of
q Q[node] + b[node] over the siblings; a rarer word further has its smoothed share of their outcome. So a
text's probability is normalised over all words, at a cost that grows with the LEVELS-th root of their number.

Training (numpy): every task starts from the same parameters and goes once over the training tokens of its
partition. At each level it tells the node of the data from NOISE draws of the nodes' unigram distribution,
shared by a batch. A row of parameters is averaged over the tasks by how often each has used it; blocks of
rows are summed in a tree. Scoring takes matrix products over the tokens below each node.

Word counts cover the whole training corpus. Rarer words of a document join their counts by shuffle, so that no
word goes without its count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import fold, map_texts, stage, table

#: Most words that are outcomes of their own, and the least count of one.
WORDS, MIN_COUNT = 500_000, 5
LEVELS = 3
WIDTH = 16
NOISE = 32
BATCH = 2048
RATE = 0.05
#: Tokens that a counting task holds before it emits their counts.
COUNTED = 4_000_000
#: Rows of parameters that are averaged together, and tasks whose sums meet in a step.
BLOCK, FAN = 1024, 64
#: What stands for the end in the table of counts; no word has white space.
END = b"\n"
_OTHER, _END = 0, 1
_TOP = 80
_LOWER = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def tokens(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_LOWER).split()


def split_column(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a column of texts, and where each text begins and the last ends."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.string()), "")))
    flat, bounds = parts.flatten(), parts.offsets.to_numpy()
    full = pc.not_equal(flat, "")  # white space at the ends of a text leaves empty ones
    return flat.filter(full), np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[bounds]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """token, c: of all texts, the end included."""

    def run(batches):
        held, n, ends = [], 0, 0

        def counted():
            found = pa.chunked_array(held, pa.string()).value_counts()
            words = found.field("values").cast(pa.binary())
            return pa.RecordBatch.from_arrays([words, found.field("counts").cast(pa.int64())], names=["token", "c"])

        for batch in batches:
            flat, _ = split_column(batch.column(0))
            held.append(flat)
            n, ends = n + len(flat), ends + batch.num_rows
            if n > COUNTED:
                yield counted()
                held, n = [], 0
        yield counted()
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["token", "c"])

    return map_texts(docs.select(text_col), run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")).where("c > 0")


def _order(index: np.ndarray, n: int) -> np.ndarray:
    """Places of indices below n in stable order; short integers are sorted by radix."""
    return np.argsort(index.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")


def _sums(index: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct indices, the sums of their rows, and how many these are."""
    order = _order(index, n)
    at = index[order]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[starts], np.add.reduceat(rows[order], starts, 0), np.diff(starts, append=len(at))


def _apart(x: np.ndarray) -> np.ndarray:
    """Derivative of -log sigma(x)."""
    return -1 / (1 + np.exp(np.clip(x, -30, 30)))


class LogBilinear:
    """Parameters, NCE steps and normalised scores for outcomes with these counts, most frequent first."""

    def __init__(self, counts: np.ndarray, width: int = WIDTH, levels: int = LEVELS, seed: int = 11):
        rng, n = np.random.default_rng(seed), len(counts)
        self.n, self.width, self.levels = n, width, levels
        self.branch = 2
        while self.branch**levels < n:
            self.branch += 1
        smooth = (counts + 0.5) / (counts + 0.5).sum()
        self.step_of = [self.branch ** (levels - 1 - d) for d in range(levels)]
        #: Shares of the nodes of each level.
        self.share = [np.add.reduceat(smooth, np.arange(0, n, s)) for s in self.step_of]
        self.edges = [np.cumsum(p) for p in self.share]
        self.shift = [np.log(NOISE * p).astype(np.float32) for p in self.share]
        self.R = rng.normal(0, 0.3, (n, width)).astype(np.float32)
        self.C = np.stack([np.eye(width) * 0.3, np.eye(width) * 0.7]).astype(np.float32)
        self.Q = [rng.normal(0, 0.02, (len(p), width + 1)).astype(np.float32) for p in self.share]
        for q, p in zip(self.Q, self.share):
            q[:, -1] = np.log(p)  # the bias: scores begin with the unigram shares

    def parts(self) -> dict[str, np.ndarray]:
        return {"R": self.R, "C": self.C.reshape(-1, self.width)} | {f"Q{d}": q for d, q in enumerate(self.Q)}

    def predict(self, w2: np.ndarray, w1: np.ndarray) -> np.ndarray:
        return self.R[w2] @ self.C[0] + self.R[w1] @ self.C[1]

    def step(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray, rng: np.random.Generator, state: dict, used: dict, rate: float = RATE) -> None:
        """One NCE step on a batch, with Adagrad; used: how often each row has been."""
        r2, r1 = self.R[w2], self.R[w1]
        q = np.ones((len(w), self.width + 1), np.float32)  # the last column meets the bias
        q[:, :-1] = r2 @ self.C[0] + r1 @ self.C[1]
        dq = np.zeros_like(q)
        grown = {}
        for d in range(self.levels):
            node, table, shift = w // self.step_of[d], self.Q[d], self.shift[d]
            fake = np.minimum(np.searchsorted(self.edges[d], rng.random(NOISE)), len(shift) - 1)
            real, false = table[node], table[fake]
            g_real = _apart(np.einsum("ij,ij->i", q, real) - shift[node])[:, None]
            g_false = 1 + _apart(q @ false.T - shift[fake])
            real *= g_real
            dq += real
            dq += g_false @ false
            grown[f"Q{d}"] = _sums(np.concatenate([node, fake]), np.concatenate([g_real * q, g_false.T @ q]), len(shift))
        dq = dq[:, :-1]
        grown["R"] = _sums(np.concatenate([w2, w1]), np.concatenate([dq @ self.C[0].T, dq @ self.C[1].T]), self.n)
        grown["C"] = (np.arange(2 * self.width), np.concatenate([r2.T @ dq, r1.T @ dq]), len(w))
        for name, whole in self.parts().items():
            rows, g, times = grown[name]
            if name not in state:
                state[name], used[name] = np.full(whole.shape, 0.1, np.float32), np.zeros(len(whole), np.int64)
            new = state[name][rows] + g * g
            state[name][rows] = new
            whole[rows] -= rate * g / np.sqrt(new)
            used[name][rows] += times

    def log_probs(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural log of P(w | w2 w1), normalised over all outcomes."""
        out = np.empty(len(w), np.float64)
        for at in range(0, len(w), 128 * BATCH):
            part = slice(at, at + 128 * BATCH)
            out[part] = self._log_probs(w2[part], w1[part], w[part])
        return out

    def _log_probs(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray) -> np.ndarray:
        order = _order(w // self.branch, len(self.share[-1]))
        w = w[order]
        q = np.empty((len(w), self.width + 1), np.float32)
        q[:, :-1], q[:, -1] = self.predict(w2[order], w1[order]), 1
        total, ones = np.zeros(len(w)), np.ones(self.branch, np.float32)
        for d in range(self.levels):  # tokens below one parent stand together
            node = w // self.step_of[d]
            parent = node // self.branch
            starts = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            norm, mine = np.empty(len(w), np.float32), np.empty(len(w), np.float32)
            row = np.arange(len(w))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(w)]):
                first = int(parent[a]) * self.branch
                s = q[a:b] @ self.Q[d][first : first + self.branch].T
                np.minimum(s, _TOP, out=s)  # no overflow below; scores begin under 0
                mine[a:b] = s[row[: b - a], node[a:b] - first]
                norm[a:b] = np.exp(s, out=s) @ ones[: s.shape[1]]
            total += mine - np.log(norm)
        out = np.empty(len(w))
        out[order] = total
        return out


def contexts(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outcome before each token and the one before that; the end stands before a text."""
    w1, w2 = np.full(len(codes), _END), np.full(len(codes), _END)
    w1[1:], w2[2:] = codes[:-1], codes[:-2]
    w1[bounds[:-1]] = _END
    w2[bounds[:-1]] = _END
    second = bounds[:-1] + 1
    second = second[second < bounds[1:]]
    w2[second] = _END
    return w1, w2


def coded(column: pa.Array, vocabulary: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words, where texts begin among them, outcomes of all tokens, and where texts begin among those."""
    flat, bounds = split_column(column)
    code = pc.fill_null(pc.index_in(flat, vocabulary), _OTHER - 2).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    return flat, bounds, np.insert(code, bounds[1:], _END), bounds + np.arange(len(bounds))


def train(docs: DataFrame, vocabulary: pa.Array, counts: np.ndarray, text_col: str = "text") -> LogBilinear:
    """Parameters averaged over the tasks; the start where there is nothing to train on.

    A task's draws are seeded by its number: the same partitions give the same parameters.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, counts))
    schema = "part int, name string, first int, used binary, sums binary"

    def rows(part: int, sums: dict) -> list[tuple]:
        """Blocks of rows, each with its use and the sums of what it has moved by, times its use."""
        return [(part, name, a, u[a : a + BLOCK].tobytes(), x[a : a + BLOCK].tobytes()) for name, (u, x) in sums.items() for a in range(0, len(u), BLOCK)]

    def as_batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["part", "name", "first", "used", "sums"])

    def run(batches):
        words, sizes = shared.value
        task = TaskContext.get().partitionId()
        model, state, used, rng = LogBilinear(sizes), {}, {}, np.random.default_rng(task)
        for batch in batches:
            _, _, w, bounds = coded(batch.column(0), words)
            w1, w2 = contexts(w, bounds)
            order = rng.permutation(len(w))
            for at in range(0, len(w), BATCH):
                part = order[at : at + BATCH]
                model.step(w2[part], w1[part], w[part], rng, state, used)
        if used:
            start = LogBilinear(sizes).parts()
            moved = {name: (used[name].astype(np.float32), (x - start[name]) * used[name].astype(np.float32)[:, None]) for name, x in model.parts().items()}
            for found in rows(task, moved):
                yield as_batch([found])

    def add(batches):
        """Sums of neighbouring rows of one block and group of tasks."""
        key, used, sums = None, None, None
        for batch in batches:
            for part, name, first, u, x in zip(*(c.to_pylist() for c in batch.columns)):
                u, x = np.frombuffer(u, np.float32), np.frombuffer(x, np.float32)
                if key == (part // FAN, name, first):
                    used, sums = used + u, sums + x
                    continue
                if key:
                    yield as_batch([(*key, used.tobytes(), sums.tobytes())])
                key, used, sums = (part // FAN, name, first), u, x
        if key:
            yield as_batch([(*key, used.tobytes(), sums.tobytes())])

    source = docs.select(text_col)
    found, left = map_texts(source, run, schema), source.rdd.getNumPartitions()
    while True:
        group = F.floor(F.col("part") / FAN)
        found = found.repartition("name", "first", group).sortWithinPartitions("name", "first", "part")
        found = map_texts(found, add, schema)
        left = -(-left // FAN)
        if left <= 1:
            break
    model = LogBilinear(counts)
    parts = model.parts()
    for r in found.collect():  # one row per block of parameters
        u = np.frombuffer(r["used"], np.float32)
        x = np.frombuffer(r["sums"], np.float32).reshape(len(u), -1)
        parts[r["name"]][r["first"] : r["first"] + len(u)] += x / np.maximum(u, 1)[:, None]
    return model


def score_texts(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per row of docs: id, n_tokens, n_known, train_tokens, base_score, score (log10).

    Counts and the model come from training. Null text is empty: the end alone. Repeated rows are scored each.
    Without training rows every token has the same share of the base score's smoothing; an empty docs table
    gives an empty result. Words of one count are outcomes together or not at all.
    """
    spark = docs.sparkSession
    counts = stage(word_counts(training, text_col), "word-counts")
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    frequent = (F.col("c") >= min_count) & (F.col("c") * words >= total)  # words of them at most
    is_end = F.col("token") == F.lit(END)
    chosen = counts.where(frequent & ~is_end).toArrow().sort_by([("c", "descending"), ("token", "ascending")])
    ends = counts.where(is_end).first()
    n_ends = int(ends["c"]) if ends else 0
    own = chosen["c"].to_numpy().astype(np.float64)
    inside = int(own.sum()) + n_ends
    vocabulary = chosen["token"].combine_chunks().cast(pa.string()) if len(own) else pa.array([], pa.string())
    outcomes = np.concatenate([[total - inside, n_ends], own])
    model = train(training, vocabulary, outcomes, text_col)

    base_norm = total + 0.5 * (distinct + 1)
    other_norm = total - inside + 0.5 * (distinct - len(own) - (n_ends > 0) + 1)
    # rarer words get theirs by the join
    base_log = np.concatenate([[0.0, np.log10((n_ends + 0.5) / base_norm)], np.log10((own + 0.5) / base_norm)])
    known = np.concatenate([[0, int(n_ends > 0)], np.ones(len(own), np.int64)]).astype(np.int64)
    shared = spark.sparkContext.broadcast((vocabulary, model, base_log, known))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        vocab, lbl, log, seen = shared.value
        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, words_at, w, bounds = coded(batch.column(1), vocab)
            w1, w2 = contexts(w, bounds)
            per_text = lambda x: np.add.reduceat(x, bounds[:-1])
            uids = (task << 33) + serial + np.arange(batch.num_rows)
            serial += batch.num_rows
            text_of = np.repeat(np.arange(batch.num_rows), np.diff(words_at))
            rare = np.flatnonzero(np.delete(w, bounds[1:] - 1) == _OTHER)
            zeros = np.zeros(len(rare))
            longs = lambda x: pa.array(x.astype(np.int64))
            # a text's own row has a key of its own: no word
            own_keys = pa.array([END + u.to_bytes(8, "big") for u in uids.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    longs(np.append(uids, uids[text_of[rare]])),
                    pa.concat_arrays([own_keys, flat.take(pa.array(rare)).cast(pa.binary())]),
                    pa.concat_arrays([batch.column(0), pa.nulls(len(rare), batch.column(0).type)]),
                    pa.array(np.append(per_text(log[w]), zeros)),
                    pa.array(np.append(per_text(lbl.log_probs(w2, w1, w)) / np.log(10), zeros)),
                    longs(np.append(np.diff(bounds), zeros)),
                    longs(np.append(per_text(seen[w]), zeros)),
                ],
                names=["uid", "token", "doc", "base", "score", "n_tokens", "n_known"],
            )

    rows = map_texts(docs.select(id_col, text_col), run, f"uid long, token binary, doc {id_type}, base double, score double, n_tokens long, n_known long")
    found = rows.join(counts.where(~frequent & ~is_end).hint("merge"), "token", "left")
    rare = F.col("n_tokens") == 0
    c = F.coalesce(F.col("c"), F.lit(0)) + 0.5
    found = found.select(
        "uid",
        "doc",
        "n_tokens",
        (F.col("n_known") + F.col("c").isNotNull().cast("long")).alias("n_known"),
        (F.col("base") + F.when(rare, F.log10(c / F.lit(base_norm))).otherwise(0.0)).alias("base"),
        (F.col("score") + F.when(rare, F.log10(c / F.lit(other_norm))).otherwise(0.0)).alias("score"),
    )
    # only a document's own row has its id
    out = found.groupBy("uid").agg(F.max("doc").alias(id_col), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    return out.select(id_col, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learning from those outside fold 1."""
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, docs.where(fold() != 1))
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op5_log_bilinear": op5_log_bilinear}
ORACLES: dict[str, str] = {}
