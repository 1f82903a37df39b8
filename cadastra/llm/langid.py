"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text answers how far the text ahead matches anything in it. The
text is parsed greedily into longest matches; the fewer phrases, the closer the language. The phrase count
is normalised to bits per character, phrases * log2(model length) / length, and the lowest wins (of equal ones
the first by name).

The models come from a bounded sample of labelled rows: per language the SAMPLE_ROWS documents of the lowest
md5 of their id, of which SAMPLE_CHARS characters in all, for the MAX_LANGUAGES languages with most labelled
rows. Only these few texts travel to the driver, and the automata built of them to the workers.

Texts are parsed whole. They are cut into lanes of LANE characters, which all languages parse in lockstep as
array operations; then each lane is parsed again from the state in which the one before it ended, up to where
it meets its first parse (greedy parses of one text soon do), until no lane's start changes. The phrases are
those of a parse from the first character to the last.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.llm.common import fold, map_texts, table
from cadastra.llm.words import pieces, texts

SAMPLE_ROWS = 64
SAMPLE_CHARS = 24_000
MAX_LANGUAGES = 200
LANE = 256
#: Characters of a lane after which most second parses have met the first one.
_MID = 48
_SPACE, _OTHER, _PAD = 0, 1, 2
#: The state without a way on: every character begins a phrase.
_DEAD = 0
UNKNOWN = "und"


def normalise(text: str) -> str:
    """Lower case, letters only, runs of anything else as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a code sequence; state 0 is the root."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def packed_steps(step: list[dict[int, int]], first: tuple[int, int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Per state an offset and a mask, and the slots: state s goes on with c if slot offset + (c & mask) names c.

    A state's block is the smallest power of two that keeps its characters apart. States and slots are numbered
    from first, (states, slots), as automata share the arrays.
    """
    offset, mask, check, to = [], [], [], []
    states, slots = first
    for go in step:
        size = 1
        while len({c & (size - 1) for c in go}) < len(go):
            size *= 2
        offset.append(slots + len(check))
        mask.append(size - 1)
        block, ends = [-1] * size, [_DEAD] * size
        for c, t in go.items():
            block[c & (size - 1)], ends[c & (size - 1)] = c, states + t
        check += block
        to += ends
    return offset, mask, check, to


class CrossParser:
    """Phrase counts of many texts against all languages."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        cleaned = {k: normalise(v)[:SAMPLE_CHARS] for k, v in samples.items()}
        known = sorted({ch for text in cleaned.values() for ch in text} - {" "})
        self.own = {" ": _SPACE} | {ch: k + 3 for k, ch in enumerate(known)}
        self.bits = np.array([math.log2(max(2, len(cleaned[k]))) for k in self.languages])
        offset, mask, check, to = [0], [0], [-1], [_DEAD]
        self.roots = np.full((len(self.languages), len(known) + 3), _DEAD, np.int32)
        for i, k in enumerate(self.languages):
            step, first = suffix_automaton([self.own[ch] for ch in cleaned[k]]), len(offset)
            for c, t in step[0].items():
                self.roots[i, c] = first + t
            for whole, part in zip((offset, mask, check, to), packed_steps(step, (first, len(check)))):
                whole += part
        self.offset, self.mask, self.check, self.to = (np.array(x, np.int32) for x in (offset, mask, check, to))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_codes"}

    @property
    def codes(self) -> np.ndarray:
        """Code of every character: its own where a model has it, else that of other letters, or of a space."""
        if "_codes" not in self.__dict__:
            codes = np.full(0x110000, _SPACE, np.int32)
            codes[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = _OTHER
            for ch, k in self.own.items():
                codes[ord(ch)] = k
            self._codes = codes
        return self._codes

    def clean(self, raw: bytes | None) -> np.ndarray:
        """The codes of normalise(text)."""
        code = self.codes[np.frombuffer((raw or b"").decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)]
        space = code == _SPACE
        keep = ~space
        keep[1:] |= ~space[:-1]
        if len(keep):
            keep[0] = not space[0]
        code = code[keep]
        return code[:-1] if len(code) and code[-1] == _SPACE else code

    def _advance(self, lanes: np.ndarray, state: np.ndarray, lang: np.ndarray, lane: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """States after the rows of lanes, and phrases begun on the way; lane: the column of each state, all in turn if None."""
        begun, width = np.zeros(len(state), np.int32), self.roots.shape[1]
        roots, row_of = self.roots.ravel(), lang * width
        for row in lanes:
            c = np.tile(row, len(self.languages)) if lane is None else row.take(lane)
            slot = self.offset.take(state) + (c & self.mask.take(state))
            on = self.check.take(slot) == c
            begun += ~on
            state = np.where(on, self.to.take(slot), roots.take(row_of + c))
        return state, begun

    def phrases(self, raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: phrases in every language, characters parsed, letters."""
        n, k = len(raws), len(self.languages)
        codes = [self.clean(raw) for raw in raws]
        lengths = np.array([len(c) for c in codes], np.int64)
        letters = np.array([len(c) - np.count_nonzero(c == _SPACE) for c in codes], np.int64)
        total = np.zeros((k, n))
        counts = -(-lengths // LANE)
        n_lanes = int(counts.sum())
        if not n_lanes or not k:
            return total, lengths, letters
        flat = np.full(n_lanes * LANE, _PAD, np.int32)
        starts = (np.cumsum(counts) - counts) * LANE
        for c, at in zip(codes, starts.tolist()):
            flat[at : at + len(c)] = c
        lanes = np.ascontiguousarray(flat.reshape(-1, LANE).T)
        owner = np.repeat(np.arange(n), counts)
        follows = np.append(owner[1:] == owner[:-1], False)  # the next lane is of the same text
        lang = np.repeat(np.arange(k, dtype=np.int32), n_lanes)
        begin = np.full(k * n_lanes, _DEAD, np.int32)
        mid, early = self._advance(lanes[:_MID], begin, lang, None)
        end, late = self._advance(lanes[_MID:], mid, lang, None)
        todo = np.arange(k * n_lanes)
        while True:
            todo = todo[follows[todo % n_lanes]] + 1
            todo = todo[begin[todo] != end[todo - 1]]
            if not len(todo):
                break
            begin[todo] = end[todo - 1]
            state, early[todo] = self._advance(lanes[:_MID], begin[todo], lang[todo], todo % n_lanes)
            apart = state != mid[todo]
            mid[todo] = state
            todo = todo[apart]
            before = end[todo]
            end[todo], late[todo] = self._advance(lanes[_MID:], mid[todo], lang[todo], todo % n_lanes)
            todo = todo[end[todo] != before]
        per_lane = (early + late).reshape(k, n_lanes) - (lanes == _PAD).sum(0)
        for i in range(k):
            total[i] = np.bincount(owner, per_lane[i], n)
        return total, lengths, letters

    def identify(self, raws: list[bytes | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and bits per character of every text."""
        best_of, scores, bits = [], [], []
        for start, end in pieces(raws, 1_000_000):
            counts, lengths, letters = self.phrases(raws[start:end])
            rates = counts * self.bits[:, None] / np.maximum(lengths, 1)
            order = np.argsort(rates, 0, kind="stable")
            for i in range(end - start):
                if not letters[i] or not self.languages:
                    best_of.append(UNKNOWN)
                    scores.append(0.0)
                    bits.append(0.0)
                    continue
                first = rates[order[0, i], i]
                second = rates[order[1, i], i] if len(self.languages) > 1 else math.inf
                best_of.append(self.languages[order[0, i]])
                scores.append(float(1 - first / second) if second > 0 else 0.0)
                bits.append(float(first))
        return best_of, scores, bits


def samples(
    labelled: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", rows: int = SAMPLE_ROWS, languages: int = MAX_LANGUAGES
) -> tuple[tuple[str, str], ...]:
    """(language, text) pairs to learn from; rows without an id, language or text are left out.

    The ids are chosen without reading texts, then only the chosen texts are read: rows * languages at most,
    each cut to SAMPLE_CHARS. Rows that repeat an id and language count once, with the first of their texts.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.select(F.col(lang_col).alias("l"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    order = W.partitionBy("l").orderBy(F.md5(F.col("i").cast("string").cast("binary")), "i")
    chosen = usable.select("l", "i").withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows)
    most = usable.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(languages)
    held = {r[0] for r in most.collect()}
    ids = sorted({r[1] for r in chosen.collect() if r[0] in held}) if held else []
    found = usable.where(F.col("i").isin(ids)).groupBy("l", "i").agg(F.min(F.substring("t", 1, SAMPLE_CHARS)).alias("t")).collect() if ids else []
    parts: dict[str, list[str]] = {}
    for lang, _, text in sorted(found, key=lambda r: (r[0], r[1])):
        if lang in held:
            parts.setdefault(lang, []).append(text)
    share = {k: max(500, SAMPLE_CHARS // len(v)) for k, v in parts.items()}
    # an equal share of every chosen text first, then what is left of them
    return tuple((k, normalise(" ".join([t[: share[k]] for t in v] + [t[share[k] :] for t in v]))[:SAMPLE_CHARS]) for k, v in sorted(parts.items()))


def identify(docs: DataFrame, models: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, bits (per character) of every row.

    score is 1 - bits / bits of the second best language. A null text or one without a letter is `und` with
    score 0, and so is every text when nothing was labelled. A text whose letters no model has takes a phrase
    a character in every language, with score 0 where the models are of one length. Repeated rows give repeated
    results; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(CrossParser(dict(models)))
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]
    )

    def run(batches):
        for batch in batches:
            lang, score, bits = shared.value.identify(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=schema.names)

    return map_texts(docs.select(id_col, text_col), run, schema)


def in_a_language(docs: DataFrame, models: tuple[tuple[str, str], ...], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that are in some language, with their own columns; `und` ones go, null texts among them.

    Where lang_col is null it becomes the language found; languages that documents came with stay. A table
    without that column keeps its columns. Without models only texts without a letter go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(CrossParser(dict(models)))
    at, label = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches):
        for batch in batches:
            raws = texts(batch.column(at))
            if not shared.value.languages:
                yield batch.filter(pa.array([bool((shared.value.clean(raw) != _SPACE).any()) for raw in raws], pa.bool_()))
                continue
            found = pa.array(shared.value.identify(raws)[0], pa.string())
            if label is not None:
                own = batch.column(label)
                batch = batch.set_column(label, batch.schema.field(label), pc.coalesce(own, found.cast(own.type)))
            yield batch.filter(pc.not_equal(found, UNKNOWN))

    return map_texts(docs, run, docs.schema)


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with models of those outside fold 0."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, samples(docs.where(fold() != 0)))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "bits")


QUERIES = {"op6_cross_parsing": op6_cross_parsing}
ORACLES: dict[str, str] = {}
