"""Chat formatting by quotation linking.

Quote marks at the start of lines give each line a level; lines of one level in a row are a passage. Quoted
passages, their lines and their sentences are normalised and hashed, and joined to the message of the same
conversation that first said them. The message with the most quoted words, before the quoting one, is what it
replies to; without a match that is the turn before. Threads are ordered by their first message, messages in a
thread by turn, so each message follows the one it replies to, and texts lose their quotes and attribution lines.

Main path: DataFrame functions only. A conversation is never gathered in one row or window: origins are one
aggregated row per hash, the turn before comes from windows over blocks of BLOCK_TURNS turns and one over the
blocks, and the order from a range sort. Replies to the turn before make runs, which the same windows follow to
their first message; thread roots come from pointer doubling between runs, over quotation links only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadastra.llm.common import stage, table, unstage

BLOCK_TURNS = 1000
MARKS = r"^[ \\t]*((?:>[ \\t]*)+)"
#: Marks that end a sentence, with what closes it.
SENTENCE_END = r"[.!?]+[\\p{Pe}\\p{Pf}\"]*[ \\t]+"
ATTRIBUTION = r"(?i)\\b(wrote|writes|said|schrieb|écrit|escribió)\\b.*:[ \\t]*$"


def parsed(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds lines (struct level, body), passages (struct level, body, lines), own (text without quotes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = messages.withColumn("__raw", F.split(text, r"\r?\n"))
    out = out.withColumn(
        "lines",
        F.expr(
            f"transform(__raw, l -> named_struct('level', length(regexp_replace(regexp_extract(l, '{MARKS}', 1), '[^>]', '')),"
            f" 'body', trim(regexp_replace(l, '{MARKS}', ''))))"
        ),
    )
    # an attribution line stands directly before a quote
    out = out.withColumn(
        "lines",
        F.expr(
            "filter(lines, (x, i) -> not (x.level = 0 and i + 1 < size(lines) and get(lines, i + 1).level > 0"
            f" and x.body rlike '{ATTRIBUTION}'))"
        ),
    )
    out = out.withColumn("__starts", F.expr("filter(sequence(0, size(lines) - 1), i -> size(lines) > 0 and (i = 0 or get(lines, i).level <> get(lines, i - 1).level))"))
    out = out.withColumn(
        "passages",
        F.expr(
            "transform(__starts, (s, k) -> named_struct('level', get(lines, s).level,"
            " 'lines', slice(transform(lines, x -> x.body), s + 1, coalesce(get(__starts, k + 1), size(lines)) - s)))"
        ),
    )
    own = F.expr("trim(array_join(transform(filter(lines, x -> x.level = 0), x -> x.body), '\n'))")
    return out.withColumn("own", own).drop("__raw", "__starts")


def _unit(text: str) -> str:
    normal = f"trim(regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"
    return f"transform(array({normal}), n -> named_struct('h', md5(n), 'words', if(n = '', 0, size(split(n, ' ')))))[0]"


def units(rows: DataFrame, quoted: bool) -> DataFrame:
    """conv, turn, level, kind, h, words: hashes of whole passages, of their lines and sentences (and of all a message says itself).

    Sentences are those of the passage with its lines joined, so that it does not matter where lines break.
    """
    side = "x.level > 0" if quoted else "x.level = 0"
    kind = lambda name: f"'{name}'" if quoted else "''"
    made = lambda level, name, text: f"named_struct('level', {level}, 'kind', {kind(name)}, 'u', {_unit(text)})"
    said = f"filter(passages, x -> {side})"
    whole = f"transform({said}, x -> {made('x.level', 'passage', 'array_join(x.lines, chr(10))')})"
    single = f"transform(filter(lines, x -> {side} and x.body <> ''), x -> {made('x.level', 'line', 'x.body')})"
    sentence = f"flatten(transform({said}, x -> transform(split(array_join(x.lines, ' '), '{SENTENCE_END}'), s -> {made('x.level', 'sentence', 's')})))"
    both = f"{whole}, {single}, {sentence}" + ("" if quoted else f", array({made('0', 'own', 'own')})")
    out = rows.select("conv", "turn", F.explode(F.expr(f"array_distinct(concat({both}))")).alias("x"))
    return out.select("conv", "turn", "x.level", "x.kind", "x.u.h", "x.u.words").where(F.col("words") > 0)


def quote_links(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conv, turn, origin, level, words: each quoting turn with the earlier turns that it quotes."""
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(text_col).alias("__text"))
    quoting = parsed(rows.where(F.col("__text").contains(">")), "__text")
    origins = units(parsed(rows, "__text"), False).groupBy("conv", "h").agg(F.min("turn").alias("origin"))
    found = units(quoting, True).join(origins, ["conv", "h"]).where(F.col("origin") < F.col("turn"))
    # passages, their lines and their sentences are the same words: each kind counts them once
    kinds = found.groupBy("conv", "turn", "origin", "kind").agg(F.min("level").alias("level"), F.sum("words").alias("words"))
    return kinds.groupBy("conv", "turn", "origin").agg(F.min("level").alias("level"), F.max("words").alias("words"))


def turn_before(turns: DataFrame) -> DataFrame:
    """(conv, turn) distinct -> before: the largest smaller turn of the conversation, rank: how many there are."""
    blocks = turns.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    inside = W.partitionBy("conv", "block").orderBy("turn")
    along = W.partitionBy("conv").orderBy("block")
    ends = blocks.groupBy("conv", "block").agg(F.max("turn").alias("end"), F.count(F.lit(1)).alias("n"))
    base = F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("conv", "block", F.lag("end").over(along).alias("end"), base.alias("base"))
    out = blocks.withColumn("before", F.lag("turn").over(inside)).withColumn("at", F.row_number().over(inside) - 1).join(ends, ["conv", "block"])
    return out.select("conv", "turn", F.coalesce("before", "end").alias("before"), (F.col("base") + F.col("at")).alias("rank"))


def last_up_to(rows: DataFrame, value: Column) -> DataFrame:
    """Adds `last`: the value of the latest turn of the conversation, this one or earlier, that has one."""
    blocks = rows.withColumn("__value", value).withColumn("__block", F.floor(F.col("turn") / BLOCK_TURNS))
    inside = W.partitionBy("conv", "__block").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    along = W.partitionBy("conv").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    ends = blocks.groupBy("conv", "__block").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col("turn"))).alias("__end"))
    ends = ends.select("conv", "__block", F.last("__end", True).over(along).alias("__end"))
    out = blocks.withColumn("last", F.last("__value", True).over(inside)).join(ends, ["conv", "__block"])
    return out.withColumn("last", F.coalesce("last", "__end")).drop("__value", "__block", "__end")


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of linked messages, root an earlier first message of a run -> the same with the thread's root.

    Links go to earlier turns, so there are no cycles. Each round doubles the steps taken, and a round without a
    move ends it.
    """
    now = stage(links.select("conv", "turn", "root", "depth"), "threads")
    while not now.isEmpty():
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = now.join(up.hint("merge"), ["conv", "root"], "left").select(
            "conv",
            "turn",
            F.coalesce("next", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next").isNotNull().alias("moved"),
        )
        step = stage(step, "threads")
        unstage(now)
        now = step.select("conv", "turn", "root", "depth")
        now._staged_path = step._staged_path
        if step.where("moved").isEmpty():
            break
    return now


def threads(parents: DataFrame) -> DataFrame:
    """(conv, turn, parent, linked, rank) -> conv, turn, parent, linked, root, depth over all parents.

    A message that is linked, or has no parent, starts a run; the others reply to the turn before and belong to
    the run of the latest start. Keys of the joins with roots are single turns: a long run is no hot key.
    """
    starts = F.col("linked") | F.col("parent").isNull()
    runs = last_up_to(parents, F.when(starts, F.struct("turn", "rank")))
    runs = stage(runs.select("conv", "turn", "parent", "linked", "rank", F.col("last.turn").alias("head"), (F.col("rank") - F.col("last.rank")).alias("steps")), "runs")
    heads = runs.select("conv", F.col("turn").alias("parent"), F.col("head").alias("root"), (F.col("steps") + 1).alias("depth"))
    links = runs.where("linked").select("conv", "turn", "parent").join(heads.hint("merge"), ["conv", "parent"])
    roots = thread_roots(links).withColumnRenamed("root", "__root").withColumnRenamed("depth", "__depth")
    runs = runs.join(roots.hint("merge"), ["conv", "turn"], "left")
    start = F.struct(F.coalesce("__root", "turn").alias("root"), F.coalesce("__depth", F.lit(0)).cast("long").alias("depth"))
    runs = last_up_to(runs, F.when(starts, start))
    return runs.select("conv", "turn", "parent", "linked", F.col("last.root").alias("root"), (F.col("last.depth") + F.col("steps")).alias("depth"))


def link_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message, in reply order: conv, turn, role, text without quotes, chat, n_quoted (lines), quote_depth, reply_to, linked, root, depth.

    linked tells a quotation link from the turn before. Rows that repeat a turn share its links. A message
    without a turn or conversation has no links and is its own root (null). Null texts are empty, a null role
    is `unknown`. An empty table gives an empty result.
    """
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("__text"))
    links = quote_links(messages, conv_col, turn_col, text_col)
    # what is quoted at the outermost level is what is answered; of several, the one with most words, then the latest
    best = links.groupBy("conv", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), F.col("words"), F.col("origin"))).alias("quoted_turn"))
    turns = rows.where("conv is not null and turn is not null").select("conv", "turn").distinct()
    parents = turn_before(turns).join(best, ["conv", "turn"], "left")
    parents = parents.withColumn("parent", F.coalesce("quoted_turn", "before")).withColumn("linked", F.col("quoted_turn").isNotNull())
    parents = stage(parents.select("conv", "turn", "parent", "linked", "rank"), "parents")
    placed = stage(threads(parents), "placed")
    out = parsed(rows, "__text").join(placed.hint("merge"), ["conv", "turn"], "left")
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    return out.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        F.col("own").alias("text"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("own"), F.lit("\n<|end|>\n")).alias("chat"),
        F.expr("cast(size(filter(lines, x -> x.level > 0)) as bigint)").alias("n_quoted"),
        F.expr("cast(coalesce(array_max(transform(lines, x -> x.level)), 0) as bigint)").alias("quote_depth"),
        F.col("parent").alias("reply_to"),
        F.coalesce(F.col("linked"), F.lit(False)).alias("linked"),
        "root",
        "depth",
    ).orderBy(F.col(conv_col), F.col("root"), F.col(turn_col), F.col("text"))


def op7_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of conversations."""
    return link_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {"op7_quote_links": op7_quote_links}
ORACLES: dict[str, str] = {}
