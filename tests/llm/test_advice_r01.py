
import hashlib
import random
from fractions import Fraction

import corpus_pipeline
from cadastra.llm import curriculum, license_scan, quotes
from cadastra.llm.common import stage

MESSAGES = "conv_id long, turn int, role string, text string"


def test_threads_follow_every_reply(spark):
    """An unquoted answer stays in the thread of the turn before."""
    rng, rows, want = random.Random(3), [], {}
    for conv in range(4):
        said, turns = [], sorted(rng.sample(range(6000), 300))
        for k, turn in enumerate(turns):
            parent, text = (turns[k - 1] if k else None), f"message {turn} of {conv}"
            if conv and k > 1 and rng.random() < 0.2:
                parent = rng.choice(said)
                text = f"> message {parent} of {conv}\n{text}"
            said.append(turn)
            rows.append((conv, turn, "user", text))
            root, depth = want[conv, parent][1:] if k else (turn, -1)
            want[conv, turn] = (parent, root, depth + 1)
    rows += [(9, 0, "user", "to begin with"), (9, 1, "user", "> to begin with\nsome answer"), (9, 2, "user", "no quote")]
    want |= {(9, 0): (None, 0, 0), (9, 1): (0, 0, 1), (9, 2): (1, 0, 2)}
    got = quotes.link_conversations(spark.createDataFrame(rows, MESSAGES)).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.root, r.depth) for r in got} == want
    order = [(r.conv_id, r.root, r.turn) for r in got]
    assert order == sorted(order)
    apart = spark.createDataFrame([(1, k * 3, "user", "x") for k in range(2500)], MESSAGES)
    last = quotes.link_conversations(apart).where("turn = 7497").first()
    assert (last.reply_to, last.root, last.depth) == (7494, 0, 2499)


def test_partial_and_rewrapped_quotes(spark):
    rows = [
        (1, 0, "user", "We met on Monday. The plan was to leave early, before the rain! Nobody agreed."),
        (1, 1, "assistant", "Yes. It is a fine plan\nfor all of us. Who drives?"),
        (1, 2, "user", "Something else entirely."),
        (1, 3, "assistant", "> The plan was to leave early, before the rain!\nWhy?"),
        (1, 4, "user", "> It is a fine\n> plan for all\n> of us.\nIs it?"),
        (1, 5, "assistant", "> Yes.\nReally?"),
        (1, 6, "user", "> The plan was to leave\n> early, before the rain! Nobody\n> agreed.\nI did."),
        (1, 7, "assistant", "> the plan was\nNo whole sentence."),
    ]
    got = {r.turn: (r.reply_to, r.linked) for r in quotes.link_conversations(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got == {0: (None, False), 1: (0, False), 2: (1, False), 3: (0, True), 4: (1, True), 5: (1, True), 6: (0, True), 7: (6, False)}


def mix_by_hand(rows):
    """(doc_id, text, source) -> doc_ids of the mix in training order, by a walk over every source's passes."""
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    size = lambda t: len((t or "").split())
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    left, free, target = Fraction(sum(total.values())), set(sources), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > 3 * total[s]}
        if not full:
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: Fraction(3 * total[s]) for s in full}
        left, free = left - sum(3 * total[s] for s in full), free - full
    out = []
    for k, s in enumerate(sources):
        docs = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, size(t)) for i, t, x in rows if x == s)
        start, end = curriculum.SCHEDULES[k % 3]
        at, copy = 0, 0
        while at < int(target[s]):
            for _, i, n in docs:
                if min(n, int(target[s]) - at) * 2 >= n:
                    share = min(1.0, float((at + Fraction(n, 2)) / target[s]))
                    low, high = 0.0, 1.0  # bisection on the integral of the weight
                    for _ in range(60):
                        t = (low + high) / 2
                        low, high = (t, high) if start * t + (end - start) * t * t / 2 < share * (start + end) / 2 else (low, t)
                    out.append((low, i, copy))
                at += n
                if at >= int(target[s]):
                    break
            copy += 1
    return sorted(out)


def test_each_copy_has_its_own_position(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(5, 40))), rng.choice("aaaaaabbc")) for i in range(120)]
    want = mix_by_hand(rows)
    assert max(copy for *_, copy in want) == 2
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in curriculum.mixed(docs).collect()] == [i for _, i, _ in want]
    # and the store of the pipeline keeps that order
    mix = stage(corpus_pipeline.mixing(spark, docs, ""), "mix")
    store = corpus_pipeline.tokens(spark, mix, "").collect()
    assert [r.doc_id for r in sorted(store, key=lambda r: r.start)] == [i for _, i, _ in want]
    assert all(r.verified for r in store)


def test_stacked_notices():
    scanner = license_scan.Scanner()
    good, bad, worse = (f"licensed under the apache {x} version 2 0" for x in ("license", "licence", "licenze"))
    for lines in ([bad, good], [bad, bad, good, bad], [good, bad, good], [bad, worse, "x", good, worse] * 20):
        text = "filler " + " ".join(lines) + " more filler"
        want, at = [], len("filler ")
        for line in lines:
            if line != "x":
                want.append(("apache", at, at + len(line), int(line != good)))
            at += len(line) + 1
        assert [(label, a, b, edits) for label, _, a, b, edits, _ in scanner.scan(text.encode())[2]] == want
