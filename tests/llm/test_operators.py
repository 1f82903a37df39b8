"""The ten operators on small fixtures, against brute force."""

import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadastra.llm import curriculum, decontaminate, exact_dedup, langid, license_scan, lm_score, near_dedup, quotes, substring_dedup, token_store
from cadastra.llm.words import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], DOCS)


def prose(rng, n, vocabulary="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()):
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "n", "s", "ed", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), ) for i, t in enumerate(base)]
    for k in range(20):
        w = base[k].split()
        w[len(w) // 2] = "changed"
        rows.append((100 + k, " ".join(w), "en", "a"))
    rows += [(200, None, None, None), (201, "", "en", "b"), (202, "...", "en", "b"), (203, base[0].upper(), "en", "c"), (204, base[0], "en", "c"), (204, base[0], "en", "c"), (205, "one two", "en", "c"), (206, "One, two!", "en", "c")]
    rows.append((207, prose(rng, 9000), "en", "a"))
    return rows


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(spark, corpus):
    got = exact_dedup.exact_dedup(frame(spark, corpus), keep="max", content=exact_dedup.ascii_lower(exact_dedup.text_or_empty())).collect()
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[lower(t)].append(i)
    want = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, *_ in corpus for g in [groups[lower(t)]])
    assert sorted(map(tuple, got)) == want
    least = exact_dedup.exact_dedup(frame(spark, corpus)).where("kept").count()
    assert least == len({t or "" for _, t, *_ in corpus})


def test_exact_dedup_collision(spark, monkeypatch):
    """Texts under one hash stay apart by their bytes."""
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00"))
    got = exact_dedup.exact_dedup(spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


def water_fill(sizes, cap=3):
    """Shares by weight, stopped at cap, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - cap * sum(sizes[s] for s in capped)
        target = {s: cap * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def test_curriculum(spark, corpus):
    got = curriculum.curriculum(frame(spark, corpus), keep=("source",)).collect()
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for _, t, _, s in corpus:
        sizes[s] += size(t)
    target, taken = water_fill(sizes), Counter()
    assert len(got) == len(corpus)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        taken[r.source] += r.taken
    assert all(target[s] - 1 < taken[s] <= target[s] + 1e-6 for s in target)
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    assert sorted(map(tuple, curriculum.curriculum(frame(spark, corpus)).collect()), key=str) == sorted((tuple(r)[:-1] for r in got), key=str)


def test_mixed_repeats_rows(spark, corpus):
    docs = frame(spark, corpus)
    plan = Counter()
    for r in curriculum.curriculum(docs).collect():
        plan[r.doc_id] += r.copies
    out = curriculum.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +plan


def test_demand_is_inverted(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[curriculum.invert_demand(F.lit(x), F.lit(a), F.lit(b)).alias(f"c{k}") for k, (x, a, b) in enumerate([(0.5, 1.0, 1.0), (0.25, 0.0, 2.0), (0.75, 2.0, 0.0)])]).first()
    assert np.allclose(list(row), [0.5, 0.5, 0.5])


def test_decontaminate(spark, corpus):
    rng = random.Random(8)
    items = [(k, prose(rng, n)) for k, n in enumerate([30, 18, 7, 60, 3])] + [(9, None), (10, "!!!")]
    planted = [(300 + k, f"{prose(rng, 40)} {t} {prose(rng, 300)}", "en", "a") for k, (_, t) in enumerate(items[:4])]
    w = items[0][1].split()
    w[15] = "changed"  # 21 of 26 shingles stay
    planted.append((400, prose(rng, 10) + " " + " ".join(w), "en", "a"))
    w[5] = "changed"
    planted.append((401, prose(rng, 10) + " " + " ".join(w), "en", "a"))
    rows = corpus + planted
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")

    def shingles(t, k):
        w = words((t or "").encode())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for j, t in items:
        k = min(5, len(words((t or "").encode())))
        q = shingles(t, k) if k else set()
        want |= {(i, j, len(q & shingles(d, k))) for i, d, *_ in rows if q and len(q & shingles(d, k)) * 10 >= 8 * len(q)}
    for block in (8_000_000, 100):
        got = {(r.doc_id, r.item_id, r.shared) for r in decontaminate.find_items(docs, bench, block_bytes=block).collect()}
        assert got == want
    assert {300, 301, 302, 303, 400} <= {i for i, *_ in want} and 401 not in {i for i, *_ in want if _[0] == 0}
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *_ in rows if i not in {x for x, *_ in want})


def test_items_in_a_long_text(spark):
    rng = random.Random(16)
    long = prose(rng, 200_000)
    w = long.split()
    items = [(k, " ".join(w[a : a + 40])) for k, a in enumerate((0, 99_000, 199_960))] + [(7, prose(rng, 40))]
    got = decontaminate.find_items(frame(spark, [(1, long, "en", "a")]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.item_id, r.containment) for r in got) == [(0, 1.0), (1, 1.0), (2, 1.0)]


def test_token_store_round_trip(spark, corpus, tmp_path):
    docs, path = frame(spark, corpus), str(tmp_path / "store")
    vocabulary = token_store.tokenizer_file()
    token_store.write_store(docs, path, vocabulary)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(vocabulary)
    order = sorted(corpus, key=lambda r: r[0])
    ids = [plain.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in order]
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    starts = itertools.accumulate([0, *map(len, ids)])
    assert [tuple(r) for r in got] == [(d[0], s, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for d, s, x in zip(order, starts, ids)]
    parts = defaultdict(list)
    for r in token_store.read_ids(spark, path).collect():
        parts[r.row].append((r.k, r.ids))
    back = [list(itertools.chain.from_iterable(x for _, x in sorted(p))) for _, p in sorted(parts.items())]
    assert back == ids


def test_token_store_finds_damage(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(frame(spark, [(1, "some words here", "en", "a"), (2, "other words", "en", "a")]), path, token_store.tokenizer_file())
    manifest = spark.read.parquet(f"{path}/manifest").withColumn("root", F.lit("0"))
    rows = manifest.collect()
    spark.createDataFrame(rows, manifest.schema).write.mode("overwrite").parquet(f"{path}/manifest")
    assert not any(r.verified for r in token_store.read_store(spark, path).collect())


def test_encoder_matches_whole_texts():
    from tokenizers import Tokenizer

    vocabulary = token_store.tokenizer_file()
    encoder, plain = token_store.Encoder(vocabulary, None), Tokenizer.from_str(vocabulary)
    assert encoder.by_word and encoder.direct
    odd = ["", " ", "İstanbul ǅ", "á b c d\x1cE", "<|endoftext|> x<|startoftext|>y", "don't we'LL 12.5", "é" * 50, "漢字 かな　z"]
    odd += ["  end,*** (see) it's' e.g. a-b -- ?! x2, é.\tÀÉ!\n", "$$$ a$$$ <b> <|x", None, "one" * 900, "x\u0301 e\u0301. ﬁne ſ ẞ"]
    rng = random.Random(5)
    odd += ["".join(rng.choices("aBé'.,!<|> \n7ß漢", k=rng.randint(0, 60))) for _ in range(300)]
    ids, bounds = encoder.encode([None if t is None else t.encode() for t in odd])
    for text, a, b in zip(odd, bounds, bounds[1:]):
        assert ids[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids
    assert [len(x) for x in encoder.encode([])] == [0, 1]


def test_crc_shift():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 99)), rng.randbytes(rng.randint(0, 5000))
        crc = np.array([zlib.crc32(a)], np.int64)
        assert int(token_store.shift_crc(crc, np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 49000, 20000).astype(np.uint16)
    cut = lambda x: {x[a:b].tobytes() for a, b in itertools.pairwise([0, *token_store.cut_points(x)])}
    moved = np.concatenate([ids[:5000], ids[:3], ids[5000:]])
    assert len(cut(ids) & cut(moved)) > 0.9 * len(cut(ids))
    sizes = np.diff([0, *token_store.cut_points(ids)])
    assert sizes.sum() == len(ids) and sizes.max() <= token_store.MAX_IDS


def phrases_by_hand(text, model):
    """Greedy longest matches, character by character."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in model:
            end += 1
        n, at = n + 1, end
    return n


def test_cross_parsing(spark):
    rng = random.Random(2)
    model = "".join(rng.choice("abcd e") for _ in range(400))
    model = langid.normalise(model)
    parser = langid.CrossParser({"x": model, "y": langid.normalise("zzzz yyy www")})
    texts = [langid.normalise("".join(rng.choice("abcd e") for _ in range(n))) for n in (1, 30, 255, 256, 257, 5000, 20000)] + [model, model + model, langid.normalise("a?zq?b" * 300), ""]
    counts, lengths, letters = parser.phrases([t.encode() for t in texts])
    assert counts[0].tolist() == [phrases_by_hand(t, model) for t in texts]
    assert lengths.tolist() == [len(t) for t in texts]


def test_cross_parsing_of_large_alphabets():
    """Every letter of a model counts, whatever their number; others are phrases by themselves."""
    rng = random.Random(4)
    letters = [chr(0x4E00 + k) for k in range(1500)]
    zh, other = ("".join(rng.choice(part) for _ in range(6000)) for part in (letters[:700], letters[600:]))
    en = langid.normalise(prose(rng, 900))
    parser = langid.CrossParser({"en": en, "zh": zh, "zz": other})
    rare = "".join(zh[a : a + 2] for a in (rng.randrange(5990) for _ in range(2000)) if min(zh[a : a + 2]) >= letters[300])
    texts = [rare, zh, zh[100:400] + "Ω" + zh[20:900], en[50:3000]]
    counts, _, _ = parser.phrases([t.encode() for t in texts])
    models = {"en": en, "zh": zh, "zz": other}
    for k, name in enumerate(parser.languages):
        assert counts[k].tolist() == [phrases_by_hand(langid.normalise(t), models[name]) for t in texts]
    assert counts[1][1] == 1 and parser.identify([t.encode() for t in texts])[0] == ["zh", "zh", "zh", "en"]


def test_language_id(spark):
    rng = random.Random(3)
    kinds = {"aa": "lo ra mi na".split(), "bb": "sch tz ur ech".split()}
    make = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(n))
    rows = [(i, make(k, rng.randint(5, 60)), k, "s") for i, k in enumerate(rng.choices(["aa", "bb"], k=120))]
    docs = frame(spark, rows + [(500, None, "aa", "s"), (501, "12 !", None, "s"), (502, "", None, None), (503, "x" * 70000, None, None)])
    got = {r.doc_id: r for r in langid.identify(docs, langid.samples(docs)).collect()}
    assert sum(got[i].lang_pred == k for i, _, k, _ in rows) >= 119
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    kept = langid.in_a_language(docs, langid.samples(docs))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - {500, 501, 502}
    assert {r.lang_pred for r in langid.identify(docs, ()).collect()} == {"und"}
    blank = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    named = {r.doc_id: r.lang for r in langid.in_a_language(blank, langid.samples(docs)).collect()}
    assert all(named[i] == (k if i % 2 == 0 else got[i].lang_pred) for i, _, k, _ in rows)
    twice = docs.unionByName(docs)
    assert [k for k, _ in langid.samples(twice)] == ["aa", "bb"]
    assert {r.doc_id for r in langid.in_a_language(docs, ()).collect()} == set(got) - {500, 501, 502}


def test_license_scan(spark):
    texts = {
        1: "x MIT\nLicense, and Apache-License MIT license",
        2: "Licensed under the Apach License, Version 2.0.",
        3: "This work is licensed under the GNU General\n Public Licence, version 3.",
        4: "Licensed under CC BY-NC 4.0.",
        5: "premit license mitlicense general public licensee",
        6: None,
        7: "filler words. " * 5000 + "Released under the MIT License.",
    }
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    places = lambda i: [(p.label, p.word) for p in got[i].places]
    labels = lambda i: [s.label for s in got[i].spans]
    assert places(1) == [("mit", 1), ("apache", 4), ("mit", 6)] and got[1].n_words == 8
    assert places(2) == [] and labels(2) == ["apache"] and got[2].spans[0].edits == 1
    assert got[2].spans[0].found == "Licensed under the Apach License, Version 2.0"
    assert places(3) == [] and labels(3) == ["gpl"]
    assert labels(4) == ["cc-by-nc"] and places(5) == [] and got[6].n_words == 0
    assert places(7) == [("mit", 10003)] and labels(7) == ["mit"]


def test_every_notice_is_found_within_its_errors():
    """Pigeonhole: no placing of the allowed edits hides a notice."""
    rng, scanner = random.Random(6), license_scan.Scanner()
    for notice, label in license_scan.NOTICES:
        errors = len(notice) // license_scan.CHARS_PER_ERROR
        for _ in range(10):
            chars = list(notice)
            for at in rng.sample(range(1, len(chars) - 1), errors):
                if chars[at] != " ":
                    chars[at] = "q"
            assert label in {s[0] for s in scanner.scan(f"zz {''.join(chars)} zz".encode())[2]}


def least_edits(notice, text):
    """Fewest edits between notice and any part of text, and that part's end (Sellers)."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        diagonal, row[0] = row[0], 0
        for k, x in enumerate(notice, 1):
            diagonal, row[k] = row[k], min(diagonal + (x != c), row[k] + 1, row[k - 1] + 1)
        best = min(best, row[-1])
    return best


def test_notices_against_edit_distance():
    """What is found has the edits it claims at most, and texts without finds are beyond the bound for all notices."""
    rng = random.Random(15)
    notices = [(n, label) for n, label in license_scan.NOTICES if len(n) < 60]
    scanner, allowed = license_scan.Scanner(notices), {n: len(n) // license_scan.CHARS_PER_ERROR for n, _ in notices}
    for _ in range(120):
        notice, label = rng.choice(notices)
        chars = list(notice)
        for _ in range(rng.randint(0, allowed[notice] + 2)):
            at = rng.randrange(len(chars))
            kind = rng.randrange(3)
            chars[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice("abcxyz")]
        text = " ".join(f"{prose(rng, 3)} {''.join(chars)} {prose(rng, 2)}".replace(".", " ").split())
        spans = scanner.scan(text.encode())[2]
        found = {s[0] for s in spans}
        near = {x for n, x in notices if least_edits(n, text) <= allowed[n]}
        assert found <= near and bool(found) == bool(near), text
        for name, _, a, b, edits, similarity in spans:
            assert min(least_edits(n, text[max(0, a - 2) : b + 2]) for n, x in notices if x == name) <= edits and 0 < similarity <= 1


def test_many_notices_take_linear_time():
    scanner = license_scan.Scanner()
    started = time.process_time()
    spans = scanner.scan(b"All rights reserved. Licensed under the Apache Licence, Version 2.0; " * 5000)[2]
    assert len(spans) == 10_000 and time.process_time() - started < 5


def test_base_columns_against_sql(spark):
    path = "/root/testdata/sf0.001"
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    got = sorted(map(tuple, license_scan.op3_license_scan(spark, path).select(*columns).collect()))
    want = duckdb.sql(
        rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM '{path}/documents.parquet'),
        p AS (SELECT * FROM (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')) v(words, label)),
        f AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d), p WHERE w[i + 1:i + len(words)] = words)
        SELECT d.doc_id, len(w)::BIGINT, count(f.i), min(f.i), max(f.i), coalesce(array_to_string(list_sort(list_distinct(list(f.label) FILTER (f.label IS NOT NULL))), ','), '')
        FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id, len(w)"""
    ).fetchall()
    assert got == sorted(want) and sum(r[2] for r in got) > 0


def test_substring_dedup(spark):
    rng = random.Random(7)
    passage = ". ".join(prose(rng, 12).replace(".", "") for _ in range(5)) + ". "
    rows = [(k, f"{prose(rng, 30)}. {passage}{prose(rng, 30)}.", "en", "a") for k in (3, 5, 8)]
    rows += [(9, prose(rng, 60), "en", "a"), (10, None, None, None), (11, passage + prose(rng, 9) + ". " + passage, "en", "b"), (3, rows[0][1], "en", "a"), (12, "One line.", "en", "a"), (13, "One line.", "en", "a")]
    got = defaultdict(list)
    for r in substring_dedup.substring_dedup(frame(spark, rows)).collect():
        got[r.doc_id].append(r)
    text = dict((r[0], r[1] or "") for r in rows)
    assert [r.clean_text for r in got[3]] == [text[3]] * 2
    for i in (5, 8):
        assert got[i][0].clean_text == text[i].replace(passage, "") and got[i][0].n_removed == 5
    assert passage.strip() not in got[11][0].clean_text
    for i in (9, 10, 12, 13):
        assert got[i][0].clean_text == text[i]


def spans_by_hand(rows, min_words):
    """(id, removed positions) by comparing every run with all others; rows: id, text."""
    held = []
    for i, text in rows:
        parts = substring_dedup.sentences((text or "").encode())
        assert b"".join(parts) == (text or "").encode()
        forms = [tuple(p.split()) for p in parts]
        for a in range(len(forms)):
            for b in range(a + 1, len(forms) + 1):
                if sum(map(len, forms[a:b])) >= min_words:
                    held.append((i, a, b, tuple(forms[a:b])))
                    break
    gone = defaultdict(set)
    for i, a, b, run in held:
        same = [(j, c) for j, c, _, other in held if other == run]
        first = min(j for j, _ in same)
        if i != first or (i, a) != min(x for x in same if x[0] == i):
            gone[i] |= set(range(a, b))
    return gone


def test_passages_cut_anywhere(spark):
    """A passage of over 50 words that begins and ends inside sentences goes, but for its edges; short repeats stay."""
    rng = random.Random(12)
    letters = "abdeilnorstu"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(1, 9)))
    text = lambda n, mark: " ".join(word() + ("" if rng.random() > mark else rng.choice([".", ",", "?\n"])) for _ in range(n))
    passages = [text(n, mark) for n, mark in ((60, 0.2), (60, 0.05), (80, 0.0), (55, 0.3))]
    common = "Home. About us. All news."
    rows = []
    for k in range(60):
        parts = [text(rng.randint(0, 40), 0.1), common if k % 3 else "", text(rng.randint(1, 30), 0.1)]
        parts.insert(rng.randint(0, 2), rng.choice(passages) if k % 2 else "")
        rows.append((k, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "one. " * 200), (103, "word " * 500), (104, "..!?\n\n  "), (105, " lead. é " + passages[0] + " ü"), (106, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = spans_by_hand(rows, substring_dedup.MIN_WORDS)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert {i: set(r.cut) for i, r in got.items() if r.cut} == {i: g for i, g in want.items() if g}
    seen, left = set(), {}
    for i, t in rows[:60]:
        for p in passages:
            if p in t:
                if p in seen:
                    left.setdefault(i, 0)
                    left[i] += len(set(p.split()) & set(got[i].clean_text.split())) / len(set(p.split()))
                seen.add(p)
        if not any(p in t for p in passages):
            assert got[i].clean_text == t
    assert len(left) > 20 and sum(left.values()) / len(left) < 0.35


def test_versions_of_one_id(spark):
    rng = random.Random(13)
    a, b = (". ".join(prose(rng, 9).replace(".", "") for _ in range(6)) + "." for _ in range(2))
    rows = [(1, a), (1, a + " " + b), (1, a), (2, b), (None, a), (None, b)]
    got = [(r.doc_id, r.clean_text) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    key = lambda r: (r[0] is None, str(r))
    assert sorted(got, key=key) == sorted([(1, a), (1, a + " " + b), (1, a), (2, ""), (None, ""), (None, "")], key=key)


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I cook rice?\nTell me please"),
        (1, 1, "assistant", "Boil it for ten minutes."),
        (1, 2, "user", "On Monday Bob wrote:\n> how do I  cook rice\nI also ask"),
        (1, 3, "assistant", "> Boil it for ten minutes.\n>> How do I cook rice?\nYes"),
        (1, 3, None, None),
        (2, 5, "user", ""),
        (2, 9, "user", "> never said before\nhm"),
        (None, None, "user", "a > b"),
    ]
    m = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = [(r.conv_id, r.turn, r.text, r.reply_to, r.linked, r.root, r.depth) for r in quotes.link_conversations(m).collect()]
    assert got == [
        (None, None, "a > b", None, False, None, None),
        (1, 0, "How do I cook rice?\nTell me please", None, False, 0, 0),
        (1, 1, "Boil it for ten minutes.", 0, False, 0, 1),
        (1, 2, "I also ask", 0, True, 0, 1),
        (1, 3, "", 1, True, 0, 2),
        (1, 3, "Yes", 1, True, 0, 2),
        (2, 5, "", None, False, 5, 0),
        (2, 9, "hm", 5, False, 5, 1),
    ]
    schema = "conv_id long, turn int, role string, text string"
    apart = spark.createDataFrame([(1, k * 3, "user", "x") for k in range(2500)], schema)
    last = quotes.link_conversations(apart).where("turn = 7497").first()
    assert (last.reply_to, last.root, last.depth) == (7494, 0, 2499)
    chain = spark.createDataFrame([(1, k, "user", f"> message number {k - 1}\nmessage number {k}") for k in range(40)], schema)
    assert [(r.turn, r.text, r.reply_to, r.root, r.depth) for r in quotes.link_conversations(chain).collect()] == [(k, f"message number {k}", k - 1 if k else None, 0, k) for k in range(40)]
    assert quotes.link_conversations(m.limit(0)).count() == 0


def test_banded_alignment():
    rng = random.Random(9)

    def table(a, b, half):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (a[i] == b[j] and abs(i - j) <= half))
        return best[-1][-1]

    for _ in range(300):
        a = [0, *(rng.randint(1, 6) for _ in range(rng.randint(0, 40))), 7]
        b = [8, *(x for x in a[1:-1] if rng.random() > 0.2), *(rng.randint(1, 6) for _ in range(rng.randint(0, 9))), 9]
        half = rng.choice([0, 2, 9, 60])
        assert near_dedup.banded_lcs(a, b, half) == table(a, b, half)


def classes_by_hand(rows):
    tokens = {i: words((t or "").encode()) for i, t, *_ in rows}
    root = {i: i for i in tokens}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(tokens), 2):
        a, b = tokens[i], tokens[j]
        if a == b or min(len(a), len(b)) >= 5 and near_dedup.similarity(a, b) >= 0.8:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in tokens}


def test_near_dedup(spark, corpus):
    rng = random.Random(10)
    chain = [corpus[1][1].split() + prose(rng, 40).split()]
    for _ in range(12):  # neighbours are alike, the ends are not
        w = list(chain[-1])
        w[rng.randrange(len(w))] = f"new{len(chain)}"
        chain.append(w)
    rows = corpus + [(500 + k, " ".join(w), "en", "a") for k, w in enumerate(chain)]
    want = classes_by_hand(rows)
    for rounds in (0, 1, 3):
        got = {r.doc_id: r for r in near_dedup.near_classes(frame(spark, rows), rounds=rounds).collect()}
        assert {i: r.class_id for i, r in got.items()} == want
    assert len({want[i] for i in range(500, 513)}) == 1 and got[204].class_size == sum(want[r[0]] == want[204] for r in rows)
    kept = near_dedup.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_near_dedup_edge_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_dedup.near_classes(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f", None, None, None), (None, None, None, None, None), (1, None, None, None, None)], DOCS)
    assert sorted((r.doc_id or 0, r.kept) for r in near_dedup.near_classes(nulls).collect()) == [(0, True), (0, True), (1, True)]


def test_lm_scores(spark, corpus):
    docs = frame(spark, corpus)
    training = docs.where(lm_score.fold() != 1)
    counts = Counter()
    for i, t, *_ in corpus:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*lm_score.tokens((t or "").encode()), lm_score.END])
    n, v = sum(counts.values()), len(counts)
    for words_, least in ((10, 1), (100_000, 1), (100_000, 3)):
        got = sorted(lm_score.score_texts(docs, training, words=words_, min_count=least).collect(), key=lambda r: r.doc_id)
        assert len(got) == len(corpus)
        own_words = sorted((w for w, c in counts.items() if c >= least and c * words_ >= n and w != lm_score.END), key=lambda w: (-counts[w], w))
        outcomes = np.array([sum(c for w, c in counts.items() if w not in {*own_words, lm_score.END}), counts[lm_score.END], *(counts[w] for w in own_words)], float)
        vocabulary = pa.array([w.decode() for w in own_words], pa.string())
        model = lm_score.train(training, vocabulary, outcomes)
        number = {w: k + 2 for k, w in enumerate(own_words)} | {lm_score.END: 1}
        rare = [counts[w] for w in counts if w not in number]
        for r, (i, t, *_) in zip(got, sorted(corpus, key=lambda r: r[0])):
            own = [*lm_score.tokens((t or "").encode()), lm_score.END]
            assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, len(own), sum(counts[w] > 0 for w in own), n)
            assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
            if len(own) > 150:
                continue
            want, before = 0.0, [1, 1]
            for w in own:
                k = number.get(w, 0)
                want += math.log10(probability(model, *before, k))
                if not k:
                    want += math.log10((counts[w] + 0.5) / (sum(rare) + 0.5 * (len(rare) + 1)))
                before = [before[1], k]
            assert math.isclose(r.score, want, rel_tol=1e-4)


def probability(model, w2, w1, w):
    """By the definition: down the tree, the share of the node among its siblings."""
    q, out = model.R[w2].astype(float) @ model.C[0] + model.R[w1].astype(float) @ model.C[1], 1.0
    for d in range(model.levels):
        node = w // model.branch ** (model.levels - 1 - d)
        first = node // model.branch * model.branch
        s = np.exp(model.Q[d][first : first + model.branch, :-1] @ q + model.Q[d][first : first + model.branch, -1])
        out *= s[node - first] / s.sum()
    return out


@pytest.mark.parametrize("n", [2, 3, 12, 50, 64, 65])
def test_lm_is_normalised_and_learns(n):
    rng = np.random.default_rng(3)
    counts = np.full(n, 100.0)
    model, state, used = lm_score.LogBilinear(counts), {}, {}
    w1 = rng.integers(0, n, 40000)
    w = np.where(rng.random(40000) < 0.9, (w1 + 1) % n, rng.integers(0, n, 40000))  # mostly the next one
    w2 = rng.integers(0, n, 40000)
    before = model.log_probs(w2, w1, w).mean()
    for at in range(0, 40000, 200):
        model.step(w2[at : at + 200], w1[at : at + 200], w[at : at + 200], rng, state, used)
    assert model.log_probs(w2, w1, w).mean() > before + (0.5 if n > 2 else 0.2)
    total = sum(np.exp(model.log_probs(np.array([1]), np.array([n - 1]), np.array([k])))[0] for k in range(n))
    assert math.isclose(total, 1, rel_tol=1e-4) and math.isclose(total, sum(probability(model, 1, n - 1, k) for k in range(n)), rel_tol=1e-4)
    assert all(used[k].sum() >= 40000 for k in ("R", "Q0", "Q1", "Q2"))


def test_lm_beats_single_words_on_held_out_texts(spark):
    rng = random.Random(14)
    chain = {f"w{k}": [f"w{rng.randrange(300)}" for _ in range(3)] for k in range(300)}

    def walk(n):
        out = ["w0"]
        while len(out) < n:
            out.append(rng.choice(chain[out[-1]]))
        return " ".join(out)

    docs = spark.createDataFrame([(k, walk(rng.randint(50, 400))) for k in range(1500)], "doc_id long, text string").repartition(3)
    scored = lm_score.score_texts(docs, docs.where(lm_score.fold() != 1)).where(lm_score.fold() == 1)
    row = scored.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (row.s - row.b) / row.n > 0.3  # a factor of two for every token


def test_words_of_columns():
    texts = [None, "", " a  B\tc\n", "\x0bX\x0cy\r", "É À zz q \x1c w\u00a0v\u2003u", "a"]
    flat, bounds = lm_score.split_column(pa.array(texts))
    assert [[x.encode() for x in flat[a:b].to_pylist()] for a, b in itertools.pairwise(bounds.tolist())] == [lm_score.tokens((t or "").encode()) for t in texts]


@pytest.mark.parametrize("extra", [False, True])
def test_empty_and_clashing_tables(spark, extra):
    docs = spark.createDataFrame([], DOCS) if not extra else frame(spark, [(1, "a b c", "en", "s"), (2, None, None, None)])
    for c in ("kept", "size", "score", "position", "lang_pred", "word", "label", "id", "cut"):
        docs = docs.withColumn(c, F.lit("clash"))
    n = docs.count()
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_dedup(docs).count() == n
    assert curriculum.curriculum(docs).count() == n
    assert decontaminate.decontaminated(docs, bench).count() == n and decontaminate.find_items(docs, bench).count() == 0
    assert token_store.token_store(docs).count() == n
    assert langid.identify(docs, langid.samples(docs)).count() == n
    assert license_scan.scan_licenses(docs).count() == n
    assert substring_dedup.substring_dedup(docs).count() == n
    assert near_dedup.near_classes(docs).count() == n
    assert lm_score.score_texts(docs, docs).count() == n
