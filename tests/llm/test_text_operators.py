"""Corpus operators against brute force on small tables with hard rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quantloom.llm import backoff_lm, chat, jaccard_join, license_scan, mixing, sharding, suffix_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


BASE = " ".join(f"w{i}" for i in range(60))
PASSAGE = "the quick brown fox jumps over the lazy dog near an old river bank at dawn"
ROWS = [
    (0, BASE, "en", "a"),
    (1, BASE, "en", "b"),
    (2, BASE.replace("w30", "changed"), "en", "a"),
    (3, f"{BASE} {PASSAGE} tail", None, None),
    (4, f"x {PASSAGE.upper()}! and more", "fr", "a"),
    (5, None, "en", "a"),
    (6, "", None, "b"),
    (7, "one two", "en", "c"),
    (8, "ONE  two", "en", "c"),
    (9, "released under the MIT License. cc by 4.0", "de", "c"),
    (10, " ".join(["again"] * 400), "en", "a"),
    (11, "Licensed under the Apache License, Version 2.0. é ÉÀ naïve", "en", "a"),
    (11, "Licensed under the Apache License, Version 2.0. é ÉÀ naïve", "en", "a"),
    (13, " ".join(f"long{i % 997}" for i in range(20000)), "en", "a"),
    (None, BASE, "en", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with an extra column whose name the operators use themselves."""
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("n_words", F.lit("mine")).withColumn("row", F.lit(1))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def contaminated(rows, items, window=10):
    out = []
    for doc, text, *_ in rows:
        words, hit, found = WORD.findall(low(text)), set(), set()
        for item, source in items:
            own = WORD.findall(low(source))
            size = min(window, len(own))
            grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words) - size + 1) if own else ():
                if tuple(words[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return out


ITEMS = [(1, PASSAGE), (2, "lazy dog"), (10, None), (11, " !! "), (12, "again " * 30), (None, BASE), (2, "one two")]


@pytest.mark.parametrize(("block", "shard"), [(1 << 20, 1 << 20), (40, 64)])
def test_contamination_equals_brute_force(spark, docs, block, shard):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = suffix_decontamination.marked(docs.select("doc_id", "text"), bench, block_bytes=block, shard_words=shard)
    got = [(r.row.doc_id, r.n_words, sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)), r["items"]) for r in got.collect()]
    want = contaminated(ROWS, [i for i in ITEMS if i[0] is not None])
    key = lambda r: (r[0] is None, r[0] or 0)
    assert [r[:3] for r in sorted(got, key=key)] == [r[:3] for r in sorted(want, key=key)]
    assert [hashlib.sha256(",".join(r[3]).encode()).hexdigest() for r in sorted(got, key=key)] == [r[4] for r in sorted(want, key=key)]


def test_contamination_columns_and_empty_tables(spark, docs, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = suffix_decontamination.contamination(docs, bench).collect()
    want = contaminated(ROWS, [i for i in ITEMS if i[0] is not None])
    assert Counter(map(tuple, rows)) == Counter(want)
    assert suffix_decontamination.contamination(none, bench).count() == 0
    nothing = suffix_decontamination.contamination(docs, bench.limit(0)).collect()
    assert len(nothing) == len(ROWS) and not any(r.contaminated for r in nothing)
    kept = suffix_decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[5] for r in want)


def test_longest_matches(spark, docs):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    got = {r.item_start: r for r in suffix_decontamination.longest_matches(docs, bench).collect()}
    assert (got[0].n_words, got[0].doc_id, got[0].doc_start) == (16, 3, 60)
    assert got[15].n_words == 1


def components(rows):
    sets = []
    for _, text, *_ in rows:
        words = TOKEN.findall(low(text))
        size = min(5, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    label = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(rows)), 2):
            linked = sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            if linked and label[i] != label[j]:
                low_ = min(x for x in (label[i], label[j]) if x is not None)
                label[i] = label[j] = low_
                changed = True
    return Counter((r[0], len(s), c) for r, s, c in zip(rows, sets, label, strict=True))


def test_jaccard_components_equal_brute_force(docs, none):
    got = jaccard_join.jaccard_components(docs).collect()
    assert Counter(map(tuple, got)) == components(ROWS)
    assert jaccard_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("small", [2, 24])
def test_jaccard_chains_and_large_groups(spark, small):
    """Copies that drift step by step: far ends link only through the middle. Small buckets and the
    probes of large ones must agree."""
    words = [f"t{i}" for i in range(80)]
    rows, text = [], list(words)
    for i in range(40):
        rows.append((100 - i, " ".join(text), "en", "a"))
        if i % 2:
            text[(i * 7) % 80] = f"new{i}"
    for i in range(30):
        own = list(words)
        own[i], own[(i * 3 + 1) % 80] = f"p{i}", f"q{i % 5}"
        rows.append((200 + i, " ".join(own), "en", "a"))
    rows += [(300 + i, " ".join(f"z{i}-{j}" for j in range(9)) + " " + " ".join(words[:12]), "en", "a") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = jaccard_join.jaccard_components(docs, small=small).collect()
    assert Counter(map(tuple, got)) == components(rows)


def test_deduplicated_keeps_one_of_each_group(docs):
    kept = jaccard_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [0, 3, 4, 5, 6, 7, 9, 10, 11, 13]


def model_scores(rows, prior):
    texts = [[*TOKEN.findall(low(r[1])), None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    count, pair, history = Counter(), Counter(), Counter()
    for words, out in zip(texts, held, strict=True):
        if not out:
            count.update(words)
            pair.update(zip(["<s>", *words[:-1]], words, strict=True))
            history.update(["<s>", *words[:-1]])
    n, v = sum(count.values()), len(count)
    p1 = lambda w: (count[w] + 0.1) / (n + 0.1 * (v + 1))
    result = []
    for row, words, out in zip(rows, texts, held, strict=True):
        base = sum(math.log10(p1(w)) for w in words)
        score = sum(
            math.log10((pair[h, w] + prior * p1(w)) / (history[h] + prior)) for h, w in zip(["<s>", *words[:-1]], words, strict=True)
        )
        result.append((row[0], out, len(words), sum(count[w] > 0 for w in words), n, round(base, 6), round(score, 6)))
    return Counter(result)


@pytest.mark.parametrize("block", [6 << 20, 2000])
def test_language_scores_equal_the_formula(docs, none, block):
    got = backoff_lm.language_scores(docs, prior=(7.0,), block_bytes=block, part_bytes=3000).collect()
    want = model_scores(ROWS, 7.0)
    assert Counter((*r[:5], round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert backoff_lm.language_scores(none).count() == 0


def test_trigram_automaton_is_a_distribution():
    """Summed over all words that can follow, probabilities of the automaton are one."""
    import numpy as np

    texts = [b"a b c a b d", b"a b c", b"b a c a", b"", None, b"d d d d"]
    grams = backoff_lm.Grams(texts, 3)
    totals = [c.astype(np.int64) for c in grams.counts(np.ones(len(texts), bool))]
    totals[0][backoff_lm.BEGIN] = len(texts)
    words = int(totals[0].sum()) - len(texts)
    distinct = int((totals[0] > 0).sum()) - 1
    model = backoff_lm.Automaton(grams, totals, words, distinct, (2.0, 0.5))
    inside = [w for w in range(grams.words) if w != backoff_lm.BEGIN]
    unknown = 10 ** np.log10(0.1 / (words + 0.1 * (distinct + 1)))
    assert sum(10 ** model.root[w] for w in inside) + unknown == pytest.approx(1)
    for history in ([], [2], [2, 3], [3, 2]):
        start = model.score(history) if history else 0.0
        mass = sum(10 ** (model.score([*history, w]) - start) for w in inside)
        assert 0.9 < mass < 1.0000001  # the rest is the unknown word's


def test_license_labels(docs, none):
    got = {r.doc_id: r for r in license_scan.license_labels(docs).collect()}
    assert (got[9].n_base, got[9].first_word, got[9].last_word, got[9].base_labels) == (2, 3, 5, "cc-by,mit")
    assert got[9].labels == "cc-by,mit,mit-notice" and got[9].score == 1.0
    assert got[11].labels == "apache,apache-notice"
    assert (got[5].n_words, got[5].first_word, got[5].labels, got[5].score) == (0, None, "", 0.0)
    assert license_scan.license_labels(none).count() == 0


def test_license_templates_want_mandatory_wording():
    mit = license_scan.Automaton("the [[big [[red]]]] {{2}} licence of {{1}} kind")
    take = lambda s: mit.accepts(s.encode().split(), 0)
    assert take("the licence of kind") and take("the big red x y licence of a kind and more")
    assert not take("the a b c licence of kind") and not take("the big licence kind") and not take("licence of kind")


def shortest(template):
    """The template's mandatory wording."""
    while "[[" in template:
        template = re.sub(r"\[\[[^\[\]]*\]\]", " ", template)
    return re.sub(r"\{\{\d+\}\}", " ", template).split()


LONG = ("mit", "isc", "apache-2.0", "gpl-or-later", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause")


@pytest.mark.parametrize("label", LONG)
def test_licences_are_wanted_to_their_last_word(label):
    by_word = license_scan.compiled(license_scan.TEMPLATES)
    own = lambda words: license_scan.scanned(" ".join(words).encode(), {}, by_word)[3] & set(LONG)
    words = shortest(license_scan.TEMPLATES[label])
    assert own(["x", *words, "y"]) == {label}
    assert not own(words[:-1]) and not own([*words[:-1], "changed"])
    last = len(words) - 12
    assert not own([*words[:last], "not", *words[last:]])


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. {more}THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""


def test_the_json_licence_is_not_mit():
    by_word = license_scan.compiled(license_scan.TEMPLATES)
    own = lambda more: license_scan.scanned(MIT.replace("{more}", more).encode(), {}, by_word)[3]
    assert own("") == {"mit"} and own("The Software shall be used for Good, not Evil. ") == set()


def test_mixture_meets_targets(spark, none):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), "en", ["a", "b", "c", None][i % 4 if i % 3 else 0]) for i in range(400)]
    rows += [(400, None, "en", "a"), (401, "", "en", "d"), (7, "x y z", "en", "a"), (None, "q", "en", "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(TOKEN.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else level * weight[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
    by_size = {sizes[s]: target[s] for s in order}
    assert len(by_size) == len(order)
    for size, goal in by_size.items():
        assert taken[size] == math.floor(goal + 1e-9)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mixed(docs.repartition(7)).collect()))
    assert mixing.mixed(none).count() == 0


def test_schedule_spreads_sources(spark):
    """In every stretch of the schedule a source has near its share of the slots."""
    targets = spark.createDataFrame([("a", 0, 900, 600.0), ("b", 1, 500, 300.0), ("c", 2, 90, 100.0)], "source string, place long, source_size long, target double")
    rows = sorted((r.slot, r.place) for r in mixing.schedule(targets, 1000, 1).collect())
    for at in range(0, 1000, 100):
        share = Counter(p for s, p in rows if at <= s < at + 100)
        assert abs(share[0] - 60) <= 4 and abs(share[1] - 30) <= 4


def test_mixed_documents_repeat_rows(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.where("text IS NULL OR text = ''").count() == 0


def test_shards_are_equal_and_slots_gapless(spark, docs, none):
    rows = [(i, "é" * (i * 37 % 900), ["en", "de", None][i % 3], f"s{i % 5}" if i % 7 else None) for i in range(600)]
    rows += [(1000 + i, "the same text", "en", "s1") for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sharding.sharded(frame, shards=8).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None
    share = sum(r.size for r in got) / 8
    assert sorted(by) == list(range(8))
    for own in by.values():
        assert abs(sum(r.size for r in own) - share) <= 1802
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert sharding.sharded(docs).count() == len(ROWS)
    assert sharding.sharded(none).count() == 0


def test_conversations_collapse_to_the_longest(spark):
    turn = lambda c, *texts: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    rows = turn(1, "a") + turn(2, "a", "b") + turn(3, "a", "b", "c") + turn(4, "a", "x") + turn(5, "a", "b", "c")
    rows += turn(6, None, "<|im_end|>") + turn(7, None) + [(None, 0, None, "z")] + turn(8, *[f"t{i}" for i in range(200)])
    rows += turn(9, *[f"t{i}" for i in range(150)]) + [(10, 0, "user", "r"), (10, 0, "user", "r")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(9))
    got = {r.conv_id: r for r in chat.rendered(frame).collect()}
    assert set(got) == {3, 4, 6, None, 8, 10}
    assert got[3].n_turns == 3 and got[8].n_turns == 200 and got[10].n_turns == 2
    assert got[4].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>"
    assert got[6].text.count("<|im_end|>") == 2
    assert chat.rendered(frame.limit(0)).count() == 0
