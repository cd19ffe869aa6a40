"""Small tests of the operators over texts against brute force, with the defined cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from hornloom.llm import minhash_dedup, pfair_mixing, pii_weak, piece_sampling, quality_rules, ring_shards, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, slot int, sketch int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source), with extra columns that clash with names the operators use."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "x", "y", 7, 8) for r in rows], SCHEMA)


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
CASES = [
    (1, "the cat and the dog sat on a mat in the sun today"), (2, "the cat and the dog sat on a mat in the sun today"), (3, None), (4, ""), (5, " \n\t "), (6, "one"),
    (7, LONG), (8, "é 日本語 🙂 text with a\u00a0gap and the end of it"), (None, "a row without an id that has some words in it"), (1, "the cat and the dog sat on a mat in the sun today"), (9, "x" * 50_000),
]


# -- personal data ---------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fine(k, m[0])]


def test_pii_base_spans_equal_the_definition(spark):
    texts = [
        "mail a.b@c.example.com now", "🙂é a@b.c_d@e.f.g x@y", "1.2.3.4.5 999.1.1.1 010.0.0.255 1.2.3.4", "+1 (988) 555-2485 and +12 3", "4984250489669609 and 4984 2504 8966 9609-1",
        "+" * 50 + "1" * 30, "1" * 40_000, "a" * 40_000 + "@", "a@b" * 5_000, "9 " * 20_000, "1." * 20_000 + "1", "me@host.org, you@host.org", "@", "+1", "4242 4242 4242 4242", "ip 10.0.0.1:80",
    ]
    rows = [*CASES, *((100 + i, t) for i, t in enumerate(texts))]
    got = pii_weak.find(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        want, r = base_spans(t), by_id[i]
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest(), (i, want, r.spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in PATTERNS)
        assert {"%s:%d:%d" % s for s in want} <= set(r.spans.split(",")) | {""}


def test_pii_adds_loose_spans_and_redacts(spark):
    rows = [(i, f"please mail user{i}@mail.example.com or call +1 (555) 123-{1000 + i} thanks") for i in range(60)]
    rows += [(100 + i, f"contact me by e-mail: person{i} [at] mail [dot] com soon") for i in range(20)]
    rows += [(200, "version 1 of the item has nothing"), (201, None), (202, "")]
    by_id = {r.doc_id: r for r in pii_weak.find(docs(spark, rows)).collect()}
    assert all(by_id[100 + i].n_added == 1 and by_id[100 + i].n_email == 0 for i in range(20))
    assert by_id[200].n_added == 0
    d = docs(spark, rows)
    out = pii_weak.redact(d)
    assert out.columns == d.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[0] == "please mail <EMAIL> or call <PHONE> thanks" and text[100] == "contact me by e-mail: <EMAIL> soon"
    assert text[201] is None and text[202] == "" and text[200] == rows[-3][1]


def test_pii_rows_with_null_or_repeated_ids_are_redacted_from_their_own_text(spark):
    rows = [(i, f"contact me by e-mail: person{i} [at] mail [dot] com soon") for i in range(20)]
    rows += [(None, "mail a@b.example.com, host 10.1.2.3, card 4111 1111 1111 1111, call +1 (555) 123-1000 thanks"), (None, "contact me by e-mail: nobody [at] mail [dot] com soon"), (None, "nothing here"), (None, None)]
    rows += [(7, "a longer beginning, then x@y.example.com"), (7, "z@y.example.com first"), (7, "no address in this one, so it stays as it is")]
    out = pii_weak.redact(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([
        *((i, "contact me by e-mail: <EMAIL> soon") for i in range(20)), (None, "mail <EMAIL>, host <IP>, card <CARD>, call <PHONE> thanks"), (None, "contact me by e-mail: <EMAIL> soon"), (None, "nothing here"), (None, None),
        (7, "a longer beginning, then <EMAIL>"), (7, "<EMAIL> first"), (7, "no address in this one, so it stays as it is"),
    ])
    assert pii_weak.redact(docs(spark, [])).collect() == []


def test_pii_adds_numbers_from_failed_runs(spark):
    digit = lambda n: (10 - sum(int(c) if i % 2 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(str(n)[::-1]))) % 10
    cards = [f"{n}{digit(n)}" for n in range(411111111111111, 411111111111111 + 90 * 7, 7)]
    rows = [(i, f"some words {c} and more +1 (555) 123-{1000 + i} words") for i, c in enumerate(cards[:60])]
    rows += [(100 + i, f"code {9000000000000000 + 7 * i} ends" if digit((9000000000000000 + 7 * i) // 10) != (9000000000000000 + 7 * i) % 10 else "nothing") for i in range(40)]
    rows += [(200 + i, f"words {c} 27.65.93.{i} words") for i, c in enumerate(cards[60:80])]
    rows += [(300 + i, f"call +1 (555) 777-{2000 + i} 190.137.223.204 now") for i in range(10)]
    by_id = {r.doc_id: r for r in pii_weak.find(docs(spark, rows)).collect()}
    lost = [i for i in range(20) if digit(int(cards[60 + i] + "2")) != 7]  # the others are numbers with the address's first digits
    assert len(lost) > 10 and all((by_id[200 + i].n_card, by_id[200 + i].n_added, by_id[200 + i].spans) == (0, 1, f"ip:23:{32 + len(str(i))},card:6:22") for i in lost)
    assert all((by_id[300 + i].n_phone, by_id[300 + i].spans) == (0, "ip:23:38,phone:5:22") for i in range(10))
    assert all(by_id[100 + i].n_added == 0 for i in range(40)) and all(by_id[i].n_added == 0 and by_id[i].n_card == 1 for i in range(60))


def test_pii_empty_table(spark):
    assert pii_weak.find(docs(spark, [])).collect() == []


# -- near duplicates -------------------------------------------------------------------------------------------------


def shingles(text, width):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    n = min(width, len(w))
    return frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else frozenset()


def brute_components(rows, width, num, den):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and den * len(x & y) >= num * len(x | y):
                r, s = sorted((root(i), root(j)))
                parent[s] = r
    return {i: (len(x), root(i)) for i, x in sets if i is not None}


def near_copies(seed=5):
    r = np.random.default_rng(seed)
    words = [f"k{i}" for i in range(300)]
    rows, n = [], 0
    passage = " ".join(r.choice(words, 90))
    for size, copies in ((6, 4), (12, 5), (40, 12), (150, 30), (700, 6)):
        base = list(r.choice(words, size))
        for c in range(copies):
            t = list(base)
            for _ in range(c * size // 200 + c % 3):
                t[r.integers(len(t))] = f"z{n}_{r.integers(9)}"
            rows.append((n, " ".join(t)))
            n += 1
    for _ in range(40):  # a long shared passage, but different texts
        rows.append((n, passage + " " + " ".join(r.choice(words, int(r.integers(20, 90))))))
        n += 1
    return rows


@pytest.mark.parametrize(("width", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, num):
    rows = [*near_copies(), *((1000 + (i or 0), t) for i, t in CASES if i not in (None, 1)), (2000, CASES[0][1]), (2001, CASES[0][1].upper())]
    want = brute_components(rows, width, num, 100)
    got = minhash_dedup.near_duplicates(docs(spark, rows), width, num, 100, spread=50).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize(("width", "num"), [(3, 85), (5, 80)])
def test_links_at_the_threshold_are_found_for_sets_of_every_size(spark, width, num):
    rows = []
    for size in range(1, 200):  # pairs of equally large sets that share as few shingles as a link may
        first = [f"a{size}_{i}" for i in range(size + width - 1)]
        other = next(e for e in range(size, -1, -1) if 100 * (size - e) >= num * (size + e))
        rows += [(2 * size, " ".join(first)), (2 * size + 1, " ".join(first[: len(first) - other] + [f"b{size}_{i}" for i in range(other)]))]
    want = brute_components(rows, width, num, 100)
    assert all(want[2 * size + 1] == (size, 2 * size) for size in range(1, 200))
    got = minhash_dedup.near_duplicates(docs(spark, rows), width, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_defined_cases(spark):
    got = minhash_dedup.near_duplicates(docs(spark, CASES), 3, 85, 100).collect()
    assert len(got) == len(CASES)
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id == 2] == [(11, 1, False)]
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for r in got if r.doc_id in (3, 4, 5))
    assert [r.kept for r in got if r.doc_id is None] == [True]
    one = minhash_dedup.keep_one(docs(spark, CASES), width=3, num=85, den=100)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in one.collect()) == [(False, 0), *((True, i) for i in (1, 3, 4, 5, 6, 7, 8, 9))]
    assert minhash_dedup.near_duplicates(docs(spark, [])).collect() == []
    assert minhash_dedup.keep_one(docs(spark, [])).collect() == []


def test_rows_with_one_id_are_judged_each_by_its_own_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (6, a + " more"), (7, "more " + b), (7, c), (3, c), (4, None), (4, "")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs(spark, rows), 3, 85, 100).collect()}
    assert got == {(5, 58, 5), (6, 59, 5), (7, 59, 5), (7, 58, 3), (3, 58, 3), (4, 0, 4)}
    kept = minhash_dedup.keep_one(docs(spark, rows), width=3, num=85, den=100)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, a), (5, b), (3, c), (4, None), (4, "")], key=str)


def test_keep_one_compares_rows_without_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (None, a), (None, a + " more"), (None, b), (None, b), (None, "more " + b), (None, None), (None, ""), (9, "another text of a few words"), (2**63 - 1, "at the upper end")]
    # A row with an id stays before rows without one.
    for some, stays in ((rows, [5]), (rows[1:], [None]), (rows[3:6], [])):
        got = [(r.doc_id, r.text) for r in minhash_dedup.keep_one(docs(spark, some).repartition(3), width=3, num=85, den=100).collect()]
        assert [i for i, t in got if "a0" in (t or "")] == stays and sum("b0" in (t or "") for _, t in got) == 1
        alone = lambda pairs: sorted((i or 0, t or "") for i, t in pairs if not {"a0", "b0"} & set((t or "").split()))
        assert alone(got) == alone(some)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in minhash_dedup.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_needed_bounds_the_miss():
    from math import comb

    for k, p in ((96, 0.85), (96, 0.8), (32, 0.5)):
        m = minhash_dedup.needed(k, p)
        tail = sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(m))
        assert tail <= minhash_dedup.MISS < tail + comb(k, m) * p**m * (1 - p) ** (k - m)


# -- quality ---------------------------------------------------------------------------------------------------------


def test_quality_measures_equal_brute_force(spark):
    rows = [*CASES, (20, "a b c d e a b c d e f"), (21, "line one\nline one\n\n\nline one\n x"), (22, "a a a a a a a a a a a"), (23, "#1 *x* $$ %% && | <b>"), (24, " ".join(["so"] * 4))]
    got = defaultdict(list)
    for r in quality_rules.quality(docs(spark, rows)).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        w = WORD.findall(t or "")
        counts = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {k for j in range(len(w) - 4) if counts[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        for r in got[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
            assert not (r.base_failed and r.kept)
    assert quality_rules.quality(docs(spark, [])).collect() == []


def test_quality_plan_has_no_shuffle_and_no_python(spark):
    plan = quality_rules.quality(docs(spark, CASES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Pandas|Arrow", plan)


# -- toxicity --------------------------------------------------------------------------------------------------------


def test_fold_and_matches():
    assert toxicity.fold("Уou 1d10t, STUP!D! id\u200biot ìdiot") == "you idiot, stupid  idiot idiot"
    assert toxicity.fold(None) == "" and toxicity.fold("2024 was 100% fine") == "2024 was 100% fine"
    m = toxicity.Model({"=trash": 2.0, "^idio": 3.0}, ("trash can", "the trash can lid"), 0, 0, 0)
    a = toxicity.build(m)
    assert toxicity.matches(a, "the trash can lid and trash and idiots, mytrash videoidiot") == [("=trash", 2.0), ("^idio", 3.0)]
    assert toxicity.matches(toxicity.build(toxicity.Model({}, (), 0, 0, 0)), "x") == []


def test_toxicity_learns_and_holds_out(spark):
    r = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        t = list(r.choice(plain, 40))
        if toxic := int(i % 6 == 0):
            t[5] = str(r.choice(["blorg", "gnarfing", "gnarfed"]))
        elif i % 31 == 1:
            t[5:7] = ["blorg", "tax"]  # never toxic in this phrase
        rows.append((i, " ".join(t)))
        labels.append((i, 1, toxic, "x"))
    rows += [(9001, None), (9002, ""), (None, "gnarfing"), (9003, "a bl0rg is here"), (9003, "a bl0rg is here"), (9004, "word1 " * 30_000)]
    d, la = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.toxicity(d, la).collect()
    assert len(got) == len(rows)
    by_id = {x.doc_id: x for x in got}
    assert all(x.held_out == (zlib.crc32(("" if x.doc_id is None else str(x.doc_id)).encode()) % 3 == 1) for x in got)
    right = [by_id[i].predicted == t for i, _, t, _ in labels if by_id[i].held_out]
    assert sum(right) >= 0.98 * len(right)
    assert by_id[9001].score == by_id[9002].score < 0.5 and by_id[9003].predicted == 1 and all(0 <= x.score <= 1 for x in got)
    clean = toxicity.keep_clean(d, toxicity.fit(d, la))
    assert clean.columns == d.columns and {x.doc_id for x in clean.collect()} == {x.doc_id for x in got if not x.predicted}
    assert toxicity.toxicity(docs(spark, []), la).collect() == []
    assert len(toxicity.toxicity(d, la.limit(0)).collect()) == len(rows)


# -- mixing ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 1}, {"a": 7, "b": 5, "c": 3, "d": 3, "e": 1}, {f"s{i}": i + 1 for i in range(20)}])
def test_period_stays_within_one_block(weights):
    slots, total, seen = pfair_mixing.period(weights), sum(weights.values()), Counter()
    for t, (s, j) in enumerate(slots, 1):
        assert j == seen[s]
        seen[s] += 1
        assert all(abs(seen[x] - Fraction(w * t, total)) < 1 for x, w in weights.items())
    assert seen == Counter(weights)


def test_mix_orders_all_rows(spark):
    rows = [(i, f"t{i}", s) for i, s in enumerate(["a"] * 300 + ["b"] * 150 + ["c"] * 40 + [None] * 5)] + [(None, None, "a"), (7, "t7", "a")]
    d = docs(spark, rows)
    got = pfair_mixing.mix(d, {"a": 3, "b": 2, "c": 1}, block_rows=4, buckets=7).collect()
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    weights = {"a": 3, "b": 2, "c": 1, None: 1}
    slots = {}
    for r in got:
        slots.setdefault(r["slot"], set()).add(r.source)
    assert all(len(s) == 1 for s in slots.values())
    end = max(r["slot"] for r in got if r.in_mix) + 1
    seen = Counter()
    for t in range(end):
        seen[next(iter(slots[t]))] += 1
        assert all(abs(seen[s] - Fraction(w * (t + 1), 7)) < 1 for s, w in weights.items())
    for s in weights:
        ranks = sorted(r.source_rank for r in got if r.source == s)
        assert ranks == list(range(len(ranks)))
    ordered = pfair_mixing.in_order(d, {"a": 3, "b": 2, "c": 1}, block_rows=4, buckets=7)
    assert ordered.columns == d.columns
    assert [r.source for r in ordered.collect()] == [r.source for r in sorted(got, key=lambda r: r.position)]
    assert pfair_mixing.mix(docs(spark, [])).collect() == []


# -- sharding --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_are_full_and_gapless(spark, shards):
    rows = [*CASES, *((100 + i, f"text {i % 50}") for i in range(200)), *((500 + i, "one group of copies") for i in range(120))]
    got = ring_shards.place(docs(spark, rows), shards, 16, 256, 8).collect()
    assert len(got) == len(rows)
    by_shard = defaultdict(list)
    text = dict(rows)
    for r in got:
        by_shard[r.shard].append(r.slot)
        t = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(by_shard[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    if shards == 3:
        where = defaultdict(set)
        for r in got:
            where[text[r.doc_id]].add(r.shard)
        assert sum(len(s) > 1 for s in where.values()) <= 3  # only groups at a shard's limit are split
    assert ring_shards.place(docs(spark, [])).collect() == []


@pytest.mark.parametrize("shards", [1, 2, 7])
def test_shards_equal_a_walk_of_single_rows(spark, shards):
    cells, nodes, rows = 64, 5, [*CASES, *((100 + i, f"text {i % 40}") for i in range(150)), *((500 + i, "one group of copies") for i in range(90))]
    d = docs(spark, rows)
    cell_of = ring_shards.keys(d, cells, 8, "doc_id", "text").select("text_crc32", "_cell").distinct().collect()
    cell_of = {r.text_crc32: r["_cell"] for r in cell_of}
    places = ring_shards.ring(shards, nodes, cells)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    want = Counter()
    for crc in sorted((zlib.crc32((t or "").encode()) for _, t in rows), key=cell_of.get):
        at = next((k for k, (c, _) in enumerate(places) if c >= cell_of[crc]), 0)
        while not room[places[at % len(places)][1]]:
            at += 1
        shard = places[at % len(places)][1]
        room[shard] -= 1
        want[cell_of[crc], shard] += 1
    got = ring_shards.place(d, shards, nodes, cells, 8).collect()
    assert Counter((cell_of[r.text_crc32], r.shard) for r in got) == want


def test_few_rows_move_when_a_shard_is_added():
    r = np.random.default_rng(1)
    counts = {c: int(n) for c, n in enumerate(r.poisson(20, 4096))}

    def owner(shards):
        out = {}
        for cell, lo, hi, shard, _ in ring_shards.walk(counts, shards, 128, 4096):
            out.update({(cell, k): shard for k in range(lo, hi)})
        return out

    a, b = owner(24), owner(25)
    assert a.keys() == b.keys() and sum(a[k] != b[k] for k in a) < 0.15 * len(a)


# -- pieces ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return piece_sampling.load()


def seeds(keys):
    return np.array([piece_sampling.seed_of(k) for k in keys], np.uint64)


def test_pieces_round_trip_and_depend_on_the_key_only(vocabulary):
    texts = ["", "a", " ", "hello world", "  x▁y  z\n\tq", "日本語テキスト 🙂 é̀ \u0000", "x" * 3000, "▁", "tail ", *(t for _, t in CASES if t)]
    ids = piece_sampling.encode(vocabulary, texts, seeds(range(len(texts))))
    assert [piece_sampling.decode(vocabulary, x) for x in ids] == texts
    alone = [piece_sampling.encode(vocabulary, [t], seeds([i]))[0] for i, t in enumerate(texts)]
    assert all((a == b).all() for a, b in zip(ids, alone, strict=True))
    other = piece_sampling.encode(vocabulary, ["a test of sampled segmentations " * 20], seeds(["other"]))[0]
    same = piece_sampling.encode(vocabulary, ["a test of sampled segmentations " * 20], seeds(["key"]))[0]
    assert len(other) != len(same) or (other != same).any()


def test_samples_follow_the_lattice(vocabulary):
    v = vocabulary

    def every(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            c = np.array([ord(x) for x in s[:n]], np.uint32)
            at = v.find(piece_sampling._slices(piece_sampling._sums(c), np.array([0]), np.array([n])))[0]
            if at >= 0:
                for rest, weight in every(s[n:]):
                    yield (int(v.ids[at]), *rest), weight + v.logs[at]

    exact = {ids: np.exp(w) for ids, w in every("▁other")}
    total, n = sum(exact.values()), 20_000
    seen = Counter(tuple(x.tolist()) for x in piece_sampling.encode(v, ["other"] * n, seeds(range(n))))
    assert set(seen) <= set(exact)
    for ids, w in exact.items():
        p = w / total
        assert abs(seen[ids] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_pieces_query_and_decoding(spark):
    got = piece_sampling.sample_pieces(docs(spark, CASES))
    rows = got.collect()
    assert len(rows) == len(CASES) and all(r.lossless and r.n_pieces == len(r.ids) for r in rows)
    twice = [tuple(r.ids) for r in rows if r.doc_id == 1]
    assert twice[0] == twice[1]
    back = {r.doc_id: r.text for r in piece_sampling.decode_pieces(got).collect()}
    assert back == {i: t or "" for i, t in CASES}
    assert piece_sampling.sample_pieces(docs(spark, [])).collect() == []
