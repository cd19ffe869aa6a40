"""What rounds write and shuffle: small cases that count rows."""

from hornloom.operators import dictionary, equality, paths
from hornloom.operators.tables import FACT, id_of
from hornloom.plans.reason import Options, reason
from hornloom.sources.ofn import parse_functional

LABEL = "id long, root long"


def test_groups_of_equals_are_expanded_once_and_only_where_facts_lack(spark):
    """facts that hold between all members of a class are no candidates again, n to the fourth of them before."""
    n = 40
    label = spark.createDataFrame([(i, 1) for i in range(1, n + 1)], LABEL)
    links = [(a, 100, b) for a in range(1, n + 1) for b in range(1, n + 1)]
    keys = [(a, 101, 900) for a in range(1, n + 1)]
    assert equality.expand(spark.createDataFrame(links + keys, FACT), label).count() == 0
    some = [(1, 102, 901), (2, 102, 901), (3, 103, 4), (77, 104, 5), (77, 104, 78)]
    made = equality.expand(spark.createDataFrame(links[1:] + keys + some, FACT), label)
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == len(set(rows))
    ids = range(1, n + 1)
    assert set(rows) == set(links) | {(a, 102, 901) for a in ids} | {(a, 103, b) for a in ids for b in ids} | {(77, 104, b) for b in ids}


def test_large_classes_are_cut(spark, monkeypatch):
    monkeypatch.setattr(equality, "PART", 3)
    label = spark.createDataFrame([(i, 1) for i in range(1, 20)] + [(i, 30) for i in (30, 31)], LABEL)
    got = sorted(tuple(r) for r in equality.couples(label).collect())
    assert got == sorted([(a, b) for a in range(1, 20) for b in range(1, 20)] + [(a, b) for a in (30, 31) for b in (30, 31)])
    assert equality.expand(spark.createDataFrame([(1, 100, 30)], FACT), label).count() == 19 * 2


def test_separate_paths_keep_places_instead_of_pairs(spark, monkeypatch):
    """the closure of paths was written to disk pair by pair, more than once."""
    monkeypatch.setattr(paths, "BLOCK", 3)
    steps = {"a": 11, "b": 1, "c": 2, "d": 4}
    t = lambda k, i: f"<urn:t:{k}{i}>"
    data = [(t(k, i), "<urn:t:p>", t(k, i + 1)) for k, n in steps.items() for i in range(n)]
    axioms = parse_functional("Prefix(:=<urn:t:>) Ontology(<urn:t:o> TransitiveObjectProperty(:p))")
    want = {(t(k, i), "<urn:t:p>", t(k, j)) for k, n in steps.items() for i in range(n + 1) for j in range(i + 2, n + 1)}
    r = reason(spark, spark.createDataFrame(data, "s string, p string, o string"), axioms)
    assert r.outcome.known.count() == len(data)
    got = [tuple(x) for x in r.inferred().collect()]
    assert len(got) == len(want) and set(got) == want
    assert {tuple(x) for x in r.closure().collect()} == want | set(data)
    # Distances 2, 3 and 4, 5 to 8, 9 to 11.
    assert [x["new_properties"] for x in r.report["reasoning"]["iterations"]] == [10 + 1 + 3, 9 + 8 + 2 + 1, 7 + 6 + 5 + 4, 3 + 2 + 1]
    assert r.report["reasoning"]["total_inferred"] == len(want) and r.report["reasoning"]["total_iterations"] == 5
    # Facts that go round, branch or join take the rule.
    pairs = lambda rows: spark.createDataFrame(rows, "s long, o long")
    assert paths.places(pairs([(1, 2), (2, 3), (3, 1), (7, 8)])) is None
    assert paths.places(pairs([(1, 2), (1, 3)])) is None and paths.places(pairs([(1, 3), (2, 3)])) is None


def test_rows_of_frequent_terms_are_not_shuffled_to_one_task(spark, monkeypatch):
    """F6, F7, F8, F10, F11, F12, F14: all rows met in one task for the term of their property, class or empty cell."""
    n = 400
    terms = ["<p>", *(f"<s{i}>" for i in range(n)), *(f"<o{i}>" for i in range(100)), "<hot>"]
    names = spark.createDataFrame([(id_of(t), t) for t in terms], "id long, term string")
    data = [(f"<s{i}>", "<p>", "<hot>" if i % 2 else f"<o{i % 100}>" if i % 4 else None) for i in range(n)]
    facts = spark.createDataFrame([tuple(t and id_of(t) for t in r) for r in data], FACT)
    for few, shuffled in ((dictionary.FEW, 0), (10, 2)):
        monkeypatch.setattr(dictionary, "FEW", few)
        monkeypatch.setattr(dictionary, "OFTEN", 50 if few == 10 else 1)
        got = dictionary.decode(facts, names)
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(data, key=str)
        often = dictionary._frequent(facts, ("s", "p", "o"))
        assert often["p"] == ([id_of("<p>")], True) and id_of("<hot>") in often["o"][0]
        assert sum(not whole for _, whole in often.values()) == shuffled


def test_facts_of_new_properties_are_not_tested_and_superproperties_fire_once(spark, tmp_path):
    """a new property's facts were written twice, joined with all known ones, and derived again from its subproperties' facts."""
    axioms = parse_functional("Prefix(:=<urn:t:>) Ontology(<urn:t:o> SubObjectPropertyOf(:p :q) SubObjectPropertyOf(:q :r) SubObjectPropertyOf(:x :y) SymmetricObjectProperty(:y) SubObjectPropertyOf(:y :z))")
    t = lambda x: f"<urn:t:{x}>"
    data = [("a", "p", "b"), ("c", "q", "d"), ("e", "q", "f"), ("e", "r", "f"), ("g", "x", "h"), ("g", "y", "h")]
    want = [("a", "q", "b"), ("a", "r", "b"), ("c", "r", "d"), ("h", "y", "g"), ("g", "z", "h"), ("h", "z", "g")]
    run = lambda rows, folder: reason(spark, spark.createDataFrame([tuple(map(t, r)) for r in rows], "s string, p string, o string"), axioms, Options(work_dir=str(tmp_path / folder)))
    r = run(data, "mixed")
    assert sorted(tuple(x) for x in r.inferred().collect()) == sorted(tuple(map(t, x)) for x in want)
    assert r.outcome.known.distinct().count() == r.outcome.known.count() == len(data) + len(want)
    r = run([("a", "p", "b"), ("c", "p", "d")], "new")
    assert r.outcome.derived.count() == 4 and not list(tmp_path.glob("new/*/delta-*"))
