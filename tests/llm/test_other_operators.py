"""Small tests of the operators over pages and vectors, and of the pipeline."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hornloom.llm import pfair_mixing, topk_search, toxicity, url_rules, warc_revisits
from hornloom.llm._shared import settle

# -- top-k -----------------------------------------------------------------------------------------------------------


def brute_top(rows, k=5):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault((i, tuple(math.floor(256 * x) for x in v)), None)
    out = {}
    for i, v in fine:
        if i % 50 == 0:
            scores = {(-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in fine if j != i and len(w) == len(v)}
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk_search, "FAN_IN", 2)
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, -0.25, 0.0, 0.125, 0.5]) for _ in range(4)]) for i in range(300)]
    rows += [(1000, None), (1050, [0.1, None, 0.2, 0.3]), (1100, [0.1, float("nan"), 0.2, 0.3]), (1150, [0.1, float("inf"), 0.2, 0.3]), (None, [0.1, 0.2, 0.3, 0.4])]
    rows += [(1200, [3000.0, -2000.0, 1.0, 2.0]), (1300, [1.0, 2.0]), (1301, [2.0, 1.0]), (1400, []), rows[7], rows[50]]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int, dim int").repartition(5)
    got = defaultdict(list)
    for x in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    want = {q: v for q, v in brute_top(rows).items() if v}
    assert {q: sorted(v) for q, v in got.items()} == want
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_top_k_refuses_overflow():
    import numpy as np

    big = np.array([[2**40]], np.int64)
    with pytest.raises(ValueError, match="too large"):
        topk_search._product(big, big)
    exact = topk_search._product(np.array([[2**30, 3]], np.int64), np.array([[2**30, 5]], np.int64))
    assert exact.tolist() == [[2**60 + 15]]


# -- URL rules -------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    cases = {
        "https://a.org/x": ("a.org", "/x", "org/", "allow"), "http://EXAMPLE.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"), "http://www.example.org/en/17?x=1#y": ("www.example.org", "/en/17", "example.org/en/1", "block"),
        "http://m.casino-win.example.com/en/4": ("m.casino-win.example.com", "/en/4", None, "block"), "http://free-bets.example.com/fr/1": ("free-bets.example.com", "/fr/1", "com/fr/", "allow"), "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://sex-education.example.net/": ("sex-education.example.net", "/", None, "allow"), "http://notorg/x": ("notorg", "/x", None, "allow"), "org": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://h.net?casino=1": ("h.net", "", None, "block"), "http://h.net/casino/x": ("h.net", "/casino/x", None, "block"), "http://h.net/" + "a" * 100_000: ("h.net", "/" + "a" * 100_000, None, "allow"), "x://y://z.org/p": ("y:", "//z.org/p", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate([*cases, "https://a.org/x"])], "page_id long, url string, host string, path string, verdict string")
    got = {r.page_id: (r.host, r["path"], r.rule, r.verdict) for r in url_rules.judge(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and len(got) == len(cases) + 1
    assert url_rules.judge(df.limit(0)).collect() == []


def test_index_loses_no_match(spark):
    import re

    r = random.Random(4)
    pool = ["casino", "win", "bets", "free", "ads", "banner", "adult", "education", "porn", "news", "x1", "tracker", "example", "gif", "sex"]
    urls = [r.choice(["http", "https"]) + "://" + "".join(r.choice(pool) + r.choice("-./") for _ in range(r.randint(1, 6))) + r.choice(["", "com", "gif"]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    by_token = url_rules.index(df, url_rules.PATTERN_RULES)
    for u in urls:
        tried = {i for t in re.findall("[a-z0-9]+", u) for i in by_token.get(t, ())} | set(by_token.get("", ()))
        hit = {i for i, x in enumerate(url_rules.PATTERN_RULES) if re.search(url_rules.regex(x.pattern), u)}
        assert hit <= tried, (u, [url_rules.PATTERN_RULES[i] for i in hit - tried])


# -- revisits --------------------------------------------------------------------------------------------------------

RECORD = "record_id long, kind string, uri string, time long, status int, etag string, last_modified string, headers map<string,string>, payload string, digest string, canonical_uri string"


def brute_revisits(rows, canon):
    out = {}
    for rid, kind, uri, time, _, etag, modified, headers, *_ in rows:
        if kind != "revisit":
            continue
        best = None
        for o in rows:
            if o[1] == "response" and None not in (o[2], o[3], uri, time) and canon[o[2]] == canon[uri] and (o[3], o[0]) < (time, rid) and (best is None or (o[3], o[0]) > (best[3], best[0])):
                best = o
        if best is None:
            out[rid] = ("orphan", None)
            continue
        bare = lambda t: t.removeprefix("W/")
        fits = bare(etag) == bare(best[5]) if etag is not None and best[5] is not None else modified == best[6] if modified is not None and best[6] is not None else None
        out[rid] = ("unverified", None) if fits is None else ("resolved", best[0]) if fits else ("mismatch", None)
    return out


def test_revisits_equal_brute_force(spark):
    r = random.Random(9)
    uris = ["http://www.A.example/x/", "https://a.example/x#top", "http://a.example:80/x?utm_source=1", "http://a.example/x?b=2&a=1", "http://a.example/x?a=1&b=2&ref=q", "http://b.example", None]
    rows = []
    for i in range(400):
        uri = uris[0] if i % 3 else r.choice(uris)
        rows.append((i, r.choice(["response", "revisit"]), uri, r.choice([None, *range(120)]), 200, r.choice([None, '"1"', 'W/"1"', '"2"']), r.choice([None, "d1", "d2"]), r.choice([None, {"ETag": "e", "Content-Type": "t"}, {"Cache-Control": f"c{i}", "X": None}]), f"p{i}", "z", "z"))
    df = spark.createDataFrame(rows, RECORD)
    canon = {x.uri: x.c for x in df.select("uri", warc_revisits.canonical(F.col("uri")).alias("c")).distinct().collect()}
    assert len({canon[u] for u in uris[:3]}) == 1 and canon[uris[3]] == canon[uris[4]]
    want = brute_revisits(rows, canon)
    for chunk in (3, 4096):
        got = warc_revisits.resolve(df, chunk).collect()
        assert {x.record_id: (x.status, x.response_id) for x in got} == want and len(got) == len(want)


def test_a_hot_url_is_cut_by_its_captures(spark):
    # Half of the captures come in a burst.
    rows = [(i, "revisit" if i % 3 else "response", "http://hot/", i if i < 200 else 1000 + i // 20, 200, f'"{i // 3 % 5}"', None, {}, str(i // 3 % 5), "", "") for i in range(400)]
    rows += [(1000, "revisit", None, 5, 304, None, None, {}, None, "", ""), (1001, "revisit", "http://hot/", None, 304, None, None, {}, None, "", ""), (1002, "response", None, 1, 200, None, None, {}, "x", "", "")]
    df = spark.createDataFrame(rows, RECORD)
    cuts = warc_revisits._cuts(df.where("uri is not null and time is not null").withColumn("canonical_uri", F.col("uri")), 20).collect()
    assert len(cuts) == 1 and 10 <= len(cuts[0]["_cuts"]) <= 19
    want = brute_revisits(rows, {"http://hot/": "hot", None: None})
    for chunk in (20, 4096):
        got = warc_revisits.resolve(df, chunk).collect()
        assert {x.record_id: (x.status, x.response_id) for x in got} == want and len(got) == len(want)


def test_revisit_merges_permitted_headers(spark):
    rows = [
        (1, "response", "http://a/", 1, 200, '"t"', None, {"ETag": '"t"', "Content-Type": "html", "Date": "d1"}, "body", "", ""),
        (2, "revisit", "http://a", 5, 304, 'W/"t"', None, {"date": "d2", "Content-Type": "text", "Expires": "soon"}, None, "", ""),
    ]
    (x,) = warc_revisits.resolve(spark.createDataFrame(rows, RECORD)).collect()
    assert (x.status, x.response_id, x.headers) == ("resolved", 1, 'content-type: html\ndate: d2\netag: "t"\nexpires: soon')
    assert warc_revisits.resolve(spark.createDataFrame([], RECORD)).collect() == []


# -- native operators ------------------------------------------------------------------------------------------------


def test_native_operators_plan_no_python(spark):
    import re

    from hornloom.llm import pfair_mixing, pii_weak, ring_shards

    docs = spark.sql("SELECT * FROM VALUES (1L, 'a@b.c'), (2L, 'x') AS t (doc_id, text)")
    for df in (pii_weak.scan(docs), pii_weak.find(docs), ring_shards.place(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


# -- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(240):
        t = [r.choice(words) for _ in range(60)]
        if i % 8 == 0:
            t[3] = "gnarfing"
        rows.append((i, " ".join(t), "en", f"src{i % 3}", 0, "kept"))
        labels.append((i, 1, int(i % 8 == 0)))
    near = rows[1][1].split()
    near[0] = "changed"
    rows += [(500, rows[1][1], "en", "src0", 0, "kept"), (501, " ".join(near), "en", "src1", 0, "kept"), (502, "write to me@mail.example.com " + rows[2][1][:200], "en", None, 0, "kept"), (503, None, "en", "src0", 0, "kept"), (504, "", "en", "src0", 0, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = settle(stage(spark, kept, str(tmp_path)), name)
        held[name] = {x.doc_id: x for x in kept.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
    toxic = {i for i in range(0, 240, 8)}
    assert set(held["toxicity"]) == {x[0] for x in rows} - toxic
    assert set(held["near_duplicates"]) == set(held["toxicity"]) - {500, 501}
    assert held["personal_data"][502].text.startswith("write to <EMAIL> ") and held["personal_data"][503].text is None
    assert set(held["mixing"]) == set(held["near_duplicates"]) == set(held["pieces"])
    assert all(x.lossless for x in held["pieces"].values()) and held["pieces"][504].n_pieces == 0
    final = {x.doc_id: tuple(x.ids) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == {i: tuple(x.ids) for i, x in held["pieces"].items()}
    assert toxicity.held_out is not None


def test_pipeline_result_has_the_mixed_order(spark, tmp_path):
    source = ["src0"] * 240 + ["src1"] * 80 + ["src2"] * 80
    rows = [(i, f"text number {i} of {x} with its own words a{i} b{i} c{i}", x) for i, x in enumerate(source)] + [(None, "a row without an id", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda x: x.position)
    assert len({x.position for x in got}) == len(got) == len(rows)
    of = lambda x: "src1" if x.doc_id is None else source[x.doc_id]
    mixed = [of(x) for x in got if x.in_mix]
    assert [x.in_mix for x in got] == [True] * len(mixed) + [False] * (len(got) - len(mixed)) and len(mixed) >= 160
    weights = {"src0": 4, "src1": 3, "src2": 3}
    for n in range(0, len(mixed), pfair_mixing.BLOCK_ROWS):
        assert all(abs(mixed[:n].count(s) - n * w / 10) < pfair_mixing.BLOCK_ROWS for s, w in weights.items())


def test_pieces_take_the_order_of_the_mixing_stage(spark, tmp_path, monkeypatch):
    rows = [(i, f"text number {i} with its own words a{i} b{i} c{i}", None if i % 50 == 9 else f"src{i % 3}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = sorted(pfair_mixing.mix(docs).collect(), key=lambda x: x.position)
    assert sorted((x.position, x.doc_id, x.in_mix) for x in mixed) == [(n, x.doc_id, x.in_mix) for n, x in enumerate(want)] and 0 < sum(x.in_mix for x in mixed) < len(rows)
    # Another order of that stage's files, which are many and of unequal sizes, is another order of the result.
    back = lambda spark, docs, sf_dir: docs.repartitionByRange(13, F.desc(F.col("doc_id") * F.col("doc_id"))).sortWithinPartitions(F.desc("doc_id"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, back if name == "mixing" else stage) for name, stage in corpus_pipeline.STAGES])
    assert sorted((x.position, x.doc_id) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [(n, 399 - n) for n in range(400)]
    empty = settle(docs.limit(0), "mixing")
    assert corpus_pipeline.encode_pieces(spark, empty, str(tmp_path)).collect() == []


def test_part_files_are_ordered_by_number():
    names = [f"part-{n:05}-6b1c-{n % 7}f-c{c:03}.snappy.parquet" for n in (0, 1, 9, 10, 99_999, 100_000, 100_001) for c in (0, 1, 10)]
    assert sorted(reversed(names), key=pfair_mixing._part) == names
    with pytest.raises(ValueError, match="order"):
        pfair_mixing._part("rows.parquet")


def test_mixing_weights_with_a_common_factor(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(300)], "doc_id long, source string")
    plain, scaled = ({tuple(x) for x in pfair_mixing.mix(df, {"a": 3 * f, "b": 2 * f}, block_rows=4).collect()} for f in (1, 1_000_000))
    assert plain == scaled and len(plain) == 300
    with pytest.raises(ValueError, match="MAX_PERIOD"):
        pfair_mixing.mix(df, {"a": 1_000_000, "b": 999_999})
