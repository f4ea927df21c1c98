"""Operators against brute force and scenario tables."""

from collections import Counter
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalens.config import DEFAULTS
from catalens.functions.text import STOPWORDS, token_set_score
from catalens.operators import dedup as D
from catalens.operators import forms, log, pricing, quality, search
from catalens.streaming import jobs, ordered


def products(spark, names, **more):
    n = len(names)
    rows = [(i, str(i), more.get("enabled", [True] * n)[i], names[i], more.get("description", [""] * n)[i], more.get("url", [None] * n)[i]) for i in range(n)]
    return spark.createDataFrame(rows, "pos long, id string, enabled boolean, name string, description string, source_url string")


def test_blocking_equals_its_definition(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(30)]
    names = [" ".join(rng.choice(vocabulary, rng.integers(0, 6))) for _ in range(60)]
    config = replace(DEFAULTS, common_df=6)
    tokens = [list(dict.fromkeys(w for w in n.split() if w not in STOPWORDS))[:12] for n in names]
    df = Counter(t for ts in tokens for t in ts)
    expected = set()
    for a, b in combinations(range(60), 2):
        shared = set(tokens[a]) & set(tokens[b])
        if any(df[t] <= 6 for t in shared) or sum(df[t] > 6 for t in shared) >= 2:
            expected.add(tuple(sorted((str(a), str(b)))))
    got = {(r["a"], r["b"]) for r in D.candidate_pairs(products(spark, names), config).collect()}
    assert got == expected


def test_copies_are_one_class_and_no_link_is_lost(spark):
    """Pairs of classes and their members give the pairs of all products; a title's copies are not paired with each other."""
    rng = np.random.default_rng(6)
    vocabulary = [f"word{i}" for i in range(25)]
    names = [" ".join(rng.choice(vocabulary, rng.integers(0, 5))) for _ in range(30)]
    names = [names[i] for i in rng.integers(0, 30, 90)] + ["the"] * 3  # no key: no links, though equal
    config, rows = replace(DEFAULTS, common_df=6), products(spark, names)
    everyone = {(r["a"], r["b"]) for r in D.candidate_pairs(rows, config).collect()}
    classes, pairs, copies = D.linked_classes(rows, ["name"], config)
    of = {r["id"]: r["class_id"] for r in D.members(rows, classes, ["name"]).collect()}
    assert classes.count() == len(set(names)) and len(of) == len(names)
    linked = {(r["a"], r["b"]) for r in pairs.collect()}
    assert linked == {tuple(sorted((of[a], of[b]))) for a, b in everyone if of[a] != of[b]}
    held = {r["b"]: r["a"] for r in copies.collect()}
    assert held == {i: of[i] for pair in everyone for i in pair if of[i] != i and of[pair[0]] == of[pair[1]]}
    counts = {r["id"]: r["links"] for r in D.link_counts(rows, classes, ["name"], pairs, copies).collect()}
    assert counts == {i: sum(i in pair for pair in everyone) for i in of}


def test_keys_of_many_holders_are_dealt_out(spark, monkeypatch):
    keys = spark.createDataFrame([(k, f"{k}{i % 40}") for k in ("x", "y") for i in range(40)] + [("z", "x1"), ("z", "y1"), ("w", "x1")], "key string, id string")
    expected = {(f"{k}{i}", f"{k}{j}") for k in "xy" for i in range(40) for j in range(40) if f"{k}{i}" < f"{k}{j}"} | {("x1", "y1")}
    monkeypatch.setattr(D, "PART_HOLDERS", 7)
    got = [(r["a"], r["b"]) for r in D.sharing(keys).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_url_duplicates_come_first_and_ids_are_text(spark):
    rows = products(spark, ["red widget", "red widget", "blue lamp"] * 4, url=["https://a.co/1", None, "https://a.co/1?spm=2"] * 4)
    got = {r["drop_id"]: (r["keep_id"], r["confidence"]) for r in D.duplicate_pairs(rows).collect()}
    assert got["9"] == ("0", 1.0) and got["11"] == ("0", 1.0)
    assert got["4"] == ("0", 1.0) and got["1"] == ("0", 1.0)  # by name
    assert got["2"] == ("0", 1.0) and got["5"] == ("0", 1.0)  # one canonical URL
    assert "0" not in got


def test_verdict_gate_and_shadowing(spark):
    rows = spark.createDataFrame([(1.0, 0.1, 0.1), (0.0, 0.2, 0.99), (0.0, 0.4, 0.95), (0.0, 0.9, 0.1), (0.0, 0.5, 0.5)], "u double, t double, i double")
    got = [r[0] for r in rows.select(D.verdict(F.col("u"), F.col("t"), F.col("i"))).collect()]
    assert [r["matched_by"] for r in got] == [["url"], [], ["image"], ["text"], []]
    assert [r["confidence"] for r in got] == [1.0, 0.2, 0.95, 0.9, 0.5]
    assert got[1]["image"] == 0.0  # below the gate the image does not count


def test_best_match_may_be_no_duplicate(spark):
    catalogue = products(spark, ["red metal widget", "blue lamp"], description=["", ""])
    queries = spark.createDataFrame([(7, "red plastic gadget", "", None), (8, "lamp blue", "", None), (9, "zzz", "", None)], "query_id long, query_name string, query_description string, query_url string")
    got = {r["query_id"]: (r["product_id"], r["is_duplicate"]) for r in D.best_match(queries, catalogue).collect()}
    assert got == {7: ("0", token_set_score("red plastic gadget", "red metal widget") >= 0.88), 8: ("1", True), 9: ("0", False)}  # the best counts, however far


def test_a_product_does_not_meet_itself(spark, monkeypatch):
    catalogue = products(spark, ["red widget", "blue lamp", "lamp blue"], description=["", "", ""])
    queries = spark.createDataFrame([(i, n, "", None, str(i)) for i, n in enumerate(["red widget", "blue lamp", "lamp blue"])], "query_id long, query_name string, query_description string, query_url string, query_product string")
    monkeypatch.setattr(D, "BLOCK_QUERIES", 2)  # several blocks
    got = {r["query_id"]: (r["product_id"], r["is_duplicate"]) for r in D.best_match(queries, catalogue).collect()}
    assert got[1] == ("2", True) and got[2] == ("1", True) and got[0][1] is False


def test_quality_rules(spark):
    rows = spark.createDataFrame([("1", "Good name", "i", 5, 1, "u"), ("2", " x ", None, 0, 0, ""), ("3", None, "", None, 0, None)], "id string, name string, image_url string, price_cents long, variant_count int, source_url string")
    got = [r[0] for r in rows.orderBy("id").select(quality.quality_issues()).collect()]
    assert got == [[], ["no image", "price = 0", "name empty or very short", "no supplier link"], ["no image", "no variants", "name empty or very short", "no supplier link"]]


def test_variant_prefix_lists_five(spark):
    rows = products(spark, ["a", "b"])
    variants = spark.createDataFrame([("0", i, f" pa{i}", "s") for i in range(7)] + [("1", 1, "spa", "s")], "product_id string, variant_no long, variant_name string, sku string")
    got = quality.audit_variant_prefix(rows, variants).collect()
    assert [(r["id"], r["n"]) for r in got] == [("0", 7)]
    assert got[0]["detail"].endswith("pa4 (and 2 more)")


def test_missing_fields_and_actions(spark):
    rows = spark.createDataFrame([("A", "a@b.co", "1"), (" ", "a@b", ""), (None, None, None)], "n string, e string, p string")
    got = [r[0] for r in rows.select(forms.missing_fields(F.col("n"), F.col("e"), F.col("p"))).collect()]
    assert got == [[], ["client.name", "client.email", "client.phone"], ["client.name", "client.email", "client.phone"]]


def test_dismissed_is_three_valued(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, dismissed boolean")
    assert sorted(r["id"] for r in rows.filter(log.not_dismissed()).collect()) == [2, 3]


def test_null_product_is_never_logged(spark):
    events = spark.createDataFrame([("a", None), ("a", "1"), ("a", "2")], "action string, product_id string")
    logged = spark.createDataFrame([("a", None), ("a", "1")], "action string, product_id string")
    assert sorted(str(r["product_id"]) for r in log.already_logged(events, logged, ["action", "product_id"]).collect()) == ["2", "None"]


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([("k", 2, "old"), ("x", 1, "only")], "key string, version long, value string")
    new = spark.createDataFrame([("k", 2, "new")], "key string, version long, value string")
    assert {r["key"]: r["value"] for r in log.upsert_latest(old, new, "key", "version").collect()} == {"k": "new", "x": "only"}


def test_cheapest_ignores_invalid_prices(spark):
    rows = spark.createDataFrame([("p", "b", 893712, "ARS"), ("p", "a", 1105507, "ARS"), ("p", "c", 0, "USD"), ("q", "a", 0, "USD"), ("q", "b", None, "USD")], "k string, source string, price_cents long, currency string")
    got = {r["k"]: (r["price_cents"], r["currency"], r["n"]) for r in pricing.cheapest(rows, ["k"]).collect()}
    assert got == {"p": (893712, "ARS", 2), "q": (None, None, 2)}


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(60, 4)), 1)
    index = spark.createDataFrame([(str(i // 2), f"i{i}", vectors[i].tolist()) for i in range(60)], "product_id string, image string, vector array<double>")
    queries = spark.createDataFrame([(i, str(i // 2), vectors[i].tolist()) for i in range(0, 60, 9)], "query_id long, query_product string, query_vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["product_id"], r["image"], r["score"]) for r in search.topk_vectors(queries, index.repartition(5), k=3).collect()}
    for q in range(0, 60, 9):
        best = {}
        for i in range(60):
            if i // 2 != q // 2:
                s = round(float(vectors[q] @ vectors[i]), 6)
                best[str(i // 2)] = min(best.get(str(i // 2), (9, "")), (-s, f"i{i}"))
        ranked = sorted(best.items(), key=lambda x: (x[1][0], x[0]))[:3]
        for n, (p, (s, image)) in enumerate(ranked, 1):
            assert got[(q, n)] == (p, image, pytest.approx(-s))


def test_decision_bands(spark):
    config = replace(DEFAULTS, embed_suggest_threshold=0.78)
    cases = [(0.94, None, False, "found"), (0.8719, None, False, "suggestion"), (0.41, None, False, "not_found"), (0.94, 0.1, False, "not_found"), (0.72, 0.9, False, "suggestion"), (0.94, None, True, "suggestion")]
    rows = spark.createDataFrame([(i, "p", s, n, a) for i, (s, n, a, _) in enumerate(cases)], "query_id int, product_id string, score double, name_score double, approximate boolean")
    best = search.best_candidate(rows, config).withColumn("d", search.lookup_decision(F.col("score"), F.col("confirmed"), F.col("vetoed"), F.col("approximate"), F.lit(False), config))
    assert [r["d"] for r in best.orderBy("query_id").collect()] == [c[3] for c in cases]


def test_confirmed_name_beats_a_better_picture(spark):
    rows = spark.createDataFrame([(1, "wrong", 0.96, 0.1), (1, "right", 0.90, 0.9)], "query_id int, product_id string, score double, name_score double")
    assert search.best_candidate(rows).first()["product_id"] == "right"


def brute_rate_limit(times, limit, window):
    log_, out = [], []
    for t in times:
        log_ = [x for x in log_ if x >= t - window]
        out.append(len(log_) < limit)
        if out[-1]:
            log_.append(t)
    return out


def test_rate_limit_does_not_count_rejections(spark, sf_dir):
    rows = jobs.stream_table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("at"))
    got = {r["event_id"]: r["allowed"] for r in jobs.drain(rows, lambda s: ordered.rate_limit(s, limit=2, seconds=86400)).collect()}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    for _, group in events.groupby("user_id"):
        expected = brute_rate_limit(group["ts"].astype("datetime64[us]").astype("int64").tolist(), 2, 86400 * 1_000_000)
        assert [got[e] for e in group["event_id"]] == expected
    assert not all(got.values())


def test_url_match_tries_the_raw_address_first(spark):
    products = spark.createDataFrame([(1, "a", True, "https://x.com/1"), (2, "b", True, "https://x.com/1/"), (3, "c", True, "https://x.com/2"), (4, "d", False, "https://x.com/3"), (5, "e", True, None)], "pos int, id string, enabled boolean, source_url string")
    asked = [(1, "https://x.com/1?utm_source=m", "https://x.com/2"), (2, "https://s.com/q", "https://X.com/2"), (3, "https://s.com/q", None), (4, None, "https://x.com/3"), (5, None, None), (6, None, "https://x.com/1#t")]
    got = D.url_matches(spark.createDataFrame(asked, "id int, raw_url string, resolved_url string"), products).collect()
    assert {r["id"]: r["product_id"] for r in got} == {1: "a", 2: "c", 3: None, 4: None, 5: None, 6: "a"}


def test_pair_queries_take_every_page(spark, sf_dir):
    """No page is left out, every seventeenth neither."""
    from catalens.functions.text import tokenize
    from catalens.plans import dedup_queries as Q

    n = Q.texts(spark, sf_dir).select(F.sum(F.size(tokenize(F.col("name"))))).first()[0]
    assert Q.agg_doc_freq(spark, sf_dir).agg(F.sum("df")).first()[0] == n
    for name in ("join_token_block", "token_set_ratio", "text_similarity"):
        pairs = getattr(Q, name)(spark, sf_dir)
        assert pairs.filter("CAST(a AS BIGINT) % 17 = 0 OR CAST(b AS BIGINT) % 17 = 0").count() > 0
    assert Q.setop_pair_dedup(spark, sf_dir).filter("CAST(a AS BIGINT) % 17 = 0").count() > 0


def test_best_match_takes_every_page(spark, tmp_path):
    """Every seventeenth page is a match where it is the best."""
    from catalens.plans import dedup_queries as Q

    titles = {17: "red oak chair", 20: "red oak chair", 21: "steel lamp", 22: "red pine table"}
    rows = [(i, f"https://x.com/{i}", f'<title>{t}</title><div class="ad">{t}</div>') for i, t in titles.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Q.join_theta_best(spark, str(tmp_path)).collect()
    assert [(r["query_id"], r["product_id"], r["is_duplicate"], r["confidence"]) for r in got] == [(20, "17", True, 1.0)]


def test_best_pictures_shuffle_no_pairs(spark, sf_dir):
    from catalens.plans.search_queries import agg_image_best

    plan = agg_image_best(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 1 and "query_id" not in shuffled[0]


def test_best_pictures_with_missing_numbers_ties_and_blocks(spark, tmp_path, monkeypatch):
    """As the SQL: a missing number adds nothing, of equal scores the smallest image, a picture without a score comes last; queries meet products in blocks, without a nested loop."""
    import random

    from catalens.operators import search
    from catalens.plans.search_queries import R, agg_image_best
    from oracle import assert_same, connect

    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    rng = random.Random(5)
    vectors = [[rng.randrange(-8, 9) / 8 for _ in range(64)] for _ in range(66)]
    vectors[21], vectors[40][3], vectors[30], vectors[50], vectors[51] = vectors[20], None, None, None, [None] * 64
    vectors[7] = [0.0005] + [0.0] * 63
    vectors[60] = [0.001] + [0.0] * 63  # the product lies halfway between two numbers of six digits
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = agg_image_best(spark, str(tmp_path))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert_same(got.toPandas(), connect(str(tmp_path)).execute(R.oracles["agg_image_best"]).df())


@pytest.mark.parametrize("name", ["join_token_block", "token_set_ratio", "text_similarity", "join_incremental", "compare"])
def test_pair_queries_return_every_pair_of_pages(spark, tmp_path, monkeypatch, name):
    """Copies of a text are paired with each other and with all others, each pair by its own pictures, also where a class takes several rows."""
    import random

    from catalens.plans import dedup_queries as Q
    from oracle import assert_same, connect

    monkeypatch.setattr(D, "CHUNK_MEMBERS", 2)
    rng = random.Random(4)
    titles = ["red oak chair", "red oak chairs", "steel lamp", "the", "red pine table"]
    pages = [(i, f"https://x.com/{i}", f'<title>{titles[min(rng.randrange(9), 4)]}</title><div class="ad">{rng.choice(["", "old"])}</div>') for i in range(1, 28)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    vectors = [(i, [rng.random() for _ in range(64)], 0) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = getattr(Q, name)(spark, str(tmp_path)).toPandas()
    assert_same(got, connect(str(tmp_path)).execute(Q.R.oracles[name]).df())
    assert len(got[["a", "b"]].drop_duplicates()) == len(got) > 27
