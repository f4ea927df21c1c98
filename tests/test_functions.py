"""Unit tables of the scalar functions."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from catalens.config import DEFAULTS
from catalens.functions import html as H
from catalens.functions import pricing as P
from catalens.functions import text as T
from catalens.functions import urls as U
from catalens.functions import vectors as V


def apply(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_canonical_urls(spark):
    given = ["https://A.com/p/1/?utm_source=x&b=2&a=1#top", "https://a.com/p/1?a=1&b=2", "https://a.com/p/2", "", None, "https://a.com/?q=", "https://www.a.com:8080/x//"]
    got = apply(spark, given, U.normalize_url)
    assert got[0] == got[1] == "https://a.com/p/1?a=1&b=2"
    assert got[2] != got[1]
    assert got[3] is None and got[4] is None
    assert got[5] == "https://a.com"
    assert got[6] == "https://www.a.com:8080/x"
    given = ["https://a.com?a1=2&a=1&q=x%20y", "\thttps://a.com?q=x+y&a1=2&a=1\n", "https://a.com?b=%7e*~&a=%zz", "https://a.com?=v&c=%C3%A9"]
    assert apply(spark, given, U.normalize_url) == ["https://a.com?a=1&a1=2&q=x+y"] * 2 + ["https://a.com?a=%25zz&b=~%2A~", "https://a.com?=v&c=%C3%A9"]


def test_normalize_url_takes_each_step_once(spark):
    plan = spark.createDataFrame([("x",)], "u string").select(U.normalize_url(F.col("u")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(u") == 1


def test_url_similarity_needs_two_urls(spark):
    same = apply(spark, ["https://a.com/x", None], lambda c: U.url_similarity(c, c))
    assert same == [1.0, 0.0]


def test_public_addresses(spark):
    private = ["http://localhost/x", "http://127.0.0.1", "http://10.0.0.5/a", "http://192.168.1.1", "http://172.16.9.9", "http://169.254.1.1", "ftp://a.com", "", "http:///x", "http://x.internal/"]
    assert not any(apply(spark, private, U.url_is_public))
    assert all(apply(spark, ["https://a.com", "http://8.8.8.8/x", "https://172.32.0.1"], U.url_is_public))


def test_marketplaces(spark):
    urls = ["https://articulo.mercadolibre.com.ar/x", "https://www.alibaba.com/y", "https://es.aliexpress.com/z", "https://detail.1688.com/offer/1", "https://www.amazon.de", "https://shop.co"]
    assert apply(spark, urls, U.detect_marketplace) == ["mercadolibre", "alibaba", "aliexpress", "1688", "amazon", "other"]


def test_marketplace_references(spark):
    urls = [
        "https://www.m.com.ar/thing/up/MLAU3916488174",
        "https://www.m.com.ar/p/MLA123456789",
        "https://articulo.m.com.ar/MLA-1234567890-thing",
        "https://www.m.com.ar/p/MLA123456789?pdp_filters=item_id:MLA1755665491",
        "https://www.m.com.ar/p/MLA123456789?pdp_filters=item_id%3AMLA1755665491",
        "https://www.m.com.ar/x/mla1234567",
        "https://a.com/x",
        "",
    ]
    got = [(r and (r["id"], r["kind"])) for r in apply(spark, urls, U.market_reference)]
    assert got == [("MLAU3916488174", "product"), ("MLA123456789", "product"), ("MLA1234567890", "item"), ("MLA1755665491", "item"), ("MLA1755665491", "item"), ("MLA1234567", "item"), None, None]


def test_name_from_slug(spark):
    assert apply(spark, ["https://www.m.com.ar/masajeador-cervical-inteligente/up/MLAU409", "https://a.com/x"], U.name_from_slug) == ["masajeador cervical inteligente", ""]


def test_absolute_pictures(spark):
    base = F.lit("https://h.com/a/b.html?x=1")
    got = apply(spark, ["//c.com/i.png", "/i.png", "i.png", "data:image/png;base64,x", "http://localhost/i.png", "ftp://x/i.png", ""], lambda c: U.absolutize_url(c, base))
    assert got == ["https://c.com/i.png", "https://h.com/i.png", "https://h.com/a/i.png", None, None, None, None]


def test_tokens(spark):
    got = apply(spark, ["The Red-WIDGET with 10 widget x9z cámara", None, " ".join(f"word{i}" for i in range(20))], T.tokenize, "string")
    assert got[0] == ["red", "widget", "x9z", "mara"]
    assert got[1] == []
    assert len(got[2]) == 12


@pytest.mark.parametrize(("a", "b", "low", "high"), [("red widget", "red widget", 1, 1), ("red widget big", "widget red", 1, 1), ("red widget", "blue sofa", 0, 0.5), ("", "x", 0, 0), ("wireless mouse black", "wireless mouse blakc", 0.85, 1)])
def test_token_set_score(a, b, low, high):
    assert low <= T.token_set_score(a, b) <= high
    assert T.token_set_score(a, b) == T.token_set_score(b, a)


def test_common_subsequence_against_the_table():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(max(new[-1], row[j + 1], row[j] + (c == d)))
            row = new
        return row[-1]

    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert T.common_subsequence(a, b) == slow(a, b)


def test_text_similarity_without_description(spark):
    rows = spark.createDataFrame([("red widget", "", "red widget", "x"), ("red widget", "<b>small  thing</b>", "widget red", "small thing"), (None, None, "x", None)], "a string, b string, c string, d string")
    got = [r[0] for r in rows.select(T.text_similarity(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == pytest.approx([1.0, 1.0, 0.0])


@pytest.mark.parametrize(
    ("now", "before", "expected"),
    [(1680, None, "first_observation"), (1680, 1680, "ok"), (1730, 1680, "ok"), (1850, 1680, "alert"), (1500, 1680, "alert"), (2700, 1680, "alert_critical"), (100, 0, "alert_critical"), (105, 100, "alert"), (130, 100, "alert"), (131, 100, "alert_critical")],
)
def test_price_decision(spark, now, before, expected):
    rows = spark.createDataFrame([(now, before)], "n long, b long")
    assert rows.select(P.price_decision(F.col("n"), F.lit("USD"), F.col("b"), F.lit("USD"))).first()[0] == expected


def test_currency_change_is_not_compared(spark):
    rows = spark.createDataFrame([("CNY", "USD"), ("USD", None), ("USD", "")], "c string, p string")
    assert [r[0] for r in rows.select(P.price_decision(F.lit(10), F.col("c"), F.lit(10), F.col("p"))).collect()] == ["skip_currency", "ok", "ok"]


def test_times_and_prices(spark):
    now = datetime.datetime(2024, 1, 2, 12)
    rows = spark.createDataFrame([(now - datetime.timedelta(seconds=s),) for s in (10, 600, 7200, 200_000, -600)], "t timestamp")
    assert [r[0] for r in rows.select(P.fmt_time(F.col("t"), F.lit(now))).collect()] == ["now", "10 min", "2 h", "2023-12-31", "10 min"]
    assert apply(spark, [1234, None], lambda c: P.fmt_price(c, F.lit("USD")), "long") == ["12.34 USD", "-"]
    assert apply(spark, [0.125, 0.375, 1.0], P.price_cents, "double") == [12, 38, 100]


def test_vectors(spark):
    assert apply(spark, [[3.0, 4.0], [0.0, 0.0]], V.vec_normalize, "array<float>") == [[0.6, 0.8], [0.0, 0.0]]
    coded = spark.createDataFrame([([1.0, -2.5],)], "v array<float>").select(V.vec_encode("v").alias("t"))
    assert coded.select(V.vec_decode(2)("t")).first()[0] == [1.0, -2.5]
    assert coded.select(V.vec_decode(3)("t")).first()[0] is None
    assert apply(spark, ["%%%", None], V.vec_decode(2)) == [None, None]
    rows = spark.createDataFrame([(0, 0), (0, 255), (-1, 0)], "a long, b long")
    assert [r[0] for r in rows.select(V.phash_score(F.col("a"), F.col("b"))).collect()] == [1.0, 0.875, 0.0]


def test_pages():
    page = '<html><head><title> A  b </title><meta property="og:image" content="https://x.co/1.jpg"><script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "N", "image": ["https://x.co/0.jpg"], "offers": {"price": "3.5", "priceCurrency": "EUR"}}]}</script></head></html>'
    assert H.read_page(page) == ("N", ["https://x.co/0.jpg", "https://x.co/1.jpg"], 3.5, "EUR", None)
    assert H.read_page("") == ("", [], None, None, "empty")
    assert H.read_page(None)[4] == "empty"
    assert H.read_page("<html>please solve this CAPTCHA</html>")[4] == "blocked"
    assert H.read_page("<html><title>x</title></html>")[:2] == ("x", [])
    assert H.read_page('<script type="application/ld+json">{broken</script>')[4] == "none_found"


def test_defaults_are_ordered():
    assert DEFAULTS.embed_name_reject_threshold < DEFAULTS.embed_name_confirm_threshold < DEFAULTS.embed_suggest_threshold < DEFAULTS.embed_match_threshold


def test_result_cards(spark):
    card = '<li class="ui-search-layout__item big"><h2 class="x ui-search-item__title">%s</h2>%s<a href="%s" class="ui-search-link">go</a></li>'
    amount = '<span class="andes-money-amount__fraction"> %s </span>'
    cents = '<span class="andes-money-amount__cents">%s</span>'
    page = "<ol>" + "".join(
        [
            card % ("<b>One</b> ", amount % "12.345" + cents % "67", "/1"),
            card % ("Two", amount % "1,000", "/2"),
            card % ("no amount", cents % "5", "/3"),
            card % ("no number", amount % "ask", "/4"),
            '<li class="ui-search-layout__item"><a class="poly-component__title" href="/5">Five</a>' + amount % "7" + cents % "x" + "</li>",
            card % ("six is one too many", amount % "1", "/6"),
            '<li class="ui-search-layout__items"><h2 class="ui-search-item__title">other</h2></li>',
        ]
    )
    got = apply(spark, [page, "", None], H.result_cards)
    assert [tuple(c) for c in got[0]] == [("One", 1234567, "ARS", "/1"), ("Two", 100000, "ARS", "/2"), ("Five", 700, "ARS", "/5")]
    assert got[1] == [] and got[2] is None
    last = "<ol>" + card % ("A", "", "/a") + "</ol>" + amount % "9"
    assert apply(spark, [last], H.result_cards) == [[]]  # an amount after the list is no card's


def cubic(x):
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def resized(line, n):
    """One line of points by definition."""
    scale = len(line) / n
    out = []
    for o in range(n):
        w = [cubic((i + 0.5 - (o + 0.5) * scale) / max(scale, 1)) for i in range(len(line))]
        whole = [math.floor(a / sum(w) * 2**22 + 0.5) for a in w]
        out.append(min(max((sum(a * b for a, b in zip(whole, line)) + 2**21) >> 22, 0), 255))
    return out


def test_pictures_for_the_model_equal_brute_force(spark):
    rng = random.Random(3)
    shapes = [(5, 4), (4, 9), (40, 30), (8, 8), (1, 1), (8, 20)]
    pictures = [(i, bytes(rng.randrange(256) for _ in range(w * h * 3)), w, h) for i, (w, h) in enumerate(shapes)] + [(6, None, 3, 3), (7, b"abc", 2, 2), (8, b"abc", None, 1)]
    rows = spark.createDataFrame(pictures, "i int, pixels binary, w int, h int")
    got = {r["i"]: r["x"] for r in rows.select("i", V.clip_tensor(8)("pixels", "w", "h").alias("x")).collect()}
    assert got[6] is got[7] is got[8] is None
    for i, (w, h) in enumerate(shapes):
        raw, expected = pictures[i][1], []
        wide, high = max(8, round(w * 8 / min(w, h))), max(8, round(h * 8 / min(w, h)))
        for c in range(3):
            plane = [[raw[(y * w + x) * 3 + c] for x in range(w)] for y in range(h)]
            plane = [resized(line, wide) for line in plane] if wide != w else plane
            plane = list(zip(*[resized(list(line), high) for line in zip(*plane)])) if high != h else plane
            left, top = (wide - 8) // 2, (high - 8) // 2
            expected += [(plane[top + y][left + x] / 255 - V.CLIP_MEAN[c]) / V.CLIP_STD[c] for y in range(8) for x in range(8)]
        assert got[i] == pytest.approx(expected, abs=1e-5)


def test_tensors_come_in_small_parts(spark, monkeypatch):
    """The same tensors as the column function's, a few pictures at once."""
    from catalens.functions import vectors as V

    monkeypatch.setattr(V, "CLIP_ROWS", 3)
    rows = spark.createDataFrame([(i, bytes(range(i, i + 60)) if i % 4 else None, 5, 4) for i in range(10)], "id long, pixels binary, width int, height int").coalesce(1)
    got = {r["id"]: r["tensor"] for r in V.clip_tensors(rows, 8).collect()}
    assert got == {r["id"]: r["p"] for r in rows.select("id", V.clip_tensor(8)("pixels", "width", "height").alias("p")).collect()}
    assert got[0] is None and len(got[1]) == 192


def test_the_query_prepares_whole_tensors(spark, sf_dir):
    """Pictures get the model's 224 points a side."""
    from catalens.plans.search_queries import clip_preprocess

    assert [r["n"] for r in clip_preprocess(spark, sf_dir).select("n").distinct().collect()] == [3 * 224 * 224]
