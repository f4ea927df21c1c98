"""URL functions: canonical form, classification, marketplace references (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalens.functions.binding import once

#: Query parameters that only track where a visitor came from.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "spm", "scm", "pvid", "algo_pvid", "algo_exp_id", "ref", "aff_trace_key",
    "terminal_id", "_t", "_p", "tt_from", "share_app_id",
]
#: Marketplaces and what their hosts contain, in order of precedence.
MARKETPLACES = [
    ("mercadolibre", ["mercadolibre.", "mercadolivre.", "mlstatic.com"]),
    ("alibaba", ["alibaba.com"]),
    ("aliexpress", ["aliexpress.", "ae01.alicdn.com"]),
    ("1688", ["1688.com", "alicdn.com"]),
    ("made-in-china", ["made-in-china.com"]),
    ("amazon", ["amazon."]),
]
#: Marketplace sites by the end of the host.
SITES = [(".com.ar", "MLA"), (".com.mx", "MLM"), (".com.br", "MLB"), (".com.co", "MCO"), (".com.uy", "MLU"), (".com.pe", "MPE"), (".com.ec", "MEC"), (".cl", "MLC")]
#: Path words that say nothing about a product.
SLUG_NOISE = ["mercadolibre", "mercadolivre", "articulo", "produto", "www", "com", "ar", "mx", "br", "co", "up", "p", "jm", "mla", "mlb", "mlm", "mlc", "mco", "mlu", "mpe", "mec"]
#: Parts of the addresses of pictures that show no product.
PLACEHOLDERS = ["logo", "sprite", "placeholder", "icon", "favicon", "/ui/", "banner"]
IMAGE_EXTENSION = r"(?i)\.(jpe?g|png|webp|gif|bmp|avif)$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(url: Column) -> Column:
    """The host in lower case, without user and port; empty where there is none."""
    authority = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def normalize_url(url: Column) -> Column:
    """Lower case, no fragment, no tracking or blank parameters, no slash at the path's end.

    Parameters are decoded, sorted by name and value, and encoded again; a malformed code stays as it is.
    """
    decoded = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    def parameters(low: Column) -> Column:
        query = F.split(F.regexp_extract(low, r"\?(.*)$", 1), "&")
        pairs = F.transform(F.filter(query, lambda p: p.rlike("^[^=]*=.+")), lambda p: F.struct(decoded(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
        kept = F.transform(F.array_sort(F.filter(pairs, lambda p: ~p["k"].isin(TRACKING))), lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"])))
        return once(F.array_join(kept, "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))

    def address(before: Column) -> Column:
        stem = F.regexp_extract(before, r"^((?:[a-z][a-z0-9+.\-]*:)?(?://[^/]*)?)", 1)
        return once(stem, lambda s: F.concat(s, F.regexp_replace(F.substring(before, F.length(s) + 1, F.length(before)), "/+$", "")))

    low = F.regexp_replace(F.regexp_replace(F.lower(url), r"^\s+|\s+$", ""), "#.*$", "")
    # each step is bound, as a branch of a condition is evaluated anew wherever it is used
    whole = once(low, lambda x: F.concat(once(F.regexp_replace(x, r"\?.*$", ""), address), F.when(F.contains(x, F.lit("?")), parameters(x)).otherwise("")))
    return F.when((url.isNull()) | (url == ""), None).otherwise(whole)


def url_similarity(a: Column, b: Column) -> Column:
    x, y = normalize_url(a), normalize_url(b)
    return F.when(x.isNotNull() & (x != "") & (x == y), 1.0).otherwise(0.0)


def detect_marketplace(url: Column) -> Column:
    at = host(url)
    out = None
    for name, needles in MARKETPLACES:
        hit = F.lit(False)
        for n in needles:
            hit = hit | at.contains(n)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def url_is_public(url: Column) -> Column:
    """http(s) with a host that is no internal name and no literal address of an internal, reserved or documentation range.

    An address in brackets is public within 2000::/3, but for its private and documentation ranges; one
    that holds an IPv4 address counts as that.
    """
    at = host(url)
    inner = F.regexp_extract(at, r"^\[(.*)\]$", 1)
    mapped = F.regexp_extract(inner, r"^(?:0*:)*:?ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    four = F.when(mapped != "", mapped).otherwise(at)
    part = lambda k: F.regexp_extract(four, r"^(\d+)\.(\d+)\.(\d+)\.(\d+)$", k).try_cast("int")
    a, b, c = part(1), part(2), part(3)
    internal = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
    )
    documented = ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    six = (inner != "") & (mapped == "")
    private6 = ~inner.rlike("^[23][0-9a-f]{3}:") | inner.rlike("^(?:2001:(?::|0?db8:|0*1?[0-9a-f]{1,2}:)|2002:|3fff:(?::|0?[0-9a-f]{1,3}:))")
    named = (at == "localhost") | at.endswith(".local") | at.endswith(".internal") | (at == "::1")
    return F.coalesce(scheme(url).isin("http", "https") & (at != "") & ~named & ~F.coalesce(internal | documented, F.lit(False)) & ~(six & private6), F.lit(False))


def _without_dots(address: Column) -> Column:
    """A path without its . and .. segments, as a browser resolves it."""
    segments = F.split(address, "/")
    folded = F.aggregate(segments, F.array().cast("array<string>"), lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x))))
    ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.array_join(ends, "/")


def absolutize_url(candidate: Column, base: Column) -> Column:
    """A picture's address made absolute; null for data:, other schemes and internal hosts."""
    c = F.trim(candidate)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*(/.*/|/)[^/]*$", 1)
    place = F.when(c.startswith("/"), c).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), c))
    resolved = F.concat(origin, _without_dots(F.regexp_extract(place, r"^([^?#]*)", 1)), F.regexp_extract(place, r"^[^?#]*(.*)$", 1))
    full = F.when(c.startswith("data:"), None).when(c.startswith("//"), F.concat(F.lit("https:"), c)).when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), c).otherwise(resolved)
    return once(full, lambda f: F.when((c != "") & url_is_public(f), f))


def looks_like_image(url: Column) -> Column:
    return path(url).rlike(IMAGE_EXTENSION)


def drop_placeholders(urls: Column) -> Column:
    return F.filter(urls, lambda u: ~F.exists(F.array(*[F.lit(p) for p in PLACEHOLDERS]), lambda p: F.contains(F.lower(u), p)))


def site_for(url: Column) -> Column:
    at, out = host(url), None
    for end, site in SITES:
        out = F.when(at.endswith(end), site) if out is None else out.when(at.endswith(end), site)
    return out.otherwise("MLA")


def market_reference(url: Column) -> Column:
    """struct(id, kind) of a marketplace address: an item named in the query, then a catalogue path, a dashed item, a bare id."""
    u = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    at = path(u)
    item = F.upper(F.regexp_extract(u, r"(?i)item_id[:=]((?:ML[A-Z]|MCO)\d{6,})", 1))
    product = F.upper(F.regexp_extract(at, r"(?i)/(?:up|p)/((?:ML[A-Z]U?|MCO)\d{6,})", 1))
    dashed = F.upper(F.concat(F.regexp_extract(at, r"(?i)/(ML[A-Z]|MCO)-?(\d{6,})", 1), F.regexp_extract(at, r"(?i)/(ML[A-Z]|MCO)-?(\d{6,})", 2)))
    bare = F.upper(F.regexp_extract(at, r"(?i)\b((?:ML[A-Z]U?|MCO)\d{6,})\b", 1))
    ref = lambda i, kind: F.struct(i.alias("id"), F.lit(kind).alias("kind"))
    return F.when(item != "", ref(item, "item")).when(product != "", ref(product, "product")).when(dashed != "", ref(dashed, "item")).when(bare.rlike(r"^ML[A-Z]U\d+$"), ref(bare, "product")).when(bare != "", ref(bare, "item"))


def name_from_slug(url: Column) -> Column:
    """The longest run of words in a hyphenated path segment (the first of equals), without noise, numbers and ids."""
    noise = F.array(*[F.lit(w) for w in SLUG_NOISE])
    useful = lambda w: (w != "") & ~w.rlike(r"^\d+$") & ~F.array_contains(noise, w) & ~w.rlike(r"^(?:ml[a-z]u?|mco)\d+$")
    segments = F.filter(F.split(F.lower(path(F.coalesce(F.try_url_decode(url), url))), "/"), lambda s: s.contains("-"))
    names = F.transform(segments, lambda s: F.array_join(F.filter(F.split(s, "-"), useful), " "))
    longest = F.aggregate(names, F.lit(""), lambda best, n: F.when(F.length(n) > F.length(best), n).otherwise(best))
    return F.substring(longest, 1, 120)


def offer_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?i)1688\.com/offer/(\d+)", 1), F.lit(""))


def short_url(url: Column) -> Column:
    """The host without www and the path, cut after 30 characters."""
    at = path(url)
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.when(F.length(at) > 30, F.concat(F.substring(at, 1, 30), F.lit("…"))).otherwise(at))


def unreachable_image(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)//(?:[^/]*\.)?example\.(?:com|org|net)"), F.lit(False))
