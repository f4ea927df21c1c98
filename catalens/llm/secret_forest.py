"""Secret scanning: pattern candidates, then a random forest that removes false positives.

DataFrame operations only. ``secret_candidates`` cuts the candidates out of whole texts with one
pattern, and ``forest_scores`` trains a forest on labelled findings and scores every candidate.
Labels come from outside the features: where no reviewed findings are given, ``planted_findings``
puts secrets and look-alikes (checksums, identifiers, placeholders, settings named after a
credential) into lines, so that what a candidate is follows from how its line was made.
``grammar_label`` is the plain rule that the forest is measured against; it decides nothing.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm._common import materialize

#: Names that introduce a credential anywhere near, for the features.
KEYWORDS = r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|auth|bearer|credential)"
#: The end of a credential's name: the word that tells it and what follows in the name ("tokens", "tokenizer" and "author" are none).
CREDENTIAL = r"(?:(?=[apstcAPSTC])(?i:token|(?:secret|passw(?:or)?d|passphrase|pwd|credential|(?:secret|api|access|private)[_\- ]?key)s?|authorization|auth|(?<=[_\-])pass)(?![a-z]))"
NAME = rf"{CREDENTIAL}[\w\-]*"
#: From a credential's name to its value: quotes, an assignment sign, perhaps a scheme; or the scheme alone.
INTRODUCED = rf"(?:{NAME}[\"'\]]{{0,2}}[ \t]{{0,8}}(?:=>|:=|=(?!=)|:)[ \t]{{0,8}}(?:(?i:bearer|basic|token)[ \t]{{1,8}})?|(?<!\w)[bB](?i:earer)[ \t]{{1,8}}(?=\S*[0-9]|\S{{20}}))[\"'`]?"
#: Prefixes that issuers give their keys.
PREFIXES = r"(?:AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk_live_|sk-|xox[abprs]-|AIza|eyJ)"
ISSUED = "^" + PREFIXES
#: What a credential's name introduces, of any length and characters: up to the closing quote, or to a blank or separator.
VALUE = r"(?:(?<=\")[^\"\n]{1,4096}(?=\")|(?<=')[^'\n]{1,4096}(?=')|[^\s\"'<>&,;]*[^\s\"'<>&,;.:!?)\]}])"
#: A key with an issued prefix, or a run of at least 16 key characters with a digit in it. A leading "name=" is no part of it.
RUN = rf"(?:{PREFIXES}[A-Za-z0-9_+/=\-]++|(?=[A-Za-z_+/=\-]*+[0-9])[A-Za-z0-9_+/=\-]{{16,}})"
#: What leads to any other candidate: names with "=" before it.
LEAD = r"(?:[A-Za-z0-9_+/\-]*+=(?=[A-Za-z0-9_+/\-])){0,8}+"
#: A candidate with what leads to it; where that ends in a credential's name, the search goes on to the name itself.
CANDIDATE = rf"(?:{INTRODUCED}{VALUE}|(?<![A-Za-z0-9_+/=\-]){LEAD}(?={RUN})(?<!{CREDENTIAL}[\w\-]{{0,64}}=){RUN})"
#: The two of them apart, tried on a match.
APART = rf"(?s)^(?:({INTRODUCED})(.+)|({LEAD})(.+))$"
#: How a value is bound to a name: an assignment sign (and a scheme) and perhaps a quote just before it.
BOUND = r"(?:[:=]>?\s*|\b(?i:bearer|basic)\s+)[\"'`]?$"
#: Values that stand for a credential or hold none: variables, placeholders, literals of languages, calls.
STAND_IN = r"^(?:[$%].*|\{\{.*|(?i:null|none|nil|true|false|undefined|str|string|required|optional|yes|no)|[xX*.]{3,}|\w[\w.]*\(.*)$"

#: What a name goes on with that holds no credential itself.
SETTING = r"(?:file|path|dir|url|uri|endpoint|expires|expiry|expiration|ttl|timeout|count|limit|length|len|min|max|size|type|name|policy|version|status|enabled|header|field|hint|format|prefix)"
QUALIFIED = rf"{CREDENTIAL}(?:[_\-][\w\-]*)?[_\-](?i:{SETTING})[\w\-]*[\"'\]]{{0,2}}[ \t]{{0,8}}(?:=>|:=|=|:)[ \t]{{0,8}}[\"'`]?$"
#: Words of placeholders, which the dictionary has beside the corpus's frequent words.
PLACEHOLDER_WORDS = "your here change changeme example placeholder default dummy sample insert replace enter value name file path user api key token secret password goes put fill todo redacted hidden".split()

FEATURES = ["length", "digits", "uppers", "symbols", "transitions", "distinct_chars", "hex_only", "vowels", "dictionary", "path_like", "assigned", "quoted", "keyword_near", "previous_length", "next_plain", "named", "qualified", "issued", "stand_in", "prose"]


def secret_candidates(docs: DataFrame, context: int = 64) -> DataFrame:
    """One row for each candidate in the whole text of each row of ``docs`` (doc_id, text, source).

    Returns doc_id, source, text_key, ordinal (from 0 in its text), candidate, left and right (up to
    ``context`` characters around it; a name that leads to it is on its left). text_key tells the text
    of a row with a null id, and is null elsewhere. A null or empty text has none; repeated rows give
    repeated candidates; other columns are ignored.
    """
    found = docs.select("doc_id", "source", text_key().alias("text_key"), "text").filter(F.col("text").rlike(CANDIDATE))
    found = found.select("doc_id", "source", "text_key", F.split("text", CANDIDATE).alias("around"), _parts("text").alias("hits"))
    one = found.select("doc_id", "source", "text_key", "around", F.posexplode("hits").alias("ordinal", "hit"))
    left = F.concat(F.get("around", F.col("ordinal")), F.col("hit.lead"))
    return one.select("doc_id", "source", "text_key", "ordinal", F.col("hit.candidate").alias("candidate"), F.right(left, F.lit(context)).alias("left"), F.left(F.get("around", F.col("ordinal") + 1), F.lit(context)).alias("right"))


def text_key() -> Column:
    """What findings of a row without an id are known by: its text's digest; null for other rows."""
    return F.when(F.col("doc_id").isNull(), F.md5(F.col("text").cast("binary")))


def _parts(text: str) -> Column:
    """The candidates of a text in order, each with what leads to it: an array of (lead, candidate)."""
    part = lambda m, k: F.regexp_extract(m, APART, k)
    return F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda m: F.struct(F.concat(part(m, 1), part(m, 3)).alias("lead"), F.concat(part(m, 2), part(m, 4)).alias("candidate")))


def common_words(docs: DataFrame, n: int = 400, min_length: int = 4) -> list[str]:
    """The ``n`` most frequent lower-case words of all texts that occur more than once (ties in word order); the list is bounded by ``n``."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"[a-z]{{{min_length},}}"), F.lit(0))).alias("word"))
    return [r["word"] for r in words.groupBy("word").count().filter("count > 1").orderBy(F.desc("count"), "word").limit(n).collect()]


def finding_features(found: DataFrame, words: list[str]) -> DataFrame:
    """Add the forest's features: length, character transitions, dictionary coverage, path and neighbouring words."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.length("candidate").cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "B"), "[^0aB]", "-")
    share = lambda chars: (n - F.length(F.regexp_replace("candidate", chars, ""))) / n
    flag = lambda x: x.cast("double")
    covered = F.lit(0.0) if not words else 1.0 - F.length(F.regexp_replace(low, "|".join(sorted(words, key=lambda w: (-len(w), w))), "")) / n
    previous = F.regexp_extract("left", r"(\S+)\s*[\"':=\s]*$", 1)
    return found.select(
        "*",
        n.alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("uppers"),
        share("[^A-Za-z0-9]").alias("symbols"),
        # runs of one kind of character, by the length
        (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n).alias("transitions"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / n).alias("distinct_chars"),
        flag(low.rlike("^[0-9a-f]+$")).alias("hex_only"),
        share("[aeiouAEIOU]").alias("vowels"),
        covered.cast("double").alias("dictionary"),
        flag(c.contains("/") | F.col("left").rlike(r"[/@.]$") | F.col("right").rlike(r"^[/@.]\w")).alias("path_like"),
        flag(F.col("left").rlike(BOUND)).alias("assigned"),
        flag(F.col("left").rlike("[\"']$") & F.col("right").rlike("^[\"']")).alias("quoted"),
        flag(F.col("left").rlike(KEYWORDS)).alias("keyword_near"),
        F.length(previous).cast("double").alias("previous_length"),
        flag(F.col("right").rlike(r"^\s+[a-z]")).alias("next_plain"),
        flag(F.col("left").rlike(INTRODUCED + "$")).alias("named"),
        flag(F.col("left").rlike(QUALIFIED)).alias("qualified"),
        flag(_issued(c)).alias("issued"),
        flag(c.rlike(STAND_IN)).alias("stand_in"),
        flag(_prose(c, F.col("left"), F.col("right"))).alias("prose"),
    )


def _issued(candidate: Column) -> Column:
    return candidate.rlike(ISSUED) & (F.length(candidate) >= 16) & candidate.rlike("[0-9A-Z]")


def _prose(candidate: Column, left: Column, right: Column) -> Column:
    """A plain word that a sentence goes on from."""
    return candidate.rlike("^[A-Z]?[a-z]+$") & left.rlike(r"\s$") & right.rlike(r"^[,.;:!?]?\s+[A-Za-z]")


def grammar_label(candidate: Column, left: Column, right: Column) -> Column:
    """What a plain rule says of a finding: 1 for an issued prefix or a value bound to a credential's name, 0 for
    all-digit numbers, parts of addresses and paths, stand-ins, a plain word that prose goes on from, and
    words with neither; null between.
    """
    named = left.rlike(INTRODUCED + "$")
    issued, prose = _issued(candidate), _prose(candidate, left, right)
    unnamed = ~issued & ~left.rlike(KEYWORDS) & ~left.rlike(BOUND)
    address = left.rlike(r"[/@.]$") | right.rlike(r"^[@.]\w") | (candidate.rlike(r"^[0-9]+$") & ~named)
    return F.when(named & (prose | candidate.rlike(STAND_IN)), 0.0).when(named & candidate.rlike(r"\s"), None).when(issued | named, 1.0).when(address | unnamed, 0.0)


#: Lines that planted values are put into ({n}: a credential's name, {v}: the value, {w}: a word, {d}: a number).
NAMES = ["token", "api_key", "apikey", "secret_key", "password", "passwd", "client_secret", "clientSecret", "access_token", "DB_PASSWORD", "AWS_SECRET_ACCESS_KEY", "auth_token", "config.api_key", "SECRET"]
NAMED = ['{n} = "{v}"', "{n}={v}", "{n}: {v}", '"{n}": "{v}",', "export {n}={v}", "{n}={v}\nHOST={w}", "{n} = '{v}'", "get https://{w}.example.com/x?page={d}&{n}={v}&y=1 now", "{w} {w} {n} = \"{v}\" {w} {w}", "{w} {n}={v} {w}", "Authorization: Bearer {v}", "{n}: {v} {w}"]
ANYWHERE = ["an id {v} alone", "id={v}", "{w} {v}, {w}", "key {v}", '"{v}"', "{v}", *NAMED]
BARE = ["commit {v}", "sha256: {v}", "checksum {v} of the file", "id={v}", "uuid {v}", '{w} "{v}" {w}', "etag: \"{v}\"", "{w} {v} {w}", "integrity=sha384-{v}", "author={w}.{v}", "digest = \"{v}\"", "build_{v}", "https://{w}.example.com/{w}/{v}", "{w}{d}.{v}@mail{d}.example.com", "see https://a.example.com/path/{d}/{w}-{v}-{w} and go", "{w} {v}.", "parent: '{v}'"]
SETTINGS = ["{n}_file={v}", "{n}_path: {v}", "{n}_url = \"{v}\"", "{n}_expires_in={v}", "{n}_type: {v}", "{n}_min_length={v}", '"{n}_name": "{v}",', "{n}_ttl = {v}", "{n}-policy: {v}", "{n}_count: {v}"]
SENTENCES = ["the {n}: {v} {w} {w}", "a {n}: {v} is {w}", "your {n}: {v}, {w} {w}"]


def planted_findings(spark: SparkSession, n: int = 12_000) -> DataFrame:
    """Candidates of ``n`` lines with planted values, as ``secret_candidates`` gives them, with their ``label``.

    Half of the lines hold a secret (random characters in a credential's place, or a key with an
    issued prefix anywhere); the others hold look-alikes. Only a planted secret has label 1.
    """
    i = F.col("id")
    pick = lambda values, salt: F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(values))).cast("int"))
    digest = F.sha2(F.concat(F.lit("planted "), i.cast("string")).cast("binary"), 512)
    hexes, length = lambda k: F.substring(digest, 1, k), F.pmod(F.xxhash64(i, F.lit("length")), F.lit(40)).cast("int")
    alnum = F.regexp_replace(F.base64(F.unhex(digest)), r"[+/=\s]", "")
    letters = F.translate(digest, "0123456789", "ghijklmnop")
    upper = F.upper(F.translate(alnum, "01", "ab"))
    cut = lambda c, least, most: F.substr(c, F.lit(1), least + length % (most - least + 1))
    number = F.abs(F.xxhash64(i)).cast("string")
    uuid = F.regexp_replace(hexes(32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    word = lambda salt: pick(["status", "report", "module", "river", "quick", "update", "green", "table", "music", "north"], salt)
    random = [hexes(40), hexes(64), hexes(32), F.upper(hexes(40)), cut(alnum, F.lit(16), 44), cut(alnum, F.lit(16), 44), cut(letters, F.lit(1), 10), cut(letters, F.lit(1), 10), cut(alnum, F.lit(4), 12), F.concat(cut(alnum, F.lit(3), 8), F.lit("!"), F.substring(letters, 20, 5), F.lit("$")), F.concat(F.substring(alnum, 1, 13), F.lit("/"), F.substring(alnum, 20, 7), F.lit("/"), F.substring(alnum, 30, 18)), F.concat(F.initcap(F.substring(letters, 1, 5)), F.initcap(F.substring(letters, 8, 6)), F.substring(letters, 20, 5))]
    issued = [F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(alnum, 1, 24)), F.concat(F.lit("xoxb-"), F.substring(number, 1, 12), F.lit("-"), F.substring(alnum, 1, 24)), F.concat(F.lit("AIza"), F.substring(alnum, 1, 35)), F.concat(F.lit("glpat-"), F.substring(alnum, 1, 20)), F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 1, 16)))]
    plain = [hexes(40), hexes(64), hexes(32), uuid, F.substring(number, 1, 16), F.substring(number, 1, 18), cut(alnum, F.lit(24), 60), F.concat(word("a"), F.lit("-"), F.substring(number, 1, 6), F.lit("-"), word("b"), F.lit("-"), word("c")), F.concat(word("a"), F.lit("_"), word("b"), F.lit("_"), F.substring(number, 1, 7)), F.concat(F.lit("2024-01-"), F.substring(number, 1, 8), F.lit("-"), word("a"))]
    stand_ins = ["YOUR_API_KEY_HERE", "changeme", "your-token-here", "your_secret_key", "insert_password_here", "example-secret", "default_password", "xxxxxxxxxxxxxxxx", "********", "None", "null", "true", "$TOKEN", "${SECRET_KEY}", "{{ api_key }}", "<token>", "required", "string", "placeholder", "enter-your-key-here", "put_your_password_here", "sample_token_value", "secret", "password", "get_token()", "os.environ('KEY')"]
    settings = [F.concat(F.lit("/run/secrets/"), word("a")), F.concat(F.lit("https://"), word("a"), F.lit(".example.com/"), word("b")), F.substring(number, 1, 4), F.substring(number, 1, 2), F.lit("bearer"), F.concat(word("a"), F.lit("-"), word("b")), F.lit("strict"), F.concat(F.lit("/etc/"), word("a"), F.lit("/"), word("b"), F.lit(".pem"))]
    words = ["never", "always", "keep", "open", "what", "nothing", "more", "plain", "simple", "hidden"]
    kind = F.pmod(i, F.lit(10)).cast("int")
    by_kind = lambda secret, key, look, holder, setting, prose: F.when(kind < 3, secret).when(kind < 5, key).when(kind < 7, look).when(kind == 7, holder).when(kind == 8, setting).otherwise(prose)
    rows = spark.range(n).select(
        i.alias("doc_id"),
        F.lit("planted").alias("source"),
        by_kind(pick(NAMED, "t"), pick(ANYWHERE, "t"), pick(BARE, "t"), pick(NAMED, "t"), pick(SETTINGS, "t"), pick(SENTENCES, "t")).alias("line"),
        by_kind(pick(random, "v"), pick(issued, "v"), pick(plain, "v"), pick(stand_ins, "v"), pick(settings, "v"), pick(words, "v")).alias("value"),
        pick(NAMES, "n").alias("name"),
        word("w").alias("word"),
        F.substring(number, 3, 4).alias("number"),
        (kind < 5).alias("secret"),
    )
    line = F.col("line")
    for mark, column in (("{n}", "name"), ("{w}", "word"), ("{d}", "number"), ("{v}", "value")):
        line = F.replace(line, F.lit(mark), F.col(column))
    rows = rows.withColumn("text", line)
    truth = rows.select(F.col("doc_id").alias("__id"), "secret", "value")
    found = secret_candidates(rows).join(F.broadcast(truth), F.col("doc_id") == F.col("__id"))  # n rows
    return found.withColumn("label", (F.col("secret") & (F.col("candidate") == F.col("value"))).cast("int")).drop("__id", "secret", "value")


def forest_scores(findings: DataFrame, labelled: DataFrame, trees: int = 40, depth: int = 10, seed: int = 7) -> DataFrame:
    """Score every finding with a forest fitted on ``labelled`` (the features and a 0/1 ``label``).

    Adds score (share of trees' votes for a secret). Where the labels hold one class only, there is
    nothing to learn and the score is that class; without any label it is 0.
    """
    train = materialize(labelled.select(*FEATURES, F.col("label").cast("double").alias("label")), "findings-train")
    classes = [r["label"] for r in train.select("label").distinct().collect()]
    if len(classes) < 2:
        return findings.withColumn("score", F.lit(float(classes[0]) if classes else 0.0))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="__x")
    forest = RandomForestClassifier(featuresCol="__x", labelCol="label", probabilityCol="__p", predictionCol="__y", rawPredictionCol="__r", numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(assemble.transform(train))
    return model.transform(assemble.transform(findings)).withColumn("score", F.get(vector_to_array("__p"), F.lit(1))).drop("__x", "__p", "__y", "__r")


def scan_secrets(docs: DataFrame, threshold: float = 0.4, n_words: int = 400, labelled: DataFrame | None = None) -> DataFrame:
    """All candidates of ``docs`` with the forest's verdict.

    Returns doc_id, source, text_key, ordinal, candidate, left, right, the features, score and
    is_secret (score >= ``threshold``). ``labelled`` may give reviewed findings (the columns of
    ``secret_candidates`` and ``label``); else ``planted_findings`` trains the forest. Texts without
    candidates, null and empty ones give no rows; an empty table none. Repeated rows give repeated
    findings, rows with a null id are told apart by text_key, and other columns are ignored,
    whatever their names.
    """
    words = sorted({*common_words(docs, n_words), *PLACEHOLDER_WORDS})
    findings = materialize(finding_features(secret_candidates(docs), words), "findings")
    train = finding_features(planted_findings(docs.sparkSession) if labelled is None else labelled, words)
    return forest_scores(findings, train).withColumn("is_secret", F.col("score") >= threshold)


def redact_secrets(docs: DataFrame, findings: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every secret of ``findings`` (doc_id, text_key, candidate, is_secret) replaced in its document's text.

    A secret is replaced where it is a candidate, and one that can't be taken for a word (16
    characters, or 8 with other than letters) wherever it stands; longer ones go first, so that one
    inside another leaves no rest. Documents without secrets stay as they are. Rows of one id
    share their secrets; rows with a null id have those of their own text.
    """
    secrets = findings.filter("is_secret").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).agg(F.collect_set("candidate").alias("__found"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & text_key().eqNullSafe(F.col("__text"))
    cut = F.zip_with(F.split("text", CANDIDATE), _parts("text"), lambda a, p: F.concat(a, F.when(p.isNull(), "").otherwise(F.concat(p["lead"], F.when(F.array_contains("__found", p["candidate"]), mark).otherwise(p["candidate"])))))
    long = F.filter("__found", lambda c: (F.length(c) >= 16) | ((F.length(c) >= 8) & c.rlike("[^A-Za-z]")))
    ordered = F.transform(F.array_sort(F.transform(long, lambda c: F.struct((-F.length(c)).alias("n"), c.alias("c")))), lambda s: s["c"])
    clean = F.aggregate(ordered, F.array_join(cut, ""), lambda t, c: F.replace(t, c, F.lit(mark)))
    return docs.join(secrets, same, "left").withColumn("text", F.when(F.col("__found").isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)
