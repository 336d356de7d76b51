"""Secret scan: wide candidate patterns, then a random forest that removes false positives; DataFrame functions only.

Candidates are, at any place of a word, all runs of 12 or more key-like characters, the parts of such a run between dots
and slashes, and whatever is assigned to a telling name, of any length and with any punctuation, or stands as the password
of a URL. Their features are length, transitions between kinds of characters, digits, symbols and distinct characters,
coverage by dictionary words, the path (``source``), the text on both sides in the word, and the neighbouring words. A
random forest is trained from labelled findings; its trees become one SQL expression that is evaluated row by
row, so that scanning shuffles nothing.

``labelled_findings`` gives a bounded training table made by rule from public key formats and from common look-alikes
(digests, identifiers, dates, numbers, paths, placeholders); any table with the same columns can be given instead.

Defined cases: null and empty texts have no candidates; a null path counts as empty; repeated rows are scanned one by
one; a value that occurs several times is a candidate at each place, and redaction replaces all its occurrences, those of
a value under 12 characters only outside longer runs of letters and digits. Values end at white space, so of a passphrase with blanks only the word
beside the name is a candidate.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import stage

#: Labelled findings that the forest is trained from.
FINDINGS = 6000
TREES, DEPTH, SEED = 24, 6, 7
THRESHOLD = 0.5
MASK = "[SECRET]"

SPACES = r"[ \t\n\x0B\f\r]+"
RUN = r"[A-Za-z0-9+/_.\-]{12,}(?:={1,2}(?![A-Za-z0-9+/_.\-\"'=]))?"

# Openings of keys that services give out.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "npm_", "SG.", "hf_")

# Words that stand beside secrets, and words beside harmless look-alikes.
TELLING = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "auth", "bearer", "credential", "access", "private")
HARMLESS = ("sha", "sha1", "sha256", "md5", "digest", "checksum", "commit", "uuid", "guid", "id", "isbn", "version", "order", "invoice", "phone", "tel", "call", "card", "iban", "account", "date", "hash", "revision", "etag", "serial", "ticket")

#: A telling name and what joins it to its value, and a URL's user; both up to the value.
NAMED = "(?i:" + "|".join(TELLING) + r")[A-Za-z0-9_\-]*[\"'\\]*[=:]+[\"'\\]*"
USER = r"://[^\s/:@]*:(?=[^\s/@]+@)"

#: A value after those: it ends at a quote, at markup and at the next name of a list, and leaves closing punctuation out.
GIVEN = r"(?:[^\s\"'<&,;@\\]++|<(?![/!A-Za-z])|[&,;](?!(?:amp;)?[\"']?[A-Za-z0-9_.\-]+[\"']?[=:])|@(?![A-Za-z0-9\-]+\.[A-Za-z])|\\(?![\"']))*+"
CLOSING = ".,;:)]}>"

#: The end of the text before a value that a telling name introduces.
INTRODUCED = "(?i)(" + "|".join(TELLING) + r")[a-z0-9_\-]*[\"'\\]*(\s*[=:]+|\s+(is|was))\s*[\"'\\(\[{]*$"

# Fragments of ordinary words, names and placeholders that random keys rarely hold.
DICTIONARY = (
    "about access account action address admin after amount api apple application archive article bank base before between black "
    "blue board body book build button cache call camera card center change charge check city class clean client close cloud code "
    "color comment common company config content control copy core count country course create current customer data date default "
    "demo design device direct document domain done draft dummy edit email empty energy engine error event example export fake "
    "family file final first folder form format free friend from full function game general global good green group guide hand "
    "head health help here high history home hour house html http image index info input insert install item java key language "
    "large last left level library light line link list live local login long mail main manage market master media member menu "
    "message method mobile model money month more music name national need network news next night node none note number office "
    "online open option order other page paper parent party password path people person phone photo picture place placeholder plan "
    "player point policy post power price print private process product profile program project public question random read "
    "record red release remote report request research response result return review right road room root sample save school "
    "science script search second secret section security select send server service session set shop short show simple site size "
    "small social source space sport staff standard start state station status step stock store story street string student style "
    "system table target task team test text theme time title token tool total town trade train type under unit update upload user "
    "value version video view water week white window word work world write xxxx year your"
).split()

# Syllables of long words in English, French, German and Spanish, some rich in consonants.
SOUNDS = (
    "th", "nd", "st", "sh", "wh", "nt", "ing", "tion", "ent", "hat", "sch", "ung", "keit", "pf", "tz", "cht", "eur", "elle",
    "que", "oux", "ente", "leur", "los", "das", "ado", "cion", "rro", "lla", "ver", "ein", "hes", "ou",
)

# Syllables of ordinary long words.
SYLLABLES = ("con", "ta", "ri", "ment", "in", "ter", "na", "de", "vel", "op", "re", "spon", "si", "bil", "per", "for", "man", "ver", "un", "ge", "ful", "ba", "lo", "mo", "ques", "ca", "li", "tro", "pe", "ness")

FEATURES = ("length", "transitions", "digits", "uppers", "distinct", "covered", "hex", "numeric", "uuid", "prefix", "assigned", "telling", "harmless", "test_path", "placeholder", "dotted", "symbols", "consonants")


def _any(words: tuple[str, ...]) -> str:
    return "(?i)(^|[^a-z0-9])(" + "|".join(words) + ")s?([^a-z0-9]|$)"


def _share(value: Column, pattern: str) -> Column:
    kept = F.length(F.regexp_replace(value, F.lit(pattern), F.lit("")))
    return (F.length(value) - kept) / F.greatest(F.length(value), F.lit(1))


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("double")


def features(c: Column, near: Column, ahead: Column, path: Column) -> list[Column]:
    """Features of a candidate; ``near`` holds the neighbouring words, ``ahead`` those of them that stand before it."""
    value, before = c["value"], c["before"]
    kinds = F.regexp_replace(value, "[a-z]", "l")
    for pattern, letter in (("[A-Z]", "u"), ("[0-9]", "d"), ("[^lud]", "o")):
        kinds = F.regexp_replace(kinds, pattern, letter)
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    length = F.length(value).cast("double")
    found = {
        "length": length,
        "transitions": (runs - 1) / length,
        "digits": _share(value, "[0-9]+"),
        "uppers": _share(value, "[A-Z]+"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / length,
        "covered": _share(F.lower(value), "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"),
        "hex": _flag(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$")),
        "numeric": _flag(value.rlike(r"^[0-9.\-/+_]+$")),
        "uuid": _flag(value.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        "prefix": _flag(value.rlike("^(" + "|".join(p.replace(".", r"\.") for p in PREFIXES) + ")")),
        "assigned": _flag(F.concat_ws(" ", ahead, before).rlike(INTRODUCED) | (before.rlike("[A-Za-z0-9_.]:$") & c["after"].startswith("@"))),
        "telling": _flag(near.rlike(_any(TELLING))),
        "harmless": _flag(F.concat_ws(" ", near, before).rlike(_any(HARMLESS))),
        "test_path": _flag(path.rlike("(?i)(test|example|sample|fixture|demo|mock|docs?)([^a-z]|$)")),
        "placeholder": _flag(value.rlike(r"(?i)(example|your|placeholder|changeme|dummy|fake|sample|xxxx|\.\.\.|1234567|abcdef)")),
        "dotted": _share(value, r"[./]+"),
        "symbols": _share(value, r"[^A-Za-z0-9+/_.\-]+"),
        "consonants": _share(F.lower(value), "[bcdfghjklmnpqrstvwxz]{4,}"),
    }
    return [F.coalesce(found[name].cast("double"), F.lit(0.0)).alias(name) for name in FEATURES]


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """word, near, path, label: ``n`` findings made by rule from a hash of their number.

    The cases are worked out inside one function over an array, which Spark interprets, and only the one that a row takes:
    as plain columns they made some 24,000 lines of generated code, too many to compile.
    """
    seed = F.col("id").cast("string")
    hexes = F.sha2(F.concat(seed, F.lit("x")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(seed, F.lit("m")), 512))), "[^A-Za-z0-9]", "")
    uppers = F.regexp_replace(F.upper(mixed), "[^A-Z2-7]", "")
    numbers = F.regexp_replace(F.concat(hexes, F.sha2(hexes, 256)), "[a-f]", "")
    pick = lambda words, salt: F.element_at(
        F.array(*[F.lit(w) for w in words]), (F.abs(F.xxhash64("id", F.lit(salt))) % len(words) + 1).cast("int")
    )
    word, glue = pick(DICTIONARY, "w"), pick(["_", "-", "", "."], "g")
    plain = pick(["", "the", "of", "and", "see", "le", "und", "para", "is"], "n")
    said = F.concat_ws(" ", plain, pick(TELLING, "t"), pick(["=", ":", "is", ""], "e"))
    beside = F.concat_ws(" ", plain, pick(HARMLESS, "h"), pick([":", "is", "", "#"], "e"))
    cut = lambda text, size: F.substring(text, 1, size)
    prefix = pick([p for p in PREFIXES if p not in ("AKIA", "ASIA")], "p")
    digits = lambda a, b: F.substring(numbers, a, b)
    letters = F.regexp_replace(F.concat(mixed, F.base64(F.unhex(F.sha2(F.concat(seed, F.lit("l")), 512)))), "[^A-Za-z]", "")
    syllable = lambda salt: pick(SYLLABLES, salt)
    ordinary = F.concat(*[syllable(f"s{k}") for k in range(4)], pick(["", "s", "ing", "tion", "ly", "al"], "f"))
    spoken = F.concat(*[pick(SOUNDS, f"o{k}") for k in range(4)], pick(["", *SOUNDS], "o4"), pick(["", *SOUNDS], "o5"))
    ended = pick(["", "", ".", ",", ":", "!"], "d")
    symbol = lambda salt: pick(["!", "#", "$", "%", "*", "?", "^", "~"], salt)
    named = F.concat(pick(TELLING, "a"), pick(["=", ":", '="', '":"'], "j"))
    joint = pick(["-", "_", "/", "."], "b")
    close = pick(["", '"', "'"], "c")
    positives = [
        (F.concat(pick(["AKIA", "ASIA"], "k"), cut(uppers, 16)), plain),
        (F.concat(prefix, cut(mixed, 36)), plain),
        (F.concat(pick(TELLING, "a"), F.lit("="), cut(hexes, 18)), plain),
        (F.concat(pick(TELLING, "a"), F.lit("="), cut(mixed, 24)), plain),
        (F.concat(F.lit('"'), cut(hexes, 40), F.lit('"')), said),
        (F.concat(F.lit('"'), cut(mixed, 40), F.lit('"')), said),
        (cut(mixed, 32), said),
        (F.concat(pick(["AKIA", "ASIA"], "k"), cut(F.regexp_replace(uppers, "[2-7]", "Q"), 16)), plain),
        (F.concat(named, cut(letters, 24)), plain),
        (cut(letters, 32), said),
        (F.concat(named, cut(mixed, 7), symbol("p"), digits(1, 2), symbol("q"), close), plain),
        (F.concat(named, word, symbol("p"), digits(1, 3), symbol("q"), close), plain),
        (F.concat(cut(mixed, 6), symbol("p"), digits(1, 2)), F.concat_ws(" ", plain, pick(TELLING, "t"), pick(["=", ":"], "e"))),
    ]
    negatives = [
        (cut(hexes, 40), beside),
        (cut(hexes, 32), beside),
        (hexes, plain),
        (F.concat_ws("-", cut(hexes, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), pick(["", "id", "uuid", "key"], "u")),
        (cut(numbers, 16), F.coalesce(beside, plain)),
        (F.concat_ws("-", digits(1, 4), digits(5, 4), digits(9, 4), digits(13, 4)), plain),
        (F.concat(F.lit("+"), digits(1, 2), F.lit("-"), digits(3, 3), F.lit("-"), digits(6, 7)), plain),
        (F.concat(F.lit("20"), digits(1, 2), F.lit("-"), digits(3, 2), F.lit("-"), digits(5, 2), F.lit("T"), digits(7, 6)), plain),
        (F.concat(word, glue, pick(DICTIONARY, "v"), glue, pick(DICTIONARY, "y"), digits(1, 2)), plain),
        (F.concat(pick(TELLING, "a"), F.lit("="), pick(["changeme_123456", "your_password_1", "example_key_123456", "xxxxxxxxxxxxxxxx1", "placeholder_0001"], "c")), plain),
        (F.concat(F.lit("/"), word, F.lit("/"), pick(DICTIONARY, "v"), F.lit("/"), digits(1, 5)), plain),
        (F.concat(F.lit("img_"), digits(1, 8), F.lit("_"), digits(9, 6), F.lit(".jpg")), plain),
        (F.concat(word, digits(1, 3), pick(DICTIONARY, "v"), digits(4, 3)), said),
        (ordinary, plain),
        (ordinary, said),
        (spoken, plain),
        (F.concat(F.upper(spoken), ended), plain),
        (F.concat(F.upper(spoken), ended), F.upper(F.concat_ws(" ", plain, pick(SOUNDS, "o6")))),
        (F.concat(F.upper(ordinary), ended), plain),
        (F.concat(F.upper(spoken), F.lit("-"), F.upper(ordinary), ended), plain),
        (F.concat(F.initcap(spoken), ended), said),
        (F.concat(ordinary, joint, word, joint, pick(DICTIONARY, "v")), plain),
        (F.concat(F.initcap(word), F.initcap(pick(DICTIONARY, "v")), F.initcap(ordinary)), plain),
        (F.concat(named, pick(DICTIONARY, "v"), close), plain),
        (F.concat(named, ordinary, close), plain),
        (F.concat(named, digits(1, 2)), plain),
        (F.concat(pick(DICTIONARY, "v"), pick(["", ",", ".", "!", "?"], "z")), F.concat_ws(" ", plain, pick(TELLING, "t"), pick(["=", ":", "is"], "e"))),
    ]
    kind = F.col("id") % (2 * len(positives) * len(negatives))
    is_secret = kind % 2 == 0
    half = F.floor(F.col("id") / 2)

    def of(cases: list, k: Column) -> Column:
        chosen = F
        for i, (word_of, near_of) in enumerate(cases):
            chosen = chosen.when(k % len(cases) == i, F.struct(word_of.alias("word"), near_of.alias("near")))
        return chosen

    made = F.when(is_secret, of(positives, half)).otherwise(of(negatives, half))
    path = pick(["", "src0", "web", "tests/config", "examples", "app/settings", "crawl"], "path")
    finding = lambda label: F.struct(made.alias("made"), path.alias("path"), label.alias("label"))
    found = spark.range(n).select(_let(is_secret.cast("double"), finding).alias("f"))
    return found.select(F.col("f.made.word").alias("word"), F.col("f.made.near").alias("near"), "f.path", "f.label")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def candidates(word: Column, ahead: Column) -> Column:
    """All candidates of a word: value, and the text ``before`` (with the name in front) and ``after`` it in the word.

    ``ahead`` holds the words in front. What it introduces or a name in the word assigns comes last.
    """
    place = lambda value, before, after: F.struct(value.alias("value"), before.alias("before"), after.alias("after"))
    none = F.array().cast("array<struct<value:string,before:string,after:string>>")
    get = lambda items, k: F.coalesce(F.get(items, k), F.lit(""))

    def cut(found: Column) -> Column:
        runs, gaps = found["runs"], found["gaps"]
        return F.transform(runs, lambda v, k: place(v, F.concat(get(runs, k - 1), get(gaps, k)), get(gaps, k + 1)))

    def parts(c: Column) -> Column:
        def each(of: Column) -> Column:
            at = lambda k: F.when(k == 0, c["before"]).otherwise(F.concat(get(of, k - 1), F.lit("/")))
            ends = lambda k: F.when(k == F.size(of) - 1, c["after"]).otherwise(F.lit("/"))
            return F.filter(F.transform(of, lambda v, k: place(v, at(k), ends(k))), lambda p: F.length(p["value"]) >= 12)

        return F.when(c["value"].rlike("[./]"), _let(F.split(c["value"], "[./]"), each)).otherwise(none)

    runs = _let(F.struct(F.regexp_extract_all(word, F.lit(RUN), F.lit(0)).alias("runs"), F.split(word, RUN).alias("gaps")), cut)
    long = F.when(F.octet_length(word) >= 12, _let(runs, lambda r: F.concat(r, F.flatten(F.transform(r, parts))))).otherwise(none)
    opening = f"(?:{NAMED}|{USER})"
    group = lambda k: F.regexp_extract_all(word, F.lit(f"({opening})({GIVEN})"), F.lit(k))
    ends = lambda name: F.when(name.startswith("://"), F.lit("@")).otherwise(F.lit(""))
    given = F.zip_with(group(1), group(2), lambda name, v: place(F.rtrim(v, F.lit(CLOSING)), name, ends(name)))
    bare = F.rtrim(F.regexp_extract(word, r"^[\"'(\[{\\]*(" + GIVEN + ")", 1), F.lit(CLOSING))
    introduced = F.when(ahead.rlike(INTRODUCED) & (bare != ""), F.array(place(bare, F.lit(""), F.lit("")))).otherwise(none)
    named = F.concat(F.when(word.rlike("[=:]"), F.filter(given, lambda g: g["value"] != "")).otherwise(none), introduced)
    # a run that a name gives too is kept once, with its name
    return _let(named, lambda n: F.concat(F.filter(long, lambda c: ~F.exists(n, lambda g: g["value"] == c["value"])), n))


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """The forest from labelled findings (word, near, path, label); a word's last candidate is the one that is labelled."""
    near, path = F.coalesce("near", F.lit("")), F.coalesce("path", F.lit(""))
    given = stage(findings.select("word", near.alias("near"), path.alias("path"), "label").filter(F.col("word").isNotNull()), "findings")
    found = stage(given.withColumn("c", F.try_element_at(candidates(F.col("word"), F.col("near")), F.lit(-1))), "finding-values")
    table = found.filter(F.col("c").isNotNull()).select(*features(F.col("c"), F.col("near"), F.col("near"), F.col("path")), "label")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(table).select("x", "label")
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt"
    )
    return forest.fit(vectors)


def forest_sql(model: RandomForestClassificationModel, of: str) -> str:
    """The forest's probability of a secret as SQL over the fields of ``of``."""

    def branch(node) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            harmless, secret = node.impurityStats().stats()
            return repr(secret / (harmless + secret))
        split = node.split()
        test = f"{of}.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D"
        return f"CASE WHEN {test} THEN {branch(node.leftChild())} ELSE {branch(node.rightChild())} END"

    trees = [f"CAST({branch(tree._call_java('rootNode'))} AS DOUBLE)" for tree in model.trees]
    return f"(({' + '.join(trees)}) / {len(trees)})"


def scan(
    docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD, name: str = "findings"
) -> DataFrame:
    """``docs`` with every candidate's place (word from 0), value, score and verdict as column ``name``.

    A column of that name is replaced.
    """
    spark = docs.sparkSession
    model = train(labelled_findings(spark) if findings is None else findings)
    text = F.coalesce(F.col("text"), F.lit(""))
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")

    def found_in(words: Column) -> Column:
        word_at = lambda k: F.coalesce(F.get(words, k), F.lit(""))

        def at(word: Column, k: Column) -> Column:
            ahead = F.concat_ws(" ", word_at(k - 2), word_at(k - 1))
            near = F.concat_ws(" ", ahead, word_at(k + 1))
            each = lambda c: F.struct(
                k.alias("place"), c["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after"),
                near.alias("near"), ahead.alias("ahead"),
            )
            introduced = word_at(k - 1).rlike(r"(?i)([=:][\"'(\[{\\]*|^is|^was)$")
            likely = (F.octet_length(word) >= 12) | word.rlike("[=:]") | introduced
            return F.when(likely, F.transform(candidates(word, ahead), each))

        return F.flatten(F.array_compact(F.transform(words, at)))

    found = docs.select("*", path.alias("__path"), _let(F.split(text, SPACES), found_in).alias("__found"))
    measured = F.transform(
        "__found",
        lambda c: F.struct(c["place"].alias("place"), c["value"].alias("value"), *features(c, c["near"], c["ahead"], F.col("__path"))),
    )
    score = forest_sql(model, "c")
    scored = f"transform(__measured, c -> named_struct('place', c.place, 'value', c.value, 'score', {score}))"
    judged = f"transform(__scored, c -> named_struct('place', c.place, 'value', c.value, 'score', c.score, 'secret', c.score >= {threshold}D))"
    out = found.withColumn("__measured", measured).withColumn("__scored", F.expr(scored))
    others = [f"`{c}`" for c in docs.columns if c != name]
    return out.select(*others, F.expr(judged).alias(name))


def list_findings(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row a candidate: doc_id, place, length and SHA-256 of the value, score, and whether it is kept as a secret."""
    scanned = scan(docs, findings).select("doc_id", F.inline("findings"))
    return scanned.select(
        "doc_id",
        F.col("place").cast("long").alias("place"),
        F.length("value").alias("length"),
        F.sha2("value", 256).alias("value_sha256"),
        F.round("score", 6).alias("score"),
        "secret",
    )


def redact(docs: DataFrame, findings: DataFrame | None = None, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret's value replaced in the text, longest first; all rows stay."""
    scanned = scan(docs, findings, name="__findings")
    kept = F.transform(F.filter("__findings", lambda f: f["secret"]), lambda f: f["value"])
    longest = F.sort_array(F.transform(F.array_distinct(kept), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))), False)
    quoted = lambda v: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    clean = F.aggregate(longest, F.col("text"), lambda t, v: F.when(v["n"] >= 12, F.replace(t, v["v"], F.lit(mask))).otherwise(F.regexp_replace(t, quoted(v["v"]), F.lit(mask))))
    return scanned.withColumn("text", clean).select(*[f"`{c}`" for c in docs.columns])
