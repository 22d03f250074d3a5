"""Secret scans: candidate strings, and a random forest that removes the false positives.

Candidates are whole runs of the characters of keys, tokens, encodings and passwords. A run is looked at if it has LONG
characters and a digit, or SHORT characters and stands after an assignment sign or a secret word; the name on the left of
an assignment is never part of it. Each candidate is described by its length, its transitions between kinds of characters,
the share of it that dictionary words cover, whether it is part of a path, and the words next to it. A random forest,
trained on labelled findings, gives the probability of a secret.

Findings are labelled by sentence: a text and the secret in it, or none. The same candidate search runs over the
sentences, so that the forest learns on what the scan can propose. The corpus has no labels of this kind: by default
SENTENCES sentences are made by rule (the bound on the fit), and accuracy() measures formats that were left out. Scanning
covers all rows and whole texts and runs in built-in functions and the JVM's forest only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .spans import spans

LONG, SHORT = 16, 8
#: Characters before and after a candidate that are looked at.
NEAR = 32
SENTENCES = 6000
TREES, DEPTH, SEED = 32, 9, 17
THRESHOLD = 0.5
SECRET_WORDS = "token|secret|password|passwd|pwd|passphrase|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key"
OTHER_WORDS = "commit|sha1|sha256|md5|hash|checksum|digest|uuid|guid|revision|etag|version|order|isbn|path|url|href|src|file"
PLACEHOLDERS = "(your|example|sample|change|placeholder|dummy|insert|xxx|redacted|todo|(.)\\2{5})"
_LETTERS = "A-Za-z_+/.~!@#$%^&*-"
_RUN = f"[0-9{_LETTERS}]"
#: Starts at the start of a run; what it asks before the run looks back a bounded way.
CANDIDATE = (
    rf"(?<!{_RUN})(?={_RUN}{{{SHORT}}})(?:(?=[{_LETTERS}]*+[0-9])(?={_RUN}{{{LONG}}})|(?<=[=:][ \t]{{0,2}}['\"`]?)|(?<=(?i:{SECRET_WORDS})[ \t]{{1,2}}(?:is[ \t])?['\"`]?))"
    rf"{_RUN}++(?:={{1,2}}(?![A-Za-z0-9=]))?+"
)
#: Words whose presence in a candidate speaks for an identifier.
DICTIONARY = "example sample test index static image content article page user admin default config public private version release build module package data file name path home local var usr lib bin src docs http https www com org net html json the and for with from this that"
FEATURES = ["length", "transitions", "digits", "upper", "symbols", "distinct", "coverage", "hexadecimal", "path", "uuid", "vowels", "placeholder", "assigned", "quoted", "secret_word", "other_word", "prose"]


def candidates(text: Column) -> Column:
    """Array of (start, end, match, before, after) of all candidates, code points."""
    return spans(text, CANDIDATE, NEAR, across=True)


def features(match: Column, before: Column, after: Column) -> list[Column]:
    """The FEATURES of a candidate."""
    n = F.greatest(F.char_length(match), F.lit(1)).cast("double")
    left = lambda pattern: F.char_length(F.regexp_replace(match, pattern, ""))
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(match, "[a-z]+", "\u0001"), "[A-Z]+", "\u0002"), "[0-9]+", "\u0003"), "\u0001\u0002\u0003", "aA0")
    words = "(?i)" + "|".join(sorted(DICTIONARY.split(), key=lambda w: (-len(w), w)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    found = {
        "length": n,
        "transitions": (F.char_length(kinds) - 1) / n,
        "digits": (n - left("[0-9]")) / n,
        "upper": (n - left("[A-Z]")) / n,
        "symbols": (n - left("[^A-Za-z0-9]")) / n,
        "distinct": F.size(F.array_distinct(F.split(match, ""))) / F.least(n, F.lit(32.0)),
        "coverage": (n - left(words)) / n,
        "hexadecimal": flag(match.rlike("^[0-9a-fA-F]+$")),
        "path": flag(match.rlike(r"/[^/]+/|\.[a-z]{2,4}$") | before.rlike(r"(://|\./|/)$")),
        "uuid": flag(match.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "vowels": (n - left("(?i)[aeiou]")) / n,
        "placeholder": flag(match.rlike(rf"(?i){PLACEHOLDERS}")),
        "assigned": flag(before.rlike(r"[=:]\s*['\"`]?$")),
        "quoted": flag(before.rlike("['\"`]$") & after.rlike("^['\"`]")),
        "secret_word": flag(before.rlike(rf"(?i)({SECRET_WORDS})[^\n]{{0,12}}$")),
        "other_word": flag(before.rlike(rf"(?i)({OTHER_WORDS})[^\n]{{0,12}}$")),
        "prose": flag(after.rlike("^[.,]? [a-z]+ [a-z]+")),
    }
    return [F.coalesce(found[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES]


def labelled_sentences(spark, n: int = SENTENCES) -> DataFrame:
    """format, text, secret (null: none): n sentences by rule, from the row's number alone.

    None of them assigns forty hexadecimal digits to a quoted token.
    """
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    b64 = lambda salt: F.base64(F.unhex(h(salt)))
    plain64 = lambda salt, k: F.substring(F.regexp_replace(F.concat(b64(salt), b64(salt + "+")), "[+/=]", ""), 1, k)
    below = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(k))
    pick = lambda options, salt: F.element_at(F.array(*[F.lit(o) for o in options]), (below(salt, len(options)) + 1).cast("int"))
    words = sorted(set(DICTIONARY.split()))
    # words of syllables, as prose in any language has them
    spoken = lambda salt: F.concat(*[pick("ta re no li en mar do sel vi un ker op bra ist ".split(), f"{salt}{i}") for i in range(4)])
    around = lambda x: F.concat(spoken("p"), F.lit(" "), spoken("q"), F.lit(" "), x, F.lit(" "), spoken("r"), F.lit(" "), spoken("s"), F.lit("."))
    name = pick(["api_key", "API_KEY", "secret", "client_secret", "password", "DB_PASSWORD", "access_key", "auth_token", "credential", "private_key", "passphrase"], "n")
    sign = pick(["=", " = ", ": ", ":"], "a")
    quote = pick(['"', "'", "", ""], "z")
    assigned = lambda x: F.concat(name, sign, quote, x, quote)
    said = lambda x: F.concat(pick(["the password is ", "my secret is ", "use the token ", "Authorization: Bearer ", "credential "], "w"), x)
    hexes = lambda salt: F.substring(h(salt), F.lit(1), pick([24, 32, 48, 64], salt + "k"))
    mixed = F.concat(F.initcap(spoken("m")), pick(list("!@#$%&*-_"), "y"), below("m", 9000).cast("string"), plain64("m", 3))
    phrase = F.concat_ws("-", pick(["Correct", "Purple", "Quiet", "Rusty"], "c1"), pick(["Horse", "Monkey", "Lamp", "River"], "c2"), pick(["Battery", "Staple", "Window"], "c3"))
    slug = F.concat_ws("-", pick(words, "a"), pick(words, "b"), pick(words, "c"), below("sl", 10_000).cast("string"))
    path = F.concat(F.lit("/"), F.concat_ws("/", pick(words, "d"), pick(words, "e"), pick(words, "f")), F.lit("/"), below("pa", 977).cast("string"), F.lit(".html"))
    uuid = F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12))
    none = F.lit(None).cast("string")
    kinds: list[tuple[str, Column, Column]] = []

    def secret(form: str, value: Column, text):
        kinds.append((form, around(text(value)), value))

    def other(form: str, text: Column):
        kinds.append((form, around(text), none))

    bare = lambda x: F.concat(pick(["", "key ", "found ", "id "], "k"), x)
    secret("hexadecimal", hexes("1"), assigned)
    secret("base64", F.concat(F.substring(b64("2"), 1, 38), pick(["==", "=", ""], "e")), assigned)
    secret("random", plain64("5", 24), assigned)
    secret("random said", plain64("6", 32), said)
    secret("password", mixed, assigned)
    secret("password said", mixed, said)
    secret("short password", plain64("7", 10), assigned)
    secret("phrase", phrase, assigned)
    secret("access id", F.concat(F.lit("AKIA"), F.upper(F.substring(h("3"), 1, 16))), bare)
    secret("prefixed token", F.concat(pick(["ghp_", "gho_", "glpat-", "npm_"], "g"), plain64("4", 36)), bare)
    secret("live key", F.concat(pick(["sk_live_", "rk_live_", "xoxb-", "AIza"], "l"), plain64("8", 28)), bare)
    secret("signed token", F.concat(F.lit("eyJ"), plain64("j", 20), F.lit("."), F.lit("eyJ"), plain64("i", 24), F.lit("."), plain64("s", 32)), said)
    other("commit", F.concat(pick(["commit ", "revision ", "sha1 ", "see commit "], "o"), F.substring(h("c"), 1, 40)))
    other("checksum", F.concat(pick(["sha256: ", "checksum=", "md5 = ", "etag: ", "digest: "], "o"), F.substring(h("d"), F.lit(1), pick([32, 40, 64], "dk"))))
    other("bare hash", F.substring(h("b"), F.lit(1), pick([32, 40, 64], "bk")))
    other("uuid", F.concat(pick(["id ", "uuid: ", "request=", "see "], "o"), uuid))
    other("slug", F.concat(pick(["page ", "id: ", "name=", ""], "o"), slug))
    other("address", F.concat(pick(["http://", "src=", "path ", "href: ", "url="], "o"), path))
    other("number", F.concat(pick(["order ", "isbn: ", "version=", "id = "], "o"), F.lpad(F.col("id").cast("string"), 20, "0")))
    other("placeholder", assigned(pick(["your_api_key_here", "example_key_0001", "change_me_please", "xxxxxxxxxxxxxxxx", "placeholder123456", "1111111111111111"], "ph")))
    other("word after a sign", F.concat(pick(["note: ", "type = ", "name: ", "title: ", "and so: "], "o"), spoken("t")))
    other("word after a secret word", F.concat(pick(["the password ", "a secret ", "each token ", "token: ", "secret = ", "auth "], "o"), spoken("v")))
    other("identifier", F.concat(pick(["call ", "import ", "module: ", "func = "], "o"), F.concat_ws("_", pick(words, "i1"), pick(words, "i2"), pick(words, "i3"), below("in", 99).cast("string"))))
    other("prose", spoken("x"))
    each = [
        spark.range(i, n, len(kinds), numPartitions=1).select(F.lit(form).alias("format"), text.alias("text"), value.alias("secret")) for i, (form, text, value) in enumerate(kinds)
    ]
    return common.stored(reduce(DataFrame.union, each).coalesce(2), "sentences")


def labelled_findings(sentences: DataFrame) -> DataFrame:
    """format, match, before, after, label of every candidate in sentences (format, text, secret)."""
    found = sentences.select("format", "secret", F.explode(candidates(F.col("text"))).alias("x"))
    return found.select("format", "x.match", "x.before", "x.after", F.coalesce(F.col("x.match") == F.col("secret"), F.lit(False)).cast("int").alias("label"))


def forest(findings: DataFrame):
    """The forest trained on match, before, after, label."""
    rows = findings.select(*features(F.col("match"), F.col("before"), F.col("after")), F.col("label").cast("double").alias("label"))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(assembled)


def accuracy(sentences: DataFrame, model) -> DataFrame:
    """format, n, n_secrets, n_found (secrets whose exact span is flagged), n_false (other spans flagged), by sentence."""
    rows = sentences.withColumn("id", F.monotonically_increasing_id())
    rows = common.stored(rows, "sentences")
    hits = scan(rows, model, "id").where(F.col("probability") >= THRESHOLD).select(F.col("doc_id").alias("id"), "match")
    per = rows.join(hits, "id", "left").groupBy("id", "format", "secret").agg(
        F.max(F.coalesce(F.col("match") == F.col("secret"), F.lit(False)).cast("int")).alias("found"),
        F.max((F.col("match").isNotNull() & F.coalesce(F.col("match") != F.col("secret"), F.lit(True))).cast("int")).alias("wrong"),
    )
    return per.groupBy("format").agg(F.count("*").alias("n"), F.count("secret").alias("n_secrets"), F.sum("found").alias("n_found"), F.sum("wrong").alias("n_false"))


def scan(docs: DataFrame, model=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, start, end, match, probability of every candidate, and one row with nulls for a document without any.

    Null text counts as empty. Repeated rows give the same candidates again (h is a hash of the text); null ids stay null.
    Time grows with the length of a text, however many candidates it has. Extra columns are ignored, also those named like
    inner ones; an empty table gives an empty result.
    """
    model = model or forest(labelled_findings(labelled_sentences(docs.sparkSession)))
    text = common.whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.explode_outer(candidates(text)).alias("x"))
    rows = rows.select("doc_id", "h", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.match").alias("match"), *features(F.col("x.match"), F.col("x.before"), F.col("x.after")))
    out = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return out.select("doc_id", "h", "start", "end", "match", F.when(F.col("start").isNotNull(), vector_to_array("probability")[1]).alias("probability"))


def op6_secret_scan(spark, sf_dir):
    """One row for each document (rows that repeat id and text are one): candidates, findings and their spans."""
    found = scan(common.documents(spark, sf_dir))
    hit = F.col("probability") >= THRESHOLD
    return (
        found.dropDuplicates(["doc_id", "h", "start"])
        .groupBy("doc_id", "h")
        .agg(
            F.count("start").alias("n_candidates"), F.count(F.when(hit, 1)).alias("n_secrets"), F.max("probability").alias("top_probability"),
            F.array_sort(F.collect_list(F.when(hit, F.struct("start", "end")))).alias("spans"),
        )
        .select("doc_id", "n_candidates", "n_secrets", "top_probability", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))
    )
