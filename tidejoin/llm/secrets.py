"""Secret scans, in DataFrame operations only: candidates by shape, false positives removed by a random forest.

Words are cut at white space and at all ASCII marks outside secrets' alphabets (so at = & ? # and brackets too); only
what a password's label assigns (password = "...") is one word with its marks, up to its quote, or unquoted up to
white space or a mark that ends it. A candidate is a maximal run of secrets' characters in a word, less dots at its
ends, or such a password. It has MIN_CHARS or more characters, or SHORT_CHARS or more if a word like "token" or
"password" is among the AROUND words before it, of secrets'
alphabets and a digit, or both letter cases. Its features are length, character transitions, dictionary coverage, path
marks, and neighbouring words. ``pyspark.ml`` trains the forest from labelled findings (candidate, before, after,
label); ``labelled_findings`` makes them by rule, since no table here labels secrets. The bound of the training table
is its parameter n.

A result names a secret by digest, not by value, and shows only plain words and labels of what stands before it.
Defined results: an empty table has no findings; a null or empty text has no findings; repeated rows
and repeated candidates are findings of their own, told apart by place (the word's number; runs parted only by characters
beyond ASCII share it); equal candidates with equal neighbours have equal scores, and a score of 0.5 is a secret; very
long texts are scanned whole; other columns are ignored. Out of reach: secrets with marks that no password's label precedes, a
padding = at a secret's end, passwords with white space or under SHORT_CHARS, and lower-case letters alone.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

MIN_CHARS, SHORT_CHARS, AROUND = 16, 8, 3
TRAIN_ROWS, TREES, DEPTH, SEED = 12_000, 24, 8, 42
MARKS = r"\s!-*,:-?\[-^`{-}"  # all of ASCII's that no secret's alphabet has, and =
RUN = "[A-Za-z0-9_+/.@~-]"
_LABEL = r"(?<=(?i:password|passwd|pwd|passphrase)[\"'`]?\s{0,2}[:=]\s{0,2}"
#: Words: quoted values of a password's label, unquoted ones, others.
WORDS = rf"{_LABEL}[\"'`])[^\s\"'`]{{{SHORT_CHARS},}}(?=[\"'`])|{_LABEL})[^\s\"'`&,;()<>\[\]{{|}}]{{{SHORT_CHARS - 1},}}[^\s\"'`&,;()<>\[\]{{|}}.!?:]|[^{MARKS}]+"

# Words that stand in placeholders, names and paths; words before secrets; words before other codes.
DICTIONARY = "example sample test dummy placeholder change insert your here name value data user admin key token secret password api file path index item list page image video static assets public private default config setting update create delete get set string number object class function return http https www com org net html json xml the and for with this that from not all new one two use can was are you has her his out day time year version release build module package license".split()
WARM = r"(?i)\b(token|secret|passw(or)?d|pwd|passphrase|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
COLD = r"(?i)\b(sha-?1|sha-?256|md5|checksum|digest|etag|commit|revision|uuid|guid|hash|fingerprint|example|sample|placeholder|dummy|isbn|phone|card|order|invoice|integrity)"
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|xox[abp]-|AIza|eyJ|npm_|pypi-)"
# Frequent letter pairs of running text.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur"


def candidates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, place, candidate, before, after."""
    text = F.coalesce("text", F.lit(""))
    split = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Looking behind at every place is dear, and finds nothing in texts without a label.
    words = docs.select(F.col("doc_id").cast("long"), F.when(text.rlike("(?i)password|passwd|pwd|passphrase"), split(WORDS)).otherwise(split(f"[^{MARKS}]+")).alias("w"))
    runs = lambda x: F.transform(F.regexp_extract_all(x, F.lit(f"{RUN}{{{SHORT_CHARS},}}"), F.lit(0)), lambda r: F.regexp_replace(r, r"^\.+|\.+$", ""))
    parts = lambda x: F.when(x.rlike(f"[{MARKS}]"), F.array(x)).otherwise(runs(x))
    near = lambda x, i: F.struct(i.alias("place"), F.array_join(F.slice("w", F.greatest(i - AROUND + 1, F.lit(1)), F.least(F.lit(AROUND), i)), " ").alias("before"), F.array_join(F.slice("w", i + 2, AROUND), " ").alias("after"), parts(x).alias("parts"))
    found = F.filter(F.transform("w", lambda x, i: F.when((F.octet_length(x) >= SHORT_CHARS) & x.rlike(f"[0-9A-Z{MARKS}]"), near(x, i))), lambda s: s.isNotNull())
    rows = words.where(F.exists("w", lambda x: F.octet_length(x) >= SHORT_CHARS)).select("doc_id", F.explode(found).alias("c"))
    rows = rows.select("doc_id", "c.place", F.explode("c.parts").alias("candidate"), "c.before", "c.after")
    c = F.col("candidate")
    mixed = c.rlike("[0-9]") | (c.rlike("[a-z]") & c.rlike("[A-Z]")) | c.rlike(f"[{MARKS}]")
    return rows.where(mixed & ((F.length(c) >= MIN_CHARS) | (F.length(c) >= SHORT_CHARS) & F.col("before").rlike(WARM)))


def with_features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    c = F.col("candidate")
    n = F.length(c).cast("double")
    count = lambda pattern, of=c: F.regexp_count(of, F.lit(pattern)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "s")
    dictionary = "(?i)(" + "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w))) + ")"
    features = {
        "f_length": n,
        "f_digits": count("[0-9]") / n,
        "f_upper": count("[A-Z]") / n,
        "f_lower": count("[a-z]") / n,
        "f_marks": count("[^A-Za-z0-9]") / n,
        "f_hex": (~c.rlike("[^0-9a-fA-F-]")).cast("double"),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "f_transitions": count(r"(.)(?!\1|$)", kinds) / n,
        "f_pairs": count("(?i)(?=(" + "|".join(PAIRS.split()) + "))") / n,
        "f_dictionary": (n - F.length(F.regexp_replace(c, dictionary, ""))) / n,
        "f_path": (count("[/.@]")).cast("double"),
        "f_uuid": c.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").cast("double"),
        "f_prefix": c.rlike(PREFIXES).cast("double"),
        "f_warm": F.col("before").rlike(WARM).cast("double"),
        "f_cold": F.col("before").rlike(COLD).cast("double"),
        "f_cold_after": F.col("after").rlike(COLD).cast("double"),
    }
    return found.withColumns(features), list(features)


def labelled_findings(spark: SparkSession, n: int = TRAIN_ROWS) -> DataFrame:
    """n findings made by rule from seeded hashes: secrets of common shapes, and codes, names and numbers that aren't."""
    bits = lambda k: F.sha2(F.concat_ws("-", F.col("id").cast("string"), F.lit(f"{SEED}.{k}")), 256)
    mixed = lambda k: F.regexp_replace(F.base64(F.unhex(bits(k))), "[+/=]", "x")
    pick = lambda k, *xs: F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs))[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(xs))).cast("int")]
    word = lambda k: pick(k, *DICTIONARY[:60])
    plain = lambda k: pick(k, "then", "of", "the near", "und", "le", "and was", "in", "")
    warm = pick(1, "token", "the token", "api_key", "secret", "password", "aws access_key", "auth bearer", "client_secret", "private_key")
    cold = pick(2, "sha1", "commit", "checksum", "md5", "etag", "sha256 digest", "uuid", "revision", "integrity", "example token", "sample api_key")
    long_hex = F.substring(bits(3), 1, pick(4, 32, 40, 64))
    secret = pick(5, long_hex, F.substring(bits(6), 1, 40), F.substring(mixed(7), 1, 24), F.substring(mixed(8), 1, 40), F.concat(F.lit("AKIA"), F.upper(F.substring(bits(9), 1, 16))), F.concat(F.lit("ghp_"), F.substring(mixed(10), 1, 36)), F.concat(F.lit("sk_live_"), F.substring(mixed(11), 1, 24)))
    uuid = F.concat_ws("-", F.substring(bits(12), 1, 8), F.substring(bits(12), 9, 4), F.substring(bits(12), 13, 4), F.substring(bits(12), 17, 4), F.substring(bits(12), 21, 12))
    digits = F.lpad(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(10**16)).cast("string"), 16, "4")
    between = pick(14, "_", "-", ".", "/")
    name = F.concat(word(15), between, word(16), between, word(17), between, word(18), F.pmod(F.col("id"), F.lit(99)).cast("string"))
    camel = F.concat(F.initcap(word(19)), F.initcap(word(20)), F.initcap(word(21)), F.initcap(word(22)), F.lit("Value"))
    url = F.concat(F.lit("//www."), word(23), F.lit(".com/"), word(24), F.lit("/"), word(25), F.pmod(F.col("id"), F.lit(999)).cast("string"))
    filler = F.concat(pick(26, "your_token_here_", "xxxxxxxxxxxxxxxxxxxx", "00000000000000000000", "changeme_changeme_", "example_api_key_"), F.pmod(F.col("id"), F.lit(9)).cast("string"))
    not_warm, not_plain = F.concat_ws(" ", plain(27), warm), plain(28)
    mark = lambda k: pick(k, "!", "#", "$", "&", "?", "*", "%", "-", "_", "@")
    password = F.concat(F.substring(mixed(39), 1, 4), pick(40, mark(41), F.lit("")), F.substring(mixed(42), 5, 4), pick(43, mark(44), F.substring(bits(45), 1, 3), F.substring(mixed(46), 1, 5)))
    plain_short = pick(47, F.concat(word(48), pick(49, "1", "12", "123", "2024")), F.concat(F.initcap(word(50)), F.initcap(word(51))), F.concat(word(52), between, word(53), F.lit("1")), F.lit("changeme1"), F.lit("password1"), F.lit("********1"), F.concat(word(54), F.initcap(word(55)), F.lit("s")))
    kind = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(12))
    rows = spark.range(n).withColumn("kind", kind)
    false = lambda c, b: F.struct(c.alias("candidate"), b.alias("before"), F.lit(0.0).alias("label"))
    true = lambda c, b: F.struct(c.alias("candidate"), b.alias("before"), F.lit(1.0).alias("label"))
    made = F.when(F.col("kind") < 4, true(secret, not_warm)).when(F.col("kind") == 4, true(pick(30, F.concat(F.lit("AKIA"), F.upper(F.substring(bits(31), 1, 16))), F.concat(F.lit("ghp_"), F.substring(mixed(32), 1, 36))), not_plain))
    made = made.when(F.col("kind") == 5, false(pick(33, long_hex, uuid), F.concat_ws(" ", plain(34), cold))).when(F.col("kind") == 6, false(pick(35, digits, uuid), not_plain))
    made = made.when(F.col("kind") == 7, false(pick(36, name, camel, url), not_plain)).when(F.col("kind") == 8, false(filler, not_warm))
    made = made.when(F.col("kind") == 10, true(F.rpad(password, 9, "7"), F.concat_ws(" ", plain(56), pick(57, "password", "pwd", "the password", "db_password", "passphrase", "secret")))).when(F.col("kind") == 11, false(plain_short, not_warm)).otherwise(false(pick(37, name, camel), not_warm))
    return rows.select("id", made.alias("m")).select("id", "m.*", plain(38).alias("after"))


def masked(words: str) -> Column:
    """Neighbouring words fit to be shown: plain words and secrets' labels; any other, which may itself be a secret, is a star."""
    return F.array_join(F.transform(F.split(F.col(words), " "), lambda w: F.when(w.rlike(rf"^([a-zA-Z]?[a-z]{{0,15}}|{WARM}s?)$"), w).otherwise(F.lit("*"))), " ")


def train(labelled: DataFrame) -> PipelineModel:
    """labelled (candidate, before, after, label 0.0 or 1.0) to a fitted forest over with_features' columns."""
    from pyspark.ml import Pipeline

    table, names = with_features(labelled)
    table, _ = cut(table.select("label", *names), "findings")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), forest]).fit(table)


def scan(docs: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """docs (doc_id, text) to doc_id, place, n_chars, secret_sha256, before, score, is_secret: a row for each candidate."""
    model = model or train(labelled_findings(docs.sparkSession))
    table, _ = with_features(candidates(docs))
    scored = model.transform(table).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", F.col("place").cast("long"), F.length("candidate").cast("long").alias("n_chars"), F.sha2("candidate", 256).alias("secret_sha256"), masked("before").alias("before"), "score", (F.col("score") >= 0.5).alias("is_secret"))
