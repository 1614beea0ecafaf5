"""Secret scans: a random forest tells secrets from what only looks like them."""

from __future__ import annotations

import functools
import json
import os
import re
import string
import zlib
from collections.abc import Sequence

import xxhash
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a value follows where it is assigned to a name that speaks for a secret.
ASSIGNED = (
    r"(?:(?<=[=:>][ \t]{0,16}[\"'`]?)(?<=(?i:token|secret|passw|passphrase|pwd|api.?key|auth|bearer|credential|private.?key|access.?key|client.?key)"
    r"[A-Za-z0-9_.-]{0,24}[\"'`\])]{0,2}[ \t]{0,16}(?::=|=>|==?|:)[ \t]{0,16}[\"'`]?)|(?<=(?i:bearer)[ \t]{1,4}))"
)
#: What a password in an address follows, and characters that values may hold beside letters, digits and "_+/.-".
IN_ADDRESS, OTHERS = r"(?<=://[A-Za-z0-9_.-]{1,32}:)", "@!#$%^*~?"
#: A candidate is a run of these characters, 16 or more with a digit among them, a password in an address, or a value of any make after ``ASSIGNED``; '=' only pads its end.
CANDIDATE = (
    r"(?<![A-Za-z0-9_+/.-])(?:" + IN_ADDRESS + r"[A-Za-z0-9_+.!#$%^*~?-]++(?=@)|" + ASSIGNED + r"[A-Za-z0-9_+/.@!#$%^*~?-]++"
    r"|(?=[A-Za-z_+/.-]*+[0-9])[A-Za-z0-9_+/.-]{16,}+)(?:={1,2}(?![A-Za-z0-9_+/=.-]))?"
)
#: Characters of context that are looked at on either side.
LEFT, RIGHT = 64, 32

#: Public prefixes of issued keys, and words that speak for or against a secret.
ISSUED = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abp]-|sk_live_|rk_live_|sk-|AIza|ya29\.|eyJ|SG\.|npm_|pypi-)"
FOR = r"(?i)(?:token|secret|passw|pwd|api.?key|apikey|auth|bearer|credential|private.?key|access.?key|client.?key)"
AGAINST = r"(?i)(?:commit|revision|sha\d*|md5|checksum|digest|hash|etag|uuid|guid|build|version|integrity|fingerprint|blob|tree|example|sample|dummy|placeholder|fixture|serial|isbn|order|invoice|session.?id|request.?id)"
#: What a digest of an integrity check begins with.
DIGEST = r"^(?i:sha(?:1|256|384|512)|md5)-"
#: Places of the dictionary's bits: a word that isn't in it has its bit set once in some 130 times.
DICTIONARY_BITS = 22
#: A public vocabulary, whose whole words of so many letters or more are the dictionary.
VOCABULARY, WORD_LETTERS = "word_bpe_49k.json", 3
#: Kinds of characters, whose transitions are counted: upper case, lower-case vowels and consonants, digits, others.
KINDS = "Uvc9_"

FEATURES = [
    "length", "entropy", "distinct", "digits", "uppers", "symbols", "runs", "is_hex", "is_issued", "dictionary", "slashes", "dots", "dashes",
    "after_slash", "assigned", "quoted", "word_for", "word_against", "filler", "is_digest", "in_address", *[f"{a}{b}" for a in KINDS for b in KINDS],
]


@functools.cache
def dictionary(vocabulary: str = VOCABULARY) -> tuple[str, ...]:
    """The vocabulary's words of ASCII letters, in order."""
    import public_tokenizers

    with open(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    words = (x.removesuffix("</w>") for x in pieces if x.endswith("</w>"))
    return tuple(sorted(w for w in words if len(w) >= WORD_LETTERS and w.isascii() and w.isalpha()))


@functools.cache
def dictionary_bits(words: tuple[str, ...]) -> str:
    """The words' places (XXH64, seed 42, as ``xxhash64`` gives it) as 64-bit numbers, joined by commas."""
    bits = [0] * (1 << DICTIONARY_BITS - 6)
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), 42) & (1 << DICTIONARY_BITS) - 1
        bits[h >> 6] |= 1 << (h & 63)
    return ",".join(str(b - (1 << 64) if b >> 63 else b) for b in bits)


def features(c: str = "candidate", left: str = "before", right: str = "after", words: Sequence[str] | None = None) -> list[Column]:
    """The forest's inputs from a candidate and its context, as plain expressions; ``words`` is the dictionary."""
    x, n = F.col(c), F.greatest(F.length(c), F.lit(1))
    lower = F.lower(x)
    share = lambda pattern: F.regexp_count(x, F.lit(pattern)) / n
    chars = F.array_distinct(F.split(x, ""))
    part = F.transform(chars, lambda ch: (n - F.length(F.replace(x, ch, F.lit("")))) / n)
    entropy = F.aggregate(part, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    vowels, consonants = "aeiou", "bcdfghjklmnpqrstvwxyz"
    kinds = F.translate(x, string.ascii_uppercase + vowels + consonants + string.digits + "_+/=.-" + OTHERS, "U" * 26 + "v" * 5 + "c" * 21 + "9" * 10 + "_" * (6 + len(OTHERS)))
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    bits = F.split(F.lit(dictionary_bits(tuple(dictionary() if words is None else words))), ",").cast("array<bigint>")
    place = lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << DICTIONARY_BITS) - 1))
    parts = F.regexp_extract_all(x, F.lit(f"[A-Z]?[a-z]{{{WORD_LETTERS - 1},}}|[A-Z]{{{WORD_LETTERS},}}"), F.lit(0))
    known = F.filter(F.transform(parts, F.lower), lambda w: (F.length(w) >= WORD_LETTERS) & (F.get(bits, F.shiftright(place(w), 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place(w).bitwiseAND(F.lit(63)).cast("int"))) != 0))
    near_left = F.substring(F.col(left), -LEFT, LEFT)
    out = {
        "length": F.length(c),
        "entropy": entropy,
        "distinct": F.size(chars) / n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "symbols": share("[_+/=.@!#$%^*~?-]"),
        "runs": (runs - 1) / n,
        "is_hex": x.rlike("^[0-9a-fA-F-]+$").cast("int"),
        "is_issued": x.rlike(ISSUED).cast("int"),
        "dictionary": F.aggregate(known, F.lit(0), lambda a, w: a + F.length(w)) / n,
        "slashes": F.regexp_count(x, F.lit("/")),
        "dots": F.regexp_count(x, F.lit(r"\.")),
        "dashes": F.regexp_count(x, F.lit("-")),
        "after_slash": near_left.rlike(r"(?:[/\\?&#@]|://\S*)$").cast("int"),
        "assigned": near_left.rlike("[=:]\\s*[\"'`]?$").cast("int"),
        "quoted": (near_left.rlike("[\"'`]$") & F.col(right).rlike("^[\"'`]")).cast("int"),
        "word_for": near_left.rlike(FOR + r"[^\n]{0,24}$").cast("int"),
        "word_against": near_left.rlike(AGAINST + r"[^\n]{0,24}$").cast("int"),
        "filler": lower.rlike(r"(.)\1{5,}|example|xxxx|abcdef|123456|changeme|your").cast("int"),
        "is_digest": x.rlike(DIGEST).cast("int"),
        "in_address": near_left.rlike(r"://[A-Za-z0-9_.-]{1,32}:$").cast("int"),
    }
    out |= {f"{a}{b}": F.regexp_count(kinds, F.lit(f"{re.escape(a)}(?={re.escape(b)})")) / n for a in KINDS for b in KINDS}
    return [F.coalesce(out[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES]


def cut_out(rows: DataFrame) -> DataFrame:
    """A row for each candidate in ``text``: the other columns, ``n`` from 0, ``gap`` before it, ``candidate``, and ``before`` and ``after`` it."""
    # The candidates are marked by characters that the text itself has not (its own become spaces), so that the pattern passes it once.
    marked = F.regexp_replace(F.translate("text", "\x01", " "), f"({CANDIDATE})", "\x01$1\x01")
    rows = rows.withColumn("_parts", F.split(marked, "\x01", -1)).where("size(_parts) > 1")
    at = F.sequence(F.lit(1), F.size("_parts") - 2, F.lit(2))
    part = lambda i: F.get("_parts", i)
    whole = F.transform(at, lambda i: F.struct(part(i).alias("c"), F.length(part(i - 1)).alias("gap"), F.substring(part(i - 1), -LEFT, LEFT).alias("l"), F.substring(part(i + 1), 1, RIGHT).alias("r")))
    kept = [c for c in rows.columns if c not in ("text", "_parts")]
    each = rows.select(*kept, F.posexplode(whole).alias("n", "x"))
    return each.select(*kept, "n", F.col("x.gap").alias("gap"), F.col("x.c").alias("candidate"), F.col("x.l").alias("before"), F.coalesce("x.r", F.lit("")).alias("after"))


def labelled_findings(spark: SparkSession, n: int = 6_000) -> DataFrame:
    """``before, candidate, after, label``: findings labelled by how they are made, from ``n`` texts made of hashes of their numbers.

    Secrets are random strings of issued and generic forms, short ones and ones of letters only among
    them, after words and signs of an assignment; false positives are commits, checksums, identifiers,
    paths, versions, numbers, fillers, and words and names that are assigned. The findings are cut out
    of the texts as the scan does it; one that is not the secret itself is none. Its words are one in 61
    of the dictionary's, by their checksum.
    """
    h = lambda salt: F.sha2(F.concat_ws("|", F.lit(salt), F.col("id").cast("string")), 256)
    pick = lambda salt, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(xs))) + 1).cast("int"))
    mixed = lambda salt: F.regexp_replace(F.base64(F.unhex(F.concat(h(salt), h(salt + "+")))), "[+/=]", "")
    cut = lambda x, salt, lo, hi: F.substr(x, F.lit(1), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(hi - lo)) + lo).cast("int"))
    listed = [w for w in dictionary() if zlib.crc32(w.encode()) % 61 == 7]
    words = lambda salt: F.initcap(F.element_at(F.split(F.lit(" ".join(listed)), " "), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(listed))) + 1).cast("int")))
    secret_word = pick("w", ["token", "api_key", "apiKey", "secret", "SECRET_KEY", "password", "auth_token", "access_key", "Authorization: Bearer", "client_secret", "private_key"])
    sign = pick("s", [" = \"", "=\"", ": \"", "='", ": ", "=", " = '", " := \""])
    close = F.when(sign.endswith("\""), F.lit("\"\n")).when(sign.endswith("'"), F.lit("'\n")).otherwise(F.lit("\n"))
    false_word = pick("f", ["commit", "sha256", "md5 =", "checksum:", "revision", "integrity: ", "etag \"", "build", "uuid=", "request id ", "blob", "digest: ", "see ", "the ", "order no. "])
    prefix = pick("p", ["AKIA", "ghp_", "xoxb-", "sk_live_", "AIza", "glpat-", "npm_"])
    uuid = F.regexp_replace(h("u"), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")
    kind = F.pmod(F.xxhash64(F.lit("kind"), "id"), F.lit(27))
    lead = F.concat(words("l1"), F.lit(" "), F.lower(words("l2")), F.lit(" "))
    rows = [
        (0, 1, F.concat(secret_word, sign), F.substring(h("a"), 1, 40), close),
        (1, 1, F.concat(secret_word, sign), F.substring(h("a"), 1, 32), close),
        (2, 1, F.concat(secret_word, sign), h("a"), close),
        (3, 1, F.concat(secret_word, sign), cut(mixed("b"), "n", 18, 60), close),
        (4, 1, F.concat(secret_word, sign), cut(F.base64(F.unhex(h("c"))), "n", 20, 44), close),
        (5, 1, F.concat(lead, sign), F.concat(prefix, cut(mixed("d"), "n", 18, 40)), close),
        (6, 1, F.concat(secret_word, sign), F.concat(prefix, cut(mixed("d"), "n", 18, 40)), close),
        (7, 0, F.concat(false_word, F.lit(" ")), F.substring(h("e"), 1, 40), F.lit(" ")),
        (8, 0, F.concat(false_word, F.lit(" ")), F.substring(h("e"), 1, 32), F.lit("\n")),
        (9, 0, F.concat(lead, sign), uuid, close),
        (10, 0, F.concat(lead, F.lit("https://host/")), F.concat(F.lower(words("x1")), F.lit("/"), words("x2"), F.lit("-"), F.substring(h("g"), 1, 6), F.lit("/"), F.lower(words("x3"))), F.lit(" ")),
        (11, 0, lead, F.concat(words("x1"), words("x2"), words("x3"), F.lit("2"), words("x4")), F.lit("(")),
        (12, 0, F.concat(lead, sign), F.concat(F.lower(words("x1")), F.lit("_"), F.lower(words("x2")), F.lit("_"), F.lower(words("x3")), F.lit("_1")), close),
        (13, 0, F.concat(secret_word, sign), F.concat(pick("q", ["xxxxxxxxxxxxxxxx", "EXAMPLE", "your_token_here_", "000000000000", "changeme", "abcdef123456"]), F.lit("0000EXAMPLE1")), close),
        (14, 0, lead, F.regexp_replace(F.conv(F.substring(h("i"), 1, 15), 16, 10), "^(.*)$", "$1.2024.11.5"), F.lit(" ")),
        (15, 0, F.concat(false_word, F.lit(" ")), h("e"), F.lit("\n")),
        (16, 1, F.concat(secret_word, sign), cut(mixed("b"), "n", 8, 16), close),
        (17, 1, F.concat(secret_word, sign), cut(F.regexp_replace(mixed("b"), "[0-9]", ""), "n", 8, 30), close),
        (18, 1, F.concat(F.lit("https://host/"), F.lower(words("x1")), F.lit("?"), pick("v", ["token=", "access_token=", "api_key=", "id=1&auth="])), cut(mixed("b"), "n", 12, 44), F.lit(" ")),
        (19, 0, F.concat(secret_word, sign), F.lower(words("x1")), close),
        (20, 0, F.concat(secret_word, sign), F.concat(F.lower(words("x1")), pick("j", ["", ".", "_", "-"]), words("x2"), pick("k", ["", ".get", "_name", "Value"])), close),
        (21, 1, F.concat(secret_word, sign), F.concat(cut(mixed("b"), "n", 2, 7), pick("o", list(OTHERS)), F.lower(words("x1")), pick("o2", list(OTHERS)), cut(mixed("e"), "m", 1, 6)), close),
        (22, 0, F.concat(pick("y", ["integrity", "integrity =", "resolved", "\"integrity\":", ""]), F.lit(" \"")), F.concat(pick("t", ["sha512-", "sha256-", "sha384-", "sha1-"]), F.base64(F.unhex(h("c")))), F.lit("\"\n")),
        (23, 0, F.concat(secret_word, sign), F.concat(pick("e", ["process.env.", "env.", "os.environ.", "config.", "settings.", "secrets.", "vault.", ""]), F.upper(words("x1")), pick("g", ["_KEY", "_TOKEN", "_API_KEY", "_SECRET", "_PASSWORD"]), pick("h", ["", "_V2", "_2", "_PROD", "_V2_PROD"])), close),
        (24, 1, F.concat(lead, pick("z", ["postgres://", "mysql://", "redis://", "https://", "amqp://", "mongodb://"]), F.lower(words("x1")), F.lit(":")), cut(mixed("b"), "n", 8, 24), F.concat(F.lit("@"), F.lower(words("x2")), F.lit(" "))),
        (25, 0, F.concat(lead, F.lit("https://")), F.concat(F.lower(words("x1")), F.lit("."), F.lower(words("x2")), F.lit(".org/v"), F.substring(F.conv(F.substring(h("i"), 1, 15), 16, 10), 1, 3), F.lit("/"), F.lower(words("x3"))), F.lit(" ")),
        (26, 0, F.concat(secret_word, sign), F.concat(F.lit("${"), F.upper(words("x1")), F.lit("}")), close),
    ]
    ids, made = spark.range(0, n, 1, 4), None
    for some in (rows[i : i + 7] for i in range(0, len(rows), 7)):  # few kinds at once, as one expression of them all would be too long to compile
        pick_row = lambda k, some=some: functools.reduce(lambda e, r: e.when(kind == r[0], r[k] if isinstance(r[k], Column) else F.lit(r[k])), some, F)
        part = ids.where(kind.isin([r[0] for r in some])).select(F.concat(lead, pick_row(2)).alias("b"), pick_row(3).alias("c"), pick_row(4).alias("a"), pick_row(1).alias("l"))
        made = part if made is None else made.unionByName(part)
    each = cut_out(made.select("b", "c", "l", F.concat("b", "c", "a").alias("text")))
    label = (F.col("l") == 1) & (F.col("candidate") == F.col("c"))
    return each.select("before", "candidate", "after", label.cast("double").alias("label"))


def fit_forest(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 1) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings.select("label", *features()))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    findings: DataFrame | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per candidate: ``id_col, start, length, candidate_sha256, score, is_secret``; ``start`` counts code points from 0.

    Candidates are runs of letters, digits and ``_+/.-``, with ``=`` as padding at the end only: those of
    16 or more with a digit, and of any length and make, with ``OTHERS`` among them, where they are assigned
    to a name that speaks for a secret (``ASSIGNED``) or are the password of an address.
    The forest weighs length, make-up and transitions between kinds of characters, how much of it is words
    of a public vocabulary, what looks like a path, and neighbouring words; it is trained from ``findings`` (by default from
    ``labelled_findings``, whose labels follow from their making). The secret itself is not returned.
    Null and empty texts have no candidates; texts of any length are scanned whole; repeated rows each
    give theirs; other columns are ignored, whatever their names; an empty table gives an empty result.

    All is columns: one pass of the pattern marks the candidates; the text is cut at the marks, and features are taken.
    Only the candidates are shuffled, with their features, to sum up the lengths before each.
    """
    model = fit_forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    each = cut_out(rows).select("id", "row", "n", "gap", "candidate", *features())
    upto = W.partitionBy("row").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("candidate")).over(upto))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(each))
    score = vector_to_array("probability")[1]
    return scored.select(
        F.col("id").alias(id_col),
        (F.col("end") - F.length("candidate")).cast("long").alias("start"),
        F.length("candidate").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"),
        score.alias("score"),
        (score >= threshold).alias("is_secret"),
    )
