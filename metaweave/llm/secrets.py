"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of token characters of at least ``least`` characters that holds a
digit or starts as known keys do, or a quoted value of at least ``SHORTEST`` characters
without blanks that is assigned to a name of a secret.  The text is cut at the candidates, so each comes with its offset and with the text
before and after it.  The forest sees the candidate's length, its character transitions
(the mean log-odds of its neighbouring characters between secrets and other findings, by a
table of pairs counted over the labelled findings) and classes, how much of it dictionary words cover, the path it was found at and the words
next to it.  It is trained from labelled findings, either given or made by
:func:`labelled_findings`, and it runs in the JVM: everything here is DataFrame operations.

Defined cases: null and empty texts have no candidates; a null path counts as empty;
repeated rows give repeated findings; a document without candidates gives no row; equal
scores stay as they are (no ranking is involved); extra columns are ignored; an empty table
gives an empty result; labelled findings of one class only make every probability that class.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 16
#: Labelled findings made where none are given.
MADE = 6000
CONTEXT = 48

#: Least length of a value that is assigned to a name of a secret.
SHORTEST = 8
#: Pieces of a text whose lengths are summed together.
BLOCK = 1024

_MARK = "\x01"
_KNOWN = "AKIA|ASIA|gh[pousr]_|sk_live_|xox[bap]-|eyJ|AIza|glpat-"

# Words that names and placeholders are made of.
DICTIONARY = (
    "access account address admin api app auth backup base build cache change client cloud code config "
    "content data database debug default deploy dev document domain dummy email error example false file "
    "folder format group header hello home host http https id image index input insert item key lib list "
    "local login main master message model module name node null number object option order output page "
    "param pass password path port private process product prod project proxy public query read release "
    "request response result root sample secret section server service session setting site source sql "
    "staging start state static status storage string system table temp test the time token true type "
    "update upload url user value version view web your"
).split()
# What stands next to secrets, to harmless digests, and in placeholders.
SECRET_WORDS = "token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|authorization|auth"
DIGEST_WORDS = "commit|sha1|sha256|sha512|md5|etag|checksum|digest|revision|hash|integrity|blob|uuid|guid"
PLACEHOLDERS = "example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0000|1234567|abcdef|test"
TEST_PATHS = "test|spec|example|sample|fixture|mock|docs?/|readme"

_VALUE = rf"""(?<=["'])(?<=(?i:{SECRET_WORDS})["']?\s{{0,3}}[:=]\s{{0,3}}["'])[^\s"'{_MARK}]{{{SHORTEST},}}+(?=["'])"""
_TOKEN = rf"{_VALUE}|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9]|{_KNOWN})[A-Za-z0-9+/_=-]{{%d,}}+"


def candidates(docs: DataFrame, least: int = LEAST, path: str = "source") -> DataFrame:
    """``doc_id, path, start, candidate, before, after``; ``start`` counts characters from 0."""
    place = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _MARK, " ")
    parts = F.split(F.regexp_replace(text, _TOKEN % least, f"{_MARK}$0{_MARK}"), _MARK)
    cutted = docs.select("doc_id", place.alias("path"), parts.alias("parts")).where(F.size("parts") > 1)
    # odd entries are the candidates; each gets its neighbours and the length of all before it,
    # from the sums of whole blocks and the lengths within its own
    total = lambda lengths, start, n: F.aggregate(F.slice(lengths, start, n), F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / BLOCK).cast("int")), lambda b: total("lengths", b * BLOCK + 1, F.lit(BLOCK)))
    found = cutted.withColumn("lengths", F.transform("parts", F.length)).withColumn("blocks", blocks)

    def finding(i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        return F.struct(
            (total("blocks", F.lit(1), block) + total("lengths", block * BLOCK + 1, i - block * BLOCK)).alias("start"),
            F.get("parts", i).alias("candidate"),
            F.right(F.get("parts", i - 1), F.lit(CONTEXT)).alias("before"),
            F.left(F.get("parts", i + 1), F.lit(CONTEXT)).alias("after"),
        )

    places = F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2))
    found = found.select("doc_id", "path", F.explode(F.transform(places, finding)).alias("f"))
    return found.select("doc_id", "path", "f.*")


def _share(pattern: str, length: Column) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / length


def features() -> dict[str, Column]:
    length = F.length("candidate")
    chars = F.split("candidate", "")
    seen = F.array_distinct(chars)
    entropy = -F.aggregate(
        seen,
        F.lit(0.0),
        lambda total, c: total
        + (F.size(F.filter(chars, lambda x: x == c)) / length) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / length),
    )
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    left = F.length(F.regexp_replace(F.lower("candidate"), words, ""))
    near = F.lower(F.col("before"))
    return {
        "length": length.cast("double"),
        "digits": _share("[0-9]", length),
        "lower": _share("[a-z]", length),
        "upper": _share("[A-Z]", length),
        "marks": _share("[+/_=-]", length),
        "hex": _share("[0-9a-fA-F]", length),
        "class_changes": _share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])", length),
        "vowel_changes": _share("(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])", length),
        "repeats": _share(r"(.)(?=\1)", length),
        "ascending": _share("(?=01|12|23|34|45|56|67|78|89|ab|bc|cd|de|ef)", length),
        "distinct": F.size(seen) / length,
        "entropy": entropy,
        "dictionary": 1 - left / length,
        "placeholder": F.lower("candidate").rlike(PLACEHOLDERS).cast("double"),
        "grouped": F.col("candidate").rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$").cast("double"),
        "known_start": F.col("candidate").rlike(f"^({_KNOWN})").cast("double"),
        "secret_word": near.rlike(f"({SECRET_WORDS})[\"']?\\W*$").cast("double"),
        "digest_word": near.rlike(f"({DIGEST_WORDS})[\"']?\\W*(of\\W+)?$").cast("double"),
        "assigned": near.rlike("[:=]\\s*[\"']?$").cast("double"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "slashes": F.col("before").rlike("[/\\\\.]$").cast("double"),
        "test_path": F.lower("path").rlike(TEST_PATHS).cast("double"),
    }


def labelled_findings(spark: SparkSession, rows: int = MADE, seed: int = 11) -> DataFrame:
    """Findings with ``label`` 1 (secret) or 0, made from a seed, the same on every run."""

    def draw(salt: int) -> Column:
        return F.xxhash64("id", F.lit(seed), F.lit(salt))

    def chars(alphabet: str, n: Column, salt: int) -> Column:
        one = lambda i: F.substring(F.lit(alphabet), F.pmod(F.xxhash64("id", F.lit(seed * 31 + salt), i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")

    def pick(options: list[str], salt: int) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), F.pmod(draw(salt), F.lit(len(options))).cast("int") + 1)

    def between(low: int, high: int, salt: int) -> Column:
        return (F.pmod(draw(salt), F.lit(high - low + 1)) + low).cast("int")

    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, mixed = "0123456789abcdef", lower + upper + digit
    uuid = F.concat_ws("-", *[chars(hexa, F.lit(n), 40 + i) for i, n in enumerate((8, 4, 4, 4, 12))])
    words = lambda salt: pick(DICTIONARY, salt)
    lead = pick(["token = \"", "TOKEN = \"", "secret: '", "api_key=", "password = \"", "Authorization: Bearer ", "access-key: ", "auth_token=\""], 1)
    hashes = pick(["commit ", "sha256:", "md5: ", "etag \"", "checksum = ", "revision ", "blob "], 2)
    plain = pick(["the ", "see ", "and then ", "number ", "id=", "of the ", "/", "file "], 3)
    path = pick(["src/app", "src3", "conf/prod", "web", "", "lib/core"], 4)
    kinds = [
        # label, candidate, before, path
        (1, chars(hexa, pick(["32", "40", "64"], 5).cast("int"), 6), lead, path),
        (1, chars(hexa.upper(), F.lit(40), 7), lead, path),
        (1, chars(mixed, between(20, 44, 8), 9), lead, path),
        (1, F.concat(F.lit("AKIA"), chars(upper + digit, F.lit(16), 10)), F.when(F.pmod(draw(11), F.lit(2)) == 0, lead).otherwise(plain), path),
        (1, F.concat(pick(["ghp_", "sk_live_", "xoxb-", "glpat-"], 12), chars(mixed, between(24, 36, 13), 14)), F.when(F.pmod(draw(15), F.lit(2)) == 0, lead).otherwise(plain), path),
        (1, chars(hexa, F.lit(40), 16), lead, path),
        (0, chars(hexa, pick(["32", "40", "64"], 17).cast("int"), 18), hashes, path),
        (0, uuid, pick(["id=", "uuid: ", "request ", "token ring "], 19), path),
        (0, chars(digit, between(16, 19, 20), 21), plain, path),
        (0, F.concat_ws("_", words(22), words(23), words(24), chars(digit, F.lit(2), 25)), F.when(F.pmod(draw(26), F.lit(2)) == 0, lead).otherwise(plain), path),
        (0, F.concat(pick(["your_api_key_here_", "EXAMPLEKEY0000", "xxxxxxxxxxxxxxx", "changeme12345678", "0000000000000000", "1234567890abcdef"], 27), chars(digit, F.lit(2), 28)), lead, path),
        (0, F.concat(words(29), F.initcap(words(30)), F.initcap(words(31)), chars(digit, between(1, 4, 32), 33)), plain, path),
        (0, chars(hexa, F.lit(40), 34), lead, pick(["tests/fixtures", "docs/example", "spec/mock", "samples"], 35)),
        (1, F.concat(pick(["Tr", "kW", "x9", "Q!"], 43), chars(mixed + "&!%.#@", between(7, 13, 44), 45), pick(["&3", "!7", ".q", "#Z"], 46)), lead, path),
        (1, F.concat(F.lit("AKIA"), chars(upper, F.lit(16), 47)), lead, path),
        (0, F.concat(pick(["AKIA", "ghp_", "sk_live_"], 48), chars(upper + digit, F.lit(9), 49), pick(["EXAMPLE", "SAMPLE", "TESTKEY"], 50)), lead, path),
        (0, F.concat(words(52), pick(["-", ".", "_", ""], 51), words(53)), lead, path),
        (0, F.concat(words(36), F.lit("/"), words(37), F.lit("/"), words(38), chars(digit, F.lit(4), 39)), plain, path),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))
    made = F.lit(None)
    for i, (label, candidate, before, where) in enumerate(kinds):
        row = F.struct(F.lit(float(label)).alias("label"), candidate.alias("candidate"), F.coalesce(before, F.lit("")).alias("before"), where.alias("path"))
        made = F.when(kind == i, row).otherwise(made)
    shown = spark.range(0, rows, 1, 2).select(made.alias("m")).select("m.*")
    quote = F.regexp_extract("before", "[\"']$", 0)
    return shown.withColumn("after", F.concat(quote, F.lit(" and more")))


#: Letters without case, then digits, then all else.
_CLASSES = 28


def _folded(column: str) -> str:
    """SQL: the candidate in characters from ``a`` on, one for each class."""
    return f"regexp_replace(regexp_replace(lower({column}), '[0-9]', '{{'), '[^a-z{{]', '|')"


def transitions(labelled: DataFrame) -> list[float]:
    """Log-odds of each pair of neighbouring classes, secrets against the rest, 1 added to every count.

    At most ``_CLASSES`` squared rows come to the driver.
    """
    chars = labelled.where("length(candidate) > 1").selectExpr("label", f"{_folded('candidate')} AS f")
    pairs = chars.select("label", F.explode(F.expr("transform(sequence(1, length(f) - 1), i -> (ascii(substr(f, i, 1)) - 97) * 28 + ascii(substr(f, i + 1, 1)) - 97)")).alias("pair"))
    counted = pairs.groupBy("pair").agg(F.sum("label").alias("secret"), F.sum(1 - F.col("label")).alias("other")).collect()
    held = {r["pair"]: (r["secret"], r["other"]) for r in counted}
    size = _CLASSES**2
    of = [sum(x[i] for x in held.values()) + size for i in (0, 1)]
    return [math.log((a + 1) / of[0]) - math.log((b + 1) / of[1]) for a, b in (held.get(p, (0, 0)) for p in range(size))]


def train(labelled: DataFrame, trees: int = 24, depth: int = 8, seed: int = 11) -> PipelineModel:
    """A forest over ``label, candidate, before, after, path``."""
    made = features()
    odds = ", ".join(f"{x:.6f}D" for x in transitions(labelled))
    mean = f"""aggregate(sequence(1, length(_folded) - 1), 0D, (t, i) -> t + get(array({odds}),
        (ascii(substr(_folded, i, 1)) - 97) * {_CLASSES} + ascii(substr(_folded, i + 1, 1)) - 97)) / (length(_folded) - 1)"""
    fold = SQLTransformer(statement=f"SELECT *, {_folded('candidate')} AS _folded FROM __THIS__")
    walk = SQLTransformer(statement=f"SELECT *, IF(length(_folded) > 1, {mean}, 0D) AS transitions FROM __THIS__")
    gather = VectorAssembler(inputCols=[*made, "transitions"], outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features")
    rows = labelled.withColumns(made).na.fill(0.0)
    for step in (fold, walk, gather):
        rows = step.transform(rows)
    return PipelineModel([fold, walk, gather, forest.fit(rows)])


def scan(docs: DataFrame, labelled: DataFrame | None = None, least: int = LEAST, path: str = "source") -> DataFrame:
    """Every candidate with ``probability`` and the verdict ``secret``."""
    model = train(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    found = candidates(docs, least, path).withColumns(features())
    scored = model.transform(found)
    return scored.select(
        "doc_id", "path", "start", F.length("candidate").alias("length"), "candidate",
        vector_to_array("probability")[1].alias("probability"),
        (F.col("prediction") == 1).alias("secret"),
    )
