"""Secrets in texts: wide candidate search, then a random forest that removes false positives. DataFrame functions and Spark ML only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapgrid.llm.frames import stored

#: Signs before and after a candidate that are looked at.
AROUND = 48
_FORMATS = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk_(live|test)_[A-Za-z0-9]{16,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{35}$|^-----BEGIN |^eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\."
_NAMES = r"(?i)(pass(word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)"
_ASSIGNED = _NAMES + r"[A-Za-z_-]*[\"']?\s*(=|:|=>|:=)\s*[\"']?$"
_IN_URL = r"://[^\s/:@\"']{0,256}:$"
# Java looks back over bounded lengths only; the first look, over few signs, spares the second in most places.
_AFTER_NAME = r"(?<=[=:>\s\"'])(?<=[=:>]\s{0,3}[\"']?)(?<=" + _NAMES.replace("(?i)(", "(?i:") + r"[A-Za-z_-]{0,40}[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?)"
#: What may be a secret: key blocks, values assigned to one of the names (quoted, or without blanks, from 6 signs), passwords in
#: URLs, and runs of 16 or more signs that keys are written in, with what follows after dots.
CANDIDATE = "|".join([
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----",
    _AFTER_NAME + r"(?:(?<=\")[^\"\r\n]{6,}+(?=\")|(?<=')[^'\r\n]{6,}+(?=')|[^\s\"'`,;<>(){}\[\]]{5,}[^\s\"'`,;.:<>(){}\[\]])",
    r"(?<=:)(?<=" + _IN_URL[:-1] + r")[^\s/@\"']++(?=@)",
    r"[A-Za-z0-9+/_-]{16,}(?:(?:\.[A-Za-z0-9_-]{4,}){2,4}|={0,2})",
])
#: Whole words only, and not the names of sites such as example.com.
_HARMLESS = r"(?i)(?<![a-z])((example|sample|dummy|placeholder|changeme|x{4,}|test|mock|fake|checksum|commit|digest|sha1|sha256|md5|uuid|isbn)(?!\.?[a-z])|your[_-])"
FEATURES = [
    "length", "digits", "capitals", "smalls", "signs", "hexadecimal", "transitions", "distinct", "vowels", "longest_word", "dictionary",
    "named", "assigned", "quoted", "in_url", "harmless_near", "harmless_path", "path_depth", "words_before", "words_after",
]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def candidates(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc, text_hash, path, start, found, before, after, cid): each candidate of the whole texts with what stands around it.

    text_hash tells the texts of one key, or of no key, apart. start counts characters from 0. Candidates and the pieces between them come from the same
    pattern, so that their lengths add up to the places.
    """
    body = F.col(text)
    parts = docs.where(F.rlike(body, F.lit(CANDIDATE))).select(
        F.col(key).alias("doc"), F.xxhash64(body).alias("text_hash"), (F.col(path).cast("string") if path else F.lit("")).alias("path"),
        F.split(body, CANDIDATE, -1).alias("between"), F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)).alias("found"),
    )
    zero = F.lit(0).cast("long")
    both = F.arrays_zip("between", "found")
    walked = F.aggregate(
        both,
        F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda s, x: _let(
            s["at"] + F.length(x["between"]),
            lambda at: F.struct((at + F.coalesce(F.length(x["found"]), zero)).alias("at"), F.concat(s["starts"], F.array(at)).alias("starts")),
        ),
        lambda s: s["starts"],
    )
    rows = parts.withColumn("starts", walked).select("*", F.posexplode("found").alias("i", "one"))
    out = rows.select(
        "doc", "text_hash", "path", F.get("starts", F.col("i")).alias("start"), F.col("one").alias("found"),
        F.right(F.get("between", F.col("i")), F.lit(AROUND)).alias("before"), F.left(F.get("between", F.col("i") + 1), F.lit(AROUND)).alias("after"),
    )
    return stored(out.withColumn("cid", F.monotonically_increasing_id()), "secret-candidates")


def dictionary(docs: DataFrame, least_docs: int = 5, text: str = "text") -> DataFrame:
    """(word): runs of three or more ASCII letters, in lower case, in at least `least_docs` texts of the corpus."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), "[^a-z]+"), lambda w: F.length(w) > 2))
    return docs.select(F.explode(words).alias("word")).groupBy("word").count().where(F.col("count") >= least_docs).select("word")


def _share(found: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(found, pattern, "")) / F.length(found)


def with_features(found: DataFrame, known: DataFrame) -> DataFrame:
    """`found` with a column for each of FEATURES."""
    c, before, after = F.col("found"), F.col("before"), F.col("after")
    # What is cut at AROUND may begin or end within a word, which is then none.
    whole_before = F.when(F.length(before) < AROUND, before).otherwise(F.regexp_replace(before, "^[A-Za-z]+", ""))
    whole_after = F.when(F.length(after) < AROUND, after).otherwise(F.regexp_replace(after, r"\.?[A-Za-z]+\.?$", ""))
    runs = F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: F.length(w) > 2)
    pieces = found.select("cid", F.explode(runs).alias("word"))
    covered = pieces.join(known, "word").groupBy("cid").agg(F.sum(F.length("word")).alias("covered"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    flag = lambda x: x.cast("double")
    rated = found.join(covered, "cid", "left").withColumns(
        {
            "length": F.length(c).cast("double"),
            "digits": _share(c, "[0-9]"),
            "capitals": _share(c, "[A-Z]"),
            "smalls": _share(c, "[a-z]"),
            "signs": _share(c, "[+/_=-]"),
            "hexadecimal": flag(F.rlike(c, F.lit("^([0-9a-f]+|[0-9A-F]+)$"))),
            "transitions": (F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) - 1) / F.length(c),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
            "vowels": _share(F.lower(c), "[aeiouy]"),
            "longest_word": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)) / F.length(c),
            "dictionary": F.coalesce(F.col("covered"), F.lit(0)) / F.length(c),
            "named": flag(F.rlike(before, F.lit(_NAMES))),
            "assigned": flag(F.rlike(before, F.lit(r"(=|:)\s*[\"']?$"))),
            "quoted": flag(F.rlike(before, F.lit("[\"'`]$"))),
            "in_url": flag(F.rlike(before, F.lit(_IN_URL)) & F.startswith(after, F.lit("@"))),
            "harmless_near": flag(F.rlike(F.concat_ws(" ", whole_before, c, whole_after), F.lit(_HARMLESS))),
            "harmless_path": flag(F.rlike(F.col("path"), F.lit(_HARMLESS))),
            "path_depth": (F.size(F.split("path", "/")) - 1).cast("double"),
            "words_before": F.size(F.filter(F.split(before, "[^A-Za-z]+"), lambda w: F.length(w) > 1)).cast("double"),
            "words_after": F.size(F.filter(F.split(after, "[^A-Za-z]+"), lambda w: F.length(w) > 1)).cast("double"),
        }
    )
    return rated.drop("covered").fillna(0.0, FEATURES)


def label_of() -> Column:
    """1 for a finding that its format or assignment proves, 0 for a proven false one, else null.

    Proven: a provider's format, a key block, a password in a URL, or digits and letters mixed that are assigned to a name such as password or token, whatever
    words are around; with a harmless word in the finding itself it is left unlabelled. False: what is not proven and has
    only digits, only letters of one case, or harmless words around. These are the labelled findings where none are given.
    """
    mixed = (F.col("digits") > 0.1) & (F.col("digits") < 1.0)
    proven = F.rlike("found", F.lit(_FORMATS)) | (F.rlike("before", F.lit(_ASSIGNED)) & mixed) | (F.col("in_url") == 1.0)
    false = (F.col("digits") == 1.0) | F.rlike("found", F.lit("^([a-z]+|[A-Z]+|[A-Z][a-z]+)$")) | (F.col("harmless_near") == 1.0)
    return F.when(proven & ~F.rlike("found", F.lit(_HARMLESS)), 1.0).when(false & ~proven, 0.0)


def train(labelled: DataFrame, most_findings: int = 100_000, trees: int = 20, depth: int = 6):
    """A random forest from (label, FEATURES) rows, or None if a class has none.

    Of each label at most about `most_findings` rows are used, picked by a hash of the finding: a bound on
    the fit alone. All other work covers all rows.
    """
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not counts.get(0.0) or not counts.get(1.0):
        return None
    share = F.when(F.col("label") == 1.0, most_findings / counts[1.0]).otherwise(most_findings / counts[0.0])
    sample = labelled.where(F.pmod(F.xxhash64("found", "before"), F.lit(1_000_000)) < share * 1_000_000)
    weight = F.when(F.col("label") == 1.0, 1.0 / counts[1.0]).otherwise(1.0 / counts[0.0]) * sum(counts.values())
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.select("label", weight.alias("weight"), *FEATURES))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, weightCol="weight", featureSubsetStrategy="sqrt")
    return forest.fit(rows)


def find_secrets(
    docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", key: str = "doc_id", path: str | None = "source", least_probability: float = 0.5
) -> DataFrame:
    """One row for each candidate in `docs`: `key`, start, length (in characters), found, probability, is_secret, text_hash.

    `labelled` are findings (label 0.0 or 1.0 and FEATURES, as from with_features); without them, the
    proven ones of `docs` themselves teach the forest. The forest judges every candidate, the labelled too. If a label does
    not occur, a candidate is a secret if label_of proves it, with probability 0 where it says nothing.
    Null or empty text has no candidate; a null path is empty; repeated rows give repeated findings; other columns are left out.
    """
    found = candidates(docs, text, key, path)
    rated = stored(with_features(found, dictionary(docs, text=text)).fillna("", ["path"]), "secret-features")
    model = train(labelled if labelled is not None else rated.withColumn("label", label_of()).where("label is not null"))
    if model is None:
        judged = rated.withColumn("probability", F.coalesce(label_of(), F.lit(0.0)))
    else:
        judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rated))
        judged = judged.withColumn("probability", vector_to_array("probability")[1])
    return judged.select(
        F.col("doc").alias(key), "start", F.length("found").cast("long").alias("length"), "found", "probability", (F.col("probability") >= least_probability).alias("is_secret"), "text_hash"
    )


def without_secrets(docs: DataFrame, secrets: DataFrame, text: str = "text", key: str = "doc_id", mark: str = "[secret]") -> DataFrame:
    """`docs` with the findings of `secrets` (as from find_secrets) replaced by `mark` in their texts.

    Every place where the found string stands as a candidate goes, in all rows with its key and text; so a list of
    findings is one text's own, also where many rows have no key or share one. Null texts stay null.
    """
    listed = secrets.where("is_secret").groupBy(F.col(key).alias("_secret_key"), F.col("text_hash").alias("_secret_text"))
    listed = listed.agg(F.collect_set("found").alias("_secret_list"))
    same = F.col(key).eqNullSafe(F.col("_secret_key")) & (F.xxhash64(F.col(text)) == F.col("_secret_text"))
    joined = docs.join(listed, same, "left")
    between, found = F.split(F.col(text), CANDIDATE, -1), F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0))
    hidden = F.transform(found, lambda x: F.when(F.array_contains("_secret_list", x), mark).otherwise(x))
    rebuilt = F.array_join(F.transform(F.arrays_zip(between.alias("a"), hidden.alias("b")), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit("")))), "")
    new = F.when(F.col("_secret_list").isNull(), F.col(text)).otherwise(rebuilt)
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
