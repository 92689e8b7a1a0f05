"""Secret scans: candidates by pattern, false positives removed by a random forest.  DataFrame functions only.

A candidate is a value given to a name such as password, token or api key, a whole private key block, or a run of at
least 16 key characters with a digit in it.  The forest sees the candidate's length, its character transitions, how
much of it dictionary words cover, path signs and the neighbouring words.  It learns from labelled findings; where
none are given, ``label_findings`` labels those that a rule can decide for certain and leaves out the others.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.persist import cut
from tessera.llm.common import pick

#: Partitions that the labelled findings are dealt to by their value: the same findings give the same forest.
FIT_PARTS = 16
NEIGHBOURHOOD = 80
#: A word belongs to the dictionary when it stands outside candidates in so many documents.
DICTIONARY_DOCS = 3
#: Names that secrets are given to, heads of issued keys, and words of made-up values.
NAMES = "pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credential|private[_-]?key|client[_-]?secret"
ISSUED = "^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|eyJ[A-Za-z0-9])|PRIVATE KEY"
PLACEHOLDER = "(?i)example|sample|dummy|placeholder|change_?me|your[_-]|test_|x{6,}|0{8,}|12345678|\\*{4,}"
#: A private key from BEGIN to END, or, where no END follows, to the end of its lines of base64.
HEAD = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
BREAK = "(?:\\s|\\\\[nrt])"
BREAK_LINE = "[ \\t\\r]*+(?:\\n|\\\\r\\\\n|\\\\n)[ \\t]*+"
KEY_BLOCK = (
    f"{HEAD}(?:[^-]*+(?:-(?!----)[^-]*+){{0,200}}+-----END [A-Z ]{{0,40}}PRIVATE KEY-----"
    f"|(?:{BREAK}*+(?:Proc-Type|DEK-Info):[^\\n\\\\]*+)*+(?:{BREAK}*+[A-Za-z0-9+/]{{24,}}+={{0,2}}+)++(?:{BREAK_LINE}[A-Za-z0-9+/]++={{0,2}}+(?=[ \\t\\r]*+(?:\\n|\\\\[nr]|[\"']|$)))?+|)"
)
FOUND = (
    f"(?i:(?<![A-Za-z0-9])(?:{NAMES}))[A-Za-z0-9_-]{{0,40}}[\"']?\\s{{0,3}}[=:]\\s{{0,3}}[\"']?(?!{HEAD})[^\\s\"']{{8,}}[\"']?"
    f"|{KEY_BLOCK}"
    "|(?<![A-Za-z0-9+/_-])(?=[A-Za-z/+_-]*[0-9])[A-Za-z0-9+/_-]{16,}"
)
NAMED = f"(?i)^({NAMES})[A-Za-z0-9_-]{{0,40}}[\"']?\\s{{0,3}}[=:]\\s{{0,3}}"
FEATURES = ["length", "transitions", "distinct_share", "digit_share", "upper_share", "lower_share", "sign_share", "hex", "vowel_share", "longest_letters", "covered", "path_signs", "after_path", "named", "in_quotes", "issued", "placeholder", "near_secret_word", "near_placeholder", "left_digits"]


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: finding, doc_id, start (characters), value_length, name, value, left, right.  Written."""
    texts = pick(docs, doc_id=id_col, text=text_col).filter(F.col("text").rlike(FOUND))
    found = F.regexp_extract_all("text", F.lit(FOUND), F.lit(0))
    cut_up = texts.select("doc_id", F.monotonically_increasing_id().alias("doc_row"), found.alias("match"), F.split("text", FOUND, -1).alias("gap"))
    near = F.lit(NEIGHBOURHOOD)
    pairs = F.transform(F.col("match"), lambda m, i: F.struct(m.alias("match"), F.length(F.get("gap", i)).alias("before"), F.right(F.get("gap", i), near).alias("left"), F.left(F.get("gap", i + 1), near).alias("right")))
    rows = cut(cut_up.select("doc_id", "doc_row", F.posexplode(pairs).alias("place", "c")).select("doc_id", "doc_row", "place", "c.*"))
    so_far = Window.partitionBy("doc_row").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.sum(F.col("before") + F.length("match")).over(so_far) - F.length("match")
    name = F.regexp_extract("match", NAMED, 1)
    bare = F.when(name != "", F.regexp_replace("match", NAMED, "")).otherwise(F.col("match"))
    placed = rows.withColumn("at", at).withColumn("name", name).withColumn("bare", bare)
    value = F.regexp_replace("bare", "^[\"']|[\"']$", "")
    placed = placed.withColumn("value", value).withColumn("start", F.col("at") + F.length("match") - F.length("bare") + F.when(F.col("bare").rlike("^[\"']"), 1).otherwise(0))
    quoted = F.col("bare").rlike("^[\"']").cast("int")
    return cut(placed.select(F.xxhash64("doc_row", "place").alias("finding"), "doc_row", "doc_id", F.col("start").cast("long").alias("start"), F.length("value").cast("long").alias("value_length"), "name", "value", quoted.alias("quoted"), "left", "right"))


def share(value: Column, drop: str) -> Column:
    """Share of the characters of ``value`` that the class ``drop`` matches."""
    return 1 - F.length(F.regexp_replace(value, drop, "")) / F.greatest(F.length(value), F.lit(1))


def letter_runs(c: Column) -> Column:
    """The runs of three or more letters, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("\\p{L}{3,}"), F.lit(0))


def dictionary_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word): the letter runs that stand outside candidates in several of all documents, over their whole texts."""
    outside = F.regexp_replace(F.col(f"`{text_col}`"), FOUND, " ")
    words = docs.select(F.explode(F.array_distinct(letter_runs(outside))).alias("word"))
    return words.groupBy("word").count().filter(F.col("count") >= DICTIONARY_DOCS).select("word")


def with_features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The candidates with the forest's features; the ``dictionary`` (word) is joined, never collected."""
    runs = found.select("finding", F.explode(letter_runs(F.col("value"))).alias("word"))
    covered = runs.join(dictionary, "word").groupBy("finding").agg(F.sum(F.length("word")).alias("covered_letters"))
    v, size = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    turns = F.size(F.split("value", "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])")) - 1
    longest = F.array_max(F.transform(F.split(v, "[^A-Za-z]+"), F.length))
    both = F.concat_ws(" ", "left", "right")
    flag = lambda c: c.cast("double")
    return found.join(covered, "finding", "left").select(
        *found.columns,
        F.length(v).cast("double").alias("length"), (turns / size).alias("transitions"), (F.size(F.array_distinct(F.split(v, ""))) / size).alias("distinct_share"),
        share(v, "[0-9]").alias("digit_share"), share(v, "[A-Z]").alias("upper_share"), share(v, "[a-z]").alias("lower_share"), share(v, "[^A-Za-z0-9]").alias("sign_share"),
        flag(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hex"), share(F.lower(v), "[aeiou]").alias("vowel_share"), F.coalesce(longest, F.lit(0)).cast("double").alias("longest_letters"),
        (F.coalesce("covered_letters", F.lit(0)) / size).alias("covered"), (F.size(F.split(v, "[/.\\\\]")) - 1).cast("double").alias("path_signs"), flag(F.col("left").rlike("[/\\\\.]$|://\\S*$")).alias("after_path"),
        flag(F.col("name") != "").alias("named"), F.col("quoted").cast("double").alias("in_quotes"), flag(v.rlike(ISSUED)).alias("issued"), flag(v.rlike(PLACEHOLDER)).alias("placeholder"),
        flag(both.rlike(f"(?i)\\b(?:{NAMES})\\b")).alias("near_secret_word"), flag(both.rlike(PLACEHOLDER)).alias("near_placeholder"), share(F.col("left"), "[0-9]").alias("left_digits"),
    )


def label_findings(found: DataFrame) -> DataFrame:
    """``found`` (with features) with a label where a rule is certain: 1 a secret, 0 none; other rows are left out.

    Secrets: issued heads, and named values of 16 or more characters that mix digits and letters, that no dictionary
    word covers and that are not made up.  Not secrets: digits alone without a name, made-up values, values mostly
    covered by words, and paths.
    """
    mixed = (F.col("digit_share") > 0.05) & (F.col("digit_share") < 0.95)
    made_up = F.col("placeholder") > 0
    yes = ((F.col("issued") > 0) | ((F.col("named") > 0) & (F.col("length") >= 16) & mixed & (F.col("covered") < 0.5))) & ~made_up
    no = made_up | ((F.col("digit_share") == 1) & (F.col("named") == 0)) | (F.col("covered") >= 0.8) | ((F.col("path_signs") >= 2) & (F.col("named") == 0))
    return found.withColumn("label", F.when(yes, 1).when(no, 0)).filter("label is not null")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: doc_id, start, value_length, name, value, value_sha256, score, is_secret.

    ``labelled``: findings in the form of ``with_features`` with a 0/1 ``label``; by default the certain findings of
    these documents.  The forest is fitted on all of them and rates every candidate.  Findings of one kind only give that kind's rate to all; without any, named candidates
    are secrets.  Null and empty texts have no candidates; repeated documents have theirs each.
    """
    found = cut(with_features(find_candidates(docs, id_col, text_col), dictionary_of(docs, text_col)))
    certain = label_findings(found) if labelled is None else labelled
    fit = certain.select(*FEATURES, F.col("label").cast("double").alias("label"), "value").repartition(FIT_PARTS, "value").sortWithinPartitions("value", *FEATURES, "label").drop("value")
    kinds = {int(r["label"]): r["count"] for r in fit.groupBy("label").count().collect()}
    if len(kinds) == 2:
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=30, maxDepth=6, seed=11).fit(assemble.transform(fit))
        rated = forest.transform(assemble.transform(found)).withColumn("score", vector_to_array(F.col("probability"))[1])
    else:
        rated = found.withColumn("score", F.lit(float(next(iter(kinds)))) if kinds else F.col("named"))
    # a private key block with key lines is a secret by its form
    block = F.col("value").rlike(f"^{HEAD}[\\s\\S]*?[A-Za-z0-9+/]{{24}}")
    rated = rated.withColumn("score", F.when(block, 1.0).otherwise(F.col("score")))
    return rated.select("doc_id", "start", "value_length", "name", "value", F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= 0.5).alias("is_secret"))


def redact_secrets(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret value of ``findings`` replaced by ``mark`` in the texts of its document."""
    secrets = findings.filter("is_secret").groupBy(F.col("doc_id").alias("__doc")).agg(F.sort_array(F.collect_set("value"), asc=False).alias("__values"))
    joined = docs.join(secrets, F.col(f"`{id_col}`").eqNullSafe(F.col("__doc")), "left")
    masked = F.aggregate(F.coalesce("__values", F.array().cast("array<string>")), F.col(f"`{text_col}`"), lambda text, value: F.replace(text, value, F.lit(mark)))
    return joined.withColumn(text_col, masked).select(*docs.columns)
