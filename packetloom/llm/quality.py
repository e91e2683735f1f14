"""Operator 10, quality rules: base counts, and divergence from references of the language, by DataFrame functions only.

Two histograms of a document are held against those of its language: of character classes, and of the language's
common words (with all others as one bin). A reference is the mean histogram of all the language's documents that are
long enough. Divergence is the Jensen-Shannon distance, from 0 to 1 (base 2). Documents with fewer words than the guard
aren't judged by divergence; nor are common words where the language has no list.

Words are runs of characters other than ASCII white space. Null and empty texts have no words, all counts zero. A null
language is one of its own. Repeated rows each give a row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import written

WHITE, WORD_CHAR = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
LEAST_WORDS, REPEATED_SHARE, WINDOW = 20, 30, 8
#: No verdict by divergence on fewer words; distances above these fail.
GUARD_WORDS, CLASS_LIMIT, COMMON_LIMIT = 80, 0.25, 0.3

#: Character classes by pattern; white space and the rest are counted by subtraction.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "mark": "[.,;:!?'\"()-]", "symbol": r"[#*$%&|<>@+=/\\^_`~{}\[\]]", "beyond_ascii": r"[^\x00-\x7F]"}
#: Common words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "that", "is", "was", "for", "with", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "ist", "für"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "por"],
}


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common): no shuffle.

    n_repeat_words: words in windows of WINDOW words that occur twice or more; windows are compared as 64-bit hashes,
    sorted so that equal ones meet, and the places of those are merged.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", WHITE + "+"), lambda w: w != ""))
    rows = rows.withColumn("n", F.size("words"))
    # the hash of each word, then of each window of them
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(1), F.col("n") - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    rows = rows.withColumn("windows", F.when(F.col("n") >= WINDOW, windows))
    numbered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(repeated, numbered))
    last = F.size("sorted") - 1
    twice = F.filter("sorted", lambda x, k: ((k > 0) & (F.get("sorted", k - 1)["h"] == x["h"])) | ((k < last) & (F.get("sorted", k + 1)["h"] == x["h"])))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["to"], i)).alias("n"), (i + WINDOW).alias("to")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_CHAR))
    chars = F.length(F.array_join("words", ""))
    by_class = {name: F.regexp_count("text", F.lit(pattern)) for name, pattern in CLASSES.items()}
    listed = sorted({w for words in COMMON_WORDS.values() for w in words})
    common = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(listed))
    own = F.lit(None).cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        own = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(own)
    rows = rows.select(
        "doc_id",
        "lang",
        "n",
        chars.alias("word_chars"),
        F.length("text").alias("length"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).alias("n_repeat_words"),
        F.struct(*(c.alias(name) for name, c in by_class.items())).alias("c"),
        common.alias("found"),
        own.alias("own"),
    )
    bins = [F.col(f"c.{name}") for name in CLASSES]
    white = F.col("length") - F.col("word_chars")
    rest = F.col("length") - white
    for one in bins:
        rest = rest - one
    classes = F.array(*(b.cast("double") for b in (*bins, white, rest)))
    hits = F.transform("own", lambda o: F.size(F.filter("found", lambda w: w == o)).cast("double"))
    long = {name: F.col(name).cast("long").alias(name) for name in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    out = rows.select("doc_id", "lang", F.col("n").cast("long").alias("n_words"), *long.values(), classes.alias("classes"), hits.alias("hits"))
    others = F.col("n_words") - F.aggregate("hits", F.lit(0.0), lambda a, x: a + x)
    return out.select(*(c for c in out.columns if c != "hits"), F.concat("hits", F.array(others)).alias("common"))


def shares(histogram: Column) -> Column:
    total = F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x)
    return F.transform(histogram, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def references(counted: DataFrame, least_words: int = GUARD_WORDS) -> DataFrame:
    """(lang, class_reference, common_reference): mean shares over all documents of a language with enough words. One row
    of partial sums for each task and language is shuffled."""
    bins_class, bins_common = len(CLASSES) + 2, 1 + len(next(iter(COMMON_WORDS.values())))
    long_enough = counted.where(F.col("n_words") >= least_words).select("lang", shares(F.col("classes")).alias("p"), shares(F.col("common")).alias("q"))
    means = [F.avg(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(bins_class)] + [F.avg(F.get("q", F.lit(i))).alias(f"q{i}") for i in range(bins_common)]
    summed = long_enough.groupBy("lang").agg(*means)
    common = F.when(F.col("q0").isNotNull(), F.array(*(f"q{i}" for i in range(bins_common))))
    return summed.select("lang", F.array(*(f"p{i}" for i in range(bins_class))).alias("class_reference"), common.alias("common_reference"))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, least_words: int = GUARD_WORDS, class_limit: float = CLASS_LIMIT, common_limit: float = COMMON_LIMIT) -> DataFrame:
    """The counts of (doc_id, text, lang), base_failed, both distances (null where not judged), and kept.

    The counts, some hundred bytes a row, are written to the shared folder, as the references need all of them first.
    References are one row a language and are joined; Spark sends them to all executors if they are small.
    """
    counted = written(counts(docs), "quality-counts")
    joined = counted.join(references(counted, least_words).withColumnRenamed("lang", "lang_"), F.col("lang") == F.col("lang_"), "left")
    enough = F.col("n_words") >= least_words
    joined = joined.withColumn("class_distance", F.when(enough, divergence(shares(F.col("classes")), F.col("class_reference"))))
    joined = joined.withColumn("common_distance", F.when(enough, divergence(shares(F.col("common")), F.col("common_reference"))))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_SHARE * F.col("n_words"))
    far = F.coalesce(F.col("class_distance") > class_limit, F.lit(False)) | F.coalesce(F.col("common_distance") > common_limit, F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "common_distance")
