"""Quality rules by distribution divergence, in built-in functions only.

Every document gets a histogram of character classes and one of common words. The references are the
mean histograms of the corpus itself, one for each known language and one for the rest, over documents
that pass the base rules. A document whose Jensen-Shannon distance to its reference is too large is
rejected, unless it is too short to judge. How far is too far for words follows from the distances of each
language's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import ASCII_SPACE, unused, written

# Frequent short words of four languages, each list in its usual order of frequency.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "with"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "ist", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "une", "que", "est", "pour", "dans"],
    "es": ["que", "el", "en", "y", "los", "del", "se", "las", "por", "con", "no", "para"],
}
#: Beyond these distances (square root of the divergence in bits, 0 to 1) a document is rejected.
MAX_CLASS_DISTANCE = 0.28
#: The derived word limit: so many times the distance from the lower quartile to the median above the median.
#: Both lie among the usual documents, so up to half of a language may be junk without moving the limit far.
WORD_SPREADS = 6
#: Shorter documents keep their base verdict: their histograms say too little. Above the 50 words of the base rules.
MIN_WORDS = 80


def vocabulary() -> list[str]:
    return list(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))


def repeated_window_words(words: str, hashes: str, repeated: str, pairs: str) -> Column:
    """Words inside a 3-word window found twice or more, each word once. ``repeated`` holds the distinct
    hashes met twice; few of them are looked up directly, many through ``pairs`` sorted by (hash, place)."""
    few = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(repeated, F.get(hashes, i)))
    many = F.sort_array(
        F.transform(
            F.filter(pairs, lambda x, j: x["h"].eqNullSafe(F.get(pairs, j - 1)["h"]) | x["h"].eqNullSafe(F.get(pairs, j + 1)["h"])),
            lambda x: x["i"],
        )
    )
    places = F.when(F.size(repeated) == 0, F.array().cast("array<int>")).when(F.size(repeated) <= FEW, few).otherwise(many)
    covered = lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0), lambda acc, j: acc + F.coalesce(F.least(F.lit(3), F.get(p, j) - F.get(p, j - 1)), F.lit(3)))
    )
    return F.get(F.transform(F.array(places), covered), F.lit(0)).cast("long")


#: Repeated windows that are looked up one by one; a speed setting only, both ways are exact.
FEW = 8


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns (clashing names replaced) with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, and the two histograms as arrays of counts."""
    docs, back = _set_aside(docs, text)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("__t", t).withColumn("__words", F.array_remove(F.split("__t", f"{ASCII_SPACE}+"), ""))
    out = out.withColumn(
        "__hashes",
        F.when(F.size("__words") >= 3, F.transform(F.sequence(F.lit(0), F.size("__words") - 3), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))).otherwise(F.array().cast("array<bigint>")),
    )
    out = out.withColumn("__sorted", F.sort_array("__hashes"))
    out = out.withColumn("__repeated", F.array_distinct(F.filter("__sorted", lambda x, j: x.eqNullSafe(F.get("__sorted", j - 1)))))
    out = out.withColumn("__pairs", F.when(F.size("__repeated") > FEW, F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    count = lambda drop: F.length(F.regexp_replace("__rest", drop, ""))
    # lower-case letters and white space go first: the other classes are counted on the little that is left
    out = out.withColumn("__rest", F.regexp_replace("__t", "[a-z\\x20\\x09-\\x0D]+", ""))
    # the set lookup leaves few words, which are then counted one by one
    out = out.withColumns({"__lines": lines, "__short": F.filter("__words", lambda w: w.isin(*vocabulary()))})
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": count(r"[^#*$%&|<>]+").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated_window_words("__words", "__hashes", "__repeated", "__pairs"),
            "__upper": count(r"[^\p{Lu}]+").cast("double"),
            "__digits": count(r"[^0-9]+").cast("double"),
            "__marks": count(r"[^.,;:!?'\"()\[\]-]+").cast("double"),
            "__common": F.array(*[(F.size("__short") - F.size(F.array_remove("__short", w))).cast("double") for w in vocabulary()]),
        }
    )
    rest = F.col("word_chars") - F.col("__upper") - F.col("__digits") - F.col("__marks") - F.col("n_symbols")
    classes = F.array("__upper", "__digits", "__marks", F.col("n_symbols").cast("double"), (F.length("__t") - F.col("word_chars")).cast("double"), rest.cast("double"))
    others = F.col("n_words") - F.aggregate("__common", F.lit(0.0), lambda a, x: a + x)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, "class_counts": classes, "word_counts": F.concat("__common", F.array(others.cast("double")))})
    return out.drop("__t", "__words", "__hashes", "__sorted", "__repeated", "__pairs", "__rest", "__lines", "__short", "__upper", "__digits", "__marks", "__common").withColumnsRenamed(back)


def _set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """The table with other names for columns that begin as the working columns here do, and the way back to theirs."""
    aside = {}
    for c in docs.columns:
        if c.startswith("__") and c not in used:
            aside[c] = unused("aside" + c, [*docs.columns, *aside.values()])
    return docs.withColumnsRenamed(aside), {new: c for c, new in aside.items()}


def shares(counts: Column, bins: int) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total)).otherwise(F.array_repeat(F.lit(1.0 / bins), bins))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays of equal length, base 2: 0 for equal, 1 for disjoint."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0)))


def word_limits(judged: DataFrame) -> DataFrame:
    """(__ref, __limit), a row for each language: the exact lower quartile and median of the word distances, to four places,
    from counts of at most 10,001 values."""
    seen = judged.where(~F.col("base_failed") & F.col("word_distance").isNotNull()).groupBy("__ref", F.round("word_distance", 4).alias("d")).agg(F.count("*").alias("k"))
    own = Window.partitionBy("__ref")
    seen = seen.withColumns({"upto": F.sum("k").over(own.orderBy("d")), "n": F.sum("k").over(own)})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("d")))
    limits = seen.groupBy("__ref").agg(at(0.25).alias("low"), at(0.5).alias("middle"))
    limit = F.col("middle") + WORD_SPREADS * (F.col("middle") - F.col("low"))
    return limits.select("__ref", F.least(limit, F.lit(1 - 1e-9)).alias("__limit"))  # a text without common words is always beyond


def divergence_rules(docs: DataFrame, text: str = "text", lang: str = "lang", max_class: float = MAX_CLASS_DISTANCE, min_words: int = MIN_WORDS) -> DataFrame:
    """The input's columns (except the text) with the measures, class_distance, word_distance and kept.

    Words are compared among the common words alone (the mass of all others hides any difference), a text without
    one is at distance 1, and the limit of each language is derived from its documents that pass the base rules.

    Null and empty texts have zero words and fail the base rules; texts below ``min_words`` keep the base verdict. Unknown
    and null languages share one reference; where no document of a language passes the base rules its reference
    is missing, the distances are null and the base verdict stands. Repeated rows are judged alike. Columns of the
    input that are called as one of the result are replaced; all others stay. An empty table gives no rows; a
    very long text is measured whole.
    """
    docs, back = _set_aside(docs, text, lang)
    known = F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).otherwise("other")
    made = [c for c in base_measures(docs, text).columns if c != text]
    bins = {"class_counts": 6, "word_counts": len(vocabulary())}
    measured = base_measures(docs, text).select(*made, known.alias("__ref"))
    for c, n in bins.items():
        measured = measured.withColumn(f"__{c}", shares(F.slice(c, 1, n), n))
    common = F.aggregate(F.slice("word_counts", 1, len(vocabulary())), F.lit(0.0), lambda a, x: a + x)
    measured = written(measured, "measures")  # one pass over the texts; a few numbers for each document
    # language x bins means: at most five rows of 54 numbers
    good = measured.where(~F.col("base_failed")).groupBy("__ref")
    told = lambda c, x: F.when(common > 0, x) if c == "word_counts" else x
    means = good.agg(*[F.avg(told(c, F.get(f"__{c}", F.lit(i)))).alias(f"{c}_{i}") for c, n in bins.items() for i in range(n)])
    refs = means.select("__ref", *[F.array(*[f"{c}_{i}" for i in range(n)]).alias(f"__{c}_ref") for c, n in bins.items()])
    judged = measured.join(F.broadcast(refs), "__ref", "left")
    judged = judged.withColumn("class_distance", js_distance(F.col("__class_counts"), F.col("__class_counts_ref")))
    far = F.when(common > 0, js_distance(F.col("__word_counts"), F.col("__word_counts_ref"))).otherwise(1.0)
    judged = judged.withColumn("word_distance", F.when(F.get("__word_counts_ref", F.lit(0)).isNotNull(), far))
    judged = judged.join(F.broadcast(word_limits(judged)), "__ref", "left")  # one row for each language
    far = (F.col("n_words") >= min_words) & ((F.col("class_distance") > max_class) | (F.col("word_distance") > F.col("__limit")))
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    return judged.withColumn("kept", kept).select(*made, "class_distance", "word_distance", "kept").withColumnsRenamed(back)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every whole text. Null and empty texts have no words and fail; unknown and null languages share a
    reference; repeated rows are judged alike; an empty table gives no rows; other columns are not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = divergence_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def oracle() -> str:
    """The same rules in DuckDB SQL."""
    letters = lambda keep: f"length(regexp_replace(t, '[^{keep}]+', '', 'g'))"
    words = ", ".join(f"len(list_filter(w, lambda x: x = '{v}'))" for v in vocabulary())
    share = lambda c, n: f"CASE WHEN list_sum({c}) > 0 THEN list_transform({c}, lambda x: x / list_sum({c})) ELSE list_transform(range({n}), lambda x: 1.0::DOUBLE / {n}) END"
    mean = lambda c, n, which="TRUE": "[" + ", ".join(f"avg({c}[{i}]) FILTER ({which})" for i in range(1, n + 1)) + "]"
    half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    distance = lambda c: f"sqrt(greatest(list_sum(list_transform(list_zip({c}, {c}_ref), lambda z: ({half('z[1]')} + {half('z[2]')}) / 2)), 0))"
    known = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    n = len(vocabulary())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({known}) THEN lang ELSE 'other' END AS ref,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS k FROM p),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM g, range(3) r(j) WHERE k > 1 GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT d.doc_id, ref, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {letters('#*$%&|<>')} AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    {letters(chr(92) + 'p{Lu}')} AS upper, {letters('0-9')} AS digits, {letters(".,;:!?''" + '"' + "()" + chr(92) + "[" + chr(92) + "]-")} AS marks, length(t) AS points, [{words}] AS common
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [upper, digits, marks, n_symbols, points - word_chars, word_chars - upper - digits - marks - n_symbols] AS classes,
    common AS counts, list_sum(common) > 0 AS told FROM m),
s AS (SELECT *, {share('classes', 6)} AS cs, {share('counts', n)} AS ws FROM b),
r AS (SELECT ref, {mean('cs', 6)} AS cs_ref, {mean('ws', n, 'told')} AS ws_ref FROM s WHERE NOT base_failed GROUP BY 1),
j AS (SELECT s.*, {distance('cs')} AS class_distance, CASE WHEN ws_ref[1] IS NOT NULL THEN CASE WHEN told THEN {distance('ws')} ELSE 1.0 END END AS word_distance FROM s LEFT JOIN r USING (ref)),
h AS (SELECT ref, round(word_distance, 4) AS d, count(*) AS k FROM j WHERE NOT base_failed AND word_distance IS NOT NULL GROUP BY 1, 2),
u AS (SELECT ref, d, sum(k) OVER (PARTITION BY ref ORDER BY d) AS upto, sum(k) OVER (PARTITION BY ref) AS n FROM h),
q AS (SELECT ref, min(d) FILTER (upto >= 0.25 * n) AS low, min(d) FILTER (upto >= 0.5 * n) AS middle FROM u GROUP BY 1),
v AS (SELECT j.*, least(middle + {WORD_SPREADS} * (middle - low), 1 - 1e-9) AS word_limit FROM j LEFT JOIN q USING (ref))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_words >= {MIN_WORDS} AND (class_distance > {MAX_CLASS_DISTANCE} OR word_distance > word_limit), FALSE) AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM v
"""
