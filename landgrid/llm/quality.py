"""Quality rules: counts of a text, and how far its histograms are from its language's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landgrid.llm.keys import document_key, keep_keys
from landgrid.session import cut_lineage, table

BLANKS = r"' \t\n\u000b\u000c\r'"
SYMBOLS = "#*$%&|<>"
CLASSES = ("upper", "letter", "digit", "symbol", "sign", "blank")
COMMON = 12  # common words of a language
LEAST_OWN = 5000  # words that a language needs for a reference
BROADCAST_ROWS = 10_000  # references are sent to every task only up to so many; beyond, the join shuffles
LEAST_CHARS, LEAST_WORDS = 200, 100  # shorter texts are not compared
MOST_CLASS, MOST_WORD = 0.25, 0.3  # Jensen-Shannon distances beyond which a text is rejected


def with_words(docs: DataFrame) -> DataFrame:
    """Add ``body`` (the text, null as empty) and ``words``."""
    body = docs.withColumn("body", F.coalesce("text", F.lit("")))
    return body.withColumn("words", split_words("body"))


def split_words(text: str) -> Column:
    trimmed = F.expr(f"trim(BOTH {BLANKS} FROM {text})")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def with_classes(df: DataFrame) -> DataFrame:
    """Add ``size``, ``word_chars`` and ``classes``, the characters of ``body`` by class in the order of CLASSES.

    Letters are taken out first; what is left is short, and the other classes are counted there.
    """
    df = df.withColumn("size", F.length("body").cast("long")).withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    df = df.withColumn("rest", F.regexp_replace("body", r"\p{L}+", "")).withColumn("upper", F.length(F.regexp_replace("body", r"\P{Lu}+", "")))
    without = lambda chars: F.length("rest") - F.length(F.translate("rest", chars, ""))
    df = df.withColumns({"symbol": without(SYMBOLS), "digit": without("0123456789")})
    letters = F.length("body") - F.length("rest")
    blank = F.col("size") - F.col("word_chars")
    sign = F.length("rest") - blank - F.col("symbol") - F.col("digit")
    classes = F.array(*[c.cast("long") for c in (F.col("upper"), letters - F.col("upper"), F.col("digit"), F.col("symbol"), sign, blank)])
    return df.withColumn("classes", classes).drop("rest", "upper", "symbol", "digit")


def common_words(docs: DataFrame) -> DataFrame:
    """``(lang, common array<string>, shares array<double>)`` over all of ``docs(lang, text)``.

    For each language with at least LEAST_OWN words in all its documents: the most frequent words (lower case; ties by the
    word) and their shares, with the share of all other words last.
    """
    words = docs.where("lang IS NOT NULL").select("lang", F.lower("text").alias("low")).where("low IS NOT NULL")
    counts = cut_lineage(words.select("lang", F.explode(split_words("low")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= LEAST_OWN)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= COMMON).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    shares = F.expr("concat(transform(top, x -> x.n / total), array(1 - aggregate(top, 0L, (s, x) -> s + x.n) / total))")
    return cut_lineage(best.join(totals, "lang").select("lang", F.col("top.word").alias("common"), shares.alias("shares")))


def small(refs: DataFrame) -> DataFrame:
    """``refs``, marked for broadcast if it has few rows."""
    return F.broadcast(refs) if refs.count() <= BROADCAST_ROWS else refs


def class_shares(counted: DataFrame) -> DataFrame:
    """``(ref, chars array<double>)``: shares of the character classes over all documents of each reference language, and of all (null)."""
    sums = counted.groupBy("ref").agg(*[F.sum(F.col("classes")[i]).alias(c) for i, c in enumerate(CLASSES)])
    every = sums.groupBy(F.lit(None).cast("string").alias("ref")).agg(*[F.sum(c).alias(c) for c in CLASSES])
    total = sum(F.col(c) for c in CLASSES)
    return sums.where("ref IS NOT NULL").unionByName(every).select("ref", F.array(*[F.col(c) / F.greatest(total, F.lit(1)) for c in CLASSES]).alias("chars"))


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance, from 0 to 1, of two arrays of shares."""
    half = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> IF(x > 0, x * log2(2 * x / (x + y)), 0D)), 0D, (s, x) -> s + x)"
    return F.expr(f"sqrt(greatest(({half(p, q)} + {half(q, p)}) / 2, 0D))")


def repeat_counts(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words that stand in a window of three words found twice or more.

    Windows are hashed; only if two hashes are equal are they sorted with their places.
    """
    df = df.withColumn("hashes", F.expr("IF(size(words) < 3, cast(array() as array<bigint>), transform(sequence(0, greatest(size(words) - 3, 0)), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))))"))
    df = df.withColumn("twice", F.expr("size(array_distinct(hashes)) < size(hashes)"))
    df = df.withColumn("placed", F.expr("IF(twice, sort_array(transform(hashes, (x, i) -> struct(x AS h, i AS i))), null)"))
    df = df.withColumn("again", F.expr("sort_array(transform(filter(placed, (p, j) -> p.h = get(placed, j - 1).h OR p.h = get(placed, j + 1).h), p -> p.i))"))
    covered = F.expr("aggregate(transform(again, (p, j) -> IF(j = 0, 3, least(3, p - get(again, j - 1)))), 0L, (s, x) -> s + x)")
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("hashes", "twice", "placed", "again")


def counted(docs: DataFrame) -> DataFrame:
    """Every row of ``docs(text, lang, ...)``, its columns as struct ``row``, with its counts and its histograms.

    ``ref`` is the language it is compared with, null if its own is null or has no reference.
    """
    own = common_words(docs).withColumnRenamed("lang", "ref")
    df = docs.select(F.struct(*docs.columns).alias("row"), "text", "lang")
    df = df.join(small(own), F.col("lang") == F.col("ref"), "left").select("row", "text", "ref", "common", "shares")
    df = with_words(df).withColumn("n_words", F.size("words").cast("long"))
    df = with_classes(repeat_counts(df))
    df = df.withColumn("longest", F.array_max(F.transform("common", F.length)))
    df = df.withColumn("hits", F.expr("filter(transform(filter(words, w -> length(w) <= longest), w -> lower(w)), w -> array_contains(common, w))"))
    df = df.withColumn("own_shares", F.expr("concat(transform(common, c -> (size(hits) - size(array_remove(hits, c))) / greatest(n_words, 1L)), array(1 - size(hits) / greatest(n_words, 1L)))"))
    lines = F.expr(f"filter(split(body, '\\n'), l -> trim(BOTH {BLANKS} FROM l) <> '')")
    df = df.withColumn("lines", lines)
    return df.select(
        "row", "ref", "size", "classes", "word_chars", "n_words",
        F.col("classes")[3].cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.when(F.col("n_words") >= LEAST_WORDS, distance("own_shares", "shares")).alias("word_distance"),
    )


def verdict(counts: DataFrame) -> DataFrame:
    """Add ``base_failed``, ``class_distance`` and ``kept`` to ``counted`` rows; the class references are sums over all of them."""
    chars = class_shares(counts)
    chars = cut_lineage(chars)
    own = chars.where("ref IS NOT NULL")
    every = chars.where("ref IS NULL").select(F.col("chars").alias("all_chars"))
    df = counts.join(small(own), "ref", "left").join(F.broadcast(every), F.lit(True), "left").withColumn("chars", F.coalesce("chars", "all_chars"))
    df = df.withColumn("own_chars", F.expr("transform(classes, c -> c / greatest(size, 1L))"))
    df = df.withColumn("class_distance", F.when(F.col("size") >= LEAST_CHARS, distance("own_chars", "chars")))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASS) & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD)
    return df.withColumn("kept", ~F.col("base_failed") & near).drop("chars", "all_chars", "own_chars", "classes", "size", "ref")


def judge(docs: DataFrame) -> DataFrame:
    """Every row of ``docs(text, lang, ...)``, its columns as struct ``row``, with the counts and the verdict ``kept``.

    Columns: word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words, word_distance, base_failed, class_distance, kept.
    A text fails the base rules with under 50 words, or if over half of its words are repeated. Otherwise its character
    classes, and its share of its language's common words, must not be further from those of the language than the
    limits; texts below the least lengths are not compared (distance null). Where the language is null, or has too few words
    for a reference of its own, words are not compared, and character classes with those of all such documents and languages together.
    A null text has no words; repeated rows are judged alike; an empty table gives no rows. Everything runs in the JVM.
    Counts are written before the verdict, so that filters on it don't work them out anew.
    """
    return verdict(cut_lineage(counted(docs)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, ...)`` that the rules keep, with their columns as they are.

    Rows are counted once; their verdicts, small without the texts, are then joined back to them.
    """
    narrow = docs.select("doc_id", "text", "lang")
    counts = counted(narrow).select("*", *[F.col(f"row.{c}").alias(c) for c in narrow.columns])
    counts = cut_lineage(counts.select(*[c for c in counts.columns if c not in ("row", *narrow.columns)], *document_key()))
    return keep_keys(docs, verdict(counts).where("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge`` of all rows of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    # Without its text a row is small: it is counted once, and both the references and the verdicts are read from that.
    counts = counted(docs).withColumn("row", F.struct("row.doc_id"))
    return verdict(cut_lineage(counts)).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS body FROM documents),
split AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, regexp_replace(body, '\p{L}+', '', 'g') AS rest FROM docs),
counts AS (
  SELECT rid, doc_id, lang, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(body) AS BIGINT) AS size,
         length(body) - length(regexp_replace(body, '\p{Lu}+', '', 'g')) AS upper, length(body) - length(rest) AS letters,
         CAST(length(rest) - length(translate(rest, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, length(rest) - length(translate(rest, '0123456789', '')) AS digits, length(rest) AS others,
         list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM split
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n
  FROM (SELECT rid, words, unnest(range(1, n_words - 1)) AS i FROM counts WHERE n_words >= 3)
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY rid
), known AS (
  SELECT lang FROM counts WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= 5000
), base AS (
  SELECT c.*, k.lang AS ref, coalesce(v.n, 0) AS n_repeat_words, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         [upper, letters - upper, digits, n_symbols, others - (size - word_chars) - n_symbols - digits, size - word_chars] AS classes
  FROM counts c LEFT JOIN covered v USING (rid) LEFT JOIN known k ON c.lang = k.lang
), sums AS (
  SELECT ref, unnest(range(1, 7)) AS i, unnest(classes) AS n FROM base
), chars AS (
  SELECT ref, list(n / greatest(total, 1) ORDER BY i) AS chars FROM (SELECT ref, i, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY ref) AS total FROM sums WHERE ref IS NOT NULL GROUP BY ref, i) GROUP BY ref
), all_chars AS (
  SELECT list(n / greatest(total, 1) ORDER BY i) AS chars FROM (SELECT i, sum(n) AS n, sum(sum(n)) OVER () AS total FROM sums GROUP BY i)
), spoken AS (
  SELECT lang, lower(unnest(words)) AS word FROM counts
), tally AS (
  SELECT lang, word, count(*) AS n FROM spoken JOIN known USING (lang) GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lang) AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM tally
), common AS (
  SELECT lang, list(word ORDER BY rank) AS common, list_append(list(n / total ORDER BY rank), 1 - sum(n) / any_value(total)) AS shares FROM ranked WHERE rank <= 12 GROUP BY lang
), paired AS (
  SELECT b.*, m.common, m.shares, coalesce(h.chars, x.chars) AS chars
  FROM base b LEFT JOIN common m ON b.ref = m.lang LEFT JOIN chars h ON b.ref = h.ref, all_chars x
), own AS (
  SELECT *, list_transform(classes, lambda c: c / greatest(size, 1)) AS p1, list_transform(words, lambda w: lower(w)) AS low FROM paired
), shared AS (
  SELECT *, list_append(list_transform(common, lambda c: len(list_filter(low, lambda w: w = c)) / greatest(n_words, 1)), 1 - len(list_filter(low, lambda w: list_contains(common, w))) / greatest(n_words, 1)) AS p2 FROM own
), far AS (
  SELECT *,
    CASE WHEN size >= 200 THEN sqrt(greatest((list_sum(list_transform(list_zip(p1, chars), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END))
      + list_sum(list_transform(list_zip(p1, chars), lambda z: CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END))) / 2, 0)) END AS class_distance,
    CASE WHEN n_words >= 100 AND shares IS NOT NULL THEN sqrt(greatest((list_sum(list_transform(list_zip(p2, shares), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END))
      + list_sum(list_transform(list_zip(p2, shares), lambda z: CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END))) / 2, 0)) END AS word_distance,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM shared
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(class_distance, 0) <= 0.25 AND coalesce(word_distance, 0) <= 0.3 AS kept
FROM far
"""
