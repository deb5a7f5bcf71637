"""Quality rules: how far a document's characters and common words lie from those of its language.

A document has two histograms: of its characters over classes, and of its words over the commonest words of its language, which are counted over all its
documents (one cell for all other words). A language's reference is the sum of these over all documents of that language. A document is
rejected if the Jensen-Shannon divergence (base 2, 0 to 1; its square root is the distance) of its characters is too large, or if its words lie nearer to a text
without common words than to its language: so it is judged by what its language has, whatever share common words have there.
Documents with few words aren't judged by either, as their histograms say little. Native DataFrame expressions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dropped, numbered, written

#: Ids that may be broadcast; more are joined by shuffling.
SMALL = 200_000

#: Commonest words of a language that have cells.
COMMON = 20
#: Judged from so many words on; divergence allowed for characters.
MIN_WORDS, CLASS_LIMIT = 80, 0.10
#: Common words that a language must let one expect in a document before their lack is judged: were words drawn one by one, a document would have none once in 22,000 times.
TELLING = 10
#: Divergence in bits, times words, of words drawn from the reference: COMMON / (8 ln 2), as half a chi-squared of COMMON cells spread over the two halves.
NOISE = COMMON / 5.545177
#: Roundings of a divergence.
ROUNDING = 1e-9
#: Languages whose words and references may be broadcast (a fixed number of cells each); more are joined by shuffling.
LANGUAGES = 10_000
BREAKS = "[\\x20\\x09-\\x0D]"
#: Around an expression that must match whole words.
NOT_AFTER, NOT_BEFORE = (f"({way}[^{BREAKS[1:]})" for way in ("?<!", "?!"))
#: Classes in the order in which they are taken out of the text; what is taken first are spaces.
CLASSES = (("lower", "[a-z]+"), ("other", "[^\\x00-\\x7F]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"))


def _small(df: DataFrame) -> DataFrame:
    """df, a row for each language, marked to be broadcast while these are few."""
    return F.broadcast(df) if df.count() <= LANGUAGES else df


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BREAKS + "+"), "")


def common_words(texts: DataFrame, size: int = COMMON) -> DataFrame:
    """ref_lang, common: the `size` commonest words (in lower case, of letters alone) of each language of texts (lang, text); of equally common ones the first by alphabet."""
    said = texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"{NOT_AFTER}\\p{{L}}++{NOT_BEFORE}"), F.lit(0))).alias("word"))
    counts = said.groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    return top.groupBy(F.col("lang").alias("ref_lang")).agg(F.array_sort(F.collect_list("word")).alias("common"))


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words: words in three-word windows found twice or more, from the column w."""
    df = df.withColumn("h", F.expr("transform(slice(w, 1, cast(greatest(n_words - 2, 0) as int)), (x, i) -> xxhash64(x, w[i + 1], w[i + 2]))"))
    # where all hashes differ, as in most texts, all windows do; else each hash gets its place in its low bits: sorted, equal windows stand side by side
    df = df.withColumn("mask", F.expr("shiftleft(1L, length(bin(n_words))) - 1L"))
    df = df.withColumn("s", F.expr("if(size(array_distinct(h)) = size(h), slice(h, 1, 0), sort_array(transform(h, (x, i) -> (x & ~mask) | cast(i as bigint))))"))
    beside = F.expr("array_compact(zip_with(s, slice(s, 2, size(s)), (x, y) -> if((x ^ y) between 0 and mask, array(cast(x & mask as int), cast(y & mask as int)), null)))")
    # neighbours of one hash count if their words are the same: with long texts few bits of the hash are left
    same = " and ".join(f"w[x[0] + {j}] = w[x[1] + {j}]" for j in range(3))
    df = df.withColumn("beside", beside).withColumn("places", F.expr(f"sort_array(array_distinct(flatten(filter(beside, x -> {same}))))"))
    covered = F.expr("aggregate(places, named_struct('last', -3L, 'n', 0L), (a, x) -> named_struct('last', cast(x as bigint), 'n', a.n + least(3L, x - a.last)), a -> a.n)")
    return df.withColumn("n_repeat_words", covered).drop("h", "mask", "s", "beside", "places")


def measures(rows: DataFrame, common: DataFrame) -> DataFrame:
    """Per document of rows (id, lang, text) its base measures and hist, an array of (key, count): classes of characters, common words."""
    # common words are letters alone, so they stand for themselves in an expression
    common = common.withColumn("any_common", F.concat(F.lit(f"{NOT_AFTER}(?:"), F.array_join("common", "|"), F.lit(f"){NOT_BEFORE}")))
    df = rows.withColumn("text", F.coalesce("text", F.lit(""))).join(_small(common), F.col("lang").eqNullSafe(F.col("ref_lang")), "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))
    df = df.withColumn("found", F.coalesce(F.regexp_extract_all(F.lower("text"), F.col("any_common"), F.lit(0)), F.array().cast("array<string>")))
    df = df.withColumn("w", words(F.col("text"))).withColumn("n_words", F.size("w").cast("long"))
    lines = F.expr(f"filter(split(text, '\\n'), x -> x rlike '{BREAKS.replace('[', '[^')}')".replace("\\", "\\\\").replace("\\\\n", "\\n"))
    df = df.withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    df = _repeat_words(df)
    df = df.withColumn("chars", F.char_length("text").cast("long")).withColumn("r", F.array_join("w", "")).withColumn("word_chars", F.char_length("r").cast("long")).withColumn("n", F.col("word_chars"))
    for name, pattern in CLASSES:
        df = df.withColumn("r", F.regexp_replace("r", pattern, "")).withColumn("left", F.char_length("r").cast("long"))
        df = df.withColumn(f"c_{name}", F.col("n") - F.col("left")).withColumn("n", F.col("left"))
    cell = lambda key, count: F.struct(F.lit(key).alias("key") if isinstance(key, str) else key.alias("key"), count.cast("long").alias("count"))
    counted = F.transform("common", lambda k: cell(F.concat(F.lit("w:"), k), F.size("found") - F.size(F.array_remove("found", k))))
    classes = [cell(f"c:{name}", F.col(f"c_{name}")) for name, _ in CLASSES] + [cell("c:space", F.col("chars") - F.col("word_chars")), cell("c:mark", F.col("n")), cell("w:", F.col("n_words") - F.size("found"))]
    hist = F.filter(F.concat(F.array(*classes), counted), lambda x: x["count"] > 0)
    return df.select("id", "lang", "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "chars", hist.alias("hist"))


def references(measured: DataFrame) -> DataFrame:
    """Per language a map of key to share, of all characters or all words of its documents. A language has a fixed number of keys."""
    cells = measured.select("lang", F.explode("hist").alias("cell")).groupBy("lang", F.col("cell.key").alias("key")).agg(F.sum("cell.count").alias("count"))
    total = lambda kind: F.sum(F.when(F.col("key").startswith(kind), F.col("count")))
    per = cells.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("key", "count"))).alias("sums"), total("c:").alias("of_c"), total("w:").alias("of_w"))
    return per.select(F.col("lang").alias("ref_lang"), F.transform_values("sums", lambda k, v: v / F.when(k.startswith("c:"), F.col("of_c")).otherwise(F.col("of_w"))).alias("shares"))


def divergence(hist: str, shares: str, kind: str, total: Column) -> Column:
    """Jensen-Shannon divergence in bits of the cells of `kind`; 0 for an empty histogram."""
    half = lambda a, b: a * F.log2(2 * a / (a + b))
    own = F.filter(hist, lambda x: x["key"].startswith(kind))
    part = lambda x: (half(x["count"] / total, F.try_element_at(shares, x["key"])) + half(F.try_element_at(shares, x["key"]), x["count"] / total) - F.try_element_at(shares, x["key"])) / 2
    # a reference cell that the document lacks adds half its share; all shares sum to 1
    return F.when(total > 0, 0.5 + F.aggregate(own, F.lit(0.0), lambda a, x: a + part(x))).otherwise(0.0)


def bare_divergence(common: Column) -> Column:
    """Divergence, as above, of words with the share `common` of common words from words without any."""
    rest = 1 - common
    return F.when(rest <= 0, 1.0).otherwise((F.log2(2 / (1 + rest)) + rest * F.log2(2 * rest / (1 + rest)) + common) / 2)


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, min_words: int, class_limit: float) -> tuple[DataFrame, DataFrame]:
    """Judged documents, and the written table of measures that they are read from."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    common = written(common_words(rows.select("lang", "text")), "common-words")
    measured = written(measures(rows, common), "measures")
    refs = written(references(measured), "references")
    df = measured.join(_small(refs), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    df = df.withColumn("class_divergence", divergence("hist", "shares", "c:", F.col("chars"))).withColumn("word_divergence", divergence("hist", "shares", "w:", F.col("n_words")))
    other = F.coalesce(F.get(F.filter("hist", lambda x: x["key"] == "w:"), F.lit(0))["count"], F.lit(0))
    expected = F.col("n_words") * (1 - F.coalesce(F.try_element_at("shares", F.lit("w:")), F.lit(0.0)))
    # words drawn from the language itself have about this divergence: one part for each cell
    drawn = NOISE / F.col("n_words")
    nearer = (expected < TELLING) | (F.col("word_divergence") <= bare_divergence(1 - other / F.col("n_words")) + drawn + ROUNDING)
    fits = (F.col("n_words") < min_words) | ((F.col("class_divergence") <= class_limit) & nearer)
    return df.withColumn("kept", ~F.col("base_failed") & fits), measured


def kept(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS, class_limit: float = CLASS_LIMIT) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever the names of these. Texts are read again, not written: what is written are measures, and ids of what goes."""
    rows = numbered(docs, id_col, text_col)
    judged, measured = _judged(rows.select("key", "text", F.col("row")[lang_col].alias("lang")), "key", "text", "lang", min_words, class_limit)
    gone = written(judged.where(~F.coalesce("kept", F.lit(False))).select(F.col("id").alias("key")), "rejected")
    dropped(measured)
    return rows.join(F.broadcast(gone) if gone.count() <= SMALL else gone, "key", "left_anti").select("row.*")


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS, class_limit: float = CLASS_LIMIT) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_divergence, word_divergence, kept; a row per row.

    Null and empty texts have no words, so they fail the base rule. Documents without a language share one reference.
    Repeated ids and rows are judged one by one, very long texts whole. Other columns are left aside.
    """
    df, _ = _judged(docs, id_col, text_col, lang_col, min_words, class_limit)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return df.select(F.col("id").alias(id_col), *names, F.round("class_divergence", 6).alias("class_divergence"), F.round("word_divergence", 6).alias("word_divergence"), "kept")
