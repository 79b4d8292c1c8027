r"""Quality rules by distribution divergence; DataFrame and SQL functions only.

Two histograms of a document are held against references of its language, by
Jensen-Shannon distance (base 2, 0 to 1): its character classes and its common
words.  References are learned from the whole corpus: per language, the sums of
the classes and the ``common_words`` most frequent words of at most
``common_word_chars`` characters, all letters.  A language with fewer than
``reference_words`` words takes the references of all languages together.

Short documents stray from any reference by chance, in proportion to the inverse
root of their length; each limit has a term for that, and documents of fewer than
``min_words`` words or ``min_chars`` characters are not judged by divergence.

Words are ``[^\x20\x09-\x0D]+``.  Beside the distances there are base counts:
``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (words inside
8-word windows found twice or more in the text) and ``base_failed``.  Windows are
compared by 64-bit hashes within one text.

Nothing but the aggregates of a language is shuffled: every document is judged
in the task that reads it.  The references are written to the shared folder, so that
Spark knows their size and broadcasts them only if they are small.

Defined results: a null text has no words (base_failed, not kept); null languages
count as the empty one, which is a language like others; repeated rows are all judged and all count in the
references; ties between common words go by the word; an empty table gives an empty
result; the columns ``doc_id``, ``text`` and ``lang`` are used and others ignored.
Texts are judged whole, at any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.llm._shared import stash

SPACE = r"[ \t-\r]+"
#: Character classes, taken out of a text one after another; the last class is what then remains.
CLASSES = {"lower": "[a-z]+", "space": SPACE, "upper": "[A-Z]+", "digit": "[0-9]+", "symbol": "[#*$%&|<>]+", "mark": r"[\x21-\x7e]+"}
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    min_chars: int = 100
    max_repeat_percent: int = 30
    char_distance: float = 0.26
    char_chance: float = 1.4
    word_distance: float = 0.255
    word_chance: float = 1.4
    common_words: int = 40
    common_word_chars: int = 6
    reference_words: int = 5000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _classes(docs: DataFrame) -> DataFrame:
    """Add ``n_chars_`` and ``classes``, the number of characters of each class."""
    left = docs.withColumn("left_0", F.col("text"))
    for k, pattern in enumerate(CLASSES.values()):
        left = left.withColumn(f"left_{k + 1}", F.regexp_replace(f"left_{k}", pattern, ""))
    sizes = [F.length(f"left_{k}") for k in range(len(CLASSES) + 1)]
    counts = F.array(*[a - b for a, b in zip(sizes, sizes[1:], strict=False)], sizes[-1]).cast("array<long>")
    return left.select(*docs.columns, F.length("text").cast("long").alias("n_chars_"), counts.alias("classes"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))


def references(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row a language: ``lang, ref_classes, ref_words, ref_hashes, ref_counts, ref_total``.

    Words that are none of the common ones count in the total; counts are padded with zeros.
    """
    texts, everything = _texts(docs), F.lit(None).cast("string")
    n, k = len(CLASSES) + 1, limits.common_words
    add = lambda df, *keys: df.groupBy(*keys).agg(F.array(*[F.sum(F.col("classes")[i]) for i in range(n)]).alias("classes"), F.sum("total").alias("total"))
    sized = _classes(texts).select("lang", "classes", F.size(words(F.col("text"))).cast("long").alias("total"))
    by_lang, _ = stash(add(sized, "lang"), "language-sums")
    short = texts.select("lang", F.explode(words(F.col("text"))).alias("word")).where(F.length("word") <= limits.common_word_chars)
    counted = short.groupBy("lang", "word").agg(F.count("*").alias("n")).where(F.col("word").rlike(r"^\p{L}+$"))
    # A language is null from here on in the rows for all languages together.
    totals = by_lang.unionByName(add(by_lang).select(everything.alias("lang"), "classes", "total"))
    counts = counted.unionByName(counted.groupBy("word").agg(F.sum("n").alias("n")).select(everything.alias("lang"), "word", "n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("k", rank).where(F.col("k") <= k).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("top"))
    made = totals.join(top, totals["lang"].eqNullSafe(top["lang"]), "left").select(
        totals["lang"].alias("key"), F.col("classes").alias("ref_classes"), F.coalesce(F.col("top.word"), F.array()).alias("ref_words"), F.coalesce(F.col("top.n"), F.array()).alias("ref_counts"), F.col("total").alias("ref_total")
    )
    key = F.when(F.col("total") >= limits.reference_words, F.col("lang"))
    lacking = F.array_repeat(F.lit(0).cast("long"), F.lit(k) - F.size("ref_counts"))
    made = made.withColumn("ref_hashes", F.transform("ref_words", lambda w: F.xxhash64(w))).withColumn("ref_counts", F.concat("ref_counts", lacking))
    return by_lang.select("lang", key.alias("of")).join(made, F.col("of").eqNullSafe(F.col("key"))).drop("of", "key")


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, base 2."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    pn, qn = total(p), total(q)
    terms = F.zip_with(p, q, lambda a, b: part(a / pn, b / qn) + part(b / qn, a / pn))
    return F.sqrt(F.greatest(total(terms) / 2, F.lit(0.0)))


def judge(docs: DataFrame, limits: Limits = Limits(), refs: DataFrame | None = None) -> DataFrame:
    """Counts, distances and verdict of every row of ``docs``.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance (null where not judged), kept.
    """
    if refs is None:
        refs, _ = stash(references(docs, limits), "language-references")
    counts = _counts(docs, limits, refs)
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", _kept(limits).alias("kept")
    )


def keep(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    refs, _ = stash(references(docs, limits), "language-references")
    inside = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select("doc_id", "text", "lang", inside.alias("whole"))
    judged = _counts(rows, limits, refs, "whole").select("whole", _kept(limits).alias("kept"))
    # Not a filter on ``kept``: that would be pushed below the projections and would repeat their expressions many times over.
    chosen = judged.select(F.explode_outer(F.when(F.col("kept"), F.array("whole"))).alias("chosen"))
    return chosen.where(F.col("chosen").isNotNull()).select("chosen.*")


def _kept(limits: Limits) -> Column:
    far = F.coalesce(F.col("char_distance") > limits.char_distance + limits.char_chance / F.sqrt("n_chars_"), F.lit(False)) | F.coalesce(
        F.col("word_distance") > limits.word_distance + limits.word_chance / F.sqrt("n_words"), F.lit(False)
    )
    return ~F.col("base_failed") & ~far


def _counts(docs: DataFrame, limits: Limits, refs: DataFrame, *carried: str) -> DataFrame:
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), *carried)
    ids = ["doc_id", "lang", *carried]
    class_of = {name: k for k, name in enumerate(CLASSES)}
    cut = _classes(texts).select(
        *ids,
        "n_chars_",
        "classes",
        words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(" \t\n\x0b\x0c\r")) != "").alias("lines"),
    )
    known = cut.join(refs, "lang", "left")
    # Hashes of windows from those of their halves; nothing is made for the last words, where no window begins.
    halves = lambda x, n: f"zip_with(slice({x}, 1, greatest(size({x}) - {n}, 0)), slice({x}, {n + 1}, greatest(size({x}) - {n}, 0)), (a, b) -> xxhash64(a, b))"
    base = [
        *ids,
        "n_chars_",
        "classes",
        "ref_classes",
        "ref_hashes",
        F.concat("ref_counts", F.array(F.col("ref_total") - F.aggregate("ref_counts", F.lit(0).cast("long"), lambda acc, v: acc + v))).alias("ref_counts"),
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    ]
    windows = known.select(*base, F.transform("words", lambda w: F.xxhash64(w)).alias("w1"))
    # Common words are counted by their hashes, one pass over the hashes for each.
    hits = F.array(*[F.coalesce(F.size("w1") - F.size(F.array_remove("w1", F.get("ref_hashes", F.lit(k)))), F.lit(0)) for k in range(limits.common_words)])
    pairs = windows.select(*[c for c in windows.columns if c not in ("w1", "ref_hashes")], hits.alias("hits"), F.expr(halves("w1", 1)).alias("w2"))
    fours = pairs.select(*[c for c in pairs.columns if c != "w2"], F.expr(halves("w2", 2)).alias("w4"))
    # A window cannot come twice where none of half its size does.
    eights = fours.select(*[c for c in fours.columns if c != "w4"], F.expr(f"if(size(array_distinct(w4)) < size(w4), {halves('w4', 4)}, array())").alias("w8"))
    # Only texts in which a window comes twice have their windows sorted: by 44 bits of the hash and
    # the place, which is one number, or, past 2**20 windows, by hash and place.
    ordered = eights.select(
        "*",
        F.expr(f"if(size(array_distinct(w8)) < size(w8) and size(w8) < {1 << 20}, sort_array(transform(w8, (h, i) -> (h & {-1 << 20}L) | i)), array())").alias("packed"),
        F.expr(f"if(size(w8) >= {1 << 20}, sort_array(transform(w8, (h, i) -> struct(h, i))), array())").alias("sorted"),
    )
    place = lambda x: f"cast({x} & {(1 << 20) - 1}L as int)"
    same = lambda j: f"coalesce(get(w8, {place('x')}) = get(w8, {place(f'get(packed, {j})')}), false)"
    equal = lambda j: f"coalesce(x.h = get(sorted, {j}).h, false)"
    again = ordered.select(
        *[c for c in ordered.columns if c not in ("packed", "sorted", "hits", "w8")],
        F.expr(
            f"sort_array(concat(array_compact(transform(packed, (x, j) -> if({same('j - 1')} or {same('j + 1')}, {place('x')}, null))), "
            f"array_compact(transform(sorted, (x, j) -> if({equal('j - 1')} or {equal('j + 1')}, x.i, null)))))"
        ).alias("at"),
        F.concat("hits", F.array(F.col("n_words").cast("int") - F.aggregate("hits", F.lit(0), lambda acc, v: acc + v))).alias("hits"),
    )
    judged = (F.col("n_words") >= limits.min_words) & (F.col("n_chars_") >= limits.min_chars)
    total = again.select(
        *ids,
        "n_words",
        "n_chars_",
        (F.col("n_chars_") - F.col("classes")[class_of["space"]]).alias("word_chars"),
        F.col("classes")[class_of["symbol"]].alias("n_symbols"),
        "n_dup_lines",
        F.expr(f"aggregate(at, struct(0L as n, 0 as stop), (acc, i) -> struct(acc.n + (i + {WINDOW} - greatest(acc.stop, i)) as n, i + {WINDOW} as stop), acc -> acc.n)").alias("n_repeat_words"),
        F.when(judged, _distance(F.col("classes").cast("array<double>"), F.col("ref_classes").cast("array<double>"))).alias("char_distance"),
        F.when(judged, _distance(F.col("hits").cast("array<double>"), F.col("ref_counts").cast("array<double>"))).alias("word_distance"),
    )
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    return total.withColumn("base_failed", failed)
