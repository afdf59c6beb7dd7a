"""Quality rules, line first: judge every line, drop the lines that fail, reject documents that lose too much.

A line fails as *navigation* (a row of items between bars), *symbols* (marks in every few words), *shouting* (capital
letters outnumber small ones in a line of some length), *punctuation* (a short fragment that no sentence mark ends)
or *boilerplate* (a line, of any length, with a phrase that gives a licence, reserves rights or asks for cookies or scripts in every
``NOTICE`` of its words).
Lines without a word are neither kept nor counted. A document is rejected if the lines that fail hold more than half of
its words, or if no line is left.

Cases: a null or blank text has no words and fails the base rules. Equal rows get equal results; nothing is compared
across documents, so there is no shuffle, and a very long text is a row like any other. All is done by DataFrame
functions, line by line inside a row. An empty table gives none. Other columns stay, whatever their names; those of the
names it sets are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, words

#: Phrases that mark a line as a notice rather than prose, in lower case.
BOILERPLATE = (
    "licensed under", "released under the", "all rights reserved", "(copyright|©) ?(©|[(]c[)]|[12][0-9]{3})", "terms of (service|use)", "privacy policy", "cookie policy", "use of cookies",
    "(enable|requires) javascript", "javascript is (disabled|required)", "lorem ipsum",
    "lizenziert unter", "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "sous licence", "tous droits réservés", "politique de confidentialité", "bajo licencia",
    "todos los derechos reservados", "política de privacidad", "uso de cookies",
)
#: Words of a line for each of its phrases, at most: a sentence or two of a notice.
NOTICE = 40
ENDS = r"""[.!?:;…"'”’»)\]]\s*$"""
WORD = r"[^\x20\x09-\x0D]"


def _only(text: Column, keep: str) -> Column:
    """How many characters of ``text`` are in the class ``keep``."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def is_notice(line: Column, n: Column) -> Column:
    """Boilerplate; ``n``: the line's words."""
    low, phrases = F.lower(line), "|".join(BOILERPLATE)
    return low.rlike(phrases) & (n <= NOTICE * F.regexp_count(low, F.lit(phrases)))


def is_junk(line: Column, n: Column) -> Column:
    """Navigation, symbols, shouting or a fragment; ``n``: the line's words."""
    marks = _only(line, "#*$%&|<>")
    navigation = F.length(line) - F.length(F.replace(line, F.lit(" |"), F.lit(" "))) >= F.greatest(F.lit(2), n / 6)
    shouting = (n >= 4) & (_only(line, r"\p{Lu}") > _only(line, r"\p{Ll}"))
    fragment = (n < 5) & ~line.rlike(ENDS)
    return navigation | (marks > n / 4) | shouting | fragment


def clean_lines(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """Adds to ``docs``: n_words, the base counts, ``kept_lines`` (the lines that stay), n_kept_words, n_lost_words, base_failed, kept."""
    n = F.col("n_words")
    w_, h_, s_, p_, lines_, stay_ = (free(docs, x) for x in ("own_w", "own_h", "own_s", "own_p", "own_lines", "own_stay"))
    d = docs.withColumn(w_, words(F.col("text"))).withColumn("n_words", F.size(w_).cast("long"))
    grams = F.arrays_zip(*[F.slice(w_, k, F.greatest(n.cast("int") - 4, F.lit(0))).alias(f"g{k}") for k in range(1, 6)])
    d = d.withColumn(h_, F.when(n > 5, F.transform(grams, lambda g: F.xxhash64(*[g[f"g{k}"] for k in range(1, 6)]))))
    d = d.withColumn(s_, F.when(F.size(F.array_distinct(h_)) < F.size(h_), F.sort_array(F.transform(h_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter(s_, lambda s, i: (s["h"] == F.get(s_, i - 1)["h"]) | (s["h"] == F.get(s_, i + 1)["h"]))
    d = d.withColumn(p_, F.sort_array(F.transform(again, lambda s: s["i"])))
    cover = F.aggregate(F.transform(p_, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(p_, i + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    good = lambda s: ~is_junk(s["line"], s["n"]) & ~is_notice(s["line"], s["n"])
    has_word = lambda x: x.rlike(WORD)
    d = d.withColumn(lines_, F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), has_word))
    # A line's words are counted once for all rules.
    d = d.withColumn(stay_, F.filter(F.transform(lines_, lambda x: F.struct(x.alias("line"), F.size(words(x)).alias("n"))), good))
    d = d.withColumns({
        "word_chars": F.length(F.array_join(w_, "")).cast("long"),
        "n_symbols": _only(F.coalesce(F.col("text"), F.lit("")), "#*$%&|<>").cast("long"),
        "n_dup_lines": (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long"),
        "n_repeat_words": F.coalesce(cover, F.lit(0)).cast("long"),
        "kept_lines": F.transform(stay_, lambda s: s["line"]),
        "n_kept_words": F.aggregate(stay_, F.lit(0).cast("long"), lambda a, s: a + s["n"]),
    })
    d = d.withColumn("n_lost_words", n - F.col("n_kept_words"))
    d = d.withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= max_lost * n) & (F.col("n_kept_words") > 0))
    return d.drop(w_, h_, s_, p_, lines_, stay_)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")
