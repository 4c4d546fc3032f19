"""Quality rules: a threshold table compiled into one projection of built-in functions.

A word is a run of characters other than space and U+0009 to U+000D. Null texts count as empty: no words,
``base_failed`` true, ``kept`` false. Repeated rows are judged one by one; columns of the input other than the two
named ones are not looked at, so clashing names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import let

#: Frequent function words of the four corpus languages. Fixed values.
STOP_WORDS = {
    "en": "the of and a to in is it that for was on with as be by this are at from or an",
    "de": "der die und in den von zu das mit sich des für auf ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas avec",
    "es": "de la que el en y los se del las un por con no una su para es al lo",
}


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: ``metric`` must lie within [low, high]; None leaves a side open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Clean rows of the labelled tables lie well within these bounds, junk well outside at least one.
RULES = (
    Rule("mean_word_chars", 2.5, 10.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("exclamation_ratio", None, 0.25),
    Rule("upper_ratio", None, 0.4),
    Rule("stop_word_ratio", 0.05, None),
    Rule("distinct_word_ratio", 0.2, None),
    Rule("dup_line_ratio", None, 0.5),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \t-\r]+"), "")


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words which the text holds twice or more, the first one included.

    Texts whose windows are all distinct, found by hashing, end there; others sort their windows.
    """
    n = F.size(words)
    window = F.transform(F.slice(words, 1, F.greatest(n - (width - 1), F.lit(0))), lambda w, i: F.concat(w, *[x for k in range(1, width) for x in (F.lit(" "), F.get(words, i + k))]))

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(rows, j)["w"] == e["w"], F.lit(False))
            return F.filter(rows, lambda e, j: same(e, j + 1) | F.when(j > 0, same(e, F.greatest(j - 1, F.lit(0)))).otherwise(False))

        starts = F.sort_array(F.transform(let(ordered, twice), lambda e: e["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("total"), F.lit(-width).alias("last")),
            lambda acc, at: F.struct((acc["total"] + F.least(F.lit(width), at - acc["last"])).alias("total"), at.alias("last")),
            lambda acc: acc["total"],
        )

    return F.when(n < width, 0).otherwise(let(window, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))).cast("long")


def metrics(text: Column) -> Column:
    """A struct of counts and ratios of one text."""
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})

    def of(t: Column) -> Column:
        kept_lines = F.filter(F.split(t, "\n"), lambda line: F.rlike(line, F.lit(r"[^ \t-\r]")))
        lower = F.array_remove(F.split(F.lower(t), r"[ \t-\r.,;:!?\"()#*$%&|<>]+"), "")
        marks = F.regexp_replace(t, r"[^#*$%&|<>!\p{Lu}]+", "")
        return let(
            F.struct(words_of(t).alias("words"), kept_lines.alias("lines"), F.array_distinct(kept_lines).alias("own_lines"), lower.alias("lower"), marks.alias("marks")),
            lambda s: F.struct(
                F.size(s["words"]).cast("long").alias("n_words"),
                F.length(F.regexp_replace(t, r"[ \t-\r]+", "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(s["marks"], r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(s["lines"]) - F.size(s["own_lines"])).cast("long").alias("n_dup_lines"),
                F.size(s["lines"]).cast("long").alias("n_lines"),
                repeated_window_words(s["words"]).alias("n_repeat_words"),
                F.length(F.regexp_replace(s["marks"], "[^!]+", "")).cast("long").alias("n_exclamations"),
                F.length(F.regexp_replace(s["marks"], "[#*$%&|<>!]+", "")).cast("long").alias("n_upper"),
                F.size(F.array_distinct(s["lower"])).cast("long").alias("n_distinct"),
                F.size(F.filter(s["lower"], lambda w: w.isin(stop))).cast("long").alias("n_stop"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), of)


def ratios(m: Column) -> dict[str, Column]:
    """What the threshold table can name, from the struct of ``metrics``."""
    n = F.greatest(m["n_words"], F.lit(1)).cast("double")
    return {
        "mean_word_chars": m["word_chars"] / n,
        "symbol_ratio": m["n_symbols"] / n,
        "exclamation_ratio": m["n_exclamations"] / n,
        "upper_ratio": m["n_upper"] / F.greatest(m["word_chars"], F.lit(1)).cast("double"),
        "stop_word_ratio": m["n_stop"] / n,
        # long texts repeat their words: beyond 10,000 words the measure grows with the root only
        "distinct_word_ratio": m["n_distinct"] / F.least(n, 100 * F.sqrt(n)),
        "dup_line_ratio": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)).cast("double"),
    }


def judge(docs: DataFrame, rules=RULES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, counts, ratios, ``base_failed``, ``failed_rules`` and ``kept``."""
    found = docs.select(F.col(id_col).alias("doc_id"), metrics(F.col(text_col)).alias("m"))
    ratio = ratios(F.col("m"))
    plain = found.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", *[v.alias(k) for k, v in ratio.items()])
    broken = [F.when((F.col(r.metric) < r.low if r.low is not None else F.lit(False)) | (F.col(r.metric) > r.high if r.high is not None else F.lit(False)), r.metric) for r in rules]
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return plain.withColumns({"base_failed": base, "failed_rules": F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only.

    The verdict is one expression over the text, so columns of any name pass through.
    """

    def good(m: Column) -> Column:
        value = ratios(m)
        out = (m["n_words"] >= 50) & (100 * m["n_repeat_words"] <= 50 * m["n_words"])
        for r in rules:
            out &= (value[r.metric] >= r.low if r.low is not None else F.lit(True)) & (value[r.metric] <= r.high if r.high is not None else F.lit(True))
        return out

    return docs.where(let(metrics(F.col(text_col)), good))
