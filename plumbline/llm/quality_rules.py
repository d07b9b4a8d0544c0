"""Quality rules: a table of thresholds compiled into one projection of column functions.

Each line of the table bounds one measure of a text: a count or a ratio of counts.
``measures`` turns a text column into the counts, ``verdict`` turns the table into one
Boolean expression over them; both are plain projections, so a scan is all that runs.

Windows of five words are compared by two steps.  Their hashes are made distinct; if none
is lost, no window occurs twice.  Only the other texts sort their windows, by hash and then
by the words themselves, so equal hashes of different words do no harm.

Cases: null text counts as empty: no words, all counts 0, not kept (fewer than ten words);
texts of blanks alone likewise.  Ratios of an empty whole are null and such a bound is not
broken.  Texts of any length are measured whole, in memory of some 200 bytes for each word
of a text that repeats a window.  Repeated rows each give a row, ids may be null or equal,
and an empty table gives an empty result.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the measures: blanks, symbols, words in a window.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: The commonest function words of each language, without regard to case.
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with as be by this are at from or an not have but which you his",
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als auch es an er so hat dass",
    "es": "de la que el en y los se del las un por con no su una para es al lo como más o pero sus le ha me si sin",
    "fr": "de la le et les des en un du une que pour est par qui dans avec sur pas au il ne se ce a plus je son sa",
}


@dataclass(frozen=True)
class Threshold:
    """``measure`` over ``per`` (a count, or a number) must lie within ``least``..``most``."""

    name: str
    measure: str
    per: str | int = 1
    least: float | None = None
    most: float | None = None
    base: bool = False

    def broken(self) -> Column:
        whole = F.col(self.per) if isinstance(self.per, str) else F.lit(self.per)
        bounds = []
        if self.least is not None:  # multiplied out: whole numbers compare exactly
            bounds.append(F.col(self.measure) < F.lit(self.least) * whole)
        if self.most is not None:
            bounds.append(F.col(self.measure) > F.lit(self.most) * whole)
        return F.coalesce(whole > 0, F.lit(False)) & reduce(lambda a, b: a | b, bounds)


#: What a text must meet.  The first two are the base rules.
THRESHOLDS = (
    Threshold("words", "n_words", least=10, base=True),
    Threshold("repeated_words", "n_repeat_words_100", "n_words", most=20, base=True),
    Threshold("word_length", "word_chars", "n_words", least=2, most=16),
    Threshold("symbols", "n_symbols", "n_words", most=0.5),
    Threshold("duplicate_lines", "n_dup_lines", "n_lines", most=0.3),
    Threshold("bullet_lines", "n_bullet_lines", "n_lines", most=0.9),
    Threshold("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=0.3),
    Threshold("words_with_letter", "n_letter_words", "n_words", least=0.7),
    Threshold("stop_words", "n_stop_words", "n_words", least=0.02),
    Threshold("stutter", "n_stutter_words", "n_words", most=0.3),
)


def _count(found: Column) -> Column:
    return F.size(found).cast("long")


def _sorted_windows(words: Column, last: Column, hashes: Column) -> Column:
    """Windows in the order of their hashes, then of their words, then of their places."""
    return F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        hashes[i].alias("h"), F.struct(*[words[i + k].alias(f"w{k}") for k in range(WINDOW)]).alias("w"), i.alias("i"))))


def _repeat_words(ordered: Column, last: Column) -> Column:
    """Words that lie in a window whose words occur at two or more places.  Neighbours in
    the sorted order that are equal belong to a group of two or more."""
    twice = F.filter(ordered, lambda x, k: (
        ((k > 0) & (ordered[F.greatest(k - 1, F.lit(0))]["w"] == x["w"]))
        | ((k < last) & (ordered[F.least(k + 1, last)]["w"] == x["w"]))))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda done, i: F.struct((done["n"] + WINDOW - F.greatest(done["end"] - i, F.lit(0))).alias("n"),
                                 (i + WINDOW).alias("end")))
    return F.coalesce(covered["n"], F.lit(0)).cast("long")


def measures(docs: DataFrame, text: Column, keep: Iterable[str | Column] = ()) -> DataFrame:
    """``keep`` and the counts of each text that ``THRESHOLDS`` may name."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    has_word = f"[^{BLANKS}]"
    kept = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    names = [f"`{c}`" for c in kept.columns[:-1]]
    split = kept.select(
        "*", F.array_remove(F.split("__text", f"[{BLANKS}]+", -1), "").alias("__words"),
        F.filter(F.split("__text", "\n", -1), lambda line: line.rlike(has_word)).alias("__lines"))
    hashed = split.select(
        "*", F.size("__words").alias("__n"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"))
    h = F.col("__h")
    last = F.col("__n") - WINDOW
    windows = hashed.select("*", F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]))).alias("__win"))
    # A column of its own: inside a lambda the sorting would be done for each element.
    ordered = windows.select("*", F.when(
        F.size(F.array_distinct("__win")) < F.size("__win"), _sorted_windows(F.col("__words"), last, F.col("__win"))).alias("__sorted"))
    return ordered.select(
        *names,
        F.col("__n").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        _count(F.col("__lines")).alias("n_lines"),
        (_count(F.col("__lines")) - _count(F.array_distinct("__lines"))).alias("n_dup_lines"),
        _count(F.filter("__lines", lambda x: x.rlike(rf"^[{BLANKS}]*[-*•‣◦·][{BLANKS}]"))).alias("n_bullet_lines"),
        _count(F.filter("__lines", lambda x: F.rtrim(x, F.lit(BLANKS)).endswith("...") | F.rtrim(x, F.lit(BLANKS)).endswith("…")))
        .alias("n_ellipsis_lines"),
        _count(F.filter("__words", lambda w: w.rlike(r"\p{L}"))).alias("n_letter_words"),
        _count(F.filter(F.split(F.lower("__text"), r"\P{L}+", -1), lambda w: w.isin(stop))).alias("n_stop_words"),
        _count(F.filter("__h", lambda x, i: (i > 0) & (h[F.greatest(i - 1, F.lit(0))] == x))).alias("n_stutter_words"),
        _repeat_words(F.col("__sorted"), last).alias("n_repeat_words"))


def verdict(measured: DataFrame, thresholds: Iterable[Threshold] = THRESHOLDS) -> DataFrame:
    """``measured`` with ``base_failed``, ``kept`` and the names of the ``broken`` rules."""
    table = list(thresholds)

    def any_of(rules: list[Threshold]) -> Column:
        return reduce(lambda a, b: a | b, [t.broken() for t in rules], F.lit(False))

    base = [t for t in table if t.base]
    return measured.withColumn("n_repeat_words_100", 100 * F.col("n_repeat_words")).select(
        *[f"`{c}`" for c in measured.columns],
        any_of(base).alias("base_failed"), (~any_of(table)).alias("kept"),
        F.array_compact(F.array(*[F.when(t.broken(), F.lit(t.name)) for t in table])).alias("broken"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          thresholds: Iterable[Threshold] = THRESHOLDS) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``broken`` of each document."""
    return verdict(measures(docs, F.col(f"`{text_col}`"), [F.col(f"`{id_col}`").alias("doc_id")]), thresholds)
