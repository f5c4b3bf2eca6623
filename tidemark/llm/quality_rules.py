"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8

# Frequent function words of the corpus' languages.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "was", "with", "on", "by", "are", "this", "be", "or", "from",
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "qui", "dans", "pour", "sur", "par", "avec", "ce", "est", "au",
    "der", "die", "das", "und", "zu", "den", "ein", "eine", "mit", "von", "ist", "dem", "nicht", "auf", "als", "für", "sich", "im", "des", "es",
    "el", "los", "las", "y", "con", "para", "su", "del", "al", "se", "lo", "como", "más", "por", "una", "no", "sus", "o", "pero", "sin",
)


@dataclass(frozen=True)
class Rule:
    """``numerator`` over ``denominator`` (None: 1) must lie within [least, most]; a zero denominator fails no bound."""

    name: str
    numerator: str
    denominator: str | None = None
    least: float | None = None
    most: float | None = None

    def fails(self) -> Column:
        """Decided by products, not quotients, so that a threshold met exactly is met."""
        below = F.col(self.denominator) if self.denominator else F.lit(1)
        tests = []
        if self.least is not None:
            tests.append(F.col(self.numerator) < F.lit(self.least) * below)
        if self.most is not None:
            tests.append(F.col(self.numerator) > F.lit(self.most) * below)
        failed = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        return failed


#: The contract's base rules and the method's own.
BASE_RULES = (Rule("words", "n_words", least=20), Rule("repetition", "n_repeat_words_pct", "n_words", most=30))
RULES = (
    Rule("word_length", "word_chars", "n_words", least=2, most=14),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("stop_words", "n_stop_words", "n_words", least=0.04),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("text_length", "n_chars", least=50),
)


def repeated_words(words: str, hashes: str) -> Column:
    """Words in windows of ``WINDOW`` words that occur at least twice, the first occurrence included.

    ``hashes`` holds one 64-bit hash per window.  Without equal hashes the answer is 0; else (hash, position) pairs are sorted, those
    with an equal neighbour are kept, and their spans are added up without counting a word twice.
    """
    h = F.col(hashes)
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def covered(s: Column) -> Column:
        twin = lambda j, k: F.coalesce(F.get(s, k)["x"] == F.get(s, j)["x"], F.lit(False))
        places = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: twin(j, j + 1) | twin(j, j - 1))
        starts = F.sort_array(F.transform(places, lambda j: F.get(s, j)["i"].cast("int")))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + F.lit(WINDOW) - F.greatest(a["end"] - p, F.lit(0))).alias("n"), (p + F.lit(WINDOW)).alias("end"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    # Bound through a one-element array: the sorted pairs are computed once.
    repeats = F.get(F.transform(F.array(pairs), covered), F.lit(0))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats)


def text_measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures that rules may name, all from built-in functions."""
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    words = text.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    hashed = words.select(
        "doc_id", "t", "words", F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    windows = F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(WINDOW)]))
    windowed = hashed.withColumn("windows", F.when(F.size("h") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    return windowed.select(
        "doc_id", "n_words", F.length("t").cast("long").alias("n_chars"),
        (F.length("t") - F.regexp_count("t", F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        repeated_words("words", "windows").cast("long").alias("n_repeat_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """docs (doc_id, text) -> the measures, base_failed, failed (names of the rules that fail), kept.

    ``n_repeat_words_pct`` is 100 times n_repeat_words, so that the base rule compares whole numbers.  Null and empty texts have no words
    and fail the base; every row is judged alone, so repeated and tied rows are judged alike; other columns are not read.
    """
    measured = text_measures(docs).withColumn("n_repeat_words_pct", F.lit(100) * F.col("n_repeat_words"))
    any_base = F.greatest(*[r.fails() for r in base]) if len(base) > 1 else base[0].fails()
    names = F.array_compact(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in rules]))
    judged = measured.withColumn("base_failed", any_base).withColumn("failed", names)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("n_repeat_words_pct")
