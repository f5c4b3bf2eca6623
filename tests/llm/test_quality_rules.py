from collections import Counter

from support import corpus, documents, empty, word_list
from tidemark.llm.quality_rules import Rule, judge


def measures(text):
    words, text = word_list(text), text or ""
    lines = [x for x in text.split("\n") if word_list(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    held = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held)


def test_measures_equal_brute_force(spark):
    texts = corpus(60) + ["a b c d e f g h " * 5, "x " * 8, "x " * 9, "x " * 10 + "y " + "x " * 9, "𝒳 #*$ %&|<> ünï", "a b c d e f g h i a b c d e f g h", "t\nt\n\nt \nu\n \nu"]
    docs = documents(spark, texts)
    got = judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for r in docs.collect():
        m = measures(r["text"])
        want.append((r["doc_id"], *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_only_built_in_functions(spark):
    plan = judge(documents(spark, ["a b"], repeat=False))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_thresholds_are_inclusive_and_named(spark):
    docs = spark.createDataFrame([(1, "the cat of it # " + "word " * 35), (2, "the cat of it ##### " + "word " * 35), (3, "word " + "other " * 39)], "doc_id long, text string")
    rules = (Rule("symbols", "n_symbols", "n_words", most=0.025), Rule("stop", "n_stop_words", "n_words", least=0.05))
    out = {r["doc_id"]: (r["failed"], r["kept"]) for r in judge(docs, rules, (Rule("words", "n_words", least=20),)).collect()}
    assert out == {1: ([], True), 2: (["symbols"], False), 3: (["stop"], False)}


def test_empty_table(spark):
    assert judge(empty(spark)).count() == 0
