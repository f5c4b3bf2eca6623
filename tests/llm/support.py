"""Small corpora with the awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, size long, keep_bits string, score double"


def corpus(n=120, seed=1):
    """Near copies in chains, exact copies, shared lines, short and empty texts, one long text."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "TU", "ré", "sö") for b in ("na", "ser", "Ti", "x", "vö", "q")]
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.35:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind < 0.42:
            texts.append(rng.choice(["", " \t", "one", "Two words", "a line of text\nA LINE OF TEXT \n\nshared line of the corpus"]))
        else:
            lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 4))]
            if rng.random() < 0.3:
                lines.insert(0, "  Shared LINE of the corpus\t")
            texts.append("\n".join(lines))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(9_000)))
    return texts


def documents(spark, texts, repeat=True):
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t), 7, 8, "clash", 0.5) for i, t in enumerate(texts)]
    rows += [(len(texts), None, None, None, None, None, None, None, None)]
    if repeat:
        rows += [rows[3], rows[3], (None, texts[0], "en", "s1", 1, 1, 1, "x", 0.1), (None, "quite alone here", "en", None, 1, 1, 1, "x", 0.1)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def word_list(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
