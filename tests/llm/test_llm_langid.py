import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import numpy as np  # noqa: E402

import brute  # noqa: E402
from conftest import SMALL  # noqa: E402
from choicefield.llm import langid, queries  # noqa: E402


def reference(rows, langs, order=langid.ORDER):
    """Interpolated Kneser-Ney with dictionaries; returns p(symbol, history, lang)."""
    counts = {l: [{} for _ in range(order + 1)] for l in langs}
    for text, lang in rows:
        for token in text.split():
            for run in langid.letters(token):
                s = "\x02" * (order - 1) + run + "\x03"
                for i in range(order - 1, len(s)):
                    g = s[i - order + 1:i + 1]
                    counts[lang][order][g] = counts[lang][order].get(g, 0) + 1
    for l in langs:
        for n in range(order, 1, -1):
            for g in counts[l][n]:
                counts[l][n - 1][g[1:]] = counts[l][n - 1].get(g[1:], 0) + 1
    alphabet = len({g[-1] for l in langs for g in counts[l][order]}) + 1

    def p(symbol, history, lang):
        value = 1 / alphabet
        for n in range(1, order + 1):
            table = counts[lang][n]
            h = history[len(history) - n + 1:] if n > 1 else ""
            seen = {g: c for g, c in table.items() if g[:-1] == h}
            one, two = (sum(c == k for c in table.values()) for k in (1, 2))
            d = one / (one + 2 * two) if one and two else 0.75
            total = sum(seen.values())
            if total:
                value = max(seen.get(h + symbol, 0) - d, 0) / total + d * len(seen) / total * value
        return value

    return p


def test_tables_are_kneser_ney(monkeypatch):
    rows = [("abra cadabra abba", "x"), ("cab dab bad abab", "x"), ("ein zwei drei eins", "y"), ("zwei weine dein", "y")]
    langs = ["x", "y"]
    of, grams, counts = [], [], []
    for i, l in enumerate(langs):
        from collections import Counter
        g, c = langid.gram_counts(Counter(w for t, k in rows if k == l for w in t.split()))
        of += [i] * len(g)
        grams.append(g)
        counts.append(c)
    model = langid.fitted(langs, np.array(of), np.concatenate(grams), np.concatenate(counts))
    p = reference(rows, langs)
    for word in ("abra", "zwein", "qqq", "cadab"):
        row = model.tokens([word])[0]
        s = "\x02" * 4 + word + "\x03"
        for l, lang in enumerate(langs):
            want = sum(np.log(p(s[i], s[i - 4:i], lang)) for i in range(4, len(s)))
            assert abs(row[l] - want) < 1e-3
        assert row[-1] == len(word) + 1


def test_held_out_accuracy_and_columns(spark):
    rows = queries.op7_langid(spark, SMALL).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(truth) and all(r.held_out == brute.held_out(r.doc_id) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.accepted for r in rows) >= 0.97 * len(rows)


def test_odd_rows(spark):
    rng = random.Random(5)
    words = {"de": "der die das und nicht ein haus baum".split(), "en": "the house and this is not a tree".split()}
    train = spark.createDataFrame([(" ".join(rng.choices(words[k], k=12)), k) for k in words for _ in range(150)] + [(None, "fr"), ("x", None)], "text string, lang string")
    model = langid.train(train)
    assert model.langs == ["de", "en"]
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 !?", "a"), (4, "the house", "a"), (4, "the house", "a"), (None, "das haus und", "a"), (7, "the " * 50000, "a")]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == 7 and [by_id[i].lang_pred for i in (1, 2, 3, 4, None, 7)] == ["und"] * 3 + ["en", "de", "en"]
    assert by_id[1].score == 0 and not by_id[1].accepted and by_id[None].held_out is False
    kept = langid.accepted_rows(spark.createDataFrame([(1, "the house and this"), (2, "Щука жила далеко " * 20), (3, None)], "id int, text string"), model)
    assert [r.id for r in kept.collect()] == [1]
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    empty = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), empty).collect()] == ["und"]
