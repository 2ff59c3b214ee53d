"""The model's statistics are those of all training rows, with and without a cut."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import numpy as np  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from choicefield.llm import langid  # noqa: E402
from test_llm_langid import reference  # noqa: E402


@pytest.mark.parametrize("grams, whole", [(4000, True), (600, False)])
def test_statistics_of_all_rows(spark, monkeypatch, grams, whole):
    rng = random.Random(9)
    common = {"x": ["banana", "cab"], "y": ["weine", "drei"]}
    rows = [(" ".join([*rng.choices(common[l], k=60), "".join(rng.choices("abcnw" if l == "x" else "wdeinr", k=7))]), l) for l in "xy" for _ in range(120)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    step = max(10, 120 // langid.CALIBRATION)
    taught = [(r.text, r.lang) for r in frame.filter(F.pmod(F.xxhash64("text"), F.lit(step)) != 0).collect()]
    monkeypatch.setattr(langid, "GRAMS", grams)
    model = langid.train(frame)
    found = len({(s[i:i + 5], l) for t, l in taught for w in t.split() for s in ["\x02" * 4 + w + "\x03"] for i in range(len(s) - 4)})
    assert (found <= grams) == whole and found < 4000
    p = reference(taught, ["x", "y"])
    words = [*common["x"], *common["y"]] + [t.split()[-1] for t, _ in taught[::9]] * whole
    for word in words:
        row, s = model.tokens([word])[0], "\x02" * 4 + word + "\x03"
        own = [i for i, l in enumerate("xy") if whole or word in common[l]]
        for l in own:
            assert abs(row[l] - sum(np.log(p(s[i], s[i - 4:i], "xy"[l])) for i in range(4, len(s)))) < 2e-3


def test_results_do_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    """F7, F8: rare words are scored by all grams, also when the table of a task holds the frequent ones only."""
    rng = random.Random(4)
    letters = {"x": "abcnw", "y": "wdeinr"}

    def word(l):
        return "".join(rng.choices(letters[l], k=6))

    rows = [(" ".join([*rng.choices([word("x")] if l == "x" else ["weine", "drei"], k=8), *[word(l) for _ in range(4)]]), l) for l in "xy" for _ in range(150)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    asked = [(i, t, "a.b") for i, (t, _) in enumerate(rows[::5])] + [(i, " ".join(word(rng.choice("xy")) for _ in range(5)), "q") for i in range(200, 260)]
    asked += [(300, None, "q"), (301, "", "q"), (302, "12 !", "q"), (None, "wnacb", "q"), (303, "ωμέγα щука " * 9, "q"), (303, "ωμέγα щука " * 9, "q")]
    docs = spark.createDataFrame(asked, "doc_id long, text string, source string")
    got, kept, calibration = {}, {}, {}
    for grams in (1 << 20, 300):
        monkeypatch.setattr(langid, "GRAMS", grams)
        model = langid.train(frame)
        got[grams] = sorted(map(tuple, langid.identify(docs, model).collect()), key=str)
        kept[grams] = sorted(map(tuple, langid.accepted_rows(docs, model).collect()), key=str)
        calibration[grams] = np.stack([model.centre, model.spread, model.allowed])
        assert bool(model.counts) == (grams < 1 << 20)
        assert len(model.grams[-1][0]) <= 2 * grams
    whole = got.pop(1 << 20)
    for grams, rows in got.items():
        assert len(rows) == len(asked) and [(r[0], r[1], r[2], r[4]) for r in rows] == [(r[0], r[1], r[2], r[4]) for r in whole]
        assert max(abs(r[3] - w[3]) for r, w in zip(rows, whole)) < 1e-4
        assert kept[grams] == kept[1 << 20] and 0 < len(kept[grams]) < len(asked)
        assert np.allclose(calibration[grams], calibration[1 << 20], rtol=1e-4)
