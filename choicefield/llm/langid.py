"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

A model reads a text as its runs of letters, lower-cased; each letter and each end of a run is predicted from up to four
symbols before it. Highest-order counts come from every training row: tasks count words, turn them into 5-grams and Spark sums
them. Lower orders hold continuation counts (in how many different contexts a shorter gram occurs). The table that travels with
the tasks holds all grams while they fit (``GRAMS`` entries over all languages, and ``CELLS`` log-probabilities), and beyond that the
frequent ones, with the probabilities that all grams give them. It is the only thing that reaches the driver. The counts of all
grams then stay in the shared folder, and a word with a gram outside the table meets them by joins: its probability is that of
the whole model, so the size of the table decides where a word is scored and not how.

Scoring looks a gram up by binary search in the hash array of its order and falls back through the stored back-off weights.
Each word is scored once per task memory, a text is the sum of its words. The prediction is the language with the lowest
cross-entropy per symbol. A text is rejected when it is unlike every language, so that texts in two of them stay: each of its
words is read by the language that knows it best, and their cross-entropy lies further above what is usual for the length than
calibrated on texts put aside by hash: a tenth of a language's training rows, about ``CALIBRATION`` once there are more.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import Scope, Stored, arrow_map, column, hold, picked, text_slices
from .shingles import mix

ORDER = 5
GRAMS, CELLS = 1 << 20, 1 << 24
CALIBRATION = 1000
WORDS, COUNTED = 150_000, 100_000
_RUN = re.compile(r"[^\W\d_]+")
_START, _END = "\x02" * (ORDER - 1), "\x03"
_STEP = mix(np.arange(101, 101 + ORDER, dtype=np.uint64)) | np.uint64(1)


def letters(token: str) -> list[str]:
    """The runs of letters of a token, lower-cased."""
    return [r if r.isalpha() else "".join(filter(str.isalpha, r)) for r in _RUN.findall(token.lower()) if any(map(str.isalpha, r))]


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """Hash of each row of code points; rows of different lengths do not collide but by chance."""
    n = points.shape[1]
    return mix(sum(points[:, i] * _STEP[i] for i in range(n)) + np.uint64(n) if n else np.zeros(len(points), np.uint64))


_KINDS = np.full(sys.maxunicode + 1, 255, np.uint8)  # of a code point: 2 letter, 1 in a run but no letter, 0 neither, 255 not looked up yet


def _kinds(points: np.ndarray) -> np.ndarray:
    kinds = _KINDS[points]
    new = np.unique(points[kinds == 255])
    if len(new):
        _KINDS[new] = [2 * c.isalpha() or bool(_RUN.fullmatch(c)) for c in map(chr, new.tolist())]
        kinds = _KINDS[points]
    return kinds


def symbols(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all runs of all tokens, as ``letters`` finds them, with their start and end signs, and the token that each
    belongs to. All tokens are read at once, a line each."""
    lines = "\n".join(tokens)
    if lines.count("\n") >= max(1, len(tokens)):
        lines = "\n".join(t.replace("\n", " ") for t in tokens)
    points = np.frombuffer(lines.lower().encode("utf-32-le"), np.uint32)
    kinds = _kinds(points)
    at = np.flatnonzero(kinds == 2)
    gap = np.cumsum(kinds == 0)[at]
    first = np.flatnonzero(np.diff(gap, prepend=-1))
    sizes = np.diff(first, append=len(at))
    out = np.full(len(at) + ORDER * len(first), ord(_START[0]), np.uint64)
    out[np.arange(len(at)) + np.repeat(ORDER * np.arange(len(first)) + ORDER - 1, sizes)] = points[at]
    out[np.cumsum(sizes + ORDER) - 1] = ord(_END)
    return out, np.repeat(np.cumsum(points == ord("\n"))[at[first]], sizes + ORDER)


def windows(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.stack([points[at - n + 1 + i] for i in range(n)], axis=1) if n else np.empty((len(at), 0), np.uint64)


def _token_blocks(counts: Counter) -> Iterator[tuple[list[str], np.ndarray]]:
    block, size = [], 0
    for token, n in counts.items():
        block.append((token, n))
        size += len(token) + ORDER
        if size > 1 << 20:
            yield [t for t, _ in block], np.array([c for _, c in block])
            block, size = [], 0
    if block:
        yield [t for t, _ in block], np.array([c for _, c in block])


def gram_counts(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Distinct highest-order grams (rows of code points) of counted tokens and their counts."""
    rows, sums = [np.empty((0, ORDER), np.uint64)], [np.empty(0, np.int64)]
    for tokens, times in _token_blocks(counts):
        points, owner = symbols(tokens)
        at = np.flatnonzero(points != 2)
        grams = windows(points, at, ORDER)
        _, first, where = np.unique(gram_hashes(grams), return_index=True, return_inverse=True)
        rows.append(grams[first])
        sums.append(np.bincount(where, times[owner[at]], len(first)).astype(np.int64))
    grams, times = np.concatenate(rows), np.concatenate(sums)
    _, first, where = np.unique(gram_hashes(grams), return_index=True, return_inverse=True)
    return grams[first], np.bincount(where, times, len(first)).astype(np.int64)


def _strings(grams: np.ndarray) -> list[str]:
    joined = grams.astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i:i + ORDER] for i in range(0, len(joined), ORDER)]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold(__name__ + ".grams")
    held: dict[str, Counter] = {}

    def flush():
        for lang, counts in held.items():
            grams, times = gram_counts(counts)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "gram": _strings(grams), "n": times})
        held.clear()

    for batch in batches:
        for part in text_slices(batch):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, held.values())) > COUNTED:
                yield from flush()
    yield from flush()


@dataclass
class Model:
    """Sorted hash arrays: per order the grams with a log-probability for each language, and histories with back-off weights."""

    langs: list[str]
    grams: list = field(default_factory=list)       # index = order - 1: (hashes, log p[gram, lang])
    histories: list = field(default_factory=list)   # index = order - 1: (hashes, log back-off[history, lang])
    floor: float = 0.0
    centre: np.ndarray | None = None                # by language: usual cross-entropy, its spread for one symbol, allowed distance
    spread: np.ndarray | None = None
    allowed: np.ndarray | None = None
    counts: tuple = ()                              # if the table is not whole, by order, highest first: path of all (lang, gram, n)
    discounts: tuple = ()                           # likewise the discount of each language

    def log_probs(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log-probability of the symbols at the given places, for each language; NaN where a table that is not whole lacks
        the gram."""
        out = np.zeros((len(at), len(self.langs)), np.float32)
        open_ = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            spans = windows(points, at[open_], n)
            keys, values = self.grams[n - 1]
            row, hit = found(keys, gram_hashes(spans))
            out[open_[hit]] += values[row[hit]]
            open_, spans = open_[~hit], spans[~hit]
            if not len(open_):
                return out
            if self.counts:
                out[open_] = np.nan
                return out
            keys, values = self.histories[n - 1]
            row, hit = found(keys, gram_hashes(spans[:, :-1]))
            out[open_[hit]] += values[row[hit]]
        out[open_] += self.floor
        return out

    def tokens(self, tokens: list[str]) -> np.ndarray:
        """For each token its log-probability in each language, the highest of them, and its number of predicted symbols; NaN for the
        probabilities of a token with a gram that a table lacks which is not whole."""
        out = np.zeros((len(tokens), len(self.langs) + 2), np.float32)
        i = 0
        while i < len(tokens):
            j = size = 0
            while i + j < len(tokens) and (not j or size < 1 << 18):
                size += len(tokens[i + j])
                j += 1
            points, owner = symbols(tokens[i:i + j])
            for part in np.array_split(np.flatnonzero(points != 2), 1 + len(points) // (1 << 19)):
                if len(part):
                    logs = self.log_probs(points, part)
                    for l in range(len(self.langs)):
                        out[i:i + j, l] += np.bincount(owner[part], logs[:, l], j)
                    out[i:i + j, -1] += np.bincount(owner[part], minlength=j)
            i += j
        out[:, -2] = out[:, :-2].max(axis=1, initial=-np.inf)  # NaN stays
        return out


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return row, keys[row] == wanted


def discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(one / (one + 2 * two)) if one and two else 0.75


@dataclass
class Whole:
    """Statistics of an order over all its grams, also those that the table lacks: one row per (language, history)."""

    lang: np.ndarray
    past: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    discounts: np.ndarray


def fitted(langs: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Model:
    """Kneser-Ney tables from all highest-order counts: one row per (language, gram)."""
    levels = [(lang, grams, counts)]
    while levels[-1][1].shape[1] > 1:
        of, rows, _ = levels[-1]
        _, first, times = np.unique(mix(gram_hashes(rows[:, 1:]) + of.astype(np.uint64)), return_index=True, return_counts=True)
        levels.append((of[first], rows[first][:, 1:], times))
    return tables(langs, levels, [None] * ORDER, len(np.unique(grams[:, -1])))


def tables(langs: list[str], levels: list[tuple], wholes: list[Whole | None], alphabet: int) -> Model:
    """Kneser-Ney tables from the rows (language, gram, count) of each order, highest first; without ``Whole`` they are all rows."""
    model, lower = Model(langs), None
    model.floor = -float(np.log(alphabet + 1))
    for (of, rows, times), whole in zip(reversed(levels), reversed(wholes)):
        keys, first, where = np.unique(gram_hashes(rows), return_index=True, return_inverse=True)
        rows_of = rows[first]
        c = np.zeros((len(keys), len(langs)))
        c[where, of] = times
        past, at = np.unique(gram_hashes(rows_of[:, :-1]), return_inverse=True)
        total, kinds = np.zeros((len(past), len(langs))), np.zeros((len(past), len(langs)))
        if whole is None:
            d = np.array([discount(times[of == l]) for l in range(len(langs))])
            np.add.at(total, at, c)
            np.add.at(kinds, at, c > 0)
        else:
            d, own = whole.discounts, np.searchsorted(past, gram_hashes(whole.past))
            total[own, whole.lang], kinds[own, whole.lang] = whole.total, whole.kinds
        weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        below = np.exp(model.floor) if lower is None else lower[1][np.searchsorted(lower[0], gram_hashes(rows_of[:, 1:]))]
        p = np.maximum(c - d, 0) / np.maximum(total, 1)[at] + weight[at] * below
        lower = (keys, p)
        model.grams.append((keys, np.log(p).astype(np.float32)))
        model.histories.append((past, np.log(weight).astype(np.float32)))
    return model


def _points(strings: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(strings), n)


def cut_tables(langs: list[str], counted: Stored, least: Column) -> Model:
    """Tables of the grams that some language has ``least`` times, and their endings, when all would be too many for a task.

    Counts, continuation counts, totals of histories and discounts are those of all grams, summed in Spark; a gram of the table
    has its probability in every language. The model names the stored counts of all grams, which ``gram_scores`` reads."""
    with Scope() as scope:
        steps, model = _cut_tables(langs, counted, least)
        scope.keep(*steps)
    return model


def _cut_tables(langs: list[str], counted: Stored, least: Column) -> tuple[list[Stored], Model]:
    place = {l: i for i, l in enumerate(langs)}
    steps, level, kept = [], counted.df, Stored(counted.df.filter(least).select("gram").distinct(), "kept-grams").df
    levels, wholes, paths = [], [], [counted.path]
    for n in range(ORDER, 0, -1):
        past = F.substring("gram", 1, n - 1)
        rows = level.join(kept, "gram", "left_semi").toArrow()
        pasts = level.withColumn("past", past).join(kept.select(past.alias("past")).distinct(), "past", "left_semi")
        sums = pasts.groupBy("lang", "past").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).toArrow()
        seldom = {r.lang: (r.one, r.two) for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()}
        d = [one / (one + 2 * two) if one and two else 0.75 for one, two in map(seldom.__getitem__, langs)]
        levels.append((np.array([place[x] for x in rows["lang"].to_pylist()], np.int64), _points(rows["gram"].to_pylist(), n), rows["n"].to_numpy()))
        wholes.append(Whole(np.array([place[x] for x in sums["lang"].to_pylist()], np.int64), _points(sums["past"].to_pylist(), n - 1), sums["total"].to_numpy(),
                            sums["kinds"].to_numpy(), np.array(d)))
        if n > 1:
            end = F.substring("gram", 2, n - 1)
            steps.append(Stored(level.groupBy("lang", end.alias("gram")).agg(F.count("*").alias("n")), "lower-grams"))
            level = steps[-1].df
            paths.append(steps[-1].path)
            kept = Stored(kept.select(end.alias("gram")).distinct(), "kept-grams").df
    model = tables(langs, levels, wholes, level.select("gram").distinct().count())
    model.counts, model.discounts = tuple(paths), tuple(w.discounts for w in wholes)
    return steps, model


def _gram_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for word in batch.column("word").to_pylist():
        runs = [_START + r + _END for r in letters(word)]
        times = Counter(r[i:i + ORDER] for r in runs for i in range(len(r) - ORDER + 1))
        yield {"word": [word] * len(times), "gram": list(times), "n": list(times.values())}


def gram_scores(asked: DataFrame, model: Model) -> DataFrame:
    """(gram, logs): log-probability of the last symbol of each distinct highest-order gram asked for, in each language, from the counts of
    all grams. The orders are worked up from the lowest: p = max(c - d, 0) / total + weight * p of the ending."""
    spark, below = asked.sparkSession, None
    for n in range(1, ORDER + 1):
        level = spark.read.schema("lang string, gram string, n bigint").parquet(model.counts[ORDER - n])
        keys = asked.select(F.substring("gram", ORDER - n + 1, n).alias("gram")).distinct()
        past, ending = F.substring("gram", 1, n - 1), F.substring("gram", 2, n - 1)
        counts = level.join(keys, "gram", "left_semi").groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("c"))
        sums = (level.withColumn("past", past).join(keys.select(past.alias("past")).distinct(), "past", "left_semi")
                .groupBy("past", "lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
                .groupBy("past").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.struct("total", "kinds")))).alias("h")))
        rows = keys.withColumn("past", past).join(counts, "gram", "left").join(sums, "past", "left")
        if below is None:
            rows = rows.withColumn("below", F.array_repeat(F.lit(float(np.exp(model.floor))), len(model.langs)))
        else:
            rows = rows.withColumn("ending", ending).join(below.select(F.col("gram").alias("ending"), F.col("p").alias("below")), "ending")
        each = []
        for i, (l, d) in enumerate(zip(model.langs, map(float, model.discounts[ORDER - n]))):
            c, h = F.coalesce(F.col("c")[l], F.lit(0)), F.col("h")[l]
            weight = F.coalesce(d * h["kinds"] / h["total"], F.lit(1.0))
            each.append(F.greatest(c - d, F.lit(0.0)) / F.coalesce(h["total"], F.lit(1)) + weight * F.col("below")[i])
        below = Stored(rows.select("gram", F.array(*each).alias("p")), "gram-probabilities").df
    return below.select("gram", F.transform("p", lambda p: F.log(p).cast("float")).alias("logs"))


def word_scores(words: DataFrame, model: Model) -> DataFrame:
    """(word, scores) as ``Model.tokens`` of a whole table gives them, for a table of distinct words."""
    spans = Stored(arrow_map(words, _gram_rows, "word string, gram string, n bigint"), "word-grams").df
    logs = [F.sum(F.col("n") * F.col("logs")[i].cast("double")).cast("float").alias(f"l{i}") for i in range(len(model.langs))]
    sums = spans.join(gram_scores(spans.select("gram").distinct(), model), "gram").groupBy("word").agg(*logs, F.sum("n").cast("float").alias("symbols"))
    each = F.array(*[f"l{i}" for i in range(len(model.langs))])
    return sums.select("word", F.concat(each, F.array(F.array_max(each), "symbols")).alias("scores"))


def summed_texts(df: DataFrame, model: Model, text: str) -> DataFrame:
    """(kept, sums): each row as a struct and the sums of its text over all words, for a model whose table is not whole.

    Words of the table are summed where the text is read. Only the others leave it; each is scored once for the whole table of
    texts and its scores come back by the number of the row, which is stored with it."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            for part in text_slices(batch):
                sums, open_ = scorer.texts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"kept": part.column("kept"), "sums": pa.array(list(sums), pa.list_(pa.float64())),
                                                  "open": pa.array(open_, pa.list_(pa.string()))})

    given = df.select(F.struct(*map(column, df.columns)).alias("kept"), column(text).alias("text"))
    schema = StructType([given.schema["kept"], StructField("sums", ArrayType(DoubleType())), StructField("open", ArrayType(StringType()))])
    whole = Stored(given.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "summed").df
    words = Stored(whole.select("row", F.explode("open").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times")), "open-words").df
    late = [F.sum(F.col("times") * F.col("scores")[i].cast("double")) for i in range(len(model.langs) + 2)]
    added = words.join(word_scores(words.select("word").distinct(), model), "word").groupBy("row").agg(F.array(*late).alias("late"))
    both = F.when(F.col("late").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "late", lambda a, b: a + b))
    return whole.join(added, "row", "left").select("kept", both.alias("sums"))


class Scorer:
    """Scores texts in a task; remembers the words it has met, up to ``WORDS`` of them."""

    def __init__(self, model: Model):
        self.model, self.known, self.rows = model, {}, np.zeros((0, len(model.langs) + 2), np.float32)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[str]]]:
        """For each text the summed log-probability in each language and in each word's best one, and the number of symbols, and its
        words that the sums leave out: those with a gram that a table lacks which is not whole."""
        split = [(t or "").split() for t in texts]
        if len(self.known) > WORDS:
            self.known, self.rows = {}, self.rows[:0]
        fresh = list(set(chain.from_iterable(split)).difference(self.known))
        self.known.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh))))
        self.rows = np.concatenate((self.rows, self.model.tokens(fresh)))
        sums, open_ = np.zeros((len(texts), self.rows.shape[1])), [[] for _ in texts]
        sizes = np.array([len(words) for words in split], np.int64)
        rows = self.rows[np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sizes.sum())]
        if self.model.counts:
            lacking = np.isnan(rows[:, -2])
            owner = np.repeat(np.arange(len(texts)), sizes)[lacking]
            words = list(chain.from_iterable(split))
            for i, k in zip(owner.tolist(), np.flatnonzero(lacking).tolist()):
                open_[i].append(words[k])
            rows[lacking] = 0
        some = sizes > 0
        if some.any():
            sums[some] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.float64)
        return sums, open_

    def decided(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, accepted) of each text, by a whole table."""
        if not self.model.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        return decisions(self.model, self.texts(texts)[0])


def decisions(model: Model, sums: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, accepted) of texts with these sums over all their words."""
    langs = model.langs
    n = sums[:, -1]
    entropy = -sums[:, :-2] / np.maximum(n, 1)[:, None]
    best = entropy.argmin(axis=1)
    least = entropy[np.arange(len(best)), best]
    near = np.exp(-(entropy - least[:, None]) * np.minimum(n, 20)[:, None])
    score = np.where(n > 0, 1 / near.sum(axis=1), 0.0)
    far = (-sums[:, -2] / np.maximum(n, 1) - model.centre[best]) * np.sqrt(np.maximum(n, 1)) / model.spread[best]
    accepted = (n > 0) & (far <= model.allowed[best])
    return [langs[b] if k else "und" for b, k in zip(best, n)], score, accepted


def is_held_out(doc_id: str) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(column(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on every row with a text and a language. Without such rows the model knows no language and rejects every text; a
    language without two texts put aside rejects none of its own."""
    rows = picked(df, text=text, lang=lang).dropna()
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([])
    step = F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, max(10, n // CALIBRATION))])
    aside = F.pmod(F.xxhash64("text"), step[F.col("lang")]) == 0
    counted = Stored(rows.filter(~aside).mapInArrow(_count_batches, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r.lang: r.total for r in counted.df.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    langs = sorted(totals)
    if not langs:
        counted.drop()
        return Model([])
    most = min(GRAMS, CELLS / len(langs))
    if counted.df.count() <= most:  # where words are scored, not how
        table, place = counted.df.toArrow(), {l: i for i, l in enumerate(langs)}
        of = np.array([place[x] for x in table["lang"].to_pylist()])
        model = fitted(langs, of, _points(table["gram"].to_pylist(), ORDER), table["n"].to_numpy())
        counted.drop()
    else:
        least = F.create_map(*[F.lit(x) for k in langs for x in (k, totals[k] * len(langs) / most)])
        model = cut_tables(langs, counted, F.col("n") >= least[F.col("lang")])
    return calibrated(model, rows.filter(aside & F.col("lang").isin(langs)))


def _entropy_rows(batch, model) -> Iterator[dict]:
    scorer = Scorer(model.value)
    for part in text_slices(batch):
        sums = scorer.texts(part.column("text").to_pylist())[0]
        yield {"lang": part.column("lang"), "entropy": -sums[:, -2] / np.maximum(sums[:, -1], 1), "n": sums[:, -1]}


def _entropies(rows: DataFrame, model: Model) -> DataFrame:
    if model.counts:
        size, n = len(model.langs), F.col("sums")[len(model.langs) + 1]
        return summed_texts(rows, model, "text").select("kept.lang", (-F.col("sums")[size] / F.greatest(n, F.lit(1.0))).alias("entropy"), n.alias("n"))
    return arrow_map(rows, _entropy_rows, "lang string, entropy double, n double", rows.sparkSession.sparkContext.broadcast(model))


def calibrated(model: Model, rows: DataFrame) -> Model:
    """Usual cross-entropy, spread and allowed distance of each language, from the texts put aside."""
    table = _entropies(rows.dropDuplicates(["text", "lang"]), model).toArrow().to_pandas()
    table = table[table.n > 0]
    size = len(model.langs)
    model.centre, model.spread, model.allowed = np.zeros(size), np.full(size, 1.0), np.full(size, np.inf)
    for i, l in enumerate(model.langs):
        own = table[table.lang == l]
        if len(own) > 1:
            model.centre[i] = np.average(own.entropy, weights=own.n)
            model.spread[i] = max(1e-3, np.sqrt((own.n * (own.entropy - model.centre[i]) ** 2).mean()))
            far = (own.entropy - model.centre[i]) * np.sqrt(own.n) / model.spread[i]
            model.allowed[i] = 3 + 2 * max(0.0, far.max())
    return model


def _scored_rows(batch, model) -> Iterator[dict]:
    scorer = _scorer(model)
    for part in text_slices(batch):
        langs, score, accepted = scorer.decided(part.column("text").to_pylist())
        yield {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": langs, "score": score, "accepted": accepted}


_SCORERS: dict[int, Scorer] = {}


def _scorer(model) -> Scorer:
    """One scorer for each model and Python worker, so that later batches know the words of earlier ones."""
    hold(__name__, _SCORERS.clear)
    if id(model.value) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model.value)] = Scorer(model.value)
    return _SCORERS[id(model.value)]


def _decided(summed: DataFrame, model: Model) -> DataFrame:
    """``summed`` (kept, sums) with ``decided`` (lang_pred, score, accepted)."""
    small = Model(model.langs, centre=model.centre, spread=model.spread, allowed=model.allowed)
    parts = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.array(batch.column("sums").to_pylist(), float).reshape(batch.num_rows, len(small.langs) + 2)
            langs, score, accepted = decisions(small, sums)
            columns = [pa.array(langs, pa.string()), pa.array(score), pa.array(accepted)]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.StructArray.from_arrays(columns, fields=list(parts))], ["kept", "decided"])

    decided = StructType.fromDDL("lang_pred string, score double, accepted boolean")
    schema = StructType([summed.schema["kept"], StructField("decided", decided)])
    return summed.mapInArrow(run, schema)


def identify(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for every row, repeated ids included.

    ``lang_pred`` is a language of the model, or ``und`` for a null text and one without a letter (score 0, not accepted).
    ``score`` is the share of the best language when languages are weighed by the likelihood of up to 20 typical symbols; equal
    cross-entropies go to the first language by name. ``accepted`` is false for texts unlike all languages of the model.
    A null doc_id is not held out. An empty table gives no rows; other columns are not read.
    """
    rows = picked(df, doc_id=doc_id, text=text).withColumn("held_out", is_held_out("doc_id"))
    if model.counts:
        decided = _decided(summed_texts(rows, model, "text"), model)
        return decided.select("kept.doc_id", "kept.held_out", "decided.*")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, accepted boolean"
    return arrow_map(rows, _scored_rows, schema, df.sparkSession.sparkContext.broadcast(model))


def accepted_rows(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text the model accepts."""
    if model.counts:
        return _decided(summed_texts(df, model, text), model).filter("decided.accepted").select("kept.*")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            for part in text_slices(batch, text):
                yield part.filter(pa.array(scorer.decided(part.column(text).to_pylist())[2]))

    return df.mapInArrow(run, df.schema)
