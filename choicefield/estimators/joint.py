"""The joint model of choices and answers: latent variables along a graph, simulated per individual inside its partition.

An individual's latent variables follow from its draws: eta = sum gamma x predictor + z, in topological order, with covariates and
earlier latent variables as predictors. They shift utilities (lambda x eta x attribute) and answers (zeta x eta), which are Gaussian
or ordered. Given the draws all parts are independent, so the log-likelihood of an individual is ln mean_r exp(sum of parts), and
the derivative by eta flows backwards along the graph from the parts that use it.

``placed`` keeps one table: for each individual a row with its answers and covariates, then the rows of its choice sets, sorted, as
packed Arrow batches.
``Kernel`` streams it: sums of exponentials per set, sums per individual and draw, scores per individual, one block per partition
(``operators.blocks``). Several parameter points are evaluated in one pass. Neither a set nor an individual is held whole; an
individual above the hot limit is spread over salts of whole sets, whose sums per draw are added up before its score is formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import PROB_FLOOR
from ..functions.vector import SQRT_2PI, interval_of_tails, norm_ppf, radical_inverse, tail_and_exp
from ..operators import blocks, kernels

SLICE = 1 << 19  # row x draw cells whose individuals are begun together
CHUNK = 1 << 15  # row x draw cells of one step, which stay in a core's cache
BLOCK = 32
STEEP = 500.0
FAR = 40.0
ENDS = 20.0
BAD = -1e10
LOG_PROB = math.log(PROB_FLOOR), math.log1p(-PROB_FLOOR)


def ordered_graph(graph: dict[str, list[str]]) -> list[str]:
    """Latent variables (name -> predictors), each after those that predict it."""
    done: list[str] = []
    left = dict(graph)
    while left:
        ready = [lv for lv, before in left.items() if not any(p in left for p in before)]
        if not ready:
            raise ValueError(f"latent variables predict each other in a circle: {sorted(left)}")
        done += ready
        for lv in ready:
            del left[lv]
    return done


@dataclass
class Item:
    """One indicator of ``lv``: ordered with the category values seen, or Gaussian."""
    name: str
    lv: str
    values: list[float] | None = None

    @property
    def cuts(self) -> list[str]:
        return [f"tau_{self.name}_{v:g}" for v in self.values[:-1]]


@dataclass
class Model:
    """What the parameters are and where each enters. Searched values: variances as logarithms, cut points as the first and the
    logarithms of the gaps, so that every vector is a valid model."""
    attrs: list[str]
    graph: dict[str, list[str]]
    terms: list[tuple[str, str]]
    items: list[Item]
    n_draws: int
    names: dict[tuple[str, str], str] = field(default_factory=dict)
    betas: list[str] | None = None
    seed: int | None = None
    largest: int = 1

    def __post_init__(self):
        self.order = ordered_graph(self.graph)
        self.covars = list(dict.fromkeys(p for lv in self.order for p in self.graph[lv] if p not in self.graph))
        self.betas = list(self.attrs) if self.betas is None else self.betas
        for lv, a in self.terms:
            if lv not in self.graph or a not in self.attrs:
                raise ValueError(f"unknown term {lv} x {a}")
        self.items = [i for i in self.items if i.values is None or len(i.values) > 1]
        self.params = [*[self.name("beta", a) for a in self.betas], *[self.name("lambda", lv, a) for lv, a in self.terms],
                       *[self.name("gamma", p, lv) for lv in self.order for p in self.graph[lv]], *[f"zeta_{i.name}" for i in self.items],
                       *[n for i in self.items for n in (i.cuts if i.values else [f"sigma2_{i.name}"])]]
        self.at = {n: k for k, n in enumerate(self.params)}

    def name(self, kind: str, *of: str) -> str:
        return self.names.get((kind, *of)) or "_".join([kind, *of[:1], *(["to"] if kind == "gamma" else []), *of[1:]])

    def natural(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reported parameters of a searched vector, and their Jacobian."""
        out, jac = theta.copy(), np.eye(len(theta))
        for i in self.items:
            if i.values is None:
                k = self.at[f"sigma2_{i.name}"]
                out[k] = jac[k, k] = math.exp(theta[k])
            else:
                ks = [self.at[c] for c in i.cuts]
                gaps = np.exp(theta[ks[1:]])
                out[ks] = theta[ks[0]] + np.concatenate(([0.0], np.cumsum(gaps)))
                for n, k in enumerate(ks):
                    jac[k, ks] = 0.0
                    jac[k, ks[0]] = 1.0
                    jac[k, ks[1:n + 1]] = gaps[:n]
        return out, jac

    def searched(self, values: dict[str, float]) -> np.ndarray:
        """The searched vector of reported values."""
        out = np.array([values[n] for n in self.params], dtype=float)
        for i in self.items:
            if i.values is None:
                k = self.at[f"sigma2_{i.name}"]
                out[k] = math.log(out[k])
            else:
                ks = [self.at[c] for c in i.cuts]
                out[ks[1:]] = np.log(np.diff(out[ks]))
        return out


def placed(rel: DataFrame, individuals: DataFrame, key: str, set_keys: list[str], model: Model, split: bool) -> DataFrame:
    """Rows (idx, kind, sid, x) sorted within partitions and packed: kind 0 is an individual (x = answers and covariates), kind 1 a row
    of a choice set (x = differences to the chosen row). Every step reads all of them, and turning rows into Arrow batches took as
    long as the sums over the draws; so it is done once, and a step reads the bytes of whole batches."""
    rows = rel.join(individuals.select(key, "idx"), key)
    own = individuals.select("idx", F.array(*[F.col(c).cast("double") for c in [*[i.name for i in model.items], *model.covars]]).alias("x") if model.items or model.covars
                             else F.array().cast("array<double>").alias("x"))
    salt = F.pmod(F.xxhash64(*set_keys), F.lit(kernels.SALTS)).cast("int") if split else F.lit(0)
    chosen = rows.select("idx", salt.alias("salt"), F.lit(1).alias("kind"), F.xxhash64(*set_keys).alias("sid"),
                         F.array(*[F.col(f"d_{a}") for a in model.attrs]).alias("x"))
    salts = chosen.select("idx", "salt").distinct().join(own, "idx") if split else own.withColumn("salt", F.lit(0))
    if split:
        salts = salts.unionByName(own.join(chosen.select("idx").distinct(), "idx", "left_anti").withColumn("salt", F.lit(0)))
    people = salts.select("idx", "salt", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("sid"), "x")
    rows = people.unionByName(chosen).repartition("idx", "salt").sortWithinPartitions("idx", "salt", "kind", "sid")
    return rows.mapInArrow(_packed, "rows binary").persist(StorageLevel.MEMORY_AND_DISK)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.select(["idx", "kind", "sid", "x"])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([out.getvalue().to_pybytes()], pa.binary())})


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in batch.column("rows"):
            yield from pa.ipc.open_stream(rows.as_buffer())


class People:
    """Individuals that a batch begins: ids, answers, covariates, draws and latent variables at one parameter point."""

    def __init__(self, model: Model, theta: np.ndarray, idx: np.ndarray, x: np.ndarray):
        m, at = len(model.items), model.at
        self.idx, self.x, self.answers, covars, self.n_draws = idx, x, x[:, :m], x[:, m:], model.n_draws
        points = idx[:, None] * model.n_draws + np.arange(model.n_draws) + 1
        self.values = {c: covars[:, j][:, None] for j, c in enumerate(model.covars)}
        for lv, base in zip(model.order, kernels.primes(len(model.order))):
            u = radical_inverse(points, base, model.largest, model.seed)
            eta = norm_ppf(np.clip(u, 1e-12, 1 - 1e-12))
            for p in model.graph[lv]:
                eta = eta + theta[at[model.name("gamma", p, lv)]] * self.values[p]
            self.values[lv] = eta
        self.coefs = [np.full((len(idx), 1), theta[at[model.name("beta", a)]] if a in model.betas else 0.0) for a in model.attrs]
        for lv, a in model.terms:
            k = model.attrs.index(a)
            self.coefs[k] = self.coefs[k] + theta[at[model.name("lambda", lv, a)]] * self.values[lv]

    def utilities(self, person: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Rows x draws. Coefficients that are the same for all draws are one column."""
        fixed = sum((coef[person, 0] * d[:, a] for a, coef in enumerate(self.coefs) if coef.shape[1] == 1), np.zeros(len(d)))
        v = None
        for a, coef in enumerate(self.coefs):
            if coef.shape[1] > 1:
                by = coef[person]
                by *= d[:, a, None]
                v = by if v is None else np.add(v, by, out=v)
        if v is None:
            return np.repeat(fixed[:, None], self.n_draws, axis=1)
        v += fixed[:, None]
        return v


def grouped(of: np.ndarray, n: int, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """n x weights x columns: sums of the rows of ``x`` by their ascending number ``of`` (below n), with each row of ``weights``.

    A reduction along rows costs a call a cell, so blocks of ``BLOCK`` rows are multiplied by small matrices that hold the weights; a
    number that goes on in the next block is added there. ``x`` has to be finite."""
    out = np.zeros((n, len(weights), x.shape[1]))
    if not len(of):
        return out
    rows = np.arange(len(of))
    block, place = np.divmod(rows, BLOCK)
    n_blocks = int(block[-1]) + 1
    number = np.concatenate(([0], np.cumsum(of[1:] != of[:-1])))
    first = number[::BLOCK]
    local = number - first[block]
    m = np.zeros((n_blocks, local.max() + 1, len(weights), BLOCK))
    m[block, local, :, place] = weights.T
    if len(of) % BLOCK:
        x = np.concatenate([x, np.zeros((n_blocks * BLOCK - len(of), x.shape[1]))])
    sums = (m.reshape(n_blocks, -1, BLOCK) @ x.reshape(n_blocks, BLOCK, -1)).reshape(*m.shape[:3], -1)
    begun = rows[(local > 0) & np.concatenate(([False], of[1:] != of[:-1]))]
    out[of[begun]] = sums[block[begun], local[begun]]
    for b in range(n_blocks):
        out[of[b * BLOCK]] += sums[b, 0]
    return out


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1))


class Kernel:
    """Sums of one partition at one parameter point: ``feed`` rows, ``finish``; ``total`` is [ll, n, scores, outer products]."""

    def __init__(self, model: Model, theta: np.ndarray, partial: bool = False):
        self.model, self.theta, self.partial = model, theta, partial
        self.k, self.r, self.a = len(model.params), model.n_draws, len(model.attrs)
        self.total = np.zeros(2 + self.k + self.k * self.k)
        self.who: People | None = None  # individuals whose rows may go on
        self.ll = self.g = None
        self.set: tuple | None = None
        self.out: list[tuple] = []

    def feed(self, idx: np.ndarray, kind: np.ndarray, sid: np.ndarray, x: list[np.ndarray], d: np.ndarray) -> None:
        """``x`` are the rows of kind 0, ``d`` those of kind 1."""
        starts = np.flatnonzero(kind == 0)
        rows = np.flatnonzero(kind == 1)
        begun = People(self.model, self.theta, idx[starts], x) if len(starts) else None
        person = np.searchsorted(starts, rows, "right")  # 0: the individual still open
        here = person == 0
        if here.any():
            self._rows(self.who, np.zeros(here.sum(), np.int64), sid[rows[here]], d[here])
        if begun is not None:
            self._close()
            self.who, self.ll, self.g = begun, np.zeros((len(starts), self.r)), np.zeros((self.a, len(starts), self.r))
            if not here.all():
                self._rows(begun, person[~here] - 1, sid[rows[~here]], d[~here])
            self._close(last=False)

    def _rows(self, who: People, person: np.ndarray, sid: np.ndarray, d: np.ndarray) -> None:
        size = max(1, CHUNK // self.r)
        for i in range(0, len(d), size):
            self._chunk(who, person[i:i + size], sid[i:i + size], d[i:i + size])

    def _chunk(self, who: People, person: np.ndarray, sid: np.ndarray, d: np.ndarray) -> None:
        starts = changes(person, sid)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(d))))
        moved = np.flatnonzero(d.any(axis=1))  # the others, chosen rows above all, have exponent 0
        v = who.utilities(person[moved], d[moved])
        if not len(v) or max(v.max(), -v.min()) <= STEEP:
            # all exponents are on one scale that neither overflows nor vanishes
            top = np.zeros((len(starts), self.r))
            q = grouped(of[moved], len(starts), np.exp(v, out=v), np.concatenate([np.ones((1, len(v))), d[moved].T]))
            q[:, 0] += (np.bincount(of, minlength=len(starts)) - np.bincount(of[moved], minlength=len(starts)))[:, None]
        else:
            v = who.utilities(person, d)
            top = np.maximum.reduceat(v, starts, axis=0)
            e = np.exp(v - top[of])
            q = np.stack([np.add.reduceat(x, starts, axis=0) for x in (e, *[e * d[:, a, None] for a in range(self.a)])], axis=1)
        owner, name = person[starts], sid[starts]
        if self.set is not None:
            who0, name0, top0, q0 = self.set
            if who0 == owner[0] and name0 == name[0]:  # the set goes on in this slice
                most = np.maximum(top0, top[0])
                q[0] = np.exp(top0 - most) * q0 + np.exp(top[0] - most) * q[0]
                top[0] = most
            else:
                self._end_set()
        if len(starts) > 1:
            self._add(owner[:-1], top[:-1], q[:-1])
        self.set = int(owner[-1]), int(name[-1]), top[-1].copy(), q[-1].copy()

    def _add(self, owner: np.ndarray, top: np.ndarray, q: np.ndarray) -> None:
        """Sets that are complete go to their individuals; ``q`` holds their sums and is used up."""
        q[:, 1:] /= q[:, :1]
        ll = np.log(q[:, 0])
        ll += top
        np.negative(ll, out=ll)
        np.clip(ll, *LOG_PROB, out=q[:, 0])
        starts = changes(owner)
        flat = q.reshape(len(q), -1)
        if math.isfinite(flat.sum()):
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(owner))))
            sums = grouped(of, len(starts), flat, np.ones((1, len(owner))))
        else:
            sums = np.add.reduceat(flat, starts, axis=0)
        sums, to = sums.reshape(len(starts), 1 + self.a, self.r), owner[starts]
        self.ll[to] += sums[:, 0]
        for a in range(self.a):
            self.g[a][to] -= sums[:, 1 + a]

    def _end_set(self) -> None:
        if self.set is not None:
            who, _, top, q = self.set
            self.set = None
            self._add(np.array([who]), top[None], q[None])

    def _close(self, last: bool = True) -> None:
        """Individuals that are complete: all but the last one, or all."""
        if self.who is None:
            return
        n = len(self.who.idx) - (0 if last else 1)
        if last or (self.set is not None and self.set[0] < n):
            self._end_set()
        if n:
            self._finished(self.who.idx[:n], self.who.x[:n], self.ll[:n], [g[:n] for g in self.g], {c: v[:n] for c, v in self.who.values.items()})
        if last:
            self.who = None
        elif n:
            whole = self.who
            self.who = People.__new__(People)
            self.who.idx, self.who.x, self.who.answers, self.who.n_draws = whole.idx[n:], whole.x[n:], whole.answers[n:], whole.n_draws
            self.who.values, self.who.coefs = {c: v[n:] for c, v in whole.values.items()}, [c[n:] for c in whole.coefs]
            self.ll, self.g = self.ll[n:], self.g[:, n:]
            if self.set is not None:
                self.set = (self.set[0] - n, *self.set[1:])

    def finish(self) -> None:
        self._close()

    def _finished(self, idx, x, ll, g, values) -> None:
        if self.partial:
            self.out.append((idx, x, ll, np.array(g)))
        else:
            self.scores(x[:, :len(self.model.items)], values, ll, g)

    def scores(self, answers: np.ndarray, values: dict[str, np.ndarray], ll: np.ndarray, g: list[np.ndarray]) -> None:
        """Measurement part, weights of the draws, backward pass along the graph, sums over the individuals.

        Derivatives are linear in the weights, so what is passed backwards is weighted, and sums over draws are taken at once."""
        model, theta, at = self.model, self.theta, self.model.at
        natural = model.natural(theta)[0]
        seen_of, pieces = ~np.isnan(answers), []
        for j, item in enumerate(model.items):
            seen, eta, zeta = seen_of[:, j], values[item.lv], theta[at[f"zeta_{item.name}"]]
            y = np.where(seen, answers[:, j], 0.0 if item.values is None else item.values[0])
            if item.values is None:
                var = natural[at[f"sigma2_{item.name}"]]
                e = y[:, None] - zeta * eta
                own = e * e
                own *= -1 / (2 * var)
                own -= 0.5 * math.log(2 * math.pi * var)
                pieces.append((e,))
            else:
                own, *ends = self._ordered(item, y, zeta * eta, natural)
                pieces.append(ends)
            if not seen.all():
                own[~seen] = 0.0
            ll = ll + own
        good = np.isfinite(ll)
        top = np.where(good, ll, -np.inf).max(axis=1, keepdims=True)
        known = np.isfinite(top[:, 0])
        e = np.where(good, np.exp(np.where(good, ll, 0.0) - np.where(known[:, None], top, 0.0)), 0.0)
        size = e.sum(axis=1, keepdims=True)
        w = e / np.where(size > 0, size, 1.0)
        person = np.where(known, np.where(known, top[:, 0], 0.0) + np.log(np.where(known, size[:, 0], 1.0)) - math.log(self.r), BAD)
        whole = good.all()

        def weighted(x: np.ndarray) -> np.ndarray:
            return w * (x if whole else np.where(good, x, 0.0))

        def total(x: np.ndarray, by: np.ndarray) -> np.ndarray:
            return np.einsum("ij,ij->i", x, np.broadcast_to(by if whole else np.where(good, by, 0.0), x.shape))

        s = np.zeros((len(ll), self.k))
        d_eta = {lv: np.zeros(ll.shape) for lv in model.order}
        grad = {a: weighted(g[k]) for k, a in enumerate(model.attrs)}
        for a in model.betas:
            s[:, at[model.name("beta", a)]] = grad[a].sum(axis=1)
        for lv, a in model.terms:
            k = at[model.name("lambda", lv, a)]
            s[:, k] = total(grad[a], values[lv])
            d_eta[lv] += theta[k] * grad[a]
        for j, (item, piece) in enumerate(zip(model.items, pieces)):
            seen, zeta = seen_of[:, j], theta[at[f"zeta_{item.name}"]]
            if item.values is None:
                k = at[f"sigma2_{item.name}"]
                by_mean = weighted(piece[0])
                by_mean *= seen[:, None] / natural[k]
                s[:, k] = np.where(seen, -0.5 * w.sum(axis=1) + 0.5 * total(by_mean, piece[0]), 0.0)
            else:
                f_low, f_high, code = weighted(piece[0]), weighted(piece[1]), piece[2]
                low, high = np.where(seen, f_low.sum(axis=1), 0.0), np.where(seen, f_high.sum(axis=1), 0.0)
                # cut c moves the upper end of category c and the lower end of the next; a gap moves all cuts above it
                ks = [at[c] for c in item.cuts]
                moves = np.zeros((len(ks) + 2, len(ll)))
                moves[code, np.arange(len(ll))] += high
                moves[code - 1, np.arange(len(ll))] -= low  # category 0 has no lower end
                above = np.cumsum(moves[len(ks) - 1::-1], axis=0)[::-1]
                for n, k in enumerate(ks):
                    s[:, k] = above[n] * (math.exp(theta[k]) if n else 1.0)
                by_mean = f_low
                by_mean -= f_high
                by_mean *= seen[:, None]
            s[:, at[f"zeta_{item.name}"]] = total(by_mean, values[item.lv])
            by_mean *= zeta
            d_eta[item.lv] += by_mean
        for lv in reversed(model.order):
            for p in model.graph[lv]:
                k = at[model.name("gamma", p, lv)]
                s[:, k] = total(d_eta[lv], values[p])
                if p in d_eta:
                    d_eta[p] += theta[k] * d_eta[lv]
        self.total[0] += person.sum()
        self.total[1] += len(ll)
        self.total[2:2 + self.k] += s.sum(axis=0)
        self.total[2 + self.k:] += (s.T @ s).ravel()

    def _ordered(self, item: Item, y: np.ndarray, mean: np.ndarray, natural: np.ndarray) -> tuple[np.ndarray, ...]:
        """ln P of the answers y by draw, densities at the lower and the upper end of their categories over P, and the categories."""
        ks = [self.model.at[c] for c in item.cuts]
        taus = np.concatenate(([-FAR], natural[ks], [FAR]))
        code = np.searchsorted(np.array(item.values), y)

        def end(cut: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Ends of the categories, Phi(-|end|) and exp(-end^2 / 2), 0 for the outer ends if they are far off everywhere."""
            x = taus[cut][:, None] - mean
            if own.all() or not np.abs(mean).max() < ENDS:
                tail, density = tail_and_exp(x)
            else:
                tail, density = np.zeros(x.shape), np.zeros(x.shape)
                tail[own], density[own] = tail_and_exp(x[own])
            density[~own] = 0.0
            return x, tail, density

        low, low_tail, low_density = end(code, code > 0)
        high, high_tail, high_density = end(code + 1, code < len(ks))
        p = interval_of_tails(low, low_tail, high, high_tail)
        np.clip(p, PROB_FLOOR, 1.0, out=p)
        for density in (low_density, high_density):
            density /= SQRT_2PI
            density /= p
        return np.log(p), low_density, high_density, code


def _slices(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[tuple]:
    width, a = len(model.items) + len(model.covars), len(model.attrs)
    size = max(1, SLICE // model.n_draws)
    for whole in _unpacked(batches):
        for batch in (whole.slice(i, size) for i in range(0, len(whole), size)):
            kind = batch.column("kind").to_numpy()
            flat = batch.column("x").flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            sizes = np.where(kind == 0, width, a)
            ends = np.cumsum(sizes)
            of_person = np.repeat(kind == 0, sizes)
            yield (batch.column("idx").to_numpy(), kind, batch.column("sid").to_numpy(), flat[of_person].reshape(-1, width) if width else np.empty(((kind == 0).sum(), 0)),
                   flat[~of_person].reshape(-1, a) if len(ends) else np.empty((0, a)))


def _fused(model: Model, points: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        parts = [Kernel(model, p) for p in points]
        for piece in _slices(batches, model):
            for kernel in parts:
                kernel.feed(*piece)
        for kernel in parts:
            kernel.finish()
        yield np.concatenate([kernel.total for kernel in parts])
    return run


def _partials(model: Model, points: list[np.ndarray]):
    """Per individual and salt the sums per draw, for individuals that are spread."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Kernel(model, p, partial=True) for p in points]

        def ready():
            for n, kernel in enumerate(parts):
                for idx, x, ll, g in kernel.out:
                    yield pa.RecordBatch.from_pydict({"point": pa.array([n] * len(idx), pa.int32()), "idx": idx, "x": list(x), "sums": list(np.concatenate([ll[None], g]).transpose(1, 0, 2).reshape(len(idx), -1))})
                kernel.out.clear()
        for piece in _slices(batches, model):
            for kernel in parts:
                kernel.feed(*piece)
            yield from ready()
        for kernel in parts:
            kernel.finish()
        yield from ready()
    return run


def _merged(model: Model, points: list[np.ndarray]):
    """Partial sums sorted by (point, idx): added per individual, then scored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        parts = [Kernel(model, p) for p in points]
        held: tuple | None = None

        def score(point, idx, x, sums):
            who = People(model, points[point], np.array([idx]), x[None])
            sums = sums.reshape(1 + len(model.attrs), 1, model.n_draws)
            parts[point].scores(who.answers, who.values, sums[0], list(sums[1:]))
        for batch in batches:
            for point, idx, x, sums in zip(*[batch.column(c).to_pylist() for c in ("point", "idx", "x", "sums")]):
                values = np.array(sums)
                if held and held[:2] == (point, idx):
                    held = (*held[:3], held[3] + values)
                else:
                    if held:
                        score(*held)
                    held = point, idx, np.array([float("nan") if v is None else v for v in x], dtype=float), values
        if held:
            score(*held)
        yield np.concatenate([kernel.total for kernel in parts])
    return run


def evaluate(rows: DataFrame, model: Model, points: list[np.ndarray], split: bool) -> list[tuple[float, int, np.ndarray, np.ndarray]]:
    """(log-likelihood, individuals, gradient, outer products of the scores) at every point, from one pass over the rows."""
    k = len(model.params)
    size = 2 + k + k * k
    if split:
        partial = rows.mapInArrow(_partials(model, points), "point int, idx bigint, x array<double>, sums array<double>")
        total = blocks.vector_sum(partial.repartition("idx").sortWithinPartitions("point", "idx"), size * len(points), _merged(model, points))
    else:
        total = blocks.vector_sum(rows, size * len(points), _fused(model, points))
    return [(float(t[0]), int(t[1]), t[2:2 + k], t[2 + k:].reshape(k, k)) for t in total.reshape(len(points), size)]
