"""Score-based kernels at given parameters.

Choice data enter as differences to the chosen alternative (``relative_design``): with d = x - x_chosen,
P(chosen) = 1 / sum_j exp(beta d_j). The chosen row adds exp(0) = 1, so the sum never underflows, and a set needs
nothing but partially combined sums: no window, no join, no set is ever gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import has_hot_group, numbered, with_group_values
from ..functions.normal import norm_cdf, norm_pdf, with_normals
from ..functions.scalars import PROB_FLOOR, add, clip, clip_prob, hash_unit
from ..functions.vector import digit_maps, digits_for
from ..session import stored
from .blocks import gram_table

FEW = 8  # parameters up to which products are single generated sums
OCTAVE = 256.0  # width of the exponent ranges whose sums are kept apart; any width that exp() and its products can hold


def primes(n: int) -> list[int]:
    """The first ``n`` primes, one base per draw dimension."""
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found if p * p <= k):
            found.append(k)
        k += 1
    return found


def relative_design(df: DataFrame, keys: list[str], attrs: list[str], chosen: str, keep: list[str] = (),
                    split: bool | None = None) -> DataFrame:
    """Rows (keys, keep, d_<attr>): attributes minus those of the chosen row. Missing attributes (opt-out) count
    as 0. Sets without a chosen row carry no information on the parameters and drop out."""
    x = {a: F.coalesce(F.col(a).cast("double"), F.lit(0.0)) for a in attrs}
    base = df.select(*dict.fromkeys([*keys, *keep]), chosen, *[v.alias(a) for a, v in x.items()])
    picked = with_group_values(base, keys, {f"__c_{a}": F.max(F.when(F.col(chosen) == 1, F.col(a))) for a in attrs}, split)
    return (picked.filter(F.col(f"__c_{attrs[0]}").isNotNull())
            .select(*dict.fromkeys([*keys, *keep]), *[(F.col(a) - F.col(f"__c_{a}")).alias(f"d_{a}") for a in attrs]))


def exp_sums(rows: DataFrame, keys: list[str], v: Column, sums: dict[str, Column], carry: list[Column] = ()) -> DataFrame:
    """Per ``keys``: for each of ``sums`` the sum of exp(v - shift) * value, and the ``__shift`` near the largest v.

    Nothing overflows and no exponent is capped. Rows are summed by ranges of v first (partially combined); the ranges of
    a key, nearly always one, are then put on the scale of the highest. Rows with a NULL v count as none.
    """
    level = F.floor(v / OCTAVE)
    parts = (rows.withColumn("__level", level).withColumn("__e", F.exp(v - F.col("__level") * OCTAVE)).groupBy(*keys, "__level")
             .agg(*[F.sum(F.col("__e") * value).alias(name) for name, value in sums.items()], *carry))
    kept = [c for c in parts.columns if c not in (*keys, "__level", *sums)]
    top = F.max("__level").over(Window.partitionBy(*keys))
    scaled = parts.withColumn("__top", top).withColumn("__f", F.exp((F.col("__level") - F.col("__top")) * OCTAVE))
    return scaled.groupBy(*keys).agg((F.max("__top") * OCTAVE).alias("__shift"), *[F.sum(F.col("__f") * F.col(n)).alias(n) for n in sums],
                                     *[F.first(c, True).alias(c) for c in kept])


def _set_ll(s: Column, floor: float = PROB_FLOOR) -> Column:
    """Log-likelihood of a set whose exponentials, shifted by ``__shift``, sum to ``s``."""
    return F.greatest(F.lit(math.log(floor)), F.least(F.lit(math.log1p(-floor)), -(F.log(s) + F.col("__shift"))))


def set_scores(rel: DataFrame, keys: list[str], beta: dict[str, float], by: list[str] = (), hessian: bool = False) -> DataFrame:
    """Per choice set: ll, gradient g_<attr> and, if asked, the second derivatives h_<a>_<b> (upper triangle)."""
    attrs = list(beta)
    v = add([F.lit(float(b)) * F.col(f"d_{a}") for a, b in beta.items()])
    pairs = [(a, b) for i, a in enumerate(attrs) for b in attrs[i:]] if hessian else []
    sums = exp_sums(rel, list(dict.fromkeys([*by, *keys])), v, {"__s": F.lit(1.0)} | {f"__t_{a}": F.col(f"d_{a}") for a in attrs}
                    | {f"__q_{a}_{b}": F.col(f"d_{a}") * F.col(f"d_{b}") for a, b in pairs})
    s = F.col("__s")
    g = {a: -F.col(f"__t_{a}") / s for a in attrs}
    return sums.select(*dict.fromkeys([*by, *keys]), _set_ll(s).alias("ll"), *[v.alias(f"g_{a}") for a, v in g.items()],
                       *[(g[a] * g[b] - F.col(f"__q_{a}_{b}") / s).alias(f"h_{a}_{b}") for a, b in pairs])


def mnl_gradient(rel: DataFrame, keys: list[str], beta: dict[str, float]) -> DataFrame:
    """(parameter, gradient) = sum over sets of (y - P) x."""
    from .stats import inline
    one = set_scores(rel, keys, beta).agg(*[F.sum(f"g_{a}").alias(a) for a in beta])
    return inline(one, [], [{"parameter": F.lit(a), "gradient": F.col(a)} for a in beta])


def individual_scores(rel: DataFrame, key: str, set_keys: list[str], beta: dict[str, float]) -> DataFrame:
    """Gradient and log-likelihood per individual."""
    return set_scores(rel, set_keys, beta, [key]).groupBy(key).agg(F.sum("ll").alias("ll"), *[F.sum(f"g_{a}").alias(f"g_{a}") for a in beta])


def probit_scores(df: DataFrame, v: str, chosen: str, attrs: list[str]) -> DataFrame:
    """Adds g_<attr>: row derivatives (y - Phi) phi / (Phi (1 - Phi)) x."""
    p, y = F.col("__p"), F.col(chosen)
    staged = df.withColumn("__p", clip_prob(norm_cdf(F.col(v)))).withColumn("__w", (y - p) * norm_pdf(F.col(v)) / (p * (1 - p)))
    return staged.withColumns({f"g_{a}": F.col("__w") * F.col(a) for a in attrs}).drop("__p", "__w")


def probit_gradient(df: DataFrame, v: str, chosen: str, attrs: list[str]) -> DataFrame:
    from .stats import inline
    one = probit_scores(df, v, chosen, attrs).agg(*[F.sum(f"g_{a}").alias(a) for a in attrs])
    return inline(one, [], [{"parameter": F.lit(a), "gradient": F.col(a)} for a in attrs])


def opg_matrix(scores: DataFrame, columns: list[str], sign: float = 1.0, prefix: str = "g_") -> DataFrame:
    """Sum of outer products of individual scores: (row, col, value), upper triangle with diagonal. Up to ``FEW`` columns are
    generated sums, more are Gram blocks; both give the same sums."""
    from .stats import inline
    names = [c.removeprefix(prefix) for c in columns]
    if len(columns) > FEW:
        return gram_table(scores, columns, names, sign)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = scores.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i, j in pairs])
    return inline(one, [], [{"row": F.lit(names[i]), "col": F.lit(names[j]), "value": F.lit(float(sign)) * F.col(f"p{i}_{j}")} for i, j in pairs])


def hessian_agg(rel: DataFrame, keys: list[str], beta: dict[str, float]) -> DataFrame:
    """Second derivatives of the log-likelihood: (row, col, value), upper triangle with diagonal."""
    from .stats import inline
    attrs = list(beta)
    pairs = [(a, b) for i, a in enumerate(attrs) for b in attrs[i:]]
    one = set_scores(rel, keys, beta, hessian=True).agg(*[F.sum(f"h_{a}_{b}").alias(f"h_{a}_{b}") for a, b in pairs])
    return inline(one, [], [{"row": F.lit(a), "col": F.lit(b), "value": F.col(f"h_{a}_{b}")} for a, b in pairs])


# ---- draws -----------------------------------------------------------------------------------------------

def radical_inverse(index: Column, base: int, largest: int = 2 ** 62, seed: int | None = None) -> Column:
    """Digits of ``index`` (0 to ``largest``) in ``base`` mirrored behind the point, as plain integer arithmetic.

    With a seed each digit d at place j becomes (a_j d + c_j) mod base, a permutation, and the point lies in the middle of its cell.
    """
    maps = digit_maps(base, digits_for(largest, base), seed)
    digit = lambda j: F.call_function("div", index, F.lit(base ** j)) % base
    if seed is None:
        return add([digit(j) / F.lit(float(base ** (j + 1))) for j in range(len(maps))])
    return add([((digit(j) * a + c) % base) / F.lit(float(base ** (j + 1))) for j, (a, c) in enumerate(maps)]) + F.lit(0.5 * float(base) ** -len(maps))


def index_individuals(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Dense index 0, 1, ... of the distinct (numeric) ids."""
    ids = df.select(key).distinct()
    return numbered(ids, [], [key], "__n", split=has_hot_group(df, [])).select(key, (F.col("__n") - 1).alias(name))


def halton_draws(ids: DataFrame, key: str, n_draws: int, dims: int, index: str = "idx", shift_seed: int | None = None,
                 scramble: int | None = None, largest: int | None = None) -> DataFrame:
    """(key, r, z1..zD): point idx * R + r + 1 of the Halton sequence, as normals. Rows are generated where the
    individual is; there is no draw tensor. ``scramble`` seeds a permutation of the digits at every place; ``shift_seed`` adds one
    random shift per dimension (mod 1). ``largest`` bounds the points, so that no digit is computed in vain; None asks the ids,
    and scrambled points depend on it, as leading zeros are permuted too."""
    if largest is None:
        ids = stored(ids.select(key, index), "ids")  # numbered once, for the question and for the draws
        largest = ((ids.agg(F.max(index)).first()[0] or 0) + 1) * n_draws
    rows = ids.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    rows = rows.withColumn("__i", F.col(index) * n_draws + F.col("r") + 1)
    uniforms = {}
    for d, base in enumerate(primes(dims)):
        u = radical_inverse(F.col("__i"), base, largest, scramble)
        if shift_seed is not None:
            u = F.pmod(u + hash_unit(F.lit(shift_seed), F.lit(d)), F.lit(1.0))
        uniforms[f"z{d + 1}"] = clip(u, 1e-12, 1 - 1e-12)
    return with_normals(rows, uniforms).select(key, "r", *uniforms)


def random_draws(ids: DataFrame, key: str, n_draws: int, dims: int, seed: int) -> DataFrame:
    """(key, r, z1..zD): keyed pseudo-random normals."""
    rows = ids.select(key).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    return with_normals(rows, {f"z{d + 1}": hash_unit(F.col(key), F.col("r"), F.lit(d), F.lit(seed)) for d in range(dims)})


# ---- simulated likelihood --------------------------------------------------------------------------------

def draw_choice(rel: DataFrame, coefs: DataFrame, keys: list[str], set_keys: list[str], attrs: list[str], carry: list[str] = (),
                how: str = "inner") -> DataFrame:
    """Choice log-likelihood and its derivatives by the coefficients per (keys, r), with the columns ``carry`` of ``coefs``.

    ``coefs`` holds (keys, r, b_<attr>): the coefficients of individual and draw. The join multiplies the rows of an
    individual by its draws; both sides hash on ``keys``, and so does everything after it. Draws are generated, so the optimizer
    takes them for as small as the ids they come from: the merge hint keeps them from being broadcast. ``how="left"`` keeps
    individuals without choice sets, at a log-likelihood and derivatives of 0.
    """
    v = add([F.col(f"b_{a}") * F.col(f"d_{a}") for a in attrs])
    joined = coefs.select(*keys, "r", *[f"b_{a}" for a in attrs], *carry).hint("merge").join(rel, keys, how)
    taken = [F.first(c).alias(c) for c in carry]
    sets = exp_sums(joined, [*dict.fromkeys([*keys, *set_keys]), "r"], v, {"__s": F.lit(1.0)} | {f"__t_{a}": F.col(f"d_{a}") for a in attrs}, taken)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sets.groupBy(*keys, "r").agg(zero(F.sum(_finite_set_ll(F.col("__s")))).alias("ll"),
                                        *[zero(F.sum(-F.col(f"__t_{a}") / F.col("__s"))).alias(f"g_{a}") for a in attrs], *taken)


def _finite_set_ll(s: Column) -> Column:
    return F.when(s.isNotNull(), _set_ll(s))


def finite_or_floor(ll: Column) -> Column:
    return F.when(ll.isNull() | F.isnan(ll) | (F.abs(ll) == float("inf")), -1e10).otherwise(ll)


def importance_weights(draws: DataFrame, key: str, ll: str = "ll") -> DataFrame:
    """Adds ``w``: softmax of the draw log-likelihoods of each individual (as many rows as draws, a fixed number).

    A draw whose log-likelihood is NULL, NaN or infinite is rejected: its weight is 0. An individual without another draw has
    only weights 0.
    """
    w = Window.partitionBy(key)
    good = F.when(F.col(ll).isNotNull() & ~F.isnan(ll) & (F.abs(ll) < float("inf")), F.col(ll))
    e = F.coalesce(F.exp(F.col("__ll") - F.max("__ll").over(w)), F.lit(0.0))
    scaled = draws.withColumn("__ll", good).withColumn("__e", e).withColumn("__sum", F.sum("__e").over(w))
    return scaled.withColumn("w", F.when(F.col("__sum") > 0, F.col("__e") / F.col("__sum")).otherwise(0.0)).drop("__e", "__ll", "__sum")


def simulated_loglik(draws: DataFrame, key: str, n_draws: int, ll: str = "ll") -> DataFrame:
    """Per individual ln(mean over draws of exp(ll))."""
    top = draws.withColumn("__m", F.max(ll).over(Window.partitionBy(key)))
    out = top.groupBy(key).agg((F.max("__m") + F.log(F.sum(F.exp(F.col(ll) - F.col("__m")))) - math.log(n_draws)).alias("ll"))
    return out.withColumn("ll", finite_or_floor(F.col("ll")))


def posterior_scores(weighted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sum over draws of w * eta."""
    return weighted.groupBy(key).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def cluster_by_individual(rel: DataFrame, key: str, set_keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows placed so that everything of an individual is local; an individual above the hot limit is spread over
    salts of whole choice sets. Returns the rows and the join keys (``key`` or ``key, salt``)."""
    if not has_hot_group(rel, [key]):
        return rel.repartition(key), [key]
    salted = rel.withColumn("salt", F.pmod(F.xxhash64(*set_keys), F.lit(SALTS)).cast("int"))
    return salted.repartition(key, "salt"), [key, "salt"]


SALTS = 64


def spread(per_individual: DataFrame, keys: list[str]) -> DataFrame:
    """Individual-level rows repeated for every salt when the choice rows are salted."""
    return per_individual if "salt" not in keys else per_individual.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
