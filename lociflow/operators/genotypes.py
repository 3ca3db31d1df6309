"""From likelihoods to genotypes, dosages, marker statistics and association."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genetics as G
from ..functions import stats as S


def posteriors(phreds: DataFrame) -> DataFrame:
    """Hardy-Weinberg prior of the site's smoothed allele counts times likelihood, normalised."""
    freq = phreds.groupBy("site").agg(((F.sum("n_ref") + 0.5) / (F.sum("n_ref") + F.sum("n_alt") + 1.0)).alias("rf"))
    rows = phreds.join(freq, "site")
    raw = [p * G.phred_prob(F.col(f"pl{i}")) for i, p in enumerate(G.hardy_weinberg(F.col("rf")))]
    rows = rows.withColumns({f"w{i}": w for i, w in enumerate(raw)})
    total = F.col("w0") + F.col("w1") + F.col("w2")
    return rows.withColumns({f"p{i}": F.col(f"w{i}") / total for i in range(3)}).select("sample_id", "site", "n_ref", "n_alt", "p0", "p1", "p2")


def best(p0="p0", p1="p1", p2="p2"):
    """The likeliest genotype; ties to 0, then 1."""
    a, b, c = map(F.col, (p0, p1, p2))
    return F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)


def marker_info(post: DataFrame) -> DataFrame:
    """freq of the reference allele, mean posterior of the best genotype, and r squared of the dosages."""
    p0, p1 = F.col("p0"), F.col("p1")
    m = post.groupBy("site").agg(F.avg(p0).alias("q0"), F.avg(p1).alias("q1"), F.avg((p0 + p1 / 2) * (p0 + p1 / 2)).alias("qq"), F.avg(F.greatest("p0", "p1", "p2")).alias("avg_post"))
    freq = F.col("q0") + F.col("q1") / 2
    m = m.withColumn("freq", freq).withColumns({"v1": F.greatest(F.col("q0") + F.col("q1") / 4 - F.col("freq") * F.col("freq"), F.lit(0.0)), "v2": F.greatest(F.col("qq") - F.col("freq") * F.col("freq"), F.lit(0.0))})
    return m.select("site", "freq", F.least("freq", 1 - F.col("freq")).alias("maf"), "avg_post", (F.col("v2") / (F.col("v1") + 1e-30)).alias("rsq"))


def draw_dosages(drawn: DataFrame, sites: int, *keys: str) -> DataFrame:
    """(keys, sample_id, site, n, p0, p1, p2, dosage, best, quality) of drawn haplotypes (keys, sample_id, code1, code2): how
    many draws there are, the shares of 0, 1 and 2 alternative alleles among them, the mean dose, the commonest genotype
    (ties to 0, then 1) and its share. A sample's draws are added up by site within one row; sites are rows only behind
    that."""
    bit = lambda c, s: F.sum(F.call_function("shiftright", c, F.lit(s)).bitwiseAND(F.lit(1)))
    one, two = F.col("code1").bitwiseXOR(F.col("code2")), F.col("code1").bitwiseAND(F.col("code2"))
    sums = [x.alias(f"{n}{s}") for s in range(sites) for n, x in (("one", bit(one, s)), ("two", bit(two, s)))]
    each = drawn.groupBy(*keys, "sample_id").agg(F.count(F.lit(1)).alias("n"), F.count(one).alias("known"), *sums)
    rows = each.select(*keys, "sample_id", "n", "known", F.inline(F.array(*[F.struct(F.lit(s).alias("site"), F.col(f"one{s}").alias("one"), F.col(f"two{s}").alias("two")) for s in range(sites)])))
    share = lambda c: F.when(F.col("known") > 0, c / F.col("known"))
    shares = (share(F.col("known") - F.col("one") - F.col("two")), share(F.col("one")), share(F.col("two")))
    out = rows.select(*keys, "sample_id", "site", "n", *[p.alias(f"p{k}") for k, p in enumerate(shares)])
    return out.select("*", (F.col("p1") + 2 * F.col("p2")).alias("dosage"), best().alias("best"), F.greatest("p0", "p1", "p2").alias("quality"))


def welch(post: DataFrame, status: DataFrame) -> DataFrame:
    """Case-control t of the reference dosage by site (1: controls, 2: cases), Satterthwaite's degrees of freedom and
    the two-sided p-value; sites with a group of one or none are left out. Where neither group varies, the guard of
    1e-10 under the root gives t, and df and p are null; so is p below one degree of freedom."""
    return welch_of(post.withColumn("x", 2 * F.col("p0") + F.col("p1")), status, "site")


def welch_of(rows: DataFrame, status: DataFrame, *keys: str) -> DataFrame:
    """welch() of any values (keys, sample_id, x), by keys."""
    dose = rows.join(status, "sample_id")
    side = lambda k, f: f(F.when(F.col("status") == k, F.col("x")))
    g = dose.groupBy(*keys).agg(*[side(k, f).alias(f"{n}{k}") for k in (1, 2) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]).where("n1 > 1 AND n2 > 1")
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    g = g.withColumns({"a": a, "b": b})
    df = (F.col("a") + F.col("b")) ** 2 / (F.col("a") * F.col("a") / (F.col("n1") - 1) + F.col("b") * F.col("b") / (F.col("n2") - 1))
    g = g.withColumns({"t": (F.col("m2") - F.col("m1")) / F.sqrt(F.col("a") + F.col("b") + 1e-10), "df": F.when(F.col("a") + F.col("b") > 1e-15, df)})
    return g.select(*keys, "n1", "n2", "t", "df", F.when(F.col("df") >= 1, S.t_tail(F.col("t"), F.col("df"))).alias("p"))


def one_sided(t: str = "t", p: str = "p") -> Column:
    """The p-value of a t that is asked to be above 0, from its two-sided one."""
    return F.when(F.col(t) >= 0, F.col(p) / 2).otherwise(1 - F.col(p) / 2)


def chi_square(reads: DataFrame, status: DataFrame) -> DataFrame:
    """2 x 2 chi-square of allele counts by status; a warning above 15.13."""
    count = lambda k, c: F.sum(F.when(F.col("status") == k, F.col(c)).otherwise(0))
    g = reads.join(status, "sample_id").groupBy("site").agg(count(1, "n_ref").alias("a"), count(1, "n_alt").alias("b"), count(2, "n_ref").alias("c"), count(2, "n_alt").alias("d"))
    a, b, c, d = map(F.col, "abcd")
    g = g.where((a + b > 0) & (c + d > 0) & (a + c > 0) & (b + d > 0))
    x = (a * d - b * c).cast("double")
    chi = (a + b + c + d) * x * x / ((a + b) * (c + d) * (a + c) * (b + d))
    g = g.select("site", "a", "b", "c", "d", chi.alias("chi2"))
    return g.withColumns({"p": S.chi_square_tail(F.col("chi2"), F.lit(1.0)), "warn": F.col("chi2") > 15.13})


def pooled_error(reads: DataFrame) -> DataFrame:
    """Error rate by site from reads that disagree with the majority; sites of at most 2 such reads share one rate.
    The pool is a sum over a grouping, joined as one row. Without any read the rate is null."""
    site = reads.groupBy("site").agg(F.sum(F.least("n_ref", "n_alt")).alias("mm"), F.sum(F.col("n_ref") + F.col("n_alt")).alias("n"))
    pool = site.where("mm <= 2").agg(F.sum("mm").alias("pm"), F.sum("n").alias("pn"))
    return site.join(F.broadcast(pool)).select("site", "mm", "n", F.when(F.col("mm") <= 2, F.col("pm") / F.nullif("pn", F.lit(0))).otherwise(F.col("mm") / F.nullif("n", F.lit(0))).alias("error"))


def votes(draws: DataFrame, *keys: str) -> DataFrame:
    """The genotype code that most draws have, ties to the lowest."""
    counts = draws.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("code")).alias("m"))).alias("w"), F.sum("n").alias("draws")).select(*keys, (-F.col("w.m")).alias("code"), F.col("w.n").alias("votes"), "draws")


def ks_distance(rows: DataFrame, key: str, group: str, value: str, exact_below: int = 10_000) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of value between the two groups (0 and 1) of each key, and the bound
    1.44 * 1.22 * sqrt(1 / n + 1 / m). Ties are added up first, so that a key costs one running sum over its values.
    groups holds, where the product of sizes is below exact_below and values are equal, how many are, in their order."""
    at = rows.groupBy(key, value).agg(F.sum(F.when(F.col(group) == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(group) == 1, 1).otherwise(0)).alias("b"))
    whole, so_far = Window.partitionBy(key), Window.partitionBy(key).orderBy(value)
    at = at.withColumns({"n": F.sum("a").over(whole), "m": F.sum("b").over(whole), "fa": F.sum("a").over(so_far), "fb": F.sum("b").over(so_far)}).where("n > 0 AND m > 0")
    gap = F.abs(F.col("fa") / F.col("n") - F.col("fb") / F.col("m"))
    tied = F.when(F.col("n") * F.col("m") < exact_below, F.struct(value, (F.col("a") + F.col("b")).alias("c")))
    out = at.groupBy(key).agg(F.max(gap).alias("d"), F.first("n").alias("n"), F.first("m").alias("m"), F.transform(F.array_sort(F.collect_list(tied)), lambda x: x["c"]).alias("groups"))
    out = out.withColumn("groups", F.when(F.exists("groups", lambda c: c > 1), F.col("groups")))
    return out.withColumn("bound", 1.44 * 1.22 * F.sqrt(1 / F.col("n") + 1 / F.col("m")))


def ks_test(distances: DataFrame, exact_below: int = 10_000, level: float = 0.1) -> DataFrame:
    """Rows of ks_distance() with p and similar. Below that product of sizes p is exact, ties included, and similar is
    p >= level; from it on p is the limit distribution's, and similar is a distance within the bound."""
    size = F.col("n") * F.col("m")
    small = size < exact_below
    x = F.col("d") * F.sqrt(size / (F.col("n") + F.col("m")))
    only = lambda c: F.when(small, F.col(c))
    exact = S.smirnov_tail(only("n"), only("m"), only("d"), F.col("groups") if "groups" in distances.columns else F.lit(None).cast("array<long>"))
    out = distances.withColumn("p", F.when(small, exact).otherwise(G.kolmogorov_tail(x))).drop("groups")
    return out.withColumn("similar", F.when(small, F.col("p") >= level).otherwise(F.col("d") <= F.col("bound")))


def group_regression(rows: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """By key, the sums of value and its square in both groups (0 and 1), their correlation with the group, its t and
    two-sided p, and whether p is below 0.05: the point-biserial test, from partial sums that add up over parts."""
    x, y = F.col(group).cast("double"), F.col(value).cast("double")
    g = rows.groupBy(key).agg(F.count(y).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    n, sx, sy, syy, sxy = map(F.col, ("n", "sx", "sy", "syy", "sxy"))
    vx, vy = n * sx - sx * sx, n * syy - sy * sy
    g = g.withColumn("r", F.when((vx > 0) & (vy > 1e-9 * n * syy), (n * sxy - sx * sy) / F.sqrt(vx * vy)))
    t = F.col("r") * F.sqrt(n - 2) / F.sqrt(F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-12)))
    g = g.withColumn("t", F.when(n > 2, t))
    g = g.withColumn("p", S.t_tail(F.col("t"), n - 2))
    return g.select(key, F.col("n").cast("long").alias("n"), "r", "t", "p", (F.col("p") < 0.05).alias("differ"))
