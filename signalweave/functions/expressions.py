"""Column expressions: paths, evidence tiers, ratings, review schedules, policies.

All of them stay in generated code; none is a user function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- paths -----------------------------------------------------------------


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the last segment, with the dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def zone_dir(path: Column) -> Column:
    """The whole parent folder; empty at the root."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)[^/]*$", 1), "/$", "")


def zone_top(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def zone_two(path: Column, root: str = "(root)") -> Column:
    """The first two folders of a path, or what there is of them."""
    folders = F.slice(F.split(path, "/"), 1, F.least(F.lit(2), F.size(F.split(path, "/")) - 1))
    return F.when(F.size(folders) == 0, F.lit(root)).otherwise(F.array_join(folders, "/"))


def zone_ancestors(path: Column) -> Column:
    """Every proper folder prefix, the shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def in_derived_zone(path: Column, folders: list[str]) -> Column:
    """Whether a folder of the path is one whose contents are made by tools."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in folders]))


def looks_generated(content: Column, limit: int = 200) -> Column:
    """Whether lines that are not blank are longer than ``limit`` characters on average."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")
    total = F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(x))
    return F.coalesce((F.size(lines) > 0) & (total > F.size(lines) * F.lit(limit)), F.lit(False))


# ---- evidence and ratings --------------------------------------------------
#
# A measured habit is a proportion with its uncertainty.  The models are the usual
# ones: Wilson's interval for a proportion, the Beta distribution as what is known
# of it after some evidence, inverse-variance weights to combine two estimates, a
# variance that grows linearly while nothing is seen, as in the Glicko ratings, and
# the power forgetting curve with the stability gain of FSRS.


def wilson_lower(share: Column, total: Column, z: float = 1.64) -> Column:
    """Lower end of Wilson's score interval for a share of ``total``; null without evidence."""
    n = F.when(total > 0, total.cast("double"))
    middle = share + z * z / (2 * n)
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (middle - spread) / (1 + z * z / n)


def _named(lower: Column, middle: Column, law: float, habit: float, guess: float) -> Column:
    return F.when(lower >= law, "law").when(lower >= habit, "habit").when(middle >= guess, "hypothesis")


def tier(prevalence: Column, total: Column, law: float = 0.85, habit: float = 0.6, guess: float = 0.5, z: float = 1.64) -> Column:
    """How firm a measured habit is: by the lower end of its interval, or by itself for a guess; null below."""
    return _named(wilson_lower(prevalence, total, z), prevalence, law, habit, guess)


def fact_key(area: Column, statement: Column) -> Column:
    """Area and what stands before the first em dash of the statement."""
    return F.concat_ws("|", area, F.trim(F.substring_index(statement, "—", 1)))


#: Observations that a claim of a model counts for.
MODEL_EVIDENCE = 4.0


def _evidence(total: Column, modelled: Column, model_evidence: float) -> Column:
    return F.when(modelled, F.lit(float(model_evidence))).otherwise(F.coalesce(total, F.lit(0)).cast("double"))


def init_rating(prevalence: Column, total: Column, modelled: Column, model_evidence: float = MODEL_EVIDENCE) -> Column:
    """Mean of the Beta distribution after the evidence, from a uniform prior: (n p + 1) / (n + 2)."""
    n = _evidence(total, modelled, model_evidence)
    return (n * prevalence + 1) / (n + 2)


def init_deviation(prevalence: Column, total: Column, modelled: Column, model_evidence: float = MODEL_EVIDENCE) -> Column:
    """Standard deviation of the same distribution."""
    n, mean = _evidence(total, modelled, model_evidence), init_rating(prevalence, total, modelled, model_evidence)
    return F.sqrt(mean * (1 - mean) / (n + 3))


def confirm_rating(rating: Column, deviation: Column, seen: Column, seen_deviation: Column) -> Column:
    """Two estimates weighted by the inverse of their variances."""
    weight = F.try_divide(deviation * deviation, deviation * deviation + seen_deviation * seen_deviation)
    return rating + F.coalesce(weight, F.lit(0.5)) * (seen - rating)


def confirm_deviation(deviation: Column, seen_deviation: Column) -> Column:
    """The deviation of that weighted mean."""
    return F.coalesce(F.try_divide(deviation * seen_deviation, F.sqrt(deviation * deviation + seen_deviation * seen_deviation)), F.lit(0.0))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000


def effective_deviation(deviation: Column, idle_days: Column, yearly: float = 0.2) -> Column:
    """The variance grows by ``yearly`` squared in a year without confirmation, up to that of knowing nothing."""
    grown = F.sqrt(deviation * deviation + yearly * yearly / 365 * F.greatest(idle_days, F.lit(0.0)))
    return F.least(grown, F.lit(12**-0.5))


def live_tier(rating: Column, deviation: Column, law: float = 0.85, habit: float = 0.6, guess: float = 0.5, z: float = 1.64) -> Column:
    """The tier that a fact has now: as ``tier``, by ``z`` deviations below its rating."""
    return F.coalesce(_named(rating - z * deviation, rating, law, habit, guess), F.lit("no_consensus"))


def retrievability(stability: Column, idle_days: Column) -> Column:
    """Power forgetting curve: 0.9 after as many days as the stability, which counts as a tenth of a day at least."""
    return F.pow(1 + 19 / 81 * F.greatest(idle_days, F.lit(0.0)) / F.greatest(stability, F.lit(0.1)), F.lit(-0.5))


def confirm_stability(stability: Column, r: Column, difficulty: float = 5.0, gain: float = 1.49, saturation: float = 0.14, lateness: float = 0.94, most: float = 365.0) -> Column:
    """FSRS's gain: a confirmation strengthens more the later it comes, and less what is stable already.

    s (1 + e^gain (11 - difficulty) s^-saturation (e^(lateness (1 - r)) - 1)), with the
    published weights as defaults, ``most`` days at most.
    """
    s = F.greatest(stability, F.lit(0.1))
    more = F.exp(F.lit(gain)) * (11 - difficulty) * F.pow(s, F.lit(-saturation)) * (F.exp(lateness * (1 - r)) - 1)
    return F.least(s * (1 + more), F.lit(most))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# ---- policies --------------------------------------------------------------


def csp_values(policy: Column, directive: Column) -> Column:
    """The sources that a policy (a map) lists for a directive, those of default-src where it has none of its own."""
    return F.coalesce(F.element_at(policy, directive), F.element_at(policy, F.lit("default-src")))


def csp_allows(values: Column, wanted: Column) -> Column:
    """Whether a list of allowed sources covers what is wanted: a host, an address, a scheme or a keyword.

    No list allows everything, and a list with 'none' nothing, whatever else it
    names.  A keyword in quotes, and a scheme that is no address, are covered by
    themselves and by * alone.  The schemes http: and https: cover their own
    addresses, and hosts without a scheme; another scheme what begins with it.  A
    host covers itself whatever scheme, port or path it is listed with, and *.host
    what lies below it.  Nothing is wanted where ``wanted`` is null: null.
    """
    wanted = F.lower(wanted)
    address = F.regexp_replace(wanted, "^([a-z][a-z0-9+.-]*:)?//", "")
    # A name with a dot or a port; keywords are quoted, and schemes have a colon and no port.
    is_host = address.rlike(r"^[a-z0-9_-]+(\.[a-z0-9_-]+)+\.?(:[0-9*]+)?(/.*)?$|^[a-z0-9_-]+:[0-9*]+(/.*)?$")
    host = F.regexp_replace(address, "[:/].*$", "")

    def one(v: Column) -> Column:
        low = F.lower(v)
        named = F.regexp_replace(F.regexp_replace(low, "^([a-z][a-z0-9+.-]*:)?//", ""), "[:/].*$", "")
        web = low.isin("http:", "https:")
        by_scheme = F.when(web, is_host & ((wanted == address) | wanted.startswith(F.concat(low, F.lit("//"))))).otherwise(low.endswith(":") & wanted.startswith(low))
        by_name = is_host & ~low.endswith(":") & ((named == host) | (named.startswith("*.") & host.endswith(named.substr(F.lit(2), F.length(named)))))
        return (v == "*") | (low == wanted) | by_scheme | by_name

    none = F.exists(values, lambda v: F.lower(v) == "'none'")
    return F.when(values.isNull(), F.lit(True)).when(none, F.lit(False)).otherwise(F.exists(values, one))
