"""URL filter by empirical-Bayes host reputation, with rules.

Labelled page outcomes (bad or not) are counted by host. A host's rate of bad pages is shrunk
through beta-binomial priors: the host's towards its registered domain's, that towards its
suffix's, that towards the rate of all labelled pages. A unit's prior leaves out the unit's own
pages. How much the units within one parent differ is estimated from the data by the method of
moments: how far their rates spread around that parent's, beyond binomial noise. How strong a prior
is follows from this spread and from how well the parent's own rate is known; pages of alike units
count in full for the parent, those of units that differ count less.

The limit is ``LIFT`` times the rate of all labelled pages. A page is blocked if the lower
``1 - SURE`` quantile of its host's posterior is over the limit; that is, if the incomplete beta
function at the limit is under ``1 - SURE``, which is what is worked out. Hosts without labels go by
their domain. Rules go before reputation. If hosts differ no more than chance would have it, the
priors are strong, and nothing is blocked but by rules.

Only DataFrame operations. Reputation goes by a normalised host (without user, port and closing
periods). A suffix is the last label of a host, or the last two under a country's code if the
last but one is a common second-level label (``SECOND_LEVEL``); a registered domain is the suffix
and a label more; an address of digits is its own domain and suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import salted_join, written

#: (host and path, verdict) of the fixed rules.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: A host is blocked if it is that sure that its rate of bad pages is over LIFT times that of all labelled pages.
SURE = 0.95
LIFT = 1.5
#: Before any outcome is seen, one page in ten is taken to be bad, with the weight of ten pages.
FIRST_BAD, FIRST_PAGES = 1.0, 10.0
#: The spread of a level (its intraclass correlation) before any is seen, with the weight of so many pages; its bounds.
FIRST_SPREAD, SPREAD_PAGES = 1 / 11, 20.0
LEAST_SPREAD, MOST_SPREAD = 1e-4, 0.9
#: Terms of the continued fraction, which are enough up to posteriors of NORMAL pages; those are taken as normal.
TERMS, NORMAL = 200, 20000
#: Second-level labels under which a country's registry sells names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# each of these is tried on a normalised host
_TIDY = (r"^.*@", r":[0-9]*$", r"\.+$")
_ADDRESS = r"^([0-9.]+|\[.*)$"
_COUNTRY = r"(^|\.)(" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2}$"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def key_of(host: Column) -> Column:
    """The host that reputation goes by: without user, port and closing periods."""
    for part in _TIDY:
        host = F.regexp_replace(host, part, "")
    return host


def suffix_of(key: Column) -> Column:
    labels = F.when(key.rlike(_COUNTRY), F.substring_index(key, ".", -2)).otherwise(F.substring_index(key, ".", -1))
    return F.when(key.rlike(_ADDRESS), key).otherwise(labels)


def domain_of(key: Column) -> Column:
    labels = F.when(key.rlike(_COUNTRY), F.substring_index(key, ".", -3)).otherwise(F.substring_index(key, ".", -2))
    return F.when(key.rlike(_ADDRESS), key).otherwise(labels)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. A rule fits its host and all subdomains if the path starts with its path."""
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        best, verdict = F.when(fits, F.lit(rule)).otherwise(best), F.when(fits, F.lit(what)).otherwise(verdict)
    return best, verdict


def _units(rows: DataFrame, by: list[str], unit: str) -> DataFrame:
    """Totals of the units (n labelled pages, k bad ones) of each parent, and what the spread within it is worked out from."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    return rows.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias(unit), F.count_if(n > 0).alias("m"), F.sum(n * n).alias("nn"), F.coalesce(F.sum(F.when(n > 0, k * k / n)), F.lit(0.0)).alias("kk")
    )


def _spread(parents: DataFrame, rate: float) -> float:
    """How much the units within these parents differ (intraclass correlation), by the method of moments over all parents."""
    n, k, m = (F.col(c).cast("double") for c in ("n", "k", "m"))
    noise = k / n * (1 - k / n)
    sums = parents.where("m > 1").agg(F.sum(F.col("kk") - k * k / n - noise * (m - 1)), F.sum(noise * (n - F.col("nn") / n - (m - 1)))).first()
    over, below = (0.0 if x is None else x for x in sums)
    first = rate * (1 - rate) * SPREAD_PAGES
    return min(MOST_SPREAD, max(LEAST_SPREAD, (over + FIRST_SPREAD * first) / (below + first)))


# SQL expressions that Spark and others read alike: of a unit (n pages, k bad ones) and its parent (n_up, k_up, with prior
# mean_up of weight w_up, and share_up of its pages' weight that counts)
_MEAN = "(share_up * (k_up - k) + w_up * mean_up) / (share_up * (n_up - n) + w_up)"


def _weight(spread: str) -> str:
    """Weight of a unit's prior: the parent's rate isn't known exactly, and the unit differs from it."""
    unknown = "1 / (share_up * (n_up - n) + w_up + 1)"
    return f"1 / ({unknown} + {spread} * (1 - {unknown})) - 1"


def _share(spread: str) -> str:
    """How much a page of one of a parent's units counts, as those of the same unit are alike."""
    return f"CASE WHEN n > 0 THEN 1 / (1 + {spread} * (nn / n - 1)) ELSE 1 END"


def _log_gamma(z: str) -> str:
    """Stirling's series for z + 8, stepped down, as an SQL expression that Spark and others read alike."""
    x = f"({z} + 8)"
    down = " * ".join(f"({z} + {i})" for i in range(8))
    return f"(({x} - 0.5) * ln({x}) - {x} + 0.9189385332046727 + 1 / (12 * {x}) - 1 / (360 * {x} * {x} * {x}) - ln({down}))"


def _fraction(a: str, b: str, x: str, fold: str) -> str:
    """The incomplete beta function by its continued fraction, from the last term up; right for x under the mean or little over it."""
    m = "floor(i / 2)"
    odd = f"-({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1))"
    even = f"{m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m}))"
    log = f"{a} * ln({x}) + {b} * ln(1 - {x}) + {_log_gamma(f'({a} + {b})')} - {_log_gamma(a)} - {_log_gamma(b)}"
    return f"(exp({log}) / {a} / {fold.format(step=f'1 + (CASE WHEN i % 2 = 1 THEN {odd} ELSE {even} END) / acc')})"


def _sure(a: str, b: str, x: str, fold: str) -> str:
    """How sure it is that a rate with a beta posterior (a, b) is over x, as an SQL expression."""
    mean, sd = f"{a} / ({a} + {b})", f"sqrt({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1)))"
    other = _fraction(b, a, f"(1 - {x})", fold)
    return f"""CASE WHEN {x} >= 1 THEN 0.0 WHEN {a} + {b} > {NORMAL} THEN CASE WHEN ({mean} - {x}) / {sd} > {_DEVIATIONS} THEN 1.0 ELSE 0.0 END
      WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN 1 - {_fraction(a, b, x, fold)} ELSE {other} END"""


#: Standard deviations of a normal law beyond which it is SURE.
_DEVIATIONS = 1.6448536269514722
_FOLD = f"aggregate(sequence({TERMS}, 1, -1), 1.0D, (acc, i) -> {{step}})"


def reputation(pages: DataFrame, outcomes: DataFrame, lift: float = LIFT) -> DataFrame:
    """(key, sure, n) for every normalised host of ``pages`` (page_id, key): how sure it is that its rate of bad pages is over the limit, and its number of pages.

    ``outcomes`` has (page_id, bad 0/1); a page with several counts as bad if one says so.
    """
    marks = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = written(
        pages.join(marks, "page_id", "left")
        .groupBy("key")
        .agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
        .withColumns({"domain": domain_of(F.col("key")), "suffix": suffix_of(F.col("key"))})
    )
    domains = written(_units(hosts, ["domain", "suffix"], "hosts"))
    suffixes = written(_units(domains, ["suffix"], "domains"))
    every = written(_units(suffixes, [], "suffixes"))
    total = every.select(F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))).first()
    rate = (total[1] + FIRST_BAD) / (total[0] + FIRST_PAGES)
    r_host, r_domain, r_suffix = (repr(_spread(x, rate)) + "D" for x in (domains, suffixes, every))

    def parents(rows: DataFrame, key: str, units: str, own: str, below: str) -> DataFrame:
        """The parents of the next level: their totals without what they inherit, and their prior."""
        picked = rows.selectExpr(key, f"{units} AS n_units", "n AS n_up2", "k AS k_up2", f"{_MEAN} AS mean_up2", f"{_weight(own)} AS w_up2", f"{_share(below)} AS share_up2")
        return written(picked.selectExpr(key, "n_units AS n", *[f"{c}2 AS {c}" for c in ("n_up", "k_up", "mean_up", "w_up", "share_up")]))

    top = {"n_up": total[0], "k_up": total[1], "mean_up": FIRST_BAD / FIRST_PAGES, "w_up": FIRST_PAGES, "share_up": 1.0}
    up = parents(suffixes.withColumns({c: F.lit(v) for c, v in top.items()}), "suffix", "domains", r_suffix, r_domain)
    mid = parents(salted_join(domains, up, "suffix", "domain"), "domain", "hosts", r_domain, r_host)
    low = salted_join(hosts.drop("suffix"), mid, "domain", "key").selectExpr("key", "pages", "n", "k", f"{_MEAN} AS mean", f"{_weight(r_host)} AS w")
    low = low.selectExpr("key", "pages AS n", "k + w * mean AS a", "n - k + w * (1 - mean) AS b")
    return written(low.select("key", F.expr(_sure("a", "b", f"{min(1.0, lift * rate)!r}D", _FOLD)).alias("sure"), "n"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, lift: float = LIFT, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict of each page.

    A url that is null or has no :// has an empty host and path, and goes by the reputation of the empty
    host. Pages with a null page_id have no outcome of their own but are judged; repeated rows are
    kept and count each; without any outcome nothing is blocked but by rules; no rows give no rows.
    Other columns aren't read. The verdict is the rule's if one fits, else block or allow by the posterior
    bound.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("key", key_of(F.col("host")))
    known = reputation(rows.select("page_id", "key"), outcomes, lift)
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    out = salted_join(rows, known, "key", "page_id", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("sure") > SURE, "block").otherwise("allow")).alias("verdict"))


_FITS = " ".join(
    f"WHEN (host = '{r[: r.index('/')]}' OR host LIKE '%.{r[: r.index('/')]}') AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
)
_SAYS = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
_KEY_SQL = "host"
for _part in _TIDY:
    _KEY_SQL = f"regexp_replace({_KEY_SQL}, '{_part}', '')"
_SQL_FOLD = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({TERMS}, 0, -1), lambda i: i::DOUBLE)), lambda acc, i: {{step}})"


def _labels_sql(more: int) -> str:
    return f"""CASE WHEN regexp_matches(key, '{_ADDRESS}') THEN key ELSE array_to_string(string_split(key, '.')[CASE WHEN regexp_matches(key, '{_COUNTRY}') THEN {-2 - more} ELSE {-1 - more} END:], '.') END"""


def _spread_sql(table: str) -> str:
    noise, first = "(k / n * (1 - k / n))", f"(any_value(r) * (1 - any_value(r)) * {SPREAD_PAGES})"
    over, below = f"coalesce(sum(kk - k * k / n - {noise} * (m - 1)) FILTER (m > 1), 0)", f"coalesce(sum({noise} * (n - nn / n - (m - 1))) FILTER (m > 1), 0)"
    return f"""(SELECT least({MOST_SPREAD}::DOUBLE, greatest({LEAST_SPREAD}::DOUBLE, ({over} + {FIRST_SPREAD!r}::DOUBLE * {first}) / ({below} + {first})))
      FROM (SELECT n::DOUBLE AS n, k::DOUBLE AS k, m::DOUBLE AS m, nn, kk FROM {table}) RIGHT JOIN rate ON true)"""


def _parents_sql(key: str, rows: str, own: str, below: str) -> str:
    return f"SELECT {key}, n AS n_up, k AS k_up, {_MEAN} AS mean_up, {_weight(own)} AS w_up, {_share(below)} AS share_up FROM (SELECT * FROM {rows}), spreads"


_UNITS_SQL = "sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, count(*) FILTER (n > 0) AS m, sum(n::DOUBLE * n) AS nn, coalesce(sum(CASE WHEN n > 0 THEN k::DOUBLE * k / n END), 0) AS kk"

#: The same result in SQL, the bound included.
ORACLE_SQL = f"""
WITH rows AS (
  SELECT *, {_KEY_SQL} AS key FROM (SELECT page_id, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages)),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT key, {_labels_sql(1)} AS domain, {_labels_sql(0)} AS suffix, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k
  FROM rows LEFT JOIN marks ON page_id = doc_id GROUP BY key),
domains AS (SELECT domain, suffix, {_UNITS_SQL} FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, {_UNITS_SQL} FROM domains GROUP BY suffix),
total AS (SELECT {_UNITS_SQL} FROM suffixes),
rate AS (SELECT coalesce(n, 0) AS n_all, coalesce(k, 0) AS k_all, (coalesce(k, 0) + {FIRST_BAD}::DOUBLE) / (coalesce(n, 0) + {FIRST_PAGES}::DOUBLE) AS r FROM total),
spreads AS (SELECT {_spread_sql('domains')} AS rh, {_spread_sql('suffixes')} AS rd, {_spread_sql('total')} AS rs),
up AS ({_parents_sql('suffix', f"(SELECT suffixes.*, n_all AS n_up, k_all AS k_up, {FIRST_BAD / FIRST_PAGES}::DOUBLE AS mean_up, {FIRST_PAGES}::DOUBLE AS w_up, 1.0::DOUBLE AS share_up FROM suffixes, rate)", 'rs', 'rd')}),
mid AS ({_parents_sql('domain', 'domains JOIN up USING (suffix)', 'rd', 'rh')}),
post AS (SELECT key, k + w * mean AS a, n - k + w * (1 - mean) AS b, least(1.0::DOUBLE, {LIFT}::DOUBLE * r) AS x
  FROM (SELECT key, n, k, {_MEAN} AS mean, {_weight('rh')} AS w FROM hosts JOIN mid USING (domain), spreads), rate),
known AS (SELECT key, {_sure('a', 'b', 'x', _SQL_FOLD)} AS sure FROM post),
judged AS (SELECT page_id, host, path, CASE {_FITS} END AS rule, sure FROM rows LEFT JOIN known USING (key))
SELECT page_id, host, path, rule, coalesce(CASE rule {_SAYS} END, CASE WHEN sure > {SURE} THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""
