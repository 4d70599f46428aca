"""Empirical-Bayes host reputation.

Labelled page outcomes are counted per host; a host's bad rate is shrunk to that of its registered domain, this to
that of its suffix and this to the overall rate, each through a beta prior whose strength comes from the spread
between the units of that level (method of moments for the beta-binomial). A host is blocked if the posterior's lower
bound of its bad rate is over a threshold. Rules, where one fits, come first.

Only counts are grouped, with partial sums before the shuffle. Pages meet their host's row in an equi-join, of which
Spark splits hot hosts; it broadcasts the host table only if its measured size allows that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import base

#: Fixed values of the query's contract: verdict, host and path of each rule.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: So many rules are one CASE; more of them, or a table of rules, are joined by host.
MOST_RULES = 200
#: The suffixes of two labels that count where no table of suffixes is given; all others have one.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "ne.jp", "com.br", "co.nz", "co.za", "co.in", "com.cn")
Z, THRESHOLD, DEFAULT_RATE, STRENGTHS = 1.645, 0.5, 0.1, (1.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for null or a url without ://."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does. Of equally long ones the first wins."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda x: -len(x[1] + x[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        one = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def above(host: Column) -> Column:
    """The host and all domains above it, longest first."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts: host, distinct. rules: verdict, host, path, and pos, their order. Returns host and rules, those for it in the
    order of precedence (structs: rule, verdict, path); hosts without any are left out. Rules of one host are one array."""
    at = hosts.select("host", F.explode(above(F.col("host"))).alias("of")).join(rules.withColumnRenamed("host", "of"), "of")
    rule = F.concat("of", "path")
    each = F.struct((-F.length(rule)).alias("size"), F.col("pos").alias("pos"), rule.alias("rule"), F.col("verdict").alias("verdict"), F.col("path").alias("path"))
    return at.groupBy("host").agg(F.array_sort(F.collect_set(each)).alias("rules"))


def bare(host: Column) -> Column:
    """The host without its port."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """An address is a domain of its own, under the suffix `ip`."""
    name = bare(host)
    address = name.rlike(r"^([0-9]+\.){3}[0-9]+$|^\[")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(address, "ip").when(long, two).otherwise(F.substring_index(name, ".", -1))
    return suffix, F.when(address, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)


def with_domain(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts (host, distinct, and others) with suffix and domain. suffixes: suffix, such as a public list; the longest that
    ends a host counts, and the last label where none does."""
    suffix, domain = suffix_and_domain(F.col("host"))
    if suffixes is None:
        return hosts.withColumns({"suffix": suffix, "domain": domain})
    each = hosts.select("host", F.explode(above(bare(F.col("host")))).alias("suffix")).join(suffixes.select("suffix").distinct(), "suffix")
    known = each.groupBy("host").agg(F.max_by("suffix", F.length("suffix")).alias("known"))
    own = F.coalesce(F.when(suffix != "ip", F.col("known")), suffix)
    labels = F.size(F.split(own, r"\."))
    named = F.when(own == "ip", bare(F.col("host"))).otherwise(F.array_join(F.slice(F.split(bare(F.col("host")), r"\."), -F.least(labels + 1, F.size(F.split(bare(F.col("host")), r"\."))), labels + 1), "."))
    return hosts.join(known, "host", "left").withColumns({"suffix": own, "domain": named}).drop("known")


def strength(units: DataFrame, name: str) -> DataFrame:
    """One row: the prior's strength for a level. units: n, k, and parent, the parent's rate."""
    m = F.col("parent") * (1 - F.col("parent"))
    sums = units.where("n > 0").agg(
        F.count("*").alias("c"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("parent")) * (F.col("k") / F.col("n") - F.col("parent"))).alias("s"), F.avg(m).alias("m"),
    )
    free = F.col("n") - F.col("nn") / F.col("n") - (F.col("c") - 1)
    rho = F.when((free > 0) & (F.col("m") > 0), (F.col("s") - (F.col("c") - 1) * F.col("m")) / (free * F.col("m")))
    low, high = STRENGTHS
    return sums.select(F.coalesce(F.when(rho > 0, F.greatest(F.lit(low), F.least(F.lit(high), (1 - rho) / rho))), F.lit(high)).alias(name))


def reputation(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts: host, n (labelled pages), k (bad ones), a row for each host; suffixes as in with_domain. Returns host, rate
    (posterior mean of the bad rate) and bound (its lower bound)."""
    hosts = with_domain(hosts.select("host", "n", "k"), suffixes)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # One row each: broadcast by size.
    overall = ends.agg(F.coalesce(F.when(F.sum("n") > 0, F.sum("k") / F.sum("n")), F.lit(DEFAULT_RATE)).alias("parent"))

    def shrunk(units: DataFrame, name: str) -> DataFrame:
        return units.join(F.broadcast(strength(units, "strength"))).withColumn(name, (F.col("k") + F.col("strength") * F.col("parent")) / (F.col("n") + F.col("strength")))

    by_suffix = shrunk(ends.join(F.broadcast(overall)), "rate").select("suffix", F.col("rate").alias("parent"))
    by_domain = shrunk(domains.join(by_suffix, "suffix"), "rate").select("suffix", "domain", F.col("rate").alias("parent"))
    at = shrunk(hosts.join(by_domain, ["suffix", "domain"]), "rate")
    size = F.col("n") + F.col("strength")
    return at.select("host", "rate", (F.col("rate") - Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (size + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, threshold: float = THRESHOLD, suffixes: DataFrame | None = None) -> DataFrame:
    """pages: page_id, url, and a nullable key of its outcome; outcomes: key, bad (0 or 1). rules: (verdict, host, path) as
    a list, or a table with these columns and pos, their order; suffixes as in with_domain.

    Returns page_id, host, path, rule, verdict, reputation (posterior mean of the host's bad rate). Every row of pages
    gives a row; rows with a null url have an empty host, which is a host as any other. Several outcomes of a key
    count once, as bad if one of them is; null keys and outcomes don't count."""
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("key").alias("key"))
    labelled = outcomes.where("key is not null and bad is not null").groupBy("key").agg(F.max("bad").cast("long").alias("bad"))
    counts = p.where("key is not null").join(labelled, "key").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    hosts = p.groupBy("host").agg(F.lit(0).alias("_")).join(counts, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    hosts = base.written(hosts, base.scratch(pages.sparkSession) + "/hosts")  # used for each level
    known = reputation(hosts, suffixes)
    if isinstance(rules, list) and len(rules) <= MOST_RULES:
        best = fitting_rule(F.col("host"), F.col("path"), rules)
    else:
        if isinstance(rules, list):
            rules = pages.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rules)], "verdict string, host string, path string, pos long")
        known = known.join(host_rules(hosts.select("host"), rules), "host", "left")
        best = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    out = p.join(known, "host").withColumn("best", best)
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("bound") > threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.round("rate", 6).alias("reputation"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document whose id its url carries."""
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"/([0-9]{1,15})(?:[./?#]|$)", 1)
    pages = base.table(spark, sf_dir, "pages").select("page_id", "url", F.when(number != "", number.cast("long")).alias("key"))
    outcomes = base.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), (1 - F.col("quality")).alias("bad"))
    return judge(pages, outcomes)


def _shrunk(units: str, parent: str, name: str, keys: str) -> str:
    low, high = STRENGTHS
    return f"""{name}0 as (select {units}.*, {parent} as parent from {units}),
{name}1 as (select count(*) c, sum(n)::double n, sum(n * n)::double nn, sum(n * (k / n - parent) * (k / n - parent)) s, avg(parent * (1 - parent)) m from {name}0 where n > 0),
{name}2 as (select case when n - nn / n - (c - 1) > 0 and m > 0 then (s - (c - 1) * m) / ((n - nn / n - (c - 1)) * m) end rho from {name}1),
{name} as (select {keys}, n + strength as size, (k + strength * parent) / (n + strength) rate from {name}0, (select coalesce(case when rho > 0 then greatest({low}, least({high}, (1 - rho) / rho)) end, {high}) strength from {name}2))"""


def oracle() -> str:
    cases = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda x: -len(x[1] + x[2])))
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    return f"""with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest,
  regexp_extract(coalesce(url, ''), '/([0-9]{{1,15}})(?:[./?#]|$)', 1) num from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path, case when num <> '' then num::bigint end key from u),
known as (select doc_id key, max(1 - quality) bad from labels where doc_id is not null and quality is not null group by 1),
counts as (select host, count(*) n, sum(bad) k from p join known using (key) group by 1),
parts as (select host, regexp_replace(host, ':[0-9]*$', '') as name, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') l from (select distinct host from p)),
hosts as (select a.host, coalesce(n, 0) n, coalesce(k, 0)::double k,
  case when regexp_matches(name, '^([0-9]+\\.){{3}}[0-9]+$|^\\[') then 'ip' when array_to_string(l[-2:], '.') in ({two}) then array_to_string(l[-2:], '.') else l[-1] end suffix,
  case when regexp_matches(name, '^([0-9]+\\.){{3}}[0-9]+$|^\\[') then name when array_to_string(l[-2:], '.') in ({two}) then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end as domain from parts a left join counts b on a.host = b.host),
domains as (select suffix, domain, sum(n) n, sum(k) k from hosts group by all),
suffixes as (select suffix, sum(n) n, sum(k) k from domains group by all),
{_shrunk("suffixes", f"(select coalesce(case when sum(n) > 0 then sum(k) / sum(n) end, {DEFAULT_RATE}) from suffixes)", "a", "suffix")},
{_shrunk("domains", "(select rate from a where a.suffix = domains.suffix)", "b", "suffix, domain")},
{_shrunk("hosts", "(select rate from b where b.suffix = hosts.suffix and b.domain = hosts.domain)", "d", "host")},
j as (select page_id, host, path, rate, size, case {cases} end best from p join d using (host))
select page_id, host, path, substr(best, 7) as rule, coalesce(substr(best, 1, 5), case when rate - {Z} * sqrt(rate * (1 - rate) / (size + 1)) > {THRESHOLD} then 'block' else 'allow' end) as verdict, round(rate, 6) as reputation from j"""
