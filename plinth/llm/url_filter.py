"""URL filters: rules first, link-graph propagation for the rest.

A rule is written ``host/path``; it fits its host and all subdomains when the
url's path starts with the rule's path, and the longest fitting rule decides.

Urls without a rule are judged by their host. Absolute links in the pages give
weighted host edges. Trust flows along the links from hosts whose pages rules
allow (personalised PageRank, restarting at those hosts in proportion to their
allowed pages); distrust flows against the links from hosts whose pages rules
block, as who links to a blocked host is suspect. A host is blocked when its
distrust exceeds ``threshold`` times its trust.

Edges are counted by (from, to) before anything is joined, so a host with a third
of all pages is one row in each iteration. One iteration is two joins of edges
with scores and one aggregation; scores are written to the shared folder every
``CUT`` iterations, until they change by ``TOLERANCE`` in sum at most, and at
once where there are no edges. ``ITERATIONS`` is where damping has left nothing to move, 0.85**200 < 1e-14.

Defined cases: a url that is null or has no ``://`` has an empty host and path,
fits no rule, is no node of the graph and is allowed; a null html has no
links; links inside one host are no edges; a host with neither trust nor distrust
is allowed; equal rows each count and each come back; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import lower_ascii, materialize, packed, scratch, spread, table

#: (verdict, rule) as the list gives them.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
DAMPING = 0.85
ITERATIONS = 200
TOLERANCE = 1e-13
CUT = 5
#: The pages of one host are dealt to so many tasks when they meet its verdict.
SALTS = 64
THRESHOLD = 1.0
_BLANK = r"\x20\x09-\x0D"
_LINK = rf"""(?i)href[{_BLANK}]*=[{_BLANK}]*["']?[{_BLANK}]*((?:https?:)?//[^"'{_BLANK}>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null and null if none fits."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, _, start = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + start))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: number of links from pages of one host to another."""
    link = F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link")
    full = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return (
        pages.select(url_host(F.col("url")).alias("src"), link)
        .select("src", url_host(full).alias("dst"))
        .filter("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from edges (src, dst, n) and seeds (host, trust, distrust).

    Mass at a host without out-links (for distrust: in-links) ends there.
    """
    with scratch() as kept:
        out = edges.groupBy("src").agg(F.sum("n").alias("out_n"))
        into = edges.groupBy("dst").agg(F.sum("n").alias("in_n"))
        edges = materialize(
            edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out_n")).alias("fwd"), (F.col("n") / F.col("in_n")).alias("rev")),
            "url-edges",
        )
        base = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
        base = scores = materialize(base, "url-seeds")
        zero, done = F.lit(0.0), 0 if not edges.isEmpty() else iterations
        while done < iterations:
            before = scores
            for _ in range(min(CUT, iterations - done)):
                along = edges.join(scores, edges["src"] == scores["host"]).select(F.col("dst").alias("host"), (F.col("fwd") * F.col("trust") * damping).alias("trust"), zero.alias("distrust"))
                back = edges.join(scores, edges["dst"] == scores["host"]).select(F.col("src").alias("host"), zero.alias("trust"), (F.col("rev") * F.col("distrust") * damping).alias("distrust"))
                scores = base.unionByName(along).unionByName(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
                done += 1
            scores = materialize(scores, "url-scores")
            if _moved(before, scores) <= tolerance:
                break
        kept.append(scores)
    return scores


def _moved(before: DataFrame, after: DataFrame) -> float:
    """Sum of all changes from one table of scores to another."""
    both = before.select("host", -F.col("trust"), -F.col("distrust")).toDF("host", "t", "d").unionByName(after.toDF("host", "t", "d"))
    each = both.groupBy("host").agg((F.abs(F.sum("t")) + F.abs(F.sum("d"))).alias("x"))
    return each.agg(F.sum("x")).first()[0] or 0.0


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of pages, without html, with host, path, rule and verdict."""
    # html is read for its links only and not carried along.
    row, columns = packed(pages, "host", "path", "rule", "verdict", "html")
    rule, said = rule_verdict(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select(row, F.col("url"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
        .withColumn("rule", rule)
        .withColumn("by_rule", said)
    )
    marked = judged.filter("by_rule is not null and host <> ''").groupBy("host").agg(
        F.count_if(F.col("by_rule") == "allow").cast("double").alias("a"), F.count_if(F.col("by_rule") == "block").cast("double").alias("b")
    )
    sums = marked.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb")).first()
    seeds = marked.select("host", (F.col("a") / F.lit(float(sums["sa"] or 1))).alias("trust"), (F.col("b") / F.lit(float(sums["sb"] or 1))).alias("distrust"))
    scores = propagate(host_edges(pages), seeds)
    blocked = scores.filter(F.col("distrust") > F.col("trust") * threshold).select(F.col("host").alias("_host"), F.lit("block").alias("by_host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_of"))
    salted = judged.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    return (
        salted.join(blocked, (F.col("host") == F.col("_host")) & (F.col("_salt") == F.col("_of")), "left")
        .select(*columns, "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))
    )


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same in SQL, the iterations written out one after the other."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = lambda url: f"case when instr(coalesce({url}, ''), '://') > 0 then substr({url}, instr({url}, '://') + 3) else '' end"
    host = lambda url: f"translate(regexp_extract({rest(url)}, '^([^/?#]*)', 1), '{upper}', '{lower}')"
    link = _LINK.replace("'", "''")
    cases: dict[str, list[str]] = {"rule": [], "said": []}
    for said, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        own, _, start = rule.partition("/")
        fits = f"(host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '/{start}')"
        cases["rule"].append(f"when {fits} then '{rule}'")
        cases["said"].append(f"when {fits} then '{said}'")
    steps = []
    for i in range(1, ITERATIONS + 1):
        steps.append(
            f"s{i} as materialized (select host, sum(trust) as trust, sum(distrust) as distrust from (select * from s0 "
            f"union all select dst, fwd * trust * {DAMPING}::double, 0::double from edges join s{i - 1} on src = host "
            f"union all select src, 0::double, rev * distrust * {DAMPING}::double from edges join s{i - 1} on dst = host) group by host)"
        )
    return (
        f"with h as (select page_id, html, {host('url')} as host, regexp_extract({rest('url')}, '^[^/?#]*([^?#]*)', 1) as path from pages), "
        f"r as (select *, case {' '.join(cases['rule'])} end as rule, case {' '.join(cases['said'])} end as said from h), "
        "m as (select host, count(*) filter (where said = 'allow')::double as a, count(*) filter (where said = 'block')::double as b from r where said is not null and host <> '' group by host), "
        "t as (select coalesce(nullif(sum(a), 0), 1) as sa, coalesce(nullif(sum(b), 0), 1) as sb from m), "
        f"s0 as materialized (select host, a / sa * {1 - DAMPING}::double as trust, b / sb * {1 - DAMPING}::double as distrust from m, t), "
        f"l as (select host as src, unnest(regexp_extract_all(html, '{link}', 1)) as link from h), "
        f"e as (select src, {host('full_link')} as dst from (select src, case when starts_with(link, '//') then 'http:' || link else link end as full_link from l)), "
        "c as (select src, dst, count(*) as n from e where src <> '' and dst <> '' and src <> dst group by all), "
        "edges as materialized (select src, dst, n / sum(n) over (partition by src) as fwd, n / sum(n) over (partition by dst) as rev from c), "
        + ", ".join(steps)
        + f" select page_id, r.host, path, rule, coalesce(said, case when distrust > trust * {THRESHOLD}::double then 'block' end, 'allow') as verdict from r left join s{ITERATIONS} s on r.host = s.host"
    )


OP10_SQL = _sql()
