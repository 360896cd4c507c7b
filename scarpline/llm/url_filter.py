"""URL filtering by rules, and by trust and distrust that spread over the graph of links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline.llm.common import discard, shuffles_released, stored

#: Fixed values: (host, path, verdict) of the rules in use.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: SETTLED is a share of a host's own score, so hosts far from every seed count like others; ROUNDS only ends what does not settle.
DAMPING, ROUNDS, SETTLED, THRESHOLD = 0.85, 200, 1e-3, 0.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rules = Sequence[tuple[str, str, str]]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules = RULES) -> Column:
    """The longest rule that fits as a struct (rule, verdict), or null. A rule fits its host and all subdomains."""
    fits = lambda h, p: ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
    cases = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame) -> DataFrame:
    """Rows (src, dst, n): absolute links of pages (host, html) between different hosts, counted."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)\shref\s*=\s*["']?([a-z][a-z0-9+.-]*:)?//([^"'\s>/?#]+)"""), F.lit(2))
    return pages.select(F.col("host").alias("src"), F.explode(found).alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter("src <> dst AND src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread_trust(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """Rows (host, trust, distrust): personalised PageRank from seeds (host, good, bad: shares from 0 to 1).

    Trust follows links (src, dst, n) forwards, distrust backwards, each split by the number of links; a round is
    two joins and a sum pre-aggregated by host. It ends once no host's scores move by more than the share `settled` of
    their sum, which a host reached for the first time always does; RuntimeError if that takes more than `rounds`.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("in"))
    edges = stored(links.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("forth"), (F.col("n") / F.col("in")).alias("back")))
    seeds = stored(seeds.groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad")))
    now = stored(seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust")))
    for _ in range(rounds):
        forth = edges.join(now, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("trust"), F.lit(0.0).alias("distrust"))
        back = edges.join(now, F.col("dst") == F.col("host")).select(F.col("src").alias("host"), F.lit(0.0).alias("trust"), (F.col("distrust") * F.col("back")).alias("distrust"))
        own = seeds.select("host", (F.col("good") * ((1 - damping) / damping)).alias("trust"), (F.col("bad") * ((1 - damping) / damping)).alias("distrust"))
        new = forth.union(back).union(own).groupBy("host").agg((F.sum("trust") * damping).alias("trust"), (F.sum("distrust") * damping).alias("distrust"))
        new = stored(new)
        was = now.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        change = F.abs(F.col("trust") - F.coalesce("t", F.lit(0.0))) + F.abs(F.col("distrust") - F.coalesce("d", F.lit(0.0)))
        # every host of a round is in the next: seeds stay, and so do those with a link
        with shuffles_released(new.sparkSession):
            moved = new.join(was, "host", "left").agg(F.max(change / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0)))).first()[0]
        old, now = now, new
        discard(old)
        if (moved or 0.0) <= settled:
            discard(edges, seeds)
            return now
    raise RuntimeError(f"trust and distrust did not settle in {rounds} rounds")


def judge_urls(pages: DataFrame, rules: Rules = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, trust, distrust.

    The longest fitting rule decides. Other pages go by their host: block if its distrust exceeds its trust by more
    than threshold, else allow. A host is seeded with the shares of its pages that rules allow and block. A null url, or one
    without ://, has empty host and path and is allowed unless a rule says otherwise; a null html has no links.
    Repeated rows give repeated rows, other columns are ignored, an empty table gives an empty one.
    """
    own = stored(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)))
    share = lambda v: F.avg(F.when(F.col("fit.verdict") == v, 1.0).otherwise(0.0))
    seeds = own.groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    links = host_links(pages.select(host_of(F.col("url")).alias("host"), "html"))
    scores = spread_trust(seeds, links)
    joined = own.join(scores.withColumnRenamed("host", "of"), F.col("host") == F.col("of"), "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(distrust - trust > threshold, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.round(trust, 9).alias("trust"), F.round(distrust, 9).alias("distrust"))


def op6_rows(pages: DataFrame) -> DataFrame:
    return judge_urls(pages)
