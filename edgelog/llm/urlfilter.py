"""URL filter: host and path rules, and link-graph propagation for everything that no rule fits.

Hosts are linked by the hyperlinks of their pages and to their parent domain (both ways and as often as pages and links
name it, so a host without any absolute link still belongs somewhere).  Every host whose pages the rules allow more often
than they block is a seed of trust, by the surplus' share of its pages; trust follows the edges (personalised PageRank).
Distrust starts likewise where more pages are blocked and follows the edges backwards, to those that link there.  A host
whose distrust exceeds its trust by ``LEAST`` times the mean mass per host is blocked.

A round settles 15 % of the mass that still moves and sends 85 % along the edges, so the moving part falls by at least
15 % a round; rounds go on until it is under 1 / ``MOVING`` of all mass (24 rounds at most), and what moves then counts where it is.
Masses are whole numbers (10**15 in all) and an edge's flow is ``mass * n * 85 div (total * 100)``, so sums don't depend on their order,
hubs of any width pass their mass on (an edge loses less than one unit) and every engine gets the same verdicts.  Repeating
every page changes no flow.  Everything is DataFrame expressions; rules and scores are joined per host, and
the page rows that travel hold an id, a host and a path, never HTML.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; hosts
without any mass are allowed; repeated pages are judged each and count each as evidence; equally long rules: the one
that sorts first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelog.llm.common import stored

MASS = 10 ** 15
SHARE = 10 ** 12
DAMPING = 85  # of 100
MOVING = 40
ROUNDS = 4  # between two looks at the moving mass
BROADCAST_BYTES = 16 << 20
LEAST = (3, 10)  # of the mean mass per host; what a seed of mean size keeps for itself is 0.15 of it
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per host (column ``host``) the rules of it and its parent domains, longest first."""
    named = rules.select(F.col("host").alias("_h"), F.struct(
        (-F.length(F.concat("host", "path"))).alias("order"), F.concat("host", "path").alias("rule"), F.col("path"),
        F.col("verdict")).alias("r"))
    fits = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("_h")).join(named, "_h")
    return fits.groupBy("host").agg(F.array_sort(F.collect_set("r")).alias("rules"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): hyperlinks between different hosts, and each host with its parent domain both ways, as often as
    pages and links name the host or one below it."""
    links = pages.where("host != ''").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    names = (links.select(F.col("dst").alias("host"), "n")
             .union(pages.where("host != ''").groupBy("host").agg(F.count("*").alias("n"))).groupBy("host").agg(F.sum("n").alias("n")))
    chain = (names.select(F.explode(F.filter(_suffixes(F.col("host")), lambda s: F.instr(s, ".") > 0)).alias("src"), "n")
             .groupBy("src").agg(F.sum("n").alias("n")))
    up = chain.select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst"), "n").where(F.instr("dst", ".") > 0)
    both = up.union(up.select("dst", "src", "n"))
    return links.unionByName(both).where("src != dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def _moves(edges: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    total = edges.groupBy(src).agg(F.sum("n").alias("total"))  # a join, since a hub's edges may not fit one task
    return edges.hint("merge").join(total, src).select(F.col(src).alias("a"), F.col(dst).alias("b"), F.lit(kind).alias("k"), "n", "total")


def propagate(edges: DataFrame, seeds: DataFrame, moving: int = MOVING) -> DataFrame:
    """Mass per (host, kind): kind ``t`` follows the edges, kind ``d`` runs against them, from the seeds' mass ``s``, until
    less than 1 / ``moving`` of it still moves.  Each round's moving mass is stored, so a round reads one table of hosts and the
    edges, and what every round settles is summed once at the end.  The moving mass is broadcast where the counted edges and the
    longest host name bound it to 16 MB; else both sides are merged (files say little about their size in memory)."""
    moves = stored(_moves(edges, "src", "dst", "t").unionByName(_moves(edges, "dst", "src", "d")), "moves")
    fronts = [stored(seeds.select("host", "kind", F.col("s").alias("m")), "mass")]
    size = (moves.select("b").unionByName(fronts[0].select(F.col("host").alias("b")))
            .agg(F.count("*").alias("n"), F.max(F.octet_length("b")).alias("longest")).first())
    small = size.n * ((size.longest or 0) + 64) <= BROADCAST_BYTES

    def in_motion() -> int:
        return fronts[-1].agg(F.sum("m")).first()[0] or 0

    start = left = in_motion()
    while left and left * moving >= start:
        for _ in range(ROUNDS):
            moving_mass = fronts[-1].hint("broadcast" if small else "merge")
            flow = moves.join(moving_mass, (F.col("host") == F.col("a")) & (F.col("kind") == F.col("k"))).select(
                F.col("b").alias("host"), "kind", F.expr(f"cast(m as decimal(20, 0)) * n * {DAMPING} div (total * 100)").alias("m"))
            fronts.append(stored(flow.groupBy("host", "kind").agg(F.sum("m").alias("m")), "mass"))
        left = in_motion()
    settled = fronts[-1]
    for front in fronts[:-1]:
        settled = settled.unionByName(front.withColumn("m", F.expr(f"m * {100 - DAMPING} div 100")))
    return settled.groupBy("host", "kind").agg(F.sum("m").alias("m"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust."""
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    slim = stored(named.select("page_id", "host", "path"), "pages")
    edges = stored(host_edges(named), "edges")

    hosts = slim.where("host != ''").groupBy("host").agg(F.count("*").alias("n"))
    ruled = stored(hosts.join(rules_by_host(hosts.select("host"), rules), "host", "left"), "hosts")
    first = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    with_rule = slim.join(ruled.select("host", "rules"), "host", "left").withColumn("r", F.try_element_at(first, F.lit(1)))
    evidence = (with_rule.where("r is not null").groupBy("host").agg(
        F.sum(F.when(F.col("r.verdict") == "allow", 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("r.verdict") == "block", 1).otherwise(0)).alias("bad"))
        .join(ruled.select("host", "n"), "host"))
    shares = stored(evidence.where("good != bad").select(
        "host", F.when(F.col("good") > F.col("bad"), "t").otherwise("d").alias("kind"),
        F.expr(f"cast(cast(abs(good - bad) as decimal(20, 0)) * {SHARE} div n as decimal(20, 0))").alias("w")), "seeds")
    total = shares.groupBy("kind").agg(F.sum("w").alias("of"))  # two rows
    seeds = shares.join(F.broadcast(total), "kind").select("host", "kind", F.expr(f"w * {MASS} div of").alias("s"))
    mass = propagate(edges, seeds)
    score = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "t", F.col("m")).otherwise(0)).alias("trust"),
                                     F.sum(F.when(F.col("kind") == "d", F.col("m")).otherwise(0)).alias("distrust"))
    n = max(ruled.count(), 1)
    least = MASS * LEAST[0] // (LEAST[1] * n)
    table = ruled.select("host", "rules").join(score, "host", "left")
    joined = slim.join(table, "host", "left").withColumn("r", F.try_element_at(first, F.lit(1)))
    trust, distrust = (F.coalesce(c, F.lit(0)).cast("long") for c in ("trust", "distrust"))
    return joined.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(
        F.col("r.verdict"), F.when(distrust - trust > F.lit(least), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"))
