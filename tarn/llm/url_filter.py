"""URL filters: host and path rules first, then the ratio of two character language models.

Both models are variable-order Markov chains over the characters of a URL: the chance of a character
given the last ORDER characters, smoothed by Witten and Bell's rule towards one character less of context,
down to a uniform chance. One model is of accepted URLs, one of rejected URLs. The names of a host and the steps of
what follows it are judged one by one, by the difference of the two log-likelihoods divided by the length and
SHORTEST more, which keeps a few letters from deciding; the lowest of a host and the lowest of a path each meet a
calibrated threshold of their own. So a common ending does not hide a name (the top-level one is not judged), and
the URLs of a host share a verdict unless a path speaks against its own. All of it is DataFrame operations.

Labelled URLs are the given seeds and every URL of the corpus that a rule decides, by its outcome. Nothing is
known of the others: they show what URLs of the corpus look like and are in both models alike, so what only
they have speaks neither way. Each host of the corpus weighs HOST_WEIGHT in all, however many URLs it has, so
no host vouches for itself. Labelled hosts are dealt to FOLDS folds by hash, and each fold is judged by models
fitted without it. A threshold is the one that blocks FALSE_BLOCKS of all accepted ones judged so. The
models that judge the corpus are then fitted on all labelled URLs. Letters are lower-cased and digits stand
for one digit, which bounds the models by the alphabet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

ORDER = 4
#: What stands before a name of a host and before a step of the rest of a URL.
STARTS = {"host": "\x02", "path": "\x03"}
#: Contexts of up to so many rows are broadcast (under 100 MB); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: A URL's smoothing floor: every character has at least one part in so many under the shortest context.
ALPHABET = 256.0

#: Characters of a URL that are cut up at a time.
PIECE = 256
#: What all URLs of a host weigh in the models; a seed URL weighs 1.
HOST_WEIGHT = 0.02

#: Folds of labelled hosts, each kept out once to set the thresholds.
FOLDS = 4
#: Share of the accepted names kept out that each threshold blocks.
FALSE_BLOCKS = {"host": 0.05, "path": 0.01}
#: Added to the length of a name or step.
SHORTEST = 4

#: Parameter: seed URLs of either kind, made of category names and common words of public block lists and
#: directories, in plain forms of a home page.
_REJECTED = "adult sex porn xxx nude hookup camgirls striptease hardcore milf escorts swingers casino poker slots jackpot roulette blackjack gambling betting sportsbook bookmaker lottery bingo viagra cialis steroids online-pharmacy weight-loss payday-loans quick-cash replica-watches get-rich warez cracks keygen serials torrents malware spyware phishing spam clickbait adserver banner-ads popunder adclick".split()
_ACCEPTED = "news library university recipes museum weather school college hospital science history garden music theatre football travel government parliament council encyclopedia dictionary journal research physics biology chemistry astronomy philosophy literature poetry painting architecture engineering software photography cooking hiking railway forest ocean mountain wildlife charity radio magazine publisher market bakery kitchen furniture carpenter plumber electric hotel airport station bridge castle cathedral village county island river valley harbour marine ferry bicycle runner football-club tennis athletics swimming orchestra choir gallery exhibition archive heritage genealogy language translation grammar teacher students kindergarten nursing dental veterinary clinic insurance solicitor accounting economy business industry energy climate agriculture farming fishing gardening flowers butterfly birds weather-report newspaper bulletin community neighbours volunteers foundation trust society association institute laboratory observatory telescope computing network database open-source".split()
_SHAPES = ("https://{}.com", "http://{}.info", "https://the-{}.co", "http://{}online.biz", "/{}/", "/all-{}")  # two are paths
SEEDS = tuple((shape.format(w), label, w) for label, names in enumerate((_REJECTED, _ACCEPTED)) for w in names for shape in _SHAPES)


@dataclass(frozen=True)
class Rule:
    """host and path prefix, e.g. net/ or example.com/de/."""

    text: str
    allow: bool

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.text.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


#: Parameter: the rules in force.
RULES = (Rule("net/", False), Rule("example.net/en/", True), Rule("example.com/de/", False), Rule("org/fr/", True))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Empty for null or without "://". Only A-Z of the host are lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, allow) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        found = F.when(r.fits(host, path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(found)
    return found


def normal(text: Column, part: str) -> Column:
    return F.concat(F.lit(STARTS[part] * ORDER), F.regexp_replace(F.lower(text), r"\p{Nd}", "0"))


def parts(url: Column) -> Column:
    """Array of (part, text): names of the host but the top-level one (unless it has no other), then steps of what follows it. Without "://" all is path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url)
    host = F.when(at > 0, F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)).otherwise(F.lit(""))
    marked = lambda part: lambda t: F.struct(F.lit(part).alias("part"), normal(t, part).alias("text"))
    names = F.split(host, r"\.")
    cut_up = {"host": F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))), "path": F.split(F.substring(rest, F.length(host) + 1, F.length(rest)), "/")}
    return F.concat(*(F.transform(F.filter(x, lambda t: t != ""), marked(p)) for p, x in cut_up.items()))


def grams(urls: DataFrame) -> DataFrame:
    """One row per character with the ORDER characters before it; urls has text, a name or step with its marks. A text is first cut
    into overlapping pieces in one pass, as finding a place in a long text takes a walk to it."""
    pieces = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{ORDER + 1},{PIECE + ORDER}}})).{{1,{PIECE}}}"), F.lit(1))
    cut_up = urls.select(*(c for c in urls.columns if c != "text"), F.explode(pieces).alias("_piece"))
    out = cut_up.select("*", F.explode(F.sequence(F.lit(1), F.length("_piece") - ORDER)).alias("_at"))
    return out.withColumn("gram", F.substring(F.col("_piece"), F.col("_at"), F.lit(ORDER + 1))).drop("_at", "_piece")


def log_ratios(counted: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, gram, ratio = log P(accepted) - log P(rejected) of its last character, for each wanted gram.

    counted: (keys, gram, label, n) for grams of ORDER + 1 characters; there are two models for each value of
    the keys. Each level k looks at the last k characters as context; unseen contexts leave the chance of the
    level below as it is.
    """
    out = wanted.select(*keys, "gram").distinct().withColumns({"p0": F.lit(1 / ALPHABET), "p1": F.lit(1 / ALPHABET)})
    for k in range(ORDER + 1):
        # k + 1 characters, and their first k as the context
        tail = F.substring(F.col("gram"), ORDER + 1 - k, k + 1)
        seen = counted.groupBy(*keys, tail.alias("tail")).agg(*(F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)))
        context = F.substring(F.col("tail"), 1, k) if k else F.lit("")
        around = seen.groupBy(*keys, context.alias("context")).agg(*(F.sum(f"n{c}").alias(f"all{c}") for c in (0, 1)), *(F.count_if(F.col(f"n{c}") > 0).alias(f"kinds{c}") for c in (0, 1)))
        out = out.withColumn("tail", tail).withColumn("context", F.substring(F.col("gram"), ORDER + 1 - k, k) if k else F.lit(""))
        out = out.join(seen, [*keys, "tail"], "left").join(around, [*keys, "context"], "left")
        for c in (0, 1):
            chance = F.try_divide(F.coalesce(F.col(f"n{c}"), F.lit(0)) + F.col(f"kinds{c}") * F.col(f"p{c}"), F.col(f"all{c}") + F.col(f"kinds{c}"))
            out = out.withColumn(f"p{c}", F.coalesce(chance, F.col(f"p{c}")))
        out = cut(out.select(*keys, "gram", "p0", "p1"))
    return out.select(*keys, "gram", (F.ln("p1") - F.ln("p0")).alias("ratio"))


def planted(spark: SparkSession, seeds: tuple[tuple[str, int, str], ...]) -> DataFrame:
    """The seeds as rows (url, label, name); the URLs of one name share a fold."""
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({quoted(u)}, {int(label)}, {quoted(name)})" for u, label, name in seeds)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label, name)") if seeds else spark.sql("SELECT '' url, 0 label, '' name WHERE false")


def fold(name: Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(FOLDS))


def scored(texts: DataFrame, counted: DataFrame, by: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """by, ratio: the log of the two models' chances of each text, divided by its characters and SHORTEST. by is short, as it
    goes with every character; keys of texts name the models that judge it."""
    counted = cut(counted)
    found, on = grams(texts), [*keys, "gram"]
    ratios = log_ratios(counted, found, keys)
    if ratios.count() > BROADCAST_ROWS:
        # The most frequent grams are broadcast; what is left is rare and has no hot key.
        often = cut(found.groupBy(*on).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *on).limit(BROADCAST_ROWS).join(ratios, on).select(*on, "ratio"))
        first = found.join(F.broadcast(often), on, "left")
        rest = first.where("ratio is null").drop("ratio").join(ratios, on)
        joined = first.where("ratio is not null").unionByName(rest)
    else:
        joined = found.join(F.broadcast(ratios), on)
    return cut(joined.groupBy(*by).agg((F.sum("ratio") / (F.count("*") + SHORTEST)).alias("ratio")))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, seeds: tuple[tuple[str, int, str], ...] = SEEDS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule (or null), verdict, host_ratio and path_ratio (lowest log-likelihood difference
    per character of a name or step, 0 without such a part), host_threshold and path_threshold (the same in all rows).

    The verdict is the longest fitting rule's, else "allow" if each part that the URL has is at or above its
    threshold. Without an accepted host a threshold is 0. A null or empty URL has empty host and path and is
    blocked: it names no page. Without "://" the whole URL is judged as a path. Rows repeat if the input's do. An
    empty table gives an empty result; other columns are not read. seeds: (url, label, name), label 1 for accepted.
    """
    texts, counted, low = models(pages, rules, seeds=seeds, url_col=url_col)
    ratios = scored(texts, counted, ("key", "part", "i")).groupBy("key").agg(*(F.min(F.when(F.col("part") == p, F.col("ratio"))).alias(p) for p in STARTS))
    ratios = ratios.withColumnsRenamed({p: f"_{p}" for p in STARTS})
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    out = rows.join(ratios, F.md5("url") == F.col("key"), "left").withColumns({"host": host, "path": path})
    out = out.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    fine = F.coalesce(F.length("url"), F.lit(0)) > 0
    for p in STARTS:
        fine &= F.coalesce(F.col(f"_{p}") >= F.lit(low[p]), F.lit(True))
    allow = F.coalesce(F.col("found.allow"), fine)
    more = [x for p in STARTS for x in (F.coalesce(F.col(f"_{p}"), F.lit(0.0)).alias(f"{p}_ratio"), F.lit(low[p]).alias(f"{p}_threshold"))]
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"), *more)


def models(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, seeds: tuple[tuple[str, int, str], ...] = SEEDS, url_col: str = "url") -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Names and steps of the distinct URLs (key, a digest of the URL, part, i, text), the counts of the final models (gram, label,
    n), and the thresholds by part."""
    host, path = host_and_path(F.col("url"))
    # Equal URLs are judged once; counting them first keeps a hot URL to one row per task in the shuffle.
    urls = pages.select(F.col(url_col).alias("url")).where("url is not null").groupBy("url").agg(F.count("*").alias("n"))
    label = longest_rule(host, path, rules)["allow"].cast("int")
    urls = cut(urls.select(F.md5("url").alias("key"), host.alias("name"), "n", label.alias("label"), parts(F.col("url")).alias("parts")))
    hosts = cut(urls.groupBy("name", "label").agg(F.sum("n").alias("rows")))
    sizes = F.broadcast(hosts) if hosts.count() <= BROADCAST_ROWS else hosts
    same = (F.col("name") == F.col("_name")) & F.col("label").eqNullSafe(F.col("_label"))
    weighed = urls.join(sizes.withColumnsRenamed({"name": "_name", "label": "_label"}), same).withColumn("n", F.col("n") / F.col("rows") * HOST_WEIGHT)
    seeded = planted(pages.sparkSession, seeds).withColumn("parts", parts(F.col("url")))
    every = weighed.select("name", "n", "label", "parts").unionByName(seeded.select("name", F.lit(1.0).alias("n"), "label", "parts"))
    both = F.explode(F.when(F.col("label").isNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array("label")))
    out = F.when(F.col("label").isNotNull(), fold(F.col("name")))
    texts = every.select(out.alias("out"), "n", both.alias("label"), "parts").select("out", "n", "label", F.explode("parts.text").alias("text"))
    # Counted once, by fold; the models without a fold add up the others and what no fold has.
    counts = cut(grams(texts).groupBy("gram", "label", "out").agg(F.sum("n").alias("n")))
    without = F.explode(F.array(*(F.lit(k).cast("long") for k in range(FOLDS)))).alias("m")
    kept = counts.select("gram", "label", "out", "n", without).where(~(F.col("out") == F.col("m")) | F.col("out").isNull()).groupBy("m", "gram", "label").agg(F.sum("n").alias("n"))
    held = urls.where("label = 1").select("name", "parts").unionByName(seeded.where("label = 1").select("name", "parts"))
    held = held.select(F.md5("name").alias("key"), fold(F.col("name")).alias("m"), F.explode("parts").alias("x")).select("key", "m", "x.part", F.xxhash64("x.text").alias("i"), "x.text").distinct()
    judged = scored(held, kept, ("key", "part", "i"), ("m",)).groupBy("key", "part").agg(F.min("ratio").alias("ratio"))
    low = judged.agg(*(F.percentile_approx(F.when(F.col("part") == p, F.col("ratio")), FALSE_BLOCKS[p], 10_000).alias(p) for p in STARTS)).first()
    texts = urls.select("key", F.posexplode("parts").alias("i", "x")).select("key", "i", "x.part", "x.text")
    return texts, counts.groupBy("gram", "label").agg(F.sum("n").alias("n")), {p: float(low[p] or 0.0) for p in STARTS}
