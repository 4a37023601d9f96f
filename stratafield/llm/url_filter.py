"""Host reputation by empirical Bayes, under explicit rules (operator 10).

Labelled page outcomes (bad = 1) are counted by host, registered domain (the
public suffix and one name before it) and public suffix.  Each level's prior is
a beta distribution around the posterior mean of the level above: the share of
bad pages of all pages sits on top, then suffix, domain and host.  The weight
of a level's prior is fitted from the spread of the level's rates around their
parents' means (method of moments, between 2 and 1000 pages).  A host is blocked
when the lower bound of its posterior bad rate (mean minus ``z`` deviations)
passes ``limit``.  User names and ports are no part of a host's name here.

Outcomes are the caller's.  ``page_outcomes`` makes them where pages have no
labels of their own: a bounded sample of labelled documents (``sample`` rows with
the smallest digest of doc_id) tells which kinds of text (``with_kind``:
share of words with runs of signs or shouting, of bars, of repeated words) are
mostly bad, and a page is bad when its text is of such a kind or its url holds a
word of ``URL_WORDS``.

A rule names a host and a path prefix.  It fits that host and its subdomains;
the longest fitting rule decides and the reputation is not asked.

Only counts per host leave the pages.  Every join with a table of hosts, domains
or suffixes is ``look_up``: keys with more than a 1/``HOT`` share of the rows (at
most ``HOT`` of them, whatever the input) are broadcast, the others shuffled; the
hot keys' rows take part in that shuffle under spread keys.

Edge cases: a null url or one without ``://`` has empty host and path, no rule,
and is judged like a host of its own named ''; a page without an outcome counts
for nothing; a page without words has no outcome but by its url; without labels
all kinds of text are good; repeated rows count and are returned row by row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT = 1000
SAMPLE = 4000
TAGS = "(?s)<script\\b.*?</script>|<style\\b.*?</style>|<[^>]*>"
SIGNS = "[%*#$&]{3}(\\s|$)"

#: Words that speak against a page wherever its url holds them, and public
#: suffixes of two names (fixed values).
URL_WORDS = "ads adult bet bets betting bingo casino escort escorts gambling jackpot lottery pills pharma poker porn porno sex slots spam viagra warez xxx".split()
SUFFIXES = """ac.at ac.il ac.in ac.jp ac.kr ac.nz ac.uk ac.za co.at co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au com.bd com.br com.cn com.co
com.eg com.hk com.mx com.my com.ng com.pe com.ph com.pk com.pl com.sa com.sg com.tr com.tw com.ua com.vn edu.au edu.cn edu.in edu.pl edu.tw gen.tr go.jp go.kr gob.ar gob.mx
gov.au gov.br gov.cn gov.in gov.uk gov.za in.ua kiev.ua ltd.uk me.uk ne.jp net.au net.br net.cn net.in net.nz net.pl net.uk nhs.uk or.at or.jp or.kr org.ar org.au org.br
org.cn org.in org.mx org.nz org.pl org.tr org.tw org.uk org.za plc.uk police.uk sch.uk waw.pl web.id blogspot.com github.io wordpress.com""".split()


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.expr("substring({u}, instr({u}, '://') + 3)".format(u="url"))).otherwise("")
    return F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def with_kind(rows: DataFrame) -> DataFrame:
    """``rows`` with the kind of column text, in its place, as four flags; null
    without words.  Counts are columns of their own, so each is taken once."""
    rest = [c for c in rows.columns if c != "text"]
    counts = {"words": F.regexp_count("text", F.lit("\\S+")), "signs": F.regexp_count("text", F.lit(SIGNS)), "shouts": F.regexp_count("text", F.lit("!!")), "distinct": F.size(F.array_distinct(F.split("text", " ")))}
    bars = F.length("text") - F.length(F.replace(F.col("text"), F.lit("|"), F.lit("")))
    counted = rows.select(*rest, *[c.alias(k) for k, c in counts.items()], bars.alias("bars"))
    flags = ["signs > 0.1 * words", "shouts > 0.1 * words", "bars > 0.1 * words", "distinct < 0.5 * words"]
    return counted.select(*rest, F.when(F.col("words") > 0, F.concat(*[F.when(F.expr(f), "1").otherwise("0") for f in flags])).alias("kind"))


def bad_kinds(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """kind: kinds of text of which labelled documents are mostly bad (16 rows at most)."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "quality").limit(sample)
    kinds = with_kind(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("quality", "text")).filter("kind IS NOT NULL")
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("quality")).alias("bad")).filter("2 * (bad + 1) > n + 2").select("kind")


def page_text(html: Column) -> Column:
    return F.replace(F.regexp_replace(html, TAGS, " "), F.lit("&amp;"), F.lit("&"))


def named_badly(url: Column) -> Column:
    return F.coalesce(F.translate(url, UPPER, LOWER).rlike(f"(^|[^a-z0-9])({'|'.join(URL_WORDS)})([^a-z0-9]|$)"), F.lit(False))


def page_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url, outcome of pages (page_id, url, html)."""
    bad = materialize(bad_kinds(docs, labels).agg(F.collect_list("kind").alias("bad_kinds")), "kinds")  # one row of 16 kinds at most
    kinds = with_kind(pages.select("page_id", "url", page_text(F.col("html")).alias("text"))).crossJoin(F.broadcast(bad))
    return kinds.select("page_id", "url", F.when(named_badly(F.col("url")), 1).when(F.col("kind").isNotNull(), F.array_contains("bad_kinds", F.col("kind")).cast("int")).alias("outcome"))


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host; of an address the address."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    long_suffix = F.substring_index(name, ".", -2).isin(SUFFIXES)
    address = name.rlike("^[0-9.]+$") | name.startswith("[")
    part = lambda short, long: F.when(address, name).when(long_suffix, F.substring_index(name, ".", long)).otherwise(F.substring_index(name, ".", short))
    return part(-1, -2), part(-2, -3)


def host_counts(pages: DataFrame) -> DataFrame:
    """host, domain, suffix, n, bad, rows."""
    hosts = pages.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("bad"), F.count(F.lit(1)).alias("rows"))
    suffix, domain = suffix_and_domain(F.col("host"))
    return hosts.withColumns({"domain": domain, "suffix": suffix})


def look_up(rows: DataFrame, table: DataFrame, key: str, times: str, spread: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``table`` (one row per ``key``, ``times``
    rows of ``rows`` each): a left join whose hot keys need no shuffle.  ``spread``:
    columns by which the rows of hot keys are dealt."""
    values = [c for c in table.columns if c not in (key, times)]
    total = table.agg(F.sum(times).alias("_total"))
    split = table.crossJoin(F.broadcast(total)).withColumn("_is_hot", F.col(times) * HOT > F.col("_total"))  # one row
    hot = split.filter("_is_hot").select(key, F.struct(*values).alias("_hot"))  # HOT rows at most
    cold = split.filter("NOT _is_hot").select(F.concat(F.lit("="), F.col(key)).alias("_key"), F.struct(*values).alias("_cold"))
    dealt = F.when(F.col("_hot").isNotNull(), F.concat(F.lit("/"), F.xxhash64(*spread).cast("string"))).otherwise(F.concat(F.lit("="), F.col(key)))
    found = rows.join(F.broadcast(hot), key, "left").withColumn("_key", dealt).join(cold, "_key", "left")
    return found.withColumn("_value", F.coalesce("_hot", "_cold")).select(*rows.columns, *[F.col(f"_value.{v}").alias(v) for v in values])


def _weight(rates: DataFrame) -> Column:
    """Pages that a prior is worth: 1 / the spread of rates beyond what counting explains."""
    m, n = F.col("prior"), F.col("n")
    between = F.sum(n * (F.col("bad") / n - m) ** 2) - F.sum(m * (1 - m))
    share = between / F.greatest(F.sum((n - 1) * m * (1 - m)), F.lit(1e-9))
    return F.least(F.greatest(1 / F.greatest(share, F.lit(1e-3)) - 1, F.lit(2.0)), F.lit(1000.0))


def reputations(counts: DataFrame) -> DataFrame:
    """host, rows, lower (bound of the bad rate), by three levels of shrinkage."""
    top = counts.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("prior"))

    def level(rows: DataFrame, name: str) -> DataFrame:
        strength = rows.filter("n > 0").agg(F.coalesce(_weight(rows), F.lit(2.0)).alias("strength"))
        a = F.col("prior") * F.col("strength") + F.col("bad")
        b = (1 - F.col("prior")) * F.col("strength") + F.col("n") - F.col("bad")
        return rows.crossJoin(F.broadcast(strength)).withColumns({"mean": a / (a + b), "deviation": F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))})  # one row

    mid = materialize(counts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("hosts")), "domains")
    up = mid.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("times")).crossJoin(F.broadcast(top))  # one row
    suffixes = materialize(level(up, "suffix").select("suffix", "times", F.col("mean").alias("prior")), "suffixes")
    domains = level(look_up(mid, suffixes, "suffix", "times", ["domain"]), "domain").select("domain", F.col("hosts").alias("times"), F.col("mean").alias("prior"))
    known = level(look_up(counts, materialize(domains, "priors"), "domain", "times", ["host"]), "host")
    return known.select("host", "rows", "mean", "deviation")


def judge_pages(pages: DataFrame, rules: list[Rule], limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate of pages (page_id, url, outcome)."""
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "outcome")
    counts = materialize(host_counts(named), "hosts")  # outcomes are read off the pages once
    known = reputations(counts).select("host", "rows", F.col("mean").alias("bad_rate"), (F.col("mean") - z * F.col("deviation") > limit).alias("bad"))
    rule, verdict = rule_of(rules)
    judged = look_up(named.drop("outcome"), materialize(known, "reputations"), "host", "rows", ["page_id", "path"])
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), F.lit("block")).otherwise("allow")).alias("verdict"), "bad_rate")
