"""URL filter: rules by host and path, and for the rest a character language-model ratio, in native functions.

Urls that a rule allows or blocks train two variable-order Markov models over unfolded characters: contexts of
four characters down to none, each interpolated with the next shorter by Witten-Bell smoothing. A url that no
rule fits is judged by its mean log-likelihood difference per character against a threshold calibrated on
rule-judged urls that the models were not fitted on. Counts grow with the pages: they are summed before each
shuffle, and orders meet by joins on their characters. What a look-up reads is joined by shuffle too, except
for keys that hold over 1 / SHARES of all rows: there are fewer than SHARES of those, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import settle

#: Fixed by contract: verdict, host, path. A rule fits its host and all subdomains, if the path starts with its own.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Begin and end a url: control characters.
START, END = "\x02", "\x03"
#: Characters of the longest context.
ORDERS = 4
#: A url is held out of the fit, for calibration, if its digest in hexadecimal digits is below: a quarter of all.
HELD = "4"
#: Keys with more than this part of all rows are looked up by broadcast.
SHARES = 10_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null and where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = []
    for verdict, own, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        found.append(F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found)


def grams(text: Column) -> Column:
    """For each character of a url, end included, the character with the ORDERS before it."""
    characters = F.split(F.concat(F.lit(START * ORDERS), text), "")
    cut = lambda own: F.transform(F.sequence(F.lit(1), F.size(own) - ORDERS), lambda i: F.array_join(F.slice(own, i, ORDERS + 1), ""))
    # bound to a name, so that the text is cut into characters once and not for each gram
    return F.transform(F.array(characters), cut)[0]


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, uses, ratio) from (gram, allow, block, uses): smoothed log-likelihood difference of the last character after the others.

    A context that a class never showed leaves all weight to the next shorter one; below no context lies one part
    in the number of characters learnt from, and one for all others.
    """
    kinds = ("allow", "block")
    orders = [counts]
    for size in range(ORDERS, 0, -1):
        orders.append(orders[-1].groupBy(F.substring("gram", 2, size).alias("gram")).agg(*[F.sum(kind).alias(kind) for kind in kinds]))
    singles = orders.pop()
    sums = [f(kind) for kind in kinds for f in (lambda k: F.sum(k).cast("double").alias(f"{k}_n"), lambda k: F.count_if(F.col(k) > 0).cast("double").alias(f"{k}_kinds"))]
    whole = singles.agg(F.struct(*sums, (F.count_if(F.col("allow") + F.col("block") > 0) + 1.0).alias("symbols")).alias("whole")).scalar()
    table = singles.withColumn("whole", whole)
    least = 1.0 / F.col("whole.symbols")
    table = table.select("gram", *[smooth(F.col(kind), F.col(f"whole.{kind}_n"), F.col(f"whole.{kind}_kinds"), least).alias(f"{kind}_p") for kind in kinds])
    for size, order in enumerate(reversed(orders), 1):
        # a context has as many rows as characters follow it
        context = Window.partitionBy(F.substring("gram", 1, size))
        order = order.withColumns({f"{kind}_n": F.sum(kind).over(context) for kind in kinds} | {f"{kind}_kinds": F.count_if(F.col(kind) > 0).over(context) for kind in kinds})
        shorter = table.withColumnRenamed("gram", "last")
        joined = order.withColumn("last", F.substring("gram", 2, size)).join(shorter, "last")
        kept = ["gram", "uses"] if size == ORDERS else ["gram"]
        table = joined.select(*kept, *[smooth(F.col(kind), F.col(f"{kind}_n"), F.col(f"{kind}_kinds"), F.col(f"{kind}_p")).alias(f"{kind}_p") for kind in kinds])
    return table.select("gram", "uses", (F.log("allow_p") - F.log("block_p")).alias("ratio"))


def smooth(n: Column, total: Column, kinds: Column, shorter: Column) -> Column:
    """Witten-Bell: n of total, and the part of kinds of characters seen here goes to the shorter context."""
    return F.when(total > 0, (n + kinds * shorter) / (total + kinds)).otherwise(shorter)


def looked_up(rows: DataFrame, table: DataFrame, key: str, shares: int) -> DataFrame:
    """rows joined to table, which has one row for each key of theirs and how many rows have it, as uses.

    Fewer than `shares` keys have more than 1 / shares of all rows: those are broadcast, so no task gets all rows of one.
    """
    often = F.col("uses") * shares > table.agg(F.sum("uses").alias("uses")).scalar()
    common, rare = (table.where(some).drop("uses") for some in (often, ~often))
    return rows.join(F.broadcast(common), key).unionByName(rows.join(F.broadcast(common.select(key)), key, "left_anti").join(rare, key))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, shares: int = SHARES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages (page_id, url; others are ignored).

    score is the url's mean log ratio, its threshold (mean_a·sd_b + mean_b·sd_a) / (sd_a + sd_b) over the
    rule-judged urls held out of the fit, so that both kinds lie equally many deviations away; halfway where neither
    varies, and 0 unless both kinds are held out. A score at the threshold is allowed. Scores of urls that the models
    were fitted on are theirs too and tell little. A url without host and path is judged like any other, by its
    end character. Rows stay one to one, repeated ones too; null page_ids stay null; an empty table gives no rows; a very long url
    takes memory by its length alone. Equal hosts and paths, named by 128 bits, are scored once.
    """
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("by", rule_for(F.col("host"), F.col("path"), rules))
    text = F.concat("host", "path")
    texts = rows.groupBy(text.alias("text")).agg(*[F.count_if(F.col("by.verdict") == kind).alias(kind) for kind in ("allow", "block")], F.count("*").alias("uses"))
    digest = F.md5("text")
    texts = settle(texts.select(F.unhex(digest).alias("name"), (digest < HELD).alias("held"), "text", "allow", "block", "uses"))
    places = texts.select("name", "held", "allow", "block", F.explode(grams(F.concat("text", F.lit(END)))).alias("gram"))
    learnt = [F.sum(F.when(F.col("held"), 0).otherwise(F.col(kind))).alias(kind) for kind in ("allow", "block")]
    ratios = settle(log_ratios(settle(places.groupBy("gram").agg(*learnt, F.count("*").alias("uses")))))
    scores = looked_up(places.select("name", "gram"), ratios, "gram", shares).groupBy("name").agg((F.sum("ratio") / F.count("*")).alias("score"))
    scored = settle(texts.drop("text").join(scores, "name"))
    stats = []
    for kind in ("allow", "block"):
        n, s = F.col(kind), F.col("score")
        mean = F.sum(n * s) / F.nullif(F.sum(n), F.lit(0))
        stats += [mean.alias(f"{kind}_mean"), F.sqrt(F.greatest(F.sum(n * s * s) / F.nullif(F.sum(n), F.lit(0)) - mean * mean, F.lit(0.0))).alias(f"{kind}_sd")]
    spread = F.col("allow_sd") + F.col("block_sd")
    even = (F.col("allow_mean") + F.col("block_mean")) / 2
    weighed = F.try_divide(F.col("allow_mean") * F.col("block_sd") + F.col("block_mean") * F.col("allow_sd"), spread)
    limit = scored.where("held").agg(*stats).select(F.coalesce(weighed, even, F.lit(0.0)).alias("limit"))
    judged = scored.select("name", "uses", "score", (F.col("score") >= limit.scalar()).alias("good"))
    final = looked_up(rows.withColumn("name", F.unhex(F.md5(text))), judged, "name", shares)
    return final.select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", F.when(F.col("good"), "allow").otherwise("block")).alias("verdict"), "score")


def oracle_sql(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """The same rows as DuckDB SQL, without score."""
    fits = [(own + start, verdict, f"(host = '{own}' OR host LIKE '%.{own}') AND starts_with(path, '{start}')") for verdict, own, start in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    rule = " ".join(f"WHEN {test} THEN '{name}'" for name, _, test in fits)
    verdict = " ".join(f"WHEN rule = '{name}' THEN '{kind}'" for name, kind, _ in fits)

    kinds = ("a", "b")
    each = lambda f: ", ".join(f(k) for k in kinds)
    smoothed = lambda k, shorter: f"CASE WHEN t{k} > 0 THEN (n{k} + k{k} * {shorter}) / (t{k} + k{k}) ELSE {shorter} END AS p{k}"
    longest = ORDERS + 1
    counts = ", ".join(f"n{i} AS (SELECT substr(gram, 2) AS gram, {each(lambda k: f'sum(n{k}) AS n{k}')} FROM n{i + 1} GROUP BY 1)" for i in range(ORDERS, 0, -1))
    after = ", ".join(
        f"p{i} AS (SELECT n.gram, {each(lambda k: smoothed(k, f'p{k}'))} FROM (SELECT *, {each(lambda k: f'sum(n{k}) OVER c AS t{k}, count(*) FILTER (WHERE n{k} > 0) OVER c AS k{k}')}"
        f" FROM n{i} WINDOW c AS (PARTITION BY substr(gram, 1, {i - 1}))) n JOIN p{i - 1} s ON s.gram = substr(n.gram, 2))"
        for i in range(2, longest + 1)
    )
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
ruled AS (SELECT *, CASE {rule} END AS rule, host || path AS text FROM parts),
said AS (SELECT *, CASE {verdict} END AS said FROM ruled),
texts AS (SELECT text, md5(text) < '{HELD}' AS held, count(*) FILTER (WHERE said = 'allow') AS a, count(*) FILTER (WHERE said = 'block') AS b FROM said GROUP BY text),
places AS (SELECT *, unnest(generate_series(1, CAST(length(text) + 1 AS BIGINT))) AS i FROM texts),
grams AS (SELECT text, held, a, b, substr(repeat(chr({ord(START)}), {ORDERS}) || text || chr({ord(END)}), i, {longest}) AS gram FROM places),
n{longest} AS (SELECT gram, {each(lambda k: f"sum(CASE WHEN held THEN 0 ELSE {k} END) AS n{k}")} FROM grams GROUP BY gram),
{counts},
whole AS (SELECT {each(lambda k: f"sum(n{k}) AS t{k}, count(*) FILTER (WHERE n{k} > 0) AS k{k}")}, 1.0 / (count(*) FILTER (WHERE na + nb > 0) + 1.0) AS least FROM n1),
p1 AS (SELECT gram, {each(lambda k: smoothed(k, "least"))} FROM n1 CROSS JOIN whole),
{after},
scored AS (SELECT text, held, a, b, avg(ln(pa) - ln(pb)) AS score FROM grams JOIN p{longest} USING (gram) GROUP BY text, held, a, b),
means AS (SELECT {each(lambda k: f"sum({k} * score) / nullif(sum({k}), 0) AS m{k}, sum({k} * score * score) / nullif(sum({k}), 0) AS q{k}")} FROM scored WHERE held),
devs AS (SELECT *, {each(lambda k: f"sqrt(greatest(q{k} - m{k} * m{k}, 0)) AS d{k}")} FROM means),
bound AS (SELECT coalesce((ma * db + mb * da) / nullif(da + db, 0), (ma + mb) / 2, 0) AS bound FROM devs)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= bound THEN 'allow' ELSE 'block' END) AS verdict
FROM said JOIN scored USING (text) CROSS JOIN bound"""
