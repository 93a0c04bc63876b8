"""URL filters: rules first, then a logistic regression on hashed character n-grams of host and path.

Everything is a Column expression. The weights are one array literal of fixed size, so judging urls
needs no join and no shuffle. A null url, or one without "://", has an empty host and path and is
judged by the method on no n-grams, which is the model's constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
SIZES = (3, 4)
EPOCHS = 120
RATE = 4.0
#: The labelled table is read into one row; a larger one is refused.
MOST_LABELLED = 5000

#: (host, path, verdict), the longest fitting rule wins.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

ALLOWED_WORDS = ("news", "docs", "library", "science", "school", "wiki", "museum", "weather", "recipes", "history")
BLOCKED_WORDS = ("casino", "jackpot", "xxxvideo", "pharmacy-deals", "lottery", "warez", "escort", "free-spins", "crackz", "clickbait")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label; 1 is block): every word as a host and as a path, with neutral company."""
    word = lambda words, label: spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("w"), F.lit(label).alias("label"))
    words = word(ALLOWED_WORDS, 0).unionByName(word(BLOCKED_WORDS, 1))
    forms = F.array(
        F.concat(F.lit("https://www."), "w", F.lit(".org/")),
        F.concat(F.lit("http://"), "w", F.lit(".info/index.html")),
        F.concat(F.lit("https://portal.example.org/"), "w", F.lit("/page/12")),
        F.concat(F.lit("https://my"), "w", F.lit("site.net/en/")),
        F.concat(F.lit("http://m.site.org/a/"), "w", F.lit(".html")),
    )
    return words.select(F.explode(forms).alias("url"), "label")


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bucket(chars: Column, n: int, kind: str):
    return lambda i: F.pmod(F.xxhash64(F.lit(kind), *(F.element_at(chars, i + k) for k in range(n))), F.lit(BUCKETS)).cast("int")


def grams(text: Column, kind: str) -> Column:
    """Buckets of the text's character n-grams, both ends marked; the n-grams of host and path differ by `kind`."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

    def of(c: Column) -> Column:
        parts = []
        for n in SIZES:
            at = F.when(F.size(c) >= n, F.sequence(F.lit(1), F.size(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(at, _bucket(c, n, kind)))
        return F.concat(*parts)

    # Bound to a lambda's variable, or the text would be split anew for every n-gram.
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.get(F.transform(F.array(chars), of), F.lit(0)))


def buckets(host_: Column, path_: Column) -> Column:
    return F.array_distinct(F.concat(grams(host_, "h"), grams(path_, "p")))


def train(labelled: DataFrame) -> list[float]:
    """Weights of the buckets, and of the constant last, by full-batch gradient steps on a small table (url, label).

    The table becomes one row: for each url its buckets, and for each bucket its urls. A step reads
    both lists, so the whole descent is a single fold. Rows with a null label are left out.
    """
    rows = labelled.where("label is not null").select(buckets(host(F.col("url")), path(F.col("url"))).alias("b"), F.col("label").cast("double").alias("y"))
    size = rows.limit(MOST_LABELLED + 1).count()
    if size > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled urls")
    if not size:
        return [0.0] * (BUCKETS + 1)
    one = rows.agg(F.array_sort(F.collect_list(F.struct("b", "y"))).alias("rows"))
    users = f"transform(sequence(0, {BUCKETS - 1}), k -> filter(transform(rows, (r, i) -> if(array_contains(r.b, k), i, -1)), i -> i >= 0))"
    start = f"transform(sequence(0, {BUCKETS}), k -> 0D)"
    margin = f"(aggregate(r.b, 0D, (a, k) -> a + w[k]) / sqrt(1 + size(r.b)) + w[{BUCKETS}])"
    rest = f"transform(rows, r -> (1 / (1 + exp(-{margin})) - r.y) / sqrt(1 + size(r.b)))"
    step = f"""transform(w, (x, k) -> x - {RATE}D / size(rows) * (0.0001D * x +
        if(k = {BUCKETS}, aggregate(e, 0D, (a, v) -> a + v), aggregate(used[k], 0D, (a, i) -> a + e[i]))))"""
    # aggregate(array(x), z, (z, name) -> ...) computes x once and gives it a name.
    epoch = f"aggregate(array({rest}), w, (z, e) -> {step})"
    fold = f"aggregate(array({users}), {start}, (z, used) -> aggregate(sequence(1, {EPOCHS}), z, (w, t) -> {epoch}))"
    return one.select(F.expr(fold).alias("w")).first().w


def judge(urls: DataFrame, weights: list[float], rules=RULES, key: str = "page_id") -> DataFrame:
    """Host, path, rule, the method's block probability and the verdict for every row (key, url)."""
    w = F.lit([float(x) for x in weights])
    parts = urls.select(key, "url").select(F.col(key), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    b = buckets(F.col("host"), F.col("path"))
    parts = parts.withColumn("margin", F.aggregate(b, F.lit(0.0), lambda a, k: a + F.get(w, k)) / F.sqrt(1 + F.size(b)) + F.lit(float(weights[-1])))
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    p = 1 / (1 + F.exp(-F.col("margin")))
    return parts.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("block_probability"))
