"""URL filter: smoothed variable-order Markov models of the characters of accepted and rejected URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rehome.llm.shared import ascii_lower, cut, parts_for

START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null where none does. Equal lengths: by name."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def grams(text: Column, order: int) -> Column:
    """For each character and the end mark: it, preceded by the ``order`` characters before it."""
    padded = F.split(F.concat(F.lit(START * order), text, F.lit(END)), "")
    return F.transform(F.sequence(F.lit(1), F.size(padded) - order), lambda i: F.array_join(F.slice(padded, i, order + 1), ""))


def char_model(counts: DataFrame, order: int, weight: float, letters: int) -> DataFrame:
    """(gram, ratio): log10 of P(last character | those before) in the accepted over the rejected model.

    ``counts`` has (gram, good, bad) of length order + 1. Each order is smoothed towards the next
    shorter one: (count + weight * shorter) / (context count + weight); the shortest towards 1 / letters.
    """
    levels = [counts]
    for k in range(order, 0, -1):
        levels.append(levels[-1].groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    levels.reverse()
    total = levels[0].agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    model = levels[0].select("gram", *[((F.col(c) + 1.0) / (total[i] + float(letters))).alias("p_" + c) for i, c in enumerate(("good", "bad"))])
    for k in range(1, order + 1):
        level = levels[k].withColumn("context", F.expr(f"left(gram, {k})"))
        context = level.groupBy("context").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
        shorter = model.select(F.col("gram").alias("tail"), F.col("p_good").alias("s_good"), F.col("p_bad").alias("s_bad"))
        level = level.withColumn("tail", F.expr(f"right(gram, {k})")).join(context, "context").join(shorter, "tail")
        model = level.select("gram", *[((F.col(c) + weight * F.col("s_" + c)) / (F.col("all_" + c) + weight)).alias("p_" + c) for c in ("good", "bad")])
    return model.select("gram", (F.log10("p_good") - F.log10("p_bad")).alias("ratio"))


def judge_urls(pages: DataFrame, rules: list[Rule], id_column: str = "page_id", url_column: str = "url",
               order: int = 4, weight: float = 2.0, letters: int = 256, text_rows: int = 20_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio) of every row.

    The longest fitting rule decides. Its verdicts also label the URLs that the two models learn from;
    where no rule fits, the verdict is allow when the difference of the two log10 likelihoods of the whole
    URL, divided by the number of characters and the end mark, reaches a threshold. The threshold is
    calibrated on all labelled URLs: the point between the two classes' means at equal distance in
    standard deviations. ``letters`` is the size of the assumed alphabet.

    The models see scheme, host, path, query and fragment as they are written. The characters of distinct URLs
    are counted, weighted by their copies, so one URL that is there very often is one row; its number
    stands for it in the joins on short strings that count, smooth and score. The driver sees three totals and six
    moments. URLs without :// have empty host and path, fit no rule and are judged by the model; a null URL is an empty one,
    judged by the end mark alone. With labels of one class only, that class is every verdict; with
    none, allow. Repeated rows are judged alike; other columns are not read.
    """
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_column).alias("page_id"), url.alias("url"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    texts = rows.groupBy("url").agg(F.count("*").alias("copies"))
    texts = texts.select("url", "copies", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    texts = cut(texts.select("*", name.alias("rule"), verdict.alias("ruled"), F.monotonically_increasing_id().alias("number")))
    spread = parts_for(pages.sparkSession, texts.count(), text_rows)
    parts = texts.select("number", "url", "ruled", "copies").repartition(spread, "number").select(
        "number", "ruled", "copies", F.explode(grams(F.col("url"), order)).alias("gram"))

    def labelled(verdict: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("ruled") == verdict, F.col("copies"))), F.lit(0))

    counts = cut(parts.groupBy("gram").agg(labelled("allow").alias("good"), labelled("block").alias("bad")))
    model = cut(char_model(counts, order, weight, letters))
    scored = parts.select("number", "gram").join(model, "gram").groupBy("number").agg(F.avg("ratio").alias("ratio"))
    scored = cut(texts.join(scored, "number").select("url", "host", "path", "rule", "ruled", "copies", "ratio"))
    fit = {}
    weighted = F.col("copies") * F.col("ratio")
    sums = scored.filter("ruled IS NOT NULL").groupBy("ruled").agg(
        F.sum("copies").alias("n"), F.sum(weighted).alias("s"), F.sum(weighted * F.col("ratio")).alias("ss"))
    for r in sums.collect():
        mean = r["s"] / r["n"]
        fit[r["ruled"]] = mean, max(r["ss"] / r["n"] - mean * mean, 1e-12) ** 0.5
    if len(fit) == 2:
        (good, wide), (bad, narrow) = fit["allow"], fit["block"]
        threshold = (good * narrow + bad * wide) / (wide + narrow)
        judged = F.when(F.col("ratio") >= F.lit(threshold), "allow").otherwise("block")
    else:
        judged = F.lit("block" if "block" in fit else "allow")
    answer = scored.select("url", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "ratio")
    return rows.join(answer, "url").select("page_id", "host", "path", "rule", "verdict", "ratio")
