"""URL filters: rules by host and path, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models, of URLs that the rules accept and of
those they reject, give each character its probability after up to ``ORDER``
characters; shorter contexts stand in as far as longer ones are unknown
(Witten-Bell). A URL's score is the difference of the log-likelihoods per
character. The threshold is calibrated on labelled URLs that neither model has seen.

The models read the whole URL after ``://``, query and fragment included, with its host
in lower case; one without ``://`` is read as it is. It has an empty host and path and fits
no rule; a null or empty one scores 0. A very long URL is read whole. If the rules accept or reject none, every score is 0 and the verdict
``allow``. Rows are judged one by one, so ties and repeated rows get equal verdicts;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import query, table
from tidegauge.session import materialise

#: Rules of the registered query: rule and verdict. A rule is a host, and a path from the first slash on.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
ORDER = 5
#: Stands for the characters before a URL's first one.
START = "\x02"
#: Characters of an address that are cut into windows at a time.
PIECE = 256
#: One in so many labelled URLs is kept for calibration.
FOLDS = 5
#: Cells of a unit of score in calibration.
CELLS = 200


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, address``; the address is the whole URL after its scheme, the host in lower case."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    part = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, part, 1), string.ascii_uppercase, string.ascii_lowercase)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    address = F.when(F.contains(url, F.lit("://")), F.concat(host, rest)).otherwise(url)
    shown = {"host": host, "path": F.regexp_extract(url, part, 2), "address": address}
    return pages.select(F.col("page_id").cast("long").alias("page_id"), *(c.alias(name) for name, c in shown.items()))


def with_rule(urls: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``urls`` with the longest rule that fits, and its verdict."""
    fits, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        host, slash, rest = rule.partition("/")
        here = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + rest)
        fits, verdict = F.when(here, F.lit(rule)).otherwise(fits), F.when(here, F.lit(rules[rule])).otherwise(verdict)
    return urls.withColumns({"rule": fits, "ruled": verdict})


def _exploded(urls: DataFrame, *keep: str) -> DataFrame:
    """A row per character of each address: the ``ORDER`` characters before it and itself, the start padded.

    Addresses are cut into overlapping pieces first, as finding a place in a text takes the longer the farther it is.
    """
    padded = F.concat(F.lit(START * ORDER), F.col("address"))
    cut = F.transform(F.sequence(F.lit(1), F.char_length("address"), F.lit(PIECE)), lambda i: F.substring(padded, i, PIECE + ORDER))
    pieces = urls.where(F.char_length("address") > 0).select(*keep, F.explode(cut).alias("piece"))
    windows = F.transform(F.sequence(F.lit(1), F.char_length("piece") - ORDER), lambda i: F.substring(F.col("piece"), i, ORDER + 1))
    return pieces.select(*keep, F.explode(windows).alias("window"))


def _suffixes(counted: DataFrame) -> DataFrame:
    """A row per window and order: the string of that order, and the context before its last character."""
    rows = counted.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ORDER))))
    gram = F.substring(F.col("window"), ORDER + 1 - F.col("k"), F.col("k") + 1)
    return rows.withColumn("gram", gram).withColumn("context", F.substring(F.col("gram"), F.lit(1), F.col("k")))


def window_scores(labelled: DataFrame, urls: DataFrame) -> DataFrame:
    """``window, score``: log-likelihood after acceptance less after rejection, for all windows of ``urls``.

    ``labelled`` has ``ruled``. Windows are counted before anything is joined.
    """
    kinds = {"a": "allow", "r": "block"}
    counted = _exploded(labelled, "ruled").groupBy("window").agg(
        *[F.sum((F.col("ruled") == v).cast("long")).alias(f"n_{k}") for k, v in kinds.items()]
    )
    grams = _suffixes(counted).groupBy("k", "context", "gram").agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds])
    grams = materialise(grams, "grams")
    contexts = grams.groupBy("k", "context").agg(
        *[F.sum(f"n_{k}").alias(f"all_{k}") for k in kinds], *[F.sum((F.col(f"n_{k}") > 0).cast("long")).alias(f"kinds_{k}") for k in kinds]
    )
    # Every string's counts and its context's, side by side: tables of distinct strings.
    known = grams.join(contexts, ["k", "context"]).drop("context", "k")
    alphabet = grams.where("k = 0").count() + 1
    wanted = _suffixes(_exploded(urls).distinct())
    # Contexts count also where the string itself is new.
    rows = wanted.select("window", "k", "gram").join(known.select("gram", "n_a", "n_r"), "gram", "left")
    rows = rows.select("window", "k", F.substring("gram", F.lit(1), F.col("k")).alias("context"), "n_a", "n_r")
    # Every window has the contexts of no and one character: as many as there are characters.
    few = rows.where("k <= 1").join(F.broadcast(contexts.where("k <= 1")), ["k", "context"], "left")
    rows = few.unionByName(rows.where("k > 1").join(contexts.where("k > 1"), ["k", "context"], "left"))
    # A context that was never met leaves the probability as it is; the empty one always was.
    steps = rows.where(F.col("all_a").isNotNull()).groupBy("window").agg(F.array_sort(F.collect_list(F.struct("k", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_r", "all_a", "all_r", "kinds_a", "kinds_r")]))).alias("steps"))

    def probability(kind):
        def longer(p, s):
            total = s[f"all_{kind}"] + s[f"kinds_{kind}"]
            return F.when(total == 0, p).otherwise((s[f"n_{kind}"] + s[f"kinds_{kind}"] * p) / total)

        return F.aggregate("steps", F.lit(1.0 / alphabet), longer)

    return steps.select("window", (F.log(probability("a")) - F.log(probability("r"))).alias("score"))


def with_scores(urls: DataFrame, scores: DataFrame) -> DataFrame:
    """``urls`` with ``score`` per character; equal URLs are scored once."""
    # Windows carry 128 bits of their address's digest; addresses may be long.
    keyed = urls.withColumn("key", F.substring(F.unhex(F.sha2("address", 256)), 1, 16))
    distinct = keyed.select("key", "address").distinct()
    found = _exploded(distinct, "key").join(scores, "window").groupBy("key").agg(F.avg("score").alias("score"))
    return keyed.join(found, "key", "left").drop("key").withColumn("score", F.coalesce("score", F.lit(0.0)))


def calibrated(scored: DataFrame) -> float:
    """Lowest score that is accepted: where the shares of right verdicts in both kinds add up to most.

    Scores are counted in cells, at most a few thousand of them.
    """
    cell = F.floor(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), "score")) * CELLS).cast("int")
    rows = scored.groupBy(cell.alias("cell")).agg(
        F.sum((F.col("ruled") == "allow").cast("long")).alias("a"), F.sum((F.col("ruled") == "block").cast("long")).alias("r")
    ).orderBy("cell").collect()
    if not rows:
        return 0.0
    a, r = (np.array([x[k] for x in rows], float) for k in "ar")
    # Accepting from the i-th cell on.
    gain = (a.sum() - np.concatenate([[0], np.cumsum(a)])) / max(a.sum(), 1) + np.concatenate([[0], np.cumsum(r)]) / max(r.sum(), 1)
    at = int(gain.argmax())
    return rows[at]["cell"] / CELLS if at < len(rows) else (rows[-1]["cell"] + 1) / CELLS


def judge(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``page_id, host, path, rule, score, verdict`` per page."""
    urls = materialise(with_rule(parsed(pages), rules), "urls")
    held_out = F.pmod(F.xxhash64("address"), F.lit(FOLDS)) == 0
    labelled = urls.where("ruled IS NOT NULL")
    learnt = labelled.where(~held_out)
    if learnt.select("ruled").distinct().count() < 2:
        scored, threshold = urls.withColumn("score", F.lit(0.0)), 0.0
    else:
        scored = materialise(with_scores(urls, window_scores(learnt, urls)), "scored")
        threshold = calibrated(scored.where("ruled IS NOT NULL").where(held_out))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", "score", verdict.alias("verdict"))


@query("op10_url_filters")
def op10(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")
